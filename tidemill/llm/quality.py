"""Quality rules: base limits on counts, then robust multivariate outliers. Built-in functions only.

Words are runs of characters other than ASCII white space. The counts of a text
are taken inside its row. Repeated 5-word windows are found by sorting the
row's window hashes (64 bits over the words' own hashes) with their places.

Outliers: rows that pass the base limits give a vector of transformed
statistics (log words, mean word length, symbols, repeated lines and repeated
words by word). For each language and source a minimum-covariance-determinant
estimate is found by concentration steps: each takes the ``H`` part of rows
nearest by Mahalanobis distance and refits mean and covariance to them. Three
starts (medians with spreads from the quartiles, medians with equal spreads, mean
and covariance of all rows) get ``TRIAL`` steps each; the one with the least
determinant goes on until its determinant no longer falls. A group that has settled takes no part in
further steps, so a step reads the rows of the groups that still move. The covariance is scaled so that the
median squared distance is that of a chi-square variable, and a row whose
squared distance exceeds ``limit``, the 99.99 % quantile of that variable, is rejected.

Most texts have no symbol and no repeat at all, so without a floor a source's spread
of those is zero and any repeat in it would be an outlier. The floors are below
what one statistic can reach within the base limits, so each can reject alone:
symbols above 7 and repeated lines above 4 for 100 words, repeated words above
12 %, in a source that has none.

Every step is a grouped sum or a grouped quantile sketch, both combined before
the shuffle, so a source with a third of all rows is no burden to one task. Estimates
are broadcast where there are at most ``INLINE`` groups, a number that is
counted; beyond, rows meet theirs in a join under keys salted by the number of rows.
Both give the same estimates. An estimate carries the inverse of its covariance's
Cholesky factor, so a distance is one expression and plans don't grow with the groups.

Null texts count as empty and fail the base limits. Groups with fewer than
``least`` fitted rows are pooled by language; a pool that is still smaller has
no estimate and rejects nothing. Null languages and sources are groups of their
own. Repeated rows are judged each alike. Other columns pass through, but for
those named like the operator's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import SPACE, forget, keep, let

H = 0.75
TRIAL = 2
STEPS = 20
SETTLED = 1e-3
LEAST = 50
#: 99.99 % quantile of chi-square with 5 degrees of freedom.
LIMIT = 25.745
#: Estimates that are broadcast. Rows of one group for each salt of its key, where rows are joined with estimates.
INLINE = 2000
PER_SALT = 1_000_000
STATS = ("x0", "x1", "x2", "x3", "x4")
#: Median of chi-square with as many degrees of freedom as there are statistics. Least spread of each statistic.
_CHI2_MEDIAN = {5: 4.351}
_FLOOR = (0.3, 0.4, 0.4, 0.3, 0.5)

#: Columns of these names in the input give way to the operator's own.
RESERVED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", "kept", "_w", "_g", "_own", "_pool", "_e", "_s", *STATS)


def repeated_words(words: Column, window: int = 5) -> Column:
    """How many of a row's words lie in windows that occur twice or more in it."""

    def covered(hashes: Column) -> Column:
        last = F.size(hashes) - window
        hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.xxhash64(*[hashes[i + j] for j in range(window)]).alias("h"), i.alias("at")))
        return F.when(last >= 1, let(F.array_sort(hashed), from_sorted)).otherwise(F.lit(0))

    def from_sorted(s: Column) -> Column:
        n = F.size(s)
        twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == x["h"])))
        return let(F.array_sort(F.transform(twice, lambda x: x["at"])), from_places)

    def from_places(at: Column) -> Column:
        n = F.size(at)
        steps = F.transform(at, lambda x, i: F.when(i < n - 1, F.least(F.lit(window), F.get(at, i + 1) - x)).otherwise(F.lit(window)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    return let(F.transform(words, lambda w: F.xxhash64(w)), covered).cast("long")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts of each text beside the other columns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\f\r", "") != "")
    return docs.select(
        "*", let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("_w"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select(*docs.columns, "_w.n_words", "word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [x.alias(name) for name, x in zip(STATS, (
        F.log(n.cast("double")), F.log((F.col("word_chars") + 1) / n) * 4, F.log1p(F.col("n_symbols") * 100 / n), F.log1p(F.col("n_dup_lines") * 100 / n), F.log1p(F.col("n_repeat_words") * 100 / n)), strict=True)]


def _looked_up(rows: DataFrame, groups: DataFrame, key: str, values: list[str], small: bool, how: str = "left") -> DataFrame:
    """``rows`` with the values of their group as the array ``_e``; without one null, or no row where ``how`` is inner. ``groups`` has a row for each key; ``small``: few enough to broadcast."""
    each = groups.select(key, F.array(*[F.col(c).cast("double") for c in values]).alias("_e"))
    if small:
        return rows.join(F.broadcast(each), key, how).select(*rows.columns, "_e")
    salts = 1 + rows.count() // PER_SALT
    each = each.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.withColumn("_s", F.pmod(F.xxhash64(*rows.columns), F.lit(salts))).join(each, [key, "_s"], how).select(*rows.columns, "_e")


def _measured(rows: DataFrame, groups: DataFrame, more: tuple[str, ...] = (), small: bool = True, how: str = "left") -> DataFrame:
    """``rows`` with ``d2`` from the estimate of their group, null without one, and what ``more`` names of that."""
    names = [*_PARTS, *more]
    e = {c: F.col("_e")[i] for i, c in enumerate(names)}
    out = _looked_up(rows, groups, "_g", names, small, how)
    off = F.array(*[F.col(x) - e[f"m{i}"] for i, x in enumerate(STATS)])
    turned = lambda u: F.array(*[reduce(Column.__add__, [e[f"w{i}{k}"] * u[k] for k in range(i + 1)]) for i in range(len(STATS))])
    d2 = F.aggregate(let(off, turned), F.lit(0.0), lambda a, z: a + z * z)
    return out.select(*rows.columns, d2.alias("d2"), *[e[c].alias(c) for c in more])


def _estimate(rows: DataFrame) -> DataFrame:
    """Mean and inverse Cholesky factor of the covariance by group, with a floor on each spread, and the log of the determinant."""
    d = len(STATS)
    sums = [F.avg(x).alias(f"m{i}") for i, x in enumerate(STATS)] + [F.covar_pop(STATS[i], STATS[j]).alias(f"c{i}{j}") for i in range(d) for j in range(i + 1)]
    out = rows.groupBy("_g").agg(F.count("*").alias("n"), *sums)
    for i in range(d):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}") + (F.lit(_FLOOR[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    for i in range(d):
        for j in range(i, -1, -1):
            rest = F.lit(1.0) if i == j else F.lit(0.0)
            for k in range(j, i):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            out = out.withColumn(f"w{i}{j}", rest / F.col(f"l{i}{i}"))
    det = sum((2 * F.log(f"l{i}{i}") for i in range(1, d)), 2 * F.log("l00"))
    return out.withColumn("det", det).select("_g", "n", "det", *_PARTS)


_PARTS = [f"m{i}" for i in range(len(STATS))] + [f"w{i}{j}" for i in range(len(STATS)) for j in range(i + 1)]


def _starts(rows: DataFrame, least: int) -> list[DataFrame]:
    """Three estimates of each group."""
    d = len(STATS)
    q = rows.groupBy("_g").agg(F.count("*").alias("n"), *[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, x in enumerate(STATS)]).where(F.col("n") >= least)
    q = keep(q, "quartiles", sweep=False)
    spread = lambda i: F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(2 * _FLOOR[i]))
    medians = [F.col(f"q{i}")[1].alias(f"m{i}") for i in range(d)]
    diagonal = lambda size: q.select("_g", *medians, *[(1 / size(i) if i == j else F.lit(0.0)).alias(f"w{i}{j}") for i in range(d) for j in range(i + 1)])
    whole = keep(_estimate(rows).where(F.col("n") >= least).select("_g", *_PARTS), "mcd", sweep=False)
    return [diagonal(spread), diagonal(lambda i: F.lit(1.0)), whole]


def _step(rows: DataFrame, groups: DataFrame, h: float, small: bool) -> DataFrame:
    """Each estimate refitted to the ``h`` part of its group's rows that are nearest to it."""
    near = _measured(rows, groups, small=small, how="inner")
    cut = near.groupBy("_g").agg(F.percentile_approx("d2", h, 1000).alias("cut"))
    return keep(_estimate(_looked_up(near, cut, "_g", ["cut"], small, "inner").where(F.col("d2") <= F.col("_e")[0])), "mcd", sweep=False)


def estimates(rows: DataFrame, h: float = H, steps: int = STEPS, least: int = LEAST, inline: int = INLINE) -> DataFrame:
    """The groups' estimates from rows of ``_g`` and ``STATS``, with the ``scale`` of squared distances."""
    starts = _starts(rows, least)
    small = len(starts) * starts[-1].count() <= inline
    # All starts are tried at once, each as a group of its own.
    of = lambda t: F.xxhash64("_g", F.lit(t))
    groups = keep(reduce(DataFrame.unionByName, [g.withColumn("_g", of(t)) for t, g in enumerate(starts)]), "starts", sweep=False)
    every = rows.select(F.explode(F.array(*[of(t) for t in range(len(starts))])).alias("_g"), *STATS)
    for _ in range(TRIAL):
        groups = _step(every, groups, h, small)
    names = reduce(DataFrame.unionByName, [starts[-1].select("_g", of(t).alias("_try"), F.lit(t).alias("_t")) for t in range(len(starts))])
    best = F.min_by(F.struct("det", *_PARTS), F.struct("det", "_t")).alias("best")
    tried = groups.withColumnRenamed("_g", "_try").join(names, "_try")
    groups = keep(tried.groupBy("_g").agg(best).select("_g", "best.*"), "mcd", sweep=False)
    done = []
    for _ in range(steps - TRIAL):
        after = _step(rows, groups, h, small)
        # With an exact cut a step never raises the determinant; one that a sketched cut raises goes round and round.
        goes_on = F.coalesce(F.col("_before") - F.col("det") >= SETTLED, F.lit(False))
        both = keep(after.join(groups.select("_g", F.col("det").alias("_before")), "_g").withColumn("_on", goes_on).drop("_before"), "mcd", sweep=False)
        forget(after)
        done.append(both.where("NOT _on").drop("_on"))
        groups = both.where("_on").drop("_on")
        if groups.isEmpty():
            break
    groups = reduce(DataFrame.unionByName, [*done, groups]).select("_g", *_PARTS)
    scale = _measured(rows, groups, small=small, how="inner").groupBy("_g").agg(F.greatest(F.percentile_approx("d2", 0.5, 1000) / _CHI2_MEDIAN[len(STATS)], F.lit(1.0)).alias("scale"))
    return keep(groups.join(scale, "_g"), "mcd", sweep=False)


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", limit: float = LIMIT, **fit: float) -> DataFrame:
    """``docs`` without its texts, with the counts, ``base_failed``, the scaled squared distance ``d2`` and ``kept``."""
    docs = docs.select(text_col, lang_col, source_col, *[c for c in docs.columns if c not in (text_col, lang_col, source_col, *RESERVED)])
    pool = F.xxhash64(F.lit("pool"), F.col(lang_col), F.col(lang_col).isNull())
    group = F.xxhash64(F.col(lang_col), F.col(source_col), F.col(lang_col).isNull(), F.col(source_col).isNull())
    rows = statistics(docs, text_col).drop(text_col).select("*", base_failed().alias("base_failed"), group.alias("_own"), pool.alias("_pool"), *vector())
    rows = keep(rows, "statistics")
    large = keep(rows.where("NOT base_failed").groupBy("_own").agg(F.count("*").alias("n")).where(F.col("n") >= fit.get("least", LEAST)), "large", sweep=False)
    inline = fit.get("inline", INLINE)
    rows = _looked_up(rows, large, "_own", ["n"], large.count() <= inline).withColumn("_g", F.when(F.col("_e").isNull(), F.col("_pool")).otherwise(F.col("_own"))).drop("_e", "_own", "_pool")
    groups = estimates(rows.where("NOT base_failed").select("_g", *STATS), **fit)
    out = _measured(rows, groups, ("scale",), groups.count() <= inline)
    out = out.withColumn("d2", F.col("d2") / F.col("scale")).drop("scale", "_g", *STATS)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= limit))
