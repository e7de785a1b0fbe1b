"""Importance resampling toward a target: gains of hashed word n-grams, and a draw by Gumbel keys.

A text becomes a table of its words by place (``posexplode``). For orders above 1, a
window over each document puts the following words beside each word with ``lead()``,
and concatenating them gives the runs that start there. Runs are hashed into
``buckets``; buckets are counted over all documents and over all target texts,
combined before the shuffle. A bucket's gain is the log ratio of its smoothed shares
in whole thousandths. The table of places meets the gains and is summed by document.

The table of gains has ``buckets`` rows, so it is broadcast up to ``SMALL`` of them and joined by
a shuffle beyond. Places of one document stand in one task after the scan, so
sums by document leave it as one row each; only orders above 1 exchange words.

A document's key adds to its weight a Gumbel variable from a hash of its id, so the
highest keys are a draw without replacement in proportion to the weights. Their ranks come from
ranges and offsets, not from a window over everything.

Null and empty texts have no features and weight 0; they are scored and never drawn.
Null ids hash as an empty string, and are drawn like others. Repeated rows are scored each alike and tie; ids break ties.
An empty target or corpus gives gains of the smoothing alone. Texts are read
whole. Other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.llm.common import keep
from tidemill.operators.ranking import row_numbers

#: What stands between words, after lower-casing A-Z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
SMALL = 1_000_000
SEED = 2024

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text with A-Z, and no other letters, in lower case."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.filter(F.split(plain, BETWEEN), lambda w: w != "")


def features(texts: DataFrame, orders: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> DataFrame:
    """A row for each run of words of ``texts`` (columns with ``words``), with its ``bucket``; null for a text without any."""
    low, high = orders
    others = [c for c in texts.columns if c != "words"]
    places = texts.select(*others, F.posexplode_outer("words").alias("at", "word"))
    following = W.partitionBy(*others).orderBy("at")
    after = [F.col("word"), *(F.lead("word", i).over(following) for i in range(1, high))]
    places = places.select(*others, *[x.alias(f"w{i}") for i, x in enumerate(after)])
    runs = [F.when(F.col(f"w{n - 1}").isNotNull(), F.concat_ws(" ", *[f"w{i}" for i in range(n)])) for n in range(low, high + 1)]
    run = runs[0] if len(runs) == 1 else F.explode_outer(F.filter(F.array(*runs), lambda r: r.isNotNull()))
    return places.select(*others, run.alias("run")).select(*others, (F.crc32(F.col("run").cast("binary")) % buckets).cast("int").alias("bucket"))


def counted(texts: DataFrame, orders: tuple[int, int], buckets: int) -> DataFrame:
    return features(texts, orders, buckets).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def _texts(rows: DataFrame, text_col: str, *more: Column) -> DataFrame:
    return rows.select(*more, words(F.col(text_col)).alias("words"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", orders: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` for every bucket; a kept table."""
    spark = docs.sparkSession
    row = F.monotonically_increasing_id().alias("row")
    have = keep(counted(_texts(docs, text_col, row), orders, buckets).withColumnRenamed("n", "s"), "have", sweep=False)
    want = keep(counted(_texts(target, text_col, row), orders, buckets).withColumnRenamed("n", "t"), "want", sweep=False)
    total = lambda df, c: df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0]
    all_s, all_t = total(have, "s"), total(want, "t")
    both = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(have, "bucket", "left").join(want, "bucket", "left")
    s, t = (F.coalesce(c, F.lit(0)).cast("double") for c in ("s", "t"))
    ratio = (t + 1) * F.lit(float(all_s + buckets)) / ((s + 1) * F.lit(float(all_t + buckets)))
    return keep(both.select("bucket", F.floor(F.log(ratio) * 1000).cast("long").alias("gain")), "gains", sweep=False)


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """A whole number of thousandths, from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000).cast("long")


def weigh(docs: DataFrame, gain: DataFrame, id_col: str = "doc_id", text_col: str = "text", orders: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> DataFrame:
    """``id_col``, ``n_words``, ``n_features`` and ``weight`` of each row."""
    texts = _texts(docs, text_col, F.col(id_col), F.monotonically_increasing_id().alias("_row")).select(id_col, "_row", F.size("words").alias("_n"), "words")
    gain = gain.withColumnRenamed("bucket", "_b")
    places = features(texts, orders, buckets)
    met = places.join(F.broadcast(gain) if buckets <= SMALL else gain, F.col("bucket") == F.col("_b"), "left")
    sums = met.groupBy(id_col, "_row", "_n").agg(F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    return sums.select(id_col, F.col("_n").cast("long").alias("n_words"), "n_features", "weight")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", orders: tuple[int, int] = (1, 1),
    buckets: int = BUCKETS, least_words: int = 20, percent: int = 10, seed: int = SEED,
) -> DataFrame:
    """``id_col, n_words, n_features, weight, score, rank`` of every row; ``rank`` counts the drawn, the others have none."""
    gain = gains(docs, target, text_col, orders, buckets)
    scored = weigh(docs, gain, id_col, text_col, orders, buckets).withColumn("score", F.col("weight") + gumbel(F.col(id_col), seed))
    scored = keep(scored, "scored")
    may = scored.where(F.col("n_words") >= least_words)
    drawn = may.count() * percent // 100
    numbered = row_numbers(may, [F.desc("score"), F.asc(id_col)], "rank")
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return numbered.unionByName(scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
