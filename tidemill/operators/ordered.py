"""Ordered windows by key when one key can hold most of the rows.

A window by key sorts all rows of a key in one task. Here rows are cut by range of key and time,
so a large key becomes several segments and many small keys share one; each segment is
worked on alone, and what the rows before it would add comes as a small
state: the last value, the last few rows, or the session that is still open. States are
taken of the keys at the borders of segments alone, at most two for each segment, so the windows over them stay
small whatever the rows. Small keys inside a segment cost nothing more.

The cut rows are a kept table, since a second sampling of the ranges could cut elsewhere. Rows
that ``order`` doesn't tell apart stay in one segment; end it in a unique column where
many share one instant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.sources.scratch import keep

SEGMENT = "_segment"


def cut(df: DataFrame, key: str, order: list[str], parts: int | None = None) -> DataFrame:
    """``df`` as a kept table with its segment. Null keys sort first and are a key."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(df.repartitionByRange(parts, key, *order).withColumn(SEGMENT, F.spark_partition_id()), "segments")


def borders(rows: DataFrame, key: str) -> DataFrame:
    """``_key`` and its segments, for the keys at the borders of segments that lie in more than one."""
    ends = rows.groupBy(SEGMENT).agg(F.min(F.struct(key)).alias("a"), F.max(F.struct(key)).alias("b"))
    each = ends.select(SEGMENT, F.explode(F.array_distinct(F.array(F.col(f"a.{key}"), F.col(f"b.{key}")))).alias("_key"))
    many = F.count("*").over(W.partitionBy("_key"))
    return keep(each.withColumn("_n", many).where("_n > 1").select("_key", F.col(SEGMENT).alias("_at")), "borders", sweep=False)


def _at_borders(rows: DataFrame, edge: DataFrame, key: str) -> DataFrame:
    return rows.join(F.broadcast(edge), (F.col(SEGMENT) == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key"))).drop("_at", "_key")


def carried(rows: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Rows of ``cut`` with the last ``value`` that isn't null, of the row's own and all earlier rows of its key."""
    edge = borders(rows, key)
    here = F.last(value, ignorenulls=True).over(W.partitionBy(key, SEGMENT).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    last = _at_borders(rows.where(F.col(value).isNotNull()), edge, key).groupBy(F.col(key).alias("_k"), F.col(SEGMENT).alias("_s")).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    state = edge.join(last, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_at") == F.col("_s")), "left")
    before = F.last("_last", ignorenulls=True).over(W.partitionBy("_key").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    state = keep(state.select("_key", "_at", before.alias("_before")), "states", sweep=False)
    met = rows.join(F.broadcast(state), (F.col(SEGMENT) == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    return met.withColumn(name, F.coalesce(here, "_before")).drop("_key", "_at", "_before", SEGMENT)


def moving(rows: DataFrame, key: str, order: list[str], preceding: int, name: str, value: Column) -> DataFrame:
    """Rows of ``cut`` with the aggregate ``value`` over each row and the ``preceding`` rows before it of its key."""
    names = [c for c in rows.columns if c != SEGMENT]
    edge = borders(rows, key)
    near = _at_borders(rows, edge, key).withColumn("_r", F.row_number().over(W.partitionBy(key, SEGMENT).orderBy(*[F.desc(c) for c in order]))).where(F.col("_r") <= preceding)
    # Of the few rows at the ends of segments, the last ones up to each segment's end.
    upto = F.collect_list(F.struct(*names)).over(W.partitionBy(key).orderBy(SEGMENT, *order).rowsBetween(1 - preceding, 0))
    ends = near.withColumn("_upto", upto).where("_r = 1").select(F.col(key).alias("_k"), F.col(SEGMENT).alias("_s"), "_upto")
    state = edge.join(ends, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_at") == F.col("_s")), "left")
    before = F.last("_upto", ignorenulls=True).over(W.partitionBy("_key").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    halo = state.withColumn("_before", before).select(F.col("_at").alias(SEGMENT), F.explode("_before").alias("_row")).select("_row.*", SEGMENT, F.lit(True).alias("_halo"))
    both = rows.withColumn("_halo", F.lit(False)).unionByName(halo)
    w = W.partitionBy(key, SEGMENT).orderBy(*order).rowsBetween(-preceding, 0)
    return both.withColumn(name, value.over(w)).where("NOT _halo").drop("_halo", SEGMENT)


def sessions(rows: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """``key, began, ended, n``: runs of rows of a key whose times lie at most ``gap`` apart, as Spark's session windows join them. Rows of ``cut``; null times don't count."""
    rows, edge = rows.where(F.col(at).isNotNull()), borders(rows, key)

    def runs(df: DataFrame, by: list[str], began: str, ended: str, n: Column) -> DataFrame:
        w = W.partitionBy(*by).orderBy(began, ended)
        fresh = F.coalesce(F.col(began) - F.max(ended).over(w.rowsBetween(W.unboundedPreceding, -1)) > F.expr(f"interval {gap}"), F.lit(True))
        numbered = df.withColumn("_fresh", fresh).withColumn("_no", F.sum(F.col("_fresh").cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
        return numbered.groupBy(*by, "_no").agg(F.min(began).alias("began"), F.max(ended).alias("ended"), n.alias("n")).drop("_no")

    local = runs(rows.select(key, SEGMENT, F.col(at).alias("_a"), F.col(at).alias("_b")), [key, SEGMENT], "_a", "_b", F.count("*"))
    local = keep(local, "sessions")
    ends = local.groupBy(F.col(key).alias("_k"), F.col(SEGMENT).alias("_s")).agg(F.min("began").alias("_first"), F.max("began").alias("_last"))
    ends = edge.join(ends, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_at") == F.col("_s"))).select("_k", "_s", "_first", "_last")
    met = local.join(F.broadcast(ends), (F.col(SEGMENT) == F.col("_s")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    open_ = met.where("began = _first OR began = _last").select(key, "began", "ended", "n").withColumnsRenamed({"began": "_a", "ended": "_b"})
    whole = met.where("_s IS NULL OR (began <> _first AND began <> _last)").select(key, "began", "ended", "n")
    return whole.unionByName(runs(open_, [key], "_a", "_b", F.sum("n")))
