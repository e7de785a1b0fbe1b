"""A corpus made ready for training: the text operators as stages over ``documents``.

Each stage takes what its predecessor kept. The first four return the columns
of ``documents``; the last returns the packed pieces.

* ``language_id`` drops documents without a language or with an unsure one.
* ``jaccard_join`` keeps, of each component of near copies, one row of the document
  with the least id. Different texts under one id are different documents. A
  document without an id counts as one with an id above all others, made from
  its text. Documents without shingles stay.
* ``decontamination`` drops documents that hold a benchmark item.
* ``secret_scans`` replaces each secret by a mark and counts ``n_chars`` anew.
* ``best_fit_packing`` packs what is left.

Columns that a stage adds for its work get names that ``documents`` doesn't have.
A stage's scratch tables go when the next stage starts, since its result has
been written by then; so write a stage's result before calling another stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontamination, jaccard_join, language, packing, secrets
from tidemill.llm.common import forget, fresh, keep, release, small_batches, tables, without

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: SQL can't express training, tokenizing or packing; the stages are tested against brute force.
ORACLE_SQL = None


#: Scratch tables of the stage that ran last.
_left: set[str] = set()


def staged(stage: Stage) -> Stage:
    """``stage``, which first deletes what the stage before has left."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        release(spark, _left, but=docs)
        before = tables()
        out = stage(spark, docs, sf_dir)
        _left.clear()
        _left.update(tables() - before)
        return out

    return run_stage


@staged
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language.judged(docs, language.train(docs))
    key = language.text_key()
    rejected = keep(found.where(~language.accepted(F.col("lang_pred"), F.col("score"))).select(*key), "rejected")
    return without(docs, rejected, key)


@staged
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text_hash = F.xxhash64("text")
    key = {"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62) + F.pmod(text_hash, F.lit(1 << 61))), "h": text_hash, "size": F.coalesce(F.length("text"), F.lit(0))}
    rows = docs.select(*[e.alias(c) for c, e in key.items()], "text")
    found = keep(jaccard_join.join(rows, id_col="id", carry=("h", "size")).where("n_shingles > 0"), "joined")
    each = found.select(F.col("doc_id").alias("id"), "h", "size", "component", "component_id")
    # Of the texts with their component's least id, one stays; there is nearly always one alone.
    first = each.where("id = component_id")
    least = first.groupBy("component").agg(F.min(F.struct("h", "size")).alias("stays"), F.max(F.struct("h", "size")).alias("other")).where("stays <> other")
    also = first.join(least, "component").where(F.struct("h", "size") != F.col("stays"))
    gone = keep(each.where("id <> component_id").select(*key).unionByName(also.select(*key)).distinct(), "gone")
    twice = keep(first.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "twice")
    left = without(docs, gone, key)
    if not twice.limit(1).count():
        return left
    names = {c: fresh(docs, c) for c in key}
    keyed = left.withColumns({names[c]: e for c, e in key.items()})
    again = keyed.join(twice.withColumnsRenamed(names), list(names.values()), "left_semi").dropDuplicates(list(names.values())).select(*docs.columns)
    return without(left, twice, key).unionByName(again)


@staged
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = fresh(docs, "leaks")
    found = decontamination.flag(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), name=name)
    return found.where(F.size(name) == 0).select(*docs.columns)


@staged
def secret_marks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    base, random = fresh(docs, "base_spans"), fresh(docs, "random_spans")
    found = secrets.scan(docs, secrets.train(docs), base=base, random=random)
    some = F.size(base) + F.size(random) > 0
    text = F.when(some, secrets.redacted(F.col("text"), secrets.ordered(base, random))).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(some, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(new).select(*docs.columns)


@staged
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("jaccard_join", near_copies),
    ("decontamination", benchmark_leaks),
    ("secret_scans", secret_marks),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return docs
