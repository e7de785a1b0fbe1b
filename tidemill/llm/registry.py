"""The named queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import decontamination, hard_negatives, html_text, importance, jaccard_join, language, near_vectors, packing, quality, secrets, suffix_dedup, token_counts, toxicity
from tidemill.llm.common import documents, keep, remainder
from tidemill.llm.oracles import ORACLES as ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = secrets.scan(docs.select("doc_id", "text"), secrets.train(docs))
    counts = [F.size(F.filter("base_spans", secrets.is_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.written(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.written(secrets.ordered("base_spans", "random_spans")).alias("spans"), F.size("random_spans").cast("long").alias("n_random"),
    )


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = remainder("doc_id", 3) == 1
    model = language.train(docs.where(~held_out))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = remainder("doc_id", 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    lexicon = toxicity.learn(docs.where(~held_out), labels)
    found = keep(toxicity.find(docs, lexicon), "found")
    scored = toxicity.rate(found, toxicity.fit(found.where(~held_out), labels, lexicon))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(keep(token_counts.length_histogram(documents(spark, sf_dir)), "histogram"))


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(documents(spark, sf_dir)))


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0, label=label)


@query
def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
