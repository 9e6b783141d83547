"""The registered query of each operator: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm import (
    clustering,
    decontaminate,
    html_text,
    line_dedup,
    mixing,
    negatives,
    neighbours,
    ngram_join,
    quality,
    secret_scan,
    sharding,
    substring_dedup,
    toxicity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels the fit must not see."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    score = toxicity.scorer(documents, labels)(F.col("text"))
    scored = documents.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.REJECT_SCORE).cast("int"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assigned(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = ngram_join.Similarity(size=3, percent=90)
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), rule).drop("class")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_report(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secret_scan.BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in base),
        F.sha2(secret_scan.joined_spans(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        secret_scan.joined_spans(F.col("spans")).alias("spans"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hit_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        decontaminate.items_digest(F.col("items")).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.removed_lines(table(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.array_join("removed", ","))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.page_texts(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("bigint"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(table(spark, sf_dir, "embeddings"))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_sharding,
        op3_mixing,
        op4_ngram_join,
        op5_secret_scan,
        op6_decontaminate,
        op7_substring_dedup,
        op8_line_dedup,
        op9_html_text,
        op10_quality,
        op11_clustering,
        op12_neighbours,
        op13_negatives,
    )
}
