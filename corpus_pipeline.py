"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last keep the columns of
documents. Rows with null or empty text pass through every filter by the rules of its
operator; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidmart.llm import neardup, packing, quality, suffix, toxicity
from vidmart.llm.common import WORK_ROWS, in_files, saved, small_batches


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose quality score reaches the threshold."""
    model = quality.fit(docs.select("doc_id", "text"), _labels(spark, sf_dir))
    scored = quality.score_quality(docs, model, *docs.columns, name="_llm_score")
    return scored.where(F.col("_llm_score") >= quality.THRESHOLD).drop("_llm_score")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score reaches the threshold."""
    model = toxicity.fit(docs.select("doc_id", "text"), _labels(spark, sf_dir))
    scored = toxicity.score_toxicity(docs, model, *docs.columns, evidence=0, name="_llm_score")
    return scored.where(F.col("_llm_score") < toxicity.THRESHOLD).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the one with the smallest doc_id.

    Rows are told apart by their place, so rows that repeat a doc_id go only if they are near
    copies; among them, and among rows without a doc_id (which come last), the first row stays."""
    rows = docs.withColumn("_llm_row", F.monotonically_increasing_id())
    found = neardup.near_duplicates(rows.select(F.col("_llm_row").alias("doc_id"), "text"), size=5)
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("_llm_row").alias("row"))
    groups = found.select(F.col("doc_id").alias("_llm_row"), "component_id").join(rows.select("_llm_row", order.alias("place")), "_llm_row")
    stay = groups.groupBy("component_id").agg(F.min("place").alias("first")).select(F.col("first.row").alias("_llm_row"))
    return in_files(rows.join(stay, "_llm_row", "left_semi").select(*docs.columns), docs.count(), WORK_ROWS)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut byte strings that occurred before out of the texts; n_chars follows."""
    out = in_files(suffix.without_repeats(docs), docs.count(), WORK_ROWS)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of the remaining texts in sequences."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [("quality classifier", good_quality), ("toxicity", not_toxic), ("MinHash near-dedup", one_of_each),
          ("suffix-array dedup", no_repeats), ("best-fit packing", packed)]

#: Learned scores and hashing are beyond SQL; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
