"""From raw documents to packed training sequences: quality rules, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of ``documents``. Stages are written as Parquet to the shared scratch folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldhouse.llm import mixing, ngram_join, packing, quality_rules, substring_dedup
from fieldhouse.llm.common import Scratch

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a guaranteed threshold reject go."""
    return quality_rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8, the one with the smallest id stays.

    Rows that repeat an id, or have none, are one group only if their texts are linked; of those with the smallest id
    the text with the smallest hash stays, once. Texts without words link with nothing and all stay.
    """
    linked = ngram_join.link(docs, k=5, num=80, den=100, keys=True).where("_id = root_id AND _th = root_th")
    stay = linked.groupBy("_id", "_th").agg((F.max("n_shingles") > 0).alias("words"), F.count("*").alias("times"))
    stay = Scratch(spark, "near").write(stay.select("_id", "_th", (F.col("words") & (F.col("times") > 1)).alias("again")), "stay")
    named = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("_th", F.xxhash64("text"))
    if stay.where("again").isEmpty():
        return named.join(stay, ["_id", "_th"], "left_semi").select(*docs.columns)
    kept = named.join(stay, ["_id", "_th"])
    once = kept.where("again").dropDuplicates(["_id", "_th"])
    return kept.where("NOT again").unionByName(once).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words or more that occur anywhere else are cut from every document that has them."""
    other = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = substring_dedup.dedup(docs, carry=other)
    cut = cut.withColumn("n_chars", F.length("kept_text").cast("long")).withColumnRenamed("kept_text", "text")
    return cut.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, stored in the order of their slots; rows that repeat id and text share a place."""
    first = F.min(F.struct("slot", "place")).alias("at")
    places = mixing.mix(docs, keys=True).groupBy("_id", "_th").agg(first).select("_id", "_th", "at.slot", "at.place")
    places = Scratch(spark, "mixed").write(places, "places")
    d = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))).withColumn("_th", F.xxhash64("text"))
    return d.join(places, ["_id", "_th"]).sort("slot", "place").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens, numbered in the order of the stored documents.

    That order is the mixing schedule: ``docs`` must be read from the Parquet files of the stage before.
    """
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    return packing.pack(docs, *packing.tokenizer_paths(), order=(part, F.col("_metadata.row_index")))


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("substring_dedup", passages),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
