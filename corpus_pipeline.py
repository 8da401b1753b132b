"""A training corpus in five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, mixing, quality, resemblance, suffix_dedup
from graphloom.llm._shared import Scratch, few


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: sets of word 5-shingles, similar by 0.8 or more, found by SimHash
    tables and MinHash bands and verified whole.

    Rows are told apart by numbers of their own, so rows of one id or of none stay unless their texts are near copies.
    The first by id (null last), then by the text's digest stays.
    """
    scratch = Scratch(spark, "rows")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc"))
    rows = scratch.keep(rows, "numbered")
    groups = scratch.keep(resemblance.similar_rows(rows.select("row", "doc.text"), "row", width=5, similarity=0.8), "groups")
    place = F.struct(F.col("doc.doc_id").isNull(), "doc.doc_id", F.sha2(F.coalesce("doc.text", F.lit("")), 256), "row")
    placed = scratch.keep(rows.select("row", place.alias("place")).join(groups, "row"), "placed")
    first = placed.groupBy("component").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = scratch.keep(first.select("component", "first"), "first")
    spare = placed.join(first, "component").where("place > first").select(F.col("row").alias("spare"))
    spare = scratch.keep(spare, "spare")
    return rows.join(few(spare), rows["row"] == spare["spare"], "left_anti").select("doc.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated strings of 100 bytes; documents of which nothing is left go."""
    rest = suffix_dedup.remove_repeats(docs, window=100, as_text=True, carry=[c for c in docs.columns if c != "text"])
    own = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    columns = [own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return rest.where("n_removed = 0 or trim(kept) <> ''").select(columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", classify_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: The classifier, XXH64 and repeats by bytes have no SQL. tests/llm/test_pipeline.py holds each stage, on what the one
#: before kept, and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written and read again as the next one's."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
