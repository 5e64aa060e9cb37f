"""Five stages from raw documents to packed token sequences; each is written as Parquet and read again as the next one's docs.

Every stage but the last returns the columns of documents. In all of them a null or empty text has no words, no lines to drop, no shingles and one token; repeated rows are rows of their
own until near duplicates, where one id stays or goes with all its rows; an empty table passes through; extra columns, also those named like a result, are carried along unless they
begin with "_". ORACLE_SQL is None: near-duplicate classes and fitted packing can't be stated in SQL, so
tests/llm holds each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import line_dedup, mixing, near_dup, packing, quality
from glyphmill.llm.shared import work_dir
from glyphmill.ship import ship

#: Of the tokens that reach the mixture, so many in a hundred go on.
MIX_FRACTION = 0.9
ORACLE_SQL = None


def _aside(docs: DataFrame, results: tuple[str, ...], stage) -> DataFrame:
    """stage over docs whose columns named like a result step aside meanwhile; the columns of docs come back as they were."""
    moved = {c: f"_aside_{c}" for c in docs.columns if c in results}
    out = stage(docs.withColumnsRenamed(moved))
    return out.drop(*moved).withColumnsRenamed({v: k for k, v in moved.items()}).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others are unchanged."""
    return _aside(docs, ("rejected_by",), lambda d: quality.apply_rules(d).where("rejected_by is null"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines go from all documents but one. A document stays, however little is left of it; n_chars follows its text."""

    def stage(d: DataFrame) -> DataFrame:
        out = line_dedup.dedup_lines(d)
        changed = F.col("n_dropped") > 0
        return out.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text"))).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))

    return _aside(docs, line_dedup.RESULTS, stage)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one with the smallest id."""
    kept = near_dup.near_duplicates(docs).where("kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf of the tree of domain, language and source keeps a seeded prefix within its budget; one epoch, so no document repeats."""
    return _aside(docs, mixing.RESULTS, lambda d: mixing.mix(d, mixing.domain_of(F.col("source")), fraction=MIX_FRACTION, epochs=1))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; what the last one returns."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = work_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
