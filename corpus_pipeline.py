"""A training-corpus pipeline over `documents`: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents; texts that a stage has cut have their n_chars counted again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fluxloom.llm import decontaminate, jaccard_join, line_dedup, pieces, quality
from fluxloom.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Share of a document's words in benchmark windows above which it goes; up to it only the spans do.
MOST_BENCHMARK = 0.5


def _documents(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("cleaned").alias("text"), "carried.lang", "carried.source", F.length("cleaned").cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and so do documents that the rules reject (NULL and empty texts among them)."""
    return _documents(quality.quality(docs, carry=("lang", "source")).filter("kept"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate lines the first stays; a document whose last word goes with its lines is a copy and goes too."""
    rows = line_dedup.dedup_lines(docs, carry=("lang", "source"))
    return _documents(rows.filter((F.col("n_dropped") == 0) | F.col("cleaned").rlike("[^ \\x09-\\x0D]")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest doc_id stays, once; documents without id link with nothing."""
    found = jaccard_join.jaccard_components(docs).filter("doc_id = component_id").select("doc_id").distinct()
    rows = docs.select(*COLUMNS)
    stay = rows.join(found, "doc_id", "left_semi")
    once = stay.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id").orderBy("text", "lang", "source", "n_chars")))
    return once.filter("turn = 1").select(*COLUMNS).unionByName(rows.filter("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark spans are cut; documents that consist of them to more than MOST_BENCHMARK go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = decontaminate.matched_spans(docs, items, keep_text=True, max_coverage=MOST_BENCHMARK, carry=("lang", "source"))
    return _documents(rows.filter(F.col("cleaned").isNotNull() | (F.col("n_hit") == 0)))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every text, checked to decode to it."""
    import public_tokenizers

    return pieces.sampled_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup_stage), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontamination), ("SentencePiece", sentencepiece)]

#: Edit-distance components and sampled segmentations are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_path(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
