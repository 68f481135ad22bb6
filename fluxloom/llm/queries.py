"""The registered queries of this subpackage; SQL twins stand in `oracles`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import context_tree, decontaminate, jaccard_join, line_dedup, pieces, pii, quality, secrets, sharding, subvectors, tokens, warc, whitening
from .oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_and_read(table(spark, sf_dir, "pages"), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.withColumn("cleaned_md5", F.md5(F.col("cleaned").cast("binary"))).drop("cleaned")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.sampled_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents")).drop("cleaned")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_spans(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = decontaminate.matched_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return spans.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.corpus_scores(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = sharding.interleave(table(spark, sf_dir, "documents"))
    return places.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subvectors.with_inertia(*subvectors.cluster_vectors(table(spark, sf_dir, "embeddings")))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_line_dedup, op3_sentencepiece, op4_token_counts, op5_quality_rules, op6_secret_scans, op7_jaccard_join, op8_personal_data, op9_decontamination, op10_lm_scores,
                                      op11_sharding, op12_centroid_clusters, op13_embedding_whitening)}
