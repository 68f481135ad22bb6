"""Proportional stratified interleaving into shards, in DataFrame and SQL functions only.

Rows of a source are put into a seeded random order and ranked; rank r of n becomes the fraction (r - u) / n, u being the
source's own random phase in (0, 1). All rows sorted by fraction are the mixture in small: any stretch of them holds each
source in its share, give or take a row. Cutting that order into equal stretches gives shards of one size and one mixture.

Both ranks are exact and no task sorts a source or the corpus. Ranks within a source come from buckets of the random
number (so many that a bucket holds BUCKET_ROWS on average), the global rank from buckets of the fraction, each numbered
within and shifted by the counts of the buckets before it. Identical rows are counted before anything is shuffled and go
on as blocks of at most COPIES rows with random numbers of their own, so a row repeated over and over is no hot key, and
its copies spread over the shards like any others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import id_text

SHARDS, SEED, BUCKET_ROWS, COPIES = 16, 20, 500, 1_000
#: Row counts of so many sources are broadcast, some 10 MB; of more they are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def _random(seed: int, *parts: Column, digits: int = 15) -> Column:
    """A number of 4 * *digits* random bits that depends on *parts* alone; NULL parts count as empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *texts)), 1, digits), 16, 10).cast("long")


def _phase(seed: int, source: Column) -> Column:
    """A number in (0, 1) for each source."""
    return (_random(seed, source, digits=12) + F.lit(0.5)) / F.lit(float(1 << 48))


def _strata(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(source, doc_id, size, text_crc32, digest, block, copies, draw): identical rows as blocks of up to COPIES."""
    text = F.col("text")
    rows = id_text(docs, id_col, text_col, carry=(F.col(source_col).cast("string").alias("source"),)).select(
        # "=" before the name keeps a NULL source apart from an empty one and lets plain joins match it
        F.coalesce(F.concat(F.lit("="), "carried.source"), F.lit("")).alias("source"), "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("digest"))
    each = rows.groupBy("source", "doc_id", "size", "text_crc32", "digest").agg(F.count("*").alias("n"))
    blocks = each.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    return blocks.select("source", "doc_id", "size", "text_crc32", "digest", "block",
                         F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("block") * COPIES).alias("copies"),
                         _random(seed, F.col("doc_id"), F.col("digest"), F.col("block")).alias("draw"))


def _before(counts: DataFrame, bucket: str, within: list[str]) -> DataFrame:
    """(*within*, *bucket*, before): the rows in earlier buckets, as sums over thousands of buckets and within each thousand."""
    counts = counts.withColumn("thousand", F.floor(F.col(bucket) / 1000))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*within, "thousand").agg(F.sum("rows").alias("rows"))
    totals = totals.select(*within, "thousand", F.coalesce(F.sum("rows").over(earlier(*within).orderBy("thousand")), F.lit(0)).alias("above"))
    inner = F.coalesce(F.sum("rows").over(earlier(*within, "thousand").orderBy(bucket)), F.lit(0))
    return counts.withColumn("inner", inner).join(totals, [*within, "thousand"]).select(*within, bucket, (F.col("above") + F.col("inner")).alias("before"))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, text_crc32, digest, fraction, shard, slot): every row's place, one row per row of *docs*.

    Shard sizes differ by one row at most; slots count from 0 in order of the fraction. size is the text's UTF-8 bytes plus
    one, a NULL text has none and the checksum of an empty one; NULL and empty texts differ in `digest`. A NULL source is
    a source of its own, a NULL id an ordinary value. Identical rows are told apart by their copy number only. Ties of the
    random numbers fall to doc_id, size, checksum, digest. Fewer rows than shards leave some shards empty; an empty table
    gives an empty result. Other columns are not looked at.
    """
    strata = cut_lineage(_strata(docs, seed, id_col, text_col, source_col), "strata")
    sizes = strata.groupBy("source").agg(F.sum("copies").alias("n"))
    facts = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("sources")).first()
    total, sizes = int(facts.n), F.broadcast(sizes) if facts.sources <= BROADCAST_SOURCES else sizes
    width = F.lit(float(1 << 60))
    placed = strata.join(sizes, "source").withColumn(
        "bucket", F.floor(F.col("draw") / width * (F.floor(F.col("n") / BUCKET_ROWS) + 1)))
    counts = placed.groupBy("source", "bucket").agg(F.sum("copies").alias("rows"))
    offsets = _before(counts, "bucket", ["source"])
    draws = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size", "text_crc32", "digest", "block")
    first = F.sum("copies").over(draws.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies")
    # dealt by both columns: the exchange of a join on the source alone would bring a whole source into one task
    ranked = placed.repartition("source", "bucket").withColumn("first", first).join(offsets, ["source", "bucket"])
    rows = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    rank = F.col("before") + F.col("first") + F.col("copy")
    rows = rows.select("source", "doc_id", "size", "text_crc32", "digest", "draw", rank.alias("rank"),
                       ((rank - _phase(seed, F.col("source"))) / F.col("n")).alias("fraction"))
    stretch = F.floor(F.col("fraction") * (total // BUCKET_ROWS + 1))
    dealt = cut_lineage(rows.withColumn("stretch", stretch), "interleaved")
    behind = _before(dealt.groupBy("stretch").agg(F.count("*").alias("rows")), "stretch", [])
    order = Window.partitionBy("stretch").orderBy("fraction", "source", "rank")
    final = dealt.withColumn("nth", F.row_number().over(order)).join(behind, "stretch").withColumn("place", F.col("before") + F.col("nth") - 1)
    shard = F.expr(f"place * {shards} div {max(total, 1)}")
    start = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return final.withColumn("shard", shard).select(
        "doc_id", F.when(F.col("source") != "", F.substring("source", 2, 1 << 30)).alias("source"), "size", "text_crc32", "digest",
        "fraction", F.col("shard").cast("int").alias("shard"), (F.col("place") - start).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text",
                 source_col: str = "source", carry: tuple[str, ...] = (), file_rows: int = 100_000) -> DataFrame:
    """Write the rows with their texts to `path/shard=K/`, in slot order within and across files; returns the table.

    A shard's slots are cut into files of *file_rows*, each sorted by one task. Texts are shuffled twice: to their places
    and to their files. Columns named in *carry* come along in a struct `carried`; identical rows share one of them.
    """
    source = F.coalesce(F.concat(F.lit("="), F.col("carried.`source key`")), F.lit(""))
    key = F.col(source_col).cast("string").alias("source key")
    texts = id_text(docs, id_col, text_col, carry=(key, F.struct(*carry).alias("more") if carry else F.lit(None).alias("more")))
    distinct = texts.select(F.struct(source.alias("s"), F.col("doc_id").alias("i"), F.md5(F.col("text").cast("binary")).alias("d")).alias("who"),
                            "text", F.col("carried.more").alias("carried")).dropDuplicates(["who"])
    places = interleave(docs, shards, seed, id_col, text_col, source_col)
    places = places.withColumn("who", F.struct(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("s"), F.col("doc_id").alias("i"), F.col("digest").alias("d")))
    # one field of the key or another may be NULL, so keys are compared NULL-safe as a whole
    rows = places.join(distinct, places.who.eqNullSafe(distinct.who)).select(
        "shard", "slot", "doc_id", "text", "source", *(["carried"] if carry else []))
    piece = F.floor(F.col("slot") / file_rows)
    rows.repartition("shard", piece).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)
