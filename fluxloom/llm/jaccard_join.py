"""N-gram Jaccard join by prefix filters under several global token orders.

A document's set holds the hashes of its distinct 5-word shingles. Two sets with a Jaccard similarity of t or more share
l tokens among the first n - ceil(t n) + l of each under any order of all tokens. The first order makes the candidates,
the others are intersected with it before two sets are compared. All orders put tokens that many documents share last
(a table of the commonest ones, bounded, read by every task) and are otherwise the orders of different hash functions;
any table gives the same links, a good one fewer candidates.

Groups of alike documents are not expanded into pairs. Equal sets are one node. Of a token's documents each is first
paired with one pivot and one neighbour, those that shared most tokens; the links found merge nodes into components.
Then only pairs of different components that share a token are left. Of either pairs only those are compared whose parity
bitmaps do not already tell more differences than the threshold allows. No pair that could merge components is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import id_text, mix64
from .graph import components

NGRAM, PERCENT, ORDERS = 5, 75, 3
#: Entries of the table of common tokens (12 bytes each), of ids in a broadcast (8 bytes each).
COMMON_TOKENS, BROADCAST_IDS = 200_000, 4_000_000
BITMAP_WORDS = 16  # 1,024 bits
MORE_SHARED = 32  # prefixes under the first order are longer by one token in so many, and so many more must be shared
HOT_CLASS, SALTS = 12, 16  # tokens of 2 ** 12 documents or more are dealt over so many groups
_UPPER = bytes(range(65, 91))
_LOWER_TABLE = bytes(b + 32 if b in _UPPER else b for b in range(256))
_FACTORS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[str | None], ngram: int = NGRAM) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has its whole sequence as one shingle."""
    split = [t.encode("utf-8", "surrogatepass").translate(_LOWER_TABLE).split() if t else [] for t in texts]
    known: dict[bytes, int] = {}
    for ws in split:
        for w in set(ws):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
    out = []
    with np.errstate(over="ignore"):
        for ws in split:
            h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
            if not ws:
                out.append(np.zeros(0, np.int64))
                continue
            size = min(ngram, len(ws))
            g = np.zeros(len(ws) - size + 1, np.uint64)
            for k in range(size):
                g += h[k:k + len(g)] * _FACTORS[k]
            out.append(np.unique(mix64(g + np.uint64(size)).view(np.int64)))
    return out


def prefix(tokens: np.ndarray, order: int, common: tuple[np.ndarray, np.ndarray], percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(t n) + l tokens under one order, and their classes (0: not in the table of common tokens).

    Similar sets share l tokens there, l being that of the smaller set: 1 + n // MORE_SHARED under the first order, else 1.
    """
    n = len(tokens)
    keep = n - (percent * n + 99) // 100 + 1 + (n // MORE_SHARED if order == 0 else 0) if n else 0
    rank = np.zeros(n, np.uint64)
    if len(common[0]) and n:
        at = np.minimum(np.searchsorted(common[0], tokens), len(common[0]) - 1)
        rank = np.where(common[0][at] == tokens, common[1][at], 0).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = (rank << np.uint64(58)) | (mix64(tokens.view(np.uint64) ^ _FACTORS[20 + order]) >> np.uint64(6))
    first = np.argsort(key, kind="stable")[:keep]  # tokens are sorted, so ties fall alike everywhere
    return tokens[first], rank[first].astype(np.int64)


def parity_bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parity of the tokens in each of 1,024 hash cells: two sets' bitmaps differ in no more cells than the sets in tokens."""
    cell = (mix64(tokens.view(np.uint64)) % np.uint64(64 * BITMAP_WORDS)).astype(np.int64)
    odd = (np.bincount(cell, minlength=64 * BITMAP_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


_BITS = [f"p{k}" for k in range(BITMAP_WORDS)]


def _profiles(rows: DataFrame, ngram: int) -> DataFrame:
    """Rows of documents (set size, 128-bit digest of the set, bitmap) and, with `token` set, of tokens that a part of the
    table repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at in range(0, len(keys), 2000):
                sets = shingle_sets(batch.column(1)[at:at + 2000].to_pylist(), ngram)
                digest = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]).reshape(-1, 2)
                bits = np.array([parity_bitmap(s) for s in sets]).reshape(-1, BITMAP_WORDS)
                token, n = np.unique(np.concatenate(sets), return_counts=True)
                token, n = token[n >= 4], n[n >= 4]
                none = pa.nulls(len(token), pa.int64())
                put = lambda a: pa.concat_arrays([pa.array(a, pa.int64()), none])
                cols = {"doc_id": put(keys[at:at + 2000]), "n": pa.concat_arrays([pa.array([len(s) for s in sets], pa.int64()), pa.array(n, pa.int64())]),
                        "d1": put(digest[:, 0]), "d2": put(digest[:, 1]), **{c: put(bits[:, k]) for k, c in enumerate(_BITS)},
                        "token": pa.concat_arrays([pa.nulls(len(sets), pa.int64()), pa.array(token, pa.int64())])}
                yield pa.RecordBatch.from_pydict(cols)

    return rows.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, " + ", ".join(f"{c} long" for c in _BITS) + ", token long")


def _prefixes(rows: DataFrame, ngram: int, percent: int, shipped) -> DataFrame:
    """(token, salt, doc) under the first order; of equal sets in one task the first document only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(keys), 1000):
                token, salt, doc = [], [], []
                for key, s in zip(keys[at:at + 1000].tolist(), shingle_sets(batch.column(1)[at:at + 1000].to_pylist(), ngram)):
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    if len(s) and digest not in seen:
                        seen.add(digest)
                        first, rank = prefix(s, 0, shipped.value, percent)
                        token.append(first)
                        salt.append(np.where(rank >= HOT_CLASS, 1 + key % SALTS, 0))
                        doc.append(np.full(len(first), key))
                if token:
                    yield pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate(token), pa.int64()), "salt": pa.array(np.concatenate(salt), pa.int32()),
                                                      "doc": pa.array(np.concatenate(doc), pa.int64())})

    return rows.filter("doc_id IS NOT NULL").mapInArrow(run, "token long, salt int, doc long")


def _sets(rows: DataFrame, ngram: int, percent: int, orders: int, shipped) -> DataFrame:
    """(doc, tokens, o1, o2, …): the set and its prefixes under the further orders."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = shingle_sets(part.column(1).to_pylist(), ngram)
                yield pa.RecordBatch.from_pydict({
                    "doc": part.column(0), "tokens": pa.array(sets, pa.list_(pa.int64())),
                    **{f"o{k}": pa.array([prefix(s, k, shipped.value, percent)[0] for s in sets], pa.list_(pa.int64())) for k in range(1, orders)}})

    return rows.mapInArrow(run, "doc long, tokens array<long>" + "".join(f", o{k} array<long>" for k in range(1, orders)))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, percent: int = PERCENT,
                       orders: int = ORDERS) -> DataFrame:
    """doc_id, n_shingles, component_id per row; the component is the smallest doc_id that links reach, itself included.

    Sets link when 100 * intersection >= percent * union. A NULL or blank text has an empty set and links with nothing.
    Rows that share a doc_id are one node with the links of each. A NULL doc_id has a NULL component.
    """
    rows = id_text(docs, id_col, text_col)
    spark = rows.sparkSession
    found = cut_lineage(_profiles(rows, ngram), "profiles")
    nodes = found.filter("token IS NULL").drop("token")
    # the commonest tokens, with the logarithm of their count: a bounded table that only orders
    top = found.filter("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(COMMON_TOKENS).toPandas()
    top = top.sort_values("token")
    shipped = spark.sparkContext.broadcast((top["token"].to_numpy(np.int64), np.log2(np.maximum(top["n"].to_numpy(np.float64), 1)).astype(np.int64)))

    # equal sets are one node, named by its smallest document
    sets = nodes.filter("n > 0 AND doc_id IS NOT NULL")
    named = cut_lineage(sets.groupBy("d1", "d2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in _BITS]), "nodes")
    member = cut_lineage(sets.select("doc_id", "d1", "d2").join(named.select("d1", "d2", "node"), ["d1", "d2"]).select(
        F.col("doc_id").alias("doc"), "node"), "members")
    # the sets of one document link with one another
    spread = member.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("doc", "a")
    own = cut_lineage(member.join(spread, "doc").filter("node > a").select("a", F.col("node").alias("b")).distinct(), "own-links")

    # tokens that several documents have, each document with the token's first and its neighbour
    from pyspark.sql import Window
    order = Window.partitionBy("token", "salt").orderBy("doc")
    tokens = _prefixes(rows, ngram, percent, shipped).select(
        "*", F.min("doc").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("first"), F.lag("doc").over(order).alias("before"),
        F.lead("doc").over(order).alias("after"))
    # a salted token is shared by another group's documents perhaps, so all its rows stay
    shared = cut_lineage(tokens.filter("before IS NOT NULL OR after IS NOT NULL OR salt > 0").drop("after"), "shared-tokens")

    def best(pairs: DataFrame) -> DataFrame:
        """Of each document's partners the one with most tokens shared, and their number."""
        n = pairs.filter("doc <> other").groupBy("doc", "other").count()
        return n.groupBy("doc").agg(F.max_by("other", F.struct("count", -F.col("other"))).alias("other"), F.max("count").alias("met"))

    heads = shared.filter("salt > 0").groupBy("token", "salt").agg(F.min("doc").alias("doc"))
    tops = heads.groupBy("token").agg(F.min("doc").alias("other"))
    pairs = best(shared.select("doc", F.col("first").alias("other"))).union(best(shared.select("doc", F.col("before").alias("other")))).union(
        best(heads.join(tops, "token").select("doc", "other")))  # these three choose what is compared first, and leave out nothing
    to = lambda side, name: member.select(F.col("doc").alias(side), F.col("node").alias(name))
    pairs = pairs.join(to("doc", "x"), "doc").join(to("other", "y"), "other").filter("x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.max("met").alias("met"))
    # |x| + |y| - 2 common <= (1 - t) / (1 + t) (|x| + |y|), and the smaller set has t of the larger
    apart = " + ".join(f"bit_count(x.{c} ^ y.{c})" for c in _BITS)
    possible = (f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
                f" AND {100 + percent} * ({apart}) <= {100 - percent} * (x.n + y.n)")
    marks = named.select("node", "n", *_BITS)
    near = pairs.join(marks.alias("x"), F.expr("a = x.node")).join(marks.alias("y"), F.expr("b = y.node")).filter(
        F.expr(f"{possible} AND met > least(x.n, y.n) div {2 * MORE_SHARED}"))
    near = cut_lineage(near.select("a", "b"), "near-pairs")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs whose prefixes meet under every further order and whose sets are similar enough."""
        ids = cut_lineage(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "pair-ids")
        some = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")
        has = cut_lineage(_sets(some, ngram, percent, orders, shipped), "sets")
        one, two = (has.select(*[F.col(c).alias(f"{c}_{s}") for c in has.columns]) for s in "ab")
        both = pairs.join(one, F.col("a") == F.col("doc_a")).join(two, F.col("b") == F.col("doc_b"))
        for k in range(1, orders):
            both = both.filter(F.arrays_overlap(f"o{k}_a", f"o{k}_b"))
        common = F.size(F.array_intersect("tokens_a", "tokens_b"))
        return both.filter(100 * common >= percent * (F.size("tokens_a") + F.size("tokens_b") - common)).select("a", "b")

    links = cut_lineage(linked(near).union(own), "links")
    labels = components(links)

    # what is left: pairs of different components that share a token
    placed = member.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select(
        "doc", "node", F.coalesce("label", "node").alias("label"))
    spots = shared.select("token", "doc").join(placed, "doc").select("token", "node", "label").distinct()
    mixed = spots.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    wide = spots.join(mixed.select("token"), "token", "left_semi").join(marks, "node")
    left = wide.alias("x").join(wide.alias("y"), F.expr(f"x.token = y.token AND x.label < y.label AND {possible}"))
    left = left.groupBy(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).agg(
        F.count("*").alias("met"), F.min(F.least("x.n", "y.n")).alias("n")).filter(f"met > n div {MORE_SHARED}")
    left = left.select("a", "b").join(near, ["a", "b"], "left_anti")
    more = cut_lineage(linked(cut_lineage(left, "left-pairs")), "links")
    labels = components(links.union(more))
    final = member.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").groupBy("doc").agg(
        F.min(F.coalesce("label", "node")).alias("component_id"))
    return nodes.join(final, F.col("doc_id") == F.col("doc"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
