"""Centroid clustering over subvector dictionaries: exact integer k-means.

Dimensions are cut into blocks. The distinct subvectors of a block are its dictionary, and a vector is stored as one code
per block, which loses nothing. A round computes the exact squared distance of every dictionary entry to its part of every
centroid once; a vector's distance to a centroid is the sum of the entries its codes point at. Sums for new centroids are
taken by code as well: entries are weighed with the number of vectors that use them, cluster by cluster.

Dictionaries are bounded before they are built: a block's entries are at most the product of the ranges of its dimensions,
and blocks are cut so that all products together stay within MAX_ENTRIES. What is broadcast each round is that table. A
dimension whose range alone would break the bound is kept as plain numbers, whose distances are computed per vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

DIMS, CLUSTERS, ROUNDS, SEED = 64, 16, 3, 1
#: Bound of all dictionaries together: with 16 centroids 32 MB of distances. A block has at most a sixteenth of it.
MAX_ENTRIES = 1 << 18
#: Components stay below this, so that squared distances over 64 dimensions fit a long.
MAX_COMPONENT = 1 << 27


def finite_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): vectors as doubles, without NULL vectors and those with NULL or non-finite entries."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    ends = [F.lit(float(x)) for x in ("inf", "-inf", "nan")]
    return rows.filter(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | x.isin(*ends)))


def scaled(vector: Column, scale: int = 64, limit: int = MAX_COMPONENT) -> Column:
    """Integers floor(scale * x); larger ones than *limit* end the query with an error instead of a wrong distance."""
    whole = F.transform(vector, lambda x: F.floor(x * scale))
    far = F.exists(vector, lambda x: F.abs(x) >= limit / scale)
    return F.when(far, F.raise_error(F.lit("a vector's component is too large for exact distances"))).otherwise(whole)


def first_centroids(rows: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest hash of seed and id: at most *clusters* rows reach the driver."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r.x) for r in rows.orderBy(order, "x").limit(clusters).collect()]


@dataclass(frozen=True)
class Blocks:
    """Which dimensions form a block (`groups`), their least values and ranges, and the dimensions kept plain (`wide`)."""

    groups: tuple[tuple[int, ...], ...]
    wide: tuple[int, ...]
    low: np.ndarray
    span: np.ndarray

    def numbers(self, x: np.ndarray) -> np.ndarray:
        """Every block's subvectors as one number each, in mixed radix: shape (vectors, blocks)."""
        out = np.zeros((len(x), len(self.groups)), np.int64)
        for b, dims in enumerate(self.groups):
            for d in dims:
                out[:, b] = out[:, b] * self.span[d] + (x[:, d] - self.low[d])
        return out

    def subvectors(self, b: int, numbers: np.ndarray) -> np.ndarray:
        """The subvectors behind the numbers of block *b*: shape (entries, dimensions of the block)."""
        out, left = np.zeros((len(numbers), len(self.groups[b])), np.int64), numbers.copy()
        for k, d in reversed(list(enumerate(self.groups[b]))):
            out[:, k] = left % self.span[d] + self.low[d]
            left //= self.span[d]
        return out


def cut_blocks(low: np.ndarray, high: np.ndarray, max_entries: int = MAX_ENTRIES) -> Blocks:
    """Neighbouring dimensions join a block while its product of ranges stays small enough; the sum keeps the bound."""
    span = high - low + 1
    most, room = max(1, max_entries // 16), max_entries
    groups, wide, open_dims, product = [], [], [], 1
    # the share of a block: as if the other dimensions went two to a block
    fair = max(1, 2 * max_entries // max(1, len(span)))
    for d, n in enumerate(span.tolist()):
        if n > min(most, fair):
            wide.append(d)
        elif open_dims and product * n <= min(most, fair):
            open_dims.append(d)
            product *= n
        else:
            if open_dims:
                groups.append(tuple(open_dims))
                room -= product
            open_dims, product = [d], n
    if open_dims:
        groups.append(tuple(open_dims))
        room -= product
    if room < 0:  # one dimension a block was still too much: those with the largest ranges go plain
        for g in sorted(groups, key=lambda g: -int(np.prod(span[list(g)]))):
            if room >= 0:
                break
            room += int(np.prod(span[list(g)]))
            groups.remove(g)
            wide += list(g)
    return Blocks(tuple(groups), tuple(sorted(wide)), low, span)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def dictionaries(rows: DataFrame, blocks: Blocks, dims: int) -> list[np.ndarray]:
    """The sorted numbers of the distinct subvectors of each block; within the bound, so they may come to the driver.

    A task keeps what it has seen, which the bound covers too, and passes every entry on once.
    """
    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [np.zeros(0, np.int64) for _ in blocks.groups]
        for batch in batches:
            numbers = blocks.numbers(_matrix(batch.column(0), dims))
            for b in range(len(known)):
                known[b] = np.union1d(known[b], numbers[:, b])
        yield from (pa.RecordBatch.from_pydict({"block": np.full(len(k), b, np.int32), "number": k}) for b, k in enumerate(known) if len(k))

    found = rows.select("x").mapInArrow(seen, "block int, number long").distinct().toArrow()
    block, number = (found.column(c).to_numpy() for c in ("block", "number"))
    return [np.sort(number[block == b]) for b in range(len(blocks.groups))]


class Assigner:
    """Nearest centroids by code: made on the driver once per round, sent to the tasks."""

    def __init__(self, blocks: Blocks, books: list[np.ndarray], centroids: np.ndarray):
        self.blocks, self.centroids = blocks, centroids
        self.starts = np.concatenate([[0], np.cumsum([len(b) for b in books])]).astype(np.int64)
        parts = [np.zeros((0, len(centroids)), np.int64)]
        for b, book in enumerate(books):
            off = blocks.subvectors(b, book)[:, None, :] - centroids[None, :, list(blocks.groups[b])]
            parts.append((off * off).sum(axis=2))
        self.table = np.concatenate(parts)

    def nearest(self, codes: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each vector; of equally near centroids the smaller number."""
        total = np.zeros((len(codes), len(self.centroids)), np.int64)
        for b in range(codes.shape[1]):
            total += self.table[self.starts[b] + codes[:, b]]
        for k, d in enumerate(self.blocks.wide):
            off = plain[:, k, None] - self.centroids[None, :, d]
            total += off * off
        cluster = total.argmin(axis=1)
        return cluster, np.take_along_axis(total, cluster[:, None], axis=1)[:, 0]


def encode(rows: DataFrame, blocks: Blocks, books: list[np.ndarray], dims: int) -> DataFrame:
    """(vec_id, codes, plain): codes are 32-bit numbers one after another, plain the 64-bit values of wide dimensions."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), dims)
                numbers = blocks.numbers(x)
                codes = np.stack([np.searchsorted(shared.value[b], numbers[:, b]) for b in range(numbers.shape[1])], axis=1) if blocks.groups else numbers
                codes, plain = np.ascontiguousarray(codes, np.int32), np.ascontiguousarray(x[:, list(blocks.wide)])
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "codes": [r.tobytes() for r in codes], "plain": [r.tobytes() for r in plain]})

    return rows.select("vec_id", "x").mapInArrow(work, "vec_id long, codes binary, plain binary")


def _decoded(batch: pa.RecordBatch, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
    codes, plain = (b"".join(batch.column(c).to_pylist()) for c in ("codes", "plain"))
    return (np.frombuffer(codes, np.int32).reshape(batch.num_rows, len(blocks.groups)),
            np.frombuffer(plain, np.int64).reshape(batch.num_rows, len(blocks.wide)))


def new_centroids(encoded: DataFrame, assigner: Assigner, books: list[np.ndarray]) -> np.ndarray:
    """floor(sum / count) of each cluster; empty clusters keep theirs.

    A task counts how often a cluster uses each entry and turns the counts into sums, one row per cluster and dimension.
    """
    blocks, old = assigner.blocks, assigner.centroids
    k, dims = old.shape
    shared = encoded.sparkSession.sparkContext.broadcast((assigner, books))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, dictionary = shared.value
        used = np.zeros((k, len(near.table)), np.int64)
        sums, counts = [[0] * dims for _ in range(k)], np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                codes, plain = _decoded(batch, blocks)
                cluster, _ = near.nearest(codes, plain)
                counts += np.bincount(cluster, minlength=k)
                for b in range(codes.shape[1]):
                    n = near.starts[b + 1] - near.starts[b]
                    used[:, near.starts[b]:near.starts[b + 1]] += np.bincount(cluster * n + codes[:, b], minlength=k * n).reshape(k, n)
                for j, d in enumerate(blocks.wide):
                    for c in range(k):
                        sums[c][d] += int(plain[cluster == c, j].sum())
        for b, dims_of in enumerate(blocks.groups):
            part = used[:, near.starts[b]:near.starts[b + 1]] @ blocks.subvectors(b, dictionary[b])
            for j, d in enumerate(dims_of):
                for c in range(k):
                    sums[c][d] += int(part[c, j])
        yield pa.RecordBatch.from_pydict({"cluster": np.arange(k, dtype=np.int32), "n": counts, "sums": pa.array(sums, pa.list_(pa.int64()))})

    each = encoded.select("codes", "plain").mapInArrow(work, "cluster int, n long, sums array<long>")
    parts = each.select("cluster", "n", F.posexplode("sums").alias("d", "s")).groupBy("cluster", "d")
    new = old.copy()
    for r in parts.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).filter("n > 0").collect():
        new[r.cluster, r.d] = int(r.s) // r.n
    return new


def assigned(encoded: DataFrame, assigner: Assigner) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    shared, blocks = encoded.sparkSession.sparkContext.broadcast(assigner), assigner.blocks

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cluster, distance = shared.value.nearest(*_decoded(batch, blocks))
                yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "cluster": cluster.astype(np.int32), "distance": distance})

    return encoded.mapInArrow(work, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, dims: int = DIMS, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED,
                    id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, max_entries: int = MAX_ENTRIES) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids as integers.

    Kept are vectors of exactly *dims* entries, all finite; NULL vectors, other lengths, NULL, infinite and NaN entries go.
    Repeated rows count each; the start takes repeated ids as they come, ties of a hash by the vector. A NULL id hashes as
    an empty text. With fewer vectors than clusters there are as many clusters as vectors; an empty table gives no rows and no
    centroids. Components of 2**27 or more after scaling end the query with an error. Other columns are not looked at.
    """
    rows = finite_vectors(vectors, id_col, vector_col).filter(F.size("vector") == dims).select("vec_id", scaled(F.col("vector"), scale).alias("x"))
    centroids = first_centroids(rows, clusters, seed)
    if not centroids:
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), np.zeros((0, dims), np.int64)
    ranges = rows.select(*[f(F.col("x")[d]).alias(f"{n}{d}") for d in range(dims) for n, f in (("low", F.min), ("high", F.max))]).first()
    low, high = (np.array([ranges[f"{n}{d}"] for d in range(dims)], np.int64) for n in ("low", "high"))
    blocks = cut_blocks(low, high, max_entries)
    books = dictionaries(rows, blocks, dims)
    encoded = cut_lineage(encode(rows, blocks, books, dims), "codes", compression="zstd")
    at = np.array(centroids, np.int64)
    for _ in range(rounds):
        at = new_centroids(encoded, Assigner(blocks, books, at), books)
    return assigned(encoded, Assigner(blocks, books, at)), at


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add cluster_inertia, inertia and the centroids' SHA-256, which are as many numbers as there are clusters."""
    spark, found = found.sparkSession, cut_lineage(found, "clusters")
    per = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    rows = [(c, s, sum(per.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in per.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
