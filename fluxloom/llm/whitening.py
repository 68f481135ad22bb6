"""Embedding whitening from an exact characteristic polynomial.

1. Entries become integers; the fit list is each distinct vector once. Its scatter n * sum(z z') - s s' (z: the vector less
   the floor of its mean, s: the sum of z) is an integer matrix, n * n times the covariance, and is summed exactly.
2. The characteristic polynomial is taken modulo many 31-bit primes, each by reduction to Hessenberg form, one Spark row
   per prime. A bound on the coefficients of matrices without negative eigenvalues says how many primes suffice; Chinese
   remaindering then gives the integers themselves.
3. All roots are real, so the sign changes of the polynomial shifted to t count the roots above t exactly. Bisection on that
   count isolates the leading roots, repeated ones with their multiplicity, and narrows them to ROOT_BITS bits of fraction.
4. Inverse iteration near each root, one Spark row per root, finds its null space in DIGITS-digit arithmetic; the unit
   vectors are rounded to doubles at the very end.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .subvectors import finite_vectors, scaled

COMPONENTS, OFFSET, SCALE = 16, 1_000_000, 64
#: Components stay below this, as sums of products are split into parts that doubles hold exactly.
MAX_COMPONENT = 1 << 40
ROOT_BITS, DIGITS = 160, 100
_WIDE = "decimal(38,0)"


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x): the vectors with finite entries only, as integers floor(scale * c) + offset."""
    rows = finite_vectors(vectors, id_col, vector_col).select("vec_id", scaled(F.col("vector"), scale, MAX_COMPONENT).alias("x"))
    return rows.select("vec_id", F.transform("x", lambda v: v + offset).alias("x"))


def exact_gram(z: np.ndarray) -> np.ndarray:
    """z' z as Python integers. Values are split into 16-bit digits, whose products doubles sum exactly over 2**20 rows."""
    digits, rest = [], z.astype(np.int64)
    while True:
        digits.append((rest & 0xFFFF).astype(np.float64))
        rest = rest >> 16
        if ((rest == 0) | (rest == -1)).all():  # only the sign is left
            if rest.any():
                digits.append(rest.astype(np.float64))
            break
    total = np.zeros((z.shape[1], z.shape[1]), object)
    for start in range(0, len(z), 1 << 20):
        part = [d[start:start + (1 << 20)] for d in digits]
        for i, a in enumerate(part):
            for j, b in enumerate(part):
                total = total + (a.T @ b).astype(np.int64).astype(object) * (1 << 16 * (i + j))
    return total


def _rows(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def scatter(distinct: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums S of the vectors, and the exact scatter matrix.

    Tasks send one row per dimension with sums of theirs; products are taken of what is left after the mean.
    """
    first = distinct.select(F.count("*").alias("n"), *[F.sum(F.col("x")[d].cast(_WIDE)).alias(f"s{d}") for d in range(dims)]).first()
    n, sums = first.n, [int(first[f"s{d}"]) for d in range(dims)] if first.n else [0] * dims
    if not n:
        return 0, sums, np.zeros((dims, dims), object)
    centre = np.array([s // n for s in sums], np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, line = np.zeros((dims, dims), object), np.zeros(dims, object)
        for batch in batches:
            if batch.num_rows:
                z = _rows(batch.column(0), dims) - centre
                total = total + exact_gram(z)
                line = line + z.sum(axis=0).astype(object)
        to_decimal = lambda values: pa.array([decimal.Decimal(int(v)) for v in values], pa.decimal128(38, 0))
        for i in range(dims):
            yield pa.RecordBatch.from_arrays([pa.array([i] * dims, pa.int32()), pa.array(range(dims), pa.int32()), to_decimal(total[i]),
                                              to_decimal([line[i]] * dims)], names=["i", "j", "p", "s"])

    parts = distinct.select("x").mapInArrow(work, f"i int, j int, p {_WIDE}, s {_WIDE}")
    gram, left = np.zeros((dims, dims), object), [0] * dims
    for r in parts.groupBy("i", "j").agg(F.sum("p").alias("p"), F.sum("s").alias("s")).collect():
        gram[r.i, r.j], left[r.i] = int(r.p), int(r.s)
    return n, sums, n * gram - np.outer(np.array(left, object), np.array(left, object))


# --- the characteristic polynomial -------------------------------------------------------------------------------------


def primes_below(top: int, product: int) -> list[int]:
    """The largest primes below *top*, so many that they multiply to more than *product*."""
    small = np.ones(isqrt(top) + 1, bool)
    small[:2] = False
    for p in range(2, isqrt(len(small)) + 1):
        if small[p]:
            small[p * p::p] = False
    divisors, found, have, q = np.flatnonzero(small), [], 1, top - 1
    while have <= product:
        if not (q % divisors[divisors < q] == 0).any():
            found.append(q)
            have *= q
        q -= 1
    return found


def characteristic_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients (constant first) of det(x - matrix) modulo a prime below 2**31."""
    h, n = matrix % p, len(matrix)
    for j in range(n - 2):
        below = np.flatnonzero(h[j + 1:, j])
        if not len(below):
            continue
        k = j + 1 + int(below[0])
        if k != j + 1:
            h[[k, j + 1]] = h[[j + 1, k]]
            h[:, [k, j + 1]] = h[:, [j + 1, k]]
        factor = h[j + 2:, j] * pow(int(h[j + 1, j]), -1, p) % p
        h[j + 2:] = (h[j + 2:] - factor[:, None] * h[j + 1] % p) % p
        h[:, j + 1] = (h[:, j + 1] + (h[:, j + 2:] * factor % p).sum(axis=1)) % p
    polys = [np.array([1], np.int64)]
    for k in range(n):  # expansion along the last column of the leading block
        new = np.zeros(k + 2, np.int64)
        new[1:] = polys[k]
        new[:-1] = (new[:-1] - h[k, k] * polys[k]) % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            new[:i + 1] = (new[:i + 1] - chain * int(h[i, k]) % p * polys[i]) % p
        polys.append(new)
    return polys[n].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients (constant first) of det(x - matrix) for an integer matrix without negative eigenvalues.

    The k-th coefficient is at most C(d, k) * (trace / d)**k, as the mean of eigenvalue products is largest for equal ones.
    """
    d, trace = len(matrix), int(sum(matrix[i, i] for i in range(len(matrix))))
    bound = max((comb(d, k) * trace**k // d**k for k in range(1, d + 1)), default=0) + 1
    primes = primes_below(1 << 31, 2 * bound)
    text = [[str(v) for v in row] for row in matrix]
    shared = spark.sparkContext.broadcast(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array([[int(v) for v in row] for row in shared.value], object)
        for batch in batches:
            ps = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"p": ps, "c": [characteristic_mod((whole % p).astype(np.int64), p) for p in ps]})

    slices = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(slices, "p")
    residues = {r.p: r.c for r in rows.mapInArrow(work, "p long, c array<long>").collect()}
    product = 1
    for p in primes:
        product *= p
    lifts = [(product // p) * pow(product // p, -1, p) for p in primes]
    coefficients = [sum(residues[p][k] * lift for p, lift in zip(primes, lifts, strict=True)) % product for k in range(d + 1)]
    return [c - product if 2 * c > product else c for c in coefficients]


# --- roots -------------------------------------------------------------------------------------------------------------


def roots_above(coefficients: list[int], t: int) -> int:
    """How many roots (with multiplicity) exceed *t*; exact, as the polynomial has real roots only."""
    c = list(coefficients)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += t * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def leading_roots(coefficients: list[int], wanted: int, bits: int = ROOT_BITS) -> list[tuple[int, int]]:
    """(root * 2**bits rounded down, multiplicity) of the largest positive roots, by falling root, up to *wanted* of them.

    Roots closer than 2**-bits to one another count as one repeated root.
    """
    d = len(coefficients) - 1
    fine = [c << bits * (d - k) for k, c in enumerate(coefficients)]  # roots times 2**bits
    while fine and fine[0] == 0:  # roots at 0, known exactly
        fine.pop(0)
    d = len(fine) - 1
    if d < 1:
        return []
    high = -fine[-2] // fine[-1] + 1  # the trace exceeds every root
    out, todo = [], [(0, high, d, 0)]  # (low, high], roots above low, roots above high
    while todo and sum(m for _, m in out) < wanted:
        low, high, above_low, above_high = todo.pop()
        inside = above_low - above_high
        if not inside:
            continue
        if high - low == 1:
            out.append((low, inside))
        elif inside == 1:
            out.append((_narrow(fine, low, high), 1))
        else:
            mid = (low + high) // 2
            above_mid = roots_above(fine, mid)
            todo += [(low, mid, above_low, above_mid), (mid, high, above_mid, above_high)]
    return out


def _value(coefficients: list[int], t: int) -> int:
    v = 0
    for c in reversed(coefficients):
        v = v * t + c
    return v


def _narrow(coefficients: list[int], low: int, high: int) -> int:
    """The single root in (low, high], rounded down to an integer unless it is one itself (then that less 1)."""
    end = _value(coefficients, high)
    if not end:
        return high - 1
    while high - low > 1:
        mid = (low + high) // 2
        v = _value(coefficients, mid)
        if not v:
            return mid - 1
        if (v > 0) == (end > 0):
            high = mid
        else:
            low = mid
    return low


# --- components --------------------------------------------------------------------------------------------------------


def null_space(matrix: np.ndarray, root: int, bits: int, count: int, digits: int = DIGITS) -> list[list[float]]:
    """*count* orthonormal vectors of the eigenvalue root / 2**bits, by inverse iteration in decimals.

    The shift lies half a unit beside the root, so the solve magnifies the wanted directions by some 10**40; three rounds
    with orthogonalisation leave nothing else at double precision.
    """
    with decimal.localcontext() as ctx:
        ctx.prec = digits
        D, n = decimal.Decimal, len(matrix)
        shift = (D(2 * root + 1)) / D(1 << (bits + 1))
        a = np.array([[D(int(v)) for v in row] for row in matrix], object)
        for i in range(n):
            a[i, i] -= shift
        order = list(range(n))
        for k in range(n):
            pivot = max(range(k, n), key=lambda i: abs(a[i, k]))
            if pivot != k:
                a[[k, pivot]] = a[[pivot, k]]
                order[k], order[pivot] = order[pivot], order[k]
            if not a[k, k]:
                a[k, k] = D(10) ** -digits
            if k + 1 < n:
                a[k + 1:, k] = a[k + 1:, k] / a[k, k]
                a[k + 1:, k + 1:] = a[k + 1:, k + 1:] - np.outer(a[k + 1:, k], a[k, k + 1:])

        def solve(v):
            y = np.array([v[i] for i in order], object)
            for i in range(1, n):
                y[i] -= (a[i, :i] * y[:i]).sum()
            for i in range(n - 1, -1, -1):
                y[i] = (y[i] - ((a[i, i + 1:] * y[i + 1:]).sum() if i + 1 < n else D(0))) / a[i, i]
            return y

        # fixed starts that favour no direction
        vectors = [np.array([D((i * (2 * c + 3) * 7919 + 104729 * (c + 1)) % 1009 + 1) for i in range(n)], object) for c in range(count)]
        for _ in range(3):
            done = []
            for v in map(solve, vectors):
                for _ in range(2):
                    for u in done:
                        v = v - u * (u * v).sum()
                    v = v / (v * v).sum().sqrt()
                done.append(v)
            vectors = done
        return [[float(x) for x in v] for v in vectors]


def principal_components(spark: SparkSession, matrix: np.ndarray, count: int = COMPONENTS) -> list[tuple[float, list[float]]]:
    """(eigenvalue, unit vector) of the integer matrix's largest positive eigenvalues, by falling eigenvalue.

    A repeated eigenvalue has as many orthonormal vectors as it is repeated, in no particular order.
    """
    found = leading_roots(characteristic_polynomial(spark, matrix), count)
    shared = spark.sparkContext.broadcast([[str(v) for v in row] for row in matrix])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            whole = [[int(v) for v in row] for row in shared.value]
            yield pa.RecordBatch.from_pydict({"nth": batch.column(0), "vectors": [
                null_space(whole, int(r["root"]), ROOT_BITS, r["times"]) for r in rows]})

    if not found:
        return []
    todo = spark.createDataFrame([(i, str(r), m) for i, (r, m) in enumerate(found)], "nth int, root string, times int")
    solved = {r.nth: r.vectors for r in todo.repartition(len(found), "nth").mapInArrow(work, "nth int, vectors array<array<double>>").collect()}
    pairs = [((2 * root + 1) / (1 << (ROOT_BITS + 1)), v) for i, (root, _) in enumerate(found) for v in solved[i]]
    return pairs[:count]


def whiten(vectors: DataFrame, count: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
           offset: int = OFFSET) -> DataFrame:
    """One row per kept vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Kept are all rows whose vector is neither NULL nor empty nor holds NULL or non-finite entries; repeated rows and ids get
    rows each. All kept vectors must have one length, other lengths end the query with an error, as do entries of 2**40 or
    more after scaling. Only eigenvalues above 0 make components: n distinct vectors give n - 1 at most, so a single one
    (and an empty table) gives no rows. `deviation` is decimal(38,0); beyond that the query ends with an error.
    identity_error is measured on the whitened fit list. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, id_col, vector_col, scale, offset).filter(F.size("x") > 0)
    distinct = cut_lineage(rows.select("x").distinct(), "fit-list", compression="zstd")
    sizes = distinct.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if sizes.least != sizes.most:
        raise ValueError(f"vectors of {sizes.least} to {sizes.most} entries cannot be whitened together")
    out = f"vec_id long, component int, n long, deviation {_WIDE}, whitened double, explained double, identity_error double"
    if sizes.most is None:
        return spark.createDataFrame([], out)
    dims = sizes.most
    n, sums, matrix = scatter(distinct, dims)
    pairs = principal_components(spark, matrix, count)
    trace = int(sum(matrix[i, i] for i in range(dims)))
    if not pairs:
        return spark.createDataFrame([], out)
    # projections of n*x - S on v, over n * sqrt(e), where the matrix's eigenvalue is n * n * e
    axes = np.array([np.array(v) / np.sqrt(e) for e, v in pairs]).T
    centre = np.array([s // n for s in sums], np.int64)
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]  # n*x - S = n*(x - centre) - rest
    explained = [e / trace for e, _ in pairs]

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = x - centre
        most = int(np.abs(z).max(initial=0)) * n + max(map(abs, rest))
        if most * most * dims < 1 << 62:
            off = z * n - np.array(rest, np.int64)
            return off.astype(np.float64) @ axes, (off * off).sum(axis=1)
        off = z.astype(object) * n - np.array(rest, object)
        return off.astype(np.float64) @ axes, (off * off).sum(axis=1)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(pairs), len(pairs) + 1))
        for batch in batches:
            if batch.num_rows:
                w, _ = project(_rows(batch.column(0), dims))
                total += np.hstack([w.T @ w, w.sum(axis=0)[:, None]])
        yield pa.RecordBatch.from_pydict({"i": np.arange(len(pairs), dtype=np.int32), "m": total.tolist()})

    seen = distinct.select("x").mapInArrow(moments, "i int, m array<double>").select("i", F.posexplode("m").alias("j", "v"))
    table = np.zeros((len(pairs), len(pairs) + 1))
    for r in seen.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        table[r.i, r.j] = r.v / n
    error = float(np.abs(table[:, :-1] - np.outer(table[:, -1], table[:, -1]) - np.eye(len(pairs))).max())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(pairs)
        for whole in batches:
            for start in range(0, whole.num_rows, 2_000):
                batch = whole.slice(start, 2_000)
                w, off = project(_rows(batch.column(1), dims))
                deviation = pa.array([decimal.Decimal(int(v)) for v in np.asarray(off).tolist()], pa.decimal128(38, 0))
                repeat, size = np.repeat(np.arange(batch.num_rows), k), batch.num_rows * k
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(repeat)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(size, n)), deviation.take(pa.array(repeat)), pa.array(w.ravel()),
                    pa.array(np.tile(explained, batch.num_rows)), pa.array(np.full(size, error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(work, out)
