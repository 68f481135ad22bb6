"""Sharding, centroid clusters and whitening: brute force, odd tables, skew."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.llm import sharding, subvectors, whitening

VECTORS = "vec_id long, embedding array<float>"
RNG = np.random.default_rng(8)


def shards_by_hand(rows, shards=16, seed=20):
    """(doc_id, text, source) rows to (doc_id, source, shard, slot, size, crc), from the description alone."""
    strata = {}
    seen = Counter()
    for doc_id, text, source in rows:
        digest = "" if text is None else hashlib.md5(text.encode()).hexdigest()
        key = "" if source is None else "=" + source
        copy = seen[key, doc_id, digest]
        seen[key, doc_id, digest] += 1
        draw = int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}:{digest}:{copy // 1000}".encode()).hexdigest()[:15], 16)
        strata.setdefault(key, []).append((draw, copy, doc_id, text, source))
    order = []
    for key, found in strata.items():
        phase = (int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:12], 16) + 0.5) / 2.0 ** 48
        order += [((r + 1 - phase) / len(found), key, r, *row[2:]) for r, row in enumerate(sorted(found, key=lambda f: f[:2]))]
    order.sort(key=lambda o: o[:3])
    out, n = [], len(order)
    for g, (_, _, _, doc_id, text, source) in enumerate(order):
        shard = g * shards // n
        out.append((doc_id, source, shard, g - -(-shard * n // shards), len((text or "").encode()) + 1, zlib.crc32((text or "").encode())))
    return out


def places(df, **kw):
    return [tuple(r) for r in sharding.interleave(df, **kw).select("doc_id", "source", "shard", "slot", "size", "text_crc32").collect()]


def test_shards_equal_the_description_with_a_hot_source_and_hot_rows(spark):
    rows = [(i, f"text {i}", "big") for i in range(1300)] + [(i, f"tëxt {i}", f"s{i % 7}") for i in range(2000, 2300)] + [(7, "again", "big")] * 2500
    rows += [(None, None, None), (None, "", ""), (1, None, "lone"), (1, "", "lone"), (3, "x" * 100_000, None)]
    got = places(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert Counter(got) == Counter(shards_by_hand(rows))
    sizes = Counter(g[2] for g in got)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(g[3] for g in got if g[2] == s) == list(range(sizes[s])) for s in sizes)
    big, each = Counter(g[2] for g in got if g[1] == "big"), Counter(g[1] for g in got)["big"] / 16
    assert max(abs(big[s] - each) for s in sizes) <= 4


def test_shards_of_small_and_empty_tables_and_other_columns(spark):
    few = spark.createDataFrame([(1, "a", "s"), (2, "b", "s"), (3, "c", "t")], "doc_id long, text string, source string")
    assert sorted(g[2] for g in places(few)) == [0, 5, 10]
    more = few.select("*", *[F.lit("x").alias(c) for c in ("n", "draw", "bucket", "rank", "shard", "slot", "size", "before", "copies", "carried")])
    assert Counter(places(more)) == Counter(places(few))
    assert places(few.filter("false")) == []


def test_written_shards_hold_the_texts_in_slot_order(spark, tmp_path):
    rows = [(i, f"text {i}", f"s{i % 3}") for i in range(200)] + [(None, None, None), (5, "twin", "s0"), (5, "twin", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    table = sharding.write_shards(docs, str(tmp_path / "shards"), shards=4, carry=("lang",), file_rows=20)
    got = [(r.doc_id, r.text, r.source) for r in table.collect()]
    assert Counter(got) == Counter(rows) and {r.carried.lang for r in table.collect()} == {"en"}
    want = {(d, s, sh, sl) for d, s, sh, sl, _, _ in places(docs, shards=4)}
    assert {(r.doc_id, r.source, r.shard, r.slot) for r in table.collect()} == want


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], VECTORS)


def clusters_by_hand(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    starts = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in starts]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(col) // len(groups[j]) for col in zip(*groups[j])] if j in groups else c for j, c in enumerate(centroids)]
    return Counter((i, near(v)[1], near(v)[0]) for i, v in kept), centroids


ODD = [(900, None), (901, []), (902, [1.0] * 63), (903, [0.5] * 63 + [None]), (904, [0.5] * 63 + [float("nan")]), (905, [0.5] * 63 + [float("inf")]),
       (None, [0.25] * 64), (906, [0.25] * 64), (906, [0.25] * 64)]


@pytest.mark.parametrize("max_entries", [1 << 18, 3000, 16])
def test_clusters_equal_brute_force_with_any_dictionary_bound(spark, max_entries):
    rows = [(i, RNG.normal(0, 0.2, 64)) for i in range(120)] + [(200 + i, [1.5] * 64) for i in range(40)] + ODD
    found, at = subvectors.cluster_vectors(vectors(spark, rows), max_entries=max_entries)
    want, centroids = clusters_by_hand(rows)
    assert Counter(tuple(r) for r in found.collect()) == want and at.tolist() == centroids
    low, high = np.full(64, -40), np.full(64, 40)
    blocks = subvectors.cut_blocks(low, high, max_entries)
    assert sum(int(np.prod([81] * len(g))) for g in blocks.groups) <= max_entries
    assert sorted([d for g in blocks.groups for d in g] + list(blocks.wide)) == list(range(64))


def test_clusters_of_small_empty_and_huge_vectors(spark):
    two = vectors(spark, [(1, [0.0] * 64), (2, [1.0] * 64)])
    rows = subvectors.with_inertia(*subvectors.cluster_vectors(two.withColumn("cluster", F.lit("x")).withColumn("x", F.lit(1)))).collect()
    assert sorted((r.vec_id, r.distance, r.inertia) for r in rows) == [(1, 0, 0), (2, 0, 0)]
    found, at = subvectors.cluster_vectors(two.filter("false"))
    assert subvectors.with_inertia(found, at).count() == 0
    wide = [(i, np.r_[RNG.normal(0, 30_000, 3), RNG.normal(0, 1, 61)]) for i in range(60)]
    got, _ = subvectors.cluster_vectors(vectors(spark, wide))
    assert Counter(tuple(r) for r in got.collect()) == clusters_by_hand(wide)[0]
    with pytest.raises(Exception, match="too large"):
        subvectors.cluster_vectors(vectors(spark, [(1, [3e7] * 64)]))


@pytest.mark.parametrize("dims", [1, 2, 5, 9])
def test_characteristic_polynomial_and_roots_are_exact(spark, dims):
    m = RNG.integers(-50, 50, (dims, dims + 2)).astype(object)
    a = m @ m.T
    coefficients = whitening.characteristic_polynomial(spark, a)
    x = 12345
    shifted = [[(x if i == j else 0) - int(a[i, j]) for j in range(dims)] for i in range(dims)]
    sign, value, rest = 1, 1, [[v for v in row] for row in shifted]
    for k in range(dims - 1):  # fraction-free elimination
        for i in range(k + 1, dims):
            for j in range(k + 1, dims):
                rest[i][j] = (rest[i][j] * rest[k][k] - rest[i][k] * rest[k][j]) // value
        value = rest[k][k]
    assert sum(c * x ** k for k, c in enumerate(coefficients)) == sign * rest[-1][-1]
    roots = [r / 2.0 ** whitening.ROOT_BITS for r, _ in whitening.leading_roots(coefficients, dims)]
    assert np.allclose(roots, np.linalg.eigvalsh(a.astype(float))[::-1], rtol=1e-10)


def test_repeated_and_zero_roots():
    # (x - 3)**2 (x - 5) x**2
    coefficients = [0, 0, -45, 39, -11, 1]
    unit = 1 << whitening.ROOT_BITS
    assert [(round(r / unit, 9), m) for r, m in whitening.leading_roots(coefficients, 16)] == [(5.0, 1), (3.0, 2)]
    assert whitening.roots_above(coefficients, 2) == 3 and whitening.roots_above(coefficients, 4) == 1
    a = np.array([[4, 0, 0], [0, 4, 0], [0, 0, 1]], object)
    found = np.array(whitening.null_space(a, 4 * unit - 1, whitening.ROOT_BITS, 2))
    assert np.allclose(found @ found.T, np.eye(2), atol=1e-14) and np.allclose(found[:, 2], 0, atol=1e-14)


def test_gram_is_exact():
    z = np.concatenate([RNG.integers(-(1 << 40), 1 << 40, (50, 3)), [[0, -1, 1]]])
    assert (whitening.exact_gram(z) == z.astype(object).T @ z.astype(object)).all()
    small = RNG.integers(-1, 1, (9, 2))
    assert (whitening.exact_gram(small) == small.T @ small).all()


def test_whitening_equals_numpy_and_odd_rows_go(spark):
    mix = RNG.normal(size=(6, 6))
    x = RNG.normal(size=(80, 6)) @ mix
    rows = [(i, v) for i, v in enumerate(x)] + [(1, x[1])] * 3 + [(700, x[9]), (None, x[2]), (90, None), (91, [1.0] * 5 + [None]), (92, [float("nan")] * 6), (93, [])]
    df = vectors(spark, rows)
    got = whitening.whiten(df, count=4).toPandas()
    kept = [(i, np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) + 1_000_000) for i, v in rows[:85]]
    fit = np.unique(np.array([v for _, v in kept]), axis=0)
    n, total = len(fit), fit.sum(axis=0)
    e, q = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, q = e[::-1][:4], q[:, ::-1][:, :4]
    assert len(got) == 85 * 4 and set(got.n) == {n} and got.identity_error.max() < 1e-10
    want = {}
    for i, v in kept:
        want.setdefault(i, (int(((n * v - total) ** 2).sum()), (v - total / n) @ q / np.sqrt(e)))
    for c in range(4):
        part = got[got.component == c + 1]
        assert np.allclose(part.explained, e[c] / np.trace(np.cov(fit.T, bias=True)), rtol=1e-10)
        mine = np.array([w for w in part.whitened])
        ref = np.array([want[None if np.isnan(i) else int(i)][1][c] for i in part.vec_id])
        assert min(np.abs(mine - ref).max(), np.abs(mine + ref).max()) < 1e-9
    assert all(int(d) == want[None if np.isnan(i) else int(i)][0] for i, d in zip(got.vec_id, got.deviation))


def test_whitening_of_degenerate_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).count() == 0  # one distinct vector
    flat = vectors(spark, [(i, [i / 64, 0.25, -i / 64]) for i in range(9)]).withColumn("x", F.lit("no")).withColumn("n", F.lit(1))
    rows = whitening.whiten(flat).collect()
    assert {r.component for r in rows} == {1} and all(abs(r.explained - 1) < 1e-12 for r in rows)
    with pytest.raises(ValueError, match="entries"):
        whitening.whiten(vectors(spark, [(1, [0.5]), (2, [0.5, 1.0])]))
