"""Language-model scores by context-tree weighting over bytes.

A text is its UTF-8 bytes and an end mark (0xFF, which UTF-8 never has); before it stand `depth` such marks. Each byte is
eight binary decisions, and each decision has a context tree over the preceding bytes. Every node of a tree holds a
Krichevsky-Trofimov estimate, and estimates of all depths are mixed with the weights that the training texts give:
P_w = (P_kt + product of the children's P_w) / 2, and P_kt itself at the largest depth.

P_kt depends on counts only, so training is counting (depth + 1)-grams of bytes: one groupBy, then one per level upwards
for the weights and one join per level downwards for the predictions. A gram that no training text has takes part with a
count of 0, so that its mixed prediction is in the same table.

Scores are read per block of documents (a hash of the row, about `block_bytes` of text each): each block asks for its
distinct grams and words, gets their values by a join, and meets its texts again in a co-group. The model is never
collected or broadcast.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from .common import id_text

DEPTH, BLOCK_BYTES, FOLDS, HELD_OUT = 3, 8 << 20, 7, 2
_END = 0xFF
_LN2, _LNPI = math.log(2), math.log(math.pi)


def byte_grams(texts: list[bytes], depth: int) -> np.ndarray:
    """All (depth + 1)-grams of the texts with their end marks; the latest byte is the lowest."""
    pad = bytes([_END]) * depth
    a = np.frombuffer(pad + (bytes([_END]) + pad).join(texts) + bytes([_END]), np.uint8).astype(np.int64)
    g = a[depth:].copy()
    for k in range(1, depth + 1):
        g |= a[depth - k:len(a) - k] << (8 * k)
    # positions of the padding between texts predict nothing
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes + depth) - depth
    keep = np.ones(len(g), dtype=bool)
    for k in range(depth):
        keep[ends[:-1] + k] = False
    return g[keep]


def _ln_gamma(x: Column) -> Column:
    """Stirling's series eight steps further up."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    shift = x
    for k in range(1, 8):
        shift = shift * (x + k)
    return series - F.log(shift)


def _ln_kt(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.when(a + b == 0, F.lit(0.0)).otherwise(_ln_gamma(a + 0.5) + _ln_gamma(b + 0.5) - _ln_gamma(a + b + 1) - _LNPI)


def gram_scores(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(gram, log10p) for distinct (gram, n), n being the count in training."""
    bits = F.explode(F.array(*[
        F.struct(F.expr(f"{1 << k} | shiftright(gram & 255, {8 - k})").alias("node"), F.expr(f"shiftright(gram & 255, {7 - k}) & 1").alias("bit"))
        for k in range(8)]))
    split = grams.select("gram", "n", bits.alias("s")).select("gram", F.shiftright("gram", 8).alias("ctx"), "s.node", "s.bit", "n")
    level = split.groupBy("ctx", "node").agg(F.sum(F.expr("n * (1 - bit)")).alias("a"), F.sum(F.expr("n * bit")).alias("b"))
    level = level.withColumn("pw", _ln_kt(F.col("a"), F.col("b")))
    levels = {depth: cut_lineage(level, "ctw")}
    for d in range(depth - 1, -1, -1):
        up = levels[d + 1].groupBy(F.col("ctx").bitwiseAND((1 << 8 * d) - 1).alias("ctx"), "node").agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("pw").alias("below"))
        up = up.withColumn("kt", _ln_kt(F.col("a"), F.col("b")))
        high, low = F.greatest("kt", "below"), F.least("kt", "below")
        levels[d] = cut_lineage(up.withColumn("pw", high + F.log1p(F.exp(low - high)) - _LN2), "ctw")
    # downwards: what is mixed so far for a 1 and for a 0, and the weight left for deeper levels
    kt1 = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    stop = F.exp(F.col("kt") - _LN2 - F.col("pw"))
    one, zero = stop * kt1, stop * (1 - kt1)
    path = levels[0].select("ctx", "node", one.alias("one"), zero.alias("zero"), (1 - stop).alias("rest")) if depth else None
    for d in range(1, depth):
        up = path.withColumnsRenamed({"ctx": "up", "one": "one0", "zero": "zero0", "rest": "rest0"})
        here = levels[d].withColumn("up", F.col("ctx").bitwiseAND((1 << 8 * (d - 1)) - 1))
        path = here.join(up, ["up", "node"]).select(
            "ctx", "node", (F.col("one0") + F.col("rest0") * one).alias("one"), (F.col("zero0") + F.col("rest0") * zero).alias("zero"),
            (F.col("rest0") * (1 - stop)).alias("rest"))
    leaf = levels[depth]
    if depth:
        up = path.withColumnsRenamed({"ctx": "up"})
        leaf = leaf.withColumn("up", F.col("ctx").bitwiseAND((1 << 8 * (depth - 1)) - 1)).join(up, ["up", "node"])
        leaf = leaf.select("ctx", "node", (F.col("one") + F.col("rest") * kt1).alias("one"), (F.col("zero") + F.col("rest") * (1 - kt1)).alias("zero"))
    else:
        leaf = leaf.select("ctx", "node", kt1.alias("one"), (1 - kt1).alias("zero"))
    p = F.when(F.col("bit") == 1, F.col("one")).otherwise(F.col("zero"))
    return split.join(leaf, ["ctx", "node"]).groupBy("gram").agg(F.sum(F.log10(p)).alias("log10p"))


def _tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def _utf8(column: pa.ChunkedArray) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def corpus_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte per row.

    Texts with crc32(doc_id as text) mod 7 = 2 are held out; the others train both models. base_score: log10 probability
    under add-one unigrams of lower-case words (A-Z only) and one end token. score: log10 probability under the weighted
    context trees; bits_per_byte is its code length per byte, the end mark included. A NULL text is empty: one token, one
    end mark. A row with a NULL id trains. Repeated rows count as often as they stand. An empty table gives no rows.
    """
    rows = id_text(docs, id_col, text_col)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    rows = rows.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False)).alias("held"),
                       F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).alias("block"))

    def ask(part: pa.Table) -> pa.Table:
        """A block's distinct grams and words with their training counts (0: only in held-out texts)."""
        texts, held = _utf8(part["text"]), part["held"].to_pylist()
        counts: dict[bytes, int] = {b"": 0}
        grams, known = [], []
        for train in (True, False):
            own = [t for t, h in zip(texts, held) if h != train]
            for at in range(0, len(own), 2000):
                g, n = np.unique(byte_grams(own[at:at + 2000], depth), return_counts=True)
                grams.append(g)
                known.append(n * train)
                for t in own[at:at + 2000]:
                    for w in _tokens(t):
                        counts[w] = counts.get(w, 0) + train
            counts[b""] += len(own) * train
        g, at = np.unique(np.concatenate(grams), return_inverse=True) if grams else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        n = np.bincount(at, weights=np.concatenate(known), minlength=len(g)).astype(np.int64) if grams else g
        block, m = part["block"][0].as_py(), len(g) + len(counts)
        return pa.table({"block": pa.array([block] * m, pa.int64()),
                         "gram": pa.concat_arrays([pa.array(g, pa.int64()), pa.nulls(len(counts), pa.int64())]),
                         "word": pa.concat_arrays([pa.nulls(len(g), pa.binary()), pa.array(list(counts), pa.binary())]),
                         "n": pa.concat_arrays([pa.array(n, pa.int64()), pa.array(list(counts.values()), pa.int64())])})

    asked = cut_lineage(rows.groupBy("block").applyInArrow(ask, "block long, gram long, word binary, n long"), "ctw-asked")
    grams, words = asked.filter("gram IS NOT NULL").select("block", "gram", "n"), asked.filter("word IS NOT NULL").select("block", "word", "n")
    scores = cut_lineage(gram_scores(grams.groupBy("gram").agg(F.sum("n").alias("n")), depth), "ctw-scores")
    counts = cut_lineage(words.groupBy("word").agg(F.sum("n").alias("c")), "ctw-words")
    total, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    told = grams.join(scores, "gram").select("block", "gram", F.lit(None).cast("binary").alias("word"), F.col("log10p").alias("value")).unionByName(
        words.join(counts, "word").select("block", F.lit(None).cast("long").alias("gram"), "word", F.col("c").cast("double").alias("value")))

    def score(part: pa.Table, told: pa.Table) -> pa.Table:
        if not part.num_rows:
            return pa.table({k: pa.array([], t) for k, t in kinds_of.items()})
        is_gram = told["gram"].is_valid()
        mine = told.filter(is_gram)
        g, p = mine["gram"].to_numpy(), mine["value"].to_numpy()
        order = np.argsort(g)
        g, p = g[order], p[order]
        mine = told.filter(told["word"].is_valid())
        c = dict(zip(mine["word"].to_pylist(), mine["value"].to_numpy().tolist()))
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score", "bits_per_byte")}
        texts = _utf8(part["text"])
        for at in range(0, len(texts), 500):
            some = texts[at:at + 500]
            each = p[np.searchsorted(g, byte_grams(some, depth))]
            sums = np.add.reduceat(each, np.cumsum([0] + [len(t) + 1 for t in some[:-1]]))
            for text, s in zip(some, sums.tolist()):
                n = np.array([c[w] for w in _tokens(text)] + [c[b""]])
                out["n_tokens"].append(len(n))
                out["n_known"].append(int((n > 0).sum()))
                out["base_score"].append(math.fsum(np.log10((n + 1) / (total + kinds + 1))))
                out["score"].append(s)
                out["bits_per_byte"].append(-s / math.log10(2) / (len(text) + 1))
        return pa.table({"doc_id": part["doc_id"].combine_chunks(), "held_out": part["held"].combine_chunks(),
                         **{k: pa.array(v, kinds_of[k]) for k, v in out.items()}}).select(list(kinds_of))

    kinds_of = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(),
                "score": pa.float64(), "bits_per_byte": pa.float64()}
    got = rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return got.withColumn("train_tokens", F.lit(total).cast("long"))
