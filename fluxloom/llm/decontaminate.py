"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The automaton is built over word numbers of all items, one word sequence after the other. Training words are streamed
through it; the length of the longest match ending at each word is tracked, and where it reaches the window length the
window's words are hit. Items shorter than a window are one window each.

The automaton is shipped to the tasks. Its size is bounded by `block_words`: the items are read in blocks of at most so
many words (an item with more is cut into overlapping pieces, which have the same windows), each block has an automaton
of its own, and every block is run against all documents.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import id_text

WINDOW = 10
BLOCK_WORDS = 100_000
_KEEP = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal_words(text: str | None) -> list[bytes]:
    """Words of digits, letters and non-ASCII characters, A-Z in lower case; NULL has none."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


@dataclass
class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window."""

    window: int
    numbers: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    items: dict[int, dict[int, set]] = field(default_factory=dict)  # state -> window length -> items
    shortest: int = WINDOW
    pairs: np.ndarray | None = None

    def _extend(self, last: int, c: int) -> int:
        step, link, size = self.step, self.link, self.size

        def clone(p: int, q: int) -> int:
            new = len(step)
            step.append(dict(step[q]))
            link.append(link[q])
            size.append(size[p] + 1)
            link[q] = new
            while p >= 0 and step[p].get(c) == q:
                step[p][c] = new
                p = link[p]
            return new

        if (q := step[last].get(c)) is not None:
            return q if size[q] == size[last] + 1 else clone(last, q)
        cur, p = len(step), last
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[cur] = q if size[q] == size[p] + 1 else clone(p, q)
        return cur

    @classmethod
    def of(cls, items: list[tuple], window: int = WINDOW) -> "Automaton":
        """From (item, words) pairs; an item of no words has no window."""
        self = cls(window)
        coded = []
        for item, ws in items:
            if ws:
                coded.append((item, [self.numbers.setdefault(w, len(self.numbers) + 1) for w in ws]))
        pairs = set()
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
            pairs.update(zip(ids, ids[1:]))
        for item, ids in coded:  # a second walk, when no state is split any more
            n = min(window, len(ids))
            self.shortest = min(self.shortest, n)
            state = length = 0
            for c in ids:
                state, length = self.walk(state, length, c)
                if length >= n:
                    s = state
                    while self.size[self.link[s]] >= n:
                        s = self.link[s]
                    self.items.setdefault(s, {}).setdefault(n, set()).add(item)
        base = len(self.numbers) + 1
        self.pairs = np.array(sorted(a * base + b for a, b in pairs), dtype=np.int64)
        return self

    def walk(self, state: int, length: int, c: int) -> tuple[int, int]:
        """The state and the length of the longest match after one more word."""
        step = self.step
        while state and c not in step[state]:
            state = self.link[state]
            length = self.size[state]
        nxt = step[state].get(c)
        return (0, 0) if nxt is None else (nxt, length + 1)

    def scan(self, ws: list[bytes]) -> tuple[np.ndarray | None, set]:
        """Mask of hit words (None: no hit) and the items with an occurring window.

        Only runs of words whose neighbouring pairs occur in items can hold a match of two words or more; the others
        are passed over without walking, which changes no result.
        """
        ids = np.array(list(map(self.numbers.get, ws, repeat(0))), dtype=np.int64)
        known = ids > 0
        if not known.any():
            return None, set()
        joined = np.zeros(len(ids), dtype=bool)  # word i and i + 1 are a pair of an item
        if len(ids) > 1:
            at = np.flatnonzero(known[:-1] & known[1:])
            if len(at) and len(self.pairs):
                code = ids[at] * (len(self.numbers) + 1) + ids[at + 1]
                place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
                joined[at[self.pairs[place] == code]] = True
        starts = np.flatnonzero(known & ~np.concatenate(([False], joined[:-1])))
        ends = np.flatnonzero(known & ~joined) + 1
        long_enough = ends - starts >= self.shortest
        hit, found = None, set()
        for a, b in zip(starts[long_enough].tolist(), ends[long_enough].tolist()):
            state = length = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                state, length = self.walk(state, length, c)
                if length < self.shortest:
                    continue
                s = state
                while s > 0:
                    for n, of in self.items.get(s, {}).items():
                        if n <= length:
                            hit = np.zeros(len(ids), dtype=bool) if hit is None else hit
                            hit[i + 1 - n:i + 1] = True
                            found |= of
                    s = self.link[s]
        return hit, found


def _item_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int):
    """Lists of (item, words), each of at most *block_words* words; one block is on the driver at a time."""
    block, held = [], 0
    for row in items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        ws = normal_words(row.t)
        for at in range(0, max(1, len(ws) - window + 1), block_words):
            piece = ws[at:at + block_words + window - 1]
            if held and held + len(piece) > block_words:
                yield block
                block, held = [], 0
            block.append((row.i, piece))
            held += len(piece)
    yield block


def matched_spans(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS,
                  keep_text: bool = False, max_coverage: float = 1.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted as strings), cleaned (only with *keep_text*).

    A word inside an occurrence of a window is hit. `cleaned` is the text without the spans of adjoining hit words
    (from the first character of the first to the last of the last); it is NULL where more than *max_coverage* of the
    words are hit, and the text itself where none is. Documents without words have zeros and no items; an item
    without id hits but is not listed; columns named in *carry* come back in a struct `carried`; repeated items count once, repeated documents are each scored.
    """
    rows = id_text(docs, id_col, text_col, carry).withColumns({
        "hit": F.lit(None).cast("binary"), "items": F.array().cast("array<string>")})
    spark, blocks = rows.sparkSession, _item_blocks(items, item_id, item_text, window, block_words)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        shipped = spark.sparkContext.broadcast(Automaton.of(block, window))
        if following is None:
            return _scan(rows, shipped, ("n_words", "n_hit", "items") + ("cleaned",) * keep_text, max_coverage)
        # the next block starts from a table, so that a task holds one automaton at a time
        rows = cut_lineage(_scan(rows, shipped, ("text", "hit", "items"), max_coverage), "decontaminate")
        block = following


_KINDS = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_hit": pa.int64(), "hit": pa.binary(), "items": pa.list_(pa.string()),
          "text": pa.string(), "cleaned": pa.string()}
_DDL = {"doc_id": "long", "n_words": "long", "n_hit": "long", "hit": "binary", "items": "array<string>", "text": "string", "cleaned": "string"}


def _scan(rows: DataFrame, shipped, wanted: tuple[str, ...], max_coverage: float) -> DataFrame:
    """One block's automaton over all rows; hits and items are added to those of earlier blocks."""
    also = [c for c in rows.columns if c == "carried"]

    def run(batches):
        auto = shipped.value
        for batch in batches:
            col = {name: batch.column(name).to_pylist() for name in ("doc_id", "text", "hit", "items")}
            out = {name: [] for name in wanted}
            for text, before, items in zip(col["text"], col["hit"], col["items"]):
                ws = normal_words(text)
                mask, found = auto.scan(ws) if auto.numbers and ws else (None, set())
                if before is not None:
                    bits = np.unpackbits(np.frombuffer(before, np.uint8), count=len(ws)).astype(bool)
                    mask = bits if mask is None else mask | bits
                n_hit = 0 if mask is None else int(mask.sum())
                row = {"n_words": len(ws), "n_hit": n_hit, "text": text, "hit": None if mask is None else np.packbits(mask).tobytes(),
                       "items": sorted({*items, *(i for i in found if i is not None)})}
                if "cleaned" in wanted:
                    row["cleaned"] = text if mask is None else None if n_hit > max_coverage * len(ws) else cut_spans(text, mask)
                for name in wanted:
                    out[name].append(row[name])
            yield pa.RecordBatch.from_pydict({k: pa.array(v, type=_KINDS[k]) for k, v in {"doc_id": col["doc_id"], **out}.items()}
                                             | {c: batch.column(c) for c in also})

    schema = ", ".join(f"{k} {_DDL[k]}" for k in ("doc_id", *wanted)) + "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in also)
    return rows.select("doc_id", "text", "hit", "items", *also).mapInArrow(run, schema)


def cut_spans(text: str, hit: np.ndarray) -> str:
    """The text without the characters from the first to the last word of each run of hit words."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    out, last = [], 0
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        out.append(raw[last:at[a][0]])
        last = at[b - 1][1]
    out.append(raw[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def items_digest(items: list[str]) -> str:
    """Lower-case hex SHA-256 of the comma-joined items."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
