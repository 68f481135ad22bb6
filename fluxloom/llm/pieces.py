"""SentencePiece segmentations sampled from the piece lattice, and lossless decoding.

The lattice of a text has a node between any two characters and an edge for each piece of the vocabulary; a path is a
segmentation and its weight the product of its pieces' weights. Forward filtering sums the weights of all paths to each
node; backward sampling then draws, from the end, each last piece in proportion. Pieces have white-space marks only at
their start, so every path passes through every word start: words (a run of marks with what follows) are filtered once
each and sampled apart.

Draws come from a counter: a 64-bit mix of the row key's hash, the word's place in the text and the step within the
word. A row's segmentation therefore depends on its key and text only, whatever batch or task it falls into.

A merge-ranked vocabulary has no log-probabilities, so a piece weighs (rank + 2) ** -alpha by its place in the vocabulary.
Characters without a piece become byte pieces; so does a literal mark U+2581, which keeps decoding lossless.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from .common import id_text, mix64

MARK = "▁"
ALPHA = 1.0
PART_CHARS = 2_000_000  # about so much text is sampled at once; no draw depends on it
_CHARS, _BYTES_WEIGHT = 0x110000, -14.0
_WORDS = re.compile(" +[^ ]*")


class PieceLattice:
    """The vocabulary as a trie, and sampling for many texts at once."""

    def __init__(self, model_file: str, alpha: float = ALPHA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.byte = np.zeros(256, dtype=np.int32)
        self.raw: list[bytes] = []
        plain = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or MARK in piece.lstrip(MARK):
                self.raw.append(b"")
            else:
                plain.append((sp.get_score(i), i, piece.replace(MARK, " ")))
                self.raw.append(plain[-1][2].encode())
        plain.sort(key=lambda x: (-x[0], x[1]))
        self.pieces = {piece: (i, -alpha * math.log(rank + 2.0)) for rank, (_, i, piece) in enumerate(plain)}
        states, moves, ends = {"": 0}, {}, {}
        for piece, (i, lw) in self.pieces.items():
            for k in range(len(piece)):
                to = states.setdefault(piece[:k + 1], len(states))
                moves[states[piece[:k]] * _CHARS + ord(piece[k])] = to
            ends[states[piece]] = (i, lw)
        self.moves = np.array(sorted(moves), np.int64)
        self.to = np.array([moves[m] for m in self.moves.tolist()], np.int32)
        self.ends = np.full(len(states), -1, np.int32)
        self.log_weight = np.zeros(len(states))
        for state, (i, lw) in ends.items():
            self.ends[state], self.log_weight[state] = i, lw

    def _edges(self, chars: np.ndarray, stop: np.ndarray) -> tuple:
        """(end, begin, piece, log weight) of all pieces found in the words, sorted by end; node k stands before character k
        of the words put together, and `stop` is the end of the character's word."""
        begin, state, found = np.arange(len(chars)), np.zeros(len(chars), np.int64), []
        k = 0
        while len(begin):
            key = state * _CHARS + chars[begin + k]
            at = np.minimum(np.searchsorted(self.moves, key), len(self.moves) - 1)
            ok = self.moves[at] == key
            begin, state = begin[ok], self.to[at[ok]].astype(np.int64)
            k += 1
            hit = self.ends[state] >= 0
            found.append((begin[hit] + k, begin[hit], self.ends[state[hit]], self.log_weight[state[hit]]))
            more = begin + k < stop[begin]
            begin, state = begin[more], state[more]
        end = np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)])
        bare = np.ones(len(chars) + 1, bool)
        bare[end] = False
        lone = np.flatnonzero(bare[1:]) + 1  # characters that no piece ends with
        cols = [np.concatenate([*[f[i] for f in found], x]) for i, x in enumerate(
            (lone, lone - 1, np.full(len(lone), -1, np.int32), np.full(len(lone), _BYTES_WEIGHT)))]
        order = np.argsort(cols[0], kind="stable")
        return tuple(c[order] for c in cols)

    def _filter(self, words: list[str]) -> tuple:
        """Forward filtering of all words side by side: nodes of the word ends and, per edge, cumulative place, begin, piece."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        stops = np.cumsum(size)
        # words share no node: word w has its nodes shifted by w
        word_of = np.repeat(np.arange(len(words)), size)
        end, begin, piece, lw = self._edges(chars, np.repeat(stops, size))
        place = end - (stops - size)[word_of[end - 1]]  # position within the word
        end, begin = end + word_of[end - 1], begin + word_of[begin]
        total = np.zeros(len(chars) + len(words))
        order = np.argsort(place, kind="stable")  # by position; ends stay together within it
        bounds = np.searchsorted(place[order], np.arange(1, int(size.max(initial=0)) + 2))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            e = order[lo:hi]
            x = total[begin[e]] + lw[e]
            first = np.flatnonzero(np.concatenate(([True], end[e][1:] != end[e][:-1])))
            top = np.maximum.reduceat(x, first)
            sums = np.add.reduceat(np.exp(x - np.repeat(top, np.diff(np.append(first, len(e))))), first)
            total[end[e][first]] = top + np.log(sums)
        p = np.exp(total[begin] + lw - total[end])
        run = np.cumsum(p)
        last = np.flatnonzero(np.concatenate((end[1:] != end[:-1], [True])))
        count = np.diff(np.concatenate(([-1], last)))
        run -= np.repeat(np.concatenate(([0.0], run[last[:-1]])), count)
        cum = end - 1 + np.minimum(run, 1.0)
        cum[last] = end[last]
        return stops + np.arange(len(words)), size, cum, begin, piece, chars, word_of

    def sample(self, keys: list[int], texts: list[str]) -> list[np.ndarray]:
        """Piece numbers of each text, drawn under its key."""
        words, counts = [], []
        for t in texts:
            w = split_words(t)
            words += w
            counts.append(len(w))
        if not words:
            return []
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        ends, size, cum, begin, piece, chars, word_of = self._filter(list(number))
        of = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        counts = np.array(counts)
        place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
        with np.errstate(over="ignore"):
            seed = mix64(np.repeat(np.array(keys, np.uint64), counts) + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        who = np.argsort(of, kind="stable")  # neighbours read the same part of the tables
        at, start, drawn, k = ends[of[who]], (ends - size)[of[who]], [], 0
        while len(who):
            with np.errstate(over="ignore"):
                u = (mix64(seed[who] + np.uint64(k)) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
            edge = np.searchsorted(cum, at - 1 + u, side="right")
            drawn.append((who, edge))
            at = begin[edge]
            more = at > start
            who, at, start = who[more], at[more], start[more]
            k += 1
        # steps run backwards within a word
        steps = np.zeros(len(words), np.int64)
        for w, _ in drawn:
            steps[w] += 1
        first = np.cumsum(steps) - steps
        taken = np.empty(int(steps.sum()), np.int64)
        for i, (w, e) in enumerate(drawn):
            taken[first[w] + steps[w] - 1 - i] = e
        ids, bounds = piece[taken].astype(np.int32), np.concatenate(([0], np.cumsum(np.add.reduceat(steps, np.cumsum(counts) - counts))))
        lone = np.flatnonzero(ids < 0)
        if len(lone):
            node = begin[taken[lone]]  # node k of the shifted numbering stands before character k less its word's number
            code = chars[node - np.repeat(of, steps)[lone]]
            raw = {c: chr(c).encode("utf-8", "surrogatepass") for c in set(code.tolist())}
            length = np.ones(len(ids), np.int64)
            length[lone] = [len(raw[c]) for c in code.tolist()]
            to = np.concatenate(([0], np.cumsum(length)))
            ids = np.repeat(ids, length)
            for p, c in zip(to[lone].tolist(), code.tolist()):
                ids[p:p + len(raw[c])] = self.byte[list(raw[c])]
            bounds = to[bounds]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text of any segmentation that `sample` gives."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def split_words(text: str) -> list[str]:
    """Runs of spaces with what follows them, of the text behind one more space. Here a mark is a plain space, so a
    literal mark in a text is a character like others (without a piece)."""
    return _WORDS.findall(" " + text) if "  " in text or text[:1] == " " else [" " + w for w in text.split(" ")]


def row_seed(key: int | None, seed: int) -> int:
    """64 bits of the row key and the seed."""
    return int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "little")


def text_parts(batch: pa.RecordBatch, most: int = PART_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about *most* bytes of text, a row at least."""
    size = np.cumsum(pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


def sampled_pieces(docs: DataFrame, model_file: str, alpha: float = ALPHA, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
                   check: bool = True) -> DataFrame:
    """doc_id, pieces array<int>, n_pieces, lossless (with *check*: decoding gives the text back) per row.

    *model_file* must exist on every executor. A NULL text has NULL pieces, no count and is lossless; an empty text is
    the lone mark. Equal rows get equal segmentations.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = PieceLattice(model_file, alpha)
        for batch in batches:
            for part in text_parts(batch):
                keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                got = lattice.sample([row_seed(k, seed) for k in keys], [t or "" for t in texts])
                offsets = np.concatenate(([0], np.cumsum([0 if t is None else len(g) for g, t in zip(got, texts)])))
                values = np.concatenate([g for g, t in zip(got, texts) if t is not None] or [np.zeros(0, np.int32)])
                none = pa.array([t is None for t in texts])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0), "pieces": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()), mask=none),
                    "n_pieces": pa.array([None if t is None else len(g) for g, t in zip(got, texts)], pa.int64()),
                    "lossless": pa.array([not check or t is None or lattice.decode(g.tolist()) == t for g, t in zip(got, texts)], pa.bool_())})

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, pieces array<int>, n_pieces long, lossless boolean")


def decoded_texts(pieces: DataFrame, model_file: str, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """doc_id and text of piece arrays; NULL pieces give a NULL text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = PieceLattice(model_file)
        for batch in batches:
            texts = [None if p is None else lattice.decode(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return pieces.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{pieces_col}` as array<int>) pieces").mapInArrow(run, "doc_id long, text string")
