"""Token counts: the tokenizer runs inside Arrow functions that return lengths only.

Texts are split at safe boundaries: a single space between two non-space characters. The pre-tokenizer of a byte-level
BPE puts that space at the start of a new piece, whatever stands around it, so the counts of the pieces add up to the
count of the text. Pieces repeat, so each task encodes a piece once and remembers its length; what is not known yet is
encoded in batches of about equal bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text

#: Bytes of one call of the tokenizer, and lengths that a task remembers before it starts afresh (neither changes a count).
BATCH_BYTES, REMEMBERED = 256 * 1024, 1_500_000
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_STOPS = (".", ",")
_OTHER_SPACES = [chr(c) for c in range(0x20) if chr(c).isspace()]
_WIDE_SPACES = [chr(c) for c in range(0x80, 0x3001) if chr(c).isspace()]


def split_safely(text: str) -> list[str]:
    """Pieces without the spaces that part them; every piece but the first begins with one."""
    if "  " in text or text[0] == " " or text[-1] == " ":
        return _SAFE.split(text)
    for c in _OTHER_SPACES if text.isascii() else _OTHER_SPACES + _WIDE_SPACES:
        if c in text and (c + " " in text or " " + c in text):  # a space beside other white space is no boundary
            return _SAFE.split(text)
    return text.split(" ")


def byte_batches(pieces: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """The pieces in batches of at most *limit* bytes; a longer piece is a batch of its own."""
    batch, held = [], 0
    for piece in pieces:
        n = len(piece.encode("utf-8", "surrogatepass"))
        if batch and held + n > limit:
            yield batch
            batch, held = [], 0
        batch.append(piece)
        held += n
    if batch:
        yield batch


class PieceLengths:
    """Token counts of pieces, remembered between batches of a task."""

    def __init__(self, tokenizer_file: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered = Tokenizer.from_file(tokenizer_file), remembered
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.first: dict[str, int] = {}
        self.rest: dict[str, int] = {}

    def _learn(self, known: dict[str, int], pieces: set[str], lead: str) -> None:
        """A full stop or comma after a Latin letter, at the end of a piece, is a piece (and a token) of its own."""
        new = pieces - known.keys()
        ended = [p for p in new if p[-1:] in _STOPS and "A" <= p[-2:-1] <= "\u024f" and p[-2].isalpha()]
        new.difference_update(ended)
        new.update(p for p in map(itemgetter(slice(-1)), ended) if p not in known)
        for batch in byte_batches([lead + p for p in new]):
            for piece, got in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)):
                known[piece[len(lead):]] = len(got)
        known.update((p, known[p[:-1]] + 1) for p in ended)

    def counts(self, texts: list[str | None]) -> list[int]:
        if len(self.first) + len(self.rest) > self.remembered:
            self.first, self.rest = {}, {}
        split = [split_safely(t) if t else [] for t in texts]
        self._learn(self.first, {s[0] for s in split if s}, "")
        self._learn(self.rest, {p for s in split for p in s[1:]}, " ")
        first, rest = self.first, self.rest
        return [first[s[0]] + sum(map(rest.__getitem__, s[1:])) if s else 0 for s in split]


def token_counts(docs: DataFrame, tokenizer_file: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > *limit*) per row.

    *tokenizer_file* is a byte-level BPE of the tokenizers library and must exist on every executor. Counts are without
    begin, end or added special tokens; special strings inside a text count as the library reads them by default; nothing
    is cut or padded. A NULL text counts as empty: no bytes and no tokens. Repeated rows are each counted.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        lengths = PieceLengths(tokenizer_file)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = []
            for at in range(0, len(texts), 512):
                n += lengths.counts(texts[at:at + 512])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_bytes": pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64()),
                "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n], pa.bool_())})

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
