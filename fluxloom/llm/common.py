"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Words of most contracts: runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The key and the text only, so that further columns of any name cannot clash; *carry* columns go into one struct."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *([F.struct(*carry).alias("carried")] if carry else []))


def map_texts(rows: DataFrame, schema: str, work: Callable[[list, list], dict]) -> DataFrame:
    """Arrow batches of (doc_id, text) through *work*, which returns output columns by name.

    A failed task is simply run again: *work* keeps no state that changes results.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                yield pa.RecordBatch.from_pydict(out)

    return rows.select("doc_id", "text").mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 on unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + _MIX[0]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


def once(rows: DataFrame, *cols) -> DataFrame:
    """A projection that later filters and projections do not repeat: it goes through a generator of one row."""
    return rows.select(F.inline(F.array(F.struct(*cols))))


def words(text: Column) -> Column:
    """Array of the words of a text; NULL and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP, -1), lambda w: w != "")


class SpanIndex:
    """Spans (start, end) of one text, asked by bisection: a text with many spans takes no comparison of all with all."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.ends = sorted(b for _, b in spans)
        self.furthest = list(accumulate((b for _, b in spans), max))
        self.same = Counter(spans)

    def _reach(self, before: int) -> int:
        """The furthest end of the first *before* spans."""
        return self.furthest[before - 1] if before else -1

    def covers(self, start: int, end: int) -> bool:
        """Whether one span holds all of start:end."""
        return self._reach(bisect_right(self.starts, start)) >= end

    def overlaps(self, start: int, end: int) -> bool:
        """Whether a span shares a place with start:end."""
        return self._reach(bisect_left(self.starts, end)) > start

    def near(self, start: int, end: int, distance: int) -> bool:
        """Whether another span starts within *distance* of *end* or ends within it of *start*; spans equal to this one do not count."""
        own = self.same[start, end]
        begun = bisect_right(self.starts, end + distance) - bisect_left(self.starts, end - distance)
        ended = bisect_right(self.ends, start + distance) - bisect_left(self.ends, start - distance)
        itself = own if end - start <= distance else 0
        return begun > itself or ended > itself
