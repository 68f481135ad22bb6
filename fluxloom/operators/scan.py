"""Ordered scans over long series in two levels.

A window function partitioned by the series key alone would pull a hot series
into one task. Every ordered operator here therefore works on *chunks* of the
order axis: the heavy window runs inside ``(key, chunk)``, each chunk is
reduced to one summary row, a window over the summaries yields what the chunk
inherits from its neighbours, and that row is joined back on ``(key, chunk)``.
The result does not depend on the chunk length; the length only bounds how
many rows one task sorts (sampling rate times chunk length).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

CHUNK = "_chunk"


def with_chunk(df: DataFrame, order: str, chunk: int) -> DataFrame:
    """Add the chunk number of the integer order column."""
    return df.withColumn(CHUNK, F.expr(f"({order} - pmod({order}, {int(chunk)}L)) div {int(chunk)}L"))


def _local(keys, order, ties=()):
    return W.partitionBy(*keys, CHUNK).orderBy(order, *ties)


def _local_reversed(keys, order, ties=()):
    return W.partitionBy(*keys, CHUNK).orderBy(*[F.col(c).desc() for c in (order, *ties)])


def _summary_window(keys):
    return W.partitionBy(*keys).orderBy(CHUNK)


def _join_back(df: DataFrame, summary: DataFrame, keys) -> DataFrame:
    return df.join(summary, [*keys, CHUNK], "left").drop(CHUNK)


def neighbours(df: DataFrame, keys, order: str, cols, chunk: int, ties=()) -> DataFrame:
    """Add ``prev_<c>`` and ``next_<c>``: the values one row before and after."""
    keys, ties = list(keys), list(ties)
    w = _local(keys, order, ties)
    marked = with_chunk(df, order, chunk)
    row = F.struct(order, *ties, *[c for c in cols if c not in (order, *ties)])
    at = F.struct(order, *ties)
    edge = marked.groupBy(*keys, CHUNK).agg(F.min_by(row, at).alias("_first"), F.max_by(row, at).alias("_last"))
    sw = _summary_window(keys)
    edge = edge.select(*keys, CHUNK, F.lag("_last").over(sw).alias("_before"),
                       F.lead("_first").over(sw).alias("_after"))
    local = marked
    for c in cols:
        local = local.withColumn(f"_l_{c}", F.lag(F.struct(c)).over(w)).withColumn(
            f"_n_{c}", F.lead(F.struct(c)).over(w))
    out = _join_back(local, edge, keys)
    for c in cols:
        out = (out.withColumn(f"prev_{c}", F.when(F.col(f"_l_{c}").isNotNull(), F.col(f"_l_{c}.{c}"))
                              .otherwise(F.col(f"_before.{c}")))
               .withColumn(f"next_{c}", F.when(F.col(f"_n_{c}").isNotNull(), F.col(f"_n_{c}.{c}"))
                           .otherwise(F.col(f"_after.{c}"))).drop(f"_l_{c}", f"_n_{c}"))
    return out.drop("_before", "_after")


def brackets(df: DataFrame, keys, order: str, cols, chunk: int, ties=()) -> DataFrame:
    """Add ``before_<c>`` and ``after_<c>``: struct (o, x) of the nearest valid sample.

    *before* looks at the row itself and earlier rows, *after* at the row
    itself and later rows, rows of equal order and *ties* on both sides; NULL
    where the series has no such sample. Both scans run forward, *after* over
    the reversed order: a frame that ends at the partition's last row is
    evaluated anew for every row.
    """
    keys, ties = list(keys), list(ties)
    back, ahead = (w.rangeBetween(W.unboundedPreceding, W.currentRow) for w in (_local(keys, order, ties), _local_reversed(keys, order, ties)))
    marked = with_chunk(df, order, chunk)
    pair = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).alias("x")))
            for c in cols}
    at = {c: F.when(F.col(c).isNotNull(), F.struct(order, *ties)) for c in cols}
    summary = marked.groupBy(*keys, CHUNK).agg(
        *[F.max_by(pair[c], at[c]).alias(f"_p_{c}") for c in cols],
        *[F.min_by(pair[c], at[c]).alias(f"_f_{c}") for c in cols])
    earlier, later = (w.rowsBetween(W.unboundedPreceding, -1) for w in (_summary_window(keys), W.partitionBy(*keys).orderBy(F.col(CHUNK).desc())))
    summary = summary.select(
        *keys, CHUNK,
        *[F.last(f"_p_{c}", ignorenulls=True).over(earlier).alias(f"_p_{c}") for c in cols],
        *[F.last(f"_f_{c}", ignorenulls=True).over(later).alias(f"_f_{c}") for c in cols])
    local = marked.select(
        "*", *[F.coalesce(pair[c], F.last(pair[c], ignorenulls=True).over(back)).alias(f"_b_{c}") for c in cols],
        *[F.coalesce(pair[c], F.last(pair[c], ignorenulls=True).over(ahead)).alias(f"_a_{c}") for c in cols])
    out = _join_back(local, summary, keys)
    return out.select(
        *df.columns,
        *[F.coalesce(f"_b_{c}", f"_p_{c}").alias(f"before_{c}") for c in cols],
        *[F.coalesce(f"_a_{c}", f"_f_{c}").alias(f"after_{c}") for c in cols])


def running(df: DataFrame, keys, order: str, aggs: dict[str, tuple[str, Column]], chunk: int,
            ties=()) -> DataFrame:
    """Running aggregates up to and including each row.

    *aggs* maps an output name to ``(kind, column)``, kind ``sum`` or ``max``.
    """
    keys = list(keys)
    w = _local(keys, order, ties).rowsBetween(W.unboundedPreceding, 0)
    marked = with_chunk(df, order, chunk)
    for name, (_, col) in aggs.items():
        marked = marked.withColumn(f"_v_{name}", col)
    fn = {"sum": F.sum, "max": F.max}
    summary = marked.groupBy(*keys, CHUNK).agg(
        *[fn[kind](f"_v_{name}").alias(f"_t_{name}") for name, (kind, _) in aggs.items()])
    sw = _summary_window(keys).rowsBetween(W.unboundedPreceding, -1)
    summary = summary.select(*keys, CHUNK, *[
        fn[kind](f"_t_{name}").over(sw).alias(f"_t_{name}") for name, (kind, _) in aggs.items()])
    local = marked.select(
        "*", *[fn[kind](f"_v_{name}").over(w).alias(f"_r_{name}") for name, (kind, _) in aggs.items()])
    out = _join_back(local, summary, keys)
    cols = []
    for name, (kind, _) in aggs.items():
        own, carried = F.col(f"_r_{name}"), F.col(f"_t_{name}")
        if kind == "sum":
            total = F.when(own.isNull() & carried.isNull(), None).otherwise(
                F.coalesce(own, F.lit(0)) + F.coalesce(carried, F.lit(0)))
        else:
            total = F.greatest(own, carried)
        cols.append(total.alias(name))
    return out.select(*df.columns, *cols)


def row_index(df: DataFrame, keys, order: str, chunk: int, name: str = "rn", ties=()) -> DataFrame:
    """1-based position of each row in its series."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, chunk, ties)
