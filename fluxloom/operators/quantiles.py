"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def exact_quantiles(df: DataFrame, keys, x: str, probs: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Linearly interpolated quantiles of *x* per key.

    A mergeable sketch brackets each wanted rank to within some n / *accuracy* rows. In a second pass all values below a
    bracket and all above it are counted only, equal values inside it as one, before anything is shuffled. What is ranked
    per key is a bracket, a few rows in *accuracy*, so neither a large group nor a frequent value meets one task whole.
    """
    keys = list(keys)
    if not keys:
        return exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], x, probs, accuracy).drop("_all")
    values = df.filter(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"))
    ends = [min(max(p + side / accuracy, 0.0), 1.0) for p in probs.values() for side in (-3, 3)]
    edges = values.groupBy(*keys).agg(F.percentile_approx("_x", F.array(*[F.lit(e) for e in ends]), accuracy).alias("_edges"),
                                      F.count(F.lit(1)).alias("_n"))
    wanted = F.array(*[F.struct(F.lit(i).alias("p"), F.col("_edges")[2 * i].alias("lo"), F.col("_edges")[2 * i + 1].alias("hi")) for i in range(len(probs))])
    rows = values.join(edges, keys).select(*keys, "_n", "_x", F.explode(wanted).alias("_w"))
    side = F.when(F.col("_x") < F.col("_w.lo"), -1).when(F.col("_x") > F.col("_w.hi"), 1).otherwise(0)
    rows = rows.select(*keys, "_n", "_x", F.col("_w.p").alias("_p"), side.alias("_side"), F.when(side == 0, F.col("_x")).alias("_v"))
    # the sketch counts ranks from 1 of n, the interpolation from 0 of n - 1: a rank may lie one row outside its bracket
    counts = rows.groupBy(*keys, "_n", "_p", "_side", "_v").agg(F.count(F.lit(1)).alias("_k"), F.max("_x").alias("_most"), F.min("_x").alias("_least"))
    counts = counts.withColumn("_v", F.when(F.col("_side") < 0, F.col("_most")).otherwise(F.col("_least")))
    upto = W.partitionBy(*keys, "_p").orderBy("_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.withColumn("_c", F.sum("_k").over(upto))
    aggs, out = [], []
    for i, (name, p) in enumerate(probs.items()):
        rank = (F.col("_n") - 1) * p
        for end, r in (("f", F.floor(rank)), ("c", F.ceil(rank))):
            at = (F.col("_p") == i) & (F.col("_c") > r) & (F.col("_c") - F.col("_k") <= r)
            aggs.append(F.max(F.when(at, F.col("_v"))).alias(f"_{end}_{name}"))
        f, c = F.col(f"_f_{name}"), F.col(f"_c_{name}")
        out.append((f + (c - f) * (rank - F.floor(rank))).alias(name))
    return ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs).select(*keys, *out)


def median_exceeds(x: Column, limit: Column | float, over=None) -> Column:
    """Whether the median lies above *limit*, from counts and the two middle values.

    An aggregate, or a window expression with *over*. A column *limit* must be
    constant within the group.
    """
    agg = (lambda a: a) if over is None else (lambda a: a.over(over))
    above = agg(F.count(F.when(x > limit, x)))
    below = agg(F.count(F.when(x <= limit, x)))
    middle = (agg(F.max(F.when(x <= limit, x))) + agg(F.min(F.when(x > limit, x)))) / 2.0
    tie = middle > (limit if over is not None or not isinstance(limit, Column) else F.max(limit))
    return F.when(above > below, True).when(above < below, False).otherwise(F.coalesce(tie, F.lit(False)))
