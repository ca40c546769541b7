"""Exact quantiles and ranks without gathering a group in one task.

Approximate cut points, a mergeable sketch, deal a group's values to RANGES ranges; counts by value within
a range say which ranges hold the ranks asked for, and only those are put in order, each in a task of its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """keys, n and for each name of ranks the value at that 0-based rank (an expression of n) among the key's non-null values.

    keys are of few groups: a row of RANGES cut points for each is sent to all tasks by the planner's choice.
    """
    keys = list(keys)
    own = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    cuts = F.percentile_approx("_v", F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), 10_000)
    groups = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), cuts.alias("_cuts"))
    join = lambda a, b: a.join(b, keys) if keys else a.join(F.broadcast(b))  # noqa: E731  without keys: one row
    dealt = join(own, groups.select(*keys, "_cuts")).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_v"))))
    counts = dealt.groupBy(*keys, "_range", "_v").agg(F.count(F.lit(1)).alias("_c"))
    sizes = counts.groupBy(*keys, "_range").agg(F.sum("_c").alias("_size"))
    order = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    before = sizes.withColumn("_before", F.sum("_size").over(order) - F.col("_size"))  # RANGES rows a key
    wanted = join(before, groups.select(*keys, "n"))
    asked = F.array(*(F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, r in ranks.items()))
    inside = F.filter(asked, lambda a: (a["rank"] >= F.col("_before")) & (a["rank"] < F.col("_before") + F.col("_size")))
    wanted = wanted.withColumn("_asked", inside).where(F.size("_asked") > 0).drop("_size")
    held = counts.join(wanted, [*keys, "_range"])
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    held = held.withColumn("_to", upto).withColumn("_a", F.explode("_asked")).where((F.col("_a.rank") < F.col("_to")) & (F.col("_a.rank") >= F.col("_to") - F.col("_c")))
    return held.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("_a.name") == name, F.col("_v"))).alias(name) for name in ranks))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float]) -> DataFrame:
    """keys, n and linearly interpolated quantiles; keys without values are absent."""
    n = F.col("n") - 1
    got = at_ranks(df, keys, value, {f"{name}_{e}": f(F.lit(float(q)) * n) for name, q in qs.items() for e, f in (("lo", F.floor), ("hi", F.ceil))})
    part = lambda q: F.lit(float(q)) * n - F.floor(F.lit(float(q)) * n)
    return got.select(*keys, "n", *((F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * part(q)).alias(name) for name, q in qs.items()))
