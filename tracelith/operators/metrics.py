"""Detection metrics: confusion, buckets, shards, histograms, percentiles, audits, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles

QUANTILES = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]


def confusion(df: DataFrame, keys: list[str], gold: str, pred: str) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall and f1 (0 where undefined) by keys; one row without keys."""
    one = lambda g, p: F.sum(F.when((F.col(gold) == g) & (F.col(pred) == p), 1).otherwise(0)).cast("long")
    c = df.groupBy(*keys).agg(one(1, 1).alias("tp"), one(0, 1).alias("fp"), one(1, 0).alias("fn"), one(0, 0).alias("tn"))
    return with_ratios(c)


def with_ratios(counts: DataFrame) -> DataFrame:
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.coalesce(F.col(x), F.lit(0)) for x in ("tp", "fp", "fn", "tn"))
    return counts.withColumns(
        {"accuracy": div(tp + tn, tp + fp + fn + tn), "precision": div(tp, tp + fp), "recall": div(tp, tp + fn), "f1": div(2 * tp, 2 * tp + fp + fn)}
    )


def bucketed(df: DataFrame, buckets: dict[str, Column], gold: str, pred: str) -> DataFrame:
    """confusion() of every (key, bucket): one pass, rows unpivoted by key before a single aggregation."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), b.cast("string").alias("bucket")) for k, b in buckets.items())))
    return confusion(df.select(gold, pred, pairs.alias("b")).select(gold, pred, "b.*"), ["key", "bucket"], gold, pred)


def histogram(df: DataFrame, key: Column, name: str = "bucket") -> DataFrame:
    h = df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    return h.join(F.broadcast(h.agg(F.sum("n").alias("total")))).select(name, "n", (F.col("n") / F.col("total")).alias("share"))


def audit(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """By feature and part (all, and each label): n, null rate, moments, quantiles, and rates among the non-null values of 0, 1 and low ones."""
    long = df.select(F.explode(F.array(F.lit("all"), F.concat(F.lit("label="), F.col(label).cast("string")))).alias("part"), *features)
    long = long.unpivot(["part"], features, "feature", "value").withColumn("value", F.col("value").cast("double"))
    v = F.col("value")
    rate = lambda cond: F.avg(cond.cast("double"))
    out = long.groupBy("feature", "part").agg(
        F.count(F.lit(1)).alias("n"), F.avg(v.isNull().cast("double")).alias("null_rate"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        rate(v == 1).alias("eq1_rate"), rate(v == 0).alias("eq0_rate"), *(rate(v <= x).alias(f"le_{str(x).replace('.', 'p')}_rate") for x in (0.95, 0.9, 0.8, 0.5)),
    )
    q = exact_quantiles(long, ["feature", "part"], "value", {f"q{round(100 * q):02d}": q for q in QUANTILES}).drop("n")
    return out.join(q, ["feature", "part"], "left")


def recommend(audited: DataFrame, zero: str = "label=0", one: str = "label=1") -> DataFrame:
    """feature and recommendation, by rules over the audit of all rows and of the two labels."""
    side = lambda part, mark: audited.where(F.col("part") == part).select("feature", *(F.col(c).alias(f"{mark}_{c}") for c in ("null_rate", "mean", "eq1_rate", "le_0p9_rate", "le_0p8_rate")))
    j = side("all", "g").join(side(zero, "a"), "feature", "left").join(side(one, "b"), "feature", "left")
    gap = lambda c: F.abs(F.coalesce(f"b_{c}", F.lit(0.0)) - F.coalesce(f"a_{c}", F.lit(0.0)))
    rule = (
        F.when(F.col("g_null_rate") == 1, "drop_candidate_all_null")
        .when(F.col("g_null_rate") >= 0.95, "drop_candidate_extremely_sparse")
        .when((F.col("g_eq1_rate") >= 0.98) & (gap("le_0p9_rate") < 0.01), "drop_candidate_near_constant_1")
        .when((gap("le_0p8_rate") >= 0.03) | (gap("le_0p9_rate") >= 0.05), "keep_candidate_tail_separation")
        .when(gap("mean") >= 0.02, "keep_candidate_mean_gap")
        .otherwise("review_candidate_weak_signal")
    )
    return j.select("feature", rule.alias("recommendation"))


def micro_counts(df: DataFrame, keys: list[str], candidates: str, gold: str, pred: str) -> DataFrame:
    """confusion() over the distinct visible candidates of each row: gold and pred are id arrays, ids outside the candidates don't count."""
    one = df.select(*keys, F.explode(F.array_distinct(candidates)).alias("_c"), gold, pred)
    one = one.select(*keys, F.array_contains(gold, F.col("_c")).cast("int").alias("_g"), F.array_contains(pred, F.col("_c")).cast("int").alias("_p"))
    return confusion(one, keys, "_g", "_p")


def throughput(df: DataFrame, wall: str, n: str) -> DataFrame:
    """ms_per_sample and samples_per_s of wall seconds and counts; null where undefined."""
    return df.withColumns({"ms_per_sample": F.try_divide(1000.0 * F.col(wall), F.col(n)), "samples_per_s": F.try_divide(F.col(n), F.col(wall))})


def lengths(df: DataFrame, keys: list[str], length: str, budgets: list[int], qs: dict[str, float]) -> DataFrame:
    """n, mean, longest, exact quantiles, and share and count of rows over each budget, by keys."""
    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(length).alias("mean"), F.max(length).alias("longest"), *(F.avg((F.col(length) > b).cast("double")).alias(f"over_{b}") for b in budgets),
        *(F.sum(F.least(F.col(length), F.lit(b))).alias(f"kept_at_{b}") for b in budgets),
    )
    return out.join(exact_quantiles(df, keys, length, qs).drop("n"), keys, "left")


def grid(attacks: list[str], seeds: list[int], models: list[str], first: DataFrame, second: DataFrame, value: str) -> DataFrame:
    """Every attack, seed and model of the grid with `value` of first, else of second; its source says which."""
    spark = first.sparkSession
    cells = spark.createDataFrame([(a, s, m) for a in attacks for s in seeds for m in models], "attack string, seed long, model string")
    keys = ["attack", "seed", "model"]
    out = cells.join(first.select(*keys, F.col(value).alias("_a")), keys, "left").join(second.select(*keys, F.col(value).alias("_b")), keys, "left")
    return out.select(*keys, F.coalesce("_a", "_b").alias(value), F.when(F.col("_a").isNotNull(), "first").when(F.col("_b").isNotNull(), "second").alias("source"))


def coverage(df: DataFrame, shard: str, n_shards: int) -> DataFrame:
    """Shards seen, missing ones, and whether all of 0..n_shards-1 are there."""
    seen = df.agg(F.array_sort(F.collect_set(F.col(shard).cast("long"))).alias("seen"))
    missing = F.array_except(F.sequence(F.lit(0), F.lit(n_shards - 1)).cast("array<bigint>"), F.col("seen"))
    return seen.select(F.size("seen").cast("long").alias("n_seen"), F.size(missing).cast("long").alias("n_missing"), (F.size(missing) == 0).alias("complete"))


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], ints: list[str], floats: list[str], tol: float = 1e-12) -> DataFrame:
    """Per key, how far the totals of a and b are apart, and whether they agree (ints exactly, floats within tol)."""
    x = a.select(*keys, *(F.col(c).alias(f"a_{c}") for c in ints + floats))
    y = b.select(*keys, *(F.col(c).alias(f"b_{c}") for c in ints + floats))
    ok = F.lit(True)
    for c in ints:
        ok = ok & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    for c in floats:
        ok = ok & F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= tol, F.lit(False))
    return x.join(y, keys, "full").withColumn("agrees", ok)
