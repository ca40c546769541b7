"""Splits and samples. Order comes from a keyed arithmetic hash, so results are the same on any layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Multiplicative hash that SQL engines share.
MULTIPLIER, MODULUS, FOLD = 2654435761, 4294967296, 2147483648


def order_hash(key: Column, seed: int = 0) -> Column:
    """Hash of an integer key, in 0..2 ** 32 - 1. Keys are folded to 31 bits first, so the product fits a long."""
    return (F.pmod(key + seed, F.lit(FOLD)) * F.lit(MULTIPLIER)) % F.lit(MODULUS)


def bottom_k(df: DataFrame, strata: list[str], key: str, k: Column | int, seed: int = 0) -> DataFrame:
    """The k rows of least hash in each stratum; k may be a column. The planner limits each partition first."""
    w = Window.partitionBy(*strata).orderBy(order_hash(F.col(key), seed), key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def time_split(df: DataFrame, windows: dict[str, list[tuple[float, float]]], time: str = "t") -> DataFrame:
    """split of the first window [start, end) that holds the time; rows in none go. Windows of different splits must not overlap."""
    spans = sorted((a, b, s) for s, ws in windows.items() for a, b in ws)
    for (a, b, s), (c, d, r) in zip(spans, spans[1:]):
        if c < b:
            raise ValueError(f"windows overlap: {s} [{a}, {b}) and {r} [{c}, {d})")
    out = F.lit(None).cast("string")
    for name in reversed(list(windows)):
        for a, b in windows[name]:
            out = F.when((F.col(time) >= a) & (F.col(time) < b), name).otherwise(out)
    return df.withColumn("split", out).where(F.col("split").isNotNull())


def fraction_sample(df: DataFrame, strata: list[str], key: str, fraction: float) -> DataFrame:
    """max(1, floor(n * fraction)) rows of each stratum by hash order."""
    sized = df.join(df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n")), strata)
    return bottom_k(sized, strata, key, F.greatest(F.lit(1), F.floor(F.col("_n") * fraction))).drop("_n")


def largest_remainder(sizes: DataFrame, strata: list[str], total: int) -> DataFrame:
    """Quota of each stratum of sizes (column n): floors, then one more by remainder until total is reached. Strata are few."""
    whole = sizes.agg(F.sum("n").alias("_all"))
    s = sizes.join(F.broadcast(whole)).withColumn("_exact", F.col("n") * F.lit(float(total)) / F.col("_all"))  # one row
    s = s.withColumn("_base", F.floor("_exact").cast("long"))
    s = s.join(F.broadcast(s.agg(F.sum("_base").alias("_given"))))
    rank = F.row_number().over(Window.orderBy(F.round(F.col("_exact") - F.col("_base"), 9).desc(), *strata))
    return s.select(*strata, "n", (F.col("_base") + F.when(rank <= total - F.col("_given"), 1).otherwise(0)).alias("quota"))


def shards(df: DataFrame, key: str, n: int) -> DataFrame:
    """Contiguous shards of ceil(rows / n) in hash order, by counts of hash ranges: no global sort in one task.

    Ranges of the hash are numbered locally and offset by the counts before them.
    """
    bits = 12
    h = order_hash(F.col(key))
    cut = df.withColumns({"_h": h, "_range": F.shiftrightunsigned(h, 32 - bits).cast("int")})
    counts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.sum("_c").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"))
    total = counts.agg(F.sum("_c").alias("_total"))
    at = cut.join(F.broadcast(before.join(F.broadcast(total))), "_range")  # 2 ** 12 rows at most
    rn = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("_h", key)) - 1
    return at.withColumn("shard", F.floor(rn / F.ceil(F.col("_total") / n)).cast("long")).drop("_h", "_range", "_before", "_c", "_total")


def proportional(sizes: dict[int, int], total: int) -> dict[int, int]:
    """Targets of two labels: half-even share of label 1 kept in 1..n1, what one label lacks goes to the other."""
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    n, want = n0 + n1, min(total, n0 + n1)
    if not want:
        return {0: 0, 1: 0}
    one = max(min(1, n1), min(n1, round(want * n1 / n)))
    zero = min(n0, want - one)
    return {0: zero, 1: min(n1, want - zero)}


def run_split(runs: DataFrame, config: list[str], run: str, train: int = 4) -> DataFrame:
    """split of each run: of every config the first `train` by hash order are train, the rest halves of val and test.

    Configs with fewer runs than that are train altogether.
    """
    h = order_hash(F.col(run))
    w = Window.partitionBy(*config)
    out = runs.withColumns({"_rn": F.row_number().over(w.orderBy(h, run)), "_n": F.count(F.lit(1)).over(w)})
    rest = F.col("_rn") - train
    split = F.when((F.col("_n") < train) | (rest <= 0), "train").when(2 * rest <= F.col("_n") - train, "val").otherwise("test")
    return out.withColumn("split", split).drop("_rn", "_n")


def fixed_sample(df: DataFrame, strata: list[str], key: str, total: int) -> DataFrame:
    """total rows in proportion to the strata (largest remainder), by hash order in each."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    quota = largest_remainder(sizes, strata, total).select(*strata, F.least("quota", "n").alias("_quota"))
    return bottom_k(df.join(F.broadcast(quota), strata), strata, key, F.col("_quota")).drop("_quota")  # a row a stratum


def key_sample(df: DataFrame, label: str, key: str, quota: dict[int, int], seed: int = 0) -> DataFrame:
    """Rows of the keys of least hash by label; all rows that share a picked key follow it, whatever their label."""
    want = F.coalesce(*(F.when(F.col(label) == y, F.lit(n)) for y, n in quota.items()), F.lit(0))
    keys = bottom_k(df.select(label, key).distinct(), [label], key, want, seed).select(key).distinct()
    return df.join(keys, key, "left_semi")


#: Runs of a pool that go to val by attacker type 1, 2, 4, 8 and 16, for val and for test.
VAL_QUOTA, TEST_QUOTA = {1: 4, 2: 5, 4: 4, 8: 5, 16: 4}, {1: 5, 2: 4, 4: 5, 8: 4, 16: 5}


def run_split_quota(runs: DataFrame, config: list[str], run: str, kind: str, train: int = 4) -> DataFrame:
    """split of each run: of every config the first `train` by hash order are train, the pool goes to val and test by the type's quota.

    Configs with fewer runs are train altogether; run is a number. Where a type's pool isn't the size of both quotas, its halves are taken.
    """
    h = order_hash(F.col(run))
    w = Window.partitionBy(*config)
    out = runs.withColumns({"_rn": F.row_number().over(w.orderBy(h, run)), "_n": F.count(F.lit(1)).over(w)})
    pool = (F.col("_n") >= train) & (F.col("_rn") > train)
    p = Window.partitionBy(pool, kind)
    out = out.withColumns({"_pn": F.row_number().over(p.orderBy(h, run)), "_ps": F.count(F.lit(1)).over(p)})
    val = F.coalesce(*(F.when((F.col(kind) == t) & (F.col("_ps") == VAL_QUOTA[t] + TEST_QUOTA[t]), F.lit(n)) for t, n in VAL_QUOTA.items()), F.floor(F.col("_ps") / 2))
    split = F.when(~pool, "train").when(F.col("_pn") <= val, "val").otherwise("test")
    return out.withColumn("split", split).drop("_rn", "_n", "_pn", "_ps")


def receiver_validation(rows: DataFrame, run: str, receiver: str, fraction: float, seed: int = 0) -> DataFrame:
    """run and receiver of those held out: of each run max(1, floor(n * fraction)) receivers by hash order."""
    pairs = rows.select(run, receiver).distinct()
    n = pairs.groupBy(run).agg(F.count(F.lit(1)).alias("_n"))
    return bottom_k(pairs.join(n, run), [run], receiver, F.greatest(F.lit(1), F.floor(F.col("_n") * fraction)), seed).drop("_n")


def top_up(df: DataFrame, strata: list[str], key: str, total: int, seed: int = 0) -> DataFrame:
    """fixed_sample, but what short strata lack is taken from the rest of the others by hash order."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n"))
    quota = largest_remainder(sizes, strata, total).select(*strata, "quota")
    rn = F.row_number().over(Window.partitionBy(*strata).orderBy(order_hash(F.col(key), seed), key))
    ranked = df.join(quota, strata).withColumn("_first", rn <= F.col("quota")).drop("quota")
    first = ranked.where("_first").drop("_first")
    short = total - first.count()
    if short <= 0:
        return first
    rest = ranked.where("not _first").drop("_first").orderBy(order_hash(F.col(key), seed), key).limit(short)
    return first.unionByName(rest)


def weighted_draws(df: DataFrame, key: str, weight: Column, draws: int, seed: int = 0, bits: int = 10) -> DataFrame:
    """`draws` draws with replacement in proportion to weight (not above 0: 1e-8): df with the number of the draw.

    Rows lie end to end on the weight axis in the order of key hashes; 2 ** bits hash ranges are numbered by
    their totals, and a draw, an even grid shifted by the seed's hash, finds its range and then its row there.
    """
    w = F.when(weight > 0, weight.cast("double")).otherwise(F.lit(1e-8))
    rows = df.withColumns({"_w": w, "_h": order_hash(F.col(key), seed)}).withColumn("_range", F.shiftrightunsigned("_h", 32 - bits).cast("int"))
    sizes = rows.groupBy("_range").agg(F.sum("_w").alias("_size"))
    upto = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))  # 2 ** bits rows
    ranges = sizes.withColumn("_from", upto - F.col("_size"))
    ranges = ranges.join(F.broadcast(sizes.agg(F.sum("_size").alias("_total"))))
    at = F.sum("_w").over(Window.partitionBy("_range").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_from")
    rows = rows.join(F.broadcast(ranges), "_range").withColumn("_to", at)
    shift = (seed * MULTIPLIER % MODULUS) / MODULUS
    first = F.ceil((F.col("_to") - F.col("_w")) / F.col("_total") * draws - shift)
    last = F.ceil(F.col("_to") / F.col("_total") * draws - shift) - 1
    numbers = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumn("draw", F.explode(numbers)).select(*df.columns, F.pmod(F.col("draw"), F.lit(draws)).alias("draw"))


def cap_rows(df: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """At most `most` rows by hash order; splits take seed, seed + 1 and seed + 2."""
    return df.orderBy(order_hash(F.col(key), seed), key).limit(most)


def ordered_subset(df: DataFrame, key: str, most: int, order: str, seed: int = 0) -> DataFrame:
    """cap_rows in the original order."""
    return cap_rows(df, key, most, seed).orderBy(order)


def demo_picks(pool: DataFrame, key: str, wanted: list[tuple[str, Column, Column]], exclude: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """One row for each (name, condition, preference): the row of least preference, then least hash, that no earlier one took.

    Rows whose key is in exclude are not eligible. Picks are a few rows; a name without an eligible row is absent.
    """
    left = pool if exclude is None else pool.join(exclude.select(key).distinct(), key, "left_anti")
    out, taken = None, []
    for i, (name, condition, preference) in enumerate(wanted):
        free = left.where(condition & ~F.col(key).isin(taken)) if taken else left.where(condition)
        pick = free.orderBy(preference, order_hash(F.col(key), seed + i), key).limit(1).withColumn("demo", F.lit(name))
        row = pick.collect()  # one row
        taken += [r[key] for r in row]
        one = pool.sparkSession.createDataFrame(row, pick.schema)
        out = one if out is None else out.unionByName(one)
    return out


def complete_runs(runs: DataFrame, config: list[str], status: str = "status") -> DataFrame:
    """Healthy runs with all config columns."""
    return runs.where(F.col(status) == "ok").dropna(subset=config)
