"""Summaries of episodes: ego, tracks, region, groups of alike pseudonyms, congestion and identity labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K

# Speed limits of slow and medium traffic (metres a second), share of a window below which a life is short.
LOW_SPEED, MEDIUM_SPEED, SHORT_LIFE = 2.0, 8.0, 0.3


def population_std(c: str) -> Column:
    """0 below two values."""
    return F.when(F.count(c) > 1, F.stddev_pop(c)).otherwise(0.0)


def circular_mean(c: Column) -> Column:
    return F.atan2(F.sum(F.sin(c)), F.sum(F.cos(c)))


def circular_std(angles: Column, mean: Column) -> Column:
    """Of an array of radians: root of the mean squared difference from their circular mean; 0 below two values."""
    squares = F.transform(angles, lambda a: F.pow(K.signed_angle(a - mean), F.lit(2.0)))
    return F.when(F.size(angles) < 2, 0.0).otherwise(F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x) / F.size(angles)))


def spread(x: str, y: str) -> Column:
    """Diagonal of the bounding box."""
    return K.norm(F.max(x) - F.min(x), F.max(y) - F.min(y))


def ego_summary(states: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per episode with own states (columns x, y, speed, heading in degrees): first and last position, speeds, headings."""
    first, last = F.min_by(F.struct("x", "y"), F.struct(*order)), F.max_by(F.struct("x", "y"), F.struct(*order))
    e = states.withColumn("_h", F.radians("heading")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_updates"), first.alias("a"), last.alias("z"), F.avg("speed").alias("avg_speed"), population_std("speed").alias("speed_std"),
        circular_mean(F.col("_h")).alias("avg_heading"), F.collect_list("_h").alias("_hs"),
    )
    return e.select(
        *keys, "num_updates", F.col("a.x").alias("start_x"), F.col("a.y").alias("start_y"), F.col("z.x").alias("end_x"), F.col("z.y").alias("end_y"),
        K.distance(F.col("a.x"), F.col("a.y"), F.col("z.x"), F.col("z.y")).alias("displacement"), "avg_speed", "speed_std", "avg_heading", circular_std(F.col("_hs"), F.col("avg_heading")).alias("heading_std"),
    )


def with_ego(summary: DataFrame, episodes: DataFrame, keys: list[str]) -> DataFrame:
    """Every episode; num_updates is 0 where no own state is in it."""
    return episodes.join(summary, keys, "left").withColumn("num_updates", F.coalesce("num_updates", F.lit(0)))


def tracks(episodes: DataFrame, keys: list[str], window: float) -> DataFrame:
    """Every pseudonym of an episode: life, rate, gaps, positions, speeds, headings (radians). msg_rate is null for a single moment."""
    lag = F.lag("t").over(Window.partitionBy(*keys, "pseudo").orderBy("t", "id"))
    e = episodes.withColumns({"iat": F.col("t") - lag, "_h": F.radians("heading")})
    first, last = F.min_by(F.struct("x", "y"), F.struct("t", "id")), F.max_by(F.struct("x", "y"), F.struct("t", "id"))
    out = e.groupBy(*keys, "pseudo").agg(
        F.count(F.lit(1)).alias("num_msgs"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.coalesce(F.avg("iat"), F.lit(0.0)).alias("mean_iat"), population_std("iat").alias("iat_std"),
        first.alias("a"), last.alias("z"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), spread("x", "y").alias("pos_spread"),
        F.avg("speed").alias("mean_speed"), population_std("speed").alias("speed_std"), F.min("speed").alias("min_speed"), F.max("speed").alias("max_speed"),
        circular_mean(F.col("_h")).alias("avg_heading"), F.collect_list("_h").alias("_hs"), F.min("sender").alias("sender"),
    )
    life = F.col("last_t") - F.col("first_t")
    return out.select(
        *keys, "pseudo", "num_msgs", "first_t", "last_t", life.alias("duration"), (life / window).alias("lifetime_fraction"), F.when(life > 0, F.col("num_msgs") / life).alias("msg_rate"), "mean_iat", "iat_std",
        F.col("a.x").alias("start_x"), F.col("a.y").alias("start_y"), F.col("z.x").alias("end_x"), F.col("z.y").alias("end_y"), K.distance(F.col("a.x"), F.col("a.y"), F.col("z.x"), F.col("z.y")).alias("displacement"),
        "mean_x", "mean_y", "pos_spread", "mean_speed", "speed_std", "min_speed", "max_speed", "avg_heading", circular_std(F.col("_hs"), F.col("avg_heading")).alias("heading_std"), "sender",
    )


def region(episodes: DataFrame, tracked: DataFrame, keys: list[str]) -> DataFrame:
    """Messages, pseudonyms, senders and speeds of each episode; shares of slow, medium and fast messages, of single and short lives."""
    share = lambda cond: F.avg(cond.cast("double"))
    v = F.col("speed")
    m = episodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_bsms"), F.countDistinct("sender").alias("num_unique_senders"), F.avg(v).alias("avg_speed"), F.percentile(v, 0.5).alias("median_speed"), population_std("speed").alias("speed_std"),
        F.min(v).alias("min_speed"), F.max(v).alias("max_speed"), share((v >= 0) & (v < LOW_SPEED)).alias("slow_msg_fraction"), share((v >= LOW_SPEED) & (v < MEDIUM_SPEED)).alias("medium_msg_fraction"), share(v >= MEDIUM_SPEED).alias("fast_msg_fraction"),
    )
    t = tracked.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_unique_pseudos"), share(F.col("num_msgs") == 1).alias("single_message_pseudo_fraction"), share(F.col("lifetime_fraction") < SHORT_LIFE).alias("short_lived_pseudo_fraction"))
    return m.join(t, keys)


def groups(clustered: DataFrame, keys: list[str], window: float, ego: DataFrame | None = None) -> DataFrame:
    """Summary of each group of an episode. clustered: tracks with group_id. ego (keys, ego_x, ego_y) gives distance_to_ego."""
    g = clustered.groupBy(*keys, "group_id").agg(
        F.array_sort(F.collect_list("pseudo")).alias("pseudos"), F.count(F.lit(1)).alias("size"), F.sum("num_msgs").alias("total_msgs"), F.avg("mean_x").alias("gx"), F.avg("mean_y").alias("gy"),
        F.avg("mean_speed").alias("avg_speed"), (population_std("mean_speed") / (F.avg("mean_speed") + 1e-9)).alias("speed_cv"), spread("mean_x", "mean_y").alias("pos_spread"),
        F.collect_list(F.struct("mean_x", "mean_y")).alias("_at"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"), circular_mean(F.col("avg_heading")).alias("avg_heading"), F.collect_list("avg_heading").alias("_hs"),
        F.when(F.count("msg_rate") > 0, population_std("msg_rate") / (F.avg("msg_rate") + 1e-9)).otherwise(0.0).alias("msg_rate_cv"),
    )
    radius = F.array_max(F.transform("_at", lambda p: K.distance(p["mean_x"], p["mean_y"], F.col("gx"), F.col("gy"))))
    g = g.withColumns({"radius": radius, "duration": F.col("last_t") - F.col("first_t"), "heading_std": circular_std(F.col("_hs"), F.col("avg_heading"))})
    g = g.withColumns({"density_proxy": F.col("size") / (F.col("radius") + 1), "lifetime_fraction": F.col("duration") / window}).drop("_at", "_hs")
    if ego is None:
        return g
    return g.join(ego, keys, "left").withColumn("distance_to_ego", K.distance(F.col("gx"), F.col("gy"), F.col("ego_x"), F.col("ego_y"))).drop("ego_x", "ego_y")


def congestion(grouped: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Low-speed groups of each episode and its congestion level, high above 0.6 slow messages, medium above 0.3."""
    slow = F.col("avg_speed") < LOW_SPEED
    best = F.max_by(F.struct("size", "total_msgs", "avg_speed"), F.when(slow, F.struct("size", "total_msgs", -F.regexp_extract("group_id", r"(\d+)", 1).cast("long"))))
    g = grouped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_groups"), F.sum((F.col("size") > 1).cast("long")).alias("num_multi_id_groups"), F.max("size").alias("largest_group_size"), F.when(F.max(slow.cast("int")) == 1, best).alias("b"),
        F.sum(F.when(slow, F.col("total_msgs")).otherwise(0)).alias("_msgs"), F.sum(F.when(slow, F.col("size")).otherwise(0)).alias("_pseudos"),
    )
    r = regions.select(*keys, "slow_msg_fraction", "num_bsms", "num_unique_pseudos").join(g, keys, "left")
    f = F.col("slow_msg_fraction")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return r.select(
        *keys, f.alias("low_speed_fraction"), F.when(f > 0.6, "high").when(f > 0.3, "medium").otherwise("low").alias("congestion_level"), zero(F.col("num_groups")).alias("num_groups"),
        zero(F.col("num_multi_id_groups")).alias("num_multi_id_groups"), zero(F.col("largest_group_size")).alias("largest_group_size"), zero(F.col("b.size")).alias("largest_low_speed_group_size"),
        zero(F.col("b.total_msgs")).alias("largest_low_speed_group_msgs"), F.coalesce("b.avg_speed", F.lit(0.0)).alias("largest_low_speed_group_avg_speed"),
        (zero(F.col("_msgs")) / F.col("num_bsms")).alias("fraction_msgs_in_low_speed_groups"), (zero(F.col("_pseudos")) / F.col("num_unique_pseudos")).alias("fraction_pseudos_in_low_speed_groups"),
    )


def local_ids(episodes: DataFrame, keys: list[str], raw: str, mark: str) -> DataFrame:
    """keys, raw id and its local id: mark and rank by raw id within the episode."""
    ids = episodes.select(*keys, raw).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(raw))
    return ids.withColumn(f"{raw}_local_id", F.concat(F.lit(mark), rank))


def identity(episodes: DataFrame, keys: list[str], flag: str = "flag") -> DataFrame:
    """Attackers of each episode among messages, senders and pseudonyms, with local ids p1.. and s1.. by raw id."""
    bad = F.col(flag) != 0
    msgs = episodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(bad.cast("long")).alias("k"))

    def side(raw: str, mark: str) -> DataFrame:
        of = episodes.groupBy(*keys, raw).agg(F.max(bad.cast("int")).alias("bad")).join(local_ids(episodes, keys, raw, mark), [*keys, raw])
        ids = lambda b, c: F.transform(F.array_sort(F.collect_list(F.when(F.col("bad") == b, F.struct(raw, f"{raw}_local_id")))), lambda x: x[c])
        return of.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"n_{raw}"), F.sum("bad").alias(f"num_attacker_{raw}s"), ids(1, raw).alias(f"attacker_{raw}_ids"),
            ids(1, f"{raw}_local_id").alias(f"attacker_{raw}_local_ids"), ids(0, f"{raw}_local_id").alias(f"benign_{raw}_local_ids"),
        )

    out = msgs.join(side("sender", "s"), keys).join(side("pseudo", "p"), keys)
    return out.select(
        *keys, (F.col("k") > 0).alias("contains_attacker_message"), (F.col("k") / F.col("n")).alias("attacker_message_fraction"),
        *(x for raw in ("sender", "pseudo") for x in (f"num_attacker_{raw}s", (F.col(f"num_attacker_{raw}s") / F.col(f"n_{raw}")).alias(f"attacker_{raw}_fraction"), f"attacker_{raw}_ids", f"attacker_{raw}_local_ids", f"benign_{raw}_local_ids")),
        F.lit("filename_attack_flag").alias("identity_source"),
    )


def group_labels(clustered: DataFrame, episodes: DataFrame, keys: list[str], flag: str = "flag") -> DataFrame:
    """Attackers of each group, among its pseudonyms and their senders; local ids of its pseudonyms."""
    bad = F.max((F.col(flag) != 0).cast("int"))
    of = clustered.select(*keys, "group_id", "pseudo")
    pseudos = of.join(episodes.groupBy(*keys, "pseudo").agg(bad.alias("bad")), [*keys, "pseudo"]).join(local_ids(episodes, keys, "pseudo", "p"), [*keys, "pseudo"])
    p = pseudos.groupBy(*keys, "group_id").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("num_attacker_pseudos"), F.transform(F.array_sort(F.collect_list(F.struct("pseudo", "pseudo_local_id"))), lambda x: x["pseudo_local_id"]).alias("pseudo_local_ids"))
    senders = of.join(episodes.select(*keys, "pseudo", "sender").distinct(), [*keys, "pseudo"]).select(*keys, "group_id", "sender").distinct()
    senders = senders.join(episodes.groupBy(*keys, "sender").agg(bad.alias("bad")), [*keys, "sender"])
    s = senders.groupBy(*keys, "group_id").agg(F.count(F.lit(1)).alias("m"), F.sum("bad").alias("num_attacker_senders"))
    out = p.join(s, [*keys, "group_id"])
    return out.select(
        *keys, "group_id", "pseudo_local_ids", (F.col("num_attacker_pseudos") > 0).alias("contains_attacker_pseudo"), (F.col("num_attacker_senders") > 0).alias("contains_attacker_sender"), "num_attacker_pseudos",
        "num_attacker_senders", (F.col("num_attacker_pseudos") / F.col("n")).alias("attacker_pseudo_fraction"), (F.col("num_attacker_senders") / F.col("m")).alias("attacker_sender_fraction"),
    )


def nested(regions: DataFrame, ego: DataFrame, tracked: DataFrame, grouped: DataFrame, summary: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """One row per episode: region, ego, pseudo_entities, pseudo_groups, group_summary and label as nested columns."""
    pack = lambda df, name: df.select(*keys, F.struct(*(c for c in df.columns if c not in keys)).alias(name))
    many = lambda df, name, order: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in df.columns if c not in [*keys, order])))).alias(name))
    out = pack(regions, "region").join(pack(ego, "ego"), keys, "left").join(many(tracked, "pseudo_entities", "pseudo"), keys, "left")
    out = out.join(many(grouped, "pseudo_groups", "group_id"), keys, "left").join(pack(summary, "group_summary"), keys, "left")
    return out.join(pack(labels, "label"), keys, "left")


def rounded_deep(c: Column, kind: str, digits: int = 2) -> Column:
    """A double, or an array of doubles, rounded half-even; NaN and infinities become null. Other kinds stay."""
    one = lambda v: F.when(~F.isnan(v) & (F.abs(v) != math.inf), F.bround(v, digits))
    return one(c) if kind == "double" else F.transform(c, one) if kind == "array<double>" else c
