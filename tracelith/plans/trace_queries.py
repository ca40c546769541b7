"""Queries over the driver's tables. Traces are not among them: messages are read off `events`, see MSG_SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bins as B
from ..functions import kernels as K
from ..functions import text as T
from ..operators import episodes as E
from ..operators import metrics as M
from ..operators import sampling as S
from ..operators import traces as O
from ..operators.quantiles import exact_quantiles

QUERIES: dict = {}
ORACLE_SQL: dict = {}

MSG_SQL = """msg AS (SELECT event_id AS id, user_id % 10 AS receiver, user_id AS sender, user_id * 4 + k % 4 AS pseudo, epoch_us(ts) / 1e6 AS t,
 CASE WHEN event_type = 'signup' THEN 2 ELSE 3 END AS type, "value" AS x, k::DOUBLE AS y, "value" / 10 AS speed, k * 3.6e0 - 180 AS heading, CASE WHEN user_id % 3 = 0 THEN 16 ELSE 0 END AS flag
 FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))"""
HOUR = 3600.0


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            # 1.0 would be a decimal in DuckDB; the engine's scores are doubles.
            ORACLE_SQL[name] = re.sub(r"(?<![\d.])([01])\.0(?!\d)", r"\1e0", sql)
        return f

    return add


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return messages_of(load(spark, sf, "events"))


def messages_of(e: DataFrame) -> DataFrame:
    """Events, a table or a stream, read as messages."""
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 10).alias("receiver"), F.col("user_id").alias("sender"), (F.col("user_id") * 4 + k % 4).alias("pseudo"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.when(F.col("event_type") == "signup", 2).otherwise(3).alias("type"),
        F.col("value").alias("x"), k.cast("double").alias("y"), (F.col("value") / 10).alias("speed"), (k * 3.6 - 180).alias("heading"), F.when(F.col("user_id") % 3 == 0, 16).otherwise(0).alias("flag"),
    )


def rounded(df: DataFrame, digits: int = 5) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query("w1_lag_plausibility", f"""WITH {MSG_SQL},
p AS (SELECT *, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(speed) OVER w AS pv FROM msg WINDOW w AS (PARTITION BY sender ORDER BY t, id)),
q AS (SELECT id, sender, t - pt AS gap, (t - pt) / 3600 AS dt, sqrt((x-px)*(x-px)+(y-py)*(y-py)) AS d, speed AS v, pv FROM p WHERE t - pt > 0)
SELECT id, sender, round(gap, 5) AS gap,
 round(CASE WHEN d <= 40*dt-2 THEN 1.0 WHEN d >= 40*dt+2 THEN 0.0 ELSE (40*dt+2-d)/4 END, 5) AS position_score,
 round(CASE WHEN abs(v-pv) <= CASE WHEN v>pv THEN 3.0 ELSE 4.5 END*dt-1 THEN 1.0 WHEN abs(v-pv) >= CASE WHEN v>pv THEN 3.0 ELSE 4.5 END*dt+1 THEN 0.0 ELSE (CASE WHEN v>pv THEN 3.0 ELSE 4.5 END*dt+1-abs(v-pv))/2 END, 5) AS speed_score,
 round(CASE WHEN dt >= 3.1 THEN 1.0 ELSE greatest(0.0, least(1.0, 1-abs(d-0.5*(v+pv)*dt)/greatest(0.5*4.5*dt*dt+4.1, 1e-6))) END, 5) AS position_speed_score,
 CASE WHEN dt < 0.9 THEN 0.0 ELSE 1.0 END AS frequency_score FROM q""")  # fmt: skip
def w1_lag_plausibility(spark, sf):
    m = O.with_previous(messages(spark, sf), ["sender"], ["t", "id"], ["x", "y", "speed"]).where("dt is not null")
    dt, d = F.col("dt") / HOUR, K.distance(F.col("x"), F.col("y"), F.col("prev_x"), F.col("prev_y"))
    v, v0 = F.col("speed"), F.col("prev_speed")
    return rounded(m.select("id", "sender", F.col("dt").alias("gap"), K.position_score(d, dt, F.lit(2.0)).alias("position_score"), K.speed_change_score(v, v0, dt, F.lit(1.0)).alias("speed_score"),
        K.position_speed_score(d, v, v0, dt, F.lit(2.0)).alias("position_speed_score"), K.frequency_score(dt).alias("frequency_score")))


@query("k_kernels", f"""WITH {MSG_SQL}, q AS (SELECT id, sqrt((x-50)*(x-50)+(y-50)*(y-50)) AS d, speed * 4 AS v, heading FROM msg)
SELECT id, round(d, 5) AS distance, round(CASE WHEN d <= 100 THEN 1.0 WHEN d >= 740 THEN 0.0 ELSE (740-d)/640 END, 5) AS range_score,
 round(CASE WHEN v+1 < 40 THEN 1.0 WHEN v-1 > 40 THEN 0.0 ELSE greatest(0.0, least(1.0, (1+(40-v))/2)) END, 5) AS speed_score,
 round(CASE WHEN d < 1e9 THEN greatest(0.0, least(1.0, 1-greatest(0.0, sqrt(29)+20-d)/(sqrt(29)+20))) END, 5) AS overlap_score,
 round(CASE WHEN (abs(heading-30) % 360) > 180 THEN 360-(abs(heading-30) % 360) ELSE abs(heading-30) % 360 END, 5) AS angle,
 round(degrees(atan2(50.0, 1+d)), 5) AS bearing FROM q""")  # fmt: skip
def k_kernels(spark, sf):
    m = messages(spark, sf).withColumn("d", K.distance(F.col("x"), F.col("y"), F.lit(50.0), F.lit(50.0)))
    return rounded(m.select("id", F.col("d").alias("distance"), K.range_score(F.col("d"), F.lit(320.0)).alias("range_score"), K.speed_score(F.col("speed") * 4, F.lit(2.0)).alias("speed_score"),
        K.overlap_score(F.col("d"), F.lit(10.0), F.lit(10.0)).alias("overlap_score"), K.angle_difference(F.col("heading"), F.lit(30.0)).alias("angle"), K.heading(1 + F.col("d"), F.lit(50.0)).alias("bearing")))


@query("k8_lens_appearance", f"""WITH {MSG_SQL}, q AS (SELECT id, 300 + sqrt((x-50)*(x-50)+(y-50)*(y-50)) AS d FROM msg)
SELECT id, round(CASE WHEN d >= 520 THEN 1.0 WHEN d <= 320 THEN 0.0 ELSE 1 - (100*100*acos((d*d+100*100-420*420)/(2*d*100)) + 420*420*acos((d*d+420*420-100*100)/(2*d*420))
 - 0.5*sqrt((-d+520)*(d+100-420)*(d-100+420)*(d+520)))/(pi()*100*100) END, 5) AS appearance_score FROM q""")  # fmt: skip
def k8_lens_appearance(spark, sf):
    d = 300 + K.distance(F.col("x"), F.col("y"), F.lit(50.0), F.lit(50.0))
    return rounded(messages(spark, sf).select("id", K.appearance_score(d, F.lit(100.0), F.lit(0.0)).alias("appearance_score")))


@query("j1_asof_backward", f"""WITH {MSG_SQL}, q AS (SELECT *, last_value(CASE WHEN type = 2 THEN id END IGNORE NULLS) OVER (PARTITION BY receiver ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS eid FROM msg)
SELECT q.id, q.receiver, s.id AS ego_id, round(s.x, 5) AS ego_x, round(sqrt((q.x-s.x)*(q.x-s.x)+(q.y-s.y)*(q.y-s.y)), 5) AS distance FROM q JOIN msg s ON s.id = q.eid WHERE q.type = 3""")
def j1_asof_backward(spark, sf):
    m = O.asof_backward(messages(spark, sf), ["receiver"], ["t", "id"], F.col("type") == 2, ["id", "x", "y"])
    return rounded(m.select("id", "receiver", "ego_id", "ego_x", K.distance(F.col("x"), F.col("y"), F.col("ego_x"), F.col("ego_y")).alias("distance")))


@query("j2_asof_nearest", f"""WITH {MSG_SQL}, q AS (SELECT m.id, m.t, arg_min(s.t, struct_pack(d := abs(s.t - m.t), t := s.t)) AS ego_t FROM msg m JOIN msg s ON s.receiver = m.receiver AND s.type = 2 WHERE m.type = 3 GROUP BY m.id, m.t)
SELECT id, round(ego_t - t, 5) AS dt FROM q""")
def j2_asof_nearest(spark, sf):
    m = O.asof_nearest(messages(spark, sf), ["receiver"], ["id"], F.col("type") == 2, ["id"])
    return rounded(m.select("id", (F.col("ego_t") - F.col("t")).alias("dt")))


@query("j3_sender_truth", f"""WITH {MSG_SQL}, q AS (SELECT m.id, m.sender, m.t, m.x, arg_min(s.x, struct_pack(d := abs(s.t - m.t), t := s.t)) AS tx FROM msg m LEFT JOIN msg s ON s.sender = m.sender AND s.type = 2 WHERE m.type = 3 GROUP BY m.id, m.sender, m.t, m.x)
SELECT sender, count(*)::BIGINT AS n, (count(*) FILTER (tx IS NULL))::BIGINT AS n_missing, round(avg(abs(x - tx)), 4) AS mean_error FROM q GROUP BY sender""")
def j3_sender_truth(spark, sf):
    m = messages(spark, sf)
    got = O.asof_nearest(m, ["sender"], ["id"], F.col("type") == 2, ["x"])
    all_ = m.where("type = 3").groupBy("sender").agg(F.count(F.lit(1)).alias("n"))
    err = got.groupBy("sender").agg(F.count(F.lit(1)).alias("hit"), F.avg(F.abs(F.col("x") - F.col("ego_x"))).alias("mean_error"))
    return all_.join(err, "sender", "left").select("sender", "n", (F.col("n") - F.coalesce("hit", F.lit(0))).alias("n_missing"), F.round("mean_error", 4).alias("mean_error"))


@query("w2_neighbour_context", f"""WITH {MSG_SQL}, prior AS (SELECT a.id, a.pseudo AS ap, b.pseudo, arg_max(b.id, struct_pack(t := b.t, i := b.id)) AS bid FROM msg a JOIN msg b ON a.receiver = b.receiver AND b.t >= a.t - 21600 AND (b.t < a.t OR (b.t = a.t AND b.id < a.id)) GROUP BY a.id, a.pseudo, b.pseudo),
n AS (SELECT p.id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d, abs(a.speed-b.speed) AS ds, b.id AS bid FROM prior p JOIN msg a ON a.id = p.id JOIN msg b ON b.id = p.bid WHERE p.pseudo <> p.ap),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, bid) AS rn FROM n WHERE d <= 30)
SELECT m.id, count(r.d)::BIGINT AS n_neighbours, round(min(r.d), 5) AS min_distance, round(avg(r.d), 4) AS mean_distance, (count(*) FILTER (r.d <= 10))::BIGINT AS n_within_10, round(avg(r.ds), 9) AS mean_speed_diff FROM msg m LEFT JOIN r ON r.id = m.id AND r.rn <= 20 GROUP BY m.id""")  # fmt: skip
def w2_neighbour_context(spark, sf):
    c = O.neighbour_context(messages(spark, sf), "receiver", 6 * HOUR, 30.0)
    return c.select("id", "n_neighbours", F.round("min_distance", 5).alias("min_distance"), F.round("mean_distance", 4).alias("mean_distance"), "n_within_10", F.round("mean_speed_diff", 9).alias("mean_speed_diff"))


@query("w9_sender_history", f"""WITH {MSG_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY t, id) AS rn FROM msg),
h AS (SELECT a.id, b.t, b.x, b.rn FROM r a JOIN r b ON a.sender = b.sender AND b.rn BETWEEN a.rn - 8 AND a.rn - 1 AND b.t >= a.t - 86400)
SELECT m.id, count(h.rn)::BIGINT AS h_count, round(arg_max(h.x, h.rn), 5) AS h_last, round(min(h.x), 5) AS h_min, round(max(h.x), 5) AS h_max, round(avg(h.x), 7) AS h_mean, (count(*) FILTER (h.x <= 20))::BIGINT AS h_t1, (count(*) FILTER (h.x <= 60))::BIGINT AS h_t2 FROM msg m LEFT JOIN h ON h.id = m.id GROUP BY m.id""")  # fmt: skip
def w9_sender_history(spark, sf):
    h = O.sender_history(messages(spark, sf), ["sender"], ["t", "id"], "x", 8, 24 * HOUR, ("le", 20.0), ("le", 60.0))
    return h.select("id", "h_count", *(F.round(c, 5).alias(c) for c in ("h_last", "h_min", "h_max")), F.round("h_mean", 7).alias("h_mean"), "h_t1", "h_t2")


@query("m1_threshold_mining", f"""WITH {MSG_SQL}, r AS (SELECT x, flag, row_number() OVER (ORDER BY x) AS rn, count(*) OVER () AS n FROM msg), g AS (SELECT count(*) AS n, count(*) FILTER (flag <> 0) AS n1 FROM msg),
c AS (SELECT q, x AS thr FROM r, (VALUES (0.05), (0.1), (0.2), (0.3)) v(q) WHERE rn = round_even(q * (n - 1), 0) + 1),
e AS (SELECT q, thr, count(*) AS h, count(*) FILTER (flag <> 0) AS h1 FROM c JOIN msg ON x <= thr GROUP BY q, thr)
SELECT q::DOUBLE AS q, round(thr, 6) AS threshold, 'le' AS op, round(h / n, 6) AS support, round(abs(h1 / n1 - (h - h1) / (n - n1)), 6) AS gap FROM e, g""")  # fmt: skip
def m1_threshold_mining(spark, sf):
    return rounded(O.mine_thresholds(messages(spark, sf), "x", "flag", [0.05, 0.1, 0.2, 0.3]).drop("score"), 6)


WINDOWS = {"train": (0.0, 15.0), "val": (15.0, 20.0), "test": (22.0, 30.0)}


@query("sp2_time_split", f"""WITH {MSG_SQL}, f AS (SELECT sender AS s, max(flag) AS mf FROM msg GROUP BY sender), d AS (SELECT m.*, (t - 1704067200) / 86400 AS day, f.mf FROM msg m LEFT JOIN f ON f.s = m.sender),
x AS (SELECT CASE WHEN day >= 0 AND day < 15 THEN 'train' WHEN day >= 15 AND day < 20 THEN 'val' WHEN day >= 22 AND day < 30 THEN 'test' END AS split, CASE WHEN coalesce(mf, 0) <> 0 THEN 1 ELSE 0 END AS label FROM d)
SELECT split, label, count(*)::BIGINT AS n FROM x WHERE split IS NOT NULL GROUP BY split, label""")  # fmt: skip
def sp2_time_split(spark, sf):
    m = messages(spark, sf)
    flags = m.groupBy("sender").agg(F.max("flag").alias("sender_flag"))
    labelled = m.join(flags, "sender", "left").withColumn("label", F.when(F.coalesce("sender_flag", F.lit(0)) != 0, 1).otherwise(0))
    split = S.time_split(labelled.withColumn("day", (F.col("t") - 1704067200) / 86400), {k: [v] for k, v in WINDOWS.items()}, "day")
    return split.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query("sp4_bottom_k", """SELECT o_orderkey, o_orderstatus FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY ((o_orderkey + 7) * 2654435761) % 4294967296, o_orderkey) AS rn FROM orders) WHERE rn <= 50""")
def sp4_bottom_k(spark, sf):
    return S.bottom_k(load(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderstatus"], "o_orderkey", 50, seed=7)


@query("sp7_fraction_sample", """WITH r AS (SELECT c_custkey, c_mktsegment, count(*) OVER (PARTITION BY c_mktsegment) AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey * 2654435761) % 4294967296, c_custkey) AS rn FROM customer)
SELECT c_custkey, c_mktsegment FROM r WHERE rn <= greatest(1, floor(n * 0.05))""")
def sp7_fraction_sample(spark, sf):
    return S.fraction_sample(load(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], "c_custkey", 0.05)


@query("sp8_largest_remainder", """WITH s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), e AS (SELECT *, n * 100.0::DOUBLE / sum(n) OVER () AS exact FROM s), b AS (SELECT *, floor(exact) AS base FROM e)
SELECT lang, n::BIGINT AS n, (base + CASE WHEN row_number() OVER (ORDER BY round(exact - base, 9) DESC, lang) <= 100 - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM b""")
def sp8_largest_remainder(spark, sf):
    return S.largest_remainder(load(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), ["lang"], 100)


@query("w17_shards", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderkey * 2654435761) % 4294967296, o_orderkey) - 1 AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey, floor(rn / ceil(n / 8))::BIGINT AS shard FROM r""")
def w17_shards(spark, sf):
    return S.shards(load(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 8)


def _judged(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return load(spark, sf, "labels").join(docs, "doc_id")


_RATIOS = "(tp+tn)/(tp+fp+fn+tn) AS accuracy, CASE WHEN tp+fp>0 THEN tp/(tp+fp) ELSE 0 END AS \"precision\", CASE WHEN tp+fn>0 THEN tp/(tp+fn) ELSE 0 END AS recall, CASE WHEN 2*tp+fp+fn>0 THEN 2*tp/(2*tp+fp+fn) ELSE 0 END AS f1"
_COUNTS = "(count(*) FILTER (quality=1 AND toxic=1))::BIGINT AS tp, (count(*) FILTER (quality=0 AND toxic=1))::BIGINT AS fp, (count(*) FILTER (quality=1 AND toxic=0))::BIGINT AS fn, (count(*) FILTER (quality=0 AND toxic=0))::BIGINT AS tn"
_BIN = "CASE WHEN n_chars IS NULL THEN 'null' WHEN n_chars <= 0 THEN '<=0' WHEN n_chars <= 1000 THEN '(0,1000]' WHEN n_chars <= 5000 THEN '(1000,5000]' ELSE '>5000' END"


@query("a10_confusion", f"SELECT tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(\"precision\", 6) AS \"precision\", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (SELECT *, {_RATIOS} FROM (SELECT {_COUNTS} FROM labels JOIN documents USING (doc_id)))")
def a10_confusion(spark, sf):
    return rounded(M.confusion(_judged(spark, sf), [], "quality", "toxic"), 6)


@query("a12_bucketed", f"""WITH j AS (SELECT quality, toxic, lang, {_BIN} AS size FROM labels JOIN documents USING (doc_id)), u AS (SELECT quality, toxic, 'lang' AS key, lang AS bucket FROM j UNION ALL SELECT quality, toxic, 'size', size FROM j)
SELECT key, bucket, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM (SELECT *, {_RATIOS} FROM (SELECT key, bucket, {_COUNTS} FROM u GROUP BY key, bucket))""")
def a12_bucketed(spark, sf):
    return rounded(M.bucketed(_judged(spark, sf), {"lang": F.col("lang"), "size": B.edge_bin(F.col("n_chars"), [1000, 5000])}, "quality", "toxic"), 6)


@query("a14_shard_merge", f"SELECT tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, n_seen, n_missing, n_missing = 0 AS complete FROM (SELECT *, {_RATIOS} FROM (SELECT {_COUNTS}, count(DISTINCT CASE WHEN doc_id % 9 < 8 THEN doc_id % 9 END)::BIGINT AS n_seen, (9 - count(DISTINCT CASE WHEN doc_id % 9 < 8 THEN doc_id % 9 END))::BIGINT AS n_missing FROM labels JOIN documents USING (doc_id) WHERE doc_id % 9 < 8))")
def a14_shard_merge(spark, sf):
    j = _judged(spark, sf).withColumn("shard", F.col("doc_id") % 9).where("shard < 8")
    per = M.confusion(j, ["shard"], "quality", "toxic").select("shard", "tp", "fp", "fn", "tn")
    total = M.with_ratios(per.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")))).select("tp", "fp", "fn", "tn", "accuracy", "f1")
    return rounded(total.join(F.broadcast(M.coverage(per, "shard", 9))), 6)


@query("a16_histogram", "SELECT bucket, n::BIGINT AS n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT CASE WHEN l_linenumber <= 8 AND l_quantity <= 8 THEN '<=8' WHEN l_quantity <= 16 THEN '9-16' WHEN l_quantity <= 24 THEN '17-24' WHEN l_quantity <= 32 THEN '25-32' ELSE '>32' END AS bucket, count(*) AS n FROM lineitem GROUP BY 1)")
def a16_histogram(spark, sf):
    return rounded(M.histogram(load(spark, sf, "lineitem"), B.candidate_bin(F.col("l_quantity"))), 6)


@query("a13_once_per_episode", """WITH e AS (SELECT l_returnflag AS bucket, l_orderkey AS episode, arg_min(l_quantity, l_linenumber::BIGINT * 10000000000 + l_partkey * 100 + l_quantity::BIGINT) AS first_quantity, count(*) AS n_rows FROM lineitem GROUP BY 1, 2)
SELECT bucket, count(*)::BIGINT AS episodes, sum(n_rows)::BIGINT AS rows, round(avg(first_quantity), 5) AS mean_first FROM e GROUP BY bucket""")
def a13_once_per_episode(spark, sf):
    key = F.col("l_linenumber").cast("long") * 10000000000 + F.col("l_partkey") * 100 + F.col("l_quantity").cast("long")
    e = load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("bucket"), "l_orderkey").agg(F.min_by("l_quantity", key).alias("first_quantity"), F.count(F.lit(1)).alias("n_rows"))
    return e.groupBy("bucket").agg(F.count(F.lit(1)).alias("episodes"), F.sum("n_rows").alias("rows"), F.round(F.avg("first_quantity"), 5).alias("mean_first"))


_AUDIT = ("l_quantity", "l_discount", "l_tax")


@query("a19_feature_audit", " UNION ALL ".join(f"""SELECT '{f}' AS feature, part, count(*)::BIGINT AS n, round(avg(({f} IS NULL)::INT), 5) AS null_rate, round(avg({f}), 5) AS mean, round(stddev_samp({f}), 5) AS std, round(min({f}), 5) AS min, round(max({f}), 5) AS max, round(avg(({f} = 1)::INT), 5) AS eq1_rate, round(avg(({f} = 0)::INT), 5) AS eq0_rate,
 round(avg(({f} <= 0.95)::INT), 5) AS le_0p95_rate, round(avg(({f} <= 0.9)::INT), 5) AS le_0p9_rate, round(avg(({f} <= 0.8)::INT), 5) AS le_0p8_rate, round(avg(({f} <= 0.5)::INT), 5) AS le_0p5_rate, {', '.join(f'round(quantile_cont({f}, {q}), 5) AS q{round(100 * q):02d}' for q in M.QUANTILES)} FROM (SELECT *, unnest(['all', 'label=' || l_returnflag]) AS part FROM lineitem) GROUP BY part""" for f in _AUDIT))  # fmt: skip
def a19_feature_audit(spark, sf):
    return rounded(M.audit(load(spark, sf, "lineitem"), list(_AUDIT), "l_returnflag"))


@query("a23_error_threshold", """WITH t AS (SELECT l_suppkey % 7 AS run, quantile_cont(CASE WHEN l_returnflag = 'N' THEN l_discount * l_quantity END, 0.9) AS eps FROM lineitem GROUP BY 1)
SELECT l_suppkey % 7 AS run, round(any_value(coalesce(eps, 0)), 6) AS eps, (count(*) FILTER (l_discount * l_quantity > coalesce(eps, 0)))::BIGINT AS n_attack, count(*)::BIGINT AS n FROM lineitem JOIN t ON t.run = l_suppkey % 7 GROUP BY 1""")
def a23_error_threshold(spark, sf):
    li = load(spark, sf, "lineitem").select((F.col("l_suppkey") % 7).alias("run"), "l_returnflag", (F.col("l_discount") * F.col("l_quantity")).alias("err"))
    eps = exact_quantiles(li.where("l_returnflag = 'N'"), ["run"], "err", {"eps": 0.9})
    li = li.join(eps.select("run", "eps"), "run", "left").withColumn("eps", F.coalesce("eps", F.lit(0.0)))
    return li.groupBy("run").agg(F.round(F.first("eps"), 6).alias("eps"), F.sum((F.col("err") > F.col("eps")).cast("long")).alias("n_attack"), F.count(F.lit(1)).alias("n"))


@query("w11_k_windows", """WITH r AS (SELECT conv_id, turn, row_number() OVER w AS n, lag(turn, 3) OVER w AS first_turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, first_turn, chars::BIGINT AS chars FROM r WHERE n >= 4 AND (n - 4) % 2 = 0""")
def w11_k_windows(spark, sf):
    c = load(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("len"))
    w = O.k_windows(c, ["conv_id"], ["turn"], 4, 2, ["turn", "len"])
    return w.select("conv_id", "turn", F.col("items")[0]["turn"].alias("first_turn"), F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x["len"]).alias("chars"))


_EP = f"""WITH {MSG_SQL}, b AS (SELECT *, min(t) OVER (PARTITION BY receiver) AS lo, max(t) OVER (PARTITION BY receiver) AS hi FROM msg),
ep AS (SELECT b.*, w.i AS window_no FROM b, range(0, 400) w(i) WHERE w.i <= floor((hi + 43200 - 86400 - lo) / 43200) AND t >= lo + w.i * 43200 AND t <= lo + w.i * 43200 + 86400)"""


@query("w13_episode_regions", _EP + """ SELECT receiver, window_no, count(*)::BIGINT AS num_msgs, count(DISTINCT pseudo)::BIGINT AS num_pseudos, count(DISTINCT sender)::BIGINT AS num_senders, round(avg(speed), 8) AS avg_speed, round(quantile_cont(speed, 0.5), 8) AS median_speed, round(CASE WHEN count(*) > 1 THEN stddev_pop(speed) ELSE 0 END, 8) AS std_speed, round(avg((speed < 2)::INT), 5) AS slow_fraction FROM ep GROUP BY receiver, window_no""")
def w13_episode_regions(spark, sf):
    e = O.sliding_episodes(messages(spark, sf), "receiver", 24 * HOUR, 12 * HOUR)
    return e.groupBy("receiver", "window_no").agg(F.count(F.lit(1)).alias("num_msgs"), F.countDistinct("pseudo").alias("num_pseudos"), F.countDistinct("sender").alias("num_senders"), F.round(F.avg("speed"), 8).alias("avg_speed"),
        F.round(F.percentile("speed", 0.5), 8).alias("median_speed"), F.round(F.when(F.count(F.lit(1)) > 1, F.stddev_pop("speed")).otherwise(0.0), 8).alias("std_speed"), F.round(F.avg((F.col("speed") < 2).cast("int")), 5).alias("slow_fraction"))


@query("a5_episode_tracks", _EP + """, l AS (SELECT *, t - lag(t) OVER (PARTITION BY receiver, window_no, pseudo ORDER BY t, id) AS iat FROM ep)
SELECT receiver, window_no, pseudo, count(*)::BIGINT AS num_msgs, round(max(t) - min(t), 4) AS duration, round((max(t) - min(t)) / 86400, 6) AS lifetime_fraction, round(CASE WHEN max(t) > min(t) THEN count(*) / (max(t) - min(t)) END, 8) AS msg_rate, round(avg(speed), 8) AS mean_speed, round(coalesce(avg(iat), 0), 3) AS mean_iat,
 round(sqrt(power(arg_max(x, t) - arg_min(x, t), 2) + power(arg_max(y, t) - arg_min(y, t), 2)), 4) AS displacement FROM l GROUP BY receiver, window_no, pseudo""")  # fmt: skip
def a5_episode_tracks(spark, sf):
    e = O.sliding_episodes(messages(spark, sf), "receiver", 24 * HOUR, 12 * HOUR)
    t = E.tracks(e, ["receiver", "window_no"], 24 * HOUR)
    r = lambda c, n: F.round(c, n).alias(c)
    return t.select("receiver", "window_no", "pseudo", "num_msgs", r("duration", 4), r("lifetime_fraction", 6), r("msg_rate", 8), r("mean_speed", 8), r("mean_iat", 3), r("displacement", 4))


@query("t9_label_parsing", """WITH s AS (SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN 'No ATTACK here, benign' WHEN 1 THEN 'Benign.' WHEN 2 THEN 'answer: 1' WHEN 3 THEN 'benign then attack' ELSE text END AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(s, '(?i)\\battack\\b') THEN 1 WHEN regexp_matches(s, '(?i)\\bbenign\\b') THEN 0 WHEN regexp_extract(s, '\\b([01])\\b', 1) <> '' THEN regexp_extract(s, '\\b([01])\\b', 1)::INT END AS label,
 CASE WHEN instr(lower(s), 'attack') > 0 AND (instr(lower(s), 'benign') = 0 OR instr(lower(s), 'attack') < instr(lower(s), 'benign')) THEN 'ATTACK' WHEN instr(lower(s), 'benign') > 0 THEN 'BENIGN' ELSE 'UNKNOWN' END AS first FROM s""")  # fmt: skip
def t9_label_parsing(spark, sf):
    c = F.col("conv_id") % 5
    s = F.when(c == 0, "No ATTACK here, benign").when(c == 1, "Benign.").when(c == 2, "answer: 1").when(c == 3, "benign then attack").otherwise(F.col("text"))
    return load(spark, sf, "conversations").select("conv_id", "turn", B.parse_label(s).alias("label"), B.first_label(s).alias("first"))


@query("t1_bins", f"""WITH {MSG_SQL} SELECT id, CASE WHEN y = 0 THEN '0' WHEN y = 1 THEN '1' WHEN y <= 3 THEN '2-3' WHEN y <= 7 THEN '4-7' ELSE '8+' END AS count_bin,
 CASE WHEN y / 99 = 0 THEN '0' WHEN y / 99 = 1 THEN '1' WHEN y / 99 <= 0.2 THEN '(0,0.2]' WHEN y / 99 <= 0.5 THEN '(0.2,0.5]' WHEN y / 99 <= 0.8 THEN '(0.5,0.8]' WHEN y / 99 <= 0.95 THEN '(0.8,0.95]' ELSE '(0.95,1)' END AS score_bin,
 CASE WHEN y <= 1 THEN '0-1' WHEN y = 4 THEN '2-4' WHEN y <= 8 THEN '5-8' WHEN y <= 14 THEN '9-14' ELSE '>14' END AS attackers_strict, CASE WHEN y <= 1 THEN '0-1' WHEN y <= 4 THEN '2-4' WHEN y <= 8 THEN '5-8' WHEN y <= 14 THEN '9-14' ELSE '>14' END AS attackers FROM msg""")  # fmt: skip
def t1_bins(spark, sf):
    y = F.col("y")
    return messages(spark, sf).select("id", B.count_bin(y).alias("count_bin"), B.score_bin(y / 99).alias("score_bin"), B.attacker_bin(y, True).alias("attackers_strict"), B.attacker_bin(y).alias("attackers"))


@query("w16_token_budget", """WITH c AS (SELECT conv_id, turn, length(text) AS cost FROM conversations), r AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM c),
o AS (SELECT *, max(CASE WHEN used > 800 AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS over FROM r) SELECT conv_id, turn, used::BIGINT AS used FROM o WHERE over = 0""")
def w16_token_budget(spark, sf):
    c = load(spark, sf, "conversations").select("conv_id", "turn", F.length("text").alias("cost"))
    return T.budget_prefix(c, ["conv_id"], ["turn"], "cost", 800).select("conv_id", "turn", "used")


@query("t16_prompts", f"""WITH {MSG_SQL} SELECT id, 'Judge one message.' || chr(10) || '[motion]' || chr(10) || '- sender: ' || sender || chr(10) || '- kind: ' || type || chr(10) || '[claims]' || chr(10) || '- flag: ' || flag || chr(10) || 'Is it an attack?' || chr(10) || 'Answer:' AS prompt FROM msg""")
def t16_prompts(spark, sf):
    p = T.prompt("Judge one message.", {"motion": [("sender", F.col("sender").cast("string")), ("kind", F.col("type").cast("string"))], "claims": [("flag", F.col("flag").cast("string"))]}, "Is it an attack?")
    return messages(spark, sf).select("id", p.alias("prompt"))


@query("set1_user_sets", """SELECT 'both' AS what, count(*)::BIGINT AS n FROM (SELECT user_id FROM events WHERE event_type = 'signup' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase')
UNION ALL SELECT 'only_signup', count(*)::BIGINT FROM (SELECT user_id FROM events WHERE event_type = 'signup' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase') UNION ALL SELECT 'either', count(DISTINCT user_id)::BIGINT FROM events WHERE event_type IN ('signup', 'purchase')""")
def set1_user_sets(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_type")
    a, b = (e.where(F.col("event_type") == x).select("user_id") for x in ("signup", "purchase"))
    n = lambda d, what: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return n(a.intersect(b), "both").union(n(a.subtract(b), "only_signup")).union(n(a.union(b).distinct(), "either"))


@query("j9_semi_anti", """SELECT 'found' AS what, count(*)::BIGINT AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT 'missing', count(*)::BIGINT FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def j9_semi_anti(spark, sf):
    c, o = load(spark, sf, "customer"), load(spark, sf, "orders")
    found = o.join(c.where("c_mktsegment = 'BUILDING'"), o.o_custkey == c.c_custkey, "left_semi").agg(F.count(F.lit(1)).alias("n"))
    missing = c.join(o, o.o_custkey == c.c_custkey, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.lit("found").alias("what"), "n").union(missing.select(F.lit("missing").alias("what"), "n"))


@query("j4_star_lookup", """SELECT r_name, o_orderstatus, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def j4_star_lookup(spark, sf):
    o, c, n, r = (load(spark, sf, x) for x in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j13_reconciliation", """WITH a AS (SELECT l_returnflag AS k, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT k, n::BIGINT AS a_n, b_n::BIGINT AS b_n, n = b_n AND abs(q - b_q) <= 1e-6 AS agrees FROM a JOIN (SELECT l_returnflag AS k, count(*) AS b_n, sum(l_quantity) AS b_q FROM lineitem WHERE l_returnflag <> 'A' OR l_linenumber > 1 GROUP BY 1) USING (k)""")
def j13_reconciliation(spark, sf):
    li = load(spark, sf, "lineitem").withColumn("k", F.col("l_returnflag"))
    a = li.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    b = li.where("l_returnflag <> 'A' or l_linenumber > 1").groupBy("k", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")).groupBy("k").agg(F.sum("n").alias("n"), F.sum("q").alias("q"))
    return M.reconcile(a, b, ["k"], ["n"], ["q"], 1e-6).select("k", "a_n", "b_n", "agrees")


@query("src21_metrics_lines", """SELECT event_id AS id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE event_type = 'purchase'""")
def src21_metrics_lines(spark, sf):
    from ..sources.logs import metrics_lines

    lines = load(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "purchase", F.concat(F.lit("METRICS_JSON: "), "props")).otherwise(F.concat(F.lit("step "), "props")).alias("value"))
    return metrics_lines(lines, "k long").select(F.col("event_id").alias("id"), F.col("metrics.k").alias("k"))


@query("ml2_logistic_baseline")
def ml2_logistic_baseline(spark, sf):
    from ..operators.baselines import train_eval

    m = messages(spark, sf).withColumns({"label": (F.col("flag") != 0).cast("int"), "train": F.pmod(F.xxhash64("id"), F.lit(5)) != 0})
    return train_eval(m, ["x", "y", "speed", "heading"], "label", "train", "lr")


@query("sp6_fixed_sample", """WITH s AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT *, n * 500.0::DOUBLE / sum(n) OVER () AS exact FROM s), b AS (SELECT *, floor(exact) AS base FROM e),
q AS (SELECT o_orderpriority, base + CASE WHEN row_number() OVER (ORDER BY round(exact - base, 9) DESC, o_orderpriority) <= 500 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM b),
r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY (o_orderkey * 2654435761) % 4294967296, o_orderkey) AS rn FROM orders) SELECT o_orderkey, o_orderpriority FROM r JOIN q USING (o_orderpriority) WHERE rn <= quota""")
def sp6_fixed_sample(spark, sf):
    return S.fixed_sample(load(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], "o_orderkey", 500)


@query("a21_value_counts", """SELECT CASE WHEN l_quantity > 25 THEN l_linestatus END AS status, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""")
def a21_value_counts(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.when(F.col("l_quantity") > 25, F.col("l_linestatus")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("a17_first_occurrence", """SELECT user_id, arg_min(event_type, epoch_us(ts)) AS first_type, count(*)::BIGINT AS n FROM events GROUP BY user_id""")
def a17_first_occurrence(spark, sf):
    e = load(spark, sf, "events")
    key = F.unix_micros(F.col("ts").cast("timestamp"))  # unique for each user
    return e.groupBy("user_id").agg(F.min_by("event_type", key).alias("first_type"), F.count(F.lit(1)).alias("n"))


@query("a18_length_percentiles", """SELECT lang, count(*)::BIGINT AS n, round(quantile_cont(n_chars, 0.5), 4) AS p50, round(quantile_cont(n_chars, 0.9), 4) AS p90, round(quantile_cont(n_chars, 0.99), 4) AS p99, max(n_chars) AS longest, round(avg((n_chars > 5000)::INT), 6) AS over_budget FROM documents GROUP BY lang""")
def a18_length_percentiles(spark, sf):
    docs = load(spark, sf, "documents").select("lang", "n_chars")
    d = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"), F.round(F.avg((F.col("n_chars") > 5000).cast("int")), 6).alias("over_budget"))
    q = exact_quantiles(docs, ["lang"], "n_chars", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).drop("n")
    return d.join(q, "lang", "left").select("lang", "n", *(F.round(p, 4).alias(p) for p in ("p50", "p90", "p99")), "longest", "over_budget")


@query("sp13_downsample", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' OR ((l_orderkey + 3) * 2654435761) % 4294967296 < 0.25 * 4294967296""")
def sp13_downsample(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return li.where((F.col("l_returnflag") != "R") | (S.order_hash(F.col("l_orderkey"), 3) < 0.25 * S.MODULUS)).drop("l_returnflag")


@query("f7_threshold_hits", f"""WITH {MSG_SQL} SELECT sender, (count(*) FILTER (x <= 20))::BIGINT AS n_le, (count(*) FILTER (x < 20))::BIGINT AS n_lt, (count(*) FILTER (x >= 20))::BIGINT AS n_ge, (count(*) FILTER (x > 20))::BIGINT AS n_gt FROM msg GROUP BY sender""")
def f7_threshold_hits(spark, sf):
    return messages(spark, sf).groupBy("sender").agg(*(F.sum(O.hit(F.col("x"), op, 20.0).cast("long")).alias(f"n_{op}") for op in ("le", "lt", "ge", "gt")))
