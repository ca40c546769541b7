"""Further queries over the driver's tables: features, episodes, statistics, samples, text and logs, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bins as B
from ..functions import coerce as C
from ..functions import kernels as K
from ..functions import text as T
from ..operators import episodes as E
from ..operators import metrics as M
from ..operators import sampling as S
from ..operators import traces as O
from ..sources import logs as L
from ..sources import sinks
from ..sources import specs
from .trace_queries import _EP, HOUR, MSG_SQL, load, messages, query, rounded

_DIST = "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))"
_TURN = "CASE WHEN (abs(a.heading-b.heading) % 360) > 180 THEN 360-(abs(a.heading-b.heading) % 360) ELSE abs(a.heading-b.heading) % 360 END"


@query("w6_context_features", f"""WITH {MSG_SQL},
seen AS (SELECT a.id, a.pseudo AS ap, a.sender AS asender, b.id AS bid, b.t AS bt, b.pseudo, b.sender FROM msg a JOIN msg b ON a.receiver = b.receiver AND b.t >= a.t - 21600 AND (b.t < a.t OR (b.t = a.t AND b.id < a.id))),
prior AS (SELECT id, ap, pseudo, arg_max(bid, struct_pack(t := bt, i := bid)) AS bid FROM seen GROUP BY id, ap, pseudo),
n AS (SELECT p.id, {_DIST} AS d, abs(a.speed-b.speed) AS ds, {_TURN} AS dh, b.id AS bid FROM prior p JOIN msg a ON a.id = p.id JOIN msg b ON b.id = p.bid WHERE p.pseudo <> p.ap),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, bid) AS rn FROM n WHERE d <= 30) WHERE rn <= 20),
s AS (SELECT id, count(*) AS n, min(d) AS min_d, list_sort(list(d)) AS ds_, avg(d) AS mean_d, stddev_pop(d) AS std_d, count(*) FILTER (d <= 5) AS n5, count(*) FILTER (d <= 10) AS n10, count(*) FILTER (d <= 20) AS n20, min(ds) AS min_ds,
 count(*) FILTER (ds <= 0.5) AS v5, count(*) FILTER (ds <= 1) AS v10, min(dh) AS min_dh, avg(dh) AS mean_dh, count(*) FILTER (dh <= 5) AS h5, count(*) FILTER (dh <= 10) AS h10, count(*) FILTER (d <= 10 AND ds <= 0.5 AND dh <= 10) AS sim FROM r GROUP BY id),
act AS (SELECT id, count(*) AS n_active FROM prior GROUP BY id),
o AS (SELECT id, count(DISTINCT pseudo) FILTER (pseudo <> ap) AS others, count(*) FILTER (changed) AS switches FROM (SELECT *, pseudo <> lag(pseudo) OVER (PARTITION BY id ORDER BY bt, bid) AS changed FROM seen WHERE sender = asender) GROUP BY id)
SELECT m.id, coalesce(n_active, 0)::BIGINT AS n_active_pseudos, coalesce(n, 0)::BIGINT AS n_neighbours, round(min_d, 5) AS min_distance, round(ds_[round_even(0.1*(n-1), 0)::INT+1], 5) AS p10_distance, round(mean_d, 4) AS mean_distance, round(CASE WHEN n > 1 THEN std_d END, 4) AS std_distance,
 coalesce(n5, 0)::BIGINT AS n_within_5, coalesce(n10, 0)::BIGINT AS n_within_10, coalesce(n20, 0)::BIGINT AS n_within_20, round(min_ds, 6) AS min_speed_diff, coalesce(v5, 0)::BIGINT AS n_speed_diff_0p5, coalesce(v10, 0)::BIGINT AS n_speed_diff_1p0,
 round(min_dh, 5) AS min_heading_diff, round(mean_dh, 4) AS mean_heading_diff, coalesce(h5, 0)::BIGINT AS n_heading_diff_5, coalesce(h10, 0)::BIGINT AS n_heading_diff_10, coalesce(sim, 0)::BIGINT AS n_similar, round(sim / n, 6) AS similar_ratio,
 (coalesce(others, 0) + 1)::BIGINT AS n_sender_pseudos, (coalesce(others, 0) > 0)::INT AS is_multi_pseudo, coalesce(switches, 0)::BIGINT AS n_pseudo_switches, (coalesce(n, 0) > 0)::INT AS has_neighbours, 1 AS avail_int, 'map=off,int=approx,kalman=off' AS feature_flags
FROM msg m LEFT JOIN s ON s.id = m.id LEFT JOIN act ON act.id = m.id LEFT JOIN o ON o.id = m.id""")  # fmt: skip
def w6_context_features(spark, sf):
    c = O.with_availability(O.neighbour_context(messages(spark, sf), "receiver", 6 * HOUR, 30.0))
    digits = {"min_distance": 5, "p10_distance": 5, "mean_distance": 4, "std_distance": 4, "min_speed_diff": 6, "min_heading_diff": 5, "mean_heading_diff": 4, "similar_ratio": 6}
    plain = ["n_active_pseudos", "n_neighbours", "n_within_5", "n_within_10", "n_within_20", "n_speed_diff_0p5", "n_speed_diff_1p0", "n_heading_diff_5", "n_heading_diff_10", "n_similar", "n_sender_pseudos", "is_multi_pseudo", "n_pseudo_switches", "has_neighbours", "avail_int", "feature_flags"]
    return c.select("id", *plain, *(F.round(k, d).alias(k) for k, d in digits.items()))


@query("w4_fresh_overlap", f"""WITH {MSG_SQL}, prior AS (SELECT a.id, b.pseudo, arg_max(b.id, struct_pack(t := b.t, i := b.id)) AS bid FROM msg a JOIN msg b ON a.receiver = b.receiver AND b.t >= a.t - 7200 AND b.pseudo <> a.pseudo AND (b.t < a.t OR (b.t = a.t AND b.id < a.id)) GROUP BY a.id, b.pseudo),
d AS (SELECT p.id, greatest(0.0, least(1.0, 1 - greatest(0.0, sqrt(29)+20-{_DIST})/(sqrt(29)+20))) AS s FROM prior p JOIN msg a ON a.id = p.id JOIN msg b ON b.id = p.bid)
SELECT m.id, count(d.s)::BIGINT AS n_fresh, round(min(d.s), 5) AS min_overlap_score, (count(*) FILTER (d.s < 0.5))::BIGINT AS n_violations FROM msg m LEFT JOIN d ON d.id = m.id GROUP BY m.id""")  # fmt: skip
def w4_fresh_overlap(spark, sf):
    f = O.fresh_overlap(messages(spark, sf), "receiver", 2 * HOUR)
    return f.select("id", "n_fresh", F.round("min_overlap_score", 5).alias("min_overlap_score"), "n_violations")


_SOFT = "CASE WHEN {v} <= -({t}) THEN 1.0 WHEN {v} >= {t} THEN 0.0 ELSE ({t} - {v}) / (2 * ({t})) END"


@query("k5_k24_kernels", f"""WITH {MSG_SQL}, p AS (SELECT *, lag(t) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(speed) OVER w AS pv FROM msg WINDOW w AS (PARTITION BY sender ORDER BY t, id)),
q AS (SELECT id, k_y AS y, x, speed, heading, pv, (t - pt) / 3600 AS dt, sqrt((x-px)*(x-px)+(y-py)*(y-py)) AS d, CASE WHEN id % 3 = 0 THEN 0 ELSE 2.5e0 END AS conf, CASE WHEN id % 2 = 0 THEN -speed * 6 ELSE speed * 6 END AS v FROM (SELECT *, y AS k_y FROM p)),
h AS (SELECT *, CASE WHEN dt > 0 THEN dt END AS sdt FROM q), z AS (SELECT *, d / sdt AS implied, 4 / sdt + 1 + 4 AS tol, greatest(speed, pv) + 8.5 * sdt AS up, greatest(least(speed, pv) - 7 * sdt, 0.0) AS down, abs(heading) * 1.2 AS off FROM h)
SELECT id, round(radians(heading * 3) - 2 * pi() * ceil((radians(heading * 3) - pi()) / (2 * pi())), 5) AS signed_angle, round(greatest(sqrt(conf * conf + x * x), 1e-3), 5) AS confidence,
 round(CASE WHEN abs(v) + greatest(conf, 1e-9) / 2 < 40 THEN 1.0 WHEN abs(v) - greatest(conf, 1e-9) / 2 > 40 THEN 0.0 ELSE greatest(0.0, least(1.0, (greatest(conf, 1e-9) / 2 + (40 - abs(v))) / greatest(conf, 1e-9))) END, 5) AS speed_score,
 round(CASE WHEN dt >= 3.1 THEN 1.0 WHEN dt > 0 THEN least({_SOFT.format(v='greatest(implied - up, 0.0)', t='tol')}, {_SOFT.format(v='greatest(down - implied, 0.0)', t='tol')}) END, 5) AS position_max_speed_score,
 CASE WHEN dt > 0 THEN CASE WHEN dt < 0.9 THEN 0.0 ELSE 1.0 END END AS frequency_score,
 round(CASE WHEN dt IS NULL OR dt <= 0 THEN NULL WHEN dt >= 1.1 OR d < 1 OR speed - 0.5 < 1 THEN 1.0 WHEN (CASE WHEN off % 360 > 180 THEN 360 - off % 360 ELSE off % 360 END) <= 95 THEN 1.0 ELSE greatest(0.0, least(1.0, 1 - ((CASE WHEN off % 360 > 180 THEN 360 - off % 360 ELSE off % 360 END) - 95) / 90)) END, 5) AS position_heading_score,
 round(CASE WHEN NOT (x < 30 AND (x < 6 OR (abs(heading) < 90 AND x < 3 / greatest(cos(radians(90 - abs(heading))), 1e-6)))) THEN 1.0 WHEN y < 4 THEN 1 - y / 4 ELSE 0.0 END, 5) AS proximity_score,
 CASE WHEN conf <= 0 THEN CASE WHEN 400 + x < 470 THEN 0.0 ELSE 1.0 END WHEN 400 + x >= 470 + conf THEN 1.0 WHEN 400 + x <= 470 - conf THEN 0.0 END AS appearance_edges FROM z""")  # fmt: skip
def k5_k24_kernels(spark, sf):
    m = O.with_previous(messages(spark, sf), ["sender"], ["t", "id"], ["x", "y", "speed"])
    dt, d = F.col("dt") / HOUR, K.distance(F.col("x"), F.col("y"), F.col("prev_x"), F.col("prev_y"))
    conf = F.when(F.col("id") % 3 == 0, 0.0).otherwise(2.5)
    v = F.when(F.col("id") % 2 == 0, -F.col("speed") * 6).otherwise(F.col("speed") * 6)
    far = 400 + F.col("x")
    inside = (conf <= 0) | (far >= 470 + conf) | (far <= 470 - conf)
    return rounded(
        m.select(
            "id", F.round(K.signed_angle(F.radians(F.col("heading") * 3)), 5).alias("signed_angle"), F.round(K.confidence(conf, F.col("x")), 5).alias("confidence"), K.speed_score(v, conf).alias("speed_score"),
            K.position_max_speed_score(d, F.col("speed"), F.col("prev_speed"), dt, F.lit(4.0), F.lit(1.0)).alias("position_max_speed_score"), K.frequency_score(dt).alias("frequency_score"),
            K.position_heading_score(d, F.col("heading") * 1.2, F.lit(0.0), F.col("speed"), dt, F.lit(0.5), F.lit(5.0)).alias("position_heading_score"), K.proximity_score(F.col("x"), F.col("heading"), F.array("y")).alias("proximity_score"),
            F.when(inside, K.appearance_score(far, conf, F.lit(50.0))).alias("appearance_edges"),
        ))


def _episodes(spark, sf):
    return O.sliding_episodes(messages(spark, sf), "receiver", 24 * HOUR, 12 * HOUR)


_KEYS = ["receiver", "window_no"]
_CSTD = "CASE WHEN count({h}) < 2 THEN 0.0 ELSE sqrt(avg(power({h} - {mu} - 2 * pi() * ceil(({h} - {mu} - pi()) / (2 * pi())), 2))) END"


@query("a4_ego_summary", _EP + f""", e AS (SELECT *, radians(heading) AS h FROM ep WHERE type = 2), c AS (SELECT receiver, window_no, atan2(sum(sin(h)), sum(cos(h))) AS mu FROM e GROUP BY ALL),
g AS (SELECT e.receiver, e.window_no, count(*) AS num_updates, sqrt(power(arg_max(x, t) - arg_min(x, t), 2) + power(arg_max(y, t) - arg_min(y, t), 2)) AS displacement, avg(speed) AS avg_speed, CASE WHEN count(*) > 1 THEN stddev_pop(speed) ELSE 0 END AS speed_std, any_value(mu) AS mu, {_CSTD.format(h='h', mu='mu')} AS heading_std FROM e JOIN c USING (receiver, window_no) GROUP BY e.receiver, e.window_no),
w AS (SELECT DISTINCT receiver, window_no FROM ep)
SELECT receiver, window_no, coalesce(num_updates, 0)::BIGINT AS num_updates, round(displacement, 4) AS displacement, round(avg_speed, 6) AS avg_speed, round(speed_std, 6) AS speed_std, round(mu, 5) AS avg_heading, round(heading_std, 5) AS heading_std FROM w LEFT JOIN g USING (receiver, window_no)""")  # fmt: skip
def a4_ego_summary(spark, sf):
    e = _episodes(spark, sf)
    s = E.with_ego(E.ego_summary(e.where("type = 2"), _KEYS, ["t", "id"]), e.select(*_KEYS).distinct(), _KEYS)
    r = lambda c, n: F.round(c, n).alias(c)
    return s.select(*_KEYS, "num_updates", r("displacement", 4), r("avg_speed", 6), r("speed_std", 6), r("avg_heading", 5), r("heading_std", 5))


_TRACKS = f""", l AS (SELECT *, radians(heading) AS h, t - lag(t) OVER (PARTITION BY receiver, window_no, pseudo ORDER BY t, id) AS iat FROM ep), hm AS (SELECT receiver, window_no, pseudo, atan2(sum(sin(h)), sum(cos(h))) AS mu FROM l GROUP BY ALL),
tr AS (SELECT receiver, window_no, pseudo, count(*) AS num_msgs, min(t) AS first_t, max(t) AS last_t, avg(x) AS mx, avg(y) AS my, avg(speed) AS mv, (max(t) - min(t)) / 86400 AS life, CASE WHEN max(t) > min(t) THEN count(*) / (max(t) - min(t)) END AS rate, any_value(mu) AS mu, {_CSTD.format(h='h', mu='mu')} AS heading_std,
 coalesce(avg(iat), 0) AS mean_iat, CASE WHEN count(iat) > 1 THEN stddev_pop(iat) ELSE 0 END AS iat_std, sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2)) AS pos_spread, min(speed) AS min_speed, max(speed) AS max_speed FROM l JOIN hm USING (receiver, window_no, pseudo) GROUP BY receiver, window_no, pseudo)"""


@query("a5_track_features", _EP + _TRACKS + """ SELECT receiver, window_no, pseudo, num_msgs::BIGINT AS num_msgs, round(mean_iat, 3) AS mean_iat, round(iat_std, 3) AS iat_std, round(pos_spread, 4) AS pos_spread, round(min_speed, 6) AS min_speed, round(max_speed, 6) AS max_speed, round(mu, 5) AS avg_heading, round(heading_std, 5) AS heading_std FROM tr""")
def a5_track_features(spark, sf):
    t = E.tracks(_episodes(spark, sf), _KEYS, 24 * HOUR)
    r = lambda c, n: F.round(c, n).alias(c)
    return t.select(*_KEYS, "pseudo", "num_msgs", r("mean_iat", 3), r("iat_std", 3), r("pos_spread", 4), r("min_speed", 6), r("max_speed", 6), r("avg_heading", 5), r("heading_std", 5))


_REGION = """, rg AS (SELECT receiver, window_no, count(*) AS num_bsms, count(DISTINCT sender) AS senders, avg(speed) AS avg_speed, min(speed) AS lo, max(speed) AS hi, avg((speed >= 0 AND speed < 2)::INT) AS slow, avg((speed >= 2 AND speed < 8)::INT) AS medium, avg((speed >= 8)::INT) AS fast FROM ep GROUP BY ALL),
tg AS (SELECT receiver, window_no, count(*) AS pseudos, avg((num_msgs = 1)::INT) AS single, avg((life < 0.3)::INT) AS short FROM tr GROUP BY ALL)"""


@query("a6_region_summary", _EP + _TRACKS + _REGION + """ SELECT receiver, window_no, num_bsms::BIGINT AS num_bsms, pseudos::BIGINT AS num_unique_pseudos, senders::BIGINT AS num_unique_senders, round(avg_speed, 9) AS avg_speed, round(lo, 9) AS min_speed, round(hi, 9) AS max_speed, round(slow, 5) AS slow_msg_fraction, round(medium, 5) AS medium_msg_fraction, round(fast, 5) AS fast_msg_fraction, round(single, 5) AS single_message_pseudo_fraction, round(short, 5) AS short_lived_pseudo_fraction FROM rg JOIN tg USING (receiver, window_no)""")
def a6_region_summary(spark, sf):
    e = _episodes(spark, sf)
    r = E.region(e, E.tracks(e, _KEYS, 24 * HOUR), _KEYS).drop("median_speed", "speed_std")
    return r.select(*(F.round(c, 9 if c.endswith("speed") else 5).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes))


_GROUPS = _TRACKS + """, pr AS (SELECT a.receiver, a.window_no, a.pseudo AS p, b.pseudo AS q FROM tr a JOIN tr b ON a.receiver = b.receiver AND a.window_no = b.window_no AND a.pseudo <> b.pseudo AND sqrt((a.mx-b.mx)*(a.mx-b.mx)+(a.my-b.my)*(a.my-b.my)) < 12 AND abs(a.mv - b.mv) < 1
  AND CASE WHEN greatest(a.last_t, b.last_t) > least(a.first_t, b.first_t) THEN greatest(least(a.last_t, b.last_t) - greatest(a.first_t, b.first_t), 0) / (greatest(a.last_t, b.last_t) - least(a.first_t, b.first_t)) ELSE 0 END > 0.2),
reach AS (SELECT receiver, window_no, pseudo AS p, pseudo AS q FROM tr UNION SELECT r.receiver, r.window_no, r.p, pr.q FROM reach r JOIN pr ON pr.receiver = r.receiver AND pr.window_no = r.window_no AND pr.p = r.q),
root AS (SELECT receiver, window_no, p AS pseudo, min(q) AS root FROM reach GROUP BY ALL), sz AS (SELECT receiver, window_no, root, count(*) AS size, sum(num_msgs) AS msgs FROM root JOIN tr USING (receiver, window_no, pseudo) GROUP BY ALL),
gi AS (SELECT *, 'G' || row_number() OVER (PARTITION BY receiver, window_no ORDER BY size DESC, msgs DESC, root) AS group_id FROM sz), cl AS (SELECT tr.*, group_id, size FROM tr JOIN root USING (receiver, window_no, pseudo) JOIN gi USING (receiver, window_no, root))"""
_EPR = _EP.replace("WITH ", "WITH RECURSIVE ", 1)


def _clustered(spark, sf):
    e = _episodes(spark, sf)
    t = E.tracks(e, _KEYS, 24 * HOUR)
    c = O.cluster_tracks(t, _KEYS, near=12.0, speed=1.0, overlap=0.2)
    return e, t, t.join(c, [*_KEYS, "pseudo"])


@query("j7_track_groups", _EPR + _GROUPS + """ SELECT receiver, window_no, pseudo, group_id, size::BIGINT AS group_size FROM cl""")
def j7_track_groups(spark, sf):
    return _clustered(spark, sf)[2].select(*_KEYS, "pseudo", "group_id", "group_size")


_GSUM = _GROUPS + f""", gm AS (SELECT receiver, window_no, group_id, avg(mx) AS gx, avg(my) AS gy, atan2(sum(sin(mu)), sum(cos(mu))) AS gmu FROM cl GROUP BY ALL),
gs AS (SELECT receiver, window_no, group_id, count(*) AS size, sum(num_msgs) AS total_msgs, avg(mv) AS avg_speed, CASE WHEN count(*) > 1 THEN stddev_pop(mv) ELSE 0 END / (avg(mv) + 1e-9) AS speed_cv, max(sqrt((mx-gx)*(mx-gx)+(my-gy)*(my-gy))) AS radius, max(last_t) - min(first_t) AS duration,
 sqrt(power(max(mx) - min(mx), 2) + power(max(my) - min(my), 2)) AS pos_spread, {_CSTD.format(h='mu', mu='gmu')} AS heading_std, CASE WHEN count(rate) > 0 THEN CASE WHEN count(rate) > 1 THEN stddev_pop(rate) ELSE 0 END / (avg(rate) + 1e-9) ELSE 0 END AS rate_cv, any_value(gx) AS gx, any_value(gy) AS gy FROM cl JOIN gm USING (receiver, window_no, group_id) GROUP BY ALL)"""


@query("a7_group_summary", _EPR + _GSUM + """, eg AS (SELECT receiver, window_no, arg_max(x, t) AS ex, arg_max(y, t) AS ey FROM ep WHERE type = 2 GROUP BY receiver, window_no)
SELECT receiver, window_no, group_id, size::BIGINT AS size, total_msgs::BIGINT AS total_msgs, round(gx, 4) AS gx, round(gy, 4) AS gy, round(avg_speed, 6) AS avg_speed, round(speed_cv, 6) AS speed_cv, round(pos_spread, 4) AS pos_spread, round(radius, 4) AS radius, round(size / (radius + 1), 5) AS density_proxy,
 round(duration, 3) AS duration, round(duration / 86400, 6) AS lifetime_fraction, round(heading_std, 5) AS heading_std, round(rate_cv, 5) AS msg_rate_cv, round(sqrt((gx-ex)*(gx-ex)+(gy-ey)*(gy-ey)), 4) AS distance_to_ego FROM gs LEFT JOIN eg USING (receiver, window_no)""")  # fmt: skip
def a7_group_summary(spark, sf):
    e, _, c = _clustered(spark, sf)
    ego = e.where("type = 2").groupBy(*_KEYS).agg(F.max_by("x", F.struct("t", "id")).alias("ego_x"), F.max_by("y", F.struct("t", "id")).alias("ego_y"))
    g = E.groups(c, _KEYS, 24 * HOUR, ego)
    digits = {"gx": 4, "gy": 4, "avg_speed": 6, "speed_cv": 6, "pos_spread": 4, "radius": 4, "density_proxy": 5, "duration": 3, "lifetime_fraction": 6, "heading_std": 5, "msg_rate_cv": 5, "distance_to_ego": 4}
    return g.select(*_KEYS, "group_id", "size", "total_msgs", *(F.round(k, d).alias(k) for k, d in digits.items()))


@query("a8_congestion", _EPR + _GSUM + _REGION + """, lw AS (SELECT receiver, window_no, count(*) AS num_groups, count(*) FILTER (size > 1) AS multi, max(size) AS largest, max(size) FILTER (avg_speed < 2) AS low_size, arg_max(total_msgs, size * 1000000 + total_msgs) FILTER (avg_speed < 2) AS low_msgs, sum(total_msgs) FILTER (avg_speed < 2) AS msgs, sum(size) FILTER (avg_speed < 2) AS ps FROM gs GROUP BY receiver, window_no)
SELECT receiver, window_no, CASE WHEN slow > 0.6 THEN 'high' WHEN slow > 0.3 THEN 'medium' ELSE 'low' END AS congestion_level, round(slow, 5) AS low_speed_fraction, num_groups::BIGINT AS num_groups, multi::BIGINT AS num_multi_id_groups, largest::BIGINT AS largest_group_size, coalesce(low_size, 0)::BIGINT AS largest_low_speed_group_size,
 coalesce(low_msgs, 0)::BIGINT AS largest_low_speed_group_msgs, round(coalesce(msgs, 0) / num_bsms, 5) AS fraction_msgs_in_low_speed_groups, round(coalesce(ps, 0) / pseudos, 5) AS fraction_pseudos_in_low_speed_groups FROM lw JOIN rg USING (receiver, window_no) JOIN tg USING (receiver, window_no)""")  # fmt: skip
def a8_congestion(spark, sf):
    e, t, c = _clustered(spark, sf)
    g = E.congestion(E.groups(c, _KEYS, 24 * HOUR), E.region(e, t, _KEYS), _KEYS).drop("largest_low_speed_group_avg_speed")
    return g.select(*(F.round(k, 5).alias(k) if kind == "double" else F.col(k) for k, kind in g.dtypes))


@query("a9_identity", _EP + """, s AS (SELECT receiver, window_no, sender, max((flag <> 0)::INT) AS bad, 's' || row_number() OVER (PARTITION BY receiver, window_no ORDER BY sender) AS lid FROM ep GROUP BY receiver, window_no, sender), p AS (SELECT receiver, window_no, pseudo, max((flag <> 0)::INT) AS bad, 'p' || row_number() OVER (PARTITION BY receiver, window_no ORDER BY pseudo) AS lid FROM ep GROUP BY receiver, window_no, pseudo),
m AS (SELECT receiver, window_no, avg((flag <> 0)::INT) AS share, max((flag <> 0)::INT) = 1 AS anyone FROM ep GROUP BY receiver, window_no), sa AS (SELECT receiver, window_no, sum(bad) AS k, avg(bad) AS share, string_agg(lid, ',' ORDER BY sender) FILTER (bad = 1) AS ids, string_agg(lid, ',' ORDER BY sender) FILTER (bad = 0) AS good FROM s GROUP BY receiver, window_no),
pa AS (SELECT receiver, window_no, sum(bad) AS k, avg(bad) AS share, string_agg(lid, ',' ORDER BY pseudo) FILTER (bad = 1) AS ids FROM p GROUP BY receiver, window_no)
SELECT receiver, window_no, anyone AS contains_attacker_message, round(m.share, 6) AS attacker_message_fraction, sa.k::BIGINT AS num_attacker_senders, pa.k::BIGINT AS num_attacker_pseudos, round(sa.share, 6) AS attacker_sender_fraction, round(pa.share, 6) AS attacker_pseudo_fraction, coalesce(sa.ids, '') AS attacker_senders, coalesce(sa.good, '') AS benign_senders, coalesce(pa.ids, '') AS attacker_pseudos
FROM m JOIN sa USING (receiver, window_no) JOIN pa USING (receiver, window_no)""")  # fmt: skip
def a9_identity(spark, sf):
    i = E.identity(_episodes(spark, sf), _KEYS)
    r = lambda c: F.round(c, 6).alias(c)
    return i.select(*_KEYS, "contains_attacker_message", r("attacker_message_fraction"), "num_attacker_senders", "num_attacker_pseudos", r("attacker_sender_fraction"), r("attacker_pseudo_fraction"), F.array_join("attacker_sender_local_ids", ",").alias("attacker_senders"),
        F.array_join("benign_sender_local_ids", ",").alias("benign_senders"), F.array_join("attacker_pseudo_local_ids", ",").alias("attacker_pseudos"))


@query("a9_group_labels", _EPR + _GROUPS + """, bad_p AS (SELECT receiver, window_no, pseudo, max((flag <> 0)::INT) AS bad, 'p' || row_number() OVER (PARTITION BY receiver, window_no ORDER BY pseudo) AS lid FROM ep GROUP BY receiver, window_no, pseudo)
SELECT receiver, window_no, group_id, (sum(bad) > 0) AS contains_attacker_pseudo, sum(bad)::BIGINT AS num_attacker_pseudos, round(avg(bad), 6) AS attacker_pseudo_fraction, string_agg(lid, ',' ORDER BY pseudo) AS ids FROM cl JOIN bad_p USING (receiver, window_no, pseudo) GROUP BY receiver, window_no, group_id""")
def a9_group_labels(spark, sf):
    e, _, c = _clustered(spark, sf)
    g = E.group_labels(c, e, _KEYS)
    return g.select(*_KEYS, "group_id", "contains_attacker_pseudo", "num_attacker_pseudos", F.round("attacker_pseudo_fraction", 6).alias("attacker_pseudo_fraction"), F.array_join("pseudo_local_ids", ",").alias("ids"))


@query("m1_positive_thresholds", f"""WITH {MSG_SQL}, v AS (SELECT y - 40 AS v, flag FROM msg), p AS (SELECT v, row_number() OVER (ORDER BY v) AS rn, count(*) OVER () AS n FROM v WHERE v > 0), g AS (SELECT count(*) AS n, count(*) FILTER (flag <> 0) AS n1 FROM v),
c AS (SELECT q::DOUBLE AS q, v AS thr, 'ge' AS op FROM p, (VALUES (0.5), (0.8), (0.9)) w(q) WHERE rn = round_even(q * (n - 1), 0) + 1 UNION ALL SELECT NULL, 0, 'gt'),
e AS (SELECT q, thr, op, count(*) AS h, count(*) FILTER (flag <> 0) AS h1 FROM c JOIN v ON (op = 'ge' AND v >= thr) OR (op = 'gt' AND v > thr) GROUP BY q, thr, op)
SELECT q, round(thr, 6) AS threshold, op, round(h / n, 6) AS support, round(abs(h1 / n1 - (h - h1) / (n - n1)), 6) AS gap FROM e, g""")  # fmt: skip
def m1_positive_thresholds(spark, sf):
    m = messages(spark, sf).withColumn("v", F.col("y") - 40)
    return rounded(O.mine_thresholds(m, "v", "flag", [0.5, 0.8, 0.9], "ge", positive=True).drop("score"), 6)


@query("m3_fitted_hits", f"""WITH {MSG_SQL}, r AS (SELECT x, flag, row_number() OVER (ORDER BY x) AS rn, count(*) OVER () AS n FROM msg WHERE t >= 1704067200 AND t < 1705363200), g AS (SELECT count(*) AS n, count(*) FILTER (flag <> 0) AS n1 FROM r),
c AS (SELECT q, x AS thr FROM r, (VALUES (0.05), (0.1), (0.2), (0.3)) v(q) WHERE rn = round_even(q * (n - 1), 0) + 1), e AS (SELECT q, thr, count(*) AS h, count(*) FILTER (flag <> 0) AS h1 FROM c JOIN r ON x <= thr GROUP BY q, thr),
s AS (SELECT q, thr, h / n AS support, abs(h1 / n1 - (h - h1) / (n - n1)) AS gap FROM e, g), k AS (SELECT *, gap * sqrt(greatest(support, 1e-12)) AS score, (support >= 0.05 AND gap >= 0.10) AS fit FROM s),
t1 AS (SELECT thr FROM k WHERE fit OR NOT EXISTS (SELECT 1 FROM k WHERE fit) ORDER BY score DESC, support DESC, q LIMIT 1)
SELECT sender, (count(*) FILTER (x <= thr))::BIGINT AS hits, count(*)::BIGINT AS n FROM msg, t1 GROUP BY sender""")  # fmt: skip
def m3_fitted_hits(spark, sf):
    m = messages(spark, sf)
    t1 = O.fit_thresholds(m, [(1704067200.0, 1705363200.0)], "flag", {"x": [0.05, 0.1, 0.2, 0.3]}, {})["x"]["t1"]
    return m.groupBy("sender").agg(F.sum(O.hit(F.col("x"), t1["op"], t1["threshold"]).cast("long")).alias("hits"), F.count(F.lit(1)).alias("n"))


_PARTS = "(SELECT *, unnest(['all', 'label=' || (l_linenumber % 2)]) AS part FROM lineitem)"
_REC = {"l_discount": "l_discount", "l_tax": "l_tax", "l_none": "CASE WHEN l_quantity < 0 THEN 1.0 END", "l_one": "CASE WHEN l_quantity < 1000 THEN 1.0 END"}


@query("a20_recommendation", "WITH a AS (" + " UNION ALL ".join(f"SELECT '{n}' AS f, part, avg(({x} IS NULL)::INT) AS nulls, avg({x}) AS mean, avg(({x} = 1)::INT) AS eq1, avg(({x} <= 0.9)::INT) AS le9, avg(({x} <= 0.8)::INT) AS le8 FROM {_PARTS} GROUP BY part" for n, x in _REC.items()) + """),
j AS (SELECT g.f, g.nulls, g.eq1, abs(coalesce(b.le9, 0) - coalesce(a.le9, 0)) AS g9, abs(coalesce(b.le8, 0) - coalesce(a.le8, 0)) AS g8, abs(coalesce(b.mean, 0) - coalesce(a.mean, 0)) AS gm FROM a g LEFT JOIN a ON a.f = g.f AND a.part = 'label=0' LEFT JOIN a b ON b.f = g.f AND b.part = 'label=1' WHERE g.part = 'all')
SELECT f AS feature, CASE WHEN nulls = 1 THEN 'drop_candidate_all_null' WHEN nulls >= 0.95 THEN 'drop_candidate_extremely_sparse' WHEN eq1 >= 0.98 AND g9 < 0.01 THEN 'drop_candidate_near_constant_1' WHEN g8 >= 0.03 OR g9 >= 0.05 THEN 'keep_candidate_tail_separation' WHEN gm >= 0.02 THEN 'keep_candidate_mean_gap' ELSE 'review_candidate_weak_signal' END AS recommendation FROM j""")  # fmt: skip
def a20_recommendation(spark, sf):
    li = load(spark, sf, "lineitem").withColumns({"l_none": F.when(F.col("l_quantity") < 0, 1.0), "l_one": F.when(F.col("l_quantity") < 1000, 1.0), "y": F.col("l_linenumber") % 2})
    return M.recommend(M.audit(li, list(_REC), "y"))


@query("a11_micro_counts", """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R') AS g, bool_or(l_discount > 0.05) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT (count(*) FILTER (g AND p))::BIGINT AS tp, (count(*) FILTER (NOT g AND p))::BIGINT AS fp, (count(*) FILTER (g AND NOT p))::BIGINT AS fn, (count(*) FILTER (NOT g AND NOT p))::BIGINT AS tn FROM l""")
def a11_micro_counts(spark, sf):
    ids = lambda cond: F.collect_set(F.when(cond, F.col("l_linenumber")))
    o = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("cands"), ids(F.col("l_returnflag") == "R").alias("gold"), ids(F.col("l_discount") > 0.05).alias("pred"))
    return M.micro_counts(o, [], "cands", "gold", "pred").select("tp", "fp", "fn", "tn")


@query("a24_split_statistics", """WITH o AS (SELECT l_orderkey, l_orderkey % 3 AS split, l_orderkey % 7 AS run, count(DISTINCT l_linenumber) AS n, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_linenumber END) AS k FROM lineitem GROUP BY l_orderkey)
SELECT split, run, count(*)::BIGINT AS n, round(avg((k = 0)::INT), 6) AS empty_fraction, round(avg(n), 6) AS mean_candidates, round(avg(k), 6) AS mean_attackers, max(n)::INT AS most_candidates FROM o GROUP BY split, run""")
def a24_split_statistics(spark, sf):
    o = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linenumber").alias("c"), F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber"))).alias("a"))
    o = o.withColumns({"split": F.col("l_orderkey") % 3, "run": F.col("l_orderkey") % 7})
    return rounded(sinks.split_statistics(o, ["split", "run"], F.col("c"), F.col("a")), 6)


@query("a25_length_summary", """SELECT CASE WHEN n_chars <= 1000 THEN 'short' ELSE 'long' END AS kind, count(*)::BIGINT AS n, round(avg(n_chars), 4) AS mean, max(n_chars)::BIGINT AS longest, round(avg((n_chars > 2000)::INT), 6) AS over_2000, round(avg((n_chars > 8000)::INT), 6) AS over_8000, sum(least(n_chars, 2000))::BIGINT AS kept_at_2000, sum(least(n_chars, 8000))::BIGINT AS kept_at_8000,
 round(quantile_cont(n_chars, 0.25), 4) AS q25, round(quantile_cont(n_chars, 0.5), 4) AS q50, round(quantile_cont(n_chars, 0.95), 4) AS q95, round(quantile_cont(n_chars, 0.99), 4) AS q99 FROM documents GROUP BY 1""")
def a25_length_summary(spark, sf):
    d = load(spark, sf, "documents").select(F.when(F.col("n_chars") <= 1000, "short").otherwise("long").alias("kind"), F.col("n_chars").cast("long").alias("n_chars"))
    out = M.lengths(d, ["kind"], "n_chars", [2000, 8000], {"q25": 0.25, "q50": 0.5, "q95": 0.95, "q99": 0.99})
    return out.select(*(F.round(c, 6 if c.startswith("over") else 4).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query("a26_a28_table_statistics", """SELECT l_returnflag AS split, l_linestatus AS label, count(*)::BIGINT AS n, round(avg(l_quantity), 9) AS mean_quantity, round(1000.0::DOUBLE * sum(l_tax) / count(*), 5) AS ms_per_sample, round(count(*) / sum(l_tax), 5) AS samples_per_s FROM lineitem GROUP BY 1, 2""")
def a26_a28_table_statistics(spark, sf):
    g = load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("split"), F.col("l_linestatus").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 9).alias("mean_quantity"), F.sum("l_tax").alias("wall"))
    return M.throughput(g, "wall", "n").select("split", "label", "n", "mean_quantity", F.round("ms_per_sample", 5).alias("ms_per_sample"), F.round("samples_per_s", 5).alias("samples_per_s"))


@query("j4_attack_flags", f"""WITH {MSG_SQL}, f AS (SELECT sender % 50 AS vid, max(flag) AS flag FROM msg GROUP BY 1) SELECT sender % 50 AS vid, any_value(f.flag) AS attack_flag, count(*)::BIGINT AS n, (count(*) FILTER (type = 2))::BIGINT AS own FROM msg JOIN f ON f.vid = sender % 50 GROUP BY 1""")
def j4_attack_flags(spark, sf):
    m = messages(spark, sf).withColumn("vid", F.col("sender") % 50)
    flags = L.attack_flags(m.select("vid", F.col("flag").alias("attack_flag")), ["vid"], "attack_flag")
    own, got = L.by_type(m)
    n = m.join(flags, "vid").groupBy("vid").agg(F.max("attack_flag").alias("attack_flag"), F.count(F.lit(1)).alias("n"))
    return n.join(own.groupBy("vid").agg(F.count(F.lit(1)).alias("own")), "vid", "left").select("vid", "attack_flag", "n", F.coalesce("own", F.lit(0)).alias("own"))


@query("j5_run_labels", f"""WITH {MSG_SQL}, r AS (SELECT *, receiver % 4 AS run FROM msg), f AS (SELECT run, sender, max(flag) AS flag FROM r WHERE sender % 2 = 0 GROUP BY run, sender)
SELECT r.run, CASE WHEN coalesce(f.flag, 0) = 16 THEN 1 ELSE 0 END AS label, count(*)::BIGINT AS n FROM r LEFT JOIN f ON f.run = r.run AND f.sender = r.sender GROUP BY 1, 2""")
def j5_run_labels(spark, sf):
    m = messages(spark, sf).withColumn("run", F.col("receiver") % 4)
    flags = L.attack_flags(m.where("sender % 2 = 0").select("run", "sender", F.col("flag").alias("attack_flag")), ["run", "sender"], "attack_flag")
    return L.label_senders(m, flags, ["run", "sender"], rule="equals", n=16).groupBy("run", "label").agg(F.count(F.lit(1)).alias("n"))


@query("src4_ground_truth", """WITH t AS (SELECT event_id AS line_idx, user_id % 20 AS pseudo, user_id % 9 AS sender FROM events WHERE event_type = 'purchase'), l AS (SELECT pseudo, arg_max(sender, line_idx) AS sender FROM t GROUP BY pseudo)
SELECT pseudo AS "senderPseudo", sender, count(*) OVER (PARTITION BY sender)::BIGINT AS n_pseudos FROM l""")
def src4_ground_truth(spark, sf):
    e = load(spark, sf, "events").select(F.col("event_id").alias("line_idx"), (F.col("user_id") % 20).alias("senderPseudo"), (F.col("user_id") % 9).alias("sender"), F.when(F.col("event_type") == "purchase", 4).otherwise(3).alias("type"))
    return L.ground_truth(e)


@query("src16_file_names", """SELECT o_orderkey AS k, o_orderkey::BIGINT AS vehicle_id, (o_custkey + 7)::BIGINT AS node_id, (o_orderkey % 17)::BIGINT AS attack_flag, 25200::BIGINT AS start_sec, (o_orderkey % 5)::BIGINT AS run_no, 'grid_run' || (o_orderkey % 5) AS run_stem FROM orders""")
def src16_file_names(spark, sf):
    k = F.col("o_orderkey").cast("string")
    name = F.concat(F.lit("/data/grid/run"), F.col("o_orderkey") % 5, F.lit("/traceJSON-"), k, F.lit("-"), (F.col("o_custkey") + 7).cast("string"), F.lit("-A"), (F.col("o_orderkey") % 17).cast("string"), F.lit("-25200-"), (F.col("o_orderkey") % 5).cast("string"))
    o = load(spark, sf, "orders").select("o_orderkey", name.alias("path"))
    strict, plain = L.file_metadata(F.concat("path", F.lit(".json"))), L.plain_metadata(F.concat("path", F.lit(".jsonl")))
    stem = L.run_stem(F.concat_ws("/", F.element_at(F.split("path", "/"), -3), F.element_at(F.split("path", "/"), -2)))
    return o.select(F.col("o_orderkey").alias("k"), *(F.when(strict[c] == plain[c], strict[c]).alias(c) for c in strict), stem.alias("run_stem"))


@query("src22_shard_logs", """SELECT doc_id AS id, 'm_atk_seed' || (doc_id % 4) AS lora_dir, (doc_id % 8)::INT AS shard_index, CASE WHEN doc_id % 3 > 0 THEN n_chars::BIGINT END AS n_samples, CASE WHEN doc_id % 3 > 0 THEN doc_id + 0.5::DOUBLE END AS wall_s, CASE WHEN doc_id % 2 = 0 THEN doc_id::DOUBLE END AS tp, 'atk' AS attack, (doc_id % 4)::BIGINT AS seed FROM documents""")
def src22_shard_logs(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).cast("string").alias("n"))
    i = F.col("doc_id")
    progress = F.when(i % 3 > 0, F.concat(F.lit("\nprogress "), "n", F.lit("/"), "n", F.lit(" elapsed="), i, F.lit(".5\nprogress 1/2 elapsed=9999"))).otherwise("\nprogress 3/9 elapsed=1.5")
    metrics = F.when(i % 2 == 0, F.concat(F.lit('\nMETRICS_JSON: {"tp": '), i, F.lit("}"))).otherwise("")
    log = F.concat(F.lit("start\nLORA_DIR=m_atk_seed"), i % 4, F.lit("\nSHARD_INDEX="), i % 8, F.lit("\nprogress 7/7 elapsed=0.1"), progress, metrics)
    got = specs.shard_logs(d.select(i.cast("string").alias("path"), F.when(i % 3 > 0, log).otherwise(F.replace(log, F.lit("progress 7/7 elapsed=0.1"), F.lit("warming up"))).alias("value")))
    m = specs.model_of(F.col("lora_dir"))
    return got.select(F.col("path").cast("long").alias("id"), "lora_dir", "shard_index", "n_samples", "wall_s", F.col("metrics")["tp"].alias("tp"), m["attack"].alias("attack"), m["seed"].alias("seed"))


@query("src23_training_curve", """SELECT doc_id / 100.0::DOUBLE AS epoch, round_even(doc_id / 100.0::DOUBLE * 50, 0)::BIGINT AS step, CASE WHEN doc_id % 5 = 0 THEN 'eval' ELSE 'train' END AS kind, round(1.0::DOUBLE / (doc_id + 1), 9) AS loss FROM documents WHERE doc_id % 2 = 1 OR doc_id % 5 = 0""")
def src23_training_curve(spark, sf):
    i = F.col("doc_id")
    loss = F.format_string("%.12f", 1.0 / (i + 1))
    line = F.when(i % 5 == 0, F.concat(F.lit("{'eval_loss': '"), loss, F.lit("', 'epoch': '"), i / 100.0, F.lit("'}"))).when(i % 2 == 1, F.concat(F.lit("noise {'loss': "), loss, F.lit(", 'epoch': "), i / 100.0, F.lit("}"))).otherwise("saving checkpoint")
    c = specs.training_curve(load(spark, sf, "documents").select(line.alias("value")), 50)
    return c.select("epoch", "step", "kind", F.round("loss", 9).alias("loss"))


@query("f6_row_logs", """SELECT CASE WHEN user_id % 3 > 0 THEN user_id % 3 END AS run, count(*)::BIGINT AS n, sum((user_id % 2))::BIGINT AS gold, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS pred, (count(*) FILTER (event_type IN ('click', 'view')))::BIGINT AS counted, min('ep_' || (user_id % 3)) AS stem FROM events WHERE user_id % 3 <> 2 GROUP BY 1""")
def f6_row_logs(spark, sf):
    e = load(spark, sf, "events").select(F.when(F.col("user_id") % 3 > 0, (F.col("user_id") % 3).cast("string")).alias("run_id"), F.lit("m").alias("model_tag"), F.lit("test").alias("split"), F.concat(F.lit("ep/"), F.col("user_id") % 3).alias("episode_id"),
        (F.col("user_id") % 2).alias("label"), F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 0).alias("pred_label"))
    r = L.row_logs(e, run_id="1", model="m", split="test")
    return r.groupBy(F.col("run_id").cast("long").alias("run")).agg(F.count(F.lit(1)).alias("n"), F.sum("gold_label").alias("gold"), F.sum("pred_is_attack").alias("pred"), F.sum("is_counted").alias("counted"), F.min("run_stem").alias("stem"))


@query("f12_k21_ids_and_scalars", """SELECT o_orderkey AS k, 'p' || (o_orderkey % 9) || ',p10,p' || (100 + o_orderkey % 3) AS ids, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 4 = 0 THEN trunc(o_totalprice)::BIGINT END AS whole, CASE WHEN o_orderkey % 4 IN (0, 2) THEN 1 ELSE 0 END AS flag, (o_orderkey % 4 = 0 AND trunc(o_totalprice) <> 0) OR o_orderkey % 4 = 2 AS is_attack, CASE WHEN o_orderstatus = 'F' THEN 'peak' WHEN o_orderstatus = 'O' THEN 'off_peak' ELSE 'unknown' END AS regime, CASE WHEN o_orderstatus = 'F' THEN 'grid' ELSE 'other' END AS family FROM orders""")
def f12_k21_ids_and_scalars(spark, sf):
    i = F.col("o_orderkey")
    ids = F.array(F.concat(F.lit(" P"), 100 + i % 3), F.concat(F.lit("p"), i % 9, F.lit(" ")), F.lit("p10"), F.lit("P10"), F.lit("x3"), F.lit("p"))
    text = F.when(i % 4 == 0, F.format_string("%.2f", F.col("o_totalprice"))).when(i % 4 == 1, "NaN").when(i % 4 == 2, "Attack").otherwise("")
    kind = F.when(F.col("o_orderstatus") == "F", "GridSybil_0709").when(F.col("o_orderstatus") == "O", "DoS_1416").otherwise("x")
    flag = F.when(i % 4 == 1, 0).otherwise(C.flag01(text))
    return load(spark, sf, "orders").select(i.alias("k"), F.array_join(C.pseudo_ids(ids), ",").alias("ids"), C.finite(text).alias("price"), C.whole(text).alias("whole"), flag.alias("flag"), C.is_attack_label(text).alias("is_attack"), K.regime(kind).alias("regime"), K.family(kind, ["grid"]).alias("family"))


@query("t8_number_formats", """SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, format('{:.3f}', l_quantity) AS fixed, CASE WHEN l_tax >= 0.01 THEN format('{:.2f}', l_extendedprice) ELSE format('{:.2e}', l_tax / 8) END AS magnitude, CASE WHEN l_tax = 0 THEN '0' WHEN l_tax < 0.01 THEN format('{:.2e}', l_tax) ELSE format('{:.2f}', l_tax) END AS signal, '[' || format('{:.1f}', l_quantity) || ',' || format('{:.1f}', l_quantity * 2) || ']' AS pair, CASE WHEN l_quantity <= 10 THEN '<=10' WHEN l_quantity <= 20 THEN '11-20' WHEN l_quantity <= 40 THEN '21-40' ELSE '>40' END AS shown FROM lineitem""")
def t8_number_formats(spark, sf):
    q, tax = F.col("l_quantity"), F.col("l_tax")
    m = F.when(tax >= 0.01, T.magnitude(F.col("l_extendedprice"), 2)).otherwise(T.magnitude(tax / 8))
    return load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), T.scalar(q, "double").alias("fixed"), m.alias("magnitude"), T.signal(tax).alias("signal"), T.pair(F.array(q, q * 2)).alias("pair"), B.shown_bin(q).alias("shown"))


_VARIANT_SQL = " UNION ALL ".join(
    f"SELECT id, '{v}' AS variant, {' || chr(10) || '.join(repr(x) for x in lines)} || chr(10) || '[Checks]' || chr(10) || '- msg catch art: ' || format('{{:.3f}}', x) || chr(10) || '[Neighbours]' || chr(10) || {repr('(' + hints['Neighbours'] + ')') + ' || chr(10) || ' if 'Neighbours' in hints else ''}'- ctx n neighbors: ' || sender || chr(10) || "
    f"'[Sender history: overlap]' || chr(10) || {repr('(' + hints['Sender history'] + ')') + ' || chr(10) || ' if 'Sender history' in hints else ''}'- ctx recentk min int min neighbor: ' || format('{{:.3f}}', y) || chr(10) || '[Timing]' || chr(10) || {repr('(' + hints['Timing'] + ')') + ' || chr(10) || ' if 'Timing' in hints else ''}'- type: ' || type || chr(10) || 'Answer:' AS prompt FROM msg"
    for v, (lines, hints) in ((v, (tuple(x.replace("'", "''") for x in ls), hs)) for v, (ls, hs) in T.VARIANTS.items())
)


@query("t16_prompt_variants", f"WITH {MSG_SQL} " + _VARIANT_SQL.replace('"', "'"))
def t16_prompt_variants(spark, sf):
    m = messages(spark, sf).select("id", F.col("x").alias("msg_catch_art"), F.col("sender").alias("ctx_n_neighbors"), F.col("y").alias("ctx_recentk_min_int_min_neighbor"), "type")
    kinds = {c: k for c, k in m.dtypes if c != "id"}
    columns = {c: kinds[c] for c in T.select_features(list(kinds), ["msg_catch_art"], ["ctx_", "type"], [], [])}
    return m.select("id", F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), T.message_prompt(columns, v, "descriptive").alias("prompt")) for v in T.VARIANTS))).alias("p")).select("id", "p.*")


@query("t17_episode_prompts", """WITH e AS (SELECT l_orderkey, 'p' || l_linenumber AS id, count(*) AS msgs, min(l_quantity) AS dist, min(l_tax) AS life, avg(l_discount) AS spd FROM lineitem GROUP BY l_orderkey, l_linenumber),
o AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY l_orderkey) AS m, '- ' || id || ': g=- msgs=' || msgs || ' life=' || format('{:.2f}', life) || ' spd=- dist=' || format('{:.2f}', dist) AS line FROM e WINDOW w AS (PARTITION BY l_orderkey ORDER BY dist, -msgs, -life, id)), k AS (SELECT *, least(2, m) AS n FROM o)
SELECT l_orderkey AS k, 'Which are attackers?' || chr(10) || '- run: ' || l_orderkey || chr(10) || '- entities shown: ' || any_value(n) || '/' || any_value(m) || CASE WHEN any_value(n) < any_value(m) THEN ' (truncated)' ELSE '' END || chr(10) || string_agg(line, chr(10) ORDER BY rn) FILTER (rn <= n) || chr(10) || '' || chr(10) || 'Answer:' AS prompt FROM k GROUP BY l_orderkey""")  # fmt: skip
def t17_episode_prompts(spark, sf):
    e = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("num_msgs"), F.min("l_quantity").alias("distance_to_ego"), F.min("l_tax").alias("lifetime_fraction"))
    ent = F.struct(F.concat(F.lit("p"), "l_linenumber").alias("pseudo_local_id"), F.lit(None).cast("string").alias("group_id"), "num_msgs", "lifetime_fraction", F.lit(None).cast("double").alias("avg_speed"), "distance_to_ego")
    o = e.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(ent)).alias("entities"))
    cost = T.token_count(T.entity_line(F.get("entities", F.lit(0))))
    return o.select(F.col("l_orderkey").alias("k"), T.episode_prompt([F.concat(F.lit("- run: "), F.col("l_orderkey"))], F.col("entities"), "distance", cost * 2, "Which are attackers?").alias("prompt"))


@query("t18_t21_history_prompts", """WITH r AS (SELECT conv_id, turn, length(text)::DOUBLE AS len, row_number() OVER w AS n, lag(length(text)::DOUBLE) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, 'dt=-1.00 pos=[' || format('{:.1f}', before) || ',7.0] spd=[2.0,3.0] rssi=0' || chr(10) || 'dt=0.00 pos=[' || format('{:.1f}', len) || ',7.0] spd=[2.0,3.0] rssi=-' || chr(10) || 'Answer:' AS prompt, CASE WHEN conv_id % 2 = 0 THEN 'BENIGN' ELSE 'ATTACK' END AS label, CASE WHEN conv_id % 2 = 0 THEN 'BENIGN' WHEN conv_id % 3 = 0 THEN 'ATTACK' ELSE 'ATTACK_TYPE_' || (conv_id % 3) END AS kind, 'run|rcv' || conv_id || '|' || (turn - 1) || '-' || turn AS sample FROM r WHERE n >= 2""")
def t18_t21_history_prompts(spark, sf):
    c = load(spark, sf, "conversations").select("conv_id", "turn", F.col("turn").cast("double").alias("t"), F.length("text").cast("double").alias("x"), F.lit(7.0).alias("y"), F.lit(2.0).alias("vx"), F.lit(3.0).alias("vy"), F.lit(0.0).alias("rssi"))
    w = O.k_windows(c, ["conv_id"], ["turn"], 2, 1, ["t", "x", "y", "vx", "vy", "rssi"])
    last = F.array_max(F.transform("items", lambda x: x["t"]))
    items = F.transform("items", lambda x: x.withField("rssi", F.when(x["t"] < last, x["rssi"])))
    y, kind = F.col("conv_id") % 2, F.when(F.col("conv_id") % 3 > 0, F.col("conv_id") % 3)
    train = F.concat(F.array_join(T.history_lines(items), "\n"), F.lit("\nAnswer: "), T.label_text(y))
    return w.select("conv_id", "turn", T.without_answer(train).alias("prompt"), T.label_text(y).alias("label"), T.label_text(y, kind).alias("kind"), T.sample_id(F.lit("run"), F.col("conv_id"), F.col("turn") - 1, F.col("turn")).alias("sample"))


@query("t19_visible_labels", """WITH o AS (SELECT l_orderkey, list_distinct(list(l_linenumber)) AS c, list_distinct(list(l_linenumber) FILTER (l_returnflag = 'R')) AS g, list_distinct(list(l_linenumber) FILTER (l_discount > 0.05)) AS p FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey AS k, len(list_filter(coalesce(g, []), lambda x: x <= 3))::INT AS n_visible, len(list_filter(coalesce(p, []), lambda x: x > 3))::INT AS n_outside, list_sort(coalesce(g, [])) = list_sort(coalesce(p, [])) AS exact FROM o""")
def t19_visible_labels(spark, sf):
    ids = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("l_linenumber"))))
    o = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(ids(F.col("l_linenumber") <= 3).alias("v"), ids(F.col("l_returnflag") == "R").alias("g"), ids(F.col("l_discount") > 0.05).alias("p"))
    return o.select(F.col("l_orderkey").alias("k"), F.size(T.visible_labels(F.col("g"), F.col("v"))).alias("n_visible"), F.size(T.outside(F.col("p"), F.col("v"))).alias("n_outside"), T.exact_match(F.col("g"), F.col("p")).alias("exact"))


_H = "(({k}) * 2654435761) % 4294967296"


@query("sp1_run_quota", f"""WITH r AS (SELECT c_custkey AS run, c_nationkey AS config, 1 << (c_custkey % 5) AS kind, row_number() OVER (PARTITION BY c_nationkey ORDER BY {_H.format(k='c_custkey')}, c_custkey) AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
p AS (SELECT *, (n >= 4 AND rn > 4) AS pool FROM r), q AS (SELECT *, row_number() OVER (PARTITION BY pool, kind ORDER BY {_H.format(k='run')}, run) AS pn, count(*) OVER (PARTITION BY pool, kind) AS ps FROM p)
SELECT run, CASE WHEN NOT pool THEN 'train' WHEN pn <= CASE WHEN ps = 9 THEN CASE WHEN kind IN (2, 8) THEN 5 ELSE 4 END ELSE floor(ps / 2) END THEN 'val' ELSE 'test' END AS split FROM q""")  # fmt: skip
def sp1_run_quota(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("run"), F.col("c_nationkey").alias("config"), F.pow(F.lit(2), F.col("c_custkey") % 5).cast("int").alias("kind"))
    return S.run_split_quota(c, ["config"], "run", "kind").select("run", "split")


@query("sp4_keys_follow", f"""WITH k AS (SELECT DISTINCT l_linestatus, l_orderkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY {_H.format(k='l_orderkey + 5')}, l_orderkey) AS rn FROM k), p AS (SELECT DISTINCT l_orderkey FROM r WHERE rn <= CASE WHEN l_linestatus = 'F' THEN 30 ELSE 20 END)
SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem JOIN p USING (l_orderkey) GROUP BY l_orderkey""")
def sp4_keys_follow(spark, sf):
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linestatus")
    return S.key_sample(li, "l_linestatus", "l_orderkey", {"F": 30, "O": 20}, 5).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("sp5_receiver_validation", f"""WITH p AS (SELECT DISTINCT l_linenumber AS run, l_suppkey AS receiver FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY {_H.format(k='receiver + 3')}, receiver) AS rn, count(*) OVER (PARTITION BY run) AS n FROM p) SELECT run, receiver FROM r WHERE rn <= greatest(1, floor(n * 0.15))""")
def sp5_receiver_validation(spark, sf):
    li = load(spark, sf, "lineitem").select(F.col("l_linenumber").alias("run"), F.col("l_suppkey").alias("receiver"))
    return S.receiver_validation(li, "run", "receiver", 0.15, 3)


@query("sp9_demo_picks", f"""WITH p AS (SELECT *, {_H.format(k='o_orderkey')} AS h0, {_H.format(k='o_orderkey + 1')} AS h1, {_H.format(k='o_orderkey + 2')} AS h2 FROM orders WHERE o_custkey % 3 <> 0),
a AS (SELECT o_orderkey, 'd1' AS demo FROM p WHERE o_orderstatus = 'F' ORDER BY o_totalprice, h0, o_orderkey LIMIT 1), b AS (SELECT o_orderkey, 'd2' AS demo FROM p WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT o_orderkey FROM a) ORDER BY o_totalprice, h1, o_orderkey LIMIT 1),
c AS (SELECT o_orderkey, 'd3' AS demo FROM p WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a UNION ALL SELECT o_orderkey FROM b) ORDER BY o_totalprice DESC, h2, o_orderkey LIMIT 1) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")  # fmt: skip
def sp9_demo_picks(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    f, price = F.col("o_orderstatus") == "F", F.col("o_totalprice")
    return S.demo_picks(o, "o_orderkey", [("d1", f, price), ("d2", f, price), ("d3", F.lit(True), -price)], o.where("o_custkey % 3 = 0")).select("o_orderkey", "demo")


@query("sp10_weighted_draws", f"""WITH w AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN 4e0 WHEN 'F' THEN 1e0 ELSE 0.5e0 END AS w, {_H.format(k='o_orderkey + 11')} AS h FROM orders), c AS (SELECT *, sum(w) OVER (ORDER BY h, o_orderkey ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER () AS total FROM w),
d AS (SELECT o_orderkey, unnest(range(ceil((upto - w) / total * 3000 - s)::BIGINT, ceil(upto / total * 3000 - s)::BIGINT)) AS d FROM c, (SELECT ((11 * 2654435761) % 4294967296) / 4294967296::DOUBLE AS s)) SELECT o_orderkey, ((d % 3000 + 3000) % 3000)::BIGINT AS draw FROM d""")  # fmt: skip
def sp10_weighted_draws(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    weight = F.when(F.col("o_orderstatus") == "P", 4.0).when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.5)
    return S.weighted_draws(o, "o_orderkey", weight, 3000, 11).select("o_orderkey", "draw")


@query("sp11_sp12_row_caps", f"""SELECT 'cap' AS how, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY {_H.format(k='o_orderkey + 42')}, o_orderkey LIMIT 100) UNION ALL SELECT 'top_up', o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_H.format(k='o_orderkey')}, o_orderkey) AS rn FROM orders WHERE o_orderstatus = 'P') WHERE rn <= 25""")
def sp11_sp12_row_caps(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    cap = S.ordered_subset(o, "o_orderkey", 100, "o_orderkey", 42).select(F.lit("cap").alias("how"), "o_orderkey")
    return cap.unionByName(S.top_up(o.where("o_orderstatus = 'P'"), ["o_orderstatus"], "o_orderkey", 25).select(F.lit("top_up").alias("how"), "o_orderkey"))


@query("j14_result_grid", """WITH c AS (SELECT a AS attack, s::BIGINT AS seed, m AS model FROM (VALUES ('x'), ('y')) t(a), (VALUES (1), (2), (3)) u(s), (VALUES ('p'), ('q')) v(m)), n AS (SELECT count(*)::DOUBLE AS n FROM region)
SELECT attack, seed, model, CASE WHEN attack = 'x' AND model = 'p' THEN n + seed WHEN seed < 3 THEN n * 10 END AS f1, CASE WHEN attack = 'x' AND model = 'p' THEN 'first' WHEN seed < 3 THEN 'second' END AS source FROM c, n""")
def j14_result_grid(spark, sf):
    n = load(spark, sf, "region").agg(F.count(F.lit(1)).cast("double").alias("n"))
    cells = spark.createDataFrame([(a, s, m) for a in "xy" for s in (1, 2, 3) for m in "pq"], "attack string, seed long, model string").join(F.broadcast(n))  # one row
    first = cells.where("attack = 'x' and model = 'p'").withColumn("f1", F.col("n") + F.col("seed"))
    return M.grid(["x", "y"], [1, 2, 3], ["p", "q"], first, cells.where("seed < 3").withColumn("f1", F.col("n") * 10), "f1")


@query("o1_feature_order", """SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_returnflag, l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey) AS place FROM lineitem WHERE l_suppkey < 5 ORDER BY place LIMIT 200""")
def o1_feature_order(spark, sf):
    order = ["l_returnflag", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]
    top = load(spark, sf, "lineitem").where("l_suppkey < 5").orderBy(*order).limit(200)
    from pyspark.sql import Window

    return top.select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))  # 200 rows

