import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tracelith.operators import metrics as M
from tracelith.operators import sampling as S
from tracelith.operators import traces as O
from tracelith.sources import logs


def make(spark, n=200, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice([1, 2]), r.choice([10, 11, 12]), float(r.randint(0, 60)), r.random() < 0.3, r.random() * 100) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, key long, sender long, t double, state boolean, x double")


def test_asof(spark):
    rows, df = make(spark)
    back = {r.id: r.ego_id for r in O.asof_backward(df, ["key"], ["t", "id"], F.col("state"), ["id"]).collect()}
    near = {r.id: r.ego_t for r in O.asof_nearest(df, ["key"], ["id"], F.col("state"), ["id"]).collect()}
    for i, k, _, t, st, _ in rows:
        if st:
            continue
        before = [s for s in rows if s[4] and s[1] == k and (s[3], s[0]) < (t, i)]
        assert back.get(i) == (max(before, key=lambda s: (s[3], s[0]))[0] if before else None)
        assert near[i] == min((s[3] for s in rows if s[4] and s[1] == k), key=lambda u: (abs(u - t), u))


def test_history(spark):
    rows, df = make(spark, 120, 2)
    got = {r.id: r for r in O.sender_history(df, ["sender"], ["t", "id"], "x", 3, 10.0, ("le", 30.0), ("le", 60.0)).collect()}
    for s in (10, 11, 12):
        own = sorted((r for r in rows if r[2] == s), key=lambda r: (r[3], r[0]))
        for n, r in enumerate(own):
            h = [q[5] for q in own[max(0, n - 3) : n] if q[3] >= r[3] - 10]
            g = got[r[0]]
            assert (g.h_count, g.h_t1, g.h_last) == (len(h), sum(v <= 30 for v in h), h[-1] if h else None)
            assert g.h_mean == (pytest.approx(sum(h) / len(h)) if h else None)


def test_time_split_rejects_overlap(spark):
    with pytest.raises(ValueError):
        S.time_split(spark.range(1), {"train": [(0.0, 2.0)], "val": [(1.0, 3.0)]}, "id")


def test_thresholds():
    c = [{"q": i, "op": "le", "threshold": float(i), "support": s, "gap": g, "score": g * s**0.5} for i, (s, g) in enumerate([(0.05, 0.3), (0.3, 0.2), (0.5, 0.05)])]
    t1, t2 = O.select_thresholds(c)
    assert t1["threshold"] == 1.0 and t2 is None


def test_episode_windows(spark):
    rows, df = make(spark, 100, 3)
    got = {(r.id, r.window_no) for r in O.sliding_episodes(df, "key", 10.0, 5.0).collect()}
    want = set()
    for k in (1, 2):
        own = [r for r in rows if r[1] == k]
        lo, hi, i = min(r[3] for r in own), max(r[3] for r in own), 0
        while lo + 5 * i + 10 <= hi + 5:
            want |= {(r[0], i) for r in own if lo + 5 * i <= r[3] <= lo + 5 * i + 10}
            i += 1
    assert got == want


def test_confusion_and_shards(spark):
    df = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (0, 0, 2), (0, 1, 3)], "g int, p int, id long")
    r = M.confusion(df, [], "g", "p").first()
    assert (r.tp, r.fp, r.fn, r.tn, r.f1) == (1, 1, 1, 1, 0.5)
    sizes = [r["count"] for r in S.shards(spark.range(10), "id", 4).groupBy("shard").count().orderBy("shard").collect()]
    assert sizes == [3, 3, 3, 1]
    assert M.coverage(df, "id", 5).first().n_missing == 1


def test_trace_files(spark, tmp_path):
    d = tmp_path / "DoS_0709" / "VeReMi_1_2_x"
    d.mkdir(parents=True)
    recs = [{"type": 2, "rcvTime": 1.0, "pos": [1, 2, 0]}, None, {"type": 3, "sendTime": 2.0, "sender": 5, "pos": [3, 4, 0]}, {"type": 3, "sender": 6}]
    (d / "traceJSON-9-1-A16-25200-7.json").write_text("\n".join("" if r is None else json.dumps(r) for r in recs))
    got = logs.flatten(logs.read_traces(spark, str(tmp_path))).orderBy("line_idx").collect()
    assert [(r.line_idx, r.type, r.t, r.pos_x, r.vehicle_id, r.attack_flag, r.episode_id) for r in got] == [
        (1, 2, 1.0, 1.0, 9, 16, "DoS_0709/VeReMi_1_2_x"), (3, 3, 2.0, 3.0, 9, 16, "DoS_0709/VeReMi_1_2_x")]


def test_metric_lines(spark):
    df = spark.createDataFrame([('METRICS_JSON: {"tp": 3}',), ("noise",)], "value string")
    assert [r.metrics.tp for r in logs.metrics_lines(df, "tp long").collect()] == [3]


def test_baseline_sizes(spark):
    from tracelith.operators.baselines import _model

    rf, gbt, mlp, lr = (_model(k, 4) for k in ("rf", "gbt", "mlp", "lr"))
    assert (rf.getNumTrees(), rf.getMaxDepth(), gbt.getMaxIter(), gbt.getMaxDepth(), gbt.getStepSize()) == (500, 30, 600, 6, 0.05)
    assert (mlp.getLayers(), mlp.getMaxIter(), lr.getMaxIter()) == ([4, 256, 128, 2], 200, 2000)


def test_cluster_tracks_of_a_full_episode(spark):
    """F3, F6, F7, F8: an episode of 30,000 tracks takes seconds, groups are those of all pairs."""
    r = random.Random(5)

    def tracks(n):
        rows = []
        for i in range(n):
            a = r.random() * 86400
            rows.append((1, 0, i, 1, r.random() * 600, r.random() * 300, r.random() * 10, a, a + r.choice([0.0, 0.0, 20000.0])))
        return rows

    schema = "receiver long, window_no long, pseudo long, num_msgs long, mean_x double, mean_y double, mean_speed double, first_t double, last_t double"
    args = (["receiver", "window_no"], 12.0, 1.0, 0.2)
    rows = tracks(4000)
    got = {x.pseudo: x.group_id for x in O.cluster_tracks(spark.createDataFrame(rows, schema), *args).collect()}
    root = {i: i for i in range(4000)}

    def find(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    moving = [x for x in rows if x[8] > x[7]]
    for m, a in enumerate(moving):
        for b in moving[m + 1 :]:
            if abs(a[4] - b[4]) < 12 and math.hypot(a[4] - b[4], a[5] - b[5]) < 12 and abs(a[6] - b[6]) < 1:
                if max(0, min(a[8], b[8]) - max(a[7], b[7])) / (max(a[8], b[8]) - min(a[7], b[7])) > 0.2:
                    root[max(find(a[2]), find(b[2]))] = min(find(a[2]), find(b[2]))
    parts = {}
    for i in range(4000):
        parts.setdefault(find(i), set()).add(got[i])
    assert all(len(names) == 1 for names in parts.values()) and len(set(got.values())) == len(parts) < 3900
    began = time.time()
    assert O.cluster_tracks(spark.createDataFrame(tracks(30000), schema), *args).count() == 30000
    assert time.time() - began < 15


def crowd(n, pseudos, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        p = r.randrange(pseudos)
        place = (None, None) if r.random() < 0.02 else (r.randint(0, 60) * 1.0, r.randint(0, 60) * 1.0)
        t = None if r.random() < 0.01 else float(r.randint(0, n // 4))
        rows.append((i, 1, None if r.random() < 0.02 else p, None if r.random() < 0.02 else p // 3, t, *place, r.random() * 10, r.random() * 360))
    return rows, "id long, receiver long, pseudo long, sender long, t double, x double, y double, speed double, heading double"


def brute(rows, span):
    """What each message sees: all earlier rows in the span, and the latest of each pseudonym."""
    for m in rows:
        past = [] if m[4] is None else sorted((q for q in rows if q[4] is not None and q[4] >= m[4] - span and (q[4], q[0]) < (m[4], m[0])), key=lambda q: (q[4], q[0]))
        yield m, past, {q[2]: q for q in past}


def test_context_of_a_crowd(spark):
    """neighbours equal brute force, ties, nulls and slice borders included; 30,000 messages of one window take seconds."""
    rows, schema = crowd(700, 120, 6)
    got = {x.id: x for x in O.neighbour_context(spark.createDataFrame(rows, schema), "receiver", 60.0, 30.0).collect()}
    most = 0
    for m, past, latest in brute(rows, 60.0):
        near = sorted((math.hypot(q[5] - m[5], q[6] - m[6]), q[0], abs(q[7] - m[7])) for p, q in latest.items() if None not in (p, m[2], q[5], m[5]) and p != m[2] and math.hypot(q[5] - m[5], q[6] - m[6]) <= 30)
        most, near, g = max(most, len(near)), near[:20], got[m[0]]
        own = [q[2] for q in past if m[3] is not None and q[3] == m[3]]
        switches = sum(None not in (a, b) and a != b for a, b in zip(own, own[1:]))
        assert (g.n_active_pseudos, g.n_neighbours, g.n_sender_pseudos, g.n_pseudo_switches) == (len(latest), len(near), len({*own, m[2]}), switches)
        assert g.min_distance == (near[0][0] if near else None) and g.mean_speed_diff == (pytest.approx(sum(x[2] for x in near) / len(near)) if near else None)
    assert most > 20
    rows, schema = crowd(30000, 20000, 7)
    began = time.time()
    assert O.neighbour_context(spark.createDataFrame(rows, schema), "receiver", 1e6, 30.0).count() == 30000
    assert time.time() - began < 60


def test_fresh_overlap_of_a_crowd(spark):
    """counts and least scores equal those of fresh_latest's lists; 30,000 messages of one window take seconds."""
    rows, schema = crowd(700, 120, 8)
    got = {x.id: x for x in O.fresh_overlap(spark.createDataFrame(rows, schema), "receiver", 60.0).collect()}
    reach = math.sqrt(29) + 20
    for m, _, latest in brute(rows, 60.0):
        others = [q for p, q in latest.items() if None not in (p, m[2]) and p != m[2]]
        scores = [1.0 if None in (q[5], m[5]) else min(1.0, 1 - max(0.0, reach - math.hypot(q[5] - m[5], q[6] - m[6])) / reach) for q in others]
        g = got[m[0]]
        assert (g.n_fresh, g.n_violations) == (len(others), sum(s < 0.5 for s in scores))
        assert g.min_overlap_score == (pytest.approx(min(scores)) if scores else None)
    rows, schema = crowd(30000, 20000, 9)
    began = time.time()
    assert O.fresh_overlap(spark.createDataFrame(rows, schema), "receiver", 1e6).count() == 30000
    assert time.time() - began < 60
