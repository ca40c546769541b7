import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracelith.functions import coerce as C
from tracelith.functions import text as T
from tracelith.operators import metrics as M
from tracelith.operators import sampling as S
from tracelith.operators import traces as O
from tracelith.operators.quantiles import exact_quantiles
from tracelith.sources import logs, sinks, specs


def test_config_and_overrides(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"a": {"b": 1}, "c": [1]}))
    got = specs.load_config(spark, f"file://{tmp_path}/c.json", ["a.b=2", "a.d=[1, 2]", "e.f=None", "g=plain text"])
    assert got == {"a": {"b": 2, "d": [1, 2]}, "c": [1], "e": {"f": None}, "g": "plain text"}
    for bad in ("novalue", "=1", "c.x=1"):
        with pytest.raises(ValueError):
            specs.apply_overrides({"c": [1]}, [bad])


def test_split_specs():
    w = lambda a, b: {"start": a, "end": b}
    got = specs.split_spec({"train": [w(5, 9), w(0, 5)], "val": [w(9, 10)], "test": [w(12, 13)]})
    assert got["kind"] == "windows" and got["splits"]["train"] == [(0.0, 5.0), (5.0, 9.0)]
    assert specs.split_spec({"train": ["a", "a"], "test": ["b"]}) == {"kind": "runs", "splits": {"train": ["a"], "test": ["b"]}}
    for bad in ({"train": ["a"]}, {"train": ["a"], "test": ["a"]}, {"train": [w(0, 5)], "test": [w(4, 6)]}, {"train": [w(5, 5)], "test": [w(6, 7)]}):
        with pytest.raises(ValueError):
            specs.split_spec(bad)
    assert specs.parse_windows("3-4, 1-2,3-4") == [(1.0, 2.0), (3.0, 4.0)] and specs.parse_quantiles("0.5,0.1,0.5") == [0.1, 0.5]
    with pytest.raises(ValueError):
        specs.parse_quantiles("1.5")


def test_ids_and_paths(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("b\n# no\n a \nb\n\n")
    (tmp_path / "ids.json").write_text('{"eval_ids": [3, 1, 3]}')
    at = f"file://{tmp_path}"
    assert specs.load_ids(spark, f"{at}/ids.txt") == ["b", "a"] and specs.load_ids(spark, f"{at}/ids.json") == ["3", "1"]
    (tmp_path / "list").write_text(f"{at}/ids.txt\n")
    got = specs.input_paths(spark, f"{at}/ids*", f"{at}/list")
    assert [p.rsplit("/", 1)[1] for p in got][:2] == ["ids.json", "ids.txt"]
    (tmp_path / "list").write_text(f"{at}/none.txt\n")
    with pytest.raises(FileNotFoundError):
        specs.input_paths(spark, None, f"{at}/list")
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    assert [r.v for r in specs.rows_by_ids(rows, "id", spark.createDataFrame([(2,)], "id long")).collect()] == ["y"]
    with pytest.raises(ValueError, match="9"):
        specs.rows_by_ids(rows, "id", spark.createDataFrame([(9,)], "id long"))


def test_sinks(spark, tmp_path):
    at = f"file://{tmp_path}"
    df = spark.createDataFrame([("train", "r1", ["p1", "p2"], ["p1"]), ("test", "r2", ["p3"], [])], "split string, run string, c array<string>, a array<string>")
    m = sinks.write_split_samples(df, f"{at}/s", "c", "a")
    assert [(r["split"], r["n"], r["empty_fraction"]) for r in m["splits"]] == [("test", 1, 1.0), ("train", 1, 0.0)]
    assert json.loads(specs.read_text(spark, f"{at}/s/split_manifest.json").strip()) == m
    sinks.write_episodes(df, f"{at}/e")
    sinks.write_episodes(df.where("run = 'r1'").withColumn("split", F.lit("again")), f"{at}/e")
    assert {(r.run, r.split) for r in spark.read.json(f"{at}/e").collect()} == {("r1", "again"), ("r2", "test")}
    path = sinks.write_row_log(df, at + "/{run_id}/{shard_index}", run_id="x", shard_index=3)
    assert path.endswith("/x/3") and spark.read.json(path).count() == 2
    sinks.write_ids(df, "run", f"{at}/i")
    assert specs.load_ids(spark, f"{at}/i") == ["r1", "r2"]
    assert sinks.write_merged(df, f"{at}/m") is None and "not written" in sinks.write_merged(df, "nosuch://x/y")


def test_checks_raise(spark):
    df = spark.createDataFrame([(0,), (1,)], "label int")
    assert C.require_labels(df, "label").count() == 2
    with pytest.raises(Exception, match="label is not 0 or 1"):
        C.require_labels(df.union(spark.createDataFrame([(7,)], "label int")), "label").collect()
    ids = spark.createDataFrame([(["p1"], ["p1", "p2"]), (["p9"], ["p1"])], "a array<string>, b array<string>")
    with pytest.raises(Exception, match="p9"):
        ids.select(C.require_subset(F.col("a"), F.col("b"), "attackers that are no candidates")).collect()
    flags = spark.createDataFrame([(1, 0), (1, 16)], "vid long, flag int")
    assert logs.attack_flags(flags, ["vid"], "flag").first().flag == 16
    with pytest.raises(ValueError, match="conflict"):
        logs.attack_flags(flags, ["vid"], "flag", strict=True)


def test_exact_quantiles_with_ties(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(k, float(v)) for k, vs in ((1, rng.integers(0, 5, 3000)), (2, rng.standard_normal(999)), (3, [7.0])) for v in vs] + [(4, None)]
    got = {r.k: r for r in exact_quantiles(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", {"a": 0.1, "b": 0.5, "c": 1.0}).collect()}
    assert set(got) == {1, 2, 3}
    for k in got:
        v = np.array([x for j, x in rows if j == k])
        assert [got[k].a, got[k].b, got[k].c] == pytest.approx(list(np.quantile(v, [0.1, 0.5, 1.0])))


def test_large_keys_and_draws(spark):
    df = spark.createDataFrame([(4_000_000_000 + i, float(i % 3)) for i in range(60)], "id long, w double")
    assert S.bottom_k(df.withColumn("s", F.lit(1)), ["s"], "id", 5).count() == 5
    draws = S.weighted_draws(df, "id", F.col("w"), 300, 4)
    assert sorted(r.draw for r in draws.collect()) == list(range(300))
    n = {r.w: r["count"] for r in draws.groupBy("w").count().collect()}
    assert n.get(0.0, 0) == 0 and n[2.0] == pytest.approx(200, abs=2)
    assert S.top_up(df, ["w"], "id", 50).count() == 50


def test_thresholds_need_rows(spark):
    df = spark.createDataFrame([(float(i), float(i % 7), i % 2) for i in range(40)], "t double, v double, y int")
    got = O.fit_thresholds(df, [(0.0, 30.0)], "y", {"v": [0.2, 0.5]}, {"v": [0.5]})
    assert got["v"]["t1"]["op"] in ("gt", "ge") and json.loads(json.dumps(got)) == got
    with pytest.raises(ValueError, match="no rows"):
        O.fit_thresholds(df, [(100.0, 101.0)], "y", {"v": [0.5]}, {})


def test_feature_lists():
    cols = ["x", "msg_catch_b", "msg_catch_a", "ctx_recentk_hist_count", "ctx_n"]
    assert T.select_features(cols, ["x"], ["msg_catch_"], ["msg_catch_b"], []) == ["x", "msg_catch_a"]
    assert T.select_features(cols, [], ["ctx_n"], [], ["msg_catch_b"]) == ["msg_catch_b", "ctx_n"]
    assert T.feature_group("ctx_recentk_hist_count") == "Sender history: extent" and T.feature_group("t") == "Timing"
    with pytest.raises(ValueError):
        T.feature_name("x", "fancy")
    with pytest.raises(ValueError):
        T.message_prompt({}, "nosuch")


def test_grid_and_reports(spark, tmp_path):
    a = spark.createDataFrame([("x", 1, "p", 0.5)], "attack string, seed long, model string, f1 double")
    got = {(r.attack, r.seed, r.model): (r.f1, r.source) for r in M.grid(["x"], [1, 2], ["p"], a, a.limit(0), "f1").collect()}
    assert got == {("x", 1, "p"): (0.5, "first"), ("x", 2, "p"): (None, None)}
    files = spark.createDataFrame([("/r/dos_base_seed3.json", '{"f1": 0.5, "acc": 1}'), ("/r/other.json", "{}")], "path string, value string")
    assert {(r.attack, r.group, r.seed, r.metric) for r in specs.result_files(files).collect()} == {("dos", "base", 3, "f1"), ("dos", "base", 3, "acc")}
    assert specs.log_glob("logs/", 12) == "logs/*_12_*.out"


def test_everything_else_works_without_llm(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for name in ("tracelith", "__spark_entry__.py"):
        src = root / name
        shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if src.is_dir() else shutil.copy(src, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 60 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)} | {k: v for k, v in __import__("os").environ.items() if k not in ("PYTHONPATH",)})
