import io
import tarfile

from pyspark.sql import functions as F

from tracelith.operators import sampling as S
from tracelith.sources import archives, logs, sinks


def test_archives(spark, tmp_path):
    name = "AttackerType1-start=7,0.1-#3"
    with tarfile.open(tmp_path / f"{name}.tgz", "w:gz") as t:
        for member in ("results/a.sca", "results/JSONlog-1-2-A1.json", "results/JSONlog-2-3-A0.json", "results/notes.txt"):
            info = tarfile.TarInfo(f"{name}/{member}")
            info.size = 3
            t.addfile(info, io.BytesIO(b"x\ny"))
    (tmp_path / "broken.tgz").write_bytes(b"no archive")
    got = {r.run_id: r for r in archives.manifest(archives.read_archives(spark, str(tmp_path))).collect()}
    ok = got[name]
    assert (ok.status, ok.vehicle_files, ok.attacker_vehicle_files, ok.attacker_type, ok.start_h, ok.seed) == ("warn", 2, 1, 1, 7, 3)
    assert got["broken"].status == "error"


def test_jsonl_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, 2.0, "b")], "label int, x double, split string")
    sinks.write_jsonl(df, str(tmp_path / "j"), gzip=True)
    assert {r.x for r in logs.read_jsonl(spark, str(tmp_path / "j"), "label int, x double").collect()} == {None, 2.0}
    assert {(r.split, r.label, r.n) for r in sinks.write_splits(df, str(tmp_path / "p")).collect()} == {("a", 1, 1), ("b", 2, 1)}
    (tmp_path / "bad.jsonl").write_text('{"label": 1}\nnot json\n')
    assert logs.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "label int", strict=False).count() == 1
    sinks.write_csv(df, str(tmp_path / "c"))
    sinks.write_metadata(spark, {"rows": 2}, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().rows == 2


def test_run_split(spark):
    runs = spark.range(13).select(F.when(F.col("id") < 3, "small").otherwise("large").alias("config"), F.col("id").cast("string").alias("run"))
    n = {(r.config, r.split): r["count"] for r in S.run_split(runs, ["config"], "run").groupBy("config", "split").count().collect()}
    assert n == {("small", "train"): 3, ("large", "train"): 4, ("large", "val"): 3, ("large", "test"): 3}
    assert S.proportional({0: 90, 1: 10}, 20) == {0: 18, 1: 2} and S.proportional({0: 5, 1: 0}, 9) == {0: 5, 1: 0}


def test_stateful_stream(spark, tmp_path):
    from tracelith.streaming.messages import stateful_messages

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "receiver long, id long, sender long, pseudo long, t double, type int, x double, y double"
    rows = [(1, 0, 5, 50, 0.5, 3, 9.0, 9.0), (1, 1, 0, 0, 1.0, 2, 0.0, 0.0), (1, 2, 5, 50, 2.0, 3, 3.0, 4.0), (1, 3, 5, 50, 3.5, 3, 6.0, 8.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    out = stateful_messages(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("stateful_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.id, r.dt, r.distance) for r in spark.table("stateful_out").orderBy("id").collect()] == [(2, None, 5.0), (3, 1.5, 10.0)]
