"""Sources of traces, row logs and metric lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VECTOR = "array<double>"
TRACE = f"type int, rcvTime double, sendTime double, sender long, senderPseudo long, messageID long, pos {VECTOR}, pos_noise {VECTOR}, spd {VECTOR}, spd_noise {VECTOR}, acl {VECTOR}, acl_noise {VECTOR}, hed {VECTOR}, hed_noise {VECTOR}"


def metrics_lines(lines: DataFrame, schema: str, mark: str = "METRICS_JSON:") -> DataFrame:
    """Lines (column value) that start with the mark, parsed as column metrics."""
    return lines.where(F.col("value").startswith(mark)).withColumn("metrics", F.from_json(F.substring("value", len(mark) + 1, 1 << 30), schema))


def file_metadata(name: Column) -> dict[str, Column]:
    """Vehicle, node, attack flag, start second and run out of traceJSON-<vid>-<nid>-A<flag>-<sec>-<run>.json."""
    pattern = r"traceJSON-(\d+)-(\d+)-A(\d+)-(\d+)-(\d+)\.json"
    part = lambda i: F.regexp_extract(name, pattern, i).try_cast("long")
    return {"vehicle_id": part(1), "node_id": part(2), "attack_flag": part(3), "start_sec": part(4), "run_no": part(5)}


def plain_metadata(name: Column) -> dict[str, Column]:
    """The same by position between dashes, for names of other endings; parts that are no numbers are null."""
    p = F.split(F.regexp_replace(name, r"^.*/", ""), "-")
    num = lambda c: F.regexp_extract(c, r"(\d+)", 1).try_cast("long")
    return {k: num(F.get(p, i)) for k, i in (("vehicle_id", 1), ("node_id", 2), ("attack_flag", 3), ("start_sec", 4), ("run_no", 5))}


def run_stem(episode_id: Column) -> Column:
    return F.replace(episode_id, F.lit("/"), F.lit("_"))


def by_type(traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Own states (type 2) and received messages (type 3); other types are left out."""
    return traces.where("type = 2"), traces.where("type = 3")


def ground_truth(traces: DataFrame, order: str = "line_idx") -> DataFrame:
    """senderPseudo and its sender by the records of type 4; the last record of a pseudonym wins. n_pseudos counts those of the sender."""
    last = traces.where("type = 4").groupBy("senderPseudo").agg(F.max_by("sender", order).alias("sender"))
    per = last.groupBy("sender").agg(F.count(F.lit(1)).alias("n_pseudos"))
    return last.join(per, "sender").select("senderPseudo", "sender", "n_pseudos")


def attack_flags(files: DataFrame, keys: list[str], flag: str, strict: bool = False) -> DataFrame:
    """One flag for each key: the largest. strict: different flags of a key are a ValueError."""
    out = files.groupBy(*keys).agg(F.max(flag).alias(flag), F.min(flag).alias("_low"))
    if strict and (bad := out.where(f"{flag} <> _low").limit(5).collect()):
        raise ValueError(f"attack flags conflict for {[tuple(r[k] for k in keys) for r in bad]}")
    return out.drop("_low")


def attacker(flag: Column, rule: str = "non_zero", n: int | None = None) -> Column:
    """1 or 0 by the rule non_zero, or equals n; a missing flag is 0."""
    f = F.coalesce(flag, F.lit(0))
    return F.when((f != 0) if rule == "non_zero" else (f == n), 1).otherwise(0)


def label_senders(rows: DataFrame, flags: DataFrame, keys: list[str], flag: str = "attack_flag", rule: str = "non_zero", n: int | None = None) -> DataFrame:
    """rows with label by the flags of their keys (sender alone, or run and sender); senders without a flag are 0."""
    got = rows.join(flags.select(*keys, F.col(flag).alias("_flag")), keys, "left")
    return got.withColumn("label", attacker(F.col("_flag"), rule, n)).drop("_flag")


def row_logs(rows: DataFrame, run_id: str | None = None, model: str | None = None, split: str | None = None) -> DataFrame:
    """Rows of a run, model and split; rows without a run_id pass. Adds run_stem, gold_label, pred_is_attack and is_counted."""
    for c, want in (("run_id", run_id), ("model_tag", model), ("split", split)):
        if want is not None:
            rows = rows.where((F.col(c) == want) | (F.col(c).isNull() if c == "run_id" else F.lit(False)))
    pred = F.col("pred_label").cast("int")
    return rows.withColumns({"run_stem": run_stem(F.col("episode_id")), "gold_label": F.col("label").cast("int"), "pred_is_attack": F.coalesce(pred, F.lit(0)), "is_counted": pred.isNotNull().cast("int")})


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Trace records with source_file, line_idx (1-based, blank lines counted), episode_id and file metadata.

    Line numbers are those of the physical file, so a file is one row until it is split. Malformed lines raise.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="traceJSON-*.json")
    raw = raw.select("value", F.col("_metadata.file_path").alias("source_file"))
    lines = raw.select("source_file", F.posexplode(F.split("value", "\n")).alias("pos_", "line")).where(F.trim("line") != "")
    rec = lines.select("source_file", (F.col("pos_") + 1).alias("line_idx"), F.from_json("line", TRACE, {"mode": "FAILFAST"}).alias("r"))
    out = rec.select("source_file", "line_idx", "r.*").withColumns(file_metadata(F.col("source_file")))
    parts = F.split("source_file", "/")
    out = out.withColumn("episode_id", F.concat_ws("/", F.element_at(parts, -3), F.element_at(parts, -2)))
    time = F.coalesce("rcvTime", "sendTime", F.lit(-1.0))
    return out.withColumn("t", F.nanvl(time, F.lit(None))).where("t >= 0")


def flatten(traces: DataFrame) -> DataFrame:
    """x and y of every vector, and confidences; missing positions are null, missing noise counts as none."""
    xy = {f"{c}_{a}": F.get(F.col(c), F.lit(i)) for c in ("pos", "spd", "acl", "hed") for i, a in enumerate("xy")}
    conf = {f"{c}_conf": F.greatest(F.hypot(*(F.coalesce(F.get(F.col(f"{c}_noise"), F.lit(i)), F.lit(0.0)) for i in (0, 1))), F.lit(1e-3)) for c in ("pos", "spd", "acl", "hed")}
    return traces.withColumns(xy | conf)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines, gzip by suffix. Strict raises on a malformed line; otherwise such lines are left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    got = spark.read.text(path).where(F.trim("value") != "")
    got = got.select(F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return got.select("r.*").where("_corrupt is null").drop("_corrupt")
