"""Sinks: routed Parquet, JSON lines, CSV, metadata."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and infinities become null, as JSON has neither."""
    ok = lambda c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c))
    return df.select(*(ok(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def write_splits(df: DataFrame, path: str, split: str = "split", label: str = "label") -> DataFrame:
    """One Parquet folder a split, replaced as a whole; returns rows by split and label, counted from what was written."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)
    return df.sparkSession.read.parquet(path).groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))


def write_jsonl(df: DataFrame, path: str, gzip: bool = False) -> None:
    w = nan_to_null(df).write.mode("overwrite")
    (w.option("compression", "gzip") if gzip else w).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A small report as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_metadata(spark, meta: dict, path: str) -> None:
    """A JSON document, through Spark so that any file system will do."""
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_episodes(df: DataFrame, path: str, run: str = "run") -> None:
    """Nested episodes as JSON lines, a folder a run; runs that are written again are replaced, others stay."""
    nan_to_null(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).json(path)


def write_row_log(df: DataFrame, template: str, **names: str | int) -> str:
    """A gzipped row log under a path with {run_id}, {model_tag}, {split} and {shard_index}; returns the path."""
    path = template.format(**names)
    write_jsonl(df, path, gzip=True)
    return path


def write_ids(df: DataFrame, key: str, path: str) -> None:
    """Distinct ids in order, a line each."""
    df.select(F.col(key).cast("string").alias("value")).where("value is not null").distinct().coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(path)


def write_merged(df: DataFrame, path: str, kind: str = "parquet") -> str | None:
    """Merged rows as parquet or json; what goes wrong is returned, not raised, as the report matters more."""
    try:
        (df.write.mode("overwrite").parquet(path) if kind == "parquet" else write_jsonl(df, path))
    except Exception as e:  # noqa: BLE001
        return f"{path} not written: {e}"
    return None


def split_statistics(df: DataFrame, keys: list[str], candidates: str, attackers: str) -> DataFrame:
    """Samples, share without attackers, mean candidates and attackers, by keys (split, run or family)."""
    n, k = F.size(candidates), F.size(attackers)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((k == 0).cast("double")).alias("empty_fraction"), F.avg(n).alias("mean_candidates"), F.avg(k).alias("mean_attackers"), F.max(n).alias("most_candidates"),
    )


def write_split_samples(df: DataFrame, path: str, candidates: str, attackers: str, run: str = "run") -> dict:
    """Samples as JSON lines by split, and split_manifest.json with their statistics, which is returned too."""
    nan_to_null(df).write.mode("overwrite").partitionBy("split").json(f"{path}/samples")
    rows = lambda keys: [r.asDict() for r in split_statistics(df, keys, candidates, attackers).orderBy(*keys).collect()]  # noqa: E731  a row a split or run
    manifest = {"splits": rows(["split"]), "runs": rows(["split", run])}
    write_metadata(df.sparkSession, manifest, f"{path}/split_manifest.json")
    return manifest


def plot_curve(curve: DataFrame, path: str) -> bool:
    """Loss over steps as a picture, train on the left axis and eval on the right one; False where matplotlib is absent."""
    try:
        from matplotlib.figure import Figure
    except ImportError:
        return False
    rows = curve.orderBy("step").collect()  # a row a logged step
    fig = Figure(figsize=(8, 4))
    left = fig.add_subplot()
    for axis, kind, colour in ((left, "train", "tab:blue"), (left.twinx(), "eval", "tab:orange")):
        own = [r for r in rows if r["kind"] == kind]
        axis.plot([r["step"] for r in own], [r["loss"] for r in own], color=colour)
        axis.set_ylabel(f"{kind} loss")
    fig.savefig(path)
    return True
