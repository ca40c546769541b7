"""Run archives: members of .tgz files, run ids, manifest health."""

from __future__ import annotations

import re
import tarfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBERS = "archive string, member string, kind string, size long, lines array<string>, error string, first_line long"
#: Lines of a row.
LINES = 20_000


def _kind(name: str) -> str | None:
    base = name.rsplit("/", 1)[-1]
    if base.endswith(".sca"):
        return "sca"
    if base.startswith("GroundTruth") or "GroundTruthJSON" in base:
        return "groundtruth"
    return "vehicle" if base.startswith("JSONlog") and base.endswith(".json") else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of up to LINES lines of every wanted member of every archive, the first of them numbered first_line (from 1).

    Archives are read as streams, one task for each, so neither an archive nor a member is ever held whole. A
    broken archive gives the members before the fault and a row with the error. Archives are one run each.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        names = [c.split()[0] for c in MEMBERS.split(", ")]
        for b in batches:
            for path in b["path"]:
                # Names hold characters that mean something in URIs.
                system, at = (fs.LocalFileSystem(), re.sub("^file:/+", "/", path)) if path.startswith("file:") else fs.FileSystem.from_uri(quote(path, safe="/:%"))
                try:
                    with system.open_input_stream(at, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|*") as tar:
                        for m in tar:
                            if m.isfile() and (kind := _kind(m.name)):
                                first, lines = 1, []
                                for line in tar.extractfile(m):
                                    lines.append(line.decode("utf-8", "replace").rstrip("\r\n"))
                                    if len(lines) == LINES:
                                        yield pd.DataFrame([(path, m.name, kind, m.size, lines, None, first)], columns=names)
                                        first, lines = first + LINES, []
                                if lines or first == 1:
                                    yield pd.DataFrame([(path, m.name, kind, m.size, lines, None, first)], columns=names)
                except (tarfile.TarError, EOFError, OSError, zlib.error) as e:
                    yield pd.DataFrame([(path, None, None, None, None, str(e), None)], columns=names).astype({"size": "Int64", "first_line": "Int64"})

    paths = spark.read.format("binaryFile").load(path).select("path")  # contents are not read
    return paths.repartition("path").mapInPandas(read, MEMBERS)


def run_columns(run_id: Column) -> dict[str, Column]:
    """Attacker type, start hour, attacker share and seed out of AttackerType<n>-start=<h>,0.<p>-#<seed>."""
    part = lambda i, t: F.regexp_extract(run_id, r"AttackerType(\d+)-start=(\d+),(0\.\d+)-#(\d+)", i).try_cast(t)
    return {"attacker_type": part(1, "int"), "start_h": part(2, "int"), "attacker_prob": part(3, "double"), "seed": part(4, "int")}


def manifest(members: DataFrame) -> DataFrame:
    """A row per archive with counts, status ok, warn or error, and notes."""
    run = F.regexp_extract("archive", r"([^/]+?)(?:\.tgz|\.tar\.gz)?$", 1)
    n = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).cast("long")
    attackers = F.sum(F.when((F.col("kind") == "vehicle") & F.col("member").rlike(r"-A1\.json$"), 1).otherwise(0)).cast("long")
    m = members.where("first_line = 1 or error is not null").groupBy(run.alias("run_id")).agg(n("vehicle").alias("vehicle_files"), attackers.alias("attacker_vehicle_files"), n("sca").alias("sca_files"), n("groundtruth").alias("groundtruth_files"), F.max("error").alias("error"))
    m = m.withColumns(run_columns(F.col("run_id")))
    status = F.when(F.col("error").isNotNull() | (F.col("vehicle_files") == 0), "error").when((F.col("sca_files") == 0) | (F.col("groundtruth_files") == 0) | F.col("attacker_type").isNull(), "warn").otherwise("ok")
    note = F.concat_ws("; ", F.col("error"), F.when(F.col("vehicle_files") == 0, "no vehicle logs"), F.when(F.col("sca_files") == 0, "no .sca"), F.when(F.col("groundtruth_files") == 0, "no ground truth"), F.when(F.col("attacker_type").isNull(), "run id not parsed"))
    return m.withColumns({"status": status, "note": note})
