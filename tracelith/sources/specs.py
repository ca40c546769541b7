"""Small driver-side inputs (configs, split specs, id lists, file lists) and log scraping."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file, through Spark so that any file system will do."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def parse_value(text: str):
    """JSON, else a Python literal, else the text itself."""
    import ast

    for read in (json.loads, ast.literal_eval):
        try:
            return read(text)
        except (ValueError, SyntaxError):
            pass
    return text


def apply_overrides(config: dict, overrides: Iterable[str]) -> dict:
    """A copy of config with dotted KEY=VALUE settings applied; missing levels are made. A ValueError names a bad setting."""
    out = json.loads(json.dumps(config))
    for setting in overrides:
        key, eq, value = setting.partition("=")
        names = key.strip().split(".")
        if not eq or not all(names):
            raise ValueError(f"not KEY=VALUE: {setting}")
        at = out
        for name in names[:-1]:
            if not isinstance(at.setdefault(name, {}), dict):
                raise ValueError(f"{name} of {key} is not a mapping")
            at = at[name]
        at[names[-1]] = parse_value(value.strip())
    return out


def load_config(spark: SparkSession, path: str, overrides: Iterable[str] = ()) -> dict:
    """A mapping from a YAML (or, as that is YAML too, JSON) file, with overrides. Needs PyYAML for anything but JSON."""
    text = read_text(spark, path)
    try:
        config = json.loads(text)
    except ValueError:
        import yaml

        config = yaml.safe_load(text)
    if not isinstance(config, dict):
        raise ValueError(f"{path} holds no mapping")
    return apply_overrides(config, overrides)


def windows(items: object, where: str = "windows") -> list[tuple[float, float]]:
    """Validated [{start, end}, ...] as half-open pairs in order."""
    if not isinstance(items, list):
        raise ValueError(f"{where} is no list")
    out = []
    for x in items:
        if not isinstance(x, dict) or not {"start", "end"} <= set(x):
            raise ValueError(f"{where}: {x} has no start and end")
        a, b = float(x["start"]), float(x["end"])
        if not a < b:
            raise ValueError(f"{where}: start {a} is not before end {b}")
        out.append((a, b))
    return sorted(out)


def split_spec(spec: dict) -> dict:
    """A split by time windows ({train,val,test: [{start,end}]}) or by runs ({train,val,test: [names]}), validated.

    Returns kind (windows or runs) and splits. Overlap between splits is a ValueError; val may be absent for runs.
    """
    named = {s: spec[s] for s in ("train", "val", "test") if spec.get(s)}
    if "train" not in named or "test" not in named:
        raise ValueError("a split spec needs train and test")
    if all(isinstance(x, dict) for xs in named.values() for x in xs):
        splits = {s: windows(xs, s) for s, xs in named.items()}
        flat = sorted((a, b, s) for s, ws in splits.items() for a, b in ws)
        for (a, b, s), (c, d, t) in zip(flat, flat[1:]):
            if c < b:
                raise ValueError(f"windows overlap: {s} [{a}, {b}) and {t} [{c}, {d})")
        return {"kind": "windows", "splits": splits}
    splits = {s: list(dict.fromkeys(map(str, xs))) for s, xs in named.items()}
    names = list(splits)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if both := sorted(set(splits[a]) & set(splits[b])):
                raise ValueError(f"runs in {a} and {b}: {', '.join(both)}")
    return {"kind": "runs", "splits": splits}


def parse_windows(text: str) -> list[tuple[float, float]]:
    """`a-b,c-d` as validated pairs, sorted and without repeats."""
    out = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(-?[\d.]+)\s*[-:]\s*(-?[\d.]+)", part)
        if not m or not float(m[1]) < float(m[2]):
            raise ValueError(f"no window: {part}")
        out.add((float(m[1]), float(m[2])))
    return sorted(out)


def parse_quantiles(text: str) -> list[float]:
    """Comma-separated numbers in 0..1, sorted and without repeats."""
    out = sorted({float(x) for x in text.split(",") if x.strip()})
    if not out or out[0] < 0 or out[-1] > 1:
        raise ValueError(f"quantiles must be in 0..1: {text}")
    return out


def load_ids(spark: SparkSession, path: str, keys: Iterable[str] = ("ids", "eval_ids", "sample_ids")) -> list[str]:
    """Ids of a text file (a line each, # comments) or of the first known key of a YAML or JSON mapping; order stays, repeats go."""
    if re.search(r"\.(ya?ml|json)$", path):
        config = load_config(spark, path)
        found = next((config[k] for k in keys if k in config), None)
        if found is None:
            raise ValueError(f"{path} has none of {', '.join(keys)}")
        lines = map(str, found)
    else:
        lines = read_text(spark, path).split("\n")
    return list(dict.fromkeys(x for x in (y.strip() for y in lines) if x and not x.startswith("#")))


def input_paths(spark: SparkSession, glob: str | None = None, list_file: str | None = None) -> list[str]:
    """Paths that match the glob, sorted, and those of the list file (# comments), each once. A FileNotFoundError names missing ones."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    out: list[str] = []
    if glob:
        p = jvm.org.apache.hadoop.fs.Path(glob)
        out += sorted(s.getPath().toString() for s in (p.getFileSystem(conf).globStatus(p) or []))
    if list_file:
        out += load_ids(spark, list_file)
    missing = [x for x in out if not (p := jvm.org.apache.hadoop.fs.Path(x)).getFileSystem(conf).exists(p)]
    if missing:
        raise FileNotFoundError(f"missing inputs: {', '.join(missing)}")
    return list(dict.fromkeys(out))


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of Parquet files, from their footers: the count is pushed into the scan."""
    return spark.read.parquet(path).count()


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def rows_by_ids(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """Rows whose key is in ids (column of the same name); a ValueError names up to ten ids that no row has."""
    wanted = ids.select(key).distinct()
    missing = [str(r[0]) for r in wanted.join(rows.select(key), key, "left_anti").orderBy(key).limit(10).collect()]
    if missing:
        raise ValueError(f"ids without rows: {', '.join(missing)}")
    return rows.join(wanted, key, "left_semi")


def shard_logs(files: DataFrame, schema: str = "map<string,double>") -> DataFrame:
    """files (path, value: the whole log): model folder, shard, seconds and samples of the last finished progress line, metrics.

    `progress d/t elapsed=s` counts where d = t. Logs without a metrics line have null metrics.
    """
    lines = F.transform(F.split("value", "\n"), lambda x: F.trim(x))
    grab = lambda pattern, i=1: F.nullif(F.regexp_extract("value", pattern, i), F.lit(""))
    done = F.filter(lines, lambda x: x.rlike(r"progress (\d+)/\1 elapsed=[\d.]+"))
    last = F.try_element_at(done, F.lit(-1))
    json_line = F.get(F.filter(lines, lambda x: x.startswith("METRICS_JSON:")), F.lit(0))
    counts = grab(r"binary_counts[=:]\s*(\{[^}]*\})")
    return files.select(
        "path", grab(r"(?m)^LORA_DIR=(\S+)").alias("lora_dir"), grab(r"(?m)^SHARD_INDEX=(\d+)").cast("int").alias("shard_index"),
        F.regexp_extract(last, r"progress (\d+)/", 1).try_cast("long").alias("n_samples"), F.regexp_extract(last, r"elapsed=([\d.]+)", 1).try_cast("double").alias("wall_s"),
        F.from_json(F.replace(counts, F.lit("'"), F.lit('"')), "map<string,long>").alias("binary_counts"), F.from_json(F.substring(json_line, 14, 1 << 30), schema).alias("metrics"),
    )


def model_of(folder: Column) -> dict[str, Column]:
    """model, attack and seed out of a folder name <model>_<attack>_seed<n>; null where it has another form."""
    pattern = r"([A-Za-z0-9.\-]+)_([A-Za-z0-9\-]+)_seed(\d+)/*$"
    part = lambda i: F.nullif(F.regexp_extract(folder, pattern, i), F.lit(""))
    return {"model": part(1), "attack": part(2), "seed": part(3).cast("long")}


def training_curve(lines: DataFrame, steps_per_epoch: int) -> DataFrame:
    """Curves out of log lines (value) that hold a Python dict with an epoch: epoch, step, kind (train or eval) and loss."""
    d = F.regexp_replace(F.regexp_extract("value", r"(\{.*'epoch'.*\})", 1), "'", '"')
    r = F.from_json(d, "loss string, eval_loss string, epoch string")
    out = lines.select(r.alias("r")).where("r.epoch is not null")
    out = out.select(F.col("r.epoch").try_cast("double").alias("epoch"), F.col("r.loss").try_cast("double").alias("loss"), F.col("r.eval_loss").try_cast("double").alias("eval_loss"))
    kind = F.when(F.col("eval_loss").isNotNull(), "eval").when(F.col("loss").isNotNull(), "train")
    out = out.withColumn("kind", kind).where("kind is not null and epoch is not null")
    return out.select("epoch", F.bround(F.col("epoch") * steps_per_epoch).cast("long").alias("step"), "kind", F.coalesce("eval_loss", "loss").alias("loss"))


def result_files(files: DataFrame) -> DataFrame:
    """files (path, value: a JSON object of numbers) named <attack>_<group>_seed<n>.json as rows of model, metric and value."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    part = lambda i: F.nullif(F.regexp_extract(name, r"^([A-Za-z0-9]+)_([A-Za-z0-9]+)_seed(\d+)\.json$", i), F.lit(""))
    out = files.select(part(1).alias("attack"), part(2).alias("group"), part(3).cast("long").alias("seed"), F.explode(F.from_json("value", "map<string,double>")).alias("metric", "value"))
    return out.where("attack is not null")


def log_glob(folder: str, job: str | int, name: str = "*") -> str:
    """Where the array tasks of a batch job write their logs."""
    return f"{folder.rstrip('/')}/{name}_{job}_*.out"
