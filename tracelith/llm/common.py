"""Shared helpers: the cluster's shared folder, written intermediate tables, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What `[^\x20\x09-\x0D]+` leaves out of words.
SEPARATORS = " \t\n\x0b\x0c\r"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_LOCAL: dict[str, str] = {}
#: Of the tables of components(): files at least, where there are partitions for them, and edges that come on a file.
LEAST_FILES, EDGES_A_FILE = 8, 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, with the scheme of Spark's default file system if it names none.

    Only where that is unset on a local master (tests), a temporary folder; unset on a cluster is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        path = _LOCAL.setdefault(app, "") or "file://" + tempfile.mkdtemp(prefix="tracelith-")
        _LOCAL[app] = path
    if "://" not in path and not path.startswith("file:"):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        path = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tracelith/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    # Shuffle files go as soon as what they led to is written, not when the driver happens to collect garbage.
    old = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if old is None else spark.conf.set(CLEANUP, old)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables whose successors are written; nothing may read them any more."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(t._written_to)
        p.getFileSystem(conf).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keys(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with a long _key of its own for every distinct row (doc_id, text), and whether that is another than doc_id.

    Keys follow the order of doc_id, null ids last. Only where a doc_id is null or has different texts,
    doc_id itself is no key. Equal rows share a key.
    """
    row = F.xxhash64("doc_id", "text")
    mixed = docs.groupBy("doc_id").agg(F.min(row).alias("low"), F.max(row).alias("high")).where("doc_id is null or low <> high")
    if mixed.isEmpty():
        return docs.withColumn("_key", F.col("doc_id").cast("long")), False
    order = [F.asc_nulls_last("doc_id"), F.asc("_row")]
    rows = docs.select("doc_id", row.alias("_row")).distinct()
    rows = rows.repartitionByRange(parts(docs.sparkSession), *order).sortWithinPartitions(*order)
    # Written, so that the ids are the same wherever they are read.
    keys = written(rows.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_hash"), F.monotonically_increasing_id().alias("_key")), "keys")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_hash"))
    return docs.withColumn("_row", row).join(keys, same).drop("_row", "_id", "_hash"), True


def parts(spark: SparkSession, at_least: int = 12) -> int:
    """Reducers for hashed blobs: follows the session's shuffle partitions."""
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges as (node, component), component = smallest node reachable.

    Alternating large-star and small-star rounds (Kiveris et al. 2014); every round is two
    aggregations and joins over edges and is written to the shared folder. Nodes without edges are absent.
    """
    e = written(
        edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where("u <> v").distinct(),
        "edges",
    )
    n = e.count()
    # Rounds write many tables; a file for each of many shuffle partitions costs more than the few edges in it, and a
    # process that an executor forks for a file (chmod, on a local folder) shows the executor's memory twice for that moment.
    few = max(LEAST_FILES, -(-2 * n // EDGES_A_FILE))
    while n:
        # Large star: every neighbour above u is linked to the smallest of u and its neighbours. The minima are
        # written, so that both sides of the join are plain shuffles and a hub's rows can be split.
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(few), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large.coalesce(few), "large")
        # Small star: every neighbour below u, and u, are linked to the smallest of them.
        small_low = written(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(few), "low")
        small = (
            large.join(small_low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_low.select("u", F.col("m").alias("v")))
        ).where("u <> v").distinct()
        nxt = written(small.coalesce(few), "edges")
        m = nxt.count()
        same = m == n and nxt.join(e, ["u", "v"], "left_anti").isEmpty()
        discard(e, low, large, small_low)
        e, n = nxt, m
        if same:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct().coalesce(few)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run of mapInArrow or mapInPandas. Workers outlive their tasks, beside those of later steps: they give back what a task freed."""

    def task(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return task


def give_back() -> None:
    """Return the worker's free memory to the system, where its allocators can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, whatever their Python path is.

    Arrow batches are kept small where the session has Spark's default: a worker holds a few copies of one, and
    texts are long, chunks and packed spans megabytes a row. A size of the user's own stays.
    """
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, str(8 << 20))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    package = Path(__file__).resolve().parent.parent
    out = Path(tempfile.mkdtemp(prefix="tracelith-")) / "tracelith.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(out))
