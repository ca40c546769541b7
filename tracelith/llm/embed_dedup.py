"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors are projected on fixed random directions; PROJECTIONS quantised projections make a
bucket key, in TABLES independent tables. Vectors that share a bucket are compared by exact cosine in
double precision. Equal vectors are one class, compared once. At cosine 0.95 a pair (distance 0.316)
shares a given bucket with probability 0.874 ** 16 = 0.116, so 24 tables find 95 % of pairs at the
very threshold and more above it; unrelated pairs meet with probability 1e-5 a table.

Only class numbers travel by bucket, 16 bytes a table. Buckets of up to SMALL classes list their pairs,
each pair once whatever it shares; larger ones are cut into pairs of blocks, which give counts and a
spanning forest of the links, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, parts, written

WIDTH, PROJECTIONS, TABLES, SEED = 2.0, 16, 24, 20240229
#: Classes of a bucket whose pairs are listed, and classes in a block of a larger one.
SMALL, BLOCK = 32, 512


def _units(col: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double precision) of the rows that can link, by dimension."""
    if not len(col):
        return
    values = col.values.to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = col.offsets.to_numpy()
    size = np.diff(offsets)
    size[col.is_null().to_numpy(zero_copy_only=False)] = 0
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        m = values[offsets[rows][:, None] + np.arange(n)]
        with np.errstate(invalid="ignore"):
            top = np.abs(m).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        m = m[good] / top[good, None]
        yield rows[good], m / np.sqrt((m * m).sum(axis=1))[:, None]


def _keys(unit: np.ndarray) -> np.ndarray:
    """Bucket keys (vectors by TABLES) of unit vectors of one dimension."""
    rng = np.random.default_rng([SEED, unit.shape[1]])
    directions = rng.standard_normal((unit.shape[1], TABLES * PROJECTIONS))
    shift = rng.uniform(0, WIDTH, TABLES * PROJECTIONS)
    cells = np.floor((unit @ directions + shift) / WIDTH).astype(np.int64).reshape(len(unit), TABLES, PROJECTIONS)
    mix = rng.integers(1, 2**62, (TABLES, PROJECTIONS)) | 1
    return (cells * mix).sum(axis=2) ^ np.int64(unit.shape[1])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, embedding and class of every row; the class is a 128-bit hash of the unit vector, null if it can't link."""
    for b in batches:
        cls: list[bytes | None] = [None] * len(b)
        for rows, unit in _units(b.column("embedding")):
            for i, u in zip(rows.tolist(), unit):
                cls[i] = hashlib.blake2b(u.tobytes(), digest_size=16).digest()
        yield pa.record_batch([b.column("vec_id"), b.column("embedding"), pa.array(cls, pa.binary())], names=["vec_id", "embedding", "cls"])


def _slots(buckets: int):
    """Packed (slot, node) pairs by bucket; a slot is a bucket key with its table."""
    schema = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column("node").to_numpy()
            for rows, unit in _units(b.column("embedding")):
                slot = (_keys(unit) * np.int64(0x5851F42D4C957F2D) + np.arange(TABLES)).ravel()
                slot = (slot ^ (slot >> np.int64(29))) * np.int64(0x2545F4914F6CDD1D)
                pack = np.stack([slot, np.repeat(node[rows], TABLES)], axis=1)
                to = (slot.view(np.uint64) >> np.uint64(33)) % np.uint64(buckets)
                order = np.argsort(to, kind="stable")
                pack, cut = pack[order], np.searchsorted(to[order], np.arange(buckets + 1))
                at = np.flatnonzero(cut[1:] > cut[:-1])
                yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array([pack[cut[k] : cut[k + 1]].tobytes() for k in at], pa.binary())], schema=schema)

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a reducer's buckets (each whole in one task) the slots that several classes share; 16 bytes a member."""
    schema = pa.schema([("slot", pa.int64()), ("node", pa.int64()), ("size", pa.int64())])
    held: dict[int, list[bytes]] = {}
    for b in batches:
        for k, blob in zip(b.column("bucket").to_pylist(), b.column("blob").to_pylist()):
            held.setdefault(k, []).append(blob)
    for k in list(held):
        x = np.frombuffer(b"".join(held.pop(k)), np.int64).reshape(-1, 2)
        x = x[np.argsort(x[:, 0], kind="stable")]
        start = np.flatnonzero(np.r_[True, x[1:, 0] != x[:-1, 0]])
        size = np.diff(np.r_[start, len(x)])
        x, size = x[np.repeat(size > 1, size)], np.repeat(size[size > 1], size[size > 1])
        for lo in range(0, len(x), 1 << 18):
            part = slice(lo, lo + (1 << 18))
            yield pa.record_batch([pa.array(x[part, 0]), pa.array(x[part, 1]), pa.array(size[part])], schema=schema)


FOUND = "node long, links long, to long"
FOUND_SCHEMA = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])


def _matrix(col: pa.ListArray) -> np.ndarray | None:
    got = list(_units(col))
    return got[0][1] if len(got) == 1 and len(got[0][0]) == len(col) else None


def _check_pairs(threshold: float):
    """Links of listed pairs: a row for each end, with the copies that the other one has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            units = {}
            for side in "ab":
                out: list[np.ndarray | None] = [None] * len(b)
                for rows, unit in _units(b.column(f"{side}_embedding")):
                    for i, u in zip(rows.tolist(), unit):
                        out[i] = u
                units[side] = out
            ok = [i for i, (x, y) in enumerate(zip(units["a"], units["b"])) if len(x) == len(y) and float(x @ y) >= threshold]
            if ok:
                x, y, nx, ny = (b.column(c).take(pa.array(ok)) for c in ("a", "b", "a_n", "b_n"))
                yield pa.record_batch([x, ny, y], schema=FOUND_SCHEMA)
                yield pa.record_batch([y, nx, pa.nulls(len(ok), pa.int64())], schema=FOUND_SCHEMA)

    return run


def _compare(x: list[tuple], y: list[tuple] | None, slot: int, threshold: float) -> Iterator[tuple]:
    """(class, links gained, other class of a spanning link) for the pairs inside x, or between x and y.

    Rows are (node, n, unit vector, its large slots). A pair counts in the first large slot that it shares.
    """
    a, b = x, x if y is None else y
    if len({len(r[2]) for r in [*a, *b]}) > 1:  # dimensions that met by chance
        for n in {len(r[2]) for r in a}:
            same = lambda rows: [r for r in rows if len(r[2]) == n]  # noqa: B023, E731
            if same(a) and same(b):
                yield from _compare(same(a), None if y is None else same(b), slot, threshold)
        return
    link = np.stack([r[2] for r in a]) @ np.stack([r[2] for r in b]).T >= threshold
    if y is None:
        link = np.triu(link, 1)
    before = sorted({s for r in a for s in r[3] if s < slot} & {s for r in b for s in r[3] if s < slot})
    if before:
        at = {s: k for k, s in enumerate(before)}

        def has(rows: list[tuple]) -> np.ndarray:
            m = np.zeros((len(rows), len(before)), np.float32)
            for i, r in enumerate(rows):
                m[i, [at[s] for s in r[3] if s in at]] = 1
            return m

        link &= has(a) @ has(b).T == 0
    i, j = np.nonzero(link)
    if not len(i):
        return
    ca, cb, na, nb = ([r[k] for r in rows] for rows, k in ((a, 0), (b, 0), (a, 1), (b, 1)))
    gain_a, gain_b = np.bincount(i, np.array(nb)[j], len(a)), np.bincount(j, np.array(na)[i], len(b))
    # A spanning forest of these links is enough for components.
    root: dict = {}

    def find(k):
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for p, q in zip(i.tolist(), j.tolist()):
        if (r := find(ca[p])) != (s := find(cb[q])):
            root[s] = r
            yield ca[p], 0, cb[q]
    for rows, gain in ((ca, gain_a), (cb, gain_b)):
        for k in np.flatnonzero(gain):
            yield rows[k], int(gain[k]), None


def _check_blocks(threshold: float):
    """Sorted rows, a block pair after another; a block pair has about 2 * BLOCK rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides, out = None, ([], []), []

        def close() -> None:
            if sides[0] and sides[1]:
                out.extend(_compare(sides[0], sides[1], key[0], threshold))
            elif len(sides[0]) > 1 and key[1] == key[2]:
                out.extend(_compare(sides[0], None, key[0], threshold))

        for b in batches:
            unit: list = [None] * len(b)
            for rows, m in _units(b.column("embedding")):
                for i, u in zip(rows.tolist(), m):
                    unit[i] = u
            for slot, lo, hi, block, node, n, large, u in zip(*(b.column(c).to_pylist() for c in ("slot", "lo", "hi", "block", "node", "n", "large")), unit):
                if key != (slot, lo, hi):
                    close()
                    key, sides = (slot, lo, hi), ([], [])
                sides[int(lo < hi and block == hi)].append((node, n, u, large))
            if len(out) > 10_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=FOUND_SCHEMA)
                out.clear()
        close()
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=FOUND_SCHEMA)

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding; other columns are not read).

    Null, empty, zero and non-finite vectors, and those with null components, link with nothing. Vectors of
    different dimensions never link. Rows that repeat a vec_id or have none count as vectors of their own;
    component_id is the smallest vec_id of the component, null if it has none. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    hashed = src.mapInArrow(_classes, f"vec_id long, embedding {kind}, cls binary")
    classes = hashed.where("cls is not null").groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"), F.first("embedding").alias("embedding"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    buckets = parts(spark)
    slots = classes.select("node", "embedding").mapInArrow(_slots(buckets), "bucket int, blob binary").repartition(buckets, "bucket")
    mates = written(slots.mapInArrow(_gather, "slot long, node long, size long"), "mates")
    vec = classes.select("node", "n", "embedding")
    large = written(mates.where(F.col("size") > SMALL).groupBy("node").agg(F.array_sort(F.collect_set("slot")).alias("large")), "large")
    few = mates.where(F.col("size") <= SMALL).select("slot", "node").join(large, "node", "left")
    other = few.select("slot", F.col("node").alias("b"), F.col("large").alias("large_b"))
    # Pairs that share a large slot are counted there.
    apart = ~F.coalesce(F.arrays_overlap("large", "large_b"), F.lit(False))
    pairs = written(few.join(other, "slot").where((F.col("node") < F.col("b")) & apart).select(F.col("node").alias("a"), "b").distinct(), "pairs")
    for side in "ab":
        pairs = pairs.join(vec.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("embedding").alias(f"{side}_embedding")), side)
    found = written(pairs.mapInArrow(_check_pairs(threshold), FOUND), "links")
    nb = F.ceil(F.col("size") / BLOCK).cast("int")
    held = mates.where(F.col("size") > SMALL).withColumn("nb", nb).withColumn("block", F.pmod(F.xxhash64("node"), "nb").cast("int"))
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    held = held.select("node", "slot", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    rows = held.join(vec, "node").join(large, "node").repartition("slot", "lo", "hi").sortWithinPartitions("slot", "lo", "hi")
    more = written(rows.select("slot", "lo", "hi", "block", "node", "n", "large", "embedding").mapInArrow(_check_blocks(threshold), FOUND), "links")
    discard(mates, large)
    found = found.union(more)
    gained = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = written(components(found.where("to is not null").select(F.col("node").alias("a"), F.col("to").alias("b"))), "comp")
    info = classes.select("cls", "node", "low", "n").join(gained, "node", "left").join(comp, "node", "left")
    info = info.select("cls", "low", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = info.groupBy("component").agg(F.min("low").alias("component_id"))
    info = written(info.join(least, "component").select("cls", "n_links", "component_id"), "info")
    out = hashed.select("vec_id", "cls").join(info, "cls", "left")
    comp_id = F.when(F.col("cls").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(True)).alias("kept"))
