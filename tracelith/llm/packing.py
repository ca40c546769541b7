"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's full windows leave at once; its
rest goes best-fit into an open window. When none fits, the fullest window is topped up with a cut
of the rest and emitted. At a partition's end the open windows are cut into runs of power-of-two
length, and a tree of merges over FAN_IN neighbouring partitions each joins equal runs, as carries in
binary addition, into full windows, which leave the tree; what stays has power-of-two lengths, so no
sequence needs padding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW, OPEN, FAN_IN = 2048, 32, 64
END_ID = 1
SPECIAL = {"<|endoftext|>"}
_KINDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
SCHEMA = pa.schema([*((c, pa.int64()) for c in _KINDS), ("run", pa.int32()), ("part", pa.int64())])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, run int, part long"


@cache
def _encoder(json_path: str, ranks_path: str):
    """Text to ids as the tokenizers file gives them.

    The rank file holds the same vocabulary and is encoded several times faster; texts that spell a
    special token take the tokenizers library, which alone recognises those.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact: list[Tokenizer] = []

    def encode(text: str) -> list[int]:
        if any(s in text for s in SPECIAL):
            if not exact:  # few texts ask for it, and each worker would hold it
                exact.append(Tokenizer.from_file(json_path))
            return exact[0].encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


class _Packer:
    """Open windows of one partition. A window is [used, pieces]; a piece is (doc, start, ids bytes, doc tokens)."""

    def __init__(self, part: int) -> None:
        self.windows: list[list] = []
        self.part, self.next, self.rows = part, 0, []

    def emit(self, pieces: list, run: int) -> None:
        seq, at = (self.part << 32) | self.next, 0
        self.next += 1
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, seq, at, run, self.part))
            at += len(ids) // 4

    def add(self, doc: int, ids: bytes) -> None:
        total, at = len(ids) // 4, 0
        while total - at >= WINDOW:
            self.emit([(doc, at, ids[4 * at : 4 * (at + WINDOW)], total)], 0)
            at += WINDOW
        if at == total:
            return
        need = total - at
        fits = [w for w in self.windows if WINDOW - w[0] >= need]
        if not fits and len(self.windows) >= OPEN:
            full = max(self.windows, key=lambda w: w[0])
            room = WINDOW - full[0]
            full[1].append((doc, at, ids[4 * at : 4 * (at + room)], total))
            self.emit(full[1], 0)
            self.windows.remove(full)
            at, need = at + room, need - room
            fits = [w for w in self.windows if WINDOW - w[0] >= need]
        if fits:
            best = max(fits, key=lambda w: w[0])
        else:
            self.windows.append(best := [0, []])
        best[0] += need
        best[1].append((doc, at, ids[4 * at :], total))
        if best[0] == WINDOW:
            self.emit(best[1], 0)
            self.windows.remove(best)

    def close(self) -> None:
        """Cut what is open into full windows and runs of distinct power-of-two lengths."""
        flat = [p for w in self.windows for p in w[1]]
        left, self.windows = sum(len(p[2]) // 4 for p in flat), []
        while left:
            size = WINDOW if left >= WINDOW else 1 << (left.bit_length() - 1)
            take, got = size, []
            while take:
                doc, start, ids, total = flat[0]
                n = min(take, len(ids) // 4)
                got.append((doc, start, ids[: 4 * n], total))
                if 4 * n == len(ids):
                    flat.pop(0)
                else:
                    flat[0] = (doc, start + n, ids[4 * n :], total)
                take -= n
            self.emit(got, 0 if size == WINDOW else size)
            left -= size


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone; repeated rows and rows without a doc_id are packed each on
    their own; an empty table gives no pieces. Other columns are not read.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import array

        from pyspark import TaskContext

        packer, encode = _Packer(TaskContext.get().partitionId()), _encoder(json_path, ranks_path)
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = encode(text) if text else []
                ids.append(END_ID)
                packer.add(doc, array.array("I", ids).tobytes())
            if packer.rows:
                yield _table(packer.rows).to_batches()[0]
                packer.rows = []
        packer.close()
        if packer.rows:
            yield _table(packer.rows).to_batches()[0]

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(src.mapInArrow(pack, PIECES), "pieces")
    done = pieces.where("run = 0")
    runs = pieces.where("run > 0")
    while runs.agg(F.max("part")).first()[0]:
        merged = written(runs.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("part").applyInArrow(_merge, PIECES), "runs")
        # Full windows leave; only runs go on, so a merge's input doesn't depend on the data's size.
        done = done.unionByName(merged.where("run = 0"))
        runs = merged.where("run > 0")
    return done.unionByName(runs).select(*_KINDS)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)


def _merge(key: tuple, runs: pa.Table) -> pa.Table:
    """Join equal runs of FAN_IN neighbouring parts into larger ones, up to full windows (run 0); ids don't change.

    A group has at most FAN_IN parts of at most 11 runs each.
    """
    held: dict[tuple[int, int], list[tuple]] = {}
    for r in zip(*(runs.column(c).to_pylist() for c in SCHEMA.names)):
        held.setdefault((r[7], r[5]), []).append(r)
    by_size: dict[int, list[list[tuple]]] = {1 << k: [] for k in range(12)}
    for size, seq in sorted(held):
        by_size[size].append(sorted(held[size, seq], key=lambda r: r[6]))
    out: list[tuple] = []
    for k in range(12):
        size, at = 1 << k, by_size[1 << k]
        while size < WINDOW and len(at) >= 2:
            x, y = at.pop(0), at.pop(0)
            by_size[2 * size].append(x + [(*r[:6], r[6] + size, *r[7:]) for r in y])
        for pieces in at:
            out += [(*r[:5], pieces[0][5], r[6], 0 if size == WINDOW else size, key[0].as_py()) for r in pieces]
    return _table(out)
