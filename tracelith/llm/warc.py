"""WARC archives: a writer with deduplicated payloads, and a salvage reader.

The reader walks gzip members (or plain records). After a failed check - a broken member, a bad record
header, a short block, a digest that doesn't match - it searches for the next valid member or version
line, recovers the later records and logs the bytes between as a quarantined gap. Inside a member the
search runs over the inflated bytes, also over those before a break or cut; such an inner gap has the
member's offsets and names the inflated bytes in its problem.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, written

MAGIC, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r?\n")
LEVEL = 1
#: An archive file is closed beyond this size, so that a reader's task stays small.
ROLL = 32 << 20
RECORDS = "path string, start long, stop long, record_id string, record_type string, refers_to string, target string, payload_digest string, payload_bytes long, payload binary, problem string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(record_id: str, target: str | None, payload: bytes | None, sha1: str, length: int, refers_to: str | None) -> bytes:
    """One record; a revisit (refers_to given) has the HTTP header only, with the full payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http if refers_to else http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if target:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", target))
    if refers_to:
        head += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at a version line and its end; ValueError says which check failed."""
    m = VERSION.match(data, at)
    if not m:
        raise ValueError("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise ValueError("header without end")
    fields = {}
    for line in data[m.end() : end].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        fields[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError):
        raise ValueError("no content length") from None
    start = end + 4
    if length < 0 or start + length > len(data):
        raise ValueError("block is short")
    if data[start + length : start + length + 4] != b"\r\n\r\n":
        raise ValueError("block has another length")
    block = data[start : start + length]
    http, _, body = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    kind = fields.get("warc-type", "")
    sha1 = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and sha1 and digest(body) != sha1:
        raise ValueError("digest doesn't match")
    record = {
        "record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": kind,
        "refers_to": fields.get("warc-refers-to", "").strip("<>") or None, "target": fields.get("warc-target-uri"),
        "payload_digest": sha1, "payload_bytes": int(size[1]) if size else len(body), "payload": body if kind == "response" else None, "problem": None,
    }
    return record, start + length + 4


class _Next:
    """Positions of the next gzip magic and version line; each is searched again only when it is passed."""

    def __init__(self, data: bytes) -> None:
        self.data, self.member, self.line = data, -1, -1

    def after(self, at: int) -> int:
        """The first of either behind `at`."""
        size = len(self.data)
        if self.member <= at:
            found = self.data.find(MAGIC, at + 1)
            self.member = found if found >= 0 else size
        if self.line <= at:
            m = VERSION.search(self.data, at + 1)
            self.line = m.start() if m else size
        return min(self.member, self.line)


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """The inflated bytes of the member at `at`, where it stops, and what broke it there, if anything did."""
    view, d, out, pos = memoryview(data), zlib.decompressobj(31), [], at
    try:  # most false magics break within the first bytes
        zlib.decompressobj(31).decompress(view[at : at + 512], 16)
    except zlib.error as e:
        return b"", at, f"bad member: {e}"
    try:
        while not d.eof and pos < len(data):
            # A broken step gives nothing of what it inflated, so a step after the last good state goes byte by byte.
            last = d.copy()
            out.append(d.decompress(view[pos : pos + (64 << 10)]))
            pos = min(len(data), pos + (64 << 10))
    except zlib.error as e:
        try:
            while pos < len(data):
                out.append(last.decompress(view[pos : pos + 1]))
                pos += 1
        except zlib.error:
            pass
        return b"".join(out), pos, f"bad member: {e}"
    if not d.eof:
        return b"".join(out), len(data), "member is cut off"
    return b"".join(out), pos - len(d.unused_data), None


def _records(data: bytes) -> Iterator[dict]:
    """The records of inflated bytes; a gap between them is a record with only its problem set."""
    at, gap, why, following = 0, None, "", _Next(data)
    while at < len(data):
        try:
            record, stop = parse_record(data, at)
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            if following.line <= at:
                following.after(at)
            at = following.line
            continue
        if gap is not None:
            yield {"problem": f"{why} (inflated bytes {gap} to {at})"}
            gap = None
        yield record
        at = stop
    if gap is not None:
        yield {"problem": f"{why} (inflated bytes {gap} to {len(data)})"}


def salvage(data: bytes) -> Iterator[tuple[int, int, dict]]:
    """(start, stop, record) over an archive, gzip members or plain; a gap is a record with only its problem set."""
    at, size, gap, why, following = 0, len(data), None, "", _Next(data)
    # Ids and digests of a broken member's records, and its end: they may stand in its stored blocks once
    # more, where a block's header can fall into one of the two.
    given, upto = set(), 0
    while at < size:
        broken = None
        try:
            if data[at : at + 3] == MAGIC:
                whole, stop, broken = _inflate(data, at)
                got = list(_records(whole))
                if not any(r["problem"] is None for r in got) and (broken or got):
                    raise ValueError(broken or got[0]["problem"].partition(" (")[0])
            else:
                record, stop = parse_record(data, at)
                if at < upto and not given.isdisjoint((record["record_id"], record["payload_digest"])):
                    raise ValueError("in a broken member")
                got = [record]
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            at = following.after(at)
            continue
        if gap is not None:
            yield gap, at, {"problem": why}
            gap = None
        if broken:
            # The break may show late, in what is the next member already: the search starts behind the magic.
            given, upto = {r[k] for r in got if not r["problem"] for k in ("record_id", "payload_digest") if r[k]}, stop
            stop = following.after(at)
        for record in got:
            yield at, stop, record
        if broken:
            gap, why = at, broken
        at = stop
    if gap is not None:
        yield gap, size, {"problem": why}


def _open(uri: str, mode: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    if mode == "w":
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return system.open_output_stream(path, compression=None)
    return system.open_input_stream(path, compression=None)


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) into archives under folder; returns their paths.

    Of rows with equal payloads of at least `least` bytes, the smallest page_id is a response and the
    others revisit it. Null html is an empty payload; a null url has no target. Of repeated page_ids
    with the same payload all rows are responses if that id is the smallest. Rows without a page_id are
    responses too and bear the record id urn:page:null. Other columns are not read.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("sha1"), F.length(payload).alias("n"))
    first = keyed.where(F.col("n") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last")
    revisits = written(keyed.where(F.col("n") >= least).join(first, "sha1").where("page_id <> first").select("page_id", "sha1", "first").distinct(), "revisits")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        t = TaskContext.get()
        stem, k, out, size, paths = f"{folder}/part-{t.partitionId():06d}-{t.taskAttemptId()}", 0, None, 0, []
        for b in batches:
            for page, url, html, sha1, first in zip(b["page_id"], b["url"], b["html"], b["sha1"], b["first"]):
                if out is None:
                    paths.append(f"{stem}-{k}.warc.gz")
                    out, k, size = _open(paths[-1], "w"), k + 1, 0
                data = (html or "").encode("utf-8", "surrogatepass")
                b32 = base64.b32encode(bytes.fromhex(sha1)).decode()
                member = _member(make_record(f"urn:page:{page}", url, data, b32, len(data), first and f"urn:page:{first}"))
                out.write(member)
                size += len(member)
                if size >= ROLL:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if paths:
            yield pd.DataFrame({"path": paths})

    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.sha1(payload).alias("sha1")
    ).join(revisits, ["page_id", "sha1"], "left")
    # Numbers as text: pandas would make them floats beside nulls.
    rows = rows.select(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("page_id"), "url", "html", "sha1", F.col("first").cast("string").alias("first"))
    # Paths come from finished attempts only; files of lost ones are never read.
    return written(rows.mapInPandas(write, "path string"), "archives")


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps (record_type null, problem set) of the archives in column path, one task for few files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for b in batches:
            for path in b["path"]:
                with _open(path, "r") as f:
                    data = f.read()
                rows, held = [], 0
                for start, stop, r in salvage(data):
                    r = {"path": path, "start": start, "stop": stop} | r
                    if not payloads:
                        r["payload"] = None
                    held += len(r.get("payload") or b"") + 500
                    rows.append(r)
                    if held > 8 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    n = max(1, min(10_000, paths.count()))
    return paths.repartition(n).mapInPandas(read, RECORDS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record read back from the written archives.

    One row per row of pages (page_id, url, html); see write_archives for nulls and repeated rows. An empty
    table gives an empty one.
    """
    spark = pages.sparkSession
    got = read_archives(write_archives(pages, new_path(spark, "warc"), least), payloads=False)
    number = lambda c: F.nullif(F.regexp_extract(c, r"urn:page:(-?\d+)", 1), F.lit(""))
    return got.where("problem is null").select(
        number("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("refers_to").isNotNull(), number("refers_to").cast("long")).alias("refers_to"),
    )
