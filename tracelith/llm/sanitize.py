"""Personal data: fixed patterns, and information-theoretic sanitisation of the other words.

Base spans (email, ip, card, phone) are found by linear scans; the words outside them are terms. The
co-occurrence of a term t with a protected value e, over all distinct documents (documents of the same
terms and values count once), gives the disclosure PMI(t; e) / IC(e), in 0..1: how much of what
identifies e is told by t alone. P(e | t) is smoothed with PRIOR documents dealt as the corpus is, so
values that occur once are scored too. In documents that hold e, all occurrences of terms at or above
DISCLOSE are generalised, those of terms at or above REMOVE are removed.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, written

KINDS = ("email", "ip", "card", "phone")
#: Documents of the prior, and disclosure from which a term is generalised or removed.
PRIOR, DISCLOSE, REMOVE = 1, 0.8, 0.95
TERM = re.compile(r"[^\W_]{3,}")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts where a run of digits starts: from inside a run the same text would fail or be matched already.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind as in KINDS; end exclusive, in code points."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(a, b, "email") for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def _spans_text(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind == 'email' else value if kind == 'ip' else _digits(value)}"


FOUND = "row binary, doc_id string, spans string, copy binary, entities array<string>, terms array<struct<term: string, at: array<struct<start: int, stop: int>>>>, words binary"
#: Terms that a counting task holds before it passes its counts on.
HELD = 200_000


def _terms(text: str, spans: list[tuple[int, int, str]]) -> dict[str, list[tuple[int, int]]]:
    """Terms outside the base spans and where they stand."""
    out: dict[str, list[tuple[int, int]]] = {}
    i, reach = 0, 0
    for m in TERM.finditer(text):
        while i < len(spans) and spans[i][0] < m.end():
            reach = max(reach, spans[i][1])
            i += 1
        if m.start() >= reach:
            out.setdefault(m[0].lower(), []).append(m.span())
    return out


def _detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    had: set[bytes] = set()
    for b in batches:
        rows = []
        for row, doc, text in zip(b["row"], b["doc_id"], b["text"]):
            spans = base_spans(text) if text else []
            at = _terms(text, spans) if spans else dict.fromkeys(x.lower() for x in set(TERM.findall(text or "")))
            entities = sorted({_entity(kind, text[a:z]) for a, z, kind in spans})
            words = "\n".join(sorted(at)).encode("utf-8", "surrogatepass")
            key = words + b"\0" + "\n".join(entities).encode("utf-8", "surrogatepass")
            copy = hashlib.blake2b(key, digest_size=16).digest()
            # A task passes on the words of copies once.
            new = bool(at) and copy not in had
            if new:
                had.add(copy)
            rows.append((row, doc, _spans_text(spans), copy, entities, list(at.items()) if spans else [], zlib.compress(words, 1) if new else None))
        yield pd.DataFrame(rows, columns=["row", "doc_id", "spans", "copy", "entities", "terms", "words"])


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    got: Counter[str] = Counter()
    for b in batches:
        for words in b["words"]:
            got.update(zlib.decompress(words).decode("utf-8", "surrogatepass").split("\n"))
            if len(got) > HELD:
                yield pd.DataFrame(list(got.items()), columns=["term", "n"])
                got.clear()
    if got:
        yield pd.DataFrame(list(got.items()), columns=["term", "n"])


def _row_key() -> Column:
    """128 bits of hashes of doc_id and text, nulls marked."""
    a = F.xxhash64(F.col("doc_id").isNull(), F.col("text").isNull(), F.col("doc_id"), F.col("text"))
    b = F.xxhash64(F.lit(1), F.col("text"), F.col("doc_id"), F.col("text").isNull())
    return F.unhex(F.concat(*(F.lpad(F.hex(x), 16, "0") for x in (a, b))))


def detect(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base spans of every row, and the disclosing terms of its values.

    First frame: row, doc_id, spans (base, comma-joined kind:start:end). Second: row, start, stop, action
    (term or drop) of added spans. A row is keyed by a hash of the row itself, so repeated rows share one
    key and get the same spans. Null or empty text has no spans.
    """
    src = docs.select(
        _row_key().alias("row"), F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    found = written(src.mapInPandas(lean(_detect), FOUND), "spans")
    new = found.where("words is not null")
    total = F.broadcast(new.agg(F.count_distinct("copy").alias("n")))  # one row
    n_t = written(new.select("copy", "words").dropDuplicates(["copy"]).select("words").mapInPandas(lean(_count), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t")), "terms")
    # Values of the same documents score alike, so they are one group: documents of many values cost no more than their groups.
    holds = new.select("copy", F.explode("entities").alias("entity")).distinct()
    groups = holds.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), F.bit_xor(F.xxhash64("copy")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), F.col("copy"))).alias("y"))
    group = ["n_e", "x", "y"]
    held = written(holds.join(groups, "entity").select("copy", *group).distinct().crossJoin(total), "groups")
    # n_te is n_e at most, so terms of more documents than this can't reach DISCLOSE.
    most = F.col("n_e") * (1 + PRIOR / F.col("n")) * F.pow(F.col("n") / F.col("n_e"), F.lit(1 - DISCLOSE)) * (1 + 1e-9) - PRIOR
    terms = new.where(F.size("entities") > 0).select("copy", F.explode("terms.term").alias("term")).distinct()
    pairs = written(terms.join(n_t, "term").join(held.withColumn("most", most), "copy").where("n_t <= most").select("copy", "term", "n_t", "n", *group), "pairs")
    scored = pairs.groupBy(*group, "term").agg(F.count(F.lit(1)).alias("n_te"), F.max("n_t").alias("n_t"), F.max("n").alias("n"))
    ic = F.log(F.col("n") / F.col("n_e"))
    told = (F.col("n_te") + PRIOR * F.col("n_e") / F.col("n")) / (F.col("n_t") + PRIOR)  # P(e | t)
    pmi = F.log(told * F.col("n") / F.col("n_e"))
    # An entity in every document identifies nothing; try_divide gives null there.
    tell = scored.withColumn("disclosure", F.try_divide(pmi, ic)).where(F.col("disclosure") >= DISCLOSE)
    tell = tell.select(*group, "term", F.when(F.col("disclosure") >= REMOVE, "drop").otherwise("term").alias("action"))
    marks = written(pairs.join(tell, [*group, "term"]).groupBy("copy", "term").agg(F.min("action").alias("action")), "telling")
    stand = found.where(F.size("entities") > 0).select("row", "copy", F.explode("terms").alias("t")).select("row", "copy", "t.term", "t.at")
    added = stand.join(marks, ["copy", "term"]).select("row", "action", F.explode("at").alias("at")).select("row", "at.start", "at.stop", "action").distinct()
    # Ids travel as text: beside nulls pandas would make them floats.
    return found.select("row", F.col("doc_id").cast("long").alias("doc_id"), "spans"), added


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, sha256 of the base spans and all spans, of every row of docs (doc_id, text).

    Null and empty texts have no spans; repeated rows give a row each with the same spans; rows that share a
    doc_id or have none are told apart by their texts. Other columns are not read. An empty table gives an empty one.
    """
    found, added = detect(docs)
    more = added.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "action"))).alias("more"))
    out = found.join(more, "row", "left")
    parts = F.when(F.col("spans") == "", F.array().cast("array<string>")).otherwise(F.split("spans", ","))
    of = lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("start"), F.split(x, ":")[2].cast("int").alias("stop"), F.split(x, ":")[0].alias("kind"))
    extra = F.transform(F.coalesce("more", F.array()), lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), m["action"].alias("kind")))
    both = F.array_sort(F.concat(F.transform("base", lambda x: F.struct(x["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).cast("int").alias("o"), x["stop"].alias("stop"), x["kind"].alias("kind"))), F.transform(extra, lambda x: F.struct(x["start"].alias("start"), F.lit(9).alias("o"), x["stop"].alias("stop"), x["kind"].alias("kind")))))
    out = out.withColumn("base", F.transform(parts, of))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select(
        "doc_id", *map(count, KINDS), F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(both, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",").alias("spans"),
    )


def sanitize(docs: DataFrame) -> DataFrame:
    """docs with the texts' spans replaced: base kinds by [KIND], disclosing terms by [TERM] or nothing.

    Base spans are found again in place, so only rows with added spans are joined. Overlapping spans
    merge under the first one's mark. All columns stay; n_chars, if there, is counted again.
    """
    _, added = detect(docs)
    more = added.groupBy("row").agg(F.collect_list(F.struct("start", "stop", "action")).alias("more")).withColumnRenamed("row", "_row")
    keyed = docs.withColumn("_row", _row_key()).join(more, "_row", "left")

    @F.pandas_udf("string")
    def mask(text: pd.Series, more: pd.Series) -> pd.Series:
        out = []
        for t, m in zip(text, more):
            if not t:
                out.append(t)
                continue
            spans = base_spans(t) + ([(x["start"], x["stop"], x["action"]) for x in m] if m is not None else [])
            got, at = [], 0
            for a, z, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
                if a >= at:
                    got += [t[at:a], "" if kind == "drop" else f"[{kind.upper()}]"]
                at = max(at, z)
            out.append("".join(got) + t[at:])
        return pd.Series(out)

    out = keyed.withColumn("text", mask("text", "more"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)
