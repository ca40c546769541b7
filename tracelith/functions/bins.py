"""Bin labels and label parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_bin(c: Column) -> Column:
    return F.when(c.isNull(), "null").when(c < 0, "<0").when(c == 0, "0").when(c == 1, "1").when(c <= 3, "2-3").when(c <= 7, "4-7").otherwise("8+")


def score_bin(c: Column) -> Column:
    out = F.when(c.isNull() | F.isnan(c), "null").when(F.abs(c) <= 1e-12, "0").when(F.abs(c - 1) <= 1e-12, "1").when(c < 0, "<0").when(c > 1, ">1")
    for hi, name in ((0.2, "(0,0.2]"), (0.5, "(0.2,0.5]"), (0.8, "(0.5,0.8]"), (0.95, "(0.8,0.95]")):
        out = out.when(c <= hi, name)
    return out.otherwise("(0.95,1)")


def edge_bin(c: Column, edges: list[float]) -> Column:
    out = F.when(c.isNull(), "null").when(c <= 0, "<=0")
    low = 0.0
    for e in edges:
        out = out.when(c <= e, f"({low:g},{e:g}]")
        low = e
    return out.otherwise(f">{low:g}")


def binary_bin(c: Column) -> Column:
    return F.when(c.isNull(), "null").when(c == 0, "0").when(c == 1, "1").otherwise("other")


def candidate_bin(n: Column) -> Column:
    return F.when(n <= 8, "<=8").when(n <= 16, "9-16").when(n <= 24, "17-24").when(n <= 32, "25-32").otherwise(">32")


def attacker_bin(n: Column, strict: bool = False) -> Column:
    """strict: only 4 itself is in 2-4, as the metrics have it; 2 and 3 then fall to 5-8."""
    second = (n == 4) if strict else (n <= 4)
    return F.when(n <= 1, "0-1").when(second, "2-4").when(n <= 8, "5-8").when(n <= 14, "9-14").otherwise(">14")


def parse_label(text: Column) -> Column:
    """1 if the word attack occurs anywhere, else 0 for benign, else the first single digit 0 or 1, else null."""
    digit = F.regexp_extract(text, r"\b([01])\b", 1)
    return F.when(text.rlike(r"(?i)\battack\b"), 1).when(text.rlike(r"(?i)\bbenign\b"), 0).when(digit != "", digit.cast("int"))


def first_label(text: Column) -> Column:
    """ATTACK or BENIGN, whichever occurs first, else UNKNOWN."""
    low = F.lower(text)
    a, b = F.locate("attack", low), F.locate("benign", low)
    return F.when((a > 0) & ((b == 0) | (a < b)), "ATTACK").when(b > 0, "BENIGN").otherwise("UNKNOWN")


def id_list(text: Column) -> Column:
    """Trimmed distinct ids of the first flat JSON array in the text; null if there is none."""
    raw = F.regexp_extract(text, r"\[[^\[\]]*\]", 0)
    return F.when(raw != "", F.array_distinct(F.transform(F.from_json(raw, "array<string>"), lambda x: F.trim(x))))


def error_type(gold: Column, pred: Column) -> Column:
    return F.when(gold == 1, F.when(pred == 1, "tp").otherwise("fn")).otherwise(F.when(pred == 1, "fp").otherwise("tn"))


def shown_bin(n: Column) -> Column:
    """Candidates by how many a prompt shows."""
    return F.when(n <= 10, "<=10").when(n <= 20, "11-20").when(n <= 40, "21-40").otherwise(">40")


def bin_for(name: str, kind: str, edges: dict[str, list[float]], scores: tuple[str, ...] = ("msg_catch_",), counts: tuple[str, ...] = ("ctx_n_", "n_")) -> Column:
    """The bins that a feature's name and type call for: edges given for it, scores, counts, binary, else edges at 1, 10 and 100."""
    c = F.col(name)
    if name in edges:
        return edge_bin(c, edges[name])
    if kind == "boolean" or name.startswith(("is_", "has_", "avail_")):
        return binary_bin(c.cast("int"))
    if name.startswith(scores) or name.endswith(("_ratio", "_frac", "_score")):
        return score_bin(c)
    if name.startswith(counts) or kind in ("int", "bigint", "smallint", "tinyint"):
        return count_bin(c)
    return edge_bin(c, [1, 10, 100])
