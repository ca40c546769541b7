"""Quality rules judged per host, with native DataFrame functions only.

Rule failures of documents are aggregated by domain, the domains' failure rates are shrunk with an
empirical beta prior, and the host verdicts are joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, written

SYMBOLS = "#*$%&|<>"
#: Rules of a document that count against its host, besides the base rules.
RULES = ("base", "symbols", "dup_lines")
#: A host with a shrunken rate above REJECT in any rule goes; above SUSPECT its failing documents go.
REJECT, SUSPECT = 0.9, 0.6
#: Least and most documents that the prior counts as.
LEAST, MOST = 2.0, 1000.0


def _repeat_words(words: Column) -> Column:
    """Word positions inside 3-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hash. Texts whose windows are all distinct stop after one hash-set
    pass; others sort (hash, position) pairs, so the cost is n log n, whatever repeats.
    """

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            return F.array_sort(
                F.transform(
                    F.filter(p, lambda x, j: x["h"].eqNullSafe(F.get(p, j + 1)["h"]) | x["h"].eqNullSafe(F.get(p, j - 1)["h"])),
                    lambda x: x["i"],
                )
            )

        def count(s: Column) -> Column:
            steps = F.transform(s, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - x, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

        one = F.transform(F.array(pairs), lambda p: starts(p))
        return F.get(F.transform(one, count), F.lit(0))

    def of(w: Column) -> Column:
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(
            F.get(
                F.transform(F.array(hashed(w)), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))),
                F.lit(0),
            )
        )

    return F.get(F.transform(F.array(words), of), F.lit(0))


def _row_key() -> list[Column]:
    """A row's two independent 64-bit hashes, nulls marked."""
    marks = [F.col(c).isNull() for c in ("doc_id", "text", "source")]
    cols = [F.col("doc_id"), F.col("text"), F.col("source")]
    return [F.xxhash64(*marks, *cols).alias("row"), F.xxhash64(F.lit(11), *reversed(cols), *marks).alias("row2")]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, host and the base counts of each document. Null text counts as no words; a null source is the host ''."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spaced = F.translate(text, SEPARATORS[1:], " " * 5)
    words = F.filter(F.split(spaced, " "), lambda w: w != "")
    solid = F.translate(text, SEPARATORS, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SEPARATORS, "") != "")
    n_lines = F.get(F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))), F.lit(0))
    stats = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r"))), F.lit(0))
    out = docs.select(
        "doc_id", *_row_key(),
        F.coalesce(F.lower(F.trim(F.col("source").cast("string"))), F.lit("")).alias("host"),
        stats.alias("w"),
        F.length(solid).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        n_lines.alias("l"),
    )
    return out.select(
        "doc_id", "row", "row2", "host", F.col("w.n").alias("n_words"), "word_chars", "n_symbols",
        (F.col("l.n") - F.col("l.d")).cast("long").alias("n_dup_lines"), F.col("l.n").cast("long").alias("n_lines"), F.col("w.r").alias("n_repeat_words"),
    )


def failures(measured: DataFrame) -> DataFrame:
    return measured.withColumns(
        {
            "f_base": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "f_symbols": 2 * F.col("n_symbols") > F.col("n_words"),
            "f_dup_lines": 10 * F.col("n_dup_lines") > 3 * F.greatest("n_lines", F.lit(1)),
        }
    )


def host_verdicts(failed: DataFrame) -> DataFrame:
    """One row per host: documents, shrunken rate of each rule, verdict pass, suspect or reject.

    The beta prior of each rule comes from the hosts' failures by beta-binomial moments: with the mean
    m = sum k / sum n, the weighted squares S = sum n (k / n - m)^2 exceed what sampling alone gives,
    m (1 - m) (hosts - 1), by the share rho of the variance that is the hosts' own; the prior's strength is
    1 / rho - 1, kept in LEAST..MOST. The rate is (k + m * strength) / (n + strength). Where nothing tells
    rho (hosts of one document each, or no spread beyond sampling), the strength is MOST.
    """
    hosts = failed.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.col(f"f_{r}").cast("long")).alias(f"k_{r}") for r in RULES)
    )
    sums = [F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("all"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares")]
    for r in RULES:
        sums += [F.sum(f"k_{r}").alias(f"t_{r}"), F.sum(F.col(f"k_{r}").cast("double") * F.col(f"k_{r}") / F.col("n")).alias(f"q_{r}")]
    out = hosts.join(F.broadcast(hosts.agg(*sums)))  # one row
    left = F.col("hosts") - 1
    spread = F.col("all") - F.col("squares") / F.col("all") - left
    for r in RULES:
        m = F.col(f"t_{r}") / F.col("all")
        own = F.try_divide(F.col(f"q_{r}") - F.col(f"t_{r}") * m, m * (1 - m)) - left
        told = (m > 0) & (m < 1) & (spread > 1e-9)
        # rho = own / spread, so 1 / rho - 1 = spread / own - 1.
        strength = F.when(told & (own * (MOST + 1) > spread), F.greatest(F.lit(LEAST), F.try_divide(spread, own) - 1)).otherwise(F.lit(MOST))
        strength = F.when((m > 0) & (m < 1), strength).otherwise(F.lit(MOST))
        out = out.withColumn(f"rate_{r}", (F.col(f"k_{r}") + m * strength) / (F.col("n") + strength))
    worst = F.greatest(*(F.col(f"rate_{r}") for r in RULES))
    return out.select(
        "host", "n", *(f"rate_{r}" for r in RULES),
        F.when(worst > REJECT, "reject").when(worst > SUSPECT, "suspect").otherwise("pass").alias("verdict"),
    )


def filter_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs that quality() keeps, all columns. Rows are told apart by 128 bits of hashes of doc_id, text and source."""
    keep = _judged(docs).where("kept").select(F.col("row").alias("_row"), F.col("row2").alias("_row2")).distinct()
    row, row2 = _row_key()
    keyed = docs.withColumns({"_row": row, "_row2": row2})
    return keyed.join(keep, ["_row", "_row2"], "left_semi").drop("_row", "_row2")


def quality(docs: DataFrame) -> DataFrame:
    """Counts, base_failed, kept and host_verdict of each row of docs (columns doc_id, text, source; others are not read).

    A null or empty text has no words and fails the base rules; repeated rows are judged one by one;
    an empty table gives an empty one. Only hosts that don't pass are joined back, by the planner's
    choice of broadcast (below its size limit) or a sort-merge join that adaptive execution splits on hot hosts.
    """
    return _judged(docs).drop("row", "row2")


def _judged(docs: DataFrame) -> DataFrame:
    failed = failures(written(measure(docs), "measured"))
    bad = written(host_verdicts(failed), "hosts").where("verdict <> 'pass'").select("host", F.col("verdict").alias("host_verdict"))
    out = failed.join(bad, "host", "left")
    verdict = F.coalesce("host_verdict", F.lit("pass"))
    soft = F.col("f_symbols") | F.col("f_dup_lines")
    keep = ~F.col("f_base") & ~(verdict == "reject") & ~((verdict == "suspect") & soft)
    return out.select(
        "doc_id", "row", "row2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.col("f_base").alias("base_failed"), keep.alias("kept"), verdict.alias("host_verdict"),
    )
