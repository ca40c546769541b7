"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation
over the corpus' counts of vote patterns (3 ** labellers at most, whatever the corpus) estimates their
accuracies and each pattern's posterior. The posteriors of a bounded sample train a hashed linear
scorer, which scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Bits of the hashed weights; rows the scorer is fitted on, those with the least hash of id and text.
BITS, SAMPLE = 16, 4000
CACHE = 300_000
LABELLERS = ("symbols", "capitals", "shouting", "variety", "length", "function_words", "word_length", "lines")
#: Frequent function words of the corpus' languages.
FUNCTION_WORDS = frozenset(
    "the of and to in is that it for on with as by this be or at from are was "
    "der die das und in den von zu ist mit sich des auf für im dem nicht ein eine als "
    "le la les de des et un une du que qui en est pour dans par sur au pas "
    "el los las y que en del se por con para una su al lo como más".split()
)


def votes(text: str | None) -> str:
    """One character a labeller: g good, b bad, - no vote. Texts without words get no votes but on length."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return "".join("b" if x == "length" else "-" for x in LABELLERS)
    chars = sum(map(len, words))
    symbols = sum(map(text.count, "#*$%&|<>"))
    upper = sum(map(str.isupper, words))
    lines = [x for x in text.split("\n") if x.strip()]

    def vote(x: float, good: float, bad: float) -> str:
        """Small is good."""
        return "g" if x <= good else "b" if x >= bad else "-"

    out = {
        "symbols": vote(symbols / n, 0.05, 0.25),
        "capitals": vote(upper / n, 0.2, 0.5),
        "shouting": vote(text.count("!") / n, 0.05, 0.3),
        "variety": vote(-len(set(words)) / n, -0.4, -0.2) if n >= 20 else "-",
        "length": vote(-n, -50, -10),
        "function_words": vote(-sum(w.lower() in FUNCTION_WORDS for w in words) / n, -0.08, -0.01) if n >= 20 else "-",
        "word_length": vote(abs(chars / n - 5.5), 2.5, 6),
        "lines": vote((len(lines) - len(set(lines))) / max(1, len(lines)), 0.1, 0.3),
    }
    return "".join(out[x] for x in LABELLERS)


def fit_votes(patterns: list[str], counts: list[int], rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good documents, accuracies [labeller, good or bad, vote], posterior of good by pattern) by EM.

    Starts from a document being bad if any labeller says so; estimates are smoothed by one vote of each kind.
    """
    code = {"b": 0, "g": 1, "-": 2}
    v = np.array([[code[c] for c in p] for p in patterns], np.int64).reshape(len(patterns), len(LABELLERS))
    w = np.array(counts, float)
    post = np.where((v == 0).any(axis=1), 0.2, 0.9)
    share, acc = 0.5, np.zeros((len(LABELLERS), 2, 3))
    for _ in range(rounds):
        share = (w @ post + 1) / (w.sum() + 2)
        for j in range(len(LABELLERS)):
            for k in range(3):
                at = v[:, j] == k
                acc[j, 1, k] = w[at] @ post[at] + 1
                acc[j, 0, k] = w[at] @ (1 - post[at]) + 1
        acc /= acc.sum(axis=2, keepdims=True)
        # Abstaining says nothing about the class by itself.
        lg = np.log(share) - np.log(1 - share)
        for j in range(len(LABELLERS)):
            ratio = np.log(acc[j, 1]) - np.log(acc[j, 0])
            ratio[2] = 0
            lg = lg + ratio[v[:, j]]
        new = 1 / (1 + np.exp(-np.clip(lg, -30, 30)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return float(share), acc, post


class _Buckets(dict):
    """A word's hashed features: itself, its shape and its last punctuation."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > CACHE:
            self.clear()
        core = word.rstrip("!#*$%&|<>.,;:?")
        tail = word[len(core) :][:4]
        shape = "U" if word.isupper() and len(word) > 1 else "d" if any(c.isdigit() for c in word) else "w"
        mask = (1 << BITS) - 1
        got = self[word] = tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) & mask for x in (f"w {core.lower()}", f"s {shape} {min(len(word), 20)}", f"t {tail}"))
        return got


_buckets = _Buckets()


def features(text: str | None) -> list[int]:
    get = _buckets.__getitem__
    return sorted({b for w in set((text or "").split()) for b in get(w)})


def fit_scorer(rows: list[list[int]], target: np.ndarray, epochs: int = 8, rate: float = 0.5, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic scorer of 1 / sqrt(n)-scaled features, by gradient steps in a fixed order."""
    weights, bias = np.zeros(1 << BITS), 0.0
    order = np.random.default_rng(7).permutation(len(rows))
    for e in range(epochs):
        step = rate / (1 + e)
        for i in order:
            x = rows[i]
            if not x:
                continue
            scale = len(x) ** -0.5
            p = 1 / (1 + np.exp(-np.clip(bias + scale * weights[x].sum(), -30, 30)))
            g = p - target[i]
            weights[x] -= step * (g * scale + decay * weights[x])
            bias -= step * 0.1 * g
    return weights, float(bias)


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, votes, posterior, score and kept (score >= 0.5) of every row of docs (doc_id, text; others are not read).

    A row without words has no features: its score is its posterior. Repeated rows score alike; an empty
    table gives an empty one.
    """
    src = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "votes": [votes(t) for t in b["text"]]})

    voted = written(src.mapInPandas(vote, "doc_id string, votes string"), "votes")
    seen = voted.groupBy("votes").count().orderBy("votes").collect()  # at most 3 ** 8 patterns
    _, _, post = fit_votes([r[0] for r in seen], [r[1] for r in seen])
    of = {r[0]: float(p) for r, p in zip(seen, post)}

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"f": [features(t) for t in b["text"]], "p": [of[votes(t)] for t in b["text"]]})

    # The SAMPLE rows of least hash: a bound on the hash, one number, picks them in one more pass.
    h = F.xxhash64("doc_id", "text")
    bound = src.select(h.alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    fit = src.where(h <= F.lit(bound)).limit(SAMPLE).mapInPandas(sample, "f array<int>, p double").toPandas()
    rows = [list(x) for x in fit["f"]]
    order = sorted(range(len(rows)), key=lambda i: (rows[i], fit["p"].iloc[i]))
    weights, bias = fit_scorer([rows[i] for i in order], fit["p"].to_numpy(float)[order])
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((weights.tolist(), bias))  # 2 ** BITS weights

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, b0 = shared.value
        at = w.__getitem__
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"]):
                v, x = votes(text), features(text)
                p = of.get(v, 0.5)
                s = 1 / (1 + np.exp(-min(30.0, max(-30.0, b0 + sum(map(at, x)) / len(x) ** 0.5)))) if x else p
                out.append((doc, v, round(p, 6), round(float(s), 6), bool(s >= 0.5)))
            yield pd.DataFrame(out, columns=["doc_id", "votes", "posterior", "score", "kept"])

    # Ids travel as text: beside nulls pandas would make them floats.
    return src.mapInPandas(score, "doc_id string, votes string, posterior double, score double, kept boolean").withColumn("doc_id", F.col("doc_id").cast("long"))
