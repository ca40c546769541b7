"""SentencePiece BPE encoding by vectorised merge rounds, and decoding.

Words new to a batch become flat numpy symbol arrays. In each round every word merges its leftmost
pair of least rank, all words at once, and finished words are compacted away. That is the library's
order (best score first, leftmost among equals), so ids are the same. Words of over LONG characters
take the same order from a heap, n log n whatever they hold.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG, KEPT, CACHE = 4096, 64, 500_000
#: Characters of texts handled at once.
CHUNK = 4_000_000
SLOT_BITS, FAR = 20, np.iinfo(np.int64).max
SPACE = "▁"
NORMAL, BYTE = 1, 6


def _slot(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


class PieceModel:
    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        spec = m.normalizer_spec
        kinds = {p.type for p in m.pieces} - {2, 3}
        if m.trainer_spec.model_type != 2 or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or kinds - {NORMAL, BYTE}:
            raise ValueError("only BPE models with byte fallback, identity normalisation and plain pieces are read")
        self.pieces = [p.piece for p in m.pieces]
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.score = [p.score for p in m.pieces]
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece goes on after a word; words could not be encoded by themselves")
        self.bos, self.eos = self.pieces.index("<s>"), self.pieces.index("</s>")
        # Equal scores share a rank: then the leftmost pair goes first
        order = sorted({self.score[i] for i in self.ids.values()}, reverse=True)
        of = {s: r for r, s in enumerate(order)}
        self.rank = {p: of[self.score[i]] for p, i in self.ids.items()}
        # Symbols are numbered: pieces by id, characters that are no piece by code point after them.
        self.of_char = np.arange(0x110000, dtype=np.int64) + len(self.pieces)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                if (a := p[:k]) in self.ids and (b := p[k:]) in self.ids:
                    pairs[(self.ids[a] << 21) | self.ids[b]] = (self.rank[p], i)
        # A piece may also be made from a character that is no piece itself.
        self.odd = {c for p in self.ids if len(p) > 1 for c in p if c not in self.ids}
        for p, i in self.ids.items():
            if self.odd & set(p) and len(p) > 1:
                for k in range(1, len(p)):
                    a, b = p[:k], p[k:]
                    if (a in self.ids or a in self.odd) and (b in self.ids or b in self.odd):
                        pairs[(self.symbol(a) << 21) | self.symbol(b)] = (self.rank[p], i)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        at = np.argsort(keys)
        self.keys = keys[at]
        vals = np.array(list(pairs.values()), np.int64)[at]
        self.pair_rank, self.pair_id = vals[:, 0], vals[:, 1]
        self.pairs = pairs
        # Open-addressed table of the pairs, for numpy lookups.
        self.slots = np.full(1 << SLOT_BITS, -2, np.int64)
        self.slot_rank, self.slot_id = np.full(1 << SLOT_BITS, FAR, np.int64), np.zeros(1 << SLOT_BITS, np.int64)
        at, left = _slot(self.keys), np.arange(len(self.keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            _, one = np.unique(at[left], return_index=True)
            free = one[self.slots[at[left[one]]] == -2]
            put = left[free]
            self.slots[at[put]], self.slot_rank[at[put]], self.slot_id[at[put]] = self.keys[put], self.pair_rank[put], self.pair_id[put]
            left = np.delete(left, free)
            at[left] = (at[left] + 1) & ((1 << SLOT_BITS) - 1)
        self.known: dict[str, bytes] = {}
        self.text = [p.encode().replace(SPACE.encode(), b" ") for p in self.pieces]
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])
        for i, p in enumerate(m.pieces):
            if p.type in (2, 3):
                self.text[i] = b""

    def symbol(self, c: str) -> int:
        i = self.ids.get(c)
        return len(self.pieces) + ord(c) if i is None else i

    def symbols(self, text: str) -> np.ndarray:
        return self.of_char[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]

    def _lookup(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair key; FAR where the pair makes no piece."""
        at = _slot(keys)
        found = self.slots[at]
        rank, new = np.where(found == keys, self.slot_rank[at], FAR), self.slot_id[at]
        miss = np.flatnonzero((found != keys) & (found != -2) & (keys >= 0))
        for _ in range(self.probes):
            if not len(miss):
                break
            at[miss] = (at[miss] + 1) & ((1 << SLOT_BITS) - 1)
            got = self.slots[at[miss]]
            hit = got == keys[miss]
            rank[miss[hit]], new[miss[hit]] = self.slot_rank[at[miss[hit]]], self.slot_id[at[miss[hit]]]
            miss = miss[~hit & (got != -2)]
        return rank, new

    def _ids(self, symbols: list[int], chars: str, spans: list[tuple[int, int]]) -> bytes:
        out = []
        for s, (a, b) in zip(symbols, spans):
            if s < len(self.pieces):
                out.append(s)
            else:
                out.extend(self.bytes[x] for x in chars[a:b].encode())
        return np.array(out, "<u4").tobytes()

    def _long(self, word: str) -> bytes:
        n = len(word)
        sym = self.symbols(word).tolist()
        nxt, prv, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
        heap: list = []

        def push(i: int) -> None:
            j = nxt[i]
            if j < n and (p := self.pairs.get((sym[i] << 21) | sym[j])):
                heapq.heappush(heap, (p[0], i, sym[i], sym[j], p[1]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], end[i], alive[j], nxt[i] = new, end[j], False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            if prv[i] >= 0:
                push(prv[i])
            push(i)
        at = [i for i in range(n) if alive[i]]
        return self._ids([sym[i] for i in at], word, [(i, end[i]) for i in at])

    def _chosen(self, cand: np.ndarray, word: np.ndarray, sym: np.ndarray, rank: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Of the least-ranked pairs (positions cand) those that merge at once: each word's leftmost, and the others
        that don't overlap one before them, unless a merge in the word makes a pair of lower rank, which comes first."""
        begin = np.r_[True, (np.diff(cand) > 1) | (word[cand[1:]] != word[cand[:-1]])]
        first = np.maximum.accumulate(np.where(begin, np.arange(len(cand)), 0))
        pick = cand[(np.arange(len(cand)) - first) % 2 == 0]
        lead = np.r_[True, word[pick[1:]] != word[pick[:-1]]]
        if lead.all():
            return pick
        several = np.isin(word[pick], word[pick[~lead]])
        p = pick[several]
        after, before = np.minimum(p + 2, len(sym) - 1), np.maximum(p - 1, 0)
        # To the left of a merge stands the symbol before it, or the merge that ends there.
        joined = np.r_[False, p[1:] - p[:-1] == 2]
        left = np.where(joined, np.r_[0, new[p[:-1]]], sym[before])
        right_rank, _ = self._lookup(np.where((p + 2 < len(sym)) & (word[after] == word[p]), (new[p] << 21) | sym[after], -1))
        left_rank, _ = self._lookup(np.where((p > 0) & (word[before] == word[p]), (left << 21) | new[p], -1))
        lower = word[p[(right_rank < rank[p]) | (left_rank < rank[p])]]
        return pick[lead | ~np.isin(word[pick], lower)]

    def _rounds(self, words: list[str]) -> None:
        """Merge rounds over all words at once; results go to self.known."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        joined = "".join(words)
        sym = self.symbols(joined)
        word = np.repeat(np.arange(len(words)), lengths)
        first = np.arange(len(joined))  # where a symbol's characters begin
        stop = first + 1
        done: list[tuple] = []
        same = np.r_[word[:-1] == word[1:], False]
        rank, new = self._lookup(np.where(same, (sym << 21) | np.r_[sym[1:], 0], -1))
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            each = np.repeat(least, np.diff(np.r_[starts, len(sym)]))
            idle = each == FAR
            if idle.any():
                done.append((word[idle], sym[idle], first[idle], stop[idle]))
            cand = np.flatnonzero((rank == each) & ~idle)
            if not len(cand):
                break
            left = self._chosen(cand, word, sym, rank, new)
            sym[left] = new[left]
            stop[left] = stop[left + 1]
            stay = ~idle
            stay[left + 1] = False
            moved = (np.cumsum(stay) - 1)[left]
            sym, word, first, stop, rank, new = (x[stay] for x in (sym, word, first, stop, rank, new))
            # Only the pairs beside a merge have changed.
            fresh = np.concatenate([moved, moved[moved > 0] - 1])
            after = np.minimum(fresh + 1, len(sym) - 1)
            inside = (word[fresh] == word[after]) & (after > fresh)
            rank[fresh], new[fresh] = self._lookup(np.where(inside, (sym[fresh] << 21) | sym[after], -1))
        w, s, a, b = (np.concatenate(x) for x in zip(*done))
        order = np.lexsort((a, w))
        w, s, a, b = w[order], s[order], a[order], b[order]
        cuts = np.searchsorted(w, np.arange(len(words) + 1))
        odd = np.unique(w[s >= len(self.pieces)])
        raw = s.astype("<u4").tobytes()
        for i, x in enumerate(words):
            self.known[x] = raw[4 * cuts[i] : 4 * cuts[i + 1]]
        for i in odd.tolist():
            at = slice(cuts[i], cuts[i + 1])
            self.known[words[i]] = self._ids(s[at].tolist(), joined, list(zip(a[at].tolist(), b[at].tolist())))

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, begin and end ids included, as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHE:
            self.known.clear()
        split = [_words(t) for t in texts]
        new = {w for ws in split for w in ws if w not in self.known}
        short = [w for w in new if len(w) <= LONG]
        long_ones = [w for w in new if len(w) > LONG]
        for w in long_ones:
            self.known[w] = self._long(w)
        if short:
            self._rounds(short)
        bos, eos, get = np.array([self.bos], "<u4").tobytes(), np.array([self.eos], "<u4").tobytes(), self.known.__getitem__
        out = [b"".join([bos, *map(get, ws), eos]) for ws in split]
        # The cache holds words of up to KEPT characters, so its bytes are bounded with its entries.
        for w in new:
            if len(w) > KEPT:
                del self.known[w]
        return out

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, without the first one's leading space mark; bytes that form no UTF-8 give U+FFFD."""
        raw = b"".join(map(self.text.__getitem__, ids))
        i = 0
        while i < len(ids) and ids[i] in (self.bos, self.eos):
            i += 1
        if i < len(ids) and self.pieces[ids[i]].startswith(SPACE):
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def _words(text: str) -> list[str]:
    """A word is a run of space marks with what follows it; no piece goes beyond one."""
    if not text:
        return []
    if "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
        return (SPACE + text.replace(" ", " " + SPACE)).split(" ")
    parts = (" " + text).replace(SPACE, " ").split(" ")
    out, spaces = [], 0
    for p in parts[1:]:
        if p:
            out.append(SPACE * (spaces + 1) + p)
            spaces = 0
        else:
            spaces += 1
    head = parts[0]
    if head:
        out.insert(0, head)
    if spaces:
        out.append(SPACE * spaces)
    return out


@cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _outputs(doc_id: pd.Series, raw: list[bytes], m: PieceModel) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": doc_id, "ids": raw, "decoded": [m.decode(np.frombuffer(r, "<u4").tolist()) for r in raw]})


def _digests(doc_id: pd.Series, raw: list[bytes], m: PieceModel) -> pd.DataFrame:
    back = (m.decode(np.frombuffer(r, "<u4").tolist()) for r in raw)
    return pd.DataFrame(
        {
            "doc_id": doc_id,
            "n_tokens": [len(r) // 4 for r in raw],
            "ids_sha256": [hashlib.sha256(r).hexdigest() for r in raw],
            "decoded_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back],
        }
    )


def encode_decode(docs: DataFrame, model_path: str, digests: bool = False) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) and decoded text of each row; or their digests only.

    A null or empty text is its begin and end ids and decodes to ''. Repeated rows give one row each;
    an empty table gives none; other columns are not read.
    """
    finish, schema = (_digests, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string") if digests else (_outputs, "doc_id string, ids binary, decoded string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(model_path)
        for b in batches:
            texts = [t or "" for t in b["text"]]
            ends = np.cumsum([len(t) for t in texts]) // CHUNK
            for k in np.unique(ends):
                at = np.flatnonzero(ends == k)
                raw = m.encode_batch(texts[at[0] : at[-1] + 1])
                yield finish(b["doc_id"].iloc[at], raw, m)

    # Ids travel as text: beside nulls pandas would make them floats.
    src = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
