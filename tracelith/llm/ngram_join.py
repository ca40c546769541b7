"""Jaccard self-join of documents on word shingles, exact.

Sets fall into size bands whose bounds grow by 1 / threshold; a tile holds two neighbouring bands, so
every pair that can link shares a tile. Two sets of a tile that link differ in at most
H = (1 - t) / (1 + t) * (|x| + |y|) shingles. The tile cuts the hash space into more segments than
that, so a linked pair agrees wholly on a segment, and only sets that agree on a segment (its shingles
and its number) are candidates: passages that many documents share scatter over segments that also
hold shingles of their own and make no candidates. Hashed bitmaps of the candidates bound their overlap
from above by bit counts, and an intersection of sorted arrays decides. Sets that are equal are one
class throughout; segments with the same members are one group.

Candidates are compared inside tasks, which emit a spanning forest of the links they find. First every
set with one hub, the first set of a group. Of the groups that still hold several labels, those of up to
SMALL sets, or up to half a set's shingles and BLOCK sets, list the pairs that bitmaps leave, and each pair is
compared once at most, however many groups have it: one pair of each label first, others if they are apart after that. What is joined by then is one label; larger groups that still hold
several are cut into pairs of blocks of BLOCK sets and never list pairs: bitmaps say which sets of two blocks have
a partner there, and only those meet with their shingles. So a group of copies costs a link each, the rows between
steps are at most BLOCK / 2 a member, or the blocks of its group, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, components, discard, lean, parts, written

#: Sets of any group whose pairs are listed, sets in a block of a larger one, and partners of a set that are compared in one unit.
SMALL, BLOCK, FAN = 32, 512, 64
#: Memberships of the groups that are dealt together.
FAMILY = 1 << 14
#: Most bits of a bitmap, and of the folded one that goes with the members of groups.
WIDEST, NARROW = 1 << 14, 1 << 11
#: Characters of text hashed at once.
CHUNK = 4_000_000
_TO_SPACE = {ord(c): " " for c in SEPARATORS[1:]} | {i: i + 32 for i in range(65, 91)}
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    """64-bit hashes of words, forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_words = _Words()


def shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of the distinct n-word shingles, sorted; fewer than n words are one shingle, none give none.

    Words are runs of anything but the ASCII separators, A-Z lower-cased. Shingles are compared by 64-bit hash.
    """
    split = [[w for w in t.translate(_TO_SPACE).split(" ") if w] if t else [] for t in texts]
    count = np.fromiter(map(len, split), np.int64, len(split))
    get = _words.__getitem__
    flat = np.fromiter((get(w) for ws in split for w in ws), np.uint64, int(count.sum()))
    doc = np.repeat(np.arange(len(texts)), count)
    start = np.r_[0, np.cumsum(count)][:-1]
    left = (np.repeat(start + count, count) - np.arange(len(flat))) if len(flat) else np.zeros(0, np.int64)
    h = np.zeros(len(flat), np.uint64)
    for k in range(n):
        part = np.zeros_like(flat)
        part[: max(0, len(flat) - k)] = flat[k:]
        inside = left > k
        h = np.where(inside, _mix(h + part + np.uint64(k + 1)), h)
    first = np.arange(len(flat)) == np.repeat(start, count) if len(flat) else np.zeros(0, bool)
    keep = (left >= n) | (first & (left < n) & (np.repeat(count, count) < n))
    doc, h = doc[keep], h[keep]
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])] if len(h) else np.zeros(0, bool)
    return doc[new], h[new]


@lru_cache(maxsize=8)
def bands(percent: int) -> np.ndarray:
    """Lower bounds of the size bands: x and y that can link are in one band or in neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(100 * (out[-1]) // percent + 1)
    return np.array(out, np.int64)


def _segments(tile: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(most differing shingles of a linked pair, number of segments) of each tile."""
    top = bands(percent)[tile + 1] - 1
    h = (100 - percent) * (top + 100 * top // percent) // (100 + percent)
    return h, h + 1 + h // 32 + (h >= 8) * 2


def _signatures(doc: np.ndarray, h: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(document number, signature) of every segment of every set, in its own band's tile and the one before."""
    outs = []
    band = np.searchsorted(bands(percent), size, "right") - 1
    some = size > 0
    for back in (0, 1):
        use = some & (band >= back)
        tile = np.where(use, band - back, 0)
        most, m = _segments(tile, percent)
        of = use[doc]
        d, x = doc[of], h[of]
        if not len(d):
            continue
        md = m[d].astype(np.uint64)
        # High 32 bits scaled to the number of segments: hashes are sorted, so segments are runs.
        seg = ((x >> np.uint64(32)) * md) >> np.uint64(32)
        new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (seg[1:] != seg[:-1])])
        total = np.add.reduceat(_mix(x), new)
        dn, sn = d[new], seg[new]
        sig = _mix(total ^ _mix(sn + (tile[dn].astype(np.uint64) << np.uint64(40))))
        outs.append((dn, sig))
        # A set with so many empty segments that agreement on them could be all two such sets have gives those too.
        full = np.bincount(dn, minlength=len(size))
        poor = np.flatnonzero(use & (full <= most))
        for p in poor.tolist():
            empty = np.setdiff1d(np.arange(m[p]), sn[dn == p].astype(np.int64)).astype(np.uint64)
            outs.append((np.full(len(empty), p), _mix(np.uint64(7) ^ _mix(empty + (np.uint64(tile[p]) << np.uint64(40))))))
    if not outs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([a for a, _ in outs]), np.concatenate([b for _, b in outs])


def _set_ids(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Two independent 64-bit ids of each set (rows by 2)."""
    out = np.zeros((len(size), 2), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        start = np.searchsorted(doc, some)
        for k, salt in enumerate((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)):
            out[some, k] = np.add.reduceat(_mix(h ^ np.uint64(salt)), start)
    return _mix(out + size.astype(np.uint64)[:, None]).view(np.int64)


def _chunks(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of about CHUNK characters, with their texts."""
    texts = b.column("text").to_pylist()
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= CHUNK or i + 1 == len(texts):
            yield b.slice(at, i + 1 - at), texts[at : i + 1]
            at, held = i + 1, 0


META = "doc_id long, text_key long, size long, s1 long, s2 long, bucket int, blob binary"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("size", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])


def _scan(n: int, percent: int, buckets: int):
    """Per document a row of its set's size and ids; per chunk and bucket a row of packed (signature, s1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, texts in _chunks(whole):
                doc, h = shingles(texts, n)
                size = np.bincount(doc, minlength=len(texts))
                ids = _set_ids(doc, h, size)
                # The rows of a set meet in one bucket, spread by text so that copies of one text don't.
                to = (ids[:, 0].view(np.uint64) % np.uint64(buckets)).astype(np.int32)
                yield pa.record_batch([b.column("doc_id"), b.column("text_key"), pa.array(size), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(to), pa.nulls(len(texts), pa.binary())], schema=SCHEMA)
                # Sets equal to an earlier one of the chunk have their signatures already.
                one = np.unique(ids, axis=0, return_index=True)[1]
                keep = np.zeros(len(texts), bool)
                keep[one] = True
                of = keep[doc]
                d, sig = _signatures(doc[of], h[of], np.where(keep, size, 0), percent)
                pack = np.empty((len(sig), 2), np.int64)
                pack[:, 0], pack[:, 1] = sig.view(np.int64), ids[d, 0]
                to = (sig >> np.uint64(40)).astype(np.int64) % buckets
                order = np.argsort(to, kind="stable")
                pack, to = pack[order], to[order]
                cut = np.searchsorted(to, np.arange(buckets + 1))
                rows = np.flatnonzero(cut[1:] > cut[:-1])
                none = pa.nulls(len(rows), pa.int64())
                yield pa.record_batch([none] * 5 + [pa.array(rows.astype(np.int32)), pa.array([pack[cut[k] : cut[k + 1]].tobytes() for k in rows], pa.binary())], schema=SCHEMA)
        _words.clear()

    return run


GROUPED = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("size", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("g", pa.int64()), ("times", pa.int64())])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document rows as they come; of a reducer's buckets (each whole in one task) the groups of two sets or more.

    A group is named by a hash of its members, so equal groups meet wherever they are; should two
    groups get one name they are compared together, which loses nothing. A bucket takes 16 bytes a member.
    """
    held: dict[int, list[bytes]] = {}
    for b in batches:
        meta = pc.is_null(b.column("blob"))
        m, x = b.filter(meta), b.filter(pc.invert(meta))
        if len(m):
            none = pa.nulls(len(m), pa.int64())
            yield pa.record_batch([m.column(c) for c in ("doc_id", "text_key", "size", "s1", "s2")] + [none, none], schema=GROUPED)
        for k, blob in zip(x.column("bucket").to_pylist(), x.column("blob").to_pylist()):
            held.setdefault(k, []).append(blob)
    for k in list(held):
        x = np.frombuffer(b"".join(held.pop(k)), np.int64).reshape(-1, 2)
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        x = x[np.r_[True, (x[1:] != x[:-1]).any(axis=1)]]
        start = np.flatnonzero(np.r_[True, x[1:, 0] != x[:-1, 0]])
        count = np.diff(np.r_[start, len(x)])
        x = x[np.repeat(count > 1, count), 1]
        count = count[count > 1]
        if not len(x):
            continue
        start = np.cumsum(count) - count
        name = np.add.reduceat(_mix(x.view(np.uint64)), start)
        name = _mix(name + count.astype(np.uint64)).view(np.int64)
        _, one, times = np.unique(name, return_index=True, return_counts=True)
        count, start, name = count[one], start[one], name[one]
        for lo in range(0, len(one), 100_000):
            c, a = count[lo : lo + 100_000], start[lo : lo + 100_000]
            at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(a, c)
            for cut in range(0, len(at), 1 << 20):
                part = slice(cut, cut + (1 << 20))
                none = pa.nulls(len(at[part]), pa.int64())
                yield pa.record_batch([none, none, none, pa.array(x[at[part]]), none, pa.array(np.repeat(name[lo : lo + 100_000], c)[part]), pa.array(np.repeat(times[lo : lo + 100_000], c)[part])], schema=GROUPED)


def _bitmap(array: np.ndarray) -> bytes:
    """Hashed bitmap of a set, some 4 to 8 bits a shingle."""
    bits = min(WIDEST, max(512, 1 << (4 * len(array)).bit_length()))
    out = np.zeros(bits, bool)
    out[(array % np.uint64(bits)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap (or rows of them) of 64-bit words folded to fewer: h modulo the smaller width."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def _arrays(n: int):
    """The sorted shingles and bitmap of each text's set, for rows whose text has the set that the node stands for."""
    schema = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("narrow", pa.binary()), ("bits", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b, texts in _chunks(whole):
                doc, h = shingles(texts, n)
                cut = np.searchsorted(doc, np.arange(len(texts) + 1))
                ids = _set_ids(doc, h, np.diff(cut))
                at = np.flatnonzero((ids[:, 0] == b.column("s1").to_numpy()) & (ids[:, 1] == b.column("s2").to_numpy()))
                sets = [h[cut[i] : cut[i + 1]] for i in at]
                bits = [_bitmap(x) for x in sets]
                narrow = [_folded(np.frombuffer(x, np.uint64), NARROW // 64).tobytes() for x in bits]
                narrow, bits, raw = (pa.array(x, pa.binary()) for x in (narrow, bits, [x.tobytes() for x in sets]))
                yield pa.record_batch([b.column("node").take(pa.array(at)), pa.array(np.diff(cut)[at]), narrow, bits, raw], schema=schema)
        _words.clear()

    return run


def _hopeful(percent: int):
    """Of pairs with their sizes and bitmaps those that bit counts leave a chance, by the narrower width of the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for m, n, p, q in zip(*(b.column(c).to_pylist() for c in ("size_a", "size_b", "bits_a", "bits_b"))):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                x, y = _folded(x, len(y)), _folded(y, len(x))
                both, nx, ny = (int(np.bitwise_count(z).sum()) for z in (x & y, x, y))
                keep.append((min(m - nx, n - ny) + both) * (100 + percent) >= percent * (m + n))
            yield pa.record_batch([b.column("a"), b.column("b")], schema=LINKS).filter(pa.array(keep, pa.bool_()))

    return run


def _group_pairs(percent: int):
    """Pairs of a group that bear different labels and that bit counts leave a chance, with their labels, once a family.

    Rows come sorted by family (hub, part), a set once with the groups that it is in. A group has BLOCK sets at most.
    """

    def chance(x: np.ndarray, y: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
        both, nx, ny = (np.bitwise_count(z).sum(axis=-1, dtype=np.int64) for z in (x & y, x, y))
        return (np.minimum(m - nx, n - ny) + both) * (100 + percent) >= percent * (m + n)

    def pairs(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        node, label, size = (np.array([r[k] for r in rows], np.int64) for k in (2, 3, 4))
        bits = [np.frombuffer(r[5], np.uint64) for r in rows]
        groups: dict[int, list[int]] = {}
        for k, r in enumerate(rows):
            for g in r[6]:
                groups.setdefault(g, []).append(k)
        seen = np.zeros(0, np.int64)
        for at in groups.values():
            at = np.array(at)
            # Wide and folded bitmaps are compared by the width of the narrower one.
            words = min(len(bits[k]) for k in at)
            x = np.stack([_folded(bits[k], words) for k in at])
            hits = []
            for k in range(len(at) - 1):
                rest = np.flatnonzero(label[at[k + 1 :]] != label[at[k]]) + k + 1
                ok = rest[chance(x[k], x[rest], size[at[k]], size[at[rest]])] if len(rest) else rest
                hits.append(at[k] * len(rows) + at[ok])
            if hits:
                seen = np.union1d(seen, np.concatenate(hits))
        i, j = seen // len(rows), seen % len(rows)
        # A narrower set in the group folded the bitmaps of these; their own width tells more.
        keep = [chance(_folded(bits[p], len(bits[q])), _folded(bits[q], len(bits[p])), size[p], size[q]) for p, q in zip(i.tolist(), j.tolist())]
        i, j = i[np.array(keep, bool)], j[np.array(keep, bool)]
        if len(i):
            i, j = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
            yield pa.record_batch([pa.array(x) for x in (node[i], node[j], label[i], label[j])], names=["a", "b", "la", "lb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("hub", "part", "node", "label", "size", "bits", "groups"))):
                if held and held[0][:2] != row[:2]:
                    yield from pairs(held)
                    held = []
                held.append(row)
        if held:
            yield from pairs(held)

    return run


UNITS = pa.schema([("unit", pa.int64()), ("part", pa.int32()), ("side", pa.int32()), ("node", pa.int64()), ("label", pa.int64())])


def _partnered(percent: int):
    """Of each unit the sets that bit counts leave a partner of another label, on the other side or, where there is one side, inside it.

    Rows come sorted by unit, each with a bitmap, and hold two blocks of a group at most.
    """

    def live(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        words = min(len(r[6]) for r in rows) // 8
        x = np.stack([_folded(np.frombuffer(r[6], np.uint64), words) for r in rows])
        side, label, size = (np.array([r[k] for r in rows], np.int64) for k in (2, 4, 5))
        spare = size - np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        two = side.any()
        other = np.flatnonzero(side == 1) if two else np.arange(len(rows))
        y, keep = x[other], np.zeros(len(rows), bool)
        for i in np.flatnonzero(side == 0).tolist():
            most = np.minimum(spare[i], spare[other]) + np.bitwise_count(x[i] & y).sum(axis=1, dtype=np.int64)
            ok = (most * (100 + percent) >= percent * (size[i] + size[other])) & (label[i] != label[other])
            keep[i] |= ok.any()
            keep[other[ok]] = True
        at = np.flatnonzero(keep)
        if len(at):
            yield pa.record_batch([pa.array([rows[i][k] for i in at], f.type) for k, f in enumerate(UNITS)], schema=UNITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in (*UNITS.names, "size", "bits"))):
                if held and held[0][:2] != row[:2]:
                    yield from live(held)
                    held = []
                held.append(row)
        if held:
            yield from live(held)

    return run


class _Block:
    """Sets to compare: nodes, labels, and the sorted arrays end to end."""

    def __init__(self, rows: list[tuple]) -> None:
        self.node = [r[0] for r in rows]
        self.label = np.array([r[1] for r in rows], np.int64)
        self.arrays = [np.frombuffer(r[2], np.uint64) for r in rows]
        self.size = np.array([len(a) for a in self.arrays], np.int64)

    def bitmap(self, bits: int) -> np.ndarray:
        out = np.zeros((len(self.node), bits), bool)
        out[np.repeat(np.arange(len(self.node)), self.size), (np.concatenate(self.arrays) % np.uint64(bits)).astype(np.int64)] = True
        return np.packbits(out, axis=1).view(np.uint64)


def _possible(a: _Block, b: _Block, percent: int) -> np.ndarray:
    """Which pairs bit counts leave a chance: overlap is at most |x| less the bits that x alone has, and so for y."""
    bits = min(WIDEST, max(512, 1 << int(4 * max(a.size.max(), b.size.max())).bit_length()))
    x = a.bitmap(bits)
    y = x if a is b else b.bitmap(bits)
    both = np.stack([np.bitwise_count(r & y).sum(axis=1, dtype=np.int64) for r in x])
    nx, ny = (np.bitwise_count(m).sum(axis=1, dtype=np.int64) for m in (x, y))
    most = np.minimum((a.size - nx)[:, None], (b.size - ny)[None, :]) + both
    out = most * (100 + percent) >= percent * (a.size[:, None] + b.size[None, :])
    out &= a.label[:, None] != b.label[None, :]
    return np.triu(out, 1) if a is b else out


def _overlaps(a: _Block, b: _Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sorted arrays i of a and j of b."""
    rows, cols = np.unique(i), np.unique(j)
    if len(i) <= 4 * (len(rows) + len(cols)):
        return np.array([len(np.intersect1d(a.arrays[p], b.arrays[q], assume_unique=True)) for p, q in zip(i.tolist(), j.tolist())], np.int64)
    # Many pairs of the same sets: all arrays are intersected at once, and the common shingles counted by pair.
    x, y = np.concatenate([a.arrays[p] for p in rows]), np.concatenate([b.arrays[q] for q in cols])
    common = np.intersect1d(x, y)
    out = np.zeros((len(rows), len(cols)), np.float32)
    for lo in range(0, len(common), 4096):
        part = common[lo : lo + 4096]

        def held(block: _Block, which: np.ndarray, part: np.ndarray = part) -> np.ndarray:
            m = np.zeros((len(which), len(part)), np.float32)
            for r, k in enumerate(which):
                at = np.searchsorted(part, block.arrays[k])
                at = at[(at < len(part)) & (part[np.minimum(at, len(part) - 1)] == block.arrays[k])]
                m[r, at] = 1
            return m

        out += held(a, rows) @ held(b, cols).T
    return out[np.searchsorted(rows, i), np.searchsorted(cols, j)].astype(np.int64)


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(percent: int):
    """Links between the sides of each unit, or inside side 0 where there is no side 1, as a spanning forest of labels.

    Rows come sorted by unit and side. Side 0 is a hub or a block; side 1 streams by in blocks.
    """

    def links(a: _Block, b: _Block, root: dict[int, int]) -> Iterator[tuple[int, int]]:
        def find(k: int) -> int:
            while (up := root.setdefault(k, k)) != k:
                root[k] = k = root.setdefault(up, up)
            return k

        i, j = np.nonzero(_possible(a, b, percent))
        step = 1 << 18
        for lo in range(0, len(i), step):
            p, q = i[lo : lo + step], j[lo : lo + step]
            # What has come together meanwhile needs no intersection.
            la, lb = (np.array([find(x) for x in m.label.tolist()]) for m in (a, b))
            apart = la[p] != lb[q]
            p, q = p[apart], q[apart]
            if not len(p):
                continue
            both = _overlaps(a, b, p, q)
            ok = 100 * both >= percent * (a.size[p] + b.size[q] - both)
            for x, y in zip(p[ok].tolist(), q[ok].tolist()):
                if (r := find(int(a.label[x]))) != (s := find(int(b.label[y]))):
                    root[max(r, s)] = min(r, s)
                    yield a.node[x], b.node[y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ones, first, root, out = None, [], [], None, {}, []

        def stream() -> None:
            """Compare what has come of side 1 with side 0."""
            nonlocal first
            if held and ones:
                first = first or _Block(held)
                out.extend(links(first, _Block(ones), root))
            ones.clear()

        def close(two: bool) -> None:
            stream()
            if not two and len(held) > 1:
                whole = _Block(held)
                out.extend(links(whole, whole, root))

        two = False
        for b in batches:
            for unit, part, side, node, label, raw in zip(*(b.column(c).to_pylist() for c in ("unit", "part", "side", "node", "label", "shingles"))):
                if key != (unit, part):
                    close(two)
                    key, held, first, root, two = (unit, part), [], None, {}, False
                (ones if side else held).append((node, label, raw))
                two |= side > 0
                if len(ones) >= BLOCK:
                    stream()
            if len(out) >= 10_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=LINKS)
                out.clear()
        close(two)
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=LINKS)

    return run


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text; other columns are not read).

    Documents link at Jaccard >= percent / 100 on sets of n-word shingles; component_id is the smallest
    doc_id reachable. Null, empty and wordless texts have empty sets and link with nothing. Rows are
    linked by their texts alone: rows that repeat a doc_id give a row each, and rows with a null doc_id
    get the smallest doc_id of their component, null if it has none. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    buckets = 2 * parts(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    out_schema = "doc_id long, text_key long, size long, s1 long, s2 long, g long, times long"
    gathered = written(src.mapInArrow(lean(_scan(n, percent, buckets)), META).repartition(buckets, "bucket").mapInArrow(lean(_gather), out_schema), "gathered")
    meta = gathered.where("g is null").select("doc_id", "text_key", "size", "s1", "s2")
    # A row per set, with a text that has it. Ids of 64 bits meet by chance among so many, both together don't.
    one = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "text_key")).alias("one")
    sets = meta.where("size > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("low"), F.min("size").alias("size"), one)
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    groups = gathered.where("g is not null").groupBy("g", "s1").agg(F.sum("times").alias("times"))
    member = written(groups.join(sets.select("s1", "node"), "s1").select("g", "node", "times"), "members")
    need = sets.join(member.select("node").distinct(), "node").select("node", "s1", "s2", "size", "one.*")
    need = written(need, "needed")
    # One text of each needed set; the texts are dealt once, and repeated rows go where they meet.
    keyed = src.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "text_key", "text").join(need.drop("size").hint("merge"), ["id", "text_key"])
    keyed = keyed.dropDuplicates(["id", "text_key", "node"]).select("text", "node", "s1", "s2")
    arrays = written(keyed.mapInArrow(lean(_arrays(n)), "node long, size long, narrow binary, bits binary, shingles binary"), "arrays")

    def compared(units: DataFrame) -> DataFrame:
        """Links of units (unit, part, side, node, label)."""
        rows = units.join(arrays.select("node", "shingles"), "node").repartition("unit", "part").sortWithinPartitions("unit", "part", "side")
        return written(rows.select("unit", "part", "side", "node", "label", "shingles").mapInArrow(lean(_compare(percent)), "a long, b long"), "links")

    def hopeful(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that bit counts leave a chance."""
        for side in "ab":
            pairs = pairs.join(arrays.select(F.col("node").alias(side), F.col("size").alias(f"size_{side}"), F.col("bits").alias(f"bits_{side}")), side)
        return written(pairs.mapInArrow(lean(_hopeful(percent)), "a long, b long"), "hopeful")

    def stars(pairs: DataFrame) -> DataFrame:
        """Units of distinct pairs (a, b): a with up to about FAN of its partners."""
        fan = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("fan"))
        ends = pairs.join(fan, "a").select(F.col("a").alias("unit"), F.pmod(F.xxhash64("b"), "fan").cast("int").alias("part"), F.col("b").alias("node"))
        hubs = ends.select("unit", "part", F.lit(0).alias("side"), F.col("unit").alias("node")).distinct()
        return hubs.unionByName(ends.withColumn("side", F.lit(1))).withColumn("label", F.col("node"))

    # A star round: every set with the one hub it shares most segments with.
    hub = member.groupBy("g").agg(F.min("node").alias("hub"))
    shared = member.join(hub, "g").where("node <> hub").groupBy("node", "hub").agg(F.sum("times").alias("k"))
    best = shared.groupBy(F.col("node").alias("b")).agg(F.max_by("hub", F.struct("k", -F.col("hub"))).alias("a"))
    best = written(best, "best")
    near = hopeful(best)
    links = [compared(stars(near))]
    # Labels say what is joined already, over any number of links.
    starred = written(components(links[0]), "joined")
    label = need.select("node", "size").join(starred, "node", "left").select("node", "size", F.coalesce("component", "node").alias("label"))
    labelled = m = written(member.join(label, "node").select("g", "node", "size", "label"), "labelled")
    mixed = m.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.min("node").alias("hub")).where("lo <> hi")
    # A set is in a group for every few of its shingles, so groups of fewer sets than that share most of their pairs.
    listed = F.col("n") <= F.least(F.lit(BLOCK), F.greatest(F.lit(SMALL), F.col("least") / 2))
    mixed = written(mixed.select("g", "n", "hub", listed.alias("listed")), "mixed")
    m = m.select("g", "node", "label").join(mixed, "g")
    # Groups of one least set are a family: its sets go there once with their bitmaps, and pairs are told without leaving it.
    families = mixed.where("listed").groupBy("hub").agg(F.ceil(F.sum("n") / FAMILY).cast("int").alias("parts"))
    few = m.where("listed").join(families, "hub").withColumn("part", F.pmod(F.xxhash64("g"), "parts").cast("int"))
    few = few.groupBy("hub", "part", "node").agg(F.min("label").alias("label"), F.collect_list("g").alias("groups"))
    few = few.join(arrays.select("node", "size", "bits"), "node").select("hub", "part", "node", "label", "size", "bits", "groups")
    few = few.repartition("hub", "part").sortWithinPartitions("hub", "part").mapInArrow(lean(_group_pairs(percent)), "a long, b long, la long, lb long")
    pairs = written(few.distinct().join(best, ["a", "b"], "left_anti"), "pairs")
    # Of the pairs of every label one first, with its least partner: what that joins needs no look at the others.
    told = pairs.groupBy(F.greatest("la", "lb").alias("hi")).agg(F.min(F.struct(F.least("la", "lb").alias("lo"), "a", "b")).alias("p"))
    first = written(told.select("p.a", "p.b"), "first")
    links.append(compared(stars(first)))
    so_far = lambda c: c.select(F.col("node").alias("a"), F.col("component").alias("b"))
    met = written(components(so_far(starred).union(links[1])), "joined")
    rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti")
    for side in "ab":
        rest = rest.join(met.select(F.col("node").alias(side), F.col("component").alias(f"l{side}")), side, "left")
    rest = written(rest.where("coalesce(la, a) <> coalesce(lb, b)").select("a", "b"), "rest")
    links.append(compared(stars(rest)))
    # What came together so far needs no second look: most large groups hold one label by now.
    joined = written(components(so_far(met).union(links[2])), "joined")
    large = m.where("not listed").drop("label").join(joined, "node", "left").select("g", "n", "node", F.coalesce("component", "node").alias("label"))
    apart = large.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("g")
    large = written(large.join(apart, "g"), "large")
    # Large groups are compared in pairs of blocks.
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    big = large.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    big = big.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    side = F.when((lo < hi) & (F.col("block") == hi), 1).otherwise(0)
    units = big.select(F.col("g").alias("unit"), (lo * F.col("blocks") + hi).alias("part"), side.alias("side"), "node", "label")
    # Narrow bitmaps are full beyond a bit a shingle.
    bits = arrays.select("node", "size", F.when(F.col("size") <= NARROW, F.col("narrow")).otherwise(F.col("bits")).alias("bits"))
    units = units.join(bits, "node").select(*UNITS.names, "size", "bits").repartition("unit", "part").sortWithinPartitions("unit", "part", "side")
    units = written(units.mapInArrow(lean(_partnered(percent)), "unit long, part int, side int, node long, label long"), "partnered")
    links.append(compared(units))
    discard(best, near, starred, pairs, first, met, rest, large, units, mixed, labelled, arrays, need, member)
    comp = written(components(so_far(joined).union(links[3])), "comp")
    discard(joined, *links)
    low = sets.join(comp, "node", "left").select("s1", "s2", "low", F.coalesce("component", "node").alias("component"))
    least = low.groupBy("component").agg(F.min("low").alias("component_id"))
    to = written(low.join(least, "component").select("s1", "s2", "component_id"), "of-set")
    out = meta.join(to, ["s1", "s2"], "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
