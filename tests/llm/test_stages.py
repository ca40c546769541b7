"""Each stage of the pipeline against brute force, on its predecessor's rows."""

import random
import re
import zlib
from array import array

import pytest

import corpus_pipeline as P
from tracelith.llm import common, host_quality, sanitize

tokenizers = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def corpus():
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(900)]
    make = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    texts = [make(r.choice([20, 60, 120, 300])) for _ in range(120)]
    passage = make(30)
    for i in range(30):  # near copies of several degrees
        w = texts[r.randrange(60)].split()
        for _ in range(r.choice([0, 1, 3, 9])):
            w[r.randrange(len(w))] = f"new{i}"
        texts.append(" ".join(w))
    texts += [make(60) + " " + passage + " " + make(40) for _ in range(20)] + ["spam " * 80] * 10 + [None, "", "é " * 60]
    texts += [f"{make(60)} write to jo{i}@x.example.org or +49 (30) 1234-567{i} from 10.0.0.{i}" for i in range(12)]
    return [(i * 3 % 1000, t, "en", f"h{i % 5}", len(t or "")) for i, t in enumerate(texts)]


def quality(rows):
    def fails(t):
        w, at = words(t), {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        repeat = len({k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)})
        lines = [x for x in (t or "").split("\n") if words(x)]
        return len(w) < 50 or 100 * repeat > 50 * len(w), 2 * sum(c in "#*$%&|<>" for c in t or "") > len(w), 10 * (len(lines) - len(set(lines))) > 3 * max(1, len(lines))

    failed = {i: fails(t) for i, (_, t, *_) in enumerate(rows)}
    hosts = sorted({x[3] for x in rows})
    n = {h: sum(x[3] == h for x in rows) for h in hosts}
    worst = dict.fromkeys(hosts, 0.0)
    for rule in range(3):
        k = {h: sum(failed[i][rule] for i, x in enumerate(rows) if x[3] == h) for h in hosts}
        total = sum(n.values())
        m = sum(k.values()) / total
        strength = host_quality.MOST
        if 0 < m < 1:
            spread = total - sum(v * v for v in n.values()) / total - (len(hosts) - 1)
            own = sum(n[h] * (k[h] / n[h] - m) ** 2 for h in hosts) / (m * (1 - m)) - (len(hosts) - 1)
            if spread > 1e-9 and own * (host_quality.MOST + 1) > spread:
                strength = max(host_quality.LEAST, spread / own - 1)
        for h in hosts:
            worst[h] = max(worst[h], (k[h] + m * strength) / (n[h] + strength))
    keep = lambda i, x: not failed[i][0] and worst[x[3]] <= host_quality.REJECT and not (worst[x[3]] > host_quality.SUSPECT and any(failed[i][1:]))
    return [x for i, x in enumerate(rows) if keep(i, x)]


def near(rows):
    sets = []
    for _, t, *_ in rows:
        w = [x.lower() for x in words(t)]
        sets.append(set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b, key=lambda x: rows[x][0])] = min(a, b, key=lambda x: rows[x][0])
    return [x for i, x in enumerate(rows) if find(i) == i]


def passages(rows):
    first, out = {}, []
    for d, t, *_ in rows:
        b = t.encode()
        for k in range(len(b) - 49):
            first[b[k : k + 50]] = min(first.get(b[k : k + 50], d), d)
    for d, t, lang, source, _ in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < d:
                gone[k : k + 50] = b"\1" * 50
        if not all(gone) or not b:
            left = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
            out.append((d, left, lang, source, len(left)))
    return out


def test_stages_against_brute_force(spark):
    common.ship(spark)
    rows = corpus()
    df = spark.createDataFrame(rows, DOC).repartition(4)
    got = lambda d: sorted(map(tuple, d.collect()))
    for (name, stage), brute in zip(P.STAGES, (quality, near, passages)):
        before = got(df)
        df = common.written(stage(spark, df, ""), f"test-{name}")
        assert got(df) == sorted(brute(before)), name
        assert len(brute(before)) > 20
    before = {x[0]: x[1] for x in got(df)}
    df = common.written(P.personal_data(spark, df, ""), "test-pii")
    after = got(df)
    assert {x[0] for x in after} == set(before) and all(not sanitize.base_spans(t) and n == len(t) for _, t, _, _, n in after)
    assert all(t == before[d] for d, t, *_ in after if not sanitize.base_spans(before[d])) and any("[EMAIL]" in x[1] for x in after)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    pieces = P.pack(spark, df, "").toPandas()
    for d, t, *_ in after:
        ids, at = [*tok.encode(t, add_special_tokens=False).ids, 1], 0
        for x in pieces[pieces.doc_id == d].sort_values("start").itertuples():
            assert x.start == at and zlib.crc32(array("I", ids[at : at + x.length]).tobytes()) == x.ids_crc32
            at += x.length
        assert at == len(ids)
