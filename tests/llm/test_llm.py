"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import array
import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tracelith.llm import common, embed_dedup, host_quality, licenses, ngram_join, packing, sanitize, sentencepiece_bpe, suffix_index, warc, weak_quality

tokenizers = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, lang string, source string, n_chars long, row long, bucket string, host string, key string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


def docs(spark, texts, ids=None, source="src0"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, source, None, 1, "b", "h", "k") for i, t in zip(ids, texts)], DOC).repartition(3)


R = random.Random(4)
VOCAB = ["the", "of", "and", "alpha", "beta", "gamma", "delta", "é", "Ü", "x|y", "#"] + [f"w{i}" for i in range(40)]
TEXTS = [None, "", " ", "\n\n", "one", "one two", "ab " * 3000, "é" * 4000, "日本 語"] + [" ".join(R.choice(VOCAB) for _ in range(R.choice([3, 10, 60, 200]))) for _ in range(60)]
TEXTS += TEXTS[-20:] + [t.replace("w1", "w2", 1) for t in TEXTS[-20:]]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality(spark):
    got = {r.doc_id: r for r in host_quality.quality(docs(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        w, at = words(t), {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k : k + 3]), []).append(k)
        repeat = len({k + j for v in at.values() if len(v) > 1 for k in v for j in range(3)})
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeat)
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (len(w) < 50 or 100 * repeat > 50 * len(w)) and (not g.kept or not g.base_failed)


def test_host_verdict_rejects_a_bad_host(spark):
    bad = [f"a{i} " * 60 for i in range(100)]
    good = [" ".join(f"g{i}x{j}" for j in range(60)) for i in range(100)]
    both = docs(spark, bad + good[:1], source="bad.example").union(docs(spark, good[1:], range(200, 299), "good.example"))
    got = {r.doc_id: r for r in host_quality.quality(both).collect()}
    assert not got[100].kept and not got[100].base_failed and got[200].kept


def test_sentencepiece(spark):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = TEXTS + ["  a  b ", "▁x▁▁y", "</s> <unk>", "\x00", "a" * 300, " "]
    for r in sentencepiece_bpe.encode_decode(docs(spark, texts), path).collect():
        ids = sp.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert array.array("I", r.ids).tolist() == ids and r.decoded == sp.decode(ids)


EMAIL, IP = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD, PHONE = r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(d):
    return sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(EMAIL, t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(IP, t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in re.finditer(CARD, t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(PHONE, t) if 10 <= len(digits(m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


@pytest.mark.parametrize("letters", ["a.b@c-_ +1 23", "1234 .-5", "+1 (2).-34 5", "0.1 25@a.."])
def test_base_spans(letters):
    r = random.Random(letters)
    for _ in range(4000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        assert ",".join(f"{k}:{a}:{b}" for a, b, k in sanitize.base_spans(t)) == brute_spans(t)


def test_sanitize(spark):
    r = random.Random(1)
    fill = lambda: " ".join(r.choice(["amber", "birch", "cedar", "dune", "ember", "fjord"]) + str(r.randint(0, 99)) for _ in range(6))
    texts = [f"{fill()} zorblax{i % 1} jo@x.example.org zorblax {fill()}" for i in range(8)] + [f"{fill()} ann{i}@y.example.org {fill()}" for i in range(60)] + [None, "", "no data"]
    got = {x.doc_id: x for x in sanitize.spans(docs(spark, texts)).collect()}
    assert all(got[i].base_sha256 == hashlib.sha256(brute_spans(t or "").encode()).hexdigest() for i, t in enumerate(texts))
    assert all("drop" in got[i].spans or "term" in got[i].spans for i in range(8)) and not any("drop" in got[i].spans for i in range(8, 68))
    clean = {x.doc_id: x.text for x in sanitize.sanitize(docs(spark, texts)).collect()}
    assert "jo@" not in clean[0] and "zorblax" not in clean[0] and "[EMAIL]" in clean[0]
    assert clean[68] is None and clean[69] == "" and clean[70] == "no data"


def test_sanitize_values_that_occur_once(spark):
    texts = ["the quorvex wrote to jo@x.example.org about the plan"] + [f"the team wrote to ann{i}@y.example.org about the plan" for i in range(60)]
    got = {x.doc_id: x.spans for x in sanitize.spans(docs(spark, texts + texts[:1])).collect()}
    assert got[0] == got[61] == "term:4:11,email:21:37" and all(got[i] == brute_spans(texts[i]) for i in range(1, 61))


def test_sanitize_counts_terms_of_all_documents(spark):
    far = "the plan of this year was read and kept by the board until summer came"
    texts = [f"the quorvex wrote to jo@x.example.org about {far} quorvex", f"{far} quorvex {far} jo@x.example.org", f"{far} quorvex"]
    texts += [f"the team wrote in {i + 100} about {far}" for i in range(80)] + [f"team {far} ann@y.example.org"]
    got = {x.doc_id: x.spans for x in sanitize.spans(docs(spark, texts)).collect()}
    marked = [[t[int(a) : int(z)] for k, a, z in (x.split(":") for x in got[i].split(",") if x) if k in ("term", "drop")] for i, t in enumerate(texts)]
    assert marked[:3] == [["quorvex", "quorvex"], ["quorvex"], []] and not any(marked[3:])


def test_warc(spark):
    rows = [(5, "http://a", "x"), (3, None, "x"), (9, "u", None), (10, "u", ""), (11, "u\r\n", "é" * 99999)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    first = {"x": 3, "": 9, "é" * 99999: 11}
    for i, _, h in rows:
        b, f = (h or "").encode(), first[h or ""]
        want = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
    assert {r.page_id for r in warc.round_trip(df, 2).where("record_type = 'response'").collect()} == {3, 5, 9, 10, 11}


def test_salvage():
    make = lambda i: warc.make_record(f"urn:page:{i}", "http://x", b"b%d" % i * 50, warc.digest(b"b%d" % i * 50), len(b"b%d" % i * 50), None)
    packed = [warc._member(make(i)) for i in range(6)]
    data = bytearray(b"".join(packed))
    data[len(packed[0]) + 20] ^= 255
    data[len(b"".join(packed[:4])) : len(b"".join(packed[:4]))] = b"zz"
    got = list(warc.salvage(bytes(data)))
    assert [r["record_id"] for *_, r in got if not r["problem"]] == [f"urn:page:{i}" for i in (0, 2, 3, 4, 5)]
    assert [(a, b) for a, b, r in got if r["problem"]] == [(len(packed[0]), len(packed[0]) + len(packed[1])), (len(b"".join(packed[:4])), len(b"".join(packed[:4])) + 2)]
    plain = make(1) + make(2)[:-30] + make(3)
    assert [r.get("record_id") for *_, r in warc.salvage(plain)] == ["urn:page:1", None, "urn:page:3"]


def test_salvage_inside_a_member():
    r = random.Random(2)
    block = lambda i: bytes(r.randrange(256) for _ in range(3000)) + b"%d" % i
    made = [warc.make_record(f"urn:page:{i}", "http://x", b := block(i), warc.digest(b), len(b), None) for i in range(60)]
    ids = lambda data: [x["record_id"] for *_, x in warc.salvage(data) if not x["problem"]]
    gaps = lambda data: [(a, z) for a, z, x in warc.salvage(data) if x["problem"]]
    all_ids = [f"urn:page:{i}" for i in range(60)]
    bad = bytearray(b"".join(made))
    bad[len(made[0]) + 600] ^= 255
    one = warc._member(bytes(bad))
    assert ids(one) == all_ids[:1] + all_ids[2:] and gaps(one) == [(0, len(one))]
    whole = warc._member(b"".join(made))
    after = warc._member(made[5])
    assert len(ids(whole[: len(whole) * 9 // 10])) >= 53 and gaps(whole[:-9])
    assert ids(whole[:-6] + b"zz" + whole[-4:]) == all_ids
    assert ids(whole[:-6] + b"zz" + whole[-4:] + after) == all_ids + all_ids[5:6]
    c = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = bytearray(c.compress(b"".join(made)) + c.flush())
    stored[-6] ^= 255
    assert ids(bytes(stored) + after) == all_ids + all_ids[5:6]
    torn = bytearray(whole)
    torn[len(whole) // 2 : len(whole) // 2 + 400] = bytes(400)
    assert ids(bytes(torn) + after)[:25] == all_ids[:25] and ids(bytes(torn) + after)[-1] == "urn:page:5"


def test_suffix_dedup(spark):
    texts = TEXTS + ["ab" * 120, "ab" * 40 + "q" + "\x00" * 80, "\x00" * 90, TEXTS[20] + " tail " + TEXTS[30]]
    first, want = {}, {}
    for d, t in enumerate(texts):
        b = (t or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - 49):
            if first.get(b[i : i + 50], d) < d:
                m[i : i + 50] = b"\1" * 50
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
        runs = sum(m[i] and not (i and m[i - 1]) for i in range(len(m)))
        want[d] = (len(b), sum(m), runs, hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest())
    got = suffix_index.remove_repeats(docs(spark, texts)).collect()
    assert len(got) == len(texts) and all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in got)


def test_ngram_join(spark):
    n, percent = 4, 85
    low = [(t or "").translate({i: i + 32 for i in range(65, 91)}) for t in TEXTS]
    sets = [set(zip(*(w[k:] for k in range(n)))) if len(w := words(t)) >= n else ({tuple(w)} if w else set()) for t in low]
    root = list(range(len(sets)))
    for _ in sets:
        for i, x in enumerate(sets):
            for j in range(i):
                if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    got = ngram_join.jaccard_components(docs(spark, TEXTS), n, percent).collect()
    assert len(got) == len(TEXTS)
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root[r.doc_id]) for r in got)


def test_embeddings(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((40, 16))
    vec = [v + 0.05 * r.standard_normal(16) for v in base for _ in range(4)] + [base[0]] * 5
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vec)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [], 1)]
    got = {x.vec_id: x for x in embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cls int")).collect()}
    u = np.stack(vec)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(vec))])
    assert (found <= links).all() and found.sum() >= 0.9 * links.sum()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 905))


def test_packing(spark):
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = TEXTS + ["a <|endoftext|> b"]
    got = packing.pack_documents(docs(spark, texts), path, tokenizers.path("byte_bpe_50k.tiktoken")).toPandas()
    for d, t in enumerate(texts):
        ids, at = [*tok.encode(t or "", add_special_tokens=False).ids, 1], 0
        for x in got[got.doc_id == d].sort_values("start").itertuples():
            assert x.start == at and x.doc_tokens == len(ids) and zlib.crc32(array.array("I", ids[at : at + x.length]).tobytes()) == x.ids_crc32
            at += x.length
        assert at == len(ids)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and (n := g.length.sum()) <= 2048 and n & (n - 1) == 0


def test_licenses(spark):
    texts = [None, "", "Released under the MIT License.", "x\nThis work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.",
             "Permission is hereby granted, free of charge, to any person obtaining. The above copyright notice and this permission notice shall be included in all. The software is provided \"as is\", without warranty of any kind.", "My licence is my own license."]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    assert [got[i].licences for i in range(7)] == ["", "", "MIT", "GPL-3.0", "Apache-2.0", "MIT", ""] and got[6].n_unknown == 1


def test_weak_quality(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    got = weak_quality.classify(d).toPandas()
    both = labels.merge(got, on="doc_id")
    assert len(got) == d.count() and (both.kept == (both.quality == 1)).mean() >= 0.9
    assert (both[both.quality == 1].kept).mean() >= 0.98
    assert weak_quality.classify(docs(spark, [None, "", "x"])).count() == 3


@pytest.mark.parametrize(
    "run",
    [
        host_quality.quality, licenses.scan, sanitize.spans, sanitize.sanitize, suffix_index.remove_repeats, ngram_join.jaccard_components, weak_quality.classify,
        lambda d: packing.pack_documents(d, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken")),
        lambda d: sentencepiece_bpe.encode_decode(d, tokenizers.path("piece_bpe_32k.model")),
    ],
)
def test_empty_and_repeated_rows(spark, run):
    assert run(docs(spark, TEXTS).limit(0)).count() == 0
    assert run(docs(spark, [None, "same text here", "same text here"], [1, 2, 2])).count() >= 3


def test_empty_tables_of_other_kinds(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    d = docs(spark, [" ".join(f"d{i}w{j}" for j in range(80)) for i in range(12)] * 2 + [None, "", "too short"])
    n = []
    for _, stage in corpus_pipeline.STAGES:
        d = common.written(stage(spark, d, ""), "t")
        n.append(d.count())
    assert n[:4] == [24, 12, 12, 12] and {r.doc_id for r in d.collect()} == set(range(12))


def test_null_and_shared_ids(spark):
    import corpus_pipeline

    text = [" ".join(f"d{i}w{j}" for j in range(80)) for i in range(6)]
    rows = docs(spark, [text[0], text[1], text[2], text[0], text[3], text[4], text[4]], [1, None, None, 7, 7, 8, 8])
    d = common.written(corpus_pipeline.near_duplicates(spark, rows, ""), "t")
    want = {(1, text[0]), (None, text[1]), (None, text[2]), (7, text[3]), (8, text[4])}
    assert sorted(map(str, d.select("doc_id", "text").collect())) == sorted(str(d.sparkSession.createDataFrame([x], "doc_id long, text string").first()) for x in want)
    left = corpus_pipeline.repeated_passages(spark, rows, "").collect()
    assert {(r.doc_id, r.text) for r in left} == want
    got = {(r.doc_id, r.kept_sha256): r.n_removed for r in suffix_index.remove_repeats(rows).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {(i, sha(t)): 0 for i, t in want} | {(7, sha("")): len(text[0])}
    for _, stage in corpus_pipeline.STAGES[2:]:
        d = common.written(stage(spark, d, ""), "t")
    assert d.where("doc_id is null and start = 0").count() == 2
