"""Hot keys, null and repeated ids, very long words and texts, damaged archives, licence notices as found in the wild."""

import array
import random
import time

import numpy as np
import pytest

from tracelith.llm import common, embed_dedup, host_quality, licenses, ngram_join, packing, sanitize, sentencepiece_bpe, suffix_index, warc, weak_quality

tokenizers = pytest.importorskip("public_tokenizers")
DOC = "doc_id long, text string, source string, n_chars long"
BIG = 2**53 + 1


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


def docs(spark, texts, ids=None, sources=None):
    ids = range(len(texts)) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    return spark.createDataFrame([(i, t, s, 0) for i, t, s in zip(ids, texts, sources)], DOC)


GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""
BSD3 = """Copyright (c) 2019, The Authors. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""


def test_licence_notices(spark):
    cases = [
        (GPL2, "GPL-2.0-or-later"), (GPL2.replace("version 2", "version 3"), "GPL-3.0-or-later"), (APACHE, "Apache-2.0"), (BSD3, "BSD-3-Clause"),
        ("\n".join(x for x in BSD3.split("\n") if not x.startswith(("3.", "   may", "   without"))), "BSD-2-Clause"),
        ("SPDX-License-Identifier: MIT OR Apache-2.0\nint main;", "MIT,Apache-2.0"), ("// SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"), ("x released into the public\ndomain", "Unlicense"),
        ("Not the MIT license", ""), ("Licensed under GPLv3", "GPL-3.0"), ("Licensed under either of Apache License, Version 2.0 or MIT License.", "Apache-2.0,MIT"),
        ("Copyright (c) 2020 Foo Inc. All rights reserved.", "Proprietary"), ("Subject to the Mozilla Public License, v. 2.0.", "MPL-2.0"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose is granted.", "ISC"), ("a licence to print money", ""),
        ("MIT license. Much later: the MIT license.", "MIT"),
    ]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, [t for t, _ in cases])).collect()}
    assert [got[i].licences for i in range(len(cases))] == [want for _, want in cases]
    assert got[len(cases) - 1].matches == "MIT,MIT"


def test_long_unspaced_words(spark):
    import sentencepiece

    path = tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(5)
    texts = ["".join(r.choice(s) for _ in range(n)) for s in ("ab", "aeiouнет日本語", "abcdefghij", "the of and ") for n in (65, 300, 3000, 6000)] + ["aaaa" * 200, "abab" * 500, "日本語" * 700]
    for x in sentencepiece_bpe.encode_decode(docs(spark, texts), path).collect():
        assert array.array("I", x.ids).tolist() == sp.encode(texts[x.doc_id], add_bos=True, add_eos=True)
    m = sentencepiece_bpe.model(path)
    assert all(len(w) <= sentencepiece_bpe.KEPT for w in m.known)


def test_null_and_large_ids_stay(spark):
    texts, ids = ["one two three"] * 4, [None, BIG, BIG, 7]
    d = docs(spark, texts, ids)
    runs = [
        host_quality.quality, licenses.scan, sanitize.spans, suffix_index.remove_repeats, ngram_join.jaccard_components, weak_quality.classify,
        lambda x: packing.pack_documents(x, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken")),
        lambda x: sentencepiece_bpe.encode_decode(x, tokenizers.path("piece_bpe_32k.model")),
    ]
    for run in runs:
        assert sorted(r.doc_id or 0 for r in run(d).collect()) == [0, 7, BIG, BIG], run
    pages = spark.createDataFrame([(None, "u", "x", 1), (BIG, "u", "x", 1), (BIG, "u", "x", 1), (BIG + 2, "u", "x", 1)], "page_id long, url string, html string, payload long")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    assert got == [(0, "response", None), (BIG, "response", None), (BIG, "response", None), (BIG + 2, "revisit", BIG)]
    v = spark.createDataFrame([(None, [1.0, 0.0]), (BIG, [2.0, 0.0]), (BIG, [0.0, 1.0]), (5, None)], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id or 0, r.n_links) for r in embed_dedup.near_duplicates(v).collect())
    assert got == [(0, 1), (5, 0), (BIG, 0), (BIG, 1)]


def test_one_document_hosts_are_pulled_to_the_mean(spark):
    good = [" ".join(f"g{i}x{j}" for j in range(60)) for i in range(40)]
    texts = [t if i % 2 else "too short" for i, t in enumerate(good)]
    d = docs(spark, texts, sources=[f"h{i}" for i in range(40)])
    rates = [r.rate_base for r in host_quality.host_verdicts(host_quality.failures(host_quality.measure(d))).collect()]
    assert all(abs(x - 0.5) < 0.01 for x in rates)
    assert {r.host_verdict for r in host_quality.quality(d).collect()} == {"pass"}


def test_false_magics_are_passed_in_linear_time():
    make = lambda i: warc._member(warc.make_record(f"urn:page:{i}", "http://x", b"b%d" % i, warc.digest(b"b%d" % i), 2, None))
    junk = b"\x1f\x8b\x08\xe0" * 250_000
    t = time.time()
    got = list(warc.salvage(make(1) + junk + make(2)))
    assert [r["record_id"] for *_, r in got if not r["problem"]] == ["urn:page:1", "urn:page:2"] and time.time() - t < 10


def test_packing_over_many_partitions(spark):
    texts = [f"word{i} " * (1 + i % 37) for i in range(1500)]
    d = docs(spark, texts).repartition(200)
    got = packing.pack_documents(d, tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken")).toPandas()
    ends = got.sort_values(["doc_id", "start"]).groupby("doc_id").agg(n=("length", "sum"), want=("doc_tokens", "first"))
    assert len(ends) == 1500 and (ends.n == ends.want).all()
    sizes = got.groupby("sequence_id")["length"].sum()
    short = sizes[sizes < 2048]
    assert short.is_unique and all(n & (n - 1) == 0 for n in short) and (sizes <= 2048).all()
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all()


def test_hot_group_of_near_copies(spark):
    """5,000 near copies, half of them just below the threshold of the others, against exact components."""
    r = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for i in range(5000):
        w = list(base)
        for k in r.sample(range(100), 3 if i % 2 else 5):
            w[k] = f"e{i}x{k}"
        texts.append(" ".join(w))
    n, percent = 4, 85
    sets = [frozenset(zip(*(t.split()[k:] for k in range(n)))) for t in texts]
    vocab: dict = {}
    m = np.zeros((5000, 97 * 40), np.float32)
    for i, s in enumerate(sets):
        for g in s:
            if all(w[0] == "b" for w in g):  # the others are of one text each
                m[i, vocab.setdefault(g, len(vocab))] = 1
    size = np.array([len(s) for s in sets])
    m = m[:, : len(vocab)]
    both = m @ m.T
    link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    comp = np.arange(5000)
    while True:
        low = np.array([min(comp[i], comp[row].min(initial=5000)) for i, row in enumerate(link)])
        low = np.minimum(low, low[low])
        if (low == comp).all():
            break
        comp = low
    got = {x.doc_id: x.component_id for x in ngram_join.jaccard_components(docs(spark, texts).repartition(4), n, percent).collect()}
    assert all(got[i] == comp[i] for i in range(5000))
    assert 1 < len(set(comp.tolist())) < 5000


def test_a_passage_in_every_document(spark):
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"d{i}w{j}" for j in range(40)) + " " + passage + " " + " ".join(f"z{i}w{r.random()}" for j in range(20)) for i in range(400)]
    got = {x.doc_id: x for x in suffix_index.remove_repeats(docs(spark, texts).repartition(7)).collect()}
    assert got[0].n_removed == 0
    assert all(got[i].n_spans == 1 and len(passage) <= got[i].n_removed <= len(passage) + 12 for i in range(1, 400))


def test_very_long_texts(spark):
    r = random.Random(8)
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(200_000))
    texts = [long, long[:700_000], "x" * 300_000]
    got = {x.doc_id: x for x in suffix_index.remove_repeats(docs(spark, texts)).collect()}
    assert got[1].n_removed == 700_000 and got[0].n_bytes == len(long)
    got = {x.doc_id: x for x in ngram_join.jaccard_components(docs(spark, texts + [long + " end"])).collect()}
    assert got[3].component_id == 0 and got[1].component_id == 1
    pieces = packing.pack_documents(docs(spark, texts), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken")).toPandas()
    assert (pieces.groupby("doc_id")["length"].sum() == pieces.groupby("doc_id")["doc_tokens"].first()).all()


def test_scorer_sample_is_bounded_in_rows(spark, monkeypatch):
    monkeypatch.setattr(weak_quality, "SAMPLE", 10)
    seen = []
    fit = weak_quality.fit_scorer
    monkeypatch.setattr(weak_quality, "fit_scorer", lambda rows, target, **k: seen.append(len(rows)) or fit(rows, target, **k))
    weak_quality.classify(docs(spark, [f"text number {i}" for i in range(60)], [1] * 60)).count()
    assert seen == [10]


def test_ngram_pairs_of_joined_sets_are_not_compared_again(spark, monkeypatch):
    """sets that earlier links joined go to no further unit, neither by listed pairs nor by large groups; the components stay whole."""
    common.ship(spark)
    r = random.Random(8)
    rows = []
    for c in range(4):
        base = [f"w{c}x{i}" for i in range(240)]
        for k in range(30):
            words = list(base)
            for at in r.sample(range(240), 2):
                words[at] = f"n{c}x{k}x{at}"
            rows.append((100 * c + k, " ".join(words)))
    seen = {}
    keep = ngram_join.written

    def spy(df, name):
        out = keep(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "written", spy)
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    got = {x.doc_id: x.component_id for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(236)} for d, t in rows for w in [t.split(" ")]}
    want = {d: d for d in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in range(30):
        for a, b in pairs:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want and len(pairs) > 500
    assert sum(seen["links"]) <= 2 * len(sets)
    assert sum(seen["partnered"]) <= 2 * len(sets)


def test_anchor_ranges_follow_the_text(spark, monkeypatch):
    """what a task holds does not grow with the table: Arrow batches are bounded in bytes, and few partitions get more ranges, one a task."""
    assert int(spark.conf.get(common.BATCH_BYTES)) <= 8 << 20
    asked = []
    scan = suffix_index._scan
    monkeypatch.setattr(suffix_index, "_scan", lambda buckets: asked.append(buckets) or scan(buckets))
    monkeypatch.setattr(suffix_index, "CHUNKS_A_BUCKET", 0.01)
    shared = "one passage of more than fifty bytes that every document of this table has "
    rows = [(i, shared + f"and words {i} of its own {i * i}") for i in range(40)]
    got = {x.doc_id: x.n_removed for x in suffix_index.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert asked == [200] and got[0] == 0 and all(got[i] >= len(shared) for i in range(1, 40))


def test_pairs_of_several_groups_leave_their_family_once(spark, monkeypatch):
    """Pipeline's disk: pairs that bitmaps rule out are told where a set comes once for all groups of a hub; no list of pairs travels with bitmaps."""
    r = random.Random(4)
    rows = []
    for k in range(24):  # every two share some two thirds of their shingles
        words = [f"w{i}" for i in range(600)]
        for at in r.sample(range(600), 12):
            words[at] = f"n{k}x{at}"
        rows.append((k, " ".join(words)))
    seen = {}
    keep, pairs = ngram_join.written, ngram_join._group_pairs

    def spy(df, name):
        out = keep(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "written", spy)
    got = {x.doc_id: x.component_id for x in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == {k: k for k in range(24)}
    assert len(seen["hopeful"]) == 1  # the list of hubs; the pairs of groups need none

    import pyarrow as pa

    sets = [ngram_join.shingles([t], 5)[1] for _, t in rows]
    cols = {"hub": [0] * 3, "part": [0] * 3, "node": [0, 1, 2], "label": [0, 1, 1], "size": [len(x) for x in sets[:3]]}
    near = [sets[0], sets[0][:-9], sets[2]]
    batch = pa.record_batch({c: pa.array(v) for c, v in cols.items()} | {"bits": pa.array([ngram_join._bitmap(x) for x in near]), "groups": pa.array([[5, 6], [5, 6, 7], [5, 7]])})
    out = [p for b in pairs(80)(iter([batch])) for p in zip(b["a"].to_pylist(), b["b"].to_pylist())]
    assert out == [(0, 1)]  # once, though in two groups; 1 and 2 bear one label, 0 and 2 are too far apart


def test_components_write_few_files(spark, monkeypatch):
    """Pipeline's memory on check_h: tables of a few edges aren't a file for each of many shuffle partitions, and components stay whole."""
    files = []
    keep = common.written

    def spy(df, name):
        out = keep(df, name)
        if name in ("low", "large"):
            files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(common, "written", spy)
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        edges = spark.createDataFrame([(10 * c + k, 10 * c + k + 1) for c in range(200) for k in range(2)], "a long, b long")
        got = {x.node: x.component for x in common.components(edges).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {10 * c + k: 10 * c for c in range(200) for k in range(3)}
    assert files and max(files) <= common.LEAST_FILES
