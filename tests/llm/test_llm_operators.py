"""The training-data operators against brute force, on small tables with nulls, empties, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from hopscope.llm import ann, common, fingerprints, jaccard, langid, licenses, line_dedup, lm, mixing, packing, queries, token_files
from hopscope.llm.tokens import PieceEncoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score double, count long, tail string, _0 string"
ODD = ["", "   ", "\n\n", "a", "a  b ", " x\n y  z", "a \nb", "it's 'sfoo  we'll  \n ", "word " * 4000, "<|endoftext|> end", "été déjà　vu 東京 😀", "same text here for all of them", "same text here for all of them", "x" * 9000]


def table(spark, texts, ids=None, langs=None):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, (langs[k] if langs else "en"), "s", len(t or ""), "clash", 0.5, 7, "t", "u") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    texts = [*ODD, None, None, "same text here for all of them"]
    return table(spark, texts, [*range(len(ODD)), 100, None, 3]), texts


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_pieces_encode_like_the_whole_text():
    enc = PieceEncoder(queries.vocabulary(), cache=20)
    for _ in range(2):
        ids, off = enc.encode(pa.array([*ODD, None]), 2)
        for i, t in enumerate([*ODD, None]):
            assert ids[off[i] : off[i + 1]].tolist() == [*enc.model.encode(t or "", add_special_tokens=False).ids, 2]


def test_token_files_round_trip(spark, odd, empty):
    enc = PieceEncoder(queries.vocabulary())
    for df, texts in ((odd[0], odd[1]), (empty, [])):
        folder = common.Scratch(spark, "test").folder()
        manifest = token_files.write_token_files(df, folder, queries.vocabulary())
        got = token_files.read_token_files(spark, folder, manifest).collect()
        assert len(got) == len(texts)
        got.sort(key=lambda r: r["start"])
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
        assert ids == sorted(ids)
        at = 0
        for r in got:
            assert r["start"] == at
            at += r["n_tokens"]
        want = Counter(zlib.crc32(np.array([*enc.model.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for t in texts)
        assert Counter(r["ids_crc32"] for r in got) == want


def test_packing_is_whole_and_tight(spark, odd, empty):
    assert packing.best_two_fit(empty, queries.vocabulary(), 64).collect() == []
    got = packing.best_two_fit(odd[0], queries.vocabulary(), 64).collect()
    enc = PieceEncoder(queries.vocabulary())
    total = sum(len(enc.model.encode(t or "", add_special_tokens=False).ids) + 1 for t in odd[1])
    assert sum(r["length"] for r in got) == total
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 64
    assert len(bins) <= -(-total // 64) + 2


def test_two_small_pieces_replace_one():
    # greedy: 60 + 25, gap 15; 20 + 20 fill the expanded gap of 40
    made = packing.patterns({60: 1, 25: 1, 20: 2}, 100)
    assert made == [(1, {60: 1, 20: 2}), (1, {25: 1})]
    counts = {n: 3 + n % 5 for n in range(1, 300, 7)}
    back = Counter()
    for times, bin_ in packing.patterns(counts, 300):
        assert sum(s * k for s, k in bin_.items()) <= 300
        for s, k in bin_.items():
            back[s] += times * k
    assert back == counts


def test_lm_base_and_probabilities(spark, docs, texts, odd, empty):
    assert lm.log_likelihoods(empty, F.lit(True), ["doc_id"]).collect() == []
    learn = ~common.held("doc_id", 10, 0)
    got = {r["doc_id"]: r for r in lm.log_likelihoods(docs, learn, ["doc_id"]).collect()}
    c = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update([*words(t), ""])
    n, v = sum(c.values()), len(c)
    own = other = 0.0
    for i, t in texts.items():
        k = [*words(t), ""]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(k), sum(c[w] > 0 for w in k), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in k))
        if not zlib.crc32(str(i).encode()) % 10:
            own, other = own + r["score"], other + r["base_score"]
    assert own > other
    rows = lm.log_likelihoods(odd[0], F.lit(True), ["doc_id", "row"]).collect()
    assert len(rows) == len(odd[1]) and all(r["score"] <= 0 and r["row"] == "clash" for r in rows)
    none = lm.log_likelihoods(odd[0], F.lit(False), ["doc_id"]).collect()
    assert all(r["score"] == r["base_score"] for r in none)


def test_lm_sums_to_one():
    voc = lm.Vocabulary([f"w{i}" for i in range(3000)], [3000 - i for i in range(3000)], 50, 10_000, 3001, 10, 5, 100, 60)
    net = lm.Gru(voc)
    total = np.zeros(1)
    for start in range(0, 3002, 500):
        ids = np.arange(start, min(start + 500, 3002))
        pairs = np.stack([np.full(len(ids), 7), ids], 1).ravel()
        lp = net.score(voc, pairs, np.arange(0, len(pairs) + 1, 2))
        total += (10 ** lp[1::2]).sum()
    assert total[0] == pytest.approx(1, abs=1e-4)


def test_lm_windows_carry_state(monkeypatch):
    voc = lm.Vocabulary([f"w{i}" for i in range(300)], [300 - i for i in range(300)], 50, 10_000, 301, 10, 5, 100, 60)
    net, rng = lm.Gru(voc), np.random.default_rng(0)
    ids, off = rng.integers(0, 302, 700), np.array([0, 3, 3, 500, 700])
    whole = net.score(voc, ids, off)
    monkeypatch.setattr(lm, "WINDOW", 7)
    assert np.allclose(whole, net.score(voc, ids, off))


def test_lm_learns_from_all_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE_DOCS", 1)
    rng = np.random.default_rng(0)
    follow = rng.permutation(40)
    texts = []
    for _ in range(300):
        w = [int(rng.integers(40))]
        while len(w) < 200:
            w.append(int(follow[w[-1]]))  # each word tells the next
        texts.append(" ".join(f"w{x}" for x in w))
    total = lambda: sum(r["score"] for r in lm.log_likelihoods(table(spark, texts), F.lit(True), ["doc_id"]).collect())
    every = total()
    monkeypatch.setattr(lm, "fit", lambda rows, voc_b, start: start)
    assert every > 0.99 * total()  # logarithms: a sample of one text alone does worse


def test_mips_recall_and_odd_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    d = len(rows.first()["embedding"])
    bad = [(9001, None), (9002, [0.0] * d), (9003, [float("nan")] * d), (9004, [1.0]), (None, [1.0] * d), (9005, [None] * d)]
    same = [(9100 + i, [0.25] * d) for i in range(40)]
    both = rows.unionByName(spark.createDataFrame(bad + same, "vec_id long, embedding array<float>"))
    got = ann.nearest(both, F.col("vec_id") % 20 == 0).collect()
    data = {r[0]: np.array(r[1], float) for r in both.collect() if r[0] is not None and r[0] not in range(9001, 9006)}
    ids = np.array(sorted(data))
    x = np.stack([data[i] for i in ids])
    found = hits = 0
    for q in [i for i in ids if i % 20 == 0]:
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        s = (x * data[q]).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        assert [m[0] for m in mine] == list(range(1, 21))
        hits += len({m[1] for m in mine} & set(ids[order].tolist()))
        found += 20
        assert all(m[2] == pytest.approx(float((data[m[1]] * data[q]).sum()), abs=1e-12) for m in mine)
    assert hits / found >= 0.95
    assert ann.nearest(rows.where("false"), F.col("vec_id") % 20 == 0).collect() == []


def test_mips_recall_over_many_blocks(spark, monkeypatch):
    """Random vectors of odd length without any structure, repeats of rows and ids, hundreds of small blocks."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", 300)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(8)
    x = np.round(rng.standard_normal((3000, 33)), 3)
    ids = np.concatenate([np.arange(3000), [7, 7, 40, 40]])
    x = np.concatenate([x, x[[7, 9, 40, 40]]])
    docs = spark.createDataFrame([(int(i), [float(y) for y in v], "clash") for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in ann.nearest(docs, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        want = [int(ids[i]) for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        assert [m[0] for m in sorted(got[q])] == list(range(1, 21))
        hits += sum((Counter(m[1] for m in got[q]) & Counter(want)).values())
        assert all(q != m[1] for m in got[q])
    assert hits / (150 * 20) >= 0.9


def test_language_of_held_out_documents(spark, docs, odd, empty):
    got = langid.identify(docs, ~common.held("doc_id", 3, 1), ["doc_id", "lang"]).where(common.held("doc_id", 3, 1)).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    rows = langid.identify(odd[0], F.lit(True), ["doc_id", "score"]).collect()
    assert len(rows) == len(odd[1])
    assert langid.identify(odd[0], F.lit(False), ["doc_id"]).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, F.lit(True), ["doc_id"]).collect() == []


def test_code_switched_words_get_their_own_labels(docs):
    rows = docs.where("lang IN ('en', 'de')").select("text", "lang").limit(120).collect()
    model = langid.fit([r[0] for r in rows], [r[1] for r in rows])
    by = {lang: " ".join(next(r[0] for r in rows if r[1] == lang).split()[:12]) for lang in ("en", "de")}
    _, _, _, turns = langid.score_texts(model, pa.array([by["en"] + " " + by["de"]], pa.large_string()))
    assert 1 <= turns[0] <= 3


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    emit, trans, first = rng.random((5, 2)).astype(np.float32), rng.normal(size=(2, 2)), rng.normal(size=2)
    codes, off = np.array([0, 3, 1, 4, 2]), np.array([0, 3, 3, 5])
    got, _ = langid.forward_backward(emit, codes, off, trans, first)
    for a, b in ((0, 3), (3, 5)):
        total = np.zeros((b - a, 2))
        for path in np.ndindex(*[2] * (b - a)):
            p = math.exp(first[path[0]])
            for t, y in enumerate(path):
                p *= emit[codes[a + t], y] * (math.exp(trans[path[t - 1], y]) if t else 1)
            for t, y in enumerate(path):
                total[t, y] += p
        assert np.allclose(got[a:b], total / total.sum(1, keepdims=True), atol=1e-5)


def deleted(texts, min_words):
    """Brute force: lines of runs that began earlier, texts in order."""
    seq, first, out = [], {}, []
    for k, t in enumerate(texts):
        lines = [] if t is None else t.split("\n")
        seq.append(lines)
        gone = [False] * len(lines)
        for i in range(len(lines)):
            best = 0
            for a, b in first.get(lines[i], []):
                n = 0
                while i + n < len(lines) and b + n < len(seq[a]) and seq[a][b + n] == lines[i + n]:
                    n += 1
                best = max(best, n)
            if sum(len(x.split()) for x in lines[i : i + best]) >= min_words:
                gone[i : i + best] = [True] * best
            first.setdefault(lines[i], []).append((k, i))
        out.append((None if t is None else "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), sum(gone)))
    return out


@pytest.mark.parametrize("block, shipped", [(65_536, 64), (7, 2)])
def test_line_runs(spark, monkeypatch, block, shipped):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    monkeypatch.setattr(line_dedup, "SHIPPED", shipped)
    rng = np.random.default_rng(block)
    pool = [f"line {i} of words" for i in range(6)]
    texts = ["\n".join(pool[j] for j in rng.integers(0, 6, rng.integers(1, 14))) for _ in range(25)]
    texts += [texts[3], texts[3], None, "", "unique here\n" + texts[5], "\n".join([pool[0]] * 30)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(table(spark, texts), ["row"], min_words=12).collect()}
    for i, (text, n) in enumerate(deleted(texts, 12)):
        assert (got[i]["text"], got[i]["n_removed"]) == (text, n), i
        assert sum(x["lines"] for x in got[i]["removed"]) == n and got[i]["row"] == "clash"


def test_short_lines_go_by_default(spark):
    texts = [f"own line {i} of this text\nShare this page\n\nanother {i}\n" for i in range(9)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(table(spark, texts), []).collect()}
    for i, (text, n) in enumerate(deleted(texts, 1)):
        assert (got[i]["text"], got[i]["n_removed"]) == (text, n), i
    assert sum("Share this page" in r["text"] for r in got.values()) == 1


def test_line_dedup_of_odd_tables(odd, empty):
    assert line_dedup.dedup_lines(empty, []).collect() == []
    rows = line_dedup.dedup_lines(odd[0], [], min_words=5).collect()
    assert len(rows) == len(odd[1]) and sum(r["text"] is None for r in rows) == 2
    assert sum(r["n_removed"] for r in rows) == 2


def components_of(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * k >= 80 * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


@pytest.mark.parametrize("block", [1024, 4])
def test_jaccard_components(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(4)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 400, 120)) for _ in range(3)]
    texts = []
    for b in base:
        for _ in range(14):
            w = b.split()
            for _ in range(rng.integers(0, 4)):
                w[rng.integers(len(w))] = f"n{rng.integers(10**6)}"
            texts.append(" ".join(w))
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [" ".join(f"r{x}" for x in rng.integers(0, 10**6, 60)) + " " + passage for _ in range(12)]
    texts += ["a b c", "A b  c", "a b c d e f", None, "", " "]
    want, sizes = components_of(texts)
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in jaccard.near_duplicates(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == list(zip(want, sizes, strict=True))
    kept = {r["doc_id"] for r in jaccard.keep_first(table(spark, texts)).collect()}
    assert kept == set(want)


def test_jaccard_copies_meet_once_and_not_once_a_shingle(spark, monkeypatch):
    rows = [(s, c, c % 2) for s in range(50) for c in range(20)] + [(100, 3, 1), (100, 30, 30), (101, 5, 1), (101, 7, 1)]
    got = jaccard.meetings(spark.createDataFrame(rows, "s long, cid long, comp long").repartition(5)).collect()
    assert sorted((r["lo"], r["hi"], r["cid"], r["comp"], r["shared"]) for r in got) == sorted([(0, 19, c, c % 2, list(range(50))) for c in range(20)] + [(3, 30, 3, 1, [100]), (3, 30, 30, 30, [100])])
    monkeypatch.setattr(jaccard, "MEETING", 3)
    rng = np.random.default_rng(6)
    base, texts = [f"w{x}" for x in rng.integers(0, 400, 120)], []
    for _ in range(40):  # some link with others only by a third, some with none
        w = list(base)
        for _ in range(rng.integers(0, 6)):
            w[rng.integers(len(w))] = f"n{rng.integers(10**6)}"
        texts.append(" ".join(w))
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in jaccard.near_duplicates(table(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == list(zip(*components_of(texts), strict=True))


def test_jaccard_of_odd_tables(odd, empty):
    assert jaccard.near_duplicates(empty).collect() == []
    rows = jaccard.near_duplicates(odd[0]).collect()
    assert len(rows) == len(odd[1])
    same = [r for r in rows if r["n_shingles"] == 3]
    assert {r["component_id"] for r in same} == {3} and len(same) == 3
    left = jaccard.keep_first(odd[0])
    assert left.columns == odd[0].columns and left.where("text LIKE 'same text%'").count() == 1


def test_rtree_finds_all_pairs_within_its_bound():
    rng = np.random.default_rng(2)
    points = rng.poisson(2.0, (300, jaccard.GROUPS))
    points[50:90] = points[50] + (rng.random((40, jaccard.GROUPS)) < 0.03)
    sizes = points.sum(1)
    got = {tuple(sorted(p)) for i, j in jaccard.RTree(points, sizes).pairs() for p in zip(i.tolist(), j.tolist(), strict=True)}
    want = set()
    for i in range(300):
        bound = np.minimum(points[i], points).sum(1)
        want |= {(i, j) for j in range(i + 1, 300) if jaccard.linked(bound[j], sizes[i], sizes[j])}
    assert want <= got and len(got) == len(want)


def test_fingerprints(spark, docs, texts, odd, empty):
    assert fingerprints.with_next(empty).collect() == []
    got = {r["doc_id"]: r for r in fingerprints.with_next(docs).collect()}
    ids = sorted(texts)
    errors = []
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        t, r = texts[a], got[a]
        k = len(t) // 4
        edited = t[: len(t) - k] + texts[b][:k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        x, y = shingles(t), shingles(edited)
        errors.append(r["near_edited"] - len(x & y) / len(x | y))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07
    rows = fingerprints.with_next(odd[0]).collect()
    assert len(rows) == len(odd[1])
    alike = {r["fingerprint"] for r in rows if r["n_chars"] == len("same text here for all of them")}
    assert len(alike) == 1
    assert all(r["fingerprint"] == "" for r in rows if r["n_chars"] == 0)


def test_next_document_crosses_buckets(spark, docs, monkeypatch):
    want = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.with_next(docs).collect()}
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 20_000)
    assert {r["doc_id"]: r["edited_sha256"] for r in fingerprints.with_next(docs).collect()} == want


def test_licenses(spark, odd, empty):
    assert licenses.scan(empty, ["doc_id"]).collect() == []
    notices = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0"}
    plain = "he lost his driving license last week\nand the rest is prose about nothing"
    texts = [f"first line of prose\n{n}\nlast line" for n in notices] + [plain, "Licensed under the Frobnicator Community License.", None, ""]
    rows = {r["doc_id"]: r for r in licenses.scan(table(spark, texts), ["doc_id", "row"]).collect()}
    for i, family in enumerate(notices.values()):
        assert rows[i]["licenses"] == [family] and rows[i]["n_paragraphs"] == 3
        assert [f["paragraph"] for f in rows[i]["findings"]] == [1]
    for i in range(len(notices), len(texts)):
        assert rows[i]["licenses"] == []
    assert rows[len(texts) - 1]["n_paragraphs"] == 0
    assert licenses.scan(odd[0], ["doc_id"]).count() == len(odd[1])


def test_wrapped_licenses(spark):
    texts = {
        "MIT": "Copyright (c) 2020\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
        "ISC": "/*\n * Permission to use, copy, modify, and/or distribute this software for any\n * purpose with or without fee is hereby granted, provided that the above\n */",
        "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:\n\n1. Redistributions",
        "GPL-3.0": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.",
        "Proprietary": "a line of prose before it\nThis document is confidential and proprietary, all\nrights\nreserved.",
    }
    begin = {"MIT": 2, "ISC": 1, "BSD-3-Clause": 0, "GPL-3.0": 0, "Proprietary": 1}
    rows = licenses.scan(table(spark, list(texts.values())), ["doc_id"]).collect()
    for r in rows:
        family = list(texts)[r["doc_id"]]
        assert r["licenses"] == [family]
        assert begin[family] in [f["paragraph"] for f in r["findings"] if f["confirmed"]]
    apart = texts["MIT"].replace("a copy\nof", "a copy\n\nof")  # a blank line parts paragraphs
    assert licenses.scan(table(spark, [apart]), ["doc_id"]).first()["licenses"] == []


def test_mixing(spark, odd, empty):
    rng = np.random.default_rng(0)
    kinds = ["good", "low", "toxic"]
    texts, labels = [], []
    for i in range(300):
        kind = kinds[int(rng.integers(3))]
        texts.append(" ".join(f"{kind if rng.random() < 0.5 else 'any'}{rng.integers(8)}" for _ in range(60)))
        labels.append((i, kind))
    docs = table(spark, texts)
    table_ = spark.createDataFrame(labels[:200] + [(0, None), (None, "low"), (99999, "good")], "doc_id long, domain string")
    rows = mixing.mix(docs, table_, {"good": 1.5, "low": 0.5, "toxic": 0.0}, ["doc_id", "row"]).collect()
    total = {k: sum(r["n_tokens"] * r[f"p_{k}"] for r in rows) for k in kinds}
    got = {k: sum(r["n_tokens"] * r[f"p_{k}"] * r["rate"] for r in rows) for k in kinds}
    for k, share in (("good", 1.5), ("low", 0.5), ("toxic", 0.0)):
        assert got[k] == pytest.approx(share * total[k], abs=0.03 * sum(total.values()))
    assert all(r["rate"] >= 0 for r in rows)
    best = {r["doc_id"]: max(kinds, key=lambda k: r[f"p_{k}"]) for r in rows}
    assert np.mean([best[i] == k for i, k in labels]) > 0.95
    assert mixing.mix(empty, table_, {}, ["doc_id"]).collect() == []
    plain = mixing.mix(odd[0], table_.where("false"), {}, ["doc_id", "count"]).collect()
    assert len(plain) == len(odd[1]) and all(r["rate"] == 1 and r["p_all"] == 1 for r in plain)


def test_words_of_slices_that_begin_inside_a_batch():
    texts = [f"Été NUMBER {i} déjà vu " + "x" * 40 for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    seen = []
    for piece in common.slices(batch, most=700):
        flat, off = common.words_of(piece.column("text"))
        flat.validate(full=True)
        seen += [flat[a:b].to_pylist() for a, b in zip(off, off[1:], strict=False)]
    assert seen == [words(t) for t in texts]


def test_packed_pieces_hold_the_library_s_ids(spark, odd):
    """Pieces, starts and checksums of every document against the tokenizers library; only longer documents are cut."""
    enc = PieceEncoder(queries.vocabulary())
    capacity = 64
    want = []
    for t in odd[1]:
        ids = [*enc.model.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) - (len(ids) - 1) // capacity * capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want.append(sorted((i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))))
    got = Counter()
    by = {}
    for r in packing.best_two_fit(odd[0], queries.vocabulary(), capacity).collect():
        by.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        got[r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    assert got == Counter(p for pieces in want for p in pieces)
    ids = [*range(len(ODD)), 100, None, 3]
    for i, pieces in zip(ids, want, strict=True):
        if ids.count(i) == 1:
            assert sorted(by[i]) == pieces
    starts = {}
    for r in packing.best_two_fit(odd[0], queries.vocabulary(), capacity).collect():
        starts.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= capacity for x in starts.values())


def test_rates_are_those_of_nonnegative_least_squares(spark):
    rng = np.random.default_rng(3)
    member = np.round(rng.dirichlet([0.3, 0.3, 0.3], 200), 2)
    tokens = rng.integers(0, 500, 200)
    df = spark.createDataFrame([(int(t), [float(x) for x in p]) for t, p in zip(tokens, member, strict=True)], "tokens long, member array<double>")
    a = (member * tokens[:, None]).T
    for shares in ([1.4, 0.5, 0.2], [0.0, 1.0, 1.0], [1.0, 1.0, 1.0], [1.03, 1.03, 1.03], [0.97, 0.97, 0.97], [1.03, 0.97, 1.0], [0.0, 0.0, 3.0]):
        want = a.sum(1) * shares
        rates, target, now = mixing.fit_rates(df, 3, None, shares)
        assert target == pytest.approx(want)
        rows = df.join(rates, "member").collect()
        assert len(rows) == 200
        total = sum(np.array(r["member"]) * r["tokens"] * r["rate"] for r in rows)
        assert total == pytest.approx(now) and all(r["rate"] >= 0 for r in rows)
        w = np.ones(200)  # brute force: descent on one rate at a time
        left = want - a @ w
        for _ in range(300):
            for i in np.flatnonzero(tokens):
                new = max(0.0, w[i] + a[:, i] @ left / (a[:, i] @ a[:, i]))
                left -= a[:, i] * (new - w[i])
                w[i] = new
        # the last case has targets that can't be met
        assert np.sqrt(((total - want) ** 2).sum()) <= np.sqrt((left**2).sum()) + 0.001 * a.sum()
        if shares == [1.0, 1.0, 1.0]:
            assert all(r["rate"] == 1 for r in rows)


def test_every_feature_word_has_a_slot_of_its_own():
    rng = np.random.default_rng(1)
    buckets = [int(x) for x in rng.choice(mixing.BUCKETS, mixing.FEATURES, replace=False)]
    place, shift = mixing._slots(buckets)
    at = lambda h: place[((h >> mixing.SPLIT) + shift[h & ((1 << mixing.SPLIT) - 1)]) % mixing.SLOTS]
    assert [at(h) for h in buckets] == list(range(1, len(buckets) + 1))


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def packed_codes(text):
    """A fingerprint by hand: hash, bin, borrow, pack."""
    import xxhash

    w = words((text or "").lower())
    if not w:
        return ""
    least = {}
    for i in range(max(1, len(w) - 4)):
        h = 42
        for x in w[i : i + 5]:
            h = xxhash.xxh64_intdigest(x.encode(), h)
        h = signed(h)
        b = (h >> fingerprints._SHIFT) + fingerprints.BINS // 2
        least[b] = min(h, least.get(b, h))
    orders = fingerprints._orders()
    values = [least[j] if j in least else next(least[o] for o in orders[j] if o in least) for j in range(fingerprints.BINS)]
    codes = [v & 255 for v in values]
    return "".join(f"{sum(c << 8 * k for k, c in enumerate(codes[q : q + 8])):016x}" for q in range(0, fingerprints.BINS, 8))


def alike(a, b):
    if not a or not b:
        return float(a == b)
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    same = sum(p == q for p, q in zip(x, y, strict=True)) / fingerprints.BINS
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def test_fingerprints_by_hand(spark, texts, monkeypatch):
    some = sorted(texts)[:60]
    rows = [(i, texts[i]) for i in some] + [(10_000, ""), (10_001, "one two"), (10_002, None), (10_003, "one two"), (10_004, "word " * 3000)]
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 8 << 10)  # many buckets
    got = {r["doc_id"]: r for r in fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == packed_codes(t) and r["edited_fingerprint"] == packed_codes(edited)
        assert r["near_edited"] == pytest.approx(alike(packed_codes(t), packed_codes(edited)))
        assert r["near_next"] == pytest.approx(alike(packed_codes(t), packed_codes(after)))


def test_language_query_ties_and_many_labels(spark, monkeypatch):
    """More labels than 64 are all learned; a text of two languages in equal parts gets one of them; equal rows are judged alike."""
    for name, value in (("STEPS", 2), ("SEQUENCES", 100)):  # a small fit
        monkeypatch.setattr(langid, name, value)
    rng = np.random.default_rng(2)
    stems = [f"{a}{b}" for a in "bdfgklmnpr" for b in "aeiou"] + [f"{a}{b}s" for a in "bdfgk" for b in "aeiou"]
    text = lambda k, n: " ".join(stems[k] * int(rng.integers(1, 3)) + stems[k] for _ in range(n))
    rows = [(k * 20 + j, text(k, 40), f"l{k:02}") for k in range(70) for j in range(4)]
    docs = spark.createDataFrame([*rows, (9001, rows[0][1] + " " + rows[4][1], None), (9001, rows[0][1] + " " + rows[4][1], None)], "doc_id long, text string, lang string")
    model = langid.fit(*langid.sample(docs, F.lit(True), "text", "lang"))
    assert len(model.labels) == 70
    got = [r for r in langid.identify(docs, F.lit(True), ["doc_id"]).collect() if r["doc_id"] == 9001]
    assert len(got) == 2 and got[0] == got[1] and 0 <= got[0]["score"] <= 1


def test_kept_columns_with_names_of_outputs(spark, odd):
    docs = odd[0]
    assert langid.identify(docs, F.lit(True), ["doc_id", "score"]).columns == ["doc_id", "score_", "lang_pred", "score", "n_words", "n_switches"]
    assert mixing.mix(docs, spark.createDataFrame([], "doc_id long, domain string"), {}, ["doc_id", "n_chars"]).columns[:3] == ["doc_id", "n_chars", "n_tokens"]
    odd_names = docs.select("doc_id", "text", F.lit(1).alias("a.b"), F.lit(2).alias("n_lines"))
    assert line_dedup.dedup_lines(odd_names, ["a.b", "n_lines"]).columns == ["doc_id", "a.b", "n_lines_", "text", "n_lines", "n_removed", "removed"]


def test_weights_of_words_are_not_parsed_one_by_one(spark, monkeypatch):
    """Thousands of literals in an expression filled the driver; sums are those of the weights."""
    texts, real = [], mixing.F.expr
    monkeypatch.setattr(mixing.F, "expr", lambda sql: texts.append(sql) or real(sql))
    words = [f"w{i}" for i in range(40)]
    ids = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.pmod(F.xxhash64("w"), F.lit(mixing.BUCKETS)).cast("int").alias("b")).collect()
    buckets = [r["b"] for r in ids[:30]]
    weights = np.round(np.random.default_rng(1).normal(size=(2, 30)), 6)
    domains = mixing.Domains(["a", "b"], buckets, weights, np.zeros((2, 3)))
    rows = spark.createDataFrame([(words[3:35] + words[5:9],), ([],)], "words array<string>")
    got = [r[0] for r in rows.select(domains.sums("words")).collect()]
    assert np.allclose(got, [weights[:, 3:].sum(1), [0, 0]], atol=1e-9)
    assert len(re.findall(r"[0-9]+", re.sub("'[^']*'", "", texts[-1]))) < 100


def test_lm_blocks_give_equal_results(monkeypatch):
    voc = lm.Vocabulary([f"w{i}" for i in range(3000)], [3000 - i for i in range(3000)], 50, 10_000, 3001, 10, 5, 100, 60)
    rng = np.random.default_rng(1)
    docs = [(np.append(rng.zipf(1.2, 900).clip(1, 3001), 0), True) for _ in range(9)]
    ids, off = np.concatenate([d for d, _ in docs]), np.arange(10) * 901

    def trained():
        net = lm.Gru(voc)
        net.train(voc, docs)
        return net, net.score(voc, ids, off)

    net, whole = trained()
    monkeypatch.setattr(lm, "BLOCK", 50)
    assert np.allclose(trained()[1], whole, atol=1e-3)
    monkeypatch.setattr(lm, "_bounded", lambda w, b: False)  # the way for logits that exp could not take
    assert np.allclose(trained()[1], whole, atol=1e-3)
    net.p["wc"] *= 1e4
    net.p["wx"] *= 1e4
    monkeypatch.undo()
    assert np.isfinite(net.score(voc, ids, off)).all()


def test_language_features_are_bounded_in_memory():
    model = langid.fit(["the cat sat on the mat and ran away", "der Hund lief zum Haus und blieb da"] * 3, ["en", "de"] * 3)
    texts = pa.array([" ".join(f"word{i}x{j}" for j in range(500)) for i in range(400)], pa.large_string())
    tracemalloc.start()
    _, value, size, _ = langid.score_texts(model, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size.sum() == 200_000 and peak < 60 << 20  # distinct words: features of all at once took 181 MB
    few = langid.score_texts(model, texts.slice(390, 3))  # no words in common with other slices
    assert np.array_equal(few[1], value[390:393])


def test_packing_slices_are_bounded_in_memory():
    enc = PieceEncoder(queries.vocabulary())
    batch = pa.RecordBatch.from_pydict({"text": pa.array([" ".join(f"w{i % 7}{j}" for j in range(500)) for i in range(2_500)], pa.string())})
    tracemalloc.start()
    for rows in common.slices(batch, most=packing.SLICE):
        enc.encode(rows.column("text"), 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * packing.SLICE <= 64 << 20
