"""Long texts: longer than the slices that tasks work on for operators on tokens and words, and of thousands of lines for those on lines and sets and for the pipeline."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_llm_operators import words

import corpus_pipeline
from hopscope.llm import common, fingerprints, jaccard, langid, licenses, line_dedup, lm, mixing, packing, queries, token_files
from hopscope.llm.tokens import encoder

NOTICE = "Released under the MIT License."


def prose(seed, size):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(4000)]
    out, n = [], 0
    while n < size:
        out.append(" ".join(rng.choices(pool, k=12)))
        n += len(out[-1]) + 1
    return out


@pytest.fixture(scope="module", params=[common.SLICE_BYTES + (1 << 20)])
def texts(request):
    return long_texts(request.param)


def long_texts(size):
    lines = prose(1, size)
    at = len(lines) // 2
    whole = "\n".join([*lines[:at], NOTICE, *lines[at:]])
    return {1: whole, 2: whole.replace(lines[at + 5], "another line of its own words here", 1), 3: "\n".join(prose(2, 5_000)), 4: "\n".join(prose(3, 20_000)), 5: "", 6: None, 7: "\n".join(prose(4, 3_000))}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return table_of(spark, texts)


def table_of(spark, texts):
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in texts.items()]
    path = f"{common.Scratch(spark, 'long').folder()}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def counts(texts):
    return {i: len(words(t)) for i, t in texts.items()}


def test_token_operators(spark, docs, texts):
    enc = encoder(queries.vocabulary())
    sizes = {i: len(enc.model.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}
    folder = common.Scratch(spark, "test").folder()
    manifest = token_files.write_token_files(docs, folder, queries.vocabulary())
    assert {r["doc_id"]: r["n_tokens"] for r in token_files.read_token_files(spark, folder, manifest).collect()} == sizes
    packed = packing.best_two_fit(docs, queries.vocabulary())
    assert {r["doc_id"]: r["n"] for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == sizes
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_word_operators(spark, docs, texts, counts):
    got = {r["doc_id"]: r for r in langid.identify(docs, F.lit(True), ["doc_id"]).collect()}
    assert {i: r["n_words"] for i, r in got.items()} == counts
    labels = spark.createDataFrame([(3, "good"), (4, "low"), (7, "low")], "doc_id long, domain string")
    assert {r["doc_id"]: r["n_tokens"] for r in mixing.mix(docs, labels, {}, ["doc_id"]).collect()}.keys() == texts.keys()
    scored = {r["doc_id"]: r for r in lm.log_likelihoods(docs, F.col("doc_id") != 2, ["doc_id"]).collect()}
    assert {i: r["n_tokens"] - 1 for i, r in scored.items()} == counts and scored[2]["score"] < 0


@pytest.fixture(scope="module")
def lined(spark):
    texts = long_texts(120_000)
    return table_of(spark, texts), texts


def test_line_and_set_operators(spark, lined):
    docs, texts = lined
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, ["doc_id"]).select("doc_id", "text", "n_removed").collect()}
    assert out[1]["text"] == texts[1] and out[2]["text"] == "another line of its own words here"
    links = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert links == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7}
    prints = {r["doc_id"]: r for r in fingerprints.with_next(docs).collect()}
    assert {i: r["n_chars"] for i, r in prints.items()} == {i: len(t or "") for i, t in texts.items()}
    assert prints[1]["near_next"] > 0.9 and prints[1]["near_edited"] > 0.5
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs, ["doc_id"]).collect()}
    assert found == {i: (["MIT"] if i in (1, 2) else []) for i in texts}


def test_stages(spark, lined):
    rows, tables = lined[0], common.Scratch(spark, "stages")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = tables.cut(stage(spark, rows, SF))
        kept[name] = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        rows = out
    assert kept["language ID"] == Counter([1, 2, 3, 4, 7])
    assert set(kept["line dedup"]) == set(kept["n-gram Jaccard join"]) == {1, 2, 3, 4, 7}
    assert 1 in kept["best-fit packing"] or 1 not in kept["mixing sources to target weights"]
