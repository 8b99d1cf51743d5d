"""The corpus pipeline: each stage against brute force on a small table with nulls, repeats, ties and clashing columns, and whole runs."""

from __future__ import annotations

from collections import Counter

import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_llm_operators import shingles, words

import __spark_entry__
import corpus_pipeline
from hopscope.llm import langid, mixing, packing, queries

NAMES = [name for name, _ in corpus_pipeline.STAGES]
CLASHES = ["n_removed", "n_lines", "removed", "lang_pred", "score", "row", "cid", "rate", "n_tokens", "first", "member", "id", "h", "turn", "_0", "doc.id"]


@pytest.fixture(scope="module")
def odd(spark):
    """Two hundred documents, some rows twice, one without id, empty and null texts, and columns named like the stages' own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = docs.orderBy("doc_id").limit(12)
    last = docs.schema["n_chars"].dataType
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "  \n "), (9004, "12 34"), (None, "a line of its own\nand one more here")], "doc_id long, text string")
    extra = extra.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.coalesce(F.length("text"), F.lit(0)).cast(last).alias("n_chars"))
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more.select("doc_id", "text", "lang", "source", "n_chars")).unionByName(extra)
    return rows.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)]).repartition(5).cache()


def kept(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect())


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))


def test_language_stage(spark, odd):
    out = corpus_pipeline.identify_language(spark, odd, SF)
    assert out.columns == odd.columns
    told = langid.identify(odd, F.lit(True), ["doc_id", "text"]).collect()
    want = Counter((r["doc_id"], r["text"]) for r in told if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE)
    assert kept(out) == want
    assert not {9001, 9002, 9003, 9004} & {i for i, _ in want}
    lost = odd.where("text RLIKE '[a-z]'").count() - sum(want.values())
    assert lost <= 0.02 * odd.count()


def test_line_stage(spark, odd):
    """Against a walk over all lines in reading order: a line with words that was met goes; blank ones go with such runs only."""
    rows = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    out = corpus_pipeline.dedup_lines(spark, rows, SF)
    assert out.columns == odd.columns
    seen, want = set(), {}
    for r in sorted(rows.collect(), key=lambda r: r["doc_id"]):
        if r["text"] is None:
            want[r["doc_id"]] = (None, r["n_chars"])
            continue
        lines, left = r["text"].split("\n"), []
        gone = False
        for x in lines:
            if words(x):
                if x in seen:
                    gone = True
                else:
                    left.append(x)
                seen.add(x)
            else:
                left.append(x)
        if not gone or words("\n".join(left)):
            want[r["doc_id"]] = ([x for x in left if words(x)], None)
    got = {r["doc_id"]: r for r in out.collect()}
    assert set(got) == set(want)
    for i, (left, _) in want.items():
        assert (got[i]["text"] if left is None else [x for x in got[i]["text"].split("\n") if words(x)]) == left
        assert left is None or got[i]["n_chars"] == len(got[i]["text"])


def test_near_duplicate_stage(spark, odd):
    rows = odd.collect()
    sets = [shingles(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = corpus_pipeline.drop_near_duplicates(spark, odd, SF)
    assert out.columns == odd.columns
    got = kept(out)
    assert sum(got.values()) == sum(1 if sets[g[0]] else len(g) for g in groups.values())
    for g in groups.values():
        least = min((rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0) for i in g)
        here = sum(got[key] for key in {(rows[i]["doc_id"], rows[i]["text"]) for i in g})
        assert here == (1 if sets[g[0]] else len(g))
        if sets[g[0]]:
            assert any(got[rows[i]["doc_id"], rows[i]["text"]] for i in g if (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0) == least)


def test_mixing_stage(spark, odd):
    out = corpus_pipeline.mix_domains(spark, odd, SF)
    assert out.columns == odd.columns
    rates = mixing.mix(odd, queries.domain_labels(spark, SF), queries.SHARES, ["doc_id", "text"])
    rates = rates.select("doc_id", "text", mixing.copies(F.col("rate"), F.col("doc_id")).alias("times"), "rate").collect()
    want = Counter()
    for r in rates:
        want[r["doc_id"], r["text"]] += r["times"]
        assert r["times"] in (int(r["rate"]), int(r["rate"]) + 1)
    assert kept(out) == +want


def test_packing_stage(spark, odd):
    got = corpus_pipeline.pack_documents(spark, odd, SF).collect()
    pieces = packing.cut_pieces(odd, queries.vocabulary(), 1024, 2).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, got)) == Counter(map(key, pieces))
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024


def test_a_whole_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    ids = {r[0] for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            ids_now = {r[0] for r in docs.select("doc_id").collect()}
            assert ids_now <= ids and ids_now
            ids = ids_now
    assert {r[0] for r in docs.select("doc_id").distinct().collect()} == ids


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0


def test_runs_leave_each_other_alone(spark, odd, tmp_path):
    """The result of a run can still be read when another one has begun and gone on."""
    for table in ("documents", "labels"):
        rows = spark.read.parquet(f"{SF}/{table}.parquet")
        (rows.limit(40) if table == "documents" else rows).write.parquet(f"{tmp_path}/{table}.parquet")
    first = corpus_pipeline.run(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    second = corpus_pipeline.identify_language(spark, docs, SF)
    other = corpus_pipeline.dedup_lines(spark, second, SF)
    assert first.count() > 0 and other.count() > 0
