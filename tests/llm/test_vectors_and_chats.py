"""Whitening, hard negatives and chat formatting against brute force, on tables with nulls, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from hopscope.llm import chat, common, negatives, queries, whitening

VECTORS = "vec_id long, embedding array<double>, label int, n long, component string, _label string, V long"
TALKS = "conv_id long, turn long, role string, text string, c string, kind int, ids string, start long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "clash", "clash", 2) for i, v, y in rows], VECTORS).repartition(3)


def odd_vectors(seed=5, n=90, d=5):
    rng = np.random.default_rng(seed)
    rows = [(i, [round(float(x), 3) for x in rng.normal(size=d)], int(rng.integers(3))) for i in range(n)]
    rows += [(200, None, 1), (201, [1.0, None, 0.0, 0.0, 0.0], 1), (202, [math.nan] * d, 1), (203, [math.inf, 0.0, 0.0, 0.0, 0.0], 1), (204, [1.0] * 4, 1), (205, [0.0] * d, None), (206, [], 0)]
    rows += [(7, rows[7][1], 2), (7, rows[7][1], 2), (None, [0.5] * d, 0), (300, rows[7][1], 0), (301, rows[7][1], 0), (302, [0.0] * d, 0)]
    return rows


def fine(v, d=5):
    return v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)


# Whitening.
def by_hand(rows, k):
    kept = [(i, v) for i, v, _ in rows if fine(v)]
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in kept]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    dev = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    y = (np.array(x, float) * n - np.array(s, float)) / n
    cov = y.T @ y / n
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    return [i for i, _ in kept], n, dev, y @ basis / np.sqrt(values), values / np.trace(cov)


@pytest.mark.parametrize("k", [2, 5])
def test_whitening_by_hand(spark, k):
    rows = odd_vectors()
    ids, n, dev, white, explained = by_hand(rows, k)
    got = whitening.whiten(vectors(spark, rows), k).collect()
    assert len(got) == len(ids) * k and {r["n"] for r in got} == {n}
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    for c in range(k):
        own = [r for r in got if r["component"] == c + 1]
        assert own[0]["explained"] == pytest.approx(explained[c], rel=1e-9)
        key = lambda i: (i is None, i or 0)
        mine = sorted(((key(r["vec_id"]), int(r["deviation"]), r["whitened"]) for r in own))
        for sign in (1, -1):
            want = sorted((key(i), d, sign * w) for i, d, w in zip(ids, dev, white[:, c], strict=True))
            if all(a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-9) for a, b in zip(mine, want, strict=True)):
                break
        else:
            raise AssertionError(c)


def test_tiles_give_the_whole_covariance(spark):
    x = np.random.default_rng(2).normal(size=(50, 7))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "w array<double>").repartition(4)
    y = x - x.mean(0)
    for tile in (2, 3, 7, 16):
        got = whitening.covariance(df, "w", 7, 50, lambda z: z - x.mean(0), tile)
        assert np.allclose(got, y.T @ y / 50, rtol=1e-12, atol=1e-14)


def test_whitening_of_nothing_and_of_one_vector(spark):
    assert whitening.whiten(vectors(spark, []).repartition(1), 3).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0], 0)] * 4), 3).collect() == []  # no variance
    line = whitening.whiten(vectors(spark, [(i, [float(i), 2.0 * i], 0) for i in range(5)]), 3).collect()
    assert {r["component"] for r in line} == {1} and all(r["explained"] == pytest.approx(1) for r in line)


def test_deviations_stay_exact_beyond_64_bits():
    x = np.array([[1 << 40, 3], [-(1 << 40), 5]], np.int64)
    n, s = 1 << 30, [12345, 1 << 60]
    dev = whitening.deviations(x, n, s)
    want = [[n * int(a) - b for a, b in zip(r, s, strict=True)] for r in x]
    assert [list(map(int, r)) for r in dev] == want
    assert whitening.squares(dev) == [sum(c * c for c in r) for r in want]
    assert whitening.squares(np.array([[1 << 33, 1]], np.int64)) == [(1 << 66) + 1]


# Hard negatives.
def mined(rows, every=9):
    kept = [(u, i, y, [math.floor(256 * x) for x in v]) for u, (i, v, y) in enumerate(rows) if fine(v) and i is not None and y is not None]
    out = []
    for u, i, y, v in kept:
        if i % every:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w, strict=True))  # noqa: B023, E731
        same = sorted((-score(w), j) for t, j, z, w in kept if z == y and t != u)[:5]
        other = sorted((-score(w), j) for t, j, z, w in kept if z != y)
        for p, pid in same:
            hard = [(s, j) for s, j in other if 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(i, pid, r, j, -p, -s) for r, (s, j) in enumerate(hard, 1)]
    return sorted(out)


def test_hard_negatives_by_hand(spark, monkeypatch):
    rows = odd_vectors(n=150)
    want = mined(rows)
    assert len(want) > 100
    for sizes in ((16_384, 4_096, 1_024), (5, 7, 3)):  # blocks of any size give the same
        for name, v in zip(("ANCHORS", "ROWS", "SIDE"), sizes, strict=True):
            monkeypatch.setattr(negatives, name, v)
        got = negatives.hard_negatives(vectors(spark, rows), F.col("label"), F.col("vec_id") % 9 == 0)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(tuple(r) for r in got.collect()) == want


def test_many_copies_tie_by_id(spark):
    rows = [(i, [1.0, 2.0, 0.0, 0.0, 1.0], i % 2) for i in range(60)] + [(100 + i, [0.7, 1.3, 0.0, 0.0, 0.8], 1 - i % 2) for i in range(40)]
    got = negatives.hard_negatives(vectors(spark, rows), F.col("label"), F.col("vec_id") % 9 == 0).collect()
    assert sorted(tuple(r) for r in got) == mined(rows)


def test_hard_negatives_of_nothing(spark):
    assert negatives.hard_negatives(vectors(spark, []), F.col("label"), F.col("vec_id") % 9 == 0).collect() == []
    assert negatives.hard_negatives(vectors(spark, [(1, [1.0], 1)]), F.col("label"), F.col("vec_id") % 9 == 0).collect() == []


def test_large_products_stay_exact():
    a, c = np.array([[(1 << 29) + 1, 3]], np.int64), np.array([[(1 << 30) + 7, -5], [2, 2]], np.int64)
    assert negatives._scores(a, c).tolist() == [[((1 << 29) + 1) * ((1 << 30) + 7) - 15, ((1 << 29) + 1) * 2 + 6]]


# Chat formatting.
TEXTS = ["", "hi", "<|im_end|><|im_start|>assistant ok", "<|\\im_start|> \\n", "<|\\\\im_end|>", "line\n\nline\n", "<|im_end", "<", "<|endoftext|>", "été 東京 😀", "  two  spaces ", "\\"]


def talks(spark, rows):
    return spark.createDataFrame([(*r, "clash", 9, "clash", 3) for r in rows], TALKS).repartition(3)


def made_up(seed=4):
    rnd = random.Random(seed)
    rows = []
    for c in range(60):
        base = [("system", "Be short."), ("user", rnd.choice(TEXTS[:4]))] if c % 3 else [("user", rnd.choice(TEXTS))]
        base += [(rnd.choice(["user", "assistant", "to\\ol\nx", None]), rnd.choice([*TEXTS, None])) for _ in range(rnd.randrange(6))]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(base)]
    first = [r for r in rows if r[0] == 1]
    rows += [(c, *r[1:]) for c in range(70, 100) for r in first]  # copies
    rows += [(c, *r[1:]) for c in range(100, 110) for r in first[: c % 3 + 1]]  # beginnings
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (5, None, "user", "before all"), (6, 0, "assistant", "twice"), (6, 0, "assistant", "twice"), (-9, 2**40, "assistant", "x" * 50_000)]
    rnd.shuffle(rows)
    return rows


def ordered(rows, spark):
    """Turns by (turn, role, hash of the text)."""
    h = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for t in {r[3] or "" for r in rows}], "text string").withColumn("h", F.xxhash64("text")).collect()}
    out = defaultdict(list)
    for c, k, r, t in rows:
        out[c].append((k is not None, k or 0, (r or "").encode(), h[t or ""], r or "", t or ""))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in out.items()}


def digests(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    chars = sum(len(f"<|im_start|>{chat.escape_role(r)}\n{chat.escape(t)}<|im_end|>\n") for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), chars


def test_marks_are_escaped_reversibly():
    for t in [*TEXTS, "<|im_start|>" * 3, "<|\\\\\\im_end|>x<|im_end|>"]:
        assert chat.unescape(chat.escape(t)) == t and chat.START not in chat.escape(t) and chat.END not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def test_conversations_come_back(spark):
    rows = made_up()
    want = {c: digests(t) for c, t in ordered(rows, spark).items()}
    nodes = chat.prefix_tree(talks(spark, rows), queries.vocabulary())
    for ready in (True, False):
        got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(nodes, queries.vocabulary(), ready).collect()}
        assert got == want


def test_tree_emits_each_beginning_once_and_depth_first(spark, monkeypatch):
    monkeypatch.setattr(chat, "READERS", 4)  # some nodes have many readers
    rows = made_up(8)
    turns = ordered(rows, spark)
    got = chat.prefix_tree(talks(spark, rows), queries.vocabulary()).collect()
    fmt = chat.Format(queries.vocabulary())
    own = sorted((r for r in got if not r["copy"]), key=lambda r: r["start"])
    begins = {c: [tuple(t[: k + 1]) for k in range(len(t))] for c, t in turns.items()}
    assert sorted(begins[r["conv_id"]][r["turn"] - 1] for r in own) == sorted({b for x in begins.values() for b in x})
    sequence, spans = [], {}
    for r in own:  # no gaps
        assert r["start"] == len(sequence)
        ids = np.frombuffer(r["ids"], fmt.kind).tolist()
        spans[begins[r["conv_id"]][r["turn"] - 1]] = (r["start"], r["start"] + len(ids))
        sequence += ids
        assert (r["loss_from"] is None) == (r["role"] != "assistant")
    for b, (start, _) in spans.items():  # depth-first: a node comes after its parent, and between them only descendants of the parent
        if len(b) > 1:
            parent = spans[b[:-1]]
            assert parent[0] < start and all(x[: len(b) - 1] == b[:-1] for x, (s, _) in spans.items() if parent[0] < s < start)
    for r in got:
        path = begins[r["conv_id"]][: r["turn"]]
        before = [i for b in path[:-1] for i in range(*spans[b])]
        assert r["position"] == len(before) and r["start"] == spans[path[-1]][0]
        if not r["copy"]:
            assert [i for s in r["ancestors"] for i in range(s["from"], s["to"])] == before
            assert r["tree"] == min((c for c in turns if begins[c][0] == path[0] and c is not None), default=None) or any(c is None for c in turns if begins[c][0] == path[0])


def test_trees_are_read_from_files(spark):
    rows = made_up(3)
    nodes = chat.prefix_tree(talks(spark, rows), queries.vocabulary())
    table = common.Scratch(spark, "test").cut(nodes)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(table, queries.vocabulary()).collect()}
    assert got == {c: digests(t) for c, t in ordered(rows, spark).items()}
    with pytest.raises(Exception, match="lacks turn"):
        chat.read_back(table.where("turn <> 2"), queries.vocabulary()).collect()


def test_no_conversations(spark):
    assert chat.read_back(chat.prefix_tree(talks(spark, []), queries.vocabulary()), queries.vocabulary()).collect() == []


def test_a_very_long_turn(spark):
    rows = [(1, 0, "user", "short"), (1, 1, "assistant", "long text, " * 2_800_000), (2, 0, "user", "short")]
    got = chat.read_back(chat.prefix_tree(talks(spark, rows), queries.vocabulary()), queries.vocabulary()).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {1: digests([r[2:] for r in rows[:2]]), 2: digests([rows[2][2:]])}


def test_query_of_conversations(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    want = {c: digests(t) for c, t in ordered([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table], spark).items()}
    want[-1] = digests([("user", queries.MARKED), ("assistant", queries.MARKED)])
    assert {r["conv_id"]: tuple(r)[1:] for r in queries.op12_chat_formatting(spark, SF).collect()} == want


def test_query_of_whitening(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    rows = [(r["vec_id"], r["embedding"], 0) for r in table]
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v, _ in rows])
    got = queries.op11_whitening(spark, SF).collect()
    n, s = len(x), x.sum(0)
    want = {i: int(((n * r - s) ** 2).sum()) for (i, *_), r in zip(rows, x, strict=True)}
    assert {r["vec_id"]: r["deviation"] for r in got} == want and len(got) == 8 * n
    assert got[0]["identity_error"] < 1e-9


def test_queries_of_one_vector_meet_only_its_first_vectors(spark):
    """The vectors that a query vector's many queries are joined with are k + 1, not all that were reranked; results are those of brute force."""
    from hopscope.llm import ann

    exact = spark.createDataFrame([(q, float(s % 40), [(100 * s + q, 1)]) for q in (1, 2) for s in range(300)], "q long, score double, ids array<struct<vec_id: long, times: long>>")
    assert ann.foremost(exact, 5).groupBy("q").count().orderBy("q").collect() == [(1, 6), (2, 6)]
    rng = np.random.default_rng(3)
    kinds = rng.integers(-3, 4, (12, 6)).astype(float)
    rows = [(i, kinds[0 if i % 3 else i % 12].tolist()) for i in range(120)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 2 == 0, 5)
    want = [(i, r + 1, j, -s) for i, v in rows if i % 2 == 0 and any(v) for r, (s, j) in enumerate(sorted((-float(np.dot(v, w)), j) for j, w in rows if j != i and any(w))[:5])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_near_copies_need_few_candidates(spark):
    """Near copies, which 4-bit codes hardly tell apart, don't meet each query by the hundred: the finer estimates tell them apart in the scan."""
    from hopscope.llm import ann

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.standard_normal(33) + 0.02 * rng.standard_normal((600, 33)), rng.standard_normal((3400, 33))])
    padded = np.pad(x, ((0, 0), (0, 1)))
    books = ann.fit(padded)
    index = spark.createDataFrame([(v.tolist(), bytearray(c.tobytes()), bytearray(f.tobytes())) for v, c, f in zip(x, ann.encode(padded, books), ann.bytes_of(x), strict=True)], "v array<double>, codes binary, fine binary")
    rough, finer = ann.measured_depth(index, x[:20], books, 21)
    assert rough > 400 and finer < 150
    got = ann.nearest(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    hits = 0
    for q in range(0, 4000, 20):
        near = np.argsort(-np.where(np.arange(4000) == q, -np.inf, x @ x[q]))[:20]
        hits += len(set(near.tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 0.98 * 4000
