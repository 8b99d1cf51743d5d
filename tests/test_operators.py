"""Pairing, enrichment, models and functions against plain replays, golden values and adversarial rows."""

from __future__ import annotations

import math
import random
from collections import OrderedDict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopscope.functions import http, latency, net, tls
from hopscope.operators import aggregate, enrich, mixture, models, pairing


def flows(seed, n=600):
    rng = random.Random(seed)
    rows, sent = [], {}
    for frame in range(n):
        flow = f"f{rng.randrange(12)}"
        kind = rng.choice(["REQ", "RESP"])
        if kind == "REQ":
            sent[flow] = sent.get(flow, 0) + rng.randrange(1, 50)
        ack = max(0, sent.get(flow, 0) - rng.choice([0, 0, 0, 30]))
        rows.append((flow, frame, frame * 1000 + rng.randrange(900), kind, sent.get(flow, 0), ack, rng.choice(["GET", "POST"]), f"/u{rng.randrange(3)}"))
    return rows


SCHEMA = "flow string, frame long, ts_us long, kind string, seq_end long, ack long, method string, uri string"


@pytest.mark.parametrize("seed", [1, 2])
def test_fifo_pairs_like_a_queue(spark, seed):
    rows = flows(seed)
    queues, want = {}, set()
    for flow, frame, _, kind, end, ack, *_ in rows:
        q = queues.setdefault(flow, deque())
        if kind == "REQ":
            q.append((frame, end))
        elif q and q[0][1] <= ack:
            want.add((flow, q.popleft()[0], frame))
    got = pairing.fifo_pairs(spark.createDataFrame(rows, SCHEMA).repartition(3), ["flow"]).collect()
    assert {(r["flow"], r["req_frame"], r["res_frame"]) for r in got} == want


def test_adjacent_as_of_and_legacy(spark):
    rows = flows(3)
    last, adjacent, as_of, pending, legacy = {}, set(), set(), {}, set()
    latest = {}
    for flow, frame, _, kind, _, _, method, uri in rows:
        p = pending.setdefault(flow, OrderedDict())
        if kind == "REQ":
            latest[flow] = frame
            p[(method, uri)] = frame
        else:
            if last.get(flow, ("", 0))[0] == "REQ":
                adjacent.add((last[flow][1], frame))
            if flow in latest:
                as_of.add((latest[flow], frame))
            if p:
                key = next(iter(p))
                legacy.add((p.pop(key), frame))
        last[flow] = (kind, frame)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    sides = (F.col("kind") == "REQ", F.col("kind") == "RESP")
    pairs = lambda d: {(r["req_frame"], r["res_frame"]) for r in d.collect()}
    assert pairs(pairing.adjacent_pairs(df, ["flow"], ["frame"], *sides)) == adjacent
    assert pairs(pairing.as_of_pairs(df, ["flow"], ["frame"], *sides)) == as_of
    assert pairs(pairing.legacy_pairs(df, ["flow"])) == legacy


def test_longest_prefix(spark):
    rng = random.Random(4)
    table = sorted({(rng.randrange(1 << 32) >> (32 - n) << (32 - n), n) for n in (8, 12, 16, 16, 24, 24, 32) for _ in range(40)} | {(10 << 24, 8), ((10 << 24) | (79 << 16), 16)})
    ips = [rng.randrange(1 << 32) for _ in range(300)] + [net_ for net_, _ in table] + [None]
    want = {ip: max(((n, f"a{b}/{n}") for b, n in table if ip is not None and ip >> (32 - n) << (32 - n) == b), default=(None, None)) for ip in ips}
    prefixes = spark.createDataFrame([(b, n, f"a{b}/{n}") for b, n in table], "net long, plen int, asn string")
    rows = enrich.longest_prefix(spark.createDataFrame([(i,) for i in ips], "ip long"), prefixes, "ip", ["asn"]).collect()
    assert len(rows) == len(ips) and all((r["plen"], r["asn"]) == want[r["ip"]] for r in rows)
    inside = enrich.in_subnets(spark.createDataFrame([(i,) for i in ips], "ip long"), prefixes, "ip")
    assert inside.count() == sum(want[i][0] is not None for i in ips)
    plan = enrich.longest_prefix(spark.createDataFrame([(1,)], "ip long"), prefixes, "ip", ["asn"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan


def test_patterns_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(enrich, "CHUNK", 2)
    rows = spark.createDataFrame([("abc",), ("xbz",), ("none",)], "line string")
    pats = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "bz", "q", "c"])], "pattern_id int, pattern string")
    got = {(r["line"], r["pattern"]) for r in enrich.match_patterns(rows, pats, F.contains("line", "pattern")).collect()}
    assert got == {("abc", "a"), ("abc", "b"), ("abc", "c"), ("xbz", "b"), ("xbz", "bz")}
    rng = random.Random(3)
    lines = ["".join(rng.choice("ab/é") for _ in range(rng.randrange(0, 14))) for _ in range(80)] + [None, "aaaaaaaa"]
    needles = sorted({"".join(rng.choice("ab/é") for _ in range(rng.randrange(1, 7))) for _ in range(40)})
    want = sorted((i, p) for i, x in enumerate(lines) for p in needles if x is not None and p in x)
    found = enrich.match_patterns(spark.createDataFrame(list(enumerate(lines)), "i int, line string"), spark.createDataFrame(list(enumerate(needles)), "pattern_id int, pattern string"), F.contains("line", "pattern"), "line", F.col("pattern"))
    assert sorted((r["i"], r["pattern"]) for r in found.collect()) == want


def test_needles_without_the_automaton(spark, monkeypatch):
    import sys

    lines = [None, "", "abcab", "xéy", "a" * 50]
    want = sorted((i, k) for i, x in enumerate(lines) for k, p in enumerate(["ab", "a", "é", "zz"]) if x and p in x)
    for gone in (False, True):
        if gone:
            monkeypatch.setitem(sys.modules, "ahocorasick", None)
        at, hit = enrich._automaton(["ab", "a", "é", "zz"])(enrich.pa.array(lines))
        assert sorted(zip(at, hit, strict=True)) == want
    got = enrich.holding(spark.createDataFrame(list(enumerate(lines)), "i int, line string").repartition(2), "line", ["ab", "a", "é", "zz"], "k")
    assert sorted(map(tuple, got.select("i", "k").collect())) == want
    assert "Exchange" not in enrich.holding(spark.range(3).selectExpr("id", "string(id) AS line"), "line", ["1"], "k")._jdf.queryExecution().executedPlan().toString()


def test_addresses(spark):
    rows = spark.createDataFrame([("999.1.1.1",), ("01.2.3.4",), ("10.0.0.1",), ("100.64.0.1",), ("224.0.0.1",), ("192.0.0.9",), ("192.0.0.8",), ("x",), (None,), ("8.8.8.8",)], "ip string")
    got = {r["ip"]: (r["n"], r["p"]) for r in rows.select("ip", net.ip_number(F.col("ip")).alias("n"), net.is_public(F.col("ip")).alias("p")).collect()}
    assert got["999.1.1.1"] == (None, False) and got["01.2.3.4"] == (None, False) and got[None] == (None, False)
    assert [got[x][1] for x in ("10.0.0.1", "100.64.0.1", "224.0.0.1", "192.0.0.9", "192.0.0.8", "8.8.8.8")] == [False, True, True, True, False, True]
    ports = spark.createDataFrame([("1.2.3.4", 0), ("1.2.3.4", None), ("1.2.3.4", 80)], "ip string, port int")
    assert [r[0] for r in ports.select(net.socket(F.col("ip"), F.col("port"))).collect()] == [None, None, "1.2.3.4:80"]


def test_urls(spark):
    rows = spark.createDataFrame([("http://a.b/x%2Fy+z",), ("%zz https://q",)], "u string")
    assert [r[0] for r in rows.select(http.decode_url(F.col("u"))).collect()] == ["a.b/x/y+z", "%zz q"]


def test_bin_edges(spark):
    rows = spark.createDataFrame([(0.0,), (0.001,), (0.0019999,), (1.9999999,), (2.0,), (2.0000011,), (None,)], "v double")
    got = {r["bin"]: r["n"] for r in aggregate.histogram(rows, F.col("v"), 1000, 2_000_000, []).collect()}
    assert got == {0: 1, 1: 2, 1999: 2}


def test_isolated_moments_of_the_reports(spark):
    """Printed totals and rests give the printed node values within rounding."""
    one = lambda name, mu, sd: (name, 0, 1.0, mu, sd * sd)
    model = spark.createDataFrame([one("t", 76.90, 262.54), one("r", 61.30, 173.05), one("w", 20.0, 5.0), one("z", 50.0, 9.0)], "model_id string, comp int, weight double, mean double, var double")
    nodes = spark.createDataFrame([("adc", "t", "r"), ("neg", "w", "z"), ("end", "t", None), ("gone", "t", "none")], "node string, total_capture string, rest_capture string")
    got = {r["node"]: r for r in mixture.isolate(model, nodes).collect()}
    assert got["adc"]["mu"] == pytest.approx(15.60, abs=0.02) and got["adc"]["sd"] == pytest.approx(197.43, abs=0.02)
    assert got["neg"]["negative_mean"] and got["neg"]["negative_variance"] and set(got) == {"adc", "neg", "end"}


def test_mixture_fit_and_selection(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0.1, 0.01, 3000), rng.normal(0.4, 0.03, 2000)])
    df = spark.createDataFrame([("c", float(v)) for v in x] + [("single", 0.2)], "capture string, v double")
    got = models.fit_mixtures(df, "capture", "v", [1, 2, 3], grid=1e-3).orderBy("comp").collect()
    assert {r["model_id"] for r in got} == {"c"}
    assert [round(r["mean"], 2) for r in got][:2] == [0.1, 0.4] and got[0]["k"] == 2
    assert got[0]["bic"] == pytest.approx(-2 * got[0]["loglik"] + 5 * math.log(5000))
    best = models.select_bandwidth(df.withColumn("o", F.rand(1)), "v", "o", [0.001, 0.01, 0.5]).first()
    assert best["bandwidth"] == 0.01


def test_draws_follow_their_mixture(spark):
    model = spark.createDataFrame([("m", 0, 0.3, 1.0, 0.04), ("m", 1, 0.7, 2.0, 0.01)], "model_id string, comp int, weight double, mean double, var double")
    x = spark.range(20_000).crossJoin(mixture.packed(model)).select(mixture.draw(F.col("id"), "s", F.col("comps")).alias("x"))
    r = x.agg(F.avg("x"), F.stddev_pop("x")).first()
    assert r[0] == pytest.approx(1.7, abs=0.02) and r[1] == pytest.approx(math.sqrt(0.3 * (0.04 + 1) + 0.7 * (0.01 + 4) - 1.7**2), abs=0.02)
    d = mixture.grid_divergence(model.unionByName(model.withColumn("model_id", F.lit("same"))), "m", "same", 500).first()
    assert d["kl"] == pytest.approx(0, abs=1e-9) and d["js"] == pytest.approx(0, abs=1e-6)


def test_running_counts_and_quantiles(spark):
    """Against numpy, with ties, one hot value, nulls and keys of one row."""
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.choice([0.5, rng.random(), float(rng.randrange(3))])) for _ in range(3000)] + [("one", 7.0), ("a", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    values = {k: sorted(v for q, v in rows if q == k and v is not None) for k in ("a", "b", "one", None)}
    for points in (2, 5, 101):
        got = aggregate.quantiles(df, F.col("v"), ["k"], points).collect()
        assert len(got) == 4 * points
        for r in got:
            assert r["q"] == pytest.approx(np.quantile(values[r["k"]], r["pos"] / (points - 1)), abs=1e-12)
    for r in aggregate.percentiles(df, F.col("v"), ["k"], {"p95": 0.95, "p1": 0.01}).collect():
        assert [r["p95"], r["p1"]] == pytest.approx(list(np.quantile(values[r["k"]], [0.95, 0.01])), abs=1e-12)
    every = sorted(v for q in values.values() for v in q)
    got = {r["k"]: r for r in aggregate.summary(df.where("k IS NOT NULL"), F.col("v"), "k").collect()}
    assert got["a"]["median"] == pytest.approx(np.median(values["a"])) and got["one"]["n"] == 1
    assert got["ALL"]["n"] == len(every) - 2
    ranked = aggregate.running(df.where("v IS NOT NULL").withColumn("i", F.monotonically_increasing_id()), ["k"], "v", ["i"]).collect()
    for k, want in values.items():
        assert [r["v"] for r in sorted((r for r in ranked if r["k"] == k), key=lambda r: r["upto"])] == want
        assert sorted(r["upto"] for r in ranked if r["k"] == k) == list(range(1, len(want) + 1))


def test_chain_without_pools_falls_back(spark):
    requests = spark.range(8).withColumn("conn", F.expr("id DIV 4"))
    pools = spark.createDataFrame([("ips", i, 0.1 * (i + 1)) for i in range(5)] + [("slb", 0, 9.0)], "node string, idx long, v double")
    got = models.chain_delays(requests, pools).collect()
    assert len(got) == 8 * 7
    by = {(r["id"], r["node"]): r["delay"] for r in got}
    assert by[0, "adc"] == 0.002 and by[0, "app"] == 0.005 and by[0, "slb"] == 0
    assert all(by[i, "ips"] == by[i // 4 * 4, "ips"] for i in range(8))  # a draw a connection
    total = {r["id"]: r["upto"] for r in got if r["hop"] == 6}
    assert total[5] == pytest.approx(sum(v for (i, _), v in by.items() if i == 5))


def test_normal_distribution(spark):
    rows = spark.createDataFrame([(x / 4,) for x in range(-12, 13)], "x double")
    got = rows.select("x", latency.normal_cdf(F.col("x"), F.lit(0.0), F.lit(1.0)).alias("p")).collect()
    assert all(r["p"] == pytest.approx(0.5 * (1 + math.erf(r["x"] / math.sqrt(2))), abs=2e-7) for r in got)


def test_ciphers_are_distinct():
    codes = [c for c, _, _ in tls.CIPHERS]
    assert len(codes) == len(set(codes)) == 27


@pytest.mark.parametrize("inside, plain", [(1 << 18, 1 << 20), (12, 1 << 20), (12, 20)])
def test_ranks_by_narrowing(spark, monkeypatch, inside, plain):
    """Keys of any size, with hot values and nulls, whatever a task may hold."""
    monkeypatch.setattr(aggregate, "INSIDE", inside)
    monkeypatch.setattr(aggregate, "PLAIN", plain)
    monkeypatch.setattr(aggregate, "ACCURACY", 40)
    monkeypatch.setattr(aggregate, "BUCKETS", 5)
    rng = random.Random(11)
    rows = [(rng.choice("aaaab"), rng.choice([0.25, rng.random(), rng.random() ** 9])) for _ in range(4000)] + [("hot", 3.0)] * 900 + [("two", 1.0), ("two", 2.0), ("one", 7.0), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    at = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: r for r in aggregate.percentiles(df, F.col("v"), ["k"], at).collect()}
    for k in ("a", "b", "hot", "two", "one"):
        want = np.quantile([v for q, v in rows if q == k and v is not None], list(at.values()))
        assert [got[k][n] for n in at] == pytest.approx(list(want), abs=1e-12), k
    whole = aggregate.percentiles(df, F.col("v"), [], {"m": 0.5}).first()["m"]
    assert whole == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.5), abs=1e-12)
    ranked = aggregate.running(df.where("v IS NOT NULL").withColumn("i", F.monotonically_increasing_id()), ["k"], "v", ["i"]).where("k = 'a'").orderBy("upto").collect()
    assert [r["v"] for r in ranked] == sorted(v for q, v in rows if q == "a" and v is not None) and [r["upto"] for r in ranked] == list(range(1, len(ranked) + 1))
    assert aggregate.percentiles(df.where("false"), F.col("v"), ["k"], at).count() == 0


def test_sql_functions_are_the_columns(spark):
    from hopscope.functions import sql

    assert set(sql.register(spark)) == set(sql.FUNCTIONS)
    ips = ["999.1.1.1", "01.2.3.4", "10.0.0.1", "100.64.0.1", "192.0.0.9", "192.0.0.8", "8.8.8.8", "1.2.3", "x", "", None, "255.255.255.255", "1.2.3.4.5"]
    texts = ["/a/b/c/d?x=1", "/x//y/FareEnq", "/a/b", "", None, "deadbeef99 12345", "/api/mapps1/82902/MMCT/f3109944", "http://A.b:80/Q", "no scheme"]
    rows = spark.createDataFrame([(a, b) for a in ips for b in texts], "ip string, t string")
    n = net.ip_number(F.col("ip"))
    by_column = rows.select("ip", "t", n.alias("a"), net.ip_number(F.col("ip"), False).alias("b"), net.is_public(F.col("ip")).alias("c"), http.api_of(F.col("t")).alias("d"), http.mask_ids(F.col("t")).alias("e"), F.array_join(F.filter(F.split("t", "/"), http.is_static_segment), "/").alias("f"))
    rows.createOrReplaceTempView("some_rows")
    by_sql = spark.sql("SELECT ip, t, ip_number(ip) AS a, ip_number_loose(ip) AS b, is_public_number(ip_number(ip)) AS c, api_of(t) AS d, mask_ids(t) AS e, static_segments(t) AS f FROM some_rows")
    assert sorted(map(repr, by_sql.collect())) == sorted(map(repr, by_column.collect()))
    plan = by_sql._jdf.queryExecution().optimizedPlan().toString()
    assert "ip_number" not in plan and "api_of" not in plan  # bodies in place of calls
    assert spark.sql("SELECT network_of(ip_number('10.79.3.4'), 16) AS a, protocol_of(443) AS b, protocol_of(1) AS c").first() == (172949504, "https", None)


def test_pools_of_nodes(spark):
    from hopscope.operators import chain

    fitted = spark.createDataFrame([("t", 0, 1.0, 0.5, 1e-4), ("r", 0, 0.6, 0.2, 1e-4), ("r", 1, 0.4, 0.1, 1e-4), ("z", 0, 1.0, 0.6, 1e-6)], "model_id string, comp int, weight double, mean double, var double")
    nodes = spark.createDataFrame([("mid", "t", "r"), ("end", "t", None), ("gone", "t", "none"), ("none", "x", None), ("neg", "t", "z")], "node string, total_capture string, rest_capture string")
    got = chain.node_pools(fitted, nodes, 400).collect()
    by = {n: [r["delay_s"] for r in sorted(got, key=lambda r: r["i"]) if r["node"] == n] for n in ("mid", "end", "gone", "none", "neg")}
    assert len(by["mid"]) == len(by["end"]) == 400 and not by["gone"] and not by["none"] and not by["neg"]
    assert np.mean(by["mid"]) == pytest.approx(0.5 - 0.16, abs=0.01) and np.mean(by["end"]) == pytest.approx(0.5, abs=0.005)
    again = chain.node_pools(fitted.repartition(3), nodes.repartition(2), 400).where("node = 'mid'").orderBy("i").collect()
    assert [r["delay_s"] for r in again] == by["mid"]


def test_em_over_tasks_is_em_of_the_whole(spark):
    """Against rounds by hand on all values at once, for several keys and numbers of components."""
    rng = np.random.default_rng(5)
    data = {"a": rng.gamma(2, 0.05, 700), "b": rng.normal(0.3, 0.02, 300), None: np.array([0.1, 0.2, 0.4])}
    rows = [(k, float(round(x, 3))) for k, v in data.items() for x in v] + [("one", 0.5)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = models.fit_mixtures(df, "k", "v", [2, 3], None, False, 4, -1.0).collect()
    assert {r["model_id"] for r in got} == {"a", "b", None}
    for name in data:
        x = np.array([v for k, v in rows if k == name])
        for k in (2, 3):
            step = (x.max() - x.min()) / k
            w, m, s = np.full(k, 1 / k), x.min() + (np.arange(k) + 0.5) * step, np.full(k, max(step * step / 4, 1e-6))
            for _ in range(4):
                p = w * np.exp(-0.5 * (x[:, None] - m) ** 2 / s) / np.sqrt(2 * np.pi * s)
                r = p / p.sum(1, keepdims=True)
                w, m = r.mean(0), (r * x[:, None]).sum(0) / r.sum(0)
                s = np.maximum((r * (x[:, None] - m) ** 2).sum(0) / r.sum(0), 1e-6)
            own = sorted((r["comp"], r["weight"], r["mean"], r["var"]) for r in got if r["model_id"] == name and r["k"] == k)
            order = np.argsort(m)
            assert np.allclose([o[1:] for o in own], np.stack([w, m, s], 1)[order], rtol=1e-6, atol=1e-9)
            p = w * np.exp(-0.5 * (x[:, None] - m) ** 2 / s) / np.sqrt(2 * np.pi * s)
            assert next(r["loglik"] for r in got if r["model_id"] == name and r["k"] == k) == pytest.approx(np.log(p.sum(1)).sum(), rel=1e-9)
