"""Soft-membership mixing in DataFrame functions: document rates whose expected domain totals meet targets.

A classifier learned from a labelled table gives each document's domain posteriors: words are hashed into
``BUCKETS``; a bucket's presence gets a weight for each domain, its log-odds against the other domains,
where they are significant (the ``FEATURES`` most significant, a size of the model); the summed weights are calibrated by
multinomial logistic regression on the other half of a bounded sample of labelled documents (``SAMPLE_DOCS``).

Posteriors are rounded to ``GRAIN``-ths, so documents fall into cells of equal posteriors; for a few domains
there are few cells, however many documents. With t tokens (words) and posteriors p, nonnegative rates w
minimise the squared distance of the expected totals sum w t p from the targets. Projected gradient starts at
w = 1: a step takes a multiple of p' r off each rate, r being the totals' residual, and projects to w >= 0;
momentum speeds it up and starts anew where the distance grows. A rate follows from its cell's posteriors and
the steps so far, so an iteration is one distributed sum over the cells, whose state is written every ``ROUND``
steps; documents meet their cell's rate by a join at the end. Where the descent ends, the rates are moved as little as the
targets need: w + p' l, projected to w >= 0, for one l that Newton's method finds from distributed sums (the
domains' totals and their derivatives). A little weight on the move, lowered until the residual is within ``TOLERANCE`` of
the targets' sum, keeps rates from being driven far for the last tokens; where targets can't be met, it ends at the least squares' own residual.

Null text counts as empty: no tokens, the prior as posteriors. Labels that are null or of unknown
documents are ignored; of repeated labels the least domain counts. Without labelled documents there is
one domain, 'all'. Repeated rows and null ids each get their rate; an empty table gives no rows. A kept
column that has the name of an output gets an underscore at its end.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, hashed_sample, kept_names, small

BUCKETS, SLOTS, SPLIT, FEATURES, SAMPLE_DOCS, LEAST_Z, LEAST_DOCS = 1 << 20, 1 << 14, 10, 2_000, 8_192, 3.0, 5
#: Steps of the descent at most, and those between writes; the residual, as a share of the targets' sum, at which they end, and the gain below which they do.
ITERATIONS, ROUND, TOLERANCE, GAIN, GRAIN = 48, 8, 5e-4, 1e-3, 256
#: Weights on the move from the descent's rates, as shares of the totals' derivatives, and Newton steps for each.
WEIGHTS, NEWTON = [10.0**-e for e in range(2, 11)], 25


def _words(text: str) -> Column:
    """Lower-cased words, cut at white space and at the marks that end clauses and sentences."""
    return F.expr(rf"array_remove(split(lower(coalesce(`{text}`, '')), '[\\x20\\x09-\\x0D.,;:?]+'), '')")


def _number(x: float) -> str:
    return f"{float(x)!r}D"


def _slots(buckets: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A perfect hash: places (from 1) of buckets by slot, and how far each group of buckets with equal low bits is shifted."""
    groups: dict[int, list[int]] = {}
    for i, h in enumerate(buckets):
        groups.setdefault(h & ((1 << SPLIT) - 1), []).append(i)
    place, shift = np.zeros(SLOTS, int), np.zeros(1 << SPLIT, int)
    for g, members in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0])):
        at = np.array([buckets[i] >> SPLIT for i in members])
        shift[g] = next(d for d in range(SLOTS) if not place[(at + d) % SLOTS].any())
        place[(at + shift[g]) % SLOTS] = np.array(members) + 1
    return place, shift


def _folded(numbers: list, kind: str) -> str:
    """An array of numbers as one string, which Spark folds; thousands of literals would each be parsed and copied by every rule on the driver."""
    return f"CAST(split('{','.join(map(repr, numbers))}', ',') AS array<{kind}>)"


class Domains:
    """names; buckets that have weights; weights (domains, buckets); calibration (domains, domains + 1)."""

    def __init__(self, names: list[str], buckets: list[int], weights: np.ndarray, calibration: np.ndarray):
        self.names, self.buckets, self.weights, self.calibration = names, buckets, weights, calibration

    def sums(self, words: str) -> Column:
        """Array of the summed weights of the word buckets that are present in array column ``words``."""
        if not self.buckets:
            return F.expr("array(" + ", ".join("0D" for _ in self.names) + ")")
        place, shift = _slots(self.buckets)
        at = f"{_folded(place.tolist(), 'int')}[(shiftright(h, {SPLIT}) + {_folded(shift.tolist(), 'int')}[h & {(1 << SPLIT) - 1}]) & {SLOTS - 1}]"
        keys = _folded([-1, *self.buckets], "int")
        present = f"array_distinct(filter(transform({words}, w -> CAST(pmod(xxhash64(w), {BUCKETS}) AS int)), h -> {keys}[{at}] = h))"
        table = [_folded([0.0, *row.tolist()], "double") for row in self.weights]
        return F.expr(f"transform(array({', '.join(map(str, range(len(self.names))))}), k -> aggregate({present}, 0D, (s, h) -> s + array({', '.join(table)})[k][{at}]))")

    def posteriors(self, sums: str) -> Column:
        """Array of the domains' probabilities from array column ``sums``."""
        k = len(self.names)
        logits = [" + ".join([_number(self.calibration[i, k])] + [f"{_number(self.calibration[i, j])} * greatest(-30D, least(30D, {sums}[{j}]))" for j in range(k)]) for i in range(k)]
        e = f"array({', '.join(f'({x})' for x in logits)})"
        scaled = f"transform({e}, x -> exp(x - array_max({e})))"
        return F.expr(f"transform({scaled}, x -> x / aggregate({scaled}, 0D, (s, y) -> s + y))")


def _calibrate(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Multinomial logistic regression of class y on sums x."""
    x = np.concatenate([np.clip(x, -30, 30), np.ones((len(x), 1))], 1)
    w, hot = np.zeros((k, k + 1)), np.eye(k)[y]
    scale = np.maximum(np.abs(x).max(0), 1)
    z = x / scale
    velocity = np.zeros_like(w)
    for _ in range(600):
        p = z @ w.T
        p = np.exp(p - p.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (hot - p).T @ z / len(z) - 1e-4 * w
        velocity = 0.9 * velocity + g
        w += 2.0 * velocity
    return w / scale


def learn_domains(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Domains:
    """Learn from ``labels`` (id, domain): a bounded sample of ids by hash, broadcast to the documents."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("domain").cast("string").alias("domain")).where("id IS NOT NULL AND domain IS NOT NULL").groupBy("id").agg(F.min("domain").alias("domain"))
    chosen = hashed_sample(known, "id", SAMPLE_DOCS, ["id"]).collect()
    none = Domains(["all"], [], np.zeros((1, 0)), np.zeros((1, 2)))
    if not chosen:
        return none
    few = F.broadcast(spark.createDataFrame(chosen, "id long, domain string"))  # at most SAMPLE_DOCS rows
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _words(text_col).alias("words")).join(few, "id")
    rows = rows.select("id", "domain", (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(2)) == 0).alias("first"), "words")
    buckets = F.expr(f"array_distinct(transform(words, w -> CAST(pmod(xxhash64(w), {BUCKETS}) AS int)))")
    half = rows.where("first")
    sizes = {r["domain"]: r["count"] for r in half.groupBy("domain").count().collect()}
    names = sorted(sizes)
    if len(names) < 2:
        return Domains(names, [], np.zeros((1, 0)), np.zeros((1, 2))) if names else none
    seen = half.select("domain", F.explode(buckets).alias("b")).groupBy("b", "domain").count().groupBy("b").agg(F.map_from_entries(F.collect_list(F.struct("domain", "count"))).alias("m"), F.sum("count").alias("n"))
    seen = sorted(tuple(r) for r in seen.where(F.col("n") >= LEAST_DOCS).select("b", "m").collect())  # at most BUCKETS, of a bounded sample
    counts = np.array([[m.get(d, 0) for _, m in seen] for d in names], float).reshape(len(names), len(seen))
    n = np.array([sizes[d] for d in names], float)
    rest, n_rest = counts.sum(0) - counts, n.sum() - n
    odds = np.log((counts + 0.5) / (n[:, None] + 1)) - np.log((rest + 0.5) / (n_rest[:, None] + 1))
    z = odds / np.sqrt(1 / (counts + 0.5) + 1 / (rest + 0.5))
    order = np.argsort(-np.abs(z).max(0), kind="stable") if len(seen) else []
    used = [int(i) for i in order if np.abs(z[:, i]).max() >= LEAST_Z][:FEATURES]
    weights = np.where(np.abs(z[:, used]) >= LEAST_Z, np.round(odds[:, used], 6), 0.0)
    out = Domains(names, [seen[i][0] for i in used], weights, np.zeros((len(names), len(names) + 1)))
    other = rows.where("NOT first").where(F.col("domain").isin(names)).select("domain", out.sums("words").alias("s")).collect()  # at most SAMPLE_DOCS
    if other:
        out.calibration = _calibrate(np.array([r["s"] for r in other]), np.array([names.index(r["domain"]) for r in other]), len(names))
    return out


def memberships(docs: DataFrame, domains: Domains, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with tokens and array ``member``, under names _0, _1, ... for those kept."""
    rows = docs.select(*[col(c).alias(f"_{i}") for i, c in enumerate(keep)], _words(text_col).alias("words"))
    rows = rows.withColumn("tokens", F.size("words").cast("long")).withColumn("sums", domains.sums("words")).drop("words")
    fine = F.transform(domains.posteriors("sums"), lambda p: F.floor(p * GRAIN + 0.5))
    rest = F.lit(GRAIN) - F.aggregate("fine", F.lit(0).cast("long"), lambda s, x: s + x)
    # what rounding leaves over goes to the first of the largest, so that shares sum to 1
    even = F.transform("fine", lambda x, i: (x + F.when(i == F.array_position("fine", F.array_max("fine")) - 1, rest).otherwise(0)) / F.lit(float(GRAIN)))
    return rows.withColumn("fine", fine).withColumn("member", even).drop("sums", "fine")


def _moved(steps: list[tuple[np.ndarray, float]]) -> str:
    """Struct (w, y) of a cell's rate and of where its next gradient is taken, after projected steps; a step: what is taken off, momentum."""
    begin = "named_struct('w', w, 'y', y)"
    if not steps:
        return begin
    moves = ", ".join(f"named_struct('c', array({', '.join(_number(x) for x in c)}), 'b', {_number(b)})" for c, b in steps)
    new = f"greatest(0D, a.y - ({' + '.join(f's.c[{j}] * member[{j}]' for j in range(len(steps[0][0])))}))"
    return f"IF(free, aggregate(array({moves}), {begin}, (a, s) -> named_struct('w', {new}, 'y', {new} + s.b * ({new} - a.w))), {begin})"


def fit_rates(table: DataFrame, k: int, targets: list[float] | None, shares: list[float] | None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """The rate of each cell (member, rate), the targets, and the expected totals.

    ``table``: tokens, member. ``targets``: token totals of the domains, or ``shares``: multiples of their expected totals at rate 1.
    """
    scratch = Scratch(table.sparkSession, "cells")
    one = F.lit(1.0)

    def totals(cells: DataFrame, steps: list) -> tuple[np.ndarray, np.ndarray]:
        """Expected totals at the rates, and where the next gradient is taken."""
        rows = cells.select("tokens", "member", F.expr(_moved(steps)).alias("s"))
        got = rows.agg(*[F.sum(F.expr(f"tokens * member[{i}] * s.{x}")) for x in ("w", "y") for i in range(k)]).first()
        return np.array([float(x or 0) for x in got[:k]]), np.array([float(x or 0) for x in got[k:]])

    def descend(cells: DataFrame, want: np.ndarray | None) -> tuple[DataFrame, np.ndarray, np.ndarray]:
        """``cells`` (member, tokens, w, y, free) after the steps, the targets, the totals."""
        m = cells.where("free").agg(*[F.sum(F.expr(f"tokens * member[{i}] * member[{j}]")) for i in range(k) for j in range(k)]).first()
        size = 1 / max(float(np.linalg.eigvalsh(np.array([float(x or 0) for x in m]).reshape(k, k)).max()), 1e-30)
        now, ahead = totals(cells, [])
        if want is None:
            want = np.array(targets if targets is not None else [s * t for s, t in zip(shares, now, strict=True)], float)
        steps: list[tuple[np.ndarray, float]] = []
        speed, best, since = 1.0, float((now - want) @ (now - want)), 0
        last = best
        for _ in range(ITERATIONS):
            if np.abs(now - want).max() <= TOLERANCE * max(np.abs(want).sum(), 1) or since >= 5:
                break
            if len(steps) == ROUND:
                cells, steps = scratch.cut(cells.select("member", "tokens", "free", F.expr(_moved(steps)).alias("s")).select("member", "tokens", "free", "s.w", "s.y")), []
            faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
            steps.append((size * (ahead - want), (speed - 1) / faster))
            speed = faster
            now, ahead = totals(cells, steps)
            far = float((now - want) @ (now - want))
            since = 0 if far < best * (1 - GAIN) else since + 1
            best = min(best, far)
            if far > last:  # momentum carries away from the targets: without it the next gradient is taken at the rates
                steps[-1] = (steps[-1][0], 0.0)
                speed, ahead = 1.0, now
            last = far
        return cells.select("member", "tokens", F.expr(_moved(steps)).alias("s")).select("member", "tokens", "s.w"), want, now

    def finish(cells: DataFrame, want: np.ndarray) -> tuple[DataFrame, np.ndarray]:
        """The rates nearest to the descent's that meet the targets, and the totals."""

        def rate(at: np.ndarray) -> str:
            """Numbers that change from step to step are folded into an array, which isn't compiled, so steps share their code."""
            return f"greatest(0D, w + aggregate(zip_with(member, array({', '.join(map(_number, at))}), (p, l) -> p * l), 0D, (s, x) -> s + x))"

        def measured(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
            """Totals at the moved rates, their derivatives, and half the tokens' sum of squared rates, whose derivatives the totals are."""
            moved = cells.select("tokens", "member", F.expr(rate(at)).alias("r"))
            upper = [(i, j) for i in range(k) for j in range(i, k)]
            sums = moved.agg(*[F.sum(F.expr(f"tokens * member[{i}] * r")) for i in range(k)], *[F.sum(F.expr(f"IF(r > 0D, tokens * member[{i}] * member[{j}], 0D)")) for i, j in upper], F.sum(F.expr("0.5D * tokens * r * r"))).first()
            slope = np.zeros((k, k))
            for (i, j), v in zip(upper, sums[k:-1], strict=True):
                slope[i, j] = slope[j, i] = float(v or 0)
            return np.array([float(x or 0) for x in sums[:k]]), slope, float(sums[-1] or 0)

        most = TOLERANCE * max(float(np.abs(want).sum()), 1.0)
        at = np.zeros(k)
        now, slope, height = measured(at)
        if np.abs(now - want).max() <= most:
            return cells.select("member", "w"), now
        scale = max(float(np.trace(slope)), 1e-30)
        for weight in WEIGHTS:
            mu = weight * scale
            for _ in range(NEWTON):
                pull = now - want + mu * at  # zero where the convex function height - want l + mu l^2 / 2 is least
                if np.linalg.norm(pull) <= 0.02 * most:
                    break
                step, size = np.linalg.solve(slope + mu * np.eye(k), pull), 1.0
                value = height - want @ at + mu / 2 * at @ at
                for _ in range(12):
                    there = at - size * step
                    then, next_slope, next_height = measured(there)
                    lower = value - (next_height - want @ there + mu / 2 * there @ there)
                    if lower >= 1e-4 * size * (pull @ step) or np.linalg.norm(then - want + mu * there) < 0.5 * np.linalg.norm(pull):
                        break
                    size /= 2
                else:
                    break
                at, now, slope, height = there, then, next_slope, next_height
            if np.abs(now - want).max() <= most:
                break
        return cells.select("member", F.expr(rate(at)).alias("w")), now

    cells = scratch.cut(table.groupBy("member").agg(F.sum("tokens").alias("tokens")).select("member", "tokens", one.alias("w"), one.alias("y"), F.lit(True).alias("free")))
    cells, want, _ = descend(cells, None)
    cells, now = finish(scratch.cut(cells), want)
    return scratch.cut(cells.select("member", F.col("w").alias("rate"))), want, now


def mix(docs: DataFrame, labels: DataFrame, shares: dict[str, float], keep: list[str], id_col: str = "doc_id", text_col: str = "text", targets: dict[str, float] | None = None) -> DataFrame:
    """Columns ``keep`` with n_tokens, rate, and p_<domain> of each row.

    ``labels``: ``id_col`` and domain. A domain's target is ``targets[domain]`` tokens, or else
    ``shares[domain]`` (1 if absent) times its expected tokens at rate 1.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    domains = learn_domains(docs, labels, id_col, text_col)
    k = len(domains.names)
    table = scratch.cut(memberships(docs, domains, keep, text_col))
    rates, _, _ = fit_rates(table.select("tokens", "member"), k, [targets.get(d, 0.0) for d in domains.names] if targets is not None else None, [shares.get(d, 1.0) for d in domains.names])
    out = table.join(small(rates), "member")
    names = kept_names(keep, ["n_tokens", "rate", *[f"p_{d}" for d in domains.names]])
    return out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(names)], F.col("tokens").alias("n_tokens"), "rate", *[F.col("member")[i].alias(f"p_{d}") for i, d in enumerate(domains.names)])


def copies(rate: Column, key: Column) -> Column:
    """How often a document is taken: its rate rounded at random by a hash of ``key``, so that expected totals stay."""
    u = F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return F.floor(rate + u).cast("int")
