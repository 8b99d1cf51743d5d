"""Fitting of 1-D mixtures (EM, BIC) and kernel densities on pre-aggregated samples.

Samples are first counted, on a grid (``grid`` seconds: 100 us for mixtures, 1 ms for densities by default). EM
runs on the counts where they lie: tasks send the sums that a round needs, so no group of samples meets in a task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut, few

MODEL = "model_id string, k int, n long, loglik double, bic double, comp int, weight double, mean double, var double"


def bic(loglik, k, n, log=np.log):
    """Of numbers, or of columns with ``log`` of columns."""
    return -2 * loglik + (3 * k - 1) * log(n)


def scored(rows: DataFrame, value: str, model: DataFrame, keys: list[str]) -> DataFrame:
    """How well mixtures fit samples: keys, model_id, k, n, loglik, bic. Equal values are counted first, so each is scored once by each mixture."""
    from .mixture import density, packed

    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    both = counts.crossJoin(few(cut(packed(model)), 10_000))  # a row for each mixture
    loglik = F.sum(F.col("_c") * F.ln(density(F.col(value), F.col("comps")) + 1e-300))
    sums = both.groupBy(*keys, "model_id").agg(F.max(F.size("comps")).alias("k"), F.sum("_c").alias("n"), loglik.alias("loglik"))
    return sums.withColumn("bic", bic(F.col("loglik"), F.col("k"), F.col("n"), F.ln))


#: Rounds of EM, the gain of the mean log-likelihood at which a fit ends, the least variance, and fits (key, k) that are worked on at once.
ROUNDS, GAIN, FLOOR, FITS = 100, 1e-3, 1e-6, 4_096


def value_counts(latency: DataFrame, key: str, value: str, grid: float | None) -> DataFrame:
    """Values, on a grid if one is given, with their counts: model_id, x, c."""
    x = F.col(value) if grid is None else F.round(F.col(value) / grid) * grid
    return latency.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("model_id"), x.alias("x")).agg(F.count("*").cast("double").alias("c"))


def starts(counts: DataFrame, ks: list[int]) -> DataFrame:
    """Where fits begin: equal weights, means at even steps between the least and the greatest value, variances of the square of half a step.

    model_id, k, n, comp, weight, mean, var; keys with fewer than 2 samples have none.
    """
    span = counts.groupBy("model_id").agg(F.sum("c").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).where("n >= 2")
    each = span.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).withColumn("comp", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    step = (F.col("high") - F.col("low")) / F.col("k")
    return each.select("model_id", "k", F.col("n").cast("long").alias("n"), "comp", (F.lit(1.0) / F.col("k")).alias("weight"), (F.col("low") + (F.col("comp") + 0.5) * step).alias("mean"), F.greatest(step * step / 4, F.lit(FLOOR)).alias("var"))


Fits = dict[tuple[str, int], np.ndarray]


def _packed_fits(rows: list, n: dict) -> Fits:
    out: dict[tuple[str, int], list] = {}
    for r in sorted(rows, key=lambda r: (str(r["model_id"]), r["k"], r["comp"])):
        out.setdefault((r["model_id"], r["k"]), []).append((r["weight"], r["mean"], r["var"]))
        n[r["model_id"]] = r["n"]
    return {key: np.array(v).T for key, v in out.items()}


def expectations(counts: DataFrame, fits: Fits) -> dict[tuple[str, int], tuple[np.ndarray, float]]:
    """One pass: for each fit the sums of responsibility, of it times x and times x squared (3, k), and the log-likelihood.

    A task adds up its values' shares for all fits of its keys and sends one row a fit; those rows are added up by fit, in a fixed
    order. x counts from the fit's own means, so that the sums lose no digits.
    """
    held = counts.sparkSession.sparkContext.broadcast(fits)

    def run(batches):
        from pyspark import TaskContext

        sums: dict[tuple[str, int], np.ndarray] = {}
        by_key: dict[str, list] = {}
        for key in held.value:
            by_key.setdefault(key[0], []).append(key)
        for batch in batches:
            df = batch.to_pandas()
            for name, own in df.groupby("model_id", dropna=False, sort=False):
                name = None if name != name else name
                x, c = own["x"].to_numpy(float), own["c"].to_numpy(float)
                for key in by_key.get(name, []):
                    w, m, v = held.value[key]
                    z = x[:, None] - m
                    with np.errstate(divide="ignore"):
                        log = np.log(w) - 0.5 * (np.log(2 * np.pi * v) + z * z / v)
                    top = log.max(1, keepdims=True)
                    p = np.exp(log - top)
                    s = p.sum(1, keepdims=True)
                    r = p / s * c[:, None]
                    own_sums = np.concatenate([r.sum(0), (r * z).sum(0), (r * z * z).sum(0), [float((c * (top + np.log(s))[:, 0]).sum())]])
                    sums[key] = sums[key] + own_sums if key in sums else own_sums
        if sums:
            part = TaskContext.get().partitionId()
            keys = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([part] * len(keys), pa.int32()), pa.array([sums[k].tolist() for k in keys], pa.list_(pa.float64()))], names=["model_id", "k", "part", "s"])

    parts = counts.mapInArrow(run, "model_id string, k int, part int, s array<double>")
    each = parts.select("model_id", "k", "part", F.posexplode("s").alias("i", "v")).groupBy("model_id", "k", "i").agg(F.array_sort(F.collect_list(F.struct("part", "v"))).alias("v"))  # a value of each task
    added = each.select("model_id", "k", "i", F.aggregate("v", F.lit(0.0), lambda a, x: a + x["v"]).alias("v"))
    out: dict[tuple[str, int], np.ndarray] = {}
    for r in added.collect():  # 3 k + 1 numbers a fit
        key = r["model_id"], r["k"]
        out.setdefault(key, np.zeros(3 * key[1] + 1))[r["i"]] = r["v"]
    held.unpersist()
    return {key: (v[:-1].reshape(3, -1), float(v[-1])) for key, v in out.items()}


def stepped(fit: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Weights, means and variances (3, k) after one round."""
    mass = sums[0] + 1e-12
    shift = sums[1] / mass
    return np.stack([mass / mass.sum(), fit[1] + shift, np.maximum(sums[2] / mass - shift * shift, FLOOR)])


def em_rounds(counts: DataFrame, begin: DataFrame, rounds: int = ROUNDS, gain: float = GAIN) -> DataFrame:
    """Mixtures after EM on counted values (``value_counts``) from ``starts``: ``MODEL``, components by mean.

    All fits of all keys go on side by side, a pass over the values a round, until a round's mean log-likelihood gains less than ``gain`` (negative: all
    ``rounds``). Values stay with their tasks; what moves is the fits' sums. ``FITS`` fits at most are worked on at once.
    """
    spark = counts.sparkSession
    counts, begin = cut(counts), cut(begin)
    wanted = sorted((tuple(r) for r in begin.select("model_id", "k").distinct().collect()), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    out: list[tuple] = []
    for a in range(0, len(wanted), FITS):
        some = spark.createDataFrame(wanted[a : a + FITS], "model_id string, k int")
        n: dict[str, int] = {}
        same = begin["model_id"].eqNullSafe(some["model_id"]) & (begin["k"] == some["k"])
        fits = _packed_fits(begin.join(F.broadcast(some), same, "left_semi").collect(), n)
        last: dict[tuple[str, int], float] = {}
        going = dict(fits)
        for _ in range(rounds):
            for key, (sums, loglik) in expectations(counts, going).items():
                fits[key] = stepped(fits[key], sums)
                if loglik - last.get(key, -np.inf) <= gain * n[key[0]]:
                    going.pop(key)
                else:
                    going[key] = fits[key]
                last[key] = loglik
            if not going:
                break
        ends = expectations(counts, fits)
        for key, (_, loglik) in sorted(ends.items(), key=lambda x: (str(x[0][0]), x[0][1])):
            order = np.lexsort((fits[key][2], fits[key][1]))
            for comp, j in enumerate(order):
                out.append((key[0], key[1], int(n[key[0]]), loglik, float(bic(loglik, key[1], n[key[0]])), comp, *(float(z) for z in fits[key][:, j])))
    return spark.createDataFrame(out, MODEL)


def fit_mixtures(latency: DataFrame, key: str, value: str, ks: list[int], grid: float | None = 1e-4, best: bool = True, rounds: int = ROUNDS, gain: float = GAIN) -> DataFrame:
    """A model row for each component of each (key, k), or of each key's k of least BIC (the least k of equals).

    Values are counted first, on a grid if one is given. Keys with fewer than 2 samples have no model.
    """
    counts = cut(value_counts(latency, key, value, grid))
    fits = em_rounds(counts, starts(counts, ks), rounds, gain)
    return select_model(fits) if best else fits


def select_model(fits: DataFrame) -> DataFrame:
    """Of each model_id the rows of the k of least BIC."""
    chosen = fits.groupBy("model_id").agg(F.min_by("k", F.struct("bic", "k")).alias("k"))
    return fits.join(chosen, ["model_id", "k"])


def kernel_density(latency: DataFrame, value: str, bandwidth: float, points: int, low: float, high: float, grid: float = 1e-3) -> DataFrame:
    """Gaussian kernel density at ``points`` equal steps, over samples counted on a grid: (x, pdf)."""
    counts = latency.where(F.col(value).isNotNull()).groupBy((F.round(F.col(value) / grid) * grid).alias("v")).agg(F.count("*").alias("c"))
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    at = counts.withColumn("i", F.explode(steps)).withColumn("x", F.lit(low) + F.col("i") * ((high - low) / (points - 1)))
    z = (F.col("x") - F.col("v")) / bandwidth
    sums = at.groupBy("i", "x").agg(F.sum(F.col("c") * F.exp(-0.5 * z * z)).alias("s"), F.sum("c").alias("n"))
    return sums.select("i", "x", (F.col("s") / (F.col("n") * bandwidth * (2 * np.pi) ** 0.5)).alias("pdf"))


#: Values whose density is worked out at once; bandwidths that are tried: 30 from 0.001 to 0.5, in equal ratios.
BLOCK = 256
BANDWIDTHS = [float(h) for h in np.logspace(-3, np.log10(0.5), 30)]


def select_bandwidth(latency: DataFrame, value: str, order: str, bandwidths: list[float] | None = None, folds: int = 3, grid: float = 1e-3) -> DataFrame:
    """Held-out log-likelihood of each bandwidth, best first. Folds are runs of rows in ``order`` (a number), the first ones longer by one where rows don't divide."""
    from .aggregate import running

    rows = latency.where(F.col(value).isNotNull()).select(F.col(order).alias("o"), (F.round(F.col(value) / grid) * grid).alias("v"))
    at = running(rows, [], "o", ["v"], name="at").crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))  # one row
    small, long = F.floor(F.col("n") / folds), F.col("n") % folds
    place = F.col("at") - 1
    fold = F.when(place < long * (small + 1), F.floor(place / (small + 1))).otherwise(long + F.floor((place - long * (small + 1)) / F.greatest(small, F.lit(1)))).cast("int")
    counts = at.groupBy("v", fold.alias("fold")).agg(F.count("*").alias("c")).withColumn("h", F.explode(F.array(*[F.lit(float(h)) for h in bandwidths or BANDWIDTHS])))

    def score(df: pd.DataFrame) -> pd.DataFrame:
        h, total = float(df["h"].iloc[0]), 0.0
        for f in range(folds):
            tr, te = df[df["fold"] != f], df[df["fold"] == f]
            if len(tr) and len(te):
                near = tr["v"].to_numpy()
                for a in range(0, len(te), BLOCK):  # values of the fold that meet those of the others at once
                    own = te.iloc[a : a + BLOCK]
                    d = np.exp(-0.5 * ((own["v"].to_numpy()[:, None] - near) / h) ** 2) @ tr["c"].to_numpy(float)
                    total += float((own["c"] * np.log(d / (tr["c"].sum() * h * (2 * np.pi) ** 0.5) + 1e-300)).sum())
        return pd.DataFrame({"bandwidth": [h], "loglik": [total]})

    return counts.groupBy("h").applyInPandas(score, "bandwidth double, loglik double").orderBy(F.desc("loglik"), "bandwidth")


#: Hops of the emulated chain: node, delay in seconds where its pool is missing (null: it adds none), and whether it draws once a connection.
CHAIN = [("ips", 0.002, True), ("adc", 0.002, False), ("waf", 0.003, False), ("web", 0.001, False), ("fw2", 0.002, False), ("slb", None, False), ("app", 0.005, False)]


def chain_delays(requests: DataFrame, pools: DataFrame, hops: list[tuple] | None = None, no_delay: bool = False) -> DataFrame:
    """Each request's delay at every hop and up to it: id, hop, node, delay, upto.

    ``requests``: id, conn. ``pools``: node, idx (from 0), v. A hop draws from its node's pool by a number made of the
    request's or connection's id and the node's name, so results don't depend on partitions. ``no_delay``: all 0.
    """
    spark = requests.sparkSession
    chain = spark.createDataFrame([(i, n, f, c) for i, (n, f, c) in enumerate(hops or CHAIN)], "hop int, node string, fallback double, once boolean")
    sizes = pools.groupBy("node").agg(F.count("*").alias("n"))
    plan = F.broadcast(chain.join(sizes, "node", "left"))  # a row for each hop
    steps = requests.crossJoin(plan)
    key = F.when(F.col("once"), F.col("conn")).otherwise(F.col("id"))
    u = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(":"), F.col("node")).cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)
    drawn = steps.withColumn("idx", F.floor(u * F.col("n")).cast("bigint")).join(pools.select("node", "idx", "v"), ["node", "idx"], "left")
    delay = F.lit(0.0) if no_delay else F.when(F.col("fallback").isNull(), 0.0).otherwise(F.coalesce("v", "fallback"))
    upto = F.sum("delay").over(Window.partitionBy("id").orderBy("hop"))
    return drawn.withColumn("delay", delay).select("id", "hop", "node", "delay", upto.alias("upto"))


def refit(samples: DataFrame, value: str, name: str, ks: list[int], least: float | None = None, rounds: int = ROUNDS, gain: float = GAIN) -> DataFrame:
    """The mixture of least BIC of samples above ``least``."""
    kept = samples.where(F.col(value) > least) if least is not None else samples
    return fit_mixtures(kept.select(F.lit(name).alias("name"), value), "name", value, ks, rounds=rounds, gain=gain)
