"""Gaussian mixtures as tables (model_id, comp, weight, mean, var): moments, densities, divergence, draws, isolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.latency import normal, normal_cdf, normal_pdf, uniform
from ..scratch import cut, few


def moments(model: DataFrame) -> DataFrame:
    """Mean and standard deviation of each mixture."""
    out = model.groupBy("model_id").agg(F.sum(F.col("weight") * F.col("mean")).alias("mu"), F.sum(F.col("weight") * (F.col("var") + F.col("mean") * F.col("mean"))).alias("m2"))
    return out.select("model_id", "mu", (F.col("m2") - F.col("mu") * F.col("mu")).alias("variance"))


def isolate(models: DataFrame, nodes: DataFrame) -> DataFrame:
    """A node's own mean and variance: total minus rest; a node without rest keeps the total. Negative ones are flagged.

    ``nodes``: node, total_capture, rest_capture (null at the end of the chain). Nodes whose models are missing drop out.
    """
    m = moments(models)
    t = m.select(F.col("model_id").alias("total_capture"), F.col("mu").alias("t_mu"), F.col("variance").alias("t_var"))
    r = m.select(F.col("model_id").alias("rest_capture"), F.col("mu").alias("r_mu"), F.col("variance").alias("r_var"))
    out = nodes.join(t, "total_capture").join(r, "rest_capture", "left").where("rest_capture IS NULL OR r_mu IS NOT NULL")
    mu, var = F.col("t_mu") - F.coalesce("r_mu", F.lit(0.0)), F.col("t_var") - F.coalesce("r_var", F.lit(0.0))
    return out.select("node", mu.alias("mu"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"), (mu < 0).alias("negative_mean"), (var < 0).alias("negative_variance"))


def packed(model: DataFrame) -> DataFrame:
    """One row a mixture, its components in an array by number, with cumulative weights up to and with each."""
    w = Window.partitionBy("model_id").orderBy("comp")
    c = model.withColumn("upto", F.sum("weight").over(w)).groupBy("model_id")
    return c.agg(F.array_sort(F.collect_list(F.struct("comp", "weight", "mean", "var", "upto"))).alias("comps"))


def density(x: Column, comps: Column) -> Column:
    return F.aggregate(comps, F.lit(0.0), lambda a, c: a + c["weight"] * normal_pdf(x, c["mean"], c["var"]))


def distribution(x: Column, comps: Column) -> Column:
    return F.aggregate(comps, F.lit(0.0), lambda a, c: a + c["weight"] * normal_cdf(x, c["mean"], c["var"]))


def draw(i: Column, stream: str, comps: Column) -> Column:
    """A reproducible draw: the component by cumulative weight, then a normal number."""
    u = uniform(i, stream + "c")
    c = F.coalesce(F.get(F.filter(comps, lambda c: u < c["upto"]), F.lit(0)), F.element_at(comps, -1))
    return c["mean"] + F.sqrt(c["var"]) * normal(i, stream)


def responsibilities(rows: DataFrame, x: str, model: DataFrame) -> DataFrame:
    """Each row's share of each component, and the component that has most (the least number of equals)."""
    joined = rows.crossJoin(few(cut(packed(model)), 10_000))  # one row for each mixture
    d = density(F.col(x), F.col("comps"))
    parts = F.transform("comps", lambda c: F.struct((c["weight"] * normal_pdf(F.col(x), c["mean"], c["var"])).alias("w"), (-c["comp"]).alias("neg"), c["comp"].alias("comp")))
    return joined.withColumn("pdf", d).withColumn("parts", parts).withColumn("label", F.array_max("parts")["comp"]).withColumn("share", F.array_max("parts")["w"] / F.col("pdf"))


def grid_divergence(models: DataFrame, p: str, q: str, points: int = 5000, low: float = 1e-4, high: float = 1.0) -> DataFrame:
    """Kullback-Leibler divergence and Jensen-Shannon distance (at most sqrt(ln 2)) of two mixtures on a grid."""
    comps = packed(models)
    pair = comps.where(F.col("model_id") == p).select(F.col("comps").alias("pc")).crossJoin(comps.where(F.col("model_id") == q).select(F.col("comps").alias("qc")))
    x = F.lit(low) + F.col("id") * ((high - low) / (points - 1))
    grid = models.sparkSession.range(points).crossJoin(F.broadcast(pair)).select(density(x, F.col("pc")).alias("p"), density(x, F.col("qc")).alias("q"))
    total = grid.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    clip = lambda c: F.least(F.greatest(c, F.lit(1e-10)), F.lit(1.0))
    n = grid.crossJoin(F.broadcast(total)).select(clip(F.col("p") / F.col("sp")).alias("p"), clip(F.col("q") / F.col("sq")).alias("q"))
    s = n.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    n = n.crossJoin(F.broadcast(s)).select((F.col("p") / F.col("sp")).alias("p"), (F.col("q") / F.col("sq")).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    kl = lambda a, b: F.sum(F.col(a) * F.ln(F.col(a) / F.col(b)))
    return n.agg(kl("p", "q").alias("kl"), F.sqrt((kl("p", "m") + kl("q", "m")) / 2).alias("js"))


def monte_carlo_kl(models: DataFrame, p: str, q: str, n: int, stream: str = "kl") -> DataFrame:
    """KL(p || q) from ``n`` reproducible draws of p, floored at 0."""
    comps = packed(models)
    pair = comps.where(F.col("model_id") == p).select(F.col("comps").alias("pc")).crossJoin(comps.where(F.col("model_id") == q).select(F.col("comps").alias("qc")))
    rows = models.sparkSession.range(n).crossJoin(F.broadcast(pair)).withColumn("x", draw(F.col("id"), stream, F.col("pc")))
    lp, lq = F.ln(density(F.col("x"), F.col("pc")) + 1e-300), F.ln(density(F.col("x"), F.col("qc")) + 1e-300)
    return rows.agg(F.greatest(F.lit(0.0), F.avg(lp - lq)).alias("kl"))


def prune(model: DataFrame, least: float = 0.05) -> DataFrame:
    """Without components below ``least``; the other weights sum to 1."""
    kept = model.where(F.col("weight") >= least)
    return kept.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("model_id")))
