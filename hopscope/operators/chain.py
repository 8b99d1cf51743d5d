"""From latencies of captures to delay pools of nodes: fit, isolate, draw.

A node's own delay is what its total capture takes longer than its rest capture; a node without a rest capture is the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, few
from . import mixture, models
from .aggregate import running

#: Draws for each sample that is wanted, and the delay in seconds that one has to exceed.
OVER, LEAST = 2, 0.001


def node_pools(fitted: DataFrame, nodes: DataFrame, samples: int) -> DataFrame:
    """Each node's first ``samples`` valid differences of random draws of its total and of its rest: node, i (from 1), delay_s.

    ``fitted``: mixtures; ``nodes``: node, total_capture, rest_capture (null at the end of the chain). Nodes whose mixtures are missing drop out; one
    of which too many differences are rejected has fewer delays. Draws depend on node and number alone, so tasks may be dealt in any way.
    """
    comps = cut(mixture.packed(fitted))
    side = lambda key, name: F.broadcast(comps.select(F.col("model_id").alias(key), F.col("comps").alias(name))) if comps.count() <= 10_000 else comps.select(F.col("model_id").alias(key), F.col("comps").alias(name))
    plan = nodes.join(side("total_capture", "t"), "total_capture").join(side("rest_capture", "r"), "rest_capture", "left").where("rest_capture IS NULL OR r IS NOT NULL")
    rows = fitted.sparkSession.range(OVER * samples).crossJoin(few(cut(plan.select("node", "t", "r")), 10_000))  # a row for each node
    key = F.concat(F.col("id").cast("string"), F.lit("-"), F.col("node"))
    delay = mixture.draw(key, "t", F.col("t")) - F.when(F.col("r").isNull(), 0.0).otherwise(mixture.draw(key, "r", F.col("r")))
    valid = rows.select("node", "id", delay.alias("delay_s")).where(F.col("delay_s") > LEAST)
    return running(cut(valid), ["node"], "id", name="i").where(F.col("i") <= samples).select("node", "i", "delay_s")


def fitted_chain(latency: DataFrame, capture: str, value: str, nodes: DataFrame, ks: list[int], samples: int, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The captures' mixtures of least BIC, the nodes' isolated means and deviations, and the nodes' pools. ``how``: grid, rounds, gain of ``fit_mixtures``."""
    fitted = cut(models.fit_mixtures(latency, capture, value, ks, **how))
    return fitted, mixture.isolate(fitted, nodes), node_pools(fitted, nodes, samples)
