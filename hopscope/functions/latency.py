"""Latency arithmetic, mixtures and reproducible draws as Column builders."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds in seconds, both exclusive: emitted pairs, fits, TLS pairs, mixture and density fits.
WINDOWS = {"emit": (0.0005, 5.0), "fit": (0.0, 5.0), "tls": (0.001, math.inf), "mixture": (0.0, 2.0)}


def plausible(latency: Column, window: str | tuple[float, float]) -> Column:
    low, high = WINDOWS[window] if isinstance(window, str) else window
    return (latency > low) & (latency < high)


def uniform(i: Column, stream: str) -> Column:
    """A number in [0, 1) from the md5 of ``i`` and a stream name: the same on any partitioning."""
    return F.conv(F.substring(F.md5(F.concat(i.cast("string"), F.lit(":" + stream)).cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def normal(i: Column, stream: str) -> Column:
    """A standard normal number by Box-Muller from two streams."""
    return F.sqrt(-2 * F.ln(1 - uniform(i, stream + "a"))) * F.cos(2 * math.pi * uniform(i, stream + "b"))


def normal_pdf(x: Column, mean: Column, var: Column) -> Column:
    return F.exp(-((x - mean) * (x - mean)) / (2 * var)) / F.sqrt(2 * math.pi * var)


def normal_cdf(x: Column, mean: Column, var: Column) -> Column:
    """By the Abramowitz-Stegun approximation 7.1.26 of the error function (absolute error below 1.5e-7)."""
    z = (x - mean) / F.sqrt(2 * var)
    t = 1 / (1 + 0.3275911 * F.abs(z))
    tail = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-z * z)
    return 0.5 * (1 + F.signum(z) * (1 - tail))


def verdict(divergence: Column, fair: bool = True) -> Column:
    """How alike two distributions are; ``fair`` adds a step at 1."""
    out = F.when(divergence < 0.1, "excellent").when(divergence < 0.5, "good")
    return (out.when(divergence < 1.0, "fair") if fair else out).otherwise("poor")


def six_decimals(value: Column) -> Column:
    """A number as text with six decimals."""
    return F.format_string("%.6f", value)


def bin_of(latency: Column, width_us: int, low_us: int = 0) -> Column:
    """Bin number of a latency in seconds on a grid of whole microseconds."""
    return F.floor((F.floor(F.round(latency * 1e6, 3)) - low_us) / width_us).cast("bigint")
