"""Aligning pairs of performances: matched onset events, a monotone time map fitted to them, and how well it fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from . import correspondence
from .warps import fit, fitted


def align(events: DataFrame, *, gap: float = correspondence.GAP, tau: float = correspondence.TAU) -> DataFrame:
    """pair, i, j, t, s: matched events of the two sides of each pair by pitch alone; events: pair, side (a or b), t, notes. See `correspondence`."""
    return correspondence.correspond(correspondence.indexed(events), gap=gap, tau=tau).select("pair", "i", "j", "t", "s")


def fit_map(t: np.ndarray, s: np.ndarray, smooth: float, least_slope_part: float) -> np.ndarray:
    return fit(t, s, smooth, least_slope_part)[0]


def warps(matches: DataFrame, *, smooth: float = 0.1, least_slope_part: float = 0.05) -> DataFrame:
    """pair, t, s, phi: the fitted map at each matched time; pairs of fewer than two distinct times, or whose second side stands still, are left out."""
    return fitted(matches.select("pair", "t", "s", F.lit(smooth).alias("smooth")), least_slope_part=least_slope_part)


def warp_quality(fitted: DataFrame) -> DataFrame:
    """pair, n, rms, worst, line_rms: residuals of the map, and of the straight line by least squares."""
    line = F.regr_slope("s", "t") * F.regr_sxx("s", "t")
    rest = F.greatest(F.regr_syy("s", "t") - F.regr_slope("s", "t") * line, F.lit(0.0))
    r = F.col("phi") - F.col("s")
    return fitted.groupBy("pair").agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(r * r)), 6).alias("rms"), F.round(F.max(F.abs(r)), 6).alias("worst"), F.round(F.sqrt(rest / F.count("*")), 6).alias("line_rms"))
