"""Readings of piecewise-linear time maps, given by their points (pair, t, phi), and their fit over a sweep of smoothness.

Slopes, kinks and energies follow from neighbouring points; values and inverses come by an as-of join with the points around.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F


def _upto(values: np.ndarray) -> np.ndarray:
    """Sums of the values before each place and at the end, along the last axis."""
    return np.concatenate([np.zeros((*values.shape[:-1], 1)), np.cumsum(values, -1)], -1)


def _places(values: np.ndarray) -> list:
    """The values by place: numbers of one map, columns of several."""
    return values.tolist() if values.ndim == 1 else list(np.moveaxis(values, -1, 0))


def _solved(diagonal: np.ndarray, beside: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of a symmetric tridiagonal system, by elimination."""
    d, e, b = _places(diagonal), _places(beside), _places(right)
    for i in range(1, len(d)):
        by = e[i - 1] / d[i - 1]
        d[i] = d[i] - by * e[i - 1]
        b[i] = b[i] - by * b[i - 1]
    for i in range(len(d) - 1, -1, -1):
        b[i] = (b[i] - (e[i] * b[i + 1] if i + 1 < len(d) else 0.0)) / d[i]
    return np.stack(b, -1)


def _inverse_trace(diagonal: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Trace of the inverse of a symmetric tridiagonal matrix: of the pivots from either end."""
    def pivots(d: list, e: list) -> np.ndarray:
        for i in range(1, len(d)):
            d[i] = d[i] - e[i - 1] * e[i - 1] / d[i - 1]
        return np.stack(d, -1)

    down, up = pivots(_places(diagonal), _places(beside)), pivots(_places(diagonal[..., ::-1]), _places(beside[..., ::-1]))[..., ::-1]
    return (1 / (down + up - diagonal)).sum(-1)


class _Map:
    """The map's quadratic program: nodes from 0 to total, values to come near, stretches that may not rise by less than `least`. Further axes before the last one are maps of as many nodes."""

    def __init__(self, h: np.ndarray, wanted: np.ndarray, total: np.ndarray | float, smooth: np.ndarray | float, least: np.ndarray):
        self.h, self.wanted, self.total, self.least = h, wanted, np.asarray(total)[..., None], least
        self.pull = smooth / h

    def with_held(self, held: np.ndarray) -> np.ndarray:
        """The minimum with the held stretches at their least rise: nodes that they tie are one unknown, so the system stays tridiagonal. All maps hold the same ones."""
        first = np.flatnonzero(np.append(True, ~held))  # nodes at which a tied run begins
        rise = _upto(np.where(held, self.least, 0.0))
        offset = rise - np.repeat(rise[..., first], np.diff(np.append(first, len(held) + 1)), -1)
        last = np.append(first[1:], len(held) + 1) - 1
        x = np.empty(rise.shape)
        x[..., : last[0] + 1] = offset[..., : last[0] + 1]
        x[..., first[-1] :] = self.total - offset[..., -1:] + offset[..., first[-1] :]
        if len(first) > 2:
            a, z = first[1:-1], last[1:-1]
            before, after = self.pull[..., a - 1], self.pull[..., z]
            sums = _upto(self.wanted - offset[..., 1:-1])
            right = sums[..., z] - sums[..., a - 1] - after * offset[..., z]
            right += before * np.concatenate([x[..., last[0], None], offset[..., z[:-1]]], -1)
            right[..., -1] += after[..., -1] * x[..., first[-1]]
            found = _solved((z - a + 1) + before + after, -after[..., :-1], right)
            x[..., a[0] : z[-1] + 1] = np.repeat(found, z - a + 1, -1) + offset[..., a[0] : z[-1] + 1]
        return x

    def forces(self, x: np.ndarray, held: np.ndarray) -> np.ndarray:
        """What each held stretch pushes with; below zero it is held wrongly."""
        flow = self.pull * np.diff(x)
        slope = (x[..., 1:-1] - self.wanted) + flow[..., :-1] - flow[..., 1:]  # of the inner nodes
        sums = _upto(slope)  # of nodes 1 to k
        free = np.flatnonzero(~held)
        start = free[np.maximum(np.searchsorted(free, np.arange(len(held)), "right") - 1, 0)]
        begin = np.where(np.arange(len(held)) < free[0], -1, start)
        from_left = sums - sums[..., np.maximum(begin, 0)]  # up to node k, from the run's beginning
        return np.where(held, np.where(begin < 0, sums[..., free[0], None] - sums, -from_left), 0.0)


def fit(t: np.ndarray, s: np.ndarray, smooth: float, least_slope_part: float) -> tuple[np.ndarray, float, int]:
    """Values at t of the piecewise-linear map that minimises sum (phi - s)^2 + smooth * sum slope^2 * dt, its degrees of freedom, and how many stretches have the least slope.

    The map keeps both ends of s, and no slope is below least_slope_part of the mean one. Each round solves a tridiagonal system with the held stretches tied, then holds all
    that are in the way and frees all that are held wrongly; if that doesn't settle, one stretch at a time from a map that keeps the bounds.
    """
    t, s = np.asarray(t, float), np.asarray(s, float)
    h, n = np.diff(t), len(t) - 2
    total = s[-1] - s[0]
    if n < 1:
        return s.copy(), 0.0, 0
    least = least_slope_part * total / (t[-1] - t[0]) * h
    problem = _Map(h, s[1:-1] - s[0], total, smooth, least)
    freedom = float(_inverse_trace(1 + problem.pull[:-1] + problem.pull[1:], -problem.pull[1:-1]))
    near = 1e-12 * max(1.0, abs(total))
    held = np.zeros(n + 1, bool)
    for _ in range(60):
        x = problem.with_held(held)
        now = np.where(held, problem.forces(x, held) >= -1e-9, np.diff(x) < least - near)
        if (now == held).all():
            return s[0] + x, freedom, int(held.sum())
        if now.all():
            break
        held = now
    x, held = (t - t[0]) * total / (t[-1] - t[0]), np.zeros(n + 1, bool)
    while True:
        step = problem.with_held(held) - x
        if np.abs(step).max() <= near:
            force = problem.forces(x, held)
            if not held.any() or force.min() >= -1e-9:
                return s[0] + x, freedom, int(held.sum())
            held[int(force.argmin())] = False
            continue
        along, room = np.diff(step), np.full(n + 1, np.inf)
        into = ~held & (along < -1e-15)
        room[into] = np.maximum(np.diff(x)[into] - least[into], 0) / -along[into]
        k = int(room.argmin())
        x = x + min(1.0, room[k]) * step
        if room[k] < 1:
            held[k] = True


#: Maps of up to so many nodes are fitted together; a longer one's own arrays are work enough for a call.
TOGETHER = 32


def fit_all(t: np.ndarray, s: np.ndarray, smooth: np.ndarray, least_slope_part: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`fit` of many maps of as many nodes: rows of t and s, a smoothness for each. Those of a round that hold the same stretches are solved together, by the same steps, so the results are the same to the last bit."""
    phi, freedom, count = np.empty(s.shape), np.empty(len(s)), np.zeros(len(s), np.int64)
    h, total = np.diff(t), s[:, -1] - s[:, 0]
    alone = np.arange(len(s))
    if 3 <= t.shape[1] <= TOGETHER:
        wanted, least = s[:, 1:-1] - s[:, :1], (least_slope_part * total / (t[:, -1] - t[:, 0]))[:, None] * h
        pull = smooth[:, None] / h
        freedom = _inverse_trace(1 + pull[:, :-1] + pull[:, 1:], -pull[:, 1:-1])
        near = 1e-12 * np.maximum(1.0, np.abs(total))[:, None]
        rounds, alone = [(alone, np.zeros(h.shape[1], bool))], []
        for _ in range(60):
            open_, now_held = [], []
            for rows, held in rounds:
                problem = _Map(h[rows], wanted[rows], total[rows], smooth[rows, None], least[rows])
                x = problem.with_held(held)
                now = np.where(held, problem.forces(x, held) >= -1e-9, np.diff(x) < least[rows] - near[rows])
                settled = (now == held).all(1)
                phi[rows[settled]], count[rows[settled]] = s[rows[settled], :1] + x[settled], held.sum()
                whole = ~settled & now.all(1)
                alone.append(rows[whole])
                open_.append(rows[~settled & ~whole])
                now_held.append(now[~settled & ~whole])
            rows, now = np.concatenate(open_), np.concatenate(now_held)
            if not len(rows):
                rounds = []
                break
            which = now @ (1 << np.arange(now.shape[1], dtype=np.int64))
            order = np.argsort(which, kind="stable")
            cuts = np.flatnonzero(np.diff(which[order])) + 1
            rounds = [(rows[part], now[part[0]]) for part in np.split(order, cuts)]
        alone = np.concatenate([*alone, *[rows for rows, _ in rounds]])
    for i in alone.tolist():
        phi[i], freedom[i], count[i] = fit(t[i], s[i], float(smooth[i]), least_slope_part)
    return phi, freedom, count


def fitted(matches: DataFrame, *, least_slope_part: float = 0.05) -> DataFrame:
    """pair, t, s, phi: the map at each matched time of matches (pair, t, s, smooth). Of matches at one time the least s counts; pairs of fewer than two times, or whose second
    side stands still, are left out. A pair is a row of arrays, so a task runs through its pairs without a call for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            phi = [fit(t, s, smooth, least_slope_part)[0] for t, s, smooth in zip(batch["t"], batch["s"], batch["smooth"])]
            yield pd.DataFrame({"pair": batch["pair"], "t": batch["t"], "s": batch["s"], "phi": phi})

    points = matches.where("t IS NOT NULL AND s IS NOT NULL").groupBy("pair", "smooth", "t").agg(F.min("s").alias("s"))
    rows = points.groupBy("pair", "smooth").agg(F.array_sort(F.collect_list(F.struct("t", "s"))).alias("p")).where((F.size("p") >= 2) & (F.element_at("p.s", -1) > F.element_at("p.s", 1)))
    rows = rows.select("pair", "smooth", F.col("p.t").cast("array<double>").alias("t"), F.col("p.s").cast("array<double>").alias("s"))
    done = rows.mapInPandas(run, "pair long, t array<double>, s array<double>, phi array<double>")
    return done.select("pair", F.explode(F.arrays_zip("t", "s", "phi")).alias("x")).select("pair", "x.t", "x.s", "x.phi")


def slopes(points: DataFrame) -> DataFrame:
    """pair, t, until, rise, slope of each stretch between two points."""
    w = Window.partitionBy("pair").orderBy("t")
    rows = points.select("pair", "t", F.lead("t").over(w).alias("until"), (F.lead("phi").over(w) - F.col("phi")).alias("rise"))
    return rows.where("until IS NOT NULL").withColumn("slope", F.col("rise") / (F.col("until") - F.col("t")))


def kinks(points: DataFrame) -> DataFrame:
    """pair, t, before, after, jump, log_ratio, place: the inner points by how much the slope changes there, most first."""
    w = Window.partitionBy("pair").orderBy("t")
    rows = slopes(points).withColumn("before", F.lag("slope").over(w)).where("before IS NOT NULL")
    rows = rows.select("pair", "t", "before", F.col("slope").alias("after"), (F.col("slope") - F.col("before")).alias("jump"), F.when((F.col("before") > 0) & (F.col("slope") > 0), F.ln(F.col("slope") / F.col("before"))).alias("log_ratio"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("pair").orderBy(F.desc_nulls_last(F.abs("log_ratio")), "t")))


def energies(points: DataFrame, *, smooth: float) -> DataFrame:
    """pair, mean_rate, dirichlet, excess, rate_rms, data_term, energy, residual_rms, residual_max, line_rms, explained of maps with data (pair, t, phi, s).

    dirichlet: the integral of the squared slope; excess: what of it a straight line wouldn't have; energy: data_term + smooth * dirichlet; explained:
    1 - residual_rms over that of the straight line between the ends.
    """
    stretch = slopes(points)
    bent = stretch.groupBy("pair").agg(F.sum(F.col("slope") * F.col("rise")).alias("dirichlet"), F.sum("rise").alias("rise"), F.sum(F.col("until") - F.col("t")).alias("length"))
    ends = points.groupBy("pair").agg(F.min_by("phi", "t").alias("phi0"), F.min("t").alias("t0"))
    rows = points.join(bent, "pair").join(ends, "pair").withColumn("rate", F.col("rise") / F.col("length"))
    r, line = F.col("phi") - F.col("s"), F.col("phi0") + F.col("rate") * (F.col("t") - F.col("t0")) - F.col("s")
    out = rows.groupBy("pair").agg(F.first("rate").alias("mean_rate"), F.first("dirichlet").alias("dirichlet"), F.first("length").alias("length"), F.sum(r * r).alias("data_term"), F.sqrt(F.avg(r * r)).alias("residual_rms"), F.max(F.abs(r)).alias("residual_max"), F.sqrt(F.avg(line * line)).alias("line_rms"))
    excess = F.col("dirichlet") - F.col("mean_rate") * F.col("mean_rate") * F.col("length")
    return out.select("pair", "mean_rate", "dirichlet", excess.alias("excess"), F.sqrt(F.greatest(excess, F.lit(0.0)) / F.col("length")).alias("rate_rms"), "data_term", (F.col("data_term") + smooth * F.col("dirichlet")).alias("energy"), "residual_rms", "residual_max", "line_rms", (1 - F.try_divide("residual_rms", "line_rms")).alias("explained"))


def at(points: DataFrame, asked: DataFrame, *, x: str = "t", y: str = "phi") -> DataFrame:
    """pair, x, y for asked (pair, x): by the line between the points around, beyond the ends the end's value. x and y changed about give the inverse."""
    rows = points.select("pair", F.col(x).alias("x"), F.struct(F.col(x).alias("x"), F.col(y).alias("y")).alias("p"), F.lit(0).alias("asked")).unionByName(asked.select("pair", F.col(x).alias("x"), F.lit(None).cast("struct<x:double,y:double>").alias("p"), F.lit(1).alias("asked")), allowMissingColumns=True)
    down = Window.partitionBy("pair").orderBy("x", "asked").rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy("pair").orderBy("x", F.desc("asked")).rowsBetween(0, Window.unboundedFollowing)
    found = rows.withColumns({"a": F.last("p", ignorenulls=True).over(down), "b": F.first("p", ignorenulls=True).over(up)}).where("asked = 1")
    between = F.col("a.y") + (F.col("b.y") - F.col("a.y")) * F.coalesce(F.try_divide(F.col("x") - F.col("a.x"), F.col("b.x") - F.col("a.x")), F.lit(0.0))
    return found.select("pair", F.col("x").alias(x), F.coalesce(between, F.col("a.y"), F.col("b.y")).alias(y)).distinct()


_SWEPT = {"data_term": "double", "excess": "double", "freedom": "double", "gcv": "double", "held": "long"}


def _swept(matches: DataFrame, smooths: list[float], least_slope_part: float) -> DataFrame:
    """pair, n, and a list for each measure of `sweep`, in the order of smooths. Pairs of a batch that have as many times are fitted together."""
    kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64() if kind == "long" else pa.float64()) for kind in _SWEPT.values()]]

    def measured(t: np.ndarray, s: np.ndarray) -> list[np.ndarray]:
        """Measures by map and smoothness."""
        n, k = t.shape[1] - 2, len(smooths)
        t, s = np.repeat(t, k, 0), np.repeat(s, k, 0)
        phi, freedom, held = fit_all(t, s, np.tile(np.array(smooths, float), len(t) // k), least_slope_part)
        data = ((phi - s) ** 2).sum(1)
        excess = (np.diff(phi) ** 2 / np.diff(t)).sum(1) - (phi[:, -1] - phi[:, 0]) ** 2 / (t[:, -1] - t[:, 0])
        rest = n - freedom
        gcv = np.where(rest > 1e-9, n * data / np.where(rest > 1e-9, rest, 1.0) ** 2, np.inf)
        return [c.reshape(-1, k) for c in (data, excess, freedom, gcv, held)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, size = batch["pair"].to_numpy(zero_copy_only=False), pc.list_value_length(batch["t"]).to_numpy(zero_copy_only=False)
            begin = np.cumsum(size) - size
            t, s = (pc.list_flatten(batch[c]).to_numpy(zero_copy_only=False) for c in ("t", "s"))
            for length in np.unique(size).tolist():
                whose = np.flatnonzero(size == length)
                for part in np.array_split(whose, max(1, len(whose) * len(smooths) * length // 500_000)):
                    at = begin[part][:, None] + np.arange(length)
                    part = part[s[at[:, -1]] > s[at[:, 0]]]
                    if len(part) and smooths:
                        at = begin[part][:, None] + np.arange(length)
                        lists = [pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * len(smooths), c.ravel()) for c in measured(t[at], s[at])]
                        yield pa.RecordBatch.from_arrays([pa.array(pair[part], pa.int64()), pa.array(np.full(len(part), length - 2)), *[c.cast(k) for c, k in zip(lists, kinds[2:])]], names=["pair", "n", *_SWEPT])

    points = matches.where("t IS NOT NULL AND s IS NOT NULL").groupBy("pair", "t").agg(F.min("s").alias("s"))
    rows = points.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("t", "s"))).alias("p")).where(F.size("p") >= 3)
    rows = rows.select("pair", F.col("p.t").cast("array<double>").alias("t"), F.col("p.s").cast("array<double>").alias("s"))
    return rows.mapInArrow(run, "pair long, n long, " + ", ".join(f"{c} array<{kind}>" for c, kind in _SWEPT.items()))


def sweep(matches: DataFrame, smooths: list[float], *, least_slope_part: float = 0.05) -> DataFrame:
    """pair, smooth, n, data_term, excess, freedom, gcv, held: fits of each pair's matches (pair, t, s) for each smoothness.

    freedom: effective degrees of freedom; gcv = n data_term / (n - freedom)^2; held: stretches at the least slope. Of matches at one time the least s counts,
    those without t or s don't. Pairs of fewer than three times, or whose second side stands still, are left out. A pair is a row of arrays; those of a batch that have as many
    times are fitted together.
    """
    found = _swept(matches, smooths, least_slope_part).withColumn("smooth", F.lit(list(map(float, smooths))).cast("array<double>"))
    return found.select("pair", "n", F.explode(F.arrays_zip("smooth", *_SWEPT)).alias("x")).select("pair", "x.smooth", "n", *[f"x.{c}" for c in _SWEPT])


def smoothness(swept: DataFrame) -> DataFrame:
    """pair, smooth: the one of least generalised cross-validation, of equal ones the least smooth."""
    return swept.groupBy("pair").agg(F.min_by("smooth", F.struct("gcv", "smooth")).alias("smooth"))


def corner(swept: DataFrame) -> DataFrame:
    """pair, smooth: where log excess over log data_term bends most, derivatives by central differences; of equal bends the least smooth, of fewer than five values the middle one.

    A pair has a row for each value swept, so its window is small.
    """
    order, least = Window.partitionBy("pair").orderBy("smooth"), F.lit(1e-300)
    rows = swept.select("pair", "smooth", F.log(F.greatest("data_term", least)).alias("x"), F.log(F.greatest("excess", least)).alias("y"))
    rows = rows.withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(Window.partitionBy("pair"))})
    slope = lambda c: (F.lead(c).over(order) - F.lag(c).over(order)) / 2
    turn = lambda c: (F.lead(c, 2).over(order) - 2 * F.col(c) + F.lag(c, 2).over(order)) / 4
    rows = rows.withColumns({"x1": slope("x"), "y1": slope("y"), "x2": turn("x"), "y2": turn("y")})
    bend = F.try_divide(F.col("x1") * F.col("y2") - F.col("y1") * F.col("x2"), F.pow(F.col("x1") * F.col("x1") + F.col("y1") * F.col("y1"), F.lit(1.5)))
    inner = rows.where(F.when(F.col("n") < 5, F.col("i") == F.floor(F.col("n") / 2)).otherwise((F.col("i") >= 2) & (F.col("i") < F.col("n") - 2)))
    return inner.groupBy("pair").agg(F.max_by("smooth", F.struct(F.coalesce(bend, F.lit(float("-inf"))), -F.col("smooth"))).alias("smooth"))


def corners(matches: DataFrame, smooths: list[float], *, least_slope_part: float = 0.05) -> DataFrame:
    """pair, smooth: `corner` of the `sweep` of matches. A pair's fits stay in its row, so they aren't dealt out again."""
    k, order = len(smooths), sorted(range(len(smooths)), key=lambda i: smooths[i])
    rows = _swept(matches, smooths, least_slope_part).select("pair", *[F.log(F.greatest(F.get(c, F.lit(i)), F.lit(1e-300))).alias(f"{name}{at}") for name, c in (("x", "data_term"), ("y", "excess")) for at, i in enumerate(order)])
    slope = lambda c, i: (F.col(f"{c}{i + 1}") - F.col(f"{c}{i - 1}")) / 2
    turn = lambda c, i: (F.col(f"{c}{i + 2}") - 2 * F.col(f"{c}{i}") + F.col(f"{c}{i - 2}")) / 4
    if k < 5:
        return rows.select("pair", F.lit(float(smooths[order[k // 2]]) if smooths else None).cast("double").alias("smooth"))
    bends = []
    for i in range(2, k - 2):
        x1, y1 = slope("x", i), slope("y", i)
        bend = F.try_divide(x1 * turn("y", i) - y1 * turn("x", i), F.pow(x1 * x1 + y1 * y1, F.lit(1.5)))
        bends.append(F.struct(F.coalesce(bend, F.lit(float("-inf"))).alias("bend"), F.lit(-float(smooths[order[i]])).alias("less")))
    return rows.select("pair", F.negative(F.array_max(F.array(*bends))["less"]).alias("smooth"))


def census(events: DataFrame, matches: DataFrame) -> DataFrame:
    """pair, n_a, n_b, matched, only_a, only_b, coverage (of the shorter side) of events (pair, side) and their matches (pair, i, j)."""
    sides = events.groupBy("pair").agg(F.count_if(F.col("side") == "a").alias("n_a"), F.count_if(F.col("side") == "b").alias("n_b"))
    both = sides.join(matches.groupBy("pair").agg(F.count("*").alias("matched")), "pair", "left").fillna(0, ["matched"])
    return both.select("pair", "n_a", "n_b", "matched", (F.col("n_a") - F.col("matched")).alias("only_a"), (F.col("n_b") - F.col("matched")).alias("only_b"), F.round(F.coalesce(F.try_divide("matched", F.least("n_a", "n_b")), F.lit(0.0)), 6).alias("coverage"))
