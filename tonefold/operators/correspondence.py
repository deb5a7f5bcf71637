"""Which onset of one performance is which of the other: local alignment along a band, with a timing prior, alternating with the fitted map.

Two events may be paired if they share at least half of what they sound (see `COSTS`); a pair scores 1 - cost / tau, less the prior's penalty; an event left
out costs a gap. The best local alignment is a dynamic program over (event of a, event of b). Its rows are worked through in order by one task for each pair of
performances, which holds a row and the events of the band around it, not a performance: events come to it sorted, and it hands on a row of steps for each event of
a. A second scan reads these rows backwards from the best cell. Scores are whole numbers (millionths), so equal ways are equal.

Short pairs have no band. In long ones it follows what is known of the correspondence: at first n-grams of the upper line that stand once in either side, later the
matches of the pass before. A way that comes near the band's edge is sought again in a band twice as wide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.stored import stored
from . import warps
from .running import running, running_sum

#: The share of exact notes in a cost, the rest is that of pitch classes; the highest cost of a pair; the cost of an event left out; the greatest penalty of the prior, and the seconds at which it is reached.
EXACT, TAU, GAP, PRIOR, HORIZON = 0.75, 0.5, 0.25, 0.5, 2.0
ONE = 1_000_000
#: Events of a block, for which the band is the same; events of b below which a pair has no band; half of a band's first width; nearness to its edge that counts as touching it.
BLOCK, WHOLE, HALF, NEAR = 1024, 4096, 2048, 64
#: Steps of the n-grams that guide a first pass.
GRAM = 6
_END = 1 << 62
_STOP, _PAIR, _SKIP_A, _SKIP_B = 0, 1, 2, 3


def indexed(events: DataFrame, *, bucket: float = 3600.0) -> DataFrame:
    """pair, side, n (the event's place in its side, from 0), t, notes, low and high (bits of the notes 0-63 and 64-127), classes, top.

    events: pair, side (a or b), t, notes. Rows with a null pair, side, time or list of notes are left out, notes that are null or outside 0-127 too. Events at one
    time are in the order of their notes. Placed by buckets of time, so no task holds a side.
    """
    notes = F.array_sort(F.array_distinct(F.filter("notes", lambda n: n.between(0, 127))))
    rows = events.where("pair IS NOT NULL AND side IN ('a', 'b') AND t IS NOT NULL AND notes IS NOT NULL").select("pair", "side", F.col("t").cast("double").alias("t"), notes.cast("array<int>").alias("notes"))
    bits = lambda lo: f"aggregate(notes, 0L, (s, n) -> s | CASE WHEN n >= {lo} AND n < {lo + 64} THEN shiftleft(1L, n - {lo}) ELSE 0L END)"
    rows = rows.withColumns({"low": F.expr(bits(0)), "high": F.expr(bits(64)), "classes": F.expr("aggregate(notes, 0, (s, n) -> s | shiftleft(1, n % 12))"), "top": F.array_max("notes"), "_one": F.lit(1)})
    placed = running_sum(rows, ["pair", "side"], ["t", "notes"], "_one", "_upto", F.floor(F.col("t") / bucket))
    return placed.withColumn("n", (F.col("_upto") - 1).cast("long")).drop("_one", "_upto")


def event_cost(a: Column, b: Column) -> Column:
    """1 - EXACT * Jaccard of two note arrays - (1 - EXACT) * Jaccard of their pitch classes; two empty arrays cost nothing."""
    def jaccard(x: Column, y: Column) -> Column:
        return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(1.0))

    classes = lambda x: F.transform(x, lambda n: F.pmod(n, F.lit(12)))
    return 1 - EXACT * jaccard(a, b) - (1 - EXACT) * jaccard(classes(a), classes(b))


def scores(a: tuple[int, int, int], low: np.ndarray, high: np.ndarray, classes: np.ndarray, tau: float) -> np.ndarray:
    """Scores in millionths of pairing an event (its bits) with each of others; far below zero where they may not be paired."""
    def part(both: np.ndarray, either: np.ndarray) -> np.ndarray:
        return np.where(either > 0, both / np.maximum(either, 1), 1.0)

    count = np.bitwise_count
    x, y, z = (np.uint64(v) for v in a)
    alike = EXACT * part(count(low & x).astype(np.int64) + count(high & y), count(low | x).astype(np.int64) + count(high | y)) + (1 - EXACT) * part(count(classes & z), count(classes | z))
    cost = 1 - alike
    return np.where(cost <= tau + 1e-9, np.rint(ONE * (1 - cost / tau)), -float(_END)).astype(np.int64)


class Forward:
    """The rows of the dynamic program, one after the other. b: the events of the band; best: the highest score so far and its cell."""

    def __init__(self, gap: float, tau: float, weight: float, horizon: float):
        self.gap, self.tau, self.weight, self.horizon = round(gap * ONE), tau, weight, horizon
        self.first, self.b = 0, [np.zeros(0), *(np.zeros(0, np.uint64) for _ in range(3))]
        self.at, self.row = 0, np.zeros(0, np.int64)
        self.best, self.cell = 0, (-1, -1)

    def add(self, columns: list[np.ndarray]) -> None:
        """Further events of b: t, low, high, classes."""
        self.b = [np.concatenate([old, new]) for old, new in zip(self.b, columns)]

    def step(self, i: int, bits: tuple[int, int, int], expected: float, lo: int, hi: int) -> bytes:
        """The steps of row i over the band from lo to hi, four to a byte."""
        if lo > self.first:
            self.b, self.first = [c[lo - self.first :] for c in self.b], lo
        t, low, high, classes = (c[lo - self.first : hi - self.first] for c in self.b)
        width = len(t)
        before = np.zeros(width + 1, np.int64)  # the row before, from lo - 1 on
        a, z = max(lo - 1, self.at), min(lo + width, self.at + len(self.row))
        if z > a:
            before[a - lo + 1 : z - lo + 1] = self.row[a - self.at : z - self.at]
        score = scores(bits, low, high, classes, self.tau)
        if expected == expected:
            score = score - np.rint(ONE * self.weight * np.minimum(np.abs(expected - t) / self.horizon, 1.0)).astype(np.int64)
        pair, skip = before[:-1] + score, before[1:] - self.gap
        along = self.gap * np.arange(width)
        row = np.maximum.accumulate(np.maximum(np.maximum(pair, skip), 0) + along) - along
        steps = np.where(row <= 0, _STOP, np.where(pair == row, _PAIR, np.where(skip == row, _SKIP_A, _SKIP_B))).astype(np.uint8)
        self.at, self.row = lo, row
        if width and (top := int(row.argmax())) >= 0 and row[top] > self.best:
            self.best, self.cell = int(row[top]), (i, lo + top)
        steps = np.concatenate([steps, np.zeros(-width % 4, np.uint8)])
        return (steps[0::4] | steps[1::4] << 2 | steps[2::4] << 4 | steps[3::4] << 6).tobytes()


_FORWARD = "pair long, i long, lo long, hi long, size_b long, steps binary, best_i long, best_j long, score long"


def _forward(rows: DataFrame, gap: float, tau: float, weight: float, horizon: float) -> DataFrame:
    names = [c.split()[0] for c in _FORWARD.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.binary()] + [pa.int64()] * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, state, out = None, None, []

        def ended() -> tuple:
            return (pair, _END, 0, 0, 0, None, *state.cell, state.best)

        for batch in batches:
            key, side = batch["pair"].to_numpy(), batch["is_a"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (side[1:] != side[:-1])))
            t = batch["t"].to_numpy(zero_copy_only=False)
            bits = [batch[c].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("low", "high", "classes")]
            n, lo, hi, size = (batch[c].to_numpy(zero_copy_only=False) for c in ("n", "lo", "hi", "size_b"))
            expected = batch["expected"].to_numpy(zero_copy_only=False).astype(np.float64)
            for at, upto in zip(cuts, np.append(cuts[1:], len(key))):
                if pair != key[at]:
                    if state is not None:
                        out.append(ended())
                    pair, state = int(key[at]), Forward(gap, tau, weight, horizon)
                if not side[at]:
                    state.add([t[at:upto], *(c[at:upto] for c in bits)])
                    continue
                for r in range(at, upto):
                    steps = state.step(int(n[r]), tuple(int(c[r]) for c in bits), float(expected[r]), int(lo[r]), int(hi[r]))
                    out.append((pair, int(n[r]), int(lo[r]), int(hi[r]), int(size[r]), steps, None, None, None))
                    if len(out) >= 4096:
                        yield _batch(out, names, kinds)
                        out = []
            if out:
                yield _batch(out, names, kinds)
                out = []
        if state is not None:
            yield _batch([ended()], names, kinds)

    return rows.repartition("pair").sortWithinPartitions("pair", "block", "is_a", "n").mapInArrow(run, _FORWARD)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _backward(steps: DataFrame) -> DataFrame:
    """pair, i, j, edge (events between the way and the nearer edge of the band; null where that is the end of b), score."""
    names, kinds = ["pair", "i", "j", "edge", "score"], [pa.int64()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = j = score = -1
        for batch in batches:
            out = []
            for pair, row, lo, hi, size, packed, best_i, best_j, best in zip(*[c.to_pylist() for c in batch.columns]):
                if row == _END:
                    i, j, score = best_i, best_j, best
                elif row == i and lo <= j < hi:
                    while True:
                        near = [j - lo] if lo else []
                        near += [hi - 1 - j] if hi < size else []
                        step = packed[(j - lo) >> 2] >> 2 * ((j - lo) & 3) & 3 if j >= lo else _STOP
                        if step == _SKIP_B:
                            j -= 1
                            continue
                        if step == _PAIR:
                            out.append((pair, i, j, min(near, default=None), score))
                            j -= 1
                        i = i - 1 if step != _STOP else -1
                        break
            if out:
                yield _batch(out, names, kinds)

    return steps.repartition("pair").sortWithinPartitions("pair", F.desc("i")).mapInArrow(run, "pair long, i long, j long, edge long, score long")


def guides(rows: DataFrame) -> DataFrame:
    """pair, i, j of n-grams of the upper line that stand once in either side. Grams are formed within blocks that reach as far as a gram beyond their end."""
    line = rows.select("pair", "side", "n", "top").where("top IS NOT NULL")
    own = F.floor(F.col("n") / BLOCK)
    line = line.withColumn("block", F.explode(F.when((F.col("n") % BLOCK < GRAM) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))))
    w = Window.partitionBy("pair", "side", "block").orderBy("n")
    gram = F.struct(*[(F.lead("top", k + 1).over(w) - F.lead("top", k).over(w)).alias(f"s{k}") for k in range(GRAM)])
    grams = line.withColumns({"gram": gram, "last": F.lead("n", GRAM).over(w)}).where((F.col("block") == own) & F.col("last").isNotNull())
    once = grams.groupBy("pair", "side", "gram").agg(F.count("*").alias("times"), F.min("n").alias("n")).where("times = 1")
    side = lambda s, name: once.where(F.col("side") == s).select("pair", "gram", F.col("n").alias(name))
    return side("a", "i").join(side("b", "j"), ["pair", "gram"]).select("pair", "i", "j")


def bands(sizes: DataFrame, known: DataFrame, half: Column) -> DataFrame:
    """pair, block, lo, hi, from_b: the events of b that a block of events of a is held against, and from which on they are new to it.

    sizes: pair, size_a, size_b. Pairs with up to WHOLE events of b are held against all; in others a band of half-width `half` runs through the medians of the known (pair, i, j)
    of a block and its neighbours, and from the last known to the next where a block has none.
    """
    blocks = sizes.select("pair", "size_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size_a") - 1) / BLOCK))).alias("block"))
    mids = known.groupBy("pair", F.floor(F.col("i") / BLOCK).alias("block")).agg(F.median("j").alias("mid"))
    rows = blocks.join(mids, ["pair", "block"], "left")
    w = Window.partitionBy("pair").orderBy("block")  # a row per block
    last, following = F.last("mid", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first("mid", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumns({"last": F.coalesce(last, F.lit(0.0)), "next": F.coalesce(following, F.col("size_b").cast("double"))})
    lo = F.greatest(F.lit(0), F.floor(F.least("last", F.coalesce("mid", "last")) - half))
    hi = F.least("size_b", F.ceil(F.greatest("next", F.coalesce("mid", "next")) + half))
    whole = F.col("size_b") <= WHOLE
    rows = rows.select("pair", "block", "size_b", F.when(whole, 0).otherwise(lo).cast("long").alias("lo"), F.when(whole, F.col("size_b")).otherwise(hi).cast("long").alias("hi"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    back = w.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumns({"hi": F.max("hi").over(upto), "lo": F.min("lo").over(back)})  # neither edge goes back
    return rows.withColumn("from_b", F.coalesce(F.lag("hi").over(w), F.lit(0)))


def _once(rows: DataFrame, expected: DataFrame | None, banded: DataFrame, gap: float, tau: float, weight: float, horizon: float) -> DataFrame:
    a = rows.where("side = 'a'").withColumn("block", F.floor(F.col("n") / BLOCK)).join(banded.drop("from_b"), ["pair", "block"])
    a = a.join(expected, ["pair", "n"], "left") if expected is not None else a.withColumn("expected", F.lit(None).cast("double"))
    columns = ["pair", "block", "is_a", "n", "t", "low", "high", "classes", "expected", "lo", "hi", "size_b"]
    slot = F.explode(F.sequence(F.floor(F.col("from_b") / BLOCK), F.floor((F.col("hi") - 1) / BLOCK)))
    fresh = banded.where("hi > from_b").select("pair", "block", "from_b", F.col("hi").alias("upto"), slot.alias("slot"))
    b = rows.where("side = 'b'").withColumn("slot", F.floor(F.col("n") / BLOCK)).join(fresh, ["pair", "slot"]).where("n >= from_b AND n < upto")
    empty = {"expected": F.lit(None).cast("double"), "lo": F.lit(0).cast("long"), "hi": F.lit(0).cast("long"), "size_b": F.lit(0).cast("long")}
    both = a.withColumn("is_a", F.lit(True)).select(*columns).unionByName(b.withColumns({"is_a": F.lit(False), **empty}).select(*columns))
    return _backward(_forward(both, gap, tau, weight, horizon))


def correspond(rows: DataFrame, *, prior: DataFrame | None = None, known: DataFrame | None = None, gap: float = GAP, tau: float = TAU, weight: float = PRIOR, horizon: float = HORIZON, half: int = HALF) -> DataFrame:
    """pair, i, j, t, s, cost, score: the matched events of `indexed` rows. Pairs of which a side is empty, or with fewer than two matches, have none: they share no music.

    prior: pair, n, expected (seconds of b at which the map of a pass before puts event n of a); the penalty grows to `weight` at `horizon` seconds from there. known: pair, i, j that
    guide the band of long pairs; by default n-grams.
    """
    if not 0 < tau <= 1 or gap <= 0:
        raise ValueError("tau must be in (0, 1], gap above 0")
    sizes = rows.groupBy("pair").agg(F.count_if(F.col("side") == "a").alias("size_a"), F.count_if(F.col("side") == "b").alias("size_b")).where("size_a > 0 AND size_b > 0")
    sizes = stored(sizes.withColumn("half", F.lit(half).cast("long")), "sizes")
    long = sizes.where(F.col("size_b") > WHOLE)
    some = not long.isEmpty()
    known = (known if known is not None else guides(rows)).join(long.select("pair"), "pair", "left_semi") if some else rows.sparkSession.createDataFrame([], "pair long, i long, j long")
    known = stored(known, "guides") if some else known
    found, asked, done = None, sizes, []
    while True:
        banded = bands(asked, known, F.lit(half))
        found = stored(_once(rows.join(asked.select("pair"), "pair", "left_semi"), prior, banded, gap, tau, weight, horizon), "matches")
        done.append(found)
        if not some:
            break
        asked = stored(found.groupBy("pair").agg(F.min("edge").alias("edge")).where(F.col("edge") < NEAR).select("pair").join(sizes, "pair").where(F.col("size_b") > half), "touching")
        if asked.isEmpty():
            break
        done[-1] = found.join(asked.select("pair"), "pair", "left_anti")
        half *= 2
    matches = done[0]
    for part in done[1:]:
        matches = matches.unionByName(part)
    a = rows.where("side = 'a'").select("pair", F.col("n").alias("i"), "t", F.col("notes").alias("x"))
    b = rows.where("side = 'b'").select("pair", F.col("n").alias("j"), F.col("t").alias("s"), F.col("notes").alias("y"))
    several = matches.groupBy("pair").agg(F.count("*").alias("m")).where("m >= 2").select("pair")
    matches = matches.join(several, "pair", "left_semi").join(a, ["pair", "i"]).join(b, ["pair", "j"])
    return matches.select("pair", "i", "j", "t", "s", F.round(event_cost(F.col("x"), F.col("y")), 9).alias("cost"), (F.col("score") / ONE).alias("score"))


def expected_times(rows: DataFrame, points: DataFrame) -> DataFrame:
    """pair, n, expected of the events of side a by a map's points (pair, t, phi); beyond its ends the end's value."""
    a = rows.where("side = 'a'").select("pair", "n", "t")
    mapped = warps.at(points, a.select("pair", "t").distinct())
    return a.join(mapped, ["pair", "t"]).select("pair", "n", F.col("phi").alias("expected"))


def alternate(events: DataFrame, smooths: list[float], *, passes: int = 8, gap: float = GAP, tau: float = TAU, weight: float = PRIOR, horizon: float = HORIZON, half: int = HALF, least_slope_part: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(matches, fits): matches as of `correspond`, with pass_, and pair, smooth, refined, first_matched.

    The first pass knows pitches alone, and the smoothness of its map, that of least generalised cross-validation, is kept: chosen later it would be chosen on matches that were made to suit a map.
    Then the map of the last matches is the prior of the next, until no pair's matches change, or `passes` times. A pass that loses matches doesn't count for its pair. Pairs of fewer
    than three matched times are left as they are.
    """
    rows = stored(indexed(events), "events")
    matches = stored(correspond(rows, gap=gap, tau=tau, half=half).withColumn("pass_", F.lit(0)), "pass")
    smooth = stored(warps.smoothness(warps.sweep(matches, smooths, least_slope_part=least_slope_part)), "smooth")
    first = stored(matches.groupBy("pair").agg(F.count("*").alias("first_matched")), "first")
    open_ = smooth
    for number in range(1, passes + 1):
        points = warps.fitted(matches.join(open_, "pair"), least_slope_part=least_slope_part)
        some = rows.join(open_.select("pair"), "pair", "left_semi")
        again = correspond(some, prior=expected_times(some, points), known=matches.select("pair", "i", "j"), gap=gap, tau=tau, weight=weight, horizon=horizon, half=half)
        again = stored(again.withColumn("pass_", F.lit(number)), "pass")
        digest = lambda df, name: df.groupBy("pair").agg(F.count("*").alias(f"n_{name}"), F.sum(F.xxhash64("i", "j").cast("decimal(20,0)")).alias(f"h_{name}"))
        both = digest(matches, "old").join(digest(again, "new"), "pair")
        better = stored(both.where("n_new >= n_old AND (n_new <> n_old OR h_new <> h_old)").select("pair"), "better")
        if better.isEmpty():
            break
        matches = stored(matches.join(better, "pair", "left_anti").unionByName(again.join(better, "pair", "left_semi")), "pass")
        open_ = open_.join(better, "pair", "left_semi")
    refined = matches.groupBy("pair").agg((F.max("pass_") > 0).alias("refined"))
    return matches, first.join(smooth, "pair", "left").join(refined, "pair").select("pair", "smooth", "refined", "first_matched")


def census(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """A row of counts for each pair with matches: every event and note of either side of `indexed` rows, matched, left out within the core, or outside of it.

    The core reaches from the first match to the last. exact_pairs: those that cost nothing.
    """
    held = rows.select("pair", "side", "n", "t", F.size("notes").cast("long").alias("notes"))
    core = matches.groupBy("pair").agg(
        F.min("i").alias("a0"), F.max("i").alias("a1"), F.min("j").alias("b0"), F.max("j").alias("b1"), F.count("*").alias("matched"), F.count_if(F.col("cost") == 0).alias("exact_pairs"), F.round(F.avg("cost"), 6).alias("mean_pair_cost"),
        F.min("t").alias("core_start_a"), F.max("t").alias("core_end_a"), F.min("s").alias("core_start_b"), F.max("s").alias("core_end_b"),
    )
    out = core
    for side, place in (("a", "i"), ("b", "j")):
        own = held.where(F.col("side") == side)
        inside = F.col("n").between(F.col(f"{side}0"), F.col(f"{side}1"))
        mine = own.join(core.select("pair", f"{side}0", f"{side}1"), "pair").join(matches.select("pair", F.col(place).alias("n"), F.lit(True).alias("hit")), ["pair", "n"], "left")
        out = out.join(mine.groupBy("pair").agg(
            F.count("*").alias(f"events_{side}"), F.sum("notes").alias(f"notes_{side}"), F.sum(F.when(F.col("hit"), F.col("notes")).otherwise(0)).alias(f"matched_notes_{side}"),
            F.count_if(inside).alias(f"core_events_{side}"), F.sum(F.when(inside, F.col("notes")).otherwise(0)).alias(f"core_notes_{side}"), F.count_if(inside & F.col("hit").isNull()).alias(f"left_out_{side}"),
        ), "pair")
    n = F.col
    rate = lambda over: F.round(n("matched") / F.greatest(n(over), F.lit(1)), 6)
    return out.select(
        "pair", "events_a", "events_b", "notes_a", "notes_b", "matched", "matched_notes_a", "matched_notes_b", "exact_pairs", "mean_pair_cost", "core_events_a", "core_events_b", "core_notes_a", "core_notes_b",
        "core_start_a", "core_end_a", "core_start_b", "core_end_b", n("left_out_a").alias("dropped_in_core_a"), n("left_out_b").alias("added_in_core_b"), n("a0").alias("head_a"), (n("events_a") - 1 - n("a1")).alias("tail_a"),
        n("b0").alias("head_b"), (n("events_b") - 1 - n("b1")).alias("tail_b"), (n("events_a") - n("core_events_a")).alias("outside_core_a"), (n("events_b") - n("core_events_b")).alias("outside_core_b"),
        (n("notes_a") - n("core_notes_a")).alias("outside_core_notes_a"), (n("notes_b") - n("core_notes_b")).alias("outside_core_notes_b"), rate("events_a").alias("match_rate_a"), rate("core_events_a").alias("match_rate_core_a"), rate("core_events_b").alias("match_rate_core_b"),
    )
