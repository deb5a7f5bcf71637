"""Interval algebra: unions, complements, levels, and measures of weighted intervals (take, a, b, weight)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.streams import PEDAL
from .running import running, running_sum

#: Width of the buckets in which levels are swept; messages of a bucket in which neighbours are sought.
SWEEP_NS = 86_400 * 1_000_000_000
BUCKET = 1 << 16


def merge(df: DataFrame, keys: list[str], *, bucket_ns: int = SWEEP_NS) -> DataFrame:
    """keys, a, b: the union of closed intervals; intervals that touch become one. A task holds the intervals of a bucket of time, not of a key."""
    bucket = F.floor(F.col("a") / bucket_ns)
    reached = running(df, keys, ["a", "b"], bucket, highest={"_reach": "b"})
    fresh = reached.withColumn("_new", (F.col("_reach").isNull() | (F.col("a") > F.col("_reach"))).cast("int"))
    return running(fresh, keys, ["a", "b"], bucket, sums={"_island": "_new"}).groupBy(*keys, "_island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_island")


def measure(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, islands: length and number of the intervals of a union."""
    return df.groupBy(*keys).agg(F.sum(F.col("b") - F.col("a")).alias("measure"), F.count("*").alias("islands"))


def plateaus(union: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """key, a, b: what a union leaves free of the span (start, stop) of its key."""
    edges = union.select(key, "a", "b").unionByName(spans.select(key, F.col("start").alias("a"), F.col("start").alias("b"))).unionByName(spans.select(key, F.col("stop").alias("a"), F.col("stop").alias("b")))
    rows = running(edges, [key], ["a", "b"], F.floor(F.col("a") / SWEEP_NS), highest={"_before": "b"}, following={"_next": "a"})
    return rows.select(key, F.greatest("_before", "b").alias("a"), F.col("_next").alias("b")).where("b > a")


def jump_measure(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t, mass: jumps of the sum of weighted indicators, those that cancel left out."""
    up = df.where("b > a").select(*keys, F.col("a").alias("t"), F.col("weight").alias("mass"))
    down = df.where("b > a").select(*keys, F.col("b").alias("t"), (-F.col("weight")).alias("mass"))
    return up.unionByName(down).groupBy(*keys, "t").agg(F.sum("mass").alias("mass")).where("mass <> 0")


def variation(jumps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, l1, l2, linf: total variation of a vector of keys' functions, by the norm taken at each instant. jumps have a component."""
    at = jumps.groupBy(*keys, "t").agg(F.sum(F.abs("mass")).alias("l1"), F.sqrt(F.sum(F.col("mass") * F.col("mass"))).alias("l2"), F.max(F.abs("mass")).alias("linf"))
    return at.groupBy(*keys).agg(F.sum("l1").alias("l1"), F.round(F.sum("l2"), 4).alias("l2"), F.sum("linf").alias("linf"))


def energy(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col("weight") * (F.col("b") - F.col("a"))).alias("energy"))


def cumulative(df: DataFrame, at: DataFrame, key: str) -> DataFrame:
    """key, t, f: the integral up to t of the sum of weighted indicators, for the instants of at (key, t).

    Linear in the rows: f(t) = t * W(t) - V(t), with the running sums of weights and of weights times place over the jumps.
    """
    jumps = df.select(key, F.col("a").alias("t"), F.col("weight").cast("decimal(38,0)").alias("w")).unionByName(df.select(key, F.col("b").alias("t"), (-F.col("weight")).cast("decimal(38,0)").alias("w")))
    jumps = jumps.groupBy(key, "t").agg(F.sum("w").alias("w")).select(key, "t", F.col("w").cast("decimal(18,0)").alias("w"), F.lit(0).alias("asked"))
    both = jumps.unionByName(at.select(key, "t").distinct().select(key, "t", F.lit(0).cast("decimal(18,0)").alias("w"), F.lit(1).alias("asked")))
    both = both.withColumn("wt", (F.col("w") * F.col("t").cast("decimal(20,0)")))
    both = running(both, [key], ["t", "asked"], F.floor(F.col("t") / SWEEP_NS), sums={"slope": "w", "spent": "wt"})
    f = F.col("t").cast("decimal(20,0)") * F.col("slope").cast("decimal(18,0)") - F.col("spent")
    return both.where("asked = 1").select(key, "t", f.cast("long").alias("f"))


def levels(df: DataFrame, key: str, *, spans: DataFrame | None = None, bucket_ns: int = SWEEP_NS) -> DataFrame:
    """key, t, level, until, turns: how many of the half-open intervals hold from t to until; simultaneous changes are one, and turns tells if there is any.

    With spans (key, start, stop) levels also hold from a key's start and to its stop, before the first interval and after the last.
    """
    move = lambda at, by: df.select(key, F.col(at).alias("t"), F.lit(by).alias("move"), F.lit(1).alias("turns"))
    moves = move("a", 1).unionByName(move("b", -1))
    for at in ("start", "stop") if spans is not None else ():
        moves = moves.unionByName(spans.select(key, F.col(at).alias("t"), F.lit(0).alias("move"), F.lit(0).alias("turns")))
    moves = moves.groupBy(key, "t").agg(F.sum("move").alias("move"), F.max("turns").alias("turns"))
    found = running(moves, [key], ["t"], F.floor(F.col("t") / bucket_ns), sums={"level": "move"}, following={"until": "t"})
    return found.select(key, "t", "level", "until", "turns")


def dwell(levels: DataFrame, key: str) -> DataFrame:
    """key, level, dwell, fraction (of all its levels' dwell), spans (how often the level is come to)."""
    spent = levels.groupBy(key, "level").agg(F.sum(F.coalesce(F.col("until") - F.col("t"), F.lit(0))).alias("dwell"), F.sum("turns").cast("long").alias("spans"))
    total = F.sum("dwell").over(Window.partitionBy(key))  # a row per level
    return spent.withColumn("fraction", F.round(F.coalesce(F.try_divide(F.col("dwell"), total), F.lit(0.0)), 6))


def closed_peak(df: DataFrame, key: str) -> DataFrame:
    """key, peak: most closed intervals that hold at one instant; beginnings come before ends."""
    moves = df.select(key, F.col("a").alias("t"), F.lit(0).alias("turn"), F.lit(1).alias("move")).unionByName(df.select(key, F.col("b").alias("t"), F.lit(1).alias("turn"), F.lit(-1).alias("move")))
    moves = moves.groupBy(key, "t", "turn").agg(F.sum("move").alias("move"))
    moves = running_sum(moves, [key], ["t", "turn"], "move", "level", F.floor(F.col("t") / SWEEP_NS))
    return moves.groupBy(key).agg(F.max("level").alias("peak"))


def overlaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, next_a: intervals that the next one of their keys begins inside of."""
    return df.withColumn("next_a", F.lead("a").over(Window.partitionBy(*keys).orderBy("a", "b"))).where("next_a < b").select(*keys, "a", "b", "next_a")


def pedal_spans(messages: DataFrame, *, down: int = 64) -> DataFrame:
    """take, a, b: stretches with the pedal down (values of its controller from `down` on), closed by the take's end."""
    bucket = F.floor(F.col("seq") / BUCKET)
    pedal = messages.where((F.col("kind") == "control") & (F.col("note") == PEDAL)).select("take", "seq", "ns", (F.col("velocity") >= down).alias("is_down"))
    turns = running(pedal, ["take"], ["seq"], bucket, previous={"was": "is_down"}).where(F.col("is_down") != F.coalesce("was", F.lit(False)))
    turns = running(turns, ["take"], ["seq"], bucket, following={"then": "ns"}).where("is_down").select("take", "ns", "then")
    ends = messages.groupBy("take").agg(F.max("ns").alias("end_ns"))
    return turns.join(ends, "take").select("take", F.col("ns").alias("a"), F.coalesce("then", "end_ns").alias("b"))


def sustained(notes: DataFrame, spans: DataFrame, *, slot_ns: int = SWEEP_NS) -> DataFrame:
    """notes (take, note, a, b, weight) with held: b moved to the end of the pedal span that holds it, but not past the key's next onset.

    Spans are disjoint, so at most one holds b. The range join meets in time slots: a span stands in each slot it touches.
    """
    slotted = spans.withColumn("slot", F.explode(F.sequence(F.floor(F.col("a") / slot_ns), F.floor(F.col("b") / slot_ns)))).select(F.col("take").alias("p_take"), "slot", F.col("a").alias("p_a"), F.col("b").alias("p_b"))
    onset = F.lead("a").over(Window.partitionBy("take", "note").orderBy("a", "b"))
    notes = notes.withColumns({"next_a": onset, "n_slot": F.floor(F.col("b") / slot_ns)})
    inside = (F.col("take") == F.col("p_take")) & (F.col("n_slot") == F.col("slot")) & (F.col("p_a") <= F.col("b")) & (F.col("b") < F.col("p_b"))
    held = F.greatest("b", F.least(F.coalesce("p_b", "b"), F.coalesce("next_a", "p_b", "b")))
    return notes.join(slotted, inside, "left").select("take", "note", "a", "b", "weight", held.alias("held"))
