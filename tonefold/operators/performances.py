"""Performances from messages: the repairs a reader asks for, readings at instants, and what a take's files say of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.streams import PEDAL
from . import integrity, intervals, pairing
from .running import running

#: Notes of a keyboard.
LOWEST, HIGHEST = 21, 108
#: Candidate steps of a timing grid, longest first, in nanoseconds.
STEPS = (10_000_000, 5_000_000, 2_000_000, 1_000_000, 500_000, 100_000, 10_000, 1_000, 1)


def perform(messages: DataFrame, *, orphans: str = "truncate", retriggers: str = "truncate", beyond: str = "drop") -> DataFrame:
    """take, note, ns_on, ns_off, velocity, closure of the notes of each take.

    orphans: what a note open at the end becomes: `truncate` (it ends with the take), `drop`, or `raise`. retriggers: a note struck while it sounds:
    `truncate` (it ends there) or `raise`. beyond: a note outside the keyboard: `drop` or `raise`. To raise is an error of the job that reads the result.
    """
    for name, value, known in (("orphans", orphans, ("truncate", "drop", "raise")), ("retriggers", retriggers, ("truncate", "raise")), ("beyond", beyond, ("drop", "raise"))):
        if value not in known:
            raise ValueError(f"{name} must be one of {known}")
    outside = ~F.col("note").between(LOWEST, HIGHEST)
    found = pairing.intervals(messages)
    refuse = lambda when, what: F.when(when, F.raise_error(F.format_string(f"take %s, note %d: {what}", F.col("take").cast("string"), "note"))).otherwise(True)
    found = found.where(refuse(outside, "outside the keyboard") if beyond == "raise" else ~outside)
    for policy, closure in ((orphans, "end_of_take"), (retriggers, "restrike")):
        if policy == "raise":
            found = found.where(refuse(F.col("closure") == closure, closure))
        elif policy == "drop":
            found = found.where(F.col("closure") != closure)
    return found.select("take", "note", "ns_on", "ns_off", F.col("velocity_on").alias("velocity"), "closure")


def repairs(messages: DataFrame) -> DataFrame:
    """take, strikes, orphan_offs, retriggers, orphan_ons, out_of_range, pedal_events, pedal_open, clean: what `perform` had to repair, and whether it was nothing."""
    inside = F.col("note").between(LOWEST, HIGHEST)
    roles = pairing.roles(messages).join(messages.select("take", "seq", "note"), ["take", "seq"])
    counts = roles.groupBy("take").agg(
        F.count_if(F.col("role") == "pedal").alias("pedal_events"), F.count_if((F.col("role") == "orphan_note_off") & inside).alias("orphan_offs"), F.count_if(F.col("role").isin("interval_on", "interval_off", "orphan_note_off") & ~inside).alias("out_of_range")
    )
    closed = pairing.intervals(messages).where(inside).groupBy("take").agg(F.count("*").alias("strikes"), F.count_if(F.col("closure") == "restrike").alias("retriggers"), F.count_if(F.col("closure") == "end_of_take").alias("orphan_ons"))
    last = messages.where((F.col("kind") == "control") & (F.col("note") == PEDAL)).groupBy("take").agg((F.max_by("velocity", "seq") >= 64).cast("int").alias("pedal_open"))
    out = counts.join(closed, "take", "left").join(last, "take", "left").fillna(0)
    names = ["orphan_offs", "retriggers", "orphan_ons", "out_of_range", "pedal_open"]
    clean = sum(F.col(c) for c in names) == 0
    return out.select("take", "strikes", "orphan_offs", "retriggers", "orphan_ons", "out_of_range", "pedal_events", "pedal_open", clean.alias("clean"))


def take_spans(messages: DataFrame) -> DataFrame:
    """take, messages, packets (different times), first_ns, last_ns, length_ns, ons, open_notes, accounted: whether each message has one role."""
    roles = pairing.roles(messages).groupBy("take").agg(F.count("*").alias("with_role"))
    held = pairing.intervals(messages).where("closure = 'end_of_take'").groupBy("take").agg(F.count("*").alias("open_notes"))
    whole = messages.groupBy("take").agg(F.count("*").alias("messages"), F.count_distinct("ns").alias("packets"), F.min("ns").alias("first_ns"), F.max("ns").alias("last_ns"), F.count_if(F.expr("kind = 'note_on'")).alias("ons"))
    out = whole.join(roles, "take").join(held, "take", "left").fillna(0, ["open_notes"])
    return out.select("take", "messages", "packets", "first_ns", "last_ns", (F.col("last_ns") - F.col("first_ns")).alias("length_ns"), "ons", "open_notes", (F.col("with_role") == F.col("messages")).alias("accounted"))


def as_of(df: DataFrame, at: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column) -> DataFrame:
    """at with `value` of the last row of df before or at the same place in order; null if there is none. Both have keys and order; of df's rows at one place the highest value counts.

    bucket must not decrease along the order; what is known is carried over buckets by a row for each, so no task holds a key.
    """
    known = F.struct(*order, F.col(value).alias("_value"))
    rows = df.select(*keys, *order, known.alias("_known"), F.lit(0).alias("_asked")).unionByName(at.select(*keys, *order, F.lit(1).alias("_asked")), allowMissingColumns=True)
    found = running(rows, keys, [*order, "_asked"], bucket, highest={"_last": "_known"})
    return found.where("_asked = 1").select(*keys, *order, F.col("_last._value").alias(value))


def pedal_in(messages: DataFrame, windows: DataFrame) -> DataFrame:
    """take, t, value: the pedal's values within each take's window (start, stop), and at its start the one carried in if that is down and none stands there."""
    pedal = messages.where((F.col("kind") == "control") & (F.col("note") == PEDAL)).select("take", F.col("ns").alias("t"), F.col("velocity").alias("value"), "seq").join(windows, "take")
    inside = pedal.where("t BETWEEN start AND stop").select("take", "t", "value", "seq")
    before = pedal.where("t < start").groupBy("take", F.col("start").alias("t")).agg(F.max_by("value", F.struct("t", "seq")).alias("value")).where("value >= 64")
    carried = before.join(inside.select("take", "t"), ["take", "t"], "left_anti")
    return inside.select("take", "t", "value").unionByName(carried.select("take", "t", "value"))


def pressed_at(messages: DataFrame) -> DataFrame:
    """take, seq, down: at each strike, whether the pedal is down."""
    pedal = messages.where((F.col("kind") == "control") & (F.col("note") == PEDAL)).withColumn("down", F.col("velocity") >= 64)
    found = as_of(pedal, messages.where("kind = 'note_on'"), ["take"], ["seq"], "down", F.floor(F.col("seq") / intervals.BUCKET))
    return found.select("take", "seq", F.coalesce("down", F.lit(False)).alias("down"))


def measures(weighted: DataFrame, spans: DataFrame) -> DataFrame:
    """take, support, length, duty, islands, plateaus, plateau_measure, key_support, energy: readings of the weighted intervals of a take within its span."""
    union = intervals.merge(weighted, ["take"])
    whole = intervals.measure(union, ["take"]).withColumnRenamed("measure", "support")
    free = intervals.plateaus(union, spans, "take").groupBy("take").agg(F.count("*").alias("plateaus"), F.sum(F.col("b") - F.col("a")).alias("plateau_measure"))
    keys = intervals.measure(intervals.merge(weighted, ["take", "note"]), ["take", "note"]).groupBy("take").agg(F.sum("measure").alias("key_support"))
    energy = weighted.groupBy("take").agg(F.sum(F.col("weight") * F.floor((F.col("b") - F.col("a")) / 1000)).alias("energy"))
    out = spans.select("take", (F.col("stop") - F.col("start")).alias("length")).join(whole, "take").join(keys, "take").join(energy, "take").join(free, "take", "left").fillna(0, ["plateaus", "plateau_measure"])
    return out.select("take", "support", "length", F.round(F.try_divide("support", "length"), 6).alias("duty"), "islands", "plateaus", "plateau_measure", "key_support", "energy")


def grid_step(messages: DataFrame) -> DataFrame:
    """take, step, gaps, off: the longest candidate step that at least 99 of 100 positive gaps are multiples of, and how many gaps aren't. One pass for all candidates."""
    gaps = integrity.gaps(messages).where("gap > 0")
    hits = [F.count_if(F.col("gap") % s == 0).alias(f"h{i}") for i, s in enumerate(STEPS)]
    found = gaps.groupBy("take").agg(F.count("*").alias("gaps"), *hits)
    step, off = F.lit(1).cast("long"), F.lit(0).cast("long")
    for i, s in reversed(list(enumerate(STEPS))):
        good = 100 * F.col(f"h{i}") >= 99 * F.col("gaps")
        step, off = F.when(good, s).otherwise(step), F.when(good, F.col("gaps") - F.col(f"h{i}")).otherwise(off)
    return found.select("take", step.cast("long").alias("step"), "gaps", off.alias("off"))


def verdict(messages: DataFrame, *, trusted: Column | None = None) -> DataFrame:
    """take, verdict: EMPTY, SUSPECT with reasons, or GOOD with readings, from losses, balance, grid and what is open; the grid counts where timing is `trusted`."""
    trusted = F.lit(True) if trusted is None else trusted
    loss = integrity.losses(messages).drop("verdict")
    grid = integrity.lattice(messages).select("take", "fraction", "off_runs", "restored")
    long = pairing.defects(messages).where("cls = 'implausible_duration'").groupBy("take").agg(F.count("*").alias("long"))
    rows = loss.join(grid, "take", "left").join(long, "take", "left").fillna(0, ["off_runs", "restored", "long"]).fillna(1.0, ["fraction"])
    text = lambda form, *columns: F.format_string(form, *columns)
    bad = [
        F.when(F.col("inferred_lost") > 0, text("%d messages inferred lost", "inferred_lost")).when(F.col("balance") != F.col("held"), text("balance %d with %d keys held", "balance", "held")),
        F.when(trusted & (F.col("off_runs") > F.col("restored")), "grid phase slipped"),
    ]
    soft = [F.when(~trusted, "timing not usable"), F.when(F.col("held") > 0, text("%d keys down at the end", "held")), F.when(F.col("long") > 0, text("%d implausibly long", "long"))]
    good = text("GOOD: %d ons and %d releases, %.1f per cent on the grid", "ons", "offs", F.col("fraction") * 100)
    reasons = F.concat_ws("; ", *bad)
    full = F.when(reasons != "", F.concat(F.lit("SUSPECT: "), F.concat_ws("; ", *bad, *soft))).otherwise(F.concat_ws("; ", good, *soft))
    return rows.select("take", F.when(F.col("messages") == 0, "EMPTY").otherwise(full).alias("verdict"))
