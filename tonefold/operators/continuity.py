"""How fast sums of weighted intervals rise, what a damper takes from them, and which intervals hold messages inside."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.notes import pedal_contact
from ..sources.streams import PEDAL
from .intervals import SWEEP_NS, cumulative
from .running import running

#: Fixed value: the exponent of continuity of the Cantor function.
CANTOR = math.log(2) / math.log(3)
#: Contact is counted in millionths, so that sums are exact whatever their order.
MICRO = 1_000_000


def steepest(df: DataFrame, key: str) -> DataFrame:
    """key, slope: the highest sum of weights of intervals (key, a, b, weight) that hold at once."""
    jumps = df.select(key, F.col("a").alias("t"), F.col("weight").alias("w")).unionByName(df.select(key, F.col("b").alias("t"), (-F.col("weight")).alias("w")))
    jumps = jumps.groupBy(key, "t").agg(F.sum("w").alias("w"))
    return running(jumps, [key], ["t"], F.floor(F.col("t") / SWEEP_NS), sums={"level": "w"}).groupBy(key).agg(F.max("level").alias("slope"))


def modulus(df: DataFrame, spans: DataFrame, key: str, widths: tuple[int, ...]) -> DataFrame:
    """key, width, omega, lipschitz, cantor: the modulus of continuity of the integral F of the weighted indicators, as parts of F's whole.

    omega is the greatest F(t + width) - F(t) within the span (key, start, stop). F is piecewise linear, so it is reached where t or t + width is
    an end of an interval or of the span: candidates are twice the ends per width. lipschitz is the bound by the steepest slope, cantor the
    modulus that the Cantor function would have. Widths not below the span are left out, and so are keys without weight.
    """
    wide = F.explode(F.array(*[F.lit(w).cast("long") for w in widths])).alias("width")
    ends = df.select(key, F.explode(F.array("a", "b")).alias("e")).distinct().join(spans, key)
    ends = ends.unionByName(spans.select(key, F.explode(F.array("start", "stop")).alias("e"), "start", "stop"))
    tried = ends.select(key, "start", "stop", "e", wide).select(key, "width", "start", "stop", F.explode(F.array(F.col("e"), F.col("e") - F.col("width"))).alias("t"))
    tried = tried.where("width < stop - start AND t >= start AND t <= stop - width").select(key, "width", "t").distinct()
    f = cumulative(df, tried.select(key, "t").unionByName(tried.select(key, (F.col("t") + F.col("width")).alias("t"))), key)
    low, high = f.select(key, "t", F.col("f").alias("low")), f.select(key, F.col("t").alias("u"), F.col("f").alias("high"))
    rises = tried.withColumn("u", F.col("t") + F.col("width")).join(low, [key, "t"]).join(high, [key, "u"])
    rises = rises.groupBy(key, "width").agg(F.max(F.col("high") - F.col("low")).alias("rise"))
    whole = df.groupBy(key).agg(F.sum(F.col("weight") * (F.col("b") - F.col("a"))).alias("whole")).where("whole > 0")
    found = rises.join(whole, key).join(steepest(df, key), key).join(spans, key)
    return found.select(
        key, "width", (F.col("rise") / F.col("whole")).alias("omega"), (F.col("slope") * F.col("width").cast("double") / F.col("whole")).alias("lipschitz"),
        F.pow(F.col("width") / (F.col("stop") - F.col("start")), F.lit(CANTOR)).alias("cantor"),
    )


def damper_integral(messages: DataFrame, *, bite: float = 0.35, tail_ns: int = 60_000_000_000) -> DataFrame:
    """take, ns, contact, dwell, landings, integral at the beginning of a take, wherever its pedal has a new value, and `tail_ns` after its end.

    contact holds from ns on, in [0, 1]; of values at one time the last counts, and before the first the pedal is up. dwell is the integral of contact up to ns
    in seconds; a landing is contact coming to a half or more from below, or being there from the beginning. integral = dwell + bite * landings before ns.
    """
    spans = messages.groupBy("take").agg(F.min("ns").alias("start"), F.max("ns").alias("stop"))
    edge = lambda at: spans.select("take", at.alias("ns"), F.lit(0).alias("given"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("value"))
    turns = messages.where((F.col("kind") == "control") & (F.col("note") == PEDAL)).select("take", "ns", F.lit(1).alias("given"), "seq", F.col("velocity").alias("value"))
    turns = turns.unionByName(edge(F.col("start"))).unionByName(edge(F.col("stop") + tail_ns))
    turns = turns.groupBy("take", "ns").agg(F.max_by("value", F.struct("given", "seq")).alias("value"))
    turns = turns.withColumn("micro", F.round(pedal_contact(F.col("value")) * MICRO).cast("long"))
    bucket = F.floor(F.col("ns") / SWEEP_NS)
    turns = running(turns, ["take"], ["ns"], bucket, following={"until": "ns"}, previous={"was": "micro"})
    spent = F.col("micro").cast("decimal(7,0)") * F.floor((F.coalesce("until", "ns") - F.col("ns")) / 1000).cast("decimal(19,0)")
    landing = (F.col("micro") >= MICRO // 2) & (F.coalesce("was", F.lit(0)) < MICRO // 2)
    turns = turns.withColumns({"spent": spent, "landing": landing.cast("long")})
    turns = running(turns, ["take"], ["ns"], bucket, sums={"all_spent": "spent", "all_landings": "landing"})
    dwell = (F.col("all_spent") - F.col("spent")).cast("double") / (MICRO * MICRO)
    landings = F.col("all_landings") - F.col("landing")
    return turns.select("take", "ns", (F.col("micro") / MICRO).alias("contact"), dwell.alias("dwell"), landings.alias("landings"), (dwell + bite * landings).alias("integral"))


def held_messages(intervals: DataFrame, messages: DataFrame) -> DataFrame:
    """intervals (take, on_seq, ns_on, ns_off) with inside: whether any of the messages (take, ns) falls strictly between both.

    The last message before an interval's end decides, so one pass over each stretch of time does, however many intervals hold at once.
    """
    kept = ["take", "on_seq", "ns_on", "ns_off"]
    none = lambda c: F.lit(None).cast("long").alias(c)
    stops = intervals.select(*kept, F.col("ns_off").alias("ns"), F.lit(0).alias("turn"), none("at"))
    marks = messages.select("take", none("on_seq"), none("ns_on"), none("ns_off"), "ns", F.lit(1).alias("turn"), F.col("ns").alias("at"))
    both = running(stops.unionByName(marks), ["take"], ["ns", "turn"], F.floor(F.col("ns") / SWEEP_NS), highest={"last": "at"})
    return both.where("turn = 0").select(*kept, F.coalesce(F.col("last") > F.col("ns_on"), F.lit(False)).alias("inside"))
