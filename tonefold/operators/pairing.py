"""Pairing on and off messages to intervals, with a role for every message and a defect for every repair.

Per take and key, in order of seq: an on is closed by the key's next note message, an off (closure note_off) or another on
(restrike); what is open at the end closes at the take's last time (end_of_take). An off with no open on is an orphan. Everything follows
from the neighbours of a message among the note messages of its key, so the windows are as narrow as a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..sources.streams import PEDAL
from .running import running

#: Messages of a bucket in which a running maximum is found.
BUCKET = 1 << 16
#: An interval at least so long is implausible, unless the end of the take closed it.
IMPLAUSIBLE_NS = 30 * 1_000_000_000
DEFECTS = ("orphan_note_off", "restrike", "end_of_take", "non_monotone_timestamp", "implausible_duration", "undecodable")


def neighbours(messages: DataFrame) -> DataFrame:
    """Note messages with the kind before, and kind, seq, ns and velocity after, of the same take and key."""
    notes = messages.where(F.col("kind").isin("note_on", "note_off"))
    key = Window.partitionBy("take", "note").orderBy("seq")
    after = {f"next_{c}": F.lead(c).over(key) for c in ("kind", "seq", "ns", "velocity")}
    return notes.withColumns({"previous_kind": F.lag("kind").over(key), **after})


def intervals(messages: DataFrame) -> DataFrame:
    """take, note, on_seq, off_seq, ns_on, ns_off, velocity_on, velocity_off, closure, trusted. ns_off is never before ns_on."""
    ends = messages.groupBy("take").agg(F.max("ns").alias("end_ns"))
    ons = neighbours(messages).where("kind = 'note_on'").join(ends, "take")
    closure = F.when(F.col("next_kind") == "note_off", "note_off").when(F.col("next_kind") == "note_on", "restrike").otherwise("end_of_take")
    return ons.select(
        "take", "note", F.col("seq").alias("on_seq"), F.when(closure == "note_off", F.col("next_seq")).alias("off_seq"), F.col("ns").alias("ns_on"),
        F.greatest("ns", F.coalesce("next_ns", "end_ns")).alias("ns_off"), F.col("velocity").alias("velocity_on"),
        F.when(closure == "note_off", F.col("next_velocity")).alias("velocity_off"), closure.alias("closure"), (closure == "note_off").alias("trusted"),
    )


def roles(messages: DataFrame) -> DataFrame:
    """take, seq, role: one role for each message."""
    notes = neighbours(messages).select("take", "seq", F.when(F.col("kind") == "note_on", "interval_on").when(F.col("previous_kind") == "note_on", "interval_off").otherwise("orphan_note_off").alias("role"))
    rest = messages.where(~F.col("kind").isin("note_on", "note_off"))
    return notes.unionByName(rest.select("take", "seq", F.when((F.col("kind") == "control") & (F.col("note") == PEDAL), "pedal").when(F.col("kind").isin("control", "undecodable"), F.col("kind")).otherwise("other").alias("role")))


def defects(messages: DataFrame) -> DataFrame:
    """take, seq, cls: each message or interval that needed a repair; restrikes count once, at the on that closes."""
    paired = intervals(messages)
    reached = running(messages.select("take", "seq", "ns"), ["take"], ["seq"], F.floor(F.col("seq") / BUCKET), highest={"reached": "ns"})
    backwards = reached.where("ns < reached").select("take", "seq", F.lit("non_monotone_timestamp").alias("cls"))
    orphans = roles(messages).where("role = 'orphan_note_off'").select("take", "seq", F.col("role").alias("cls"))
    closed = paired.where("closure <> 'note_off'").select("take", F.col("on_seq").alias("seq"), F.col("closure").alias("cls"))
    long = paired.where((F.col("closure") != "end_of_take") & (F.col("ns_off") - F.col("ns_on") >= IMPLAUSIBLE_NS)).select("take", F.col("on_seq").alias("seq"), F.lit("implausible_duration").alias("cls"))
    unread = messages.where("kind = 'undecodable'").select("take", "seq", F.col("kind").alias("cls"))
    return backwards.unionByName(orphans).unionByName(closed).unionByName(long).unionByName(unread)


def defect_counts(messages: DataFrame) -> DataFrame:
    """cls, n for every class, with zeros."""
    spark = messages.sparkSession
    classes = spark.createDataFrame([(c,) for c in DEFECTS], "cls string")
    return classes.join(defects(messages).groupBy("cls").count(), "cls", "left").select("cls", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def overwriting_pairs(messages: DataFrame) -> DataFrame:
    """The pairing that keeps the last of several ons before an off: take, note, ns_on, ns_off, velocity_on, velocity_off."""
    on = neighbours(messages).where("kind = 'note_on' AND next_kind = 'note_off'")
    return on.select("take", "note", F.col("ns").alias("ns_on"), F.col("next_ns").alias("ns_off"), F.col("velocity").alias("velocity_on"), F.col("next_velocity").alias("velocity_off"))
