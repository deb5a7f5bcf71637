"""Stored takes that grow: each ingest reads what is new, pairs it with what was held open, and commits messages, roles, intervals and defects together.

What is stored after any cuts is what one reading of the whole take stores. Only the end of a take closes its open notes. A take whose
source was rewritten or cut short is read again from its start, as another run; readers see the last run alone.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sources import capture, takes
from ..sources.stored import stored
from . import framing, pairing
from .running import running

#: Bytes at a capture's beginning by which it is known again.
HEAD = 4096
#: Messages of a bucket in which a running maximum is found.
BUCKET = 1 << 16


def _raw(spark: SparkSession, path: str, table: str) -> DataFrame:
    takes.register(spark)
    return spark.read.format("takes").option("path", path).option("table", table).load()


def progress(spark: SparkSession, path: str) -> DataFrame:
    """A row for each take: how far it is stored, by the last commit that touched it."""
    last = _raw(spark, path, "progress").groupBy("take").agg(F.max_by(F.struct("run", "version", *[c.split()[0] for c in takes.TABLES["progress"].split(", ")]), "version").alias("p"))
    return last.select("take", "p.*")


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table, of each take's last run. Of `held` the open notes after the last commit."""
    rows = _raw(spark, path, name)
    if name == "progress":
        return progress(spark, path)
    now = progress(spark, path).select("take", "run", *(["version"] if name == "held" else []))
    return rows.join(now, now.columns, "left_semi")


def _entries(df: DataFrame, name: str) -> DataFrame:
    kinds = {c: k for c, k in (x.split(" ") for x in takes.schema(takes.ENTRY).replace("`", "").split(", "))}
    own = takes.columns(name)
    return df.select(F.lit(name).alias("table"), *[(F.col(c) if c in own else F.lit(None)).cast(kinds[c]).alias(c) for c in takes.ENTRY if c != "table"])


def store(messages: DataFrame, now: DataFrame, path: str, *, commit: str | None = None) -> None:
    """Commits new messages (take, seq, ns, kind, note, velocity) of takes, whose seq go on from what is stored.

    now: a row for each take that is to have one: take, and where known path, byte_offset, digest, complete (the take has ended), reason (why it is read from its start again; empty: it is
    not, and an unknown take begins). A commit of the same name is made once.
    """
    spark = messages.sparkSession
    known = progress(spark, path).select("take", F.col("run").alias("was_run"), F.col("version").alias("was"), F.col("messages").alias("was_messages"), F.col("last_ns").alias("was_ns"), F.col("complete").alias("was_complete"))
    have = set(now.columns)
    optional = [(F.col(c) if c in have else F.lit(None)).cast(k).alias(c) for c, k in (("path", "string"), ("byte_offset", "long"), ("digest", "string"), ("complete", "boolean"), ("reason", "string"))]
    state = now.select("take", *optional).join(known, "take", "left").withColumns({"reason": F.coalesce("reason", F.lit("")), "complete": F.coalesce("complete", F.lit(False))})
    again = F.col("was_run").isNull() | (F.col("reason") != "")
    state = state.select(
        "take", F.when(F.col("was_run").isNull(), 0).when(F.col("reason") != "", F.col("was_run") + 1).otherwise(F.col("was_run")).cast("long").alias("run"), F.coalesce(F.col("was") + 1, F.lit(0)).cast("long").alias("version"), "path", "byte_offset", "digest", "complete", "reason",
        F.when(again, 0).otherwise(F.col("was_messages")).alias("was_messages"), F.when(~again, F.col("was_ns")).alias("was_ns"), (~again).alias("goes_on"),
    )
    state = stored(state, "state")  # a row for each take
    keys = state.select("take", "run", "version")
    new = messages.select("take", "seq", "ns", "kind", "note", "velocity").join(keys.select("take"), "take", "left_semi")

    held = _raw(spark, path, "held").join(state.where("goes_on").select("take", "run", (F.col("version") - 1).alias("version")), ["take", "run", "version"], "left_semi")
    carried = held.select("take", F.col("on_seq").alias("seq"), F.col("ns_on").alias("ns"), F.lit("note_on").alias("kind"), "note", F.col("velocity_on").alias("velocity"), F.lit(True).alias("old"))
    both = stored(pairing.neighbours(carried.unionByName(new.withColumn("old", F.lit(False)))), "paired")
    spans = new.groupBy("take").agg(F.max("ns").alias("new_ns"), F.count("*").alias("new_messages"))
    ended = stored(state.join(spans, "take", "left").withColumn("last_ns", F.greatest("was_ns", "new_ns")), "ended")
    on = both.where("kind = 'note_on'").join(ended.select("take", "complete", "last_ns"), "take")
    closure = F.when(F.col("next_kind") == "note_off", "note_off").when(F.col("next_kind") == "note_on", "restrike").when(F.col("complete"), "end_of_take")
    on = on.withColumn("closure", closure)
    intervals = on.where("closure IS NOT NULL").select(
        "take", "note", F.col("seq").alias("on_seq"), F.when(F.col("closure") == "note_off", F.col("next_seq")).alias("off_seq"), F.col("ns").alias("ns_on"), F.greatest("ns", F.coalesce("next_ns", "last_ns")).alias("ns_off"),
        F.col("velocity").alias("velocity_on"), F.when(F.col("closure") == "note_off", F.col("next_velocity")).alias("velocity_off"), "closure",
    )
    open_ = on.where("closure IS NULL").select("take", "note", F.col("seq").alias("on_seq"), F.col("ns").alias("ns_on"), F.col("velocity").alias("velocity_on"))
    roles = both.where("NOT old").select("take", "seq", F.when(F.col("kind") == "note_on", "interval_on").when(F.col("previous_kind") == "note_on", "interval_off").otherwise("orphan_note_off").alias("role"))
    roles = roles.unionByName(pairing.roles(new.where("kind NOT IN ('note_on', 'note_off')")))

    reached = running(new, ["take"], ["seq"], F.floor(F.col("seq") / BUCKET), highest={"reached": "ns"}).join(ended.select("take", "was_ns"), "take")
    late = reached.where("ns < greatest(reached, was_ns)").select("take", "seq", F.lit("non_monotone_timestamp").alias("cls"))
    closed = intervals.where("closure <> 'note_off'").select("take", F.col("on_seq").alias("seq"), F.col("closure").alias("cls"))
    long = intervals.where((F.col("closure") != "end_of_take") & (F.col("ns_off") - F.col("ns_on") >= pairing.IMPLAUSIBLE_NS)).select("take", F.col("on_seq").alias("seq"), F.lit("implausible_duration").alias("cls"))
    odd = roles.where("role IN ('orphan_note_off', 'undecodable')").select("take", "seq", F.col("role").alias("cls"))
    steps = ended.select("take", "path", "byte_offset", "digest", (F.col("was_messages") + F.coalesce("new_messages", F.lit(0))).alias("messages"), "last_ns", "complete", "reason")

    parts = {"messages": new, "roles": roles, "intervals": intervals, "defects": late.unionByName(closed).unionByName(long).unionByName(odd), "held": open_, "progress": steps}
    rows = None
    for name, part in parts.items():
        part = _entries(part.join(keys, "take"), name)
        rows = part if rows is None else rows.unionByName(part)
    rows.write.format("takes").mode("append").options(path=path, **({"commit": commit} if commit else {})).save()


def captures(spark: SparkSession, files: dict[int, str], path: str) -> DataFrame:
    """Brings the stored takes up to date with growing captures (take to file), and returns what came of it: take, from_offset, to_offset, messages, complete, reason.

    A take is read on from where its last commit ended, or from its start if its file is shorter than that or begins with other bytes. Where nothing was added nothing is committed.
    """
    known = {r["take"]: r for r in progress(spark, path).where(F.col("take").isin(list(files))).collect()}  # a row for each file asked for
    plan = []
    for take, file in files.items():
        was, size = known.get(take), os.path.getsize(file)
        reason = ""
        if was and size < was["byte_offset"]:
            reason = f"shorter than the {was['byte_offset']} bytes read"
        elif was and was["digest"] and head(file, min(was["byte_offset"], HEAD)) != was["digest"]:
            reason = "begins with other bytes"
        plan.append((take, file, 0 if reason or not was else was["byte_offset"], reason, 0 if reason or not was else was["messages"], bool(was and was["complete"] and not reason)))
    capture.register(spark)
    starts = "\n".join(str(p[2]) for p in plan)
    lines = spark.read.format("capture").option("paths", "\n".join(p[1] for p in plan)).option("starts", starts).load()
    asked = spark.createDataFrame(plan, "take long, path string, start long, reason string, first long, was_complete boolean")
    lines = lines.join(F.broadcast(asked), "path")  # a row for each file asked for
    ends = lines.groupBy("take").agg(F.max("byte_end").alias("to_offset"), F.max(F.col("kind") == "trailer").alias("trailer"))
    packets = lines.where("kind = 'packet'").select("take", F.col("byte_offset").alias("packet_seq"), "ns", "data")
    numbered = framing.framed(packets).join(F.broadcast(asked.select("take", "first")), "take")
    messages = numbered.select("take", (F.col("first") + F.col("seq")).alias("seq"), "ns", "kind", "note", "velocity")
    done = {r["take"]: (r["to_offset"], r["trailer"]) for r in ends.collect()}  # a row for each file asked for
    now, out = [], []
    for take, file, start, reason, _, was_complete in plan:
        to, trailer = done.get(take, (start, False))
        if take in done or reason or take not in known:
            now.append((take, file, to, head(file, min(to, HEAD)), bool(trailer or was_complete), reason))
        out.append((take, start, to, bool(trailer or was_complete), reason))
    if now:
        store(messages, spark.createDataFrame(now, "take long, path string, byte_offset long, digest string, complete boolean, reason string"), path)
    counts = table(spark, path, "progress").select("take", "messages", "run")
    return spark.createDataFrame(out, "take long, from_offset long, to_offset long, complete boolean, reason string").join(counts, "take", "left")


def head(file: str, size: int) -> str:
    with open(file, "rb") as f:
        return hashlib.sha256(f.read(size)).hexdigest()
