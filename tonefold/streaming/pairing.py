"""Pairing on a stream: the same intervals as in batch, whatever the cuts between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

INTERVAL = "take long, note int, on_seq long, off_seq long, ns_on long, ns_off long, velocity_on int, velocity_off int, closure string"
#: The open note, and the take's last time seen by this key.
STATE = "on_seq long, ns_on long, velocity_on int"


def _pair(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    take, note = key
    rows = pd.concat(list(batches)).sort_values("seq")
    held = state.get if state.exists else None
    out = []
    for seq, ns, kind, velocity in zip(rows["seq"], rows["ns"], rows["kind"], rows["velocity"]):
        if held is not None:
            off = kind == "note_off"
            closure = "note_off" if off else "restrike" if kind == "note_on" else "end_of_take"
            out.append((take, note, held[0], seq if off else None, held[1], max(ns, held[1]), held[2], velocity if off else None, closure))
            held = None
        if kind == "note_on":
            held = (int(seq), int(ns), int(velocity))
    if held is None:
        if state.exists:
            state.remove()
    else:
        state.update(held)
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in INTERVAL.split(", ")])
    yield frame.astype({"off_seq": "Int64", "velocity_off": "Int32"})


def intervals(messages: DataFrame) -> DataFrame:
    """Intervals of a stream of messages (take, seq, ns, kind, note, velocity), each emitted when it closes.

    Only the take's end closes what is open, so an `end` message for each key in use is what to send last (see end_of_take); no timer closes a note.
    Rows of a key must come in order over micro-batches; within one they are sorted.
    """
    notes = messages.where("kind IN ('note_on', 'note_off', 'end')").select("take", "note", "seq", "ns", "kind", "velocity")
    return notes.groupBy("take", "note").applyInPandasWithState(_pair, INTERVAL, STATE, "append", GroupStateTimeout.NoTimeout)


def end_of_take(ends: DataFrame) -> DataFrame:
    """An `end` message for each of the 128 keys from ends (take, seq, ns)."""
    from pyspark.sql import functions as F

    return ends.select("take", F.explode(F.sequence(F.lit(0), F.lit(127))).alias("note"), "seq", "ns", F.lit("end").alias("kind"), F.lit(0).alias("velocity"))
