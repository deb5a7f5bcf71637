"""Lines of segments while notes arrive: the same places as in batch, whatever the cuts between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.identify import CLUSTER_NS, FIELDS, ORNAMENT_NS, Reader

PLACE = "take long, segment long, line string, pos long, ns long, pitch int"


def lines(messages: DataFrame, *, gap_ns: int = 6_000_000_000, cluster_ns: int = CLUSTER_NS, ornament_ns: int = ORNAMENT_NS) -> DataFrame:
    """Places of lines of a stream of messages (take, seq, ns, kind, note, velocity), each once it can't change any more.

    A gap above gap_ns between onsets ends a segment; an `end` message ends the take. Messages of a take come in order of seq over micro-batches. The
    state is the open cluster, the notes that may still be part of an ornament, and the register, in columns of their own.
    """

    def read(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        segment, last, reader = 0, None, Reader(cluster_ns, ornament_ns)
        if state.exists:
            segment, last, *fields = state.get
            reader = Reader.of(tuple(fields), cluster_ns, ornament_ns)
        rows = pd.concat(list(batches)).sort_values("seq")
        out: list[tuple] = []

        def give(onsets: list[tuple[int, int]], end: bool) -> None:
            out.extend((key[0], segment, *place) for place in reader.feed(onsets, end))

        some: list[tuple[int, int]] = []
        for ns, kind, note in zip(rows["ns"].tolist(), rows["kind"].tolist(), rows["note"].tolist()):
            if kind == "end" or (last is not None and ns - last > gap_ns):
                give(some, True)
                reader, segment, some, last = Reader(cluster_ns, ornament_ns), segment + 1, [], None
            if kind != "end":
                some.append((ns, note))
                last = ns
        give(some, False)
        state.update((segment, last, *reader.fields()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PLACE.split(", ")])

    notes = messages.where("(kind = 'note_on' AND velocity > 0) OR kind = 'end'").select("take", "seq", "ns", "kind", "note")
    return notes.groupBy("take").applyInPandasWithState(read, PLACE, f"segment long, last long, {FIELDS}", "append", GroupStateTimeout.NoTimeout)
