"""Naming a piece while it is played: votes in keyed state, ranked only when a leader may have changed, one announcement for each segment.

The stream is that of a segment's n-grams, joined with the index: a row for each agreement. A segment's state is a map of cells (line, theme, diagonal) to hits and the places of
the first and the last. A cell of fewer than `LEAST` hits that got none for more than `LAG` places begins anew, so it may be forgotten; that is what bounds the state of a long segment, and as the
rule goes by places and not by micro-batches, what is announced doesn't depend on the cuts. `replay` says the same of finished segments in batch, by the same steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.scans import scanned

#: Fewest hits of a named piece, fewest for each place of its passage, places after which a weaker cell is forgotten, confidence of an announcement.
LEAST, DENSITY, LAG, SURE = 6, 0.34, 240, 0.8
#: Places from one clearing of the state to the next.
CLEAR = 64
FOUND = "theme bigint, line string, hits int, density double, runner_up int, confidence double, place bigint, announced boolean"
CELL, VALUE, FACTS = "line string, theme long, diagonal long", "work long, hits int, first long, last long", "peak int, ranked int, changed boolean, announced boolean, place long, cleared long"


def confidence(hits: int, density: float, rival: int) -> float:
    """As in operators.matching.candidates."""
    if hits < LEAST:
        return 0.0
    apart = 1.0 if rival < LEAST else 0.0 if hits <= rival else 1 - math.exp(-(hits - rival) / 2)
    return max(0.0, 1 - math.exp(-(hits - 2) / 2)) * min(1.0, density / 0.75) * apart


class Votes:
    """Cells of a segment and whether they are worth ranking: (line, theme, diagonal) to [work, hits, first, last]."""

    def __init__(self, cells: dict[tuple, list] | None = None, facts: tuple | None = None):
        self.cells = cells if cells is not None else {}
        self.touched: set[tuple] = set()
        self.gone: set[tuple] = set()
        self.peak, self.ranked, self.changed, self.announced, self.place, self.cleared = facts or (0, 0, False, False, -1, 0)

    def facts(self) -> tuple:
        return self.peak, self.ranked, self.changed, self.announced, self.place, self.cleared

    def add(self, line: str, q: int, theme: int, work: int, pos: int) -> None:
        for diagonal in (pos - q - 1, pos - q, pos - q + 1):
            key = line, theme, diagonal
            cell = self.cells.get(key)
            if cell is None or (cell[1] < LEAST and q - cell[3] > LAG):
                cell = self.cells[key] = [work, 0, q, q]
            cell[1] += 1
            cell[3] = q
            self.touched.add(key)
            self.gone.discard(key)
            if cell[1] >= LEAST:
                self.changed = True
            self.peak = max(self.peak, cell[1])

    def clear(self) -> None:
        """Forgets, now and then, what would begin anew anyway: a line goes on from the last place of any of its cells."""
        self.cleared += 1
        if self.cleared < CLEAR:
            return
        self.cleared, reached = 0, {}
        for (line, _, _), (_, _, _, last) in self.cells.items():
            reached[line] = max(last, reached.get(line, 0))
        for key in [k for k, (_, hits, _, last) in self.cells.items() if hits < LEAST and reached[k[0]] - last > LAG]:
            del self.cells[key]
            self.gone.add(key)

    def worth_ranking(self) -> bool:
        return self.peak >= LEAST and (self.peak > self.ranked or self.changed)

    def best(self) -> tuple | None:
        """theme, line, hits, density, runner_up, confidence of the surest line's best cell; None without cells."""
        self.ranked, self.changed = self.peak, False
        strong: dict[str, list[tuple]] = {}
        for (line, theme, diagonal), (work, hits, first, last) in self.cells.items():
            density = hits / (last - first + 1)
            strong.setdefault(line, []).append((hits if density >= DENSITY else 0, hits, -theme, -diagonal, density, work, first, last))
        found = []
        for line, cells in strong.items():
            effective, hits, theme, _, density, work, first, last = max(cells)
            rival = max((c[0] for c in cells if c[5] != work and c[7] >= first and c[6] <= last), default=0)
            found.append((round(confidence(effective, density, rival), 4), hits, line == "mel", line == "top", -theme, line, round(density, 6), rival))
        if not found:
            return None
        sure, hits, _, _, theme, line, density, rival = max(found)
        return theme, line, hits, density, rival, sure

    def run(self, rows: Iterable[tuple]) -> list[tuple]:
        """Announcements of rows (place, line, q, theme, work, pos) in order of place."""
        out: list[tuple] = []
        for place, line, q, theme, work, pos in rows:
            if place != self.place:
                out += self.decided()
                self.place = place
                self.clear()
            self.add(line, q, theme, work, pos)
        return out

    def decided(self) -> list[tuple]:
        """What the places so far decide."""
        if self.announced or not self.worth_ranking():
            return []
        best = self.best()
        if best is None or best[5] < SURE:
            return []
        self.announced = True
        return [(*best, self.place, True)]

    def end(self) -> list[tuple]:
        """What is left to say at the end: the announcement, if it is due, or else the best so far as none."""
        out = self.decided()
        if not self.announced and (best := self.best()) is not None:
            out.append((*best, self.place, False))
        return out

    feed = run


COLUMNS = ["place", "line", "q", "theme", "work", "pos"]


def agreements(grams: DataFrame, indexed: DataFrame) -> DataFrame:
    """take, segment, place, line, q, theme, work, pos of grams (take, segment, line, pos, gram, place) that an index (theme, work, pos, gram) has. place orders a segment's grams
    over its lines, as the time does at which a gram is complete."""
    met = grams.select("take", "segment", "place", "line", F.col("pos").alias("q"), "gram")
    return met.join(indexed.select("gram", "theme", "work", "pos"), "gram").select("take", "segment", *COLUMNS)


def replay(met: DataFrame) -> DataFrame:
    """take, segment and what is found of finished segments: an announcement where one was due, at the place at which it was, or else what was best at the end."""
    return scanned(met, ["take", "segment"], ["place", "line", "q", "theme", "pos"], COLUMNS, Votes, FOUND)


class Live(StatefulProcessor):
    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", CELL, VALUE)
        self.facts = handle.getValueState("facts", FACTS)

    def _loaded(self) -> Votes:
        facts = tuple(self.facts.get()) if self.facts.exists() else None
        return Votes({tuple(k): list(v) for k, v in self.cells.iterator()}, facts)

    def _forget_timers(self) -> None:
        for timer in list(self.handle.listTimers()) if self.idle_ms else ():
            self.handle.deleteTimer(timer)

    def _closed(self, key: tuple, votes: Votes) -> pd.DataFrame:
        self.cells.clear()
        self.facts.clear()
        self._forget_timers()
        return _frame(key, votes.end())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["place", "line", "q", "theme", "pos"], na_position="last")
        votes = self._loaded()
        ended = batch["line"].isna()
        found = votes.run(batch[~ended][COLUMNS].astype({c: "int64" for c in COLUMNS if c != "line"}).itertuples(index=False, name=None))
        yield _frame(key, found + votes.decided())
        if ended.any():
            yield self._closed(key, votes)
            return
        for cell in votes.gone:
            if self.cells.containsKey(cell):
                self.cells.removeKey(cell)
        for cell in votes.touched:
            if cell in votes.cells:
                self.cells.updateValue(cell, tuple(int(x) for x in votes.cells[cell]))
        self.facts.update(votes.facts())
        if self.idle_ms:
            self._forget_timers()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._closed(key, self._loaded())

    def close(self) -> None:
        pass


def _frame(key: tuple, found: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in FOUND.split(", ")]
    out = pd.DataFrame([(*key, *row) for row in found], columns=["take", "segment", *names])
    return out.astype({"take": "int64", "segment": "int64", "theme": "int64", "hits": "int32", "runner_up": "int32", "place": "int64", "announced": "bool", "density": "float64", "confidence": "float64"})


def named(met: DataFrame, ends: DataFrame | None = None, *, idle_ms: int = 600_000) -> DataFrame:
    """What `replay` says of a stream of agreements, each announcement once and as soon as it is due. ends: take, segment of segments that are over; those that
    get nothing for idle_ms (0: no timer) are closed by a timer. Agreements of a segment come in order of place over micro-batches, all of a place in one.

    With a timer Spark runs batches without input as well, so such a query never ends by itself: give it a trigger of processing time, not availableNow."""
    if ends is not None:
        blank = {"place": "long", "line": "string", "q": "long", "theme": "long", "work": "long", "pos": "long"}
        met = met.unionByName(ends.select("take", "segment", *[F.lit(None).cast(k).alias(c) for c, k in blank.items()]))
    return met.groupBy("take", "segment").transformWithStateInPandas(Live(idle_ms), "take long, segment long, " + FOUND.replace("bigint", "long"), "Append", "ProcessingTime" if idle_ms else "None")
