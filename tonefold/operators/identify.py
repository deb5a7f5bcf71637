"""Naming what is played: lines of a segment, their n-grams, votes for themes, and one verdict per segment.

A segment is read as three lines of its onset clusters: the highest notes (top), the lowest (bass), and the highest without those that drop out of the
register of the notes before (mel). Ornaments are taken out of each. `Reader` reads one segment, in pieces of any size; a place of a line is given out once what
follows can't change it any more, so the lines are the same whatever the pieces. In batch each segment is read at once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from . import scans, search, sessions

LINES = ("mel", "top", "bass")
#: Onsets of one cluster, steps of an ornament (nanoseconds); steps that make an ornament; the register: notes remembered and semitones below their median.
CLUSTER_NS, ORNAMENT_NS, ORNAMENT, MEMORY, BELOW = 55_000_000, 170_000_000, 5, 8, 11
#: From this confidence on a candidate is a verdict.
SURE = 0.8


class Reader:
    """Onsets (ns, note) of a segment, in order of ns, to places (line, pos, ns, pitch)."""

    def __init__(self, cluster_ns: int = CLUSTER_NS, ornament_ns: int = ORNAMENT_NS):
        self.clusters = scans.Clusters(cluster_ns)
        self.register = scans.Register(MEMORY, BELOW)
        self.trills = {line: scans.Trills(ornament_ns, ORNAMENT) for line in LINES}
        self.given = dict.fromkeys(LINES, 0)

    def _placed(self, line: str, notes: list[tuple[int, int]]) -> list[tuple[str, int, int, int]]:
        at = self.given[line]
        self.given[line] += len(notes)
        return [(line, at + i, *note) for i, note in enumerate(notes)]

    def _closed(self, clusters: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, int]]:
        tops = [(t, high) for t, _, high, _ in clusters]
        notes = {"mel": self.register.feed(tops), "top": tops, "bass": [(t, low) for t, low, _, _ in clusters]}
        return [place for line in LINES for place in self._placed(line, self.trills[line].feed(notes[line]))]

    def feed(self, onsets: Iterable[tuple[int, int]], end: bool = False) -> list[tuple[str, int, int, int]]:
        out = self._closed(self.clusters.feed(onsets))
        return out + self.end() if end else out

    def end(self) -> list[tuple[str, int, int, int]]:
        out = self._closed(self.clusters.end())
        return out + [place for line in LINES for place in self._placed(line, self.trills[line].end())]

    def fields(self) -> tuple:
        """What goes on, as plain values: see `FIELDS`."""
        trills = [self.trills[line] for line in LINES]
        return (list(self.clusters.open or ()), list(self.register.last), [self.given[line] for line in LINES], [t.inside for t in trills], [[ns for ns, _ in t.held] for t in trills], [[p for _, p in t.held] for t in trills])

    @classmethod
    def of(cls, fields: tuple, cluster_ns: int, ornament_ns: int) -> Reader:
        cluster, last, given, inside, ns, pitch = fields
        reader = cls(cluster_ns, ornament_ns)
        reader.clusters.open = tuple(cluster) or None
        reader.register.last.extend(last)
        reader.given = dict(zip(LINES, given))
        for line, on, times, pitches in zip(LINES, inside, ns, pitch):
            reader.trills[line].inside, reader.trills[line].held = bool(on), list(zip(times, pitches))
        return reader


#: Columns of a reader's fields.
FIELDS = "cluster array<long>, register array<int>, given array<long>, inside array<boolean>, held_ns array<array<long>>, held_pitch array<array<int>>"


def lines(onsets: DataFrame, *, cluster_ns: int = CLUSTER_NS, ornament_ns: int = ORNAMENT_NS) -> DataFrame:
    """take, segment, line, pos, ns, pitch of onsets (take, segment, ns, note). Onsets at one time are in the order of notes; rows without a time or a note are
    left out. A task runs through segments one after the other and holds what of one is still open."""
    rows = onsets.select("take", F.col("segment").cast("long").alias("segment"), "ns", "note")
    return scans.scanned(rows, ["take", "segment"], ["ns", "note"], ["ns", "note"], lambda: Reader(cluster_ns, ornament_ns), "line string, pos bigint, ns bigint, pitch int")


def candidates(read: DataFrame, themes: DataFrame, *, n: int = 4, clamp: int = 15) -> DataFrame:
    """take, segment, line, theme, hits, density, margin, confidence: the best theme of each line; themes: theme, i, pitch."""
    asked = read.withColumn("query", F.concat_ws("/", "take", "segment", "line"))
    grams = sessions.ngrams(asked, ["query"], ["pos"], "pitch", n=n, clamp=clamp)
    corpus = search.packed(sessions.ngrams(themes, ["theme"], ["i"], "pitch", n=n, clamp=clamp), ["theme"])
    best = search.candidates(grams, corpus.withColumn("theme", F.concat(F.lit("t"), F.col("theme").cast("string"))))
    part = lambda i: F.split("query", "/")[i]
    margin = F.round((F.col("hits") - F.col("runner_up")) / F.col("hits"), 3)
    return best.select(part(0).cast("long").alias("take"), part(1).cast("long").alias("segment"), part(2).alias("line"), F.substring("theme", 2, 40).alias("theme"), "hits", F.round("density", 3).alias("density"), margin.alias("margin"), "confidence")


def verdicts(onsets: DataFrame, themes: DataFrame, *, cluster_ns: int = CLUSTER_NS, ornament_ns: int = ORNAMENT_NS, sure: float = SURE) -> DataFrame:
    """take, segment, theme, line, hits, density, margin, confidence, notes, length_ns, sure: one row for each segment for which any theme has a vote.

    Of the lines' candidates the surest counts, then that with most hits, then the order of LINES.
    """
    read = lines(onsets, cluster_ns=cluster_ns, ornament_ns=ornament_ns)
    found = candidates(read, themes)
    order = F.when(F.col("line") == "mel", 2).when(F.col("line") == "top", 1).otherwise(0)
    best = found.groupBy("take", "segment").agg(F.max(F.struct("confidence", "hits", order.alias("order"), "theme", "line", "density", "margin")).alias("b"))
    size = onsets.groupBy("take", F.col("segment").cast("long").alias("segment")).agg(F.count("*").alias("notes"), (F.max("ns") - F.min("ns")).alias("length_ns"))
    return best.join(size, ["take", "segment"]).select("take", "segment", "b.theme", "b.line", "b.hits", "b.density", "b.margin", "b.confidence", "notes", "length_ns", (F.col("b.confidence") >= sure).alias("sure"))
