"""Melody search while notes arrive: grams by keyed state, votes as partial counts per micro-batch.

The last notes of a take are its state, so grams come once each, whatever the cuts. Each micro-batch's votes are written under its number, so
one that is run again replaces itself; totals are sums over all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import matching

GRAM = "query long, pos long, gram long"


def grams(notes: DataFrame, *, n: int, clamp: int) -> DataFrame:
    """query, pos, gram of a stream of notes (take, seq, note); as in operators.sessions.ngrams. Notes of a take come in order of seq over micro-batches."""

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, last = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values("seq")
        line = last + rows["note"].astype(int).tolist()
        out = []
        for i in range(len(line) - n):
            value = 0
            for a, b in zip(line[i : i + n], line[i + 1 : i + n + 1]):
                value = value * (2 * clamp + 1) + max(-clamp, min(clamp, b - a)) + clamp
            out.append((key[0], done + i, value))
        state.update((done + len(out), line[len(out) :]))
        yield pd.DataFrame(out, columns=["query", "pos", "gram"]).astype("int64")

    return notes.select("take", "seq", "note").groupBy("take").applyInPandasWithState(add, GRAM, "done long, last array<int>", "append", GroupStateTimeout.NoTimeout)


def sink(indexed: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """What to give to foreachBatch: writes the votes of a micro-batch of grams against an index."""

    def write(batch: DataFrame, number: int) -> None:
        matching.votes(batch, indexed).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def totals(spark: SparkSession, path: str) -> DataFrame:
    """query, theme, diagonal, hits, first, last over all micro-batches so far; as operators.matching.votes gives in batch."""
    parts = spark.read.parquet(path)
    return parts.groupBy("query", "theme", "diagonal").agg(F.sum("hits").alias("hits"), F.min("first").alias("first"), F.max("last").alias("last"))
