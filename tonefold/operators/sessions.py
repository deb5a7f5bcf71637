"""Sessions by gaps, anchored onset clusters, and sequences of pitch steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import scans

#: Width of the buckets of time in which sessions are cut.
SPLIT_NS = 86_400 * 1_000_000_000


def split(df: DataFrame, key: str, at: str, gap: int, *, tie: str, bucket: int = SPLIT_NS) -> DataFrame:
    """df with segment, 0 for a key's first: a new one begins where the gap to the row before is above `gap`. Rows without a time belong to none and are left out.

    Cuts are found within buckets of time and carried over them by a row per bucket, so no task holds a key's rows.
    """
    rows = df.where(F.col(at).isNotNull()).withColumn("_bucket", F.floor(F.col(at) / bucket))
    inner, outer = Window.partitionBy(key, "_bucket").orderBy(at, tie), Window.partitionBy(key).orderBy("_bucket")
    cut = F.coalesce((F.col(at) - F.lag(at).over(inner) > gap).cast("int"), F.lit(0))
    rows = rows.withColumn("_cut", cut).withColumn("_within", F.sum("_cut").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    edges = rows.groupBy(key, "_bucket").agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.sum("_cut").alias("_cuts"))
    edges = edges.withColumn("_fresh", F.coalesce((F.col("_first") - F.lag("_last").over(outer) > gap).cast("int"), F.lit(0)))
    before = F.sum(F.col("_cuts") + F.col("_fresh")).over(outer.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cuts")
    edges = edges.select(key, "_bucket", before.alias("_before"))
    return rows.join(edges, [key, "_bucket"]).withColumn("segment", F.col("_before") + F.col("_within")).select(*df.columns, "segment")


def clusters(notes: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, t, low, high, n: anchored clusters of the notes (t, note) of each group: a note within `width` of a cluster's first one belongs to it.

    Notes at one time are in the order of the notes; rows without a time or a note are left out. A scan, as a cluster's reach depends on where it began.
    """
    return scans.scanned(notes, keys, ["t", "note"], ["t", "note"], lambda: scans.Clusters(width), "t bigint, low int, high int, n int")


def steps(df: DataFrame, key: list[str], order: list[str], pitch: str, clamp: int) -> DataFrame:
    """df with step: difference to the next pitch, held within +-clamp; null for a key's last row."""
    after = F.lead(pitch).over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("step", F.when(after.isNotNull(), F.greatest(F.lit(-clamp), F.least(F.lit(clamp), after - F.col(pitch)))))  # least() passes over nulls


def ngrams(df: DataFrame, key: list[str], order: list[str], pitch: str, *, n: int, clamp: int) -> DataFrame:
    """key, pos, gram: the n clamped steps from each place that has n + 1 pitches, as one number in base 2 clamp + 1."""
    window = Window.partitionBy(*key).orderBy(*order)
    rows = steps(df, key, order, pitch, clamp).withColumn("pos", F.row_number().over(window) - 1)
    base, gram = 2 * clamp + 1, F.lit(0).cast("long")
    for i in range(n):
        gram = gram * base + F.lead("step", i).over(window) + clamp
    return rows.select(*key, "pos", gram.alias("gram")).where("gram IS NOT NULL")


def collapse_trills(df: DataFrame, keys: list[str], *, within_ns: int = 170_000_000, least: int = 5) -> DataFrame:
    """Rows (keys, ns, pitch) without the inner notes of trills: a run of `least` or more alternating steps of one or two semitones, each within
    `within_ns`, becomes its first note. Greedy from the left. Notes at one time are in the order of pitches; rows without a time or a pitch are left out."""
    return scans.scanned(df, keys, ["ns", "pitch"], ["ns", "pitch"], lambda: scans.Trills(within_ns, least), f"ns bigint, pitch {dict(df.dtypes)['pitch']}")


def register_line(df: DataFrame, keys: list[str], *, memory: int = 8, below: int = 11) -> DataFrame:
    """Rows (keys, ns, pitch) that are not more than `below` under the median of the last `memory` admitted ones. Notes at one time are in the order of
    pitches; rows without a time or a pitch are left out."""
    return scans.scanned(df, keys, ["ns", "pitch"], ["ns", "pitch"], lambda: scans.Register(memory, below), f"ns bigint, pitch {dict(df.dtypes)['pitch']}")
