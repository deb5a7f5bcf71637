"""Answers that replace earlier ones: a log that takes each answer once, the state that it leaves, and the trail of revisions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .running import running


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The log at path, each answer once; None before the first merge."""
    try:
        return spark.read.parquet(path).distinct()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def merge(updates: DataFrame, path: str, at: str) -> None:
    """Adds to the log at path what it doesn't hold yet of the updates, whose columns are those of the log. at: the column of an answer's time.

    A batch may come again, in part or after a failure, and batches in any order: an answer is in the log once, and what is read from it depends only on the set of answers. Only the part of the log
    that lies between the batch's first and last time is read. Answers without a time are left out; other columns may be null. One writer at a time; should two write the same answer, `read` gives it once.
    """
    spark = updates.sparkSession
    fresh = updates.where(F.col(at).isNotNull()).distinct()
    first, last = fresh.agg(F.min(at), F.max(at)).first()  # one row
    if first is None:
        return
    if (log := read(spark, path)) is not None:
        known = log.where(F.col(at).between(F.lit(first), F.lit(last))).select([F.col(c).alias(f"_l_{c}") for c in fresh.columns])
        same = F.lit(True)
        for c in fresh.columns:
            same = same & F.col(c).eqNullSafe(F.col(f"_l_{c}"))
        fresh = fresh.join(known, same, "left_anti")
    fresh.write.mode("append").parquet(path)


def _followed(log: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column) -> DataFrame:
    """Answers with the value and time of the one before of their keys, where that said something else."""
    rows = log.select(*keys, *order, value).where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, *order])).distinct()
    rows = rows.withColumn("_answer", F.struct(F.col(value).alias("value"), F.col(order[0]).alias("at")))
    found = running(rows, keys, [*order, value], bucket, previous={"_before": "_answer"})
    changed = F.col("_before").isNotNull() & ~F.col("_before.value").eqNullSafe(F.col(value))
    return found.select(*keys, *order, value, changed.alias("_changed"), F.when(changed, F.col("_before.value")).alias("revised_from"), F.when(changed, F.col("_before.at")).alias("revised_at"))


def trail(log: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column) -> DataFrame:
    """keys, order, value, revised_from, revised_at of each answer that says something else than the one before of its keys.

    order begins with the time; answers of equal order count in order of value. bucket must not decrease along the order: a task holds a bucket of a key. Answers without keys or order are left out.
    """
    return _followed(log, keys, order, value, bucket).where("_changed").drop("_changed")


def state(log: DataFrame, keys: list[str], order: list[str], value: str, bucket: Column) -> DataFrame:
    """keys, order, value of the last answer of each key, revised_from and revised_at if it changed the one before, answers and revisions of the key; see `trail`."""
    last = F.max_by(F.struct(*order, value, "revised_from", "revised_at"), F.struct(*order, value)).alias("_last")
    counts = [F.count("*").alias("answers"), F.count_if("_changed").alias("revisions")]
    return _followed(log, keys, order, value, bucket).groupBy(*keys).agg(last, *counts).select(*keys, "_last.*", "answers", "revisions")
