"""Readings of a line of notes: keys, texture, the upper line, themes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Pitch classes of a major scale above its root.
MAJOR = (0, 2, 4, 5, 7, 9, 11)


def diatonic(df: DataFrame, keys: list[str], note: str, weight: str) -> DataFrame:
    """keys, root, share: the major key that holds most of the weight of the pitch classes; of equal ones the lowest root."""
    classes = df.groupBy(*keys, F.pmod(F.col(note), F.lit(12)).alias("pc")).agg(F.sum(weight).alias("w"))
    roots = classes.withColumn("root", F.explode(F.sequence(F.lit(0), F.lit(11))))
    inside = F.pmod(F.col("pc") - F.col("root"), F.lit(12)).isin(*MAJOR)
    sums = roots.groupBy(*keys, "root").agg(F.sum(F.when(inside, F.col("w")).otherwise(0)).alias("in_key"), F.sum("w").alias("total"))
    order = Window.partitionBy(*keys).orderBy(F.desc("in_key"), "root")
    return sums.withColumn("place", F.row_number().over(order)).where("place = 1").select(*keys, "root", F.round(F.try_divide("in_key", "total"), 6).alias("share"))


def texture(df: DataFrame, keys: list[str], at: str, note: str, velocity: str, tie: str, *, stop: int) -> DataFrame:
    """keys, n, per_hour, stops (gaps above `stop`), low, high, velocity, repetition (share of runs of four pitches that came before), root and share of the major key."""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    gap = F.col(at) - F.lag(at).over(w)
    gram = F.when(F.lead(note, 3).over(w).isNotNull(), F.concat_ws(",", *[F.col(note) if i == 0 else F.lead(note, i).over(w) for i in range(4)]))
    rows = df.withColumns({"_gap": gap, "_gram": gram})
    span = (F.max(at) - F.min(at)) / 3_600_000_000_000
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.try_divide(F.count("*").cast("double"), span), 4).alias("per_hour"), F.count_if(F.col("_gap") > stop).alias("stops"), F.min(note).alias("low"), F.max(note).alias("high"),
        F.round(F.avg(velocity), 4).alias("velocity"), F.round(F.coalesce(1 - F.try_divide(F.count_distinct("_gram"), F.count("_gram")), F.lit(0.0)), 6).alias("repetition"),
    )
    return found.join(diatonic(df, keys, note, velocity), keys)


def top_part(df: DataFrame, keys: list[str], part: str, at: str, note: str, *, least: int = 8) -> DataFrame:
    """keys, part, median, n: the part whose upper median of the highest note at each time is highest; parts of fewer than `least` times don't count, of equal ones the first."""
    tops = df.groupBy(*keys, part, at).agg(F.max(note).alias("p")).groupBy(*keys, part).agg(F.sort_array(F.collect_list("p")).alias("p")).where(F.size("p") >= least)
    found = tops.select(*keys, part, F.get("p", F.floor(F.size("p") / 2).cast("int")).alias("median"), F.size("p").cast("long").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("median"), part)
    return found.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def skyline(df: DataFrame, keys: list[str], at: str, note: str, tie: str) -> DataFrame:
    """keys, at, note: the highest note of each instant, with the first row that has it."""
    return df.groupBy(*keys, at).agg(F.max(note).alias("note"), F.min_by(tie, F.struct(-F.col(note), F.col(tie))).alias(tie))


def themes(df: DataFrame, key: str, order: str, note: str, *, size: int = 32, stride: int = 16, most: int = 12, least_pitches: int = 3) -> DataFrame:
    """key, start, pitches: windows of `size` notes every `stride`, up to `most` per key, without those of the same steps as an earlier one or of too few pitches."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("i", F.row_number().over(w) - 1).withColumn("window", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("i") - size) / stride) + 1), F.floor(F.col("i") / stride))))
    sets = rows.groupBy(key, "window").agg(F.array_sort(F.collect_list(F.struct("i", F.col(note).alias("p")))).alias("x")).where(F.size("x") == size)
    sets = sets.select(key, "window", F.col("x.p").alias("pitches"))
    steps = F.transform("pitches", lambda p, i: p - F.get("pitches", F.greatest(i - 1, F.lit(0))))
    sets = sets.where(F.size(F.array_distinct("pitches")) >= least_pitches).withColumn("steps", F.array_join(steps, ","))
    sets = sets.withColumn("seen", F.row_number().over(Window.partitionBy(key, "steps").orderBy("window"))).where("seen = 1")
    sets = sets.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("window"))).where(F.col("place") <= most)
    return sets.select(key, (F.col("window") * stride).alias("start"), F.array_join("pitches", ",").alias("pitches"))
