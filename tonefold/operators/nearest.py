"""The nearest row in time, before or after, within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def nearest(df: DataFrame, at: DataFrame, keys: list[str], time: str, value: str, tolerance: int, *, parts: int = 1, out: str = "near") -> DataFrame:
    """at with `out`, a struct (distance, at, value): the row of df with the same keys that is nearest in time, at most `tolerance` away, on either side; null if there is none.

    Of equally near rows the earlier one counts, of rows at one time the smallest value. Times are whole numbers. Rows without a time, a key or (in df) a value match nothing; every row of
    `at` is kept, repeated ones too.

    Time is cut into slots, `parts` of them to the tolerance, so what is near lies in the same slot or in the next `parts` on a side: of those only their last or first row can count. A
    task sorts one slot of a key, never a key; a key with very many rows takes more parts.
    """
    if tolerance < 0 or parts < 1:
        raise ValueError("tolerance must not be negative, parts must be at least 1")
    width = max(1, -(-tolerance // parts))
    slot = F.expr(f"(_t - pmod(_t, {width}L)) div {width}L")
    given = lambda rows: rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, time]))
    known = given(df).where(F.col(value).isNotNull()).groupBy(*keys, F.col(time).cast("long").alias("_t")).agg(F.min(value).alias("_value"))
    known = known.select(*keys, "_t", slot.alias("_slot"), F.struct(F.col("_t").alias("at"), F.col("_value").alias("value")).alias("_known"))
    asked = given(at).select(*keys, F.col(time).cast("long").alias("_t")).distinct().withColumn("_slot", slot)

    steps = F.explode(F.sequence(F.lit(1), F.lit(parts))).alias("_step")
    edges = known.groupBy(*keys, "_slot").agg(F.max("_known").alias("_last"), F.min("_known").alias("_first")).select(*keys, "_slot", "_last", "_first", steps)
    beside = edges.select(*keys, (F.col("_slot") + F.col("_step")).alias("_slot"), F.col("_last").alias("_b")).unionByName(edges.select(*keys, (F.col("_slot") - F.col("_step")).alias("_slot"), F.col("_first").alias("_a")), allowMissingColumns=True)
    beside = beside.groupBy(*keys, "_slot").agg(F.max("_b").alias("_b"), F.min("_a").alias("_a"))

    rows = known.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "_slot")
    rows = rows.withColumns({"_before": F.max("_known").over(inside.orderBy("_t")), "_after": F.min("_known").over(inside.orderBy(F.desc("_t")))})  # rows at one time see each other
    found = rows.where("_asked").drop("_asked", "_known").join(beside, [*keys, "_slot"], "left")
    sides = [F.greatest("_before", "_b"), F.least("_after", "_a")]
    near = [F.when(F.abs(F.col("_t") - c["at"]) <= tolerance, F.struct(F.abs(F.col("_t") - c["at"]).alias("distance"), c["at"].alias("at"), c["value"].alias("value"))) for c in sides]
    found = found.select(*keys, F.col("_t").alias("_time"), F.least(*near).alias(out)).where(F.col(out).isNotNull())
    kept = [c for c in at.columns if c != out]
    return at.select(*kept, F.col(time).cast("long").alias("_time")).join(found, [*keys, "_time"], "left").select(*kept, out)
