"""Running sums and neighbours over long timelines without one task for a whole timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, *, sums: dict[str, str] | None = None, highest: dict[str, str] | None = None, following: dict[str, str] | None = None, previous: dict[str, str] | None = None
) -> DataFrame:
    """df with columns per keys, in order: sums up to this row, the highest value of the rows before, values of the next and of the previous row.

    bucket must not decrease along the order. Each is found within a bucket, and what it needs of other buckets comes from a row per bucket; a
    task holds a bucket, not a timeline. Rows of equal order count as in any order.
    """
    df = df.withColumn("_bucket", bucket)
    inner, outer = Window.partitionBy(*keys, "_bucket").orderBy(*order), Window.partitionBy(*keys).orderBy("_bucket")
    upto, before, earlier = inner.rowsBetween(Window.unboundedPreceding, 0), inner.rowsBetween(Window.unboundedPreceding, -1), outer.rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    edges, carried, within, out = [], [], {}, {}
    for name, value in (sums or {}).items():
        edges.append(F.sum(value).alias(f"_e_{name}"))
        carried.append(F.coalesce(F.sum(f"_e_{name}").over(earlier), F.lit(0)).alias(f"_c_{name}"))
        within[f"_w_{name}"] = F.sum(value).over(upto)
        out[name] = F.col(f"_c_{name}") + F.col(f"_w_{name}")
    for name, value in (highest or {}).items():
        edges.append(F.max(value).alias(f"_e_{name}"))
        carried.append(F.max(f"_e_{name}").over(earlier).alias(f"_c_{name}"))
        within[f"_w_{name}"] = F.max(value).over(before)
        out[name] = F.greatest(f"_c_{name}", f"_w_{name}")
    for names, edge, beside, near in ((following, F.min_by, F.lead, F.lead), (previous, F.max_by, F.lag, F.lag)):
        for name, value in (names or {}).items():
            edges.append(edge(value, place).alias(f"_e_{name}"))
            carried.append(near(f"_e_{name}").over(outer).alias(f"_c_{name}"))
            last = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*[F.desc(c) if near is F.lead else F.asc(c) for c in order])) == 1
            within[f"_w_{name}"] = F.when(last, None).otherwise(beside(value).over(inner))
            within[f"_l_{name}"] = last
            out[name] = F.when(F.col(f"_l_{name}"), F.col(f"_c_{name}")).otherwise(F.col(f"_w_{name}"))
    totals = df.groupBy(*keys, "_bucket").agg(*edges).select(*keys, "_bucket", *carried)
    kept = [c for c in df.columns if c != "_bucket" and c not in out]
    return df.withColumns(within).join(totals, [*keys, "_bucket"]).select(*kept, *[c.alias(name) for name, c in out.items()])


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out: str, bucket: Column) -> DataFrame:
    """df with out: the sum of value over the rows up to this one, per keys, in order."""
    return running(df, keys, order, bucket, sums={out: value})
