"""Distribution statistics of columns of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .running import running


def exclusive_quantile(values: Column, q: float) -> Column:
    """Quantile of a sorted array by the exclusive method, place q (n + 1), which goes beyond the ends for few values; null below two."""
    n = F.size(values)
    at = F.lit(q) * (n + 1)
    lower = F.greatest(F.lit(1), F.least(F.floor(at), n - 1)).cast("int")
    a, b = F.get(values, lower - 1), F.get(values, lower)
    return F.when(n >= 2, a + (at - lower) * (b - a))


#: Parts that a key's values are dealt into, by approximate quantiles.
PARTS = 64


def cumulative_counts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, v, c, upto: each different value of a key, how often it occurs, and how many values there are up to it.

    Values are counted first, then dealt into parts between approximate quantiles of their key; counts are added up within a part, and over parts by a row for each. The parts decide
    who does the work, not the result.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    cuts = counts.groupBy(*keys).agg(F.percentile_approx("v", [i / PARTS for i in range(1, PARTS)], 1000).alias("cuts"))
    dealt = counts.join(cuts, keys).withColumn("part", F.size(F.filter("cuts", lambda x: x < F.col("v")))).drop("cuts")
    return running(dealt, keys, ["v"], F.col("part"), sums={"upto": "c"}).select(*keys, "v", "c", "upto")


def describe(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, min, p10, median, mean, p90, max, sd (of the population); quantiles by the exclusive method. Values at the places of quantiles come from cumulative counts, so no task holds a group."""
    known = df.where(F.col(value).isNotNull())
    whole = known.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.stddev_pop(value).alias("sd"))
    rows = cumulative_counts(known, keys, value).join(whole.select(*keys, "n"), keys)
    at = lambda place: (F.col("upto") - F.col("c") < place) & (place <= F.col("upto"))

    def part(q: float) -> Column:
        place = F.lit(q) * (F.col("n") + 1)
        lower = F.greatest(F.lit(1), F.least(F.floor(place), F.col("n") - 1))
        return F.sum(F.when(at(lower), F.col("v") * (1 - (place - lower))).otherwise(0.0) + F.when(at(lower + 1), F.col("v") * (place - lower)).otherwise(0.0))

    middle = F.sum(F.when(at(F.floor((F.col("n") + 1) / 2)), F.col("v")).otherwise(0.0) + F.when(at(F.floor((F.col("n") + 2) / 2)), F.col("v")).otherwise(0.0)) / 2
    found = rows.groupBy(*keys).agg(part(0.1).alias("p10"), middle.alias("median"), part(0.9).alias("p90"))
    many = lambda c: F.round(F.when(F.col("n") >= 2, F.col(c)), 3).alias(c)
    rounded = lambda c: F.round(c, 3).alias(c)
    return whole.join(found, keys).select(*keys, "n", "min", many("p10"), rounded("median"), rounded("mean"), many("p90"), "max", rounded("sd"))


def histogram(df: DataFrame, keys: list[str], value: str, width: int) -> DataFrame:
    """keys, bucket (lower end), n; buckets go down for negative values."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, (F.floor(F.col(value) / width) * width).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def entropy(df: DataFrame, keys: list[str], bucket: Column) -> DataFrame:
    """keys, bits: Shannon entropy of the buckets."""
    counts = df.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(*keys))
    return counts.withColumn("p", p).groupBy(*keys).agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("bits"))


def mutual_information(df: DataFrame, keys: list[str], a: Column, b: Column) -> DataFrame:
    """keys, n, bits: mutual information of two bucketed columns."""
    joint = df.groupBy(*keys, a.alias("a"), b.alias("b")).agg(F.count("*").alias("c"))
    total = F.sum("c").over(Window.partitionBy(*keys))
    ca, cb = F.sum("c").over(Window.partitionBy(*keys, "a")), F.sum("c").over(Window.partitionBy(*keys, "b"))
    return joint.withColumns({"t": total, "ca": ca, "cb": cb}).groupBy(*keys).agg(F.sum("c").alias("n"), F.round(F.sum(F.col("c") / F.col("t") * F.log2(F.col("c") * F.col("t") / (F.col("ca") * F.col("cb")))), 6).alias("bits"))


def correlations(df: DataFrame, keys: list[str], a: str, b: str, tie: str) -> DataFrame:
    """keys, n, pearson, rank_correlation; ranks by order, ties in the order of `tie`, not averaged."""
    rank = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(c, tie)).cast("double")
    ranked = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumns({"ra": rank(a), "rb": rank(b)})
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), 6).alias("pearson"), F.round(F.corr("ra", "rb"), 6).alias("rank_correlation"))


def fano(df: DataFrame, keys: list[str], at: str, width: int) -> DataFrame:
    """keys, bins, fano: variance over mean of the counts in windows of `width` from the first row on, empty ones included; the last, unfinished one left out."""
    start = df.groupBy(*keys).agg(F.min(at).alias("t0"), F.max(at).alias("t1")).withColumn("bins", F.floor((F.col("t1") - F.col("t0")) / width))
    counts = df.join(start, keys).withColumn("bin", F.floor((F.col(at) - F.col("t0")) / width)).where("bin < bins").groupBy(*keys, "bin").agg(F.count("*").alias("c"))
    sums = counts.groupBy(*keys).agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    mean = F.col("s") / F.col("bins")
    return start.join(sums, keys).where("bins > 0").select(*keys, "bins", F.round((F.col("q") / F.col("bins") - mean * mean) / mean, 6).alias("fano"))


def fano_bands(df: DataFrame, keys: list[str], at: str, number: str, widths: tuple[int, ...], *, samples: int = 9, seed: int = 0) -> DataFrame:
    """keys, width, bins, fano, poisson, low, high: the dispersion of a key's rows in windows of each width, and that of surrogates: as many rows, evenly at random over the same span.

    poisson is the first surrogate's, low and high are the extremes of all `samples`; null where no surrogate row lies in a whole window. Widths of which fewer than three fit are left out. A surrogate's
    row takes its place from 52 bits of a hash of sample, keys and the row's `number`, so it is the same whatever the partitions; rows without a time are left out. Times are whole numbers.
    """
    spans = df.where(F.col(at).isNotNull()).groupBy(*keys).agg(F.min(at).alias("_t0"), (F.max(at) - F.min(at)).alias("_span"))
    rows = df.where(F.col(at).isNotNull()).select(*keys, F.col(at).alias("_at"), F.col(number).alias("_number")).join(spans, keys)
    rows = rows.withColumn("_sample", F.explode(F.array(*[F.lit(i) for i in range(-1, samples)])))
    bits = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed) + F.col("_sample"), *[F.col(k) for k in keys], "_number"), 256), 1, 13), 16, 10).cast("long")
    place = F.when(F.col("_sample") < 0, F.col("_at") - F.col("_t0")).otherwise(F.floor(bits.cast("double") * F.col("_span").cast("double") / 2.0**52).cast("long"))
    rows = rows.select(*keys, "_span", "_sample", place.alias("_x")).withColumn("width", F.explode(F.array(*[F.lit(w).cast("long") for w in widths])))
    rows = rows.withColumns({"bins": F.expr("_span div width"), "_bin": F.expr("_x div width")}).where("bins >= 3 AND _bin < bins")
    sums = rows.groupBy(*keys, "width", "bins", "_sample", "_bin").agg(F.count("*").alias("_c")).groupBy(*keys, "width", "bins", "_sample").agg(F.sum("_c").alias("_s"), F.sum(F.col("_c") * F.col("_c")).alias("_q"))
    mean = F.col("_s") / F.col("bins")
    value = F.round((F.col("_q") / F.col("bins") - mean * mean) / mean, 6)
    of = lambda when, agg: agg(F.when(when, value))
    sample = F.col("_sample")
    return sums.groupBy(*keys, "width", "bins").agg(of(sample == -1, F.max).alias("fano"), of(sample == 0, F.max).alias("poisson"), of(sample >= 0, F.min).alias("low"), of(sample >= 0, F.max).alias("high"))
