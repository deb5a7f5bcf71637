"""Integrity of a stream's timing and pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import pairing
from .running import running

LATTICE_NS = 5_000_000


#: Messages of a bucket in which neighbours are sought.
BUCKET = 1 << 16


def gaps(messages: DataFrame) -> DataFrame:
    """take, seq, gap: time since the message before, from a take's second message on."""
    found = running(messages.select("take", "seq", "ns"), ["take"], ["seq"], F.floor(F.col("seq") / BUCKET), previous={"before": "ns"})
    return found.select("take", "seq", (F.col("ns") - F.col("before")).alias("gap")).where("gap IS NOT NULL")


def lattice(messages: DataFrame, *, step_ns: int = LATTICE_NS) -> DataFrame:
    """take, n_gaps, on_grid, fraction, smallest, zero_gaps, off_runs, restored: gaps on a grid of step_ns, runs of gaps off it, and how many of these add up to the grid again."""
    g = gaps(messages).withColumn("off", (F.pmod("gap", F.lit(step_ns)) != 0).cast("int"))
    bucket = F.floor(F.col("seq") / BUCKET)
    g = running(g, ["take"], ["seq"], bucket, previous={"was": "off"})
    g = g.withColumn("new", ((F.col("off") == 1) & (F.coalesce("was", F.lit(0)) == 0)).cast("int"))
    g = running(g, ["take"], ["seq"], bucket, sums={"run": "new"})
    runs = g.where("off = 1").groupBy("take", "run").agg(F.sum("gap").alias("length")).groupBy("take").agg(F.count("*").alias("off_runs"), F.count_if(F.pmod("length", F.lit(step_ns)) == 0).alias("restored"))
    whole = g.groupBy("take").agg(F.count("*").alias("n_gaps"), F.count_if(F.expr("off = 0")).alias("on_grid"), F.min(F.when(F.col("gap") > 0, F.col("gap"))).alias("smallest"), F.count_if(F.expr("gap = 0")).alias("zero_gaps"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return whole.join(runs, "take", "left").select("take", "n_gaps", "on_grid", F.round(F.col("on_grid") / F.col("n_gaps"), 6).alias("fraction"), "smallest", "zero_gaps", zero("off_runs"), zero("restored"))


def common_divisor(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, divisor: greatest common divisor of the values, folded within each partition first."""
    spread = values.where(F.col(value) > 0).select(*keys, F.col(value).alias("v")).distinct()
    euclid = lambda a, b: F.aggregate(  # noqa: E731  at most 93 steps for 64-bit numbers
        F.sequence(F.lit(1), F.lit(93)), F.struct(a.alias("a"), b.alias("b")), lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.pmod(s["a"], F.when(s["b"] == 0, 1).otherwise(s["b"])).alias("b"))), lambda s: s["a"]
    )
    fold = lambda arr: F.aggregate(arr, F.lit(0).cast("long"), euclid)
    part = spread.groupBy(*keys, F.pmod(F.xxhash64("v"), F.lit(64)).alias("part")).agg(fold(F.collect_list("v")).alias("v"))
    return part.groupBy(*keys).agg(fold(F.collect_list("v")).alias("divisor"))


def losses(messages: DataFrame) -> DataFrame:
    """take, messages, ons, offs, orphans, restrikes, held, balance, inferred_lost, rate, verdict."""
    roles = pairing.roles(messages).groupBy("take").agg(F.count("*").alias("messages"), F.count_if(F.expr("role = 'interval_on'")).alias("ons"), F.count_if(F.expr("role IN ('interval_off', 'orphan_note_off')")).alias("offs"), F.count_if(F.expr("role = 'orphan_note_off'")).alias("orphans"))
    closed = pairing.intervals(messages).groupBy("take").agg(F.count_if(F.expr("closure = 'restrike'")).alias("restrikes"), F.count_if(F.expr("closure = 'end_of_take'")).alias("held"))
    both = roles.join(closed, "take", "left").fillna(0, ["restrikes", "held"]).withColumns({"balance": F.col("ons") - F.col("offs"), "inferred_lost": F.col("orphans") + F.col("restrikes")})
    verdict = F.when(F.col("ons") + F.col("offs") == 0, "EMPTY").when((F.col("inferred_lost") == 0) & (F.col("balance") == F.col("held")), "GOOD").otherwise("SUSPECT")
    return both.select("take", "messages", "ons", "offs", "orphans", "restrikes", "held", "balance", "inferred_lost", F.round(F.col("inferred_lost") / F.col("messages"), 6).alias("rate"), verdict.alias("verdict"))
