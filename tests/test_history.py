"""Logs of answers against a plain fold; batches that come again, out of order or in part change nothing."""

import random

from pyspark.sql import functions as F

from tonefold.operators import history

SCHEMA = "take long, part string, at long, seq long, verdict string"


def folded(rows):
    """State and trail by one pass over the answers in order."""
    state, trail = {}, []
    for take, part, at, seq, verdict in sorted({r for r in rows if None not in r[:4]}, key=lambda r: (r[2], r[3], r[4] is not None, r[4] or "")):
        before = state.get((take, part))
        row = [at, seq, verdict, None, None, 1, 0]
        if before:
            row[5], row[6] = before[5] + 1, before[6]
            if before[2] != verdict:
                row[3], row[4], row[6] = before[2], before[0], before[6] + 1
                trail.append((take, part, *row[:5]))
        state[take, part] = row
    return sorted([(*k, *v) for k, v in state.items()], key=str), sorted(trail, key=str)


def found(spark, path, width):
    log, how = history.read(spark, path), (["take", "part"], ["at", "seq"], "verdict", F.floor(F.col("at") / width))
    return sorted(map(tuple, history.state(log, *how).collect()), key=str), sorted(map(tuple, history.trail(log, *how).collect()), key=str)


def test_batches_in_any_order_and_again(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice([1, 1, 1, 2]), rng.choice("ab"), rng.randrange(60), rng.randrange(3), rng.choice(["right", "wrong", "unsure", None])) for _ in range(160)]
    rows += [(None, "a", 5, 0, "right"), (1, None, 5, 0, "right"), (1, "a", None, 0, "right")]
    batches = [rows[i::4] for i in range(4)]
    path = str(tmp_path / "log")
    assert history.read(spark, path) is None
    for i in (2, 0, 2, 3, 1, 0):
        history.merge(spark.createDataFrame(batches[i], SCHEMA).repartition(3), path, "at")
    history.merge(spark.createDataFrame(rows[10:90], SCHEMA), path, "at")  # in part
    history.merge(spark.createDataFrame([], SCHEMA), path, "at")
    assert spark.read.parquet(path).count() == len({r for r in rows if r[2] is not None})  # each answer written once
    for width in (7, 1000):
        assert found(spark, path, width) == folded(rows)


def test_a_log_with_an_answer_twice_reads_as_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(1, "a", 1, 0, "right"), (1, "a", 2, 0, "wrong"), (1, "a", 3, 0, "wrong")]
    for part in (rows[:2], rows):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(path)
    assert found(spark, path, 10) == ([(1, "a", 3, 0, "wrong", None, None, 3, 1)], [(1, "a", 2, 0, "wrong", "right", 1)])
