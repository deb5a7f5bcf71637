"""Nearest rows against brute force; surrogates of the Fano curve against the same counters in plain Python."""

import hashlib
import random

import pytest

from tonefold.operators import nearest, stats


def brute(known, asked, tolerance):
    out = []
    for key, t, name in asked:
        near = [(abs(at - t), at, value) for k, at, value in known if None not in (k, at, value, t) and k == key and abs(at - t) <= tolerance]
        out.append((key, t, name, min(near) if near else None))
    return sorted(out, key=str)


def ours(spark, known, asked, tolerance, parts):
    found = nearest.nearest(spark.createDataFrame(known, "key long, t long, id long"), spark.createDataFrame(asked, "key long, t long, name string"), ["key"], "t", "id", tolerance, parts=parts)
    return sorted(((r.key, r.t, r.name, r.near and tuple(r.near)) for r in found.collect()), key=str)


@pytest.mark.parametrize(("tolerance", "parts"), [(0, 1), (1, 3), (7, 1), (40, 4), (10_000, 2)])
def test_nearest_by_brute_force(spark, tolerance, parts):
    rng = random.Random(tolerance)
    base = 1_700_000_000_000_000_000  # times at which doubles are 256 apart
    known = [(rng.choice([1, 1, 1, 2, None]), rng.choice([base, -50]) + rng.randrange(400), rng.randrange(50)) for _ in range(150)] + [(1, None, 3), (2, base, None)]
    asked = [(rng.choice([1, 1, 2, 3, None]), rng.choice([base, -50]) + rng.randrange(400), f"q{i % 90}") for i in range(120)] + [(1, None, "none")]
    asked += asked[:5]
    assert ours(spark, known, asked, tolerance, parts) == brute(known, asked, tolerance)


def test_ties_and_empty_tables(spark):
    asked = [(1, 10, "a")]
    assert ours(spark, [(1, 7, 5), (1, 13, 1), (1, 7, 4)], asked, 3, 1) == [(1, 10, "a", (3, 7, 4))]
    assert ours(spark, [(1, 10, 9), (1, 9, 0)], asked, 3, 1) == [(1, 10, "a", (0, 10, 9))]
    assert ours(spark, [], asked, 3, 1) == [(1, 10, "a", None)]
    assert ours(spark, [(1, 10, 9)], [], 3, 1) == []
    with pytest.raises(ValueError):
        ours(spark, [], asked, -1, 1)


def test_a_key_is_spread_over_its_slots(spark):
    rows = spark.range(4000).selectExpr("1L AS key", "id AS t", "id")
    plan = nearest.nearest(rows, rows.select("key", "t"), ["key"], "t", "id", 10)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line]
    assert windows and all("_slot" in line for line in windows)


def counts(xs, width, bins):
    out = [0] * bins
    for x in xs:
        if x // width < bins:
            out[x // width] += 1
    mean = sum(out) / bins
    return (sum(c * c for c in out) / bins - mean * mean) / mean if mean else None


def test_bands_equal_the_same_counters_in_python(spark):
    rng = random.Random(9)
    rows = [(take, seq, 5_000 + rng.randrange(span)) for take, n, span in ((1, 200, 1000), (2, 30, 90), (3, 1, 10), (4, 2, 0 + 1)) for seq in range(n)]
    df = spark.createDataFrame(rows, "take long, seq long, ns long")
    found = {(r.take, r.width): r for r in stats.fano_bands(df.repartition(5), ["take"], "ns", "seq", (10, 100, 400), samples=4, seed=7).collect()}
    again = {(r.take, r.width): r for r in stats.fano_bands(df.coalesce(1), ["take"], "ns", "seq", (10, 100, 400), samples=4, seed=7).collect()}
    assert found == again and found
    expected = {}
    for take in (1, 2, 3, 4):
        mine = [(seq, ns) for t, seq, ns in rows if t == take]
        t0, t1 = min(ns for _, ns in mine), max(ns for _, ns in mine)
        for width in (10, 100, 400):
            bins = (t1 - t0) // width
            if bins < 3:
                continue
            number = lambda sample, seq: int(hashlib.sha256(f"{7 + sample}:{take}:{seq}".encode()).hexdigest()[:13], 16)  # noqa: E731,B023
            made = [counts([int(number(s, seq) * float(t1 - t0) / 2**52) for seq, _ in mine], width, bins) for s in range(4)]
            expected[take, width] = (bins, counts([ns - t0 for _, ns in mine], width, bins), made[0], min(made), max(made))
    assert set(found) == set(expected)
    for key, (bins, *values) in expected.items():
        r = found[key]
        assert r.bins == bins and (r.fano, r.poisson, r.low, r.high) == pytest.approx(values, abs=2e-6)
