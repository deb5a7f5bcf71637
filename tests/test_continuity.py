"""Continuity, damper and corner against hand values and brute force."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from tonefold.operators import continuity, warps


def test_modulus_by_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), int(a), int(a + n), int(w)) for k, a, n, w in zip(rng.integers(0, 3, 60), rng.integers(0, 400, 60), rng.integers(0, 80, 60), rng.integers(1, 9, 60))]
    df = spark.createDataFrame(rows, "take long, a long, b long, weight long")
    spans = df.groupBy("take").agg((F.min("a") - 3).alias("start"), (F.max("b") + 5).alias("stop"))
    widths = (1, 37, 150, 10_000)
    found = {(r.take, r.width): r for r in continuity.modulus(df, spans, "take", widths).collect()}
    for take in range(3):
        mine = [r for r in rows if r[0] == take]
        start, stop = min(r[1] for r in mine) - 3, max(r[2] for r in mine) + 5
        level = np.zeros(stop - start)
        for _, a, b, w in mine:
            level[a - start : b - start] += w
        f = np.r_[0, np.cumsum(level)]  # all ends are whole numbers, so F bends nowhere else
        for width in widths:
            if width >= stop - start:
                assert (take, width) not in found
                continue
            r = found[take, width]
            assert r.omega == pytest.approx((f[width:] - f[:-width]).max() / f[-1])
            assert r.lipschitz == pytest.approx(level.max() * width / f[-1])
            assert r.omega <= r.lipschitz + 1e-12
            assert r.cantor == pytest.approx((width / (stop - start)) ** (np.log(2) / np.log(3)))


def test_damper_integral(spark):
    s = 1_000_000_000
    rows = [
        (1, 0, 0, "note_on", 60, 9), (1, 1, 2 * s, "control", 64, 127), (1, 2, 5 * s, "control", 64, 0), (1, 3, 5 * s, "control", 7, 3),
        (1, 4, 6 * s, "control", 64, 100), (1, 5, 6 * s, "control", 64, 127), (1, 6, 8 * s, "control", 64, 0), (1, 7, 9 * s, "note_off", 60, 0),
        (2, 0, 7 * s, "control", 64, 127), (2, 1, 8 * s, "other", 0, 0),
    ]
    found = continuity.damper_integral(spark.createDataFrame(rows, "take long, seq long, ns long, kind string, note int, velocity int"), bite=0.5)
    got = [(r.take, r.ns // s, r.contact, round(r.dwell, 6), r.landings, round(r.integral, 6)) for r in found.orderBy("take", "ns").collect()]
    assert got == [
        (1, 0, 1.0, 0.0, 0, 0.0), (1, 2, 0.02, 2.0, 1, 2.5), (1, 5, 1.0, 2.06, 1, 2.56), (1, 6, 0.02, 3.06, 2, 4.06), (1, 8, 1.0, 3.1, 2, 4.1), (1, 69, 1.0, 64.1, 3, 65.6),
        (2, 7, 0.02, 0.0, 0, 0.0), (2, 68, 1.0, 1.22, 0, 1.22),
    ]


def test_messages_at_the_ends_are_not_inside(spark):
    intervals = spark.createDataFrame([(1, 1, 10, 20), (1, 2, 15, 40), (1, 3, 20, 40), (2, 4, 0, 9), (2, 5, 86_400_000_000_001, 3 * 86_400_000_000_000)], "take long, on_seq long, ns_on long, ns_off long")
    messages = spark.createDataFrame([(1, 10), (1, 20), (1, 40), (3, 5), (2, 86_400_000_000_002)], "take long, ns long")
    found = {r.on_seq: r.inside for r in continuity.held_messages(intervals, messages).collect()}
    assert found == {1: False, 2: True, 3: False, 4: False, 5: True}


def test_corner_is_the_sharpest_bend(spark):
    smooths = [10.0**i for i in range(-4, 5)]
    x, y = np.array([-9, -8.9, -8.7, -8.2, -6, -4, -2, -1.9, -1.7]), np.array([5, 3, 1, -1, -1.6, -1.8, -2.0, -4, -9])
    rows = [(1, s, float(np.exp(a)), float(np.exp(b))) for s, a, b in zip(smooths, x, y)] + [(2, s, 1.0 + s, 1.0 / s) for s in smooths[:3]] + [(3, s, 1.0, 1.0) for s in smooths]
    found = {r.pair: r.smooth for r in warps.corner(spark.createDataFrame(rows, "pair long, smooth double, data_term double, excess double")).collect()}
    x1, y1 = np.gradient(x), np.gradient(y)
    bend = (x1 * np.gradient(y1) - y1 * np.gradient(x1)) / (x1**2 + y1**2) ** 1.5
    assert found == {1: smooths[2 + int(np.argmax(bend[2:-2]))], 2: smooths[1], 3: smooths[2]}
