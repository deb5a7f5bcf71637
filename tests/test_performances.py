"""Performances, verdicts, time maps and captures on hand vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonefold.operators import alignment, intervals, pairing, performances, warps
from tonefold.operators.running import running
from tonefold.sources import capture

MESSAGE = "take long, seq long, ns long, kind string, note int, velocity int"
S = 1_000_000_000


def take(spark, rows, name=1):
    return spark.createDataFrame([(name, i, *r) for i, r in enumerate(rows)], MESSAGE)


def test_roles_of_controllers_and_unread_messages(spark):
    m = take(spark, [(0, "note_on", 60, 1), (0, "note_off", 62, 1), (0, "control", 64, 127), (0, "control", 7, 1), (0, "other", 0, 0), (0, "undecodable", None, None)])
    assert [r.role for r in pairing.roles(m).orderBy("seq").collect()] == ["interval_on", "orphan_note_off", "pedal", "control", "other", "undecodable"]
    assert {r.cls: r.n for r in pairing.defect_counts(m).collect()}["undecodable"] == 1
    assert intervals.pedal_spans(take(spark, [(0, "control", 7, 127), (S, "control", 64, 127), (2 * S, "other", 0, 0)])).collect() == [(1, S, 2 * S)]


def test_levels_from_start_to_stop(spark):
    x = spark.createDataFrame([(1, 10, 20), (1, 15, 30), (1, 30, 40)], "take long, a long, b long")
    spans = spark.createDataFrame([(1, 0, 50)], "take long, start long, stop long")
    found = {r.level: (r.dwell, r.fraction, r.spans) for r in intervals.dwell(intervals.levels(x, "take", spans=spans, bucket_ns=7), "take").collect()}
    assert found == {0: (20, 0.4, 1), 1: (25, 0.5, 3), 2: (5, 0.1, 1)}


def test_policies(spark):
    m = take(spark, [(0, "note_on", 60, 9), (S, "note_on", 60, 8), (2 * S, "note_off", 60, 1), (2 * S, "note_on", 20, 5), (3 * S, "note_off", 20, 5), (3 * S, "note_on", 64, 7), (4 * S, "note_off", 70, 1), (5 * S, "control", 64, 100)])
    rows = lambda **kw: sorted((r.note, r.ns_on, r.ns_off) for r in performances.perform(m, **kw).collect())
    assert rows() == [(60, 0, S), (60, S, 2 * S), (64, 3 * S, 5 * S)]
    assert rows(orphans="drop") == rows()[:2]
    for policy in ({"orphans": "raise"}, {"retriggers": "raise"}, {"beyond": "raise"}):
        with pytest.raises(Exception, match="take 1"):
            rows(**policy)
    with pytest.raises(ValueError):
        performances.perform(m, orphans="keep")
    report = performances.repairs(m).first()
    assert (report.strikes, report.orphan_offs, report.retriggers, report.orphan_ons, report.out_of_range, report.pedal_events, report.pedal_open, report.clean) == (3, 1, 1, 1, 2, 1, 1, False)


def test_verdicts_of_takes(spark):
    steady = [(i * 5_000_000, "note_on" if i % 2 == 0 else "note_off", 60, 64) for i in range(200)]
    lost = [(0, "note_off", 60, 1), (5_000_000, "note_on", 62, 1), (10_000_000, "note_on", 62, 1), (15_000_000, "note_off", 62, 1)]
    held = steady + [(10**9, "note_on", 61, 1)]
    m = take(spark, steady, 1).union(take(spark, lost, 2)).union(take(spark, held, 3))
    found = {r.take: r.verdict for r in performances.verdict(m).collect()}
    assert found == {1: "GOOD: 100 ons and 100 releases, 100.0 per cent on the grid", 2: "SUSPECT: 2 messages inferred lost", 3: "GOOD: 101 ons and 100 releases, 100.0 per cent on the grid; 1 keys down at the end"}
    assert performances.verdict(m, trusted=F.lit(False)).where("take = 1").first().verdict.endswith("timing not usable")
    steps = {r.take: r.step for r in performances.grid_step(m).collect()}
    assert steps[1] == 5_000_000


def test_running_equals_windows(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), int(t), int(v)) for t, (k, v) in enumerate(zip(rng.integers(0, 3, 300), rng.integers(0, 50, 300)))]
    df = spark.createDataFrame(rows, "k int, t long, v long")
    found = running(df, ["k"], ["t"], F.floor(F.col("t") / 17), sums={"s": "v"}, highest={"h": "v"}, following={"f": "v"}, previous={"p": "v"})
    got = {(r.k, r.t): (r.s, r.h, r.f, r.p) for r in found.collect()}
    for k in range(3):
        own = [(t, v) for key, t, v in rows if key == k]
        for i, (t, v) in enumerate(own):
            before = [x for _, x in own[:i]]
            assert got[k, t] == (sum(before) + v, max(before, default=None), own[i + 1][1] if i + 1 < len(own) else None, before[-1] if before else None)


def test_maps(spark):
    rows = [(1, 0.0, 0.0, 0.0), (1, 1.0, 2.0, 1.0), (1, 3.0, 3.0, 3.0), (1, 4.0, 4.0, 4.0)]
    points = spark.createDataFrame(rows, "pair long, t double, phi double, s double")
    assert [r.slope for r in warps.slopes(points).orderBy("t").collect()] == [2.0, 0.5, 1.0]
    kinks = warps.kinks(points).orderBy("place").collect()
    assert [(r.t, r.jump) for r in kinks] == [(1.0, -1.5), (3.0, 0.5)] and kinks[0].log_ratio == pytest.approx(np.log(0.25))
    e = warps.energies(points, smooth=2.0).first()
    assert (e.mean_rate, e.dirichlet, e.excess, e.data_term, e.energy, e.residual_max) == (1.0, 5.5, 1.5, 1.0, 12.0, 1.0)
    asked = spark.createDataFrame([(1, x) for x in (-1.0, 0.5, 1.0, 2.0, 9.0)], "pair long, t double")
    assert {r.t: r.phi for r in warps.at(points, asked).collect()} == {-1.0: 0.0, 0.5: 1.0, 1.0: 2.0, 2.0: 2.5, 9.0: 4.0}
    back = warps.at(points, asked.withColumnRenamed("t", "phi"), x="phi", y="t")
    assert {r.phi: r.t for r in back.collect()} == {-1.0: 0.0, 0.5: 0.25, 1.0: 0.5, 2.0: 1.0, 9.0: 4.0}


def test_fit_is_the_minimum(spark):
    rng = np.random.default_rng(5)
    for _ in range(20):
        n = int(rng.integers(3, 15))
        t, s = np.cumsum(rng.uniform(0.2, 1, n)), np.cumsum(rng.uniform(0.01, 2, n))
        smooth = float(rng.choice([0.0, 0.1, 3.0]))
        phi, freedom, _ = alignment.fit(t, s, smooth, 0.3)
        least = 0.3 * (s[-1] - s[0]) / (t[-1] - t[0])
        cost = lambda x: ((x - s) ** 2).sum() + smooth * (np.diff(x) ** 2 / np.diff(t)).sum()  # noqa: B023, E731
        assert phi[0] == s[0] and phi[-1] == pytest.approx(s[-1]) and (np.diff(phi) / np.diff(t) >= least - 1e-7).all() and 0 <= freedom <= n - 2 + 1e-9
        for _ in range(200):  # no step towards another allowed map is better
            other = s[0] + np.concatenate([[0], np.cumsum(least * np.diff(t) + (1 - 0.3) * (s[-1] - s[0]) * rng.dirichlet(np.full(n - 1, 0.5)))])
            assert cost(phi + 1e-3 * (other - phi)) >= cost(phi) - 1e-9
    line = spark.createDataFrame([(1, float(i), 2.0 * i + 0.05 * (-1) ** i) for i in range(12)] + [(2, 0.0, 1.0)], "pair long, t double, s double")
    swept = warps.sweep(line, [0.01, 1.0, 100.0])
    assert swept.count() == 3 and warps.smoothness(swept).collect()[0].smooth >= 1.0
    excess = [r.excess for r in swept.orderBy("smooth").collect()]
    assert excess == sorted(excess, reverse=True)


def test_pedal_carried_in(spark):
    m = take(spark, [(0, "control", 64, 100), (5, "control", 7, 0), (20, "control", 64, 0), (30, "note_on", 60, 1)])
    windows = spark.createDataFrame([(1, 10, 40)], "take long, start long, stop long")
    assert sorted((r.t, r.value) for r in performances.pedal_in(m, windows).collect()) == [(10, 100), (20, 0)]
    assert performances.pressed_at(m).collect() == [(1, 3, False)]


def test_captures(spark, tmp_path):
    head = "# capture 1\n# anchor_mach_ns 100\n# anchor_unix_ns 5000\n"
    for name, tail in (("a", "# end packets 2 dropped 0 ts_zero 0\n"), ("b", "# end packets 2 ts_zero 2\n"), ("c", "")):
        (tmp_path / name).write_text(head + "200 90 3C 64\n300 80 3C 40\n" + tail)
    capture.register(spark)
    rows = spark.read.format("capture").option("paths", "\n".join(str(tmp_path / n) for n in "abc")).load()
    found = {r.path[-1]: r for r in capture.takes(rows).collect()}
    assert {n: (r.packets, r.complete, r.timing) for n, r in found.items()} == {"a": (2, True, "hardware"), "b": (2, True, "untrusted"), "c": (2, False, "unknown")}
    assert found["a"].header["anchor_mach_ns"] == "100" and found["a"].trailer["packets"] == "2"
    assert sorted(r.unix_ns for r in capture.wall_times(rows).where("path like '%a'").collect()) == [5100, 5200]
    path = str(tmp_path / "a")
    size = (tmp_path / "a").stat().st_size
    known = capture.digest(path, size)
    with open(path, "a") as f:
        f.write("400 90 3C 64\n")
    assert capture.rewritten(path, size, known) == ""
    (tmp_path / "a").write_text("x" * (size + 5))
    assert capture.rewritten(path, size, known) == "changed" and capture.rewritten(path, size + 9, known) == "shrunk"
