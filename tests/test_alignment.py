"""Correspondence against the full dynamic program, maps against a general solver, long pairs in bands."""

import random

import numpy as np
import pytest

from tonefold.operators import alignment, correspondence as c, warps

EVENTS = "pair long, side string, t double, notes array<int>"


def cost(a, b):
    a, b = set(a), set(b)
    part = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    return 1 - 0.75 * part(a, b) - 0.25 * part({n % 12 for n in a}, {n % 12 for n in b})


def full(a, b, prior=None, gap=0.25, tau=0.5, weight=0.5):
    """Smith-Waterman over all cells, in whole millionths; of equal ways a pair first, then an event of a left out."""
    n, m, g = len(a), len(b), round(gap * 10**6)
    best, step = np.zeros((n + 1, m + 1), np.int64), np.zeros((n + 1, m + 1), int)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            x = cost(a[i - 1][1], b[j - 1][1])
            pair = -(10**15)
            if x <= tau + 1e-9:
                pair = best[i - 1, j - 1] + int(np.rint(10**6 * (1 - x / tau)))
                if prior is not None:
                    pair -= int(np.rint(10**6 * weight * min(1.0, abs(prior[i - 1] - b[j - 1][0]) / 2.0)))
            ways = [pair, best[i - 1, j] - g, best[i, j - 1] - g]
            top = max(ways)
            if top > 0:
                best[i, j], step[i, j] = top, 1 + ways.index(top)
    i, j = np.unravel_index(int(best.argmax()), best.shape)
    score, out = int(best[i, j]), []
    while step[i, j]:
        if step[i, j] == 1:
            out.append((int(i) - 1, int(j) - 1))
        i, j = i - (step[i, j] != 3), j - (step[i, j] != 2)
    return (out[::-1], score / 10**6) if len(out) > 1 else ([], score / 10**6)


def played(rng, n, m, keys=6):
    """Two performances of one piece with events left out, added and changed."""
    piece = [sorted(rng.sample(range(60, 60 + keys), rng.randint(1, 2))) for _ in range(max(n, m))]
    sides = []
    for size, rate in ((n, 1.0), (m, 1.3)):
        t, side = 0.0, []
        for notes in piece[:size]:
            t += rate * rng.uniform(0.2, 1.0)
            roll = rng.random()
            if roll > 0.1:
                side.append((t, notes))
            if roll > 0.9:
                side.append((t + 0.1, [rng.randint(60, 60 + keys)]))
        sides.append(side)
    return sides


def rows_of(pairs):
    return [(p, side, t, notes) for p, (a, b) in pairs.items() for side, events in (("a", a), ("b", b)) for t, notes in events]


def test_equal_to_the_full_program(spark):
    rng = random.Random(7)
    pairs = {p: played(rng, rng.randint(1, 40), rng.randint(1, 40)) for p in range(40)}
    rows = c.indexed(spark.createDataFrame(rows_of(pairs), EVENTS).repartition(7))
    found = {}
    for r in c.correspond(rows).collect():
        found.setdefault(r.pair, []).append((r.i, r.j, r.t, r.s, r.cost, r.score))
    prior = {p: [t * rng.uniform(0.9, 1.5) for t, _ in a] for p, (a, _) in pairs.items()}
    expected = spark.createDataFrame([(p, i, x) for p, xs in prior.items() for i, x in enumerate(xs)], "pair long, n long, expected double")
    timed = {}
    for r in c.correspond(rows, prior=expected).collect():
        timed.setdefault(r.pair, []).append((r.i, r.j, r.t, r.s, r.cost, r.score))
    for p, (a, b) in pairs.items():
        for got, known in ((found, None), (timed, prior[p])):
            way, score = full(a, b, known)
            assert [x[:2] for x in sorted(got.get(p, []))] == way
            assert all(x[5] == score and x[2:4] == (a[x[0]][0], b[x[1]][0]) and x[4] == pytest.approx(cost(a[x[0]][1], b[x[1]][1])) for x in got.get(p, []))
    assert timed != found


def test_odd_rows(spark):
    rows = [(1, "a", 0.0, [60]), (1, "a", 1.0, [62]), (1, "a", None, [64]), (1, "a", 2.0, None), (1, "b", 0.0, [60, None, 300]), (1, "b", 1.0, [62]), (1, "c", 1.0, [62]), (None, "a", 0.0, [60])]
    rows += [(2, "a", 0.0, [60]), (2, "a", 1.0, [61])]  # no second side
    rows += [(3, s, float(i), [50 + 30 * (s == "b") + i % 5]) for s in "ab" for i in range(20)]  # no music in common
    rows += [(4, "a", 0.0, []), (4, "a", 1.0, []), (4, "b", 0.0, []), (4, "b", 1.0, [])]  # empty events are alike
    rows += [(5, s, 1.0, [n]) for s in "ab" for n in (64, 60, 62)]  # all at one time, in the order of notes
    found = c.correspond(c.indexed(spark.createDataFrame(rows, EVENTS))).collect()
    assert sorted((r.pair, r.i, r.j) for r in found) == [(1, 0, 0), (1, 1, 1), (4, 0, 0), (4, 1, 1), (5, 0, 0), (5, 1, 1), (5, 2, 2)]
    assert c.correspond(c.indexed(spark.createDataFrame([], EVENTS))).collect() == []
    with pytest.raises(ValueError):
        c.correspond(c.indexed(spark.createDataFrame(rows, EVENTS)), tau=0.0)


def test_bands_give_what_the_whole_gives(spark, monkeypatch):
    """Small blocks and bands, so that a pair of some hundred events runs over many blocks and bands are widened."""
    rng = random.Random(8)
    pairs = {1: played(rng, 300, 300, keys=20), 2: played(rng, 150, 300, keys=20), 3: played(rng, 40, 30)}
    a, b = pairs[2]
    pairs[4] = (a, [(t, n) for t, n in b[:20]] + [(40.0 + t, [rng.randint(90, 110)]) for t in range(200)] + [(300.0 + t, n) for t, n in b[20:]])  # a long insertion
    rows = c.indexed(spark.createDataFrame(rows_of(pairs), EVENTS))
    whole = sorted((r.pair, r.i, r.j) for r in c.correspond(rows).collect())
    for name, value in (("BLOCK", 32), ("WHOLE", 64), ("NEAR", 4), ("GRAM", 3)):
        monkeypatch.setattr(c, name, value)
    assert sorted((r.pair, r.i, r.j) for r in c.correspond(rows, half=24).collect()) == whole
    assert len({p for p, *_ in whole}) == 4


def test_a_long_pair_in_bounded_memory():
    """100,000 events on either side: the scan holds a band, whatever the length."""
    rng = np.random.default_rng(1)
    n, width = 100_000, 600
    notes = rng.integers(40, 90, n)
    low, high, classes = (np.where(notes < 64, np.uint64(1) << (notes % 64).astype(np.uint64), 0).astype(np.uint64), np.where(notes >= 64, np.uint64(1) << (notes % 64).astype(np.uint64), 0).astype(np.uint64), (np.uint64(1) << (notes % 12).astype(np.uint64)))
    t, forward, fed, held, steps = np.arange(n) * 0.25, c.Forward(0.25, 0.5, 0.5, 2.0), 0, 0, 0
    for i in range(0, n, 10):  # every tenth row is enough to tell
        lo, hi = max(0, i - width), min(n, i + width)
        if hi > fed:
            forward.add([x[fed:hi] for x in (t, low, high, classes)])
            fed = hi
        steps = max(steps, len(forward.step(i // 10, (int(low[i]), int(high[i]), int(classes[i])), float(t[i]), lo, hi)))
        held = max(held, len(forward.b[0]))
    assert held <= 2 * width + 10 and steps <= width // 2 + 1


def test_alternating(spark):
    """A repeated note whose pitch can't tell which is which: the second pass goes by time, and no pass loses matches."""
    rng = random.Random(3)
    a = [(i * 0.5, [60 + rng.randint(0, 11)]) for i in range(60)]
    a[30:34] = [(15.0, [72]), (15.5, [72]), (16.0, [72]), (16.5, [72])]
    b = [(1.1 * t + 2, notes) for k, (t, notes) in enumerate(a) if k not in (30, 31)]
    matches, fits = c.alternate(spark.createDataFrame(rows_of({1: (a, b), 2: (a[:2], b[:2])}), EVENTS), [0.01, 1.0])
    rows = {r.i: r.j for r in matches.where("pair = 1").collect()}
    assert len(rows) == 58 and rows[32] == 30 and rows[33] == 31 and 30 not in rows
    found = {r.pair: r for r in fits.collect()}
    assert found[1].first_matched == 58 and found[2].smooth is None and not found[2].refined


def test_census_accounts_for_everything(spark):
    rng = random.Random(5)
    pairs = {p: played(rng, 30, 40) for p in range(5)}
    rows = c.indexed(spark.createDataFrame(rows_of(pairs), EVENTS))
    matches = c.correspond(rows)
    for r in c.census(rows, matches).collect():
        a, b = pairs[r.pair]
        assert (r.events_a, r.events_b, r.notes_a) == (len(a), len(b), sum(len(set(x)) for _, x in a))
        assert r.matched + r.dropped_in_core_a + r.outside_core_a == r.events_a and r.matched + r.added_in_core_b + r.outside_core_b == r.events_b
        assert r.head_a + r.tail_a == r.outside_core_a and r.core_notes_b + r.outside_core_notes_b == r.notes_b and 0 < r.match_rate_core_a <= 1
        assert r.exact_pairs <= r.matched and r.core_start_a <= r.core_end_a


def test_fit_against_dense_solutions():
    """Ties, held stretches at both ends and in between, no smoothness: the conditions of a minimum hold, and freedom is the dense trace."""
    rng = np.random.default_rng(11)
    for k in range(200):
        n = int(rng.integers(2, 40))
        t = np.cumsum(rng.uniform(0.05, 1, n))
        s = np.sort(rng.integers(0, 6, n)).astype(float) if k % 2 else np.cumsum(rng.normal(0.4, 1.0, n))
        if s[-1] <= s[0]:
            continue
        smooth, part = float(rng.choice([0.0, 0.01, 0.5, 20.0])), float(rng.choice([0.0, 0.05, 0.6, 0.95]))
        phi, freedom, held = alignment.fit(t, s, smooth, part)
        h, total = np.diff(t), s[-1] - s[0]
        least = part * total / (t[-1] - t[0]) * h
        assert phi[0] == s[0] and phi[-1] == pytest.approx(s[-1]) and (np.diff(phi) >= least - 1e-8 * max(1, total)).all()
        system = np.eye(n - 2) + smooth * (np.diag(1 / h[:-1] + 1 / h[1:]) - np.diag(1 / h[1:-1], 1) - np.diag(1 / h[1:-1], -1))
        assert freedom == pytest.approx(float(np.trace(np.linalg.inv(system))) if n > 2 else 0.0)
        cost_of = lambda x: ((x - s) ** 2).sum() + smooth * (np.diff(x) ** 2 / h).sum()  # noqa: B023, E731
        for _ in range(40):
            rises = least + (total - least.sum()) * rng.dirichlet(np.full(n - 1, 0.3))
            other = s[0] + np.append(0.0, np.cumsum(rises))
            assert cost_of(phi + 1e-4 * (other - phi)) >= cost_of(phi) - 1e-9 * max(1.0, cost_of(phi))
    assert held >= 0


def test_fit_of_a_long_map():
    rng = np.random.default_rng(2)
    t = np.cumsum(rng.uniform(0.1, 0.5, 100_000))
    s = np.cumsum(rng.normal(0.3, 0.5, 100_000))
    phi, freedom, held = warps.fit(t, s, 1.0, 0.05)
    assert (np.diff(phi) > 0).all() and held > 0 and 0 < freedom < 100_000
