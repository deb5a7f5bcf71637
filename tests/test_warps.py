"""Maps fitted together: the same as one by one, without a call for each."""

import numpy as np

from tonefold.operators import warps

SMOOTHS = [0.001, 0.01, 0.1, 1.0, 10.0, 100.0]


def made(rng, maps, n):
    t, s = np.cumsum(rng.choice([0.3, 1.0, 2.0], (maps, n)), 1), np.cumsum(rng.choice([-3.0, 0.0, 1.0, 2.0, 20.0, 50.0], (maps, n)), 1)
    rising = s[:, -1] > s[:, 0]
    return t[rising], s[rising]


def test_together_as_one_by_one():
    rng, held_at_all = np.random.default_rng(5), 0
    for n in (2, 3, 4, 5, 7, 12, 32, 33):
        for least in (0.0, 0.05, 0.6, 1.0):
            t, s = made(rng, 30, n)
            smooth = rng.choice(SMOOTHS, len(t))
            phi, freedom, held = warps.fit_all(t, s, smooth, least)
            for i in range(len(t)):
                alone = warps.fit(t[i], s[i], float(smooth[i]), least)
                assert (alone[0] == phi[i]).all() and alone[1:] == (freedom[i], held[i])
                held_at_all += alone[2] > 0
    assert held_at_all > 100


def test_short_maps_need_no_call_each(monkeypatch):
    calls = []
    monkeypatch.setattr(warps, "fit", lambda *a: calls.append(a))
    t = np.tile(np.arange(7.0), (3000, 1))
    s = np.cumsum(np.random.default_rng(6).integers(1, 51, t.shape).astype(float), 1)
    phi, _, held = warps.fit_all(t, s, np.full(len(t), 0.001), 0.05)
    assert not calls and (held > 0).sum() > 100 and np.allclose(phi[:, -1], s[:, -1])


def test_corners_of_rows(spark):
    rng, rows = np.random.default_rng(7), []
    for pair in range(60):
        n = int(rng.integers(1, 9)) if pair else 40
        rows += [(pair, float(i), float(v)) for i, v in enumerate(np.cumsum(rng.integers(0, 51, n)))]
    rows += [(100, 0.0, 5.0), (100, 1.0, 7.0), (100, 2.0, 5.0), (101, 0.0, 1.0), (101, None, 2.0), (101, 1.0, 3.0), (101, 2.0, None)]
    matches = spark.createDataFrame(rows, "pair long, t double, s double")
    for smooths in (SMOOTHS, SMOOTHS[::-1], SMOOTHS[:5], SMOOTHS[:3], [10.0]):
        swept = warps.sweep(matches, smooths)
        assert sorted(map(tuple, warps.corners(matches, smooths).collect())) == sorted(map(tuple, warps.corner(swept).collect()))
    one = {(r.pair, r.smooth): (r.n, r.data_term, r.freedom, r.held) for r in warps.sweep(matches, SMOOTHS).collect()}
    for pair in {p for p, *_ in rows}:
        t, s = (np.array(x) for x in zip(*[(t, s) for p, t, s in rows if p == pair and t is not None and s is not None]))
        if len(t) < 3 or s[-1] <= s[0]:
            assert (pair, 1.0) not in one
            continue
        for smooth in SMOOTHS:
            phi, freedom, held = warps.fit(t, s, smooth, 0.05)
            n, data, free, stretches = one[pair, smooth]
            assert (n, stretches) == (len(t) - 2, held) and np.allclose([data, free], [((phi - s) ** 2).sum(), freedom], rtol=1e-12, atol=1e-12)
