"""Centroid clustering against brute force in whole numbers."""

import hashlib
import math
import random

import numpy as np

from tonefold.llm import centroids


def expected(rows, k, rounds=5, dimensions=4):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [list(v) for _, v in first]

    def assigned():
        found = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            found.append((d.index(min(d)), min(d)))
        return found

    for _ in range(rounds):
        cluster = assigned()
        for c in range(len(centres)):
            mine = [v for (_, v), (x, _) in zip(kept, cluster) if x == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine)]
    cluster = assigned()
    inertia = sum(d for _, d in cluster)
    of = {c: sum(d for x, d in cluster if x == c) for c in range(len(centres))}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, of[c], inertia, digest[c]) for (i, _), (c, d) in zip(kept, cluster)), key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=str)


def test_ties_repeats_and_what_is_left_out(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice((-1.0, -0.5, 0.0, 0.5, 0.25)) for _ in range(4)]) for i in range(300)]  # few values: many ties and repeats
    rows += [(7, rows[0][1]), (None, [0.1, 0.2, 0.3, 0.4]), (None, [0.1, 0.2, 0.3, 0.5]), (400, None), (401, [1.0, 2.0, 3.0]), (402, [1.0, None, 0.0, 0.0]), (403, [float("nan"), 0.0, 0.0, 0.0]), (404, [float("-inf"), 0.0, 0.0, 0.0]), (405, []), (406, [1e9, 0.0, 0.0, 0.0]), (407, [524287.9, -524287.9, 524287.9, -524287.9])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(5)
    for k, leading in ((6, 2), (6, 4), (40, 1)):
        found = rows_of(centroids.cluster(df, k=k, dimensions=4, leading=leading))
        assert found == expected(rows, k)
    assert {r[0] for r in found}.isdisjoint({400, 401, 402, 403, 404, 405, 406}) and 407 in {r[0] for r in found}


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert rows_of(centroids.cluster(df, k=40, dimensions=4)) == expected(rows, 40)
    assert rows_of(centroids.cluster(df.limit(0), k=40, dimensions=4)) == []


def test_bound_never_prunes_the_nearest():
    """Any orthogonal rotation, vectors on lines and planes, and far from the origin."""
    rng = np.random.default_rng(1)
    for shift, spread in ((0, 3), (10**6, 2), (-(2**26), 5)):
        v = rng.integers(-spread, spread + 1, (500, 8)) + shift
        v[:, 5:] = shift
        c = v[rng.choice(500, 12, replace=False)]
        axes = np.linalg.qr(rng.normal(size=(8, 8)))[0]
        for leading in (1, 3, 8):
            found, distance, computed = centroids.nearest(v, *centroids._projected(v, axes, leading), c, axes)
            d = ((v[:, None] - c[None]) ** 2).sum(2)
            assert (found == d.argmin(1)).all() and (distance == d.min(1)).all() and len(v) <= computed <= d.size


def test_pruning_saves_distances_where_axes_differ():
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(size=(2000, 64)) * (400 / (1 + np.arange(64)))).astype(np.int64)
    axes = np.linalg.qr(np.linalg.eigh(np.cov(v.T))[1][:, ::-1])[0]
    *_, computed = centroids.nearest(v, *centroids._projected(v, axes, 16), v[:40], axes)
    assert computed < 3 * len(v)
