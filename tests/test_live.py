"""Live naming: the same announcements as in batch whatever the cuts, one for each segment, a state that doesn't grow with a segment."""

import random

import pytest

from tonefold.streaming import live

MET = "take long, segment long, place long, line string, q long, theme long, work long, pos long"


def made(rng, take, segment, length, tune=None, noise=30):
    """Agreements of a segment: of theme `tune` (of work tune // 2) from place 20 on, and chance ones."""
    rows = []
    for q in range(length):
        place = 1000 * segment + q
        if tune is not None and 20 <= q < 60 and rng.random() < 0.9:
            rows.append((take, segment, place, "mel", q, tune, tune // 2, q + 3))
        for _ in range(rng.randint(0, 2)):
            theme = rng.randrange(noise)
            rows.append((take, segment, place, rng.choice(["mel", "top", "bass"]), q, theme, theme // 2, rng.randrange(40)))
    return rows


def naive(rows):
    """Every place ranked anew from a list of all hits."""
    out, hits, announced = [], {}, False
    places = sorted({r[2] for r in rows})
    for place in places:
        for _, _, _, line, q, theme, work, pos in sorted(r for r in rows if r[2] == place):
            for d in (pos - q - 1, pos - q, pos - q + 1):
                run = hits.setdefault((line, theme, d, work), [])
                if run and len(run) < live.LEAST and q - run[-1] > live.LAG:
                    run.clear()
                run.append(q)
        votes = live.Votes({(line, theme, d): [work, len(x), x[0], x[-1]] for (line, theme, d, work), x in hits.items()})
        best = votes.best()
        if not announced and best and best[5] >= live.SURE:
            out.append((*best, place, True))
            announced = True
    return out or ([(*best, place, False)] if rows and best else [])


def test_replay_against_every_place_ranked_anew(spark):
    rng = random.Random(1)
    segments = {(1, 0): made(rng, 1, 0, 120, tune=5), (1, 1): made(rng, 1, 1, 90), (2, 0): made(rng, 2, 0, 700, tune=8), (3, 0): made(rng, 3, 0, 3)}
    rows = [r for s in segments.values() for r in s]
    rng.shuffle(rows)
    found = {}
    for r in live.replay(spark.createDataFrame(rows, MET).repartition(3)).collect():
        found.setdefault((r.take, r.segment), []).append(tuple(r)[2:])
    assert found == {k: naive(s) for k, s in segments.items() if s}
    assert found[1, 0][0][0] == 5 and found[1, 0][0][-1] and found[2, 0][0][0] == 8 and not found[1, 1][0][-1]


def test_state_of_a_long_segment_is_bounded():
    rng = random.Random(2)
    votes, most = live.Votes(), 0
    for q in range(20_000):
        votes.run([(q, "mel", q, theme, theme, rng.randrange(500)) for theme in rng.sample(range(400), 2)])
        most = max(most, len(votes.cells))
    assert most <= 3 * 2 * (live.LAG + live.CLEAR + 2)


def test_strong_rivals_of_other_works_silence_those_of_the_same_do_not():
    def sure(work):
        votes = live.Votes()
        for q in range(20):
            votes.run([(q, "mel", q, 1, 1, q), (q, "mel", q, 2, work, q + 9)])
        return votes.best()[5]

    assert sure(work=1) > live.SURE and sure(work=2) == 0.0


@pytest.mark.parametrize("cuts", [(0, 45, 46, 200, 2000), (0, 1000, 2000)])
def test_stream_equals_replay(spark, tmp_path, cuts):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(3)
    rows = [r for t in (1, 2) for s in (0, 1) for r in made(rng, t, s, 400, tune=4 if s == 0 else None)]
    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    batches = [[(*r, False) for r in rows if lo <= r[2] < hi] for lo, hi in zip(cuts, cuts[1:])]
    batches.append([(t, s, 0, "", 0, 0, 0, 0, True) for t in (1, 2) for s in (0, 1)])
    for batch in batches:
        spark.createDataFrame(batch, MET + ", over boolean").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(MET + ", over boolean").parquet(source)
        found = live.named(stream.where("NOT over").drop("over"), stream.where("over"), idle_ms=0)
        query = found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(180) and query.exception() is None
    expected = sorted(map(tuple, live.replay(spark.createDataFrame(rows, MET)).collect()))
    assert sorted(map(tuple, spark.read.parquet(out).select("take", "segment", *[c.split()[0] for c in live.FOUND.split(", ")]).collect())) == expected
    assert [r[-1] for r in expected] == [True, False, True, False]


def test_idle_segments_are_closed_by_a_timer(spark, tmp_path):
    import time

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, name = str(tmp_path / "in"), "closed_by_a_timer"
    send = lambda take: spark.createDataFrame([(take, 0, 5, "mel", 5, 3, 1, 9)], MET).coalesce(1).write.mode("append").parquet(source)
    send(1)
    stream = live.named(spark.readStream.schema(MET).parquet(source), idle_ms=500)
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        for take in (1, 2):
            if take > 1:
                send(take)
            until = time.time() + 60
            while spark.table(name).where(f"take = {take}").isEmpty() and query.isActive and time.time() < until:
                time.sleep(0.5)
        assert query.exception() is None
        assert sorted(r.take for r in spark.table(name).collect()) == [1, 2]  # each closed once
    finally:
        query.stop()
