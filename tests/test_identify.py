"""Lines, candidates and verdicts of segments: hand vectors, chunks of any size, streams."""

import random

from tonefold.operators import identify, matching, sessions
from tonefold.streaming import lines as streaming

MS = 1_000_000


def read(onsets, chunk=None):
    reader, out = identify.Reader(), []
    chunk = chunk or max(1, len(onsets))
    for i in range(0, len(onsets), chunk):
        out += reader.feed(onsets[i : i + chunk])
    return sorted(out + reader.feed([], end=True))


def pitches(found, line="top"):
    return [p for name, _, _, p in found if name == line]


def test_hand_vectors():
    assert len(pitches(read([(i * 5 * MS, 60 + i) for i in range(4)]))) == 1
    trill = [60, 62, 60, 62, 60, 62, 60, 65]
    assert pitches(read([(i * 60 * MS, p) for i, p in enumerate(trill)])) == [60, 65]
    assert pitches(read([(i * 60 * MS, p) for i, p in enumerate([60, 62, 60, 62])])) == [60, 62, 60, 62]
    assert pitches(read([(i * 400 * MS, p) for i, p in enumerate(trill)])) == trill
    chord = read([(0, 72), (10 * MS, 48), (300 * MS, 74), (301 * MS, 47), (600 * MS, 50), (900 * MS, 76)])
    assert (pitches(chord, "top"), pitches(chord, "bass"), pitches(chord, "mel")) == ([72, 74, 50, 76], [48, 47, 50, 76], [72, 74, 76])
    assert read([]) == []


def made(rng, n):
    ns, out = 0, []
    while len(out) < n:
        ns += rng.choice([5, 30, 60, 60, 60, 120, 400]) * MS
        base = rng.randint(50, 80)
        for p in [base, base + 1] * rng.choice([0, 0, 3, 4]) or [base]:
            out.append((ns, p))
            ns += 60 * MS
    return out[:n]


def test_chunks_don_t_matter():
    rng = random.Random(1)
    for _ in range(20):
        onsets = made(rng, rng.randint(1, 120))
        whole = read(onsets)
        assert [name for name, *_ in whole] and all(read(onsets, chunk) == whole for chunk in (1, 2, 3, 7, 50))


def test_verdicts(spark):
    rng = random.Random(2)
    tunes = {t: [rng.randint(55, 80) for _ in range(40)] for t in range(5)}
    themes = spark.createDataFrame([(t, i, p) for t, x in tunes.items() for i, p in enumerate(x)], "theme long, i long, pitch int")
    onsets = [(7, 0, i * 250 * MS, p + 3) for i, p in enumerate(tunes[2][5:35])] + [(7, 0, i * 250 * MS + 5 * MS, 30) for i in range(30)]
    onsets += [(7, 1, 10**12 + i * 250 * MS, p - 4) for i, p in enumerate(tunes[4][:30])] + [(8, 0, i * 250 * MS, rng.randint(55, 80)) for i in range(3)]
    rows = {(r.take, r.segment): r for r in identify.verdicts(spark.createDataFrame(onsets, "take long, segment long, ns long, note int"), themes).collect()}
    assert set(rows) == {(7, 0), (7, 1)}
    assert [(rows[k].theme, rows[k].sure, rows[k].notes) for k in sorted(rows)] == [("2", True, 60), ("4", True, 30)]
    assert rows[7, 0].line in ("mel", "top") and rows[7, 0].hits == 26 and 0 < rows[7, 0].margin <= 1


def test_works(spark):
    found = spark.createDataFrame([(1, 10, 5, 0.9), (1, 11, 4, 0.8), (1, 12, 4, 0.7)], "query long, theme long, votes long, score double")
    owners = spark.createDataFrame([(10, "x"), (11, "x"), (12, "y")], "theme long, work string")
    assert sorted((r.work, r.theme, r.place) for r in matching.works(found, owners).collect()) == [("x", 10, 1), ("y", 12, 2)]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows, seq = [], 0
    for take in (1, 2):
        at = 0
        for part in range(3):
            for ns, note in made(rng, 40):
                rows.append((take, seq, at + ns, "note_on", note, 90))
                seq += 1
            at = rows[-1][2] + 7_000_000_000
    rows += [(take, seq + take, 0, "end", 0, 0) for take in (1, 2)]
    schema = "take long, seq long, ns long, kind string, note int, velocity int"
    batch = sessions.split(spark.createDataFrame(rows, schema).where("kind = 'note_on'"), "take", "ns", 6_000_000_000, tie="seq")
    expected = sorted(map(tuple, identify.lines(batch).collect()))
    source = str(tmp_path / "in")
    for lo, hi in ((0, 70), (70, 71), (71, 200), (200, 1000)):
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], schema).coalesce(1).write.mode("append").parquet(source)
        stream = streaming.lines(spark.readStream.schema(schema).parquet(source))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("take", "segment", "line", "pos", "ns", "pitch").collect())) == expected and expected
