"""Sessions, clusters, trills, search, alignment and expressions on hand vectors."""

import numpy as np
from pyspark.sql import functions as F

from tonefold.functions import metadata, notes, scores
from tonefold.operators import alignment, integrity, matching, sessions, stats

MS = 1_000_000


def test_clusters_are_anchored(spark):
    rows = [(1, 30 * MS * i, 60 + i) for i in range(8)] + [(2, 5 * MS * i, 60 + i) for i in range(4)]
    found = sessions.clusters(spark.createDataFrame(rows, "k long, t long, note int"), ["k"], 55 * MS).groupBy("k").agg(F.sort_array(F.collect_list("n")).alias("n"))
    assert {r.k: r.n for r in found.collect()} == {1: [2, 2, 2, 2], 2: [4]}


def test_sessions_keep_an_event_at_the_gap(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 10, 1), (1, 21, 2)], "k long, t long, seq long")
    assert [r.segment for r in sessions.split(df, "k", "t", 10, tie="seq").orderBy("t").collect()] == [0, 0, 1]


def test_trills(spark):
    def left(pitches, step):
        df = spark.createDataFrame([(1, i * step * MS, p) for i, p in enumerate(pitches)], "k long, ns long, pitch int")
        return [r.pitch for r in sessions.collapse_trills(df, ["k"]).orderBy("ns").collect()]

    assert left([60, 62, 60, 62, 60, 62, 60, 65], 60) == [60, 65]
    assert left([60, 62, 60, 62], 60) == [60, 62, 60, 62]
    assert left([60, 62, 60, 62, 60, 62, 60, 65], 400) == [60, 62, 60, 62, 60, 62, 60, 65]


def test_register_line(spark):
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate([70, 72, 71, 40, 69, 60, 45])], "k long, ns long, pitch int")
    assert [r.pitch for r in sessions.register_line(df, ["k"]).orderBy("ns").collect()] == [70, 72, 71, 69, 60]


def test_stop_grams_and_transposition(spark):
    tune = [60, 62, 64, 65, 67, 65, 64, 62, 60, 67, 72, 60]
    rows = [(t, i, p + 7 * t) for t in range(2) for i, p in enumerate(tune)] + [(2, i, 60 + i % 3) for i in range(12)]
    grams = sessions.ngrams(spark.createDataFrame(rows, "theme long, i long, p int"), ["theme"], ["i"], "p", n=4, clamp=15)
    best = matching.candidates(matching.votes(grams.where("theme = 0").withColumnRenamed("theme", "query"), matching.index(grams))).first()
    assert (best.theme, best.hits) == (1, 8) and abs(best.diagonal) <= 1  # votes also count for the neighbouring diagonals
    same = spark.createDataFrame([(t, i, p) for t in range(200) for i, p in enumerate(tune)], "theme long, i long, p int")
    assert matching.index(sessions.ngrams(same, ["theme"], ["i"], "p", n=4, clamp=15)).count() == 0


def test_alignment_of_a_played_copy(spark):
    rng = np.random.default_rng(3)
    t = np.cumsum(rng.uniform(0.3, 0.9, 60))
    chords = [sorted(int(x) for x in rng.choice(np.arange(48, 84), 3, replace=False)) for _ in t]
    rows = [(1, "a", float(x), c) for x, c in zip(t, chords)] + [(1, "b", float(1.2 * x + 3), c) for i, (x, c) in enumerate(zip(t, chords)) if i % 10]
    matches = alignment.align(spark.createDataFrame(rows, "pair long, side string, t double, notes array<int>"))
    got = [(r.i, r.j) for r in matches.orderBy("i").collect()]
    assert len(got) == 54 and all(i - j == i // 10 + 1 for i, j in got)
    quality = alignment.warp_quality(alignment.warps(matches, smooth=1e-6)).first()
    assert quality.rms < 1e-3 and quality.line_rms < 1e-6
    phi = alignment.fit_map(np.array([0.0, 1, 2, 3]), np.array([0.0, 2, 1, 3]), 0.0, 0.05)
    assert (np.diff(phi) >= 0.05 - 1e-9).all()


def test_exclusive_quantiles(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4, 20)], "k long, v double")
    row = stats.describe(df, ["k"], "v").first()
    assert (row.p10, row.median, row.mean, row.n) == (0.6, 3.0, 6.0, 5) and row.p90 > 20


def test_lattice_and_divisor(spark):
    def runs(ms):
        m = spark.createDataFrame([(1, i, x * MS, "other", 0, 0) for i, x in enumerate(ms)], "take long, seq long, ns long, kind string, note int, velocity int")
        r = integrity.lattice(m).first()
        return r.off_runs, r.restored

    assert runs([0, 5, 10, 25]) == (0, 0) and runs([0, 5, 11, 15, 20]) == (1, 1) and runs([0, 5, 11, 16]) == (1, 0)
    v = spark.createDataFrame([(1, x) for x in (12, 18, 30, 0)], "k long, v long")
    assert integrity.common_divisor(v, ["k"], "v").first().divisor == 6


def test_expressions(spark):
    df = spark.createDataFrame([("Gb4", "  <b>Op. 10,</b>  No. 3 ", "Dvořák, Antonín (1841-1904)", "3/4", "01:30")], "n string, t string, c string, f string, m string")
    row = df.select(notes.note_number(F.col("n")), notes.note_name(notes.note_number(F.col("n"))), metadata.clean(F.col("t")), metadata.opus(F.col("t")), metadata.surname(F.lit("Saint-Saëns, Camille (1835-1921)")), metadata.fraction(F.col("f")), metadata.fraction(F.lit("x")), notes.seconds_of(F.col("m")), notes.clock(F.lit(90.0))).first()
    assert tuple(row) == (66, "F#4", "Op. 10, No. 3", "Op. 10", "saintsaens", 0.75, 0.0, 90.0, "01:30")
    assert [r[0] for r in spark.range(1).select(F.explode(F.array(*[notes.message_length(F.lit(x)) for x in (0x90, 0xC0, 0xF1, 0xF2, 0xFE)]))).collect()] == [3, 2, 2, 3, 1]


def test_incipits(spark):
    rows = [("8,G'G''G'''G", ""), ("4''E", "bBEA"), ("4'FnFxFF/F", "xF"), ("8'A4G2E", ""), ("4.'E8F2G", ""), ("=7/8'GA", ""), ("4'G{}()!?@~A", ""), ("2'D^F^AE", ""), ("4'gFE+E-G", ""), (None, None)]
    out = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, c string, s string").select("i", scores.decode_incipit("c", "s").alias("x")).orderBy("i").collect()
    assert [r.x.pitches for r in out] == [[55, 67, 79, 91], [75], [66, 65, 66, 66, 66], [69, 67, 64], [64, 65, 67], [67, 69], [67, 69], [69, 64], [65, 64, 67], []]
    assert [r.x.onsets for r in out[3:6]] == [[0.0, 0.5, 1.5], [0.0, 1.5, 2.0], [0.0, 0.5]] and out[8].x.onsets == [0.0, 0.0, 3.0]


def test_midi_files():
    track = bytes.fromhex("00 90 3C 64 60 3C 00 00 FF 51 03 0F 42 40 83 60 90 40 50 00 FF 2F 00")
    data = b"MThd" + bytes([0, 0, 0, 6, 0, 0, 0, 1, 1, 0xE0]) + b"MTrk" + len(track).to_bytes(4, "big") + track
    got = [(round(x["seconds"], 6), x["data"].hex()) for x in scores.read_midi(data)]
    assert got == [(0.0, "903c64"), (0.1, "903c00"), (1.1, "904050")]
    assert scores.read_midi(b"none") == []
    back = scores.read_midi(scores.write_midi([0, 200, 100_000], [b"\x90\x3c\x64", b"\x80\x3c\x40", b"\xc0\x05"]))
    assert [(round(x["seconds"] * 960), x["data"]) for x in back] == [(0, b"\x90\x3c\x64"), (200, b"\x80\x3c\x40"), (100_000, b"\xc0\x05")]


def test_ranking_falls_back(spark):
    grams = spark.createDataFrame([(t, i, 7) for t in range(1, 5) for i in range(2)] + [(5, 0, 8), (6, 0, 9), (6, 1, 8)], "theme long, pos long, gram long")
    queries = spark.createDataFrame([(100, 7), (101, 8), (101, 7), (102, 9), (102, 8)], "query long, gram long")
    found = {(r.query, r.theme): r.votes for r in matching.ranked(queries, grams, cap=3).collect()}
    assert found == {**{(100, t): 2 for t in range(1, 5)}, (101, 5): 1, (101, 6): 1, (102, 6): 2}
    assert {r.query for r in matching.ranked(queries, grams, cap=0, part=0, beyond=False).collect()} == set()
    assert {(r.query, r.theme): r.votes for r in matching.ranked(queries, grams, cap=0, part=0).collect()} == {**{(100, t): 2 for t in range(1, 5)}, (101, 5): 1, (101, 6): 1, (102, 6): 1}


def test_index_keeps_its_share_at_any_size(spark):
    """The same corpus many times over, as other themes of other works: what is a stop-gram stays one, the rest stays."""
    def kept(copies):
        rows = [(100 * c + t, 50 * c + t // 2, i, i if i < 9 else 7) for c in range(copies) for t in range(100) for i in range(2 if t % 4 else 12)]
        return matching.index(spark.createDataFrame(rows, "theme long, work long, pos long, gram long"), most=6, part=0.2, least=2, share=0.6)

    small, large = kept(1), kept(4)
    assert large.count() == 4 * small.count() and {r.gram for r in small.select("gram").distinct().collect()} == {r.gram for r in large.select("gram").distinct().collect()} == {2, 3, 4, 5, 6, 8}
