"""Pairing, framing and accounting on hand vectors."""

from pyspark.sql import functions as F

from tonefold.operators import framing, integrity, intervals, pairing

MESSAGE = "take long, seq long, ns long, kind string, note int, velocity int"
S = 1_000_000_000


def take(spark, rows):
    return spark.createDataFrame([(1, i, ns, kind, note, v) for i, (ns, kind, note, v) in enumerate(rows)], MESSAGE)


def test_restrike_truncates(spark):
    m = take(spark, [(0, "note_on", 60, 100), (S // 2, "note_on", 60, 90), (9 * S // 10, "note_off", 60, 64)])
    rows = pairing.intervals(m).orderBy("ns_on").collect()
    assert [(r.ns_on, r.ns_off, r.closure) for r in rows] == [(0, S // 2, "restrike"), (S // 2, 9 * S // 10, "note_off")]
    assert [tuple(r) for r in pairing.overwriting_pairs(m).select("ns_on", "ns_off").collect()] == [(S // 2, 9 * S // 10)]


def test_every_message_has_one_role(spark):
    m = take(spark, [(0, "note_on", 60, 1), (1, "note_off", 62, 1), (2, "control", 64, 127), (3, "other", 0, 0), (4, "note_off", 60, 1), (5, "note_on", 61, 1)])
    roles = {r.seq: r.role for r in pairing.roles(m).collect()}
    assert roles == {0: "interval_on", 1: "orphan_note_off", 2: "pedal", 3: "other", 4: "interval_off", 5: "interval_on"}
    assert m.count() == len(roles)


def test_defects_and_losses(spark):
    m = take(spark, [(0, "note_off", 60, 1), (S, "note_on", 62, 1), (2 * S, "note_on", 62, 1), (S, "note_off", 62, 1), (40 * S, "note_on", 64, 1), (80 * S, "note_off", 64, 1)])
    counts = {r.cls: r.n for r in pairing.defect_counts(m).collect()}
    assert counts == {"orphan_note_off": 1, "restrike": 1, "end_of_take": 0, "non_monotone_timestamp": 1, "implausible_duration": 1, "undecodable": 0}
    assert pairing.intervals(m).where("ns_off < ns_on").count() == 0
    row = integrity.losses(m).first()
    assert (row.inferred_lost, row.verdict) == (2, "SUSPECT")


def test_framing(spark):
    data = [bytes.fromhex("903C64904050B0407F"), bytes.fromhex("903C"), bytes.fromhex("F07E01F7FE"), b"", bytes.fromhex("C005903C00")]
    packets = spark.createDataFrame([(1, i, 7 * i, d) for i, d in enumerate(data)], "take long, packet_seq long, ns long, data binary")
    rows = framing.framed(packets).orderBy("seq").collect()
    assert [r.kind for r in rows] == ["note_on", "note_on", "control", "undecodable", "system", "system", "program", "note_off"]
    assert [r.seq for r in rows] == list(range(8)) and {r.ns for r in rows[:3]} == {0}


def test_interval_laws(spark):
    rows = [(1, 60, 0, 10, 5), (1, 61, 10, 20, 3), (1, 62, 30, 40, 2), (1, 60, 32, 36, 4), (1, 60, 36, 36, 9)]
    x = spark.createDataFrame(rows, "take long, note int, a long, b long, weight long")
    union = intervals.merge(x, ["take"])
    assert sorted((r.a, r.b) for r in union.collect()) == [(0, 20), (30, 40)]
    spans = spark.createDataFrame([(1, 0, 50)], "take long, start long, stop long")
    free = [(r.a, r.b) for r in intervals.plateaus(union, spans, "take").orderBy("a").collect()]
    assert free == [(20, 30), (40, 50)]
    assert sum(b - a for a, b in free) + intervals.measure(union, ["take"]).first().measure == 50
    at = spark.createDataFrame([(1, t) for t in (0, 5, 20, 34, 99)], "take long, t long")
    expected = {t: sum(w * max(0, min(t, b) - a) for _, _, a, b, w in rows) for t in (0, 5, 20, 34, 99)}
    assert {r.t: r.f for r in intervals.cumulative(x, at, "take").collect()} == expected
    assert intervals.energy(x, ["take"]).first().energy == expected[99]
    assert intervals.closed_peak(x, "take").first().peak == 3
    assert intervals.levels(x, "take", bucket_ns=7).agg(F.max("level")).first()[0] == 2
    assert intervals.variation(intervals.jump_measure(x, ["take", "note"]), ["take"]).first().l1 == 2 * (5 + 3 + 2 + 4)
