"""Further registered queries: readings of takes, performances, time maps, names; with DuckDB SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import metadata, notes
from ..operators import history, identify, ingest, intervals, matching, nearest, pairing, performances, sessions, stats, warps
from ..sources.stored import shared_folder
from ..sources.streams import MESSAGES_SQL, table
from .catalog import HOUR_NS, _asked, _DESCRIBED, _grams, _messages, _SCORED, _PAIRED, _segments, _SEGMENTS, _UNION, _weighted, query


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).groupBy("take").agg(F.min("ns").alias("start"), F.max("ns").alias("stop"))


@query(f"{_PAIRED} SELECT take, note, on_seq, off_seq, ns_on, ns_off, velocity_on, velocity_off FROM iv WHERE trusted")
def trusted_intervals(spark, sf_dir):
    return pairing.intervals(_messages(spark, sf_dir)).where("trusted").select("take", "note", "on_seq", "off_seq", "ns_on", "ns_off", "velocity_on", "velocity_off")


@query(f"WITH {MESSAGES_SQL} SELECT take, seq, ns, note AS controller, velocity AS value FROM m WHERE kind = 'control'")
def controls(spark, sf_dir):
    return _messages(spark, sf_dir).where("kind = 'control'").select("take", "seq", "ns", F.col("note").alias("controller"), F.col("velocity").alias("value"))


@query(f"WITH {MESSAGES_SQL} SELECT take, velocity AS value, COUNT(*) AS n, COUNT(*) FILTER (WHERE velocity >= 64) AS down FROM m WHERE kind = 'control' AND note = 64 GROUP BY ALL")
def pedal_values(spark, sf_dir):
    rows = _messages(spark, sf_dir).where("kind = 'control' AND note = 64")
    return rows.groupBy("take", F.col("velocity").alias("value")).agg(F.count("*").alias("n"), F.count_if(F.col("velocity") >= 64).alias("down"))


@query(f"""{_PAIRED}
SELECT take, seq, role AS cls FROM ro WHERE role IN ('orphan_note_off', 'undecodable') UNION ALL SELECT take, on_seq, closure FROM iv WHERE closure <> 'note_off'
UNION ALL SELECT take, on_seq, 'implausible_duration' FROM iv WHERE closure <> 'end_of_take' AND ns_off - ns_on >= {pairing.IMPLAUSIBLE_NS}
UNION ALL SELECT take, seq, 'non_monotone_timestamp' FROM (SELECT *, MAX(ns) OVER (PARTITION BY take ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM m) WHERE ns < reached""")
def defect_instances(spark, sf_dir):
    return pairing.defects(_messages(spark, sf_dir))


@query(f"WITH {MESSAGES_SQL}, s AS (SELECT take, (ns - LAG(ns) OVER (PARTITION BY take ORDER BY seq)) / 1000000000 AS v FROM m WHERE kind = 'note_on'), {_DESCRIBED}")
def onset_gaps(spark, sf_dir):
    """Times between strikes."""
    from ..operators import integrity

    gaps = integrity.gaps(_messages(spark, sf_dir).where("kind = 'note_on'"))
    return stats.describe(gaps.withColumn("seconds", F.col("gap") / 1000000000), ["take"], "seconds")


@query(f"""{_PAIRED}, r AS (SELECT take, COUNT(*) AS r FROM ro GROUP BY take), h AS (SELECT take, COUNT(*) AS h FROM iv WHERE closure = 'end_of_take' GROUP BY take),
w AS (SELECT take, COUNT(*) AS messages, COUNT(DISTINCT ns) AS packets, MIN(ns) AS first_ns, MAX(ns) AS last_ns, COUNT(*) FILTER (WHERE kind = 'note_on') AS ons FROM m GROUP BY take)
SELECT w.take, messages, packets, first_ns, last_ns, last_ns - first_ns AS length_ns, ons, COALESCE(h, 0) AS open_notes, r = messages AS accounted FROM w JOIN r ON r.take = w.take LEFT JOIN h ON h.take = w.take""")
def take_spans(spark, sf_dir):
    return performances.take_spans(_messages(spark, sf_dir))


@query(f"{_PAIRED} SELECT take, note, on_seq FROM iv WHERE closure = 'end_of_take'")
def open_notes(spark, sf_dir):
    return pairing.intervals(_messages(spark, sf_dir)).where("closure = 'end_of_take'").select("take", "note", "on_seq")


@query(f"""{_UNION},
e AS (SELECT take, a, b FROM u UNION ALL SELECT take, start_ns, start_ns FROM ends UNION ALL SELECT take, end_ns, end_ns FROM ends),
f AS (SELECT take, MAX(b) OVER (PARTITION BY take ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS a, LEAD(a) OVER (PARTITION BY take ORDER BY a, b) AS b FROM e),
fr AS (SELECT take, COUNT(*) AS plateaus, SUM(b - a) AS pm FROM f WHERE b > a GROUP BY take),
su AS (SELECT take, SUM(b - a) AS support, COUNT(*) AS islands FROM u GROUP BY take),
kr AS (SELECT *, MAX(b) OVER (PARTITION BY take, note ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
ki AS (SELECT *, SUM(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY take, note ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM kr),
ks AS (SELECT take, SUM(b - a) AS s FROM (SELECT take, note, MIN(a) AS a, MAX(b) AS b FROM ki GROUP BY take, note, island) GROUP BY take),
en AS (SELECT take, SUM(CAST(weight AS HUGEINT) * ((b - a) // 1000)) AS e FROM x GROUP BY take)
SELECT ends.take, CAST(support AS BIGINT) AS support, end_ns - start_ns AS length, ROUND(support / NULLIF(end_ns - start_ns, 0), 6) AS duty, islands, COALESCE(plateaus, 0) AS plateaus, CAST(COALESCE(pm, 0) AS BIGINT) AS plateau_measure,
  CAST(s AS BIGINT) AS key_support, CAST(e AS BIGINT) AS energy FROM ends JOIN su ON su.take = ends.take JOIN ks ON ks.take = ends.take JOIN en ON en.take = ends.take LEFT JOIN fr ON fr.take = ends.take""")
def support_measures(spark, sf_dir):
    return performances.measures(_weighted(spark, sf_dir), _spans(spark, sf_dir))


_WIDTHS = (6, 24, 96)


@query(" UNION ALL ".join(f"""SELECT * FROM (WITH {MESSAGES_SQL}, z AS (SELECT take, MIN(ns) AS t0, (MAX(ns) - MIN(ns)) // {w * HOUR_NS} AS bins FROM m GROUP BY take),
c AS (SELECT m.take, (ns - t0) // {w * HOUR_NS} AS bin, COUNT(*) AS c FROM m JOIN z ON m.take = z.take WHERE (ns - t0) // {w * HOUR_NS} < bins GROUP BY ALL),
s AS (SELECT take, SUM(c) AS s, SUM(c * c) AS q FROM c GROUP BY take)
SELECT z.take, {w} AS hours, bins, ROUND((q / bins - (s / bins) * (s / bins)) / (s / bins), 6) AS fano FROM z JOIN s ON z.take = s.take WHERE bins > 0)""" for w in _WIDTHS))
def fano_curve(spark, sf_dir):
    """Variance over mean of message counts, over windows of several widths."""
    parts = [stats.fano(_messages(spark, sf_dir), ["take"], "ns", w * HOUR_NS).withColumn("hours", F.lit(w)) for w in _WIDTHS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("take", "hours", "bins", "fano")


@query(f"""WITH {MESSAGES_SQL}, o AS (SELECT take, seq, ns FROM m WHERE kind = 'note_on'), z AS (SELECT take, MIN(ns) AS t0, MAX(ns) - MIN(ns) AS span FROM o GROUP BY take),
p AS (SELECT o.take, -1 AS sample, span, ns - t0 AS x FROM o JOIN z ON z.take = o.take UNION ALL
  SELECT o.take, sample, span, CAST(floor(CAST(CAST('0x' || substr(sha256(sample || ':' || o.take || ':' || seq), 1, 13) AS BIGINT) AS DOUBLE) * CAST(span AS DOUBLE) / 4503599627370496) AS BIGINT) FROM o JOIN z ON z.take = o.take, (SELECT unnest(range(9)) AS sample)),
b AS (SELECT take, sample, width, span // width AS bins, x // width AS bin FROM p, (SELECT unnest([{", ".join(str(w * HOUR_NS) for w in _WIDTHS)}]) AS width)),
c AS (SELECT take, sample, width, bins, bin, COUNT(*) AS c FROM b WHERE bins >= 3 AND bin < bins GROUP BY ALL), s AS (SELECT take, sample, width, bins, SUM(c) AS s, SUM(c * c) AS q FROM c GROUP BY ALL),
f AS (SELECT take, sample, width, bins, ROUND((q / bins - (s / bins) * (s / bins)) / (s / bins), 6) AS v FROM s)
SELECT take, width, bins, MAX(v) FILTER (WHERE sample = -1) AS fano, MAX(v) FILTER (WHERE sample = 0) AS poisson, MIN(v) FILTER (WHERE sample >= 0) AS low, MAX(v) FILTER (WHERE sample >= 0) AS high FROM f GROUP BY ALL""")
def fano_bands(spark, sf_dir):
    """The dispersion of strikes beside that of nine surrogates of as many strikes, evenly at random over the same span."""
    strikes = _messages(spark, sf_dir).where("kind = 'note_on'")
    return stats.fano_bands(strikes, ["take"], "ns", "seq", tuple(w * HOUR_NS for w in _WIDTHS))


@query(f"""WITH {MESSAGES_SQL}, q AS (SELECT take, seq, ns FROM m WHERE kind = 'note_on'), c AS (SELECT take, ns, MIN(seq) AS control FROM m WHERE kind = 'control' GROUP BY ALL),
n AS (SELECT q.take, q.seq, control, ABS(c.ns - q.ns) AS distance, c.ns < q.ns AS before FROM q JOIN c ON c.take = q.take AND ABS(c.ns - q.ns) <= {24 * HOUR_NS} QUALIFY ROW_NUMBER() OVER (PARTITION BY q.take, q.seq ORDER BY ABS(c.ns - q.ns), c.ns) = 1)
SELECT q.take, q.seq, control, distance, before FROM q LEFT JOIN n ON n.take = q.take AND n.seq = q.seq""")
def nearest_controls(spark, sf_dir):
    """The control message nearest to each strike, at most a day before or after it."""
    heard = _messages(spark, sf_dir)
    found = nearest.nearest(heard.where("kind = 'control'"), heard.where("kind = 'note_on'"), ["take"], "ns", "seq", 24 * HOUR_NS)
    return found.select("take", "seq", F.col("near.value").alias("control"), F.col("near.distance").alias("distance"), (F.col("near.at") < F.col("ns")).alias("before"))


@query(f"""WITH {MESSAGES_SQL}, g AS (SELECT * FROM (SELECT take, ns - LAG(ns) OVER (PARTITION BY take ORDER BY seq) AS gap FROM m) WHERE gap > 0),
h AS (SELECT take, s, COUNT(*) AS n, COUNT(*) FILTER (WHERE gap % s = 0) AS h FROM g, (SELECT unnest({list(performances.STEPS)}) AS s) GROUP BY take, s)
SELECT take, CAST(s AS BIGINT) AS step, n AS gaps, n - h AS off FROM h WHERE 100 * h >= 99 * n QUALIFY ROW_NUMBER() OVER (PARTITION BY take ORDER BY s DESC) = 1""")
def grid_steps(spark, sf_dir):
    return performances.grid_step(_messages(spark, sf_dir))


@query(f"""{_PAIRED}, p AS (SELECT r.take, COUNT(*) FILTER (WHERE role = 'pedal') AS pedal_events, COUNT(*) FILTER (WHERE role = 'orphan_note_off') AS orphan_offs FROM ro r GROUP BY r.take),
c AS (SELECT take, COUNT(*) AS strikes, COUNT(*) FILTER (WHERE closure = 'restrike') AS retriggers, COUNT(*) FILTER (WHERE closure = 'end_of_take') AS orphan_ons FROM iv GROUP BY take),
l AS (SELECT take, CAST(arg_max(velocity, seq) >= 64 AS INTEGER) AS pedal_open FROM m WHERE kind = 'control' AND note = 64 GROUP BY take),
a AS (SELECT p.take, COALESCE(strikes, 0) AS strikes, orphan_offs, COALESCE(retriggers, 0) AS retriggers, COALESCE(orphan_ons, 0) AS orphan_ons, CAST(0 AS BIGINT) AS out_of_range, pedal_events, COALESCE(pedal_open, 0) AS pedal_open
  FROM p LEFT JOIN c ON c.take = p.take LEFT JOIN l ON l.take = p.take)
SELECT *, orphan_offs + retriggers + orphan_ons + out_of_range + pedal_open = 0 AS clean FROM a""")
def performance_repairs(spark, sf_dir):
    return performances.repairs(_messages(spark, sf_dir))


@query(f"{_PAIRED} SELECT take, note, ns_on, ns_off, velocity_on AS velocity, closure FROM iv WHERE closure <> 'end_of_take' AND note BETWEEN 21 AND 108")
def performed_notes(spark, sf_dir):
    """Notes of each take, those still open at its end left out."""
    return performances.perform(_messages(spark, sf_dir), orphans="drop")


@query(f"""{_PAIRED}, w AS (SELECT take, start_ns + (end_ns - start_ns) // 3 AS lo, start_ns + 2 * ((end_ns - start_ns) // 3) AS hi FROM ends),
p AS (SELECT m.take, ns, velocity, seq, lo, hi FROM m JOIN w ON w.take = m.take WHERE kind = 'control' AND note = 64), i AS (SELECT take, ns AS t, velocity AS value FROM p WHERE ns BETWEEN lo AND hi),
b AS (SELECT take, lo AS t, arg_max(velocity, ns * 1000000 + seq % 1000000) AS value FROM p WHERE ns < lo GROUP BY take, lo)
SELECT * FROM i UNION ALL SELECT * FROM b WHERE value >= 64 AND NOT EXISTS (SELECT 1 FROM i WHERE i.take = b.take AND i.t = b.t)""".replace("ns * 1000000 + seq % 1000000", "CAST(ns AS HUGEINT) * 1000000000 + seq"))
def pedal_in_middle(spark, sf_dir):
    """The pedal over the middle third of each take, with the state that it comes in with."""
    third = F.floor((F.col("stop") - F.col("start")) / 3)
    windows = _spans(spark, sf_dir).select("take", (F.col("start") + third).alias("start"), (F.col("start") + 2 * third).alias("stop"))
    return performances.pedal_in(_messages(spark, sf_dir), windows)


@query(f"""WITH {MESSAGES_SQL}, s AS (SELECT take, seq, kind, LAST_VALUE(CASE WHEN kind = 'control' AND note = 64 THEN velocity >= 64 END IGNORE NULLS) OVER (PARTITION BY take ORDER BY seq ROWS UNBOUNDED PRECEDING) AS down FROM m)
SELECT take, seq, COALESCE(down, FALSE) AS down FROM s WHERE kind = 'note_on'""")
def pedal_at_strikes(spark, sf_dir):
    return performances.pressed_at(_messages(spark, sf_dir))


@query(f"{_PAIRED} SELECT take, COUNT(DISTINCT note) AS keys, MIN(note) AS low, MAX(note) AS high, COUNT(*) AS strikes, COUNT(*) FILTER (WHERE ns_on = ns_off) AS degenerate FROM iv GROUP BY take")
def active_keys(spark, sf_dir):
    found = pairing.intervals(_messages(spark, sf_dir))
    return found.groupBy("take").agg(F.count_distinct("note").alias("keys"), F.min("note").alias("low"), F.max("note").alias("high"), F.count("*").alias("strikes"), F.count_if(F.col("ns_on") == F.col("ns_off")).alias("degenerate"))


@query(f"{_PAIRED}, q AS (SELECT take, seq, ns FROM m WHERE kind = 'control') SELECT q.take, q.seq, COUNT(x.a) AS level FROM q LEFT JOIN x ON x.take = q.take AND a <= ns AND ns < b GROUP BY ALL")
def polyphony_at_controls(spark, sf_dir):
    """How many notes sound at each control message, from the swept levels."""
    asked = _messages(spark, sf_dir).where("kind = 'control'").select("take", F.col("ns").alias("t"), "seq")
    levels = intervals.levels(_weighted(spark, sf_dir), "take").select("take", "t", F.col("level").cast("long").alias("level"))
    found = performances.as_of(levels, asked.select("take", "t").distinct(), ["take"], ["t"], "level", F.floor(F.col("t") / intervals.SWEEP_NS))
    return asked.join(found, ["take", "t"]).select("take", "seq", F.coalesce("level", F.lit(0)).cast("long").alias("level"))


@query(f"""{_SEGMENTS}, z AS (SELECT take, segment, MIN(ns) AS t0 FROM sg GROUP BY ALL)
SELECT sg.take, CAST(sg.segment AS BIGINT) AS segment, seq, ns - t0 AS t FROM sg JOIN z ON z.take = sg.take AND z.segment = sg.segment WHERE ns - t0 <= {HOUR_NS}""")
def segment_openings(spark, sf_dir):
    """Messages of the first hour of each segment, timed from its start."""
    rows = _segments(spark, sf_dir)
    start = rows.groupBy("take", "segment").agg(F.min("ns").alias("t0"))
    return rows.join(start, ["take", "segment"]).withColumn("t", F.col("ns") - F.col("t0")).where(F.col("t") <= HOUR_NS).select("take", "segment", "seq", "t")


def _themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of melodies: what each take plays, and the quantities of each supplier's lines as pitches."""
    played = _messages(spark, sf_dir).where("kind = 'note_on'").select(F.col("take").alias("theme"), F.col("seq").alias("i"), F.col("note").alias("pitch"))
    order = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select((F.lit(1 << 40) + F.col("l_suppkey")).alias("theme"), order.alias("i"), (60 + F.pmod(F.floor("l_quantity"), F.lit(12))).cast("int").alias("pitch"))
    return played.unionByName(lines)


def _onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strikes in segments that end at gaps of a month."""
    strikes = _messages(spark, sf_dir).where("kind = 'note_on'")
    return sessions.split(strikes, "take", "ns", 720 * HOUR_NS, tie="seq").select("take", "segment", "ns", "note")


@query()
def take_lines(spark, sf_dir):
    """The three lines of each segment."""
    return identify.lines(_onsets(spark, sf_dir), cluster_ns=HOUR_NS // 60, ornament_ns=HOUR_NS)


@query()
def line_candidates(spark, sf_dir):
    """The best theme of each line of each segment."""
    return identify.candidates(identify.lines(_onsets(spark, sf_dir), cluster_ns=HOUR_NS // 60, ornament_ns=HOUR_NS), _themes(spark, sf_dir))


@query()
def segment_verdicts(spark, sf_dir):
    """What each segment is most like, and whether that is sure."""
    return identify.verdicts(_onsets(spark, sf_dir), _themes(spark, sf_dir), cluster_ns=HOUR_NS // 60, ornament_ns=HOUR_NS)


@query(f"""{_SCORED}, tp AS (SELECT * FROM sc QUALIFY ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, votes DESC, theme) <= 200),
wk AS (SELECT * FROM tp QUALIFY ROW_NUMBER() OVER (PARTITION BY query, work ORDER BY score DESC, votes DESC, theme) = 1)
SELECT query, work, theme, votes, score, place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, votes DESC, theme) AS place FROM wk) WHERE place <= 10""")
def work_search(spark, sf_dir):
    """The ten best works for each asking theme, each by its best theme."""
    grams = _grams(spark, sf_dir)
    found = matching.ranked(_asked(grams), grams, top=200)
    return matching.works(found, grams.select("theme", "work").distinct()).withColumn("place", F.col("place").cast("long"))


@query(f"{_PAIRED} SELECT take, note, on_seq, off_seq, ns_on, ns_off, velocity_on, velocity_off, closure, CASE closure WHEN 'note_off' THEN 0 ELSE 1 END AS defects FROM iv")
def stored_intervals(spark, sf_dir):
    """Every take stored in two commits, cut at the middle event, and read back: its intervals, with how many defects name each."""
    path = f"{shared_folder(spark)}/takes-{uuid.uuid4().hex}"
    heard = _messages(spark, sf_dir)
    middle = heard.agg(F.expr("(min(seq) + max(seq)) div 2 AS middle"))
    cut = heard.join(F.broadcast(middle))  # one row
    for part, ended in ((cut.where("seq <= middle"), False), (cut.where("seq > middle"), True)):
        takes_ = (heard if ended else part).select("take").distinct().withColumn("complete", F.lit(ended))
        ingest.store(part.drop("middle"), takes_, path)
    named = ingest.table(spark, path, "defects").where("cls IN ('restrike', 'end_of_take')").groupBy("take", F.col("seq").alias("on_seq")).agg(F.count("*").cast("int").alias("defects"))
    rows = ingest.table(spark, path, "intervals").drop("run", "version")
    return rows.join(named, ["take", "on_seq"], "left").fillna(0, ["defects"])


_FOLLOWED = f"""WITH {MESSAGES_SQL}, l AS (SELECT take, note, ns, seq, kind AS verdict, LAG(kind) OVER w AS pf, LAG(ns) OVER w AS pa FROM m WINDOW w AS (PARTITION BY take, note ORDER BY ns, seq)),
f AS (SELECT take, note, ns, seq, verdict, CASE WHEN pf <> verdict THEN pf END AS revised_from, CASE WHEN pf <> verdict THEN pa END AS revised_at FROM l)"""


def _answered(spark: SparkSession, sf_dir: str) -> tuple:
    """Messages as answers about a key of a take, merged in three batches, the last first and one of them twice; and how they are ordered."""
    path = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    answers = _messages(spark, sf_dir).select("take", "note", "ns", "seq", F.col("kind").alias("verdict"))
    for part in (2, 0, 1, 0):
        history.merge(answers.where(F.pmod(F.xxhash64("take", "seq"), F.lit(3)) == part), path, "ns")
    return history.read(spark, path), ["take", "note"], ["ns", "seq"], "verdict", F.floor(F.col("ns") / (24 * HOUR_NS))


@query(f"{_FOLLOWED} SELECT * FROM f WHERE revised_from IS NOT NULL")
def answer_revisions(spark, sf_dir):
    """What each answer that changed an earlier one changed, and of when that was."""
    return history.trail(*_answered(spark, sf_dir))


@query(f"""{_FOLLOWED}, n AS (SELECT take, note, COUNT(*) AS answers, COUNT(revised_from) AS revisions FROM f GROUP BY ALL)
SELECT f.*, answers, revisions FROM (SELECT * FROM f QUALIFY ROW_NUMBER() OVER (PARTITION BY take, note ORDER BY ns DESC, seq DESC) = 1) f JOIN n ON n.take = f.take AND n.note = f.note""")
def answer_states(spark, sf_dir):
    """The answer that stands for each key of a take, what it replaced, and how often it was revised."""
    return history.state(*_answered(spark, sf_dir))


# --- time maps: an order's lines as times, its running quantity as the map, its running price as what was matched -------------


_MAP = """li AS (SELECT l_orderkey AS pair, CAST(l_linenumber AS DOUBLE) AS t, SUM(l_quantity) AS q, SUM(CAST(l_extendedprice AS DECIMAL(18, 2))) AS p FROM lineitem GROUP BY ALL),
mp AS (SELECT pair, t, SUM(q) OVER w AS phi, CAST(SUM(p) OVER w AS DOUBLE) / 1000 AS s FROM li WINDOW w AS (PARTITION BY pair ORDER BY t)),
sl AS (SELECT * FROM (SELECT pair, t, LEAD(t) OVER w AS until, LEAD(phi) OVER w - phi AS rise, (LEAD(phi) OVER w - phi) / (LEAD(t) OVER w - t) AS slope FROM mp WINDOW w AS (PARTITION BY pair ORDER BY t)) WHERE until IS NOT NULL)"""


def _maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("pair").orderBy("t")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").cast("double").alias("t")).agg(F.sum("l_quantity").alias("q"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("p"))
    return lines.select("pair", "t", F.sum("q").over(w).alias("phi"), (F.sum("p").over(w).cast("double") / 1000).alias("s"))


@query(f"WITH {_MAP} SELECT pair, t, until, rise, ROUND(slope, 6) AS slope FROM sl")
def map_slopes(spark, sf_dir):
    return warps.slopes(_maps(spark, sf_dir)).withColumn("slope", F.round("slope", 6))


@query(f"""WITH {_MAP}, k AS (SELECT pair, t, LAG(slope) OVER (PARTITION BY pair ORDER BY t) AS before, slope AS after FROM sl)
SELECT pair, t, ROUND(before, 6) AS before, ROUND(after, 6) AS after, ROUND(after - before, 6) AS jump, ROUND(LN(after / before), 6) AS log_ratio FROM k WHERE before IS NOT NULL""")
def map_kinks(spark, sf_dir):
    found = warps.kinks(_maps(spark, sf_dir))
    return found.select("pair", "t", *[F.round(c, 6).alias(c) for c in ("before", "after", "jump", "log_ratio")])


@query(f"""WITH {_MAP}, b AS (SELECT pair, SUM(slope * rise) AS d, SUM(rise) / SUM(until - t) AS c, SUM(until - t) AS len FROM sl GROUP BY pair), e AS (SELECT pair, arg_min(phi, t) AS p0, MIN(t) AS t0 FROM mp GROUP BY pair),
r AS (SELECT mp.pair, d, c, len, phi - s AS r, p0 + c * (t - t0) - s AS l FROM mp JOIN b ON b.pair = mp.pair JOIN e ON e.pair = mp.pair)
SELECT pair, ROUND(ANY_VALUE(c), 4) AS mean_rate, ROUND(ANY_VALUE(d), 4) AS dirichlet, ROUND(ANY_VALUE(d - c * c * len), 4) AS excess, ROUND(SUM(r * r), 3) AS data_term, ROUND(SUM(r * r) + 0.1 * ANY_VALUE(d), 3) AS energy,
  ROUND(SQRT(AVG(r * r)), 6) AS residual_rms, ROUND(MAX(ABS(r)), 6) AS residual_max, ROUND(SQRT(AVG(l * l)), 6) AS line_rms FROM r GROUP BY pair""")
def map_energies(spark, sf_dir):
    found = warps.energies(_maps(spark, sf_dir), smooth=0.1)
    return found.select("pair", *[F.round(c, d).alias(c) for c, d in (("mean_rate", 4), ("dirichlet", 4), ("excess", 4), ("data_term", 3), ("energy", 3), ("residual_rms", 6), ("residual_max", 6), ("line_rms", 6))])


@query(f"""WITH {_MAP}, q AS (SELECT DISTINCT pair, t + 0.25 AS t FROM mp), l AS (SELECT *, LEAD(t) OVER w AS u, LEAD(phi) OVER w AS v FROM mp WINDOW w AS (PARTITION BY pair ORDER BY t))
SELECT q.pair, q.t, ROUND(CASE WHEN u IS NULL THEN phi ELSE phi + (v - phi) * (q.t - l.t) / (u - l.t) END, 6) AS phi FROM q JOIN l ON l.pair = q.pair AND q.t >= l.t AND (u IS NULL OR q.t < u)""")
def map_values(spark, sf_dir):
    """Each map at a quarter after each of its points."""
    points = _maps(spark, sf_dir)
    return warps.at(points, points.select("pair", (F.col("t") + 0.25).alias("t"))).withColumn("phi", F.round("phi", 6))


@query(f"""WITH {_MAP}, q AS (SELECT DISTINCT pair, phi + 0.5 AS phi FROM mp), l AS (SELECT *, LEAD(t) OVER w AS u, LEAD(phi) OVER w AS v FROM mp WINDOW w AS (PARTITION BY pair ORDER BY t))
SELECT q.pair, q.phi, ROUND(CASE WHEN u IS NULL THEN l.t ELSE l.t + (u - l.t) * (q.phi - l.phi) / (v - l.phi) END, 6) AS t FROM q JOIN l ON l.pair = q.pair AND q.phi >= l.phi AND (v IS NULL OR q.phi < v)""")
def map_inverses(spark, sf_dir):
    points = _maps(spark, sf_dir)
    return warps.at(points, points.select("pair", (F.col("phi") + 0.5).alias("phi")), x="phi", y="t").withColumn("t", F.round("t", 6))


@query()
def map_sweep(spark, sf_dir):
    """Fits of each order's map over four values of smoothness."""
    rows = _maps(spark, sf_dir).select("pair", "t", F.col("phi").alias("s"))
    return warps.sweep(rows, [0.01, 0.1, 1.0, 10.0])


# --- names ---------------------------------------------------------------------------------------------------------------


@query(r"""WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Op. ' || p_size WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN 'posth.' ELSE '' END AS o, CASE p_partkey % 3 WHEN 0 THEN 'No. ' || (p_partkey % 7) WHEN 1 THEN CAST(p_partkey % 7 AS VARCHAR) ELSE '' END AS n FROM part)
SELECT p_partkey, trim(CASE WHEN o = '' THEN '' WHEN o = 'posth.' THEN 'posth' WHEN o LIKE 'Op.%' THEN o ELSE 'Op. ' || o END || ' ' || CASE WHEN n = '' THEN '' WHEN n LIKE 'No.%' THEN n ELSE 'No. ' || n END) AS opus FROM p""")
def opus_forms(spark, sf_dir):
    key = F.col("p_partkey")
    size, number = F.col("p_size").cast("string"), F.pmod(key, F.lit(7)).cast("string")
    ops = F.when(key % 4 == 0, F.concat(F.lit("Op. "), size)).when(key % 4 == 1, size).when(key % 4 == 2, "posth.").otherwise("")
    onm = F.when(key % 3 == 0, F.concat(F.lit("No. "), number)).when(key % 3 == 1, number).otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", metadata.opus_form(ops, onm).alias("opus"))


_NUMBERED = metadata.NUMBERED


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{_NUMBERED}', 1), lambda w: lower(w)) AS w, regexp_extract_all(text, '{_NUMBERED}', 2) AS v, regexp_extract_all(text, '{_NUMBERED}', 0) AS x, regexp_split_to_array(text, '{_NUMBERED}') AS b FROM d),
p AS (SELECT *, COALESCE(list_position(list_transform(w, lambda a: a IN ('op', 'opus')), TRUE), 0) AS o, COALESCE(list_position(list_transform(w, lambda a: a IN ({", ".join(f"'{c.lower()}'" for c in metadata.CATALOGUES)})), TRUE), 0) AS c FROM n)
SELECT doc_id, CASE WHEN o = 0 THEN '' WHEN COALESCE(w[o + 1], '') IN ('no', 'nr') AND regexp_matches(b[o + 1], '^\\s*,?\\s*$') THEN 'Op. ' || v[o] || ' No. ' || v[o + 1] ELSE 'Op. ' || v[o] END AS opus,
  CASE WHEN c = 0 THEN '' ELSE regexp_replace(x[c], '\\s+', ' ', 'g') END AS catalogue FROM p""")
def works_named(spark, sf_dir):
    """The first opus and catalogue number that each document names."""
    return table(spark, sf_dir, "documents").select("doc_id", metadata.opus(F.col("text")).alias("opus"), metadata.catalogue(F.col("text")).alias("catalogue"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(t), lower(p_type)) THEN t ELSE t || ' - ' || p_type END AS title FROM (SELECT p_partkey, p_type, p_brand || ': ' || p_name || CASE WHEN contains(regexp_replace(lower(p_brand || p_name), '[^a-z0-9]', '', 'g'), 'op' || p_size) THEN '' ELSE ', Op. ' || p_size END AS t FROM part)""")
def display_titles(spark, sf_dir):
    title = metadata.display(F.col("p_name"), F.col("p_brand"), F.concat(F.lit("Op. "), F.col("p_size").cast("string")), F.lit(None).cast("string"), F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", title.alias("title"))


@query("SELECT s_suppkey, lower(regexp_replace(string_split(s_name, ' ')[1], '[^A-Za-z]', '', 'g')) AS surname, trim(regexp_replace(s_name, '^[A-Za-z]+', '')) || ' ' || regexp_extract(s_name, '^[A-Za-z]+', 0) AS composer FROM supplier")
def composer_names(spark, sf_dir):
    """Names of suppliers as `Surname, rest`, turned about."""
    name = F.concat(F.regexp_extract("s_name", "^[A-Za-z]+", 0), F.lit(", "), F.trim(F.regexp_replace("s_name", "^[A-Za-z]+", "")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", metadata.composer_key(name).alias("surname"), metadata.composer(name).alias("composer"))


@query(f"WITH {MESSAGES_SQL} SELECT take, seq, ROUND(GREATEST(0, LEAST(1, 0.02 + 0.98 * GREATEST(0, LEAST(1, (0.55 - velocity / 127.0) / 0.25 + 0.5)))), 6) AS contact FROM m WHERE kind = 'control' AND note = 64")
def damper_contact(spark, sf_dir):
    rows = _messages(spark, sf_dir).where("kind = 'control' AND note = 64")
    return rows.select("take", "seq", F.round(notes.pedal_contact(F.col("velocity")), 6).alias("contact"))


@query()
def take_verdicts(spark, sf_dir):
    """Is this take any good?"""
    return performances.verdict(_messages(spark, sf_dir))
