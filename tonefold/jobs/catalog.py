"""The registered queries over the driver's tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import metadata, notes, scores
from ..operators import alignment, correspondence, framing, integrity, intervals, matching, melody, pairing, search, sessions, stats
from ..sources.streams import MESSAGES_SQL, messages, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOUR_NS = 3_600_000_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages(table(spark, sf_dir, "events"))


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    paired = pairing.intervals(_messages(spark, sf_dir))
    return paired.select("take", "note", F.col("ns_on").alias("a"), F.col("ns_off").alias("b"), F.col("velocity_on").cast("long").alias("weight"))


_PAIRED = f"""WITH {MESSAGES_SQL},
nb AS (
  SELECT *, LAG(kind) OVER w AS pk, LEAD(kind) OVER w AS nk, LEAD(seq) OVER w AS nseq, LEAD(ns) OVER w AS nns, LEAD(velocity) OVER w AS nv
  FROM m WHERE kind IN ('note_on', 'note_off') WINDOW w AS (PARTITION BY take, note ORDER BY seq)),
ends AS (SELECT take, MIN(ns) AS start_ns, MAX(ns) AS end_ns FROM m GROUP BY take),
iv AS (
  SELECT nb.take, note, seq AS on_seq, CASE WHEN nk = 'note_off' THEN nseq END AS off_seq, ns AS ns_on, GREATEST(ns, COALESCE(nns, end_ns)) AS ns_off,
    velocity AS velocity_on, CASE WHEN nk = 'note_off' THEN nv END AS velocity_off,
    CASE nk WHEN 'note_off' THEN 'note_off' WHEN 'note_on' THEN 'restrike' ELSE 'end_of_take' END AS closure, COALESCE(nk = 'note_off', FALSE) AS trusted
  FROM nb JOIN ends ON nb.take = ends.take WHERE kind = 'note_on'),
ro AS (
  SELECT take, seq, CASE WHEN kind = 'note_on' THEN 'interval_on' WHEN pk = 'note_on' THEN 'interval_off' ELSE 'orphan_note_off' END AS role FROM nb
  UNION ALL SELECT take, seq, CASE WHEN kind = 'control' AND note = 64 THEN 'pedal' WHEN kind IN ('control', 'undecodable') THEN kind ELSE 'other' END FROM m WHERE kind NOT IN ('note_on', 'note_off')),
x AS (SELECT take, note, ns_on AS a, ns_off AS b, CAST(velocity_on AS BIGINT) AS weight FROM iv)"""
_LEVELS = f"""{_PAIRED},
mv AS (SELECT take, t, SUM(d) AS d FROM (SELECT take, a AS t, 1 AS d FROM x UNION ALL SELECT take, b, -1 FROM x) GROUP BY take, t),
lv AS (SELECT take, t, SUM(d) OVER (PARTITION BY take ORDER BY t) AS level, LEAD(t) OVER (PARTITION BY take ORDER BY t) AS until FROM mv)"""
_UNION = f"""{_PAIRED},
r AS (SELECT *, MAX(b) OVER (PARTITION BY take ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
i AS (SELECT *, SUM(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY take ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM r),
u AS (SELECT take, MIN(a) AS a, MAX(b) AS b FROM i GROUP BY take, island)"""


@query(f"""{_PAIRED},
mv AS (SELECT take, t, SUM(d) AS d, MAX(u) AS turns FROM (SELECT take, a AS t, 1 AS d, 1 AS u FROM x UNION ALL SELECT take, b, -1, 1 FROM x
  UNION ALL SELECT take, start_ns, 0, 0 FROM ends UNION ALL SELECT take, end_ns, 0, 0 FROM ends) GROUP BY take, t),
lv AS (SELECT take, t, turns, SUM(d) OVER w AS level, LEAD(t) OVER w AS until FROM mv WINDOW w AS (PARTITION BY take ORDER BY t)),
dw AS (SELECT take, CAST(level AS BIGINT) AS level, CAST(SUM(COALESCE(until - t, 0)) AS BIGINT) AS dwell, CAST(SUM(turns) AS BIGINT) AS spans FROM lv GROUP BY take, level)
SELECT *, ROUND(CASE WHEN SUM(dwell) OVER (PARTITION BY take) > 0 THEN dwell / SUM(dwell) OVER (PARTITION BY take) ELSE 0 END, 6) AS fraction FROM dw""")
def polyphony(spark, sf_dir):
    """Time that each take spends at each level, from its first message to its last."""
    spans = _messages(spark, sf_dir).groupBy("take").agg(F.min("ns").alias("start"), F.max("ns").alias("stop"))
    return intervals.dwell(intervals.levels(_weighted(spark, sf_dir), "take", spans=spans), "take").withColumn("level", F.col("level").cast("long"))


@query(f"{_PAIRED} SELECT * FROM iv")
def pair_intervals(spark, sf_dir):
    return pairing.intervals(_messages(spark, sf_dir))


@query(f"{_PAIRED} SELECT role, COUNT(*) AS n FROM ro GROUP BY role")
def roles(spark, sf_dir):
    return pairing.roles(_messages(spark, sf_dir)).groupBy("role").agg(F.count("*").alias("n"))


@query(f"WITH {MESSAGES_SQL} SELECT kind, COUNT(*) AS n, ROUND(COUNT(*) / (SELECT COUNT(*) FROM m), 6) AS fraction FROM m GROUP BY kind")
def census(spark, sf_dir):
    counts = _messages(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))
    return counts.withColumn("fraction", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))  # a row per kind


@query(f"""{_PAIRED},
d AS (
  SELECT 'orphan_note_off' AS cls FROM ro WHERE role = 'orphan_note_off' UNION ALL SELECT closure FROM iv WHERE closure <> 'note_off'
  UNION ALL SELECT 'implausible_duration' FROM iv WHERE closure <> 'end_of_take' AND ns_off - ns_on >= {pairing.IMPLAUSIBLE_NS}
  UNION ALL SELECT kind FROM m WHERE kind = 'undecodable' UNION ALL SELECT 'non_monotone_timestamp' FROM (SELECT ns, MAX(ns) OVER (PARTITION BY take ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM m) WHERE ns < reached)
SELECT c.cls, COUNT(d.cls) AS n FROM (SELECT unnest({list(pairing.DEFECTS)}) AS cls) c LEFT JOIN d ON c.cls = d.cls GROUP BY c.cls""")
def defects(spark, sf_dir):
    return pairing.defect_counts(_messages(spark, sf_dir))


@query(f"{_PAIRED} SELECT take, closure, COUNT(*) AS n FROM iv GROUP BY take, closure")
def closures(spark, sf_dir):
    return pairing.intervals(_messages(spark, sf_dir)).groupBy("take", "closure").agg(F.count("*").alias("n"))


@query(f"{_PAIRED} SELECT take, note, ns AS ns_on, nns AS ns_off, velocity AS velocity_on, nv AS velocity_off FROM nb WHERE kind = 'note_on' AND nk = 'note_off'")
def overwriting_pairs(spark, sf_dir):
    return pairing.overwriting_pairs(_messages(spark, sf_dir))


@query(f"{_UNION} SELECT take, CAST(SUM(b - a) AS BIGINT) AS measure, COUNT(*) AS islands FROM u GROUP BY take")
def support(spark, sf_dir):
    return intervals.measure(intervals.merge(_weighted(spark, sf_dir), ["take"]), ["take"])


@query(f"""{_UNION},
e AS (SELECT take, a, b FROM u UNION ALL SELECT take, start_ns, start_ns FROM ends UNION ALL SELECT take, end_ns, end_ns FROM ends),
f AS (SELECT take, MAX(b) OVER (PARTITION BY take ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS a, LEAD(a) OVER (PARTITION BY take ORDER BY a, b) AS b FROM e)
SELECT take, a, b FROM f WHERE b > a""")
def plateaus(spark, sf_dir):
    spans = _messages(spark, sf_dir).groupBy("take").agg(F.min("ns").alias("start"), F.max("ns").alias("stop"))
    return intervals.plateaus(intervals.merge(_weighted(spark, sf_dir), ["take"]), spans, "take")


@query(f"{_PAIRED} SELECT take, CAST(SUM(CAST(weight AS HUGEINT) * ((b - a) // 1000)) AS BIGINT) AS energy FROM x GROUP BY take")
def energy(spark, sf_dir):
    micros = _weighted(spark, sf_dir).withColumns({"a": F.lit(0).cast("long"), "b": F.floor((F.col("b") - F.col("a")) / 1000)})
    return intervals.energy(micros, ["take"])


@query(f"""{_PAIRED},
j AS (SELECT take, note, t, SUM(d) AS mass FROM (SELECT take, note, a AS t, weight AS d FROM x WHERE b > a UNION ALL SELECT take, note, b, -weight FROM x WHERE b > a) GROUP BY ALL HAVING SUM(d) <> 0),
n AS (SELECT take, t, SUM(ABS(mass)) AS l1, SQRT(SUM(mass * mass)) AS l2, MAX(ABS(mass)) AS linf FROM j GROUP BY take, t)
SELECT take, CAST(SUM(l1) AS BIGINT) AS l1, ROUND(SUM(l2), 4) AS l2, CAST(SUM(linf) AS BIGINT) AS linf FROM n GROUP BY take""")
def variation(spark, sf_dir):
    return intervals.variation(intervals.jump_measure(_weighted(spark, sf_dir), ["take", "note"]), ["take"])


@query(f"""{_PAIRED}, q AS (SELECT DISTINCT take, ns AS t FROM m WHERE kind = 'control')
SELECT q.take, q.t, CAST(COALESCE(SUM(CAST(weight AS HUGEINT) * GREATEST(0, LEAST(q.t, b) - a)), 0) AS BIGINT) AS f FROM q LEFT JOIN x ON x.take = q.take GROUP BY q.take, q.t""")
def cumulative(spark, sf_dir):
    """The integral of each take's weighted notes up to each of its control messages."""
    at = _messages(spark, sf_dir).where("kind = 'control'").select("take", F.col("ns").alias("t"))
    return intervals.cumulative(_weighted(spark, sf_dir), at, "take")


@query(f"""{_PAIRED},
mv AS (SELECT take, t, turn, SUM(d) AS d FROM (SELECT take, a AS t, 0 AS turn, 1 AS d FROM x UNION ALL SELECT take, b, 1, -1 FROM x) GROUP BY ALL)
SELECT take, CAST(MAX(l) AS BIGINT) AS peak FROM (SELECT take, SUM(d) OVER (PARTITION BY take ORDER BY t, turn) AS l FROM mv) GROUP BY take""")
def closed_peak(spark, sf_dir):
    return intervals.closed_peak(_weighted(spark, sf_dir), "take")


@query(f"{_PAIRED} SELECT take, note, a, b, next_a FROM (SELECT *, LEAD(a) OVER (PARTITION BY take, note ORDER BY a, b) AS next_a FROM x) WHERE next_a < b")
def overlapping_notes(spark, sf_dir):
    return intervals.overlaps(_weighted(spark, sf_dir), ["take", "note"])


_PEDAL = """c AS (SELECT take, seq, ns, velocity >= 64 AS down, COALESCE(LAG(velocity >= 64) OVER (PARTITION BY take ORDER BY seq), FALSE) AS was FROM m WHERE kind = 'control' AND note = 64),
tn AS (SELECT take, ns, down, LEAD(ns) OVER (PARTITION BY take ORDER BY seq) AS nxt FROM c WHERE down <> was),
pd AS (SELECT tn.take, ns AS pa, COALESCE(nxt, end_ns) AS pb FROM tn JOIN ends ON tn.take = ends.take WHERE down)"""


@query(f"{_PAIRED}, {_PEDAL} SELECT take, pa AS a, pb AS b FROM pd")
def pedal_spans(spark, sf_dir):
    return intervals.pedal_spans(_messages(spark, sf_dir))


@query(f"""{_PAIRED}, {_PEDAL}, o AS (SELECT *, LEAD(a) OVER (PARTITION BY take, note ORDER BY a, b) AS next_a FROM x)
SELECT o.take, note, a, b, weight, GREATEST(b, LEAST(COALESCE(pb, b), COALESCE(next_a, pb, b))) AS held FROM o LEFT JOIN pd ON pd.take = o.take AND pa <= b AND b < pb""")
def sustained_notes(spark, sf_dir):
    return intervals.sustained(_weighted(spark, sf_dir), intervals.pedal_spans(_messages(spark, sf_dir)))


_DESCRIBED = """r AS (SELECT take, v, COUNT(*) OVER (PARTITION BY take) AS n, ROW_NUMBER() OVER (PARTITION BY take ORDER BY v) AS i FROM s WHERE v IS NOT NULL),
k AS (SELECT *, 0.1 * (n + 1) AS p, 0.9 * (n + 1) AS q, GREATEST(1, LEAST(FLOOR(0.1 * (n + 1)), n - 1)) AS pl, GREATEST(1, LEAST(FLOOR(0.9 * (n + 1)), n - 1)) AS ql FROM (SELECT take, v, n, i FROM r))
SELECT take, COUNT(*) AS n, MIN(v) AS min, ROUND(CASE WHEN MAX(n) >= 2 THEN SUM(CASE WHEN i = pl THEN v * (1 - (p - pl)) WHEN i = pl + 1 THEN v * (p - pl) END) END, 3) AS p10, ROUND(MEDIAN(v), 3) AS median,
  ROUND(AVG(v), 3) AS mean, ROUND(CASE WHEN MAX(n) >= 2 THEN SUM(CASE WHEN i = ql THEN v * (1 - (q - ql)) WHEN i = ql + 1 THEN v * (q - ql) END) END, 3) AS p90, MAX(v) AS max, ROUND(STDDEV_POP(v), 3) AS sd
FROM k GROUP BY take"""


@query(f"WITH {MESSAGES_SQL}, s AS (SELECT take, CAST(velocity AS DOUBLE) AS v FROM m WHERE kind = 'note_on'), {_DESCRIBED}")
def strike_velocity(spark, sf_dir):
    return stats.describe(_messages(spark, sf_dir).where("kind = 'note_on'").withColumn("velocity", F.col("velocity").cast("double")), ["take"], "velocity")


@query(f"{_PAIRED}, s AS (SELECT take, CAST(velocity_off AS DOUBLE) AS v FROM iv WHERE trusted), {_DESCRIBED}")
def release_velocity(spark, sf_dir):
    return stats.describe(pairing.intervals(_messages(spark, sf_dir)).where("trusted").withColumn("velocity_off", F.col("velocity_off").cast("double")), ["take"], "velocity_off")


@query(f"{_PAIRED}, s AS (SELECT take, (ns_off - ns_on) / 1000000000 AS v FROM iv WHERE trusted), {_DESCRIBED}")
def durations(spark, sf_dir):
    return stats.describe(pairing.intervals(_messages(spark, sf_dir)).where("trusted").withColumn("seconds", (F.col("ns_off") - F.col("ns_on")) / 1000000000), ["take"], "seconds")


@query(f"{_PAIRED} SELECT take, note, on_seq, ns_off - ns_on AS ns, place FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY take ORDER BY ns_off - ns_on DESC, on_seq) AS place FROM iv) WHERE place <= 5")
def longest_notes(spark, sf_dir):
    """Five longest notes of each take."""
    order = Window.partitionBy("take").orderBy(F.desc("ns"), "on_seq")
    notes_ = pairing.intervals(_messages(spark, sf_dir)).withColumn("ns", F.col("ns_off") - F.col("ns_on"))
    some = Window.partitionBy("take", F.pmod(F.xxhash64("on_seq"), F.lit(32))).orderBy(F.desc("ns"), "on_seq")
    notes_ = notes_.withColumn("place", F.row_number().over(some)).where("place <= 5")  # five of each part first
    return notes_.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 5").select("take", "note", "on_seq", "ns", "place")


@query(f"WITH {MESSAGES_SQL} SELECT kind, CAST(FLOOR(velocity / 8) * 8 AS BIGINT) AS bucket, COUNT(*) AS n FROM m GROUP BY ALL")
def velocity_histogram(spark, sf_dir):
    return stats.histogram(_messages(spark, sf_dir), ["kind"], "velocity", 8)


@query(f"WITH {MESSAGES_SQL}, c AS (SELECT take, CAST(FLOOR(velocity / 8) AS BIGINT) AS b, COUNT(*) AS c FROM m GROUP BY ALL), p AS (SELECT take, c / SUM(c) OVER (PARTITION BY take) AS p FROM c) SELECT take, ROUND(-SUM(p * LOG2(p)), 6) AS bits FROM p GROUP BY take")
def velocity_entropy(spark, sf_dir):
    return stats.entropy(_messages(spark, sf_dir), ["take"], F.floor(F.col("velocity") / 8))


@query(f"""{_PAIRED},
j AS (SELECT note, CAST(FLOOR(velocity_on / 16) AS BIGINT) AS a, CAST(FLOOR(velocity_off / 16) AS BIGINT) AS b, COUNT(*) AS c FROM iv WHERE trusted GROUP BY ALL),
w AS (SELECT *, SUM(c) OVER (PARTITION BY note) AS t, SUM(c) OVER (PARTITION BY note, a) AS ca, SUM(c) OVER (PARTITION BY note, b) AS cb FROM (SELECT note, a, b, c FROM j))
SELECT note, CAST(SUM(c) AS BIGINT) AS n, ROUND(SUM(c / t * LOG2(c * t / (ca * cb))), 6) AS bits FROM w GROUP BY note""")
def velocity_information(spark, sf_dir):
    """Mutual information of strike and release velocity, per key."""
    trusted = pairing.intervals(_messages(spark, sf_dir)).where("trusted")
    return stats.mutual_information(trusted, ["note"], F.floor(F.col("velocity_on") / 16), F.floor(F.col("velocity_off") / 16))


@query(f"""{_PAIRED},
k AS (SELECT note, CAST(velocity_on AS DOUBLE) AS a, CAST(velocity_off AS DOUBLE) AS b, CAST(ROW_NUMBER() OVER (PARTITION BY note ORDER BY velocity_on, on_seq) AS DOUBLE) AS ra, CAST(ROW_NUMBER() OVER (PARTITION BY note ORDER BY velocity_off, on_seq) AS DOUBLE) AS rb FROM iv WHERE trusted)
SELECT note, COUNT(*) AS n, ROUND(CORR(a, b), 6) AS pearson, ROUND(CORR(ra, rb), 6) AS rank_correlation FROM k GROUP BY note""")
def velocity_correlations(spark, sf_dir):
    return stats.correlations(pairing.intervals(_messages(spark, sf_dir)).where("trusted"), ["note"], "velocity_on", "velocity_off", "on_seq")


@query(f"""WITH {MESSAGES_SQL}, z AS (SELECT take, MIN(ns) AS t0, (MAX(ns) - MIN(ns)) // {24 * HOUR_NS} AS bins FROM m GROUP BY take),
c AS (SELECT m.take, (ns - t0) // {24 * HOUR_NS} AS bin, COUNT(*) AS c FROM m JOIN z ON m.take = z.take WHERE (ns - t0) // {24 * HOUR_NS} < bins GROUP BY ALL),
s AS (SELECT take, SUM(c) AS s, SUM(c * c) AS q FROM c GROUP BY take)
SELECT z.take, bins, ROUND((q / bins - (s / bins) * (s / bins)) / (s / bins), 6) AS fano FROM z JOIN s ON z.take = s.take WHERE bins > 0""")
def fano_by_day(spark, sf_dir):
    return stats.fano(_messages(spark, sf_dir), ["take"], "ns", 24 * HOUR_NS)


_GAPS = f"WITH {MESSAGES_SQL}, g AS (SELECT * FROM (SELECT take, seq, ns - LAG(ns) OVER (PARTITION BY take ORDER BY seq) AS gap FROM m) WHERE gap IS NOT NULL)"


@query(f"""{_GAPS}, o AS (SELECT *, CAST(gap % 5000000 <> 0 AS INTEGER) AS off FROM g),
f AS (SELECT *, CASE WHEN off = 1 AND COALESCE(LAG(off) OVER (PARTITION BY take ORDER BY seq), 0) = 0 THEN 1 ELSE 0 END AS fresh FROM o),
r AS (SELECT *, SUM(fresh) OVER (PARTITION BY take ORDER BY seq) AS run FROM f),
l AS (SELECT take, COUNT(*) AS off_runs, COUNT(*) FILTER (WHERE s % 5000000 = 0) AS restored FROM (SELECT take, run, SUM(gap) AS s FROM r WHERE off = 1 GROUP BY ALL) GROUP BY take)
SELECT r.take, COUNT(*) AS n_gaps, COUNT(*) FILTER (WHERE off = 0) AS on_grid, ROUND(COUNT(*) FILTER (WHERE off = 0) / COUNT(*), 6) AS fraction, MIN(gap) FILTER (WHERE gap > 0) AS smallest,
  COUNT(*) FILTER (WHERE gap = 0) AS zero_gaps, COALESCE(MAX(off_runs), 0) AS off_runs, COALESCE(MAX(restored), 0) AS restored FROM r LEFT JOIN l ON r.take = l.take GROUP BY r.take""")
def lattice(spark, sf_dir):
    return integrity.lattice(_messages(spark, sf_dir))


@query("SELECT l_linenumber AS line, list_reduce(list(DISTINCT CAST(l_quantity AS BIGINT) * 6), lambda a, b: gcd(a, b)) AS divisor FROM lineitem GROUP BY l_linenumber")
def common_divisor(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("line"), (F.col("l_quantity").cast("long") * 6).alias("v"))
    return integrity.common_divisor(rows, ["line"], "v")


@query(f"""{_PAIRED},
r AS (SELECT take, COUNT(*) AS messages, COUNT(*) FILTER (WHERE role = 'interval_on') AS ons, COUNT(*) FILTER (WHERE role IN ('interval_off', 'orphan_note_off')) AS offs, COUNT(*) FILTER (WHERE role = 'orphan_note_off') AS orphans FROM ro GROUP BY take),
c AS (SELECT take, COUNT(*) FILTER (WHERE closure = 'restrike') AS restrikes, COUNT(*) FILTER (WHERE closure = 'end_of_take') AS held FROM iv GROUP BY take),
b AS (SELECT r.*, COALESCE(restrikes, 0) AS restrikes, COALESCE(held, 0) AS held FROM r LEFT JOIN c ON r.take = c.take)
SELECT take, messages, ons, offs, orphans, restrikes, held, ons - offs AS balance, orphans + restrikes AS inferred_lost, ROUND((orphans + restrikes) / messages, 6) AS rate,
  CASE WHEN ons + offs = 0 THEN 'EMPTY' WHEN orphans + restrikes = 0 AND ons - offs = held THEN 'GOOD' ELSE 'SUSPECT' END AS verdict FROM b""")
def losses(spark, sf_dir):
    return integrity.losses(_messages(spark, sf_dir))


_SEGMENTS = f"""WITH {MESSAGES_SQL}, sg AS (
  SELECT *, SUM(cut) OVER (PARTITION BY take ORDER BY ns, seq ROWS UNBOUNDED PRECEDING) AS segment FROM (SELECT *, CASE WHEN ns - LAG(ns) OVER (PARTITION BY take ORDER BY ns, seq) > {12 * HOUR_NS} THEN 1 ELSE 0 END AS cut FROM m))"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.split(_messages(spark, sf_dir), "take", "ns", 12 * HOUR_NS, tie="seq")


@query(f"{_SEGMENTS} SELECT take, CAST(segment AS BIGINT) AS segment, COUNT(*) AS n, MIN(ns) AS first_ns, MAX(ns) - MIN(ns) AS length FROM sg GROUP BY take, segment")
def segments(spark, sf_dir):
    return _segments(spark, sf_dir).groupBy("take", "segment").agg(F.count("*").alias("n"), F.min("ns").alias("first_ns"), (F.max("ns") - F.min("ns")).alias("length"))


@query(f"""{_SEGMENTS.replace('WITH', 'WITH RECURSIVE', 1)},
nt AS (SELECT take, segment, ns AS t, note, ROW_NUMBER() OVER (PARTITION BY take, segment ORDER BY ns, note) AS i FROM sg),
an AS (SELECT take, segment, i, t, note, t AS head FROM nt WHERE i = 1
  UNION ALL SELECT n.take, n.segment, n.i, n.t, n.note, CASE WHEN n.t - an.head <= {HOUR_NS} THEN an.head ELSE n.t END FROM an JOIN nt n ON n.take = an.take AND n.segment = an.segment AND n.i = an.i + 1)
SELECT take, CAST(segment AS BIGINT) AS segment, head AS t, MIN(note) AS low, MAX(note) AS high, CAST(COUNT(*) AS INTEGER) AS n FROM an GROUP BY take, segment, head""")
def onset_clusters(spark, sf_dir):
    """Anchored clusters of an hour within the segments of each take."""
    return sessions.clusters(_segments(spark, sf_dir).withColumn("t", F.col("ns")), ["take", "segment"], HOUR_NS)


_STRIKES = f"""{_SEGMENTS.replace('WITH', 'WITH RECURSIVE', 1)},
nt AS (SELECT take, segment, ns, note AS pitch, ROW_NUMBER() OVER (PARTITION BY take, segment ORDER BY ns, note) AS i FROM sg WHERE kind = 'note_on')"""


@query(f"""{_STRIKES},
st AS (SELECT *, COALESCE(LEAD(ns) OVER w - ns <= {12 * HOUR_NS} AND ABS(LEAD(pitch) OVER w - pitch) BETWEEN 1 AND 2, FALSE) AS ok, COALESCE(LAG(pitch) OVER w = LEAD(pitch) OVER w, FALSE) AS back FROM nt WINDOW w AS (PARTITION BY take, segment ORDER BY i)),
rn AS (SELECT *, CASE WHEN ok THEN MIN(CASE WHEN NOT (ok AND back) THEN i END) OVER (PARTITION BY take, segment ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) ELSE i END AS j FROM st),
nx AS (SELECT *, CASE WHEN j - i >= 3 THEN j + 1 ELSE i + 1 END AS follow FROM rn),
wk AS (SELECT take, segment, ns, pitch, follow FROM nx WHERE i = 1 UNION ALL SELECT n.take, n.segment, n.ns, n.pitch, n.follow FROM wk JOIN nx n ON n.take = wk.take AND n.segment = wk.segment AND n.i = wk.follow)
SELECT take, CAST(segment AS BIGINT) AS segment, ns, pitch FROM wk""")
def trill_free(spark, sf_dir):
    rows = _segments(spark, sf_dir).where("kind = 'note_on'").select("take", "segment", "ns", F.col("note").alias("pitch"))
    return sessions.collapse_trills(rows, ["take", "segment"], within_ns=12 * HOUR_NS, least=3)


@query(f"""{_STRIKES},
rg AS (SELECT take, segment, i, ns, 2 * pitch AS pitch, TRUE AS kept, [2 * pitch] AS held FROM nt WHERE i = 1
  UNION ALL SELECT n.take, n.segment, n.i, n.ns, 2 * n.pitch, 2 * n.pitch >= list_aggregate(held, 'median') - 11, CASE WHEN 2 * n.pitch >= list_aggregate(held, 'median') - 11 THEN list_append(held, 2 * n.pitch)[-8:] ELSE held END
  FROM rg JOIN nt n ON n.take = rg.take AND n.segment = rg.segment AND n.i = rg.i + 1)
SELECT take, CAST(segment AS BIGINT) AS segment, ns, CAST(pitch AS INTEGER) AS pitch FROM rg WHERE kept""")
def register_lines(spark, sf_dir):
    rows = _segments(spark, sf_dir).where("kind = 'note_on'").select("take", "segment", "ns", (F.col("note") * 2).cast("int").alias("pitch"))
    return sessions.register_line(rows, ["take", "segment"])


def _grams_sql(n: int, clamp: int) -> str:
    """Themes and queries are the key sequences of takes, four takes a work; n steps within +-clamp make a gram."""
    gram = "CAST(0 AS BIGINT)"
    for i in range(n):
        gram = f"({gram}) * {2 * clamp + 1} + (LEAD(s, {i}) OVER v) + {clamp}"
    return f"""WITH {MESSAGES_SQL}, st AS (SELECT take, note, ROW_NUMBER() OVER w - 1 AS pos, CASE WHEN LEAD(note) OVER w IS NOT NULL THEN GREATEST(-{clamp}, LEAST({clamp}, (LEAD(note) OVER w) - note)) END AS s FROM m WINDOW w AS (PARTITION BY take ORDER BY seq)),
gr AS (SELECT * FROM (SELECT take AS theme, take // 4 AS work, pos, {gram} AS gram FROM st WINDOW v AS (PARTITION BY take ORDER BY pos)) WHERE gram IS NOT NULL)"""


#: Steps of a gram and their bound: for votes by diagonal, and for ranking.
_VOTED, _RANKED = (4, 15), (5, 24)
_GRAMS = _grams_sql(*_RANKED)
_INDEX = f"""{_grams_sql(*_VOTED)}, us AS (SELECT gram FROM gr GROUP BY gram HAVING COUNT(*) <= GREATEST(4000, 0.002 * (SELECT COUNT(*) FROM gr)) AND COUNT(DISTINCT work) <= GREATEST(8, 0.1 * (SELECT COUNT(DISTINCT work) FROM gr))),
ix AS (SELECT gr.* FROM gr JOIN us ON gr.gram = us.gram)"""
_VOTES = f"""{_INDEX}, qy AS (SELECT * FROM gr WHERE theme % 10 = 0),
cl AS (SELECT query, theme, work, diagonal, COUNT(*) AS hits, MIN(q) AS first, MAX(q) AS last FROM (SELECT qy.theme AS query, ix.theme, ix.work, qy.pos AS q, unnest([ix.pos - qy.pos - 1, ix.pos - qy.pos, ix.pos - qy.pos + 1]) AS diagonal FROM qy JOIN ix ON qy.gram = ix.gram WHERE qy.theme <> ix.theme) GROUP BY ALL)"""
#: Ranked themes: sc. A query's grams count by their number of postings, and if none is usual its rarer ones do.
_SCORED = f"""{_GRAMS}, nm AS (SELECT gram, COUNT(*) AS n FROM gr GROUP BY gram), li AS (SELECT GREATEST(3000, 0.002 * COUNT(*)) AS lim FROM gr), ow AS (SELECT theme, COUNT(*) AS tg FROM gr GROUP BY theme),
a0 AS (SELECT theme AS query, gram, COUNT(*) AS times FROM gr WHERE theme % 10 = 0 GROUP BY ALL), sz AS (SELECT query, SUM(times) AS qg FROM a0 GROUP BY query),
a1 AS (SELECT a0.*, n, lim, MIN(n) OVER (PARTITION BY query) AS rarest FROM a0 JOIN nm ON nm.gram = a0.gram, li),
ak AS (SELECT query, gram, times FROM a1 WHERE n <= lim OR (rarest > lim AND n <= 10 * lim) OR (rarest > 10 * lim AND n = rarest)),
m0 AS (SELECT query, gr.theme, gr.work, CAST(SUM(times) AS BIGINT) AS votes FROM ak JOIN gr ON ak.gram = gr.gram WHERE query <> gr.theme GROUP BY ALL), m1 AS (SELECT *, MAX(votes) OVER (PARTITION BY query) AS most FROM m0),
sc AS (SELECT m1.query, m1.theme, m1.work, votes, ROUND(votes / SQRT(tg * qg), 6) AS score FROM m1 JOIN ow ON ow.theme = m1.theme JOIN sz ON sz.query = m1.query WHERE votes >= 2 OR most < 2)"""


def _grams(spark: SparkSession, sf_dir: str, size: tuple[int, int] = _RANKED) -> DataFrame:
    found = sessions.ngrams(_messages(spark, sf_dir), ["take"], ["seq"], "note", n=size[0], clamp=size[1])
    return found.select(F.col("take").alias("theme"), F.floor(F.col("take") / 4).alias("work"), F.col("pos").cast("long").alias("pos"), "gram")


def _asked(grams: DataFrame) -> DataFrame:
    """A tenth of the themes asks: the feature is the search of stated queries."""
    return grams.where("theme % 10 = 0").withColumnRenamed("theme", "query")


@query(f"{_GRAMS} SELECT theme, pos, gram FROM gr")
def theme_ngrams(spark, sf_dir):
    return _grams(spark, sf_dir).drop("work")


@query(f"{_INDEX} SELECT theme, work, pos, gram FROM ix")
def theme_index(spark, sf_dir):
    return matching.index(_grams(spark, sf_dir, _VOTED))


@query(f"{_VOTES} SELECT query, theme, work, diagonal, hits, first, last FROM cl")
def theme_votes(spark, sf_dir):
    grams = _grams(spark, sf_dir, _VOTED)
    return search.votes(_asked(grams), grams)


@query(f"""{_VOTES}, de AS (SELECT *, hits / (last - first + 1) AS density FROM cl), ef AS (SELECT *, CASE WHEN density >= 0.34 THEN hits ELSE 0 END AS effective FROM de),
be AS (SELECT * FROM ef QUALIFY ROW_NUMBER() OVER (PARTITION BY query ORDER BY effective DESC, hits DESC, theme, diagonal) = 1),
ru AS (SELECT be.query, MAX(r.effective) AS ru FROM be JOIN ef r ON r.query = be.query AND r.work <> be.work AND r.last >= be.first AND r.first <= be.last GROUP BY be.query),
al AS (SELECT be.*, COALESCE(ru, 0) AS runner_up FROM be LEFT JOIN ru ON be.query = ru.query)
SELECT query, theme, diagonal, hits, ROUND(density, 6) AS density, runner_up, ROUND(CASE WHEN effective < 6 THEN 0.0 ELSE GREATEST(0.0, 1 - EXP(-(effective - 2) / 2)) * LEAST(1.0, density / 0.75)
  * CASE WHEN runner_up < 6 THEN 1.0 WHEN effective <= runner_up THEN 0.0 ELSE 1 - EXP(-(effective - runner_up) / 2) END END, 4) AS confidence FROM al""")
def theme_candidates(spark, sf_dir):
    grams = _grams(spark, sf_dir, _VOTED)
    return search.candidates(_asked(grams), grams)


@query(f"{_SCORED} SELECT * FROM (SELECT query, theme, votes, score, ROW_NUMBER() OVER (PARTITION BY query ORDER BY score DESC, votes DESC, theme) AS place FROM sc) WHERE place <= 10")
def theme_search(spark, sf_dir):
    grams = _grams(spark, sf_dir)
    return matching.ranked(_asked(grams), grams).withColumn("place", F.col("place").cast("long"))


@query(f"""WITH {MESSAGES_SQL}, n AS (SELECT take AS key, note, ROW_NUMBER() OVER (PARTITION BY take ORDER BY seq) AS i FROM m),
g AS (SELECT * FROM (SELECT key, i, CASE WHEN LEAD(note, 1) OVER w IS NOT NULL THEN note || ',' || (LEAD(note, 1) OVER w) END AS gram FROM n WINDOW w AS (PARTITION BY key ORDER BY i)) WHERE gram IS NOT NULL),
h AS (SELECT * FROM g WHERE i < 20), b AS (SELECT * FROM g WHERE i >= 20),
v AS (SELECT h.key, b.i - h.i AS off, COUNT(*) AS votes FROM h JOIN b ON h.key = b.key AND h.gram = b.gram GROUP BY ALL)
SELECT key, off AS offset, votes, votes - COALESCE(nxt, 0) AS margin FROM (SELECT *, ROW_NUMBER() OVER w AS place, LEAD(votes) OVER w AS nxt FROM v WINDOW w AS (PARTITION BY key ORDER BY votes DESC, off)) WHERE place = 1""")
def seams(spark, sf_dir):
    """Where the first twenty notes of a take come again."""
    rows = _messages(spark, sf_dir).select(F.col("take").alias("key"), F.row_number().over(Window.partitionBy("take").orderBy("seq")).cast("long").alias("i"), F.col("note").alias("pitch"))
    return matching.seam(rows.where("i <= 20"), rows.where("i >= 20"), n=2)


@query("SELECT p_partkey, CAST(21 + p_size AS INTEGER) AS note, CASE (21 + p_size) % 12 WHEN 0 THEN 'C' WHEN 1 THEN 'C#' WHEN 2 THEN 'D' WHEN 3 THEN 'D#' WHEN 4 THEN 'E' WHEN 5 THEN 'F' WHEN 6 THEN 'F#' WHEN 7 THEN 'G' WHEN 8 THEN 'G#' WHEN 9 THEN 'A' WHEN 10 THEN 'A#' ELSE 'B' END || CAST((21 + p_size) // 12 - 1 AS VARCHAR) AS name, CAST(21 + p_size AS INTEGER) AS back FROM part")
def note_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.lit(21) + F.col("p_size")).cast("int").alias("note"))
    return rows.withColumn("name", notes.note_name(F.col("note"))).withColumn("back", notes.note_number(F.col("name")))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS label, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS letters FROM customer")
def name_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", metadata.label_key(F.col("c_name")).alias("label"), metadata.letters_and_digits(F.col("c_name")).alias("letters"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'), '^[ .,;:]+|[ .,;:]+$', '', 'g') AS title FROM pages""")
def page_titles(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", metadata.clean(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query("SELECT n_name AS nation, r_name AS region, COUNT(*) AS orders, COUNT(DISTINCT o_custkey) AS customers, COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def corpus_stats(spark, sf_dir):
    """Counts over the join of records, works and sources, here orders, customers and nations."""
    t = lambda name: table(spark, sf_dir, name)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("orders"), F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%' OR p_brand ILIKE '%#1%' OR p_type ILIKE '%econ%' ORDER BY p_name, p_partkey LIMIT 20")
def find_parts(spark, sf_dir):
    """Text search over three columns, twenty results: the reference's find."""
    parts = table(spark, sf_dir, "part")
    return parts.where(F.ilike("p_name", F.lit("%RING%")) | F.ilike("p_brand", F.lit("%#1%")) | F.ilike("p_type", F.lit("%econ%"))).orderBy("p_name", "p_partkey").limit(20).select("p_partkey", "p_name")


@query("SELECT conv_id, role, turn, text FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, text) AS place FROM conversations) WHERE place = 1")
def latest_turns(spark, sf_dir):
    """Latest row by key: the upsert of label records."""
    order = Window.partitionBy("conv_id", "role").orderBy(F.desc("turn"), "text")
    return table(spark, sf_dir, "conversations").withColumn("place", F.row_number().over(order)).where("place = 1").select("conv_id", "role", "turn", "text")


@query(f"""WITH {MESSAGES_SQL} SELECT take, ROW_NUMBER() OVER (PARTITION BY take ORDER BY seq) - 1 AS seq, seq AS packet_seq, ns, CASE WHEN kind = 'other' THEN 'system' ELSE kind END AS kind,
  CASE WHEN kind NOT IN ('other', 'undecodable') THEN 0 END AS channel, CASE WHEN kind NOT IN ('other', 'undecodable') THEN note END AS note, CASE WHEN kind NOT IN ('other', 'undecodable') THEN velocity END AS velocity FROM m""")
def framed_messages(spark, sf_dir):
    """Events encoded as packets of bytes and framed again: kinds, channels and data."""
    rows = _messages(spark, sf_dir)
    status = F.when(F.col("kind") == "note_on", "90").when(F.col("kind") == "note_off", "80").when(F.col("kind") == "control", "B0").otherwise("FE")
    two = lambda c: F.lpad(F.hex(F.col(c).cast("long")), 2, "0")
    status = F.when(F.col("kind") == "undecodable", "90").otherwise(status)  # cut after its first byte
    coded = F.unhex(F.when(F.col("kind").isin("other", "undecodable"), status).otherwise(F.concat(status, two("note"), two("velocity"))))
    packets = rows.select("take", F.col("seq").alias("packet_seq"), "ns", coded.alias("data"))
    return framing.framed(packets).select("take", "seq", "packet_seq", "ns", "kind", "channel", "note", "velocity")


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring takes: the first segments of each, as events of one note."""
    rows = _messages(spark, sf_dir).where("kind = 'note_on'").select(F.floor(F.col("take") / 2).alias("pair"), F.when(F.col("take") % 2 == 0, "a").otherwise("b").alias("side"), F.col("ns"), F.col("note"))
    start = rows.groupBy("pair", "side").agg(F.min("ns").alias("t0"))
    return rows.join(start, ["pair", "side"]).select("pair", "side", ((F.col("ns") - F.col("t0")) / HOUR_NS).alias("t"), F.array("note").alias("notes"))


@query()
def aligned_takes(spark, sf_dir):
    return alignment.align(_sides(spark, sf_dir))


@query()
def fitted_warps(spark, sf_dir):
    return alignment.warp_quality(alignment.warps(alignment.align(_sides(spark, sf_dir))))


@query()
def refined_takes(spark, sf_dir):
    """Pairs of takes aligned by pitch, then by pitch and time in turn until the matches stay: which were refined, and with what smoothness."""
    matches, fits = correspondence.alternate(_sides(spark, sf_dir), [0.01, 0.1, 1.0, 10.0], horizon=720.0)
    return fits.join(matches.groupBy("pair").agg(F.count("*").alias("matched"), F.max("pass_").alias("passes")), "pair")


_CHORDS = f"""ch AS (SELECT take // 2 AS pair, CASE WHEN take % 2 = 0 THEN 'a' ELSE 'b' END AS side, CAST(ns // {72 * HOUR_NS} AS DOUBLE) AS t, list_sort(list(DISTINCT note)) AS notes FROM m WHERE kind = 'note_on' GROUP BY ALL),
ev AS (SELECT *, len(notes) AS c, ROW_NUMBER() OVER (PARTITION BY pair, side ORDER BY t) - 1 AS n FROM ch),
mt AS (SELECT * FROM (SELECT a.pair, a.n AS i, b.n AS j, a.t, b.t AS s, a.c AS ca, b.c AS cb, 1 - len(list_intersect(a.notes, b.notes)) / len(list_distinct(list_concat(a.notes, b.notes))) AS cost FROM ev a JOIN ev b ON a.pair = b.pair AND a.n = b.n AND a.side = 'a' AND b.side = 'b') WHERE cost <= 0.5)"""


def _side_census(side: str) -> str:
    return f"""s{side} AS (SELECT ev.pair, COUNT(*) AS e, SUM(c) AS k, COUNT(*) FILTER (WHERE n BETWEEN {side}0 AND {side}1) AS ce, SUM(c) FILTER (WHERE n BETWEEN {side}0 AND {side}1) AS ck, MIN(t) FILTER (WHERE n = {side}0) AS s0, MIN(t) FILTER (WHERE n = {side}1) AS s1
FROM ev JOIN co ON co.pair = ev.pair WHERE side = '{side}' GROUP BY ev.pair)"""


@query(f"""WITH {MESSAGES_SQL}, {_CHORDS},
co AS (SELECT pair, MIN(i) AS a0, MAX(i) AS a1, MIN(j) AS b0, MAX(j) AS b1, COUNT(*) AS m, SUM(ca) AS ma, SUM(cb) AS mb, COUNT(*) FILTER (WHERE cost = 0) AS x, AVG(cost) AS ac FROM mt GROUP BY pair),
{_side_census('a')}, {_side_census('b')}
SELECT co.pair, a.e AS events_a, b.e AS events_b, CAST(a.k AS BIGINT) AS notes_a, CAST(b.k AS BIGINT) AS notes_b, m AS matched, CAST(ma AS BIGINT) AS matched_notes_a, CAST(mb AS BIGINT) AS matched_notes_b, x AS exact_pairs, ROUND(ac, 6) AS mean_pair_cost, a.ce AS core_events_a, b.ce AS core_events_b,
  CAST(a.ck AS BIGINT) AS core_notes_a, CAST(b.ck AS BIGINT) AS core_notes_b, a.s0 AS core_start_a, a.s1 AS core_end_a, b.s0 AS core_start_b, b.s1 AS core_end_b, a.ce - m AS dropped_in_core_a, b.ce - m AS added_in_core_b, a0 AS head_a, a.e - 1 - a1 AS tail_a, b0 AS head_b, b.e - 1 - b1 AS tail_b,
  a.e - a.ce AS outside_core_a, b.e - b.ce AS outside_core_b, CAST(a.k - a.ck AS BIGINT) AS outside_core_notes_a, CAST(b.k - b.ck AS BIGINT) AS outside_core_notes_b, ROUND(m / a.e, 6) AS match_rate_a, ROUND(m / a.ce, 6) AS match_rate_core_a, ROUND(m / b.ce, 6) AS match_rate_core_b
FROM co JOIN sa a ON a.pair = co.pair JOIN sb b ON b.pair = co.pair""")
def match_census(spark, sf_dir):
    """The account of two takes matched place by place: chords of three days are a pair where they share half of their notes."""
    strikes = _messages(spark, sf_dir).where("kind = 'note_on'").withColumn("t", F.floor(F.col("ns") / (72 * HOUR_NS)).cast("double"))
    chords = strikes.groupBy(F.floor(F.col("take") / 2).alias("pair"), F.when(F.col("take") % 2 == 0, "a").otherwise("b").alias("side"), "t").agg(F.collect_set("note").alias("notes"))
    rows = correspondence.indexed(chords, bucket=100.0)
    side = lambda s, place, at, notes: rows.where(F.col("side") == s).select("pair", F.col("n").alias("n"), F.col("n").alias(place), F.col("t").alias(at), F.col("notes").alias(notes))
    met = side("a", "i", "t", "x").join(side("b", "j", "s", "y"), ["pair", "n"]).withColumn("cost", F.round(correspondence.event_cost(F.col("x"), F.col("y")), 9))
    return correspondence.census(rows, met.where(F.col("cost") <= correspondence.TAU).select("pair", "i", "j", "t", "s", "cost"))


@query(f"{_PAIRED} SELECT note, COUNT(*) AS n, CAST(SUM((ns_off - ns_on) // 1000) AS BIGINT) AS micros, ROUND(AVG(velocity_on), 4) AS velocity FROM iv GROUP BY note")
def keys(spark, sf_dir):
    paired = pairing.intervals(_messages(spark, sf_dir))
    return paired.groupBy("note").agg(F.count("*").alias("n"), F.sum(F.floor((F.col("ns_off") - F.col("ns_on")) / 1000)).alias("micros"), F.round(F.avg("velocity_on"), 4).alias("velocity"))


@query(f"{_PAIRED} SELECT take, on_seq, off_seq, ns_on, ns_off, velocity_on, closure FROM iv WHERE note = 60")
def one_key(spark, sf_dir):
    """All intervals of middle C."""
    return pairing.intervals(_messages(spark, sf_dir)).where("note = 60").select("take", "on_seq", "off_seq", "ns_on", "ns_off", "velocity_on", "closure")


@query(f"WITH {MESSAGES_SQL} SELECT take, note % 12 AS pc, COUNT(*) AS n FROM m WHERE kind = 'note_on' GROUP BY ALL")
def pitch_classes(spark, sf_dir):
    return _messages(spark, sf_dir).where("kind = 'note_on'").groupBy("take", F.pmod("note", F.lit(12)).alias("pc")).agg(F.count("*").alias("n"))


@query(f"WITH {MESSAGES_SQL} SELECT take, MAX(c) AS peak FROM (SELECT take, COUNT(*) OVER (PARTITION BY take ORDER BY ns RANGE BETWEEN {HOUR_NS} PRECEDING AND CURRENT ROW) AS c FROM m) GROUP BY take")
def peak_rate(spark, sf_dir):
    """Most messages of a take within an hour."""
    own = F.floor(F.col("ns") / HOUR_NS)
    rows = _messages(spark, sf_dir).select("take", "ns", own.alias("own"), F.explode(F.array(own, own + 1)).alias("hour"))  # an hour back reaches into the hour before
    last = Window.partitionBy("take", "hour").orderBy("ns").rangeBetween(-HOUR_NS, 0)
    return rows.withColumn("c", F.count("*").over(last)).where("own = hour").groupBy("take").agg(F.max("c").alias("peak"))


@query(f"{_LEVELS} SELECT take, ROUND(SUM(level * ((until - t) // 1000)) / SUM((until - t) // 1000), 6) AS mean_level FROM lv WHERE until > t GROUP BY take")
def mean_polyphony(spark, sf_dir):
    spent = F.floor((F.col("until") - F.col("t")) / 1000)
    found = intervals.levels(_weighted(spark, sf_dir), "take").where("until > t")
    return found.groupBy("take").agg(F.round(F.sum(F.col("level") * spent) / F.sum(spent), 6).alias("mean_level"))


@query(f"""{_PAIRED}, q AS (SELECT take, seq, ns FROM m WHERE kind = 'control')
SELECT q.take, q.seq, x.note, CAST(SUM(weight) AS BIGINT) AS value FROM q JOIN x ON x.take = q.take AND a <= ns AND ns <= b GROUP BY ALL""")
def values_at(spark, sf_dir):
    """The value of every key that sounds at each control message: a range join by take and day."""
    day = 24 * HOUR_NS
    x = _weighted(spark, sf_dir).withColumn("day", F.explode(F.sequence(F.floor(F.col("a") / day), F.floor(F.col("b") / day))))
    q = _messages(spark, sf_dir).where("kind = 'control'").select("take", "seq", "ns", F.floor(F.col("ns") / day).alias("day"))
    return q.join(x, ["take", "day"]).where("a <= ns AND ns <= b").groupBy("take", "seq", x["note"]).agg(F.sum("weight").alias("value"))


@query(f"""{_SEGMENTS}, c AS (SELECT take, segment, note % 12 AS pc, SUM(velocity) AS w FROM sg WHERE kind = 'note_on' GROUP BY ALL),
r AS (SELECT take, segment, root, SUM(CASE WHEN (pc - root + 12) % 12 IN (0, 2, 4, 5, 7, 9, 11) THEN w ELSE 0 END) AS i, SUM(w) AS t FROM c, (SELECT unnest(range(12)) AS root) GROUP BY ALL)
SELECT take, CAST(segment AS BIGINT) AS segment, CAST(root AS INTEGER) AS root, ROUND(i / t, 6) AS share FROM r QUALIFY ROW_NUMBER() OVER (PARTITION BY take, segment ORDER BY i DESC, root) = 1""")
def segment_keys(spark, sf_dir):
    """The major key of each segment."""
    return melody.diatonic(_segments(spark, sf_dir).where("kind = 'note_on'"), ["take", "segment"], "note", "velocity")


@query(f"""{_SEGMENTS}, g AS (SELECT *, ns - LAG(ns) OVER w AS gap, CASE WHEN LEAD(note, 3) OVER w IS NOT NULL THEN note || ',' || (LEAD(note, 1) OVER w) || ',' || (LEAD(note, 2) OVER w) || ',' || (LEAD(note, 3) OVER w) END AS gram
  FROM sg WINDOW w AS (PARTITION BY take, segment ORDER BY ns, seq)),
c AS (SELECT take, segment, note % 12 AS pc, SUM(velocity) AS w FROM sg GROUP BY ALL),
r AS (SELECT take, segment, root, SUM(CASE WHEN (pc - root + 12) % 12 IN (0, 2, 4, 5, 7, 9, 11) THEN w ELSE 0 END) AS i, SUM(w) AS t FROM c, (SELECT unnest(range(12)) AS root) GROUP BY ALL),
k AS (SELECT take, segment, CAST(root AS INTEGER) AS root, ROUND(i / t, 6) AS share FROM r QUALIFY ROW_NUMBER() OVER (PARTITION BY take, segment ORDER BY i DESC, root) = 1)
SELECT g.take, CAST(g.segment AS BIGINT) AS segment, COUNT(*) AS n, ROUND(CASE WHEN MAX(ns) > MIN(ns) THEN COUNT(*) / ((MAX(ns) - MIN(ns)) / {HOUR_NS}) END, 4) AS per_hour, COUNT(*) FILTER (WHERE gap > {HOUR_NS}) AS stops,
  MIN(note) AS low, MAX(note) AS high, ROUND(AVG(velocity), 4) AS velocity, ROUND(CASE WHEN COUNT(gram) > 0 THEN 1 - COUNT(DISTINCT gram) / COUNT(gram) ELSE 0 END, 6) AS repetition, root, share
FROM g JOIN k ON k.take = g.take AND k.segment = g.segment GROUP BY g.take, g.segment, root, share""")
def segment_textures(spark, sf_dir):
    return melody.texture(_segments(spark, sf_dir), ["take", "segment"], "ns", "note", "velocity", "seq", stop=HOUR_NS)


@query(f"WITH {MESSAGES_SQL}, h AS (SELECT take, ns // {HOUR_NS} AS hour, note, seq FROM m) SELECT take, hour, note, seq FROM h QUALIFY ROW_NUMBER() OVER (PARTITION BY take, hour ORDER BY note DESC, seq) = 1")
def hourly_skyline(spark, sf_dir):
    """The highest note of each hour of a take."""
    rows = _messages(spark, sf_dir).withColumn("hour", F.floor(F.col("ns") / HOUR_NS))
    return melody.skyline(rows, ["take"], "hour", "note", "seq")


@query(f"""WITH {MESSAGES_SQL}, r AS (SELECT take, note, ROW_NUMBER() OVER (PARTITION BY take ORDER BY seq) - 1 AS i FROM m),
l AS (SELECT take, list(note ORDER BY i) AS x FROM r GROUP BY take), w AS (SELECT take, x, unnest(range(0, len(x) - 7, 4)) AS start FROM l),
p AS (SELECT take, start, x[start + 1 : start + 8] AS p FROM w), s AS (SELECT *, array_to_string(list_transform(p, lambda v, i: v - p[greatest(i - 1, 1)]), ',') AS steps FROM p WHERE len(list_distinct(p)) >= 3),
f AS (SELECT * FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY take, steps ORDER BY start) = 1)
SELECT take, start, array_to_string(p, ',') AS pitches FROM f QUALIFY ROW_NUMBER() OVER (PARTITION BY take ORDER BY start) <= 12""")
def take_themes(spark, sf_dir):
    """Themes of eight notes, every four notes of a take."""
    return melody.themes(_messages(spark, sf_dir), "take", "seq", "note", size=8, stride=4)


@query(f"""{_PAIRED}, w AS (SELECT take, MIN(ns_off) AS t0, MAX(ns_on) AS t1 FROM iv GROUP BY take) SELECT m.take, COUNT(*) AS n FROM m JOIN w ON m.take = w.take WHERE ns > t0 AND ns < t1 GROUP BY m.take""")
def messages_during(spark, sf_dir):
    """Messages strictly between a take's first release and its last onset."""
    rows = _messages(spark, sf_dir)
    span = pairing.intervals(rows).groupBy("take").agg(F.min("ns_off").alias("t0"), F.max("ns_on").alias("t1"))
    return rows.join(span, "take").where("ns > t0 AND ns < t1").groupBy("take").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, COUNT(o_orderkey) AS works, ROUND(COALESCE(SUM(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def works_per_customer(spark, sf_dir):
    """Counts by correlated subqueries, as one grouped join with zeros."""
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("works"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(counts, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("works", F.lit(0)).cast("long").alias("works"), F.round(F.coalesce(F.col("total").cast("double"), F.lit(0.0)), 2).alias("total"))


@query("SELECT vec_id, ROUND(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 4) AS l1, ROUND(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS l2, ROUND(list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))), 4) AS linf FROM embeddings")
def vector_norms(spark, sf_dir):
    absolute = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(total(absolute), 4).alias("l1"), F.round(F.sqrt(total(F.transform(absolute, lambda x: x * x))), 4).alias("l2"), F.round(F.array_max(absolute), 4).alias("linf"))


@query("SELECT p_brand AS composer, COUNT(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, composer LIMIT 10")
def top_brands(spark, sf_dir):
    """Ten largest groups: the reference's list of composers."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("composer")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "composer").limit(10)


@query(f"""WITH {MESSAGES_SQL}, e AS (SELECT MAX(ns) AS now FROM m), s AS (SELECT take, COUNT(*) AS n, MAX(ns) AS last_ns, COUNT(*) FILTER (WHERE ns >= now - {24 * HOUR_NS}) AS recent FROM m, e GROUP BY take)
SELECT take, n, recent, CASE WHEN recent = 0 AND now - last_ns > {72 * HOUR_NS} THEN 'red' WHEN recent = 0 THEN 'amber' ELSE 'green' END AS light FROM s, e""")
def take_status(spark, sf_dir):
    """Counts of a take, of its last day before the end of all, and a light."""
    rows = _messages(spark, sf_dir)
    now = rows.agg(F.max("ns").alias("now"))
    found = rows.join(F.broadcast(now)).groupBy("take").agg(F.count("*").alias("n"), F.count_if(F.col("ns") >= F.col("now") - 24 * HOUR_NS).alias("recent"), F.max("ns").alias("last_ns"), F.max("now").alias("now"))
    light = F.when((F.col("recent") == 0) & (F.col("now") - F.col("last_ns") > 72 * HOUR_NS), "red").when(F.col("recent") == 0, "amber").otherwise("green")
    return found.select("take", "n", "recent", light.alias("light"))


@query(f"""WITH {MESSAGES_SQL}, z AS (SELECT take, MIN(ns) AS t0 FROM m GROUP BY take)
SELECT m.take, ROW_NUMBER() OVER (PARTITION BY m.take ORDER BY seq) - 1 AS i, (ns - t0) // 1000000000 AS tick, kind, note, velocity FROM m JOIN z ON m.take = z.take WHERE kind NOT IN ('other', 'undecodable')""")
def midi_round_trip(spark, sf_dir):
    """Each take written as a MIDI file, a second as a tick, and read again."""
    rows = _messages(spark, sf_dir)
    start = rows.groupBy("take").agg(F.min("ns").alias("t0"))
    rows = rows.where("kind NOT IN ('other', 'undecodable')").join(start, "take").select("take", "seq", F.floor((F.col("ns") - F.col("t0")) / 1_000_000_000).alias("tick"), "kind", "note", "velocity")

    def encode(take):
        take = take.sort_values("seq")
        status = take["kind"].map({"note_on": 0x90, "note_off": 0x80, "control": 0xB0})
        data = scores.write_midi(take["tick"].tolist(), [bytes(x) for x in zip(status, take["note"], take["velocity"])])
        return take[["take"]].iloc[:1].assign(file=[data])

    files = rows.groupBy("take").applyInPandas(encode, "take long, file binary")
    back = files.select("take", F.posexplode(scores.parse_midi("file")).alias("i", "m"))
    kind, _, note, velocity = framing.classify(F.col("m.data"))
    return back.select("take", F.col("i").cast("long").alias("i"), F.round(F.col("m.seconds") * (scores.TICKS * 1e6 / scores.TEMPO)).cast("long").alias("tick"), kind.alias("kind"), note.alias("note"), velocity.alias("velocity"))
