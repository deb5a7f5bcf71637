"""Registered queries over continuity: how fast a take's sum rises, what its damper takes, which notes hold controls; with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import continuity, pairing
from ..sources.streams import MESSAGES_SQL
from .catalog import HOUR_NS, _messages, _PAIRED, _weighted, query
from .readings import _maps, _spans

_WIDTHS = (HOUR_NS, 6 * HOUR_NS, 24 * HOUR_NS)
_CONTACT = "GREATEST(0, LEAST(1, 0.02 + 0.98 * GREATEST(0, LEAST(1, (0.55 - value / 127.0) / 0.25 + 0.5))))"


@query(f"""{_PAIRED},
j AS (SELECT take, t, SUM(w) AS w FROM (SELECT take, a AS t, weight AS w FROM x UNION ALL SELECT take, b, -weight FROM x) GROUP BY take, t),
g AS (SELECT take, t, SUM(w) OVER o AS slope, SUM(CAST(w AS HUGEINT) * t) OVER o AS spent FROM j WINDOW o AS (PARTITION BY take ORDER BY t)),
d AS (SELECT unnest([{", ".join(map(str, _WIDTHS))}]) AS width),
e AS (SELECT take, unnest([a, b]) AS e FROM x UNION SELECT take, unnest([start_ns, end_ns]) FROM ends),
c AS (SELECT DISTINCT e.take, width, t FROM (SELECT take, width, unnest([e, e - width]) AS t FROM e, d) e JOIN ends ON ends.take = e.take WHERE width < end_ns - start_ns AND t >= start_ns AND t <= end_ns - width),
lo AS (SELECT c.take, c.width, c.t, c.t + c.width AS u, COALESCE(c.t * CAST(slope AS HUGEINT) - spent, 0) AS f FROM c ASOF LEFT JOIN g ON g.take = c.take AND c.t >= g.t),
hi AS (SELECT lo.take, lo.width, COALESCE(lo.u * CAST(slope AS HUGEINT) - spent, 0) - lo.f AS rise FROM lo ASOF LEFT JOIN g ON g.take = lo.take AND lo.u >= g.t),
w AS (SELECT take, SUM(CAST(weight AS HUGEINT) * (b - a)) AS whole FROM x GROUP BY take HAVING SUM(CAST(weight AS HUGEINT) * (b - a)) > 0), l AS (SELECT take, MAX(slope) AS slope FROM g GROUP BY take),
r AS (SELECT take, width, MAX(rise) AS rise FROM hi GROUP BY take, width)
SELECT r.take, width, ROUND(CAST(rise AS DOUBLE) / CAST(whole AS DOUBLE), 6) AS omega, ROUND(CAST(slope AS DOUBLE) * width / CAST(whole AS DOUBLE), 6) AS lipschitz, ROUND(POW(CAST(width AS DOUBLE) / (end_ns - start_ns), LN(2) / LN(3)), 6) AS cantor
FROM r JOIN w ON w.take = r.take JOIN l ON l.take = r.take JOIN ends ON ends.take = r.take""")
def continuity_moduli(spark, sf_dir):
    """The greatest rise of each take's sum within an hour, six hours and a day."""
    found = continuity.modulus(_weighted(spark, sf_dir), _spans(spark, sf_dir), "take", _WIDTHS)
    return found.select("take", "width", *[F.round(c, 6).alias(c) for c in ("omega", "lipschitz", "cantor")])


@query(f"""WITH {MESSAGES_SQL}, s AS (SELECT take, MIN(ns) AS t0, MAX(ns) AS t1 FROM m GROUP BY take),
p AS (SELECT take, ns, value FROM (SELECT take, ns, 1 AS given, seq, velocity AS value FROM m WHERE kind = 'control' AND note = 64 UNION ALL SELECT take, t0, 0, 0, 0 FROM s UNION ALL SELECT take, t1 + 60000000000, 0, 0, 0 FROM s)
  QUALIFY ROW_NUMBER() OVER (PARTITION BY take, ns ORDER BY given DESC, seq DESC) = 1),
c AS (SELECT take, ns, CAST(ROUND({_CONTACT} * 1000000) AS BIGINT) AS micro FROM p),
q AS (SELECT *, CAST(micro AS HUGEINT) * ((LEAD(ns) OVER o - ns) // 1000) AS spent, CAST(micro >= 500000 AND COALESCE(LAG(micro) OVER o, 0) < 500000 AS BIGINT) AS landing FROM c WINDOW o AS (PARTITION BY take ORDER BY ns)),
r AS (SELECT take, ns, micro / 1000000 AS contact, CAST(COALESCE(SUM(spent) OVER o, 0) AS DOUBLE) / 1000000000000 AS dwell, CAST(COALESCE(SUM(landing) OVER o, 0) AS BIGINT) AS landings FROM q WINDOW o AS (PARTITION BY take ORDER BY ns ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT take, ns, contact, ROUND(dwell, 3) AS dwell, landings, ROUND(dwell + 0.35 * landings, 3) AS integral FROM r""")
def damper_integrals(spark, sf_dir):
    found = continuity.damper_integral(_messages(spark, sf_dir))
    return found.select("take", "ns", "contact", F.round("dwell", 3).alias("dwell"), "landings", F.round("integral", 3).alias("integral"))


@query(f"""{_PAIRED}, p AS (SELECT *, ns_off - ns_on AS ns, EXISTS (SELECT 1 FROM m WHERE m.take = iv.take AND m.kind = 'control' AND m.ns > iv.ns_on AND m.ns < iv.ns_off) AS inside FROM iv WHERE trusted)
SELECT take, COUNT(*) AS notes, COUNT(*) FILTER (WHERE inside) AS with_control, MAX(ns) AS longest, FIRST(on_seq ORDER BY ns DESC, on_seq) AS longest_seq FROM p GROUP BY take""")
def notes_with_controls(spark, sf_dir):
    """How many of a take's notes have a control message in their life, and which is the longest."""
    heard = _messages(spark, sf_dir)
    held = continuity.held_messages(pairing.intervals(heard).where("trusted"), heard.where("kind = 'control'"))
    length = F.col("ns_off") - F.col("ns_on")
    return held.groupBy("take").agg(F.count("*").alias("notes"), F.count_if("inside").alias("with_control"), F.max(length).alias("longest"), F.max_by("on_seq", F.struct(length, -F.col("on_seq"))).alias("longest_seq"))


@query()
def map_corners(spark, sf_dir):
    """The smoothness at which each order's map bends most between fit and evenness."""
    from ..operators import warps

    rows = _maps(spark, sf_dir).select("pair", "t", F.col("phi").alias("s"))
    return warps.corners(rows, [0.001, 0.01, 0.1, 1.0, 10.0, 100.0])
