"""DuckDB SQL for the rows of the corpus queries that SQL can express."""

from __future__ import annotations

from . import licence_scan, quality_rules, revisits

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def quality() -> str:
    classes = {"lower": "[^a-z]", "space": r"[^\x20\x09-\x0D]", "other": r"[\x00-\x7F]", "upper": "[^A-Z]", "digit": "[^0-9]", "symbol": "[^#*$%&|<>]", "mark": r"[a-zA-Z0-9#*$%&|<>\x20\x09-\x0D]|[^\x00-\x7F]"}
    cells = " UNION ALL ".join(f"SELECT r, lang, 'c:{name}' AS key, length(regexp_replace(text, '{drop}', '', 'g')) AS n FROM d" for name, drop in classes.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format("text")} AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
grams AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
covered AS (SELECT r, count(DISTINCT spot) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS spot FROM grams WHERE c > 1) GROUP BY r),
base AS (
  SELECT r, doc_id, lang, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, length(text) AS chars
  FROM w LEFT JOIN covered USING (r)),
said AS (SELECT r, lang, unnest({_WORDS.format("lower(text)")}) AS x FROM d),
common AS (SELECT lang, x FROM (SELECT lang, x, count(*) AS n FROM said WHERE regexp_matches(x, '^\p{{L}}+$') GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, x) <= {quality_rules.COMMON}),
found AS (SELECT s.r, s.lang, 'w:' || s.x AS key, count(*) AS n FROM said s JOIN common c ON s.x = c.x AND s.lang IS NOT DISTINCT FROM c.lang GROUP BY ALL),
rest AS (SELECT b.r, b.lang, 'w:' AS key, n_words - coalesce(sum(n), 0) AS n FROM base b LEFT JOIN found f ON b.r = f.r GROUP BY b.r, b.lang, n_words),
cells AS (SELECT * FROM ({cells} UNION ALL SELECT * FROM found UNION ALL SELECT * FROM rest) WHERE n > 0),
sums AS (SELECT lang, key, sum(n) AS n, left(key, 1) AS kind FROM cells GROUP BY ALL),
shares AS (SELECT lang, key, n / sum(n) OVER (PARTITION BY lang, kind) AS q FROM sums),
parts AS (
  SELECT c.r, left(c.key, 1) AS kind, n / CASE WHEN left(c.key, 1) = 'c' THEN chars ELSE n_words END AS p, q
  FROM cells c JOIN base b ON c.r = b.r JOIN shares s ON c.key = s.key AND c.lang IS NOT DISTINCT FROM s.lang),
plain AS (SELECT lang, sum(n) FILTER (WHERE key = 'w:') / sum(n) AS q FROM sums WHERE kind = 'w' GROUP BY lang),
js AS (SELECT r, kind, 0.5 + sum((p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q)) - q) / 2) AS js FROM parts GROUP BY r, kind),
judged AS (
  SELECT b.*, CASE WHEN chars > 0 THEN c.js ELSE 0 END AS cjs, CASE WHEN n_words > 0 THEN w.js ELSE 0 END AS wjs, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    coalesce(o.n, 0) / n_words AS own, n_words * (1 - coalesce(p.q, 0)) AS expected
  FROM base b LEFT JOIN js c ON c.r = b.r AND c.kind = 'c' LEFT JOIN js w ON w.r = b.r AND w.kind = 'w' LEFT JOIN rest o ON o.r = b.r LEFT JOIN plain p ON p.lang IS NOT DISTINCT FROM b.lang),
bared AS (SELECT *, CASE WHEN own > 0 THEN (log2(2 / (1 + own)) + own * log2(2 * own / (1 + own)) + 1 - own) / 2 ELSE 1 END AS bare FROM judged)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, round(cjs, 6) AS class_divergence, round(wjs, 6) AS word_divergence,
  NOT base_failed AND (n_words < {quality_rules.MIN_WORDS} OR (cjs <= {quality_rules.CLASS_LIMIT} AND (expected < {quality_rules.TELLING} OR wjs <= bare + {quality_rules.NOISE} / n_words + {quality_rules.ROUNDING}))) AS kept
FROM bared"""


def jaccard(k: int, percent: int) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{upper}', '{upper.lower()}')")} AS ws FROM documents),
s AS (SELECT DISTINCT r, array_to_string(ws[i : i + {k - 1}], ' ') AS sh FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - {k - 1}, least(len(ws), 1)) + 1)) AS i FROM w)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.r < y.r GROUP BY x.r, y.r) p
  JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT r, r FROM w UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, min(o.doc_id) AS component_id
FROM w JOIN reach ON reach.a = w.r JOIN w o ON o.r = reach.b LEFT JOIN n ON n.r = w.r GROUP BY w.r, w.doc_id, n.n"""


def substrings(length: int) -> str:
    return rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + {length - 1}], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {length - 2})) AS i FROM w)),
late AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {length})) AS i FROM late),
cut AS (SELECT doc_id, list(i) AS cut FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(cut), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN cut IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(cut, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN cut ON w.doc_id = cut.doc_id"""


def licences() -> str:
    every = licence_scan.sentences()
    of = lambda sentence: licence_scan.expression(sentence, " ", " ")
    case = "CASE " + " ".join(f"WHEN regexp_full_match(s, '{of(text)}') THEN '{name}'" for name, text in every) + " END"
    plain = "lower(text)"
    for pattern, mark in licence_scan.MARKED:
        plain = f"regexp_replace({plain}, '{pattern}', '{mark}', 'g')"
    # each mark twice: one ends a sentence, one begins the next
    plain = f"replace(replace(trim({plain}), 'L', 'LL'), 'P', 'PP')"
    sentences = "|".join(licence_scan.expression(text, "(?: |LL)", "(?: |LL|PP)") for _, text in every)
    pattern = f"(?:^|[LP])({sentences})(?:[LP]|$)"
    found = f"list_transform(regexp_extract_all(p, '{pattern}', 1), lambda s: replace(replace(s, 'LL', ' '), 'PP', ' '))"
    between = f"list_transform(regexp_split_to_array(p, '{pattern}'), lambda x: (len(x) - len(replace(x, 'P', ''))) // 2)"
    steps = [f"a AS (SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), '{licence_scan.ANCHORS}') THEN {plain} ELSE '' END AS p FROM documents)", f"b AS (SELECT doc_id, list_transform({found}, lambda s: {case}) AS ids, {between} AS u FROM a)"]
    steps.append(f"s0 AS (SELECT doc_id, ids, ' ' || array_to_string(list_transform(ids, lambda x, i: CASE WHEN u[i] > {licence_scan.APART} THEN ';  ' || x ELSE x END), '  ') || ' ' AS rest, CAST([] AS VARCHAR[]) AS found FROM b)")
    for i, (licence, ids) in enumerate(licence_scan.RULES):
        rule = " " + "  ".join(ids) + " "
        now = f"CASE WHEN contains(rest, '{rule}') AND NOT list_contains(found, '{licence}') THEN list_append(found, '{licence}') ELSE found END" if licence else "found"
        steps.append(f"s{i + 1} AS (SELECT doc_id, ids, replace(rest, '{rule}', ' ; ') AS rest, {now} AS found FROM s{i})")
    return f"WITH {', '.join(steps)} SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ',') AS sentences, array_to_string(found, ',') AS licences FROM s{len(licence_scan.RULES)}"


def containment(k: int, percent: int) -> str:
    runs = "SELECT r, {0} AS k, array_to_string(ws[i : i + {0} - 1], ' ') AS sh FROM (SELECT r, ws, unnest(range(1, len(ws) - {0} + 2)) AS i FROM {1} WHERE {2})"
    items = " UNION ".join(runs.format(j, "b", f"len(ws) = {j}" if j < k else f"len(ws) >= {k}") for j in range(1, k + 1))
    held = " UNION ".join(runs.format(j, "d", f"{j} IN (SELECT k FROM bs)") for j in range(1, k + 1))
    words = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
b AS (SELECT row_number() OVER () AS r, item_id, {words} FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bs AS ({items}), ds AS ({held}),
n AS (SELECT r, count(*) AS n FROM bs GROUP BY r),
shared AS (SELECT ds.r AS dr, bs.r AS br, count(*) AS c FROM ds JOIN bs ON ds.k = bs.k AND ds.sh = bs.sh GROUP BY ds.r, bs.r)
SELECT doc_id, item_id, n AS n_shingles, c AS n_shared FROM shared JOIN d ON d.r = dr JOIN b ON b.r = br JOIN n ON n.r = br WHERE 100 * c >= {percent} * n"""


def not_modified() -> str:
    url = "regexp_replace(trim(url), '#.*$', '')"
    host = rf"regexp_replace(regexp_replace(lower(regexp_extract({url}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')"
    path = rf"regexp_replace(regexp_extract({url}, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?]*([^?]*)', 1), '(;jsessionid=[^/]*)?/*$', '')"
    pairs = rf"list_sort(list_filter(string_split(regexp_extract({url}, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^({revisits.TRACKING})(=|$)')))"
    return f"""
WITH p AS (
  SELECT page_id, {host} || {path} || CASE WHEN len({pairs}) > 0 THEN '?' || array_to_string({pairs}, '&') ELSE '' END AS url_key,
    '"' || substring(sha256(html), 1, 16) || '"' AS tag, strftime(make_timestamp((1600000000 + page_id * 60) * 1000000), '%Y-%m-%d %H:%M:%S') AS date, CAST(octet_length(encode(html)) AS VARCHAR) AS size
  FROM pages),
r AS (
  SELECT page_id * 2 AS record_id, url_key, page_id * 10 AS seen, 'response' AS kind, tag AS etag, date AS modified, date, size FROM p
  UNION ALL
  SELECT page_id * 2 + 1, url_key, page_id * 10 + 5 + (page_id * 7919) % 200000, 'revisit', CASE WHEN page_id % 4 <= 1 THEN tag END, CASE WHEN page_id % 4 <= 2 THEN date END, NULL, NULL FROM p),
f AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN {{'id': record_id, 'etag': etag, 'modified': modified, 'date': date, 'size': size}} END IGNORE NULLS)
    OVER (PARTITION BY url_key ORDER BY seen, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS o FROM r),
g AS (
  SELECT *, CASE WHEN o IS NULL THEN 'missing' WHEN etag IS NOT NULL THEN CASE WHEN etag = o.etag THEN 'resolved' ELSE 'changed' END
    WHEN modified IS NOT NULL THEN CASE WHEN modified = o.modified THEN 'resolved' ELSE 'changed' END ELSE 'unchecked' END AS status
  FROM f WHERE kind = 'revisit')
SELECT record_id, url_key, CASE WHEN status = 'resolved' THEN o.id END AS response_id, status,
  CASE WHEN status = 'resolved' THEN 'cache-control=max-age=600;content-length=' || o.size || ';content-type=text/html;date=' || o.date || ';x-cache=hit'
    ELSE 'cache-control=max-age=600;content-length=0;x-cache=hit' END AS headers
FROM g"""


def centroids(k: int = 40, rounds: int = 5, dimensions: int = 64) -> str:
    """Rounds one after the other; every distance in whole numbers."""
    x = "CAST(FLOOR(256 * CAST(x AS DOUBLE)) AS BIGINT)"
    fine = f"embedding IS NOT NULL AND len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x) < 524288)) = {dimensions}"
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id, embedding) AS r, list_transform(embedding, lambda x: {x}) AS v FROM embeddings WHERE {fine})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || COALESCE(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v AS m FROM v QUALIFY c < {k})",
    ]
    distance = "list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v, c, CAST({distance} AS BIGINT) AS d FROM v, c{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)")
        if i < rounds:
            steps.append(f"u{i} AS (SELECT c, j, SUM(v[j]) AS s, COUNT(*) AS n FROM a{i}, (SELECT unnest(range(1, {dimensions + 1})) AS j) GROUP BY c, j)")
            steps.append(f"n{i} AS (SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY j) AS m FROM u{i} GROUP BY c)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, COALESCE(n{i}.m, c{i}.m) AS m FROM c{i} LEFT JOIN n{i} ON n{i}.c = c{i}.c)")
    last = f"a{rounds}"
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST({last}.c AS INTEGER) AS cluster, d AS distance, CAST(SUM(d) OVER (PARTITION BY {last}.c) AS BIGINT) AS cluster_inertia, CAST(SUM(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} ON c{rounds}.c = {last}.c"""
