import random

from tonefold.llm import revisits

SCHEMA = "record_id long, url string, at long, kind string, etag string, modified string, headers map<string,string>, extra string"


def brute(rows):
    out = {}
    for r in rows:
        if r[3] != "revisit":
            continue
        earlier = [x for x in rows if x[3] == "response" and x[1].split("#")[0] == r[1].split("#")[0] and (x[2], x[0]) < (r[2], r[0])]
        if not earlier:
            out[r[0]] = (None, "missing")
            continue
        of = max(earlier, key=lambda x: (x[2], x[0]))
        if r[4] and of[4]:
            same = r[4].removeprefix("W/") == of[4].removeprefix("W/")
        elif r[5] and of[5]:
            same = r[5] == of[5]
        else:
            out[r[0]] = (None, "unchecked")
            continue
        out[r[0]] = (of[0], "resolved") if same else (None, "changed")
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(800):
        url = "http://h.example/hot" if rng.random() < 0.6 else f"http://h.example/{rng.randint(0, 30)}"
        rows.append((i, url + rng.choice(["", "#top"]), rng.randint(0, 300), rng.choice(["response", "revisit", "revisit"]), rng.choice([None, '"a"', 'W/"a"', '"b"']), rng.choice([None, "m1", "m2"]), {"h": str(i)}, "x"))
    for partitions in (1, 7, 40):
        found = {r.record_id: (r.response_id, r.status) for r in revisits.resolve(spark.createDataFrame(rows, SCHEMA), partitions=partitions).collect()}
        assert found == brute(rows)


def test_headers_and_edges(spark):
    rows = [
        (1, "HTTP://WWW.Ex.com:80/a/?utm_source=q&b=2&a=1", 5, "response", '"t"', None, {"content-type": "text/html", "cache-control": "old", "date": "d"}, "x"),
        (2, "https://ex.com/a?a=1&b=2#f", 5, "revisit", 'W/"t"', None, {"content-type": "none", "cache-control": "new"}, "x"),
        (3, None, 6, "revisit", '"t"', None, None, "x"),
        (4, "https://ex.com/a?a=1&b=2", None, "revisit", '"t"', None, {}, "x"),
        (5, "https://ex.com/a?a=1&b=2", 9, "revisit", None, None, None, "x"),
    ]
    out = {r.record_id: r for r in revisits.resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[2].response_id == 1 and out[2].headers == {"content-type": "text/html", "cache-control": "new", "date": "d"}
    assert {i: out[i].status for i in (3, 4, 5)} == {3: "missing", 4: "missing", 5: "unchecked"}
    assert revisits.resolve(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_ids_and_other_kinds(spark):
    url = "http://m.ex.com/a.html"
    rows = [(1, url, 1, "response", '"t"', None, {}, "x"), (2, url, 2, "revisit", '"t"', None, {}, "x"), (2, url, 3, "revisit", '"u"', None, {}, "x"), (3, url, 2, "metadata", '"z"', None, {}, "x"), (4, "http://ex.com/a", 9, "revisit", '"t"', None, {}, "x")]
    out = sorted((r.record_id, r.response_id is not None, r.status) for r in revisits.resolve(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(2, False, "changed"), (2, True, "resolved"), (4, False, "missing")]


def test_canonical_urls(spark):
    same = ["http://www.Ex.com:80/a/?b=2&a=1&utm_source=q", "https://ex.com/a?a=1&b=2&sid=9#x", "//ex.com/a;jsessionid=77?a=1&b=2"]
    other = ["http://m.ex.com/a?a=1&b=2", "http://ex.com/a.html?a=1&b=2", "http://ex.com/a?a=1&b=2&ref=home", "http://ex.com/A?a=1&b=2"]
    df = spark.createDataFrame([(u,) for u in same + other], "url string")
    keys = [r[0] for r in df.select(revisits.canonical(df.url)).collect()]
    assert set(keys[:3]) == {"ex.com/a?a=1&b=2"} and len(set(keys)) == 5
