"""Not-modified revisits of web archives, resolved to the full responses they stand for.

A revisit record says that a page had not changed: it has the headers of a 304 answer and no body. It belongs to the latest earlier
full response of the same canonical URL, if its validators agree with that response's: the entity tag (compared weakly)
where the revisit has one, else the modification date. The resolved record has the response's headers, updated with those of the
revisit that a 304 answer may change.

The as-of join is skew-proof: records are dealt by ranges of (URL, time), so one URL may span many partitions;
each partition finds the latest response within itself, and what comes from earlier partitions is carried in from one
row per partition and URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import written

#: Headers of the stored body, which a 304 answer doesn't change.
BODY_HEADERS = ("content-encoding", "content-length", "content-md5", "content-range", "content-type", "transfer-encoding", "etag-body")
#: Query parameters of trackers and sessions, which don't choose the page.
TRACKING = "utm_[a-z]+|fbclid|gclid|jsessionid|phpsessid|sessionid|sid"


def canonical(url: Column, ignored: str = TRACKING) -> Column:
    """Lower-case host without www. or a default port, path without session or closing slash, parameters in order without `ignored` ones; no scheme or fragment."""
    url = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?]*)", 1)), "^www\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?]*([^?]*)", 1), "(;jsessionid=[^/]*)?/*$", "")
    pairs = F.array_sort(F.filter(F.split(F.regexp_extract(url, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(f"^({ignored})(=|$)")))
    return F.concat(host, path, F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""))


def resolve(records: DataFrame, *, partitions: int | None = None, ignored: str = TRACKING) -> DataFrame:
    """record_id, url_key, response_id, status, headers of each revisit of records.

    records: record_id, url, at (time, any order), kind (`response` or `revisit`), etag, modified, headers (map, names in lower case). Where times are
    equal, record ids decide. status: `resolved`; `changed` where validators disagree; `unchecked` where they can't be compared;
    `missing` where no response comes earlier. Only resolved ones have a response_id; headers are the merged ones or else the revisit's
    own. Records with a null URL, time or id are resolved with nothing. Records of other kinds are neither resolved nor resolved with. Of records with one id each
    revisit gives a row; responses of one URL, time and id stand in any order. Other columns are left aside.
    """
    spark = records.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = records.select("record_id", canonical(F.col("url"), ignored).alias("url_key"), "at", "kind", "etag", "modified", "headers")
    whole = F.col("url_key").isNotNull() & F.col("at").isNotNull() & F.col("record_id").isNotNull()
    dealt = written(wanted.where(whole).repartitionByRange(n, "url_key", "at", "record_id").withColumn("part", F.spark_partition_id()), "dealt")

    own = F.when(F.col("kind") == "response", F.struct("at", "record_id", "etag", "modified", "headers"))
    dealt = dealt.withColumn("response", own)
    before = Window.partitionBy("part", "url_key").orderBy("at", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.last("response", ignorenulls=True).over(before)).where("kind = 'revisit'")

    # per URL and partition the last response, for URLs that go over more than one
    ends = dealt.groupBy("url_key", "part").agg(F.max_by("response", F.when(F.col("response").isNotNull(), F.struct("at", "record_id"))).alias("last"))
    several = ends.groupBy("url_key").agg(F.count("*").alias("parts")).where("parts > 1").select("url_key")
    earlier = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(several, "url_key").select("url_key", "part", F.last("last", ignorenulls=True).over(earlier).alias("carried"))

    found = near.join(carried, ["url_key", "part"], "left").withColumn("of", F.coalesce("near", "carried"))
    weak = lambda tag: F.regexp_replace(tag, "^[Ww]/", "")
    same = F.when(F.col("etag").isNotNull() & F.col("of.etag").isNotNull(), weak(F.col("etag")) == weak(F.col("of.etag"))).when(F.col("modified").isNotNull() & F.col("of.modified").isNotNull(), F.col("modified") == F.col("of.modified"))
    status = F.when(F.col("of").isNull(), "missing").when(same.isNull(), "unchecked").when(same, "resolved").otherwise("changed")
    may = F.map_filter(F.coalesce("headers", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*BODY_HEADERS))
    kept = F.map_filter(F.coalesce("of.headers", F.create_map().cast("map<string,string>")), lambda k, v: ~F.array_contains(F.map_keys(may), k))
    out = found.withColumn("status", status).select(
        "record_id", "url_key", F.when(F.col("status") == "resolved", F.col("of.record_id")).alias("response_id"), "status",
        F.when(F.col("status") == "resolved", F.map_concat(kept, may)).otherwise(F.col("headers")).alias("headers"),
    )
    lost = wanted.where(~whole & (F.col("kind") == "revisit")).select("record_id", "url_key", F.lit(None).cast(dict(out.dtypes)["response_id"]).alias("response_id"), F.lit("missing").alias("status"), "headers")
    return out.unionByName(lost)


def captures(pages: DataFrame) -> DataFrame:
    """Archive records from pages: each page is a full response at the time of its id, and each is asked for again later.

    The second visit is a not-modified answer with the validator of the response that it was made for: its tag (weak for some), or
    its date, or none. As other captures of the same canonical URL lie between, some have gone stale.
    """
    tag = F.concat(F.lit('"'), F.substring(F.sha2(F.col("html"), 256), 1, 16), F.lit('"'))
    date = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.col("page_id") * 60), "yyyy-MM-dd HH:mm:ss")
    length = F.octet_length("html").cast("string")
    response = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("at"), F.lit("response").alias("kind"), tag.alias("etag"), date.alias("modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), length, F.lit("cache-control"), F.lit("max-age=60"), F.lit("date"), date).alias("headers"),
    )
    turn = F.pmod(F.col("page_id"), F.lit(4))
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 10 + 5 + F.pmod(F.col("page_id") * 7919, F.lit(200_000))).alias("at"), F.lit("revisit").alias("kind"),
        F.when(turn == 0, F.concat(F.lit("W/"), tag)).when(turn == 1, tag).alias("etag"), F.when(turn <= 2, date).alias("modified"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.lit("max-age=600"), F.lit("x-cache"), F.lit("hit")).alias("headers"),
    )
    return response.unionByName(revisit)
