"""Streams give what batches give, however they are cut."""

import random

from pyspark.sql import functions as F

from tonefold.operators import matching, sessions
from tonefold.streaming import sessions as streaming_sessions
from tonefold.streaming import votes


def test_votes_equal_batch(spark, tmp_path):
    rng = random.Random(2)
    tunes = {t: [rng.randint(60, 66) for _ in range(40)] for t in range(6)}
    themes = spark.createDataFrame([(t, i, p) for t, x in tunes.items() for i, p in enumerate(x)], "theme long, seq long, note int")
    indexed = matching.index(sessions.ngrams(themes, ["theme"], ["seq"], "note", n=3, clamp=15)).cache()
    played = [(10 + t, i, p) for t in range(3) for i, p in enumerate(tunes[t][5:30])]
    batch = sessions.ngrams(spark.createDataFrame(played, "query long, seq long, note int"), ["query"], ["seq"], "note", n=3, clamp=15)
    expected = sorted(map(tuple, matching.votes(batch, indexed).select("query", "theme", "diagonal", "hits", "first", "last").collect()))

    source, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "take long, seq long, note int"
    for cut in range(4):
        part = [r for r in played if r[1] * 4 // 25 == cut]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = votes.grams(spark.readStream.schema(schema).parquet(source), n=3, clamp=15)
        query = stream.writeStream.foreachBatch(votes.sink(indexed, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    found = votes.totals(spark, out).select("query", "theme", "diagonal", "hits", "first", "last")
    assert sorted(map(tuple, found.collect())) == expected and expected


def test_sessions_close_by_watermark(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(1, 0), (1, 4), (1, 9), (1, 30), (2, 5), (1, 100), (2, 100), (3, 1000)]
    spark.createDataFrame(rows, "take long, s long").select("take", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(source)
    stream = streaming_sessions.sessions(spark.readStream.schema("take long, ts timestamp").parquet(source))
    query = stream.writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    found = spark.table("closed").select("take", F.unix_seconds("start"), F.unix_seconds("last"), "n")
    assert sorted(map(tuple, found.collect())) == [(1, 0, 9, 3), (1, 30, 30, 1), (1, 100, 100, 1), (2, 5, 5, 1), (2, 100, 100, 1)]
