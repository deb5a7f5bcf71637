"""The capture source and pairing on a stream that grows by uneven cuts."""

from pyspark.sql import functions as F

from tonefold.operators import framing, pairing
from tonefold.sources import capture
from tonefold.streaming import pairing as streaming

HEAD = "# capture 1\n# anchor_ns 100\n"
BODY = "".join(f"{1_000_000_000 + i * 5_000_000} {'90 3C 64' if i % 2 == 0 else '80 3C 40'}\n" for i in range(40))
TAIL = "# end packets 40 dropped 0\n"


def test_torn_and_unterminated_lines():
    rows, at = capture.parse("p", b"1 90 3C 64\n2 80 3C", 0)
    assert [r[3] for r in rows] == [1] and at == 11
    rows, at = capture.parse("p", b"1 90\n2 ZZ NOPE\n3 80\n", 0)
    assert [r[3] for r in rows] == [1] and at == 5
    assert capture.parse("p", b"2 80", 50) == ([], 50)


def test_batch(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_text(HEAD + BODY + TAIL)
    capture.register(spark)
    rows = spark.read.format("capture").option("paths", str(path)).load()
    assert {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()} == {"header": 2, "packet": 40, "trailer": 1}


def test_stream_equals_batch(spark, tmp_path):
    path, out, checkpoint = tmp_path / "b.txt", str(tmp_path / "out"), str(tmp_path / "cp")
    capture.register(spark)
    text = HEAD + BODY + TAIL

    def run():
        rows = spark.readStream.format("capture").option("path", str(path)).load()
        packets = rows.where("kind = 'packet'").select(F.lit(1).cast("long").alias("take"), "ns", "byte_offset", framing.split_messages("data").alias("parts"))
        kind, _, d1, d2 = framing.classify(F.col("raw"))
        messages = packets.select("take", "ns", F.posexplode("parts").alias("i", "raw"), "byte_offset").select("take", (F.col("byte_offset") * 16 + F.col("i")).alias("seq"), "ns", kind.alias("kind"), d1.alias("note"), d2.alias("velocity"))
        ends = rows.where("kind = 'trailer'").select(F.lit(1).cast("long").alias("take"), (F.col("byte_offset") * 16).alias("seq"), F.lit(2_000_000_000).cast("long").alias("ns"))
        both = messages.unionByName(streaming.end_of_take(ends))
        query = streaming.intervals(both).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for cut in (len(HEAD) + 7, len(HEAD) + 200, len(HEAD) + 211, len(text) - 3, len(text)):
        path.write_text(text[:cut])
        run()
    stream = sorted((r.ns_on, r.ns_off, r.closure) for r in spark.read.parquet(out).collect())
    rows = [(1, i, int(line.split()[0]), "note_on" if i % 2 == 0 else "note_off", 60, 1) for i, line in enumerate(BODY.splitlines())]
    batch = pairing.intervals(spark.createDataFrame(rows, "take long, seq long, ns long, kind string, note int, velocity int"))
    assert stream == sorted((r.ns_on, r.ns_off, r.closure) for r in batch.collect()) and len(stream) == 20
