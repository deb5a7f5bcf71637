"""Stored takes: commits are all or nothing, increments equal the whole, rewritten captures get another run."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tonefold.operators import ingest, pairing
from tonefold.sources import takes

MESSAGES = "take long, seq long, ns long, kind string, note int, velocity int"
TABLES = ("messages", "roles", "intervals", "defects", "held")


def contents(spark, path, take=None):
    """The rows of all tables without run and version."""
    out = {}
    for name in TABLES:
        rows = ingest.table(spark, path, name).drop("run", "version")
        rows = rows if take is None else rows.where(F.col("take") == take)
        out[name] = sorted((tuple(r) for r in rows.drop("take").collect()), key=str)
    return out


def made(rng, n):
    ns, rows = 10**9, []
    for seq in range(n):
        ns += rng.choice([-3, 0, 5, 5, 5, 40_000]) * 10**6
        kind = rng.choice(["note_on"] * 4 + ["note_off"] * 4 + ["control", "undecodable", "system"])
        rows.append((seq, ns, kind, 64 if kind == "control" else rng.randint(60, 64), rng.randint(1, 127)))
    return rows


def capture_text(rng, n, trailer=True):
    lines = ["# capture 1", "# source test"]
    for i in range(n):
        lines.append(f"{10**9 + i * 5_000_000} {'90' if rng.random() < 0.5 else '80'} {rng.randint(60, 63):02X} {rng.randint(1, 127):02X}" + (" B0 40 7F" if i % 7 == 0 else ""))
    return "\n".join(lines + (["# end packets 1"] if trailer else [])) + "\n"


def test_increments_equal_the_whole(spark, tmp_path):
    rng = random.Random(1)
    rows = [(t, *r) for t in (1, 2) for r in made(rng, 60)]
    whole, parts = str(tmp_path / "whole"), str(tmp_path / "parts")
    ended = spark.createDataFrame([(1, True), (2, True)], "take long, complete boolean")
    ingest.store(spark.createDataFrame(rows, MESSAGES), ended, whole)
    for lo, hi in ((0, 1), (1, 25), (25, 25), (25, 60)):
        now = ended if hi == 60 else ended.withColumn("complete", F.lit(False))
        ingest.store(spark.createDataFrame([r for r in rows if lo <= r[1] < hi], MESSAGES), now, parts)
    found = contents(spark, parts)
    assert found == contents(spark, whole) and not found["held"] and found["defects"]
    batch = pairing.intervals(spark.createDataFrame(rows, MESSAGES)).select("note", "on_seq", "off_seq", "ns_on", "ns_off", "velocity_on", "velocity_off", "closure")
    assert found["intervals"] == sorted(map(tuple, batch.collect()), key=str)
    expected = pairing.defects(spark.createDataFrame(rows, MESSAGES)).select("seq", "cls")
    assert found["defects"] == sorted(map(tuple, expected.collect()), key=str)
    assert [(r.run, r.version, r.messages, r.complete) for r in ingest.progress(spark, parts).collect()] == [(0, 3, 60, True)] * 2


def test_a_growing_capture(spark, tmp_path):
    rng = random.Random(2)
    text = capture_text(rng, 60)
    live, whole = tmp_path / "live", tmp_path / "whole"
    whole.write_text(text)
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    ingest.captures(spark, {1: str(whole)}, a)
    for i in (0, 2, 5, 9, 11):  # cuts within lines too
        live.write_text(text[: len(text) * i // 11])
        last = ingest.captures(spark, {1: str(live)}, b).first()
        assert last.reason == "" and last.complete == (i == 11)
    assert contents(spark, b) == contents(spark, a) and last.to_offset == len(text)
    commits = len(takes.Store(b).commits())
    again = ingest.captures(spark, {1: str(live)}, b).first()
    assert (again.from_offset, again.to_offset, again.reason) == (len(text), len(text), "") and len(takes.Store(b).commits()) == commits  # nothing new, nothing committed


def test_keys_stay_down_until_the_end_is_there(spark, tmp_path):
    live, path = tmp_path / "live", str(tmp_path / "s")
    live.write_text("# capture 1\n1000000000 90 3C 64\n")
    ingest.captures(spark, {1: str(live)}, path)
    assert [len(contents(spark, path)[t]) for t in TABLES] == [1, 1, 0, 0, 1]
    with live.open("a") as f:
        f.write("3000000000 B0 40 00\n# end packets 2\n")
    ingest.captures(spark, {1: str(live)}, path)
    found = contents(spark, path)
    assert found["held"] == [] and [(r[3:5], r[-1]) for r in found["intervals"]] == [((1000000000, 3000000000), "end_of_take")]


def test_rewritten_and_shortened_captures_get_another_run(spark, tmp_path):
    rng = random.Random(3)
    files = {1: tmp_path / "one", 2: tmp_path / "two", 3: tmp_path / "three"}
    for f in files.values():
        f.write_text(capture_text(rng, 30, trailer=False))
    path = str(tmp_path / "s")
    names = {t: str(f) for t, f in files.items()}
    ingest.captures(spark, names, path)
    before = contents(spark, path, 3)
    files[1].write_text(capture_text(rng, 60).replace("# source test", "# source tess"))  # longer, so that its beginning alone tells
    files[2].write_text(files[2].read_text()[:200])
    found = {r.take: r for r in ingest.captures(spark, names, path).collect()}
    assert "other bytes" in found[1].reason and "shorter" in found[2].reason and found[3].reason == ""
    assert {t: r.run for t, r in found.items()} == {1: 1, 2: 1, 3: 0} and found[1].from_offset == 0
    fresh = str(tmp_path / "fresh")
    ingest.captures(spark, names, fresh)
    assert contents(spark, path) == contents(spark, fresh) and contents(spark, path, 3) == before


def entries(spark, rows):
    messages = spark.createDataFrame([(t, s, s, "note_on", 60, 1, 0, 0) for t, s in rows], MESSAGES + ", run long, version long")
    return ingest._entries(messages, "messages")


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    ok = entries(spark, [(1, i) for i in range(4)])
    takes.register(spark)
    broken = ok.repartition(4).withColumn("kind", F.when(F.col("seq") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("kind")))
    with pytest.raises(Exception, match="lost"):
        broken.select(*ok.columns).write.format("takes").mode("append").option("path", path).save()
    assert takes.Store(path).commits() == {} and ingest._raw(spark, path, "messages").count() == 0
    takes.Store(path).sweep()  # tasks that Spark killed had no chance to
    assert os.listdir(f"{path}/staged") == []
    ok.write.format("takes").mode("append").option("path", path).save()
    assert takes.Store(path).sweep() == 0 and ingest._raw(spark, path, "messages").count() == 4


def test_a_repeated_commit_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    takes.register(spark)
    for _ in range(2):
        entries(spark, [(1, 0), (1, 1)]).write.format("takes").mode("append").options(path=path, commit="first").save()
    assert ingest._raw(spark, path, "messages").count() == 2 and list(takes.Store(path).commits()) == ["first"]
    with pytest.raises(Exception, match="appended"):
        entries(spark, [(1, 0)]).write.format("takes").mode("overwrite").option("path", path).save()


def test_stream_commits_once_a_batch(spark, tmp_path):
    path, source, checkpoint = str(tmp_path / "s"), str(tmp_path / "in"), str(tmp_path / "cp")
    takes.register(spark)
    schema = MESSAGES + ", run long, version long"

    def run(check):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = ingest._entries(stream, "messages").writeStream.format("takes").option("path", path).option("checkpointLocation", check).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    for part in range(3):
        spark.createDataFrame([(1, part * 10 + i, i, "note_on", 60, 1, 0, 0) for i in range(10)], schema).coalesce(1).write.mode("append").parquet(source)
        run(checkpoint)
    assert sorted(r.seq for r in ingest._raw(spark, path, "messages").collect()) == list(range(30)) and len(takes.Store(path).commits()) == 3
    run(str(tmp_path / "lost"))  # the checkpoint is lost: batches come again under their numbers
    assert ingest._raw(spark, path, "messages").count() == 30
