"""Removal of repeated passages: every word in a window of `length` words that also begins earlier in the corpus.

An index per shard of documents would have every document searched in every shard. Here shards are cut by content: each window belongs
to the shard of its smallest word 8-gram, and consecutive windows with the same smallest 8-gram travel as one
segment, so all places of a window meet in one shard and the work grows with the corpus.

1. Count the segments' 8-grams; one that occurs once holds no repeat (unless inside itself, which is seen at once).
2. Equal segments are one text with a number of places, the first of which counts; a text goes to its shard once.
3. Each shard builds a compressed index over its texts and streams them through it by backward search. Each window's matching statistic, held at
   `length`, and its interval of suffixes give the first place at which it begins: whether that is before the text's own first place decides for this
   place; for all later places of an equal text it is.
4. Texts of an 8-gram with very many different ones (a line or passage in very many contexts) would fill a shard with contexts of which nothing repeats. Before
   they go to the index, windows that occur once are cut off them; what is left of the contexts is mostly equal, and one text again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from .common import Words, dropped, mix, numbered, powers, rolling, texts_of, written
from .fm_index import repeats

GRAM = 8
#: Windows in a segment, at most; texts of one 8-gram from which on their single windows are cut off first; texts of a shard, about.
LONGEST, MANY, SHARD = 1024, 3000, 3000


def segments(rows: DataFrame, length: int) -> DataFrame:
    """gram, content (hash of all words), key, start (word), n (windows) of each segment, loops: a window might repeat inside it."""
    names = ["gram", "content", "key", "start", "n", "loops"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, hi, data, bounds in texts_of(batch.column(1)):
                words = Words(data, bounds)
                doc = np.repeat(np.arange(hi - lo), np.diff(words.first))
                grams = rolling(words.hash, GRAM)
                least, span = grams, 1
                while 2 * span <= length - GRAM + 1:
                    least = np.minimum(least[:-span], least[span:])
                    span *= 2
                rest = length - GRAM + 1 - span
                least = np.minimum(least[: len(least) - rest], least[rest:]) if len(least) > rest else least[:0]
                at = np.flatnonzero(doc[: len(least)] == doc[length - 1 : length - 1 + len(least)])
                if not len(at):
                    continue
                least = least[at]
                twice = np.zeros(len(at), np.int8)
                for i in range(length - GRAM + 1):
                    twice += grams[at + i] == least
                new = np.ones(len(at), bool)
                new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
                begin = np.flatnonzero(new)
                n = np.diff(np.append(begin, len(at)))
                loops = (np.maximum.reduceat(twice, begin) > 1) | (n > length - GRAM + 1)
                if n.max() > LONGEST:  # cut long runs
                    parts = -(-n // LONGEST)
                    inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    begin = np.repeat(begin, parts) + inner * LONGEST
                    loops = np.repeat(loops, parts)
                    n = np.minimum(np.repeat(n, parts) - inner * LONGEST, LONGEST)
                first = at[begin]
                p, inv = powers(len(words.hash) + 1)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * p[: len(words.hash)], dtype=np.uint64)])
                content = mix((total[first + n + length - 1] - total[first]) * inv[first] + n.astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least[begin].view(np.int64)), pa.array(content.view(np.int64)), pa.array(keys[lo:hi][doc[first]]), pa.array((first - words.first[doc[first]]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(loops)], names=names
                )

    return rows.select("key", "text").mapInArrow(run, "gram long, content long, key long, start int, n int, loops boolean")


def _asked(rows: DataFrame, wanted: DataFrame, fields: list[str]) -> DataFrame:
    """key, text and asked, the wanted spans of it, of documents that have any."""
    wanted = wanted.groupBy("key").agg(F.collect_list(F.struct(*fields)).alias("asked"))
    return rows.select("key", "text").join(wanted, "key")


def words_of(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """gram, content, key, start, words: the hashes of the words of the wanted segments (gram, content, key, start, n)."""
    names = ["gram", "content", "key", "start", "words"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: list[list] = [[] for _ in names]
                wants, keys = batch.column(2).to_pylist(), batch.column(0).to_pylist()
                for lo, _, data, bounds in texts_of(batch.column(1)):
                    words = Words(data, bounds)
                    for i, first in enumerate(words.first[:-1].tolist()):
                        for want in wants[lo + i]:
                            s = first + want["start"]
                            for column, value in zip(out, (want["gram"], want["content"], keys[lo + i], want["start"], words.hash[s : s + want["n"] + length - 1].tobytes())):
                                column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)

    return _asked(rows, wanted, ["gram", "content", "start", "n"]).mapInArrow(run, "gram long, content long, key long, start int, words binary")


def windows_of(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """gram, key, segment (its start), at, window: the hash of each window of the wanted segments (gram, key, start, n)."""
    names = ["gram", "key", "segment", "at", "window"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(0, whole.num_rows, 256):
                batch = whole.slice(row, 256)
                out: list[list] = [[] for _ in names]
                wants, keys = batch.column(2).to_pylist(), batch.column(0).to_pylist()
                for lo, _, data, bounds in texts_of(batch.column(1)):
                    words = Words(data, bounds)
                    runs = rolling(words.hash, length)
                    for i, first in enumerate(words.first[:-1].tolist()):
                        for want in wants[lo + i]:
                            n, s = want["n"], want["start"]
                            for column, values in zip(out, (np.full(n, want["gram"]), np.full(n, keys[lo + i]), np.full(n, s), np.arange(s, s + n), runs[first + s : first + s + n].view(np.int64))):
                                column.append(values)
                columns = [np.concatenate(v) if v else np.zeros(0, np.int64) for v in out]
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in columns], names=names)

    return _asked(rows, wanted, ["gram", "start", "n"]).mapInArrow(run, "gram long, key long, segment long, at long, window long")


def without_single_windows(rows: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """Segments (gram, key, start, n) left of the texts (gram, key, start, n) when windows that occur once are cut off. Counts are combined before they are shuffled."""
    every = written(windows_of(rows, texts, length), "windows")
    often = every.groupBy("window").count().where("count > 1").select("window")
    left = every.join(often, "window").withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("gram", "key", "segment").orderBy("at")))
    left = written(left.groupBy("gram", "key", "segment", "run").agg(F.min("at").cast("int").alias("start"), F.count("*").cast("int").alias("n")).select("gram", "key", "start", "n"), "left")
    dropped(every)
    return left


def searched(texts: DataFrame, length: int) -> DataFrame:
    """gram, content, offset, n, earlier: the windows of each text (gram, content, key, start, words) in runs, and whether these begin earlier than here in their shard."""
    shards = max(1, -(-texts.count() // SHARD))
    names, types = ["gram", "content", "offset", "n", "earlier"], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())

    def search(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("key", "ascending"), ("start", "ascending")])
        found = repeats([np.frombuffer(w, np.uint64) for w in shard["words"].to_pylist()], length)
        out: list[list] = [[] for _ in names]
        for gram, content, flags in zip(shard["gram"].to_pylist(), shard["content"].to_pylist(), found):
            edges = [0, *(np.flatnonzero(flags[1:] != flags[:-1]) + 1).tolist(), len(flags)]
            for a, b in zip(edges, edges[1:]):
                for column, value in zip(out, (gram, content, a, b - a, bool(flags[a]))):
                    column.append(value)
        return pa.table({name: pa.array(v, t) for name, v, t in zip(names, out, types)})

    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(search, "gram long, content long, offset int, n int, earlier boolean")


def repeated_runs(rows: DataFrame, length: int) -> DataFrame:
    """key, start, n: n windows from word `start` on, each of which also begins earlier; rows: key, text."""
    places = segments(rows, length)
    often = written(places.groupBy("gram").count().where("count > 1"), "grams")
    places = places.join(often.hint("shuffle_hash"), "gram", "left").where("count is not null or loops").select("gram", "content", "key", "start", "n", "loops")
    places = written(places, "places")

    texts = places.groupBy("gram", "content").agg(F.min(F.struct("key", "start")).alias("first"), F.first("n").alias("n"), F.count("*").alias("places"), F.max("loops").alias("loops"))
    texts = written(texts, "texts")
    kinds = texts.groupBy("gram").agg(F.count("*").alias("kinds"), F.max("places").alias("most"))
    # of an 8-gram with one text in one place only loops can repeat
    texts = texts.join(kinds, "gram").where("kinds > 1 OR most > 1 OR loops").select("gram", "content", "first.key", "first.start", "n", F.col("kinds").alias("kinds"))
    texts = written(texts, "competing")
    some = words_of(rows, texts.where(F.col("kinds") <= MANY), length)

    many = texts.where(F.col("kinds") > MANY)
    cut = without_single_windows(rows, many, length)
    # a later place of a whole equal text is cut like its first one
    also = places.join(many.select("gram", "content", F.col("key").alias("k"), F.col("start").alias("s")), ["gram", "content"]).where("key <> k OR start <> s").select("key", "start", "n")
    cut = words_of(rows, cut.withColumn("content", F.lit(0).cast("long")), length).withColumn("content", F.xxhash64("words"))
    cut_places = written(cut, "cut")
    cut_texts = cut_places.groupBy("gram", "content").agg(F.min_by("words", F.struct("key", "start")).alias("words"), F.min(F.struct("key", "start")).alias("first"))
    whole = written(some.unionByName(cut_texts.select("gram", "content", "first.key", "first.start", "words")), "content")
    found = written(searched(whole, length), "found")
    firsts = whole.select("gram", "content", F.col("key").alias("k"), F.col("start").alias("s"))

    at = places.select("gram", "content", "key", "start").unionByName(cut_places.select("gram", "content", "key", "start"))
    at = at.join(firsts, ["gram", "content"]).join(found, ["gram", "content"]).where("earlier OR key <> k OR start <> s")
    return at.select("key", (F.col("start") + F.col("offset")).alias("start"), "n").unionByName(also)


def dedup(docs: DataFrame, *, length: int = 20, id_col: str = "doc_id", text_col: str = "text", keep_layout: bool = False, counts: bool = True) -> DataFrame:
    """docs with its text replaced by the kept words, joined by one space, and, if counts, n_words and n_removed (in place of columns of these names).

    Windows are judged on the input: the first of equal windows (by id, then place) stays. With keep_layout, a text that loses
    nothing stays as it was. Null and empty texts become empty. Rows with repeated ids count as documents in the order of
    their texts, rows with null ids come last. Other columns go along, whatever their names.
    """
    rows = numbered(docs, id_col, text_col)
    runs = repeated_runs(rows.select("key", "text"), length)
    runs = runs.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    joined = rows.join(runs, "key", "left").select("row", "runs")
    fields = [f for f in docs.schema.fields if not (counts and f.name in ("n_words", "n_removed"))]
    docs_names, kept_names = docs.columns, [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                columns = dict(zip(docs_names, batch.column(0).flatten()))
                cuts = batch.column(1).to_pylist()
                kept, n_words, removed = [], [], []
                for lo, _, data, bounds in texts_of(columns[text_col].cast(pa.large_string())):
                    words = Words(data, bounds)
                    raw = data.tobytes()
                    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                        gone = np.zeros(b - a + 1, np.int32)
                        for cut in cuts[lo + i] or ():
                            gone[cut["start"]] += 1
                            gone[cut["start"] + cut["n"] + length - 1] -= 1
                        stay = np.cumsum(gone[:-1]) == 0
                        n_words.append(b - a)
                        removed.append(int(b - a - stay.sum()))
                        if keep_layout and not removed[-1]:
                            kept.append(raw[bounds[i] : bounds[i + 1]].decode())
                        else:
                            kept.append(b" ".join([raw[s:e] for s, e in zip(words.begin[a:b][stay].tolist(), words.end[a:b][stay].tolist())]).decode())
                columns[text_col] = pa.array(kept, pa.string())
                added = [pa.array(n_words, pa.int64()), pa.array(removed, pa.int64())] if counts else []
                yield pa.RecordBatch.from_arrays([columns[f] for f in kept_names] + added, names=kept_names + ["n_words", "n_removed"] * counts)

    schema = StructType(list(fields))
    if counts:
        schema = schema.add("n_words", "long").add("n_removed", "long")
    return joined.mapInArrow(run, schema)
