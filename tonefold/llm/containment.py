"""Benchmark decontamination: test items found inside documents by size-partitioned MinHash, verified by exact shingle containment.

Shingles are five words of letters and digits in lower case; an item of fewer words is one shingle of all of them. A document contains an item if it
holds `percent` of the item's distinct shingles or more. An item's MinHash sketch is its k smallest shingle hashes with k = n - ceil(percent n) + 1: a
document that contains it holds one of any k of its shingles, so the search loses nothing. Items are partitioned
by size; each partition has its smallest size and the largest hash in its sketches. A document's sketch is its shingles with hashes up to the largest of
the partitions whose items are small enough for it; long items have low ones. Matches are then verified on all shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import only, written

SHINGLE = 5
#: Rows of a side that may be broadcast (of two or three numbers each); a larger side is joined by shuffling.
SMALL = 200_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def _runs(w: str, k: int) -> Column:
    """Hashes of the runs of k words of the array w; those of other k differ."""
    rest = "".join(f", get({w}, i + {j})" for j in range(1, k))
    return F.expr(f"transform(slice({w}, 1, greatest(size({w}) - {k - 1}, 0)), (x, i) -> xxhash64({k}, x{rest}))")


def shingled(df: DataFrame, text: str, short: list[int] | None = None) -> DataFrame:
    """df with shingles: distinct hashes of five consecutive words and of the numbers of words in `short`; without `short`, of a text of fewer than five words that of all of them."""
    df = df.withColumn("w", _words(F.col(text)))
    if short is None:
        runs = _runs("w", SHINGLE)
        for k in range(1, SHINGLE):
            runs = F.when(F.size("w") == k, _runs("w", k)).otherwise(runs)
    else:
        runs = F.concat(_runs("w", SHINGLE), *[_runs("w", k) for k in short])
    return df.withColumn("shingles", F.array_distinct(runs)).withColumn("n_words", F.size("w")).drop("w")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def contained(docs: DataFrame, items: DataFrame, *, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """id, item, n_shingles (the item's), n_shared: a row for each document and item that it contains.

    Items without words are in no document. Items of fewer than five words are in the documents that hold these words in a row. Null ids and
    texts match nothing. Repeated documents or items give repeated rows. Very long texts are searched whole.
    """
    items = shingled(only(items, item_col, text_col).toDF("item", "item_text").dropna(), "item_text").where("size(shingles) > 0").withColumn("n", F.size("shingles"))
    items = written(items.select("item", "n", "shingles", "n_words", F.monotonically_increasing_id().alias("item_row")), "items")
    short = [r.n_words for r in items.where(F.col("n_words") < SHINGLE).select("n_words").distinct().collect()]  # four numbers at most
    keep = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    sketches = items.withColumn("sketch", F.slice(F.array_sort("shingles"), 1, keep.cast("int"))).withColumn("part", F.length(F.bin("n")))
    parts = sketches.groupBy("part").agg(F.min("n").alias("least"), F.max(F.element_at("sketch", -1)).alias("bound")).collect()  # one for each power of two
    sketches = sketches.select("item_row", F.explode("sketch").alias("hash"))

    docs = only(docs, id_col, text_col).toDF("id", "text").dropna()
    bound = F.array_max(F.array(F.lit(None).cast("long"), *[F.when(100 * F.size("shingles") >= percent * p.least, F.lit(p.bound)) for p in parts]))
    offered = shingled(docs, "text", short).withColumn("bound", bound).select("id", F.explode(F.filter("shingles", lambda h: h <= F.col("bound"))).alias("hash"))
    found = written(offered.join(_small(sketches), "hash").select("id", "item_row").distinct(), "found")

    sets = shingled(docs.join(_small(found), "id"), "text", short).drop("text", "n_words")
    both = sets.withColumnRenamed("shingles", "held").join(items.drop("n_words"), "item_row").withColumn("n_shared", F.size(F.array_intersect("held", "shingles")))
    return both.where(100 * F.col("n_shared") >= percent * F.col("n")).select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("n").cast("long").alias("n_shingles"), F.col("n_shared").cast("long").alias("n_shared"))
