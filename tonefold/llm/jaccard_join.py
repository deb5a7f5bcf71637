"""Exact n-gram Jaccard self-join: candidates share prefix tokens under several global token orders.

A document's tokens are its distinct word shingles. If two sets x and y share o tokens, then under every global order of tokens the first
|x| - o + l tokens of x and the first |y| - o + l of y share l of these. Linked sets share o >= t / (1 + t) (|x| + |y|). Three orders are used:

1. Shingles that are rare in the corpus first. Only the prefixes under this order are joined. A pair's first common token stands at places that leave
   room for o tokens in both sets; of sets that were given words of their own to a common text nothing of that text is left in the prefixes that
   can still meet, unless they are linked.
2. and 3. Two orders by hash. Beside each set lie its prefixes under these, long enough for l to be a tenth of the set. Pairs stay only if they share so
   many tokens under each.

What passes all three is compared on whole sets; no text or set is fetched before.

Equal sets are one node. First every node that has a token is taken together with the token's hub, the node that has it and least of its own, and linked nodes are put
together. Only tokens whose nodes are in different parts then make further pairs, between the parts. So a group of copies costs
its size, not its square, and no link between parts is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Words, dropped, mix, numbered, only, rolling, texts_of, written
from .components import components

#: Counters of the corpus-wide count of shingles; fixed, so what is sent to executors never grows.
SKETCH_BITS = 22
BLOCK_BITS = 16
#: Orders by hash, besides the one by rarity.
HASHED = (1, 2)
#: Rows of ids that may be broadcast; more are joined by shuffling.
SMALL = 200_000


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text: runs of k words; of a shorter text the whole run; of no words none."""
    for _, _, data, bounds in texts_of(column):
        words = Words(data, bounds, lower=True)
        runs = rolling(words.hash, k)
        for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            if hi - lo >= k:
                yield np.unique(runs[lo : hi - k + 1])
            elif hi > lo:
                yield mix(rolling(words.hash[lo:hi], hi - lo) + np.uint64(hi - lo))
            else:
                yield np.zeros(0, np.uint64)


def signatures(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers for a set, independent of each other: equal sets have equal ones, different ones meet with odds of about sets^2 / 2^129."""
    with np.errstate(over="ignore"):
        first = mix(np.array([mix(tokens).sum(dtype=np.uint64) ^ np.uint64(len(tokens))], np.uint64))
        second = mix(np.array([mix(tokens * np.uint64(0xD1342543DE82EF95) + np.uint64(0x632BE5AB)).sum(dtype=np.uint64)], np.uint64))
    return int(first.view(np.int64)[0]), int(second.view(np.int64)[0])


def shingle_counts(docs: DataFrame, k: int, *, text_col: str = "text") -> np.ndarray:
    """A count per counter of the shingles of all documents. A shingle's counter is never below its number of documents."""
    width, block = 1 << SKETCH_BITS, 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        total = np.zeros(width, np.uint32)
        for batch in batches:
            for tokens in shingle_sets(batch.column(0), k):
                held.append((tokens & np.uint64(width - 1)).astype(np.int32))
                size += len(tokens)
                if size > 1 << 22:
                    total += np.bincount(np.concatenate(held), minlength=width).astype(np.uint32)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=width).astype(np.uint32)
        part = int(total[: 1 << 10].sum()) % 64  # any number below 64: spreads the partial sums
        for i in range(width // block):
            cells = total[i * block : (i + 1) * block]
            if cells.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([zlib.compress(cells.tobytes(), 1)], pa.binary())], names=["block", "part", "cells"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(block, np.uint64)
        for cells in rows["cells"]:
            total += np.frombuffer(zlib.decompress(cells), np.uint64 if len(zlib.decompress(cells)) == 8 * block else np.uint32)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "part": [0], "cells": [zlib.compress(total.tobytes(), 1)]})

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        cells = np.frombuffer(zlib.decompress(add(rows)["cells"].iloc[0]), np.uint64)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "cells": [zlib.compress(cells.astype(np.uint32).tobytes(), 1)]})

    schema = "block int, part int, cells binary"
    parts = only(docs, text_col).mapInArrow(count, schema).groupBy("block", "part").applyInPandas(add, schema)
    found = np.zeros(width, np.uint32)
    for row in parts.groupBy("block").applyInPandas(total, "block int, cells binary").collect():  # 4 * width bytes in all
        found[row.block * block : (row.block + 1) * block] = np.frombuffer(zlib.decompress(row.cells), np.uint32)
    return found


def _most_apart(n: int, percent: int) -> int:
    """Tokens of a set of n that a linked set may lack."""
    return n - -(-percent * n // 100)


def rare_first(tokens: np.ndarray, percent: int, counts: np.ndarray) -> tuple[np.ndarray, int]:
    """The set's prefix, rare shingles first, and a measure of how rare its shingles are on the whole."""
    at = counts[(tokens & np.uint64(len(counts) - 1)).astype(np.int64)].astype(np.uint64)
    rank = (np.minimum(at, np.uint64((1 << 31) - 1)) << np.uint64(32)) | (mix(tokens) >> np.uint64(32))
    size = _most_apart(len(tokens), percent) + 1
    rare = 1 - float(np.log2(np.maximum(at, 1)).mean()) / 32
    return tokens[np.argsort(rank, kind="stable")[:size]], int(rare * 65535)


def hashed_first(tokens: np.ndarray, percent: int, order: int) -> np.ndarray:
    """The set's prefix under an order by hash, as 32 bits of that hash; empty (which passes everything) if two tokens have the same."""
    n = len(tokens)
    with np.errstate(over="ignore"):
        found = np.sort(mix(tokens + np.uint64(order * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(32))[: _most_apart(n, percent) + 1 + n // 10].astype(np.uint32)
    return found if (found[1:] != found[:-1]).all() else found[:0]


def described(rows: DataFrame, k: int, percent: int, counts: np.ndarray) -> DataFrame:
    """key, id, s1, s2, n (the size of the set), rare, p0 (prefix, rare shingles first) and a prefix for each order by hash; rows: key, id, text."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)
    names = ["key", "id", "s1", "s2", "n", "rare", "p0", *(f"p{o}" for o in HASHED)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), *(pa.list_(pa.int32()) for _ in HASHED)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                out: list[list] = [[] for _ in names[2:]]
                for tokens in shingle_sets(batch.column(2), k):
                    if len(tokens):
                        prefix, rare = rare_first(tokens, percent, shared.value)
                        values = (*signatures(tokens), len(tokens), rare, prefix.view(np.int64), *(hashed_first(tokens, percent, o).view(np.int32) for o in HASHED))
                    else:
                        values = (None, None, 0, 0, *([],) * (1 + len(HASHED)))
                    for column, value in zip(out, values):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, kind) for v, kind in zip(out, kinds[2:]))], names=names)

    return rows.mapInArrow(run, "key long, id long, s1 long, s2 long, n long, rare int, p0 array<long>, " + ", ".join(f"p{o} array<int>" for o in HASHED))


def _overlap(percent: int, a: Column, b: Column) -> Column:
    """Tokens that linked sets of these sizes share at least."""
    return F.ceil(percent * (a + b) / F.lit(100 + percent))


def may_link(percent: int, a: str, b: str) -> Column:
    """Whether two postings (n, pos) of one token may be the first common token of linked sets."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = _overlap(percent, na, nb)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (na - F.col(f"{a}.pos") >= need) & (nb - F.col(f"{b}.pos") >= need)


def _of_some(df: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """The rows of df whose key stands in the pairs."""
    ids = written(pairs.select(F.col("a").alias(key)).union(pairs.select(F.col("b").alias(key))).distinct(), "ids")
    return df.join(F.broadcast(ids) if ids.count() <= SMALL else ids, key, "left_semi")


def met(pairs: DataFrame, all_rows: DataFrame) -> DataFrame:
    """The pairs (a, b, n_a, n_b) that share enough of their prefixes under each order by hash too."""
    some = _of_some(all_rows.select("key", *[f"p{o}" for o in HASHED]), "key", pairs)
    side = lambda s: some.select(F.col("key").alias(s), *[F.col(f"p{o}").alias(f"{s}{o}") for o in HASHED])
    full = pairs.join(side("b"), "b").join(side("a"), "a")
    least = F.floor(F.least("n_a", "n_b") / 10) + 1
    for o in HASHED:
        a, b = F.col(f"a{o}"), F.col(f"b{o}")
        full = full.where((F.size(a) == 0) | (F.size(b) == 0) | (F.size(F.array_intersect(a, b)) >= least))
    return full.select("a", "b", "n_a", "n_b")


def verified(pairs: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """The linked ones (a, b) among pairs (a, b, n_a, n_b), by comparing whole sets; rows: key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.view(np.int64) for t in shingle_sets(batch.column(1), k)], pa.list_(pa.int64()))], names=["key", "tokens"])

    sets = written(_of_some(rows.select("key", "text"), "key", pairs).mapInArrow(run, "key long, tokens array<long>"), "sets")
    side = lambda s: sets.select(F.col("key").alias(s), F.col("tokens").alias(f"t_{s}"))
    shared = F.size(F.array_intersect("t_a", "t_b"))
    links = pairs.join(side("b"), "b").join(side("a"), "a").where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")
    links = written(links, "links")
    dropped(sets)
    return links


def postings(all_rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """token, x (node, n, pos, index: whether a larger set may look for it here), hub (the one that has least of its own) of tokens that several nodes have."""
    held = all_rows.join(nodes.select(F.col("node").alias("key")), "key", "left_semi").select("key", "n", "rare", F.posexplode("p0").alias("pos", "token"))
    index = F.col("pos") <= F.col("n") - F.ceil(2 * percent * F.col("n") / F.lit(100 + percent))
    held = held.select("token", "rare", F.col("key").alias("node"), "n", "pos", index.alias("index"))
    several = held.groupBy("token").agg(F.count("*").alias("nodes"), F.max("index").alias("some")).where("nodes > 1 AND some").select("token")
    shared = written(held.join(several, "token"), "shared")  # most tokens are in one node: what is left is small
    x = F.struct("rare", "node", "n", "pos", "index")
    hubs = shared.groupBy("token").agg(F.min(x).alias("hub"))
    found = written(shared.select("token", x.alias("x")).join(hubs, "token"), "postings")
    dropped(shared)
    return found


def similar(docs: DataFrame, *, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id: the smallest id reachable over pairs of which 100 |A n B| >= percent |A u B|.

    Texts without words (null and empty ones) have no shingles and are linked with nothing. A row gives a row; rows with
    repeated ids stay apart unless their texts are linked. Rows with a null id get the smallest id of
    their component, null if it has none. Other columns are left aside.
    """
    counts = shingle_counts(docs, k, text_col=text_col)
    rows = numbered(docs, id_col, text_col).select("key", F.col("row")[id_col].cast("long").alias("id"), "text")
    all_rows = written(described(rows, k, percent, counts), "shingled")
    nodes = all_rows.where("n > 0").groupBy("s1", "s2").agg(F.min("key").alias("node"), F.min("id").alias("least"), F.first("n").alias("n"))
    nodes = written(nodes, "nodes")

    tokens = postings(all_rows, nodes, percent)
    ordered = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    sizes = lambda a, b: [F.when(F.col(f"{a}.node") < F.col(f"{b}.node"), F.col(f"{a}.n")).otherwise(F.col(f"{b}.n")).alias("n_a"), F.when(F.col(f"{a}.node") < F.col(f"{b}.node"), F.col(f"{b}.n")).otherwise(F.col(f"{a}.n")).alias("n_b")]
    stars = tokens.where((F.col("x.node") != F.col("hub.node")) & may_link(percent, "x", "hub")).select(*ordered("x.node", "hub.node"), *sizes("x", "hub")).distinct()
    stars = written(stars, "stars")
    links = verified(written(met(stars, all_rows), "met"), rows, k, percent)
    parts = components(links)

    placed = tokens.join(parts, F.col("x.node") == parts["node"], "left").select("token", "x", F.coalesce("component", "x.node").alias("part"))
    mixed = placed.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("token")
    placed = written(placed.join(mixed, "token"), "placed")
    x = placed.where("x.index").select("token", "x", "part")
    y = placed.select("token", F.col("x").alias("y"), F.col("part").alias("other"))
    smaller = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.node") < F.col("y.node")))
    apart = x.join(y, "token").where((F.col("part") != F.col("other")) & smaller & may_link(percent, "x", "y"))
    apart = apart.select(*ordered("x.node", "y.node"), *sizes("x", "y")).distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti")
    apart = written(apart, "apart")
    links = links.unionByName(verified(written(met(apart, all_rows), "met"), rows, k, percent))
    parts = components(links)
    dropped(tokens, placed, stars, apart)

    labels = nodes.join(parts, "node", "left").select("s1", "s2", "least", F.coalesce("component", "node").alias("part"))
    lowest = labels.groupBy("part").agg(F.min("least").alias("component_id"))
    labels = labels.join(lowest, "part").select("s1", "s2", "component_id")
    out = all_rows.select("id", "n", "s1", "s2").join(labels, ["s1", "s2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
