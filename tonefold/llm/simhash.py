"""SimHash near-dedup: fingerprints that differ in few bits are linked; candidates come from a pigeonring filter.

A 64-bit fingerprint is cut into a ring of segments, one more than the bits that linked fingerprints may differ in (four of 16 bits for three). If two
fingerprints differ in at most that many bits, then from some segment on, going round the ring, the first j segments differ in at most j - 1 bits
together, for every j. Such a chain is asked for in two steps:

1. Its first two segments make the join key: the first is equal, the second differs in one bit at most. Of two values that differ in one
   bit one has it set, so it is enough to look up each value as it is and with each of its set bits cleared, among the values as they are.
2. The longer prefixes of the chain are held against their budgets in the condition of the join, and last the whole fingerprints.

Equal fingerprints are one node, so copies cost one row. A key that very many different fingerprints have is not joined with itself but looked up exactly: see `crowded`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import Words, dropped, numbered, texts_of, written
from .components import components

BITS, SEED = 64, 42
#: Shingles of a text that are held at once.
BLOCK = 1 << 16
#: Different fingerprints of a key that are compared with each other; of keys that have more, see `crowded`.
CROWD = 4096


def fingerprint(words: list[bytes], k: int) -> int:
    """The bits that over half of the XXH64 (seed 42) of the text's runs of k words have, repeats included; 0 without words."""
    n = len(words) - k + 1 if len(words) >= k else min(1, len(words))
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, BLOCK):
        hashes = np.fromiter((digest(b" ".join(words[i : i + k]), SEED) for i in range(lo, min(n, lo + BLOCK))), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(rows: DataFrame, k: int) -> DataFrame:
    """key, id, fingerprint (as a signed number) of rows (key, id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lo, hi, data, bounds in texts_of(batch.column(2)):
                words = Words(data, bounds, lower=True, hashed=False)
                raw = words.data.tobytes()
                begin, end, first = words.begin.tolist(), words.end.tolist(), words.first.tolist()
                found += [fingerprint([raw[a:b] for a, b in zip(begin[i:j], end[i:j])], k) for i, j in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(found, np.uint64).view(np.int64))], names=["key", "id", "fingerprint"])

    return rows.mapInArrow(run, "key long, id long, fingerprint long")


def _ring(most: int) -> list[int]:
    """Masks of the segments, as equal as they can be."""
    cuts = [BITS * i // (most + 1) for i in range(most + 2)]
    return [(1 << b) - (1 << a) for a, b in zip(cuts[:-1], cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _chain(masks: list[int], start: int, length: int) -> int:
    return sum(masks[(start + i) % len(masks)] for i in range(length))


def _differ(a: Column, b: Column, mask: int = (1 << BITS) - 1) -> Column:
    return F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(_signed(mask))))


def _cleared(value: Column, mask: int) -> Column:
    """The value with each of its set bits within the mask cleared."""
    bits = [_signed(1 << i) for i in range(BITS) if mask >> i & 1]
    each = [F.when(value.bitwiseAND(F.lit(b)) != 0, value.bitwiseAND(F.lit(_signed(~b & (1 << BITS) - 1)))) for b in bits]
    return F.array_compact(F.array(*each))


def postings(nodes: DataFrame, masks: list[int]) -> tuple[DataFrame, DataFrame]:
    """Rows (start, key, node): what each node looks up, and what it is found under. Without a second segment (a ring of one) all values must be equal."""
    node = F.col("node")

    def keyed(start: int, keys: Column) -> Column:
        return F.transform(keys, lambda key: F.struct(F.lit(start).cast("tinyint").alias("start"), key.alias("key")))

    own, near = [], []
    for i in range(len(masks)):
        whole = node.bitwiseAND(F.lit(_signed(_chain(masks, i, 2))))
        own.append(keyed(i, F.array(whole)))
        near.append(keyed(i, F.concat(F.array(whole), _cleared(whole, masks[(i + 1) % len(masks)]))))
    found = nodes.select("node", F.explode(F.concat(*own)).alias("p")).select("p.start", "p.key", "node")
    asked = nodes.select("node", F.explode(F.concat(*near)).alias("p")).select("p.start", "p.key", "node")
    return asked, found


def _within(masks: list[int], most: int, a: str, b: str) -> Column:
    """The budgets of the chain's longer prefixes, then the whole fingerprints."""
    held = F.lit(True)
    for length in range(3, len(masks)):
        for i in range(len(masks)):
            held = held & ((F.col("start") != i) | (_differ(F.col(a), F.col(b), _chain(masks, i, length)) <= length - 1))
    return held & (_differ(F.col(a), F.col(b)) <= most)


def crowded(nodes: DataFrame, most: int) -> DataFrame:
    """Pairs (a, b) that connect all nodes of which linked ones are among them, at a cost per node, however near each other they lie.

    Each value is taken with every choice of up to `most` of its set bits cleared; two values within `most` bits meet where each has lost what the other hasn't. The value
    that lost least there is linked with any that it may be linked with by these losses, and so connects all of them.
    """
    bits = [_signed(1 << i) for i in range(BITS)]
    level = nodes.select("node", F.col("node").alias("at"), F.lit(BITS).alias("below"), F.lit(0).alias("lost"))
    out = level
    for _ in range(most):
        choices = F.array_compact(F.array(*[F.when((F.col("below") > i) & (F.col("at").bitwiseAND(F.lit(b)) != 0), F.lit(i)) for i, b in enumerate(bits)]))
        level = level.withColumn("bit", F.explode(choices)).select("node", F.expr("at & ~shiftleft(1L, bit)").alias("at"), F.col("bit").alias("below"), (F.col("lost") + 1).alias("lost"))
        out = out.unionByName(level)
    hubs = out.groupBy("at").agg(F.min(F.struct("lost", "node")).alias("hub"), F.count("*").alias("n")).where("n > 1").select("at", "hub")
    met = out.join(hubs, "at").where((F.col("node") != F.col("hub.node")) & (F.col("lost") + F.col("hub.lost") <= most))
    return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def links(nodes: DataFrame, most: int, *, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b), a < b, of nodes that differ in at most `most` bits: all of them, but among the nodes of a crowded key only what connects the same nodes."""
    masks = _ring(most)
    if len(masks) < 2:
        return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    asked, found = postings(nodes, masks)
    size = found.groupBy("start", "key").agg(F.count("*").alias("n"))
    full = written(size.where(F.col("n") > crowd).select("start", "key"), "crowded")
    some = not full.isEmpty()
    left = asked.join(full, ["start", "key"], "left_anti") if some else asked
    pairs = left.select("start", "key", F.col("node").alias("x")).join(found.select("start", "key", F.col("node").alias("y")), ["start", "key"]).where((F.col("x") != F.col("y")) & _within(masks, most, "x", "y"))
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    if some:
        inside = asked.join(full, ["start", "key"], "left_semi").select("node").distinct()
        pairs = pairs.unionByName(crowded(inside, most))
    pairs = written(pairs.distinct(), "links")
    dropped(full)
    return pairs


def similar(docs: DataFrame, *, k: int = 3, most: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id: the smallest id reachable over pairs of fingerprints that differ in at most `most` bits.

    Words are runs of anything but white space of ASCII, A-Z in lower case; a text of fewer than k words is one shingle. Texts without words, null and empty ones,
    have the fingerprint 0 and are linked like any other. A row gives a row, whether ids or texts repeat or not. Rows with a null id get the smallest id of their
    component, null if it has none. Other columns are left aside.
    """
    if not 0 <= most < BITS // 2:
        raise ValueError("most must be below half of the bits")
    rows = numbered(docs, id_col, text_col).select("key", F.col("row")[id_col].cast("long").alias("id"), "text")
    found = written(fingerprints(rows, k), "fingerprints")
    nodes = written(found.groupBy(F.col("fingerprint").alias("node")).agg(F.min("id").alias("least")), "nodes")
    pairs = links(nodes.select("node"), most)
    parts = nodes.join(components(pairs), "node", "left").select("node", "least", F.coalesce("component", "node").alias("part"))
    lowest = parts.groupBy("part").agg(F.min("least").alias("component_id"))
    labels = parts.join(lowest, "part").select(F.col("node").alias("fingerprint"), "component_id")
    out = found.select("id", "fingerprint").join(labels, "fingerprint")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
