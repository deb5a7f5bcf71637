"""SimHash near-dedup against brute force, with every path forced."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tonefold.llm import queries, simhash

BREAKS = re.compile("[^\x20\x09-\x0d]+")


def brute_fingerprint(text, k=3):
    words = BREAKS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, most):
    """The smallest value reachable, by comparing all pairs."""
    label = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if (a ^ b).bit_count() <= most and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def expected(rows, most=3):
    marks = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(set(marks), most)
    least = {}
    for (i, _), m in zip(rows, marks):
        if i is not None:
            least[label[m]] = min(least.get(label[m], i), i)
    return sorted(((i, f"{m:016x}", least.get(label[m])) for (i, _), m in zip(rows, marks)), key=str)


def test_texts(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    base = [rng.choice(words) for _ in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, None), (4, ""), (5, " \t\x0b\n"), (6, "Two words"), (7, "two\x0cWORDS"), (8, "one"), (9, "Ünïcode ÄB  x"), (9, "Ünïcode ÄB  x"), (None, "one"), (None, "alone here now")]
    for i in range(20):
        copy = list(base)
        copy[rng.randrange(400)] = "other"
        rows.append((20 + i, " ".join(copy)))
    rows.append((99, " ".join(rng.choice(words) for _ in range(150_000))))
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, key string, fingerprint string, component_id int")
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.similar(docs).collect()), key=str)
    assert found == expected(rows)
    assert len({c for _, _, c in found}) < len({f for _, f, _ in found})  # some are linked


def nodes_of(rng, centres, each, flips):
    out = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        out |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, flips))) for _ in range(each)}
    return sorted(out)


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4, 6])
def test_pairs_are_all_pairs(spark, most):
    values = nodes_of(random.Random(most), 12, 25, most + 2)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "node long")
    found = {(r.a, r.b) for r in simhash.links(nodes, most).collect()}
    assert found == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= most}


@pytest.mark.parametrize("crowd", [1, 3])
def test_crowded_keys_lose_no_component(spark, crowd):
    from tonefold.llm.components import components

    values = nodes_of(random.Random(9), 3, 30, 4)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    pairs = simhash.links(spark.createDataFrame([(v,) for v in signed], "node long"), 3, crowd=crowd)
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 3 for r in pairs.collect())
    found = {r.node: r.component for r in components(pairs).collect()}
    label = brute_components(signed, 3) if all(v >= 0 for v in signed) else None
    if label is None:
        unsigned = brute_components(values, 3)
        label = {s: unsigned[v] for s, v in zip(signed, values)}
    groups = lambda of: sorted(sorted(v for v in signed if of(v) == g) for g in {of(v) for v in signed})
    assert groups(lambda v: found.get(v, v)) == groups(lambda v: label[v])


def test_dense_group_stays_connected_over_fewer_pairs(spark):
    """All 11-bit values: 236,544 pairs are linked; a value has no more than its hubs."""
    from tonefold.llm.components import components

    nodes = spark.range(1 << 11).select(F.col("id").alias("node"))
    pairs = simhash.crowded(nodes, 3)
    assert pairs.where("bit_count(a ^ b) > 3").isEmpty() and pairs.count() < 100_000
    assert components(pairs).where("component = 0").count() == 1 << 11


def test_empty_table(spark):
    assert simhash.similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_against_brute_force(spark):
    import os

    import oracle

    if not os.path.isdir(oracle.SF_DIR):
        pytest.skip("no tables here")
    rows = [(r.doc_id, r.text) for r in queries.table(spark, oracle.SF_DIR, "documents").collect()]
    found = [(r.doc_id, r.fingerprint, r.component_id) for r in queries.op11_pigeonring_simhash(spark, oracle.SF_DIR).collect()]
    assert sorted(found, key=str) == expected(rows)
