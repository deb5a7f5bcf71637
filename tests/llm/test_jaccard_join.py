import itertools
import random
import re

import pytest

from tonefold.llm import jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, node string, n long"


def shingles(text, k):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)}


def brute(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets))), key=str)


def got(spark, rows, k, percent):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in jaccard_join.similar(docs, k=k, percent=percent).collect()), key=str)


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_against_all_pairs(spark, k, percent):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 90))] for _ in range(12)]
    rows = []
    for doc in range(150):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words += passage
        rows.append((doc, " ".join(words).upper() if rng.random() < 0.1 else "\n".join(words)))
    assert got(spark, rows, k, percent) == brute(rows, k, percent)


def test_edges(spark):
    rows = [(5, None), (4, ""), (3, " \t"), (2, "one two"), (1, "ONE two"), (9, "one two three four five"), (7, "one two three four five"), (7, "one two three four five"), (7, "quite another text with many words"), (None, "one two three four five"), (None, "alone here")]
    assert got(spark, rows, 4, 85) == brute(rows, 4, 85)
    assert got(spark, [], 4, 85) == []
    texts = [" ".join(f"{x}{i}" for i in range(60)) for x in "abc"]
    rows = [(3, texts[0]), (3, texts[1]), (3, texts[2]), (5, texts[1] + " end"), (6, texts[0] + " end"), (2, texts[2] + " end")]
    assert got(spark, rows, 4, 85) == brute(rows, 4, 85)
    long = " ".join(f"t{i}" for i in range(60_000))
    assert got(spark, [(1, long), (2, long + " more")], 4, 85) == [(1, 59_997, 1), (2, 59_998, 1)]


def test_unlinked_copies_of_a_template_make_no_pairs(spark, monkeypatch):
    """240 words in common and 30 of its own in each (similarity 0.78): nothing to compare, however many there are; with 15 of their own a star."""
    asked = []
    met = jaccard_join.met
    monkeypatch.setattr(jaccard_join, "met", lambda pairs, rows: asked.append(pairs.count()) or met(pairs, rows))
    template = [f"t{i}" for i in range(240)]
    for n, own, most in ((100, 30, 0), (300, 30, 0), (300, 15, 299)):
        asked.clear()
        rows = [(d, " ".join(template + [f"o{d}_{i}" for i in range(own)])) for d in range(n)]
        found = got(spark, rows, 4, 85)
        assert sum(asked) <= most
        assert {r[2] for r in found} == (set(range(n)) if own == 30 else {0})


def test_clashing_names_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (4, text + " end"), (9, text), (7, "other words only here")]
    docs = spark.createDataFrame([(d, t, 1, "x", 2, 3) for d, t in rows], "doc_id long, text string, key int, row string, id long, n long")
    found = {tuple(r) for r in jaccard_join.similar(docs, k=4, percent=85).collect()}
    assert found == {(None, 57, 4), (4, 58, 4), (9, 57, 4), (7, 1, 7)}


def test_orders_give_what_the_theorem_says():
    import numpy as np

    rng = np.random.default_rng(1)
    counts = rng.integers(1, 50, 1 << 10).astype(np.uint32)
    for _ in range(300):
        x = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 200))).astype(np.uint64))
        drop = int(rng.integers(0, len(x) // 8 + 1))
        y = np.unique(np.concatenate([x[rng.permutation(len(x))[drop:]], rng.integers(0, 2**63, int(rng.integers(0, len(x) // 10 + 1))).astype(np.uint64)]))
        if 100 * len(np.intersect1d(x, y)) < 85 * len(np.union1d(x, y)):
            continue
        assert set(jaccard_join.rare_first(x, 85, counts)[0]) & set(jaccard_join.rare_first(y, 85, counts)[0])
        for order in jaccard_join.HASHED:
            a, b = jaccard_join.hashed_first(x, 85, order), jaccard_join.hashed_first(y, 85, order)
            assert len(np.intersect1d(a, b)) >= min(len(x), len(y)) // 10 + 1
        assert (jaccard_join.signatures(x) == jaccard_join.signatures(y)) == (x.tolist() == y.tolist())
