"""Spelling variants against brute force."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import oracle
import pytest

from tonefold.llm import queries, spelling

COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


def expected(rows, least=7, occurrences=2, times=10):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            counts[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 31 == 0 else word] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least and c >= occurrences}
    near, holes = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + "?" + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in n:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= times * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("block", [1, 4, 512])
def test_random_words(spark, block):
    """Words of two letters only, so that halves are crowded and prefixes and suffixes overlap."""
    rng = random.Random(block)
    word = lambda: "".join(rng.choice("abÀ") for _ in range(rng.randint(6, 9)))
    known = [word() for _ in range(60)]
    rows = [(i, " ".join(rng.choice(known[: rng.choice((3, 60))]) for _ in range(60))) for i in range(40)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    found = rows_of(spelling.variants(docs, block=block, times=3))
    assert found == expected(rows, times=3) and any(r[3] for r in found)


def test_texts(spark):
    long_text = "letters " * 200_000 + "lettres lettres"
    rows = [(1, "Grammar GRAMMAR grammer"), (1, "grammer Ünderwater ünderwater"), (None, "Grammar x÷yzabcde x÷yzabcde"), (2, None), (3, ""), (4, "123 -- 4"), (5, long_text), (5, long_text), (6, "z" * 3000 + " " + "z" * 3001), (7, "z" * 3000 + " " + "z" * 3001)]
    found = rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == expected(rows)
    assert ("lettres", 4, 0, None, None, "lettres") in found  # two neighbours changed about are two edits
    assert {r[0]: r[2] for r in found}["z" * 3000] == 1


def test_roots_follow_forms(spark):
    """A chain of four words, each ten times as frequent as the one before and one edit away."""
    chain = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx"]
    rows = [(0, " ".join(w for i, w in enumerate(chain) for _ in range(2 * 10**i)))]
    assert all(zlib.crc32(f"0:{w}".encode()) % 31 for w in chain)
    found = {r[0]: r for r in rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert [found[w][3] for w in chain] == [*chain[1:], None] and {r[5] for r in found.values()} == {chain[-1]}
    assert sorted(found.values()) == expected(rows)


def test_pieces_cut_no_run(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 5)
    text = "abcdefghij klm  nop qrstuvwxyzabc"
    pieces = list(spelling._pieces(text))
    assert "".join(pieces) == text and len(pieces) > 2 and re.findall("[a-z]+", text) == [w for p in pieces for w in re.findall("[a-z]+", p)]


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.skipif(not os.path.isdir(oracle.SF_DIR), reason="no tables here")
def test_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, oracle.SF_DIR, "documents").collect()]
    assert rows_of(queries.op12_spelling_variants(spark, oracle.SF_DIR)) == expected(rows)
