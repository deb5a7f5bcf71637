import random
import re

import numpy as np

from tonefold.llm import fm_index, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, words string, _runs_ long"


def brute(rows, length):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or "")):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            window = tuple(words[i : i + length])
            if window in seen:
                gone[i : i + length] = [True] * length
            seen.add(window)
        out.append((doc, " ".join(w for w, g in zip(words, gone) if not g), len(words), sum(gone)))
    return sorted(out, key=str)


def got(spark, rows, length=20):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    out = substring_dedup.dedup(docs, length=length)
    return sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in out.collect()), key=str)


def made(n, seed, words=400):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 60))] for _ in range(6)]
    rows = []
    for doc in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            at = rng.randint(0, len(text))
            text[at:at] = p[a:] if rng.random() < 0.5 else p
        rows.append((doc, rng.choice([" ", "\n", "\t "]).join(text)))
        if rng.random() < 0.1:
            rows[-1] = (doc, rng.choice(rows)[1])
    rows += [(n, "same " * 300), (n + 1, "same " * 500), (n + 2, "a b " * 100), (n + 3, None), (n + 4, ""), (n + 5, "Été " * 30)]
    return rows


def test_against_all_windows(spark):
    rows = made(120, 1)
    assert got(spark, rows) == brute(rows, 20)


def test_hot_and_long(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "MANY", 5)
    monkeypatch.setattr(substring_dedup, "SHARD", 7)
    monkeypatch.setattr(substring_dedup, "LONGEST", 16)
    rows = made(150, 2)
    assert got(spark, rows) == brute(rows, 20)


def test_edges(spark):
    text = " ".join(f"t{i}" for i in range(50))
    rows = [(1, text), (1, text + " end"), (None, text), (2, text), (2, text), (None, None)]
    assert got(spark, rows) == brute(rows, 20)
    assert got(spark, []) == []
    long = " ".join(f"u{i}" for i in range(70_000))
    assert got(spark, [(1, long), (2, "x " + long)]) == brute([(1, long), (2, "x " + long)], 20)


def test_clashing_names(spark):
    text = " ".join(f"t{i}" for i in range(30))
    names = ["_key", "_runs", "n_words", "key", "row", "runs", "gram"]
    docs = spark.createDataFrame([(i, text, *("c" * len(names))) for i in (1, 2)], ", ".join(["doc_id long, text string", *(f"{n} string" for n in names)]))
    out = {r.doc_id: r for r in substring_dedup.dedup(docs).collect()}
    assert (out[1].n_removed, out[2].n_removed, out[1].n_words, out[2].text) == (0, 30, 30, "")
    assert out[1]._key == out[1].row == out[2].runs == "c"
    plain = substring_dedup.dedup(docs, counts=False, keep_layout=True)
    assert plain.columns == docs.columns and {r.n_words for r in plain.collect()} == {"c"}


def test_index_finds_every_pattern():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 3, rng.integers(1, 60)).astype(np.uint64) for _ in range(40)]
    for length in (2, 5, 20):
        seen, expected = set(), []
        for t in texts:
            flags = []
            for i in range(len(t) - length + 1):
                w = tuple(t[i : i + length].tolist())
                flags.append(w in seen)
                seen.add(w)
            expected.append(flags)
        assert [f.tolist() for f in fm_index.repeats(texts, length)] == expected
