import random
import re

import pytest

import corpus_pipeline
from tonefold.llm import quality_rules
from tonefold.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rng = random.Random(1)
    vocabulary = "the of and to in is that for it with".split() + [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    item, passage = prose(25), prose(40)
    texts = {i: prose(150) for i in range(40)}
    texts[40] = ["###$$$" for _ in range(100)]
    texts[41] = list(texts[3])
    texts[42] = texts[5][:70] + ["changed"] + texts[5][71:]
    texts[43] = prose(80) + item + prose(80)
    texts[44] = passage + prose(100)
    texts[45] = prose(100) + passage
    texts[46] = prose(10)
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in texts.items()] + [(50, None, "en", "s", None), (51, "", None, None, 0), (None, " ".join(prose(120)), "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        left[name] = {r.doc_id: r.text for r in docs.collect()}
    good = {*range(40), 41, 42, 43, 44, 45, None}
    assert set(left["quality_rules"]) == good
    assert set(left["ngram_jaccard_join"]) == good - {41, 42}
    assert set(left["substring_dedup"]) == good - {41, 42}
    assert left["substring_dedup"][44] == " ".join(texts[44]) and left["substring_dedup"][45] == " ".join(texts[45][:100])
    assert set(left["benchmark_decontamination"]) == good - {41, 42, 43}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == good - {41, 42, 43}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages_against_brute_force(spark, tmp_path):
    """Near duplicates, passages and decontamination on rows with repeated and null ids, nulls and columns with clashing names."""
    pytest.importorskip("public_tokenizers")
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(500)]
    prose = lambda n: rng.choices(vocabulary, k=n)
    passage, items = prose(30), [prose(12), prose(3)]
    bases = [prose(rng.randint(5, 120)) for _ in range(25)]
    rows = []
    for i in range(120):
        words = list(rng.choice(bases)) if rng.random() < 0.5 else prose(rng.randint(0, 100))
        for _ in range(rng.randint(0, 2)):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            words += passage
        if rng.random() < 0.1:
            words[5:5] = rng.choice(items)
        rows.append((rng.choice([i, i, 7, None]), " ".join(words) if rng.random() < 0.95 else None, "en", "s", 0, i, "x"))
    schema = SCHEMA + ", key long, row string"
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, schema)
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")

    stages = dict(corpus_pipeline.STAGES)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [words_of((t or "").lower())] for i in range(max(len(w) - 4, min(len(w), 1)))}
    ranked = sorted(rows, key=order)
    sets = [shingles(r[1]) for r in ranked]
    root = list(range(len(ranked)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ranked)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    left = stages["ngram_jaccard_join"](spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    expected = sorted((r[1] or "", r[0] or -1) for i, r in enumerate(ranked) if find(i) == i)
    assert sorted((r.text or "", r.doc_id or -1) for r in left.collect()) == expected

    seen, expected = set(), []
    for r in ranked:
        words = words_of(r[1])
        gone = set()
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        expected.append(" ".join(w for i, w in enumerate(words) if i not in gone) if gone else r[1] or "")
    cut = stages["substring_dedup"](spark, docs, str(tmp_path))
    assert cut.columns == docs.columns
    found = cut.collect()
    assert sorted(r.text for r in found) == sorted(expected) and all(r.n_chars == len(r.text) for r in found)

    def holds(text):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        for item in items:
            k = min(5, len(item))
            runs = lambda w: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
            if 100 * len(runs(item) & runs(words)) >= 80 * len(runs(item)):
                return True
        return False

    clean = stages["benchmark_decontamination"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert sorted(r.text or "" for r in clean.collect()) == sorted(r[1] or "" for r in rows if not holds(r[1]))

    left = stages["quality_rules"](spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    kept = {r.text for r in quality_rules.judge(docs).where("kept").join(docs.select("doc_id", "text"), "doc_id").collect()}
    assert {r.text for r in left.collect() if r.doc_id is not None and r.doc_id != 7} <= kept
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
