"""Operators that look at documents one by one, against the libraries or brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from tonefold.llm import containment, language_id, licence_scan, packing, quality_rules, token_counts, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "  two  spaces ", "\n\n\tx\r\n", "😀 你好 ▁ x▁▁y é", "<s> </s> <|endoftext|>x <unk>", "a" * 500, "it's DON'T we'll 123", "x y z\x1cw\x85v", "ΑΣ ΣΑΣ İ", "\x00 zero"]


def frame(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", 0, "clash") for i, t in enumerate(texts)], SCHEMA)


def made_texts(n, seed):
    rng = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "Ü", "ß", "é", "ñ", "4", "."]
    return [rng.choice([" ", "\n", "  "]).join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_prefix_counts_are_the_librarys(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD + made_texts(20, 1)
    out = token_counts.prefix_token_counts(frame(spark, texts), path, budgets=(10,)).withColumns({"before": token_counts.tokens_before(F.col("prefix_counts"), 5), "within": token_counts.chars_within(F.col("prefix_counts"), 10)})
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        text = text or ""
        expected = [len(sp.encode(text[:j])) for j in range(len(text) + 1)]
        assert rows[i].prefix_counts == expected
        assert (rows[i].n_tokens, rows[i].n_bytes) == (expected[-1], len(text.encode()))
        assert rows[i].fit_10 == rows[i].within == max(j for j, c in enumerate(expected) if c <= 10)
        assert rows[i].before == expected[min(5, len(text))]
    assert token_counts.prefix_token_counts(frame(spark, []), path).count() == 0


def test_packing_is_a_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ODD + made_texts(300, 2) + ["word " * 5000]
    pieces = packing.pack(frame(spark, texts), path, window=256, group=100).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    at = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == at[p.doc_id] and p.doc_tokens == len(ids[p.doc_id])
        part = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()
        assert p.ids_crc32 == zlib.crc32(part)
        at[p.doc_id] += p.length
    assert dict(at) == {i: len(x) for i, x in ids.items()}
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    full = 0
    for s in sequences.values():
        place = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == place
            place += p.length
        assert place <= 256
        full += place
    assert full >= 0.97 * 256 * len(sequences)
    assert packing.pack(frame(spark, []), path).count() == 0


def test_fill_is_the_best_subset():
    rng = random.Random(4)
    for _ in range(200):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(lengths, minlength=65)
        first = max(lengths)
        rest = list(lengths)
        rest.remove(first)
        sums = {first}
        for x in rest:
            sums |= {s + x for s in sums if s + x <= 64}
        chosen = packing.fill(counts, first, 64)
        assert sum(chosen) == max(sums) and counts.sum() == len(lengths) - len(chosen)


def test_quality_measures(spark):
    rng = random.Random(5)
    texts = [None, "", " \n ", "a b a b a b", "x\nx\n\n \nx"] + [" ".join(rng.choices(["the", "of", "x", "y#", "Z1", "und\n", "é"], k=rng.randint(0, 90))) for _ in range(60)]
    rows = {r.doc_id: r for r in quality_rules.judge(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        grams = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
        often = Counter(grams)
        repeated = {j + d for j, g in enumerate(grams) if often[g] > 1 for d in range(3)}
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words)) and (not r.kept or not r.base_failed)
    assert quality_rules.judge(frame(spark, [])).count() == 0


def test_words_beside_a_letter_run_are_not_common(spark):
    # U+2028 isn't a break, so it belongs to its word, which then isn't of letters alone
    texts = ["the\u2028 " * 9 + "of, " * 9 + "x1 " * 9 + "sea Sea \U00010400o", "Sea,sea sea\tThe  SEA\n\U00010428O"]
    docs = frame(spark, texts).union(frame(spark, ["1 2"], None))
    common = quality_rules.common_words(docs.select("lang", "text"))
    assert [(r.ref_lang, r.common) for r in common.collect()] == [("en", ["sea", "the", "\U00010428o"])]
    hists = [{x["key"]: x["count"] for x in r.hist} for r in quality_rules.measures(docs.selectExpr("doc_id AS id", "lang", "text"), common).orderBy("id", "lang").collect()]
    assert [{k: n for k, n in h.items() if k.startswith("w:")} for h in hists] == [{"w:": 2}, {"w:": 27, "w:sea": 2, "w:\U00010428o": 1}, {"w:": 1, "w:sea": 2, "w:the": 1, "w:\U00010428o": 1}]


def test_repeats_among_equal_and_different_windows(spark):
    rng = random.Random(12)
    texts = ["a b c", "a b c a b c", "a a a a", "a b", "x " * 300] + [" ".join(rng.choices("abcdefghij", k=n)) for n in range(3, 90, 3)] + [" ".join(f"w{i}" for i in range(200))]
    for r in quality_rules.judge(frame(spark, texts)).collect():
        words = texts[r.doc_id].split()
        often = Counter(zip(words, words[1:], words[2:]))
        assert r.n_repeat_words == len({i + j for i, g in enumerate(zip(words, words[1:], words[2:])) if often[g] > 1 for j in range(3)})


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(6)
    prose = [" ".join(rng.choices(["the", "of", "and", "to", "river", "stone", "walk", "green", "is", "house", "went"], k=200)) for _ in range(40)]
    junk = [" ".join("".join(rng.choices("abcdef", k=5)) + "###" for _ in range(200)) for _ in range(2)]
    docs = frame(spark, prose + junk)
    assert sorted(r.doc_id for r in quality_rules.kept(docs).collect()) == list(range(40))


def test_containment(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 40))) for _ in range(30)] + ["", None, "!!", "alpha beta gamma", "w1 w2", "w7"]
    texts = [None, ""]
    for _ in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 200))
        if rng.random() < 0.6:
            item = (rng.choice(items) or "").split()
            cut = rng.randint(0, 4)
            words[rng.randint(0, len(words)) :][:0] = item
            at = rng.randint(0, len(words))
            words[at:at] = item[cut:]
        texts.append(rng.choice([" ", "\n", ", "]).join(words).upper())
    texts += ["alpha beta gamma", "before " * 50 + "Alpha, beta GAMMA" + " after" * 50, "alpha gamma beta"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def shingles(text, k=5):
        words = re.findall(r"[^\W_]+", (text or "").lower())
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}

    expected = []
    for i, item in enumerate(items):
        n = len(re.findall(r"[^\W_]+", item or ""))
        wanted = shingles(item, min(n, 5)) if n else set()
        for d, text in enumerate(texts):
            both = len(wanted & shingles(text, min(n, 5))) if wanted else 0
            if wanted and 100 * both >= 80 * len(wanted):
                expected.append((d, i, len(wanted), both))
    assert sorted(map(tuple, containment.contained(frame(spark, texts), bench).collect())) == sorted(expected)
    assert {(122, 33), (123, 33)} <= {e[:2] for e in expected} and (124, 33) not in {e[:2] for e in expected}
    assert containment.contained(frame(spark, []), bench).count() == 0
    assert containment.contained(frame(spark, texts), bench.where("false")).count() == 0


def test_licences(spark):
    s = licence_scan.SENTENCES
    mit = ". ".join(s[i] for i in ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")) + "."
    wrapped = "\n".join(re.findall(".{1,60}(?: |$)", s["bsd-redistribution"] + ": " + s["bsd-source"] + ". " + s["bsd-binary"] + "."))
    texts = [None, "", "Released under the MIT License.", "Some prose about software.\nLicensed under CC BY-NC 4.0.\nMore.", mit.upper(), wrapped, ". ".join([s["mit-notice"], s["mit-grant"]])]
    rows = [r.licences for r in licence_scan.scan(frame(spark, texts)).orderBy("doc_id").collect()]
    assert rows == [[], [], ["MIT"], ["CC-BY-NC-4.0"], ["MIT"], ["BSD-2-Clause"], []]
    assert all(re.search(licence_scan.ANCHORS, x) for x in s.values())


def test_language(spark):
    words = {"en": "the of and with that house river", "de": "der die und nicht haus fluss mit", "fr": "le la des maison avec que fleuve"}
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(words[lang].split(), k=30)), lang, "s", 0, "c") for i in range(300) for lang in [rng.choice(list(words))]]
    rows += [(1000, None, "en", "s", 0, "c"), (1001, "123 !?", "en", "s", 0, "c"), (None, "the of and", None, "s", 0, "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = language_id.identify(docs, language_id.fit(docs)).collect()
    truth = {r[0]: r[2] for r in rows}
    assert len(out) == len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.lang_pred == ("und" if r.doc_id in (1000, 1001) else truth[r.doc_id] or "en")
    empty = docs.where("false")
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_language_against_a_plain_version(spark):
    rng = random.Random(12)
    langs = {lang: ["".join(rng.choices("abcdefghijklmnop", k=4)) for _ in range(12)] for lang in "abc"}
    texts = [(lang, " ".join(rng.choices(langs[lang], k=25))) for lang in "abc" for _ in range(20)]
    sets = [set(t.encode()) | {t.encode()[i : i + 2] for i in range(len(t) - 1)} | {t.encode()[i : i + 3] for i in range(len(t) - 2)} for _, t in texts]
    marks = [0, 1, 20, 21, 40, 41]
    vocabulary = set.union(*[sets[i] for i in marks])
    plain = np.array([[len(s & sets[m]) / np.sqrt(len(s & vocabulary) * len(sets[m])) for m in marks] for s in sets])
    model = language_id.Landmarks([language_id.grams(texts[m][1]) for m in marks])
    k = model.kernel([t for _, t in texts])
    assert np.allclose(k, plain, atol=1e-5)
    fitted = language_id.KernelClassifier(model, model.marks.T @ model.marks, k, [lang for lang, _ in texts])
    # ridge by least squares on the features with rows of the penalty below
    values, vectors = np.linalg.eigh(plain[marks])
    phi = plain @ (vectors / np.sqrt(values))
    y = np.array([[float(lang == x) for x in "abc"] for lang, _ in texts])
    rows = np.vstack([phi / np.sqrt(20), np.sqrt(1e-2 / 6) * np.eye(6)])
    beta = np.linalg.lstsq(rows, np.vstack([y / np.sqrt(20), np.zeros((6, 3))]), rcond=None)[0]
    assert np.allclose(fitted.scores([t for _, t in texts]), phi @ beta, atol=1e-3)


def test_seventy_languages(spark):
    rng = random.Random(13)
    letters = [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0xE0, 0xF6)]
    words = {f"l{i}": ["".join(rng.choices(rng.sample(letters, 6), k=5)) for _ in range(15)] for i in range(70)}
    rows = [(100 * i + j, " ".join(rng.choices(words[f"l{i}"], k=20)), f"l{i}", "s", 0, "c") for i in range(70) for j in range(12)]
    rows += [(5, rows[0][1], "l0", "s", 0, "c"), (5, rows[0][1], "l0", "s", 0, "c"), (9000, "x1 " * 100_000, None, "s", 0, "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = language_id.identify(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert {r.lang_pred for r in out} == set(words) and sum(r.lang_pred == r.lang for r in out) >= 0.97 * len(out)


def test_toxicity(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        words = rng.choices("stone river walk green house you they light".split(), k=60)
        toxic = rng.random() < 0.3
        for _ in range(3 * toxic):
            words[rng.randrange(60)] = rng.choice(["blorf", "snarkle"])
        rows.append((i, " ".join(words), "en", "s", 0, "c"))
        labels.append((i, 1, int(toxic)))
    rows += [(700, None, "en", "s", 0, "c"), (701, "", "en", "s", 0, "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, marks).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())
    held = [(out[i].predicted, t) for i, _, t in labels if out[i].held_out]
    assert len(held) > 50 and sum(p == t for p, t in held) >= 0.97 * len(held)
    assert {r.score for r in toxicity.score(docs, marks.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), marks).count() == 0


def test_toxic_features_by_hand():
    text = "You SHOUT loud! you gr1n at blorfing? a blorf sooo; near 42."
    # words: you shout loud you gr n at blorfing a blorf sooo near
    found = dict(zip(toxicity.FEATURES, toxicity.features(text, {"blorf": 4.0, "blor-": 3.0})))
    n, chars = 12, len(text)
    expected = {
        "log_words": np.log1p(n), "lexicon_density": 2 / n, "lexicon_weight": 7 / n, "lexicon_top": 4.0, "lexicon_distinct": 2.0, "lexicon_hits": np.log1p(2), "beginning_density": 1 / n,
        "second_person_near": 1 / n, "second_person_density": 2 / n, "capitals": 5 / chars, "shouted_words": 1 / n, "exclaims": 1 / n, "questions": 1 / n, "punctuation": 2 / n,
        "obfuscated": 1 / n, "stretched": 1 / n, "digits": 3 / chars,
    }
    assert found == pytest.approx(expected) and list(found) == list(expected)
    assert toxicity.features("", {}) == [0.0] * 17


def test_toxicity_of_odd_labels(spark):
    rng = random.Random(14)
    rows = [(i, " ".join(rng.choices("stone river walk green".split(), k=30)) + " blorf" * (i % 4 == 0)) for i in range(400)]
    rows += [(None, "a text"), (7, "again"), (401, "word " * 60_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    once = [(i, int(i % 4 == 0)) for i in range(400)]
    odd = [(i, 0) for i in range(0, 400, 8)] + [(i, None) for i in range(400)] + [(None, 1), (None, 0)]
    scores = lambda labels: {(r.doc_id, r.held_out, round(r.score, 9)) for r in toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    first = scores(once)
    assert first == scores(once + odd) and len({d for d, _, _ in first}) == 402


def test_toxicity_of_long_texts(spark):
    lexicon = {"blorf": 4.0, "snark-": 3.0}
    text = "You walked past the BLORF house, snarkling! 7 rivers? Sooo gr3en today; "
    counted = [toxicity.FEATURES.index(name) for name in ("log_words", "lexicon_hits")]
    once, often = toxicity.features(text, lexicon), toxicity.features(text * 1000, lexicon)
    assert [x for i, x in enumerate(often) if i not in counted] == pytest.approx([x for i, x in enumerate(once) if i not in counted])
    assert once[toxicity.FEATURES.index("lexicon_density")] == pytest.approx(2 / 12)
    rng = random.Random(10)
    rows = []
    for i in range(600):
        words = rng.choices("stone river walk green house you they light".split(), k=60)
        toxic = i % 3 == 0
        for _ in range(6 if toxic else rng.random() < 0.3):
            words[rng.randrange(60)] = "blorf"
        rows.append((i, " ".join(words), int(toxic)))
    rows.append((1000, " ".join((rng.choices("stone river walk green house you they light".split(), k=300) + ["blorf", "stone"]) * 100), None))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert toxicity.score(frame.select("doc_id", "text"), frame.select("doc_id", "toxic")).where("doc_id = 1000").first().score < 0.3


MIT = """MIT License

Copyright (c) 2020 Some Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
GPL = """Copyright (C) 2020  Some Author

This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
APACHE = """Copyright 2020 Some Author

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def test_genuine_licence_notices(spark):
    hashed = "".join(f"# {line}".rstrip() + "\n" for line in APACHE.replace("Author\n\n", "Author\n").split("\n"))
    texts = [MIT, GPL, APACHE, hashed, APACHE.replace("\n", "\r\n"), "Licensed under CC BY 4.0.\n\n" + MIT, "Released under the\n\nMIT License."]
    rows = list(licence_scan.scan(frame(spark, texts)).orderBy("doc_id").collect())
    assert [r.licences for r in rows] == [["MIT"], ["GPL-3.0-or-later"], ["Apache-2.0"], ["Apache-2.0"], ["Apache-2.0"], ["MIT", "CC-BY-4.0"], []]
    assert rows[1].sentences == ["gpl-free", "gpl-hope", "gpl-copy"]
    assert all(r.sentences == ["apache-header", "apache-compliance", "apache-copy", "apache-as-is"] for r in rows[2:5])
    assert rows[5].sentences == ["cc-by-reference", "mit-grant", "mit-notice", "mit-as-is", "mit-liability"]
    more = [
        "Released under the MIT License.\n\n" + "\n".join(re.findall(".{1,60}(?: |$)", ". ".join(licence_scan.SENTENCES[i] for i in ("bsd-redistribution", "bsd-source", "bsd-binary")) + ".")),
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.\n",
        "This is free and unencumbered software released into the public domain.\n",
        "Distributed under the Boost Software License, Version 1.0.",
    ]
    assert [r.licences for r in licence_scan.scan(frame(spark, more)).orderBy("doc_id").collect()] == [["BSD-2-Clause", "MIT"], ["MPL-2.0"], ["Unlicense"], ["BSL-1.0"]]
    assert len({name for name, _ in licence_scan.RULES if name}) >= 30
    # the SQL reads the same
    import duckdb

    from tonefold.llm import sql

    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate([*texts, *more, None, ""])))
    ours = [(r.doc_id, ",".join(r.sentences), ",".join(r.licences)) for r in licence_scan.scan(frame(spark, [*texts, *more, None, ""])).collect()]
    assert sorted(ours) == sorted((a, c, d) for a, _, c, d in con.sql(sql.licences()).fetchall())
    again = frame(spark, texts[:1] * 2).union(frame(spark, texts[:1]))
    assert licence_scan.scan(again).count() == 3 and licence_scan.scan(frame(spark, [])).count() == 0
    lines = "\u4e00\n" * 20000 + "licence\n" + "- \n" * 20000 + "x; " * 20000
    assert [r.licences for r in licence_scan.scan(frame(spark, [lines])).collect()] == [[]]


def test_texts_without_their_languages_words_go(spark):
    rng = random.Random(11)
    names = [f"n{chr(97 + i)}{chr(97 + j)}" for i in range(26) for j in range(26)]  # so many that none of them is common
    made = lambda words, common, n: " ".join(rng.choice(words) if rng.random() < common else rng.choice(names) for _ in range(n))
    english, german = "the of and to is that for with".split(), "der die das und den von zu mit".split()
    rows = [(i, made(english, 0.21, 60 + i), "en") for i in range(200)] + [(i, made(german, 0.21, 60 + i), "de") for i in range(200, 400)]
    rows += [(i, made([], 0, 90), "xx") for i in range(400, 420)] + [(i, made(english, 0.02, 90), "yy") for i in range(420, 480)]
    bad = [(1000, made([], 0, 120), "en"), (1001, made(german, 0.21, 120), "en"), (1002, made(english, 0.21, 300), "de"), (1003, made(english, 0.02, 300), "en")]
    docs = spark.createDataFrame(rows + bad, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in quality_rules.kept(docs).collect()) == list(range(480))
    judged = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert [i for i, r in judged.items() if not r.kept] == sorted(r[0] for r in bad) or {i for i, r in judged.items() if not r.kept} == {r[0] for r in bad}


def test_quality_of_odd_rows(spark):
    words = [f"w{i}" for i in range(70_000)]
    long = " ".join(words + words[:3] + ["x"] * 2)
    names = "doc_id long, text string, lang string, _row_key string, row string, id long, w string, common string, kept string"
    rows = [(1, long), (1, long), (None, "a b c " * 40), (2, None), (3, "")]
    docs = spark.createDataFrame([(d, t, None, *("c", "c", 1, "c", "c", "c")) for d, t in rows], names)
    found = sorted((r.doc_id or 0, r.n_words, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(docs).collect())
    assert found == [(0, 120, 120, True), (1, 70_005, 6, False), (1, 70_005, 6, False), (2, 0, 0, True), (3, 0, 0, True)]
    left = quality_rules.kept(docs)
    assert left.columns == docs.columns and {r.kept for r in left.collect()} <= {"c"}


BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND {0} DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.
"""


def test_changed_licences_are_never_other_licences(spark):
    third = "3. Neither the name of {0} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    holders = ["the copyright holder", "Google Inc.", "the University of California, Berkeley", "Acme-Werke GmbH & Co. KG", "the ITS Foundation"]
    x11 = MIT.replace("this permission notice", "this permission notice (including the next\nparagraph)")
    mit0 = MIT.replace(", subject to the following conditions:", ".").replace(MIT[MIT.index("The above copyright") : MIT.index("THE SOFTWARE IS")], "")
    assert mit0 != MIT and "The above copyright" not in mit0
    expected = [(BSD + third.format(h), ["BSD-3-Clause"]) for h in holders]
    expected += [
        (BSD, ["BSD-2-Clause"]),
        (BSD + "3. The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission.", ["BSD-3-Clause"]),
        (BSD + "3. Neither the name of Acme nor anything else of its may be used at all.", []),
        (BSD + "3. The name of the author may not be used to endorse anything.", []),
        (BSD + "3. All advertising materials must say so.", []),
        (BSD + "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", ["BSD-2-Clause", "BSD-style"]),
        (x11, ["MIT"]),
        (mit0, ["MIT-0"]),
        (MIT.replace("The above copyright notice and this permission notice", "The above copyright notice and the name of the band"), []),
        (MIT.replace("subject to the following conditions", "subject to the approval of the band"), []),
        (ISC.format("THE AUTHOR"), ["ISC"]),
        (ISC.format("ISC"), ["ISC"]),
        (ISC.format("THE AUTHOR").replace("the above\ncopyright", "a fee is paid, the\ncopyright").replace("granted, provided", "granted,\nprovided"), []),
        (APACHE, ["Apache-2.0"]),
        ("Licensed under the Apache License, Version 2.0\nwith the Commons Clause.", []),
        (BSD + "\n\n".join(f"Words of some other thing, number {i}." for i in range(30)) + "\n\n" + third.format("Acme"), ["BSD-2-Clause"]),
    ]
    docs = frame(spark, [t for t, _ in expected])
    assert [r.licences for r in licence_scan.scan(docs).orderBy("doc_id").collect()] == [x for _, x in expected]
    import duckdb

    from tonefold.llm import sql

    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert [r[0] for r in con.sql(f"SELECT licences FROM ({sql.licences()}) ORDER BY doc_id").fetchall()] == [",".join(x) for _, x in expected]
