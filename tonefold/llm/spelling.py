"""Spelling variants: words one edit apart, found by common prefix and suffix lengths over dense tiles of padded code-point matrices.

Two words are one inserted, deleted or replaced code point apart if their common prefix and their common suffix together reach the longer one's length less one,
k. Then the prefix covers the first half of k, or the suffix the other half and one more; so near words of any vocabulary share a half, and only words that share one are
compared. The words of a half are cut into blocks, and each two blocks, and each block with itself, are a tile: all of the tile's longer words are held
against its other words at once, as rows of matrices. A half that very many words share costs more tiles, not larger ones.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import dropped, only, texts_of, written

#: Letters of a run, besides A-Z, which become lower case. All are single bytes of Latin-1, so a matrix of bytes is one of code points.
LETTERS = "a-zÀ-ÿ"
#: One in so many of a document's different runs loses a code point.
DROP = 31
#: Words of a block; different words that a task counts before it passes them on; letters searched at once; cells of a matrix that are compared at once.
BLOCK, HELD, PIECE, CELLS = 512, 1 << 17, 1 << 20, 1 << 22


def _pieces(text: str) -> Iterator[str]:
    """Pieces of about PIECE code points that cut no run."""
    outside, at = re.compile(f"[^{LETTERS}]"), 0
    while len(text) - at > PIECE:
        found = outside.search(text, at + PIECE)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def counts(docs: DataFrame, *, least: int, drop: int = DROP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the runs of letters of all texts, A-Z in lower case, of at least `least` code points, and how often each occurs. A run whose crc32 with the document's id
    `drop` divides loses the code point that the crc32 points to first."""
    runs = re.compile(f"[{LETTERS}]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, bounds in texts_of(batch.column(1)):
                raw = data.tobytes().lower()  # of bytes, so A-Z alone
                for i in range(hi - lo):
                    start = zlib.crc32(f"{'' if ids[lo + i] is None else ids[lo + i]}:".encode())
                    for piece in _pieces(raw[bounds[i] : bounds[i + 1]].decode("utf-8", "replace")):
                        for word, n in Counter(runs.findall(piece)).items():
                            h = zlib.crc32(word.encode(), start)
                            if h % drop == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1 :]
                                if len(word) < least:
                                    continue
                            held[word] += n
                        if len(held) >= HELD:
                            yield given()
        if held:
            yield given()

    return only(docs, id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def tiles(words: DataFrame, block: int) -> DataFrame:
    """tile, k, side, length, word, n, mine (the word's block), crossed (the tile is of two blocks) of words (word, n): a word stands under each half
    that a near one may share with it, once for each tile of its block."""
    length = F.char_length("word")
    halves = []
    for k in (length - 1, length):
        half = F.ceil(k / 2).cast("int")
        halves += [F.struct(k.alias("k"), F.lit(True).alias("side"), F.expr("word").substr(F.lit(1), half).alias("half")), F.struct(k.alias("k"), F.lit(False).alias("side"), F.expr("word").substr(length - (k - half), k - half + 1).alias("half"))]
    rows = words.select("word", "n", length.alias("length"), F.explode(F.array(*halves)).alias("h")).select("word", "n", "length", "h.*")
    sizes = rows.groupBy("k", "side", "half").agg(F.count("*").alias("size")).where("size > 1")
    rows = rows.join(sizes, ["k", "side", "half"]).withColumn("blocks", F.ceil(F.col("size") / block))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    i, j = F.least("mine", "other"), F.greatest("mine", "other")
    return rows.select(F.xxhash64("k", "side", "half", i, j).alias("tile"), "k", "side", "length", "word", "n", "mine", (i != j).alias("crossed"))


def compared(words: list[bytes], k: int, side: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs of rows (i, j) that are near; words have k or k + 1 letters, those of i k + 1. A pair that shares the first half counts on that side alone."""
    left, right = np.zeros((len(words), k + 2), np.uint8), np.zeros((len(words), k + 2), np.uint8)
    for row, word in enumerate(words):
        letters = np.frombuffer(word, np.uint8)
        left[row, : len(letters)] = letters
        right[row, : len(letters)] = letters[::-1]
    most = max(1, CELLS // (k + 2))
    a, b = [], []
    for at in range(0, len(i), most):
        x, y = i[at : at + most], j[at : at + most]
        prefix = (left[x] != left[y]).argmax(1)
        suffix = (right[x] != right[y]).argmax(1)
        near = (prefix + suffix >= k) & ((prefix >= (k + 1) // 2) == side[x])
        a.append(x[near])
        b.append(y[near])
    return np.concatenate(a), np.concatenate(b)


def near_words(words: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """word, near, near_n: each two different words (word, n) one edit apart, both ways."""
    dealt = tiles(words, block).repartition("tile").sortWithinPartitions("tile", "k", "side", "length")

    def found(rows: pa.Table) -> pa.RecordBatch:
        word, n = rows["word"].to_pylist(), rows["n"].to_numpy()
        k, side, length, mine, crossed = (rows[c].to_numpy() for c in ("k", "side", "length", "mine", "crossed"))
        first = _starts(rows)
        start = np.repeat(first, np.diff(np.append(first, len(k))))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for value in np.unique(k):
            of = np.flatnonzero(k == value)
            longer = of[length[of] == value + 1]
            partners = longer - start[longer]  # all rows of the tile before it: shorter ones come first
            at = 0
            while at < len(longer):
                upto = max(at + 1, int(np.searchsorted(np.cumsum(partners[at:]), CELLS, "right")) + at)
                i = np.repeat(longer[at:upto], partners[at:upto])
                j = np.arange(len(i)) - np.repeat(np.cumsum(partners[at:upto]) - partners[at:upto], partners[at:upto]) + np.repeat(start[longer[at:upto]], partners[at:upto])
                other = ~crossed[i] | (mine[i] != mine[j])
                i, j = i[other], j[other]
                if len(i):
                    rank, place = np.unique(np.concatenate([i, j]), return_inverse=True)
                    a, b = compared([word[r].encode("latin-1") for r in rank], int(value), side[rank], place[: len(i)], place[len(i) :])
                    out.append((rank[a], rank[b]))
                at = upto
        a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
        b = np.concatenate([y for _, y in out]) if out else np.zeros(0, np.int64)
        x, y = np.concatenate([a, b]), np.concatenate([b, a])
        return pa.RecordBatch.from_arrays([pa.array([word[r] for r in x], pa.string()), pa.array([word[r] for r in y], pa.string()), pa.array(n[y])], names=["word", "near", "near_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 1 << 16:
                rows = pa.Table.from_batches(held)
                whole = int(_starts(rows)[-1])  # the last tile may go on
                if whole:
                    yield found(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
                size -= whole
        if size:
            yield found(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "word string, near string, near_n long")


def _starts(rows: pa.Table) -> np.ndarray:
    """Places at which a new tile begins."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in ("tile", "k", "side"):
        v = rows[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def variants(docs: DataFrame, *, least: int = 7, occurrences: int = 2, times: int = 10, drop: int = DROP, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of all texts that has `least` code points and occurs `occurrences` times: see `counts`.

    n_near: its near words. form: the near word that occurs most (of equal ones the smallest by code points) if that is at least `times` as often as the word, with form_n; else
    both are null. root: where forms lead to in the end, the word itself without a form. Null and empty texts have no words; a null id counts as an empty text in the crc32; rows
    whose ids or texts repeat count each. A document's order and cutting don't matter. Tables without words give an empty result. Other columns are left aside.
    """
    if times < 2 or least < 3:
        raise ValueError("times must be 2 at least, least 3")
    words = written(counts(docs, least=least, drop=drop, id_col=id_col, text_col=text_col).where(F.col("n") >= occurrences), "words")
    near = near_words(words, block=block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    strong = -F.col("best.minus") >= F.lit(times) * F.col("n")
    named = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.near")).alias("form"), F.when(strong, -F.col("best.minus")).alias("form_n"))
    named = written(named, "forms")
    roots = written(named.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots")
    while not roots.where("open").isEmpty():  # steps double, and n grows `times` a step, so rounds are few
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        last, roots = roots, written(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("open")), "roots")
        dropped(last)
    out = named.join(roots.select("word", "root"), "word", "left")
    return out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
