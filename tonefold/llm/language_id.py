"""Language identification with string kernels: blended-spectrum n-gram presence, Nyström landmarks, one-versus-rest kernel ridge.

Two texts are as similar as the byte n-grams (of 1 to 3 bytes, letters A-Z in lower case) that both hold, over the root of the
product of their numbers. A bounded sample of labelled texts gives landmarks and training texts; each text is
then described by its kernel with the landmarks, and one ridge regression per language gives its score. All of
a batch's scores are two matrix products: presence times landmarks, kernel times coefficients.

Every language that is labelled is learned. Fitting brings no text to the driver: of a landmark its n-grams, of a training text its kernel with the
landmarks, both computed where the texts lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import _LOWER, only, written

#: Bounds of the sample that is fitted: texts of a language, landmarks of a language, and of both in all; with many languages there are fewer of each, but LEAST.
TEXTS, LANDMARKS, ALL_TEXTS, ALL_LANDMARKS, LEAST = 160, 16, 20_000, 1024, 2
#: Languages whose counts may be broadcast (a name and a number each).
SMALL = 100_000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def held_out(id_col: str = "doc_id", remainder: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == remainder, F.lit(False))


def grams(text: str) -> np.ndarray:
    """Distinct n-grams of 1 to 3 bytes as numbers: an n-gram's bytes after a leading 1 bit's worth of offset."""
    b = _LOWER[np.frombuffer(text.encode(errors="replace"), np.uint8)].astype(np.int32)
    two = (b[:-1] << 8) + b[1:]
    return np.unique(np.concatenate([b, two + 256, (two[:-1] << 8) + b[2:] + 256 + 65536]))


class Landmarks:
    """Presence kernel of texts with the landmarks, which are given as arrays of n-grams."""

    def __init__(self, sets: list[np.ndarray]):
        self.vocab = np.unique(np.concatenate(sets))
        rows = np.zeros((len(sets), len(self.vocab)), np.float32)
        for row, s in zip(rows, sets):
            row[np.searchsorted(self.vocab, s)] = 1
        self.marks = (rows / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1))).T.copy()
        self._place: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_place": None}  # each worker makes its own from the vocabulary

    @property
    def place(self) -> np.ndarray:
        """The column of each n-gram there can be; one more for those of no landmark."""
        if self._place is None:
            self._place = np.full(256 + 65536 + (1 << 24), len(self.vocab), np.int32)
            self._place[self.vocab] = np.arange(len(self.vocab))
        return self._place

    def kernel(self, texts: list[str]) -> np.ndarray:
        presence = np.zeros((len(texts), len(self.vocab) + 1), np.uint8)
        numbers = np.zeros((len(texts), 1), np.float32)
        place = self.place
        for row, number, text in zip(presence, numbers, texts):
            b = _LOWER[np.frombuffer(text.encode(errors="replace"), np.uint8)].astype(np.int32)
            two = (b[:-1] << 8) + b[1:]
            row[place[b]] = 1
            row[place[two + 256]] = 1
            row[place[(two[:-1] << 8) + (b[2:] + 65792)]] = 1
        presence = presence[:, :-1].astype(np.float32)
        numbers[:] = presence.sum(1, keepdims=True)  # of the n-grams that landmarks have
        return presence @ self.marks / np.sqrt(np.maximum(numbers, 1))


class KernelClassifier:
    """One-versus-rest ridge over the Nyström features of kernels: k K_mm^(-1/2), each language with the same weight."""

    def __init__(self, landmarks: Landmarks, among: np.ndarray, kernels: np.ndarray, langs: list[str], ridge: float = 1e-2):
        """among: the landmarks' kernel with each other; kernels and langs: of the training texts."""
        self.landmarks, self.langs = landmarks, sorted(set(langs))
        values, vectors = np.linalg.eigh(among.astype(np.float64))
        keep = values > 1e-6 * values.max()
        root = vectors[:, keep] / np.sqrt(values[keep])
        phi = kernels @ root
        place = {lang: i for i, lang in enumerate(self.langs)}
        y = np.zeros((len(langs), len(self.langs)))
        y[np.arange(len(langs)), [place[lang] for lang in langs]] = 1
        weighted = phi / y.sum(0)[y.argmax(1)][:, None]
        beta = np.linalg.solve(weighted.T @ phi + ridge * np.eye(phi.shape[1]) / phi.shape[1], weighted.T @ y)
        self.coefficients = (root @ beta).astype(np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.landmarks.kernel(texts) @ self.coefficients


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = TEXTS, landmarks: int = LANDMARKS) -> KernelClassifier | None:
    """Fitted on `texts` texts at most, in the order of a hash of their id, of each language; None if no row with a letter is labelled.

    With more than ALL_TEXTS / texts languages each has fewer texts, with more than ALL_LANDMARKS / landmarks fewer landmarks, but LEAST of both where it has
    them. Rows with equal ids count as far as there is room for them, whatever their order.
    """
    rows = only(docs, id_col, text_col, lang_col).toDF("id", "text", "lang").where(~held_out("id") & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return None
    texts = max(LEAST, min(texts, ALL_TEXTS // languages))
    landmarks = max(LEAST, min(landmarks, ALL_LANDMARKS // languages))
    order = F.pmod(F.xxhash64(F.col("id"), F.lit("fit")), F.lit(1 << 30))
    # far fewer rows than all are ranked: those with low hashes, so that each language very likely has enough, and all of a rare one
    low = F.lit(2.0 * texts + 40) / F.col("n")
    some = rows.withColumn("order", order).join(F.broadcast(counts) if languages <= SMALL else counts, "lang").where(F.col("order") < low * (1 << 30))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "id", "text"))
    sample = written(some.withColumn("place", place).where(F.col("place") <= texts).select("lang", "text", "place"), "language-sample")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([grams(t) for t in batch.column(0).to_pylist()], pa.list_(pa.int32()))], names=["grams"])

    marks = sample.where(F.col("place") <= landmarks).select("text").mapInArrow(sets, "grams array<int>").collect()  # ALL_LANDMARKS rows at most, or LEAST for each language
    model = Landmarks([np.array(r.grams, np.int32) for r in marks])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                k = shared.value.kernel(batch.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(k), pa.list_(pa.float32()))], names=["lang", "place", "k"])

    trained = sample.select("lang", "place", "text").mapInArrow(kernels, "lang string, place int, k array<float>").orderBy("lang", "place").collect()
    k = np.array([r.k for r in trained], np.float32)
    among = model.marks.T @ model.marks
    return KernelClassifier(model, among, k, [r.lang for r in trained])


def identify(docs: DataFrame, model: KernelClassifier | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score (0 to 1). Null texts and texts without a letter: `und`, 0; so are all where nothing was labelled. A row gives a
    row, whether its id repeats or is null; of very long texts all n-grams count.

    One pass over whole texts; the model's size is bounded by its sample and goes along once per executor.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                known = [i for i, t in enumerate(texts) if model is not None and _LETTER.search(t)]
                if known:
                    s = model.scores([texts[i] for i in known])
                    for i, j, v in zip(known, s.argmax(1), s.max(1)):
                        pred[i], score[i] = model.langs[j], float(min(max(v, 0.0), 1.0))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[id_col, "lang_pred", "score"])

    out = only(docs, id_col, text_col).mapInArrow(run, f"`{id_col}` long, lang_pred string, score double")
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
