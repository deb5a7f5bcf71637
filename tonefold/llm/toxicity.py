"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

From two thirds of a bounded sample of labelled rows: a lexicon (words and word beginnings far likelier in toxic texts) and trees over
features that use it. From the other third: the calibration. All documents are scored in one pass over whole texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from .common import only, written
from .language_id import held_out

#: Bounds of what is fitted: labelled rows, entries of the lexicon.
SAMPLE, LEXICON = 12_000, 400
THRESHOLD = 0.3
#: Letters of a word's beginnings that the lexicon may hold, longest first.
BEGINNINGS = (7, 6, 5, 4)
NEAR = 5
#: Second-person words of the languages served.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos ti tuyo usted ustedes vosotros vuestro".split())
_WORD = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[^\W\d_][0-9@$*#%&]+[^\W\d_]")
_STRETCH = re.compile(r"([^\W\d_])\1\1")
_CAPS = re.compile(r"\b[A-Z]{3,}\b")
FEATURES = ("log_words", "lexicon_density", "lexicon_weight", "lexicon_top", "lexicon_distinct", "lexicon_hits", "beginning_density", "second_person_near", "second_person_density", "capitals", "shouted_words", "exclaims", "questions", "punctuation", "obfuscated", "stretched", "digits")


def units(text_col: str) -> F.Column:
    """Distinct lexicon units of a text: its words, and the beginnings of longer ones."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"(\p{L}+)"), F.lit(1)))
    cut = lambda n: F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("-"))))
    return F.concat(words, *[cut(n) for n in BEGINNINGS])


def learn_lexicon(sample: DataFrame, *, text_col: str = "text", size: int = LEXICON) -> dict[str, float]:
    """unit -> log-odds weight, of the units of the sample that mark toxic texts most."""
    total = sample.agg(F.sum("label").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = total.t or 0, total.n - (total.t or 0)
    found = sample.select("label", F.explode(units(text_col)).alias("unit")).groupBy("unit").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
    weight = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("n") - F.col("t") + 0.5) / (clean + 1))
    often = max(4, toxic // 150)  # what few toxic texts hold marks them by chance
    top = found.where(F.col("t") >= often).withColumn("weight", weight).where("weight > 3").orderBy(F.desc(F.col("weight") * F.log1p("t")), "unit").limit(size)
    return {r.unit: r.weight for r in top.select("unit", "weight").collect()}


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    words = _WORD.findall(text.lower())
    n, chars = max(len(words), 1), max(len(text), 1)
    weights, places, second, beginnings, seen = [], [], [], 0, set()
    for i, w in enumerate(words):
        weight = lexicon.get(w)
        if weight is None and len(w) > 4:
            for length in BEGINNINGS:
                weight = lexicon.get(w[:length] + "-") if len(w) > length else None
                if weight is not None:
                    beginnings += 1
                    seen.add(w[:length])
                    break
        elif weight is not None:
            seen.add(w)
        if weight is not None:
            weights.append(weight)
            places.append(i)
        if w in SECOND_PERSON:
            second.append(i)
    near = 0
    if places and second:
        s = np.array(second)
        at = np.array(places)
        right = np.searchsorted(s, at)
        gap = np.minimum(np.abs(s[np.minimum(right, len(s) - 1)] - at), np.abs(s[np.maximum(right - 1, 0)] - at))
        near = int((gap <= NEAR).sum())
    caps = sum(map(len, _CAPS.findall(text)))
    marks = sum(map(text.count, ".,;:-'\""))
    return [
        math.log1p(len(words)), len(weights) / n, sum(weights) / n, max(weights, default=0.0), float(len(seen)), math.log1p(len(weights)), beginnings / n, near / n, len(second) / n,
        caps / chars, len(_CAPS.findall(text)) / n, text.count("!") / n, text.count("?") / n, marks / n,
        len(_ODD.findall(text)) / n, len(_STRETCH.findall(text)) / n, sum(map(text.count, "0123456789")) / chars,
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float], *, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The long columns `keep` and x, the array of features; one pass over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x = pa.array([features(t or "", shared.value) for t in batch.column(len(keep)).to_pylist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).cast(pa.int64()) for i in range(len(keep))), x], names=[*keep, "x"])

    ddl = ", ".join(f"`{c}` long" for c in keep) + ", x array<double>"
    return only(docs, *keep, text_col).mapInArrow(run, ddl)


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """id, held_out, score (0 to 1), predicted. Held-out rows are never learned from.

    Of repeated labels of an id the largest counts; null labels and ids are not learned from. Null texts are
    empty texts and get a score as any other; a row gives a row. Without rows of both classes in either part every score is the labelled share.
    """
    known = only(labels, id_col, label_col).where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.max(F.col(label_col).cast("double")).alias("label"))
    known = known.orderBy(F.xxhash64(F.col(id_col), F.lit("fit")), id_col).limit(sample)  # `sample` rows of two numbers at most: safe to broadcast
    rows = only(docs, id_col, text_col).dropna(subset=[text_col]).join(F.broadcast(known), id_col)
    rows = written(rows.select(id_col, text_col, F.col("label").cast("long").alias("label")), "labelled")
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit("part")), F.lit(3))
    classes = {(r.label, r.used): r["count"] for r in rows.groupBy("label", (part > 0).alias("used")).count().collect()}
    if len(classes) < 4:
        toxic = sum(n for (label, _), n in classes.items() if label)
        share = toxic / max(1, sum(classes.values()))
        return only(docs, id_col).select(id_col, held_out(id_col).alias("held_out"), F.lit(share).alias("score"), F.lit(int(share >= threshold)).alias("predicted"))

    lexicon = learn_lexicon(rows.where(part > 0), text_col=text_col)
    train = written(with_features(rows, lexicon, keep=(id_col, "label"), text_col=text_col), "toxic-features")
    train = train.select(id_col, F.col("label").cast("double").alias("label"), array_to_vector("x").alias("features"))
    trees = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, maxBins=64, seed=7).fit(train.where(part > 0))
    raw = vector_to_array(F.col("probability"))[1]
    steps = IsotonicRegression().fit(trees.transform(train.where(part == 0)).select("label", raw.alias("features")))

    every = with_features(docs, lexicon, keep=(id_col,), text_col=text_col)
    scored = trees.transform(every.select(id_col, array_to_vector("x").alias("features"))).select(id_col, raw.alias("features"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
    scored = steps.transform(scored).select(id_col, held_out(id_col).alias("held_out"), value.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
