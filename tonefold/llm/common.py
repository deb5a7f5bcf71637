"""Helpers shared by the corpus operators: tables, written intermediates, vectorised word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words are maximal runs of anything but these bytes (space, tab, \n, \v, \f, \r).
WORD_BREAKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Where it is unset, a new local one in local mode alone; executors elsewhere wouldn't see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-tonefold-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes what `written` wrote for frames that nothing will read again: what was derived from them is written itself."""
    for df in frames:
        spark = df.sparkSession
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash with an operator's own."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, text, row: key is unique and in the order of ids, the id itself, or where ids repeat or are null a number in the order of id (nulls last)
    and text. row holds all columns of docs, so none of their names can clash with an operator's own."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("key"), F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    ids = rows.select("key")
    if ids.where("key is null").isEmpty() and ids.groupBy("key").count().where("count > 1").isEmpty():
        return rows
    ordered = rows.orderBy(F.col("key").asc_nulls_last(), "text")
    return written(ordered.withColumn("key", F.monotonically_increasing_id()), "keyed")


# --- vectorised word hashing ---------------------------------------------------------------

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(WORD_BREAKS)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}
#: Bytes whose words are hashed at once: what is held besides a text is of this size, or that of its longest word.
HASH_BLOCK = 1 << 17


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0.. and P^-0.. modulo 2^64, n of each at least."""
    if len(_powers.get("p", ())) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for key, base in (("p", _P), ("i", _P_INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[key] = np.cumprod(out, dtype=np.uint64)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; a bijection, so it never makes two hashes equal."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: begin and end byte and, if `hashed`, hash of each; first[i]:first[i+1] are those of text i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False, hashed: bool = True):
        data = _LOWER[data] if lower else data
        self.data, n = data, len(data)
        inside = _IS_WORD[data]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            cuts = bounds[1:-1]
            before[cuts[cuts < n]] = False
            after[cuts[cuts > 0] - 1] = False
        self.begin = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.hash = np.empty(len(self.begin) if hashed else 0, np.uint64)
        lo = 0 if hashed else len(self.begin)
        while lo < len(self.begin):
            at = self.begin[lo]
            hi = max(lo + 1, int(np.searchsorted(self.end, at + HASH_BLOCK, "right")))
            self.hash[lo:hi] = self._hashes(data[at : self.end[hi - 1]], self.begin[lo:hi] - at, self.end[lo:hi] - at)
            lo = hi
        self.first = np.searchsorted(self.begin, bounds)

    @staticmethod
    def _hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        n = len(data)
        p, inv = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * p[:n], out=total[1:])
        return mix((total[end] - total[begin]) * inv[begin])


def texts_of(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a string column of about `most` bytes: first row, row after, bytes, bounds of the texts in them.
    Nulls are empty texts. A piece holds one text at least, however long."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + most, "right")) - 1))
        yield lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k consecutive words, in order; runs that cross texts are the caller's to leave out."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    p, inv = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * p[:n], out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * inv[: n - k + 1])
