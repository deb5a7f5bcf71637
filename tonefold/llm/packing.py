"""Packing documents into fixed windows of tokens by minimum bin slack.

Each document's ids (its end id last) are cut into pieces of a whole window and one remainder. Whole
pieces are sequences as they are. Remainders are dealt evenly into groups; each group is a multiset of
lengths, and each of its windows takes the longest length left and, by a bitset subset-sum over the other
lengths, the multiset that leaves the least slack; the counts are found by backtracking.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import only, written

#: Words remembered by one Python worker; forgotten all at once beyond that. Bounds memory, not results.
MEMORY = 1_500_000
#: Remainders in a group, about. More remainders make more groups.
GROUP = 20_000
#: White space that str.split() and the tokenizer might not see alike; texts with it are cut at plain white space alone.
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")
_PLAIN = re.compile("[^ \t\r\n]+")


#: One run of lower-case letters that NFC leaves alone, and one mark: the tokenizer cuts exactly between the two.
_SIMPLE = re.compile("([a-zß-öø-ÿ]+)([.,;:!?]?)")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class WordIds:
    """Ids of whole texts from ids of their white-space-bounded words, which this tokenizer never joins."""

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        self.encode = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        self.merge = tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.ids: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def stem(self, stem: str) -> bytes:
        known = self.stems.get(stem)
        if known is None:
            spelled = stem if stem.isascii() else "".join([self.letters[b] for b in stem.encode()])
            known = self.stems[stem] = array("I", [t.id for t in self.merge(spelled)]).tobytes()
        return known

    def learn(self, words: list[str]) -> None:
        for memory in (self.ids, self.stems):
            if len(memory) > MEMORY:
                memory.clear()
        rest = []
        for word in words:
            if simple := _SIMPLE.fullmatch(word.lower()):
                stem, mark = simple.groups()
                self.ids[word] = self.stem(stem) + self.stem(mark) if mark else self.stem(stem)
            else:
                rest.append(word)
        for word, found in zip(rest, self.encode(rest, add_special_tokens=False) if rest else ()):
            self.ids[word] = array("I", found.ids).tobytes()

    def many(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        parts = [_PLAIN.findall(t) if _ODD_SPACE.search(t) else t.split() for t in texts]
        known = [list(map(self.ids.get, words)) for words in parts]
        if new := {w for words, ids in zip(parts, known) if None in ids for w, i in zip(words, ids) if i is None}:
            self.learn(list(new))
            fresh = {w: self.ids[w] for w in new}
            known = [[fresh[w] if i is None else i for w, i in zip(words, ids)] if None in ids else ids for words, ids in zip(parts, known)]
        for ids in known:
            yield b"".join(ids)


_tokenizers: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    if path not in _tokenizers:
        _tokenizers[path] = WordIds(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, tokenizer_file: str, *, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of each piece: whole windows, then what remains."""
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: list[list] = [[] for _ in names]
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for key, ids in zip(batch.column(0).to_pylist(), _word_ids(tokenizer_file).many(texts)):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        piece = ids[4 * start : 4 * (start + window)]
                        for column, value in zip(out, (key, start, len(piece) // 4, zlib.crc32(piece), total)):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

    return only(docs, id_col, text_col).mapInArrow(run, ", ".join(f"`{n}` long" for n in names))


def fill(counts: np.ndarray, first: int, window: int) -> list[int]:
    """Takes `first` and the lengths that fill the rest of a window closest to it out of counts; all of them."""
    counts[first] -= 1
    room = window - first
    mask, bits, layers = (1 << (room + 1)) - 1, 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        for _ in range(min(int(counts[length]), room // length)):
            more = (bits | bits << length) & mask
            if more == bits:
                break
            layers.append((length, bits))
            bits = more
            if bits >> room:
                break
        if bits >> room:
            break
    total, chosen = bits.bit_length() - 1, [first]
    for length, before in reversed(layers):
        if not before >> total & 1:
            total -= length
            counts[length] -= 1
            chosen.append(length)
    return chosen


def min_slack(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length."""
    counts = np.bincount(lengths, minlength=window + 1)
    order = np.argsort(lengths, kind="stable")
    after = np.cumsum(counts)  # rows of a length are handed out from the last
    left = counts.copy()
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    bins = 0
    for first in range(window, 0, -1):
        while left[first]:
            at = 0
            for length in fill(left, first, window):
                after[length] -= 1
                row = order[after[length]]
                number[row], offset[row] = bins, at
                at += length
            bins += 1
    return number, offset


def pack(docs: DataFrame, tokenizer_file: str, *, window: int = 2048, end_id: int = 1, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with sequence_id and offset. Each id of each document lies in one piece; sequences hold at most `window` ids.

    Null and empty texts hold the end id alone; repeated and null ids are packed row by row; very long texts are
    cut into whole windows and one remainder; an empty table gives an empty result. Sequence ids are unique, not dense.
    """
    pieces = written(token_pieces(docs, tokenizer_file, window=window, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    row = F.monotonically_increasing_id()
    rest = pieces.where(F.col("length") < window)
    groups = max(1, -(-rest.count() // group))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        number, offset = min_slack(rows["length"].to_numpy(), window)
        return rows.assign(sequence_id=(rows["_group"].to_numpy() << 32) + number, offset=offset).drop(columns="_group")

    schema = ", ".join(f"`{c}` long" for c in [*pieces.columns, "sequence_id", "offset"])
    # by a hash, as row numbers begin anew at a power of two in each partition
    packed = rest.withColumn("_group", F.pmod(F.xxhash64(row), F.lit(groups))).groupBy("_group").applyInPandas(place, schema)
    full = pieces.where(F.col("length") == window).withColumns({"sequence_id": F.lit(1 << 62) + row, "offset": F.lit(0).cast("long")})
    return packed.unionByName(full)
