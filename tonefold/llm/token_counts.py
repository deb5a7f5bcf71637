"""Token counts at every prefix of a text, by dynamic programming over the vocabulary.

In byte-pair encoding the tokens of a text's prefix that ends where a token of the prefix's own
encoding ends are again an encoding. So the encoding of a prefix is the encoding of a shorter prefix
and one last token, and the last token is the one vocabulary entry that ends there and may follow the
shorter prefix's last token: count[i] = count[i - len(last)] + 1. Two tokens may stand side by side if
encoding the two strings together gives these two tokens.

Merges never cross a place where a space follows another character, nor a character outside the
vocabulary, so a text falls into units (spaces with what follows them). The recurrence runs once for each
different unit that a worker sees; the counts of a whole text are sums of the units' steps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import only

SPACE = "▁"
#: Units remembered by one Python worker; forgotten all at once beyond that. Bounds memory, not results.
MEMORY = 800_000


class PrefixCounter:
    """Steps of the token count along a text: steps[i] = count(text[:i + 1]) - count(text[:i])."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.vocab = {p for i, p in enumerate(pieces) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i))}
        self.longest = max(map(len, self.vocab))
        self.chars = {p for p in self.vocab if len(p) == 1}
        self.beside: dict[tuple[str, str], bool] = {}
        self.steps: dict[str, bytes] = {}
        self.units = re.compile(f"{SPACE}*[^{SPACE}\n\t]+|{SPACE}+|[\n\t]")

    def may_follow(self, left: str, right: str) -> bool:
        known = self.beside.get((left, right))
        if known is None:
            # after a line feed no space is put in front, and nothing merges across it
            known = self.sp.encode("\n" + left + right, out_type=str)[2:] == [left, right]
            if len(self.beside) > MEMORY:
                self.beside.clear()
            self.beside[left, right] = known
        return known

    def learn(self, units: list[str]) -> None:
        """Runs the recurrence over units in order of the alphabet, so that each goes on from what it shares
        with the one before."""
        vocab, chars, longest, beside, may_follow = self.vocab, self.chars, self.longest, self.beside, self.may_follow
        if len(self.steps) > MEMORY:
            self.steps.clear()
        counts, lasts, before = [0], [""], ""
        for unit in sorted(units):
            shared, most = 0, min(len(unit), len(before))
            while shared < most and unit[shared] == before[shared]:
                shared += 1
            del counts[shared + 1 :], lasts[shared + 1 :]
            for i in range(shared + 1, len(unit) + 1):
                char = unit[i - 1]
                if char not in chars:
                    counts.append(counts[-1] + len(char.encode(errors="replace")))
                    lasts.append("")
                    continue
                for j in range(max(0, i - longest), i):
                    token = unit[j:i]
                    if token in vocab:
                        left = lasts[j]
                        if left:
                            ok = beside.get((left, token))
                            if not (may_follow(left, token) if ok is None else ok):
                                continue
                        counts.append(counts[j] + 1)
                        lasts.append(token)
                        break
                else:
                    raise ValueError(f"no encoding of {unit[:i]!r}")
            self.steps[unit] = bytes([(y - x) & 255 for x, y in zip(counts, counts[1:])])
            before = unit

    def split(self, text: str) -> list[str]:
        return self.units.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Token counts of text[:0], text[:1], ..., text, for each: one more than the text has characters."""
        parts = [self.split(text) for text in texts]
        if new := set(chain.from_iterable(parts)).difference(self.steps):
            self.learn(list(new) if len(self.steps) <= MEMORY else list(set(chain.from_iterable(parts))))
        for units in parts:
            if not units:
                yield np.zeros(1, np.int32)
                continue
            counts = np.cumsum(np.frombuffer(b"".join(map(self.steps.__getitem__, units)), np.int8), dtype=np.int32)
            counts[0] = 0  # the space that the tokenizer puts in front counts from the first character on
            yield counts


_counters: dict[str, PrefixCounter] = {}


def counter(model_file: str) -> PrefixCounter:
    if model_file not in _counters:
        _counters[model_file] = PrefixCounter(model_file)
    return _counters[model_file]


def prefix_token_counts(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", budgets: tuple[int, ...] = (), keep_prefixes: bool = True) -> DataFrame:
    """Per document: id, n_bytes (UTF-8), n_tokens, prefix_counts (count at each prefix, in characters; left
    out unless keep_prefixes) and, for each budget b, fit_b: characters of the longest prefix of at most b tokens
    beyond which no prefix fits.

    Null and empty texts have 0 bytes, 0 tokens, prefix_counts [0]. Ids may repeat or be null; a row gives a
    row. No shuffle: one pass over the texts, each kept whole.
    """
    fields = [pa.field(id_col, pa.int64()), pa.field("n_bytes", pa.int64()), pa.field("n_tokens", pa.int64())]
    fields += [pa.field("prefix_counts", pa.list_(pa.int32()))] * keep_prefixes
    fields += [pa.field(f"fit_{b}", pa.int64()) for b in budgets]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_file)
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                texts = [text or "" for text in batch.column(1).to_pylist()]
                counted = list(count.many(texts))
                columns = [batch.column(0).cast(pa.int64()), pa.array([len(text.encode()) for text in texts], pa.int64()), pa.array([int(c[-1]) for c in counted], pa.int64())]
                if keep_prefixes:
                    ends = np.cumsum([0, *map(len, counted)], dtype=np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(counted).astype(np.int32, copy=False))))
                columns += [pa.array([len(c) - 1 - int(np.argmax(c[::-1] <= b)) for c in counted], pa.int64()) for b in budgets]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    types = {pa.int64(): "long"}
    ddl = ", ".join(f"`{f.name}` {types.get(f.type, 'array<int>')}" for f in schema)
    return only(docs, id_col, text_col).mapInArrow(run, ddl)


def tokens_before(prefix_counts: Column, n_chars: Column | int) -> Column:
    """Tokens of the first n_chars characters, from stored counts."""
    return F.element_at(prefix_counts, F.least(F.lit(n_chars) + 1, F.size(prefix_counts)))


def chars_within(prefix_counts: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most `budget` tokens, from stored counts."""
    return (F.size(prefix_counts) - F.array_position(F.reverse(F.transform(prefix_counts, lambda x: x <= budget)), True)).cast("long")
