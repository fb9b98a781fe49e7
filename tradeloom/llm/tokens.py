"""Encoding of a whole corpus with a public byte-level BPE tokenizer, as a tree of joins.

A text is encoded as a monoid: halves are encoded on their own, down to leaves, and neighbours are joined. The tokenizer cuts a text into
pieces from left to right, each piece decided by the text from its start to at most a few characters beyond its end, and merges bytes only
within a piece. So in a join the left part's pieces that end clear of its edge stand; from there the text is cut anew in a window that
grows until a new piece starts where the right part has one, after which the right part's pieces stand too, because cutting from the same
place gives the same pieces. Only tokens between these two places are encoded again. Decoding joins the bytes of the tokens.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pieces of this family of tokenizers, a fixed value of the vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: No piece is decided by more than this many characters after its end.
REACH = 3
FOLDER = os.environ.get("TRADELOOM_TOKENIZERS", "/opt/tokenizers")


@dataclass
class Span:
    """The encoding of text[start:stop]: starts of its pieces, where each piece's tokens begin in ids, and ids."""

    start: int
    stop: int
    starts: list[int]
    cuts: list[int]
    ids: list[int]

    def until(self, n: int) -> tuple[list[int], list[int], list[int]]:
        """Its first n pieces."""
        return self.starts[:n], self.cuts[:n], self.ids[: self.cuts[n] if n < len(self.cuts) else len(self.ids)]


class TreeEncoder:
    def __init__(self, vocabulary: str | Path, leaf: int = 1024):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).open("rb"))}
        self.encoding = tiktoken.Encoding("tree", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.pieces, self.leaf = regex.compile(PIECES), max(leaf, 2)
        self.token_bytes = {v: k for k, v in ranks.items()}
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)

    def encode(self, text: str | None) -> list[int] | None:
        """Token ids; none for an empty text, None for a null one. Strings of special tokens are ordinary text."""
        if text is None:
            return None
        if len(text) <= self.leaf:
            return self.encoding.encode_ordinary(text)
        return self._tree(text, 0, len(text)).ids

    def decode(self, ids: list[int] | None) -> str | None:
        return None if ids is None else b"".join(self.token_bytes[i] for i in ids).decode("utf-8")

    def _tree(self, text: str, start: int, stop: int) -> Span:
        if stop - start <= self.leaf:
            return self._leaf(text, start, stop)
        half = (start + stop) // 2
        return self._join(text, self._tree(text, start, half), self._tree(text, half, stop))

    def _leaf(self, text: str, start: int, stop: int) -> Span:
        part = text[start:stop]
        pieces = self.pieces.findall(part)
        sizes = [len(p) for p in pieces]
        starts = (start + np.cumsum([0, *sizes[:-1]])).tolist() if pieces else []
        ids = self.encoding.encode_ordinary(part)
        at = np.cumsum([0, *(len(p.encode()) for p in pieces)])[:-1]
        ends = np.cumsum(self.lengths[ids]) if ids else np.zeros(0, np.int64)
        cuts = np.where(at == 0, 0, np.searchsorted(ends, at) + 1)
        if len(at) > 1 and not np.array_equal(ends[cuts[1:] - 1], at[1:]):  # the two libraries cut differently: piece by piece then
            return Span(start, stop, *self._each(starts, pieces))
        return Span(start, stop, starts, cuts.tolist(), ids)

    def _each(self, starts: list[int], pieces: list[str]) -> tuple[list[int], list[int], list[int]]:
        cuts, ids = [], []
        for p in pieces:
            cuts.append(len(ids))
            ids += self.encoding.encode_ordinary(p)
        return starts, cuts, ids

    def _join(self, text: str, left: Span, right: Span) -> Span:
        n = len(left.starts)
        while n and (left.starts[n] if n < len(left.starts) else left.stop) + REACH > left.stop:
            n -= 1
        begin = left.starts[n] if n < len(left.starts) else left.stop
        size = 2 * (left.stop - begin) + 64
        while True:
            end = min(begin + size, right.stop)
            starts, pieces, meet = [], [], None
            for m in self.pieces.finditer(text, begin, end) if end == right.stop else self.pieces.finditer(text[begin:end]):
                s, e = (m.start(), m.end()) if end == right.stop else (m.start() + begin, m.end() + begin)
                if s >= right.start:
                    i = bisect_left(right.starts, s)
                    if i < len(right.starts) and right.starts[i] == s:
                        meet = i
                        break
                if e + REACH > end and end < right.stop:
                    break
                starts.append(s)
                pieces.append(m.group())
            else:
                if end == right.stop:
                    meet = len(right.starts)
            if meet is not None:
                break
            size *= 2
        a, b, c = left.until(n)
        s, k, ids = self._each(starts, pieces)
        base = len(c) + len(ids)
        first = right.cuts[meet] if meet < len(right.cuts) else len(right.ids)
        return Span(left.start, right.stop, a + s + right.starts[meet:], b + [len(c) + x for x in k] + [base + x - first for x in right.cuts[meet:]], c + ids + right.ids[first:])


@lru_cache(maxsize=4)
def encoder(vocabulary: str, leaf: int) -> TreeEncoder:
    return TreeEncoder(vocabulary, leaf)


def vocabulary(name: str = "byte_bpe_50k", folder: str | None = None) -> str:
    return f"{folder or FOLDER}/{name}.tiktoken"


def spread(df: DataFrame) -> DataFrame:
    """df in enough partitions to occupy every core: texts of an input of fewer partitions than twice the cores are shuffled once, larger inputs stay where they are."""
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def encode_corpus(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary_file: str | None = None, leaf: int = 1024) -> DataFrame:
    """(doc_id, ids), a row for each row of documents: ids is null for a null text and empty for an empty one.

    Texts are whole, of any length; blanks are encoded like any text. Other columns are dropped. Batches of texts pass through Python in Arrow
    form; nothing is shuffled unless the input has too few partitions to occupy the cores (see spread).
    """
    path = vocabulary_file or vocabulary()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = encoder(path, leaf)
        for b in it:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                ids = pa.array([tree.encode(t) for t in part.column(1).to_pylist()], type=pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    plain = spread(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    return plain.mapInArrow(batches, "doc_id long, ids array<int>")


def decode_corpus(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary_file: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids), the inverse of encode_corpus."""
    path = vocabulary_file or vocabulary()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = encoder(path, 1024)
        for b in it:
            texts = pa.array([tree.decode(i) for i in b.column(1).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=["doc_id", "text"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(batches, "doc_id long, text string")


def count_tokens(documents: DataFrame, keep: list[str], text: str = "text", vocabulary_file: str | None = None, leaf: int = 1024) -> DataFrame:
    """The kept columns and n_tokens (0 for an empty text, null for a null one)."""
    path = vocabulary_file or vocabulary()
    fields = [documents.schema[k] for k in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_tokens long"

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = encoder(path, leaf)
        for b in it:
            counts = [None if (ids := tree.encode(t)) is None else len(ids) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts, type=pa.int64())], names=[*keep, "n_tokens"])

    return spread(documents.select(*keep, F.col(text).cast("string").alias("text__"))).mapInArrow(batches, schema)
