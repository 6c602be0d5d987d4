"""Problem 8: encoding by a byte-level BPE vocabulary of ranks.

A word is merged with a segment tree over its byte positions: each node holds the leftmost
position of the smallest pair rank below it, so that a merge costs a few point updates of
logarithmic depth and a word of n bytes O(n log n), whatever its length. Words repeat, so every
worker remembers the ids of the words it has met (:data:`MEMORY` entries at most; the memory only
saves time). Null and empty texts have the defined ids ``[]``.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Words a worker remembers at most, and the longest that it remembers, in characters.
MEMORY, LONGEST = 400_000, 64
# Fixed value: the published pattern that splits a text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces between white space: the bounds of SPLIT around white space, whatever stands between.
_chunks = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Python's \s has these, Unicode's White_Space has not.
_separators = re.compile("[\x1c-\x1f]")


class Ranks:
    """A vocabulary file of ranks (``base64 rank`` per line)."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.split = regex.compile(SPLIT).findall
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks: dict[str, tuple[int, ...]] = {}

    def word(self, data: bytes) -> tuple[int, ...]:
        """The ids of one word by merges of the leftmost pair of lowest rank."""
        ranks = self.ranks
        if (whole := ranks.get(data)) is not None:
            return (whole,)
        n = len(data)
        none = 1 << 40
        size = 1
        while size < n:
            size *= 2
        # leaf i: rank of the pair that starts at i, times n, plus i: the minimum is leftmost
        tree = [none] * (2 * size)
        get = ranks.get
        for i in range(n - 1):
            if (r := get(data[i : i + 2])) is not None:
                tree[size + i] = r * n + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after = list(range(1, n + 1))  # start of the live neighbour to the right
        before = list(range(-1, n - 1))
        while (top := tree[1]) != none:
            i = top % n
            j = after[i]
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            changes = [(j, none)]
            changes.append((i, none if k >= n or (r := get(data[i : after[k]])) is None else r * n + i))
            if (h := before[i]) >= 0:
                changes.append((h, none if (r := get(data[h:k])) is None else r * n + h))
            for at, value in changes:
                at += size
                tree[at] = value
                at >>= 1
                while at:
                    a, b = tree[2 * at], tree[2 * at + 1]
                    low = a if a < b else b
                    if tree[at] == low:
                        break
                    tree[at] = low
                    at >>= 1
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : after[i]]])
            i = after[i]
        return tuple(out)

    def chunk(self, text: str) -> tuple[int, ...]:
        ids: list[int] = []
        words = self.words
        for w in self.split(text):
            known = words.get(w)
            if known is None:
                known = self.word(w.encode("utf-8", "replace"))
                if len(w) <= LONGEST:
                    if len(words) >= MEMORY:
                        words.clear()
                    words[w] = known
            ids += known
        return tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text; strings that look like special tokens are plain text."""
        ids: list[int] = []
        self.extend(ids, text)
        return ids

    def extend(self, ids, text: str | None) -> None:
        if not text:
            return
        if _separators.search(text):
            ids.extend(self.chunk(text))
            return
        chunks = self.chunks
        for c in _chunks.findall(text):
            try:
                ids.extend(chunks[c])
            except KeyError:
                known = self.chunk(c)
                if len(c) <= LONGEST:
                    if len(chunks) >= MEMORY:
                        chunks.clear()
                    chunks[c] = known
                ids.extend(known)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Ranks:
    """Read once per Python worker, where its machine lacks the file from the copy that the driver sent."""
    return Ranks(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))


def _sent(df: DataFrame, path: str | None) -> str:
    """The path of the vocabulary, which goes along with the job."""
    path = path or rank_file()
    if os.path.exists(path):
        df.sparkSession.sparkContext.addFile(path)
    return path


def rank_file(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return os.path.join(folder, f"{name}.tiktoken")


def encode(df: DataFrame, key: str, column: str, path: str | None = None) -> DataFrame:
    """``(key, ids)`` for every row, null and empty texts included (ids ``[]``)."""
    path = _sent(df, path)
    src = df.select(F.col(key).alias("_k"), F.col(column).cast("string").alias("_t"))

    def work(batches):
        v = vocabulary(path)
        for b in batches:
            flat, ends = array("i"), array("i", [0])
            for t in b.column(1).to_pylist():
                v.extend(flat, t)
                ends.append(len(flat))
            lists = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)]), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["_k", "ids"])

    return src.mapInArrow(work, f"_k {src.schema['_k'].dataType.simpleString()}, ids array<int>").toDF(key, "ids")


def count_tokens(df: DataFrame, key: str, column: str, path: str | None = None) -> DataFrame:
    """``(key, tokens)``: the number of ids of every row, 0 for null and empty texts."""
    path = _sent(df, path)
    src = df.select(F.col(key).alias("_k"), F.col(column).cast("string").alias("_t"))

    def work(batches):
        v = vocabulary(path)
        chunks = v.chunks
        for b in batches:
            sizes = array("q")
            for t in b.column(1).to_pylist():
                n = 0
                if t and _separators.search(t):
                    n = len(v.chunk(t))
                elif t:
                    for c in _chunks.findall(t):
                        known = chunks.get(c)
                        if known is None:
                            known = v.chunk(c)
                            if len(c) <= LONGEST:
                                if len(chunks) >= MEMORY:
                                    chunks.clear()
                                chunks[c] = known
                        n += len(known)
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.Array.from_buffers(pa.int64(), len(sizes), [None, pa.py_buffer(sizes)])], names=["_k", "tokens"])

    return src.mapInArrow(work, f"_k {src.schema['_k'].dataType.simpleString()}, tokens bigint").toDF(key, "tokens")
