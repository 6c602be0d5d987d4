"""Problem 10: abusive, hateful or sexual content, by nearest labelled examples.

The examples are the sentences of a bounded sample of reviewed documents (:data:`LABELLED_POSITIVE`
and :data:`LABELLED_NEGATIVE` rows by hash of the id; the others are scored, not learned from). They
are held as a block-max inverted index: postings by term in blocks of 64 examples, each block with
its largest weight, so that a search sums the bounds of the blocks, scores the most promising ones
and skips every block that cannot reach the k-th best; the cosines it returns are exact.

A label holds for a document, not for its sentences, and some are wrong. Sentences of positive
documents are therefore voted on by their own neighbours first; those that keep a majority are the
prototypes. A sentence is a case if a prototype is within reach and the distance-weighted vote of
its neighbours passes :data:`LEAST_SHARE`; the vote is the score, the nearest prototype the evidence.
The examples of each class weigh as many sentences as the sample stands for, so a vote is an estimate
of the share of positive labels near a sentence, whatever the size of the sample.

A sentence beyond the reach of every prototype has the score 0 by definition. Most are ruled out
without a search, and exactly: the prototypes stand in blocks of a few alike ones, each with the
largest weight of a term, and a sentence whose sum of these weights is under the reach in every block
cannot have a cosine within it. The sums of a batch of documents are taken at once, first over one
block of all prototypes, then for what is left over large blocks, small ones and single prototypes.

Terms are words and pairs of words of a folded text: one form of look-alike letters, no case, no
accents, runs of one letter as one, figures and signs inside words read as letters, letters of
scripts without spaces in pairs.

Cases: null, empty and blank texts score 0; documents without labels are scored like others; labels
of null are ignored; a label given twice counts once; with no positive label all scores are 0.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forms import visual_form

#: Bounds of the sample that the index is made of.
LABELLED_POSITIVE, LABELLED_NEGATIVE = 1500, 2500
NEIGHBOURS, LEAST_COSINE, REACH, LEAST_SHARE, PROTOTYPE, BLOCK = 20, 0.25, 0.3, 0.62, 0.56, 64
#: Blocks of bounds are of so many prototypes or smaller blocks; documents whose sums are taken at once.
ALIKE, AT_ONCE = 8, 500
#: Words and sentences that a worker remembers; the memory only saves time.
MEMORY = 300_000

# Figures and signs that stand for letters inside words.
_leet = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i", "|": "i"})
_token = re.compile(r"[^\W_]+(?:[*$@!|.]{1,3}(?=[^\W_])[^\W_]+)*[*$@]*|[*$@]+[^\W_]+")
_runs = re.compile(r"([^\W\d_])\1{2,}")
_accents = re.compile("[\u0300-\u036f]+")
_stars = re.compile(r"\*+")
_unspaced = re.compile("[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]")
_wide_end = re.compile("(?<=[\u3002\uff01\uff1f])")
_closers, _ends = ")\"”»'’", (".", "!", "?", "؟", "।")
_maybe_spaced = re.compile(r"[ ._\-][^\W\d_][ ._\-][^\W\d_][ ._\-]")
_spaced_letters = re.compile(r"(?<![^\W_])(?:[^\W\d_][ ._\-]){3,}[^\W\d_](?![^\W_])")


def _term(word: str) -> tuple[str, ...]:
    """A word as terms: runs of one letter as one, no accents, signs read as letters; letters of
    scripts without spaces in pairs."""
    if word.isdigit():
        return ()
    w = _runs.sub(r"\1", word)
    if not w.isascii():
        w = _accents.sub("", unicodedata.normalize("NFD", w)).replace("đ", "d")
    if not w.isalpha():
        w = _stars.sub("*", w) if "*" in w else w.replace(".", "").translate(_leet)
    if len(w) > 1 and _unspaced.search(w):
        return tuple(w[i : i + 2] for i in range(len(w) - 1))
    return (w,) if w else ()


#: Stands for the end of a sentence between two lines.
END = "\0"


@lru_cache(maxsize=MEMORY)
def _read(chunk: str) -> list[tuple[str, tuple[str, ...], bool]]:
    """What stands between two blanks, as parts ``(text, terms, ends a sentence)``; mostly one."""
    parts = [x for x in _wide_end.split(chunk) if x]
    out = [(x, tuple(t for w in _token.findall(x) for t in _term(w)), True) for x in parts]
    if parts and parts[-1][-1] not in "。！？":
        out[-1] = (*out[-1][:2], parts[-1].rstrip(_closers).endswith(_ends))
    return out


def _lines(text: str) -> list[tuple[str, bool]]:
    """The lines of a text in one form and lower case, and whether each ends a sentence: one that ends
    well before the widest one does."""
    t = visual_form(text).lower()
    if END in t:
        t = t.replace(END, " ")
    if _maybe_spaced.search(t):
        t = _spaced_letters.sub(lambda m: re.sub(r"[ ._\-]", "", m[0]), t)
    lines = t.split("\n")
    width = max(map(len, lines)) * 0.7 if len(lines) > 1 else 0
    return [(x, len(x) < width) for x in lines]


def sentences(text: str) -> list[tuple[str, tuple[str, ...]]]:
    """Sentences of a text with their terms; a sentence of no words is one too."""
    out: list[tuple[str, tuple[str, ...]]] = []
    words: list[str] = []
    ts: list[str] = []

    def close():
        out.append((" ".join(words), tuple(ts)))
        words.clear()
        ts.clear()

    for line, short in _lines(text):
        for chunk in line.split():
            for part, terms, ends in _read(chunk):
                words.append(part)
                ts.extend(terms)
                if ends:
                    close()
        if short:
            close()
    close()
    return out


def grams(ts: tuple[str, ...]) -> list[str]:
    return [*ts, *map(" ".join, zip(ts, ts[1:], strict=False))]


class BlockMaxIndex:
    """Unit TF-IDF vectors; ``search`` gives the exact k nearest by cosine."""

    def __init__(self, rows: list[list[str]]):
        self.n = len(rows)
        self.terms: dict[str, int] = {}
        number = self.terms.setdefault
        flat = np.array([number(g, len(self.terms)) for r in rows for g in r], np.int64)
        size = len(self.terms)
        pair, count = np.unique(np.repeat(np.arange(self.n), [len(r) for r in rows]) * max(size, 1) + flat, return_counts=True)
        d, t = pair // max(size, 1), pair % max(size, 1)
        self.idf = np.log1p(self.n / np.maximum(np.bincount(t, minlength=size), 1)) if size else np.empty(0)
        self.unknown = math.log1p(self.n)
        v = (1 + np.log(count)) * self.idf[t]
        w = v / np.maximum(np.sqrt(np.bincount(d, v * v, self.n)), 1e-12)[d] if size else v
        order = np.lexsort((d, t))
        t, self.docs, self.weights = t[order], d[order].astype(np.int32), w[order].astype(np.float32)
        self.start = np.searchsorted(t, np.arange(size + 1))
        key = t * (self.n // BLOCK + 1) + self.docs // BLOCK
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if size else np.empty(0, np.int64)
        self.block_max = np.maximum.reduceat(self.weights, first) if size else np.empty(0, np.float32)
        self.block_no = self.docs[first] // BLOCK
        self.block_from = first
        self.block_to = np.r_[first[1:], len(t)]
        self.block_start = np.searchsorted(t[first], np.arange(size + 1))

    def vector(self, gs: list[str]) -> tuple[list[int], list[float]]:
        c = Counter(gs)
        ids, v, norm = [], [], 0.0
        for x, n in c.items():
            i = self.terms.get(x)
            y = (1 + math.log(n)) * (self.unknown if i is None else self.idf[i])
            norm += y * y
            if i is not None:
                ids.append(i)
                v.append(y)
        norm = math.sqrt(norm) or 1.0
        return ids, [y / norm for y in v]

    def search(self, ids: list[int], v: list[float], k: int, least: float, skip: int = -1) -> list[tuple[float, int]]:
        if not len(ids):
            return []
        ids, v = np.asarray(ids), np.asarray(v)
        entries, of = _ranges(self.block_start[ids], self.block_start[ids + 1])
        no, y = self.block_no[entries], v[of]
        bound = np.bincount(no, y * self.block_max[entries], self.n // BLOCK + 1)
        first = min(6, len(bound))
        best = np.argpartition(-bound, first - 1)[:first]  # the threshold comes from the most promising blocks
        chosen = np.zeros(len(bound), bool)
        chosen[best] = True
        score = self._scores(entries, y, chosen[no])
        if skip >= 0:
            score[skip] = 0
        some = np.concatenate([score[x * BLOCK : (x + 1) * BLOCK] for x in best])
        floor = max(least, float(np.partition(some, len(some) - k)[len(some) - k])) if len(some) >= k else least
        alive = bound >= floor - 1e-6
        alive[best] = False
        if alive.any():
            score += self._scores(entries, y, alive[no])
            if skip >= 0:
                score[skip] = 0
        hit = np.flatnonzero(score >= floor - 1e-6)
        hit = hit[np.lexsort((hit, -score[hit]))][:k]
        return [(float(score[i]), int(i)) for i in hit if score[i] >= least]

    def _scores(self, entries, y, keep) -> np.ndarray:
        e = entries[keep]
        at, of = _ranges(self.block_from[e], self.block_to[e])
        return np.bincount(self.docs[at], y[keep][of] * self.weights[at], self.n)


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of several ranges one after another, and which range each is of."""
    n = stop - start
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - (np.cumsum(n) - n)[of] + start[of], of


class _Known(dict):
    """What stands between two blanks by number, and of each number the words it holds, -1 where a sentence
    ends. Words that the examples lack have numbers of their own, beyond those of the index."""

    def __init__(self, words: dict[str, int]):
        super().__init__()
        self.index_words = words
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.words, self.flat, self.ends = dict(self.index_words), [-1], [0, 1]
        self[END] = 0
        self.arrays = np.array(self.flat), np.array(self.ends)

    def __missing__(self, chunk: str) -> int:
        number = self.words.setdefault
        for _, terms, ends in _read(chunk):
            self.flat += [number(x, len(self.words)) for x in terms]
            if ends:
                self.flat.append(-1)
        self.ends.append(len(self.flat))
        code = self[chunk] = len(self)
        return code

    def expand(self, codes: list[int]) -> np.ndarray:
        """The words of all chunks, one after another."""
        flat, ends = self.arrays
        if len(ends) < len(self.ends):
            new = len(ends)
            flat = np.concatenate([flat, np.array(self.flat[len(flat) :], np.int64)])
            ends = np.concatenate([ends, np.array(self.ends[new:], np.int64)])
            self.arrays = flat, ends
        at, _ = _ranges(ends[codes], ends[np.array(codes) + 1])
        return flat[at]


class Model:
    """The index, the votes of its examples and the prototypes among them, with the bounds that rule
    sentences out. Prototypes are told by :meth:`keeps`, example by example, and set by :meth:`settle`."""

    def __init__(self, labelled: list[tuple[str, int]], positives_share: float = 1.0, negatives_share: float = 1.0):
        votes: dict[str, list[float]] = {}
        for text, toxic in labelled:
            for t in {" ".join(ts) for _, ts in sentences(text)} if text else ():
                if t:
                    votes.setdefault(t, [0.0, 0.0])[1 if toxic else 0] += 1 / (positives_share if toxic else negatives_share)
        self.examples = sorted(votes)  # like next to like, for blocks with sharp bounds
        self.index = BlockMaxIndex([grams(tuple(t.split(" "))) for t in self.examples])
        self.votes = np.array([votes[t] for t in self.examples], np.float64).reshape(-1, 2)
        self.asked = np.flatnonzero(self.votes[:, 1] > 0)
        self.settle(np.empty(0, np.int64))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "scored", "levels", "highest")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._bounds()

    def keeps(self, i: int) -> bool:
        """Do the neighbours of an example of a positive document vote for it?"""
        ids, v = self.index.vector(grams(tuple(self.examples[i].split(" "))))
        return self._share(self.index.search(ids, v, NEIGHBOURS, LEAST_COSINE, i), own=i) >= PROTOTYPE

    def settle(self, prototypes: np.ndarray) -> None:
        ix = self.index
        size = len(ix.terms)
        self.prototype = np.zeros(len(self.examples), bool)
        self.prototype[prototypes] = True
        mine = self.prototype[ix.docs] if len(ix.docs) else np.empty(0, bool)
        term = np.repeat(np.arange(size), np.diff(ix.start))[mine]
        no = np.searchsorted(prototypes, ix.docs[mine])
        self.near_docs, self.near_weights = no, ix.weights[mine]
        self.near_start = np.searchsorted(term, np.arange(size + 1))
        # words by number, pairs by the numbers of their words; the last number is that of unknown words
        self.words = {t: k for k, t in enumerate(x for x in ix.terms if " " not in x)}
        self.base = len(self.words) + 1
        of_word = np.full(self.base, size)
        pairs = []
        for x, i in ix.terms.items():
            if " " in x:
                a, b = x.split(" ")
                pairs.append((self.words[a] * self.base + self.words[b], i))
            else:
                of_word[self.words[x]] = i
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.of_word, self.pair_keys, self.of_pair = of_word, pairs[:, 0].copy(), pairs[:, 1].copy()
        own = np.unique(term)
        self.row = np.zeros(size + 1, np.int64)  # row 0 of the bounds is that of all terms of no prototype
        self.row[own] = np.arange(1, len(own) + 1)
        weight = np.r_[ix.idf, ix.unknown]
        self.weight, self.square, self.near_idf = weight, weight * weight, weight[own]
        self._bounds()

    def _bounds(self) -> None:
        """The weights of every term in the prototypes, and the largest of each block of them: arrays of
        rows by blocks by parts of a block, from single prototypes up."""
        self.known, self.scored = _Known(self.words), {}
        n = max(1, -(-int(self.prototype.sum()) // (ALIKE * ALIKE))) * ALIKE
        x = np.zeros((len(self.near_idf) + 1, n * ALIKE), np.float32)
        term = np.repeat(np.arange(len(self.near_start) - 1), np.diff(self.near_start))
        x[self.row[term], self.near_docs] = self.near_weights * self.near_idf[self.row[term] - 1] if len(term) else 0
        x = x.reshape(len(x), n, ALIKE)
        y = x.max(axis=2).reshape(len(x), n // ALIKE, ALIKE)
        self.levels = [y.max(axis=2), y, x]
        self.highest = self.levels[0].max(axis=1)[self.row]

    def _share(self, near: list[tuple[float, int]], own: int = -1) -> float:
        p = s = 0.0
        for c, i in [*near, *([(1.0, own)] if own >= 0 else [])]:
            a, b = self.votes[i]
            p += c * c * b
            s += c * c * (a + b)
        return p / s if s else 0.0

    def _vector(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms of the index in a sentence of words by number, and their weights in its unit vector."""
        size, last = len(self.index.terms), self.base - 1
        x = np.asarray(x, np.int64)  # of no words too, whose array is one of floats
        words, m = np.unique(x, return_counts=True)
        pairs, n = np.unique(x[:-1] << 32 | x[1:], return_counts=True)
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        key = np.where((a < last) & (b < last), a * self.base + b, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        term = np.r_[self.of_word[np.minimum(words, last)], np.where(self.pair_keys[at] == key, self.of_pair[at], size)]
        v = (1 + np.log(np.r_[m, n])) * self.weight[term]
        known = term < size
        return term[known], v[known] / np.sqrt((v * v).sum())

    def score(self, words: tuple[int, ...]) -> tuple[float, int]:
        """The vote and the nearest prototype of a sentence of words by number; (0, -1) if none is within reach."""
        if not words or not len(self.near_docs) or not len(self.pair_keys):
            return 0.0, -1
        ids, v = self._vector(np.array(words, np.int64))
        at, of = _ranges(self.near_start[ids], self.near_start[ids + 1])
        if not len(at) or np.bincount(self.near_docs[at], v[of] * self.near_weights[at]).max() < REACH - 1e-5:
            return 0.0, -1
        near = self.index.search(ids, v, NEIGHBOURS, LEAST_COSINE)
        proto = next((i for s, i in near if self.prototype[i] and s >= REACH), -1)
        return (self._share(near), proto) if proto >= 0 else (0.0, -1)

    def numbers(self, terms: tuple[str, ...]) -> tuple[int, ...]:
        number = self.known.words.setdefault
        return tuple(number(x, len(self.known.words)) for x in terms)

    def within_bounds(self, texts: list[str | None]) -> list[tuple[int, int, tuple[int, ...]]]:
        """``(text, sentence, words)`` by number of all sentences that a prototype may be within reach of."""
        if len(self.known) >= MEMORY:
            self.known.reset()
            self.scored.clear()
        codes: list[int] = []
        code = self.known.__getitem__
        ends = []
        for t in texts:
            if t:
                lines = _lines(t)
                codes.extend(map(code, " ".join([x + " " + END if short else x for x, short in lines]).split()))
            codes.append(0)
            ends.append(len(codes))
        if not len(self.pair_keys):
            return []
        x = self.known.expand(codes)
        close = x < 0
        number = np.cumsum(close)
        # the number of the first sentence of each text: the ends before it
        until = np.cumsum(np.diff(self.known.arrays[1])[codes])[np.array(ends) - 1]
        first = np.r_[0, number[until - 1][:-1]] if len(ends) else np.empty(0, np.int64)
        n = int(number[-1]) if len(number) else 0
        s, x = number[~close], x[~close]
        if not len(x):
            return []
        size, last = len(self.index.terms), self.base - 1
        w = np.minimum(x, last)
        next_to = (s[1:] == s[:-1]) & (w[1:] < last) & (w[:-1] < last)
        key = (w[:-1] * self.base + w[1:])[next_to]
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        term, of = np.r_[self.of_word[w], np.where(self.pair_keys[at] == key, self.of_pair[at], size)], np.r_[s, s[1:][next_to]]
        words = np.maximum(np.bincount(s, minlength=n), 1)
        pairs = np.bincount(s[1:][s[1:] == s[:-1]], minlength=n) - np.bincount(s[1:][next_to], minlength=n)
        # a term that stands m times weighs 1 + ln m: m at most, and of m its square is at least this share
        norm = np.sqrt((np.bincount(of, self.square[term], n) + pairs * self.square[size]) * np.minimum(1, (1 + np.log(words)) ** 2 / words))
        least = (REACH - 1e-4) * norm
        high = self.highest[term]
        some = high > 0
        term, of = term[some], of[some]
        alive = (np.bincount(of, high[some], n) >= least) & (norm > 0)
        some = alive[of]
        term, of = term[some], of[some]
        order = np.argsort(of, kind="stable")
        term, of = term[order], of[order]
        if not len(of):
            return []
        begin = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        until = np.r_[begin[1:], len(of)]
        sentence, row = of[begin], self.row[term]
        i, block = np.nonzero(np.add.reduceat(self.levels[0][row], begin, axis=0) >= least[sentence][:, None])
        for level in self.levels[1:]:
            if not len(i):
                return []
            at, pair = _ranges(begin[i], until[i])
            sums = np.add.reduceat(level[row[at], block[pair]], np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]), axis=0)
            k, part = np.nonzero(sums >= least[sentence[i]][:, None])
            i, block = i[k], block[k] * ALIKE + part
        left = sentence[np.unique(i)]
        doc = np.searchsorted(first, left, side="right") - 1
        a, b = np.searchsorted(s, left), np.searchsorted(s, left, side="right")
        return [(int(d), int(k - first[d]), tuple(x[y:z].tolist())) for d, k, y, z in zip(doc, left, a, b, strict=True)]

    def scores(self, texts: list[str | None]) -> list[tuple[float, str | None, str | None]]:
        """Of every text the highest score, its sentence and the nearest prototype."""
        best: dict[int, tuple[float, int, int]] = {}
        for d, k, words in self.within_bounds(texts):
            got = self.scored.get(words)
            if got is None:
                got = self.scored[words] = self.score(words)
            if got[0] > best.get(d, (0.0,))[0]:
                best[d] = (got[0], k, got[1])
        out: list[tuple[float, str | None, str | None]] = [(0.0, None, None)] * len(texts)
        for d, (score, k, i) in best.items():
            out[d] = (score, sentences(texts[d])[k][0], self.examples[i])
        return out


def learn(documents: DataFrame, labels: DataFrame, positive: int = LABELLED_POSITIVE, negative: int = LABELLED_NEGATIVE) -> Model:
    """The model of the bounded sample; every other step looks at all documents. The votes on the
    examples are taken by the executors; a flag of each comes back."""
    spark = documents.sparkSession
    y = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {int(r["toxic"] > 0): r["n"] for r in y.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    most = {1: positive, 0: negative}
    taken = [y.where((F.col("toxic") > 0) == bool(k)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[k]) for k in (1, 0)]
    sample = taken[0].unionByName(taken[1])
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).select("text", "toxic").collect()
    share = {k: min(1.0, most[k] / sizes[k]) if sizes.get(k) else 1.0 for k in (0, 1)}
    model = Model(sorted((r["text"], int(r["toxic"] > 0)) for r in rows), share[1], share[0])
    if len(model.asked):
        shared = spark.sparkContext.broadcast(model)

        def ask(batches):
            m = shared.value
            for b in batches:
                kept = [i for i in b.column(0).to_pylist() if m.keeps(int(m.asked[i]))]
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64())], names=["id"])

        kept = spark.range(0, len(model.asked), 1, 1 + len(model.asked) // 250).mapInArrow(ask, "id bigint").collect()
        model.settle(np.sort(model.asked[[r["id"] for r in kept]]) if kept else np.empty(0, np.int64))
    return model


def scored(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, score, evidence, example)``: the highest vote of a sentence, that sentence, and the
    nearest prototype; every row of ``documents`` has one."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    src = documents.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))

    def work(batches):
        m = shared.value
        for b in batches:
            for k in range(0, b.num_rows, AT_ONCE):
                part = b.slice(k, AT_ONCE)
                got = m.scores(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([round(x[0], 6) for x in got], pa.float64()), *(pa.array([x[i] for x in got], pa.string()) for i in (1, 2))], names=["_k", "score", "evidence", "example"])

    kind = src.schema["_k"].dataType.simpleString()
    return src.mapInArrow(work, f"_k {kind}, score double, evidence string, example string").withColumnRenamed("_k", key)


def rates(documents: DataFrame, scores: DataFrame, least: float = LEAST_SHARE) -> DataFrame:
    """Per source: documents, cases, rate."""
    j = documents.select("doc_id", F.coalesce("source", F.lit("")).alias("source")).join(scores.select("doc_id", "score"), "doc_id")
    return j.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("score") >= least).alias("cases")).withColumn("rate", F.round(F.col("cases") / F.col("documents"), 6))
