"""Ranking of passages for a batch of questions: BM25, hashed sparse vectors, hybrid, dense.

Questions come in blocks that every task gets whole; a task multiplies its passages with the block as
matrices and gives the best of them, or a row of scores a passage. So no table of pairs is shuffled,
and statistics are sums of parts that each task has made."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from ..session import cut, sized_join

K1, B, DIMS = 1.5, 0.75, 2048
#: Questions of a block, and passages multiplied at once.
BLOCK, ROWS = 512, 512
#: Features whose frequencies are sent to every task at most (16 bytes each); more are joined by shuffle.
MOST_FEATURES = 4_000_000


def top_k(scores: DataFrame, k: int, by: str = "score", group: str = "query_id", tie: str = "chunk_id") -> DataFrame:
    """The k best rows of each group, rank 1 first; ties by the smaller id. Spark cuts each
    partition to k rows a group before the shuffle."""
    w = Window.partitionBy(group).orderBy(F.desc(by), tie)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks(questions: DataFrame, size: int = BLOCK, *columns: str):
    """The questions in blocks of about ``size``, as lists of rows; each is read on its own."""
    q = questions.select("query_id", *(columns or ("question",)))
    n = q.count()
    parts = max(1, -(-n // size))
    for i in range(parts):
        rows = q.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i).collect() if parts > 1 else q.collect()
        if rows:
            yield rows


def _union(parts: list[DataFrame], spark, schema: str) -> DataFrame:
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out if out is not None else spark.createDataFrame([], schema)


def _lists(rows: list, kind) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.concatenate(rows) if len(rows) else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind)))


def postings(chunks: DataFrame, terms: dict[str, int], analyser: str) -> DataFrame:
    """``(chunk_id, dl, ids, tfs)`` of every passage with terms: its length, and the terms asked for."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()

    def work(batches):
        analyse = T.BATCH_ANALYSERS[analyser]
        for b in batches:
            at, dl, ids, tfs = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                toks = analyse(t) if t else ()
                if not toks:
                    continue
                c = Counter(map(terms.get, toks))
                c.pop(None, None)
                at.append(i)
                dl.append(len(toks))
                ids.append(np.fromiter(c.keys(), np.int32, len(c)))
                tfs.append(np.fromiter(c.values(), np.int32, len(c)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(dl, pa.int32()), _lists(ids, np.int32), _lists(tfs, np.int32)], names=["chunk_id", "dl", "ids", "tfs"])

    return chunks.select("chunk_id", F.col("text").cast("string")).mapInArrow(work, f"chunk_id {kind}, dl int, ids array<int>, tfs array<int>")


def _gains(dl: np.ndarray, row: np.ndarray, ids: np.ndarray, tf: np.ndarray, idf: np.ndarray, avg: float) -> np.ndarray:
    """Passages by terms: what each term adds to the score of a passage, for one occurrence in the question."""
    out = np.zeros((len(dl), len(idf)))
    out[row, ids] = idf[ids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avg))
    return out


def bm25(chunks: DataFrame, questions: DataFrame, analyser: str = "basic", k: int | None = None, occurrences: bool = False) -> DataFrame:
    """``(query_id, chunk_id, score)`` of all passages that share a term with the question, or of about
    the best ``k`` of each task. Corpus statistics are those of all passages. ``occurrences`` takes the
    occurrences of a term in place of the passages that have it; scores below 0 can then arise and stay."""
    spark = chunks.sparkSession
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    analyse = T.BATCH_ANALYSERS[analyser]
    schema = f"query_id {questions.schema['query_id'].dataType.simpleString()}, chunk_id {kind}, score double"
    parts = []
    for block in _blocks(questions):
        counts = [Counter(analyse(r["question"] or "")) for r in block]
        terms = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
        asked = np.zeros((len(terms), len(block)))
        for j, c in enumerate(counts):
            for t, n in c.items():
                asked[terms[t], j] = n
        post = cut(postings(chunks, terms, analyser))
        s = post.agg(F.count("*").alias("n"), F.avg("dl").alias("avg")).first()
        n, avg = s["n"] or 0, float(s["avg"] or 1.0)
        df = np.zeros(len(terms))
        for r in post.select(F.explode(F.arrays_zip("ids", "tfs")).alias("x")).groupBy("x.ids").agg(F.sum(F.col("x.tfs") if occurrences else F.lit(1)).alias("n")).collect():
            df[r["ids"]] = r["n"]
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        names = np.array([r["query_id"] for r in block])

        def work(batches, idf=idf, avg=avg, asked=asked, names=names):
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    b = batch.slice(at, ROWS)
                    ids = b.column(2)
                    row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(ids.offsets)))
                    s = np.round(_gains(np.asarray(b.column(1), dtype=float), row, np.asarray(ids.flatten()), np.asarray(b.column(3).flatten(), dtype=float), idf, avg) @ asked, 6)
                    keys = np.asarray(b.column(0))
                    hit = s != 0 if occurrences else s > 0
                    if k is not None and k < len(keys):
                        order = np.lexsort((np.broadcast_to(keys, s.T.shape), -np.where(hit, s, -np.inf).T), axis=1)[:, :k]
                        best = np.zeros(s.shape, bool)
                        best[order, np.arange(s.shape[1])[:, None]] = True
                        hit &= best
                    i, j = np.nonzero(hit)
                    yield pa.RecordBatch.from_arrays([pa.array(names[j]), pa.array(keys[i], b.column(0).type), pa.array(s[i, j])], names=["query_id", "chunk_id", "score"])

        parts.append(post.mapInArrow(work, schema))
    return _union(parts, spark, schema)


def minmax(scores: DataFrame, by: str = "score", group: str = "query_id", digits: int | None = 6) -> DataFrame:
    """Scores of each group to 0..1; a constant group to 1. By an aggregate and a join on the group,
    so that a large group is never sorted in one place. What goes on into sums is not rounded
    (``digits`` None), as a sum of rounded values may lie half way between two."""
    m = scores.groupBy(group).agg(F.min(by).alias("_lo"), F.max(by).alias("_hi"))
    x = sized_join(scores, m, [group])
    norm = (F.col(by) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return x.withColumn("norm", F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise(norm if digits is None else F.round(norm, digits))).drop("_lo", "_hi")


def rewrites(questions: DataFrame) -> DataFrame:
    """``(query_id, variant, weight, question)``: the question, without accents, expanded, and both;
    of equal texts the first stays."""
    q = F.col("question")
    low, bare = F.lower(q), T.fold(q)
    extra, plain = F.lit(""), F.lit("")
    for trigger, more in lexicon.EXPANSIONS.items():
        twin = [T.folded(x) for x in more]
        for t, xs in ((trigger, more), (T.folded(trigger), twin)):
            hit = F.contains(low, F.lit(t)) | F.contains(F.lower(bare), F.lit(t))
            extra = F.concat(extra, F.when(hit, F.lit("".join(" " + x for x in xs))).otherwise(""))
            plain = F.concat(plain, F.when(hit, F.lit("".join(" " + T.folded(x) for x in xs))).otherwise(""))
    variants = [("original", 1.0, T.clean_text(q)), ("unaccented", 0.95, F.when(bare != q, bare)), ("expanded", 0.55, F.when(extra != "", F.concat(q, extra))), ("expanded_unaccented", 0.50, F.when(extra != "", F.concat(bare, plain)))]
    v = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("variant"), F.lit(w).alias("weight"), c.alias("text")) for i, (n, w, c) in enumerate(variants)])
    x = questions.select("query_id", F.filter(v, lambda y: F.coalesce(y["text"], F.lit("")) != "").alias("v"))
    first = F.filter("v", lambda x: ~F.exists("v", lambda y: (y["pos"] < x["pos"]) & (F.lower(y["text"]) == F.lower(x["text"]))))
    return x.select("query_id", F.explode(first).alias("v")).select("query_id", "v.variant", "v.weight", F.col("v.text").alias("question"))


#: Different features that a task counts before it hands them on, and features of a batch that it gives.
HELD, GIVEN = 300_000, 50_000


def _gathered(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, texts)``: one row a key; texts are shuffled only where a key stands more than once, or is null."""
    df = df.select(key, F.col(text).cast("string").alias("_t"))
    twice = cut(df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).where(F.col(key).isNotNull()).select(key))
    one = sized_join(df.where(F.col(key).isNotNull()), twice, [key], "left_anti").select(key, F.array("_t").alias("texts"))
    more = sized_join(df, twice, [key], "left_semi").unionByName(df.where(F.col(key).isNull()))
    return one.unionByName(more.groupBy(key).agg(F.collect_list("_t").alias("texts")))


def _counted(texts: list) -> Counter:
    """How often the texts of a key have each feature."""
    c: Counter = Counter()
    for t in texts:
        if t is not None:
            toks, s = T.words_dual(t), T.squeezed_text(t)
            c.update(["w:" + x for x in toks])
            c.update(["b:" + x + "_" + y for x, y in zip(toks, toks[1:], strict=False)])
            for k in (3, 4, 5):
                c.update(["c:" + s[i : i + k] for i in range(len(s) - k + 1) if s[i] != " " and s[i + k - 1] != " "])
    return c


def features(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, feature, tf)``: words and pairs of words by 1, character n-grams by 0.2."""
    src = _gathered(df, key, text)

    def work(batches):
        for b in batches:
            for i in range(b.num_rows):
                c = list(_counted(b.column(1)[i].as_py()).items())
                for j in range(0, len(c), GIVEN):
                    part = c[j : j + GIVEN]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(part), pa.int64())), pa.array([f for f, _ in part], pa.string()), pa.array([n * 0.2 if f[0] == "c" else n * 1.0 for f, n in part], pa.float64())], names=["_k", "feature", "tf"])

    return src.mapInArrow(work, f"_k {src.schema[key].dataType.simpleString()}, feature string, tf double").withColumnRenamed("_k", key)


def feature_kinds(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(kind, features, pairs, weight)``: how many :func:`features` there are of a kind, in how many
    pairs with a key, and their weight. Tasks count features over many texts before anything is shuffled."""

    def given(pairs, n):
        names = list(pairs)
        for j in range(0, len(names), GIVEN):
            part = names[j : j + GIVEN]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([pairs[f] for f in part], pa.int64()), pa.array([n[f] for f in part], pa.int64())], names=["feature", "pairs", "n"])

    def work(batches):
        pairs, n = Counter(), Counter()
        for b in batches:
            for texts in b.column(0):
                c = _counted(texts.as_py())
                pairs.update(c.keys())
                n.update(c)
                if len(n) > HELD:
                    yield from given(pairs, n)
                    pairs, n = Counter(), Counter()
        yield from given(pairs, n)

    each = _gathered(df, key, text).select("texts").mapInArrow(work, "feature string, pairs bigint, n bigint").groupBy("feature").agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("n"))
    kinds = each.groupBy(F.substring("feature", 1, 1).alias("kind")).agg(F.count("*").alias("features"), F.sum("pairs").alias("pairs"), F.sum("n").alias("n"))
    return kinds.select("kind", "features", "pairs", F.round(F.when(F.col("kind") == "c", F.col("n") * 0.2).otherwise(F.col("n") * 1.0), 3).alias("weight"))


_hashes: dict[str, int] = {}


def _hash(feature: str) -> int:
    h = _hashes.get(feature)
    if h is None:
        if len(_hashes) > 1_000_000:
            _hashes.clear()
        h = _hashes[feature] = int(hashlib.md5(feature.encode(), usedforsecurity=False).hexdigest()[:15], 16)
    return h


def features_of(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashes (60 bits) and weights of the :func:`features` of one text, and the number of its words."""
    toks = T.words_dual(text)
    s = T.squeezed_text(text)
    c = Counter(["w:" + t for t in toks])
    c.update(["b:" + a + "_" + b for a, b in zip(toks, toks[1:], strict=False)])
    n = len(c)
    g = Counter([s[i : i + k] for k in (3, 4, 5) for i in range(len(s) - k + 1) if s[i] != " " and s[i + k - 1] != " "])
    h = np.fromiter([*map(_hash, c), *[_hash("c:" + x) for x in g]], np.int64, n + len(g))
    tf = np.fromiter([*c.values(), *g.values()], np.float64, len(h))
    tf[n:] *= 0.2
    return h, tf, len(toks)


def feature_counts(chunks: DataFrame) -> DataFrame:
    """``(h, n)``: in how many passages each feature is; h = -1 counts the passages with words, h = -2
    their words. Counted in each task before anything is shuffled."""

    def work(batches):
        for b in batches:
            found, size, words = [], 0, 0
            for t in b.column(0).to_pylist():
                h, _, n = features_of(t) if t else (None, None, 0)
                if n:
                    found.append(h)
                    size, words = size + 1, words + n
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[h, -1, -2].astype(np.int64)), pa.array(np.r_[n, size, words].astype(np.int64))], names=["h", "n"])

    return chunks.select(F.col("text").cast("string")).mapInArrow(work, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


class Frequencies:
    """Of features: the number of passages with each; those that are not listed have one."""

    def __init__(self, counts: DataFrame, own: np.ndarray, most: int = MOST_FEATURES):
        """``counts`` of :func:`feature_counts`; ``own`` are hashes of questions, whose counts are exact.
        With more than ``most`` features, passages get theirs by a join (``joined``)."""
        few = counts.where("h < 0").collect()
        self.n = next((r["n"] for r in few if r["h"] == -1), 0)
        self.avg = next((r["n"] for r in few if r["h"] == -2), 0) / max(1, self.n)
        many = counts.where("h >= 0 and n > 1")
        self.joined = many.count() > most
        if not self.joined:
            t = many.orderBy("h").toArrow()
            self.h, self.df = t.column("h").to_numpy(), t.column("n").to_numpy().astype(np.float64)
        asked = counts.sparkSession.createDataFrame([(int(h),) for h in np.unique(own)], "h bigint")
        self.own = {r["h"]: r["n"] for r in counts.join(F.broadcast(asked), "h").collect()}

    def idf(self, df: np.ndarray) -> np.ndarray:
        return np.log1p((self.n - df + 0.5) / (df + 0.5))

    def of_passages(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.h, h), max(len(self.h) - 1, 0))
        return self.idf(np.where(self.h[at] == h, self.df[at], 1.0)) if len(self.h) else self.idf(np.ones(len(h)))

    def of_questions(self, h: np.ndarray) -> np.ndarray:
        return self.idf(np.array([float(self.own.get(int(x), 0)) for x in h]))


def joined_vectors(chunks: DataFrame, counts: DataFrame, n: int, dims: int = DIMS) -> DataFrame:
    """``(chunk_id, text, vec)``: the passages with their hashed vectors as (place, value), by a join of
    their features with the counts of all features."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            found = [features_of(t)[:2] if t else (np.empty(0, np.int64), np.empty(0)) for t in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(h) for h, _ in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.concatenate([h for h, _ in found])), pa.array(np.concatenate([t for _, t in found]))], names=["chunk_id", "h", "tf"])

    x = chunks.select("chunk_id", F.col("text").cast("string")).mapInArrow(work, f"chunk_id {kind}, h bigint, tf double").join(counts, "h")
    idf = F.log1p((n - F.col("n") + 0.5) / (F.col("n") + 0.5))
    x = x.groupBy("chunk_id", (F.col("h") % dims).cast("int").alias("idx")).agg(F.sum(F.when(F.shiftright("h", 59) == 1, -1.0).otherwise(1.0) * (1 + F.log("tf")) * idf).alias("v"))
    return chunks.select("chunk_id", "text").join(x.groupBy("chunk_id").agg(F.collect_list(F.struct("idx", "v")).alias("vec")), "chunk_id")


def hashed_vector(h: np.ndarray, tf: np.ndarray, idf: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """The unit vector of signed hashed TF-IDF. A weight under 1/e makes the factor of its feature negative."""
    v = np.bincount(h % dims, np.where(h >> 59, -1.0, 1.0) * (1 + np.log(tf)) * idf, dims)
    norm = np.sqrt((v * v).sum())
    return v / norm if norm else v


def phrase_runs(words: list[str], n: int) -> list[str]:
    """The runs of n words, repeated ones too."""
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


#: What runs of so many words of the question are worth in a text, the whole question, and all of it at most.
RUNS, WHOLE, MOST_PHRASE, FOCUS = {4: 0.08, 3: 0.05, 2: 0.02}, 0.60, 0.45, 2.0


class Bonuses:
    """Phrase and focus bonuses of a block of questions: all their phrases are found in one pass over a text."""

    def __init__(self, questions: list[str]):
        import ahocorasick

        self.phrases: dict[str, int] = {}
        number = lambda p: self.phrases.setdefault(p, len(self.phrases))
        runs, focus = [], []
        for j, q in enumerate(questions):
            low = T.fold_text(q.lower())
            words = T.words_folded(q)
            if low:
                runs.append((number(low), j, WHOLE))
            for n, w in RUNS.items():
                runs += [(number(p), j, w) for p in phrase_runs(words, n)]
            focus += [(number(p), j, FOCUS) for p in lexicon.FOCUS if p in low]
        self.run, self.focus = (np.zeros((max(1, len(self.phrases)), len(questions))) for _ in range(2))
        for m, x in ((self.run, runs), (self.focus, focus)):
            for i, j, w in x:
                m[i, j] += w
        self.automaton = ahocorasick.Automaton()
        for p, i in self.phrases.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Phrase bonus and focus bonus of every question."""
        hit = sorted({i for _, i in self.automaton.iter(T.fold_text(text.lower()))}) if self.phrases else []
        return np.round(np.minimum(self.run[hit].sum(axis=0), MOST_PHRASE), 6), self.focus[hit].sum(axis=0)


def bonuses(ranked: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, phrase, focus)`` of pairs with ``question`` and ``text``: built-in functions,
    for few pairs. 0.60 for the whole question in the text, 0.08, 0.05 and 0.02 for each of its runs of 4,
    3 and 2 words, 0.45 at most; 2 for each phrase of focus in both."""
    x = ranked.select("query_id", "chunk_id", T.fold(F.lower("question")).alias("q"), T.tokens_folded(F.col("question")).alias("w"), T.fold(F.lower("text")).alias("t"))
    total = F.when((F.col("q") != "") & F.contains("t", "q"), WHOLE).otherwise(0.0)

    def run(n: int):
        return lambda i: F.array_join(F.slice("w", i, F.lit(n)), " ")

    for n, w in RUNS.items():
        runs = F.when(F.size("w") < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), run(n)))
        total = total + F.size(F.filter(runs, lambda r: F.contains(F.col("t"), r))) * w
    focus = sum((F.when(F.contains("q", F.lit(p)) & F.contains("t", F.lit(p)), FOCUS).otherwise(0.0) for p in lexicon.FOCUS), F.lit(0.0))
    return x.select("query_id", "chunk_id", F.round(F.least(total, F.lit(MOST_PHRASE)), 6).alias("phrase"), focus.alias("focus"))


def score_rows(chunks: DataFrame, block: list[list[tuple[str, float]]], freq: Frequencies, first: list[str], dims: int = DIMS) -> DataFrame:
    """``(chunk_id, kw, sem, phrase, focus)``: of every passage with words the scores for all questions of
    the block as arrays. A question is a list of variants with weights; the best weighted variant counts.
    ``kw`` is NaN where no term is shared."""
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    flat = [(q, w) for variants in block for q, w in variants]
    of = np.repeat(np.arange(len(block)), [len(v) for v in block])
    starts = np.searchsorted(of, np.arange(len(block)))
    weight = np.array([w for _, w in flat])
    counts = [Counter(T.words_dual(q)) for q, _ in flat]
    terms = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    asked = np.zeros((len(terms), len(flat)))
    for j, c in enumerate(counts):
        for t, n in c.items():
            asked[terms[t], j] = n
    idf = freq.of_questions(np.array([_hash("w:" + t) for t in terms], np.int64))
    vectors = []
    for q, _ in flat:
        h, tf, _ = features_of(q)
        vectors.append(hashed_vector(h, tf, freq.of_questions(h), dims))
    vectors = np.array(vectors).T

    def work(batches):
        bonus = Bonuses(first)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                given = b.column(2) if b.num_columns > 2 else None
                keep, dl, row, ids, tfs, vecs, phrase, focus = [], [], [], [], [], [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    h, tf, n = features_of(t) if t else (None, None, 0)
                    if not n:
                        continue
                    c = Counter(map(terms.get, T.words_dual(t)))
                    c.pop(None, None)
                    row += [len(keep)] * len(c)
                    ids += c.keys()
                    tfs += c.values()
                    keep.append(i)
                    dl.append(n)
                    if given is None:
                        vecs.append(hashed_vector(h, tf, freq.of_passages(h), dims))
                    else:
                        x = np.zeros(dims)
                        for y in given[i].as_py():
                            x[y["idx"]] = y["v"]
                        vecs.append(x / (np.sqrt((x * x).sum()) or 1.0))
                    p, f = bonus(t)
                    phrase.append(p)
                    focus.append(f)
                if not keep:
                    continue
                kw = np.round(_gains(np.array(dl, float), np.array(row, int), np.array(ids, int), np.array(tfs, float), idf, freq.avg) @ asked, 6) * weight
                sem = np.round(np.array(vecs) @ vectors, 6) * weight
                kw, sem = (np.maximum(0, np.maximum.reduceat(x, starts, axis=1)) for x in (kw, sem))
                kw[kw == 0] = np.nan
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), *(_lists(list(x), np.float64) for x in (kw, sem, phrase, focus))], names=["chunk_id", "kw", "sem", "phrase", "focus"])

    more = ["vec"] if "vec" in chunks.columns else []
    return chunks.select("chunk_id", F.col("text").cast("string"), *more).mapInArrow(work, f"chunk_id {kind}, kw array<double>, sem array<double>, phrase array<double>, focus array<double>")


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _bounds(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """Least and greatest score of each question, NaN left aside: from the bounds that each task gives."""

    def work(batches):
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0))
                lo, hi = np.where(np.isnan(m), np.inf, m).min(axis=0), np.where(np.isnan(m), -np.inf, m).max(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(m.shape[1])), pa.array(lo), pa.array(hi)], names=["j", "lo", "hi"])

    out = np.tile([np.inf, -np.inf], (n, 1))
    for r in rows.select(column).mapInArrow(work, "j bigint, lo double, hi double").groupBy("j").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect():
        out[r["j"]] = r["lo"], r["hi"]
    return out


def _scaled(m: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Scores to 0..1 between the bounds; 1 where both are equal, 0 for NaN."""
    lo, hi = bounds[:, 0], bounds[:, 1]
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.where(hi == lo, 1.0, (m - lo) / (hi - lo))
    return np.where(np.isnan(m), 0.0, x)


def _best_rows(rows: DataFrame, names: np.ndarray, schema: str, k: int, score) -> DataFrame:
    """The best k passages of each question in every batch, with the columns that ``score`` gives: a
    function of a batch to matrices, the first of which ranks."""
    fields = [x.split()[0] for x in schema.split(", ")]

    def work(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = score(b)
            keys = np.asarray(b.column(0))
            order = np.lexsort((np.broadcast_to(keys, x[0].T.shape), -x[0].T), axis=1)[:, :k]
            j = np.repeat(np.arange(len(names)), order.shape[1])
            i = order.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(names[j]), pa.array(keys[i], b.column(0).type), *(pa.array(m[i, j]) for m in x)], names=fields)

    return rows.mapInArrow(work, schema)


def sparse(chunks: DataFrame, questions: DataFrame, k: int = 5, dims: int = DIMS, most: int = MOST_FEATURES) -> DataFrame:
    """``(query_id, rank, chunk_id, score)``: the best passages by cosine of hashed vectors, 0 at least."""
    return _hybrid(chunks, questions.select("query_id", "question", F.lit(1.0).alias("weight"), F.lit("original").alias("variant")), questions, k, lambda kw, sem: lambda b: [_matrix(b.column(2))], "", dims, most).select("query_id", "rank", "chunk_id", "score")


def fused(chunks: DataFrame, questions: DataFrame, k: int = 30, weights: tuple = (0.45, 0.55), dims: int = DIMS) -> DataFrame:
    """``(query_id, rank, chunk_id, score, keyword, semantic, phrase, focus)``: the first candidates. BM25
    and cosine over all variants of the question, fused after minmax, plus the bonuses; every passage
    gets its bonuses before the cut."""

    def score(kw, sem):
        def of(b):
            x, y, p, f = _scaled(_matrix(b.column(1)), kw), _scaled(_matrix(b.column(2)), sem), _matrix(b.column(3)), _matrix(b.column(4))
            return [np.round(x * weights[0] + y * weights[1] + p + f, 6), np.round(x, 6), np.round(y, 6), p, f]

        return of

    return _hybrid(chunks, rewrites(questions), questions, k, score, ", keyword double, semantic double, phrase double, focus double", dims)


def _hybrid(chunks: DataFrame, variants: DataFrame, questions: DataFrame, k: int, score, more: str, dims: int, most: int = MOST_FEATURES) -> DataFrame:
    v = variants.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("variant", "question", "weight"))).alias("v"))  # four a question
    asked = questions.select("query_id", "question").join(v, "query_id").where("question is not null")
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    schema = f"query_id {questions.schema['query_id'].dataType.simpleString()}, chunk_id {kind}, score double{more}"
    counts = cut(feature_counts(chunks))
    parts = []
    for block in _blocks(asked, BLOCK // 4, "question", "v"):
        texts = [[(x["question"], x["weight"]) for x in r["v"]] for r in block]
        own = np.concatenate([features_of(q)[0] for x in texts for q, _ in x])
        freq = Frequencies(counts, own, most)
        source = joined_vectors(chunks, counts, freq.n, dims) if freq.joined else chunks.select("chunk_id", "text")
        rows = cut(score_rows(source, texts, freq, [r["question"] for r in block], dims))
        kw, sem = (_bounds(rows, c, len(block)) for c in ("kw", "sem"))
        parts.append(_best_rows(rows, np.array([r["query_id"] for r in block]), schema, k, score(kw, sem)))
    return top_k(_union(parts, chunks.sparkSession, schema), k)


def hybrid(chunks: DataFrame, questions: DataFrame, candidates: int = 30, k: int = 6) -> DataFrame:
    """``(query_id, rank, chunk_id, score, first)``: the candidates of :func:`fused`, ranked again with
    coverage, density and the bonuses once more."""
    x = cut(fused(chunks, questions, candidates).drop("rank").withColumnRenamed("score", "first"))
    terms = lambda c: F.array_distinct(T.tokens_dual(F.col(c)))
    x = sized_join(chunks.select("chunk_id", terms("text").alias("_t")), x, ["chunk_id"]).join(questions.select("query_id", terms("question").alias("_q")), "query_id")
    common = F.size(F.array_intersect("_q", "_t"))
    x = x.withColumn("score", F.round(F.col("first") + 0.25 * common / F.greatest(F.size("_q"), F.lit(1)) + 0.10 * common / F.greatest(F.size("_t"), F.lit(1)) + F.col("phrase") + F.col("focus"), 6))
    return top_k(x, k).select("query_id", "rank", "chunk_id", "score", "first")


def question_vectors(chunks: DataFrame, questions: DataFrame, dims: int = DIMS) -> DataFrame:
    """``(query_id, idx, val)``: the hashed vectors of the questions, by the frequencies of the passages."""
    counts = cut(feature_counts(chunks))
    parts = []
    for block in _blocks(questions):
        found = [(r["query_id"], *features_of(r["question"] or "")[:2]) for r in block]
        freq = Frequencies(counts, np.concatenate([h for _, h, _ in found]))
        rows = []
        for q, h, tf in found:
            v = hashed_vector(h, tf, freq.of_questions(h), dims)
            rows += [(q, int(i), float(v[i])) for i in np.flatnonzero(np.abs(v) > 1e-12)]
        parts.append(chunks.sparkSession.createDataFrame(rows, "query_id bigint, idx bigint, val double"))
    return _union(parts, chunks.sparkSession, "query_id bigint, idx bigint, val double")


def dense(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5) -> DataFrame:
    """``(query_id, rank, key, score)``: exact inner product of unit vectors. Queries go in blocks of a
    few thousand to every task, which multiplies matrices and keeps k rows a query; only these are
    shuffled."""
    out = None
    kind = vectors.schema[key].dataType.simpleString()
    rows = queries.select("query_id", F.col(vector).alias("v"))
    block = 4096
    for part in range(max(1, -(-rows.count() // block))):
        mine = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-rows.count() // block)))) == part).collect()
        ids = np.array([r["query_id"] for r in mine], np.int64)
        q = np.array([r["v"] for r in mine], np.float64)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)

        def work(batches, q=q, ids=ids):
            for b in batches:
                if not b.num_rows:
                    continue
                m = np.array(b.column(1).to_pylist(), np.float64)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                s = np.round(q @ m.T, 6)
                n = min(k, s.shape[1])
                keys = np.array(b.column(0).to_pylist())
                order = np.lexsort((np.broadcast_to(keys, s.shape), -s), axis=1)[:, :n]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat(ids, n)), key: pa.array(keys[order].ravel(), b.column(0).type), "score": pa.array(np.take_along_axis(s, order, 1).ravel())})

        got = vectors.select(key, vector).where(F.col(vector).isNotNull()).mapInArrow(work, f"query_id bigint, {key} {kind}, score double")
        out = got if out is None else out.unionByName(got)
    return top_k(out, k, tie=key).select("query_id", "rank", key, "score")
