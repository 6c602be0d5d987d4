"""Problem 7: groups of records that share most of their content.

Anchor-point covering over min-hash fingerprints. A fingerprint is a vector of :data:`SYMBOLS`
min-hash values of the record's word triples, and the distance of two fingerprints is the number of
places in which they differ. The covering code is a fixed family of masks, each a set of places; the
anchors of a fingerprint are the words that it reads under the masks. Two fingerprints whose distance
is within the threshold agree under some mask, so they are replicated to a common anchor; with masks
of ``ROWS`` places of ``SYMBOLS`` the chance that a pair of similarity s shares no anchor is
(1 - s^ROWS)^MASKS: 9e-5 at 0.5, 2e-9 at 0.6. Pairs that meet at an anchor, whose sketches (a bit of
each value) are not far apart and whose numbers of triples allow the similarity, are compared exactly,
on the whole sets of triples. The masks are taken in rounds, so that the anchors of only one round are
on disk at a time, and pairs are compared in slices. Anchors are shuffled in packed pieces without
their sketches, which only those get that more than one record has.

Exact copies (same words) are one class with one representative, so they never meet at an anchor; the
pairs of ``pairs`` are expanded from the classes, those of ``classes`` are not.

Binary fingerprints in Hamming space, the usual ground of covering codes, were left: at similarity
one half their distance is a quarter of all bits, and every anchor would be within reach of all.

Cases: null, short texts and texts of under three words have no fingerprint and no pair; rows given
twice count once; ties go to the smaller id; extra columns are ignored.
"""

from __future__ import annotations

import gc
import re
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut, drop, once, sized_join
from .forms import canonical_form
from .quality import MARKS

#: Places of a mask, masks, least similarity, least characters of a text.
ROWS, MASKS, LEAST, LEAST_CHARS, SHINGLE = 4, 144, 0.5, 200, 3
SYMBOLS = ROWS * MASKS
#: Masks of a round.
ROUND = 24
#: Pairs compared at once, or as many as there are records in pairs if that is more: with each pair
#: the set of one record is on disk while it is joined with that of the other.
PAIRS = 20_000
#: Bits of the sketch, and the distance beyond which a pair is not compared: the distance of a pair of
#: similarity 0.5 is binomial with mean 128, so 5e-6 of them are farther; nearly all unlike pairs are.
SKETCH, FAR = 512, 172
#: Anchors of a partition in which equal ones are looked for.
ANCHORS = 500_000
PARTS = [f"s{j + 1}" for j in range(SKETCH // 64)]
_word = re.compile(f"[\\w{MARKS}]+")
_MIX, _S29, _S30, _S32 = np.uint64(0x9E3779B97F4A7C15), np.uint64(29), np.uint64(30), np.uint64(32)


def _coefficients(n: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 32, n, dtype=np.uint32) | np.uint32(1)


def word_list(text: str) -> list[str]:
    return _word.findall(canonical_form(text).replace("_", " "))


_hashes: dict[str, int] = {}
#: Words whose hash a worker remembers; the memory only saves time.
MEMORY = 500_000


def _word_hashes(words: list[str]) -> np.ndarray:
    ids = list(map(_hashes.get, words))
    if None in ids:
        if len(_hashes) > MEMORY:
            _hashes.clear()
        for i, h in enumerate(ids):
            if h is None:
                ids[i] = _hashes[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    return np.array(ids, np.uint64)


def shingles(words: list[str], k: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of all runs of k words, sorted."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    ids = _word_hashes(words)
    h = ids[:n].copy()
    for j in range(1, k):
        h ^= h >> _S29
        h *= _MIX
        h += ids[j : n + j]
    h ^= h >> _S32
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def anchors(h: np.ndarray, a: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """One 32-bit word a mask, of the min-hash values at its places; and a bit of each of the first
    512 values as eight words, a sketch whose Hamming distance tells far pairs apart cheaply. The
    shingles are hashed already, so a value is the least product with an odd number of its own."""
    low = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    h = (h >> _S32).astype(np.uint32)
    room = np.empty((min(64, len(h)), len(a)), np.uint32)  # a piece that stays in the cache, whatever the length of the text
    for k in range(0, len(h), 64):
        part = h[k : k + 64, None]
        np.minimum(low, np.minimum.reduce(np.multiply(part, a, out=room[: len(part)]), axis=0), out=low)
    out = low.reshape(-1, rows)
    key = np.arange(1, len(out) + 1, dtype=np.uint64) * _MIX
    for j in range(rows):
        key = (key ^ (key >> _S30) ^ out[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
    bits = np.zeros(SKETCH, np.uint8)
    some = low[:SKETCH]
    some = ((some ^ (some >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(31)
    bits[: len(some)] = some
    return (key >> _S32).astype(np.uint32), np.packbits(bits).view(np.uint64)


def fingerprints(df: DataFrame, key: str, text: str, masks: int = MASKS, rows: int = ROWS, least_chars: int = LEAST_CHARS, k: int = SHINGLE) -> DataFrame:
    """``(key, w1, w2, n, s1, .. s8, anchors0, ..)``: 128 bits of the word list, the number of triples, the
    sketch, the anchors by round, so that a round reads its own only."""
    rounds = [(y, min(y + ROUND, masks)) for y in range(0, masks, ROUND)]
    names = [f"anchors{i}" for i in range(len(rounds))]
    src = df.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")).where((F.length("_t") >= least_chars) & F.col("_k").isNotNull())

    def work(batches):
        a = _coefficients(masks * rows)
        for batch in batches:
            at, w1, w2, n, found, sketch = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                words = word_list(t)
                if len(words) < k:
                    continue
                d = xxhash.xxh3_128_intdigest(" ".join(words))
                at.append(i)
                w1.append(d >> 64)
                w2.append(d & (1 << 64) - 1)
                h = shingles(words, k)
                n.append(len(h))
                key_words, bits = anchors(h, a, rows)
                found.append(key_words)
                sketch.append(bits)
            flat = np.array(found, np.uint32).view(np.int32).reshape(len(at), masks)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * (z - y)), pa.array(flat[:, y:z].ravel())) for y, z in rounds]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(np.array(w1, np.uint64).view(np.int64)), pa.array(np.array(w2, np.uint64).view(np.int64)), pa.array(n, pa.int32()), *(pa.array(np.ascontiguousarray(np.array(sketch, np.uint64).reshape(-1, len(PARTS))[:, j]).view(np.int64)) for j in range(len(PARTS))), *lists], names=["_k", "w1", "w2", "n", *PARTS, *names])

    kind = src.schema["_k"].dataType.simpleString()
    return src.mapInArrow(work, f"_k {kind}, w1 bigint, w2 bigint, n int, {", ".join(f"{s} bigint" for s in PARTS)}, {", ".join(f"{s} array<int>" for s in names)}").withColumnRenamed("_k", key)


def triple_sets(df: DataFrame, key: str, text: str, k: int = SHINGLE) -> DataFrame:
    """``(key, h)``: the sorted distinct shingle hashes as bytes."""
    src = df.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))

    def work(batches):
        for batch in batches:
            sets = [shingles(word_list(t), k).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["_k", "h"])

    kind = src.schema["_k"].dataType.simpleString()
    return src.mapInArrow(work, f"_k {kind}, h binary").withColumnRenamed("_k", key)


def _repeated(at: DataFrame, parts: int = 1) -> DataFrame:
    """The rows ``(anchor, rep)``, each once, whose anchor has more than one. ``anchor`` may also be
    a list, of a word for each mask. The rows are shuffled once only, whatever the number of such
    anchors, packed into one piece for each of ``parts`` partitions, so that the JVM neither holds
    them as rows nor sorts them."""
    kind = at.schema["rep"].dataType
    schema = pa.schema([("anchor", pa.int64()), ("rep", to_arrow_type(kind))])

    def pack(batches):
        for b in batches:
            anchor, rep = b.column(0), b.column(1)
            if pa.types.is_list(anchor.type):
                n = anchor.value_lengths().to_numpy()
                mask = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                anchor, of = (mask << 32) + anchor.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
            else:
                anchor, of = anchor.to_numpy(), np.arange(len(anchor))
            if not len(of):
                continue
            part = ((anchor.view(np.uint64) * _MIX) >> _S32) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            table = pa.RecordBatch.from_arrays([pa.array(anchor[order]), rep.take(pa.array(of[order])).cast(schema.field("rep").type)], schema=schema)
            to, start = np.unique(part[order], return_index=True)
            pieces = [table.slice(i, j - i).serialize() for i, j in zip(start, [*start[1:], len(order)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array([x.to_pybytes() for x in pieces], pa.binary())], names=["part", "rows"])

    def work(batches):
        pieces = [pa.ipc.read_record_batch(x.as_buffer(), schema) for b in batches for x in b.column(1)]
        if not pieces:
            return
        table = pa.Table.from_batches(pieces)
        found = table.filter(pa.array(_shared(table.column(0).to_numpy())))
        found = found.group_by(["anchor", "rep"], use_threads=False).aggregate([]).select(["anchor", "rep"])  # rows given twice
        yield from found.filter(pa.array(_shared(found.column(0).to_numpy()))).combine_chunks().to_batches(50_000)

    packed = at.select("anchor", "rep").mapInArrow(pack, "part int, rows binary")
    return packed.repartitionById(parts, F.col("part")).mapInArrow(work, f"anchor bigint, rep {kind.simpleString()}")


def _shared(x: np.ndarray) -> np.ndarray:
    """Of each value, whether it stands more than once."""
    order = np.argsort(x)
    like = x[order[1:]] == x[order[:-1]]
    out = np.zeros(len(x), bool)
    out[order[1:][like]] = out[order[:-1][like]] = True
    return out


def _meeting(prints: DataFrame, copies: DataFrame, column: str, records: int, least: float) -> DataFrame:
    """``(rep_a, rep_b)``: representatives that meet at an anchor of this round, are not far apart and
    have sets of sizes at which ``least`` is possible."""
    at = sized_join(prints.select("_id", F.col(column).alias("anchor")), copies, ["_id"], "left_anti", 2_000_000)
    marks = prints.select(F.col("_id").alias("rep"), "n", *PARTS)
    full = _cut(_repeated(at.withColumnRenamed("_id", "rep"), -(-max(1, records) * ROUND // ANCHORS)).join(marks, "rep"))
    side = lambda x: full.select("anchor", F.col("rep").alias(f"rep_{x}"), *[F.col(s).alias(f"{x}{s}") for s in ("n", *PARTS)])
    far = sum((F.bit_count(F.col(f"a{s}").bitwiseXOR(F.col(f"b{s}"))) for s in PARTS), F.lit(0))
    near = (F.col("rep_a") < F.col("rep_b")) & (F.least("an", "bn") / F.greatest("an", "bn") >= least) & (far <= FAR)
    met = _cut(side("a").join(side("b"), "anchor").where(near).select("rep_a", "rep_b").distinct())
    drop(full)
    return met


def _cut(df: DataFrame) -> DataFrame:
    """:func:`~tessella.session.cut`, after which the shuffle files that it took go at once, not when
    the driver happens to collect its garbage."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(name, None)
    conf.set(name, "true")
    try:
        return cut(df)
    finally:
        conf.set(name, was) if was is not None else conf.unset(name)


def _free(spark) -> None:
    """Let Spark drop the shuffle files of finished rounds now, not when the driver's heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def similar_classes(df: DataFrame, key: str, text: str, least: float = LEAST, pairs_at_once: int = PAIRS, **how) -> tuple[DataFrame, DataFrame]:
    """``(links, members)``: links ``(rep_a, rep_b, similarity)`` between representatives of classes
    of equal word lists, and members ``(key, rep)`` of every class."""
    k = how.get("k", SHINGLE)
    prints = _cut(fingerprints(df, key, text, **how).withColumnRenamed(key, "_id"))
    words = prints.select("_id", "w1", "w2").distinct()
    reps = words.groupBy("w1", "w2").agg(F.min("_id").alias("rep"))
    members = _cut(words.join(reps, ["w1", "w2"]).select(F.col("_id").alias(key), "rep"))
    copies = _cut(members.where(F.col(key) != F.col("rep")).select(F.col(key).alias("_id")))
    rounds, records = [], prints.count()
    for column in [c for c in prints.columns if c.startswith("anchors")]:
        rounds.append(_meeting(prints, copies, column, records, least))
        _free(df.sparkSession)
    candidates = _cut(reduce(DataFrame.unionByName, rounds).distinct())
    drop(prints, copies, *rounds)
    _free(df.sparkSession)
    ids = _cut(candidates.select(F.explode(F.array("rep_a", "rep_b")).alias("_id")).distinct())
    texts = df.select(F.col(key).alias("_id"), F.col(text).alias("_t")).where(F.length("_t") >= how.get("least_chars", LEAST_CHARS))
    sets = _cut(triple_sets(sized_join(once(texts, "_id"), ids, ["_id"], "left_semi", 2_000_000), "_id", "_t", k))
    at_once = max(pairs_at_once, ids.count())
    drop(ids)
    _free(df.sparkSession)

    def compare(batches):
        for b in batches:
            s = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                s.append(common / max(1, len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], names=["rep_a", "rep_b", "similarity"])

    kind = candidates.schema["rep_a"].dataType.simpleString()
    links, slices = [], -(-max(1, candidates.count()) // at_once)
    for i in range(slices):  # all pairs, a slice at a time, so that the sets of only one are shuffled
        own = lambda c, i=i: F.pmod(F.xxhash64(c), F.lit(slices)) == i
        some = candidates.where(own("rep_a"))
        ha = sets.where(own("_id")).select(F.col("_id").alias("rep_a"), F.col("h").alias("ha"))
        hb = sized_join(sets, some.select(F.col("rep_b").alias("_id")).distinct(), ["_id"], "left_semi", 2_000_000) if slices > 1 else sets
        pairs = some.join(ha, "rep_a").join(hb.select(F.col("_id").alias("rep_b"), F.col("h").alias("hb")), "rep_b")
        links.append(_cut(pairs.select("rep_a", "rep_b", "ha", "hb").mapInArrow(compare, f"rep_a {kind}, rep_b {kind}, similarity double").where(F.col("similarity") >= least)))
        _free(df.sparkSession)
    drop(candidates, sets)
    return reduce(DataFrame.unionByName, links), members


def similar_pairs(df: DataFrame, key: str, text: str, **how) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``: all pairs of similar records, copies included."""
    links, members = similar_classes(df, key, text, **how)
    a, b = members.select(F.col(key).alias("x"), F.col("rep").alias("rep_a")), members.select(F.col(key).alias("y"), F.col("rep").alias("rep_b"))
    between = links.join(a, "rep_a").join(b, "rep_b").select("x", "y")
    large = members.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1").select("rep")
    own = members.join(large, "rep")
    within = own.select("rep", F.col(key).alias("x")).join(own.select("rep", F.col(key).alias("y")), "rep").where("x < y").select("x", "y")
    return between.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def connected(both: DataFrame) -> DataFrame:
    """``(u, g)``: the smallest node that each node of the links ``(u, v)``, given both ways, is linked
    to over any number of links: minimum labels, with the labels of labels, until nothing changes."""
    label = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("g")))
    while True:  # labels only fall, so this ends
        near = both.join(label.select(F.col("u").alias("v"), F.col("g").alias("gv")), "v").groupBy("u").agg(F.min("gv").alias("gn"))
        step = label.join(near, "u").select("u", F.least("g", "gn").alias("g"))
        jump = step.alias("s").join(label.select(F.col("u").alias("g"), F.col("g").alias("gg")), "g", "left").select("u", F.coalesce(F.least("g", "gg"), F.col("g")).alias("g"))
        new = cut(jump)
        changed = new.join(label.withColumnRenamed("g", "old"), "u").where("g <> old").limit(1).count()
        label = new
        if not changed:
            return label


def similar_groups(df: DataFrame, key: str, text: str, **how) -> DataFrame:
    """``(key, group_id, links)``: one row a record with a fingerprint; the group is the smallest id
    that it is linked to over any number of links, links counts the classes linked to its own."""
    links, members = similar_classes(df, key, text, **how)
    links = cut(links.select("rep_a", "rep_b"))
    both = links.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v")).unionByName(links.select(F.col("rep_b").alias("u"), F.col("rep_a").alias("v")))
    label = connected(both)
    degree = both.groupBy("u").agg(F.count("*").alias("links"))
    out = members.join(label.join(degree, "u").withColumnRenamed("u", "rep"), "rep", "left")
    return out.select(key, F.coalesce("g", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
