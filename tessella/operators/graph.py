"""Entities, co-occurrence, communities and graph retrieval."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from ..session import BROADCAST_ROWS, cut, sized_join
from .retrieval import minmax, top_k

PER_UNIT, PER_EDGE, ROUNDS = 12, 10, 12
#: Edges of a graph that one task walks through at most, in the sequential mode of communities.
MOST_EDGES = 5_000_000


def mentions(x: Column) -> Column:
    """Candidate entities of a text: references of law, abbreviations, domain phrases and capitalised
    phrases of 4 to 90 characters; one mention may be found by several."""
    low = T.fold(F.lower(x))
    found = lambda p: F.regexp_extract_all(x, F.lit(p), F.lit(0))
    domain = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(T.folded(p))), F.lit(p)) for p in lexicon.DOMAIN]))
    capital = F.filter(F.transform(found(lexicon.CAPITALISED), T.clean_text), lambda p: F.length(p).between(4, 90))
    return F.concat(found(lexicon.LEGAL_ENTITY), found(lexicon.ABBREVIATION), domain, capital)


def entity_key(x: Column) -> Column:
    return T.fold(F.lower(F.regexp_replace(T.strip(F.regexp_replace(T.clean_text(x), r"[,:;.!?()\[\]{}]+$", "")), f"{T.BLANK}+", " ")))


def entities(df: DataFrame, unit: str, text: str, most: int = 18) -> DataFrame:
    """``(unit, key, name, n, rank)``: the most frequent entities of every unit, by count, then key. Left
    out are stop keys, keys of under 3 characters or over 12 words, single words that are no abbreviation,
    reference or domain phrase, and phrases in capitals without accents."""
    x = df.select(unit, F.posexplode(mentions(F.col(text))).alias("pos", "surface"))
    x = x.withColumn("surface", F.regexp_replace(F.regexp_replace("surface", f"{T.BLANK}+", " "), r"^[ \-:;,.]+|[ \-:;,.]+$", ""))
    x = x.withColumn("key", entity_key(F.col("surface"))).withColumn("_t", F.size(T.tokens(F.col("surface"))))
    whole = lambda p: F.col("surface").rlike(p.replace(")", ")^(?:", 1) + ")$")
    legal, short, domain = whole(lexicon.LEGAL_ENTITY), whole(lexicon.ABBREVIATION), F.col("key").isin([T.folded(p) for p in lexicon.DOMAIN])
    noise = (F.upper("surface") == F.col("surface")) & F.contains("surface", F.lit(" ")) & ~F.col("surface").rlike("[À-ỹĐ]")
    ok = (F.length("key") >= 3) & ~F.col("key").isin(lexicon.STOP_KEYS) & (F.col("_t") <= 12) & ~(noise & ~(legal | domain)) & ((F.col("_t") != 1) | short | legal | domain)
    x = x.where(ok).groupBy(unit, "key").agg(F.count("*").alias("n"), F.min_by("surface", F.struct(F.length("surface"), F.col("pos"))).alias("name"))
    w = Window.partitionBy(unit).orderBy(F.desc("n"), "key")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def entity_names(found: DataFrame, unit: str) -> DataFrame:
    """``(key, name, mentions)`` of the whole corpus: in how many units an entity is, and the name that most
    of them use (then the one seen first)."""
    n = found.groupBy("key", "name").agg(F.count("*").alias("n"), F.min(unit).alias("first"))
    return n.groupBy("key").agg(F.max_by("name", F.struct(F.col("n"), -F.col("first"))).alias("name"), F.sum("n").alias("mentions"))


def _first_keys(members: DataFrame, unit: str, key: str, most: int) -> DataFrame:
    w = Window.partitionBy(unit).orderBy(F.desc("n"), key)
    return members.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).groupBy(unit).agg(F.array_sort(F.collect_list(key)).alias("ks")).where(F.size("ks") > 1)


def _pairs(members: DataFrame, unit: str, key: str, most: int) -> DataFrame:
    """``(unit, source, target, w)``, source < target: a unit shares 1/(k-1) among the pairs of its k first
    entities; k is at most ``most``, so a unit gives a bounded number of pairs."""
    m = _first_keys(members, unit, key, most)
    pairs = F.flatten(F.transform("ks", lambda a: F.transform(F.filter("ks", lambda b: b > a), lambda b: F.struct(a.alias("source"), b.alias("target"), (1.0 / (F.size("ks") - 1)).alias("w")))))
    return m.select(unit, F.explode(pairs).alias("p")).select(unit, "p.*")


def edges(members: DataFrame, unit: str = "unit", key: str = "key", most: int = PER_UNIT) -> DataFrame:
    """``(source, target, weight)`` of all units together."""
    return _pairs(members, unit, key, most).groupBy("source", "target").agg(F.round(F.sum("w"), 6).alias("weight"))


def edge_units(members: DataFrame, unit: str = "unit", key: str = "key", most: int = PER_UNIT, refs: int = PER_EDGE) -> DataFrame:
    """``(source, target, n, unit)``: the first ``refs`` units of every edge."""
    w = Window.partitionBy("source", "target").orderBy(unit)
    return _pairs(members, unit, key, most).select("source", "target", unit, F.row_number().over(w).alias("n")).where(F.col("n") <= refs)


def both_ways(e: DataFrame) -> DataFrame:
    return e.select(F.col("source").alias("u"), F.col("target").alias("v"), "weight").unionByName(e.select(F.col("target").alias("u"), F.col("source").alias("v"), "weight"))


def degrees(e: DataFrame) -> DataFrame:
    return both_ways(e).groupBy("u").agg(F.round(F.sum("weight"), 6).alias("degree")).withColumnRenamed("u", "key")


def label_propagation(e: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(key, label)`` after so many synchronous rounds, or when nothing changes: every node takes the
    heaviest label of its neighbours (then the shorter, then the smaller). The lineage is cut in every
    second round."""
    b = cut(both_ways(e))
    label = b.select("u").distinct().select("u", F.col("u").alias("label"))
    for r in range(rounds):
        votes = b.join(label.select(F.col("u").alias("v"), "label"), "v").groupBy("u", "label").agg(F.round(F.sum("weight"), 6).alias("w"))
        new = votes.groupBy("u").agg(F.min_by("label", F.struct((-F.col("w")).alias("w"), F.length("label").alias("n"), F.col("label"))).alias("label"))
        if r % 2:
            new = cut(new)
            if new.join(label.withColumnRenamed("label", "old"), "u").where("label <> old").isEmpty():
                label = new
                break
        label = new
    return label.withColumnRenamed("u", "key")


def label_propagation_in_turn(e: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(key, label)``: the sequential variant, where a node sees the labels that nodes before it have taken
    in the same round; nodes by degree, then key. One task walks the graph, so it must have at most
    :data:`MOST_EDGES` edges; :func:`label_propagation` has no such bound."""
    b = cut(both_ways(e))
    if b.count() > 2 * MOST_EDGES:
        raise ValueError("too many edges to be walked in turn")

    def walk(batches):
        near: dict[str, list] = {}
        for x in batches:
            for u, v, w in zip(*(c.to_pylist() for c in x.columns), strict=True):
                near.setdefault(u, []).append((v, w))
        label = {u: u for u in near}
        order = sorted(near, key=lambda u: (-round(sum(w for _, w in near[u]), 6), u))
        for _ in range(rounds):
            changed = False
            for u in order:
                votes: dict[str, float] = {}
                for v, w in near[u]:
                    votes[label[v]] = votes.get(label[v], 0.0) + w
                best = min(votes, key=lambda g: (-round(votes[g], 6), len(g), g))
                if best != label[u]:
                    label[u], changed = best, True
            if not changed:
                break
        yield pa.RecordBatch.from_pydict({"key": pa.array(list(label), pa.string()), "label": pa.array(list(label.values()), pa.string())})

    return b.select("u", "v", "weight").coalesce(1).mapInArrow(walk, "key string, label string")


def communities(label: DataFrame, degree: DataFrame, most: int = 12) -> DataFrame:
    """``(label, size, top)``: the members of every community of two and more by degree, then name."""
    w = Window.partitionBy("label").orderBy(F.desc("degree"), "key")
    x = label.join(degree, "key").withColumn("r", F.row_number().over(w))
    size = label.groupBy("label").agg(F.count("*").alias("size")).where("size > 1")
    top = x.where(F.col("r") <= most).groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "key"))), lambda s: s["key"]), " ").alias("top"))
    return size.join(top, "label")


def described(label: DataFrame, names: DataFrame, degree: DataFrame, members: DataFrame, passages: DataFrame, most: int = 12, chunks: int = 8) -> DataFrame:
    """``(label, size, top_chunks, summary)`` of every community, also of single entities: its first entities
    by mentions, degree and name, its passages by entities in them, and the first sentences of three."""
    x = names.join(label, "key", "left").join(degree, "key", "left").select("key", "name", "mentions", F.coalesce("label", "key").alias("label"), F.coalesce("degree", F.lit(0.0)).alias("degree"))
    x = cut(x)
    size = x.groupBy("label").agg(F.count("*").alias("size"))
    first = Window.partitionBy("label").orderBy(F.desc("mentions"), F.desc("degree"), "name")
    top = x.withColumn("r", F.row_number().over(first)).where(F.col("r") <= min(most, 10)).groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda s: s["name"]), ", ").alias("entities"))
    of = members.join(x.select("key", "label"), "key").groupBy("label", "unit").agg(F.sum("n").alias("s"))
    w = Window.partitionBy("label").orderBy(F.desc("s"), "unit")
    best = cut(of.withColumn("r", F.row_number().over(w)).where(F.col("r") <= chunks))
    need = cut(best.where("r <= 3").select(F.col("unit").alias("chunk_id")).distinct())
    said = sized_join(passages.select("chunk_id", "text"), need, ["chunk_id"], "left_semi").select(F.col("chunk_id").alias("unit"), T.repair_ocr(F.col("text")).alias("t"), T.clean_text(F.col("text")).alias("c"))
    said = said.select("unit", F.coalesce(F.get(T.sentences(F.col("t")), F.lit(0)), F.substring("c", 1, 240)).alias("said"))
    excerpt = best.where("r <= 3").join(said, "unit").groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "said"))), lambda s: s["said"]), " ").alias("e"))
    ids = best.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "unit"))), lambda s: s["unit"]).alias("top_chunks"))
    short = F.when(F.length("e") > 900, F.regexp_replace(F.substring("e", 1, 900), "(?s) [^ ]*$", "")).otherwise(F.coalesce("e", F.lit("")))
    out = size.join(top, "label").join(ids, "label", "left").join(excerpt, "label", "left")
    return out.select("label", "size", "top_chunks", F.concat(F.lit("Entities: "), "entities", F.lit("\nKey excerpts: "), short).alias("summary"))


def seeds_of(questions: DataFrame, names: DataFrame, limit: int = 8) -> DataFrame:
    """``(query_id, key, seed)``: the entities of ``(key, name, mentions)`` nearest to each question: the
    overlap of question and name, 0.6 if the key stands in the question and, for what is above 0, a
    fortieth of the mentions up to 0.25. Entities of shared words are joined by word; keys that are
    part of a question, also of its words, by containment."""
    ask = questions.select("query_id", "question", T.fold(F.lower(F.col("question"))).alias("_fq"), F.array_distinct(T.tokens_folded(F.col("question"))).alias("_qs"))
    by_word = ask.select("query_id", F.explode("_qs").alias("w")).join(names.select("key", F.explode(F.array_distinct(T.tokens_folded(F.col("name")))).alias("w")), "w").select("query_id", "key")
    # the whole of a question in a name shares its words, unless it has none
    part = names.select("key").join(F.broadcast(ask.select("query_id", "_fq")) if questions.count() <= BROADCAST_ROWS else ask.select("query_id", "_fq"), F.contains(F.col("_fq"), F.col("key"))).select("query_id", "key")
    x = by_word.unionByName(part).distinct().join(names, "key").join(ask, "query_id")
    name_score = overlap(F.col("question"), F.col("name")) + F.when(F.contains(F.col("_fq"), F.col("key")), 0.6).otherwise(0.0)
    x = x.withColumn("_s", name_score).where("_s > 0").select("query_id", "key", F.round(F.col("_s") + F.least(F.col("mentions") / 40.0, F.lit(0.25)), 6).alias("seed"))
    w = Window.partitionBy("query_id").orderBy(F.desc("seed"), "key")
    return x.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")


def local(questions: DataFrame, passages: DataFrame, found: DataFrame, keywords: DataFrame, names: DataFrame | None = None, k: int = 7, candidates: int = 40) -> DataFrame:
    """Local retrieval of ``(chunk_id, text)`` by their entities ``(chunk_id, key, name, n, rank)`` and
    the BM25 scores ``keywords``. Questions without a seed take the first three entities of each of
    their k best passages, by 0.35 a time. A fifth of the scores of the best ``candidates`` joins the
    graph score; graph and keywords after minmax, and the overlap, make the rank. An entity counts once a
    passage, as often as it may stand in it."""
    members = found.select(F.col("chunk_id").alias("unit"), "key", "n")
    names = cut(entity_names(found, "chunk_id") if names is None else names)
    seeds = cut(seeds_of(questions, names))
    best = cut(top_k(keywords, max(candidates, k)))
    missing = best.where(F.col("rank") <= k).join(seeds.select("query_id").distinct(), "query_id", "left_anti")
    fallback = missing.select("query_id", "chunk_id").join(found.where("rank <= 3").select("chunk_id", "key"), "chunk_id").select("query_id", "key", F.lit(0.35).alias("seed"))
    graph = local_scores(seeds.unionByName(fallback), members.withColumn("n", F.lit(1)), cut(edges(members))).withColumnRenamed("unit", "chunk_id")
    return _combined(questions, passages, graph, keywords, best, k, candidates)


def _combined(questions: DataFrame, passages: DataFrame, graph: DataFrame, keywords: DataFrame, best: DataFrame, k: int, candidates: int) -> DataFrame:
    best = best.where(F.col("rank") <= candidates)
    graph = graph.unionByName(best.select("query_id", "chunk_id", (F.col("score") * 0.2).alias("score"))).groupBy("query_id", "chunk_id").agg(F.round(F.sum("score"), 12).alias("score"))
    x = minmax(cut(graph), digits=None).select("query_id", "chunk_id", F.col("norm").alias("graph")).join(minmax(keywords, digits=None).select("query_id", "chunk_id", F.col("norm").alias("keyword")), ["query_id", "chunk_id"], "left").na.fill(0.0, ["keyword"])
    # every candidate has a graph score, as the best passages by keyword have; a passage is at most
    # 1.35 * 0.25 better by its overlap, so only those near the k best need their texts
    x = cut(x.withColumn("base", F.col("graph") * 0.60 + F.col("keyword") * 0.40))
    least = top_k(x, k, "base").groupBy("query_id").agg(F.min("base").alias("_least"))
    near = cut(x.join(least, "query_id").where(F.col("base") + 0.3375 >= F.col("_least") - 1e-5).select("query_id", "chunk_id", "base"))
    y = sized_join(passages.select("chunk_id", "text"), near, ["chunk_id"]).join(questions.select("query_id", "question"), "query_id")
    y = y.select("query_id", "chunk_id", F.round(F.col("base") + 0.25 * overlap(F.col("question"), F.col("text"), None), 6).alias("score"))
    return top_k(y, k).select("query_id", "rank", "chunk_id", "score")


def local_scores(seeds: DataFrame, members: DataFrame, e: DataFrame, neighbours: int = 8) -> DataFrame:
    """``(query_id, unit, score)``: seed times count, plus 0.35 of seed times edge times count of the
    neighbours with the heaviest edges."""
    direct = seeds.join(members, "key").select("query_id", "unit", (F.col("seed") * F.col("n")).alias("s"))
    b = both_ways(e).withColumnRenamed("u", "key")
    w = Window.partitionBy("key").orderBy(F.desc("weight"), "v")
    near = b.withColumn("r", F.row_number().over(w)).where(F.col("r") <= neighbours)
    second = seeds.join(near, "key").select("query_id", F.col("v").alias("key"), (0.35 * F.col("seed") * F.col("weight")).alias("x")).join(members, "key").select("query_id", "unit", (F.col("x") * F.col("n")).alias("s"))
    return direct.unionByName(second).groupBy("query_id", "unit").agg(F.round(F.sum("s"), 12).alias("score"))


def community_scores(questions: DataFrame, described: DataFrame, most: int = 5) -> DataFrame:
    """``(query_id, label, score, n)``: the communities nearest to each question: overlap of the question
    without words of overview and the summary, and an eightieth of the size up to 0.35. Communities of
    shared words are joined by word; of the others only the largest can be among the first."""
    ask = questions.select("query_id", stripped_question(F.col("question")).alias("asked"))
    prior = F.least(F.col("size") / 80.0, F.lit(0.35))
    words = lambda c: F.explode(F.array_distinct(T.tokens_folded(F.col(c)))).alias("w")
    by_word = ask.select("query_id", words("asked")).join(described.select("label", words("summary")), "w").select("query_id", "label").distinct()
    largest = described.orderBy(F.desc(F.round(prior, 6)), "label").limit(most).select("label")
    x = by_word.unionByName(ask.select("query_id").join(F.broadcast(largest))).distinct().join(described.select("label", "size", "summary"), "label").join(ask, "query_id")
    x = x.select("query_id", "label", F.round(F.when(F.col("asked") != "", overlap(F.col("asked"), F.col("summary"))).otherwise(0.0) + prior, 6).alias("score")).where("score > 0")
    return top_k(x, most, tie="label").withColumnRenamed("rank", "n")


def global_retrieve(questions: DataFrame, passages: DataFrame, described: DataFrame, keywords: DataFrame, k: int = 7, candidates: int = 40) -> DataFrame:
    """Global retrieval: passages by the scores of the communities that they stand for, over their rank in
    it, plus keywords, as in :func:`local`."""
    near = cut(community_scores(questions, described))
    chunks = described.select("label", F.posexplode("top_chunks").alias("pos", "chunk_id"))
    graph = near.join(chunks, "label").select("query_id", "chunk_id", (F.col("score") / (F.col("pos") + 1)).alias("score"))
    return _combined(questions, passages, graph, keywords, cut(top_k(keywords, max(candidates, k))), k, candidates)


def choose_mode(question: Column) -> Column:
    """global for a question with a word or phrase of overview, else local."""
    q = F.concat(F.lit(" "), T.normalized(question), F.lit(" "))
    return F.when(F.exists(F.array(*[F.lit(f" {h} ") for h in lexicon.GLOBAL_HINTS]), lambda h: F.contains(q, h)), "global").otherwise("local")


def stripped_question(question: Column) -> Column:
    """Without the words of overview and the fillers, longest first; words of one letter go too."""
    q = T.fold(F.lower(question))
    for p in sorted({*lexicon.GLOBAL_HINTS, *lexicon.FILLERS}, key=lambda x: (-len(x), x)):
        q = F.replace(q, F.lit(p), F.lit(" "))
    return F.array_join(T.tokens(q), " ")


def overlap(question: Column, text: Column, digits: int | None = 6) -> Column:
    """The share of the question's words that the text has, plus 0.35 if it has the whole question."""
    q, t = F.array_distinct(T.tokens_folded(question)), T.tokens_folded(text)
    low = lambda x: T.fold(F.lower(x))
    whole = F.when(F.contains(low(text), low(question)), 0.35).otherwise(0.0)
    x = F.when((F.size(q) == 0) | (F.size(t) == 0), 0.0).otherwise(F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1)) + whole)
    return x if digits is None else F.round(x, digits)
