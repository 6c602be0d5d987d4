"""Controlled concepts, typed facts and the ranking that uses them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from ..session import BROADCAST_ROWS, cut, sized_join
from .retrieval import top_k

#: Aliases that are sent to every task at most; longer lists are joined by shuffle.
MOST_ALIASES = 200_000


def aliases(concepts: DataFrame) -> DataFrame:
    """``(concept, alias)``: labels and aliases in normalised form, each once."""
    x = concepts.select("id", F.explode(F.array_union(F.array("concept_label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a"))
    return x.select(F.col("id").alias("concept"), T.normalized(F.col("a")).alias("alias")).where("alias <> ''").distinct()


def find_concepts(df: DataFrame, key: str, text: str, concepts: DataFrame, most: int = MOST_ALIASES) -> DataFrame:
    """``(key, concept, alias)``: concepts of which a whole alias stands in the text, with the longest such
    alias; nested aliases count too. One pass of an automaton over each text instead of a comparison
    with every alias; a list of more than ``most`` aliases is joined with the runs of words instead."""
    known = cut(aliases(concepts))
    src = df.select(F.col(key).alias("_k"), T.normalized(F.col(text)).alias("_t")).where("_t is not null")
    if known.count() > most:
        lengths = [r["n"] for r in known.select(F.size(F.split("alias", " ")).alias("n")).distinct().collect()]
        w = F.split("_t", " ")
        runs = lambda n: F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " ")))
        x = src.select("_k", F.explode(F.array_distinct(F.concat(*[runs(n) for n in lengths]))).alias("alias")).join(known, "alias")
    else:
        by: dict[str, list[str]] = {}
        for r in sorted(known.collect()):
            by.setdefault(r["alias"], []).append(r["concept"])

        def work(batches):
            import ahocorasick

            a = ahocorasick.Automaton()
            for k, v in by.items():
                a.add_word(f" {k} ", (k, v))
            a.make_automaton()
            for b in batches:
                at, found, alias = [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    for k, v in {k: v for _, (k, v) in a.iter(f" {t} ")}.items() if by else ():
                        at += [i] * len(v)
                        found += v
                        alias += [k] * len(v)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string()), pa.array(alias, pa.string())], names=["_k", "concept", "alias"])

        x = src.mapInArrow(work, f"_k {src.schema['_k'].dataType.simpleString()}, concept string, alias string")
    return x.groupBy("_k", "concept").agg(F.max_by("alias", F.struct(F.length("alias").alias("n"), F.col("alias").alias("a"))).alias("alias")).withColumnRenamed("_k", key)


def _listed(found: DataFrame, keys: list[str], out: str, keep: Column | None = None) -> DataFrame:
    """The concepts of each key as an array: longer aliases first, then by concept."""
    s = F.struct((-F.length("alias")).alias("n"), F.col("concept"))
    return found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(s if keep is None else F.when(keep, s))), lambda x: x["concept"]).alias(out))  # concepts of one text


def invalid_concepts(concepts: DataFrame, types: dict[str, list[str]] = lexicon.ENTITY_TYPES) -> DataFrame:
    """``(problem, id)``: ids that are null or used twice, concepts without a type or label or of an
    unknown type, required columns that are missing."""
    x = concepts
    lost = [c for c in ("id", "concept_type", "concept_label", "aliases") if c not in x.columns]
    for c in lost:
        x = x.withColumn(c, F.lit(None).cast("array<string>" if c == "aliases" else "string"))
    say = lambda df, what: df.select(F.lit(what).alias("problem"), F.col("id").cast("string").alias("id"))
    out = say(x.where("id is null"), "null id")
    out = out.unionByName(say(x.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 and id is not null"), "duplicate id"))
    out = out.unionByName(say(x.where("concept_type is null or concept_label is null"), "no type or label"))
    out = out.unionByName(say(x.where(~F.col("concept_type").isin([t for ts in types.values() for t in ts])), "unknown type"))
    return out.unionByName(concepts.sparkSession.createDataFrame([("missing column", c) for c in lost], "problem string, id string"))


def intents(df: DataFrame, key: str, question: str, hints: dict[str, list[str]] = lexicon.INTENTS) -> DataFrame:
    """``(key, predicate)``: what a question asks for, by the hints of an ontology."""
    q = T.normalized(F.col(question))
    hit = [F.when(sum((F.contains(q, F.lit(T.folded(h.lower()))).cast("int") for h in words), F.lit(0)) > 0, F.lit(p)) for p, words in hints.items()]
    return df.select(key, F.explode(F.array_compact(F.array(*hit))).alias("predicate"))


def _bound(pattern: str) -> str:
    return rf"(?iu)(^|[^\p{{L}}\p{{N}}_]){pattern}([^\p{{L}}\p{{N}}_]|$)"


def fact_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, pos, sentence)`` of sentences of 20 characters and more."""
    return df.select(key, F.posexplode(F.filter(T.sentences(F.col(text), wide=False), lambda s: F.length(s) >= 20)).alias("pos", "sentence"))


def sentence_predicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, pos, sentence, predicate)``: the predicates that a sentence states by its words."""
    x = fact_sentences(df, key, text)
    hit = [F.when(F.col("sentence").rlike(_bound(p)), F.lit(n)) for n, p in lexicon.PREDICATES.items()]
    return x.select(key, "pos", "sentence", F.explode(F.array_compact(F.array(*hit))).alias("predicate"))


def sentence_facts(df: DataFrame, key: str, text: str, concepts: DataFrame, document: str, article: str | None = None, most: int = 5) -> DataFrame:
    """``(subject, predicate, object, key, pos, sentence, confidence)``. Predicates are those of the words,
    applies_to for the scope, defines for "is" in a text that explains terms, references for a document
    number, and mentions if there is no other but a concept. The subject of rights and duties is the first
    actor of the sentence, else the document (column ``document``) or its article; objects are topics, or
    else actors, or else the documents referred to, ``most`` at most."""
    base = df.select(F.col(key), F.col(document).alias("_doc"), (F.col(article) if article else F.lit(None).cast("string")).alias("_art"), F.col(text).alias("_text"))
    base = base.withColumn("_refs", T.legal_refs(F.col("_text"))).withColumn("_terms", F.contains(T.normalized(F.col("_text")), F.lit("giai thich tu ngu")))
    s = base.select(key, "_doc", "_art", "_refs", "_terms", F.posexplode(F.filter(T.sentences(F.col("_text"), wide=False), lambda x: F.length(x) >= 20)).alias("pos", "sentence"))
    s = s.withColumn("_n", T.normalized(F.col("sentence"))).withColumn("refs", F.filter("_refs", lambda r: F.contains(F.col("_n"), T.normalized(r))))
    s = cut(s.withColumn("sid", F.concat_ws("#", F.col(key).cast("string"), F.col("pos").cast("string"))))
    found = find_concepts(s.select("sid", "sentence"), "sid", "sentence", concepts)
    kinds = cut(concepts.select(F.col("id").alias("concept"), F.col("concept_type").isin(lexicon.ACTORS).alias("actor")).distinct())
    found = sized_join(found, kinds, ["concept"])
    lists = _listed(found, ["sid"], "actors", F.col("actor")).join(_listed(found, ["sid"], "topics", ~F.col("actor")), "sid")
    none = F.array().cast("array<string>")
    x = s.join(lists, "sid", "left").withColumn("actors", F.coalesce("actors", none)).withColumn("topics", F.coalesce("topics", none))
    words = F.array_compact(F.array(
        *[F.when(F.col("sentence").rlike(_bound(p)), F.lit(n)) for n, p in lexicon.PREDICATES.items()],
        F.when(F.contains("_n", F.lit("doi tuong ap dung")), F.lit("applies_to")),
        F.when(F.col("_terms") & F.col("sentence").rlike(_bound(lexicon.DEFINING)), F.lit("defines")),
        F.when(F.size("refs") > 0, F.lit("references")),
    ))
    stated = F.when(F.size(words) > 0, words).when(F.size("actors") + F.size("topics") > 0, F.array(F.lit("mentions"))).otherwise(none)
    x = x.select("*", F.explode(stated).alias("predicate"))
    own = F.when(F.coalesce("_art", F.lit("")) != "", F.concat("_doc", F.lit("#article:"), "_art")).otherwise(F.col("_doc"))
    x = x.withColumn("subject", F.when(F.col("predicate").isin("has_right", "requires") & (F.size("actors") > 0), F.get("actors", F.lit(0))).otherwise(own))
    targets = F.when(F.size("topics") > 0, F.col("topics")).when(F.size("actors") > 0, F.col("actors")).otherwise(F.col("refs"))
    x = x.select("*", F.explode(F.slice(targets, 1, most)).alias("target")).where("target <> subject")
    return x.select("subject", "predicate", F.when(F.array_contains("refs", F.col("target")), F.concat(F.lit("legal_document:"), "target")).otherwise(F.col("target")).alias("object"), key, "pos", F.substring("sentence", 1, 700).alias("sentence"), F.when(F.col("predicate") == "mentions", 0.65).otherwise(0.9).alias("confidence"))


def document_metadata(documents: DataFrame, key: str, name: str, text: str, concepts: DataFrame, issuers: list[str] = lexicon.ISSUERS) -> DataFrame:
    """``(key, document_number, document_type, issuer, promulgation_date, quality, status)`` from a file
    name and the leading 10,000 characters: the number of the name, else the first before the words of
    legal ground; issuer is the first of the known authorities that the text names."""
    from .corpus import document_quality

    lead = F.substring(F.col(text), 1, 10000)
    head = F.get(F.split(lead, r"(?iuU)\bcăn\s+cứ\b"), F.lit(0))
    x = documents.select(key, F.coalesce(T.filename_ref(F.col(name)), F.get(T.legal_refs(head), F.lit(0))).alias("document_number"), T.document_type(F.concat(F.regexp_replace(F.col(name), r"\.[^.]*$", ""), F.lit(" "), lead)).alias("document_type"), T.first_date(lead).alias("promulgation_date"))
    order = F.array(*map(F.lit, issuers)) if issuers else F.array().cast("array<string>")
    known = concepts.where(F.col("id").isin(issuers))
    issuer = find_concepts(documents, key, text, known).groupBy(key).agg(F.min(F.array_position(order, F.col("concept"))).alias("_i"))
    quality = document_quality(documents, key, text)
    out = x.join(issuer, key, "left").join(quality, key)
    return out.select(key, "document_number", "document_type", F.get(order, (F.col("_i") - 1).cast("int")).alias("issuer"), "promulgation_date", "quality", "status")


def question_refs(questions: DataFrame) -> DataFrame:
    return questions.select("query_id", F.explode(T.legal_refs(F.col("question"))).alias("ref"))


def ontology_scores(questions: DataFrame, facts: DataFrame, chunks: DataFrame, concepts: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(query_id, chunk_id, score)``: what passages get for concepts, document numbers and facts. 1.5 for
    each shared concept, 2 for a shared reference, 3 for the document's own number; for each fact 1 for a
    concept, 1.25 for a predicate, 1.5 for both and 2 for a reference in its object."""
    qc = cut(find_concepts(questions, "query_id", "question", concepts).select("query_id", "concept"))
    qp = intents(questions, "query_id", "question")
    qr = cut(question_refs(questions))
    own = cut(chunks.select("chunk_id", "document", F.col("text")).transform(lambda c: find_concepts(c, "chunk_id", "text", concepts)).select("chunk_id", "concept"))
    shared = sized_join(own, qc, ["concept"]).groupBy("query_id", "chunk_id").agg((1.5 * F.count("*")).alias("s"))
    refs = sized_join(chunks.select("chunk_id", F.explode(T.legal_refs(F.col("text"))).alias("ref")), qr, ["ref"]).select("query_id", "chunk_id").distinct().withColumn("s", F.lit(2.0))
    named = manifest.select(F.col("filename").alias("document"), F.col("document_number").alias("ref")).distinct().join(qr, "ref").select("query_id", "document").distinct()
    numbers = sized_join(chunks.select("chunk_id", "document"), cut(named), ["document"]).select("query_id", "chunk_id", F.lit(3.0).alias("s"))
    # the facts that meet a question in some way, each once with its flags
    f = facts.select("chunk_id", F.col("predicate_name").alias("predicate"), F.col("subject_id"), F.col("object_id")).withColumn("n", F.lit(1))
    f = cut(f.groupBy("chunk_id", "predicate", "subject_id", "object_id").agg(F.sum("n").alias("n")).withColumn("fid", F.xxhash64("chunk_id", "predicate", "subject_id", "object_id")))
    hit = sized_join(f.select("fid", "chunk_id", "predicate", "n", F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("concept")), qc, ["concept"]).select("query_id", "fid", "chunk_id", "predicate", "n").distinct()
    both = hit.join(qp.withColumn("p", F.lit(1)), ["query_id", "predicate"], "left").groupBy("query_id", "chunk_id").agg(F.sum(F.col("n") * (1.0 + F.when(F.col("p") == 1, 1.5).otherwise(0.0))).alias("s"))
    asked = f.groupBy("chunk_id", "predicate").agg(F.sum("n").alias("n")).join(qp, "predicate").groupBy("query_id", "chunk_id").agg((1.25 * F.sum("n")).alias("s"))
    objects = f.groupBy("object_id").agg(F.count("*").alias("_")).join(F.broadcast(qr) if qr.count() <= BROADCAST_ROWS else qr, F.contains("object_id", F.col("ref"))).select("query_id", "object_id").distinct()
    cited = f.join(objects, "object_id").groupBy("query_id", "chunk_id").agg((2.0 * F.sum("n")).alias("s"))
    x = shared
    for p in (refs, numbers, both, asked, cited):
        x = x.unionByName(p)
    return x.groupBy("query_id", "chunk_id").agg(F.round(F.sum("s"), 6).alias("score"))


def routes(questions: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(query_id, document)``: the files that a question names by number, unless it asks for references."""
    docs = manifest.select(F.col("filename").alias("document"), F.col("document_number").alias("ref")).distinct().join(question_refs(questions), "ref").select("query_id", "document").distinct()
    return docs.join(intents(questions, "query_id", "question").where("predicate = 'references'").select("query_id"), "query_id", "left_anti")


def routed(scores: DataFrame, questions: DataFrame, chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Of questions that name a document of the manifest, only its passages stay; others keep all."""
    docs = cut(routes(questions, manifest))
    free = sized_join(scores, cut(docs.select("query_id").distinct()), ["query_id"], "left_anti")
    bound = sized_join(chunks.select("chunk_id", "document"), docs, ["document"]).select("query_id", "chunk_id")
    return free.unionByName(scores.join(bound, ["query_id", "chunk_id"], "left_semi"))


def ontology_rank(keyword: DataFrame, ontology: DataFrame, questions: DataFrame, chunks: DataFrame, concepts: DataFrame, k: int = 7) -> DataFrame:
    """``(query_id, rank, chunk_id, score, kw, ont)``: 0.55 keyword (a quarter of it where the ontology gives
    nothing to a question with concepts or references) plus 0.45 ontology, 0.08 for the article named,
    0.28 or 0.16 for the opening that the intent asks for; all times a factor of quality. ``chunks`` has
    article, quality_score and text."""
    plan = questions.select("query_id", "question").join(find_concepts(questions, "query_id", "question", concepts).select("query_id").unionByName(question_refs(questions).select("query_id")).distinct().withColumn("_gated", F.lit(True)), "query_id", "left")
    has = intents(questions, "query_id", "question").groupBy("query_id").agg(F.max(F.col("predicate") == "has_right").alias("_right"), F.max(F.col("predicate") == "applies_to").alias("_scope"))
    plan = cut(plan.join(has, "query_id", "left").withColumn("_articles", F.regexp_extract_all(F.lower("question"), F.lit(r"(?U)\bđi[eề]u\s+(\w+)\b"), F.lit(1))))
    x = keyword.select("query_id", "chunk_id", F.col("norm").alias("kw")).join(ontology.select("query_id", "chunk_id", F.col("norm").alias("ont")), ["query_id", "chunk_id"], "full").na.fill(0.0, ["kw", "ont"])
    own = cut(chunks.select("chunk_id", F.lower(F.col("article").cast("string")).alias("_art"), F.coalesce("quality_score", T.text_quality(F.col("text"))).alias("quality_score"), T.normalized(F.substring("text", 1, 180)).alias("_open")).select("chunk_id", "_art", "quality_score", F.contains("_open", F.lit("quyen cua")).alias("_of_right"), F.contains("_open", F.lit("doi tuong ap dung")).alias("_of_scope")))
    x = sized_join(x, plan, ["query_id"]).join(own, "chunk_id")
    bonus = F.when(F.coalesce(F.array_contains("_articles", F.col("_art")), F.lit(False)), 0.08).otherwise(0.0)
    bonus = bonus + F.when(F.coalesce("_right", F.lit(False)) & F.col("_of_right"), 0.28).when(F.coalesce("_scope", F.lit(False)) & F.col("_of_scope"), 0.16).otherwise(0.0)
    gate = F.when(F.coalesce("_gated", F.lit(False)) & (F.col("ont") == 0), 0.25).otherwise(1.0)
    x = x.withColumn("score", F.round((F.col("kw") * 0.55 * gate + F.col("ont") * 0.45 + bonus) * (0.2 + 0.8 * F.coalesce("quality_score", F.lit(0.0))), 6))
    return top_k(x, k).select("query_id", "rank", "chunk_id", "score", F.round("kw", 6).alias("kw"), F.round("ont", 6).alias("ont"))
