"""The queries of the core, each over its whole tables; their SQL is in :mod:`.oracles`.

``documents`` are pages (one row, page 1), cut into passages of 450 words; the labels of
``banking_ontology`` are the batch of questions; ``chunks``, ``facts`` and ``doc_manifest`` are a
ready-made index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon
from ..functions import text as T
from ..operators import answer, corpus, graph, ontology, retrieval
from ..session import cut, once, sized_join, table
from . import oracles


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text").where("text is not null")


def _passages(s: SparkSession, d: str) -> DataFrame:
    return corpus.chunk_words(table(s, d, "documents"), "doc_id", "text")


def _questions(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "banking_ontology").select(F.col("concept_no").alias("query_id"), F.col("concept_label").alias("question"))


def _asked(s: SparkSession, d: str) -> DataFrame:
    """The questions, and as many that name a document by its number, an article and an intent."""
    q = table(s, d, "banking_ontology").select("concept_no", "concept_label")
    n = table(s, d, "doc_manifest").select("document_number").where("document_number is not null").distinct().orderBy("document_number").limit(max(1, q.count()))
    n = n.withColumn("concept_no", F.row_number().over(Window.orderBy("document_number")))  # as many as concepts
    named = q.join(n, "concept_no").select((F.col("concept_no") + 100000).alias("query_id"), F.concat(F.lit("Quyền của "), "concept_label", F.lit(" theo Điều "), (F.col("concept_no") % 60).cast("string"), F.lit(" "), "document_number", F.lit(" là gì?")).alias("question"))
    return cut(_questions(s, d).unionByName(named))


def _index(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks").select("id", "document", "page", "chunk_on_page", "article", "text", "quality_score")
    return once(c.where("text is not null"), "id").withColumnRenamed("id", "chunk_id")


def _text(out: str, f):
    return lambda s, d: _docs(s, d).select("doc_id", f(F.col("text")).alias(out))


def _listed(out: str, f):
    return lambda s, d: _docs(s, d).select("doc_id", F.array_join(f(F.col("text")), " ").alias(out))


def sentence_split(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def chunk_words(s, d):
    return _passages(s, d).select("doc_id", "chunk_on_page", "chunk_id", F.size(T.words(F.col("text"))).alias("n_words"), F.md5("text").alias("hash"))


def chunk_merge(s, d):
    return answer.merge_overlapping(_passages(s, d), ["doc_id"], ["chunk_on_page"], "text").select("doc_id", F.md5("text").alias("hash"))


def token_bigrams(s, d):
    return _docs(s, d).select("doc_id", T.tokens_dual(F.col("text")).alias("t")).select("doc_id", F.array_join(T.bigrams(F.col("t")), " ").alias("pairs"))


def char_ngrams(s, d):
    return _docs(s, d).select("doc_id", T.char_ngram_counts(T.squeezed(F.col("text"))).alias("g")).select("doc_id", "g.grams", "g.distinct_grams")


def bm25_topk(analyser: str = "basic", k: int = 5):
    return lambda s, d: retrieval.top_k(retrieval.bm25(_passages(s, d), _questions(s, d), analyser, k), k).select("query_id", "rank", "chunk_id", "score")


def bm25_occurrences(s, d):
    return retrieval.top_k(retrieval.bm25(_passages(s, d), _questions(s, d), "folded", 7, occurrences=True), 7).select("query_id", "rank", "chunk_id", "score")


def minmax(s, d):
    return retrieval.minmax(retrieval.bm25(_passages(s, d), _questions(s, d))).select("query_id", "chunk_id", "norm")


def feature_df(s, d):
    return retrieval.feature_kinds(_passages(s, d), "chunk_id", "text")


def feature_counts(s, d):
    """How many features are in so many passages."""
    return retrieval.feature_counts(_passages(s, d)).where("h >= 0").groupBy("n").agg(F.count("*").alias("features"))


def hashed_vector(s, d):
    return retrieval.question_vectors(_passages(s, d), _questions(s, d)).select("query_id", "idx", F.round("val", 6).alias("val"))


def sparse_topk(s, d):
    return retrieval.sparse(_passages(s, d), _questions(s, d))


def hybrid_topk(s, d):
    return retrieval.fused(_passages(s, d), _questions(s, d), 30)


def rerank_topk(s, d):
    return retrieval.hybrid(_passages(s, d), _questions(s, d))


def dense_topk(s, d):
    v = table(s, d, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.dense(v, q, "vec_id", "embedding")


def _ranked(s, d):
    top = retrieval.top_k(retrieval.bm25(_passages(s, d), _questions(s, d), "basic", 5), 5)
    p = _passages(s, d).select("chunk_id", F.col("doc_id").cast("string").alias("document"), "doc_id", F.lit(1).alias("page"), "chunk_on_page", "text")
    return cut(sized_join(p, cut(top), ["chunk_id"]).join(_questions(s, d), "query_id"))


def bonuses(s, d):
    r = _ranked(s, d)
    return retrieval.bonuses(r).join(r.select("query_id", "chunk_id", graph.overlap(F.col("question"), F.col("text")).alias("overlap")), ["query_id", "chunk_id"])


def best_sentences(s, d):
    return answer.best_sentences(_ranked(s, d))


def context_pack(s, d):
    r = _ranked(s, d).select("query_id", "rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("text")).alias("block"))
    return answer.packed_context(r).select("query_id", "rank", F.length("block").alias("chars"), F.md5("block").alias("hash"))


def _hashed(df, column="context"):
    return df.select("query_id", F.length(column).alias("chars"), F.md5(column).alias("hash"))


def format_context(s, d):
    return _hashed(answer.format_context(_ranked(s, d)))


def compressed_context(s, d):
    return answer.compressed(_ranked(s, d))


def llm_context(s, d):
    return _hashed(answer.llm_context(_ranked(s, d)))


def graph_context(s, d):
    found = cut(_concept_entities(s, d))
    return _hashed(answer.graph_context(_ranked(s, d), found.select("chunk_id", "rank", "name")))


def ontology_sentences(s, d):
    return answer.ontology_sentences(_ranked(s, d))


def ontology_context(s, d):
    q, c, o = _questions(s, d), _index(s, d), table(s, d, "banking_ontology")
    top = cut(retrieval.top_k(retrieval.bm25(c, q, "folded", 7), 7).select("query_id", "rank", "chunk_id"))
    r = cut(sized_join(c, top, ["chunk_id"]))
    labels = ontology.find_concepts(r.select("chunk_id", "text").dropDuplicates(["chunk_id"]), "chunk_id", "text", o).join(F.broadcast(o.select(F.col("id").alias("concept"), "concept_label").limit(ontology.MOST_ALIASES)), "concept")
    w = F.struct((-F.length("alias")).alias("n"), "concept", "concept_label")
    labels = labels.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(w)), lambda x: x["concept_label"]), ", ").alias("labels"))
    numbers = table(s, d, "doc_manifest").select(F.col("filename").alias("document"), "document_number").where("document_number is not null").distinct()
    return _hashed(answer.ontology_context(r, labels, numbers))


def citations(s, d):
    c = once(table(s, d, "chunks").select("id", "document", "page", "chunk_on_page", "article", "text").where("text is not null"), "id")
    legal = F.concat("document", F.lit(", trang "), F.col("page").cast("string"), F.when(F.coalesce("article", F.lit("")) != "", F.concat(F.lit(", Điều "), "article")).otherwise(""))
    return c.select("id", answer.citation(F.col("document"), F.col("page"), F.col("chunk_on_page")).alias("citation"), legal.alias("legal_citation"), F.substring(T.clean_text(F.col("text")), 1, 420).alias("preview"))


def inspect_stats(s, d):
    f, m = table(s, d, "facts"), table(s, d, "doc_manifest").dropDuplicates(["id"])
    a = m.agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.count_if(F.col("quality_status") == "review").alias("review"), F.count_if(F.col("document_number").isNull()).alias("unnumbered"))
    return a.select(*a.columns, F.lit(f.count()).alias("facts"))


def entity_members(s, d):
    """Units are documents, entities the objects of their facts."""
    f = table(s, d, "facts").where("object_id is not null and subject_id is not null")
    return f.groupBy(F.col("subject_id").alias("unit"), F.col("object_id").alias("key")).agg(F.count("*").alias("n"))


def _edges(s, d):
    return graph.edges(entity_members(s, d))


def label_propagation(s, d):
    return graph.label_propagation(_edges(s, d))


def community_table(s, d):
    e = cut(_edges(s, d))
    return graph.communities(graph.label_propagation(e), graph.degrees(e))


def edge_units(s, d):
    return graph.edge_units(entity_members(s, d))


def communities_in_turn(s, d):
    return graph.label_propagation_in_turn(_edges(s, d))


def _concept_entities(s, d):
    """The concepts of every passage as its entities."""
    o = table(s, d, "banking_ontology")
    names = o.groupBy(F.col("id").alias("key")).agg(F.min("concept_label").alias("name"))
    x = ontology.find_concepts(_passages(s, d), "chunk_id", "text", o).select("chunk_id", F.col("concept").alias("key")).join(F.broadcast(names.limit(ontology.MOST_ALIASES)), "key")
    return x.select("chunk_id", "key", "name", F.lit(1).alias("n"), F.row_number().over(Window.partitionBy("chunk_id").orderBy("key")).alias("rank")).where("rank <= 18")


def concept_names(s, d):
    return graph.entity_names(_concept_entities(s, d), "chunk_id")


def seed_entities(s, d):
    return graph.seeds_of(_questions(s, d), cut(concept_names(s, d)))


def _local(s, d, found):
    p, q = cut(_passages(s, d).select("chunk_id", "text")), _questions(s, d)
    return graph.local(q, p, cut(found), cut(retrieval.bm25(p, q, "folded")))


def local_retrieve(s, d):
    """Over the concepts of the passages."""
    return _local(s, d, _concept_entities(s, d))


def local_retrieve_entities(s, d):
    """Over all entities of the passages."""
    return _local(s, d, _passage_entities(s, d))


def _described(s, d, found, p):
    members = found.select(F.col("chunk_id").alias("unit"), "key", "n")
    e = cut(graph.edges(members))
    return cut(graph.described(cut(graph.label_propagation(e)), cut(graph.entity_names(found, "chunk_id")), graph.degrees(e), members.withColumn("n", F.lit(1)), p))


def _global_questions(s, d):
    return _questions(s, d).select("query_id", F.concat(F.lit("Tổng quan các quy định về "), "question").alias("question"))


def _global(s, d, found):
    p, q, found = cut(_passages(s, d).select("chunk_id", "text")), _global_questions(s, d), cut(found)
    return graph.global_retrieve(q, p, _described(s, d, found, p), cut(retrieval.bm25(p, q, "folded")))


def community_description(s, d):
    p = cut(_passages(s, d).select("chunk_id", "text"))
    return _described(s, d, cut(_concept_entities(s, d)), p).select("label", "size", F.array_join(F.col("top_chunks").cast("array<string>"), " ").alias("chunks"), F.md5("summary").alias("hash"))


def community_scores(s, d):
    p = cut(_passages(s, d).select("chunk_id", "text"))
    return graph.community_scores(_global_questions(s, d), _described(s, d, cut(_concept_entities(s, d)), p))


def global_retrieve(s, d):
    """Over the communities of concepts."""
    return _global(s, d, _concept_entities(s, d))


def global_retrieve_entities(s, d):
    """Over the communities of all entities."""
    return _global(s, d, _passage_entities(s, d))


def _passage_entities(s, d):
    return graph.entities(_passages(s, d), "chunk_id", "text")


def entity_mentions(s, d):
    """Every entity of the corpus: name, mentions, weighted degree."""
    found = cut(_passage_entities(s, d))
    e = graph.edges(found.select(F.col("chunk_id").alias("unit"), "key", "n"))
    return graph.entity_names(found, "chunk_id").join(graph.degrees(e), "key", "left").select("key", "name", "mentions", F.coalesce("degree", F.lit(0.0)).alias("degree"))


def entity_table(s, d):
    return graph.entities(_docs(s, d), "doc_id", "text").select("doc_id", "key", "name", "n", "rank")


def mode_choice(s, d):
    return _questions(s, d).unionByName(_global_questions(s, d).withColumn("query_id", F.col("query_id") + 100000)).select("query_id", graph.choose_mode(F.col("question")).alias("mode"), graph.stripped_question(F.col("question")).alias("stripped"))


def query_rewrite(s, d):
    return retrieval.rewrites(_questions(s, d))


def concept_match(s, d):
    return ontology.find_concepts(_docs(s, d), "doc_id", "text", table(s, d, "banking_ontology")).select("doc_id", "concept", "alias")


def query_semantics(s, d):
    q = _asked(s, d)
    kind = lambda df, name, column: df.select("query_id", F.lit(name).alias("kind"), F.col(column).alias("value"))
    found = kind(ontology.find_concepts(q, "query_id", "question", table(s, d, "banking_ontology")), "concept", "concept")
    return found.unionByName(kind(ontology.intents(q, "query_id", "question"), "intent", "predicate")).unionByName(kind(ontology.question_refs(q), "reference", "ref"))


def legal_refs(s, d):
    return _docs(s, d).select("doc_id", F.posexplode(T.legal_refs(F.col("text"))).alias("pos", "ref"))


def filename_refs(s, d):
    return table(s, d, "doc_manifest").select("filename").distinct().select("filename", T.filename_ref(F.col("filename")).alias("ref"))


def doc_quality(s, d):
    return corpus.document_quality(_docs(s, d), "doc_id", "text")


def document_stats(s, d):
    return corpus.document_stats(table(s, d, "chunks"))


def sentence_predicates(s, d):
    return ontology.sentence_predicates(_docs(s, d), "doc_id", "text").select("doc_id", "pos", "predicate")


def sentence_facts(s, d):
    docs = _docs(s, d).withColumn("document", F.concat(F.lit("document:"), F.col("doc_id").cast("string")))
    return ontology.sentence_facts(docs, "doc_id", "text", table(s, d, "banking_ontology"), "document")


def document_metadata(s, d):
    o = table(s, d, "banking_ontology")
    issuers = [r["id"] for r in o.where("concept_type = 'Authority'").select("id").distinct().orderBy("id").limit(3).collect()]
    docs = table(s, d, "documents").where("text is not null").select("doc_id", F.regexp_replace(F.coalesce("document_number", F.lit("")), "/", ".").alias("name"), "text")
    return ontology.document_metadata(docs, "doc_id", "name", "text", o, issuers)


def predicate_counts(s, d):
    return table(s, d, "facts").groupBy("predicate_name").agg(F.count("*").alias("facts"), F.countDistinct("subject_id").alias("subjects"))


def ontology_scores(s, d):
    return ontology.ontology_scores(_asked(s, d), table(s, d, "facts"), _index(s, d), table(s, d, "banking_ontology"), table(s, d, "doc_manifest"))


def doc_routing(s, d):
    return ontology.routes(_asked(s, d), table(s, d, "doc_manifest"))


def ontology_topk(s, d):
    q, c, o, m = _asked(s, d), cut(_index(s, d)), table(s, d, "banking_ontology"), table(s, d, "doc_manifest")
    ont = cut(retrieval.minmax(cut(ontology.ontology_scores(q, table(s, d, "facts"), c, o, m)), digits=None))
    kw = cut(retrieval.minmax(cut(retrieval.bm25(c, q, "folded")), digits=None))
    kw, ont = (ontology.routed(x, q, c, m) for x in (kw, ont))
    return ontology.ontology_rank(kw, ont, q, c, o)


def concept_types(s, d):
    """Concepts per type, and whether the type is a known one."""
    known = [t for ts in lexicon.ENTITY_TYPES.values() for t in ts]
    return table(s, d, "banking_ontology").groupBy("concept_type").agg(F.count("*").alias("concepts")).withColumn("known", F.col("concept_type").isin(known))


def concept_check(s, d):
    return ontology.invalid_concepts(table(s, d, "banking_ontology"))


def article_segments(s, d):
    c = once(table(s, d, "chunks").select("id", "document", "page", "chunk_on_page", "text").where("text is not null"), "id")
    return _segments_hashed(corpus.article_segments(c, "id", "text", "document", ["page", "chunk_on_page"]))


def _segments_hashed(x):
    return x.select("id", "pos", "article", F.length("segment").alias("chars"), F.md5("segment").alias("hash"))


def relationships(s, d):
    """The hundred heaviest edges."""
    return _edges(s, d).orderBy(F.desc("weight"), "source", "target").limit(100)


def queries() -> dict:
    return {
        "bm25_topk": bm25_topk(), "bm25_dual": bm25_topk("dual"), "bm25_folded": bm25_topk("folded"), "bm25_occurrences": bm25_occurrences, "minmax": minmax,
        "clean_text": _text("clean", T.clean_text), "clean_text_dehyphen": _text("clean", T.clean_text_dehyphen), "ocr_repair": _text("repaired", T.repair_ocr),
        "accent_fold": _text("folded", lambda x: T.fold(F.lower(x))), "normalized": _text("form", T.normalized), "text_quality": _text("quality", T.text_quality),
        "tokens_basic": _listed("toks", T.tokens), "tokens_dual": _listed("toks", T.tokens_dual), "tokens_folded": _listed("toks", T.tokens_folded),
        "token_bigrams": token_bigrams, "char_ngrams": char_ngrams,
        "doc_type": _text("kind", T.document_type), "promulgation_date": _text("dated", T.first_date),
        "sentence_split": sentence_split, "chunk_words": chunk_words, "chunk_merge": chunk_merge,
        "min_page_filter": lambda s, d: corpus.page_counts(table(s, d, "documents"), "text"),
        "term_counts": lambda s, d: corpus.term_counts(_passages(s, d)), "doc_freq": lambda s, d: corpus.doc_freq(_passages(s, d)),
        "corpus_stats": lambda s, d: corpus.corpus_stats(_passages(s, d)), "document_stats": document_stats, "doc_quality": doc_quality,
        "article_segments": article_segments, "article_carry": lambda s, d: corpus.carried_articles(table(s, d, "chunks")),
        "legal_refs": legal_refs, "filename_refs": filename_refs, "document_metadata": document_metadata,
        "query_rewrite": query_rewrite, "feature_df": feature_df, "feature_counts": feature_counts, "hashed_vector": hashed_vector, "sparse_topk": sparse_topk,
        "bonuses": bonuses, "hybrid_topk": hybrid_topk, "rerank_topk": rerank_topk, "dense_topk": dense_topk,
        "entity_table": entity_table, "entity_mentions": entity_mentions, "entity_members": entity_members, "cooc_edges": _edges, "edge_units": edge_units, "relationships": relationships,
        "weighted_degree": lambda s, d: graph.degrees(_edges(s, d)),
        "label_propagation": label_propagation, "communities_in_turn": communities_in_turn, "community_table": community_table, "community_description": community_description, "community_scores": community_scores,
        "concept_names": concept_names, "seed_entities": seed_entities, "local_retrieve": local_retrieve, "local_retrieve_entities": local_retrieve_entities,
        "global_retrieve": global_retrieve, "global_retrieve_entities": global_retrieve_entities, "mode_choice": mode_choice,
        "concept_match": concept_match, "concept_check": concept_check, "concept_types": concept_types, "query_semantics": query_semantics, "sentence_predicates": sentence_predicates, "sentence_facts": sentence_facts,
        "predicate_counts": predicate_counts, "ontology_scores": ontology_scores, "doc_routing": doc_routing, "ontology_topk": ontology_topk,
        "best_sentences": best_sentences, "ontology_sentences": ontology_sentences, "context_pack": context_pack, "format_context": format_context, "compressed_context": compressed_context,
        "llm_context": llm_context, "graph_context": graph_context, "ontology_context": ontology_context, "citations": citations, "inspect_stats": inspect_stats,
    }


def oracle_sql() -> dict:
    return oracles.oracle_sql()
