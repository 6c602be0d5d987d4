"""The queries of problems 1 to 10, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table
from . import abuse, bpe, forms, neardup, packing, pieces, quality, repeated, scans, sentences


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noise(table(spark, d, "chunks").select("id", "source", "document", "page", "text"))


def p1_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return scans.paragraphs(table(spark, d, "chunks").select("id", "source", "document", "page", "text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated.repeated_lines(table(spark, d, "chunks").select("id", "source", "document", "text"))


def p2_blocks(spark: SparkSession, d: str) -> DataFrame:
    return repeated.block_report(table(spark, d, "chunks").select("id", "source", "document", "text"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return repeated.strip_repeated(table(spark, d, "chunks").select("id", "source", "document", "text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.judged(table(spark, d, "chunks"), lang="lang").where("kind is not null").select("id", "kind")


def p3_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.judged(table(spark, d, "chunks"), lang="lang")


def p4_sentences(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select("id", "text", "lang")
    models = sentences.learn(cut(sentences.statistics(chunks, "text", "lang")))
    asked = table(spark, d, "sentence_sample").select("id").distinct()
    return sentences.split_sentences(chunks.join(asked, "id", "left_semi"), models)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_sentences(spark, d).select("id", "start_pos")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    chunks = forms.lookalike_pairs(table(spark, d, "chunks"), "id", "text", 6)
    names = table(spark, d, "banking_ontology").select("concept_no", F.explode("aliases").alias("alias"))
    concepts = forms.lookalike_pairs(names, "concept_no", "alias")
    return chunks.select(F.lit("chunks").alias("tab"), "id_a", "id_b").unionByName(concepts.select(F.lit("banking_ontology").alias("tab"), "id_a", "id_b"))


def p5_forms(spark: SparkSession, d: str) -> DataFrame:
    """The form of every chunk and of every alias, an alias once for each concept and spelling."""
    chunks = table(spark, d, "chunks").select(F.lit("chunks").alias("tab"), "id", "text").dropDuplicates(["id"])
    names = table(spark, d, "banking_ontology").select(F.lit("banking_ontology").alias("tab"), F.col("concept_no").alias("id"), F.explode("aliases").alias("text")).distinct()
    return forms.canonicalise(chunks.unionByName(names), "text", "form").select("tab", "id", "form")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces.cut_oversized(table(spark, d, "chunks").select("id", "text", "lang"), table(spark, d, "size_limits")).where("piece_no = 2").select("id")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.recut_pages(table(spark, d, "chunks"), table(spark, d, "size_limits"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, d, "chunks"), "id", "text")


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_groups(table(spark, d, "chunks"), "id", "text")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    items = bpe.count_tokens(documents, "doc_id", "text")
    return packing.fill_containers(items, table(spark, d, "pack_limits"), "doc_id", "tokens", rows=documents.count())


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, d), table(spark, d, "pack_limits"), "doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return abuse.scored(documents, abuse.learn(documents, table(spark, d, "review_labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_scores(spark, d).where(F.col("score") >= abuse.LEAST_SHARE).select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(table(spark, d, "documents"), p10_scores(spark, d))


def queries() -> dict:
    return {
        "p1_found": p1_found, "p1_paragraphs": p1_paragraphs, "p2_found": p2_found, "p2_blocks": p2_blocks, "p2_clean": p2_clean, "p3_found": p3_found, "p3_statistics": p3_statistics, "p4_found": p4_found, "p4_sentences": p4_sentences,
        "p5_found": p5_found, "p5_forms": p5_forms,
        "p6_found": p6_found, "p6_pieces": p6_pieces, "p7_found": p7_found, "p7_groups": p7_groups, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_report": p9_report,
        "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates,
    }


def oracle_sql() -> dict:
    return {
        "p6_found": """SELECT DISTINCT c.id AS id FROM chunks c LEFT JOIN size_limits s ON s.lang = c.lang
            CROSS JOIN (SELECT max_chars FROM size_limits WHERE lang = 'und') u WHERE length(c.text) > coalesce(s.max_chars, u.max_chars)""",
    }
