"""From ranked passages to sentences, contexts and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def best_sentences(ranked: DataFrame, most: int = 5) -> DataFrame:
    """``(query_id, n, sentence)``: by rank of the passage, then words shared with the question, then
    the shorter one; each sentence once; without shared words only if it would be the first.
    ``ranked`` has query_id, question, rank, text and few rows a question."""
    s = ranked.select("query_id", "question", "rank", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    s = s.withColumn("shared", F.size(F.array_intersect(F.array_distinct(T.tokens(F.col("question"))), T.tokens(F.col("sentence")))))
    once = Window.partitionBy("query_id", F.lower("sentence")).orderBy("rank", F.desc("shared"), F.length("sentence"), "pos")
    s = s.withColumn("_d", F.row_number().over(once)).where("_d = 1")
    walk = Window.partitionBy("query_id").orderBy("rank", F.desc("shared"), F.length("sentence"), "pos")
    s = s.withColumn("_w", F.row_number().over(walk)).where("shared > 0 or _w = 1")
    return s.withColumn("n", F.row_number().over(walk)).where(F.col("n") <= most).select("query_id", "n", "sentence")


def citation(document, page, chunk):
    return F.format_string("%s p.%d chunk %d", document, page, chunk)


def packed_context(ranked: DataFrame, budget: int = 6000, truncate: bool = True) -> DataFrame:
    """``(query_id, rank, block)``: passages by rank until the budget of characters is used up; the one
    that passes it is cut (``truncate``) or ends the context."""
    before = F.coalesce(F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = ranked.withColumn("_b", before)
    if truncate:
        x = x.where(F.col("_b") < budget).withColumn("block", F.substring(F.col("block"), F.lit(1), (F.lit(budget) - F.col("_b")).cast("int")))
    else:
        x = x.where(F.col("_b") + F.length("block") <= budget)
    return x.select("query_id", "rank", "block")


def merge_overlapping(df: DataFrame, group: list[str], order: list[str], text: str, most: int = 160, least: int = 10) -> DataFrame:
    """Overlapping passages of a page as one text: of each following passage the words that the text
    already ends with (10 to 160 of them) are left out."""
    g = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("t")))).alias("c"))  # the passages of one page
    ws = F.transform("c", lambda s: T.words(s["t"]))

    def add(acc, w):
        widths = F.sequence(F.least(F.size(acc), F.size(w), F.lit(most)), F.lit(least), F.lit(-1))
        fits = F.filter(widths, lambda n: F.slice(acc, F.greatest(F.size(acc) - n + 1, F.lit(1)), n) == F.slice(w, F.lit(1), n))
        n = F.when(F.least(F.size(acc), F.size(w)) < least, 0).otherwise(F.coalesce(F.get(fits, F.lit(0)), F.lit(0)))
        return F.concat(acc, F.slice(w, n + 1, F.greatest(F.size(w) - n, F.lit(0))))

    return g.select(*group, F.array_join(F.aggregate(ws, F.array().cast("array<string>"), add), " ").alias("text"))


def format_context(ranked: DataFrame, most: int = 2500) -> DataFrame:
    """``(query_id, context)``: rank, citation and the first ``most`` characters of each passage. ``ranked``
    has document, page, chunk_on_page and a few passages a question."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), citation(F.col("document"), F.col("page"), F.col("chunk_on_page")), F.lit("\n"), F.substring(T.clean_text(F.col("text")), 1, most))
    return _joined(ranked.select("query_id", "rank", block.alias("block")))


def _joined(blocks: DataFrame, sep: str = "\n\n") -> DataFrame:
    """The blocks of a question as one context, by rank."""
    return blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), sep).alias("context"))  # within the budget of a context


def compressed(ranked: DataFrame, budget: int = 4500, most: int = 8) -> DataFrame:
    """``(query_id, n, line)``: of each passage the ``most`` sentences that share words with the question, at
    least one; lines until the first that passes the budget."""
    s = ranked.select("query_id", "question", "rank", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    s = s.withColumn("shared", F.size(F.array_intersect(F.array_distinct(T.tokens_dual(F.col("question"))), T.tokens_dual(F.col("sentence")))))
    order = [F.desc("shared"), F.length("sentence"), F.col("pos")]
    once = Window.partitionBy("query_id", "rank", F.lower("sentence")).orderBy(*order)
    s = s.withColumn("_d", F.row_number().over(once)).where("_d = 1")
    walk = Window.partitionBy("query_id", "rank").orderBy(*order)
    s = s.withColumn("_w", F.row_number().over(walk)).where((F.col("shared") > 0) | (F.col("_w") == 1)).withColumn("_w", F.row_number().over(walk)).where(F.col("_w") <= most)
    s = s.withColumn("line", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "sentence"))
    by = Window.partitionBy("query_id").orderBy("rank", "_w")
    s = s.withColumn("_used", F.sum(F.length("line") + 3).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return s.withColumn("n", F.row_number().over(by)).where(F.col("_used") <= budget).select("query_id", "n", "line")


def llm_context(ranked: DataFrame, budget: int = 2500, compressed_budget: int = 4500) -> DataFrame:
    """``(query_id, context)``: the passages within the budget, before them the compressed sentences if they
    still fit."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), citation(F.col("document"), F.col("page"), F.col("chunk_on_page")), F.lit("\n"), F.col("text"))
    blocks = packed_context(ranked.select("query_id", "rank", head.alias("block")), budget)
    used = blocks.groupBy("query_id").agg(F.sum(F.length("block")).alias("used"))
    lines = compressed(ranked, compressed_budget).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: F.concat(F.lit("- "), x["line"])), "\n").alias("c"))
    first = F.concat(F.lit("Compressed relevant sentences:\n"), F.coalesce("c", F.lit("")))
    x = _joined(blocks).join(used, "query_id").join(lines, "query_id", "left")
    return x.select("query_id", F.when(F.col("used") + F.length(first) <= budget, F.concat(first, F.lit("\n\n"), "context")).otherwise(F.col("context")).alias("context"))


def graph_context(ranked: DataFrame, names: DataFrame, near: DataFrame | None = None, budget: int = 7000) -> DataFrame:
    """``(query_id, context)``: the summaries of the communities ``near`` (query_id, n, summary) until one
    does not fit, then passages with up to eight names of their entities ``names`` (chunk_id, rank, name)
    within the budget; the passage that passes it is cut."""
    some = names.where("rank <= 8").groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]), ", ").alias("names"))
    x = ranked.join(some, "chunk_id", "left")
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), citation(F.col("document"), F.col("page"), F.col("chunk_on_page")), F.lit("\nEntities: "), F.coalesce("names", F.lit("")), F.lit("\n"), T.repair_ocr(F.col("text")))
    blocks = x.select("query_id", (F.col("rank") + 1000).alias("rank"), block.alias("block"))
    if near is not None:
        by = Window.partitionBy("query_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        c = near.withColumn("block", F.concat(F.lit("[community "), F.col("n").cast("string"), F.lit("] "), "summary"))
        c = c.withColumn("_used", F.sum(F.length("block")).over(by)).where(F.col("_used") <= budget)
        blocks = c.select("query_id", F.col("n").alias("rank"), "block").unionByName(blocks)
    return _joined(packed_context(blocks, budget))


def ontology_context(ranked: DataFrame, labels: DataFrame, numbers: DataFrame, budget: int = 8000) -> DataFrame:
    """``(query_id, context)``: passages with file, page, article, the verified number of their document
    ``numbers`` (document, document_number) and the labels of their concepts ``labels`` (chunk_id, labels);
    the whole is cut at the budget."""
    x = ranked.join(labels, "chunk_id", "left").join(numbers.groupBy("document").agg(F.min("document_number").alias("document_number")), "document", "left")
    nothing = F.lit("")
    block = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "), "document", F.lit(", trang "), F.col("page").cast("string"),
        F.when(F.coalesce("article", nothing) != "", F.concat(F.lit(", Điều "), "article")).otherwise(nothing),
        F.when(F.coalesce("document_number", nothing) != "", F.concat(F.lit("\nVerified document number from manifest: "), "document_number")).otherwise(nothing),
        F.when(F.coalesce("labels", nothing) != "", F.concat(F.lit("\nOntology concepts: "), "labels")).otherwise(nothing),
        F.lit("\n"), T.repair_ocr(F.col("text")),
    )
    return _joined(x.select("query_id", "rank", block.alias("block"))).select("query_id", F.substring("context", 1, budget).alias("context"))


def ontology_sentences(ranked: DataFrame, most: int = 6) -> DataFrame:
    """``(query_id, n, sentence, rank)``: sentences of 35 characters and more by coverage of the question plus
    0.15 over the rank of the passage; none that cites other documents only, where the question names one;
    each once."""
    refs = T.legal_refs(F.col("question"))
    s = ranked.select("query_id", "rank", F.array_distinct(T.tokens_folded(F.col("question"))).alias("q"), refs.alias("refs"), F.posexplode(F.filter(T.sentences(T.repair_ocr(F.col("text")), wide=False), lambda x: F.length(x) >= 35)).alias("pos", "sentence"))
    own = T.legal_refs(F.col("sentence"))
    s = s.where((F.size("refs") == 0) | (F.size(own) == 0) | F.arrays_overlap("refs", own))
    once = Window.partitionBy("query_id", T.normalized(F.col("sentence"))).orderBy("rank", "pos")
    s = s.withColumn("_d", F.row_number().over(once)).where("_d = 1")
    s = s.withColumn("score", F.round(F.size(F.array_intersect("q", T.tokens_folded(F.col("sentence")))) / F.greatest(F.size("q"), F.lit(1)) + 0.15 / F.col("rank"), 6))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("sentence"), F.desc("rank"))
    return s.withColumn("n", F.row_number().over(by)).where(F.col("n") <= most).select("query_id", "n", "sentence", "rank")
