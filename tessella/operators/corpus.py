"""From documents to passages and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CHUNK, OVERLAP, MIN_PAGE = 450, 80, 40


def chunk_words(df: DataFrame, key: str, text: str, size: int = CHUNK, overlap: int = OVERLAP, min_chars: int = MIN_PAGE) -> DataFrame:
    """``(key, chunk_on_page, chunk_id, text)``: passages of ``size`` words that share ``overlap``
    words; pages of under ``min_chars`` characters are left out. One narrow pass, no shuffle. Ids are the
    key times 2^20 plus the number of the passage, so they stay apart up to a million passages a text."""
    step = max(1, size - overlap)
    x = df.select(F.col(key), T.clean_text(F.col(text)).alias("_t")).where(F.length("_t") >= min_chars)
    x = x.select(key, T.words(F.col("_t")).alias("_w"))
    last = F.ceil(F.greatest(F.size("_w") - size, F.lit(0)) / step).cast("int")
    x = x.select(key, "_w", F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    return x.select(key, (F.col("_i") + 1).alias("chunk_on_page"), (F.shiftleft(F.col(key).cast("bigint"), 20) + F.col("_i")).alias("chunk_id"), F.array_join(F.slice("_w", F.col("_i") * step + 1, F.lit(size)), " ").alias("text"))


def page_counts(df: DataFrame, text: str, min_chars: int = MIN_PAGE) -> DataFrame:
    n = F.length(T.clean_text(F.col(text)))
    return df.agg(F.count("*").alias("pages"), F.count_if(n >= min_chars).alias("kept"), F.count_if(F.coalesce(n, F.lit(0)) < min_chars).alias("skipped"))


def term_counts(chunks: DataFrame, analyser: str = "basic") -> DataFrame:
    return chunks.select("chunk_id", F.explode(T.ANALYSERS[analyser](F.col("text"))).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def doc_freq(chunks: DataFrame, analyser: str = "basic") -> DataFrame:
    """Passages of every term: the terms of a passage are made distinct before anything is shuffled."""
    return chunks.select(F.explode(F.array_distinct(T.ANALYSERS[analyser](F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(chunks: DataFrame, analyser: str = "basic") -> DataFrame:
    n = chunks.select(F.size(T.ANALYSERS[analyser](F.col("text"))).cast("bigint").alias("n")).where("n > 0")
    return n.agg(F.count("*").alias("chunks"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 6).alias("avg_length"))


def document_stats(chunks: DataFrame) -> DataFrame:
    """Pages, pages with text and passages of every file."""
    c = chunks.select("document", "page", "id", (F.length(T.clean_text(F.col("text"))) >= MIN_PAGE).alias("full")).dropDuplicates(["id"])
    return c.groupBy("document").agg(F.countDistinct("page").alias("pages"), F.countDistinct(F.when(F.col("full"), F.col("page"))).alias("text_pages"), F.count("*").alias("chunks"))


def article_segments(df: DataFrame, key: str, text: str, document: str | None = None, order: list[str] | None = None) -> DataFrame:
    """``(key, pos, article, segment)``: a text split before its article headings, which stay with their
    segments. What stands before the first heading belongs to the last article of the pages before it
    (of the same ``document``, by ``order``); without a document a text is on its own."""
    from ..functions.lexicon import ARTICLE

    group, by = (document or key), (order or [])
    x = df.select(*dict.fromkeys([key, group, *by]), F.posexplode(F.split(F.col(text), ARTICLE.replace(")", ")(?=", 1) + ")")).alias("pos", "segment"))
    own = F.nullif(F.regexp_extract("segment", ARTICLE.replace(")", ")^", 1), 1), F.lit(""))
    w = Window.partitionBy(group).orderBy(*by, key, "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return x.select(key, "pos", F.last(own, ignorenulls=True).over(w).alias("article"), "segment").where(F.length(T.strip(F.col("segment"))) >= 20)


def carried_articles(chunks: DataFrame) -> DataFrame:
    """The article a passage belongs to: its own, or the last one named in its file before it."""
    w = Window.partitionBy("document").orderBy("page", "chunk_on_page", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = chunks.select("id", "document", "page", "chunk_on_page", "article").dropDuplicates(["id"])
    return c.select("id", F.last("article", ignorenulls=True).over(w).alias("article"))


def document_quality(df: DataFrame, key: str, text: str) -> DataFrame:
    """Coverage by pages with text, less the share of noisy words; three digits, and a status."""
    ws = F.regexp_extract_all(F.col(text), F.lit(T.WORD), F.lit(0))
    noisy = F.filter(ws, lambda w: (F.length(w) > 2) & ((F.length(F.regexp_replace(w, r"[^\p{L}]+", "")) < F.length(w) * 0.55) | w.rlike(r"\d.*[A-Za-z].*\d")))
    x = df.groupBy(key).agg(F.avg((F.length(T.strip(F.col(text))) >= MIN_PAGE).cast("int")).alias("coverage"), F.sum(F.size(ws)).alias("words"), F.sum(F.size(noisy)).alias("noisy"))
    q = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("coverage") * (1 - F.least(F.lit(0.8), 4.0 * F.col("noisy") / F.greatest(F.col("words"), F.lit(1)))))), 3)
    x = x.select(key, F.coalesce(q, F.lit(0.0)).alias("quality"))
    return x.withColumn("status", F.when(F.col("quality") >= 0.75, "good").when(F.col("quality") >= 0.45, "review").otherwise("poor"))
