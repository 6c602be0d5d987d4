"""``python -m tessella build|ask|inspect``: an index of a folder of PDF files or of a table of pages."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import answer, corpus, graph, retrieval
from .session import cut, session, sized_join
from .sources import files

VARIANTS = ("keyword", "hybrid", "graph")


def build(spark: SparkSession, source: str, index: str, size: int = corpus.CHUNK, overlap: int = corpus.OVERLAP, min_chars: int = corpus.MIN_PAGE) -> None:
    """Passages, entities and edges of a folder of PDF files, or of Parquet pages (document, page, text)."""
    pages = spark.read.parquet(source) if source.endswith(".parquet") else files.extract_pages(files.discover(spark, source))
    pages = pages.select("document", "page", "text").withColumn("page_id", F.xxhash64("document", "page").bitwiseAND(F.lit((1 << 42) - 1)))
    pages = cut(pages)
    if pages.select("page_id").distinct().count() < pages.count():
        raise ValueError("two pages of one document and number, or of equal ids")
    chunks = corpus.chunk_words(pages, "page_id", "text", size, overlap, min_chars).join(pages.select("page_id", "document", "page"), "page_id").drop("page_id")
    found = graph.entities(chunks, "chunk_id", "text")
    files.save_index(index, {"source": source, "size": str(size), "overlap": str(overlap)}, chunks=chunks, entities=found, edges=graph.edges(found.select(F.col("chunk_id").alias("unit"), "key", "n")))


def ask(spark: SparkSession, index: str, question: str, variant: str = "keyword", k: int = 5) -> DataFrame:
    """The ranked passages of one question with their best sentences."""
    t = files.load_index(spark, index, "chunks", "entities")
    q = spark.createDataFrame([(1, question)], "query_id bigint, question string")
    if variant == "hybrid":
        top = retrieval.hybrid(t["chunks"], q, k=k)
    elif variant == "graph":
        top = graph.local(q, t["chunks"], t["entities"], retrieval.bm25(t["chunks"], q, "folded"), k=k)
    else:
        top = retrieval.top_k(retrieval.bm25(t["chunks"], q, "basic", k), k)
    return sized_join(t["chunks"], top.select("query_id", "rank", "chunk_id", "score"), ["chunk_id"]).join(q, "query_id")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="tessella")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("source")
    b.add_argument("index")
    a = sub.add_parser("ask")
    a.add_argument("index")
    a.add_argument("question")
    a.add_argument("--variant", choices=VARIANTS, default="keyword")
    a.add_argument("--top", type=int, default=5)
    i = sub.add_parser("inspect")
    i.add_argument("index")
    args = p.parse_args(argv)
    spark = session()
    if args.command == "build":
        build(spark, args.source, args.index)
    elif args.command == "ask":
        r = ask(spark, args.index, args.question, args.variant, args.top).cache()
        for x in answer.best_sentences(r).orderBy("n").collect():
            print("-", x["sentence"])
        for x in r.select("rank", "score", answer.citation(F.col("document"), F.col("page"), F.col("chunk_on_page")).alias("c"), F.substring("text", 1, 420).alias("t")).orderBy("rank").collect():
            print(f"[{x['rank']}] {x['c']} score={x['score']}\n    {x['t']}")
    else:
        t = files.load_index(spark, args.index, "chunks", "entities", "edges")
        print("documents", t["chunks"].select("document").distinct().count(), *(f"{n} {df.count()}" for n, df in t.items()))


if __name__ == "__main__":
    main()
