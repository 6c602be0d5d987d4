"""Problem 2: blocks of lines repeated across the documents of one source.

Lines become identifiers (96 bits of hash of the line's form). The suffix array over a source's
concatenated identifiers is never laid out in one place: it is built by prefix doubling, as a table
of suffixes with their ranks. The rank of the first 2^k lines of a suffix is told by the pair of the
ranks of their two halves, so equal ranks are a common prefix; the rank of any length between 2^k
and 2^(k+1) is told by two ranks of 2^k lines that overlap. Suffixes that begin with a line of too
few documents cannot share a prefix with enough documents and act as the separators between texts,
so after the first level only repeated lines are left, and each level keeps the suffixes whose
prefix stands in enough documents. Doubling goes on until none is left. Then the longest prefix that
each suffix shares with enough documents is found by halving steps, and the blocks are those longest
prefixes that are no rest of a longer one.

Cases: null texts have no lines; a null source is a source of its own; rows with a null document
count as no document but are cleaned too; rows given twice count once; lines of under
``least_letters`` letters never count and end a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, once, sized_join

LEAST_LETTERS, LEAST_DOCUMENTS, LEAST_SHARE = 20, 4, 0.1


def line_form(line):
    """Column: the line without case, digits, white space and signs at its ends."""
    bare = F.regexp_replace(F.lower(line), r"[\p{Nd}\p{Z}\s\p{Cf}]+", "")
    return F.regexp_extract(bare, r"(?s)\p{L}(?:.*\p{L})?", 0)


def lines_of(df: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """``(id, source, document, line_no, k1, k2)`` of every line with enough letters."""
    x = df.where(F.length("text") >= least_letters).select("id", F.coalesce("source", F.lit("")).alias("source"), "document", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    x = x.where(F.length("line") >= least_letters).withColumn("form", line_form(F.col("line"))).where(F.length("form") >= least_letters)
    x = x.where(F.col("form").rlike(rf"^(?:\p{{L}}[^\p{{L}}]*+){{{least_letters}}}"))
    return x.select("id", "source", "document", (F.col("pos") + 1).alias("line_no"), F.xxhash64("form").alias("k1"), F.hash("form").alias("k2"))


def _enough(x: DataFrame, keys: list[str], sizes: DataFrame, least_documents: int, least_share: float) -> DataFrame:
    """``(source, keys, documents)`` of what stands in enough documents of its source. Documents are
    counted twice over (document, then key), so what all documents have is spread over them before
    it is summed."""
    per_doc = x.where("document is not null").select("source", *keys, F.xxhash64("document").alias("d")).distinct()
    n = per_doc.groupBy("source", *keys).agg(F.count("*").alias("documents")).where(F.col("documents") >= least_documents)
    return n.join(sizes, "source").where(F.col("documents") >= F.col("n") * least_share).select("source", *keys, "documents")


def repeated_blocks(df: DataFrame, least_documents: int = LEAST_DOCUMENTS, least_share: float = LEAST_SHARE, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """``(id, source, document, start, lines, block)``: where the longest blocks of lines stand that
    enough documents of the source have; ``block`` is the same for equal blocks."""
    lines = cut(lines_of(df, least_letters))
    sizes = cut(df.where("document is not null").select(F.coalesce("source", F.lit("")).alias("source"), "document").distinct().groupBy("source").agg(F.count("*").alias("n")))
    limits = (sizes, least_documents, least_share)
    keys = cut(_enough(lines, ["k1", "k2"], *limits))
    hits = sized_join(lines, keys.select("source", "k1", "k2"), ["source", "k1", "k2"])
    level = cut(hits.select("id", "source", "document", F.col("line_no").alias("start"), F.xxhash64("k1", "k2").alias("rank")).distinct())
    levels: list[DataFrame] = []
    while not level.isEmpty():
        levels.append(level)
        half = 1 << len(levels) - 1
        second = level.select("id", (F.col("start") - half).alias("start"), F.col("rank").alias("next"))
        pair = level.join(second, ["id", "start"]).select("id", "source", "document", "start", F.xxhash64("rank", "next").alias("rank"))
        good = cut(_enough(pair, ["rank"], *limits))
        level = cut(sized_join(pair, good.select("source", "rank"), ["source", "rank"]).select("id", "source", "document", "start", "rank"))
    if not levels:
        return hits.select("id", "source", "document", F.col("line_no").alias("start"), F.lit(1).alias("lines"), F.col("k1").alias("block"))
    ranks = levels[0].withColumn("k", F.lit(0))
    for k, x in enumerate(levels[1:], 1):
        ranks = ranks.unionByName(x.withColumn("k", F.lit(k)))
    # a suffix has the length of its highest level at least; longer prefixes are tried by halving steps
    state = ranks.groupBy("id", "start").agg(F.max("k").alias("k")).withColumn("lines", F.expr("shiftleft(1, k)"))
    for j in range(len(levels) - 2, -1, -1):
        tried = cut(state.withColumn("longer", F.when(F.col("k") > j, F.col("lines") + (1 << j))))
        of = cut(_of_length(ranks, cut(tried.where("longer is not null").select("k", F.col("longer").alias("lines")).distinct())))
        good = cut(_enough(of, ["k", "lines", "block"], *limits))
        fits = sized_join(of, good.select("source", "k", "lines", "block"), ["source", "k", "lines", "block"]).select("id", "start", "k", F.col("lines").alias("longer"), F.lit(True).alias("fits"))
        state = tried.join(fits, ["id", "start", "k", "longer"], "left").select("id", "start", "k", F.when(F.col("fits"), F.col("longer")).otherwise(F.col("lines")).alias("lines"))
    state = cut(state)
    before = F.lag("lines").over(Window.partitionBy("id").orderBy("start"))  # a text's own lines
    at = F.lag("start").over(Window.partitionBy("id").orderBy("start"))
    longest = state.withColumn("_l", before).withColumn("_s", at).where("_s is null or _s < start - 1 or _l <= lines").select("id", "start", "k", "lines")
    named = _of_length(ranks, cut(longest.select("k", "lines").distinct()))
    return named.join(longest, ["id", "start", "k", "lines"]).select("id", "source", "document", "start", "lines", "block")


def _of_length(ranks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(id, source, document, start, k, lines, block)``: the ranks of the prefixes of the lengths
    ``(k, lines)``, each from two of 2^k lines that cover it. There are at most as many lengths as a
    block has lines."""
    x = ranks.join(F.broadcast(wanted), "k").withColumn("end", F.col("start") + F.col("lines") - F.expr("shiftleft(1, k)"))
    y = ranks.select("id", F.col("k"), F.col("start").alias("end"), F.col("rank").alias("last"))
    return x.join(y, ["id", "k", "end"]).select("id", "source", "document", "start", "k", "lines", F.xxhash64("lines", "rank", "last").alias("block"))


def repeated_lines(df: DataFrame, **limits) -> DataFrame:
    """``(id, line_no)`` of all lines inside repeated blocks."""
    return repeated_blocks(df, **limits).select("id", F.explode(F.expr("sequence(start, start + lines - 1)")).alias("line_no")).distinct()


def block_report(df: DataFrame, **limits) -> DataFrame:
    """``(source, lines, block, documents)``: the longest blocks and in how many documents they stand as such."""
    return repeated_blocks(df, **limits).where("document is not null").groupBy("source", "lines", "block").agg(F.countDistinct("document").alias("documents"))


def strip_repeated(df: DataFrame, **limits) -> DataFrame:
    """``(id, clean_text)``, each id once: every text without its repeated blocks of lines."""
    hits = cut(repeated_lines(df, **limits).groupBy("id").agg(F.collect_set("line_no").alias("_gone")))  # a text's own lines
    out = sized_join(once(df.select("id", "text"), "id"), hits, ["id"], "left", 20_000)
    kept = F.expr("array_join(filter(split(text, '\n'), (x, i) -> not array_contains(_gone, i + 1)), '\n')")
    return out.select("id", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept).alias("clean_text"))
