"""Problem 6: cutting oversized texts at natural boundaries.

A text is parsed into a tree: chapters, sections, articles and clauses by the rank of their headings,
paragraphs in them, items of lists in these (by indentation); below stand lines, sentences, clauses,
words and characters, which are only looked at inside a node that is still too large. Only nodes over
the limit are opened; the parts that come out are merged again with their siblings, bottom-up, as long
as they stay under the limit. Every piece but the first begins with the last ``overlap_chars``
characters of its predecessor, exactly, so an overlap may begin inside a word.

Cases: null texts give no piece, texts under the limit one piece (the text itself, be it empty); an
overlap of half the limit or more cannot leave room for new text and is shortened to half the limit,
which ``overlap_of`` reports; a language without a row of limits takes the row ``und``. Rows repeated
with the same id count once. Other columns pass through.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, once, sized_join

# Words that open a numbered heading, by language of the corpus.
HEADING = r"(?:#{1,6} |(?:Điều|Khoản|Mục|Chương|Article|Section|Artikel|Abschnitt|Artículo|Sección|अनुच्छेद|धारा|المادة|ข้อ|มาตรา) ?\d|第 ?\d+ ?[条章節节])"
# The same by rank, with chapters, outermost first.
RANKS = [
    r"(?:Chương|Chapter|Kapitel|Chapitre|Capítulo|अध्याय|الفصل|บทที่) ?[\dIVXLC]|第 ?\d+ ?章",
    r"(?:Mục|Section|Abschnitt|Sección|धारा|القسم|หมวด) ?\d|第 ?\d+ ?[節节]",
    r"(?:Điều|Article|Artikel|Artículo|अनुच्छेद|المادة|ข้อ|มาตรา) ?\d|第 ?\d+ ?[条條]",
    r"(?:Khoản|Clause|Absatz|Alinéa|Apartado) ?\d",
]
_ranks = re.compile("|".join(f"({r})" for r in RANKS))
_marks = re.compile(r"(#{1,6}) ")
_item = re.compile(r"([ \t]*)(?:[-•*–·▪]|\(?(?:\d{1,3}|[a-zđ]|[ivx]{1,4})[.)])\s")
#: Ranks of the nodes of a tree: headings from 1 (# marks) and 7 (words), paragraphs, items by indentation.
WORDS, PARAGRAPH, ITEM = 7, 20, 21
#: Ways to open a node that has no nodes below it, outermost first; a cut is made after the match.
LEVELS = [
    re.compile(r"\n"),
    re.compile(r"(?:[.!?…][”\"»’)\]]*\s+)|(?:[。！？｡][”」』）]*)|(?:[।؟]\s*)"),
    re.compile(r"[;:,،；，、|]\s*"),
    re.compile(r"\s+"),
]


def openers(text: str) -> list[tuple[int, int]]:
    """``(start, rank)`` of all nodes of the tree of a text, by start: a node goes on to the next one of
    its rank or above."""
    out, at, blank, headed = [], 0, True, False
    for line in text.split("\n"):
        bare = line.lstrip()
        rank = None
        if not bare:
            blank = True
        elif m := _marks.match(bare):
            rank = len(m[1])
        elif m := _ranks.match(bare):
            rank = WORDS + m.lastindex - 1
        elif m := _item.match(line):
            rank = ITEM + min(len(m[1].expandtabs(4)), 40)
        elif blank or headed:
            rank = PARAGRAPH
        if rank is not None:
            out.append((at, rank))
        if bare:
            blank, headed = False, rank is not None and rank < PARAGRAPH
        at += len(line) + 1
    return out


def _merge(spans: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and b - out[-1][0] <= limit:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _open(text: str, a: int, b: int, level: int, limit: int) -> list[tuple[int, int]]:
    """The parts of a node without nodes below it."""
    if b - a <= limit:
        return [(a, b)]
    if level == len(LEVELS):
        spans, at = [], a
        while b - at > limit:
            to = at + limit
            while to > at + 1 and unicodedata.category(text[to])[0] == "M":  # a mark stays with its letter
                to -= 1
            spans.append((at, to))
            at = to
        return [*spans, (at, b)]
    spans, at = [], a
    for m in LEVELS[level].finditer(text, a, b):
        if at < m.end() < b:
            spans.append((at, m.end()))
            at = m.end()
    spans.append((at, b))
    return _merge([p for s in spans for p in _open(text, *s, level + 1, limit)], limit)


def _pack(text: str, a: int, b: int, nodes: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """The parts of a node; ``nodes`` are those that begin inside it."""
    if b - a <= limit:
        return [(a, b)]
    if not nodes:
        return _open(text, a, b, 0, limit)
    top = min(rank for _, rank in nodes)
    cuts = [i for i, (_, rank) in enumerate(nodes) if rank == top]
    parts = _pack(text, a, nodes[cuts[0]][0], nodes[: cuts[0]], limit) if nodes[cuts[0]][0] > a else []
    for i, k in zip(cuts, [*cuts[1:], len(nodes)], strict=True):
        parts += _pack(text, nodes[i][0], nodes[k][0] if k < len(nodes) else b, nodes[i + 1 : k], limit)
    return _merge(parts, limit)


def overlap_of(max_chars: int, overlap_chars: int) -> int:
    """The overlap that is used: at most half the limit."""
    return min(overlap_chars, max_chars // 2)


def cut_text(text: str, max_chars: int, overlap_chars: int) -> list[tuple[int, int, int]]:
    """Pieces as ``(start, body, end)``: the piece is ``text[start:end]``, new from ``body`` on."""
    if len(text) <= max_chars:
        return [(0, 0, len(text))]
    overlap = overlap_of(max_chars, overlap_chars)
    limit = max(1, max_chars - overlap)
    spans = _pack(text, 0, len(text), openers(text), limit)
    if len(spans) > 1 and spans[1][1] <= max_chars:  # the first piece has no overlap to carry
        spans[:2] = [(0, spans[1][1])]
    return [(max(0, a - overlap) if a else 0, a, b) for a, b in spans]


def with_limits(df: DataFrame, limits: DataFrame, lang: str = "lang") -> DataFrame:
    """``df`` with ``_max`` and ``_overlap``. The limits table has one row a language: it is sent
    as a literal map after a check that it is small."""
    rows = limits.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("size limits: more languages than there are")
    known = {r["lang"]: (r["max_chars"], r["overlap_chars"]) for r in rows}
    if "und" not in known:
        raise ValueError("size limits: no row 'und'")
    m = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("m"), F.lit(v[1]).alias("o")))])
    at = F.coalesce(F.try_element_at(m, F.coalesce(F.col(lang), F.lit("und"))), F.try_element_at(m, F.lit("und")))
    return df.withColumn("_max", at["m"]).withColumn("_overlap", at["o"])


def cut_oversized(df: DataFrame, limits: DataFrame, key: str = "id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(key, piece_no, start_pos, piece)`` of the rows over their limit, whole texts, each id once.
    Everything but the cutting itself is done before Python sees a row."""
    src = with_limits(df, limits, lang).where(F.length(text) > F.col("_max"))
    src = src.select(F.col(key).alias("_k"), F.col(text).alias("_t"), "_max", "_overlap")

    def work(batches):
        for b in batches:
            at, no, start, piece = [], [], [], []
            for i, (t, m, o) in enumerate(zip(*(b.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                for k, (x, _, y) in enumerate(cut_text(t, m, o)):
                    at.append(i)
                    no.append(k + 1)
                    start.append(x + 1)
                    piece.append(t[x:y])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(no, pa.int32()), pa.array(start, pa.int32()), pa.array(piece, pa.string())], names=["_k", "piece_no", "start_pos", "piece"])

    kind = src.schema["_k"].dataType.simpleString()
    out = src.mapInArrow(work, f"_k {kind}, piece_no int, start_pos int, piece string")
    return out.dropDuplicates(["_k", "piece_no"]).withColumnRenamed("_k", key)


def recut_pages(df: DataFrame, limits: DataFrame, block: int = 256) -> DataFrame:
    """All chunks as pieces within their limits, numbered anew in ``chunk_on_page`` within
    ``(document, page)``: by the old number, then id. Texts of null are dropped.

    The new numbers are a running count in two steps (blocks of old numbers, then rows of a
    block), so that no page of any size is gathered in one place."""
    cols = ["id", "source", "document", "page", "chunk_on_page", "text", "lang"]
    base = once(df.select(*cols).where("text is not null"), "id")
    limited = with_limits(base, limits)
    parts = cut(cut_oversized(base, limits))
    n = parts.groupBy("id").agg(F.count("*").alias("n"))
    pos = base.select("id", "document", "page", "chunk_on_page").join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    pos = cut(pos.withColumn("blk", F.coalesce(F.floor(F.col("chunk_on_page") / block), F.lit(-1))))
    page = ["document", "page"]
    sums = pos.groupBy(*page, "blk").agg(F.sum("n").alias("bn"))
    sums = sums.withColumn("before", F.coalesce(F.sum("bn").over(Window.partitionBy(*page).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = Window.partitionBy(*page, "blk").orderBy("chunk_on_page", "id").rowsBetween(Window.unboundedPreceding, -1)
    pos = pos.withColumn("inside", F.coalesce(F.sum("n").over(run), F.lit(0)))
    on = (pos.document.eqNullSafe(sums.document)) & (pos.page.eqNullSafe(sums.page)) & (pos.blk == sums.blk)
    first = cut(pos.join(sums, on).select(pos.id, (sums.before + pos.inside).alias("first")))
    # the numbers (16 bytes a row) go to the texts, not the texts to the numbers
    whole = limited.where(F.length("text") <= F.col("_max")).select("id", "source", "document", "page", F.lit(1).alias("piece_no"), F.lit(1).alias("start_pos"), "text")
    cutted = sized_join(base.select("id", "source", "document", "page"), parts.select("id").distinct(), ["id"], "left_semi").join(parts.withColumnRenamed("piece", "text"), "id").select(*whole.columns)
    out = sized_join(whole.unionByName(cutted), first, ["id"], rows=2_000_000)
    return out.select("id", "source", "document", "page", (F.col("first") + F.col("piece_no")).cast("int").alias("chunk_on_page"), "piece_no", "start_pos", "text")
