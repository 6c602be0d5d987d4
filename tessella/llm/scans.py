"""Problem 1: noise in text from scanned pages.

One pass counts the words of the whole corpus (per task, before the shuffle). From the counts come
two dictionaries, both made by joins, not in memory: words that are a rare misreading of a frequent
word (one confusion of :data:`CONFUSIONS` undone gives a word many times as frequent), and words
broken at a line end, told from words that have their hyphen anyway by the counts of the joined, the
hyphenated and the single forms. A second pass over the texts finds page-number lines, candidates of
running headers, line breaks inside words and all words that are not among the most frequent ones;
the last two are joined with the dictionaries.

Running headers are compared by a skeleton that is equal for a line and its misreadings (accents,
page suffix and the two sides of each confusion left aside), so fuzzy repetition within a document
is an ordinary aggregation; lines that many documents of a source share are not headers.

Cases: null and blank texts have no noise; rows given twice count once; a null document or page is a
document or page of its own; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, sized_join
from .forms import _newline, visual_form
from .pieces import HEADING
from .quality import _mojibake

# What a scanner takes for which letters: as read, then as printed.
CONFUSIONS = {
    "0": "o", "1": "l i", "!": "i l", "|": "l i", "5": "s", "8": "b", "4": "a á ả ấ ạ", "6": "é ó ô ổ b", "9": "g",
    "c": "e", "b": "h", "f": "t", "g": "ệ ợ", "m": "rn", "q": "ạ", "é": "ể ế", "u": "ư", "j": "ị í",
    "ri": "n", "cl": "d", "li": "h", "rn": "m", "vv": "w", "ii": "ü",
}
#: A misreading is at most one in so many of its word; with a figure or sign inside it needs less proof.
RATIO, RATIO_SIGN = 15, 2
#: Least occurrences of the word that was meant: outright and as a share of all words.
LEAST, LEAST_SHARE = 8, 1.5e-5
#: A passage with a smaller share of frequent words is junk: its words are not misreadings.
LEAST_FREQUENT = 0.5
#: Words that are surely no misreadings and not looked up; the list is sent to every task.
FREQUENT = 2000

_LATIN = "A-Za-zÀ-ÖØ-öø-ɏḀ-ỿ"
_word = re.compile(rf"[0-9{_LATIN}]+(?:[!|][0-9{_LATIN}]+)*")
_pure = re.compile(rf"[{_LATIN}]+$")
_hyphened = re.compile(rf"[{_LATIN}]+(?:-[{_LATIN}]+)+")
#: A line that ends in a letter and a hyphen, and the beginnings of the next two lines.
_break = re.compile(r"(-?)\b([^\W\d_]+)[-\u2010\u2011\u00ad][ \t\u00a0]*\n[ \t]*([^\W\d_]*)(?=(-?)[^\n]*(?:\n[ \t]*([^\W\d_]*))?)")
_page_line = re.compile(r"(?:(?:page|p|trang|tr|seite|s|página|pág|pag)\.? ?(\d{1,4})(?: ?(?:of|/|von|de|sur) ?\d{1,4})?|[-–—\[(] ?(\d{1,4}) ?[-–—\])]|(\d{1,4}) ?/ ?\d{1,4}|第? ?(\d{1,4}) ?[页頁])$", re.I)
_bare = re.compile(r"\d{1,4}$")
_roman = re.compile(r"(?=[ivxlc])(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$", re.I)
_roman_values = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_suffix = re.compile(r"(?:\s*\|\s*|\s{2,}|\s+)(?:(?:p|tr|page|trang|seite|s)\.?\s*)?\d{1,4}$", re.I)
_running = re.compile(r"\S\s+[—·]\s+\S")
_number = re.compile(r"(?<![^\W_])\d[\d.,:/-]*(?![^\W_])")
_closing = re.compile(r"[.!?;:,…][”\"»’)]*$")
_heading = re.compile(HEADING)
#: Lines that stay lines: items of a list and rows of a table.
_item = re.compile(r"(?:[-•*–·]|\(?(?:\d{1,2}|[a-zđ])[.)])\s|.*(?:\t| \| )")
#: The end of a line and the sign after it with no blank between: a hyphen that stays, signs written without blanks.
_unspaced = re.compile("[^\\W\\d_][-\u2010\u2011][^\\W\\d_]|.?[\u0e00-\u0e7f\u2e80-\u9fff\uff00-\uffef]{2}$")
_classes = [("vv", "w"), ("ri", "n"), ("cl", "d"), ("li", "h"), ("rn", "m"), ("ii", "u")]
_folded = str.maketrans({"c": "e", "g": "e", "6": "e", "0": "o", "b": "h", "f": "t", "1": "i", "!": "i", "l": "i", "j": "i", "|": "i", "5": "s", "4": "a", "q": "a", "đ": "d"})
_not_skeleton = re.compile(r"[^a-zß-\U0010ffff0-9!|]+")


def skeleton(line: str) -> str:
    """A form of a line that is the same for its misreadings."""
    x = unicodedata.normalize("NFD", _number.sub("", _suffix.sub("", line)).lower())
    x = "".join(c for c in x if not "̀" <= c <= "ͯ")
    x = _not_skeleton.sub("", x)
    for a, b in _classes:
        x = x.replace(a, b)
    x = x.translate(_folded)
    for a, b in _classes:
        x = x.replace(a, b)
    return x


def _words(text: str) -> list[str]:
    return [w for w in _word.findall(text) if len(w) > 1 and not w.isdigit()]


def word_counts(df: DataFrame, column: str) -> DataFrame:
    """``(key, n)``: occurrences of every word, and of every hyphenated pair ``a-b`` inside a line.
    Words broken at line ends are left out."""

    def count(batches):
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if not t:
                    continue
                if _mojibake.search(t):
                    continue
                t = _break.sub("\n", t) if "-" in t or "­" in t or "‐" in t else t
                t = visual_form(t).lower()
                c.update(_words(t))
                if "-" in t:
                    for x in _hyphened.findall(t):
                        p = x.split("-")
                        c.update(f"{a}-{z}" for a, z in zip(p, p[1:], strict=False))
        keys = list(c)
        for k in range(0, len(keys), 50_000):
            part = keys[k : k + 50_000]
            yield pa.RecordBatch.from_pydict({"key": pa.array(part, pa.string()), "n": pa.array([c[x] for x in part], pa.int64())})

    return df.select(F.col(column).cast("string").alias("t")).mapInArrow(count, "key string, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def corrections(word: str) -> list[str]:
    """What the word may have been before one misreading."""
    out = []
    for bad, goods in CONFUSIONS.items():
        at = word.find(bad)
        while at >= 0:
            out += [word[:at] + g + word[at + len(bad) :] for g in goods.split()]
            at = word.find(bad, at + 1)
    return list(dict.fromkeys(out))


def misreadings(counts: DataFrame) -> DataFrame:
    """``(word, correction)`` for all words that are a misreading of a frequent word."""

    def propose(batches):
        for b in batches:
            w, g, n = [], [], []
            for x, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(x) >= 3 and "-" not in x:
                    for y in corrections(x):
                        if _pure.match(y):
                            w.append(x)
                            g.append(y)
                            n.append(m)
            yield pa.RecordBatch.from_pydict({"word": pa.array(w, pa.string()), "key": pa.array(g, pa.string()), "m": pa.array(n, pa.int64())})

    sign = F.col("word").rlike("[0-9!|]")
    p = counts.select("key", "n").mapInArrow(propose, "word string, key string, m bigint")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hit = p.join(counts, "key").where(F.col("n") >= max(LEAST, total * LEAST_SHARE)).where(F.when(sign, F.col("n") >= F.col("m") * RATIO_SIGN).otherwise(F.col("n") >= F.col("m") * RATIO))
    return hit.groupBy("word").agg(F.max_by("key", F.struct("n", "key")).alias("correction"))


def marks(df: DataFrame, frequent: set[str]) -> DataFrame:
    """What the second pass finds, one row an event: ``(id, document, source, page, what, a, b, c)``.
    what: ``page_no``; ``line`` (a candidate of a header, a: skeleton, b: is it of the form of a
    running head); ``break`` (a, b, c: the half word and the beginnings of the next lines); ``word``."""
    src = df.select(F.col("id").alias("id"), F.col("document"), F.coalesce("source", F.lit("")).alias("source"), "page", F.col("text").cast("string").alias("text")).where("text is not null")
    kinds = [src.schema[c].dataType.simpleString() for c in ("id", "document", "source", "page")]

    def work(batches):
        for b in batches:
            at, what, a, c2, c3 = [], [], [], [], []

            def add(i, w, x, y=None, z=None):
                at.append(i)
                what.append(w)
                a.append(x)
                c2.append(y)
                c3.append(z)

            for i, (page, t) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                v = visual_form(t)
                if not v:
                    continue
                low = v.lower()
                if "-" in t or "­" in t or "‐" in t or "‑" in t:
                    for m in _break.finditer(t):
                        if not m[1] and not m[4] and (m[3] or m[5]):  # no part of a longer chain of hyphens
                            add(i, "break", visual_form(m[2]).lower(), visual_form(m[3]).lower(), visual_form(m[5] or "").lower())
                words = _words(low)
                rare = [w for w in words if w not in frequent]
                readable = len(rare) <= (1 - LEAST_FREQUENT) * len(words) and 2 * sum(map(len, words)) >= sum(map(len, v.split())) and not _mojibake.search(t)
                if readable:
                    for w in dict.fromkeys(rare):
                        add(i, "word", w)
                lines = [x.strip() for x in v.split("\n")]
                last = len(lines) - 1
                for k, x in enumerate(lines):
                    if len(x) <= 16 and (_bare.match(x) or _page_line.match(x) or _roman.match(x)):
                        if (n := is_page_line(x, page)) is not None:
                            add(i, "page_no", n)
                    elif readable and 12 <= len(x) <= 200 and not _closing.search(x):
                        form = _running.search(x) is not None
                        if (form or k < 2 or k > last - 2) and not _heading.match(x):
                            s = skeleton(x)
                            if len(s) >= 8:
                                add(i, "line", s, "r" if form else "", None)
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(where) for k in range(4)), *(pa.array(x, pa.string()) for x in (what, a, c2, c3))], names=["id", "document", "source", "page", "what", "a", "b", "c"])

    return src.mapInArrow(work, "id {}, document {}, source {}, page {}, what string, a string, b string, c string".format(*kinds))


def evidence(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the second pass finds, the word counts and the misreadings."""
    counts = cut(word_counts(df, "text"))
    wrong = cut(misreadings(counts))
    frequent = {r["key"] for r in counts.where("key not like '%-%'").join(wrong.withColumnRenamed("word", "key"), "key", "left_anti").orderBy(F.desc("n"), "key").limit(FREQUENT).collect()}
    return cut(marks(df, frequent)), counts, wrong


def noise(df: DataFrame) -> DataFrame:
    """``(id, kind)`` for every chunk and kind of noise."""
    return kinds_of(*evidence(df))


def repairs(found: DataFrame, counts: DataFrame, wrong: DataFrame) -> DataFrame:
    """``(id, fixes)``: what is wrong in a chunk, as arrays ``(what, a, b, c, to)``."""
    page_no = found.where("what = 'page_no'").select("id", "what", "a", "b", "c", F.lit(None).cast("string").alias("to"))
    misread = sized_join(found.where("what = 'word'"), wrong.withColumnRenamed("word", "a"), ["a"]).select("id", "what", "a", "b", "c", F.col("correction").alias("to"))
    breaks = found.where("what = 'break'")
    broken = sized_join(breaks, cut(judge_breaks(breaks, counts)), ["a", "b", "c"]).select("id", "what", "a", "b", "c", F.col("word").alias("to"))
    lines = found.where("what = 'line'")
    header = lines.withColumn("k", F.xxhash64("a")).join(header_lines(lines).distinct(), ["id", "k"], "left_semi").select("id", F.lit("line").alias("what"), "a", *[F.lit(None).cast("string").alias(c) for c in ("b", "c", "to")])
    fixes = page_no.unionByName(misread).unionByName(broken).unionByName(header).distinct()
    return fixes.groupBy("id").agg(F.collect_list(F.struct("what", "a", "b", "c", "to")).alias("fixes"))  # a text's own


def paragraphs(df: DataFrame) -> DataFrame:
    """``(id, text)`` for every chunk: without the header and page-number lines found, broken words
    joined, misread words corrected, and the lines of a paragraph joined by blanks. Paragraphs end at
    blank lines, headings and lists begin a line of their own. Null stays null."""
    fixes = cut(repairs(*evidence(df)))
    texts = df.select("id", "page", F.col("text").cast("string").alias("text")).dropDuplicates(["id"])
    x = sized_join(texts, fixes, ["id"], "left", 20_000).select("id", "page", "text", "fixes")

    def work(batches):
        for b in batches:
            out = [None if t is None else mended(t, page, f or []) for page, t, f in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "text"])

    return x.mapInArrow(work, f"id {x.schema['id'].dataType.simpleString()}, text string")


def is_page_line(line: str, page: int | None) -> str | None:
    """The number, if the line holds nothing but the page number."""
    if len(line) <= 16 and (m := _bare.match(line) or _page_line.match(line)):
        n = next((g for g in m.groups() if g), line)
        if m.re is _page_line or (page is not None and int(n) == page):
            return n
    elif page is not None and len(line) <= 16 and _roman.match(line) and roman(line) == page:
        return line
    return None


def roman(number: str) -> int:
    """The value of a Roman numeral under 100."""
    v = [_roman_values[c] for c in number.lower()]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0], strict=True))


def _like(word: str, pattern: str) -> str:
    """The word in the case of the pattern."""
    if len(pattern) > 1 and pattern.upper() == pattern and pattern.lower() != pattern:
        return word.upper()
    return word[:1].upper() + word[1:] if pattern[:1].isupper() else word


def mended(text: str, page: int | None, fixes: list[dict]) -> str:
    """A text without the noise that ``fixes`` names."""
    of = lambda what: [f for f in fixes if f["what"] == what]
    heads, words = {f["a"] for f in of("line")}, {f["a"]: f["to"] for f in of("word")}
    breaks = {(f["a"], f["b"], f["c"]): f["to"] for f in of("break")}
    low = lambda x: visual_form(x or "").lower()
    text = _newline.sub("\n", text)
    if breaks:
        # the second half goes up to its first half, from the next line or from the one after a
        # header or page number; it is taken from the end so that places stay right
        for m in reversed(list(_break.finditer(text))):
            a, b, c = low(m[2]), low(m[3]), low(m[5])
            to = None if m[1] or m[4] else breaks.get((a, b, c))
            if to is None:
                continue
            k = 3 if b and to == a + b else 5
            start, end = m.span(k)
            whole = m[2] + m[k]
            while end < len(text) and text[end] in ".,;:!?)”\"»’":
                whole, end = whole + text[end], end + 1
            text = text[: m.start(2)] + whole + text[m.end(2) + 1 : start] + text[end:].lstrip(" \t")
    numbered, kept = bool(of("page_no")), []
    for line in text.split("\n"):
        line = line.strip()
        if line and (numbered or heads or words):
            v = visual_form(line)
            if numbered and is_page_line(v, page) is not None:
                continue
            if heads and 12 <= len(v) <= 200 and skeleton(v) in heads:
                continue
            if any(w in words and w not in _words(line.lower()) for w in _words(v.lower())):
                line = v
        kept.append(line)
    if words:
        swap = lambda m: _like(words[low(m[0])], m[0]) if low(m[0]) in words else m[0]
        kept = [_word.sub(swap, x) for x in kept]
    out, new = [], True
    for line in kept:
        if not line:
            new = True
            continue
        alone = _heading.match(line) is not None
        if new or alone or _item.match(line):
            out.append(line)
        else:
            out[-1] += ("" if _unspaced.match(out[-1][-2:] + line[0]) else " ") + line
        new = alone and len(line) <= 80 and not _closing.search(line)
    return "\n\n".join(out)


def kinds_of(found: DataFrame, counts: DataFrame, wrong: DataFrame) -> DataFrame:
    page_no = found.where("what = 'page_no'").select("id", F.lit("page_no").alias("kind"))
    misread = sized_join(found.where("what = 'word'").select("id", F.col("a").alias("word")), wrong.select("word"), ["word"], "left_semi").select("id", F.lit("misread").alias("kind"))
    broken = cut(judge_breaks(found.where("what = 'break'"), counts))
    hyphen = sized_join(found.where("what = 'break'").select("id", "a", "b", "c"), broken.select("a", "b", "c"), ["a", "b", "c"], "left_semi").select("id", F.lit("hyphen").alias("kind"))
    header = header_lines(found.where("what = 'line'")).select("id", F.lit("header").alias("kind"))
    return page_no.unionByName(misread).unionByName(hyphen).unionByName(header).distinct()


def judge_breaks(breaks: DataFrame, counts: DataFrame) -> DataFrame:
    """The kinds of breaks ``(a, b, c)`` that are broken words, with the joined ``word``. The joined
    word is known: it is one. The hyphenated form is known, or both halves are, or the same two
    halves meet at line ends again and again: it has its hyphen anyway. Else: it is one."""
    kinds = breaks.groupBy("a", "b", "c").agg(F.count("*").alias("times"))
    pairs = breaks.groupBy("a", "b").agg(F.count("*").alias("meet"))
    roles = {"ab": F.concat("a", "b"), "ac": F.concat("a", "c"), "hb": F.concat_ws("-", "a", "b"), "hc": F.concat_ws("-", "a", "c"), "wa": F.col("a"), "wb": F.col("b"), "wc": F.col("c")}
    keys = kinds.select("a", "b", "c", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), k.alias("key")) for r, k in roles.items()])).alias("x")).select("a", "b", "c", "x.role", "x.key")
    n = keys.join(counts, "key", "left").groupBy("a", "b", "c").agg(*[F.max(F.when(F.col("role") == r, F.coalesce("n", F.lit(0)))).alias(r) for r in roles]).join(pairs, ["a", "b"])
    near = (F.col("b") != "") & (F.col("ab") > F.col("hb"))
    far = (F.col("c") != "") & (F.col("ac") > F.col("hc")) & ((F.col("b") == "") | (F.col("ab") == 0))
    other = F.when(F.col("b") != "", F.col("wb")).otherwise(F.col("wc"))
    own = (F.col("hb") > 0) | ((F.col("c") != "") & (F.col("hc") > 0)) | (((F.col("wa") > 0) | (F.length("a") == 1)) & (other > 0)) | ((F.col("b") != "") & (F.col("meet") >= 3))
    word = F.when(near, F.concat("a", "b")).when(far, F.concat("a", "c")).when(~own, F.concat("a", F.when(F.col("b") != "", F.col("b")).otherwise(F.col("c"))))
    return n.select("a", "b", "c", word.alias("word")).where("word is not null")


def header_lines(lines: DataFrame) -> DataFrame:
    """``(id, k)``, k the hash of the skeleton: lines that are a running header of their document: repeated on other pages of it,
    or of the form of a running head, and no property of the source (under 3 documents have it)."""
    k = lines.select("id", F.coalesce(F.col("document"), F.lit("")).alias("document"), "source", "page", F.xxhash64("a").alias("k"), (F.col("b") == "r").alias("r")).distinct()
    per_doc = k.groupBy("source", "k", "document").agg(F.countDistinct("page").alias("pages"), F.max("r").alias("r"))
    docs = per_doc.groupBy("source", "k").agg(F.count("*").alias("docs"))
    good = cut(per_doc.join(docs, ["source", "k"]).where("docs < 3 and (r or pages >= 3)").select("source", "k", "document"))
    return sized_join(k, good, ["source", "k", "document"], "left_semi").select("id", "k")
