"""Problem 3: text statistics of each passage and fixed rules that tell prose from lists, tables and
junk, with the reason of every failure.

Two passes over the texts: the first counts in how many passages each word stands (counted inside a
batch before anything is shuffled) and keeps the :data:`COMMON` most frequent words and those of each
language; the second computes the statistics, vectorised over a batch, and applies the rules. The
statistics alone settle most passages: they are prose where no rule can fail. Lines and cells are only
looked at one by one in the others.

``failures`` are the published rules for web text (lengths, symbols, bullets, ellipses, letters, common
words) that a passage breaks, each with its name; ``kind`` and ``reason`` are what its form says.

Cases: null, empty and blank texts have null statistics, no kind and no reason; very long texts are
read whole; repeated rows of an id give one row; other columns may have any names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .forms import visual_form

#: Size of the list of common words, and how many of each language are in it anyway; the list is sent
#: to every task.
COMMON, COMMON_OF_LANGUAGE, LANGUAGES = 3000, 300, 200

# Thresholds of published rules for web text: words, mean length of a word, signs (# and
# ellipses) a word, lines with bullets, lines that end in an ellipsis, words with a letter, common words.
WORDS, MEAN, SIGNS, BULLETS, ELLIPSES, LETTERS, STOPS = (50, 100_000), (3, 10), 0.1, 0.9, 0.3, 0.8, 2

# Thresholds of the rules; the first four follow published heuristics for web text.
MAX_SYMBOLS, MIN_MEAN_WORD, MAX_MEAN_WORD, MIN_COMMON = 0.3, 1.5, 14, 0.12
MAX_DUMP, MAX_MOJIBAKE, MIN_DISTINCT, MIN_PACKED = 0.4, 0.08, 0.12, 0.13
ITEM_WORDS, ITEM_CHARS, SENTENCE_WORDS, MIN_ITEMS, LINE_SHARE, FIGURES = 16, 110, 60, 4, 0.6, 0.35

# Ranges of combining marks of the scripts in use, which belong to words.
MARKS = "\u0300-\u036f\u064b-\u065f\u0670\u0900-\u0903\u093a-\u094f\u0951-\u0957\u0962\u0963\u0e31\u0e34-\u0e3a\u0e47-\u0e4e"
_word = re.compile(f"[^\\W\\d_](?:[^\\W\\d_]|[{MARKS}])*")
_end = re.compile(r"[.!?…؟।][”\"»’)\]]*(?=\s|$)|[。！？]")
_closed = re.compile(r"[.!?…。！？؟।][”\"»’')\]」』]*\s*$")
_symbols = re.compile(rf"[^\w\s{MARKS}]|_")
_marker = re.compile(r"^\s*(?:[-–—•*·▪◦‣]\s|\(?[\d]{1,3}[.)]\s|\(?[a-zđ]{1,2}[.)]\s|\(?[ivx]{1,5}[.)]\s)", re.I)
_mojibake = re.compile(r"[Â-ô](?:[\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]){1,3}")
_dump = re.compile(r"[A-Za-z0-9+/=_\-]{40,}")
_cells = re.compile(r"\t+|\s*\|\s*|\s*;\s*| {2,}")
_cell = re.compile(r"[\t|;]|\S  ")
_figure = re.compile(r"^(?:[-–+]?[\d.,/:%\s'’-]*\d[\d.,/:%\s'’-]*|n/a|x|-|–|—|)$", re.I)
#: Separators of items in one line, the strongest first.
_separators = [re.compile(x) for x in (r"\s\|\s", r"\s[•·▪]\s", r"[;；]\s*", r"\s[/–—]\s", r"[,،，、]\s*")]
_thai = re.compile("[฀-๿]")
_wide = re.compile("[぀-ヿ㐀-鿿]")


def words_of(text: str) -> list[str]:
    return _word.findall(text.lower())


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The words of all texts: row, number and the list of words by number."""
    lists = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\p{L}\p{M}]+")
    row = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    d = lists.flatten().dictionary_encode()
    code = np.asarray(d.indices)
    words = d.dictionary.to_pylist()
    if "" in words:
        keep = code != words.index("")
        row, code = row[keep], code[keep]
    return row, code, words


def common_words(df: DataFrame, column: str, lang: str | None = None, size: int = COMMON) -> set[str]:
    """The words that stand in the most texts, of all and of each language."""

    def count(batches):
        for b in batches:
            t = pa.array([visual_form(t) if t else None for t in b.column(0).to_pylist()], pa.string())
            row, code, words = _words(t)
            langs = b.column(1).dictionary_encode()
            pair = np.unique(row * np.int64(max(1, len(words))) + code)
            of = np.asarray(pc.fill_null(langs.indices, len(langs.dictionary)))[pair // max(1, len(words))]
            key, n = np.unique(of * np.int64(max(1, len(words))) + pair % max(1, len(words)), return_counts=True)
            names = [*langs.dictionary.to_pylist(), "und"]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([names[i] for i in key // max(1, len(words))], pa.string()), "w": pa.array([words[i] for i in key % max(1, len(words))], pa.string()), "n": pa.array(n, pa.int64())})

    src = df.select(F.col(column).cast("string").alias("t"), (F.col(lang).cast("string") if lang else F.lit(None).cast("string")).alias("lang"))
    n = cut(src.mapInArrow(count, "lang string, w string, n bigint").groupBy("lang", "w").agg(F.sum("n").alias("n")))
    all_ = n.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "w").limit(size)
    top = n.where("n > 1").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("r") <= COMMON_OF_LANGUAGE)
    return {r["w"] for r in all_.select("w").unionByName(top.select("w").distinct().limit(COMMON_OF_LANGUAGE * LANGUAGES)).collect()}


def _table_rows(lines: list[str]) -> tuple[int, int]:
    rows = chars = 0
    for x in lines:
        cells = [c for c in _cells.split(x.strip().strip("|")) if c]
        if len(cells) >= 3:
            figures = sum(1 for c in cells if _figure.match(c))
            if figures >= max(2, FIGURES * len(cells)):
                rows += 1
                chars += len(x)
    return rows, chars


def _sentence_ends(text: str) -> int:
    """Closing signs after a word of two letters, a figure or a bracket: not after initials or "v.v"."""
    n = 0
    for m in _end.finditer(text):
        at = m.start()
        last = text[at - 1 : at]
        if text[at] in "。！？" or (last.isalpha() and text[at - 2 : at - 1].isalpha()) or last.isdigit() or last in "%)]»”’\"":
            n += 1
    return n


def statistics(text: str, common: set[str]) -> dict:
    """The figures that the rules look at."""
    tokens = text.split()
    n = max(1, sum(map(len, tokens)))
    words = words_of(text)
    lines = [x for x in text.split("\n") if x.strip()]
    return {
        "words": len(tokens),
        "mean_word": sum(map(len, words)) / len(words) if words else 0.0,
        "symbols": len(_symbols.findall(text)) / n,
        "closed_lines": sum(1 for x in lines if _closed.search(x[-8:])) / max(1, len(lines)),
        "common": sum(map(common.__contains__, words)) / max(1, len(words)),
        "lines": lines,
        "letters": words,
        "size": n,
        "wide": len(_wide.findall(text)) / n if _wide.search(text) else 0.0,
        "thai": len(_thai.findall(text)) / n if _thai.search(text) else 0.0,
        "ends": _sentence_ends(text),
    }


def judge(text: str, s: dict, raw: str | None = None) -> tuple[str | None, str | None]:
    """``(kind, reason)``; both None for prose. ``raw`` is the text with its own tabs."""
    n, lines, words = s["size"], s["lines"], s["letters"]
    alphabetic = s["wide"] < 0.3 and s["thai"] < 0.3
    raw = raw or text
    rows, chars = _table_rows(raw.split("\n")) if _cell.search(raw) else (0, 0)
    if rows >= 2 and chars >= 0.5 * len(text):
        return "table", "rows_of_figures"
    if _mojibake.search(text) and sum(len(m) for m in _mojibake.findall(text)) >= MAX_MOJIBAKE * n:
        return "junk", "wrongly_decoded"
    if s["symbols"] > MAX_SYMBOLS:
        return "junk", "symbols"
    if sum(len(m) for m in _dump.findall(text)) > MAX_DUMP * n:
        return "junk", "dump"
    if not words:
        return "junk", "no_words"
    distinct = len(set(words)) / len(words)
    if len(words) >= 20 and distinct < MIN_DISTINCT:
        return "junk", "repetition"
    if n >= 400 and (distinct < 0.4 or len(words) < 20):
        data = text.encode("utf-8", "replace")
        if len(zlib.compress(data, 1)) < MIN_PACKED * len(data):
            return "junk", "repetition"
    if alphabetic and len(words) >= 10 and s["common"] < MIN_COMMON and s["ends"] * SENTENCE_WORDS < len(words):
        return "junk", "no_common_words"
    # lists: hardly any sentence ends, and short items by line or between separators
    units = len(words) if alphabetic else n / 4
    if s["ends"] * SENTENCE_WORDS > units:
        marked = [x for x in lines if _marker.match(x)]
        if len(marked) < MIN_ITEMS or len(marked) < LINE_SHARE * len(lines) or sum(1 for x in marked if _closed.search(x)) > 0.2 * len(marked):
            return None, None
    size = (lambda x: len(x.split()) / ITEM_WORDS) if alphabetic else (lambda x: len(x) / ITEM_CHARS * 2)
    short = [x for x in lines if size(x) <= 1 and not _closed.search(x)]
    marked = [x for x in short if _marker.match(x)]
    if len(lines) >= MIN_ITEMS and (len(marked) >= max(3, LINE_SHARE * len(lines)) or (len(short) >= 0.7 * len(lines) and _starts_alike(lines))):
        return "list", "short_lines"
    longest = max(lines, key=len)
    if len(longest) > 0.5 * len(text):
        items = next((x for x in ([y for y in p.split(longest) if y.strip()] for p in _separators) if len(x) >= MIN_ITEMS), [])
        if len(items) >= MIN_ITEMS + 2:
            sizes = sorted(size(x) for x in items)
            if sizes[len(sizes) // 2] <= 0.9 and sizes[int(len(sizes) * 0.9)] <= 1.2:
                return "list", "short_items"
    return None, None


def _starts_alike(lines: list[str]) -> bool:
    """Items begin alike (all capitals or all small, or behind a marker); wrapped prose doesn't."""
    first = [x.lstrip()[0] for x in lines]
    upper = sum(1 for c in first if c.isupper()) / len(first)
    lower = sum(1 for c in first if c.islower()) / len(first)
    return max(upper, lower, 1 - upper - lower) >= 0.7


def _count(texts: pa.Array, pattern: str) -> np.ndarray:
    return np.asarray(pc.count_substring_regex(texts, pattern), dtype=np.float64)


def batch_statistics(texts: pa.Array, common: pa.Array) -> dict[str, np.ndarray]:
    """The statistics of all texts of a batch (in one form, none of them null)."""
    row, code, words = _words(texts)
    n = len(texts)
    count = np.bincount(row, minlength=n)
    sizes = np.array([len(w) for w in words] or [0])
    known = np.asarray(pc.is_in(pa.array(words, pa.string()), common)).astype(bool) if words else np.zeros(1, bool)
    pair = np.unique(row * np.int64(max(1, len(words))) + code)
    lines = np.maximum(_count(texts, r"(?m)^.*\S.*$"), 1)
    # one form of a text has no other white space than the first two; a text as it came may have tabs
    size = np.maximum(np.asarray(pc.utf8_length(texts)) - sum(np.asarray(pc.count_substring(texts, x)) for x in " \n\t"), 1.0)
    tokens = _count(texts, r"\S+")
    return {
        "words": tokens,
        "letters": count,
        "mean_word": np.bincount(row, sizes[code], n) / np.maximum(count, 1),
        "symbols": _count(texts, r"[^\p{L}\p{N}\p{M}\s]") / size,
        "closed_lines": _count(texts, r"(?m)[.!?…。！？؟।][”\"»’')\]」』]*[ \t]*$") / lines,
        "bullet_lines": _count(texts, r"(?mi)^[ \t]*(?:[-–—•*·▪◦‣]\s|\(?\d{1,3}[.)]\s|\(?[a-zđ]{1,2}[.)]\s|\(?[ivx]{1,5}[.)]\s)") / lines,
        "ellipsis_lines": _count(texts, r"(?m)(?:…|\.\.\.)[ \t]*$") / lines,
        "signs": _count(texts, r"#|…|\.\.\.") / np.maximum(tokens, 1),
        "lettered": _count(texts, r"\S*\p{L}\S*") / np.maximum(tokens, 1),
        "common": np.bincount(row, known[code], n) / np.maximum(count, 1),
        "stops": np.bincount(row, known[code], n),
        "distinct": np.bincount(pair // max(1, len(words)), minlength=n) / np.maximum(count, 1),
        "size": size,
        "lines": lines,
        "wide": _count(texts, r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]") / size,
        "thai": _count(texts, r"[\x{0e00}-\x{0e7f}]") / size,
        # closing signs that _sentence_ends counts too: at most as many
        "ends": _count(texts, r"(?:\p{L}\p{L}|\d|[%)\]»”’\"])[.!?…؟।][”\"»’')\]]*(?:\s|$)|[。！？]"),
    }


def failures(s: dict[str, np.ndarray]) -> list[list[str]]:
    """The names of the published rules that each text breaks. Rules on words hold for scripts with blanks
    between them."""
    spaced = (s["wide"] < 0.3) & (s["thai"] < 0.3)
    rules = {
        "few_words": spaced & (s["words"] < WORDS[0]), "many_words": spaced & (s["words"] > WORDS[1]),
        "short_words": spaced & (s["mean_word"] < MEAN[0]), "long_words": spaced & (s["mean_word"] > MEAN[1]),
        "signs": s["signs"] > SIGNS, "bullets": s["bullet_lines"] > BULLETS, "ellipses": s["ellipsis_lines"] > ELLIPSES,
        "unlettered_words": spaced & (s["lettered"] < LETTERS), "no_common_words": spaced & (s["stops"] < STOPS),
    }
    out: list[list[str]] = [[] for _ in s["words"]]
    for name, broken in rules.items():
        for i in np.flatnonzero(broken):
            out[i].append(name)
    return out


def surely_prose(texts: pa.Array, raw: pa.Array, s: dict[str, np.ndarray]) -> np.ndarray:
    """Where no rule of :func:`judge` can hold, by the statistics alone."""
    has = lambda t, p: np.asarray(pc.match_substring_regex(t, p)).astype(bool)
    alphabetic = (s["wide"] < 0.3) & (s["thai"] < 0.3)
    units = np.where(alphabetic, s["letters"], s["size"] / 4)
    varied = (s["distinct"] >= 0.4) | (s["distinct"] >= MIN_DISTINCT) & (s["size"] < 400)  # short texts are not tried by packing
    out = (s["symbols"] <= MAX_SYMBOLS) & (s["letters"] >= 20) & varied & ((s["common"] >= MIN_COMMON) | ~alphabetic)
    out &= (s["ends"] * SENTENCE_WORDS > units) & (s["bullet_lines"] * s["lines"] < MIN_ITEMS)
    cells = r"(?:[\t|;]|\S  )[^\n]*(?:[\t|;]|\S  )"  # a row has two bounds of cells at least, a table two rows
    out &= ~has(raw, rf"{cells}[^\n]*\n(?:[^\n]*\n)*?[^\n]*{cells}") & ~has(texts, r"[A-Za-z0-9+/=_\-]{40,}")
    return out & ~has(texts, r"[\x{00c2}-\x{00f4}][\x{0080}-\x{00bf}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")


def judged(df: DataFrame, key: str = "id", column: str = "text", common: set[str] | None = None, lang: str | None = None) -> DataFrame:
    """``(key, words, mean_word, symbols, closed_lines, bullet_lines, common, kind, reason, failures)``, one
    row an id."""
    known = common_words(df, column, lang) if common is None else common
    src = df.select(F.col(key).alias("_k"), F.col(column).cast("string").alias("_t"))
    names = ["words", "mean_word", "symbols", "closed_lines", "bullet_lines", "common"]

    def work(batches):
        listed = pa.array(sorted(known), pa.string())
        for b in batches:
            raws = b.column(1).to_pylist()
            forms = [visual_form(t) if t else "" for t in raws]
            there = np.flatnonzero([bool(t) for t in forms])
            texts, raw = pa.array([forms[i] for i in there], pa.string()), pa.array([raws[i] for i in there], pa.string())
            s = batch_statistics(texts, listed)
            kinds: list[tuple] = [(None, None)] * len(raws)
            for i in there[~surely_prose(texts, raw, s)]:
                kinds[i] = judge(forms[i], statistics(forms[i], known), raws[i])
            broken: list = [None] * len(raws)
            for i, x in zip(there, failures(s), strict=True):
                broken[i] = x
            cols = []
            for n in names:
                v = np.full(len(raws), np.nan)
                v[there] = np.round(s[n], 6)
                cols.append(pa.array(v, pa.float64(), mask=np.isnan(v)))
            cols[0] = cols[0].cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array([k for k, _ in kinds], pa.string()), pa.array([r for _, r in kinds], pa.string()), pa.array(broken, pa.list_(pa.string()))], names=["_k", *names, "kind", "reason", "failures"])

    kind = src.schema["_k"].dataType.simpleString()
    out = src.mapInArrow(work, f"_k {kind}, words bigint, mean_word double, symbols double, closed_lines double, bullet_lines double, common double, kind string, reason string, failures array<string>")
    return out.dropDuplicates(["_k"]).withColumnRenamed("_k", key)
