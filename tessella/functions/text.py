"""Text functions as Column expressions, all inside the JVM."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon

#: White space as Python's strip and split see it, in a class that Java and RE2 both know.
BLANK = r"[\s\p{Z}]"
WORD = r"[\p{L}\p{N}_]+"


@lru_cache(maxsize=1)
def fold_map() -> tuple[str, str]:
    """Letters whose decomposition is one letter and accents, and these letters; by rule."""
    a, b = ["đ", "Đ"], ["d", "D"]
    for k in range(0xC0, 0x3100):
        c = chr(k)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            a.append(c)
            b.append(base)
    return "".join(a), "".join(b)


def folded(x: str) -> str:
    """:func:`fold` of a constant."""
    return x.translate(str.maketrans(*fold_map()))


_word = re.compile(r"\w+")
_blank = re.compile(r"\s+")


@lru_cache(maxsize=1)
def _fold_table() -> dict:
    return str.maketrans(*fold_map())


@lru_cache(maxsize=200_000)
def fold_text(x: str) -> str:
    """:func:`fold` of one string, for work in Arrow batches."""
    if x.isascii():
        return x
    return "".join(c for c in x.translate(_fold_table()) if unicodedata.category(c) != "Mn")


def words_of(x: str) -> list[str]:
    """:func:`tokens` of one string."""
    return [t for t in _word.findall(x.lower()) if len(t) > 1]


def words_dual(x: str) -> list[str]:
    """:func:`tokens_dual` of one string."""
    out = []
    for t in words_of(x):
        out.append(t)
        if (f := fold_text(t)) != t:
            out.append(f)
    return out


def words_folded(x: str) -> list[str]:
    """:func:`tokens_folded` of one string."""
    return [fold_text(t) for t in words_of(x)]


#: The analysers for work in Arrow batches, by the names of :data:`ANALYSERS`.
BATCH_ANALYSERS = {"basic": words_of, "dual": words_dual, "folded": words_folded}


def squeezed_text(x: str) -> str:
    """:func:`squeezed` of one string."""
    x = x.lower()
    if not x.isascii():
        x = "".join(c for c in x.translate(_fold_table()) if unicodedata.category(c) != "Mn")
    return _blank.sub(" ", x).strip()


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", "")


def clean_text(x: Column) -> Column:
    """NUL to a blank, blanks and tabs to one blank, three and more line breaks to two, stripped."""
    x = F.regexp_replace(F.replace(x, F.lit("\0"), F.lit(" ")), r"[ \t]+", " ")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def clean_text_dehyphen(x: Column) -> Column:
    """:func:`clean_text` after words broken by a hyphen at a line end are joined."""
    x = F.replace(x, F.lit("\0"), F.lit(" "))
    return clean_text(F.regexp_replace(x, rf"(?<={WORD[:-1]})-{BLANK}*\n{BLANK}*(?={WORD[:-1]})", ""))


def fold(x: Column) -> Column:
    """Without accents; đ as d."""
    return F.regexp_replace(F.translate(x, *fold_map()), r"\p{Mn}+", "")


def words(x: Column) -> Column:
    return F.filter(F.split(strip(x), f"{BLANK}+"), lambda w: w != "")


def tokens(x: Column) -> Column:
    """Lower-case words of two characters and more."""
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0)), lambda t: F.length(t) > 1)


def tokens_dual(x: Column) -> Column:
    """Each token, then its folded form where that differs."""
    return F.flatten(F.transform(tokens(x), lambda t: F.when(fold(t) != t, F.array(t, fold(t))).otherwise(F.array(t))))


def tokens_folded(x: Column) -> Column:
    """Folded tokens; the length is tested before folding."""
    return F.transform(tokens(x), fold)


def normalized(x: Column) -> Column:
    """Folded lower-case words, one blank between them; words of one letter stay."""
    return F.array_join(F.regexp_extract_all(fold(F.lower(x)), F.lit(WORD), F.lit(0)), " ")


ANALYSERS = {"basic": tokens, "dual": tokens_dual, "folded": tokens_folded}


def bigrams(t: Column, sep: str = " ") -> Column:
    """Neighbouring pairs; ``t`` is read a few times, so it should be a column, not an expression."""
    n = F.greatest(F.size(t) - 1, F.lit(0))
    return F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat_ws(sep, a, b))


def squeezed(x: Column) -> Column:
    """Folded lower-case text with single blanks, the ground of :func:`char_ngrams`."""
    return F.regexp_replace(strip(fold(F.lower(x))), f"{BLANK}+", " ")


def char_ngrams(s: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of a squeezed text without those that begin or end in a blank. In Arrow
    batches: a built-in substring counts characters from the start each time."""

    @F.pandas_udf("array<string>")
    def grams(texts):
        return texts.map(lambda t: [t[i : i + k] for k in range(low, high + 1) for i in range(len(t) - k + 1) if t[i] != " " and t[i + k - 1] != " "], na_action="ignore")

    return grams(s)


def char_ngram_counts(s: Column, low: int = 3, high: int = 5) -> Column:
    """``(grams, distinct_grams)``: how many :func:`char_ngrams` a squeezed text has, and how many of
    them differ. Counted one text and length at a time, so the grams of a batch never stand in memory."""
    import numpy as np
    import pandas as pd

    def count(t):
        c = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters, ids = np.unique(c, return_inverse=True)
        full, base, n, some = c != 32, len(letters), 0, 0
        if base**high >= 1 << 63:  # thousands of different letters: no number stands for a gram
            grams = [{t[i : i + k] for i in range(len(t) - k + 1) if full[i] and full[i + k - 1]} for k in range(low, high + 1)]
            return sum(int((full[: len(t) - k + 1] & full[k - 1 :]).sum()) for k in range(low, high + 1)), sum(map(len, grams))
        code = ids.astype(np.int64)
        for k in range(2, min(high, len(t)) + 1):
            code = code[:-1] * base + ids[k - 1 :]
            if k >= low:
                own = code[full[: len(code)] & full[k - 1 :]]
                n, some = n + len(own), some + len(np.unique(own))
        return n, some

    @F.pandas_udf("grams int, distinct_grams int")
    def counts(texts):
        return pd.DataFrame([(None, None) if t is None else count(t) for t in texts], columns=["grams", "distinct_grams"], dtype="Int32")

    return counts(s)


def sentences(x: Column, wide: bool = True) -> Column:
    """Pieces after a closing sign and white space, or at line breaks; cleaned, blank ones dropped."""
    marks = r"[.!?。！？;:]" if wide else r"[.!?;:]"
    return F.filter(F.transform(F.split(x, rf"(?<={marks}){BLANK}+|\n+"), clean_text), lambda s: s != "")


def text_quality(x: Column) -> Column:
    """0.55 times the share of letters, 0.45 times that of plausible words up to 0.62; three digits, rounded half up."""
    body = F.regexp_replace(x, f"{BLANK}+", "")
    alpha = F.length(F.regexp_replace(body, r"[^\p{L}]+", "")) / F.greatest(F.length(body), F.lit(1))
    ws = F.regexp_extract_all(x, F.lit(WORD), F.lit(0))
    good = F.filter(ws, lambda w: (F.length(w) >= 3) & (F.length(F.regexp_replace(w, r"[^\p{L}]+", "")) >= F.length(w) * 0.8))
    plausible = F.size(good) / F.greatest(F.size(ws), F.lit(1))
    score = F.lit(0.55) * alpha + F.lit(0.45) * F.least(F.lit(1.0), plausible / 0.62)
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * 1000 + 0.5) / 1000


def legal_refs(x: Column) -> Column:
    """Document numbers in order, each once, in one spelling."""
    found = F.regexp_extract_all(F.upper(fold(x)), F.lit(lexicon.LEGAL_NUMBER), F.lit(1))
    return F.array_distinct(F.transform(found, lambda r: F.replace(F.replace(F.regexp_replace(r, r"\s+", ""), F.lit("ND-"), F.lit("NĐ-")), F.lit("QD-"), F.lit("QĐ-"))))


def filename_ref(x: Column) -> Column:
    """``number/year/kind-issuer`` of a file name, or null."""
    name = F.upper(fold(F.regexp_replace(x, r"\.[^.]*$", "")))
    g = [F.regexp_extract(name, lexicon.FILE_NUMBER, i) for i in range(1, 5)]
    kind = F.when(g[2] == "ND", "NĐ").when(g[2] == "QD", "QĐ").otherwise(g[2])
    return F.when(g[0] != "", F.concat(g[0], F.lit("/"), g[1], F.lit("/"), kind, F.lit("-"), g[3]))


def first_date(x: Column) -> Column:
    """The first possible date of the form "ngày d tháng m năm y" in the first 5,000 characters."""
    found = F.regexp_extract_all(F.substring(x, 1, 5000), F.lit(lexicon.DATE), F.lit(0))
    parts = lambda s, i: F.regexp_extract(s, lexicon.DATE, i)
    dates = F.transform(found, lambda s: F.try_to_date(F.concat_ws("-", parts(s, 3), F.lpad(parts(s, 2), 2, "0"), F.lpad(parts(s, 1), 2, "0"))))
    return F.get(F.filter(dates, lambda v: v.isNotNull()), F.lit(0))


def document_type(x: Column) -> Column:
    """The first of the ordered types whose pattern stands in the text."""
    out = F
    for name, pattern in lexicon.TYPES.items():
        out = out.when(x.rlike(f"(?iuU){pattern}"), name)
    return out.otherwise("OtherLegalDocument")


def repair_ocr(x: Column) -> Column:
    """Frequent misreadings of Vietnamese scans undone, in order; spacing of punctuation mended."""
    x = F.translate(clean_text_dehyphen(x), "Ðð", "Đđ")
    one = f"([{lexicon.CAPITALS}])"
    # Java's bounds of words take combining marks for letters; these do not
    before, after = f"(?<!{WORD[:-1]})", f"(?!{WORD[:-1]})"
    x = F.regexp_replace(x, rf"(?U){before}{one}\s+{one}\s+{one}{after}", "$1$2$3")
    for pattern, right in lexicon.OCR_REWRITES:
        x = F.regexp_replace(x, f"(?iuU){before}{pattern[2:-2]}{after}", right)
    x = F.regexp_replace(x, rf"{BLANK}+([,.;:!?])", "$1")
    x = F.regexp_replace(x, rf"([(\[{{]){BLANK}+", "$1")
    return clean_text_dehyphen(F.regexp_replace(x, rf"{BLANK}+([)\]}}])", "$1"))
