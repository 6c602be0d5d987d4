"""Problem 5: one form for text that looks the same (compatibility forms, look-alike letters,
kinds of blanks, invisible characters).

Cases: null stays null; empty and blank texts become the empty string; repeated rows and ties are
kept as they are; columns other than the ones named pass through untouched. The work is done once
per distinct value of a batch.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of Cyrillic, Greek and other blocks whose printed shape equals a Latin letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "У": "Y", "Ѕ": "S", "І": "I", "Ј": "J", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x",
    "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ь": "b", "ӏ": "l", "Ԍ": "G",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ι": "i", "α": "a", "ρ": "p", "ϲ": "c", "ϳ": "j",
    "ɡ": "g", "ı": "i", "ꓲ": "I", "Ð": "Đ", "Ɖ": "Đ",
}
# Hyphens drawn alike.
HYPHENS = "‐‑⁃﹣－"
#: Default-ignorable code points, as ranges of the Unicode property.
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U000e0000-\U000e0fff"
BLANKS = "\t\u000b\u000c   -   　"

_ignorable = re.compile(f"[{IGNORABLE}]+")
_blank = re.compile(f"[{BLANKS}]")
_newline = re.compile("\r\n?| | |\u0085")
_alike = re.compile(f"[{''.join(LOOKALIKES)}{HYPHENS}]")
_table = str.maketrans(LOOKALIKES | dict.fromkeys(HYPHENS, "-"))
_margin = re.compile("^ +| +$", re.M)


#: Whatever a text must have at least one of to change, besides decomposed or compatibility forms.
_special = re.compile(f"[{IGNORABLE}{BLANKS}{HYPHENS}{''.join(LOOKALIKES)}\u0370-\u052f\u1f00-\u1fff\r\u0085\u2028\u2029]")


def visual_form(text: str) -> str:
    """The text as it looks: case and accents stay, encodings of the same sight become one."""
    if _special.search(text) or not (text.isascii() or unicodedata.is_normalized("NFKC", text)):
        text = _newline.sub("\n", _ignorable.sub("", text))
        text = _blank.sub(" ", text)
        # a letter and its accents are told apart before look-alikes are exchanged, as a letter of
        # another script with an accent may be one character that has no look-alike of its own
        text = unicodedata.normalize("NFKD", text)
        if _alike.search(text):
            text = text.translate(_table)
        text = unicodedata.normalize("NFKC", text)
    if " \n" in text or "\n " in text:
        text = _margin.sub("", text)
    return text.strip(" \n")


def canonical_form(text: str) -> str:
    """:func:`visual_form` with full case folding, for comparisons that ignore case."""
    folded = visual_form(text).casefold()
    if folded.isascii():
        return folded
    if not unicodedata.is_normalized("NFKC", folded):
        folded = unicodedata.normalize("NFKC", folded)
    return visual_form(folded) if _special.search(folded) else folded


def canonicalise(df: DataFrame, column: str, out: str, fold_case: bool = True) -> DataFrame:
    """``df`` with ``out``, the one form of ``column``; an existing ``out`` is replaced."""
    form = canonical_form if fold_case else visual_form

    @F.pandas_udf("string")
    def one_form(s):
        known = {v: form(v) for v in s.dropna().unique()}
        return s.map(known, na_action="ignore")

    return df.withColumn(out, one_form(F.col(column)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def hashed_forms(df: DataFrame, keys: list[str], column: str, least: int = 1) -> DataFrame:
    """``keys`` and hashes: ``k1``, ``k2`` of the visual form (128 bits) and ``raw`` of the
    text itself. Null, blank and texts of under ``least`` characters give no row."""
    src = df.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col(column).alias("_text")).where(F.length("_text") >= least)
    types = [src.schema[f"_key{i}"].dataType.simpleString() for i in range(len(keys))]
    schema = ", ".join(f"_key{i} {t}" for i, t in enumerate(types)) + ", k1 bigint, k2 bigint, raw bigint"

    def work(batches):
        for b in batches:
            keep, k1, k2, raw = [], [], [], []
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                v = visual_form(t)
                if not v:
                    continue
                h = xxhash.xxh3_128_intdigest(v)
                keep.append(i)
                k1.append(_signed(h >> 64))
                k2.append(_signed(h & (1 << 64) - 1))
                raw.append(_signed(xxhash.xxh3_64_intdigest(t)))
            cols = [c.take(pa.array(keep, pa.int64())) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.int64()) for x in (k1, k2, raw))], names=[*b.schema.names[:-1], "k1", "k2", "raw"])

    return src.mapInArrow(work, schema).toDF(*keys, "k1", "k2", "raw")


def lookalike_pairs(df: DataFrame, key: str, column: str, least: int = 1) -> DataFrame:
    """Pairs ``id_a < id_b`` of ``key`` whose values of ``column`` look the same but differ in
    characters. A key may hold several values (exploded aliases); rows given twice count once.

    Forms are compared by 128-bit hashes; only hashes that have more than one spelling are
    joined, on the whole hash, so ordinary copies of one text never meet each other."""
    h = hashed_forms(df.where(F.col(key).isNotNull()), [key], column, least).withColumnRenamed(key, "_id").distinct()
    spelt = h.groupBy("k1", "k2").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("k1", "k2")
    amb = h.join(spelt, ["k1", "k2"])
    a, b = amb.select("k1", "k2", F.col("_id").alias("id_a"), F.col("raw").alias("raw_a")), amb.select("k1", "k2", F.col("_id").alias("id_b"), F.col("raw").alias("raw_b"))
    return a.join(b, ["k1", "k2"]).where("id_a < id_b and raw_a <> raw_b").select("id_a", "id_b").distinct()
