"""Readers and writers: folders of PDF files, indexes as one Parquet table per logical table, pluggable
services for embeddings and answers."""

from __future__ import annotations

import io
import json
import os
import re
import shutil
import signal
import subprocess
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Seconds for one attempt at a file, and for reading it by character recognition.
TIMEOUT, OCR_TIMEOUT = 10, 180


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, content)`` of the PDF files of a folder by path, read where they are needed. A folder that is
    missing or has none is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    if files.select("path").isEmpty():
        raise FileNotFoundError(f"no PDF file in {folder}")
    return files.orderBy("path")


def find_program(name: str, places: tuple[str, ...] = ("/usr/local/bin", "/opt/homebrew/bin", "/usr/bin")) -> str | None:
    """An external program in the path or in the usual places."""
    found = shutil.which(name)
    return found or next((p for p in (os.path.join(d, name) for d in places) if os.access(p, os.X_OK)), None)


def page_of_image(name: str) -> int:
    """The page number at the end of the name of a page image, 0 without one."""
    m = re.search(r"-(\d+)\.png$", name)
    return int(m[1]) if m else 0


def _run(command: list[str], timeout: float) -> bytes:
    return subprocess.run(command, capture_output=True, timeout=timeout, check=True).stdout


def _on_disk(content: bytes, folder: str) -> str:
    path = os.path.join(folder, "file.pdf")
    with open(path, "wb") as f:
        f.write(content)
    return path


def by_pdftotext(content: bytes, timeout: int = TIMEOUT) -> list[str]:
    """Page texts by an external program; an empty list where it is missing."""
    program = find_program("pdftotext")
    if not program:
        return []
    with tempfile.TemporaryDirectory() as d:
        pages = _run([program, "-layout", _on_disk(content, d), "-"], timeout).decode("utf-8", "replace").split("\f")
    return pages[:-1] if pages and not pages[-1].strip() else pages


def by_ocr(content: bytes, timeout: int = OCR_TIMEOUT, dpi: int = 180, lang: str = "vie+eng", psm: str = "4") -> list[str]:
    """Page texts by external programs that draw the pages and recognise characters."""
    draw, read = find_program("pdftoppm"), find_program("tesseract")
    if not draw or not read:
        return []
    with tempfile.TemporaryDirectory() as d:
        _run([draw, "-r", str(dpi), "-png", _on_disk(content, d), os.path.join(d, "page")], timeout)
        images = sorted((page_of_image(x), x) for x in os.listdir(d) if x.endswith(".png"))
        return [_run([read, os.path.join(d, x), "stdout", "-l", lang, "--psm", psm, "-c", "preserve_interword_spaces=1"], timeout).decode("utf-8", "replace") for _, x in images]


def _text(page) -> str:
    """A page that cannot be read is empty; the others count."""
    try:
        return page() or ""
    except Exception:  # noqa: BLE001
        return ""


def by_pypdf(content: bytes, timeout: int = TIMEOUT) -> list[str]:
    import pypdf

    return [_text(p.extract_text) for p in pypdf.PdfReader(io.BytesIO(content)).pages]


def by_pdfplumber(content: bytes, timeout: int = TIMEOUT) -> list[str]:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as f:
        return [_text(p.extract_text) for p in f.pages]


def by_pypdfium2(content: bytes, timeout: int = TIMEOUT) -> list[str]:
    import pypdfium2

    return [_text(lambda p=p: p.get_textpage().get_text_range()) for p in pypdfium2.PdfDocument(content)]


EXTRACTORS: dict[str, Callable[[bytes, int], list[str]]] = {"pdftotext": by_pdftotext, "pypdfium2": by_pypdfium2, "pdfplumber": by_pdfplumber, "pypdf": by_pypdf, "ocr": by_ocr}
CHAIN = tuple(EXTRACTORS)


def within(timeout: float, f: Callable, *args):
    """The result of ``f`` from a process of its own, which is ended after ``timeout`` seconds; so neither
    a hanging reader nor one that ends its process takes the task with it."""
    out, into = os.pipe()
    pid = os.fork()
    if not pid:
        status = 1
        try:
            os.close(out)
            with os.fdopen(into, "wb") as w:
                w.write(json.dumps(f(*args)).encode())
            status = 0
        finally:
            os._exit(status)
    os.close(into)
    ended = []

    def end(*_):
        ended.append(True)

    import threading

    timer = threading.Timer(timeout, lambda: (end(), os.kill(pid, signal.SIGKILL)))
    timer.start()
    try:
        with os.fdopen(out, "rb") as r:
            data = r.read()
    finally:
        timer.cancel()
        _, status = os.waitpid(pid, 0)
    if ended:
        raise TimeoutError(f"no result after {timeout} s")
    if status:
        raise RuntimeError(f"ended with {status}")
    return json.loads(data)


def extract_pages(files: DataFrame, chain: tuple[str, ...] = CHAIN, timeout: int = TIMEOUT, extractors: dict | None = None, repair: bool = False) -> DataFrame:
    """``(document, source, page, text)``: of each file the cleaned pages of the first extractor that gives
    any text; a file that all fail on gives no rows. Extractors are pluggable. ``repair`` also undoes
    frequent misreadings."""
    known = EXTRACTORS | (extractors or {})

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in parts:
            rows = []
            for path, content in zip(df["path"], df["content"], strict=True):
                for name in chain:
                    limit = OCR_TIMEOUT if name == "ocr" else timeout
                    try:
                        pages = within(limit + 1, known[name], content, limit)
                    except Exception:  # noqa: BLE001  an extractor may fail in any way; the next one is tried
                        pages = []
                    if any(p.strip() for p in pages):
                        rows += [(path.rsplit("/", 1)[-1], path, i + 1, p) for i, p in enumerate(pages)]
                        break
            yield pd.DataFrame(rows, columns=["document", "source", "page", "text"])

    pages = files.mapInPandas(work, "document string, source string, page int, text string")
    return pages.withColumn("text", (T.repair_ocr if repair else T.clean_text)(F.col("text")))


def cached_pages(chunks: DataFrame) -> DataFrame:
    """``(document, page, text)``: pages put together again from overlapping passages of an index."""
    from ..operators.answer import merge_overlapping

    return merge_overlapping(chunks, ["document", "page"], ["chunk_on_page"], "text")


def save_index(folder: str, settings: dict[str, str], **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(sorted(settings.items()), "name string, value string").withColumn("built_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{folder}/settings")


def load_index(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def embed(df: DataFrame, key: str, text: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 64, tries: int = 3) -> DataFrame:
    """``(key, embedding)`` by a pluggable service, in batches, each tried three times."""
    import time

    src = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))

    def work(parts):
        for p in parts:
            out = []
            texts = p["_t"].fillna("").tolist()
            for i in range(0, len(texts), batch):
                for n in range(tries):
                    try:
                        out += embedder(texts[i : i + batch])
                        break
                    except Exception:  # noqa: BLE001
                        if n == tries - 1:
                            raise
                        time.sleep(n + 1)
            yield pd.DataFrame({"_k": p["_k"], "embedding": out})

    return src.mapInPandas(work, f"_k {src.schema['_k'].dataType.simpleString()}, embedding array<float>").withColumnRenamed("_k", key)


PROMPT = (
    "Answer the question in its language, from the context below only. Cite passages by their numbers in brackets, such as [1]. "
    "If the context does not say enough, say so.\n\nQuestion:\n{question}\n\nContext:\n{context}\n"
)


def prompt(question: Column, context: Column) -> Column:
    """What is sent to a generator."""
    head, middle, tail = re.split(r"\{\w+\}", PROMPT)
    return F.concat(F.lit(head), question, F.lit(middle), context, F.lit(tail))


def answer_text(payload: str) -> str:
    """The text of a service's answer: the field output_text, or else the texts of its parts."""
    data = json.loads(payload)
    if isinstance(data.get("output_text"), str):
        return data["output_text"].strip()
    parts = [c["text"] for o in data.get("output", []) for c in o.get("content", []) if isinstance(c.get("text"), str)]
    return "\n".join(parts).strip()


def generate(ranked: DataFrame, generator: Callable[[str], str] | None, fallback: str = "extract") -> DataFrame:
    """``(query_id, answer)``: a pluggable generator over the prompt of question and context, which gives a
    payload; without one, where it fails or says nothing, the extracted sentences in ``fallback``."""
    src = ranked.select("query_id", prompt(F.col("question"), F.col("context")).alias("p"), F.col(fallback).alias("f"))

    def work(parts):
        for p in parts:
            out = []
            for q, f in zip(p["p"], p["f"], strict=True):
                try:
                    out.append((answer_text(generator(q)) or f) if generator else f)
                except Exception:  # noqa: BLE001
                    out.append(f)
            yield pd.DataFrame({"query_id": p["query_id"], "answer": out})

    return src.mapInPandas(work, "query_id bigint, answer string")


def export_json(df: DataFrame, folder: str) -> None:
    """A table as lines of JSON."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(folder)


def import_json(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.text(folder).select(F.from_json("value", schema).alias("r")).select("r.*")
