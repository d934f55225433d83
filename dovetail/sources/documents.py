"""Resume files as texts."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dovetail.functions.normalize import binary_like, file_name, file_stem

SUFFIXES = (".pdf", ".docx", ".doc", ".txt")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Extractors by suffix that may be added: bytes to text.  No PDF library is built in; without one PDFs are unreadable.
EXTRACTORS: dict[str, Callable[[bytes], str]] = {}


def plain_text(content: bytes) -> str:
    """UTF-8 with or without a byte order mark, else Latin-1; any line break becomes a newline."""
    for encoding in ("utf-8-sig", "latin-1"):
        try:
            return content.decode(encoding).replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            continue
    raise AssertionError("Latin-1 decodes any bytes")


def docx_text(content: bytes) -> str:
    """The non-blank paragraphs of the body (tables and headers are left out)."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    texts = []
    for p in body.findall(f"{_W}p") if body is not None else []:
        parts = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n"}
        texts.append("".join(parts[e.tag](e) for e in p.iter() if e.tag in parts))
    return "\n".join(t for t in texts if t.strip())


def reader_of(extra: dict[str, Callable[[bytes], str]]):
    by_suffix = {".txt": plain_text, ".docx": docx_text, ".doc": docx_text} | extra

    def read(suffix: pd.Series, content: pd.Series) -> pd.Series:
        out = []
        for s, c in zip(suffix, content, strict=True):
            try:
                out.append(by_suffix[s](bytes(c)))
            except Exception:  # a file that can't be read is a null row, never an end of the batch
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(read, "string")


def texts_of(files: DataFrame) -> DataFrame:
    """(path, content) as file_path, filename, source_id, raw_text, warnings; unreadable and unsupported files go,
    blank and binary ones stay with an empty text and a warning."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    own = files.select("path", "content", suffix.alias("suffix")).filter(F.col("suffix").isin(*SUFFIXES))
    raw = own.withColumn("raw", reader_of(EXTRACTORS)("suffix", "content")).filter(F.col("raw").isNotNull())
    blank, binary = ~F.col("raw").rlike(r"\S"), (F.col("suffix") == ".txt") & binary_like(F.col("raw"))
    notes = F.array_compact(F.array(F.when(F.col("suffix") == ".doc", F.lit("legacy .doc read as DOCX")), F.when(blank, F.lit("empty text")), F.when(~blank & binary, F.lit("binary content"))))
    file = file_name(F.regexp_replace("path", "%20", " "))
    return raw.select(
        F.col("path").alias("file_path"), file.alias("filename"), F.concat(F.lit("resume_"), F.regexp_replace(file, r"(?<=.)\.[^.]*$", "")).alias("source_id"),
        F.when(blank | binary, F.lit("")).otherwise(F.col("raw")).alias("raw_text"), notes.alias("warnings"),
    )


def read_folder(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The supported files of a folder (not of its subfolders), or of a list of paths; a missing folder gives no rows."""
    try:
        return texts_of(spark.read.format("binaryFile").load(path))
    except AnalysisException:
        return texts_of(spark.createDataFrame([], "path string, content binary"))


__all__ = ["EXTRACTORS", "SUFFIXES", "docx_text", "file_stem", "plain_text", "read_folder", "texts_of"]
