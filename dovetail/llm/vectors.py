"""Hashed byte n-gram vectors of whole texts, many texts at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dovetail.llm import store
from dovetail.llm.blobs import tidy
from dovetail.llm.text import LOWER, chunks

#: Texts of a dense block of vectors.
ROWS = 512


def folded() -> np.ndarray:
    """Byte codes for language: ASCII letters in lower case, other bytes from 128 as they are, the rest one blank."""
    table = LOWER.copy()
    table[[b for b in range(128) if not chr(b).isalpha()]] = 32
    return table


def counts(data: np.ndarray, at: np.ndarray, table: np.ndarray, sizes: tuple[int, ...], dims: int) -> np.ndarray:
    """Counts of the byte n-grams of the given sizes within each text, hashed to `dims` (a power of two) columns."""
    n, rows = len(data), len(at) - 1
    out = np.zeros(rows * dims, np.float32)
    if not n:
        return out.reshape(rows, dims)
    codes = table[data].astype(np.uint32)
    base = np.repeat(np.arange(rows, dtype=np.int64) * dims, np.diff(at))
    shift = np.uint32(32 - dims.bit_length() + 1)
    ends = np.repeat(at[1:], np.diff(at))
    here = np.arange(n)
    for k in sizes:
        if n < k:
            continue
        m = n - k + 1
        h = np.full(m, k, np.uint32)
        for j in range(k):
            h = (h ^ codes[j : j + m]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        ok = here[:m] + k <= ends[:m]
        out += np.bincount(base[:m][ok] + (h >> shift)[ok], minlength=rows * dims)
    return out.reshape(rows, dims)


def blocks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As text.chunks, with at most ROWS texts at once."""
    for lo, hi, data, at in chunks(column, limit):
        for a in range(0, hi - lo, ROWS):
            b = min(hi - lo, a + ROWS)
            yield lo + a, lo + b, data[at[a] : at[b]], at[a : b + 1] - at[a]


def weighted(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF, tf being 1 + ln(count)."""
    x = np.where(raw > 0, 1 + np.log(np.maximum(raw, 1)), 0).astype(np.float32) * idf
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def document_counts(docs: DataFrame, text: Column, table: np.ndarray, sizes: tuple[int, ...], dims: int) -> tuple[int, np.ndarray]:
    """How many of all documents there are and how many hold each column's n-grams; `dims` numbers reach the driver."""

    def run(batches):
        total, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            for lo, hi, data, at in blocks(batch.column(0)):
                total += (counts(data, at, table, sizes, dims) > 0).sum(0)
                n += hi - lo
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1)), pa.array(np.append(total, n))], ["slot", "n"])

    with store.small_batches(docs.sparkSession):
        rows = docs.select(text.cast("binary").alias("text")).mapInArrow(tidy(run), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(dims + 1)
    for slot, n in rows:
        out[slot] = n
    return int(out[dims]), out[:dims]


def idf(n: int, having: np.ndarray) -> np.ndarray:
    return (np.log((1 + n) / (1 + having)) + 1).astype(np.float32)


def sampled(rows: DataFrame, key: Column, label: Column, per_label: int) -> DataFrame:
    """About per_label rows of each label (all, where there are fewer), chosen by a hash of the key: alike at every size.

    The labels' sizes are sent to the rows, so the rows stay where they are (see store.small)."""
    labelled = rows.withColumn("_label", label).filter(F.col("_label").isNotNull())
    sizes = store.small(labelled.groupBy("_label").agg(F.count(F.lit(1)).alias("_size")), "sizes")
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return labelled.join(sizes, "_label").filter(place < F.lit(float(per_label)) / F.col("_size")).drop("_size")


def scored(docs: DataFrame, keep: list[str], text_col: str, score: Callable, schema: str, inside: str | None = None) -> DataFrame:
    """docs' `keep` columns and what score(bytes, offsets) returns for blocks of whole texts (a list of arrays).

    inside: the kept struct column that holds the text, so that it isn't sent a second time."""

    def run(batches):
        for batch in batches:
            texts = pc.struct_field(batch.column(keep.index(inside)), text_col) if inside else batch.column(len(keep))
            for lo, hi, data, at in blocks(texts):
                new = score(data, at)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo) for i in range(len(keep))], *map(pa.array, new)], [*keep, *[f"_{i}" for i in range(len(new))]])

    own = docs.select(*keep) if inside else docs.select(*keep, F.col(text_col).cast("binary").alias("_text"))
    out = T.StructType(own.schema.fields[: len(keep)] + [T.StructField(n, T._parse_datatype_string(k)) for n, k in (c.split() for c in schema.split(", "))])
    return own.mapInArrow(tidy(run), out)
