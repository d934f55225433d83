"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dovetail.llm import vectors


def sample(docs: DataFrame, labels: DataFrame, label_col: str, allowed: Column, per_label: int, id_col: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """docs with a `_label` (0 or 1) for about per_label ids of each label and how many ids have each label.

    An id with differing labels has the smaller; null ids and labels teach nothing.  The chosen ids are at most
    2 * per_label and a little chance, so they are broadcast; the documents are not shuffled."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & allowed).groupBy(id_col).agg(F.min(label_col).alias("_label"))
    sizes = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    chosen = vectors.sampled(known, F.col(id_col), F.col("_label"), per_label).select(F.col(id_col), "_label")
    return docs.select(id_col, *[c for c in docs.columns if c not in (id_col, "_label")]).join(F.broadcast(chosen), id_col), sizes
