"""A training corpus from raw documents: filtered, deduplicated, redacted and packed."""

from __future__ import annotations

from dovetail.llm import stages, store

STAGES = [
    ("quality", stages.good_quality),
    ("language", stages.known_language),
    ("near_duplicates", stages.one_of_each_group),
    ("secrets", stages.without_secrets),
    ("packing", stages.packed),
]

#: The classifiers and the tokenizer are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    docs = store.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
