"""Operators as stages of a pipeline: each takes documents and returns documents, the last one packed pieces.

All columns of the documents pass through unchanged, whatever their names; only redaction changes text and n_chars.
Rows with the same id (or none) and the same text are one document for deduplication; rows that share an id but differ in
their texts are different documents, and each is compared by its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dovetail.llm import language_id, packing, quality, secrets, store
from dovetail.llm.ngram_join import representatives


def whole_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct("*").alias("_row"), F.col("doc_id"), F.col("text"), F.col("lang"))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good; it learns from all labels."""
    rows = whole_rows(docs)
    model = quality.fit(rows.select("doc_id", "text"), store.table(spark, sf_dir, "labels"), F.lit(True))
    return quality.classify(rows, model, ["_row"], inside="_row").filter("predicted = 1").select("_row.*")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language classifier does not reject."""
    rows = whole_rows(docs)
    model = language_id.fit(rows.select("doc_id", "text", "lang"))
    return language_id.identify(rows, model, ["_row"], inside="_row").filter("NOT rejected").select("_row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked texts one row: the smallest id's (rows without an id come last), of its differing texts the
    one with the smallest hash, and of equal rows any.  Texts without words are groups of their own."""
    tag = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    first = store.materialize(representatives(docs.select("doc_id", "text", tag.alias("tag"))).distinct(), "first")
    row = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("id"), tag.alias("tag"), F.xxhash64(F.struct("*")).alias("order"))
    # the list grows with the documents: never a broadcast
    kept = row.join(first.hint("merge"), row["id"].eqNullSafe(first["id"]) & (row["tag"] == first["tag"]), "left_semi")
    twice = kept.groupBy("id", "tag").agg(F.count(F.lit(1)).alias("n"), F.min("order").alias("order")).filter("n > 1").drop("n")
    some = store.materialize(twice, "twice")
    if not some.limit(1).count():
        return kept.select("_row.*")
    same = lambda x, y: x["id"].eqNullSafe(y["id"]) & (x["tag"] == y["tag"])
    once = kept.join(some, same(kept, some), "left_anti")
    one = kept.join(some, same(kept, some) & (kept["order"] == some["order"]), "left_semi").dropDuplicates(["id", "tag"])
    return once.unionByName(one).select("_row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets replaced, but for widely copied examples."""
    found = secrets.scan(docs)
    some, text = F.size("redact") > 0, F.col("row.text")
    new = {"text": F.when(some, secrets.redacted(text, F.col("redact"))).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(some, F.char_length(new["text"])).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(docs))
