"""The whole integration: sources to canonical profiles to projected output."""

from __future__ import annotations

import json
import os
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dovetail.operators import merge, notices, records, resolve, score
from dovetail.plans import projection
from dovetail.plans.shared import cut
from dovetail.sources.registry import reader

CANONICAL = (
    "candidate_id", "full_name", "emails", "phones", "phones_raw", "location", "links", "headline", "years_experience", "skills", "experience",
    "education", "provenance", "field_confidence", "field_reasoning", "overall_confidence", "source_profile_kind", "source_notice",
)


#: A projected profile's card beside its output.
CARD = ("candidate_id", "source_profile_kind", "source_notice", "meta.data_quality_notice", "meta.resume_filename", "meta.manifest_resume", "meta.csv_row_number")


def build_canonical(table: DataFrame, texts: DataFrame, as_of: Column | date | None = None, default_region: str | None = None, source_priority: tuple[str, ...] = ("resume", "recruiter_csv")) -> DataFrame:
    """Canonical profiles, with `meta` and `group_order`, of identified table rows and resume texts."""
    when = F.current_date() if as_of is None else F.lit(as_of) if isinstance(as_of, date) else as_of
    every = cut(records.assembled(records.normalized_table(table, default_region), records.extracted(texts, when, default_region)))
    profiles = score.scored(merge.merged(merge.gathered(resolve.resolve(every)), source_priority))
    return notices.noticed(cut(profiles)).select(*CANONICAL, "meta", "group_order")


def read_sources(spark: SparkSession, csv: str, resumes: str) -> tuple[DataFrame, DataFrame]:
    return reader("csv")(spark, csv), reader("resume")(spark, resumes)


def run(spark: SparkSession, csv: str, resumes: str, config: str | dict | None = None, as_of: date | None = None, skip_on_error: bool = True) -> dict[str, DataFrame]:
    """canonical, output (JSON documents in order), errors, meta, summary and warnings (source_id, warning) of a batch."""
    table, texts = read_sources(spark, csv, resumes)
    canonical = build_canonical(table, texts, as_of=as_of)
    return reproject(canonical, config, skip_on_error) | {"canonical": canonical, "warnings": warnings(table, texts, canonical)}


def warnings(table: DataFrame, texts: DataFrame, canonical: DataFrame) -> DataFrame:
    """What readers noted on records, and the listed resumes that were missing, unreadable or failed validation."""
    read = [rows.select("source_id", F.explode("warnings").alias("warning")) for rows in (table, texts)]
    row = F.concat(F.lit("csv_row_"), F.col("meta.csv_row_number").cast("string"))
    said = F.coalesce(*[F.when(F.col(f"meta.manifest_resume_{k}").isNotNull(), F.concat(F.lit(f"listed resume {k}: "), F.col(f"meta.manifest_resume_{k}"))) for k in ("missing", "unreadable")], F.when(F.col("source_notice").contains("do not match"), F.concat(F.lit("listed resume failed validation: "), F.coalesce("meta.manifest_resume", "meta.resume_filename"))))
    listed = canonical.select(F.coalesce(row, F.col("meta.resume_filename")).alias("source_id"), said.alias("warning")).filter("warning IS NOT NULL")
    return read[0].unionByName(read[1]).unionByName(listed)


def reproject(canonical: DataFrame, config: str | dict | None = None, skip_on_error: bool = True) -> dict[str, DataFrame]:
    """Late projection of stored canonical profiles; reading, extraction and merging aren't repeated.

    skip_on_error: profiles that the configuration refuses are rows of `errors`; otherwise the first one raises ValueError."""
    if "meta" not in canonical.columns:  # a stored profile may have lost it
        names = {"data_quality_notice": "string", "resume_filename": "string", "manifest_resume": "string", "csv_row_number": "bigint"}
        canonical = canonical.withColumn("meta", F.struct(*[F.lit(None).cast(t).alias(n) for n, t in names.items()]))
    order = ("group_order",) if "group_order" in canonical.columns else ()
    card = [F.col(c).alias(f"_card_{i}") for i, c in enumerate(CARD)]
    rows = projection.project_json(canonical.withColumn("_card", F.struct(*card)), projection.parse(config), (*order, "candidate_id", "full_name", "_card"))
    rows = rows.orderBy(*order) if order else rows
    good, bad = rows.filter("error IS NULL"), rows.filter("error IS NOT NULL").select("candidate_id", "full_name", "error")
    first = None if skip_on_error else bad.first()
    if first:
        raise ValueError(f"Projection failed for profile {first['candidate_id']}: {first['error']}")
    return {
        "output": good.select("candidate_id", "output"),
        "errors": bad,
        "meta": good.select(*[F.col(f"_card._card_{i}").alias(c.rsplit(".", 1)[-1]) for i, c in enumerate(CARD)]),
        "summary": notices.batch_summary(canonical),
    }


def cards(canonical: DataFrame) -> DataFrame:
    """Canonical profiles as card documents: all fields and a flat confidence for each scored field."""
    flat = {f"{f}_confidence": F.col("field_confidence")[f] for f in score.FIELDS}
    document = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(json.dumps(k) + ":"), projection.json_of(v)) for k, v in ({c: F.col(c) for c in CANONICAL} | flat).items()]), F.lit("}"))
    return canonical.select("candidate_id", document.alias("card"))


def shaped(rows: DataFrame) -> DataFrame:
    """Stored profiles in the canonical shape: null arrays, maps and links become empty ones."""
    empty = {"emails": F.array().cast("array<string>"), "phones": F.array().cast("array<string>"), "phones_raw": F.array().cast("array<string>")}
    for name in ("skills", "experience", "education", "provenance", "field_confidence", "field_reasoning"):
        if name in rows.columns:
            kind = rows.schema[name].dataType
            empty[name] = (F.create_map() if kind.typeName() == "map" else F.array()).cast(kind)
    return rows.withColumns({k: F.coalesce(k, v) for k, v in empty.items() if k in rows.columns})


def write_json(output: DataFrame, path: str | None) -> str:
    """One pretty JSON array, for a person to read; large results are written as output.write.text(...) instead."""
    whole = json.dumps([json.loads(r[0]) for r in output.select("output").toLocalIterator()], indent=2, ensure_ascii=False)
    if path:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(whole)
    return whole
