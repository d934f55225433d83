"""Notices about where a profile's data come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dovetail.functions.normalize import person_name

# Notices.
CSV_ONLY = "CSV-only profile: no matching resume was merged into this card. All fields below are from the recruiter CSV."
RESUME_ONLY = "Resume-only profile: no matching CSV row was merged into this card. All fields below are from the resume file."
MISMATCH_CSV = (
    "CSV and resume do not match: a resume file was listed for this CSV row in the manifest, but identity validation failed "
    "(email, phone, name, or filename), so this card shows CSV data only. The resume is shown as a separate profile."
)
MISMATCH_RESUME = (
    "CSV and resume do not match: this resume was listed in the CSV manifest for another candidate, but identity validation "
    "failed. This card shows resume data only."
)
UNREADABLE = ("CSV lists resume file '", "' for this row, but that file was empty, corrupted, or had no readable identity fields. This card shows CSV data only.")
MISSING = ("CSV lists resume file '", "' for this row, but that file was not found or could not be read. This card shows CSV data only.")


def around(text: tuple[str, str], value: str):
    return F.concat(F.lit(text[0]), F.col(value), F.lit(text[1]))


def noticed(profiles: DataFrame) -> DataFrame:
    """profiles with source_notice and meta.data_quality_notice; whether a resume was listed looks at all profiles."""
    listed = profiles.select(F.col("meta.manifest_resume").alias("_listed")).filter("_listed IS NOT NULL").distinct()
    own = profiles.join(listed, F.col("meta.resume_filename") == F.col("_listed"), "left")
    table, told = F.col("source_profile_kind") == "csv_only", F.col("source_profile_kind") == "resume_only"
    unreadable, missing = "meta.manifest_resume_unreadable", "meta.manifest_resume_missing"
    notice = (
        F.when(table & F.col(unreadable).isNotNull(), around(UNREADABLE, unreadable))
        .when(table & F.col(missing).isNotNull(), around(MISSING, missing))
        .when(table & F.col("meta.manifest_resume").isNotNull(), MISMATCH_CSV)
        .when(table, CSV_ONLY)
        .when(told & F.col("_listed").isNotNull(), MISMATCH_RESUME)
        .when(told, RESUME_ONLY)
    )
    row = F.coalesce(F.concat(F.lit(" (CSV row "), F.col("meta.csv_row_number").cast("string"), F.lit(")")), F.lit(""))
    nothing = (F.size("emails") == 0) & (F.size("phones") == 0)
    unnamed = (
        F.when(table, F.concat(F.lit("No candidate name on CSV"), row, F.lit(". "), F.when(nothing, "Email/phone also missing — this row had almost no data.").otherwise("Other CSV fields may still appear below.")))
        .when(told, F.concat(F.lit("Resume '"), F.coalesce("meta.resume_filename", F.lit("resume file")), F.lit("' had no readable name, email, or phone — likely empty, corrupted, or not a real resume.")))
        .otherwise("Name could not be resolved from CSV or resume.")
    )
    link = F.when(F.col(unreadable).isNotNull(), around(("Linked resume '", "' was empty or corrupted — not merged into this card."), unreadable))
    quality = F.nullif(F.concat_ws(" ", F.when(~person_name(F.col("full_name")), unnamed), link), F.lit(""))
    return own.withColumns({"source_notice": notice, "meta": F.col("meta").withField("data_quality_notice", quality)}).drop("_listed")


def batch_summary(profiles: DataFrame) -> DataFrame:
    count = lambda k: F.count_if(F.col("source_profile_kind") == k)
    return profiles.agg(
        F.count(F.lit(1)).alias("total"), count("merged").alias("merged"), count("csv_only").alias("csv_only"), count("resume_only").alias("resume_only"),
        F.count_if(F.coalesce(F.col("source_notice").contains("do not match"), F.lit(False))).alias("mismatched"),
    )
