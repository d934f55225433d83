"""Recruiter tables from CSV files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Attributes with the headers that are accepted for them.
HEADERS = {
    "name": ["name", "full_name", "fullname", "full name", "candidate_name"],
    "email": ["email", "email_address", "e-mail"],
    "phone": ["phone", "phone_number", "mobile", "telephone"],
    "current_company": ["current_company", "company", "employer", "current employer", "company_name"],
    "title": ["title", "job_title", "current_title", "position"],
    "years_experience": ["years_experience", "years of experience", "experience_years", "yoe"],
    "experience_months": ["experience_months", "experience months", "months_experience"],
    "experience_description": ["experience_description", "experience description", "role_description", "job_description"],
    "skills": ["skills", "skill", "technical skills"],
    "education": ["education", "degree", "qualification"],
    "resume_path": ["resume_path", "resume", "resume_file"],
}
ATTRIBUTES = tuple(HEADERS)
#: A row is blank when none of these has a value.
CONTENT = ("name", "email", "phone", "current_company", "title", "resume_path", "years_experience", "skills", "education")


def header_key(header: str) -> str:
    return " ".join(header.strip().lower().split())


def attributes_of(headers: list[str]) -> dict[str, str]:
    """Attribute to the header that supplies it; of several the last."""
    known = {alias: attribute for attribute, aliases in HEADERS.items() for alias in aliases}
    return {known[header_key(h)]: h for h in headers if header_key(h) in known}


def clean(cell: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(cell.cast("string"), r"^\s+|\s+$", "")), F.lit(""))


def mapped(rows: DataFrame) -> DataFrame:
    """All attributes of a table by its headers, cleaned; what the table lacks is null.  Other columns are left out."""
    found = attributes_of(rows.columns)
    return rows.select(*[(clean(F.col(f"`{found[a]}`")) if a in found else F.lit(None).cast("string")).alias(a) for a in ATTRIBUTES], *[c for c in ("row_number",) if c in rows.columns])


def identified(rows: DataFrame) -> DataFrame:
    """Rows with content, their source_id and warnings."""
    some = F.coalesce(*[F.col(c) for c in CONTENT]).isNotNull()
    source = F.coalesce(F.concat(F.lit("csv_"), F.lower("email")), F.concat(F.lit("csv_row_"), F.col("row_number").cast("string")))
    warnings = F.when(F.col("email").isNull(), F.array(F.lit("missing email"))).otherwise(F.array().cast("array<string>"))
    return rows.filter(some).withColumns({"source_id": source, "warnings": warnings})


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file (UTF-8, with or without a byte order mark, quoted line breaks) as identified rows, numbered from 2
    in each file.

    A missing file and one without a known header give no rows.  Rows with cells too many or too few are kept."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("inferSchema", False)
    empty = spark.createDataFrame([], ", ".join(f"{a} string" for a in ATTRIBUTES) + ", row_number long")
    try:
        raw = reader.csv(path)
    except AnalysisException:
        return identified(empty)
    if not attributes_of(raw.columns):
        return identified(empty)
    place = Window.partitionBy("_file").orderBy("_place")  # a file is read by one task, in order
    numbered = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_place")).withColumn("row_number", (F.row_number().over(place) + 1).cast("long"))
    return identified(mapped(numbered))
