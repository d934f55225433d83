"""Rows of tables and texts of resumes as records of one shape, in their defined order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dovetail.functions import extract, normalize
from dovetail.functions.normalize import SKILL_TYPE

STUDY = extract.STUDY
CSV = f"struct<row_number:bigint,name:string,email:string,phone:string,phone_method:string,company:string,title:string,description:string,years:double,years_method:string,skills:array<{SKILL_TYPE}>,education:array<{STUDY}>,file:string,unreadable:string,missing:string>"
RESUME = f"struct<full_name:string,emails:array<string>,phones:array<string>,phones_raw:array<struct<value:string,method:string>>,headline:string,location:struct<city:string,region:string,country:string>,links:struct<linkedin:string,github:string,portfolio:string,other:array<string>>,years:double,years_method:string,skills:array<{SKILL_TYPE}>,experience:array<{extract.ROLE}>,education:array<{STUDY}>,filename:string>"
#: Place of a record: table rows and what they list by row, then other resumes by path.
PLACE = "struct<late:int,row_number:bigint,second:int,path:string>"


def with_skills(rows: DataFrame, key: str, tokens: str, out: str) -> DataFrame:
    """rows with `out`, the skills of the array `tokens` in order.  Known spellings, which most tokens are, are looked up in
    place; each distinct other token is compared once with all names and joined."""
    each = rows.select(key, F.posexplode(tokens).alias("_at", "_token")).withColumn("_known", normalize.known_skill(F.col("_token")))
    at_once = each.filter("_known IS NOT NULL").select(key, "_at", F.col("_known").alias("skill"))
    others = each.filter("_known IS NULL").drop("_known")
    joined = others.join(normalize.skill_dictionary(others, "_token"), "_token").select(key, "_at", "skill")
    found = at_once.unionByName(joined).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "skill"))), lambda x: x["skill"]).alias(out))
    empty = F.array().cast(f"array<{SKILL_TYPE}>")
    return rows.join(found, key, "left").withColumn(out, F.coalesce(out, empty))


def first_of_each(items: Column, key) -> Column:
    """The items that are the first of their key, in order."""
    first = lambda x: extract.let(F.transform(x, key), lambda keys: F.filter(x, lambda y, i: F.array_position(keys, F.get(keys, i)) == i + 1))
    return extract.let(items, first)


def csv_education(raw: Column) -> Column:
    """`Institution - Degree, 2021` or `Institution, Degree, 2021` as an array of at most one study."""
    text = F.trim(raw)
    year = F.regexp_extract(text, r"\b((?:19|20)[0-9]{2})\b", 1)
    cut = F.when(year != "", F.regexp_replace(F.regexp_extract(text, r"(?s)^(.*?)\b(?:19|20)[0-9]{2}\b", 1), r"[ ,]+$", "")).otherwise(text)
    dashed = F.split(cut, " - ", 2)
    parts = F.filter(F.transform(F.split(cut, ","), lambda p: F.trim(p)), lambda p: p != "")
    is_dashed, is_listed = cut.contains(" - "), cut.contains(",")
    institution = F.when(is_dashed, F.trim(F.get(dashed, F.lit(0)))).when(is_listed, F.get(parts, F.lit(0))).otherwise(cut)
    degree = F.when(is_dashed, F.nullif(F.trim(F.get(dashed, F.lit(1))), F.lit(""))).when(is_listed, F.get(parts, F.lit(1)))
    one = F.struct(institution.alias("institution"), degree.alias("degree"), F.lit(None).cast("string").alias("field"), F.nullif(year, F.lit("")).cast("int").alias("end_year"))
    return F.when(text != "", F.array(one)).otherwise(F.array()).cast(f"array<{STUDY}>")


def normalized_table(rows: DataFrame, default_region: str | None = None) -> DataFrame:
    """Identified table rows with their normalised values in the struct `csv`."""
    tokens = F.filter(F.transform(F.split(F.coalesce("skills", F.lit("")), "[,;|]"), lambda t: F.trim(t)), lambda t: t != "")
    own = rows.withColumns({"_tokens": tokens, "_phone": normalize.phone(F.col("phone"), default_region), "_years": normalize.csv_years(F.col("experience_months"), F.col("years_experience"))})
    own = with_skills(own, "row_number", "_tokens", "_skills")
    has_phone = F.col("phone").isNotNull()
    parts = {
        "row_number": F.col("row_number"), "name": F.col("name"), "email": F.col("email"),
        "phone": F.when(has_phone, F.coalesce("_phone.e164", "_phone.raw")),
        "phone_method": F.when(has_phone & F.col("_phone.e164").isNull(), F.col("_phone.method")),
        "company": F.col("current_company"), "title": F.col("title"), "description": F.col("experience_description"),
        "years": F.col("_years.value"), "years_method": F.col("_years.method"),
        "skills": first_of_each(F.col("_skills"), lambda s: F.lower(s["name"])), "education": csv_education(F.col("education")),
        "file": normalize.file_name(F.col("resume_path")), "unreadable": F.lit(None).cast("string"), "missing": F.lit(None).cast("string"),
    }
    return own.select("source_id", F.struct(*[v.alias(k) for k, v in parts.items()]).cast(CSV).alias("csv"))


def extracted(texts: DataFrame, as_of: Column, default_region: str | None = None) -> DataFrame:
    """Resume texts with their fields in the struct `resume`."""
    text = F.col("raw_text")
    found = texts.withColumns({"_name": extract.name(text), "_sections": extract.sections(text)})
    phones = F.transform(extract.phones(text), lambda p: normalize.phone(p, default_region))
    worked = extract.worked_years(F.col("_sections.experience"), as_of)
    found = found.withColumns({"_phones": phones, "_worked": worked, "_tokens": F.col("_sections.skills")})
    found = with_skills(found, "file_path", "_tokens", "_skills")
    dated = F.transform("_sections.experience", lambda r: r.withField("start", normalize.year_month(r["start"])).withField("end", normalize.end_year_month(r["end"])))
    stated = extract.stated_years(text)
    parts = {
        "full_name": F.col("_name"), "emails": extract.emails(text),
        "phones": F.array_distinct(F.transform(F.filter("_phones", lambda p: p["e164"].isNotNull()), lambda p: p["e164"])),
        "phones_raw": F.transform(F.filter("_phones", lambda p: p["e164"].isNull()), lambda p: F.struct(p["raw"].alias("value"), p["method"].alias("method"))),
        "headline": extract.headline(text, F.col("_name")), "location": extract.location(text), "links": extract.links(text),
        "years": F.coalesce("_worked", stated),
        "years_method": F.when(F.col("_worked").isNotNull(), F.lit("calculated_from_date_range")).when(stated.isNotNull(), F.lit("regex_extraction")),
        "skills": F.col("_skills"), "experience": dated, "education": F.col("_sections.education"), "filename": F.col("filename"),
    }
    return found.select("source_id", "file_path", "filename", F.struct(*[v.alias(k) for k, v in parts.items()]).cast(RESUME).alias("resume"))


def usable(resume: str = "resume") -> Column:
    """Whether a resume names anyone: an email, a phone or a plausible name."""
    r = lambda c: F.col(f"{resume}.{c}")
    return F.coalesce((F.size(r("emails")) > 0) | (F.size(r("phones")) > 0) | (F.size(r("phones_raw")) > 0) | normalize.person_name(r("full_name")), F.lit(False))


def assembled(table: DataFrame, resumes: DataFrame) -> DataFrame:
    """All records: each row's listed resume stands before the row (once for each row that lists it), then come the
    resumes that no row lists, by path.  A row whose resume is unusable or missing says so."""
    place = lambda late, row, second, path: F.struct(F.lit(late).alias("late"), row.alias("row_number"), F.lit(second).alias("second"), path.alias("path")).cast(PLACE)
    none = lambda kind: F.lit(None).cast(kind)
    best = resumes.groupBy("filename").agg(F.min_by(F.struct("source_id", "file_path", "resume"), "file_path").alias("r"))
    files = best.select("filename", "r.*", usable("r.resume").alias("usable"))
    linked = table.join(files.select(F.col("filename").alias("_file"), F.col("source_id").alias("_source"), "file_path", "resume", "usable"), F.col("csv.file") == F.col("_file"), "left")
    listed = F.col("csv.file").isNotNull()
    state = F.when(listed & F.col("usable").isNull(), F.col("csv").cast(CSV).withField("missing", F.col("csv.file"))).when(listed & ~F.col("usable"), F.col("csv").withField("unreadable", F.col("csv.file"))).otherwise(F.col("csv"))
    rows = linked.select(place(0, F.col("csv.row_number"), 1, none("string")).alias("place"), F.lit("recruiter_csv").alias("source_type"), "source_id", state.alias("csv"), none(RESUME).alias("resume"))
    before = linked.filter("usable").select(place(0, F.col("csv.row_number"), 0, F.col("file_path")).alias("place"), F.lit("resume").alias("source_type"), F.col("_source").alias("source_id"), none(CSV).alias("csv"), "resume")
    others = files.filter("usable").join(table.select(F.col("csv.file").alias("filename")).distinct(), "filename", "left_anti")
    late = others.select(place(1, none("bigint"), 0, F.col("file_path")).alias("place"), F.lit("resume").alias("source_type"), "source_id", none(CSV).alias("csv"), "resume")
    every = rows.unionByName(before).unionByName(late)
    roles = F.get("resume.experience", F.lit(0))
    return every.select(
        "place", F.to_json("place").alias("record_id"), "source_type", "source_id",
        normalize.email_key(F.coalesce("csv.email", F.get("resume.emails", F.lit(0)))).alias("email"),
        normalize.phone_digits(F.coalesce("csv.phone", F.get(F.concat("resume.phones", F.transform("resume.phones_raw", lambda p: p["value"])), F.lit(0)))).alias("phone"),
        F.coalesce("csv.name", "resume.full_name").alias("name"), F.coalesce(F.col("csv.company"), roles["company"]).alias("company"),
        F.coalesce("csv.file", "resume.filename").alias("file"), "csv", "resume",
    )
