"""Records of one person as one canonical profile.

A group's distinct records are gathered in order as two arrays, of table rows and of resumes; everything else is
array functions over them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dovetail.functions.extract import ROLE, STUDY, let
from dovetail.functions.normalize import candidate_id
from dovetail.functions.similarity import ratio
from dovetail.operators.records import first_of_each

YEARS_GAP = 0.15
COMPANY_AGREES, TITLE_AGREES = 85, 80
SOURCED_ROLE = ROLE[:-1] + ",source:string>"
SOURCED_STUDY = STUDY[:-1] + ",source:string>"
SKILL = "struct<name:string,confidence:double,sources:array<string>,method:string,best_match:string,best_score:double>"
CANDIDATE = "struct<source:string,value:double,method:string>"
PROVENANCE = f"struct<field:string,source:string,method:string,notes:string,candidate_values:array<{CANDIDATE}>>"


def similar(a: str | None, b: str | None) -> float:
    """The indel ratio of two texts, trimmed and in lower case; -1 where one is missing."""
    if not a or not b:
        return -1.0
    return ratio(a.strip().lower(), b.strip().lower())


def fold_roles(roles: list[dict], current: list[dict]) -> list[dict]:
    """Roles of the resumes, once each, and the current roles of table rows: one that agrees with a role takes it over;
    one at another company than the first role goes before all; any other is added at the end if its company and title
    are new."""
    low = lambda v: (v or "").strip().lower()
    out: list[dict] = []
    seen: set[tuple] = set()

    def add(entry: dict, place: int | None = None) -> None:
        key = (low(entry["company"]), low(entry["title"]), low(entry["start"]))
        if key not in seen:
            seen.add(key)
            out.insert(len(out) if place is None else place, entry)

    for r in roles:
        add({**r, "source": "resume"})
    for c in current:
        if not (c["company"] or c["title"] or c["summary"]):
            continue
        twin = next((e for e in out if similar(e["company"], c["company"]) >= COMPANY_AGREES and (not c["title"] or similar(e["title"], c["title"]) >= TITLE_AGREES)), None)
        if twin is not None:
            twin.update({k: c[k] for k in ("company", "title", "summary") if c[k]}, source="merged")
            continue
        new = {"company": c["company"], "title": c["title"], "start": None, "end": None, "summary": c["summary"], "is_current": None, "source": "recruiter_csv"}
        if out and c["company"] and similar(out[0]["company"], c["company"]) < COMPANY_AGREES:
            add(new, 0)
        elif not any(low(e["company"]) == low(c["company"]) and low(e["title"]) == low(c["title"]) for e in out):
            add(new)
    return out


def fold_studies(listed: list[dict], told: list[dict]) -> list[dict]:
    """One study for each institution: table rows' first; resumes fill what is missing."""
    out: dict[str, dict] = {}
    for source, studies in (("recruiter_csv", listed), ("resume", told)):
        for s in studies:
            key = (s["institution"] or "").strip().lower()
            if not key:
                continue
            known = out.setdefault(key, {**s, "source": source})
            if source == "resume":
                known["degree"] = known["degree"] or s["degree"]
                known["end_year"] = known["end_year"] or s["end_year"]
                known["source"] = known["source"] if known["source"] == "resume" else "merged"
    return list(out.values())


def _rows(values) -> list[dict]:
    return [dict(v) for v in values] if values is not None else []


def experience(roles: Column, current: Column) -> Column:
    return F.pandas_udf(_experience, f"array<{SOURCED_ROLE}>")(roles, current)


def education(listed: Column, told: Column) -> Column:
    return F.pandas_udf(_education, f"array<{SOURCED_STUDY}>")(listed, told)


def _experience(roles: pd.Series, current: pd.Series) -> pd.Series:
    return pd.Series([fold_roles(_rows(r), _rows(c)) for r, c in zip(roles, current, strict=True)], dtype=object)


def _education(listed: pd.Series, told: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(listed, told, strict=True):
        both = [[{**x, "end_year": None if pd.isna(x["end_year"]) else int(x["end_year"])} for x in _rows(v)] for v in (a, b)]
        out.append(fold_studies(*both))
    return pd.Series(out, dtype=object)


def each(rows: str, path: str) -> Column:
    """The non-null values of a path over an array of records."""
    def value(r: Column) -> Column:
        for part in path.split("."):
            r = r[part]
        return r

    return F.filter(F.transform(rows, value), lambda v: v.isNotNull())


def first(rows: str, path: str) -> Column:
    return F.get(each(rows, path), F.lit(0))


def flat(rows: str, path: str) -> Column:
    return F.flatten(each(rows, path))


def scalar(listed: Column, told: Column) -> Column:
    """Equal but for case and outer spaces: as listed; else the resume's; else what there is."""
    same = F.lower(F.trim(listed.cast("string"))) == F.lower(F.trim(told.cast("string")))
    return F.when(same, listed).otherwise(F.coalesce(told, listed))


def reconciled_years(listed: Column, told: Column) -> Column:
    """struct(value, provenance) from arrays of (value, method) of table rows and of resumes."""
    a, b = F.get(listed, F.lit(0)), F.get(told, F.lit(0))
    x, y = a["value"], b["value"]
    gap = F.abs(x - y) / F.greatest(x, y, F.lit(1.0))
    both = F.array(F.struct(F.lit("recruiter_csv").alias("source"), x.alias("value"), a["method"].alias("method")), F.struct(F.lit("resume").alias("source"), y.alias("value"), b["method"].alias("method")))
    note = F.concat(F.lit("Disagreement: CSV="), x.cast("string"), F.lit(" vs resume="), y.cast("string"), F.lit(" ("), F.bround(gap * 100).cast("int").cast("string"), F.lit("% gap) — value suppressed"))
    entry = lambda source, method, notes=F.lit(None), values=F.lit(None): F.struct(F.lit("years_experience").alias("field"), F.lit(source).alias("source"), method.alias("method"), notes.alias("notes"), values.alias("candidate_values")).cast(PROVENANCE)
    out = lambda value, p: F.struct(value.cast("double").alias("value"), p.alias("provenance"))
    return (
        F.when(a.isNull() & b.isNull(), out(F.lit(None), F.lit(None).cast(PROVENANCE)))
        .when(b.isNull(), out(x, entry("recruiter_csv", a["method"])))
        .when(a.isNull(), out(y, entry("resume", b["method"])))
        .when(gap > YEARS_GAP, out(F.lit(None), entry("merged", F.lit("suppressed_disagreement"), note, both)))
        .otherwise(out(F.bround((x + y) / 2, 2), entry("merged", F.lit("averaged_agreement"), F.lit(None), both)))
    )


def union_skills(listed: Column, told: Column) -> Column:
    """Skills of both, once for each name in any case, with the sources that have it."""
    mark = lambda items, source: F.transform(items, lambda s: F.struct(F.lower(s["name"]).alias("key"), F.lit(source).alias("source"), s.alias("s")))
    every = F.filter(F.concat(mark(listed, "recruiter_csv"), mark(told, "resume")), lambda e: e["key"] != "")
    sources = lambda x, e: F.array_distinct(F.transform(F.filter(x, lambda o: o["key"] == e["key"]), lambda o: o["source"]))
    made = lambda x, e: F.struct(e["s"]["name"].alias("name"), e["s"]["confidence"].alias("confidence"), sources(x, e).alias("sources"), e["s"]["method"].alias("method"), e["s"]["best_match"].alias("best_match"), e["s"]["best_score"].alias("best_score"))
    return let(every, lambda x: F.transform(first_of_each(x, lambda e: e["key"]), lambda e: made(x, e))).cast(f"array<{SKILL}>")


def routed_phones(listed: Column, told: Column, told_raw: Column) -> Column:
    """struct(phones, phones_raw): distinct phones, table rows' first; those with a country code are normalised."""
    mark = lambda items, sure: F.transform(items, lambda p: F.struct(p.alias("value"), (p.startswith("+") if sure else F.lit(False)).alias("plus")))
    every = F.filter(F.concat(mark(listed, True), mark(told, True), mark(told_raw, False)), lambda p: p["value"] != "")
    pick = lambda x, plus: F.transform(F.filter(x, lambda p: p["plus"] if plus else ~p["plus"]), lambda p: p["value"])
    firsts = let(every, lambda x: first_of_each(x, lambda p: p["value"]))
    return let(firsts, lambda x: F.struct(pick(x, True).alias("phones"), pick(x, False).alias("phones_raw")))


def gathered(resolved: DataFrame) -> DataFrame:
    """One row for each group: its matching and the arrays c (table rows) and r (resumes), in record order."""
    record = F.struct("place", "source_type", "source_id", "csv", "resume")
    rows = resolved.groupBy("group_id").agg(F.first("group_order").alias("group_order"), F.first("match_method").alias("match_method"), F.first("match_confidence").alias("match_confidence"), F.array_sort(F.collect_list(record)).alias("all"))
    of = lambda kind, part: F.transform(F.filter("all", lambda x: x["source_type"] == kind), lambda x: x[part])
    return rows.select("group_id", "group_order", "match_method", "match_confidence", F.get("all", F.lit(0))["source_id"].alias("first_source"), of("recruiter_csv", "csv").alias("c"), of("resume", "resume").alias("r"))


def merged(groups: DataFrame, source_priority: tuple[str, ...] = ("resume", "recruiter_csv")) -> DataFrame:
    """Canonical profiles before scoring; source_priority: whose email comes first as the candidate's id."""
    value = lambda rows: F.transform(F.filter(rows, lambda x: x["years"].isNotNull()), lambda x: F.struct(x["years"].alias("value"), x["years_method"].alias("method")))
    raw = flat("r", "phones_raw")
    first_email = {"resume": F.get(flat("r", "emails"), F.lit(0)), "recruiter_csv": first("c", "email")}
    email = F.coalesce(*[first_email[s] for s in source_priority if s in first_email], F.lit(None).cast("string"))
    phones = routed_phones(each("c", "phone"), flat("r", "phones"), F.transform(raw, lambda p: p["value"]))
    detail = "struct<value:string,method:string,source:string>"
    known = F.concat(
        F.transform(F.filter("c", lambda x: x["phone"].isNotNull() & x["phone_method"].isNotNull()), lambda x: F.struct(x["phone"].alias("value"), x["phone_method"].alias("method"), F.lit("recruiter_csv").alias("source"))),
        F.transform(raw, lambda p: F.struct(p["value"].alias("value"), p["method"].alias("method"), F.lit("resume").alias("source"))),
    )
    fallback = lambda p: F.struct(p.alias("value"), F.lit("unnormalized_no_country_code").alias("method"), F.lit("resume").alias("source"))
    detailed = lambda p, k: F.transform(p["phones_raw"], lambda x: F.coalesce(F.get(F.filter(k, lambda y: y["value"] == x), F.lit(0)), fallback(x))).cast(f"array<{detail}>")
    contact = let(F.struct(phones.alias("p"), known.alias("k")), lambda x: F.struct(x["p"]["phones"].alias("phones"), x["p"]["phones_raw"].alias("phones_raw"), detailed(x["p"], x["k"]).alias("details")))
    years = let(F.struct(value("c").alias("c"), value("r").alias("r")), lambda x: reconciled_years(x["c"], x["r"]))
    has_c, has_r = F.size("c") > 0, F.size("r") > 0
    current = F.transform("c", lambda x: F.struct(x["company"].alias("company"), x["title"].alias("title"), x["description"].alias("summary")))
    staged = groups.withColumns({
        "_years": years, "_contact": contact,
        "experience": experience(flat("r", "experience"), current), "education": education(flat("c", "education"), flat("r", "education")),
    })
    return staged.select(
        "group_id", "group_order",
        F.coalesce(candidate_id(email), F.concat(F.lit("unknown_"), "first_source")).alias("candidate_id"),
        scalar(first("c", "name"), first("r", "full_name")).alias("full_name"),
        first_of_each(F.concat(each("c", "email"), flat("r", "emails")), F.lower).alias("emails"),
        F.col("_contact.phones").alias("phones"), F.col("_contact.phones_raw").alias("phones_raw"),
        first("r", "location").alias("location"),
        F.struct(first("r", "links.linkedin").alias("linkedin"), first("r", "links.github").alias("github"), first("r", "links.portfolio").alias("portfolio"), F.array_distinct(flat("r", "links.other")).alias("other")).alias("links"),
        F.coalesce(F.get(F.filter(F.transform(flat("r", "experience"), lambda e: e["title"]), lambda t: t.isNotNull()), F.lit(0)), first("r", "headline"), first("c", "title")).alias("headline"),
        F.col("_years.value").alias("years_experience"),
        union_skills(flat("c", "skills"), flat("r", "skills")).alias("skills"), "experience", "education",
        F.array_compact(F.array("_years.provenance")).alias("provenance"),
        F.when(has_c & has_r, F.lit("merged")).when(has_c, F.lit("csv_only")).otherwise(F.lit("resume_only")).alias("source_profile_kind"),
        F.struct(
            "match_method", "match_confidence", F.array_compact(F.array(F.when(has_c, F.lit("recruiter_csv")), F.when(has_r, F.lit("resume")))).alias("group_sources"),
            first("c", "file").alias("manifest_resume"), first("r", "filename").alias("resume_filename"), F.element_at(F.concat(F.array(F.lit(None).cast("bigint")), each("c", "row_number")), -1).alias("csv_row_number"),
            F.element_at(F.concat(F.array(F.lit(None).cast("string")), each("c", "unreadable")), -1).alias("manifest_resume_unreadable"), F.element_at(F.concat(F.array(F.lit(None).cast("string")), each("c", "missing")), -1).alias("manifest_resume_missing"),
            F.col("_contact.details").alias("phones_raw_details"),
        ).alias("meta"),
    )
