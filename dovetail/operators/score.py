"""Confidence, provenance and reasoning of merged profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dovetail.operators.merge import PROVENANCE, YEARS_GAP

# Weights of sources and methods.
WEIGHTS = {
    "recruiter_csv": 0.90, "resume": 0.75, "calculated_from_date_range": 0.70, "regex_extraction": 0.75, "alias_dictionary": 0.95,
    "fuzzy_match_normalization": 0.80, "unnormalized_no_country_code": 0.30, "unnormalized_invalid": 0.30, "E164": 0.95, "merged": 0.82,
    "direct_field_csv": 0.90, "direct_field_csv_months": 0.90,
}
TIERS = {"alias_dictionary": 0.80, "fuzzy_match_normalization": 0.70}
PLAIN_TIER, PHONES, RAW_PHONES, LOCATION, EXPERIENCE, EDUCATION, LINKS = 0.55, 0.95, 0.30, 0.65, 0.75, 0.72, 0.80
SINGLE_SOURCE, REQUIRED_WEIGHT = 0.85, 1.5
FIELDS = ("full_name", "emails", "phones", "phones_raw", "headline", "location", "years_experience", "skills", "experience", "education", "links")
SCORES = sorted({*WEIGHTS.values(), *TIERS.values(), PLAIN_TIER, PHONES, RAW_PHONES, LOCATION, EXPERIENCE, EDUCATION, LINKS, 0.0})
#: What a single source leaves of each score, rounded from its exact binary value.
SINGLE = {x: round(x * SINGLE_SOURCE, 3) for x in SCORES}


def number_map(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def skills_tier(skills: Column) -> Column:
    """The upper median of the skills' tiers."""
    tiers = F.array_sort(F.transform(skills, lambda s: F.coalesce(number_map(TIERS, s["method"]), F.lit(PLAIN_TIER))))
    return F.get(tiers, F.floor(F.size(tiers) / 2).cast("int"))


def union_source(sources: Column, merged_alone: bool = False) -> Column:
    """struct(source, method) of an array field from its entries' sources."""
    has = lambda s: F.array_contains(sources, s)
    made = lambda s, m: F.struct(F.lit(s).alias("source"), F.lit(m).alias("method"))
    both = made("merged", "union_csv_resume")
    only_resume = F.forall(sources, lambda s: s.isin("resume", "merged") if merged_alone else s == "resume")
    out = F.when(F.forall(sources, lambda s: s == "recruiter_csv"), made("recruiter_csv", "direct_field_csv"))
    if merged_alone:
        out = out.when(only_resume & ~has("resume"), both)
    return out.when(only_resume, made("resume", "regex_extraction")).otherwise(both)


def years_text(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def years_reasoning(listed: Column, told: Column) -> Column:
    percent = F.bround(F.abs(listed - told) / F.greatest(listed, told, F.lit(1.0)) * 100).cast("int").cast("string")
    return F.concat(
        F.lit("CSV states "), years_text(listed), F.lit(" years; resume's work history calculates to approximately "), years_text(F.bround(told, 1)), F.lit(" years — a "), percent,
        F.lit(f"% gap, which exceeds our {round(YEARS_GAP * 100)}% agreement threshold, so no value is being asserted for this field."),
    )


def phone_reasoning(method: Column, value: Column) -> Column:
    said = lambda head, tail: F.concat(F.lit(head), value, F.lit(tail))
    return (
        F.when(method == "unnormalized_invalid", said("The value '", "' is not a valid phone number, so it was discarded rather than treated as real data."))
        .when(method == "unnormalized_parse_error", said("The phone parser failed on this value ('", "'), so it was not normalized and is kept only in phones_raw."))
        .otherwise(said("Phone number '", "' has no country code, so it could not be normalized to E.164. We do not guess a country, so the raw digits are kept in phones_raw rather than asserting a normalized number."))
    )


def skill_reasoning(name: Column, best: Column, score: Column) -> Column:
    near = F.when(best.isNotNull() & score.isNotNull(), F.concat(F.lit(" (best match: '"), best, F.lit("' at "), F.bround(score).cast("int").cast("string"), F.lit("%)"))).otherwise("")
    return F.concat(F.lit("The skill '"), name, F.lit("' did not match any canonical skill name above our 85% similarity threshold"), near, F.lit(", so it was kept as originally written rather than being force-mapped."))


def overall(scores: Column) -> Column:
    """The weighted mean of a map of scores; name and emails weigh more; 0 without scores."""
    pairs = F.array_sort(F.map_entries(scores))
    weight = lambda e: F.when(e["key"].isin("full_name", "emails"), REQUIRED_WEIGHT).otherwise(1.0)
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, e: s + f(e))
    return F.when(F.size(pairs) > 0, F.bround(total(lambda e: e["value"] * weight(e)) / total(weight), 3)).otherwise(0.0)


def adjusted(scores: Column, match_method: Column, cap: Column, kind: Column) -> Column:
    """Scores of a listed match are capped, those of a single source lowered."""
    lowered = F.when(kind.isin("csv_only", "resume_only"), F.transform_values(scores, lambda _, v: number_map(SINGLE, v))).otherwise(scores)
    return F.when(match_method == "manifest_resume_link", F.transform_values(scores, lambda _, v: F.least(v, cap))).otherwise(lowered)


def settled(rows: DataFrame) -> DataFrame:
    """rows, with each column computed once: what is selected from them doesn't repeat their expressions."""
    return rows.select(F.explode(F.array(F.struct("*"))).alias("row")).select("row.*")


def scored(profiles: DataFrame) -> DataFrame:
    """Merged profiles with field_confidence, field_reasoning, overall_confidence and all provenance."""
    kind = F.col("source_profile_kind")
    told = kind == "resume_only"
    made = lambda s, m: F.struct(F.lit(s).alias("source"), F.lit(m).alias("method"))
    scalar_from = F.when(told, made("resume", "regex_extraction")).otherwise(made("recruiter_csv", "direct_field_csv"))
    own_weight = F.when(told, WEIGHTS["resume"]).otherwise(WEIGHTS["recruiter_csv"])
    years = F.get("provenance", F.lit(0))
    suppressed = F.coalesce(years["method"] == "suppressed_disagreement", F.lit(False))
    years_score = F.coalesce(number_map(WEIGHTS, years["method"]), F.when(years["source"] == "resume", WEIGHTS["resume"]).otherwise(WEIGHTS["recruiter_csv"]))
    details = F.col("meta.phones_raw_details")
    from_csv = F.exists(details, lambda d: d["source"] == "recruiter_csv")
    phones_from = F.when(told | ((kind == "merged") & ~from_csv), made("resume", "E164")).otherwise(made("recruiter_csv", "E164"))
    some = lambda c: F.size(c) > 0
    has_location = F.col("location").isNotNull() & F.array_contains("meta.group_sources", "resume")
    has_links = F.coalesce(*[F.nullif(f"links.{k}", F.lit("")) for k in ("linkedin", "github", "portfolio")]).isNotNull()
    plan = {
        "full_name": (F.coalesce(F.col("full_name") != "", F.lit(False)), own_weight, scalar_from),
        "emails": (some("emails"), own_weight, scalar_from),
        "phones": (some("phones"), F.lit(PHONES), phones_from),
        "phones_raw": (some("phones_raw"), F.lit(RAW_PHONES), F.struct(F.get(details, F.lit(0))["source"].alias("source"), F.get(details, F.lit(0))["method"].alias("method"))),
        "headline": (F.coalesce(F.col("headline") != "", F.lit(False)), own_weight, scalar_from),
        "location": (has_location, F.lit(LOCATION), made("resume", "regex_extraction")),
        "years_experience": (suppressed | F.col("years_experience").isNotNull(), F.when(suppressed, 0.0).otherwise(years_score), None),
        "skills": (some("skills"), skills_tier(F.col("skills")), union_source(F.flatten(F.transform("skills", lambda s: s["sources"])))),
        "experience": (some("experience"), F.lit(EXPERIENCE), union_source(F.transform("experience", lambda e: e["source"]))),
        "education": (some("education"), F.lit(EDUCATION), union_source(F.transform("education", lambda e: e["source"]), merged_alone=True)),
        "links": (has_links, F.lit(LINKS), made("resume", "regex_extraction")),
    }
    entries = F.array_compact(F.array(*[F.when(has, F.struct(F.lit(f).alias("key"), s.cast("double").alias("value"))) for f, (has, s, _) in plan.items()]))
    new = F.array_compact(F.array(*[F.when(has, F.struct(F.lit(f).alias("field"), p["source"].alias("source"), p["method"].alias("method"), F.lit(None).cast("string").alias("notes"), F.lit(None).alias("candidate_values")).cast(PROVENANCE)) for f, (has, _, p) in plan.items() if p is not None]))
    values = years["candidate_values"]
    kept = F.filter("skills", lambda s: s["method"] == "kept_original_below_threshold")
    said = {
        "phones_raw": F.when(some("phones_raw"), F.array_join(F.transform(details, lambda d: phone_reasoning(d["method"], d["value"])), " ")),
        "years_experience": F.when(suppressed, years_reasoning(F.get(values, F.lit(0))["value"], F.get(values, F.lit(1))["value"])),
        "skills": F.when(some(kept), F.array_join(F.transform(kept, lambda s: skill_reasoning(s["name"], s["best_match"], s["best_score"])), " ")),
    }
    reasons = F.map_from_entries(F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.alias("value"))) for k, v in said.items()])))
    out = settled(profiles).withColumns({"field_confidence": F.map_from_entries(entries), "field_reasoning": reasons, "_new": new})
    out = settled(out.withColumn("field_confidence", adjusted(F.col("field_confidence"), F.col("meta.match_method"), F.col("meta.match_confidence"), kind)))
    return out.withColumns({"overall_confidence": overall(F.col("field_confidence")), "provenance": F.concat("provenance", "_new")}).drop("_new")
