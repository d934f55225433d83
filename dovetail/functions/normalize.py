"""Normalisers of contact data, dates, countries, skills and years as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dovetail.functions.similarity import common, places

# Canonical skills with the other spellings that are accepted.
SKILLS = {
    "React": ["reactjs", "react.js", "react js"], "Node.js": ["node", "nodejs", "node js"], "Python": ["py"],
    "JavaScript": ["js"], "TypeScript": ["ts"], "Go": ["golang"], "AWS": ["amazon web services"], "PostgreSQL": ["postgres"],
    "MongoDB": ["mongo"], "Kubernetes": ["k8s"], "Machine Learning": ["ml"], "Deep Learning": ["dl"], "Ruby on Rails": ["rails"],
    "Apache Spark": ["spark"], "Java": [], "SQL": [], "Docker": [], "TensorFlow": [], "PyTorch": [], "HTML": [], "CSS": [],
    "C++": [], "C#": [], "Ruby": [], "Swift": [], "Kotlin": [], "Rust": [], "Scala": [], "Hadoop": [], "Git": [], "Linux": [],
    "Agile": [], "Scrum": [],
}
# Countries.
COUNTRIES = {
    "US": ["us", "usa", "united states", "united states of america"], "GB": ["gb", "uk", "united kingdom", "great britain", "england"],
    "IN": ["in", "india"], "CA": ["ca", "canada"], "AU": ["au", "australia"], "DE": ["de", "germany"], "FR": ["fr", "france"],
    "JP": ["jp", "japan"], "CN": ["cn", "china"], "SG": ["sg", "singapore"],
}
# Calling codes with patterns of national numbers (an approximation of the public numbering plans).
CALLING = {
    "1": "[2-9][0-9]{2}[2-9][0-9]{6}", "91": "[6-9][0-9]{9}|[1-5][0-9]{9}", "44": "[1-35789][0-9]{8,9}", "61": "[2-478][0-9]{8}", "49": "[1-9][0-9]{5,12}",
    "33": "[1-9][0-9]{8}", "81": "[1-9][0-9]{8,9}", "86": "1[3-9][0-9]{9}|[2-9][0-9]{8,10}", "65": "[3689][0-9]{7}", "34": "[5-9][0-9]{8}", "39": "[03][0-9]{5,10}",
    "31": "[1-9][0-9]{8}", "41": "[1-9][0-9]{8}", "46": "[1-9][0-9]{6,8}", "55": "[1-9][0-9]{9,10}", "52": "[1-9][0-9]{9}", "971": "[2-9][0-9]{7,8}", "972": "[2-9][0-9]{7,8}",
    "353": "[1-9][0-9]{6,8}", "880": "1[0-9]{9}", "92": "3[0-9]{9}|[2-9][0-9]{8,9}", "94": "[1-9][0-9]{8}", "7": "[3489][0-9]{9}", "82": "[1-9][0-9]{7,9}", "27": "[1-8][0-9]{8}",
}
# Calling codes of regions, with the digit that opens a national number at home.
REGIONS = {"US": ("1", "1"), "CA": ("1", "1"), "IN": ("91", "0"), "GB": ("44", "0"), "AU": ("61", "0"), "DE": ("49", "0"), "FR": ("33", "0"), "JP": ("81", "0"), "CN": ("86", "0"), "SG": ("65", "")}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FUZZY_SKILL = 85
NOW = "(?i)^(present|current|now)"


def lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def email_key(email: Column) -> Column:
    return F.lower(F.trim(email))


def phone_digits(phone: Column) -> Column:
    return F.nullif(F.regexp_replace(phone, "[^0-9]", ""), F.lit(""))


def phone(raw: Column, default_region: str | None = None) -> Column:
    """struct(e164, raw, confidence, method).  No country is guessed: without a default region only a number that begins
    with + is parsed; with one, others are national numbers there."""
    clean = F.trim(raw)
    digits = F.regexp_replace(clean, "[^0-9]", "")
    plan = "|".join(f"{code}(?:{rest})" for code, rest in CALLING.items())
    whole = F.regexp_replace(digits, "^44(0)", "44")
    abroad = clean.startswith("+")
    if default_region:
        code, trunk = REGIONS[default_region.upper()]
        whole = F.when(abroad, whole).otherwise(F.concat(F.lit(code), F.regexp_replace(digits, f"^{trunk}" if trunk else "^$", "")))
    result = lambda e164, conf, how, kept=clean: F.struct(e164.cast("string").alias("e164"), kept.alias("raw"), F.lit(conf).alias("confidence"), F.lit(how).alias("method"))
    none = F.lit(None)
    return (
        F.when(raw.isNull() | (clean == ""), result(none, 0.0, "empty", raw))
        .when(~abroad & F.lit(not default_region), result(none, 0.3, "unnormalized_no_country_code"))
        .when((F.char_length(digits) < 3) | abroad & digits.startswith("0") | clean.rlike("[^0-9+() ./\\-\\u00a0]"), result(none, 0.3, "unnormalized_parse_error"))
        .when(whole.rlike(f"^(?:{plan})$"), result(F.concat(F.lit("+"), whole), 0.95, "E164"))
        .otherwise(result(none, 0.3, "unnormalized_invalid"))
    )


def month_number(name: Column) -> Column:
    return lookup({m: f"{i:02d}" for i, m in enumerate(MONTHS, 1)}, F.substring(F.lower(name), 1, 3))


def year_month(raw: Column) -> Column:
    """YYYY-MM of `Mon YYYY`, `M/YYYY`, `YYYY` or `YYYY-MM...`, else null."""
    x = F.trim(raw)
    part = lambda p, g: F.regexp_extract(x, p, g)
    named, slashed, dashed = r"^([A-Za-z]+)\.?\s+([0-9]{4})", "^([0-9]{1,2})/([0-9]{4})", "^([0-9]{4})-([0-9]{2})"
    return (
        F.when(x.rlike(named) & month_number(part(named, 1)).isNotNull(), F.concat(part(named, 2), F.lit("-"), month_number(part(named, 1))))
        .when(x.rlike(slashed), F.concat(part(slashed, 2), F.lit("-"), F.lpad(part(slashed, 1), 2, "0")))
        .when(x.rlike("^[0-9]{4}$"), F.concat(x, F.lit("-01")))
        .when(x.rlike(dashed), F.concat(part(dashed, 1), F.lit("-"), part(dashed, 2)))
    )


def end_year_month(raw: Column) -> Column:
    return F.when(~F.trim(raw).rlike(NOW), year_month(raw))


def months_index(ym: Column) -> Column:
    """Months since year 0 of YYYY-MM; null where the month is none."""
    month = F.try_element_at(F.split(ym, "-"), F.lit(2)).try_cast("int")
    return F.when(month.between(1, 12), F.substring(ym, 1, 4).try_cast("int") * 12 + month - 1)


def country(raw: Column) -> Column:
    return lookup({name: code for code, names in COUNTRIES.items() for name in names}, F.lower(F.trim(raw)))


def number_in(raw: Column) -> Column:
    """The number that the digits and dots of a text make, or null."""
    return F.regexp_replace(raw, "[^0-9.]", "").try_cast("double")


def csv_years(months: Column, years: Column) -> Column:
    """struct(value, method): months above zero win, rounded half to even to one place; then the years column."""
    m, y = number_in(months), number_in(years)
    kind = "struct<value:double,method:string>"
    return (
        F.when(m > 0, F.struct(F.bround(m / 12, 1).alias("value"), F.lit("direct_field_csv_months").alias("method")).cast(kind))
        .when(y.isNotNull(), F.struct(y.alias("value"), F.lit("direct_field_csv").alias("method")).cast(kind))
    )


SKILL_TYPE = "struct<name:string,confidence:double,method:string,best_match:string,best_score:double>"


def skill_alias(raw: Column) -> Column:
    """The canonical skill of a known spelling, else null."""
    return lookup({v: name for name, more in SKILLS.items() for v in (name.lower(), *more)}, F.lower(F.trim(raw)))


def _closest(text: str) -> dict:
    """The canonical name most like a text (the first in order among equals), names that can't be better being passed over."""
    best, at = {"name": None, "score": -1.0}, places(text)
    for name in sorted(SKILLS):
        low, total = name.lower(), len(name) + len(text)
        if 200.0 * min(len(low), len(text)) / total > best["score"]:
            score = 100.0 if low == text else 200.0 * common(at, len(text), low) / total
            if score > best["score"]:
                best = {"name": name, "score": score}
    return best


def closest(clean: Column) -> Column:
    """For each text of an array, struct(name, score) of the closest canonical name; null for null."""

    def each(arrays: pd.Series) -> pd.Series:
        known: dict[str, dict] = {}  # of this batch
        found = lambda t: None if t is None else known[t] if t in known else known.setdefault(t, _closest(t))
        return pd.Series([None if a is None else [found(t) for t in a] for a in arrays], dtype=object)

    return F.pandas_udf(each, "array<struct<name:string,score:double>>")(clean)


def skills(raw: Column) -> Column:
    """For each text of an array, struct(name, confidence, method, best_match, best_score): a known spelling, else the closest
    canonical name if it is close enough, else the text as it stands."""
    unknown = F.transform(raw, lambda t: F.when(skill_alias(t).isNull() & (F.trim(t) != ""), F.lower(F.trim(t))))
    both = F.arrays_zip(raw.alias("raw"), closest(unknown).alias("best"))
    return F.transform(both, lambda z: skill_result(z["raw"], skill_alias(z["raw"]), z["best"]["name"], z["best"]["score"]))


def skill(raw: Column) -> Column:
    """skills() of one text."""
    return F.get(skills(F.array(raw)), F.lit(0))


def skill_result(raw: Column, alias: Column, name: Column, score: Column) -> Column:
    made = lambda n, c, m, b=F.lit(None), s=F.lit(None): F.struct(n.alias("name"), c.alias("confidence"), F.lit(m).alias("method"), b.alias("best_match"), s.alias("best_score")).cast(SKILL_TYPE)
    return (
        F.when(F.coalesce(F.trim(raw), F.lit("")) == "", made(F.coalesce(raw, F.lit("")), F.lit(0.0), "empty"))
        .when(alias.isNotNull(), made(alias, F.lit(0.95), "alias_dictionary"))
        .when(score >= FUZZY_SKILL, made(name, F.bround(score / 100, 2), "fuzzy_match_normalization"))
        .otherwise(made(F.trim(raw), F.lit(0.6), "kept_original_below_threshold", name, F.bround(score, 1)))
    )


def known_skill(raw: Column) -> Column:
    """The skill of a known spelling or of blank text, else null."""
    none = F.lit(None)
    return F.when(skill_alias(raw).isNotNull() | (F.trim(raw) == ""), skill_result(raw, skill_alias(raw), none.cast("string"), none.cast("double")))


def skill_dictionary(tokens: DataFrame, column: str) -> DataFrame:
    """(column, skill) for the distinct tokens: similarity is computed once for each, and only where no spelling is known."""
    one = tokens.select(column).distinct().withColumn("_known", known_skill(F.col(column)))
    return one.filter("_known IS NOT NULL").select(column, F.col("_known").alias("skill")).unionByName(one.filter("_known IS NULL").select(column, skill(F.col(column)).alias("skill")))


def candidate_id(email: Column) -> Column:
    return F.sha2(email_key(email), 256)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(name: Column) -> Column:
    """The name without its suffix, underscores and dashes as spaces."""
    return F.translate(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "_-", "  ")


def person_name(text: Column) -> Column:
    """Whether a text looks like a person's name: 2 to 60 characters, two letters at least, 85 % name characters."""
    x = F.trim(text)
    n = F.char_length(x)
    letters = F.regexp_count(x, F.lit(r"\p{L}"))
    plain = F.regexp_count(x, F.lit(r"[\p{L}\s.\-']"))
    return F.coalesce(n.between(2, 60) & (letters >= 2) & (plain >= n * 0.85), F.lit(False))


def binary_like(text: Column) -> Column:
    """Whether the first 800 characters hold too many control (4 %) or unprintable (12 %) characters."""
    head = F.substring(text, 1, 800)
    n = F.char_length(head)
    control = F.regexp_count(head, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    hidden = F.regexp_count(head, F.lit(r"[\p{C}\p{Z}&&[^ \n\r\t]]"))
    return F.coalesce((n > 0) & ((control > n * 0.04) | (hidden > n * 0.12)), F.lit(False))
