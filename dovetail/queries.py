"""Queries over the driver's tables that apply the engine's operators, each with its SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dovetail.functions import extract, normalize, similarity
from dovetail.operators import merge, records, resolve, score
from dovetail.plans import projection
from dovetail.plans.shared import spread
from dovetail.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- text -------------------------------------------------------------------------------------------------------


@query(r"""
WITH m AS (SELECT doc_id, list_distinct_keep AS e FROM (SELECT doc_id, list_filter(x, lambda v, i: list_position(x, v) = i) AS list_distinct_keep
  FROM (SELECT doc_id, regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b') AS x FROM documents)))
SELECT doc_id, CAST(i AS INTEGER) AS pos, e[i + 1] AS email, lower(trim(e[i + 1])) AS email_key, sha256(lower(trim(e[i + 1]))) AS candidate_id
FROM (SELECT doc_id, e, unnest(range(0, len(e))) AS i FROM m)""")
def extract_emails(spark, sf_dir):
    """Email addresses with their order, key and candidate id."""
    found = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(extract.emails(F.col("text"))).alias("pos", "email"))
    return found.select("doc_id", "pos", "email", normalize.email_key(F.col("email")).alias("email_key"), normalize.candidate_id(F.col("email")).alias("candidate_id"))


# Numbering plans of the calling codes that these numbers have, written out once more for the comparison.
PLANS_SQL = "1(?:[2-9][0-9]{2}[2-9][0-9]{6})|91(?:[6-9][0-9]{9}|[1-5][0-9]{9})|44(?:[1-35789][0-9]{8,9})|49(?:[1-9][0-9]{5,12})|33(?:[1-9][0-9]{8})|34(?:[5-9][0-9]{8})|61(?:[2-478][0-9]{8})|81(?:[1-9][0-9]{8,9})|86(?:1[3-9][0-9]{9}|[2-9][0-9]{8,10})|65(?:[3689][0-9]{7})"
PHONE_SQL = r"""(SELECT doc_id, list_filter(x, lambda v, i: v <> '' AND list_position(x, v) = i) AS e
  FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '(?:\+?\d{1,3}[-.\s]?)?(?:\(?\d{2,4}\)?[-.\s]?)?\d{3,4}[-.\s]?\d{3,4}\b'), lambda v: trim(v)) AS x FROM documents))"""


@query(f"""SELECT doc_id, CAST(i AS INTEGER) AS pos, e[i + 1] AS phone, nullif(regexp_replace(e[i + 1], '[^0-9]', '', 'g'), '') AS digits,
  CASE WHEN e[i + 1] NOT LIKE '+%' THEN 'unnormalized_no_country_code' WHEN regexp_matches(e[i + 1], '[^0-9+() ./\\-]') OR length(regexp_replace(e[i + 1], '[^0-9]', '', 'g')) < 3 OR regexp_replace(e[i + 1], '[^0-9]', '', 'g') LIKE '0%' THEN 'unnormalized_parse_error'
    WHEN regexp_matches(regexp_replace(regexp_replace(e[i + 1], '[^0-9]', '', 'g'), '^440', '44'), '^(?:{PLANS_SQL})$') THEN 'E164' ELSE 'unnormalized_invalid' END AS method
FROM (SELECT doc_id, e, unnest(range(0, len(e))) AS i FROM {PHONE_SQL})""")
def extract_phones(spark, sf_dir):
    """E3, N13 and N1 over the numbers of real texts."""
    found = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(extract.phones(F.col("text"))).alias("pos", "phone"))
    return found.select("doc_id", "pos", "phone", normalize.phone_digits(F.col("phone")).alias("digits"), normalize.phone(F.col("phone"))["method"].alias("method"))




@query(f"""WITH p AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '+1 415 555 ' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') WHEN 1 THEN '+91 98765 ' || lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0')
    WHEN 2 THEN '98765' || CAST(c_custkey AS VARCHAR) WHEN 3 THEN '+44 (0)20 79' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') ELSE '+999' || CAST(c_custkey AS VARCHAR) END AS raw FROM customer),
d AS (SELECT *, regexp_replace(regexp_replace(raw, '[^0-9]', '', 'g'), '^440', '44') AS w FROM p)
SELECT c_custkey, raw, CASE WHEN raw LIKE '+%' AND regexp_matches(w, '^(?:{PLANS_SQL})$') THEN '+' || w END AS e164,
  CASE WHEN raw NOT LIKE '+%' THEN 'unnormalized_no_country_code' WHEN regexp_matches(w, '^(?:{PLANS_SQL})$') THEN 'E164' ELSE 'unnormalized_invalid' END AS method,
  CASE WHEN raw LIKE '+%' AND regexp_matches(w, '^(?:{PLANS_SQL})$') THEN 0.95::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM d""")
def phone_classify(spark, sf_dir):
    """N1 over phones in five forms."""
    k = F.col("c_custkey")
    padded = lambda n: F.lpad((k % 10**n).cast("string"), n, "0")
    raw = F.when(k % 5 == 0, F.concat(F.lit("+1 415 555 "), padded(4))).when(k % 5 == 1, F.concat(F.lit("+91 98765 "), padded(5))).when(k % 5 == 2, F.concat(F.lit("98765"), k.cast("string"))).when(k % 5 == 3, F.concat(F.lit("+44 (0)20 79"), padded(6))).otherwise(F.concat(F.lit("+999"), k.cast("string")))
    out = read(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")).withColumn("p", normalize.phone(F.col("raw")))
    return out.select("c_custkey", "raw", "p.e164", "p.method", "p.confidence")


@query(r"""WITH u AS (SELECT page_id, regexp_extract_all(url || ' ' || html, '(?i)https?://[\w./?=#&%-]+') AS all_urls, url || ' ' || html AS t FROM pages),
v AS (SELECT page_id, list_filter(all_urls, lambda x: NOT contains(lower(x), 'linkedin.com') AND NOT contains(lower(x), 'github.com')) AS rest FROM u)
SELECT page_id, rest[1] AS portfolio, CAST(greatest(len(rest) - 1, 0) AS INTEGER) AS n_other, array_to_string(rest[2:], ' ') AS other FROM v""")
def page_links(spark, sf_dir):
    """The first other address and the rest (ASCII word characters, for comparison)."""
    text = F.concat_ws(" ", "url", "html")
    found = read(spark, sf_dir, "pages").select("page_id", extract.links(text).alias("l"))
    return found.select("page_id", "l.portfolio", F.size("l.other").alias("n_other"), F.array_join("l.other", " ").alias("other"))


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
f AS (SELECT doc_id, ls, ls[1] AS a FROM l)
SELECT doc_id, CASE WHEN regexp_matches(a, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b') OR length(a) > 60 THEN NULL
  WHEN length(a) < 2 OR len(regexp_extract_all(a, '\p{L}')) < 2 OR len(regexp_extract_all(a, '[\p{L}\s.\-'']')) < length(a) * 0.85 THEN NULL
  WHEN regexp_matches(lower(a), '^(resume|curriculum vitae|cv)$') THEN ls[2] ELSE a END AS name FROM f""")
def first_line_names(spark, sf_dir):
    """The name that a text's first line gives."""
    return read(spark, sf_dir, "documents").select("doc_id", extract.name(F.col("text")).alias("name"))


@query(r"""WITH h AS (SELECT doc_id, substr(text, 1, 800) AS t FROM documents)
SELECT doc_id, CAST(len(regexp_extract_all(t, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) AS INTEGER) AS n_control,
  length(t) > 0 AND (len(regexp_extract_all(t, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) > length(t) * 0.04 OR len(regexp_extract_all(t, '[\p{C}\p{Z}]')) - len(regexp_extract_all(t, '[ \n\r\t]')) > length(t) * 0.12) AS binary_like FROM h""")
def text_quality_gate(spark, sf_dir):
    """S13."""
    control = F.regexp_count(F.substring("text", 1, 800), F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"))
    return read(spark, sf_dir, "documents").select("doc_id", control.alias("n_control"), normalize.binary_like(F.col("text")).alias("binary_like"))


@query(r"""WITH n AS (SELECT 'customer' AS kind, c_custkey AS k, c_name AS s FROM customer UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation UNION ALL SELECT 'part', p_partkey, p_name FROM part)
SELECT kind, CAST(k AS BIGINT) AS k, length(trim(s)) BETWEEN 2 AND 60 AND len(regexp_extract_all(trim(s), '\p{L}')) >= 2 AND len(regexp_extract_all(trim(s), '[\p{L}\s.\-'']')) >= length(trim(s)) * 0.85 AS looks_like_name FROM n""")
def name_like(spark, sf_dir):
    """N11 over names of several kinds."""
    each = [read(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(k).cast("long").alias("k"), normalize.person_name(F.col(n)).alias("looks_like_name")) for t, k, n in (("customer", "c_custkey", "c_name"), ("nation", "n_nationkey", "n_name"), ("part", "p_partkey", "p_name"))]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("""SELECT conv_id, turn, greatest(0, CAST(try_cast(regexp_extract(lower(text), '([0-9]+(?:\\.[0-9]+)?)\\+?\\s*(?:years?|yrs?)(?:\\s+of)?\\s+(?:experience|exp)', 1) AS DOUBLE) AS DOUBLE)) AS stated FROM
  (SELECT conv_id, turn, text || ' I have ' || CAST(turn + 1 AS VARCHAR) || '.5+ years of experience' AS text FROM conversations)""")
def stated_years(spark, sf_dir):
    """E14."""
    text = F.concat("text", F.lit(" I have "), (F.col("turn") + 1).cast("string"), F.lit(".5+ years of experience"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", extract.stated_years(text).alias("stated"))


def written_resumes(spark, sf_dir) -> DataFrame:
    """Customers as resumes in one layout, with what is rare in some of them."""
    k, ks, n = F.col("c_custkey"), F.col("c_custkey").cast("string"), F.lit("\n")
    year = lambda m: (F.lit(1990) + k % m).cast("string")
    place = F.when(k % 3 == 0, "Pune, MH").when(k % 3 == 1, "Lyon, France").otherwise("somewhere")
    first = F.when(k % 4 == 0, F.concat(F.col("c_mktsegment"), F.lit(" - Engineer"), n, F.lit("Jan "), year(20), F.lit(" - Mar "), year(30), n, F.lit("Built things."), n, F.lit("And more."))).otherwise(F.concat(F.lit("Clerk"), n, F.col("c_mktsegment"), n, F.lit("2/"), year(20), F.lit(" – Present")))
    second = F.concat(F.lit("2001 - 2003"), n, F.lit("Helper"), n, F.lit("Odd Jobs"))
    study = F.concat(F.lit("School "), ks, n, F.lit("Master of Arts"), n, F.when(k % 2 == 0, F.lit("History")).otherwise(F.lit("no degree here")), n, F.lit("2009 or 2011"))
    skills = F.concat(F.lit("• SQL, "), F.col("c_mktsegment"), F.lit(",SQL"), n, F.lit("Rust | Go"), n, F.lit("Key skills"), n, F.lit("- Typing"))
    text = F.concat(F.lit("Ana Lima"), n, place, n, n, F.lit("Maker of "), F.col("c_mktsegment"), n, F.lit("ana@x.org"), n, n, F.lit("Work  Experience"), n, first, n, n, second, n, n, F.lit(" EDUCATION "), n, study, n, n, F.lit("Technical skills"), n, skills)
    return spread(read(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", text.alias("text"))


@query("""SELECT c_custkey, 'Ana Lima' AS name, 'Maker of ' || c_mktsegment AS headline, CASE c_custkey % 3 WHEN 0 THEN 'Ana Lima' || chr(10) || 'Pune' WHEN 1 THEN 'Ana Lima' || chr(10) || 'Lyon' END AS city, CASE c_custkey % 3 WHEN 0 THEN 'MH' END AS region, CASE c_custkey % 3 WHEN 0 THEN 'US' END AS country,
  'SQL;' || c_mktsegment || ';Rust;Go;Typing' AS skills FROM customer""")
def resume_heads(spark, sf_dir):
    """Name, headline, place and skill tokens of written resumes."""
    t = F.col("text")
    named = score.settled(written_resumes(spark, sf_dir).withColumn("name", extract.name(t)))
    out = score.settled(named.select("c_custkey", "name", extract.headline(t, F.col("name")).alias("headline"), extract.location(t).alias("l"), extract.sections(t, "skills")["skills"].alias("s")))
    place = lambda c: F.when(F.col("c_custkey") % 3 != 2, F.col(f"l.{c}")).alias(c)  # noqa: E731  (the third kind's city is text of the next lines)
    return out.select("c_custkey", "name", "headline", place("city").alias("city"), place("region"), place("country"), F.array_join("s", ";").alias("skills"))


@query("""WITH r AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_custkey % 20 + 1990 AS a, c_custkey % 30 + 1990 AS b FROM customer)
SELECT k AS c_custkey, 0 AS pos, CASE WHEN k % 4 = 0 THEN 'Engineer' ELSE 'Clerk' END AS title, seg AS company, a || CASE WHEN k % 4 = 0 THEN '-01' ELSE '-02' END AS start, CASE WHEN k % 4 = 0 THEN b || '-03' END AS finish, CASE WHEN k % 4 = 0 THEN 'Built things. And more.' END AS summary, k % 4 <> 0 AS is_current,
  round_even((24 + CASE WHEN k % 4 <> 0 THEN greatest(0, (2020 * 12 + 5) - (a * 12 + 1)) ELSE greatest(0, (b - a) * 12 + 2) END) / 12.0, 1)::DOUBLE AS worked FROM r
UNION ALL SELECT k, 1, 'Helper', 'Helper', '2001-01', '2003-01', 'Odd Jobs', false, round_even((24 + CASE WHEN k % 4 <> 0 THEN greatest(0, (2020 * 12 + 5) - (a * 12 + 1)) ELSE greatest(0, (b - a) * 12 + 2) END) / 12.0, 1)::DOUBLE FROM r""")
def resume_roles(spark, sf_dir):
    """Roles in both orders and with the dates first, and the years worked up to June 2020."""
    out = score.settled(written_resumes(spark, sf_dir).select("c_custkey", extract.sections(F.col("text"), "experience")["experience"].alias("roles")))
    worked = extract.worked_years(F.col("roles"), F.make_date(F.lit(2020), F.lit(6), F.lit(1)))
    each = out.select("c_custkey", worked.alias("worked"), F.posexplode("roles").alias("pos", "r"))
    return each.select("c_custkey", "pos", "r.title", "r.company", normalize.year_month(F.col("r.start")).alias("start"), normalize.end_year_month(F.col("r.end")).alias("finish"), "r.summary", "r.is_current", "worked")


@query("""SELECT c_custkey, 'School ' || c_custkey AS institution, 'Master of Arts' AS degree, CASE WHEN c_custkey % 2 = 0 THEN 'History' ELSE 'no degree here' END AS field, 2009 AS end_year FROM customer""")
def resume_studies(spark, sf_dir):
    """E8, E11."""
    return score.settled(written_resumes(spark, sf_dir).select("c_custkey", extract.sections(F.col("text"), "education")["education"].alias("s"))).select("c_custkey", F.explode("s").alias("e")).select("c_custkey", "e.institution", "e.degree", "e.field", "e.end_year")


# --- tables and scalars -----------------------------------------------------------------------------------------


def perturbed(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    some = lambda m, c: F.when(k % m != 0, c)
    return read(spark, sf_dir, "customer").select(
        k.alias("row_number"), some(2, F.col("c_name")).alias(" Full  Name "), some(3, F.concat(F.lit(" U"), k.cast("string"), F.lit("@X.com "))).alias("E-MAIL"),
        some(5, F.lit("  ")).alias("employer"), some(30, F.col("c_mktsegment")).alias("Skill"), F.lit("9").alias("Experience Months"), F.lit("z").alias("unknown header"),
    )


@query("""WITH p AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 <> 0 THEN c_name END AS name, CASE WHEN c_custkey % 3 <> 0 THEN 'U' || c_custkey || '@X.com' END AS email,
  CASE WHEN c_custkey % 30 <> 0 THEN c_mktsegment END AS skills FROM customer)
SELECT k AS row_number, name, email, skills, CASE WHEN email IS NOT NULL THEN 'csv_' || lower(email) ELSE 'csv_row_' || k END AS source_id, email IS NULL AS warned FROM p WHERE coalesce(name, email, skills) IS NOT NULL""")
def table_rows(spark, sf_dir):
    """Headers by alias, cells cleaned, blank rows dropped, rows identified."""
    rows = tables.identified(tables.mapped(perturbed(spark, sf_dir)))
    return rows.select("row_number", "name", "email", "skills", "source_id", (F.size("warnings") > 0).alias("warned"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 4 THEN NULL ELSE CASE o_orderkey % 5 WHEN 2 THEN strftime(o_orderdate, '%Y') || '-01' ELSE strftime(o_orderdate, '%Y-%m') END END AS start,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 2 THEN strftime(o_orderdate, '%Y') || '-01' ELSE strftime(o_orderdate, '%Y-%m') END AS finish FROM orders""")
def normalize_dates(spark, sf_dir):
    """N2, N3 over dates in five forms."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(k % 5 == 0, F.date_format(d, "MMM. yyyy")).when(k % 5 == 1, F.date_format(d, "M/yyyy")).when(k % 5 == 2, F.date_format(d, "yyyy")).when(k % 5 == 3, F.date_format(d, "yyyy-MM-dd")).otherwise("soon")
    end = F.when(k % 7 == 0, "Present (since then)").otherwise(raw)
    return read(spark, sf_dir, "orders").select("o_orderkey", normalize.year_month(raw).alias("start"), normalize.end_year_month(end).alias("finish"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, (year(l_shipdate) * 12 + month(l_shipdate)) - (year(o_orderdate) * 12 + month(o_orderdate)) AS gap FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(gap) FILTER (gap > 0) AS BIGINT) AS months FROM m GROUP BY l_orderkey""")
def month_gaps(spark, sf_dir):
    """E13 as a distributed sum: positive gaps of whole months."""
    index = lambda c: normalize.months_index(normalize.year_month(F.date_format(c, "yyyy-MM")))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    gap = index("l_shipdate") - index("o_orderdate")
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.when(gap > 0, gap)).cast("long").alias("months"))


@query("""SELECT n_nationkey, CASE lower(trim(n_name)) WHEN 'united states' THEN 'US' WHEN 'united kingdom' THEN 'GB' WHEN 'india' THEN 'IN' WHEN 'canada' THEN 'CA' WHEN 'australia' THEN 'AU' WHEN 'germany' THEN 'DE'
  WHEN 'france' THEN 'FR' WHEN 'japan' THEN 'JP' WHEN 'china' THEN 'CN' WHEN 'singapore' THEN 'SG' END AS code FROM nation""")
def country_codes(spark, sf_dir):
    """N4."""
    return read(spark, sf_dir, "nation").select("n_nationkey", normalize.country(F.col("n_name")).alias("code"))


LCS_SQL = """CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE list_last(list_reduce(list_transform(string_split({a}, ''), lambda ch: [unicode(ch)]), lambda prev, ch:
  list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda cur, j: list_append(cur, CASE WHEN unicode({b}[j[1]]) = ch[1] THEN prev[j[1]] + 1 ELSE greatest(prev[j[1] + 1], cur[j[1]]) END), [0::BIGINT]),
  list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT))) END"""
PART_TOKENS = """(SELECT DISTINCT unnest(list_append(string_split(p_name, ' '), ['ReactJs', 'k8s', 'Javascrip', 'pythn', 'Rubi', ' SPARK '][1 + CAST(p_partkey % 6 AS INTEGER)])) AS token FROM part)"""
ALIAS_SQL = """(VALUES ('react', 'React'), ('reactjs', 'React'), ('react.js', 'React'), ('react js', 'React'), ('node.js', 'Node.js'), ('node', 'Node.js'), ('nodejs', 'Node.js'), ('node js', 'Node.js'),
  ('python', 'Python'), ('py', 'Python'), ('javascript', 'JavaScript'), ('js', 'JavaScript'), ('typescript', 'TypeScript'), ('ts', 'TypeScript'), ('go', 'Go'), ('golang', 'Go'), ('aws', 'AWS'), ('amazon web services', 'AWS'),
  ('postgresql', 'PostgreSQL'), ('postgres', 'PostgreSQL'), ('mongodb', 'MongoDB'), ('mongo', 'MongoDB'), ('kubernetes', 'Kubernetes'), ('k8s', 'Kubernetes'), ('machine learning', 'Machine Learning'), ('ml', 'Machine Learning'),
  ('deep learning', 'Deep Learning'), ('dl', 'Deep Learning'), ('ruby on rails', 'Ruby on Rails'), ('rails', 'Ruby on Rails'), ('apache spark', 'Apache Spark'), ('spark', 'Apache Spark'), ('java', 'Java'), ('sql', 'SQL'),
  ('docker', 'Docker'), ('tensorflow', 'TensorFlow'), ('pytorch', 'PyTorch'), ('html', 'HTML'), ('css', 'CSS'), ('c++', 'C++'), ('c#', 'C#'), ('ruby', 'Ruby'), ('swift', 'Swift'), ('kotlin', 'Kotlin'), ('rust', 'Rust'),
  ('scala', 'Scala'), ('hadoop', 'Hadoop'), ('git', 'Git'), ('linux', 'Linux'), ('agile', 'Agile'), ('scrum', 'Scrum'))"""
NAMES_SQL = """(SELECT n, row_number() OVER (ORDER BY n) - 1 FROM (SELECT unnest(['AWS', 'Agile', 'Apache Spark', 'C#', 'C++', 'CSS', 'Deep Learning', 'Docker', 'Git', 'Go', 'HTML', 'Hadoop', 'Java', 'JavaScript', 'Kotlin', 'Kubernetes',
  'Linux', 'Machine Learning', 'MongoDB', 'Node.js', 'PostgreSQL', 'PyTorch', 'Python', 'React', 'Ruby', 'Ruby on Rails', 'Rust', 'SQL', 'Scala', 'Scrum', 'Swift', 'TensorFlow', 'TypeScript']) AS n))"""


@query(f"""WITH t AS (SELECT token, lower(trim(token)) AS x FROM {PART_TOKENS}),
s AS (SELECT token, x, n, i, CASE WHEN x = lower(n) THEN 100.0 ELSE 200.0::DOUBLE * ({LCS_SQL.format(a="x", b="lower(n)")}) / (length(x) + length(n)) END AS score FROM t CROSS JOIN {NAMES_SQL} v(n, i)),
b AS (SELECT token, x, n, score, row_number() OVER (PARTITION BY token ORDER BY score DESC, i) AS r FROM s),
j AS (SELECT b.*, a.name AS known FROM b LEFT JOIN {ALIAS_SQL} a(v, name) ON b.x = a.v WHERE r = 1)
SELECT token, CASE WHEN known IS NOT NULL THEN known WHEN score >= 85 THEN n ELSE trim(token) END AS name,
  CASE WHEN known IS NOT NULL THEN 'alias_dictionary' WHEN score >= 85 THEN 'fuzzy_match_normalization' ELSE 'kept_original_below_threshold' END AS method,
  CASE WHEN known IS NOT NULL THEN 95 WHEN score >= 85 THEN CAST(round_even(score, 0) AS INTEGER) ELSE 60 END AS confidence_pct,
  CASE WHEN known IS NULL AND score < 85 THEN n END AS best_match FROM j""")
def canonical_skills(spark, sf_dir):
    """Skills of distinct tokens, by spelling or by the closest name."""
    extra = F.element_at(F.array(*map(F.lit, ["ReactJs", "k8s", "Javascrip", "pythn", "Rubi", " SPARK "])), (F.col("p_partkey") % 6 + 1).cast("int"))
    tokens = read(spark, sf_dir, "part").select(F.explode(F.array_append(F.split("p_name", " "), extra)).alias("token"))
    found = normalize.skill_dictionary(tokens, "token")
    return found.select("token", "skill.name", "skill.method", F.round(F.col("skill.confidence") * 100).cast("int").alias("confidence_pct"), "skill.best_match")


@query(f"""SELECT a.n_name AS a, b.n_name AS b, CAST(({LCS_SQL.format(a="a.n_name", b="b.n_name")}) AS INTEGER) AS common,
  round(CASE WHEN a.n_name = b.n_name THEN 100.0 ELSE 200.0::DOUBLE * ({LCS_SQL.format(a="a.n_name", b="b.n_name")}) / (length(a.n_name) + length(b.n_name)) END, 6) AS ratio
FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey""")
def name_ratios(spark, sf_dir):
    """N6 over pairs of nations of a region."""
    n = read(spark, sf_dir, "nation").select("n_name", "n_regionkey")
    both = n.select(F.col("n_name").alias("a"), "n_regionkey").join(n.select(F.col("n_name").alias("b"), "n_regionkey"), "n_regionkey")
    return both.select("a", "b", similarity.lcs_length(F.col("a"), F.col("b")).alias("common"), F.round(similarity.indel_ratio(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("""SELECT s_suppkey, 100.0::DOUBLE AS whole, round(600.0::DOUBLE / 7, 6) AS edge, 0.0::DOUBLE AS none FROM supplier WHERE length(s_name) > 4""")
def partial_ratios(spark, sf_dir):
    """A name within a longer text; one of which a window at the edge is best; one with no letter in common."""
    a = F.lower("s_name")
    n = read(spark, sf_dir, "supplier").filter(F.char_length("s_name") > 4)
    edge = similarity.partial_ratio(F.concat(F.substring(a, 1, 3), F.lit("~")), a)
    return n.select("s_suppkey", similarity.partial_ratio(a, F.concat(F.lit("cv of "), a, F.lit(" 2020"))).alias("whole"), F.round(edge, 6).alias("edge"), similarity.partial_ratio(F.lit("~~"), a).alias("none"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 40 > 0 THEN round_even((c_custkey % 40) / 12.0, 1)::DOUBLE WHEN c_custkey % 4 <> 0 THEN (c_custkey % 9)::DOUBLE + 0.5 END AS years,
  CASE WHEN c_custkey % 3 = 0 AND c_custkey % 40 > 0 THEN 'direct_field_csv_months' WHEN c_custkey % 4 <> 0 THEN 'direct_field_csv' END AS method FROM customer""")
def csv_years(spark, sf_dir):
    """N10."""
    k = F.col("c_custkey")
    months = F.when(k % 3 == 0, F.concat((k % 40).cast("string"), F.lit(" months")))
    years = F.when(k % 4 != 0, F.concat(F.lit("~"), (k % 9).cast("string"), F.lit(".5 yrs"))).otherwise("n/a")
    out = read(spark, sf_dir, "customer").select("c_custkey", normalize.csv_years(months, years).alias("y"))
    return out.select("c_custkey", F.col("y.value").alias("years"), F.col("y.method").alias("method"))


@query("""SELECT p_partkey, p_name AS institution, CASE WHEN p_partkey % 3 < 2 THEN p_type END AS degree, CASE WHEN p_partkey % 2 = 0 THEN 1950 + p_size END AS end_year FROM part""")
def csv_education(spark, sf_dir):
    """N9."""
    k = F.col("p_partkey")
    year = F.when(k % 2 == 0, F.concat(F.lit(", "), (F.col("p_size") + 1950).cast("string"))).otherwise("")
    raw = F.concat("p_name", F.when(k % 3 == 0, F.concat(F.lit(" - "), "p_type")).when(k % 3 == 1, F.concat(F.lit(", "), "p_type")).otherwise(""), year)
    out = read(spark, sf_dir, "part").select("p_partkey", F.explode(records.csv_education(raw)).alias("e"))
    return out.select("p_partkey", "e.institution", "e.degree", "e.end_year")


# --- resolution ---------------------------------------------------------------------------------------------------

A_SQL = """a AS (SELECT c_custkey AS k, 'user' || c_custkey || '@x.com' AS email, CAST(c_custkey * 7919 AS VARCHAR) AS phone, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'cand_' || c_custkey || '.txt' END AS file FROM customer),
b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'other' || c_custkey || '@x.com' ELSE 'user' || c_custkey || '@x.com' END AS email, CASE WHEN c_custkey % 7 = 0 OR c_custkey % 6 = 0 THEN '00' || c_custkey ELSE CAST(c_custkey * 7919 AS VARCHAR) END AS phone,
  CASE WHEN c_custkey % 15 = 0 THEN 'Nobody Else' ELSE c_name || 'x' END AS name, 'cand_' || c_custkey || '.txt' AS file FROM customer WHERE c_custkey % 4 <> 1)"""
LINK_SQL = f"""WITH {A_SQL}, j AS (SELECT a.k, b.k AS bk, a.email = b.email AND a.phone = b.phone AS exact, a.file = b.file AND (a.email = b.email OR a.phone = b.phone OR (b.k % 15 <> 0)) AS listed FROM a LEFT JOIN b ON a.k = b.k),
g AS (SELECT k, bk, coalesce(exact, false) AS exact, coalesce(listed, false) AS listed FROM j)"""


def two_views(spark, sf_dir) -> DataFrame:
    """Records of customers as table rows and, perturbed, as resumes."""
    k = F.col("c_custkey")
    own = F.concat(F.lit("user"), k.cast("string"), F.lit("@x.com"))
    c = read(spark, sf_dir, "customer")
    place = lambda late, row, second, path: F.struct(F.lit(late).alias("late"), row.alias("row_number"), F.lit(second).alias("second"), path.alias("path")).cast(records.PLACE)
    file = F.concat(F.lit("cand_"), k.cast("string"), F.lit(".txt"))
    phone = (k * 7919).cast("string")
    a = c.select(place(0, k, 1, F.lit(None).cast("string")).alias("place"), F.lit("recruiter_csv").alias("source_type"), F.concat(F.lit("csv_"), k.cast("string")).alias("source_id"), own.alias("email"), phone.alias("phone"), F.col("c_name").alias("name"), F.when(k % 3 == 0, file).alias("file"), k.alias("k"))
    email = F.when(k % 5 == 0, F.concat(F.lit("other"), k.cast("string"), F.lit("@x.com"))).otherwise(own)
    other = F.when((k % 7 == 0) | (k % 6 == 0), F.concat(F.lit("00"), k.cast("string"))).otherwise(phone)
    name = F.when(k % 15 == 0, "Nobody Else").otherwise(F.concat("c_name", F.lit("x")))
    b = c.filter(k % 4 != 1).select(place(1, F.lit(None).cast("long"), 0, file).alias("place"), F.lit("resume").alias("source_type"), F.concat(F.lit("resume_"), k.cast("string")).alias("source_id"), email.alias("email"), other.alias("phone"), name.alias("name"), file.alias("file"), k.alias("k"))
    return a.unionByName(b).withColumn("record_id", F.to_json("place"))


@query(f"""{LINK_SQL}
SELECT CASE WHEN exact THEN 'exact_email_and_phone' WHEN listed THEN 'manifest_resume_link' ELSE 'singleton' END AS match_method, k, CAST(CASE WHEN exact OR listed THEN 2 ELSE 1 END AS BIGINT) AS n, bk IS NULL OR exact OR listed AS whole FROM g WHERE exact OR listed
UNION ALL SELECT 'singleton', k, CASE WHEN bk IS NULL THEN 1 ELSE 2 END, bk IS NULL FROM g WHERE NOT exact AND NOT listed""")
def entity_groups(spark, sf_dir):
    """Exact and listed groups and singletons, counted for each customer."""
    found = resolve.resolve(two_views(spark, sf_dir))
    per = found.groupBy("match_method", "k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group_id").alias("groups"))
    return per.select("match_method", "k", "n", (F.col("groups") == 1).alias("whole"))


def rows_and_resumes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Table rows that list files, and resumes: some files are missing, some resumes name nobody, some are not listed."""
    k, ks = F.col("c_custkey"), F.col("c_custkey").cast("string")
    file, none = F.concat(F.lit("cand_"), ks, F.lit(".txt")), F.lit(None).cast("string")
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    c, base = F.struct, read(spark, sf_dir, "customer")
    csv = c(k.alias("row_number"), F.col("c_name").alias("name"), F.concat(F.lit("user"), ks, F.lit("@x.com")).alias("email"), none.alias("phone"), none.alias("phone_method"), F.col("c_mktsegment").alias("company"), none.alias("title"), none.alias("description"),
            F.lit(None).cast("double").alias("years"), none.alias("years_method"), empty(normalize.SKILL_TYPE).alias("skills"), empty(extract.STUDY).alias("education"), F.when(k % 3 == 0, file).alias("file"), none.alias("unreadable"), none.alias("missing")).cast(records.CSV)
    named = k % 10 != 0
    resume = c(F.when(named, F.col("c_name")).alias("full_name"), F.when(named & (k % 2 == 0), F.array(F.concat(F.lit(" Mail"), ks, F.lit("@Y.org")))).otherwise(F.array()).cast("array<string>").alias("emails"), empty("string").alias("phones"), empty("struct<value:string,method:string>").alias("phones_raw"),
               none.alias("headline"), F.lit(None).cast("struct<city:string,region:string,country:string>").alias("location"), F.lit(None).cast("struct<linkedin:string,github:string,portfolio:string,other:array<string>>").alias("links"), F.lit(None).cast("double").alias("years"), none.alias("years_method"),
               empty(normalize.SKILL_TYPE).alias("skills"), empty(extract.ROLE).alias("experience"), empty(extract.STUDY).alias("education"), file.alias("filename")).cast(records.RESUME)
    table = base.select(F.concat(F.lit("csv_"), ks).alias("source_id"), csv.alias("csv"))
    resumes = base.filter(k % 4 != 1).select(F.concat(F.lit("resume_"), ks).alias("source_id"), F.concat(F.lit("/in/"), file).alias("file_path"), file.alias("filename"), resume.alias("resume"))
    return table, resumes


@query("""WITH r AS (SELECT c_custkey AS k, c_custkey % 3 = 0 AS listed, c_custkey % 4 <> 1 AS there, c_custkey % 10 <> 0 AND length(trim(c_name)) BETWEEN 2 AND 60 AND len(regexp_extract_all(c_name, '\\p{L}')) >= 2 AND len(regexp_extract_all(trim(c_name), '[\\p{L}\\s.\\-'']')) >= length(trim(c_name)) * 0.85 OR c_custkey % 10 <> 0 AND c_custkey % 2 = 0 AS usable FROM customer)
SELECT k, 0 AS late, 1 AS second, 'recruiter_csv' AS source_type, 'user' || k || '@x.com' AS email, CASE WHEN listed AND NOT there THEN 'cand_' || k || '.txt' END AS missing, CASE WHEN listed AND there AND NOT usable THEN 'cand_' || k || '.txt' END AS unreadable FROM r
UNION ALL SELECT k, CASE WHEN listed THEN 0 ELSE 1 END, 0, 'resume', CASE WHEN k % 2 = 0 THEN 'mail' || k || '@y.org' END, NULL, NULL FROM r WHERE there AND usable""")
def assembled_records(spark, sf_dir):
    """Rows with their listed resumes before them, what is missing or unreadable, and resumes that no row lists."""
    out = records.assembled(*rows_and_resumes(spark, sf_dir))
    k = F.coalesce(F.col("csv.row_number"), F.regexp_extract("file", "_([0-9]+)", 1).cast("long"))
    return out.select(k.alias("k"), "place.late", "place.second", "source_type", "email", "csv.missing", "csv.unreadable")


def noticed_views(spark, sf_dir) -> DataFrame:
    """Merged customers, of whose single rows some list a resume that stands alone, one that is gone or one that is unreadable."""
    from dovetail.operators import notices

    k = F.col("group_order")
    lists = k % 8 == 6
    file = F.when(k % 3 == 0, F.concat((k + 1).cast("string"), F.lit(".txt"))).when(k % 3 == 1, F.concat(F.lit("gone"), k.cast("string"))).otherwise(F.lit("bad.txt"))
    meta = F.col("meta").withField("manifest_resume", F.when(lists, file)).withField("manifest_resume_missing", F.when(lists & (k % 3 == 1), file)).withField("manifest_resume_unreadable", F.when(lists & (k % 3 == 2), file))
    return notices.noticed(merge.merged(customer_views(spark, sf_dir)).withColumn("meta", meta))


@query("""WITH v AS (SELECT c_custkey AS k, c_custkey % 8 AS m, CASE WHEN c_custkey % 8 = 7 THEN 'resume' WHEN c_custkey % 8 = 6 THEN 'csv' ELSE 'merged' END AS kind FROM customer),
f AS (SELECT *, CASE WHEN kind = 'csv' THEN CASE k % 3 WHEN 0 THEN 'listed' WHEN 1 THEN 'gone' ELSE 'bad' END WHEN kind = 'resume' AND (k - 1) % 3 = 0 AND k > 1 THEN 'listed' END AS state FROM v)
SELECT k AS c_custkey, CASE WHEN kind = 'csv' AND state = 'bad' THEN 'CSV lists resume file ''bad.txt'' for this row, but that file was empty, corrupted, or had no readable identity fields. This card shows CSV data only.'
  WHEN kind = 'csv' AND state = 'gone' THEN 'CSV lists resume file ''gone' || k || chr(39) || ' for this row, but that file was not found or could not be read. This card shows CSV data only.'
  WHEN kind = 'csv' THEN 'CSV and resume do not match: a resume file was listed for this CSV row in the manifest, but identity validation failed (email, phone, name, or filename), so this card shows CSV data only. The resume is shown as a separate profile.'
  WHEN state = 'listed' THEN 'CSV and resume do not match: this resume was listed in the CSV manifest for another candidate, but identity validation failed. This card shows resume data only.'
  WHEN kind = 'resume' THEN 'Resume-only profile: no matching CSV row was merged into this card. All fields below are from the resume file.' END AS source_notice,
  nullif(concat_ws(' ', CASE WHEN kind = 'csv' THEN 'No candidate name on CSV (CSV row ' || k || '). Other CSV fields may still appear below.' WHEN kind = 'resume' THEN 'Resume ' || chr(39) || k || '.txt' || chr(39) || ' had no readable name, email, or phone — likely empty, corrupted, or not a real resume.'
    ELSE 'Name could not be resolved from CSV or resume.' END,
  CASE WHEN kind = 'csv' AND state = 'bad' THEN 'Linked resume ''bad.txt'' was empty or corrupted — not merged into this card.' END), '') AS data_quality_notice FROM f""")
def profile_notices(spark, sf_dir):
    """A1, A2, A3: notices of single profiles, of listed files that failed, and of names that aren't a person's (no customer's is)."""
    return noticed_views(spark, sf_dir).select(F.col("group_order").alias("c_custkey"), "source_notice", "meta.data_quality_notice")


# --- merging ------------------------------------------------------------------------------------------------------


def customer_views(spark, sf_dir) -> DataFrame:
    """Groups as merging sees them: arrays c and r of what customers have in two views."""
    k = F.col("c_custkey")
    ks = k.cast("string")
    skill = lambda n, m: F.struct(n.alias("name"), F.lit(0.95).alias("confidence"), F.lit(m).alias("method"), F.lit(None).cast("string").alias("best_match"), F.lit(None).cast("double").alias("best_score"))
    study = lambda i, d, y: F.struct(i.alias("institution"), d.alias("degree"), F.lit(None).cast("string").alias("field"), y.alias("end_year"))
    none = F.lit(None).cast("string")
    c = F.struct(
        k.alias("row_number"), F.when(k % 10 != 0, F.upper("c_name")).alias("name"), F.concat(F.lit("User"), ks, F.lit("@x.com")).alias("email"), F.when(k % 2 == 0, F.concat(F.lit("+1415555"), ks)).otherwise(F.concat(F.lit("0"), ks)).alias("phone"),
        F.when(k % 2 != 0, F.lit("unnormalized_no_country_code")).alias("phone_method"), F.col("c_mktsegment").alias("company"), F.lit("Engineer").alias("title"), none.alias("description"), F.when(k % 6 != 0, (k % 12).cast("double")).alias("years"), F.lit("direct_field_csv").alias("years_method"),
        F.array(skill(F.lit("SQL"), "alias_dictionary"), skill(F.col("c_mktsegment"), "kept_original_below_threshold")).alias("skills"), F.array(study(F.lit("MIT"), none, F.when(k % 2 == 0, 2001).cast("int"))).alias("education"), none.alias("file"), none.alias("unreadable"), none.alias("missing"),
    )
    r = F.struct(
        F.when(k % 4 == 0, F.col("c_name")).when(k % 4 == 1, F.concat("c_name", F.lit(" Jr"))).alias("full_name"), F.array(F.concat(F.lit("user"), ks, F.lit("@x.com")), F.concat(F.lit("alt"), ks, F.lit("@y.org"))).alias("emails"), F.array(F.concat(F.lit("+1415555"), ks)).alias("phones"),
        F.array(F.struct(F.concat(F.lit("77"), ks).alias("value"), F.lit("unnormalized_invalid").alias("method"))).alias("phones_raw"), F.lit("Doer of things").alias("headline"), F.struct(F.lit("Pune").alias("city"), none.alias("region"), none.alias("country")).alias("location"),
        F.struct(none.alias("linkedin"), F.when(k % 3 == 0, F.concat(F.lit("https://github.com/u"), ks)).alias("github"), none.alias("portfolio"), F.array().cast("array<string>").alias("other")).alias("links"), F.when(k % 5 != 0, (k % 11).cast("double") + 0.5).alias("years"), F.lit("calculated_from_date_range").alias("years_method"),
        F.array(skill(F.lit("sql"), "alias_dictionary"), skill(F.lit("Rust"), "fuzzy_match_normalization")).alias("skills"),
        F.array(F.struct(F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(F.lit("Elsewhere Ltd")).alias("company"), F.lit("Engineer").alias("title"), F.lit("2015-01").alias("start"), F.lit("2016-01").alias("end"), none.alias("summary"), F.lit(False).alias("is_current"))).alias("experience"),
        F.array(study(F.lit("mit "), F.lit("BSc"), F.lit(1999)), study(F.concat(F.lit("School "), ks), none, F.lit(None).cast("int"))).alias("education"), F.concat(ks, F.lit(".txt")).alias("filename"),
    )
    arrays = spread(read(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", F.when(k % 8 != 7, F.array(c)).otherwise(F.array()).cast(f"array<{records.CSV}>").alias("c"), F.when(k % 8 != 6, F.array(r)).otherwise(F.array()).cast(f"array<{records.RESUME}>").alias("r"))
    both = (F.size("c") > 0) & (F.size("r") > 0)
    return arrays.select("c_custkey", F.col("c_custkey").cast("string").alias("group_id"), F.col("c_custkey").alias("group_order"), F.when(both & (k % 3 == 0), "manifest_resume_link").when(both, "exact_email_and_phone").otherwise("singleton").alias("match_method"), F.when(both & (k % 3 == 0), 0.88).when(both, 0.97).otherwise(1.0).alias("match_confidence"), F.concat(F.lit("s"), ks).alias("first_source"), "c", "r")


V_SQL = """v AS (SELECT c_custkey AS k, c_name, c_mktsegment AS seg, c_custkey % 8 <> 7 AS hc, c_custkey % 8 <> 6 AS hr FROM customer),
y AS (SELECT *, CASE WHEN hc AND k % 6 <> 0 THEN (k % 12)::DOUBLE END AS a, CASE WHEN hr AND k % 5 <> 0 THEN (k % 11)::DOUBLE + 0.5 END AS b FROM v)"""
GAP_SQL = "abs(a - b) / greatest(a, b, 1)"


@query(f"""WITH {V_SQL}
SELECT k AS c_custkey, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN {GAP_SQL} > 0.15 THEN NULL ELSE round_even((a + b) / 2, 2) END AS years,
  CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN b IS NULL THEN 'recruiter_csv' WHEN a IS NULL THEN 'resume' ELSE 'merged' END AS source,
  CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN b IS NULL THEN 'direct_field_csv' WHEN a IS NULL THEN 'calculated_from_date_range' WHEN {GAP_SQL} > 0.15 THEN 'suppressed_disagreement' ELSE 'averaged_agreement' END AS method FROM y""")
def years_reconcile(spark, sf_dir):
    """M5."""
    value = lambda rows: F.transform(F.filter(rows, lambda x: x["years"].isNotNull()), lambda x: F.struct(x["years"].alias("value"), x["years_method"].alias("method")))
    out = customer_views(spark, sf_dir).select("c_custkey", merge.reconciled_years(value("c"), value("r")).alias("y"))
    return out.select("c_custkey", F.col("y.value").alias("years"), "y.provenance.source", "y.provenance.method")


@query(f"""WITH {V_SQL}, n AS (SELECT k, CASE WHEN hc AND k % 10 <> 0 THEN upper(c_name) END AS a, CASE WHEN hr AND k % 4 = 0 THEN c_name WHEN hr AND k % 4 = 1 THEN c_name || ' Jr' END AS b, hc, hr, seg FROM v)
SELECT k AS c_custkey, CASE WHEN lower(trim(a)) = lower(trim(b)) THEN a ELSE coalesce(b, a) END AS full_name, CASE WHEN hr OR hc THEN 'Engineer' END AS headline,
  CASE WHEN hc AND hr THEN 'merged' WHEN hc THEN 'csv_only' ELSE 'resume_only' END AS kind, sha256('user' || k || '@x.com') AS candidate_id FROM n""")
def scalar_conflict(spark, sf_dir):
    """M2-M4, M13, N14."""
    return merge.merged(customer_views(spark, sf_dir)).select(F.col("group_order").alias("c_custkey"), "full_name", "headline", F.col("source_profile_kind").alias("kind"), "candidate_id")


@query(f"""WITH {V_SQL}
SELECT k AS c_custkey, array_to_string(CASE WHEN hc AND hr THEN ['User' || k || '@x.com', 'alt' || k || '@y.org'] WHEN hc THEN ['User' || k || '@x.com'] ELSE ['user' || k || '@x.com', 'alt' || k || '@y.org'] END, ',') AS emails,
  CASE WHEN hr OR k % 2 = 0 THEN '+1415555' || k ELSE '' END AS phones,
  array_to_string(list_filter([CASE WHEN hc AND k % 2 <> 0 THEN '0' || k END, CASE WHEN hr THEN '77' || k END], lambda x: x IS NOT NULL), ',') AS phones_raw,
  array_to_string(list_filter([CASE WHEN hc AND k % 2 <> 0 THEN 'recruiter_csv:unnormalized_no_country_code' END, CASE WHEN hr THEN 'resume:unnormalized_invalid' END], lambda x: x IS NOT NULL), ',') AS details FROM v""")
def contact_union(spark, sf_dir):
    """M6-M8."""
    out = merge.merged(customer_views(spark, sf_dir))
    details = F.transform("meta.phones_raw_details", lambda d: F.concat_ws(":", d["source"], d["method"]))
    return out.select(F.col("group_order").alias("c_custkey"), F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"), F.array_join("phones_raw", ",").alias("phones_raw"), F.array_join(details, ",").alias("details"))


@query(f"""WITH {V_SQL}
SELECT k AS c_custkey, CASE WHEN hc AND hr THEN 'SQL(recruiter_csv+resume),' || seg || '(recruiter_csv),Rust(resume)' WHEN hc THEN 'SQL(recruiter_csv),' || seg || '(recruiter_csv)' ELSE 'sql(resume),Rust(resume)' END AS skills,
  CASE WHEN hc AND hr THEN 'MIT/BSc/' || CASE WHEN k % 2 = 0 THEN '2001' ELSE '1999' END || '/merged,School ' || k || '//' || '/resume' WHEN hc THEN 'MIT//' || CASE WHEN k % 2 = 0 THEN '2001' ELSE '' END || '/recruiter_csv' ELSE 'mit /BSc/1999/resume,School ' || k || '///resume' END AS education,
  CASE WHEN hc AND hr AND k % 2 = 0 THEN seg || '/Engineer/merged' WHEN hc AND hr THEN seg || '/Engineer/recruiter_csv,Elsewhere Ltd/Engineer/resume' WHEN hc THEN seg || '/Engineer/recruiter_csv' WHEN k % 2 = 0 THEN seg || '/Engineer/resume' ELSE 'Elsewhere Ltd/Engineer/resume' END AS experience FROM v""")
def history_union(spark, sf_dir):
    """M9-M11."""
    out = merge.merged(customer_views(spark, sf_dir))
    skills = F.transform("skills", lambda s: F.concat(s["name"], F.lit("("), F.array_join(s["sources"], "+"), F.lit(")")))
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    study = F.transform("education", lambda e: F.concat(e["institution"], F.lit("/"), blank(e["degree"]), F.lit("/"), blank(e["end_year"]), F.lit("/"), e["source"]))
    work = F.transform("experience", lambda e: F.concat(e["company"], F.lit("/"), e["title"], F.lit("/"), e["source"]))
    return out.select(F.col("group_order").alias("c_custkey"), F.array_join(skills, ",").alias("skills"), F.array_join(study, ",").alias("education"), F.array_join(work, ",").alias("experience"))


SCORE_SQL = f"""WITH {V_SQL}, s AS (SELECT k, hc, hr, a, b, hc AND hr AND k % 3 = 0 AS capped, NOT (hc AND hr) AS single,
  (hc AND k % 10 <> 0) OR (hr AND k % 4 < 2) AS named, CASE WHEN hc THEN 0.9 ELSE 0.75 END AS own, a IS NOT NULL AND b IS NOT NULL AND {GAP_SQL} > 0.15 AS gone FROM y),
f AS (SELECT k, capped, single, unnest([{{'f': 'full_name', 's': CASE WHEN named THEN own END}}, {{'f': 'emails', 's': own}}, {{'f': 'phones', 's': CASE WHEN hr OR k % 2 = 0 THEN 0.95 END}}, {{'f': 'phones_raw', 's': CASE WHEN hr OR k % 2 <> 0 THEN 0.30 END}},
  {{'f': 'headline', 's': own}}, {{'f': 'location', 's': CASE WHEN hr THEN 0.65 END}}, {{'f': 'years_experience', 's': CASE WHEN gone THEN 0.0 WHEN a IS NOT NULL THEN 0.9 WHEN b IS NOT NULL THEN 0.70 END}},
  {{'f': 'skills', 's': CASE WHEN hc AND hr THEN 0.70 ELSE 0.80 END}}, {{'f': 'experience', 's': 0.75}}, {{'f': 'education', 's': 0.72}}, {{'f': 'links', 's': CASE WHEN hr AND k % 3 = 0 THEN 0.80 END}}]) AS e FROM s),
m AS (SELECT k, e.f AS field, CAST(e.s AS DOUBLE) AS raw, CASE WHEN capped THEN least(CAST(e.s AS DOUBLE), 0.88) WHEN single THEN l.v ELSE CAST(e.s AS DOUBLE) END AS score FROM f
  LEFT JOIN (VALUES (0.0::DOUBLE, 0.0::DOUBLE), (0.3, 0.255), (0.65, 0.552), (0.7, 0.595), (0.72, 0.612), (0.75, 0.637), (0.8, 0.68), (0.9, 0.765), (0.95, 0.807)) l(x, v) ON CAST(e.s AS DOUBLE) = l.x WHERE e.s IS NOT NULL)"""


@query(f"{SCORE_SQL} SELECT k AS c_custkey, field, score FROM m")
def field_scores(spark, sf_dir):
    """Scores of all fields, capped or lowered."""
    out = score.scored(merge.merged(customer_views(spark, sf_dir)))
    return out.select(F.col("group_order").alias("c_custkey"), F.explode("field_confidence").alias("field", "score"))


@query(f"""{SCORE_SQL}, w AS (SELECT k, list(struct_pack(p := score * CASE WHEN field IN ('full_name', 'emails') THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END, w := CASE WHEN field IN ('full_name', 'emails') THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) ORDER BY field) AS l FROM m GROUP BY k)
SELECT k AS c_custkey, CAST(round_even(CAST(CAST(list_reduce(list_transform(l, lambda x: x.p), lambda s, x: s + x) / list_sum(list_transform(l, lambda x: x.w)) AS VARCHAR) AS DECIMAL(38, 20)), 3) AS DOUBLE) AS overall_confidence FROM w""")
def overall_confidence(spark, sf_dir):
    """The weighted mean, summed in the order of the fields' names and rounded half to even in decimals."""
    out = score.scored(merge.merged(customer_views(spark, sf_dir)))
    return out.select(F.col("group_order").alias("c_custkey"), "overall_confidence")


@query(f"""WITH {V_SQL}, g AS (SELECT * FROM y WHERE a IS NOT NULL AND b IS NOT NULL AND {GAP_SQL} > 0.15)
SELECT k AS c_custkey, 'CSV states ' || regexp_replace(CAST(a AS VARCHAR), '\\.0$', '') || ' years; resume''s work history calculates to approximately ' || regexp_replace(CAST(b AS VARCHAR), '\\.0$', '') || ' years — a ' || CAST(round_even({GAP_SQL} * 100, 0) AS INTEGER)
  || '% gap, which exceeds our 15% agreement threshold, so no value is being asserted for this field.' AS reasoning FROM g""")
def reasoning_text(spark, sf_dir):
    """C10."""
    out = score.scored(merge.merged(customer_views(spark, sf_dir)))
    return out.select(F.col("group_order").alias("c_custkey"), F.col("field_reasoning")["years_experience"].alias("reasoning")).filter("reasoning IS NOT NULL")


@query(f"""WITH {V_SQL}, p AS (SELECT k, unnest(list_filter([CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN 'years_experience:' || CASE WHEN b IS NULL THEN 'recruiter_csv:direct_field_csv' WHEN a IS NULL THEN 'resume:calculated_from_date_range' WHEN {GAP_SQL} > 0.15 THEN 'merged:suppressed_disagreement' ELSE 'merged:averaged_agreement' END END,
  CASE WHEN (hc AND k % 10 <> 0) OR (hr AND k % 4 < 2) THEN 'full_name:' || o END, 'emails:' || o, CASE WHEN hr OR k % 2 = 0 THEN 'phones:' || CASE WHEN NOT hc OR (hr AND k % 2 = 0) THEN 'resume' ELSE 'recruiter_csv' END || ':E164' END,
  CASE WHEN hc AND k % 2 <> 0 THEN 'phones_raw:recruiter_csv:unnormalized_no_country_code' WHEN hr THEN 'phones_raw:resume:unnormalized_invalid' END, 'headline:' || o, CASE WHEN hr THEN 'location:resume:regex_extraction' END,
  'skills:' || u, 'experience:' || u, 'education:' || CASE WHEN hc AND hr THEN 'resume:regex_extraction' ELSE u END, CASE WHEN hr AND k % 3 = 0 THEN 'links:resume:regex_extraction' END], lambda x: x IS NOT NULL)) AS entry
  FROM (SELECT *, CASE WHEN hc THEN 'recruiter_csv:direct_field_csv' ELSE 'resume:regex_extraction' END AS o, CASE WHEN hc AND hr THEN 'merged:union_csv_resume' WHEN hc THEN 'recruiter_csv:direct_field_csv' ELSE 'resume:regex_extraction' END AS u FROM y))
SELECT k AS c_custkey, entry FROM p""")
def provenance_entries(spark, sf_dir):
    """C7, C8."""
    out = score.scored(merge.merged(customer_views(spark, sf_dir)))
    return out.select(F.col("group_order").alias("c_custkey"), F.explode("provenance").alias("p")).select("c_custkey", F.concat_ws(":", "p.field", "p.source", "p.method").alias("entry"))


@query("""SELECT user_id, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN abs(a - b) / greatest(a, b, 1) > 0.15 THEN NULL ELSE CAST(a + b AS DOUBLE) / 2 END AS agreed FROM
  (SELECT user_id, CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS a, CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS b FROM events GROUP BY user_id)""")
def event_agreement(spark, sf_dir):
    """M5 over aggregates: counts of two kinds of events of each user."""
    counts = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").cast("double").alias("a"), F.count_if(F.col("event_type") == "click").cast("double").alias("b"))
    pair = lambda c: F.array(F.struct(F.col(c).alias("value"), F.lit("count").alias("method")))
    return counts.select("user_id", merge.reconciled_years(pair("a"), pair("b"))["value"].alias("agreed"))


@query(f"""WITH {V_SQL}
SELECT k AS c_custkey, CASE WHEN hr AND k % 3 = 0 THEN 'https://github.com/u' || k END AS github, CASE WHEN hr THEN 'Pune' END AS city, CASE WHEN hc AND hr AND k % 3 = 0 THEN 'manifest_resume_link' WHEN hc AND hr THEN 'exact_email_and_phone' ELSE 'singleton' END AS match_method,
  CASE WHEN hc AND hr AND k % 3 = 0 THEN 88 WHEN hc AND hr THEN 97 ELSE 100 END AS match_pct, concat_ws('+', CASE WHEN hc THEN 'recruiter_csv' END, CASE WHEN hr THEN 'resume' END) AS sources, CASE WHEN hr THEN k || '.txt' END AS resume_filename, CASE WHEN hc THEN k END AS csv_row_number FROM v""")
def links_and_meta(spark, sf_dir):
    """M1, M12, M14."""
    out = merge.merged(customer_views(spark, sf_dir))
    return out.select(F.col("group_order").alias("c_custkey"), "links.github", "location.city", "meta.match_method", F.round(F.col("meta.match_confidence") * 100).cast("int").alias("match_pct"), F.array_join("meta.group_sources", "+").alias("sources"), "meta.resume_filename", "meta.csv_row_number")


@query(f"""WITH {V_SQL}
SELECT k AS c_custkey, 'SQL(recruiter_csv),' || seg || '(recruiter_csv+resume),Rust(resume)' AS skills, 'MIT/BSc/2001/merged,Old School///recruiter_csv,School ' || k || '///resume' AS education,
  seg || '/Chief/recruiter_csv,Late Ltd/Lead/resume,elsewhere ltd./Engineers/merged' AS experience, 'first@x.com,second@x.com,user' || k || '@x.com' AS emails, k + 0.5::DOUBLE AS years FROM v WHERE k > 9""")
def larger_groups(spark, sf_dir):
    """M2-M11 over groups of two rows and two resumes: firsts win, unions keep their order, a fold takes over what agrees."""
    k, ks = F.col("c_custkey"), F.col("c_custkey").cast("string")
    none = F.lit(None).cast("string")
    skill = lambda n: F.struct(n.alias("name"), F.lit(0.95).alias("confidence"), F.lit("alias_dictionary").alias("method"), none.alias("best_match"), F.lit(None).cast("double").alias("best_score"))
    study = lambda i, d=none, y=F.lit(None).cast("int"): F.struct(i.alias("institution"), d.alias("degree"), none.alias("field"), y.alias("end_year"))
    role = lambda c, t, y: F.struct(F.lit(c).alias("company"), F.lit(t).alias("title"), F.lit(y).alias("start"), none.alias("end"), none.alias("summary"), F.lit(False).alias("is_current"))

    def row(email, company, title, skills, studies):
        return F.struct(k.alias("row_number"), none.alias("name"), email.alias("email"), none.alias("phone"), none.alias("phone_method"), company.alias("company"), F.lit(title).alias("title"), none.alias("description"), k.cast("double").alias("years"), F.lit("direct_field_csv").alias("years_method"), F.array(*skills).alias("skills"), F.array(*studies).alias("education"), none.alias("file"), none.alias("unreadable"), none.alias("missing")).cast(records.CSV)

    def resume(skills, roles, studies):
        empty = lambda kind: F.array().cast(f"array<{kind}>")
        return F.struct(none.alias("full_name"), F.array(F.concat(F.lit("user"), ks, F.lit("@x.com"))).alias("emails"), empty("string").alias("phones"), empty("struct<value:string,method:string>").alias("phones_raw"), none.alias("headline"), F.lit(None).cast("struct<city:string,region:string,country:string>").alias("location"), F.lit(None).cast("struct<linkedin:string,github:string,portfolio:string,other:array<string>>").alias("links"),
                        (k + 1).cast("double").alias("years"), F.lit("calculated_from_date_range").alias("years_method"), F.array(*skills).alias("skills"), F.array(*roles).alias("experience"), F.array(*studies).alias("education"), none.alias("filename")).cast(records.RESUME)

    seg = F.col("c_mktsegment")
    c = F.array(row(F.lit("first@x.com"), F.lit("elsewhere ltd."), "Engineers", [skill(F.lit("SQL")), skill(seg)], [study(F.lit("MIT"), y=F.lit(2001))]), row(F.lit("second@x.com"), seg, "Chief", [skill(F.lit("sql"))], [study(F.lit("mit"), F.lit("ignored")), study(F.lit("Old School"))]))
    r = F.array(resume([skill(F.lower(seg))], [role("Late Ltd", "Lead", "2020-01"), role("late ltd ", "LEAD", "2020-01")], [study(F.lit("Mit "), F.lit("BSc"), F.lit(1999))]), resume([skill(F.lit("Rust"))], [role("Elsewhere Ltd", "Engineer", "2015-01")], [study(F.concat(F.lit("School "), ks))]))
    groups = spread(read(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", ks.alias("group_id"), k.alias("group_order"), F.lit("exact_email_and_phone").alias("match_method"), F.lit(0.97).alias("match_confidence"), F.lit("s").alias("first_source"), c.alias("c"), r.alias("r"))
    out = merge.merged(groups.filter("c_custkey > 9"))
    blank = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    skills = F.transform("skills", lambda s: F.concat(s["name"], F.lit("("), F.array_join(s["sources"], "+"), F.lit(")")))
    studies = F.transform("education", lambda e: F.concat(e["institution"], F.lit("/"), blank(e["degree"]), F.lit("/"), blank(e["end_year"]), F.lit("/"), e["source"]))
    work = F.transform("experience", lambda e: F.concat(e["company"], F.lit("/"), e["title"], F.lit("/"), e["source"]))
    return out.select(F.col("group_order").alias("c_custkey"), F.array_join(skills, ",").alias("skills"), F.array_join(studies, ",").alias("education"), F.array_join(work, ",").alias("experience"), F.array_join("emails", ",").alias("emails"), F.col("years_experience").alias("years"))


# --- projection ---------------------------------------------------------------------------------------------------


def canonical_view(spark, sf_dir) -> DataFrame:
    out = score.scored(merge.merged(customer_views(spark, sf_dir)))
    return out.withColumn("source_notice", F.lit(None).cast("string"))


def configured(spark, sf_dir, config: dict) -> DataFrame:
    return projection.project(canonical_view(spark, sf_dir), projection.parse(config), ("group_order",)).withColumnRenamed("group_order", "c_custkey")


RENAMED = {"fields": [{"path": "email", "from": "emails[0]"}, {"path": "second", "from": "emails[1]"}, {"path": "names", "from": "skills[].name", "type": "string[]"}, {"path": "city", "from": "location.city"}, {"path": "none", "from": "nothing.at[3].all"}, {"path": "years", "from": "years_experience", "type": "number"}], "include_provenance": False, "include_confidence": False}


@query(f"""WITH {V_SQL}
SELECT k AS c_custkey, CASE WHEN hc THEN 'User' || k || '@x.com' ELSE 'user' || k || '@x.com' END AS email, CASE WHEN hr THEN 'alt' || k || '@y.org' END AS second,
  CASE WHEN hc AND hr THEN 'SQL,' || seg || ',Rust' WHEN hc THEN 'SQL,' || seg ELSE 'sql,Rust' END AS names, CASE WHEN hr THEN 'Pune' END AS city, CAST(NULL AS VARCHAR) AS "none",
  CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN {GAP_SQL} > 0.15 THEN NULL ELSE round_even((a + b) / 2, 2) END AS years, CAST(NULL AS VARCHAR) AS error FROM y""")
def project_rename(spark, sf_dir):
    """Paths and types."""
    return configured(spark, sf_dir, RENAMED).withColumn("names", F.array_join("names", ","))


STRICT = {"fields": [{"path": "full_name", "required": True}, {"path": "phone", "from": "phones[0]", "required": True}], "on_missing": "error", "include_provenance": False}


@query(f"""WITH {V_SQL}, n AS (SELECT k, (hc AND k % 10 <> 0) OR (hr AND k % 4 < 2) AS named, hr OR k % 2 = 0 AS phoned FROM v)
SELECT k AS c_custkey, CASE WHEN NOT named THEN 'Required field missing: full_name' WHEN NOT phoned THEN 'Required field missing: phone' END AS error FROM n""")
def project_error(spark, sf_dir):
    """Missing required fields are rows' errors."""
    return configured(spark, sf_dir, STRICT).select("c_custkey", "error")


OMITTED = {"fields": [{"path": "full_name"}, {"path": "github", "from": "links.github"}, {"path": "raw", "from": "phones_raw", "type": "string[]"}], "on_missing": "omit", "include_confidence": False, "include_provenance": False}


@query(f"""WITH {V_SQL}, n AS (SELECT k, CASE WHEN hc AND k % 10 <> 0 THEN upper(c_name) END AS a, CASE WHEN hr AND k % 4 = 0 THEN c_name WHEN hr AND k % 4 = 1 THEN c_name || ' Jr' END AS b, hc, hr FROM v),
f AS (SELECT *, CASE WHEN lower(trim(a)) = lower(trim(b)) THEN a ELSE coalesce(b, a) END AS name FROM n)
SELECT k AS c_custkey, '{{' || array_to_string(list_filter([CASE WHEN name IS NOT NULL THEN '"full_name":"' || name || '"' END, CASE WHEN hr AND k % 3 = 0 THEN '"github":"https://github.com/u' || k || '"' END,
  '"raw":[' || array_to_string(list_filter([CASE WHEN hc AND k % 2 <> 0 THEN '"0' || k || '"' END, CASE WHEN hr THEN '"77' || k || '"' END], lambda x: x IS NOT NULL), ',') || ']'], lambda x: x IS NOT NULL), ',') || '}}' AS output FROM f""")
def project_omit(spark, sf_dir):
    """Documents without what is missing."""
    out = projection.project_json(canonical_view(spark, sf_dir), projection.parse(OMITTED), ("group_order",))
    return out.select(F.col("group_order").alias("c_custkey"), "output")


NORMALIZED = {"fields": [{"path": "phone", "from": "phones_raw[0]", "normalize": "E164"}, {"path": "skills", "from": "skills[].name", "type": "string[]", "normalize": "canonical"}, {"path": "mail", "from": "emails[0]"}], "include_provenance": False}


@query(f"""{SCORE_SQL} SELECT v.k AS c_custkey, CASE WHEN hc AND v.k % 2 <> 0 THEN '0' || v.k WHEN hr THEN '77' || v.k END AS phone, CASE WHEN hc AND hr THEN 'SQL,' || seg || ',Rust' WHEN hc THEN 'SQL,' || seg ELSE 'SQL,Rust' END AS skills,
  CASE WHEN hc THEN 'User' ELSE 'user' END || v.k || '@x.com' AS mail, p.score AS phone_confidence, s.score AS skills_confidence, e.score AS mail_confidence
FROM v LEFT JOIN m p ON p.k = v.k AND p.field = 'phones_raw' LEFT JOIN m s ON s.k = v.k AND s.field = 'skills' LEFT JOIN m e ON e.k = v.k AND e.field = 'emails'""")
def project_normalized(spark, sf_dir):
    """Normalised values, and each path's confidence by its canonical field."""
    out = configured(spark, sf_dir, NORMALIZED).withColumn("skills", F.array_join("skills", ","))
    return out.select("c_custkey", "phone", "skills", "mail", "phone_confidence", "skills_confidence", "mail_confidence")


@query(f"""WITH {V_SQL} SELECT k AS c_custkey, CASE WHEN hc THEN 'User' ELSE 'user' END || k || '@x.com' AS email FROM v""")
def reprojected(spark, sf_dir):
    """Stored profiles are projected again, without the steps before."""
    from dovetail.operators import notices
    from dovetail.plans import pipeline
    from dovetail.plans.shared import cut

    stored = notices.noticed(cut(score.scored(merge.merged(customer_views(spark, sf_dir)))))  # notices read all profiles twice
    out = pipeline.reproject(stored, {"fields": [{"path": "email", "from": "emails[0]"}], "include_confidence": False, "include_provenance": False})["output"]
    ids = stored.select("candidate_id", F.col("group_order").alias("c_custkey"))
    return out.join(ids, "candidate_id").select("c_custkey", F.get_json_object("output", "$.email").alias("email"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k_text, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_number FROM events""")
def project_json_path(spark, sf_dir):
    """P3, P5 over parsed JSON: a.b as text and as a number."""
    rows = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k string").alias("props"))
    profile = rows.withColumns({"field_confidence": F.create_map().cast("map<string,double>"), "field_reasoning": F.create_map().cast("map<string,string>"), "overall_confidence": F.lit(0.0)})
    config = projection.parse({"fields": [{"path": "k_text", "from": "props.k"}, {"path": "k_number", "from": "props.k", "type": "number"}], "include_confidence": False, "include_provenance": False})
    return projection.project(profile, config, ("event_id",)).drop("error")


@query(f"""WITH {V_SQL} SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (hc AND hr) AS BIGINT) AS merged, CAST(count(*) FILTER (hc AND NOT hr) AS BIGINT) AS csv_only, CAST(count(*) FILTER (NOT hc) AS BIGINT) AS resume_only,
  CAST(count(*) FILTER (hc AND NOT hr AND k % 3 = 0 OR NOT hc AND k % 3 = 1 AND k > 1) AS BIGINT) AS mismatched FROM v""")
def batch_summary(spark, sf_dir):
    """X6."""
    from dovetail.operators import notices

    return notices.batch_summary(noticed_views(spark, sf_dir))


def integrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All steps over two views of customers: flagship."""
    scored = canonical_view(spark, sf_dir)
    return projection.project_json(scored, projection.parse(None), ("candidate_id",))

