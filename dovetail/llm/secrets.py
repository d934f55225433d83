"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Three kinds of candidates are found in whole texts: assigned values, access keys and long hexadecimal runs.  The
hashes of all candidate values are aggregated over the corpus by distinct repositories and owners.  A value that many
owners have is a widely copied example; a value of one owner that looks live (long enough, enough different
characters, letters and digits) is a live credential and adds a `live` span over its value; the rest stays undecided.

Positions: between the matches of a pattern lie the parts that split() gives, so running sums of the parts' and the
matches' lengths, in code points, are the matches' starts.

Edge cases.  Null and empty texts have no spans (the hash is that of an empty string).  A null repository or owner
counts as one of its own kind.  Repeated rows are scanned each and don't add owners.  The same value of several kinds
is classified once.  An empty table gives no rows.  Kept columns lie in one struct, so their names can't clash.  A table
with one column of origin has it for repository and owner; then both frequencies are the same number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dovetail.llm import store

# Kinds in order, with their patterns and least lengths of the value.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: A value of so many owners or repositories is an example; a live one has so many different characters at least.
EXAMPLE_OWNERS, LIVE_OWNERS, LIVE_LENGTH, LIVE_DISTINCT = 3, 1, 12, 8
SALTS, RUN = 16, 64
SPAN = "struct<s:int,k:int,e:int,vs:int,h:bigint,live:boolean>"


def live_looking(value: Column) -> Column:
    return (F.char_length(value) >= LIVE_LENGTH) & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_DISTINCT) & value.rlike("[A-Za-z]") & value.rlike("[0-9]")


def spans_of(text: Column, kind: int) -> Column:
    """Spans (start, kind, end, value's start, value's hash, live-looking) of a kind; ends are exclusive."""
    pattern, group, least = list(KINDS.values())[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.transform(F.split(text, pattern, -1), F.char_length)
    triples = F.arrays_zip(between.alias("gap"), found.alias("whole"), values.alias("value"))
    empty = F.array().cast(f"array<{SPAN}>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + F.char_length(x["whole"])
        value = x["value"]
        span = F.struct(start.alias("s"), F.lit(kind).alias("k"), end.alias("e"), (end - F.char_length(value)).alias("vs"), F.xxhash64(value).alias("h"), live_looking(value).alias("live"))
        kept = F.when(x["whole"].isNotNull() & (F.char_length(value) >= least), F.concat(state["out"], F.array(span).cast(f"array<{SPAN}>"))).otherwise(state["out"])
        return F.struct(F.coalesce(end, start).alias("at"), kept.alias("out"))

    # runs of RUN matches, each folded from where it starts: a text with very many matches isn't copied once for each
    runs = let(triples, lambda t: F.transform(F.sequence(F.lit(0), ((F.size(t) - 1) / RUN).cast("int")), lambda i: F.slice(t, i * RUN + 1, F.lit(RUN))))
    long = lambda run: F.aggregate(run, F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(F.char_length(x["whole"]), F.lit(0)))
    starts = lambda r: F.aggregate(r, F.array(F.lit(0)), lambda at, run: F.concat(at, F.array(F.element_at(at, -1) + long(run))))
    fold = lambda run, at: F.aggregate(run, F.struct(at.alias("at"), empty.alias("out")), step)["out"]
    folded = let(runs, lambda r: let(starts(r), lambda at: F.flatten(F.transform(r, lambda run, i: fold(run, F.get(at, i))))))
    return F.when(text.rlike(pattern), folded).otherwise(empty)


def let(value: Column, body) -> Column:
    """body(value), the value being computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def joined(spans: Column) -> Column:
    """kind:start:end of the spans by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "live")])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, text_col: str = "text", repo_col: str = "source", owner_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """row (a struct of the `keep` columns of docs, or of all), base (spans), every (with live spans) and redact (spans to
    take out: all but examples).  Without owner_col the repository is the owner.

    The scan is written once to the shared folder: corpus statistics and each row's decision read it from there."""
    own = lambda c: F.col(quoted(c))
    text = F.coalesce(own(text_col), F.lit(""))
    row = F.struct("*") if keep is None else F.struct(*[own(c) for c in keep])
    spans = docs.select(row.alias("row"), own(repo_col).alias("repo"), own(owner_col or repo_col).alias("owner"), F.monotonically_increasing_id().alias("number"), F.concat(*[spans_of(text, k) for k in range(len(KINDS))]).alias("base"))
    seen = store.materialize(spans, "secrets")
    plain = seen.filter(F.size("base") == 0).select("row", "base", F.col("base").alias("every"), F.col("base").alias("redact"))
    each = seen.filter(F.size("base") > 0).select("number", "repo", "owner", F.explode("base").alias("x")).withColumn("h", F.col("x.h"))
    owned = each.select("h", "repo", "owner").distinct()
    repos = owned.select("h", "repo").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("repos"))
    owners = owned.select("h", "owner").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("owners"))
    classes = owners.join(repos, "h").select("h", (F.greatest("owners", "repos") >= EXAMPLE_OWNERS).alias("example"), (F.col("owners") <= LIVE_OWNERS).alias("own"))
    # a widely copied value may stand in a third of all rows: its rows are dealt to SALTS tasks; classes grow with the
    # documents and are never broadcast
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    judged = each.withColumn("salt", F.pmod(F.xxhash64("number"), F.lit(SALTS)).cast("int")).join(classes.select("*", salt).hint("merge"), ["h", "salt"])
    by_row = judged.groupBy("number").agg(F.collect_list(F.struct("x", "example", "own")).alias("judged"))
    to_live = lambda y: F.struct(y["x"]["vs"].alias("s"), F.lit(len(KINDS)).alias("k"), y["x"]["e"].alias("e"), y["x"]["vs"].alias("vs"), y["x"]["h"].alias("h"), y["x"]["live"].alias("live"))
    live = F.array_distinct(F.transform(F.filter("judged", lambda y: y["own"] & y["x"]["live"]), to_live)).cast(f"array<{SPAN}>")
    redact = F.transform(F.filter("judged", lambda y: ~y["example"]), lambda y: y["x"]).cast(f"array<{SPAN}>")
    with_some = seen.filter(F.size("base") > 0).join(by_row, "number").select("row", "base", F.concat(F.col("base"), live).alias("every"), redact.alias("redact"))
    return plain.unionByName(with_some)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def redacted(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """text with each value of the spans (overlapping ones joined) replaced by the mark."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["vs"].alias("s"), x["e"].alias("e"))))

    def step(state: Column, x: Column) -> Column:
        fresh = x["s"] >= state["at"]
        piece = F.when(fresh, F.concat(state["out"], F.substring(text, state["at"] + 1, x["s"] - state["at"]), F.lit(mark))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], x["e"]).alias("at"), piece.alias("out"))

    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(store.table(spark, sf_dir, "documents"), keep=["doc_id"])
    number = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("row.doc_id", *[number(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("every")).alias("spans"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
p(k, kind, pattern, least) AS (VALUES (0, 'assign', '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 8), (1, 'access', '(AKIA[A-Z0-9]+)', 16), (2, 'hex', '([0-9a-f]{32,})', 32)),
m AS (SELECT doc_id, source, k, kind, least, regexp_extract_all(t, pattern, 0) AS w, regexp_extract_all(t, pattern, 1) AS v, string_split_regex(t, pattern) AS g FROM d JOIN p ON regexp_matches(t, pattern)),
i AS (SELECT *, unnest(range(1, len(w) + 1)) AS n FROM m),
s AS (SELECT doc_id, source, k, kind, least, v[n] AS value, CAST(length(array_to_string(g[1:n], '')) + length(array_to_string(w[1:n - 1], '')) AS BIGINT) AS s, length(w[n]) AS size FROM i),
b AS (SELECT doc_id, source, k, kind, value, s, s + size AS e FROM s WHERE length(value) >= least),
o AS (SELECT value, count(DISTINCT coalesce(source, '')) AS owners FROM b GROUP BY value),
l AS (SELECT DISTINCT doc_id, 3 AS k, 'live' AS kind, e - length(value) AS s, e FROM b JOIN o USING (value) WHERE owners <= 1 AND length(value) >= 12 AND len(list_distinct(string_split(value, ''))) >= 8 AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]')),
j AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans FROM (SELECT doc_id, k, kind, s, e FROM b UNION ALL SELECT doc_id, k, kind, s, e FROM l) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS x, count(*) FILTER (k = 2) AS h, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS base FROM b GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(x, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN j USING (doc_id)
"""
