"""Steps whose cost a row must stay small, on inputs that took minutes."""

import random
import time

from pyspark.sql import functions as F

from dovetail import queries
from dovetail.functions import similarity
from dovetail.plans import projection, shared


SF = "/root/testdata/sf0.001"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        above, row = row, [0]
        for j, o in enumerate(b):
            row.append(above[j] + 1 if ch == o else max(above[j + 1], row[j]))
    return row[-1]


def test_partial_ratios_of_longer_texts(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    pairs = [(text(40), text(120)) for _ in range(400)] + [("", None), (None, "a"), ("", ""), ("", "a")]
    began = time.time()
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.partial_ratio(F.col("a"), F.col("b")).alias("p"), similarity.lcs_length(F.col("a"), F.col("b")).alias("n")).collect()
    assert time.time() - began < 60
    assert [r["p"] for r in got[-4:]] == [0.0, None, 100.0, 0.0] and [r["n"] for r in got[-4:]] == [None, None, 0, 0]
    for r in got[:20]:
        windows = [r["b"][max(0, i) : i + 40] for i in range(-39, 120)]
        assert r["p"] == max(200.0 * lcs(r["a"], w) / (40 + len(w)) for w in windows) and r["n"] == lcs(r["a"], r["b"])


def plan(spark, frame):
    spark.conf.set("spark.sql.maxPlanStringLength", "100000000")
    try:
        return frame._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxPlanStringLength")


def tasks(frame):
    return frame.select(F.spark_partition_id()).distinct().count()


def test_roles_are_found_once_and_by_many_tasks(spark):
    out = queries.resume_roles(spark, SF)
    assert plan(spark, out).count(r"\n\s*\n") == 1  # what parts paragraphs; six times before
    assert tasks(out) > 1


def test_heads_are_found_once_and_by_many_tasks(spark):
    out = queries.resume_heads(spark, SF)
    assert plan(spark, out).count("curriculum") == plan(spark, out).count("linkedin") == 1  # in names and headlines; four times and twice before
    assert tasks(out) > 1


def test_skills_of_many_tokens_in_a_projection(spark):
    rng = random.Random(4)
    token = lambda: "".join(rng.choice("abcdehijklmnoprstuvy .+") for _ in range(24))
    rows = [([token(), " ReactJs ", None, "Postgresq"],) for _ in range(20000)]
    profiles = spark.createDataFrame(rows, "skills array<string>").withColumns({"field_confidence": F.create_map().cast("map<string,double>"), "overall_confidence": F.lit(0.0), "field_reasoning": F.create_map().cast("map<string,string>")})
    config = projection.parse({"fields": [{"path": "out", "from": "skills", "type": "string[]", "normalize": "canonical"}], "include_confidence": False, "include_provenance": False})
    began = time.time()
    got = projection.project(profiles, config, ("skills",)).collect()
    assert time.time() - began < 60
    assert all(r["out"] == [r["skills"][0].strip(), "React", "", "PostgreSQL"] for r in got)


def test_normalized_projection_is_dealt_to_many_tasks(spark):
    assert tasks(queries.project_normalized(spark, SF)) > 1


def test_stored_profiles_are_made_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(shared, "cut", lambda df, cut=shared.cut: made.append(plan(spark, df)) or cut(df))
    out = queries.reprojected(spark, SF)
    assert out.count() == 150
    assert [p.count("ArrowEvalPython") for p in made] == [1]  # twice before, as notices read all profiles twice


def test_larger_groups_are_dealt_to_many_tasks(spark):
    assert tasks(queries.larger_groups(spark, SF)) > 1
