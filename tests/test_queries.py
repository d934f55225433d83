"""Every query with SQL against DuckDB, at two numbers of shuffle partitions for those that group."""

import oracle
import pytest

from dovetail import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_agrees_with_its_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    if name in queries.ORACLES:
        got, want = oracle.compared(df, queries.ORACLES[name], SF)
        assert got == want
    else:
        assert df.count() > 0


def test_results_do_not_depend_on_partitions(spark):
    first = sorted(map(tuple, queries.history_union(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(tuple, queries.history_union(spark, SF).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_overall_is_the_weighted_mean(spark):
    from fractions import Fraction

    from dovetail.operators import merge, score

    rows = score.scored(merge.merged(queries.customer_views(spark, SF))).select("field_confidence", "overall_confidence").collect()
    for r in rows:
        w = {f: Fraction(3, 2) if f in ("full_name", "emails") else Fraction(1) for f in r["field_confidence"]}
        exact = sum(Fraction(v) * w[f] for f, v in r["field_confidence"].items()) / sum(w.values())
        assert abs(float(exact) - r["overall_confidence"]) <= 0.0005000001 and 0 <= r["overall_confidence"] <= 1


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 150
    assert set(entry.oracle_sql()) <= set(entry.queries())
