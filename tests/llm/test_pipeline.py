"""The pipeline's stages, one by one, and the larger paths of the n-gram join."""

import re

import pytest
from test_llm import by_brute_force, near_copies, table

from dovetail.llm import ngram_join, packing, stages

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_follow_one_another(spark, documents):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "language", "near_duplicates", "secrets", "packing"]
    docs, before = documents, documents.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert sorted(out.columns) == sorted(docs.columns) and out.dtypes == docs.dtypes
        n = out.count()
        assert 0 < n <= before
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert {r["doc_id"] for r in out.select("doc_id").collect()} <= ids
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            keep = {i for i, _, c in by_brute_force(rows) if i == c}
            assert {r["doc_id"] for r in out.collect()} == keep
        if name == "secrets":
            assert n == before
            assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{12,})""", re.I)
            left = [m[2] for r in out.collect() for m in assign.finditer(r["text"])]
            assert len(left) == 0
        docs, before = out, n
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    tokens = sum(len(packing.encode(r["text"])) for r in docs.collect())
    assert last.agg({"length": "sum"}).first()[0] == tokens


def test_run_gives_pieces(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r["length"] > 0 for r in rows)


def test_stages_bear_odd_documents(spark, tmp_path):
    rows = [(1, None, "en"), (2, "", None), (None, "no id and some words here in a row", "en"), (3, "a b c d e f", "en"), (3, "a b c d e f", "en"), (4, "A b c d e f", "de")]
    docs = table(spark, rows)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert stages.good_quality(spark, docs, str(tmp_path)).columns == docs.columns
    assert stages.known_language(spark, docs, str(tmp_path)).columns == docs.columns
    kept = stages.one_of_each_group(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "2", "3", "None"]  # without an id: its text stands once
    assert stages.without_secrets(spark, docs, str(tmp_path)).count() == len(rows)
    none = docs.limit(0)
    for stage in (stages.good_quality, stages.known_language, stages.one_of_each_group, stages.without_secrets, stages.packed):
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_stages_bear_any_columns(spark, tmp_path):
    """Names with dots and quotes, names of the operators' own columns, ids that are null or repeated."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `_s_repo` string, `_letter` boolean, `_row` int, `_label` string, row int, base string, score double, predicted int, tag long, id long, `x``y` string"
    text = "some words that are long enough to be a text with password=Ab3dE6gH9kL2mN in it"
    rows = [(1, text), (2, text), (None, text), (None, "another text that has no id at all"), (None, "another text that has no id at all"), (3, "one text here now and again"), (3, "and quite another of the same id"), (3, "one text here now and again"), (4, None), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "ab", "r", True, 7, "l", 8, "b", 0.5, 1, 9, 10, "q") for i, t in rows], kind)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for stage in (stages.good_quality, stages.known_language, stages.one_of_each_group, stages.without_secrets):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = out.collect()
        assert all(r["a.b"] == "ab" and r["_row"] == 7 and r["x`y"] == "q" for r in got)
        if stage is stages.one_of_each_group:
            assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted([("1", text), ("None", rows[3][1]), ("3", rows[5][1]), ("3", rows[6][1]), ("4", "None"), ("None", str(got[[r["doc_id"] is None and not r["text"] for r in got].index(True)]["text"]))])
        if stage is stages.without_secrets:
            assert len(got) == len(rows) and sum("<secret>" in (r["text"] or "") for r in got) == 3
    assert stages.packed(spark, docs, str(tmp_path)).count() == len(rows)


@pytest.mark.parametrize(("rounds", "group", "heavy", "block"), [(1, 8, 2, 40), (0, 16, 3, 1 << 16)])
def test_jaccard_join_in_blocks(spark, monkeypatch, rounds, group, heavy, block):
    """Small blocks and few rounds, so that heavy shingles and block-wise comparison decide."""
    monkeypatch.setattr(ngram_join, "STAR_ROUNDS", rounds or 1)
    monkeypatch.setattr(ngram_join, "GROUP", group)
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    rows = near_copies(9)
    docs = table(spark, [(i, t, None) for i, t in rows])
    got = ngram_join.ngram_jaccard_join(docs).select("id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == by_brute_force(rows)
