"""Units of the engine on small own fixtures, and one whole batch."""

import io
import json
import random
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from dovetail import cli
from dovetail.functions import extract, normalize, similarity
from dovetail.operators import merge, resolve
from dovetail.plans import pipeline, projection
from dovetail.sources import documents, registry, tables


def one(spark, column, **values):
    """The value of a column over one row of text values."""
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)) if names else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        above, row = row, [0]
        for j, o in enumerate(b):
            row.append(above[j] + 1 if ch == o else max(above[j + 1], row[j]))
    return row[-1]


def test_ratios(spark):
    rng = random.Random(0)
    pairs = [("react.js", "react"), ("mohan iqbal", "mohit iqbal"), ("", ""), ("", "a"), ("spring", "swift"), ("ñandú", "nandu")]
    pairs += [("".join(rng.choice("abcé ") for _ in range(rng.randrange(9))), "".join(rng.choice("abcé ") for _ in range(rng.randrange(9)))) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", similarity.indel_ratio(F.col("a"), F.col("b")).alias("r"), similarity.indel_ratio(F.col("b"), F.col("a")).alias("s"), similarity.partial_ratio(F.col("a"), F.col("b")).alias("p")).collect():
        a, b = r["a"], r["b"]
        want = 100.0 if a == b else 200 * lcs(a, b) / (len(a) + len(b))
        assert r["r"] == pytest.approx(want) and r["r"] == r["s"] and 0 <= r["r"] <= 100
        if a and b and a != b:
            def best(x, y):
                return max(200 * lcs(x, w) / (len(x) + len(w)) for i in range(1 - len(x), len(y)) for w in [y[max(0, i) : i + len(x)]] if w)

            assert r["p"] == pytest.approx(max(best(a, b), best(b, a)) if len(a) == len(b) else best(*sorted((a, b), key=len)))
    assert merge.similar("Acme Corp", " acme corp ") == 100


@pytest.mark.parametrize(("raw", "e164", "method"), [
    ("+1 415 555 0182", "+14155550182", "E164"), ("+91-98765 00001", "+919876500001", "E164"), ("9876500001", None, "unnormalized_no_country_code"),
    ("+1 115 555 0182", None, "unnormalized_invalid"), ("+abc", None, "unnormalized_parse_error"), ("  ", None, "empty"), (None, None, "empty"),
])
def test_phones(spark, raw, e164, method):
    got = one(spark, normalize.phone(F.col("x")), x=raw)
    assert (got["e164"], got["method"]) == (e164, method)


@pytest.mark.parametrize(("raw", "start", "end"), [
    ("Jan 2020", "2020-01", "2020-01"), ("Sept. 2021", "2021-09", "2021-09"), ("3/2019", "2019-03", "2019-03"), ("13/2019", "2019-13", "2019-13"), ("2020", "2020-01", "2020-01"),
    ("2020-05-06", "2020-05", "2020-05"), ("present", None, None), ("soon", None, None), ("Foo 2020", None, None), (None, None, None),
])
def test_dates(spark, raw, start, end):
    assert one(spark, F.struct(normalize.year_month(F.col("x")), normalize.end_year_month(F.col("x"))), x=raw) == (start, end)


def test_skills(spark):
    for raw, name, method in [("ReactJS", "React", "alias_dictionary"), (" k8s ", "Kubernetes", "alias_dictionary"), ("Postgresq", "PostgreSQL", "fuzzy_match_normalization"), ("Basket weaving", "Basket weaving", "kept_original_below_threshold"), ("", "", "empty")]:
        got = one(spark, normalize.skill(F.col("x")), x=raw)
        assert (got["name"], got["method"]) == (name, method)
    assert one(spark, normalize.skill(F.col("x")), x="Postgresq")["confidence"] == 0.95


def test_rounding_of_months_and_single_source_scores(spark):
    from dovetail.operators.score import SINGLE

    got = spark.range(1, 121).select(F.bround(F.col("id") / 12, 1)).collect()
    assert [r[0] for r in got] == [round(m / 12, 1) for m in range(1, 121)]
    assert (SINGLE[0.75], SINGLE[0.95], SINGLE[0.65]) == (0.637, 0.807, 0.552)


def test_person_names_and_binary_gate(spark):
    for text, fits in [("Ana Lima", True), ("O'Neil-Smith Jr.", True), ("X1 Y2 Z3", False), ("A", False), ("é" * 61, False), (None, False)]:
        assert one(spark, normalize.person_name(F.col("x")), x=text) is fits
    for text, gate in [("plain text\n" * 50, False), ("\x01" * 5 + "a" * 95, True), ("\x01" * 4 + "a" * 96, False), ("\u200b" * 20 + "a" * 80, True), ("", False)]:
        assert one(spark, normalize.binary_like(F.col("x")), x=text) is gate


RESUME = """Ana Lima

Sao Paulo, Brazil
Senior engineer of data things
ana.lima@mail.com | +1 415 555 0182
www.linkedin.com/in/ana-lima and https://ana.dev and https://blog.ana.dev/x

EXPERIENCE
Acme Corp - Engineer
Jan 2019 - Mar 2020
Built pipes.

Beta LLC
Some Company
2/2020 – Present

Education
State University
Bachelor of Science
Physics
2014

Technical Skills
• Python, k8s
Spark | SQL
Skills
"""


def test_extraction(spark):
    text = F.col("x")
    value = lambda c: one(spark, c, x=RESUME)
    assert value(extract.emails(text)) == ["ana.lima@mail.com"] and "+1 415 555 0182" in value(extract.phones(text))
    assert value(extract.name(text)) == "Ana Lima" and value(extract.headline(text, extract.name(text))) == "Senior engineer of data things"
    links = value(extract.links(text))
    assert (links["linkedin"], links["portfolio"], links["other"]) == ("https://www.linkedin.com/in/ana-lima", "https://ana.dev", ["https://blog.ana.dev/x"])
    assert value(extract.location(text))["country"] is None
    found = value(extract.sections(text))
    assert found["skills"] == []  # the repeated section wins
    assert [(r["company"], r["title"], r["is_current"]) for r in found["experience"]] == [("Acme Corp", "Engineer", False), ("Some Company", "Beta LLC", True)]
    assert found["experience"][0]["summary"] == "Built pipes."
    assert [tuple(s) for s in found["education"]] == [("State University", "Bachelor of Science", "Physics", 2014)]
    years = extract.worked_years(extract.sections(text)["experience"], F.lit(date(2021, 1, 31)))
    assert value(years) == round((14 + 11) / 12, 1)
    assert one(spark, extract.stated_years(text), x="over 7.5+ yrs of experience") == 7.5
    assert one(spark, extract.worked_years(extract.sections(text)["experience"], F.lit(date(2021, 1, 1))), x="nothing") is None


def docx(*paragraphs):
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@pytest.fixture(scope="module")
def batch(tmp_path_factory):
    d = tmp_path_factory.mktemp("batch")
    r = d / "resumes"
    r.mkdir()
    (d / "people.csv").write_bytes(("﻿ref, Full  Name ,E-Mail,Mobile,Employer,Position,YOE,Resume,Skills,Education\n"
        'a,Exact Person,EXACT@x.com,+1 415 555 0182,Acme,"Lead, of\nthings",5,,"Python; js|COBOL","MIT - BSc, 2010"\n'
        "b,Mail Person,mail@x.com,111,Beta,,3,files/mail.txt,,\n"
        "c,Name Persona,c@x.com,222,,,,files/name.txt,,\n"
        "d,Wrong Person,d@x.com,333,Delta,Clerk,,files/wrong.txt,,\n"
        ",,,,,,,,,\n"
        "e,,,444,,,,files/absent.txt,,\n"
        "f,Gone Person,f@x.com,,,,,files/blank.txt,,\n"
        "g,Twice One,g@x.com,555,,,,files/mail.txt,,\n").encode())
    texts = {
        "exact.txt": "Exact Person\n\nexact@x.com\n+1 415 555 0182\n\nSKILLS\nPython, Go\n\nEXPERIENCE\nAcme\nLead of things\nJan 2018 - Jan 2021\n",
        "mail.txt": "Mail Persson\nmail@x.com\n\nEXPERIENCE\nTester\nBeta\nJan 2019 - Jan 2022\n", "name.txt": "Name Person\n\nother@y.org\n", "wrong.txt": "Somebody Else\nelse@z.org\n", "alone.txt": "Lone Wolf\nlone@z.org\n",
        "blank.txt": "  \n",
    }
    for name, text in texts.items():
        (r / name).write_text(text)
    (r / "latin.txt").write_bytes("Zoë Ångström\nzoe@z.org\r\n".encode("latin-1"))
    (r / "word.docx").write_bytes(docx("Doc Person", " ", "doc@z.org"))
    (r / "broken.docx").write_bytes(b"no zip")
    (r / "scan.pdf").write_bytes(b"%PDF-1.4")
    (r / "binary.txt").write_bytes(b"\x01\x02\x03" * 100)
    (r / "ignored.xyz").write_text("x@y.com")
    return d


@pytest.fixture(scope="module")
def result(spark, batch):
    found = pipeline.run(spark, str(batch / "people.csv"), str(batch / "resumes"), None, date(2026, 6, 15))
    found["canonical"] = found["canonical"].cache()
    return found


def test_tables(spark, batch):
    rows = {r["row_number"]: r for r in tables.read_table(spark, str(batch / "people.csv")).collect()}
    assert sorted(rows) == [2, 3, 4, 5, 7, 8, 9]
    assert rows[2]["title"] == "Lead, of\nthings" and rows[2]["source_id"] == "csv_exact@x.com" and rows[7]["source_id"] == "csv_row_7" and rows[7]["warnings"] == ["missing email"]
    assert tables.read_table(spark, str(batch / "no such file.csv")).count() == 0
    assert tables.attributes_of(["Company", " employer ", "x"]) == {"current_company": " employer "}
    (batch / "strange.csv").write_text("a,b\n1,2\n")
    assert registry.reader("csv")(spark, str(batch / "strange.csv")).count() == 0
    with pytest.raises(ValueError):
        registry.reader("github")


def test_documents(spark, batch):
    rows = {r["filename"]: r for r in documents.read_folder(spark, str(batch / "resumes")).collect()}
    assert set(rows) == {"exact.txt", "mail.txt", "name.txt", "wrong.txt", "alone.txt", "blank.txt", "latin.txt", "word.docx", "binary.txt"}
    assert rows["word.docx"]["raw_text"] == "Doc Person\ndoc@z.org" and rows["latin.txt"]["raw_text"].startswith("Zoë Ångström\n")
    assert rows["binary.txt"]["raw_text"] == rows["blank.txt"]["raw_text"] == "" and rows["binary.txt"]["warnings"]
    assert documents.read_folder(spark, str(batch / "nowhere")).count() == 0


def test_whole_batch(result):
    rows = result["canonical"].collect()
    got = sorted((r["full_name"] or "", r["source_profile_kind"], r["meta"]["match_method"]) for r in rows)
    assert got == sorted([
        ("Exact Person", "merged", "exact_email_and_phone"), ("Mail Persson", "merged", "manifest_resume_link"), ("Name Person", "merged", "manifest_resume_link"),
        ("Wrong Person", "csv_only", "singleton"), ("Somebody Else", "resume_only", "singleton"), ("", "csv_only", "singleton"), ("Gone Person", "csv_only", "singleton"),
        ("Twice One", "csv_only", "singleton"), ("Mail Persson", "resume_only", "singleton"), ("Lone Wolf", "resume_only", "singleton"), ("Zoë Ångström", "resume_only", "singleton"), ("Doc Person", "resume_only", "singleton"),
    ])
    by = {(r["full_name"], r["source_profile_kind"]): r for r in rows}
    exact = by["Exact Person", "merged"]
    assert exact["phones"] == ["+14155550182"] and exact["emails"] == ["EXACT@x.com"] and exact["years_experience"] is None
    assert [(s["name"], s["sources"]) for s in exact["skills"]] == [("Python", ["recruiter_csv", "resume"]), ("JavaScript", ["recruiter_csv"]), ("COBOL", ["recruiter_csv"]), ("Go", ["resume"])]
    assert exact["provenance"][0]["method"] == "suppressed_disagreement" and "40% gap" in exact["provenance"][0]["notes"]
    assert exact["education"][0]["end_year"] == 2010
    assert "was not found" in by[None, "csv_only"]["source_notice"] and "empty" in by["Gone Person", "csv_only"]["source_notice"]
    assert by["Somebody Else", "resume_only"]["source_notice"].startswith("CSV and resume do not match")
    assert "No candidate name on CSV (CSV row 7)" in by[None, "csv_only"]["meta"]["data_quality_notice"]
    assert result["summary"].first()["total"] == 12
    assert all(0 <= s <= 1 for r in rows for s in r["field_confidence"].values())


def test_every_record_is_in_one_group(spark):
    from dovetail import queries

    records = queries.two_views(spark, "/root/testdata/sf0.001")
    got = resolve.resolve(records).select("record_id", "group_id").collect()
    assert len({r["record_id"] for r in got}) == len(got) == records.count()


def test_listed_resumes_are_taken_once(spark):
    place = "struct<late:int,row_number:bigint,second:int,path:string>"
    rows = [((0, 2, 1, None), "recruiter_csv", "a", "x@x", "1", "N"), ((0, 3, 1, None), "recruiter_csv", "b", "x@x", "2", "N"), ((0, 4, 1, None), "recruiter_csv", "c", "x@x", "3", "N"), ((1, None, 0, "p"), "resume", "r", "x@x", "9", "N"), ((1, None, 0, "q"), "resume", "s", "x@x", "8", "N")]
    df = spark.createDataFrame([(*r, "f.txt", r[2]) for r in rows], f"place {place}, source_type string, source_id string, email string, phone string, name string, file string, record_id string")
    got = {(r["x"], r["y"]) for r in resolve.listed_pairs(df).collect()}
    assert got == {("a", "r"), ("b", "s")}
    other = df.withColumn("name", F.when(F.col("record_id") == "s", "M").otherwise(F.col("name")))
    assert {(r["x"], r["y"]) for r in resolve.listed_pairs(other).collect()} == got


def test_projection_grammar(result):
    df = result["canonical"].filter("full_name = 'Exact Person'")
    def value(path, kind="string", **more):
        config = projection.parse({"fields": [{"path": "x", "from": path, "type": kind, **more}], "include_confidence": False, "include_provenance": False, "on_missing": more.pop("on_missing", "null")})
        r = projection.project(df, config).first()
        return r["x"], r["error"]

    assert value("emails[0]") == ("EXACT@x.com", None) and value("emails[9]") == (None, None) and value("no.such[].path") == (None, None)
    assert value("skills[].name", "string[]")[0] == ["Python", "JavaScript", "COBOL", "Go"] and value("skills[].nope", "string[]")[0] == []
    assert value("skills[].sources[]", "object[]")[0][0] == ["recruiter_csv", "resume"]
    assert value("full_name", "string[]")[0] == ["Exact Person"] and value("years_experience", "number") == (None, None)
    assert value("full_name", "number") == (None, "Field x expected number") and value("links", "object[]")[0][0]["other"] == []
    assert value("emails", "string[]")[0] == ["EXACT@x.com"] and value("links.github", "string[]")[0] == []
    assert value("phones_raw", "string[]")[0] == [] and value("field_confidence.emails", "number")[0] == 0.9
    assert value("phones[0]", normalize="e164")[0] == "+14155550182"
    assert projection.confidence_key("skills[].name") == "skills" and projection.confidence_key("emails[0]") == "emails" and projection.confidence_key("location.country") == "location.country"
    with pytest.raises(ValueError):
        projection.parse("{nonsense")
    assert projection.parse("  ") == projection.parse(None)


def test_policies_and_documents(result):
    fields = [{"path": "full_name", "required": True}, {"path": "city", "from": "location.city"}]
    def run(policy):
        return pipeline.reproject(result["canonical"], {"fields": fields, "on_missing": policy, "include_provenance": False})

    errors = run("error")["errors"].collect()
    assert [r["error"] for r in errors] == ["Required field missing: full_name"]
    nulls = [json.loads(r["output"]) for r in run("null")["output"].collect()]
    assert len(nulls) == 12 and all(list(d)[:4] == ["full_name", "full_name_confidence", "city", "city_confidence"] for d in nulls)
    omitted = [json.loads(r["output"]) for r in run("omit")["output"].collect()]
    assert any("full_name" not in d and "full_name_confidence" not in d for d in omitted) and all(d.get("city", "x") is not None for d in omitted)


def test_stored_profiles_project_alike(spark, result, tmp_path):
    result["canonical"].select(*pipeline.CANONICAL, "group_order").write.parquet(str(tmp_path / "c"))
    again = pipeline.reproject(pipeline.shaped(spark.read.parquet(str(tmp_path / "c"))))
    assert [r["output"] for r in again["output"].collect()] == [r["output"] for r in result["output"].collect()]
    cards = [json.loads(r["card"]) for r in pipeline.cards(result["canonical"]).collect()]
    assert all("links_confidence" in c and "meta" not in c for c in cards)
    assert all(("best_match" in s) == (s["method"] == "kept_original_below_threshold") for c in cards for s in c["skills"])


def test_command_line(batch, tmp_path, spark):
    out = tmp_path / "deep" / "out.json"
    assert cli.main(["--csv", str(batch / "people.csv"), "--resumes", str(batch / "resumes"), "-o", str(out)]) == 0
    assert len(json.loads(out.read_text())) == 12
    assert cli.main(["--csv", str(batch / "missing.csv"), "--resumes", str(batch / "resumes")]) == 1


def test_roles_and_studies_fold():
    role = lambda c, t, s=None: {"company": c, "title": t, "start": s, "end": None, "summary": None, "is_current": False}
    now = lambda c, t, d=None: {"company": c, "title": t, "summary": d}
    names = lambda rows: [(r["company"], r["title"], r["source"]) for r in rows]
    two = [role("Acme", "Engineer", "2019-01"), role("Beta", "Tester", "2017-01"), role("acme ", "engineer", "2019-01")]
    assert names(merge.fold_roles(two, [now("Beta", "Tester II")])) == [("Acme", "Engineer", "resume"), ("Beta", "Tester II", "merged")]
    assert names(merge.fold_roles(two, [now("Gamma", "Boss")]))[0] == ("Gamma", "Boss", "recruiter_csv")
    assert names(merge.fold_roles(two, [now("Acme", "Cook")]))[-1] == ("Acme", "Cook", "recruiter_csv")
    assert names(merge.fold_roles([], [now(None, None), now("A", None)])) == [("A", None, "recruiter_csv")]
    study = lambda i, d=None, y=None: {"institution": i, "degree": d, "field": None, "end_year": y}
    got = merge.fold_studies([study("MIT")], [study("mit ", "BSc", 2001), study("", "x"), study("Other")])
    assert [(s["degree"], s["end_year"], s["source"]) for s in got] == [("BSc", 2001, "merged"), (None, None, "resume")]


def test_arriving_files(spark, tmp_path):
    from dovetail.streaming import arrivals

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Name,E-mail\nAna,a@x.com\n,\n")
    run = lambda: arrivals.keep(arrivals.arriving_rows(spark, str(tmp_path / "in"), ["Name", "E-mail"]), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    (tmp_path / "in" / "b.csv").write_text("Name,E-mail\nBob,\n")
    run()
    got = {r["name"]: r["source_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["Ana"] == "csv_a@x.com" and got["Bob"].startswith("csv_row_") and len(got) == 2


@pytest.mark.parametrize(("raw", "region", "e164", "method"), [
    ("(415) 555-0182", "US", "+14155550182", "E164"), ("098765 00001", "in", "+919876500001", "E164"), ("+44 20 7946 0018", "US", "+442079460018", "E164"),
    ("12", "US", None, "unnormalized_parse_error"), ("115 555 0182", "CA", None, "unnormalized_invalid"), ("9876500001", None, None, "unnormalized_no_country_code"),
])
def test_phones_of_a_region(spark, raw, region, e164, method):
    got = one(spark, normalize.phone(F.col("x"), region), x=raw)
    assert (got["e164"], got["method"]) == (e164, method)


def test_source_priority_decides_the_first_email(spark):
    from dovetail import queries

    views = queries.customer_views(spark, "/root/testdata/sf0.001").filter("size(c) > 0 AND size(r) > 0").limit(1)
    key = views.first()["c_custkey"]
    ids = [merge.merged(views, p).first()["candidate_id"] for p in (("resume", "recruiter_csv"), ("recruiter_csv",), ())]
    import hashlib

    assert ids[0] == ids[1] == hashlib.sha256(f"user{key}@x.com".encode()).hexdigest() and ids[2].startswith("unknown_")


def test_errors_can_stop_a_projection(spark, result):
    strict = {"fields": [{"path": "phone", "from": "phones[0]", "required": True}], "on_missing": "error"}
    found = pipeline.reproject(result["canonical"], strict)
    good, bad = found["output"].count(), found["errors"].count()
    assert good and bad and good + bad == result["canonical"].count() and found["meta"].count() == good
    with pytest.raises(ValueError, match="Required field missing: phone"):
        pipeline.reproject(result["canonical"], strict, skip_on_error=False)


def test_warnings_are_kept(result):
    said = {(r["source_id"], r["warning"]) for r in result["warnings"].collect()}
    assert ("csv_row_7", "missing email") in said and any("missing: absent.txt" in w for _, w in said) and any("failed validation: wrong.txt" in w for _, w in said)


def test_files_are_numbered_each(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text("name,email\n" + "".join(f"{name} {i},e{i}@x.com\n" for i in range(3)))
    rows = tables.read_table(spark, str(tmp_path)).collect()
    assert sorted((r["name"], r["row_number"]) for r in rows) == [(f"{n} {i}", i + 2) for n in ("a.csv", "b.csv") for i in range(3)]
