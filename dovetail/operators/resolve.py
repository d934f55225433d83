"""Entity resolution: which records are of one person.

Exact: the same email and the same phone digits.  Listed: a table row names a resume file and email, phone, name or the
file's name agree.  Nothing else joins records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dovetail.functions.normalize import file_stem
from dovetail.functions.similarity import indel_ratio, partial_ratio
from dovetail.plans.shared import cut

NAME_AGREES, STEM_AGREES = 85, 90
EXACT, LISTED, SINGLE = ("exact_email_and_phone", 0.97), ("manifest_resume_link", 0.88), ("singleton", 1.0)


def validated(a_email: Column, a_phone: Column, a_name: Column, b_email: Column, b_phone: Column, b_name: Column, file: Column) -> Column:
    """Whether a row and the resume file it lists agree; the cheap tests come first."""
    named = a_name.isNotNull() & b_name.isNotNull()
    told = F.coalesce(a_email == b_email, F.lit(False)) | F.coalesce(a_phone == b_phone, F.lit(False)) | ~named
    x, y, stem = (F.when(~told, F.lower(text)) for text in (a_name, b_name, file_stem(file)))  # null costs no comparison
    return (
        F.when(a_email == b_email, True)
        .when(a_phone == b_phone, True)
        .when(~named, False)
        .when(indel_ratio(x, y) >= NAME_AGREES, True)
        .otherwise((partial_ratio(x, stem) >= STEM_AGREES) & (partial_ratio(y, stem) >= STEM_AGREES))
    )


def exact_groups(records: DataFrame) -> DataFrame:
    """(record_id, group_place) of records that share email and phone with another."""
    keyed = records.filter((F.col("email") != "") & F.col("phone").isNotNull())
    keys = keyed.groupBy("email", "phone").agg(F.min("place").alias("group_place"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(keys, ["email", "phone"]).select("record_id", "group_place")


def listed_pairs(records: DataFrame) -> DataFrame:
    """(x: row, y: resume, px: place of the row) for rows and the resume files they list; each row takes the first resume
    that agrees and is free, in the rows' order.

    Where all resumes of a file are alike (copies of one file that several rows list), the rows that agree take them by
    rank, so a file that very many rows list needs no pair of each row with each copy.  Other files go by rounds."""
    rows = records.filter("source_type = 'recruiter_csv' AND file IS NOT NULL")
    resumes = records.filter("source_type = 'resume' AND file IS NOT NULL")
    kinds = resumes.groupBy("file", "email", "phone", "name").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"))
    alike = cut(kinds.join(kinds.groupBy("file").agg(F.count(F.lit(1)).alias("kinds")), "file"))
    fits = validated(*[F.col(f"a.{c}") for c in ("email", "phone", "name")], *[F.col(f"b.{c}") for c in ("email", "phone", "name")], F.col("a.file"))
    in_order = Window.partitionBy("file").orderBy("place")
    same = alike.filter("kinds = 1")
    agreeing = rows.alias("a").join(same.alias("b"), "file").filter(fits).select("file", F.col("a.record_id").alias("x"), F.col("a.place").alias("place")).withColumn("rank", F.row_number().over(in_order))
    copies = resumes.join(same.select("file"), "file", "left_semi").select("file", F.col("record_id").alias("y"), "place").withColumn("rank", F.row_number().over(in_order)).drop("place")
    by_rank = agreeing.join(copies, ["file", "rank"]).select("x", "y", F.col("place").alias("px"))
    mixed = resumes.join(alike.filter("kinds > 1").select("file").distinct(), "file", "left_semi")
    pairs = rows.alias("a").join(mixed.alias("b"), F.col("a.file") == F.col("b.file")).filter(fits)
    return by_rank.unionByName(by_rounds(pairs.select(F.col("a.record_id").alias("x"), F.col("b.record_id").alias("y"), F.col("a.place").alias("px"), F.col("b.place").alias("py"))))


def by_rounds(pairs: DataFrame) -> DataFrame:
    """Rows prefer resumes by place and resumes prefer rows by place, so in each round the pairs that are first for both
    are final; rounds end when no pair is left."""
    open_ = cut(pairs)
    final = None
    while not open_.isEmpty():
        first_of = open_.groupBy("x").agg(F.min("py").alias("first_y"))
        first_to = open_.groupBy("y").agg(F.min("px").alias("first_x"))
        both = cut(open_.join(first_of, "x").join(first_to, "y").filter("py = first_y AND px = first_x").select("x", "y", "px"))
        final = both if final is None else final.union(both)
        open_ = cut(open_.join(both.select("x"), "x", "left_anti").join(both.select("y"), "y", "left_anti"))
    return open_.select("x", "y", "px") if final is None else final


def resolve(records: DataFrame) -> DataFrame:
    """records with group_id, group_order (exact, listed, single; then place), match_method and match_confidence."""
    exact = exact_groups(records)
    rest = cut(records.join(exact.select("record_id"), "record_id", "left_anti"))
    pairs = listed_pairs(rest)
    kind = lambda df, rank, how: df.withColumns({"group_order": F.struct(F.lit(rank).alias("rank"), F.col("group_place").alias("place")), "match_method": F.lit(how[0]), "match_confidence": F.lit(how[1])})
    linked = pairs.select(F.explode(F.array("x", "y")).alias("record_id"), F.col("px").alias("group_place"))
    single = rest.join(linked.select("record_id"), "record_id", "left_anti").select("record_id", F.col("place").alias("group_place"))
    chosen = kind(exact, 0, EXACT).unionByName(kind(linked, 1, LISTED)).unionByName(kind(single, 2, SINGLE)).drop("group_place")
    return records.join(chosen, "record_id").withColumn("group_id", F.to_json("group_order"))
