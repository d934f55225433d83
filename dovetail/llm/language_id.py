"""Language identification by nearest centroid.

Texts are normalised TF-IDF vectors of hashed byte n-grams (letters only).  Document counts for the IDF cover all
training rows; centroids, several for each language, are spherical k-means clusters of a bounded sample
(SAMPLE_PER_LANG texts of each language, equal ones counted once).  The language of the nearest centroid by cosine is
predicted; a text farther from its centroid than nearly all of that centroid's own texts, and than nearly all of the
language's texts are from theirs, with a margin, is rejected.  So a cluster of copies doesn't reject what resembles it.

Edge cases.  Null texts and texts without a letter: `und`, score 0, rejected.  Rows with a null language teach
nothing.  No training rows: everything is `und`.  Repeated rows count as often as they stand.  Other columns are not
read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dovetail.llm import store, vectors

SIZES, DIMS = (2, 3), 4096
SAMPLE_PER_LANG, CLUSTERS = 1000, 4
#: A text is rejected beyond this quantile of its centroid's sample distances times this margin.
QUANTILE, MARGIN = 0.995, 1.25
#: Short texts are far from any centroid by chance: a text of so many bytes may be so much farther (see identify).
SHORT = 400


def cluster(x: np.ndarray, k: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; empty clusters go."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        mine = (x @ centres.T).argmax(1)
        sums = np.stack([x[mine == j].sum(0) for j in range(len(centres)) if (mine == j).any()])
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = sums / np.where(length > 0, length, 1)
    return centres.astype(np.float32)


def _clusters(pdf: pd.DataFrame) -> pd.DataFrame:
    """Centroids of one language's sample, with radii, the quantile of all its distances (none, where each text is a
    centroid) and those distances."""
    x = np.stack([np.frombuffer(v, np.float16) for v in sorted({bytes(v) for v in pdf["x"]})]).astype(np.float32)
    own = cluster(x, CLUSTERS)
    near = x @ own.T
    mine, distance = near.argmax(1), 1 - near.max(1)
    radius = [float(np.quantile(distance[mine == j], QUANTILE)) if (mine == j).any() else 1.0 for j in range(len(own))]
    floor = float(np.quantile(distance, QUANTILE)) if len(x) > CLUSTERS else None
    return pd.DataFrame([(pdf["_label"].iloc[0], own.astype(np.float32).tobytes(), radius, floor, float(distance.max()))], columns=["lang", "centres", "radii", "floor", "farthest"])


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """The model: languages of the centroids, centroids, their radii and the IDF.  A task clusters a language's sample; what
    reaches the driver and is sent out is CLUSTERS * DIMS floats for each language."""
    train = train.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    table = vectors.folded()
    n, having = vectors.document_counts(train, F.col(text_col), table, SIZES, DIMS)
    if not n:
        return None
    idf = vectors.idf(n, having)
    sample = vectors.sampled(train, F.col(id_col), F.col(lang_col), SAMPLE_PER_LANG)

    def score(data, at):
        x = vectors.weighted(vectors.counts(data, at, table, SIZES, DIMS), idf).astype(np.float16)
        return [[r.tobytes() for r in x]]

    found = vectors.scored(sample, ["_label"], text_col, score, "x binary").groupBy("_label").applyInPandas(_clusters, "lang string, centres binary, radii array<double>, floor double, farthest double")
    rows = sorted(found.collect(), key=lambda r: r["lang"])
    centres = [np.frombuffer(r["centres"], np.float32).reshape(-1, DIMS) for r in rows]
    # texts of a language that are all centroids tell no distance: the widest language's is taken
    floors = [r["floor"] for r in rows if r["floor"] is not None]
    widest = max(floors) if floors else max(r["farthest"] for r in rows)
    radii = [min(1.0, max(x, widest if r["floor"] is None else r["floor"]) * MARGIN) for r in rows for x in r["radii"]]
    return {"langs": [r["lang"] for r, c in zip(rows, centres, strict=True) for _ in c], "centres": np.concatenate(centres), "radii": np.array(radii), "idf": idf}


def identify(docs: DataFrame, model: dict | None, keep: list[str], text_col: str = "text", inside: str | None = None) -> DataFrame:
    """`keep` columns of docs, lang_pred, score (cosine, 0 to 1) and rejected (inside: see vectors.scored)."""
    if model is None:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    table = vectors.folded()

    def score(data, at):
        near = vectors.weighted(vectors.counts(data, at, table, SIZES, DIMS), model["idf"]) @ model["centres"].T
        best = near.argmax(1)
        cosine = near[np.arange(len(best)), best].astype(float)
        size = np.diff(at)
        least = (1 - model["radii"][best]) * np.sqrt(size / (size + SHORT))
        return [[model["langs"][b] for b in best], np.clip(cosine, 0, 1), cosine < least]

    free = "_letter"
    while free in {c.lower() for c in docs.columns}:
        free += "_"
    letters = docs.withColumn(free, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    out = vectors.scored(letters, [*keep, free], text_col, score, "_lang string, _score double, _rejected boolean", inside)
    known = F.col(free)
    return out.select(*keep, F.when(known, F.col("_lang")).otherwise("und").alias("lang_pred"), F.when(known, F.col("_score")).otherwise(0.0).alias("score"), (~known | F.col("_rejected")).alias("rejected"))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", store.id_crc() % 5 == 0)
    model = fit(docs.filter(~F.col("held_out")))
    return identify(docs, model, ["doc_id", "held_out"])
