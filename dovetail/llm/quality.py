"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts are TF-IDF vectors of hashed byte n-grams (case and signs kept); document counts cover the whole corpus.  A
truncated SVD of a bounded labelled sample (SAMPLE_PER_LABEL of each label) gives the latent space; the sample's
latent vectors are broadcast (2 * SAMPLE_PER_LABEL * RANK floats).  Each text's exact cosines to all of them are one
blocked matrix product; its NEIGHBOURS nearest (of equal ones those that stand first in the sample, which is ordered by label and vector) vote, weighted by similarity and by the share that each label's
sample is of its rows, so the score is the chance of label 1.

Edge cases.  Null and empty texts have a zero vector and get the prior.  Without labels of both kinds every score is
the prior (0.5 without any).  An id with differing labels has the smaller.  Repeated rows are scored each.  Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dovetail.llm import labelled, store, vectors

SIZES, DIMS, RANK = (1, 2, 3), 4096, 48
SAMPLE_PER_LABEL, NEIGHBOURS = 1500, 15
TABLE = np.arange(256, dtype=np.uint8)


def latent(x: np.ndarray, rank: int, seed: int = 3) -> np.ndarray:
    """Right singular vectors of x by randomised subspace iteration."""
    rng = np.random.default_rng(seed)
    y = x @ rng.standard_normal((x.shape[1], rank + 16)).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(y)
        y = x @ (x.T @ q)
    q, _ = np.linalg.qr(y)
    _, _, right = np.linalg.svd(q.T @ x, full_matrices=False)
    return right[:rank].T.astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def fit(docs: DataFrame, labels: DataFrame, allowed, label_col: str = "quality", text_col: str = "text") -> dict:
    n, having = vectors.document_counts(docs.filter(F.col(text_col).isNotNull()), F.col(text_col), TABLE, SIZES, DIMS)
    idf = vectors.idf(n, having)
    sample, sizes = labelled.sample(docs, labels, label_col, allowed, SAMPLE_PER_LABEL)

    def score(data, at):
        return [[r.astype(np.float16).tobytes() for r in vectors.weighted(vectors.counts(data, at, TABLE, SIZES, DIMS), idf)]]

    rows = sorted(vectors.scored(sample, ["_label"], text_col, score, "x binary").collect(), key=lambda r: (r[0], bytes(r[1])))
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.5
    if len({r[0] for r in rows}) < 2:
        return {"prior": prior, "idf": idf}
    x = np.stack([np.frombuffer(r[1], np.float16) for r in rows]).astype(np.float32)
    y = np.array([r[0] for r in rows])
    space = latent(x, RANK)
    share = {v: sizes[v] / max(1, int((y == v).sum())) for v in (0, 1)}
    return {"prior": prior, "idf": idf, "space": space, "known": unit(x @ space), "y": y, "weight": np.where(y == 1, share[1], share[0])}


def vote(near: np.ndarray, model: dict, k: int = NEIGHBOURS) -> np.ndarray:
    """The chance of label 1 from cosines to all known vectors."""
    k = min(k, near.shape[1])
    last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
    above, equal = near > last, near == last
    taken = above | equal & (np.cumsum(equal, 1) <= k - above.sum(1, keepdims=True))  # of equal ones the first rows
    similar = np.where(taken, np.maximum(near, 0) ** 2 * model["weight"], 0)
    total = similar.sum(1)
    ones = (similar * model["y"]).sum(1)
    return np.where(total > 0, ones / np.where(total > 0, total, 1), model["prior"])


def classify(docs: DataFrame, model: dict, keep: list[str], text_col: str = "text", inside: str | None = None) -> DataFrame:
    """`keep` columns of docs, score and predicted (inside: see vectors.scored)."""

    def score(data, at):
        if "known" not in model:
            return [np.full(len(at) - 1, model["prior"])]
        x = unit(vectors.weighted(vectors.counts(data, at, TABLE, SIZES, DIMS), model["idf"]) @ model["space"])
        return [np.clip(vote(x @ model["known"].T, model), 0, 1).astype(float)]

    return vectors.scored(docs, keep, text_col, score, "score double", inside).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_quality_knn(spark, sf_dir: str) -> DataFrame:
    docs = store.table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", store.id_crc() % 3 == 1)
    model = fit(docs, store.table(spark, sf_dir, "labels"), store.id_crc() % 3 != 1)
    return classify(docs, model, ["doc_id", "held_out"])
