"""Exact top-k inner product search by pivot-table elimination.

Components become floor(256 * x).  Inner products follow from distances: 2 q.x = |q|**2 + |x|**2 - |q - x|**2, and for
any pivot p, |q - x| >= |d(q, p) - d(x, p)|.  The largest lower bound over PIVOTS pivots gives each candidate an upper
bound of its score; candidates are evaluated in bound order, and a query stops exactly where no bound reaches its k-th
score (ties go to the smaller id, so equal bounds are still evaluated).

Vectors lie in blocks of about BLOCK rows by their nearest pivot.  A query first meets its own block, which gives it a k-th
score.  Each block is known by its number of rows, its longest vector and its ranges of distances to all pivots: a block
that no query of another block can need, by the same bounds over those ranges, is not sent there.  So candidates
are copied only for blocks of queries that may need them, no side is broadcast or collected and no pair of rows becomes a
row.  Where vectors have no clusters the bounds can't rule blocks out and all are evaluated; `evaluated` (see top_k) says.

Pivots are different vectors, one from each of 4 * PIVOTS hash slots of a dimension (at most that many reach the driver
for each dimension, in DIMENSIONS dimensions; others use their blocks' first vector).

Edge cases.  Null vectors, vectors with null or non-finite components and rows with a null id take no part; a query
is never its own candidate, nor are rows that repeat its id; repeated candidate rows count once for each row; only
vectors of a query's dimension are its candidates.  Without other candidates a query has no rows.  An empty table
gives no rows.  Other columns are not read.  Of rows that
repeat a query's id the one with the smallest vector asks.  Components count up to 2**27 / 256 in size, larger ones as
that: products of 512 components are exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dovetail.llm import store
from dovetail.llm.blobs import pack, unpack

PIVOTS, DIMENSIONS = 24, 100
BLOCK = 8192
#: Blocks whose ranges a task compares with a block's queries at once.
CHUNK = 16384
STEP = 256
LARGEST = (1 << 27) - 1
#: Tasks that compare blocks with each chunk of ranges.
SALTS = 64


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & F.coalesce(finite, F.lit(False)) & (F.size(x) > 0)).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(F.greatest(F.least(v * 256, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long")).alias("v"))


def _table(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def best(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, pivots: np.ndarray) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(query, candidate, score) of each query's best k among the candidates, exactly, but for scores below `least`; and how
    many candidates each query evaluated."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    qf, cf = q.astype(float), c.astype(float)
    to_pivots, of_query = _table(cf, pivots), _table(qf, pivots)
    own, squares = (qf * qf).sum(1), (cf * cf).sum(1)
    out, evaluated = [], np.zeros(len(q), np.int64)
    for i in range(len(q)):
        bound = _bound(own[i], squares, np.abs(to_pivots - of_query[i]).max(1))
        bound[c_ids == q_ids[i]] = -np.inf
        by = np.argsort(-bound, kind="stable")
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(by), STEP):
            floor = max(least[i], scores[-1] if len(scores) == k else -np.inf)
            if bound[by[at]] < floor:
                break
            new = by[at : at + STEP]
            new = new[bound[new] >= floor] if np.isfinite(floor) else new[np.isfinite(bound[new])]
            evaluated[i] += len(new)
            ids = np.concatenate([ids, c_ids[new]])
            scores = np.concatenate([scores, c[new] @ q[i]])
            top = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[top], scores[top]
        out += [(int(q_ids[i]), int(a), int(b)) for a, b in zip(ids, scores, strict=True)]
    return out, evaluated


def _bound(own, squares: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The upper bound of scores from lower bounds of distances; rounding never hides a candidate."""
    return (own + squares - low * low) / 2 + 1e-9 * (own + squares) + 1e-6


def _pivots(x: DataFrame) -> dict[int, np.ndarray]:
    slot = F.pmod(F.xxhash64("v"), F.lit(4 * PIVOTS))
    rows = x.groupBy("dim", slot.alias("slot")).agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    found: dict[int, list] = {}
    for r in rows.orderBy("dim", "slot").limit(4 * PIVOTS * DIMENSIONS).collect():
        mine = found.setdefault(r["dim"], [])
        if len(mine) < PIVOTS:
            mine.append(list(r["v"]))
    return {d: np.array(v, float) for d, v in found.items()}


KEY = ["dim", "cell", "block"]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", with_evaluated: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id, score[, evaluated: how many candidates' scores the query needed]; is_query reads the
    column `id`."""
    x = usable(vectors, id_col, vec_col).withColumns({"dim": F.size("v"), "is_query": F.coalesce(is_query, F.lit(False))})
    pivots = _pivots(x)
    first = F.row_number().over(Window.partitionBy("id").orderBy("v")) == 1
    x = x.filter("NOT is_query").unionByName(x.filter("is_query").withColumn("is_query", first))

    @F.pandas_udf("int")
    def nearest(dim: pd.Series, v: pd.Series) -> pd.Series:
        out = np.zeros(len(v), np.int32)
        for d in dim.unique():
            mine = np.flatnonzero((dim == d).to_numpy())
            if int(d) in pivots:
                out[mine] = _table(np.stack(v.iloc[mine].to_numpy()).astype(float), pivots[int(d)]).argmin(1)
        return pd.Series(out)

    celled = x.withColumn("cell", nearest("dim", "v"))
    sizes = store.small(celled.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), "cells")
    place = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
    placed = store.materialize(celled.join(sizes, ["dim", "cell"]).select("id", "v", "is_query", "dim", "cell", place), "vectors")

    def of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        v = np.stack(pdf["v"].to_numpy())
        return v, pivots.get(v.shape[1], v[:1].astype(float))

    def found(rows: list, q_ids: np.ndarray, evaluated: np.ndarray) -> pd.DataFrame:
        out = pd.DataFrame([(*r, 0) for r in rows] + [(int(q), None, None, int(n)) for q, n in zip(q_ids, evaluated, strict=True)], columns=["query_id", "vec_id", "score", "evaluated"])
        return out.astype({"query_id": "int64", "vec_id": "Int64", "score": "Int64", "evaluated": "int64"})

    def home(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one block: its ranges, and its queries with what they find here and the k-th of it."""
        pdf = pdf.sort_values("id", kind="stable")
        v, own = of(pdf)
        table, squares = _table(v.astype(float), own), (v.astype(float) ** 2).sum(1)
        asks = pdf["is_query"].to_numpy(bool)
        ids = pdf["id"].to_numpy()
        rows, evaluated = best(ids[asks], v[asks], np.full(int(asks.sum()), -np.inf), ids, v, k, own)
        scores: dict[int, list] = {}
        for q, _, score in rows:
            scores.setdefault(q, []).append(score)
        least = np.array([float(scores[q][-1]) if len(scores.get(q, [])) == k else -np.inf for q in ids[asks].tolist()])
        where = [int(pdf[c].iloc[0]) for c in KEY]
        return pd.DataFrame([(*where, float(squares.max()), pack(table.min(0), table.max(0)), pack(ids[asks], squares[asks], least, table[asks].reshape(-1)), pack(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64), evaluated))], columns=[*KEY, "longest", "ranges", "asks", "found"])

    blocks = store.materialize(placed.groupBy(*KEY).applyInPandas(home, "dim int, cell int, block int, longest double, ranges binary, asks binary, found binary"), "blocks")

    def chunked(pdf: pd.DataFrame) -> pd.DataFrame:
        ranges = [unpack(r) for r in pdf["ranges"]]
        blob = pack(pdf["cell"].to_numpy(np.int64), pdf["block"].to_numpy(np.int64), pdf["longest"].to_numpy(float), np.concatenate([r[0] for r in ranges]), np.concatenate([r[1] for r in ranges]))
        return pd.DataFrame([(int(pdf["dim"].iloc[0]), blob)], columns=["dim", "chunk"])

    n_chunks = max(1, -(-blocks.count() // CHUNK))
    chunks = blocks.select("*", F.pmod(F.xxhash64("cell", "block"), F.lit(n_chunks)).alias("part")).groupBy("dim", "part").applyInPandas(chunked, "dim int, chunk binary")

    def needed(frames):
        """Pairs (block of queries, other block) where a query's bound over the other's ranges reaches its k-th score."""
        for pdf in frames:
            out = []
            for dim, cell, block, asks, chunk in pdf.itertuples(index=False):
                ids, own, least, table = unpack(asks)
                if not len(ids):
                    continue
                cells, others, longest, lo, hi = unpack(chunk)
                table, lo, hi = table.reshape(len(ids), -1), lo.reshape(len(cells), -1), hi.reshape(len(cells), -1)
                width = min(table.shape[1], lo.shape[1]) if dim in pivots else 0  # without pivots blocks have no common table
                reached = np.zeros(len(cells), bool)
                for q, square, floor in zip(table[:, :width], own, least, strict=True):
                    low = np.maximum(np.maximum(q - hi[:, :width], lo[:, :width] - q), 0).max(1) if width else np.zeros(len(cells))
                    reached |= _bound(square, longest, low) >= floor
                reached &= (cells != cell) | (others != block)
                out += [(dim, cell, block, int(a), int(b)) for a, b in zip(cells[reached], others[reached], strict=True)]
            yield pd.DataFrame(out, columns=["dim", "qc", "qb", "cell", "block"]).astype("int32")

    salted = blocks.select(*KEY, "asks", F.pmod(F.xxhash64("cell", "block"), F.lit(SALTS)).cast("int").alias("salt"))
    every = chunks.select("dim", "chunk", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    pairs = store.materialize(salted.join(every, ["dim", "salt"]).select(*KEY, "asks", "chunk").mapInPandas(needed, "dim int, qc int, qb int, cell int, block int"), "pairs")
    group = ["dim", "qc", "qb", "cell", "block"]
    asking = placed.filter("is_query").withColumnsRenamed({"cell": "qc", "block": "qb"}).join(pairs, ["dim", "qc", "qb"])
    candidates = store.again(placed).join(store.again(pairs), KEY)
    floors = store.again(blocks).select("dim", F.col("cell").alias("qc"), F.col("block").alias("qb"), "asks").join(store.again(pairs), ["dim", "qc", "qb"])
    left = asking.select(*group, "id", "v", F.lit(None).cast("binary").alias("asks")).unionByName(floors.select(*group, F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<long>").alias("v"), "asks"))

    def away(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        own = queries[queries["id"].notna()]
        if not len(own) or not len(rows):
            return found([], np.zeros(0, np.int64), np.zeros(0, np.int64))
        ids, _, least, _ = unpack(queries["asks"].dropna().iloc[0])
        q_ids = own["id"].to_numpy().astype(np.int64)
        q, (c, pivot) = np.stack(own["v"].to_numpy()), of(rows)
        got, evaluated = best(q_ids, q, least[np.searchsorted(ids, q_ids)], rows["id"].to_numpy(), c, k, pivot)
        return found(got, q_ids, evaluated)

    schema = "query_id long, vec_id long, score long, evaluated long"
    elsewhere = left.groupBy(*group).cogroup(candidates.groupBy(*group)).applyInPandas(away, schema)

    def unpacked(frames):
        for pdf in frames:
            for blob, asks in zip(pdf["found"], pdf["asks"], strict=True):
                q, c, score, evaluated = unpack(blob)
                yield found(list(zip(q.tolist(), c.tolist(), score.tolist(), strict=True)), unpack(asks)[0], evaluated)

    near = blocks.select("found", "asks").mapInPandas(unpacked, schema).unionByName(elsewhere)
    by = Window.partitionBy("query_id")
    ranked = near.withColumn("rank", F.row_number().over(by.orderBy(F.desc_nulls_last("score"), "vec_id")))
    if with_evaluated:
        ranked = ranked.withColumn("evaluated", F.sum("evaluated").over(by))
    out = ranked.filter((F.col("rank") <= k) & F.col("vec_id").isNotNull())
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *["evaluated"] * with_evaluated)


def op4_pivot_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(store.table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
