"""Exact top-k search by tiled matrix products.

Queries and candidates are dealt by a hash of their ids into blocks of bounded size. A task takes
a tile, one block of queries against one shard of candidates, multiplies them in smaller tiles,
keeps a partial selection of each and emits the best k of the tile for each query. A tree of
merges, by groups of shards, then leaves the best k of all. The query set is stated (every
vector whose id is divisible by `every`) and meets all rows in blocks, so no row is replicated more
often than there are blocks on the other side.

Vectors that are null, or hold null or non-finite components, take no part, and vectors of different
lengths do not meet. Every row is a candidate, repeated rows too; rows with a query's own id are never
its results. Rows that share an id divisible by `every` are one query, whose scores are those of any of them. Scores are exact: products run in doubles while they are below 2^53, else in
whole numbers of any size (held to the range of a long). Ties go to the smaller id. An empty table
gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from petroloom.llm import shared

K, EVERY, SCALE = 10, 100, 1024.0
BLOCK = 32_768  # vectors of a block of queries or a shard of candidates, about
TILE_Q, TILE_C = 256, 4096
FAN_IN = 16
FOUND = "query_id long, vec_id long, score long, shard int"


def _unpack(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and whole-number vectors, by id."""
    pdf = pdf.sort_values("vec_id", kind="stable")
    if not len(pdf):
        return np.zeros(0, np.int64), np.zeros((0, 0))
    return pdf["vec_id"].to_numpy(np.int64), np.stack([np.asarray(x, np.float64) for x in pdf["v"]])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row, best first; columns are in order of id, so a tie goes to
    the first."""
    if scores.shape[1] > k and scores.dtype != object:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        some = np.flatnonzero((scores >= kth).any(axis=0))  # all that reach any row's k-th score
        order = np.argsort(-scores[:, some], axis=1, kind="stable")[:, :k]
        return some[order]
    return np.argsort(-scores, axis=1, kind="stable")[:, :k] if scores.dtype != object else np.array([sorted(range(scores.shape[1]), key=lambda j, r=r: (-r[j], ids[j]))[:k] for r in scores])


def tile_top(queries: pd.DataFrame, shard: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best k of a shard (vec_id, v) for each of a block of queries."""
    out = []
    for dim, some in queries.groupby(queries["v"].map(len)):
        q_ids, q = _unpack(some)
        c_ids, c = _unpack(shard[shard["v"].map(len) == dim])
        if not len(c_ids):
            continue
        exact = dim * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) < 2**53
        for i in range(0, len(q_ids), TILE_Q):
            top_ids, top = np.zeros((len(q_ids[i : i + TILE_Q]), 0), np.int64), None
            for j in range(0, len(c_ids), TILE_C):
                a, b, ids = q[i : i + TILE_Q], c[j : j + TILE_C], c_ids[j : j + TILE_C]
                if exact:
                    s = a @ b.T
                    own = q_ids[i : i + TILE_Q, None] == ids[None, :]
                    s[own] = -np.inf
                else:
                    whole = [[int(x) for x in row] for row in b]
                    s = np.array([[None if qi == ci else max(-(2**63) + 1, min(2**63 - 1, sum(int(x) * y for x, y in zip(row, w, strict=True)))) for w, ci in zip(whole, ids, strict=True)] for row, qi in zip(a, q_ids[i : i + TILE_Q], strict=True)], object)
                    s[s == None] = -math.inf  # noqa: E711
                at = _best(s, ids, k)
                now_ids, now = ids[at], np.take_along_axis(s, at, axis=1)
                top_ids, top = np.concatenate([top_ids, now_ids], axis=1), now if top is None else np.concatenate([top, now], axis=1)
                at = np.argsort(-top, axis=1, kind="stable")[:, :k]  # earlier tiles hold smaller ids
                top_ids, top = np.take_along_axis(top_ids, at, axis=1), np.take_along_axis(top, at, axis=1)
            rows = np.repeat(q_ids[i : i + TILE_Q], top.shape[1])
            flat = top.ravel()
            real = np.array([x != -math.inf for x in flat], bool)
            out.append(pd.DataFrame({"query_id": rows[real], "vec_id": top_ids.ravel()[real], "score": [int(x) for x in flat[real]]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """vectors: (vec_id long, v array<double> of whole numbers). Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    queries = vectors.filter(F.col("vec_id") % every == 0)
    n, n_queries = vectors.count(), queries.count()
    shards = max(-(-n // block), min(2 * shared.part_count(spark), -(-n // 1024)), 1)
    blocks = max(1, -(-n_queries // block))
    deal = lambda m, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(m)).cast("int")
    left = queries.select("vec_id", "v", F.lit(True).alias("asks"), deal(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = vectors.select("vec_id", "v", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), deal(shards, 2).alias("shard"))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        return tile_top(pdf[pdf["asks"]], pdf[~pdf["asks"]], k).assign(shard=pdf["shard"].iloc[0])

    found = left.unionByName(right).groupBy("block", "shard").applyInPandas(tile, FOUND)
    best = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
    while shards > FAN_IN:
        shards = -(-shards // FAN_IN)
        found = best(found.withColumn("shard", (F.col("shard") / FAN_IN).cast("int")), "query_id", "shard").drop("rank")
    return best(found, "query_id").select("query_id", "rank", "vec_id", "score")


def whole_vectors(embeddings: DataFrame, scale: float = SCALE, more: list[str] = ()) -> DataFrame:
    """embeddings (vec_id, embedding): (vec_id, v), v the components times `scale`, rounded down, and the columns
    of `more`. Null ids, and vectors that are null or hold null or non-finite components, take no part."""
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return embeddings.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"), *more)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors, by inner product of scaled whole numbers, for every
    hundredth id."""
    return top_k(whole_vectors(shared.table(spark, sf_dir, "embeddings")))


SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) for x in embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
