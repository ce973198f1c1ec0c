"""Hard-negative mining by ball trees.

Candidates are dealt into shards of bounded size and anchors into blocks. A task takes a tile, one block
against one shard; it builds a ball tree over the shard and searches it by branch and bound. A ball with
centre c and radius r bounds the inner product of a vector q with all it holds: q.c - |q| r below and
q.c + |q| r above. The first pass finds each anchor's best rows of its own label and leaves out balls
without that label or with an upper bound strictly beneath the anchor's k-th score. The second finds, for
each anchor and positive, the best rows of other labels whose score lies in the positive's window, and
leaves out balls that lie beside the window as well. What shards have found is merged by rank, by groups of
shards. All anchors of a block descend together, so a leaf is one matrix product.

Scores are exact: products run in doubles while they are below 2^53, else in whole numbers of any
size, without a tree (held to the range of a long). Ties go to the smaller id.

Rows with a null id, label or vector, or with null or non-finite components, take no part, and vectors of
different lengths do not meet. Repeated rows are candidates each, and a positive that occurs twice is two
positives; rows with an anchor's own id are never its results. Rows that share an anchor's id are one
anchor: that with the smallest label, then the smallest vector. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from petroloom.llm import shared, topk

SCALE, EVERY, POSITIVES, NEGATIVES = 256.0, 50, 5, 3
LOW, HIGH = 50, 95  # hundredths of the positive's score
BLOCK = 32_768  # candidates of a shard and anchors of a block, about
LEAF, TOGETHER = 256, 512  # vectors of a leaf; anchors that descend together
FOUND = "anchor_id long, place int, id long, score long, shard int"


class BallTree:
    """Nodes of a tree over rows of v; children of node k are 2 k + 1 and 2 k + 2. A row goes to the nearer of two
    rows that lie far apart; where that leaves less than a tenth on one side, rows are halved in their order
    between the two, so equal rows may lie on both sides and the depth stays logarithmic."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, leaf: int = LEAF) -> None:
        self.ids, self.labels, self.v = ids, labels, v
        self.names = np.unique(labels)
        self.rows: dict[int, np.ndarray] = {}  # of leaves, by id
        self.centre: dict[int, np.ndarray] = {}
        self.radius: dict[int, float] = {}
        self.has: dict[int, np.ndarray] = {}  # of self.names
        waiting = [(0, np.arange(len(ids)))]
        while waiting:
            node, at = waiting.pop()
            some = v[at]
            centre = some.mean(axis=0)
            # a little more than the rows need, since bounds are made in doubles
            self.centre[node], self.radius[node] = centre, float(np.sqrt(((some - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-6
            self.has[node] = np.isin(self.names, labels[at])
            if len(at) <= leaf:
                self.rows[node] = at[np.argsort(ids[at], kind="stable")]
                continue
            one = some[int(np.argmax(((some - centre) ** 2).sum(axis=1)))]
            two = some[int(np.argmax(((some - one) ** 2).sum(axis=1)))]
            along = some @ (two - one)
            near = along <= ((one + two) / 2) @ (two - one)
            if not 0.1 <= near.mean() <= 0.9:
                near = np.zeros(len(at), bool)
                near[np.argpartition(along, len(at) // 2)[: len(at) // 2]] = True
            waiting += [(2 * node + 1, at[near]), (2 * node + 2, at[~near])]

    def bounds(self, node: int, q: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        middle, off = q @ self.centre[node], length * self.radius[node]
        off = off + 1e-9 * np.abs(middle) + 1e-3
        return middle - off, middle + off


def merged(best: tuple[np.ndarray, np.ndarray], ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) of each row from those held and from scores, whose columns belong to ids, in
    order; -inf marks what is none."""
    at = topk._best(scores, ids, k)
    s, i = np.concatenate([best[0], np.take_along_axis(scores, at, axis=1)], axis=1), np.concatenate([best[1], ids[at]], axis=1)
    order = np.lexsort((i, -s), axis=-1)[:, :k]
    return np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)


def search(tree: BallTree, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, windows: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) for each anchor and window: of its own label if windows is None, else of
    other labels with low <= score <= high for each (low, high) of windows, shaped (anchors, windows, 2)."""
    n, m = len(ids), 1 if windows is None else windows.shape[1]
    scores, found = np.full((n, m, k), -np.inf), np.full((n, m, k), np.iinfo(np.int64).max)
    length = np.sqrt((q**2).sum(axis=1))
    own = tree.names[None, :] == labels[:, None]
    low, high = (np.full((n, 1), x) for x in (-np.inf, np.inf)) if windows is None else (windows[:, :, 0], windows[:, :, 1])
    waiting = [(0, np.arange(n))]
    while waiting:
        node, some = waiting.pop()
        there = tree.has[node][None, :]
        fits = (own[some] & there).any(axis=1) if windows is None else (~own[some] & there).any(axis=1)
        some = some[fits]
        below, above = tree.bounds(node, q[some], length[some])
        # outside the window, or strictly beneath the k-th score
        open_ = (above[:, None] >= low[some]) & (below[:, None] <= high[some]) & (above[:, None] >= scores[some, :, k - 1])
        some = some[open_.any(axis=1)]
        if not len(some):
            continue
        if node not in tree.rows:
            near = np.argsort([(q[some] @ tree.centre[c]).sum() for c in (2 * node + 1, 2 * node + 2)])
            waiting += [(2 * node + 1 + int(c), some) for c in near]  # the more promising one is taken first
            continue
        at = tree.rows[node]
        s = q[some] @ tree.v[at].T
        same = tree.labels[at][None, :] == labels[some][:, None]
        good = (same if windows is None else ~same) & (tree.ids[at][None, :] != ids[some][:, None])
        for w in range(m):
            inside = good & (s >= low[some, w, None]) & (s <= high[some, w, None])
            rows = np.flatnonzero(inside.any(axis=1))
            if len(rows):
                to = some[rows]
                scores[to, w], found[to, w] = merged((scores[to, w], found[to, w]), tree.ids[at], np.where(inside[rows], s[rows], -np.inf), k)
    return scores, found


def _plain(pdf: pd.DataFrame, anchors: pd.DataFrame, k: int) -> Iterator[tuple[int, int, int, int]]:
    """As search(), in whole numbers of any size, for components beyond what doubles hold."""
    whole = [[int(x) for x in v] for v in pdf["v"]]
    for a in anchors.itertuples(index=False):
        q = [int(x) for x in a.v]
        scored = [(max(-(2**63) + 1, min(2**63 - 1, sum(x * y for x, y in zip(q, v, strict=True)))), int(i), label) for v, i, label in zip(whole, pdf["vec_id"], pdf["label"], strict=True) if i != a.vec_id]
        windows = [None] if a.windows is None else [(int(w["low"]), int(w["high"])) for w in a.windows]
        for place, w in enumerate(windows):
            fit = [(-s, i) for s, i, label in scored if (label == a.label if w is None else label != a.label and w[0] <= s <= w[1])]
            for s, i in sorted(fit)[:k]:
                yield int(a.vec_id), place, i, -s


def tile(pdf: pd.DataFrame, anchors: pd.DataFrame, k: int) -> pd.DataFrame:
    """What a shard (vec_id, label, v) has for a block of anchors (vec_id, label, v, windows or null)."""
    out: list[tuple[np.ndarray, ...]] = []
    for dim, some in anchors.groupby(anchors["v"].map(len)):
        here = pdf[pdf["v"].map(len) == dim]
        if not len(here) or not dim:
            continue
        v, q = (np.stack([np.asarray(x, np.float64) for x in f["v"]]) for f in (here, some))
        if dim * float(np.abs(q).max()) * float(np.abs(v).max()) >= 2**53:
            made = list(_plain(here, some, k))
            out.append(tuple(np.array([r[c] for r in made], np.int64) for c in range(4)))
            continue
        tree = BallTree(here["vec_id"].to_numpy(np.int64), here["label"].to_numpy(np.int64), v)
        ids, labels = some["vec_id"].to_numpy(np.int64), some["label"].to_numpy(np.int64)
        windows = None
        if some["windows"].notna().all():
            most = max(len(w) for w in some["windows"])
            windows = np.full((len(some), most, 2), [np.inf, -np.inf])
            for a, held in enumerate(some["windows"]):
                for w, x in enumerate(held):
                    windows[a, w] = x["low"], x["high"]
        order = np.argsort(q @ q.mean(axis=0), kind="stable")  # anchors alike descend together
        for a in range(0, len(order), TOGETHER):
            at = order[a : a + TOGETHER]
            s, i = search(tree, ids[at], labels[at], q[at], None if windows is None else windows[at], k)
            r, place, n = np.nonzero(s > -np.inf)
            out.append((ids[at][r], place, i[r, place, n], s[r, place, n].astype(np.int64)))
    cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out, strict=True) if out else [()] * 4)]
    return pd.DataFrame(dict(zip(("anchor_id", "place", "id", "score"), cols, strict=True)))


def best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def pass_over(vectors: DataFrame, anchors: DataFrame, shards: int, blocks: int, k: int) -> DataFrame:
    """(anchor_id, place, id, score, rank): the best k for each anchor and window over all shards."""
    windows = "array<struct<low:bigint,high:bigint>>"
    block = lambda: F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(blocks)).cast("int").alias("block")
    left = anchors.select("vec_id", "label", "v", "windows", F.lit(True).alias("asks"), block(), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = vectors.select("vec_id", "label", "v", F.lit(None).cast(windows).alias("windows"), F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return tile(pdf[~pdf["asks"]], pdf[pdf["asks"]], k).assign(shard=pdf["shard"].iloc[0])

    found = left.unionByName(right).groupBy("block", "shard").applyInPandas(run, FOUND)
    while shards > topk.FAN_IN:
        shards = -(-shards // topk.FAN_IN)
        found = best(found.withColumn("shard", (F.col("shard") / topk.FAN_IN).cast("int")), ["anchor_id", "place", "shard"], k).drop("rank")
    return best(found, ["anchor_id", "place"], k)


def mine(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """vectors: (vec_id long, label long, v array<double> of whole numbers). Returns anchor_id, positive_id,
    rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    with shared.working(spark):
        vectors = shared.materialize(vectors.select("vec_id", "label", "v"), "vectors")
        n = vectors.count()
        shards = max(-(-n // block), min(2 * shared.part_count(spark), -(-n // 1024)), 1)
        # an id's repeats are told apart by their place, so they too are dealt over all shards
        deal = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int")
        dealt = shared.materialize(vectors.withColumn("shard", deal), "dealt")
        anchors = shared.materialize(vectors.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v"), "anchors")
        blocks = max(1, -(-anchors.count() // block))
        none = F.lit(None).cast("array<struct<low:bigint,high:bigint>>")
        near = shared.materialize(pass_over(dealt, anchors.withColumn("windows", none), shards, blocks, positives), "positives")
        # the window in whole numbers: 100 negative >= low positive and 100 negative <= high positive
        share = lambda of: F.col("score").cast("decimal(20,0)") * F.lit(of).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")
        asked = near.select("anchor_id", F.col("rank").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.ceil(share(low)).cast("long").alias("low"), F.floor(share(high)).cast("long").alias("high"))
        windows = asked.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("w"))  # `positives` of each
        windows = windows.select(F.col("anchor_id").alias("vec_id"), F.transform("w", lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"))).alias("windows"))
        found = pass_over(dealt, anchors.join(windows, "vec_id"), shards, blocks, negatives)
        named = asked.select("anchor_id", (F.col("place") - 1).alias("place"), "positive_id", "positive_score")
        out = found.join(named, ["anchor_id", "place"])
        return shared.materialize(out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard", hold=True)


def labelled_vectors(embeddings: DataFrame, scale: float = SCALE) -> DataFrame:
    """embeddings (vec_id, embedding, label): (vec_id, label, v), where every seventh id has the next of ten
    labels. Rows that take no part are left out."""
    whole = topk.whole_vectors(embeddings.filter("label IS NOT NULL").select("vec_id", "embedding", F.col("label").cast("long").alias("label")), scale, ["label"])
    return whole.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector."""
    return mine(labelled_vectors(shared.table(spark, sf_dir, "embeddings")))


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score QUALIFY rank <= 3
"""
