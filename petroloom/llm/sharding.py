"""Sharding by a k-d tree over document metadata.

A node that is to become m shards is split in two, for m // 2 and m - m // 2 of them, where the
running sum of sizes along its widest dimension reaches that share: a weighted median, or a
weighted third for three. All nodes of a level are split together, by one sort of the (small)
metadata table over the whole cluster. Rows with the same value in that dimension are told apart
by a hash of their id, so that a value that a third of all rows share can be cut anywhere.

`shards` fixes how many leaves there are; given target_bytes instead, there are as many as make
each leaf reach that size or less. The law that holds is `bytes`: leaves differ by about one
document for each level.

Nulls: a null text has no bytes; null metadata sorts first. Repeated rows, equal ids included,
are placed as rows of their own. An empty table gives no rows. Columns of the input other than
those named play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from petroloom.llm import shared

SHARDS = 24
#: The order of a string's first six bytes, as a number.
_ORDER = "cast(conv(rpad(substr(hex(cast({0} AS binary)), 1, 12), 12, '0'), 16, 10) AS double)"
#: Metadata dimensions: a number for each row, as SQL over the input's columns.
DIMENSIONS = {"d_bytes": "log2(size)", "d_source": _ORDER.format("source"), "d_lang": _ORDER.format("lang"), "d_id": "doc_id"}


def _widest(nodes: DataFrame, dims: list[str]) -> dict[int, str]:
    """The dimension with the largest spread for each node, by standard deviation over the whole
    table's, so that units do not matter."""
    spread = lambda: [F.stddev_pop(d).alias(d) for d in dims]
    whole = nodes.agg(*spread()).first()
    out = {}
    for r in nodes.groupBy("_node").agg(*spread()).collect():  # a row for each node: as many as shards
        out[r["_node"]] = max(dims, key=lambda d: ((r[d] or 0.0) / whole[d] if whole[d] else 0.0, -dims.index(d)))
    return out


def kd_shards(rows: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, dimensions: dict[str, str] = DIMENSIONS) -> DataFrame:
    """rows: (doc_id, size, ...and the columns that dimensions name). Adds shard (0 on) and slot
    (0 on within each shard, without gaps), in place of columns of these names."""
    dims = [f"_d{k}" for k in range(len(dimensions))]
    rows = rows.drop("shard", "slot")
    along = {d: F.coalesce(F.expr(e).cast("double"), F.lit(-1.0)) for d, e in zip(dims, dimensions.values(), strict=True)}
    frame, back = shared.set_aside(rows, ["doc_id", "size"], **along)
    extra = [c for c in frame.columns if c not in dims]
    with shared.working(rows.sparkSession):
        leaves = _leaves(frame, dims, shards, target_bytes).select(*extra, "_tie", "shard", F.lit(1).cast("long").alias("_one"))
        ranked, _ = shared.running_totals(shared.materialize(leaves, "kd"), ["shard", "_tie", "doc_id"], "_one", "kd")
        firsts = ranked.groupBy("shard").agg(F.min("_before").alias("_first"))  # a row for each shard
        placed = shared.materialize(ranked.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("_before") - F.col("_first")), "sharded", hold=True)
    return back(placed, "shard", "slot")


def _leaves(frame: DataFrame, dims: list[str], shards: int | None, target_bytes: int | None) -> DataFrame:
    """frame with its shard."""
    table = frame.sparkSession.createDataFrame  # of a row for each node: as many as shards
    extra = [c for c in frame.columns if c not in dims]
    nodes = shared.materialize(frame.select(*extra, *dims, F.xxhash64("doc_id", "size").alias("_tie"), F.lit(0).alias("_node")), "kd")
    if shards is None:
        total = nodes.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // max(1, target_bytes or 1)))
    parts = {0: shards}  # node: the shards it becomes
    while any(m > 1 for m in parts.values()):
        widest = _widest(nodes, dims)
        along = table([(node, dims.index(d) + 1) for node, d in widest.items()], "_node int, _d int")
        keyed = nodes.join(F.broadcast(along), "_node").withColumn("_along", F.element_at(F.array(*dims), F.col("_d"))).drop("_d")
        ordered, _ = shared.running_totals(shared.materialize(keyed, "kd"), ["_node", "_along", "_tie", "doc_id"], "size", "kd")
        sums = {r["_node"]: (r["first"], r["total"]) for r in ordered.groupBy("_node").agg(F.min("_before").alias("first"), F.sum("size").alias("total")).collect()}
        cuts, after = [], {}
        for node, m in parts.items():
            first, total = sums.get(node, (0, 0))
            cuts.append((node, float(first + total * (m // 2) / m) if m > 1 else float("inf")))
            after |= {2 * node + 1: max(1, m // 2)} | ({2 * node + 2: m - m // 2} if m > 1 else {})
        # the middle of a row decides on which side of the cut it lies
        side = F.when(F.col("_before") + F.col("size") / 2 < F.col("_cut"), 1).otherwise(2)
        cut = ordered.join(F.broadcast(table(cuts, "_node int, _cut double")), "_node").withColumn("_node", (2 * F.col("_node") + side).cast("int"))
        nodes, parts = shared.materialize(cut.drop("_before", "_along", "_cut"), "kd"), after
    named = table([(node, k) for k, node in enumerate(sorted(parts))], "_node int, shard int")
    return nodes.join(F.broadcast(named), "_node")


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    text = shared.empty_if_null().cast("binary")
    rows = shared.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return kd_shards(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
