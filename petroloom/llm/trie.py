"""A prefix trie over conversations, with sums over subtrees by heavy-path decomposition.

Every conversation is rebuilt: it takes the first turns of the head of its hundred, then goes on with its
own. Each distinct beginning of a rebuilt conversation is a node; two conversations share a node if
their first turns are alike in role and text.

A node is named by the exclusive or of 128-bit hashes of its turns and their depths, so names come from a
running sum along each conversation, which a range shuffle deals over the cluster: no conversation is
held by one task. Per node, counts are aggregated before they are shuffled, so a node that most
conversations pass (the root; a common first turn) costs what others do.

Sums over subtrees (leaves, saved tokens): each node's largest child by conversations continues its
path, the smaller id among equals; the other children begin paths of their own. A path is an array of
nodes from its head down to a leaf. By rounds, the lowest light paths first, each path's total is
attached to the node its head hangs on; a light child has at most half of its parent's
conversations, so there are at most log2(conversations) rounds. One running sum from every path's leaf
upwards then gives the sums of all subtrees.

A node's digest needs its members' ids in one order and SHA-256 reads them one after another: ids are
sorted by a range shuffle, each partition joins its part of a node's ids to one text, and a task streams a
node's parts, so it holds one part at a time.

Nulls: rows with a null conv_id take no part; null turns come first; a null role or text is empty. Ties
of turn go by the SHA-256 of role and text. Repeated rows are turns of their own. An empty
table gives no rows, not even a root. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from petroloom.llm import shared

HUNDRED, MOST_SHARED = 100, 6  # conversations of a head; a conversation takes fewer turns than this from it


def _head_turns() -> Column:
    return (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("long")


def _parted(name: str) -> list[Column]:
    """Two longs of a hexadecimal digest."""
    return [F.conv(F.substring(name, 1 + 16 * k, 16), 16, -10).cast("long").alias(f"h{k}") for k in (0, 1)]


def _node() -> Column:
    return F.concat(F.lpad(F.hex("a"), 16, "0"), F.lpad(F.hex("b"), 16, "0"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, n_chars): a row for each turn of each rebuilt conversation, and one of
    depth 0 for each conversation."""
    role, text = (shared.empty_if_null(c) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("n_chars"), F.lit(1).cast("long").alias("one"))
    own = shared.running_by_key(shared.materialize(turns, "turns"), "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest").asc()], ["one"], label="own")
    own = shared.materialize(own.select("conv_id", F.col("one_run").alias("at"), *_parted("digest"), "n_chars"), "own")
    convs = shared.materialize(own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", _head_turns()).withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED), "convs")
    held = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base"))
    convs = shared.materialize(convs.join(held, "base", "left").withColumn("taken", F.least("h", F.coalesce("of_base", F.lit(0)))).select("conv_id", "n", "h", "base", "taken"), "convs")
    first = own.filter((F.col("at") < MOST_SHARED) & (F.col("conv_id") % HUNDRED == 0)).withColumnRenamed("conv_id", "base")
    heads = convs.filter("taken > 0").join(first, "base").filter(F.col("at") <= F.col("taken")).select("conv_id", F.col("at").alias("depth"), "h0", "h1", "n_chars")
    hot = shared.hot_keys(convs, "conv_id", own.count())
    rest = own.filter(F.col("at") > _head_turns())
    rest = shared.hot_join(rest, convs.select("conv_id", "h", "taken"), "conv_id", hot).select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "h0", "h1", "n_chars")
    none = [F.lit(0).cast("long").alias(c) for c in ("depth", "a", "b", "n_chars")]
    mixed = lambda seed, c: F.xxhash64(F.lit(seed), "depth", c)
    every = heads.unionByName(rest).select("conv_id", "depth", mixed(1, "h0").alias("a"), mixed(2, "h1").alias("b"), "n_chars").unionByName(convs.select("conv_id", *none))
    named = shared.running_by_key(shared.materialize(every, "rebuilt"), "conv_id", [F.col("depth").asc()], [], ["a", "b"], "named")
    before = F.when(F.col("depth") > 0, F.struct(F.col("a_run").bitwiseXOR(F.col("a")).alias("a"), F.col("b_run").bitwiseXOR(F.col("b")).alias("b")))
    pair = named.select("conv_id", "depth", "n_chars", F.col("a_run").alias("a"), F.col("b_run").alias("b"), before.alias("p"))
    pair = pair.withColumn("node", _node()).withColumn("a", F.col("p.a")).withColumn("b", F.col("p.b"))
    return shared.materialize(pair.select("conv_id", "depth", "node", _node().alias("parent"), "n_chars"), "named")


def nodes_of(rows: DataFrame) -> tuple[DataFrame, list]:
    """A row for each node of rebuilt(): node, parent, depth, conv_id (its smallest member), n_convs, n_children,
    heavy (it continues its parent's path), saved (by the node alone); and the names of nodes with very many children."""
    nodes = rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("n_chars").alias("n_chars"))
    nodes = shared.materialize(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_chars")).drop("n_chars"), "nodes")
    children = shared.materialize(nodes.filter("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"), F.max_by("node", F.struct("n_convs", -F.col("conv_id"))).alias("next")), "children")
    hot = shared.hot_keys(children.select("parent", F.col("n_children").alias("n")), "parent", nodes.count())
    both = nodes.join(children.select(F.col("parent").alias("node"), "n_children"), "node", "left")
    both = both.join(children.select(F.col("next").alias("node"), F.lit(True).alias("heavy")), "node", "left")
    return shared.materialize(both.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn("heavy", F.coalesce("heavy", F.lit(False))), "nodes"), hot


def heavy_paths(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, depth, node, parent, heavy, leaf, saved), a row for each node, where a path is named after the
    smallest conversation that ends in its leaf; and (path, level): how many light nodes lie from the root to
    its leaf. From the leaf upwards a path ends with its first light node, or the root."""
    hot = shared.hot_keys(nodes.select("node", F.col("n_convs").alias("n")), "node", rows.count())
    known = nodes.select("node", F.col("conv_id").alias("smallest"), (~F.col("heavy")).cast("long").alias("light"), (F.col("n_children") == 0).cast("long").alias("leaf"), "saved")
    on = shared.hot_join(rows.select("conv_id", "depth", "node", "parent"), known, "node", hot)
    on = on.withColumn("own", F.col("leaf") * (F.col("smallest") == F.col("conv_id")).cast("long")).drop("smallest")
    up = shared.running_by_key(shared.materialize(on, "along"), "conv_id", [F.col("depth").desc()], ["light", "own"], label="up").filter("own_run = 1")
    up = shared.materialize(up.withColumnRenamed("conv_id", "path"), "up")
    members = up.filter("light_run = light").select("path", "depth", "node", "parent", "light", "leaf", "saved")
    return members, up.filter("depth = 0").select("path", F.col("light_run").alias("level"))


def subtree_sums(members: DataFrame, levels: DataFrame, hot: list) -> DataFrame:
    """(node, n_leaves, saved_tokens) over each node's subtree."""
    own = members.groupBy("path").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"), F.max(F.when(F.col("light") == 1, F.col("parent"))).alias("parent"))
    at = members.select(F.col("node").alias("parent"), F.col("path").alias("above"))
    paths = shared.materialize(own.join(levels, "path"), "paths")
    hung = shared.hot_join(paths.filter("parent IS NOT NULL"), at, "parent", hot)
    paths = shared.materialize(hung.unionByName(paths.filter("parent IS NULL").withColumn("above", F.lit(None).cast("long"))), "paths")
    done, below = [], None
    for level in range(paths.agg(F.max("level")).first()[0] or 0, 0, -1):
        now = paths.filter(F.col("level") == level).select("path", "parent", "above", "leaves", "saved")
        if below is not None:
            more = below.groupBy("above").agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s")).withColumnRenamed("above", "path")
            now = now.join(more, "path", "left").select("path", "parent", "above", (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"))
        below = shared.materialize(now, "level")
        done.append(below)
    whole = members.select("path", "depth", "node", F.col("leaf").alias("leaves"), "saved")
    if done:
        light = done[0]
        for d in done[1:]:
            light = light.unionByName(d)
        added = light.filter("parent IS NOT NULL").groupBy("parent").agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s")).withColumnRenamed("parent", "node")
        whole = whole.join(added, "node", "left").select("path", "depth", "node", (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"))
    along = shared.running_by_key(shared.materialize(whole, "whole"), "path", [F.col("depth").desc()], ["leaves", "saved"], label="sums")
    return along.select("node", F.col("leaves_run").alias("n_leaves"), F.col("saved_run").alias("saved_tokens"))


def end_digests(rows: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of the ids of the conversations that end in a node, ascending, joined by commas."""
    from pyspark import TaskContext

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, node, ids = TaskContext.get().partitionId(), None, []
        made = lambda: pa.RecordBatch.from_arrays([pa.array([node]), pa.array([part], pa.int32()), pa.array([",".join(ids)])], names=["node", "part", "ids"])
        for batch in batches:
            for name, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != node and ids:
                    yield made()
                    ids = []
                node = name
                ids.append(str(conv))
        if ids:
            yield made()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        made = lambda: pa.RecordBatch.from_arrays([pa.array([node]), pa.array([sha.hexdigest()])], names=["node", "ends"])
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if sha and name == node:
                    sha.update(f",{ids}".encode())
                    continue
                if sha:
                    yield made()
                node, sha = name, hashlib.sha256(ids.encode())
        if sha:
            yield made()

    ends = shared.materialize(rows.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node")).select("node", "conv_id"), "ends")
    parts = shared.part_count(rows.sparkSession)
    texts = shared.materialize(ends.repartitionByRange(parts, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(shared.lean(join_up), "node string, part int, ids string"), "ids")
    dealt = texts.repartition(parts, "node").sortWithinPartitions("node", "part").select("node", "ids")
    return dealt.mapInArrow(shared.lean(digest), "node string, ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text): a row for each node."""
    with shared.working(conversations.sparkSession):
        rows = rebuilt(conversations)
        nodes, hot = nodes_of(rows)
        sums = subtree_sums(*heavy_paths(rows, nodes), hot)
        above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        with_parent = shared.hot_join(nodes.filter("parent IS NOT NULL"), above, "parent", hot)
        with_parent = with_parent.unionByName(nodes.filter("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
        out = with_parent.join(sums, "node").join(end_digests(rows), "node", "left")
        none = hashlib.sha256(b"").hexdigest()
        return shared.materialize(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(none)).alias("ends_sha256")), "trie", hold=True)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(shared.table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (SELECT conv_id, coalesce(text, '') AS x, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS s, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, s, length(x) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, s) AS k FROM t),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base FROM own),
crc AS (SELECT conv_id, base, xor(list_reduce([CAST(v AS BIGINT) for v in flatten([[ord(b), 0, 0, 0, 0, 0, 0, 0] for b in string_split(CAST(conv_id AS VARCHAR), '')])],
        lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1)), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 6 AS h FROM c),
r AS (SELECT crc.conv_id, 0 AS part, o.k, o.s, o.chars FROM crc JOIN own o ON o.conv_id = crc.base AND o.k <= crc.h
      UNION ALL SELECT o.conv_id, 1, o.k, o.s, o.chars FROM crc JOIN own o USING (conv_id) WHERE o.k > crc.h),
d AS (SELECT conv_id, s, chars, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth FROM r),
p AS (SELECT conv_id, depth, chars, list(s) OVER (PARTITION BY conv_id ORDER BY depth) AS seq FROM d UNION ALL SELECT conv_id, 0, 0, [] FROM crc),
m AS (SELECT conv_id, depth, chars, min(conv_id) OVER (PARTITION BY depth, seq) AS node FROM p),
up AS (SELECT a.node, a.depth, any_value(a.chars) AS chars, count(*) AS n_convs, min(b.node) AS parent FROM m a LEFT JOIN m b ON b.conv_id = a.conv_id AND b.depth = a.depth - 1 GROUP BY a.node, a.depth),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM up WHERE depth > 0 GROUP BY parent, depth),
n AS (SELECT up.*, coalesce(kids.n, 0) AS n_children FROM up LEFT JOIN kids USING (node, depth)),
sums AS (SELECT m.node, m.depth, sum(CASE WHEN n.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
         FROM n JOIN m ON m.conv_id = n.node AND m.depth <= n.depth GROUP BY m.node, m.depth),
ends AS (SELECT node, depth, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS digest FROM m
         WHERE depth = (SELECT max(depth) FROM m x WHERE x.conv_id = m.conv_id) GROUP BY node, depth)
SELECT n.node AS conv_id, CAST(n.depth AS BIGINT) AS depth, n.parent AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children, CAST(sums.n_leaves AS BIGINT) AS n_leaves,
       CAST(sums.saved AS BIGINT) AS saved_tokens, coalesce(ends.digest, sha256('')) AS ends_sha256
FROM n JOIN sums USING (node, depth) LEFT JOIN ends USING (node, depth)
"""
