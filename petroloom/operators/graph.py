"""Pose graphs as tables: edges (i, j, dx, dy, phi, quality), poses (id, x, y, theta)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from petroloom.functions import geometry as g


IN_ONE = 1_000_000  # edges, 16 MB


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets its own."""
    context = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir():
        return named
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="petroloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Ends df's lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_stored: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: made once, and its lineage ends there."""
    spark, at = df.sparkSession, f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(at)
    made = spark.read.schema(df.schema).parquet(at)
    _stored[made] = at
    return made


def kept_with(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, a few expressions over a stored table, to be forgotten with it."""
    _stored[df] = _stored[table]
    return df


def forget(made: DataFrame) -> None:
    """Deletes a stored table. Frames that read it end here."""
    spark, at = made.sparkSession, made.sparkSession._jvm.org.apache.hadoop.fs.Path(_stored[made])
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _reach(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label) of the nodes of all edges, which one task holds."""
    held = [np.stack([c.to_numpy() for c in batch.columns]) for batch in rows]
    if not held:
        return
    ids, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
    i, j = ends.reshape(2, -1)
    label = np.arange(len(ids))
    while True:
        low, new = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["id", "label"])


def components(nodes: DataFrame, edges: DataFrame, most: int = IN_ONE) -> DataFrame:
    """(id, label): the smallest id that each node can reach. Up to `most` edges fit one task. Of more,
    labels move to neighbours and then on to their labels' labels, so rounds grow with the logarithm
    of a path. Labels are the same either way. edges may be near.Near: its hubs get labels by their links and hand
    them to their points."""
    if not isinstance(edges, DataFrame):
        hubs = edges.hubs()
        of = components(hubs.select(F.col("hub").alias("id")).distinct(), edges.links(hubs), most)
        found = hubs.join(of.select(F.col("id").alias("hub"), "label"), "hub").select("id", "label")
        kind = nodes.schema["id"].dataType
        return nodes.select("id").join(found, "id", "left").select("id", F.coalesce(F.col("label").cast(kind), F.col("id")).alias("label"))
    edges = cut(edges.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")))
    if edges.count() <= most:
        found = edges.coalesce(1).mapInArrow(_reach, "id long, label long")
        kind = nodes.schema["id"].dataType
        return nodes.select("id").join(found, "id", "left").select("id", F.coalesce(F.col("label").cast(kind), F.col("id")).alias("label"))
    both = cut(edges.select("i", "j").unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).distinct())
    labels = cut(nodes.select("id", F.col("id").alias("label")))
    while True:
        heard = both.join(labels, both["j"] == labels["id"]).groupBy("i").agg(F.min("label").alias("heard"))
        near = labels.join(heard, labels["id"] == heard["i"], "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("heard", "label")).alias("near"))
        jump = labels.select(F.col("id").alias("near"), F.col("label").alias("far"))
        now = cut(near.join(jump, "near").select("id", "was", F.least("near", "far").alias("label")))
        labels = now.select("id", "label")
        if not now.filter("was != label").limit(1).count():
            return labels


def ranked(labels: DataFrame, least: int = 3) -> DataFrame:
    """(id, label, component): 0 for the largest, 1 and on for others of `least` nodes or more, by size and
    then label; -1 for what is left out."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("size"))
    order = F.desc("size"), F.col("label")
    top = sizes.orderBy(*order).limit(1)
    # only the components that are kept are ordered in one place
    kept = sizes.filter(F.col("size") >= least).unionByName(top.filter(F.col("size") < least))
    kept = kept.withColumn("component", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))
    return labels.join(kept.select("label", "component"), "label", "left").select("id", "label", F.coalesce("component", F.lit(-1)).alias("component"))


def residuals(edges: DataFrame, poses: DataFrame) -> DataFrame:
    a = poses.select(F.col("id").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("theta").alias("at"))
    b = poses.select(F.col("id").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"))
    r = g.residual(F.col("ax"), F.col("ay"), F.col("at"), F.col("bx"), F.col("by"), F.col("dx"), F.col("dy"))
    return edges.join(a, "i").join(b, "j").withColumn("residual", r).drop("ax", "ay", "at", "bx", "by")


def outlier_round(edges: DataFrame, threshold: float) -> DataFrame:
    """Marks edges with residuals beyond the threshold and half the largest; none if none is beyond."""
    most = edges.agg(F.max("residual").alias("most"))  # one row
    return edges.join(F.broadcast(most), F.lit(True)).withColumn("outlier", (F.col("most") > threshold) & (F.col("residual") > F.greatest(F.lit(threshold), F.col("most") / 2))).drop("most")


def frame_quality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean quality and number of the edges at each node."""
    ends = edges.select(F.explode(F.array("i", "j")).alias("id"), "quality")
    mean = ends.groupBy("id").agg(F.avg("quality").alias("quality"), F.count("*").alias("n_links"))
    return nodes.select("id").join(mean, "id", "left").select("id", F.coalesce("quality", F.lit(0.0)).alias("quality"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def status(component: str = "component", merged: dict[int, str] | None = None):
    """The report's word for a component; merged: those for attached ones."""
    c = F.col(component)
    word = F.when(c == 0, "used")
    for k, name in (merged or {}).items():
        word = word.when(c == k, name)
    return word.when(c > 0, "unlinked").otherwise("dropped")


def chain(edges: DataFrame, segment: str) -> DataFrame:
    """Poses along each segment's sequence of edges, from its first node at the origin: running sums,
    each segment in order of its nodes."""
    w = Window.partitionBy(segment).orderBy("j")
    turned = edges.withColumn("theta", F.sum("phi").over(w)).withColumn("_before", F.col("theta") - F.col("phi"))
    x, y = g.rotate(F.col("_before"), F.col("dx"), F.col("dy"))
    turned = turned.withColumn("_x", x).withColumn("_y", y)
    return turned.select(segment, F.col("j").alias("id"), F.sum("_x").over(w).alias("x"), F.sum("_y").over(w).alias("y"), "theta")


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v, back, dx, dy, phi): each edge as it is and, with back = 1, from its end to its start."""
    kept = [F.col(c).cast("double").alias(c) for c in ("dx", "dy", "phi")]
    way = lambda u, v, back: edges.select(F.col(u).alias("u"), F.col(v).alias("v"), F.lit(back).alias("back"), *kept)
    return way("i", "j", 0).unionByName(way("j", "i", 1))


def composed(u: tuple[Column, Column, Column], back: Column, dx: Column, dy: Column, phi: Column) -> tuple[Column, Column, Column]:
    """The pose at the far end of an edge that is walked from pose u."""
    theta = u[2] + F.when(back == 1, -phi).otherwise(phi)
    x, y = g.rotate(F.when(back == 1, theta).otherwise(u[2]), dx, dy)
    sign = F.when(back == 1, -1.0).otherwise(1.0)
    return u[0] + sign * x, u[1] + sign * y, theta


def integrate(nodes: DataFrame, edges: DataFrame, roots: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(id, x, y, theta, level): poses composed breadth first along edges (i, j, dx, dy, phi) of either direction.

    All components are walked at once, from roots (id; by default the smallest id of each), which
    lie at the origin. Of several ways into a node the smallest parent's wins, then the edge as it is before
    one walked backwards, then the smallest edge. A node of known (id, x, y, theta) keeps that pose and hands it
    on. Nodes that no root reaches have no row.

    A round takes one level: neighbours of a level lie in it, before it or after it, so only the last two
    levels are looked at, and every level is written to the shared folder, which ends its lineage.
    There are as many rounds as the graph is deep. edges may be near.Near, which are made anew around each level."""
    spark = nodes.sparkSession
    both = cut(both_ways(edges)) if isinstance(edges, DataFrame) else None
    if roots is None:
        roots = components(nodes, edges).filter("id = label")
    at = f"{shared_folder(spark)}/levels-{uuid.uuid4().hex}"
    schema = "id long, x double, y double, theta double"

    def written(df: DataFrame, level: int) -> DataFrame:
        if known is not None:
            own = known.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(f"_{c}") for c in ("x", "y", "theta")])
            df = df.join(own, "id", "left").select("id", *[F.coalesce(f"_{c}", c).alias(c) for c in ("x", "y", "theta")])
        df.write.parquet(f"{at}/level={level}")
        return spark.read.schema(schema).parquet(f"{at}/level={level}")

    before, level = spark.createDataFrame([], schema), 0
    front = written(roots.select(F.col("id").cast("long").alias("id")).distinct().select("id", *[F.lit(0.0).alias(c) for c in ("x", "y", "theta")]), 0)
    while front.limit(1).count():
        steps = edges.ways(front, before) if both is None else both.join(front, both["u"] == front["id"])
        ways = steps.groupBy(F.col("v").cast("long").alias("v")).agg(F.min(F.struct("u", "back", "dx", "dy", "phi", "x", "y", "theta")).alias("w"))
        met = front.select("id").unionByName(before.select("id"))
        w = lambda c: F.col(f"w.{c}")
        x, y, theta = composed((w("x"), w("y"), w("theta")), w("back"), w("dx"), w("dy"), w("phi"))
        new = ways.join(met, ways["v"] == met["id"], "left_anti").select(F.col("v").alias("id"), x.alias("x"), y.alias("y"), theta.alias("theta"))
        before, level = front, level + 1
        front = written(new, level)
    return spark.read.schema(f"{schema}, level int").parquet(at)


def levelled(poses: DataFrame, key: str) -> DataFrame:
    """Poses (key, id, x, y, theta), each key's turned by its mean angle so that it stands upright."""
    mean = poses.groupBy(key).agg(F.avg("theta").alias("_mean"))
    p = poses.join(mean, key)
    x, y = g.unrotate(F.col("_mean"), F.col("x"), F.col("y"))
    return p.select(key, "id", x.alias("x"), y.alias("y"), (F.col("theta") - F.col("_mean")).alias("theta"))
