"""Radius joins, greedy caps and tiles of the plane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from petroloom.operators.graph import stored


def radius_pairs(points: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """Pairs i < j of points (key, x, y) nearer than radius: an equi-join on grid cells, to nine of
    which a point on the right belongs; no nested loop."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("long")
    around = F.expr("flatten(transform(sequence(-1L, 1L), a -> transform(sequence(-1L, 1L), b -> struct(gx + a AS cx, gy + b AS cy))))")
    a = points.select(F.col(key).alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"), cell("x").alias("cx"), cell("y").alias("cy"))
    b = points.select(F.col(key).alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"), cell("x").alias("gx"), cell("y").alias("gy"))
    b = b.select("j", "xj", "yj", F.explode(around).alias("c")).select("j", "xj", "yj", "c.cx", "c.cy")
    d = F.hypot(F.col("xj") - F.col("xi"), F.col("yj") - F.col("yi"))
    return a.join(b, ["cx", "cy"]).filter(F.col("i") < F.col("j")).withColumn("distance", d).filter(F.col("distance") < radius).select("i", "j", "xi", "yi", "xj", "yj", "distance")


def untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    return pairs.join(tested.select("i", "j"), ["i", "j"], "left_anti")


def capped(pairs: DataFrame, near: int = 2, far: int = 8) -> DataFrame:
    """Pairs (i, j, distance) taken in order of distance while neither end has its fill: `near` of ids at most 3
    apart, `far` of others.

    What is taken depends only on pairs before it that share an end. So in each round every pair is taken that is
    among the first of both its ends that these still have room for, and pairs of full ends go; the nearest
    pair left is always one of those taken. A round is two shuffles by end, and no task holds more than an end's
    pairs."""
    kind = (F.abs(F.col("i") - F.col("j")) <= 3).cast("int")
    left = stored(pairs.select("i", "j", "distance", kind.alias("close")).withColumn("room_i", F.when(F.col("close") == 1, near).otherwise(far)).withColumn("room_j", F.col("room_i")))
    taken = None
    while left.limit(1).count():
        end = lambda e: F.struct(F.col(e).alias("end"), F.col(f"room_{e}").alias("room"))
        ends = left.select("i", "j", "distance", "close", F.explode(F.array(end("i"), end("j"))).alias("e")).select("i", "j", "distance", "close", "e.*")
        place = F.row_number().over(Window.partitionBy("end", "close").orderBy("distance", "i", "j"))
        fits = ends.withColumn("fits", place <= F.col("room")).groupBy("i", "j").agg(F.min("fits").alias("fits"))
        marked = stored(left.join(fits, ["i", "j"]))
        new = marked.filter("fits")
        used = new.select("close", F.explode(F.array("i", "j")).alias("end")).groupBy("end", "close").agg(F.count("*").alias("n"))
        rest = marked.filter("NOT fits").drop("fits")
        for e in "ij":
            rest = rest.join(used.select(F.col("end").alias(e), "close", F.col("n").alias("_n")), [e, "close"], "left").withColumn(f"room_{e}", F.col(f"room_{e}") - F.coalesce("_n", F.lit(0))).drop("_n")
        new = new.select("i", "j", "distance")
        taken = new if taken is None else taken.unionByName(new)
        left = stored(rest.filter("room_i > 0 AND room_j > 0").select("i", "j", "distance", "close", "room_i", "room_j"))
    return pairs.select("i", "j", "distance").limit(0) if taken is None else taken


def covered_tiles(boxes: DataFrame, tile: float) -> DataFrame:
    """A row for each tile that a box (x0, y0, x1, y1; ends exclusive) touches."""
    to = lambda c: F.floor(F.col(c) / tile).cast("long")
    last = lambda c: (F.ceil(F.col(c) / tile) - 1).cast("long")
    return boxes.withColumn("tile_x", F.explode(F.sequence(to("x0"), F.greatest(to("x0"), last("x1"))))).withColumn("tile_y", F.explode(F.sequence(to("y0"), F.greatest(to("y0"), last("y1")))))


def winner(df: DataFrame, cell: list[str], weight: Column, order: str, value: str) -> DataFrame:
    """The value of largest weight in each cell; of equal ones the first in order wins."""
    return df.groupBy(*cell).agg(F.max_by(value, F.struct(weight, -F.col(order))).alias("value"), F.max_by(order, F.struct(weight, -F.col(order))).alias("winner"))


def feather(df: DataFrame, cell: list[str], weight: Column, value: str, power: float = 1.5) -> DataFrame:
    """The mean by weight ** power; 0 where there is no weight."""
    w = F.pow(weight, power)
    return df.groupBy(*cell).agg(F.when(F.sum(w) > 0, F.sum(w * F.col(value)) / F.sum(w)).otherwise(0.0).alias("value"))


def attachable(pairs: DataFrame, key: str, most: int = 12) -> DataFrame:
    """pairs (key, s, m, distance): for each s its nearest m, each m once, the nearest first, `most` for a
    key. Since an s has one m only, an m goes to the nearest s that wants it."""
    nearest = pairs.groupBy(key, "s").agg(F.min(F.struct("distance", "m")).alias("_n")).select(key, "s", "_n.*")
    once = nearest.groupBy(key, "m").agg(F.min(F.struct("distance", "s")).alias("_n")).select(key, "m", "_n.*")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("distance", "m", "s"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= most)


def extents(poses: DataFrame, key: list[str], reach: float) -> DataFrame:
    """Corner and size of the mosaic of each key's poses."""
    low, high = lambda c: F.floor(F.min(c) - reach), lambda c: F.ceil(F.max(c) + reach)
    return poses.groupBy(*key).agg(low("x").alias("x0"), low("y").alias("y0"), (high("x") - low("x") + 1).alias("width"), (high("y") - low("y") + 1).alias("height"))
