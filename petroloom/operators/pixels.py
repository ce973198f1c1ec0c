"""Small images as arrays of pixels, row by row: what the kernels of fields of view, sharpness and flat
fields do, as column expressions and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def exploded(frames: DataFrame, image: str, width: int, *keys: str) -> DataFrame:
    """(keys, px, py, level): a row for each pixel."""
    at = frames.select(*keys, F.posexplode(image).alias("_k", "level"))
    return at.select(*keys, (F.col("_k") % width).alias("px"), F.floor(F.col("_k") / width).cast("int").alias("py"), F.col("level").cast("double").alias("level"))


def brightest(pixels: DataFrame, *keys: str) -> DataFrame:
    """The largest level of each pixel over all frames of a key."""
    return pixels.groupBy(*keys, "py", "px").agg(F.max("level").alias("level"))


def middles(pixels: DataFrame, frames: DataFrame, dark: float, *keys: str, share: float = 0.3, least: int = 5) -> DataFrame:
    """Medians of each pixel's levels from `dark` on, where enough of a key's frames show it."""
    seen = pixels.filter(F.col("level") >= dark).groupBy(*keys, "py", "px").agg(F.count("*").alias("n"), F.percentile("level", 0.5).alias("middle"))
    total = frames.groupBy(*keys).agg(F.count("*").alias("_all"))
    return seen.join(F.broadcast(total), list(keys)).filter(F.col("n") >= F.greatest(F.lit(float(least)), share * F.col("_all"))).drop("_all")


def laplacian_variance(image: str, width: int, height: int) -> Column:
    """The variance of the four-neighbour Laplacian over the inner pixels."""
    inner = [y * width + x for y in range(1, height - 1) for x in range(1, width - 1)]
    e = lambda i: F.element_at(image, i + 1).cast("double")
    at = F.transform(F.array(*map(F.lit, inner)), lambda i: e(i - width) + e(i + width) + e(i - 1) + e(i + 1) - 4 * e(i))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    # the list of differences is bound once
    varied = F.transform(F.array(at), lambda a: total(F.transform(F.transform(a, lambda x: x - total(a) / len(inner)), lambda d: d * d)) / len(inner))
    return F.element_at(varied, 1)


def shifts(pairs: DataFrame, seen: DataFrame, key: str, least: int) -> DataFrame:
    """(i, j, sx, sy, ncc): the correlation of pictures i and j under each shift at which `least` pixels that both show lie
    upon each other (a pixel of i is one of j plus the shift). seen: (key, px, py, level), the pixels that are
    not masked. The six sums of a shift are aggregated where the pixels of a pair meet."""
    side = lambda e: seen.select(F.col(key).alias(e), *[F.col(c).alias(f"{c}_{e}") for c in ("px", "py", "level")])
    f, g = F.col("level_i"), F.col("level_j")
    both = pairs.join(side("i"), "i").join(side("j"), "j")
    sums = both.groupBy("i", "j", (F.col("px_i") - F.col("px_j")).alias("sx"), (F.col("py_i") - F.col("py_j")).alias("sy")).agg(F.count("*").alias("n"), F.sum(f).alias("f"), F.sum(g).alias("g"), F.sum(f * f).alias("ff"), F.sum(g * g).alias("gg"), F.sum(f * g).alias("fg")).filter(F.col("n") >= least)
    spread = (F.col("ff") - F.col("f") * F.col("f") / F.col("n")) * (F.col("gg") - F.col("g") * F.col("g") / F.col("n"))
    shared = F.col("fg") - F.col("f") * F.col("g") / F.col("n")
    return sums.select("i", "j", "sx", "sy", F.when(spread > 1e-12, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), shared / F.sqrt(spread)))).otherwise(0.0).alias("ncc"))


def peaks(scores: DataFrame, radius: float) -> DataFrame:
    """(i, j, sx, sy, peak, second): the best shift of each pair, moved by a parabola through its neighbours by half a
    pixel at most, and the best score further than radius from it, 0 at least."""
    top = scores.groupBy("i", "j").agg(F.max(F.struct("ncc", (-F.col("sy")).alias("y"), (-F.col("sx")).alias("x"))).alias("t"))
    top = top.select("i", "j", F.col("t.ncc").alias("peak"), (-F.col("t.x")).alias("tx"), (-F.col("t.y")).alias("ty"))
    both = scores.join(top, ["i", "j"]).withColumn("dx", F.col("sx") - F.col("tx")).withColumn("dy", F.col("sy") - F.col("ty"))
    beside = lambda x, y: F.max(F.when((F.col("dx") == x) & (F.col("dy") == y), F.col("ncc")))
    away = F.max(F.when(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") > radius * radius, F.col("ncc")))
    found = both.groupBy("i", "j", "tx", "ty", "peak").agg(F.greatest(F.lit(0.0), F.coalesce(away, F.lit(0.0))).alias("second"), beside(-1, 0).alias("l"), beside(1, 0).alias("r"), beside(0, -1).alias("u"), beside(0, 1).alias("d"))

    def part(a: str, b: str) -> Column:
        bend = F.col(a) - 2 * F.col("peak") + F.col(b)
        return F.when(bend < 0, F.least(F.lit(0.5), F.greatest(F.lit(-0.5), 0.5 * (F.col(a) - F.col(b)) / bend))).otherwise(0.0)

    return found.select("i", "j", (F.col("tx") + part("l", "r")).alias("sx"), (F.col("ty") + part("u", "d")).alias("sy"), "peak", "second")


def filled(seen: DataFrame, key: str, levels: int) -> DataFrame:
    """seen (key, px, py, level or null for a hole) with holes filled: means of two by two pixels without holes make each
    coarser level, and from the coarsest down a hole takes what lies over it."""
    pyramid = [seen.select(key, "px", "py", "level")]
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    for _ in range(levels):
        pyramid.append(pyramid[-1].groupBy(key, half("px"), half("py")).agg(F.avg("level").alias("level")))
    whole = pyramid.pop()
    for own in reversed(pyramid):
        over = whole.select(key, F.col("px").alias("_x"), F.col("py").alias("_y"), F.col("level").alias("_over"))
        there = own.withColumn("_x", half("px")).withColumn("_y", half("py"))
        whole = there.join(over, [key, "_x", "_y"]).select(key, "px", "py", F.coalesce("level", "_over").alias("level"))
    return whole


CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


def _around(seen: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """(key, px, py): each pixel of seen and its four neighbours within the picture, as often as they occur."""
    moves = F.array(*[F.struct((F.col("px") + x).cast("int").alias("px"), (F.col("py") + y).cast("int").alias("py")) for x, y in CROSS])
    at = seen.select(key, F.explode(moves).alias("_m")).select(key, "_m.px", "_m.py")
    return at.filter(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))


def closed(seen: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """The pixels (key, px, py) of seen, grown by a cross and worn by one again; pixels outside the picture count for
    neither."""
    grown = _around(seen, key, width, height).distinct()
    least = 5 - F.col("px").isin(0, width - 1).cast("int") - F.col("py").isin(0, height - 1).cast("int")
    return _around(grown, key, width, height).groupBy(key, "px", "py").agg(F.count("*").alias("n")).filter(F.col("n") == least).drop("n")


def blobs(seen: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """seen (key, px, py) with `blob`, the smallest name of the pixels that are linked over sides, key * width * height +
    place; and `size`. Runs of a row are intervals; overlapping ones of neighbouring rows are linked, so the graph has
    a node for each run, not for each pixel."""
    from petroloom.operators import graph

    row = Window.partitionBy(key, "py").orderBy("px")
    runs = seen.withColumn("_run", F.col("px") - F.row_number().over(row)).groupBy(key, "py", "_run").agg(F.min("px").alias("x0"), F.max("px").alias("x1"))
    name = F.col(key) * (width * height) + F.col("py") * width + F.col("x0")
    runs = graph.stored(runs.select(key, "py", "x0", "x1", name.cast("long").alias("id")))
    below = runs.select(F.col(key), (F.col("py") - 1).alias("py"), F.col("x0").alias("y0"), F.col("x1").alias("y1"), F.col("id").alias("j"))
    links = runs.join(below, [key, "py"]).filter((F.col("x0") <= F.col("y1")) & (F.col("y0") <= F.col("x1"))).select(F.col("id").alias("i"), "j")
    labels = graph.components(runs.select("id"), links)
    named = runs.join(labels, "id").select(key, "py", "x0", "x1", F.col("label").alias("blob"))
    size = named.groupBy("blob").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("size"))
    return named.join(size, "blob").select(key, "blob", "size", "py", F.explode(F.sequence("x0", "x1")).alias("px"))


def hull_corners(shape: DataFrame, key: str) -> DataFrame:
    """(key, side, px, py): the corners of the convex hull of each key's pixels, on its left (-1) and right (1) side. Of a
    row only the ends can be corners: those towards which the side's edge turns, by the steepest slopes from the
    rows before and to those after."""
    ends = shape.groupBy(key, "py").agg(F.min("px").alias("l"), F.max("px").alias("r"))
    side = ends.select(key, "py", F.explode(F.array(F.struct(F.lit(-1).alias("side"), F.col("l").alias("px")), F.struct(F.lit(1).alias("side"), F.col("r").alias("px")))).alias("_e")).select(key, "_e.side", "_e.px", "py")
    other = side.select(key, "side", F.col("px").alias("_x"), F.col("py").alias("_y"))
    pairs = side.join(other, [key, "side"], "left").withColumn("_d", F.when(F.col("_y") != F.col("py"), -F.col("side") * (F.col("_x") - F.col("px")) / (F.col("_y") - F.col("py"))))
    by = pairs.groupBy(key, "side", "px", "py").agg(F.max(F.when(F.col("_y") < F.col("py"), F.col("_d"))).alias("before"), F.min(F.when(F.col("_y") > F.col("py"), F.col("_d"))).alias("after"))
    return by.filter(F.col("before").isNull() | F.col("after").isNull() | (F.col("before") < F.col("after"))).select(key, "side", "px", "py")


def edge_distances(pixels: DataFrame, key: str) -> DataFrame:
    """pixels (key, px, py, seen) with `distance` from each seen pixel to the nearest other one of its picture: 0 for those,
    null without any. The nearest of a pixel's own column comes from two windows, the nearest of all from the columns
    of its row, which are held together, so no pairs of pixels are made."""
    up = Window.partitionBy(key, "px").orderBy("py")
    edge = F.when(~F.col("seen"), F.col("py"))
    above = F.last(edge, True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(edge, True).over(up.rowsBetween(0, Window.unboundedFollowing))
    column = pixels.select(key, "px", "py", F.least(F.col("py") - above, below - F.col("py")).alias("_d"))
    rows = column.groupBy(key, "py").agg(F.collect_list("px").alias("_x"), F.collect_list(F.when(F.col("_d").isNotNull(), F.struct("px", (F.col("_d") * F.col("_d")).alias("s")))).alias("_c"))
    nearest = F.transform("_x", lambda x: F.struct(x.alias("px"), F.array_min(F.transform("_c", lambda c: c["s"] + (c["px"] - x) * (c["px"] - x))).alias("s")))
    return rows.select(key, "py", F.explode(nearest).alias("_n")).select(key, "_n.px", "py", F.sqrt("_n.s").alias("distance"))
