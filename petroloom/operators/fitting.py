"""Fits as aggregates: circles, thresholds, medians, rigid motions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def circle(points: DataFrame, key: list[str]) -> DataFrame:
    """Least squares circle of each key's points (x, y), after Kasa: sums about the mean, then a
    linear solve in closed form."""
    mean = points.groupBy(*key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    p = points.join(mean, key) if key else points.join(F.broadcast(mean), F.lit(True))
    u, v = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    z = u * u + v * v
    sums = p.groupBy(*key).agg(F.count("*").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"), F.sum(u * z).alias("uz"), F.sum(v * z).alias("vz"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    a = (F.col("uz") * F.col("vv") - F.col("vz") * F.col("uv")) / det / 2
    b = (F.col("vz") * F.col("uu") - F.col("uz") * F.col("uv")) / det / 2
    return sums.select(*key, (a + F.col("mx")).alias("cx"), (b + F.col("my")).alias("cy"), F.sqrt(a * a + b * b + (F.col("uu") + F.col("vv")) / F.col("n")).alias("radius"))


def inliers(points: DataFrame, key: list[str], floor: float = 2.0, medians: float = 3.0) -> DataFrame:
    """The points whose residual (_r) in the first fit is below the larger of floor and some medians."""
    first = circle(points, key)
    r = points.join(first, key).withColumn("_r", F.abs(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) - F.col("radius")))
    limit = r.groupBy(*key).agg(F.greatest(F.lit(floor), medians * F.percentile("_r", 0.5)).alias("_limit"))
    return r.join(limit, key).filter("_r < _limit").select(*key, "x", "y", "_r")


def circle_refit(points: DataFrame, key: list[str], floor: float = 2.0, medians: float = 3.0, least: int = 20) -> DataFrame:
    """A second fit on the points near the first; the first one where fewer than `least` are near."""
    near = inliers(points, key, floor, medians)
    enough = near.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    again = circle(near.join(enough, key, "left_semi"), key).select(*key, F.struct("cx", "cy", "radius").alias("_again"))
    first = circle(points, key).join(again, key, "left")
    return first.select(*key, *[F.coalesce(f"_again.{c}", c).alias(c) for c in ("cx", "cy", "radius")])


def otsu(df: DataFrame, level: str, levels: int = 256) -> DataFrame:
    """The level that parts a histogram into two classes of largest variance between them; one row.
    The histogram has `levels` rows at most, so ordering it is small."""
    h = df.groupBy(F.col(level).cast("int").alias("level")).agg(F.count("*").alias("n"))
    up, whole = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    h = h.select("level", F.sum("n").over(up).alias("w0"), F.sum(F.col("n") * F.col("level")).over(up).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("level")).over(whole).alias("s"))
    w0, w1 = F.col("w0").cast("double"), (F.col("w") - F.col("w0")).cast("double")
    gap = F.col("s0") / w0 - (F.col("s") - F.col("s0")) / w1
    h = h.filter("w > w0").withColumn("between", w0 * w1 * gap * gap)
    return h.agg(F.max_by("level", F.struct("between", -F.col("level"))).alias("level"))


def rigid(points: DataFrame, key: list[str]) -> DataFrame:
    """The rotation and shift that take (ux, uy) to (vx, vy) best, by key: v = R u + t; one pair gives a
    shift alone."""
    mean = points.groupBy(*key).agg(*[F.avg(c).alias(f"m_{c}") for c in ("ux", "uy", "vx", "vy")])
    p = points.join(mean, key)
    d = {c: F.col(c) - F.col(f"m_{c}") for c in ("ux", "uy", "vx", "vy")}
    sums = p.groupBy(*key).agg(F.count("*").alias("n"), *[F.first(f"m_{c}").alias(f"m_{c}") for c in d], F.sum(d["ux"] * d["vy"] - d["uy"] * d["vx"]).alias("cross"), F.sum(d["ux"] * d["vx"] + d["uy"] * d["vy"]).alias("dot"))
    t = F.when(F.col("n") > 1, F.atan2("cross", "dot")).otherwise(0.0)
    sums = sums.withColumn("theta", t)
    c, s = F.cos("theta"), F.sin("theta")
    return sums.select(*key, "theta", (F.col("m_vx") - (c * F.col("m_ux") - s * F.col("m_uy"))).alias("tx"), (F.col("m_vy") - (s * F.col("m_ux") + c * F.col("m_uy"))).alias("ty"))


def linear(df: DataFrame, key: list[str], terms: list[Column], value: Column) -> DataFrame:
    """(key, solution): the least squares coefficients of terms for value. Each key's normal equations are sums, gathered
    with partial aggregation, and solved by elimination inside the row; the matrix is positive, so no rows change
    places."""
    n = len(terms)
    wide = df.select(*key, F.array(*terms).alias("_t"), value.alias("_v"))
    sums = [F.sum(F.col("_t")[i] * (F.col("_t")[j] if j < n else F.col("_v"))) for i in range(n) for j in range(n + 1)]
    made = wide.groupBy(*key).agg(*[c.alias(f"_{k}") for k, c in enumerate(sums)])
    rows = F.array(*[F.array(*[F.col(f"_{i * (n + 1) + j}") for j in range(n + 1)]) for i in range(n)])

    def eliminate(m: Column, k: Column) -> Column:
        lead = F.element_at(m, k + 1)

        def clear(row: Column, r: Column) -> Column:
            by = F.element_at(row, k + 1) / F.element_at(lead, k + 1)
            return F.when(r == k, row).otherwise(F.zip_with(row, lead, lambda a, b: a - by * b))

        return F.transform(m, clear)

    solved = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), rows, eliminate)
    return made.select(*key, F.transform(solved, lambda row, r: F.element_at(row, n + 1) / F.element_at(row, r + 1)).alias("solution"))
