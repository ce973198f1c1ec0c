"""Ordered frame streams: indexing, sampling, the rolling-median blur filter and counters.

A stream is keyed by video; its frames are numbered from 0 in the order of `order`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def indexed(df: DataFrame, video: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(video).orderBy(*order)
    return df.withColumn("frame_index", (F.row_number().over(w) - 1).cast("long"))


def sample_step(frames: DataFrame, step: int) -> DataFrame:
    """Every step-th frame, the first included."""
    return frames.filter(F.col("frame_index") % step == 0)


def analysis_step(fps: float, analysis_fps: float) -> int:
    return max(1, round(fps / max(analysis_fps, 0.1)))


def sample_even(frames: DataFrame, video: str, n: int) -> DataFrame:
    """n frames evenly spaced from the first to the last; a short stream repeats some."""
    total = frames.groupBy(video).agg(F.count("*").alias("total"))
    at = total.select(video, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"), "total")
    at = at.withColumn("frame_index", F.floor(F.col("k") * (F.col("total") - 1) / max(n - 1, 1)).cast("long"))
    return at.drop("total").join(frames, [video, "frame_index"])


def rolling_median(value: str, video: str, order: list[str], last: int) -> Column:
    """The median of the last `last` values, this one included."""
    w = Window.partitionBy(video).orderBy(*order).rowsBetween(-(last - 1), 0)
    a = F.sort_array(F.collect_list(value).over(w))
    n = F.size(a)
    return (F.element_at(a, ((n + 1) / 2).cast("int")) + F.element_at(a, (n / 2).cast("int") + 1)) / 2


def blur_filter(frames: DataFrame, video: str, value: str, share: float = 0.6, least: float = 0.0, last: int = 31) -> DataFrame:
    """Adds the rolling median, and whether a frame is too blurred beside it."""
    frames = frames.withColumn("median", rolling_median(value, video, ["frame_index"], last))
    return frames.withColumn("blurred", (F.col(value) < share * F.col("median")) | (F.col(value) < least))


def track_stats(frames: DataFrame, video: str) -> DataFrame:
    """Counters of a blur-filtered stream."""
    return frames.groupBy(video).agg(F.count("*").alias("analysed"), F.count_if("blurred").alias("blurred"), F.count_if(~F.col("blurred")).alias("usable"))
