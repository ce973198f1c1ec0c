"""Keyframe selection over ordered streams: the folds that depend on what was selected before.

Videos are spread over the cluster. What windows can express runs in the JVM, which spills; the one fold
that cannot streams over frames sorted within partitions and keeps one number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F


class Gate:
    """Keeps a frame that has moved by `least` from the last kept one; the first is kept. The state is
    the last kept position, so batches and streams share it."""

    def __init__(self, least: float, last: float | None = None) -> None:
        self.least, self.last = least, last

    def keep(self, position: float) -> bool:
        if self.last is None or abs(position - self.last) >= self.least:
            self.last = position
            return True
        return False


def keyframe_gate(frames: DataFrame, video: str, position: str, least: float) -> DataFrame:
    """(video, frame_index) of the keyframes."""
    def select(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate, of = Gate(least), None
        for batch in rows:
            keep = np.zeros(batch.num_rows, bool)
            for k, (v, p) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if v != of or gate is None:
                    gate, of = Gate(least), v
                keep[k] = gate.keep(p)
            yield batch.select([0, 1]).filter(pa.array(keep))

    ordered = frames.select(video, F.col("frame_index").cast("long").alias("frame_index"), F.col(position).cast("double")).repartition(video).sortWithinPartitions(video, "frame_index")
    return ordered.mapInArrow(select, f"{video} {dict(frames.dtypes)[video]}, frame_index long")


def velocity(frames: DataFrame, video: str, position: str, share: float = 0.5) -> DataFrame:
    """The last velocity of each video: an exponential mean of the shifts between frames, which weighs a
    shift by (1 - share) to the number of later ones."""
    forth, back = Window.partitionBy(video).orderBy("frame_index"), Window.partitionBy(video).orderBy(F.desc("frame_index"))
    shifts = frames.withColumn("_shift", F.col(position) - F.lag(position).over(forth)).withColumn("_later", F.row_number().over(back) - 1)
    weighed = F.col("_shift") * share * F.pow(F.lit(1.0 - share), F.col("_later"))
    return shifts.groupBy(video).agg(F.count("*").alias("frames"), F.coalesce(F.sum(weighed), F.lit(0.0)).alias("velocity"))


def lost_segments(frames: DataFrame, video: str, value: str, least: float, patience: int = 3) -> DataFrame:
    """Tracking fails on frames below `least`; after `patience` failures in a row a new segment starts."""
    good = F.when(F.col(value) < least, 0).otherwise(1)
    islands = frames.withColumn("_bad", 1 - good).withColumn("_island", F.sum(good).over(Window.partitionBy(video).orderBy("frame_index")))
    runs = islands.groupBy(video, "_island").agg(F.sum("_bad").alias("failed"))
    return runs.groupBy(video).agg(F.sum("failed").cast("long").alias("failed"), (1 + F.sum(F.floor(F.col("failed") / patience))).cast("long").alias("segments"))


def tail_velocity(frames: DataFrame, video: str, position: str, fps: float = 30.0, last: int = 4) -> DataFrame:
    """Velocity a second over the last frames of each video: the motion before tracking was lost."""
    w = Window.partitionBy(video).orderBy(F.desc("frame_index"))
    tail = frames.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= last)
    ends = tail.groupBy(video).agg(F.count("*").alias("n"), F.max_by(position, "frame_index").alias("p1"), F.min_by(position, "frame_index").alias("p0"), F.max("frame_index").alias("i1"), F.min("frame_index").alias("i0"))
    return ends.select(video, F.when(F.col("n") > 1, (F.col("p1") - F.col("p0")) / ((F.col("i1") - F.col("i0")) / fps)).otherwise(0.0).alias("velocity"))

