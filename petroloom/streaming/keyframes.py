"""Keyframe selection over streams, with the batch form's folds as keyed state.

The reference point is a total order of frames in each video. A stream may deliver a video's frames in
several batches, each batch's in any order: a batch is sorted, and a frame that is not after all
frames of earlier batches is late, counted and left out."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from petroloom.functions.fov import FieldOfView
from petroloom.functions.registration import Registrar
from petroloom.operators.frames import analysis_step
from petroloom.operators.selection import OUTCOMES, Along, Line, Rules
from petroloom.operators.tracking import Gate
from petroloom.plans.keyframes import EVENTS, Tracker, cropped, image, rows
from petroloom.settings import Settings


def gate(stream: DataFrame, video: str, position: str, least: float) -> DataFrame:
    """(video, frame_index, late) of the keyframes of a stream with columns video, frame_index, position."""
    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen, late = state.get if state.exists else (None, -1, 0)
        pdf = pd.concat(list(pdfs)).sort_values("frame_index")
        g, kept = Gate(least, last), []
        for index, p in zip(pdf["frame_index"], pdf[position], strict=True):
            if index <= seen:
                late += 1
                continue
            seen = int(index)
            if g.keep(float(p)):
                kept.append(seen)
        state.update((g.last, seen, late))
        yield pd.DataFrame({video: key[0], "frame_index": kept, "late": late})

    kind = dict(stream.dtypes)[video]
    return stream.select(video, "frame_index", position).groupBy(video).applyInPandasWithState(fold, f"{video} {kind}, frame_index long, late long", "last double, seen long, late long", "append", GroupStateTimeout.NoTimeout)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Selecting(StatefulProcessor):
    """Keyframe selection of one video: a record as value state, the sharpness of the last frames as list state."""

    def __init__(self, video: str, matcher: Along, rules: Rules) -> None:
        self.video, self.matcher, self.rules = video, matcher, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.record = handle.getValueState("record", Line.RECORD)
        self.recent = handle.getListState("recent", "sharpness double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        line = Line(self.matcher, self.rules, self.record.get() if self.record.exists() else None, [r[0] for r in self.recent.get()])
        frames = pd.concat(list(rows)).sort_values("frame_index", kind="stable")
        columns = [c.split()[0] for c in OUTCOMES.split(", ")]
        out = pd.DataFrame(line.steps(frames[["frame_index", "p", "s"]]), columns=columns)
        self.record.update(line.record())
        self.recent.put([(x,) for x in line.recent])
        yield out.assign(**{self.video: key[0], "late": line.late})[[self.video, *columns, "late"]]

    def close(self) -> None:
        pass


def selection(stream: DataFrame, video: str, position: str, sharpness: str, matcher: Along, rules: Rules) -> DataFrame:
    """(video, ...OUTCOMES, late): operators.selection.outcomes() over a stream. late counts the frames of a video
    that came too late so far. The session's state store must be RocksDB (ROCKS)."""
    kind = dict(stream.dtypes)[video]
    frames = stream.selectExpr(video, "cast(frame_index AS bigint) AS frame_index", f"cast({position} AS double) AS p", f"cast({sharpness} AS double) AS s")
    return frames.groupBy(video).transformWithStateInPandas(Selecting(video, matcher, rules), f"{video} {kind}, {OUTCOMES}, late long", "Append", "None")


def track(stream: DataFrame, fov: FieldOfView, settings: Settings, fps: float = 30.0) -> DataFrame:
    """Keyframe and edge events of streams of frames (schema.FRAMES)."""
    step = analysis_step(fps, settings.analysis_fps)

    def fold(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        blob, seen = state.get if state.exists else (None, -1)
        tracker = Tracker(Registrar(fov, settings), step)
        if blob is not None:
            tracker.__dict__ |= pickle.loads(blob)
        out: list[dict] = []
        for f in pd.concat(list(pdfs)).sort_values("frame_index").itertuples(index=False):
            if f.frame_index > seen:
                seen = int(f.frame_index)
                out += tracker.step(seen, f.time_s, image(f.data, f.width, f.height))
        state.update((pickle.dumps({k: v for k, v in tracker.__dict__.items() if k != "registrar"}), seen))
        yield rows(key[0], out)

    return cropped(stream.filter(stream["frame_index"] % step == 0), fov).groupBy("video_id").applyInPandasWithState(fold, EVENTS, "tracker binary, seen long", "append", GroupStateTimeout.NoTimeout)
