"""Keyframe selection as one state machine over a video's frames in order.

A frame is sharp enough beside the last ones, or blurred. A sharp frame is looked for beside where the motion
so far puts it, then anywhere by stricter rules. If it is not found, the last frame that lay near the keyframe
takes the keyframe's place, where it has moved and fits, and the search begins anew from there; whether or not
it does, it is given up. What is found far enough from the keyframe and fits becomes the next one.

The state is a record of fixed size, so batches and streams run the same step, and what the shifts are
(numbers, or displacements of images) is up to a Matcher."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median
from typing import Any, NamedTuple, Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

RECENT = 31  # frames whose sharpness a frame is held against, itself included


class Frame(NamedTuple):
    index: int
    time: float
    item: Any
    sharpness: float


class Rules(NamedTuple):
    least: float  # shift from which a frame is a keyframe
    step: int = 1  # frames of the video from one analysed frame to the next
    patience: int = 3  # frames not found until a segment begins
    sharp: float = 0.6  # share of the median sharpness
    sharp_least: float = 0.0


class State(NamedTuple):
    """held: the last frame near the keyframe, with its match; shift and velocity are those of the last frame found."""

    key: Any = None
    held: tuple[Frame, Any] | None = None
    shift: Any = 0.0
    velocity: Any = 0.0
    segment: int = 0
    missed: int = 0
    keyframes: int = 0


class Matcher(Protocol):
    """Matches of frame b against keyframe a, or None."""

    def near(self, a: Any, b: Any, at: Any) -> Any: ...

    def anywhere(self, a: Any, b: Any, strict: bool) -> Any: ...

    def fit(self, a: Any, b: Any, found: Any) -> Any:
        """The pose of a match, if it holds at full detail."""

    def replaced(self, a: Any, b: Any, found: Any) -> Any:
        """The pose of the frame that is to take a's place, if it has moved and holds."""

    def shift(self, found: Any) -> Any: ...

    def length(self, found: Any) -> float: ...


class Step(NamedTuple):
    """What a frame was (blurred, first, near, keyframe, unfit, missed, lost), the keyframes that it made, each
    with the pose that binds it to the one before or None, and the state after it."""

    outcome: str
    made: list[tuple[Frame, Any]]
    state: State


def is_sharp(recent: list[float], sharpness: float, rules: Rules) -> bool:
    """recent: of the last frames, this one included."""
    return sharpness >= max(rules.sharp * median(recent), rules.sharp_least)


def _keyed(s: State, frame: Frame) -> State:
    return s._replace(key=frame.item, held=None, shift=s.shift * 0, keyframes=s.keyframes + 1)


def advance(s: State, frame: Frame, m: Matcher, rules: Rules) -> Step:
    """The step of one sharp frame."""
    if s.key is None:
        return Step("first", [(frame, None)], _keyed(s, frame))
    found = m.near(s.key, frame.item, s.shift + s.velocity * rules.step)
    if found is None:
        found = m.anywhere(s.key, frame.item, True)
    made = []
    if found is None and s.held:
        (other, match), s = s.held, s._replace(held=None)
        if (pose := m.replaced(s.key, other.item, match)) is not None:
            made, s = [(other, pose)], _keyed(s, other)
            found = m.anywhere(s.key, frame.item, False)
    if found is None:
        s = s._replace(missed=s.missed + 1)
        if s.missed < rules.patience:
            return Step("missed", made, s)
        s = _keyed(s, frame)._replace(segment=s.segment + 1, missed=0, velocity=s.velocity * 0)
        return Step("lost", [*made, (frame, None)], s)
    at = m.shift(found)
    s = s._replace(missed=0, shift=at, velocity=(s.velocity + (at - s.shift) / rules.step) / 2)
    if m.length(found) < rules.least:
        return Step("near", made, s._replace(held=(frame, found)))
    pose = m.fit(s.key, frame.item, found)
    return Step("unfit", made, s) if pose is None else Step("keyframe", [*made, (frame, pose)], _keyed(s, frame))


# Positions in place of images

class Along(NamedTuple):
    """Frames that are positions on a line: a shift is found beside a prediction or within reach."""

    window: float
    reach: float
    strict_reach: float
    fits: float
    moved: float
    replaces: float

    def near(self, a: float, b: float, at: float) -> float | None:
        return b - a if abs(b - a - at) <= self.window else None

    def anywhere(self, a: float, b: float, strict: bool) -> float | None:
        return b - a if abs(b - a) <= (self.strict_reach if strict else self.reach) else None

    def fit(self, a: float, b: float, found: float) -> float | None:
        return found if abs(found) <= self.fits else None

    def replaced(self, a: float, b: float, found: float) -> float | None:
        return found if self.moved <= abs(found) <= self.replaces else None

    def shift(self, found: float) -> float:
        return found

    def length(self, found: float) -> float:
        return abs(found)


OUTCOMES = "frame_index long, outcome string, segment int, keyframe long, promoted long, velocity double"


class Line:
    """The machine over one video's positions, with the record that a stream keeps between its batches."""

    RECORD = "key double, held double, held_index long, shift double, velocity double, segment int, missed int, keyframes long, seen long, late long"

    def __init__(self, matcher: Along, rules: Rules, record: tuple | None = None, recent: list[float] = ()) -> None:
        self.matcher, self.rules, self.recent = matcher, rules, list(recent)
        key, held, at, *rest, self.seen, self.late = record or (None, None, None, 0.0, 0.0, 0, 0, 0, -1, 0)
        self.state = State(key, None if held is None else (Frame(at, 0.0, key + held, 0.0), held), *rest)

    def record(self) -> tuple:
        s = self.state
        frame, shift = s.held or (None, None)
        return (s.key, shift, frame and frame.index, s.shift, s.velocity, s.segment, s.missed, s.keyframes, self.seen, self.late)

    def steps(self, frames: pd.DataFrame) -> Iterator[tuple]:
        """Rows of OUTCOMES for frames (frame_index, position, sharpness) in order; a frame that is not after all
        before it is late, counted and left out."""
        for index, position, sharpness in frames.itertuples(index=False):
            if index <= self.seen:
                self.late += 1
                continue
            self.seen = int(index)
            self.recent = [*self.recent[-RECENT + 1 :], float(sharpness)]
            if not is_sharp(self.recent, sharpness, self.rules):
                yield self.seen, "blurred", self.state.segment, self.state.keyframes - 1, None, self.state.velocity
                continue
            outcome, made, self.state = advance(self.state, Frame(self.seen, 0.0, float(position), float(sharpness)), self.matcher, self.rules)
            before = [f.index for f, _ in made if f.index != self.seen]
            yield self.seen, outcome, self.state.segment, self.state.keyframes - 1, before[0] if before else None, self.state.velocity


def outcomes(frames: DataFrame, video: str, position: str, sharpness: str, matcher: Along, rules: Rules) -> DataFrame:
    """(video, ...OUTCOMES): what became of each frame of each video. Videos are dealt over the cluster and streamed
    through machines one after another, so a task holds one record; one video is one task, since each step
    needs the one before."""
    columns = [c.split()[0] for c in OUTCOMES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        line, of = None, None
        for pdf in batches:
            starts = pdf[video].ne(pdf[video].shift()).cumsum()
            for _, part in pdf.groupby(starts, sort=False):
                if line is None or part[video].iloc[0] != of:
                    line, of = Line(matcher, rules), part[video].iloc[0]
                yield pd.DataFrame(line.steps(part[["frame_index", "p", "s"]]), columns=columns).assign(**{video: of})[[video, *columns]]

    kind = dict(frames.dtypes)[video]
    ordered = frames.select(video, F.col("frame_index").cast("long").alias("frame_index"), F.col(position).cast("double").alias("p"), F.col(sharpness).cast("double").alias("s"))
    return ordered.repartition(video).sortWithinPartitions(video, "frame_index").mapInPandas(run, f"{video} {kind}, {OUTCOMES}")
