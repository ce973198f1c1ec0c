"""The keyframe machine by cases, and as a stream that stops and goes on."""

from __future__ import annotations

import pytest

from petroloom import catalog
from petroloom.operators import selection
from petroloom.operators.selection import Along, Frame, Rules, State, advance

LINE = Along(window=5.0, reach=60.0, strict_reach=30.0, fits=50.0, moved=2.0, replaces=30.0)
RULES = Rules(least=20.0)


def run(positions, matcher=LINE, rules=RULES):
    s, out = State(), []
    for k, p in enumerate(positions):
        outcome, made, s = advance(s, Frame(k, k / 30, float(p), 1.0), matcher, rules)
        out.append((outcome, [f.index for f, _ in made]))
    return out, s


def test_prediction_keyframes_and_velocity():
    out, s = run([0, 8, 16, 24, 32])
    assert out == [("first", [0]), ("near", []), ("near", []), ("keyframe", [3]), ("near", [])]
    assert s.velocity == pytest.approx(7.5) and s.shift == 8 and s.keyframes == 2


def test_a_candidate_takes_the_keyframes_place():
    out, s = run([0, 15, 70])  # 70 is out of reach of 0 but not of 15
    assert out[-1] == ("unfit", [1]) and s.key == 15 and s.shift == 55


def test_a_candidate_that_cannot_is_given_up():
    out, s = run([0, 1, 200, 31])
    assert out[2] == ("missed", []) and s.held is None
    assert out[3][0] == "missed"  # strictly out of reach, and no candidate is left to try


def test_segments_begin_after_patience():
    out, s = run([0, 200, 201, 202, 203])
    assert [o for o, _ in out] == ["first", "missed", "missed", "lost", "near"] and s.segment == 1 and s.missed == 0


def test_the_step_between_frames_scales_the_prediction():
    out, _ = run([0, 8, 16], rules=Rules(least=20.0, step=4))
    assert out[2][0] == "near"
    _, s = run([0, 8], rules=Rules(least=20.0, step=4))
    assert s.velocity == 1.0


def test_blurred_frames_count_in_the_median():
    recent = []
    said = []
    for x in [10, 10, 5, 10, 6]:
        recent.append(float(x))
        said.append(selection.is_sharp(recent, x, RULES))
    assert said == [True, True, False, True, True]


def test_stream_goes_on_from_its_checkpoint(spark, sf, tmp_path):
    """Two runs over one checkpoint, the second also with frames of before, give the batch's rows; those are late."""
    from petroloom.streaming import keyframes as sk

    frames = catalog.stream(spark, sf).select("user_id", "frame_index", "value")
    want = {tuple(r) for r in selection.outcomes(frames, "user_id", "value", "value", catalog.SELECTING, catalog.GATED).collect()}
    source, key = str(tmp_path / "in"), "spark.sql.streaming.stateStore.providerClass"

    def read() -> None:
        live = spark.readStream.schema(frames.schema).parquet(source)
        out = sk.selection(live, "user_id", "value", "value", catalog.SELECTING, catalog.GATED).writeStream.format("parquet").outputMode("append")
        out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(200)

    before = spark.conf.get(key)
    spark.conf.set(key, sk.ROCKS)
    try:
        frames.filter("frame_index < 4").coalesce(1).write.parquet(source)
        read()
        frames.filter("frame_index >= 2").coalesce(1).write.mode("append").parquet(source)
        read()
    finally:
        spark.conf.set(key, before)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {tuple(r[:-1]) for r in rows} == want and len(rows) == len(want)
    assert max(r["late"] for r in rows) == 2


def test_cancel_stops_running_jobs(spark):
    import time

    from petroloom.plans.control import cancellable

    def slow(pdfs):
        for pdf in pdfs:
            time.sleep(60)
            yield pdf

    start = time.time()
    with pytest.raises(InterruptedError), cancellable(spark, lambda: time.time() - start > 2):
        spark.range(4).repartition(2).mapInPandas(slow, "id long").collect()
    assert time.time() - start < 30
    with cancellable(spark, lambda: False):
        assert spark.range(3).count() == 3
