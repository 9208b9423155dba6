"""What has to hold so that figures grow no faster than the input."""

import inspect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstlake import scale
from burstlake.operators import filters, matching, recurrence, transforms
from burstlake.plans import comparison
from burstlake.sources import recordings
from burstlake.streaming import extract


@pytest.mark.parametrize("n", [2310, 1_200_000, 7_200_000, 7_199_999])
def test_tiles_of_a_long_recording_are_as_many_as_its_samples_ask_for(n):
    s = transforms.shape_of(n, 500)
    tiles = len(transforms.strips(s.cols, s.wide)) * len(transforms.strips(s.rows, s.high))
    assert tiles <= max(64, 2 * s.rows * s.cols // transforms.TILE)
    assert max(s.wide * s.rows, s.high * s.cols) <= max(500, (transforms.TILE * s.rows * s.cols) ** 0.5)


def test_a_state_that_never_forgets_settles_in_few_rounds(spark, monkeypatch):
    """A plain sum over 24 segments: warmed states are all wrong, runs that double put them right."""
    steps, cut = [], scale.cut_lineage
    monkeypatch.setattr(scale, "cut_lineage", lambda df: steps.append(1) or cut(df))
    data = [(k, i, float(i % 5)) for k, n in (("a", 48), (None, 7)) for i in range(n)]
    df = spark.createDataFrame(data, "key string, i long, v double").withColumn("seg", F.floor(F.col("i") / 2).cast("long"))

    def step(rows, state):
        out = (state or [0.0])[0] + rows.sort_values("i")["v"].cumsum()
        return pd.DataFrame({"key": rows["key"], "i": rows["i"], "sum": out}), [out.iloc[-1]]

    got = scale.scan_segments(df, ["key"], "seg", step, T.StructType([df.schema["key"], df.schema["i"], T.StructField("sum", T.DoubleType())]),
                              warm=1, order="i").collect()
    want, at = {}, {}
    for k, i, v in data:
        at[k] = want[k, i] = at.get(k, 0.0) + v
    assert {(r.key, r.i): r["sum"] for r in got} == want and len(got) == len(data)
    assert len(steps) <= 24


def test_the_nearest_frame_needs_no_window_to_the_end(spark):
    """Such a window is summed up anew for every row: quadratic in the questions of a segment."""
    asked = spark.createDataFrame([("s", 0, 1.4), ("s", 0, 7.6), ("s", 0, 40.0)], "stream_id string, channel int, _pos double")
    frames = spark.createDataFrame([("s", 0, f) for f in (2, 7, 12, 33)], "stream_id string, channel int, frame long")
    near = matching._nearest_frame(asked, frames, ["stream_id", "channel"], 8)
    assert sorted((r["_pos"], r["_near"]) for r in near.collect()) == [(1.4, 2), (7.6, 7), (40.0, 33)]
    assert "unboundedfollowing" not in near._jdf.queryExecution().toString().lower()


def test_channels_leave_their_task_in_small_batches(spark):
    """An Arrow function gives a whole batch at once, twelve times its input: rows come out of a stream of batches instead."""
    blocks = spark.createDataFrame([(k, 0, 0, [1.0] * 8, [0.0] * 8) for k in ("s", None)],
                                   "stream_id string, block_idx long, first_sample long, i array<double>, q array<double>")
    out = filters.channelise(blocks)
    assert out.groupBy("stream_id").count().where("count = 48").count() == 2
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


@pytest.mark.parametrize("first", [0.25, float("nan")])
def test_frames_smoothed_before_move_the_estimate_as_in_order(spark, first):
    rng = np.random.default_rng(3)
    spec = rng.normal(scale=0.5, size=(40, 9))
    spec[0, 4] = first
    df = spark.createDataFrame([(i, s.tolist()) for i, s in enumerate(spec)], "frame long, power_db array<double>").withColumn("recording", F.lit("r"))
    est, move, same = spec[0], recurrence.mover(9, 0.0625, 7), spec[1]
    for s in spec:
        est = recurrence.track_step(est, s, 0.0625, 7)
    for s in spec[1:]:
        want = np.array([np.median(np.take(same + np.where(recurrence.smooth_bins(s) > same, 0.0625, -0.0625), range(i - 3, i + 4), mode="clip"))
                         for i in range(9)])
        same = move(same, recurrence.smooth_bins(s))
        assert np.array_equal(same, want)
    got = recurrence.track_median(df).orderBy("frame").collect()
    assert np.array_equal(np.array(got[-1].est_db, dtype=float), est, equal_nan=True) and np.isnan(est).any() == np.isnan(first)


def test_short_recordings_share_tables():
    clips = [(str(k), 8000, 0, np.arange(5.0), np.zeros(5)) for k in range(3000)]
    tables = list(recordings.piece_rows(clips, 2))
    assert len(tables) <= 4 and sum(map(len, tables)) == 9000
    assert list(pd.concat(tables)["first_sample"][:4]) == [0, 2, 4, 0] and list(tables[0]["i"][2]) == [4.0]
    long = list(recordings.piece_rows([("a", 8000, 0, np.zeros(1 << 22), np.zeros(1 << 22))], 8192))
    assert len(long) >= 4 and max(map(len, long)) <= 130


def test_a_comparison_matches_once(spark):
    truth = spark.createDataFrame([(1, 1, "k1", 5.0, 1.0), (1, 2, "k2", 9.0, 4.0)], "run_id long, truth_no long, msg string, freq double, t_sec double")
    log = spark.createDataFrame([(1, 1, "k1 x", 5.0, 1.0), (1, 2, "k9", 9.5, 4.0), (1, 3, "k7", 90.0, 4.0)],
                                "run_id long, line_no long, message string, freq double, t_sec double")
    statuses, alarms = comparison.compare(truth, log)
    assert {r.truth_no: r.status for r in statuses.collect()} == {1: "DECODED", 2: "GARBLED"} and [r.line_no for r in alarms.collect()] == [3]
    assert all("_pf" not in df._jdf.queryExecution().toString() for df in (statuses, alarms))


def test_event_segments_leave_a_few_at_a_time():
    """The step gives out a table per ``OUT_ROWS`` segments, not all of a micro-batch as lists."""
    source = inspect.getsource(extract.stream_event_segments)
    assert 0 < extract.OUT_ROWS <= 10_000 and "len(out) >= OUT_ROWS" in source and "tolist" not in source
