"""Streams in several micro-batches give what the batch operators give."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlake.operators import framing, gates, recurrence
from burstlake.plans.detection import DetectConfig, detect
from burstlake.sinks import tables
from burstlake.streaming import jobs as st
from burstlake.streaming.extract import stream_event_segments


def feed(spark, tmp_path, df, order, parts, make, name):
    """Run the stream once per appended part, so state has to survive restarts."""
    src, out, state = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "state"))
    cuts = df.agg(F.max(order)).first()[0] // parts + 1
    for k in range(parts):
        df.where(F.floor(F.col(order) / cuts) == k).repartition(2).write.mode("append").parquet(src)
        stream = make(st.stream_blocks(spark, src, df.schema, None))
        st.run_to_table(stream, out, state).awaitTermination()
    return spark.read.parquet(out)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_cooldown(spark, tmp_path):
    rng = random.Random(1)
    df = spark.createDataFrame([("s", c, f, rng.random() < 0.1) for c in (1, 2) for f in range(300) if rng.random() < 0.4],
                               "stream_id string, channel int, frame long, again boolean")
    got = feed(spark, tmp_path, df, "frame", 3, lambda s: st.stream_cooldown(s, 9, restart="again"), "cool")
    assert rows(got, "channel", "frame") == rows(gates.cooldown(df, 9, restart=F.col("again")), "channel", "frame")


@pytest.mark.parametrize("circular", [False, True])
def test_detect(spark, tmp_path, circular):
    rng = np.random.default_rng(4)
    lin = rng.exponential(size=(400, 48)) ** 2
    cfg = DetectConfig(threshold_db=22.0, depth=60, cooldown_frames=7, circular=circular)
    wide = spark.createDataFrame([("s", f, v.tolist()) for f, v in enumerate(lin)], "stream_id string, frame long, lin array<double>")
    long = wide.select("stream_id", "frame", F.posexplode("lin").alias("channel", "lin"))
    got = feed(spark, tmp_path, wide, "frame", 3, lambda s: st.stream_detect(s, cfg), "det")
    want = rows(detect(long, cfg), "frame", "channel", "lin")
    assert rows(got, "frame", "channel", "lin") == want and len(want) > 20


def test_impulse_gate_and_tracker(spark, tmp_path):
    rng = np.random.default_rng(1)
    blocks = rng.normal(size=(90, 16))
    blocks[[20, 50, 51]] *= 50
    df = spark.createDataFrame([("s", i, b.tolist(), [0.0] * 16) for i, b in enumerate(blocks)],
                               "stream_id string, block_idx long, i array<double>, q array<double>")
    args = dict(factor=3.0, size=16, rate=160.0)
    got = feed(spark, tmp_path, df, "block_idx", 3, lambda s: st.stream_impulse_gate(s, **args), "gate")
    assert rows(got, "block_idx", "n_hot", "blanked") == rows(recurrence.impulse_gate(df, **args), "block_idx", "n_hot", "blanked")
    spec = df.select(F.lit("r").alias("recording"), F.col("block_idx").alias("frame"), F.col("i").alias("power_db"))
    got = feed(spark, tmp_path, spec, "frame", 2, st.stream_track_median, "track")
    assert rows(got, "frame", "est_db") == rows(recurrence.track_median(spec), "frame", "est_db")


def test_windows_and_runs_wait_for_the_watermark(spark, tmp_path):
    ts = F.timestamp_seconds(F.lit(1_700_000_100) + F.col("sec"))
    df = spark.createDataFrame([("s", s, float(s)) for s in (0, 1, 2, 20, 21, 60, 61)], "stream_id string, sec long, metric double") \
        .withColumn("ts", ts)
    win = feed(spark, tmp_path, df, "sec", 2, lambda s: st.publish_windows(s, {"n": F.count("*")}), "win")
    assert [(r.window_start.second, r.n) for r in win.orderBy("window_start").collect()] == [(0, 3), (15, 2)]
    runs = feed(spark, tmp_path, df, "sec", 2, lambda s: st.stream_runs(s, "5 seconds"), "runs")
    assert [(r.triggers, r.peak) for r in runs.orderBy("run_start").collect()] == [(3, 2.0), (2, 21.0)]


def test_detections_without_decode_appear_late(spark, tmp_path):
    at = lambda c: F.timestamp_seconds(F.lit(1_700_000_000) + F.col(c))
    det = spark.createDataFrame([(1, 0), (2, 5), (3, 500)], "marker_id long, s long").withColumn("det_ts", at("s")).drop("s")
    dec = spark.createDataFrame([(1, 8, "CQ"), (9, 600, "zz")], "marker_id long, s long, message string").withColumn("dec_ts", at("s")).drop("s")
    for name, df in (("a", det), ("b", dec)):
        df.write.parquet(str(tmp_path / name))
    joined = st.stream_attach(st.stream_blocks(spark, str(tmp_path / "a"), det.schema, None),
                              st.stream_blocks(spark, str(tmp_path / "b"), dec.schema, None))
    st.run_to_table(joined, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    got = rows(spark.read.parquet(str(tmp_path / "o")), "marker_id", "message")
    assert (1, "CQ") in got and (2, None) in got and (3, None) not in got


def test_export_of_spots_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("K1TTT", "FN32", 50_260_000, -3, "MSK144", 1)],
                               "de_call string, de_grid string, freq_hz long, snr int, mode string, utc_epoch long")
    for _ in range(2):
        df.write.mode("append").parquet(str(tmp_path / "in"))
        s = st.stream_blocks(spark, str(tmp_path / "in"), df.schema, None)
        tables.export_spots(s, str(tmp_path / "out"), str(tmp_path / "state"), every=None).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("batch_id").count().count() == 2


def late_feed(spark, tmp_path, df, name, order, parts=4, spread=6, seed=3):
    """Files whose rows overlap by up to ``spread`` of ``order`` (a second each), then an end mark; one file a micro-batch."""
    src = str(tmp_path / f"{name}-in")
    rng = random.Random(seed)
    data = df.withColumn("ts", F.timestamp_seconds(F.col(order) + 1_000)).collect()
    schema = df.withColumn("ts", F.timestamp_seconds(F.lit(0))).schema
    at = {id(r): r[order] + rng.randrange(spread) for r in data}
    data.sort(key=lambda r: at[id(r)])
    size = -(-len(data) // parts)
    for k in range(0, len(data), size):
        spark.createDataFrame(data[k:k + size], schema).coalesce(1).write.mode("append").parquet(src)
    st.end_marks(spark, schema, "ts", F.timestamp_seconds(F.lit(10_000_000))).write.mode("append").parquet(src)
    return st.stream_blocks(spark, src, schema, 1)


def test_out_of_order_rows_and_idle_keys(spark, tmp_path):
    rng = random.Random(1)
    df = spark.createDataFrame([("s", c, f) for c in (1, 2) for f in range(120) if rng.random() < 0.4], "stream_id string, channel int, frame long")
    stream = st.stream_cooldown(late_feed(spark, tmp_path, df, "late", "frame"), 9, ts="ts", wait="8 seconds", expire="1 minute")
    query = st.run_to_table(stream, str(tmp_path / "late-out"), str(tmp_path / "late-state"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "late-out"))
    assert rows(got, "channel", "frame") == rows(gates.cooldown(df, 9), "channel", "frame")
    left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(left) >= 2 and left[-1] <= 1  # the keys are idle at the end mark; the mark's own key may remain


def test_tracker_out_of_order(spark, tmp_path):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([("a", i, rng.normal(size=5).tolist()) for i in range(60)], "recording string, frame long, power_db array<double>")
    stream = st.stream_track_median(late_feed(spark, tmp_path, df, "track", "frame"), ts="ts", wait="8 seconds")
    st.run_to_table(stream, str(tmp_path / "t-out"), str(tmp_path / "t-state")).awaitTermination()
    want = recurrence.track_median(df)
    assert rows(spark.read.parquet(str(tmp_path / "t-out")), "frame", "est_db") == rows(want, "frame", "est_db")


def test_event_segments_wait_for_their_blocks(spark, tmp_path):
    """Late blocks are waited for, missing ones are left out, and events near the end leave with what exists."""
    size = 16
    blocks = spark.createDataFrame([("s", b, b * size, [float(b * size + k) for k in range(size)]) for b in range(40) if b not in (11, 25)],
                                   "stream_id string, block_idx long, first_sample long, x array<double>")
    at = [0, 5, 100, 170, 176, 180, 300, 404, 410, 600, 637, 900]
    events = spark.createDataFrame([("s", i, a, a // size) for i, a in enumerate(at)], "stream_id string, event_id long, at long, sec long")
    stream = stream_event_segments(late_feed(spark, tmp_path, blocks, "b", "block_idx"), late_feed(spark, tmp_path, events, "e", "sec", parts=2),
                                   pre=7, post=30, pad=3, block=size, wait="8 seconds", patience="9 seconds", keep="12 seconds")
    st.run_to_table(stream, str(tmp_path / "x-out"), str(tmp_path / "x-state")).awaitTermination()
    want = framing.event_segments(blocks, events, 7, 30, 3, size)
    assert rows(spark.read.parquet(str(tmp_path / "x-out")), "event_id", "x") == rows(want, "event_id", "x")
    assert want.count() == len(at) - 1


def test_runs_to_the_end(spark, tmp_path):
    df = spark.createDataFrame([("s", t, float(t)) for t in (1, 2, 3, 50, 51, 90)], "stream_id string, sec long, metric double")
    runs = st.stream_runs(late_feed(spark, tmp_path, df, "r", "sec", spread=1), "10 seconds")
    st.run_to_table(runs, str(tmp_path / "r-out"), str(tmp_path / "r-state")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "r-out")), "triggers", "peak") == [(1, 90.0), (2, 51.0), (3, 3.0)]
