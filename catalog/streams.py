"""Streaming queries and sinks: each runs a stream (or write) over the tables and reads the result back."""

from __future__ import annotations

from pyspark.sql import functions as F

from burstlake.operators import framing, spectra
from burstlake.plans import comparison, jobs
from burstlake.scale import cut_lineage, fresh_dir
from burstlake.sinks import tables
from burstlake.sources import logs
from burstlake.streaming import jobs as st
from burstlake.streaming.extract import stream_event_segments

from . import detection as det
from . import records as rec
from . import signals as sig
from .bindings import HEAT, IQ32, TRUTH, epoch_us, heat, iq32, log, messages, table, truth
from .detection import r


def staged(spark, df, name):
    """Write rows as a table in the shared folder and stream it."""
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return st.stream_blocks(spark, path, df.schema, max_files=None)


def in_parts(spark, df, name, order, parts=3, files=2):
    """The same in ``parts`` micro-batches along ``order``, so that state is handed on."""
    path = fresh_dir(spark, name)
    rows = cut_lineage(df)
    lo, hi = rows.agg(F.min(order), F.max(order)).first()
    if lo is None:
        rows.write.parquet(path)
        return st.stream_blocks(spark, path, df.schema, max_files=None)
    width = (hi - lo) // parts + 1
    for k in range(parts):
        part = rows.where((F.col(order) >= lo + k * width) & (F.col(order) < lo + (k + 1) * width))
        part.repartition(files).write.mode("append").parquet(path)
    return st.stream_blocks(spark, path, df.schema, max_files=files)


def finished(spark, stream, name):
    path = fresh_dir(spark, name)
    st.run_to_table(stream, path, fresh_dir(spark, name + "-state")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def second(order):
    return F.timestamp_seconds(F.lit(1_700_000_000) + order)


def out_of_order(spark, df, name, order, parts=3, spread=8):
    """The same in micro-batches whose rows overlap by up to ``spread`` of ``order``, one second each, then an end mark."""
    path = fresh_dir(spark, name)
    rows = cut_lineage(df.withColumn("ts", second(F.col(order))).withColumn("_at", F.col(order) + F.pmod(F.xxhash64(*df.columns), F.lit(spread))))
    lo, hi = rows.agg(F.min("_at"), F.max("_at")).first()
    schema = rows.drop("_at").schema
    width = ((hi or 0) - (lo or 0)) // parts + 1
    for k in range(parts if lo is not None else 0):
        part = rows.where((F.col("_at") >= lo + k * width) & (F.col("_at") < lo + (k + 1) * width)).drop("_at")
        part.coalesce(1).write.mode("append").parquet(path)
    st.end_marks(spark, schema, "ts", second(F.lit((hi or 0) + 100_000))).write.mode("append").parquet(path)
    return st.stream_blocks(spark, path, schema, max_files=1)


def events(spark, sf):
    return table(spark, sf, "events").select(F.col("event_type").alias("stream_id"), "event_id",
                                             F.timestamp_micros(epoch_us()).alias("ts"), F.col("value").alias("metric"))


def windows(spark, sf):
    s = staged(spark, events(spark, sf), "events")
    out = st.publish_windows(s, {"n": F.count("*"), "peak": F.max("metric")}, every="1 hour", keep="10 minutes")
    return finished(spark, out, "windows").select("stream_id", F.unix_seconds("window_start").alias("window_start"), "n", "peak")


def sessions(spark, sf):
    s = staged(spark, events(spark, sf).where("metric > 40"), "triggers")
    out = st.stream_runs(s, "2 hours", keep="10 minutes")
    return finished(spark, out, "runs").select("stream_id", F.unix_micros("run_start").alias("start_us"),
                                               F.unix_micros("last_at").alias("last_us"), "triggers", "peak")


# a run is out once the newest trigger, less ten minutes, has passed its end plus the gap
SESSIONS_SQL = """WITH e AS (SELECT event_type AS stream_id, epoch_us(ts) AS us, value FROM events WHERE value > 40),
  l AS (SELECT *, us - lag(us) OVER (PARTITION BY stream_id ORDER BY us) AS d FROM e),
  i AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY us) AS run FROM l)
SELECT stream_id, min(us) AS start_us, max(us) AS last_us, count(*) AS triggers, max(value) AS peak FROM i GROUP BY stream_id, run
HAVING max(us) + 7200000000 <= (SELECT max(us) // 1000 * 1000 FROM e) - 600000000"""


def cooldown(spark, sf):
    s = in_parts(spark, heat(spark, sf).where("lin > 60"), "hot", "frame")
    return finished(spark, st.stream_cooldown(s, 6), "cooldown").select("frame", "channel")


def cooldown_late(spark, sf):
    """Triggers out of order over micro-batches, held back until the watermark has passed them."""
    s = out_of_order(spark, heat(spark, sf).where("lin > 60"), "hot", "frame")
    return finished(spark, st.stream_cooldown(s, 6, ts="ts", wait="10 seconds"), "cooldown").select("frame", "channel")


def extract_late(spark, sf):
    """Blocks and events out of order; an event waits for the blocks of its window, the stream's last ones for the end mark."""
    series = sig.series(spark, sf)
    hits = series.where("x > 150").select("stream_id", F.col("n").alias("event_id"), F.col("n").alias("at"), F.floor(F.col("n") / 128).alias("sec"))
    blocks = out_of_order(spark, framing.to_blocks(series, 128).select("stream_id", "block_idx", "first_sample", "x"), "blocks", "block_idx", spread=3)
    seg = stream_event_segments(blocks, out_of_order(spark, hits, "hits", "sec", spread=3), 20, 45, 4, 128, wait="5 seconds", keep="20 seconds",
                                patience="10 seconds")
    return sig.frame_rows(finished(spark, seg, "segments").withColumnRenamed("event_id", "frame")).select(
        "stream_id", F.col("frame").alias("event_id"), "pos", r(F.col("x")).alias("x"))


def sessions_ended(spark, sf):
    """Runs of triggers with an end mark behind them: the last run is published too."""
    rows = events(spark, sf).where("metric > 40")
    path = fresh_dir(spark, "triggers")
    rows.write.parquet(path)
    end = rows.agg(F.max("ts")).select(F.coalesce(F.col("max(ts)"), F.timestamp_seconds(F.lit(0)))).first()[0]
    st.end_marks(spark, rows.schema, "ts", F.lit(end) + F.expr("INTERVAL 100 DAYS")).write.mode("append").parquet(path)
    out = st.stream_runs(st.stream_blocks(spark, path, rows.schema, max_files=None), "2 hours", keep="10 minutes")
    return finished(spark, out, "runs").select("stream_id", F.unix_micros("run_start").alias("start_us"),
                                               F.unix_micros("last_at").alias("last_us"), "triggers", "peak")


def detect(spark, sf):
    h = heat(spark, sf).groupBy("stream_id", "frame").agg(
        F.sort_array(F.collect_list(F.struct("channel", "lin"))).alias("c")).select("stream_id", "frame", F.col("c.lin").alias("lin"))
    out = finished(spark, st.stream_detect(in_parts(spark, h, "frames", "frame"), det.CFG), "detections")
    return out.select("frame", "channel", r(F.col("lin")).alias("lin"), r(F.col("metric_db"), 4).alias("metric_db"))


def impulse(spark, sf):
    s = in_parts(spark, sig.gate_blocks(spark, sf), "blocks", "block_idx")
    out = st.stream_impulse_gate(s, factor=1.4, size=16, rate=160.0)
    return finished(spark, out, "gate").select("stream_id", "block_idx", "n_hot", "blanked")


def tracker(spark, sf):
    s = in_parts(spark, sig.frames(spark, sf).withColumnRenamed("x", "power_db"), "spectra", "frame")
    out = finished(spark, st.stream_track_median(s), "tracker")
    return sig.bins(out, "est_db", "frame").select("frame", "bin", r(F.col("_v"), 6).alias("est_db"))


def attach(spark, sf):
    """Detections with and without a decode; a later row on each side moves the watermark past the rest."""
    at = lambda n: F.timestamp_seconds(F.lit(1_700_000_000) + n)
    late = lambda name, no: spark.range(1).select(F.lit(no).cast("long").alias("marker_id"), at(F.lit(300_000_000)).alias(name))
    d = truth(spark, sf).select(F.col("truth_no").alias("marker_id"), at(F.col("truth_no")).alias("det_ts"))
    m = log(spark, sf).select((F.col("line_no") - F.col("line_no") % 4).alias("marker_id"), "message",
                              at(F.col("line_no")).alias("dec_ts"))
    d = d.unionByName(late("det_ts", -1))
    m = m.unionByName(late("dec_ts", -2).withColumn("message", F.lit("")))
    out = finished(spark, st.stream_attach(staged(spark, d, "det"), staged(spark, m, "dec")), "attached")
    return out.select("marker_id", F.unix_seconds("dec_ts").alias("decoded_at"), "message")


def spot_export(spark, sf):
    """Spots exported in batches, read back from the batch folders."""
    src = staged(spark, messages(spark, sf), "messages")
    spots = jobs.spots(src, "A0AA").select("de_call", "de_grid", "freq_hz", "snr", "mode", F.col("id").alias("utc_epoch"))
    path = fresh_dir(spark, "spots")
    tables.export_spots(spots, path, fresh_dir(spark, "spots-state"), every=None).awaitTermination()
    return spark.read.parquet(path).drop("batch_id")


def log_sink(spark, sf):
    """Decode rows appended as JSON lines and read back."""
    rows = rec.log_rows(spark, sf).where("outcome = 'decoded'").select(
        F.lit("2024-01-01_00:00:00.0").alias("timestamp"), F.col("id").cast("double").alias("t_sec"), "radio_khz", "message",
        "jt9_snr_db", "jt9_line")
    path = fresh_dir(spark, "decodes")
    tables.write_log(rows, path)
    return logs.read_decode_log(spark, path, since="2023-12-31").select("t_sec", "radio_khz", "message", "jt9_snr_db", "jt9_line")


LOG_SINK_SQL = "WITH " + rec.OUTPUTS + """
SELECT id::DOUBLE AS t_sec, round_even(50.26::DOUBLE * 1000 + (fc_hz - 1500) / 1000, 0)::BIGINT AS radio_khz, msg AS message,
  coalesce(dsnr, est_snr) AS jt9_snr_db, line AS jt9_line FROM po WHERE line IS NOT NULL"""


def report_sink(spark, sf):
    """Two runs of the report; the first is written twice and must not double."""
    out = comparison.report(truth(spark, sf), log(spark, sf), freq_tol=rec.FREQ_TOL, time_tol=rec.TIME_TOL)
    rows = cut_lineage(out.withColumnRenamed("run_id", "user_id")
                       .select("user_id", "total", "decoded", "garbled", "missed", "false_alarms"))
    path = fresh_dir(spark, "reports")
    for run in (1, 2, 1):
        tables.write_report(rows, path, run)
    return spark.read.parquet(path)


def spectrogram_sink(spark, sf):
    w = spectra.waterfall()
    rows = iq32(spark, sf).select(F.pmod("frame", F.lit(3)).cast("string").alias("stream_id"),
                                  F.floor(F.col("frame") / 100).alias("window_id"), "frame", w("re", "im").alias("power_db"))
    path = fresh_dir(spark, "spectrogram")
    tables.write_spectrogram(rows, path)
    back = spark.read.parquet(path)
    return sig.bins(back, "power_db", "stream_id", "window_id", "frame").select(
        F.col("stream_id").cast("bigint").alias("stream_id"), F.col("window_id").cast("bigint").alias("window_id"), "frame", "bin",
        r(F.col("_v"), 4).alias("power_db"))


QUERIES = {
    "stream_publish_windows": windows,
    "stream_runs": sessions,
    "stream_runs_to_end": sessions_ended,
    "stream_cooldown": cooldown,
    "stream_cooldown_out_of_order": cooldown_late,
    "stream_event_segments": extract_late,
    "stream_detect_bursts": detect,
    "stream_impulse_gate": impulse,
    "stream_median_tracker": tracker,
    "stream_attach_decodes": attach,
    "export_spots": spot_export,
    "write_decode_log": log_sink,
    "write_report": report_sink,
    "write_spectrogram": spectrogram_sink,
}

SQL = {
    "stream_publish_windows": """SELECT event_type AS stream_id, epoch_us(ts) // 3600000000 * 3600 AS window_start, count(*) AS n, max(value) AS peak
FROM events GROUP BY 1, 2 HAVING (epoch_us(any_value(ts)) // 3600000000 + 1) * 3600000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events) - 600000""",
    "stream_runs": SESSIONS_SQL,
    "stream_cooldown": "WITH RECURSIVE " + HEAT + """,
  hot AS (SELECT *, false AS restart FROM heat WHERE lin > 60),""" + det.cooldown_sql("hot", 6)
        + "\nSELECT frame, channel FROM fold WHERE kept",
    "stream_runs_to_end": SESSIONS_SQL[:SESSIONS_SQL.index("\nHAVING")],
    "stream_cooldown_out_of_order": "WITH RECURSIVE " + HEAT + """,
  hot AS (SELECT *, false AS restart FROM heat WHERE lin > 60),""" + det.cooldown_sql("hot", 6)
        + "\nSELECT frame, channel FROM fold WHERE kept",
    "stream_event_segments": sig.SQL["event_segments"],
    "stream_detect_bursts": "SELECT frame, channel, lin, metric_db FROM (" + det.DETECT + ")",
    "stream_impulse_gate": sig.SQL["impulse_gate"],
    "stream_median_tracker": sig.SQL["median_tracker_series"],
    "stream_attach_decodes": "WITH " + TRUTH + """
SELECT truth_no AS marker_id, 1700000000 + line_no AS decoded_at, message FROM truth LEFT JOIN log ON line_no - line_no % 4 = truth_no""",
    "export_spots": "SELECT de_call, de_grid, freq_hz, snr, mode, id AS utc_epoch FROM (" + rec.spots_sql(True) + ")",
    "write_decode_log": LOG_SINK_SQL,
    "write_report": "WITH " + rec.claims_sql(True) + """,
  a AS (SELECT run_id, count(*) AS false_alarms FROM alarms GROUP BY 1),
  s AS (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status = 'DECODED') AS decoded,
    count(*) FILTER (WHERE status = 'MISSED') AS missed, count(*) FILTER (WHERE status = 'GARBLED') AS garbled FROM st GROUP BY 1)
SELECT run_id AS user_id, coalesce(total, 0) AS total, coalesce(decoded, 0) AS decoded, coalesce(garbled, 0) AS garbled,
  coalesce(missed, 0) AS missed, coalesce(false_alarms, 0) AS false_alarms, unnest([1, 2])::INT AS run_id FROM s FULL JOIN a USING (run_id)""",
    "write_spectrogram": "SELECT frame % 3 AS stream_id, frame // 100 AS window_id, frame, bin, power_db FROM ("
        + sig.SQL["waterfall_frames"] + ")",
}
