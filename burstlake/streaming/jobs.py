"""The same operators over unbounded input (Structured Streaming).

State lives in the checkpoint, so a lost executor or driver resumes where it
was. Sequential operators keep their state per stream (or channel) and work
through the rows of each micro-batch in order; a micro-batch is bounded by
``maxFilesPerTrigger``.

Given an event time (``ts``), they wait for late rows instead (``stateful``): rows are
held back until the watermark has passed them and are then worked through in
order, whichever micro-batch brought them, so results are those of batch for all rows that
come within ``wait``; later ones Spark drops. A key that is idle for ``expire`` loses
its state. At the end of an input ``end_marks`` moves the watermark past all that is held.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.numeric import N_CHANNELS
from ..operators.recurrence import gate_rows, track_step
from ..plans.detection import DetectConfig

DOUBLES = T.ArrayType(T.DoubleType())


def stream_blocks(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = 1) -> DataFrame:
    """Blocks (or any parquet rows) as files arrive, ``max_files`` per micro-batch."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off what is there, exactly once, into parquet files."""
    return (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .outputMode(mode).trigger(availableNow=True).start(path))


def with_retention(stream: DataFrame, ts: str = "ts", keep: str = "5 seconds") -> DataFrame:
    """Rows later than ``keep`` behind the newest are dropped by what follows."""
    return stream.withWatermark(ts, keep)


def publish_windows(stream: DataFrame, aggregates: dict[str, Column], keys: Sequence[str] = ("stream_id",),
                    ts: str = "ts", every: str = "15 seconds", keep: str = "5 seconds") -> DataFrame:
    """One row per key and window, published once the window is over."""
    return (with_retention(stream, ts, keep).groupBy(*keys, F.window(ts, every).alias("w"))
            .agg(*[c.alias(name) for name, c in aggregates.items()])
            .select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    *aggregates))


def stream_runs(stream: DataFrame, gap: str, keys: Sequence[str] = ("stream_id",), ts: str = "ts",
                metric: str = "metric", keep: str = "5 seconds") -> DataFrame:
    """Triggers closer than ``gap`` joined to runs; a run appears once nothing can extend it."""
    return (with_retention(stream, ts, keep).groupBy(*keys, F.session_window(ts, gap).alias("w"))
            .agg(F.count("*").alias("triggers"), F.max(metric).alias("peak"), F.max(ts).alias("last_at"))
            .select(*keys, F.col("w.start").alias("run_start"), "last_at", "triggers", "peak"))


def stream_attach(detections: DataFrame, decodes: DataFrame, key: str = "marker_id",
                  keep: str = "30 seconds") -> DataFrame:
    """Detections with the decodes that follow them within ``keep``; without one, null.

    Needs event times det_ts and dec_ts.
    """
    d = detections.withWatermark("det_ts", keep).alias("d")
    m = decodes.withWatermark("dec_ts", keep).alias("m")
    near = (F.col(f"d.{key}") == F.col(f"m.{key}")) & (F.col("dec_ts") >= F.col("det_ts")) & (
        F.col("dec_ts") <= F.col("det_ts") + F.expr(f"INTERVAL {keep}"))
    return d.join(m, near, "leftOuter").select("d.*", F.col("m.dec_ts"), F.col("m.message"))


def _sorted(chunks: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    return pd.concat(list(chunks), ignore_index=True).sort_values(by, kind="stable")


def _keyed(stream: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [stream.schema[k] for k in keys]


def end_marks(spark: SparkSession, schema: T.StructType, ts: str, at: Column) -> DataFrame:
    """One row that says that nothing before ``at`` will follow: only its event time is set.

    Fed behind the last rows of a source, it publishes what windows, runs and held-back
    rows wait for; sequential operators pass over it, and windows keep it to themselves
    as it stands in one that isn't over.
    """
    return spark.range(1).select(*(at.cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))


def _millis(time: str) -> Column:
    return F.expr(f"CAST((unix_micros(timestamp_seconds(0) + INTERVAL {time}) / 1000) AS BIGINT)")


def stateful(stream: DataFrame, keys: Sequence[str], order: str, schema: T.StructType,
             step: Callable[[tuple, pd.DataFrame, object], tuple[pd.DataFrame, object]], ts: str | None = None,
             wait: str = "5 seconds", expire: str = "1 hour") -> DataFrame:
    """Work through each key's rows in ``order`` with a state: step(key, rows, state or None) -> (result rows, state).

    Without ``ts`` the rows of a micro-batch are sorted and taken as they are. With it, rows
    wait in the state until the watermark (``wait`` behind the newest) has passed their event time,
    and the state goes once the key has been idle for ``expire``. The buffer holds the rows of ``wait``.
    """
    kept = T.StructType([T.StructField("state", T.BinaryType())])

    def plain(key, chunks, state: GroupState) -> Iterator[pd.DataFrame]:
        carry = pickle.loads(state.get[0]) if state.exists else None
        out, carry = step(key, _sorted(chunks, order), carry)
        state.update((pickle.dumps(carry),))
        yield out

    if ts is None:
        return stream.groupBy(*keys).applyInPandasWithState(plain, schema, kept, "append", GroupStateTimeout.NoTimeout)
    idle = stream.sparkSession.range(1).select(_millis(expire)).first()[0]
    timed = stream.withColumn("_ms", F.unix_millis(ts)).withWatermark(ts, wait)

    def held_back(key, chunks, state: GroupState) -> Iterator[pd.DataFrame]:
        carry, held, last = pickle.loads(state.get[0]) if state.exists else (None, None, 0)
        late = state.hasTimedOut
        new = [] if late else [c for c in chunks if len(c)]
        if new:
            last = max(last, *(int(c["_ms"].max()) for c in new))
            held = pd.concat([*([] if held is None else [held]), *(c[c[order].notna()] for c in new)], ignore_index=True)
        now = state.getCurrentWatermarkMs()
        if held is not None and len(held):
            due = (held["_ms"] <= now).to_numpy()
            if due.any():
                ready = held[due].sort_values(order, kind="stable")
                out, carry = step(key, ready.astype({order: "int64"}), carry)
                held = held[~due].reset_index(drop=True)
                yield out
        waiting = held is not None and len(held) > 0
        if not waiting and late and now >= last + idle:
            state.remove()
            return
        state.update((pickle.dumps((carry, held if waiting else None, last)),))
        state.setTimeoutTimestamp(max(now + 1, int(held["_ms"].min()) if waiting else last + idle))

    return timed.groupBy(*keys).applyInPandasWithState(held_back, schema, kept, "append", GroupStateTimeout.EventTimeTimeout)


def stream_cooldown(stream: DataFrame, frames: int = 46, keys: Sequence[str] = ("stream_id", "channel"),
                    frame: str = "frame", restart: str | None = None, **timing: str) -> DataFrame:
    """Accepted triggers; the state of a key is the frame at which its pause ends. ``timing`` as in ``stateful``."""
    schema = T.StructType([*_keyed(stream, keys), T.StructField(frame, T.LongType())])

    def step(key, pdf: pd.DataFrame, until):
        until = -(1 << 62) if until is None else until
        kept = []
        again = pdf[restart].tolist() if restart else [False] * len(pdf)
        for at, force in zip(pdf[frame].tolist(), again):
            if force or at >= until:
                if not force:
                    kept.append(at)
                until = at + frames
        return pd.DataFrame({**{k: [v] * len(kept) for k, v in zip(keys, key)}, frame: kept}), until

    return stateful(stream, keys, frame, schema, step, **timing)


def stream_impulse_gate(stream: DataFrame, factor: float = 6.0, frac: float = 0.30, size: int = 256,
                        rate: float = 48_000.0, tau: float = 2.0,
                        keys: Sequence[str] = ("stream_id",), block: int | None = None, **timing: str) -> DataFrame:
    """Blocks (block_idx, i, q) -> (block_idx, n_hot, blanked); the state is the average spectrum.

    Rows may hold ``block`` samples, a multiple of ``size``, as in batch. ``timing`` as in ``stateful``.
    """
    per = (block or size) // size
    schema = T.StructType([*_keyed(stream, keys), T.StructField("block_idx", T.LongType()),
                           T.StructField("n_hot", T.LongType()), T.StructField("blanked", T.BooleanType())])
    alpha = 1.0 - math.exp(-size / (tau * rate))

    def step(key, pdf: pd.DataFrame, avg):
        count, hots, gone, avg = gate_rows(pdf["i"], pdf["q"], size, avg, factor, frac, alpha)
        at = np.concatenate([i * per + np.arange(c) for i, c in zip(pdf["block_idx"], count)])
        return pd.DataFrame({**{k: [v] * len(at) for k, v in zip(keys, key)},
                             "block_idx": at, "n_hot": hots, "blanked": gone}), avg

    return stateful(stream, keys, "block_idx", schema, step, **timing)


def stream_track_median(stream: DataFrame, step_db: float = 0.0625, width: int = 7,
                        keys: Sequence[str] = ("recording",), frame: str = "frame",
                        power: str = "power_db", **timing: str) -> DataFrame:
    """Running per-bin median estimate of each frame; the state is the estimate. ``timing`` as in ``stateful``."""
    schema = T.StructType([*_keyed(stream, keys), T.StructField(frame, T.LongType()),
                           T.StructField("est_db", DOUBLES)])

    def step(key, pdf: pd.DataFrame, est):
        rows = []
        for at, p in zip(pdf[frame].tolist(), pdf[power]):
            p = np.asarray(p, dtype=np.float64)
            est = track_step(p.copy() if est is None else est, p, step_db, width)
            rows.append((*key, at, est.tolist()))
        return pd.DataFrame(rows, columns=schema.names), est

    return stateful(stream, keys, frame, schema, step, **timing)


def stream_detect(stream: DataFrame, cfg: DetectConfig = DetectConfig(),
                  keys: Sequence[str] = ("stream_id",), **timing: str) -> DataFrame:
    """Detections from frames (frame, lin ARRAY of one metric per channel), as in batch.

    A frame needs all its channels for the coincidence gate, so the key is the
    stream. The state is the metric history of ``depth`` frames, the current
    baseline and the end of each channel's pause. ``timing`` as in ``stateful``.
    """
    schema = T.StructType([*_keyed(stream, keys), *[T.StructField(n, t) for n, t in (
        ("frame", T.LongType()), ("channel", T.IntegerType()), ("lin", T.DoubleType()),
        ("metric_db", T.DoubleType()))]])
    slots = -(-cfg.depth // cfg.stride)

    def step(key, pdf: pd.DataFrame, state):
        start = np.empty((0, N_CHANNELS)), np.empty(0, dtype=np.int64), None, np.full(N_CHANNELS, -(1 << 62), dtype=np.int64)
        history, seen, base, until = start if state is None else state
        rows = []
        for frame, lin in zip(pdf["frame"].tolist(), pdf["lin"]):
            lin = np.asarray(lin, dtype=np.float64)
            if frame % cfg.stride == 0:
                history = np.vstack([history, lin])[-slots:]
                seen = np.append(seen, frame)[-slots:]
            if base is None or frame % cfg.refresh == 0:
                past = history[seen > frame - cfg.depth]
                rank = int(len(past) * cfg.quantile)
                base = np.maximum(np.partition(past, rank, axis=0)[rank], cfg.floor)
            db = np.maximum(10.0 * np.log10(np.maximum(lin / base, 1e-30)), 0.0)
            hot = np.flatnonzero(db > cfg.threshold_db)
            if not len(hot):
                continue
            span = hot[-1] - hot[0]
            if cfg.circular and len(hot) > 1:
                span = N_CHANNELS - np.max(np.diff(np.append(hot, hot[0] + N_CHANNELS)))
            if len(hot) >= cfg.max_channels or (len(hot) >= 3 and span > cfg.max_span):
                until[hot] = frame + cfg.cooldown_frames
                continue
            for k in hot:
                if abs(k - N_CHANNELS // 2) > cfg.edge_skip and frame >= until[k]:
                    rows.append((*key, frame, int(k), float(lin[k]), float(db[k])))
                    until[k] = frame + cfg.cooldown_frames
        return pd.DataFrame(rows, columns=schema.names), (history, seen, base, until)

    return stateful(stream, keys, "frame", schema, step, **timing)
