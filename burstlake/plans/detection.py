"""From per-channel metrics to detections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import EDGE_SKIP, carrier_hz, channel_hz, not_edge
from ..operators.baseline import metric_db, rolling_quantile
from ..operators.filters import channel_metrics, soft_blank
from ..operators.gates import coincidence_gate, cooldown
from ..operators.recurrence import gate_mask, impulse_gate
from ..scale import cut_lineage

#: Samples per block of the impulse gate.
GATE_SIZE = 256


@dataclass(frozen=True)
class DetectConfig:
    # Fixed values of the detection chain.
    threshold_db: float = 3.5
    depth: int = 300
    quantile: float = 0.25
    stride: int = 3
    refresh: int = 10
    floor: float = 1e-30
    max_channels: int = 8
    max_span: int = 5
    circular: bool = False
    edge_skip: int = EDGE_SKIP
    cooldown_frames: int = 46


def metrics(df: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Add ``baseline`` and ``metric_db`` to rows (stream_id, frame, channel, lin, ...)."""
    based = rolling_quantile(df, depth=cfg.depth, q=cfg.quantile, stride=cfg.stride,
                             refresh=cfg.refresh, floor=cfg.floor)
    return based.withColumn("metric_db", metric_db(F.col("lin"), F.col("baseline")))


def gated_triggers(metric_rows: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    return coincidence_gate(metric_rows.where(F.col("metric_db") > cfg.threshold_db),
                            cfg.max_channels, cfg.max_span, cfg.circular)


def detect(df: DataFrame, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Detections: baseline, threshold, coincidence gate, edge skip, cooldown, carrier.

    Gated triggers restart their channel's pause, so the pause runs over gated
    rows and candidates together. With columns lo_hz and hi_hz the carrier is
    taken from the tone pair, otherwise it is the channel centre.
    """
    hot = gated_triggers(metrics(df, cfg), cfg)
    rows = hot.where(F.col("gated") | not_edge(F.col("channel"), cfg.edge_skip))
    tones = [c for c in ("lo_hz", "hi_hz") if c in df.columns]
    found = cooldown(rows, cfg.cooldown_frames, restart=F.col("gated"),
                     payload=["lin", "baseline", "metric_db", *tones])
    fc = (carrier_hz(F.col("lo_hz"), F.col("hi_hz"), F.col("channel")) if len(tones) == 2
          else channel_hz(F.col("channel")))
    return found.withColumn("fc_hz", fc)


def receive(blocks: DataFrame, cfg: DetectConfig = DetectConfig(), block: int = 8192,
            rate: float = 48_000.0, blank: bool = True) -> DataFrame:
    """Sample blocks (stream_id, block_idx, first_sample, i, q) to detections.

    Impulses are gated and blanked, then the metrics of all channels measured.
    The metrics, one row per frame and channel, are written once, as the
    detection chain is much smaller than the signal work before it.
    """
    if blank:
        gate = impulse_gate(blocks, size=GATE_SIZE, rate=rate, block=block)
        blocks = soft_blank(gate_mask(blocks, gate, block, GATE_SIZE), cols=("i", "q"))
    return detect(cut_lineage(channel_metrics(blocks, block, rate)), cfg)
