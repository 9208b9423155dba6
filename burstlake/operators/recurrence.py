"""Operators whose state at one block depends on the blocks before it."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import DOUBLES, row_function
from ..scale import cut_lineage, dense_segments, join_keys, scan_segments


#: Time constants after which an average has forgotten its start to 1e-12 though half of the blocks are blanked, and copies of a block at most that
#: a warm-up may take; with shorter segments, states are handed on round by round.
WARM_TAU, MOST_WARM = 60, 64


def gate_blocks(blocks: np.ndarray, avg: np.ndarray | None, factor: float, frac: float, alpha: float):
    """The impulse gate over a matrix of blocks: (hot bins, blanked, last average). Shared with streaming."""
    hots, blanked = np.zeros(len(blocks), dtype=np.int64), np.zeros(len(blocks), dtype=bool)
    if not len(blocks):
        return hots, blanked, avg
    power = np.abs(np.fft.fft(blocks, axis=1)) ** 2
    if avg is None:
        avg = np.maximum(power[0], 1e-30)
    limit = frac * blocks.shape[1]
    for k, p in enumerate(power):
        hots[k] = np.count_nonzero(p > factor * factor * avg)
        if hots[k] > limit:
            blanked[k] = True
        else:
            avg = (1.0 - alpha) * avg + alpha * p
    return hots, blanked, avg


def gate_rows(re, im, size, avg, factor, frac, alpha):
    """``gate_blocks`` on rows of arrays, each cut into blocks of ``size`` samples.

    Returns (blocks per row, hot bins, blanked, last average). A partial last
    block of a row passes and changes nothing.
    """
    whole = np.array([len(a) // size for a in re], dtype=np.int64)
    count = np.array([-(-len(a) // size) for a in re], dtype=np.int64)
    full = np.ones(count.sum(), dtype=bool)
    full[(np.cumsum(count) - 1)[count > whole]] = False
    join = lambda col: np.concatenate([np.asarray(a)[:k * size] for a, k in zip(col, whole)])
    hots, gone = np.zeros(len(full), dtype=np.int64), np.zeros(len(full), dtype=bool)
    if full.any():
        hots[full], gone[full], avg = gate_blocks((join(re) + 1j * join(im)).reshape(-1, size), avg,
                                                  factor, frac, alpha)
    return count, hots, gone, avg


def impulse_gate(blocks: DataFrame, factor: float = 6.0, frac: float = 0.30, size: int = 256,
                 rate: float = 48_000.0, tau: float = 2.0, keys: Sequence[str] = ("stream_id",),
                 re: str = "i", im: str = "q", segment: int = 11_250,
                 block: int | None = None) -> DataFrame:
    """Blocks of ``size`` samples -> (keys, block_idx, n_hot, blanked).

    Rows may hold ``block`` samples, a multiple of ``size``; block_idx of the
    result counts blocks of ``size``.

    A block is blanked when more than ``frac`` of its bins exceed factor^2 times
    their running average; only clean blocks enter the average, which starts from
    the first block. A partial last block passes. A gap in the blocks keeps the
    average. Segments of a stream run in parallel and hand their averages on until
    they agree to 1e-12, not to the last bit: a bin that close to its limit may
    count either way. Segments are entered with the average that ``WARM_TAU`` ``tau`` of
    blocks before them leave, by when it has forgotten its start to that precision; only those
    where it hasn't (long blankings) are entered again.
    """
    keys, per = list(keys), (block or size) // size
    in_seg = max(1, segment // per)
    rows = cut_lineage(blocks.withColumn("_seg", F.floor(F.col("block_idx") / F.lit(in_seg)).cast("long"))
                       .select(*keys, "_seg", "block_idx", F.col(re).cast("array<double>").alias("re"),
                               F.col(im).cast("array<double>").alias("im")))
    rows = dense_segments(rows, keys, "_seg", "_at")
    kept = [f for f in rows.schema.fields if f.name in keys]
    schema = T.StructType([*kept, T.StructField("block_idx", T.LongType()),
                           T.StructField("n_hot", T.LongType()),
                           T.StructField("blanked", T.BooleanType())])
    alpha = 1.0 - math.exp(-size / (tau * rate))

    def step(pdf: pd.DataFrame, state):
        pdf = pdf.sort_values("block_idx")
        count, hots, gone, avg = gate_rows(pdf["re"], pdf["im"], size, np.asarray(state) if state else None,
                                           factor, frac, alpha)
        at = np.concatenate([i * per + np.arange(c) for i, c in zip(pdf["block_idx"], count)])
        out = pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "block_idx": at, "n_hot": hots, "blanked": gone})
        return out, ([] if avg is None else avg.tolist())

    warm = -(-int(WARM_TAU * tau * rate / size) // (in_seg * per))
    return scan_segments(rows, keys, "_at", step, schema, tol=1e-12, warm=warm if warm <= MOST_WARM else 0, order="block_idx")


def gate_mask(blocks: DataFrame, gate: DataFrame, block: int = 8192, size: int = 256,
              keys: Sequence[str] = ("stream_id",), re: str = "i") -> DataFrame:
    """Add ``mask`` to blocks of ``block`` samples: 1.0 where the gate blanked, per sample."""
    flag = F.struct(F.col("block_idx").alias("at"), F.when(F.col("blanked"), 1.0).otherwise(0.0).alias("v"))
    flags = (gate.groupBy(*keys, F.floor(F.col("block_idx") * size / F.lit(block)).cast("long").alias("_b"))
                 .agg(F.sort_array(F.collect_list(flag)).alias("_f"))
                 .withColumnRenamed("_b", "block_idx"))
    wide = F.slice(F.flatten(F.transform("_f", lambda f: F.array_repeat(f["v"], size))), 1, F.size(re))
    return blocks.join(flags, [*keys, "block_idx"]).withColumn("mask", wide).drop("_f")


def envelope(blocks: DataFrame, size: int = 256, rate: float = 48_000.0, tau: float = 2.0,
             keys: Sequence[str] = ("stream_id",), kept: str = "n_ok", level: str = "mean_abs",
             segment: int = 16_384) -> DataFrame:
    """Running mean of kept amplitudes, one row per block (n_ok, mean_abs); null before the first kept one.

    A block of n_ok samples, at most ``size``, has weight 1 - exp(-n_ok / (tau * rate));
    the first kept block has weight 1; a fully blanked block changes nothing,
    however long the blanking lasts. The update is affine, y -> a * y + b, so every
    segment is reduced to one (a, b), these are composed per key in order (one
    small row per segment), and each segment starts from its exact entry value.
    """
    keys = list(keys)
    # exponents within a segment stay far from overflow
    seg = max(1, min(segment, int(400.0 * tau * rate / size)))
    rows = blocks.select(*keys, "block_idx", kept, level).withColumn(
        "_seg", F.floor(F.col("block_idx") / F.lit(seg)).cast("long"))
    used = (F.col(kept) > 0) & F.col(level).isNotNull()
    w = Window.partitionBy(*keys, "_seg").orderBy("block_idx").rowsBetween(Window.unboundedPreceding, 0)
    # y_n = exp(C_n) * (entry + sum of w_i v_i exp(-C_i)), C the running sum of -n_i / (tau * rate);
    # entered with the first kept level, a segment gives that level itself for its first block
    share = F.when(used, -F.col(kept) / F.lit(tau * rate)).otherwise(F.lit(0.0))
    term = F.when(used, (F.lit(1.0) - F.exp("_b")) * F.col(level) * F.exp(-F.col("_c"))).otherwise(F.lit(0.0))
    local = (rows.withColumn("_b", share).withColumn("_c", F.sum("_b").over(w))
                 .withColumn("_own", F.exp("_c") * F.sum(term).over(w))
                 .withColumn("_first", F.first(F.when(used, F.col(level)), ignorenulls=True).over(w)))
    last = local.groupBy(*keys, "_seg").agg(
        F.max_by(F.struct(F.exp("_c").alias("a"), F.col("_own").alias("b"), F.col("_first").alias("v")),
                 "block_idx").alias("_s")).select(*keys, "_seg", "_s.*")
    kept_fields = [f for f in blocks.select(*keys).schema.fields]
    schema = T.StructType([*kept_fields, T.StructField("_seg", T.LongType()), T.StructField("_entry", T.DoubleType())])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_seg")
        y, entry = math.nan, []
        for a, b, v in zip(pdf["a"].tolist(), pdf["b"].tolist(), pdf["v"].astype(float).tolist()):
            entry.append(y)
            if v == v:
                y = a * (v if y != y else y) + b
        return pdf[[*keys, "_seg"]].assign(_entry=[None if e != e else e for e in entry])

    entries = cut_lineage(last.groupBy(*keys).applyInPandas(compose, schema))
    return join_keys(local, entries, [*keys, "_seg"]).select(*keys, "block_idx", (
        F.exp("_c") * F.coalesce("_entry", "_first") + F.col("_own")).alias("envelope"))


def smooth_bins(v: np.ndarray, width: int = 7) -> np.ndarray:
    """Median over neighbouring bins (the last axis) with replicated ends; NaN where a neighbour is."""
    width += (width + 1) % 2
    half = width // 2
    if not half:
        return v
    wide = np.concatenate([v[..., :1].repeat(half, -1), v, v[..., -1:].repeat(half, -1)], axis=-1)
    near = np.lib.stride_tricks.sliding_window_view(wide, width, axis=-1)
    middle = np.partition(near, half, axis=-1)[..., half]
    return np.where(np.isnan(near).any(axis=-1), np.nan, middle) if np.isnan(wide).any() else middle


def mover(size: int, step_db: float, width: int):
    """``track_step`` for one estimate of ``size`` bins after another, on frames smoothed before, without setting up its windows anew."""
    width += (width + 1) % 2
    half = width // 2
    wide = np.empty(size + 2 * half)
    middle, near = wide[half:half + size], np.lib.stride_tricks.sliding_window_view(wide, width)

    def move(est: np.ndarray, smooth: np.ndarray) -> np.ndarray:
        np.add(est, np.where(smooth > est, step_db, -step_db), out=middle)
        wide[:half], wide[half + size:] = middle[0], middle[-1]
        sets = near.copy()
        sets.partition(half, axis=1)
        return sets[:, half]
    return move


def track_step(est: np.ndarray, frame: np.ndarray, step_db: float, width: int) -> np.ndarray:
    """Move each bin one step towards the smoothed frame, then smooth. Shared with streaming."""
    return smooth_bins(est + np.where(smooth_bins(frame, width) > est, step_db, -step_db), width)


def track_median(frames: DataFrame, step_db: float = 0.0625, passes: int = 1, width: int = 7,
                 keys: Sequence[str] = ("recording",), frame: str = "frame", power: str = "power_db") -> DataFrame:
    """Per-bin streaming median of valid frames (an array per row), starting at the first one.

    One pass gives the running series (keys, frame, est_db). More passes replay
    the recording from where the last one ended and give the final estimate per
    key (keys, est_db). A pass is one job: the frames of a recording stream through
    one task in order, which keeps the estimate alone; recordings run in parallel.
    Frames are smoothed before, wherever they are, so that the ordered task only moves the estimate.
    Frames without a spectrum are passed over.
    """
    keys = list(keys)
    raw = frames.where(F.col(power).isNotNull()).select(
        *keys, F.col(frame).cast("long").alias(frame), F.col(power).cast("array<double>").alias("est_db"))
    smoothed = row_function(lambda m: smooth_bins(m, width), DOUBLES)
    rows = cut_lineage(raw.withColumn("est_db", smoothed("est_db")))
    start = -(1 << 63)
    # the estimate starts with the first frame as it is
    ends = cut_lineage(raw.groupBy(*keys).agg(F.min(F.struct(frame, "est_db"))["est_db"].alias("est_db"))
                       .select(*keys, F.lit(start).cast("long").alias(frame), "est_db"))

    def walk(series: bool):
        def run(batches):
            key, est, move = None, None, None
            for pdf in batches:
                out = []
                for *k, at, p in zip(*[pdf[c].tolist() for c in [*keys, frame]], pdf["est_db"]):
                    k, p = tuple(None if v != v else v for v in k), np.asarray(p)
                    if k != key:
                        if key is not None and not series:
                            out.append((*key, start, est.tolist()))
                        key = k
                    # a row before all frames holds the estimate the last pass ended with
                    if at == start:
                        est = p
                        # an estimate without NaN never gets one
                        if np.isnan(p).any():
                            move = lambda e, s: smooth_bins(e + np.where(s > e, step_db, -step_db), width)
                        else:
                            move = mover(len(p), step_db, width)
                        continue
                    est = move(est, p)
                    if series:
                        out.append((*k, at, est.tolist()))
                yield pd.DataFrame(out, columns=[*keys, frame, "est_db"])
            if key is not None and not series:
                yield pd.DataFrame([(*key, start, est.tolist())], columns=[*keys, frame, "est_db"])
        return run

    def one_pass(ends: DataFrame, series: bool) -> DataFrame:
        return (rows.unionByName(ends).repartition(*keys).sortWithinPartitions(*keys, frame)
                    .mapInPandas(walk(series), rows.schema))

    if passes == 1:
        return one_pass(ends, True)
    for _ in range(passes):
        ends = cut_lineage(one_pass(ends, False))
    return ends.select(*keys, "est_db")
