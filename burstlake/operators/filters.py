"""FIR filters, decimation, resampling, spectral filters and the channeliser."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.arrow import CHUNK, DOUBLES, row_function
from ..functions.numeric import N_CHANNELS, OFFSET_HZ, SPACING_HZ
from ..scale import drop_halo, with_halo
from .framing import KEYS, with_edges
from .spectra import tone_levels

_DOUBLES = T.ArrayType(T.DoubleType())

#: Samples per window segment of the long-row filters.
SEGMENT = 65_536
#: Longest row the spectral filters on rows accept; ``transforms.spectral_blocks`` takes recordings of any length.
MAX_RECORDING = 20_000_000


def fir_taps(n: int, cutoff: float, rate: float, pass_zero: bool = True) -> list[float]:
    """Hamming-windowed sinc with unit gain at DC (low-pass) or at Nyquist (high-pass)."""
    k = np.arange(n) - (n - 1) / 2.0
    c = 2.0 * cutoff / rate
    low = c * np.sinc(c * k)
    ham = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
    if pass_zero:
        h = low * ham
        return (h / h.sum()).tolist()
    h = (np.sinc(k) - low) * ham
    return (h / np.sum(h * np.cos(np.pi * k))).tolist()


# -- long rows: short filters as window expressions --------------------------

def fir_samples(df: DataFrame, taps: Sequence[float], cols: Sequence[str] = ("x",),
                keys: Sequence[str] = KEYS, n: str = "n", segment: int = SEGMENT) -> DataFrame:
    """Causal FIR with zero initial state, stays in the JVM; for short filters."""
    w = Window.partitionBy(*keys, "segment").orderBy(n)
    halo = with_halo(df, n, segment, before=len(taps) - 1)
    filtered = {c: sum((F.lag(c, k, 0.0).over(w) * F.lit(float(b)) for k, b in enumerate(taps) if k),
                       F.col(c) * F.lit(float(taps[0]))) for c in cols}
    return drop_halo(halo.withColumns(filtered))


def decimate_samples(df: DataFrame, m: int, taps: Sequence[float], cols: Sequence[str] = ("x",),
                     keys: Sequence[str] = KEYS, n: str = "n") -> DataFrame:
    """Filter, then keep absolute sample numbers divisible by ``m`` and renumber."""
    return (fir_samples(df, taps, cols, keys, n).where(F.pmod(F.col(n), F.lit(m)) == 0)
            .withColumn(n, F.floor(F.col(n) / F.lit(m)).cast("long")))


# -- blocks: any length, one convolution per block ---------------------------

def _convolver(taps: Sequence[float], step: int = 1):
    h = np.asarray(taps, dtype=np.float64)

    def run(head, x):
        full = np.concatenate([head, x], axis=1)
        return np.stack([np.convolve(row, h, mode="valid")[::step] for row in full]) \
            if x.shape[1] else x
    return row_function(run, DOUBLES)


def fir(blocks: DataFrame, taps: Sequence[float], cols: Sequence[str] = ("x",),
        keys: Sequence[str] = KEYS) -> DataFrame:
    """Causal FIR with zero initial state on blocks."""
    conv = _convolver(taps)
    edged = with_edges(blocks, cols, before=len(taps) - 1, keys=keys)
    return edged.select(*[conv(F.col(f"{c}_head"), F.col(c).cast(DOUBLES)).alias(c) if c in cols
                          else F.col(c) for c in blocks.columns])


def decimate(blocks: DataFrame, m: int, taps: Sequence[float], cols: Sequence[str] = ("x",),
             keys: Sequence[str] = KEYS) -> DataFrame:
    """Filter and keep every ``m``-th sample; block lengths must be multiples of ``m``."""
    conv = _convolver(taps, m)
    edged = with_edges(blocks, cols, before=len(taps) - 1, keys=keys)
    out = {c: conv(F.col(f"{c}_head"), F.col(c).cast(DOUBLES)).alias(c) for c in cols}
    out["first_sample"] = F.floor(F.col("first_sample") / F.lit(m)).cast("long").alias("first_sample")
    return edged.select(*[out.get(c, F.col(c)) for c in blocks.columns])


def halve(blocks: DataFrame, times: int, taps: Sequence[float], cols: Sequence[str] = ("x",),
          keys: Sequence[str] = KEYS) -> DataFrame:
    """Cascade of decimations by two."""
    for _ in range(times):
        blocks = decimate(blocks, 2, taps, cols, keys)
    return blocks


def soft_blank(blocks: DataFrame, half: int = 24, cols: Sequence[str] = ("x",), mask: str = "mask",
               keys: Sequence[str] = KEYS) -> DataFrame:
    """Multiply by 1 - min(mask convolved with a Hann bump of 2 * half + 1 points, 1)."""
    bump = np.hanning(2 * half + 1)
    bump = bump / bump.max()

    def run(head, body, tail):
        full = np.concatenate([head, body, tail], axis=1)
        return np.stack([1.0 - np.minimum(np.convolve(row, bump, mode="valid"), 1.0) if row.any()
                         else np.ones(body.shape[1]) for row in full])
    gain, product = row_function(run, DOUBLES), row_function(lambda x, g: x * g, DOUBLES)
    edged = with_edges(blocks, [mask], before=half, after=half, keys=keys)
    kept = gain(F.col(f"{mask}_head"), F.col(mask).cast(DOUBLES), F.col(f"{mask}_tail"))
    return (edged.withColumns({c: product(F.col(c).cast(DOUBLES), kept) for c in cols})
                 .drop(f"{mask}_head", f"{mask}_tail"))


# -- resampling ---------------------------------------------------------------

def resample_linear(df: DataFrame, src: int, dst: int, cols: Sequence[str] = ("x",),
                    keys: Sequence[str] = KEYS, n: str = "n", segment: int = SEGMENT) -> DataFrame:
    """round(N * dst / src) points, evenly spaced over the N samples of each stream.

    Sample k produces the target points that fall in [k, k + 1), so no join on
    target points is needed; only the stream's length is joined in.
    """
    length = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys, "segment").orderBy(n)
    nxt = drop_halo(with_halo(df, n, segment, after=1)
                    .withColumns({f"_next_{c}": F.lead(c).over(w) for c in cols}))
    rows = nxt.join(length, list(keys)).withColumn(
        "_m", F.rint(F.col("_n") * F.lit(dst / src)).cast("long"))
    span = F.greatest(F.col("_n") - 1, F.lit(1))
    at = lambda k: F.ceil(k * (F.col("_m") - 1) / span).cast("long")
    first = at(F.col(n))
    last = F.when(F.col(n) == F.col("_n") - 1, F.col("_m") - 1).otherwise(at(F.col(n) + 1) - 1)
    spread = rows.where(last >= first).withColumn("_j", F.explode(F.sequence(first, last)))
    frac = F.col("_j") * span / F.greatest(F.col("_m") - 1, F.lit(1)) - F.col(n)
    return spread.select(*keys, F.col("_j").alias(n), *[
        (F.col(c) + (F.coalesce(F.col(f"_next_{c}"), F.col(c)) - F.col(c)) * frac).alias(c)
        for c in cols])


# -- whole recordings in one row ----------------------------------------------

def _bounded(x):
    if x.shape[1] > MAX_RECORDING:
        raise ValueError("recording too long for a whole-recording filter: cut it first")
    return x


def _cosine(f: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """0 below lo, half-cosine rise to 1 at hi."""
    if hi <= lo:
        return (f >= hi).astype(float)
    t = np.clip((f - lo) / (hi - lo), 0.0, 1.0)
    return 0.5 - 0.5 * np.cos(np.pi * t)


def _hz(k: np.ndarray, n: int, rate: float) -> np.ndarray:
    """Absolute frequency of bins of a transform of ``n`` samples."""
    return np.minimum(k, n - k) * (rate / n)


def lowpass_gain(rate: float, cutoff: float, taper: float = 0.10):
    """Gain of bin numbers: keep |f| <= cutoff with a cosine edge."""
    return lambda k, n: 1.0 - _cosine(_hz(k, n, rate), cutoff, cutoff * (1.0 + taper))


def bandpass_gain(rate: float, lo: float, hi: float):
    """Gain of bin numbers: pass lo..hi, cosine edges of max(10 Hz, 10 %)."""
    edge = max(10.0, 0.10 * (hi - lo))

    def gain(k, n):
        f = _hz(k, n, rate)
        return _cosine(f, max(0.0, lo - edge), lo) * (1.0 - _cosine(f, hi, hi + edge))
    return gain


def equalise_gain(rate: float, cutoff: float, correction_db: Sequence[float], nfft: int):
    """Gain of bin numbers: per-bin correction (a spectrum of nfft / 2 + 1 bins), then roll-off above cutoff."""
    corr = np.asarray(correction_db, dtype=np.float64)
    corr_hz = np.fft.rfftfreq(nfft, 1.0 / rate)[: len(corr)]

    def gain(k, n):
        f = _hz(k, n, rate)
        level = np.interp(f, corr_hz, corr, left=0.0, right=0.0) - 60.0 * _cosine(f, cutoff, 2.0 * cutoff)
        return np.where(f > 2.0 * cutoff, 0.0, 10.0 ** (level / 20.0))
    return gain


def analytic_gain(k, n):
    """Gain of bin numbers: positive frequencies doubled, negative ones gone."""
    return np.where((k == 0) | (2 * k == n), 1.0, np.where(2 * k < n, 2.0, 0.0))


def _on_real(gain):
    def run(x):
        n = _bounded(x).shape[1]
        return np.fft.irfft(np.fft.rfft(x, axis=1) * gain(np.arange(n // 2 + 1), n), n=n, axis=1)
    return row_function(run, DOUBLES)


def fft_lowpass(rate: float, cutoff: float, taper: float = 0.10):
    """Column function (re, im) -> struct(re, im): keep |f| <= cutoff with a cosine edge."""
    gain = lowpass_gain(rate, cutoff, taper)

    def run(re, im):
        n = _bounded(re).shape[1]
        y = np.fft.ifft(np.fft.fft(re + 1j * im, axis=1) * gain(np.arange(n), n), axis=1)
        return y.real, y.imag
    return row_function(run, [("re", DOUBLES), ("im", DOUBLES)])


def fft_bandpass(rate: float, lo: float, hi: float):
    """Column function on real arrays: pass lo..hi, cosine edges of max(10 Hz, 10 %)."""
    return _on_real(bandpass_gain(rate, lo, hi))


def fft_equalise(rate: float, cutoff: float, correction_db: Sequence[float], nfft: int):
    """Column function on real arrays: per-bin correction, then roll-off above cutoff.

    ``correction_db`` is one table for all recordings (a spectrum of nfft / 2 + 1 bins).
    """
    return _on_real(equalise_gain(rate, cutoff, correction_db, nfft))


def analytic():
    """Column function on real arrays: struct(re, im) without negative frequencies."""
    def run(x):
        n = _bounded(x).shape[1]
        y = np.fft.ifft(np.fft.fft(x, axis=1) * analytic_gain(np.arange(n), n), axis=1)
        return y.real, y.imag
    return row_function(run, [("re", DOUBLES), ("im", DOUBLES)])


# -- channeliser ---------------------------------------------------------------

class ChannelBank:
    """Mix to 0 Hz, low-pass, keep every m-th sample, high-pass, for all channels at once.

    With both filters linear and the mixer fixed to absolute sample numbers, a
    channel is one FIR c (low-pass convolved with the spread high-pass) whose taps
    turn with the channel frequency: y[k] = e^{-j w m k} * sum_n c[n] e^{j w n} x[m k - n].
    That is a matrix product of sample windows with a table of taps.
    """

    def __init__(self, rate: float, n: int, spacing: float, offset: float, m: int,
                 lowpass: Sequence[float] | None, highpass: Sequence[float] | None):
        lp = np.asarray(lowpass or fir_taps(7, 2700.0, rate))
        hp = np.asarray(highpass or fir_taps(9, 300.0, rate / m, pass_zero=False))
        spread = np.zeros((len(hp) - 1) * m + 1)
        spread[::m] = hp
        both = np.convolve(lp, spread)
        self.rate, self.m = rate, m
        self.hz = np.arange(n) * spacing + offset
        #: Samples of the past that an output needs.
        self.memory = len(both) - 1
        at = np.arange(len(both))
        self.taps = (both[:, None] * np.exp(2j * np.pi * np.outer(at, self.hz) / rate))[::-1]
        self.turning = np.empty((0, n))

    def __call__(self, x: np.ndarray, first: int) -> np.ndarray:
        """Channels x outputs from ``memory`` earlier samples and the block that starts at ``first``."""
        rows = np.lib.stride_tricks.sliding_window_view(x, self.memory + 1)[::self.m]
        if len(self.turning) < len(rows):
            turns = np.mod(np.outer(self.m * np.arange(len(rows)), self.hz), self.rate) / self.rate
            self.turning = np.exp(-2j * np.pi * turns)
        start = np.exp(-2j * np.pi * (np.mod(self.hz * first, self.rate) / self.rate))
        return ((np.ascontiguousarray(rows) @ (self.taps * start)) * self.turning[:len(rows)]).T


def channelise(blocks: DataFrame, rate: float = 48_000.0, n: int = N_CHANNELS,
               spacing: float = SPACING_HZ, offset: float = OFFSET_HZ, m: int = 4,
               lowpass: Sequence[float] | None = None, highpass: Sequence[float] | None = None,
               keys: Sequence[str] = KEYS, re: str = "i", im: str = "q") -> DataFrame:
    """Split each block into ``n`` channels; one output row per block and channel.

    Blocks are independent: each gets the causal memory of the filters from its
    predecessor. Block lengths must be multiples of ``m``. The output is
    n / m times the input: use ``channel_metrics`` when only metrics are wanted.
    """
    bank = ChannelBank(rate, n, spacing, offset, m, lowpass, highpass)
    edged = with_edges(blocks, [re, im], before=bank.memory, keys=keys)

    whole = lambda c: F.concat(f"{c}_head", F.col(c).cast(DOUBLES)).alias(c)
    rows = edged.select(*keys, "block_idx", F.col("first_sample").cast("bigint").alias("first_sample"), whole(re), whole(im))
    own = [f for f in rows.schema.fields if f.name in (*keys, "block_idx")]
    schema = T.StructType([*own, T.StructField("channel", T.IntegerType()), T.StructField("first_sample", T.LongType()),
                           T.StructField(re, _DOUBLES), T.StructField(im, _DOUBLES)])

    def channels(batch: pa.RecordBatch, at: list[int], made: list[np.ndarray]) -> pa.RecordBatch:
        size = np.repeat([y.shape[1] for y in made], n)
        part = lambda f: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)),
                                                  pa.array(np.concatenate([f(y).ravel() for y in made])))
        rows = pa.array(np.repeat(at, n))
        return pa.RecordBatch.from_arrays(
            [*(batch.column(f.name).take(rows) for f in own), pa.array(np.tile(np.arange(n, dtype=np.int32), len(made))),
             pa.array(batch.column("first_sample").take(rows).to_numpy(zero_copy_only=False) // m), part(np.real), part(np.imag)],
            names=schema.names)

    def split(batches):
        """What a block gives is n / m times as long, so batches come out ``CHUNK`` values at a time."""
        for batch in batches:
            at, made, held = [], [], 0
            for k, (first, x) in enumerate(_complex_rows(*(batch.column(c) for c in ("first_sample", re, im)))):
                at.append(k)
                made.append(bank(x, first))
                held += made[-1].size
                if held >= CHUNK:
                    yield channels(batch, at, made)
                    at, made, held = [], [], 0
            if made:
                yield channels(batch, at, made)

    return rows.mapInArrow(split, schema).select(*keys, "channel", "block_idx", "first_sample", re, im)


def channel_metrics(blocks: DataFrame, block: int = 8192, rate: float = 48_000.0, n: int = N_CHANNELS,
                    spacing: float = SPACING_HZ, offset: float = OFFSET_HZ, m: int = 4,
                    size: int = 512, hop: int = 256, tone: float = 1000.0, tol: float = 200.0,
                    keys: Sequence[str] = KEYS, re: str = "i", im: str = "q") -> DataFrame:
    """Sample blocks to tone metrics (keys, frame, channel, lin, lo_hz, hi_hz) in one step.

    A block gets the filter memory before it and the samples after it that its
    last frames reach into, so channels and frames never leave the task: what is
    shuffled is a fifth of a block's length, and what comes out is one row per
    frame and channel. ``block`` must be a multiple of ``hop * m``.
    """
    if block % (hop * m) or (size - hop) * m > block:
        raise ValueError("block must be a multiple of hop * m and at least (size - hop) * m long")
    bank = ChannelBank(rate, n, spacing, offset, m, None, None)
    edged = with_edges(blocks, [re, im], before=bank.memory, after=(size - hop) * m, keys=keys, fill=("head",))
    fields = [("frame", T.LongType(), pa.int64()), ("channel", T.IntegerType(), pa.int32()),
              *[(c, T.DoubleType(), pa.float64()) for c in ("lin", "lo_hz", "hi_hz")]]

    @arrow_udf(T.ArrayType(T.StructType([T.StructField(c, t) for c, t, _ in fields])))
    def measure(first: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        count, cols = [0], [[np.empty(0)] for _ in fields]
        for start, x in _complex_rows(first, a, b):
            y = bank(x, start)
            held = min(block // (hop * m), (y.shape[1] - size) // hop + 1) if y.shape[1] >= size else 0
            count.append(held * n)
            if held:
                cut = np.lib.stride_tricks.sliding_window_view(y, size, axis=1)[:, ::hop][:, :held]
                _, _, lin, lo_hz, hi_hz = tone_levels(cut, rate / m, tone, tol)
                frame = np.broadcast_to(start // (hop * m) + np.arange(held), (n, held))
                channel = np.broadcast_to(np.arange(n)[:, None], (n, held))
                for col, v in zip(cols, (frame, channel, lin, lo_hz, hi_hz)):
                    col.append(v.ravel())
        rows = pa.StructArray.from_arrays(
            [pa.array(np.concatenate(col).astype(t.to_pandas_dtype())) for col, (_, _, t) in zip(cols, fields)],
            [c for c, _, _ in fields])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(count).astype(np.int32)), rows)

    whole = lambda c: F.concat(f"{c}_head", F.col(c).cast(DOUBLES), f"{c}_tail")
    return (edged.select(*keys, F.explode(measure(F.col("first_sample").cast("bigint"), whole(re), whole(im)))
                         .alias("_m")).select(*keys, "_m.*"))


def _complex_rows(first: pa.Array, re: pa.Array, im: pa.Array):
    """(first sample, complex samples) of each row of an Arrow batch."""
    a, b = (c.flatten().to_numpy(zero_copy_only=False) for c in (re, im))
    at = re.offsets.to_numpy() - re.offsets[0].as_py()
    for k, s in enumerate(first.to_numpy(zero_copy_only=False)):
        yield int(s), a[at[k]:at[k + 1]] + 1j * b[at[k]:at[k + 1]]
