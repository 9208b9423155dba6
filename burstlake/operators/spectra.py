"""Spectra, tone metrics, peaks and SNR of framed samples.

Frames are rows holding arrays, so everything up to ``superpose`` is a narrow
column function: no shuffle, Catalyst prunes what is not used.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import DOUBLES, row_function
from ..functions.numeric import let
from ..scale import quantiles
from .baseline import array_median


def waterfall():
    """(re, im) -> dB amplitude spectrum, Hann window, zero frequency in the middle."""
    def run(re, im):
        n = re.shape[1]
        w = np.hanning(n)
        x = np.fft.fftshift(np.fft.fft((re + 1j * im) * w, axis=1), axes=1)
        return 20.0 * np.log10(np.abs(x) / (n * np.sqrt(np.mean(w ** 2))) + 1e-12)
    return row_function(run, DOUBLES)


def psd(rate: float):
    """(re, im) -> two-sided power spectral density in dB."""
    def run(re, im):
        w = np.hanning(re.shape[1])
        x = np.fft.fftshift(np.fft.fft((re + 1j * im) * w, axis=1), axes=1)
        return 10.0 * np.log10(np.abs(x) ** 2 / (rate * np.sum(w ** 2)) + 1e-20)
    return row_function(run, DOUBLES)


def psd_real(rate: float):
    """Real array -> one-sided power spectral density in dB."""
    def run(x):
        w = np.hanning(x.shape[1])
        y = np.fft.rfft(x * w, axis=1)
        return 10.0 * np.log10(np.abs(y) ** 2 / (rate * np.sum(w ** 2)) + 1e-20)
    return row_function(run, DOUBLES)


def squared_spectrum(rate: float, fc: float, ntol: float, edge: int = 12, two_sided: bool = True):
    """(re, im) of an analytic or low-passed frame -> struct(spec_db, det_raw).

    The frame is squared and faded at both ends; ``det_raw`` is the larger of the
    two peaks round 2 * (fc +- 500 Hz), each searched within +-2 * ntol.
    """
    def run(re, im):
        n = re.shape[1]
        fade = np.ones(n)
        ramp = (1.0 - np.cos(np.arange(edge) * np.pi / edge)) / 2.0
        fade[:edge] *= ramp
        fade[n - edge:] *= ramp[::-1]
        power = np.abs(np.fft.fft((re + 1j * im) ** 2 * fade, axis=1)) ** 2
        df, top = rate / n, n // 2
        clamp = lambda hz: max(0, min(top, int(round(hz / df))))
        half = max(1, int(round(2.0 * ntol / df)))
        peaks = []
        for tone in (fc + 500.0, fc - 500.0):
            c = clamp(2.0 * tone)
            peaks.append(power[:, max(0, c - half):min(top, c + half) + 1].max(axis=1))
        shown = np.fft.fftshift(power, axes=1) if two_sided else power[:, :top + 1]
        return 10.0 * np.log10(shown + 1e-20), np.maximum(*peaks)
    return row_function(run, [("spec_db", DOUBLES), ("det_raw", "double")])


def tone_levels(x: np.ndarray, rate: float, tone: float, tol: float) -> tuple[np.ndarray, ...]:
    """Tone pair of complex frames along the last axis: lo, hi, their mean, and both frequencies."""
    n = x.shape[-1]
    spec = np.fft.fft(x * x * np.hanning(n), axis=-1)
    hz = np.fft.fftfreq(n, 1.0 / rate)
    found = []
    for centre in (-tone, tone):
        near = np.flatnonzero((hz >= centre - tol) & (hz <= centre + tol))
        near = near[np.argsort(hz[near])]
        part = np.abs(spec[..., near]) / n
        found.append((part.max(axis=-1), hz[near][part.argmax(axis=-1)]))
    (lo, lo_hz), (hi, hi_hz) = found
    return lo, hi, (lo + hi) / 2.0, lo_hz, hi_hz


def tone_pair(rate: float, tone: float = 1000.0, tol: float = 200.0):
    """(re, im) of a channel frame -> struct(lo_lin, hi_lin, lin, lo_hz, hi_hz).

    Squared and Hann-windowed; the strongest bin near -tone and near +tone, and
    their mean amplitude as the metric.
    """
    def run(re, im):
        return tone_levels(re + 1j * im, rate, tone, tol)
    return row_function(run, [(c, "double") for c in ("lo_lin", "hi_lin", "lin", "lo_hz", "hi_hz")])


def local_peaks(power_db: Column, thresh: float = 10.0, win: int = 5,
                floor_db: float = -130.0) -> Column:
    """Array of (bin, power_db): bins at least ``thresh`` over the median of the active bins
    and equal to the maximum within +-win bins; ``win`` bins at each edge are left out."""
    active = lambda a: F.filter(a, lambda v: v > F.lit(floor_db))
    near = lambda a, i: F.array_max(F.slice(a, i - win + 1, 2 * win + 1))
    found = lambda a, limit: F.filter(
        F.sequence(F.lit(win), F.size(a) - F.lit(win + 1)),
        lambda i: (F.get(a, i) >= limit) & (F.get(a, i) == near(a, i)))
    usable = lambda a: (F.size(active(a)) >= 10) & (F.size(a) > 2 * win)
    empty = F.array().cast("array<int>")
    at = lambda a: F.when(usable(a), let(array_median(active(a)) + F.lit(thresh),
                                         lambda limit: found(a, limit))).otherwise(empty)
    return let(power_db, lambda a: F.transform(
        at(a), lambda i: F.struct(i.alias("bin"), F.get(a, i).alias("power_db"))))


def pair_peaks(peaks: Column, bin_hz: float, first_hz: float, spacing: float = 2000.0,
               tol: float = 200.0, centre: float | None = None, centre_tol: float = 500.0) -> Column:
    """Array of (lo_hz, hi_hz): strongest peak first, each takes the unused peak nearest to
    its own frequency + spacing within tol (the lower bin wins a tie). One frame per row."""
    hz = lambda p: p["bin"] * F.lit(bin_hz) + F.lit(first_hz)
    order = lambda all_peaks: F.array_sort(all_peaks, lambda a, b: F.when(a["power_db"] > b["power_db"], -1)
                         .when(a["power_db"] < b["power_db"], 1).otherwise(a["bin"] - b["bin"]))
    empty = F.struct(F.array().cast("array<int>").alias("used"),
                     F.array().cast("array<struct<lo_hz:double,hi_hz:double>>").alias("pairs"))

    def take(acc, p, all_peaks):
        reach = F.filter(all_peaks, lambda c: (c["bin"] != p["bin"])
                         & ~F.array_contains(acc["used"], c["bin"])
                         & (F.abs(hz(c) - hz(p) - F.lit(spacing)) <= F.lit(tol)))
        nearest = F.array_min(F.transform(reach, lambda c: F.struct(
            F.abs(hz(c) - hz(p) - F.lit(spacing)).alias("d"), c["bin"].alias("bin"))))
        taken = F.array_contains(acc["used"], p["bin"])

        def keep(best):
            return F.when(taken | best.isNull(), acc).otherwise(F.struct(
                F.concat(acc["used"], F.array(p["bin"], best["bin"])).alias("used"),
                F.array_append(acc["pairs"], F.struct(
                    hz(p).alias("lo_hz"), hz(best).alias("hi_hz"))).alias("pairs")))
        return let(nearest, keep)
    pairs = let(peaks, lambda found: F.aggregate(
        order(found), empty, lambda acc, p: take(acc, p, found), lambda a: a["pairs"]))
    if centre is None:
        return pairs
    return F.filter(pairs, lambda p: F.abs((p["lo_hz"] + p["hi_hz"]) / 2 - F.lit(centre))
                    <= F.lit(centre_tol))


def snr_db(rate: float = 12_000.0, nfft: int = 1024, pad: int = 1200, pre: int = 6000,
           signal: tuple[float, float] = (900.0, 2100.0), noise: tuple[float, float] = (200.0, 5500.0),
           ref_hz: float = 2500.0):
    """Real array [pad][pre: noise][burst ...] -> SNR in whole dB, null if it cannot be told.

    Noise: median over out-of-band bins of the mean power spectrum of the pre part
    (half-overlapping windows). Signal: strongest in-band power of the windows of
    the rest, a quarter window apart.
    """
    w = np.hanning(nfft)
    hz = np.fft.rfftfreq(nfft, 1.0 / rate)
    in_band = (hz >= signal[0]) & (hz <= signal[1])
    out_band = (hz > noise[0]) & (hz < noise[1]) & ~in_band
    ref_bins = ref_hz / (rate / nfft)

    def power(block, step):
        """Mean-ready power spectra of the windows of each row."""
        count = max(1, -(-(block.shape[1] - nfft + 1) // step))
        if block.shape[1] < nfft:
            block = np.pad(block, ((0, 0), (0, nfft - block.shape[1])))
        at = np.arange(count) * step
        return np.abs(np.fft.rfft(block[:, at[:, None] + np.arange(nfft)] * w, axis=2)) ** 2

    def run(x):
        split = pad + pre
        nothing = np.full(len(x), np.nan)
        if x.shape[1] <= split or x.shape[1] - split < nfft:
            return nothing
        floor = np.median(power(x[:, pad:split], nfft // 2).mean(axis=1)[:, out_band], axis=1)
        best = power(x[:, split:], nfft // 4)[:, :, in_band].sum(axis=2).max(axis=1)
        ok = (floor > 0) & (best > 0)
        ratio = np.where(ok, best, 1.0) / np.where(ok, floor * ref_bins, 1.0)
        return np.where(ok, np.rint(10.0 * np.log10(ratio)), np.nan)
    return row_function(run, "double")


def superpose(spectra: DataFrame, src_first_hz: float, src_bin_hz: float, grid_first_hz: float,
              grid_bin_hz: float, grid_bins: int, keys: Sequence[str] = ("frame",),
              power: str = "power", shift: str = "shift_hz") -> DataFrame:
    """Sum shifted linear power spectra on a common grid: rows (keys, bin, power).

    Axes are regular, so the source bins either side of a grid point follow by
    arithmetic inside the source row; only the sum is shuffled, after partial sums.
    """
    src = F.col(power)
    at = lambda g: ((F.lit(grid_first_hz) + g * F.lit(grid_bin_hz) - F.col(shift)
                     - F.lit(src_first_hz)) / F.lit(src_bin_hz))
    level = lambda p: F.get(src, F.floor(p).cast("int")) * (F.lit(1.0) - (p - F.floor(p))) + F.when(
        p > F.floor(p), F.get(src, F.floor(p).cast("int") + 1) * (p - F.floor(p))).otherwise(0.0)
    inside = lambda p: (p >= 0) & (p <= F.size(src) - 1)
    on_grid = F.transform(F.sequence(F.lit(0), F.lit(grid_bins - 1)),
                          lambda g: F.when(inside(at(g)), level(at(g))).otherwise(F.lit(0.0)))
    return (spectra.select(*keys, F.posexplode(on_grid).alias("bin", "_p"))
                   .groupBy(*keys, "bin").agg(F.sum("_p").alias(power)))


def align_floor(grid: DataFrame, in_band: Column, reference_db: Column, power: str = "power",
                keys: Sequence[str] = ("recording",), q: float = 0.10,
                bound: int | None = None) -> DataFrame:
    """Power to dB, shifted so that the q-quantile of the in-band bins meets the reference."""
    db = grid.withColumn("power_db", F.lit(10.0) * F.log10(F.greatest(F.col(power), F.lit(1e-30))))
    low = quantiles(db.where(in_band), keys, "power_db", {"low_db": q}, bound=bound)
    return (db.join(low, list(keys))
              .withColumn("power_db", F.col("power_db") + reference_db - F.col("low_db"))
              .drop("low_db"))


def smooth_median(values: Column, width: int = 7) -> Column:
    """Median over ``width`` neighbouring bins of an array, ends replicated; even widths go up."""
    width += (width + 1) % 2
    if width <= 1:
        return values
    half = width // 2
    padded = F.concat(F.array_repeat(F.get(values, F.lit(0)), half), values,
                      F.array_repeat(F.element_at(values, -1), half))
    return let(padded, lambda p: F.transform(
        F.sequence(F.lit(1), F.size(p) - F.lit(2 * half)),
        lambda i: F.element_at(F.sort_array(F.slice(p, i, width)), half + 1)))


def valid_frames(df: DataFrame, keys: Sequence[str] = ("recording",), frame: str = "frame",
                 power: str = "power_db", guard_db: float = -170.0,
                 margin_db: float = 6.0) -> DataFrame:
    """Drop leading and trailing frames near the numerical floor, if the recording reaches it.

    The first and last good frame are two aggregates, so no ordering is needed.
    """
    peaks = df.withColumn("_peak", F.array_max(power))
    low = peaks.groupBy(*keys).agg(F.min("_peak").alias("_low"))
    marked = peaks.join(low, list(keys)).withColumn(
        "_bad", (F.col("_low") <= guard_db) & (F.col("_peak") <= F.col("_low") + margin_db))
    edges = marked.where(~F.col("_bad")).groupBy(*keys).agg(F.min(frame).alias("_a"),
                                                           F.max(frame).alias("_b"))
    return (df.join(edges, list(keys))
              .where(F.col(frame).between(F.col("_a"), F.col("_b"))).drop("_a", "_b"))
