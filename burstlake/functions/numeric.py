"""Column expressions on complex samples, channels, units and levels."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the channel plan: 48 channels, 1 kHz apart, centred half a
# channel up; edge channels lie within 4 of the Nyquist channel 24.
N_CHANNELS = 48
SPACING_HZ = 1000.0
OFFSET_HZ = 500.0
EDGE_SKIP = 4
AUDIO_HZ = 1500.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``, also inside its lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def c_square(re: Column, im: Column) -> Column:
    return F.struct((re * re - im * im).alias("re"), (F.lit(2.0) * re * im).alias("im"))


def c_square_array(re: Column, im: Column) -> Column:
    return F.zip_with(re, im, c_square)


def c_abs(re: Column, im: Column) -> Column:
    return F.hypot(re, im)


def to_db(x: Column, kind: str = "amplitude", floor: float | None = None) -> Column:
    """``amplitude``: 20*log10(x + floor); ``power``: 10*log10(max(x, floor))."""
    if kind == "amplitude":
        return F.lit(20.0) * F.log10(x + F.lit(1e-12 if floor is None else floor))
    if kind == "power":
        return F.lit(10.0) * F.log10(F.greatest(x, F.lit(1e-30 if floor is None else floor)))
    raise ValueError(kind)


def mix(re: Column, im: Column, n: Column, hz: float | Column, rate: float) -> Column:
    """Shift by -hz at absolute sample number n: no phase is carried between rows."""
    hz = hz if isinstance(hz, Column) else F.lit(float(hz))
    angle = F.lit(-2.0 * math.pi) * F.pmod(hz * n, F.lit(float(rate))) / F.lit(float(rate))
    c, s = F.cos(angle), F.sin(angle)
    return F.struct((re * c - im * s).alias("re"), (re * s + im * c).alias("im"))


def channel_signed(k: Column) -> Column:
    return F.when(k <= N_CHANNELS // 2, k).otherwise(k - F.lit(N_CHANNELS))


def channel_display(k: Column) -> Column:
    return F.pmod(k + F.lit(N_CHANNELS // 2), F.lit(N_CHANNELS))


def channel_hz(k: Column) -> Column:
    return channel_signed(k) * F.lit(SPACING_HZ) + F.lit(OFFSET_HZ)


def not_edge(k: Column, skip: int = EDGE_SKIP) -> Column:
    return F.abs(k - F.lit(N_CHANNELS // 2)) > F.lit(skip)


def drop_edge(df: DataFrame, channel: str = "channel", skip: int = EDGE_SKIP) -> DataFrame:
    return df.where(not_edge(F.col(channel), skip))


def carrier_offset_hz(lo: Column, hi: Column) -> Column:
    """Squaring doubles frequency, so the midpoint of the pair is twice the carrier."""
    return (lo + hi) / F.lit(4.0)


def carrier_hz(lo: Column, hi: Column, channel: Column) -> Column:
    return channel_hz(channel) + carrier_offset_hz(lo, hi)


def dial_khz(centre_mhz: Column, fc_hz: Column) -> Column:
    return centre_mhz * F.lit(1000.0) + (fc_hz - F.lit(AUDIO_HZ)) / F.lit(1000.0)


def round_even(x: Column) -> Column:
    return F.rint(x).cast("long")


def ms_of_day(col: Column) -> Column:
    """HH:MM:SS to milliseconds since midnight; 0 when malformed."""
    p = F.split(col, ":")
    part = lambda i: F.get(p, F.lit(i)).try_cast("int")
    ms = (part(0) * 3600 + part(1) * 60 + part(2)) * 1000
    return F.coalesce(F.when(F.size(p) == 3, ms), F.lit(0)).cast("long")


def freq_mhz(col: Column) -> Column:
    v = col.try_cast("double")
    return F.when(v >= 1e6, v / F.lit(1e6)).otherwise(v)


def bandwidth_hz(col: Column) -> Column:
    v = col.try_cast("double")
    return F.when(v <= 0, F.lit(None)).when(v < 1000, v * F.lit(1e6)).otherwise(v)


def lp_taper_db(power_db: Column, hz: Column, cutoff: float) -> Column:
    """Unchanged up to cutoff, cosine roll-off to -60 dB at twice that, then -200 dB."""
    f = F.abs(hz)
    t = (f - F.lit(cutoff)) / F.lit(cutoff)
    gain = F.lit(-60.0) * (F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(math.pi) * t))
    return (F.when(f <= cutoff, power_db).when(f <= 2 * cutoff, power_db + gain)
             .otherwise(F.lit(-200.0)))


def normalise(x: Column, kind: str) -> Column:
    """Ingress scaling of an array of raw samples to +-1.0."""
    x = x.cast("array<double>")
    if kind == "i16":
        return F.transform(x, lambda v: v / F.lit(32768.0))
    if kind == "u8":
        return F.transform(x, lambda v: (v - F.lit(127.5)) / F.lit(127.5))
    if kind == "unit":
        return x
    raise ValueError(kind)
