"""Framing, filters and spectra on the sample, frame and complex bindings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from burstlake.functions import numeric as num
from burstlake.operators import baseline as base
from burstlake.operators import filters, framing, recurrence, spectra, transforms
from burstlake.scale import drop_halo, with_halo

from .bindings import FRAME_BINS, FRAMES, IQ32, SERIES, frame_bins, frames, iq32, series, table
from .detection import r

PI = "pi()"


def listed(taps) -> str:
    return "[" + ", ".join(repr(float(t)) + "::DOUBLE" for t in taps) + "]"


def bins(df, col, *keep, first=0):
    """Array column to long rows (keep..., bin, value)."""
    out = df.select(*keep, F.posexplode(col).alias("bin", "_v"))
    return out.withColumn("bin", F.col("bin") + first) if first else out


# ---------------------------------------------------------------- SQL parts

def dft(source: str, n: int, out: str = "spec", sign: int = -1, key: str = "frame") -> str:
    """CTE ``out``(key, k, re, im): DFT of ``source``(key, n, re, im) of length n."""
    turn = f"2 * {PI} * ((k * n) % {n}) / {n}"
    s = "" if sign < 0 else "-"
    return f"""{out} AS (SELECT {key}, k,
    sum(re * cos({turn}) + {s}(im * sin({turn}))) AS re,
    sum(im * cos({turn}) - {s}(re * sin({turn}))) AS im
  FROM {source}, (SELECT unnest(range(0, {n}))::INT AS k) GROUP BY {key}, k)"""


REAL64 = FRAME_BINS + """, x64 AS (SELECT frame, bin AS n, power_db AS re, 0.0::DOUBLE AS im FROM frame_bins)"""
HANN64 = "(0.5 - 0.5 * cos(2 * pi() * n / 63))"
HANN32 = "(0.5 - 0.5 * cos(2 * pi() * n / 31))"
W64 = sum((0.5 - 0.5 * math.cos(2 * math.pi * n / 63)) ** 2 for n in range(64))
W32 = sum((0.5 - 0.5 * math.cos(2 * math.pi * n / 31)) ** 2 for n in range(32))
SQUARED = IQ32 + """, sq AS (SELECT frame, n, re * re - im * im AS re, 2 * re * im AS im FROM iq32)"""


# ---------------------------------------------------------------- framing

def frame_rows(df, cols=("x",)):
    return df.select("stream_id", "frame", F.posexplode("x").alias("pos", "x"))


def frames_drop(spark, sf):
    f = framing.frames(series(spark, sf), 64, 32)
    return frame_rows(f).select("stream_id", "frame", "pos", r(F.col("x")).alias("x"))


def frames_cut(spark, sf):
    blocks = framing.to_blocks(series(spark, sf), 256)
    f = framing.frames_of_blocks(blocks, 64, 32, 256)
    return frame_rows(f).select("stream_id", "frame", "pos", r(F.col("x")).alias("x"))


def frames_pad(spark, sf):
    f = framing.frames(series(spark, sf), 63, 63, tail="pad", pad_to=64)
    return frame_rows(f).select("stream_id", "frame", "pos", r(F.col("x")).alias("x"))


def frames_psd_grid(spark, sf):
    f = framing.frames(series(spark, sf), 54, 13)
    return f.select("stream_id", "frame", r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("total"))


def halo_mean(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("stream_id", "segment").orderBy("n").rowsBetween(-9, 0)
    out = drop_halo(with_halo(series(spark, sf), "n", 500, before=9).withColumn("m", F.avg("x").over(w)))
    return out.select("stream_id", "n", r(F.col("m")).alias("mean_10"))


def event_windows(spark, sf):
    s = series(spark, sf)
    hits = s.where("x > 150").select("stream_id", F.col("n").alias("event_id"), F.col("n").alias("at"))
    seg = framing.event_segments(framing.to_blocks(s, 128), hits, 20, 45, 4, 128)
    return frame_rows(seg.withColumnRenamed("event_id", "frame")).select(
        "stream_id", F.col("frame").alias("event_id"), "pos", r(F.col("x")).alias("x"))


EVENTS_SQL = "WITH " + SERIES + """,
  hits AS (SELECT stream_id, n AS event_id, n AS at FROM series WHERE x > 150),
  part AS (SELECT h.stream_id, h.event_id, s.n, s.x FROM hits h JOIN series s
    ON s.stream_id = h.stream_id AND s.n >= h.at - 20 AND s.n < h.at + 45),
  placed AS (SELECT stream_id, event_id, x,
    row_number() OVER (PARTITION BY stream_id, event_id ORDER BY n) + 3 AS pos,
    count(*) OVER (PARTITION BY stream_id, event_id) AS c FROM part),
  zeros AS (SELECT DISTINCT stream_id, event_id, p + CASE WHEN p >= 4 THEN c ELSE 0 END AS pos, 0.0 AS x
    FROM placed, (SELECT unnest(range(0, 8)) AS p))
SELECT stream_id, event_id, pos::INT AS pos, round(x, 6) + 0.0 AS x FROM placed
UNION ALL SELECT stream_id, event_id, pos::INT, x FROM zeros"""


def rebatched(spark, sf):
    packets = framing.to_blocks(series(spark, sf), 48).select(
        "stream_id", "first_sample", (F.lit(1_700_000_000) + F.floor(F.col("first_sample") / 100)).alias("ts_sec"),
        (F.pmod("first_sample", F.lit(100)) * 10_000_000_000).alias("ts_ps"), "x")
    b = framing.rebatch(packets, 256, rate=100.0)
    return b.select("stream_id", "block_idx", "first_sample", "ts_sec", "ts_ps",
                    F.size("x").alias("n_samples"),
                    r(F.aggregate("x", F.lit(0.0), lambda a, v: a + v)).alias("total"))


REBATCH_SQL = "WITH " + SERIES + """,
  p AS (SELECT stream_id, n, x FROM series)
SELECT stream_id, n // 256 AS block_idx, min(n) AS first_sample,
  (1700000000 + min(n) // 100)::BIGINT AS ts_sec, (min(n) % 100 * 10000000000)::BIGINT AS ts_ps,
  count(*)::INT AS n_samples, round(sum(x), 6) + 0.0 AS total FROM p GROUP BY 1, 2"""


def slot_rows(spark, sf):
    from .bindings import epoch_us

    ev = table(spark, sf, "events").select("event_id", "value", (epoch_us() / 1e6).alias("t"))
    s = framing.slots(ev, F.col("t"), secs=3600.0, rate=0.05, count=170)
    return s.select("event_id", "window_id", "slot", r(F.col("position"), 3).alias("position"))


def slot_last(spark, sf):
    from .bindings import epoch_us

    ev = table(spark, sf, "events").select("event_id", "value", (epoch_us() / 1e6).alias("t"))
    s = framing.slots(ev, F.col("t"), secs=86400.0, rate=0.002, count=170)
    return framing.last_per_slot(s, ["t", "event_id"], ["event_id", "value"], ("window_id", "slot"))


# ---------------------------------------------------------------- filters

SHORT = filters.fir_taps(7, 2700.0, 48_000.0)
HIGH = filters.fir_taps(9, 300.0, 12_000.0, pass_zero=False)
LONG = filters.fir_taps(65, 6000.0, 48_000.0)
HALF = filters.fir_taps(15, 10_000.0, 48_000.0)


def long_out(df, name="y"):
    return df.select("stream_id", "n", r(F.col("x")).alias(name))


def fir_short(spark, sf):
    return long_out(filters.fir_samples(series(spark, sf), SHORT))


def fir_high(spark, sf):
    return long_out(filters.fir_samples(series(spark, sf), HIGH))


def fir_long(spark, sf):
    return long_out(framing.to_samples(filters.fir(framing.to_blocks(series(spark, sf), 1024), LONG)))


def decimate_4(spark, sf):
    return long_out(filters.decimate_samples(series(spark, sf), 4, SHORT))


def decimate_20(spark, sf):
    taps = filters.fir_taps(101, 1000.0, 48_000.0)
    return long_out(framing.to_samples(filters.decimate(framing.to_blocks(series(spark, sf), 1000), 20, taps)))


def halve_twice(spark, sf):
    return long_out(framing.to_samples(filters.halve(framing.to_blocks(series(spark, sf), 1024), 2, HALF)))


def fir_sql(taps, source="series", out="y", step=1):
    keep = "" if step == 1 else f"WHERE n % {step} = 0"
    return f"""{out} AS (SELECT stream_id, n // {step} AS n, x FROM (
    SELECT s.stream_id, s.n, sum(p.x * {listed(taps)}[s.n - p.n + 1]) AS x
    FROM {source} s JOIN {source} p ON p.stream_id = s.stream_id AND p.n BETWEEN s.n - {len(taps) - 1} AND s.n
    {keep.replace('n %', 's.n %')} GROUP BY 1, 2))"""


OUT_SQL = "\nSELECT stream_id, n, round(x, 6) + 0.0 AS y FROM y"


def resample(spark, sf):
    return long_out(filters.resample_linear(series(spark, sf), 48_000, 36_000))


RESAMPLE_SQL = "WITH " + SERIES + """,
  len AS (SELECT stream_id, count(*) AS c, round_even(count(*) * 0.75::DOUBLE, 0)::BIGINT AS m FROM series GROUP BY 1),
  grid AS (SELECT stream_id, c, m, unnest(range(0, m)) AS j FROM len),
  pos AS (SELECT stream_id, j, (j * (c - 1)) // (m - 1) AS k, (j * (c - 1)) % (m - 1) / (m - 1)::DOUBLE AS f FROM grid)
SELECT p.stream_id, p.j AS n, round(a.x + (coalesce(b.x, a.x) - a.x) * f, 6) + 0.0 AS y
FROM pos p JOIN series a ON a.stream_id = p.stream_id AND a.n = p.k
LEFT JOIN series b ON b.stream_id = p.stream_id AND b.n = p.k + 1"""


def blanked(spark, sf):
    s = series(spark, sf).withColumn("mask", F.when(F.col("x") > 200, 1.0).otherwise(0.0))
    b = filters.soft_blank(framing.to_blocks(s, 512, ("x", "mask")))
    return long_out(framing.to_samples(b))


BLANK_SQL = "WITH " + SERIES + """
SELECT s.stream_id, s.n, round(any_value(s.x) * (1 - least(sum(CASE WHEN p.x > 200
    THEN 0.5 - 0.5 * cos(2 * pi() * (s.n - p.n + 24) / 48) ELSE 0 END), 1)), 6) + 0.0 AS y
FROM series s JOIN series p ON p.stream_id = s.stream_id AND p.n BETWEEN s.n - 24 AND s.n + 24 GROUP BY 1, 2"""


def complex_rows(df, col="y"):
    return df.select("frame", F.posexplode(F.arrays_zip(F.col(f"{col}.re").alias("re"), F.col(f"{col}.im").alias("im")))
                     .alias("n", "_v")).select("frame", "n", r(F.col("_v.re")).alias("re"), r(F.col("_v.im")).alias("im"))


def spectral_lowpass(spark, sf):
    y = filters.fft_lowpass(12_000.0, 2500.0)
    return complex_rows(iq32(spark, sf).select("frame", y("re", "im").alias("y")))


def real_rows(df):
    return df.select("frame", F.posexplode("y").alias("n", "_v")).select("frame", "n", r(F.col("_v")).alias("y"))


def spectral_bandpass(spark, sf):
    y = filters.fft_bandpass(6400.0, 600.0, 1900.0)
    return real_rows(frames(spark, sf).select("frame", y("x").alias("y")))


CORRECTION = [k * 0.25 for k in range(17)]


def spectral_equalise(spark, sf):
    y = filters.fft_equalise(6400.0, 900.0, CORRECTION, 32)
    return real_rows(frames(spark, sf).select("frame", y("x").alias("y")))


def analytic_signal(spark, sf):
    return complex_rows(frames(spark, sf).select("frame", filters.analytic()("x").alias("y")))


def spectral_bandpass_long(spark, sf):
    """Whole streams in strips of some 500 samples, by factors or by a chirp as their lengths have it."""
    b = framing.to_blocks(series(spark, sf), 64)
    y = transforms.spectral_blocks(b, filters.bandpass_gain(160.0, 20.0, 50.0), 64, re="x", im=None, task=500)
    return long_blocks(y).select("stream_id", "n", r(F.col("_v.re"), 4).alias("y"))


def analytic_signal_long(spark, sf):
    y = transforms.spectral_blocks(framing.to_blocks(series(spark, sf), 64), filters.analytic_gain, 64, re="x", im=None, task=500)
    return long_blocks(y).select("stream_id", "n", r(F.col("_v.im"), 4).alias("im"))


def long_blocks(df):
    return (df.select("stream_id", "block_idx", F.posexplode(F.arrays_zip("re", "im")).alias("_at", "_v"))
            .withColumn("n", F.col("block_idx") * 64 + F.col("_at")))


def whole_sql(gain: str, wave: str, out: str) -> str:
    """Circular convolution of each stream with the impulse response of a gain over the bins of its own length."""
    return "WITH " + SERIES + f""",
  sizes AS (SELECT stream_id, count(*) AS m FROM series GROUP BY 1),
  ks AS (SELECT stream_id, m, unnest(range(m)) AS k FROM sizes),
  gains AS (SELECT *, {gain} AS g FROM (SELECT *, least(k, m - k) * 160.0::DOUBLE / m AS f FROM ks)),
  response AS MATERIALIZED (SELECT a.stream_id, b.k AS d, sum(a.g * {wave}(2 * pi() * ((a.k * b.k) % a.m) / a.m)) / a.m AS h
    FROM gains a JOIN ks b ON b.stream_id = a.stream_id GROUP BY a.stream_id, b.k, a.m),
  pairs AS MATERIALIZED (SELECT s.stream_id, s.n, p.x, (s.n - p.n + p.m) % p.m AS d FROM series s
    JOIN (SELECT * FROM series JOIN sizes USING (stream_id)) p ON p.stream_id = s.stream_id)
SELECT stream_id, n, round(sum(x * h), 4) + 0.0 AS {out} FROM pairs JOIN response USING (stream_id, d) GROUP BY 1, 2"""


def inverse_sql(gain: str, n: int, source: str, real: bool) -> str:
    cols = ("round(re / {n}, 6) + 0.0 AS y" if real else
            "round(re / {n}, 6) + 0.0 AS re, round(im / {n}, 6) + 0.0 AS im").format(n=n)
    return (dft(source, n) + f""",
  shaped AS (SELECT frame, k AS n, re * ({gain}) AS re, im * ({gain}) AS im FROM
    (SELECT *, least(k, {n} - k) AS a FROM spec)),
  """ + dft("shaped", n, "back", sign=1) + f"\nSELECT frame, k AS n, {cols} FROM back")


def ramp(f: str, lo: float, hi: float) -> str:
    return f"(0.5 - 0.5 * cos(pi() * least(greatest(({f} - {lo}) / ({hi} - {lo}), 0), 1)))"


LOWPASS_GAIN = f"1 - {ramp('a * 375.0', 2500.0, 2750.0)}"
BANDPASS_GAIN = f"{ramp('a * 100.0', 470.0, 600.0)} * (1 - {ramp('a * 100.0', 1900.0, 2030.0)})"
EQUALISE_GAIN = (f"CASE WHEN a * 100.0 > 1800 THEN 0 ELSE pow(10.0, (a * 0.125 - 60.0 * "
                 f"{ramp('a * 100.0', 900.0, 1800.0)}) / 20.0) END")
ANALYTIC_GAIN = "CASE WHEN k = 0 OR k = 32 THEN 1 WHEN k < 32 THEN 2 ELSE 0 END"


def channelised(spark, sf):
    s = series(spark, sf).withColumn("q", -F.col("x") / 2)
    blocks = framing.to_blocks(s, 512, ("x", "q")).withColumnsRenamed({"x": "i"})
    y = filters.channelise(blocks)
    out = y.select("stream_id", "channel", "first_sample", F.posexplode(F.arrays_zip("i", "q")).alias("_k", "_s"))
    return out.select("stream_id", "channel", (F.col("first_sample") + F.col("_k")).alias("n"),
                      r(F.col("_s.i"), 5).alias("i"), r(F.col("_s.q"), 5).alias("q"))


def metrics_of_blocks(spark, sf):
    s = series(spark, sf).withColumn("q", -F.col("x") / 2)
    blocks = framing.to_blocks(s, 128, ("x", "q")).withColumnsRenamed({"x": "i"})
    m = filters.channel_metrics(blocks, 128, size=32, hop=16, tol=400.0)
    return m.select("stream_id", "frame", "channel", r(F.col("lin"), 5).alias("lin"))


def metrics_sql() -> str:
    high = channel_sql().rsplit("SELECT", 1)[0]
    return high.rstrip() + f""",
 cut AS (SELECT stream_id || '/' || channel || '/' || f AS frame, n - f * 16 AS n, re * re - im * im AS a, 2 * re * im AS b
    FROM high, LATERAL (SELECT unnest(range(greatest((n - 16) // 16, 0), n // 16 + 1)) AS f) WHERE n < f * 16 + 32),
 full_frames AS (SELECT frame FROM cut GROUP BY frame HAVING count(*) = 32),
 win AS (SELECT frame, n, a * {HANN32} AS re, b * {HANN32} AS im FROM cut WHERE frame IN (SELECT frame FROM full_frames)),
 """ + dft("win", 32) + """,
 lev AS (SELECT frame, (CASE WHEN k < 16 THEN k ELSE k - 32 END) * 375.0 AS hz, sqrt(re * re + im * im) / 32 AS amp FROM spec)
SELECT split_part(frame, '/', 1) AS stream_id, split_part(frame, '/', 3)::BIGINT AS frame, split_part(frame, '/', 2)::INT AS channel,
  round((max(amp) FILTER (WHERE abs(hz + 1000) <= 400) + max(amp) FILTER (WHERE abs(hz - 1000) <= 400)) / 2, 5) + 0.0 AS lin
FROM lev GROUP BY lev.frame"""


def channel_sql() -> str:
    parts = []
    for k in range(48):
        turn = f"2 * pi() * (({k * 1000 + 500} * n) % 48000) / 48000"
        parts.append(f"SELECT stream_id, {k} AS channel, n, x * cos({turn}) - x / 2 * sin({turn}) AS re, "
                     f"-x * sin({turn}) - x / 2 * cos({turn}) AS im FROM series")
    both = lambda taps, src, step: f"""SELECT s.stream_id, s.channel, s.n // {step} AS n,
      sum(p.re * {listed(taps)}[s.n - p.n + 1]) AS re, sum(p.im * {listed(taps)}[s.n - p.n + 1]) AS im
    FROM {src} s JOIN {src} p ON p.stream_id = s.stream_id AND p.channel = s.channel
      AND p.n BETWEEN s.n - {len(taps) - 1} AND s.n WHERE s.n % {step} = 0 GROUP BY s.stream_id, s.channel, s.n"""
    return ("WITH " + SERIES + ",\n mixed AS (" + "\nUNION ALL ".join(parts) + "),\n low AS ("
            + both(SHORT, "mixed", 4) + "),\n high AS (" + both(HIGH, "low", 1)
            + ")\nSELECT stream_id, channel, n, round(re, 5) + 0.0 AS i, round(im, 5) + 0.0 AS q FROM high")


# ---------------------------------------------------------------- spectra

def waterfall(spark, sf):
    w = spectra.waterfall()
    return bins(iq32(spark, sf).select("frame", w("re", "im").alias("p")), "p", "frame").select(
        "frame", "bin", r(F.col("_v"), 4).alias("power_db"))


def psd_complex(spark, sf):
    w = spectra.psd(12_000.0)
    return bins(iq32(spark, sf).select("frame", w("re", "im").alias("p")), "p", "frame").select(
        "frame", "bin", r(F.col("_v"), 4).alias("power_db"))


def psd_real(spark, sf):
    w = spectra.psd_real(6400.0)
    return bins(frames(spark, sf).select("frame", w("x").alias("p")), "p", "frame").select(
        "frame", "bin", r(F.col("_v"), 4).alias("power_db"))


def squared_detection(spark, sf):
    s = spectra.squared_spectrum(12_000.0, 1500.0, 200.0, edge=4)
    df = iq32(spark, sf).select(F.lit("all").alias("recording"), "frame", s("re", "im").alias("s")).select(
        "recording", "frame", "s.*")
    out = base.floor_ratio(df, ["recording"], "det_raw")
    return out.select("frame", r(F.col("det_raw"), 8).alias("det_raw"), r(F.col("det_norm")).alias("det_norm"))


def squared_spectrogram(spark, sf):
    s = spectra.squared_spectrum(12_000.0, 1500.0, 200.0, edge=4)
    df = iq32(spark, sf).select("frame", s("re", "im").alias("s")).select("frame", "s.spec_db")
    return bins(df, "spec_db", "frame").select("frame", "bin", r(F.col("_v"), 4).alias("power_db"))


FADE = ("(CASE WHEN n < 4 THEN (1 - cos(n * pi() / 4)) / 2 WHEN n >= 28 THEN (1 - cos((31 - n) * pi() / 4)) / 2 "
        "ELSE 1 END)")
FADED = SQUARED + f", faded AS (SELECT frame, n, re * {FADE} AS re, im * {FADE} AS im FROM sq), " + dft("faded", 32)
# 2 * (1500 +- 500) Hz in bins of 375 Hz: 11 and 5, half width 1
DET_SQL = "WITH " + FADED + """,
  det AS (SELECT frame, max(re * re + im * im) FILTER (WHERE k BETWEEN 10 AND 12 OR k BETWEEN 4 AND 6) AS d
    FROM spec GROUP BY frame),
  ref AS (SELECT greatest(quantile_cont(d, 0.25), 0.001 * avg(d), 1e-20) AS ref FROM det)
SELECT frame, round(d, 8) + 0.0 AS det_raw, round(d / ref, 6) + 0.0 AS det_norm FROM det, ref"""


def tone_pair(spark, sf):
    t = spectra.tone_pair(3200.0)
    df = iq32(spark, sf).select("frame", t("re", "im").alias("t")).select("frame", "t.*")
    return df.select("frame", *[r(F.col(c), 8).alias(c) for c in ("lo_lin", "hi_lin", "lin")], "lo_hz", "hi_hz",
                     num.carrier_hz(F.col("lo_hz"), F.col("hi_hz"), F.pmod("frame", F.lit(48))).alias("fc_hz"))


TONE_SQL = "WITH " + SQUARED + f""",
  win AS (SELECT frame, n, re * {HANN32} AS re, im * {HANN32} AS im FROM sq), """ + dft("win", 32) + """,
  lev AS (SELECT frame, (CASE WHEN k < 16 THEN k ELSE k - 32 END) * 100.0::DOUBLE AS hz, sqrt(re * re + im * im) / 32 AS a FROM spec),
  pick AS (SELECT frame,
    max(a) FILTER (WHERE hz BETWEEN -1200 AND -800) AS lo_lin, max(a) FILTER (WHERE hz BETWEEN 800 AND 1200) AS hi_lin,
    arg_max(hz, a) FILTER (WHERE hz BETWEEN -1200 AND -800) AS lo_hz,
    arg_max(hz, a) FILTER (WHERE hz BETWEEN 800 AND 1200) AS hi_hz FROM lev GROUP BY frame)
SELECT frame, round(lo_lin, 8) + 0.0 AS lo_lin, round(hi_lin, 8) + 0.0 AS hi_lin,
  round((lo_lin + hi_lin) / 2, 8) + 0.0 AS lin, lo_hz, hi_hz,
  (CASE WHEN frame % 48 <= 24 THEN frame % 48 ELSE frame % 48 - 48 END) * 1000.0::DOUBLE + 500.0 + (lo_hz + hi_hz) / 4 AS fc_hz
FROM pick"""

PEAK_SCALE = 60.0


def scaled(spark, sf):
    """Frames read as dB values."""
    return frames(spark, sf).select("recording", "frame", F.transform("x", lambda v: v * PEAK_SCALE).alias("power_db"))


def peaks(spark, sf):
    df = scaled(spark, sf).select("frame", F.explode(spectra.local_peaks(F.col("power_db"))).alias("p"))
    return df.select("frame", F.col("p.bin").alias("bin"), r(F.col("p.power_db"), 4).alias("power_db"))


PEAKS = FRAME_BINS + """,
  db AS (SELECT frame, bin, power_db * 60.0 AS p FROM frame_bins),
  lim AS (SELECT frame, median(p) + 10 AS lim FROM db WHERE p > -130 GROUP BY frame HAVING count(*) >= 10),
  near AS (SELECT *, max(p) OVER (PARTITION BY frame ORDER BY bin ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m FROM db),
  peaks AS (SELECT near.frame, bin, p FROM near JOIN lim ON lim.frame = near.frame
    WHERE bin BETWEEN 5 AND 58 AND p >= lim AND p = m)"""


def pairs(spark, sf):
    df = scaled(spark, sf).select("frame", F.explode(spectra.pair_peaks(
        spectra.local_peaks(F.col("power_db")), 100.0, -3200.0, spacing=2000.0, tol=600.0)).alias("p"))
    return df.select("frame", "p.lo_hz", "p.hi_hz")


PAIR_SQL = "WITH RECURSIVE " + PEAKS + """,
  ranked AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY p DESC, bin) AS rn FROM peaks),
  packs AS (SELECT frame, list(bin ORDER BY bin) AS all_bins, count(*) AS c FROM peaks GROUP BY frame),
  cand AS (SELECT a.frame, a.rn, a.bin, list({'d': abs(b.bin * 100.0 - a.bin * 100.0 - 2000.0), 'b': b.bin})
      FILTER (WHERE abs(b.bin * 100.0 - a.bin * 100.0 - 2000.0) <= 600.0 AND b.bin <> a.bin) AS reach
    FROM ranked a JOIN peaks b ON b.frame = a.frame GROUP BY 1, 2, 3),
  fold AS (
    SELECT frame, 0::BIGINT AS rn, []::INT[] AS used, NULL::INT AS lo, NULL::INT AS hi FROM packs
    UNION ALL
    SELECT frame, rn, CASE WHEN hi IS NULL THEN used ELSE list_concat(used, [lo, hi]) END, lo, hi FROM (
      SELECT c.frame, c.rn, f.used, c.bin AS lo,
        CASE WHEN list_contains(f.used, c.bin) THEN NULL ELSE
          list_sort(list_filter(coalesce(c.reach, []), lambda x: NOT list_contains(f.used, x.b)))[1].b END AS hi
      FROM fold f JOIN cand c ON c.frame = f.frame AND c.rn = f.rn + 1))
SELECT frame, lo * 100.0::DOUBLE - 3200 AS lo_hz, hi * 100.0::DOUBLE - 3200 AS hi_hz FROM fold WHERE hi IS NOT NULL"""


def snr(spark, sf):
    s = spectra.snr_db(6400.0, nfft=16, pad=4, pre=24, signal=(900.0, 2100.0), noise=(200.0, 3100.0))
    return frames(spark, sf).select("frame", s("x").cast("int").alias("snr_db"))


# windows: noise at 4 and 12, signal at 28, 32, .. 48; bins of 400 Hz
SNR_SQL = "WITH " + FRAME_BINS + """,
  starts AS (SELECT unnest([4, 12, 28, 32, 36, 40, 44, 48]) AS s),
  win AS (SELECT frame * 64 + s AS frame, bin - s AS n, power_db * (0.5 - 0.5 * cos(2 * pi() * (bin - s) / 15)) AS re,
    0.0::DOUBLE AS im FROM frame_bins, starts WHERE bin >= s AND bin < s + 16), """ + dft("win", 16) + """,
  pow AS (SELECT frame // 64 AS frame, frame % 64 AS s, k, re * re + im * im AS p FROM spec WHERE k <= 8),
  noise AS (SELECT frame, median(p) AS floor FROM (SELECT frame, k, avg(p) AS p FROM pow
    WHERE s < 28 AND k * 400 > 200 AND k * 400 < 3100 AND NOT k * 400 BETWEEN 900 AND 2100 GROUP BY 1, 2) GROUP BY 1),
  sig AS (SELECT frame, max(p) AS best FROM (SELECT frame, s, sum(p) AS p FROM pow
    WHERE s >= 28 AND k * 400 BETWEEN 900 AND 2100 GROUP BY 1, 2) GROUP BY 1)
SELECT noise.frame, round_even(10 * log10(best / (floor * 6.25)), 0)::INT AS snr_db FROM noise JOIN sig ON sig.frame = noise.frame"""


def superposed(spark, sf):
    src = frames(spark, sf).select(
        F.floor(F.col("frame") / 4).alias("frame"), (F.pmod("frame", F.lit(4)) * 730.0).alias("shift_hz"),
        F.transform("x", lambda v: v * v).alias("power"))
    out = spectra.superpose(src, 0.0, 100.0, -500.0, 150.0, 64)
    return out.select("frame", "bin", r(F.col("power"), 8).alias("power"))


SUPER_SQL = "WITH " + FRAME_BINS + """,
  src AS (SELECT frame // 4 AS frame, (frame % 4) * 730.0 AS shift, frame AS id, bin, power_db * power_db AS p FROM frame_bins),
  ids AS (SELECT DISTINCT id, frame, shift FROM src),
  pos AS (SELECT id, frame, g AS bin, (-500.0 + g * 150.0 - shift) / 100.0 AS q
    FROM ids, (SELECT unnest(range(0, 64))::INT AS g)),
  lev AS (SELECT pos.frame, pos.bin, CASE WHEN q < 0 OR q > 63 THEN 0.0
      ELSE a.p * (1 - (q - floor(q))) + coalesce(b.p, 0) * (q - floor(q)) END AS p
    FROM pos LEFT JOIN src a ON a.id = pos.id AND a.bin = floor(q) LEFT JOIN src b ON b.id = pos.id AND b.bin = floor(q) + 1)
SELECT frame, bin, round(sum(p), 8) + 0.0 AS power FROM lev GROUP BY 1, 2"""


def aligned(spark, sf):
    src = frames(spark, sf).select(
        F.lit("all").alias("recording"), F.floor(F.col("frame") / 4).alias("frame"), F.lit(0.0).alias("shift_hz"),
        F.transform("x", lambda v: v * v).alias("power"))
    grid = spectra.superpose(src, 0.0, 100.0, 0.0, 100.0, 64, keys=("recording", "frame"))
    out = spectra.align_floor(grid, F.col("bin").between(10, 40), F.lit(-12.0))
    return out.select("frame", "bin", r(F.col("power_db"), 4).alias("power_db"))


ALIGN_SQL = "WITH " + FRAME_BINS + """,
  grid AS (SELECT frame // 4 AS frame, bin, 10 * log10(greatest(sum(power_db * power_db), 1e-30)) AS db
    FROM frame_bins GROUP BY 1, 2),
  low AS (SELECT quantile_cont(db, 0.10) AS low FROM grid WHERE bin BETWEEN 10 AND 40)
SELECT frame, bin, round(db - 12.0 - low, 4) + 0.0 AS power_db FROM grid, low"""


# ------------------------------------------------- levels and bin statistics

def square(spark, sf):
    df = iq32(spark, sf).select("frame", F.posexplode(num.c_square_array(F.col("re"), F.col("im"))).alias("n", "s"))
    return df.select("frame", "n", r(F.col("s.re"), 8).alias("re"), r(F.col("s.im"), 8).alias("im"))


def iq_rows(spark, sf):
    return iq32(spark, sf).select("frame", F.posexplode(F.arrays_zip("re", "im")).alias("n", "s")).select(
        "frame", "n", "s.re", "s.im")


def levels(spark, sf):
    a = num.c_abs(F.col("re"), F.col("im"))
    return iq_rows(spark, sf).select("frame", "n", r(a, 8).alias("magnitude"),
                                     r(num.to_db(a), 4).alias("amplitude_db"),
                                     r(num.to_db(a * a, "power"), 4).alias("power_db"))


def mixed(spark, sf):
    n = F.col("frame") * 32 + F.col("n")
    m = num.mix(F.col("re"), F.col("im"), n, 1510.0, 12_000.0)
    return iq_rows(spark, sf).select("frame", "n", r(m["re"], 8).alias("re"), r(m["im"], 8).alias("im"))


MIX_SQL = "WITH " + IQ32 + """, a AS (SELECT *, -2 * pi() * ((1510 * (frame * 32 + n)) % 12000) / 12000 AS w FROM iq32)
SELECT frame, n, round(re * cos(w) - im * sin(w), 8) + 0.0 AS re, round(re * sin(w) + im * cos(w), 8) + 0.0 AS im FROM a"""


def scaling(spark, sf):
    raw = frames(spark, sf).select("frame", F.transform("x", lambda v: F.rint(v * 32767)).alias("a"),
                                   F.transform("x", lambda v: F.rint(v * 100 + 128)).alias("b"))
    z = F.arrays_zip(num.normalise(F.col("a"), "i16").alias("s16"), num.normalise(F.col("b"), "u8").alias("u8"))
    return raw.select("frame", F.posexplode(z).alias("n", "s")).select(
        "frame", "n", r(F.col("s.s16"), 8).alias("s16"), r(F.col("s.u8"), 8).alias("u8"))


def taper(spark, sf):
    hz = (F.col("bin") - 32) * F.lit(100.0)
    return frame_bins(spark, sf).select("frame", "bin", r(num.lp_taper_db(F.col("power_db"), hz, 1000.0)).alias("power_db"))


def floors(spark, sf):
    return base.median_floor(frame_bins(spark, sf)).select("bin", r(F.col("floor_db"), 8).alias("floor_db"))


def flattened(spark, sf):
    df = frame_bins(spark, sf)
    return base.flatten(df, base.median_floor(df)).select("frame", "bin", r(F.col("flat_db"), 8).alias("flat_db"))


def window_floors(spark, sf):
    df = frame_bins(spark, sf).select(F.lit("s").alias("stream_id"), F.floor(F.col("frame") / 100).alias("window_id"),
                                      "bin", "power_db")
    return base.window_floor(df, bound=100).select("window_id", "bin", r(F.col("floor_db"), 8).alias("floor_db"))


def strided(spark, sf):
    return base.sample_stats(frame_bins(spark, sf)).select(
        r(F.col("min_db"), 8).alias("min_db"), r(F.col("max_db"), 8).alias("max_db"), r(F.col("mean_db"), 8).alias("mean_db"))


def rms(spark, sf):
    return base.rms_dbfs(series(spark, sf), span=100).select("stream_id", "span", r(F.col("dbfs"), 4).alias("dbfs"))


def scores(spark, sf):
    df = frames(spark, sf).withColumnRenamed("x", "power_db")
    return base.frame_score(df, min_span_db=0.01).select("frame", r(F.col("score")).alias("score"))


def smoothed(spark, sf):
    df = frames(spark, sf).select("frame", spectra.smooth_median(F.col("x"), 7).alias("s"))
    return bins(df, "s", "frame").select("frame", "bin", r(F.col("_v"), 8).alias("smooth"))


def edges(spark, sf):
    ranked = scaled(spark, sf)
    dead = (F.col("frame") < 7) | (F.col("frame") > 480) | F.col("frame").between(100, 110)
    df = ranked.withColumn("power_db", F.when(dead, F.transform("power_db", lambda v: v * 0.01 - 200)).otherwise(F.col("power_db")))
    return spectra.valid_frames(df).select("frame")


EDGE_SQL = "WITH " + FRAMES + """,
  p AS (SELECT frame, CASE WHEN frame < 7 OR frame > 480 OR frame BETWEEN 100 AND 110
    THEN list_max(list_transform(x, lambda v: v * 60.0 * 0.01 - 200)) ELSE list_max(x) * 60.0 END AS peak FROM frames),
  bad AS (SELECT frame, min(peak) OVER () <= -170 AND peak <= min(peak) OVER () + 6 AS bad FROM p),
  e AS (SELECT min(frame) AS a, max(frame) AS b FROM bad WHERE NOT bad)
SELECT frame FROM p, e WHERE frame BETWEEN a AND b"""


# ---------------------------------------------------------------- recurrences

def gate_blocks(spark, sf):
    b = framing.to_blocks(series(spark, sf), 16)
    return b.select("stream_id", "block_idx", F.col("x").alias("i"), F.transform("x", lambda v: F.lit(0.0)).alias("q"))


def impulse(spark, sf):
    g = recurrence.impulse_gate(gate_blocks(spark, sf), factor=1.4, size=16, rate=160.0, segment=50)
    return g.select("stream_id", "block_idx", "n_hot", "blanked")


ALPHA16 = 1.0 - math.exp(-16 / (2.0 * 160.0))
IMPULSE_SQL = "WITH RECURSIVE " + SERIES + """,
  x16 AS (SELECT stream_id || '/' || (n // 16) AS frame, n % 16 AS n, x AS re, 0.0::DOUBLE AS im FROM series), """ \
    + dft("x16", 16) + f""",
  packs AS (SELECT split_part(frame, '/', 1) AS stream_id, split_part(frame, '/', 2)::BIGINT AS block_idx,
    list(re * re + im * im ORDER BY k) AS p FROM spec GROUP BY frame),
  sizes AS (SELECT stream_id, n // 16 AS block_idx, count(*) AS c FROM series GROUP BY 1, 2),
  full_blocks AS (SELECT p.*, c = 16 AS ok FROM packs p JOIN sizes s ON s.stream_id = p.stream_id AND s.block_idx = p.block_idx),
  fold AS (
    SELECT stream_id, block_idx, ok, 0::BIGINT AS n_hot, false AS blanked,
      list_transform(p, lambda v: greatest(v, 1e-30)) AS avg FROM full_blocks WHERE block_idx = 0
    UNION ALL
    SELECT stream_id, block_idx, ok, n_hot, n_hot > 0.3 * 16,
      CASE WHEN NOT ok OR n_hot > 0.3 * 16 THEN avg
        ELSE list_transform(range(1, 17), lambda i: {1 - ALPHA16!r}::DOUBLE * avg[i] + {ALPHA16!r}::DOUBLE * p[i]) END
    FROM (SELECT b.stream_id, b.block_idx, b.ok, b.p, f.avg, CASE WHEN b.ok THEN
        len(list_filter(range(1, 17), lambda i: b.p[i] > {1.4 * 1.4!r}::DOUBLE * f.avg[i])) ELSE 0 END AS n_hot
      FROM fold f JOIN full_blocks b ON b.stream_id = f.stream_id AND b.block_idx = f.block_idx + 1))
SELECT stream_id, block_idx, n_hot, blanked FROM fold"""


def envelope_levels(spark, sf):
    ok = F.col("x") < 60
    b = (series(spark, sf).groupBy("stream_id", F.floor(F.col("n") / 16).alias("block_idx"))
         .agg(F.count_if(ok).alias("n_ok"), F.avg(F.when(ok, F.col("x"))).alias("mean_abs")))
    e = recurrence.envelope(b, size=16, rate=160.0, segment=20)
    return e.select("stream_id", "block_idx", r(F.col("envelope")).alias("envelope"))


ENVELOPE_SQL = "WITH RECURSIVE " + SERIES + """,
  b AS (SELECT stream_id, n // 16 AS block_idx, count(*) FILTER (WHERE x < 60) AS c, avg(x) FILTER (WHERE x < 60) AS v
    FROM series GROUP BY 1, 2),
  fold AS (
    SELECT stream_id, block_idx, v AS y FROM b WHERE block_idx = 0
    UNION ALL
    SELECT b.stream_id, b.block_idx, CASE WHEN b.c = 0 THEN y WHEN y IS NULL THEN b.v
      ELSE exp(-b.c / 320.0) * y + (1 - exp(-b.c / 320.0)) * b.v END
    FROM fold f JOIN b ON b.stream_id = f.stream_id AND b.block_idx = f.block_idx + 1)
SELECT stream_id, block_idx, round(y, 6) + 0.0 AS envelope FROM fold"""


def tracked(spark, sf):
    df = frames(spark, sf).withColumnRenamed("x", "power_db")
    t = recurrence.track_median(df, step_db=0.0625)
    return bins(t, "est_db", "frame").select("frame", "bin", r(F.col("_v"), 6).alias("est_db"))


def tracked_final(spark, sf):
    df = frames(spark, sf).withColumnRenamed("x", "power_db")
    t = recurrence.track_median(df, step_db=0.0625, passes=8)
    return t.select(F.posexplode("est_db").alias("bin", "_v")).select("bin", r(F.col("_v"), 6).alias("est_db"))


def smooth_sql(a: str) -> str:
    return (f"list_transform(range(0, 64), lambda i: list_sort(list_transform(range(-3, 4), "
            f"lambda d: {a}[least(greatest(i + d, 0), 63) + 1]))[4])")


TRACK_BASE = "WITH RECURSIVE " + FRAMES + f""",
  sm AS (SELECT frame, x, row_number() OVER (ORDER BY frame) AS rn, {smooth_sql('x')} AS s FROM frames),"""
TRACK_SQL = TRACK_BASE + f"""
  fold AS (
    SELECT 0::BIGINT AS rn, -1::BIGINT AS frame, x AS est FROM sm WHERE rn = 1
    UNION ALL
    SELECT rn, frame, {smooth_sql('e')} FROM (SELECT m.rn, m.frame,
      list_transform(range(1, 65), lambda i: f.est[i] + CASE WHEN m.s[i] > f.est[i] THEN 0.0625 ELSE -0.0625 END) AS e
      FROM fold f JOIN sm m ON m.rn = f.rn + 1))
SELECT frame, unnest(range(0, 64))::INT AS bin, unnest(list_transform(est, lambda v: round(v, 6) + 0.0)) AS est_db
FROM fold WHERE rn > 0"""
REPLAY_SQL = TRACK_BASE + f"""
  replay AS (SELECT frame, x, rn + p * (SELECT max(rn) FROM sm) AS rn, s FROM sm, (SELECT unnest(range(0, 8)) AS p)),
  fold AS (
    SELECT 0::BIGINT AS rn, x AS est FROM sm WHERE rn = 1
    UNION ALL
    SELECT rn, {smooth_sql('e')} FROM (SELECT m.rn,
      list_transform(range(1, 65), lambda i: f.est[i] + CASE WHEN m.s[i] > f.est[i] THEN 0.0625 ELSE -0.0625 END) AS e
      FROM fold f JOIN replay m ON m.rn = f.rn + 1))
SELECT unnest(range(0, 64))::INT AS bin, unnest(list_transform(est, lambda v: round(v, 6) + 0.0)) AS est_db
FROM fold WHERE rn = (SELECT max(rn) FROM replay)"""


QUERIES = {
    "frames_drop_tail": frames_drop,
    "frames_from_blocks": frames_cut,
    "frames_pad_tail": frames_pad,
    "frames_72ms_grid": frames_psd_grid,
    "segment_halo_window": halo_mean,
    "event_segments": event_windows,
    "packet_rebatch": rebatched,
    "time_slots": slot_rows,
    "last_write_per_slot": slot_last,
    "fir_lowpass_short": fir_short,
    "fir_highpass_short": fir_high,
    "fir_long_blocks": fir_long,
    "decimate_by_4": decimate_4,
    "decimate_by_20_blocks": decimate_20,
    "decimate_cascade": halve_twice,
    "resample_linear": resample,
    "soft_blank": blanked,
    "spectral_lowpass": spectral_lowpass,
    "spectral_bandpass": spectral_bandpass,
    "spectral_equalise": spectral_equalise,
    "analytic_signal": analytic_signal,
    "spectral_bandpass_long": spectral_bandpass_long,
    "analytic_signal_long": analytic_signal_long,
    "channelise": channelised,
    "channel_metrics": metrics_of_blocks,
    "waterfall_frames": waterfall,
    "psd_two_sided": psd_complex,
    "psd_one_sided": psd_real,
    "squared_detection_metric": squared_detection,
    "squared_spectrogram": squared_spectrogram,
    "tone_pair_metric": tone_pair,
    "local_peaks": peaks,
    "peak_pairs": pairs,
    "snr_estimate": snr,
    "spectra_superposed": superposed,
    "spectra_floor_aligned": aligned,
    "complex_square": square,
    "complex_levels": levels,
    "frequency_shift": mixed,
    "ingress_scaling": scaling,
    "lowpass_taper_db": taper,
    "median_floor": floors,
    "flatten_floor": flattened,
    "window_floor": window_floors,
    "strided_stats": strided,
    "rms_dbfs": rms,
    "frame_score": scores,
    "median_smooth": smoothed,
    "valid_frames": edges,
    "impulse_gate": impulse,
    "envelope_average": envelope_levels,
    "median_tracker_series": tracked,
    "median_tracker_replay": tracked_final,
}

FRAME_SQL = """
SELECT stream_id, f AS frame, (n - f * {hop})::INT AS pos, round(x, 6) + 0.0 AS x FROM series,
  LATERAL (SELECT unnest(range(greatest((n - {size} + {hop}) // {hop}, 0), n // {hop} + 1)) AS f)
WHERE n >= f * {hop} AND n < f * {hop} + {size}
  AND f * {hop} + {size} <= (SELECT count(*) FROM series t WHERE t.stream_id = series.stream_id)"""

SQL = {
    "frames_drop_tail": "WITH " + SERIES + FRAME_SQL.format(size=64, hop=32),
    "frames_from_blocks": "WITH " + SERIES + FRAME_SQL.format(size=64, hop=32),
    "frames_pad_tail": "WITH " + SERIES + """, len AS (SELECT stream_id, count(*) AS c FROM series GROUP BY 1),
  grid AS (SELECT stream_id, unnest(range(0, ((c - 1) // 63 + 1) * 64)) AS g FROM len)
SELECT grid.stream_id, g // 64 AS frame, (g % 64)::INT AS pos, round(coalesce(x, 0.0), 6) + 0.0 AS x
FROM grid LEFT JOIN series s ON s.stream_id = grid.stream_id AND g % 64 < 63 AND s.n = (g // 64) * 63 + g % 64""",
    "frames_72ms_grid": "WITH " + SERIES + """, len AS (SELECT stream_id, count(*) AS c FROM series GROUP BY 1),
  grid AS (SELECT stream_id, unnest(range(0, (c - 54) // 13 + 1)) AS frame FROM len)
SELECT g.stream_id, frame, round(sum(x), 6) + 0.0 AS total FROM grid g JOIN series s
  ON s.stream_id = g.stream_id AND s.n BETWEEN frame * 13 AND frame * 13 + 53 GROUP BY 1, 2""",
    "segment_halo_window": "WITH " + SERIES + """
SELECT stream_id, n, round(avg(x) OVER (PARTITION BY stream_id ORDER BY n ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) + 0.0 AS mean_10 FROM series""",
    "event_segments": EVENTS_SQL,
    "packet_rebatch": REBATCH_SQL,
    "time_slots": """SELECT event_id, floor(t / 3600)::BIGINT AS window_id,
  least(greatest(floor((t - floor(t / 3600) * 3600) * 0.05::DOUBLE)::BIGINT, 0), 169) AS slot,
  round(t - floor(t / 3600) * 3600, 3) + 0.0 AS position FROM (SELECT event_id, epoch_us(ts) / 1e6 AS t FROM events)""",
    "last_write_per_slot": """SELECT window_id, slot, arg_max(event_id, t) AS event_id, arg_max(value, t) AS value FROM (
  SELECT event_id, value, t, floor(t / 86400)::BIGINT AS window_id,
    least(greatest(floor((t - floor(t / 86400) * 86400) * 0.002::DOUBLE)::BIGINT, 0), 169) AS slot
  FROM (SELECT event_id, value, epoch_us(ts) / 1e6 AS t FROM events)) GROUP BY 1, 2""",
    "fir_lowpass_short": "WITH " + SERIES + ", " + fir_sql(SHORT) + OUT_SQL,
    "fir_highpass_short": "WITH " + SERIES + ", " + fir_sql(HIGH) + OUT_SQL,
    "fir_long_blocks": "WITH " + SERIES + ", " + fir_sql(LONG) + OUT_SQL,
    "decimate_by_4": "WITH " + SERIES + ", " + fir_sql(SHORT, step=4) + OUT_SQL,
    "decimate_by_20_blocks": "WITH " + SERIES + ", " + fir_sql(filters.fir_taps(101, 1000.0, 48_000.0), step=20) + OUT_SQL,
    "decimate_cascade": "WITH " + SERIES + ", " + fir_sql(HALF, out="h", step=2) + ", " + fir_sql(HALF, "h", "y", 2) + OUT_SQL,
    "resample_linear": RESAMPLE_SQL,
    "soft_blank": BLANK_SQL,
    "spectral_lowpass": "WITH " + IQ32 + ", " + inverse_sql(LOWPASS_GAIN, 32, "iq32", False),
    "spectral_bandpass": "WITH " + REAL64 + ", " + inverse_sql(BANDPASS_GAIN, 64, "x64", True),
    "spectral_equalise": "WITH " + REAL64 + ", " + inverse_sql(EQUALISE_GAIN, 64, "x64", True),
    "spectral_bandpass_long": whole_sql(f"{ramp('f', 10.0, 20.0)} * (1 - {ramp('f', 50.0, 60.0)})", "cos", "y"),
    "analytic_signal_long": whole_sql("CASE WHEN k = 0 OR 2 * k = m THEN 1 WHEN 2 * k < m THEN 2 ELSE 0 END", "sin", "im"),
    "analytic_signal": "WITH " + REAL64 + ", " + inverse_sql(ANALYTIC_GAIN, 64, "x64", False),
    "channelise": channel_sql(),
    "channel_metrics": metrics_sql(),
    "waterfall_frames": "WITH " + IQ32 + f", win AS (SELECT frame, n, re * {HANN32} AS re, im * {HANN32} AS im FROM iq32), "
        + dft("win", 32) + f"""
SELECT frame, ((k + 16) % 32)::INT AS bin,
  round(20 * log10(sqrt(re * re + im * im) / (32 * sqrt({W32 / 32!r}::DOUBLE)) + 1e-12), 4) + 0.0 AS power_db FROM spec""",
    "psd_two_sided": "WITH " + IQ32 + f", win AS (SELECT frame, n, re * {HANN32} AS re, im * {HANN32} AS im FROM iq32), "
        + dft("win", 32) + f"""
SELECT frame, ((k + 16) % 32)::INT AS bin,
  round(10 * log10((re * re + im * im) / {12000.0 * W32!r}::DOUBLE + 1e-20), 4) + 0.0 AS power_db FROM spec""",
    "psd_one_sided": "WITH " + REAL64 + f", win AS (SELECT frame, n, re * {HANN64} AS re, im FROM x64), "
        + dft("win", 64) + f"""
SELECT frame, k AS bin, round(10 * log10((re * re + im * im) / {6400.0 * W64!r}::DOUBLE + 1e-20), 4) + 0.0 AS power_db
FROM spec WHERE k <= 32""",
    "squared_detection_metric": DET_SQL,
    "squared_spectrogram": "WITH " + FADED + """
SELECT frame, ((k + 16) % 32)::INT AS bin, round(10 * log10(re * re + im * im + 1e-20), 4) + 0.0 AS power_db FROM spec""",
    "tone_pair_metric": TONE_SQL,
    "local_peaks": "WITH " + PEAKS + " SELECT frame, bin, round(p, 4) + 0.0 AS power_db FROM peaks",
    "peak_pairs": PAIR_SQL,
    "snr_estimate": SNR_SQL,
    "spectra_superposed": SUPER_SQL,
    "spectra_floor_aligned": ALIGN_SQL,
    "complex_square": "WITH " + SQUARED + " SELECT frame, n, round(re, 8) + 0.0 AS re, round(im, 8) + 0.0 AS im FROM sq",
    "complex_levels": "WITH " + IQ32 + """ SELECT frame, n, round(sqrt(re*re + im*im), 8) + 0.0 AS magnitude,
  round(20 * log10(sqrt(re*re + im*im) + 1e-12), 4) + 0.0 AS amplitude_db,
  round(10 * log10(greatest(re*re + im*im, 1e-30)), 4) + 0.0 AS power_db FROM iq32""",
    "frequency_shift": MIX_SQL,
    "ingress_scaling": "WITH " + FRAME_BINS + """ SELECT frame, bin AS n, round(round_even(power_db * 32767, 0) / 32768, 8) + 0.0 AS s16,
  round((round_even(power_db * 100 + 128, 0) - 127.5) / 127.5, 8) + 0.0 AS u8 FROM frame_bins""",
    "lowpass_taper_db": "WITH " + FRAME_BINS + """, h AS (SELECT *, abs(bin - 32) * 100.0::DOUBLE AS f FROM frame_bins)
SELECT frame, bin, round(CASE WHEN f <= 1000 THEN power_db WHEN f <= 2000
  THEN power_db - 60 * (0.5 - 0.5 * cos(pi() * (f - 1000) / 1000)) ELSE -200 END, 6) + 0.0 AS power_db FROM h""",
    "median_floor": "WITH " + FRAME_BINS + " SELECT bin, round(median(power_db), 8) + 0.0 AS floor_db FROM frame_bins GROUP BY 1",
    "flatten_floor": "WITH " + FRAME_BINS + """, f AS (SELECT bin, median(power_db) AS m FROM frame_bins GROUP BY 1)
SELECT frame, b.bin, round(power_db + (SELECT max(m) FROM f) - m, 8) + 0.0 AS flat_db FROM frame_bins b JOIN f ON f.bin = b.bin""",
    "window_floor": "WITH " + FRAME_BINS + """
SELECT frame // 100 AS window_id, bin, round(quantile_cont(power_db, 0.1), 8) + 0.0 AS floor_db FROM frame_bins GROUP BY 1, 2""",
    "strided_stats": "WITH " + FRAME_BINS + """ SELECT round(min(power_db), 8) + 0.0 AS min_db, round(max(power_db), 8) + 0.0 AS max_db,
  round(avg(power_db), 8) + 0.0 AS mean_db FROM frame_bins WHERE frame % 4 = 0 AND bin % 8 = 0""",
    "rms_dbfs": "WITH " + SERIES + """ SELECT stream_id, n // 100 AS span, round(20 * log10(sqrt(avg(x * x)) + 1e-12), 4) + 0.0 AS dbfs
FROM series GROUP BY 1, 2""",
    "frame_score": "WITH " + FRAME_BINS + """, m AS (SELECT frame, median(power_db) AS p FROM frame_bins GROUP BY 1),
  q AS (SELECT quantile_cont(p, 0.10) AS a, quantile_cont(p, 0.995) AS b FROM m)
SELECT frame, round((p - a) / greatest(b - a, 0.01), 6) + 0.0 AS score FROM m, q""",
    "median_smooth": "WITH " + FRAMES + f""", s AS (SELECT frame, {smooth_sql('x')} AS s FROM frames)
SELECT frame, unnest(range(0, 64))::INT AS bin, unnest(list_transform(s, lambda v: round(v, 8) + 0.0)) AS smooth FROM s""",
    "valid_frames": EDGE_SQL,
    "impulse_gate": IMPULSE_SQL,
    "envelope_average": ENVELOPE_SQL,
    "median_tracker_series": TRACK_SQL,
    "median_tracker_replay": REPLAY_SQL,
}
