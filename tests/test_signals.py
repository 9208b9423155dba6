"""Properties of the signal operators on made-up inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlake.functions import numeric as num
from burstlake.operators import filters, framing, spectra, transforms
from burstlake.operators import recurrence
from burstlake.plans.detection import DetectConfig, detect, receive
from burstlake.sources import recordings


def stream(spark, x, name="s"):
    return spark.createDataFrame([(name, i, float(v.real), float(v.imag)) for i, v in enumerate(x)],
                                 "stream_id string, n long, i double, q double").repartition(4)


def back(df, a="i", b="q", n="n"):
    rows = df.orderBy(n).collect()
    return np.array([r[a] + 1j * r[b] for r in rows])


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(7)
    return rng.normal(size=1000) + 1j * rng.normal(size=1000)


def test_taps_have_unit_gain():
    low = np.array(filters.fir_taps(7, 2700.0, 48_000.0))
    high = np.array(filters.fir_taps(9, 300.0, 12_000.0, pass_zero=False))
    assert low.sum() == pytest.approx(1.0)
    assert abs(np.sum(high * (-1.0) ** np.arange(9))) == pytest.approx(1.0)
    assert np.allclose(low, low[::-1]) and np.allclose(high, high[::-1])


def test_squaring_doubles_frequency(spark):
    n = np.arange(64)
    x = np.exp(2j * np.pi * 5 * n / 64)
    df = spark.createDataFrame([(x.real.tolist(), x.imag.tolist())], "re array<double>, im array<double>")
    sq = df.select(num.c_square_array(F.col("re"), F.col("im")).alias("s")).select("s.re", "s.im").first()
    y = np.abs(np.fft.fft(np.array(sq.re) + 1j * np.array(sq.im)))
    assert y.argmax() == 10


@pytest.mark.parametrize("block", [64, 128, 1000])
def test_block_filter_equals_convolution(spark, noise, block):
    taps = filters.fir_taps(33, 5000.0, 48_000.0)
    out = filters.fir(framing.to_blocks(stream(spark, noise), block, ("i", "q")), taps, ("i", "q"))
    assert np.allclose(back(framing.to_samples(out, ("i", "q"))), np.convolve(noise, taps)[:1000])


def test_long_row_filter_crosses_segments(spark, noise):
    taps = filters.fir_taps(9, 5000.0, 48_000.0)
    out = filters.fir_samples(stream(spark, noise), taps, ("i", "q"), segment=37)
    assert np.allclose(back(out), np.convolve(noise, taps)[:1000])


def test_decimation_is_independent_of_blocks(spark, noise):
    taps = filters.fir_taps(7, 2700.0, 48_000.0)
    want = np.convolve(noise, taps)[:1000:4]
    for block in (100, 256):
        out = filters.decimate(framing.to_blocks(stream(spark, noise), block, ("i", "q")), 4, taps, ("i", "q"))
        assert np.allclose(back(framing.to_samples(out, ("i", "q"))), want)
    assert np.allclose(back(filters.decimate_samples(stream(spark, noise), 4, taps, ("i", "q"))), want)


def test_channeliser_equals_direct_form(spark, noise):
    lp, hp = filters.fir_taps(7, 2700.0, 48_000.0), filters.fir_taps(9, 300.0, 12_000.0, pass_zero=False)
    out = filters.channelise(framing.to_blocks(stream(spark, noise), 128, ("i", "q")))
    got = framing.to_samples(out, ("i", "q"), ("stream_id", "channel"))
    for k in (0, 13, 47):
        mixed = noise * np.exp(-2j * np.pi * (k * 1000 + 500) * np.arange(1000) / 48_000)
        want = np.convolve(np.convolve(mixed, lp)[:1000:4], hp)[:250]
        assert np.allclose(back(got.where(F.col("channel") == k)), want)
    # the same from column expressions: mix, filter, decimate, filter
    m = num.mix(F.col("i"), F.col("q"), F.col("n"), 13_500.0, 48_000.0)
    direct = stream(spark, noise).select("stream_id", "n", m["re"].alias("i"), m["im"].alias("q"))
    direct = filters.fir_samples(filters.decimate_samples(direct, 4, lp, ("i", "q")), hp, ("i", "q"))
    assert np.allclose(back(direct), back(got.where("channel = 13")))


def test_resampling(spark, noise):
    for src, dst in ((48_000, 12_000), (12_000, 48_000), (48_000, 44_100)):
        m = round(1000 * dst / src)
        at = np.linspace(0, 999, m)
        want = np.interp(at, np.arange(1000), noise.real) + 1j * np.interp(at, np.arange(1000), noise.imag)
        assert np.allclose(back(filters.resample_linear(stream(spark, noise), src, dst, ("i", "q"), segment=64)), want)


def test_analytic_has_no_negative_frequencies(spark, noise):
    for n in (64, 63):
        df = spark.createDataFrame([(noise.real[:n].tolist(),)], "x array<double>")
        y = df.select(filters.analytic()("x").alias("y")).select("y.*").first()
        z = np.array(y.re) + 1j * np.array(y.im)
        assert np.allclose(z.real, noise.real[:n])
        assert np.abs(np.fft.fft(z)[n // 2 + 1:]).max() < 1e-9


def test_frames_of_both_forms_agree(spark, noise):
    a = framing.frames(stream(spark, noise), 96, 32, cols=("i", "q"))
    b = framing.frames_of_blocks(framing.to_blocks(stream(spark, noise), 64, ("i", "q")), 96, 32, 64, ("i", "q"))
    key = lambda df: {r.frame: (tuple(r.i), tuple(r.q)) for r in df.collect()}
    assert key(a) == key(b) and len(key(a)) == (1000 - 96) // 32 + 1


def test_tail_is_padded(spark, noise):
    f = framing.frames(stream(spark, noise), 504, 504, "pad", 512, ("i",)).orderBy("frame").collect()
    assert [len(r.i) for r in f] == [512, 512] and f[1].i[496:] == [0.0] * 16 and f[0].i[504:] == [0.0] * 8


def test_event_segment_at_the_edges(spark, noise):
    ev = spark.createDataFrame([("s", 1, 3), ("s", 2, 500), ("s", 3, 999)], "stream_id string, event_id int, at long")
    seg = framing.event_segments(framing.to_blocks(stream(spark, noise), 50, ("i",)), ev, 60, 80, 5, 50, ("i",))
    got = {r.event_id: r.i for r in seg.collect()}
    for e, at in ((1, 3), (2, 500), (3, 999)):
        assert np.allclose(got[e], [0.0] * 5 + noise.real[max(0, at - 60):at + 80].tolist() + [0.0] * 5)


def test_snr_rises_with_the_burst(spark):
    rng = np.random.default_rng(0)
    t = np.arange(12_000) / 12_000
    found = []
    for level in (0.0, 2.0, 20.0):
        x = rng.normal(size=21_600)
        x[8000:20_000] += level * np.sin(2 * np.pi * 1500 * t)
        df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
        found.append(df.select(spectra.snr_db()("x")).first()[0])
    assert found[0] < found[1] and found[2] - found[1] == pytest.approx(20, abs=2)
    short = spark.createDataFrame([([0.0] * 7200,), ([0.0] * 9000,)], "x array<double>")
    assert [r[0] for r in short.select(spectra.snr_db()("x")).collect()] == [None, None]


def test_burst_is_detected_at_its_channel(spark):
    """Two tones 1 kHz apart round +5.5 kHz in noise, from samples to a detection."""
    rng = np.random.default_rng(5)
    n = np.arange(3 * 48_000)
    x = 0.05 * (rng.normal(size=n.size) + 1j * rng.normal(size=n.size))
    on = slice(96_000, 110_000)
    fc = 5500.0
    x[on] += np.exp(2j * np.pi * (fc - 500) * n[on] / 48_000) + np.exp(2j * np.pi * (fc + 500) * n[on] / 48_000)
    blocks = spark.createDataFrame(
        [("s", b, b * 8192, x.real[b * 8192:(b + 1) * 8192].tolist(), x.imag[b * 8192:(b + 1) * 8192].tolist())
         for b in range(-(-n.size // 8192))],
        "stream_id string, block_idx long, first_sample long, i array<double>, q array<double>")
    ch = filters.channelise(blocks)
    fr = framing.frames_of_blocks(ch, 512, 256, 2048, ("i", "q"), ("stream_id", "channel"))
    metrics = fr.select("stream_id", "frame", "channel", spectra.tone_pair(12_000.0)("i", "q").alias("t")).select(
        "stream_id", "frame", "channel", "t.lin", "t.lo_hz", "t.hi_hz")
    # the same without channels leaving their task
    fused = filters.channel_metrics(blocks)
    key = lambda df: sorted((r.frame, r.channel, round(r.lin, 9), r.lo_hz, r.hi_hz) for r in df.collect())
    assert key(fused) == key(metrics)
    found = detect(fused, DetectConfig(threshold_db=20.0, max_channels=49, max_span=48)).collect()
    # 24,000 samples at 12 kHz are 93.75 hops; the metric is raised until the burst ends at 107.4
    assert found and all(91 <= r.frame <= 108 for r in found)
    best = max(found, key=lambda r: r.metric_db)
    assert best.channel == 5 and abs(best.fc_hz - fc) <= 15


def test_channel_labels(spark):
    df = spark.range(48).select(F.col("id").alias("k"))
    rows = df.select("k", num.channel_signed(F.col("k")).alias("s"), num.channel_display(F.col("k")).alias("d")).collect()
    assert [(r.s, r.d) for r in rows if r.k in (0, 24, 25, 47)] == [(0, 24), (24, 0), (-23, 1), (-1, 23)]
    assert num.drop_edge(df.withColumnRenamed("k", "channel")).count() == 39


def test_impulse_is_blanked_on_the_way(spark):
    """A click of 300 samples trips the gate; the samples round it are faded, the rest is untouched."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=4 * 8192) + 1j * rng.normal(size=4 * 8192)
    x[8180:8480] *= 200
    blocks = spark.createDataFrame(
        [("s", b, b * 8192, x.real[b * 8192:(b + 1) * 8192].tolist(), x.imag[b * 8192:(b + 1) * 8192].tolist()) for b in range(4)],
        "stream_id string, block_idx long, first_sample long, i array<double>, q array<double>")
    small = framing.split_blocks(blocks, 256, ("i", "q"))
    assert np.allclose(back(framing.to_samples(small, ("i", "q"))), x)
    gate = recurrence.impulse_gate(small)
    assert {r.block_idx for r in gate.where("blanked").collect()} == {31, 32, 33}
    wide = recurrence.impulse_gate(blocks, block=8192)
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, gate.collect()))
    mask = np.zeros(x.size)
    mask[31 * 256:34 * 256] = 1.0
    want = x * (1 - np.minimum(np.convolve(mask, np.hanning(49), mode="same"), 1.0))
    clean = filters.soft_blank(recurrence.gate_mask(blocks, gate), cols=("i", "q"))
    assert np.allclose(back(framing.to_samples(clean, ("i", "q"))), want)
    loud = detect(filters.channel_metrics(blocks), DetectConfig(threshold_db=15.0, max_channels=49, max_span=48)).count()
    assert loud > 0 and receive(blocks, DetectConfig(threshold_db=15.0, max_channels=49, max_span=48)).count() == 0


def test_whole_recordings_of_any_length_in_strips(spark):
    """By factors, by a chirp, very short, with a null key, and with a missing block, against the transform of the whole."""
    rng = np.random.default_rng(1)
    pair = lambda n: rng.normal(size=n) + 1j * rng.normal(size=n)
    signals = {"factors": pair(2310), "prime": pair(1009), "one": pair(1), "two": pair(2), "five": pair(5), None: pair(96)}
    rows = [(k, b // 64, v[b:b + 64].real.tolist(), v[b:b + 64].imag.tolist()) for k, v in signals.items() for b in range(0, len(v), 64)]
    rows = [r for r in rows if r[:2] != ("factors", 3)] + [("empty", 0, [], [])]
    signals["factors"][192:256] = 0
    df = spark.createDataFrame(rows, "stream_id string, block_idx long, i array<double>, q array<double>")
    gain = lambda k, n: 1.0 / (1.0 + np.minimum(k, n - k)) + 0.5j * (k % 3)
    found = transforms.spectral_blocks(df, gain, block=64, task=200).collect()
    assert {r.stream_id for r in found} == set(signals)
    for k, v in signals.items():
        mine = sorted((r for r in found if r.stream_id == k), key=lambda r: r.block_idx)
        assert [len(r.re) for r in mine] == [min(64, len(v) - b) for b in range(0, len(v), 64)]
        got = np.concatenate([np.array(r.re) + 1j * np.array(r.im) for r in mine])
        assert np.abs(got - np.fft.ifft(np.fft.fft(v) * gain(np.arange(len(v)), len(v)))).max() < 1e-12
    assert transforms.spectral_blocks(df.limit(0), gain, block=64).count() == 0
    assert transforms.shape_of(1 << 26) == (1 << 26, 8192, 8192, 32, 32, False) and transforms.shape_of((1 << 26) - 5).chirp


def test_long_recordings_become_analytic_as_short_ones_do(spark):
    rng = np.random.default_rng(2)
    rows = [(k, b // 64, b, 8000, v[b:b + 64].tolist(), [0.0] * len(v[b:b + 64])) for k, n in (("a", 1000), ("b", 997), ("c", 64))
            for v in [rng.normal(size=n)] for b in range(0, n, 64)]
    df = spark.createDataFrame(rows, recordings.PIECE)
    get = lambda short: {(r.stream_id, r.block_idx): r for r in recordings.analytic_blocks(df, 64, short).collect()}
    one, other = get(1 << 20), get(100)
    assert set(one) == set(other) and len(one) == 33
    for k in one:
        assert one[k].first_sample == other[k].first_sample and np.allclose(one[k].i, other[k].i, atol=1e-6) and np.allclose(one[k].q, other[k].q, atol=1e-6)
