"""The paths for very large keys, forced on small data, against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstlake import scale
from burstlake.operators import baseline, gates, matching, recurrence, runs
from burstlake.scale import islands, lagged, number_rows, quantiles, running_total, top_k


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(9)}", i, float(rng.choice([1, 1, 1, 2, 5, 7])))
            for i in rng.sample(range(10_000), 900)]
    return spark.createDataFrame(rows, "k string, o long, x double").repartition(5).cache()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_number_rows_spreads_a_big_key(skewed):
    assert rows(number_rows(skewed, ["k"], ["o"], task_rows=50), "k", "o", "n") == \
        rows(number_rows(skewed, ["k"], ["o"]), "k", "o", "n")


def test_running_total_of_weights(skewed):
    big = running_total(skewed, ["k"], ["o"], F.col("x").cast("long"), "s", task_rows=40)
    small = running_total(skewed, ["k"], ["o"], F.col("x").cast("long"), "s")
    assert rows(big, "k", "o", "s") == rows(small, "k", "o", "s")


def test_quantiles_with_many_ties(skewed):
    big = quantiles(skewed, ["k"], "x", {"a": 0.25, "b": 0.5, "c": 0.9}, task_rows=3)
    small = quantiles(skewed, ["k"], "x", {"a": 0.25, "b": 0.5, "c": 0.9})
    assert rows(big, "k", "a", "b", "c") == rows(small, "k", "a", "b", "c")
    pdf = skewed.toPandas()
    for k, a, b, c in rows(big, "k", "a", "b", "c"):
        assert np.allclose([a, b, c], np.percentile(pdf[pdf.k == k].x, [25, 50, 90]))


def test_lag_and_islands_cross_segments(skewed):
    assert rows(lagged(skewed, ["k"], ["o"], {"p": "x"}, task_rows=10, segment=7), "k", "o", "p") == \
        rows(lagged(skewed, ["k"], ["o"], {"p": "x"}), "k", "o", "p")
    new = F.col("o") - F.col("p") > 20
    assert rows(islands(skewed, ["k"], ["o"], {"p": "o"}, new, task_rows=10), "k", "o", "island") == \
        rows(islands(skewed, ["k"], ["o"], {"p": "o"}, new), "k", "o", "island")


def test_runs_of_a_big_key(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([("s", i, rng.random() * 5) for i in range(800)],
                               "stream_id string, frame long, metric double")
    a = runs.merge_runs(runs.threshold_runs(df, 3.0, task_rows=20), 3, task_rows=10)
    b = runs.merge_runs(runs.threshold_runs(df, 3.0), 3)
    assert rows(a, "start", "end", "peak") == rows(b, "start", "end", "peak")
    assert rows(runs.rank_runs(b, task_rows=5), "start", "rank") == rows(runs.rank_runs(b), "start", "rank")
    assert rows(top_k(b, 4, [F.desc("peak")]), "peak") == sorted((p,) for _, _, p in rows(b, "start", "end", "peak"))[-4:]


def greedy(events, gap):
    until, kept = -10**9, []
    for at, restart in sorted(events):
        if restart:
            until = at + gap
        elif at >= until:
            kept.append(at)
            until = at + gap
    return kept


@pytest.mark.parametrize("density", [1.0, 0.3, 0.02])
def test_cooldown_over_segments(spark, monkeypatch, density):
    monkeypatch.setattr(gates, "SEGMENT_FRAMES", 20)
    monkeypatch.setattr("burstlake.scale.CHAIN_FANOUT", 4)
    rng = random.Random(11)
    data = {c: [(f, rng.random() < 0.05) for f in range(700) if rng.random() < density] for c in (1, 2)}
    df = spark.createDataFrame([("s", c, f, r) for c, ev in data.items() for f, r in ev],
                               "stream_id string, channel int, frame long, again boolean")
    got = rows(gates.cooldown(df, 9, restart=F.col("again")), "channel", "frame")
    assert got == sorted((c, f) for c, ev in data.items() for f in greedy(ev, 9))


def test_cooldown_default_is_46(spark):
    df = spark.createDataFrame([("s", 0, f) for f in range(100)], "stream_id string, channel int, frame long")
    assert [r.frame for r in gates.cooldown(df).orderBy("frame").collect()] == [0, 46, 92]


def test_neighbours_over_segments(spark):
    rng = random.Random(2)
    data = sorted({(rng.randrange(150), rng.randrange(12)) for _ in range(300)})
    live, want = [], []
    for f, c in data:
        live = [a for a in live if f - a[0] < 15]
        if all(abs(c - a[1]) >= 2 for a in live):
            live.append((f, c))
            want.append((f, c))
    df = spark.createDataFrame([("s", f, c) for f, c in data], "stream_id string, frame long, channel int")
    got = rows(gates.suppress_neighbours(df, 2.0, 15, segment=40), "frame", "channel")
    assert got == want


@pytest.mark.parametrize("fold", [0, 20_000])
def test_spaced_changes(spark, monkeypatch, fold):
    monkeypatch.setattr(runs, "FOLD_ROWS", fold)
    rng = random.Random(4)
    data = [(k, i, float(i) / 3, rng.choice(["a", "b", None]), rng.randrange(2)) for k in ("p", "q") for i in range(120)]
    want = []
    for k in ("p", "q"):
        last = None
        for row in (d for d in data if d[0] == k):
            if last is None or (row[3:] != last[3:] and row[2] - last[2] >= 2.5):
                want.append(row)
                last = row
    df = spark.createDataFrame(data, "client_id string, seq long, t double, a string, b long")
    got = runs.on_change(df, ["a", "b"], time="t", min_gap=2.5, segment=50)
    assert [tuple(r) for r in got.orderBy("client_id", "seq").collect()] == want


def test_changes_without_interval(spark):
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])],
                               "client_id string, seq long, v string")
    assert [r.seq for r in runs.on_change(df, ["v"]).orderBy("seq").collect()] == [0, 2, 4, 5]


def test_rolling_quantile_segments(spark, monkeypatch):
    monkeypatch.setattr(baseline, "SEGMENT_FRAMES", 50)
    rng = np.random.default_rng(0)
    x = rng.random(400)
    df = spark.createDataFrame([("s", 0, f, float(v), f"r{f}") for f, v in enumerate(x)],
                               "stream_id string, channel int, frame long, lin double, note string")
    for refresh in (1, 10):
        out = baseline.rolling_quantile(df, depth=30, stride=3, refresh=refresh).orderBy("frame").collect()
        assert [r.note for r in out] == [f"r{f}" for f in range(400)]
        for r in out:
            at = r.frame - r.frame % refresh
            hist = sorted(x[f] for f in range(max(0, at - 29), at + 1) if f % 3 == 0)
            assert r.baseline == hist[int(len(hist) * 0.25)]


def gate_sequential(blocks, factor, frac, alpha):
    avg, out = None, []
    for b in blocks:
        power = np.abs(np.fft.fft(b)) ** 2
        avg = power if avg is None else avg
        hot = int(np.sum(power > factor ** 2 * avg))
        gone = hot > frac * len(b)
        out.append((hot, gone))
        avg = avg if gone else (1 - alpha) * avg + alpha * power
    return out


def test_impulse_gate_over_segments(spark):
    rng = np.random.default_rng(1)
    blocks = rng.normal(size=(100, 16)) + 1j * rng.normal(size=(100, 16))
    blocks[rng.choice(100, 6, replace=False)] *= 40
    df = spark.createDataFrame([("s", i, b.real.tolist(), b.imag.tolist()) for i, b in enumerate(blocks)],
                               "stream_id string, block_idx long, i array<double>, q array<double>")
    out = recurrence.impulse_gate(df, 3.0, 0.3, 16, rate=160.0, segment=35).orderBy("block_idx").collect()
    want = gate_sequential(blocks, 3.0, 0.3, 1 - np.exp(-16 / 320))
    assert [(r.n_hot, r.blanked) for r in out] == want
    assert any(r.blanked for r in out)


def test_median_tracker_in_order(spark):
    rng = np.random.default_rng(2)
    spec = rng.normal(scale=0.5, size=(50, 9))
    df = spark.createDataFrame([("r", i, s.tolist()) for i, s in enumerate(spec)],
                               "recording string, frame long, power_db array<double>")
    est, series = spec[0].copy(), []
    for _ in range(2):
        for s in spec:
            est = recurrence.track_step(est, s, 0.0625, 7)
            series.append(est)
    one = recurrence.track_median(df.repartition(5)).orderBy("frame").collect()
    assert np.allclose([r.est_db for r in one], series[:50])
    two = recurrence.track_median(df.repartition(5).unionByName(df.select(F.lit(None).cast("string").alias("recording"), "frame", "power_db")), passes=2).where("recording = 'r'").collect()
    assert np.allclose(two[0].est_db, series[-1])


def envelope_sequential(data, scale):
    y, want = None, []
    for _, _, n, v in data:
        if n and v is not None:
            a = 1 - np.exp(-n / scale)
            y = v if y is None else (1 - a) * y + a * v
        want.append(y)
    return want


@pytest.mark.parametrize("segment", [7, 50, 10_000])
@pytest.mark.parametrize("blanked", [0.06, 0.95])
def test_envelope_is_the_sequential_average(spark, segment, blanked):
    rng = np.random.default_rng(3)
    data = [(s, i, 0 if rng.random() < blanked or (s is None and i < 20) or 200 <= i < 330 else int(rng.integers(1, 17)),
             float(v) if i % 11 else None)
            for s in ("s", None) for i, v in enumerate(rng.random(400)) if not 60 <= i < 90]
    df = spark.createDataFrame(data, "stream_id string, block_idx long, n_ok long, mean_abs double")
    got = {(r.stream_id, r.block_idx): r.envelope
           for r in recurrence.envelope(df, 16, 160.0, tau=0.1, segment=segment).collect()}
    assert len(got) == len(data)
    for key in ("s", None):
        rows = [d for d in data if d[0] == key]
        for d, want in zip(rows, envelope_sequential(rows, 16.0)):
            have = got[key, d[1]]
            assert have is None if want is None else abs(have - want) < 1e-9


@pytest.mark.parametrize("segment", [10, 10_000])
def test_impulse_gate_keeps_its_average_over_a_gap(spark, segment):
    rng = np.random.default_rng(4)
    blocks = rng.normal(size=(60, 16)) + 1j * rng.normal(size=(60, 16))
    blocks[30:33] *= 40
    keep = [i for i in range(60) if not 8 <= i < 30]
    df = spark.createDataFrame([(s, i, blocks[i].real.tolist(), blocks[i].imag.tolist()) for i in keep for s in ("s", None)],
                               "stream_id string, block_idx long, i array<double>, q array<double>")
    out = recurrence.impulse_gate(df, 3.0, 0.3, 16, rate=160.0, segment=segment).orderBy("stream_id", "block_idx").collect()
    want = gate_sequential(blocks[keep], 3.0, 0.3, 1 - np.exp(-16 / 320))
    assert [(r.n_hot, r.blanked) for r in out] == want + want
    assert out[8].block_idx == 30 and out[8].blanked


@pytest.mark.parametrize("task_rows", [3, 1000])
def test_spaced_changes_tell_nulls_from_strings_at_every_size(spark, task_rows):
    rows = [("a", 0, 0.0, None, 0.0), ("a", 1, 9.0, "\0", 0.0), ("a", 2, 18.0, "\0", -0.0), ("a", 3, 27.0, "null", 1.0),
            ("a", 4, 36.0, None, 1.0), (None, 0, 0.0, "x", 1.0), (None, 1, 9.0, "x", None), (None, 2, 10.0, "y", 2.0)]
    df = spark.createDataFrame(rows, "client_id string, seq long, t double, s string, v double")
    got = runs.on_change(df, ["s", "v"], time="t", min_gap=2.5, task_rows=task_rows, segment=2)
    assert sorted(((r.client_id or "", r.seq) for r in got.collect())) == [("", 0), ("", 1), ("a", 0), ("a", 1), ("a", 3), ("a", 4)]


@pytest.mark.parametrize("leaf", [2, 10_000])
def test_nearest_in_crowded_cells(spark, leaf):
    rng = random.Random(8)
    pt = lambda: (round(rng.gauss(10, 0.4), 2), round(rng.gauss(100, 0.3), 2))
    logs = [(1, i, *pt()) for i in range(400)] + [(1, 400 + i, 10.0, 100.0) for i in range(100)]
    logs += [(1, 500 + i, rng.uniform(0, 30), rng.uniform(90, 110)) for i in range(60)]
    truths = [(1, i, *pt()) for i in range(80)] + [(1, 80 + i, rng.uniform(0, 30), rng.uniform(90, 110)) for i in range(80)]
    want = []
    for _, no, f, t in truths:
        best = min(((((g - f) / 2.0) ** 2 + ((u - t) / 1.5) ** 2, n) for _, n, g, u in logs
                    if abs(g - f) <= 2.0 and abs(u - t) <= 1.5), default=(0, None))
        want.append((no, best[1]))
    log = spark.createDataFrame(logs, "run_id long, line_no long, freq double, t_sec double")
    truth = spark.createDataFrame(truths, "run_id long, truth_no long, freq double, t_sec double")
    got = matching.match_nearest(truth, log, leaf=leaf).orderBy("truth_no").collect()
    assert [(r.truth_no, r.near_line) for r in got] == want


def test_large_keys_keep_null_keys_and_empty_groups(spark):
    rows = [("a", i, float(i * i % 7)) for i in range(9)] + [(None, i, float(i)) for i in range(6)] + [("z", i, None) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, n long, x double")

    def both(fn):
        out = [sorted((tuple(r) for r in fn(limit).collect()), key=repr) for limit in (1000, 2)]
        assert out[0] == out[1]
        return out[0]

    assert len(both(lambda m: number_rows(df, ["k"], ["n"], "i", task_rows=m).select("k", "n", "x", "i"))) == 18
    assert len(both(lambda m: lagged(df, ["k"], ["n"], {"p": "x"}, task_rows=m, segment=2).select("k", "n", "x", "p"))) == 18
    assert len(both(lambda m: quantiles(df, ["k"], "x", {"q": 0.3, "m": 0.5}, task_rows=m))) == 3
    assert len(both(lambda m: quantiles(df, ["k"], "x", {"q": 0.3}, task_rows=m, extra={"c": F.count("*")}))) == 3


@pytest.mark.parametrize("fan,levels,segment", [(2, 3, 5), (64, 4, 4096)])
def test_intervals_keep_every_truth_and_name_frames_that_exist(spark, fan, levels, segment):
    rng = random.Random(5)
    grid = [("s", c, f, float(rng.randrange(6))) for c in (0, 1) for f in sorted(rng.sample(range(400), 60))]
    truths = [("s", rng.choice([0, 1]), rng.randrange(-50, 450) + rng.random(), rng.choice([0.0, 0.4, 3.0, 90.0, 500.0])) for _ in range(200)]
    truths += [("s", 2, 5.0, 1.0), ("t", 0, 5.0, 1.0), ("s", 0, None, 1.0), (None, 0, 5.0, 1.0), truths[0]]
    want = []
    for s, c, a, w in truths:
        mine = [(f, m) for k, ch, f, m in grid if k == s and ch == c] if a is not None else []
        hits = [(-m, f) for f, m in mine if a <= f <= a + w]
        near = min(((abs(f - (a + w / 2)), f) for f, _ in mine), default=(0, None))[1]
        want.append((s, c, a, w, min(hits)[1] if hits else near, bool(hits)))
    got = matching.match_interval(
        spark.createDataFrame(truths, "stream_id string, channel int, start double, width double"),
        spark.createDataFrame(grid, "stream_id string, channel int, frame long, metric_db double"), 0.0, 1.0,
        fan=fan, levels=levels, segment=segment)
    rows = [(r.stream_id, r.channel, r.start, r.width, r.frame, r.inside) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("warm", [1, 4])
def test_warmed_scan_is_the_sequential_one(spark, warm):
    """A decaying sum over segments of 10 rows: warm-up over one segment doesn't forget enough and is put right by rounds."""
    rng = np.random.default_rng(5)
    data = [(k, i, float(v)) for k, n in (("a", 95), ("b", 7), (None, 33)) for i, v in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(data, "key string, i long, v double").withColumn("seg", F.floor(F.col("i") / 10).cast("long"))

    def step(rows, state):
        at, out = (state or [0.0])[0], []
        rows = rows.sort_values("i")
        for v in rows["v"]:
            at = 0.4 * at + v
            out.append(at)
        return pd.DataFrame({"key": rows["key"], "i": rows["i"], "sum": out}), [at]

    got = scale.scan_segments(df, ["key"], "seg", step, T.StructType([df.schema["key"], df.schema["i"], T.StructField("sum", T.DoubleType())]),
                              tol=1e-12, warm=warm, order="i").collect()
    want, at = {}, {}
    for k, i, v in data:
        at[k] = want[k, i] = 0.4 * at.get(k, 0.0) + v
    assert len(got) == len(want) and all(abs(r["sum"] - want[r["key"], r["i"]]) < 1e-10 for r in got)
