"""Native formats, made by the tests."""

import json
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from burstlake.functions import messages as msg
from burstlake.plans import comparison, jobs
from burstlake.scale import cut_lineage
from burstlake.sinks import tables
from burstlake.sources import logs, packets, recordings


def wav(path, data: bytes, channels, width, rate=48_000):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(data)


def samples(df, name):
    rows = df.where(F.col("stream_id").endswith(name)).orderBy("block_idx").collect()
    assert [r.first_sample for r in rows] == [16 * k for k in range(len(rows))]
    return np.concatenate([np.array(r.i) + 1j * np.array(r.q) for r in rows])


def test_recordings_of_all_widths(spark, tmp_path):
    rng = np.random.default_rng(0)
    iq = rng.uniform(-1, 1, size=(100, 2))
    i16 = (iq * 32_000).astype("<i2")
    wav(tmp_path / "i16.wav", i16.tobytes(), 2, 2)
    u8 = (iq * 100 + 128).astype(np.uint8)
    wav(tmp_path / "u8.wav", u8.tobytes(), 2, 1)
    i32 = (iq * 2e9).astype("<i4")
    i32[0] = 0x7F800001, 5  # no finite float: these are integers
    wav(tmp_path / "i32.wav", i32.tobytes(), 2, 4)
    f32 = (iq * 4).astype("<f4")
    wav(tmp_path / "f32.wav", f32.tobytes(), 2, 4)
    mono = (iq[:, 0] * 32_000).astype("<i2")
    wav(tmp_path / "mono.wav", mono.tobytes(), 1, 2, 12_000)
    three = np.hstack([i16, i16[:, :1]])
    wav(tmp_path / "three.wav", three.tobytes(), 3, 2)
    df = recordings.read_recordings(spark, str(tmp_path), block=16, blocks_per_task=2).cache()
    pair = lambda a: a[:, 0] + 1j * a[:, 1]
    assert np.allclose(samples(df, "i16.wav"), pair(i16 / 32768.0), atol=1e-6)
    assert np.allclose(samples(df, "u8.wav"), pair((u8 - 128.0) / 128.0), atol=1e-6)
    assert np.allclose(samples(df, "f32.wav"), pair(f32 / np.abs(f32).max()), atol=1e-6)
    assert np.allclose(samples(df, "three.wav"), pair(i16 / 32768.0), atol=1e-6)
    assert np.allclose(samples(df, "i32.wav"), pair(i32 / 2147483648.0), atol=1e-6)
    z = samples(df, "mono.wav")
    assert np.allclose(z.real, mono / 32768.0, atol=1e-5) and np.abs(np.fft.fft(z)[51:]).max() < 1e-3
    assert {r.rate for r in df.where(F.col("stream_id").endswith("mono.wav")).collect()} == {12_000}
    # the same from a binary column
    content = spark.createDataFrame([("x/i16.wav", (tmp_path / "i16.wav").read_bytes())], "path string, content binary")
    assert np.allclose(samples(recordings.decode_recordings(content, block=16), "i16.wav"), pair(i16 / 32768.0), atol=1e-6)
    with pytest.raises(ValueError):
        recordings.raw_levels(b"123", 3, False, 0.0)


def test_recordings_behind_large_chunks_in_any_case_and_rf64(spark, tmp_path):
    iq = np.arange(40, dtype="<i2").reshape(20, 2)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 2, 48_000, 192_000, 4, 16)
    junk = struct.pack("<4sI", b"JUNK", 70_001) + bytes(70_002)
    data = struct.pack("<4sI", b"data", iq.nbytes) + iq.tobytes()
    (tmp_path / "late.WAV").write_bytes(struct.pack("<4sI4s", b"RIFF", 0, b"WAVE") + junk + fmt + data)
    ds64 = struct.pack("<4sIQQQI", b"ds64", 28, 0, iq.nbytes, 20, 0)
    tail = struct.pack("<4sI", b"LIST", 4) + b"abcd"
    (tmp_path / "long.wav").write_bytes(struct.pack("<4sI4s", b"RF64", 0xFFFFFFFF, b"WAVE") + ds64 + fmt
                                        + struct.pack("<4sI", b"data", 0xFFFFFFFF) + iq.tobytes() + tail)
    df = recordings.read_recordings(spark, str(tmp_path), block=16)
    for name in ("late.WAV", "long.wav"):
        assert np.allclose(samples(df, name), (iq[:, 0] + 1j * iq[:, 1]) / 32768.0)


def test_wrapped_data_size():
    head = struct.pack("<4sI4s", b"RIFF", 0, b"WAVE") + struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 2, 48_000, 192_000, 4, 16)
    true = (1 << 32) + 400
    head += struct.pack("<4sI", b"data", true % (1 << 32))
    assert recordings.wav_layout(lambda at, n: head[at:at + n], len(head) + true + 12)[3:] == (len(head), true // 4)


def packet(seq, pairs, class_id=None, tsf=2, trailer=False, sec=1_700_000_000, frac=5, stream=0xC0000001):
    body = b"".join(struct.pack("<ff", *p) for p in pairs)
    head = struct.pack(">I", stream) + (struct.pack(">Q", class_id) if class_id is not None else b"")
    head += struct.pack(">I", sec) + (struct.pack(">Q", frac) if tsf else b"")
    words = 1 + (len(head) + len(body)) // 4 + trailer
    w0 = (1 << 28) | ((class_id is not None) << 27) | (trailer << 26) | (1 << 22) | (tsf << 20) | (seq << 16) | words
    return struct.pack(">I", w0) + head + body + (b"\xde\xad\xbe\xef" if trailer else b"")


def test_packets(spark):
    rows = [(0, packet(3, [(1.5, -2.0), (0.25, 8.0)])), (1, packet(4, [(1.0, 2.0)], class_id=(1 << 64) - 1, trailer=True)),
            (2, packet(5, [(1.0, 2.0)], tsf=0)), (3, b"\x00\x01"), (4, packet(6, [])), (5, None),
            (6, packet(7, [(1.0, 2.0)])[:-4])]
    got = {r.k: r.packet for r in packets.read_packets(
        spark.createDataFrame(rows, "k int, payload binary").repartition(1)).collect()}
    assert (got[0].stream_id, got[0].seq, got[0].ts_sec, got[0].ts_frac, got[0].tsf) == (0xC0000001, 3, 1_700_000_000, 5, 2)
    assert list(got[0].i) == [1.5, 0.25] and list(got[0].q) == [-2.0, 8.0] and got[0].class_id is None
    assert int(got[1].class_id) == (1 << 64) - 1 and list(got[1].q) == [2.0]
    assert got[2].ts_frac == 0 and got[2].tsf == 0
    assert [got[k] for k in (3, 4, 5, 6)] == [None] * 4


def test_packet_times(spark):
    df = spark.createDataFrame([(1_700_000_000, 500, 2, 0), (1_700_000_000, 24_000, 1, 0), (7, 0, 2, 1_600_000_000_250_000)],
                               "ts_sec long, ts_frac long, tsf int, arrival_us long")
    got = [(r.time_sec, r.time_ps) for r in packets.normalise_time(df).collect()]
    assert got == [(1_700_000_000, 500), (1_700_000_000, 500_000_000_000), (1_600_000_000, 250_000_000_000)]
    moved = packets.normalise_time(df, buffered=F.lit(48_000)).collect()
    assert [r.time_sec for r in moved] == [1_699_999_999, 1_699_999_999, 1_599_999_999]


LINES = ['{"timestamp": "2026-03-01_10:00:00.5", "t_sec": 1.0, "radio_khz": 50260, "message": "CQ W1AW FN31", "jt9_snr_db": null}',
         "", "   ", "not json", '{"timestamp": "soon", "message": "x", "jt9_snr_db": -3}',
         '{"timestamp": "2026-03-01T09:00:00+00:00", "message": "early"}',
         '{"timestamp": "2026-03-01T10:30:00+02:00", "message": "zoned early"}',
         '{"timestamp": "2026-03-02 00:00:00", "message": "late"}']


def test_decode_log(spark, tmp_path):
    (tmp_path / "decodes.jsonl").write_text("\n".join(LINES))
    everything = logs.read_decode_log(spark, str(tmp_path))
    assert [r.message for r in everything.orderBy("line_no").collect()] == ["CQ W1AW FN31", "x", "early", "zoned early", "late"]
    since = logs.read_decode_log(spark, str(tmp_path), since="2026-03-01T10:00:00")
    assert [(r.line_no, r.message) for r in since.orderBy("line_no").collect()] == [(0, "CQ W1AW FN31"), (4, "x"), (7, "late")]
    with pytest.raises(ValueError):
        logs.read_decode_log(spark, str(tmp_path), since="yesterday")


def test_manifest_and_comparison(spark, tmp_path):
    """Three signals: one decoded twice, one garbled, one missed; one false alarm."""
    doc = {"generated_at": "2026-03-01T10:00:00+00:00", "output_wav": "a.wav", "output_rate": 48_000, "awgn_snr_db": 3.0,
           "placements": [
               {"msg": "AP05075N07150", "center_hz": 6500.0, "delay_s": 7.5, "freq_khz": 5, "time_ds": 75, "snr_db": -7, "width_ms": 150},
               {"msg": "AN09062P03128", "center_hz": -7500.0, "delay_s": 6.2, "freq_khz": -9, "time_ds": 62, "snr_db": 3, "width_ms": 128},
               {"msg": "CQ W1AW FN31", "center_hz": 1500.0, "delay_s": 12.0}]}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "n.json").write_text(json.dumps({"output_wav": "b.wav"}))
    m = logs.read_manifest(spark, str(tmp_path))
    assert m.where("output_wav = 'b.wav'").first().msg is None and m.count() == 4
    truth = comparison.truth_from_manifest(m)
    assert [r.msg for r in truth.orderBy("truth_no").collect()] == ["AN09062P03128", "AP05075N07150", "CQ W1AW FN31"]
    run = truth.first().run_id
    log = spark.createDataFrame(
        [(run, 0, "AP05075N07150", 6.4, 7.6), (run, 1, "2200 -3 AP05075N07150", 6.5, 7.5),
         (run, 2, "garbage", -7.0, 6.0), (run, 3, "W1AW K1TTT", 20.0, 1.0)],
        "run_id string, line_no long, message string, freq double, t_sec double")
    for claim_all, alarms in ((True, [3]), (False, [1, 3])):
        st, fa = comparison.compare(truth, log, claim_all=claim_all)
        assert {r.msg: (r.status, r.line_no) for r in st.collect()} == {
            "AP05075N07150": ("DECODED", 0), "AN09062P03128": ("GARBLED", 2), "CQ W1AW FN31": ("MISSED", None)}
        assert sorted(r.line_no for r in fa.collect()) == alarms
    launches = spark.createDataFrame([(run, o) for o in ("decoded", "no_decode", "no_decode", "timeout")], "run_id string, outcome string")
    rep = comparison.report(truth, log, launches).first()
    assert (rep.total, rep.decoded, rep.garbled, rep.missed, rep.false_alarms) == (3, 1, 1, 1, 1)
    assert (rep.launched, rep.launch_decoded, rep.no_decode, rep.timeout) == (4, 1, 2, 1)


def test_claimed_row_is_not_given_twice(spark):
    truth = spark.createDataFrame([(1, i, f"m{i}", 10.0, 5.0 + i / 10) for i in range(3)],
                                  "run_id int, truth_no long, msg string, freq double, t_sec double")
    log = spark.createDataFrame([(1, 0, "zzz", 10.0, 5.2), (1, 1, "yyy", 10.0, 6.5)],
                                "run_id int, line_no long, message string, freq double, t_sec double")
    st, fa = comparison.compare(truth, log)
    assert [r.status for r in st.orderBy("truth_no").collect()] == ["GARBLED", "MISSED", "MISSED"]
    assert [r.line_no for r in fa.collect()] == [1]


@pytest.mark.parametrize("text,want", [
    ("CQ W1AW FN31", ("W1AW", "CQ", "FN31")), ("W1AW K1TTT FN32", ("K1TTT", "W1AW", "FN32")),
    ("W1AW K1TTT -05", ("K1TTT", "W1AW", None)), ("W1AW K1TTT RR73", ("K1TTT", "W1AW", None)),
    ("W1AW K1TTT", ("K1TTT", "W1AW", None)), (" cq dx k1ttt/p fn31pr ", ("K1TTT/P", "CQ", "FN31PR")),
    ("AN09062P03128", ("", "", None)), ("hello world", ("", "", None))])
def test_messages(spark, text, want):
    m = spark.createDataFrame([(text,)], "m string").select(msg.parse_message(F.col("m")).alias("p")).first().p
    assert (m.de, m.to, m.grid) == want


def test_rr73_can_be_a_grid(spark):
    m = spark.createDataFrame([("W1AW K1TTT RR73",)], "m string").select(msg.parse_message(F.col("m"), True).alias("p")).first().p
    assert m.grid == "RR73"


def test_parameters_round_trip(spark):
    df = spark.createDataFrame([(f, t, s, w) for f in (-24, 0, 9) for t in (5, 150) for s in (-10, 0, 3) for w in (0, 999)],
                               "freq_khz int, time_ds int, snr_db int, width_ms int")
    out = df.withColumn("m", msg.encode_params(*[F.col(c) for c in df.columns]))
    out = out.withColumn("p", msg.decode_params(F.col("m")))
    for r in out.collect():
        assert len(r.m) == 13 and (r.p.freq_khz, r.p.time_ds, r.p.snr_db, r.p.width_ms) == (r.freq_khz, r.time_ds, r.snr_db, r.width_ms)
    one = spark.createDataFrame([("AN09062P03128",), ("B",)], "m string").select(msg.decode_params(F.col("m")).alias("p")).collect()
    assert tuple(one[0].p) == (-9, 62, 3, 128) and one[1].p.freq_khz is None


def test_decoder_output(spark):
    df = spark.createDataFrame([("\n<x>\n  123456  -3  0.2  1500  ~  CQ  W1AW FN31 \nmore",), ("EOF\n",), ("two words",)], "o string")
    got = [tuple(r.p) for r in df.select(msg.parse_decoder_output(F.col("o")).alias("p")).collect()]
    assert got == [("123456  -3  0.2  1500  ~  CQ  W1AW FN31", -3, "CQ W1AW FN31"), (None, None, None), ("two words", None, "two words")]


def test_status_lines(spark):
    lines = ["S1|client 0xA connected gui=1 client_id=u1 station=one program=x ip=1.2.3.4", "S1|client 0xB gui=0 client_id=u2 program=other",
             "S1|client 0xC gui=0 client_id=u3 program=SmartSDR-Win station=b", "R1|0| client 0xD gui=1 client_id=u1 station=two",
             "S1|slice 0 RF=50.2", "S1|client 0xE gui=1"]
    df = spark.createDataFrame(list(enumerate(lines)), "seq long, line string")
    got = {r.client_id: (r.handle, r.station, r.ip) for r in jobs.client_status(df).collect()}
    assert got == {"u1": ("0xD", "two", ""), "u3": ("0xC", "b", "")}
    kv = spark.createDataFrame([("a=1 b a=2 c=x=y d=",)], "l string")
    assert kv.select(msg.parse_kv(F.col("l"))).first()[0] == {"a": "2", "c": "x=y", "d": ""}
    assert kv.select(msg.parse_kv(F.col("l"), "first")).first()[0]["a"] == "1"
    assert tuple(kv.select(msg.kv_value(F.col("l"), "a"), msg.kv_value(F.col("l"), "a", "first"), msg.kv_value(F.col("l"), "c")).first()) == ("2", "1", "x=y")
    handles = spark.createDataFrame([("ip=1 gui_client_handles=0x1,,0x2", ), ("ip=2",)], "l string")
    assert [r[0] for r in handles.select(msg.list_value(msg.parse_kv(F.col("l")), "gui_client_handles")).collect()] == [["0x1", "0x2"], []]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("2026-03-01_10:00:00.0", 1.0, 50260, "CQ W1AW FN31", None, "l")],
                               "timestamp string, t_sec double, radio_khz long, message string, jt9_snr_db int, jt9_line string")
    for _ in range(2):
        tables.write_log(df, str(tmp_path / "log"))
    assert logs.read_decode_log(spark, str(tmp_path / "log")).count() == 2
    for run in (1, 2, 2):
        tables.write_report(df.select("message"), str(tmp_path / "rep"), run)
    assert sorted(r.run_id for r in spark.read.parquet(str(tmp_path / "rep")).collect()) == [1, 2]


def test_cut_lineage_keeps_rows(spark):
    df = spark.range(10).withColumn("s", F.struct(F.col("id").alias("a")))
    assert cut_lineage(df).where("s.a > 7").count() == 2 and cut_lineage(df.where("id < 0")).count() == 0
