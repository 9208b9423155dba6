"""Text, status, packet and match queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from burstlake.functions import messages as msg
from burstlake.functions import numeric as num
from burstlake.operators import baseline as base
from burstlake.operators import framing, matching, runs
from burstlake.plans import comparison, jobs
from burstlake.scale import fresh_dir, top_k
from burstlake.sources import logs, packets as pk, recordings

from .bindings import (HEAT, K, MESSAGES, PACKETS, SERIES, STATUS, TRUTH, epoch_us, heat, k_of, log, messages,
                       packets, series, status_lines, table, truth)
from .detection import r

FREQ_TOL, TIME_TOL = 25.0, 7200.0

# ---------------------------------------------------------------- messages

CALL, GRID, REPORT = msg.CALL, msg.GRID, msg.REPORT
CQ, REPLY = msg.CQ_PATTERN, msg.REPLY_PATTERN


def parsed_sql(rr73: bool) -> str:
    extra = "" if rr73 else " AND tail <> 'RR73'"
    return f"""m AS (SELECT *, upper(trim(message)) AS u FROM messages),
  p AS (SELECT *, regexp_matches(u, '{CQ}') AS cq, regexp_matches(u, '{REPLY}') AS reply,
    regexp_extract(u, '{REPLY}', 3) AS tail FROM m),
  parsed AS (SELECT id, message, radio_khz, snr_db,
    CASE WHEN cq THEN regexp_extract(u, '{CQ}', 1) WHEN reply THEN regexp_extract(u, '{REPLY}', 2) ELSE '' END AS de,
    CASE WHEN cq THEN 'CQ' WHEN reply THEN regexp_extract(u, '{REPLY}', 1) ELSE '' END AS to_call,
    CASE WHEN cq THEN nullif(regexp_extract(u, '{CQ}', 2), '')
      WHEN reply AND regexp_matches(tail, '^{GRID}'){extra} THEN tail END AS grid FROM p)"""


def parse(rr73):
    def q(spark, sf):
        m = msg.parse_message(F.col("message"), rr73)
        return messages(spark, sf).select("id", m["de"].alias("de"), m["to"].alias("to_call"), m["grid"].alias("grid"))
    return q


def codec(spark, sf):
    k = F.col("c_custkey")
    p = [(k % 49 - 24).cast("int"), (5 + k % 146).cast("int"), (k % 21 - 10).cast("int"), (k % 1000).cast("int")]
    df = table(spark, sf, "customer").select(k.alias("id"), msg.encode_params(*p).alias("msg"))
    return df.select("id", "msg", msg.decode_params(F.col("msg")).alias("d")).select("id", "msg", "d.*")


CODEC_SQL = """SELECT c_custkey AS id, 'A' || CASE WHEN f >= 0 THEN 'P' ELSE 'N' END || lpad(abs(f)::VARCHAR, 2, '0') || lpad(t::VARCHAR, 3, '0')
  || CASE WHEN s >= 0 THEN 'P' ELSE 'N' END || lpad(abs(s)::VARCHAR, 2, '0') || lpad(w::VARCHAR, 3, '0') AS msg,
  f AS freq_khz, t AS time_ds, s AS snr_db, w AS width_ms
FROM (SELECT c_custkey, (c_custkey % 49 - 24)::INT AS f, (5 + c_custkey % 146)::INT AS t, (c_custkey % 21 - 10)::INT AS s,
  (c_custkey % 1000)::INT AS w FROM customer)"""


def outputs(spark, sf):
    """Decoder text: sometimes only markers, sometimes a short line, usually a full one."""
    m, k = messages(spark, sf), F.col("id")
    snr = F.when(k % 5 == 0, "x").otherwise((k % 40 - 20).cast("string"))
    full = F.concat(F.lit("123456  "), snr, F.lit("  0.4  1500  ~  "), F.trim("message"))
    text = (F.when(k % 9 == 0, F.lit("<DecodeFinished>   0   0\nEOF on input file\n"))
             .when(k % 9 == 1, F.concat(F.lit("\n  short "), k, F.lit("\n")))
             .otherwise(F.concat(F.lit("\nEOF\n <x>\n "), full, F.lit(" \n<DecodeFinished>\n"))))
    return m.select("id", text.alias("output"), F.timestamp_seconds(F.lit(1_700_000_000) + k * 61).alias("ts"),
                    (F.lit(1000.0) * (k % 48) - F.lit(23_500.0)).alias("fc_hz"), (k % 30).cast("int").alias("est_snr"))


OUTPUTS = MESSAGES + """,
  o AS (SELECT id, CASE WHEN id % 9 = 0 THEN NULL WHEN id % 9 = 1 THEN 'short ' || id
      ELSE '123456  ' || snr || '  0.4  1500  ~  ' || trim(message) END AS line,
    regexp_replace(trim(message), '\\s+', ' ', 'g') AS words, snr,
    1700000000 + id * 61 AS sec, 1000.0::DOUBLE * (id % 48) - 23500 AS fc_hz, (id % 30)::INT AS est_snr
    FROM (SELECT *, CASE WHEN id % 5 = 0 THEN 'x' ELSE (id % 40 - 20)::VARCHAR END AS snr FROM messages)),
  po AS (SELECT *, CASE WHEN id % 9 = 0 THEN NULL WHEN id % 9 = 1 THEN try_cast(id::VARCHAR AS INT) ELSE try_cast(snr AS INT) END AS dsnr,
    CASE WHEN id % 9 = 0 THEN NULL WHEN id % 9 = 1 THEN line ELSE words END AS msg FROM o)"""


def decoder_text(spark, sf):
    o = msg.parse_decoder_output(F.col("output"))
    return outputs(spark, sf).select("id", o["line"].alias("line"), o["snr_db"].alias("snr_db"), o["message"].alias("message"))


def log_rows(spark, sf):
    out = jobs.decode_rows(outputs(spark, sf), centre_mhz=F.lit(50.26))
    return out.select("id", "outcome", "message", "jt9_snr_db", "jt9_line", "radio_khz", "file_name")


LOG_ROWS_SQL = "WITH " + OUTPUTS + """
SELECT id, CASE WHEN line IS NULL THEN 'no_decode' ELSE 'decoded' END AS outcome, msg AS message,
  CASE WHEN line IS NOT NULL THEN coalesce(dsnr, est_snr) END AS jt9_snr_db, line AS jt9_line,
  round_even(50.26::DOUBLE * 1000 + (fc_hz - 1500) / 1000, 0)::BIGINT AS radio_khz,
  CASE WHEN line IS NOT NULL THEN strftime(make_timestamp(sec * 1000000), '%Y%m%d_%H%M%S') || 'Z_'
    || round_even(50.26::DOUBLE * 1000 + (fc_hz - 1500) / 1000, 0)::BIGINT || 'kHz_'
    || trim(regexp_replace(msg, '[^A-Za-z0-9]+', '_', 'g'), '_') END AS file_name FROM po"""


def spots(need_grid):
    def q(spark, sf):
        out = jobs.spots(messages(spark, sf), "A0AA", need_grid)
        return out.select("id", "de_call", "to_call", "de_grid", "freq_hz", "snr", "mode", "comment")
    return q


def spots_sql(need_grid):
    return "WITH " + MESSAGES + ", " + parsed_sql(False) + f"""
SELECT id, de AS de_call, to_call, grid AS de_grid, round_even(radio_khz * 1000, 0)::BIGINT AS freq_hz,
  greatest(-127, least(127, coalesce(snr_db, 0)))::INT AS snr, 'MSK144' AS mode,
  trim('MSK144 ' || coalesce(grid, '') || ' ' || CASE WHEN snr_db IS NULL THEN '' ELSE
    (CASE WHEN snr_db >= 0 THEN '+' ELSE '-' END) || abs(snr_db) || 'dB' END) AS comment
FROM parsed WHERE de <> '' AND de <> 'A0AA'{' AND grid IS NOT NULL' if need_grid else ''}"""


def rollup(spark, sf):
    m = messages(spark, sf).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 7))
    out = jobs.spot_rollup(jobs.spots(m, "A0AA", False))
    return out.select("de_call", F.unix_seconds("window_start").alias("window_start"), "spots", "best_snr")


ROLLUP_SQL = "WITH " + MESSAGES + ", " + parsed_sql(False) + """
SELECT de AS de_call, (1700000000 + id * 7) // 300 * 300 AS window_start, count(*) AS spots,
  max(greatest(-127, least(127, coalesce(snr_db, 0))))::INT AS best_snr
FROM parsed WHERE de <> '' AND de <> 'A0AA' GROUP BY 1, 2"""


def dial(spark, sf):
    khz = num.dial_khz(F.lit(50.26), F.col("x") * 10 - 1000)
    return series(spark, sf).select("stream_id", "n", r(khz).alias("khz"), num.round_even(khz).alias("whole_khz"),
                                    num.round_even(F.col("n") / 2).alias("half_even"))


def day_times(spark, sf):
    text = F.when(F.col("n") % 11 == 0, F.concat(F.lit("x:"), F.col("n"))).when(
        F.col("n") % 11 == 1, F.lit("12:30")).otherwise(F.concat_ws(
            ":", F.col("n") % 24, F.lpad((F.col("n") % 60).cast("string"), 2, "0"), F.floor("x") % 60))
    return series(spark, sf).select("stream_id", "n", num.ms_of_day(text).alias("ms"))


def units(spark, sf):
    f = F.when(F.col("n") % 2 == 0, F.concat("n", F.lit("000000"))).when(F.col("n") % 7 == 1, "n/a").otherwise(
        F.col("x").cast("string"))
    b = F.when(F.col("n") % 3 == 0, F.lit("-1")).when(F.col("n") % 3 == 1, F.lit("0.0625")).otherwise(
        F.col("n").cast("string"))
    return series(spark, sf).select("stream_id", "n", r(num.freq_mhz(f)).alias("mhz"), r(num.bandwidth_hz(b)).alias("hz"))


UNITS_SQL = "WITH " + SERIES + """, t AS (SELECT stream_id, n,
    try_cast(CASE WHEN n % 2 = 0 THEN n || '000000' WHEN n % 7 = 1 THEN 'n/a' ELSE x::VARCHAR END AS DOUBLE) AS f,
    try_cast(CASE WHEN n % 3 = 0 THEN '-1' WHEN n % 3 = 1 THEN '0.0625' ELSE n::VARCHAR END AS DOUBLE) AS b FROM series)
SELECT stream_id, n, round(CASE WHEN f >= 1e6 THEN f / 1e6 ELSE f END, 6) + 0.0 AS mhz,
  round(CASE WHEN b <= 0 THEN NULL WHEN b < 1000 THEN b * 1e6 ELSE b END, 6) + 0.0 AS hz FROM t"""


# ---------------------------------------------------------------- status lines

def kv(keep):
    def q(spark, sf):
        m = msg.parse_kv(F.col("line"), keep)
        return status_lines(spark, sf).select("seq", F.explode(m).alias("k", "v"))
    return q


def kv_sql(keep):
    return "WITH " + STATUS + f""",
  tok AS (SELECT seq, unnest(string_split(line, ' ')) AS t, unnest(range(0, len(string_split(line, ' ')))) AS i FROM status),
  pair AS (SELECT seq, i, t[:instr(t, '=') - 1] AS k, t[instr(t, '=') + 1:] AS v FROM tok WHERE contains(t, '='))
SELECT seq, k, {'arg_max' if keep == 'last' else 'arg_min'}(v, i) AS v FROM pair GROUP BY 1, 2"""


def clients(spark, sf):
    return jobs.client_status(status_lines(spark, sf)).orderBy("station", "client_id")


CLIENTS_SQL = "WITH " + STATUS + """,
  f AS (SELECT seq, regexp_extract(line, 'client (\\S+)', 1) AS handle, regexp_extract(line, 'gui=(\\S+)', 1) AS gui,
    regexp_extract(line, 'client_id=(\\S+)', 1) AS client_id, regexp_extract(line, '.*station=(S=\\S+|\\S+)', 1) AS station,
    regexp_extract(line, 'program=(\\S+)', 1) AS program FROM status)
SELECT client_id, arg_max(handle, seq) AS handle, arg_max(station, seq) AS station, arg_max(program, seq) AS program,
  '' AS host, '' AS ip FROM f WHERE gui = '1' OR program LIKE 'SmartSDR%' GROUP BY client_id"""
CLIENTS_SQL = CLIENTS_SQL.replace("'.*station=(S=\\S+|\\S+)'", "'.* station=(\\S+)'")


def tuning_lines(spark, sf):
    ev = table(spark, sf, "events")
    line = num.let(k_of(), lambda k: F.concat(
        F.lit("display pan center="), F.when(k % 2 == 0, "50.26").otherwise("50313000"),
        F.lit(" bandwidth="), F.when(k % 5 < 3, "0.0625").otherwise("96000")))
    return ev.select(F.col("user_id").alias("pan_id"), F.col("event_id").alias("seq"), (epoch_us() / 1e6).alias("t"),
                     line.alias("line"))


TUNING = f"""tune AS (SELECT user_id AS pan_id, event_id AS seq, epoch_us(ts) / 1e6 AS t,
  CASE WHEN {K}::INT % 2 = 0 THEN 50.26::DOUBLE ELSE 50.313::DOUBLE END AS centre_mhz,
  CASE WHEN {K}::INT % 5 < 3 THEN 62500.0::DOUBLE ELSE 96000.0::DOUBLE END AS bandwidth_hz FROM events)"""


def changes(spark, sf):
    return jobs.tuning_history(tuning_lines(spark, sf), ["pan_id"]).select("pan_id", "seq", "centre_mhz", "bandwidth_hz")


def changes_spaced(spark, sf):
    return jobs.tuning_history(tuning_lines(spark, sf), ["pan_id"], time="t", min_gap=86_400.0).select(
        "pan_id", "seq", "centre_mhz", "bandwidth_hz")


CHANGES_SPACED_SQL = "WITH RECURSIVE " + TUNING + """,
  o AS (SELECT *, row_number() OVER (PARTITION BY pan_id ORDER BY seq) AS rn FROM tune),
  fold AS (
    SELECT pan_id, rn, seq, centre_mhz, bandwidth_hz, true AS keep, t AS lt, centre_mhz AS lc, bandwidth_hz AS lb FROM o WHERE rn = 1
    UNION ALL
    SELECT pan_id, rn, seq, centre_mhz, bandwidth_hz, ok, CASE WHEN ok THEN t ELSE lt END,
      CASE WHEN ok THEN centre_mhz ELSE lc END, CASE WHEN ok THEN bandwidth_hz ELSE lb END
    FROM (SELECT o.*, f.lt, f.lc, f.lb, (o.centre_mhz <> f.lc OR o.bandwidth_hz <> f.lb) AND o.t - f.lt >= 86400 AS ok
      FROM fold f JOIN o ON o.pan_id = f.pan_id AND o.rn = f.rn + 1))
SELECT pan_id, seq, centre_mhz, bandwidth_hz FROM fold WHERE keep"""


# ---------------------------------------------------------------- packets

def gaps(spark, sf):
    return runs.seq_gaps(packets(spark, sf)).select("stream_id", "arrival", "missed")


def packet_health(spark, sf):
    h = jobs.packet_health(packets(spark, sf))
    return h.select("stream_id", "packets", "missed", r(F.col("loss_percent")).alias("loss_percent"))


GAPS = PACKETS + """, gaps AS (SELECT stream_id, arrival, coalesce((seq - lag(seq) OVER (PARTITION BY stream_id ORDER BY arrival) - 1 + 32) % 16, 0)::BIGINT AS missed
  FROM packets)"""


def blanked_share(spark, sf):
    s = series(spark, sf)
    h = base.health(s, ["stream_id"], F.when(F.col("x") > 100, 1).otherwise(0), F.lit(1))
    return h.select("stream_id", r(F.col("percent")).alias("percent"))


def wire(spark, sf):
    """Each event as a packet: header, times and two complex samples in bytes."""
    p = packets(spark, sf)
    n = F.col("arrival")
    has_class, has_trailer, tsf = n % 3 == 0, n % 5 == 0, (n % 3).cast("bigint")
    short = n % 17 == 0
    words = (F.lit(3) + F.when(short, 1).otherwise(4) + F.when(has_class, 2).otherwise(0) + F.when(has_trailer, 1).otherwise(0)
             + F.when(tsf != 0, 2).otherwise(0)).cast("bigint")
    word0 = (F.lit(1 << 28) + F.when(has_class, 1 << 27).otherwise(0) + F.when(has_trailer, 1 << 26).otherwise(0)
             + F.lit(1 << 22) + tsf * F.lit(1 << 20) + F.col("seq") * F.lit(1 << 16) + words).cast("bigint")
    h = lambda v, d: F.lpad(F.hex(v), d, "0")
    body = F.when(short, F.lit("0000803F")).otherwise(F.lit("0000803F000000C00000003F000020C1"))
    text = F.concat(h(word0, 8), h(F.col("stream_id"), 8), F.when(has_class, h(n * 1000003, 16)).otherwise(""),
                    h(F.col("ts_sec"), 8), F.when(tsf != 0, h(F.when(tsf == 2, F.col("us") * 1_000_000)
                                                              .otherwise(F.col("us") % 48_000), 16)).otherwise(""),
                    body, F.when(has_trailer, "DEADBEEF").otherwise(""))
    return p.select("arrival", (F.col("ts_sec") * 1_000_000 + F.col("us")).alias("arrival_us"), F.unhex(text).alias("payload"))


def packet_fields(spark, sf):
    p = pk.read_packets(wire(spark, sf)).where("packet is not null").select("arrival", "packet.*")
    total = lambda c: F.aggregate(F.col(c).cast("array<double>"), F.lit(0.0), lambda a, v: a + v)
    return p.select("arrival", "packet_type", "stream_id", F.col("class_id").cast("bigint").alias("class_id"), "tsi",
                    "ts_sec", "tsf", "ts_frac", "seq", F.size("i").alias("n_samples"), total("i").alias("sum_i"),
                    total("q").alias("sum_q"))


PACKET_SQL = "WITH " + PACKETS + """
SELECT arrival, 1::INT AS packet_type, stream_id, CASE WHEN arrival % 3 = 0 THEN arrival * 1000003 END AS class_id, 1::INT AS tsi, ts_sec,
  (arrival % 3)::INT AS tsf, CASE arrival % 3 WHEN 0 THEN 0 WHEN 2 THEN us * 1000000 ELSE us % 48000 END AS ts_frac, seq,
  2::INT AS n_samples, 1.5::DOUBLE AS sum_i, -12.0::DOUBLE AS sum_q FROM packets WHERE arrival % 17 <> 0"""


def packet_times(spark, sf):
    p = packets(spark, sf).withColumns({
        "tsf": (F.col("arrival") % 3).cast("int"),
        "arrival_us": F.col("ts_sec") * 1_000_000 + F.col("us"),
        "ts_sec": F.when(F.col("arrival") % 7 == 0, F.lit(12)).otherwise(F.col("ts_sec")).cast("bigint"),
        "ts_frac": F.when(F.col("arrival") % 3 == 2, F.col("us") * 1_000_000).otherwise(F.col("us") % 48_000)})
    out = pk.normalise_time(p, 48_000.0, buffered=F.col("arrival") % 100)
    return out.select("arrival", "time_sec", "time_ps")


TIMES_SQL = "WITH " + PACKETS + """,
  a AS (SELECT arrival, CASE WHEN arrival % 7 = 0 THEN ts_sec ELSE ts_sec END AS sec, CASE WHEN arrival % 7 = 0 THEN us * 1000000
      WHEN arrival % 3 = 2 THEN us * 1000000 ELSE trunc((us % 48000) * (1e12::DOUBLE / 48000))::BIGINT END
      - round_even((arrival % 100) * (1e12::DOUBLE / 48000), 0)::BIGINT AS ps FROM packets)
SELECT arrival, (sec + floor(ps / 1e12))::BIGINT AS time_sec, (ps - floor(ps / 1e12)::BIGINT * 1000000000000)::BIGINT AS time_ps FROM a"""


# ---------------------------------------------------------------- recordings, logs, manifests as text

def clips(spark, sf):
    """Each frame of 64 values as a two-channel 16-bit WAV file of 32 samples."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.rint(v * 32767).cast("int"))
    byte2 = lambda v: F.concat(F.lpad(F.hex(F.pmod(v, F.lit(256)).cast("bigint")), 2, "0"),
                               F.lpad(F.hex(F.pmod(F.floor(v / 256), F.lit(256)).cast("bigint")), 2, "0"))
    # RIFF, fmt (PCM, 2 channels, 48000 Hz, 16 bits) and data chunk of 128 bytes
    head = "52494646A400000057415645666D74201000000001000200" + "80BB0000" + "00EE0200" + "04001000" + "6461746180000000"
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("path"),
        F.unhex(F.concat(F.lit(head), F.array_join(F.transform(x, byte2), ""))).alias("content"))


def recordings_read(spark, sf):
    b = recordings.decode_recordings(clips(spark, sf), block=16)
    rows = b.select("stream_id", "first_sample", "rate", F.posexplode(F.arrays_zip("i", "q")).alias("k", "s"))
    return rows.select(F.col("stream_id").cast("bigint").alias("frame"), "rate", (F.col("first_sample") + F.col("k")).alias("n"),
                       r(F.col("s.i").cast("double"), 8).alias("i"), r(F.col("s.q").cast("double"), 8).alias("q"))


def folder_read(spark, sf):
    """The same clips written as files of a shared folder and scanned by path."""
    folder = fresh_dir(spark, "clips")

    def write(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        system.create_dir(root, recursive=True)
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"]):
                with system.open_output_stream(f"{root}/{name}.WAV") as out:
                    out.write(bytes(raw))
            yield pdf[["path"]]

    clips(spark, sf).mapInPandas(write, "path string").count()
    b = recordings.read_recordings(spark, folder, block=16)
    rows = b.select("stream_id", "first_sample", "rate", F.posexplode(F.arrays_zip("i", "q")).alias("k", "s"))
    return rows.select(F.regexp_extract("stream_id", r"(\d+)\.WAV$", 1).cast("bigint").alias("frame"), "rate",
                       (F.col("first_sample") + F.col("k")).alias("n"),
                       r(F.col("s.i").cast("double"), 8).alias("i"), r(F.col("s.q").cast("double"), 8).alias("q"))


RECORDINGS_SQL = """SELECT vec_id AS frame, 48000::INT AS rate, unnest(range(0, 32)) AS n,
  unnest(list_transform(range(0, 32), lambda j: round(round_even(embedding[2*j+1]::DOUBLE * 32767, 0) / 32768, 8) + 0.0)) AS i,
  unnest(list_transform(range(0, 32), lambda j: round(round_even(embedding[2*j+2]::DOUBLE * 32767, 0) / 32768, 8) + 0.0)) AS q
FROM embeddings"""


def log_lines(spark, sf):
    ev = table(spark, sf, "events")
    n, us = F.col("event_id"), epoch_us()
    stamp = F.when(n % 13 == 0, "soon").otherwise(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd_HH:mm:ss.S"))
    obj = F.to_json(F.struct(stamp.alias("timestamp"), F.round(F.col("value"), 3).alias("t_sec"), (n % 97).alias("radio_khz"),
                             F.concat(F.lit("k"), k_of()).alias("message"),
                             F.when(n % 3 > 0, (n % 40).cast("int")).alias("jt9_snr_db")))
    return ev.select("event_id", F.when(n % 17 == 0, "  ").when(n % 19 == 0, "{broken").otherwise(obj).alias("value"))


def decode_log(spark, sf):
    p = logs.parse_log(log_lines(spark, sf), since="2024-01-10T12:00:00")
    return p.select("event_id", "t_sec", "radio_khz", "message", "jt9_snr_db",
                    F.unix_millis("logged_at").alias("logged_ms"))


DECODE_LOG_SQL = f"""SELECT event_id, round(value, 3) AS t_sec, event_id % 97 AS radio_khz, 'k' || {K} AS message,
  CASE WHEN event_id % 3 > 0 THEN (event_id % 40)::INT END AS jt9_snr_db,
  CASE WHEN event_id % 13 > 0 THEN epoch_us(ts) // 100000 * 100 END AS logged_ms FROM events
WHERE event_id % 17 > 0 AND event_id % 19 > 0 AND (event_id % 13 = 0 OR epoch_us(ts) // 100000 * 100000 >= epoch_us(TIMESTAMP '2024-01-10 12:00:00'))"""


def launch_lines(spark, sf):
    n = F.col("event_id")
    outcome = F.element_at(F.array(*map(F.lit, ("decoded", "no_decode", "timeout", "error"))), (n % 4 + 1).cast("int"))
    obj = F.to_json(F.struct(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd_HH:mm:ss.S").alias("timestamp"),
                             outcome.alias("outcome")))
    return table(spark, sf, "events").select(F.col("user_id").alias("run_id"), obj.alias("value"))


def launches(spark, sf):
    from burstlake.schemas import LAUNCH_LOG

    p = logs.parse_log(launch_lines(spark, sf), LAUNCH_LOG, since="2024-01-05")
    return matching.outcome_counts(p)


LAUNCH_SQL = """SELECT user_id AS run_id, count(*) AS launched, count(*) FILTER (WHERE event_id % 4 = 0) AS decoded,
  count(*) FILTER (WHERE event_id % 4 = 1) AS no_decode, count(*) FILTER (WHERE event_id % 4 = 2) AS timeout,
  count(*) FILTER (WHERE event_id % 4 = 3) AS error FROM events WHERE ts >= TIMESTAMP '2024-01-05' GROUP BY 1"""


def manifests(spark, sf):
    """One document per order; its lines are the placements; every eleventh order has none."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_extendedprice").alias("center_hz"),
                                             F.col("l_quantity").alias("delay_s")))).alias("_l"))
    o = table(spark, sf, "orders").join(li, "o_orderkey", "left")
    key = F.col("o_orderkey")
    place = F.transform("_l", lambda s: F.struct(F.concat(F.lit("m"), s["l_linenumber"]).alias("msg"),
                                                 s["center_hz"].alias("center_hz"), s["delay_s"].alias("delay_s")))
    doc = F.struct(F.col("o_orderpriority").alias("output_wav"), F.col("o_totalprice").alias("duration_s"),
                   F.when(key % 11 > 0, place).alias("placements"))
    return o.select(key.alias("manifest"), F.to_json(doc).alias("value"))


def manifest_rows(spark, sf):
    m = logs.parse_manifest(manifests(spark, sf))
    return m.groupBy("manifest", "output_wav").agg(
        F.count("placement_no").alias("placements"), r(F.sum("center_hz"), 2).alias("sum_hz"),
        r(F.max("delay_s")).alias("last_s"), r(F.max("duration_s")).alias("duration_s"))


MANIFEST_SQL = """SELECT o_orderkey AS manifest, o_orderpriority AS output_wav,
  CASE WHEN o_orderkey % 11 > 0 THEN count(l_orderkey) ELSE 0 END AS placements,
  round(CASE WHEN o_orderkey % 11 > 0 THEN sum(l_extendedprice) END, 2) + 0.0 AS sum_hz,
  round(CASE WHEN o_orderkey % 11 > 0 THEN max(l_quantity) END, 6) + 0.0 AS last_s, round(max(o_totalprice), 6) + 0.0 AS duration_s
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority"""


def generations(spark, sf):
    work = table(spark, sf, "events").select(F.col("user_id").alias("stream_id"), "event_id",
                                             F.floor(F.dayofmonth(F.col("ts").cast("timestamp_ntz")) / 10).cast("int").alias("generation"))
    return framing.newest_generation(work, work).select("stream_id", "event_id", "generation")


# ---------------------------------------------------------------- runs and order

def heat_runs(spark, sf):
    h = heat(spark, sf).select("channel", "frame", F.col("lin").alias("metric"))
    return runs.threshold_runs(h, 45.0, keys=("channel",))


RUNS = HEAT + """,
  hot AS (SELECT channel, frame, lin, frame - row_number() OVER (PARTITION BY channel ORDER BY frame) AS g FROM heat WHERE lin >= 45),
  runs AS (SELECT channel, min(frame) AS start, max(frame) AS "end", max(lin) AS peak FROM hot GROUP BY channel, g),
  lagged AS (SELECT *, start - lag("end") OVER (PARTITION BY channel ORDER BY start) AS d FROM runs),
  isl AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY start) AS island FROM lagged),
  merged AS (SELECT channel, min(start) AS start, max("end") AS "end", max(peak) AS peak FROM isl GROUP BY channel, island)"""


def run_out(df, *extra):
    return df.select("channel", "start", "end", r(F.col("peak")).alias("peak"), *extra)


def merged(spark, sf):
    return runs.merge_runs(heat_runs(spark, sf), 4, keys=("channel",))


def ranked(spark, sf):
    return run_out(runs.rank_runs(merged(spark, sf), keys=("channel",)), "rank")


def strongest(spark, sf):
    return run_out(top_k(merged(spark, sf), 20, [F.desc("peak"), F.asc("channel"), F.asc("start")]))


def strongest_each(spark, sf):
    return run_out(top_k(merged(spark, sf), 3, [F.desc("peak"), F.asc("start")], ["channel"]),
                   F.col("rank").cast("bigint").alias("rank"))


RUN_COLS = 'channel, start, "end", round(peak, 6) + 0.0 AS peak'

# ---------------------------------------------------------------- matches


def exact(spark, sf):
    return matching.match_exact(truth(spark, sf), log(spark, sf)).select("truth_no", "exact_line")


def nearest(spark, sf):
    t, l = truth(spark, sf), log(spark, sf)
    return matching.match_nearest(t, l, FREQ_TOL, TIME_TOL).select("truth_no", "near_line")


def compared(spark, sf, claim_all=True):
    return comparison.compare(truth(spark, sf), log(spark, sf), FREQ_TOL, TIME_TOL, claim_all)


def statuses(spark, sf):
    return compared(spark, sf)[0].select("truth_no", "status", "line_no")


def statuses_first(spark, sf):
    return compared(spark, sf, False)[0].select("truth_no", "status", "line_no")


def alarms(spark, sf):
    return compared(spark, sf)[1].select("line_no", "message")


def report(spark, sf):
    out = comparison.report(truth(spark, sf), log(spark, sf), freq_tol=FREQ_TOL, time_tol=TIME_TOL)
    return out.select("run_id", "total", "decoded", "missed", "garbled", "false_alarms", r(F.col("percent")).alias("percent"))


def report_launches(spark, sf):
    """The same with how each run's launches ended."""
    from burstlake.schemas import LAUNCH_LOG

    started = logs.parse_log(launch_lines(spark, sf), LAUNCH_LOG, since="2024-01-05")
    out = comparison.report(truth(spark, sf), log(spark, sf), started, freq_tol=FREQ_TOL, time_tol=TIME_TOL)
    return out.select("run_id", "total", "decoded", "missed", "garbled", "false_alarms", r(F.col("percent")).alias("percent"),
                      "launched", "launch_decoded", "no_decode", "timeout", "launch_error")


EXACT = TRUTH + """,
  words AS (SELECT DISTINCT run_id, line_no, unnest(list_append(string_split(message, ' '), message)) AS w FROM log),
  hits AS (SELECT t.run_id, t.truth_no, w.line_no FROM truth t JOIN words w ON w.run_id = t.run_id AND w.w = t.msg),
  exact AS (SELECT t.run_id, t.truth_no, min(h.line_no) AS exact_line FROM truth t LEFT JOIN hits h ON h.truth_no = t.truth_no GROUP BY 1, 2)"""
NEAR = EXACT + f""",
  band AS (SELECT t.truth_no, l.line_no, row_number() OVER (PARTITION BY t.truth_no ORDER BY
      pow((l.freq - t.freq) / {FREQ_TOL}, 2) + pow((l.t_sec - t.t_sec) / {TIME_TOL}, 2), l.line_no) AS rn
    FROM truth t JOIN log l ON l.run_id = t.run_id AND abs(l.freq - t.freq) <= {FREQ_TOL} AND abs(l.t_sec - t.t_sec) <= {TIME_TOL}),
  near AS (SELECT t.truth_no, b.line_no AS near_line FROM truth t LEFT JOIN band b ON b.truth_no = t.truth_no AND rn = 1)"""


def claims_sql(claim_all: bool) -> str:
    mine = ("SELECT run_id, line_no, truth_no FROM hits" if claim_all else
            "SELECT run_id, exact_line AS line_no, truth_no FROM exact WHERE exact_line IS NOT NULL")
    return NEAR + f""",
  claims AS (SELECT run_id, line_no, min(truth_no) AS by_no FROM ({mine}
    UNION ALL SELECT e.run_id, n.near_line, e.truth_no FROM exact e JOIN near n ON n.truth_no = e.truth_no
      WHERE e.exact_line IS NULL AND n.near_line IS NOT NULL) GROUP BY 1, 2),
  st AS (SELECT e.run_id, e.truth_no, CASE WHEN exact_line IS NOT NULL THEN 'DECODED' WHEN c.by_no = e.truth_no THEN 'GARBLED'
      ELSE 'MISSED' END AS status, exact_line, near_line FROM exact e JOIN near n ON n.truth_no = e.truth_no
    LEFT JOIN claims c ON c.run_id = e.run_id AND c.line_no = n.near_line),
  alarms AS (SELECT l.* FROM log l LEFT JOIN claims c ON c.run_id = l.run_id AND c.line_no = l.line_no WHERE c.line_no IS NULL)"""


STATUS_COLS = """
SELECT truth_no, status, CASE status WHEN 'DECODED' THEN exact_line WHEN 'GARBLED' THEN near_line END AS line_no FROM st"""


def interval_truth(spark, sf):
    ev = table(spark, sf, "events")
    first = ev.agg(F.floor(F.min(epoch_us()) / 3_600_000_000)).scalar()
    start = F.floor((epoch_us() - first * 3_600_000_000) / 60_000_000) / 60.0
    return ev.select(
        F.when(F.col("event_type") == "error", "elsewhere").otherwise("grid").alias("stream_id"), F.col("event_id").alias("truth_no"),
        F.pmod("user_id", F.lit(48)).cast("int").alias("channel"), start.alias("start"),
        (F.floor(F.col("value") / 8) * 0.5).alias("width"))


def intervals(spark, sf):
    h = heat(spark, sf).select("stream_id", "channel", "frame", F.col("lin").alias("metric_db"))
    return matching.match_interval(interval_truth(spark, sf), h, 0.0, 1.0).select("truth_no", "frame", "inside")


def sparse_intervals(spark, sf):
    """Few frames, a channel and a stream without any, intervals up to days; small blocks and segments."""
    h = heat(spark, sf).where("lin > 60 AND channel <> 7").select("stream_id", "channel", "frame", F.col("lin").alias("metric_db"))
    asked = interval_truth(spark, sf).withColumn("width", F.col("width") * 12)
    return matching.match_interval(asked, h, 0.0, 1.0, fan=4, levels=3, segment=16).select("truth_no", "frame", "inside")


def interval_sql(frames: str, width: str) -> str:
    return "WITH " + HEAT + f""",
  h AS (SELECT * FROM heat WHERE {frames}),
  t AS (SELECT event_id AS truth_no, (user_id % 48)::INT AS channel, event_type <> 'error' AS here,
    floor((epoch_us(ts) - lo * 3600000000) / 60000000) / 60.0 AS start, floor(value / 8) * {width}::DOUBLE AS width FROM events, span),
  met AS (SELECT truth_no, frame, lin, frame >= start AND frame <= start + width AS inside, abs(frame - (start + width / 2)) AS away
    FROM t JOIN h ON h.channel = t.channel AND here),
  pick AS (SELECT truth_no, frame, inside, row_number() OVER (PARTITION BY truth_no
    ORDER BY inside DESC, CASE WHEN inside THEN -lin ELSE away END, frame) AS rn FROM met)
SELECT t.truth_no, p.frame, coalesce(p.inside, false) AS inside FROM t LEFT JOIN pick p ON p.truth_no = t.truth_no AND rn = 1"""


def attached(spark, sf):
    d = truth(spark, sf).select(F.col("truth_no").alias("marker_id"), "msg")
    dec = log(spark, sf).select((F.col("line_no") - F.col("line_no") % 4).alias("marker_id"), "line_no", "message")
    return matching.attach_decodes(d, dec).select("marker_id", "message", "decoded")


ATTACH_SQL = "WITH " + TRUTH + """, d AS (SELECT line_no - line_no % 4 AS marker_id, arg_max(message, line_no) AS message FROM log GROUP BY 1)
SELECT truth_no AS marker_id, message, message IS NOT NULL AS decoded FROM truth LEFT JOIN d ON d.marker_id = truth_no"""


def coded_truth(spark, sf):
    t = truth(spark, sf)
    p = [(F.col("truth_no") % 49 - 24).cast("int"), (5 + F.col("truth_no") % 146).cast("int"),
         (F.col("truth_no") % 21 - 10).cast("int"), (F.col("truth_no") % 1000).cast("int")]
    return t.select("run_id", "truth_no", msg.encode_params(*p).alias("msg"), "freq", "t_sec")


def coded_log(spark, sf):
    c = coded_truth(spark, sf).where("truth_no % 3 > 0")
    return c.select("run_id", F.col("truth_no").alias("line_no"),
                    F.concat(F.lit("2200 -3 ~ "), F.when(F.col("truth_no") % 5 == 0, "junk").otherwise(F.col("msg"))).alias("message"),
                    "freq", "t_sec", (F.col("truth_no") % 25 - 12).cast("int").alias("snr_db"))


def recovery(spark, sf):
    out = jobs.recovery_error(coded_log(spark, sf), coded_truth(spark, sf))
    return out.select("run_id", "matched", *[r(F.col(f"{a}_{c}") + 1e-7, 4).alias(f"{a}_{c}") for a in ("mean", "median")
                                             for c in ("freq", "time", "snr")])


RECOVERY_SQL = "WITH " + TRUTH + """,
  c AS (SELECT run_id, truth_no, freq, t_sec, truth_no % 49 - 24 AS f, 5 + truth_no % 146 AS t, truth_no % 21 - 10 AS s, truth_no % 1000 AS w,
    truth_no % 25 - 12 AS snr FROM truth),
  l AS (SELECT *, row_number() OVER (PARTITION BY run_id, f, t, s, w ORDER BY truth_no) AS rn FROM c WHERE truth_no % 3 > 0 AND truth_no % 5 > 0),
  e AS (SELECT c.run_id, abs(l.freq - c.f) AS freq, abs(l.t_sec - c.t / 10.0::DOUBLE) AS time, abs(l.snr - c.s)::DOUBLE AS snr
    FROM c JOIN l ON l.run_id = c.run_id AND l.f = c.f AND l.t = c.t AND l.s = c.s AND l.w = c.w AND l.rn = 1)
SELECT run_id, count(*) AS matched, round(avg(freq) + 1e-7::DOUBLE, 4) + 0.0 AS mean_freq, round(avg(time) + 1e-7::DOUBLE, 4) + 0.0 AS mean_time, round(avg(snr) + 1e-7::DOUBLE, 4) + 0.0 AS mean_snr,
  round(median(freq) + 1e-7::DOUBLE, 4) + 0.0 AS median_freq, round(median(time) + 1e-7::DOUBLE, 4) + 0.0 AS median_time, round(median(snr) + 1e-7::DOUBLE, 4) + 0.0 AS median_snr FROM e GROUP BY 1"""


def truth_order(spark, sf):
    from burstlake.scale import number_rows

    return number_rows(truth(spark, sf), ["run_id"], ["t_sec", "truth_no"], "position").select("run_id", "truth_no", "position")


def recent(spark, sf):
    return top_k(log(spark, sf), 50, [F.desc("line_no")]).select("line_no", "message")


def snr_fallback(spark, sf):
    return log(spark, sf).select("line_no", msg.coalesce_snr(
        F.when(F.col("line_no") % 3 > 0, F.col("line_no") % 40), F.floor("freq")).cast("bigint").alias("snr_db"))


QUERIES = {
    "parse_message": parse(False),
    "parse_message_rr73_grid": parse(True),
    "encode_decode_parameters": codec,
    "parse_decoder_output": decoder_text,
    "decode_log_rows": log_rows,
    "spots_with_grid": spots(True),
    "spots_immediate": spots(False),
    "spot_rollup": rollup,
    "dial_frequency": dial,
    "milliseconds_of_day": day_times,
    "unit_guess": units,
    "parse_key_values_last": kv("last"),
    "parse_key_values_first": kv("first"),
    "client_status": clients,
    "tuning_changes": changes,
    "tuning_changes_spaced": changes_spaced,
    "sequence_gaps": gaps,
    "packet_health": packet_health,
    "blanked_share": blanked_share,
    "read_packets": packet_fields,
    "packet_time": packet_times,
    "read_recordings": recordings_read,
    "read_recordings_folder": folder_read,
    "read_decode_log": decode_log,
    "launch_outcomes": launches,
    "read_manifest": manifest_rows,
    "newest_generation": generations,
    "threshold_runs": lambda spark, sf: run_out(heat_runs(spark, sf)),
    "merged_runs": lambda spark, sf: run_out(merged(spark, sf)),
    "ranked_runs": ranked,
    "strongest_runs": strongest,
    "strongest_runs_per_channel": strongest_each,
    "match_exact": exact,
    "match_nearest": nearest,
    "claim_all_rows": statuses,
    "claim_first_row": statuses_first,
    "false_alarms": alarms,
    "comparison_report": report,
    "comparison_report_launches": report_launches,
    "match_interval": intervals,
    "match_interval_sparse": sparse_intervals,
    "attach_decodes": attached,
    "recovery_error": recovery,
    "truth_order": truth_order,
    "recent_decodes": recent,
    "snr_fallback": snr_fallback,
}


REPORT_SQL = "WITH " + claims_sql(True) + """,
  a AS (SELECT run_id, count(*) AS false_alarms FROM alarms GROUP BY 1),
  s AS (SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status = 'DECODED') AS decoded,
    count(*) FILTER (WHERE status = 'MISSED') AS missed, count(*) FILTER (WHERE status = 'GARBLED') AS garbled FROM st GROUP BY 1)
SELECT run_id, coalesce(total, 0) AS total, coalesce(decoded, 0) AS decoded, coalesce(missed, 0) AS missed, coalesce(garbled, 0) AS garbled,
  coalesce(false_alarms, 0) AS false_alarms, round(CASE WHEN total > 0 THEN 100.0::DOUBLE * decoded / total ELSE 0 END, 6) + 0.0 AS percent
FROM s FULL JOIN a USING (run_id)"""

SQL = {
    "parse_message": "WITH " + MESSAGES + ", " + parsed_sql(False) + " SELECT id, de, to_call, grid FROM parsed",
    "parse_message_rr73_grid": "WITH " + MESSAGES + ", " + parsed_sql(True) + " SELECT id, de, to_call, grid FROM parsed",
    "encode_decode_parameters": CODEC_SQL,
    "parse_decoder_output": "WITH " + OUTPUTS + " SELECT id, line, dsnr AS snr_db, msg AS message FROM po",
    "decode_log_rows": LOG_ROWS_SQL,
    "spots_with_grid": spots_sql(True),
    "spots_immediate": spots_sql(False),
    "spot_rollup": ROLLUP_SQL,
    "dial_frequency": "WITH " + SERIES + """, k AS (SELECT *, 50.26::DOUBLE * 1000 + (x * 10 - 1000 - 1500) / 1000 AS khz FROM series)
SELECT stream_id, n, round(khz, 6) + 0.0 AS khz, round_even(khz, 0)::BIGINT AS whole_khz, round_even(n / 2, 0)::BIGINT AS half_even FROM k""",
    "milliseconds_of_day": "WITH " + SERIES + """ SELECT stream_id, n, CASE WHEN n % 11 < 2 THEN 0
  ELSE ((n % 24) * 3600 + (n % 60) * 60 + floor(x)::BIGINT % 60) * 1000 END AS ms FROM series""",
    "unit_guess": UNITS_SQL,
    "parse_key_values_last": kv_sql("last"),
    "parse_key_values_first": kv_sql("first"),
    "client_status": CLIENTS_SQL,
    "tuning_changes": "WITH " + TUNING + """, l AS (SELECT *, lag(centre_mhz) OVER w AS pc, lag(bandwidth_hz) OVER w AS pb FROM tune
  WINDOW w AS (PARTITION BY pan_id ORDER BY seq))
SELECT pan_id, seq, centre_mhz, bandwidth_hz FROM l WHERE pc IS NULL OR pc <> centre_mhz OR pb <> bandwidth_hz""",
    "tuning_changes_spaced": CHANGES_SPACED_SQL,
    "sequence_gaps": "WITH " + GAPS + " SELECT stream_id, arrival, missed FROM gaps",
    "packet_health": "WITH " + GAPS + """ SELECT stream_id, count(*) AS packets, sum(missed)::BIGINT AS missed,
  round(sum(missed) / count(*) * 100, 6) + 0.0 AS loss_percent FROM gaps GROUP BY 1""",
    "blanked_share": "WITH " + SERIES + """ SELECT stream_id, round(count(*) FILTER (WHERE x > 100) / count(*) * 100, 6) + 0.0 AS percent
FROM series GROUP BY 1""",
    "read_packets": PACKET_SQL,
    "packet_time": TIMES_SQL,
    "read_recordings": RECORDINGS_SQL,
    "read_recordings_folder": RECORDINGS_SQL,
    "read_decode_log": DECODE_LOG_SQL,
    "launch_outcomes": LAUNCH_SQL,
    "read_manifest": MANIFEST_SQL,
    "newest_generation": """SELECT stream_id, event_id, generation FROM (SELECT user_id AS stream_id, event_id, (day(ts) // 10)::INT AS generation,
  max(day(ts) // 10) OVER (PARTITION BY user_id) AS newest FROM events) WHERE generation = newest""",
    "threshold_runs": "WITH " + RUNS + f" SELECT {RUN_COLS} FROM runs",
    "merged_runs": "WITH " + RUNS + f" SELECT {RUN_COLS} FROM merged",
    "ranked_runs": "WITH " + RUNS + f" SELECT {RUN_COLS}, row_number() OVER (PARTITION BY channel ORDER BY m.peak DESC, start) AS rank FROM merged m",
    "strongest_runs": "WITH " + RUNS + f" SELECT {RUN_COLS} FROM merged m ORDER BY m.peak DESC, channel, start LIMIT 20",
    "strongest_runs_per_channel": "WITH " + RUNS + f""" SELECT * FROM (SELECT {RUN_COLS},
  row_number() OVER (PARTITION BY channel ORDER BY m.peak DESC, start) AS rank FROM merged m) WHERE rank <= 3""",
    "match_exact": "WITH " + EXACT + " SELECT truth_no, exact_line FROM exact",
    "match_nearest": "WITH " + NEAR + " SELECT truth_no, near_line FROM near",
    "claim_all_rows": "WITH " + claims_sql(True) + STATUS_COLS,
    "claim_first_row": "WITH " + claims_sql(False) + STATUS_COLS,
    "false_alarms": "WITH " + claims_sql(True) + " SELECT line_no, message FROM alarms",
    "comparison_report": REPORT_SQL,
    "comparison_report_launches": f"""SELECT m.*, coalesce(l.launched, 0) AS launched, coalesce(l.decoded, 0) AS launch_decoded,
  coalesce(l.no_decode, 0) AS no_decode, coalesce(l.timeout, 0) AS timeout, coalesce(l.error, 0) AS launch_error
FROM ({REPORT_SQL}) m LEFT JOIN ({LAUNCH_SQL}) l USING (run_id)""",
    "match_interval": interval_sql("true", "0.5"),
    "match_interval_sparse": interval_sql("lin > 60 AND channel <> 7", "6"),
    "attach_decodes": ATTACH_SQL,
    "recovery_error": RECOVERY_SQL,
    "truth_order": "WITH " + TRUTH + " SELECT run_id, truth_no, row_number() OVER (PARTITION BY run_id ORDER BY t_sec, truth_no) - 1 AS position FROM truth",
    "recent_decodes": "WITH " + TRUTH + " SELECT line_no, message FROM log ORDER BY line_no DESC LIMIT 50",
    "snr_fallback": "WITH " + TRUTH + """ SELECT line_no, coalesce(CASE WHEN line_no % 3 > 0 THEN line_no % 40 END, floor(freq)::BIGINT)::BIGINT AS snr_db FROM log""",
}
