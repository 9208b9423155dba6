"""How the given tables stand in for streams, frames, metrics, logs and packets.

Each binding has a Spark form and the same thing as SQL (a CTE body).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from burstlake.scale import number_rows


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def epoch_us(col: str = "ts"):
    """Microseconds since 1970 of a zone-less or UTC timestamp, whatever the session zone."""
    c = F.col(col).cast("timestamp_ntz")
    return (F.unix_date(c.cast("date")).cast("long") * F.lit(86_400_000_000)
            + F.hour(c).cast("long") * F.lit(3_600_000_000) + F.minute(c).cast("long") * F.lit(60_000_000)
            + (F.extract(F.lit("SECOND"), c) * F.lit(1_000_000)).cast("long"))


# -- series: five streams of samples ---------------------------------------

def series(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select(
        F.col("event_type").alias("stream_id"), "ts", "event_id", F.col("value").alias("x"))
    return number_rows(ev, ["stream_id"], ["ts", "event_id"]).select("stream_id", "n", "x")


SERIES = """series AS (SELECT event_type AS stream_id,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n,
  value AS x FROM events)"""


# -- frames: real spectra or frames of 64 values ----------------------------

def frames(spark: SparkSession, sf: str) -> DataFrame:
    """One row per frame with an array of 64 doubles."""
    return table(spark, sf, "embeddings").select(
        F.lit("all").alias("recording"), F.col("vec_id").alias("frame"),
        F.col("embedding").cast("array<double>").alias("x"))


def frame_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Long form of ``frames``: one row per (frame, bin)."""
    return frames(spark, sf).select("recording", "frame", F.posexplode("x").alias("bin", "power_db"))


FRAMES = """frames AS (SELECT vec_id AS frame,
  list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"""
FRAME_BINS = FRAMES + """, frame_bins AS (SELECT frame, unnest(range(0, 64))::INT AS bin,
  unnest(x) AS power_db FROM frames)"""


# -- iq32: 32 complex samples per frame -------------------------------------

def iq32(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    half = F.sequence(F.lit(0), F.lit(31))
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("frame"),
        F.transform(half, lambda i: F.get(x, i * 2)).alias("re"),
        F.transform(half, lambda i: F.get(x, i * 2 + 1)).alias("im"))


IQ32 = """iq32 AS (SELECT vec_id AS frame, unnest(range(0, 32))::INT AS n,
  unnest(list_transform(range(0, 32), lambda i: embedding[2*i+1]::DOUBLE)) AS re,
  unnest(list_transform(range(0, 32), lambda i: embedding[2*i+2]::DOUBLE)) AS im
  FROM embeddings)"""


# -- heat: hour x 48 channels, filled ---------------------------------------

def heat(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    hour = F.floor(epoch_us() / F.lit(3_600_000_000)).cast("long")
    cells = ev.groupBy(hour.alias("hour"), (F.col("user_id") % 48).cast("int").alias("channel")).agg(
        F.sum("value").alias("lin"))
    lo, hi = ev.agg(F.min(hour), F.max(hour)).first()
    grid = spark.range(0, (hi - lo + 1) * 48).select(
        F.floor(F.col("id") / 48).cast("long").alias("frame"),
        (F.col("id") % 48).cast("int").alias("channel"))
    cells = cells.select((F.col("hour") - F.lit(lo)).alias("frame"), "channel", "lin")
    return grid.join(cells, ["frame", "channel"], "left").select(
        F.lit("grid").alias("stream_id"), "frame", "channel",
        F.coalesce("lin", F.lit(0.0)).alias("lin"))


HEAT = """cells AS (SELECT floor(epoch_us(ts) / 3600000000)::BIGINT AS hour,
    (user_id % 48)::INT AS channel, sum(value) AS lin FROM events GROUP BY 1, 2),
  span AS (SELECT min(hour) AS lo, max(hour) AS hi FROM cells),
  heat AS (SELECT g.frame, g.channel, coalesce(c.lin, 0.0) AS lin
    FROM (SELECT f.frame, k.channel FROM (SELECT unnest(range(0, hi - lo + 1)) AS frame FROM span) f,
          (SELECT unnest(range(0, 48))::INT AS channel) k) g
    LEFT JOIN (SELECT hour - lo AS frame, channel, lin FROM cells, span) c
      ON c.frame = g.frame AND c.channel = g.channel)"""


# -- messages built from customers -------------------------------------------

def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Decoded texts of six shapes, with dial frequency and SNR."""
    k, nk = F.col("c_custkey"), F.col("c_nationkey")
    ch = lambda c: F.chr(65 + c)
    call = F.concat(ch(k % 26), (k % 10).cast("string"), ch(F.floor(k / 26) % 26), ch(F.floor(k / 676) % 26))
    grid = F.concat(ch(nk % 18), ch((nk * 7) % 18), F.lpad((k % 100).cast("string"), 2, "0"))
    report = F.concat(F.when(k % 2 == 0, "-").otherwise("+"), F.lpad((k % 31).cast("string"), 2, "0"))
    shape = k % 6
    prefix = F.when(shape == 0, "CQ ").when(shape == 1, "cq dx ").when(shape == 2, " W1AW ").when(
        shape == 4, F.concat(F.lit("text "), F.col("c_mktsegment"))).otherwise("W1AW ")
    sender = F.when(shape != 4, F.when(shape == 1, F.lower("call")).otherwise(F.col("call"))).otherwise("")
    suffix = (F.when(shape < 3, F.concat(F.when(shape == 1, "  ").otherwise(" "), F.col("grid"),
                                         F.when(shape == 2, " ").otherwise("")))
               .when(shape == 3, F.concat(F.lit(" "), report)).when(shape == 5, " RR73").otherwise(""))
    text = F.concat(prefix, sender, suffix)
    return table(spark, sf, "customer").select("*", call.alias("call"), grid.alias("grid")).select(
        k.alias("id"), text.alias("message"), (F.lit(50_260.0) + F.col("c_acctbal") / 1000).alias("radio_khz"),
        F.when(k % 7 != 0, (k % 301 - 150).cast("int")).alias("snr_db"))


MESSAGES = """messages AS (SELECT c_custkey AS id, CASE c_custkey % 6
    WHEN 0 THEN 'CQ ' || call || ' ' || grid
    WHEN 1 THEN 'cq dx ' || lower(call) || '  ' || grid
    WHEN 2 THEN ' W1AW ' || call || ' ' || grid || ' '
    WHEN 3 THEN 'W1AW ' || call || ' ' || (CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE '+' END) || lpad((c_custkey % 31)::VARCHAR, 2, '0')
    WHEN 4 THEN 'text ' || c_mktsegment
    ELSE 'W1AW ' || call || ' RR73' END AS message,
  50260.0::DOUBLE + c_acctbal / 1000 AS radio_khz,
  CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 301 - 150)::INT END AS snr_db
  FROM (SELECT *, chr((65 + c_custkey % 26)::INT) || (c_custkey % 10)::VARCHAR || chr((65 + (c_custkey // 26) % 26)::INT)
      || chr((65 + (c_custkey // 676) % 26)::INT) AS call,
    chr((65 + c_nationkey % 18)::INT) || chr((65 + (c_nationkey * 7) % 18)::INT) || lpad((c_custkey % 100)::VARCHAR, 2, '0') AS grid
    FROM customer))"""


# -- truth and log ------------------------------------------------------------

def k_of(col: str = "props"):
    return F.get_json_object(col, "$.k").cast("int")


def truth(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").where("event_type IN ('signup', 'view')")
    return ev.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("truth_no"),
                     F.concat(F.lit("k"), k_of()).alias("msg"), F.col("value").alias("freq"),
                     (F.pmod(epoch_us(), F.lit(86_400_000_000)) / 1e6).alias("t_sec"))


def log(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").where("event_type NOT IN ('signup', 'view')")
    return ev.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("line_no"),
                     F.concat(F.lit("k"), k_of(), F.lit(" "), F.col("event_type")).alias("message"),
                     F.col("value").alias("freq"),
                     (F.pmod(epoch_us(), F.lit(86_400_000_000)) / 1e6).alias("t_sec"))


K = "regexp_extract(props, '([0-9]+)', 1)"
TRUTH = f"""truth AS (SELECT user_id AS run_id, event_id AS truth_no, 'k' || {K} AS msg, value AS freq,
    (epoch_us(ts) % 86400000000) / 1e6 AS t_sec FROM events WHERE event_type IN ('signup', 'view')),
  log AS (SELECT user_id AS run_id, event_id AS line_no, 'k' || {K} || ' ' || event_type AS message, value AS freq,
    (epoch_us(ts) % 86400000000) / 1e6 AS t_sec FROM events WHERE event_type NOT IN ('signup', 'view'))"""


# -- packets --------------------------------------------------------------------

def packets(spark: SparkSession, sf: str) -> DataFrame:
    us = epoch_us()
    return table(spark, sf, "events").select(
        F.col("user_id").alias("stream_id"), F.col("event_id").alias("arrival"),
        (k_of() % 16).alias("seq"), F.floor(us / 1_000_000).cast("bigint").alias("ts_sec"),
        F.pmod(us, F.lit(1_000_000)).alias("us"), "value")


PACKETS = f"""packets AS (SELECT user_id AS stream_id, event_id AS arrival, ({K}::INT % 16)::INT AS seq,
  epoch_us(ts) // 1000000 AS ts_sec, epoch_us(ts) % 1000000 AS us, value FROM events)"""


# -- status lines -----------------------------------------------------------------

def status_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Two lines per supplier and id; the later one repeats the key ``station``."""
    k = F.col("s_suppkey")
    sup = table(spark, sf, "supplier").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    line = F.concat(F.lit("S3C0|client 0x"), F.lower(F.hex(k)), F.lit(" connected gui="), (k % 3 > 0).cast("int"),
                    F.lit(" client_id=c"), F.floor(k / 2), F.lit(" station="), F.translate("s_name", "#", "_"),
                    F.when(F.col("again") == 1, F.concat(F.lit(" station=S="), k % 7)).otherwise(""),
                    F.lit(" program="), F.when(k % 6 == 0, "SmartSDR-Win").otherwise("other"))
    return sup.select((k * 2 + F.col("again")).alias("seq"), line.alias("line"))


STATUS = """status AS (SELECT s_suppkey * 2 + again AS seq, 'S3C0|client 0x' || lower(to_hex(s_suppkey)) || ' connected gui='
    || (CASE WHEN s_suppkey % 3 > 0 THEN '1' ELSE '0' END) || ' client_id=c' || (s_suppkey // 2) || ' station=' || replace(s_name, '#', '_')
    || (CASE WHEN again = 1 THEN ' station=S=' || (s_suppkey % 7) ELSE '' END)
    || ' program=' || (CASE WHEN s_suppkey % 6 = 0 THEN 'SmartSDR-Win' ELSE 'other' END) AS line
  FROM supplier, (SELECT unnest([0, 1]) AS again))"""
