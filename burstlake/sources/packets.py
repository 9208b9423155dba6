"""Radio sample packets: header fields as column expressions, payload by Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

#: Seconds below this are a clock that was never set (2001-09-09).
UNSET_CLOCK = 1_000_000_000


def _uint(data: Column, at: Column, n: int, to: str = "bigint") -> Column:
    """Big-endian unsigned integer of n bytes at a 0-based offset."""
    return F.conv(F.hex(F.substring(data, at + 1, F.lit(n))), 16, 10).cast(to)


@arrow_udf(T.ArrayType(T.FloatType()))
def _floats(payload: pa.Array) -> pa.Array:
    """Little-endian float32 values of payloads of whole words, without touching single rows."""
    payload = pa.concat_arrays([payload.cast(pa.binary())])
    _, offsets, data = payload.buffers()
    at = np.frombuffer(offsets, "<i4", count=len(payload) + 1 + payload.offset)[payload.offset:]
    values = np.frombuffer(data, "<f4", offset=int(at[0]), count=int(at[-1] - at[0]) // 4) if data else []
    return pa.ListArray.from_arrays(pa.array((at - at[0]) // 4, type=pa.int32()),
                                    pa.array(values, type=pa.float32()), mask=payload.is_null())


def read_packets(df: DataFrame, col: str = "payload") -> DataFrame:
    """Add struct ``packet``; null when the packet is too short or has under two payload words.

    Fields: packet_type, stream_id, class_id, tsi, ts_sec, tsf, ts_frac, seq, i, q.
    """
    data = F.col(col)
    word = _uint(data, F.lit(0), 4)
    bits = lambda shift, mask: F.shiftright(word, shift).bitwiseAND(F.lit(mask)).cast("int")
    head = df.withColumns({
        "_type": bits(28, 0xF), "_class": bits(27, 1), "_trailer": bits(26, 1), "_tsi": bits(22, 3),
        "_tsf": bits(20, 3), "_seq": bits(16, 0xF), "_words": word.bitwiseAND(F.lit(0xFFFF)).cast("int"),
        "_len": F.octet_length(data)})
    c_at = F.lit(8)
    s_at = c_at + F.col("_class") * 8
    f_at = s_at + F.when(F.col("_tsi") != 0, 4).otherwise(0)
    p_at = f_at + F.when(F.col("_tsf") != 0, 8).otherwise(0)
    end = F.least(F.col("_words") * 4 - F.col("_trailer") * 4, F.col("_len"))
    words = F.floor((end - F.col("_p")) / 4).cast("int")
    placed = head.withColumn("_p", p_at)
    ok = (F.col("_len") >= 8) & (F.col("_len") >= F.col("_p")) & (words >= 2)
    body = placed.withColumn("_x", _floats(F.when(ok, F.substring(data, F.col("_p") + 1, words * 4))))
    pick = lambda odd: F.transform(F.sequence(F.lit(0), F.floor(F.size("_x") / 2).cast("int") - 1),
                                   lambda k: F.get("_x", k * 2 + odd))
    packet = F.struct(
        F.col("_type").alias("packet_type"), _uint(data, F.lit(4), 4).alias("stream_id"),
        F.when(F.col("_class") == 1, _uint(data, c_at, 8, "decimal(20,0)")).alias("class_id"),
        F.col("_tsi").alias("tsi"),
        F.when(F.col("_tsi") != 0, _uint(data, s_at, 4)).otherwise(F.lit(0)).alias("ts_sec"),
        F.col("_tsf").alias("tsf"),
        F.when(F.col("_tsf") != 0, _uint(data, f_at, 8, "decimal(20,0)").try_cast("bigint"))
         .otherwise(F.lit(0)).alias("ts_frac"),
        F.col("_seq").alias("seq"), pick(0).alias("i"), pick(1).alias("q"))
    out = body.withColumn("packet", F.when(F.col("_x").isNotNull(), packet))
    return out.select(*df.columns, "packet")


def normalise_time(df: DataFrame, rate: float = 48_000.0, buffered: Column | None = None) -> DataFrame:
    """Add ``time_sec``, ``time_ps`` and ``ts`` from ts_sec, ts_frac, tsf and arrival_us.

    Real-time fractions (tsf 2) are picoseconds, others count samples. A clock
    that was never set gives way to the arrival time. ``buffered`` samples still
    waiting in front of the packet move the start back.
    """
    ps = F.when(F.col("tsf") == 2, F.col("ts_frac")).otherwise(
        (F.col("ts_frac") * F.lit(1e12 / rate)).cast("bigint"))
    unset = F.col("ts_sec") < UNSET_CLOCK
    sec = F.when(unset, F.floor(F.col("arrival_us") / 1_000_000).cast("bigint")).otherwise(F.col("ts_sec"))
    ps = F.when(unset, F.pmod("arrival_us", F.lit(1_000_000)) * F.lit(1_000_000)).otherwise(ps)
    if buffered is not None:
        ps = ps - F.rint(buffered * F.lit(1e12 / rate)).cast("bigint")
    carry = F.floor(ps / F.lit(1_000_000_000_000)).cast("bigint")
    return (df.withColumn("time_sec", (sec + carry).cast("bigint"))
              .withColumn("time_ps", (ps - carry * F.lit(1_000_000_000_000)).cast("bigint"))
              .withColumn("ts", F.timestamp_micros(
                  F.col("time_sec") * 1_000_000 + F.floor(F.col("time_ps") / 1_000_000).cast("bigint"))))
