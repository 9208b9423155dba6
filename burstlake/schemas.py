"""Explicit schemas of the native formats (nothing is inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(),
          "double": T.DoubleType(), "boolean": T.BooleanType(), "floats": T.ArrayType(T.FloatType())}


def _schema(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in fields.items()])


BLOCKS = _schema(stream_id="string", block_idx="bigint", first_sample="bigint", rate="int",
                 i="floats", q="floats")

PLACEMENT = _schema(msg="string", center_hz="double", delay_s="double", freq_khz="int",
                    time_ds="int", snr_db="int", width_ms="int")
MANIFEST = T.StructType([
    *_schema(generated_at="string", output_wav="string", output_npy="string", output_rate="int",
             duration_s="double", atten_db="double", awgn_snr_db="double",
             noise_floor_dbfs="double", no_noise="boolean").fields,
    T.StructField("placements", T.ArrayType(PLACEMENT))])

DECODE_LOG = _schema(timestamp="string", t_sec="double", radio_khz="bigint", message="string",
                     jt9_snr_db="int", jt9_line="string")
LAUNCH_LOG = _schema(timestamp="string", t_sec="double", radio_khz="bigint", outcome="string",
                     message="string", jt9_snr_db="int", jt9_line="string")

SPOT = _schema(de_call="string", de_grid="string", freq_hz="bigint", snr="int", mode="string",
               utc_epoch="bigint")

METRICS = _schema(stream_id="string", frame="bigint", channel="int", lin="double")
