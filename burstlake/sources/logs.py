"""Decode and launch logs (JSON lines) and truth manifests (JSON documents)."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.messages import strip
from ..scale import number_rows
from ..schemas import DECODE_LOG, LAUNCH_LOG, MANIFEST

CORRUPT = "_corrupt_record"


def log_time(col: Column) -> Column:
    """Timestamp of a log entry; without a zone it is UTC; null if it does not parse."""
    iso = F.regexp_replace(col, r"^(\d{4}-\d{2}-\d{2})[_ T]", "$1T")
    iso = F.regexp_replace(iso, r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00")
    zoned = iso.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, iso).otherwise(F.concat(iso, F.lit("Z"))).try_cast("timestamp")


def parse_log(lines: DataFrame, schema: T.StructType = DECODE_LOG, since: str | None = None,
              col: str = "value") -> DataFrame:
    """JSON lines to rows; blank and non-JSON lines are skipped.

    ``since`` (ISO time, UTC unless it has a zone) keeps later rows and rows
    whose time does not parse. Other columns of ``lines`` are carried along.
    """
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    entry = F.filter(F.array(F.from_json(col, wide, {"columnNameOfCorruptRecord": CORRUPT})),
                     lambda j: j.isNotNull() & j[CORRUPT].isNull())
    keep = [c for c in lines.columns if c != col]
    # exploding none or one entry parses a line once, however the columns are used
    parsed = lines.where(strip(F.col(col)) != "").select(*keep, F.explode(entry).alias("_j"))
    out = parsed.select(*keep, *[F.col(f"_j.{f.name}").alias(f.name) for f in schema.fields],
                        log_time(F.col("_j.timestamp")).alias("logged_at"))
    if since is None:
        return out
    at = datetime.fromisoformat(since)
    at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
    bound = F.timestamp_micros(F.lit((at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)))
    return out.where(F.col("logged_at").isNull() | (F.col("logged_at") >= bound))


def _read(spark: SparkSession, path: str, schema: T.StructType, since: str | None) -> DataFrame:
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"))
    # within a file, splits are ordered by their offset and rows by position in the split
    numbered = number_rows(lines, ["file"], ["_block", "_row"], "line_no")
    return parse_log(numbered.drop("_block", "_row"), schema, since)


def read_decode_log(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Decode log rows with ``file`` and 0-based ``line_no``."""
    return _read(spark, path, DECODE_LOG, since)


def read_launch_log(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    return _read(spark, path, LAUNCH_LOG, since)


def explode_placements(documents: DataFrame) -> DataFrame:
    """One row per placement, document fields kept; a document without any gives one empty row."""
    fields = [c for c in documents.columns if c != "placements"]
    place = MANIFEST["placements"].dataType.elementType.names
    return (documents.select(*fields, F.posexplode_outer("placements").alias("placement_no", "_p"))
                     .select(*fields, "placement_no", *[F.col(f"_p.{c}").alias(c) for c in place]))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    docs = (spark.read.schema(MANIFEST).option("multiLine", "true").json(path)
            .withColumn("manifest", F.col("_metadata.file_path")))
    return explode_placements(docs)


def parse_manifest(df: DataFrame, col: str = "value") -> DataFrame:
    """The same for documents held in a text column."""
    doc = df.withColumn("_d", F.from_json(col, MANIFEST))
    keep = [c for c in df.columns if c != col]
    return explode_placements(doc.select(*keep, "_d.*"))
