"""Ordered-row operators: sequence gaps, threshold runs, change detection."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import TASK_ROWS, cut_lineage, islands, lagged, largest_group, number_rows, scan_segments

#: Largest key that is folded as one array instead of segment by segment.
FOLD_ROWS = 20_000


def seq_gaps(df: DataFrame, mod: int = 16, keys: Sequence[str] = ("stream_id",),
             order: Sequence[str] = ("arrival",), seq: str = "seq", bound: int | None = None,
             task_rows: int = TASK_ROWS) -> DataFrame:
    """Packets missed before each packet by its wrapping sequence number (0 for the first).

    Losses of a multiple of ``mod`` packets cannot be seen.
    """
    out = lagged(df, keys, order, {"_prev": seq}, bound, task_rows)
    missed = F.pmod(F.col(seq) - F.col("_prev") - 1, F.lit(mod))
    return out.withColumn("missed", F.coalesce(missed, F.lit(0)).cast("long")).drop("_prev")


def threshold_runs(df: DataFrame, thr: float = 3.0, keys: Sequence[str] = ("stream_id",),
                   frame: str = "frame", metric: str = "metric", bound: int | None = None,
                   task_rows: int = TASK_ROWS) -> DataFrame:
    """Maximal runs of consecutive frames at or above ``thr``: start, end, peak."""
    hot = df.where(F.col(metric) >= thr).select(*keys, frame, metric)
    lab = islands(hot, keys, [frame], {"_prev": frame}, F.col(frame) != F.col("_prev") + 1,
                  bound=bound, task_rows=task_rows)
    return (lab.groupBy(*keys, "island")
               .agg(F.min(frame).alias("start"), F.max(frame).alias("end"),
                    F.max(metric).alias("peak")).drop("island"))


def merge_runs(runs: DataFrame, gap: int, keys: Sequence[str] = ("stream_id",),
               bound: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Join runs whose start is at most ``gap`` after the previous end."""
    lab = islands(runs, keys, ["start"], {"_end": "end"}, F.col("start") - F.col("_end") > gap,
                  bound=bound, task_rows=task_rows)
    return (lab.groupBy(*keys, "island")
               .agg(F.min("start").alias("start"), F.max("end").alias("end"),
                    F.max("peak").alias("peak")).drop("island"))


def rank_runs(runs: DataFrame, keys: Sequence[str] = ("stream_id",), bound: int | None = None,
              task_rows: int = TASK_ROWS) -> DataFrame:
    """Position of each run by peak, strongest first; the earlier run wins a tie."""
    ranked = number_rows(runs, keys, [F.desc("peak"), F.asc("start")], "rank", bound, task_rows)
    return ranked.withColumn("rank", F.col("rank") + 1)


def on_change(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("client_id",),
              order: Sequence[str] = ("seq",), time: str | None = None, min_gap: float = 0.0,
              bound: int | None = None, task_rows: int = TASK_ROWS,
              segment: int = 65_536) -> DataFrame:
    """Rows whose ``cols`` differ from the last emitted row, at least ``min_gap`` s after it.

    Without an interval every change is emitted, so a look at the previous row is
    enough. With one, whether a row is emitted depends on what was emitted
    before: a recurrence whose state is the last emitted time and values. Nulls
    equal nulls. Values of big keys travel as the SHA-256 of their JSON text, in
    which a null is no string.
    """
    keys = list(keys)
    if not min_gap:
        prev = lagged(df.withColumn("_seen", F.struct(*cols)), keys, order, {"_prev": "_seen"},
                      bound, task_rows)
        return prev.where(~F.col("_seen").eqNullSafe(F.col("_prev"))).drop("_seen", "_prev")

    biggest = bound if bound is not None else largest_group(df, keys)
    if biggest <= min(task_rows, FOLD_ROWS):
        return _spaced_changes(df, cols, keys, order, time, min_gap)
    # 0.0 is added because -0.0 equals 0.0 but is written otherwise
    plain = [(F.col(c) + 0.0 if df.schema[c].dataType in (T.DoubleType(), T.FloatType()) else F.col(c)).alias(c)
             for c in cols]
    sig = F.sha2(F.to_json(F.struct(*plain), {"ignoreNullFields": "false"}), 256)
    numbered = number_rows(df.withColumn("_sig", sig), keys, order, "_n", biggest, task_rows)
    rows = cut_lineage(numbered.withColumn("_seg", F.floor(F.col("_n") / F.lit(segment)).cast("long")))
    schema = T.StructType([f for f in rows.schema.fields if f.name not in ("_n", "_seg", "_sig")])

    def step(pdf: pd.DataFrame, state):
        pdf = pdf.sort_values("_n")
        # the signature travels as eight exact 32-bit numbers
        last = None if not state else (state[0], "".join(f"{int(v):08x}" for v in state[1:]))
        keep = []
        for t, s in zip(pdf[time].astype(float).tolist(), pdf["_sig"].tolist()):
            ok = last is None or (s != last[1] and t - last[0] >= min_gap)
            if ok:
                last = (t, s)
            keep.append(ok)
        out = pdf[keep].drop(columns=["_n", "_seg", "_sig"])
        return out, [last[0], *(float(int(last[1][a:a + 8], 16)) for a in range(0, 64, 8))]

    return scan_segments(rows, keys, "_seg", step, schema)


def _spaced_changes(df: DataFrame, cols: Sequence[str], keys: list[str], order: Sequence[str],
                    time: str, min_gap: float) -> DataFrame:
    """``on_change`` with an interval for keys small enough to be folded as one array."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    row = F.struct(*order, *rest)
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    item = packed.schema["_rows"].dataType.elementType
    none = F.array().cast(T.ArrayType(item))
    start = F.struct(F.lit(None).cast(item).alias("last"), none.alias("kept"))

    def take(acc, r):
        same = F.lit(True)
        for c in cols:
            same = same & r[c].eqNullSafe(acc["last"][c])
        ok = acc["last"].isNull() | (~same & (r[time] - acc["last"][time] >= F.lit(float(min_gap))))
        return F.when(ok, F.struct(r.alias("last"), F.array_append(acc["kept"], r).alias("kept"))).otherwise(acc)

    kept = F.aggregate("_rows", start, take, lambda a: a["kept"])
    return packed.select(*keys, F.explode(kept).alias("_r")).select(
        *[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   values: Sequence[str]) -> DataFrame:
    """Last record of each key (partial aggregation, no sort)."""
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"))
              .select(*keys, "_v.*"))


