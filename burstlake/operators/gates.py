"""Stateful accept/ignore rules on triggers: coincidence, cooldown, neighbours."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import N_CHANNELS
from ..scale import chain_states, cut_lineage, largest_group, scan_segments

#: Frames per segment of a cooldown fold.
SEGMENT_FRAMES = 16_384


def coincidence_gate(df: DataFrame, max_channels: int = 8, max_span: int = 5,
                     circular: bool = False, keys: Sequence[str] = ("stream_id",),
                     frame: str = "frame", channel: str = "channel") -> DataFrame:
    """Mark triggers of frames in which too many or too scattered channels fired.

    Input rows are triggers. A frame has at most one row per channel, so the
    window by (stream, frame) is bounded by the channel count. ``circular``
    measures the span round the band edge (channels 47 and 0 are neighbours).
    """
    w = Window.partitionBy(*keys, frame)
    count = F.count("*").over(w)
    if circular:
        ch = F.sort_array(F.collect_list(channel).over(w))
        gaps = F.transform(ch, lambda c, i: F.pmod(
            F.get(ch, F.pmod(i + 1, F.size(ch))) - c, F.lit(N_CHANNELS)))
        span = F.when(count > 1, F.lit(N_CHANNELS) - F.array_max(gaps)).otherwise(0)
    else:
        span = F.max(channel).over(w) - F.min(channel).over(w)
    return (df.withColumn("n_triggered", count).withColumn("span", span)
              .withColumn("gated", (F.col("n_triggered") >= max_channels)
                          | ((F.col("n_triggered") >= 3) & (F.col("span") > max_span))))


def cooldown(df: DataFrame, frames: int = 46, keys: Sequence[str] = ("stream_id", "channel"),
             frame: str = "frame", restart: Column | None = None,
             payload: Sequence[str] = ()) -> DataFrame:
    """Greedy refractory rule: after an accepted trigger ignore the key for ``frames`` frames.

    Ignored triggers do not extend the pause. Rows where ``restart`` is true are
    never accepted but always start a pause. At most one row per (key, frame).

    A key's frames are cut into segments. What a segment passes on is only how
    many frames of pause are left, one of ``frames`` values, so each segment is
    folded once per value into a table, the tables are composed, and then every
    segment knows its entry state. No task sees more than one segment of a key.
    """
    keys = list(keys)
    length = max(SEGMENT_FRAMES, frames)
    gap, seg_len = F.lit(frames).cast("long"), F.lit(length).cast("long")
    flag = F.lit(False) if restart is None else restart
    item = F.struct(F.col(frame).cast("long").alias("at"), flag.alias("restart"),
                    *[F.col(p) for p in payload])
    # triggers are few next to the metrics they come from: keep them, compute those once
    packed = cut_lineage(df.withColumn("segment", F.floor(F.col(frame) / seg_len).cast("long"))
                         .groupBy(*keys, "segment")
                         .agg(F.sort_array(F.collect_list(item)).alias("_items")))
    begin = F.col("segment") * seg_len

    def pause(until, x):
        return F.when(x["restart"] | (x["at"] >= until), x["at"] + gap).otherwise(until)

    if largest_group(packed, keys) <= 1:
        # one segment per key: nothing is handed on
        entered = packed.withColumn("entry", F.lit(0))
    else:
        tables = packed.withColumn("_table", F.transform(
            F.sequence(F.lit(0), F.lit(max(frames - 1, 0))),
            lambda e: F.aggregate("_items", begin + e, pause,
                                  lambda until: F.greatest(until - begin - seg_len, F.lit(0))
                                  .cast("int"))))
        entered = packed.join(chain_states(tables, keys, "segment", "_table"), [*keys, "segment"])

    none = F.array().cast(packed.schema["_items"].dataType)

    def take(acc, x):
        ok = ~x["restart"] & (x["at"] >= acc["until"])
        return F.struct(pause(acc["until"], x).alias("until"),
                        F.when(ok, F.array_append(acc["kept"], x)).otherwise(acc["kept"]).alias("kept"))

    kept = F.aggregate("_items", F.struct((begin + F.col("entry")).alias("until"), none.alias("kept")),
                       take, lambda a: a["kept"])
    return (entered.select(*keys, F.explode(kept).alias("_x"))
                   .select(*keys, F.col("_x.at").alias(frame), *[F.col(f"_x.{p}") for p in payload]))


def suppress_neighbours(df: DataFrame, span: float = 2.0, horizon: int = 46,
                        keys: Sequence[str] = ("stream_id",), frame: str = "frame",
                        position: str = "channel", segment: int = 65_536) -> DataFrame:
    """Drop a trigger closer than ``span`` to one accepted less than ``horizon`` frames before.

    Triggers are taken in order of (frame, position). The state handed to the
    next segment is the list of accepted triggers still within the horizon.
    """
    keys = list(keys)
    rows = cut_lineage(df.withColumn("_seg", F.floor(F.col(frame) / F.lit(segment)).cast("long")))
    schema = T.StructType([f for f in rows.schema.fields if f.name != "_seg"])

    def step(pdf: pd.DataFrame, state):
        pdf = pdf.sort_values([frame, position], kind="stable")
        live = [(state[i], state[i + 1]) for i in range(0, len(state or []), 2)]
        keep = []
        for f, p in zip(pdf[frame].tolist(), pdf[position].tolist()):
            live = [a for a in live if f - a[0] < horizon]
            ok = all(abs(p - a[1]) >= span for a in live)
            if ok:
                live.append((float(f), float(p)))
            keep.append(ok)
        end = (int(pdf["_seg"].iloc[0]) + 1) * segment
        live = [a for a in live if end - a[0] < horizon]
        return pdf[keep].drop(columns="_seg"), [v for a in live for v in a]

    return scan_segments(rows, keys, "_seg", step, schema)
