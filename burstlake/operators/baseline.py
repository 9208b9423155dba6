"""Noise floors, baselines and summary statistics (aggregations)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import let
from ..scale import drop_halo, quantiles, with_halo

#: Frames per window segment; a multiple of every default refresh and stride.
SEGMENT_FRAMES = 14_400


def rolling_quantile(df: DataFrame, keys: Sequence[str] = ("stream_id", "channel"),
                     frame: str = "frame", x: str = "lin", depth: int = 300, q: float = 0.25,
                     stride: int = 3, refresh: int = 10, floor: float = 1e-30,
                     out: str = "baseline") -> DataFrame:
    """Rolling order statistic: the value at 0-based index int(q * count).

    History is the last ``depth`` frames, every ``stride``-th kept; the value is
    renewed on frames divisible by ``refresh`` and held in between. Frames are
    dense integers, so only renewal frames look at their history, and a segment
    needs ``depth - 1`` frames of its predecessor.
    """
    n, keys = F.col(frame), list(keys)
    rank = lambda size: F.floor(size * F.lit(q)).cast("int") + 1
    if refresh == 1:
        history = (Window.partitionBy(*keys, "segment").orderBy(frame)
                   .rangeBetween(-(depth - 1), 0))
        kept = F.when(F.pmod(n, F.lit(stride)) == 0, F.col(x))
        halo = with_halo(df, frame, max(SEGMENT_FRAMES, 4 * depth), before=depth - 1)
        ranked = halo.withColumn("_r", F.sort_array(F.collect_list(kept).over(history)))
        value = F.element_at("_r", rank(F.size("_r")))
        return drop_halo(ranked.withColumn(out, F.greatest(value, F.lit(floor)))).drop("_r")

    # One row per block of `refresh` frames: the window moves over blocks, each
    # bringing only its few history values, and the frames ride along packed.
    rest = [c for c in df.columns if c not in (*keys, frame, x)]
    back = -(-(depth - 1) // refresh)
    packs = (df.groupBy(*keys, F.floor(n / F.lit(refresh)).cast("long").alias("_b"))
               .agg(F.sort_array(F.collect_list(F.struct(
                   n.cast("long").alias("_f"), F.col(x).alias("_x"), *rest))).alias("_rows"))
               .withColumn("_h", F.transform(
                   F.filter("_rows", lambda i: F.pmod(i["_f"], F.lit(stride)) == 0),
                   lambda i: F.struct(i["_f"].alias("f"), i["_x"].alias("x")))))
    halo = with_halo(packs, "_b", max(SEGMENT_FRAMES // refresh, 4 * back), before=back)
    earlier = Window.partitionBy(*keys, "segment").orderBy("_b").rangeBetween(-back, -1)
    due = F.col("_b") * F.lit(refresh)
    seen = (halo.withColumn("_rows", F.when(F.col("owned"), F.col("_rows")))
                .withColumn("_past", F.flatten(F.collect_list("_h").over(earlier))))
    inside = F.concat(F.filter("_past", lambda p: p["f"] > due - F.lit(depth)),
                      F.filter("_h", lambda p: p["f"] <= due))
    value = let(F.sort_array(F.transform(inside, lambda p: p["x"])),
                lambda s: F.get(s, rank(F.size(s)) - 1))
    return (drop_halo(seen).withColumn(out, F.greatest(value, F.lit(floor)))
            .select(*keys, out, F.explode("_rows").alias("_i"))
            .select(*[F.col("_i._f").alias(c) if c == frame else F.col("_i._x").alias(c) if c == x
                      else F.col(f"_i.{c}").alias(c) if c in rest else F.col(c)
                      for c in df.columns], out))


def metric_db(x: Column, base: Column) -> Column:
    """dB over the baseline, floored at 0."""
    return F.greatest(F.lit(10.0) * F.log10(F.greatest(x / base, F.lit(1e-30))), F.lit(0.0))


def quantile_baseline(df: DataFrame, keys: Sequence[str] = ("stream_id", "channel"), x: str = "lin",
                      q: float = 0.25, bound: int | None = None) -> DataFrame:
    """Whole-series interpolated quantile per channel, and dB over it."""
    base = quantiles(df, keys, x, {"baseline": q}, bound=bound)
    return (df.join(base, list(keys))
              .withColumn("metric_db", F.lit(10.0) * F.log10(
                  F.col(x) / F.greatest(F.col("baseline"), F.lit(1e-30)))))


def floor_ratio(df: DataFrame, keys: Sequence[str], x: str, bound: int | None = None) -> DataFrame:
    """Detection metric over max(25th percentile, 0.1 % of the mean, 1e-20)."""
    ref = quantiles(df, keys, x, {"p25": 0.25}, bound=bound, extra={"mean": F.avg(x)}).select(
        *keys, F.greatest(F.col("p25"), F.lit(0.001) * F.col("mean"), F.lit(1e-20)).alias("reference"))
    return df.join(ref, list(keys)).withColumn("det_norm", F.col(x) / F.col("reference"))


def median_floor(df: DataFrame, keys: Sequence[str] = ("recording",), bin_col: str = "bin",
                 power: str = "power_db", bound: int | None = None) -> DataFrame:
    """Median level of each bin over all frames."""
    return quantiles(df, [*keys, bin_col], power, {"floor_db": 0.5}, bound=bound)


def flatten(df: DataFrame, floor: DataFrame, keys: Sequence[str] = ("recording",),
            bin_col: str = "bin", power: str = "power_db") -> DataFrame:
    """Raise each bin by (highest floor - its floor). ``floor`` has one row per bin."""
    top = F.max("floor_db").over(Window.partitionBy(*keys))
    corr = floor.withColumn("correction_db", top - F.col("floor_db"))
    return (df.join(corr.select(*keys, bin_col, "correction_db"), [*keys, bin_col])
              .withColumn("flat_db", F.col(power) + F.col("correction_db")))


def window_floor(df: DataFrame, keys: Sequence[str] = ("stream_id", "window_id"),
                 bin_col: str = "bin", power: str = "power_db", q: float = 0.1,
                 bound: int | None = None) -> DataFrame:
    """Low percentile per bin and window; absent frames do not count."""
    return quantiles(df, [*keys, bin_col], power, {"floor_db": q}, bound=bound)


def sample_stats(df: DataFrame, frame: str = "frame", bin_col: str = "bin", power: str = "power_db",
                 frame_step: int = 4, bin_step: int = 8, keys: Sequence[str] = ()) -> DataFrame:
    """Min, max and mean on a strided sample (the stride reaches the scan as a filter)."""
    kept = df.where((F.pmod(F.col(frame), F.lit(frame_step)) == 0)
                    & (F.pmod(F.col(bin_col), F.lit(bin_step)) == 0))
    return kept.groupBy(*keys).agg(F.min(power).alias("min_db"), F.max(power).alias("max_db"),
                                   F.avg(power).alias("mean_db"))


def rms_dbfs(df: DataFrame, n: str = "n", x: Column | None = None, span: int = 9600,
             keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """RMS level in dBFS of each span of samples (200 ms at 48 kHz)."""
    x = F.col("x") if x is None else x
    return (df.groupBy(*keys, F.floor(F.col(n) / F.lit(span)).cast("long").alias("span"))
              .agg((F.lit(20.0) * F.log10(F.sqrt(F.avg(x * x)) + F.lit(1e-12))).alias("dbfs")))


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, and 0 when there is nothing."""
    return F.when(whole > 0, part / whole * F.lit(100.0)).otherwise(F.lit(0.0))


def health(df: DataFrame, keys: Sequence[str], part: Column, whole: Column,
           out: str = "percent") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(part).alias("part"), F.sum(whole).alias("whole")).withColumn(
        out, percent(F.col("part"), F.col("whole")))


def array_median(a: Column) -> Column:
    """Median of an array held in one row."""
    at = lambda s, n: F.element_at(s, F.floor(n / 2).cast("int") + 1)
    return let(F.sort_array(a), lambda s: (at(s, F.size(s) - 1) + at(s, F.size(s))) / F.lit(2.0))


def frame_score(df: DataFrame, keys: Sequence[str] = ("recording",), power: str = "power_db",
                min_span_db: float = 1.5, bound: int | None = None) -> DataFrame:
    """Median power of each frame (an array per row) scaled by p10 and p99.5 of the recording."""
    scored = df.withColumn("frame_power", array_median(F.col(power)))
    ref = quantiles(scored, keys, "frame_power", {"p_noise": 0.10, "p_ref": 0.995}, bound=bound)
    return scored.join(ref, list(keys)).withColumn(
        "score", (F.col("frame_power") - F.col("p_noise"))
        / F.greatest(F.col("p_ref") - F.col("p_noise"), F.lit(min_span_db)))


def peak_frame(df: DataFrame, keys: Sequence[str] = ("stream_id",), frame: str = "frame",
               metric: str = "metric_db") -> DataFrame:
    """Frame with the largest channel metric; the lowest frame wins a tie."""
    return df.groupBy(*keys).agg(
        F.max_by(frame, F.struct(F.col(metric), (-F.col(frame)).alias("early"))).alias(frame),
        F.max(metric).alias("peak_db"))
