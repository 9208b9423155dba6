"""Blocks, overlapping frames, time slots and event segments of sample streams.

Two forms of a stream are used: long rows ``(stream_id, n, x...)`` and blocks
``(stream_id, block_idx, x ARRAY...)`` of a fixed number of samples. Every
group built here has a size fixed by a parameter, whatever the stream length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("stream_id",)
#: Picoseconds in a second.
PICOS = 1_000_000_000_000


def ordered_arrays(n: str, cols: Sequence[str]) -> Column:
    return F.sort_array(F.collect_list(F.struct(F.col(n).alias("n"), *[F.col(c) for c in cols])))


def unpack(items: str, cols: Sequence[str]) -> list[Column]:
    return [F.col(f"{items}.{c}").alias(c) for c in cols]


def to_blocks(df: DataFrame, size: int = 8192, cols: Sequence[str] = ("x",),
              keys: Sequence[str] = KEYS, n: str = "n") -> DataFrame:
    """Long rows to blocks of ``size`` samples (the last one of a stream may be shorter)."""
    return (df.groupBy(*keys, F.floor(F.col(n) / F.lit(size)).cast("long").alias("block_idx"))
              .agg(ordered_arrays(n, cols).alias("_s"))
              .select(*keys, "block_idx", (F.col("block_idx") * size).alias("first_sample"),
                      *unpack("_s", cols)))


def to_samples(blocks: DataFrame, cols: Sequence[str] = ("x",), keys: Sequence[str] = KEYS,
               n: str = "n") -> DataFrame:
    """Blocks to long rows."""
    return (blocks.select(*keys, "first_sample", F.posexplode(F.arrays_zip(*cols)).alias("_i", "_s"))
                  .select(*keys, (F.col("first_sample") + F.col("_i")).alias(n),
                          *[F.col(f"_s.{c}").alias(c) for c in cols]))


def split_blocks(blocks: DataFrame, size: int, cols: Sequence[str] = ("x",),
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """Blocks cut into blocks of ``size`` samples, which must divide their length; nothing is shuffled."""
    part = lambda k: F.struct(*[F.slice(c, k * size + 1, size).alias(c) for c in cols])
    last = F.ceil(F.size(cols[0]) / F.lit(size)).cast("int") - 1
    return (blocks.select(*keys, "first_sample", F.posexplode(F.transform(
                F.sequence(F.lit(0), last), part)).alias("_k", "_s"))
            .select(*keys, (F.floor(F.col("first_sample") / F.lit(size)) + F.col("_k")).cast("long").alias("block_idx"),
                    (F.col("first_sample") + F.col("_k") * size).alias("first_sample"), "_s.*"))


def with_edges(blocks: DataFrame, cols: Sequence[str], before: int = 0, after: int = 0,
               keys: Sequence[str] = KEYS, fill: Sequence[str] = ("head", "tail")) -> DataFrame:
    """Attach the last ``before`` samples of the previous block as ``<col>_head`` and the
    first ``after`` of the next as ``<col>_tail``.

    Edges named in ``fill`` get zeros where there is no neighbour (zero initial
    state); others are then empty.
    """
    by = [*keys, "block_idx"]
    rest = [c for c in blocks.columns if c not in by]
    widths = {name: w for name, w in (("head", before), ("tail", after)) if w}
    # A block goes to its own number and its edges to the neighbours', in one
    # scan and one shuffle; joining edges back would read the input three times.
    cut = {"head": lambda c, w: F.slice(c, F.greatest(F.size(c) - w + 1, F.lit(1)), w),
           "tail": lambda c, w: F.slice(c, 1, w)}
    edge = {name: F.struct(*[cut[name](c, w).cast("array<double>").alias(c) for c in cols])
            for name, w in widths.items()}
    parts = {"own": F.struct(*rest), **edge}
    shift = {"own": 0, "head": 1, "tail": -1}
    piece = lambda role: F.struct((F.col("block_idx") + shift[role]).cast("long").alias("block_idx"), *[
        (v if name == role else F.when(F.lit(False), v)).alias(f"_{name}") for name, v in parts.items()])
    met = (blocks.select(*keys, F.explode(F.array(*[piece(role) for role in parts])).alias("_p"))
                 .select(*keys, "_p.*").groupBy(*by)
                 .agg(*[F.collect_list(f"_{name}").alias(f"_{name}") for name in parts])
                 .where(F.size("_own") > 0))
    out = met.select(*by, F.get("_own", F.lit(0)).alias("_own"),
                     *[F.get(f"_{name}", F.lit(0)).alias(f"_{name}") for name in widths])

    def neighbour(name: str, c: str, w: int) -> Column:
        have = F.coalesce(F.col(f"_{name}.{c}"), F.array().cast("array<double>"))
        if name not in fill:
            return have
        pad = F.array_repeat(F.lit(0.0), F.lit(w) - F.size(have))
        return F.concat(pad, have) if name == "head" else F.concat(have, pad)

    return out.select(*[F.col(c) if c in by else F.col(f"_own.{c}").alias(c) for c in blocks.columns],
                      *[neighbour(name, c, w).alias(f"{c}_{name}") for name, w in widths.items() for c in cols])


def frames(df: DataFrame, size: int, hop: int, tail: str = "drop", pad_to: int | None = None,
           cols: Sequence[str] = ("x",), keys: Sequence[str] = KEYS, n: str = "n") -> DataFrame:
    """Overlapping frames of a long stream: frame f holds samples f*hop .. f*hop + size - 1.

    ``drop`` keeps full frames only; ``pad`` starts a frame at every hop and
    fills it with zeros up to ``pad_to`` (default ``size``).
    """
    at = F.col(n)
    first = F.greatest(F.ceil((at - F.lit(size - 1)) / F.lit(hop)), F.lit(0)).cast("long")
    last = F.floor(at / F.lit(hop)).cast("long")
    spread = df.where(last >= first) if hop > size else df
    out = (spread.withColumn("frame", F.explode(F.sequence(first, last)))
                 .groupBy(*keys, "frame").agg(ordered_arrays(n, cols).alias("_s")))
    if tail == "drop":
        return out.where(F.size("_s") == size).select(*keys, "frame", *unpack("_s", cols))
    if tail != "pad":
        raise ValueError(tail)
    out = out.select(*keys, "frame", *unpack("_s", cols))
    width = pad_to or size
    for c in cols:
        out = out.withColumn(c, F.concat(c, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(c))))
    return out


def frames_of_blocks(blocks: DataFrame, size: int, hop: int, block: int,
                     cols: Sequence[str] = ("x",), keys: Sequence[str] = KEYS) -> DataFrame:
    """Full frames cut straight out of blocks; ``block`` must be a multiple of ``hop``."""
    if block % hop or size - hop > block:
        raise ValueError("block must be a multiple of hop and at least size - hop long")
    edged = with_edges(blocks, cols, after=size - hop, keys=keys, fill=())
    joined = {c: F.concat(F.col(c).cast("array<double>"), F.col(f"{c}_tail")) for c in cols}
    wide = edged.select(*keys, "first_sample", *[v.alias(c) for c, v in joined.items()])
    count = F.least(F.lit(block // hop),
                    F.floor((F.size(cols[0]) - F.lit(size)) / F.lit(hop)).cast("int") + 1)
    return (wide.where(count > 0)
                .withColumn("_k", F.explode(F.sequence(F.lit(0), count - 1)))
                .select(*keys, (F.floor(F.col("first_sample") / F.lit(hop)) + F.col("_k"))
                        .cast("long").alias("frame"),
                        *[F.slice(c, F.col("_k") * hop + 1, size).alias(c) for c in cols]))


def slots(df: DataFrame, t: Column, secs: float = 15.0, rate: float = 46.875,
          count: int | None = None) -> DataFrame:
    """Tumbling window number and slot within it: clamp(floor(position * rate), 0, count - 1)."""
    count = int(secs * rate) if count is None else count
    window = F.floor(t / F.lit(secs)).cast("long")
    pos = t - window * F.lit(secs)
    slot = F.least(F.greatest(F.floor(pos * F.lit(rate)).cast("long"), F.lit(0)), F.lit(count - 1))
    return df.withColumn("window_id", window).withColumn("position", pos).withColumn("slot", slot)


def last_per_slot(df: DataFrame, order: Sequence[str], values: Sequence[str],
                  keys: Sequence[str] = ("stream_id", "window_id", "slot")) -> DataFrame:
    """Last write wins: the values with the largest ``order`` in each slot."""
    return (df.groupBy(*keys)
              .agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v"))
              .select(*keys, "_v.*"))


def event_segments(blocks: DataFrame, events: DataFrame, pre: int, post: int, pad: int,
                   block: int, cols: Sequence[str] = ("x",), keys: Sequence[str] = KEYS,
                   event: str = "event_id", at: str = "at") -> DataFrame:
    """Samples at - pre .. at + post - 1 round each event, padded with zeros at both ends.

    An event touches a handful of blocks, so it is joined to them by block
    number. What the stream does not have is left out.
    """
    lo, hi = F.col(at) - F.lit(pre), F.col(at) + F.lit(post)
    touched = events.select(*keys, event, lo.alias("_lo"), hi.alias("_hi"), F.explode(F.sequence(
        F.floor(lo / F.lit(block)).cast("long"),
        F.floor((hi - 1) / F.lit(block)).cast("long"))).alias("block_idx"))
    from_ = F.greatest(F.col("_lo") - F.col("first_sample"), F.lit(0)).cast("int")
    upto = F.least(F.col("_hi") - F.col("first_sample"), F.size(cols[0]).cast("long")).cast("int")
    parts = (touched.join(blocks, [*keys, "block_idx"])
             .where(upto > from_)
             .select(*keys, event, "block_idx", *[
                 F.slice(c, from_ + 1, upto - from_).alias(c) for c in cols]))
    packed = parts.groupBy(*keys, event).agg(ordered_arrays("block_idx", cols).alias("_p"))
    zeros = F.array_repeat(F.lit(0.0), F.lit(pad))
    return packed.select(*keys, event, *[
        F.concat(zeros, F.flatten(f"_p.{c}"), zeros).alias(c)
        for c in cols])


def rebatch(df: DataFrame, size: int = 1024, cols: Sequence[str] = ("x",),
            keys: Sequence[str] = KEYS, rate: float = 48_000.0) -> DataFrame:
    """Regroup packets (first_sample, time, arrays) into batches of ``size`` samples.

    A batch holds the samples whose absolute number falls in it, whatever the
    packet order. Its time is that of its first sample: the time of the packet
    that brought it plus the samples before it in the packet, in picoseconds.
    """
    n = F.col("first_sample") + F.col("_i")
    long = (df.select(*keys, "first_sample", "ts_sec", "ts_ps",
                      F.posexplode(F.arrays_zip(*cols)).alias("_i", "_s"))
              .select(*keys, n.alias("n"), "first_sample", "ts_sec", "ts_ps",
                      *[F.col(f"_s.{c}").alias(c) for c in cols]))
    return (long.groupBy(*keys, F.floor(F.col("n") / F.lit(size)).cast("long").alias("block_idx"))
                .agg(ordered_arrays("n", cols).alias("_s"),
                     F.min(F.struct("first_sample", "ts_sec", "ts_ps")).alias("_t"))
                .withColumn("_n", F.get("_s", F.lit(0))["n"])
                .withColumn("_ps", F.col("_t.ts_ps") + F.round(
                    (F.col("_n") - F.col("_t.first_sample")) * F.lit(1e12 / rate)).cast("long"))
                .select(*keys, "block_idx", F.col("_n").alias("first_sample"),
                        (F.col("_t.ts_sec") + F.floor(F.col("_ps") / PICOS)).cast("long").alias("ts_sec"),
                        F.pmod("_ps", PICOS).alias("ts_ps"), *unpack("_s", cols)))


def newest_generation(work: DataFrame, generations: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep work of each stream's newest generation; a source switch makes older work stale."""
    newest = generations.groupBy(*keys).agg(F.max("generation").alias("generation"))
    return work.join(newest, [*keys, "generation"], "left_semi")
