"""WAV recordings as blocks of complex samples.

Files are cut into byte ranges and every range is read by its own task, so one
long recording does not sit in one task.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import analytic, analytic_gain
from ..operators.transforms import spectral_blocks
from ..scale import cut_lineage, join_keys

LAYOUT = ("stream_id string, length bigint, rate int, channels int, width int, "
          "data_at bigint, n_frames bigint")
#: Longest recording whose analytic signal is made in one row: 8 MB of samples.
SHORT = 1 << 20
#: Bytes read for a file's header, samples of a table that a task gives out, what a row counts besides its samples.
HEAD, BATCH, ROW = 4096, 1 << 20, 256
PIECE = "stream_id string, block_idx bigint, first_sample bigint, rate int, i array<float>, q array<float>"


def wav_layout(read: Callable[[int, int], bytes], length: int) -> tuple[int, int, int, int, int]:
    """(rate, channels, bytes per sample, offset of the data, frames) of a RIFF or RF64 file.

    ``read(at, n)`` gives bytes of the file; chunks are walked by their offsets,
    so any number of other chunks of any size may come before the samples. Data
    sizes of 4 GiB and more come from the ``ds64`` chunk of RF64; in plain RIFF
    they have wrapped, and the file's length says how often.
    """
    head = read(0, 12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt, long_data = 12, None, None
    while at + 8 <= length:
        name, size = struct.unpack("<4sI", read(at, 8))
        if name == b"ds64":
            long_data = struct.unpack("<Q", read(at + 16, 8))[0]
        elif name == b"fmt ":
            _, channels, rate, _, _, bits = struct.unpack("<HHIIHH", read(at + 8, 16))
            fmt = (rate, channels, bits // 8)
        elif name == b"data" and fmt:
            rate, channels, width = fmt
            room = length - at - 8
            if head[:4] == b"RF64" and size == 0xFFFFFFFF and long_data is not None:
                size = long_data
            elif size <= room:
                size += (room - size) >> 32 << 32
            return rate, channels, width, at + 8, min(size, room) // (channels * width)
        at += 8 + size + size % 2
    raise ValueError("no data chunk in the WAV file")


def raw_levels(raw: bytes, width: int, as_float: bool, peak: float) -> np.ndarray:
    """Samples scaled to +-1. Four-byte data is float (over its peak if above 1) or int."""
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128.0) / 128.0
    if width == 2:
        return np.frombuffer(raw, "<i2").astype(np.float32) / np.float32(32768.0)
    if width == 4:
        if as_float:
            x = np.frombuffer(raw, "<f4")
            return x / np.float32(peak) if peak > 1.0 else x
        return np.frombuffer(raw, "<i4").astype(np.float32) / np.float32(2147483648.0)
    raise ValueError(f"unsupported sample width of {width} bytes")


def float_evidence(raw: bytes) -> tuple[bool, float]:
    """Whether four-byte data can be float (finite, at most 10) and its peak."""
    x = np.frombuffer(raw, "<f4")
    finite = bool(np.all(np.isfinite(x)))
    return finite, float(np.max(np.abs(x))) if finite and len(x) else float("inf") if not finite else 0.0


def to_iq(x: np.ndarray, channels: int, on_multi: str) -> tuple[np.ndarray, np.ndarray]:
    frames = x.reshape(-1, channels)
    if channels == 1 or (channels > 2 and on_multi == "mean"):
        real = frames.mean(axis=1).astype(np.float32)
        return real, np.zeros_like(real)
    return frames[:, 0], frames[:, 1]


def is_real(channels: int, on_multi: str) -> bool:
    return channels == 1 or (channels > 2 and on_multi == "mean")


def _open(path: str):
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path)
    return system.open_input_file(where)


def _head(src, length: int) -> Callable[[int, int], bytes]:
    """``read(at, n)`` for the chunk walk: the file's beginning is read once."""
    begin = src.read_at(min(length, HEAD), 0)
    return lambda at, n: begin[at:at + n] if at + n <= len(begin) else src.read_at(n, at)


def piece_rows(parts, block: int) -> Iterator[pd.DataFrame]:
    """Blocks of (stream_id, rate, first sample, i, q) in tables of some ``BATCH`` samples, however short the recordings."""
    rows, held = [], 0
    for name, rate, first, i, q in parts:
        for a in range(0, len(i), block):
            rows.append((name, (first + a) // block, first + a, rate, i[a:a + block], q[a:a + block]))
            held += min(block, len(i) - a) + ROW
            if held >= BATCH:
                yield pd.DataFrame(rows, columns=["stream_id", "block_idx", "first_sample", "rate", "i", "q"])
                rows, held = [], 0
    if rows:
        yield pd.DataFrame(rows, columns=["stream_id", "block_idx", "first_sample", "rate", "i", "q"])


def read_recordings(spark: SparkSession, path: str, block: int = 8192, on_multi: str = "first2",
                    blocks_per_task: int = 64, mono_to_analytic: bool = True) -> DataFrame:
    """Blocks (stream_id = file, block_idx, first_sample, rate, i, q) of all WAV files under ``path``."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", "*.[wW][aA][vV]").load(path)
             .select(F.col("path").alias("stream_id"), "length"))

    def layouts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for f, n in zip(pdf["stream_id"], pdf["length"]):
                with _open(f) as src:
                    rows.append((f, n, *wav_layout(_head(src, n), n)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LAYOUT.split(", ")])

    # a split holds a few dozen short files at most; only their heads are read here, so a task takes many splits
    files = files.coalesce(max(4 * spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions() // 32))
    # one row per file
    layout = cut_lineage(files.mapInPandas(layouts, LAYOUT))
    span = block * blocks_per_task
    pieces = (layout.where("n_frames > 0").withColumn("piece", F.explode(F.sequence(
                  F.lit(0), F.floor((F.col("n_frames") - 1) / F.lit(span)).cast("long"))))
              .repartition("stream_id", "piece"))

    def read(p):
        first = p.piece * span
        count = min(span, p.n_frames - first)
        size = p.channels * p.width
        with _open(p.stream_id) as src:
            return src.read_at(int(count * size), int(p.data_at + first * size))

    def evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(p.stream_id, *float_evidence(read(p))) for p in pdf.itertuples()]
            yield pd.DataFrame(got, columns=["stream_id", "finite", "peak"])

    four = (pieces.where("width = 4").mapInPandas(evidence, "stream_id string, finite boolean, peak double")
            .groupBy("stream_id").agg(F.bool_and("finite").alias("finite"), F.max("peak").alias("peak")))
    ready = pieces.join(four, "stream_id", "left")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts():
            for pdf in batches:
                for p in pdf.itertuples():
                    as_float = bool(p.finite) and p.peak <= 10 if p.width == 4 else False
                    yield p.stream_id, p.rate, int(p.piece * span), *to_iq(
                        raw_levels(read(p), p.width, as_float, p.peak), p.channels, on_multi)
        yield from piece_rows(parts(), block)

    if not mono_to_analytic:
        return ready.mapInPandas(decode, PIECE)
    real = (F.col("channels") == 1) | ((F.col("channels") > 2) & F.lit(on_multi == "mean"))
    return ready.where(~real).mapInPandas(decode, PIECE).unionByName(
        analytic_blocks(ready.where(real).mapInPandas(decode, PIECE), block))


def analytic_blocks(blocks: DataFrame, block: int = 8192, short: int = SHORT) -> DataFrame:
    """Real recordings to analytic ones.

    Recordings of at most ``short`` samples are transformed in one row each, longer ones, of any length, in
    strips over many tasks. The real blocks are written once, as both need their lengths first.
    """
    keys = ["stream_id", "rate"]
    rows = cut_lineage(blocks)
    length = cut_lineage(rows.groupBy(*keys).agg(F.max(F.col("first_sample") + F.size("i")).alias("_n")))
    few, many = length.where(F.col("_n") <= short), length.where(F.col("_n") > short)
    whole = (join_keys(rows, few, keys, "left_semi").groupBy(*keys)
             .agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block_idx", "i"))),
                                        lambda b: b["i"].cast("array<double>"))).alias("x"))
             .select(*keys, analytic()(F.col("x")).alias("y")))
    cut = lambda c: F.slice(F.col(f"y.{c}"), F.col("block_idx").cast("int") * block + 1, block)
    count = F.ceil(F.size("y.re") / F.lit(block)).cast("long")
    out = (whole.withColumn("block_idx", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
                .select(*keys, "block_idx", cut("re").alias("re"), cut("im").alias("im")))
    if not many.isEmpty():
        out = out.unionByName(spectral_blocks(join_keys(rows, many, keys, "left_semi"), analytic_gain, block, keys, "i", None))
    return out.select("stream_id", "block_idx", (F.col("block_idx") * block).alias("first_sample"), "rate",
                      F.col("re").cast("array<float>").alias("i"), F.col("im").cast("array<float>").alias("q"))


def decode_recordings(df: DataFrame, block: int = 8192, on_multi: str = "first2",
                      name: str = "path", content: str = "content",
                      mono_to_analytic: bool = True) -> DataFrame:
    """The same for recordings held in a binary column (short clips in a table)."""
    def decoder(kinds: tuple[bool, ...]):
        def parts(batches: Iterator[pd.DataFrame]):
            for pdf in batches:
                for p, raw in zip(pdf[name], pdf[content]):
                    raw = bytes(raw)
                    rate, channels, width, at, n = wav_layout(lambda a, size: raw[a:a + size], len(raw))
                    if is_real(channels, on_multi) not in kinds:
                        continue
                    data = raw[at:at + n * channels * width]
                    finite, peak = float_evidence(data) if width == 4 else (False, 0.0)
                    yield str(p), rate, 0, *to_iq(raw_levels(data, width, finite and peak <= 10, peak), channels, on_multi)

        def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            yield from piece_rows(parts(batches), block)
        return decode

    clips = df.select(name, content)
    if not mono_to_analytic:
        return clips.mapInPandas(decoder((True, False)), PIECE)
    return clips.mapInPandas(decoder((False,)), PIECE).unionByName(
        analytic_blocks(clips.mapInPandas(decoder((True,)), PIECE), block))
