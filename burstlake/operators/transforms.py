"""Spectral filters over whole recordings of any length, as Spark jobs.

A recording of n samples is looked at as a matrix of ``rows`` by ``cols``, sample a * cols + b at
(a, b). Its transform takes the columns' transforms, turns them, and takes the rows' transforms; the
gain is applied to the rows and the way back undoes the same steps, so nothing is put into
frequency order. Tasks hold strips of columns or rows of about ``task`` samples; tiles, the
crossing of a strip of columns and one of rows, are what is shuffled. Strips of a long recording
are wider, by the root of its length, so that tiles keep some ``TILE`` samples and are as many as the samples ask for.

Lengths without two factors of about equal size use a chirp: the transform of length n becomes a convolution of
a power of two of at least 2n - 1 samples, done the same way. Samples that no block holds count as zero.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache
from math import isqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scale import cut_lineage, join_keys

#: Samples of a strip: 4 MB of complex doubles.
TASK = 1 << 18
#: Samples that a tile holds on the whole, however long its recording.
TILE = 256

#: (bin numbers, recording length) -> gain of each bin.
Gain = Callable[[np.ndarray, int], np.ndarray]


class Shape(NamedTuple):
    n: int       # samples of the recording
    rows: int
    cols: int
    wide: int    # columns of a strip of columns
    high: int    # rows of a strip of rows
    chirp: bool


def strip_of(size: int, task: int = TASK) -> int:
    """Samples of a strip of a matrix of ``size``: at least ``task``, and so many that two strips cross in ``TILE`` samples."""
    return max(task, isqrt(TILE * size))


@lru_cache(maxsize=4096)
def shape_of(n: int, task: int = TASK) -> Shape:
    """How a recording of ``n`` samples is laid out: by two factors at most 16 apart in ratio, or by a chirp."""
    root = int(n ** 0.5)
    rows = next((a for a in range(root, max(1, root // 4) - 1, -1) if a and n % a == 0), 0)
    chirp = not rows
    if chirp:
        bits = (2 * n - 2).bit_length()
        rows, cols = 1 << (bits // 2), 1 << (bits - bits // 2)
    else:
        cols = n // rows
    task = strip_of(rows * cols, task)
    return Shape(n, rows, cols, min(cols, max(1, task // rows)), min(rows, max(1, task // cols)), chirp)


def turn(numerator: np.ndarray, size: int) -> np.ndarray:
    """exp(-2 pi i numerator / size), the angle reduced in whole numbers."""
    return np.exp(-2j * np.pi * ((numerator % size) / size))


def chirp(k: np.ndarray, n: int) -> np.ndarray:
    """exp(-pi i k^2 / n)."""
    return turn(k * k, 2 * n)


def places(lo: int, hi: int, c0: int, c1: int, cols: int) -> np.ndarray:
    """Sample numbers from lo up to hi that lie in the columns from c0 up to c1, ascending."""
    at = (np.arange(lo // cols, -(-hi // cols))[:, None] * cols + np.arange(c0, c1)).ravel()
    return at[(at >= lo) & (at < hi)]


def strips(size: int, width: int) -> list[tuple[int, int]]:
    return [(a, min(size, a + width)) for a in range(0, size, width)]


def spectral_blocks(blocks: DataFrame, gain: Gain, block: int = 8192, keys: Sequence[str] = ("stream_id",),
                    re: str = "i", im: str | None = "q", task: int = TASK) -> DataFrame:
    """Blocks (keys, block_idx, samples) -> (keys, block_idx, re, im) after ``gain`` on each recording's whole transform.

    Blocks are ``block`` samples long but for the last of a recording. Without ``im`` samples are real.
    Results are doubles; every block up to the last is returned, also those missing in the input.
    Empty recordings give no rows.
    """
    keys = list(keys)
    zero = F.transform(re, lambda v: F.lit(0.0))
    rows = blocks.where(F.size(re) > 0).select(*keys, "block_idx", F.col(re).cast("array<double>").alias("re"),
                                               (zero if im is None else F.col(im)).cast("array<double>").alias("im"))
    rows = cut_lineage(rows)
    length = rows.groupBy(*keys).agg(F.max(F.col("block_idx") * block + F.size("re")).alias("_n"))
    kept = [f for f in rows.schema.fields if f.name in keys]
    values = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("re", "im")]
    tile = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in ("_n", "_from", "_to")], *values])
    out = T.StructType([*kept, T.StructField("block_idx", T.LongType()), *values])
    heads = [f.name for f in kept]

    def table(key, n, source, parts) -> pd.DataFrame:
        """Tiles (to, complex values) as rows; a chirp's tile holds its samples, then the chirp's own."""
        to, data = [p[0] for p in parts], [p[1] for p in parts]
        return pd.DataFrame({**{k: [v] * len(to) for k, v in zip(heads, key)}, "_n": n, "_from": source, "_to": to,
                             "re": [d.real.copy() for d in data], "im": [d.imag.copy() for d in data]}, columns=tile.names)

    def tiles(pdf):
        for source, a, b in zip(pdf["_from"].tolist(), pdf["re"], pdf["im"]):
            yield source, np.asarray(a) + 1j * np.asarray(b)

    def span(n: int) -> int:
        """Samples of a strip in time order."""
        s = shape_of(n, task)
        return block * max(1, strip_of(s.rows * s.cols, task) // block)

    def limits(q: int, n: int) -> tuple[int, int]:
        return q * span(n), min(n, (q + 1) * span(n))

    def first(it):
        """An empty tile for each strip of columns, so that all of them come up whatever blocks are missing."""
        for pdf in it:
            for *key, n in zip(*[pdf[c].tolist() for c in [*heads, "_n"]]):
                s = shape_of(int(n), task)
                yield table(key, n, -1, [(j, np.zeros(0, complex)) for j in range(len(strips(s.cols, s.wide)))])

    def from_time(key, pdf):
        *head, n, q = key
        n, q = int(n), int(q)
        s, (lo, hi) = shape_of(n, task), limits(q, n)
        x = np.zeros(hi - lo, complex)
        for b, i, v in zip(pdf["block_idx"].tolist(), pdf["re"], pdf["im"]):
            x[b * block - lo:b * block - lo + len(i)] = np.asarray(i) + 1j * np.asarray(v)
        return table(head, n, q, [(j, x[places(lo, hi, a, b, s.cols) - lo]) for j, (a, b) in enumerate(strips(s.cols, s.wide))])

    def columns_out(head, s: Shape, j: int, x: np.ndarray) -> pd.DataFrame:
        """Transforms of a strip's columns, turned, cut into tiles for the strips of rows."""
        a, b = strips(s.cols, s.wide)[j]
        size = s.rows * s.cols
        wheel = turn(np.arange(s.rows)[:, None] * np.arange(a, b), size)
        parts = [np.fft.fft(x, axis=0) * wheel]
        if s.chirp:
            at = np.arange(s.rows)[:, None] * s.cols + np.arange(a, b)
            near = np.minimum(at, size - at)
            parts.append(np.fft.fft(np.where(near < s.n, chirp(near, s.n).conj(), 0), axis=0) * wheel)
        return table(head, s.n, j, [(k, np.concatenate([p[lo:hi].ravel() for p in parts]))
                                    for k, (lo, hi) in enumerate(strips(s.rows, s.high))])

    def to_rows(key, pdf):
        *head, n, j = key
        s = shape_of(int(n), task)
        a, b = strips(s.cols, s.wide)[int(j)]
        x = np.zeros(s.rows * (b - a), complex)
        for q, v in tiles(pdf):
            if q >= 0:
                at = places(*limits(q, s.n), a, b, s.cols)
                x[at // s.cols * (b - a) + at % s.cols - a] = v * chirp(at, s.n) if s.chirp else v
        return columns_out(head, s, int(j), x.reshape(s.rows, b - a))

    def in_rows(key, pdf):
        """The rows' transforms, the gain or the chirp on them, and back: tiles for the strips of columns."""
        *head, n, k = key
        s = shape_of(int(n), task)
        lo, hi = strips(s.rows, s.high)[int(k)]
        cuts = strips(s.cols, s.wide)
        x = np.zeros((1 + s.chirp, hi - lo, s.cols), complex)
        for j, v in tiles(pdf):
            a, b = cuts[j]
            x[:, :, a:b] = v.reshape(-1, hi - lo, b - a)
        x = np.fft.fft(x, axis=2)
        k1 = np.arange(lo, hi)[:, None]
        y = x[0] * (x[1] if s.chirp else gain(k1 + s.rows * np.arange(s.cols), s.n))
        y = np.fft.ifft(y, axis=1) * turn(k1 * np.arange(s.cols), s.rows * s.cols).conj()
        return table(head, s.n, int(k), [(j, y[:, a:b].ravel()) for j, (a, b) in enumerate(cuts)])

    def columns_in(s: Shape, j: int, pdf) -> tuple[np.ndarray, np.ndarray]:
        """(sample or bin numbers, values) of a strip of columns that comes back from the rows."""
        a, b = strips(s.cols, s.wide)[j]
        x = np.zeros((s.rows, b - a), complex)
        cuts = strips(s.rows, s.high)
        for k, v in tiles(pdf):
            lo, hi = cuts[k]
            x[lo:hi] = v.reshape(hi - lo, b - a)
        return np.arange(s.rows)[:, None] * s.cols + np.arange(a, b), np.fft.ifft(x, axis=0)

    def between(key, pdf):
        """With a chirp: bins are at hand here. The gain, then the way back as the transform of the conjugate."""
        *head, n, j = key
        s = shape_of(int(n), task)
        k, x = columns_in(s, int(j), pdf)
        inside = k < s.n
        k = np.where(inside, k, 0)
        w = chirp(k, s.n)
        x = np.where(inside, (x * w * gain(k, s.n)).conj() * w, 0)
        return columns_out(head, s, int(j), x)

    def to_time(key, pdf):
        *head, n, j = key
        s = shape_of(int(n), task)
        at, x = columns_in(s, int(j), pdf)
        a, b = strips(s.cols, s.wide)[int(j)]
        if s.chirp:
            inside = at < s.n
            at = np.where(inside, at, 0)
            x = np.where(inside, (x * chirp(at, s.n)).conj() / s.n, 0)
        parts = []
        for q in range(-(-s.n // span(s.n))):
            p = places(*limits(q, s.n), a, b, s.cols)
            parts.append((q, x[p // s.cols, p % s.cols - a]))
        return table(head, s.n, int(j), parts)

    def in_time(key, pdf):
        *head, n, q = key
        s, (lo, hi) = shape_of(int(n), task), limits(int(q), int(n))
        x, cuts = np.zeros(hi - lo, complex), strips(s.cols, s.wide)
        for j, v in tiles(pdf):
            x[places(lo, hi, *cuts[j], s.cols) - lo] = v
        starts = range(0, hi - lo, block)
        return pd.DataFrame({**{k: [v] * len(starts) for k, v in zip(heads, head)},
                             "block_idx": [(lo + a) // block for a in starts],
                             "re": [x[a:a + block].real.copy() for a in starts],
                             "im": [x[a:a + block].imag.copy() for a in starts]}, columns=out.names)

    def step(df: DataFrame, run, schema=tile) -> DataFrame:
        return df.groupBy(*keys, "_n", "_to").applyInPandas(run, schema)

    def filtered(size: DataFrame, chirped: bool) -> DataFrame:
        timed = join_keys(rows, size, keys).withColumn("_to", F.floor(F.col("block_idx") * block / F.col("_span")).cast("long")).drop("_span")
        begun = step(timed, from_time).unionByName(size.select(*keys, "_n").mapInPandas(first, tile))
        back = step(step(begun, to_rows), in_rows)
        if chirped:
            back = step(step(back, between), in_rows)
        return step(step(back, to_time), in_time, out)

    has_chirp = F.udf(lambda n: shape_of(int(n), task).chirp, "boolean")
    spans = F.udf(lambda n: span(int(n)), "long")
    length = cut_lineage(length.withColumn("_chirp", has_chirp("_n")).withColumn("_span", spans("_n")))
    kinds = [r[0] for r in length.select("_chirp").distinct().collect()]
    parts = [filtered(length.where(F.col("_chirp") == k).drop("_chirp"), k) for k in sorted(kinds)]
    if not parts:
        return blocks.sparkSession.createDataFrame([], out)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
