"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, padded to ``CODE_BITS`` dimensions and turned by a random
rotation; the signs are the code. With a vector's length and how well its code
points its way, a query's inner product with it is estimated from the packed bits,
and an error bound around the estimate says which vectors might be among the
nearest. Only those are compared exactly, on the original vectors.

Every vector is indexed; only the centre, a median that far vectors don't move, is fitted, on ``SAMPLE`` vectors (those
with the smallest hashes of their ids). Vectors are dealt to chunks by the hash of
their id, queries to blocks; a task meets one chunk with one block and gives back
the best of each query, so what is merged for a query is k rows for each chunk.
Chunks and blocks grow with the square root of the table, and a chunk of a common
vector is as large as any other.

Defined results: vectors that are null, empty, zero, of another length than most,
or hold null or non-finite components take no part; rows that repeat a vec_id are
one vector (the least); a null vec_id takes no part; ties go to the smaller
vec_id; with fewer candidates than k all are returned; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from burstlake.llm.common import saved

CODE_BITS, SEED, EPSILON, SAMPLE = 256, 1_848, 1.9, 4096
CHUNK, BLOCK = (4096, 262_144), (1024, 65_536)
SLICE = 16_384


def usable(rows: DataFrame) -> DataFrame:
    """One row (vec_id, v) for each vector that takes part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    good = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(fine)
    good = good.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(v).alias("v"))
    return saved(good.select("vec_id", "v", F.size("v").alias("dim")))


class Codes:
    """Rotation and centre, with which vectors become codes and queries are compared with them."""

    def __init__(self, centre: np.ndarray, bits: int = CODE_BITS, epsilon: float = EPSILON) -> None:
        self.centre, self.bits, self.epsilon = centre, max(bits, -(-len(centre) // 8) * 8), epsilon
        q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((self.bits, self.bits)))
        self.rotation = (q * np.sign(np.diag(r)))[:, :len(centre)]

    def turn(self, x: np.ndarray) -> np.ndarray:
        """Centred vectors in the rotated space (what is padded is zero)."""
        return (x - self.centre) @ self.rotation.T

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, distance from the centre, and the cosine of vector and code."""
        t = self.turn(x)
        norm = np.linalg.norm(t, axis=1)
        cos = np.abs(t).sum(axis=1) / (math.sqrt(self.bits) * np.maximum(norm, 1e-300))
        return np.packbits(t > 0, axis=1), norm, np.where(norm > 0, cos, 1.0)

    def bounds(self, codes: np.ndarray, norm: np.ndarray, cos: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of squared distances, a row for each query; where numbers are too large for bounds, NaN or infinite."""
        t = self.turn(q)
        away = np.linalg.norm(t, axis=1, keepdims=True)
        signs = np.unpackbits(codes, axis=1).astype(np.float64) * 2 - 1
        inner = t @ signs.T / math.sqrt(self.bits) * (norm / cos)
        error = away * (norm * np.sqrt(np.maximum(1 - cos**2, 0)) / cos) * (self.epsilon / math.sqrt(max(1, self.bits - 1)))
        square = norm**2 + away**2 - 2 * inner
        slack = 1e-9 * (norm**2 + away**2)  # rounding, also of the centring of vectors far out
        return square - 2 * error - slack, square + 2 * error + slack


@np.errstate(over="ignore", invalid="ignore")
def best(codes: Codes, ids: np.ndarray, x: np.ndarray, code: np.ndarray, norm: np.ndarray, cos: np.ndarray, qid: np.ndarray,
         q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ids and exact distances of its k nearest in this chunk."""
    for i in range(0, len(qid), 64):
        found = [(np.zeros(0, np.int64), np.zeros(0)) for _ in qid[i:i + 64]]
        for j in range(0, len(ids), SLICE):
            part = slice(j, j + SLICE)
            low, high = codes.bounds(code[part], norm[part], cos[part], q[i:i + 64])
            for n, (own_id, own) in enumerate(zip(qid[i:i + 64], q[i:i + 64], strict=True)):
                other = ids[part] != own_id
                near, dist = found[n]
                limit = dist[k - 1] ** 2 * (1 + 1e-9) if len(dist) >= k else np.inf
                if other.sum() > k:
                    limit = min(limit, np.partition(high[n][other], k - 1)[k - 1])
                at = j + np.flatnonzero(other & ~(low[n] > limit))  # what has no bound may be near
                exact = np.sqrt(((x[at].astype(np.float64) - own) ** 2).sum(axis=1))
                near, dist = np.r_[near, ids[at]], np.r_[dist, exact]
                order = np.lexsort((near, dist))[:k]
                found[n] = near[order], dist[order]
        for own_id, (near, dist) in zip(qid[i:i + 64], found, strict=True):
            yield int(own_id), near, dist


def _matrix(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _parts(count: int, limits: tuple[int, int]) -> int:
    return max(1, -(-count // min(limits[1], max(limits[0], int(32 * math.sqrt(count))))))


def search(rows: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each vector whose id is divisible by ``every``."""
    spark = rows.sparkSession
    found = usable(rows)
    sizes = found.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, count = sizes[0] if sizes else (1, 0)
    found = found.where(F.col("dim") == dim)
    sample = found.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    codes = Codes(np.median([r["v"] for r in sample], axis=0) if sample else np.zeros(dim))
    asked = found.where(F.col("vec_id") % every == 0)
    chunks, blocks = _parts(count, CHUNK), _parts(asked.count(), BLOCK)

    def index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                code, norm, cos = codes.encode(_matrix(b.column(1), np.float64))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm.astype(np.float64)),
                     pa.array(cos.astype(np.float64))], names=["vec_id", "v", "code", "norm", "cos"])

    value = found.schema["v"].dataType.simpleString()
    coded = found.select("vec_id", "v").mapInArrow(index, f"vec_id long, v {value}, code binary, norm double, cos double")

    def numbers(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int")
    left = coded.withColumn("chunk", chunk).withColumn("block", numbers(blocks))
    right = asked.select("vec_id", "v", block.alias("block")).withColumn("chunk", numbers(chunks))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.float64()]
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        code = np.frombuffer(b"".join(a["code"].to_pylist()), np.uint8).reshape(a.num_rows, -1)
        near = list(best(codes, a["vec_id"].to_numpy(), _matrix(a["v"], np.float64), code, a["norm"].to_numpy(), a["cos"].to_numpy(),
                         b["vec_id"].to_numpy(), _matrix(b["v"], np.float64), k))
        return pa.table([pa.array(np.repeat([q for q, *_ in near], [len(i) for _, i, _ in near]), kinds[0]),
                         pa.array(np.concatenate([i for _, i, _ in near]), kinds[1]),
                         pa.array(np.concatenate([d for *_, d in near]), kinds[2])], names=names)

    pairs = (left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block"))
             .applyInArrow(meet, "query_id long, vec_id long, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
