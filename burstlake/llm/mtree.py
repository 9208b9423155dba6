"""Exact top-k inner products by best-first search of an M-tree.

Components are floor(256 x), so scores are integers. The tree stands in a metric
space: with M the largest length in a group, a vector x gets one more coordinate,
sqrt(M^2 - |x|^2), a query gets zero there, and then d(q, x)^2 = |q|^2 + M^2 - 2 <q, x>:
the nearest are those of the highest scores.

The root's entries are groups, one for each of at most ``PIVOTS`` routing vectors
(those with the smallest hashes, a bounded sample; every vector is indexed). They
are few enough to be sent to all tasks. Vectors go to the nearest routing vector;
a group of over 2 * ``GROUP`` of them is dealt to several subtrees. A subtree is a
table of pages: a page's entries hold a vector, its covering radius, its distance to
the page's own routing vector, and the page below or, in a leaf, ids.

A query first searches the group that may hold its nearest, then, with the score of
its k-th best as a bound, each group whose ball reaches that far. In a subtree pages
are opened in the order of the least distance below them. An entry whose stored
distance to its parent shows by the triangle inequality that it is too far is
passed over without a computation. Bounds are in double precision with a slack
that covers their rounding; what they let through is scored in integers.

Equal vectors are one entry with their k + 1 smallest ids, more of which no result
can name, so a vector that a third of all rows hold costs as much as any other. A
task holds one subtree and ``BLOCK`` queries.

Defined results: vectors that are null, empty, of another length than most, or hold
null or non-finite components take no part, nor does a null vec_id; zero vectors do;
rows that repeat a vec_id are one vector (the least); components beyond 2^56 are
taken as 2^56; scores beyond a long are ordered exactly and returned as the largest or smallest
long; with fewer candidates than k all are returned; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstlake.llm.common import saved

SCALE, SEED = 256, 7
PIVOTS, GROUP, BLOCK = 4096, 16_384, 16_384
PAGE = 256
#: Ways that equal vectors are dealt before their ids are brought together.
SALTS = 16
#: Relative slack of a squared distance.
SLACK = 1e-12
_LIMIT = float(1 << 56)


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as longs."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.lit(-_LIMIT), F.least(F.lit(_LIMIT), c.cast("double") * scale))).cast("long"))


def usable(rows: DataFrame) -> DataFrame:
    """One row (vec_id, x) for each vector that takes part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    good = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(fine)
    good = good.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(v).alias("v"))
    return saved(good.select("vec_id", scaled(F.col("v")).alias("x"), F.size("v").alias("dim")))


def distinct_vectors(found: DataFrame, k: int) -> DataFrame:
    """(x, ids): each vector once, with its k + 1 smallest ids."""
    salted = found.select("vec_id", "x", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt"))
    for keys in (["x", "salt"], ["x"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
        salted = salted.withColumn("rank", rank).where(F.col("rank") <= k + 1).drop("rank")
    return salted.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _small(*xs: np.ndarray) -> bool:
    """Whether doubles hold the inner products exactly."""
    most = [max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0 for x in xs]
    return xs[0].shape[1] * most[0] * most[-1] < 1 << 53


def lengths(x: np.ndarray) -> np.ndarray:
    """Squared lengths, in double precision."""
    return np.einsum("ij,ij->i", x, x)


def nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest routing vector of each row and the squared distance to it."""
    own, theirs = lengths(x), lengths(pivots)
    at = np.empty(len(x), np.int64)
    for i in range(0, len(x), 4096):
        at[i:i + 4096] = (theirs - 2 * (x[i:i + 4096] @ pivots.T)).argmin(axis=1)
    return at, np.maximum(own + theirs[at] - 2 * np.einsum("ij,ij->i", x, pivots[at]), 0)


class Root:
    """Routing vectors with the covering radius and largest length of their groups."""

    def __init__(self, pivots: np.ndarray, parts: np.ndarray, top: np.ndarray, radius: np.ndarray) -> None:
        self.pivots, self.parts, self.top, self.radius = pivots, parts, top, radius

    def least(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least squared distance of each query to what a group holds, and |q|^2 + M^2 (a row for each query)."""
        span = lengths(q)[:, None] + self.top
        d = np.sqrt(np.maximum(span - 2 * (q @ self.pivots.T), 0))
        low = np.maximum(d - self.radius - 4 * np.sqrt(SLACK * span), 0)
        return np.where(self.parts > 0, low**2, np.inf), span


# -- pages ---------------------------------------------------------------------

_PAGES = pa.schema([("page", pa.int32()), ("leaf", pa.bool_()), ("x", pa.list_(pa.int64())), ("radius", pa.list_(pa.float64())),
                    ("to_parent", pa.list_(pa.float64())), ("child", pa.list_(pa.int32())), ("ids", pa.list_(pa.list_(pa.int64())))])


def _split(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, list[np.ndarray]]:
    """Routing rows of pages and the rows in each page: those nearest to it, at most ``PAGE``."""
    want = -(-2 * len(x) // PAGE)
    seeds = np.sort(rng.choice(len(x), min(want, len(x)), replace=False))
    at, far = nearest_pivot(x, x[seeds])
    order = np.lexsort((far, at))
    heads, pages = [], []
    for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
        for i in range(0, len(own), PAGE):
            heads.append(seeds[at[own[0]]])
            pages.append(own[i:i + PAGE])
    return np.array(heads), pages


def build(x: np.ndarray, ids: list[list[int]]) -> list[dict]:
    """Pages of a subtree, from the leaves up; the last is its top page."""
    rng = np.random.default_rng(SEED)
    wide = np.c_[x.astype(np.float64), np.zeros(len(x))]
    square = lengths(wide)
    wide[:, -1] = np.sqrt(np.maximum(square.max() - square, 0))
    rows, radius, below, out = np.arange(len(x)), np.zeros(len(x)), np.full(len(x), -1), []
    leaf = True
    while True:
        heads, pages = (rows[:1], [np.arange(len(rows))]) if len(rows) <= PAGE else _split(wide[rows], rng)
        heads = rows[heads] if len(rows) > PAGE else heads
        up = []
        for head, own in zip(heads, pages, strict=True):
            gap = np.sqrt(lengths(wide[rows[own]] - wide[head]))
            out.append({"page": len(out), "leaf": leaf, "x": x[rows[own]].ravel().tolist(), "radius": radius[own].tolist(),
                        "to_parent": gap.tolist(), "child": below[own].tolist(), "ids": [ids[i] for i in rows[own]] if leaf else []})
            up.append((head, (gap + radius[own]).max(), len(out) - 1))
        if len(pages) == 1:
            return out
        rows, radius, below = (np.array(v) for v in zip(*up, strict=True))
        leaf = False


class Subtree:
    """The pages of one subtree, searched query by query."""

    def __init__(self, pages: pa.Table, dim: int) -> None:
        order = np.argsort(pages["page"].to_numpy())
        column = {c: [pages[c][int(i)] for i in order] for c in ("leaf", "x", "radius", "to_parent", "child", "ids")}
        self.leaf = [v.as_py() for v in column["leaf"]]
        self.whole = [v.values.to_numpy().reshape(-1, dim) for v in column["x"]]
        self.x = [v.astype(np.float64) for v in self.whole]
        self.radius, self.to_parent, self.child = ([v.values.to_numpy() for v in column[c]] for c in ("radius", "to_parent", "child"))
        self.ids = [v.as_py() for v in column["ids"]]
        self.top = max(lengths(x).max() for x, leaf in zip(self.x, self.leaf, strict=True) if leaf)
        self.exact = [_small(x) for x in self.whole]
        self.computed = self.avoided = 0

    def _scores(self, page: int, rows: np.ndarray, q: np.ndarray, whole: np.ndarray, small: bool) -> list[int] | np.ndarray:
        if small and self.exact[page]:
            return self.x[page][rows] @ q
        return [sum(map(int.__mul__, v, whole.tolist())) for v in self.whole[page][rows].tolist()]

    def search(self, own: int, whole: np.ndarray, k: int, bound: int | None) -> list[tuple[int, int]]:
        """The k best (-score, vec_id) that score at least ``bound``, without the query's own id."""
        q = whole.astype(np.float64)
        span = float(q @ q) + self.top
        slack = 4 * math.sqrt(SLACK * span)
        small = _small(whole[None, :]) and all(self.exact)
        best: list[tuple[int, int]] = []
        limit = bound
        reach = math.inf if limit is None else math.sqrt(max(span - 2 * limit, 0)) + slack
        heap = [(0.0, len(self.leaf) - 1, -1.0)]
        while heap:
            least, page, parent = heapq.heappop(heap)
            if least > reach:
                break
            rows = np.arange(len(self.radius[page]))
            if parent >= 0:  # stored distances first
                rows = rows[np.abs(parent - self.to_parent[page]) - self.radius[page] - slack <= reach]
            self.computed, self.avoided = self.computed + len(rows), self.avoided + len(self.radius[page]) - len(rows)
            if not len(rows):
                continue
            if not self.leaf[page]:
                d = np.sqrt(np.maximum(span - 2 * (self.x[page][rows] @ q), 0))
                low = np.maximum(d - self.radius[page][rows] - slack, 0)
                for i in np.flatnonzero(low <= reach).tolist():
                    heapq.heappush(heap, (float(low[i]), int(self.child[page][rows[i]]), float(d[i])))
                continue
            scores = self._scores(page, rows, q, whole, small)
            take = range(len(rows)) if limit is None or not isinstance(scores, np.ndarray) else np.flatnonzero(scores >= limit).tolist()
            for i in take:
                score = int(scores[i])
                if limit is None or score >= limit:
                    best += [(-score, v) for v in self.ids[page][rows[i]] if v != own]
            best = sorted(best)[:k]
            if len(best) == k and (limit is None or -best[-1][0] > limit):
                limit = -best[-1][0]
                reach = math.sqrt(max(span - 2 * limit, 0)) + slack
        return best


# -- the search over all groups ------------------------------------------------

def index(vectors: DataFrame, dim: int, pivots: np.ndarray) -> tuple[DataFrame, Root]:
    """Pages (grp, part, ..) of all groups, and the root."""
    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                x = _matrix(b.column(0)).astype(np.float64)
                at, far = nearest_pivot(x, pivots)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at), pa.array(far), pa.array(lengths(x))],
                                                 names=["x", "ids", "grp", "far", "square"])

    placed = saved(vectors.mapInArrow(assign, "x array<bigint>, ids array<bigint>, grp long, far double, square double"))
    sizes = placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("top"))
    own = np.zeros((3, len(pivots)))
    for r in sizes.collect():  # a row for each routing vector
        own[:, r["grp"]] = -(-r["n"] // (2 * GROUP)), r["top"], 0
    square = lengths(pivots)
    own[1] = np.maximum(own[1], square)
    spark = vectors.sparkSession
    facts = spark.createDataFrame([(i, int(own[0, i]), float(own[1, i]), float(square[i])) for i in range(len(pivots))],
                                  "grp long, parts long, top double, pivot double")
    placed = placed.join(F.broadcast(facts), "grp")
    last = lambda s: F.sqrt(F.greatest(F.col("top") - F.col(s), F.lit(0.0)))
    for r in placed.groupBy("grp").agg(F.max(F.sqrt(F.col("far") + (last("square") - last("pivot")) ** 2)).alias("r")).collect():
        own[2, r["grp"]] = r["r"]
    slack = 4 * np.sqrt(SLACK * (own[1] + square))

    def pages(t: pa.Table) -> pa.Table:
        made = pa.Table.from_pylist(build(_matrix(t["x"]), t["ids"].to_pylist()), schema=_PAGES)
        for i, c in enumerate(("grp", "part")):
            made = made.add_column(i, c, pa.array([t[c][0].as_py()] * made.num_rows, pa.int64()))
        return made

    dealt = placed.select("x", "ids", "grp", F.pmod(F.xxhash64("x"), F.col("parts")).alias("part"))
    tree = dealt.groupBy("grp", "part").applyInArrow(
        pages, "grp long, part long, page int, leaf boolean, x array<bigint>, radius array<double>, to_parent array<double>, child array<int>, ids array<array<bigint>>")
    return saved(tree), Root(pivots, own[0], own[1], own[2] + slack)


def _visit(tree: DataFrame, asked: DataFrame, root: Root, dim: int, k: int, count: int) -> DataFrame:
    """(query_id, vec_id, exact score as text) of the queries (query_id, q, bound, grp) in the groups they name."""
    blocks = max(1, -(-count // BLOCK))
    parts = root.parts.astype(np.int64).tolist()

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n = [parts[g] for g in b.column(3).to_pylist()]
            rows = np.repeat(np.arange(b.num_rows), n)
            part = np.concatenate([np.arange(i) for i in n]) if n else np.zeros(0)
            out = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(part.astype(np.int64))], names=["query_id", "q", "bound", "grp", "part"])

    left = tree.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = (asked.mapInArrow(deal, "query_id long, q array<bigint>, bound string, grp long, part long")
             .withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if a.num_rows and b.num_rows:
            subtree = Subtree(a, dim)
            for own, q, bound in zip(b["query_id"].to_pylist(), _matrix(b["q"]), b["bound"].to_pylist(), strict=True):
                for score, v in subtree.search(own, q, k, None if bound is None else int(bound)):
                    for column, value in zip(out, (own, v, str(-score)), strict=True):
                        column.append(value)
        return pa.table([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["query_id", "vec_id", "score"])

    return (left.groupBy("grp", "part", "block").cogroup(right.groupBy("grp", "part", "block"))
            .applyInArrow(meet, "query_id long, vec_id long, score string"))


def search(rows: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each vector whose id is divisible by ``every``."""
    found = usable(rows)
    sizes = found.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim = sizes[0]["dim"] if sizes else 1
    found = found.where(F.col("dim") == dim)
    vectors = saved(distinct_vectors(found, k))
    count = vectors.count()
    sample = vectors.orderBy(F.xxhash64("x"), "x").limit(min(PIVOTS, -(-count // GROUP))).select("x").collect()
    asked = found.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"))
    if not sample:
        return asked.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.col("query_id").alias("score")).limit(0)
    tree, root = index(vectors, dim, np.array([r["x"] for r in sample], np.float64))
    queries = asked.count()
    kind = "query_id long, q array<bigint>, bound string, grp long"

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                q = _matrix(b.column(1)).astype(np.float64)
                low, span = root.least(q)
                at = (np.where(np.isfinite(low), span, np.inf) - np.where(np.isfinite(low), 2 * (q @ root.pivots.T), 0)).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.nulls(b.num_rows, pa.string()), pa.array(at)],
                                                 names=["query_id", "q", "bound", "grp"])

    def others(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            q = _matrix(b.column(1)).astype(np.float64)
            low, span = root.least(q)
            bound = np.array([-np.inf if v is None else float(int(v)) for v in b.column(2).to_pylist()])[:, None]
            near = low <= span - 2 * bound + 8 * SLACK * span
            near[np.arange(b.num_rows), b.column(3).to_numpy()] = False
            i, g = np.nonzero(near & np.isfinite(low))
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(i)).columns[:3], pa.array(g)], names=["query_id", "q", "bound", "grp"])

    at_home = saved(asked.select("query_id", "q").mapInArrow(first, kind))
    home = saved(_visit(tree, at_home, root, dim, k, queries))
    exact = F.col("score").cast("decimal(38,0)")  # wide enough for 2^56 * 2^56 * 10,000
    order = Window.partitionBy("query_id").orderBy(F.desc(exact), "vec_id")
    known = home.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    more = at_home.drop("bound").join(known, "query_id", "left").select("query_id", "q", "bound", "grp").mapInArrow(others, kind)
    both = home.unionByName(_visit(tree, more, root, dim, k, queries))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    score = F.greatest(-most - 1, F.least(most, exact)).cast("long").alias("score")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)
