"""SimHash near-duplicates by a Gray-order hierarchical index.

A text's fingerprint has the bits that more than half of its shingle hashes have.
Fingerprints that differ in at most ``radius`` bits are linked.

The index: distinct fingerprints are sorted by Gray rank, neighbours form leaves,
and nodes form upper nodes. A node holds the bits that everything below it shares
(a mask and a pattern); what its parent holds already is left out. Two nodes are
compared by adding, level by level, the differences in the bits that are new at
that level; where the sum exceeds the radius, no fingerprint below one is linked
to any below the other, and the whole pair of groups is pruned. A pair is pruned
as well where everything below both is linked already.

To share the work out, the top of the index is dealt by blocks of bits. 64 bits
are cut into ``radius + k`` blocks; linked fingerprints agree on at least k of
them. For each choice of k blocks, fingerprints with equal bits there meet in one
bucket, which is a tree. k grows with the logarithm of the number of
fingerprints, so that buckets stay small; the links are the same for every k.
A bucket gives back a spanning tree of its links, not its pairs.

Copies are one fingerprint before anything is compared, so a large group of
copies costs as much as a single document. All of this holds fingerprints, never
texts; a task holds the largest of its buckets or ``CHUNK`` fingerprints.

``drop_near_duplicates`` wants groups of a stated similarity. Groups of near fingerprints
come first, each member checked against its group's first on whole shingle sets. Five-word
sets that are 0.8 alike can have fingerprints some 10 bits apart, too far for any index by
blocks. What the index can't reach comes from an exact rule: with all shingles in one order,
two sets of that similarity share one of the first |x| - ceil(0.8 |x|) + 1. The order is
by how many documents have a shingle, rarest first, so what many texts share (a passage, a
line) is no candidate unless it is most of the text. Frequencies need not be
exact, as any order that all texts use gives the same pairs: all documents' shingles are counted
in ``SKETCH`` counters, a bounded table that every task gets. What first shingles two texts
have in common is found by ranges of the hashes. A bucket of up to ``SMALL`` texts gives its
pairs there; larger ones go in rounds that compare few members with the others and leave out
what is linked already.

Whole sets are 8 bytes a word, so few candidates get that far. Each text has a bitmap of 2 to 4
bits a shingle: a bit is the parity of the shingles that fall on it. Two bitmaps differ in no
more bits than the sets differ in shingles, so a pair whose bitmaps differ in more than its
sets may is not similar. What remains is checked on the whole sets, which are moved once:
from the text to the task that compares them with the pair's other side. No pair is lost.

Defined results: null and wordless texts have fingerprint zero; with fewer words
than a shingle has, the whole sequence is the shingle; rows with a null doc_id
take part but are not the smallest; repeated rows have equal results; an empty
table gives an empty result; further columns are ignored by ``near_duplicates``
and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.llm.common import free_name, saved
from burstlake.llm.graph import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints that a task indexes at a time, and pairs that it compares at a time.
CHUNK, PAIRS = 200_000, 1 << 16
FANOUT = 8
#: Similarity groups: words of a shingle, least Jaccard similarity.
WORDS, SIMILARITY = 5, 0.8
#: Counters of shingles and the slices that they are added up in; text of a slice.
SKETCH, PARTS, SLICE_BYTES = 1 << 20, 64, 1_000_000
#: First shingles that a task brings together, ways they are dealt at least, and times the mean count from which one needs no partner to stay.
MATCHED, LEAST_RANGES, HOT = 2_000_000, 16, 16
#: Texts of a bucket that give all pairs at once; bits of a bitmap at most; bytes of a key (a longer hash is cut, which only adds candidates).
SMALL, BITS, KEY_BYTES = 8, 1 << 17, 5
#: Ids that may be broadcast; pairs of one text that a task compares.
FEW, DEAL = 200_000, 1_000
#: How many times more members of a bucket meet the others in each further round.
GROWTH = 64


# -- fingerprints ------------------------------------------------------------

def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> tuple[np.ndarray, bytes]:
    """Hashes of a text's shingles, repeats included, and its words; only A to Z are put in lower case."""
    words = (text or "").encode().lower().split()
    whole = b" ".join(words)
    if not words:
        return np.empty(0, np.uint64), whole
    starts = [0, *itertools.accumulate(len(w) + 1 for w in words)]
    ends = starts[shingle:] or starts[-1:]
    return np.fromiter((xxhash.xxh64_intdigest(whole[a:b - 1], SEED) for a, b in zip(starts, ends)), np.uint64), whole


def majority(hashes: np.ndarray) -> int:
    """The bits that are 1 in over half of the hashes, unsigned; zero for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text."""
    return majority(shingle_hashes(text, shingle)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, th, fp): ``th`` is a hash of the text that tells apart rows with equal ids; ``fp`` is signed."""
    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "th", "fp"])

    return (docs.select(F.col("doc_id").cast("long"), text_hash().alias("th"), "text")
            .mapInArrow(each, "doc_id long, th long, fp long"))


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


# -- the index ---------------------------------------------------------------

def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray code: the running exclusive or of its bits."""
    out = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class Index:
    """Trees over the fingerprints of many buckets at once; no node spans two buckets."""

    def __init__(self, bucket: np.ndarray, fp: np.ndarray, radius: int) -> None:
        order = np.lexsort((gray_rank(fp), bucket))
        self.bucket, self.fp, self.radius = bucket[order], fp[order], radius
        self.root = np.arange(len(fp))  # smallest index that is linked
        ones, ends, tops = self.fp, np.arange(len(fp) + 1), self.bucket
        low, high = self.fp, self.fp
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # mask, pattern, first child of each node
        while len(ones) and (not self.levels or (tops[1:] == tops[:-1]).any()):
            new = np.r_[True, tops[1:] != tops[:-1]]
            run = np.arange(len(tops)) - np.maximum.accumulate(np.where(new, np.arange(len(tops)), 0))
            first = np.flatnonzero(run % FANOUT == 0)
            low, high = np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first)
            mask = ~(low ^ high)
            self.levels.append((mask, low & mask, np.append(first, len(tops))))
            tops, ones = tops[first], first
        self._uniform()

    def _uniform(self) -> None:
        """For each node the root of all below it, or -1 where they have several."""
        self.same: list[np.ndarray] = []
        least = most = self.root
        for *_, first in self.levels:
            least, most = np.minimum.reduceat(least, first[:-1]), np.maximum.reduceat(most, first[:-1])
            self.same.append(np.where(least == most, least, -1))

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        root = self.root
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
        self.root = root

    def _near(self, i: np.ndarray, j: np.ndarray) -> None:
        near = np.bitwise_count(self.fp[i] ^ self.fp[j]) <= self.radius
        if near.any():
            self._link(i[near], j[near])

    def search(self) -> None:
        """Link all fingerprints of a bucket that are near each other, directly or through others."""
        n = len(self.fp)
        for step in range(1, FANOUT + 1):  # neighbours in Gray order first: they join most groups
            i = np.flatnonzero(self.bucket[step:] == self.bucket[:-step])
            self._near(i, i + step)
        if not n:
            return
        self._uniform()
        top = len(self.levels) - 1
        nodes = np.arange(len(self.levels[top][0]))
        todo = [(top, nodes, nodes, np.zeros(len(nodes), np.uint8))]
        while todo:
            level, a, b, far = todo.pop()
            if len(a) > PAIRS:
                todo += [(level, a[k:k + PAIRS], b[k:k + PAIRS], far[k:k + PAIRS]) for k in range(0, len(a), PAIRS)]
                continue
            joined = (self.same[level][a] == self.same[level][b]) & (self.same[level][a] >= 0)
            a, b, far = a[~joined], b[~joined], far[~joined]
            if not len(a):
                continue
            mask, pattern, first = self.levels[level]
            i, j, pair = self._children(first, a, b)
            if level == 0:
                before = self.root
                self._near(i, j)
                if self.root is not before:
                    self._uniform()
                continue
            below, shapes, _ = self.levels[level - 1]
            new = below[i] & below[j] & ~(mask[a] & mask[b])[pair]
            sums = far[pair] + np.bitwise_count((shapes[i] ^ shapes[j]) & new)
            keep = sums <= self.radius
            todo.append((level - 1, i[keep], j[keep], sums[keep]))

    @staticmethod
    def _children(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of a child of a and a child of b, each pair once, and which pair of nodes it belongs to."""
        na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
        pair = np.repeat(np.arange(len(a)), na * nb)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
        i, j = first[a][pair] + k // nb[pair], first[b][pair] + k % nb[pair]
        once = (a != b)[pair] | (i <= j)
        return i[once], j[once], pair[once]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest: each linked fingerprint and its root."""
        i = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.fp[i], self.fp[self.root[i]]


def block_masks(count: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of all choices of k out of radius + k blocks, for as small a k as gives small buckets."""
    need = max(1.0, math.log2(max(count, 2)) - 8)
    k = next((k for k in range(1, 65 - radius) if 64 * k / (radius + k) >= need), 64 - radius)
    edges = [round(64 * i / (radius + k)) for i in range(radius + k + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(blocks, k)]


def near_links(fps: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect what is near; ``count`` of them sets the blocks."""
    signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(count, radius)]
    dealt = fps.select("fp", F.explode(F.array(*(
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(signed)))).alias("at"))
    dealt = dealt.select("fp", "at.t", "at.k").repartition("t", "k").sortWithinPartitions("t", "k")

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(fp: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
            index = Index(bucket, fp, radius)
            index.search()
            a, b = index.links()
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def take() -> tuple[np.ndarray, np.ndarray]:
            fp, t, k = (np.concatenate(x) for x in zip(*held))
            return fp, np.r_[0, np.cumsum((t[1:] != t[:-1]) | (k[1:] != k[:-1]))]

        for b in it:
            if not b.num_rows:
                continue
            held.append((b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy()))
            size += b.num_rows
            if size >= CHUNK:
                fp, bucket = take()
                whole = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
                if whole:
                    yield done(fp[:whole], bucket[:whole])
                    t, k = (np.concatenate(x) for x in list(zip(*held))[1:])
                    held = [(fp[whole:], t[whole:], k[whole:])]
                    size = len(fp) - whole
        if held:
            yield done(*take())

    return dealt.mapInArrow(search, "a long, b long")


def grouped(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root) of the distinct fingerprints of ``rows``, each root standing for a group."""
    distinct = rows.select("fp").distinct()
    found = components(near_links(distinct, distinct.count(), radius))
    return distinct.join(found, distinct.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of (doc_id, text)."""
    rows = saved(fingerprints(docs))
    roots = grouped(rows)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("doc")).join(roots, "fp")
    ids = least.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = least.join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- groups of a similarity ---------------------------------------------------

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(h: np.ndarray) -> np.ndarray:
    for m in _MIX:
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


def word_shingles(texts: list[str | None], shingle: int) -> tuple[list[np.ndarray], list[int]]:
    """Shingle hashes of each text, repeats included, and a hash of its words; each distinct word is hashed once."""
    words = [(t or "").encode().lower().split() for t in texts]
    ends = np.cumsum([len(w) for w in words])
    flat = pa.array(list(itertools.chain.from_iterable(words)), pa.large_binary()).dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
    ids = known[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    full = np.zeros(max(len(ids) - shingle + 1, 0), np.uint64)
    for k in range(shingle):
        full = full * _BASE + ids[k:k + len(full)]
    full = _mixed(full)
    out = []
    for a, b in zip([0, *ends.tolist()], ends.tolist()):
        if b - a >= shingle:
            out.append(full[a:b - shingle + 1])
        else:
            h = np.zeros(min(b - a, 1), np.uint64)
            for w in ids[a:b]:
                h = h * _BASE + w
            out.append(_mixed(h))
    return out, [xxhash.xxh3_64_intdigest(b" ".join(w)) for w in words]


def _text_slices(b: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE_BYTES, "right")))
        yield b.slice(i, j - i)
        i = j


def bitmap(shingles: np.ndarray) -> bytes:
    """Parities of the distinct shingles that fall on each of 2 to 4 times as many bits."""
    bits = min(BITS, max(64, 2 << max(len(shingles) - 1, 0).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """Shingles in which two sets differ at least, by the bytes of their bitmaps; the longer one is folded."""
    if len(x) < len(y):
        x, y = y, x
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0) ^ y).sum())


_DESCRIBED = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("node", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()),
                        ("bits", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])


def described(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, th, node, fp, n, bits) of each document, where ``node`` is a hash of the words, equal for copies, and n and
    ``bits`` are its set's size and bitmap; and for each task its counters of shingles, by parts. A task counts copies once."""
    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(values: dict, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([values[f.name] if f.name in values else pa.nulls(n, f.type) for f in _DESCRIBED], schema=_DESCRIBED)

        table, known = np.zeros(SKETCH, np.int64), set()
        for whole in it:
            for b in _text_slices(whole, 2):
                hashes, nodes = word_shingles(b.column(2).to_pylist(), shingle)
                new = []
                sets = [np.unique(h) for h in hashes]
                for node, own in zip(nodes, sets, strict=True):
                    if node not in known:
                        known.add(node)
                        new.append(own)
                table += np.bincount(slots(np.concatenate(new)), minlength=SKETCH) if new else 0
                fps = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
                yield row({"doc_id": b.column(0), "th": b.column(1), "node": pa.array(np.array(nodes, np.uint64).view(np.int64)),
                           "fp": pa.array(fps), "n": pa.array([len(x) for x in sets], pa.int64()),
                           "bits": pa.array([bitmap(x) for x in sets], pa.binary())}, b.num_rows)
        if known:
            parts = np.minimum(table, (1 << 32) - 1).astype("<u4").reshape(PARTS, -1)
            yield row({"part": pa.array(range(PARTS), pa.int32()), "counts": pa.array([v.tobytes() for v in parts], pa.binary())}, PARTS)

    return (docs.select(F.col("doc_id").cast("long"), text_hash().alias("th"), "text")
            .mapInArrow(each, "doc_id long, th long, node long, fp long, n long, bits binary, part int, counts binary"))


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)


def sketch(rows: DataFrame) -> np.ndarray:
    """The sums of all tasks' counters."""
    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH // PARTS, np.int64)
        for v in t["counts"]:
            total += np.frombuffer(v.as_buffer(), "<u4")
        return pa.table([pa.array([t["part"][0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])

    out = np.zeros((PARTS, SKETCH // PARTS), np.int64)
    for r in rows.where("part is not null").select("part", "counts").groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        out[r["part"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel()


def may_share(n, at, other_n, other_at, similarity: float, least):
    """Whether two texts may be similar if a shingle at these places is the first that both have: only what comes after it can be shared."""
    return least(n - at, other_n - other_at) * (1 + similarity) >= similarity * (n + other_n) - 1e-6


def prefixes(docs: DataFrame, counts: np.ndarray, shingle: int, similarity: float) -> DataFrame:
    """Nodes that meet in one of their first shingles, rarest first: the pairs (a, b) of buckets of up to ``SMALL`` nodes that
    may be similar, and the members (key, node, n, at) of larger ones; n is a set's size and ``at`` the shingle's place
    in that order, which is the same for all nodes.

    A shingle whose counter is far above the mean is taken as shared and dealt by node, so that it is in no single task.
    """
    total = int(counts.sum())
    ranges = max(LEAST_RANGES, -(-int(total * (1 - similarity)) // MATCHED))
    hot = HOT * max(1.0, total / SKETCH)
    counts = np.minimum(counts, (1 << 32) - 1).astype(np.uint32)
    small, cut = SMALL, np.uint64(64 - 8 * KEY_BYTES)

    def rare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        for whole in it:
            keys, nodes, sizes, places = [], [], [], []
            for b in _text_slices(whole, 0):
                for h, node in zip(*word_shingles(b.column(0).to_pylist(), shingle), strict=True):
                    if node in known:
                        continue
                    known.add(node)
                    h = np.unique(h)
                    first = h[np.lexsort((h, counts[slots(h)]))[:len(h) - math.ceil(similarity * len(h) - 1e-9) + 1]]
                    keys.append(first)
                    nodes.append(np.full(len(first), node, np.uint64))
                    sizes.append(np.full(len(first), len(h), np.uint32))
                    places.append(np.arange(len(first), dtype=np.uint32))
            if not keys or not sum(map(len, keys)):
                continue
            key, node, size, place = (np.concatenate(x) for x in (keys, nodes, sizes, places))
            part = np.where(counts[slots(key)] > hot, ranges + (node % np.uint64(ranges)).astype(np.int64),
                            (key >> np.uint64(32)).astype(np.int64) * ranges >> 32)
            order = np.argsort(part, kind="stable")
            part, key, node, size, place = part[order], key[order] >> cut, node[order], size[order], place[order]
            short = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]
            place = place.astype("<u2" if int(place.max()) < 1 << 16 else "<u4")
            # a node is written once for all its shingles of a part
            run = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (node[1:] != node[:-1])])
            length = np.diff(np.append(run, len(part))).astype("<u4")
            node, size, of = node[run], size[run], part[run]
            mine = np.unique(of)
            at, runs = (np.append(np.searchsorted(x, mine), len(x)).tolist() for x in (part, of))
            rows = range(len(mine))
            yield pa.RecordBatch.from_arrays(
                [pa.array(mine, pa.int64()), *(pa.array([v[e[p]:e[p + 1]].tobytes() for p in rows], pa.binary()) for v, e in (
                    (short, at), (place, at), (node, runs), (size, runs), (length, runs)))], names=["part", "key", "at", "node", "n", "length"])

    def unpacked(t: pa.Table) -> tuple[np.ndarray, ...]:
        out = []
        for r in t.select(["key", "at", "node", "n", "length"]).to_pylist():
            length = np.frombuffer(r["length"], "<u4")
            short = np.frombuffer(r["key"], np.uint8).reshape(-1, KEY_BYTES)
            key = np.zeros((len(short), 8), np.uint8)
            key[:, :KEY_BYTES] = short
            place = np.frombuffer(r["at"], "<u2" if len(r["at"]) == 2 * len(short) else "<u4")
            out.append((key.view("<u8").ravel(), np.repeat(np.frombuffer(r["node"], "<u8"), length).view(np.int64),
                        np.repeat(np.frombuffer(r["n"], "<u4"), length).astype(np.int64), place.astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def match(t: pa.Table) -> pa.Table:
        columns = key, node, n, at = unpacked(t)
        order = np.lexsort((at, node, key))
        key, node, n, at = (x[order] for x in columns)
        once = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node, n, at = key[once], node[once], n[once], at[once]
        pairs = np.zeros((0, 2), np.int64)
        if t["part"][0].as_py() < ranges:
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            members = np.diff(np.append(first, len(key)))
            many = np.repeat(members > small, members)
            found = [pairs]
            for step in range(1, small):
                i = np.flatnonzero((key[step:] == key[:-step]) & ~many[step:])
                i = i[may_share(n[i], at[i], n[i + step], at[i + step], similarity, np.minimum)]
                found.append(np.stack([node[i], node[i + step]], axis=1))
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            key, node, n, at = key[many], node[many], n[many], at[many]
        none = [pa.nulls(len(pairs), pa.int64())]
        return pa.table([pa.chunked_array([pa.array(x.view(np.int64)), *none]) for x in (key, node, n, at)]
                        + [pa.chunked_array([pa.nulls(len(key), pa.int64()), pa.array(np.ascontiguousarray(pairs[:, c]))]) for c in (0, 1)],
                        names=["key", "node", "n", "at", "a", "b"])

    return (docs.select("text").mapInArrow(rare, "part long, key binary, at binary, node binary, n binary, length binary")
            .groupBy("part").applyInArrow(match, "key long, node long, n long, at long, a long, b long"))


def plausible_pairs(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) that the bitmaps of (node, n, bits) do not rule out."""
    most = (1 - similarity) / (1 + similarity)

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sizes = b.column(2).to_numpy() + b.column(3).to_numpy()
            apart = np.array([least_difference(*(np.frombuffer(v.as_buffer(), np.uint8) for v in xy)) for xy in zip(b.column(4), b.column(5))], np.int64)
            yield b.select(["a", "b"]).filter(pa.array(apart <= most * sizes + 1e-6))

    both = (pairs.select("a", "b").join(nodes.select(F.col("node").alias("a"), F.col("n").alias("x_n"), F.col("bits").alias("x")), "a")
            .join(nodes.select(F.col("node").alias("b"), F.col("n").alias("y_n"), F.col("bits").alias("y")), "b"))
    return both.select("a", "b", "x_n", "y_n", "x", "y").mapInArrow(each, "a long, b long")


def similar_pairs(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The distinct ``pairs`` (a, b) whose shingle sets have that Jaccard similarity; an ``a`` of many pairs is dealt by b.

    A text's set goes from its row to each ``a`` that it meets, sorted so that the set of ``a`` comes first. Ids are
    broadcast up to ``FEW`` of them, else joined by a shuffle.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(DEAL)).alias("parts")).where("parts > 1")
    dealt = pairs.join(many, "a", "left").select("a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"), "b")
    sides = dealt.select("a", "part", F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = saved(sides.join(nodes, "node").select("a", "part", "node", F.col("w.doc_id").alias("doc_id"), F.col("w.th").alias("th")))
    if wanted.count() <= FEW:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), text_hash().alias("h"), "text")
    texts = texts.join(wanted, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th"))).select("a", "part", "node", "text")

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int, int]] = set()  # repeated rows
        last, own = None, b""
        for whole in it:
            for b in _text_slices(whole, 3):
                keep, out = [], []
                for i, at in enumerate(zip(*(b.column(c).to_pylist() for c in range(3)))):
                    if at in sent:
                        continue
                    sent.add(at)
                    if at[2] != last:  # the rows of a text follow each other
                        last, own = at[2], np.unique(word_shingles([b.column(3)[i].as_py()], shingle)[0][0]).tobytes()
                    keep.append(i)
                    out.append(own)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(keep, pa.int64())) for c in range(3)), pa.array(out, pa.binary())],
                                                 names=["a", "part", "node", "shingles"])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(0, np.uint64)
        for b in it:
            near = []
            for a, node, v in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                y = np.frombuffer(v.as_buffer(), np.uint64)
                if a == node:
                    x = y.copy()
                shared = len(np.intersect1d(x, y, assume_unique=True)) if a != node else -1
                near.append(shared >= similarity * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    met = texts.mapInArrow(sets, "a long, part long, node long, shingles binary").repartition("a", "part")
    return met.sortWithinPartitions("a", "part", F.col("a") != F.col("node")).mapInArrow(compare, "a long, b long")


def similar_groups(docs: DataFrame, shingle: int = WORDS, radius: int = RADIUS,
                   similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, node, ..) of all documents, and (node, root) of the linked nodes.

    Candidates are each member of a group of near fingerprints with the group's smallest, the
    pairs of small buckets, and round by round those of large ones: their members are dealt
    to 1, 64, 4,096 .. classes, whose smallest members meet all others of the bucket that fit,
    and then leave it; a bucket is done when its members are of one group. Two texts fit if the
    bucket's shingle can be the first of those that both have, by its places in their sets and
    the sets' sizes; a similar pair does so in the bucket of its first one. Bitmaps rule most
    candidates out. The first round checks each text with the smallest that it may be like, the
    second what is left of these and not linked by then. So a large group costs a link a member, and no similar pair is
    passed over unless it is linked already.
    """
    rows = saved(described(docs, shingle))
    texts = rows.where("part is null")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th"))
    nodes = saved(texts.groupBy("node").agg(first.alias("w"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bits").alias("bits")))

    def rooted(df: DataFrame, column: str, root: str) -> DataFrame:
        if found is None:
            return df.withColumn(root, F.col(column))
        known = found.select(F.col("node").alias(column), F.col("root").alias(root))
        return df.join(known, column, "left").withColumn(root, F.coalesce(root, column))

    roots = saved(grouped(nodes, radius).join(nodes.select("node", "fp"), "fp").select("node", "root"))
    heads = roots.groupBy("root").agg(F.min("node").alias("a"))
    places = saved(prefixes(docs, sketch(rows), shingle, similarity))
    fresh = (heads.join(roots, "root").where("node <> a").select("a", F.col("node").alias("b"))
             .unionByName(places.where("a is not null").select("a", "b")))
    members = places.where("a is null").select("key", "node", "n", "at")
    links = found = left = None
    classes = 1
    while True:
        if members is not None:
            members = rooted(members, "node", "root")
            ends = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
            members = saved(members.join(ends.select("key"), "key").select("key", "node", "n", "at", "root"))
            members = None if members.isEmpty() else members
        if members is not None:
            part = F.pmod(F.xxhash64("node"), F.lit(classes))
            heads = members.groupBy("key", part.alias("part")).agg(F.min(F.struct("node", "root", "n", "at")).alias("head"))
            heads = heads.select("key", *(F.col(f"head.{c}").alias(name) for c, name in
                                          (("node", "a"), ("root", "a_root"), ("n", "a_n"), ("at", "a_at"))))
            fits = may_share(F.col("n"), F.col("at"), F.col("a_n"), F.col("a_at"), similarity, F.least)
            met = members.join(heads, "key").where((F.col("root") != F.col("a_root")) & fits)
            met = met.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
            fresh = met if fresh is None else fresh.unionByName(met)
            members = members.drop("root").join(heads.select("key", F.col("a").alias("node")), ["key", "node"], "left_anti")
        if left is not None:
            left = rooted(rooted(left, "a", "ra"), "b", "rb").where("ra <> rb").select("a", "b")
        if fresh is None and left is None:
            break
        pairs = None if fresh is None else plausible_pairs(fresh.distinct(), nodes, similarity)
        pairs = saved(pairs if left is None else left if pairs is None else pairs.unionByName(left).distinct())
        if classes == 1:
            todo = saved(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
            left = pairs.join(todo, ["a", "b"], "left_anti")
        else:
            todo, left = pairs, None
        if not todo.isEmpty():
            new = saved(similar_pairs(docs, todo, nodes, shingle, similarity))
            if not new.isEmpty():
                links = new if links is None else links.unionByName(new)
                found = saved(components(links))
        fresh = None
        classes *= GROWTH
    if found is None:
        found = nodes.select("node", F.col("node").alias("root")).limit(0)
    return texts.select("doc_id", "th", "node"), found


def drop_near_duplicates(docs: DataFrame, shingle: int = WORDS, radius: int = RADIUS,
                         similarity: float = SIMILARITY) -> DataFrame:
    """The same columns, with one row of each group: the smallest doc_id, and for equal ids the smallest text hash."""
    rows, found = similar_groups(docs, shingle, radius, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th"))
    least = rows.groupBy("node").agg(first.alias("w")).join(found, "node", "left")
    kept = least.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("w").alias("w")).select("w.doc_id", "w.th")
    th = free_name(docs, "th")
    out = docs.withColumn(th, text_hash())
    out = out.join(kept.select(F.col("doc_id").alias("kept_id"), F.col("th").alias("kept_th")),
                   F.col("doc_id").cast("long").eqNullSafe(F.col("kept_id")) & (F.col(th) == F.col("kept_th")), "left_semi")
    return out.dropDuplicates(["doc_id", th]).select(*docs.columns)
