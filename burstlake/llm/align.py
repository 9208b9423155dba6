"""Cross-tokenizer alignment by white-space anchors.

A text is tokenised whole by two tokenizers, A (byte-level) and B (pieces with byte
fallback). Where a token of A and one of B end at the same byte, the next tokens of
both begin with a space, and the bytes of both read the same up to there, stands an
anchor. Anchors cut a document into windows of a few token ids on either side. How
a window's ids align depends on the ids alone, so each distinct pair of id tuples is
aligned once and remembered: its groups (cut wherever both sides end) and its links
(tokens whose byte ranges overlap).

How often an id pair is linked is counted over all documents. Documents are tokenised
in blocks of at most ``BLOCK_BYTES`` of text; a block is written with its distinct
windows, its id pairs and their numbers, and each document with the windows it has.
Pairs are summed by block, then over all blocks, and their sums go back to the
blocks: a pair that stands in every document is one row a block. Blocks are dealt
to ``SHARE_BYTES`` of text, whatever the number of input files. A task holds one such
share (windows and documents' window numbers, no texts), or one longer document.

Defined results: a text that is null or empty, or whose tokens of A or B don't join
to the bytes of space + text, has no tokens: all counts are zero and the groups are
the empty string; rows with a null doc_id and repeated rows are results of their own
and count each; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.llm.common import saved

SLICE_BYTES, BLOCK_BYTES, SHARE_BYTES, LEAST_SHARES = 1_000_000, 8_000_000, 8_000_000, 32
#: Distinct windows that a worker remembers before it starts anew.
REMEMBERED = 200_000
#: Characters that every version of Unicode tables since 5.0 puts in the same class.
_SETTLED = re.compile("[^\x00-ɏ‘-”–—…]")
SPACE_MARK = "▁"


class Paths(NamedTuple):
    """Files of the tokenizers: A, B, and A's vocabulary as ranks (same ids, or None)."""

    a: str
    b: str
    a_ranks: str | None = None


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """Bytes of each id of a vocabulary."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = pa.array(tokens, pa.large_binary())
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.spaced = np.array([t.startswith(b" ") for t in tokens])

    def joined(self, ids: np.ndarray) -> memoryview:
        buf = self.tokens.take(pa.array(ids)).buffers()
        return memoryview(buf[2]).cast("B")[:int(self.size[ids].sum())] if buf[2] is not None else memoryview(b"")


class Tokenizers:
    def __init__(self, paths: Paths) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(paths.a)
        self.a.encode_special_tokens = True
        letters, size = byte_letters(), self.a.get_vocab_size()
        names = [self.a.id_to_token(i) or "" for i in range(size)]
        self.side_a = Side([bytes(letters[c] for c in n) if all(c in letters for c in n) else n.encode() for n in names])
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths.b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.side_b = Side([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE_MARK, " ").encode()
                            for i, p in enumerate(pieces)])
        self.ranked = self._ranked(paths) if paths.a_ranks else None

    @staticmethod
    def _ranked(paths: Paths):
        """The same vocabulary as ranks, some four times as fast; only where its ids are those of A."""
        import public_tokenizers
        import tiktoken

        with open(paths.a_ranks, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        with open(paths.a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        letters = byte_letters()
        if any(ranks.get(bytes(letters[c] for c in t)) != i for t, i in vocab.items() if all(c in letters for c in t) and i < len(ranks)):
            raise ValueError("the ranks are of another vocabulary")
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        if self.ranked is not None:
            for i, t in enumerate(texts):
                if not _SETTLED.search(t):
                    out[i] = self.ranked.encode_ordinary(t)
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, found in zip(rest, self.a.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)


def align_windows(a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray, side_a: Side, side_b: Side,
                  names: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Groups of windows as text, their number, and the links of all windows (a << 32 | b) with their number.

    The ids of the windows stand one after the other. Between two neighbouring ends of any side lies one
    link; a group ends where both sides do.
    """
    end_a, end_b = np.cumsum(side_a.size[a]), np.cumsum(side_b.size[b])
    cuts = np.union1d(end_a, end_b)
    begin = np.r_[0, cuts[:-1]]
    in_a, in_b = np.searchsorted(end_a, begin, "right"), np.searchsorted(end_b, begin, "right")
    links = a[in_a].astype(np.int64) << 32 | b[in_b].astype(np.int64)
    bounds = end_a[np.cumsum(len_a) - 1]
    n_links = np.diff(np.searchsorted(cuts, bounds, "right"), prepend=0)
    both = np.intersect1d(end_a, end_b, assume_unique=True)
    n_groups = np.diff(np.searchsorted(both, bounds, "right"), prepend=0)
    last_a, last_b = (np.searchsorted(both, e) for e in (end_a, end_b))  # group of each token
    closes_a, closes_b = both[last_a] == end_a, both[last_b] == end_b
    size_a, size_b = (np.bincount(g, minlength=len(both)) for g in (last_a, last_b))
    word = np.empty(len(a) + len(b), np.int64)
    word[np.arange(len(a)) + (np.cumsum(size_b) - size_b)[last_a]] = 2 * a.astype(np.int64) + closes_a
    word[np.arange(len(b)) + np.cumsum(size_a)[last_b]] = 2 * len(side_a.size) + 2 * b.astype(np.int64) + closes_b
    text = names.take(pa.array(word))
    at = np.frombuffer(text.buffers()[1], np.int64)[np.r_[0, np.cumsum(len_a + len_b)]].tolist()
    data = text.buffers()[2].to_pybytes()
    return [data[i:j] for i, j in zip(at, at[1:])], n_groups, links, n_links


class Aligner:
    """Tokenizers and the windows met so far, each with its text, number of groups and links."""

    def __init__(self, paths: Paths) -> None:
        self.tok = Tokenizers(paths)
        self.names = pa.array([f"{i}{end}" for side, ends in ((self.tok.side_a, ",|"), (self.tok.side_b, ",;"))
                               for i in range(len(side.size)) for end in ends], pa.large_string())
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.text: list[bytes] = []
        self.groups: list[int] = []
        self.sizes: list[np.ndarray] = []
        self.links: list[np.ndarray] = []

    def places(self, keys: list[bytes]) -> np.ndarray:
        """Numbers of windows; those not met before are aligned."""
        new = [k for k in keys if k not in self.place]
        if new:
            data = np.frombuffer(b"".join(new), "<u4")
            size = np.array([len(k) for k in new], np.int64) // 4
            head = np.cumsum(size) - size
            len_a = data[head].astype(np.int64)
            inside = np.arange(len(data)) - np.repeat(head, size)
            is_a = inside <= np.repeat(len_a, size)
            text, groups, links, n = align_windows(data[is_a & (inside > 0)], data[~is_a], len_a, size - 1 - len_a,
                                                   self.tok.side_a, self.tok.side_b, self.names)
            self.place.update(zip(new, range(len(self.text), len(self.text) + len(new))))
            self.text += text
            self.groups += groups.tolist()
            self.sizes.append(n)
            self.links.append(links)
        return np.array([self.place[k] for k in keys], np.int64)

    def tokens(self, texts: list[str]) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
        """Which texts have tokens that join to their bytes, and the ids of both sides."""
        a = [np.array(x, np.uint32) for x in self.tok.encode_a([" " + t for t in texts])]
        b = [np.array(x, np.uint32) for x in self.tok.encode_b(texts)]
        whole = b"".join((" " + t).encode() for t in texts)
        ends = np.cumsum([len(t.encode()) + 1 for t in texts])
        fine = list(range(len(texts)))
        for side, ids in ((self.tok.side_a, a), (self.tok.side_b, b)):
            sizes = np.cumsum([int(side.size[x].sum()) for x in ids])
            if not np.array_equal(sizes, ends) or side.joined(np.concatenate(ids)) != whole:
                fine = [i for i in fine if side.joined(ids[i]) == (" " + texts[i]).encode()]
        return fine, [a[i] for i in fine], [b[i] for i in fine]

    def windows(self, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Keys of the windows of all texts (number of A ids, A ids, B ids), and where each text ends in them."""
        na, nb = (np.cumsum([len(x) for x in side]) for side in (a, b))
        ids_a, ids_b = np.concatenate(a), np.concatenate(b)
        side_a, side_b = self.tok.side_a, self.tok.side_b
        end_a, end_b = np.cumsum(side_a.size[ids_a]), np.cumsum(side_b.size[ids_b])
        ends_b = np.zeros(end_a[-1] + 1, bool)
        ends_b[end_b] = True
        shared = np.flatnonzero(ends_b[end_a])
        other = np.searchsorted(end_b, end_a[shared])
        spaced = side_a.spaced[np.append(ids_a[1:], 0)[shared]] & side_b.spaced[np.append(ids_b[1:], 0)[other]]
        spaced |= np.isin(shared, na - 1, assume_unique=True)
        cut_a, cut_b = shared[spaced] + 1, other[spaced] + 1
        from_a, from_b = np.r_[0, cut_a[:-1]], np.r_[0, cut_b[:-1]]
        len_a, len_b = cut_a - from_a, cut_b - from_b
        at = np.r_[0, np.cumsum(1 + len_a + len_b)]
        data = np.empty(at[-1], "<u4")
        data[at[:-1]] = len_a
        data[np.arange(len(ids_a)) + np.repeat(at[:-1] + 1 - from_a, len_a)] = ids_a
        data[np.arange(len(ids_b)) + np.repeat(at[:-1] + 1 + len_a - from_b, len_b)] = ids_b
        keys = pa.Array.from_buffers(pa.large_binary(), len(len_a), [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(data)])
        return keys.dictionary_encode(), np.searchsorted(cut_a, na) + 1


@lru_cache(maxsize=2)
def aligner_of(paths: Paths) -> Aligner:
    return Aligner(paths)


class Block:
    """How often each window stands in some documents."""

    def __init__(self, number: int) -> None:
        self.number, self.bytes, self.met = number, 0, np.zeros(0, np.int64)

    def add(self, places: np.ndarray) -> None:
        met = np.bincount(places, minlength=len(self.met))
        met[:len(self.met)] += self.met
        self.met = met

    def row(self, aligner: Aligner) -> pa.RecordBatch:
        """The id pairs in order with their numbers, and the windows with the places of their links among the pairs."""
        window = np.flatnonzero(self.met)
        size, links = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (aligner.sizes, aligner.links))
        n = size[window]
        own = links[np.arange(n.sum()) + np.repeat((np.cumsum(size) - size)[window] - (np.cumsum(n) - n), n)]
        pairs, at = np.unique(own, return_inverse=True)
        count = np.bincount(at, np.repeat(self.met[window], n), len(pairs)).astype(np.int64)
        if len(aligner.place) > REMEMBERED:
            aligner.forget()
        columns = {"block": self.number, "bytes": self.bytes, "a": pairs >> 32, "b": pairs & 0xFFFFFFFF, "links": count,
                   "window": window, "size": n, "at": at}
        return pa.RecordBatch.from_arrays([
            pa.nulls(1, f.type) if f.name not in columns else pa.array([columns[f.name]], f.type) for f in _OUT], schema=_OUT)


_OUT = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                  ("groups_sha256", pa.string()), ("windows", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
                  ("bytes", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32())), ("links", pa.list_(pa.int64())),
                  ("window", pa.list_(pa.int32())), ("size", pa.list_(pa.int32())), ("at", pa.list_(pa.int32()))])
_DDL = ("block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, windows array<int>, times array<int>, "
        "bytes long, a array<int>, b array<int>, links array<bigint>, window array<int>, size array<int>, at array<int>")


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE_BYTES, "right")))
        yield b.slice(i, j - i)
        i = j


def _ragged(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.astype(np.int32)))


def _documents(b: pa.RecordBatch, block: Block, aligner: Aligner) -> pa.RecordBatch:
    """A row for each document of a slice; its windows are added to the block."""
    n, texts = b.num_rows, b.column(1).to_pylist()
    live = [i for i, t in enumerate(texts) if t]
    n_a, n_b, n_groups = (np.zeros(n, np.int64) for _ in range(3))
    sha, starts = [""] * n, np.zeros(n + 1, np.int64)
    windows = times = np.zeros(0, np.int64)
    fine, a, bs = aligner.tokens([texts[i] for i in live]) if live else ([], [], [])
    if fine:
        rows = np.array(live)[fine]
        n_a[rows], n_b[rows] = [len(x) for x in a], [len(x) for x in bs]
        keys, ends = aligner.windows(a, bs)
        places = aligner.places(keys.dictionary.to_pylist())
        at = places[keys.indices.to_numpy()]
        begins = np.r_[0, ends[:-1]]
        distinct = places.tolist()
        n_groups[rows] = np.add.reduceat(np.array([aligner.groups[i] for i in distinct])[keys.indices.to_numpy()], begins)
        text = pa.array([aligner.text[i] for i in distinct], pa.large_binary()).take(keys.indices)
        offsets, data = np.frombuffer(text.buffers()[1], np.int64), memoryview(text.buffers()[2])
        for i, s, e in zip(rows.tolist(), offsets[begins].tolist(), offsets[ends].tolist(), strict=True):
            sha[i] = hashlib.sha256(data[s:e - 1]).hexdigest()
        block.add(at)
        whose = np.repeat(np.arange(len(rows)), ends - begins)
        both, times = np.unique(whose << 32 | at, return_counts=True)
        windows = both & 0xFFFFFFFF
        own = np.zeros(n, np.int64)
        own[rows] = np.bincount(both >> 32, minlength=len(rows))
        starts = np.r_[0, np.cumsum(own)]
    columns = {"block": pa.array(np.full(n, block.number)), "doc_id": b.column(0), "n_a": pa.array(n_a), "n_b": pa.array(n_b),
               "n_groups": pa.array(n_groups), "groups_sha256": pa.array(sha, pa.string()),
               "windows": _ragged(windows, starts), "times": _ragged(times, starts)}
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _OUT], schema=_OUT)


def aligned(docs: DataFrame, paths: Paths) -> DataFrame:
    """Rows of documents, and one row for each block (whose ``size`` is not null)."""
    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = aligner_of(paths), TaskContext.get().partitionId() << 32
        block = Block(number)
        for whole in it:
            for b in _slices(whole):
                yield _documents(b, block, aligner)
                block.bytes += b.nbytes
                if block.bytes >= BLOCK_BYTES:
                    yield block.row(aligner)
                    number += 1
                    block = Block(number)
        if block.bytes:
            yield block.row(aligner)
        pa.default_memory_pool().release_unused()

    return saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, _DDL), "zstd")


def pair_counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(share, a, b) of each share's id pairs with ``links`` over all documents and whether it is the most for b; shares of blocks."""
    blocks = rows.where("size is not null")
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    share = F.pmod(F.xxhash64("block"), F.lit(max(LEAST_SHARES, -(-total // SHARE_BYTES)))).alias("share")
    each = blocks.select(share, F.explode(F.arrays_zip("a", "b", "links")).alias("p")).groupBy(
        "share", "p.a", "p.b").agg(F.sum("p.links").alias("links"))
    each = saved(each)
    counts = each.groupBy("a", "b").agg(F.sum("links").alias("links"))
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    known = counts.join(most, "b").select("a", "b", "links", (F.col("links") == F.col("most")).alias("best"))
    return each.select("share", "a", "b").join(known, ["a", "b"]), rows.withColumn("share", share)


def alignment(docs: DataFrame, paths: Paths) -> DataFrame:
    """What each document's two tokenisations have in common; see the module's text for the columns."""
    counts, rows = pair_counts(aligned(docs, paths))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        key = right["a"].to_numpy().astype(np.int64) << 32 | right["b"].to_numpy()
        order = np.argsort(key)
        key, links, best = key[order], right["links"].to_numpy()[order], right["best"].to_numpy()[order]
        own = left.filter(pc.is_valid(left["size"]))
        values = {}
        for i in range(own.num_rows):
            at, size, a, b, window = (own[c][i].values.to_numpy().astype(np.int64) for c in ("at", "size", "a", "b", "window"))
            place = np.searchsorted(key, a << 32 | b)[at] if len(at) else at
            starts = np.cumsum(size) - size
            values[own["block"][i].as_py()] = window, [size, *(np.add.reduceat(v, starts) if len(at) else size for v in (
                best[place].astype(np.int64), links[place]))]
        docs = left.filter(pc.is_null(left["size"]))
        out = [np.zeros(docs.num_rows, np.int64) for _ in range(3)]
        block_of = docs["block"].to_numpy()
        for number in np.unique(block_of):
            mine = np.flatnonzero(block_of == number)
            part = docs.take(pa.array(mine)).combine_chunks()
            n = pc.list_value_length(part["windows"]).to_numpy()
            windows, times = (pc.list_flatten(part[c]).to_numpy() for c in ("windows", "times"))
            whose, (known, sums) = np.repeat(mine, n), values[number]
            place = np.searchsorted(known, windows)
            for total, value in zip(out, sums, strict=True):
                np.add.at(total, whose, value[place] * times)
        sums = dict(zip(("n_links", "n_best", "count_sum"), map(pa.array, out), strict=True))
        return pa.table([sums.get(c) if c in sums else docs[c] for c in names], names=names)

    kept = rows.select("share", "block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "windows", "times", "a", "b", "window", "size", "at")
    return kept.groupBy("share").cogroup(counts.groupBy("share")).applyInArrow(
        meet, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def pair_table(docs: DataFrame, paths: Paths) -> DataFrame:
    """(a, b, links, best): how often each id pair is linked over all documents, and whether it is b's most frequent."""
    counts, _ = pair_counts(aligned(docs, paths))
    return counts.drop("share").distinct()
