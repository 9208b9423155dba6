"""Packing: bounded-space online packing of token sequences.

Every partition packs its documents in one pass. It keeps at most ``open_windows``
windows open. A document's full windows are emitted at once; its rest goes to the
window that it fits best. When it fits none and no more may be opened, the fullest
window is topped up with the rest's head (unless the gap is under ``min_cut``
tokens) and emitted, and what remains is placed again. Windows still open at a
partition's end are merged in the same way, some partitions together, and what
is then left is laid end to end; its last tokens become sequences whose lengths
are powers of two, which need no padding.

Memory: a slice of a batch and ``open_windows`` windows for each task; the merge
reads no more than ``open_windows`` windows of each of ``merge`` partitions.
Nothing but leftovers is shuffled. Ids of the first pass are written to the
shared folder, so that a text is tokenised once and a lost executor costs tasks
and no more.

Defined results: a null or empty text is the end id alone; a null doc_id is
kept; repeated rows are packed each; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, repeat
from operator import add, getitem, is_, not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.llm.common import saved

WINDOW, END_ID = 4096, 2
SLICE_BYTES = 4_000_000
#: Distinct words of a generation. A worker remembers two: what is met again in the second goes on into the next.
REMEMBERED = 150_000
#: Runs of letters that a worker remembers before it starts anew.
LETTERS = 400_000
MARKS = ".,!?;:*$%&#|"


def _letters(core: str, lower: str) -> bool:
    """Whether a word is letters only, in lower case too (some letters become a letter and a mark)."""
    return lower.isalpha() and core.isalpha() and (core.isascii() or max(core) < "\u0250")


class Words:
    """Ids of texts by way of the distinct words in them.

    The vocabulary drops white space and never joins across it, nor across a letter
    and one of ``MARKS``. So each distinct word is encoded once, and a word that is
    letters and such marks shares its letters, in lower case, with all its forms.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known: dict[str, bytes] = {"": b""}
        self.former: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def _each(self, words: list[str]) -> dict[str, bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {w: np.array(x.ids, "<u4").tobytes() for w, x in zip(words, found, strict=True)}

    def _plain(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters: one run each, so they are encoded as one text and cut at word ends."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
        if len(ends) != len(words):
            return list(self._each(words).values())
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *ends], ends)]

    def _learn(self, words: list[str]) -> None:
        cores = list(map(str.rstrip, words, repeat(MARKS)))
        lower = list(map(str.lower, cores))
        fine = list(map(_letters, cores, lower))
        odd = list(compress(words, map(not_, fine)))
        if odd:
            self.known.update(self._each(odd))
            words, cores, lower = (list(compress(x, fine)) for x in (words, cores, lower))
        found = list(map(self.letters.get, lower))
        new = list(dict.fromkeys(compress(lower, map(is_, found, repeat(None)))))
        if new:
            if len(self.letters) > LETTERS:
                self.letters = {}
                new = list(dict.fromkeys(lower))
            self.letters.update(zip(new, self._plain(new), strict=True))
            found = list(map(self.letters.get, lower))
        tails = list(map(getitem, words, map(slice, map(len, cores), repeat(None))))
        others = set(tails) - self.tails.keys()
        if others:
            if len(self.tails) > REMEMBERED:
                self.tails = {"": b""}
                others = set(tails) - {""}
            self.tails.update(self._each(list(others)))
        self.known.update(zip(words, map(add, found, map(self.tails.get, tails)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and where each text ends."""
        texts = pc.replace_substring(pc.coalesce(texts.cast(pa.large_string()), pa.scalar("", pa.large_string())), "\n", " ")
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > REMEMBERED:
            self.former, self.known = self.known, {"": b""}
        found = list(map(self.known.get, distinct))
        new = list(compress(distinct, map(is_, found, repeat(None))))
        if new:
            before = list(map(self.former.get, new))  # what the former generation knew is taken over
            self.known.update(zip(new, before, strict=True))
            self._learn(list(compress(new, map(is_, before, repeat(None)))))
            found = list(map(self.known.get, distinct))
        ids = pa.array(found, pa.large_binary()).take(words.indices)
        if not len(ids):
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset:ids.offset + len(ids) + 1]
        offsets = lists.offsets.to_numpy()
        ends = (at[offsets - offsets[0]] - at[0]) // 4
        return np.frombuffer(ids.buffers()[2], "<u4")[at[0] // 4:at[-1] // 4], ends[1:]


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


class Packer:
    """Open windows of one pass. Pieces are [doc, start, ids, doc tokens]; windows hold pieces and a fill."""

    def __init__(self, first_id: int, window: int, open_windows: int, min_cut: int) -> None:
        self.next_id, self.window, self.most, self.min_cut = first_id, window, open_windows, min_cut
        self.open: list[list] = []
        self.rows: list[tuple] = []

    def emit(self, pieces: list, still_open: bool = False) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), ids.tobytes(), total, self.next_id, offset, still_open))
            offset += len(ids)
        self.next_id += 1

    def put(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.window:
            self.emit([(doc, start, ids[:self.window], total)])
            start, ids = start + self.window, ids[self.window:]
        while len(ids):
            fits = [w for w in self.open if w[0] + len(ids) <= self.window]
            if fits:
                w = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.most:
                w = [0, []]
                self.open.append(w)
            else:
                w = max(self.open, key=lambda w: w[0])
                head = self.window - w[0]
                if head >= self.min_cut:
                    w[1].append((doc, start, ids[:head], total))
                    start, ids = start + head, ids[head:]
                self.open.remove(w)
                self.emit(w[1])
                continue
            w[0] += len(ids)
            w[1].append((doc, start, ids, total))
            ids = ids[:0]
            if w[0] == self.window:
                self.open.remove(w)
                self.emit(w[1])

    def leave_open(self) -> None:
        for _, pieces in self.open:
            self.emit(pieces, True)
        self.open = []

    def finish(self) -> None:
        """Lay what is open end to end; the last tokens go to sequences of a power of two."""
        pieces = [p for w in self.open for p in w[1]]
        left, self.open = sum(len(p[2]) for p in pieces), []
        room = 0
        held: list = []
        for doc, start, ids, total in pieces:
            while len(ids):
                if not room:
                    room = self.window if left >= self.window else 1 << (left.bit_length() - 1)
                n = min(room, len(ids))
                held.append((doc, start, ids[:n], total))
                start, ids, room, left = start + n, ids[n:], room - n, left - n
                if not room:
                    self.emit(held)
                    held = []

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


PIECES = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "open boolean")
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES, strict=True)], names=_NAMES)


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``SLICE_BYTES`` of text, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE_BYTES, "right")))
        yield b.slice(i, j - i)
        i = j


def pack(docs: DataFrame, tokenizer_path: str, *, window: int = WINDOW, open_windows: int = 32, min_cut: int = 8,
         merge: int = 16) -> DataFrame:
    """Pieces of documents (doc_id, text) with their ids (unsigned 32-bit, little-endian) and places.

    A window that is emitted is at most ``min_cut`` - 1 tokens short.
    """
    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 32, window, open_windows, min_cut)
        for whole in it:
            for b in _slices(whole):
                ids, ends = words.encode(b.column(1))
                start = 0
                for doc, end in zip(b.column(0).to_pylist(), ends.tolist(), strict=True):
                    own = np.append(ids[start:end], np.uint32(END_ID)).astype("<u4")
                    packer.put(doc, 0, own, len(own))
                    start = end
                if rows := packer.taken():
                    yield _batch(rows)
        packer.leave_open()
        if rows := packer.taken():
            yield _batch(rows)
        pa.default_memory_pool().release_unused()

    def again(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, group = None, None
        for b in it:
            for row in b.to_pylist():
                if packer is None or row["group"] != group:
                    if packer:
                        packer.finish()
                    group, held = row["group"], packer.taken() if packer else []
                    packer = Packer((1 << 62) + (group << 32), window, open_windows, min_cut)
                    if held:
                        yield _batch(held)
                packer.put(row["doc_id"], row["start"], np.frombuffer(row["ids"], "<u4"), row["doc_tokens"])
            if packer and (rows := packer.taken()):
                yield _batch(rows)
        if packer:
            packer.finish()
            if rows := packer.taken():
                yield _batch(rows)

    passed = saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first, PIECES), "zstd")
    left = (passed.where("open").withColumn("group", F.floor(F.shiftright("sequence_id", 32) / merge).cast("long"))
            .repartition("group").sortWithinPartitions("group", "sequence_id", "offset"))
    return passed.where("not open").unionByName(left.mapInArrow(again, PIECES)).drop("open")


def digest(pieces: DataFrame) -> DataFrame:
    """The places of all pieces and a checksum of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
