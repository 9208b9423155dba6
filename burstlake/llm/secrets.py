"""Secret scans: fixed patterns, and what a credential-context value would cost to guess.

Base spans are matches of fixed patterns over the whole text, leftmost and
non-overlapping per kind; a match that is too short is dropped, and what it
covered is not searched again.

The method looks at values that stand where a credential stands ("password is
...", "api-key := ..."). Their guess cost, in powers of ten, is the cheapest way
to cut the value into known words, dates, repeats, keyboard walks and
brute-force spans; a dynamic programme over positions finds it in time linear in
the value's length. Values of the wider contexts that cost at least
``MIN_COST`` and overlap no base span become spans of kind ``guess``.

Words of prose follow "secret is" as well, so the known words are a short fixed list
and the words of the corpus, ranked by the documents that hold them (``ranked``): one
more scan, counts combined in the tasks and before the shuffle, and the first
``MAX_WORDS`` of at most ``MAX_LETTERS`` letters, no more from all tasks together, go to
the driver and to each worker. A
document doesn't count for the words of its own context values, so that a secret isn't
known for being copied; what fewer than ``MIN_WORD_DOCS`` documents hold is no word.
A small corpus knows few words, and more of its prose costs brute force.

Defined results: a null text counts as empty and has no spans; repeated rows
have equal results; further columns are ignored by ``scan`` and kept by
``redact``; an empty table gives an empty result; texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from burstlake.llm.common import free_name, saved

# The kinds in the order of listing, with pattern, group and least length.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

#: Wider credential contexts of the method.
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?)"""
    r"""["']?(?:[ \t]*(?::=|=>|[:=])[ \t]*|[ \t]+(?:is|was)[ \t]+)["'`]?([^\s"'`]{4,})""", re.I | re.A)
#: What each match of ASSIGN or CONTEXT holds one of, in lower case.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT_WORDS = ("passw", "passphrase", "passcode", "pwd", "secret", "token", "api", "access", "private", "credential")
#: Least guess cost, as a power of ten, of a span that the method adds.
MIN_COST = 8.0

# Words, most likely first: a word's rank is its number of guesses. A plain list of well-known bad passwords.
WORDS = (
    "password qwerty letmein dragon baseball football monkey abc master michael shadow superman pass admin welcome "
    "login princess solo sunshine iloveyou starwars hello freedom whatever trustno trust test default root user guest "
    "secret changeme temp demo system server access database backup oracle hunter summer winter spring autumn "
    "january february march april may june july august september october november december monday tuesday "
    "wednesday thursday friday saturday sunday love god money example sample token key code public private none null "
    "true false").split()
RANK = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST_WORD = max(map(len, WORDS))
#: Words taken from the corpus: how many, of how many letters, and in how many documents at least; counts held by a task.
MAX_WORDS, MIN_LETTERS, MAX_LETTERS, MIN_WORD_DOCS = 65_536, 3, 32, 3
HELD_COUNTS = 200_000
LETTERS = re.compile(r"[^\W\d_]+")
LEET = str.maketrans("4@8301!|$57", "aabeoiiisst")
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")

BRUTE_CHAR, EXTRA_SEGMENT = 1.0, 0.3
YEARS = re.compile(r"19\d\d|20[0-4]\d")
DATES = re.compile(r"(?:(?:0?[1-9]|[12]\d|3[01])([-/._ ]?)(?:0?[1-9]|1[0-2])\1(19\d\d|20[0-4]\d)"
                   r"|(19\d\d|20[0-4]\d)([-/._ ]?)(?:0?[1-9]|1[0-2])\4(?:0?[1-9]|[12]\d|3[01]))")


class Ranks:
    """Words with their ranks; equal for equal words, so that one is kept with the remembered costs."""

    def __init__(self, words: tuple[str, ...] = ()):
        self.rank = {w: i + 1 for i, w in enumerate(words)}
        for w, r in RANK.items():
            self.rank[w] = min(r, self.rank.get(w, r))
        self.longest = max(map(len, self.rank))
        self.key = hashlib.sha256("\n".join(words).encode()).hexdigest()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Ranks) and self.key == other.key

    def __hash__(self) -> int:
        return hash(self.key)


FIXED = Ranks()


def _places() -> dict[str, tuple[float, int]]:
    return {c: (x + y * 0.5, y) for y, row in enumerate(KEYBOARD) for x, c in enumerate(row)}


PLACES = _places()


def _next_to(a: str, b: str) -> tuple[float, int] | None:
    """Direction from one key to a neighbouring key."""
    if a not in PLACES or b not in PLACES or a == b:
        return None
    dx, dy = PLACES[b][0] - PLACES[a][0], PLACES[b][1] - PLACES[a][1]
    return (dx, dy) if abs(dx) <= 1 and abs(dy) <= 1 else None


def repeats(value: str) -> list[list[int]]:
    """For units of 1 to 8 characters: from each position, how many characters equal the one a unit later."""
    n, out = len(value), []
    for unit in range(1, 9):
        run = [0] * (n + 1)
        for i in range(n - unit - 1, -1, -1):
            run[i] = run[i + 1] + 1 if value[i] == value[i + unit] else 0
        out.append(run)
    return out


def segments(value: str, i: int, runs: list[list[int]], words: Ranks = FIXED) -> list[tuple[int, float]]:
    """Ends and costs of the patterns that start at ``i``; brute force is not among them.

    A repeat ends where it cannot go on, a keyboard walk there or after 64 keys, so
    there are no more than a constant number of segments for each start.
    """
    out: list[tuple[int, float]] = []
    low = value[i:i + words.longest].lower()
    plain = low.translate(LEET)
    for k in range(3, len(low) + 1):
        rank, leet = words.rank.get(low[:k]), words.rank.get(plain[:k])
        if rank or leet:
            cased = value[i:i + k] != low[:k]
            swaps = 0 if rank else sum(a != b for a, b in zip(low[:k], plain[:k], strict=True))
            out.append((i + k, math.log10(rank or leet) + math.log10(2) * (cased + swaps)))
    if m := YEARS.match(value, i):
        out.append((m.end(), math.log10(max(20, abs(int(m[0]) - 2025)))))
    if m := DATES.match(value, i):
        year = int(m[2] or m[3])
        out.append((m.end(), math.log10(365 * max(20, abs(year - 2025)) * (4 if m[1] or m[4] else 1))))
    for unit, run in enumerate(runs, 1):
        times = run[i] // unit + 1
        if times > 1 and times * unit >= 3:
            out.append((i + times * unit, unit * BRUTE_CHAR + math.log10(times)))
    low, end, turns, last = value[i:i + 64].lower(), 1, 0, None
    while end < len(low) and (step := _next_to(low[end - 1], low[end])):
        turns += step != last
        last, end = step, end + 1
    if end >= 3:
        out.append((i + end, math.log10(len(PLACES) * end) + turns * math.log10(4.6)))
    return [(e, c) for e, c in out if e <= len(value)]


#: Longest value whose cost is kept for the next time.
KEPT_LETTERS = 64


def guess_cost(value: str, words: Ranks = FIXED) -> float:
    """The least sum of segment costs, see ``cost_of``; costs of short values are remembered."""
    return (short_cost if len(value) <= KEPT_LETTERS else cost_of)(value, words)


def cost_of(value: str, words: Ranks) -> float:
    """The least sum of segment costs over all ways to cut ``value``, as a power of ten.

    Every segment after the first costs ``EXTRA_SEGMENT``. A brute-force span costs
    ``BRUTE_CHAR`` for each character, so it grows by one character at a time.
    """
    n = len(value)
    ended = [math.inf] * (n + 1)  # cheapest where a pattern ends at this position
    brute = [math.inf] * (n + 1)  # cheapest where a brute-force span ends there
    ended[0] = -EXTRA_SEGMENT
    runs = repeats(value)
    for i in range(n):
        best = min(ended[i], brute[i])
        brute[i + 1] = min(brute[i] + BRUTE_CHAR, ended[i] + EXTRA_SEGMENT + BRUTE_CHAR)
        for end, cost in segments(value, i, runs, words):
            ended[end] = min(ended[end], best + EXTRA_SEGMENT + cost)
    return max(0.0, min(ended[n], brute[n]))


short_cost = lru_cache(maxsize=65_536)(cost_of)


def mentions(text: str, words: tuple[str, ...]) -> bool:
    """Whether any of the words occurs in any case: without one the patterns need not be tried."""
    low = text.lower()
    return any(w in low for w in words)


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of the fixed patterns."""
    out = []
    if mentions(text, ASSIGN_WORDS):
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def context_values(text: str) -> list[tuple[int, str]]:
    """(start, value) where a credential stands, without the punctuation after it."""
    if not mentions(text, CONTEXT_WORDS):
        return []
    return [(m.start(1), m[1].rstrip(".,;:!?)]}>")) for m in CONTEXT.finditer(text)]


def guess_spans(text: str, base: list[tuple[int, int, int, int, int]], words: Ranks = FIXED) -> list[tuple[int, int, int, int, int]]:
    """Values in credential contexts that no base span touches and that are hard to guess."""
    out, i, reach = [], 0, 0
    for s, value in context_values(text):
        e = s + len(value)
        # both lists go by start; `reach` is the furthest end of all base spans that start before e
        while i < len(base) and base[i][0] < e:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= s and guess_cost(value, words) >= MIN_COST:
            out.append((s, 3, e, s, e))
    return out


def words_of(text: str) -> set[str]:
    return {w for w in LETTERS.findall(text.lower()) if MIN_LETTERS <= len(w) <= MAX_LETTERS}


def ranked(docs: DataFrame, text_col: str = "text") -> Ranks:
    """The corpus's words by the number of documents that hold them, outside of their own context values."""
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for b in it:
            for x in b.column(0):
                text = x.as_py() or ""
                held.update(words_of(text).difference(*(words_of(v) for _, v in context_values(text))))
                if len(held) > HELD_COUNTS:
                    yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
                    held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    counts = docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = saved(counts.where(F.col("n") >= MIN_WORD_DOCS))
    # The driver gets how many words have each number, then only those that fit; a number whose words don't all fit is left out.
    least, total = None, 0
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect():
        total += r.words
        if total > MAX_WORDS:
            break
        least = r.n
    top = counts.where(F.col("n") >= F.lit(least)).collect()
    return Ranks(tuple(r.word for r in sorted(top, key=lambda r: (-r.n, r.word))))


def joined(spans: list[tuple[int, int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


SCAN = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, "
        "hardest double")


def scan(docs: DataFrame) -> DataFrame:
    """Spans of every document, one row for each row of (doc_id, text)."""
    names = [c.split()[0] for c in SCAN.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
    known = docs.sparkSession.sparkContext.broadcast(ranked(docs))

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                more = guess_spans(text, base, known.value)
                n = [sum(x[1] == k for x in base) for k in range(3)]
                costs = [guess_cost(text[x[3]:x[4]], known.value) for x in (*base, *more) if x[1] in (0, 3)]
                rows.append((doc, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + more)),
                             len(more), max(costs, default=None)))
            cols = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, SCAN)


MARK = "[REDACTED]"


def redacted(text: str | None, words: Ranks = FIXED) -> str | None:
    """The text with every found value replaced by ``MARK``; spans that touch become one."""
    if not text:
        return text
    base = base_spans(text)
    found = sorted((x[3], x[4]) for x in base + guess_spans(text, base, words))
    if not found:
        return text
    out, at, i = [], 0, 0
    while i < len(found):
        s, e = found[i]
        while i + 1 < len(found) and found[i + 1][0] < e:
            i += 1
            e = max(e, found[i][1])
        out += [text[at:s], MARK]
        at, i = e, i + 1
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with the secrets in ``text_col`` replaced; where it exists, n_chars follows."""
    at = docs.columns.index(text_col)
    known = docs.sparkSession.sparkContext.broadcast(ranked(docs, text_col))

    def clean(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            new = pa.array([redacted(x.as_py(), known.value) for x in b.column(at)], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([new if i == at else b.column(i) for i in range(b.num_columns)], schema=b.schema)

    out = docs.mapInArrow(clean, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
