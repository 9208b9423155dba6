"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram's vector binds its
letters' vectors, each turned by its place in the trigram, by multiplication; a
text's vector bundles (sums) those of its trigrams, and a language's prototype
those of its texts. A text gets the language whose prototype has the greatest
cosine with it. What all prototypes have in common is taken off both sides first,
since it tells nothing apart.

Bundling is linear, so a task sums trigram counts for each language and binds
once; tasks' sums are added up before they meet. The model is one vector for each
language. Letters are any letters, in lower case; further scripts share symbols.

Defined results: a null text and one without a letter are ``und`` with score 0, as
is every text where nothing could be learned; ties go to the smaller name; a null
doc_id counts as empty text for the fold; repeated rows have equal results; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM, SEED, SYMBOLS = 1024, 20_240_229, 64
#: Trigram vectors that a worker keeps; rarer ones are bound again.
KEPT = 16_384


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """A symbol for each code point: 0 for what isn't a letter, 1 to 26 for a to z, the rest shared out."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(sys.maxunicode + 1):
        if chr(i).isalpha():
            out[i] = i - 96 if 97 <= i <= 122 else 27 + i % (SYMBOLS - 27)
    return out


class Vectors:
    """Trigram vectors, bound when first met."""

    def __init__(self) -> None:
        rng = np.random.default_rng(SEED)
        letters = rng.choice(np.array([-1, 1], np.int8), (SYMBOLS, DIM))
        self.turned = [np.roll(letters, 2, axis=1), np.roll(letters, 1, axis=1), letters]
        self.row = np.full(SYMBOLS**3, -1, np.int32)
        self.kept = np.zeros((KEPT, DIM), np.float32)
        self.n = 0

    def bind(self, trigrams: np.ndarray) -> np.ndarray:
        a, b, c = self.turned
        return (a[trigrams // SYMBOLS**2] * b[trigrams // SYMBOLS % SYMBOLS] * c[trigrams % SYMBOLS]).astype(np.float32)

    def bundle(self, trigrams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors, each as often as it was counted."""
        new = trigrams[self.row[trigrams] < 0][:KEPT - self.n]
        if len(new):
            self.kept[self.n:self.n + len(new)] = self.bind(new)
            self.row[new] = np.arange(self.n, self.n + len(new))
            self.n += len(new)
        at = self.row[trigrams]
        known = at >= 0
        out = counts[known].astype(np.float32) @ self.kept[at[known]]
        if not known.all():
            out += counts[~known].astype(np.float32) @ self.bind(trigrams[~known])
        return out


@lru_cache(maxsize=1)
def vectors() -> Vectors:
    return Vectors()


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of symbols and their counts; what isn't a letter parts words."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    s = np.concatenate([[0], symbols()[points], [0]]).astype(np.int64)
    if not s.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = s[np.r_[True, (s[1:] > 0) | (s[:-1] > 0)]]
    return np.unique(s[:-2] * SYMBOLS**2 + s[1:-1] * SYMBOLS + s[2:], return_counts=True)


def held_out():
    """Documents that nothing is learned from."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 4 == 2


def learn(docs: DataFrame) -> dict[str | None, np.ndarray]:
    """A unit prototype for each language of (text, lang), and under None what they have in common."""
    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in it:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                which, counts = trigrams(text.as_py())
                if len(which):
                    if lang not in total:
                        total[lang] = np.zeros(SYMBOLS**3)
                    total[lang][which] += counts / counts.sum()
        for lang, counts in total.items():
            which = np.flatnonzero(counts)
            vector = sum((vectors().bundle(which[i:i + KEPT], counts[which[i:i + KEPT]]).astype(float)
                          for i in range(0, len(which), KEPT)), np.zeros(DIM))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(range(DIM), pa.int32()), pa.array(vector)],
                                             names=["lang", "i", "x"])

    rows = (docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(sums, "lang string, i int, x double")
            .groupBy("lang", "i").agg(F.sum("x").alias("x")).collect())
    found: dict[str, np.ndarray] = {}
    for lang, i, x in rows:
        found.setdefault(lang, np.zeros(DIM))[i] = x
    unit = {k: v / np.linalg.norm(v) for k, v in sorted(found.items()) if v.any()}
    return unit | {None: np.mean(list(unit.values()), axis=0) if len(unit) > 1 else np.zeros(DIM)}


def predict(docs: DataFrame, model: dict[str | None, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of (doc_id, text); the score is the cosine, at least 0."""
    langs = [k for k in model if k is not None]
    common = model[None].astype(np.float32)
    own = np.array([model[k] - model[None] for k in langs]).reshape(-1, DIM)
    own = (own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            names, scores = [], []
            for text in b.column(1):
                which, counts = trigrams(text.as_py())
                if not len(which) or not langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                v = sum((vectors().bundle(which[i:i + KEPT], counts[i:i + KEPT]) for i in range(0, len(which), KEPT)),
                        np.zeros(DIM, np.float32))
                v = v / max(float(np.linalg.norm(v)), 1e-12) - common
                cos = own @ v / max(float(np.linalg.norm(v)), 1e-12)
                best = int(np.argmax(cos))
                names.append(langs[best])
                scores.append(min(1.0, max(0.0, float(cos[best]))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    return (docs.select(F.col("doc_id").cast("long"), "text", held_out().alias("held_out"))
            .mapInArrow(each, "doc_id long, held_out boolean, lang_pred string, score double"))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents of three folds and predict all of them."""
    return predict(docs, learn(docs.where(~held_out())))
