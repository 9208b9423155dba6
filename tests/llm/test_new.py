"""Whitening, exact top-k and alignment against brute force, and on odd rows."""

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from burstlake.llm import align, ann, mtree, simhash, whitening
from burstlake.llm.queries import aligned_tokenizers

VECTORS = "vec_id long, embedding array<float>, x int, n string"
ODD = [(None, [1.0, 2.0, 3.0, 4.0]), (901, None), (902, []), (903, [1.0, None, 2.0, 3.0]), (904, [1.0, float("nan"), 0.0, 0.0]),
       (905, [float("inf"), 0.0, 0.0, 0.0]), (906, [1.0, 2.0]), (950, [0.0, 0.0, 0.0, 0.0])]


def frame(spark, pairs, kind=VECTORS):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in pairs], kind)


# -- whitening -----------------------------------------------------------------

@pytest.mark.parametrize("dim,want", [(1, 1), (5, 5), (120, 8), (90, 20)])
def test_jacobi_davidson(dim, want):
    rng = np.random.default_rng(dim)
    a = rng.standard_normal((3 * dim, dim)) * np.linspace(3, 0.5, dim)
    if dim > 50:
        a[:, 5], a[:, 7] = a[:, 4], 0
    v = a.T @ a / len(a)
    values, vectors, residuals = whitening.jacobi_davidson(lambda q: v @ q, dim, want)
    exact = np.linalg.eigvalsh(v)[::-1][:want]
    assert np.abs(values / exact - 1).max() < 1e-13 and residuals.max() < 1e-13
    assert np.abs(vectors.T @ vectors - np.eye(want)).max() < 1e-13


def test_minres():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    a, b = a + a.T, rng.standard_normal((30, 4))
    assert np.abs(a @ whitening.minres(lambda q: a @ q, b, 120, 1e-13) - b).max() < 1e-8


def test_whitening(spark):
    rng = np.random.default_rng(3)
    data = (rng.standard_normal((300, 4)) * [3, 2, 1, 0.5]).astype(np.float32)
    pairs = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    pairs += [pairs[0], ODD[0], *ODD]
    got = whitening.whitened(frame(spark, pairs)).toPandas()
    rows = np.array([v for _, v in pairs if v and len(v) == 4 and all(c is not None and math.isfinite(c) for c in v)])
    x = np.floor(64 * rows).astype(np.int64) + 1_000_000
    n, whole = len(x), len(x) * x - x.sum(axis=0)
    values, vectors = np.linalg.eigh((whole / n).T @ (whole / n) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 4 * n and set(got.n) == {n} and got.identity_error.max() < 1e-10 and got.residual.max() < 1e-13
    assert sorted(got[got.component == 1].deviation) == sorted((whole**2).sum(axis=1))
    for c in range(4):
        part = got[got.component == c + 1]
        want = np.sort(whole / n @ vectors[:, c] / math.sqrt(values[c]))
        own = np.sort(part.whitened)
        assert min(np.abs(own - want).max(), np.abs(np.sort(-own) - want).max()) < 1e-9
        assert abs(part.explained.iloc[0] / (values[c] / values.sum()) - 1) < 1e-10
    for none in ([], [(1, None)], [(i, [2.0, 3.0]) for i in range(5)]):
        assert whitening.whitened(frame(spark, none)).count() == 0
    huge = whitening.whitened(frame(spark, [(1, [1e30, 1.0]), (2, [1.0, 2.0]), (3, [2.0, 0.0])])).collect()
    assert {r.component for r in huge} == {1} and all(r.deviation is None for r in huge)


# -- exact top-k ---------------------------------------------------------------

def brute_topk(pairs, every, k):
    own = {}
    for i, v in pairs:
        if i is not None and v and len(v) == 4 and all(c is not None and math.isfinite(c) for c in v):
            own[i] = min(own.get(i, v), v)
    own = {i: [int(math.floor(256 * np.float64(np.float32(c)))) for c in v] for i, v in own.items()}
    out = {}
    for q in (i for i in own if i % every == 0):
        best = sorted((-sum(a * b for a, b in zip(own[q], v)), i) for i, v in own.items() if i != q)[:k]
        out.update({(q, r + 1): (i, -s) for r, (s, i) in enumerate(best)})
    return out


@pytest.mark.parametrize("group,page", [(16_384, 256), (40, 8)])
def test_topk(spark, monkeypatch, group, page):
    monkeypatch.setattr(mtree, "GROUP", group)
    monkeypatch.setattr(mtree, "PAGE", page)
    rng = np.random.default_rng(6)
    pairs = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.standard_normal((400, 4)) * 0.2)]
    pairs += [(500 + i, pairs[7][1]) for i in range(60)] + [pairs[3], *ODD]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mtree.search(frame(spark, pairs), every=10, k=5).collect()}
    assert got == brute_topk(pairs, 10, 5)


def test_topk_of_few_and_large(spark):
    assert mtree.search(frame(spark, [])).count() == 0 and mtree.search(frame(spark, [(50, None)])).count() == 0
    few = [(0, [1.0, 0.0, 0.0, 0.0]), (50, [0.5, 0.5, 0.0, 0.0]), (3, [-1.0, 0.0, 0.0, 0.0]), (100, [3e7, -2e7, 1.0, 0.0])]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mtree.search(frame(spark, few)).collect()}
    assert got == brute_topk(few, 50, 5)


def test_subtree_avoids_computations():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((20, 8)) * 4000
    x = np.floor(centres[rng.integers(20, size=3000)] + rng.standard_normal((3000, 8)) * 20).astype(np.int64)
    import pyarrow as pa

    tree = mtree.Subtree(pa.Table.from_pylist(mtree.build(x, [[i] for i in range(3000)]), schema=mtree._PAGES), 8)
    for q in range(0, 3000, 300):
        want = sorted((-int(x[q] @ v), i) for i, v in enumerate(x) if i != q)[:5]
        assert tree.search(q, x[q], 5, None) == want
    assert tree.computed < 10 * 3000 / 2


# -- alignment -----------------------------------------------------------------

def brute_alignment(texts):
    paths, letters = aligned_tokenizers(), align.byte_letters()
    a_tok, b_tok = Tokenizer.from_file(paths.a), sentencepiece.SentencePieceProcessor(model_file=paths.b)
    a_tok.encode_special_tokens = True
    found, count = [], Counter()
    for t in texts:
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        ab = [bytes(letters[c] for c in a_tok.id_to_token(i)) for i in a]
        bb = [bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not t or not b"".join(ab) == b"".join(bb) == (" " + t).encode():
            found.append(None)
            continue
        ea, eb = ([0, *itertools.accumulate(map(len, x))] for x in (ab, bb))
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if ea[i] < eb[j + 1] and eb[j] < ea[i + 1]]
        cuts = sorted(set(ea) & set(eb))
        groups = ";".join(f"{','.join(str(a[i]) for i in range(len(a)) if lo <= ea[i] < hi)}|{','.join(str(b[j]) for j in range(len(b)) if lo <= eb[j] < hi)}"
                          for lo, hi in itertools.pairwise(cuts))
        found.append((len(a), len(b), len(cuts) - 1, links, hashlib.sha256(groups.encode()).hexdigest()))
        count.update(links)
    best = {}
    for (_, y), c in count.items():
        best[y] = max(best.get(y, 0), c)
    return [(0,) * 6 + ("",) if f is None else (*f[:3], len(f[3]), sum(count[p] == best[p[1]] for p in f[3]), sum(count[p] for p in f[3]), f[4]) for f in found]


def test_alignment(spark, monkeypatch):
    rng = random.Random(4)
    words = ["hello", "world", "naïve", "日本語", "<|endoftext|>", "</s>", "12345", "á", "don't", "😀", "▁", "x\ty", "\n\n", " ", "Straße", "ﬁ", "\x00", "ŋ̊", "the"]
    texts = [None, "", " ", "a", "  two  spaces ", "▁", "tab\tand\r\nline", "the " * 400] + [
        rng.choice(["", " "]).join(rng.choice([" ", "", "  "]) + rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    texts += texts[10:20]
    df = spark.createDataFrame([(None if i == 12 else i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, block string")
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = sorted((-1 if i == 12 else i, *v) for i, v in enumerate(brute_alignment(texts)))
    monkeypatch.setattr(align, "BLOCK_BYTES", 2_000)
    got = align.alignment(df.repartition(3), aligned_tokenizers()).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, *(r[c] for c in names)) for r in got) == want
    assert align.alignment(df.limit(0), aligned_tokenizers()).count() == 0
    table = {(r.a, r.b): r.links for r in align.pair_table(df, aligned_tokenizers()).collect()}
    assert sum(table.values()) == sum(v[4] for v in want)


def test_ranks_are_the_same_vocabulary():
    """Where texts go the fast way their ids are those of A: letters, spaces and marks below U+0250 in many settings."""
    tok = align.Tokenizers(aligned_tokenizers())
    texts = [f" a{c}b {c} {c}{c}\n{c}1 {c}'s x{c}. {c}" for c in map(chr, range(0x250))]
    assert tok.encode_a(texts) == [e.ids for e in tok.a.encode_batch(texts, add_special_tokens=False)]


# -- nearest neighbours of very large and very small vectors --------------------

def test_nearest_of_mixed_scales(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 4)).astype(np.float32)
    x[5, 0], x[6], x[100, 2], x[200] = 1e25, x[6] * np.float32(1e-30), 3e18, x[200] * np.float32(1e6)
    pairs = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    got = ann.search(frame(spark, pairs), every=20, k=10).collect()
    own = x.astype(np.float64)
    for q in range(0, 300, 20):
        d = np.sqrt(((own - own[q]) ** 2).sum(axis=1))
        want = [int(i) for i in np.lexsort((np.arange(300), d)) if i != q][:10]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert len(mine) == 10 and len({v for _, v, _ in mine} & set(want)) >= 9
        assert all(s == d[v] for _, v, s in mine)


# -- near duplicates: what is moved, and buckets of any size ---------------------

def varied(rng, base, share):
    return [f"x{rng.randrange(10 ** 6)}" if rng.random() < share else w for w in base]


def test_whole_sets_are_no_step_table(spark):
    """Step tables of the near-duplicate stage, counters aside, stay well below the texts."""
    import os

    import pyarrow.parquet as pq

    from burstlake.scale import shared_dir

    rng = random.Random(3)
    texts = []
    for f in range(40):
        base = [f"f{f}w{rng.randrange(10 ** 6)}" for _ in range(500)]
        texts += [" ".join(varied(rng, base, 0.004)) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    top = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(os.listdir(top))
    assert 40 <= simhash.drop_near_duplicates(docs).count() < 60
    size = 0
    for d in set(os.listdir(top)) - before:
        parts = [f"{top}/{d}/{f}" for f in os.listdir(f"{top}/{d}") if f.endswith(".parquet")]
        if parts and "counts" not in pq.read_schema(parts[0]).names:
            size += sum(map(os.path.getsize, parts))
    assert size < sum(map(len, texts)) / 4


@pytest.mark.parametrize("small", [1, 8])
def test_similar_groups_in_buckets_of_any_size(spark, monkeypatch, small):
    """A large group of near copies, texts around a common passage, short texts and odd ones, against all pairs."""
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    base, passage = words(120), words(60)
    texts = [" ".join(varied(rng, base, rng.choice((0.005, 0.01, 0.03)))) for _ in range(60)]
    texts += [" ".join(passage + words(rng.choice((2, 4, 20)))) for _ in range(50)]
    texts += ["one two", "one two three four five six", "one two three four five six", "", None]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").split() for t in texts)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect())
    assert got == sorted(set(root)) and 3 < len(got) < len(texts) - 20


def test_bitmaps_never_differ_more_than_their_sets():
    rng = np.random.default_rng(2)
    for n, m, shared in ((1, 1, 1), (40, 45, 39), (500, 520, 300), (700, 30, 30), (3000, 2900, 2800), (0, 5, 0)):
        h = rng.integers(0, 1 << 63, n + m - shared).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        x, y = (np.frombuffer(simhash.bitmap(np.unique(v)), np.uint8) for v in (h[:n], h[n - shared:]))
        assert simhash.least_difference(x, y) == simhash.least_difference(y, x) <= n + m - 2 * shared
    h = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    x, y = (np.frombuffer(simhash.bitmap(np.unique(v)), np.uint8) for v in (h[:500], h[500:]))
    assert simhash.least_difference(x, y) > 1000 / 9
