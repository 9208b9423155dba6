"""The training-data operators against brute force, and on odd rows."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from burstlake.llm import ann, chat, graph, langid, mixing, packing, quality, secrets, sharding, simhash, warc
from burstlake.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, th string, row int, `open` int"
LONG = "lorem ipsum " * 30_000


def rows(*texts):
    return [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 2}", 0, "x", 1, 2) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and very long texts, repeated rows, a null id, and columns with names the operators use."""
    base = rows(None, "", " \n\t", "one two", "The quick brown fox\njumps over the lazy dog again and again today", LONG)
    return spark.createDataFrame([*base, base[4], base[4], (None, "no id here but twelve words of text that nobody else has at all", None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- chat ----------------------------------------------------------------------

def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>user\n<|end|>\n", "\\", "\\\\|", "<\\|", "[\\INST]", "a\\n<<SYS>>", "", None, "é😀"]
    said = [(1, i, r, t) for i, (r, t) in enumerate(zip(itertools.cycle(["user", "assistant", None, "a\nb\\"]), nasty))]
    said += [(2, 0, "assistant", "tie b"), (2, 0, "assistant", "tie a"), (None, None, "assistant", "x"), (2, 0, "assistant", "tie a")]
    got = {r.conv_id: r for r in chat.conversations(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()}
    for key in (1, 2, None):
        own = sorted((x for x in said if x[0] == key), key=lambda x: (x[1] or 0, x[2] or "", x[3] or ""))
        text = "".join(f"{r or ''}\n{t or ''}\n" for *_, r, t in own)
        loss = "".join(t or "" for *_, r, t in own if r == "assistant")
        assert (got[key].n_turns, got[key].turns_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest())
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string, head string")).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <|image:1|> ", None, None, None, None, None), ("image", None, "a.png", 29, 14, None, None),
             ("audio", None, "b.wav", None, None, 2.5, None), ("document", None, "c.pdf", None, None, None, 3), ("image", None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    a, b = chat.format_turns(df).orderBy("turn").collect()
    assert a.chunk == "<|turn|>user\nsee <\\|image:1|> <|image:1|><|audio:2|><|document:3|><|image:4|><|end|>\n"
    assert [(x.position, x.kind, x.ref, x.tokens) for x in a.attachments] == [
        (1, "image", "a.png", 3), (2, "audio", "b.wav", 63), (3, "document", "c.pdf", 1536), (4, "image", None, 1)]
    assert (a.attachment_tokens, a.loss_chars, b.loss_chars, b.chunk) == (1603, 0, 0, "<|turn|>assistant\n<|end|>\n")


# -- secrets -------------------------------------------------------------------

def brute_cost(value):
    runs = secrets.repeats(value)
    best = [-secrets.EXTRA_SEGMENT] + [math.inf] * len(value)
    for i in range(len(value)):
        known = [*secrets.segments(value, i, runs), *((j, (j - i) * secrets.BRUTE_CHAR) for j in range(i + 1, len(value) + 1))]
        for j, cost in known:
            best[j] = min(best[j], best[i] + secrets.EXTRA_SEGMENT + cost)
    return max(0.0, best[-1])


def test_guess_cost_is_the_least():
    rng = random.Random(1)
    pieces = ["password", "qwerty", "2019", "12/05/1999", "aaaa", "abcabc", "x9", "$", "Tr0", "letmein", "zxcvb", "k"]
    for _ in range(200):
        v = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 5)))
        assert secrets.guess_cost(v) == pytest.approx(brute_cost(v))
    assert secrets.guess_cost("a" * 20_000) < 7


def test_base_spans():
    text = 'password: token: abcdefgh1 AKIA' + "B" * 12 + ' AKIA1 ' + "0" * 32 + ' ſecret=abcdefghij api_KEY = "qwertyui" ' + "f" * 31
    kinds = [(secrets.KINDS[k], text[s:e]) for s, k, e, *_ in secrets.base_spans(text)]
    assert kinds == [("access", "AKIA" + "B" * 12), ("hex", "0" * 32), ("assign", 'api_KEY = "qwertyui')]
    more = secrets.guess_spans("the passphrase is x9$kQ2!pLm. password was letmein1", [])
    assert [("the passphrase is x9$kQ2!pLm. "[s:e]) for s, _, e, *_ in more] == ["x9$kQ2!pLm"]


def test_secrets_odd(spark, odd, empty):
    assert secrets.scan(odd).count() == 9 and secrets.scan(empty).count() == 0
    none = hashlib.sha256(b"").hexdigest()
    assert {r.base_sha256 for r in secrets.scan(odd).collect()} == {none}
    df = spark.createDataFrame(rows('token = "1eb9c654e721b4f812088970e66a6345cee33dd6"', "plain", None), DOCS)
    out = secrets.redact(df).orderBy("doc_id").collect()
    assert [r.text for r in out] == ['token = "[REDACTED]"', "plain", None]
    assert secrets.redact(df).columns == df.columns and out[0].n_chars == len(out[0].text)


def test_cost_decides_on_context_values(spark):
    """Values of one kind of character are found; prose isn't, as its words are in other documents."""
    found = ["passphrase is xQvBnRtYpLkWzMd", "pwd: kG$!vQ@zRw#pLx", "passcode = 839201774652"]
    prose = ["the passphrase is unbelievable", "a credential was misunderstanding"]
    other = ["unbelievable misunderstanding here"] * 3
    again = ["passphrase is wertzuvbnopqa and wertzuvbnopqa once more"] * 5
    df = spark.createDataFrame(rows(*found, *prose, *other, *again), DOCS)
    got = {r.doc_id: r for r in secrets.scan(df).collect()}
    assert [got[i].n_guess for i in range(13)] == [1] * 3 + [0] * 5 + [1] * 5
    out = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert [out[i] for i in range(3)] == ["passphrase is [REDACTED]", "pwd: [REDACTED]", "passcode = [REDACTED]"]
    assert [out[3], out[4]] == prose
    assert set(secrets.ranked(df).rank) - set(secrets.RANK) == {"unbelievable", "misunderstanding", "here", "and", "once", "more", "passphrase"}


# -- packing -------------------------------------------------------------------

def check_pieces(pieces, texts, window=4096):
    tok = Tokenizer.from_file(tokenizer_path())
    ids = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]
    assert sum(p.length for p in pieces) == sum(map(len, ids))
    want = {(i, len(x)) for i, x in enumerate(ids)}
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    for i, n in want:
        at = 0
        for p in sorted(by[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, n, zlib.crc32(ids[i][at:at + p.length].tobytes()))
            at += p.length
        assert at == n
    seq = defaultdict(list)
    for p in pieces:
        seq[p.sequence_id].append(p)
    short = 0
    for own in seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        short += at & (at - 1) and window - at
    return short


def test_packing(spark, empty):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["Straße,", "l'été", "don't", "foo", "x1y2", "<|endoftext|>", "A<|endoftext|>.", "naïve!!", " a", "́b",
                                  "日本語", "İx", "a\x1cb", "\t\n"]) for _ in range(rng.choice([0, 3, 200, 3000]))) for _ in range(60)]
    texts += [None, "", LONG]
    df = spark.createDataFrame(rows(*texts), DOCS).repartition(5)
    pieces = packing.digest(packing.pack(df, tokenizer_path(), open_windows=4, merge=2)).collect()
    assert check_pieces(pieces, texts) <= 7 * len({p.sequence_id for p in pieces})
    small = packing.digest(packing.pack(df, tokenizer_path(), window=64, open_windows=2)).collect()
    check_pieces(small, texts, 64)
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_words_forget(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    import pyarrow as pa

    words, tok = packing.Words(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for t in ["a b c d", "d e, f. a", "a b", "", "q w e r t y a"]:
        ids, ends = words.encode(pa.array([t, None]))
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids and ends.tolist() == [len(ids)] * 2


# -- WARC ----------------------------------------------------------------------

def test_warc(spark):
    big, trap = "é" * 600, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(1, "u", big), (2, "u\r\nX: y", big), (3, None, None), (4, "v", trap), (5, "v", trap), (6, "w", "z" * 999), (7, "w", "z" * 999),
             (8, "u", big), (9, "a", "q" * 1000), (9, "a", "q" * 1000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, digest int")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    want = []
    for i, _, html in pages:
        data = (html or "").encode()
        top = max(p[0] for p in pages if p[2] == html)
        again = len(data) >= 1000 and i != top
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    assert got == sorted(want)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_assembly_without_partners(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string")
    warc.write(df, f"{tmp_path}/w")
    found = warc.read(spark, f"{tmp_path}/w")
    assert found.count() == 3
    alone = warc.assemble(found.where("kind <> 'request'")).collect()
    assert len(alone) == 1 and alone[0].request is None and bytes(alone[0].response.block).endswith(b"\r\n\r\nbody")
    assert warc.assemble(found.where("kind = 'request'")).count() == 0


# -- quality -------------------------------------------------------------------

def test_quality_statistics(spark, odd, empty):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(80)] + ["a#*$ %&|<> x\na#*$ %&|<> x\n\n\n", None]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows(*texts), DOCS)).collect()}
    for i, t in enumerate(texts):
        w = (t or "").split()
        windows = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        places = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if x.strip()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(places))
    assert quality.judge(odd).count() == 9 and quality.judge(empty).count() == 0
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns and quality.keep_good(empty).count() == 0
    assert {r.doc_id for r in kept.collect()} == {4, None}


def test_common_lines(spark):
    def own(i, n=10):
        return " ".join(f"w{i}x{k}" for k in range(n))

    line = "This page and all that is on it belongs to nobody in particular"
    texts = [f"{own(i)}\n{line}\n{own(-i - 1)}" for i in range(30)] + [f"{line}\nx{i}" for i in range(3)]
    copies = [f"{own('a')}\n{own('b')}"] * 60
    data = [(i, t, "en", "h", len(t), "x", 1, 2) for i, t in enumerate(texts + copies)]
    df = spark.createDataFrame(data, DOCS)
    judged = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert [judged[i] for i in range(33)] == [True] * 30 + [False] * 3 and all(judged[i] for i in range(33, 93))
    out = {r.doc_id: r for r in quality.keep_good(df).collect()}
    assert len(out) == 90 and line not in out[0].text and out[0].n_chars == len(out[0].text)
    assert out[40].text == copies[0]


def quality_fixture():
    """Templates of 3 to 20 lines, documents of 8 of the same 15 lines, edited copies of one document, exact copies."""
    rng = random.Random(12)

    def line(n=12):
        return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))

    data = []
    for n in (3, 5, 10, 20):
        shared = [line() for _ in range(n)]
        data += [("\n".join([*shared[:n // 2], line(), *shared[n // 2:]]), f"t{n}") for _ in range(60)]
    shared = [line() for _ in range(15)]
    data += [("\n".join(rng.sample(shared, 8)), "s15") for _ in range(300)]
    words = [line().split() for _ in range(5)]
    for _ in range(60):
        copy = [list(w) for w in words]
        copy[rng.randrange(5)][rng.randrange(12)] = line(1)
        data.append(("\n".join(map(" ".join, copy)), "c5"))
    text = "\n".join(line() for _ in range(6))
    return [(i, t, "en", s, len(t), "x", 1, 2) for i, (t, s) in enumerate([*data, *[(text, "e6")] * 60])]


def test_common_lines_of_templates_and_copies(spark):
    """Lines of more than 20 distinct texts of a host go, whatever else these hold; exact copies are one text."""
    data = quality_fixture()
    df = spark.createDataFrame(data, DOCS)
    texts, lines = {(s, t) for _, t, _, s, *_ in data}, defaultdict(int)
    for s, t in texts:
        for x in set(t.split("\n")):
            lines[s, x] += 1
    want = {}
    for i, t, _, s, *_ in data:
        left = [x for x in t.split("\n") if lines[s, x] <= 20]
        if 100 * sum(map(len, left)) >= 20 * sum(map(len, t.split("\n"))):
            want[i] = "\n".join(left)
    assert {r.doc_id: r.text for r in quality.keep_good(df).collect()} == want
    kept = {r.doc_id: r.kept for r in quality.judge(df).collect()}
    assert {i for i, k in kept.items() if k} == set(want)
    count = {s: sum(kept[i] for i, _, _, h, *_ in data if h == s) for s in ("t3", "t5", "t10", "t20", "s15", "c5", "e6")}
    assert count["t3"] == count["e6"] == 60 and count["t5"] == count["t10"] == count["t20"] == count["s15"] == 0


def test_quality_sql_is_the_same_rule(spark, odd):
    for df in (spark.createDataFrame(quality_fixture(), DOCS), odd):
        con = duckdb.connect()
        con.register("documents", df.toPandas())
        cur = con.execute(quality.SQL)
        names = [d[0] for d in cur.description]
        got = quality.judge(df).select(*names).collect()
        key = lambda r: (r[0] is None, *map(str, r))
        assert sorted(map(tuple, got), key=key) == sorted((tuple(None if v != v else v for v in r) for r in cur.fetchall()), key=key)


# -- mixing --------------------------------------------------------------------

def test_mixing(spark, odd, empty):
    sizes = {"a": 900, "b": 90, "c": 10}
    data = [(i, "w " * 20, "en", s, 40, "x", 1, 2) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    df = spark.createDataFrame(data, DOCS)
    used = defaultdict(int)
    for r in mixing.copies(df, entropy=0.8, repeats=100.0).collect():
        used[r.source] += r.copies * r.tokens
    p = np.array([n / 1000 for n in sizes.values()])
    h = lambda a: -sum(x * math.log(x) for x in p**a / (p**a).sum())
    low, high = 0.0, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (low, mid) if h(mid) <= 0.8 * math.log(3) else (mid, high)
    want = p**high / (p**high).sum() * 20_000
    assert all(0 <= w - used[s] < 21 for s, w in zip(sizes, want, strict=True))
    limited = defaultdict(int)
    for r in mixing.copies(df, entropy=0.99, repeats=3.0).collect():
        limited[r.source] += r.copies
    assert limited["c"] in (29, 30)
    whole = mixing.mixed(df, 0.8, 100.0, budget=None)
    assert whole.columns == df.columns and whole.select("doc_id").distinct().count() == 1000
    assert mixing.mixed(odd, budget=None).where("doc_id = 4").count() >= 3
    assert mixing.copies(empty).count() == 0 and mixing.mixed(empty, budget=None).count() == 0
    assert mixing.copies(odd).count() == 9
    alike = spark.createDataFrame([(1, "a b c", lang, "s", n, "x", 1, 2) for lang, n in (("en", 5), ("de", 6), ("de", 6), ("fr", 7))] * 2, DOCS)
    once = mixing.mixed(alike, budget=None, repeats=1.0)
    assert sorted(once.collect()) == sorted(alike.collect())  # equal ids and texts, other columns



# -- SimHash -------------------------------------------------------------------

def test_index_and_components(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = set()
    for _ in range(400):
        x = int(base[rng.integers(30)])
        for b in rng.choice(64, rng.integers(0, 7), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    for count in (len(fps), 1 << 22):
        groups = defaultdict(set)
        for r in graph.components(simhash.near_links(df, count)).collect():
            groups[r.root].add(r.node % (1 << 64))
        want = defaultdict(set)
        for x in fps:
            want[find(x)].add(x)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7)], "a long, b long")
    assert {r.root for r in graph.components(path).collect()} == {0}


def test_simhash_odd(spark, odd, empty):
    import xxhash

    words = "a b c d e f".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert simhash.fingerprint("A b\tC d\n e F") == want and simhash.fingerprint("a b") == xxhash.xxh64_intdigest("a b", 42)
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == 9
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got if r.doc_id in (0, 1, 2)} == {(i, "0" * 16, 0) for i in range(3)}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.select("doc_id").collect()) == [(False, 0), (False, 3), (False, 4), (False, 5), (True, None)]
    assert simhash.near_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def brute_groups(texts, similarity=0.8):
    """Smallest place of each text's group, by all pairs of five-word sets."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


@pytest.mark.parametrize("deal", [1_000, 3])
def test_similarity_groups(spark, monkeypatch, deal):
    monkeypatch.setattr(simhash, "DEAL", deal)
    monkeypatch.setattr(simhash, "FEW", deal)
    rng = random.Random(5)
    texts = []
    for n in (3, 30, 200, 200, 1500):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts.append(" ".join(base))
        for k in range(12):
            other = list(base)
            for i in rng.sample(range(n), min(n, 1 + k * n // 400)):
                other[i] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(other))
    texts += texts[:20] + [texts[-1].upper().replace("X", "x").replace("W", "w")]
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "doc_id long, text string, root string")
    got = sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect())
    assert got == sorted(set(brute_groups(texts))) and 10 < len(got) < 60


# -- sharding ------------------------------------------------------------------

def test_sharding(spark, odd, empty):
    table = sharding.lookup_table()
    counts = np.bincount(table, minlength=64)
    assert counts.max() - counts.min() <= 1
    small = sharding.lookup_table(("a", "b", "c"), 7)
    free, at, want = set(range(7)), 0, [None] * 7
    orders = [[(sharding._number(f"offset:{s}") + k * (sharding._number(f"step:{s}") % 6 + 1)) % 7 for k in range(7)] for s in "abc"]
    while free:
        slot = next(x for x in orders[at % 3] if x in free)
        free.discard(slot)
        want[slot], at = at % 3, at + 1
    assert small.tolist() == want
    fewer = sharding.lookup_table(sharding.SHARDS[:-1])
    assert (fewer != table)[table != 63].mean() < 0.1
    out = sharding.placements(odd).collect()
    assert len(out) == 9 and all(r.shard == sharding.SHARDS[table[r.slot]] for r in out)
    assert sharding.placements(empty).count() == 0


# -- language ------------------------------------------------------------------

def test_langid(spark, odd, empty):
    rng = random.Random(5)
    parts = {"xx": ["ba", "do", "ki", "ra"], "yy": ["éth", "ung", "sch", "öl"]}
    data = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(3)) for _ in range(40)), k, "s", 0, "x", 1, 2)
            for i, k in enumerate(["xx", "yy"] * 40)]
    out = {r.doc_id: r for r in langid.identify(spark.createDataFrame([*data, (99, "12 34!", "xx", "s", 0, "x", 1, 2)], DOCS)).collect()}
    assert all(out[i].lang_pred == k and 0 < out[i].score <= 1 for i, _, k, *_ in data)
    assert (out[99].lang_pred, out[99].score) == ("und", 0.0)
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in out)
    assert langid.identify(odd).count() == 9 and langid.identify(empty).count() == 0
    which, counts = langid.trigrams("ab  c")
    assert counts.sum() == 4
    v = langid.Vectors()
    assert np.array_equal(v.bundle(which, counts), sum(c * v.bind(np.array([t]))[0] for t, c in zip(which, counts)))


# -- neighbours ----------------------------------------------------------------

def test_ann(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x[500:1500] = x[500]
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000, None, 0), (5100, [0.0] * 24, 0), (5200, [float("nan")] * 24, 0),
                                                              (5300, [None] * 24, 0), (5400, [1.0], 0), (None, x[0].tolist(), 0), (100, x[100].tolist(), 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 100))
    hit = 0
    for q, near in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float))**2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10].tolist()
        hit += len({i for i, _ in near} & set(want))
        assert all(s == pytest.approx(d[i]) for i, s in near) and len(near) == 10
    assert hit >= 0.97 * 10 * len(got)
    few = ann.search(df.where("vec_id <= 3")).collect()
    assert [r.rank for r in sorted(few, key=lambda r: r.rank)] == [1, 2, 3]
    assert ann.search(df.limit(0)).count() == 0


# -- pipeline ------------------------------------------------------------------

def test_pipeline(spark, odd, empty, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.quality_rules(spark, docs, sf)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {p.doc_id for p in pieces} <= {r.doc_id for r in good.collect()} and pieces
    for data in (odd, empty):
        out = data
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = corpus_pipeline.saved(stage(spark, out, sf))
            assert out.columns == data.columns
        assert corpus_pipeline.STAGES[-1][1](spark, out, sf).count() >= 0


PARTS = ["password is ", "secret: ", "PASSWORD = '", "AKIA", "Q7Z4", "token=Zx9$kQ2!", "xQvBnRtYpLkWzMd", "deadbeef", "0123", " ", ", ", "\n", "İ",
         "pwd: kG$!vQ@zRw#pLx", "api_key=abcdefgh12", "apiKey:\"", "the passphrase is ", "ſecret=", "=", "a"]


def test_secrets_of_random_texts_against_the_plain_patterns():
    rng = random.Random(3)
    plain = [re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
             re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    for _ in range(2000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 40)))
        base = secrets.base_spans(text)
        assert [x[:3] for x in base] == sorted((m.start(), k, m.end()) for k, p in enumerate(plain) for m in p.finditer(text)
                                               if len(m[2] if k == 0 else m[0]) >= (8, 16, 32)[k])
        free = [(s, s + len(v), v) for s, v in secrets.context_values(text)]
        assert [(x[0], x[2]) for x in secrets.guess_spans(text, base)] == [
            (s, e) for s, e, v in free if not any(b[0] < e and s < b[2] for b in base) and secrets.cost_of(v, secrets.FIXED) >= secrets.MIN_COST]


def test_secrets_of_a_long_text_in_linear_time():
    text = "the password is hunter, token=abcdefgh12 and pwd: kG$!vQ@zRw#pLx. " * 20_000
    began = time.monotonic()
    base = secrets.base_spans(text)
    more = secrets.guess_spans(text, base)
    assert (len(base), len(more)) == (20_000, 20_000) and time.monotonic() - began < 30


def test_planted_values_are_found_and_prose_is_not(spark):
    rng = random.Random(8)
    words = "river mountain window garden thunder captain harvest lantern morning traveler whisper blanket".split()
    hard = ["".join(rng.choice("abcdefghjkmnpqrstuvwxyzABCDEFGHJKMNPQRSTUVWXYZ23456789!#%") for _ in range(14)) for _ in range(40)]
    data = [(i, f"my passphrase is {hard[i] if i < 40 else rng.choice(words)} and {' '.join(rng.choices(words, k=30))}", "en", "s", 0, "x", 1, 2)
            for i in range(400)]
    found = {r.doc_id for r in secrets.scan(spark.createDataFrame(data, DOCS)).where("n_guess > 0").collect()}
    assert found == set(range(40))


def test_langid_of_a_language_without_a_name(spark):
    parts = {"": "ba do ki ra", "yy": "éth ung sch öl"}
    rng = random.Random(6)
    data = [(i, " ".join("".join(rng.choices(parts[k].split(), k=3)) for _ in range(40)), k, "s", 0, "x", 1, 2) for i in range(40) for k in [["", "yy"][i % 2]]]
    assert all(r.lang_pred == data[r.doc_id][2] for r in langid.identify(spark.createDataFrame(data, DOCS)).collect())


def test_langid_prototypes_are_bundles_of_bound_letters(spark):
    data = [(0, "ab ba", "xx", "s", 0, "x", 1, 2), (1, "bab", "xx", "s", 0, "x", 1, 2), (2, "öl", "yy", "s", 0, "x", 1, 2)]
    model, v = langid.learn(spark.createDataFrame(data, DOCS)), langid.Vectors()
    for lang in ("xx", "yy"):
        total = np.zeros(langid.DIM)
        for text in (d[1] for d in data if d[2] == lang):
            which, counts = langid.trigrams(text)
            total += sum(c * v.bind(np.array([t]))[0].astype(float) for t, c in zip(which, counts / counts.sum()))
        assert np.allclose(model[lang], total / np.linalg.norm(total), atol=1e-5)
    assert np.allclose(model[None], (model["xx"] + model["yy"]) / 2)
