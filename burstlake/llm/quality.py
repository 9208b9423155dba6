"""Quality rules: word and line statistics, and how many documents of a host share a line.

Base rules need the document alone: word counts, symbols, repeated lines, and
words in 5-word windows that the text holds twice or more.

The method looks across documents. Lines are normalised (tabs and carriage returns
are spaces, outer spaces go) and hashed; for each host and line the distinct documents
(distinct texts: exact copies are one) are counted. A line that more than ``MAX_DOCS``
documents of a host share is removed, and a document that keeps less than
``MIN_KEPT_PERCENT`` of its characters is depleted and rejected. Edited copies are
documents of their own here, so lines that many of them share go; removing
near-duplicates is a stage of its own.

Only DataFrame functions are used. One scan makes a narrow table (statistics and
a hash and a length for each line) in the shared folder; the rest works on that. Counts
are combined before each shuffle and spread by (host, text, line) first, so neither a
large host nor a common line meets in one task.

Defined results: a null text has no words and fails (n_words < 10); a null host
is a host of its own; repeated rows are judged each, with equal results; an empty
table gives an empty result; further columns are ignored by ``judge`` and kept by
``keep_good``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burstlake.llm.common import SPACE, free_name, saved

WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Documents of a host that may share a line, and the percentage of its characters that a document must keep.
MAX_DOCS, MIN_KEPT_PERCENT = 20, 20
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


def words_in(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def plain_line(line: Column) -> Column:
    return F.trim(F.replace(F.replace(line, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" ")))


def line_hash(line: Column) -> Column:
    """60 bits of the normalised line's MD5."""
    return F.conv(F.substring(F.md5(plain_line(line)), 1, 15), 16, 10).cast("long")


def window_at(i: Column, join) -> Column:
    """The words from place ``i`` (from 0) on, put together by ``join``."""
    return join(*(F.get("words", i + k) for k in range(WINDOW)))


def alike(name: str, field: str):
    """Whether a struct in the sorted array ``name`` equals a neighbour in ``field``."""
    def same(x: Column, i: Column) -> Column:
        before, after = F.get(name, i - 1), F.get(name, i + 1)
        return F.coalesce(x[field] == before[field], F.lit(False)) | F.coalesce(x[field] == after[field], F.lit(False))

    return same


def repeated_words(docs: DataFrame) -> DataFrame:
    """Add n_repeat_words to rows with ``words`` and ``n_words``; drops what it needs in between.

    Windows are hashed. If the hashes are distinct, so are the windows. Else they are
    sorted, and those with equal hashes are sorted once more as text, so that equal
    windows are neighbours.
    """
    def none(kind: str) -> Column:
        return F.array().cast(f"array<{kind}>")

    out = docs.withColumn("hashes", F.when(F.col("n_words") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: window_at(i, F.xxhash64))).otherwise(none("bigint")))
    out = out.withColumn("spots", F.when(
        F.size(F.array_distinct("hashes")) < F.size("hashes"),
        F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .otherwise(none("struct<h:bigint,i:int>")))
    out = out.withColumn("texts", F.sort_array(F.transform(
        F.filter("spots", alike("spots", "h")),
        lambda x: F.struct(window_at(x["i"], lambda *w: F.concat_ws(" ", *w)).alias("w"), x["i"].alias("i")))))
    out = out.withColumn("places", F.sort_array(F.transform(F.filter("texts", alike("texts", "w")), lambda x: x["i"])))
    gain = F.transform("places", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("places", i + 1) - p, F.lit(WINDOW))))
    out = out.withColumn("n_repeat_words", F.aggregate(gain, F.lit(0).cast("long"), lambda a, g: a + g.cast("long")))
    return out.drop("hashes", "spots", "texts", "places")


def without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def statistics(docs: DataFrame, host: str = "source") -> DataFrame:
    """One narrow row for each document: base counts and (hash, characters) of its lines with a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"),
                      F.xxhash64(text).alias("th"), text.alias("t"))
    out = out.select(
        "doc_id", "host", "th", words_in(F.col("t")).alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        (F.octet_length("t") - F.octet_length(without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"))
    out = out.select(
        "doc_id", "host", "th", "words", "n_symbols", F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("lines", lambda x: F.struct(
            line_hash(x).alias("h"), F.length(x).alias("n"))).alias("marks"))
    out = repeated_words(out)
    return out.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "th", "host", "n_words", "word_chars", "n_symbols",
        "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        F.aggregate("marks", F.lit(0).cast("long"), lambda a, m: a + m["n"]).alias("line_chars"), "marks")


def common_lines(stats: DataFrame) -> DataFrame:
    """(host, h) of the lines that too many distinct documents of a host share."""
    lines = stats.select("host", "th", F.explode(F.array_distinct(F.col("marks.h"))).alias("h")).distinct()
    docs = lines.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs"))
    return docs.where(F.col("docs") > MAX_DOCS).select("host", "h")


def verdicts(stats: DataFrame) -> DataFrame:
    """Add ``removed`` (line hashes, null if none) and ``kept`` to the rows of ``statistics``, without ``marks``."""
    common = common_lines(stats).select(F.col("host").alias("c_host"), F.col("h").alias("c_h"))
    lines = stats.select("row", "host", F.explode("marks").alias("m")).select("row", "host", "m.h", "m.n")
    hit = lines.join(common, F.col("host").eqNullSafe(F.col("c_host")) & (F.col("h") == F.col("c_h")))
    lost = hit.groupBy("row").agg(F.sum("n").alias("lost"), F.collect_set("h").alias("removed"))
    out = stats.drop("marks").join(lost, "row", "left")
    left = F.col("line_chars") - F.coalesce("lost", F.lit(0))
    return out.withColumn("kept", ~F.col("base_failed") & (100 * left >= MIN_KEPT_PERCENT * F.col("line_chars")))


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """Statistics and verdict of every row of (doc_id, text, host)."""
    return verdicts(saved(statistics(docs, host))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that are kept, same columns, without the lines that too many documents share.

    Where the table has n_chars, it follows the text.
    """
    judged = verdicts(saved(statistics(docs, host)))
    judged = judged.where("not kept or removed is not null").groupBy("doc_id", "th", "host").agg(
        F.first("kept").alias("kept"), F.first("removed").alias("removed"))
    th, kept, removed = (free_name(docs, n) for n in ("th", "kept", "removed"))
    found = judged.select(F.col("doc_id").alias("j_id"), F.col("th").alias("j_th"), F.col("host").alias("j_host"),
                          F.col("kept").alias(kept), F.col("removed").alias(removed))
    out = docs.withColumn(th, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    out = out.join(found, docs["doc_id"].cast("long").eqNullSafe(found["j_id"]) & (out[th] == found["j_th"])
                   & docs[host].cast("string").eqNullSafe(found["j_host"]), "left")
    out = out.where(F.coalesce(F.col(kept), F.lit(True)))
    less = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~x.rlike(WORD) | ~F.array_contains(removed, line_hash(x))), "\n")
    out = out.withColumn("text", F.when(F.col(removed).isNull(), F.col("text")).otherwise(less))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(removed).isNull(), F.col("n_chars"))
                             .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


SQL = rf"""
with d as (
  select row_number() over () as r, doc_id, source as host, md5(coalesce(text, '')) as th, coalesce(text, '') as t from documents
), w as (
  select *, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') as words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from d
), runs as (
  select r, unnest(list_transform(range(1, len(words) - {WINDOW - 2}), lambda i: {{'i': i, 'w': array_to_string(words[i:i + {WINDOW - 1}], ' ')}})) as x
  from w where len(words) >= {WINDOW}
), twice as (
  select r, x.i as i, count(*) over (partition by r, x.w) as n from runs
), rep as (
  select r, count(distinct i + k) as n_repeat_words from twice, range({WINDOW}) as o(k) where n > 1 group by r
), stats as (
  select w.r, doc_id, host, th, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
         (length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')))::bigint as n_symbols,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, lines,
         coalesce(list_sum(list_transform(lines, lambda x: length(x))), 0) as line_chars
  from w left join rep on rep.r = w.r
), lined as (
  select r, host, th, unnest(lines) as line from stats
), hashed as (
  select r, host, th, ('0x' || substr(md5(trim(replace(replace(line, chr(9), ' '), chr(13), ' '), ' ')), 1, 15))::bigint as h,
         length(line) as w from lined
), common as (
  select host, h from hashed group by host, h having count(distinct th) > {MAX_DOCS}
), lost as (
  select r, sum(w) as lost from hashed where exists (
    select 1 from common where common.h = hashed.h and common.host is not distinct from hashed.host) group by r
), judged as (
  select stats.*, coalesce(lost, 0) as lost, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed
  from stats left join lost on lost.r = stats.r
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and 100 * (line_chars - lost) >= {MIN_KEPT_PERCENT} * line_chars as kept
from judged"""
