"""Mixing sources by temperature.

A source's weight is its share of all tokens to the power ``alpha``, normalised.
``alpha`` is the smallest exponent between 0 (all sources alike) and 1 (as they
are) for which the weights' entropy is no more than a target share of the
greatest possible one and no source is repeated more often than a limit; both
rise with falling alpha, so it is found by bisection. A round of it evaluates 255
exponents in one aggregate over one row per source, which halves the bracket
eight times.

A source's budget is its weight times the token budget. It is met by whole
passes over the source, then by blocks of its documents in a permuted order, and
in the block where the rest runs out by single documents, so that a source is
off by less than a document. Blocks are dealt by hash, ``BLOCKS`` for each
source, so what is put in order is ``BLOCKS`` sums and one block's narrow rows
for each source, however large it is. Without a budget, the smallest one is
taken that uses every document at least once.

Only DataFrame functions are used.

Defined results: a null text has no tokens; sources are told apart with null as
one of them; a source without tokens has weight zero and no copies, unless each
document is to be used, which gives one; repeated rows are documents of their
own, put in order after each other; an empty table gives an empty result; further
columns are ignored by ``copies`` and kept by ``mixed``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burstlake.llm.common import SPACE, free_name, saved

BLOCKS, POINTS, ROUNDS, DIGITS = 1024, 256, 4, 6
#: Target entropy as a share of the greatest, and passes over a source at most.
ENTROPY, REPEATS = 0.98, 4.0


def tokens_in(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def number(*parts: Column) -> Column:
    """60 bits of the parts' MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *parts)), 1, 15), 16, 10).cast("long")


def _fits(shares: DataFrame, low: float, high: float, entropy: float, repeats: float, budget: float | None) -> list[bool]:
    """For the exponents that cut the bracket into POINTS parts: whether entropy and repetition are within limits."""
    at = F.lit(low) + F.lit((high - low) / POINTS) * F.col("i")
    each = shares.select("p", F.explode(F.sequence(F.lit(1), F.lit(POINTS - 1))).alias("i")).withColumn("w", F.pow("p", at))
    rows = each.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("z"), F.sum(F.col("w") * F.log("p")).alias("l"),
                                 F.max(F.col("w") / F.col("p")).alias("r"),
                                 F.max(F.col("p") / F.col("w")).alias("m")).collect()
    return [math.log(x["z"]) - (low + (high - low) / POINTS * x["i"]) * x["l"] / x["z"] <= entropy * math.log(x["n"]) + 1e-12
            and x["r"] * (x["m"] if budget is None else budget / x["z"]) <= repeats for x in sorted(rows, key=lambda x: x["i"])]


def exponent(shares: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = 1.0) -> float:
    """The exponent for shares ``p`` of one row per source; ``budget`` is in units of all tokens, or
    None for the smallest that uses every source whole.

    1 where even the shares as they are break a limit.
    """
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        fits = _fits(shares, low, high, entropy, repeats, budget)
        first = fits.index(True) if True in fits else POINTS - 1
        width = (high - low) / POINTS
        low, high = low + width * first, low + width * (first + 1)
    return round(high, DIGITS)


def weights(rows: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = 1.0) -> DataFrame:
    """(src, total, weight, wanted) for each source of (source, tokens): its tokens, weight and token budget."""
    sums = saved(rows.groupBy("source").agg(F.sum("tokens").alias("total")))
    every = int(sums.agg(F.sum("total")).first()[0] or 0)
    some = sums.where("total > 0").withColumn("p", F.col("total") / F.lit(float(max(every, 1))))
    alpha = exponent(some, entropy, repeats, budget) if every else 1.0
    z, worst = some.agg(F.sum(F.pow("p", F.lit(alpha))), F.max(F.pow("p", F.lit(1 - alpha)))).first()
    whole = (z or 1.0) * (worst or 1.0) if budget is None else budget
    weight = F.when(F.col("total") > 0, F.pow(F.col("total") / F.lit(float(max(every, 1))), F.lit(alpha)) / F.lit(z or 1.0)).otherwise(0.0)
    return sums.select(F.col("source").alias("src"), "total", weight.alias("weight"),
                       F.floor(weight * F.lit(every * whole) + 0.5).cast("long").alias("wanted"))


def copies(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = 1.0,
           seed: str = "mix", row: Column | None = None) -> DataFrame:
    """(row, doc_id, source, tokens, place, copies): how often each document is used.

    ``place`` is the document's block in the permutation of its source, from 1; ``row`` a number for each row.
    """
    text = F.coalesce("text", F.lit(""))
    rows = saved(docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"),
        F.col("source").cast("string").alias("source"), tokens_in(text).alias("tokens"),
        F.pmod(number(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("block")), F.lit(BLOCKS)).alias("block")))
    name = F.coalesce("source", F.lit(""))
    order = Window.partitionBy("source").orderBy("turn", "block")
    blocks = (rows.groupBy("source", "block").agg(F.sum("tokens").alias("own"))
              .withColumn("turn", number(F.lit(seed), name, F.col("block").cast("string")))
              .withColumns({"place": F.row_number().over(order), "until": F.sum("own").over(order)}))
    share = weights(rows, entropy, repeats, budget)
    passes = F.when(F.col("total") > 0, F.floor(F.col("wanted") / F.greatest("total", F.lit(1)))).otherwise(0 if budget is not None else 1)
    plan = blocks.join(F.broadcast(share) if share.count() <= 100_000 else share, F.col("source").eqNullSafe(F.col("src")))
    rest = F.col("wanted") - F.col("passes") * F.col("total") - (F.col("until") - F.col("own"))
    plan = plan.withColumn("passes", passes.cast("long")).select(
        F.col("source").alias("b_source"), F.col("block").alias("b_block"), "place", "passes", "own", rest.alias("rest"))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
    cut = (F.col("rest") > 0) & (F.col("rest") < F.col("own"))
    whole = joined.where(~cut).withColumn("copies", F.col("passes") + F.when(F.col("rest") >= F.col("own"), 1).otherwise(0))
    inner = Window.partitionBy("source").orderBy("at", "doc_id", "th", "row").rowsBetween(Window.unboundedPreceding, 0)
    last = (joined.where(cut).withColumn("at", number(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("order")))
            .withColumn("run", F.sum("tokens").over(inner))
            .withColumn("copies", F.col("passes") + F.when(F.col("run") <= F.col("rest"), 1).otherwise(0)))
    names = ["row", "doc_id", "source", "tokens", "place", "copies"]
    return whole.select(*names).unionByName(last.select(*names))


def mixed(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = 1.0) -> DataFrame:
    """The documents as often as the mix uses them, same columns."""
    row, n, at = (free_name(docs, x) for x in ("row_number", "copies", "copy"))
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()), "zstd")
    used = copies(numbered, entropy, repeats, budget, row=F.col(row)).where("copies > 0")
    out = numbered.join(used.select(F.col("row").alias(row), F.col("copies").alias(n)), row)
    return out.withColumn(at, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n).cast("long")))).select(*docs.columns)


def weights_report(docs: DataFrame) -> DataFrame:
    """Documents with how often they are used, as the query returns them."""
    return copies(docs).select("doc_id", "source", "tokens", F.col("place").cast("long").alias("place"), "copies")


def _hash(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('/', 'mix', {', '.join(parts)})), 1, 15))::bigint"


SQL = f"""
with recursive d as (
  select row_number() over () as r, doc_id, source,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> ''))::bigint as tokens,
         {_hash("coalesce(doc_id::varchar, '')", "'block'")} % {BLOCKS} as block,
         {_hash("coalesce(doc_id::varchar, '')", "'order'")} as spot
  from documents
), sums as (
  select source, sum(tokens)::bigint as total from d group by source
), one as (
  select sum(total)::double as every, list(total / (select sum(total)::double from sums) order by total) filter (where total > 0) as p from sums
), halved(i, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select i + 1,
         case when ok then lo else (lo + hi) / 2 end, case when ok then (lo + hi) / 2 else hi end
  from (
    select i, lo, hi,
           ln(list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))))
           - (lo + hi) / 2 * list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2) * ln(x))) / list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2)))
             <= {ENTROPY} * ln(len(p)) + 1e-12
           and list_max(list_transform(p, lambda x: pow(x, (lo + hi) / 2) / x)) / list_sum(list_transform(p, lambda x: pow(x, (lo + hi) / 2))) <= {REPEATS} as ok
    from halved, one where i < 32)
), a as (
  select round(hi, {DIGITS}) as alpha from halved where i = 32
), share as (
  select source, total, floor(case when total > 0 then pow(total / every, alpha) / list_sum(list_transform(p, lambda x: pow(x, alpha))) else 0 end * every + 0.5)::bigint as wanted
  from sums, one, a
), planned as (
  select *, case when total > 0 then wanted // total else 0 end as passes from share
), blocks as (
  select source, block, sum(tokens)::bigint as own, {_hash("coalesce(source, '')", "block::varchar")} as turn from d group by source, block
), placed as (
  select *, row_number() over w as place, sum(own) over w as until from blocks window w as (partition by source order by turn, block)
), plan as (
  select placed.source, block, place, passes, own, wanted - passes * total - (until - own) as rest
  from placed join planned on placed.source is not distinct from planned.source
), j as (
  select d.*, place, passes, own, rest, sum(tokens) over (partition by d.source, d.block order by spot, doc_id, r rows unbounded preceding) as run
  from d join plan on d.source is not distinct from plan.source and d.block = plan.block
)
select doc_id, source, tokens, place::bigint as place,
       (passes + case when rest >= own then 1 when rest <= 0 then 0 when run <= rest then 1 else 0 end)::bigint as copies
from j"""
