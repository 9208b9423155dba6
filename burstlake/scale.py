"""Building blocks that keep ordered work parallel when one key is very large.

Streams are cut into segments of a fixed number of samples, frames or rows, so
no task ever holds a whole stream:

* ``with_halo``     copies the few rows a window needs from the neighbouring
                    segment, so windows partition by (key, segment);
* ``running_total`` is a prefix sum per key that range-partitions big keys;
* ``quantiles``     is an exact percentile that does the same;
* ``chain_states``  composes per-segment transfer tables of finite automata;
* ``scan_segments`` iterates a true recurrence over segments until the states
                    handed from one segment to the next stop changing.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key with at most this many rows may be handled by one task.
TASK_ROWS = 2_000_000
#: Segment summaries composed by one task in ``chain_states``.
CHAIN_FANOUT = 4096


# --------------------------------------------------------------------------
# shared storage

def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only a local session without the setting gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new, unused folder path under the shared folder."""
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    Computed once (a checkpoint runs its last stage twice), columnar, with known
    size, and safe from lost executors.
    """
    path = fresh_dir(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest key (partial counts are combined map-side)."""
    row = df.groupBy(*keys).count().agg(F.max("count").alias("n")).first()
    return int(row["n"] or 0)


# --------------------------------------------------------------------------
# segments and halos

def with_halo(df: DataFrame, index: str, segment: int, before: int = 0, after: int = 0,
              out: str = "segment") -> DataFrame:
    """Give each row to its own segment and to every segment whose window needs it.

    A row at ``index`` n is needed by segments that own any of
    n - after .. n + before. ``owned`` marks the single copy to keep.
    """
    n = F.col(index)
    first = F.floor((n - F.lit(after)) / F.lit(segment)).cast("long")
    last = F.floor((n + F.lit(before)) / F.lit(segment)).cast("long")
    own = F.floor(n / F.lit(segment)).cast("long")
    return (df.withColumn(out, F.explode(F.sequence(first, last)))
              .withColumn("owned", F.col(out) == own))


def drop_halo(df: DataFrame, out: str = "segment") -> DataFrame:
    return df.where("owned").drop("owned", out)


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key matches a null key, as grouping has it; the keys are kept once."""
    renamed = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = [left[k].eqNullSafe(renamed[f"_key_{k}"]) for k in keys]
    return left.join(renamed, same, how).drop(*(f"_key_{k}" for k in keys))


def dense_segments(df: DataFrame, keys: Sequence[str], seg: str, out: str) -> DataFrame:
    """Replace segment numbers by positions among the segments that exist, so that a gap breaks no chain.

    The numbers are one row per segment; ``df`` itself is not moved when they
    are small enough to be broadcast.
    """
    number = number_rows(df.select(*keys, seg).distinct(), keys, [seg], out)
    return join_keys(df, cut_lineage(number), [*keys, seg]).drop(seg)


# --------------------------------------------------------------------------
# ranks and exact quantiles

def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column,
                  out: str, bound: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Exclusive prefix sum of ``weight`` per key in ``order`` (which must be unique).

    Keys that fit one task use a plain window. Otherwise rows are
    range-partitioned by (key, order): a big key spreads over many partitions,
    each adds the total of the partitions before it.
    """
    keys, order = list(keys), list(order)
    biggest = bound if bound is not None else largest_group(df, keys)
    before = (Window.partitionBy(*keys).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    if biggest <= task_rows:
        return df.withColumn(out, F.coalesce(F.sum(weight).over(before), F.lit(0)).cast("long"))

    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * biggest // task_rows))
    sliced = cut_lineage(
        df.withColumn("_w", weight)
          .repartitionByRange(parts, *keys, *order)
          .withColumn("_part", F.spark_partition_id()))
    sums = sliced.groupBy(*keys, "_part").agg(F.sum("_w").alias("_sum"))
    # one row per (key, partition): at most `parts` rows per key
    base = (sums.withColumn("_base", F.coalesce(
                F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part")
                                   .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                .drop("_sum"))
    local = (Window.partitionBy(*keys, "_part").orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, -1))
    return (sliced.withColumn("_local", F.coalesce(F.sum("_w").over(local), F.lit(0)))
                  .transform(join_keys, base, [*keys, "_part"])
                  .withColumn(out, (F.col("_local") + F.col("_base")).cast("long"))
                  .drop("_local", "_base", "_part", "_w"))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "n",
                bound: int | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """Dense 0-based position of each row within its key."""
    return running_total(df, keys, order, F.lit(1), out, bound, task_rows)


def quantiles(df: DataFrame, keys: Sequence[str], x: str, qs: dict[str, float],
              bound: int | None = None, task_rows: int = TASK_ROWS,
              extra: dict[str, Column] | None = None) -> DataFrame:
    """Exact interpolated quantiles per key, one row per key.

    ``bound`` states a group size known by construction; without it the group
    sizes are counted. Big groups are reduced to distinct values with counts
    (ties, however many, become one row), ranked by ``running_total``, and only
    the rows that hold a wanted rank survive. ``extra`` are plain aggregates to
    add.
    """
    return column_quantiles(df, keys, {n: (x, q) for n, q in qs.items()}, bound, task_rows, extra)


def column_quantiles(df: DataFrame, keys: Sequence[str], wanted: dict[str, tuple[str, float]],
                     bound: int | None = None, task_rows: int = TASK_ROWS,
                     extra: dict[str, Column] | None = None) -> DataFrame:
    """``quantiles`` of several columns at once: {output: (column, q)}."""
    keys = list(keys)
    plain = [c.alias(n) for n, c in (extra or {}).items()]
    biggest = bound if bound is not None else largest_group(df, keys)
    if biggest <= task_rows:
        return df.groupBy(*keys).agg(*[F.percentile(x, F.lit(q)).alias(name)
                                       for name, (x, q) in wanted.items()], *plain)
    out = df.groupBy(*keys).agg(*plain) if plain else df.select(*keys).distinct()
    for x in dict.fromkeys(x for x, _ in wanted.values()):
        part = _ranked_quantiles(df, keys, x, {n: q for n, (c, q) in wanted.items() if c == x}, task_rows)
        out = join_keys(out, part, keys, "left")
    return out.select(*keys, *wanted, *(extra or {}))


def _ranked_quantiles(df: DataFrame, keys: list[str], x: str, qs: dict[str, float],
                      task_rows: int) -> DataFrame:
    values = (df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("_v"))
                .agg(F.count("*").alias("_c")))
    totals = values.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    ranked = (running_total(cut_lineage(values), keys, ["_v"], F.col("_c"), "_lo", None, task_rows)
              .transform(join_keys, totals, keys))
    inside = lambda r: (r >= F.col("_lo")) & (r < F.col("_lo") + F.col("_c"))
    picks = []
    for name, q in qs.items():
        pos = (F.col("_n") - 1) * F.lit(q)
        picks += [F.max(F.when(inside(F.floor(pos)), F.col("_v"))).alias(f"_{name}_lo"),
                  F.max(F.when(inside(F.ceil(pos)), F.col("_v"))).alias(f"_{name}_hi"),
                  F.max(pos - F.floor(pos)).alias(f"_{name}_f"), F.max(F.ceil(pos) - pos).alias(f"_{name}_g")]
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *[
        F.when(F.col(f"_{n}_f") == 0, F.col(f"_{n}_lo").cast("double"))
        .otherwise(F.col(f"_{n}_g") * F.col(f"_{n}_lo") + F.col(f"_{n}_f") * F.col(f"_{n}_hi")).alias(n)
        for n in qs])


# --------------------------------------------------------------------------
# finite automata over segments

def chain_states(summary: DataFrame, keys: Sequence[str], seg: str, transfer: str) -> DataFrame:
    """State with which every segment is entered, given each segment's transfer table.

    ``transfer`` is an array: element e is the state after the segment when it
    is entered in state e. State 0 is the start, and a missing segment resets to
    0. Tables are composed in two levels, so no task holds more than
    ``CHAIN_FANOUT`` of them. Adds column ``entry``.
    """
    keys = list(keys)
    rows = summary.select(*keys, seg, transfer).withColumn(
        "_grp", F.floor(F.col(seg) / F.lit(CHAIN_FANOUT)).cast("long"))

    def step(acc, item, position):
        state = F.when(item[position] == acc["next"], acc["state"]).otherwise(F.lit(0))
        return F.struct(F.get(item["table"], state).alias("state"),
                        (item[position] + F.lit(1)).alias("next"))

    def start(state, position):
        return F.struct(state.cast("int").alias("state"), position.cast("long").alias("next"))

    packed = rows.groupBy(*keys, "_grp").agg(
        F.sort_array(F.collect_list(F.struct(F.col(seg).alias("pos"),
                                             F.col(transfer).alias("table")))).alias("_items"))
    first = F.col("_grp") * F.lit(CHAIN_FANOUT)
    composed = packed.withColumn("_table", F.transform(
        F.sequence(F.lit(0), F.size(F.col("_items")[0]["table"]) - F.lit(1)),
        lambda e: F.aggregate("_items", start(e, first), lambda a, i: step(a, i, "pos"),
                              lambda a: F.when(a["next"] == first + F.lit(CHAIN_FANOUT),
                                               a["state"]).otherwise(F.lit(0)))))

    def entries(items, begin):
        """Fold that keeps the state seen on entry to each item."""
        zero = F.struct(begin["state"].alias("state"), begin["next"].alias("next"),
                        F.array().cast("array<struct<pos:bigint,entry:int>>").alias("seen"))

        def merge(acc, item):
            state = F.when(item["pos"] == acc["next"], acc["state"]).otherwise(F.lit(0))
            return F.struct(F.get(item["table"], state).alias("state"),
                            (item["pos"] + F.lit(1)).alias("next"),
                            F.array_append(acc["seen"], F.struct(
                                item["pos"].alias("pos"), state.cast("int").alias("entry"))
                            ).alias("seen"))
        return F.aggregate(items, zero, merge, lambda a: a["seen"])

    per_key = composed.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("_grp").alias("pos"),
                                             F.col("_table").alias("table")))).alias("_grps"))
    grp_entry = (per_key
                 .select(*keys, F.explode(entries(F.col("_grps"),
                                                  start(F.lit(0), F.col("_grps")[0]["pos"]))).alias("_e"))
                 .select(*keys, F.col("_e.pos").alias("_grp"), F.col("_e.entry").alias("_ge")))
    return (join_keys(packed, grp_entry, [*keys, "_grp"])
            .select(*keys, F.explode(entries(F.col("_items"), start(F.col("_ge"), first))).alias("_e"))
            .select(*keys, F.col("_e.pos").alias(seg), F.col("_e.entry").alias("entry")))


# --------------------------------------------------------------------------
# true recurrences over segments

State = list[float]
Step = Callable[[pd.DataFrame, "State | None"], tuple[pd.DataFrame, State]]


def scan_segments(df: DataFrame, keys: Sequence[str], seg: str, step: Step, schema: T.StructType,
                  tol: float = 0.0, first_state: DataFrame | None = None,
                  return_states: bool = False, warm: int = 0, order: str | None = None):
    """Run ``step`` over the segments of each key in order, all segments at once.

    Round one enters every segment cold. Each later round re-enters only the
    segments whose predecessor left a different state; a round settles at least
    one more segment per key, so with ``tol`` = 0 the loop ends with the same
    result as a sequential run, usually after two or three rounds. With a ``tol``
    states within that relative difference count as equal.
    ``step(rows, state)`` gets one segment in the order of its caller's sort and
    returns (output rows, state as a list of doubles).

    A state that forgets needs no rounds: with ``warm``, each run of ``warm`` segments is walked
    through in one task after the ``warm`` segments before it (so a row is copied once, however many these
    are), which gives the states its segments are entered with and left in; ``order`` is what ``step`` sorts by.
    Round one then has settled all segments whose state has forgotten how their warm-up began, and the
    comparison with what predecessors left finds the others. They are re-entered too, and a task then goes on
    through the run as long as segments are entered otherwise than before. A run streams through its task, which holds one
    segment, and is twice as long in each round: a state that never forgets takes as many rounds as its number of segments has digits.

    ``df`` is read once per round: pass a table or a checkpointed DataFrame.
    """
    keys = list(keys)
    by = [*keys, seg]
    fields = {f.name: f for f in df.schema.fields}
    state_schema = T.StructType([fields[k] for k in by] + [T.StructField("state", T.ArrayType(T.DoubleType()))])

    def entry_of(states: pd.DataFrame):
        if len(states) and states["state"].iloc[0] is not None:
            return [float(v) for v in states["state"].iloc[0]]
        return None

    def emit(key, rows, states):
        if not len(rows):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        out, _ = step(rows, entry_of(states))
        return out

    pair = T.StructType([*state_schema.fields[:-1], *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("entry", "exit"))])

    def to_next(states):
        moved = states.select(*keys, (F.col(seg) + 1).alias(seg), F.col("exit").alias("state"))
        return moved if first_state is None else moved.unionByName(
            first_state.select(*by, "state"))

    def agree(a, b):
        return len(a) == len(b) and all(abs(x - y) <= tol * max(abs(x), abs(y)) for x, y in zip(a, b))

    def walk(batches):
        """From each segment with a fresh entry on, through its run until a segment was entered like that already."""
        ident, pieces, state, found = None, [], None, []

        def finish():
            nonlocal state
            if ident is None:
                return
            entry, fresh, again = (pieces[0][c].iloc[0] for c in ("entry", "fresh", "again"))
            if state is None and not again or state is not None and entry is not None and agree(state, entry):
                state = None
                return
            enter = [float(v) for v in fresh] if state is None and fresh is not None else state
            rows = pd.concat(pieces, ignore_index=True).drop(columns=["_run", "entry", "fresh", "again"])
            state = list(step(rows, enter)[1])
            found.append((*ident[:-1], enter, state))

        for pdf in batches:
            if not len(pdf):
                continue
            codes = np.stack([pd.factorize(pdf[c])[0] for c in [*keys, seg]])
            starts = [0, *(1 + np.flatnonzero((np.diff(codes, axis=1) != 0).any(axis=0))).tolist()]
            for a, b in zip(starts, [*starts[1:], len(pdf)]):
                here = tuple(None if pd.isna(v) else v for v in (pdf[c].iloc[a] for c in [*keys, seg, "_run"]))
                if here == ident:
                    pieces.append(pdf.iloc[a:b])
                    continue
                finish()
                if ident is None or here[:-2] != ident[:-2] or here[-1] != ident[-1]:
                    state = None
                ident, pieces = here, [pdf.iloc[a:b]]
            yield pd.DataFrame(found, columns=pair.names)
            found = []
        finish()
        yield pd.DataFrame(found, columns=pair.names)

    def walked(rows, known, run):
        """``known``: the segments of ``rows``; ``again`` marks those to enter with ``fresh``. A run streams through one task."""
        return cut_lineage(join_keys(rows, known, by).withColumn("_run", run).repartition(*keys, "_run")
                           .sortWithinPartitions(*keys, "_run", seg).mapInPandas(walk, pair))

    present = cut_lineage(df.select(*by).distinct())
    if first_state is None and not return_states and largest_group(present, keys) <= 1:
        # every key fits one segment: nothing is handed on
        def alone(key, rows):
            return step(rows, None)[0]
        return df.groupBy(*by).applyInPandas(alone, schema)
    if warm and order and first_state is None:
        # segments are numbered without gaps
        states = _warmed(df, keys, seg, step, pair, warm, order, present)
    else:
        none = F.lit(None).cast("array<double>")
        begun = present if first_state is None else join_keys(present, first_state.select(*by, "state"), by, "left")
        states = walked(df, begun.select(*by, none.alias("entry"), (none if first_state is None else F.col("state")).alias("fresh"),
                                         F.lit(True).alias("again")), F.col(seg))
    length = max(1, warm)
    while True:
        proposed = join_keys(to_next(states), present, by, "left_semi")
        close = F.forall(F.arrays_zip(F.col("_new.state").alias("a"), F.col("_old.entry").alias("b")),
                         lambda p: F.abs(p["a"] - p["b"]) <= F.lit(tol) * F.greatest(F.abs(p["a"]), F.abs(p["b"])))
        same = (F.col("_old.entry").isNotNull()
                & (F.size("_new.state") == F.size("_old.entry")) & close)
        changed = cut_lineage(
            proposed.alias("_new").join(states.alias("_old"), [
                F.col(f"_new.{k}").eqNullSafe(F.col(f"_old.{k}")) for k in by], "left")
            .where(~F.coalesce(same, F.lit(False)))
            .select(*[F.col(f"_new.{c}") for c in [*by, "state"]]))
        if changed.isEmpty():
            break
        run = F.floor(F.col(seg) / F.lit(length)).cast("long")
        length *= 2
        concerned = changed.groupBy(*keys, run.alias("_run")).agg(F.min(seg).alias("_least"))
        inside = lambda rows: (join_keys(rows.withColumn("_run", run), concerned, [*keys, "_run"])
                               .where(F.col(seg) >= F.col("_least")).drop("_run", "_least"))
        redone = walked(inside(df), join_keys(inside(states).drop("exit"), changed.withColumnRenamed("state", "fresh"), by, "left")
                        .withColumn("again", F.col("fresh").isNotNull()), run)
        states = cut_lineage(join_keys(states, redone.select(*by), by, "left_anti").unionByName(redone))
    entries, exits = (states.select(*by, F.col(c).alias("state")) for c in ("entry", "exit"))
    out = df.groupBy(*by).cogroup(entries.groupBy(*by)).applyInPandas(emit, schema)
    return (out, exits) if return_states else out


def _warmed(df: DataFrame, keys: Sequence[str], seg: str, step: Step, schema: T.StructType, warm: int, order: str,
            present: DataFrame) -> DataFrame:
    """States (keys, seg, entry, exit) of each segment; the entry is null for the first of a key.

    ``warm`` segments at a time run in one task, after the ``warm`` ones before them; where that begins with a
    key's first segment the states are exact.
    """
    own = F.floor(F.col(seg) / F.lit(warm)).cast("long")
    ahead = df.withColumn("_run", F.explode(F.array(own, own + 1)))
    wanted = present.select(*keys, own.alias("_run")).distinct()
    ahead = join_keys(ahead, wanted, [*keys, "_run"], "left_semi")

    def run(key, rows):
        state, found = None, []
        for at, part in rows.groupby(seg):
            entry = state
            _, state = step(part.sort_values(order), entry)
            state = list(state)
            if at // warm == key[-1]:
                found.append((*key[:-1], at, entry, state))
        return pd.DataFrame(found, columns=schema.names)

    return cut_lineage(ahead.groupBy(*keys, "_run").applyInPandas(run, schema))


# --------------------------------------------------------------------------
# neighbours in order, islands

def lagged(df: DataFrame, keys: Sequence[str], order: Sequence, previous: dict[str, str],
           bound: int | None = None, task_rows: int = TASK_ROWS, segment: int = 65_536) -> DataFrame:
    """Add columns holding the previous row's values: ``{new column: source column}``.

    ``order`` must be unique within a key. Keys too big for one task are numbered
    first and then cut into segments that overlap by one row.
    """
    keys = list(keys)
    biggest = bound if bound is not None else largest_group(df, keys)
    if biggest <= task_rows:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({new: F.lag(src).over(w) for new, src in previous.items()})
    numbered = number_rows(df, keys, order, "_n", biggest, task_rows)
    w = Window.partitionBy(*keys, "_seg").orderBy("_n")
    halo = with_halo(numbered, "_n", segment, before=1, out="_seg")
    return drop_halo(halo.withColumns({new: F.lag(src).over(w) for new, src in previous.items()}),
                     "_seg").drop("_n")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence, previous: dict[str, str],
            is_new: Column, out: str = "island", bound: int | None = None,
            task_rows: int = TASK_ROWS) -> DataFrame:
    """Number the groups of consecutive rows that ``is_new`` (over lagged columns) starts."""
    biggest = bound if bound is not None else largest_group(df, list(keys))
    prev = lagged(df, keys, order, previous, biggest, task_rows)
    flagged = prev.withColumn("_new", F.when(F.coalesce(is_new, F.lit(True)), 1).otherwise(0))
    before = running_total(flagged, keys, order, F.col("_new"), out, biggest, task_rows)
    return before.withColumn(out, F.col(out) + F.col("_new")).drop("_new", *previous)


def top_k(df: DataFrame, k: int, order: Sequence, keys: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows in ``order``, overall or per key (partial limits come before the shuffle)."""
    if not keys:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
