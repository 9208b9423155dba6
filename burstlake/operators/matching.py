"""Truth against decode log: exact, nearest, claims, false alarms, intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.messages import strip
from ..scale import cut_lineage, join_keys

RUN = ("run_id",)


def message_tokens(message: Column) -> Column:
    """The whole message and each of its words, once."""
    m = strip(message)
    return F.array_distinct(F.array_append(F.split(m, r"\s+"), m))


def match_exact(truth: DataFrame, log: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Add ``exact_line``: first log row whose message is, or contains as a word, truth.msg.

    The log is reduced to one row per word before the join, so a word that
    fills the log costs a partial aggregate, not a row per pair.
    """
    first = (log.select(*keys, "line_no", F.explode(message_tokens(F.col("message"))).alias("msg"))
                .groupBy(*keys, "msg").agg(F.min("line_no").alias("exact_line")))
    return truth.join(first, [*keys, "msg"], "left")


def _cell(x: Column, size: float, level: int) -> Column:
    return F.floor(x * F.lit(float(2 ** level)) / F.lit(float(size))).cast("long")


def match_nearest(truth: DataFrame, log: DataFrame, freq_tol: float = 2.0, time_tol: float = 1.5,
                  keys: Sequence[str] = RUN, leaf: int = 256, max_level: int = 40) -> DataFrame:
    """Add ``near_line``: log row in the band |df| <= freq_tol, |dt| <= time_tol with the
    smallest (df/freq_tol)^2 + (dt/time_tol)^2; the earliest row wins a tie.

    Copies (equal frequency and time) are one point. Points sit in cells the size
    of the tolerances and a truth looks at its 3 x 3 cells. A cell with more than
    ``leaf`` points is not compared pair by pair: it is split in four, and of the
    parts only those that can still hold the nearest point are followed, until
    they are small. So the work per truth does not grow with a crowded cell.
    """
    keys = list(keys)
    points = (log.groupBy(*keys, F.col("freq").alias("_pf"), F.col("t_sec").alias("_pt"))
                 .agg(F.min("line_no").alias("_line")))
    asked = truth.select(*keys, F.col("freq").alias("_qf"), F.col("t_sec").alias("_qt")).distinct()
    cell = lambda level: [_cell(F.col("_pf"), freq_tol, level).alias("_cf"),
                          _cell(F.col("_pt"), time_tol, level).alias("_ct")]
    counts = lambda level: points.groupBy(*keys, *cell(level)).agg(F.count("*").alias("_c"))
    by_cell = [*keys, "_cf", "_ct"]
    by_asked = [*keys, "_qf", "_qt"]
    around = lambda c: F.explode(F.array(c - 1, c, c + 1))

    frontier = (asked.withColumn("_cf", around(_cell(F.col("_qf"), freq_tol, 0)))
                     .withColumn("_ct", around(_cell(F.col("_qt"), time_tol, 0))))
    crowded = counts(0).agg(F.max("_c").alias("m")).first()["m"] or 0
    leaves: list[tuple[int, DataFrame]] = []
    level = 0
    if crowded > leaf:
        frontier = cut_lineage(frontier.join(counts(0), by_cell))
        while level < max_level:
            leaves.append((level, frontier.where(F.col("_c") <= leaf).select(*by_cell, "_qf", "_qt")))
            wide = frontier.where(F.col("_c") > leaf)
            if wide.isEmpty():
                frontier = None
                break
            level += 1
            parts = (wide.drop("_c")
                     .withColumn("_cf", F.explode(F.array(F.col("_cf") * 2, F.col("_cf") * 2 + 1)))
                     .withColumn("_ct", F.explode(F.array(F.col("_ct") * 2, F.col("_ct") * 2 + 1)))
                     .join(counts(level), by_cell))
            s = float(2 ** level)
            u, v = F.col("_qf") / F.lit(freq_tol) * F.lit(s), F.col("_qt") / F.lit(time_tol) * F.lit(s)
            near = lambda q, c: F.greatest(c - q, q - c - 1, F.lit(0.0)) / F.lit(s)
            far = lambda q, c: F.greatest(F.abs(c - q), F.abs(c + 1 - q)) / F.lit(s)
            du, dv = near(u, F.col("_cf")), near(v, F.col("_ct"))
            fu, fv = far(u, F.col("_cf")), far(v, F.col("_ct"))
            slack = F.lit(1.0 + 1e-9)
            parts = parts.where((du <= slack) & (dv <= slack)).withColumns({
                "_lb": du * du + dv * dv,
                "_ub": F.when((fu < F.lit(1 - 1e-9)) & (fv < F.lit(1 - 1e-9)), fu * fu + fv * fv)})
            best = parts.groupBy(*by_asked).agg(F.min("_ub").alias("_best"))
            frontier = cut_lineage(
                parts.join(best, by_asked)
                     .where(F.col("_best").isNull() | (F.col("_lb") <= F.col("_best") * slack + 1e-12))
                     .drop("_lb", "_ub", "_best"))
    if frontier is not None:
        leaves.append((level, frontier.select(*by_cell, "_qf", "_qt")))

    df = F.abs(F.col("_pf") - F.col("_qf"))
    dt = F.abs(F.col("_pt") - F.col("_qt"))
    a, b = df / F.lit(freq_tol), dt / F.lit(time_tol)
    found = None
    for lvl, cells in leaves:
        pairs = (cells.join(points.select(*keys, "_pf", "_pt", "_line", *cell(lvl)), by_cell)
                      .where((df <= freq_tol) & (dt <= time_tol))
                      .select(*by_asked, F.struct((a * a + b * b).alias("d"), "_line").alias("_s")))
        found = pairs if found is None else found.unionByName(pairs)
    best = found.groupBy(*by_asked).agg(F.min("_s").alias("_s"))
    return (truth.join(best.select(*keys, F.col("_qf").alias("freq"), F.col("_qt").alias("t_sec"),
                                   F.col("_s._line").alias("near_line")),
                       [*keys, "freq", "t_sec"], "left"))


def first_claims(matched: DataFrame, log: DataFrame, claim_all: bool = True,
                 keys: Sequence[str] = RUN) -> DataFrame:
    """First truth (lowest ``truth_no``) to claim each log row: (keys, line_no, claimed_by).

    Truths claim the rows that hold their message, all of them or only the first
    (``claim_all``); truths without such a row claim their nearest row.
    """
    if claim_all:
        earliest = matched.groupBy(*keys, "msg").agg(F.min("truth_no").alias("truth_no"))
        exact = (log.select(*keys, "line_no", F.explode(message_tokens(F.col("message"))).alias("msg"))
                    .join(earliest, [*keys, "msg"]).select(*keys, "line_no", "truth_no"))
    else:
        exact = matched.where(F.col("exact_line").isNotNull()).select(
            *keys, F.col("exact_line").alias("line_no"), "truth_no")
    near = matched.where(F.col("exact_line").isNull() & F.col("near_line").isNotNull()).select(
        *keys, F.col("near_line").alias("line_no"), "truth_no")
    return exact.unionByName(near).groupBy(*keys, "line_no").agg(F.min("truth_no").alias("claimed_by"))


def claim(matched: DataFrame, claims: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Status per truth: DECODED, GARBLED (its nearest row was free) or MISSED; no second choice.

    A truth's pick does not depend on earlier picks, so a row is free exactly
    when this truth is its first claimer.
    """
    exact = F.col("exact_line").isNotNull()
    mine = (claims.withColumnRenamed("line_no", "near_line"))
    out = matched.join(mine, [*keys, "near_line"], "left")
    status = (F.when(exact, "DECODED")
               .when(F.col("claimed_by") == F.col("truth_no"), "GARBLED").otherwise("MISSED"))
    return (out.withColumn("status", status)
               .withColumn("line_no", F.when(exact, F.col("exact_line"))
                           .when(F.col("status") == "GARBLED", F.col("near_line")))
               .drop("claimed_by"))


def false_alarms(log: DataFrame, claims: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    return log.join(claims, [*keys, "line_no"], "left_anti")


def _cover(probe: DataFrame, fan: int, levels: int) -> DataFrame:
    """Add ``_nodes``: the (level, node) blocks that make up frames _a .. _b.

    A node of level l is fan^l frames. At each level the nodes up to the next
    whole parent are taken from both ends and the middle goes one level up, so a
    long interval is some 2 * fan nodes a level; the last level takes what is left.
    """
    none = F.array().cast("array<struct<level:int,node:bigint>>")

    def span(lo, hi, level):
        row = lambda n: F.struct(F.lit(level).alias("level"), n.alias("node"))
        return F.when(lo <= hi, F.transform(F.sequence(lo, hi), row)).otherwise(none)

    # whole nodes of a level within a .. b; dividing twice by fan is dividing once by fan^2
    low = lambda level: F.ceil(F.col("_a") / F.lit(fan ** level)).cast("long")
    high = lambda level: F.floor((F.col("_b") + 1) / F.lit(fan ** level)).cast("long") - 1
    pieces = []
    for level in range(levels - 1):
        more = low(level + 1) <= high(level + 1)
        pieces += [span(low(level), F.when(more, low(level + 1) * fan - 1).otherwise(high(level)), level),
                   span(F.when(more, (high(level + 1) + 1) * fan), high(level), level)]
    pieces.append(span(low(levels - 1), high(levels - 1), levels - 1))
    return probe.withColumn("_nodes", F.concat(*pieces))


def _nearest_frame(asked: DataFrame, frames: DataFrame, by: list[str], segment: int) -> DataFrame:
    """Add ``_near``: the existing frame nearest ``_pos`` on the same ``by``, the earlier one if two are.

    Frames are looked at only in segments that hold a question; what lies beyond
    comes from the first and last frame of each segment.
    """
    seg = lambda c: F.floor(F.col(c) / F.lit(segment)).cast("long").alias("_seg")
    asked = asked.select("*", seg("_pos"))
    rows = frames.select(*by, seg("frame"), F.col("frame").alias("_f"))
    where = asked.select(*by, "_seg").distinct()
    ends = rows.groupBy(*by, "_seg").agg(F.min("_f").alias("_lo"), F.max("_f").alias("_hi"))
    # what follows is what precedes in falling order: a frame to the end is summed up anew for every row
    ordered, falling = Window.partitionBy(*by).orderBy("_seg"), Window.partitionBy(*by).orderBy(F.desc("_seg"))
    around = (ends.unionByName(where, allowMissingColumns=True).groupBy(*by, "_seg")
              .agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
              .select(*by, "_seg",
                      F.last("_hi", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev"),
                      F.last("_lo", ignorenulls=True).over(falling.rowsBetween(Window.unboundedPreceding, -1)).alias("_next")))
    marks = rows.join(where, [*by, "_seg"], "left_semi").withColumn("_pos", F.col("_f").cast("double"))
    w, back = (Window.partitionBy(*by, "_seg").orderBy(o) for o in (F.asc("_pos"), F.desc("_pos")))
    looked = (asked.unionByName(marks, allowMissingColumns=True)
              .withColumn("_before", F.last("_f", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)))
              .withColumn("_after", F.last("_f", ignorenulls=True).over(back.rangeBetween(Window.unboundedPreceding, 0)))
              .where(F.col("_f").isNull()).join(around, [*by, "_seg"]))
    before, after = F.coalesce("_before", "_prev"), F.coalesce("_after", "_next")
    near = F.when(before.isNull() | (after - F.col("_pos") < F.col("_pos") - before), after).otherwise(before)
    return looked.select(*[c for c in asked.columns if c != "_seg"], near.alias("_near"))


def match_interval(truth: DataFrame, frames: DataFrame, t0: float, step: float,
                   keys: Sequence[str] = ("stream_id",), fan: int = 64, levels: int = 4,
                   segment: int = 4096) -> DataFrame:
    """Add ``frame``: the frame of largest metric on the truth's channel within
    [start, start + width], the earlier one if two are; if no frame falls inside, the
    existing frame nearest the centre.

    Frame f is at t0 + f * step. Every truth is kept; its frame is null where its
    stream and channel have no frames or start or width is null. An interval is
    cut into blocks of 1, ``fan``, fan^2 .. frames whose maxima are known, so the
    work of a truth grows with the logarithm of its width. Truths with equal
    channel, start and width are looked up once.
    """
    keys = list(keys)
    by = [*keys, "channel"]
    ident = [*by, "start", "width"]
    asked = truth.select(*ident).distinct()
    first = F.ceil((F.col("start") - t0) / F.lit(step) - F.lit(1e-9)).cast("long")
    last = F.floor((F.col("start") + F.col("width") - t0) / F.lit(step) + F.lit(1e-9)).cast("long")
    probe = _cover(asked.withColumns({"_a": first, "_b": last}).where("_b >= _a"), fan, levels)
    at = lambda level: F.floor(F.col("frame") / F.lit(fan ** level)).cast("long")
    best = (frames.select(*by, F.struct(F.col("metric_db").alias("m"), (-F.col("frame")).alias("f")).alias("_m"),
                          F.explode(F.array(*[F.struct(F.lit(v).alias("level"), at(v).alias("node"))
                                              for v in range(levels)])).alias("_n"))
            .groupBy(*by, "_n").agg(F.max("_m").alias("_m")))
    hits = (probe.select(*ident, F.explode("_nodes").alias("_n")).join(best, [*by, "_n"])
            .groupBy(*ident).agg((-F.max("_m")["f"]).alias("_hit")))
    known = cut_lineage(join_keys(asked, hits, ident, "left"))
    centre = (F.col("start") + F.col("width") / F.lit(2.0) - F.lit(t0)) / F.lit(step)
    far = known.where(F.col("_hit").isNull()).select(*ident, centre.cast("double").alias("_pos")).where("_pos is not null")
    if far.isEmpty():
        near = known.withColumn("_near", F.lit(None).cast("long"))
    else:
        near = join_keys(known, _nearest_frame(far, frames, by, segment).select(*ident, "_near"), ident, "left")
    picked = near.select(
        *ident, F.coalesce("_hit", "_near").alias("frame"), F.col("_hit").isNotNull().alias("inside"))
    return join_keys(truth, picked, ident, "left")


def attach_decodes(detections: DataFrame, decodes: DataFrame, key: str = "marker_id",
                   order: str = "line_no") -> DataFrame:
    """Detections with the message of their last decode, if any."""
    last = decodes.groupBy(key).agg(F.max_by("message", order).alias("message"))
    return (detections.join(last, key, "left")
            .withColumn("decoded", F.col("message").isNotNull()))


def match_summary(statuses: DataFrame, alarms: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Totals per run: decoded, missed, garbled, percent decoded, false alarms."""
    n = lambda s: F.count_if(F.col("status") == s)
    rows = statuses.groupBy(*keys).agg(
        F.count("*").alias("total"), n("DECODED").alias("decoded"), n("MISSED").alias("missed"),
        n("GARBLED").alias("garbled"))
    extra = alarms.groupBy(*keys).agg(F.count("*").alias("false_alarms"))
    return (rows.join(extra, list(keys), "full")
                .na.fill(0, ["total", "decoded", "missed", "garbled", "false_alarms"])
                .withColumn("percent", F.when(F.col("total") > 0, F.lit(100.0) * F.col("decoded")
                                              / F.col("total")).otherwise(0.0)))


def outcome_counts(launches: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    n = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    return launches.groupBy(*keys).agg(F.count("*").alias("launched"), n("decoded"),
                                       n("no_decode"), n("timeout"), n("error"))
