"""Baselines, gates and the flagship detection chain on the hour x channel grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from burstlake.functions import numeric as num
from burstlake.operators import baseline as base
from burstlake.operators import gates
from burstlake.plans import detection as det

from .bindings import HEAT, heat

CFG = det.DetectConfig(floor=30.0, cooldown_frames=6)
DB = 4


def r(col, places=6):
    return F.round(col, places) + F.lit(0.0)


def detections(spark, sf):
    return det.detect(heat(spark, sf), CFG).select(
        "frame", "channel", r(F.col("lin")).alias("lin"), r(F.col("metric_db"), DB).alias("metric_db"),
        "fc_hz")


BASELINE = HEAT + """,
  hist AS (SELECT *, list_sort(list(lin) FILTER (WHERE frame % 3 = 0) OVER (
      PARTITION BY channel ORDER BY frame ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)) AS h FROM heat),
  due AS (SELECT channel, frame, greatest(h[floor(len(h) * 0.25)::INT + 1], 30.0) AS baseline
    FROM hist WHERE frame % 10 = 0),
  metric AS (SELECT heat.*, baseline,
      greatest(10 * log10(greatest(lin / baseline, 1e-30)), 0.0) AS metric_db
    FROM heat JOIN due ON due.channel = heat.channel AND due.frame = heat.frame - heat.frame % 10)"""

GATED = BASELINE + """,
  trig AS (SELECT *, count(*) OVER w AS n_triggered, max(channel) OVER w - min(channel) OVER w AS span
    FROM metric WHERE metric_db > 3.5 WINDOW w AS (PARTITION BY frame)),
  gated AS (SELECT *, n_triggered >= 8 OR (n_triggered >= 3 AND span > 5) AS gated FROM trig)"""


def cooldown_sql(source: str, gap: int) -> str:
    """Greedy fold per channel: rows (channel, frame, restart) of ``source``."""
    return f"""
  ordered AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY frame) AS rn FROM {source}),
  fold AS (
    SELECT channel, frame, rn, NOT restart AS kept, frame + {gap} AS until FROM ordered WHERE rn = 1
    UNION ALL
    SELECT o.channel, o.frame, o.rn, NOT o.restart AND o.frame >= f.until,
      CASE WHEN o.restart OR o.frame >= f.until THEN o.frame + {gap} ELSE f.until END
    FROM fold f JOIN ordered o ON o.channel = f.channel AND o.rn = f.rn + 1)"""


DETECT = "WITH RECURSIVE " + GATED + """,
  rows_in AS (SELECT *, gated AS restart FROM gated WHERE gated OR abs(channel - 24) > 4),""" \
    + cooldown_sql("rows_in", 6) + """
SELECT r.frame, r.channel, round(r.lin, 6) + 0.0 AS lin, round(r.metric_db, 4) + 0.0 AS metric_db,
  (CASE WHEN r.channel <= 24 THEN r.channel ELSE r.channel - 48 END) * 1000.0::DOUBLE + 500.0 AS fc_hz
FROM fold JOIN rows_in r ON r.channel = fold.channel AND r.frame = fold.frame WHERE kept"""


def rolling_baseline(spark, sf):
    return det.metrics(heat(spark, sf), CFG).select(
        "frame", "channel", r(F.col("baseline")).alias("baseline"),
        r(F.col("metric_db"), DB).alias("metric_db"))


def rolling_every_frame(spark, sf):
    return base.rolling_quantile(heat(spark, sf), stride=1, refresh=1).select(
        "frame", "channel", r(F.col("baseline")).alias("baseline"))


def quantile_baseline(spark, sf):
    # + 1 keeps empty cells out of log10(0)
    df = heat(spark, sf).withColumn("lin", F.col("lin") + 1.0)
    return base.quantile_baseline(df).select(
        "frame", "channel", r(F.col("baseline")).alias("baseline"),
        r(F.col("metric_db"), DB).alias("metric_db"))


def gate(spark, sf):
    return det.gated_triggers(det.metrics(heat(spark, sf), CFG), CFG).select(
        "frame", "channel", "n_triggered", F.col("span").cast("int").alias("span"), "gated")


def gate_circular(spark, sf):
    cfg = det.DetectConfig(floor=30.0, circular=True)
    return det.gated_triggers(det.metrics(heat(spark, sf), cfg), cfg).select(
        "frame", "channel", "n_triggered", F.col("span").cast("int").alias("span"), "gated")


def cooldown(spark, sf):
    hot = heat(spark, sf).where("lin > 60")
    return gates.cooldown(hot, 6, payload=["lin"]).select("frame", "channel", r(F.col("lin")).alias("lin"))


def neighbours(spark, sf):
    hot = heat(spark, sf).where("lin > 90")
    return gates.suppress_neighbours(hot, span=2.0, horizon=4).select("frame", "channel")


def peak(spark, sf):
    return base.peak_frame(heat(spark, sf), metric="lin").select(
        "frame", r(F.col("peak_db")).alias("peak"))


def labels(spark, sf):
    k = F.col("channel")
    return num.drop_edge(heat(spark, sf)).select(
        "frame", "channel", num.channel_signed(k).cast("int").alias("signed"),
        num.channel_display(k).cast("int").alias("display"), num.channel_hz(k).alias("centre_hz"))


QUERIES = {
    "detect_bursts": detections,
    "rolling_quantile_baseline": rolling_baseline,
    "rolling_quantile_every_frame": rolling_every_frame,
    "series_quantile_baseline": quantile_baseline,
    "coincidence_gate": gate,
    "coincidence_gate_circular": gate_circular,
    "cooldown": cooldown,
    "suppress_neighbours": neighbours,
    "peak_frame": peak,
    "channel_labels_without_edges": labels,
}

SQL = {
    "detect_bursts": DETECT,
    "rolling_quantile_baseline": "WITH " + BASELINE + """
SELECT frame, channel, round(baseline, 6) + 0.0 AS baseline, round(metric_db, 4) + 0.0 AS metric_db FROM metric""",
    "rolling_quantile_every_frame": "WITH " + HEAT + """,
  hist AS (SELECT *, list_sort(list(lin) OVER (PARTITION BY channel ORDER BY frame
      ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)) AS h FROM heat)
SELECT frame, channel, round(greatest(h[floor(len(h) * 0.25)::INT + 1], 1e-30), 6) + 0.0 AS baseline FROM hist""",
    "series_quantile_baseline": "WITH " + HEAT + """,
  b AS (SELECT channel, quantile_cont(lin + 1.0, 0.25) AS baseline FROM heat GROUP BY channel)
SELECT frame, heat.channel, round(baseline, 6) + 0.0 AS baseline,
  round(10 * log10((lin + 1.0) / greatest(baseline, 1e-30)), 4) + 0.0 AS metric_db
FROM heat JOIN b ON b.channel = heat.channel""",
    "coincidence_gate": "WITH " + GATED + """
SELECT frame, channel, n_triggered, span, gated FROM gated""",
    "coincidence_gate_circular": "WITH " + BASELINE + """,
  hot AS (SELECT * FROM metric WHERE metric_db > 3.5),
  gaps AS (SELECT frame, channel, coalesce(lead(channel) OVER w, 48 + first_value(channel) OVER w) - channel AS gap,
      count(*) OVER (PARTITION BY frame) AS n_triggered FROM hot WINDOW w AS (PARTITION BY frame ORDER BY channel)),
  spans AS (SELECT frame, channel, n_triggered,
      CASE WHEN n_triggered > 1 THEN 48 - max(gap) OVER (PARTITION BY frame) ELSE 0 END AS span FROM gaps)
SELECT frame, channel, n_triggered, span::INT AS span,
  n_triggered >= 8 OR (n_triggered >= 3 AND span > 5) AS gated FROM spans""",
    "cooldown": "WITH RECURSIVE " + HEAT + """,
  hot AS (SELECT *, false AS restart FROM heat WHERE lin > 60),""" + cooldown_sql("hot", 6) + """
SELECT h.frame, h.channel, round(h.lin, 6) + 0.0 AS lin
FROM fold JOIN hot h ON h.channel = fold.channel AND h.frame = fold.frame WHERE kept""",
    "suppress_neighbours": "WITH RECURSIVE " + HEAT + """,
  ordered AS (SELECT frame, channel, row_number() OVER (ORDER BY frame, channel) AS rn FROM heat WHERE lin > 90),
  fold AS (
    SELECT rn, frame, channel, true AS kept, [{'f': frame, 'c': channel}] AS live FROM ordered WHERE rn = 1
    UNION ALL
    SELECT o.rn, o.frame, o.channel,
      len(list_filter(f.live, lambda a: o.frame - a.f < 4 AND abs(o.channel - a.c) < 2)) = 0,
      CASE WHEN len(list_filter(f.live, lambda a: o.frame - a.f < 4 AND abs(o.channel - a.c) < 2)) = 0
        THEN list_append(list_filter(f.live, lambda a: o.frame - a.f < 4), {'f': o.frame, 'c': o.channel})
        ELSE list_filter(f.live, lambda a: o.frame - a.f < 4) END
    FROM fold f JOIN ordered o ON o.rn = f.rn + 1)
SELECT frame, channel FROM fold WHERE kept""",
    "peak_frame": "WITH " + HEAT + """,
  m AS (SELECT frame, max(lin) AS peak FROM heat GROUP BY frame)
SELECT frame, round(peak, 6) + 0.0 AS peak FROM m ORDER BY m.peak DESC, frame LIMIT 1""",
    "channel_labels_without_edges": "WITH " + HEAT + """
SELECT frame, channel, (CASE WHEN channel <= 24 THEN channel ELSE channel - 48 END)::INT AS signed,
  ((channel + 24) % 48)::INT AS display,
  (CASE WHEN channel <= 24 THEN channel ELSE channel - 48 END) * 1000.0::DOUBLE + 500.0 AS centre_hz
FROM heat WHERE abs(channel - 24) > 4""",
}
