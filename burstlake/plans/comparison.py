"""Score a decode log against the truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.matching import (RUN, claim, false_alarms, first_claims, match_exact, match_nearest,
                                  match_summary, outcome_counts)
from ..scale import cut_lineage


def compare(truth: DataFrame, log: DataFrame, freq_tol: float = 2.0, time_tol: float = 1.5,
            claim_all: bool = True, keys: Sequence[str] = RUN) -> tuple[DataFrame, DataFrame]:
    """(status per truth, false alarms).

    ``truth`` has the keys, truth_no, msg, freq, t_sec; ``log`` the keys, line_no,
    message, freq, t_sec, both frequencies in kHz. truth_no gives the claim order.
    """
    # both are needed more than once
    matched = cut_lineage(match_nearest(match_exact(truth, log, keys), log, freq_tol, time_tol, keys))
    claims = cut_lineage(first_claims(matched, log, claim_all, keys))
    return claim(matched, claims, keys), false_alarms(log, claims, keys)


def report(truth: DataFrame, log: DataFrame, launches: DataFrame | None = None,
           keys: Sequence[str] = RUN, **options) -> DataFrame:
    """One row per run: match totals and, with launches, their outcomes."""
    statuses, alarms = compare(truth, log, keys=keys, **options)
    out = match_summary(statuses, alarms, keys)
    if launches is None:
        return out
    counts = outcome_counts(launches, keys).withColumnsRenamed(
        {"decoded": "launch_decoded", "error": "launch_error"})
    return out.join(counts, list(keys), "left").na.fill(
        0, ["launched", "launch_decoded", "no_decode", "timeout", "launch_error"])


def truth_from_manifest(placements: DataFrame, key: str = "manifest") -> DataFrame:
    """Manifest rows as truth, in order of their start time."""
    from ..scale import number_rows

    rows = placements.where(F.col("msg").isNotNull()).select(
        F.col(key).alias("run_id"), "placement_no", "msg",
        (F.col("center_hz") / 1000.0).alias("freq"), F.col("delay_s").alias("t_sec"),
        *[c for c in ("freq_khz", "time_ds", "snr_db", "width_ms") if c in placements.columns])
    return number_rows(rows, ["run_id"], ["t_sec", "placement_no"], "truth_no")
