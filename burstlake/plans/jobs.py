"""Table jobs: spots, parameter recovery, client status, packet health, decode rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages as msg
from ..functions import numeric as num
from ..operators.baseline import percent
from ..operators.matching import RUN, match_exact
from ..operators.runs import newest_per_key, on_change, seq_gaps
from ..scale import column_quantiles, cut_lineage


def spots(log: DataFrame, my_call: str, need_grid: bool = True, message: str = "message",
          khz: str = "radio_khz", snr: str = "snr_db", rr73_is_grid: bool = False) -> DataFrame:
    """Decode log rows to spots: sender, addressee, grid, frequency, clipped SNR, text."""
    parsed = log.withColumn("_m", msg.parse_message(F.col(message), rr73_is_grid)).select(
        *log.columns, "_m.*")
    ok = msg.eligible_spots(parsed, my_call, need_grid)
    return ok.select(
        *log.columns, F.col("de").alias("de_call"), F.col("to").alias("to_call"),
        F.col("grid").alias("de_grid"), msg.spot_freq_hz(F.col(khz)).alias("freq_hz"),
        msg.clip_snr(F.col(snr)).alias("snr"), F.lit(msg.MODE).alias("mode"),
        msg.spot_comment(F.col("grid"), F.col(snr)).alias("comment"))


def spot_rollup(spot_rows: DataFrame, ts: str = "ts", every: str = "5 minutes") -> DataFrame:
    """Spots and best SNR per call and window."""
    return spot_rows.groupBy("de_call", F.window(ts, every).alias("w")).agg(
        F.count("*").alias("spots"), F.max("snr").alias("best_snr")).select(
        "de_call", F.col("w.start").alias("window_start"), "spots", "best_snr")


def recovered(log: DataFrame, truth: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Decoded 13-character messages next to the truth they name, with the errors.

    The log's own frequency, time and SNR are compared with what its text says.
    """
    words = log.select(*keys, "line_no", "freq", "t_sec", "snr_db",
                       F.explode(F.split(F.trim("message"), r"\s+")).alias("msg"))
    coded = words.where(F.col("msg").startswith("A") & (F.length("msg") == 13)).withColumn(
        "_p", msg.decode_params(F.col("msg"))).where(F.col("_p.width_ms").isNotNull())
    first = coded.groupBy(*keys, "msg").agg(F.min_by(
        F.struct("line_no", "freq", "t_sec", "snr_db", "_p"), "line_no").alias("_l"))
    return (truth.select(*keys, "truth_no", "msg").join(first, [*keys, "msg"]).select(
        *keys, "truth_no", "msg", F.col("_l.line_no").alias("line_no"),
        (F.col("_l.freq") - F.col("_l._p.freq_khz")).alias("freq_error"),
        (F.col("_l.t_sec") - F.col("_l._p.time_ds") / F.lit(10.0)).alias("time_error"),
        (F.col("_l.snr_db") - F.col("_l._p.snr_db")).cast("double").alias("snr_error")))


def recovery_error(log: DataFrame, truth: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Mean and median absolute errors per run."""
    rows = recovered(log, truth, keys)
    absolute = cut_lineage(rows.select(*keys, *[F.abs(f"{c}_error").alias(c) for c in ("freq", "time", "snr")]))
    return column_quantiles(
        absolute, keys, {f"median_{c}": (c, 0.5) for c in ("freq", "time", "snr")},
        extra={"matched": F.count("*"), **{f"mean_{c}": F.avg(c) for c in ("freq", "time", "snr")}})


def client_status(lines: DataFrame, line: str = "line", order: Sequence[str] = ("seq",)) -> DataFrame:
    """Newest record of each graphical client from its status lines, by station and id."""
    text = F.regexp_replace(F.col(line), r"^[^|]*\|", "")
    has = text.rlike(r"(^|\s)client\s")
    body = F.trim(F.regexp_replace(text, r"^(?:.*?\s)?client\s+", ""))
    handle = F.get(F.split(body, r"\s+"), F.lit(0))
    rows = lines.where(has).withColumn("handle", handle).withColumn("_body", body)
    field = lambda k: msg.kv_value(F.col("_body"), k)
    gui = (field("gui") == "1") | field("program").startswith("SmartSDR")
    rows = rows.where(gui & (field("client_id") != "")).select(
        *order, "handle", *[field(k).alias(k) for k in ("client_id", "station", "program", "host", "ip")])
    return newest_per_key(rows, ["client_id"], list(order),
                          ["handle", "station", "program", "host", "ip"])


def tuning_history(lines: DataFrame, keys: Sequence[str], line: str = "line",
                   order: Sequence[str] = ("seq",), time: str | None = None,
                   min_gap: float = 0.0) -> DataFrame:
    """Changes of centre frequency (MHz) and bandwidth (Hz) told by status lines."""
    field = lambda k: F.nullif(msg.kv_value(F.col(line), k), F.lit(""))
    raw = F.struct(field("center").alias("c"), field("bandwidth").alias("b"))
    tuned = F.transform(F.array(raw), lambda v: F.struct(
        num.freq_mhz(v["c"]).alias("centre_mhz"), num.bandwidth_hz(v["b"]).alias("bandwidth_hz")))
    some = F.filter(tuned, lambda t: t["centre_mhz"].isNotNull() | t["bandwidth_hz"].isNotNull())
    # exploding none or one value evaluates a line once
    rows = lines.select(*keys, *order, *([time] if time and time not in order else []),
                        F.explode(some).alias("_t"))
    rows = rows.select(*[c for c in rows.columns if c != "_t"], "_t.centre_mhz", "_t.bandwidth_hz")
    return on_change(rows, ["centre_mhz", "bandwidth_hz"], keys, order, time, min_gap)


def packet_health(packets: DataFrame, keys: Sequence[str] = ("stream_id",),
                  order: Sequence[str] = ("arrival",), mod: int = 16) -> DataFrame:
    """Packets, missed packets and percentage lost per stream."""
    gaps = seq_gaps(packets, mod, keys, order)
    return (gaps.groupBy(*keys).agg(F.count("*").alias("packets"), F.sum("missed").alias("missed"))
                .withColumn("loss_percent", percent(F.col("missed"), F.col("packets"))))


def decode_rows(outputs: DataFrame, text: str = "output", centre_mhz: Column | None = None) -> DataFrame:
    """Decoder text to log rows: message, SNR with fallback, dial frequency, file name, outcome.

    Needs ts, fc_hz and est_snr; ``centre_mhz`` defaults to a column of that name.
    """
    centre = F.col("centre_mhz") if centre_mhz is None else centre_mhz
    khz = num.dial_khz(centre, F.col("fc_hz"))
    parsed = outputs.withColumn("_o", msg.parse_decoder_output(F.col(text)))
    got = F.col("_o.line").isNotNull()
    return parsed.select(
        *[c for c in outputs.columns if c != text],
        F.when(got, "decoded").otherwise("no_decode").alias("outcome"),
        F.col("_o.message").alias("message"),
        F.when(got, msg.coalesce_snr(F.col("_o.snr_db"), F.col("est_snr"))).alias("jt9_snr_db"),
        F.col("_o.line").alias("jt9_line"), num.round_even(khz).alias("radio_khz"),
        F.when(got, msg.safe_name(F.col("ts"), khz, F.col("_o.message"))).alias("file_name"))
