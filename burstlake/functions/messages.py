"""Column expressions on decoded message text, decoder output and status lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numeric import let

# The grammar of a callsign, a locator grid and a signal report.
CALL = r"[A-Z0-9]{1,3}[0-9][A-Z0-9]{0,3}[A-Z](?:/[A-Z0-9]+)?"
GRID = r"[A-R]{2}[0-9]{2}(?:[A-X]{2})?"
REPORT = r"[+-][0-9]{2}|RRR|RR73|73|RR"
CQ_PATTERN = rf"^CQ\s+(?:DX\s+)?({CALL})(?:\s+({GRID}))?$"
REPLY_PATTERN = rf"^({CALL})\s+({CALL})(?:\s+({GRID}|{REPORT}))?$"
MODE = "MSK144"


def encode_params(freq_khz: Column, time_ds: Column, snr_db: Column, width_ms: Column) -> Column:
    """13 characters: A, sign and 2 digits of kHz, 3 of deciseconds, sign and 2 of dB, 3 of ms."""
    sign = lambda c: F.when(c >= 0, "P").otherwise("N")
    return F.concat(F.lit("A"), sign(freq_khz), F.format_string("%02d", F.abs(freq_khz)),
                    F.format_string("%03d", time_ds),
                    sign(snr_db), F.format_string("%02d", F.abs(snr_db)),
                    F.format_string("%03d", width_ms))


def decode_params(msg: Column) -> Column:
    """Struct of the four parameters; all null unless the text has that shape."""
    ok = msg.startswith("A") & (F.length(msg) == 13)
    num = lambda pos, n: F.when(ok, F.substring(msg, pos, n)).try_cast("int")
    sgn = lambda pos: F.when(F.substring(msg, pos, 1) == "P", 1).otherwise(-1)
    return F.struct((sgn(2) * num(3, 2)).alias("freq_khz"), num(5, 3).alias("time_ds"),
                    (sgn(8) * num(9, 2)).alias("snr_db"), num(11, 3).alias("width_ms"))


def strip(col: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(col, F.lit(" \t\r\n\x0b\f"))


def parse_message(col: Column, rr73_is_grid: bool = False) -> Column:
    """Struct (de, to, grid) of a message; ('', '', null) when it has neither shape.

    ``CQ`` is not a callsign, so at most one of the two patterns matches and a
    group of the other one is empty.
    """
    m = F.upper(strip(col))
    grp = lambda p, g: F.regexp_extract(m, p, g)
    tail = grp(REPLY_PATTERN, 3)
    looks = tail.rlike(f"^(?:{GRID})")
    if not rr73_is_grid:
        looks = looks & (tail != "RR73")
    return F.struct(
        F.concat(grp(CQ_PATTERN, 1), grp(REPLY_PATTERN, 2)).alias("de"),
        F.when(grp(CQ_PATTERN, 1) != "", "CQ").otherwise(grp(REPLY_PATTERN, 1)).alias("to"),
        F.coalesce(F.nullif(grp(CQ_PATTERN, 2), F.lit("")), F.when(looks, tail)).alias("grid"))


def parse_decoder_output(col: Column) -> Column:
    """Struct (line, snr_db, message) of the first real line of a decoder's output."""
    lines = F.filter(F.transform(F.split(col, "\r\n|\n|\r"), lambda s: strip(s)),
                     lambda s: (s != "") & ~s.startswith("<") & ~s.startswith("EOF"))
    line = F.get(lines, F.lit(0))
    tokens = F.split(line, r"\s+")
    return F.struct(
        line.alias("line"),
        F.get(tokens, F.lit(1)).try_cast("int").alias("snr_db"),
        F.when(F.size(tokens) >= 6, F.array_join(F.slice(tokens, 6, F.size(tokens)), " "))
         .otherwise(line).alias("message"))


def coalesce_snr(decoder: Column, estimate: Column) -> Column:
    return F.coalesce(decoder, estimate)


def safe_name(ts: Column, khz: Column, message: Column) -> Column:
    """UTC time, rounded kHz and message with each run of other characters as one underscore."""
    text = F.regexp_replace(F.regexp_replace(message, r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", "")
    return F.concat(F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("Z_"),
                    F.rint(khz).cast("long").cast("string"), F.lit("kHz_"), text)


def kv_pairs(col: Column) -> Column:
    """Array of (k, v) of the key=value tokens, split at the first ``=``, in order."""
    tokens = F.filter(F.split(strip(col), r"\s+"), lambda t: F.contains(t, F.lit("=")))
    return F.transform(tokens, lambda t: F.struct(
        F.substring_index(t, "=", 1).alias("k"),
        F.substr(t, F.instr(t, "=") + 1).alias("v")))


def parse_kv(col: Column, keep: str = "last") -> Column:
    """Map of a key=value line; ``keep`` says which of repeated keys wins."""
    if keep not in ("first", "last"):
        raise ValueError(keep)
    pairs = F.reverse(kv_pairs(col)) if keep == "last" else kv_pairs(col)
    first = lambda all_pairs: F.filter(
        all_pairs, lambda p, i: F.array_position(F.transform(all_pairs, lambda q: q["k"]), p["k"]) == i + 1)
    return let(pairs, lambda all_pairs: F.map_from_entries(first(all_pairs)))


def kv_value(col: Column, key: str, keep: str = "last") -> Column:
    """Value of one key of a key=value line, '' if absent; no map is built."""
    lead = r"^(?:.*\s)?" if keep == "last" else r"^(?:.*?\s)??"
    return F.regexp_extract(col, lead + key.replace(".", r"\.") + r"=(\S*)", 1)


def list_value(kv: Column, key: str) -> Column:
    """Comma-separated value of a key as an array without empty items."""
    return F.filter(F.split(F.coalesce(F.get(F.array(kv[key]), F.lit(0)), F.lit("")), ","),
                    lambda s: s != "")


def eligible_spots(df: DataFrame, my_call: str, need_grid: bool) -> DataFrame:
    """Rows with a sender other than ourselves, and with a grid if one is needed."""
    ok = (F.col("de") != "") & (F.upper("de") != my_call.upper())
    return df.where(ok & F.col("grid").isNotNull() if need_grid else ok)


def spot_comment(grid: Column, snr: Column) -> Column:
    """Mode, grid and signed SNR with single spaces; absent parts leave no gap at the end."""
    snr_text = F.when(snr.isNull(), "").otherwise(F.format_string("%+ddB", snr))
    return F.trim(F.concat(F.lit(f"{MODE} "), F.coalesce(grid, F.lit("")), F.lit(" "), snr_text))


def clip_snr(snr: Column) -> Column:
    return F.greatest(F.lit(-127), F.least(F.lit(127), F.coalesce(snr, F.lit(0)).cast("int")))


def spot_freq_hz(khz: Column) -> Column:
    return F.rint(khz * F.lit(1000.0)).cast("long")
