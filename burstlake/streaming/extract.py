"""Samples round each event of a stream, cut out once they have arrived.

An event's window often reaches past the newest block. So events and blocks are one
keyed stream: an event waits in the state until the blocks of its window are there,
or, when some never come, until the watermark has passed its time by ``patience``,
and then leaves with what exists. Blocks are kept for ``keep`` behind the newest and
as long as an open event needs them; so the state of a stream is bounded by its rate
times the longer of the two, and it goes when the stream falls silent.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .jobs import DOUBLES, _keyed, _millis


#: Segments that leave a key together, however many events a micro-batch has.
OUT_ROWS = 1000


def stream_event_segments(blocks: DataFrame, events: DataFrame, pre: int, post: int, pad: int, block: int,
                          cols: Sequence[str] = ("x",), keys: Sequence[str] = ("stream_id",), event: str = "event_id",
                          at: str = "at", ts: str = "ts", patience: str = "2 seconds", keep: str = "5 seconds",
                          wait: str = "2 seconds") -> DataFrame:
    """(keys, event, cols): samples at - pre .. at + post - 1 with ``pad`` zeros at both ends, as ``event_segments`` in batch.

    ``blocks`` (block_idx, first_sample, cols, ts) and ``events`` (event, at, ts) may come in any order within ``wait``.
    An event of which no block exists gives no row, as in batch.
    """
    spark = blocks.sparkSession
    patient, kept = spark.range(1).select(_millis(patience), _millis(keep)).first()
    none = F.lit(None).cast("long")
    # a watermark for each source: the slower one counts
    left = blocks.select(*keys, ts, F.unix_millis(ts).alias("_ms"), "block_idx", "first_sample", *(F.col(c).cast(DOUBLES).alias(c) for c in cols),
                         none.alias("_event"), none.alias("_at")).withWatermark(ts, wait)
    right = events.select(*keys, ts, F.unix_millis(ts).alias("_ms"), none.alias("block_idx"), none.alias("first_sample"),
                          *(F.lit(None).cast(DOUBLES).alias(c) for c in cols), F.col(event).cast("long").alias("_event"),
                          F.col(at).cast("long").alias("_at")).withWatermark(ts, wait)
    both = left.unionByName(right)
    schema = T.StructType([*_keyed(both, keys), T.StructField(event, T.LongType()), *(T.StructField(c, DOUBLES) for c in cols)])

    def cut(own: dict, where: int) -> list[np.ndarray] | None:
        lo, hi = where - pre, where + post
        parts: list[list[np.ndarray]] = [[] for _ in cols]
        for b in range(lo // block, (hi - 1) // block + 1):
            if b in own:
                _, first, *samples = own[b]
                for part, x in zip(parts, samples):
                    part.append(x[max(lo - first, 0):max(hi - first, 0)])
        if not sum(map(len, parts[0])):
            return None
        zeros = np.zeros(pad)
        return [np.concatenate([zeros, *p, zeros]) for p in parts]

    def run(key, chunks, state: GroupState) -> Iterator[pd.DataFrame]:
        own, waiting, last = pickle.loads(state.get[0]) if state.exists else ({}, [], 0)
        for pdf in [] if state.hasTimedOut else chunks:
            for ms, b, first, e, where, *samples in pdf[["_ms", "block_idx", "first_sample", "_event", "_at", *cols]].itertuples(index=False):
                last = max(last, int(ms))
                if not pd.isna(b):
                    own[int(b)] = (int(ms), int(first), *(np.asarray(x, dtype=np.float64) for x in samples))
                elif not pd.isna(where):
                    waiting.append((int(ms), int(e), int(where)))
        now, out, still = state.getCurrentWatermarkMs(), [], []
        for ms, e, where in waiting:
            needed = range((where - pre) // block, (where + post - 1) // block + 1)
            if all(b in own for b in needed) or ms + patient <= now:
                found = cut(own, where)
                if found is not None:
                    out.append((*key, e, *found))
                if len(out) >= OUT_ROWS:
                    yield pd.DataFrame(out, columns=schema.names)
                    out = []
            else:
                still.append((ms, e, where))
        if out:
            yield pd.DataFrame(out, columns=schema.names)
        needed = {b for _, _, where in still for b in range((where - pre) // block, (where + post - 1) // block + 1)}
        own = {b: v for b, v in own.items() if v[0] >= last - kept or v[0] > now - kept or b in needed}
        if not still and state.hasTimedOut and now >= last + kept:
            state.remove()
            return
        state.update((pickle.dumps((own, still, last)),))
        state.setTimeoutTimestamp(max(now + 1, min((ms + patient for ms, *_ in still), default=last + kept)))

    kind = T.StructType([T.StructField("state", T.BinaryType())])
    return both.groupBy(*keys).applyInPandasWithState(run, schema, kind, "append", GroupStateTimeout.EventTimeTimeout)
