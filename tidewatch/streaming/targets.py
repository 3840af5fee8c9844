"""Which sources are on: a stream of polls becomes a stream of starts and stops."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, patience: int) -> Iterator[pd.DataFrame]:
    """State: the last time (ms) that the key was seen since its start."""
    last = state.get[0] if state.exists else None
    out: list[tuple[str, int]] = []
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"key": [key[0]], "change": ["stop"], "ms": [last]})
        return
    for t in np.unique(np.concatenate([f["ms"].to_numpy(np.int64) for f in frames])).tolist():
        if last is not None and t - last > patience:
            out.append(("stop", last))
            last = None
        if last is None:
            out.append(("start", t))
        last = t if last is None else max(last, t)
    if last + patience <= state.getCurrentWatermarkMs():
        out.append(("stop", last))
        if state.exists:
            state.remove()
    else:
        state.update((last,))
        state.setTimeoutTimestamp(last + patience)
    yield pd.DataFrame({"key": [key[0]] * len(out), "change": [c for c, _ in out], "ms": [t for _, t in out]})


def source_changes(seen: DataFrame, key: str = "broad_no", ts: str = "ts", patience_minutes: float = 10, late: str = "0 seconds") -> DataFrame:
    """(key, change, at) of a stream of polls (key, ts): start when a key is first seen, or seen again after a pause of
    more than patience; stop, at its last sight, once the watermark has passed that by patience. A poll that is replayed
    changes nothing, and a restart goes on from the stored state. Rows without key or time are left out; a sight that
    comes late but inside the watermark moves no start that was emitted before it."""
    rows = seen.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    kind = seen.schema[key].dataType.simpleString()
    rows = rows.select(F.col(key).alias("key"), F.col(ts), F.unix_millis(ts).alias("ms"))
    fn = partial(_changes, patience=int(patience_minutes * 60_000))
    out = rows.groupBy("key").applyInPandasWithState(fn, f"key {kind}, change string, ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("key").alias(key), "change", F.timestamp_millis("ms").alias("at"))
