"""Overlap clusters of a stream of calls: open clusters as state, closed by event time.

For each key the state is a list of disjoint islands (start, end, calls) of
the calls seen so far, not the calls themselves; a call that connects islands
makes one of them.  Once the watermark has reached an island's end no later
call can overlap it: it is given out with its number and leaves the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "starts array<bigint>, ends array<bigint>, calls array<bigint>, closed bigint"


def islands(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Disjoint islands of (start, end, calls): one begins where a start reaches the largest end so far."""
    out: list[tuple[int, int, int]] = []
    for s, e, n in sorted(spans):
        if out and s < out[-1][1]:
            a, b, m = out[-1]
            out[-1] = a, max(b, e), m + n
        else:
            out.append((s, e, n))
    return out


def _closing(names: list[str], unit: int) -> callable:
    """State function; ``unit`` coordinate units are a millisecond of event time."""

    def of(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        starts, ends, calls, closed = state.get if state.exists else ([], [], [], 0)
        held = list(zip(map(int, starts), map(int, ends), map(int, calls), strict=True))
        if not state.hasTimedOut:
            for b in batches:
                # a batch at a time, so that no more than one and the islands are held
                held = islands(held + list(zip(b.start.tolist(), b.end.tolist(), [1] * len(b), strict=True)))
        reached = state.getCurrentWatermarkMs()
        done = [h for h in held if h[1] <= reached * unit]
        held = held[len(done) :]
        if held or closed + len(done):
            cols = [list(c) for c in zip(*held, strict=True)] or [[], [], []]
            state.update((*cols, closed + len(done)))
            if held:
                state.setTimeoutTimestamp(max(-(-held[0][1] // unit), reached + 1))
        rows = [(*key, closed + i + 1, *d) for i, d in enumerate(done)]
        yield pd.DataFrame(rows, columns=[*names, "cluster_no", "start", "end", "n"], dtype=object)

    return of


def closed_clusters(calls: DataFrame, keys: list[str], event_time: str, delay: str, unit: int = 1_000) -> DataFrame:
    """Clusters ``keys, cluster_no, start, end, n`` of a streaming ``calls(keys, start, end, event_time)``, as the watermark closes them.

    ``event_time`` is the start as a timestamp, ``unit`` coordinate units of
    start and end to a millisecond; calls later than ``delay`` behind the
    newest one are dropped.  Clusters are numbered by start from 1 in each
    key, as the batch operator numbers them.  Calls with a null in a key,
    start, end or time belong to no cluster.  The state keeps the open islands of a
    key and how many it has closed.
    """
    types = {f.name: f.dataType.simpleString() for f in calls.schema}
    out = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "cluster_no bigint, start bigint, `end` bigint, n bigint"])
    plain = calls.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col(event_time).alias("_time")).dropna().withWatermark("_time", delay)
    return plain.groupBy(*keys).applyInPandasWithState(_closing(keys, unit), out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def cluster_stream(calls: DataFrame, keys: list[str], event_time: str, delay: str, sink: str, checkpoint: str, unit: int = 1_000) -> StreamingQuery:
    """Write closed clusters to Parquet files in ``sink``, once each, until the source has no more; a restart goes on from ``checkpoint``."""
    out = closed_clusters(calls, keys, event_time, delay, unit)
    return out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
