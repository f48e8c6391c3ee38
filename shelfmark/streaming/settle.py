"""The settling scan as a stream: a file is staged when it was seen unchanged for a quiet time.

State per path: signature and the time since which it holds. A changed signature starts anew; nothing is dropped as late. State
survives restarts in the query's checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfmark.operators.health import SETTLE

OBSERVED = "path string, signature string, mtime double, seen_at double"
STAGED = "path string, signature string, stable_since double, seen_at double, state string"


def settle(signature: str | None, since: float, rows: list[tuple[str, float, float]], quiet: float) -> tuple[str, float, list[tuple[str, float, float, str]]]:
    """The new state and one (signature, stable_since, seen_at, state) per observation (signature, mtime, seen_at), by time."""
    out = []
    for sig, mtime, seen in sorted(rows, key=lambda r: r[2]):
        same = sig == signature
        if not same:
            signature, since = sig, seen
        waiting = not same or seen - since < quiet or seen - mtime < quiet
        out.append((sig, since, seen, "waiting" if waiting else "staged"))
    return signature, since, out


def settle_stream(observed: DataFrame, quiet: float = SETTLE) -> DataFrame:
    """path, signature, stable_since, seen_at, state for every observation of a stream of :data:`OBSERVED` rows."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        signature, since = state.get if state.exists else (None, 0.0)
        rows = [(r.signature, r.mtime, r.seen_at) for pdf in batches for r in pdf.itertuples()]
        signature, since, out = settle(signature, since, rows, quiet)
        state.update((signature, since))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=["path", "signature", "stable_since", "seen_at", "state"])

    return observed.groupBy("path").applyInPandasWithState(step, STAGED, "signature string, since double", "append", GroupStateTimeout.NoTimeout)


def settle_observations(observed: DataFrame, quiet: float = SETTLE) -> DataFrame:
    """The same for a batch, by window functions: running frames that read each path's rows once and may spill."""
    by = W.partitionBy("path").orderBy("seen_at", "signature", "mtime")
    before = F.lag("signature").over(by)
    same = F.coalesce(before == F.col("signature"), F.lit(False))
    runs = observed.withColumn("_same", same)
    since = F.last(F.when(~F.col("_same"), F.col("seen_at")), ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0))
    runs = runs.withColumn("stable_since", since)
    waiting = ~F.col("_same") | (F.col("seen_at") - F.col("stable_since") < quiet) | (F.col("seen_at") - F.col("mtime") < quiet)
    return runs.select("path", "signature", "stable_since", "seen_at", F.when(waiting, "waiting").otherwise("staged").alias("state"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """window_start, event_type, n: counts of a stream of events (ts, event_type) by time window, late rows within ``late``."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")
