"""Batch throttle: at most one accepted report per key and minute.

The rule is sequential per key, but a stretch of time only needs to know when
the key's last report before it was accepted, and that can matter only for its
first minute.  So: each (key, stretch) states which last acceptance follows from
which entry; a fold per key runs over these few statements, not over reports;
then each (key, stretch) picks its reports on its own.  A key holding a third of
all reports is thus spread over its stretches of time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline import fixed_values as V

GAP = V.REPORT_GAP_SECONDS * 1_000_000
HOUR = 3_600_000_000


def _statements(width: int):
    """Per (key, chunk): ``upto, exit`` -- entering at or before ``upto``, the last acceptance is ``exit``."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        at = np.sort(rows["at"].to_numpy())
        n, chunk = len(at), int(rows["chunk"].iloc[0])
        after = np.searchsorted(at, at + GAP, "left")
        last = at.copy()
        for i in range(n - 1, -1, -1):
            if after[i] < n:
                last[i] = last[after[i]]
        reach = min(int(np.searchsorted(at, chunk * width + GAP, "left")), n - 1)
        upto, exits = at[: reach + 1], last[: reach + 1]
        ends = np.append(exits[1:] != exits[:-1], True)
        return pd.DataFrame({"key": rows["key"].iloc[0], "chunk": chunk, "upto": upto[ends], "exit": exits[ends]})

    return run


def _entries(rows: pd.DataFrame) -> pd.DataFrame:
    """Per key: last acceptance before each chunk."""
    before, out = None, []
    for chunk, part in rows.sort_values(["chunk", "upto"]).groupby("chunk", sort=True):
        out.append((rows["key"].iloc[0], chunk, before))
        open_from = -np.inf if before is None else before + GAP
        hit = part[part["upto"] >= open_from]
        if len(hit):
            before = int(hit["exit"].iloc[0])
    return pd.DataFrame(out, columns=["key", "chunk", "before"]).astype({"before": "Int64"})


def _pick(rows: pd.DataFrame) -> pd.DataFrame:
    """Per (key, chunk): the accepted reports."""
    rows = rows.sort_values(["at", "id"])
    at, before = rows["at"].to_numpy(), rows["before"].iloc[0]
    i = 0 if pd.isna(before) else int(np.searchsorted(at, int(before) + GAP, "left"))
    keep = []
    while i < len(at):
        keep.append(i)
        i = int(np.searchsorted(at, at[i] + GAP, "left"))
    return rows.iloc[keep][["key", "id", "at"]]


def throttle(reports: DataFrame, key: str = "race_id", chunk_hours: int = 6) -> DataFrame:
    """Accepted reports as ``key, id, created_at``; rejected ones do not extend the block.

    The key may be of any type, an address as well as a number.
    """
    width, kind = chunk_hours * HOUR, reports.schema[key].dataType.simpleString()
    at = F.unix_micros("created_at")
    slim = reports.select(F.col(key).alias("key"), "id", at.alias("at"), F.floor(at / width).cast("bigint").alias("chunk"))
    said = slim.groupBy("key", "chunk").applyInPandas(_statements(width), f"key {kind}, chunk long, upto long, exit long")
    entries = said.groupBy("key").applyInPandas(_entries, f"key {kind}, chunk long, before long")
    picked = slim.join(entries, ["key", "chunk"]).groupBy("key", "chunk").applyInPandas(_pick, f"key {kind}, id long, at long")
    return picked.select("key", "id", F.timestamp_micros("at").alias("created_at"))
