"""Greedy segmentation with a reset: the one computation here that no window can express.

A segment takes entries in order until it holds `limit` bytes or more (freeze), or as long as the next entry still fits
(blocks). Streams are cut independently by `stream`, so the fold of one never sees another's rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def cut(sizes: np.ndarray, limit: int, fits: bool) -> np.ndarray:
    """Segment numbers. fits: an entry that would exceed the limit opens a new segment; else the entry that reaches the
    limit closes its own."""
    out, segment, held = np.empty(len(sizes), np.int64), 0, 0
    for k, size in enumerate(sizes):
        if fits and held and held + size >= limit:
            segment, held = segment + 1, 0
        out[k] = segment
        held += size
        if not fits and held >= limit:
            segment, held = segment + 1, 0
    return out


def segments(rows: DataFrame, limit: int, fits: bool = False, stream: str = "stream", order: str = "seq", size: str = "size") -> DataFrame:
    """(stream, order, size, segment) of all rows; a stream is folded in order within one task, narrow rows only."""
    names = [stream, order, size]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(names[1], kind="stable")
        return part.assign(segment=cut(part[names[2]].to_numpy(), limit, fits))

    types = dict(rows.dtypes)
    return rows.select(*names).groupBy(stream).applyInPandas(run, f"{stream} {types[stream]}, {order} {types[order]}, {size} {types[size]}, segment long")
