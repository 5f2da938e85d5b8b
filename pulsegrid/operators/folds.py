"""Sequential folds over small ordered tables (tracks, detections), one state per key.

Rows are shuffled to their key, sorted, and streamed through the fold batch by batch, so a key's
rows are never gathered.  Only detection-sized tables go through here.
"""
from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def fold(df: DataFrame, keys: list[str], order: list[str], schema: str, make: Callable) -> DataFrame:
    """``make()`` returns a callable taking one row (a named tuple) and returning output rows."""
    names = [c.split()[0] for c in schema.split(",") if c.strip()]

    def run(batches):
        key, state = None, None
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                k = tuple(getattr(row, c) for c in keys)
                if k != key:
                    key, state = k, make()
                out.extend(state(row))
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
