"""Registry of runnable queries, each with the SQL it is checked against."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPARK = {"i": "int", "l": "long", "s": "string", "b": "boolean"}
_SQL = {"i": "INTEGER", "l": "BIGINT", "s": "VARCHAR", "b": "BOOLEAN"}


def _parse(cols: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) if ":" in c else (c, "s") for c in cols.split()]


def query(cols: str, oracle: str | None = None, name: str | None = None,
          views: dict[str, str] | None = None):
    """Register a query under its function name.

    ``cols`` fixes the result layout as ``name:type`` (i int, l long, s string, b boolean, dN
    double rounded to N places), applied to both sides so that types and names agree.
    """
    spec = _parse(cols)

    def wrap(fn):
        key = name or fn.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = fn(Views(spark, folder))
            out = []
            for c, t in spec:
                if t.startswith("d"):
                    out.append((F.round(F.col(c).cast("double"), int(t[1:] or 6)) + F.lit(0.0)).alias(c))
                else:
                    out.append(F.col(c).cast(_SPARK[t]).alias(c))
            return df.select(*out)

        QUERIES[key] = run
        if oracle is not None:
            parts = [f'round(CAST("{c}" AS DOUBLE), {int(t[1:] or 6)}) + 0.0::DOUBLE AS "{c}"'
                     if t.startswith("d") else f'CAST("{c}" AS {_SQL[t]}) AS "{c}"' for c, t in spec]
            ORACLES[key] = with_views(f"SELECT {', '.join(parts)} FROM (\n{oracle}\n) AS result", views)
        return fn

    return wrap
