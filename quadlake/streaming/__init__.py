"""Queries over unbounded tables.

The query language has no windows or watermarks of its own. A query whose plan is stateless, or groups by an
event-time window that the caller adds, also runs over a stream: mapped tables may be streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadlake.engine import Engine
from quadlake.sources.catalog import Catalog, TableMap


def stream_select(spark: SparkSession, table: TableMap, text: str) -> DataFrame:
    """A SELECT over one mapped streaming table, as a streaming DataFrame of native columns."""
    out = Engine(Catalog(spark, None, [table])).select(text)
    if not out.isStreaming:
        raise ValueError("the table is not a stream")
    return out
