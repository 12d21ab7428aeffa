"""Tables whose size is counted before they go to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hinted(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The rows with a broadcast hint, if they are counted to be `most` at most; else as they are, for a shuffled join."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
