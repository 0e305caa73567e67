"""Cutting a table into shards that follow one another in the order of a key, without a global sort."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sorts after every other key; what a null key counts as.
LAST = (1 << 63) - 1
#: Rows that a shard holds on average, and most shards (their bounds are kept on the driver: 160 kB).
SHARD_ROWS, MOST_SHARDS = 4_000, 20_000


def order_key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(LAST))


def shard_bounds(df: DataFrame, column: str, shard_rows: int = SHARD_ROWS) -> list[int]:
    """Ascending keys at which a shard begins; the first is the smallest key. Each is a key of the table.

    A key with the rows of several shards comes as often; shards_of() parts its rows. Reads only the key
    column. An empty table has no shards.
    """
    keys = df.select(order_key(column).alias("k"))
    n = keys.count()
    if not n:
        return []
    shards = max(1, min(MOST_SHARDS, -(-n // shard_rows)))
    cuts = [i / shards for i in range(1, shards)]
    first, inner = keys.agg(F.min("k"), F.percentile_approx("k", cuts or [0.5], max(10_000, 10 * shards))).first()
    return sorted([first, *(inner if cuts else [])])


def shards_of(bounds: np.ndarray, keys: np.ndarray, second: np.ndarray, width: int = 32) -> np.ndarray:
    """The shard of each row with such a key and second key (of so many bits), in the order of both."""
    low, high = np.searchsorted(bounds, keys, "left"), np.searchsorted(bounds, keys, "right")
    many = np.maximum(high - low, 1)
    return np.where(high - low > 1, low + (second * many >> width), high - 1).astype(np.int32)
