"""Arrow batches in slices that Python can hold."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Rows of text, and bytes, that Python works on at a time.
TEXT_ROWS, TEXT_BYTES = 1_000, 8_000_000


def pieces(batches: Iterator[pa.RecordBatch], rows: int = TEXT_ROWS, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows and about so many bytes, but at least a row.

    Spark bounds a batch's bytes (64 MB), so whole texts fit a worker's memory without settings of the session.
    """
    for batch in batches:
        n = batch.num_rows
        step = max(1, min(rows, n * most // max(1, batch.nbytes)))
        for i in range(0, max(n, 1), step):
            yield batch.slice(i, step)
