"""Arrow batches in lots, so that a task holds few texts as Python objects at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa

LOT = 512


def lots(batches: Iterable[pa.RecordBatch], rows: int = LOT) -> Iterator[pa.RecordBatch]:
    """``batches`` cut into lots of at most ``rows`` rows; the rows' memory is shared."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
