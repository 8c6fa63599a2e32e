"""Arrow batches in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: About so many characters are worked on at once, so that very long texts don't add up.
CHARS = 2_000_000


def parts(batch: pa.RecordBatch, text: int, rows: int = 2000, chars: int = CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``rows`` rows and about ``chars`` characters in a text column; a longer text is a
    slice of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = int(np.searchsorted(total, before + chars, "right"))
        stop = max(start + 1, min(stop, start + rows))
        yield batch.slice(start, stop - start)
        start = stop
