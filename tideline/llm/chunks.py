"""Shared helpers of the tokenising operators: Arrow batches, chunks between spaces, and bounded chunk caches."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes that one Arrow batch may carry to a Python worker.
BATCH_ROWS = 1000


def bounded_batches(spark) -> None:
    """Keep Arrow batches small enough for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def texts_of(column) -> pa.Array:
    """A string column of a batch with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def split_at_spaces(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Split each text at single spaces: codes of the parts, the distinct parts, and the parts' offsets by text."""
    parts = pc.split_pattern(texts, " ")
    offsets = np.asarray(parts.offsets, dtype=np.int64)
    coded = parts.flatten().dictionary_encode()
    codes = np.asarray(coded.indices, dtype=np.int64)
    return codes, coded.dictionary.to_pylist(), offsets - offsets[0]


def any_in_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each row of a ragged array, whether one of its flags is set."""
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] > total[offsets[:-1]]


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Exact sums of integers over the rows of a ragged array; empty rows give 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def spread(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ..., n - 1 for each n of lengths, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


class Pool:
    """Values of chunks by number. make(chunks) gives a tuple of equally long lists; the oldest entries all go
    when more than cap are held, which happens between batches only."""

    def __init__(self, make, columns: int, cap: int = 400_000):
        self.make, self.cap = make, cap
        self.index: dict[str, int] = {}
        self.columns = [[] for _ in range(columns)]

    def renew(self) -> None:
        """Call before each batch."""
        if len(self.index) > self.cap:
            self.index.clear()
            for c in self.columns:
                c.clear()

    def numbers(self, chunks: list[str]) -> np.ndarray:
        got = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        new = [chunks[i] for i in np.flatnonzero(got < 0)]
        if new:
            new = list(dict.fromkeys(new))
            first = len(self.index)
            for column, values in zip(self.columns, self.make(new), strict=True):
                column.extend(values)
            self.index.update(zip(new, range(first, first + len(new)), strict=True))
            late = np.flatnonzero(got < 0)
            got[late] = [self.index[chunks[i]] for i in late]
        return got
