"""Array helpers for code inside tasks: bounded slices of batches, ragged gathers, state of a reused worker."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 8 << 20


def held(key: tuple, make: Callable[[], object]):
    """An object that a reused Python worker keeps from one task to the next.

    Task code travels by value, so its own globals are new in each task. A worker serves one
    stage after the other: objects of another kind, which the stages before have left, go.
    """
    kept = sys.modules.setdefault("threadlens_worker_state", types.ModuleType("threadlens_worker_state"))
    state = kept.__dict__.setdefault("held", {})
    for other in [k for k in state if k[0] != key[0]]:
        del state[other]
    if key not in state:
        state[key] = make()
    return state[key]


def release() -> None:
    """For tasks that keep nothing: what the stages before have left in this worker goes."""
    held(("nothing",), lambda: None)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in runs whose ``column`` holds at most ``limit`` bytes, or one row.

    At the end, memory that Arrow keeps for later goes back: a reused worker may idle long.
    """
    for batch in batches:
        sizes = binary_lengths(batch.column(column))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    batch = None
    pa.default_memory_pool().release_unused()


def binary_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def filled(column: pa.Array) -> pa.Array:
    """Texts with null as empty, in an array of its own (offset 0)."""
    import pyarrow.compute as pc

    return pa.concat_arrays([pc.fill_null(column, "")])


def ragged_positions(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of runs ``starts[i] .. starts[i] + lengths[i]``, one run after the other."""
    total = int(lengths.sum())
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total, dtype=np.int64)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])


class Recent:
    """A bounded cache: the older half goes when the newer one is full. Trimmed between slices only."""

    def __init__(self, size: int) -> None:
        self.size, self.new, self.old = size, {}, {}

    def trim(self) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}

    def again(self, key):
        """A value that has left the newer half, or None."""
        value = self.old.get(key)
        if value is not None:
            self.new[key] = value
        return value


def renamed(df):
    """``df`` with its columns as ``_c0``, ``_c1``, ..., so that none clashes with an operator's own."""
    return df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
