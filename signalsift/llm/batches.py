"""Helpers for Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the row offsets in them; a null has no bytes."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    places = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    held = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return held[places[0] : places[-1]], places - places[0]


def slices(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold at most ``limit`` bytes, or one row."""
    start, rows = 0, len(offsets) - 1
    while start < rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), rows)
        yield start, stop
        start = stop


def changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Bounds of the runs of rows with equal keys."""
    changed = np.zeros(max(table.num_rows - 1, 0), bool)
    for key in keys:
        column = table.column(key).combine_chunks()
        changed |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
        if column.null_count:
            nulls = column.is_null().to_numpy(zero_copy_only=False)
            changed |= nulls[1:] != nulls[:-1]
    return np.concatenate([[0], np.flatnonzero(changed) + 1, [table.num_rows]])


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by ``keys`` as tables of whole groups, with the groups' bounds.

    The last group of a batch may go on in the next one, so it is held back.
    Memory is that of a batch and of the largest group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        last = pa.Table.from_batches([batch])
        if len(changes(last, keys)) == 2 and len(held) > 1 and all(
            held[0].column(k)[0] == last.column(k)[0] for k in keys
        ):
            continue
        table = pa.Table.from_batches(held)
        cuts = changes(table, keys)
        if len(cuts) > 2:
            yield table.slice(0, int(cuts[-2])), cuts[:-1]
        held = table.slice(int(cuts[-2])).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, changes(table, keys)


_cache: dict[str, Callable[[], None]] = {}


def sole_cache(owner: str, clear: Callable[[], None]) -> None:
    """Let go of what other operators know in this worker: stages run one after the other in the same workers."""
    others = [n for n in _cache if n != owner]
    for name in others:
        _cache.pop(name)()
    _cache[owner] = clear
    if others:
        handed_back()


def handed_back() -> None:
    """Give memory that nothing uses back to the system, which the C library (if it is glibc) does not do by itself."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
