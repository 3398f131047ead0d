"""Words of many texts at once: Arrow's bytes cut with numpy, distinct words found by Arrow's dictionary encoding."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task takes apart at a time; one longer text is taken whole.
SLICE_BYTES = 4 << 20


def byte_table(members: bytes, inverted: bool = False) -> np.ndarray:
    """256 booleans: whether each byte is (or, inverted, is not) one of the members."""
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return ~table if inverted else table


class Flat(NamedTuple):
    """Bytes of all texts in a row, and where each text begins (and the last ends)."""

    data: np.ndarray
    bounds: np.ndarray


def flat(texts: pa.Array, translate: bytes | None = None) -> Flat:
    """The bytes of a column of texts, each byte replaced by translate's, a table of 256 that leaves multi-byte characters alone.

    Null is an empty text.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = memoryview(raw)[bounds[0] : bounds[-1]] if raw else b""
    return Flat(np.frombuffer(bytes(data).translate(translate) if translate else data, np.uint8), bounds - bounds[0])


class Words(NamedTuple):
    """strings: the words in order; starts: where each begins in the bytes; before: words before each text (and in all)."""

    strings: pa.Array
    starts: np.ndarray
    before: np.ndarray


def strings_of(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings that lie in data one after the other; ends: where each ends."""
    offsets = np.zeros(len(ends) + 1, np.int64)
    offsets[1:] = ends
    return pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))


def words_of(texts: Flat, inside: np.ndarray) -> Words:
    """The longest runs of bytes for which `inside` holds; no run reaches from one text into the next."""
    data, bounds = texts
    within = inside[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[bounds] = True
    first = within.copy()
    first[1:] &= ~within[:-1] | begins[1:-1]
    last = within.copy()
    last[:-1] &= ~within[1:] | begins[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(strings_of(data[within], np.cumsum(ends - starts)), starts, np.searchsorted(starts, bounds))


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `size` bytes of text, whole rows each."""
    if not batch.num_rows:
        return
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    cuts = np.flatnonzero(np.diff((total - 1) // size)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(lo, hi - lo)


ASCII_LOWER = bytes(range(256)).lower()
