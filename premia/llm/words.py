"""Words of whole Arrow batches as numpy arrays: spans, document numbers and 64-bit hashes.

Texts are handled as one run of UTF-8 bytes with document offsets. A word is a run of bytes of a
given class, so spans come from comparisons of neighbouring bytes and never from a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 2 << 20  # bytes of text handled at a time; a longer document is a piece of its own
SEGMENT = 1 << 20  # bytes hashed at a time

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
ROOT = 0x9E3779B97F4A7C15 | 1
CHAIN = 0xD1342543DE82EF95


def byte_class(*members: int) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


def not_space() -> np.ndarray:
    return ~byte_class(*SPACES)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; every other byte as it is."""

    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table[data]


def pieces(column, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into (first row, end row, bytes, offsets) of at most ``limit`` bytes.

    NULL counts as empty. Texts are never cut.
    """

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if n == 0:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Words(NamedTuple):
    """Spans in bytes of every word, and the document (row of the piece) that holds it."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    per_doc: np.ndarray  # number of words of each document
    first: np.ndarray  # place of each document's first word; one more entry at the end


def find_words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Runs of bytes of the class ``inside``; a document's end always ends a word."""

    n_docs = len(offsets) - 1
    mask = inside[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(mask)
    after = np.empty_like(mask)
    if len(mask):
        before[0] = False
        before[1:] = mask[:-1]
        after[-1] = False
        after[:-1] = mask[1:]
    before &= ~edge[:-1]
    after &= ~edge[1:]
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    per_doc = np.bincount(doc, minlength=n_docs).astype(np.int64)
    first = np.zeros(n_docs + 1, dtype=np.int64)
    np.cumsum(per_doc, out=first[1:])
    return Words(starts, ends, doc, per_doc, first)


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""

    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit sways every output bit."""

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_sums(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values[start + j] * base^j over each run, modulo 2^64, from one running sum."""

    scale = powers(base, len(values) + 1)
    back = powers(pow(base, -1, 1 << 64), len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * scale[:-1], out=total[1:])
    return (total[ends] - total[starts]) * back[starts]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; the spans are in order and apart."""

    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + SEGMENT, side="right")))
        part = data[base : ends[j - 1]].astype(np.uint64) + np.uint64(1)
        out[i:j] = run_sums(part, ROOT, starts[i:j] - base, ends[i:j] - base)
        i = j
    return mixed(out)


def hash_windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every ``n`` consecutive entries; callers drop windows across documents."""

    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(count)
    return mixed(run_sums(hashes, CHAIN, at, at + n))


def window_starts(words: Words, n: int) -> np.ndarray:
    """Mask over hash_windows(.., n): does the window stay within one document?"""

    count = len(words.doc) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=bool)
    return words.doc[:count] == words.doc[n - 1 :]


def in_document(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The hash joined with the number of its document."""

    return mixed(hashes ^ (doc.astype(np.uint64) * np.uint64(ROOT)))


def covered(marked: np.ndarray, n: int, length: int) -> np.ndarray:
    """Mask over ``length`` words: is the word in a window of ``n`` words that starts at a marked place?"""

    edge = np.zeros(length + 1, dtype=np.int32)
    edge[marked] += 1
    edge[np.minimum(marked + n, length)] -= 1
    return np.cumsum(edge[:-1]) > 0
