"""Words, word hashes and shingles of Arrow batches of texts, by numpy over their UTF-8 bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of the blocks that are hashed at once.
BLOCK = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_tables: dict[str, np.ndarray] = {}


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each text begins; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    at = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def pieces(column: pa.Array, most: int = 4 * BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about ``most`` bytes together, or a single longer text."""
    at, lo = flat(column)[1], 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            table = np.full(BLOCK + 1, base, np.uint64)
            table[0] = 1
            _tables[name] = np.multiply.accumulate(table)
    return _tables["up"], _tables["down"]


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and for each text the number of its first word (and, last, the number of words)."""
    space = SPACE[data]
    word = ~space
    first, last = word.copy(), word.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    full = at[:-1] < at[1:]
    heads, tails = at[:-1][full], at[1:][full] - 1
    first[heads] |= word[heads]
    last[tails] |= word[tails]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, from prefix sums, finally mixed. Memory is bounded by BLOCK."""
    up, down = _powers()
    out = np.zeros(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = int(np.searchsorted(end, start[lo] + BLOCK, "right"))
        if hi == lo:  # a word longer than a block
            out[lo] = np.frombuffer(hashlib.blake2b(data[start[lo] : end[lo]].tobytes(), digest_size=8).digest(), np.uint64)[0]
            lo += 1
            continue
        base = start[lo]
        part = data[base : end[hi - 1]].astype(np.uint64)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * up[: len(part)], out=sums[1:])
        s = start[lo:hi] - base
        out[lo:hi] = (sums[end[lo:hi] - base] - sums[s]) * down[s]
        lo = hi
    return mixed(out)


def shingles(hashes: np.ndarray, first: np.ndarray, width: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words within each text, and for each text the number of its first run.

    short: a text of fewer words, but one at least, has all its words as its only run; else it has none.
    """
    count = np.diff(first)
    runs = np.maximum(0, count - width + 1)
    few = np.flatnonzero((count > 0) & (count < width)) if short else np.zeros(0, int)
    runs[few] = 1
    at = np.concatenate([[0], np.cumsum(runs)])
    begin = np.repeat(first[:-1] - at[:-1], runs) + np.arange(at[-1])
    out = np.zeros(at[-1], np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    for k in range(width):
        out += padded[begin + k] * np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64))
    for i in few:
        own = hashes[first[i] : first[i + 1]]
        out[at[i]] = np.uint64(int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little"))
    return mixed(out), at


def by_group(key: str, work: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over partitions sorted by an integer key: work on the rows of one key at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(batch.schema.get_field_index(key)).to_numpy()
            bounds = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if held and k[lo] != at:
                    if (out := work(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                at = k[lo]
                held.append(batch.slice(lo, hi - lo))
        if held and (out := work(pa.Table.from_batches(held))) is not None:
            yield out

    return run
