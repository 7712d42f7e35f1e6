"""Encoding texts by their chunks: each distinct chunk is tokenised once a batch, and frequent ones once a worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .textkernel import word_hashes

#: Slots of the cache of chunks (even), and ids held before it starts anew.
SLOTS, MOST_IDS = 1 << 21, 12 << 20
#: Bytes of ASCII letters, and of printable ASCII characters.
LETTER, PRINTED = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
PRINTED[0x21:0x7F] = True


def space_cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where chunks begin if a run of spaces opens a chunk; texts begin one too."""
    begin = data == 0x20
    begin[1:] &= data[:-1] != 0x20
    begin[at[:-1][at[:-1] < at[1:]]] = True
    return np.flatnonzero(begin)


def opening(never: bytes) -> np.ndarray:
    """For each byte, whether a space before it begins a chunk (see byte_level_cuts)."""
    plain = np.zeros(256, bool)
    plain[0x21:0x7F] = plain[0xC3:] = True
    plain[[0xE1, 0xE2, 0xE3, *never]] = False
    return plain


def stopping(inside: bytes) -> np.ndarray:
    """For each byte, whether it begins a chunk behind a Latin letter (see byte_level_cuts)."""
    stop = PRINTED & ~LETTER
    stop[[0x27, *range(0x30, 0x3A), *inside]] = False
    return stop


def byte_level_cuts(data: np.ndarray, at: np.ndarray, never: bytes = b"", inside: bytes = b"") -> np.ndarray:
    """Where chunks begin that a byte-level BPE's usual pattern never joins, so that most chunks are one word or what stands behind it.

    A chunk begins before the space in front of a character that is no white space: the pattern leaves such a space to the word behind
    it, whatever stands before. It begins before ASCII punctuation other than the apostrophe behind an ASCII letter or one of U+00C0 to
    U+00FF, as letters end there. And it begins before an ASCII letter behind a single line feed that follows a printable ASCII
    character: such a line feed is a piece of its own, whether a letter or nothing follows. The pattern looks at nothing before the
    place where a piece begins.
    Characters that may be white space beyond ASCII (those whose first byte is C2, E1, E2 or E3) begin no chunk, nor do the bytes
    ``never``: first bytes of added tokens, before which the pattern ends and a space stays with those before it. Punctuation among
    ``inside``, all bytes of added tokens, begins none, so that no such token is cut; they hold no white space.
    """
    begin = np.zeros(len(data), bool)
    begin[:-1] = (data[:-1] == 0x20) & opening(never)[data[1:]]
    letter = LETTER[data]
    behind = letter[:-1].copy()
    behind[1:] |= (data[:-2] == 0xC3) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
    begin[1:] |= behind & stopping(inside)[data[1:]]
    lines = np.flatnonzero(data[1:-1] == 0x0A) + 2
    lines = lines[letter[lines] & opening(never)[data[lines]] & PRINTED[data[lines - 2]]]
    begin[lines[np.searchsorted(at, lines, "right") == np.searchsorted(at, lines - 2, "right")]] = True  # all three in one text
    ends = at[1:][at[:-1] < at[1:]] - 1
    begin[ends[data[ends] == 0x20]] = False  # what follows a text's last byte belongs to the next text
    begin[at[:-1][at[:-1] < at[1:]]] = True
    return np.flatnonzero(begin)


def gather(off: np.ndarray, size: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """pool[off[i] : off[i] + size[i]] for all i, joined."""
    total = int(size.sum())
    if not total:
        return pool[:0]
    index = np.repeat(off - (np.cumsum(size) - size), size)
    index += np.arange(total)
    return pool[index]


def differing(data: np.ndarray, at: np.ndarray, back: np.ndarray, sizes: np.ndarray) -> list[int]:
    """Numbers of the texts that are not what their ids gave back (back: all bytes, sizes: how many each text has)."""
    if len(back) == len(data) and (sizes == np.diff(at)).all() and (back == data).all():
        return []
    ends, raw, own = np.cumsum(sizes), memoryview(back.tobytes()), memoryview(data.tobytes())
    return [i for i, (e, n, a, b) in enumerate(zip(ends.tolist(), sizes.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)) if raw[e - n : e] != own[a:b]]


def replaced(ids: np.ndarray, sizes: np.ndarray, new: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """ids and sizes with those of some texts replaced."""
    if not new:
        return ids, sizes
    ends = np.cumsum(sizes)
    lists = [np.asarray(new[i], np.int32) if i in new else ids[e - n : e] for i, (e, n) in enumerate(zip(ends.tolist(), sizes.tolist(), strict=True))]
    return np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists))


class Chunks:
    """Ids of chunks by 64-bit hash, in a table of paired slots: a chunk that falls on another's slot sends it to the slot beside, where
    it replaces a third.

    Two chunks of one hash would share ids; callers decode what they get and encode a text anew, without the table, where it differs.
    """

    def __init__(self, encode: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]]):
        """encode: gets chunks and their variants, gives all their ids, joined, and how many each has."""
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.key, self.off, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(1 << 20, np.int32), 0

    def ids(self, data: np.ndarray, at: np.ndarray, cuts: np.ndarray, variant: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has. variant: of each chunk, a small number that takes part in its key."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
        if self.used > MOST_IDS:
            self.clear()
        ends = np.append(cuts[1:], len(data))
        key = word_hashes(data, cuts, ends) | np.uint64(1)
        if variant is not None:
            key = (key ^ (variant.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        slot = (key >> np.uint64(17)).astype(np.int64) & (SLOTS - 1)
        known = self.key[slot] == key
        other = np.flatnonzero(~known)
        other = other[self.key[slot[other] ^ 1] == key[other]]
        slot[other] ^= 1
        known[other] = True
        off, size = self.off[slot].astype(np.int64), self.size[slot].astype(np.int64)
        if not known.all():
            new = np.flatnonzero(~known)
            one, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            some = new[first]
            raw = data.tobytes()
            flat, n = self.encode([raw[a:b] for a, b in zip(cuts[some].tolist(), ends[some].tolist(), strict=True)], None if variant is None else variant[some])
            where = self.used + np.cumsum(n) - n
            if self.used + len(flat) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(1 << 20, 2 * len(flat)), np.int32)])
            self.pool[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            off[new], size[new] = where[back], n[back]
            at_slot = slot[some]
            full = at_slot[self.key[at_slot] != 0]
            for held in (self.key, self.off, self.size):  # what was there goes to the slot beside
                held[full ^ 1] = held[full]
            self.key[at_slot], self.off[at_slot], self.size[at_slot] = one, where, n
        ids = gather(off, size, self.pool)
        upto = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(cuts, at)]
        return ids, np.diff(upto)
