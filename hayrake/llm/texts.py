"""Word positions and word hashes of Arrow text columns, vectorised over the raw UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; word boundaries are respected, so results do not depend on it.
PIECE = 1 << 19
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2**64
_powers = np.ones(1, dtype=U64)
_inverse = np.ones(1, dtype=U64)

#: Byte classes. A-Z count as letters and are lower-cased by LOWER.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
NOT_NEWLINE = np.ones(256, dtype=bool)
NOT_NEWLINE[10] = False

#: Kinds of bytes in units: blanks, letters (ASCII, and the two bytes of U+00C0 to U+00FF), digits, other printable ASCII, and the rest.
BLANK, LETTER, DIGIT, MARK, ODD = range(5)
KIND = np.full(256, ODD, dtype=np.uint8)
KIND[33:127] = MARK
KIND[[9, 10, 13, 32]] = BLANK
KIND[65:91] = KIND[97:123] = LETTER
KIND[48:58] = DIGIT
#: Second bytes of U+00C0 to U+00FF: their kinds (the signs for times and division are no letters) and lower-case forms.
LATIN = np.full(256, ODD, dtype=np.uint8)
LATIN[0x80:0xC0] = LETTER
LATIN[[0x97, 0xB7]] = ODD
LATIN_LOW = np.arange(256, dtype=np.uint8)
LATIN_LOW[0x80:0x9F] += 32
NOT_BLANK = KIND != BLANK
#: Longest unit, in bytes, that is not ODD.
UNIT_BYTES = 24
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)

_caches: dict[str, Callable[[], None]] = {}


def begin(operator: str, clear: Callable[[], None] | None = None) -> None:
    """To be called at the start of a task: a worker, which may serve several operators, keeps the caches of one only."""
    for name in [n for n in _caches if n != operator]:
        _caches.pop(name)()
    if clear is not None:
        _caches[operator] = clear
    pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the n + 1 offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) <= n:
        size = max(n + 1, PIECE + 1)
        with np.errstate(over="ignore"):
            step = np.full(size, _BASE, dtype=U64)
            step[0] = 1
            _powers = np.multiply.accumulate(step)
            step[1:] = pow(_BASE, -1, 1 << 64)
            _inverse = np.multiply.accumulate(step)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = table[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[:-1] < offsets[1:]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def pieces(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about PIECE bytes that cut no word: at a row's start or at a byte outside words."""
    at, end = 0, len(data)
    while at < end:
        to = min(end, at + PIECE)
        if to < end:
            row = offsets[np.searchsorted(offsets, to, side="right") - 1]
            if row > at:
                to = int(row)
            else:
                while to < end and table[data[to]]:  # one long word or text: on to the next byte outside words
                    step = np.flatnonzero(~table[data[to : to + PIECE]])
                    to = to + int(step[0]) if len(step) else min(end, to + PIECE)
                nxt = offsets[np.searchsorted(offsets, at, side="right")]
                to = min(to, int(nxt)) if nxt > at else to
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, rows and 64-bit hashes of all words: maximal runs of bytes of a class.

    fold lower-cases A-Z before hashing. Equal words have equal hashes
    wherever they stand; texts of any length are handled in bounded pieces.
    """
    starts, ends, hashes = [], [], []
    for a, b in pieces(data, offsets, table):
        part = data[a:b]
        lo, hi = np.searchsorted(offsets, a, side="left"), np.searchsorted(offsets, b, side="right")
        inner = np.unique(np.concatenate([[0], offsets[lo:hi] - a, [b - a]]))
        s, e = _spans(part, inner, table)
        _grow(len(part))
        with np.errstate(over="ignore"):
            byte = (LOWER[part] if fold else part).astype(U64) + U64(1)
            total = np.zeros(len(part) + 1, dtype=U64)
            np.cumsum(byte * _powers[: len(part)], out=total[1:])
            h = (total[e] - total[s]) * _inverse[s]
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(mix(h))
    if not starts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, np.zeros(0, dtype=U64)
    s, e = np.concatenate(starts), np.concatenate(ends)
    return s, e, np.searchsorted(offsets, s, side="right") - 1, np.concatenate(hashes)


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of n rows starts in a sorted array of row numbers (n + 1 positions)."""
    return np.searchsorted(rows, np.arange(n + 1))


def groups_of_rows(offsets: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes together (one row alone may be longer)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def units(part: np.ndarray, rows: np.ndarray, odd: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and kinds of the units of some bytes, and the bytes in lower case with UNIT_BYTES zeros after them.

    A unit is a run of letters, one digit or a run of marks. What stands
    between blanks and holds a byte of the kind ODD, a longer unit or one of
    the places in odd is one unit of the kind ODD, as a whole. rows are the
    places where texts begin; no unit crosses them.
    """
    kind, low = KIND[part], np.zeros(len(part) + UNIT_BYTES, dtype=np.uint8)
    low[: len(part)] = LOWER[part]
    if (part >= 128).any():
        lead = np.flatnonzero(part[:-1] == 0xC3)
        kind[lead], kind[lead + 1], low[lead + 1] = LETTER, LATIN[part[lead + 1]], LATIN_LOW[part[lead + 1]]
    new = kind == DIGIT
    new[1:] |= kind[1:] != kind[:-1]
    new[rows] = True
    if len(new):
        new[0] = True
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(part))
    k = kind[s]
    full = k != BLANK
    bad = [np.flatnonzero(k == ODD), np.flatnonzero((e - s > UNIT_BYTES) & full)]
    if odd is not None and len(odd):
        bad.append(np.searchsorted(s, odd, side="right") - 1)
    bad = np.concatenate(bad)
    if len(bad):
        begins = np.zeros(len(part) + 1, dtype=bool)
        begins[rows] = True
        first = full & (np.concatenate([[True], ~full[:-1]]) | begins[s])
        last = full & np.concatenate([first[1:] | ~full[1:], [True]])
        form = np.cumsum(first) - 1
        gone = np.zeros(int(first.sum()), dtype=bool)
        gone[form[bad]] = True
        whole = np.flatnonzero(first)[gone]
        inside = full & gone[np.maximum(form, 0)]
        e[whole], k[whole] = e[last][gone], ODD
        full &= ~inside
        full[whole] = True
    return s[full], e[full], k[full], low


class Remembered:
    """An index of units by their exact bytes, of a fixed size: a unit has one place, and the last one that was put there stays."""

    def __init__(self, places: int) -> None:
        self.shift = np.uint64(64 - max(1, places.bit_length() - 1))
        self.keys = np.zeros((1 << (64 - int(self.shift)), 3), dtype=U64)

    def find(self, low: np.ndarray, s: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, places, and whether the unit is known there, of the units at s of n bytes (at most UNIT_BYTES)."""
        eight = np.ndarray((len(low) - 7,), "<u8", buffer=low, strides=(1,))
        keys = np.zeros((len(s), 3), dtype=U64)
        with np.errstate(over="ignore"):
            keys[:, 0] = eight[s] & _MASK[np.minimum(n, 8)]
            h = keys[:, 0] * U64(_BASE)
            for c in (1, 2):
                more = np.flatnonzero(n > 8 * c)
                keys[more, c] = eight[s[more] + 8 * c] & _MASK[np.minimum(n[more] - 8 * c, 8)]
                h[more] = (h[more] ^ (h[more] >> U64(29)) ^ keys[more, c]) * U64(0xBF58476D1CE4E5B9)
            place = (((h ^ (h >> U64(32))) * U64(0x94D049BB133111EB)) >> self.shift).astype(np.int64)
        return keys, place, (self.keys[place] == keys).all(axis=1)

    def put(self, keys: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Remembers units at their places; returns which ones (one for each place)."""
        _, at = np.unique(place, return_index=True)
        self.keys[place[at]] = keys[at]
        return at


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different key first stands in order, and for every key the number of its first."""
    order = np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))
    ordered = keys[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])[: len(keys)]
    back = np.empty(len(keys), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


class Numbers:
    """An exact map from different 64-bit keys (not all bits set) to their numbers in order."""

    def __init__(self, keys: np.ndarray) -> None:
        self.none = len(keys)
        self.shift = U64(64 - max(1, (4 * len(keys)).bit_length()))
        self.keys = np.full(1 << (64 - int(self.shift)), ~U64(0), dtype=U64)
        self.numbers = np.full(len(self.keys), self.none, dtype=np.int32)
        left, step = np.arange(len(keys)), 0
        while len(left):
            at = self._place(keys[left], step)
            free = np.flatnonzero(self.keys[at] == ~U64(0))
            put = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[put]], self.numbers[at[put]] = keys[left[put]], left[put]
            left, step = np.delete(left, put), step + 1

    def _place(self, keys: np.ndarray, step: int) -> np.ndarray:
        return (((keys * U64(_BASE)) >> self.shift).astype(np.int64) + step) & (len(self.keys) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The numbers of keys; none for those that are not in the map."""
        at = self._place(keys, 0)
        found = self.keys[at]
        other = found != keys
        out = self.numbers[at]
        out[other] = self.none
        left, step = np.flatnonzero(other & (found != ~U64(0))), 1
        while len(left):
            at = self._place(keys[left], step)
            found = self.keys[at]
            same = found == keys[left]
            out[left[same]] = self.numbers[at[same]]
            left, step = left[~same & (found != ~U64(0))], step + 1
        return out
