"""CRC-32 of many byte spans at once.

The CRC register is linear over XOR: a span's register, begun at zero, is the XOR of what each byte gives
on its own, and that depends on the byte and its distance from the span's end only. ``NEAR`` distances
are tabulated; longer spans are cut into blocks of ``NEAR`` bytes from their end, and blocks are folded in
pairs by operators that append zero bytes. The usual start and end values add a constant of the length.
"""

from __future__ import annotations

import numpy as np

NEAR = 64
_FOLD = 6                                   # 2 ** _FOLD == NEAR
CHUNK = 1 << 20
FULL = np.uint32(0xFFFFFFFF)


def _byte_step() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_STEP = _byte_step()


def _zero_byte(register: np.ndarray) -> np.ndarray:
    return (register >> np.uint32(8)) ^ _STEP[register & np.uint32(255)]


def _positions() -> np.ndarray:
    out = np.empty((NEAR, 256), np.uint32)
    out[0] = _STEP
    for d in range(1, NEAR):
        out[d] = _zero_byte(out[d - 1])
    return out


_POSITION = _positions().ravel()            # [distance from the end * 256 + byte]
_append: list[np.ndarray] = []              # [j][4 * 256]: 2 ** j zero bytes after each byte of a register


def _apply(table: np.ndarray, register: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return (table[register & low] ^ table[256 + ((register >> np.uint32(8)) & low)]
            ^ table[512 + ((register >> np.uint32(16)) & low)] ^ table[768 + (register >> np.uint32(24))])


def _zeros(j: int) -> np.ndarray:
    """The operator that appends 2 ** j zero bytes."""
    while len(_append) <= j:
        if not _append:
            each = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).ravel()
            _append.append(_zero_byte(each))
        else:
            _append.append(_apply(_append[-1], _append[-1]))
    return _append[j]


def advance(register: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Each register after ``zeros`` zero bytes."""
    register, zeros = np.array(register, np.uint32), np.asarray(zeros)
    for j in range(int(zeros.max(initial=0)).bit_length()):
        at = np.flatnonzero((zeros >> j) & 1)
        register[at] = _apply(_zeros(j), register[at])
    return register


_CONSTANT = advance(np.full(NEAR + 1, FULL), np.arange(NEAR + 1)) ^ FULL


def _fold(values: np.ndarray, owner: np.ndarray, from_end: np.ndarray) -> np.ndarray:
    """One register an owner out of its blocks' registers, first block first; ``from_end`` counts blocks after it."""
    level = _FOLD
    while from_end.max(initial=0) > 0:
        odd = np.flatnonzero(from_end & 1)
        values[odd] = _apply(_zeros(level), values[odd])
        from_end = from_end >> 1
        head = np.ones(len(values), bool)
        head[1:] = (owner[1:] != owner[:-1]) | (from_end[1:] != from_end[:-1])
        head = np.flatnonzero(head)
        values, owner, from_end = np.bitwise_xor.reduceat(values, head), owner[head], from_end[head]
        level += 1
    return values


def _registers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum())) + np.repeat(starts - first, lengths)
    after = np.repeat(ends - 1, lengths) - at
    values = _POSITION[((after & (NEAR - 1)) << 8) | data[at]]
    if lengths.max() <= NEAR:
        return np.bitwise_xor.reduceat(values, first)
    head = (after & (NEAR - 1)) == NEAR - 1
    head[first] = True
    head = np.flatnonzero(head)
    owner = np.searchsorted(first, head, "right") - 1
    return _fold(np.bitwise_xor.reduceat(values, head), owner, after[head] >> _FOLD)


def registers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The register of each span ``data[starts:ends]`` begun at zero. Spans may overlap; an empty one has 0. Works in
    runs of about ``CHUNK`` bytes, or of one span where that is longer."""
    out = np.zeros(len(starts), np.uint32)
    held = np.flatnonzero(ends > starts)
    total = np.cumsum(ends[held] - starts[held])
    at = 0
    while at < len(held):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + CHUNK, "right")))
        some = held[at:to]
        out[some] = _registers(data, starts[some], ends[some])
        at = to
    return out


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span, as ``zlib.crc32`` gives it."""
    lengths = ends - starts
    constant = _CONSTANT[np.minimum(lengths, NEAR)]
    far = np.flatnonzero(lengths > NEAR)
    if len(far):
        constant[far] = advance(np.full(len(far), FULL), lengths[far]) ^ FULL
    return registers(data, starts, ends) ^ constant


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes where ``inside`` holds, never across the document borders ``offsets`` (n+1):
    starts, ends, and the number of the first run of each document (n+1)."""
    n = len(inside)
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[offsets] = False
    starts = np.flatnonzero(inside & ~before[:n])
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[offsets] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)
