"""Simple-8b: 64-bit words whose top four bits select how many values of how many bits share the other sixty.

Values are cut into blocks of ``BLOCK``; each block starts a new word, so a block's words decode by themselves, and the
offsets of blocks (in words) are stored. Encoding and decoding run over all blocks of a segment at once. A value of more
than sixty bits is an escape: its word has selector 15, and the value itself stands in a list beside the words.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
# Fixed values of the code: (values in a word, bits of each) for selectors 0 to 14.
SELECTORS = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
_COUNTS = np.array([n for n, _ in SELECTORS] + [1], np.int64)
_PAD = max(n for n, _ in SELECTORS)


_SHORT = np.array([k.bit_length() for k in range(1 << 16)], np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits of each value."""
    if not len(values) or values.max() < len(_SHORT):
        return _SHORT[values]
    out = np.zeros(values.shape, np.uint8)
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        high = rest >> np.uint64(step)
        big = high > 0
        out += np.uint8(step) * big
        rest = np.where(big, high, rest)
    return out + (rest > 0)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the offset of each block's first word with the end last, and the escaped values in order."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint64)
    grid = np.zeros((blocks, BLOCK + _PAD), np.uint64)
    flat = np.zeros(blocks * BLOCK, np.uint64)
    flat[:n] = values
    grid[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    width = _widths(grid)
    # Widest value among the next k, for every k that a selector packs: each from two shorter runs.
    runs = {1: width}
    for k in sorted({k for k, _ in SELECTORS} - {1}):
        a = max(x for x in runs if x < k and 2 * x >= k)
        wide = runs[a].copy()
        wide[:, : -(k - a)] = np.maximum(runs[a][:, : -(k - a)], runs[a][:, k - a :])
        runs[k] = wide
    choice = np.full(width.shape, ESCAPE, np.uint8)
    for s in range(len(SELECTORS) - 1, -1, -1):
        k, bits = SELECTORS[s]
        np.copyto(choice, np.uint8(s), where=runs[k] <= bits)
    # Follow each block's chain of words, all blocks a step at a time.
    length = np.minimum(BLOCK, n - BLOCK * np.arange(blocks))
    at, live, steps = np.zeros(blocks, np.int64), np.arange(blocks), []
    while len(live):
        here = at[live]
        s = choice[live, here]
        steps.append((live, here, s))
        at[live] = here + _COUNTS[s]
        live = live[at[live] < length[live]]
    block = np.concatenate([x[0] for x in steps])
    start = np.concatenate([x[1] for x in steps])
    sel = np.concatenate([x[2] for x in steps])
    order = np.lexsort((start, block))
    block, start, sel = block[order], start[order], sel[order]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s, (k, bits) in enumerate(SELECTORS):
        if bits and len(i := np.flatnonzero(sel == s)):
            part = grid[block[i, None], start[i, None] + np.arange(k)]
            words[i] |= np.bitwise_or.reduce(part << (np.uint64(bits) * np.arange(k, dtype=np.uint64)), axis=1)
    big = np.flatnonzero(sel == ESCAPE)
    return words, np.searchsorted(block, np.arange(blocks + 1)).astype(np.uint32), grid[block[big], start[big]]


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values."""
    blocks = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    block = np.repeat(np.arange(blocks), np.diff(offsets.astype(np.int64)))
    ends = np.cumsum(_COUNTS[sel])
    starts = ends - _COUNTS[sel]
    within = starts - starts[offsets[:-1]][block] + block * (BLOCK + _PAD)
    out = np.zeros(blocks * (BLOCK + _PAD), np.uint64)
    for s, (k, bits) in enumerate(SELECTORS):
        if bits and len(i := np.flatnonzero(sel == s)):
            mask = np.uint64((1 << bits) - 1)
            out[within[i, None] + np.arange(k)] = (words[i, None] >> (np.uint64(bits) * np.arange(k, dtype=np.uint64))) & mask
    out[within[sel == ESCAPE]] = escapes
    return out.reshape(blocks, -1)[:, :BLOCK].reshape(-1)[:n]
