"""64-bit hashes of byte windows, over whole arrays at once."""

from __future__ import annotations

import numpy as np

# Odd bases of the hashes, and the constants of the splitmix64 finaliser below.
_BASES = (0xA24BAED4963EE407, 0x9FB21C651E98DF25)
_TABLES = [np.random.default_rng(20240611 + k).integers(0, 1 << 64, 256, np.uint64) for k in range(len(_BASES))]
STEP = 4096
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cumulated(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def _steps(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** 0 .. base ** (STEP - 1) and the powers of base ** STEP, from whose products those up to n follow; kept, as they are short."""
    low, high = _powers.get(base, (None, None))
    if high is None or len(high) * STEP < n:
        low, high = _cumulated(base, STEP), _cumulated(pow(base, STEP, 1 << 64), max(1024, -(-n // STEP)))
        _powers[base] = low, high
    return low, high


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    low, high = _steps(base, n)
    return (high[: -(-n // STEP), None] * low).ravel()[:n]


def _power_at(base: int, at: np.ndarray) -> np.ndarray:
    """base ** at."""
    low, high = _steps(base, int(at.max(initial=0)) + 1)
    return high[at // STEP] * low[at % STEP]


def prefix(raw: np.ndarray, which: int = 0) -> np.ndarray:
    """Sums from which the polynomial hash of any window follows in two steps; one longer than ``raw``."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_TABLES[which][raw] * _power(pow(_BASES[which], -1, 1 << 64), len(raw)), out=out[1:])
    return out


def windows(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, sums: np.ndarray | None = None, which: int = 0) -> np.ndarray:
    """Polynomial hashes, modulo 2 ** 64 and over a random table of bytes, of raw[start:end]; not yet mixed.

    ``which`` chooses one of two hashes, of independent tables and different bases; ``sums`` are of the same one.
    """
    sums = prefix(raw, which) if sums is None else sums
    return (sums[ends] - sums[starts]) * _power_at(_BASES[which], starts)
