"""Hashes of words and of runs of words, in numpy, the same in every task."""

from __future__ import annotations

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD_BASE = 0xD6E8FEB86659FD93
_CHUNK = 1 << 20  # bytes of a text that are hashed at once; cut between words

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))  # A-Z only; other alphabets' bytes stay

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the word base and of its inverse, for at least n places."""
    while len(_powers[0]) < n:
        size = len(_powers[0])
        for i, base in enumerate((_WORD_BASE, pow(_WORD_BASE, -1, 1 << 64))):
            _powers[i] = np.concatenate([_powers[i], _powers[i] * np.uint64(pow(base, size, 1 << 64))])
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _codes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_SPACE[raw]
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    power, inverse = _power_tables(len(raw))
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(BASES[1]))


def word_codes(text: str | None, lower: bool = False) -> np.ndarray:
    """A 64-bit code of each word between white space (space, tab, LF, VT, FF, CR); lower takes A-Z as a-z."""
    if not text:
        return np.empty(0, np.uint64)
    data = text.encode("utf-8", "surrogatepass")
    if lower:
        data = data.translate(LOWER)
    if len(data) <= _CHUNK:
        return _codes(data)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(_codes(data[at:end]))
        at = end
    return np.concatenate(parts)


def run_hashes(codes: np.ndarray, length: int, base: int) -> np.ndarray:
    """A polynomial hash (mod 2^64) of every run of `length` codes, in about log2(length) passes."""
    n = len(codes) - length + 1
    if n <= 0 or length <= 0:
        return np.empty(0, np.uint64)
    out, at, size, parts = np.zeros(n, np.uint64), 0, 1, []
    part = codes
    while True:
        parts.append((size, part))
        if size * 2 > length:
            break
        part = part[:-size] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
        size *= 2
    for size, part in reversed(parts):
        if length & size:
            out = out * np.uint64(pow(base, size, 1 << 64)) + part[at:at + n]
            at += size
    return out


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every `width` neighbours."""
    size = 1
    while size * 2 <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


_KIND = np.full(256, 3, np.int8)  # symbols
_KIND[_SPACE] = 0
_KIND[[b for b in range(256) if chr(b).isascii() and chr(b).isalpha() or b >= 0x80]] = 1
_KIND[list(range(0x30, 0x3A))] = 2


def token_runs(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, kinds, bytes and capitals of the runs of letters (1), digits (2) and symbols (3).

    All bytes of other alphabets count as letters; capitals are A-Z. A text is cut into slices at white space.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(_runs(data[at:end]))
        at = end
    if not parts:
        return np.empty(0, np.uint64), np.empty(0, np.int8), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts))


def _runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    kind = _KIND[raw]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(kind)) + 1])
    ends = np.append(starts[1:], len(raw))
    inside = kind[starts] > 0
    starts, ends = starts[inside], ends[inside]
    power, inverse = _power_tables(len(raw))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], out=sums[1:])
        codes = mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    upper = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw >= 65) & (raw <= 90), out=upper[1:])
    return codes, kind[starts], ends - starts, upper[ends] - upper[starts]
