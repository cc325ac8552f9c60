"""Vectorised text kernels: whole Arrow batches at a time, in slices whose size bounds memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np

#: Characters handled at once. A longer text is a slice of its own, never cut.
SLICE_CHARS = 1 << 18
SPACE = 32


@lru_cache(1)
def alnum_table() -> np.ndarray:
    """By code point: whether it is a letter or a digit."""
    return np.fromiter(map(str.isalnum, map(chr, range(0x110000))), bool, 0x110000)


@lru_cache(1)
def letter_table() -> np.ndarray:
    """By code point: whether it is a letter."""
    return np.fromiter((category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def slices(texts: list[str], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` characters together."""
    first, chars = 0, 0
    for i, t in enumerate(texts):
        if i > first and chars + len(t) > most:
            yield first, i
            first, chars = i, 0
        chars += len(t)
    if first < len(texts):
        yield first, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def words(texts: list[str], kinds: Callable[[], np.ndarray] = alnum_table) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of letters and digits (of other characters with another table), without case: the index of its text and a 64-bit hash."""
    joined = codes("\n".join(texts).lower())
    inside = kinds()[joined]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64)
    np.cumprod(powers, out=powers)
    value = (joined[inside].astype(np.uint64) + np.uint64(0x1F3D)) * powers[place]
    # lower() may change the length of a text, so texts are found by their separators
    breaks = np.cumsum([0, *(len(t.lower()) + 1 for t in texts)])
    return np.searchsorted(breaks, starts, "right") - 1, mix64(np.add.reduceat(value, first))


def padded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points with every run of other characters as one space and each text between spaces; each text's start and length."""
    low = [t.lower() for t in texts]
    joined = codes(" " + "\0".join(low).replace("\0", "  ") + " ") if not any("\0" in t for t in low) else codes(" " + "  ".join(t.replace("\0", " ") for t in low) + " ")
    lengths = np.fromiter((len(t) + 2 for t in low), np.int64, len(low))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    letters = alnum_table()[joined]
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    keep[starts] = True  # the space before a text
    out = np.where(letters, joined, SPACE).astype(np.uint32)[keep]
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out, kept[starts], kept[ends] - kept[starts]


def gram_buckets(text_codes: np.ndarray, orders: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """By order n: the bucket of the n-gram that starts at each place, for as many places as have one."""
    h = np.zeros(len(text_codes), np.uint32)
    for n in range(1, max(orders) + 1):
        if len(text_codes) < n:
            return
        h = h[: len(text_codes) - n + 1] * np.uint32(0x01000193) + (text_codes[n - 1 :] + np.uint32(0x9E37)) * np.uint32(0x85EBCA6B)
        if n in orders:
            b = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * n)
            yield n, (b ^ (b >> np.uint32(13))) * np.uint32(0x9E3779B1) >> np.uint32(32 - bits)


def sums_by_text(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Sums of per-place values (one or more columns) over the n-grams that lie wholly in each text."""
    out = np.zeros((len(starts), *values.shape[1:]))
    whole = np.flatnonzero(lengths >= n)
    if len(whole):
        # pairs of first place and the place behind the last: reduceat gives the sum of each pair at even places
        at = np.stack([starts[whole], starts[whole] + lengths[whole] - n + 1], 1).ravel()
        more = np.concatenate([values, np.zeros((1, *values.shape[1:]), values.dtype)])
        out[whole] = np.add.reduceat(more, at, axis=0, dtype=np.float64)[::2]
    return out
