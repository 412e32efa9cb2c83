"""Word shingles of whole texts as 64-bit hashes, and MinHash signatures of their sets, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit values whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 256), _BASE)]))
    return _powers


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of concatenated UTF-8 texts, A-Z folded, and each text's first word.

    at: where texts begin, and the end. Words never span texts.
    """
    inside = ~_BLANK[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < len(data)]
    begins[edge] = inside[edge]
    first = np.flatnonzero(begins)
    bounds = np.searchsorted(first, at)
    if not len(first):
        return np.empty(0, np.uint64), bounds
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.append(first, len(data)))) if first[0] == 0 else None
    if place is None:
        place = np.arange(first[0], len(data)) - np.repeat(first, np.diff(np.append(first, len(data))))
        data, inside, first = data[first[0] :], inside[first[0] :], first - first[0]
    powers = _power_table(int(place.max()) + 1)
    with np.errstate(over="ignore"):
        terms = (_FOLD[data].astype(np.uint64) + np.uint64(1)) * powers[place]
        terms[~inside] = 0
        return mix(np.add.reduceat(terms, first)), bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles of `size` words, and bounds per text.

    A text with fewer words, but one at least, has its whole sequence as one shingle.
    """
    n = np.diff(bounds)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(ends[-1], np.uint64)
    with np.errstate(over="ignore"):
        factors = mix(np.arange(1, size + 2, dtype=np.uint64))
        full = np.repeat(n >= size, counts)
        start = np.repeat(bounds[:-1] - ends[:-1], counts) + np.arange(ends[-1])
        begin = start[full]
        total = np.full(len(begin), factors[size])
        for k in range(size):
            total += words[begin + k] * (factors[k] | np.uint64(1))
        out[full] = mix(total)
        for i in np.flatnonzero((n > 0) & (n < size)):
            part = words[bounds[i] : bounds[i + 1]]
            total = np.sum(part * (factors[: len(part)] | np.uint64(1)), dtype=np.uint64) + np.uint64(len(part))
            out[ends[i]] = mix(np.array([total]))[0]
    return out, ends


def text_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, where texts begin) for runs of rows of about `size` bytes; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(at, at[row] + size, side="right")) - 1)
        yield row, data[at[row] : at[to]], at[row : to + 1] - at[row]
        row = to


def sets_of(texts: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each text) for runs of rows."""
    for row, data, at in text_slices(texts):
        words, bounds = word_hashes(data, at)
        hashes, ends = shingle_hashes(words, bounds, size)
        yield row, [np.unique(hashes[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def signatures(sets: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """MinHash values (texts x seeds, 32 bits) of non-empty sets; of empty ones, the largest value."""
    out = np.full((len(sets), len(seeds)), np.iinfo(np.uint32).max, np.uint32)
    odd = mix(seeds) | np.uint64(1)
    shift = mix(seeds + np.uint64(1 << 32))
    live = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(live):
        to, n = at, 0
        while to < len(live) and (n == 0 or n + len(sets[live[to]]) <= 16_384):
            n += len(sets[live[to]])
            to += 1
        group = [sets[i] for i in live[at:to]]
        values = np.concatenate(group)
        first = np.concatenate([[0], np.cumsum([len(g) for g in group])[:-1]])
        with np.errstate(over="ignore"):
            for k in range(len(seeds)):
                hashed = ((values * odd[k] + shift[k]) >> np.uint64(32)).astype(np.uint32)
                out[live[at:to], k] = np.minimum.reduceat(hashed, first)
        at = to
    return out
