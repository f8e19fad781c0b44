"""Simple-8b: 64-bit words, the upper 4 bits a selector, the lower 60 bits as many ids as the selector says.

A block holds up to BLOCK ids: its words, then its escapes.  An id of more than ESCAPE_BITS bits is packed
as 0 and kept apart with its place, so that one wide id does not thin out the words around it and decoding
stays a few vector operations per selector."""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 15
ESCAPE_BITS = 30
# Ids in a word and bits of each, by selector.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, places of escapes and their values, for one block of unsigned ids."""
    n = len(ids)
    v = ids.astype(np.uint64)
    wide = v >= np.uint64(1 << ESCAPE_BITS)
    places = np.flatnonzero(wide).astype(np.uint32)
    values = v[wide]
    v = np.where(wide, np.uint64(0), v)
    bits = np.zeros(n, np.int8)
    for b in range(ESCAPE_BITS):
        more = v >= np.uint64(1 << b)
        if not more.any():
            break
        bits += more
    # The selector for a word that starts at each place: the most ids that all fit; runs past the end are padded.
    longest = np.ones(n, np.int64)
    selector = np.full(n, len(COUNTS) - 1, np.uint64)
    most, reach = np.append(bits, np.zeros(64, np.int8)), 1
    for s in range(len(COUNTS) - 2, -1, -1):
        while reach < COUNTS[s]:  # most[i] = max of bits[i : i + reach]
            step = min(reach, COUNTS[s] - reach)
            most = np.maximum(most, np.append(most[step:], np.zeros(step, np.int8)))
            reach += step
        fits = most[:n] <= WIDTHS[s]
        if not fits.any():
            break
        longest[fits] = COUNTS[s]
        selector[fits] = s
    nxt, starts, i = (np.arange(n) + longest).tolist(), [], 0
    while i < n:
        starts.append(i)
        i = nxt[i]
    starts = np.array(starts, np.int64)
    chosen = selector[starts]
    words = chosen << np.uint64(60)
    padded = np.append(v, np.zeros(64, np.uint64))
    for s in np.unique(chosen):
        at = np.flatnonzero(chosen == s)
        c, w = COUNTS[int(s)], WIDTHS[int(s)]
        shifts = (np.arange(c) * w).astype(np.uint64)
        words[at] |= np.bitwise_or.reduce(padded[starts[at][:, None] + np.arange(c)] << shifts, axis=1)
    return words, places, values


def unpack(words: np.ndarray, n: int, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The ``n`` ids of a block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[selector]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(selector):
        at = np.flatnonzero(selector == s)
        c, w = COUNTS[s], WIDTHS[s]
        shifts = (np.arange(c) * w).astype(np.uint64)
        out[starts[at][:, None] + np.arange(c)] = (words[at][:, None] >> shifts) & np.uint64((1 << w) - 1)
    out = out[:n]
    out[places] = values
    return out
