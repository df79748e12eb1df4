"""Simple-8b: integers packed into 64-bit words, as many to a word as its selector says.

A word's top four bits are its selector: 0 to 13 stand for 60 // w integers of w bits each, w from WIDTHS.  Selector 15 is the escape for
integers of more than 60 bits: two such words in a row hold the low 60 bits and the rest.  Integers are packed in blocks of
BLOCK; a block begins with a new word, so that a reader can begin at any block, and decodes many of them at once.
"""

from __future__ import annotations

import numpy as np

# fixed values: bits of an integer for selectors 0 to 13
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE = 15
BLOCK = 512  # integers

_LIMITS = np.array([(1 << w) - 1 for w in WIDTHS], np.uint64)
_COUNTS = np.array([*[60 // w for w in WIDTHS], 0, 1], np.int64)
_LOW = np.uint64((1 << 60) - 1)
_PAD = 60  # places beyond a block's end, where nothing needs any bits
_SMALL = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), "left").astype(np.uint8)


def _selectors(size: np.ndarray) -> np.ndarray:
    """For each place the selector that takes most integers from there on; size has the least selector that can hold each integer, a block a
    row, with places beyond its end."""
    best = np.full(size.shape, ESCAPE, np.uint8)
    flat = size.ravel()
    for s in range(min(int(flat.max()), len(WIDTHS) - 1), -1, -1):
        fits, held, step, need = flat <= s, None, 1, int(_COUNTS[s])
        at = 0
        while True:  # runs of 1, 2, 4, ... places that fit are put together to as many as the selector takes
            if need & step:
                held = fits.copy() if held is None else held[: len(held) - step] & fits[at : at + len(held) - step]
                at += step
            if 2 * step > need:
                break
            fits = fits[:-step] & fits[step:]
            step *= 2
        np.copyto(best.ravel()[: len(held)], np.uint8(s), where=held)
    return best


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, how many words each block takes) of unsigned integers."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    blocks, wide = -(-n // BLOCK), BLOCK + _PAD
    padded = np.zeros((blocks, wide), np.uint64)
    padded[: n // BLOCK, :BLOCK] = values[: n // BLOCK * BLOCK].reshape(-1, BLOCK)
    if n % BLOCK:
        padded[-1, : n % BLOCK] = values[n // BLOCK * BLOCK :]
    small = int(padded.max()) < len(_SMALL)
    best = _selectors(_SMALL[padded] if small else np.searchsorted(_LIMITS, padded.ravel(), "left").astype(np.uint8).reshape(padded.shape)).ravel()
    begin = np.arange(blocks) * wide
    end = begin + BLOCK
    end[-1] = begin[-1] + (n - 1) % BLOCK + 1
    taken, pos = [], begin
    while len(pos):  # all blocks' next words at a time
        taken.append(pos)
        pos = pos + _COUNTS[best[pos]]
        live = pos < end
        pos, end = pos[live], end[live]
    pos = np.sort(np.concatenate(taken))
    chosen, flat = best[pos], padded.ravel()
    width = 1 + (chosen == ESCAPE)
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    for s in np.unique(chosen).tolist():
        of = np.flatnonzero(chosen == s)
        p, at = pos[of], place[of]
        if s == ESCAPE:
            words[at] = flat[p] & _LOW | np.uint64(ESCAPE << 60)
            words[at + 1] = flat[p] >> np.uint64(60) | np.uint64(ESCAPE << 60)
            continue
        word = np.full(len(of), s << 60, np.uint64)
        for j in range(int(_COUNTS[s])):
            word |= flat[p + j] << np.uint64(j * WIDTHS[s])
        words[at] = word
    return words, np.bincount(pos // wide, width, blocks).astype(np.int64)


def decode(words: np.ndarray, per_block: np.ndarray, n: int) -> np.ndarray:
    """The n integers of whole blocks, of which all but the last are full."""
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    count = _COUNTS[selector]
    escapes = np.flatnonzero(selector == ESCAPE)
    count[escapes[1::2]] = 0
    first = np.cumsum(per_block) - per_block  # each block's first word
    before = np.cumsum(count) - count
    begin = np.arange(len(per_block)) * BLOCK
    pos = before + np.repeat(begin - before[first], per_block) if len(words) else before
    end = np.repeat(np.minimum(begin + BLOCK, n), per_block)
    out = np.zeros(n, np.uint64)
    for s in np.unique(selector).tolist():
        if s == ESCAPE:
            low, high = escapes[::2], escapes[1::2]
            out[pos[low]] = words[low] & _LOW | (words[high] & _LOW) << np.uint64(60)
            continue
        of = np.flatnonzero(selector == s)
        mask = _LIMITS[s]
        for j in range(int(_COUNTS[s])):
            live = of[pos[of] + j < end[of]]
            out[pos[live] + j] = words[live] >> np.uint64(j * WIDTHS[s]) & mask
    return out
