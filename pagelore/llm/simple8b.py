"""Simple-8b: a selector of 4 bits says how many ids of how many bits the other 60 bits of a 64-bit word hold.

Ids of 60 bits or more take an escape word (selector 0) and a raw word. Ids are cut into blocks of BLOCK; each block
begins a new word, and the words' offsets by block let any run of blocks be decoded at once, without a loop over ids.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 16
#: Ids per word and bits per id, by selector; selector 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0], np.int64)
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0], np.int64)
ESCAPE, WHOLE = 0, 14
_SHIFT = np.uint64(60)


def _choices(ids: np.ndarray) -> np.ndarray:
    """The selector that packs most of the ids from each place on: the highest class of width in a window decides.

    Class k needs BITS[k] bits; classes and windows rise together, so each window is put together from smaller ones.
    """
    n = len(ids)
    widest = np.ones(n, np.uint8)
    for selector in range(1, WHOLE):
        widest += ids >= np.uint64(1 << int(BITS[selector]))
    choice = np.full(n, WHOLE, np.uint8)
    size, window = 1, widest
    for selector in range(WHOLE - 1, 0, -1):
        count = int(COUNTS[selector])
        if count > n:
            break
        longer = n - count + 1
        window = np.maximum(window[:longer], window[count - size : count - size + longer])  # overlaps, as count <= 2 * size
        size = count
        choice[:longer][window <= selector] = selector
    choice[ids >= np.uint64(1 << 60)] = ESCAPE
    return choice


def _pack_block(ids: np.ndarray) -> np.ndarray:
    n = len(ids)
    choice = _choices(ids)
    steps = COUNTS[choice].astype(np.uint8).tobytes()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts)
    selectors = choice[starts]
    escaped = selectors == ESCAPE
    slots = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(escaped)[:-1]])
    words = np.zeros(len(starts) + int(escaped.sum()), np.uint64)
    words[slots] = selectors.astype(np.uint64) << _SHIFT
    for selector in np.unique(selectors):
        own, first = slots[selectors == selector], starts[selectors == selector]
        if selector == ESCAPE:
            words[own + 1] = ids[first]
            continue
        for k in range(int(COUNTS[selector])):
            words[own] |= ids[first + k] << np.uint64(k * BITS[selector])
    return words


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): offsets[k] is where block k's words begin, with the number of words at last."""
    ids = np.ascontiguousarray(ids, np.uint64)
    blocks = [_pack_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(np.int64)
    return np.concatenate([np.zeros(0, np.uint64), *blocks]), offsets


def unpack(words: np.ndarray) -> np.ndarray:
    """The ids of whole blocks' words. Only where escapes occur are their raw words told apart first."""
    selectors = (words >> _SHIFT).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selectors == ESCAPE).any():
        at = 0
        escapes = np.flatnonzero(selectors == ESCAPE)
        for e in escapes.tolist():  # a raw word may look like an escape
            if e >= at:
                raw[e + 1] = True
                at = e + 2
    counts = np.where(raw, 0, COUNTS[selectors])
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    first = ends - counts
    for selector in np.unique(selectors[~raw]) if len(words) else ():
        own = np.flatnonzero((selectors == selector) & ~raw)
        if selector == ESCAPE:
            out[first[own]] = words[own + 1]
            continue
        mask = np.uint64((1 << int(BITS[selector])) - 1)
        for k in range(int(COUNTS[selector])):
            out[first[own] + k] = (words[own] >> np.uint64(k * BITS[selector])) & mask
    return out


def unpack_range(words: np.ndarray, offsets: np.ndarray, start: int, end: int) -> np.ndarray:
    """Ids start to end, touching only the blocks they lie in."""
    first, last = start // BLOCK, (end + BLOCK - 1) // BLOCK
    return unpack(words[offsets[first] : offsets[last]])[start - first * BLOCK : end - first * BLOCK]
