"""Simple-8b: unsigned integers in 64-bit words.

The top four bits of a word are its selector, which says how many integers of how many bits the other sixty hold. The
encoder takes as many of the next integers as fit. An integer of more than sixty bits follows an escape word, raw. A
stream is cut in blocks of ``BLOCK`` integers, each beginning a word of its own; the offsets of the blocks (in words)
let a reader decode all blocks, or some of them, at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
#: (integers in a word, bits of each); selector 1 is the first. Selector 15 is the escape.
MODES = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
_COUNTS = np.array([0] + [n for n, _ in MODES] + [0], np.int64)
#: Window sizes in rising order, each as the union of two windows of a size before it: (size, part, shift of the second).
_WINDOWS = [(2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 4, 1), (6, 4, 2), (7, 4, 3), (8, 4, 4), (10, 8, 2), (12, 8, 4), (15, 8, 7), (20, 15, 5), (30, 15, 15), (60, 30, 30)]


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words as little-endian uint64, offset in words of each block)."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, np.int32)
    blocks = -(-n // BLOCK)
    wide = BLOCK + 60
    padded = np.zeros((blocks, wide), np.uint64)
    filled = np.zeros(blocks * BLOCK, np.uint64)
    filled[:n] = values
    padded[:, :BLOCK] = filled.reshape(blocks, BLOCK)
    bits = np.frexp(padded.astype(np.float64))[1].astype(np.uint8)
    selector = np.where(bits <= 60, len(MODES), ESCAPE).astype(np.uint8)
    most = {1: bits}
    by_size = {size: k + 1 for k, (size, _) in enumerate(MODES)}
    for size, part, shift in _WINDOWS:
        a = most[part]
        b = np.zeros_like(a)
        b[:, : wide - shift] = a[:, shift:]
        most[size] = np.maximum(a, b)
        selector[most[size] <= dict(MODES)[size]] = by_size[size]
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = n - (blocks - 1) * BLOCK
    take = np.where(np.arange(16) == ESCAPE, 1, _COUNTS)
    cost = np.where(np.arange(16) == ESCAPE, 2, 1)
    at, used, live = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64), np.arange(blocks)
    steps = []
    while len(live):
        p = at[live]
        s = selector[live, p]
        steps.append((live, p, used[live], s))
        at[live] = p + take[s]
        used[live] += cost[s]
        live = live[at[live] < lengths[live]]
    offsets = np.cumsum(used) - used
    words = np.zeros(int(used.sum()), np.uint64)
    block, start, rank, chosen = (np.concatenate([x[k] for x in steps]) for k in range(4))
    place = offsets[block] + rank
    flat = padded.reshape(-1)
    first = block * wide + start
    for s, (count, width) in enumerate(MODES, 1):
        m = np.flatnonzero(chosen == s)
        if len(m):
            word = np.full(len(m), np.uint64(s) << np.uint64(60))
            for k in range(count):
                word |= flat[first[m] + k] << np.uint64(k * width)
            words[place[m]] = word
    m = np.flatnonzero(chosen == ESCAPE)
    words[place[m]] = np.uint64(ESCAPE) << np.uint64(60)
    words[place[m] + 1] = flat[first[m]]
    return words.astype("<u8"), offsets.astype(np.int32)


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` integers that ``encode`` was given."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for k in np.flatnonzero(selector == ESCAPE):
        if not raw[k]:
            raw[k + 1] = True
    selector[raw] = 0
    counts = np.where(raw, 1, _COUNTS[selector])
    block = np.repeat(np.arange(len(offsets)), np.diff(np.append(offsets, len(words))))
    before = np.cumsum(counts) - counts
    within = before - before[np.asarray(offsets, np.int64)][block]
    for s, (count, width) in enumerate(MODES, 1):
        m = np.flatnonzero(selector == s)
        if s and len(m):
            mask = np.uint64((1 << width) - 1)
            for k in range(count):
                pos = within[m] + k
                place = block[m] * BLOCK + pos
                ok = (pos < BLOCK) & (place < n)
                out[place[ok]] = (words[m[ok]] >> np.uint64(k * width)) & mask
    m = np.flatnonzero(raw)
    out[block[m] * BLOCK + within[m]] = words[m]
    return out
