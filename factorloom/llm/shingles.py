"""Weighted word shingles and their ProbMinHash signatures, vectorised over many texts.

A text's words are what white space (the six ASCII kinds) separates.  Its shingles are
all runs of ``SHINGLE`` words; a text of fewer words has one shingle of all of them, and
one without words has none.  A shingle weighs as often as it occurs.
"""

from __future__ import annotations

import numpy as np

SHINGLE = 5
#: Texts whose shingles are worked on together; their numbers share a word with the hash.
TEXTS_AT_ONCE = 4096
_HASH_BITS = 52
_HASH_MASK = np.uint64((1 << _HASH_BITS) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Fixed multipliers of a published 64-bit finaliser.
_FIN = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= _FIN[0]
    x ^= x >> np.uint64(33)
    x *= _FIN[1]
    x ^= x >> np.uint64(33)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, _ODD, np.uint64)
        up[0] = 1
        down = np.full(size, pow(int(_ODD), -1, 1 << 64), np.uint64)
        down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts end to end, and each text's first word (n + 1 values)."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~space
    begin = inside.copy()
    begin[1:] &= space[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= space[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = mixed((sums[stops] - sums[starts]) * down[starts])
    return h, np.searchsorted(starts, offsets)


def weighted_shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of every distinct shingle of the texts, by text and shingle."""
    n = len(offsets) - 1
    if n > TEXTS_AT_ONCE:
        raise ValueError("too many texts at once")
    h, first = word_hashes(data, offsets)
    words = np.diff(first)
    h = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    whole = np.zeros(len(h) - SHINGLE, np.uint64)
    for j in range(SHINGLE):
        whole = whole * _ODD + h[j : j + len(whole)]
    text = np.repeat(np.arange(n), words)
    last = np.repeat(first[1:], words) - SHINGLE
    full = np.arange(len(whole)) <= last
    key, owner = [mixed(whole[full])], [text[full]]
    for t in np.flatnonzero((words > 0) & (words < SHINGLE)):
        x = np.zeros(1, np.uint64)
        for w in h[first[t] : first[t + 1]]:
            x = x * _ODD + w
        key.append(mixed(x + np.uint64(words[t])))
        owner.append(np.array([t]))
    tagged = np.concatenate(owner).astype(np.uint64) << np.uint64(_HASH_BITS) | np.concatenate(key) >> np.uint64(64 - _HASH_BITS)
    tagged.sort()
    if not len(tagged):
        return np.zeros(0, np.int64), tagged, np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(tagged[1:] != tagged[:-1]) + 1])
    weight = np.diff(np.append(starts, len(tagged)))
    tagged = tagged[starts]
    return (tagged >> np.uint64(_HASH_BITS)).astype(np.int64), tagged & _HASH_MASK, weight


def prob_minhash(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """The shingle that arrives first at each register of each text (texts x registers).

    Each shingle sends points of a Poisson process of its weight's rate, seeded by the
    shingle alone, to registers drawn evenly.  A shingle stops when its next point would
    come after the latest of its text's registers, which is when no later one can win.
    Registers of texts without shingles are 0.
    """
    arrival = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, np.uint64)
    now = np.zeros(len(text))
    owner, key, rate = text, shingle, weight.astype(np.float64)
    turn = 0
    while len(owner):
        base = key * _ODD + np.uint64(2 * turn + 1)
        gap = mixed(base)
        now = now - np.log1p(-((gap >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate
        if turn:
            latest = arrival.reshape(texts, registers).max(axis=1)
            alive = now < latest[owner]
            owner, key, rate, now, base = owner[alive], key[alive], rate[alive], now[alive], base[alive]
        slot = owner * registers + ((mixed(base ^ _FIN[1]) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(arrival, slot, now)
        won = arrival[slot] == now
        winner[slot[won]] = key[won]
        turn += 1
    return winner.reshape(texts, registers)


def band_keys(winner: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each run of ``rows`` registers (texts x bands), as signed numbers."""
    texts, registers = winner.shape
    parts = winner.reshape(texts, registers // rows, rows)
    key = np.broadcast_to(np.arange(registers // rows, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(rows):
        key = mixed(key * _ODD + parts[:, :, j])
    return key.view(np.int64)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Sum over shared shingles i of 1 / sum over j of max(wa_j / wa_i, wb_j / wb_i).

    The shingles of each side are distinct and sorted.  For equal weights this is the
    Jaccard index of the two sets.  Two sides without shingles have 0.
    """
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = b[at] == a
    if not shared.any():
        return 0.0
    x, y = wa[shared].astype(np.float64), wb[at[shared]].astype(np.float64)
    only_a = float(wa[~shared].sum())
    only_b = float(wb.sum()) - float(y.sum())
    pairs, times = np.unique(np.stack([x, y]), axis=1, return_counts=True)
    total = 0.0
    for (p, q), t in zip(pairs.T, times, strict=True):
        total += t / (float((np.maximum(pairs[0] / p, pairs[1] / q) * times).sum()) + only_a / p + only_b / q)
    return total
