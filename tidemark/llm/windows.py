"""Repeated windows of a sequence, found by the least fingerprint of a window.

A window of n symbols has n - k + 1 grams of k symbols; the least hash among them is the window's anchor.  Equal windows
have equal anchors, and neighbouring windows mostly share theirs, so a run of windows with one anchor is one entry: about
2 / (n - k + 2) entries for a symbol.  A window can stand elsewhere only if its anchor has another entry, or its run
holds the anchor's gram twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE, OTHER_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
LONG = 256  # bytes from which a word goes through a hash function of its own


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def words(texts: pa.Array, lower: bool = False, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of all texts, and how many words the texts have up to each one's end.

    texts: strings; null has no words.  lower: A-Z as a-z.  Words are read 8 bytes at a time, all of the texts together.
    """
    import xxhash

    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    n = int(at[-1] - at[0])
    data = np.zeros(n + 8, np.uint8)
    if n:
        data[:n] = np.frombuffer(texts.buffers()[2], np.uint8, n, int(at[0]))
    at -= at[0]
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data[:n]]
    before, behind = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], behind[:-1] = inside[:-1], inside[1:]
    before[at[:-1][at[:-1] < n]] = False  # a word ends with its text
    behind[at[1:][at[1:] > 0] - 1] = False
    first, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~behind) + 1
    size = stop - first
    lanes = np.ndarray((n + 1,), "<u8", data, strides=(1,))
    h = size.astype(np.uint64) + np.uint64(seed * int(OTHER_BASE) & (1 << 64) - 1)
    some = np.flatnonzero(size <= LONG)
    done = 0
    while len(some):
        left = size[some] - done
        h[some] = mix(h[some] * BASE + (lanes[first[some] + done] & _MASK[np.minimum(left, 8)]))
        done += 8
        some = some[left > 8]
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = xxhash.xxh64_intdigest(data[first[k] : stop[k]].tobytes(), seed)
    return h, np.searchsorted(first, at[1:], "left")


def powers(n: int, base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2**64, i < n (a table that grows by doubling)."""
    have = _TABLES.get(int(base))
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for b in (int(base), pow(int(base), -1, 1 << 64)):
            a = np.ones(size, np.uint64)
            done = 1
            while done < size:
                a[done : 2 * done] = a[:done] * np.uint64(pow(b, done, 1 << 64))
                done *= 2
            out.append(a)
        _TABLES[int(base)] = have = tuple(out)
    return have[0][:n], have[1][:n]


def prefix(h: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Sums of h[i] * base ** i before each place."""
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h), base)[0], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, size: np.ndarray | int, base: np.uint64 = BASE) -> np.ndarray:
    """Hashes of stretches of the sequence that the sums belong to."""
    return mix((sums[start + size] - sums[start]) * powers(len(sums), base)[1][start])


def sliding(pick: np.ufunc, h: np.ndarray, w: int) -> np.ndarray:
    """np.minimum or np.maximum of each w neighbours."""
    n = len(h) - w + 1
    if n <= 0:
        return h[:0]
    size, m = 1, h
    while 2 * size <= w:
        m = pick(m[:-size], m[size:])
        size *= 2
    return pick(m[:n], m[w - size : w - size + n])


def runs(h: np.ndarray, ends: np.ndarray, n: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (anchor, start, windows, owner, again).

    h: hashes of the symbols of documents one after another, which end at `ends`.  again: the anchor's gram stands at two
    or more places of the document.
    """
    return placed_runs(h, ends, n, k)[:5]


def placed_runs(h: np.ndarray, ends: np.ndarray, n: int, k: int) -> tuple[np.ndarray, ...]:
    """As runs(), and the anchor's place behind the run's start; of several places any one."""
    empty = np.zeros(0, np.int64)
    if len(h) < n:
        return empty.astype(np.uint64), empty, empty, empty, empty.astype(bool), empty
    sums = prefix(h)
    grams = (sums[k:] - sums[:-k]) * powers(len(h))[1][: len(h) - k + 1]
    grams, w = mix(grams), n - k + 1
    low = sliding(np.minimum, grams, w)
    sizes = np.diff(np.concatenate([[0], ends]))
    owner = np.repeat(np.arange(len(ends)), sizes)
    valid = np.arange(len(low)) + n <= ends[owner[: len(low)]]
    change = np.empty(len(low), bool)
    change[0] = True
    change[1:] = (low[1:] != low[:-1]) | (owner[1 : len(low)] != owner[: len(low) - 1])
    start = np.flatnonzero(change & valid)
    if not len(start):
        return empty.astype(np.uint64), empty, empty, empty, empty.astype(bool), empty
    # a run ends where the next begins, or where its document's windows end
    stop = np.minimum(np.append(start[1:], len(low)), ends[owner[start]] - n + 1)
    anchor, own, count = low[start], owner[start], stop - start
    # places whose gram is the least of a window around them; those with one gram in one document
    pad = np.zeros(w - 1, np.uint64)
    place = np.flatnonzero(sliding(np.maximum, np.concatenate([pad, low, pad]), w) == grams)
    key = grams[place] + owner[place].astype(np.uint64) * BASE
    order = np.argsort(key)
    key = key[order]
    first = np.searchsorted(key, anchor + own.astype(np.uint64) * BASE)
    twice = np.append(key[1:] == key[:-1], False)[first]
    return anchor, start, count, own, twice, place[order[first]] - start


def covered(starts: np.ndarray, counts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of `size` symbols are covered by windows of n symbols; window starts are given as runs."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + counts + n - 1, size), -1)
    return np.cumsum(step[:-1]) > 0
