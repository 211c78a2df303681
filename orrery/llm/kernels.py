"""Vectorised text kernels that the operators of this subpackage share.

All of them work on an Arrow string column as one byte buffer, so the cost per
character is a handful of numpy passes, whatever the lengths of the texts.

Words are maximal runs of characters other than the six ASCII white-space
characters, lower-cased.  A null text has no words, exactly like an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WINDOW = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: For words of letters alone: everything in ASCII that is no letter separates.
_NOT_LETTER = np.arange(256) < 128
_NOT_LETTER[65:91] = _NOT_LETTER[97:123] = False
#: For words of letters and digits.
_NOT_WORD = _NOT_LETTER.copy()
_NOT_WORD[48:58] = False
_SEPARATORS = {"space": _SPACE, "letters": _NOT_LETTER, "plain": _NOT_WORD}
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of word hashes spread over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, _WINDOW + 4096)

        def row(base: int) -> np.ndarray:
            x = np.full(size, base, np.uint64)
            x[0] = 1
            return np.cumprod(x, dtype=np.uint64)

        _powers = row(_BASE), row(_INVERSE)
    return _powers


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the n + 1 offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1 + texts.offset)[texts.offset :] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.cast(pa.large_string()))


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and how many words each text has."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    solid = ~separators[data]
    before = np.empty(n, bool)
    before[:1] = True
    np.logical_not(solid[:-1], out=before[1:])
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = True
    np.logical_not(solid[1:], out=after[:-1])
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each of the ascending spans, windows of about a million at a time.

    values: uint64, or bytes, which stand for random odd numbers.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _WINDOW, side="right")))
        last = ends[j - 1]
        forward, back = _power(int(last - base) + 1)
        total = np.zeros(int(last - base) + 1, np.uint64)
        own = values[base:last]
        np.cumsum((_BYTES[own] if own.dtype == np.uint8 else own) * forward[: last - base], dtype=np.uint64, out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (total[e] - total[s]) * back[s]
        i = j
    return mix(out)


word_hashes = rolling


def words(texts: pa.Array, kind: str = "space") -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words in order, and how many each text has.

    kind: what words are made of: everything but white space, letters, or letters and digits ("plain").
    """
    data, offsets = buffers(lower(texts))
    starts, ends, counts = word_bounds(data, offsets, _SEPARATORS[kind])
    return word_hashes(data, starts, ends), counts


def ngrams(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-grams in order, and how many each text has.

    A text of 1 to n - 1 words has one gram, of all its words.
    """
    steps = [np.uint64(pow(_BASE, k + 2, 1 << 64)) for k in range(n)]
    at = np.concatenate(([0], np.cumsum(counts)))
    have = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    if not len(hashes):
        return np.zeros(0, np.uint64), have
    firsts = np.repeat(at[:-1] - np.concatenate(([0], np.cumsum(have)[:-1])), have) + np.arange(int(have.sum()))
    whole = np.repeat(counts >= n, have)
    total = np.zeros(len(firsts), np.uint64)
    room = np.repeat(at[1:], have)
    for k in range(n):
        place = firsts + k
        inside = place < room
        word = hashes[np.minimum(place, len(hashes) - 1)] * steps[k]
        total += word if whole.all() else np.where(inside, word, np.uint64(0))
    return mix(total), have


def runs(sorted_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(sorted_ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], sorted_ids[1:] != sorted_ids[:-1])))
    return starts, np.diff(np.concatenate((starts, [len(sorted_ids)])))


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)


def windows(counts: np.ndarray, n: int) -> np.ndarray:
    """Where windows of n words start that lie within one text, over the words of all texts."""
    at = np.cumsum(counts) - counts
    have = np.maximum(counts - n + 1, 0)
    return spans(at, have)


def _slide(x: np.ndarray, w: int, how) -> np.ndarray:
    """how over x[i : i + w] for every i, as two running passes over blocks of w."""
    n = len(x)
    fill = np.uint64(0xFFFFFFFFFFFFFFFF) if how is np.minimum else np.uint64(0)
    pad = np.full(-(-(n + w) // w) * w, fill, np.uint64)
    pad[:n] = x
    blocks = pad.reshape(-1, w)
    ahead = how.accumulate(blocks, axis=1).ravel()
    behind = how.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return how(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(hashes: np.ndarray, counts: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: of any w consecutive k-word windows of a text the least hash is chosen.

    Gives the chosen windows' first words (over all texts) and their hashes.
    """
    first = windows(counts, k)
    if not len(first):
        return first, np.zeros(0, np.uint64)
    h = rolling(hashes, first, first + k)
    have = np.maximum(counts - k + 1, 0)
    start = np.cumsum(have) - have
    valid = np.zeros(len(h), bool)
    valid[spans(start, np.maximum(have - w + 1, 0))] = True
    least = np.where(valid, _slide(h, w, np.minimum), np.uint64(0))
    # A window is chosen if it is the least of some valid w: the greatest such least is its own hash.
    most = _slide(np.concatenate((np.zeros(w - 1, np.uint64), least)), w, np.maximum)[: len(h)]
    chosen = most == h
    return first[chosen], h[chosen]
