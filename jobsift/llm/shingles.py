"""Word shingles of texts as 64-bit hashes, many texts at a time in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes with A-Z in lower case.  A shingle
is a run of ``k`` words; a text with one to ``k - 1`` words has one shingle, the whole
sequence; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SLICE_BYTES = 1 << 20
SLICE_TEXTS = 2048
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of ``data``.

    A word's hash is a polynomial in its bytes; differences of one running sum give those
    of all words at once.
    """
    if not data:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    buf = np.frombuffer(data, np.uint8)
    white = np.concatenate(([True], _WHITE[buf], [True]))
    edges = np.flatnonzero(white[1:] != white[:-1])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * _powers(_BASE, len(buf)), dtype=np.uint64)))
    return mix((running[ends] - running[starts]) * _powers(_BASE_INVERSE, len(buf))[starts]), starts


def _pieces(text: bytes) -> Iterator[bytes]:
    """Parts of a very long text, cut between words."""
    while len(text) > SLICE_BYTES:
        cut = max(text.rfind(w, 0, SLICE_BYTES) for w in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= 0:
            found = [i for w in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (i := text.find(w, SLICE_BYTES)) >= 0]
            if not found:
                break
            cut = min(found)
        yield text[:cut]
        text = text[cut:]
    yield text


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(text number, shingle hash)`` of the texts, sorted by both."""
    if len(texts) == 1:
        hashes = np.concatenate([word_hashes(p)[0] for p in _pieces(texts[0])])
        owner = np.zeros(len(hashes), np.int64)
    else:
        hashes, starts = word_hashes(b" ".join(texts))
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        owner = np.searchsorted(begins, starts, side="right") - 1
    count = np.bincount(owner, minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    if not len(hashes):
        return owner, hashes
    acc = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
    for j in range(k):
        acc = mix(acc * _STEP + hashes[j:len(hashes) - k + 1 + j] + np.uint64(j + 1)) if len(acc) else acc
    whole = owner[:len(acc)] == owner[k - 1:] if len(acc) else np.empty(0, bool)
    ids, values = [owner[:len(acc)][whole]], [acc[whole]]
    first = np.concatenate(([0], np.cumsum(count)))
    for i in np.flatnonzero((count > 0) & (count < k)):
        value = np.zeros(1, np.uint64)
        for j, h in enumerate(hashes[first[i]:first[i + 1]]):
            value = mix(value * _STEP + h + np.uint64(j + 1))
        ids.append(np.array([i]))
        values.append(mix(value + np.uint64(count[i])))
    owner, values = np.concatenate(ids), np.concatenate(values)
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], values[new]


def slices(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    """Lower-case bytes of the texts, about ``SLICE_BYTES`` at a time; long ones alone."""
    part: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if part and (size + len(data) > SLICE_BYTES or len(part) == SLICE_TEXTS):
            yield part
            part, size = [], 0
        part.append(data)
        size += len(data) + 1
    if part:
        yield part
