"""Tables of a byte-level BPE vocabulary, as numpy arrays with a hashed pair lookup."""

from __future__ import annotations

import base64
import functools
import json
import re
from array import array

import numpy as np
import regex

#: Splits text before the merges of the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ANY = regex.compile(SPLIT).findall
_LAST_LATIN = 0x24F


def _latin(kind: str) -> str:
    """A character class of the code points up to ``_LAST_LATIN`` of this kind."""
    return "".join(map(re.escape, regex.findall(kind, "".join(map(chr, range(_LAST_LATIN + 1))))))


_L, _N, _S = map(_latin, (r"\p{L}", r"\p{N}", r"\s"))
_BEYOND = re.compile(f"[^\0-{chr(_LAST_LATIN)}]").search
_FAST = re.compile(
    f" ?[{_L}]+| ?[{_N}]+|'(?:[stmd]|re|ve|ll)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall


def split(text: str) -> list[str]:
    """The matches of ``SPLIT``; Latin text takes an equal pattern with plain classes, twice as fast."""
    return _ANY(text) if _BEYOND(text) else _FAST(text)


NO_RANK = np.int32(2**31 - 1)
_EMPTY = np.uint64(2**64 - 1)
_HASH = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """``(left id, right id) -> value`` by open addressing; many lookups at a time."""

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        size = 1 << int(4 * max(len(key), 1)).bit_length()
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.mask = np.int64(size - 1)
        self.keys = np.full(size, _EMPTY, np.uint64)
        self.values = np.full(size, NO_RANK, np.int32)
        at, todo = self._home(key), np.arange(len(key))
        while len(todo):
            free = todo[self.keys[at[todo]] == _EMPTY]
            slots, first = np.unique(at[free], return_index=True)
            self.keys[slots], self.values[slots] = key[free[first]], value[free[first]]
            todo = todo[self.keys[at[todo]] != key[todo]]
            at[todo] = (at[todo] + 1) & self.mask

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key * _HASH) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The values of the pairs, ``NO_RANK`` where there is none."""
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._home(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], NO_RANK)
        todo = np.flatnonzero((found != key) & (found != _EMPTY))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != _EMPTY)]
        return out


def _read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


def _by_id(ranks: dict[bytes, int]) -> list[bytes]:
    token = [b""] * (max(ranks.values()) + 1)
    for data, rank in ranks.items():
        token[rank] = data
    return token


class Ranks:
    """A rank file: token bytes in base 64 and rank on each line; ids are ranks.

    Two neighbours may merge when their joined bytes are a token, in the order of its rank.
    """

    def __init__(self, path: str):
        self.ranks = _read_ranks(path)
        self.token = _by_id(self.ranks)
        left, right, value = array("i"), array("i"), array("i")
        for data, rank in self.ranks.items():
            for cut in range(1, len(data)):
                a, b = self.ranks.get(data[:cut]), self.ranks.get(data[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), value.append(rank)
        self._made = left, right, value
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(value, np.int32))
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)

    @functools.cached_property
    def pair(self) -> dict[tuple[int, int], int]:
        """The pairs one by one, made when a long piece first asks."""
        return {(a, b): r for a, b, r in zip(*self._made)}


def _byte_letters() -> dict[str, int]:
    """The printable letter by which the .json form writes each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """A .json vocabulary with its list of merges, and the tree that its tokens form.

    ``step[node, byte]`` walks the tree of token bytes; ``token_of[node]`` is the token that
    ends at a node or -1.  ``rank``, ``left`` and ``right`` tell when and of what a token is
    made; bytes have rank -1.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        letters = _byte_letters()
        ids = model["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        n = max([*ids.values(), *self.special.values()]) + 1
        self.rank, self.left, self.right = (np.full(n, -1, np.int64) for _ in range(3))
        data: dict[int, bytes] = {}
        for text, i in ids.items():
            if all(c in letters for c in text) and len(text) == 1:
                data[i] = bytes([letters[text]])
        for rank, (a, b) in enumerate(pairs):
            made = ids[a + b]
            if self.rank[made] < 0 and made not in data:
                self.rank[made], self.left[made], self.right[made] = rank, ids[a], ids[b]
                data[made] = data[ids[a]] + data[ids[b]]
        a, b = np.array([[ids[x], ids[y]] for x, y in pairs], np.int64).T
        self.pairs = PairTable(a, b, np.arange(len(a), dtype=np.int32))
        nodes: dict[bytes, int] = {b"": 0}
        steps: list[tuple[int, int, int]] = []
        ends: dict[int, int] = {}
        for i, token in data.items():
            for cut in range(1, len(token) + 1):
                if token[:cut] not in nodes:
                    nodes[token[:cut]] = len(nodes)
                    steps.append((nodes[token[:cut - 1]], token[cut - 1], nodes[token[:cut]]))
            ends[nodes[token]] = i
        node, byte, child = np.array(steps, np.int64).T
        self.step = PairTable(node, byte, child.astype(np.int32))
        self.token_of = np.full(len(nodes), -1, np.int64)
        self.token_of[list(ends)] = list(ends.values())
        # A token that the merges make another way never stands at the end of a text.
        made = np.flatnonzero(self.rank >= 0)
        for i in made[~self.fit(self.left[made], self.right[made], self.rank[made])]:
            self.token_of[nodes[data[int(i)]]] = -1

    def fit(self, left: np.ndarray, right: np.ndarray, ended: np.ndarray | None = None) -> np.ndarray:
        """Whether the encoding of two tokens' joined bytes is just these two.

        The merges inside both tokens are undone, latest first.  In between, the tokens at
        the border stand beside each other; had they a merge that comes before the next
        inner one, or at the same rank further to the left, they would have been joined.
        ``ended``: only merges before this rank count, one for each pair.
        """
        x, y = np.asarray(left, np.int64).copy(), np.asarray(right, np.int64).copy()
        good = np.ones(len(x), bool)
        live = np.arange(len(x))
        limit = np.full(len(x), 2**31 - 2, np.int64) if ended is None else ended - 1
        while len(live):
            a, b = x[live], y[live]
            clash = self.pairs.find(a, b) <= limit[live]
            good[live[clash]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~clash & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            # The left one's last merge comes first at equal ranks, so it is undone last.
            undo_left = ra > rb
            x[live] = np.where(undo_left, self.right[a], a)
            y[live] = np.where(undo_left, b, self.left[b])
            limit[live] = np.where(undo_left, ra - 1, rb)
        return good


@functools.cache
def load_ranks(path: str) -> Ranks:
    return Ranks(path)


@functools.cache
def load_tokens(path: str) -> list[bytes]:
    """The bytes of each id, all that decoding needs."""
    return _by_id(_read_ranks(path))


@functools.cache
def load_merges(path: str) -> Merges:
    return Merges(path)


class Recent(dict):
    """A bounded memory of results."""

    def __init__(self, entries: int):
        super().__init__()
        self.entries = entries

    def with_new(self, found: dict, need: set) -> dict:
        """Adds the results; when full, keeps only those of the present ``need`` if they fit.

        Returns a mapping that has all of ``need``.
        """
        if len(self) + len(found) > self.entries:
            now = {p: self[p] for p in need if p in self} | found
            self.clear()
            if len(now) > self.entries:
                return now
            self.update(now)
        else:
            self.update(found)
        return self
