"""Byte-level BPE encoding and decoding with padded numpy matrices.

Texts are split by the vocabulary's pattern.  The distinct pieces that a worker has not met
lately are put in matrices by length: one row per piece, one column per byte, padded.  Each
round every row merges its leftmost pair of least rank, found by a hashed pair lookup; the
columns behind the merge move up, and finished rows leave the matrix.  Pieces longer than
``LONGEST_ROW`` bytes take the same merges in the same order from a heap, since moving a row
at every merge would take quadratic time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.llm.memory import lean
from jobsift.llm.vocab import NO_RANK, Ranks, Recent, load_ranks, load_tokens, split

LONGEST_ROW = 512
SLICE_CHARS = 1 << 20
MEMORY = 120_000


def merge_rows(pieces: list[bytes], vocab: Ranks) -> list[bytes]:
    """Ids of pieces of like length, packed as little-endian unsigned 32-bit integers."""
    out: list[bytes] = [b""] * len(pieces)
    lengths = np.array([len(p) for p in pieces], np.int64)
    width = int(lengths.max())
    flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
    ids = vocab.byte[flat]
    inside = np.arange(width - 1) + 1 < lengths[:, None]
    ranks = np.full((len(pieces), width - 1), NO_RANK, np.int32)
    row, col = np.nonzero(inside)
    ranks[row, col] = vocab.pairs.find(ids[row, col], ids[row, col + 1])
    rows = np.arange(len(pieces))

    def finish(done: np.ndarray) -> None:
        packed = ids[done].astype("<u4")
        for i, r, n in zip(rows[done], packed, lengths[done]):
            out[i] = r[:n].tobytes()

    while len(rows):
        if not ranks.shape[1]:
            finish(np.ones(len(rows), bool))
            break
        at = ranks.argmin(axis=1)
        best = ranks[np.arange(len(rows)), at]
        done = best == NO_RANK
        if done.any():
            finish(done)
            live = ~done
            ids, ranks, rows, lengths, at, best = (x[live] for x in (ids, ranks, rows, lengths, at, best))
            if not len(rows):
                break
        n = np.arange(len(rows))
        take = np.arange(ids.shape[1] - 1)
        ids = np.take_along_axis(ids, take + (take > at[:, None]), axis=1)
        ids[n, at] = best
        take = take[:-1]
        ranks = np.take_along_axis(ranks, take + (take >= at[:, None]), axis=1)
        lengths = lengths - 1
        before = np.flatnonzero(at > 0)
        ranks[before, at[before] - 1] = vocab.pairs.find(ids[before, at[before] - 1], ids[before, at[before]])
        behind = np.flatnonzero(at + 1 < lengths)
        ranks[behind, at[behind]] = vocab.pairs.find(ids[behind, at[behind]], ids[behind, at[behind] + 1])
        width = int(lengths.max())
        ids, ranks = ids[:, :width], ranks[:, :width - 1]
    return out


def merge_long(piece: bytes, vocab: Ranks) -> bytes:
    """The same for one long piece: a heap of (rank, place) over a linked list."""
    pair, n = vocab.pair, len(piece)
    ids = vocab.byte[np.frombuffer(piece, np.uint8)].tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := pair.get((ids[i], ids[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j >= n or pair.get((ids[i], ids[j])) != rank:
            continue
        ids[i], ids[j], after[i] = rank, -1, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := pair.get((ids[i], ids[after[j]]))) is not None:
                heapq.heappush(heap, (r, i))
        if (p := before[i]) >= 0 and (r := pair.get((ids[p], ids[i]))) is not None:
            heapq.heappush(heap, (r, p))
    return np.array([x for x in ids if x >= 0], "<u4").tobytes()


def encode_pieces(pieces: list[bytes], vocab: Ranks) -> list[bytes]:
    """Packed ids of each piece; a piece that is a token is that token."""
    out: list[bytes] = [b""] * len(pieces)
    buckets: dict[int, list[int]] = {}
    for i, piece in enumerate(pieces):
        known = vocab.ranks.get(piece)
        if known is not None:
            out[i] = known.to_bytes(4, "little")
        elif len(piece) > LONGEST_ROW:
            out[i] = merge_long(piece, vocab)
        else:
            buckets.setdefault((len(piece) + 3) // 4 if len(piece) <= 32 else 8 + len(piece).bit_length(), []).append(i)
    for places in buckets.values():
        for i, ids in zip(places, merge_rows([pieces[i] for i in places], vocab)):
            out[i] = ids
    return out


class Encoder:
    """Encodes lists of texts; remembers the pieces it met lately."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.vocab = load_ranks(path)
        self.known = Recent(memory)

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [split(t) for t in texts]
        need = set().union(*pieces)
        new = list(need.difference(self.known))
        found = dict(zip(new, encode_pieces([p.encode("utf-8", "replace") for p in new], self.vocab)))
        known = self.known.with_new(found, need)
        return [b"".join(map(known.__getitem__, p)) for p in pieces]


def in_slices(texts: list, size: int = SLICE_CHARS) -> Iterator[list]:
    part, n = [], 0
    for t in texts:
        if part and n + len(t) > size:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t)
    if part:
        yield part


def _packer(path: str):
    @F.arrow_udf("binary")
    @lean
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        # One encoder per task: what it remembers goes when the task ends.
        encoder = Encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            yield pa.array([ids for part in in_slices(texts) for ids in encoder.encode(part)], pa.binary())
    return pack


def _unpacker(path: str):
    @F.arrow_udf("binary")
    @lean
    def unpack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        token = load_tokens(path)
        for batch in batches:
            yield pa.array([b"".join(map(token.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))
                            for ids in (x.as_py() for x in batch)], pa.binary())
    return unpack


def encode(docs: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and ``packed``: the text's ids as little-endian unsigned 32-bit integers.

    ``path`` names a rank file every executor can read.  A null text is encoded as the empty
    text, to no ids.  Rows are encoded one by one and stay in their partition, repeated rows
    each for itself.  A kept column may not be called ``packed``; other columns are not read.
    Special tokens are never used: their strings are ordinary text.
    """
    return docs.select(*keep, _packer(path)(F.col(text_col)).alias("packed"))


def decode(encoded: DataFrame, path: str, keep: list[str], ids_col: str = "packed") -> DataFrame:
    """The ``keep`` columns, the packed ids and ``decoded``: the bytes the ids stand for; null as none."""
    return encoded.select(*keep, ids_col, _unpacker(path)(F.col(ids_col)).alias("decoded"))
