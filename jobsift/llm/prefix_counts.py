"""Exact token counts at every prefix of a text, by dynamic programming.

For byte-level BPE the encoding of a prefix ends in exactly one token, and that token is the
only one ending there that fits the last token of the shorter prefix before it (``Merges.fit``).
So one pass over a piece gives the last token, and with it the token count, of all its
prefixes.  A text's table holds, per code point, how much the count of the prefix that ends
with it differs from the one before: one signed byte.  Sums over the table answer what a
truncation costs or how much of a text a budget allows, without encoding again.

The count of a prefix is the count of that prefix encoded as a text of its own.  It may differ
from what its pieces have in the whole text: white space before a word and half a contraction
(``'l`` of ``'ll``) are split otherwise at the end of a text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.llm.bpe import in_slices
from jobsift.llm.vocab import NO_RANK, Merges, Recent, load_merges, split

#: Pieces longer than this many bytes are walked one by one.
LONGEST_ROW = 256
MEMORY = 250_000
#: Pieces that end with a letter, but whose prefix at the second letter is split before it.
HALVED = ("'re", "'ve", "'ll")
#: Code points over which the `regex` module and the vocabulary's own splitter agree.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if regex.match(r"\s", c))
#: White space before a word, where the prefix that ends in it is split otherwise.
RUN = re.compile(f"[{re.escape(_SPACES)}]{{2,}}(?=[^{re.escape(_SPACES)}])")
PLAIN = regex.compile(
    r"[\u0000-\u0557\u2000-\u206F\u20A0-\u20BF\u3000-\u30FF\u3400-\u4DB5\u4E00-\u9FEA\uAC00-\uD7A3\uFF00-\uFFEF]*+")


def _ends(pieces: list[bytes], vocab: Merges) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All places where a token stands: (piece, start, end in the piece, token)."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    begins = np.concatenate(([0], np.cumsum(lengths)))
    buf = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    owner = np.repeat(np.arange(len(pieces)), lengths)
    start = np.arange(len(buf))
    stop = begins[owner + 1]
    node, at = np.zeros(len(buf), np.int64), start.copy()
    found = []
    live = start
    while len(live):
        child = vocab.step.find(node[live], buf[at[live]])
        ok = child != NO_RANK
        live = live[ok]
        node[live] = child[ok]
        at[live] += 1
        token = vocab.token_of[node[live]]
        hit = token >= 0
        found.append((live[hit], at[live[hit]], token[hit]))
        live = live[at[live] < stop[live]]
    s, e, t = (np.concatenate(x) for x in zip(*found))
    base = begins[owner[s]]
    return owner[s], s - base, e - base, t


def piece_counts(pieces: list[bytes], vocab: Merges) -> np.ndarray:
    """The token counts of the prefixes of 1, 2 ... bytes of each piece, one piece after the other."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    out = np.zeros(int(lengths.sum()), np.int64)
    begins = np.concatenate(([0], np.cumsum(lengths)))
    short = np.flatnonzero(lengths <= LONGEST_ROW)
    for i in np.flatnonzero(lengths > LONGEST_ROW):
        out[begins[i]:begins[i + 1]] = long_counts(pieces[i], vocab)
    rows = [pieces[i] for i in short]
    if not rows or not lengths[short].max():
        return out
    owner, start, end, token = _ends(rows, vocab)
    width = int(lengths[short].max())
    last = np.full((len(rows), width + 1), -1, np.int64)
    count = np.zeros((len(rows), width + 1), np.int64)
    order = np.argsort(start, kind="stable")
    owner, start, end, token = owner[order], start[order], end[order], token[order]
    bounds = np.searchsorted(start, np.arange(width + 1))
    for j in range(width):
        part = slice(bounds[j], bounds[j + 1])
        o, e, t = owner[part], end[part], token[part]
        if j:
            previous = last[o, j]
            if (previous < 0).any():
                raise ValueError("a prefix without an encoding: the vocabulary lacks a byte")
            fits = vocab.fit(previous, t)
            o, e, t = o[fits], e[fits], t[fits]
        last[o, e], count[o, e] = t, count[o, j] + 1
    out[np.repeat(lengths <= LONGEST_ROW, lengths)] = count[:, 1:][np.arange(width) < lengths[short][:, None]]
    return out


def long_counts(piece: bytes, vocab: Merges) -> np.ndarray:
    """The same for one long piece, place by place, remembering which tokens fit."""
    _, start, end, token = _ends([piece], vocab)
    order = np.argsort(start, kind="stable")
    bounds = np.searchsorted(start[order], np.arange(len(piece) + 1)).tolist()
    end, token = end[order].tolist(), token[order].tolist()
    last, count, memo = [-1] * (len(piece) + 1), [0] * (len(piece) + 1), {}
    for j in range(len(piece)):
        for k in range(bounds[j], bounds[j + 1]):
            pair = (last[j], token[k])
            if j and pair not in memo:
                memo[pair] = bool(vocab.fit(np.array(pair[:1]), np.array(pair[1:]))[0])
            if not j or memo[pair]:
                last[end[k]], count[end[k]] = token[k], count[j] + 1
    return np.array(count[1:], np.int64)


class PrefixCounter:
    """Prefix tables of texts; remembers the pieces it met lately."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.path = path
        self.vocab = load_merges(path)
        self.special = list(self.vocab.special)
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.known = Recent(memory)
        self._library = None

    def pieces(self, text: str) -> list[str]:
        """The vocabulary's pieces of the text; the library splits what this splitter might not."""
        if PLAIN.fullmatch(text):
            return split(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        new = list(pieces.difference(self.known))
        data = [p.encode("utf-8", "replace") for p in new]
        counts = piece_counts(data, self.vocab)
        buf = np.frombuffer(b"".join(data) + b" ", np.uint8)
        last_byte = (buf[1:] & 0xC0) != 0x80
        counts = counts[last_byte]
        ends = np.cumsum([len(p) for p in new], dtype=np.int64).tolist()
        steps = np.diff(counts, prepend=0)
        begins = np.array([0, *ends[:-1]], np.int64)[:len(new)]
        steps[begins] = counts[begins]
        if len(steps) and abs(steps).max() > 127:
            raise OverflowError("a step of a prefix table leaves a signed byte")
        flat = steps.astype(np.int8).tobytes()
        found = {p: flat[a:b] for p, a, b in zip(new, [0, *ends], ends)}
        for p in HALVED:
            if p in found:
                tail = int(piece_counts([p[1:2].encode()], self.vocab)[-1])
                one, whole = found[p][0], sum_of(found[p])
                found[p] = np.array([one, tail, whole - one - tail], np.int8).tobytes()
        return found

    def tables(self, texts: list[str]) -> list[bytes]:
        """One signed byte per code point of each text."""
        if self.at_special is not None and any(s in t for s in self.special for t in texts):
            return [self._with_special(t) if self.at_special.search(t) else self._plain([t])[0] for t in texts]
        return self._plain(texts)

    def _plain(self, texts: list[str]) -> list[bytes]:
        parts = [self.pieces(t) for t in texts]
        need = set().union(*parts)
        runs = [list(RUN.finditer(t)) for t in texts]
        for m in (m for own in runs for m in own):
            need.update((m[0], m[0][:-1]))
        found = self._learn(need)
        known = self.known.with_new(found, need)
        out = []
        for pieces, own in zip(parts, runs):
            table = b"".join(map(known.__getitem__, pieces))
            if own:
                # White space up to here is one piece of the prefix, though not of the text.
                t = np.frombuffer(table, np.int8).copy()
                for m in own:
                    at = m.end() - 1
                    shift = sum_of(known[m[0]]) - sum_of(known[m[0][:-1]]) - t[at]
                    t[at] += shift
                    t[at + 1] -= shift
                table = t.tobytes()
            out.append(table)
        return out

    def _with_special(self, text: str) -> bytes:
        """A special string counts as one token; before its last letter it is ordinary text."""
        out, at = [], 0
        for m in self.at_special.finditer(text):
            before = m.start() - at
            part = np.frombuffer(self._plain([text[at:m.end() - 1]])[0], np.int8)
            step = part[:before].sum(dtype=np.int64) + 1 - part.sum(dtype=np.int64)
            out.append(part.tobytes() + np.int8(step).tobytes())
            at = m.end()
        return b"".join(out) + self._plain([text[at:]])[0]


def sum_of(table: bytes) -> int:
    """The token count of a whole text, from its table."""
    return int(np.frombuffer(table, np.int8).sum(dtype=np.int64))


def tokens_before(table: bytes, end: int) -> int:
    """The token count of the first ``end`` code points."""
    return int(np.frombuffer(table, np.int8)[:end].sum(dtype=np.int64))


def longest_within(table: bytes, budget: int) -> int:
    """The most code points whose prefix has at most ``budget`` tokens."""
    counts = np.concatenate(([0], np.cumsum(np.frombuffer(table, np.int8), dtype=np.int64)))
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def _ddl(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *more])


def _tabler(path: str, budget: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One counter per task: what it remembers goes when the task ends.
        counter = PrefixCounter(path)
        for batch in batches:
            at = 0
            for texts in in_slices([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]):
                tables = counter.tables(texts)
                columns = [
                    *(c.slice(at, len(texts)) for c in batch.columns[:-1]),
                    pa.array([len(t.encode("utf-8", "replace")) for t in texts], pa.int64()),
                    pa.array([sum_of(t) for t in tables], pa.int64()),
                    pa.array(tables, pa.binary())]
                names = [*batch.schema.names[:-1], "n_bytes", "n_tokens", "prefix_steps"]
                if budget is not None:
                    columns.append(pa.array([longest_within(t, budget) for t in tables], pa.int64()))
                    names.append("fitting_chars")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += len(texts)
    return run


def count_prefixes(
    docs: DataFrame, path: str, keep: list[str], text_col: str = "text", budget: int | None = None
) -> DataFrame:
    """The ``keep`` columns with ``n_bytes``, ``n_tokens`` and ``prefix_steps`` of each text.

    ``prefix_steps`` is the prefix table, one signed byte per code point; ``tokens_before``
    and ``longest_within`` read it.  With ``budget``, ``fitting_chars`` is the length of the
    longest prefix within that many tokens.  ``path`` names a .json vocabulary with merges
    that every executor can read.  A null text counts as empty: no bytes, no tokens, an
    empty table.  Rows are counted one by one, repeated rows each for itself; columns that
    are not kept are not read, and kept ones may not bear the names of the new ones.
    """
    rows = docs.select(*keep, text_col)
    more = ["n_bytes long", "n_tokens long", "prefix_steps binary"] + (["fitting_chars long"] if budget is not None else [])
    return rows.mapInArrow(_tabler(path, budget), _ddl(rows.select(*keep), *more))


def truncate_to_budget(docs: DataFrame, path: str, keep: list[str], budget: int, text_col: str = "text") -> DataFrame:
    """The ``keep`` columns and ``text`` cut to its longest prefix of at most ``budget`` tokens."""
    counted = count_prefixes(docs, path, [*keep, text_col], text_col, budget) if text_col not in keep else \
        count_prefixes(docs, path, keep, text_col, budget)
    return counted.select(*keep, F.expr(f"left({text_col}, int(fitting_chars))").alias("truncated"))
