"""Grouping of spelling variants: words one edit apart, found in dense tiles.

1.  Words that one edit separates agree in front of the edit and behind it.  The longer word's
    length is cut into four windows; the edit lies in one of them, and both words have the same
    characters before that window and, counted from their ends, behind it.  So a word is filed
    under eight keys: four windows, with its own length and with that of a word one longer.
2.  Words under one key lie side by side in padded matrices of code points, one aligned at the
    words' beginnings and one at their ends.  A block of rows is compared with the block a few
    rows further down, all rows at once: the first unequal column from the left is the length
    of the common prefix, from the right that of the common suffix.  Where both together reach
    the longer length minus one, a single edit turns one word into the other.
3.  A key under which many words meet is split into blocks, and its words go to one tile for
    each pair of blocks, so that no task holds more than a tile.

A pair under several keys is reported for the first window that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.llm.memory import lean
from jobsift.session import materialize
from jobsift.skew import spread_join

WINDOWS = 4
#: Code points under one key above which it is split into blocks of about half as many.
TILE_CELLS = 200_000
#: Code points that are compared at once.
COMPARED_CELLS = 1 << 21
#: A word's form occurs at least so many times as often.
MORE_OFTEN = 5


def _window(length, i: int):
    """Code points before window ``i`` and behind it, for numbers, arrays and columns of lengths."""
    return length * i // WINDOWS, length - length * (i + 1) // WINDOWS


def _keys(words: DataFrame) -> DataFrame:
    """``words(word, n)``, one row per key: ``m`` is the longer word's length, ``w`` the window."""
    size = F.length("word")
    spots = []
    for more in (0, 1):
        m = size + more
        for i in range(WINDOWS):
            front, end = F.floor(m * i / WINDOWS).cast("int"), F.floor(m * (i + 1) / WINDOWS).cast("int")
            key = F.xxhash64(m, F.lit(i), F.substring("word", F.lit(1), front), F.substring("word", size - (m - end) + 1, m - end))
            spots.append(F.struct(m.alias("m"), F.lit(i).alias("w"), key.alias("key")))
    return words.select("word", "n", F.explode(F.array(*spots)).alias("at")).select("word", "n", "at.*")


def _tiles(keyed: DataFrame, tile_cells: int) -> DataFrame:
    """``keyed`` with the tile ``(lo, hi)`` of a row and its block; rows of split keys repeat for each tile.

    At most (code points under all keys) / ``tile_cells`` keys are split; they are broadcast.
    """
    large = keyed.groupBy("key").agg(F.sum("m").alias("cells")).where(F.col("cells") > tile_cells).select(
        "key", F.ceil(F.col("cells") * 2 / tile_cells).cast("int").alias("blocks"))
    marked = keyed.join(F.broadcast(large), "key", "left").withColumn(
        "block", F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("word", F.lit(1)), F.col("blocks")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    return marked.withColumn("other", other).select(
        "word", "n", "m", "w", "key", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points aligned left, aligned right (both padded with 0), and lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    width = max(int(sizes.max(initial=0)), 1)
    left = np.array(words, dtype=f"<U{width}").view(np.uint32).reshape(len(words), width)
    column = np.arange(width) - (width - sizes)[:, None]
    right = np.where(column >= 0, np.take_along_axis(left, np.maximum(column, 0), axis=1), 0).astype(np.uint32)
    return left, right, sizes


def common_ends(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the common prefix and suffix of the rows ``a`` and ``b``."""
    shorter = np.minimum(sizes[a], sizes[b])

    def first_unequal(unequal: np.ndarray) -> np.ndarray:
        at = unequal.argmax(axis=1)
        return np.where(unequal[np.arange(len(at)), at], at, unequal.shape[1])

    return (np.minimum(first_unequal(left[a] != left[b]), shorter),
            np.minimum(first_unequal((right[a] != right[b])[:, ::-1]), shorter))


def _near_rows(words: list[str], m: np.ndarray, w: np.ndarray, block: np.ndarray, crossed: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group that are one edit apart; groups are contiguous."""
    left, right, sizes = matrices(words)
    ends = np.searchsorted(group, group, side="right")
    rows = np.arange(len(words))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, COMPARED_CELLS // left.shape[1])
    shift = 1
    active = rows[rows + 1 < ends]
    while len(active):
        # A tile of two blocks compares across them only: within each, another tile does.
        useful = active[~crossed[active] | (block[active] != block[active + shift])]
        for at in range(0, len(useful), step):
            a = useful[at:at + step]
            b = a + shift
            longest = m[a]
            fit = np.maximum(sizes[a], sizes[b]) == longest
            a, b, longest = a[fit], b[fit], longest[fit]
            if not len(a):
                continue
            prefix, suffix = common_ends(left, right, sizes, a, b)
            single = prefix + suffix >= longest - 1
            first = np.full(len(a), WINDOWS)
            for i in reversed(range(WINDOWS)):
                front, behind = _window(longest, i)
                first[(prefix >= front) & (suffix >= behind)] = i
            hit = single & (first == w[a])
            pairs.append((a[hit], b[hit]))
        shift += 1
        active = active[active + shift < ends[active]]
    if not pairs:
        return rows[:0], rows[:0]
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of tiles to links in both directions; the last tile of a batch waits for the next."""
    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        group = starts(rows)
        m = rows.column("m").to_numpy()
        # Whole groups, as many as fit the cells that may be held at once.
        bounds = np.flatnonzero(np.diff(group, prepend=-1))
        begin = 0
        while begin < rows.num_rows:
            width = int(m[begin])
            limit = begin + max(1, COMPARED_CELLS // max(width, 1))
            inside = bounds[(bounds > begin) & (bounds <= limit)]
            end = int(inside[-1]) if len(inside) else int(next(iter(bounds[bounds > begin]), rows.num_rows))
            if limit >= rows.num_rows:
                end = rows.num_rows
            part = rows.slice(begin, end - begin)
            words = part.column("word").to_pylist()
            a, b = _near_rows(words, m[begin:end], part.column("w").to_numpy(), part.column("block").to_numpy(),
                              part.column("lo").to_numpy() != part.column("hi").to_numpy(), group[begin:end])
            if len(a):
                word, n = part.column("word"), part.column("n")
                for x, y in ((a, b), (b, a)):
                    yield from pa.table({"word": word.take(pa.array(x)), "near": word.take(pa.array(y)), "near_n": n.take(pa.array(y))}).to_batches()
            begin = end

    def starts(rows: pa.Table) -> np.ndarray:
        change = np.zeros(rows.num_rows, bool)
        for name in ("m", "key", "lo", "hi"):
            values = rows.column(name).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        return np.cumsum(change)

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        group = starts(rows)
        last = int(np.searchsorted(group, group[-1]))
        if waiting:
            head = pa.Table.from_batches([waiting[-1].slice(waiting[-1].num_rows - 1), batch.slice(0, 1)])
            if starts(head)[-1]:
                yield from links(pa.Table.from_batches(waiting))
                waiting = []
        if last:
            yield from links(pa.Table.from_batches([*waiting, batch.slice(0, last)]))
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield from links(pa.Table.from_batches(waiting))


def near_words(words: DataFrame, tile_cells: int = TILE_CELLS) -> DataFrame:
    """``(word, near, near_n)`` of distinct ``words(word, n)`` for each two that one edit separates, both ways round."""
    tiles = _tiles(_keys(words), tile_cells)
    ordered = tiles.repartition("key", "lo", "hi").sortWithinPartitions("m", "key", "lo", "hi")
    return ordered.mapInArrow(lean(_compare), "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``: each round doubles the steps already taken.

    Counts grow by a factor with each step, so there are no circles and few rounds.
    """
    reached = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(spread_join(reached, further, ["root"], "left", ["word"]), "roots")
        reached = moved.select("word", F.coalesce("next", "root").alias("root"))
        if moved.where(F.col("next").isNotNull()).isEmpty():
            return reached


def group_spellings(words: DataFrame, more_often: int = MORE_OFTEN, tile_cells: int = TILE_CELLS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``words(word, n)``, one row per word.

    ``n_near`` counts the words that one inserted, deleted or replaced code point turns into
    this one.  ``form`` is the near word of the largest ``n`` (ties: the least in code-point
    order) if that is ``more_often`` times the word's own or more, else null; ``root`` is where
    the forms end.  Rows that repeat a word are added up; null words, and words with a null
    count, take no part; columns beyond the two are not read.  Empty frames give no rows.
    """
    words = materialize(
        words.where(F.col("word").isNotNull() & F.col("n").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")), "words")
    near = near_words(words, tile_cells).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    judged = words.join(near, "word", "left")
    often = -F.col("best.less") >= F.col("n") * more_often
    judged = materialize(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(judged.where(F.col("form").isNotNull()))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
