"""Joins, top-k and ranks that hold when one key owns a large share of all rows.

The rules used throughout the package:

* aggregate first, so a hot key is combined on the map side;
* ``spread_join`` splits only the keys found to be hot and replicates the other
  side for just those keys;
* ``top_k`` cuts each (key, salt) group to k rows before the key's rows meet;
* ``position_in_group`` numbers rows bucket by bucket, never a whole group in
  one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000   # rows of one key that are still fine in one task
SALTS = 32             # for rows without a key, and where no key was counted


def salt_of(spread_by: Sequence[str], salts: int | Column = SALTS) -> Column:
    """Deterministic salt, so a recomputed task gives the same value."""
    return F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int | None = None) -> DataFrame:
    """Every key with ``min_rows`` (``HOT_ROWS``) rows or more, and how many salts it needs.

    A key of n rows gets ``2 * n / min_rows`` salts, so about half of ``min_rows`` rows meet
    in a task however large the key is.  The list has at most (rows of ``df``) /
    ``min_rows`` entries.
    """
    least = HOT_ROWS if min_rows is None else min_rows
    return (
        df.groupBy(*keys).count().where(F.col("count") >= least)
        .select(*keys, F.greatest(F.ceil(F.col("count") * 2 / least), F.lit(2)).cast("int").alias("salts"))
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str,
    spread_by: Sequence[str],
    hot: DataFrame | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Equi-join where ``left`` may be skewed on ``keys``.

    ``spread_by`` names left columns that differ between rows of one key.
    ``hot`` may give the hot keys when a cheaper frame than ``left`` knows them.
    Each left row gets exactly one salt and every matching right row exists once
    per salt of its key, so inner, left, left_semi and left_anti all stay exact.
    """
    keys = list(keys)
    found = hot if hot is not None else hot_keys(left, keys, min_rows)
    # Bounded by (rows / HOT_ROWS) keys, see ``hot_keys``.
    marked = F.broadcast(found.withColumnRenamed("salts", "_salts"))
    # Null keys never match; spread them too rather than pile them in one task.
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salted = left.join(marked, keys, "left").withColumn(
        "_salt",
        F.when(no_key, salt_of(spread_by, 1 << 20))
        .when(F.col("_salts").isNotNull(), salt_of(spread_by, F.col("_salts")))
        .otherwise(F.lit(0)),
    ).drop("_salts")
    copies = right.join(marked, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)),
    ).drop("_salts")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread_by: Sequence[str],
    rank: str = "rank",
    salts: int = SALTS,
) -> DataFrame:
    """The first ``k`` rows of each key, numbered from 1 in ``rank``.

    Both windows plan as WindowGroupLimit, and the second sees at most
    ``salts * k`` rows of a key however many rows the key has.
    """
    keys = list(keys)
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    second = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt_of(spread_by, salts))
        .withColumn(rank, F.row_number().over(first)).where(F.col(rank) <= k)
        .drop("_salt")
        .withColumn(rank, F.row_number().over(second)).where(F.col(rank) <= k)
    )


def keep_top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[tuple[str, bool]],
    k: int,
    row_key: Sequence[str],
) -> DataFrame:
    """The first ``k`` rows of each key of a wide frame.

    ``order`` is (column, ascending); ``row_key`` identifies a row.  Only those
    columns are ranked; the wide rows move once, in the join back.
    """
    columns = list(dict.fromkeys([*keys, *(c for c, _ in order), *row_key]))
    by = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    kept = top_k(df.select(*columns), keys, by, k, spread_by=row_key).select(*row_key)
    return df.join(kept, list(row_key), "left_semi")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key with the greatest ``order`` columns."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def position_in_group(
    df: DataFrame,
    keys: Sequence[str],
    buckets: Sequence[tuple[str, Column, bool]],
    order: Sequence[Column],
    name: str = "position",
    attach: DataFrame | None = None,
) -> DataFrame:
    """Number every row of a group without bringing the group together.

    ``buckets`` are (name, expression, ascending) and must agree with ``order``:
    rows of an earlier bucket come before rows of a later one.  Bucket sizes
    are counted, their running sum gives each bucket's offset, and rows are
    numbered inside their bucket only.  Columns of ``attach``, one row per group,
    ride along with the offsets and so cost no second pass over the rows.  Rows whose
    bucket value is null form a bucket of their own; keys must not be null.
    """
    keys = list(keys)
    names = [n for n, _, _ in buckets]
    bucketed = df
    for n, expr, _ in buckets:
        bucketed = bucketed.withColumn(n, expr)
    bucket_order = [F.col(n).asc() if up else F.col(n).desc() for n, _, up in buckets]
    before = (
        Window.partitionBy(*keys).orderBy(*bucket_order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        bucketed.groupBy(*keys, *names).count()
        .withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    if attach is not None:
        offsets = offsets.join(attach, keys)
    inside = Window.partitionBy(*keys, *names).orderBy(*order)
    offsets = offsets.withColumnsRenamed({n: f"_of{n}" for n in names})
    same = reduce(lambda a, b: a & b, [bucketed[k] == offsets[k] for k in keys] + [
        bucketed[n].eqNullSafe(offsets[f"_of{n}"]) for n in names])
    joined = bucketed.join(offsets, same)
    for k in keys:
        joined = joined.drop(offsets[k])
    return (
        joined.withColumn(name, F.row_number().over(inside) + F.col("_before"))
        .drop("_before", *names, *(f"_of{n}" for n in names))
    )
