"""Matches of a pattern with their places, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 256


def matches_with_start(text: Column, pattern: str, group: int = 0) -> Column:
    """``array<struct<start, m, v>>`` of the leftmost matches that do not overlap.

    ``start`` counts code points, ``m`` is the match and ``v`` its ``group``.  A match begins
    behind all earlier gaps and matches, so starts are running sums of their lengths; they
    are summed in chunks, which keeps texts with very many matches from quadratic work.  The
    pattern must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
    rows = F.zip_with(
        F.arrays_zip(found.alias("m"), values.alias("v")),
        F.slice(gaps, F.lit(1), F.size(found)),
        lambda x, g: F.struct(g.alias("gap"), x["m"].alias("m"), x["v"].alias("v")))

    def chunks(all_rows: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.size(all_rows) - 1) / _CHUNK).cast("int")),
            lambda c: F.slice(all_rows, c * _CHUNK + 1, F.lit(_CHUNK)))

    def length(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda n, x: n + x["gap"] + F.length(x["m"]))

    def placed(part: Column, before: Column) -> Column:
        empty = F.array().cast("array<struct<start:bigint,m:string,v:string>>")
        start = F.struct(before.alias("at"), empty.alias("out"))
        return F.aggregate(
            part, start,
            lambda a, x: F.struct(
                (a["at"] + x["gap"] + F.length(x["m"])).alias("at"),
                F.concat(a["out"], F.array(F.struct(
                    (a["at"] + x["gap"]).alias("start"), x["m"].alias("m"), x["v"].alias("v")))).alias("out")),
            lambda a: a["out"])

    def all_placed(parts: Column) -> Column:
        offsets = F.aggregate(
            F.transform(parts, length), F.array(F.lit(0).cast("long")),
            lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.zip_with(parts, F.slice(offsets, F.lit(1), F.size(parts)), placed))

    return F.when(F.size(found) > 0, all_placed(chunks(rows))).otherwise(
        F.array().cast("array<struct<start:bigint,m:string,v:string>>"))
