"""Mixing sources to target weights, with weights that change over the training run.

Each source has a token target.  Its weight over the time 0..1 of the run is a broken line;
the integral of that line says which share of the target is due by when.  Documents of a
source line up in a hashed order; where a document stands in its source's running token sum
is looked up in the inverse of the integral and gives its training position.  Sorting by
position, in ranges, gives the order of the run.  A source whose target exceeds its size
goes round again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsift.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: (time, relative weight) of each weight class: steady, rising, falling.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))
#: Rows of a source that are summed in one window, about; and a bound on the windows.
BUCKET_ROWS = 1000
MOST_BUCKETS = 1 << 20
#: Rows of a window above which it is split: ids that repeat, or are null, share one.
HOT_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place_hash(key: Column) -> Column:
    """60 bits of the key's MD5; a null key counts as empty."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size, class, target)`` of ``sizes(source, source_size)``, one row per source.

    Sources in code point order, null last, take the weights in turn and share
    ``share`` times all sizes by weight; a target stops at ``most`` times its source's size
    and the excess is shared again.  Each round of sharing sends two sums to the driver.
    """
    # Rows keep their range partition and place in it once they are written.
    order = F.col("source").asc_nulls_last()
    rows = materialize(
        sizes.select("source", "source_size").repartitionByRange(32, order).sortWithinPartitions(order)
        .withColumn("at", F.monotonically_increasing_id()), "sources")
    part, place = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    numbered = rows.withColumn("part", part).join(F.broadcast(parts), "part").withColumn(
        "class", ((F.col("before") + place) % len(weights)).cast("int"))
    weight = F.element_at(F.lit(list(weights)), F.col("class") + 1)
    numbered = materialize(
        numbered.select("source", "source_size", "class", weight.alias("w"), (F.col("source_size") * F.lit(most)).alias("cap")), "classes")
    total = numbered.agg(F.sum("source_size")).first()[0] or 0
    rate, stopped = 0.0, -1
    while True:
        full = F.lit(rate) * F.col("w") > F.col("cap")
        kept, open_weight, count = numbered.agg(
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0).otherwise(F.col("w"))),
            F.count(F.when(full, 1))).first()
        if count == stopped or not open_weight:
            break
        rate, stopped = (share * total - kept) / open_weight, count
    full = F.lit(rate) * F.col("w") > F.col("cap")
    return numbered.select("source", "source_size", "class", F.when(full, F.col("cap")).otherwise(F.lit(rate) * F.col("w")).alias("target"))


def due_time(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the integral of the schedule reaches ``share`` of its whole."""
    pieces, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        pieces.append((t0, t1, w0, w1, done))
        done += (t1 - t0) * (w0 + w1) / 2
    out = F.lit(float(schedule[-1][0]))
    for t0, t1, w0, w1, before in reversed(pieces):
        rest = F.greatest(share * done - before, F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        # w0 x + slope x^2 / 2 = rest, in the form that also holds for slope 0.
        step = F.try_divide(2 * rest, w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0))))
        out = F.when(share * done < before + (t1 - t0) * (w0 + w1) / 2, t0 + F.coalesce(step, F.lit(0.0))).otherwise(out)
    return out


def _windows(rows: DataFrame, buckets: int, hot_rows: int) -> DataFrame:
    """``rows`` with their window: ``bucket``, a range of hashes, and ``part`` of it, 0 but where many rows share it.

    At most (rows) / ``hot_rows`` buckets are split; they are broadcast.
    """
    placed = rows.withColumn("bucket", F.floor(F.col("hash") / F.lit(float(1 << 60)) * buckets).cast("int"))
    hot = placed.groupBy("of", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select(
        "of", "bucket", F.ceil(F.col("n") * 2 / hot_rows).cast("int").alias("parts"))
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    return placed.join(F.broadcast(hot), ["of", "bucket"], "left").withColumn("part", part).drop("parts")


def assign_positions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
    weights: tuple[int, ...] = WEIGHTS, schedules=SCHEDULES, share: float = 1.5, most: float = 2.0, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``id``, size, source_size, target, taken, ``places`` and the ``keep`` columns.

    ``size`` counts words, 0 for null and empty texts.  ``taken`` is how many words of the row the
    mix takes, all rounds together, at most ``most`` times its size (a whole number of rounds);
    ``places`` is ``array<struct<round, position, words>>``.  Rows are taken whole: the one in
    which a source reaches its target is taken if its middle lies below the target, else not,
    so a source is within half a document of it.  Rows with a null source form one source; rows
    with a null id stand where the empty id would.  Rows that repeat an id each take their own
    place, those alike in id and size in the order of the table.  Reruns agree.  The places'
    order within a source follows a hash of the id, not its value.  Kept columns may not bear
    the names above (``ValueError``).  Empty frames give no rows.

    Places are found on narrow rows; kept columns are joined to them once, by a row number.
    """
    taken_names = {"id", "size", "source_size", "target", "taken", "places", "row"}
    if clash := taken_names & {k.lower() for k in keep}:
        raise ValueError(f"kept columns bear names of the result: {sorted(clash)}")
    rounds = math.ceil(most)
    # Written once, the row numbers hold for good.
    numbered = materialize(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"), F.struct(F.lit(0).alias("_"), *keep).alias("kept")), "rows")
    rows = numbered.select(
        "row", "id", "size", place_hash(F.col("id")).alias("hash"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("of"))
    rows = _windows(rows, min(MOST_BUCKETS, max(1, rows.count() // BUCKET_ROWS)), hot_rows)
    sums = materialize(rows.groupBy("of", "bucket", "part").agg(F.sum("size").alias("words")), "sums")
    sizes = sums.groupBy("of").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes.select(F.when(F.col("of") != "", F.substring("of", 2, 1 << 30)).alias("source"), "source_size"), weights, share, most)
    targets = targets.select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("of"), "source_size", "class", "target",
        F.floor(F.col("target") + 0.5).cast("long").alias("whole"))
    earlier = Window.partitionBy("of").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    plan = sums.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words").join(targets, "of")
    inside = Window.partitionBy("of", "bucket", "part").orderBy("hash", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(plan, ["of", "bucket", "part"]).withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))

    def place(turn: int) -> Column:
        begin = F.col("start") + F.lit(turn) * F.col("source_size")
        words = F.when(2 * begin + F.col("size") < 2 * F.col("whole"), F.col("size")).otherwise(F.lit(0))
        middle = (begin + F.col("size") / 2) / F.greatest("whole", F.lit(1))
        position = F.lit(None).cast("double")
        for i in range(len(weights)):
            position = F.when(F.col("class") == i, due_time(middle, schedules[i])).otherwise(position)
        return F.struct(F.lit(turn).alias("round"), position.alias("position"), words.alias("words"))

    places = F.filter(F.array(*(place(i) for i in range(rounds))), lambda p: p["words"] > 0)
    placed = placed.withColumn("places", places).select(
        "row", "id", "size", "source_size", "target",
        F.aggregate("places", F.lit(0).cast("long"), lambda n, p: n + p["words"]).alias("taken"), "places")
    if keep:
        placed = placed.join(numbered.select("row", "kept"), "row")
    return placed.select("id", "size", "source_size", "target", "taken", "places", *(F.col(f"kept.`{c}`") for c in keep))


def training_order(assigned: DataFrame) -> DataFrame:
    """The mix itself: a row per place, range-sorted by position."""
    columns = [c for c in assigned.columns if c != "places"]
    rows = assigned.select(*columns, F.explode("places").alias("place")).select(*columns, "place.*")
    return rows.repartitionByRange("position", "id", "round").sortWithinPartitions("position", "id", "round")
