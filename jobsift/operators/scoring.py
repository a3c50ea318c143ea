"""Asking a scorer for items in their order, and no further than it makes sense.

Every question to a scorer may cost money.  After an answer that ends a batch (401 or 429) the
rest of the batch is not asked, and a user with a limited allowance is asked for until the
allowance is used up.  Both depend on earlier answers, so the items of one user (or of one
batch, where the user has no limit) are worked off in order by one task.  Tasks hold a wave of
items at a time: what is left of a very large group waits for the answers of the wave before.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobsift.session import materialize
from jobsift.skew import position_in_group, spread_join

#: Items of one user or batch that one task works off in a wave.
WAVE_ROWS = 50_000
#: Answers that go back to Spark together at most.
ANSWER_ROWS = 256
FATAL = (401, 429)
CONTROL = ["_cluster", "_user", "_period", "_left"]


def _together(answers: Iterator[pd.DataFrame], most: int = ANSWER_ROWS) -> Iterator[pd.DataFrame]:
    """The rows of ``answers`` in fewer frames.

    Every frame costs as much as hundreds of rows on its way to Spark.  Only frames of the same
    columns and types are put together, so no value changes.
    """
    held: list[pd.DataFrame] = []
    rows, kinds = 0, None
    for answer in answers:
        if held and (rows + len(answer) > most or list(answer.dtypes.items()) != kinds):
            yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
            held, rows = [], 0
        if not held:
            kinds = list(answer.dtypes.items())
        held.append(answer)
        rows += len(answer)
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def _asker(scorer: Callable, inputs: Sequence[str]) -> Callable:
    """The scorer, fed one item at a time with what is still worth asking."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stopped: set = set()
        used: Counter = Counter()
        asked: list = []

        def feed() -> Iterator[pd.DataFrame]:
            cluster = None
            for frame in frames:
                control, items = frame[["batch_id", *CONTROL]].to_dict("list"), frame[list(inputs)]
                for i in range(len(frame)):
                    if control["_cluster"][i] != cluster:
                        # Neither a batch nor an allowance reaches into another cluster.
                        cluster = control["_cluster"][i]
                        stopped.clear(), used.clear()
                    batch, left = control["batch_id"][i], control["_left"][i]
                    purse = (control["_user"][i], control["_period"][i])
                    if batch in stopped or (not pd.isna(left) and used[purse] >= left):
                        continue
                    asked[:] = [batch, purse]
                    yield items.iloc[i:i + 1].reset_index(drop=True)

        def noted() -> Iterator[pd.DataFrame]:
            for answer in scorer(feed()):
                for status in answer["status"]:
                    if status in FATAL:
                        stopped.add(asked[0])
                    elif 200 <= status <= 299:
                        used[asked[1]] += 1
                yield answer

        yield from _together(noted())
    return run


def _waves(items: DataFrame, wave_rows: int) -> tuple[DataFrame, int]:
    """Items with the number of their wave, and how many waves there are."""
    largest = items.groupBy("_cluster").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= wave_rows:
        return items.withColumn("_wave", F.lit(0)), 1
    order = ["_first", "batch_id", "seq"]
    stretch = F.floor(F.col("seq") / wave_rows)
    numbered = position_in_group(
        items.select("_cluster", *order), ["_cluster"],
        [("_first_at", F.col("_first"), True), ("_batch", F.col("batch_id"), True), ("_stretch", stretch, True)], [F.col(c) for c in order], "_place")
    waves = numbered.select("batch_id", "seq", F.floor((F.col("_place") - 1) / wave_rows).cast("int").alias("_wave"))
    return materialize(items.join(waves, ["batch_id", "seq"]), "waves"), -(-largest // wave_rows)


def ask_in_order(
    items: DataFrame, scorer: Callable, answer_schema: T.StructType | str, inputs: Sequence[str], wave_rows: int = WAVE_ROWS
) -> DataFrame:
    """The scorer's answers, stored, for all items that had to be asked.

    ``items``: batch_id, seq (unique together), user_id, ts, period, left and ``inputs``.
    ``left`` is how many successes the user may still have in the period, null without a limit.
    Batches of a user are worked off by their first time, then id; items of a batch by ``seq``.
    ``scorer`` gets an iterator of one-row pandas frames of ``inputs`` and must yield the answer
    to each (columns batch_id, seq, status and others) before it takes the next one.  Answers
    200 to 299 are successes.  An empty frame asks nothing.
    """
    first = items.groupBy("batch_id").agg(F.min("ts").alias("_first"))
    dated = spread_join(items, first, ["batch_id"], "inner", ["seq"]).select(
        "batch_id", "seq", *(c for c in inputs if c not in ("batch_id", "seq")), "_first",
        F.when(F.col("left").isNull(), F.concat(F.lit("batch "), "batch_id")).otherwise(F.concat(F.lit("user "), "user_id")).alias("_cluster"),
        F.col("user_id").alias("_user"), F.col("period").cast("string").alias("_period"), F.col("left").cast("double").alias("_left"))
    waves, count = _waves(dated, wave_rows)
    answers = None
    for wave in range(count):
        todo = waves.where(F.col("_wave") == wave)
        if answers is not None:
            # What earlier waves answered: which batches are over, and how much is used.
            over = answers.where(F.col("status").isin(*FATAL)).select("batch_id").distinct()
            paid = answers.where(F.col("status").between(200, 299)).select("batch_id", "seq").join(
                waves.select("batch_id", "seq", "_user", "_period"), ["batch_id", "seq"])
            paid = paid.groupBy("_user", "_period").agg(F.count(F.lit(1)).alias("_paid"))
            todo = spread_join(todo, over, ["batch_id"], "left_anti", ["seq"])
            todo = spread_join(todo, paid, ["_user", "_period"], "left", ["seq"]).withColumn(
                "_left", F.col("_left") - F.coalesce("_paid", F.lit(0)))
        ordered = todo.repartition("_cluster").sortWithinPartitions("_cluster", "_first", "batch_id", "seq")
        columns = list(dict.fromkeys(["batch_id", "seq", *inputs, *CONTROL]))
        new = materialize(ordered.select(*columns).mapInPandas(_asker(scorer, inputs), answer_schema), "answers")
        answers = new if answers is None else answers.union(new)
    return answers
