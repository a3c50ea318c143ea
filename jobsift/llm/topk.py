"""Exact top-k by inner product of integer vectors, block by block with bounds.

Dimensions are the terms and components their integer weights.  Rows are put in an order that
places like vectors beside each other, cut into document-range blocks, and each block keeps a
forward index (its ids and weights) with the greatest and least weight of every term.  For a
query a block's bound is the sum over terms of the greater of (query weight x greatest) and
(query weight x least).  Blocks are visited in falling order of bounds and scored through the
forward index, until the bound falls below the query's k-th score; a bound equal to it may
still hold a tie with a smaller id and is visited.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsift.session import materialize

BLOCK_ROWS = 128
#: Rows of the index, and queries, that meet in one task.
SHARD_ROWS = 8192
QUERY_ROWS = 512
#: Groups of queries that follow one copy of a shard.
GROUPS_A_COPY = 32


def quantize(values, scale: int = 256) -> np.ndarray | None:
    """``floor(scale * x)`` of each component as a double, None unless all are finite.

    A component beyond 63 bits raises ``OverflowError``.
    """
    if values is None or any(x is None or not math.isfinite(x) for x in values):
        return None
    whole = np.floor(np.asarray(values, np.float64) * scale)
    if len(whole) and not np.abs(whole).max() < 2.0**63:
        raise OverflowError("a component leaves 63 bits")
    return whole.astype(np.int64)


def _quantizer(scale: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, order, packed, query = [], [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                q = None if i is None else quantize(v, scale)
                if q is None:
                    continue
                strong = np.argsort(-np.abs(q), kind="stable")[:2]
                # Like vectors: those with the same two strongest terms and signs.
                order.append(sum((int(d) * 2 + int(q[d] < 0) + 1) << (20 * (1 - j)) for j, d in enumerate(strong)))
                ids.append(i), packed.append(q.tobytes()), query.append(i % every == 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(order, pa.int64()), pa.array(packed, pa.binary()), pa.array(query, pa.bool_())],
                names=["id", "place", "weights", "is_query"])
    return run


def _stack(rows: list[bytes]) -> np.ndarray:
    """Rows of weights as a matrix; shorter ones are filled up with zeros."""
    vectors = [np.frombuffer(r, np.int64) for r in rows]
    out = np.zeros((len(vectors), max((len(v) for v in vectors), default=0)), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _packer(name: str, rows: int | None):
    """Consecutive rows of a partition packed into one: ``rows`` at a time, or the whole
    partition, whose number is then the shard's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        weights: list[bytes] = []
        shard = TaskContext.get().partitionId()

        def pack(n: int) -> pa.RecordBatch:
            matrix = _stack(weights[:n])
            values = [np.array(ids[:n], np.int64).tobytes(), matrix.tobytes(), matrix.shape[1], shard]
            del ids[:n], weights[:n]
            return pa.RecordBatch.from_arrays(
                [pa.array([v]) for v in values], names=[f"{name}_ids", f"{name}_weights", f"{name}_terms", f"{name}_shard"])

        for batch in batches:
            ids += batch.column("id").to_pylist()
            weights += batch.column("weights").to_pylist()
            while rows and len(ids) >= rows:
                yield pack(rows)
        if ids:
            yield pack(len(ids))
    return run


def _kind(a: np.ndarray, b: np.ndarray) -> type:
    """What every inner product is exact in: doubles multiply fastest, Python's integers hold any."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(a.shape[1], 1)
    return float if most < 2**53 else np.int64 if most < 2**62 else object


def best_of_shard(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, weights: np.ndarray, k: int, block: int = BLOCK_ROWS
) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Each query's best ``k`` of the shard: (query id, ids, scores, rows scored)."""
    cuts = np.arange(0, len(ids), block)
    most, least = np.maximum.reduceat(weights, cuts, axis=0), np.minimum.reduceat(weights, cuts, axis=0)
    kind = _kind(queries, weights)
    up, down = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    bounds = up @ most.T.astype(kind) + down @ least.T.astype(kind)
    values = weights.astype(kind)
    visits = np.argsort(-bounds, axis=1, kind="stable")
    repeats = len(np.unique(ids)) < len(ids)
    for q, own in enumerate(query_ids):
        best_ids, best = np.empty(0, np.int64), np.empty(0, kind)
        row, scored = queries[q].astype(kind), 0
        for b in visits[q]:
            if len(best) == k and bounds[q, b] < best[-1]:
                break
            part = slice(cuts[b], cuts[b] + block)
            score, found = values[part] @ row, ids[part]
            scored += len(found)
            if len(best) == k and score.max() < best[-1]:
                continue
            keep = (found != own) & (score >= best[-1]) if len(best) == k else found != own
            best_ids, best = np.concatenate((best_ids, found[keep])), np.concatenate((best, score[keep]))
            order = np.lexsort((best_ids, -best))
            # An id that repeats stands where its best score does.
            if repeats:
                order = order[np.sort(np.unique(best_ids[order], return_index=True)[1])]
            best_ids, best = best_ids[order[:k]], best[order[:k]]
        if kind is object and any(abs(x) >= 2**63 for x in best):
            raise OverflowError("a score leaves 63 bits")
        yield int(own), best_ids, best.astype(np.int64), scored


def _search(k: int, block: int):
    """Each row of queries against the shard that stands before it; rows come by ``_unit``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, index = None, None
        for batch in batches:
            for n in range(batch.num_rows):
                r = batch.slice(n, 1).to_pylist()[0]
                ids = np.frombuffer(r["ids"], np.int64)
                matrix = np.frombuffer(r["weights"], np.int64).reshape(len(ids), r["terms"])
                if not r["is_query"]:
                    unit, index = r["_unit"], (ids, matrix)
                    continue
                # A shard without rows has nothing to find.
                if r["_unit"] != unit:
                    continue
                terms = max(matrix.shape[1], index[1].shape[1])
                q, d = (np.pad(m, ((0, 0), (0, terms - m.shape[1]))) for m in (matrix, index[1]))
                out = [[], [], [], []]
                for own, found, scores, scored in best_of_shard(ids, q, index[0], d, k, block):
                    out[0] += [own] * len(found)
                    out[1] += found.tolist()
                    out[2] += scores.tolist()
                    out[3] += [scored] * len(found)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "id", "score", "scored"])
    return run


def _meetings(queries: DataFrame, index: DataFrame, shards: int, groups: int) -> DataFrame:
    """Shards, each followed by the groups of queries that it meets, in partitions of a few of them.

    Rows are dealt out and sorted, not joined: the copies of the queries hold far more bytes than
    the groups that Spark knows of, and a join would send them all through the driver.
    """
    def piece(rows: DataFrame, name: str, is_query: bool, *unit: Column) -> DataFrame:
        return rows.select(
            F.struct(*unit).alias("_unit"), F.lit(is_query).alias("is_query"), *[F.col(f"{name}_{c}").alias(c) for c in ("ids", "weights", "terms")])

    def counted(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    copies = max(1, -(-groups // GROUPS_A_COPY))
    shard, copy = F.col("shard"), F.col("copy")
    # A partition of queries is one group or a few, so its number deals them out evenly.
    asked = queries.withColumn("copy", F.col("q_shard") % copies).withColumn("shard", counted(shards))
    kept = index.withColumnRenamed("d_shard", "shard").withColumn("copy", counted(copies))
    pieces = piece(asked, "q", True, shard.alias("shard"), copy.alias("copy")).union(piece(kept, "d", False, shard.alias("shard"), copy.alias("copy")))
    return pieces.repartition(shards * copies, "_unit").sortWithinPartitions("_unit", "is_query")


def search_top_k(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    shard_rows: int = SHARD_ROWS,
    block: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query_id, rank, id, score)``: each query's ``k`` best other rows, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``.  Rows whose vector is null or holds
    null or non-finite components, and rows with a null id, take no part; an empty vector is
    one without terms.  Vectors of different length are filled up with zeros.  Rows that repeat
    an id with an equal vector count once; with other vectors the best score of the id counts.
    Other columns are not read.  A query with fewer than ``k`` others has them all; an empty
    frame gives no rows.  A finite component or a score that leaves 63 bits raises ``OverflowError``.

    Queries in groups meet the index in shards: a task holds ``QUERY_ROWS`` queries and
    ``shard_rows`` rows at a time, so neither side is ever whole in a task or on the driver.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = materialize(
        source.mapInArrow(_quantizer(scale, every), "id long, place long, weights binary, is_query boolean").distinct(), "weights")
    total = rows.count()
    shards = max(1, -(-total // shard_rows))
    kind = "{0}_ids binary, {0}_weights binary, {0}_terms long, {0}_shard long"
    index = materialize(
        rows.repartitionByRange(shards, "place", "id").sortWithinPartitions("place", "id")
        .mapInArrow(_packer("d", None), kind.format("d")), "shards")
    shards = (index.agg(F.max("d_shard")).first()[0] or 0) + 1
    groups = max(1, -(-total // (every * QUERY_ROWS)))
    queries = (
        rows.where("is_query").repartitionByRange(groups, "place", "id")
        .sortWithinPartitions("place", "id").mapInArrow(_packer("q", QUERY_ROWS), kind.format("q")))
    units = _meetings(queries, index, shards, groups)
    found = units.mapInArrow(_search(k, block), "query_id long, id long, score long, scored long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    one = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    return (
        one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"))
