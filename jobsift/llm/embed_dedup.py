"""Near-duplicate vectors: random projections decoded to points of the lattice E8.

In each table a unit vector is projected to eight dimensions, shifted at random and decoded
to its nearest lattice point, its home cell.  It also visits the ``PROBES`` neighbouring cells
(the home point plus one of the 240 shortest lattice vectors) that lie nearest.  Two vectors
meet in a table when the home of one is home or visited cell of the other.  All vectors in a
cell are compared by cosine in double precision, in blocks of bounded size.

A pair is counted once: in the first table where it meets, in the home cell of its smaller
id if that holds both, else in the other's.  So cells send back a count per vector and links
that span what they joined, at most one row per vector and block, never all pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.llm.components import connected_components
from jobsift.session import materialize

#: Recall over 0.99 at cosine 0.9: a table misses such a pair with probability 0.34.
TABLES = 6
PROBES = 4
WIDTH = 5.0
#: Vectors of a cell that meet in one task.
BLOCK = 1024
SEED = 8


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2)
             for a in (1, -1) for b in (1, -1)]
    half = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*whole, *half])


ROOTS = _roots()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest point with whole coordinates of even sum."""
    point = np.rint(x)
    off = x - point
    row = np.flatnonzero(point.sum(axis=1) % 2 != 0)
    worst = np.abs(off[row]).argmax(axis=1)
    point[row, worst] += np.where(off[row, worst] >= 0, 1, -1)
    return point


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest lattice point: of the even points, or of those shifted by one half."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH) -> np.ndarray:
    """``(vector, table, 1 + probes)`` cell keys; the first of each table is the home.

    A projection begins with that of fewer dimensions.
    """
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    for t in range(tables):
        rng = np.random.default_rng([SEED, t])
        shift, weight = rng.random(8) * 2, rng.integers(1, 2**62, 8)
        project = rng.normal(size=(unit.shape[1], 8)) * (math.sqrt(8) / width)
        y = unit @ project + shift
        home = decode_e8(y)
        # |y - home - r|^2 grows with -(y - home) . r, as all r have one length.
        near = np.argsort(-((y - home) @ ROOTS.T), axis=1, kind="stable")[:, :probes]
        points = np.concatenate([home[:, None], home[:, None] + ROOTS[near]], axis=1)
        with np.errstate(over="ignore"):
            keys = np.rint(points * 2).astype(np.int64) @ weight
        out[:, t] = keys // tables * tables + t  # the table can be read from a cell's key
    return out


def _units(values: pa.ListArray) -> tuple[np.ndarray, list[bytes]]:
    """Which rows are usable, and these rows at length 1 in double precision.

    Zeros at the end of a vector are left out, so vectors of any length meet as if filled up with
    zeros, wherever they are read.
    """
    good, rows = [], []
    for i, v in enumerate(values.to_pylist()):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float64)
            x /= np.abs(x).max()
            x = x[:np.flatnonzero(x)[-1] + 1]
            good.append(i), rows.append((x / np.sqrt((x * x).sum())).tobytes())
    return np.array(good, np.int64), rows


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good, units = _units(batch.column(1))
        if len(good):
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), pa.array(units, pa.binary())], names=["id", "unit"])


def _filled(units: list[bytes]) -> np.ndarray:
    """Unit vectors as rows of the longest one's width."""
    rows = [np.frombuffer(u) for u in units]
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _placer(tables: int, probes: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys = cells(_filled(part.column("unit").to_pylist()), tables, probes, width)
                flat = keys.reshape(part.num_rows, -1)
                source = pa.array(np.repeat(np.arange(part.num_rows), flat.shape[1]))
                packed = pa.array([k.tobytes() for k in keys], pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array(flat.reshape(-1)), part.column("id").take(source), part.column("copies").take(source),
                    part.column("unit").take(source), packed.take(source)],
                    names=["cell", "id", "copies", "unit", "keys"])
    return run


def _pairs(table: pa.Table, tables: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All linked pairs of a block pair (positions), and which of them are counted here."""
    cell = table.column("cell")[0].as_py()
    ids = table.column("id").to_numpy()
    side = table.column("side").to_numpy()
    units = _filled(table.column("unit").to_pylist())
    keys = np.stack([np.frombuffer(k, np.int64) for k in table.column("keys").to_pylist()]).reshape(len(ids), tables, -1)
    t = cell % tables
    one, two = np.flatnonzero(side != 2), np.flatnonzero(side != 1)
    a, b = np.nonzero(units[one] @ units[two].T >= least)
    a, b = one[a], two[b]
    same = side[a] == 0
    keep = (ids[a] != ids[b]) & (~same | (ids[a] < ids[b]))
    a, b = a[keep], b[keep]
    swap = ids[a] > ids[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    here = np.zeros(len(a), bool)
    for at in range(0, len(a), 65536):
        x, y = keys[a[at:at + 65536]], keys[b[at:at + 65536]]
        x_in_y = (x[:, :, :1] == y).any(axis=2)
        meets = x_in_y | (y[:, :, :1] == x).any(axis=2)
        first = meets.argmax(axis=1)
        owner = np.where(x_in_y[:, t], x[:, t, 0], y[:, t, 0])
        here[at:at + 65536] = (first == t) & (owner == cell)
    return ids, a, b, here


def _counter(tables: int, least: float, schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        copies = table.column("copies").to_numpy()
        ids, a, b, here = _pairs(table, tables, least)
        n = np.zeros(len(ids), np.int64)
        np.add.at(n, a[here], copies[b[here]])
        np.add.at(n, b[here], copies[a[here]])
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        label = rank.copy()
        while len(a):
            low = label.copy()
            np.minimum.at(low, a, label[b])
            np.minimum.at(low, b, label[a])
            low = np.minimum(low, low[order[low]])
            if (low == label).all():
                break
            label = low
        rows = np.flatnonzero((n > 0) | (label != rank))
        return pa.table([pa.array(ids[rows]), pa.array(n[rows]), pa.array(ids[order[label[rows]]])], schema=schema)
    return run


def near_duplicate_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = 0.9,
    tables: int = TABLES,
    probes: int = PROBES,
    width: float = WIDTH,
    block: int = BLOCK,
) -> DataFrame:
    """``(id, n_links, component_id)`` of every row of ``vectors``.

    A link joins two ids whose vectors have a cosine of ``least`` or more; every link is
    verified, and those of equal vectors are always found.  ``component_id`` is the least id
    reachable, the row's own without links.  Vectors that are null, empty, zero or hold null or
    non-finite components have no links; so have rows with a null id, whose component is
    null.  Vectors of fewer dimensions count as filled up with zeros.  Rows that repeat an id with an equal vector count once and each get
    their row.  Other columns are not read.  An empty frame gives no rows.
    """
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    units = source.where("id IS NOT NULL").mapInArrow(_reader, "id long, unit binary").distinct()
    units = materialize(units, "units")
    heads = units.groupBy("unit").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    heads = materialize(heads.select("id", "copies", "unit"), "heads")

    placed = heads.mapInArrow(_placer(tables, probes, width), "cell long, id long, copies long, unit binary, keys binary")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    sizes = materialize(sizes.withColumn("blocks", F.ceil(F.col("rows") / block)), "cells")
    # Each block of a cell meets itself (side 0) and each other block (side 1 or 2) in a task.
    mine = F.pmod(F.xxhash64("id"), F.col("blocks"))
    dealt = placed.join(sizes.select("cell", "blocks"), "cell").withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "cell", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"),
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
        "id", "copies", "unit", "keys")
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("to", pa.int64())])
    found = materialize(
        dealt.groupBy("cell", "lo", "hi").applyInArrow(_counter(tables, least, schema), "id long, n long, to long"), "found")

    counts = found.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "head")
    copies = units.join(heads.withColumnRenamed("id", "head"), "unit").select("id", "head", "copies")
    links = found.where("id <> to").select(F.col("id").alias("a"), F.col("to").alias("b")).union(
        copies.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")))
    part = connected_components(links)
    linked = copies.join(counts, "head", "left").groupBy("id").agg(
        F.sum(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    return (
        source.select("id").join(linked, "id", "left").join(part, "id", "left")
        .select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")))
