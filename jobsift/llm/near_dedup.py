"""Near-duplicate texts: fast similarity sketches, banding, exact verification.

1.  Each text's set of word shingles is sketched.  Round ``i`` throws every shingle into a
    hashed bin with a value that grows with ``i``; a bin keeps its least value.  Rounds go on
    until every bin is filled; from round ``coords`` on, round ``i`` throws all shingles into
    bin ``i - coords``, so that after ``2 * coords`` rounds none can be empty.  Two sets agree
    in a coordinate with the probability of their Jaccard similarity, with concentration
    bounds as for independent hashes, in time O(n + coords log coords).
2.  Texts with equal sets form one class.  Class heads are banded: ``rows`` coordinates
    hash to a bucket key, ``coords / rows`` keys each.
3.  Links are confirmed on the full shingle sets, with integers.  A group of thousands of
    near copies is not expanded into pairs: members of a bucket are compared with the member
    that has the least share of shingles of its own, then, where a bucket still holds
    several components, with one member picked by hash.  What is still apart is compared
    across components in blocks: each set is told by its difference from the bucket's central
    member, which is short, and two sets differ by the difference of their differences.
    Only links leave a block, at most one per member and component.

A pair of similarity 0.8 or more misses all 40 bands with probability 1.3e-7 or less.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from jobsift.llm.components import connected_components
from jobsift.llm.memory import lean
from jobsift.llm.shingles import mix, shingle_sets, slices
from jobsift.session import materialize, recorded, remove_tables

COORDS = 200
ROWS = 5
#: Members of a bucket's group that meet in one task, on either side.
BLOCK = 1024
_COLUMNS = 8192
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def sketch(owner: np.ndarray, values: np.ndarray, texts: int, coords: int = COORDS) -> np.ndarray:
    """A ``texts x coords`` matrix of sketches; rows of texts without shingles stay at the maximum."""
    empty = np.uint64(2**64 - 1)
    out = np.full(texts * coords, empty, np.uint64)
    base = owner * coords
    for i in range(2 * coords):
        if not len(values):
            break
        h = mix(values + np.uint64((i + 1) * int(_GOLDEN) % 2**64))
        bins = (mix(h) % np.uint64(coords)).astype(np.int64) if i < coords else i - coords
        np.minimum.at(out, base + bins, (np.uint64(i) << np.uint64(54)) | (h >> np.uint64(10)))
        open_rows = (out.reshape(texts, coords) == empty).any(axis=1)
        keep = open_rows[owner]
        owner, values, base = owner[keep], values[keep], base[keep]
    return out.reshape(texts, coords)


def band_keys(sketches: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates, different for each band."""
    n, coords = sketches.shape
    parts = sketches[:, :coords - coords % rows].reshape(n, -1, rows)
    key = np.zeros(parts.shape[:2], np.uint64) + np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * _GOLDEN
    for j in range(rows):
        key = mix(key ^ parts[:, :, j]) * np.uint64(5) + np.uint64(j)
    return mix(key).astype(np.int64)


def _lists(matrix: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(matrix).reshape(-1)
    offsets = np.arange(0, len(flat) + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _sketcher(k: int, coords: int, rows: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for texts in slices(batch.column(1).to_pylist()):
                owner, values = shingle_sets(texts, k)
                n = np.bincount(owner, minlength=len(texts)).astype(np.int64)
                sums = np.zeros((2, len(texts)), np.uint64)
                for row, salt in enumerate((np.uint64(0x51ED270B), np.uint64(0x2545F4914F6CDD1D))):
                    np.add.at(sums[row], owner, mix(values ^ salt))
                marks = sketch(owner, values, len(texts), coords)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(texts)), pa.array(n),
                    pa.array(sums[0].astype(np.int64)), pa.array(sums[1].astype(np.int64)),
                    _lists(band_keys(marks, rows))],
                    names=["id", "n_shingles", "f1", "f2", "keys"])
                at += len(texts)
    return run


def _set_maker(k: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for texts in slices(batch.column(1).to_pylist()):
                owner, values = shingle_sets(texts, k)
                ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts))))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), lists], names=["id", "shingles"])
                at += len(texts)
    return run


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``(a, b)`` with ``den * intersection >= num * union`` on full sets."""
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
        .select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb") - common).alias("either"))
        .where(F.col("common") * den >= F.col("either") * num).select("a", "b"))


def _possible(one: str, two: str, num: int, den: int) -> Column:
    """Whether the sizes, and the shingles that others have too, allow the similarity.

    With an intersection of c at most, ``num / den`` of the union is reached only if
    ``(num + den) * c >= num * (n + m)``.
    """
    n, m = F.col(f"{one}.n"), F.col(f"{two}.n")
    shared = F.least(f"{one}.shared", f"{two}.shared", n, m)
    return shared * (num + den) >= (n + m) * num


def _incidence(rows: np.ndarray, columns: np.ndarray, n: int, lo: int) -> np.ndarray:
    inside = (columns >= lo) & (columns < lo + _COLUMNS)
    out = np.zeros((n, _COLUMNS), np.float32)
    out[rows[inside], columns[inside] - lo] = 1
    return out


def _block_links(num: int, den: int, schema: pa.Schema):
    """Links between the two sides of a block, from the members' differences to one set.

    Sets of n and m members that differ in d have the similarity (n + m - d) / (n + m + d).
    """
    def run(table: pa.Table) -> pa.Table:
        side = table.column("apart").to_numpy(zero_copy_only=False)
        ids, part = table.column("id").to_pylist(), np.array(table.column("part").to_pylist(), object)
        n = table.column("n").to_numpy()
        lists = table.column("delta").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(ids)), lengths)
        _, column = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        place = np.empty(len(ids), np.int64)
        place[one], place[two] = np.arange(len(one)), np.arange(len(two))
        common = np.zeros((len(one), len(two)), np.float32)
        for lo in range(0, int(column.max(initial=-1)) + 1, _COLUMNS):
            x, y = (_incidence(place[row[m]], column[m], len(w), lo) for m, w in ((side[row], one), (~side[row], two)))
            common += x @ y.T
        apart = lengths[one][:, None] + lengths[two] - 2 * common.astype(np.int64)
        total = n[one][:, None] + n[two]
        a, b = np.nonzero((total - apart) * den >= (total + apart) * num)
        found = {}
        for i, j in zip(one[a], two[b]):
            if part[i] != part[j]:
                found[i, part[j]] = j
        return pa.table([pa.array([ids[i] for i, _ in found]), pa.array([ids[j] for j in found.values()])], schema=schema)
    return run


def _across(groups: DataFrame, sets: DataFrame, num: int, den: int, kind: str) -> DataFrame:
    """Links between different components of each of ``groups(hub, id, part)``.

    The largest component of a group need not be compared with itself.  The other members
    meet all members in pairs of blocks of bounded size; the large component's rows are
    copied only as often as the others have blocks.
    """
    counts = groups.groupBy("hub", "part").agg(F.count(F.lit(1)).alias("n"))
    plan = counts.groupBy("hub").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("part", F.struct("n", "part")).alias("main"))
    plan = plan.select("hub", "main", F.ceil(F.col("all") / BLOCK).alias("blocks"), F.ceil((F.col("all") - F.col("most")) / BLOCK).alias("rest"))
    near, far = F.array_except("s", "h"), F.array_except("h", "s")
    rows = (
        groups.join(sets.toDF("id", "s"), "id").join(sets.toDF("hub", "h"), "hub")
        .select("hub", "id", "part", F.size("s").cast("long").alias("n"), F.concat(near, far).alias("delta")).join(plan, "hub"))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    body = ["hub", "id", "part", "n", "delta"]
    apart = rows.where("part <> main").select(*body, mine("rest").alias("a"), upto("blocks").alias("b"), F.lit(True).alias("apart"))
    all_rows = rows.select(*body, upto("rest").alias("a"), mine("blocks").alias("b"), F.lit(False).alias("apart"))
    ids = groups.schema["id"].dataType
    schema = pa.schema([("a", to_arrow_type(ids)), ("b", to_arrow_type(ids))])
    return apart.unionByName(all_rows).groupBy("hub", "a", "b").applyInArrow(_block_links(num, den, schema), f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: tuple[int, int] = (4, 5),
    coords: int = COORDS,
    rows: int = ROWS,
) -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row of ``docs``.

    ``similarity`` is a fraction; a pair is linked at that Jaccard similarity or more.
    ``component_id`` is the least id reachable by links, the row's own if there are none.
    Null or wordless texts have no shingles and no links.  Rows that repeat an id are one
    node and each gets its row.  Rows with a null id have no links and a null component.
    Other columns of ``docs`` are not read.  An empty frame gives no rows.
    """
    with recorded() as written:
        result = _linked(docs, id_col, text_col, words, similarity, coords, rows)
    # Nothing reads the working tables once the result, the last one written, is there.
    remove_tables(docs.sparkSession, written[:-1])
    return result


def _linked(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: tuple[int, int], coords: int, rows: int) -> DataFrame:
    num, den = similarity
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    marks = materialize(
        source.mapInArrow(
            _sketcher(words, coords, rows),
            f"id {kind}, n_shingles long, f1 long, f2 long, keys array<long>"),
        "sketches")

    # Texts with equal sets: one head each.
    print_cols = ["n_shingles", "f1", "f2"]
    nodes = marks.where("id IS NOT NULL AND n_shingles > 0")
    heads = nodes.groupBy(*print_cols).agg(F.min("id").alias("head"))
    members = nodes.select("id", *print_cols).distinct().join(heads, print_cols).select("id", "head")
    members = materialize(members, "members")
    banded = (
        marks.join(heads.withColumnRenamed("head", "id"), ["id", *print_cols], "left_semi")
        .dropDuplicates(["id", *print_cols])
        .select("id", F.explode("keys").alias("key")))

    # Buckets of at least two class heads.
    shared = banded.groupBy("key").agg(F.min("id").alias("_first"), F.max("id").alias("_last")).where("_first <> _last")
    buckets = materialize(banded.select("key", "id").join(shared.select("key"), "key").distinct(), "buckets")
    involved = buckets.select("id").distinct()
    sets = materialize(
        source.join(involved, "id", "left_semi").mapInArrow(_set_maker(words), f"id {kind}, shingles array<long>")
        .dropDuplicates(["id", "shingles"]), "sets")
    # Shingles that no other set has: they have one row, which names their set.
    alone = (
        sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
        .where("n = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone")))
    traits = (
        sets.select("id", F.size("shingles").cast("long").alias("n")).join(alone, "id", "left")
        .select("id", F.struct("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared")).alias("t")))
    buckets = materialize(buckets.join(traits, "id").select("key", "t"), "traits")

    def central(t: str) -> Column:
        """The lower, the larger the part of the set that others have; no two alike."""
        return -F.round(F.col(f"{t}.shared") / F.col(f"{t}.n"), 4) + F.pmod(F.xxhash64(f"{t}.id"), F.lit(10**9)) / 1e14

    def compared(rows: DataFrame, hub: Column, different: Column) -> DataFrame:
        """Pairs of each member and its bucket's hub, the larger id first."""
        hubs = rows.groupBy("key").agg(F.min_by("t.id", hub).alias("_hub"))
        hubs = rows.join(hubs, "key").where("t.id = _hub").select("key", *(F.col(c).alias(c + "h") for c in rows.columns if c != "key"))
        return (
            rows.join(hubs, "key").where(different & _possible("t", "th", num, den))
            .select(F.greatest("t.id", "th.id").alias("a"), F.least("t.id", "th.id").alias("b")).distinct())

    own = members.where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b"))
    tested = materialize(compared(buckets, central("t"), F.col("t.id") != F.col("th.id")), "pairs")
    links = materialize(_confirm(tested, sets, num, den).union(own), "links")

    # Buckets that still hold several components.
    def split_buckets(links: DataFrame) -> DataFrame:
        part = connected_components(links)
        marked = buckets.join(part, F.col("t.id") == part["id"], "left").select("key", "t", F.coalesce("component", "t.id").alias("part"))
        several = marked.groupBy("key").agg(F.min("part").alias("_lo"), F.max("part").alias("_hi")).where("_lo <> _hi")
        return materialize(marked.join(several.select("key"), "key"), "split")

    again = compared(split_buckets(links), F.xxhash64("key", "t.id"), F.col("part") != F.col("parth"))
    again = materialize(again.join(tested, ["a", "b"], "left_anti"), "pairs")
    links = materialize(links.union(_confirm(again, sets, num, den)), "links")

    # What is still apart: by central member of the bucket, across components, in blocks.
    left = split_buckets(links)
    hubs = left.groupBy("key").agg(F.min_by("t.id", central("t")).alias("hub"))
    groups = materialize(left.join(hubs, "key").select("hub", F.col("t.id").alias("id"), "part").distinct(), "groups")
    links = links.union(_across(groups, sets, num, den, kind))

    part = connected_components(links)
    return materialize(
        marks.select("id", "n_shingles").join(part, "id", "left")
        .select("id", "n_shingles", F.coalesce("component", "id").alias("component_id")), "near-duplicates")
