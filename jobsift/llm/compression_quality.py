"""Quality of texts by compression: the class whose dictionary packs a text better is likelier its own.

Two zstandard dictionaries are trained, one on blocks of good texts and one on blocks of bad
ones.  A text is cut into blocks of a fixed size, so that the dictionaries matter from its first
word to its last and not only until the text has filled the compressor's own window; every block
is compressed with both.  The difference of the summed sizes, divided by their sum, is the
evidence; what repeats itself without end is short under either dictionary, so the logarithm of
the compressed size against the text's own goes beside it.  A logistic curve over both, fitted
on labelled texts that took no part in the dictionaries, turns them into a probability.

Nothing but the text enters a score.  The model (two dictionaries and three numbers) has a fixed
size and travels with the tasks; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from jobsift.llm.memory import lean

#: Bytes of a block, zstandard level and bytes of a dictionary.
BLOCK = 1024
LEVEL = 3
DICTIONARY_BYTES = 112_640
#: Labelled texts of each class that are sampled for the dictionaries and for the curve, and
#: blocks that a text gives to a dictionary, evenly spread over the whole text.
DICTIONARY_TEXTS = 800
CURVE_TEXTS = 1500
BLOCKS_OF_A_TEXT = 8
#: Bytes added to each side of a quotient of sizes, so that a few words are weak evidence.
WEIGHT_OF_DOUBT = 16
#: A text of this many bytes or more is encoded and scored in slices of that size.
SLICE = 1 << 20
SIZES = ("n_good", "n_bad", "n_bytes")


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries of both classes and the curve ``1 / (1 + exp(-(slope * difference + steep * shortness + offset)))``."""

    good: bytes
    bad: bytes
    slope: float
    steep: float
    offset: float


class Sizes:
    """Compressed sizes of texts with both dictionaries; built once per task."""

    def __init__(self, good: bytes, bad: bytes):
        self._packers = [self._packer(d) for d in (good, bad)]

    @staticmethod
    def _packer(dictionary: bytes) -> zstandard.ZstdCompressor:
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if data:
            data.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(
            level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)

    def of(self, text: str) -> tuple[int, int, int]:
        """Bytes with the dictionary of good and with that of bad texts, over all blocks, and of the text."""
        good, bad = (p.compress for p in self._packers)
        n_good = n_bad = size = 0
        # Long texts are encoded slice by slice; blocks are cut inside a slice.
        for at in range(0, len(text), SLICE):
            raw = text[at:at + SLICE].encode("utf-8", "replace")
            size += len(raw)
            for b in range(0, len(raw), BLOCK):
                block = raw[b:b + BLOCK]
                n_good += len(good(block))
                n_bad += len(bad(block))
        return n_good, n_bad, size


def difference(n_good, n_bad):
    """The normalised difference: above 0 the good dictionary packs better; 0 for empty texts."""
    return (n_bad - n_good) / (n_bad + n_good + WEIGHT_OF_DOUBT)


def spread_blocks(text: str, most: int = BLOCKS_OF_A_TEXT) -> list[bytes]:
    """Up to ``most`` blocks of a text, evenly spread from its first to its last."""
    raw = text.encode("utf-8", "replace")
    count = math.ceil(len(raw) / BLOCK)
    chosen = range(count) if count <= most else [i * (count - 1) // (most - 1) for i in range(most)]
    return [raw[i * BLOCK:(i + 1) * BLOCK] for i in chosen]


def train_dictionary(blocks: Sequence[bytes]) -> bytes:
    """A dictionary of the blocks; of their plain content where they are too few to train on."""
    if not blocks:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, list(blocks), level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def fit_curve(features: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes and offset of the likeliest logistic curve over ``features[text, column]``.

    Slopes are weakly pulled to 0.  Targets are ``(n + 1) / (n + 2)`` and ``1 / (n + 2)`` in place
    of 1 and 0, so that classes that a threshold separates still get finite numbers.
    """
    n1 = int(y.sum())
    n0 = len(y) - n1
    width = features.shape[1]
    if not n0 or not n1:
        return np.zeros(width), math.log((n1 + 1) / (n0 + 1))
    centre, scale = features.mean(axis=0), features.std(axis=0)
    scale[scale == 0] = 1.0
    x = np.column_stack([(features - centre) / scale, np.ones(len(y))])
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    pull = np.diag([1e-3] * width + [0.0])
    at = np.zeros(width + 1)
    at[-1] = math.log((n1 + 1) / (n0 + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -35, 35)))
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((x * w[:, None]).T @ x + pull, x.T @ (target - p) - pull @ at)
        # A step is kept short, as far from the optimum the curvature says little.
        step *= min(1.0, 2.0 / max(abs(step).max(), 1e-12))
        at += step
        if abs(step).max() < 1e-10:
            break
    slopes = at[:-1] / scale
    return slopes, float(at[-1] - slopes @ centre)


def _draw(labelled: DataFrame, label: int, n: int, part: int) -> DataFrame:
    """The ``n`` ids of a class with the least hashes in one half of all hashes."""
    return labelled.where((F.col("label") == label) & (F.col("half") == part)).orderBy("place", "id").limit(n)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """The model of ``docs(id_col, text_col)`` and ``labels(id_col, label_col)``.

    Only a bounded sample is read by the fit: ``DICTIONARY_TEXTS`` ids of each class for the
    dictionaries and ``CURVE_TEXTS`` others of each class for the curve (their share in the
    labels is kept by weighing the offset), those with the least hashes.  The driver receives
    ``BLOCKS_OF_A_TEXT`` blocks of a text or three numbers of it.  Labels other than 0 and 1, null
    ids, ids without a document and ids with both labels take no part; of rows that repeat an
    id one text is taken.  Without labelled texts of both classes every score is the share of
    class 1 (one half if there are none).
    """
    known = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct()
    labelled = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("other"))
        .where("label = other").join(known, "id", "left_semi")
        .select("id", F.col("label").cast("int").alias("label"), F.xxhash64("id").alias("place"))
        # One bit decides whether an id serves the dictionaries or the curve, the rest its place.
        .withColumn("half", F.col("place").bitwiseAND(1)))
    wanted = [(_draw(labelled, label, n, part).select("id", "label", F.lit(part).alias("part")))
              for label in (0, 1) for part, n in ((0, DICTIONARY_TEXTS), (1, CURVE_TEXTS))]
    sample = wanted[0].union(wanted[1]).union(wanted[2]).union(wanted[3])
    # At most 2 * (DICTIONARY_TEXTS + CURVE_TEXTS) ids are sent.
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    # One text of an id that repeats: that of the least hash, then the least text.
    found = found.groupBy("id", "label", "part").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select(
        "id", "label", "part", "one.text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, classes, texts = (batch.column(i) for i in range(3))
            for i in range(batch.num_rows):
                cut = spread_blocks(texts[i].as_py())
                yield pa.RecordBatch.from_arrays(
                    [ids.take([i] * len(cut)), classes.take([i] * len(cut)), pa.array(range(len(cut)), pa.int32()), pa.array(cut, pa.binary())],
                    ["id", "label", "at", "block"])

    id_type = docs.schema[id_col].dataType.simpleString()
    cut = found.where("part = 0").select("id", "label", "text").mapInArrow(lean(blocks), f"id {id_type}, label int, at int, block binary")
    # The sort makes the order, and so the dictionary, repeatable.
    lists = cut.orderBy(F.xxhash64("id", "at"), "id", "at").toArrow()
    by_class = lists.column("label").to_numpy()
    block_list = lists.column("block").to_pylist()
    good, bad = (train_dictionary([b for b, c in zip(block_list, by_class) if c == label]) for label in (1, 0))
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not good or not bad:
        n1, n0 = counts.get(1, 0), counts.get(0, 0)
        return QualityModel(good, bad, 0.0, 0.0, math.log((n1 + 1) / (n0 + 1)))
    curve = _sized(found.where("part = 1").select("id", "label", "text"), good, bad).orderBy("id").toArrow()
    y = curve.column("label").to_numpy()
    n_good, n_bad, size = (curve.column(c).to_numpy().astype(float) for c in ("n_good", "n_bad", "n_bytes"))
    shortness = np.log((n_good + WEIGHT_OF_DOUBT) / (size + WEIGHT_OF_DOUBT))
    (slope, steep), offset = fit_curve(np.column_stack([difference(n_good, n_bad), shortness]), y)
    # The sample may hold the classes in other shares than the labels; the odds are set right.
    m1, m0 = int(y.sum()), int(len(y) - y.sum())
    if m1 and m0:
        offset += math.log(counts.get(1, 0) / counts.get(0, 1) * m0 / m1)
    return QualityModel(good, bad, float(slope), float(steep), offset)


def _sized(rows: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """``rows`` with ``n_good``, ``n_bad`` and ``n_bytes`` in place of ``text``; every column else is carried."""
    kept = [c for c in rows.columns if c != "text"]
    fields = [rows.schema[c] for c in kept]
    schema = pa.schema([(f"c{i}", to_arrow_type(f.dataType)) for i, f in enumerate(fields)] + [(n, pa.int64()) for n in SIZES])

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Sizes(good, bad)
        for batch in batches:
            # One text at a time, so that a batch of very long texts exists once only.
            found = [packer.of(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).cast(schema.field(i).type) for i, c in enumerate(kept)]
                + [pa.array([f[j] for f in found], pa.int64()) for j in range(len(SIZES))], schema=schema)

    types = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
    out = rows.mapInArrow(lean(sizes), f"{types}, " + ", ".join(f"{n} long" for n in SIZES))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), *SIZES)


def probability(n_good: Column, n_bad: Column, n_bytes: Column, model: QualityModel) -> Column:
    x = difference(n_good.cast("double"), n_bad.cast("double"))
    shortness = F.log((n_good + WEIGHT_OF_DOUBT) / (n_bytes + WEIGHT_OF_DOUBT))
    return 1 / (1 + F.exp(-(F.lit(model.slope) * x + F.lit(model.steep) * shortness + F.lit(model.offset))))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``score`` (0 to 1, higher: class 1 likelier), ``n_good``, ``n_bad`` and ``n_bytes`` of every row of ``docs``.

    Whole texts are compressed.  Null and empty texts have no bytes and stand where the curve crosses both evidences' 0.  Rows that repeat an
    id are scored each; null ids stay null.  Other columns take no part, whatever their names.
    Empty frames give no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sized = _sized(rows, model.good, model.bad)
    return sized.select("id", probability(*(F.col(c) for c in SIZES), model).alias("score"), *SIZES)
