"""Audit of how sources differ in their words, with the words' text read late.

1.  Every task counts the terms of its own documents by language and source and writes each
    count with a digest of 8 bytes; a term's text is written once, beside its first count.
    Digests, never terms, are then shuffled and their counts summed.
2.  Digests in too few documents of a language go before counts by source are shuffled.  The written texts of those that are left
    are read: the least and the greatest term of each.  Where they are unlike, several terms
    share the digest, and a second reading of the documents counts these few by their text and
    gives each a number of its own.
3.  Shares are compared in integers.  For two sources the differences of all kept terms are
    summed: terms are dealt into buckets and sources into blocks, a tile holds the shares of one
    bucket for two blocks in a matrix, and what the terms that both lack add is one product.
4.  The text is joined to the terms that are reported.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobsift.llm.memory import lean
from jobsift.session import materialize, recorded, remove_tables
from jobsift.skew import salt_of, spread_join

#: Bytes of a term, A-Z lower-cased; every other byte parts terms.
LETTERS = bytes.maketrans(
    bytes(range(128)), bytes(ord(chr(c).lower()) if chr(c) in ascii_uppercase + ascii_lowercase else ord(" ") for c in range(128)))
#: Documents of a language that a kept term is in, at least.
LEAST_DOCUMENTS = 30
#: Parts in which shares are told, and occurrences that each kept term is given beforehand.
PARTS = 1_000_000_000
PRIOR = 5
#: Terms reported for a source.
TOP_TERMS = 50
#: Kept digests up to which they are broadcast (8 bytes each) to the written texts.
BROADCAST_DIGESTS = 500_000
#: Counts that a task holds before it writes them, and bytes of a text that are split at once.
HELD_COUNTS = 1_000_000
SLICE = 1 << 20
#: Terms of a bucket and sources of a block, about.
BUCKET_TERMS = 1024
BLOCK_SOURCES = 128
#: Salts of a source's terms before its best ones meet.
SALTS = 16


def digest_of(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term)


def term_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, some at a time, however long it is."""
    raw = text.translate(LETTERS)
    at = 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):
            cut = raw.rfind(b" ", at + 1, end)
            end = cut if cut > 0 else raw.find(b" ", end)
            end = end if end > 0 else len(raw)
        yield raw[at:end].split()
        at = end


def _reader(digest: Callable[[bytes], int], every_text: bool):
    """Counts of a task's documents; each text beside its first count, or beside all."""
    names = ["lang", "source", "digest", "n", "docs", "term"]

    def written(counts: dict) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for (lang, source), (n, docs) in counts.items():
            terms = list(n)
            texts = terms if every_text else [t if t not in known else None for t in terms]
            known.update(terms)
            values = np.fromiter((digest(t) & 0xFFFFFFFFFFFFFFFF for t in terms), np.uint64, len(terms)).view(np.int64)
            columns = [
                pa.array([lang]).take(pa.array(np.zeros(len(terms), np.int32))), pa.array([source]).take(pa.array(np.zeros(len(terms), np.int32))),
                pa.array(values), pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in terms], pa.int64()),
                pa.array(texts, pa.binary()).cast(pa.string())]
            whole = pa.RecordBatch.from_arrays(columns, names=names)
            for i in range(0, len(terms), 10_000):
                yield whole.slice(i, 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for lang, source, text in zip(langs, sources, texts):
                n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                seen: set[bytes] = set()
                for terms in term_pieces(text.as_buffer().to_pybytes()):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
                held += len(n) - before
                if held >= HELD_COUNTS:
                    yield from written(counts)
                    counts, held = {}, 0
        yield from written(counts)
    return run


def _read(docs: DataFrame, digest: Callable[[bytes], int], every_text: bool) -> DataFrame:
    return docs.mapInArrow(lean(_reader(digest, every_text)), "lang string, source string, digest long, n long, docs long, term string")


def _summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy("lang", "source", *keys).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _listed(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose columns are listed in ``keys``; the list is sent only if it is short."""
    short = keys.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    return rows.join(F.broadcast(keys) if short else keys, keys.columns, "left_semi")


def _split(docs: DataFrame, shared: DataFrame, digest: Callable[[bytes], int], least: int) -> tuple[DataFrame, DataFrame]:
    """Counts and texts of the terms that share a digest, told apart by ``slot``, from 1."""
    counted = materialize(_summed(_listed(_read(docs, digest, True), shared), "digest", "term"), "shared-counts")
    often = counted.groupBy("lang", "digest", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    texts = materialize(often.select("digest", "term").distinct().withColumn(
        "slot", F.row_number().over(Window.partitionBy("digest").orderBy("term"))), "shared-texts")
    kept = often.drop("docs").join(texts, ["digest", "term"])
    return counted.join(kept, ["lang", "digest", "term"]).select("lang", "source", "digest", "slot", "n"), texts.select("digest", "slot", "term")


def _kept_counts(docs: DataFrame, digest: Callable[[bytes], int], least: int) -> tuple[DataFrame, DataFrame]:
    """``(lang, source, digest, slot, n)`` of kept terms and their ``(digest, slot, term)``."""
    with recorded() as working:
        written = materialize(_read(docs, digest, False), "read")
    often = written.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    kept = materialize(often.select("lang", "digest"), "kept")
    # Only counts of kept terms are shuffled by source.
    counted = materialize(_listed(written.select("lang", "source", "digest", "n"), kept).groupBy("lang", "source", "digest").agg(
        F.sum("n").alias("n")), "counts")
    texts = _listed(written.where("term IS NOT NULL").select("digest", "term"), kept.select("digest").distinct())
    texts = materialize(texts.groupBy("digest").agg(F.min("term").alias("least"), F.max("term").alias("greatest")), "texts")
    remove_tables(docs.sparkSession, working)
    unique = texts.where("least = greatest").select("digest", F.lit(0).alias("slot"), F.col("least").alias("term"))
    shared = texts.where("least <> greatest").select("digest")
    counts = counted.select("lang", "source", "digest", F.lit(0).alias("slot"), "n")
    if shared.isEmpty():
        return counts, unique
    split, split_texts = _split(docs, shared, digest, least)
    counts = counts.join(shared, "digest", "left_anti").select(*counts.columns).union(split)
    return materialize(counts, "kept-counts"), unique.union(split_texts)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(PARTS * (count + PRIOR) / (total + PRIOR * terms))``, in whole decimals; null without terms."""
    def whole(x: Column) -> Column:
        return x.cast("decimal(20,0)")

    over = whole(count + PRIOR) * F.lit(PARTS).cast("decimal(10,0)")
    under = whole(total) + F.lit(PRIOR).cast("decimal(2,0)") * whole(terms)
    return F.when(terms > 0, F.lit(1).cast("long") + F.call_function("div", over, under))


def _tile(key: tuple, rows: pa.Table) -> pa.Table:
    """What the terms of a bucket add for each two sources of two blocks, over what absent terms add."""
    lang, lo, hi = key[0].as_py(), key[2].as_py(), key[3].as_py()
    names, first = np.unique(rows.column("gid").to_numpy(), return_index=True)
    spot = np.searchsorted(names, rows.column("gid").to_numpy())
    absent, block = rows.column("p0").to_numpy()[first], rows.column("block").to_numpy()[first]
    # Rows of slot -1 stand for the sources of the blocks, also those without a term of the bucket.
    real = rows.column("slot").to_numpy() >= 0
    terms = np.stack([rows.column("digest").to_numpy(), rows.column("slot").to_numpy().astype(np.int64)])[:, real]
    _, at = np.unique(terms, axis=1, return_inverse=True)
    at = at.reshape(-1)
    shares = np.tile(absent, (int(at.max(initial=-1)) + 1, 1))
    shares[at, spot[real]] = rows.column("p").to_numpy()[real]
    out = []
    for i in np.flatnonzero(block == lo):
        others = np.flatnonzero(block == hi)
        if lo == hi:
            others = others[others > i]
        if len(others):
            gap = np.abs(shares[:, others] - shares[:, [i]]).sum(axis=0) - len(shares) * np.abs(absent[others] - absent[i])
            out.append((np.full(len(others), names[i]), names[others], gap))
    a, b, gap = (np.concatenate(c) if out else np.zeros(0, np.int64) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": np.minimum(a, b), "b": np.maximum(a, b), "gap": gap})


def _pair_gaps(shares: DataFrame, totals: DataFrame, sizes: DataFrame) -> DataFrame:
    """``(lang, a, b, gap)`` with a < b, summed over tiles."""
    sizes = F.broadcast(sizes.select(
        "lang", F.ceil(F.col("terms") / BUCKET_TERMS).cast("int").alias("buckets"), F.ceil(F.col("sources") / BLOCK_SOURCES).cast("int").alias("blocks")))
    columns = ["lang", "bucket", "blocks", "gid", "digest", "slot", "p", "p0"]
    dealt = shares.join(sizes, "lang").withColumn("bucket", F.pmod(F.xxhash64("digest", "slot", F.lit(2)), "buckets").cast("int"))
    present = totals.join(sizes, "lang").where("buckets > 0").withColumns({
        "bucket": F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)), "digest": F.lit(0).cast("long"), "slot": F.lit(-1), "p": F.col("p0")})
    dealt = dealt.select(*columns).union(present.select(*columns))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("gid", F.lit(3)), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "lang", "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
        "gid", "block", "digest", "slot", "p", "p0")
    return dealt.groupBy("lang", "bucket", "lo", "hi").applyInArrow(_tile, "lang string, a long, b long, gap long").groupBy(
        "lang", "a", "b").agg(F.sum("gap").alias("gap"))


def audit_sources(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, digest: Callable[[bytes], int] = digest_of,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every source of every language.

    Part ``pair`` compares a source with each other source of its language: the sum of the
    distances of their shares over all kept terms of the language, 0 without any.  Part ``term``
    gives the ``top`` terms whose share in the source exceeds that in the language the most.
    Ranks count from 1, largest value first, ties by the item's UTF-8 bytes.

    Null text, lang and source count as ''.  Rows that repeat each count.  Groups without terms
    are compared as well.  Other columns take no part.  Empty frames give no rows.
    ``digest`` may be any function of a term to 64 bits: terms that share a digest are split.
    The list of languages (two numbers each) is broadcast.
    """
    empty = F.lit("")
    docs = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), empty).alias("lang"), F.coalesce(F.col(source_col).cast("string"), empty).alias("source"),
        F.coalesce(F.col(text_col), empty).alias("text"))
    counts, texts = _kept_counts(docs, digest, least)
    # Written once, the numbers of the groups hold for good.
    groups = materialize(docs.select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id()), "groups")
    by_lang = counts.groupBy("lang", "digest", "slot").agg(F.sum("n").alias("lang_n"))
    langs = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(
        by_lang.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total")), "lang", "left").select(
        "lang", "sources", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"))
    langs = materialize(langs, "langs")
    totals = groups.join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(
        F.broadcast(langs.select("lang", "terms")), "lang")
    totals = materialize(totals.select(
        "lang", "source", "gid", "terms", F.coalesce("total", F.lit(0)).alias("total"),
        _share(F.lit(0).cast("long"), F.coalesce("total", F.lit(0)), F.col("terms")).alias("p0")), "totals")
    shares = spread_join(counts, totals.drop("terms"), ["lang", "source"], "inner", ["digest", "slot"]).join(
        F.broadcast(langs.select("lang", "terms", "lang_total")), "lang")
    shares = materialize(shares.select(
        "lang", "source", "gid", "digest", "slot", "p0", "lang_total", "terms", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p")), "shares")

    # Terms of a source: cut by value in salts, ties kept, before the text is joined.
    raised = shares.join(by_lang, ["lang", "digest", "slot"]).withColumn(
        "value", F.col("p") - _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).where("value > 0").select(
        "lang", "source", "digest", "slot", "value", salt_of(["digest", "slot"], SALTS).alias("salt"))
    by_value = F.col("value").desc()
    cut = raised.withColumn("r", F.rank().over(Window.partitionBy("lang", "source", "salt").orderBy(by_value))).where(F.col("r") <= top)
    cut = cut.withColumn("r", F.rank().over(Window.partitionBy("lang", "source").orderBy(by_value))).where(F.col("r") <= top)
    named = cut.join(texts, ["digest", "slot"]).select("lang", "source", F.col("term").alias("item"), "value")
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(by_value, "item"))
    terms = named.withColumn("rank", ranked).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    gaps = _pair_gaps(shares, totals, langs.select("lang", "sources", "terms"))
    others = totals.select("lang", F.col("source").alias("item"), F.col("gid").alias("of"), F.col("p0").alias("q0"))
    pairs = spread_join(totals, others, ["lang"], "inner", ["gid"], min_rows=1000).where("gid <> of").withColumns(
        {"a": F.least("gid", "of"), "b": F.greatest("gid", "of")})
    far = F.coalesce("gap", F.lit(0)) + F.coalesce(F.col("terms") * F.abs(F.col("p0") - F.col("q0")), F.lit(0))
    pairs = pairs.join(gaps.drop("lang"), ["a", "b"], "left").withColumn("value", far)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", ranked.alias("rank"))
    return pairs.union(terms)
