"""Language of a text from several kinds of evidence, fused by Bayes' rule.

* Text: character trigrams, hashed to a table of log-likelihoods per language.  The table is
  fitted on a bounded sample of labelled rows, ``SAMPLE`` per language.
* Declared language (of the markup or a label column) and address suffix: how often each
  value goes with each language, counted over all rows.
* Host: how often each language was seen on the host, smoothed towards its domain, that
  towards its suffix, and that towards the whole corpus.  A row's own vote is left out.

* None of them: a background language stands beside the model's, with a small prior and the same
  log-likelihood for every trigram.  Texts of the model's languages lie well above it, texts of
  others below, the surer the longer they are.

Counts and priors come from grouped aggregation over all rows.  Text likelihoods are worked
out over whole texts, in Arrow batches; the rest is built-in functions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsift.llm.memory import lean
from jobsift.llm.warc import LANGUAGE, visible_text
from jobsift.session import materialize
from jobsift.skew import top_k

#: Labelled rows per language that fit the text model, at most.
SAMPLE = 400
SLOTS = 1 << 16
#: Neighbouring trigrams tell much the same: their log-likelihoods are weighed down.
TEMPER = 0.1
#: Pseudo-counts of the level above.
PULL = 4.0
LEAST_CONFIDENCE = 0.5
UNKNOWN = "und"
#: A trigram's log-likelihood in a language that the model does not know, and such a language's prior.
BACKGROUND = -math.log(SLOTS / 2)
UNKNOWN_PRIOR = 0.05
_ROW = 1 << 20


def trigram_slots(text: str) -> Iterator[np.ndarray]:
    """Table slots of the text's character trigrams, in parts; what is no letter counts as a space."""
    low = text.lower()
    for at in range(0, len(low), _ROW):
        c = np.frombuffer(f" {low[max(at - 2, 0):at + _ROW]} ".encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        letter = (c > 127) | ((c >= 97) & (c <= 122))
        c = np.where(letter, c, np.uint64(32))
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        c = c[keep | (np.arange(len(c)) == 0)]
        if len(c) < 3:
            continue
        h = (c[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (c[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c[2:] * np.uint64(0x165667B19E3779F9))
        yield ((h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(48)).astype(np.int64)


def _count_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for slots in trigram_slots(text or ""):
                slot, n = np.unique(slots, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(slot), pa.string()), pa.array(slot), pa.array(n)], names=["language", "slot", "n"])


def fit_text_model(labelled: DataFrame, id_col: str, text_col: str, label_col: str, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """``{language: log-likelihood per slot}`` from at most ``sample`` rows of each language.

    The sample is the rows with the least hashes of their ids.  The model's size is fixed:
    ``SLOTS`` numbers per language.  Rows without id, text or label take no part.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("language"))
    usable = rows.where("id IS NOT NULL AND text IS NOT NULL AND language IS NOT NULL")
    chosen = top_k(usable.select("id", "language"), ["language"], [F.xxhash64("id"), F.col("id")], sample, spread_by=["id"])
    counts = (
        # ``sample`` ids per language at most, as the model has a table per language: small enough to send.
        usable.join(F.broadcast(chosen.select("id", "language")), ["id", "language"], "left_semi").select("language", "text")
        .mapInArrow(_count_sample, "language string, slot long, n long")
        .groupBy("language", "slot").agg(F.sum("n").alias("n")).toArrow())
    model = {}
    for language in sorted(set(counts.column("language").to_pylist())):
        part = counts.filter(pa.compute.equal(counts.column("language"), language))
        table = np.full(SLOTS, 0.5)
        table[part.column("slot").to_numpy()] += part.column("n").to_numpy()
        model[language] = np.log(table / table.sum()).astype(np.float32)
    return model


def _scorer(model: dict[str, np.ndarray], temper: float):
    table = np.stack(list(model.values()), axis=1) if model else np.zeros((SLOTS, 0), np.float32)

    @F.arrow_udf("text_score array<double>, trigrams long, unknown double")
    @lean
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            scores, letters, unknown = [], [], []
            for text in (x.as_py() for x in batch):
                total, n = np.zeros(table.shape[1]), 0
                for slots in trigram_slots(text or ""):
                    for at in range(0, len(slots), 1 << 16):
                        total += table[slots[at:at + (1 << 16)]].sum(axis=0, dtype=np.float64)
                    n += len(slots)
                scores.append(((total - total.max(initial=-math.inf)) * temper if n else total).tolist())
                letters.append(n)
                unknown.append((n * BACKGROUND - float(total.max())) * temper if n and len(total) else 0.0)
            yield pa.StructArray.from_arrays(
                [pa.array(scores, pa.list_(pa.float64())), pa.array(letters, pa.int64()), pa.array(unknown, pa.float64())],
                names=["text_score", "trigrams", "unknown"])
    return score


def _votes(rows: DataFrame, key: str, name: str, size: int) -> DataFrame:
    """Per value of ``key`` how many rows' texts speak for each language, as one array."""
    counts = [F.sum(F.when(F.col("best") == i, 1).otherwise(0)).alias(f"v{i}") for i in range(size)]
    table = rows.groupBy(key).agg(*counts).select(
        F.col(key).alias(f"{name}_key"), F.array(*(F.col(f"v{i}").cast("double") for i in range(size))).alias(name))
    # Written, its size is known: a small table is sent to the rows, a large one joined by key.
    return materialize(table, name)


def _smoothed(votes: Column, upper: Column, n: Column, pull: float) -> Column:
    return F.zip_with(votes, upper, lambda x, p: (x + p * pull) / (n + pull))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def identify(
    rows: DataFrame, model: dict[str, np.ndarray], id_col: str, text_col: str, declared_col: str | None = None,
    host_col: str | None = None, domain_col: str | None = None, suffix_col: str | None = None, keep: tuple[str, ...] = (),
    least_confidence: float = LEAST_CONFIDENCE, accepted: tuple[str, ...] | None = None, temper: float = TEMPER, pull: float = PULL,
) -> DataFrame:
    """``(id, language, confidence, text_language, accepted, *keep)`` of every row.

    Evidence whose column is None or whose value is null says nothing.  ``language`` is the one
    of greatest posterior (ties: the first by name), ``und`` if the model knows no language, the
    text has no letters or the background language is likelier than each known one; such rows are not accepted, nor are those under ``least_confidence`` or
    outside the ``accepted`` languages.  Null and empty texts have no letters.  Repeated rows are
    judged one by one; kept columns may not bear the names above.  Empty frames give no rows.
    """
    names = list(model)
    size = len(names)
    value = lambda c: F.lit(None).cast("string") if c is None else F.lower(F.col(c).cast("string"))
    source = rows.select(
        F.col(id_col).alias("id"), F.struct(F.lit(0).alias("_"), *keep).alias("kept"), value(declared_col).alias("declared"), value(host_col).alias("host"),
        value(domain_col).alias("domain"), value(suffix_col).alias("suffix"), F.col(text_col).alias("text"))
    if not keep:
        # Without other columns a text that is computed would become a part of the scoring call, which Spark then cannot plan.
        source = source.withColumn("text", F.explode(F.array("text")))
    kept = [F.col(f"kept.`{c}`") for c in keep]
    scored = source.withColumn("score", _scorer(model, temper)(F.col("text"))).drop("text").select("*", "score.*").drop("score")
    if not size:
        return scored.select(
            "id", F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("confidence"), F.lit(UNKNOWN).alias("text_language"),
            F.lit(False).alias("accepted"), *kept)
    # Texts of unknown languages have no vote.
    foreign = F.col("unknown") + math.log(UNKNOWN_PRIOR) > 0
    best = F.when((F.col("trigrams") > 0) & ~foreign, F.array_position("text_score", F.array_max("text_score")).cast("int") - 1)
    scored = materialize(scored.withColumn("best", best), "language")

    # Hosts under domains under suffixes under the corpus: one aggregate each.
    total = [int(x or 0) for x in scored.agg(*(F.sum(F.when(F.col("best") == i, 1)) for i in range(size))).first()]
    share = [(n + 1) / (sum(total) + size) for n in total]
    own = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(F.col("best") == i, 1.0).otherwise(0.0))
    prior = F.lit(share)
    joined = scored
    for name in ("suffix", "domain", "host"):
        column = {"suffix": suffix_col, "domain": domain_col, "host": host_col}[name]
        if column is None:
            continue
        votes = _votes(scored.where(F.col(name).isNotNull()), name, f"{name}_votes", size)
        joined = joined.join(votes, F.col(name) == F.col(f"{name}_votes_key"), "left")
        others = F.zip_with(f"{name}_votes", own, lambda n, o: F.greatest(n - o, F.lit(0.0)))
        n = F.aggregate(others, F.lit(0.0), lambda a, x: a + x)
        upper = prior
        prior = F.when(F.col(f"{name}_votes").isNull(), upper).otherwise(_smoothed(others, upper, n, pull))
        joined = joined.withColumn(f"{name}_prior", prior)
        prior = F.col(f"{name}_prior")

    logs = F.transform(prior, lambda p: F.log(p))
    other = F.lit(math.log(UNKNOWN_PRIOR))
    if declared_col is not None:
        # P(declared | language), with the value's own share of the corpus as the level above.
        votes = _votes(scored.where("declared IS NOT NULL"), "declared", "declared_votes", size)
        joined = joined.join(votes, F.col("declared") == F.col("declared_votes_key"), "left")
        others = F.zip_with("declared_votes", own, lambda n, o: F.greatest(n - o, F.lit(0.0)))
        n = F.aggregate(others, F.lit(0.0), lambda a, x: a + x)
        told = F.zip_with(others, F.lit([float(x) for x in total]), lambda x, t: F.log(
            (x + pull * (n + 1) / (sum(total) + 1)) / (t + pull)))
        other = other + F.when(F.col("declared_votes").isNull(), 0.0).otherwise(F.log((n + 1) / (sum(total) + 1)))
        logs = F.when(F.col("declared_votes").isNull(), logs).otherwise(_plus(logs, told))
    joined = joined.withColumn("logs", _plus(logs, F.when(F.col("trigrams") > 0, F.col("text_score")).otherwise(F.lit([0.0] * size)))).withColumn("other", other + F.col("unknown"))
    top = F.array_max("logs")
    place = F.array_position("logs", top).cast("int")
    likeliest = F.greatest(top, F.col("other"))
    sure = 1 / F.aggregate("logs", F.exp(F.col("other") - likeliest), lambda a, x: a + F.exp(x - likeliest))
    letters = F.col("trigrams") > 0
    known = letters & (top >= F.col("other"))
    name_of = lambda i: F.element_at(F.lit(names), i)
    out = joined.select(
        "id", F.when(known, name_of(place)).otherwise(UNKNOWN).alias("language"), F.when(letters, sure).otherwise(0.0).alias("confidence"),
        F.when(F.col("best").isNotNull(), name_of(F.col("best") + 1)).otherwise(UNKNOWN).alias("text_language"), "kept")
    good = (F.col("language") != UNKNOWN) & (F.col("confidence") >= least_confidence)
    if accepted is not None:
        good = good & F.col("language").isin(*accepted)
    return out.select("id", "language", "confidence", "text_language", good.alias("accepted"), *kept)


def page_evidence(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """Pages as rows to identify: ``(id, text, declared, host, domain, suffix)``.

    The domain is the host's last two labels; null or broken addresses have none of the three.
    """
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.when(host != "", host)
    declared = F.substring_index(F.lower(F.regexp_extract(F.col(html_col), LANGUAGE, 1)), "-", 1)
    return pages.select(
        F.col(id_col).alias("id"), visible_text(F.col(html_col)).alias("text"), F.when(declared != "", declared).alias("declared"),
        host.alias("host"), F.substring_index(host, ".", -2).alias("domain"), F.substring_index(host, ".", -1).alias("suffix"))
