"""Source divergence, spelling variants and the compression classifier against plain Python."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsift.llm import compression_quality, divergence, queries, spelling

SF_DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, value string, terms int, gid int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)


# Source divergence.

def audit(rows, least, top):
    """The operator, term by term and source by source."""
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = "".join(c if c.isascii() and c.isalpha() or ord(c) > 127 else " " for c in low(text or "")).split(" ")
        terms = [t for t in terms if t]
        counts[lang, source].update(terms)
        seen[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in seen[lang].items() if n >= least)
        v = len(kept)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i) for i, (item, value) in enumerate(items, 1) if part == "pair" or i <= top}
    return out


def some_docs(seed, n=160, sources=7):
    r = random.Random(seed)
    words = ["über", "Der", "der", "É", "é", "x", "日本", "a", "b-c", "c4d", "naïve", "THE", "the", "𝒳y"] + [f"w{chr(97 + i)}" for i in range(12)]
    rows = [(i, " ".join(r.choices(words, k=r.randrange(0, 12))), r.choice(["en", "en", "en", "de"]), f"s{r.randrange(sources)}") for i in range(n)]
    return rows + [(None, None, "en", "empty"), (1, "", "en", None), (1, "the the", None, "s1"), (1, "the the", None, "s1"), (2, "alone", "fr", "s1"), (3, "%% 12", "fr", "s2")]


@pytest.mark.parametrize("digest", [divergence.digest_of, lambda t: zlib.crc32(t) % 5, lambda t: 2**64 - 7])
def test_divergence(spark, monkeypatch, digest):
    """Small tiles and few digests: shared digests are told apart, sums over tiles are whole."""
    monkeypatch.setattr(divergence, "BUCKET_TERMS", 4)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", 3)
    monkeypatch.setattr(divergence, "HELD_COUNTS", 20)
    monkeypatch.setattr(divergence, "SLICE", 9)
    rows = some_docs(1)
    got = divergence.audit_sources(frame(spark, rows), least=8, top=4, digest=digest).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == audit(rows, 8, 4)


def test_divergence_ties_and_long_lists(spark, monkeypatch):
    """Ties at the cut are settled by the text; a list of digests too long to send is joined."""
    monkeypatch.setattr(divergence, "BROADCAST_DIGESTS", 3)
    rows = [(i, " ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90)), "en", f"s{i % 2}") for i in range(4)] + [(9, "z " * 200, "en", "s1")] * 3
    got = {tuple(r) for r in divergence.audit_sources(frame(spark, rows), least=2, top=50).collect()}
    assert got == audit(rows, 2, 50)
    assert [r[3] for r in sorted(got, key=lambda r: r[5]) if r[1] == "s0" and r[2] == "term"] == sorted({t for t in rows[0][1].split()})[:50]


def test_divergence_odd_tables(spark):
    assert divergence.audit_sources(frame(spark, []), least=1).collect() == []
    rows = [(1, None, None, None), (2, "", "", "b"), (3, "a " * 5000, "x", "c")]
    got = {tuple(r) for r in divergence.audit_sources(frame(spark, rows)).collect()}
    assert got == audit(rows, 30, 50) == {("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)}


# Spelling variants.

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(counts):
    near = defaultdict(list)
    for a, b in itertools.combinations(counts, 2):
        if one_edit(a, b):
            near[a].append(b), near[b].append(a)
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] is not None else None))
    return out


@pytest.mark.parametrize("cells", [spelling.TILE_CELLS, 60])
@pytest.mark.parametrize("signs, least, most", [("ab", 1, 7), ("abéß日", 6, 10), ("a", 1, 30)])
def test_spelling(spark, cells, signs, least, most, monkeypatch):
    """Few signs make many near words; small tiles split almost every key; small comparisons cut tiles."""
    if cells < 100:
        monkeypatch.setattr(spelling, "COMPARED_CELLS", 64)
    r = random.Random(cells + len(signs))
    counts = {"".join(r.choices(signs, k=r.randint(least, most))): r.choice([1, 2, 5, 5, 10, 25, 60, 300]) for _ in range(250)}
    counts["𝒳" * 8] = counts["𝒳" * 7 + "a"] = 3
    words = spark.createDataFrame([(w, n, "k", 1) for w, n in counts.items()], "word string, n long, key string, m int")
    got = spelling.group_spellings(words, tile_cells=cells).collect()
    assert len(got) == len(counts) and {tuple(x) for x in got} == grouped(counts)


def test_spelling_chain_and_odd_rows(spark):
    chain = [("abcdef" + "x" * i, 5 ** i) for i in range(9)]
    rows = [*chain, (None, 4), ("nocount", None), ("", 3), ("y" * 5000, 5), ("y" * 4999 + "z", 25), ("twice", 2), ("twice", 3), ("Twice", 1)]
    got = {r.word: r for r in spelling.group_spellings(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert all(got[w].root == chain[-1][0] for w, _ in chain)
    assert got["y" * 5000].form == "y" * 4999 + "z" and got["twice"].n == 5 and got["Twice"].form == "twice"
    assert got[""].n_near == 0 and len(got) == 14
    assert spelling.group_spellings(spark.createDataFrame([], "word string, n long")).collect() == []


def test_spelling_words_of_documents(spark):
    """Words lose a code point by the hash of document and run, every occurrence alike."""
    texts = {i: " ".join(f"Wördelich{chr(97 + i % 26)}{chr(97 + j % 26)}" for j in range(80)) + " 12x×÷ÿ_short" for i in range(40)}
    want = Counter()
    for i, text in [*texts.items(), *texts.items(), ("", "Anotherword " * 7)]:
        run = ""
        for c in text + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{i}:{run}".encode())
                k = h % len(run)
                want[run[:k] + run[k + 1:] if h % 199 == 0 else run] += 1
                run = ""
    rows = [(i, t, None, None) for i, t in texts.items()] * 2 + [(None, "Anotherword " * 7, None, None), (5, None, None, None), (6, "", None, None)]
    got = {r.word: r.n for r in queries.word_counts(frame(spark, rows)).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5} and any(len(w) == 10 for w in got)


# Compression.

@pytest.fixture(scope="module")
def scored(spark):
    return queries.op13_compression_quality(spark, SF_DIR).toPandas()


def test_quality_of_texts_not_learnt(spark, scored):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").toPandas()
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in scored.doc_id]).all()
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.5)).all()
    known = scored[scored.held_out].merge(labels, on="doc_id")
    good, bad = known[known.quality == 1], known[known.quality == 0]
    assert (good.predicted == 1).mean() > 0.95 and (bad.predicted == 0).mean() > 0.85
    assert ((known.score - known.quality) ** 2).mean() < 0.03
    assert (good.score.to_numpy()[:, None] > bad.score.to_numpy()).mean() > 0.98


def test_quality_reads_texts_only(spark, tmp_path, scored):
    """Labels held out, languages, sources and ids of other rows change no score; runs agree."""
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{tmp_path}/labels.parquet")
    docs.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string"), "score": F.lit("clash")}).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    again = queries.op13_compression_quality(spark, str(tmp_path)).toPandas()
    both = scored.merge(again, on="doc_id")
    assert len(both) == len(scored) and np.allclose(both.score_x, both.score_y, atol=1e-12)


def test_quality_odd_tables(spark):
    rows = [(1, "good text here " * 90, "", ""), (1, "another", "", ""), (2, "bad " * 700, "", ""), (None, None, "", ""), (3, "", "", ""), (4, "日本語 " * 3000, "", "")]
    docs = frame(spark, rows)

    def fit(labels):
        return compression_quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, text string"))

    for labels in ([], [(1, 1, "")], [(2, 0, ""), (2, 0, "")], [(1, 1, ""), (1, 0, ""), (9, 0, ""), (None, 1, ""), (2, None, ""), (3, 7, "")], [(1, 1, ""), (2, 0, "")]):
        got = compression_quality.score(docs, fit(labels)).collect()
        assert Counter(r.id for r in got) == Counter(r[0] for r in rows) and all(0 <= r.score <= 1 for r in got)
        assert {r.n_bytes for r in got if r.id in (None, 3)} == {0} and sum(r.n_bytes for r in got if r.id == 4) == 30000
    assert {r.score for r in compression_quality.score(docs, fit([])).collect()} == {0.5}
    assert compression_quality.score(frame(spark, []), fit([(1, 1, "")])).collect() == []


def test_quality_curve_and_blocks():
    r = np.random.default_rng(3)
    x = r.normal(size=(4000, 2))
    y = (r.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(int)
    slopes, offset = compression_quality.fit_curve(x, y)
    assert np.allclose(slopes, [2, -1], atol=0.2) and abs(offset - 0.5) < 0.15
    assert np.isfinite(compression_quality.fit_curve(x[:, :1], (x[:, 0] > 0).astype(int))[0]).all()
    text = "é" * 20000
    cut = compression_quality.spread_blocks(text, 5)
    assert len(cut) == 5 and cut[0] == text.encode()[:1024] and text.encode().endswith(cut[-1])
    sizes = compression_quality.Sizes(b"", b"")
    assert sizes.of("") == (0, 0, 0) and sizes.of("a" * (compression_quality.SLICE + 5))[2] == compression_quality.SLICE + 5
