"""Every posterior of the language operator, recomputed in plain Python from the fitted table."""

import math
from collections import Counter, defaultdict

import pytest

from jobsift.llm import language_id as li

SF_DIR = "/root/testdata/sf0.001"
LEVELS = ("suffix", "domain", "host")


def posterior(rows, model, levels, declared=True):
    """``{key: (language, confidence, text language)}`` of rows(key, text, declared, host, domain, suffix)."""
    names = list(model)
    size = len(names)
    lower = lambda x: None if x is None else x.lower()
    texts = {}
    for key, text, *_ in rows:
        total, n = [0.0] * size, 0
        for slots in li.trigram_slots(text or ""):
            n += len(slots)
            for i, name in enumerate(names):
                total[i] += math.fsum(float(model[name][s]) for s in slots)
        top = max(total)
        foreign = n and (n * li.BACKGROUND - top) * li.TEMPER + math.log(li.UNKNOWN_PRIOR) > 0
        best = total.index(top) if n and not foreign else None
        texts[key] = ([(t - top) * li.TEMPER for t in total], n, (n * li.BACKGROUND - top) * li.TEMPER, best)
    counts = Counter(t[3] for t in texts.values() if t[3] is not None)
    whole = [counts[i] for i in range(size)]
    votes = {name: defaultdict(lambda: [0] * size) for name in (*LEVELS, "declared")}
    place = {"declared": 2, "host": 3, "domain": 4, "suffix": 5}
    for row in rows:
        best = texts[row[0]][3]
        for name, table in votes.items():
            value = lower(row[place[name]])
            if value is not None and best is not None:
                table[value][best] += 1
    out = {}
    for row in rows:
        score, n, unknown, best = texts[row[0]]
        prior = [(c + 1) / (sum(whole) + size) for c in whole]

        def others(name):
            return [max(v - (best == i), 0) for i, v in enumerate(votes[name][lower(row[place[name]])])]

        for name in levels:
            if row[place[name]] is not None:
                seen = others(name)
                prior = [(x + p * li.PULL) / (sum(seen) + li.PULL) for x, p in zip(seen, prior)]
        logs, other = [math.log(p) for p in prior], math.log(li.UNKNOWN_PRIOR)
        if declared and row[2] is not None:
            seen = others("declared")
            share = (sum(seen) + 1) / (sum(whole) + 1)
            logs = [a + math.log((x + li.PULL * share) / (t + li.PULL)) for a, x, t in zip(logs, seen, whole)]
            other += math.log(share)
        if n:
            logs, other = [a + s for a, s in zip(logs, score)], other + unknown
        top = max(max(logs), other)
        sure = 1 / (sum(math.exp(x - top) for x in logs) + math.exp(other - top)) if n else 0.0
        known = n and max(logs) >= other
        out[row[0]] = (names[logs.index(max(logs))] if known else li.UNKNOWN, sure, names[best] if best is not None else li.UNKNOWN)
    return out


@pytest.fixture(scope="module")
def model(spark):
    return li.fit_text_model(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "doc_id", "text", "lang", sample=20)


def check(found, want, least=li.LEAST_CONFIDENCE):
    assert len(found) == len(want)
    for r in found:
        language, sure, text = want[r.id]
        assert r.confidence == pytest.approx(sure, abs=1e-9) and r.text_language == text
        assert r.language == language and r.accepted == (language != li.UNKNOWN and sure >= least)


def test_documents(spark, model):
    """Declared labels of rows that the table was not fitted on, and the flat host."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, None, None) for r in docs.collect()]
    found = li.identify(docs, model, "doc_id", "text", "lang", "source").collect()
    check(found, posterior(rows, model, ("host",)))


def test_pages_with_all_evidence(spark, model):
    pages = li.page_evidence(spark.read.parquet(f"{SF_DIR}/pages.parquet"))
    rows = [(r.id, r.text, r.declared, r.host, r.domain, r.suffix) for r in pages.collect()]
    found = li.identify(pages, model, "id", "text", "declared", "host", "domain", "suffix").collect()
    check(found, posterior(rows, model, LEVELS))


def test_odd_rows(spark, model):
    texts = ["the and of", "der die und", "", None, "123 %", "Русский текст о свободе и правах всех людей", "de la", "the die and und", "x"]
    rows = [(i, texts[i % len(texts)], [None, "en", "DE", "zz"][i % 4], [None, "a.example", "b.example"][i % 3],
             [None, "example"][i % 2], [None, "com", "de"][(i // 3) % 3]) for i in range(120)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "key long, text string, declared string, host string, domain string, suffix string, language string")
    for levels in (LEVELS, ("host",), ()):
        columns = {f"{n}_col": n for n in levels}
        check(li.identify(docs, model, "key", "text", "declared", **columns).collect(), posterior(rows, model, levels))
    check(li.identify(docs, model, "key", "text").collect(), posterior(rows, model, (), declared=False))
