"""The pipeline's stages against plain Python, and on odd rows."""

from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from jobsift.llm import bpe

SF_DIR = "/root/testdata/sf0.001"


def shingle_set(text):
    w = text.encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        path = corpus_pipeline.materialize(docs, f"test-{name}")
        docs = path
        out.append(docs.toPandas())
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "pii", "mixing", "bpe"]


def test_columns(stages):
    for table in stages[:-1]:
        assert list(table.columns) == corpus_pipeline.COLUMNS
    assert set(stages[-1].columns) == {*corpus_pipeline.COLUMNS, "token_ids", "n_tokens", "decodes"}


def test_languages_are_kept(stages):
    assert set(stages[0].doc_id) - set(stages[1].doc_id) <= {i for i, t in zip(stages[0].doc_id, stages[0].text) if not any(c.isalpha() for c in t)}


def test_one_of_each_group_stays(stages):
    sets = {i: shingle_set(t) for i, t in zip(stages[1].doc_id, stages[1].text)}
    label = dict.fromkeys(sets)
    label = {i: i for i in sets}
    ids = sorted(sets)
    for _ in range(3):
        for n, i in enumerate(ids):
            for j in ids[n + 1:]:
                if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    low = min(label[i], label[j])
                    label[i] = label[j] = low
    assert sorted(stages[2].doc_id) == [i for i in ids if label[i] == i]


def test_personal_data_is_replaced_and_nothing_else(stages):
    before, after = (dict(zip(s.doc_id, s.text)) for s in stages[2:4])
    assert before.keys() == after.keys()
    changed = [i for i in before if before[i] != after[i]]
    assert changed and all(any(c.isdigit() for c in before[i]) for i in changed)
    assert all("@" not in before[i] or before[i] != after[i] for i in before)


def test_mix_repeats_and_drops(stages):
    n = Counter(stages[4].doc_id)
    assert set(n) <= set(stages[3].doc_id) and set(n.values()) <= {1, 2}
    size = {i: len(t.split()) for i, t in zip(stages[3].doc_id, stages[3].text)}
    source, longest = dict(zip(stages[3].doc_id, stages[3].source)), Counter()
    for i, n_words in size.items():
        longest[source[i]] = max(longest[source[i]], n_words)
    # Documents are whole, so each source is within half a document of its target.
    assert all(len(t.split()) == size[i] for i, t in zip(stages[4].doc_id, stages[4].text))
    assert abs(sum(n[i] * size[i] for i in n) - 1.5 * sum(size.values())) <= sum(longest.values()) / 2 + len(longest)


def test_tokens(stages):
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks=bpe.load_ranks(public_tokenizers.path(corpus_pipeline.ENCODING)).ranks)
    last = stages[-1]
    assert last.decodes.all() and len(last) == len(stages[4])
    for text, ids, n in zip(last.text, last.token_ids, last.n_tokens):
        want = known.encode_ordinary(text)
        assert n == len(want) and bytes(ids) == b"".join(i.to_bytes(4, "little") for i in want)


def test_run_and_odd_rows(spark, tmp_path):
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "the and that with of is", "en", "a", 5), (3, "the and that with of was to", None, None, None),
            (3, "the and that with of was to", None, None, None), (4, "der und nicht mit sich ist ein", "de", "b", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {None, 3, 4} and all(r.decodes for r in got)
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_near_copies_are_rows_not_ids(spark):
    """Null and repeated ids neither join rows nor tell copies apart; the least id stays, null ids last."""
    clean = ["the first clean text has words of its own", "another clean text that nobody else has written", "a third one says something else again here"]
    copied = "one text that was copied by several rows of the table"
    rows = [(None, clean[0]), (None, clean[1]), (None, copied + " x"), (None, copied + " x"), (7, clean[2]), (7, "the same id with a wholly different text in it"),
            (9, copied), (8, copied), (8, copied), (None, copied), (None, ""), (None, ""), (7, None)]
    for part in (rows, [r for r in rows if r[0] is None]):
        docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in part], "doc_id long, text string, lang string, source string, n_chars long")
        got = Counter((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
        want = Counter((i, t) for i, t in part if copied not in (t or ""))
        if len(part) == len(rows):
            assert got == want + Counter([(8, copied)])
        else:
            extra = got - want
            assert not want - got and sum(extra.values()) == 1 and all(i is None and copied in t for i, t in extra)
