"""BPE encoding and prefix counts against the libraries."""

import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from jobsift.llm import bpe, prefix_counts
from jobsift.llm.queries import QUERIES
from jobsift.llm.vocab import SPLIT

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MERGES = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "the", "'ll", "'re", "'s", "'", " ", "  ", "\n", "\t", "é", "ü", "1", "23", "!", "...", "<|endoftext|>", "<|end", "漢字",
         " ", "́", "x", "ing", "🙂", "\x1c", "\x85", "I", "don't", "===", "-" * 70, "　", "​", "ՠ", "\x00"]
TEXTS = [None, "", " ", "Hello world", "a" * 3000, "=" * 2000 + " " * 2000, "x\n\n  y", "token <|endoftext|> here"]


def mixtures(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(MERGES)


def test_pattern_is_the_public_one():
    assert SPLIT == public_tokenizers.PATTERN


@pytest.mark.parametrize("path", [RANKS, MULTI])
def test_encoder_equals_library(path):
    encoder = bpe.Encoder(path, memory=50)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocab.ranks, special_tokens={})
    rng = random.Random(1)
    for text in [t or "" for t in TEXTS] + mixtures(400) + ["".join(rng.choice("abcdeth") for _ in range(2500)), "ab" * 900]:
        ids = np.frombuffer(encoder.encode([text])[0], "<u4").tolist()
        assert ids == known.encode_ordinary(text), repr(text)
        assert b"".join(encoder.vocab.token[i] for i in ids) == text.encode()


def test_one_piece_by_rows_and_by_heap():
    vocab = bpe.load_ranks(RANKS)
    rng = random.Random(2)
    pieces = ["".join(rng.choice("theingaor") for _ in range(rng.randint(2, 60))).encode() for _ in range(300)]
    assert bpe.merge_rows(pieces, vocab) == [bpe.merge_long(p, vocab) for p in pieces]


def test_every_prefix(library):
    counter = prefix_counts.PrefixCounter(MERGES, memory=60)
    for text in [t for t in TEXTS if t and len(t) < 100] + mixtures(250):
        table = counter.tables([text])[0]
        got = np.cumsum(np.frombuffer(table, np.int8), dtype=int).tolist()
        want = [len(e.ids) for e in library.encode_batch([text[:i + 1] for i in range(len(text))], add_special_tokens=False)]
        assert got == want, repr(text)


def test_long_pieces(library):
    counter = prefix_counts.PrefixCounter(MERGES)
    rng = random.Random(4)
    for text in ["".join(rng.choice("abcdeth") for _ in range(2500)), "=" * 700, "漢" * 300]:
        table = counter.tables([text])[0]
        for end in (1, 255, 256, 257, 300, len(text)):
            assert prefix_counts.tokens_before(table, end) == len(library.encode(text[:end], add_special_tokens=False).ids)


def test_split_agrees_on_all_code_points():
    """Whatever a code point's class is taken for, the libraries' ids come out."""
    encoder = bpe.Encoder(RANKS)
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocab.ranks, special_tokens={})
    texts = ["".join(f"a{chr(c)}a1{chr(c)}1 {chr(c)}\n" for c in range(at, at + 512) if not 0xD800 <= c < 0xE000)
             for at in range(0, 0x20000, 512)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == known.encode_ordinary_batch(texts)


def test_budget(spark, library):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + mixtures(40))], "doc_id long, text string")
    for r in prefix_counts.truncate_to_budget(rows, MERGES, ["doc_id", "text"], 5).collect():
        text = r.text or ""
        fitting = [i for i in range(len(text) + 1) if i > 400 or len(library.encode(text[:i], add_special_tokens=False).ids) <= 5]
        if len(text) <= 400:
            assert r.truncated == (None if r.text is None else text[:max(fitting)])


def frame(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(3, "Hello world", "x", 1), (None, "null id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, packed_size long")


def test_odd_rows(spark, library):
    counted = prefix_counts.count_prefixes(frame(spark), MERGES, ["doc_id"]).collect()
    assert len(counted) == len(TEXTS) + 2
    for r in counted:
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
    decoded = bpe.decode(bpe.encode(frame(spark), RANKS, ["doc_id"]), RANKS, ["doc_id"]).collect()
    assert sorted(bytes(r.decoded).decode() for r in decoded) == sorted([t or "" for t in TEXTS] + ["Hello world", "null id"])
    empty = frame(spark).where("false")
    assert prefix_counts.count_prefixes(empty, MERGES, ["doc_id"]).count() == 0
    assert bpe.decode(bpe.encode(empty, RANKS, ["doc_id"]), RANKS, ["doc_id"]).count() == 0


def test_queries(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op6_token_counts"](spark, sf_dir).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)
    import hashlib

    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS).ranks, special_tokens={})
    for r in QUERIES["op7_byte_bpe"](spark, sf_dir).collect():
        ids = known.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
