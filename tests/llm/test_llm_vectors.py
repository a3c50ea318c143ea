"""Exact top-k and lattice near-duplicates against brute force."""

import math

import numpy as np
import pytest

from jobsift.llm import embed_dedup, topk

SCHEMA = "vec_id long, embedding array<float>, score string, id int, cell long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "s", 1, 2) for i, v in rows], SCHEMA)


def odd_rows(rng):
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(300)]
    base = rng.normal(size=16)
    rows += [(300 + i, (base + rng.normal(size=16) * .15).astype(np.float32).tolist()) for i in range(150)]
    rows += [(500 + i, rows[7][1]) for i in range(40)]
    rows += [(600, None), (601, [0.0] * 16), (602, [math.nan] + [1.0] * 15), (603, [None] + [1.0] * 15), (604, [math.inf] + [1.0] * 15), (605, []),
             (None, rows[7][1]), (7, rows[7][1]), (606, [1e-30] * 16), (607, [1e30] * 16)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return odd_rows(np.random.default_rng(3))


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("shard_rows, block", [(8192, 128), (64, 7)])
def test_top_k_equals_brute_force(spark, rows, shard_rows, block):
    rows = [(i, v) for i, v in rows if i != 607]
    got = {}
    for r in topk.search_top_k(frame(spark, rows), every=5, k=5, shard_rows=shard_rows, block=block).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    table = {i: np.floor(np.array(v, np.float32).astype(float) * 256).astype(np.int64) for i, v in rows if i is not None and usable(v)}
    want = {}
    for q in [i for i in table if i % 5 == 0]:
        score = lambda i: int(sum(a * b for a, b in zip(table[q].tolist(), table[i].tolist())))
        best = sorted(((-score(i), i) for i in table if i != q))[:5]
        want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert {q: sorted(v) for q, v in got.items()} == want


def test_copies_of_queries_are_not_sent_by_the_driver(spark, monkeypatch):
    """Queries are copied for every shard, which a broadcast would hold at once; several copies of a shard give the same."""
    rng = np.random.default_rng(8)
    rows = frame(spark, [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(400)])
    want = sorted(map(tuple, topk.search_top_k(rows, every=4, shard_rows=50).collect()))
    monkeypatch.setattr(topk, "QUERY_ROWS", 10)
    monkeypatch.setattr(topk, "GROUPS_A_COPY", 3)
    got = topk.search_top_k(rows, every=4, shard_rows=50)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 500
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "BroadcastExchange" not in plan


def test_top_k_of_little(spark):
    few = frame(spark, [(50, [1.0, 2.0]), (51, [1.0, -2.0])])
    assert [(r.query_id, r["rank"], r.id) for r in topk.search_top_k(few).collect()] == [(50, 1, 51)]
    assert topk.search_top_k(few.where("false")).count() == 0
    assert topk.search_top_k(frame(spark, [(50, [1.0, 2.0])])).count() == 0


def test_blocks_are_pruned():
    rng = np.random.default_rng(1)
    near = rng.integers(80, 100, (64, 8))
    weights = np.concatenate([near, rng.integers(-5, 5, (640, 8))])
    (_, ids, scores, scored), = topk.best_of_shard(np.array([-1]), near[:1], np.arange(704), weights, 5, 64)
    assert scored == 64 and scores.tolist() == sorted((weights @ near[0]).tolist(), reverse=True)[:5]


def test_wide_integers_stay_exact():
    weights = np.array([[2**30, 1], [2**30, 2], [2**30, 3]])
    (_, ids, scores, _), = topk.best_of_shard(np.array([9]), np.array([[2**30, 1]]), np.arange(3), weights, 2)
    assert ids.tolist() == [2, 1] and scores.tolist() == [2**60 + 3, 2**60 + 2]


def test_repeated_ids_take_one_place(spark):
    """An id with several vectors counts with its best score and takes no second place."""
    (_, ids, scores, _), = topk.best_of_shard(
        np.array([0]), np.array([[1]]), np.array([1, 2, 1, 3, 4, 5, 2]), np.array([[10], [9], [8], [7], [6], [5], [9]]), 5)
    assert ids.tolist() == [1, 2, 3, 4, 5] and scores.tolist() == [10, 9, 7, 6, 5]
    rng = np.random.default_rng(5)
    rows = [(i % 40, rng.normal(size=4).astype(np.float32).tolist()) for i in range(400)]
    table = [(i, np.floor(np.array(v, np.float32).astype(float) * 256).astype(int)) for i, v in rows]
    for block in (3, 128):
        got = sorted((r.query_id, r["rank"], r.id, r.score) for r in topk.search_top_k(frame(spark, rows), every=20, k=5, shard_rows=50, block=block).collect())
        want = []
        for q in (0, 20):
            best = {}
            for i, own in table:
                if i == q:
                    for j, other in table:
                        if j != q:
                            best[j] = max(best.get(j, -10**9), int(own @ other))
            want += [(q, n + 1, j, s) for n, (j, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5])]
        assert got == want


def test_large_components():
    """Sums beyond doubles and 63 bits on the way stay exact; what ends beyond 63 bits raises."""
    big = 2**61
    (_, ids, scores, _), = topk.best_of_shard(np.array([9]), np.array([[3, -3, 1]]), np.arange(3), np.array([[big, big, 1], [big, big, 3], [0, 0, 2]]), 3)
    assert ids.tolist() == [1, 2, 0] and scores.tolist() == [3, 2, 1]
    with pytest.raises(OverflowError):
        list(topk.best_of_shard(np.array([9]), np.array([[8]]), np.arange(1), np.array([[big]]), 3))
    with pytest.raises(OverflowError):
        topk.quantize([1e17])
    assert topk.quantize([2.0**54]).tolist() == [2**62]


def test_lattice_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 8)) * 2
    point = embed_dedup.decode_e8(x)
    own = ((x - point) ** 2).sum(axis=1)
    assert (own <= 1 + 1e-9).all()  # the covering radius is 1
    for root in embed_dedup.ROOTS:
        assert (own <= ((x - point - root) ** 2).sum(axis=1) + 1e-9).all()
    twice = np.rint(point * 2)
    assert ((twice % 2 == 0).all(axis=1) | (twice % 2 == 1).all(axis=1)).all() and (point.sum(axis=1) % 2 == 0).all()
    assert len(np.unique(embed_dedup.ROOTS, axis=0)) == 240


@pytest.mark.parametrize("block", [1024, 32])
def test_lattice_links(spark, rows, block):
    got = embed_dedup.near_duplicate_vectors(frame(spark, rows), block=block).collect()
    assert len(got) == len(rows)
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and usable(v) and any(v)}
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    links = {i: {j for j in unit if j != i and float(unit[i] @ unit[j]) >= .9} for i in unit}
    true = sum(map(len, links.values()))
    found = {r.id: r.n_links for r in got}
    assert all(found[i] <= len(links[i]) for i in links)
    assert sum(found[i] for i in links) >= .97 * true
    assert all(found[i] == 0 for i in found if i not in links)
    label = {i: i for i in unit}
    changed = True
    while changed:
        changed = False
        for i in unit:
            low = min([label[i], *(label[j] for j in links[i])])
            if low < label[i]:
                label[i], changed = low, True
    wrong = sum(r.component_id != label.get(r.id, r.id) for r in got)
    assert wrong <= .02 * len(got)
    copies = {r.component_id for r in got if r.id is not None and 500 <= r.id < 540}
    assert len(copies) == 1 and copies == {r.component_id for r in got if r.id == 7}


def test_vectors_of_unlike_length_meet_wherever_they_are_read(spark):
    rng = np.random.default_rng(11)
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [2.0]), (4, [0.0, 1.0]), (5, [0.05, 1.0, 0.0, 0.0]), (6, [0.0, 0.0, 1.0])]
    rows += [(10 + i, rng.normal(size=3 + i % 4).tolist()) for i in range(40)] + [(60, [0.0, 0.0, 0.9, 0.0])]
    answers = [sorted((r.id, r.n_links, r.component_id) for r in embed_dedup.near_duplicate_vectors(
        frame(spark, part).repartition(n)).collect()) for n in (1, 2, 7) for part in (rows, rows[::-1])]
    assert all(a == answers[0] for a in answers)
    assert {i: c for i, _, c in answers[0] if i < 10 or i == 60} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 60: 6}


def test_lattice_of_nothing(spark, rows):
    assert embed_dedup.near_duplicate_vectors(frame(spark, rows).where("false")).count() == 0
