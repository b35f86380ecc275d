import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from harborline.operators import cells, retrieval, wordindex
from harborline.sources.durable import stored
from pyspark.sql import functions as F


def _vectors(spark, array, name, first=0):
    rows = [(first + i, None if v is None else [float(x) for x in v]) for i, v in enumerate(array)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grid_of_twenty_thousand_queries(spark):
    rng = np.random.default_rng(1)
    corpus, asked = rng.normal(size=(1500, 6)), rng.normal(size=(20_000, 6))
    held = _vectors(spark, corpus, "doc_id")
    got = retrieval.grid_topk(_vectors(spark, asked, "query_id"), held, 2, block=6000, part=400)
    plan = _plan(got)
    assert plan.count("FlatMapCoGroupsInPandas") == 1 and "Union" not in plan
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cosine = np.floor(unit(asked) @ unit(corpus).T * 1e6 + 0.5) / 1e6
    best = np.lexsort((np.broadcast_to(np.arange(1500), cosine.shape), -cosine), axis=1)[:, :2]
    found = {(r.query_id, r["rank"]): r.doc_id for r in got.collect()}
    assert found == {(i, j + 1): int(best[i, j]) for i in range(20_000) for j in range(2)}


def test_grid_with_odd_rows(spark):
    asked = _vectors(spark, [[1, 0], None, [0, 0], [0, 1]], "query_id")
    held = _vectors(spark, [[2, 0], [0, 0], None, [1, 1], [2, 0]], "doc_id")
    got = retrieval.grid_topk(asked, held, 2, block=1, part=1)
    assert sorted(map(tuple, got.collect())) == [
        (0, 1, 0, 1.0), (0, 2, 4, 1.0), (3, 1, 3, 0.707107), (3, 2, 0, 0.0),
    ]
    assert retrieval.grid_topk(asked, held.limit(0), 2).count() == 0
    assert retrieval.grid_topk(asked.limit(0), held, 2).count() == 0


def _clustered(n, kinds, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(kinds, 16))
    return middle[rng.integers(0, kinds, n)] + 0.25 * rng.normal(size=(n, 16))


def test_cells_find_neighbours_in_a_falling_share(spark, capsys):
    shares = []
    for n in (1000, 8000):
        corpus = _vectors(spark, _clustered(n, 60, 2), "doc_id")
        asked = corpus.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
        index = cells.build_cell_index(corpus)
        exact = {(r.query_id, r.doc_id) for r in retrieval.cosine_topk(asked, corpus).collect()}
        near = {(r.query_id, r.doc_id) for r in cells.ivf_topk(asked, corpus, index=index).collect()}
        assert len(exact & near) >= 0.9 * len(exact)
        assert index.vectors.count() == n  # every row is indexed
        assert index.sizes.agg(F.sum("n")).first()[0] == n
        shares.append(cells.candidate_share(asked, index))
    with capsys.disabled():
        print(f"\nshare of pairs whose codes are read: {shares}")
    assert shares[1] < shares[0] < 0.3


def test_cells_with_copies_and_odd_rows(spark):
    copies = np.repeat(np.ones((1, 8)), 2500, axis=0)
    others = np.random.default_rng(3).normal(size=(1200, 8))
    rows = [*copies, *others, None, np.zeros(8)]
    corpus = _vectors(spark, rows, "doc_id")
    index = cells.build_cell_index(corpus, k=3)
    largest = index.sizes.orderBy(F.desc("n")).first()
    assert largest.n >= 2500 and largest.blocks >= 3  # copies lie in one cell, not in one block
    assert index.blocks.select(F.max(F.size("ids"))).first()[0] < 2 * cells.BLOCK_ROWS
    asked = _vectors(spark, [np.ones(8), others[5], None, np.zeros(8)], "query_id")
    got = cells.ivf_topk(asked, corpus, 3, index).collect()
    assert Counter(r.query_id for r in got) == {0: 3, 1: 3}
    assert {r.similarity for r in got if r.query_id == 0} == {1.0}
    assert max((r.similarity, r.doc_id) for r in got if r.query_id == 1) == (1.0, 2505)


def test_cells_of_tiny_and_empty_corpora(spark):
    asked = _vectors(spark, [[1.0, 0.0]], "query_id")
    few = _vectors(spark, [[1.0, 0.1], [0.0, 1.0]], "doc_id")
    assert [(r.doc_id, r["rank"]) for r in cells.ivf_topk(asked, few, 6).collect()] == [(0, 1), (1, 2)]
    assert cells.ivf_topk(asked, few.limit(0), 6).count() == 0


def test_centers_move_though_some_tasks_have_no_rows(spark):
    sample = spark.createDataFrame([([0.8, 0.6],)], "unit array<double>").repartition(5)
    moved = cells._refined(sample, np.eye(2))
    assert moved.tolist() == [[0.8, 0.6], [0.0, 1.0]]


def _tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def _brute_tfidf(corpus, asked, k):
    n = len(corpus)
    df = Counter(w for _, t in corpus for w in set(_tokens(t)))

    def vector(text):
        raw = {w: c * (math.log((n + 1) / (df[w] + 1)) + 1) for w, c in Counter(_tokens(text)).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / norm for w, x in raw.items()}

    docs, want = [(i, vector(t)) for i, t in corpus if _tokens(t)], {}
    for q, text in asked:
        mine = vector(text) if _tokens(text) else {}
        scored = [(-round(sum(x * d.get(w, 0) for w, x in mine.items()), 6), i) for i, d in docs if mine.keys() & d.keys()]
        want[q] = sorted(scored)[:k]
    return want


def _check_words(spark, corpus, asked, k=4, **own):
    held = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    questions = spark.createDataFrame(asked, "query_id long, text string")
    index = wordindex.build_word_index(held, **own)
    got = defaultdict(list)
    for r in wordindex.tfidf_topk(questions, index, k).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-r.similarity, r.doc_id))
    for q, want in _brute_tfidf(corpus, asked, k).items():
        assert [i for _, i in got[q]] == [i for _, i in want], q
        assert [s for s, _ in got[q]] == pytest.approx([s for s, _ in want], abs=1.1e-6)
    return index, questions


def _zipf(rng, n):
    return " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(n))


def test_index_equals_brute_force(spark):
    rng = random.Random(5)
    corpus = [(i, _zipf(rng, rng.randint(1, 60))) for i in range(600)]
    corpus += [(1000, None), (1001, ""), (1002, " .,"), (1003, corpus[3][1]), (1004, "w1 " * 3000)]
    asked = [(i, _zipf(rng, rng.randint(1, 9))) for i in range(40)] + [(90, ""), (91, "nothing known"), (92, None)]
    for size in (200, 65_536):
        index, _ = _check_words(spark, corpus, asked, group_postings=size)
    assert index.groups.count() <= 3


def test_index_reads_only_asked_words_and_prunes_groups(spark):
    rng = random.Random(6)
    corpus = [(i, f"common shared text{i % 17} {'rare' if i % 211 == 0 else 'plain'} w{rng.randint(0, 99)}") for i in range(3000)]
    asked = [(0, "rare common"), (1, "rare text3")]
    index, questions = _check_words(spark, corpus, asked, k=3, slices=64, group_postings=256)
    words = stored(wordindex.asked_words(index, questions).where("idf IS NOT NULL").drop("idf"))
    bounds = wordindex.upper_bounds(index, words)
    plan = _plan(bounds)
    assert "dynamicpruning" in plan and " IN (" not in plan and "rare" not in plan
    pairs = wordindex.groups_to_score(index, words, bounds, 3)
    assert pairs.count() < 0.5 * bounds.count()


def test_index_of_an_empty_corpus(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert wordindex.tfidf_topk(asked, wordindex.build_word_index(none), 3).count() == 0


def test_lists_hold_counts_not_weights(spark):
    """A posting takes 4 bytes, and 8 where a word stands 65,536 times or more in a text."""
    corpus = [(i, f"common w{i % 7} w{i}") for i in range(200)]
    index, _ = _check_words(spark, corpus, [(0, "common w3"), (1, "w150 w3")], slices=8)
    got = index.postings.agg(F.sum(F.octet_length("list")).alias("n")).first().n
    assert got == 4 * sum(len(set(text.split())) for _, text in corpus)
    corpus.append((900, "w3 " * 70_000 + "common w5"))
    _check_words(spark, corpus, [(0, "common w3"), (1, "w3 w5")], slices=8)
