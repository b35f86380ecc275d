import hashlib
import math
import random
from collections import Counter
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harborline.operators import lookup, metrics, quality, quantile, ranking, retrieval, skew, split, wordindex
from harborline.operators.profile import guest_profile
from harborline.sources import durable

few = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def test_salted_join_equals_plain_join(spark):
    left = [("hot", i) for i in range(300)] + [(f"k{i % 40}", i) for i in range(120)] + [(None, 1)]
    right = [("hot", "x"), ("hot", "y")] + [(f"k{i}", str(i)) for i in range(0, 40, 2)] + [(None, "n")]
    a = spark.createDataFrame(left, "k string, v int")
    b = spark.createDataFrame(right, "k string, w string")
    got = skew.salted_left_join(a, b, ["k"], ["v"]).select("k", "v", "w")
    want = a.join(b, "k", "left").select("k", "v", "w")
    assert Counter(got.collect()) == Counter(want.collect())


def test_hot_keys_are_found_and_bounded(spark):
    rows = [("hot",)] * 500 + [(f"k{i}",) for i in range(500)]
    hot = skew.hot_keys(spark.createDataFrame(rows, "k string"), ["k"]).collect()
    assert len(hot) == 1 and hot[0]._splits == 4  # half of 4 partitions, twice over


def test_stored_tables_lie_in_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert durable.shared_folder(spark) == folder
    (file,) = {f.rsplit("/", 2)[0] for f in durable.stored(spark.range(3)).inputFiles()}
    assert file.removeprefix("file:").replace("///", "/") == folder


def test_sequential_ids_follow_the_order(spark):
    rng = random.Random(1)
    rows = [
        (rng.choice("ab"), rng.choice(["x", "y", None]), rng.randrange(4), i) for i in range(200)
    ]
    df = spark.createDataFrame(rows, "a string, b string, c int, d int").repartition(7)
    got = ranking.sequential_ids(df, [["a"], ["b"], ["c"], ["d"]], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(200))
    order = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2], r[3]))
    assert [tuple(r)[:4] for r in got] == order


def test_sequential_ids_with_one_level(spark):
    df = spark.createDataFrame([("b",), ("a",)], "k string")
    got = ranking.sequential_ids(df, [["k"]], "n", start=5).collect()
    assert {r.k: r.n for r in got} == {"a": 5, "b": 6}


def test_top_k_is_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    top = ranking.top_k(df, ["k"], [F.col("id").desc()], 2)
    assert sorted(r.id for r in top.collect()) == [994, 995, 996, 997, 998, 999]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


@few
@given(st.lists(st.integers(0, 10**7), min_size=1, max_size=60))
def test_median_is_exact(spark, cents):
    df = spark.createDataFrame([(Decimal(c) / 100,) for c in cents], "v decimal(18,2)")
    got = quantile.exact_median(df, "v").first().median
    assert got == pytest.approx(float(np.median([c / 100 for c in cents])), abs=1e-9)


def test_median_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,)], "v decimal(18,2)")
    assert quantile.exact_median(df, "v").first().median is None


def test_split_takes_the_exact_share_of_every_stratum(spark):
    df = spark.range(503).select("id", (F.col("id") % 7 == 0).alias("y"))
    got = split.stratified_split(df, ["id"], F.col("y"))
    sizes = {(r.y, r.is_test): r["count"] for r in got.groupBy("y", "is_test").count().collect()}
    for label in (True, False):
        n = sizes[label, True] + sizes[label, False]
        assert sizes[label, True] == math.ceil(0.2 * n)
    again = split.stratified_split(df.repartition(9), ["id"], F.col("y"))
    assert sorted(got.collect()) == sorted(again.collect())


def test_split_cuts_inside_ranges_of_several_levels(spark, monkeypatch):
    monkeypatch.setattr(split, "HASH_DIGITS", 1)  # 16 ranges a level: 900 rows need several levels
    df = spark.range(900).select("id", F.when(F.col("id") < 800, F.lit("a")).alias("y"))
    got = {r.id for r in split.stratified_split(df, ["id"], F.col("y")).where("is_test").collect()}
    want = set()
    for ids in (range(800), range(800, 900)):
        ordered = sorted(ids, key=lambda i: hashlib.md5(f"{i}|42".encode()).hexdigest())
        want |= set(ordered[: math.ceil(0.2 * len(ordered))])
    assert got == want


def test_split_keeps_equal_keys_together(spark):
    df = spark.createDataFrame([(7,)] * 300 + [(i,) for i in range(20)], "id int")
    rows = split.stratified_split(df, ["id"]).collect()
    assert len(rows) == 320 and len({r.is_test for r in rows if r.id == 7}) == 1
    assert sum(r.is_test for r in rows) >= 64


def test_split_keeps_a_stratum_of_one_and_a_null_stratum(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b"), (4, "b")], "id int, y string")
    got = split.stratified_split(df, ["id"], F.col("y")).collect()
    assert len(got) == 4 and sum(r.is_test for r in got) == 3


@few
@given(st.lists(st.tuples(st.integers(0, 8), st.booleans()), min_size=2, max_size=50))
def test_auc_counts_pairs(spark, rows):
    df = spark.createDataFrame([(s / 8, int(y)) for s, y in rows], "s double, y int")
    got = metrics.auc_roc(df, F.col("s"), F.col("y")).first().auc_roc
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    if not pos or not neg:
        assert got is None
    else:
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert got == pytest.approx(wins / len(pos) / len(neg))


def test_auc_of_equal_scores_is_half(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 0)], "s double, y int")
    assert metrics.auc_roc(df, F.col("s"), F.col("y")).first().auc_roc == 0.5


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (4.0, 3.0)], "p double, y double")
    row = df.agg(
        metrics.mean_absolute_error(F.col("p"), F.col("y")).alias("mae"),
        metrics.r_squared(F.col("p"), F.col("y")).alias("r2"),
    ).first()
    assert row.mae == pytest.approx(2 / 3) and row.r2 == pytest.approx(1 - 2 / (2 / 3))


def test_codes_of_unknown_and_null_are_zero(spark):
    df = spark.createDataFrame([("Oceania",), ("Other",), (None,), ("None",)], "b string")
    got = [r[0] for r in df.select(lookup.code_of(F.col("b"), {"Norwegian": 0, "Oceania": 1})).collect()]
    assert got == [1, 0, 0, 0]


def test_alphabetical_codes_by_map_and_by_join(spark, monkeypatch):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3), (None, 4), ("a", 5)], "c string, i int")
    by_map = sorted(lookup.with_alphabetical_code(df, "c", "n", ["i"]).collect(), key=lambda r: r.i)
    monkeypatch.setattr(lookup, "MAX_CATEGORIES", 2)
    by_join = sorted(lookup.with_alphabetical_code(df, "c", "n", ["i"]).collect(), key=lambda r: r.i)
    assert by_map == by_join and [r.n for r in by_map] == [1, 0, 2, 0, 0]


def test_profile_mode_tie_takes_the_smallest(spark):
    rows = [("g", "B", "x", "1"), ("g", "A", "y", "2"), ("g", "A", "z", "0"), ("g", "B", "w", "3")]
    df = spark.createDataFrame(rows, "guest_id string, brand string, loyalty_tier string, booking_id string")
    row = guest_profile(df).first()
    assert (row.primary_brand, row.total_bookings, row.loyalty_tier) == ("A", 4, "w")


def test_quality_rules(spark):
    df = spark.createDataFrame(
        [("1", "Norwegian"), ("1", "Else"), (None, None), ("2", "Else")], "id string, brand string"
    )
    rules = [
        quality.Rule("m", "id", "unique"),
        quality.Rule("m", "id", "not_null"),
        quality.Rule("m", "brand", "not_null"),
        quality.Rule("m", "brand", "accepted_values", ("Norwegian",)),
    ]
    got = {(r.column, r.test): r.failures for r in quality.dq_suite({"m": df}, rules).collect()}
    assert got == {
        ("id", "unique"): 1,
        ("id", "not_null"): 1,
        ("brand", "not_null"): 1,
        ("brand", "accepted_values"): 1,
    }


def _vectors(spark, matrix, name):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} int, embedding array<float>")


def _brute(queries, corpus, k):
    out = []
    for q, u in enumerate(queries):
        sims = []
        for d, v in enumerate(corpus):
            norm = np.linalg.norm(u) * np.linalg.norm(v)
            if norm:
                sims.append((-math.floor(float(u @ v) / norm * 1e6 + 0.5) / 1e6, d))
        out += [(q, r + 1, d, -s) for r, (s, d) in enumerate(sorted(sims)[:k])]
    return out


def test_cosine_topk_with_ties_and_a_zero_vector(spark):
    rng = np.random.default_rng(3)
    corpus = rng.normal(size=(60, 8)).astype("float32").astype("float64")
    corpus[5] = corpus[9] = corpus[2]
    corpus[7] = 0
    queries = np.vstack([corpus[2], rng.normal(size=(3, 8)).astype("float32")])
    got = retrieval.cosine_topk(
        _vectors(spark, queries, "query_id"), _vectors(spark, corpus, "doc_id").repartition(5), 4
    )
    assert [tuple(r) for r in got.orderBy("query_id", "rank").collect()] == _brute(queries, corpus, 4)


def test_many_queries_meet_the_corpus_in_a_grid(spark, monkeypatch):
    rng = np.random.default_rng(4)
    corpus = rng.normal(size=(30, 4)).astype("float32").astype("float64")
    queries = rng.normal(size=(25, 4)).astype("float32").astype("float64")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 8)
    frame = _vectors(spark, queries, "query_id")
    got = retrieval.cosine_topk(frame, _vectors(spark, corpus, "doc_id"), 3)
    assert [tuple(r) for r in got.orderBy("query_id", "rank").collect()] == _brute(queries, corpus, 3)


def test_lsh_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    corpus = np.repeat(centres, 40, axis=0) + 0.3 * rng.normal(size=(240, 16))
    q, c = _vectors(spark, centres, "query_id"), _vectors(spark, corpus, "doc_id")
    exact = {(r.query_id, r.doc_id) for r in retrieval.cosine_topk(q, c).collect()}
    near = {(r.query_id, r.doc_id) for r in retrieval.lsh_topk(q, c).collect()}
    assert len(exact & near) / len(exact) >= 0.8


def test_tfidf_against_brute_force(spark):
    docs = [
        "Alaska cabins were cheap",
        "Alaska alaska ALASKA price",
        "Europe price list, price list",
        "nothing in common",
        "",
        "Alaska cabins were cheap",
    ]
    questions = ["alaska price", "cheap cabins?", "unseen words"]
    corpus = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    asked = spark.createDataFrame(list(enumerate(questions)), "query_id int, text string")
    got = wordindex.tfidf_topk(asked, wordindex.build_word_index(corpus), 3)

    def tokens(t):
        return "".join(ch if ch.isalnum() else " " for ch in t.lower()).split()

    n = len(docs)
    df = Counter(w for d in docs for w in set(tokens(d)))

    def vector(t):
        v = {w: c * (math.log((n + 1) / (df[w] + 1)) + 1) for w, c in Counter(tokens(t)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    want = []
    for i, q in enumerate(questions):
        qv = vector(q)
        sims = []
        for j, d in enumerate(docs):
            dv = vector(d) if d else {}
            if set(qv) & set(dv):
                sims.append((-round(sum(x * dv.get(w, 0) for w, x in qv.items()), 6), j))
        want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(sims)[:3])]
    assert [tuple(r) for r in got.orderBy("query_id", "rank").collect()] == want


def test_latest_tier_of_ids_of_different_length(spark):
    rows = [("G", "BK9999999", "B", "Gold"), ("G", "BK10000000", "B", "Silver")]
    frame = spark.createDataFrame(rows, "guest_id string, booking_id string, brand string, loyalty_tier string")
    assert guest_profile(frame).first().loyalty_tier == "Silver"


def test_small_errors_count(spark):
    frame = spark.createDataFrame([(1.0, 1.0 + 2e-7), (1.0, 1.0)], "p double, y double")
    got = frame.agg(metrics.mean_absolute_error(F.col("p"), F.col("y")).alias("m")).first().m
    assert abs(got - 1e-7) < 1e-12


def test_words_are_told_apart_whatever_their_hash(spark):
    """Of 20,000 words many share a short hash; each finds its own document."""
    corpus = spark.range(200).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", F.transform(F.sequence(F.col("id") * 100, F.col("id") * 100 + 99), lambda i: F.concat(F.lit("w"), i))).alias("text"),
    )
    asked = spark.createDataFrame([(i, f"w{i * 977}") for i in range(20)], "query_id long, text string")
    got = wordindex.tfidf_topk(asked, wordindex.build_word_index(corpus), 3).collect()
    assert sorted((r.query_id, r.doc_id) for r in got) == [(i, i * 977 // 100) for i in range(20)]


def test_lsh_index_narrows_as_the_corpus_grows(spark):
    rng = np.random.default_rng(6)
    shares = []
    for n in (300, 4000):
        corpus = _vectors(spark, rng.normal(size=(n, 16)), "doc_id")
        asked = _vectors(spark, rng.normal(size=(5, 16)), "query_id")
        found = retrieval.lsh_candidates(asked, retrieval.build_sign_index(corpus, likely=0.85))
        shares.append(found.count() / (5 * n))
    assert shares[1] < shares[0] < 0.8


def test_median_with_an_outlier_and_odd_values(spark):
    rng = random.Random(1)
    for values in (
        [rng.random() for _ in range(501)] + [1e12],
        [5.0] * 40 + [-1e300, 1e300],
        [2.0, 2.0 + 1e-15, 1e9, -1e9, 0.0],
    ):
        got = quantile.exact_median(spark.createDataFrame([(v,) for v in values], "v double"), "v").first().median
        ordered = sorted(values)
        want = (ordered[(len(values) - 1) // 2] + ordered[len(values) // 2]) / 2
        assert got == want


def test_auc_of_scores_outside_the_unit_interval(spark):
    rng = random.Random(2)
    rows = [(rng.choice([-5.0, -4.5, 3.0, 1e6 + rng.random()]), rng.randint(0, 1)) for _ in range(300)]
    got = metrics.auc_roc(spark.createDataFrame(rows, "s double, y int"), F.col("s"), F.col("y")).first().auc_roc
    pos, neg = ([s for s, y in rows if y == k] for k in (1, 0))
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    assert abs(got - wins / (len(pos) * len(neg))) < 1e-12


def test_codes_of_many_values_with_one_prefix(spark):
    values = spark.range(20_000).select(F.concat(F.lit("STANDARD "), F.hex(F.xxhash64("id"))).alias("c"))
    got = [(r.c, r.code) for r in lookup.alphabetical_codes(values, "c").collect()]
    assert sorted(got) == [(c, i) for i, c in enumerate(sorted(c for c, _ in got))]
    ranges = ranking.in_ranges(values.distinct(), "c").groupBy("_range").count().agg(F.max("count")).first()[0]
    assert ranges < 20_000


def test_a_small_share_is_split_among_many_partitions(spark):
    """0.05 % of the rows is more than one of 5,000 partitions should get."""
    rows = spark.range(200_000).select(F.when(F.col("id") < 100, -1).otherwise(F.col("id")).alias("k"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5000")
    try:
        listed = skew.hot_keys(rows.coalesce(2), ["k"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r._splits for r in listed] == [5]
