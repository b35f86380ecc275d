import numpy as np
import pytest

from harborline.operators import retrieval


@pytest.mark.parametrize("n", [1, 500, 262_144, 4_200_000, 67_000_000, 10**10])
@pytest.mark.parametrize("likely", [0.6, 0.85])
def test_the_chance_of_a_miss_holds_for_any_corpus(n, likely):
    bits, tables = retrieval.sign_tables(n, 64, likely, 0.02)
    same = (1 - np.arccos(likely) / np.pi) ** bits
    assert (1 - same) ** tables <= 0.02 and bits >= 1 and tables <= retrieval.MOST_TABLES


def test_a_query_short_of_candidates_is_answered_exactly(spark):
    rng = np.random.default_rng(4)
    frame = lambda rows, name: spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(rows)], f"{name} long, embedding array<float>"
    )
    corpus = rng.normal(size=(300, 8))
    asked = np.vstack([corpus[:2], -10 * corpus.mean(axis=0), np.zeros(8)])
    q, c = frame(asked, "query_id"), frame(corpus, "doc_id")
    keys = retrieval.build_sign_index(c, in_bucket=1, likely=0.99, missed=0.5)
    short = retrieval.lsh_candidates(q, keys).groupBy("query_id").count().where("count < 6")
    assert short.count() > 0
    got = retrieval.lsh_topk(q, c, index=keys).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {0: 6, 1: 6, 2: 6}
