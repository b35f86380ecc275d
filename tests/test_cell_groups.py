import numpy as np
from pyspark.sql import functions as F

from harborline.operators import cells
from harborline.sources.durable import stored


def test_best_coded_equals_one_query_at_a_time():
    rng = np.random.default_rng(3)
    cell = np.sort(rng.integers(0, 12, 400))
    rows, queries = rng.normal(size=(400, 8)), rng.normal(size=(90, 8))
    rows[200:230] = rows[200]  # equal rows in one cell, and in others
    ids = rng.permutation(400)
    probed = [rng.choice(14, 1 + i % 5, replace=False) for i in range(90)]  # cells 12 and 13 have no rows
    found = {i: (ids[at], near) for i, at, near in cells._best_coded(queries, probed, rows, cell, ids, 20)}
    for i, q in enumerate(queries):
        own = np.flatnonzero(np.isin(cell, probed[i]))
        best = sorted(zip(-np.round(rows[own] @ q, 9), ids[own]))[:20]
        got = found.get(i, (np.array([]), np.array([])))
        assert got[0].tolist() == [d for _, d in best]
        assert np.allclose(got[1], [-n for n, _ in best], atol=1e-8)


def test_shortlists_are_the_same_however_rows_meet(spark, monkeypatch):
    """Any number of groups and parts gives one shortlist, and a task sends on no more than that of each query."""
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(3000, 12)))]
    corpus = stored(spark.createDataFrame(vectors, "doc_id long, embedding array<double>"))
    asked = cells._asked(corpus.where("doc_id % 25 = 0").withColumnRenamed("doc_id", "query_id"))
    index = cells.replace(cells.build_cell_index(corpus), shortlist=30)
    list_of = lambda: sorted(map(tuple, cells.shortlisted(asked, index).collect()))
    sent, top_k = [], cells.top_k
    monkeypatch.setattr(cells, "top_k", lambda df, *a: top_k(sent.append(stored(df)) or sent[-1], *a))
    whole = list_of()
    assert len(whole) == 120 * 30 == len({(q, d) for q, _, _, d in whole})
    assert sent[-1].count() == 120 * 30  # one group of queries, one part: no pair beyond the shortlists
    monkeypatch.setattr(cells, "GROUP_QUERIES", 16)
    monkeypatch.setattr(cells, "GROUP_ROWS", 700)
    assert list_of() == whole
    assert sent[-1].groupBy("query_id", "slice").count().agg(F.max("count")).first()[0] <= 30 * 5
