import random
import re

import pytest

from harborline.llm import neardup
from harborline.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def _brute(rows):
    """Smallest id reachable over links, by comparing all pairs."""
    rows = [(i, _set(t)) for i, t, _ in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (a, x) in enumerate(rows):
        for b, y in rows[:n]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in rows}


def _edited(rng, words, share, vocabulary):
    return [rng.choice(vocabulary) if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def family(vocabulary):
    """Groups of copies at growing distances, chains, and a passage that unrelated texts share."""
    rng = random.Random(11)
    rows, i = [], 0
    passage = rng.choices(vocabulary, k=30)
    for group in range(25):
        base = rng.choices(vocabulary, k=rng.randint(40, 160))
        for _ in range(rng.randint(1, 9)):
            rows.append((i, " ".join(_edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06]), vocabulary)), "s"))
            i += 1
    for _ in range(60):
        rows.append((i, " ".join(rng.choices(vocabulary, k=60) + passage), "s"))
        i += 1
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(make_docs, family):
    got = {r.doc_id: r for r in neardup.near_duplicates(make_docs(family)).collect()}
    for i, (n, component) in _brute(family).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, component, i == component)


def test_large_groups_are_compared_in_cells(make_docs, vocabulary, monkeypatch):
    """With cells of 8 texts a group of near copies takes the way of large groups, exactly."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rng = random.Random(4)
    base = rng.choices(vocabulary, k=120)
    rows = [(i, " ".join(_edited(rng, base, 0.01 + 0.05 * rng.random(), vocabulary)), "s") for i in range(70)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(make_docs(rows)).collect()}
    assert got == {i: c for i, (_, c) in _brute(rows).items()}


def test_odd_rows(make_docs, odd_rows):
    rows = [*odd_rows, (20, "One", "s"), (21, "one two three four", "s"), (22, "ONE two\tthree four", "s")]
    got = neardup.near_duplicates(make_docs(rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].n_shingles == 0 and by[i].kept for i in (0, 1, 2))
    assert by[4].component_id == 3 and not by[4].kept
    assert by[20].component_id == 5 and by[22].component_id == 21
    assert sum(r.doc_id == 6 and r.kept for r in got) == 2
    assert by[None].component_id is None
    kept = neardup.keep_one_of_each(make_docs(rows))
    assert kept.columns == make_docs(rows).columns
    assert kept.count() == sum(r.kept for r in got)


def test_empty(make_docs):
    assert neardup.near_duplicates(make_docs([])).count() == 0


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (10, 9), (8, 8), (7, 7)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8, 10: 8} | {100 + i: 100 for i in range(41)}


def test_parts_of_a_batch_hash_like_the_whole(vocabulary):
    import numpy as np
    import pyarrow as pa

    from harborline.llm.wordhash import text_slices, word_hashes

    rng = random.Random(2)
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))).title() for _ in range(300)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    whole, _ = word_hashes(batch.column("text"))
    parts = list(text_slices(batch.slice(0), 1000))
    assert len(parts) > 10
    assert np.array_equal(whole, np.concatenate([word_hashes(p.column("text"))[0] for p in parts]))


def test_circulant_signature_estimates_jaccard(vocabulary):
    import numpy as np

    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64) for n in (600, 200, 200))
    flat = np.concatenate([np.sort(np.concatenate([common, x])) for x in (a, b)])
    signed = neardup.signatures(flat, np.array([0, 800]), 1024)
    assert abs((signed[0] == signed[1]).mean() - 0.6) < 0.05
