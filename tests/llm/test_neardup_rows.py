import random
from collections import Counter

from harborline.llm import neardup


def test_rows_are_kept_by_their_own_text_whatever_their_id(make_docs, vocabulary):
    rng = random.Random(8)
    text = lambda: " ".join(rng.choices(vocabulary, k=60))
    named, lone, twice, near, other = text(), text(), text(), text(), text()
    rows = [(1, named, "s"), (None, named, "copy"), (None, lone, "clean")]
    rows += [(None, twice, "twice"), (None, twice, "twice")]
    rows += [(None, near + " end", "near"), (None, near, "near")]
    rows += [(2, other, "s"), (3, other, "copy"), (3, text(), "clean"), (None, None, "null"), (None, "", "empty")]
    kept = Counter(r.source for r in neardup.keep_one_of_each(make_docs(rows)).collect())
    assert kept == {"s": 2, "clean": 2, "twice": 1, "near": 1, "null": 1, "empty": 1}
    got = neardup.near_duplicates(make_docs(rows)).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == sum(kept.values())
    assert Counter(r.component_id for r in got if r.doc_id is None) == {1: 1, None: 7}
    assert {r.component_id for r in got if r.doc_id == 3} == {2, 3}


def test_texts_of_one_id_link_by_themselves(make_docs, vocabulary):
    rng = random.Random(9)
    a, b = (rng.choices(vocabulary, k=80) for _ in range(2))
    join = " ".join
    rows = [(5, join(a), "s"), (5, join(b), "s"), (6, join([*a, "x"]), "s"), (7, join([*b, "y"]), "s"), (4, join(["z", *b]), "s")]
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(make_docs(rows)).collect()}
    assert got == {(5, 5, True), (5, 4, False), (6, 5, False), (7, 4, False), (4, 4, True)}
