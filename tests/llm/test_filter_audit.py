import random
import re
from collections import Counter
from itertools import permutations

import pytest
from harborline.llm import filteraudit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int, text string"


def _fails(rows, i, text):
    t = text or ""
    ws = WORD.findall(t)
    first = min((j for j, u, _ in rows if j is not None and (u or "") == t), default=None)
    found = {
        "A": len(ws) < 200,
        "B": 100 * len(set(ws)) < 50 * len(ws),
        "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
        "D": bool(re.search(r"[#$%&*|]", t)),
        "E": i is not None and i > first,
    }
    return {x for x, failed in found.items() if failed}


def replayed(rows, labels):
    """Every order applied document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    want = {}
    for part in {p or "" for _, _, p in rows}:
        inside = [(i, _fails(rows, i, t)) for i, t, p in rows if (p or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = list(range(len(inside)))
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in inside[d][1]]
                stay = [d for d in left if x not in inside[d][1]]
                failing = [d for d in range(len(inside)) if x in inside[d][1]]
                alone = [d for d in failing if inside[d][1] == {x}]
                shapley[x] += len(gone)
                want[part, "".join(order), step] = [
                    len(stay), len(gone), len(failing) - len(gone), len(alone),
                    sum(inside[d][0] in good for d in gone), sum(inside[d][0] in toxic for d in gone),
                ]
                left = stay
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                want[part, "".join(order), step].append(shapley[x])
    return want


def _check(spark, rows, labels):
    docs = spark.createDataFrame(
        [(i, t, p, "s", -1, 7) for i, t, p in rows],
        "doc_id long, text string, lang string, mask string, n int, part int",
    )
    marked = spark.createDataFrame([(i, q, x, "t") for i, q, x in labels], LABELS)
    got = filteraudit.audit(docs, marked).collect()
    columns = [*filteraudit.COUNTED, "shapley"]
    found = {(r.part, r.filter_order, r.step): [r[c] for c in columns] for r in got}
    assert len(found) == len(got)
    assert found == replayed(rows, labels)


def test_intervals_cover_every_order_once():
    for n in (1, 3, 4):
        orders = list(permutations(range(n)))
        found = {}
        for mask, step, lo, hi, what in filteraudit.step_intervals(n):
            for r in range(lo, hi):
                assert (mask, step, r) not in found
                found[mask, step, r] = what
        for mask in range(1 << n):
            for r, order in enumerate(orders):
                gone = next((s for s, x in enumerate(order, 1) if mask >> x & 1), n + 1)
                for step in range(1, n + 1):
                    fails = mask >> order[step - 1] & 1
                    want = "kept" if step < gone else "removed" if step == gone else "redundant" if fails else None
                    assert found.get((mask, step, r)) == want


def test_replayed_orders(spark, vocabulary):
    rng = random.Random(4)
    texts = []
    for _ in range(25):
        ws = rng.choices(vocabulary[: rng.choice([20, 900])], k=rng.choice([5, 150, 230, 500]))
        ws += rng.choice([[], ["#"], ["LOUD" * 40]])
        texts.append(" ".join(ws))
    rows = [(i, rng.choice(texts), rng.choice(["en", "de"])) for i in range(60)]
    rows += [(100 + i, texts[0], "en") for i in range(30)]  # a third of all rows are one text
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 130, 2)]
    _check(spark, rows, labels)


def test_odd_rows(spark, odd_rows):
    rows = [(i, t, s) for i, t, s in odd_rows]
    rows += [(None, rows[3][1], "a"), (None, rows[3][1], None), (20, "", "b"), (20, "other", "b"), (-9, None, "")]
    labels = [(0, 1, 0), (4, 1, 1), (4, 0, 1), (6, None, 1), (None, 1, 1), (20, 1, None), (77, 1, 1)]
    _check(spark, rows, labels)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], LABELS)
    assert filteraudit.audit(none, labels).count() == 0
    _check(spark, [(1, "x", "en")], [])


def test_own_filters(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "bb", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], LABELS)
    got = filteraudit.audit(docs, labels, {"A": lambda f: f["n_chars"] < 2}).collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in got} == {
        ("AE", 1): (1, 2, 0, 1, 3), ("AE", 2): (1, 0, 1, 0, 1),
        ("EA", 1): (2, 1, 0, 0, 1), ("EA", 2): (1, 1, 1, 1, 3),
    }
    with pytest.raises(ValueError):
        filteraudit.audit(docs, labels, {"F": lambda f: f["n_chars"] < 2})
