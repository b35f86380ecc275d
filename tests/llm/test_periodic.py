import hashlib
import random
import re
import zlib

import pyarrow as pa
from harborline.llm import periodic
from harborline.llm.queries import looped, op13_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(ws):
    """All maximal stretches, period by period; the smallest period of a stretch counts."""
    n, smallest = len(ws), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ws[j] == ws[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                smallest.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b - a, q) for (a, b), q in smallest.items())


def collapsed(ws, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def planted(rng, n, kinds):
    ws = [str(rng.randint(0, kinds)) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 10:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // rng.randint(2, 9)))
            for i in range(a, min(n, a + p * rng.randint(3, 8) + rng.randint(0, p))):
                ws[i] = ws[a + (i - a) % p]
    return ws


def test_runs_equal_brute_force():
    rng = random.Random(2)
    found = 0
    for _ in range(120):
        texts = [planted(rng, rng.choice([0, 1, 6, 30, 200, 900]), rng.choice([1, 2, 4, 50])) for _ in range(5)]
        runs, short = periodic._text_runs(pa.array([" ".join(t) for t in texts]))
        for ws, got, text in zip(texts, runs, short.to_pylist()):
            want = brute_runs(ws)
            assert got == want
            assert text == collapsed(ws, want)
            found += len([r for r in want if r[2] > periodic.LAGS])
    assert found > 50


def test_periods_around_every_scale():
    rng = random.Random(3)
    for q in (1, 2, 15, 16, 17, 31, 32, 33, 63, 64, 65, 128, 129, 257):
        for extra in (-1, 0, 1, q):
            part = [f"{rng.random()}" for _ in range(q)]
            n = max(6, 4 * q) + extra
            ws = ["a", "b"] + [part[i % q] for i in range(n)] + ["c", "a"]
            runs, _ = periodic._text_runs(pa.array([" ".join(ws)]))
            assert runs == [brute_runs(ws)]
            assert (len(runs[0]) > 0) == (extra >= 0)


def test_minimizers_are_window_minima():
    import numpy as np

    rng = np.random.default_rng(1)
    for width in (1, 2, 8):
        values = rng.integers(1, 30, 60).astype(np.uint64)
        want = set()
        for i in range(len(values) - width + 1):
            window = values[i : i + width]
            want |= {i + j for j in np.flatnonzero(window == window.min())}
        assert set(periodic.minimizers(values, width).tolist()) == want


def contract_row(doc_id, text):
    ws = WORD.findall(text or "")
    n, h = len(ws), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(ws)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
        sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(collapsed(ws, runs)),
    )


def test_query_equals_brute_force(spark, make_docs, odd_rows, vocabulary, tmp_path):
    rng = random.Random(6)
    rows = [r for r in odd_rows if r[0] is not None and len(r[1] or "") < 30_000]
    for i in range(20, 320):
        rows.append((i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 9, 60, 300]))), "s"))
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((contract_row(i, t) for i, t, _ in rows), key=str)
    edited = sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows)
    assert edited > 20 and sum(r[1] > 0 for r in got) > 5


def test_odd_rows(make_docs, odd_rows):
    got = periodic.periodic_runs(make_docs(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    want = []
    for i, t, _ in odd_rows:
        ws = WORD.findall(t or "")
        runs = brute_runs(ws) if len(ws) < 2000 or len(set(ws)) < 10 else []
        want.append((str(i), str(runs), collapsed(ws, runs)))
    assert sorted((str(r.doc_id), str([tuple(x) for x in r.runs]), r.collapsed) for r in got) == sorted(want)


def test_empty_table_and_null_ids(make_docs):
    assert periodic.periodic_runs(make_docs([])).count() == 0
    assert looped(make_docs([(None, "a b", "s")])).collect()[0].text == "a b"
