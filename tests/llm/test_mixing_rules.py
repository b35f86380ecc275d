import random
import re
from collections import Counter, defaultdict

from harborline.llm import hostrules, mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        level = left / open_ if open_ else 0
        over = {s for s in order if s not in full and level * weight[s] > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else level * weight[s] for s in order}
        full |= over


def _check(rows, got):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = _targets(sizes)
    taken = defaultdict(int)
    by_id = defaultdict(list)
    for i, t, s in rows:
        by_id[i].append((len(WORD.findall(t or "")), s))
    assert len(got) == len(rows)
    for r in got:
        size, s = next(x for x in by_id[r.doc_id] if x[0] == r.size)
        assert r.source_size == sizes[s]
        assert abs(r.target - want[s]) < 1e-6 * (1 + want[s])
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] += r.taken
    for s, t in want.items():
        largest = max([x[0] for v in by_id.values() for x in v if x[1] == s], default=0)
        assert abs(taken[s] - t) <= largest + 1, s


def test_mix_meets_targets(make_docs):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(1, 60), f"s{rng.randint(0, 6)}") for i in range(400)]
    rows += [(1000 + i, "w " * 5, "tiny") for i in range(3)]
    got = mixing.mix(make_docs(rows)).collect()
    _check(rows, got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(make_docs(rows)).collect()))


def test_empty_documents_are_copied_as_often_as_the_others(make_docs):
    rows = [(i, "" if i % 2 else "w " * 9, "tiny") for i in range(40)]
    rows += [(100 + i, "w " * 900, "vast") for i in range(40)]
    taken = Counter(r.doc_id for r in mixing.mixed_rows(make_docs(rows)).collect())
    assert max(taken.values()) == mixing.MOST_COPIES


def test_mix_odd_rows(make_docs, odd_rows):
    got = mixing.mix(make_docs(odd_rows)).collect()
    _check(odd_rows, got)
    repeated = [r.taken for r in got if r.doc_id == 6]
    assert len(repeated) == 2 and len(set(repeated)) == 1


def test_mixed_rows_follow_the_plan(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    times = Counter((r.doc_id, r.text) for r in out.collect())
    plan = {(r.doc_id, r.size): r.taken for r in mixing.mix(docs).collect()}
    for (i, text), n in times.items():
        size = len(WORD.findall(text or ""))
        assert size == 0 or plan[i, size] * (2 if i == 6 else 1) == n * size


def test_mix_empty(make_docs):
    assert mixing.mix(make_docs([])).count() == 0
    assert mixing.mixed_rows(make_docs([])).count() == 0


def _counts(text):
    t = text or ""
    w = WORD.findall(t)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)),
        len(lines) - len(set(lines)), len(covered),
    )


def test_rules_count_like_brute_force(make_docs, odd_rows):
    rows = [*odd_rows, (50, "a | b <c>\n" * 30 + "$$ #", "q"), (51, "x y x y x y z", "q")]
    got = hostrules.judge(make_docs(rows)).collect()
    want = sorted((str(i), *_counts(t)) for i, t, _ in rows)
    seen = sorted(
        (str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got
    )
    assert seen == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_a_bad_host_is_held_to_every_rule(make_docs, vocabulary):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    marked = lambda: " ".join(w + " |" for w in rng.choices(vocabulary, k=60))
    rows = [(i, marked() if i % 10 else text(80), "bad") for i in range(60)]
    rows += [(100 + i, text(80), f"good{i % 5}") for i in range(100)] + [(300, marked(), "good1")]
    kept = {r.doc_id: r.kept for r in hostrules.judge(make_docs(rows)).collect()}
    assert not any(kept[i] for i in range(60) if i % 10)  # the host fails the rule, so they go
    assert all(kept[i] for i in range(0, 60, 10))  # clean documents of that host stay
    assert kept[300] and all(kept[100 + i] for i in range(100))
    out = hostrules.keep_good(make_docs(rows))
    assert {r.doc_id for r in out.collect()} == {i for i, k in kept.items() if k}
    assert out.columns == make_docs(rows).columns


def test_equal_hosts_and_a_single_host_fail_no_rule(make_docs, vocabulary):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choices(vocabulary, k=n))
    marked = lambda: " ".join(w + " |" for w in rng.choices(vocabulary, k=60))
    rows = [(10 * h + i, marked() if i < 3 else text(80), f"h{h}") for h in range(6) for i in range(10)]
    assert all(r.kept for r in hostrules.judge(make_docs(rows)).collect())
    alone = [(i, marked() if i % 2 else text(80), None) for i in range(20)]
    assert all(r.kept for r in hostrules.judge(make_docs(alone)).collect())


def test_distance_from_the_mean_like_brute_force(spark):
    hosts = {"a": (400, 40), "b": (900, 18), "c": (50, 0), "d": (7, 7)}
    rows = [(h, i < f) for h, (n, f) in hosts.items() for i in range(n)]
    rated = hostrules.host_rates(spark.createDataFrame(rows, "host string, fails_x boolean")).collect()
    total = sum(n for n, _ in hosts.values())
    mean = sum(f for _, f in hosts.values()) / total
    spread = sum(f * f / n for n, f in hosts.values()) / total - mean**2
    weight = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6)
    for r in rated:
        n, f = hosts[r.host]
        rate = (f + mean * weight) / (n + weight)
        deviation = (rate * (1 - rate) / (n + weight + 1)) ** 0.5
        assert abs(r.rate_x - rate) < 1e-12 and abs(r.above_x - (rate - mean) / deviation) < 1e-9


def test_small_hosts_are_shrunk_to_the_mean(spark):
    rows = [("big", i < 30) for i in range(1000)] + [("other", i < 60) for i in range(1000)] + [("one", True)]
    rates = {
        r.host: r.rate_x
        for r in hostrules.host_rates(spark.createDataFrame(rows, "host string, fails_x boolean")).collect()
    }
    assert rates["one"] < 0.5 and abs(rates["big"] - 0.03) < 0.01


def test_rules_empty(make_docs):
    assert hostrules.judge(make_docs([])).count() == 0
