import hashlib
import random
import re


from harborline.llm import pii
from harborline.sources.durable import stored

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(d):
    s = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 * (x > 9) for x in s) % 10 == 0


def _spans(text):
    t, d = text or "", lambda m: re.sub("[^0-9]", "", m[0])
    kinds = {
        "email": list(EMAIL.finditer(t)),
        "ip": [m for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m for m in CARD.finditer(t) if 13 <= len(d(m)) <= 19 and _luhn(d(m))],
        "phone": [m for m in PHONE.finditer(t) if 9 <= len(d(m)) <= 15],
    }
    return {k: [f"{k}:{m.start()}:{m.end()}" for m in v] for k, v in kinds.items()}


def _random_texts(n):
    rng = random.Random(9)
    bits = ["a@b.c", "x_y@d-e.f.g", "@", ".", "1.2.3.4", "256.1.1.1", "0010.2.3.255.7", "4111111111111111", "4111-1111 1111 1111",
            "4111  1111", "+1 (366) 555-9807", "+4", "+49.30-123456", "é", "😀", " ", "\n", "-", "7", "word", "+", "12345678901234567890"]
    return ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(n)]


def _check(rows, got):
    want = {}
    for i, t, _ in rows:
        k = _spans(t)
        want.setdefault(i, set()).add((*(len(v) for v in k.values()), ",".join(sum(k.values(), []))))
    assert len(got) == len(rows)
    for r in got:
        counts = (r.n_email, r.n_ip, r.n_card, r.n_phone)
        base = ",".join(s for s in r.spans.split(",") if s and not s.startswith("id:"))
        assert (*counts, base) in want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()


def test_fixed_patterns_equal_brute_force(make_docs):
    rows = [(i, t, "s") for i, t in enumerate(_random_texts(1500))]
    _check(rows, pii.find_personal(make_docs(rows)).collect())


def test_odd_rows_and_long_runs(make_docs, odd_rows):
    runs = ["9" * 40_000, "1 " * 30_000, "a@b" + ".c" * 30_000, "a." * 40_000 + "@", "+" + "1-" * 30_000 + "2", "1." * 30_000]
    rows = odd_rows + [(100 + i, t, "s") for i, t in enumerate(runs)]
    _check(rows, pii.find_personal(make_docs(rows)).collect())


def test_contexts_of_seeds_find_unseen_identifiers(make_docs, vocabulary):
    rng = random.Random(6)
    filler = lambda: " ".join(rng.choices(vocabulary, k=12))
    rows = [(i, f"{filler()} contact: user{i}@mail.example.com {filler()}", "s") for i in range(20)]
    rows += [(100, f"{filler()} contact: QX77-19 {filler()}", "s"), (101, f"{filler()} version 2.0 {filler()}", "s")]
    rows += [(200 + i, f"{filler()} the {i}@mail.example.com the end the word", "s") for i in range(5)]
    rows += [(300, "the 77 days", "s")]
    found = {r.doc_id: r.spans for r in pii.find_personal(make_docs(rows)).collect()}
    text = rows[20][1]
    at = text.index("QX77-19")
    assert found[100] == f"id:{at}:{at + 7}"
    assert found[101] == "" and found[300] == ""  # `the` is mostly followed by ordinary words
    masked = {r.doc_id: r.text for r in pii.redact(make_docs(rows)).collect()}
    assert masked[100] == text.replace("QX77-19", "[id]")
    assert masked[3] == re.sub(r"\S+@\S+", "[email]", rows[3][1])
    assert masked[101] == rows[21][1]


def _bootstrapped(rows):
    """Values that trusted words precede, by plain rounds; texts without base entities but e-mails."""
    edges, total, seeds = {}, {}, set()
    for _, t, _ in rows:
        ws = t.split()
        for w in ws:
            total[w.lower()] = total.get(w.lower(), 0) + 1
        for w, v in zip(ws, ws[1:]):
            if EMAIL.fullmatch(v) or any(c.isdigit() for c in v):
                edges[w.lower(), v] = edges.get((w.lower(), v), 0) + 1
                seeds |= {v} if EMAIL.fullmatch(v) else set()
    known, trusted, last = set(seeds), set(), None
    sure = {v: float(v in known) for _, v in edges}
    while True:
        score, support = {}, {}
        for (w, v), n in edges.items():
            score[w] = score.get(w, 0) + n * sure[v] / total[w]
            support[w] = support.get(w, 0) + (v in known)
        score = {w: min(x, 1.0) for w, x in score.items()}
        trusted = {w for w in score if score[w] >= pii.CONFIDENCE and support[w] >= pii.SUPPORT}
        now = (len(trusted), sum(score.values()))
        if last and now[0] == last[0] and now[1] - last[1] <= pii.SETTLED:
            return trusted
        last, doubt = now, {}
        for w, v in edges:
            doubt[v] = doubt.get(v, 1.0) * (1 - min(score[w], 1 - 1e-9))
            known |= {v} if w in trusted and len(v) >= pii.SPECIFIC else set()
        sure = {v: 1.0 if v in known else (1 - doubt[v]) * (len(v) >= pii.SPECIFIC) for v in doubt}


def test_bootstrapping_equals_brute_force_on_random_graphs(make_docs):
    rng = random.Random(21)
    leads = [f"lead{c}:" for c in "abcdefgh"]
    ids = [f"user{i}@mail.example.com" for i in range(12)] + [f"QX{i:04d}" for i in range(40)] + ["7", "42"]
    rows = []
    for i in range(150):
        k = rng.randrange(len(leads))
        near = [v for j, v in enumerate(ids) if j % 9 in (k, k + 1)]
        value = rng.choice(near) if rng.random() < 0.93 - 0.02 * k else "plain"
        rows.append((i, f"some text {leads[k]} {value} follows", "s"))
    trusted = _bootstrapped(rows)
    assert 1 < len(trusted)
    got = {r.doc_id: r.spans for r in pii.find_personal(make_docs(rows)).collect()}
    for i, t, _ in rows:
        w, v = t.split()[2:4]
        at = t.index(v, t.index(w) + len(w))
        led = w in trusted and v != "plain" and "@" not in v
        assert [x for x in got[i].split(",") if x.startswith("id:")] == [f"id:{at}:{at + len(v)}"] * led


def test_bootstrapping_goes_on_from_what_it_finds(make_docs):
    rows = [(i, f"write to contact: user{i}@mail.example.com today", "s") for i in range(20)]
    rows += [(100 + i, f"write to contact: QX77-{i} today", "s") for i in range(4)]
    rows += [(200 + i, f"carry badge QX77-{i} always", "s") for i in range(4)]
    rows += [(300, "carry badge QX99-77 always", "s"), (301, "write to contact: B11 C22 today", "s")]
    rows += [(302, "see contact:" + " " * 250 + "QX88-20", "s"), (303, "see page 77 again", "s")]
    rows += [(400 + i, f"on line2: user{i}@mail.example.com now", "s") for i in range(12)] + [(450, "on line2: E99 now", "s")]
    found = {r.doc_id: r.spans for r in pii.find_personal(make_docs(rows)).collect()}
    span = lambda i, v: (lambda at: f"id:{at}:{at + len(v)}")(next(t for j, t, _ in rows if j == i).index(v))
    assert found[200] == span(200, "QX77-0") and found[300] == span(300, "QX99-77")
    assert found[301] == f"{span(301, 'B11')},{span(301, 'C22')}"
    assert found[302] == span(302, "QX88-20") and found[450] == span(450, "E99")
    assert found[303] == ""


def test_redaction_masks_what_is_found(make_docs, odd_rows):
    rows = odd_rows + [(400 + i, t, "s") for i, t in enumerate(_random_texts(200))]
    docs = make_docs(rows)
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = {r.doc_id: r.text for r in out.collect()}
    for i, t, _ in rows:
        spans = [s.split(":") for v in _spans(t).values() for s in v]
        if not spans:
            continue
        stretches = sorted((int(a), int(b), k) for k, a, b in spans)
        plain, at = "", 0
        for a, b, k in stretches:
            if a >= at:
                plain += t[at:a] + f"[{k}]"
            at = max(at, b)
        assert i is None or re.sub(r"\[id\]", "", texts[i]).count("[") == plain.count("[")
    assert texts[0] is None


def test_empty(make_docs):
    assert pii.find_personal(make_docs([])).count() == 0
    assert pii.redact(make_docs([])).count() == 0


def test_main_path_has_no_python(make_docs, odd_rows):
    plan = pii.find_personal(make_docs(odd_rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_are_not_written_before_they_are_returned(make_docs, monkeypatch):
    kept = []
    monkeypatch.setattr(pii, "stored", lambda df: kept.append(stored(df)) or kept[-1])
    docs = make_docs([(i, f"write to a{i}@b.org or call nobody", "a") for i in range(64)]).repartition(16)
    assert pii.find_personal(docs).count() == 64
    assert all("id_out" not in df.columns for df in kept)


def test_rounds_write_no_more_files_than_there_are_cores(make_docs, spark, monkeypatch):
    """Small tables of a round have few files, however many parts a shuffle has."""
    written = []
    monkeypatch.setattr(pii, "stored", lambda df: written.append((df.columns, stored(df))) or written[-1][1])
    docs = make_docs([(i, f"word{i % 9} a{i}@b.cc code{i % 9} x{i}y{i}zz", "a") for i in range(400)])
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    before = [spark.conf.get(n) for n in names]
    try:
        spark.conf.set(names[0], "40")
        spark.conf.set(names[1], "false")
        pii.discovered(pii._with_base(docs, "doc_id", "text", []))
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    of_rounds = [df for columns, df in written if "known" in columns or "support" in columns]
    assert len(of_rounds) >= 3
    cores = spark.sparkContext.defaultParallelism
    assert cores < 40 and all(len(df.inputFiles()) <= cores for df in of_rounds)


def _slow_rows():
    """Words that stand once before an identifier and gain a little in every round."""
    rows = [(i, f"write to contact: user{i}@mail.example.com today", "s") for i in range(20)]
    rows += [(100 + i, f"alpha{'xyz'[i % 3] * (1 + i // 3)}q QX{i:04d}-7 ends", "s") for i in range(60)]
    rows += [(200 + i, f"beta QX{i:04d}-7 and beta again", "s") for i in range(60)]
    rows += [(300 + i, f"beta user{i % 2}@mail.example.com ends beta", "s") for i in range(2)]
    return rows


def test_rounds_end_when_no_pattern_is_left_that_could_be_trusted(make_docs, monkeypatch):
    """Confidences that grow for long without any chance of trust cost no rounds."""
    monkeypatch.setattr(pii, "SETTLED", 1e-5)  # as many slow words together as a large corpus has
    written = []
    monkeypatch.setattr(pii, "stored", lambda df: written.append(df.columns) or stored(df))
    rows = _slow_rows()
    assert _bootstrapped(rows) == {"contact:"}
    found = {r.doc_id: r.spans for r in pii.find_personal(make_docs(rows)).collect()}
    assert all("id:" not in s for s in found.values())
    assert sum("support" in columns for columns in written) <= 3


def test_totals_of_patterns_are_the_same_by_either_path(make_docs, monkeypatch):
    docs = make_docs([(i, "The code: A1 the CODE: the end" + " x" * (i % 3), "s") for i in range(9)] + [(9, None, "s")])
    based = pii._with_base(docs, "doc_id", "text", [])
    patterns = stored(based.sparkSession.createDataFrame([("the",), ("code:",), ("gone",)], "pattern string"))
    sent = {(r.pattern, r.total) for r in pii.word_totals(based, patterns).collect()}
    monkeypatch.setattr(pii, "SENT_PATTERNS", 0)
    counted = {(r.pattern, r.total) for r in pii.word_totals(based, patterns).collect()}
    assert sent == counted == {("the", 27), ("code:", 18)}
