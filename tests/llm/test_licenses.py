import random
import re

from harborline.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_scan(text, templates=licenses.TEMPLATES, threshold=licenses.THRESHOLD):
    ws = WORD.findall(_lower(text))
    places = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(ws)) if ws[i : i + len(p)] == p]
    labels, best = {x for _, x in places}, 0.0
    for label, template in templates:
        own = WORD.findall(_lower(template))
        step = 4
        while step < len(own):
            step *= 2
        for first in range(0, len(ws), step):
            shared = len(set(ws[first : first + 2 * step]) & set(own))
            if 100 * shared >= threshold * len(set(own)):
                labels.add(label)
                best = max(best, shared / len(set(own)))
    at = [i for i, _ in places]
    return (
        len(ws), len(at), min(at, default=None), max(at, default=None),
        ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), 1.0 if at else best,
    )


def _check(make_docs, rows, **own):
    got = licenses.scan(make_docs(rows), **own).collect()
    want = sorted([(str(i), *map(str, brute_scan(t, **own))) for i, t, _ in rows])
    assert sorted(tuple(map(str, r)) for r in got) == want
    return got


def test_scan_equals_brute_force(make_docs, vocabulary):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        ws = rng.choices(vocabulary[:40] + ["the", "of", "license", "and", "to"], k=rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            _, notice = rng.choice(licenses.TEMPLATES)
            kept = [w for w in notice.split(" ") if rng.random() < rng.choice([1, 0.9, 0.75])]
            if rng.random() < 0.3:
                rng.shuffle(kept)
            at = rng.randint(0, len(ws))
            ws[at:at] = kept
        rows.append((i, rng.choice([" ", "\n"]).join(ws), "s"))
    got = _check(make_docs, rows)
    assert sum(r.base_labels != r.labels for r in got) > 20  # the method finds more than the phrases


def test_notices_broken_over_lines_and_upper_case(make_docs):
    rows = [
        (1, "// Licensed under the\n// APACHE License,\n// Version 2.0 (the thing)", "s"),
        (2, "ALL RIGHTS. reserved! and CC-BY, cc by-nc", "s"),
        (3, "all the rights are reserved", "s"),
        (4, "x " * 5000 + "Released under the MIT License." + " y" * 7000, "s"),
        (5, "the mit license", "s"),
        (6, "cc Kby cc bK İ ééall rights reserved", "s"),
    ]
    got = {r.doc_id: r for r in _check(make_docs, rows)}
    assert got[1].labels == "apache-2.0" and got[1].n_base == 0
    assert (got[2].first_word, got[2].last_word, got[2].n_base) == (0, 6, 3)
    assert got[4].labels == "mit" and got[5].labels == ""


def test_odd_rows(make_docs, odd_rows):
    _check(make_docs, odd_rows + [(7, "all rights reserved " * 3000, "b")])


def test_empty_table(make_docs):
    assert licenses.scan(make_docs([])).count() == 0


def test_blocks_and_own_templates(make_docs):
    own = [("one", "alpha beta gamma delta epsilon"), ("two", "beta beta zeta")]
    rows = [(i, t, "s") for i, t in enumerate(["alpha beta gamma x delta", "zeta beta", "alpha", "beta zeta alpha " * 9])]
    _check(make_docs, rows, templates=own, threshold=70)
    found = licenses.license_blocks(licenses.scanned(make_docs(rows), own), own, 70).where("doc_id = 0").collect()
    assert [(r.label, r["first"], r.end, r.shared, r.score) for r in found] == [("one", 0, 16, 4, 0.8)]
