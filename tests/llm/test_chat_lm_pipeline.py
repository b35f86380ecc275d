import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harborline.llm import chat, lm, neardup, packing
from harborline.sources.durable import stored

TURNS = "conv_id long, turn long, role string, text string, n long, part long"


def _turns(spark, conversations):
    rows = [(c, t, r, x, -1, -2) for c, turns in conversations for t, r, x in turns]
    return spark.createDataFrame(rows, TURNS)


def _rendered(turns):
    ordered = sorted(set((t, r or "unknown", x or "") for t, r, x in turns))
    return "".join(f"<|{r}|>\n{x}<|end|>\n" for _, r, x in ordered)


def test_snapshots_collapse_to_maximal_conversations(spark):
    rng = random.Random(5)
    conversations, i = [], 0
    for group in range(30):
        whole = [(t, ["user", "assistant"][t % 2], f"g{group} t{t} {rng.random()}") for t in range(rng.randint(2, 9))]
        for cut in {len(whole), *rng.choices(range(1, len(whole) + 1), k=3)}:
            conversations.append((i, whole[:cut]))
            i += 1
        if group % 3 == 0:
            branch = [*whole[:-1], (len(whole) - 1, "assistant", "another end")]
            conversations.append((i, branch))
            i += 1
    rng.shuffle(conversations)
    conversations.append((999, conversations[0][1]))
    got = {r.conv_id: r for r in chat.format_chats(_turns(spark, conversations)).collect()}
    whole = {c: tuple(sorted(t)) for c, t in conversations}
    maximal = {
        c for c, t in whole.items()
        if not any(len(o) > len(t) and o[: len(t)] == t for o in whole.values())
    }
    first = {min(c for c in maximal if whole[c] == whole[m]) for m in maximal}
    assert set(got) == first
    for c in first:
        assert got[c].text == _rendered(whole[c]) and got[c].n_turns == len(whole[c])
        assert got[c].copies == sum(t == whole[c] for t in whole.values())
        assert got[c].trained_chars == sum(len(x) for _, r, x in whole[c] if r == "assistant")


def test_chat_odd_rows(spark):
    long = [(t, "user", f"turn {t}") for t in range(150)]
    conversations = [
        (1, [(None, "user", "x"), (0, None, None), (0, None, None)]), (2, long), (3, long[:70]), (None, [(0, "user", "é" * 9000)]),
        (5, [(0, "user", ""), (0, "assistant", "tie")]), (6, [(0, "user", None)]),
    ]
    got = chat.format_chats(_turns(spark, conversations)).collect()
    parts = sorted((r.part, r.n_turns) for r in got if r.conv_id == 2)
    assert parts == [(0, 64), (1, 64), (2, 22)]
    whole = "".join(r.text for r in sorted((r for r in got if r.conv_id == 2), key=lambda r: r.part))
    assert whole == _rendered(long)
    assert {r.conv_id for r in got} == {1, 2, None, 5, 6}
    first = next(r for r in got if r.conv_id == 1)
    assert first.text == "<|user|>\nx<|end|>\n<|unknown|>\n<|end|>\n" and first.n_turns == 2
    assert chat.format_chats(_turns(spark, [])).count() == 0


def _sentences(n, seed):
    """Texts of a small grammar, in which a word depends on those around it."""
    rng = random.Random(seed)
    nouns, verbs = [f"noun{i}" for i in range(12)], [f"verb{i}" for i in range(12)]
    say = lambda: f"the {rng.choice(nouns)} will {rng.choice(verbs)} a {rng.choice(nouns)} ."
    return [" ".join(say() for _ in range(rng.randint(3, 12))) for _ in range(n)]


def test_scores_prefer_held_out_text_to_shuffled_text(spark):
    schema = "doc_id long, text string"
    corpus = spark.createDataFrame(list(enumerate(_sentences(2000, 1))), schema).repartition(3)
    held_out = _sentences(30, 2)
    rng = random.Random(3)
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in held_out]
    rows = [(i, t) for i, t in enumerate([*held_out, *shuffled])]
    encode = lambda df: df.mapInArrow(lm._encoded, "doc_id long, ids binary")
    trained = lm.train(stored(encode(corpus)))
    scored = encode(spark.createDataFrame(rows, schema)).mapInArrow(
        lm._scored(*trained), "doc_id long, n_tokens long, log_prob double"
    )
    mean = {r.doc_id: r.log_prob / r.n_tokens for r in scored.collect()}
    assert sum(mean[i] > mean[i + 30] for i in range(30)) >= 27
    counts = Counter(w for t in _sentences(2000, 1) for w in t.split())
    total = sum(counts.values())
    unigram = sum(np.log(counts[w] / total) for t in held_out for w in t.split())
    words = sum(len(t.split()) for t in held_out)
    assert sum(mean[i] * len(held_out[i].split()) for i in range(30)) / words > unigram / words + 0.3


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 50, lm.VOCABULARY)
    classes = lm.word_classes(counts)
    net = {k: v.astype(np.float64) for k, v in lm.fresh_network(counts, classes).items()}
    around, target = rng.integers(0, 40, (64, 2 * lm.SIDE)), rng.integers(0, lm.CLASSES, 64)
    loss = lambda n: -lm.forward(n, around)[2][np.arange(64), target].mean()
    moved = {k: v.copy() for k, v in net.items()}
    lm.learn(moved, around, target, 1e-3)
    for name, at in (("hidden", (3, 5)), ("out", (7, 9)), ("out_bias", (int(target[0]),))):
        bumped = {k: v.copy() for k, v in net.items()}
        bumped[name][at] += 1e-5
        slope = (loss(bumped) - loss(net)) / 1e-5
        assert (net[name][at] - moved[name][at]) / 1e-3 == pytest.approx(slope, rel=1e-2, abs=1e-6)


def test_scores_of_odd_rows(make_docs, odd_rows):
    got = lm.score(make_docs(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        assert (r.mean_log_prob is None) == (r.n_tokens == 0) and np.isfinite(r.log_prob)
    assert len({r.log_prob for r in got if r.doc_id == 6}) == 1
    assert {r.log_prob for r in got if r.doc_id in (0, 1, 2)} == {0.0}
    assert lm.score(make_docs([])).count() == 0


def test_stages_build_on_each_other(spark, make_docs, odd_rows, vocabulary):
    """Each stage's rows against what its operator says of the rows it was given."""
    rng = random.Random(9)
    clean = [(100 + i, " ".join(rng.choices(vocabulary, k=rng.randint(60, 200))), f"s{i % 3}") for i in range(60)]
    copies = [(300 + i, clean[i][1], "s1") for i in range(10)]
    private = [(400 + i, clean[20 + i][1][::-1] + f" mail me{i}@example.com today", "s2") for i in range(5)]
    docs = make_docs(odd_rows + clean + copies + private)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = docs
        docs = stored(stage(spark, docs, ""))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == seen[name].columns
    kept = {r.doc_id for r in seen["near duplicates"].collect()}
    assert {i for i, _, _ in clean} <= kept and not kept & {0, 1, 2, 5, 9}
    single = {r.doc_id for r in seen["personal data"].collect()}
    assert single == {r.doc_id for r in neardup.near_duplicates(seen["near duplicates"]).where("kept").collect()}
    assert not single & {i for i, _, _ in copies}
    masked = {r.doc_id: (r.text, r.n_chars) for r in seen["mixing"].collect()}
    assert all("@example" not in masked[i][0] and "[email]" in masked[i][0] for i, _, _ in private if i in masked)
    assert all(n == len(t) for t, n in masked.values())
    mixed = Counter(r.doc_id for r in seen["packing"].collect())
    assert set(mixed) <= set(masked) and max(mixed.values()) <= 3
    tokens = docs.where("start = 0").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("doc_tokens").alias("t"))
    assert {r.doc_id: r.n for r in tokens.collect()} == dict(mixed)
    total = docs.agg(F.sum("length")).first()[0]
    assert total == sum(r.t * r.n for r in tokens.collect())
    assert packing.WINDOW >= docs.agg(F.max("length")).first()[0]


def test_pipeline_of_nothing(spark, make_docs):
    docs = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, ""))
    assert docs.count() == 0
