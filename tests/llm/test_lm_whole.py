import pickle

import numpy as np

from harborline.llm import lm


def test_every_word_is_a_target_once(monkeypatch):
    rng = np.random.default_rng(2)
    sizes = [0, 1, 2, 3, 9, 40, 40, 41, 200]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    ids = rng.integers(0, lm.VOCABULARY, bounds[-1])
    classes = np.arange(lm.VOCABULARY)  # the target tells the word
    cells = [ids[a:b].astype("<u2").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
    batch = lm.pa.RecordBatch.from_arrays([lm.pa.array(cells, lm.pa.binary())], names=["ids"])
    seen = []
    monkeypatch.setattr(lm, "learn", lambda net, around, target: seen.extend(target.tolist()))
    net = lm.fresh_network(np.ones(lm.VOCABULARY), lm.word_classes(np.ones(lm.VOCABULARY)))
    weights = [row.column("weight")[0].as_py() for r in range(lm.ROUNDS) for row in lm._trained(net, classes, r)([batch])]
    assert sorted(seen) == sorted(ids.tolist())
    assert sum(weights) == len(ids)


def test_the_masks_phase_follows_the_text():
    texts = [np.arange(16) + i for i in range(64)]
    bounds = np.arange(65) * 16
    turns = lm.mask_turns(np.concatenate(texts), bounds).reshape(64, 16)
    assert set(turns[:, 0]) == set(range(lm.MASKED))
    assert (np.sort(turns, axis=1) == np.repeat(np.arange(lm.MASKED), 2)).all()
    assert (lm.mask_turns(texts[5], np.array([0, 16])) == turns[5]).all()


def test_words_of_one_id_have_shares_of_their_own(make_docs):
    by_id, i = {}, 0
    while True:
        first = by_id.setdefault(int(lm.hashes_of(lm.pa.array([f"w{i}"]))[0] % lm.VOCABULARY), i)
        if first != i:
            break
        i += 1
    often, rare = f"w{first}", f"W{i}"
    rows = [(k, often, "s") for k in range(30)] + [(100 + k, rare, "s") for k in range(2)]
    rows += [(200, f"{often} {rare} other", "s"), (201, "", "s")]
    got = {r.doc_id: r for r in lm.score(make_docs(rows)).collect()}
    assert len(got) == len(rows) and got[200].n_tokens == 3 and got[201].log_prob == 0
    assert np.isclose(got[100].log_prob - got[0].log_prob, np.log(3 / 31))


def test_classes_are_bands_of_frequency():
    counts = np.random.default_rng(1).zipf(1.4, lm.VOCABULARY).clip(0, 10**6)
    classes = lm.word_classes(counts)
    rest = [counts[classes == c] for c in range(lm.OWN, lm.CLASSES)]
    for more, less in zip(rest[:-1], rest[1:]):
        assert more.min() >= less.max()
    mass = np.array([(r + 1).sum() for r in rest])
    assert mass.max() < 2 * mass.min()


def test_counted_words_shuffle_each_word_once(spark):
    """Places are byte planes that read back whole, and a word meets its counts in one shuffle."""
    places = np.array([0, 1, 255, 256, 70_000, 2**24 + 3, 5], np.int64)
    cells = lm._planes(places, np.array([0, 3, 3, 7])).to_pylist()
    got, bounds = lm._places_of(cells)
    assert got.tolist() == places.tolist() and bounds.tolist() == [0, 3, 3, 7]
    rows = [(1, ["a", "b"], [2, 1]), (2, ["b", "c"], [4, 1]), (2, None, None), (3, [], [])]
    encoded = spark.createDataFrame(rows, "piece long, words array<string>, ns array<long>")
    counted = lm.counted_words(encoded)
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in counted.collect()} == {(1, 0, 2), (1, 1, 5), (2, 0, 5), (2, 1, 1)}


def test_updates_take_the_fast_way_for_arrays_that_came_with_a_task():
    came = pickle.loads(pickle.dumps(lm.fresh_network(np.ones(lm.VOCABULARY), lm.word_classes(np.ones(lm.VOCABULARY)))))
    own = lm.own_copy(came)
    assert all((own[k] == came[k]).all() and own[k].dtype is np.dtype(np.float32) for k in came)


def test_keys_of_pieces_are_short():
    batch = lm.pa.RecordBatch.from_arrays([lm.pa.array([1, 2]), lm.pa.array(["a b", "b c"])], names=["doc_id", "text"])
    keys = [k for rows in lm._worded([batch, batch]) for k in rows.column("piece").to_pylist()]
    assert keys == [0, 0, 1, 1]
