import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from harborline.llm import binary, packing, tokens
from harborline.llm.tokens import Encoder, default_vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocabulary())


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_the_library(library):
    rng = random.Random(2)
    bits = ["a", "B", " ", "  ", "\n", "\t", "'s", "1", "é", ".", " ", "\x1c", "$", "\r", " ", "\x0b", "<|endoftext|>", "日本", "😀"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(6000)] + [None, "", " ", "x" * 5000]
    ids, bounds = Encoder(default_vocabulary()).encode(pa.array(texts))
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def _check(library, rows, placed, window=2048):
    by_text = defaultdict(list)
    for r in placed:
        by_text[r.doc_id].append(r)
    for i, texts in _texts(rows).items():
        want = Counter()
        for t in texts:
            ids = library.encode(t or "", add_special_tokens=False).ids + [1]
            want[len(ids)] += 1
            for p in by_text[i]:
                if p.doc_tokens == len(ids) and len(texts) == 1:
                    assert p.ids_crc32 == _crc(ids[p.start : p.start + p.length])
        got = Counter()
        for p in by_text[i]:
            got[p.doc_tokens] += p.length
        assert got == Counter({n: n * k for n, k in want.items()})
        if len(texts) == 1:
            at = 0
            for p in sorted(by_text[i], key=lambda p: p.start):
                assert p.start == at
                at += p.length
    sequences = defaultdict(list)
    for r in placed:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def _texts(rows):
    texts = defaultdict(list)
    for i, t, _ in rows:
        texts[i].append(t)
    return texts


def test_packing_places_every_id_once(make_docs, odd_rows, vocabulary, library):
    rng = random.Random(8)
    rows = odd_rows + [(1000 + i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 2500))), "s") for i in range(150)]
    docs = make_docs(rows)
    placed = packing.pack(docs).collect()
    padding = _check(library, rows, placed)
    assert padding <= 8 * len({r.sequence_id for r in placed})
    assert sorted(map(str, placed)) == sorted(map(str, packing.pack(docs).collect()))


def test_equal_lengths_pack_without_padding(make_docs, library):
    rows = [(i, "word " * 700, "s") for i in range(37)]
    placed = packing.pack(make_docs(rows)).collect()
    assert _check(library, rows, placed) == 0


def test_sequences_hold_the_ids(make_docs, vocabulary, library):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 900))), "s") for i in range(40)]
    docs = make_docs(rows)
    placed = packing.pack(docs)
    whole = {r.sequence_id: r.ids for r in packing.sequences(docs, placed).collect()}
    for r in placed.collect():
        assert _crc(whole[r.sequence_id][r.offset : r.offset + r.length]) == r.ids_crc32


def test_best_fill_equals_all_choices():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        target = rng.randint(1, 90)
        sums = {0}
        for x, n in counts.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        best = max(s for s in sums if s <= target)
        chosen = packing.best_fill(counts, target)
        assert sum(x * k for x, k in chosen.items()) == best
        assert all(k <= counts[x] for x, k in chosen.items())


def test_packing_empty(make_docs):
    assert packing.pack(make_docs([])).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 32])
def test_bit_packing_round_trip(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 1 << bits, n, dtype=np.uint64).astype(np.uint32)
        data = binary.pack_bits(ids, bits)
        assert len(data) == -(-n * bits // 8)
        assert binary.unpack_bits(data, n, bits).tolist() == ids.tolist()


def test_file_random_access(tmp_path):
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 5000, n).astype(np.uint32) for n in (0, 5, 20_000, 1, 9000, 0)]
    writer = binary.TokenWriter(f"file://{tmp_path}/a.bin", binary.bits_for(5000))
    for i, ids in enumerate(docs):
        writer.add(None if i == 3 else i * 7, ids)
    writer.close()
    assert [p.name for p in tmp_path.iterdir()] == ["a.bin"]
    reader = binary.TokenReader(f"file://{tmp_path}/a.bin")
    assert reader.bits == 13
    for i in (4, 0, 2, 5, 1, 3):
        assert reader.document(i).tolist() == docs[i].tolist()
    whole = np.concatenate(docs)
    assert reader.ids(8000, 8400).tolist() == whole[8000:8400].tolist()
    assert [d for d, _, _ in reader.documents(100)] == [0, 7, 14, None, 28, 35]


def test_token_files_hold_all_documents(make_docs, odd_rows, library):
    got = binary.token_table(make_docs(odd_rows)).orderBy("start").collect()
    order = sorted((i for i, _, _ in odd_rows), key=lambda i: (i is not None, i or 0))
    assert [r.doc_id for r in got] == order
    texts, at = _texts(odd_rows), 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        wanted = {(len(ids), _crc(ids)) for ids in (library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts[r.doc_id])}
        assert (r.n_tokens, r.ids_crc32) in wanted
    assert binary.token_table(make_docs([])).count() == 0


def test_a_full_memory_keeps_words_met_again(monkeypatch):
    monkeypatch.setattr(tokens, "MOST_WORDS", 150)
    encode = tokens.Encoder(tokens.default_vocabulary())
    batches = [" ".join(["the", "Ünder", "a.\nb"] + [f"w{k}x{i}" for i in range(40)]) for k in range(2)]
    batches += ["quite other words", "", "the Ünder a.\nb w0x3"]
    for text in batches:
        ids, bounds = encode.encode(pa.array([text, text[::-1]]))
        want = [encode.whole.encode(t, add_special_tokens=False).ids for t in (text, text[::-1])]
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
        if text.startswith("quite"):
            assert {" Ünder", " a.\nb"} <= set(encode.known) and " w0x3" not in encode.known


def test_remembered_words_are_no_python_strings():
    encode = tokens.Encoder(tokens.default_vocabulary())
    batches = [pa.array([" ".join(f"w{k}x{i}" for i in range(10_000))]) for k in range(4)]
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    for batch in batches:
        encode.encode(batch)
    encode.parts = {}
    held = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert len(encode.words) > 39_000 and held < 80 * len(encode.words)


def test_the_list_of_token_files_is_one_file(make_docs, tmp_path):
    docs = make_docs([(i, f"text {i}", "a") for i in range(200)])
    docs.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = binary.write_tokens(docs, str(tmp_path))
    finally:
        docs.sparkSession.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() > 1 and len(files.inputFiles()) == 1
