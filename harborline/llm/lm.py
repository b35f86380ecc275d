"""Scoring by masked pseudo-likelihood with a small bidirectional window network.

Every word is predicted from the two words before and after it. The network gives the
probability of the class of the word's id; the id's share of its class and the word's share
of its id, both counted over the whole corpus, give the rest. A document's score is the sum
of its words' log-probabilities.

Ids are hashes of words, so that the network has a fixed size. The words themselves are
counted in a table of their own, which grows with the corpus, and their counts are joined
back to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.wordhash import distinct_words, hashes_of, text_slices
from harborline.sources.durable import stored

VOCABULARY = 8192  # ids the network knows: hashes of lower-case words
SIDE = 2  # words on each side of the masked one
WIDTH = 16  # numbers per word
HIDDEN = 32
OWN = 96  # frequent words that are a class of their own
CLASSES = 128  # the others' classes are bands of like frequency and near equal mass
MASKED = 8  # one in so many words is masked at a time; all residues have their turn
ROUNDS = 2
BATCH = 2048
PIECE_BYTES = 8 << 20  # of text whose distinct words are shuffled together
AT_ONCE = 512  # words scored at once, so the work stays in the cache
RATE = 0.5
SHAPES = {
    "words": (VOCABULARY + 1, WIDTH),  # the last row stands beyond the ends of a text
    "hidden": (2 * SIDE * WIDTH, HIDDEN),
    "hidden_bias": (HIDDEN,),
    "out": (HIDDEN, CLASSES),
    "out_bias": (CLASSES,),
}
Network = dict[str, np.ndarray]
SCORED = ["doc_id", "n_tokens", "log_prob"]


def fresh_network(counts: np.ndarray, classes: np.ndarray, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    net = {k: (rng.standard_normal(s) * 0.1).astype(np.float32) for k, s in SHAPES.items()}
    share = np.bincount(classes, weights=counts, minlength=CLASSES) + 1
    return net | {"out_bias": np.log(share / share.sum()).astype(np.float32), "hidden_bias": np.zeros(HIDDEN, np.float32)}


def flat(net: Network) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray) -> Network:
    sizes = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])[:-1]
    return {
        k: part.reshape(s).astype(np.float32)
        for (k, s), part in zip(SHAPES.items(), np.split(values, sizes))
    }


def word_classes(counts: np.ndarray) -> np.ndarray:
    """The most frequent ids are classes of their own; the others, in the order of their
    counts, are cut into bands of near equal total count."""
    order = np.lexsort((np.arange(VOCABULARY), -counts))
    classes = np.empty(VOCABULARY, np.int64)
    classes[order[:OWN]] = np.arange(OWN)
    mass = counts[order[OWN:]] + 1.0
    middle = (np.cumsum(mass) - mass / 2) / mass.sum()
    classes[order[OWN:]] = OWN + (middle * (CLASSES - OWN)).astype(np.int64)
    return classes


def shares_of_class(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Log of an id's share of its class, each id counted once more than seen."""
    total = np.bincount(classes, weights=counts + 1, minlength=CLASSES)
    return np.log((counts + 1) / total[classes])


def windows(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids padded on both sides of every text, and where each id stands in them."""
    sizes = np.diff(bounds)
    at = np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes) * 2 * SIDE + SIDE
    padded = np.full(len(ids) + len(sizes) * 2 * SIDE, VOCABULARY, np.int64)
    padded[at] = ids
    return padded, at


def context(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    sides = [s for s in range(-SIDE, SIDE + 1) if s]
    return padded[at[:, None] + np.array(sides)]


def scores(net: Network, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, and a column per word of hidden values and of the classes' scores up to a constant,
    at most 0. Steps over all classes so run along the words, which lie side by side."""
    x = np.take(net["words"], around, axis=0).reshape(len(around), -1)
    h = net["hidden"].T @ x.T
    h += net["hidden_bias"][:, None]
    np.tanh(h, out=h)
    found = net["out"].T @ h
    found += net["out_bias"][:, None]
    found -= found.max(axis=0)
    return x, h, found


def forward(net: Network, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, hidden values and log-probabilities of all classes, a row per word."""
    x, h, found = scores(net, around)
    return x, h.T, (found - np.log(np.exp(found).sum(axis=0))).T


def learn(net: Network, around: np.ndarray, target: np.ndarray, rate: float = RATE) -> None:
    """One step of gradient descent on a batch of masked words, in place."""
    n = len(target)
    total = {k: np.zeros_like(net[k]) for k in ("hidden", "hidden_bias", "out", "out_bias")}
    dx = np.empty((n, 2 * SIDE * WIDTH), net["words"].dtype)
    for a in range(0, n, AT_ONCE):
        part = slice(a, min(a + AT_ONCE, n))
        x, h, d = scores(net, around[part])
        np.exp(d, out=d)
        d /= d.sum(axis=0)
        d[target[part], np.arange(d.shape[1])] -= 1
        dh = net["out"] @ d
        dh *= 1 - h * h
        np.matmul(dh.T, net["hidden"].T, out=dx[part])
        total["out"] += h @ d.T
        total["out_bias"] += d.sum(axis=1)
        total["hidden"] += x.T @ dh.T
        total["hidden_bias"] += dh.sum(axis=1)
    for k, gradient in total.items():
        net[k] -= rate / n * gradient
    # a word's vector moves by the mean over its places, so rare and common words keep pace;
    # numpy adds at single numbers many times faster than at rows
    places = np.ravel(around)[:, None] * WIDTH + np.arange(WIDTH)
    np.subtract.at(net["words"].reshape(-1), places.ravel(), rate / 32 * dx.ravel())


def _cells(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    data, width = values.tobytes(), values.itemsize
    return pa.array([data[width * a : width * b] for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())


def _planes(places: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A cell per text: the lowest bytes of its places, then the next ones; high bytes so pack well."""
    data = places.astype("<u4").view(np.uint8).reshape(-1, 4)
    return pa.array([data[a:b].T.tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())


def _places_of(cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(c) // 4 for c in cells])]).astype(np.int64)
    data = np.empty((bounds[-1], 4), np.uint8)
    for cell, a, b in zip(cells, bounds[:-1], bounds[1:]):
        data[a:b] = np.frombuffer(cell, np.uint8).reshape(4, -1).T
    return data.view("<u4").ravel(), bounds


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every text's ids and its words' places among the words of its piece.

    A piece is a slice of a batch, numbered in its task: such keys are short in a compressed
    shuffle. Its first row carries its distinct words with their ids and counts.
    """
    where = TaskContext.get()
    task, number = where.partitionId() if where else 0, count()
    for batch in batches:
        for rows in text_slices(batch, PIECE_BYTES):
            words, places, bounds = distinct_words(rows.column("text"))
            ids = (hashes_of(words) % np.uint64(VOCABULARY)).astype("<u2")
            once = np.minimum(np.arange(rows.num_rows + 1), 1).astype(np.int32) * len(words)
            on_first = lambda values: pa.ListArray.from_arrays(pa.array(once), values)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"),
                    _cells(ids[places], bounds),
                    pa.array([task << 32 | next(number)] * rows.num_rows, pa.int64()),
                    _planes(places, bounds),
                    on_first(words.cast(pa.string())),
                    on_first(pa.array(ids.astype(np.int32))),
                    on_first(pa.array(np.bincount(places, minlength=len(words)).astype(np.int64))),
                ],
                names=["doc_id", "ids", "piece", "places", "words", "word_ids", "ns"],
            )


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _worded(batches):
        yield batch.select(["doc_id", "ids"])


def _ids_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    cells = batch.column("ids").to_pylist()
    bounds = np.concatenate([[0], np.cumsum([len(c) // 2 for c in cells])]).astype(np.int64)
    return np.frombuffer(b"".join(cells), "<u2").astype(np.int64), bounds


def _one_row(weight: float, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([float(weight)]), pa.array([values.astype(np.float32).tolist()], pa.list_(pa.float32()))],
        names=["weight", "values"],
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(VOCABULARY, np.int64)
    for batch in batches:
        counts += np.bincount(_ids_of(batch)[0], minlength=VOCABULARY)
    yield pa.RecordBatch.from_arrays([pa.array([counts.tolist()], pa.list_(pa.int64()))], names=["values"])


def mask_turns(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The turn, below ``MASKED``, in which each word is masked: its place in its text, moved
    by a phase that follows from the whole text, so a layout repeated by many texts is met at
    every phase."""
    phases = [crc32(ids[a:b].astype("<u2")) % MASKED for a, b in zip(bounds[:-1], bounds[1:])]
    inside = np.arange(len(ids)) - np.repeat(bounds[:-1] - np.array(phases, np.int64), np.diff(bounds))
    return inside % MASKED


def own_copy(net: Network) -> Network:
    """Arrays made here. Those that came with a task hold a type object of their own, and
    numpy's adding at places passes by its fast way for these, even in their copies."""
    made = {k: np.empty(v.shape, np.float32) for k, v in net.items()}
    for k, v in net.items():
        made[k][...] = v
    return made


def _trained(net: Network, classes: np.ndarray, round_: int):
    """A task's own copy of the network after its masked words, weighted by their number.

    A one stands behind the copy's values, so that their weighted sum ends with the weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = own_copy(net), 0
        for batch in batches:
            ids, bounds = _ids_of(batch)
            padded, at = windows(ids, bounds)
            turns = mask_turns(ids, bounds)
            for turn in range(round_, MASKED, ROUNDS):
                masked = np.random.default_rng(turn).permutation(np.flatnonzero(turns == turn))
                for a in range(0, len(masked), BATCH):
                    part = masked[a : a + BATCH]
                    learn(own, context(padded, at[part]), classes[ids[part]])
                seen += len(masked)
        if seen:
            yield _one_row(seen, np.append(flat(own), 1.0))

    return run


def _log_probs(net: Network, classes: np.ndarray, shares: np.ndarray, ids: np.ndarray, bounds: np.ndarray):
    """Log-probability of every place's id."""
    padded, at = windows(ids, bounds)
    logp = shares[ids]
    for a in range(0, len(ids), AT_ONCE):
        part = slice(a, a + AT_ONCE)
        found = scores(net, context(padded, at[part]))[2]
        own = found[classes[ids[part]], np.arange(found.shape[1])]
        logp[part] += own - np.log(np.exp(found, out=found).sum(axis=0))
    return logp


def _summed(doc_ids, bounds: np.ndarray, logp: np.ndarray) -> list:
    """Every text's words are added up from 0, so equal texts have equal sums wherever they stand."""
    sizes = np.diff(bounds)
    sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=logp, minlength=len(sizes))
    return [doc_ids, pa.array(sizes), pa.array(sums.astype(np.float64))]


def _scored(net: Network, classes: np.ndarray, shares: np.ndarray):
    """Scores of ids alone, without the words' shares of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bounds = _ids_of(batch)
            logp = _log_probs(net, classes, shares, ids, bounds)
            yield pa.RecordBatch.from_arrays(_summed(batch.column("doc_id"), bounds, logp), names=SCORED)

    return run


def _scored_pieces(net: Network, classes: np.ndarray, shares: np.ndarray, counts: np.ndarray):
    """Scores of a piece's texts, given the corpus' counts of the piece's words above 1."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        place = words.column("place").to_numpy()
        id_of = pc.list_flatten(texts.column("word_ids")).to_numpy().astype(np.int64)
        share_of = np.zeros(len(id_of))
        share_of[place] = np.log(words.column("n").to_numpy())
        share_of -= np.log(counts[id_of])
        places, bounds = _places_of(texts.column("places").to_pylist())
        logp = _log_probs(net, classes, shares, id_of[places], bounds) + share_of[places]
        return pa.Table.from_arrays(_summed(texts.column("doc_id"), bounds, logp), names=SCORED)

    return run


def _total(rows: DataFrame, size: int, value) -> np.ndarray:
    """Sum of the tasks' arrays by position: folded inside the tasks, a fixed number of rows."""
    summed = rows.select("*", F.posexplode("values").alias("at", "value")).groupBy("at").agg(F.sum(value).alias("s"))
    found = summed.toPandas()
    out = np.zeros(size)
    out[found["at"].to_numpy()] = found["s"].to_numpy()
    return out


def id_counts(encoded: DataFrame) -> np.ndarray:
    return _total(encoded.select("ids").mapInArrow(_counted, "values array<long>"), VOCABULARY, F.col("value"))


def train(encoded: DataFrame, counts: np.ndarray | None = None) -> tuple[Network, np.ndarray, np.ndarray]:
    """Network, class of every id and log-share of every id in its class.

    Words are counted over all texts. In every round each task teaches its own copy of the
    network on its share of the masks' turns, and the copies are averaged by the number of
    words they have seen. Over the rounds every word of every text is masked once. What a round gathers is one copy per task; what the
    driver holds is one network of fixed size.
    """
    counts = id_counts(encoded) if counts is None else counts
    classes = word_classes(counts)
    net = fresh_network(counts, classes)
    size = len(flat(net))
    for r in range(ROUNDS):
        copies = encoded.select("ids").mapInArrow(
            _trained(net, classes, r), "weight double, values array<float>"
        )
        summed = _total(copies, size + 1, F.col("weight") * F.col("value"))
        if summed[-1]:
            net = shaped(summed[:-1] / summed[-1])
    return net, classes, shares_of_class(counts, classes)


def counted_words(encoded: DataFrame) -> DataFrame:
    """``piece, place, n``: every piece's words with their counts in the whole corpus.

    A word has one row per piece that holds it, and these meet once: no second shuffle of the
    words brings their counts back to them.
    """
    words = encoded.select("piece", F.posexplode(F.arrays_zip("words", "ns")).alias("place", "w"))
    total = F.sum("w.ns").over(Window.partitionBy("w.words"))
    return words.select("piece", "place", total.alias("n"))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, log_prob, mean_log_prob`` of every document.

    ``log_prob`` sums the log-probabilities of all words given the words around them;
    ``mean_log_prob`` is the sum by word, null without words.

    Null and empty texts have no words and the sum 0. Repeated rows are scored alike and
    learnt from each. A null id is carried along. An empty table gives no rows. Further
    columns of the input are not read.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    encoded = stored(
        texts.mapInArrow(
            _worded,
            f"doc_id {kind}, ids binary, piece long, places binary, "
            "words array<string>, word_ids array<int>, ns array<long>",
        ),
        codec="zstd",
    )
    counts = id_counts(encoded)
    run = _scored_pieces(*train(encoded, counts), counts)
    by_piece = encoded.select(F.col("piece").alias("of"), "doc_id", "places", "word_ids").groupBy("of")
    met_again = counted_words(encoded).where("n > 1")  # what is left out was met once
    scored = by_piece.cogroup(met_again.groupBy("piece")).applyInArrow(
        run, f"doc_id {kind}, n_tokens long, log_prob double"
    )
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return scored.withColumn("mean_log_prob", mean)
