"""Exact top-k by TF-IDF over an inverted index: postings by word and group of documents.

A group holds the documents of one stretch of the corpus, some 65,536 postings. For every word of
a group the index keeps the greatest weight, so a question reads these maxima first and the
postings of those groups alone that can still hold one of its best documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.functions.text import words
from harborline.operators.ranking import top_k
from harborline.sources.durable import stored

DEFAULT_K = 6
GROUP_POSTINGS = 65_536  # a group closes with the document that reaches so many, or with 1,024 documents
SLICE_BLOCKS, SLICES = 250_000, 1_024  # rows of a folder of postings, and the most folders
FEWEST_SLICES = 8
FIRST_GROUPS = 4  # groups that a question is scored on to find what the others have to beat
QUESTIONS_AT_ONCE = 256  # questions that one task scores on one group
_ASKED = "weight > 0"  # true of every row; lets the planner read only the folders of asked words
ROUNDING = 2e-6  # similarities have six decimals


@dataclass(frozen=True)
class WordIndex:
    """TF-IDF index of a corpus: built once, asked many times.

    ``slice`` is a hash of the word and a folder of its own in ``postings`` and ``weights``.
    """

    postings: DataFrame  # (slice, word, group, most, list): pairs of a place in the group and a count
    weights: DataFrame  # (slice, word, idf), one row per distinct word
    groups: DataFrame  # (group, ids, norms): the documents of a group by their places
    n: int
    slices: int


def _grouped(batches: Iterator[pa.RecordBatch], postings: int) -> Iterator[pa.RecordBatch]:
    """Rows ``(doc_id, words)`` to rows ``(group, at, word, list)``: the places of a word's
    documents in their group, each followed by how often it stands there, see ``_packed``.
    ``at`` numbers the words of a group. The row of the word null holds the group's documents
    themselves."""
    number = TaskContext.get().partitionId() << 32  # postings // 1024 more by document close it in time
    for batch in batches:
        ids, listed = batch.column(0), batch.column(1)
        bounds = listed.offsets.to_numpy() - listed.offsets[0].as_py()
        coded = listed.flatten().dictionary_encode()
        if not len(coded):
            continue
        doc = np.repeat(np.arange(len(ids), dtype=np.int64), np.diff(bounds))
        size = len(coded.dictionary)
        keys, tf = np.unique(doc * size + coded.indices.to_numpy(), return_counts=True)
        doc, code = keys // size, keys % size
        cost = np.cumsum(np.bincount(doc, minlength=len(ids)) + postings // 1024) // postings
        cuts = np.flatnonzero(np.diff(cost[doc], prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            first, last = int(doc[a]), int(doc[b - 1])
            order = np.argsort(code[a:b], kind="stable")
            own = code[a:b][order]
            starts = np.append(np.flatnonzero(np.diff(own, prepend=-1)), b - a)
            pairs = np.stack([doc[a:b][order] - first, tf[a:b][order]], 1)
            n = len(starts) - 1
            columns = [
                pa.array(np.full(n, number), pa.int64()),
                pa.array(np.arange(n), pa.int32()),
                coded.dictionary.take(pa.array(own[starts[:-1]])),
                _packed(pairs, starts),
                pa.nulls(n, pa.list_(ids.type)),
            ]
            names = ["group", "at", "word", "list", "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            whole = [pa.array([number], pa.int64()), *[pa.nulls(1, c.type) for c in columns[1:4]]]
            own_ids = ids.slice(first, last - first + 1)
            whole.append(pa.ListArray.from_arrays(pa.array([0, len(own_ids)], pa.int32()), own_ids))
            yield pa.RecordBatch.from_arrays(whole, names=names)
            number += 1


def _binary(data: bytes, offsets: np.ndarray) -> pa.Array:
    """One value per pair of neighbouring offsets."""
    buffers = [None, pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, buffers)


def _packed(pairs: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The pairs between neighbouring starts as one value each: 16-bit numbers, or where one of
    the group's is greater, 32-bit numbers and a byte that makes the length odd."""
    if pairs.max() < 1 << 16:
        return _binary(pairs.astype("<u2").tobytes(), starts * 4)
    parts = np.split(pairs.astype("<i4"), starts[1:-1])
    return pa.array([part.tobytes() + b"\0" for part in parts], pa.binary())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    wide = len(data) % 2
    pairs = np.frombuffer(data, "<i4" if wide else "<u2", len(data) // (8 if wide else 4) * 2)
    return pairs[::2], pairs[1::2]


def _n_documents() -> Column:
    """How many documents a list holds."""
    n = F.octet_length("list")
    return F.when(n % 2 == 1, (n - 1) / 8).otherwise(n / 4)


def _weighed(postings: pa.Table, idfs: pa.Table) -> pa.Table:
    """A group's rows ``(group, at, word, list)`` and ``(of, n, idf)`` to rows with the greatest
    weight of each word, where the group's documents have norm 1. The weights themselves are not
    kept: they follow from the counts, the word's idf and the norms, which are the list of the
    row of the word null, as doubles."""
    if not len(postings):
        return _POSTING.empty_table()
    postings, idfs = postings.sort_by("at"), idfs.sort_by("n")
    lists = postings.column("list").to_pylist()
    pairs = [_unpacked(x) for x in lists]
    docs, tfs = (np.concatenate(side) for side in zip(*pairs))
    sizes = np.array([len(places) for places, _ in pairs])
    raw = tfs * np.repeat(idfs.column("idf").to_numpy(), sizes)
    norms = np.sqrt(np.bincount(docs, raw * raw))
    most = np.maximum.reduceat(raw / norms[docs], np.cumsum(sizes) - sizes).astype(np.float32)
    most = np.nextafter(most, np.float32(np.inf))  # a bound, so never rounded down
    group = postings.column("group").combine_chunks()
    columns = [
        pa.array([*postings.column("word").to_pylist(), None], pa.string()),
        pa.array(np.append(group.to_numpy(), group[0].as_py())),
        pa.array(np.append(most, np.float32(0))),
        pa.array([*lists, norms.astype("<f8").tobytes()], pa.binary()),
    ]
    return pa.Table.from_arrays(columns, schema=_POSTING)


_POSTING = pa.schema([("word", pa.string()), ("group", pa.int64()), ("most", pa.float32()), ("list", pa.binary())])


def _slice(slices: int) -> Column:
    return F.pmod(F.xxhash64("word"), F.lit(slices)).cast("int").alias("slice")


def build_word_index(
    corpus: DataFrame, slices: int | None = None, group_postings: int = GROUP_POSTINGS
) -> WordIndex:
    """Index of ``corpus(doc_id, text)`` over whole texts; every word is itself the key.

    Words are counted where their texts lie. What is shuffled by word is one row per group and
    distinct word, never one per posting; the idfs go back to the groups, which then know
    their documents' norms. A word of all documents has a row per group, not one list. Lists hold
    counts from first to last, so weights are neither moved nor stored.
    """
    kind = corpus.schema["doc_id"].dataType.simpleString()
    split = corpus.select("doc_id", F.coalesce(words(F.col("text")), F.array()).alias("ws"))
    whole = stored(
        split.mapInArrow(
            lambda batches: _grouped(batches, group_postings), f"group long, at int, word string, list binary, ids array<{kind}>"
        )
    )
    n = corpus.count()
    postings = whole.where("word IS NOT NULL").select("group", "at", "word", "list")
    slices = slices or max(FEWEST_SLICES, min(SLICES, postings.count() // SLICE_BLOCKS))
    idf = F.log(F.lit(n + 1) / (F.sum(_n_documents()) + 1)) + 1
    weights = stored(
        postings.groupBy("word").agg(idf.alias("idf")).select("word", "idf", _slice(slices)).repartition("slice"),
        by="slice",
    )
    known = weights.select("word", "idf").join(postings.select("group", "at", "word"), "word")
    by_group = known.select(F.col("group").alias("of"), F.col("at").alias("n"), "idf").groupBy("of")
    # norms have folders of their own, below zero
    of_norms = -1 - F.pmod(F.xxhash64("group"), F.lit(1 + slices // 16)).cast("int")
    weighed = (
        postings.groupBy("group")
        .cogroup(by_group)
        .applyInArrow(_weighed, "word string, group long, most float, list binary")
        .select("*", F.when(F.col("word").isNull(), of_norms).otherwise(_slice(slices)).alias("slice"))
    )
    ordered = stored(weighed.repartition("slice").sortWithinPartitions("slice", "word"), by="slice")
    norms = ordered.where("slice < 0").select("group", F.col("list").alias("norms"))
    groups = stored(whole.where("word IS NULL").select("group", "ids").join(norms, "group"))
    return WordIndex(ordered.where("slice >= 0"), weights, groups, n, slices)


def asked_words(index: WordIndex, queries: DataFrame) -> DataFrame:
    """``(query_id, slice, word, weight, idf)`` of ``queries(query_id, text)``, norm 1 per query.
    ``idf`` is null for words that the corpus does not have."""
    unseen = F.log(F.lit(index.n + 1).cast("double")) + 1
    counted = (
        queries.select("query_id", F.explode(words(F.col("text"))).alias("word"))
        .groupBy("query_id", "word")
        .agg(F.count("*").alias("tf"))
    )
    weighed = counted.select("*", _slice(index.slices)).join(index.weights, ["slice", "word"], "left").withColumn(
        "w", F.col("tf") * F.coalesce("idf", unseen)
    )
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query_id")))
    return weighed.select("query_id", "slice", "word", (F.col("w") / norm).alias("weight"), "idf")


def upper_bounds(index: WordIndex, asked: DataFrame) -> DataFrame:
    """``(query_id, group, bound)``: what no document of the group scores above."""
    most = index.postings.select("slice", "word", "group", "most")
    met = asked.where(_ASKED).join(most, ["slice", "word"])
    return met.groupBy("query_id", "group").agg(F.sum(F.col("weight") * F.col("most")).alias("bound"))


def _best_of_group(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        flat = []
        for ids, norms, held, wanted in zip(batch["ids"], batch["norms"], batch["held"], batch["wanted"]):
            norms, lists = np.frombuffer(norms, "<f8"), {}
            for p in held:
                docs, tfs = _unpacked(p["list"])
                lists[p["word"]] = docs, tfs * p["idf"] / norms[docs]
            for q in wanted:
                scores = np.zeros(len(ids))
                for t in sorted(q["terms"], key=lambda t: t["word"]):
                    if t["word"] in lists:
                        docs, ws = lists[t["word"]]
                        scores[docs] += t["weight"] * ws
                near = np.floor(scores * 1e6 + 0.5) / 1e6
                kept = np.flatnonzero(scores > 0)
                if len(kept) > k:
                    floor = np.partition(near[kept], len(kept) - k)[len(kept) - k]
                    kept = kept[near[kept] >= floor]
                best = sorted((-near[i], ids[i]) for i in kept)[:k]
                flat += [(q["query_id"], d, -s) for s, d in best]
        if flat:
            yield pd.DataFrame(flat, columns=["query_id", "doc_id", "similarity"])


def score_groups(index: WordIndex, asked: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """``(query_id, doc_id, similarity)``: each group's best k documents for the queries that want
    it. ``pairs(query_id, group)``.

    Postings of asked words are read from their folders and moved once per group and block of
    queries, however many of them ask for the word; a task emits k rows per query and group.
    """
    blocks = -(-pairs.select("query_id").distinct().count() // QUESTIONS_AT_ONCE) or 1
    terms = asked.groupBy("query_id").agg(F.collect_list(F.struct("word", "weight")).alias("terms"))
    wanted = (
        pairs.join(terms, "query_id")
        .groupBy("group", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))
        .agg(F.collect_list(F.struct("query_id", "terms")).alias("wanted"))
    )
    met_words = asked.where(_ASKED).select("slice", "word").distinct()
    idfs = stored(met_words.join(index.weights, ["slice", "word"]))  # small: postings stay where they are
    held = (
        index.postings.join(idfs, ["slice", "word"])
        .join(pairs.select("group").distinct(), "group", "left_semi")
        .groupBy("group")
        .agg(F.collect_list(F.struct("word", "list", "idf")).alias("held"))
    )
    kinds = asked.schema["query_id"].dataType.simpleString(), index.groups.schema["ids"].dataType.elementType.simpleString()
    met = index.groups.join(held, "group").join(wanted, "group").select("ids", "norms", "held", "wanted")
    schema = f"query_id {kinds[0]}, doc_id {kinds[1]}, similarity double"
    return met.mapInPandas(lambda batches: _best_of_group(batches, k), schema)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = [F.col("similarity").desc(), F.col("doc_id").asc()]
    return top_k(scored, ["query_id"], order, k).select("query_id", "rank", "doc_id", "similarity")


def groups_to_score(index: WordIndex, asked: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
    """``(query_id, group)`` that can hold one of the best k documents of the query.

    A query's groups with the highest bounds are scored first; every other group has to reach
    the k-th best similarity found there. With fewer than k found, all groups stay.
    """
    highest = top_k(bounds, ["query_id"], [F.col("bound").desc(), F.col("group")], FIRST_GROUPS)
    first = score_groups(index, asked, highest.select("query_id", "group"), k)
    reached = _ranked(first, k).where(F.col("rank") == k).select("query_id", F.col("similarity").alias("least"))
    joined = bounds.join(reached, "query_id", "left")
    return joined.where(F.col("bound") + ROUNDING >= F.coalesce("least", F.lit(0.0))).select("query_id", "group")


def tfidf_topk(queries: DataFrame, index: WordIndex, k: int = DEFAULT_K) -> DataFrame:
    """Exact top-k by cosine of TF-IDF word weights, six decimals, ties by id.

    ``queries(query_id, text)`` -> ``(query_id, rank, doc_id, similarity)``. Documents that
    share no word with a query do not appear. No question and no word comes to the driver.
    """
    asked = stored(asked_words(index, queries).where("idf IS NOT NULL").drop("idf"))
    bounds = stored(upper_bounds(index, asked))
    pairs = stored(groups_to_score(index, asked, bounds, k))
    return _ranked(score_groups(index, asked, pairs, k), k)
