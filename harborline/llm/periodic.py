"""Runs of repeated words: maximal stretches that hold their smallest period at least four times."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.wordhash import text_slices

LEAST_WORDS, LEAST_PERIODS = 6, 4
LAGS = 16  # periods up to this one are found by comparing words at that distance

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _least(period: int) -> int:
    return max(LEAST_WORDS, LEAST_PERIODS * period)


def _stretches(where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each stretch of consecutive numbers."""
    breaks = np.flatnonzero(np.diff(where) != 1)
    return where[np.concatenate([[0], breaks + 1])], where[np.concatenate([breaks, [len(where) - 1]])]


def lag_runs(ids: np.ndarray, most: int = LAGS) -> Iterator[tuple[int, int, int]]:
    """``(start, end, period)`` of the stretches that repeat at a short distance."""
    for q in range(1, min(most, len(ids) // LEAST_PERIODS) + 1):
        same = np.flatnonzero(ids[q:] == ids[:-q])
        if len(same) < _least(q) - q:
            continue
        first, last = _stretches(same)
        enough = last - first + 1 + q >= _least(q)
        for a, b in zip(first[enough].tolist(), last[enough].tolist()):
            yield a, b + 1 + q, q


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """The best of every window, by doubling; ``width`` is a power of two."""
    step = 1
    while step < width:
        values = best(values[:-step], values[step:])
        step *= 2
    return values


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of some window of ``width``, all of them where equal.

    The greatest of the minima of all windows around a place is its own hash just then.
    """
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    least = _slide(hashes, width, np.minimum)
    edge = np.zeros(width - 1, hashes.dtype)
    return np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum) == hashes)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of hashes."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def seeds(ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(period, places)``: words at a place and one period later may belong to a run.

    ``ids`` holds texts one after another, the longest first, ``ends`` their ends. At scale k,
    stretches of k words are hashed, built from two of the scale before, and windows of k/2 of
    them keep their minima. In a run of period q, k/2 < q <= k, of 4 q words, some window and its
    copy one period later lie inside the run, so a minimum repeats at distance q; and as all
    stretches of k >= q words inside one period differ, no equal minimum lies between. So equal
    minimizers that follow each other at a distance of that range are all the seeds there are.
    A scale reads only the texts that are long enough for its periods.
    """
    sizes = np.diff(np.concatenate([[0], ends]))
    hashes = _mixed(ids.astype(np.uint64), np.uint64(0x2545F4914F6CDD1D) ^ ids.astype(np.uint64))
    k = 1
    while k < len(hashes):
        hashes = _mixed(hashes[:-k], hashes[k:])
        k *= 2
        if k <= LAGS:
            continue
        long_enough = np.flatnonzero(sizes >= LEAST_PERIODS * (k // 2 + 1))
        if not len(long_enough):
            return
        hashes = hashes[: ends[long_enough[-1]]]
        found = minimizers(hashes, k // 2)
        order = np.argsort(hashes[found], kind="stable")
        found, values = found[order], hashes[found][order]
        away = np.diff(found)
        near = np.flatnonzero((values[1:] == values[:-1]) & (away > k // 2) & (away <= k))
        if not len(near):
            continue
        by_period = near[np.lexsort((found[near], away[near]))]
        periods, starts = np.unique(away[by_period], return_index=True)
        for q, places in zip(periods.tolist(), np.split(found[by_period], starts[1:])):
            yield q, places


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning, read in parts of growing size."""
    at, part, most = 0, 64, min(len(a), len(b))
    while at < most:
        same = a[at : min(at + part, most)] == b[at : min(at + part, most)]
        if not same.all():
            return at + int(np.argmin(same))
        at += len(same)
        part *= 2
    return most


def seeded_runs(ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(start, end, period)`` of the stretches around seeds; every stretch is read once."""
    for q, places in seeds(ids, ends):
        done = -1
        for x in places.tolist():
            if x < done:
                continue
            right = _agree(ids[x:], ids[x + q :])
            left = _agree(ids[:x][::-1], ids[: x + q][::-1])
            done = x + right
            if left + right + q >= _least(q):
                yield x - left, x + right + q, q


def runs_of(ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs, by start and period.

    A stretch that holds several periods holds its smallest one too, with the same ends, so the
    smallest one found for a stretch is its period.
    """
    smallest: dict[tuple[int, int], int] = {}
    for found in (lag_runs(ids), seeded_runs(ids, ends)):
        for start, end, q in found:
            smallest[start, end] = min(q, smallest.get((start, end), q))
    return sorted((a, b - a, q) for (a, b), q in smallest.items())


def _text_runs(texts: pa.Array):
    """Every text's runs and its words without the repeats, joined by one space."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = split.flatten()
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
    flat = flat.filter(pa.array(real))
    coded = flat.dictionary_encode().indices.to_numpy()
    sizes = np.diff(bounds)
    # the longest text first, and after each text a number that occurs nowhere else
    order = np.argsort(-sizes, kind="stable")
    ends = np.cumsum(sizes[order] + 1)
    starts = ends - sizes[order] - 1
    source = np.repeat(bounds[:-1][order] - starts, sizes[order] + 1) + np.arange(len(coded) + len(sizes))
    breaks = ends - 1
    ids = np.concatenate([coded, [0]])[np.minimum(source, len(coded))].astype(np.int32)
    ids[breaks] = len(coded) + np.arange(len(breaks))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    kept = np.ones(len(flat), bool)
    for start, length, q in runs_of(ids, ends):
        i = int(np.searchsorted(ends, start, "right"))
        at = start - int(starts[i])
        runs[order[i]].append((at, length, q))
        first = int(bounds[order[i]]) + at
        kept[first + q : first + length] = False
    bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
    words = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat.filter(pa.array(kept)).cast(pa.string()))
    return runs, pc.binary_join(words, " ")


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in text_slices(batch):
            runs, collapsed = _text_runs(rows.column("text"))
            made = [[{"start": a, "length": n, "period": q} for a, n, q in r] for r in runs]
            columns = [rows.column("doc_id"), pa.array(made, pa.list_(_RUN)), collapsed]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, runs, collapsed``: every run of repeated words, and the text without repeats.

    Words are split at ASCII white space and numbered from 0. A run is a maximal stretch of words
    with smallest period q, at least ``4 * q`` and at least 6 words long; runs come by start, then
    period. ``collapsed`` leaves out what a run repeats after its first period and joins the other
    words by one space. Texts stay in their rows: nothing is shuffled. Stretches are compared by
    word at the end, so hashes can only waste work; to lose a run, two different stretches of one
    batch would have to share a 64-bit hash at the wrong place.

    Null, empty and blank texts have no runs and an empty ``collapsed``. A null id is carried
    along. Repeated rows give a row each. An empty table gives no rows. Other columns are not read.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return texts.mapInArrow(_found, f"doc_id long, runs {RUNS}, collapsed string")


def most_repeated(runs: Column) -> Column:
    """The run with the greatest length by period, then the smallest start, then the smallest
    period; null where there is none. Ratios are compared exactly."""

    def better(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        tie = (a["start"] < b["start"]) | ((a["start"] == b["start"]) & (a["period"] < b["period"]))
        return (x > y) | ((x == y) & tie)

    return F.reduce(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(better(r, best), r).otherwise(best))
