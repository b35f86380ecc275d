"""Packing documents into windows of a fixed number of tokens by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborline.llm.ranks import buckets_for, numbered
from harborline.llm.tokens import default_vocabulary, encoder
from harborline.llm.wordhash import in_small_batches, text_slices
from harborline.sources.durable import stored

WINDOW = 2048
END_ID = 1
TOLERANCE = 8  # tokens of padding that a window may keep; beyond it documents are cut further

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, parts array<long>"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def binary_parts(length: int) -> list[int]:
    """Powers of two that make the length, the largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def _pieces_of(path: str, window: int, end_id: int):
    """Every document as full windows and a rest, with a checksum of the ids of each.

    ``parts`` holds the checksums of a rest's binary parts, for the few that are cut again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for rows in text_slices(batch):
                ids, bounds = encode(rows.column("text"))
                made = []
                for d, a, b in zip(rows.column("doc_id").to_pylist(), bounds[:-1], bounds[1:]):
                    own = np.append(ids[a:b], np.uint32(end_id))
                    for s in range(0, len(own), window):
                        piece = own[s : s + window]
                        parts = []
                        if len(piece) < window:
                            cuts = np.cumsum([0, *binary_parts(len(piece))])
                            parts = [_crc(piece[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]
                        made.append((d, s, len(piece), _crc(piece), len(own), parts))
                columns = list(zip(*made))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "parts"]
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], names=names
                )

    return run


def best_fill(counts: dict[int, int], target: int) -> dict[int, int]:
    """The multiset of remaining lengths whose sum comes closest to the target from below.

    Bit t of a Python integer tells whether some choice sums to t. Lengths are added from
    the longest on, each as often as it is left, until the target is met; the choice is
    traced back through the bitsets kept before every length.
    """
    everything = (1 << (target + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= target and counts[x]), reverse=True):
        steps.append((length, reach))
        left, block = min(counts[length], target // length), 1
        while left:
            take = min(block, left)
            reach |= (reach << (length * take)) & everything
            left -= take
            block *= 2
        if reach >> target & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        while not before >> at & 1:
            at -= length
            chosen[length] = chosen.get(length, 0) + 1
    return chosen


@dataclass
class Plan:
    """Which pieces share a window, in arrays ordered by length and rank.

    Pieces of one length with ranks from ``first`` on belong to one row: ``per`` of them
    go to each window from ``window`` on, side by side from ``offset``. In rows with
    ``window`` -1 they are cut into binary parts, which ``cut_rank`` numbers by size.
    """

    length: np.ndarray
    first: np.ndarray
    per: np.ndarray
    window: np.ndarray
    offset: np.ndarray
    cut_rank: np.ndarray  # one column per bit
    cut_base: np.ndarray  # address of the first part of each size on the tape of parts
    cut_total: int
    windows: int


def plan_windows(counts: dict[int, int], window: int = WINDOW, tolerance: int = TOLERANCE) -> Plan:
    """Minimum bin slack over the counts of lengths.

    The longest remaining piece opens a window, a subset-sum choice of the others fills it,
    and the same choice is used as long as the counts allow. So the work depends on the
    number of lengths, at most ``window``, and not on the number of pieces. Choices that
    leave more slack than the tolerance are cut into powers of two, which fill windows
    without a gap.
    """
    left = {x: n for x, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    rows, cut, n_windows = [], [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        fill = best_fill(rest, window - longest) if window > longest else {}
        choice = dict(fill)
        choice[longest] = choice.get(longest, 0) + 1
        slack = window - sum(x * k for x, k in choice.items())
        times = min(left[x] // k for x, k in choice.items())
        offset = 0
        for x in sorted(choice, reverse=True):
            k = choice[x]
            at = (x, used[x], k, n_windows if slack <= tolerance else -1, offset)
            (rows if slack <= tolerance else cut).append((at, times * k))
            offset += x * k
            used[x] += times * k
            left[x] -= times * k
            if not left[x]:
                del left[x]
        if slack <= tolerance:
            n_windows += times
    bits = (window - 1).bit_length()
    seen = np.zeros(bits, np.int64)
    full = []
    for at, n in rows:
        full.append((*at, np.zeros(bits, np.int64)))
    for at, n in cut:
        full.append((*at, seen.copy()))
        seen += n * np.array([at[0] >> b & 1 for b in range(bits)])
    full.sort(key=lambda r: r[:2])
    column = lambda i: np.array([r[i] for r in full], np.int64)
    sizes = seen << np.arange(bits)
    base = np.concatenate([np.cumsum(sizes[::-1])[::-1][1:], [0]])
    ranks = np.array([r[5] for r in full], np.int64).reshape(len(full), bits)
    return Plan(column(0), column(1), column(2), column(3), column(4), ranks, base, int(sizes.sum()), n_windows)


def _placed(plan: Plan, window: int):
    """Rows of ranked pieces to rows of placed pieces; the plan travels with the task."""
    key = plan.length << np.int64(48) | plan.first
    tail = plan.cut_total % window
    tail_ends = np.cumsum([0, *binary_parts(tail)]) if tail else np.array([0])
    last = plan.cut_total // window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = {c: batch.column(c).to_numpy() for c in ("start", "length", "ids_crc32", "rank")}
            row = np.searchsorted(key, f["length"] << np.int64(48) | f["rank"], "right") - 1
            at = f["rank"] - plan.first[row]
            sequence = plan.window[row] + at // plan.per[row]
            offset = plan.offset[row] + at % plan.per[row] * f["length"]
            whole = np.flatnonzero(plan.window[row] >= 0)
            source, start, length, crc, where, place = (
                [whole], [f["start"][whole]], [f["length"][whole]], [f["ids_crc32"][whole]],
                [sequence[whole]], [offset[whole]],
            )
            for i in np.flatnonzero(plan.window[row] < 0):
                sizes = np.array(binary_parts(int(f["length"][i])))
                bits = np.log2(sizes).astype(int)
                address = plan.cut_base[bits] + (plan.cut_rank[row[i], bits] + at[i]) * sizes
                over = address // window
                spot = address % window
                # the end of the tape: one sequence per power of two
                k = np.where(over == last, np.searchsorted(tail_ends, spot, "right") - 1, 0)
                source.append(np.full(len(sizes), i))
                start.append(f["start"][i] + np.cumsum(sizes) - sizes)
                length.append(sizes)
                crc.append(np.array(batch.column("parts")[int(i)].as_py()))
                where.append(plan.windows + over + k)
                place.append(spot - np.where(over == last, tail_ends[k], 0))
            taken = pa.array(np.concatenate(source))
            arrays = {
                "doc_id": batch.column("doc_id").take(taken),
                "start": np.concatenate(start),
                "length": np.concatenate(length),
                "ids_crc32": np.concatenate(crc),
                "doc_tokens": batch.column("doc_tokens").take(taken),
                "sequence_id": np.concatenate(where),
                "offset": np.concatenate(place),
            }
            yield pa.RecordBatch.from_arrays([pa.array(arrays[c], pa.int64()) for c in _OUT], names=_OUT)

    return run


_OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    vocabulary: str | None = None,
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece.

    A document's ids end with ``end_id``. What fills whole windows is cut off first; the
    rests are packed by minimum bin slack. The counts of their lengths, at most ``window``
    numbers, are all that the driver plans on; a piece finds its place by its rank among
    the pieces of its length. Few windows keep up to 8 tokens of padding, and the last
    pieces are cut into powers of two, so their sequences are full or a power of two long.

    Null and empty texts are one piece, the end id. Repeated rows are packed each. A null id
    is carried along. An empty table gives no rows. Further columns are not read.
    """
    path = vocabulary or default_vocabulary()
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = stored(in_small_batches(texts).mapInArrow(_pieces_of(path, window, end_id), _PIECE))
    found = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()
    counts = {r["length"]: r["n"] for r in found}
    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    slim = numbered(pieces, ["length"], order, buckets_for(sum(counts.values())), "rank")
    schema = ", ".join(f"{c} long" for c in _OUT)
    if not counts:
        return docs.sparkSession.createDataFrame([], schema)
    return slim.mapInArrow(_placed(plan_windows(counts, window), window), schema)


def sequences(
    docs: DataFrame,
    placed: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    end_id: int = END_ID,
    vocabulary: str | None = None,
) -> DataFrame:
    """``sequence_id, ids``: the packed windows themselves, for ``placed`` rows of ``pack``.

    Texts are encoded again where they lie and cut at the placed pieces; only the pieces are
    shuffled, and a sequence gathers at most a window of ids. Ids of documents have to be
    distinct here.
    """
    path = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for rows in text_slices(batch):
                ids, bounds = encode(rows.column("text"))
                made = []
                for pieces, a, b in zip(rows.column("pieces").to_pylist(), bounds[:-1], bounds[1:]):
                    own = np.append(ids[a:b], np.uint32(end_id))
                    for p in pieces:
                        part = own[p["start"] : p["start"] + p["length"]]
                        made.append((p["sequence_id"], p["offset"], part.tolist()))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=["sequence_id", "offset", "ids"]
                )

    by_doc = placed.groupBy(F.col("doc_id").alias("_doc")).agg(
        F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces")
    )
    joined = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(
        by_doc, F.col("_id").eqNullSafe(F.col("_doc"))
    )
    cut_up = joined.select("text", "pieces").mapInArrow(cut, "sequence_id long, offset long, ids array<int>")
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return cut_up.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda s: s["ids"])).alias("ids"))
