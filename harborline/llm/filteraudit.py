"""What every filter removes under every order of the filters, without replaying the orders."""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.text import let, words
from harborline.sources.durable import stored

MOST_FILTERS = 6  # the orders are listed: 720 at most
COPIES = "E"
COUNTED = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_facts(text: Column) -> Column:
    """Struct of what the filters read of a text. A null text is an empty one."""
    whole = F.coalesce(text, F.lit(""))
    return let(
        words(text),
        lambda ws: F.struct(
            F.size(ws).alias("n_words"),
            F.size(F.array_distinct(ws)).alias("n_distinct"),
            F.length(whole).alias("n_chars"),
            F.length(F.regexp_replace(whole, "[^A-Z]+", "")).alias("n_upper"),
            whole.rlike(r"[#$%&*|]").alias("has_symbol"),
        ),
    )


FILTERS: dict[str, Callable[[Column], Column]] = {
    "A": lambda f: f["n_words"] < 200,
    "B": lambda f: 100 * f["n_distinct"].cast("long") < 50 * f["n_words"].cast("long"),
    "C": lambda f: 100 * f["n_upper"].cast("long") > 3 * f["n_chars"].cast("long"),
    "D": lambda f: f["has_symbol"],
}


def lehmer_rank(prefix: tuple[int, ...], n: int) -> int:
    """Rank of the first of all permutations of ``range(n)`` that start with the prefix."""
    rank = 0
    for i, x in enumerate(prefix):
        unused_before = x - sum(y < x for y in prefix[:i])
        rank += unused_before * factorial(n - 1 - i)
    return rank


def step_intervals(n: int) -> list[tuple[int, int, int, int, str]]:
    """``(mask, step, lo, hi, what)``: for the orders with ranks from ``lo`` to before ``hi``,
    a document that fails the filters of ``mask`` is ``what`` at the step.

    All orders with one prefix are neighbours in rank, and whether a document is kept, removed
    or was already gone follows from the prefix. Neighbouring intervals are merged.
    """
    found: dict[tuple[int, int, str], list[list[int]]] = {}
    for step in range(1, n + 1):
        for prefix in permutations(range(n), step):
            lo = lehmer_rank(prefix, n)
            hi = lo + factorial(n - step)
            before, here = sum(1 << x for x in prefix[:-1]), 1 << prefix[-1]
            for mask in range(1 << n):
                if mask & before:
                    if not mask & here:
                        continue
                    what = "redundant"
                else:
                    what = "removed" if mask & here else "kept"
                spans = found.setdefault((mask, step, what), [])
                if spans and spans[-1][1] == lo:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
    return [(m, s, lo, hi, what) for (m, s, what), spans in found.items() for lo, hi in spans]


def mask_counts(
    docs: DataFrame,
    labels: DataFrame,
    filters: dict[str, Callable[[Column], Column]],
    doc_id: str,
    text: str,
    part: str,
) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents by the set of filters that they fail.

    Texts are compared by their SHA-256 digest. The smallest id of every text is found by a
    group-by and marked by a join on text and id together, so that a text with a third of all
    rows is spread over all tasks.
    """
    facts = text_facts(F.col(text))
    mask = let(facts, lambda f: sum((fails(f).cast("int") * (1 << i) for i, fails in enumerate(filters.values())), F.lit(0)))
    slim = stored(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
            mask.alias("mask"),
        )
    )
    first = slim.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"))
    rows = slim.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")).alias("r")
    is_first = (F.col("r.digest") == F.col("f.digest")) & (F.col("r.doc_id") == F.col("f.first"))
    copy = F.col("first").isNull() & F.col("r.doc_id").isNotNull()
    marked = rows.join(first.alias("f"), is_first, "left").select(
        # a row without an id has no label; its key only spreads it
        F.coalesce("doc_id", F.xxhash64("r.digest")).alias("key"),
        F.col("doc_id").isNotNull().alias("has_id"),
        "part",
        (F.col("mask") + copy.cast("int") * (1 << len(filters))).alias("mask"),
        "n",
    )
    labelled = labels.groupBy(F.col("doc_id").cast("long").alias("key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    joined = marked.join(labelled, "key", "left")
    counted = lambda c: F.sum(F.when(F.col("has_id") & (F.col(c) == 1), F.col("n")).otherwise(0))
    return joined.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), counted("good").alias("good"), counted("toxic").alias("toxic")
    )


def replay(counts: DataFrame, letters: str) -> DataFrame:
    """The audit of ``counts(part, mask, n, good, toxic)``: one row per part, order and step.

    Every count is added where an interval of ranks begins and taken off where it ends; a sum
    over the ranks of one part and step, at most 720 rows, turns these differences into the
    totals of all orders.
    """
    spark, n = counts.sparkSession, len(letters)
    orders = factorial(n)
    counts = stored(counts)
    intervals = spark.createDataFrame(step_intervals(n), "mask int, step int, lo int, hi int, what string")
    ends = F.array(
        F.struct(F.col("lo").alias("rank"), F.lit(1).alias("sign")),
        F.struct(F.col("hi").alias("rank"), F.lit(-1).alias("sign")),
    )
    at_ends = (
        counts.join(F.broadcast(intervals), "mask")
        .select("*", F.explode(ends).alias("end"))
        .select("part", "step", "end.rank", "end.sign", "mask", "what", "n", "good", "toxic")
        .where(F.col("rank") < orders)
    )
    is_what = lambda what: (F.col("what") == what).cast("int") * F.col("sign")
    alone = (F.bit_count("mask") == 1).cast("int")
    changes = at_ends.select(
        "part",
        "step",
        "rank",
        (is_what("kept") * F.col("n")).alias("kept"),
        (is_what("removed") * F.col("n")).alias("removed"),
        (is_what("redundant") * F.col("n")).alias("redundant"),
        (is_what("removed") * alone * F.col("n")).alias("unique_fails"),
        (is_what("removed") * F.col("good")).alias("good_lost"),
        (is_what("removed") * F.col("toxic")).alias("toxic_lost"),
    )
    nothing = (
        counts.select("part")
        .distinct()
        .select("part", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
        .select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("rank"))
        .select("*", *[F.lit(0).cast("long").alias(c) for c in COUNTED])
    )
    by_rank = changes.unionByName(nothing).groupBy("part", "step", "rank").agg(
        *[F.sum(c).alias(c) for c in COUNTED]
    )
    so_far = Window.partitionBy("part", "step").orderBy("rank")
    totals = by_rank.select("part", "step", "rank", *[F.sum(c).over(so_far).alias(c) for c in COUNTED])
    listed = spark.createDataFrame(
        [(r, "".join(p)) for r, p in enumerate(permutations(letters))], "rank int, filter_order string"
    )
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    whole = Window.partitionBy("part", letter)  # at most 720 rows
    return totals.join(F.broadcast(listed), "rank").select(
        "part", "filter_order", "step", *COUNTED, F.sum("removed").over(whole).alias("shapley")
    )


def audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: dict[str, Callable[[Column], Column]] | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> DataFrame:
    """How the filters interact: for every part, order of the filters and step, how many
    documents are ``kept`` after the step, ``removed`` by it, ``redundant`` (failing it, but
    removed earlier), ``unique_fails`` (failing only it), and how many of the removed are labelled
    good or toxic; ``shapley`` sums what the step's filter removes over all orders.

    ``filters`` maps a letter to a condition on ``text_facts``, true where a text fails. The last
    filter, ``E``, fails texts that equal the text of a smaller id anywhere in the table. Only the
    counts by part and set of failed filters are replayed, so the work after one pass over the
    texts does not grow with the documents.

    A null text is empty, a null part is the part ``''``. A row without an id is no copy, has no
    copies and no labels. Repeated rows count each; rows that share id and text are no copies of
    each other. An id with several labels is good or toxic if one of them says so. An empty table
    has no parts and gives no rows; without labels nothing is lost. Other columns are not read.
    """
    filters = FILTERS if filters is None else filters
    letters = "".join([*filters, COPIES])
    if len(letters) > MOST_FILTERS or list(letters) != sorted(set(letters)):
        raise ValueError(f"filters have to be up to {MOST_FILTERS - 1} letters before {COPIES}, in order")
    return replay(mask_counts(docs, labels, filters, doc_id, text, part), letters)
