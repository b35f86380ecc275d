"""Document fingerprints from closed syncmers over words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.ranks import successors
from harborline.llm.text import let, words
from harborline.sources.durable import stored

INNER = 2  # words of an inner substring
WINDOW = 5  # inner substrings of a k-mer, which so has 6 words
SKETCH = 64  # smallest anchors in the printed digest; likeness reads all anchors
BAND = 32  # words; offsets of matches in two neighbouring bands count as one place


def anchors(text: Column) -> Column:
    """``(hash, at)`` of every closed syncmer of the text, in text order.

    A k-mer of six words is chosen if the smallest hash of its five inner two-word
    substrings is the first or the last one. The choice looks at the k-mer alone, so an
    edit elsewhere in the text moves no anchor. The text is padded on both sides, so any
    text with a word has k-mers; ``at`` is the number of the k-mer's first word.
    """
    pad = F.array_repeat(F.lit(""), WINDOW)

    def chosen(h: Column) -> Column:
        at = lambda i, k: F.get(h, i + k)
        inner = [k for k in range(1, WINDOW - 1)]
        kmers = F.filter(
            F.sequence(F.lit(0), F.size(h) - WINDOW),
            lambda i: F.least(at(i, 0), at(i, WINDOW - 1)) <= F.least(*[at(i, k) for k in inner]),
        )
        return F.transform(
            kmers,
            lambda i: F.struct(
                F.xxhash64(*[at(i, k) for k in range(0, WINDOW, INNER)]).alias("hash"),
                (i - WINDOW).alias("at"),
            ),
        )

    def hashed(ws: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(ws) - INNER), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1))
        )

    none = F.array().cast("array<struct<hash:bigint,at:int>>")
    return let(
        words(text),
        lambda ws: F.when(F.size(ws) == 0, none).otherwise(
            let(F.concat(pad, ws, pad), lambda padded: let(hashed(padded), chosen))
        ),
    )


def _runs(ordered: Column, value) -> Column:
    """Where the runs of equal ``value(element)`` start in a sorted array, its size at the end."""
    places = F.sequence(F.lit(0), F.size(ordered) - 1)
    starts = F.filter(places, lambda i: (i == 0) | (value(F.get(ordered, i)) != value(F.get(ordered, i - 1))))
    return F.concat(starts, F.array(F.size(ordered)))


def _by_run(ordered: Column, value, body) -> Column:
    """``body(elements, index of the first)`` of every run of a sorted array that has elements."""
    return let(
        _runs(ordered, value),
        lambda cuts: F.transform(
            F.slice(cuts, F.lit(1), F.size(cuts) - 1),
            lambda start, k: body(F.slice(ordered, start + 1, F.get(cuts, k + 1) - start), start),
        ),
    )


def numbered(found: Column) -> Column:
    """All anchors as ``(hash, nth, at)``: ``nth`` counts earlier ones of that hash in the text."""

    def entry(a: Column, j: Column) -> Column:
        return F.struct(a["hash"].alias("hash"), j.alias("nth"), a["at"].alias("at"))

    repeated = F.size(F.array_distinct(found.getField("hash"))) < F.size(found)
    by_hash = let(
        F.sort_array(found),
        lambda ordered: F.flatten(
            _by_run(ordered, lambda a: a["hash"], lambda run, _start: F.transform(run, entry))
        ),
    )
    # most texts repeat no anchor and need no order here
    return F.when(repeated, by_hash).otherwise(F.transform(found, lambda a: entry(a, F.lit(0))))


def offsets(a: Column, b: Column) -> Column:
    """How far every anchor of ``a`` moved to its match in ``b``, ascending.

    Both are ``numbered``. The n-th anchor of a hash matches the n-th one of the other text;
    sorted together, matches stand side by side, the one of ``a`` first.
    """

    def sided(anchors_: Column, side: int) -> Column:
        return F.transform(
            anchors_,
            lambda x: F.struct(
                x["hash"].alias("hash"), x["nth"].alias("nth"), F.lit(side).alias("side"), x["at"].alias("at")
            ),
        )

    def moved(both: Column) -> Column:
        pairs = F.zip_with(
            F.slice(both, F.lit(1), F.size(both) - 1),
            F.slice(both, F.lit(2), F.size(both) - 1),
            lambda x, y: F.when((x["hash"] == y["hash"]) & (x["nth"] == y["nth"]), y["at"] - x["at"]),
        )
        return F.sort_array(F.filter(pairs, lambda d: d.isNotNull()))

    return let(
        F.sort_array(F.concat(sided(a, 0), sided(b, 1))),
        lambda both: F.when(F.size(both) < 2, F.array().cast("array<int>")).otherwise(moved(both)),
    )


def consistent(moves: Column) -> Column:
    """The most matches whose offsets lie in one band: two neighbouring stretches of ``BAND`` words."""

    def best(bands: Column) -> Column:
        def fullest(runs: Column) -> Column:
            after = lambda k: F.get(runs, k + 1)
            both = lambda r, k: r["n"] + F.when(after(k)["band"] == r["band"] + 1, after(k)["n"]).otherwise(0)
            return F.array_max(F.transform(runs, both))

        counted = _by_run(
            bands,
            lambda x: x,
            lambda run, start: F.struct(F.get(bands, start).alias("band"), F.size(run).alias("n")),
        )
        return let(counted, fullest)

    bands = F.transform(moves, lambda d: F.floor(d / BAND))
    return let(bands, lambda x: F.when(F.size(x) == 0, F.lit(0)).otherwise(best(x)))


def likeness(a: Column, b: Column) -> Column:
    """Share of the anchors of two texts that match and moved alike.

    Matches count if they lie in the one band of offsets that holds most of them, so blocks
    in another order are not alike, and an insertion of more than ``BAND`` words leaves the
    larger part. Two texts without anchors are alike, 1.
    """
    shares = lambda n: n.cast("double") / (F.size(a) + F.size(b) - n)
    met = F.arrays_overlap(a.getField("hash"), b.getField("hash"))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when(~met, F.lit(0.0))
        .otherwise(let(consistent(offsets(numbered(a), numbered(b))), shares))
    )


def printed(found: Column) -> Column:
    """A short digest of the anchors to print: the 64 smallest distinct hashes, 32 bits of each."""
    hashes = F.transform(found, lambda a: a["hash"].bitwiseAND(F.lit(0xFFFFFFFF)))
    least = F.slice(F.sort_array(F.array_distinct(hashes)), 1, SKETCH)
    return F.array_join(F.transform(least, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The fingerprint of every text and of its edit by the next document.

    The edit replaces the last quarter of a text, in code points, by as many of the first
    code points of the next document in ascending order of ids; the first one follows the
    last. ``near_edited`` is the likeness of the anchors of a text and its edit, matched by
    hash and place over the whole texts, ``near_next`` that of a text and the next document.
    ``fingerprint`` and ``edited_fingerprint`` are short digests of the anchors.

    Null texts are empty. An empty text, or one without words, has an empty fingerprint.
    Rows with one id are each other's equals in the order: the next document is that of the
    next higher id, and of its rows the smallest text counts. A null
    id comes after all others and is nobody's next. An empty table gives no rows. Further
    columns of the input are not read.
    """
    # one key that is never null, so that both joins below read the same shuffle of the texts
    key_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    texts = docs.select(
        F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("null")).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    lengths = stored(
        texts.groupBy(F.expr("try_cast(key AS bigint)").alias("doc_id")).agg(
            F.max(F.length("text")).cast("long").alias("n_chars")
        )
    )
    following = successors(lengths, "doc_id").select(F.col("value").alias("doc_id"), "next")
    first = following.agg(F.min("doc_id")).first()[0]
    order = stored(
        lengths.join(following, "doc_id", "left").withColumn(
            "next", F.coalesce("next", F.lit(first).cast("long"), "doc_id")
        )
    )
    # every document goes to the one before it too; ids are distinct in `order`
    before = order.select(key_of("doc_id").alias("to"), key_of("next").alias("from"))
    following_text = (
        texts.join(before, F.col("key") == F.col("from"))
        .groupBy("to")
        .agg(F.min("text").alias("following"))
    )
    joined = texts.join(following_text, F.col("key") == F.col("to"), "left")
    n, cut = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    after = F.coalesce("following", F.lit(""))
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring(after, F.lit(1), cut))

    def compared(x: Column) -> Column:
        return F.struct(
            printed(x["own"]).alias("fingerprint"),
            printed(x["changed"]).alias("edited_fingerprint"),
            likeness(x["own"], x["changed"]).alias("near_edited"),
            likeness(x["own"], x["of_next"]).alias("near_next"),
            F.size(x["own"]).cast("long").alias("n_anchors"),
        )

    made = joined.withColumn("edited", edited).select(
        F.expr("try_cast(key AS bigint)").alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        let(
            F.struct(
                anchors(F.col("text")).alias("own"),
                anchors(F.col("edited")).alias("changed"),
                anchors(after).alias("of_next"),
            ),
            compared,
        ).alias("found"),
    )
    return made.select("doc_id", "n_chars", "edited_sha256", "found.*")


def anchor_table(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, hash, at)``: every anchor of every text with its place, for joins by anchor.

    A null text, an empty one or one without words has no row; a null id is carried along,
    and equal rows repeat theirs.
    """
    found = docs.select(F.col(doc_id).alias("doc_id"), F.explode(anchors(F.col(text))).alias("a"))
    return found.select("doc_id", "a.hash", "a.at")
