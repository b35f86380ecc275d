"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborline.llm.text import BREAK, WORD_CHARACTER, let
from harborline.sources.durable import stored

# Matching is leftmost and greedy. Possessive quantifiers give the same matches without
# recursion on long runs, and the look-behinds spare starts inside a run that failed.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
DIGIT_WORD = rf"(?<!{WORD_CHARACTER})[^\x20\x09-\x0D0-9]*+[0-9]{WORD_CHARACTER}*+"

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"  # the kind of spans that the induced patterns add
SUPPORT = 3  # distinct known entities a pattern has to precede
CONFIDENCE = 0.8
SPECIFIC = 5  # code points; shorter words with a digit, as page numbers, support no pattern
SETTLED = 0.01  # confidence that all patterns together may still gain when scoring ends
SENT_PATTERNS = 500_000  # patterns, at most, that travel to the tasks that count their words, some 40 MB

TAIL = 200  # code points before an entity that are looked at first for its context word
RUN = 128  # matches whose places are added up in one fold

_SPAN = "struct<start:int,end:int,value:string,before:string>"


def word_before(gap: Column) -> Column:
    """The last word of a stretch that ends in white space, in lower case: '' where it holds
    no word, null where it ends in one. The whole stretch is read if its tail is too short."""

    def last(part: Column, whole: Column) -> Column:
        in_part = F.when(F.element_at(part, -1) == "", F.lower(F.element_at(part, -2)))
        in_whole = let(F.split(whole, BREAK), lambda ws: F.lower(F.element_at(ws, -2)))
        cut = (F.element_at(part, -1) == "") & (F.size(part) < 3) & (F.length(whole) > TAIL)
        return F.when(F.length(whole) == 0, F.lit("")).when(cut, in_whole).otherwise(in_part)

    return let(F.split(F.substring(gap, -TAIL, TAIL), BREAK), lambda part: last(part, gap))


def located(text: Column, pattern: str) -> Column:
    """``(start, end, value, before)`` of all matches, in code points, end exclusive.

    The text between the matches gives the positions: gap, match, gap, match and so on.
    ``before`` is the last word of the gap, see ``word_before``. Lengths are added up by runs of matches and then
    inside each run, so the work stays in proportion for a text full of matches.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(
        F.split(text, pattern, -1),
        matches,
        lambda gap, m: F.struct(
            (F.length(gap)).alias("gap"), F.length(m).alias("n"), m.alias("m"),
            F.when(m.isNotNull(), word_before(gap)).alias("before"),
        ),
    )
    none = F.array().cast(f"array<{_SPAN}>")

    def placed(run: Column, offset: Column) -> Column:
        def add(acc: Column, p: Column) -> Column:
            begin = acc["at"] + p["gap"]
            span = F.struct(
                begin.alias("start"), (begin + p["n"]).alias("end"), p["m"].alias("value"), p["before"]
            )
            return F.struct((begin + p["n"]).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

        return F.aggregate(run, F.struct(offset.alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])

    def by_runs(real: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(real), F.lit(RUN))
        runs = F.transform(starts, lambda i: F.slice(real, i, RUN))
        sums = F.transform(
            runs, lambda run: F.aggregate(run, F.lit(0), lambda acc, p: acc + p["gap"] + p["n"])
        )
        offsets = F.aggregate(
            sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n))
        )
        return let(
            F.struct(runs.alias("runs"), offsets.alias("offsets")),
            lambda x: F.flatten(F.transform(x["runs"], lambda run, i: placed(run, F.get(x["offsets"], i)))),
        )

    # the last gap has no match; the null value drops it
    real = F.filter(pairs, lambda p: p["m"].isNotNull())
    return let(real, lambda r: F.when(F.size(r) == 0, none).otherwise(by_runs(r)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(value: Column) -> Column:
    """Digits from the right, every second one doubled, and its digits summed."""

    def check(d: Column) -> Column:
        n = F.length(d)
        digit = lambda i: F.substring(d, n - i, F.lit(1)).cast("int")
        term = lambda i: F.when(i % 2 == 0, digit(i)).otherwise(
            2 * digit(i) - F.when(digit(i) > 4, 9).otherwise(0)
        )
        total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + term(i))
        return F.when(n.between(13, 19), total % 10 == 0).otherwise(F.lit(False))

    return let(_digits(value), check)


def _valid_ip(value: Column) -> Column:
    part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of every kind. Texts that cannot hold a kind are passed over by a plain search."""
    none = F.array().cast(f"array<{_SPAN}>")

    def of(hint: str, pattern: str, valid=None) -> Column:
        spans = located(text, pattern)
        return F.when(text.rlike(hint), F.filter(spans, valid) if valid else spans).otherwise(none)

    return {
        "email": F.when(F.contains(text, F.lit("@")), located(text, EMAIL)).otherwise(none),
        "ip": of(r"[0-9]\.[0-9]", IP, lambda s: _valid_ip(s["value"])),
        "card": of(r"[0-9](?:[\x20-]?[0-9]){12}", CARD, lambda s: _luhn(s["value"])),
        "phone": of(r"\+[0-9]", PHONE, lambda s: F.length(_digits(s["value"])).between(9, 15)),
    }


def _printed(kind: str, spans: Column) -> Column:
    return F.transform(
        spans,
        lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")),
    )


def _with_base(docs: DataFrame, doc_id: str, text: str, carried: list[Column]) -> DataFrame:
    """``doc_id, digest, text`` and the spans of each kind; ``digest`` tells texts of one id apart."""
    whole = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(
        *carried,
        F.col(doc_id).cast("string").alias("key"),
        F.md5(F.encode(whole, "UTF-8")).alias("digest"),
        whole.alias("whole"),
    )
    spans = base_spans(F.col("whole"))
    return read.select("*", *[spans[k].alias(k) for k in KINDS])


def contexts(based: DataFrame) -> DataFrame:
    """Every word with a digit and every base entity, with the word before it.

    One row per occurrence: ``key, digest, pattern, of_run, value, start, end, seed``. Only
    texts with a digit or an at sign are looked at; a base entity hides the words it touches.
    The word before may itself be an entity; ``of_run`` is then the last word before that
    is none, so that a list of identifiers shares the word in front of it.
    """
    text = F.col("whole")
    base = F.concat(*[F.col(k) for k in KINDS])
    row = lambda s, seed: F.struct(s["start"], s["end"], s["value"], s["before"], F.lit(seed).alias("seed"))
    seeds = F.transform(base, lambda s: row(s, True))
    tokens = F.transform(located(text, DIGIT_WORD), lambda s: row(s, False))
    rows = based.where(text.rlike("[0-9@]")).select("key", "digest", F.explode(F.concat(seeds, tokens)).alias("o"))
    rows = rows.select("key", "digest", "o.*")
    of_text = Window.partitionBy("key", "digest").orderBy("start", F.desc("seed"), "end")
    earlier = of_text.rowsBetween(Window.unboundedPreceding, -1)
    later = of_text.rowsBetween(1, Window.unboundedFollowing)
    seen_end = F.max(F.when(F.col("seed"), F.col("end"))).over(earlier)
    next_start = F.min(F.when(F.col("seed"), F.col("start"))).over(later)
    hidden = (seen_end > F.col("start")) | (next_start < F.col("end"))
    word = F.when(F.col("before") != "", F.col("before"))
    return (
        rows.withColumn("hidden", F.coalesce(hidden, F.lit(False)))
        .withColumn("of_run", F.last(word, ignorenulls=True).over(earlier))
        .withColumn("previous", F.lower(F.lag("value").over(of_text)))
        .withColumn("pattern", F.when(F.col("before") == "", F.col("previous")).otherwise(F.col("before")))
        .withColumn("of_run", F.when(F.col("before") == "", F.col("of_run")))
        .where("pattern <> '' AND (seed OR NOT hidden)")
        .select("key", "digest", "pattern", "of_run", "value", "start", "end", "seed")
    )


def _in_few_files(rows: DataFrame) -> DataFrame:
    """The rows, stored in no more files than there are cores.

    Every round of the graph stores small tables. Each file costs its writers some processes and
    its readers a request, and with one per shuffle partition a round is mostly that.
    """
    return stored(rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism)))


def word_totals(based: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(pattern, total)``: how often each of the stored, distinct patterns occurs as a word.

    Most words of a corpus precede no instance. Where the patterns are few enough to travel,
    other words go before anything is counted or shuffled, else after the count.
    """
    words = based.select(F.explode(F.split(F.lower("whole"), BREAK)).alias("pattern"))
    total = F.count("*").alias("total")
    if patterns.count() <= SENT_PATTERNS:
        return words.join(F.broadcast(patterns), "pattern", "left_semi").groupBy("pattern").agg(total)
    return words.groupBy("pattern").agg(total).join(patterns, "pattern")


def pattern_scores(based: DataFrame, found: DataFrame) -> DataFrame:
    """``(pattern, confidence, support)`` once the trusted patterns of the pattern-instance graph are settled.

    A pattern is the word before an instance, a base entity or a word with a digit. Its
    confidence is the confidence of what follows it, summed over all occurrences of the word
    in the corpus: one followed by an ordinary word counts against it. It is trusted from
    ``CONFIDENCE`` and ``SUPPORT`` distinct known instances on. Known are base entities, and
    instances of ``SPECIFIC`` code points that a trusted pattern precedes, so that these
    support further patterns. Another such instance is as sure as its patterns are together
    (noisy or). Both only grow; rounds go on until one trusts no further pattern and either
    confidences have settled or none is left that could be trusted. That is a pattern whose
    followers would give the confidence if all that may ever count were sure, and that has the
    support; support only grows with trust. Words that stand before one identifier once or
    twice gain a little in every round for thousands of rounds, the more together the larger
    the corpus, and change nothing. Edges are counted inside the tasks before they are shuffled.
    """
    edges = stored(
        found.groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    )
    totals = word_totals(based, stored(edges.select("pattern").distinct()))
    graph = stored(edges.join(totals, "pattern"))
    instances = _in_few_files(
        graph.groupBy("value").agg(F.max("seed").alias("known"), F.max("seed").cast("double").alias("sure"))
    )
    specific = F.length("value") >= SPECIFIC
    # known values may have any length, but only seeds and specific ones ever count
    counting = F.col("known") | specific
    trusted = (F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT)
    # a sum of doubles may fall short of the bound by its rounding
    hopeful = (F.col("most") >= CONFIDENCE - 1e-6) & (F.col("support") >= SUPPORT) & ~trusted
    before = (0, None)  # nothing is trusted
    while True:
        patterns = _in_few_files(
            graph.join(instances, "value")
            .groupBy("pattern")
            .agg(
                F.least(F.lit(1.0), F.sum(F.col("n") * F.col("sure")) / F.first("total")).alias("confidence"),
                F.count_if("known").alias("support"),
                (F.sum(F.when(counting, F.col("n"))) / F.first("total")).alias("most"),
            )
        )
        now = patterns.agg(
            F.count_if(trusted), F.coalesce(F.sum("confidence"), F.lit(0.0)), F.count_if(hopeful)
        ).first()
        settled = not now[2] or (before[1] is not None and now[1] - before[1] <= SETTLED)
        if now[0] == before[0] and settled:
            return patterns.drop("most")
        before = now
        doubt = F.log1p(-F.least("confidence", F.lit(1 - 1e-9)))
        instances = _in_few_files(
            graph.join(patterns, "pattern")
            .groupBy("value")
            .agg(F.max("seed").alias("seed"), F.max(trusted).alias("led"), F.sum(doubt).alias("doubt"))
            .select("value", (F.col("seed") | (F.col("led") & specific)).alias("known"), "doubt")
            .select(
                "value",
                "known",
                F.when(F.col("known"), 1.0).when(specific, 1 - F.exp("doubt")).otherwise(0.0).alias("sure"),
            )
        )


def discovered(based: DataFrame) -> DataFrame:
    """``key, digest, found``: the spans after trusted patterns, of texts that have any."""
    found = stored(contexts(based))
    trusted = stored(
        pattern_scores(based, found)
        .where((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT))
        .select("pattern")
    )
    led = found.where("NOT seed")
    spans = led.join(trusted, "pattern", "left_semi").unionByName(
        led.join(trusted, led["of_run"] == trusted["pattern"], "left_semi")
    )
    return stored(
        spans.select("key", "digest", F.struct("start", "end", "value", F.lit("").alias("before")).alias("span"))
        .distinct()
        .groupBy("key", "digest")
        .agg(F.sort_array(F.collect_list("span")).alias("found"))
    )


def _same_text(left: DataFrame, right: DataFrame) -> Column:
    return left["key"].eqNullSafe(right["key"]) & (left["digest"] == right["digest"])


def find_personal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts and places of personal data in every text.

    ``n_email`` to ``n_phone`` and ``base_sha256`` tell the fixed patterns' spans; ``spans``
    lists them and after them the spans of kind ``id``, words with a digit after a trusted
    context. A span is ``kind:start:end`` in code points, the end exclusive.

    Null and empty texts have no spans. Rows with one id and different texts are told apart
    by the text; equal rows have equal results. A null id is carried along. An empty table
    gives no rows. Further columns of the input are not read.
    """
    id_column = F.col(doc_id).alias("id_out")
    based = _with_base(docs, doc_id, text, [id_column])
    printed = [_printed(k, F.col(k)) for k in KINDS]
    slim = based.select(
        "id_out", "key", "digest",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.concat(*printed).alias("base"),
    )
    extra = discovered(based)
    joined = slim.join(extra, _same_text(slim, extra), "left")
    more = F.coalesce(_printed(FOUND, F.col("found")), F.array().cast("array<string>"))
    return joined.select(
        F.col("id_out").alias("doc_id"),
        *[f"n_{k}" for k in KINDS],
        F.sha2(F.encode(F.array_join("base", ","), "UTF-8"), 256).alias("base_sha256"),
        F.array_join(F.concat("base", more), ",").alias("spans"),
    )


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the
    first one names the stretch, and what they cover together goes."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        parts = F.concat(acc["parts"], F.array(kept, F.concat(F.lit("["), s["kind"], F.lit("]"))))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh, parts).otherwise(acc["parts"]).alias("parts"),
        )

    def tail(acc: Column) -> Column:
        rest = F.substring(text, acc["at"] + 1, F.length(text))
        return F.concat(F.array_join(acc["parts"], ""), rest)

    return F.aggregate(F.sort_array(spans), start, add, tail)


def _tagged(kind: str, spans: Column) -> Column:
    return F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with all personal data masked, and all their columns.

    Only texts with a digit or an at sign can hold any; the others pass through unread. A
    null text stays null.
    """
    suspect = F.coalesce(F.col(text).rlike("[0-9@]"), F.lit(False))
    plain, held = docs.where(~suspect), docs.where(suspect)
    extra = discovered(_with_base(docs, doc_id, text, []))
    based = _with_base(held, doc_id, text, [F.struct("*").alias("row")])
    joined = based.join(extra, _same_text(based, extra), "left")
    found = F.coalesce("found", F.array().cast(f"array<{_SPAN}>"))
    tagged = [_tagged(k, F.col(k)) for k in KINDS] + [_tagged(FOUND, found)]
    masked = mask(F.col("whole"), F.concat(*tagged))
    columns = [masked.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return plain.unionByName(joined.select(*columns))
