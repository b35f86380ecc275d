"""Quality rules judged per host: failure rates shrunk by an empirical beta prior."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.text import WORD_CHARACTER, let, words
from harborline.sources.durable import stored

LEAST_WORDS = 50
SPREADS = 1.0  # a host whose rate of a rule lies so many standard deviations above the mean fails it
FEWEST, STRONGEST = 1.0, 1e6  # bounds of the prior's weight in documents


def _repeated_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    The windows' 64-bit hashes are compared as a set first; only a text with a repeated
    window sorts them, so equal windows meet side by side.
    """
    n = F.size(ws)
    window = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)),
    )

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            here = lambda j: F.get(s, j)["h"]
            twice = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda j: (F.coalesce(here(j) == here(j - 1), F.lit(False)))
                | (F.coalesce(here(j) == here(j + 1), F.lit(False))),
            )
            at = lambda j: F.get(s, j)["i"]
            return F.size(
                F.array_distinct(F.flatten(F.transform(twice, lambda j: F.array(at(j), at(j) + 1, at(j) + 2))))
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(ordered, count)
        )

    return F.when(n < 3, F.lit(0)).otherwise(let(window, covered))


def text_counts(text: Column) -> Column:
    """Struct of the counts that the rules read. All are 0 for a null text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD_CHARACTER))
    counted = let(
        words(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            _repeated_words(ws).cast("long").alias("n_repeat_words"),
        ),
    )
    by_line = let(
        lines,
        lambda ls: F.struct(
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        ),
    )
    symbols = F.length(whole) - F.length(F.regexp_replace(whole, r"[#*$%&|<>]+", ""))
    return let(
        F.struct(counted.alias("w"), by_line.alias("l"), symbols.cast("long").alias("s")),
        lambda c: F.struct(
            c["w"]["n_words"].alias("n_words"),
            c["w"]["word_chars"].alias("word_chars"),
            c["s"].alias("n_symbols"),
            c["l"]["n_lines"].alias("n_lines"),
            c["l"]["n_dup_lines"].alias("n_dup_lines"),
            c["w"]["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


def base_failed(c: Column) -> Column:
    return (c["n_words"] < LEAST_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def rules(c: Column) -> dict[str, Column]:
    """The rules whose failures are counted by host. True: the document fails.

    They are stricter than the base rules, whose failures go whatever the host.
    """
    return {
        "word_length": (c["word_chars"] < 3 * c["n_words"]) | (c["word_chars"] > 12 * c["n_words"]),
        "symbols": 10 * c["n_symbols"] > c["n_words"],
        "lines": 100 * c["n_dup_lines"] > 30 * c["n_lines"],
        "repeats": 100 * c["n_repeat_words"] > 20 * c["n_words"],
    }


def host_rates(judged: DataFrame) -> DataFrame:
    """``(host, n, rate_<rule>..., above_<rule>...)``: rates shrunk towards the mean over all hosts.

    ``judged`` holds ``host`` and one boolean ``fails_<rule>`` per rule. The prior's mean is
    the rate over all documents, its weight the beta weight that explains the spread of the
    hosts' own rates (method of moments). ``above`` is the distance of a host's rate from the
    mean in standard deviations of the host's own posterior; it is 0 where nothing varies, as
    for a rule that no document or every document fails, or for a single host. Failures are summed inside every task first, so a
    host with a third of all rows costs no more than others. The prior, two numbers per
    rule, comes to the driver.
    """
    names = [c.removeprefix("fails_") for c in judged.columns if c.startswith("fails_")]
    failures = [F.sum(F.col(f"fails_{r}").cast("long")).alias(r) for r in names]
    hosts = stored(judged.groupBy("host").agg(F.count("*").alias("n"), *failures))
    moments = []
    for r in names:
        moments += [F.sum(r).alias(f"f_{r}"), F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"q_{r}")]
    row = hosts.agg(F.sum("n").alias("n"), F.count("*").alias("hosts"), *moments).first()
    shrunk, above = [], []
    for r in names:
        mean = row[f"f_{r}"] / row["n"] if row["n"] else 0.0
        spread = row[f"q_{r}"] / row["n"] - mean * mean if row["n"] else 0.0
        weight = STRONGEST if spread <= 0 else mean * (1 - mean) / spread - 1
        weight = min(max(weight, FEWEST), STRONGEST)
        rate = (F.col(r) + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
        deviation = F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(weight + 1)))
        shrunk.append(rate.alias(f"rate_{r}"))
        above.append(
            F.when((F.lit(spread) > 0) & (deviation > 0), (rate - F.lit(mean)) / deviation)
            .otherwise(F.lit(0.0))
            .alias(f"above_{r}")
        )
    return hosts.select("host", "n", *shrunk, *above)


def _judged(docs: DataFrame, text: str, host: str, carried: list[Column]) -> DataFrame:
    counted = docs.select(*carried, F.col(host).alias("host"), text_counts(F.col(text)).alias("counts"))
    failed = rules(F.col("counts"))
    return counted.select(
        "*",
        base_failed(F.col("counts")).alias("base_failed"),
        *[fails.alias(f"fails_{r}") for r, fails in failed.items()],
    )


def _with_verdict(judged: DataFrame, spreads: float) -> DataFrame:
    names = [c.removeprefix("fails_") for c in judged.columns if c.startswith("fails_")]
    verdicts = stored(
        host_rates(judged).select(
            F.col("host").alias("_host"),
            *[(F.col(f"above_{r}") > spreads).alias(f"bad_{r}") for r in names],
        )
    )
    joined = judged.join(verdicts, F.col("host").eqNullSafe(F.col("_host")), "left")
    held = F.lit(False)
    for r in names:
        held = held | (F.col(f"fails_{r}") & F.coalesce(F.col(f"bad_{r}"), F.lit(False)))
    return joined.withColumn("kept", ~F.col("base_failed") & ~held)


def judge(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    spreads: float = SPREADS,
) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every document.

    A document is dropped if it fails the base rules, or if it fails a rule that its host
    fails. A host fails a rule if its shrunk failure rate lies more than ``spreads`` standard
    deviations of its posterior above the mean of all hosts. A document that passes all rules
    stays whatever its host, and so does one that fails a rule no more usual there than elsewhere.

    Null and empty texts have no words and fail the base rules. A null host is a host of
    its own. Repeated rows are judged alike, and each counts. An empty table gives no rows.
    Further columns of the input are not read.
    """
    judged = stored(_judged(docs, text, host, [F.col(doc_id).alias("doc_id")]))
    return _with_verdict(judged, spreads).select(
        "doc_id",
        "counts.n_words",
        "counts.word_chars",
        "counts.n_symbols",
        "counts.n_dup_lines",
        "counts.n_repeat_words",
        "base_failed",
        "kept",
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", spreads: float = SPREADS) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns.

    Counting is the dear part, so the rows are stored once with their verdicts' inputs and
    neither counted nor shuffled again.
    """
    judged = stored(_judged(docs, text, host, [F.struct("*").alias("row")]))
    return _with_verdict(judged, spreads).where("kept").select("row.*")
