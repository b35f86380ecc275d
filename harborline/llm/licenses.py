"""License scans: an exact containment join of text blocks with license templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborline.llm.text import let
from harborline.sources.durable import stored

THRESHOLD = 80  # per cent of a template's distinct words that a block has to hold
SMALLEST_BLOCK = 4

# fixed values: phrases that name a license wherever their words stand side by side
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# fixed values: public license notices, as (label, text)
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights to this work"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted",
    ),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "All rights reserved"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def license_words(text: Column) -> Column:
    """Words of ASCII letters, digits and all other characters, A-Z in lower case."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(plain, BREAK), "")


def _split(text: str) -> list[str]:
    lower = [c if c > "\x7f" or c.isalnum() else " " for c in text.lower()]
    return "".join(lower).split(" ")


def _words_of(text: str) -> list[str]:
    return [w for w in _split(text) if w]


def needed_words(distinct: int, threshold: int = THRESHOLD) -> int:
    return -(-threshold * distinct // 100)


def block_step(n_words: int) -> int:
    """The power of two, 4 at least, that a template's words fit into."""
    return max(SMALLEST_BLOCK, 1 << (n_words - 1).bit_length())


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def base_places(hits: Column, phrases: dict[str, str]) -> Column:
    """``array<struct<at, label>>`` of the places where a phrase's words stand side by side."""

    def stands(h: Column, j: Column, parts: list[str]) -> Column:
        here = h["w"] == parts[0]
        for k, word in enumerate(parts[1:], 1):
            after = F.get(hits, j + k)
            here = here & F.coalesce((after["w"] == word) & (after["i"] == h["i"] + k), F.lit(False))
        return here

    def found(h: Column, j: Column) -> Column:
        labels = [
            F.when(stands(h, j, _words_of(phrase)), F.struct(h["i"].alias("at"), F.lit(label).alias("label")))
            for phrase, label in phrases.items()
        ]
        return F.array(*labels)

    first = sorted({_words_of(p)[0] for p in phrases})
    starts = F.transform(hits, lambda h, j: F.when(h["w"].isin(first), found(h, j)))
    listed = F.flatten(F.filter(starts, lambda s: s.isNotNull()))
    return F.filter(listed, lambda s: s.isNotNull())


def scanned(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``row, doc_id, n_words, hits, places`` of every row, stored.

    ``hits`` are the row's words that some template or phrase uses, with their places; all other
    words can match nothing. ``row`` is a key of its own, so that repeated ids do no harm.
    """
    vocabulary = sorted({w for t in [*phrases, *[t for _, t in templates]] for w in _words_of(t)})

    def hits_of(ws: Column) -> Column:
        marked = F.transform(
            ws, lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("i"), w.alias("w")))
        )
        return F.struct(
            F.size(ws).cast("long").alias("n_words"), F.filter(marked, lambda h: h.isNotNull()).alias("hits")
        )

    read = docs.select(
        F.col(doc_id).alias("doc_id"), let(license_words(F.col(text)), hits_of).alias("found")
    )
    hits = F.col("found.hits")
    return stored(
        read.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "found.n_words",
            hits.alias("hits"),
            let(hits, lambda h: base_places(h, phrases)).alias("places"),
        )
    )


def _by_rarity(rows: DataFrame, templates: list[tuple[str, str]]) -> list[str]:
    """The templates' words, the rarest of the corpus first; ties by the word.

    Counts of whole words over all rows. There are as many as the templates have words, whatever
    the size of the corpus.
    """
    counted = rows.select(F.explode("hits.w").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    n = {r["w"]: r["n"] for r in counted.collect()}
    return sorted({w for _, t in templates for w in _words_of(t)}, key=lambda w: (n.get(w, 0), w))


def license_blocks(
    rows: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: int = THRESHOLD
) -> DataFrame:
    """``row, doc_id, template, label, first, end, shared, score``: every block that holds at least
    ``threshold`` per cent of a template's distinct words. ``rows`` come from ``scanned``.

    Blocks of a template whose words fit into c, a power of two, are 2c words long and begin at
    every c-th word, so any passage of c words lies inside one. The join is exact:

    * prefix filter: words are ordered by rarity; a block with enough of a template's words holds
      one of its rarest ``size - needed + 1``, so only those words' places are candidates;
    * length filter: the block holds at least ``needed`` distinct words of all templates;
    * positional filter: what stands after the common word in both orders has to be enough, which
      is true of the first common word of every pair that qualifies;
    * the survivors' whole sets are compared.

    A candidate carries the hits around it, as many as its block can have. Templates are joined
    by word and broadcast; they are a parameter and small. No row of two blocks is ever formed.
    """
    if not templates:
        raise ValueError("no templates to look for")
    spark = rows.sparkSession
    order = _by_rarity(rows, templates)
    place = {w: i for i, w in enumerate(order)}
    entries, prefix, reach = [], set(), 0
    for number, (label, text) in enumerate(templates):
        own = sorted(set(_words_of(text)), key=place.__getitem__)
        need = needed_words(len(own), threshold)
        step = block_step(len(_words_of(text)))
        reach = max(reach, 2 * step)
        for p, w in enumerate(own[: len(own) - need + 1]):
            entries.append((w, number, label, p, len(own), need, step, own))
            prefix.add(w)
    fields = ["w", "template", "label", "p", "size", "need", "step"]
    listed = [
        F.struct(*[F.lit(v).alias(c) for c, v in zip(fields, e)], _strings(e[-1]).alias("own")) for e in entries
    ]
    wanted = spark.range(1).select(F.inline(F.array(*listed)))
    around = lambda j: F.slice(F.col("hits"), F.greatest(j - reach, F.lit(0)) + 1, F.lit(2 * reach + 1))
    near = F.transform(
        "hits",
        lambda h, j: F.when(
            h["w"].isin(sorted(prefix)), F.struct(h["w"].alias("w"), h["i"].alias("i"), around(j).alias("near"))
        ),
    )
    candidates = rows.select("row", "doc_id", F.explode(F.filter(near, lambda c: c.isNotNull())).alias("c"))
    number = F.floor(F.col("c.i") / F.col("step")).cast("int")
    joined = (
        candidates.withColumn("w", F.col("c.w"))
        .join(F.broadcast(wanted), "w")
        .withColumn("block", F.explode(F.array(number, number - 1)))
        .where("block >= 0")
        .withColumn("first", F.col("block") * F.col("step"))
        .withColumn("end", F.col("first") + 2 * F.col("step"))
    )
    inside = F.filter("c.near", lambda h: (h["i"] >= F.col("first")) & (h["i"] < F.col("end")))
    ranked = F.array_sort(
        F.filter(
            F.transform(F.array_distinct(inside["w"]), lambda w: F.array_position(_strings(order), w)),
            lambda r: r > 0,
        )
    )
    own_rank = F.array_position(_strings(order), F.col("w"))
    after_here = F.size("set") - F.array_position("set", own_rank)
    enough = (F.size("set") >= F.col("need")) & (
        1 + F.least(F.col("size") - 1 - F.col("p"), after_here) >= F.col("need")
    )
    own_set = F.transform("own", lambda w: F.array_position(_strings(order), w))
    compared = (
        joined.withColumn("set", ranked)
        .where(enough)
        .withColumn("shared", F.size(F.array_intersect("set", own_set)))
        .where("shared >= need")
    )
    return compared.select(
        "row", "doc_id", "template", "label", "first", "end", "shared", (F.col("shared") / F.col("size")).alias("score")
    ).distinct()


def scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: int = THRESHOLD,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score``.

    ``n_base`` counts the places of the phrases, ``first_word`` and ``last_word`` are the smallest
    and greatest of them. ``labels`` adds the templates found by ``license_blocks``. ``score`` is 1
    where a phrase stands, else the greatest share of a template's words that a found block holds,
    else 0.

    Null, empty and blank texts have no words, no labels and score 0. A null id is carried along;
    repeated rows give a row each. An empty table gives no rows. Other columns are not read.
    """
    rows = scanned(docs, templates, phrases, doc_id, text)
    by_row = license_blocks(rows, templates, threshold).groupBy("row").agg(
        F.collect_set("label").alias("found"), F.max("score").alias("best")
    )
    base = F.array_distinct("places.label")
    none = F.array().cast("array<string>")
    listed = lambda labels: F.array_join(F.array_sort(labels), ",")
    return (
        rows.select("row", "doc_id", "n_words", "places")
        .join(by_row, "row", "left")
        .select(
            "doc_id",
            "n_words",
            F.size("places").cast("long").alias("n_base"),
            F.array_min("places.at").cast("long").alias("first_word"),
            F.array_max("places.at").cast("long").alias("last_word"),
            listed(base).alias("base_labels"),
            listed(F.array_union(base, F.coalesce("found", none))).alias("labels"),
            F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        )
    )
