"""Licence scans: an exact set-similarity join between word windows of texts and licence templates.

Built-in functions only. Sets of words are compared: a window meets a template if it holds at least ``CONTAINMENT`` of
the template's distinct words. A window is ``SPAN`` times as many words as the template has, wherever lines end: notices
are wrapped over lines, and words far apart in a text without line ends are no notice. Every place is covered, as windows
start at each of the template's words, but only in texts that hold enough of them. Words of templates are counted over all texts (in how many each occurs) and ordered
from rare to frequent; in that order, with ``need`` the least number of words to share,

* prefix filter: one of the first ``size - need + 1`` words of the template must be in the window,
* length filter: the window must hold ``need`` template words at all,
* positional filter: from the first shared word on, both sides must have ``need`` words left.

What passes is verified by the full intersection, so the join is exact. Templates are a fixed list, so its words (read by
the driver with their counts) and the index over its prefixes are bounded by that list, not by the data.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changefeed.llm.common import keyed, materialise

CONTAINMENT, SPAN = 0.9, 2
# A word: no ASCII control, space or sign. With capitals allowed, the words of a text and of its lower-cased form are the same.
INSIDE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
OUTSIDE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
# Phrases and their labels.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
# The opening words of public licences and usual notices, by label.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def word_list(text: Column) -> Column:
    """Lower-case words of a text; the first and last may be empty strings, which no template has."""
    return F.split(F.lower(text), OUTSIDE + "+")


def phrase_pattern(phrases: list[str]) -> str:
    any_of = "|".join(p.replace(" ", OUTSIDE + "+") for p in phrases)
    return f"(?i)(?<!{INSIDE})(?:{any_of})(?!{INSIDE})"


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(INSIDE + "+")).cast("long")


def phrase_facts(docs: DataFrame) -> DataFrame:
    """n_words, n_base, first_word, last_word and base (array of labels) of documents with their ``words``."""
    every, text, words = phrase_pattern(list(PHRASES.values())), F.col("text"), F.col("words")
    empty = (F.element_at(words, 1) == "").cast("long") + ((F.size(words) > 1) & (F.element_at(words, -1) == "")).cast("long")
    found = F.when(F.array_contains(words, "license"), F.regexp_count(text, F.lit(every))).otherwise(F.lit(0)).cast("long")
    before_last = F.regexp_extract(text, f"(?s)^(.*){every}", 1)
    labels = F.array_sort(
        F.filter(F.array(*[F.when(text.rlike(phrase_pattern([p])), F.lit(k)) for k, p in PHRASES.items()]), lambda x: x.isNotNull())
    )
    some = F.col("n_base") > 0
    return (
        docs.withColumn("n_words", F.size(words).cast("long") - empty)
        .withColumn("n_base", found)
        .withColumn("first_word", F.when(some, count_words(F.split(text, every, 2)[0])))
        .withColumn("last_word", F.when(some, count_words(before_last)))
        .withColumn("base", F.when(some, labels).otherwise(F.array().cast("array<string>")))
    )


def _rows(spark, rows: list[tuple], names: str) -> DataFrame:  # noqa: ANN001
    """A small frame of literals."""
    fields = names.split()
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, r)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


class Templates:
    """Distinct words of each template, how many a match needs, and all words of all templates."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> None:
        self.labels = [label for label, _ in templates]
        kept = ["".join(c if c.isalnum() else " " for c in text.lower()).split() for _, text in templates]
        self.sets = [list(dict.fromkeys(words)) for words in kept]
        self.lengths = [SPAN * len(words) for words in kept]
        self.needs = [max(1, math.ceil(containment * len(s) - 1e-9)) for s in self.sets]
        self.vocabulary = sorted({w for s in self.sets for w in s})

    def able(self, present: Column) -> list[Column]:
        """Whether a set of words reaches each template."""
        return [F.size(F.array_intersect(present, F.lit(s))) >= n for s, n in zip(self.sets, self.needs)]

    def may_match(self, present: Column) -> Column:
        """Whether a set of words reaches any template: no window of a text that fails can match."""
        return reduce(lambda x, y: x | y, self.able(present))


def prepared(docs: DataFrame, templates: Templates) -> DataFrame:
    """One pass over keyed texts, written once: facts, template words present, and the text where a window may match."""
    words = docs.withColumn("words", word_list(F.col("text")))
    facts = phrase_facts(words).withColumn("present", F.array_intersect("words", F.lit(templates.vocabulary)))
    text = F.when(templates.may_match(F.col("present")), F.col("text")).alias("text")
    names = ("rid", "doc_id", "n_words", "n_base", "first_word", "last_word", "base", "present")
    return materialise(facts.select(*names, text), "licences")


def lines(maybe: DataFrame, templates: Templates, rank: dict[str, int], prefix: list[str]) -> DataFrame:
    """rid, block, of (null: any template) and ranks of the template words of each line with a prefix word."""
    spark = maybe.sparkSession
    said = maybe.select("rid", F.posexplode(F.split("text", "\n")).alias("block", "said"))
    said = said.select("rid", "block", F.array_distinct(word_list(F.col("said"))).alias("words"))
    said = said.where(F.arrays_overlap("words", F.lit(prefix)))
    known = _rows(spark, [(w, r) for w, r in rank.items()], "known rank")
    words = said.select("rid", "block", F.explode("words").alias("word")).join(known, F.col("word") == F.col("known"))
    blocks = words.groupBy("rid", "block").agg(F.array_sort(F.collect_list("rank")).alias("ranks"))
    return blocks.select("rid", "block", F.lit(None).cast("int").alias("of"), "ranks")


def windows(maybe: DataFrame, templates: Templates, rank: dict[str, int], prefix: list[str]) -> DataFrame:
    """rid, block (place of the first word), of (template) and ranks of its words in each window that starts with one.

    Any window can be moved on to its first word of the template without losing one. The words of a template in one text
    are one group, no larger than the text; a window reaches over ``length`` words of any kind.
    """
    spark = maybe.sparkSession
    able = F.array(*[F.when(a, F.lit(t)) for t, a in enumerate(templates.able(F.col("present")))])
    able = F.filter(able, lambda t: t.isNotNull()).alias("able")
    said = maybe.select("rid", able, F.posexplode(word_list(F.col("text"))).alias("block", "word"))
    of = [(w, t, rank[w], n) for t, (s, n) in enumerate(zip(templates.sets, templates.lengths)) for w in s]
    known = _rows(spark, of, "known of rank length")
    words = said.join(known, (F.col("word") == F.col("known")) & F.array_contains("able", F.col("of")))
    ahead = Window.partitionBy("rid", "of").orderBy("block").rangeBetween(0, max(templates.lengths) - 1)
    words = words.withColumn("near", F.collect_list(F.struct("block", "rank")).over(ahead))
    inside = F.filter("near", lambda x: x["block"] < F.col("block") + F.col("length"))
    return words.select("rid", "block", "of", F.array_sort(F.array_distinct(inside["rank"])).alias("ranks"))


def template_matches(rows: DataFrame, templates: Templates, blocks_of: Callable = lines) -> DataFrame:
    """rid, line (or place of the first word), label and score of every block that meets a template."""
    spark = rows.sparkSession
    counts = rows.select(F.explode("present").alias("word")).groupBy("word").count()
    frequency = {r["word"]: r["count"] for r in counts.collect()}  # at most the templates' words
    order = sorted(templates.vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index, whole = [], []
    for t, (label, s, need) in enumerate(zip(templates.labels, templates.sets, templates.needs)):
        ranks = sorted(rank[w] for w in s)
        whole.append((t, label, len(ranks), need, ranks))
        index += [(r, t, i, len(ranks), need) for i, r in enumerate(ranks[: len(ranks) - need + 1])]
    prefix = [order[r] for r in sorted({x[0] for x in index})]
    maybe = rows.where(F.col("text").isNotNull() & F.arrays_overlap("present", F.lit(prefix)))
    blocks = blocks_of(maybe, templates, rank, prefix).where(F.size("ranks") >= min(templates.needs))
    places = blocks.select("rid", "block", "of", "ranks", F.size("ranks").alias("held"), F.posexplode("ranks").alias("j", "token"))
    met = places.join(_rows(spark, index, "key t i size need"), F.col("token") == F.col("key"))
    met = met.where((F.col("held") >= F.col("need")) & (F.least(F.col("size") - F.col("i"), F.col("held") - F.col("j")) >= F.col("need")))
    pairs = met.where(F.coalesce(F.col("of") == F.col("t"), F.lit(True))).groupBy("rid", "block", "t").agg(F.first("ranks").alias("ranks"))
    full = _rows(spark, whole, "u label size need whole")
    shared = F.size(F.array_intersect("ranks", "whole"))
    verified = pairs.join(full, F.col("t") == F.col("u")).withColumn("shared", shared).where("shared >= need")
    return verified.select("rid", F.col("block").alias("line"), "label", (F.col("shared") / F.col("size")).alias("score"))


def scan(docs: DataFrame, templates: Templates | None = None) -> DataFrame:
    """Base facts and all labels of each row of ``docs`` (doc_id, text).

    Null texts are empty: no words, no labels. The score is the best containment of any window that meets a
    template, 0 without one. Repeated rows and null ids each get a row; other columns are left out.
    """
    templates = templates or Templates()
    rows = prepared(keyed(docs), templates)
    matches = template_matches(rows, templates, windows).groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    joined = rows.drop("text", "present").join(matches, "rid", "left")
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
    )
