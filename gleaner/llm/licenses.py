"""License scans: named licences, and an exact set-similarity join of text blocks with notices.

A block is a window of 2 m words at every m-th word, m being a template's number of words
rounded up to a power of two, so each stretch as long as the template lies in one block.
A template is found in a block that holds `share` of its distinct words (containment).

The join: words are put in one global order, rarest in the corpus first. An overlap of o
words between two sets means that they share a word among the first size - o + 1 of each
(prefix filter); blocks of fewer than o template words drop out (length filter), and so do
pairs whose places of the shared word leave room for fewer than o (positional filter).
What is left is verified by intersection. Words that no template has cannot add to an
overlap, so blocks are cut down to the others first.

Everything is DataFrame functions. Templates are an argument, so their size is that of the
program, not of the data; they are broadcast.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shielded

#: Code points of words, and those between them, once A-Z are lower-cased.
_IN, _OUT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of the smallest block's half.
SMALLEST = 8
SHARE = 0.8

# Phrases that name a licence, with its label.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Wording of published licence notices, with the share of distinct words that must stand in a block.
# Short notices, of which another licence's differ in a word or two, must stand as a whole.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", SHARE),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", SHARE),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", SHARE),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", SHARE),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", SHARE),
    ("unlicense", "This is free and unencumbered software released into the public domain", SHARE),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", SHARE),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", 1.0),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", 1.0),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", 0.9),
)


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    words: tuple[str, ...]  # distinct
    half: int
    least: int


def lowered(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def prepared(templates) -> list[Template]:
    """Templates without words are left out."""
    out = []
    for i, (label, text, share) in enumerate(templates):
        if not 0 < share <= 1:
            raise ValueError(f"the share of template {i} must be over 0 and at most 1")
        words = re.findall(_IN + "+", lowered(text))
        distinct = tuple(dict.fromkeys(words))
        if words:
            half = max(SMALLEST, 1 << (len(words) - 1).bit_length())
            out.append(Template(i, label, distinct, half, max(1, math.ceil(round(share * len(distinct), 9)))))
    return out


def low(text: Column) -> Column:
    """A text with A-Z lower-cased, and nothing else."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def once(value: Column, make) -> Column:
    """make(value), with value computed once: only a lambda's argument is, however often it is named."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def words_and_marks(text: Column, vocabulary: list[str]) -> Column:
    """struct(n, m) of a lower-cased text: its number of words, and these, null where the vocabulary hasn't got one."""
    words = F.array_remove(F.split(text, _OUT + "+"), "")
    return once(words, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.transform(x, lambda w: F.when(w.isin(vocabulary), w)).alias("m")))


def array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def corpus_order(marked: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest in all documents first."""
    each = marked.select(F.explode(F.array_compact("m")).alias("w"))
    n = {r.w: r.n for r in each.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a word of the templates
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def blocks(marked: DataFrame, half: int, least: int, words: list[str]) -> DataFrame:
    """(row, block) of the blocks of marked (row, m) with `least` different ones of these words."""
    own = marked.select("row", F.transform("m", lambda w: F.when(w.isin(words), w)).alias("m"))
    own = own.where(F.size(F.array_distinct(F.array_compact("m"))) >= least)
    last = F.greatest(F.ceil(F.size("m") / half) - 2, F.lit(0)).cast("int")
    each = own.select("row", "m", F.explode(F.sequence(F.lit(0), last)).alias("b"))
    each = each.select("row", F.array_distinct(F.array_compact(F.slice("m", F.col("b") * half + 1, 2 * half))).alias("block"))
    return each.where(F.size("block") >= least)


def join(found: DataFrame, templates: list[Template], order: list[str]) -> DataFrame:
    """(rows of found, label, containment) of the pairs of blocks and templates (of one size) that overlap enough."""
    spark = found.sparkSession
    place = {w: i for i, w in enumerate(order)}
    least = min(t.least for t in templates)
    index = []
    for t in templates:
        words = sorted(t.words, key=place.__getitem__)
        index += [(w, j, t.number, t.label, words, t.least) for j, w in enumerate(words[: len(words) - t.least + 1])]
    prefixes = spark.createDataFrame(index, "w string, j int, number int, label string, words array<string>, least int")
    # The intersection has the order of its first argument.
    sets = found.withColumn("block", F.array_intersect(array(order), "block"))
    n = F.size("block")
    probes = sets.select("*", F.posexplode(F.slice("block", 1, n - least + 1)).alias("i", "w"))
    pairs = probes.join(F.broadcast(prefixes), "w")
    i, j, of = F.col("i"), F.col("j"), F.size("words")
    long_enough = (n >= F.col("least")) & (i <= n - F.col("least"))
    room = F.least(i, j) + 1 + F.least(n - i - 1, of - j - 1) >= F.col("least")
    overlap = F.size(F.array_intersect("block", "words"))
    pairs = pairs.where(long_enough & room).withColumn("overlap", overlap).where(F.col("overlap") >= F.col("least"))
    rest = [c for c in found.columns if c != "block"]
    return pairs.select(*rest, "label", (F.col("overlap") / of).alias("containment"))


def similar(marked: DataFrame, templates: list[Template]) -> DataFrame:
    """(row, found, containment): the labels of templates that are found in a row's blocks, and their largest containment.

    marked: a table (row, m).
    """
    order = corpus_order(marked, sorted({w for t in templates for w in t.words}))
    out = None
    for half in sorted({t.half for t in templates}):
        some = [t for t in templates if t.half == half]
        own = {w for t in some for w in t.words}
        words = [w for w in order if w in own]
        pairs = join(blocks(marked, half, min(t.least for t in some), words), some, words)
        out = pairs if out is None else out.union(pairs)
    return out.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))


def places(text: Column, phrase: str) -> Column:
    """struct(n, first, after) of a lower-cased text: how often a phrase's words stand in a row, words before the first place, words after the start of the last.

    A match is the first word alone, the others being looked at ahead, so places may
    overlap. Null without any.
    """
    words = re.findall(_IN + "+", lowered(phrase))
    ahead = "".join(rf"{_OUT}++{re.escape(w)}(?!{_IN})" for w in words[1:])
    pattern = rf"(?<!{_IN}){re.escape(words[0])}(?!{_IN})(?={ahead})"
    count = lambda t: F.regexp_count(t, F.lit(_IN + "+")).cast("long")
    at = once(F.split(text, pattern, -1), lambda x: F.when(F.size(x) > 1, F.struct(
        (F.size(x) - 1).cast("long").alias("n"), count(F.get(x, F.lit(0))).alias("first"), count(F.element_at(x, -1)).alias("after"),
    )))
    return F.when(F.contains(text, F.lit(max(words, key=len))), at)


@shielded
def scan(docs: DataFrame, text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """docs without the text, with n_words, n_base, first_word, last_word, base_labels, labels and score; a row for each row.

    n_base: places where a phrase's words stand consecutively, first_word and last_word
    their smallest and largest start, null without any. base_labels: the labels of those
    phrases; labels: these and those of templates found in a block of the text; both
    distinct, sorted and comma-joined, empty without any. score: 1 with a base label, else
    the largest containment of a template that was found, else 0. A null text counts as
    empty; repeated rows get equal results. Columns of docs with one of the new names are
    replaced.
    """
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    rest = [c for c in docs.columns if c.lower() not in new and c.lower() != text_col.lower()]
    known = prepared(templates)
    vocabulary = sorted({w for t in known for w in t.words})
    facts = once(low(F.coalesce(F.col(text_col), F.lit(""))), lambda t: F.struct(
        words_and_marks(t, vocabulary).alias("w"), *[places(t, phrase).alias(f"p{i}") for i, (phrase, _) in enumerate(phrases)]
    ))
    table = materialise(docs.select(*rest, F.monotonically_increasing_id().alias("_row"), facts.alias("_f")))
    out = table.select(*rest, "_row", F.col("_f.w.n").alias("n_words"), *[F.col(f"_f.p{i}").alias(f"_p{i}") for i in range(len(phrases))])
    none = F.lit(None).cast("long")
    if known:
        found = similar(table.select(F.col("_row").alias("row"), F.col("_f.w.m").alias("m")), known)
        out = out.join(found.toDF("_row", "_found", "_containment"), "_row", "left")
    else:
        out = out.withColumns({"_found": F.lit(None).cast("array<string>"), "_containment": F.lit(None).cast("double")})
    at = [(label, F.col(f"_p{i}")) for i, (_, label) in enumerate(phrases)]
    base = F.array_compact(F.array(*[F.when(p.isNotNull(), F.lit(label)) for label, p in at], F.lit(None).cast("string")))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return out.withColumn("_base", base).select(
        *rest,
        "n_words",
        sum((F.coalesce(p["n"], F.lit(0)) for _, p in at), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.array(*[p["first"] for _, p in at], none)).alias("first_word"),
        F.array_max(F.array(*[F.col("n_words") - p["after"] - 1 for _, p in at], none)).alias("last_word"),
        joined(F.col("_base")).alias("base_labels"),
        joined(F.concat("_base", F.coalesce("_found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce("_containment", F.lit(0.0))).alias("score"),
    )
