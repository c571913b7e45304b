"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a run of words; blocks overlap so far that every passage as long as the
longest template lies inside one. A block meets a template if it holds a share
``CONTAINMENT`` of the template's different words or more. Tokens are put in one
global order, rarest first, by the number of blocks that hold them. A template of n
tokens of which m are needed has at least one of its first n - m + 1 in every block
that meets it: only blocks with such a prefix token are joined, on that token. The
length filter and the positions of the token on both sides rule out most of the
rest, and what is left is decided by the exact overlap.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offermarket.llm.frames import REST, ascii_lower, field, pack, unpack
from offermarket.staging import stage

WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINMENT = 0.9
#: Characters of templates in all that may be given: their tokens go to every task.
TEMPLATE_CHARS = 1 << 20

# Phrases that count wherever they stand, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Sentences of public licenses and notices, and their labels.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction',
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl-notice",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation",
    ),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("creative-commons", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met",
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def template_words(text: str) -> list[str]:
    """The words of a template, as ``words`` takes them from a document."""
    lower = re.sub("[A-Z]", lambda letter: letter.group().lower(), text)
    return [word for word in re.split(WORD_GAP, lower) if word]


def needed(size: int, containment: float = CONTAINMENT) -> int:
    """Tokens of a template of ``size`` that a block must hold."""
    return max(1, math.ceil(size * containment - 1e-9))


def words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return F.array_remove(F.split(ascii_lower(text), WORD_GAP, -1), "")


def _places(tokens: str, joined: str, phrase: list[str]) -> Column:
    """Where the phrase's words stand one after another; looked for only where the joined words hold it."""
    here = lambda i: F.array(*[F.get(F.col(tokens), i + k) for k in range(len(phrase))])
    wanted = F.array(*[F.lit(word) for word in phrase])
    starts = F.filter(F.sequence(F.lit(0), F.size(tokens) - len(phrase)), lambda i: here(i) == wanted)
    held = F.contains(F.col(joined), F.lit(f" {' '.join(phrase)} "))
    return F.when(held, starts).otherwise(F.array().cast("array<int>"))


def _tokenised(docs: DataFrame, carried: list[str], id_col: str, text_col: str, phrases: dict[str, str], vocabulary: list[str], stride: int) -> DataFrame:
    """Per document: words, places of phrases, and the template tokens of each of its blocks."""
    text = F.coalesce(field(text_col), F.lit(""))
    rows = pack(docs, carried, id=field(id_col), text_key=F.xxhash64(text), words=words(text))
    known = F.array(*[F.lit(token) for token in vocabulary]).cast("array<string>")
    rows = rows.withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).withColumn(
        "known", F.array_intersect(known, "words")
    )
    last = F.greatest(F.lit(0), F.ceil(F.size("words") / F.lit(stride)).cast("int") - 2)
    blocks = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.array_intersect(F.col("known"), F.slice(F.col("words"), i * stride + 1, F.lit(2 * stride))),
    )
    found = [(_places("words", "joined", template_words(phrase)), label) for phrase, label in phrases.items()]
    labels = [F.when(F.size(places) > 0, F.lit(label)) for places, label in found]
    starts = F.flatten(F.array(*[places for places, _ in found])) if found else F.array().cast("array<int>")
    return rows.select(
        REST,
        "id",
        "text_key",
        F.size("words").cast("long").alias("n_words"),
        starts.alias("starts"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels).cast("array<string>")))).alias("base_labels"),
        F.when(F.size("known") > 0, blocks).otherwise(F.array().cast("array<array<string>>")).alias("blocks"),
    )


def _ordered(rows: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest first, by the blocks holding a token: at most one count per token of a template."""
    counts = rows.select(F.explode(F.flatten("blocks")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    held = {row["token"]: row["n"] for row in counts.collect()}
    return sorted(vocabulary, key=lambda token: (held.get(token, 0), token))


def _matches(rows: DataFrame, templates: list[tuple[str, str]], vocabulary: list[str], stride: int, containment: float) -> DataFrame:
    """``id, text_key, template, label, first_word, containment``: every block that meets a template."""
    order = _ordered(rows, vocabulary)
    rank = {token: i for i, token in enumerate(order)}
    index = []
    for number, (label, text) in enumerate(templates):
        tokens = sorted(set(template_words(text)), key=rank.__getitem__)
        least = needed(len(tokens), containment)
        for place, token in enumerate(tokens[: len(tokens) - least + 1]):
            index.append((token, place, number, label, tokens, least))
    prefixes = rows.sparkSession.createDataFrame(
        index, "token string, place int, template int, label string, tokens array<string>, least int"
    )
    firsts = F.array(*[F.lit(token) for token in sorted({entry[0] for entry in index})])
    least_of_all = min(entry[5] for entry in index)
    blocks = (
        rows.select("id", "text_key", F.posexplode("blocks").alias("block", "held"))
        .filter((F.size("held") >= least_of_all) & F.arrays_overlap("held", firsts))
        .withColumn("held", F.array_intersect(F.array(*[F.lit(token) for token in order]), "held"))
    )
    # The templates are a parameter of at most TEMPLATE_CHARS.
    joined = blocks.select("*", F.posexplode("held").alias("at", "token")).join(F.broadcast(prefixes), "token")
    size = F.size("tokens")
    possible = joined.filter(
        (F.size("held") >= F.col("least")) & (F.least(size - F.col("place"), F.size("held") - F.col("at")) >= F.col("least"))
    ).withColumn("overlap", F.array_intersect("tokens", "held"))
    # A pair met through several prefix tokens counts at the first token that both sides hold.
    exact = possible.filter((F.size("overlap") >= F.col("least")) & (F.get("overlap", F.lit(0)) == F.col("token")))
    return exact.select(
        "id",
        "text_key",
        "template",
        "label",
        (F.col("block").cast("long") * stride).alias("first_word"),
        (F.size("overlap") / size).alias("containment"),
    )


def scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    containment: float = CONTAINMENT,
    carry: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: ``n_words, n_base, first_word, last_word, base_labels, labels, score, matches``.

    ``n_base`` counts all places of the phrases, ``first_word`` and ``last_word`` are
    their smallest and largest start (words from 0, NULL without any). ``matches`` lists
    every block that meets a template ``(first_word of the block, template, label,
    containment)``; ``labels`` are those of phrases and templates, sorted. ``score`` is 1
    with a phrase, else the largest containment of a match, else 0. Blocks are runs of
    twice the words of the longest template, each beginning in the middle of the one
    before. A NULL text is empty and has no words; a text of any length is one row's
    work; rows that repeat id and text get the same result. ``carry`` names the input
    columns to return (all but the text if left out); those with names of results are
    replaced.
    """
    results = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    carried = [c for c in docs.columns if c != text_col] if carry is None else carry
    usable = [(label, text) for label, text in templates if template_words(text)]
    if sum(len(text) for _, text in usable) > TEMPLATE_CHARS:
        raise ValueError(f"templates of more than {TEMPLATE_CHARS} characters")
    spaced = {phrase: label for phrase, label in phrases.items() if template_words(phrase)}
    vocabulary = sorted({word for _, text in usable for word in template_words(text)})
    stride = max((len(template_words(text)) for _, text in usable), default=1)
    rows = stage(_tokenised(docs, carried, id_col, text_col, spaced, vocabulary, stride), "license-words")
    match = F.struct("first_word", "template", "label", "containment")
    kind = "array<struct<first_word:bigint,template:int,label:string,containment:double>>"
    if usable:
        found = (
            _matches(rows, usable, vocabulary, stride, containment)
            .groupBy(F.col("id").alias("found_id"), F.col("text_key").alias("found_key"))
            .agg(F.array_sort(F.collect_set(match)).alias("matches"))
        )
        here = F.col("id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key"))
        rows = rows.join(found, here, "left")
    else:
        rows = rows.withColumn("matches", F.lit(None).cast(kind))
    rows = rows.withColumn("matches", F.coalesce("matches", F.array().cast(kind)))
    based = F.size("starts") > 0
    values = {
        "n_words": F.col("n_words"),
        "n_base": F.size("starts").cast("long"),
        "first_word": F.array_min("starts").cast("long"),
        "last_word": F.array_max("starts").cast("long"),
        "base_labels": F.col("base_labels"),
        "labels": F.array_sort(F.array_union("base_labels", F.col("matches.label"))),
        "score": F.when(based, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.col("matches.containment")), F.lit(0.0))),
        "matches": F.col("matches"),
    }
    return unpack(rows, carried, **{name: values[name] for name in results})
