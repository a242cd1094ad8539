"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame operations only.

A block is 64 consecutive words, one starting every 32, so a phrase of up to 33 words lies whole in some block. A template is
found in a block when the block holds at least ``threshold`` of the template's distinct tokens. Tokens are ordered by
their frequency in the whole corpus, rarest first. A template whose overlap must be a or more of its t tokens shares one
of its first t - a + 1 with every block that reaches a: blocks and templates are joined on these tokens (prefix filter); a
block with fewer than a template tokens is left out (length filter); so is one whose tokens after the first common one,
in either order, cannot reach a (position filter). What remains is counted exactly.

Beside it, every place of the base phrases is found. Text is lower-cased in A-Z; other letters only meet other letters,
so their case does not matter, and the one that lower-cases into a-z is kept apart.

Defined cases: a null text is empty; without base places first_word and last_word are null; labels are empty strings where none
was found. Repeated rows give repeated results. The score is the largest share of a template found, 1 where a base phrase
stands, else 0.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.session import materialise

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK, STEP = 64, 32

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Sentences by which licenses are declared, at most 33 words each.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words_column(text: Column) -> Column:
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("￿")))  # the Kelvin sign would become k
    return F.array_remove(F.split(low, SEPARATORS), "")


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts, from 0, at which the words of ``phrase`` stand one after another; only texts with all of them are searched."""
    last = F.size(words) - len(phrase)
    hit = lambda i: _all([F.get(words, i + k) == p for k, p in enumerate(phrase)])
    holds = _all([F.array_contains(words, p) for p in phrase])
    return F.when(holds & (last >= 0), F.filter(F.sequence(F.lit(0), last), hit)).otherwise(F.lit([]).cast("array<int>"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def _tokens(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def token_order(words: DataFrame, tokens: list[str]) -> dict[str, int]:
    """Rank of each template token by its frequency in the corpus, rarest first. One row per template token is returned."""
    wanted = words.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    counts = (words.select(F.explode("words").alias("token")).join(F.broadcast(wanted), "token").groupBy("token")
              .agg(F.count(F.lit(1)).alias("n")).collect())
    n = {r.token: r.n for r in counts}
    return {t: i for i, t in enumerate(sorted(tokens, key=lambda t: (n.get(t, 0), t)))}


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.9,
         phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per document. The templates, a fixed list, are broadcast; texts are never shuffled."""
    spark = docs.sparkSession
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words_column(F.col("text").cast("string")).alias("words"))
    sets = [sorted(set(_tokens(t))) for _, t in templates]
    rank = token_order(words, sorted(set().union(*sets)))
    need = [math.ceil(threshold * len(s) - 1e-9) for s in sets]
    ordered = [sorted(rank[t] for t in s) for s in sets]
    prefix = [o[:len(o) - a + 1] for o, a in zip(ordered, need)]
    name = {i: t for t, i in rank.items()}

    ranks = F.create_map(*[x for t, i in rank.items() for x in (F.lit(t), F.lit(i))])
    rare = F.lit([name[i] for i in sorted(set().union(*prefix))])
    every = F.lit(sorted(rank))
    block = lambda w, k: F.array_sort(F.transform(F.array_intersect(F.slice(w, k + 1, BLOCK), every), lambda t: F.element_at(ranks, t)))
    starts = lambda w: F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(STEP))
    found = {p: _places(F.col("words"), p.split()) for p in phrases}
    first = materialise(
        words.select("doc_id", F.size("words").cast("long").alias("n_words"),
                     *[e.alias(f"at_{i}") for i, e in enumerate(found.values())],
                     # sorted ranks of the template tokens of each block, for texts that hold a prefix token at all
                     F.when(F.arrays_overlap("words", rare), F.transform(starts(F.col("words")), lambda k: block(F.col("words"), k))).alias("blocks"))
        .withColumn("row", F.monotonically_increasing_id()))

    index = spark.createDataFrame(
        [(t, j, i, o, a, templates[i][0]) for i, (o, a, p) in enumerate(zip(ordered, need, prefix)) for j, t in enumerate(p)],
        "token int, place int, template int, tokens array<int>, need int, label string")
    blocks = first.where("blocks IS NOT NULL").select("row", F.posexplode("blocks").alias("block", "have"))
    met = (blocks.select("row", "block", "have", F.posexplode("have").alias("at", "token"))
           .join(F.broadcast(index), "token")
           .where(F.size("have") >= F.col("need"))
           # the first common token in the order decides; what comes before it on either side is not common
           .where(F.element_at(F.array_intersect("have", "tokens"), 1) == F.col("token"))
           .where(1 + F.least(F.size("have") - F.col("at"), F.size("tokens") - F.col("place")) - 1 >= F.col("need")))
    share = F.size(F.array_intersect("have", "tokens"))
    hits = (met.where(share >= F.col("need"))
            .groupBy("row").agg(F.collect_set("label").alias("more"), F.max(share / F.size("tokens")).alias("share")))

    places = [F.col(f"at_{i}") for i in range(len(found))]
    base = first.select("row", "doc_id", "n_words", F.aggregate(F.transform(F.array(*places), F.size), F.lit(0), lambda a, b: a + b).cast("long").alias("n_base"),
                        F.array_min(F.flatten(F.array(*places))).cast("long").alias("first_word"), F.array_max(F.flatten(F.array(*places))).cast("long").alias("last_word"),
                        F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(places, phrases.values())])).alias("base"))
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return base.join(hits, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", text(F.col("base")).alias("base_labels"),
        text(F.concat("base", F.coalesce("more", F.lit([]).cast("array<string>")))).alias("labels"),
        F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(0.0)).alias("score"))
