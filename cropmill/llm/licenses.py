"""License scans: an exact set-similarity join of text blocks with license templates. DataFrame functions only.

A block is a sentence: texts are cut after sentence ends and at lines without words, so a notice that is wrapped over lines, with or
without comment marks, is one block. A block matches a template if it holds at least ``threshold`` of the template's
distinct words. Template words are put in one global order, rarest first by the number of documents that hold them; a block of enough
overlap must hold one of a template's first ``|t| - alpha + 1`` words (prefix filter, ``alpha``: the least overlap), have at least
``alpha`` template words (length filter), and, if the first common word of both is the template's i-th and j template words of the
block remain from it on, reach ``alpha`` with what remains (positional filter). What is left is counted exactly. Blocks meet templates
through an index from prefix words to templates, so a block never looks at a template without a common prefix word.

Texts without any prefix word are told apart by one regular-expression test and never cut into blocks. The templates are a parameter of
bounded size, so their side is broadcast.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropmill.llm.arrays import running

# The base phrases, as words, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Templates of notices: label and words.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "All rights reserved"),
]
#: The templates' words may have this many characters altogether; it bounds what is broadcast.
MOST_TEMPLATE_CHARS = 1 << 20
#: What stands between words, once A-Z are lower-cased, and what words are made of before that.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
BLOCK_END = rf"\n(?:(?!\n){GAP})*\n|(?<=[.!?])\s+"


def words_of(text: str) -> list[str]:
    """The words of a template, A-Z lower-cased."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return "".join(c if c.isdigit() and c < "\x80" or "a" <= c <= "z" or c >= "\x80" else " " for c in low).split()


def phrase_pattern(phrase: str) -> str:
    """A phrase's words with gaps between, at word bounds; letters A-Z in either case."""
    return rf"(?i)(?<!{WORD})" + rf"{GAP}+".join(phrase.split()) + rf"(?!{WORD})"


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else; for short texts."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of words: the words' starts, counted as the gaps of the text with one space before."""
    spaced = F.trim(F.regexp_replace(text, rf"{GAP}+", " "))
    return F.when(F.length(spaced) == 0, F.lit(0)).otherwise(F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit(""))) + 1)


def phrase_places(text: Column, phrase: str) -> Column:
    """First word numbers of all places of a phrase, ascending."""
    n, pattern = len(phrase.split()), phrase_pattern(phrase)
    before = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))
    ends = running(F.transform(before, lambda gap: word_count(gap).cast("long") + n), lambda a, b: a + b)
    return F.transform(ends, lambda end: end - n)


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many documents each word of a bounded vocabulary stands; only these counts reach the driver.

    They only choose the global order, so ``lower``, which also changes letters beyond ASCII, does.
    """
    own = F.array_intersect(F.split(F.lower(F.col(text_col).cast("string")), rf"{GAP}+", -1), F.lit(vocabulary))
    rows = docs.select(F.explode(own).alias("word")).groupBy("word").count().collect()
    return {r.word: r["count"] for r in rows}


def _templates(docs: DataFrame, templates: list[tuple[str, str]], threshold: float, text_col: str) -> list[dict]:
    """Templates with their distinct words in the global order, their least overlaps and prefixes."""
    if sum(len(t) for _, t in templates) > MOST_TEMPLATE_CHARS:
        raise ValueError(f"templates are larger than {MOST_TEMPLATE_CHARS} characters")
    sets = [(label, sorted(set(words_of(t)))) for label, t in templates]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    seen = document_frequencies(docs, vocabulary, text_col) if vocabulary else {}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    out = []
    for number, (label, ws) in enumerate(sets):
        if ws:
            ranks, alpha = sorted(order[w] for w in ws), max(1, math.ceil(threshold * len(ws) - 1e-9))
            out.append({"template": number, "label": label, "ranks": ranks, "size": len(ws), "alpha": alpha, "prefix": ranks[: len(ws) - alpha + 1], "words": {order[w]: w for w in ws}})
    return out


def prefix_index(templates: list[dict], words: int) -> list[list[int]]:
    """For each word of the global order the places in ``templates`` of those that have it in their prefix."""
    index: list[list[int]] = [[] for _ in range(words)]
    for place, t in enumerate(templates):
        for rank in t["prefix"]:
            index[rank].append(place)
    return index


def block_matches(text: Column, templates: list[dict], vocabulary: list[str]) -> Column:
    """(label, containment) of each block and template that it holds: the join of a text's blocks with the templates.

    ``vocabulary`` has the template words in the global order; a block is the ascending array of its distinct words' places in it.
    """
    kind = "array<struct<label:string,size:int,alpha:int,prefix:array<int>,ranks:array<int>>>"
    sides = F.from_json(F.lit(json.dumps([{k: t[k] for k in ("label", "size", "alpha", "prefix", "ranks")} for t in templates])), kind)
    index = F.from_json(F.lit(json.dumps(prefix_index(templates, len(vocabulary)))), "array<array<int>>")
    known = F.lit(vocabulary)
    ranks = F.transform(F.split(text, BLOCK_END, -1), lambda b: F.array_sort(F.transform(F.array_intersect(F.split(lowered(b), rf"{GAP}+", -1), known), lambda w: F.array_position(known, w).cast("int") - 1)))
    least = min(t["alpha"] for t in templates)

    def join(block: Column) -> Column:
        def possible(t: Column) -> Column:
            common = F.array_min(F.array_intersect(block, t["prefix"]))
            rest = F.least(t["size"] - F.array_position(t["ranks"], common), F.size(block) - F.array_position(block, common))
            return (F.size(block) >= t["alpha"]) & (1 + rest >= t["alpha"])

        met = F.array_sort(F.array_distinct(F.flatten(F.transform(block, lambda rank: F.get(index, rank)))))
        near = F.filter(F.transform(met, lambda place: F.get(sides, place)), possible)
        shared = F.transform(near, lambda t: F.struct(t["label"].alias("label"), F.size(F.array_intersect(block, t["ranks"])).alias("n"), t["alpha"].alias("alpha"), t["size"].alias("size")))
        return F.transform(F.filter(shared, lambda t: t["n"] >= t["alpha"]), lambda t: F.struct(t["label"].alias("label"), (t["n"] / t["size"]).alias("score")))

    return F.flatten(F.transform(F.filter(ranks, lambda r: F.size(r) >= least), join))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``, ``n_blocks``.

    Base phrases are found in whole texts, by word places. ``labels`` adds the labels of templates that some block holds to
    ``threshold``; ``score`` is the best containment of a matching block (1 where a base phrase stands, 0 where nothing matches);
    ``n_blocks`` counts matching (block, template) pairs. A null text is an empty one; rows of equal or null ids are rows of their own.
    An empty table gives an empty table. Other columns are ignored.
    """
    found = _templates(docs, TEMPLATES if templates is None else templates, threshold, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = {k: w for t in found for k, w in t["words"].items()}
    vocabulary = [words[k] for k in sorted(words)]
    phrases = "|".join(rf"{GAP}+".join(p.split()) for p in PHRASES)
    prefix = "|".join(sorted({words[r] for t in found for r in t["prefix"]}))
    base = docs.select(F.col(id_col), text.alias("t"))
    base = base.select(id_col, word_count(F.col("t")).cast("long").alias("n_words"), F.when(F.col("t").rlike(rf"(?i)(?<!{WORD})(?:{phrases})(?!{WORD})"), F.col("t")).alias("b"), F.when(F.col("t").rlike(rf"(?i)(?<!{WORD})(?:{prefix})(?!{WORD})"), F.col("t")).alias("c") if found else F.lit(None).cast("string").alias("c"))
    none = F.array().cast("array<long>")
    base = base.select("*", *[F.when(F.col("b").isNotNull(), phrase_places(F.col("b"), p)).otherwise(none).alias(f"p{i}") for i, p in enumerate(PHRASES)])
    kind = "struct<label:string,score:double>"
    hits = F.when(F.col("c").isNotNull(), block_matches(F.col("c"), found, vocabulary)).otherwise(F.array().cast(f"array<{kind}>")) if found else F.array().cast(f"array<{kind}>")
    places = F.concat(*[F.col(f"p{i}") for i in range(len(PHRASES))])
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]))
    out = base.select(id_col, "n_words", places.alias("places"), base_labels.alias("own"), hits.alias("hits"))
    return out.select(
        id_col,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("own")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("own", F.transform("hits", lambda h: h["label"])))), ",").alias("labels"),
        F.when(F.size("own") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0))).alias("score"),
        F.size("hits").cast("long").alias("n_blocks"),
    )
