"""License scans: an exact set-similarity join of text blocks with license templates.

A block is as many consecutive words of a text as a template has. A template's words, in the order of their frequency in
all texts, rarest first, have a prefix of which every block of enough containment holds a word; blocks are looked for only
around those words, and go by length and position before they are compared. Main path: DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.base import materialise

#: What stands between words, A-Z being in lower case already.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Different words of all templates at most: each task holds them as a set, and the joins broadcast a row for each.
MOST_WORDS = 20_000


@dataclass(frozen=True)
class Template:
    """A label and the words that stand for it. least: the share of its different words that a block must hold. ordered:
    the block must be these words, one after the other."""

    label: str
    text: str
    least: float = 0.8
    ordered: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def needed(self) -> int:
        """Different words that a block must hold."""
        return max(1, math.ceil(self.least * len(set(self.words)) - 1e-9))


#: Fixed by the contract of op11: phrases and their labels.
PHRASES = [
    Template("cc-by", "cc by", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
    Template("reserved", "all rights reserved", 1.0, True),
]
#: Wording of notices in public use. Short ones, of which one word tells the license, are asked for in full.
NOTICES = [
    Template("agpl", "gnu affero general public license", 1.0),
    Template("apache", "licensed under the apache license version 2 0", 1.0),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", 1.0),
    Template("cc-by-sa", "licensed under cc by sa 4 0", 1.0),
    Template("creative-commons", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mit", "released under the mit license", 1.0),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("public-domain", "this is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; null has none."""
    text = F.coalesce(text, F.lit(""))
    # lower() is the quicker way where it changes A-Z only
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.array_remove(F.split(F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), BETWEEN), "")


def _told(docs: DataFrame, known: set[str], id_col: str, text_col: str) -> DataFrame:
    """(rid, id, n_words, hits): hits are the words (i, w) of a text that some template has, in order."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("id"), words(F.col(text_col)).alias("words"))
    hits = F.transform("words", lambda w, i: F.when(w.isin(*known), F.struct(i.alias("i"), w.alias("w"))))
    rows = rows.select("rid", "id", F.size("words").cast("long").alias("n_words"), F.filter(hits, lambda h: h.isNotNull()).alias("hits"))
    return materialise(rows, "license-words")


def _blocks(rows: DataFrame, templates: list[Template]) -> DataFrame:
    spark = rows.sparkSession
    hits = rows.where(F.size("hits") > 0)
    found = hits.select(F.explode("hits.w").alias("w")).groupBy("w").count().collect()  # a row for each template word at most
    often = {r.w: r["count"] for r in found}
    rank = {w: k for k, w in enumerate(sorted({w for t in templates for w in t.words}, key=lambda w: (often.get(w, 0), w)))}
    index = []
    for n, t in enumerate(templates):
        mine = sorted(set(t.words), key=rank.get)
        for k, w in enumerate(mine[: len(mine) - t.needed + 1]):
            index.append((w, n, t.label, t.ordered, t.words, mine, [x for x in mine[k:]], t.needed))
    index = F.broadcast(spark.createDataFrame(index, "w string, template int, label string, ordered boolean, phrase array<string>, tokens array<string>, later array<string>, needed int"))
    wide = max(len(t.words) for t in templates)
    prefix = sorted({w for t in templates for w in sorted(set(t.words), key=rank.get)[: len(set(t.words)) - t.needed + 1]})
    # of a text's hits, those that stand in some prefix, each with the hits around it: never more than two blocks' worth
    at = F.transform("hits", lambda h, i: F.when(h.w.isin(*prefix), F.struct(h.i.alias("i"), h.w.alias("w"), F.slice("hits", F.greatest(i - wide + 2, F.lit(1)), F.lit(2 * wide - 1)).alias("near"))))
    probes = hits.select("rid", "n_words", F.explode(F.filter(at, lambda x: x.isNotNull())).alias("p")).select("rid", "n_words", "p.*")
    met = probes.join(index, "w").where("n_words >= needed")
    # a block begins at a hit: to begin later loses none of its template's words
    size = F.size("phrase")
    near = met.withColumn("own", F.filter("near", lambda h: F.array_contains("tokens", h.w) & (h.i > F.col("i") - size) & (h.i < F.col("i") + size)))
    starts = near.withColumn("start", F.explode(F.transform(F.filter("own", lambda h: h.i <= F.col("i")), lambda h: h.i)))
    starts = starts.withColumn("block", F.filter("own", lambda h: (h.i >= F.col("start")) & (h.i < F.col("start") + size)))
    held = F.array_distinct(F.transform("block", lambda h: h.w))
    # the template's words from this one on, and those before it that the block holds, bound what both can share
    starts = starts.withColumn("held", held).where(F.size("held") >= F.col("needed"))
    starts = starts.where(F.size("later") + F.size(F.array_except("held", "later")) >= F.col("needed"))
    fits = ~F.col("ordered") | (F.transform("block", lambda h: h.w) == F.col("phrase"))
    return starts.where(fits).select("rid", "template", "label", "ordered", F.col("start").cast("long").alias("start"), size.alias("size"), (F.size("held") / F.size("tokens")).alias("containment")).distinct()


def _known(templates: list[Template]) -> set[str]:
    known = {w for t in templates for w in t.words}
    if not templates or not all(t.words for t in templates):
        raise ValueError("every template needs a word, and there must be a template")
    if len(known) > MOST_WORDS:
        raise ValueError(f"the templates have {len(known)} different words; {MOST_WORDS} at most are meant to be held in a task")
    return known


def blocks(docs: DataFrame, templates: list[Template], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, template number, label, start, size, containment) of each block of a text that holds enough of a template.

    Blocks are as many consecutive words as the template has (fewer at the end of a text), begin at a word of the template
    and are all found, overlapping ones too. start counts words from 0. Null and empty texts have none; rows that repeat an
    id have their own blocks each.
    """
    rows = _told(docs, _known(templates), id_col, text_col)
    return _blocks(rows, templates).join(rows.select("rid", "id"), "rid").select("id", "template", "label", "start", "size", "containment")


def scan(docs: DataFrame, templates: list[Template], base: list[Template], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    n_base counts the blocks of base templates, first_word and last_word are the smallest and largest start of these (null
    if there is none); labels are sorted arrays, those of base templates and those of all; score is the greatest
    containment found, 0 without any. Null texts count as empty, rows that repeat an id are judged each by itself.
    """
    both = [*base, *templates]
    rows = _told(docs, _known(both), id_col, text_col)
    found = _blocks(rows, both)
    mine = F.col("template") < len(base)
    told = found.groupBy("rid").agg(
        F.count(F.when(mine, 1)).alias("n_base"), F.min(F.when(mine, F.col("start"))).alias("first_word"), F.max(F.when(mine, F.col("start"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(mine, F.col("label")))).alias("base_labels"), F.array_sort(F.collect_set("label")).alias("labels"), F.max("containment").alias("score"),
    )
    none = F.array().cast("array<string>")
    out = rows.select("rid", "id", "n_words").join(told, "rid", "left")
    return out.select("id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
