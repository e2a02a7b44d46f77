"""Licence scans: phrase places, and an exact set-similarity join of text lines with templates (no Python on executors).

A line matches a template when it holds at least `threshold` of the template's distinct words. The join never compares
every line with every template: words are ordered by how often the whole corpus has them, rarest first, and

* prefix filter: a line that lacks all of the template's |T| - need + 1 rarest words cannot hold `need` of them (texts
  without any such word are not even cut into lines);
* length filter: a line with fewer than `need` distinct template words is left out;
* positional filter: from a shared word at place i of the template and j of the line, at most
  1 + min(words after i, words after j) can be shared.

Survivors are checked exactly. Templates are a parameter; what is sent to executors is their word table, whose size
does not depend on the data.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstats.llm.common import whole_text

# fixed values: the characters of words, before A-Z are lowered
LETTER = r"0-9A-Za-z\x{80}-\x{10FFFF}"
WORD, APART = f"[{LETTER}]+", f"[^{LETTER}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lowered, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.translate(w, UPPER, LOWER))


def _phrase_places(words: Column, phrases: Sequence[str]) -> Column:
    """For each phrase the array of word numbers at which it starts."""
    def starts(w: Column, phrase: str) -> Column:
        parts = phrase.split(" ")
        whole = F.array(*[F.lit(p) for p in parts])
        last = F.size(w) - len(parts)
        return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), lambda i: (F.get(w, i) == parts[0])
                                          & (F.slice(w, i + 1, len(parts)) == whole))
                      ).otherwise(F.array().cast("array<int>"))
    # the outer lambda binds the words, which are else made anew for every place looked at
    return F.get(F.transform(F.array(words), lambda w: F.array(*[starts(w, p) for p in phrases])), F.lit(0))


def _phrase_pattern(phrases: Sequence[str]) -> str:
    """Any of the phrases, A-Z regardless of case, any separators between the words."""
    one = [APART.join(p.split(" ")) for p in phrases]
    return f"(?i)(?<![{LETTER}])(?:{'|'.join(one)})(?![{LETTER}])"


def _line_words(docs: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """(key…, line, size, held): per line the number of distinct words and those the templates know."""
    line = F.regexp_extract_all("line", F.lit(WORD), F.lit(0))
    return (
        docs.select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .withColumn("held", F.array_intersect(F.transform(line, lambda w: F.translate(w, UPPER, LOWER)),
                                              F.array(*[F.lit(w) for w in vocabulary])))
        .where(F.size("held") > 0)
        .select("doc_id", "text_key", "line_no", "held")
    )


def template_matches(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES,
                     threshold: float = 0.8) -> DataFrame:
    """(doc_id, text_key, line_no, label, containment) of every line that holds enough of a template.

    Expects columns doc_id, text_key and text. The result does not depend on the word order, only the work does.
    """
    sets = [(label, sorted(set(text.split(" ")))) for label, text in templates]
    vocabulary = sorted({w for _, ws in sets for w in ws})
    spark = docs.sparkSession
    seen = docs.select(F.explode(F.split(F.lower("text"), APART)).alias("word")).where(F.col("word").isin(vocabulary))
    counted = {r["word"]: r["places"] for r in  # one row per template word at most
               seen.groupBy("word").agg(F.count("*").alias("places")).collect()}
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counted.get(w, 0), w)))}
    entries = []
    for number, (label, ws) in enumerate(sets):
        order = sorted(rank[w] for w in ws)
        need = math.ceil(threshold * len(order) - 1e-9)
        entries += [(order[i], number, label, i, len(order), need, order) for i in range(len(order) - need + 1)]
    index = spark.createDataFrame(
        entries, "rank int, template int, label string, at int, size int, need int, words array<int>")
    first = sorted({w for w, k in rank.items() if k in {e[0] for e in entries}})
    lines = _line_words(docs.where(F.col("text").rlike(_phrase_pattern(first))), vocabulary)
    order = F.create_map(*[x for w, k in rank.items() for x in (F.lit(w), F.lit(k))])
    ranked = lines.select("doc_id", "text_key", "line_no",
                          F.array_sort(F.transform("held", lambda w: order[w])).alias("ranks"))
    near = (
        ranked.select("*", F.posexplode("ranks").alias("here", "rank"))
        .join(index, "rank")
        .where((F.size("ranks") >= F.col("need"))
               & (1 + F.least(F.col("size") - 1 - F.col("at"), F.size("ranks") - 1 - F.col("here")) >= F.col("need")))
        .withColumn("shared", F.size(F.array_intersect("ranks", "words")))
        .where("shared >= need")
    )
    return near.groupBy("doc_id", "text_key", "line_no", "template", "label").agg(
        F.max(F.col("shared") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Mapping[str, str] = PHRASES,
         templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Phrase places and template matches of every document.

    Returns doc_id, n_words, n_base (places of all phrases), first_word and last_word (smallest and largest start,
    null without a place), base_labels and labels (distinct, sorted, comma-joined; empty without one) and score: 1 with
    a phrase, else the largest containment that reaches the threshold, else 0. A missing text is empty; a missing
    doc_id is kept as such; repeated rows each give their row.
    """
    data = docs.select(F.col(f"`{id_col}`").alias("doc_id"), whole_text(text_col).alias("text"))
    data = data.withColumn("text_key", F.xxhash64("text"))
    names = list(phrases)
    n = F.regexp_count("text", F.lit(WORD))
    places = F.when(F.col("text").rlike(_phrase_pattern(names)), _phrase_places(words_of(F.col("text")), names))
    base = data.select("doc_id", "text_key", n.cast("long").alias("n_words"), places.alias("places"))
    matches = template_matches(data, templates, threshold)
    found = matches.groupBy("doc_id", "text_key").agg(
        F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    key = [base["doc_id"].eqNullSafe(found["doc_id"]), base["text_key"] == found["text_key"]]
    both = base.join(found, key, "left").select(base["doc_id"], "n_words", "places", "found", "containment")
    flat = F.flatten("places")
    marks = F.filter(F.transform(F.arrays_zip(F.col("places"), F.array(*[F.lit(phrases[p]) for p in names]).alias("label")),
                                 lambda z: F.when(F.size(z["places"]) > 0, z["label"])), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    both = both.withColumn("base", F.coalesce(F.array_sort(F.array_distinct(marks)), none))
    starts = F.when(F.size("base") > 0, flat)
    return both.select(
        "doc_id", "n_words",
        F.when(F.size("base") > 0, F.size(flat)).otherwise(0).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
