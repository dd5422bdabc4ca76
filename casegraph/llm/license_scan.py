"""Licence scan by a positional rare-token index, in DataFrame functions only.

Licence notices are templates: word lists with mandatory key phrases. A first pass counts in how many of all files each
template word stands, which gives its inverse document frequency. The index has, for each template, the places
(template, position) of the highest-IDF words of its key phrases. A file's places of these words are looked up: a word
at place p with a posting (t, q) proposes that template t begins at p - q. A beginning on which two different rare words
agree is a candidate; it is verified word by word against the template, and all its key phrases must stand there in
full. Key phrases are mandatory, so each notice has its anchors, whatever else stands in the file.

All of a file's work is in its own row, so there is no shuffle but that of the word counts, and neither hot words nor
repeated files gather anywhere.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases that always give their label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Rarest key words of a template that are looked up, two at least, and the share of a template that has to stand in its place.
RARE_WORDS, LEAST_COVERAGE = 2, 0.7


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases of `text` that must stand in full.
    keys: tuple[str, ...]


#: Opening or identifying notices of common licences.
TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2.0", ("apache license version 2.0",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("hereby granted free of charge", "obtaining a copy of this software")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    Template("bsd", "licensed under the bsd 3 clause license", ("bsd 3 clause",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("gnu general public license",)),
    Template("gpl", "licensed under the gnu general public license", ("general public license",)),
    Template("gpl", "under the terms of the gnu general public license", ("general public license",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "under the terms of the gnu affero general public license", ("affero general public license",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0", ("mozilla public license",)),
    Template("cc-by", "licensed under cc by 4.0", ("cc by",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4.0 international license", ("creative commons attribution 4.0",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4.0 international license", ("attribution sharealike",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", ("attribution noncommercial",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2.0", ("eclipse public license",)),
)

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: An anchor is a long: template, beginning plus _SHIFT (beginnings can be before the text), word.
_SHIFT, _BEGIN, _WORDS = 1 << 20, 1 << 33, 1 << 12


def template_words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def phrase_at(words: list[str], phrase: list[str]) -> int:
    return next(k for k in range(len(words)) if words[k : k + len(phrase)] == phrase)


def _pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row: a generator keeps the optimizer from copying them into lambdas."""
    for name, value in columns.items():
        df = df.select("*", F.explode(F.array(value)).alias(name))
    return df


def words_of(text: Column) -> Column:
    """Words of the text: A-Z lower-cased, split at ASCII characters other than letters and digits; null has none."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    bare = F.regexp_replace(lowered, f"\\A{SEPARATORS}|{SEPARATORS}\\z", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SEPARATORS))


def word_frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of files, and of those that each word of the vocabulary stands in; over all of `docs` (text)."""
    found = docs.select(F.array_intersect(words_of(F.col("text")), F.array(*map(F.lit, vocabulary))).alias("w"))
    rows = found.select(F.explode(F.concat(F.array(F.lit("")), "w")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()  # one a word
    counts = {r["w"]: r["n"] for r in rows}
    return counts.pop("", 0), counts


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base=BASE, rare_words: int = RARE_WORDS, least_coverage: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches of each row of `docs`.

    n_base counts all places of the base phrases; first_word and last_word are their smallest and largest beginning in
    words from 0, null without any. `labels` are the base labels and those of verified templates. `matches` lists
    (label, begin, coverage). The score is the largest coverage, 1 with a base phrase, else 0. Null, empty and wordless
    texts have no words and no labels. Repeated rows are told each, extra columns are ignored, empty tables stay empty.
    """
    texts = [template_words(t.text) for t in templates]
    vocabulary = sorted({w for t in texts for w in t})
    if len(vocabulary) >= _WORDS:
        raise ValueError("too many template words")
    total, counts = word_frequencies(docs, vocabulary)
    idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in vocabulary}
    keyed_at = [sorted({p for key in t.keys for k in [phrase_at(ws, template_words(key))] for p in range(k, k + len(template_words(key)))}) for t, ws in zip(templates, texts, strict=True)]
    # postings of each template's rarest key words; without two key words any two of all its words are anchors
    found: dict[str, list[int]] = {}
    for t, (ws, at) in enumerate(zip(texts, keyed_at, strict=True)):
        if len({ws[q] for q in at}) < 2:
            at, most = range(len(ws)), len(ws)
        else:
            most = max(2, rare_words)
        chosen = sorted({ws[q] for q in at}, key=lambda w: (-idf[w], w))[:most]
        for q in at:
            if ws[q] in chosen:
                found.setdefault(ws[q], []).append(t * _BEGIN - q)
    ranked = sorted(found, key=lambda w: (-idf[w], w))
    rank = {w: k for k, w in enumerate(ranked)}
    postings = [found[w] for w in ranked]

    lit_array = lambda xs, kind: F.array(*map(F.lit, xs)).cast(f"array<{kind}>")
    ranks = F.create_map(*(F.lit(x) for w in ranked for x in (w, rank[w])))
    posting_table = F.array(*(lit_array(p, "bigint") for p in postings))
    text_table = F.array(*(lit_array(t, "string") for t in texts))
    key_table = F.array(*(lit_array(at, "int") for at in keyed_at))
    label_table = lit_array([t.label for t in templates], "string")

    df = _pin(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words=words_of(F.col("text"))).drop("text")
    words, n = F.col("words"), F.size("words")

    def begins(w: Column, i: Column) -> Column:
        out = F.lit(None).cast("bigint")
        for k, (phrase, _) in reversed(list(enumerate(base))):
            first, *rest = phrase.split(" ")
            same = reduce(lambda a, b: a & b, (F.get(words, i + j) == x for j, x in enumerate(rest, 1)), w == first)
            out = F.when(same, i.cast("bigint") * len(base) + k).otherwise(out)
        return out

    df = _pin(df, places=F.array_compact(F.transform(words, begins)))
    df = _pin(df, rare_text=F.array_intersect(words, lit_array(ranked, "string")))
    # places of the rare words: place * _WORDS + rank
    place = lambda w, i: F.when(F.array_contains("rare_text", w), i.cast("bigint") * _WORDS + F.element_at(ranks, w))
    df = _pin(df, looked=F.when(F.size("rare_text") < 2, F.array().cast("array<bigint>")).otherwise(F.array_compact(F.transform(words, place))))
    anchors = F.flatten(F.transform("looked", lambda x: F.transform(F.element_at(posting_table, (x % _WORDS).cast("int") + 1), lambda p: (p + F.shiftright(x, 12) + _SHIFT) * _WORDS + x % _WORDS)))
    df = _pin(df, anchors=F.sort_array(F.array_distinct(anchors)))
    agreed = F.filter(F.col("anchors"), lambda x, i: F.coalesce(F.shiftright(F.get("anchors", i + 1), 12) == F.shiftright(x, 12), F.lit(False)))
    df = _pin(df, candidates=F.array_distinct(F.transform(agreed, lambda x: F.shiftright(x, 12))))

    def verify(c: Column) -> Column:
        t = F.floor(c / _BEGIN).cast("int") + 1
        begin = (c % _BEGIN - _SHIFT).cast("int")
        at = lambda q: F.when(begin + q >= 0, F.get(words, begin + q))
        template = F.element_at(text_table, t)
        met = F.size(F.filter(F.transform(template, lambda w, q: F.coalesce(at(q) == w, F.lit(False))), lambda x: x))
        keyed = F.forall(F.element_at(key_table, t), lambda q: F.coalesce(at(q) == F.get(template, q), F.lit(False)))
        return F.struct(F.element_at(label_table, t).alias("label"), begin.alias("begin"), F.when(keyed, met / F.size(template)).otherwise(F.lit(0.0)).alias("coverage"))

    df = _pin(df, matches=F.filter(F.transform("candidates", verify), lambda m: m["coverage"] >= least_coverage))
    base_labels = F.array_distinct(F.transform("places", lambda x: F.element_at(lit_array([b for _, b in base], "string"), (x % len(base)).cast("int") + 1)))
    df = _pin(df, base_found=base_labels)
    start = lambda x: F.floor(x / len(base)).cast("bigint")
    return df.select(
        "doc_id",
        n.cast("bigint").alias("n_words"),
        F.size("places").cast("bigint").alias("n_base"),
        start(F.array_min("places")).alias("first_word"),
        start(F.array_max("places")).alias("last_word"),
        F.array_join(F.sort_array("base_found"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base_found", F.transform("matches", lambda m: m["label"]))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0))).alias("score"),
        "matches",
    )
