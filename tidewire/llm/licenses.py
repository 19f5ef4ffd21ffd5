"""License scans by a positional index of rare words; DataFrame functions only.

A template is a passage of words with mandatory phrases in it. The index posts each template under the two rarest words of its
mandatory phrases, by their document frequency in the corpus, with their places. A file's rare licence words are looked up,
the postings' relative positions are intersected, which gives the places where the passage can begin, and there the mandatory
phrases are verified and the other words counted. As an accepted passage has all its mandatory words, none is lost.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a passage's words that must stand at their places.
LEAST_SHARE = 0.7
#: Rare words under which a template is posted.
POSTED = 2
FOUND = "array<struct<label:string,base:boolean,start:int,n_words:int,share:double>>"


class Template(NamedTuple):
    """A passage whose label is given to files with it; ``must`` are phrases of it, each with its first word's place."""

    label: str
    base: bool
    words: tuple[str, ...]
    must: tuple[tuple[int, tuple[str, ...]], ...]


def template(label: str, passage: str, *phrases: str, base: bool = False) -> Template:
    """A template of a passage and its mandatory phrases; without any, all of it is mandatory."""
    words = normal(passage)
    must = []
    for phrase in map(normal, phrases or (passage,)):
        at = next((i for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase), None)
        if at is None or not phrase:
            raise ValueError(f"not a phrase of the passage: {phrase}")
        must.append((at, phrase))
    return Template(label, base, words, tuple(must))


def normal(text: str) -> tuple[str, ...]:
    return tuple(re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER))))


#: Passages of common licences and short forms of their names; those marked base are the contract's phrases.
TEMPLATES = (
    template("gpl", "GNU General Public License", base=True),
    template("apache", "Apache License", base=True),
    template("cc-by", "CC BY", base=True),
    template("mit", "MIT License", base=True),
    template("agpl", "GNU Affero General Public License"),
    template("apache-2.0", "Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0"),
    template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "may not use this file except in compliance with the License"),
    template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistribution and use in source and binary forms", "following conditions are met"),
    template("bsd-3-clause", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "used to endorse or promote products derived from this software"),
    template("cc-by-nc", "CC BY-NC"),
    template("cc-by-nd", "CC BY-ND"),
    template("cc-by-sa", "CC BY-SA"),
    template("cc0", "CC0 1.0 Universal"),
    template("creative-commons", "licensed under a Creative Commons Attribution", "Creative Commons Attribution"),
    template("gpl-2.0", "GNU General Public License, version 2"),
    template("gpl-3.0", "GNU General Public License, version 3"),
    template("gpl-or-later", "either version 3 of the License, or (at your option) any later version", "at your option any later version"),
    template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee"),
    template("lgpl", "GNU Lesser General Public License"),
    template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Permission is hereby granted free of charge", "software and associated documentation files"),
    template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Mozilla Public License v 2 0"),
    template("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
    template("warranty-disclaimer", "the software is provided as is without warranty of any kind express or implied", "software is provided as is"),
)


def text_words(text: Column) -> Column:
    """Words of a text with A-Z as a-z: runs of digits, letters and all that is not ASCII; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _strings(values: tuple[str, ...] | list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def document_frequency(docs: DataFrame, words: list[str], text: str = "text") -> dict[str, int]:
    """In how many documents each of these words stands; one row a word comes back."""
    seen = docs.select(F.explode(F.array_intersect(_strings(words), text_words(F.col(text)))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return {r.w: r.n for r in seen.collect()}


def rarest(t: Template, frequency: dict[str, int], n: int = POSTED) -> list[str]:
    """The template's ``n`` mandatory words of highest inverse document frequency."""
    return sorted({w for _, phrase in t.must for w in phrase}, key=lambda w: (frequency.get(w, 0), w))[:n]


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, text: str = "text", least_share: float = LEAST_SHARE) -> DataFrame:
    """Add ``n_words`` and ``found``, an array of (label, base, start, n_words, share), one for each place of each template, to documents.

    ``start`` counts words from 0 and may be below 0 if a file begins amid a passage. A place counts if all mandatory phrases
    stand consecutively where they should and ``least_share`` of the passage's words at theirs. Null and empty texts have no
    words and nothing found; other columns stay, own ones of these two names are replaced. Rows are independent, so repeated
    rows give equal results; an empty table gives no rows. Templates are part of the plan: give hundreds, not millions.
    """
    own = [f"`{c}`" for c in docs.columns if c.lower() not in ("n_words", "found")]
    if not templates:
        return docs.select(*own, F.size(text_words(F.col(text))).cast("long").alias("n_words"), F.array().cast(FOUND).alias("found"))
    frequency = document_frequency(docs, sorted({w for t in templates for _, p in t.must for w in p}), text)
    posted = [rarest(t, frequency) for t in templates]
    vocabulary = sorted({w for words in posted for w in words}, key=lambda w: (frequency.get(w, 0), w))  # rarest first

    def entry(t: Template, words: list[str]) -> Column:
        postings = [F.struct(F.lit(w).alias("w"), F.array(*(F.lit(o + j) for o, p in t.must for j, x in enumerate(p) if x == w)).alias("at")) for w in words]
        must = [F.struct(F.lit(o).alias("at"), _strings(p).alias("phrase")) for o, p in t.must]
        return F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), _strings(words).alias("rare"), F.array(*postings).alias("postings"), F.array(*must).alias("must"), _strings(t.words).alias("words"))

    words = F.col("_words")
    places = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(*vocabulary), i)))
    index = F.array(*(entry(t, p) for t, p in zip(templates, posted)))

    def starts(posting: Column) -> Column:
        """Where the passage can begin by one rare word's postings."""
        here = F.filter(F.col("_places"), lambda i: F.get(words, i) == posting["w"])
        return F.array_distinct(F.flatten(F.transform(posting["at"], lambda p: F.transform(here, lambda i: i - p))))

    def common(t: Column) -> Column:
        return F.aggregate(F.slice(t["postings"], 2, POSTED), starts(t["postings"][0]), lambda got, p: F.array_intersect(got, starts(p)))

    def verified(t: Column, s: Column) -> Column:
        return F.forall(t["must"], lambda m: (s + m["at"] >= 0) & (F.slice(words, F.greatest(s + m["at"], F.lit(0)) + 1, F.size(m["phrase"])) == m["phrase"]))

    def share(t: Column, s: Column) -> Column:
        at_place = F.filter(t["words"], lambda w, j: F.coalesce(F.get(words, s + j) == w, F.lit(False)))
        return F.size(at_place) / F.size(t["words"])

    def accepted(t: Column) -> Column:
        rows = F.transform(F.filter(common(t), lambda s: verified(t, s)), lambda s: F.struct(t["label"].alias("label"), t["base"].alias("base"), s.alias("start"), F.size(t["words"]).alias("n_words"), share(t, s).alias("share")))
        return F.filter(rows, lambda r: r["share"] >= least_share)

    whole = F.filter(index, lambda t: F.forall(t["rare"], lambda w: F.array_contains(F.col("_rare"), w)))  # templates all of whose rare words the file has
    out = docs.select(*own, text_words(F.col(text)).alias("_words")).withColumn("_places", places)
    out = out.withColumn("_rare", F.array_intersect(_strings(vocabulary), F.transform("_places", lambda i: F.get(words, i))))
    return out.select(*own, F.size("_words").cast("long").alias("n_words"), F.flatten(F.transform(whole, accepted)).alias("found"))
