"""Licence scan: a positional index of licence words, joined by relative position, verified by mandatory key phrases."""

from __future__ import annotations

import json
import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import body, materialise, table

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed by the contract: what separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str  # the words of the licence text, in order
    key: str  # mandatory phrase, part of text
    base: bool = False  # whether the contract fixes label and phrase

    def before(self) -> int:
        """Words of the text before its key phrase."""
        line, key = self.text.split(), self.key.split()
        return next(k for k in range(len(line)) if line[k : k + len(key)] == key)


#: Notices and the texts of licences that go with them (the first paragraphs that identify them).
TEMPLATES = [
    Template("mit", "released under the mit license", "under the mit license", True),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2", True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc", True),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("all-rights-reserved", "all rights reserved", "all rights reserved"),
    Template("public-domain", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ),
    Template(
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied",
        "you may not use this file except in compliance with the license",
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
        "under the terms of the gnu general public license",
    ),
    Template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "gnu lesser general public license",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistribution and use in source and binary forms",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "for any purpose with or without fee is hereby granted",
    ),
]
#: Rare words of a key phrase whose postings are joined before the whole phrase is.
RARE = 2
#: Keys of postings are label number * SHIFT + place; places are moved by BIAS so that none is negative.
SHIFT, BIAS = 1 << 40, 1 << 20


def text_words(text: Column) -> Column:
    """The words of a text in order; A-Z lower-cased, null is empty."""
    low = F.translate(text, _UPPER, _UPPER.lower())
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def _constant(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


class Index:
    """Words of all templates in slots: crc32 modulo `size`, chosen so that no two words share a slot, so one look-up tells a word."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        self.vocabulary = sorted({w for t in templates for w in t.text.split()})
        self.size = max(4 * len(self.vocabulary), 64)
        while len({self.slot(w) for w in self.vocabulary}) < len(self.vocabulary):
            self.size += max(1, self.size // 16)

    def slot(self, word: str) -> int:
        return zlib.crc32(word.encode()) % self.size

    def hits(self, words: Column) -> Column:
        """Position * size + slot of each word of a text that occurs in a template; one walk over the words, whatever the number of templates."""
        names: list = [None] * self.size
        for w in self.vocabulary:
            names[self.slot(w)] = w
        filed = _constant(names, "array<string>")
        slot = lambda w: (F.crc32(w.cast("binary")) % self.size).cast("int")
        return F.filter(F.transform(words, lambda w, i: F.when(F.get(filed, slot(w)) == w, i.cast("bigint") * self.size + slot(w))), lambda x: x.isNotNull())

    def _postings(self, chosen: list[tuple[int, int, int]]) -> Column:
        """By slot, the keys (template, offset) of chosen (template, offset, slot): a hit at place i adds i to each."""
        filed: list = [None] * self.size
        for t, offset, slot in chosen:
            filed[slot] = [*(filed[slot] or []), t * SHIFT + BIAS - offset]
        return _constant(filed, "array<array<bigint>>")

    def starts(self, hits: Column, chosen: list[tuple[int, int, int]]) -> Column:
        """Keys (template, start) that the hits on chosen words speak for."""
        filed = self._postings(chosen)
        at = lambda h: F.get(filed, (h % self.size).cast("int"))
        some = F.filter(hits, lambda h: at(h).isNotNull())
        return F.flatten(F.transform(some, lambda h: F.transform(at(h), lambda key: key + F.floor(h / self.size))))


def inverse_document_frequencies(hits: DataFrame, index: Index) -> dict[str, float]:
    """IDF of each template word over all rows of (hits); one count per word reaches the driver."""
    slots = F.array_distinct(F.transform("hits", lambda h: h % index.size))
    counts = {r["slot"]: r["count"] for r in hits.select(F.explode(F.concat(F.array(F.lit(-1).cast("bigint")), slots)).alias("slot")).groupBy("slot").count().collect()}
    total = counts.get(-1, 0)
    return {w: math.log((1 + total) / (1 + counts.get(index.slot(w), 0))) for w in index.vocabulary}


def scan_licenses(docs: DataFrame, templates: list[Template] = TEMPLATES, rare: int = RARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    1. Each text is split and walked once; the places of words that occur in any template are kept (hits). They give the
       words' IDF and all that follows, so texts are read once, and templates only make the index larger.
    2. The words of a file that are the rarest of some key phrase (by IDF) are looked up; their postings, shifted by
       their place in the phrase, are possible starts. Those stay on which the postings of the phrase's next rare words agree.
    3. The starts that are left are joined with the postings of all other words of the phrases, so that
       exactly the places where a whole key phrase stands are left.

    n_base counts all places of the contract's phrases, first_word and last_word are their smallest and largest
    start, labels adds the method's own templates. score is the largest share of a template's text that
    stands in place around the first place of its key phrase (0 without labels).

    Null or empty text: no words, no labels, score 0. Repeated rows are scanned one by one; a null
    doc_id is carried along; other columns are ignored. Very long texts are scanned whole.
    """
    index = Index(templates)
    words = docs.select("doc_id", text_words(body("text")).alias("w"))
    found = materialise(words.select("doc_id", F.size("w").cast("bigint").alias("n_words"), index.hits(F.col("w")).alias("hits")), "license-hits")
    idf = inverse_document_frequencies(found, index)
    keys = [t.key.split() for t in templates]
    by_rarity = [sorted(range(len(k)), key=lambda i: (-idf[k[i]], i)) for k in keys]
    # Turn r: the r-th rarest word of each phrase; a phrase without so many words stands with its last one again.
    turns = [[(t, at[min(r, len(at) - 1)], index.slot(keys[t][at[min(r, len(at) - 1)]])) for t, at in enumerate(by_rarity)] for r in range(max(map(len, keys)))]
    rows = found.withColumn("places", index.starts(F.col("hits"), turns[0]))
    for turn in turns[1:]:
        rows = rows.withColumn("places", F.when(F.size("places") > 0, F.array_intersect("places", index.starts(F.col("hits"), turn))).otherwise(F.col("places")))
    names = _constant([t.label for t in templates], "array<string>")
    is_base = _constant([t.base for t in templates], "array<boolean>")
    which = lambda key: F.floor(key / SHIFT).cast("int")
    base = F.transform(F.filter("places", lambda p: F.get(is_base, which(p))), lambda p: p % SHIFT - BIAS)
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: F.get(names, which(p))))), ",")
    # Around the first place of each template: its words as hits that would stand there.
    lines = _constant([[[k - t.before(), index.slot(w)] for k, w in enumerate(t.text.split())] for t in templates], "array<array<array<bigint>>>")
    first = F.filter("places", lambda p: ~F.exists("places", lambda q: (which(q) == which(p)) & (q < p)))
    wanted = lambda p: F.transform(F.get(lines, which(p)), lambda x: (p % SHIFT - BIAS + x[0]) * index.size + x[1])
    share = lambda p: F.size(F.array_intersect(wanted(p), F.col("hits"))) / F.size(F.get(lines, which(p)))
    out = rows.select("doc_id", "n_words", "hits", "places", base.alias("base"))
    return out.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min("base").alias("first_word"), F.array_max("base").alias("last_word"),
        labels(F.filter("places", lambda p: F.get(is_base, which(p)))).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.when(F.size("places") == 0, F.lit(0.0)).otherwise(F.array_max(F.transform(first, share))).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    places, scores = [], []
    for i, t in enumerate(TEMPLATES):
        line, key, before = t.text.split(), t.key.split(), t.before()
        same = " AND ".join(f"w[s + {k + 1}] = '{x}'" for k, x in enumerate(key))
        places.append(f"CASE WHEN list_contains(w, '{key[0]}') THEN list_filter(range(len(w)), lambda s: {same}) ELSE [] END AS p{i}")
        near = " + ".join(f"CASE WHEN s >= {before - k} AND w[s + {k - before + 1}] = '{x}' THEN 1 ELSE 0 END" for k, x in enumerate(line))
        scores.append(f"coalesce(list_max(list_transform(p{i}[1:1], lambda s: {near})), 0) / {float(len(line))}")
    base = [i for i, t in enumerate(TEMPLATES) if t.base]
    starts = "list_concat(" + ", ".join(f"p{i}" for i in base) + ")"

    def named(which):
        items = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{TEMPLATES[i].label}' END" for i in which)
        return f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{items}], lambda x: x IS NOT NULL))), ','), '')"

    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, {", ".join(places)} FROM d)
SELECT doc_id, len(w) AS n_words, len({starts}) AS n_base, list_min({starts}) AS first_word, list_max({starts}) AS last_word,
  {named(base)} AS base_labels, {named(range(len(TEMPLATES)))} AS labels,
  greatest({", ".join(scores)}) AS score
FROM p
"""


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLES = {"op6_license_scan": _sql()}
