"""Licence scan with a positional index of rare words.

Licence notices are kept as templates: words with positions. All words of all
templates are indexed, word -> postings (template, position), and their inverse
document frequency is taken over the whole corpus. A file looks up its own licence
words, the one with the highest IDF first. Each posting met becomes an anchor of
its template, until the template has as many as any match must agree on: a match
holds a share ``MIN_COVERAGE`` of the template's words, so of the words that the
file has, all but a known number stand at their places. A template that lacks too
many words, or a word of a key phrase, is left out. Where an anchor of position q
stands at p it votes for a start at p - q; the votes that agree are the
intersection of the postings by relative position. A start with enough votes is
verified: each key phrase of the template must stand at its place, and the share
of template words at their places is the match's coverage. So no match is lost,
whatever the frequencies are; they decide only how much is looked at.

A short phrase that names a licence is a template whose only key phrase is the
phrase itself, whose words must all be there: one anchor finds every place of it.

Defined cases: a null text counts as empty and has no words and no matches;
matches may overlap and repeat; rows repeated whole give the same result each;
an empty table gives an empty result; other columns are ignored. A file is
handled whole, in time linear in its words and anchor hits.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innsight.llm.tables import binary_values, column, read_table

MIN_VOTES = 2  # anchors that must agree on a notice's start
MIN_COVERAGE = 0.7  # of a notice's words at their places

# every byte that is no part of a word becomes a space, A-Z becomes a-z
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def split_words(text: bytes) -> list[bytes]:
    """Words of digits, letters and non-ASCII characters; A-Z as a-z."""
    return text.translate(_WORD_BYTES).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[int, tuple[bytes, ...]], ...]  # (place in words, words)
    base: bool  # a phrase alone

    @cached_property
    def vital(self) -> frozenset[bytes]:
        """Words without which there is no match."""
        return frozenset(w for _, wanted in self.phrases for w in wanted)

    @cached_property
    def least_hits(self) -> int:
        """Words that must stand at their places."""
        n = len(self.words)
        return n if self.base else next(h for h in range(1, n + 1) if h / n >= MIN_COVERAGE)

    @property
    def votes(self) -> int:
        return min(1 if self.base else MIN_VOTES, self.least_hits)


def notice(label: str, text: str, *key_phrases: str) -> Template:
    words = tuple(split_words(text.encode()))
    placed = []
    for phrase in key_phrases:
        wanted = tuple(split_words(phrase.encode()))
        place = next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted)
        placed.append((place, wanted))
    return Template(label, words, tuple(placed), False)


def phrase(label: str, text: str) -> Template:
    words = tuple(split_words(text.encode()))
    return Template(label, words, ((0, words),), True)


# The four base phrases.
BASE_PHRASES = [
    phrase("gpl", "gnu general public license"),
    phrase("apache", "apache license"),
    phrase("cc-by", "cc by"),
    phrase("mit", "mit license"),
]

# Wording that the licences themselves prescribe, with the words
# that must not be missing.
NOTICES = [
    notice("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "gnu affero general public license"),
    notice("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "apache license version 2 0"),
    notice("apache", "Licensed under the Apache License, Version 2.0", "licensed under the apache license version 2 0"),
    notice("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    notice("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution 4 0"),
    notice("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    notice("cc-by-nd", "Licensed under CC BY-ND 4.0", "cc by nd"),
    notice("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa"),
    notice("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "creative commons attribution sharealike"),
    notice("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    notice("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general public license"),
    notice("gpl", "This work is licensed under the GNU General Public License, version 3", "licensed under the gnu general public license"),
    notice("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    notice("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser general public license"),
    notice("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    notice("mit", "Released under the MIT License", "released under the mit license"),
    notice("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public license"),
    notice("unlicense", "This is free and unencumbered software released into the public domain", "free and unencumbered software"),
]

TEMPLATES = BASE_PHRASES + NOTICES


def template_vocabulary(templates: list[Template]) -> set[bytes]:
    return {w for t in templates for w in t.words}


def document_frequencies(df: DataFrame, text_col: str, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of rows, and how many hold each word of the (bounded) vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = Counter(), 0
        for batch in batches:
            for text in binary_values(batch.column(0)):
                rows += 1
                seen.update(vocabulary.intersection(split_words(text)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([None, *seen], pa.binary()), pa.array([rows, *seen.values()], pa.int64())],
            names=["word", "n"],
        )

    counts = (
        df.select(column(df, text_col).cast("binary").alias("text"))
        .mapInArrow(count, "word binary, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .collect()  # one row per word of the vocabulary
    )
    found = {bytes(r.word) if r.word is not None else None: r.n for r in counts}
    return found.pop(None, 0), found


def rare_word_index(
    templates: list[Template], rows: int, frequencies: dict[bytes, int]
) -> tuple[dict[bytes, list[tuple[int, int]]], dict[bytes, float]]:
    """Postings of all template words, word -> [(template, position)], and the words' IDF."""
    postings: dict[bytes, list[tuple[int, int]]] = {}
    for k, t in enumerate(templates):
        for q, w in enumerate(t.words):
            postings.setdefault(w, []).append((k, q))
    return postings, {w: math.log((rows + 1) / (frequencies.get(w, 0) + 1)) for w in postings}


def file_anchors(
    own: set[bytes], templates: list[Template], postings: dict, idf: dict[bytes, float]
) -> dict[int, list[int]]:
    """Anchor positions per template that a file with the licence words ``own`` can hold, its rarest words first."""
    open_: dict[int, int] = {}  # template -> anchors still to be found
    for k, t in enumerate(templates):
        if t.vital <= own:
            spare = sum(w in own for w in t.words) - t.least_hits  # words of the file that may stand elsewhere
            if spare >= 0:
                open_[k] = spare + t.votes
    anchors: dict[int, list[int]] = {k: [] for k in open_}
    if open_:
        for w in sorted(own, key=lambda w: (-idf[w], w)):
            for k, q in postings[w]:
                if open_.get(k, 0) > 0:
                    anchors[k].append(q)
                    open_[k] -= 1
            if not any(open_.values()):
                break
    return anchors


def find_matches(
    words: list[bytes], templates: list[Template], postings: dict, idf: dict[bytes, float]
) -> list[tuple[int, int, float]]:
    """Verified (template, start, coverage) in a file's words, by start."""
    anchors = file_anchors(postings.keys() & set(words), templates, postings, idf)
    if not anchors:
        return []
    wanted_by: dict[bytes, list[tuple[int, int]]] = {}
    for k, at in anchors.items():
        for q in at:
            wanted_by.setdefault(templates[k].words[q], []).append((k, q))
    tally: Counter = Counter()
    for p, w in enumerate(words):
        if w in wanted_by:
            for k, q in wanted_by[w]:
                tally[k, p - q] += 1
    found = []
    for (k, start), n in tally.items():
        t = templates[k]
        if n < t.votes:
            continue
        if any(
            start + at < 0 or tuple(words[start + at : start + at + len(wanted)]) != wanted
            for at, wanted in t.phrases
        ):
            continue
        first = max(0, -start)  # a notice may be cut off at either end of the file
        hits = sum(a == b for a, b in zip(t.words[first:], words[start + first : start + len(t.words)], strict=False))
        if hits >= t.least_hits:
            found.append((k, start, hits / len(t.words)))
    return sorted(found, key=lambda m: (m[1], m[0]))


MATCHES = "array<struct<label: string, base: boolean, start: long, n_words: long, coverage: double>>"


def scan_licenses(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] = TEMPLATES
) -> DataFrame:
    """(id, n_words, matches) per row; a match has label, base, start, n_words, coverage.

    ``start`` counts words from 0 and is negative where a notice's beginning is
    cut off.
    """
    rows, frequencies = document_frequencies(df, text_col, template_vocabulary(templates))
    postings, idf = rare_word_index(templates, rows, frequencies)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(
            pa.struct(
                [
                    ("label", pa.string()),
                    ("base", pa.bool_()),
                    ("start", pa.int64()),
                    ("n_words", pa.int64()),
                    ("coverage", pa.float64()),
                ]
            )
        )
        for batch in batches:
            n, matches = [], []
            for text in binary_values(batch.column("text")):
                words = split_words(text)
                n.append(len(words))
                matches.append(
                    [
                        (templates[k].label, templates[k].base, start, len(templates[k].words), coverage)
                        for k, start, coverage in find_matches(words, templates, postings, idf)
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(matches, kind)],
                names=["id", "n_words", "matches"],
            )

    given = df.select(column(df, id_col).alias("id"), column(df, text_col).cast("binary").alias("text"))
    kind = dict(given.dtypes)["id"]
    return given.mapInArrow(scan, f"id {kind}, n_words long, matches {MATCHES}").withColumnRenamed("id", id_col)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    named = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    # a phrase alone is weaker evidence than a notice around it
    strength = F.transform("matches", lambda m: F.when(m["base"], F.lit(0.5)).otherwise(m["coverage"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"),
        named(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(strength), F.lit(0.0)).alias("score"),
    )
