"""Operator 11: license scans as an exact set-similarity join of text blocks with license templates.

A template of w words is joined with the *text blocks* of 2w words that start at
every multiple of w (a text's last ones may be shorter), so a passage of up to w words lies
whole in one of them. A block matches if its set of words holds at least the
share ``LEAST`` of the template's set (containment).

The join is the prefix-filter join on globally ordered tokens:

* *order*: the template words by the number of texts of the whole corpus that hold them, the
  rarest first (counted on Spark, one row a template word);
* *prefix filter*: of a template of k different words, a match lacks at most
  k - need; so it holds one of the first k - need + 1 words of the order. Only those are indexed,
  and only places of such words open a candidate block;
* *positional filter*: the candidate's first shared word stands at place p of the
  template's order, so at most k - p words can be shared;
* *length filter*: a block with fewer than ``need`` words, or with fewer words after the
  candidate's filters than ``need``, cannot match.

What is left is checked on the full sets. Templates are a stated list (a parameter,
at most ``MOST_TEMPLATE_WORDS`` words in all), so their index goes to every task; documents are
read where they lie, nothing of them is shuffled, and a very frequent word costs nothing more.

*Phrases* are the plain part: words that stand consecutively give a label wherever they occur.

Defined cases: NULL and empty texts have no words, no places, labels '' and score 0; equal rows
are returned each; a template without words matches nothing; other columns are ignored;
an empty table gives no rows. The score is the largest containment of a matching template,
1 where a phrase occurs, else 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, ready, slices, table
from .decontaminate import words

LEAST = 0.8
MOST_TEMPLATE_WORDS = 200_000

# Phrases and their labels
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Public license notices, (label, text)
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "Released under the terms of the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)


@dataclass
class Template:
    """One template as its distinct words in the global order."""
    label: str
    size: int                 # words, repeats counted
    order: list[bytes]        # distinct words, the rarest first
    need: int                 # words a matching block must hold
    held: set[bytes] = field(default_factory=set)

    def prefix(self) -> list[bytes]:
        return self.order[:len(self.order) - self.need + 1]


def needed(k: int, least: float) -> int:
    """The least whole number of shared words whose share of ``k`` reaches ``least``."""
    n = max(1, int(least * k))
    while n / k < least:
        n += 1
    while n > 1 and (n - 1) / k >= least:
        n -= 1
    return n


def ordered_templates(templates: Sequence[tuple[str, str]], held_by: dict[bytes, int], least: float) -> list[Template]:
    out = []
    for label, text in templates:
        own = words(text)
        distinct = sorted(set(own), key=lambda w: (held_by.get(w, 0), w))
        if distinct:
            out.append(Template(label, len(own), distinct, needed(len(distinct), least), set(distinct)))
    return out


def token_counts(docs: DataFrame, templates: Sequence[tuple[str, str]]) -> dict[bytes, int]:
    """For every template word the number of texts of ``docs(text)`` that hold it."""
    known = {w for _, text in templates for w in words(text)}
    if len(known) > MOST_TEMPLATE_WORDS or sum(len(words(t)) for _, t in templates) > MOST_TEMPLATE_WORDS:
        raise ValueError("the list of templates is too long to be sent to every task")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(known, 0)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                for w in known.intersection(words(text)):
                    total[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    ready(docs.sparkSession)
    summed = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in summed.collect()}   # a row a template word


class Index:
    """Prefix words to (template, place in its order)."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        self.at: dict[bytes, list[tuple[int, int]]] = {}
        for t, own in enumerate(templates):
            for p, w in enumerate(own.prefix()):
                self.at.setdefault(w, []).append((t, p))
        self.rare = frozenset(self.at)

    def candidates(self, text: list[bytes]) -> dict[tuple[int, int], int]:
        """(template, start of a block) -> least place in the order of the prefix words seen in it."""
        found: dict[tuple[int, int], int] = {}
        if self.rare.isdisjoint(text):
            return found
        for i, w in enumerate(text):
            for t, p in self.at.get(w, ()):
                size = self.templates[t].size
                last = i - i % size
                for start in {last, max(0, last - size)}:
                    if p < found.get((t, start), p + 1):
                        found[t, start] = p
        return found

    def matches(self, text: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start of the block, containment) of every matching block."""
        out = []
        for (t, start), p in sorted(self.candidates(text).items()):
            own = self.templates[t]
            k = len(own.order)
            if k - p < own.need or len(text) - start < own.need:            # positional and length filter
                continue
            shared = len(own.held.intersection(text[start:start + 2 * own.size]))
            if shared >= own.need:
                out.append((t, start, shared / k))
        return out


def phrase_places(text: list[bytes], phrases: Sequence[tuple[list[bytes], str]]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand consecutively."""
    out = []
    joined = b" " + b" ".join(text) + b" "
    for own, label in phrases:
        needle = b" " + b" ".join(own) + b" "
        at, seen, place = joined.find(needle), 0, 0
        while at >= 0:
            place += joined.count(b" ", seen, at)
            seen = at
            out.append((place, label))
            at = joined.find(needle, at + 1)
    return out


FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
BLOCKS = "label string, template long, first_word long, containment double"


def _shared(docs: DataFrame, templates: Sequence[tuple[str, str]], least: float):
    spark = ready(docs.sparkSession)
    return spark.sparkContext.broadcast(Index(ordered_templates(templates, token_counts(docs, templates), least)))  # of the stated list's size


def _typed(docs: DataFrame, kept: Sequence[str], rest: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), rest])


def scan(docs: DataFrame, extra: Sequence[str] = ("doc_id",), templates: Sequence[tuple[str, str]] = TEMPLATES,
         phrases: Sequence[tuple[str, str]] = PHRASES, least: float = LEAST) -> DataFrame:
    """A row per row of ``docs(text)``: columns ``extra``, phrase places, labels and score."""
    index, plain, kept = _shared(docs, templates, least), [(words(p), label) for p, label in phrases], list(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, rows = batch.column(len(kept)).to_pylist(), []
            for a, b in blocks(texts):
                for text in texts[a:b]:
                    own = words(text)
                    base = phrase_places(own, plain)
                    found = index.value.matches(own)
                    names = {label for _, label in base}
                    starts = [p for p, _ in base]
                    rows.append((len(own), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(names)),
                                 ",".join(sorted(names | {index.value.templates[t].label for t, _, _ in found})),
                                 1.0 if base else max((c for _, _, c in found), default=0.0)))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                             names=[*kept, *(x.split()[0] for x in FOUND.split(", "))])

    return docs.select(*kept, F.col("text").alias("_text")).mapInArrow(run, _typed(docs, kept, FOUND))


def matching_blocks(docs: DataFrame, extra: Sequence[str] = ("doc_id",), templates: Sequence[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """Every (row of ``docs``, text block, template) of the join: columns ``extra``, the template's label and number among those with
    words, the block's first word and the containment."""
    index, kept = _shared(docs, templates, least), list(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, out = [], []
            for i, text in enumerate(batch.column(len(kept)).to_pylist()):
                for t, start, share in index.value.matches(words(text)):
                    at.append(i)
                    out.append((index.value.templates[t].label, t, start, share))
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(kept))), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                                             names=[*kept, *(x.split()[0] for x in BLOCKS.split(", "))])

    return docs.select(*kept, F.col("text").alias("_text")).mapInArrow(run, _typed(docs, kept, BLOCKS))


def op11_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return scan(table(spark, sf_dir, "documents"))
