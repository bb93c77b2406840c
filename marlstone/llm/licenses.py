"""License scans by an exact set-similarity join of text blocks with license templates.

A block is a window of consecutive words, a quarter longer than the template (a shorter text is one block). A template
of m distinct words matches a block that holds at least t = ceil(threshold * m) of them. Words are ordered by how many
documents of the whole corpus have them, rarest first; a block that holds t of m words must hold one of the first
m - t + 1 in that order (prefix filter), the text needs t distinct words (length filter), and of the words from a hit's
place in the order on, enough must be in the text to reach t (positional filter). What passes is verified window by
window, so the join is exact: it finds every block over the threshold.

Beside that, three fixed phrases are counted wherever their words stand consecutively.

Defined results: null text counts as empty: no words, null places, empty labels, score zero. Repeated rows are scanned
each. Extra columns are ignored. Templates are a bounded dictionary (``MOST_TEMPLATE_WORDS``), held by every task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import common

#: Share of a template's distinct words that a block must hold.
THRESHOLD = 0.9
#: Words that all templates together may have; more are refused rather than broadcast.
MOST_TEMPLATE_WORDS = 100_000
#: Windows are this much longer than their template.
SLACK = 1.25

#: Phrases that are found as they stand, and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices by label. The longer ones open the licenses' own texts.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

SCAN_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label: string, start: long, words: long, containment: double>>"

_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lowering A-Z, on UTF-8: digits, a-z and all beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_KEPT).split()


@dataclass
class Template:
    label: str
    length: int  # words, repeats included
    order: list[bytes]  # distinct words, rarest in the corpus first
    need: int

    @property
    def prefix(self) -> list[bytes]:
        return self.order[: len(self.order) - self.need + 1]


def arrange(templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float) -> list[Template]:
    out = []
    for label, text in templates:
        w = words(text)
        order = sorted(set(w), key=lambda x: (frequency.get(x, 0), x))
        if order:
            out.append(Template(label, len(w), order, math.ceil(threshold * len(order) - 1e-9)))
    return out


def phrase_places(ws: list[bytes], phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    joined = b" %b " % b" ".join(ws)
    out = []
    for phrase, label in phrases.items():
        at, seen, word = joined.find(phrase), 0, 0
        while at >= 0:
            word += joined.count(b" ", seen, at)
            out.append((word, label))
            seen, at = at, joined.find(phrase, at + 1)
    return out


def blocks_of(ws: list[bytes], template: Template) -> list[tuple[int, int, int]]:
    """All blocks that match, overlapping windows joined: first word, word after the last, most distinct words held."""
    width = max(template.length, math.ceil(SLACK * template.length))
    wanted, inside, out, start = set(template.order), Counter(), [], 0
    places = [i for i, w in enumerate(ws) if w in wanted]
    for i in places:
        inside[ws[i]] += 1
        while places[start] <= i - width:
            left = ws[places[start]]
            inside[left] -= 1
            if not inside[left]:
                del inside[left]
            start += 1
        if len(inside) >= template.need:
            if out and places[start] < out[-1][1]:
                out[-1] = (out[-1][0], i + 1, max(out[-1][2], len(inside)))
            else:
                out.append((places[start], i + 1, len(inside)))
    return out


def candidates(own: set[bytes], templates: list[Template], index: dict[bytes, list[tuple[int, int]]]) -> list[int]:
    """Templates that pass the prefix, length and positional filters for a text with these distinct words."""
    passed = {}
    for word in own & index.keys():
        for k, place in index[word]:
            t = templates[k]
            if k not in passed and len(own) >= t.need and len(t.order) - place >= t.need - sum(x in own for x in t.order[:place]):
                passed[k] = sum(x in own for x in t.order) >= t.need
    return [k for k, ok in passed.items() if ok]


def word_frequencies(documents: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many of all documents each word of the templates stands; as many rows as the templates have words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = Counter()
        for rows in batches:
            for text in rows["text"]:
                n.update(vocabulary.intersection(words(text or "")))
        yield pd.DataFrame({"word": list(n.keys()), "n": list(n.values())})

    counted = common.require(documents, "text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


def scan(documents: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, phrases: dict[str, str] | None = None) -> DataFrame:
    """A row for each document (SCAN_SCHEMA): phrase places, labels of both ways, best containment, matched blocks."""
    templates = TEMPLATES if templates is None else templates
    vocabulary = {w for _, text in templates for w in words(text)}
    if sum(len(words(text)) for _, text in templates) > MOST_TEMPLATE_WORDS:
        raise ValueError("too many template words to hold in every task")
    arranged = arrange(templates, word_frequencies(documents, vocabulary), threshold)
    index: dict[bytes, list[tuple[int, int]]] = {}
    for k, t in enumerate(arranged):
        for place, word in enumerate(t.prefix):
            index.setdefault(word, []).append((k, place))
    sought = {b" %b " % p.encode(): label for p, label in (PHRASES if phrases is None else phrases).items()}

    def one(doc_id: object, text: str) -> tuple:
        ws = words(text)
        places = phrase_places(ws, sought)
        blocks = []
        own = set(ws)
        for k in candidates(own, arranged, index):
            t = arranged[k]
            blocks += [{"label": t.label, "start": s, "words": e - s, "containment": held / len(t.order)} for s, e, held in blocks_of(ws, t)]
        base = {label for _, label in places}
        starts = [p for p, _ in places]
        score = 1.0 if places else max((b["containment"] for b in blocks), default=0.0)
        return doc_id, len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {b["label"] for b in blocks})), score, blocks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = pd.DataFrame([one(i, t or "") for i, t in zip(rows["doc_id"], rows["text"], strict=True)], columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])
            yield out.astype({"doc_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    docs = common.require(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInPandas(run, SCAN_SCHEMA)
