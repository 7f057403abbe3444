"""Operator 9: license scan by an exact set-similarity join.

Text blocks are joined with license templates where a block holds at least
``CONTAINMENT`` of a template's distinct words. Blocks are the lines (of lines
over ``BLOCK_WORDS`` words, windows of that length at every half length) and,
for notices wrapped over several lines, the windows of that length at every
half length over the words of the whole text. They hold every run of
``BLOCK_WORDS // 2 + 1`` words; with a template longer than that, windows are
twice as long as the longest one. The words of
the templates are ordered by how many documents of the corpus hold them,
rarest first. A block that reaches the threshold must hold one of a
template's first ``|T| - need + 1`` words in that order (prefix filter); it
must have at least ``need`` distinct words (length filter); and the words
left after the first common one must suffice on both sides (positional
filter). What passes is counted exactly, so no block is missed.

The templates are a fixed small table, so their prefix index goes to every
task and the texts are never shuffled; the counts of the template words are
one aggregate over all documents.

Defined results: a null text counts as empty: no words, labels empty, score
0, null places; repeated rows repeat; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import documents, map_rows

CONTAINMENT = 0.9
BLOCK_WORDS = 64
# Words of the lower-cased text, over its UTF-8 bytes: a character outside ASCII is a word character.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

# Phrases and their labels (fixed values).
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# License notices as they stand in files and texts (fixed values): label, words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
            "provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial license"),
    ("cc-by-sa", "creative commons attribution sharealike license"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published "
            "by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def tokens(text: str | None) -> list[bytes]:
    return WORDS.findall(text.encode().lower()) if text else []


def template_sets(templates=TEMPLATES) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(WORDS.findall(words.encode().lower()))) for label, words in templates]


def corpus_counts(docs: DataFrame, templates=TEMPLATES) -> dict[bytes, int]:
    """Documents of the corpus that hold each template word; the result is as long as the templates' word list."""
    vocabulary = frozenset().union(*(t for _, t in template_sets(templates)))

    def run(batches):
        for b in batches:
            n = Counter()
            for text in b["text"]:
                n.update(vocabulary.intersection(tokens(text)))
            yield {"word": [w.decode() for w in n], "n": list(n.values())}

    rows = map_rows(docs.select("text"), "word string, n long", run).groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r.word.encode(): r.n for r in rows}


class Matcher:
    """The templates in the corpus order of words, and the index of their prefixes."""

    def __init__(self, counts: dict[bytes, int], templates=TEMPLATES, containment: float = CONTAINMENT,
                 across_lines: bool = False):
        """``across_lines``: the windows over the whole text as well as the lines."""
        self.across_lines = across_lines
        # A window holds every passage of half its words: two windows' step covers the longest template.
        self.window = max([BLOCK_WORDS, *(2 * len(tokens(words)) for _, words in templates)])
        sets = template_sets(templates)
        words = sorted(frozenset().union(*(t for _, t in sets)), key=lambda w: (counts.get(w, 0), w))
        self.place = {w: i for i, w in enumerate(words)}
        self.templates = [(label, sorted(t, key=self.place.__getitem__), math.ceil(containment * len(t) - 1e-9))
                          for label, t in sets]
        self.prefixes: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, t, need) in enumerate(self.templates):
            for i, w in enumerate(t[: len(t) - need + 1]):
                self.prefixes.setdefault(w, []).append((k, i))

    def match(self, block: list[bytes]) -> dict[str, float]:
        """label -> largest share of a template that the block holds, at or above the threshold."""
        held = set(block)
        # Only words of templates can be shared; they come in the corpus order.
        own = sorted(held & self.place.keys(), key=self.place.__getitem__)
        found: dict[str, float] = {}
        done: set[int] = set()
        for j, w in enumerate(own):
            for k, i in self.prefixes.get(w, ()):
                label, t, need = self.templates[k]
                if k in done:
                    continue
                done.add(k)  # the first common word in the order: the bound below holds for it
                if len(held) < need or 1 + min(len(t) - i - 1, len(own) - j - 1) < need:
                    continue
                common = len(held.intersection(t))
                if common >= need:
                    found[label] = max(found.get(label, 0.0), common / len(t))
        return found

    def _windows(self, words: list[bytes]):
        half = self.window // 2
        for a in range(0, max(1, len(words) - half), half):
            yield a, words[a:a + 2 * half]

    def blocks(self, text: str):
        """Word lists of the text's lines, with the number of words before each."""
        before = 0
        for line in text.encode().lower().split(b"\n"):
            words = WORDS.findall(line)
            for a, block in self._windows(words):
                yield before + a, block
            before += len(words)

    def matches(self, text: str):
        """(first word, number of words, label, share) of the blocks at or above the threshold. A window over
        the whole text is passed over for a label that a line within it holds to the same share."""
        in_lines = []
        for at, block in self.blocks(text):
            for label, share in sorted(self.match(block).items()):
                in_lines.append((at, len(block), label, share))
        yield from in_lines
        if not self.across_lines or "\n" not in text:
            return
        starts = [found[0] for found in in_lines]
        for at, block in self._windows(tokens(text)):
            end = at + len(block)
            within = in_lines[bisect_left(starts, at):bisect_left(starts, end)]
            for label, share in sorted(self.match(block).items()):
                if not any(name == label and s >= share and a + n <= end for a, n, name, s in within):
                    yield at, len(block), label, share

    def scan(self, text: str | None) -> dict:
        words = tokens(text)
        places: list[int] = []
        base: set[str] = set()
        labels: dict[str, float] = {}
        present = set(words)
        if not present.isdisjoint(PHRASE_WORDS):
            line = b" " + b" ".join(words) + b" "
            for phrase, label in PHRASES.items():
                sought = b" " + phrase.encode() + b" "
                at, last, before = line.find(sought), 0, 0
                while at >= 0:
                    before += line.count(b" ", last, at)  # the words before this place
                    last = at
                    places.append(before)
                    base.add(label)
                    at = line.find(sought, at + 1)
        if not present.isdisjoint(self.prefixes):
            for _, _, label, share in self.matches(text):
                labels[label] = max(labels.get(label, 0.0), share)
        return {"n_words": len(words), "n_base": len(places),
                "first_word": min(places, default=None), "last_word": max(places, default=None),
                "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels.keys())),
                "score": 1.0 if base else max(labels.values(), default=0.0)}


# The last word of each phrase: a text without any of them has no place.
PHRASE_WORDS = frozenset(p.split()[-1].encode() for p in PHRASES)


def scan_licenses(docs: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Per row: doc_id, the places of the phrases, labels and score."""
    shared = docs.sparkSession.sparkContext.broadcast(Matcher(corpus_counts(docs), containment=containment, across_lines=True))
    schema = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
              "base_labels string, labels string, score double")

    def run(batches):
        for b in batches:
            rows = [shared.value.scan(t) for t in b["text"]]
            yield {"doc_id": b["doc_id"], **{k: [r[k] for r in rows] for k in Matcher.scan(shared.value, None)}}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), schema, run)


def matching_blocks(docs: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, first_word, n_words, label, containment of every block that meets the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(Matcher(corpus_counts(docs), containment=containment, across_lines=True))

    def run(batches):
        for b in batches:
            rows = [(d, *found) for d, t in zip(b["doc_id"], b["text"]) if t for found in shared.value.matches(t)]
            names = ("doc_id", "first_word", "n_words", "label", "containment")
            yield {n: [r[i] for r in rows] for i, n in enumerate(names)}

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"),
                    "doc_id long, first_word long, n_words long, label string, containment double", run)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
