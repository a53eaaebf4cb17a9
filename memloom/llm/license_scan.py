"""License notices in texts, exact phrases and fuzzy short notices.

A text's words (ASCII letters in lower case) are joined by single spaces. A
notice that may differ by k edits is split into k + 1 pieces: an occurrence
with at most k edits leaves one piece unharmed, so an automaton over all pieces finds
every place worth a look. There the regex library's bounded-error matching
decides, and reports words and edits. Matches begin and end at words.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

# Phrases whose exact occurrences are counted, and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: (label, words that must stand as they are, words that may differ, edits).
NOTICES = (
    ("apache", "", "apache license", 1),
    ("apache", "", "licensed under the apache license version 2 0", 4),
    ("gpl", "", "gnu general public license", 2),
    ("gpl", "", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 10),
    ("lgpl", "", "gnu lesser general public license", 2),
    ("agpl", "", "gnu affero general public license", 2),
    ("mit", "mit ", "license", 1),
    ("mit", "", "permission is hereby granted free of charge to any person obtaining a copy", 7),
    ("bsd", "bsd ", "license", 1),
    ("bsd", "", "redistribution and use in source and binary forms with or without modification are permitted", 8),
    ("isc", "", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 10),
    ("mpl", "", "mozilla public license", 2),
    ("epl", "", "eclipse public license", 2),
    ("bsl", "", "boost software license", 2),
    ("cc-by", "", "creative commons attribution", 2),
    ("unlicense", "", "this is free and unencumbered software released into the public domain", 6),
)

#: Upper case to lower case, everything that is no word to a blank.
TABLE = bytes(b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 32 for b in range(256))

SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("edits", T.IntegerType()), T.StructField("allowed", T.IntegerType())])


def normal(text: str) -> tuple[str, int]:
    """The words joined by single spaces, and their number."""
    words = text.encode("utf-8", "replace").translate(TABLE).split()
    return b" ".join(words).decode("utf-8"), len(words)


def pieces(body: str, edits: int) -> list[tuple[int, str]]:
    """``edits`` + 1 pieces of nearly equal length with their offsets."""
    n = edits + 1
    at = [len(body) * i // n for i in range(n + 1)]
    return [(at[i], body[at[i] : at[i + 1]]) for i in range(n)]


class Scanner:
    """An automaton over the pieces of all notices, and a bounded-error pattern for each."""

    def __init__(self, notices=NOTICES, phrases=None):
        self.notices, self.phrases = notices, PHRASES if phrases is None else phrases
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (_, head, body, edits) in enumerate(notices):
            for offset, piece in pieces(body, edits):
                seeds.setdefault(piece, []).append((i, offset + len(head)))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()
        self.patterns = [regex.compile(rf"(?b)(?<![^ ]){regex.escape(head)}(?:{regex.escape(body)}){{e<={edits}}}(?![^ ])") for _, head, body, edits in notices]

    def exact(self, norm: str) -> list[tuple[str, int]]:
        """Label and first word of every place of a phrase, overlaps included."""
        padded, found = f" {norm} ", []
        for phrase, label in self.phrases.items():
            at, word, last = padded.find(f" {phrase} "), 0, 0
            while at >= 0:
                word, last = word + padded.count(" ", last, at), at
                found.append((label, word))
                at = padded.find(f" {phrase} ", at + 1)
        return found

    def windows(self, norm: str) -> dict[int, list[list[int]]]:
        """Stretches of text, in order and apart from each other, that may hold a notice, by notice."""
        starts: dict[int, list[int]] = {}
        for end, (size, uses) in self.automaton.iter(norm):
            for i, offset in uses:
                starts.setdefault(i, []).append(end + 1 - size - offset)
        out = {}
        for i, places in starts.items():
            _, head, body, edits = self.notices[i]
            merged: list[list[int]] = []
            for at in sorted(places):
                low, high = max(0, at - edits), min(len(norm), max(0, at) + len(head) + len(body) + 2 * edits)
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(high, merged[-1][1])
                else:
                    merged.append([low, high])
            out[i] = merged
        return out

    def fuzzy(self, norm: str) -> list[tuple[str, int, int, int, int]]:
        """Label, first and last word, edits made and allowed, of every notice found."""
        found = []
        for i, merged in sorted(self.windows(norm).items()):
            label, _, _, allowed = self.notices[i]
            word, last = 0, 0
            for low, high in merged:
                stop = norm.find(" ", high)
                low, high = norm.rfind(" ", 0, low) + 1, len(norm) if stop < 0 else stop
                for m in self.patterns[i].finditer(norm, max(low, last), high):
                    word, last = word + norm.count(" ", last, m.start()), m.start()
                    length = norm.count(" ", m.start(), m.end())
                    found.append((label, word, word + length, sum(m.fuzzy_counts), allowed))
                    word, last = word + length, m.end()
        return sorted(set(found), key=lambda s: (s[1], s[2], s[0], s[3]))


def scan(docs: DataFrame, notices=NOTICES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words``, ``places`` (label and word of exact phrases) and ``spans`` (fuzzy notices) of every text.

    A null text is empty, repeated rows get a row each, texts are read whole.
    """
    place = T.StructType([T.StructField("label", T.StringType()), T.StructField("word", T.LongType())])
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(place)), T.StructField("spans", T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        places_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
        spans_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("allowed", pa.int32())]))
        names = ["label", "first_word", "last_word", "edits", "allowed"]
        for batch in batches:
            for start, texts in slices(batch, text):
                sizes, places, spans = [], [], []
                for t in texts:
                    norm, n = normal(t)
                    sizes.append(n)
                    places.append([{"label": a, "word": w} for a, w in scanner.exact(norm)])
                    spans.append([dict(zip(names, s)) for s in scanner.fuzzy(norm)])
                yield pa.record_batch([batch.column(0).slice(start, len(texts)), pa.array(sizes, pa.int64()), pa.array(places, places_type), pa.array(spans, spans_type)], schema.names)

    return docs.select(key, text).mapInArrow(run, schema)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One flat row per text: counts, labels, a score (1 for an exact phrase, else 1 less the share of the
    allowed edits plus one that the best notice used; 0 without any) and ``spans`` as label:first:last:edits."""
    words = F.transform("places", lambda p: p["word"])
    exact = F.transform("places", lambda p: p["label"])
    near = F.transform("spans", lambda s: s["label"])
    joined = lambda labels: F.concat_ws(",", F.array_sort(F.array_distinct(labels)))
    best = F.array_max(F.transform("spans", lambda s: 1 - s["edits"] / (s["allowed"] + 1)))
    shown = F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["first_word"], s["last_word"], s["edits"]))
    return found.select(
        key,
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        joined(exact).alias("base_labels"),
        joined(F.concat(exact, near)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        F.concat_ws(",", shown).alias("spans"),
    )
