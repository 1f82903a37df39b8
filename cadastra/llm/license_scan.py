"""Fuzzy search for short licence notices.

A notice that is allowed k errors is split into k + 1 pieces: a text that holds it with at most k edits holds
one of the pieces exactly (pigeonhole). One Aho-Corasick pass over the whole text finds the pieces; around
each, the regex library's bounded-error matching verifies the notice, counts its edits and gives the span.
Texts are compared as words joined by single spaces, A-Z lower-cased, so line breaks and punctuation inside a
notice are not errors. Beside that, three short phrases are searched exactly (the base labels).
"""

from __future__ import annotations

import re
from bisect import bisect_left

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cadastra.llm.common import map_texts, table, worker_state
from cadastra.llm.words import WORD_TABLE, texts

#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Notices (as normalised words) and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("licensed under the gnu general public license", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)
#: One error is allowed for so many characters of a notice.
CHARS_PER_ERROR = 12


def split_pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of about equal length with their offsets."""
    cuts = [round(i * len(notice) / (errors + 1)) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices=NOTICES, phrases=PHRASES, chars_per_error: int = CHARS_PER_ERROR):
        self.notices, self.patterns, owners = [], [], {}
        for n, (notice, label) in enumerate(notices):
            errors = len(notice) // chars_per_error
            flat = notice.encode().decode("latin-1")
            self.notices.append((label, len(flat), errors))
            self.patterns.append(regex.compile(f"(?b)(?:{regex.escape(flat, special_only=True)}){{e<={errors}}}"))
            for offset, piece in split_pieces(flat, errors):
                owners.setdefault(piece, []).append((n, offset, len(piece)))
        self.seeds = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.seeds.add_word(piece, own)
        if owners:
            self.seeds.make_automaton()
        self.labels = [label for _, label in phrases]
        body = b"|".join(b"(%s)" % b" +".join(p.encode().split()) for p, _ in phrases)
        self.base = re.compile(rb"(?<![^ ])(?:%s)(?![^ ])" % body) if phrases else None
        self.last = sorted({p.split()[-1].encode() for p, _ in phrases})

    def phrases(self, spaced: bytes) -> list[tuple[str, int]]:
        """(label, first word's index) of every place of a base phrase."""
        if self.base is None or not any(w in spaced for w in self.last):
            return []
        out, at, index = [], 0, 0
        for m in self.base.finditer(spaced):
            index += len(spaced[at : m.start()].split())
            at = m.start()
            out.append((self.labels[m.lastindex - 1], index))
        return out

    def matches(self, n: int, flat: str, start: int, end: int):
        """The best match of a notice between start and end, and those before and after it."""
        _, length, errors = self.notices[n]
        todo = [(start, end)]
        while todo:
            start, end = todo.pop()
            m = self.patterns[n].search(flat, start, end) if end - start >= length - errors else None
            if m:
                yield m
                todo += [(start, m.start()), (m.end(), end)]

    def fuzzy(self, flat: str) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, edits, similarity) of the notices in normalised text; of overlapping finds the most similar stays."""
        if not len(self.seeds):
            return []
        starts: dict[int, set[int]] = {}
        for end, own in self.seeds.iter(flat):
            for n, offset, size in own:
                starts.setdefault(n, set()).add(end + 1 - size - offset - self.notices[n][2])
        found = []
        for n, places in starts.items():
            label, length, errors = self.notices[n]
            spans: list[list[int]] = []  # pieces of one notice are shifted by its errors at most: one window holds it whole
            for start in sorted(places):
                if spans and start <= spans[-1][0] + 2 * errors:
                    spans[-1][1] = start + length + 2 * errors
                else:
                    spans.append([start, start + length + 2 * errors])
            for start, end in spans:
                for m in self.matches(n, flat, max(0, start), min(len(flat), end)):
                    edits = sum(m.fuzzy_counts)
                    found.append((label, m.start(), m.end(), edits, 1 - edits / length))
        found = sorted(set(found), key=lambda x: (-x[4], x[1] - x[2], x[1], x[0]))
        starts_, out = [], []  # kept finds by place; no two overlap
        for f in found:
            k = bisect_left(starts_, f[2])
            if not k or out[k - 1][2] <= f[1]:
                starts_.insert(k, f[1])
                out.insert(k, f)
        return out

    def scan(self, raw: bytes):
        """Number of words, places of base phrases, notices as (label, first word, start, end, edits, similarity); offsets count bytes of the text."""
        spaced = raw.translate(WORD_TABLE)
        tokens = spaced.split()
        base = self.phrases(spaced)
        flat = b" ".join(tokens).decode("latin-1")
        found, spans = self.fuzzy(flat), []
        if found:
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            ends = np.cumsum(sizes + 1) - 1  # of the words in flat
            starts = ends - sizes
            space = np.frombuffer(spaced, np.uint8) == 0x20
            edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))  # of the words in the text
        for label, start, end, edits, similarity in found:
            # an edit may have taken in the spaces around the notice
            first, last = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(starts, end, "left")) - 1
            spans.append((label, first, int(edges[2 * first]), int(edges[2 * last + 1]), edits, similarity))
        return len(tokens), base, spans


SPAN = "struct<label:string,first_word:bigint,start:bigint,end:bigint,edits:bigint,similarity:double,found:string>"
PLACE = "struct<label:string,word:bigint>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, phrases=PHRASES, chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """id, n_words, places (of base phrases), spans (of notices with at most the allowed edits, and their text).

    Spans are byte ranges of the UTF-8 text. Of finds that overlap the most similar stays, then the longest, the
    first, and the first by label. Null text counts as empty and holds nothing. Repeated rows give repeated
    results; an empty table gives an empty result. Time grows with the text's length and finds alone.
    """
    spark = docs.sparkSession
    key = (tuple(notices), tuple(phrases), chars_per_error)
    schema = docs.select(F.col(id_col), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(f"array<{PLACE}>").alias("places"), F.lit(None).cast(f"array<{SPAN}>").alias("spans")).schema
    target = to_arrow_schema(schema)
    place, span = target.field("places").type, target.field("spans").type

    def run(batches):
        scanner = worker_state(("scanner", *key), lambda: Scanner(*key))
        for batch in batches:
            counts, places, spans = [], [], []
            for raw in texts(batch.column(1)):
                n, base, found = scanner.scan(raw or b"")
                counts.append(n)
                places.append([{"label": x, "word": w} for x, w in base])
                spans.append(
                    [
                        {"label": x, "first_word": w, "start": a, "end": b, "edits": e, "similarity": s, "found": raw[a:b].decode("utf-8", "replace")}
                        for x, w, a, b, e, s in found
                    ]
                )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(places, place), pa.array(spans, span)], names=schema.names)

    return map_texts(docs.select(id_col, text_col), run, schema)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the digest columns, derived from places and spans."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    words = F.transform("places", lambda x: x["word"])
    base = F.array_distinct(F.transform("places", lambda x: x["label"]))
    fuzzy = F.array_distinct(F.transform("spans", lambda x: x["label"]))
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    best = F.array_max(F.transform("spans", lambda x: x["similarity"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.array_union(base, fuzzy)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        F.size("spans").cast("long").alias("n_notices"),
    )


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES: dict[str, str] = {}
