"""Fuzzy search for short license notices.

A notice of m characters may differ in k = m * ``rate`` edits (at least one). By the pigeonhole principle one of k + 1
pieces of the notice then stands in the text unchanged. One automaton finds all pieces of all notices; around each the
window in which a match may lie is marked, windows that touch are one, and in these the regex library's bounded-error
matching (edits at most k, fit improved) verifies the notice and gives its span. As every match lies in a window with room
for a whole match on either side, nothing is missed. The regex library is slow to find that a window has no match, so edit
distances (Myers's bit vectors) first rule out windows without one.

Text is searched as it is but for the case of ASCII letters, and each blank or line break is a space, so spans are those
of the text: ``start`` and ``stop`` count characters from 0.

Of Creative Commons the long names and the short ones are notices; a line that also names conditions has a row for each
notice in it ("Licensed under CC BY-NC-SA" is cc-by-licensed, cc-by-nc and cc-by-nc-sa). A bare "CC BY" or "CC0" without a
version, a condition or words of licensing is none: five letters or less stand in too many other texts.

Defined results: null and empty texts have no match; matches of one notice don't overlap, those of several may; rows are
searched one by one, so repeated rows and null ids stay; a notice shorter than ``SHORTEST`` characters must match exactly;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import bounded, table

NOTICES: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "mit-name": "Released under the MIT License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "gpl": "GNU General Public License",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it",
    "lgpl": "GNU Lesser General Public License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "cc": "Creative Commons Attribution",
    "cc-by-licensed": "Licensed under CC BY",
    "cc-by-available": "available under CC BY",
    "cc-by-field": "License: CC BY",
    "cc-by-license": "CC BY license",
    "cc-by-nc-sa": "CC BY-NC-SA",
    "cc-by-nc-nd": "CC BY-NC-ND",
    **{f"cc-by-{t}": f"CC BY-{t.upper()}" for t in ("sa", "nc", "nd")},
    **{f"cc-by-{t}-id": f"CC-BY-{t.upper()}" for t in ("sa", "nc", "nd")},
    **{f"cc-by-{v}": f"CC BY {v}" for v in ("1.0", "2.0", "2.5", "3.0", "4.0")},
    **{f"cc-by-{v}-id": f"CC-BY-{v}" for v in ("1.0", "2.0", "2.5", "3.0", "4.0")},
    "cc0": "Creative Commons Zero",
    "cc0-under": "under CC0",
    "cc0-1.0": "CC0 1.0 Universal",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "reserved": "All rights reserved",
    "spdx": "SPDX-License-Identifier:",
}
RATE = 0.1
SHORTEST = 10
#: ASCII capitals as small letters, blanks and line breaks as spaces: lengths stay.
PLAIN = {c: c + 32 for c in range(65, 91)} | {c: 32 for c in b"\t\n\v\f\r"} | {0xA0: 32}


@dataclass(frozen=True)
class Notice:
    name: str
    text: str
    edits: int


def notices(given: dict[str, str] = NOTICES, rate: float = RATE) -> list[Notice]:
    plain = {k: v.translate(PLAIN) for k, v in given.items() if v}
    return [Notice(k, v, max(1, int(rate * len(v))) if len(v) >= SHORTEST else 0) for k, v in plain.items()]


def letters(pattern: str) -> dict[str, int]:
    """Of each letter of the pattern a number with the bits of its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def within(places: dict[str, int], length: int, edits: int, text: str) -> bool:
    """Whether a part of the text is at most ``edits`` from the pattern of these ``letters``, by Myers's bit vectors."""
    full, high = (1 << length) - 1, 1 << (length - 1)
    more, less, score = full, 0, length
    for c in text:
        same = places.get(c, 0)
        down = same | less
        flat = ((same & more) + more ^ more) | same
        up, drop = less | ~(flat | more) & full, more & flat
        score += bool(up & high) - bool(drop & high)
        if score <= edits:
            return True
        up, drop = up << 1 & full, drop << 1 & full
        more, less = drop | ~(down | up) & full, up & down
    return False


class Searcher:
    def __init__(self, wanted: list[Notice]) -> None:
        self.wanted = wanted
        self.places = [letters(n.text) for n in wanted]
        self.patterns = [regex.compile(f"(?e)(?:{regex.escape(n.text, special_only=True)}){{e<={n.edits}}}") for n in wanted]
        self.seeds = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, n in enumerate(wanted):
            cuts = [len(n.text) * i // (n.edits + 1) for i in range(n.edits + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(n.text[a:b], []).append((k, a))
        for piece, owners in pieces.items():
            self.seeds.add_word(piece, (len(piece), owners))
        self.seeds.make_automaton()

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Notice, begin and end of the merged windows."""
        last: dict[int, list[int]] = {}
        for end, (length, owners) in self.seeds.iter(text):
            for k, a in owners:
                n = self.wanted[k]
                # a match starts at most k before or behind where the seed says, and ends k further at most; twice that for the fit
                begin = max(0, end + 1 - length - a - 2 * n.edits - 1)
                stop = end + 1 - length - a + len(n.text) + 2 * n.edits + 1
                if k in last and begin <= last[k][1]:
                    last[k][0] = min(last[k][0], begin)
                    last[k][1] = max(last[k][1], stop)
                else:
                    if k in last:
                        yield k, *last[k]
                    last[k] = [begin, stop]
        for k, (begin, stop) in last.items():
            yield k, begin, stop

    def search(self, text: str) -> list[tuple[str, int, int, int]]:
        """Notice, start, stop and edits of each match."""
        plain, out = text.translate(PLAIN), []
        for k, begin, stop in self.windows(plain):
            n = self.wanted[k]
            if not within(self.places[k], len(n.text), n.edits, plain[begin:stop]):
                continue
            for m in self.patterns[k].finditer(plain, begin, min(stop, len(plain))):
                out.append((n.name, m.start(), m.end(), sum(m.fuzzy_counts)))
        return sorted(out, key=lambda r: (r[1], r[2], r[0]))


def scan(documents: DataFrame, given: dict[str, str] = NOTICES, rate: float = RATE) -> DataFrame:
    """doc_id, notice, start, stop and edits of every match in every row of documents."""
    wanted = notices(given, rate)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(wanted)
        for b in batches:
            at, rows = [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                if t and (found := searcher.search(t)):
                    at += [i] * len(found)
                    rows += found
            if rows:
                name, start, stop, edits = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), pa.array(name), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(edits, pa.int32())], ["doc_id", "notice", "start", "stop", "edits"])

    return bounded(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, notice string, start int, stop int, edits int")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
