"""Licence recognition by sentences: known sentences become identifiers, and rules match their order."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playseq.llm.text import slices

# How a sentence that names a licence begins.
_NAMED = r"((this|the) \w+ is )?(released|licensed|distributed|available|provided) under (a |the )?(terms of the )?"

# Sentences of common licences, as patterns over normalised text (lower case,
# letters, digits and dots within numbers; everything else one space). A group named v is the version.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("mit-name", _NAMED + r"mit licen[sc]e"),
    ("mit-title", r"(the )?mit licen[sc]e( mit)?"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software .*"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-warranty", r"the software is provided as is without warranty of any kind express or implied .*"),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted .*"),
    ("apache-name", _NAMED + r"apache licen[sc]e( version)? ?(?P<v>\d[\d.]*)?( the licen[sc]e)?"),
    ("apache-use", r"you may not use this file except in compliance with the licen[sc]e"),
    ("apache-copy", r"you may obtain a copy of the licen[sc]e at( .*)?"),
    ("apache-warranty", r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis .*"),
    ("gpl-name", _NAMED + r"(gnu )?(general public licen[sc]e|gpl)( version)? ?v?(?P<v>\d[\d.]*)?( only)?"),
    ("gpl-or-later", _NAMED + r"(gnu )?(general public licen[sc]e|gpl)( version)? ?v?(?P<v>\d[\d.]*) or (at your option )?any later version"),
    ("gpl-free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e .* version (?P<v>\d[\d.]*) .*"),
    ("lgpl-name", _NAMED + r"(gnu )?(lesser general public licen[sc]e|lgpl)( version)? ?v?(?P<v>\d[\d.]*)?"),
    ("gpl-hope", r"this program is distributed in the hope that it will be useful but without any warranty .*"),
    ("mpl-name", r"this source code form is subject to the terms of the mozilla public licen[sc]e v(ersion)? ?\.? ?(?P<v>\d[\d.]*)"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted .*"),
    ("bsd-source", r"(\d |.* )?redistributions of source code must retain the above copyright notice .*"),
    ("bsd-binary", r"(\d |.* )?redistributions in binary form must reproduce the above copyright notice .*"),
    ("bsd-endorse", r"(\d |.* )?neither the name of .* may be used to endorse or promote products .*"),
    ("bsd-name", _NAMED + r"(?P<v>[23]) clause bsd licen[sc]e"),
    ("cc-name", _NAMED + r"(creative commons|cc) (?P<v>(by|zero|0)[a-z ]*( \d[\d.]*)?)( licen[sc]e)?"),
    ("public-domain", r"this (work|software|file) (is|has been) (placed |released )?(in|into|to) the public domain"),
    ("all-rights", r"all rights reserved"),
)

# Rules in order. A rule takes a run of identifiers ("..." allows others between) and
# names the licence; {v} is the version that its sentences state.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("bsd-grant", "...", "bsd-source", "...", "bsd-binary", "...", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "...", "bsd-source", "...", "bsd-binary")),
    ("MIT", ("mit-grant", "...", "mit-notice", "...", "mit-warranty")),
    ("Apache-{v}", ("apache-name", "...", "apache-use", "...", "apache-copy", "...", "apache-warranty")),
    ("GPL-{v}", ("gpl-free", "...", "gpl-hope")),
    ("GPL-{v}-or-later", ("gpl-or-later",)),
    ("LGPL-{v}", ("lgpl-name",)),
    ("GPL-{v}", ("gpl-name",)),
    ("Apache-{v}", ("apache-name",)),
    ("MPL-{v}", ("mpl-name",)),
    ("BSD-{v}-Clause", ("bsd-name",)),
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-title",)),
    ("ISC", ("isc-grant",)),
    ("CC-{v}", ("cc-name",)),
    ("public-domain", ("public-domain",)),
    ("all-rights-reserved", ("all-rights",)),
    ("unknown-MIT-style", ("mit-grant",)),
    ("unknown-BSD-style", ("bsd-grant",)),
    ("unknown-GPL-style", ("gpl-free",)),
)

#: Every known sentence holds one of these, so texts are normalised around them only.
TELLS = re.compile(
    r"licen[sc]e|gpl|creative\s+commons|\bcc\b|copyright|permission|redistribut|warranty|public\W+domain"
    r"|rights\W+reserved|endorse|applicable\W+law|compliance",
    re.IGNORECASE,
)
#: A sentence ends at a full stop (but for that of "v. 2"), ! or ? before white space, and at a line without words.
_END = re.compile(r"(?:(?<!\bv)\.|[!?])(?=\s|\Z)|\n(?=[^\w\n]*+(?:\n|\Z))")
#: Where the whole isn't known, its clauses may be, and then its lines. Semicolons may also lead comments.
_SMALLER = (re.compile(r"(?<=[^\s;]);|[!?]"), re.compile(r"\n"))
_OTHER = re.compile(r"[^a-z0-9.]+|(?<![0-9])\.|\.(?![0-9])")


@dataclass(frozen=True)
class Known:
    sentence: str  # identifier
    version: str
    first: int
    past: int


def normalise(sentence: str) -> str:
    return " ".join(_OTHER.sub(" ", sentence.lower()).split())


def _recognised(text: str, begin: int, past: int, sentences: Sequence[tuple[str, re.Pattern]], smaller: Sequence[re.Pattern]) -> list[Known]:
    """The sentence between two places if it is known, or those of its parts that are."""
    plain = normalise(text[begin:past])
    for name, pattern in sentences:
        match = pattern.fullmatch(plain)
        if match:
            version = match.groupdict().get("v") or ""
            first = begin + len(text[begin:past]) - len(text[begin:past].lstrip())
            return [Known(name, "-".join(version.upper().split()), first, past)]
    if not smaller:
        return []
    cuts = [(m.start(), m.end()) for m in smaller[0].finditer(text, begin, past)]
    if not cuts:
        return _recognised(text, begin, past, sentences, smaller[1:]) if smaller[1:] else []
    starts, ends = [begin, *(b for _, b in cuts)], [*(a for a, _ in cuts), past]
    parts = [(a, b) for a, b in zip(starts, ends, strict=True) if TELLS.search(text, a, b)]
    return [k for a, b in parts for k in _recognised(text, a, b, sentences, smaller[1:])]


def known_sentences(text: str, sentences: Sequence[tuple[str, re.Pattern]]) -> list[Known]:
    """The licence sentences of a text in order, with their characters' places.

    A sentence may be wrapped over lines and stand in a comment; a known line or clause inside an
    unknown sentence counts as well. However long a sentence is, it is looked at from its beginning.
    """
    found, looked = [], 0
    for tell in TELLS.finditer(text):
        if tell.start() < looked:
            continue
        begin = looked
        for end in _END.finditer(text, looked, tell.start()):
            begin = end.end()
        end = _END.search(text, tell.end())
        past = end.start() if end else len(text)
        looked = end.end() if end else len(text)
        found += _recognised(text, begin, past, sentences, _SMALLER)
    return found


def match_rules(known: Sequence[Known], rules: Sequence[tuple[str, tuple[str, ...]]]) -> list[tuple[str, int, int]]:
    """Licences with the sentences they take; each sentence serves the first rule in order that can take it."""
    free, found = [True] * len(known), []
    for licence, pattern in rules:
        start = 0
        while start < len(known):
            taken = _taken(known, free, start, pattern)
            if taken is None:
                start += 1
                continue
            for k in taken:
                free[k] = False
            version = next((known[k].version for k in taken if known[k].version), "")
            name = licence.replace("-{v}", f"-{version}" if version else "")
            found.append((name, known[taken[0]].first, known[taken[-1]].past))
            start = taken[-1] + 1
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


def _taken(known, free, start, pattern) -> list[int] | None:
    taken, at, gap = [], start, False
    for step in pattern:
        if step == "...":
            gap = True
            continue
        while gap and at < len(known) and not (free[at] and known[at].sentence == step):
            at += 1
        if at >= len(known) or not free[at] or known[at].sentence != step:
            return None
        taken.append(at)
        at, gap = at + 1, False
    return taken


def scan(
    documents: DataFrame,
    *,
    text: str = "text",
    carry: Sequence[str] = ("doc_id",),
    sentences: Sequence[tuple[str, str]] = SENTENCES,
    rules: Sequence[tuple[str, tuple[str, ...]]] = RULES,
) -> DataFrame:
    """The licences that every document states.

    Returns, one row for each document: `row` (a struct of the `carry` columns), sentences (the
    identifiers of known licence sentences, in order), licences (an array of licence, first, past:
    characters of the text) and expression (the distinct licences in alphabetical order, joined by
    " AND "; empty if there is none). Null and empty texts state none.
    """
    words = documents.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(text).alias("text"))

    def recognise(batches):
        patterns = [(name, re.compile(pattern)) for name, pattern in sentences]
        kind = pa.list_(pa.struct([("licence", pa.string()), ("first", pa.int32()), ("past", pa.int32())]))
        for batch in slices(batches, "text"):
            known = [known_sentences(t, patterns) if t else [] for t in batch.column("text").to_pylist()]
            found = [match_rules(k, rules) for k in known]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array([[k.sentence for k in ks] for ks in known], pa.list_(pa.string())),
                    pa.array([[{"licence": a, "first": b, "past": c} for a, b, c in f] for f in found], kind),
                    pa.array([" AND ".join(sorted({a for a, _, _ in f})) for f in found], pa.string()),
                ],
                ["row", "sentences", "licences", "expression"],
            )

    return words.mapInArrow(
        recognise,
        f"row {words.schema['row'].dataType.simpleString()}, sentences array<string>, "
        "licences array<struct<licence:string,first:int,past:int>>, expression string",
    )
