"""Licence scans by sentence rules: known sentences become identifiers, identifier sequences match ordered rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import batch, by_bytes

#: Normalised licence sentences and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2.ref",
    "licensed under the apache license version 2 0 the license": "apache2.ref",
    "you may not use this file except in compliance with the license": "apache.use",
    "you may obtain a copy of the license at": "apache.copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache.asis",
    "see the license for the specific language governing permissions and limitations under the license": "apache.see",
    "released under the mit license": "mit.ref",
    "licensed under the mit license": "mit.ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit.grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit.notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit.asis",
    "this work is licensed under the gnu general public license version 3": "gpl3.ref",
    "this work is licensed under the gnu general public license version 2": "gpl2.ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3.grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2.grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl.hope",
    "see the gnu general public license for more details": "gpl.see",
    "you should have received a copy of the gnu general public license along with this program": "gpl.copy",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd.grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd.source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd.binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd.names",
    "licensed under cc by 4 0": "ccby.ref",
    "licensed under cc by sa 4 0": "ccbysa.ref",
    "licensed under cc by nc 4 0": "ccbync.ref",
    "licensed under cc by nd 4 0": "ccbynd.ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby.ref",
    "all rights reserved": "reserved",
}
#: Rules in order; the first that matches where the last match ended wins.
RULES = [
    ("Apache-2.0", ("apache2.ref", "apache.use", "apache.copy", "apache.asis", "apache.see")),
    ("MIT", ("mit.grant", "mit.notice", "mit.asis")),
    ("GPL-3.0-or-later", ("gpl3.grant", "gpl.hope", "gpl.see", "gpl.copy")),
    ("GPL-2.0-or-later", ("gpl2.grant", "gpl.hope", "gpl.see", "gpl.copy")),
    ("BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.names")),
    ("BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary")),
    ("Apache-2.0", ("apache2.ref",)), ("MIT", ("mit.ref",)), ("MIT", ("mit.grant",)), ("GPL-3.0", ("gpl3.ref",)), ("GPL-2.0", ("gpl2.ref",)), ("GPL-3.0-or-later", ("gpl3.grant",)), ("GPL-2.0-or-later", ("gpl2.grant",)),
    ("CC-BY-4.0", ("ccby.ref",)), ("CC-BY-SA-4.0", ("ccbysa.ref",)), ("CC-BY-NC-4.0", ("ccbync.ref",)), ("CC-BY-ND-4.0", ("ccbynd.ref",)), ("Proprietary", ("reserved",)),
]
#: A sentence ends at a line break or behind . ! ? before white space or the end.
END = re.compile(r"[.!?]+(?=\s|$)|[\r\n]+")
#: A licence text wraps its sentences over lines, so paragraphs are also read without their single line breaks.
PARAGRAPH = re.compile(r"\r?\n[ \t]*(?:\r?\n[ \t]*)+")
WORDS = re.compile(r"[^\W_]+")


def normalise(sentence: str) -> str:
    return " ".join(WORDS.findall(sentence.lower()))


#: Every known sentence has one of these words, so texts without them are read no further.
CUES = ("licens", "permi", "copyright", "redistribut", "warrant", "gnu", "reserved", "copyright")


def identify(text: str, known: dict[str, str]) -> list[tuple[int, str]]:
    """Offsets and identifiers of the known sentences, in order. A sentence counts once, whole or wrapped."""
    low = text.lower()
    if not any(c in low for c in CUES):
        return []
    found: dict[int, str] = {}

    def scan(part: str, base: int) -> None:
        at = 0
        for m in [*END.finditer(part), None]:
            stop = m.start() if m else len(part)
            name = known.get(normalise(part[at:stop]))
            if name:
                found.setdefault(base + at + len(part[at:stop]) - len(part[at:stop].lstrip()), name)
            at = m.end() if m else stop

    scan(text, 0)
    at = 0
    for m in [*PARAGRAPH.finditer(text), None]:
        stop = m.start() if m else len(text)
        part = text[at:stop]
        if ("\n" in part or "\r" in part) and any(c in part.lower() for c in CUES):
            scan(re.sub(r"[\r\n]", " ", part), at)
        at = m.end() if m else stop
    return sorted(found.items())


def match(names: list[str], rules: list[tuple[str, tuple[str, ...]]]) -> list[tuple[str, int, int]]:
    """Licences with their first and last place in the identifier sequence; what no rule takes is ``Unknown``."""
    out, i = [], 0
    while i < len(names):
        for licence, rule in rules:
            if tuple(names[i:i + len(rule)]) == rule:
                out.append((licence, i, i + len(rule) - 1))
                i += len(rule)
                break
        else:
            out.append(("Unknown", i, i))
            i += 1
    return out


def scan_licences(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """``doc_id, n_sentences, licences, first_at`` of every row: known licence sentences in its whole text, the licences they
    make up (in order, joined by ", ", empty for none) and the offset of the first (null for none).

    One narrow pass. Null and empty texts hold none; equal rows stay; other columns are not read.
    """
    known, ordered = sentences or SENTENCES, rules or RULES
    out = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("licences", pa.string()), ("first_at", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for at, run in by_bytes(b.column(1)):
                for i, t in enumerate(run):
                    found = identify(t, known)
                    rows.append((ids[at + i], len(found), ", ".join(x for x, _, _ in match([n for _, n in found], ordered)), found[0][0] if found else None))
            if rows:
                yield batch(out, list(zip(*rows)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, n_sentences long, licences string, first_at long")
