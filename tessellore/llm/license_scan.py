"""License scans by sentence rules.

Lines without comment marks make sentences, which end at end marks and empty lines, however
they are wrapped. A sentence becomes its words in lower case, and known licence sentences
are looked for from every word of it, wherever in it they begin and end; of those that begin
at one word the longest counts. Titles have to fill a line, or up to three lines in a row,
so that prose which names a licence is none. Each match has an identifier. The identifiers
of a document, in order, are then matched against ordered licence rules: the first rule
whose sequence occurs (gaps of unknown sentences up to a bound allowed, known sentences
between not) claims its sentences for a licence; later rules see what is left. An SPDX line
gives the expression it names.

Edge cases: a null or empty text has no licence; a text of any length is read whole;
repeated rows each get their own result; an empty table gives an empty result;
only the named id and text columns take part, so others may have any name. Of rules that
fit at one place the first counts, so no two results tie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Normalised licence sentences (patterns after normalisation) and their identifiers.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("mit-name", r"(?:this (?:work|software|file|project|text) is )?(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?mit licen[cs]e"),
    ("mit-title", r"(?:the )?mit licen[cs]e(?: mit)?"),
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software .*"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("as-is", r"the software is provided as is without warranty of any kind .*"),
    ("apache-2-name", r"(?:this (?:work|software|file|project|text) is )?(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?apache licen[cs]e(?: version)? 2 0(?: the license)?"),
    ("apache-2-title", r"apache licen[cs]e(?: version)? 2 0(?: january 2004)?"),
    ("apache-2-use", r"you may not use this file except in compliance with the license"),
    ("gpl-3-name", r"(?:this (?:work|software|file|project|text) is )?(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?gnu general public licen[cs]e(?: version| v)? ?3(?: 0)?"),
    ("gpl-2-name", r"(?:this (?:work|software|file|project|text) is )?(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?gnu general public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("gpl-any-name", r"(?:this (?:work|software|file|project|text) is )?(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?gnu general public licen[cs]e"),
    ("gpl-2-only-free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 (?:only )?as published by the free software foundation"),
    ("gpl-2-later-free", r"this (?:program|file) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3-later-free", r"this (?:program|file) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3-later-free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-name", r"(?:this (?:work|software|file|project|text) is )?(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?(?:gnu )?(?:affero general public licen[cs]e|agpl).*"),
    ("lgpl-3-later-free", r"this (?:library|program) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-free", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation"),
    ("perl-same", r"this (?:library|program|module) is free software you can redistribute it and or modify it under the same terms as perl itself"),
    ("gpl-2-title", r"gnu general public license version 2 june 1991"),
    ("gpl-3-title", r"gnu general public license version 3 29 june 2007"),
    ("gpl-2-later-name", r"(?:this (?:work|software|file|project|text) is )?(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?gnu general public licen[cs]e(?: version| v)? ?2(?: 0)? or (?:any )?later(?: version)?"),
    ("gpl-3-later-name", r"(?:this (?:work|software|file|project|text) is )?(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?gnu general public licen[cs]e(?: version| v)? ?3(?: 0)? or (?:any )?later(?: version)?"),
    ("gpl-free", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license .*"),
    ("gpl-later", r"either version 2 of the license or at your option any later version"),
    ("gpl-3-later", r"either version 3 of the license or at your option any later version"),
    ("lgpl-2.1-later", r"either version 2 1 of the license or at your option any later version"),
    ("lgpl-name", r"(?:this (?:work|software|file|project|text) is )?(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?gnu lesser general public licen[cs]e.*"),
    ("bsd-3-name", r"(?:this (?:work|software|file|project|text) is )?(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?(?:bsd 3 clause|3 clause bsd|new bsd)(?: licen[cs]e)?"),
    ("bsd-2-name", r"(?:this (?:work|software|file|project|text) is )?(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[cs]e)?"),
    ("bsd-redistribution", r"redistribution and use in source and binary forms with or without modification are permitted .*"),
    ("bsd-endorse", r"neither the name of .* nor the names of its contributors may be used to endorse or promote products .*"),
    ("bsd-advert", r"all advertising materials mentioning features or use of this software must display the following acknowledg[e]?ment .*"),
    ("x11-name", r"except as contained in this notice the name .* shall not be used in advertising or otherwise to promote the sale use or other dealings in (?:this|the) software without prior written authorization .*"),
    ("isc-grant", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd-grant", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-as-is", r"the software is provided as is and .* disclaims all warranties with regard to this software .*"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("bsl-grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license .*"),
    ("bsl-title", r"boost software license version 1 0 17 august 2003|boost software license version 1 0 august 17th 2003"),
    ("bsl-name", r"distributed under the boost software license version 1 0"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("epl-1-name", r"this program and the accompanying materials are made available under the terms of the eclipse public license v ?(?:ersion )?1 0.*"),
    ("epl-2-name", r"this program and the accompanying materials are made available under the terms of the eclipse public license v? ?(?:ersion )?2 0.*"),
    ("wtfpl-title", r"do what the fuck you want to public license(?: version 2 december 2004)?"),
    ("mpl-2-form", r"this source code form is subject to the terms of the mozilla public license v(?: 2 0)?"),
    ("mpl-2-title", r"mozilla public license version 2 0"),
    ("mpl-2-name", r"(?:released|licensed|distributed|available|subject to the terms) (?:under|of) the mozilla public licen[cs]e(?: version| v)? ?2 0"),
    ("cc-by-name", r"(?:this (?:work|software|file|project|text) is )?(?:released|licensed|distributed|available) under (?:a |the )?(?:creative commons attribution|cc by)(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-sa-name", r"(?:this (?:work|software|file|project|text) is )?(?:released|licensed|distributed|available) under (?:a |the )?(?:creative commons attribution share ?alike|cc by sa)(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nc-name", r"(?:this (?:work|software|file|project|text) is )?(?:released|licensed|distributed|available) under (?:a |the )?(?:creative commons attribution non ?commercial|cc by nc)(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"),
    ("cc-by-nd-name", r"(?:this (?:work|software|file|project|text) is )?(?:released|licensed|distributed|available) under (?:a |the )?(?:creative commons attribution no ?derivatives|cc by nd)(?: [1-4] [05])?(?: international)?(?: licen[cs]e)?"),
    ("cc0-name", r"(?:this (?:work|software|file|project|text) is )?(?:released|licensed|dedicated|available|marked) (?:under|to|with) (?:the )?(?:cc0(?: 1 0)?.*|public domain)"),
    ("all-rights", r"(?:copyright )?all rights reserved"),
    ("spdx-line", r"spdx license identifier [a-z0-9 ]+"),
    ("bsd-style", r"use of this (?:source code|software|file|package) is governed by (?:a|the) bsd (?:style )?licen[cs]e"),
    ("mit-style", r"use of this (?:source code|software|file|package) is governed by (?:an|the) mit (?:style )?licen[cs]e"),
)
#: Sentences that have to fill lines.
TITLES = frozenset(("mit-title", "apache-2-title", "gpl-2-title", "gpl-3-title", "bsl-title", "wtfpl-title", "mpl-2-title", "all-rights", "spdx-line"))
#: Licences and the sentence sequences that mean them; the first that fits wins.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("X11", ("mit-grant", "mit-notice", "as-is", "x11-name")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT-0", ("mit-grant", "as-is")),
    ("MIT", ("mit-title", "mit-grant")),
    ("MIT", ("mit-name",)),
    ("Apache-2.0", ("apache-2-name", "apache-2-use")),
    ("Apache-2.0", ("apache-2-name",)),
    ("Apache-2.0", ("apache-2-title",)),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-later")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-3-later")),
    ("GPL-2.0-or-later", ("gpl-2-later-free",)),
    ("GPL-3.0-or-later", ("gpl-3-later-free",)),
    ("GPL-2.0-or-later", ("gpl-2-later-name",)),
    ("GPL-3.0-or-later", ("gpl-3-later-name",)),
    ("GPL-2.0", ("gpl-2-only-free",)),
    ("GPL-2.0", ("gpl-2-title",)),
    ("GPL-3.0", ("gpl-3-title",)),
    ("AGPL-3.0-or-later", ("agpl-3-later-free",)),
    ("AGPL", ("agpl-name",)),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-2.1-later")),
    ("LGPL-2.0-or-later", ("lgpl-free", "gpl-later")),
    ("LGPL-3.0-or-later", ("lgpl-free", "gpl-3-later")),
    ("LGPL-3.0-or-later", ("lgpl-3-later-free",)),
    ("LGPL", ("lgpl-free",)),
    ("LGPL", ("lgpl-name",)),
    ("Artistic-1.0-Perl OR GPL-1.0-or-later", ("perl-same",)),
    ("GPL-3.0", ("gpl-3-name",)),
    ("GPL-2.0", ("gpl-2-name",)),
    ("GPL", ("gpl-any-name",)),
    ("GPL", ("gpl-free",)),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-advert", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-3-name",)),
    ("BSD-2-Clause", ("bsd-2-name",)),
    ("BSD-2-Clause", ("bsd-redistribution",)),
    ("BSD", ("bsd-style",)),
    ("MIT", ("mit-style",)),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl-title", "bsl-grant")),
    ("BSL-1.0", ("bsl-grant",)),
    ("BSL-1.0", ("bsl-name",)),
    ("Unlicense", ("unlicense",)),
    ("EPL-1.0", ("epl-1-name",)),
    ("EPL-2.0", ("epl-2-name",)),
    ("WTFPL", ("wtfpl-title",)),
    ("MPL-2.0", ("mpl-2-form",)),
    ("MPL-2.0", ("mpl-2-title",)),
    ("MPL-2.0", ("mpl-2-name",)),
    ("CC-BY-NC", ("cc-by-nc-name",)),
    ("CC-BY-SA", ("cc-by-sa-name",)),
    ("CC-BY-ND", ("cc-by-nd-name",)),
    ("CC-BY", ("cc-by-name",)),
    ("CC0", ("cc0-name",)),
    ("MIT", ("mit-title",)),
    ("Proprietary", ("all-rights",)),
    ("SPDX", ("spdx-line",)),
)
#: Unknown sentences that may stand between two of a rule.
MAX_GAP = 3

_END = re.compile(r"(?<=[.!?;])\s")
_NOISE = re.compile(r"[^a-z0-9]+")
#: Comment marks and indents at the start of a line that a wrapped sentence goes on in.
_MARGIN = re.compile(r"[ \t]*(?:(?://+|#+|\*+|;+|--+|/\*+|>+|%+)[ \t]*)?")
#: Lines that a title may fill, and titles that fill one.
TITLE_LINES, ONE_LINE = 3, ("spdx-line", "all-rights")
_HELD = re.compile(r"[\W_]*(?:copyright\b|\(c\)|©)[^\n]*?\b(all rights reserved)[.\s]*", re.I)
_SPDX = re.compile(r"spdx-license-identifier\s*:\s*([A-Za-z0-9.+:() \t-]+?)\s*(?:\*/|-->|$)", re.I)
_HINT = re.compile(r"licen[cs]|permission|redistribut|rights reserved|warrant|copyright|public\s+domain|unencumbered|advertis|endorse|cc0|free software|spdx|later version|gpl|bsd|\bcc[ -]by\b|governed by", re.I)
_WORD = re.compile("[A-Za-z0-9]+")
_TITLES = [(name, re.compile(p)) for name, p in SENTENCES if name in TITLES]
#: What a sentence may go on with after the known part is left out.
_INSIDE = [(name, re.compile(rf"(?<![^ ])(?:{p.removesuffix(' .*').removesuffix('.*')})(?![^ ])")) for name, p in SENTENCES if name not in TITLES]


def title_id(line: str) -> str | None:
    """The identifier of a title, or None."""
    if (held := _HELD.fullmatch(line)) is not None:
        line = held[1]  # without the years and the holder
    plain = _NOISE.sub(" ", line.lower()).strip()
    return next((name for name, pattern in _TITLES if pattern.fullmatch(plain)), None)


def inside(plain: str) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of the known sentences in a sentence's words: the leftmost, there the longest, then the first of the table."""
    every = [(m.start(), -m.end(), i, name) for i, (name, pattern) in enumerate(_INSIDE) for m in pattern.finditer(plain)]
    out, at = [], 0
    for start, end, _, name in sorted(every):
        if start >= at:
            out.append((start, -end, name))
            at = -end
    return out


def sentences(text: str) -> Iterator[tuple[int, int, int]]:
    """(line, start, end) of the pieces of a text: lines without their margin, cut after end marks."""
    at = line = 0
    while at <= len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        begin = _MARGIN.match(text, at, stop).end()
        for m in _END.finditer(text, begin, stop):
            if text[begin : m.start()].strip():
                yield line, begin, m.start()
            begin = m.end()
        if text[begin:stop].strip():
            yield line, begin, stop
        at, line = stop + 1, line + 1


def _identified(text: str) -> Iterator[tuple[int, str, int, int]]:
    """(sentence number, identifier, start, end) of the known sentences, by place."""
    cuts = list(sentences(text))
    lines = [text[a:b] for _, a, b in cuts]
    number = i = 0
    while i < len(cuts):
        j = i + 1  # a sentence goes on after a semicolon and over line breaks, not over an empty line
        while j < len(cuts) and cuts[j][0] - cuts[j - 1][0] <= 1 and lines[j - 1].rstrip()[-1] not in ".!?":
            j += 1
        if any(map(_HINT.search, lines[i:j])) or _HINT.search(" ".join(lines[i:j])):
            words = [m for _, a, b in cuts[i:j] for m in _WORD.finditer(text, a, b)]
            ends, plain = [], []
            for m in words:
                plain.append(m[0].lower())
            at = 0
            starts = {}
            for k, w in enumerate(plain):
                starts[at] = k
                ends.append(at + len(w))
                at += len(w) + 1
            last = {e: k for k, e in enumerate(ends)}
            met = [(words[starts[a]].start(), words[last[b]].end(), name) for a, b, name in inside(" ".join(plain))]
            met += _titles(text, cuts[i:j], [(a, b) for a, b, _ in met])
            for a, b, name in sorted(met):
                yield number, name, a, b
        if any(map(str.isalpha, "".join(lines[i:j]))):
            number += 1  # list numbers are no sentences
        i = j


def _titles(text: str, cuts: list[tuple[int, int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, identifier) of titles that fill lines of a sentence, the most lines first."""
    i = 0
    while i < len(cuts):
        step = 1
        for n in range(min(TITLE_LINES, len(cuts) - i), 0, -1):
            a, b = cuts[i][1], cuts[i + n - 1][2]
            name = title_id(" ".join(text[x:y] for _, x, y in cuts[i : i + n]))
            if name and (n == 1 or name not in ONE_LINE) and not any(x < b and a < y for x, y in taken):
                yield a, b, name
                step = n
                break
        i += step


def match_rules(found: Sequence[tuple[int, str]], rules: Sequence[tuple[str, tuple[str, ...]]] = RULES, gap: int = MAX_GAP) -> list[tuple[str, int, int]]:
    """(licence, first and last index into ``found``) of the rules that (number, identifier) sequences meet."""
    used, out = [False] * len(found), []
    for licence, wanted in rules:
        i = 0
        while i + len(wanted) <= len(found):
            span = range(i, i + len(wanted))
            fits = all(not used[j] and found[j][1] == w for j, w in zip(span, wanted, strict=True))
            if fits and all(found[j + 1][0] - found[j][0] <= gap + 1 for j in list(span)[:-1]):
                for j in span:
                    used[j] = True
                out.append((licence, i, i + len(wanted) - 1))
            i += 1
    return sorted(out, key=lambda x: x[1])


def find_licences(text: str | None) -> list[tuple[str, str, int, int]]:
    """(licence, identifiers, start, end) of what a text says, by place; places are code points."""
    if not text or not _HINT.search(text):
        return []
    found, places = [], []
    for k, name, a, b in _identified(text):
        found.append((k, name))
        places.append((a, b))
    out = [(licence, "+".join(n for _, n in found[i : j + 1]), places[i][0], places[j][1]) for licence, i, j in match_rules(found)]
    return [(m[1].rstrip(". ") if x[0] == "SPDX" and (m := _SPDX.search(text[x[2] : x[3]])) else x[0], *x[1:]) for x in out]


SCAN = "doc_id bigint, licences array<string>, n_licences bigint, spans array<struct<licence:string,rule:string,start:bigint,end:bigint>>"


def scan_licences(docs: DataFrame) -> DataFrame:
    """For each document (``doc_id``, ``text``) its licences, distinct in order of place, and their spans."""
    span = pa.struct([("licence", pa.string()), ("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = [find_licences(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([list(dict.fromkeys(x[0] for x in h)) for h in hits], pa.list_(pa.string())),
                    pa.array([len({x[0] for x in h}) for h in hits], pa.int64()),
                    pa.array([[dict(zip(("licence", "rule", "start", "end"), x, strict=True)) for x in h] for h in hits], pa.list_(span)),
                ],
                names=["doc_id", "licences", "n_licences", "spans"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(tidy(run), SCAN)
