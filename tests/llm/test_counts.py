"""Token counts, licences, packing and mixing against brute force and their own promises."""

import math
import random
import re
from collections import defaultdict

import pytest

from tessellore.llm import license_scan, mixing, packing, token_counts

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute_tokens(word, table, byte):
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        size = len(word[i - 1].encode())
        top = (best[i - 1][0] + size * byte, best[i - 1][1] + size)
        for n in range(1, i + 1):
            s = table.get(word[i - n : i])
            if s is not None and best[i - n][0] + s >= top[0]:
                top = (best[i - n][0] + s, best[i - n][1] + 1)
        best.append(top)
    return best[-1][1]


def test_token_counts_are_those_of_each_word_alone(spark):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("thaeonlé漢🙂") for _ in range(rng.randint(1, 12))) for _ in range(40)) for _ in range(30)] + ["", None, " \n", "the " * 500, "a" * 3000]
    table, byte = token_counts.pieces(None)
    rows = token_counts.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    for r in rows:
        words = token_counts.pretokens(texts[r.doc_id] or "")
        assert (r.n_pretokens, r.n_distinct) == (len(words), len(set(words)))
        assert r.n_tokens == sum(brute_tokens(w, table, byte) for w in words)


def test_a_trie_counts_shared_prefixes_as_each_word_alone():
    table, byte = token_counts.pieces(None)
    rng = random.Random(31)
    words = {"".join(rng.choice("abtheé") for _ in range(rng.randint(0, 9))) for _ in range(3000)} | {"▁the", "▁", "the" * 40}
    trie = token_counts.Trie()
    for w in sorted(words, key=lambda w: rng.random()):
        trie.insert(w)
    assert trie.count(table, byte) == {w: brute_tokens(w, table, byte) for w in words}


def test_long_pretokens_take_linear_time_and_are_counted_whole(spark):
    import time

    table, byte = token_counts.pieces(None)
    rng = random.Random(32)
    long = "".join(rng.choice("漢字仮名abcxyz09+/") for _ in range(800_000))

    def took(n):
        trie, begun = token_counts.Trie(), time.perf_counter()
        trie.insert(long[:n])
        got = trie.count(table, byte)
        return time.perf_counter() - begun, got

    took(10_000)
    (small, _), (large, _) = took(200_000), took(800_000)
    assert large < 8 * small + 0.2
    assert took(3000)[1] == {long[:3000]: brute_tokens(long[:3000], table, byte)}
    docs = spark.createDataFrame([(1, long + " a"), (2, long)], "doc_id bigint, text string")
    a, b = sorted(token_counts.count_tokens(docs).collect())
    assert a.n_pretokens == 2 and a.n_tokens > b.n_tokens > 0


def test_token_counts_of_an_empty_table(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("Some prose.\nReleased under the MIT License.", ["MIT"]),
        ("This work is licensed under the GNU General Public License, version 3.\nmore", ["GPL-3.0"]),
        ("Licensed under CC BY-NC 4.0.\nx", ["CC-BY-NC"]),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("A licence is needed to drive. Copyright matters.", []),
        ("", []),
        (None, []),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that x.\nNeither the name of Foo nor the names of its contributors may be used to endorse or promote products y.", ["BSD-3-Clause"]),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that x.", ["BSD-2-Clause"]),
        ("All rights reserved.\nReleased under the MIT License.", ["Proprietary", "MIT"]),
    ],
)
def test_licences(text, wanted):
    found = license_scan.find_licences(text)
    assert [x[0] for x in found] == wanted
    for _, _, a, b in found:
        assert 0 <= a < b <= len(text)


BSD = """Copyright (c) 2020, Foo Bar

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """# This program is free software; you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation; either version 2 of the License, or
# (at your option) any later version.
"""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
"""


@pytest.mark.parametrize(
    "text, wanted, rule",
    [
        (BSD, "BSD-3-Clause", "bsd-redistribution+bsd-endorse"),
        (BSD.replace("\n", "\r\n"), "BSD-3-Clause", "bsd-redistribution+bsd-endorse"),
        (GPL, "GPL-2.0-or-later", "gpl-2-later-free"),
        (MIT, "MIT", "mit-grant+mit-notice+as-is"),
        ("Licensed under the GNU General Public License\nversion 3.", "GPL-3.0", "gpl-3-name"),
        ("Copyright (c) 2020 X, all rights reserved", "Proprietary", "all-rights"),
        ("// SPDX-License-Identifier: MIT OR Apache-2.0\ncode", "MIT OR Apache-2.0", "spdx-line"),
        ("/* SPDX-License-Identifier: GPL-2.0-only */", "GPL-2.0-only", "spdx-line"),
    ],
)
def test_licences_as_they_are_published(text, wanted, rule):
    assert [x[:2] for x in license_scan.find_licences(f"Prose before.\n\n{text}\nProse after it\n")] == [(wanted, rule)]


#: Paragraphs of licences as they are published, and what they mean.
PUBLISHED = {
    "MIT": [
        "MIT License",
        "Copyright (c) 2021 Some Body",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "BSD-2-Clause": [
        "Copyright (c) 2021, Some Body",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ],
    "Apache-2.0": [
        "Copyright 2021 Some Body",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        "http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "GPL-2.0-or-later": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "GPL-3.0-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "LGPL-2.1-or-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "ISC": [
        "Copyright (c) 2021, Some Body",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ],
    "Zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software."],
    "CC-BY": ["This work is licensed under the Creative Commons Attribution 4.0 International License.", "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/."],
}
PUBLISHED["BSD-3-Clause"] = [*PUBLISHED["BSD-2-Clause"][:-1], "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", PUBLISHED["BSD-2-Clause"][-1]]
PUBLISHED["BSD-4-Clause"] = [*PUBLISHED["BSD-2-Clause"][:-1], "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by Some Body.", "4. Neither the name of Some Body nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", PUBLISHED["BSD-2-Clause"][-1]]
PUBLISHED["X11"] = [*PUBLISHED["MIT"][1:], "Except as contained in this notice, the name of Some Body shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from Some Body."]


@pytest.mark.parametrize("licence", sorted(PUBLISHED))
def test_full_texts_are_found_however_they_are_wrapped(licence):
    import textwrap

    for width in (1_000, 100, 80, 76, 72, 66):
        for mark in ("", "// ", "# ", " * ", "> ", ";; "):
            for newline in ("\n", "\r\n"):
                lines = []
                for p in PUBLISHED[licence]:
                    lines += [mark + x for x in textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False)] + [mark.rstrip()]
                text = newline.join(["A first line of prose.", "", *lines, "", "x = 1  # and code that says nothing", ""])
                assert list(dict.fromkeys(x[0] for x in license_scan.find_licences(text))) == [licence], (width, mark)


def test_scan_of_a_very_long_text(spark):
    prose = "Copyright matters and a permission is not a licence. " * 40_000
    body = "\n\n".join(PUBLISHED["MIT"][2:])
    docs = spark.createDataFrame([(1, f"{prose}\n\n{body}\n\n{prose}"), (2, prose)], "doc_id bigint, text string")
    assert {r.doc_id: r.licences for r in license_scan.scan_licences(docs).collect()} == {1: ["MIT"], 2: []}


def test_rules_match_brute_force_sequences():
    rng = random.Random(4)
    names = ["a", "b", "c"]
    rules = [("X", ("a", "b")), ("Y", ("b", "c")), ("Z", ("a",))]
    for _ in range(200):
        found, k = [], 0
        for _ in range(rng.randint(0, 8)):
            k += rng.randint(1, 6)
            found.append((k, rng.choice(names)))
        used, want = set(), []
        for licence, seq in rules:
            for i in range(len(found)):
                span = list(range(i, i + len(seq)))
                if span[-1] < len(found) and not used & set(span) and [found[j][1] for j in span] == list(seq) and all(found[j + 1][0] - found[j][0] <= 4 for j in span[:-1]):
                    used |= set(span)
                    want.append((licence, span[0], span[-1]))
        assert license_scan.match_rules(found, rules, 3) == sorted(want, key=lambda x: x[1])


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("This project is licensed under the MIT License - see the LICENSE.md file for details.", ["MIT"]),
        ("Our code is available on GitHub and released under the MIT License.", ["MIT"]),
        ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", ["BSD"]),
        ("Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY"]),
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n", ["Apache-2.0"]),
        ("This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1-or-later"]),
        ("We like the MIT License, and the GNU General Public License version 2, June 1991, is long.", []),
        ("word\n" * 60 + "and all of it is\nreleased\nunder\nthe\nMIT\nLicense", ["MIT"]),
    ],
)
def test_notices_as_projects_write_them(text, wanted):
    assert [x[0] for x in license_scan.find_licences(text)] == wanted


def test_known_sentences_are_found_in_any_prose_however_it_is_wrapped():
    """Against a search of each pattern by itself in the flat words of each sentence."""
    rng = random.Random(11)
    known = ["released under the MIT License", "distributed under the terms of the GNU General Public License, version 3 or later", "you may not use this file except in compliance with the License", "Licensed under the Apache License, Version 2.0", "This is free and unencumbered software released into the public domain", "available under CC BY-SA 4.0", "either version 2 of the License, or (at your option) any later version", "dedicated to the public domain"]
    prose = ["a", "license", "of", "the", "under", "the", "version", "terms", "MIT", "released", "public", "2.0", "permission"]
    wide = [(n, re.compile(rf"(?<![^ ])(?:{p.removesuffix(' .*').removesuffix('.*')})(?![^ ])")) for n, p in license_scan.SENTENCES if n not in license_scan.TITLES]
    for _ in range(300):
        said, want, number = [], [], 0
        for _ in range(rng.randint(1, 5)):
            words = [rng.choice(prose) for _ in range(rng.randint(0, 6))]
            for _ in range(rng.randint(0, 2)):
                words += rng.choice(known).split() + [rng.choice(prose) for _ in range(rng.randint(1, 3))]
            said.append(words + ["end"])
            plain, at = " ".join(re.findall("[a-z0-9]+", " ".join(said[-1]).lower())), 0
            while at < len(plain):
                if at == 0 or plain[at - 1] == " ":
                    hits = [(m.end(), -i, n) for i, (n, p) in enumerate(wide) if (m := p.match(plain, at))]
                    if hits:
                        end, _, name = max(hits)
                        want.append((number, name))
                        at = end
                        continue
                at += 1
            number += 1
        mark = rng.choice(["", "# ", "// ", " * "])
        text = "".join(mark + line + "\n" for line in " ".join(" ".join(w) + "." for w in said).replace(" ", " ").splitlines())
        text = re.sub(" (?!$)", lambda m: f"\n{mark}" if rng.random() < 0.2 and text[max(0, m.start() - 3) : m.start()].strip("#/* \n") else " ", text)
        assert [(k, n) for k, n, _, _ in license_scan._identified(text) if n not in license_scan.TITLES] == want, text


def test_license_scan_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a", 5), (1, None, "a", 5), (None, "Released under the MIT License.", "b", 6)], "doc_id bigint, text string, licences string, spans int")
    assert sorted((r.n_licences for r in license_scan.scan_licences(docs).collect())) == [0, 0, 1]
    assert license_scan.scan_licences(docs.limit(0)).collect() == []


# packing ------------------------------------------------------------------------------
def pack_rows(spark, texts, **options):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    return packing.pack_documents(docs, **options).collect()


def check_packing(rows, texts, capacity=1024, places=True):
    """The ids of each text's pieces and, with ``places``, that sequences have no gap; (sequences, the least number)."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in texts.items() if isinstance(texts, dict) else enumerate(texts):
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == capacity for r in pieces[1:])
        assert len(pieces) == -(-len(ids) // capacity)
    for members in by_sequence.values() if places else ():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence), -(-sum(r.length for r in rows) // capacity)


def test_packing_holds_every_token_once_and_is_tight(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(int(rng.paretovariate(0.9) * 12) % 1500)) for _ in range(400)] + [None, "", "x <|endoftext|> y", " " * 3000]
    rows = pack_rows(spark, texts)
    used, least = check_packing(rows, texts)
    assert used <= least * 1.01 + 1


def test_migration_between_islands_keeps_all_pieces(spark, monkeypatch):
    texts = ["w " * (k % 370 + 1) for k in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = packing.pack(packing.tokenize(docs), island_size=60).collect()
    used, least = check_packing(rows, texts)
    assert used <= least * 1.02 + 1


def test_ids_are_the_tokenizers_also_for_special_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    exact, ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(None)
    assert ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    rng = random.Random(17)
    bits = ["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "word", "é漢", "🙂", "'s", "12", "<|im_end|>", "a" * 30, "\u3000"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert ids(text).tolist() == exact.encode(text, add_special_tokens=False).ids, text


def test_elite_bins_of_one_island_reach_the_parents_of_another(monkeypatch):
    import pandas as pd

    sizes = [300, 350, 374, 511, 513, 400, 500, 700, 250]
    seen = []
    real = packing.evolve
    monkeypatch.setattr(packing, "evolve", lambda *a: seen.append(a[3]) or real(*a))
    n = len(sizes)
    items = pd.DataFrame({"uid": range(n), "doc_id": range(n), "piece": 0, "start": 0, "length": sizes, "ids_crc32": 0, "handed": [7, 7, 7, 8, 8, None, None, None, None], "island": 0})
    out = packing.island(1024, False, 1)(items)
    assert seen == [[[0, 1, 2], [3, 4]]]
    for _, members in out.groupby("sequence_id"):
        free = 1024 - members["length"].sum()
        assert free >= 0 and set(members["final"]) == {free <= packing.SLACK} and set(members["elite"]) == {free <= packing.ELITE_SLACK}


def test_a_very_long_text_is_cut_into_whole_sequences(spark):
    texts = [" ".join(f"word{k % 997}" for k in range(200_000)), "short"]
    rows = pack_rows(spark, texts)
    used, least = check_packing(rows, texts)
    assert used == least > 300


def test_migrants_are_kept_where_they_are_better():
    sizes = [512, 342, 341, 341, 512, 342, 341, 341]  # falling best fit pairs 512 with 512
    bins = packing.evolve(sizes, 1024, 0, [[1, 2, 3], [5, 6, 7]])
    assert len(bins) == 3 and sorted(i for b in bins for i in b) == list(range(8))


def test_repeated_rows_are_packed_once_each(spark):
    docs = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (None, None, 0)], "doc_id bigint, text string, uid int")
    rows = packing.pack_documents(docs).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (1, 3), (1, 3)]
    assert sorted(r.offset for r in rows) == sorted({r.offset for r in rows})
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_evolution_beats_or_meets_its_first_parent():
    rng = random.Random(1)
    sizes = [rng.choice([300, 350, 400, 500, 512, 260]) for _ in range(200)]
    bins = packing.evolve(sizes, 1024, 3)
    assert sorted(i for b in bins for i in b) == list(range(200))
    assert all(sum(sizes[i] for i in b) <= 1024 for b in bins)
    first = packing.Bins(sizes, 1024)
    for i in sorted(range(200), key=lambda i: (-sizes[i], i)):
        first.put(i)
    assert len(bins) <= len(first.members)


# mixing -------------------------------------------------------------------------------
def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, share = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in sizes if s not in capped)
        over = {s for s in sizes if s not in capped and weight[s] * left > 3 * sizes[s] * share}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * left / share for s in sizes}
        capped |= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        source = rng.choice(["big"] * 30 + ["mid"] * 8 + ["tiny", "é", "Z", None, "small", "small"])
        rows.append((i, rng.choice([None, ""]) if rng.random() < 0.02 else "w " * rng.randint(1, 60), "en", source, 0))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = mixing.mix_report(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = brute_targets(dict(sizes))
    source = {r[0]: r[3] for r in rows}
    taken = defaultdict(int)
    for r in got:
        assert r.size == len((rows[r.doc_id][1] or "").split()) and r.source_size == sizes[source[r.doc_id]]
        assert math.isclose(r.target, want[source[r.doc_id]], rel_tol=1e-12)
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[source[r.doc_id]] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 60
    again = mixing.mix_report(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    whole = defaultdict(set)
    for r in got:
        if r.size:
            whole[source[r.doc_id]].add(r.taken // r.size)
    assert all(max(k) - min(k) <= 1 for k in whole.values())


def brute_mix(rows, keys, weights=(1, 2, 3), fillers=4):
    """{id: (copies, filler)}: whole epochs, then the sorted prefix, then what closes the rest."""
    sizes, by_source = defaultdict(int), defaultdict(list)
    for i, text, source in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        sizes[source] += n
        by_source[source].append((keys[i], i, n))
    out = {}
    for source, target in brute_targets(dict(sizes)).items():
        total = sizes[source]
        whole = min(math.floor(target / total), 3) if total else 0
        gap, taken, free = target - whole * total, set(), []
        budget, open_ = gap, True
        for key, i, n in sorted(by_source[source]):
            open_ = open_ and n <= gap
            if open_:
                taken.add(i)
                gap -= n
            elif n:
                free.append((key, i, n))
        extra = set()
        for turn in range(fillers):
            fits = [f for f in free if f[1] not in extra and (f[2] <= gap if turn < fillers - 1 else abs(gap - f[2]) < gap)]
            if gap <= 0 or not fits:
                if gap <= 0:
                    break
                continue
            key, i, n = min(fits, key=lambda f: (abs(gap - f[2]), f[0], f[1]))
            extra.add(i)
            gap -= n
        for _, i, _ in by_source[source]:
            more = budget > 0 and whole < 3
            out[i] = (whole + (more and i in taken | extra), more and i in extra)
    return out


def test_the_sample_is_the_sorted_prefix_of_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(16)
    rows = [(i, rng.choice([None, ""]) if rng.random() < 0.02 else "w" * rng.randint(1, 9) + " v" * rng.randint(0, 60), rng.choice(["big"] * 20 + ["mid"] * 6 + ["small", None, "é"])) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    size = mixing.word_count(F.col("text"))
    keys = {r[0]: r[1] for r in docs.select("doc_id", mixing.sampling_key([F.col("doc_id"), size], mixing.default_quality(F.col("text"), size))).collect()}
    want = brute_mix(rows, keys)
    assert {r.doc_id: (r.copies, r.filler) for r in mixing.mix_report(docs).collect()} == want
    assert sum(f for _, f in want.values()) <= mixing.FILLERS * 5


def test_targets_of_many_and_of_huge_sources(spark):
    n = 20_000
    sources = spark.range(n).selectExpr("concat('s', id) source", "1L source_size").unionByName(spark.createDataFrame([(None, 30_000_000_000_000), ("a", 3_000_000_000_000_000_000)], "source string, source_size bigint"))
    got = {r.source: r for r in mixing.targets(sources).collect()}
    want = brute_targets({r: g.source_size for r, g in got.items()})
    assert len(got) == n + 2 and got[None].rank == n + 1 and got["a"].rank == 0
    assert sorted((s for s in got if s is not None)) == sorted((s for s in got if s is not None), key=lambda s: got[s].rank)
    assert all(math.isclose(got[s].target, t, rel_tol=1e-12) for s, t in want.items())


def test_mixed_rows_are_the_taken_copies(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7 + 1), "en", "ab"[i % 2], i) for i in range(300)], SCHEMA)
    copies = {r.doc_id: r.copies for r in mixing.mix_report(docs).collect()}
    counted = defaultdict(int)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        counted[r.doc_id] += 1
    assert dict(counted) == {i: c for i, c in copies.items() if c}


def test_mix_with_a_very_long_text_and_clashing_columns(spark):
    rows = [(0, "w " * 400_000, "a", 1, 2, "x")] + [(i, "w " * (i % 50 + 1), "ab"[i % 2], 1, 2, "x") for i in range(1, 400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, uid int, bin int, copies string")
    got = {r.doc_id: r for r in mixing.mix_report(docs).collect()}
    assert got[0].size == 400_000 and sum(r.size for r in got.values()) == 400_000 + sum(i % 50 + 1 for i in range(1, 400))
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and {r.copies for r in out.collect()} == {"x"}


def test_mix_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, " ", "s", 2)], "doc_id bigint, text string, source string, size int")
    assert [(r.size, r.taken) for r in mixing.mix_report(docs).collect()] == [(0, 0)] * 3
    assert mixing.mix_report(docs.limit(0)).collect() == []
    assert mixing.mixed(docs).collect() == []
