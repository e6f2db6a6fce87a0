"""License scan by patience alignment (operator 7).

A text and a license template are aligned on the words that occur exactly once in both: the longest
increasing subsequence of their positions gives the anchors, and the gaps between anchors are
aligned the same way, down to gaps without unique common words, of which equal beginnings and ends
still count. The coverage is the number of aligned words by that of the template's words, or of the
words the match spans if they are more: words put in count against it.

Names and numbers of a template (``NAMES``, versions) must all be aligned, and a match may hold no
word of ``MARKS`` that its template lacks ("Lesser", "NC"): so one license isn't taken for another.

A match thus holds the longest name of its template, which is its key word. In a template without
names, a match of coverage ``least`` or more holds at least one of any floor((1 - least) words) + 1
words, and that many of its longest are the key words. Only stretches of a text around key words are
aligned; no text is cut short. Stretches end where no key word follows for a template's length.
Windows begin where a template would begin that has its key word there, so notices one after
another are each aligned, and in even steps. Of overlapping matches, the one that aligns the most
words, less those put in, is reported. Licenses without a template are not found.

Defined results: null and empty texts and texts without key words give no rows; a null doc_id is
carried; rows repeated in the input are scanned one by one; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from revlens.llm.common import bound_batches, known_id, null_id, slices

LEAST = 0.8
WORD = re.compile(r"\w+")
FOUND = "doc_id long, license string, coverage double, first_word int, n_words int, matched_words int"

# Public license notices and statements.
TEMPLATES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software."),
    "MIT-statement": "Released under the MIT License.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."),
    "Apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "GPL-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-statement": "Licensed under CC BY-NC 4.0.",
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."),
    "AGPL-3.0-statement": "This work is licensed under the GNU Affero General Public License, version 3.",
    "LGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version."),
    "LGPL-3.0-statement": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
        "your option) any later version."),
    "LGPL-2.1-statement": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "GPL-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version."),
    "GPL-2.0-statement": "This work is licensed under the GNU General Public License, version 2.",
    "BSD-statement": "Released under the BSD License.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "ISC-statement": "Released under the ISC License.",
    "MPL-2.0-statement": "Licensed under the Mozilla Public License, Version 2.0.",
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0"),
    "EPL-2.0-statement": "Licensed under the Eclipse Public License, Version 2.0.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "This work is licensed under a Creative Commons CC0 1.0 Universal License.",
    "CC0-1.0-statement": "Licensed under CC0 1.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "CC-BY-NC-ND-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "CC-BY-statement": "Licensed under CC BY 4.0.",
    "CC-BY-SA-statement": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-statement": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-statement": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-statement": "Licensed under CC BY-NC-ND 4.0.",
}
#: Words that tell licenses apart: they must not be in a match whose template lacks them.
MARKS = frozenset("lesser affero noncommercial noncommercially sharealike noderivatives noderivs nc sa nd cc0".split())
#: Words of templates that a match must have, besides numbers.
NAMES = MARKS | frozenset("mit apache gnu mozilla mpl bsd isc eclipse boost unencumbered creative commons cc attribution".split())


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in order of their first number, the longest run that also increases in the second."""
    tops: list[int] = []            # smallest last value of a run of each length
    last: list[int] = []            # the pair that ends it
    before = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        before[i] = last[k - 1] if k else -1
        if k == len(tops):
            tops.append(b)
            last.append(i)
        else:
            tops[k], last[k] = b, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned positions (in text, in template), increasing in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a >= b or c >= d:
            continue
        own, other = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(template[c:d], c) if other[w] == 1}
        anchors = longest_increasing([(i, place[w]) for i, w in enumerate(text[a:b], a) if own[w] == 1 and w in place])
        if not anchors:
            continue
        found += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            todo.append((i + 1, k, j + 1, m))
    return sorted(found)


@dataclass(frozen=True)
class Template:
    name: str
    words: list[str]
    keys: frozenset[str]
    #: Words that must be aligned, and the places of the key words.
    needed: frozenset[str]
    key_places: dict[str, list[int]]


def prepared(templates: dict[str, str], least: float) -> list[Template]:
    out = []
    for name, text in templates.items():
        words = words_of(text)
        # Occurrences, not just words, must outnumber what a match may miss.
        spare, keys, n = len(words) - -(-len(words) * round(least * 100) // 100), [], 0
        count = Counter(words)
        for w in sorted(count, key=lambda w: (-len(w), w)):
            if n > spare:
                break
            keys.append(w)
            n += count[w]
        needed = frozenset(w for w in words if w in NAMES or w.isdigit())
        if names := sorted(w for w in needed if not w.isdigit()):
            keys = [max(names, key=len)]
        out.append(Template(name, words, frozenset(keys), needed,
                            {k: [j for j, w in enumerate(words) if w == k] for k in keys}))
    return out


def stretches(text: list[str], t: Template, places: dict[str, list[int]]) -> Iterator[tuple[int, int]]:
    """Ranges of words around the template's key words, joined where they are near each other."""
    at = sorted(i for w in t.keys for i in places.get(w, ()))
    n, first, last = len(t.words), None, None
    for i in at:
        if first is not None and i - last > n:
            yield max(0, first - n), min(len(text), last + n + 1)
            first = i
        first, last = i if first is None else first, i
    if first is not None:
        yield max(0, first - n), min(len(text), last + n + 1)


def matches(text: list[str], templates: list[Template], least: float) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, first word, words, matched words) of a text, without overlaps."""
    places: dict[str, list[int]] = {}
    keys = frozenset().union(*(t.keys for t in templates))
    for i, w in enumerate(text):
        if w in keys:
            places.setdefault(w, []).append(i)
    found = []
    for t in templates:
        n = len(t.words)
        most = n * 100 // round(least * 100)  # words that a match can span
        begins = {max(0, i - j) for w in t.keys for i in places.get(w, ()) for j in t.key_places[w]}
        # As long as the template, so without words of a next notice, and with room for words put in.
        windows = {(c, min(len(text), c + size)) for c in begins for size in (n, most)}
        for a, b in stretches(text, t, places):
            # Windows of twice the template's length, half a length apart: a notice that is no longer
            # than one and a half lengths lies whole in one of them, with little of the next notice.
            windows |= {(c, min(b, c + 2 * n + 2)) for c in range(a, max(a + 1, b - n), max(1, n // 2))}
        for c, end in sorted(windows):
            pairs = align(text[c:end], t.words)
            if len(pairs) < least * n:
                continue
            first, span = c + pairs[0][0], pairs[-1][0] - pairs[0][0] + 1
            coverage = len(pairs) / max(n, span)
            if coverage >= least and t.needed <= {t.words[j] for _, j in pairs} and all(
                    w in t.needed for w in MARKS.intersection(text[first:first + span])):
                found.append((t.name, coverage, first, span, len(pairs)))
    kept: list[tuple[str, float, int, int, int]] = []
    for m in sorted(set(found), key=lambda m: (m[3] - 2 * m[4], -m[1], m[3], m[2], m[0])):
        if all(m[2] + m[3] <= k[2] or k[2] + k[3] <= m[2] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[2])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """One row per license notice in ``docs`` (doc_id, text), columns as FOUND; positions in words."""
    bound_batches(docs.sparkSession)
    known = prepared(TEMPLATES if templates is None else templates, least)
    any_key = re.compile(r"\b(?:" + "|".join(sorted({re.escape(k) for t in known for k in t.keys})) + r")\b")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches):
            rows = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                if isinstance(text, str) and any_key.search(lower := text.lower()):
                    rows += [(doc_id, *m) for m in matches(WORD.findall(lower), known, least)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("doc_id", "license", "coverage", "first_word",
                                                                     "n_words", "matched_words")])

    return docs.select(known_id(), "text").mapInPandas(scan, FOUND).withColumn("doc_id", null_id())
