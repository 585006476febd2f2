"""License texts in documents, found by patience alignment with templates.

An index holds, for each template, words that no copy of it can lack: the rarest of those that
tell it from its neighbours or, without such, so many of its rarest that lacking all would leave
too little of it.  Where a document has one, the surroundings are aligned
with the template: words that occur once in both are anchors, the longest
increasing subsequence of them is kept, and the gaps between are aligned in the same way.
A template is found where enough of its words are aligned close together, and the words that
tell it from its neighbours (name, version, NC, SA, ND) stand in one run, with none between.

Defined results: null and empty texts have no licenses; every place of a license is found,
also of the same one; of templates that overlap, the one with more aligned words counts,
then the earlier name; repeated rows get equal results; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COVERAGE = 0.8
#: So many words more than the template has may lie between its first and its last word.
SLACK = 8

#: Public license texts and notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}

_GNU_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
_GNU = {"gpl": ("General Public License", "2 3"), "lgpl": ("Lesser General Public License", "2.1 3"), "agpl": ("Affero General Public License", "3")}
_CC = {"": "", "-sa": "ShareAlike", "-nd": "NoDerivatives", "-nc": "NonCommercial", "-nc-sa": "NonCommercial ShareAlike", "-nc-nd": "NonCommercial NoDerivatives"}
_CC_PLACES = {"4.0": "International", "3.0": "Unported", "2.5": "Generic", "2.0": "Generic"}

#: The runs of words that tell a template from its neighbours; a template that isn't here is told by its length.
RUNS = {
    "mit-notice": ["MIT"],
    "apache-2.0-notice": ["Apache License, Version 2.0"],
    "apache-2.0-header": ["Apache License, Version 2.0"],
    "gpl-3.0-notice": ["GNU General Public License, version 3"],
    "cc-by-nc-4.0-notice": ["CC BY-NC 4.0"],
    "cc-by-4.0-notice": ["Creative Commons Attribution 4.0"],
    "cc-by-sa-4.0-notice": ["Creative Commons Attribution-ShareAlike 4.0"],
    "mit": ["shall be included in all copies"],
    "isc": ["appear in all copies"],
    "gpl-3.0-header": ["GNU General Public License as", "version 3 of"],
    "mpl-2.0-header": ["Mozilla Public License, v. 2.0"],
}


def _more() -> list[tuple[str, str, list[str]]]:
    """(license, text, runs) of the neighbours of the templates above, and of other wordings of these."""
    mit = TEMPLATES["mit"]
    found = [
        ("mit-0", mit[: mit.index(", subject to")] + mit[mit.index(" THE SOFTWARE IS") :], ["furnished to do so THE SOFTWARE IS PROVIDED"]),
        ("bsd-3-clause", TEMPLATES["bsd"] + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["Neither the name of"]),
        ("bsd-4-clause", TEMPLATES["bsd"] + " All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["All advertising materials mentioning", "Neither the name of"]),
        ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", ["with or without fee is hereby granted"]),
        ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ["free and unencumbered software"]),
        ("mpl-1.1-header", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/', ["Mozilla Public License Version 1.1"]),
    ]
    # Names in running text; each counts after one of the usual beginnings.
    named = [("isc", "the ISC License"), ("bsd", "the BSD License"), ("unlicense", "the Unlicense"), ("unlicense", "the Unlicense License"), ("mit-0", "the MIT No Attribution License"), ("cc0-1.0", "CC0 1.0 Universal"), ("cc0-1.0", "CC0 1.0")]
    named += [("mit", "the MIT License"), *((f"bsd-{n}-clause", f"the BSD {n}-Clause License") for n in "234")]
    named += [(f"apache-{v}", f"the Apache License, {x}{v}") for v in ("1.0", "1.1", "2.0") for x in ("Version ", "v", "")]
    named += [(f"mpl-{v}", f"the Mozilla Public License, {x}{v}") for v in ("1.0", "1.1", "2.0") for x in ("Version ", "v. ", "v", "")]
    for short, (name, versions) in _GNU.items():
        named += [(short, f"the GNU {name}"), (short, f"the {short}"), (short, f"the GNU {short}")]
        for v in versions.split():
            full = v if "." in v else f"{v}.0"
            found.append((f"{short}-{full}-header", _GNU_HEADER.format(name=name, version=v), [f"GNU {name} as", f"version {v} of"]))
            named += [(f"{short}-{full}", f"the {x} {y}") for x in (f"GNU {name}", short, f"GNU {short}") for y in (f"version {v}", f"v{v}", f"v {v}", v)]
            named += [(f"{short}-{full}", f"the {x}{short}v{v}") for x in ("", "GNU ")]
    named += [("lgpl-2.0", "the GNU Library General Public License, version 2")]
    for short, name in _CC.items():
        for v, place in _CC_PLACES.items():
            id_ = f"cc-by{short}-{v}"
            for spelled in {name, name.replace("NoDerivatives", "NoDerivs"), name.replace("NonCommercial", "Non-Commercial"), name.replace("ShareAlike", "Share Alike")}:
                named += [(id_, f"a Creative Commons Attribution {spelled} {v} {x}") for x in (f"{place} License", "License", "")]
            named.append((id_, f"CC BY{short} {v}"))
    for id_, name in named:
        run = name.removeprefix("the ").removeprefix("a ").removesuffix(" License")
        for start in ("Licensed under", "Released under", "This work is licensed under"):
            found.append((f"{id_}-notice", f"{start} {name}", [run]))
    return found


_WORD = re.compile(r"\w+")
#: Only a version that is longer by zeros is the same one: 3.0 is 3, 2.1 isn't 2.
_OTHER_VERSION = re.compile(r"\.0*[1-9]")


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by the first, in which the second increases, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for n, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        if pile == len(tops):
            tops.append(b)
            piles.append(n)
        else:
            tops[pile], piles[pile] = b, n
        back.append(piles[pile - 1] if pile else -1)
    out = []
    n = piles[-1] if piles else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Aligned (text, template) positions, in order."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        t0, t1, p0, p1 = gaps.pop()
        while t0 < t1 and p0 < p1 and text[t0] == template[p0] and (t0, p0) != (0, 0):  # what follows an anchor
            out.append((t0, p0))
            t0, p0 = t0 + 1, p0 + 1
        while t0 < t1 and p0 < p1 and text[t1 - 1] == template[p1 - 1] and (t1, p1) != (len(text), len(template)):
            out.append((t1 - 1, p1 - 1))
            t1, p1 = t1 - 1, p1 - 1
        if t0 >= t1 or p0 >= p1:
            continue
        in_text, in_template = Counter(text[t0:t1]), Counter(template[p0:p1])
        place = {template[p]: p for p in range(p0, p1) if in_template[template[p]] == 1}
        anchors = _increasing([(t, place[text[t]]) for t in range(t0, t1) if in_text[text[t]] == 1 and text[t] in place])
        if not anchors:
            continue
        out += anchors
        for (a, b), (c, d) in zip([(t0 - 1, p0 - 1), *anchors], [*anchors, (t1, p1)]):
            gaps.append((a + 1, c, b + 1, d))
    return sorted(out)


def _densest(aligned: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """The most aligned words within ``length`` words of the text; the first such stretch."""
    best, start = (0, 0), 0
    for end in range(len(aligned)):
        while aligned[end][0] - aligned[start][0] >= length:
            start += 1
        if end + 1 - start > best[1] - best[0]:
            best = (start, end + 1)
    return aligned[best[0] : best[1]]


def _spelled(word: str) -> str:
    """In lower case; the British licence is the same word."""
    word = word.lower()
    return "licens" + word[6:] if word.startswith("licenc") else word


def _words(text: str) -> list[str]:
    return [_spelled(w) for w in _WORD.findall(text)]


def _place(run: list[str], template: list[str]) -> range:
    at = next(i for i in range(len(template)) if template[i : i + len(run)] == run)
    return range(at, at + len(run))


def _prepared() -> list[tuple[str, list[str], list[range], frozenset[str]]]:
    """(license, words, places of its runs, words of its runs) of all templates, each wording once."""
    rows = {}
    for name, text, runs in [*((name, text, RUNS.get(name, [])) for name, text in TEMPLATES.items()), *_more()]:
        template = _words(text)
        places = [_place(_words(run), template) for run in runs]
        rows.setdefault((name, *template), (name, template, places, frozenset(template[p] for place in places for p in place)))
    return list(rows.values())


_PREPARED = _prepared()
_TEMPLATES_WITH = Counter(word for _, template, _, _ in _PREPARED for word in set(template))


def _seeds(template: list[str], places: list[range], coverage: float) -> list[str]:
    """Words one of which every copy has: of the first run the rarest, else the rarest that make up more than a copy may lack."""
    rare = lambda words: sorted(set(words), key=lambda w: (template.count(w), _TEMPLATES_WITH[w], -len(w), w))
    if places:
        return rare(template[p] for p in places[0])[:1]
    chosen, without = [], 0
    for word in rare(template):
        if len(template) - without < coverage * len(template):
            break
        chosen.append(word)
        without += template.count(word)
    return chosen


@cache
def _index(coverage: float) -> dict[str, list[int]]:
    """The templates (numbers) that each seed word stands for."""
    out: dict[str, list[int]] = {}
    for n, (_, template, places, _) in enumerate(_PREPARED):
        for word in _seeds(template, places, coverage):
            out.setdefault(word, []).append(n)
    return out


def _told(aligned: list[tuple[int, int]], places: list[range], ends: list[int], text: str) -> bool:
    """Whether every run is aligned as a whole, with no other word in it and no other version at its end."""
    at = {p: t for t, p in aligned}
    for place in places:
        first = at.get(place[0])
        if first is None or any(at.get(p) != first + n for n, p in enumerate(place)) or _OTHER_VERSION.match(text, ends[at[place[-1]]]):
            return False
    return True


def scan(text: str, coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first and last character + 1) of every license text."""
    spans = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    words = [_spelled(text[a:b]) for a, b in spans]
    ends = [b for _, b in spans]
    index = _index(coverage)
    seeds: dict[int, list[tuple[int, str]]] = {}
    for i, word in enumerate(words):
        for n in index.get(word, ()):
            seeds.setdefault(n, []).append((i, word))
    known = set(words) if seeds else set()
    found = []
    for n, places_of in sorted(seeds.items()):
        name, template, places, telling = _PREPARED[n]
        if not telling <= known or sum(map(known.__contains__, template)) < coverage * len(template):
            continue
        done = 0
        for seed, at in ((i, p) for i, word in places_of for p, w in enumerate(template) if w == word):
            if seed < done:
                continue
            for slack in (len(template), SLACK, 1):  # narrower where a copy stands so near that its words aren't unique
                first = max(0, seed - at - slack, done)
                got = _densest(align(words[first : seed - at + len(template) + slack], template), len(template) + SLACK)
                if len(got) >= coverage * len(template) and _told([(first + t, p) for t, p in got], places, ends, text):
                    start, end = first + got[0][0], first + got[-1][0] + 1
                    found.append((-len(got), name, len(got) / len(template), start, end))
                    done = end
                    break
    kept = []
    for _, name, share, start, end in sorted(found):
        if all(end <= s or start >= e for _, _, s, e in kept):
            kept.append((name, share, start, end))
    return [(name, share, spans[start][0], spans[end - 1][1]) for name, share, start, end in sorted(kept, key=lambda x: x[2])]


def licenses(docs: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, start and end (characters): one row per license text of a document."""

    def run(parts):
        for part in parts:
            rows = [(i, *x) for i, text in zip(part["doc_id"], part["text"]) for x in scan(text, coverage)]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "coverage", "start", "end"]).astype({"doc_id": "Int64"})

    seeds = "|".join(re.escape(w).replace("licens", "licen[sc]") for w in sorted(_index(coverage)))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("text").rlike(rf"(?iU)\b(?:{seeds})\b"))
    return rows.mapInPandas(run, "doc_id long, license string, coverage double, start long, end long")
