"""License scans by sentence rules.

Texts are cut into fragments at line ends and after stops; a fragment, or a run of fragments (wrapped lines), whose
normalised words are those of a known licence sentence gets the sentence's identifier. A slot ``{*}`` in a sentence (a
name, a holder) stands for one to ``SLOT`` words. The identifier sequence of a
text is matched against ordered rules: a rule is found where its identifiers follow one another with at most ``GAP``
fragments between, and rules of more sentences go first, so a licence inside a larger one is not reported again.

Each text is one row's work: its fragments are looked up in a trie of the sentences. Most texts hold none of the words of
which every known sentence has one (derived from the table: a small cover by words) and cost one search.

Nulls: a null text has no fragment. Repeated rows are reported each. Texts without licences have no row. Other columns
are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, texts_of

WORDS = re.compile(r"[a-z0-9]+(?:[.'-][a-z0-9]+)*")
STOPS = re.compile(r"\n|(?<=[.;:!?])\s")
GAP = 2
#: Words of the sentences that are common in other texts too, so they spare few.
COMMON = ("without", "distributed", "following", "conditions", "purpose", "permitted", "obtain", "version", "provided", "available", "subject", "person", "modify", "particular")
#: Words that a slot may stand for, and the key of a slot in a trie.
SLOT, WILD = 12, ("{*}",)

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit-notice-1": "Released under the MIT License",
    "mit-notice-2": "Licensed under the MIT License",
    "mit-notice-3": "This project is licensed under the MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-notice": "Licensed under the Apache License, Version 2.0",
    "apache-header": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-notice-1": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-notice-2": "Licensed under the GNU General Public License, version 3",
    "gpl2-notice": "Licensed under the GNU General Public License, version 2",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free-1": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2-free-2": "either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-implied": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "lgpl-notice": "Licensed under the GNU Lesser General Public License, version 3",
    "agpl-notice": "Licensed under the GNU Affero General Public License, version 3",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-notice-2": "Licensed under the BSD 2-Clause License",
    "bsd-notice-3": "Licensed under the BSD 3-Clause License",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-notice-1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-notice-2": "Licensed under the Mozilla Public License, Version 2.0",
    "cc-by-notice": "Licensed under CC BY 4.0",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-nd-notice": "Licensed under CC BY-NC-ND 4.0",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0-notice": "This work is dedicated to the public domain under CC0 1.0",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "reserved": "Copyright, all rights reserved",
    "bsd-provided": 'THIS SOFTWARE IS PROVIDED BY {*} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "lgpl-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "epl-notice": "Licensed under the Eclipse Public License, Version 2.0",
    "epl-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "zlib-provided": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "wtfpl-title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
# Other wordings of sentences above, as (identifier, sentence).
VARIANTS = (
    ("mit-liability", "IN NO EVENT SHALL {*} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd-name", "Neither the name of {*} nor the names of {*} contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
)
# Identifiers of the public licence list, each a sentence and a rule of its own.
SPDX = (
    "MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later "
    "BSD-2-Clause BSD-3-Clause ISC MPL-2.0 EPL-2.0 Zlib BSL-1.0 Unlicense WTFPL CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0"
).split()
SENTENCES |= {f"spdx-{x}": f"SPDX-License-Identifier: {x}" for x in SPDX}
# Ordered rules, as (licence, sentence identifiers).
RULES = (
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-condition")),
    ("MIT", ("mit-notice-1",)),
    ("MIT", ("mit-notice-2",)),
    ("MIT", ("mit-notice-3",)),
    ("Apache-2.0", ("apache-header", "apache-use", "apache-copy", "apache-warranty", "apache-see")),
    ("Apache-2.0", ("apache-header", "apache-use")),
    ("Apache-2.0", ("apache-header",)),
    ("Apache-2.0", ("apache-notice",)),
    ("GPL-3.0", ("gpl-free", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-3.0", ("gpl-free",)),
    ("GPL-3.0", ("gpl3-notice-1",)),
    ("GPL-3.0", ("gpl3-notice-2",)),
    ("GPL-2.0", ("gpl2-free-1", "gpl2-free-2", "gpl-hope", "gpl-implied", "gpl-details")),
    ("GPL-2.0", ("gpl2-free-1", "gpl2-free-2")),
    ("GPL-2.0", ("gpl2-notice",)),
    ("LGPL-3.0", ("lgpl-notice",)),
    ("AGPL-3.0", ("agpl-notice",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", ("bsd-notice-2",)),
    ("BSD-3-Clause", ("bsd-notice-3",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-notice-1",)),
    ("MPL-2.0", ("mpl-notice-2",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("Unlicense", ("unlicense",)),
    ("Proprietary", ("reserved",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "bsd-provided")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-provided")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-hope", "lgpl-details")),
    ("LGPL-2.1-or-later", ("lgpl-free",)),
    ("AGPL-3.0", ("agpl-free", "gpl-hope", "gpl-implied", "agpl-details")),
    ("AGPL-3.0", ("agpl-free",)),
    ("EPL-2.0", ("epl-notice",)),
    ("EPL-2.0", ("epl-header",)),
    ("Zlib", ("zlib-provided", "zlib-liable", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-notice",)),
    ("BSL-1.0", ("boost-grant",)),
    ("WTFPL", ("wtfpl-title",)),
    ("MPL-2.0", ("mpl-notice-1", "mpl-copy")),
    *((x, (f"spdx-{x}",)) for x in SPDX),
)


def normalised(sentence: str) -> tuple[str, ...]:
    return tuple(WORDS.findall(sentence.lower()))


def anchors_of(sentences: Iterable[str]) -> re.Pattern:
    """A pattern that every one of the sentences matches, lower-cased and however wrapped: parts of words that cover them,
    those first that cover the most. A sentence of short words only is covered by its longest."""
    words = {s: set(normalised(s.replace("{*}", " "))) for s in sentences}
    left, found = set(words), []
    while left:
        counts = Counter(w for s in left for w in words[s] if len(w) >= 6 and w not in COMMON or w == max(words[s], key=lambda x: (len(x), x)))
        best = min(counts, key=lambda w: (-counts[w], -len(w), w))
        found.append(best)
        left -= {s for s in left if any(best in w for w in words[s])}
    return re.compile("|".join(map(re.escape, found)) or r"(?!)")


def trie_of(sentences: Iterable[tuple[str, str]]) -> dict:
    """Nested dicts by word, slots under the key ``WILD``; the identifier of a whole sentence is under the key ``None``."""
    root: dict = {}
    for name, sentence in sentences:
        node = root
        for i, part in enumerate(sentence.split("{*}")):
            if i:
                node = node.setdefault(WILD, {})
            for word in normalised(part):
                node = node.setdefault(word, {})
        node[None] = name
    return root


def step(states: list[tuple[dict, int]], word: str) -> list[tuple[dict, int]]:
    """The (node, words that the slot before it may still take) that a word leads to."""
    after = {}
    for node, more in states:
        for there, left in ((node.get(word), 0), (node.get(WILD), SLOT - 1), (node if more else None, more - 1)):
            if there is not None:
                after[id(there)] = (there, max(left, after.get(id(there), (None, 0))[1]))
    return list(after.values())


def fragments(text: str) -> list[tuple[int, int, tuple[str, ...]]]:
    """(start, end, words) of all fragments that have words."""
    edges = [0, *(m.end() for m in STOPS.finditer(text)), len(text)]
    parts = ((a, b, normalised(text[a:b])) for a, b in zip(edges, edges[1:], strict=False))
    return [p for p in parts if p[2]]


def sentence_ids(parts: list[tuple[int, int, tuple[str, ...]]], trie: dict) -> list[tuple[int, int, str]]:
    """(first, last, identifier) of known sentences; at each fragment the longest, and none within another."""
    found, i = [], 0
    while i < len(parts):
        states, best = [(trie, 0)], None
        for j in range(i, len(parts)):
            for word in parts[j][2]:
                states = step(states, word)
                if not states:
                    break
            if not states:
                break
            ends = [node[None] for node, _ in states if None in node]
            if ends:
                best = (i, j, min(ends))
        if best:
            found.append(best)
            i = best[1]
        i += 1
    return found


def matches(ids: list[tuple[int, int, str]], rules=RULES, gap: int = GAP) -> list[tuple[str, int, int, int]]:
    """(licence, first fragment, last fragment, sentences), by place."""
    used, found = set(), []
    for licence, rule in sorted(rules, key=lambda r: -len(r[1])):
        for k in range(len(ids)):
            chain = [k]
            while len(chain) <= len(rule) and ids[chain[-1]][2] == rule[len(chain) - 1] and chain[-1] not in used:
                if len(chain) == len(rule):
                    used.update(chain)
                    found.append((licence, ids[k][0], ids[chain[-1]][1], len(rule)))
                    break
                want = rule[len(chain)]
                after = next((j for j in range(chain[-1] + 1, len(ids)) if ids[j][0] - ids[chain[-1]][1] > gap + 1 or ids[j][2] == want), None)
                if after is None or ids[after][2] != want or ids[after][0] - ids[chain[-1]][1] > gap + 1:
                    break
                chain.append(after)
    return sorted(found, key=lambda x: x[1:])


#: Of the own table.
ANCHORS = anchors_of([*SENTENCES.values(), *(s for _, s in VARIANTS)])


def licenses(docs: DataFrame, sentences=SENTENCES, rules=RULES, variants=None, anchors: re.Pattern | bool | None = True) -> DataFrame:
    """(doc_id, license, start, end, n_sentences): every match in every row of (doc_id, text); places in code points.

    ``variants`` are other wordings of the sentences, by default those of the own table, and none for other tables.
    ``anchors`` spares texts that can't hold a known sentence; by default it is derived from the sentences, None for none.
    """
    variants = (VARIANTS if sentences is SENTENCES else ()) if variants is None else variants
    named = [*sentences.items(), *variants]
    anchors = anchors_of(s for _, s in named) if anchors is True else anchors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(named)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                if not text or anchors and not anchors.search(text.lower()):
                    continue
                parts = fragments(text)
                rows += [(doc_id, name, parts[a][0], parts[b][1], n) for name, a, b, n in matches(sentence_ids(parts, trie), rules)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "license", "start", "end", "n_sentences"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, license string, start long, end long, n_sentences long")


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return licenses(table(spark, sf_dir, "documents"))
