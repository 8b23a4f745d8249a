"""Licence notices by MinHash bands over overlapping windows.

Templates and texts are word sequences (lower case, ASCII punctuation dropped). A window is one word longer than a template
and starts at every word, so it holds a notice with a word inserted. A window and a template match when the window holds

- the template's keys, the words in [[ ]] that make it this licence and no other (name, terms, version), each key unbroken;
- all but max(1, n // 5) of the template's n distinct words; and
- CONTAINMENT of its shingles (WIDTH words each), or, where that is less, what one changed word inside leaves of them.

So any one word outside the keys may be changed, dropped or put in. A change inside a key is another licence or none: no
version is guessed. Two templates may be each other's near copies (GPL and LGPL); where matches of such rivals overlap, the
one with the greater share stays, on ties both; a sentence does not displace a full text of over twice its shingles.

Retrieval: windows with too few of a template's shingles are passed over by exact counts. The rest are compared with it in
BANDS bands of one minimum each, shingles that no template of that length has left out of both. At these settings a template of n words has a
share of at least 1/3 (n = 4) in a match; with up to n - 1 other known shingles in the window the similarity is 1/6 or more and
a match misses all bands with probability (5/6)^BANDS < 1e-9; equal sets never miss.

The scan is one pass without a shuffle. Templates are broadcast in blocks of about TEMPLATE_BYTES; with more of them, a row passes
the blocks one after the other and carries what each found, and the last decides between overlapping matches. A licence
may have many texts: notices, and for the short licences the full text.

Defined results: null and empty texts match nothing; a template of fewer than four words is compared by single words;
first_word and end_word bound the shingles held; overlapping matches of one licence give the one that holds the most shingles (on ties the greater share, then the first),
separate ones are reported each; repeated rows are reported each.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare
from .decontaminate import words_of

WIDTH, CONTAINMENT, BANDS, SEED = 2, 0.8, 128, 11
TEMPLATE_BYTES = 4 << 20
#: The parts of full licence texts.
_AS_IS = "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {more}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. " + _AS_IS
FULL_TEXTS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": _BSD.format(more=""),
    "BSD-3-Clause": _BSD.format(more="3. Neither the [[name]] of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "),
}
#: Notices by SPDX identifier, keys in [[ ]].
TEMPLATES: dict[str, str | tuple[str, ...]] = {
    "0BSD": "[[BSD Zero Clause]] License",
    "AGPL-3.0": ("This work is licensed under the GNU [[Affero]] General Public License, version [[3]].", "Licensed under the GNU [[Affero]] General Public License, version [[3]].", "Licensed under the [[AGPL v3]].", "Licensed under the [[AGPLv3]].", "GNU [[AFFERO]] GENERAL PUBLIC LICENSE Version [[3]], 19 November 2007"),
    "Apache-1.1": ("Licensed under the [[Apache]] License, Version [[1.1]].", "The [[Apache]] Software License, Version [[1.1]]"),
    "Apache-2.0": ("Licensed under the [[Apache]] License, Version [[2.0]].", "[[Apache]] License Version [[2.0]], January 2004"),
    #: The sentence that BSD-2-Clause and BSD-3-Clause have in common.
    "BSD": "[[Redistribution]] and use in [[source and binary]] forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause": ("Released under the [[BSD 2 Clause]] License.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and or other materials provided with the [[distribution THIS SOFTWARE]] IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS"),
    "BSD-3-Clause": ("Released under the [[BSD 3 Clause]] License.", "Neither the [[name]] of the copyright holder nor the names of its contributors may be used to [[endorse or promote]] products derived from this software without specific prior written permission"),
    "BSD-4-Clause": "All [[advertising]] materials mentioning features or use of this software must display the following [[acknowledgement]]",
    "BSL-1.0": ("[[Boost]] Software License Version [[1.0]]", "Distributed under the [[Boost]] Software License, Version [[1.0]]."),
    "CC0-1.0": ("Licensed under [[CC0 1.0]] Universal.", "Released under [[CC0]].", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the [[public domain]] worldwide", "To the extent possible under law, the person who associated CC0 with this work has [[waived]] all copyright and related or neighboring rights to this work"),
    "EPL-1.0": "This program is made available under the terms of the [[Eclipse]] Public License [[1.0]]",
    "EPL-2.0": "This program is made available under the terms of the [[Eclipse]] Public License [[2.0]]",
    "ISC": ("Released under the [[ISC]] License.", "Permission to [[use copy modify]] and or distribute this software for any purpose [[with or without fee]] is hereby granted"),
    "MIT": "Released under the [[MIT]] License.",
    "MIT-grant": "[[Permission]] is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-1.1": "The contents of this file are subject to the [[Mozilla]] Public License Version [[1.1]]",
    "MPL-2.0": ("This Source Code Form is subject to the terms of the [[Mozilla]] Public License, v. [[2.0]].", "[[Mozilla]] Public License Version [[2.0]]"),
    "OFL-1.0": "This Font Software is licensed under the SIL [[Open Font]] License, Version [[1.0]].",
    "OFL-1.1": ("This Font Software is licensed under the SIL [[Open Font]] License, Version [[1.1]].", "SIL [[OPEN FONT]] LICENSE Version [[1.1]] 26 February 2007"),
    "Proprietary": "[[All rights]] [[reserved]].",
    "Unlicense": "This is free and [[unencumbered]] software released into the [[public domain]].",
    "Zlib": "This software is provided as is, without any express or implied warranty. [[In no event]] will the [[authors]] be held liable for any damages arising from the use of this software",
    **{f"GPL-{v}.0": (f"This work is licensed under the [[GNU General]] Public License, version [[{v}]].", f"Licensed under the [[GNU General]] Public License, version [[{v}]].", f"Licensed under the [[GPL v{v}]].", f"Licensed under the [[GPLv{v}]].", f"Licensed under the [[GPL version {v}]].", f"[[GNU GENERAL]] PUBLIC LICENSE Version [[{v}]], {day}", f"under the terms of the [[GNU General]] Public License as published by the Free Software Foundation, either version [[{v}]] of the License") for v, day in ((1, "February 1989"), (2, "June 1991"), (3, "29 June 2007"))},
    **{f"LGPL-{v}": (f"This work is licensed under the GNU [[{kind}]] General Public License, version [[{said}]].", f"Licensed under the GNU [[{kind}]] General Public License, version [[{said}]].", f"Licensed under the [[LGPL v{said}]].", f"Licensed under the [[LGPLv{said}]].", f"GNU [[{kind}]] GENERAL PUBLIC LICENSE Version [[{said}]], {day}", f"under the terms of the GNU [[{kind}]] General Public License as published by the Free Software Foundation, either version [[{said}]] of the License") for v, said, kind, day in (("2.0", "2", "Library", "June 1991"), ("2.1", "2.1", "Lesser", "February 1999"), ("3.0", "3", "Lesser", "29 June 2007"))},
    **{f"CC-{kind}-{v}": (f"Licensed under [[CC {kind} {v}]].", f"Licensed under a Creative Commons [[{name} {v}]] License.", f"This work is licensed under the Creative Commons [[{name} {v}]] International License.") for kind, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")) for v in ("1.0", "2.0", "2.5", "3.0", "4.0")},
}
for _name, _text in FULL_TEXTS.items():
    TEMPLATES[_name] = (*([TEMPLATES[_name]] if isinstance(TEMPLATES[_name], str) else TEMPLATES[_name]), _text)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_rng = np.random.default_rng(SEED)
_A = _rng.integers(1, 2**63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(ids: np.ndarray, width: int) -> np.ndarray:
    n = len(ids) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, width, np.uint64)
    for k in range(width):
        acc = (acc ^ ids[k : k + n].astype(np.uint64)) * _M1
        acc = (acc ^ (acc >> np.uint64(29))) * _M2
    return acc ^ (acc >> np.uint64(32))


def _holds(ids: list[int], phrase: list[int]) -> bool:
    return any(ids[i : i + len(phrase)] == phrase for i in range(len(ids) - len(phrase) + 1))


class Index:
    def __init__(self, templates: dict[str, str | tuple[str, ...]], width: int, containment: float):
        self.vocab: dict[bytes, int] = {}
        self.names, self.sets, self.words, self.keys, self.need, self.spare = [], [], [], [], [], []
        self.groups: dict[tuple[int, int], list[int]] = defaultdict(list)
        number = lambda t: [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(t)]
        every = [(name, t) for name in sorted(templates) for t in ([templates[name]] if isinstance(templates[name], str) else templates[name])]
        texts = []
        for name, t in every:
            if not (ids := number(t)):
                continue
            n, w = len(ids), width if len(ids) > max(3, width) else 1
            self.groups[n, w].append(len(self.names))
            self.names.append(name)
            self.sets.append(np.unique(shingles(np.array(ids), w)))
            self.words.append(set(ids))
            self.keys.append([k for k in map(number, re.findall(r"\[\[(.*?)\]\]", t)) if k])
            self.spare.append(max(1, n // 5))
            # one changed word inside leaves this many shingles
            self.need.append(max(1, min(int(np.ceil(containment * len(self.sets[-1]) - 1e-9)), len(self.sets[-1]) - w)))
            texts.append(words_of(t))
        self.bands, self.known = {}, {}
        for g, ks in self.groups.items():
            self.bands[g] = np.stack([(self.sets[k][:, None] * _A[None, :]).min(axis=0) for k in ks])
            self.known[g] = np.unique(np.concatenate([self.sets[k] for k in ks]))
        self.texts = texts

    def matches(self, words: list[bytes]) -> list[tuple[str, int, int, float, int]]:
        """(licence, first word, last word + 1, containment, shingles held) of each window and template that match."""
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        held = set(ids[ids > 0].tolist())
        hashes, found = {}, []
        for (n, w), members in self.groups.items():
            able = [i for i, k in enumerate(members) if all(x in held for key in self.keys[k] for x in key) and len(self.words[k] - held) <= self.spare[k]]
            if not able:
                continue
            if w not in hashes:
                hashes[w] = shingles(ids, w)
            s = hashes[w]
            at = np.flatnonzero(np.isin(s, self.known[n, w]))
            if not len(at):
                continue
            wide = n + 2 - w  # shingles of n + 1 words
            # a short text is one window of its own
            last = max(0, len(s) - wide)
            starts = np.unique(np.clip((at[:, None] - np.arange(wide)[None, :]).ravel(), 0, last))
            sums = np.concatenate([[0], np.cumsum(np.isin(s, self.known[n, w]))])
            counts = sums[np.minimum(starts + wide, len(s))] - sums[starts]
            starts = starts[counts >= min(self.need[members[i]] for i in able)]
            for start in starts.tolist():
                row = s[start : start + wide]
                known = row[np.isin(row, self.known[n, w])]
                agree = (self.bands[n, w][able] == (known[:, None] * _A[None, :]).min(axis=0)[None, :]).any(axis=1)
                for k in (members[i] for i, yes in zip(able, agree.tolist(), strict=True) if yes):
                    own = np.isin(row, self.sets[k])
                    got = len(np.unique(row[own]))
                    if got < self.need[k]:
                        continue
                    window = ids[start : start + n + 1].tolist()
                    if len(self.words[k].difference(window)) <= self.spare[k] and all(_holds(window, key) for key in self.keys[k]):
                        places = np.flatnonzero(own)
                        found.append((self.names[k], start + int(places[0]), start + int(places[-1]) + w, got / len(self.sets[k]), got))
        return found


def _choose(hits: list[tuple], rivals: set[tuple[str, str]]) -> list[tuple[str, int, int, float]]:
    """(licence, first word, last word + 1, containment) of each notice among the matches of a text."""
    meet = lambda x, y: x[1] < y[2] and y[1] < x[2]
    best: list[tuple[str, int, int, float, int]] = []
    for hit in sorted(set(hits), key=lambda x: (-x[4], -x[3], x[2] - x[1], x[1], x[0])):
        if not any(x[0] == hit[0] and meet(x, hit) for x in best):
            best.append(hit)
    stays = [h for h in best if not any(x[3] > h[3] and 2 * x[4] >= h[4] and (x[0], h[0]) in rivals and meet(x, h) for x in best)]
    return sorted((x[:4] for x in stays), key=lambda x: (x[1], x[0]))


def _rivals(blocks: list[dict], width: int, containment: float) -> set[tuple[str, str]]:
    """Pairs of licences (a, b) where a text of one also matches the other."""
    texts = [(name, words_of(t)) for block in blocks for name, v in block.items() for t in ([v] if isinstance(v, str) else v)]
    found = set()
    for block in blocks:
        index = Index(block, width, containment)
        found |= {(hit[0], name) for name, words in texts for hit in index.matches(words)}
    return found | {(b, a) for a, b in found}


def _blocks(templates: dict[str, str | tuple[str, ...]], most: int) -> list[dict[str, tuple[str, ...]]]:
    blocks: list[dict] = [{}]
    held = 0
    for name in sorted(templates):
        for t in [templates[name]] if isinstance(templates[name], str) else templates[name]:
            if held and held + len(t.encode()) > most:
                blocks.append({})
                held = 0
            blocks[-1][name] = (*blocks[-1].get(name, ()), t)
            held += len(t.encode())
    return blocks


HITS = pa.list_(pa.struct([("licence", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("containment", pa.float64()), ("held", pa.int32())]))
HIT = "array<struct<licence:string,first_word:int,end_word:int,containment:double,held:int>>"


def find_licences(docs: DataFrame, templates: dict[str, str | tuple[str, ...]] | None = None, width: int = WIDTH, containment: float = CONTAINMENT, doc_id: str = "doc_id", text: str = "text", block_bytes: int = TEMPLATE_BYTES) -> DataFrame:
    """doc_id, licence, first_word, end_word, containment of every notice in `docs`."""
    spark = prepare(docs.sparkSession)
    blocks = _blocks(TEMPLATES if templates is None else templates, block_bytes)
    rivals = _rivals(blocks, width, containment)
    kind = docs.schema[doc_id].dataType.simpleString()
    names = [f.name for f in HITS.value_type]
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.expr(f"cast(array() as {HIT})").alias("hits"))
    for k, block in enumerate(blocks):
        shared, last = spark.sparkContext.broadcast(block), k == len(blocks) - 1

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value, width, containment)
            for batch in batches:
                taken, made, every = [], [], []
                for i, (t, hits) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                    found = [tuple(h.values()) for h in hits] + (index.matches(words_of(t)) if t else [])
                    every.append([dict(zip(names, h, strict=True)) for h in set(found)] if not last else [])
                    for hit in _choose(found, rivals) if last else ():
                        taken.append(i)
                        made.append(hit)
                if not last:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(every, HITS)], names=["doc_id", "text", "hits"])
                    continue
                columns = list(zip(*made, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(taken, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.float64()), strict=True))], names=["doc_id", "licence", "first_word", "end_word", "containment"])

        rows = rows.mapInArrow(run, f"doc_id {kind}, licence string, first_word int, end_word int, containment double" if last else f"doc_id {kind}, text string, hits {HIT}")
    return rows
