"""License scan: exact containment join of text blocks with license templates (operator 5).

Two sources of labels. Phrases: every place where the words of a phrase stand one after the other.
Templates: an exact set-similarity join. A template is the set of its words, and some of them can be named as those that it
does not go without, such as `mit` in a notice of five words. A template of n words is held against blocks of 2n words
that start every n words, so that every run of n words lies within one block. A block matches if it holds at least
`threshold` of the template's distinct words and all that are named.

The words of all templates are ordered by how many documents of the
corpus have them, rarest first, counted over all documents. Filters, in this order, each lossless:
prefix: a block is a candidate only if it has one of the template's |T| - need + 1 rarest words (need = threshold |T|, rounded up);
length: it has at least `need` distinct words of any template;
positional: from its rarest shared prefix word on, both the template and the block still have `need` words in the order.
What is left is verified by counting.

Templates and phrases are few and bounded (checked), so they travel with the task; the corpus is
never shuffled, only one count for each template word and batch is.

Defined results: a null or empty text has no words and no labels; equal rows give equal rows; a very long text is one chunk and
needs memory in proportion; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from .common import in_arrow

PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Public license texts and notices by label, with the words that a notice does not go without.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ()),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ()),
    ("mit", "Released under the MIT License.", ("mit", "license")),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", ("apache",)),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", ("apache",)),
    ("apache-2", "Licensed under the Apache License, Version 2.0.", ("apache", "2")),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc", "nc")),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("commons", "noncommercial")),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("commons", "sharealike")),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ("gnu", "3")),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", ("gnu",)),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("gnu",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ()),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ("fee",)),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", ()),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ("unencumbered",)),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ("mozilla",)),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla",)),
    ("all-rights-reserved", "Copyright. All rights reserved. No part of this work may be reproduced without permission.", ("rights", "reserved", "reproduced")),
)
FILTERS = ("prefix", "length", "positional", "verified")
MOST_TEMPLATE_WORDS = 100_000


def _word_hashes(text: str) -> np.ndarray:
    chunk = next(B.chunks(pa.array([text], pa.string())))
    return B.words(chunk, B.WORDLIKE, lower=True).hash


@dataclass
class Templates:
    """Templates over numbered words."""

    labels: list[str]
    words: np.ndarray  # hash of each numbered word
    sets: list[np.ndarray]  # numbers of each template's distinct words
    sizes: list[int]  # words of each template, repeated ones too
    needed: list[np.ndarray]  # numbers of the words it does not go without
    phrases: list[tuple[np.ndarray, str]]

    @classmethod
    def of(cls, templates=TEMPLATES, phrases=PHRASES) -> Templates:
        hashes, needed = [_word_hashes(t) for _, t, _ in templates], [_word_hashes(" ".join(n)) for _, _, n in templates]
        ordered = [(_word_hashes(p), label) for p, label in phrases]
        words = np.unique(np.concatenate(hashes + needed + [h for h, _ in ordered]))
        if len(words) > MOST_TEMPLATE_WORDS:
            raise ValueError(f"templates have {len(words)} distinct words; they are sent to every task and may have {MOST_TEMPLATE_WORDS}")
        number = lambda h: np.searchsorted(words, h)
        return cls([label for label, _, _ in templates], words, [np.unique(number(h)) for h in hashes], list(map(len, hashes)), [number(h) for h in needed], [(number(h), label) for h, label in ordered])


@dataclass
class Join:
    """One template over words numbered by their rank in the global order, rarest first."""

    label: str
    size: int  # words of the template: blocks are twice as long and start this far apart
    ranks: np.ndarray  # of its distinct words, ascending
    needed: np.ndarray
    need: int

    def matches(self, rank: np.ndarray, place: np.ndarray, row: np.ndarray, vocabulary: int, seen: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, numbers of blocks and shared words of all matches; given the template words of many rows in order, by rank, place in their row and row.

        `seen` counts the pairs of block and template that each filter leaves."""
        step = self.size
        prefix, member, named = (np.zeros(vocabulary, bool) for _ in range(3))
        prefix[self.ranks[: len(self.ranks) - self.need + 1]] = member[self.ranks] = named[self.needed] = True
        hit = np.flatnonzero(prefix[rank])
        block = place[hit] // step
        blocks = np.unique(np.concatenate((row[hit] << 32 | block, (row[hit] << 32 | block - 1)[block > 0])))
        seen["prefix"] += len(blocks)
        at = row << 32 | place  # ascending
        low = np.searchsorted(at, (blocks >> 32 << 32) | (blocks & 0xFFFFFFFF) * step)
        high = np.searchsorted(at, (blocks >> 32 << 32) | ((blocks & 0xFFFFFFFF) * step + 2 * step))
        count = high - low
        inside = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
        pair = np.unique(np.repeat(np.arange(len(blocks)), count) * vocabulary + rank[inside])  # each word of a block once, rarest first
        block, word = pair // vocabulary, pair % vocabulary
        held = np.bincount(block, minlength=len(blocks))
        begins = np.cumsum(held) - held
        enough = held >= self.need
        seen["length"] += int(enough.sum())
        in_prefix = np.flatnonzero(prefix[word])
        first = np.full(len(blocks), len(word) - 1, np.int64)
        np.minimum.at(first, block[in_prefix], in_prefix)  # the rarest shared word of each block
        rest_of_block = held - (first - begins)
        rest_of_template = len(self.ranks) - np.searchsorted(self.ranks, word[first])
        enough &= np.minimum(rest_of_block, rest_of_template) >= self.need
        seen["positional"] += int(enough.sum())
        some = enough[block]
        block, word = block[some], word[some]
        shared, with_name = np.bincount(block[member[word]], minlength=len(blocks)), np.bincount(block[named[word]], minlength=len(blocks))
        found = np.flatnonzero((shared >= self.need) & (with_name == len(self.needed)))
        seen["verified"] += len(found)
        return blocks[found] >> 32, blocks[found] & 0xFFFFFFFF, shared[found]


def joins(t: Templates, counts: np.ndarray, threshold: float) -> tuple[list[Join], np.ndarray]:
    """The join of each template, and the rank of each numbered word."""
    order = np.lexsort((t.words, counts))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return [Join(label, size, np.sort(rank[words]), np.unique(rank[needed]), max(1, math.ceil(threshold * len(words) - 1e-9))) for label, size, words, needed in zip(t.labels, t.sizes, t.sets, t.needed, strict=True)], rank


def document_counts(docs: DataFrame, templates: Templates, text_col: str = "text") -> np.ndarray:
    """For each template word the number of documents of the whole corpus that have it."""
    index = B.HashIndex(templates.words)
    size = len(templates.words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(size, np.int64)
        for chunk in B.chunks(batch.column(0)):
            w = B.words(chunk, B.WORDLIKE, lower=True)
            number = index.get(w.hash)
            has = number >= 0
            pair = np.unique(w.row[has] * size + number[has])
            total += np.bincount(pair % size, minlength=size)
        some = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    got = in_arrow(docs.select(F.col(f"`{text_col}`").cast("string")), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for r in got:  # one row for each template word at most
        out[r["word"]] = r["n"]
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: Templates | None = None, threshold: float = 0.8) -> DataFrame:
    """For each document its number of words, its phrase spans, its matching blocks, and the labels of both.

    spans: array of (label, first_word, words); blocks: array of (label, first_word, containment)."""
    t = templates or Templates.of()
    plans, ranks = joins(t, document_counts(docs, t, text_col), threshold)
    index = B.HashIndex(t.words)
    kind = docs.schema[id_col].dataType.simpleString()

    def phrase_places(number: np.ndarray, w: B.Words, phrase: np.ndarray) -> np.ndarray:
        n, k = len(number), len(phrase)
        if n < k or k == 0:
            return np.zeros(0, np.int64)
        ok = number[: n - k + 1] == phrase[0]
        for j in range(1, k):
            ok &= number[j : n - k + 1 + j] == phrase[j]
        ok &= w.row[: n - k + 1] == w.row[k - 1 :]
        return np.flatnonzero(ok)

    def block_matches(number: np.ndarray, w: B.Words) -> list[tuple[int, str, int, float]]:
        at = np.flatnonzero(number >= 0)
        rank, row, seen = ranks[number[at]], w.row[at], dict.fromkeys(FILTERS, 0)
        place = at - w.first[row]
        return [(int(r), j.label, int(b) * j.size, float(n / len(j.ranks))) for j in plans for r, b, n in zip(*j.matches(rank, place, row, len(ranks), seen), strict=True)] if len(at) else []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, spans, blocks = [], [], []
        for chunk in B.chunks(batch.column(1)):
            w = B.words(chunk, B.WORDLIKE, lower=True)
            number = index.get(w.hash)
            n_words.append(np.diff(w.first))
            s, b = [[] for _ in range(chunk.rows)], [[] for _ in range(chunk.rows)]
            for phrase, label in t.phrases:
                for i in phrase_places(number, w, phrase).tolist():
                    r = int(w.row[i])
                    s[r].append({"label": label, "first_word": int(i - w.first[r]), "words": len(phrase)})
            for r, label, first, value in block_matches(number, w):
                b[r].append({"label": label, "first_word": first, "containment": value})
            spans += s
            blocks += b
        span = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64())]))
        block = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("containment", pa.float64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_words)), pa.array(spans, span), pa.array(blocks, block)], [id_col, "n_words", "spans", "blocks"])

    schema = f"`{id_col}` {kind}, n_words long, spans array<struct<label string, first_word long, words long>>, blocks array<struct<label string, first_word long, containment double>>"
    return in_arrow(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")), run, schema)
