"""Finding licence notices by an exact set-similarity join of texts and templates.

Text blocks are runs of words; a template is found in a block that holds at least a
threshold's share of its distinct words. The join is by prefix: the words of the
templates are ordered by their frequency in all documents, and a block that meets the
threshold holds one of a template's rarest words. Such a hit is taken further if the
block has enough words (length filter) and the template enough words from that one on
(positional filter), and then verified. Phrases are templates whose words must all be
there, and one after another. A few common words in any order say nothing, so short wordings
are looked for by their rarest word, and their words must stand in order and close together.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fleetlens.llm import common

# Phrases whose words must stand one after another, and notices that
# licences ask to be put into a work.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
TEMPLATES = {
    "apache": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is"
        " distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
        " and associated documentation files",
        # The whole licence.
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
        " to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above"
        " copyright notice and this permission notice shall be included in all copies or substantial portions of the"
        " Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT"
        " LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT"
        " SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION"
        " OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER"
        " DEALINGS IN THE SOFTWARE.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted"
        " provided that the following conditions are met",
        # The whole licence of two clauses, and the third clause.
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met: Redistributions of source code must retain the above copyright notice, this list"
        " of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright"
        " notice, this list of conditions and the following disclaimer in the documentation and/or other materials"
        " provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY"
        " EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND"
        " FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE"
        " FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED"
        " TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER"
        " CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR"
        " OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public"
        " License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
        " warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "mpl": [
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
}
# Short wordings, whose words must stand in order and next to each other, but for a word in four.
WORDINGS = {
    "apache": [
        "the Apache License", "under the Apache License", "under an Apache License", "Apache License version 2",
        "Apache License 2 0", "under Apache 2 0", "Apache 2 0 License", "SPDX License Identifier Apache", "License Apache 2 0",
    ],
    "mit": [
        "the MIT License", "under the MIT License", "under an MIT License", "under MIT License", "SPDX License Identifier MIT",
        "License MIT",
    ],
    "bsd": [
        "the BSD License", "under the BSD License", "under a BSD License", "under BSD License", "BSD 2 clause", "BSD 3 clause",
        "SPDX License Identifier BSD",
    ],
    "gpl": [
        "under the GNU General Public License", "under the GNU GPL", "under the terms of the GPL", "the GNU GPL",
        "GNU GPL version", "GPL 2 0", "GPL 3 0", "GPL version 2", "GPL version 3", "GPLv2", "GPLv3", "SPDX License Identifier GPL",
    ],
    "mpl": ["Mozilla Public License", "MPL 2 0", "SPDX License Identifier MPL"],
    "cc": ["a Creative Commons License", "Creative Commons Attribution", "SPDX License Identifier CC"],
}

# Whole licences, word for word; find_licenses cuts them into parts.
for _label, _file in (("apache", "Apache-2.0"), ("gpl", "GPL-2"), ("gpl", "GPL-3"), ("mpl", "MPL-2.0")):
    TEMPLATES[_label].append((Path(__file__).parent / "license_texts" / f"{_file}.txt").read_text(encoding="utf-8"))

#: Every byte that is no word byte becomes a space, A-Z lower case; bytes beyond ASCII are word bytes.
_WORDS = bytes(
    b if chr(b).isdigit() or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    """The text's runs of letters and digits, A-Z in lower case; any character beyond ASCII is a letter."""
    return text.encode().translate(_WORDS).split()


def parts_of(words: list[bytes], most: int) -> list[list[bytes]]:
    """The words in nearly equal parts of at most ``most``."""
    n = max(1, -(-len(words) // most))
    edges = [len(words) * i // n for i in range(n + 1)]
    return [words[a:b] for a, b in zip(edges, edges[1:])]


def word_counts(docs: DataFrame, vocabulary: Sequence[bytes]) -> dict[bytes, int]:
    """How often each word of the fixed ``vocabulary`` stands in all documents."""
    wanted = frozenset(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(filter(wanted.__contains__, words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"]
        )

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    totals = texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in totals.collect()}  # at most the vocabulary


def spellings(words: list[bytes]) -> list[list[bytes]]:
    """A wording as it is spelled in America and in England."""
    other = [w.replace(b"licens", b"licenc") for w in words]
    return [words] if other == words else [words, other]


PHRASE, TEMPLATE, WORDING = range(3)


class Finder:
    """Templates, phrases and wordings, indexed by the rarest words of each."""

    def __init__(
        self,
        templates: Sequence[tuple[str, list[bytes]]],
        phrases: Sequence[tuple[str, list[bytes]]],
        counts: Mapping[bytes, int],
        threshold: float,
        block_words: int,
        wordings: Sequence[tuple[str, list[bytes]]] = (),
    ):
        self.block, self.step = block_words, block_words // 2
        self.sets: list[list[tuple]] = [[], [], []]
        self.by_word: dict[bytes, list[tuple[int, int, int]]] = {}
        self.tried = self.verified = 0
        rarity = lambda w: (counts.get(w, 0), w)
        for kind, some in ((PHRASE, phrases), (TEMPLATE, templates), (WORDING, wordings)):
            for label, words in some:
                ordered = sorted(set(words), key=rarity)
                need = math.ceil(threshold * len(ordered) - 1e-9) if kind == TEMPLATE else len(ordered)
                for place, word in enumerate(ordered[: len(ordered) - need + 1]):
                    self.by_word.setdefault(word, []).append((kind, len(self.sets[kind]), place))
                self.sets[kind].append((label, words, ordered, need))
        known = {w for _, _, ordered, _ in self.sets[TEMPLATE] for w in ordered}
        self.rank = {w: i for i, w in enumerate(sorted(known, key=rarity))}

    def places(self, words: list[bytes], at: int, n: int) -> list[tuple[str, int]]:
        """Where the phrase stands around its word at ``at``; of a repeated word, the first place counts."""
        label, phrase, _, _ = self.sets[PHRASE][n]
        first = at - phrase.index(words[at])
        return [(label, first)] if first >= 0 and words[first : first + len(phrase)] == phrase else []

    def wordings(self, words: list[bytes], at: int, n: int) -> Iterator[tuple[str, int, int]]:
        """The closest places of the wording's words, in order, around that at ``at``."""
        label, wording, _, _ = self.sets[WORDING][n]
        most = len(wording) + len(wording) // 4
        low, high = max(0, at - most + 1), min(len(words), at + most)
        for j, word in enumerate(wording):
            if word != words[at]:
                continue
            first = last = at
            for w in reversed(wording[:j]):
                first = next((i for i in range(first - 1, low - 1, -1) if words[i] == w), -1)
                if first < 0:
                    break
            for w in wording[j + 1 :] if first >= 0 else ():
                last = next((i for i in range(last + 1, high) if words[i] == w), -1)
                if last < 0:
                    break
            if first >= 0 and last >= 0 and last - first < most:
                yield label, first, last + 1

    def find(self, text: str) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, float]], list[tuple[str, int, int]]]:
        """Number of words, places of phrases, blocks with the share of a template that they hold, and wordings."""
        words = words_of(text)
        places, found, tried = [], set(), {}
        for at in [i for i, w in enumerate(words) if w in self.by_word]:
            for kind, n, place in self.by_word[words[at]]:
                if kind == PHRASE:
                    places += self.places(words, at, n)
                elif kind == WORDING:
                    found.update(self.wordings(words, at, n))
                else:
                    for b in {max(0, at // self.step - 1), at // self.step}:
                        tried.setdefault((b, n), set()).add(place)
        blocks, ranks = [], {}
        for (b, n), hit in sorted(tried.items()):
            label, _, template, need = self.sets[TEMPLATE][n]
            start, end = b * self.step, min(b * self.step + self.block, len(words))
            self.tried += 1
            if end - start < need:
                continue  # length filter
            if b not in ranks:
                ranks[b] = sorted({self.rank[w] for w in words[start:end] if w in self.rank})
            # Positional filter: up to the last hit all shared words are known; each side has so many words from there on.
            last = max(hit)
            later = len(ranks[b]) - bisect_right(ranks[b], self.rank[template[last]])
            if len(hit) + min(len(template) - last - 1, later) < need:
                continue
            self.verified += 1
            shared = len({self.rank[w] for w in template}.intersection(ranks[b]))
            if shared >= need:
                blocks.append((label, start, end, shared / len(template)))
        return len(words), sorted(set(places), key=lambda p: (p[1], p[0])), blocks, sorted(found, key=lambda p: (p[1:], p[0]))


_WORDING = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_PLACE = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
_BLOCK = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))


def find_licenses(
    docs: DataFrame,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    threshold: float = 0.9,
    block_words: int = 64,
    wordings: Mapping[str, Sequence[str]] = WORDINGS,
) -> DataFrame:
    """``doc_id, n_words, places, blocks, wordings`` of every row of ``docs``, whole texts.

    ``places``: label and first word of each place where a phrase stands, words
    counted from 0. ``blocks``: label, words ``start`` to ``end`` (exclusive) and
    containment of each text block that holds at least ``threshold`` of a
    template's distinct words. Blocks are ``block_words`` long and start every
    half of that; templates of more words than half a block are cut into parts
    that are templates of their own, so a notice or part always lies within a
    block. ``wordings``: label, first word and end of each short wording, in American or English spelling, whose
    words stand in order with at most one other word to every four of them. A null text is an empty
    one and has neither. Repeated and null ids are kept; columns other than
    ``doc_id`` and ``text`` are not looked at. Two passes over ``docs``: the
    words' frequencies order the index, and never change what is found.
    """
    split = [
        (label, part)
        for label, texts in templates.items()
        for t in texts
        for part in parts_of(words_of(t), max(1, block_words // 2))
    ]
    exact = [(label, words_of(p)) for label, p in phrases.items()]
    short = [(label, spelled) for label, texts in wordings.items() for t in texts for spelled in spellings(words_of(t))]
    if not all(words for _, words in split + exact + short):
        raise ValueError("a template needs words")
    counts = word_counts(docs, sorted({w for _, words in split + exact + short for w in words}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(split, exact, counts, threshold, block_words, short)
        for ids, texts in common.portions(batches):
            found = [finder.find(t) for t in texts]
            places = [[{"label": a, "start": s} for a, s in f[1]] for f in found]
            blocks = [[{"label": a, "start": s, "end": e, "containment": c} for a, s, e, c in f[2]] for f in found]
            worded = [[{"label": a, "start": s, "end": e} for a, s, e in f[3]] for f in found]
            counted = pa.array([f[0] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, counted, pa.array(places, _PLACE), pa.array(blocks, _BLOCK), pa.array(worded, _WORDING)],
                ["doc_id", "n_words", "places", "blocks", "wordings"],
            )

    texts = common.id_and_text(docs)
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(
        run,
        f"doc_id {kind}, n_words long, places array<struct<label string, start long>>, "
        "blocks array<struct<label string, start long, end long, containment double>>, "
        "wordings array<struct<label string, start long, end long>>",
    )


def license_report(found: DataFrame) -> DataFrame:
    """One row per document: counts, first and last place, labels, and the highest containment as ``score``.

    A place of a phrase or wording counts as containment 1; a document with nothing found scores 0.
    """
    starts, held = F.col("places.start"), F.col("blocks.containment")
    base = F.array_distinct(F.col("places.label"))
    every = F.array_union(F.array_union(F.col("places.label"), F.col("blocks.label")), F.col("wordings.label"))
    exact = (F.size("places") > 0) | (F.size("wordings") > 0)
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(exact, 1.0).otherwise(F.coalesce(F.array_max(held), F.lit(0.0))).alias("score"),
    )
