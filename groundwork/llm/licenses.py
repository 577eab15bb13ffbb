"""License scan over a positional index of rare licence words."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import appended

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")

#: The phrases that count in any place, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Template:
    """A licence notice: its label, its wording, and the phrases that must all stand in the matched place."""

    label: str
    text: str
    required: tuple[str, ...] = field(default=())


MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the
software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or
substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether
in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""
ISC = """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this
permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use
data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""
BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of
source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright
notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
ZLIB = """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following
restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an
acknowledgment in the product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as
being the original software 3 this notice may not be removed or altered from any source distribution"""
UNLICENSE = """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in
source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""
APACHE = """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without
warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"""
GPL = """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation
either version {0} of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the
implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"""

#: The public wording of common licences, and short notices of them.
TEMPLATES = (
    Template("mit", MIT, ("permission is hereby granted free of charge", "without warranty of any kind")),
    Template("isc", ISC, ("for any purpose with or without fee", "disclaims all warranties")),
    Template("bsd", BSD, ("redistribution and use in source and binary forms", "in binary form must reproduce")),
    Template("zlib", ZLIB, ("must not be misrepresented", "altered source versions")),
    Template("unlicense", UNLICENSE, ("free and unencumbered software",)),
    Template("apache-2", APACHE, ("apache license version 2", "in compliance with the license")),
    Template("gpl-3", GPL.format(3), ("gnu general public license", "either version 3 of the license")),
    Template("gpl-2", GPL.format(2), ("gnu general public license", "either version 2 of the license")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    Template("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("in compliance with the license",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    Template("cc-by-nc", "this work is licensed under cc by nc", ("cc by nc",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("public domain dedication",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    Template("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)


def words_of(text: str | bytes | None) -> list[bytes]:
    """Lower-cases A-Z only and splits at ASCII characters that are neither digits nor letters (null: no words)."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return _WORDS.findall(data.lower())


class Index:
    """Postings (template, position) of the templates' words that few documents have, and the phrases' first words.

    A word that stands in over ``common`` of all documents is in no posting, unless the template has fewer than two others; then its two rarest are.
    """

    def __init__(self, templates: tuple[Template, ...], phrases: dict[str, str], found_in: dict[bytes, int], n_docs: int, common: float):
        self.idf = {w: math.log((n_docs + 1) / (n + 1)) for w, n in found_in.items()}
        self.most = math.log(n_docs + 1)  # of a word that no document has
        self.templates, self.wording = templates, [words_of(t.text) for t in templates]
        self.required = [[words_of(p) for p in t.required] for t in templates]
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.need, self.slack = [], [max(2, len(w) // 10) for w in self.wording]
        for k, wording in enumerate(self.wording):
            ranked = sorted(dict.fromkeys(wording), key=lambda w: (-self.idf.get(w, self.most), w))
            rare = [w for w in ranked if found_in.get(w, 0) <= common * n_docs]
            rare = set(rare if len(rare) >= 2 else ranked[:2])
            self.need.append(min(3, math.ceil(len(rare) / 2)))
            for at, w in enumerate(wording):
                if w in rare:
                    self.postings[w].append((k, at))
        self.starts = {p[0] for p, _ in self.phrases}
        self.watched = frozenset(self.postings) | self.starts

    def scan(self, words: list[bytes], enough: float) -> tuple[list[int], set[str], set[str], float]:
        """Starts of base phrases, base labels, all labels, best score."""
        if self.watched.isdisjoint(words):
            return [], set(), set(), 0.0
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in self.watched:
                places[w].append(i)
        starts, base = [], set()
        for phrase, label in self.phrases:
            found = [i for i in places.get(phrase[0], ()) if words[i : i + len(phrase)] == phrase]
            starts += found
            base |= {label} if found else set()
        votes: dict[tuple[int, int], set[bytes]] = defaultdict(set)
        for w in sorted(places, key=lambda w: (-self.idf.get(w, self.most), w)):  # the file's own rarest licence words first
            for k, at in self.postings.get(w, ()):
                for i in places[w]:
                    votes[k, i - at].add(w)
        labels, best = set(base), 1.0 if base else 0.0
        for k, shift in votes:
            score = self._verified(words, votes, k, shift)
            if score >= enough:
                labels.add(self.templates[k].label)
                best = max(best, score)
        return sorted(starts), base, labels, best

    def _verified(self, words: list[bytes], votes: dict[tuple[int, int], set[bytes]], k: int, shift: int) -> float:
        """The share of the template's words that stand at this place, or 0 if too few rare ones agree on it or a mandatory phrase is missing."""
        slack, wording, hits = self.slack[k], self.wording[k], set()
        for d in range(-slack, slack + 1):
            hits |= votes.get((k, shift + d), set())
        if len(hits) < self.need[k]:
            return 0.0
        window = words[max(0, shift - slack) : max(0, shift + len(wording) + slack)]
        if not all(any(window[j : j + len(p)] == p for j in range(len(window))) for p in self.required[k]):
            return 0.0
        return sum((Counter(wording) & Counter(window)).values()) / len(wording)


def licence_word_counts(docs: DataFrame, templates: tuple[Template, ...]) -> tuple[dict[bytes, int], int]:
    """In how many of all documents each template word stands. The result has one row per template word, whatever the corpus."""
    vocabulary = frozenset(w for t in templates for w in words_of(t.text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = Counter(), 0
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                found.update(vocabulary.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array([None, *found], pa.binary()), pa.array([n, *found.values()], pa.int64())], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {None if r.word is None else bytes(r.word): r.n for r in rows}
    return counts, counts.pop(None, 0)


def scan_licenses(
    docs: DataFrame, *, templates: tuple[Template, ...] = TEMPLATES, phrases: dict[str, str] | None = None, common: float = 0.1, enough: float = 0.6, key: str = "doc_id"
) -> DataFrame:
    """Licence labels of every whole text, with the places of the base phrases.

    A first pass counts in how many documents each licence word stands. The index holds the places in the templates of words that at most ``common`` of all documents have. A
    text's licence words are looked up, those of highest IDF first; each of their places votes for (template, relative position), positions within a tenth of the template's length
    (two words at least) count together, and where three rare words agree (or half of the template's, if it has fewer than six) the place is verified: the mandatory phrases must
    stand there and ``enough`` of the template's words. There is no cap on words or places. Base phrases are matched word by word.

    Null or empty text: no words, no labels, score 0. Repeated rows, null keys and other columns change nothing. No rows: no rows.
    """
    phrases = PHRASES if phrases is None else phrases
    found_in, n_docs = licence_word_counts(docs, templates)
    index = Index(templates, phrases, found_in, n_docs, common)  # as large as the templates

    def scan(texts: list) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
        for text in texts:
            words = words_of(text)
            starts, base, labels, score = index.scan(words, enough)
            row = (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score)
            for values, value in zip(out.values(), row):
                values.append(value)
        return out

    schema = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return appended(docs.select(F.col(key).alias("_key"), "text"), "text", scan, schema, binary=True).withColumnRenamed("_key", key)
