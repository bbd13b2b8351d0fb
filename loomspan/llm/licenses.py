"""License scans over a positional rare-token index of licence templates."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import table

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates of licence texts, a paragraph each: label, wording, and the key phrases without which it does not count.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ["apache license version 2 0"],
    ),
    (
        "apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ["unless required by applicable law", "as is basis"],
    ),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    (
        "mit",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
        ["to deal in the software without restriction"],
    ),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["permission notice shall be included"]),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ["with or without fee is hereby granted", "appear in all copies"],
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    (
        "bsd",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ["redistributions in binary form must reproduce"],
    ),
    (
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ["endorse or promote products derived from this software"],
    ),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["general public license version 2"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["general public license version 3"]),
    ("gpl-family", "you can redistribute it and or modify it under the terms of the gnu general public license", ["redistribute it", "general public license"]),
    (
        "gpl-family",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ["free software foundation", "general public license"],
    ),
    (
        "gpl-family",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        ["in the hope that it will be useful", "gnu general public license"],
    ),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    (
        "mpl-2.0",
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        ["copy of the mpl was not distributed"],
    ),
    ("cc-by-family", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0", "to the extent possible under law the author has dedicated all copyright to the public domain", ["public domain"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    (
        "unlicense",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ["anyone is free to copy modify publish use compile sell"],
    ),
    ("copyright", "copyright c all rights reserved", ["all rights reserved"]),
]

#: A template's words may stand so many places off; this share of them, weighed by IDF, must be there; its anchors weigh at least this share.
SLACK, LEAST_SHARE, ANCHOR_SHARE = 3, 0.8, 0.5

#: Of bytes: A-Z to a-z; what is neither letter, digit nor beyond ASCII to a blank.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """The maximal runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    key_phrases: tuple[tuple[bytes, ...], ...]
    base: bool


def all_templates() -> list[Template]:
    base = [Template(label, tuple(words_of(phrase)), (tuple(words_of(phrase)),), True) for phrase, label in BASE.items()]
    more = [Template(label, tuple(words_of(text)), tuple(tuple(words_of(k)) for k in keys), False) for label, text, keys in TEMPLATES]
    return base + more


class RareTokenIndex:
    """Positional postings of the rarest words of each template.

    ``frequency`` has the number of documents that hold each licence word,
    ``documents`` how many there are. A template's anchors are its words of
    highest IDF, as many as make up ANCHOR_SHARE of its weight (of a base
    phrase all words, as all must stand).
    """

    def __init__(self, templates: list[Template], frequency: dict[bytes, int], documents: int):
        self.templates = templates
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 1.0 for t in templates for w in t.words}
        self.weight = [sum(self.idf[w] for w in t.words) for t in templates]
        #: For each template: (word, position) of its anchors, rarest first; what they must weigh; how many of them a place must start from.
        self.postings: list[list[tuple[bytes, int]]] = []
        self.need: list[float] = []
        self.start: list[int] = []
        for t, total in zip(templates, self.weight, strict=True):
            ranked = sorted(((w, at) for at, w in enumerate(t.words)), key=lambda x: (-self.idf[x[0]], x[0], x[1]))
            chosen, have = [], 0.0
            for word, at in ranked:
                if not t.base and have >= ANCHOR_SHARE * total:
                    break
                chosen.append((word, at))
                have += self.idf[word]
            # Where LEAST_SHARE of all words stand, no more than the rest of the weight is missing, from the anchors too.
            need = have - (0.0 if t.base else (1 - LEAST_SHARE) * total)
            start, rest = 0, have
            while start < len(chosen) and rest >= need - 1e-9:
                rest -= self.idf[chosen[start][0]]
                start += 1
            self.postings.append(chosen)
            self.need.append(need - 1e-9)
            self.start.append(start)
        self.anchors = frozenset(w for chosen in self.postings for w, _ in chosen)

    def places(self, n: int, at: dict[bytes, list[int]]) -> list[int]:
        """Where template ``n`` may stand, from the positions of anchor words in a text.

        A hit at p of a word at q in the template is a posting at p - q. Postings
        of the rarest anchors, without one of which the others weigh too little,
        name places; the lists of all anchors are intersected there, a word
        counting if it stands within SLACK of its place.
        """
        chosen, slack = self.postings[n], 0 if self.templates[n].base else SLACK
        lists = [[p - q for p in at.get(word, ())] for word, q in chosen]
        named = {o + k for found in lists[: self.start[n]] for o in found for k in range(-slack, slack + 1)}
        if not named:
            return []
        out = []
        for o in sorted(named):
            held = 0.0
            for (word, _), found in zip(chosen, lists, strict=True):
                k = bisect_left(found, o - slack)
                if k < len(found) and found[k] <= o + slack:
                    held += self.idf[word]
            if held >= self.need[n]:
                out.append(o)
        return out

    def share(self, n: int, words: list[bytes], o: int) -> float:
        """The IDF-weighted share of template ``n`` at a place; 0 without all its key phrases near by."""
        t = self.templates[n]
        first = max(0, o - SLACK)
        near = words[first : max(0, o + len(t.words) + SLACK)]
        if not all(_holds(near, key) for key in t.key_phrases):
            return 0.0
        there = lambda i, w: w in near[max(0, o + i - SLACK - first) : max(0, o + i + SLACK + 1 - first)]
        return sum(self.idf[w] for i, w in enumerate(t.words) if there(i, w)) / self.weight[n]

    def scan(self, words: list[bytes]) -> tuple[dict[int, list[int]], dict[int, float]]:
        """Places of each base phrase, and the best share of each other template that counts."""
        at: dict[bytes, list[int]] = defaultdict(list)
        for p, word in enumerate(words):
            if word in self.anchors:
                at[word].append(p)
        places: dict[int, list[int]] = {}
        shares: dict[int, float] = {}
        for n, t in enumerate(self.templates):
            found = self.places(n, at)
            if t.base:
                if exact := [o for o in found if o >= 0 and tuple(words[o : o + len(t.words)]) == t.words]:
                    places[n] = exact
            elif found and (best := max(self.share(n, words, o) for o in found)) >= LEAST_SHARE:
                shares[n] = best
        return places, shares


def _holds(words: list[bytes], phrase: tuple[bytes, ...]) -> bool:
    size = len(phrase)
    return any(words[i] == phrase[0] and tuple(words[i : i + size]) == phrase for i in range(len(words) - size + 1))


def _batches(batch: pa.RecordBatch, rows: int = 256) -> Iterator[list[str | None]]:
    """A batch's texts, a few rows at a time, so that long texts need little memory."""
    for at in range(0, batch.num_rows, rows):
        yield batch.column("text").slice(at, rows).to_pylist()


def document_frequency(docs: DataFrame, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many rows each licence word stands, over all rows; and how many rows there are.

    The words are those of the templates, so what reaches the driver is bounded.
    """
    vocabulary = frozenset(w for t in all_templates() for w in t.words)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = defaultdict(int)
        rows = 0
        for batch in batches:
            for texts in _batches(batch):
                for text in texts:
                    rows += 1
                    for word in vocabulary.intersection(words_of(text)):
                        seen[word] += 1
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in seen] + [""], "n": pa.array([*seen.values(), rows], pa.int64())})

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n bigint")
    totals = {r["word"]: r["total"] for r in found.groupBy("word").agg(F.sum("n").alias("total")).collect()}
    rows = totals.pop("", 0)
    return {w.encode(): n for w, n in totals.items()}, rows


RESULT = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds licence notices in whole texts.

    One pass counts in how many rows each licence word stands and so picks each
    template's rarest words; a second looks these up, intersects their postings
    by relative position and verifies key phrases and the weighted share of all
    words. Both are map-only but for the sum of a few hundred counts. A template
    of which LEAST_SHARE stands is always found: its anchors then weigh enough.

    Returns one row per input row: the id; ``n_words``; ``n_base``, the places
    of base phrases; ``first_word`` and ``last_word``, their smallest and
    largest start (null if none); ``base_labels``; ``labels``, those and the
    other templates' (distinct, sorted, comma-joined; empty if none); and
    ``score``: 1 for a base phrase, else the largest IDF-weighted share of a
    template that is there, else 0. Null text counts as empty; empty texts have
    no words. Repeated rows give repeated rows; other input columns are not
    read; an empty table gives an empty result.
    """
    frequency, rows = document_frequency(docs, text_col)
    index = RareTokenIndex(all_templates(), frequency, rows)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for texts in _batches(batch):
                for text in texts:
                    words = words_of(text)
                    if index.anchors.isdisjoint(words):
                        out.append((len(words), 0, None, None, "", "", 0.0))
                        continue
                    places, shares = index.scan(words)
                    starts = [at for found in places.values() for at in found]
                    base = {index.templates[n].label for n in places}
                    labels = base | {index.templates[n].label for n in shares}
                    score = 1.0 if places else min(1.0, max(shares.values(), default=0.0))
                    out.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            arrays = [batch.column(id_col)] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, *(c.split()[0] for c in RESULT.split(", "))])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(scan, f"`{id_col}` {kind}, {RESULT}")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
