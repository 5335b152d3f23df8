"""License scan: a positional index of rare license words, and mandatory key phrases."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import words

#: Phrases that are reported wherever they stand, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices by label: a template, and the phrases without which it isn't that license.
TEMPLATES = {
    "apache-2.0": [
        ("licensed under the apache license version 2 0", ["apache license", "2 0"]),
        ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses"]),
        ("apache license version 2 0 january 2004", ["apache license", "2 0"]),
    ],
    "mit": [
        ("released under the mit license", ["mit license"]),
        ("licensed under the mit license", ["mit license"]),
        (
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights "
            "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
            ["hereby granted free of charge", "person obtaining a copy"],
        ),
        ("permission is hereby granted free of charge to any person obtaining a copy of this software", ["hereby granted free of charge", "person obtaining a copy"]),
        ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["permission notice shall be included"]),
    ],
    "bsd": [
        ("redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms"]),
        ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form"]),
        ("released under the bsd license", ["bsd license"]),
        ("licensed under the bsd 3 clause license", ["bsd 3 clause"]),
        ("licensed under the bsd 2 clause license", ["bsd 2 clause"]),
    ],
    "gpl-3.0": [
        ("this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
        ("gnu general public license version 3", ["gnu general public license", "version 3"]),
        ("under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license", "version 3"]),
    ],
    "gpl-2.0": [
        ("this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
        ("gnu general public license version 2", ["gnu general public license", "version 2"]),
        ("under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license", "version 2"]),
    ],
    "lgpl": [
        ("licensed under the gnu lesser general public license", ["lesser general public license"]),
        ("under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ],
    "agpl-3.0": [
        ("licensed under the gnu affero general public license version 3", ["affero general public license"]),
        ("under the terms of the gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    ],
    "mpl-2.0": [
        ("subject to the terms of the mozilla public license version 2 0", ["mozilla public license"]),
        ("licensed under the mozilla public license version 2 0", ["mozilla public license"]),
    ],
    "epl-2.0": [("made available under the terms of the eclipse public license 2 0", ["eclipse public license"])],
    "cc-by-4.0": [
        ("licensed under cc by 4 0", ["cc by 4 0"]),
        ("creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
        ("licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ],
    "cc-by-sa-4.0": [("licensed under cc by sa 4 0", ["cc by sa"]), ("creative commons attribution sharealike 4 0 international license", ["attribution sharealike 4 0"])],
    "cc-by-nc-4.0": [("licensed under cc by nc 4 0", ["cc by nc"]), ("creative commons attribution noncommercial 4 0 international license", ["attribution noncommercial 4 0"])],
    "cc0-1.0": [
        ("dedicated to the public domain under cc0 1 0 universal", ["cc0"]),
        ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright"]),
    ],
    "unlicense": [("this is free and unencumbered software released into the public domain", ["unencumbered software"])],
    "isc": [("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"])],
    "zlib": [("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["granted to anyone to use this software"])],
}
#: Parts of the full texts by which a copy without its title is told, and the boilerplate that points to a full text.
PARTS = {
    "apache-2.0": [
        ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["as is basis without warranties or conditions"]),
        ("subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of", ["no charge royalty free irrevocable copyright license"]),
    ],
    "mit": [
        (
            "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
            "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
            ["other dealings in the software"],
        ),
    ],
    "bsd": [
        (
            "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
            ["copyright holders and contributors as is"],
        ),
        ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    ],
    "gpl-3.0": [("the gnu general public license is a free copyleft license for software and other kinds of works", ["free copyleft license"])],
    "gpl-2.0": [("you may copy and distribute verbatim copies of the program s source code as you receive it in any medium provided that you conspicuously and appropriately publish on each copy an appropriate copyright notice and disclaimer of warranty", ["conspicuously and appropriately publish on each copy"])],
    "mpl-2.0": [("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["mozilla org mpl 2 0"])],
    "unlicense": [("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["free to copy modify publish use compile sell or distribute"])],
    "isc": [("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ["author disclaims all warranties with regard to this software"])],
    "zlib": [("the origin of this software must not be misrepresented you must not claim that you wrote the original software", ["must not be misrepresented"])],
}
#: Short identifiers, as they stand after SPDX-License-Identifier, and names by which licences are called in running text.
IDENTIFIERS = {
    "apache-2.0": ["apache 2 0"], "mit": ["mit"], "bsd": ["bsd 2 clause", "bsd 3 clause"], "gpl-3.0": ["gpl 3 0"], "gpl-2.0": ["gpl 2 0"], "lgpl": ["lgpl 2 1", "lgpl 3 0"], "agpl-3.0": ["agpl 3 0"], "mpl-2.0": ["mpl 2 0"], "epl-2.0": ["epl 2 0"],
    "cc-by-4.0": ["cc by 4 0"], "cc-by-sa-4.0": ["cc by sa 4 0"], "cc-by-nc-4.0": ["cc by nc 4 0"], "cc0-1.0": ["cc0 1 0"], "unlicense": ["unlicense"], "isc": ["isc"], "zlib": ["zlib"],
}
NAMES = {
    "apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license"], "mit": ["mit license"], "bsd": ["bsd license", "bsd 2 clause license", "bsd 3 clause license"], "gpl-3.0": ["gnu gpl version 3", "gnu gpl v3", "gpl version 3"],
    "gpl-2.0": ["gnu gpl version 2", "gnu gpl v2", "gpl version 2"], "lgpl": ["gnu lgpl", "lesser general public license"], "agpl-3.0": ["gnu agpl", "affero general public license"], "mpl-2.0": ["mozilla public license"], "epl-2.0": ["eclipse public license"], "isc": ["isc license"], "zlib": ["zlib license"],
}
#: So large a part of a template's words must stand in its order, each at most DRIFT words from where the others put it.
COVER, DRIFT = 0.75, 6


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words are runs of 0-9, a-z and whatever is not ASCII."""
    return text.translate(words.SIGNS).split()


def _templates() -> list[tuple[str, list[bytes], list[bytes]]]:
    """(label, words, key phrases) of every template; names and identifiers stand whole."""
    said = [(label, t, keys) for ts_of in (TEMPLATES, PARTS) for label, ts in ts_of.items() for t, keys in ts]
    said += [(label, f"license identifier {x}", [f"license identifier {x}"]) for label, xs in IDENTIFIERS.items() for x in xs]
    said += [(label, x, [x]) for label, xs in NAMES.items() for x in xs]
    return [(label, t.encode().split(), [b" " + k.encode() + b" " for k in keys]) for label, t, keys in said]


def word_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many of all documents each license word stands (the words are those of the templates: a fixed number)."""
    vocabulary = frozenset(w for _, t, _ in _templates() for w in t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        n = 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                df.update(vocabulary.intersection(words_of(text or b"")))
                n += 1
        df[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {bytes(r["word"]): r["n"] for r in rows}
    return found, found.pop(b"", 0)


class Scanner:
    """The index: licence word -> postings (template, place), looked up by each file's highest-IDF licence words.

    A template of n words counts where COVER of them stand. So a file that lacks more of its words can't hold it; and of
    the n / 4 + 2 highest-IDF words that the file shares with it two at least stand in the notice: looking these up
    loses no place.
    """

    def __init__(self, frequencies: dict[bytes, int], n: int):
        self.templates = _templates()
        self.postings: dict[bytes, dict[int, list[int]]] = {}
        for k, (_, ws, _) in enumerate(self.templates):
            for place, w in enumerate(ws):
                self.postings.setdefault(w, {}).setdefault(k, []).append(place)
        self.keys = frozenset(self.postings)
        self.idf = {w: math.log((1 + n) / (1 + frequencies.get(w, 0))) for w in self.keys}
        self.spare = [math.floor(len(ws) * (1 - COVER)) for _, ws, _ in self.templates]
        self.needed = [max(2, len(set(ws)) - x) for (_, ws, _), x in zip(self.templates, self.spare, strict=True)]
        self.base = [(b" " + p.encode() + b" ", label) for p, label in BASE.items()]

    def _places(self, words_: list[bytes]) -> dict[int, list[tuple[int, bytes]]]:
        """For each template of which the file holds enough words: (where it would begin, word), by place."""
        held = self.keys.intersection(words_)
        n = Counter(k for w in held for k in self.postings[w])
        own = {k for k, c in n.items() if c >= self.needed[k]}
        if not own:
            return {}
        rank: Counter = Counter()
        wanted = defaultdict(list)  # the file's licence words, rarest first, with the templates they are looked up for
        for w in sorted(held, key=lambda w: (-self.idf[w], w)):
            for k in own.intersection(self.postings[w]):
                if rank[k] < self.spare[k] + 2:
                    rank[k] += 1
                    wanted[w] += [(k, place) for place in self.postings[w][k]]
        begins = defaultdict(list)
        for at, w in enumerate(words_):
            if w in wanted:
                for k, place in wanted[w]:
                    begins[k].append((at - place, w))
        return {k: sorted(x) for k, x in begins.items()}

    def _notices(self, words_: list[bytes]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, cover) of every template that is found."""
        out = []
        for k, begins in self._places(words_).items():
            label, template, keys = self.templates[k]
            j, done = 0, -1
            for i, (begin, w) in enumerate(begins):
                j = max(j, i)
                while j < len(begins) and begins[j][0] <= begin + DRIFT:
                    j += 1
                # two different rare words must agree on where it begins, but for the drift
                if begin < done or all(x == w for _, x in begins[i:j]):
                    continue
                done = begin + DRIFT // 2
                first, end = max(0, begin), begin + len(template) + DRIFT
                own = words_[first:end]
                cover = words.common_subsequence(template, own) / len(template)
                near = b" " + b" ".join(own) + b" "
                if cover >= COVER and all(p in near for p in keys):
                    out.append((label, first, min(len(words_), begin + len(template)), cover))
                    done = begin + len(template) // 2
        return out

    def scan(self, text: bytes) -> tuple:
        words_ = words_of(text)
        joined = b" " + b" ".join(words_) + b" "
        starts, base = [], set()
        for phrase, label in self.base:
            at, last, word = joined.find(phrase), 0, 0
            while at >= 0:
                word += joined.count(b" ", last, at)  # words before the phrase, counted on from its last place
                last = at
                starts.append(word)
                base.add(label)
                at = joined.find(phrase, at + 1)
        notices = self._notices(words_)
        score = 1.0 if starts else max((c for *_, c in notices), default=0.0)
        return (
            len(words_),
            len(starts),
            min(starts, default=None),
            max(starts, default=None),
            ",".join(sorted(base)),
            ",".join(sorted(base.union(x for x, *_ in notices))),
            score,
            ";".join(f"{x}:{a}:{b}" for x, a, b, _ in sorted(notices, key=lambda s: (s[1], s[2], s[0]))),
        )


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices string"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: word count, base phrases (all places), labels, score and notices (label:start:end).

    Words are counted from 0. The file's highest-IDF licence words are looked up; a template is a candidate where two of
    them agree, within DRIFT words, on where it begins, and is found if three quarters of its words follow there in its
    order and its key phrases stand there too. Null and empty texts have no words, no
    labels, null first_word and last_word and score 0. An empty table gives no rows; repeated rows repeat; copies of a notice are
    all reported; other columns are ignored.
    """
    frequencies, n = word_frequencies(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast((frequencies, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(*shared.value)
        for batch in batches:
            rows = [scanner.scan(t or b"") for t in batch.column(1).cast(pa.binary()).to_pylist()]
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
