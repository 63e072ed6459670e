"""Licence scans with a positional index of rare licence words.

Templates are the telling passages of licence texts and of notices that name one; callers may pass whole
licence texts. A first pass counts in how many files each template word occurs (one small row a word
leaves a task), which gives the words' inverse document frequencies. The second pass looks every file's own
licence words up in the positional index word -> (template, places):

* a template whose words are not all but ``1 - least`` of them in the file can't be there;
* of the others, the places of the words with the highest IDF among those the file has are anchors. A passage that
  agrees in ``least`` of its n words differs in at most m = n - ceil(least * n) places; with m + 2 anchors, less the
  places whose words the file lacks, two at least agree. So the positions of anchor words, each less its place, are
  intersected: where two meet, the passage may begin, and none is lost;
* there the whole passage is compared: it counts if its mandatory key phrases stand where they belong and the
  agreeing share of words reaches ``least``.

Phrases of ``BASE`` are templates that are mandatory as a whole; all their places are counted exactly.

Files are whole; nothing is shuffled but word counts, so long files and common phrases cost their own
length alone. Defined results: null and empty texts have no words, null places, "" for labels and
score 0; null ids are kept; repeated rows give equal rows; texts of any length are read whole; an empty table
gives an empty one; extra columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops
from .shared import small_batches

BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Fixed values: (label, passage, mandatory key phrases) of public licence texts and their usual notices.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("free of charge", "deal in the software",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license", "version 2 0",)),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license",)),
    ("apache-1.1", "the end user documentation included with the redistribution if any must include the following acknowledgment this product includes software developed by the apache software foundation", ("apache software foundation",)),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl", "it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation",)),
    ("gpl-3", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", ("verbatim copies",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("lgpl-2", "under the terms of the gnu library general public license", ("gnu library general public license",)),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ("gnu free documentation license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "with or without modification",)),
    ("bsd-3", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products", "prior written permission",)),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display the following acknowledgement", ("advertising materials",)),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is", ("any purpose with or without fee", "as is",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1", ("mozilla public license version 1 1",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("any purpose with or without fee", "appear in all copies",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("cc-by-nd", "creative commons attribution noderivatives 4 0 international license", ("attribution noderivatives",)),
    ("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("waived all copyright", "neighboring rights",)),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("epl-1", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", ("eclipse public license v1",)),
    ("cddl-1", "the contents of this file are subject to the terms of the common development and distribution license", ("common development and distribution license",)),
    ("eupl-1.2", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission", ("eupl version 1 2",)),
    ("ms-pl", "this license governs use of the accompanying software if you use the software you accept this license if you do not accept the license do not use the software", ("governs use of the accompanying software",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("held liable for any damages",)),
    ("libpng", "the png reference library is supplied as is the contributing authors and group 42 inc disclaim all warranties expressed or implied", ("png reference library",)),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("artistic-2", "you can redistribute it and or modify it under the terms of the artistic license 2 0", ("artistic license 2 0",)),
    ("artistic-1", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", ("artistic control",)),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ("verbatim or modified copies",)),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ("open font license",)),
    ("psf-2", "this license agreement is between the python software foundation psf and the individual or organization licensee", ("python software foundation",)),
    ("php-3.01", "this source file is subject to version 3 01 of the php license", ("php license",)),
    ("ruby", "you can redistribute it and or modify it under either the terms of the 2 clause bsdl or the conditions below", ("2 clause bsdl",)),
    ("vim", "this license applies to the vim editor you may distribute unmodified copies of vim without restrictions", ("copies of vim",)),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", ("openssl project",)),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", ("without a written agreement",)),
    ("ncsa", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", ("to deal with the software",)),
    ("odbl-1.0", "this database is made available under the open database license", ("open database license",)),
    ("pddl-1.0", "made available under the public domain dedication and license v1 0", ("public domain dedication and license",)),
    ("bsl-1.1", "use of the licensed work will be governed by the business source license", ("business source license",)),
    ("sspl-1", "you can redistribute it and or modify it under the terms of the server side public license version 1", ("server side public license",)),
    ("elastic-2", "licensed under the elastic license 2 0 you may not use this file except in compliance with the elastic license 2 0", ("elastic license 2 0",)),
    ("upl-1.0", "licensed under the universal permissive license v 1 0 as shown at", ("universal permissive license",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)
LEAST = 0.8


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return textops.Words(data, np.array([0, len(data)]), textops.ALNUM_WORD, lower=True).hashes()


@dataclass
class Template:
    label: str
    words: np.ndarray  # numbers in the vocabulary
    keys: np.ndarray  # places that must agree
    base: bool

    def slack(self, least: float) -> int:
        """Places that may differ."""
        return 0 if self.base else len(self.words) - math.ceil(least * len(self.words) - 1e-9)


@dataclass
class Library:
    vocabulary: np.ndarray  # sorted hashes
    templates: list[Template]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary numbers of words, -1 for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1).astype(np.int32)


def library(templates=TEMPLATES, base=BASE) -> Library:
    rows = [(label, _hashes(text), [_hashes(k) for k in keys], False) for label, text, keys in templates] + [(label, _hashes(text), [_hashes(text)], True) for text, label in base]
    vocabulary = np.unique(np.concatenate([h for _, h, _, _ in rows]))
    out = []
    for label, h, keys, is_base in rows:
        must = np.zeros(len(h), bool)
        for k in keys:
            places = [i for i in range(len(h) - len(k) + 1) if (h[i : i + len(k)] == k).all()]
            if not places:
                raise ValueError(f"a key phrase of {label} isn't in its template")
            must[places[0] : places[0] + len(k)] = True
        out.append(Template(label, np.searchsorted(vocabulary, h).astype(np.int32), np.flatnonzero(must), is_base))
    return Library(vocabulary, out)


def document_frequencies(docs: DataFrame, lib: Library) -> tuple[np.ndarray, int]:
    """In how many files each vocabulary word occurs, and the number of files."""
    size = len(lib.vocabulary)

    def run(batches):
        counts = np.zeros(size + 1, np.int64)
        for batch in batches:
            for _, data, offsets in textops.slices(batch.column(0)):
                words = textops.Words(data, offsets, textops.ALNUM_WORD, lower=True)
                numbers = lib.numbers(words.hashes())
                hit = numbers >= 0
                pairs = np.unique(words.text_of()[hit] * size + numbers[hit])
                counts[:size] += np.bincount(pairs % size, minlength=size)
                counts[size] += len(offsets) - 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(counts)], names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row a template word
    counts = np.zeros(size + 1, np.int64)
    for r in rows:
        counts[r["word"]] = r["n"]
    return counts[:size], int(counts[size])


def inverse_frequencies(frequencies: np.ndarray, files: int) -> np.ndarray:
    return np.log((files + 1) / (frequencies + 1.0)) + 1.0


class Index:
    """Positional postings of each template's rarest words.

    A passage may differ in ``slack`` places of its template, so of any slack + 2 places two agree at least. The
    postings hold those with the highest IDF: word -> (template, place). A file's words are looked up once each; the
    places of the passage that they vote for are intersected, and only what two of them agree on is compared in full.
    """

    def __init__(self, lib: Library, idf: np.ndarray, least: float):
        self.lib = lib
        self.slack = np.array([t.slack(least) for t in lib.templates])
        self.sizes = np.array([len(t.words) for t in lib.templates])
        postings = []
        for n, t in enumerate(lib.templates):
            rare = np.lexsort((np.arange(len(t.words)), -idf[t.words]))[: self.slack[n] + 2]
            postings += [(int(t.words[p]), n, int(p)) for p in rare]
        postings.sort()
        word, self.template, self.place = np.array(postings, np.int64).reshape(-1, 3).T
        self.begin = np.searchsorted(word, np.arange(len(lib.vocabulary) + 1))
        self.votes = np.minimum(2, self.slack + 2).clip(max=self.sizes)

    def candidates(self, words: textops.Words, numbers: np.ndarray) -> np.ndarray:
        """(template, file, first word of the passage in the run of files) that enough rare words vote for."""
        at = np.flatnonzero(numbers >= 0)
        begin = self.begin[numbers[at]]
        n = self.begin[numbers[at] + 1] - begin
        entry, at = textops.ranges(begin, n), np.repeat(at, n)
        file, template, start = np.searchsorted(words.first, at, "right") - 1, self.template[entry], at - self.place[entry]
        order = np.lexsort((start, file, template))
        found = np.stack([template, file, start])[:, order]
        fresh = np.flatnonzero(np.r_[True, (found[:, 1:] != found[:, :-1]).any(axis=0)]) if len(at) else np.zeros(0, np.int64)
        votes = np.diff(np.r_[fresh, len(at)])
        return found[:, fresh[votes >= self.votes[found[0, fresh]]]]

    def passages(self, words: textops.Words):
        """(file, template, first word in its file, agreeing share) of every passage found."""
        numbers = self.lib.numbers(words.hashes())
        template, file, start = self.candidates(words, numbers)
        cut = np.flatnonzero(np.r_[True, template[1:] != template[:-1]]) if len(template) else []
        for a, b in zip(cut, [*cut[1:], len(template)]):
            n = int(template[a])
            t = self.lib.templates[n]
            for a in range(a, b, 4096):  # of bounded memory
                own, begin = file[a : min(b, a + 4096)], start[a : min(b, a + 4096)]
                at = begin[:, None] + np.arange(len(t.words))
                inside = (at >= words.first[own][:, None]) & (at < words.first[own + 1][:, None])
                same = inside & (numbers[np.clip(at, 0, len(numbers) - 1)] == t.words)
                good = same[:, t.keys].all(axis=1) & (same.sum(axis=1) >= len(t.words) - self.slack[n])
                yield from zip(own[good].tolist(), [n] * int(good.sum()), (begin - words.first[own])[good].tolist(), same.mean(axis=1)[good].tolist())


def scan(docs: DataFrame, templates=TEMPLATES, base=BASE, least: float = LEAST) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and the passages found
    (label, first word, words, agreeing share) of every file."""
    small_batches(docs.sparkSession)
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    lib = library(templates, base)
    index = Index(lib, inverse_frequencies(*document_frequencies(docs, lib)), least)

    def run(batches):
        for batch in batches:
            for at, data, offsets in textops.slices(batch.column(1)):
                words = textops.Words(data, offsets, textops.ALNUM_WORD, lower=True)
                rows = [[n, 0, None, None, set(), set(), 0.0, []] for n in words.counts.tolist()]
                for file, n, start, share in index.passages(words):
                    row, t = rows[file], lib.templates[n]
                    row[6] = max(row[6], share)
                    if t.base:
                        row[1] += 1
                        row[2] = start if row[2] is None else min(row[2], start)
                        row[3] = start if row[3] is None else max(row[3], start)
                        row[4].add(t.label)
                    else:
                        row[5].add(t.label)
                        row[7].append((t.label, start, len(t.words), share))
                labels = lambda s: ",".join(sorted(s))
                columns = zip(*[(r[0], r[1], r[2], r[3], labels(r[4]), labels(r[4] | r[5]), r[6], [dict(zip(("label", "first_word", "n_words", "share"), p)) for p in sorted(r[7])]) for r in rows])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)), *[pa.array(c, t) for c, t in zip(columns, _TYPES)]], names=_NAMES)

    return docs.mapInArrow(run, _SCHEMA)


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, passages array<struct<label: string, first_word: bigint, n_words: bigint, share: double>>"
_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "passages"]
_TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("share", pa.float64())]))]
