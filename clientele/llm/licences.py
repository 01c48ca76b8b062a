"""Licence texts found by the Dice coefficient over word bigrams.

Texts and templates are normalised to words; a passage is compared with a template by
2 |A and B| / (|A| + |B|) over their sets of bigrams. For a coefficient of at least t a passage must
have between t / (2 - t) and (2 - t) / t times the template's bigrams, and share at least
t / (2 - t) of them: the first bound limits the windows that are looked at, the second drops nearly
every template for a document before any window is.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from clientele.llm.common import fresh
from clientele.llm.suffix_match import fold_words

THRESHOLD = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including
without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee
is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form
must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
in compliance with the License. You may obtain a copy of the License at"""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version {} of the License, or
(at your option) any later version."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at"""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy,
modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any means."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the
authors be held liable for any damages arising from the use of this software. Permission is granted to anyone
to use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you
must not claim that you wrote the original software."""
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the
software and accompanying documentation covered by this license (the "Software") to use, reproduce, display,
distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit
third-parties to whom the Software is furnished to do so."""
_APACHE_GRANT = """Grant of Copyright License. Subject to the terms and conditions of this License, each
Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable
copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense,
and distribute the Work and such Derivative Works in Source or Object form."""
_GPL2_PREAMBLE = """The licenses for most software are designed to take away your freedom to share and change it.
By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free
software"""
_GPL3_PREAMBLE = """The licenses for most software and other practical works are designed to take away your freedom
to share and change the works. By contrast, the GNU General Public License is intended to guarantee your
freedom to share and change all versions of a program"""
_LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation; either version {} of the License,
or (at your option) any later version."""
_MPL_TERMS = """"Contributor" means each individual or legal entity that creates, contributes to the creation of,
or owns Covered Software."""
_CC_TERMS = """By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and
conditions of this Creative Commons {} 4.0 International Public License"""

#: Public licence texts, passages that stand for the longer ones, and notices that name a licence.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("ISC", _ISC),
    ("ISC", "Licensed under the ISC License"),
    ("BSD-2-Clause", _BSD2),
    ("BSD-3-Clause", _BSD2 + " 3. Neither the name of the copyright holder nor the names of its contributors may be "
     "used to endorse or promote products derived from this software without specific prior written permission."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", _APACHE_GRANT),
    ("BSL-1.0", _BSL),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("zlib", _ZLIB),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
     "License 2.0"),
    ("Artistic-2.0", "You may redistribute and modify it under the terms of the Artistic License 2.0"),
    ("GPL-2.0", _GPL2_PREAMBLE),
    ("GPL-3.0", _GPL3_PREAMBLE),
    ("LGPL-2.1", _LGPL.format("2.1")),
    ("LGPL-3.0", _LGPL.format("3")),
    ("MPL-2.0", _MPL_TERMS),
    ("CC-BY-4.0", _CC_TERMS.format("Attribution")),
    ("CC-BY-SA-4.0", _CC_TERMS.format("Attribution-ShareAlike")),
    ("CC-BY-NC-4.0", _CC_TERMS.format("Attribution-NonCommercial")),
    ("GPL-2.0", _GPL.format(2)),
    ("GPL-3.0", _GPL.format(3)),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
     "rights to this work"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved"),
)

MATCH = T.StructType([
    T.StructField("licence", T.StringType()), T.StructField("dice", T.DoubleType()),
    T.StructField("word_start", T.LongType()), T.StructField("n_words", T.LongType())])


def bigrams(words: list[bytes]) -> list[tuple[bytes, bytes]]:
    return list(zip(words, words[1:]))


class Scanner:
    """Templates by their bigrams."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must be above 0 and at most 1")
        self.threshold = threshold
        self.names, self.sets = [], []
        for name, text in templates:
            grams = frozenset(bigrams(fold_words(text)))
            if not grams:
                raise ValueError(f"template of {name} has fewer than two words")
            self.names.append(name)
            self.sets.append(grams)
        self.all = frozenset().union(*self.sets)
        share = threshold / (2 - threshold)
        self.need = [math.ceil(len(s) * share - 1e-9) for s in self.sets]
        self.most = [math.floor(len(s) / share + 1e-9) for s in self.sets]

    def _windows(self, grams: list[tuple[bytes, bytes]], t: int) -> Iterator[tuple[float, int, int]]:
        """(dice, first bigram, end) of the best passage from each place where the template shows.

        The coefficient only changes where a bigram comes for the first time after the start. Going
        backwards, ``first`` holds the bigrams by where they next come, the nearest last, so a start
        looks at no more than ``most`` of them however often they repeat.
        """
        mine, need, most = self.sets[t], self.need[t], self.most[t]
        first: OrderedDict[tuple[bytes, bytes], int] = OrderedDict()
        found = []
        for start in range(len(grams) - 1, -1, -1):
            first[grams[start]] = start
            first.move_to_end(grams[start])
            if grams[start] not in mine:
                continue
            shared, best = 0, None
            for seen, (gram, at) in enumerate(reversed(first.items()), 1):
                if seen > most:
                    break
                if gram in mine:
                    shared += 1
                    if shared >= need:
                        dice = 2 * shared / (seen + len(mine))
                        if dice >= self.threshold and (best is None or dice > best[0]):
                            best = dice, start, at + 1
            if best:
                found.append(best)
        yield from reversed(found)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """Passages (licence, dice, first word, words) without overlap, the most similar first taken."""
        words = fold_words(text)
        hits = self.all.intersection(zip(words, words[1:]))
        if not hits:
            return []
        grams = None
        found = []
        for t, own in enumerate(self.sets):
            if len(hits & own) >= self.need[t]:
                grams = bigrams(words) if grams is None else grams
                found += [(-dice, a - b, a, self.names[t], b) for dice, a, b in self._windows(grams, t)]
        taken: list[tuple[int, int, str, float]] = []
        free = bytearray(len(words))
        for minus, _, a, name, b in sorted(found):
            if free.find(1, a, b + 1) < 0:
                free[a:b + 1] = b"\1" * (b + 1 - a)
                taken.append((a, b, name, -minus))
        return [(name, dice, a, b + 1 - a) for a, b, name, dice in sorted(taken)]


def add_licences(docs: DataFrame, text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES,
                 threshold: float = THRESHOLD, name: str = "licences") -> tuple[DataFrame, str]:
    """``docs`` with the licence passages of the whole text; also the new column's name.

    Words are the runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased.
    Null, empty and one-word texts have no passage. Of overlapping passages the most similar, then the
    longest, then the first stays.
    """
    name = fresh(name, docs.columns)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(MATCH))])
    position = docs.columns.index(text_col)

    def run(batches):
        scanner = Scanner(templates, threshold)
        kind = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()),
                                   ("word_start", pa.int64()), ("n_words", pa.int64())]))
        keys = [f.name for f in kind.value_type]
        for batch in batches:
            rows = [[dict(zip(keys, m)) for m in scanner.scan(t)] for t in batch.column(position).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], schema.fieldNames())

    return docs.mapInArrow(run, schema), name
