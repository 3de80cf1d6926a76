"""Licence scan: the Dice coefficient of word bigrams against licence templates.

Units of a document are its lines, its paragraphs (runs of lines that are not blank), the whole text,
and for each template every window of as many words as the template has, anywhere in the text and
across lines. A template is compared only with texts, and its windows only around places, that share
enough bigrams for the coefficient to reach the threshold.

Defined results: units that reach the threshold and overlap are one match, the one whose coefficient
times shared bigrams is largest (so a notice is not taken for the shorter one inside it), then the
kind in the order above, the first place, the template first in TEMPLATES; n_matches counts these. The
best match is that of the largest coefficient, the first of equals. A null or empty text has no unit
and no licence; units of one word have no bigrams and match nothing; repeated rows are scanned each;
an empty table gives no rows and a null doc_id stays null; texts of any length are scanned whole, one at
a time; further columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerspark.llm.bpe import small_batches

#: Public licence notices, short licence texts and, from license_texts, full ones.
#: Of the AGPL-3.0 and the Creative Commons licences only notices are there, not the full texts.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
]
_TEXTS = sorted((f for f in (resources.files(__package__) / "license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
TEMPLATES += [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in _TEXTS]
THRESHOLD = 0.8
_WORDS = re.compile(r"[^\W_]+").findall
KINDS = ["line", "paragraph", "text", "window"]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], threshold: float):
        self.threshold, self.names = threshold, [name for name, _ in templates]
        words = [_WORDS(text.lower()) for _, text in templates]
        self.sizes = [len(w) - 1 for w in words]
        self.grams = [set(zip(w, w[1:], strict=False)) for w in words]
        #: A unit has at least as many distinct bigrams as it shares, so it must share so many.
        self.least = [max(1, int(-(-(threshold * len(g) / (2 - threshold) - 1e-9) // 1))) for g in self.grams]
        self.holders: dict[tuple[str, str], list[int]] = {}
        for t, grams in enumerate(self.grams):
            for g in grams:
                self.holders.setdefault(g, []).append(t)
        self.known = frozenset(self.holders)

    def windows(self, grams: list[tuple[str, str]], t: int) -> Iterator[tuple[int, float, int]]:
        """(shared bigrams, coefficient, start) of every window of the template's length that reaches the threshold."""
        own, least, size = self.grams[t], self.least[t], self.sizes[t]
        at = [i for i, g in enumerate(grams) if g in own]
        ranges: list[list[int]] = []  # starts of windows with enough places that share a bigram
        for first, last in zip(at, at[least - 1 :], strict=False):
            a, b = max(0, last - size + 1), min(first, len(grams) - size)
            if a > b:
                continue
            if ranges and a <= ranges[-1][1] + 1:
                ranges[-1][1] = b
            else:
                ranges.append([a, b])
        for a, b in ranges:
            held = Counter(grams[a : a + size])
            shared = len(own.intersection(held))
            for start in range(a, b + 1):
                dice = 2 * shared / (len(held) + len(own))
                if dice >= self.threshold:
                    yield shared, dice, start
                if start < b:
                    gone, new = grams[start], grams[start + size]
                    held[gone] -= 1
                    if not held[gone]:
                        del held[gone]
                        shared -= gone in own
                    if new not in held:
                        shared += new in own
                    held[new] += 1

    def scan(self, text: str | None) -> list[tuple[str, int, float, str]]:
        """(unit, first line, coefficient, licence) of every match, in the order of the text."""
        if not text:
            return []
        lines, words, starts = text.split("\n"), [], [0]
        for line in lines:
            words += _WORDS(line.lower())
            starts.append(len(words))
        held = Counter(t for g in self.known.intersection(zip(words, words[1:], strict=False)) for t in self.holders[g])
        live = [t for t, n in sorted(held.items()) if n >= self.least[t]]
        if not live:
            return []
        units = [(0, i, i + 1) for i in range(len(lines))]
        start = 0
        for i in range(len(lines) + 1):
            if i == len(lines) or not lines[i].strip():
                if i - start > 1:
                    units.append((1, start, i))
                start = i + 1
        if len(lines) > 1:
            units.append((2, 0, len(lines)))
        grams, found = list(zip(words, words[1:], strict=False)), []  # (-weight, kind, first word, template, end, coefficient, line)
        for kind, i, j in units:
            a, b = starts[i], starts[j]
            unit = set(grams[a : max(a, b - 1)])
            for t in live:
                shared = len(unit & self.grams[t])
                dice = 2 * shared / (len(unit) + len(self.grams[t]))
                if dice >= self.threshold:
                    found.append((-shared * dice, kind, a, t, b, dice, i))
        for t in live:
            for shared, dice, a in self.windows(grams, t):
                found.append((-shared * dice, 3, a, t, a + self.sizes[t] + 1, dice, bisect(starts, a) - 1))
        begins, matches = [], []
        for _, kind, a, t, b, dice, line in sorted(found):
            at = bisect(begins, a)
            if (at and matches[at - 1][1] > a) or (at < len(begins) and begins[at] < b):
                continue
            begins.insert(at, a)
            matches.insert(at, (a, b, (KINDS[kind], line, dice, self.names[t])))
        return [m for *_, m in matches]


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of (doc_id, text): license and dice of the best unit (null if none) and n_matches."""
    small_batches(docs.sparkSession)

    def run(batches):
        scanner = Scanner(templates, threshold)
        for b in batches:
            found = [scanner.scan(t) for t in b.column(1).to_pylist()]
            best = [max(f, key=lambda x: x[2]) if f else (None, None, None, None) for f in found]
            yield pa.record_batch([b.column(0), pa.array([x[3] for x in best], pa.string()), pa.array([x[2] for x in best], pa.float64()), pa.array([x[0] for x in best], pa.string()), pa.array([x[1] for x in best], pa.int32()), pa.array([len(f) for f in found], pa.int64())], names=["doc_id", "license", "dice", "unit", "line", "n_matches"])

    fields = [("license", T.StringType()), ("dice", T.DoubleType()), ("unit", T.StringType()), ("line", T.IntegerType()), ("n_matches", T.LongType())]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, t) for n, t in fields)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
