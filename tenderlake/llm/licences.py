"""License scans: passages against notices and whole licence texts by the Dice coefficient of word bigrams."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .common import table

DICE = 0.8
#: Whole licence texts, a file for each licence; more can be put there or given as ``templates``.
TEXTS = Path(__file__).with_name("licence_texts")
# Public licence notices, as their licences word them or as they are commonly cited.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    ],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License."],
    "ISC": ["Licensed under the ISC License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORDS = re.compile("[a-z0-9]+")


def all_templates() -> dict[str, list[str]]:
    """The notices and whole texts of each licence."""
    out = {k: list(v) for k, v in NOTICES.items()}
    for f in sorted(TEXTS.glob("*.txt")):
        out.setdefault(f.stem, []).append(f.read_text(encoding="utf-8"))
    return out


def words(text: str) -> list[str]:
    """Words; A-Z is lowered, and all but a-z and 0-9 parts words."""
    return _WORDS.findall(text.translate(_LOWER))


class Templates:
    """Templates as sets of word bigrams. A passage is a run of as many words as the template has, or a shorter whole text."""

    def __init__(self, templates: dict[str, list[str]], dice: float):
        self.names, self.sets, self.lengths = [], [], []
        for name, ts in sorted(templates.items()):
            for t in ts:
                w = words(t)
                if len(w) > 1:
                    self.names.append(name)
                    self.lengths.append(len(w) - 1)
                    self.sets.append(frozenset(zip(w, w[1:], strict=False)))
        self.dice = Fraction(str(dice))
        # 2 |A and B| / (|A| + |B|) >= d and |A and B| <= |A| ask for at least d / (2 - d) of |B|, in common and in A.
        self.needs = [-(-len(s) * self.dice.numerator // (2 * self.dice.denominator - self.dice.numerator)) for s in self.sets]
        self.holders: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i in sorted(range(len(self.sets)), key=lambda i: self.needs[i]):
            for g in self.sets[i]:
                self.holders[g].append(i)

    def best(self, grams: list[tuple[str, str]], i: int):
        """The first of the passages with the highest Dice to template i: (dice, place of its first word), if it is enough."""
        own, width = self.sets[i], min(self.lengths[i], len(grams))
        size, common, counts = 0, 0, Counter()
        top, place = Fraction(0), 0
        for k, g in enumerate(grams):
            counts[g] += 1
            if counts[g] == 1:
                size += 1
                common += g in own
            if k >= width:
                old = grams[k - width]
                counts[old] -= 1
                if not counts[old]:
                    size -= 1
                    common -= old in own
            if k >= width - 1 and common >= self.needs[i] and (d := Fraction(2 * common, size + len(own))) > top:
                top, place = d, k - width + 1
        return (top, place) if top >= self.dice else None

    def matches(self, text: str):
        """(licence, Dice, place of the passage's first word) of each template that a passage of the text is near to.

        Templates too large for the text, by its number of bigrams, are passed over; of the others those that have enough
        bigrams in common with the whole text are compared passage by passage.
        """
        w = words(text)
        grams = list(zip(w, w[1:], strict=False))
        holders = self.holders
        common: Counter = Counter()
        for g in {g for g in grams if g in holders}:
            for i in holders[g]:
                if self.needs[i] > len(grams):
                    break  # the rest are larger
                common[i] += 1
        for i, n in common.items():
            if n >= self.needs[i] and (got := self.best(grams, i)):
                yield self.names[i], float(got[0]), got[1]


def licences(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), templates: dict[str, list[str]] | None = None, dice: float = DICE) -> DataFrame:
    """``keep`` columns, licence (best match; ties by name; null if none), dice, first_word (place of the first word of
    the passage; of several templates of equal name and Dice the first), templates (how many matched) and licences (all
    names matched, sorted, comma-joined).

    Passages may begin anywhere and run over lines. A null or empty text has none; repeated rows have equal results; an
    empty table gives no rows. Texts of any length are worked on whole, each by itself and without a shuffle, in time in
    proportion to the words and to the templates that they may hold. The templates, of fixed number, are broadcast.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Templates(templates or all_templates(), dice))
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    fields = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep] + ["licence string, dice double, first_word long, templates long, licences string"])

    def run(batches):
        known = sent.value
        for batch in batches:
            out = []
            for t in batch.column("_t"):
                every = list(known.matches(t.as_py()))
                best = min(every, key=lambda m: (-m[1], m[0], m[2]), default=(None, None, None))
                out.append((*best, len(every), ",".join(sorted({m[0] for m in every}))))
            cols = zip(*out, strict=True) if out else [[]] * 5
            made = [pa.array(list(c), y) for c, y in zip(cols, (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=[*keep, "licence", "dice", "first_word", "templates", "licences"])

    return rows.mapInArrow(run, fields)


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


def _values() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({quote(n)}, {quote(t)})" for n, ts in sorted(all_templates().items()) for t in ts)


OP10_SQL = rf"""
WITH a AS (SELECT 0 AS kind, row_number() OVER () AS rid, doc_id, '' AS name, coalesce(text, '') AS body FROM documents
           UNION ALL SELECT 1, row_number() OVER (), NULL, name, body FROM (VALUES {_values()}) AS v(name, body)),
w AS (SELECT kind, rid, doc_id, name, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w FROM a),
g AS (SELECT kind, rid, doc_id, name, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM w),
e AS (SELECT DISTINCT kind, rid, unnest(g) AS g FROM g),
s AS (SELECT kind, rid, count(*) AS n FROM e GROUP BY ALL),
c AS (SELECT x.rid, y.rid AS tid FROM e x JOIN e y ON x.kind = 0 AND y.kind = 1 AND x.g = y.g JOIN s ON s.kind = 1 AND s.rid = y.rid GROUP BY x.rid, y.rid, s.n HAVING 3 * count(*) >= 2 * s.n),
p AS (SELECT c.rid, c.tid, y.name, y.g AS tg, x.g AS xg, least(len(x.g), len(y.g)) AS k FROM c JOIN g x ON x.kind = 0 AND x.rid = c.rid JOIN g y ON y.kind = 1 AND y.rid = c.tid),
v AS (SELECT rid, tid, name, i - 1 AS place, list_distinct(xg[i:i + k - 1]) AS xs, list_distinct(tg) AS ts FROM (SELECT *, unnest(range(1, len(xg) - k + 2)) AS i FROM p)),
m AS (SELECT rid, tid, name, place, 2 * len(list_intersect(xs, ts)) AS top, len(xs) + len(ts) AS below FROM v),
f AS (SELECT rid, tid, name, place, CAST(top AS DOUBLE) / CAST(below AS DOUBLE) AS dice FROM m WHERE 10 * top >= 8 * below),
b AS (SELECT rid, tid, name, max(dice) AS dice, arg_max(place, (dice, -place)) AS place FROM f GROUP BY ALL),
r AS (SELECT rid, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS licences FROM b GROUP BY rid),
o AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dice DESC, name, place) AS k FROM b)
SELECT g.doc_id, o.name AS licence, o.dice, CAST(o.place AS BIGINT) AS first_word, CAST(coalesce(r.n, 0) AS BIGINT) AS templates, coalesce(r.licences, '') AS licences
FROM g LEFT JOIN o ON o.rid = g.rid AND o.k = 1 LEFT JOIN r ON r.rid = g.rid WHERE g.kind = 0
"""
