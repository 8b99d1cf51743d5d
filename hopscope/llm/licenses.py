"""Licence scan of lines and of runs of neighbouring lines by a trained classifier, in DataFrame functions only.

Sparse logistic regression over hashed word 1- and 2-grams tells licence families, ``unknown`` (licence
talk of no known family) and ``none`` apart. It is trained on the driver from the notices below, from
variations of them (dropped and added words, frames, parts), from licence talk with invented names, from
ordinary sentences and from a bounded sample of paragraphs (``SAMPLE_LINES``); probabilities are calibrated
by a temperature on variations that were not trained on. Only passages that hold one of the ``ANCHORS``
are candidates; by the model's definition all others are ``none``. A prediction is confirmed if the
passage has at least ``CONFIRM`` of the 2-grams of one of the family's notices.

Passages are all lines, and windows that join a line with the first words (``SPANS``) of those after it up
to a line without words; so a notice is met whole however it is wrapped. Words before the last
``SPANS[-1]`` of a window's first line are left out, since a notice that goes on in the next line begins
later. A window's finding stands at its first line; it is left out if a line or window inside it tells the same.

All of a text's lines are looked at, in place, without a shuffle. Null or empty text has no
findings; repeated rows and null ids are scanned row by row; an empty table gives no rows. A kept column
that has the name of an output gets an underscore at its end.
"""

from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, hashed_sample, kept_names

# Notices of licence families.
NOTICES = {
    "AGPL-3.0": ["licensed under the gnu affero general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or any later version", "spdx license identifier agpl 3 0 or later"],
    "Apache-2.0": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "you may obtain a copy of the license at http www apache org licenses license 2 0", "spdx license identifier apache 2 0"],
    "BSD-2-Clause": ["licensed under the bsd 2 clause license", "released under the simplified bsd license", "spdx license identifier bsd 2 clause"],
    "BSD-3-Clause": ["licensed under the bsd 3 clause license", "use of this source code is governed by a bsd style license that can be found in the license file", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "spdx license identifier bsd 3 clause"],
    "CC-BY-4.0": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "spdx license identifier cc by 4 0"],
    "CC-BY-NC-4.0": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "spdx license identifier cc by nc 4 0"],
    "CC-BY-SA-4.0": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "spdx license identifier cc by sa 4 0"],
    "CC0-1.0": ["released under cc0 1 0 universal public domain dedication", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "spdx license identifier cc0 1 0"],
    "GPL-2.0": ["licensed under the gnu general public license version 2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or any later version", "spdx license identifier gpl 2 0 only"],
    "GPL-3.0": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu gpl v3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or any later version", "spdx license identifier gpl 3 0 or later"],
    "ISC": ["licensed under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "spdx license identifier isc"],
    "LGPL-2.1": ["licensed under the gnu lesser general public license version 2 1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "spdx license identifier lgpl 2 1 or later"],
    "MIT": ["released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "use of this source code is governed by an mit style license", "spdx license identifier mit"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "spdx license identifier mpl 2 0"],
    "Proprietary": ["all rights reserved", "copyright all rights reserved", "this document is confidential and proprietary all rights reserved", "no part of this publication may be reproduced without the prior written permission of the copyright holder"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "spdx license identifier unlicense"],
}
# Licence talk of no family, and sentences that use such words otherwise.
TALK = ["see the license file for details", "subject to the terms of the license agreement", "distributed under the terms of its own license", "a copy of the license is included with the software", "the license may change without notice", "use is permitted under license from the owner", "this software is provided as is without warranty of any kind", "licensed material please contact the copyright holder", "permission to reproduce must be requested", "the above copyright notice shall be included in all copies"]
PLAIN = ["he lost his driving license last week", "with the permission of her parents she left", "the warranty on the washing machine has ended", "the town issued a fishing license", "they asked permission to enter the hall", "copyright was discussed at the conference", "a license plate was found near the road", "the public domain of ideas is large", "the court spoke about copyright law and its history", "no permission was needed to walk there"]
NAMES = ["eclipse public", "artistic", "zlib", "boost software", "acme community", "vendor evaluation", "open data", "academic free", "python software foundation", "sil open font"]
ANCHORS = ["licen", "copyright", "permission", "warrant", "all rights reserved", "public domain", "redistribut", "creative commons", "cc by", "cc-by", "cc0", "gpl", "spdx"]

BUCKETS, SAMPLE_LINES, VARIANTS, LEAST, CONFIRM = 4_096, 2_000, 14, 0.5, 0.8
UNKNOWN, NONE = "unknown", "none"
#: Words after its first line that a window holds; the last is at least the longest notice.
SPANS = [6, 12, 24, 48]


def _grams(text: str) -> list[str]:
    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    return list(dict.fromkeys(w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]))


def _kindred(family: str) -> list[str]:
    """Families with a notice that shares half its 2-grams with one of ``family``'s."""
    pairs = lambda n: [{g for g in _grams(t) if " " in g} for t in NOTICES[n]]
    return [n for n in NOTICES if n != family and any(2 * len(a & b) >= len(a) for a in pairs(family) for b in pairs(n))]


def _bucket(gram: str) -> int:
    """The same as pmod(xxhash64(gram), BUCKETS) in SQL."""
    return xxhash.xxh64_intdigest(gram.encode(), 42) % BUCKETS


def _variant(text: str, rng: random.Random, filler: list[str]) -> str:
    w = text.split()
    if len(w) > 6:
        w = [x for x in w if rng.random() > 0.06]
    frame = rng.choice([[], [], ["this", "file", "is"], ["the", "code", "below", "is"], ["copyright", "2019", "the", "authors"], ["c", "2021"], ["note"]])
    tail = [rng.choice(filler) for _ in range(rng.randrange(0, 7))]
    return " ".join([*frame, *w, *tail] if rng.random() < 0.6 else [*tail, *w])


def _examples(seed: int, lines: list[str], variants: int) -> list[tuple[str, str]]:
    rng = random.Random(seed)
    filler = [w for x in lines[:200] for w in re.split("[^a-z0-9]+", x.lower()) if w] or ["text"]
    out = []
    for family, notices in NOTICES.items():
        for text in notices:
            out += [(text, family)] + [(_variant(text, rng, filler), family) for _ in range(variants)]
    for text in TALK:
        out += [(text, UNKNOWN)] + [(_variant(text, rng, filler), UNKNOWN) for _ in range(variants)]
    for name in NAMES:
        for form in ("licensed under the {} license", "released under the {} license version 1 0", "distributed under the terms of the {} license"):
            out += [(_variant(form.format(name), rng, filler), UNKNOWN) for _ in range(3)]
    for form in ("licensed under the {} license", "released under the {} license version 2 0", "licensed under {} 4 0"):
        out += [(_variant(form.format(rng.choice(filler)), rng, filler), UNKNOWN) for _ in range(25)]
    for text in PLAIN:
        out += [(text, NONE)] + [(_variant(text, rng, filler), NONE) for _ in range(variants)]
    return out + [(x, NONE) for x in lines]


class LicenceModel:
    """names, weights (classes, used buckets), bias, buckets in use."""

    def __init__(self, lines: list[str]):
        self.names = [*NOTICES, UNKNOWN, NONE]
        k = len(self.names)
        train, held = _examples(1, lines[: len(lines) // 2], VARIANTS), _examples(2, lines[len(lines) // 2 :], 6)
        at = {name: i for i, name in enumerate(self.names)}
        x, y = self._matrix(train), np.array([at[f] for _, f in train])
        w, b = np.zeros((k, x.shape[1]), np.float32), np.zeros(k, np.float32)
        hot = np.eye(k, dtype=np.float32)[y]
        share = 1 / np.maximum(np.bincount(y, minlength=k), 1)[y]
        share = (share / share.sum()).astype(np.float32)
        move = np.zeros_like(w)
        for _ in range(400):
            p = self._softmax(x @ w.T + b)
            err = (hot - p) * share[:, None]
            move = 0.9 * move + err.T @ x
            w += 3.0 * move
            b += 3.0 * err.sum(0)
            w = np.sign(w) * np.maximum(np.abs(w) - 6e-4, 0)  # the penalty that keeps weights sparse
        xh, yh = self._matrix(held), np.array([at[f] for _, f in held])
        z = xh @ w.T + b
        loss = {t: -np.log(self._softmax(z * t)[np.arange(len(yh)), yh] + 1e-9).mean() for t in np.linspace(0.3, 3, 28)}
        self.temperature = min(loss, key=loss.get)
        self.used = np.flatnonzero(np.abs(w).sum(0))
        self.weights, self.bias = np.round(w[:, self.used] * self.temperature, 4), np.round(b * self.temperature, 4)

    @staticmethod
    def _matrix(examples: list[tuple[str, str]]) -> np.ndarray:
        x = np.zeros((len(examples), BUCKETS), np.float32)
        for i, (text, _) in enumerate(examples):
            x[i, [_bucket(g) for g in _grams(text)]] = 1
        return x

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _strings(xs) -> str:
    return "array(" + ", ".join(f"'{x}'" for x in xs) + ")"


def _numbers(xs) -> str:
    return "array(" + ", ".join(f"{float(x):.4f}D" for x in xs) + ")"


def scan(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with n_paragraphs, n_findings, licenses (confirmed, sorted) and findings of each row.

    A finding: paragraph (from 0), family, probability, similarity, confirmed; families of probability
    ``LEAST`` or more, and ``unknown``.
    """
    rows = docs.select(*[col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    # negatives: eight lines of a part of each sampled text, wherever a hash says
    start = 1 + F.pmod(F.xxhash64("text", F.lit(7)), F.greatest(F.length("text") - 4000, F.lit(1))).cast("int")
    few = hashed_sample(rows.select(F.substring("text", start, F.lit(4000)).alias("text")), "text", SAMPLE_LINES // 4, ["text"]).selectExpr("slice(split(text, '\n'), 1, 8) AS lines").collect()
    gate = re.compile("|".join(map(re.escape, ANCHORS)))
    lines = [x for r in sorted(few) for x in r["lines"] if not gate.search(x.lower())][:SAMPLE_LINES]
    model = LicenceModel(lines)
    k = len(model.names)
    place = np.zeros(BUCKETS, int)
    place[model.used] = np.arange(1, len(model.used) + 1)
    has = lambda c: " OR ".join(f"contains({c}, '{a}')" for a in dict.fromkeys(a.replace("-", " ") for a in ANCHORS))
    # anchors may be broken over lines: the gate of whole texts asks for each anchor's last word, and for cc as a word
    last = " OR ".join(f"contains(low, '{a}')" for a in dict.fromkeys(re.split("[ -]", a)[-1] for a in ANCHORS if a[:3] not in ("cc ", "cc-")))
    last += " OR contains(low, 'cc') AND low RLIKE '(?<![a-z0-9])cc[^a-z0-9]+by'"
    df = rows.withColumn("low", F.lower("text"))
    df = df.withColumn("n_paragraphs", F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).drop("text")
    df = df.withColumn("l", F.expr(f"CASE WHEN {last} THEN transform(split(low, '\n'), t -> array_remove(split(t, '[^a-z0-9]+'), '')) END")).drop("low")
    most, blank = SPANS[-1], "CAST(array() AS array<string>)"
    after = f"transform(sequence(0, size(l) - 1), i -> named_struct('i', i, 'a', l[i], 'f', IF(size(l[i]) = 0, array({blank}), slice(l, i + 2, {most}))))"
    after = f"transform({after}, x -> named_struct('i', x.i, 'a', x.a, 'f', IF(array_contains(x.f, {blank}), slice(x.f, 1, CAST(array_position(x.f, {blank}) AS int) - 1), x.f)))"
    after = f"transform({after}, x -> named_struct('i', x.i, 'a', x.a, 'm', transform(x.f, y -> size(y)), 'r', slice(flatten(x.f), 1, {most})))"
    lines_of = "aggregate(x.m, named_struct('w', 0, 'n', 0), (s, m) -> IF(s.w >= y, s, named_struct('w', s.w + m, 'n', s.n + 1)), s -> s.n)"
    spans = f"filter(array({', '.join(map(str, SPANS))}), (y, j) -> size(x.r) > array({', '.join(map(str, [0, *SPANS[:-1]]))})[j])"
    wide = f"transform({spans}, y -> named_struct('paragraph', x.i, 'n', {lines_of}, 'w', concat(slice(x.a, greatest(1, size(x.a) - {most - 1}), {most}), slice(x.r, 1, y))))"
    windows = f"flatten(transform({after}, x -> concat(array(named_struct('paragraph', x.i, 'n', 0, 'w', x.a)), {wide})))"
    joined = "transform(filter(transform({}, x -> named_struct('x', x, 't', array_join(x.w, ' '))), y -> {}), y -> y.x)"
    df = df.withColumn("c", F.expr(f"CASE WHEN l IS NOT NULL THEN {joined.format(windows, has('y.t'))} END")).drop("l")
    df = df.withColumn("c", F.expr("transform(c, x -> named_struct('paragraph', x.paragraph, 'n', x.n, 'g', array_distinct(concat(x.w, IF(size(x.w) < 2, CAST(array() AS array<string>), transform(sequence(1, size(x.w) - 1), i -> concat(x.w[i - 1], ' ', x.w[i])))))))"))
    df = df.withColumn("c", F.expr(f"transform(c, x -> named_struct('paragraph', x.paragraph, 'n', x.n, 'g', x.g, 'b', filter(array_distinct(transform(x.g, g -> array({', '.join(map(str, place))})[CAST(pmod(xxhash64(g), {BUCKETS}) AS int)])), b -> b > 0)))"))
    table = "array(" + ", ".join(_numbers(model.weights[i]) for i in range(k)) + ")"
    df = df.withColumn("c", F.expr(f"transform(c, x -> named_struct('paragraph', x.paragraph, 'n', x.n, 'g', x.g, 'z', transform(sequence(0, {k - 1}), k -> {_numbers(model.bias)}[k] + aggregate(x.b, 0D, (s, b) -> s + {table}[k][b - 1]))))"))
    df = df.withColumn("c", F.expr("transform(c, x -> named_struct('paragraph', x.paragraph, 'n', x.n, 'g', x.g, 'k', CAST(array_position(x.z, array_max(x.z)) AS int) - 1, 'p', 1D / aggregate(x.z, 0D, (s, z) -> s + exp(z - array_max(x.z)))))"))
    grams = "array(" + ", ".join("array(" + ", ".join(_strings(g for g in _grams(t) if " " in g) for t in NOTICES.get(n, [])) + ")" if n in NOTICES else "CAST(array() AS array<array<string>>)" for n in model.names) + ")"
    similar = f"coalesce(array_max(transform({grams}[x.k], t -> size(array_intersect(t, x.g)) / size(t))), 0D)"
    df = df.withColumn("c", F.expr(f"transform(filter(c, x -> x.k < {k - 1} AND (x.p >= {LEAST}D OR x.k = {k - 2})), x -> named_struct('paragraph', x.paragraph, 'n', x.n, 'family', {_strings(model.names)}[x.k], 'probability', x.p, 'similarity', {similar}))"))
    df = df.withColumn("c", F.expr(f"transform(c, x -> named_struct('paragraph', x.paragraph, 'n', x.n, 'family', x.family, 'probability', x.probability, 'similarity', x.similarity, 'confirmed', x.similarity >= {CONFIRM}D))"))
    # a window goes if a shorter one or one that begins later inside it has the same family confirmed, or if it is unsure and there is any
    each = len(SPANS) + 1  # passages that begin at a line, at most
    near = f"slice(c, greatest(1, i + 2 - {each}), {each + each * most})"
    inside = "(y.paragraph > x.paragraph AND y.paragraph <= x.paragraph + x.n OR y.paragraph = x.paragraph AND y.n < x.n)"
    told = f"exists({near}, y -> IF(x.confirmed, {inside} AND y.confirmed AND y.family = x.family, {inside} OR y.paragraph = x.paragraph AND y.confirmed))"
    df = df.withColumn("c", F.expr(f"filter(c, (x, i) -> x.n = 0 OR NOT {told})"))
    # part of a notice can be like that of a kindred family: the better one of overlapping windows stays
    kindred = "CASE x.family " + " ".join(f"WHEN '{a}' THEN {_strings(kin)}" for a in NOTICES if (kin := _kindred(a))) + " ELSE CAST(array() AS array<string>) END"
    better = f"exists({near}, y -> y.confirmed AND y.similarity > x.similarity AND y.paragraph <= x.paragraph + x.n AND x.paragraph <= y.paragraph + y.n AND array_contains({kindred}, y.family))"
    df = df.withColumn("c", F.expr(f"filter(c, (x, i) -> x.n = 0 OR NOT x.confirmed OR NOT {better})"))
    found = F.expr("coalesce(transform(c, x -> named_struct('paragraph', x.paragraph, 'family', x.family, 'probability', x.probability, 'similarity', x.similarity, 'confirmed', x.confirmed)), CAST(array() AS array<struct<paragraph:int,family:string,probability:double,similarity:double,confirmed:boolean>>))")
    df = df.withColumn("findings", found).drop("c")
    sure = F.expr("array_sort(array_distinct(transform(filter(findings, x -> x.confirmed), x -> x.family)))")
    return df.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(kept_names(keep, ["n_paragraphs", "n_findings", "licenses", "findings"]))], F.col("n_paragraphs").cast("int").alias("n_paragraphs"), F.size("findings").alias("n_findings"), sure.alias("licenses"), "findings")
