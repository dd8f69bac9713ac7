"""License scans: MinHash bands of overlapping windows, then shingle containment."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.decontaminate import shingle_hashes
from fleetlens.llm.texts import small, stage_counted
from fleetlens.sources.sinks import stage

# Public license notices and passages of license texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    (
        "MIT",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a "
        "copy of the software and accompanying documentation covered by this license (the "
        '"Software") to use, reproduce, display, distribute, execute, and transmit the Software',
    ),
    (
        "BSL-1.0",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE "
        "DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the "
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version.",
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version.",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor "
        "the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Unlicense",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event "
        "will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely",
    ),
    (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License 2.0 which is available at",
    ),
    (
        "CC0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work.",
    ),
)

# Tokens are runs of letters and digits.
BREAKS = r"[^\p{L}\p{N}]+"


@dataclass(frozen=True)
class LicenseRules:
    """Shingles of ``width`` tokens in windows of ``window`` shingles, ``stride`` apart.

    A longer template is cut into windows at every place, so a verbatim passage has
    windows equal to some of them, which always collide. A shorter one is one window;
    with the defaults it reaches a similarity of 3/7 at least, and with one row in
    each of 16 bands it collides with a probability of more than 0.9998.

    Templates of which one holds ``rival_percent`` of the other's shingles are rivals: of those found
    around one place only the best is reported.
    """

    width: int = 3
    window: int = 6
    stride: int = 4
    bands: int = 16
    min_percent: int = 80
    rival_percent: int = 60


def tokens(text: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), BREAKS)
    return F.filter(parts, lambda t: t != "")


def band_values(window: str, rules: LicenseRules) -> Column:
    """The MinHash of a window under each of the masks.

    Flipping the bits of a mask orders the hashes anew; the least one is the
    coordinate. It is flipped back into the shingle and hashed with its band.
    """
    masks = F.array(*(F.xxhash64(F.lit(f"mask {k}")) for k in range(rules.bands)))
    return F.transform(
        masks,
        lambda m, k: F.xxhash64(
            k, F.array_min(F.transform(F.col(window), lambda h: h.bitwiseXOR(m)))
        ),
    )


def families(
    templates: Sequence[tuple[str, str]], rules: LicenseRules
) -> list[tuple[int, int]]:
    """(family, depth) of each template: rivals share a family, and depth counts those it holds whole."""
    sets = []
    for _, text in templates:
        found = re.findall(r"[^\W_]+", text.lower())
        sets.append({tuple(found[i : i + rules.width]) for i in range(len(found) - rules.width + 1)})
    family = list(range(len(sets)))
    depth = [0] * len(sets)
    for a, one in enumerate(sets):
        for b, other in enumerate(sets):
            if a == b or not one:
                continue
            if 100 * len(one & other) >= rules.rival_percent * len(one):
                old, new = family[b], family[a]
                family = [new if f == old else f for f in family]
            if one < other:
                depth[b] += 1
    return list(zip(family, depth, strict=True))


def template_table(spark, rules: LicenseRules, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """(template, license, family, depth, shingles); templates shorter than a shingle are left out."""
    related = families(templates, rules)
    rows = [(i, name, *related[i], text) for i, (name, text) in enumerate(templates)]
    frame = spark.createDataFrame(rows, "template INT, license STRING, family INT, depth INT, text STRING")
    return (
        frame.withColumn("found", tokens(F.col("text")))
        .select(
            "template", "license", "family", "depth", shingle_hashes("found", rules.width).alias("shingles")
        )
        .filter("size(shingles) > 0")
    )


def license_passages(
    docs: DataFrame,
    rules: LicenseRules = LicenseRules(),
    templates: Sequence[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """License passages in documents.

    Returns (doc_id, license, containment, first_token): for each document and license
    the greatest share of a template's distinct shingles that lies in the text around
    one window, and the first token of the first such window. Of rivals, templates that hold most
    of each other, a passage counts for the one with the greatest share; of equal shares one that
    holds the other whole wins, else both count.

    Windows that share a shingle with some template are hashed into bands and joined with those of the
    templates; any other window cannot collide, as a band is one row. Containment is counted on the
    shingles from one template length before a window that collides to one behind it.

    Null and empty texts, and texts shorter than a shingle, have no window; rows that
    repeat a doc_id count together. Building it stages templates and collisions.
    """
    known, n_known = stage_counted(template_table(docs.sparkSession, rules, templates), "license-templates")
    spread = known.select(
        "template",
        F.expr(
            f"explode(transform(sequence(1, greatest(1, size(shingles) - {rules.window - 1})), "
            f"i -> slice(shingles, i, {rules.window})))"
        ).alias("w"),
    )
    marks, n_marks = stage_counted(
        spread.select("template", F.explode(band_values("w", rules)).alias("band")).distinct(),
        "license-bands",
    )

    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    )

    def hashed(frame: DataFrame) -> DataFrame:
        # Out of a generator: a filter on the shingles, pushed below them, would split a text once per shingle.
        found = frame.select("doc_id", F.xxhash64("text").alias("row"), tokens(F.col("text")).alias("found"))
        row = F.struct("row", shingle_hashes("found", rules.width).alias("hashes"))
        return found.select("doc_id", F.inline(F.array(row)))

    # Places of template shingles, and the windows they lie in.
    vocabulary, n_vocabulary = stage_counted(
        known.select(F.explode("shingles").alias("hash")).distinct(), "license-shingles"
    )
    places = hashed(texts).select("doc_id", "row", F.posexplode("hashes").alias("at", "hash"))
    first = f"greatest(0, (at - {rules.window} + {rules.stride}) div {rules.stride} * {rules.stride})"
    touched, _ = stage_counted(
        places.join(small(vocabulary, n_vocabulary), "hash")
        .select("doc_id", "row", F.expr(f"explode(sequence({first}, at, {rules.stride})) AS start"))
        .distinct(),
        "license-touched",
    )
    ids, n_ids = stage_counted(touched.select("doc_id").distinct(), "license-ids")
    again = hashed(texts.join(small(ids, n_ids), "doc_id", "left_semi")).dropDuplicates(["doc_id", "row"])
    again = stage(again, "license-texts")
    banded = touched.join(again, ["doc_id", "row"]).select(
        "doc_id", "row", "start", F.expr(f"slice(hashes, start + 1, {rules.window}) AS w")
    ).select("doc_id", "row", "start", F.explode(band_values("w", rules)).alias("band"))
    collisions, _ = stage_counted(
        banded.join(small(marks, n_marks), "band")
        .select("doc_id", "row", "start", "template")
        .distinct(),
        "license-collisions",
    )
    around = F.expr(
        f"slice(hashes, greatest(1, start + 1 - size(shingles)), 2 * size(shingles) + {rules.window})"
    )
    checked = (
        collisions.join(again, ["doc_id", "row"])
        .join(small(known, n_known), "template")
        .select(
            "doc_id",
            "row",
            "license",
            "family",
            "depth",
            "start",
            F.size(F.array_intersect(around, "shingles")).alias("shared"),
            F.size(F.array_distinct("shingles")).alias("total"),
        )
        .filter(100 * F.col("shared") >= rules.min_percent * F.col("total"))
        .withColumn("merit", F.struct((F.col("shared") / F.col("total")).alias("share"), "depth"))
    )
    reach = rules.window + rules.stride
    nearby = Window.partitionBy("doc_id", "row", "family").orderBy("start").rangeBetween(-reach, reach)
    return (
        checked.withColumn("best", F.max("merit").over(nearby))
        .filter(F.col("merit") == F.col("best"))
        .groupBy("doc_id", "license")
        .agg(F.max(F.struct("merit.share", (-F.col("start")).alias("less"))).alias("top"))
        .select(
            "doc_id",
            "license",
            F.col("top.share").alias("containment"),
            (-F.col("top.less")).cast("bigint").alias("first_token"),
        )
    )
