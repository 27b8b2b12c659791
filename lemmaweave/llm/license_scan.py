"""Licence scan: sparse TF-IDF cosine to templates, then inheritance by directory.

Files are (path, text).  The units of a file are its lines, its sentences, its
paragraphs (between lines without a letter or digit, as in comment headers) and,
of a licence file, its whole text; each is compared with every template: short
notices, header paragraphs as licences ask for them, the openings of full texts.
Document frequencies are those of the templates, but that words of any prose weigh
little; a term of no template has the weight of one seen nowhere, so foreign words
lower the cosine.  The greatest
cosine of a file names its licence, if it reaches a threshold.

Most texts need no split: a unit that shares none of the heaviest terms of a
template stays below the threshold whatever else it says (the rest of the
template's norm is too small), and only texts with such a term are looked into.
Of their units, those go on in which known terms are a large enough part of the
norm: no cosine exceeds that part.

A directory takes the licence of its licence files; a file without a licence of
its own inherits from the nearest ancestor directory that has one, by joins on
path prefixes.

Defined results: null or blank texts have no unit; a null path has no directory
and inherits nothing; ties go to the greater cosine, then the smaller template
name; a directory whose licence files differ takes the best one and counts them
in n_licenses; rows that repeat a file key are scanned as one file and each gives
a row; an empty table gives an empty table.  Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Notices, headers and openings by licence (fixed values).
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "BSD 2-Clause License",
    ),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Use of this source code is governed by a BSD-style license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "BSD 3-Clause License",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "ISC License",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License", "Licensed under the MIT License", "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License Version 2.0",
    ),
}
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
THRESHOLD = 0.6
#: Words of any prose and what they weigh at most (fixed values): templates alone are too few to show that they are common.
LIGHT = 0.5
COMMON = frozenset("a all an and any are as at be by can do for from if in is it its may must not of on one or see that the this to under use used was with without work you your".split())
#: A sentence ends where a capital follows; a paragraph at a line without a letter or digit.
SENTENCE_END, PARAGRAPH_END = r"([.!?])[ \t\r\n]+(\p{Lu})", r"\n[^\p{L}\p{N}\n]*\n"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


class Model:
    """TF-IDF of the templates: idf by term, unit vectors, and the terms of which a match needs one."""

    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD):
        parts = [(name, i, Counter(re.findall(TERM, text.lower()))) for name, texts in sorted(templates.items()) for i, text in enumerate(texts)]
        seen = Counter(term for _, _, counts in parts for term in counts)
        self.foreign = math.log(1 + len(parts)) + 1
        self.idf = {term: min(math.log((1 + len(parts)) / (1 + n)) + 1, LIGHT if term in COMMON else math.inf) for term, n in seen.items()}
        self.vectors: list[tuple[str, int, str, float]] = []
        needed = set()
        for name, i, counts in parts:
            weights = {term: (1 + math.log(n)) * self.idf[term] for term, n in counts.items()}
            whole = sum(w * w for w in weights.values())
            self.vectors += [(name, i, term, w / math.sqrt(whole)) for term, w in weights.items()]
            # by Cauchy and Schwarz, terms of a small part of the norm alone can't reach the threshold: as many
            # common words as fit are such a part, then the lightest terms
            rest = 0.0
            for term in sorted(weights, key=lambda t: (t not in COMMON, weights[t], t)):
                if rest + weights[term] ** 2 < (threshold * threshold - 1e-6) * whole:
                    rest += weights[term] ** 2
                else:
                    needed.add(term)
        self.needed = sorted(needed)
        # a term begins and ends where no letter or digit stands
        fronts = [(front, [t[1:] for t in self.needed if t[0] == front]) for front in sorted({t[0] for t in self.needed})]
        self.pattern = f"(?<![a-z0-9])(?:{'|'.join(front + '(?:' + '|'.join(map(re.escape, rest)) + ')' for front, rest in fronts)})(?![a-z0-9])"

    def tables(self, spark) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
        """(term, idf) and (license, part, term, t_w): as many rows as the templates have terms."""
        return spark.createDataFrame(sorted(self.idf.items()), "term string, idf double"), spark.createDataFrame(self.vectors, "license string, part int, term string, t_w double")


def known_part(words: Column, model: Model) -> Column:
    """An upper bound of the cosine of a unit with any template: the part of its norm in known terms, if each of them
    were every word and each foreign term stood once."""
    # one literal each, split once by the optimizer: hundreds of literals would make the plan slow
    names = F.split(F.lit(" ".join(sorted(model.idf))), " ")
    squares = F.map_from_arrays(names, F.split(F.lit(" ".join(repr(model.idf[t] ** 2) for t in sorted(model.idf))), " ").cast("array<double>"))
    different = F.array_distinct(words)
    known = F.aggregate(F.array_intersect(different, names), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda t, v: F.struct((t["s"] + F.element_at(squares, v)).alias("s"), (t["n"] + 1).alias("n")),
                        lambda t: t["s"] / F.greatest(F.size(different) - t["n"], F.lit(1e-9)))
    # null, which is no match, where there is no known term
    return F.sqrt(1 / (1 + F.try_divide(F.lit(model.foreign**2), F.pow(1 + F.log(F.size(words)), 2) * known)))


def units(files: DataFrame, model: Model, threshold: float) -> DataFrame:
    """file, unit (number), words of every unit that can match.  files: file, text, is_license."""
    mark = "\x1e"
    sentences = F.split(F.regexp_replace("text", SENTENCE_END, f"$1{mark}$2"), mark)
    whole = F.when(F.col("is_license"), F.array("text")).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(sentences, F.split("text", "\n"), F.split("text", PARAGRAPH_END), whole))
    hit = files.where(F.lower("text").rlike(model.pattern)).select("file", F.xxhash64("text", "is_license").alias("_row"), every.alias("_every"))
    rows = hit.select("file", "_row", F.explode_outer("_every").alias("text")).withColumn("words", terms(F.col("text")))
    # a step that filters can't be pushed through: the optimizer would evaluate all of it again for each use
    stay = F.spark_partition_id() * F.lit(0.0)
    rows = rows.withColumn("_part", known_part(F.col("words"), model) + stay).where(F.col("_part") >= threshold - 1e-6)
    return rows.select("file", F.xxhash64("_row", "text").alias("unit"), "words").dropDuplicates(["file", "unit"])


def scores(files: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """file, unit, license, score for every template and unit that share a term and may reach the threshold."""
    idf, vectors = (F.broadcast(t) for t in model.tables(files.sparkSession))
    counts = units(files, model, threshold).select("file", "unit", F.explode_outer("words").alias("term")).where("term is not null").groupBy("file", "unit", "term").agg(F.count("*").alias("tf"))
    rows = cut(counts.join(idf, "term", "left").select("file", "unit", "term", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(model.foreign))).alias("w")))
    norm = rows.groupBy("file", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = rows.join(vectors, "term").groupBy("file", "unit", "license", "part").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"))
    return dots.join(norm, ["file", "unit"]).groupBy("file", "unit", "license").agg(F.max(F.round(F.col("dot") / F.col("norm"), 6)).alias("score"))


def own_licenses(files: DataFrame, threshold: float = THRESHOLD, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """file, license, score, n_notices (units above the threshold), n_found (different licences that are best in a unit)."""
    best = scores(files, Model(templates, threshold), threshold).groupBy("file", "unit").agg(F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("license"))).alias("b"))
    best = best.select("file", "b.license", "b.score").where(F.col("score") >= threshold)
    return best.groupBy("file").agg(
        F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("license"))).alias("b"),
        F.count("*").alias("n_notices"), F.countDistinct("license").alias("n_found"),
    ).select("file", "b.license", "b.score", "n_notices", "n_found")


def folder(path: Column) -> Column:
    """The directory of a path; files at the top are in the empty one."""
    return F.when(path.isNotNull(), F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def ancestors(directory: Column) -> Column:
    """The directory and all above it, the empty one last."""
    parts = F.split(directory, "/")
    up = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.array_distinct(F.concat(up, F.array(F.lit(""))))


def licensed(files: DataFrame, threshold: float = THRESHOLD, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """path, file, license, basis (own, inherited, none), score, from_dir, n_licenses of that directory.

    files: file (a key), path, text, is_license (this file licenses its directory).
    """
    found = own_licenses(files.select("file", "text", F.coalesce("is_license", F.lit(False)).alias("is_license")), threshold, templates)
    places = files.select("file", "path", "is_license", folder(F.col("path")).alias("dir"))
    rows = places.join(found, "file", "left")
    given = rows.where("is_license and license is not null and dir is not null").groupBy("dir").agg(
        F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("license"))).alias("g"), F.countDistinct("license").alias("n_licenses")
    )
    # each directory once, then each of its ancestors: rows grow with directories times depth
    dirs = places.where("dir is not null").select("dir").distinct()
    up = dirs.select("dir", F.posexplode_outer(ancestors(F.col("dir"))).alias("distance", "from_dir"))
    near = up.join(given.withColumnRenamed("dir", "from_dir"), "from_dir").groupBy("dir").agg(F.min_by(F.struct("from_dir", "g", "n_licenses"), "distance").alias("i"))
    out = rows.join(near, "dir", "left")
    own = F.col("license").isNotNull()
    return out.select(
        "file", "path", F.coalesce("license", "i.g.license").alias("license"),
        F.when(own, "own").when(F.col("i").isNotNull(), "inherited").otherwise("none").alias("basis"),
        F.coalesce("score", "i.g.score").alias("score"),
        F.when(~own, F.col("i.from_dir")).alias("from_dir"), F.when(~own, F.col("i.n_licenses")).alias("n_licenses"),
    )
