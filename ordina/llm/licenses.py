"""License scans: sparse TF-IDF cosine of text segments to templates, then nearest-ancestor inheritance. SQL functions only."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: License -> texts that grant it: SPDX tags, notices, and the public texts or the headers that they ask for. Each
#: segment of them (see ``segments``) is a template by itself.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0.",
        "This project is licensed under the terms of the Apache License 2.0.",
        "Licensed to you under the terms of the Apache License 2.0.",
        "Apache License\n\nVersion 2.0, January 2004",
        "Apache License Version 2.0, January 2004",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 ",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "SPDX-License-Identifier: MIT",
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Licensed to you under the terms of the MIT license.",
        "The MIT License (MIT)",
        "MIT License",
        "Permission is hereby granted, free of charge, to any person "
        "obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: ",
        "The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.",
    ),
    "ISC": (
        "SPDX-License-Identifier: ISC",
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "GPL": (
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This work is licensed under the GNU General Public License, version 3.",
        "This project is licensed under the terms of the GNU General Public License.",
        "Released under the GNU GPL version 2.",
        "GNU GENERAL PUBLIC LICENSE",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License "
        "for more details. You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": (
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation",
    ),
    "BSD": (
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Released under the BSD License.",
        "This project is licensed under the terms of the BSD 3-Clause License.",
        "BSD 3-Clause License",
        "BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ),
    "MPL-2.0": (
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/ ",
    ),
    "CC-BY-NC": (
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Creative Commons Attribution-NonCommercial 4.0 International",
    ),
    "CC-BY-SA": (
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Creative Commons Attribution-ShareAlike 4.0 International",
    ),
    "CC-BY": (
        "SPDX-License-Identifier: CC-BY-4.0",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Creative Commons Attribution 4.0 International",
    ),
    "CC0": (
        "SPDX-License-Identifier: CC0-1.0",
        "Dedicated to the public domain under CC0 1.0.",
        "CC0 1.0 Universal",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights "
        "to this software to the public domain worldwide.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Proprietary and confidential.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "This software is the confidential and proprietary information of the company",
    ),
}
#: Least cosine of a segment to a template.
COSINE = 0.7
#: A file is a licence file when its name says so, or when this share of its words stands in licence segments.
COVERAGE = 0.5
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.-][a-z0-9]+)?$"

_WORDS = r"[a-z0-9]+"
#: Words of any English text: as terms they have the least IDF, 1, as if every segment had them.
_USUAL = frozenset("a about all also an and any are as at be been but by can do for from had has have he her his i if in including into is it its may more no not of on one only or other our out s see she should so such than that the their them then there these they this to up used use was we were what when which who will with without would you your".split())
#: Where a line, and a paragraph, is parted into segments: behind the end of a sentence.
_ENDS = {"line": r"[.!?;]+[ \t\r]+", "paragraph": r"[.!?;]+[ \t\r\n]+"}
_PARAGRAPH = r"\n[ \t\r]*\n"


def _terms(text: str) -> list[str]:
    return re.findall(_WORDS, text.lower())


def segments(text: str) -> list[tuple[str, str]]:
    """(kind, segment): sentences of each line, and those sentences of each paragraph that run over a line end."""
    low = text.lower()
    out = [("line", s) for x in low.split("\n") for s in re.split(_ENDS["line"], x)]
    return out + [("paragraph", s) for x in re.split(_PARAGRAPH, low) for s in re.split(_ENDS["paragraph"], x) if "\n" in s]


def vectors(templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> tuple[list[tuple[str, int, str, float, float]], float]:
    """(license, template number, term, unit TF-IDF weight, IDF) rows, and the squared IDF of a term in no template.

    Segments of one term are no templates. Usual words weigh little, so none has to be left out; those in no template
    are rows without weight, of template -1.
    """
    found = dict.fromkeys((name, s) for name, texts in templates.items() for t in texts for kind, s in segments(t) if kind == "line")
    lines = [(name, Counter(_terms(s))) for name, s in found if len(_terms(s)) > 1]
    seen = Counter(term for _, c in lines for term in c)
    idf = lambda term: 1.0 if term in _USUAL else 1 + math.log((1 + len(lines)) / (1 + seen[term]))
    rows = []
    for i, (name, terms) in enumerate(lines):
        norm = math.sqrt(sum((n * idf(t)) ** 2 for t, n in terms.items()))
        rows += [(name, i, t, n * idf(t) / norm, idf(t)) for t, n in terms.items()]
    rows += [("", -1, t, 0.0, 1.0) for t in sorted(_USUAL - set(seen))]
    return rows, (1 + math.log(1 + len(lines))) ** 2


def telling(rows: list[tuple[str, int, str, float, float]], cosine: float) -> list[str]:
    """Terms of which any segment that reaches ``cosine`` has at least one.

    By Cauchy's inequality a segment's cosine to a template is at most the root of the squared weights of the terms
    that they share. So of each template's terms, the most common first, those may be left out whose squares
    add up to less than the squared cosine.
    """
    out = set()
    for template in {r[1] for r in rows}:
        left = cosine**2
        for _, _, term, weight, _ in sorted((r for r in rows if r[1] == template), key=lambda r: (r[4], r[3], r[2])):
            left -= weight**2
            if left <= 1e-9:
                out.add(term)
    return sorted(out)


def _one_of(words: list[str]) -> str:
    """A regular expression for any of the words, which share their prefixes, so that few ways are tried at a place."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    if len(heads) == 1 and "" in heads:
        return ""
    parts = [c + _one_of(rest) for c, rest in sorted(heads.items()) if c]
    out = parts[0] if len(parts) == 1 and "" not in heads else f"(?:{'|'.join(parts)})"
    return out + "?" if "" in heads and out[:3] == "(?:" else f"(?:{out})?" if "" in heads else out


def _reachable(rows: list[tuple[str, int, str, float, float]], unknown: float, cosine: float) -> Column:
    """False where a segment's ``terms`` that no template has outweigh the others too far to reach ``cosine``.

    The squared cosine is at most the share of the segment's squared norm that lies in template terms. Each other
    distinct term adds at least ``unknown``, and template terms at most the square of the sum of their IDF.
    """
    usual = sorted({r[2] for r in rows if r[4] == 1.0})
    rare = sorted({r[2] for r in rows} - set(usual))
    most = max(r[4] for r in rows)
    count = lambda words: F.size(F.filter("terms", lambda w: w.isin(*words)))
    outside = F.size(F.filter(F.array_distinct("terms"), lambda w: ~w.isin(*usual, *rare)))
    return outside * F.lit(unknown) <= (1 / cosine**2 - 1) * F.pow(count(usual) + count(rare) * F.lit(most), F.lit(2)) + F.lit(1e-6)


def _segments(low: Column) -> Column:
    """As ``segments``, of a lower-cased text."""
    part = lambda kind, x: F.transform(F.split(x, _ENDS[kind]), lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("s")))
    lines = F.flatten(F.transform(F.split(low, "\n"), lambda x: part("line", x)))
    wrapped = F.flatten(F.transform(F.split(low, _PARAGRAPH), lambda x: part("paragraph", x)))
    return F.concat(lines, F.filter(wrapped, lambda x: F.contains(x["s"], F.lit("\n"))))


def segment_licenses(df: DataFrame, templates: Mapping[str, tuple[str, ...]] = TEMPLATES, cosine: float = COSINE) -> DataFrame:
    """(key, license, score, covered, n_terms) of ``df`` (key, text): each file's best segment, over the whole text.

    Scores are rounded to six decimals, so of licenses that tie, the last by name counts. covered: words in licence
    segments (of lines or of paragraphs, whichever are more), of the text's n_terms. Segments without a ``telling``
    term, and those with too many other terms, cannot reach the cosine and leave before the join with the template
    terms, a table of a fixed few hundred rows.
    """
    spark: SparkSession = df.sparkSession
    rows, unknown = vectors(templates)
    terms = spark.createDataFrame(rows, "license string, template int, term string, weight double, idf double")
    weights = F.broadcast(terms.groupBy("term").agg(F.collect_list(F.struct("license", "template", "weight")).alias("in"), F.first("idf").alias("idf")))
    sign = rf"(?<![a-z0-9]){_one_of(telling(rows, cosine))}(?![a-z0-9])"
    words = lambda c: F.regexp_extract_all(c, F.lit(_WORDS), F.lit(0))
    low = df.select("key", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("low")).filter(F.col("low").rlike(sign))
    files = low.select("key", F.filter(_segments(F.col("low")), lambda x: x["s"].rlike(sign)).alias("parts"), F.regexp_count("low", F.lit(_WORDS)).alias("all_terms"))
    parts = files.select("key", "all_terms", F.posexplode("parts").alias("at", "part"))
    parts = parts.select("key", "at", "all_terms", "part.kind", words(F.col("part.s")).alias("terms")).filter(_reachable(rows, unknown, cosine))
    parts = common.stage(parts.select("key", "at", "all_terms", "kind", F.size("terms").alias("n_terms"), "terms"), "licence-candidates")
    keys = ["key", "at", "all_terms", "kind", "n_terms"]
    each = parts.select(*keys, F.explode("terms").alias("term"))
    met = each.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("tf")).join(weights, "term", "left")
    norm = met.groupBy(*keys).agg(F.sum(F.pow("tf", F.lit(2)) * F.coalesce(F.pow("idf", F.lit(2)), F.lit(unknown))).alias("norm2"))
    dots = met.filter("`in` IS NOT NULL").select("key", "at", "tf", "idf", F.explode("in").alias("t"))
    dots = dots.groupBy("key", "at", "t.license", "t.template").agg(F.sum(F.col("tf") * F.col("idf") * F.col("t.weight")).alias("dot"))
    found = dots.join(norm, ["key", "at"]).withColumn("score", F.round(F.col("dot") / F.sqrt("norm2"), 6)).filter(F.col("score") >= cosine)
    best = found.groupBy("key", "at", "kind").agg(F.max(F.struct("score", "license")).alias("b"), F.first("n_terms").alias("part_terms"), F.first("all_terms").alias("n_terms"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("part_terms"))), F.lit(0))
    best = best.groupBy("key").agg(F.max("b").alias("b"), F.greatest(of("line"), of("paragraph")).alias("covered"), F.first("n_terms").alias("n_terms"))
    return best.select("key", "b.license", "b.score", "covered", "n_terms")


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row per file: path, license, score, origin ("own", "inherited" or "none"), license_dir.

    A file has the license of its best segment (a header, or any sentence of a licence file). A file without one
    inherits that of the nearest directory above it that holds a licence file; of several licence files in one
    directory, the one with the best score, then the smallest path.

    * null or empty text has no segment and may inherit; a null path is the root's file "";
    * repeated rows share a path and count once as licence file: each row comes out again;
    * an empty table gives an empty result; other columns are not read.

    Directories, not files, are joined with their ancestors; a directory with a third of all files is one row
    there, and its answer is broadcast to its files as one of at most HOT_SHARE hot ones.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    rows = files.select(path.alias("path"), F.col(text_col).cast("string").alias("text"), F.xxhash64(path, F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("th"))
    keyed = rows.select(F.struct("path", "th").alias("key"), "text")
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    found = common.stage(segment_licenses(keyed).select("key.path", "key.th", "license", "score", "covered", "n_terms"), "licence-found")
    own = rows.select("path", "th", directory.alias("dir"))
    own = own.join(F.broadcast(found) if common.few(found) else found, ["path", "th"], "left")
    own = common.stage(own.drop("th"), "licence-own")

    name = F.regexp_extract("path", r"[^/]*$", 0)
    grants = own.filter("license IS NOT NULL").filter(name.rlike(LICENSE_FILE) | (F.col("covered") >= COVERAGE * F.col("n_terms")))
    best = F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), F.col("path"))).alias("g")
    granted = common.stage(grants.groupBy("dir").agg(best).select(F.col("dir").alias("license_dir"), "g.license", "g.score"), "licence-dirs")

    dirs = common.stage(own.groupBy("dir").agg(F.count(F.lit(1)).alias("n")), "licence-all-dirs")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    steps = dirs.select("dir", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), above))).alias("license_dir"))
    deepest = F.max(F.struct(F.length("license_dir").alias("depth"), "license_dir", "license", "score")).alias("d")
    nearest = steps.join(granted, "license_dir").groupBy("dir").agg(deepest)
    nearest = common.stage(dirs.join(nearest, "dir", "left").select("dir", "n", F.col("d.license_dir").alias("up_dir"), F.col("d.license").alias("up"), F.col("d.score").alias("up_score")), "licence-nearest")
    met = common.lookup(own, nearest, ["dir"], "n", own.count())
    mine = F.col("license").isNotNull()
    origin = F.when(mine, "own").when(F.col("up").isNotNull(), "inherited").otherwise("none")
    return met.select("path", F.coalesce("license", "up").alias("license"), F.when(mine, F.col("score")).otherwise(F.col("up_score")).alias("score"), origin.alias("origin"), F.when(~mine, F.col("up_dir")).alias("license_dir"))
