"""License scans: TF-IDF cosine to templates, then inheritance down directories.

A header is any line of the whole text that holds a license word; a licence file
(by its name) is compared as a whole, too. Both become sparse TF-IDF vectors, whose
cosine to each template decides: of the several templates of all licenses the best
counts if it reaches ``threshold``. A template that versions share names their family
(``GPL``), which counts if no version is stated; what a license must or must not say to be
that very one is checked on the line or file itself. A line that denies a license states
none; a tag (SPDX-License-Identifier) states what it says, whatever it is. Of a licence file
the first three lines are compared together, too. A file without a license of its own takes that of the nearest
directory above it that holds a licence file with one.

Null or empty texts have no license of their own. Of several licence files in one
directory the best match counts, then the smallest doc_id. Files with a null path
inherit nothing. Repeated rows are judged alike, and rows that share doc_id and path
share their best match; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackweave.llm.common import NO_GAP, materialize
from trackweave.llm.graphs import salted_join

#: How the licenses state themselves, by title, tag, notice and, if short, whole text.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Apache License",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License",
        "MIT License",
        "The MIT License (MIT)",
        "SPDX-License-Identifier: MIT",
        "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "GNU GENERAL PUBLIC LICENSE",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "it under the terms of the GNU General Public License as published by",
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3",
        "GNU LESSER GENERAL PUBLIC LICENSE",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "under the terms of the GNU Lesser General Public License as published by",
    ],
    "MPL-2.0": [
        "This source code form is subject to the terms of the Mozilla Public License, version 2.0",
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use under the BSD 3-Clause License is permitted",
        "BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistribution and use in source and binary forms, with or without",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "ISC": [
        "Permission to use under the ISC License is granted",
        "ISC License",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "Proprietary": ["Copyright. All rights reserved", "All rights reserved"],
}
TEMPLATES |= {
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "This library is licensed under the GNU Lesser General Public License, version 2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "GNU AFFERO GENERAL PUBLIC LICENSE",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "BSD-2-Clause": [
        "BSD 2-Clause License",
        "Redistribution and use under the BSD 2-Clause License is permitted",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal", "CC0 1.0 Universal", "Licensed under CC0 1.0"],
    "Unlicense": [
        "The Unlicense",
        "This is free and unencumbered software released into the public domain.",
    ],
    "EPL-2.0": ["Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0."],
}
#: Templates that versions share, by license and place, and the name of their family.
FAMILIES = {
    ("Apache-2.0", 1): "Apache",
    ("GPL-3.0", 1): "GPL",
    ("GPL-3.0", 6): "GPL",
    ("LGPL-3.0", 1): "LGPL",
    ("LGPL-3.0", 4): "LGPL",
    ("AGPL-3.0", 0): "AGPL",
    ("BSD-3-Clause", 4): "BSD",
    ("BSD-3-Clause", 5): "BSD",
    ("BSD-3-Clause", 6): "BSD",
}
#: What lower-cased text must hold, and must not hold, to state a license.
GUARDS = {
    "Apache-2.0": ("2\\.0", ""),
    "Apache": ("apache", ""),
    "MIT": ("mit|permission is hereby granted", ""),
    "GPL-3.0": ("(^|[^0-9.])v?3(\\.0)?($|[^0-9.]|\\.$|\\.[^0-9])|2007", "affero|lesser|library general"),
    "GPL-2.0": ("(^|[^0-9.])v?2(\\.0)?($|[^0-9.]|\\.$|\\.[^0-9])|1991", "affero|lesser|library general"),
    "GPL": ("general public", "affero|lesser|library general"),
    "LGPL-3.0": ("(lesser.*[^0-9.]3(\\.0)?($|[^0-9.]|\\.$|\\.[^0-9]))", "affero"),
    "LGPL-2.1": ("lesser.*2\\.1", "affero"),
    "LGPL": ("lesser", "affero"),
    "AGPL-3.0": ("affero.*[^0-9.]3(\\.0)?($|[^0-9.]|\\.$|\\.[^0-9])", ""),
    "AGPL": ("affero", ""),
    "MPL-2.0": ("mozilla.*2\\.0|mpl.*2\\.0", ""),
    "BSD-3-Clause": ("3-clause|endorse", "all advertising"),
    "BSD-2-Clause": ("2-clause|in the documentation and/or other materials", "endorse|all advertising|3-clause"),
    "BSD": ("redistribution", ""),
    "ISC": ("isc|provided that", ""),
    "CC-BY-4.0": ("4\\.0", "sharealike|noncommercial|noderiv|-sa|-nc|-nd"),
    "CC-BY-SA-4.0": ("4\\.0", "noncommercial|noderiv|-nc|-nd"),
    "CC-BY-NC-4.0": ("4\\.0", "sharealike|noderiv|-sa|-nd"),
    "CC0-1.0": ("cc0", ""),
    "Unlicense": ("unlicense|unencumbered", ""),
    "EPL-2.0": ("eclipse.*2\\.0", ""),
    "BSL-1.0": ("boost.*1\\.0", ""),
    "Proprietary": ("reserved", ""),
}
#: A line that says that something is not under a license.
DENIED = "(^|[^a-z])(not|never|no longer)( [a-z]+)?( [a-z]+)? (licen[sc]ed|released|distributed|available|published|covered|provided|offered)( [a-z]+)? (under|by)|n.t (licen[sc]ed|released|distributed|covered)"
#: A tag and its expression.
TAG = "[Ss][Pp][Dd][Xx]-License-Identifier: *([A-Za-z0-9.+-]+( (OR|AND|WITH) [A-Za-z0-9.+-]+)*)"
CUE = "(?i)licen[sc]e|copyright|rights reserved|spdx|redistribution|permission"
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENSE_FILE = "(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


Templates = dict[str, list[str]]


def every(templates: Templates) -> list[tuple[str, int, str]]:
    """(license, number, text) of all templates."""
    return [(name, k, text) for name, texts in sorted(templates.items()) for k, text in enumerate(texts)]


def idf(templates: Templates) -> dict[str, float]:
    texts = every(templates)
    seen = Counter(t for _, _, text in texts for t in set(terms(text)))
    return {t: 1 + math.log((1 + len(texts)) / (1 + n)) for t, n in sorted(seen.items())}


def unseen_idf(templates: Templates) -> float:
    return 1 + math.log(1 + len(every(templates)))


def template_weights(templates: Templates) -> list[tuple[str, int, str, float, float]]:
    """(license, number, term, normed weight, idf) of every template: as many rows as terms."""
    known, out = idf(templates), []
    for name, k, text in every(templates):
        count = Counter(terms(text))
        norm = math.sqrt(sum((n * known[t]) ** 2 for t, n in count.items()))
        out += [(name, k, t, n * known[t] / norm, known[t]) for t, n in sorted(count.items())]
    return out


def reported(templates: Templates) -> dict[tuple[str, int], tuple[str, int, int]]:
    """(name, tier, bit) of every template: versions come before families, and these before rights alone."""
    known = {(n, k): FAMILIES.get((n, k), n) if templates is TEMPLATES else n for n, k, _ in every(templates)}
    bit = {name: k for k, name in enumerate(sorted(set(known.values())))}
    tier = lambda key, name: 2 if name == "Proprietary" else int(name != key[0])
    return {key: (name, tier(key, name), bit[name]) for key, name in known.items()}


def may_state(text: Column, templates: Templates) -> Column:
    """A bit for each name that this lower-cased text may state, by the guards."""
    names = {name: bit for name, _, bit in reported(templates).values()}
    allowed = F.lit(0).cast("long")
    for name, bit in sorted(names.items()):
        need, forbid = GUARDS.get(name, ("", ""))
        fits = (F.rlike(text, F.lit(need)) if need else F.lit(True)) & (~F.rlike(text, F.lit(forbid)) if forbid else F.lit(True))
        allowed = allowed + F.when(fits, F.lit(1 << bit).cast("long")).otherwise(0)
    return allowed


def tags(files: DataFrame) -> DataFrame:
    """(doc_id, path, license) of each tag; the version says the same with and without ``-only`` or ``-or-later``."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TAG), F.lit(1))
    plain = lambda x: F.regexp_replace(x, "-(only|or-later)", "")
    return files.select("doc_id", "path", F.explode(F.array_distinct(F.transform(found, plain))).alias("license"))


def squared_counts(terms: Column) -> Column:
    """The sum of the squared numbers of each different term."""
    begin = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum"))

    def step(a: Column, t: Column) -> Column:
        again = t == a["last"]
        run = F.when(again, a["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(t.alias("last"), run.alias("run"), (a["sum"] + 2 * run - 1).alias("sum"))

    return F.aggregate(F.array_sort(terms), begin, step, lambda a: a["sum"])


def own_licenses(files: DataFrame, threshold: float = 0.7, templates: Templates | None = None) -> DataFrame:
    """(doc_id, path, own_license, own_score) of the rows of files(doc_id, path, text) that state one."""
    spark: SparkSession = files.sparkSession
    templates = templates or TEMPLATES
    names = reported(templates)
    rows = [(*names[name, k], k, term, w, i, name) for name, k, term, w, i in template_weights(templates)]
    weights = spark.createDataFrame(rows, "license string, tier int, bit int, template int, term string, weight double, idf double, of string")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    denied = lambda x: F.rlike(F.lower(x), F.lit(DENIED)) | F.rlike(x, F.lit(TAG))
    headers = F.filter(lines, lambda x: F.rlike(x, F.lit(CUE)) & ~denied(x))
    head = F.array_join(F.slice(F.filter(lines, lambda x: F.rlike(x, F.lit(NO_GAP))), 1, 3), " ")
    by_name = F.coalesce(F.rlike(F.col("path"), F.lit(LICENSE_FILE)), F.lit(False))
    units = F.when(by_name & F.rlike(text, F.lit(NO_GAP)), F.concat(headers, F.filter(F.array(head), lambda x: ~denied(x)), F.array(text))).otherwise(headers)
    each = files.where(by_name | F.rlike(text, F.lit(CUE))).select("doc_id", "path", F.explode(F.array_distinct(units)).alias("text"))
    # a unit goes by the hash of its text, which is not shuffled with every term
    # once a unit, before its terms are exploded: what it may state, and the sum of its squared counts
    unit = each.select("doc_id", "path", F.md5(F.col("text").cast("binary")).alias("unit"), F.lower("text").alias("low"))
    unit = unit.select("doc_id", "path", "unit", may_state(F.col("low"), templates).alias("allowed"), F.regexp_extract_all("low", F.lit(TERM), F.lit(0)).alias("terms"))
    unit = unit.withColumn("squares", squared_counts(F.col("terms")))
    vocabulary = weights.select("term", "idf").distinct()
    # of the terms only the templates' own are shuffled; their table is as small as the given templates
    keys = ["doc_id", "path", "unit", "allowed", "squares"]
    known = unit.select(*keys, F.explode("terms").alias("term")).join(F.broadcast(vocabulary), "term")
    tf = known.groupBy(*keys, "term", "idf").agg(F.count(F.lit(1)).alias("tf")).withColumn("w", F.col("tf") * F.col("idf"))
    unseen = F.lit(unseen_idf(templates))
    more = F.sum(F.col("tf") * F.col("tf") * (F.col("idf") * F.col("idf") - unseen * unseen))
    bags = tf.groupBy(*keys).agg(F.sqrt(unseen * unseen * F.col("squares") + more).alias("norm"), F.collect_list(F.struct("term", "w")).alias("terms"))
    unit = ["doc_id", "path", "unit", "allowed"]
    matched = bags.select(*unit, "norm", F.inline("terms")).join(F.broadcast(weights.drop("idf")), "term")
    dots = matched.where(F.expr("shiftright(allowed, bit) & 1") == 1).groupBy(*unit, "license", "tier", "of", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), F.first("norm").alias("norm"))
    score = F.round(F.col("dot") / F.col("norm"), 6)
    scored = dots.select("doc_id", "path", "tier", "license", score.alias("score")).where(F.col("score") >= threshold)
    scored = scored.unionByName(tags(files).withColumns({"tier": F.lit(0), "score": F.lit(1.0)}))
    best = F.min(F.struct("tier", (-F.col("score")).alias("s"), F.col("license").alias("l")))
    return scored.groupBy("doc_id", "path").agg(best.alias("best")).select("doc_id", "path", F.col("best.l").alias("own_license"), (-F.col("best.s")).alias("own_score"))


def folder(path: Column) -> Column:
    """The directory of a path, without the last slash; empty at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def license_scan(files: DataFrame, threshold: float = 0.7, templates: Templates | None = None, salts: int = 16) -> DataFrame:
    """Own and inherited license of every row of files(doc_id, path, text).

    Returns doc_id, path, own_license, own_score, license, inherited_from (the
    directory) and how (``own``, ``inherited`` or ``none``). Only matches are
    shuffled, not texts. A directory may hold any share of the files: its one row is
    copied to ``salts`` keys, over which its files are dealt.
    """
    own = materialize(own_licenses(files, threshold, templates), "licenses")
    licensed = own.where(F.rlike("path", F.lit(LICENSE_FILE))).groupBy(folder(F.col("path")).alias("above"))
    licensed = licensed.agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("doc_id").alias("d"), F.col("own_license").alias("l"))).alias("best"))
    licensed = licensed.select("above", F.col("best.l").alias("l"))
    folders = files.where(F.col("path").isNotNull()).select(folder(F.col("path")).alias("dir")).distinct()
    parts = F.split("dir", "/")
    ancestors = F.concat(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), F.array(F.lit("")))
    up = folders.select("dir", F.explode(F.array_distinct(ancestors)).alias("above"))
    # a directory at the top is above any share of the others
    nearest = salted_join(up, licensed, "above", salts=salts).groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "l")).alias("near"))
    nearest = nearest.select("dir", F.col("near.above").alias("from_dir"), F.col("near.l").alias("dir_license"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = files.select("doc_id", "path", folder(F.col("path")).alias("dir"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    inherited = salted.join(nearest, ["dir", "salt"], "left")
    same = [inherited[c].eqNullSafe(own[c]) for c in ("doc_id", "path")]
    both = inherited.join(own, same, "left")
    mine = F.col("own_license").isNotNull()
    return both.select(
        inherited["doc_id"],
        inherited["path"],
        "own_license",
        "own_score",
        F.coalesce("own_license", "dir_license").alias("license"),
        F.when(~mine, F.col("from_dir")).alias("inherited_from"),
        F.when(mine, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("how"),
    )


def corpus_files(docs: DataFrame) -> DataFrame:
    """Lay documents out as a tree of files: source, then directories by doc_id.

    One in ten documents is a licence file, one in a hundred in a directory one
    level up.
    """
    high = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 5000).cast("string"))
    deep = F.concat_ws("/", high, F.pmod(F.floor(F.col("doc_id") / 500), F.lit(10)).cast("string"))
    name = F.col("doc_id").cast("string")
    path = (
        F.when(F.col("doc_id") % 100 == 0, F.concat(high, F.lit("/LICENSE."), name))
        .when(F.col("doc_id") % 10 == 0, F.concat(deep, F.lit("/LICENSE."), name))
        .otherwise(F.concat(deep, F.lit("/"), name, F.lit(".txt")))
    )
    return docs.select("doc_id", path.alias("path"), "text")


def oracle(threshold: float = 0.7) -> str:
    """DuckDB SQL for ``license_scan(corpus_files(documents))``."""
    names = reported(TEMPLATES)
    rows = ", ".join(f"('{a}', '{names[a, k][0]}', {names[a, k][1]}, {names[a, k][2]}, {k}, '{t}', {w!r}::DOUBLE, {i!r}::DOUBLE)" for a, k, t, w, i in template_weights(TEMPLATES))
    fits = []
    for guarded, bit in sorted({x: b for x, _, b in names.values()}.items()):
        need, forbid = GUARDS.get(guarded, ("", ""))
        fits.append(f"CASE WHEN {f"regexp_matches(lower(unit), '{need}')" if need else 'TRUE'} AND {f"NOT regexp_matches(lower(unit), '{forbid}')" if forbid else 'TRUE'} THEN {1 << bit} ELSE 0 END")
    cue, name = CUE.removeprefix("(?i)"), LICENSE_FILE.removeprefix("(?i)")
    return f"""
WITH t(origin, license, tier, bit, template, term, weight, idf) AS (VALUES {rows}),
f AS (SELECT doc_id, text, CASE WHEN doc_id % 100 = 0 THEN high || '/LICENSE.' || doc_id WHEN doc_id % 10 = 0 THEN deep || '/LICENSE.' || doc_id ELSE deep || '/' || doc_id || '.txt' END AS path
  FROM (SELECT *, high || '/' || (doc_id // 500 % 10) AS deep FROM (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, 'unknown') || '/' || (doc_id // 5000) AS high FROM documents))),
files_ AS (SELECT *, string_split(text, chr(10)) AS lines FROM f WHERE regexp_matches(text, '[^\\x09-\\x0D\\x20]') AND regexp_matches(path, '{name}', 'i')),
u AS (SELECT DISTINCT doc_id, path, unit, {" + ".join(fits)} AS allowed FROM (
  SELECT doc_id, path, unnest(string_split(text, chr(10))) AS unit, 1 AS kind FROM f WHERE regexp_matches(text, '{cue}', 'i')
  UNION ALL SELECT doc_id, path, array_to_string(list_filter(lines, lambda x: regexp_matches(x, '[^\\x09-\\x0D\\x20]'))[1:3], ' '), 2 FROM files_
  UNION ALL SELECT doc_id, path, text, 3 FROM files_)
  WHERE (kind > 1 OR regexp_matches(unit, '{cue}', 'i')) AND (kind = 3 OR NOT (regexp_matches(lower(unit), '{DENIED}') OR regexp_matches(unit, '{TAG}')))),
w AS (SELECT doc_id, path, unit, allowed, term, count(*) AS tf FROM (SELECT *, unnest(regexp_extract_all(lower(unit), '{TERM}')) AS term FROM u) GROUP BY ALL),
k AS (SELECT w.*, tf * coalesce(idf, {unseen_idf(TEMPLATES)!r}::DOUBLE) AS v FROM w LEFT JOIN (SELECT DISTINCT term, idf FROM t) USING (term)),
n AS (SELECT doc_id, path, unit, sqrt(sum(v * v)) AS norm FROM k GROUP BY ALL),
s AS (SELECT doc_id, path, license, tier, round(sum(v * weight) / any_value(norm), 6) AS score FROM k JOIN t USING (term) JOIN n USING (doc_id, path, unit) WHERE (allowed >> bit) & 1 = 1 GROUP BY doc_id, path, unit, license, tier, origin, template
  UNION ALL SELECT doc_id, path, regexp_replace(unnest(regexp_extract_all(text, '{TAG}', 1)), '-(only|or-later)', '', 'g'), 0, 1.0 FROM f),
o AS (SELECT doc_id, path, license AS own_license, score AS own_score FROM s WHERE score >= {threshold} QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY tier, score DESC, license) = 1),
l AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS above, own_license AS l FROM o WHERE regexp_matches(path, '{name}', 'i') QUALIFY row_number() OVER (PARTITION BY regexp_replace(path, '/?[^/]*$', '') ORDER BY own_score DESC, doc_id) = 1),
m AS (SELECT f.doc_id, f.path, l.above, l.l FROM f JOIN l ON starts_with(f.path, l.above || '/') QUALIFY row_number() OVER (PARTITION BY f.doc_id, f.path ORDER BY length(l.above) DESC) = 1)
SELECT f.doc_id, f.path, own_license, own_score, coalesce(own_license, l) AS license, CASE WHEN own_license IS NULL THEN above END AS inherited_from,
  CASE WHEN own_license IS NOT NULL THEN 'own' WHEN l IS NOT NULL THEN 'inherited' ELSE 'none' END AS how
FROM f LEFT JOIN o USING (doc_id, path) LEFT JOIN m USING (doc_id, path)"""
