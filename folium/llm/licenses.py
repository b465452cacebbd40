"""Licence scans: TF-IDF cosine of notices to templates, then inheritance from the nearest directory.

DataFrame operators only.  Every line of every text is a candidate notice.  Weights are those of the
templates' own collection (a token outside it has the greatest weight), so no corpus statistics are
gathered.  Lines are screened by anchor tokens: tokens without which no line can reach the threshold,
which ``Templates`` proves when it is built.  Files that hold a word every licence holds are also compared
as wholes with licence texts, and their windows of up to ``WINDOW`` lines with standard headers and titles
that wrap; an SPDX tag names its licence.  A file's own licence is the best of all; a file without one
inherits from the nearest ancestor directory that holds a licence file with one.

Scale: the templates are a few rows (broadcast).  Directories are reduced to distinct ones before
their ancestors are joined, so a root above a third of all files is one row; files then meet their
directory's answer in an equi-join that adaptive execution may split.

Cases: null text has no licence; a null path is a file of no directory and inherits nothing; ties go
to the first template, then to the first licence file by path; repeated rows are rows of their own;
an empty table gives no rows; extra columns stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from folium.functions.text import let

# Short notices by which licences are applied to a work.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "MPL-2.0": "Subject to the Mozilla Public License, v. 2.0.",
    "ISC": "Licensed under the ISC License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "Proprietary": "Copyright. All rights reserved.",
}
# Titles of licences and sentences of the headers they ask to be put into files.
_GPL = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as "
        "published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version.")
HEADERS = {
    "Apache-2.0/title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "Apache-2.0/short title": "Apache License",
    "Apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "MIT/title": "MIT License",
    "MIT/long title": "The MIT License (MIT)",
    "MIT/permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
                      'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
                      "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0/title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "GPL-3.0/header": _GPL.format("", 3),
    "GPL-2.0/title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-2.0/header": _GPL.format("", 2).replace(":", ";"),
    "LGPL-3.0/title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-3.0/header": _GPL.format("Lesser ", 3),
    "LGPL-2.1/title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-2.1/header": _GPL.format("Lesser ", 2.1).replace("program", "library"),
    "AGPL-3.0/title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "AGPL-3.0/header": _GPL.format("Affero ", 3),
    "MPL-2.0/title": "Mozilla Public License Version 2.0",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
                      "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause/title": "BSD 3-Clause License",
    "BSD-3-Clause/short": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "ISC/title": "ISC License",
    "ISC/permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
                      "provided that the above copyright notice and this permission notice appear in all copies.",
    "CC0-1.0/title": "Creative Commons CC0 1.0 Universal",
}
#: Licence texts, one file each.
TEXTS = Path(__file__).resolve().parent / "license_texts"
#: A word of every header and text, without which no window or file is a licence (SPDX tags hold one too).
HELD = "(?i)licen[sc]e|permission|redistribution|creative commons"
WINDOW = 6
#: Windows and wholes come after all notices where scores are equal.
LATER = 1000
COMMON = frozenset("this is under the of to a and in by for".split())
TOKEN = "[a-z0-9]+(?:[.-][a-z0-9]+)*"


@dataclass(frozen=True)
class Templates:
    """Weights of template tokens; ``anchors`` are the tokens a matching line must hold one of."""

    notices: dict[str, str] = field(default_factory=lambda: dict(NOTICES))
    threshold: float = 0.7

    def counts(self) -> dict[str, Counter]:
        return {name: Counter(re.findall(TOKEN, text.lower())) for name, text in self.notices.items()}

    def idf(self) -> dict[str, float]:
        df = Counter(t for c in self.counts().values() for t in c)
        return {t: math.log((1 + len(self.notices)) / (1 + n)) + 1 for t, n in df.items()}

    @property
    def outside(self) -> float:
        """Weight of a token no template holds."""
        return math.log(1 + len(self.notices)) + 1

    def weights(self) -> list[tuple[int, str, str, float, float]]:
        """(template number, name, token, weight, idf): weights of a template have length 1."""
        idf, rows = self.idf(), []
        for i, (name, counts) in enumerate(self.counts().items()):
            norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in counts.items()))
            rows += [(i, name, t, n * idf[t] / norm, idf[t]) for t, n in sorted(counts.items())]
        return rows

    def anchors(self) -> list[str]:
        """Tokens of which a line must hold one to reach the threshold.

        Without an anchor, a line's cosine is at most the norm of a template's other tokens; common
        words are anchors only where that bound would not stay below the threshold without them.
        """
        chosen = {t for _, _, t, _, _ in self.weights() if t not in COMMON and len(t) >= 2}
        for name in self.notices:
            rest = sorted((w, t) for _, n, t, w, _ in self.weights() if n == name and t not in chosen)
            while rest and math.sqrt(sum(w * w for w, _ in rest)) >= self.threshold - 1e-6:
                chosen.add(rest.pop()[1])
        return sorted(chosen)

    def anchor_pattern(self) -> str:
        """Any anchor as a whole token: nothing that belongs to a token stands beside it."""
        return "(?i)(?:^|[^a-z0-9])(?:" + "|".join(t.replace(".", "[.]") for t in self.anchors()) + ")(?:$|[^a-z0-9])"


def read_texts() -> dict[str, str]:
    return {p.stem: p.read_text("utf-8") for p in sorted(TEXTS.glob("*.txt"))}


@dataclass(frozen=True)
class Wholes:
    """Headers for windows and texts for whole files; names are a licence and what follows a slash.

    Counts of a token are damped, 1 + ln n, so that a long text is not its articles and conjunctions.
    """

    headers: dict[str, str] = field(default_factory=lambda: dict(HEADERS))
    texts: dict[str, str] = field(default_factory=read_texts)
    threshold: float = 0.7

    def weights(self) -> tuple[list[tuple[str, int, str, str, float, float]], dict[str, float]]:
        """(kind, number, license, token, weight, idf) and per kind the weight of a token outside."""
        rows, outside, number = [], {}, LATER
        for kind, named in (("window", self.headers), ("whole", self.texts)):
            counts = {name: Counter(re.findall(TOKEN, text.lower())) for name, text in named.items()}
            df = Counter(t for c in counts.values() for t in c)
            idf = {t: math.log((1 + len(named)) / (1 + n)) + 1 for t, n in df.items()}
            outside[kind] = math.log(1 + len(named)) + 1
            for name, c in counts.items():
                w = {t: (1 + math.log(n)) * idf[t] for t, n in sorted(c.items())}
                norm = math.sqrt(sum(x * x for x in w.values()))
                rows += [(kind, number, name.split("/")[0], t, x / norm, idf[t]) for t, x in w.items()]
                number += 1
        return rows, outside


def whole_scores(files: DataFrame, spark: SparkSession, key: str, text: str, templates: Templates, wholes: Wholes) -> DataFrame:
    """key, number, license, score of windows, whole files and SPDX tags that reach the threshold."""
    plain = lambda x: F.array_join(F.regexp_extract_all(F.lower(x), F.lit(TOKEN), F.lit(0)), " ")
    exact = [" ".join(re.findall(TOKEN, t.lower())) for t in templates.notices.values()]
    rows = files.where(F.regexp_like(F.col(text), F.lit(HELD))).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    tag = F.regexp_extract("_text", r"(?i)SPDX-License-Identifier:[ \t(]*([A-Za-z0-9][A-Za-z0-9.-]*)", 1)
    tags = rows.select("_key", F.regexp_replace(tag, "-(only|or-later)$", "").alias("license")).where("license <> ''").select(
        "_key", F.lit(LATER - 1).alias("number"), "license", F.lit(1.0).alias("score")
    )
    # A line that is a notice scores 1 and wins ties, so nothing else of its file can be better.
    lines = F.filter(F.split("_text", "\n"), lambda x: F.regexp_like(x, F.lit("[A-Za-z0-9]")))
    starts = lambda ls: F.transform(F.sequence(F.lit(1), F.greatest(F.size(ls), F.lit(1))), lambda i: F.slice(ls, i, WINDOW))
    open_rows = rows.select("_key", "_text", let(lines, lambda ls: F.when(
        ~F.exists(ls, lambda x: F.regexp_like(x, F.lit(templates.anchor_pattern())) & plain(x).isin(*exact)),
        F.filter(starts(ls), lambda w: F.exists(w, lambda x: F.regexp_like(x, F.lit(HELD)))),
    )).alias("_starts")).where("_starts IS NOT NULL")
    windows = open_rows.select("_key", F.posexplode("_starts").alias("_at", "_w")).select(
        "_key", "_at", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w"), F.lit(1))), lambda n: F.array_join(F.slice("_w", F.lit(1), n), " "))).alias("_n", "unit")
    )
    units = windows.select("_key", F.lit("window").alias("kind"), "_at", "_n", "unit").unionByName(
        open_rows.select("_key", F.lit("whole").alias("kind"), F.lit(0).alias("_at"), F.lit(0).alias("_n"), F.col("_text").alias("unit"))
    )
    at = ["_key", "kind", "_at", "_n"]
    counts = units.select(*at, F.explode(F.regexp_extract_all(F.lower("unit"), F.lit(TOKEN), F.lit(0))).alias("token")).groupBy(*at, "token").agg(
        F.count(F.lit(1)).alias("n")
    )
    table, outside = wholes.weights()
    weights = F.broadcast(spark.createDataFrame(table, "kind string, number int, license string, token string, weight double, idf double"))
    idf = F.broadcast(weights.select("kind", "token", "idf").distinct())
    unknown = F.when(F.col("kind") == "window", F.lit(outside["window"])).otherwise(F.lit(outside["whole"]))
    weighed = counts.join(idf, ["kind", "token"], "left").withColumn("w", (1 + F.ln("n")) * F.coalesce("idf", unknown))
    norms = weighed.groupBy(*at).agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("token", "w"))).alias("known")
    )
    cosines = (
        norms.select(*at, "norm", F.explode("known").alias("k")).select(*at, "norm", F.col("k.token").alias("token"), F.col("k.w").alias("w"))
        .join(weights, ["kind", "token"]).groupBy(*at, "number", "license").agg((F.sum(F.col("w") * F.col("weight")) / F.max("norm")).alias("score"))
        .withColumn("score", F.round("score", 6)).where(F.col("score") >= wholes.threshold)
    )
    return cosines.select("_key", "number", "license", "score").unionByName(tags)


def best_notices(files: DataFrame, spark: SparkSession, key: str, text: str, templates: Templates, wholes: Wholes) -> DataFrame:
    """key, license, score of the best line, window or whole of each file that reaches the threshold."""
    pattern = F.lit(templates.anchor_pattern())
    lines = (
        files.where(F.regexp_like(F.col(text), pattern))
        .select(F.col(key).alias("_key"), F.posexplode(F.split(F.col(text), "\n")).alias("_line", "_words"))
        .where(F.regexp_like("_words", pattern))
    )
    counts = (
        lines.select("_key", "_line", F.explode(F.regexp_extract_all(F.lower("_words"), F.lit(TOKEN), F.lit(0))).alias("token"))
        .groupBy("_key", "_line", "token").agg(F.count(F.lit(1)).alias("n"))
    )
    weights = spark.createDataFrame(templates.weights(), "number int, license string, token string, weight double, idf double")
    idf = F.broadcast(weights.select("token", "idf").distinct())
    weighed = counts.join(idf, "token", "left").withColumn("w", F.col("n") * F.coalesce("idf", F.lit(templates.outside)))
    norms = weighed.groupBy("_key", "_line").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"),
        # Tokens of a line, reduced to the templates' vocabulary: at most that many entries.
        F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("token", "w"))).alias("known"),
    )
    cosines = (
        norms.select("_key", "_line", "norm", F.explode("known").alias("k"))
        .select("_key", "_line", "norm", F.col("k.token").alias("token"), F.col("k.w").alias("w"))
        .join(F.broadcast(weights), "token")
        .groupBy("_key", "_line", "number", "license").agg((F.sum(F.col("w") * F.col("weight")) / F.max("norm")).alias("score"))
        .withColumn("score", F.round("score", 6)).where(F.col("score") >= templates.threshold)
    )
    best = F.max_by("license", F.struct("score", -F.col("number")))
    found = cosines.select("_key", "number", "license", "score").unionByName(whole_scores(files, spark, key, text, templates, wholes))
    return found.groupBy("_key").agg(best.alias("license"), F.max("score").alias("score"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """The directory and all above it, with their depth; "" is the root."""
    parts = F.split(directory, "/")
    upto = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))
    root = F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("dir")))
    return F.when(directory == "", root).otherwise(F.concat(root, upto))


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text",
         license_name: str = r"(?i)(^|/)(licen[sc]e|copying)(\.[a-z]+)?$", templates: Templates = Templates(), wholes: Wholes = Wholes()) -> DataFrame:
    """Files with own_license, own_score, license, inherited_from (a directory, null if own or none).

    Input columns of these names give way to the results; all others stay as they came, whatever their
    names.  Keys must tell files apart for a file's own licence to be its alone.
    """
    added = ("own_license", "own_score", "license", "inherited_from")
    held = files.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.col(path).alias("path"))
    own = best_notices(files.select(F.col(key).alias("key"), F.col(text).alias("text")), files.sparkSession, "key", "text", templates, wholes)
    known = held.join(own.withColumnsRenamed({"license": "own_license", "score": "own_score"}), held["key"].eqNullSafe(own["_key"]), "left").drop("_key")
    known = known.withColumn("at", parent(F.col("path")))
    holders = (
        known.where(F.regexp_like("path", F.lit(license_name)) & F.col("own_license").isNotNull())
        .groupBy(F.col("at").alias("dir")).agg(F.min_by("own_license", F.struct("path", "own_license")).alias("license"))
    )
    places = known.where(F.col("at").isNotNull()).select("at").distinct().select("at", F.explode(ancestors(F.col("at"))).alias("a")).select("at", "a.depth", "a.dir")
    nearest = places.join(holders, "dir").groupBy("at").agg(F.max(F.struct("depth", "dir", "license")).alias("n")).select(
        F.col("at").alias("dir"), F.col("n.dir").alias("source"), F.col("n.license").alias("given")
    )
    joined = known.join(nearest, F.col("at") == F.col("dir"), "left")
    plain = {c.lower() for c in added}
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in files.columns if c.lower() not in plain], "own_license", "own_score",
        F.coalesce("own_license", "given").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("source")).alias("inherited_from"),
    )


def oracle(files_sql: str, key: str = "doc_id", templates: Templates = Templates()) -> str:
    """The scan of single lines as DuckDB SQL over ``files_sql`` (columns key, path, text); no headers, texts or tags."""
    rows = ", ".join(f"({i}, '{name}', '{t}', {w!r}::DOUBLE, {idf!r}::DOUBLE)" for i, name, t, w, idf in templates.weights())
    return f"""
WITH files AS ({files_sql}), weights(number, license, token, weight, idf) AS (VALUES {rows}),
lines AS (SELECT {key} AS k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln
          FROM files WHERE regexp_matches(text, '{templates.anchor_pattern()}')),
counts AS (SELECT k, ln, token, count(*) AS n FROM (
             SELECT k, ln, unnest(regexp_extract_all(lower(line), '{TOKEN}')) AS token FROM lines
             WHERE regexp_matches(line, '{templates.anchor_pattern()}')) GROUP BY ALL),
weighed AS (SELECT c.*, i.idf, n * coalesce(i.idf, {templates.outside!r}) AS w
            FROM counts c LEFT JOIN (SELECT DISTINCT token, idf FROM weights) i USING (token)),
norms AS (SELECT k, ln, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
cosines AS (SELECT k, ln, number, license, round(sum(w * weight) / max(norm), 6) AS score
            FROM weighed JOIN norms USING (k, ln) JOIN weights USING (token) GROUP BY ALL),
own AS (SELECT k, license AS own_license, score AS own_score FROM cosines WHERE score >= {templates.threshold}
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, number) = 1),
known AS (SELECT f.{key}, path, own_license, own_score, regexp_replace(path, '/?[^/]*$', '') AS dir
          FROM files f LEFT JOIN own ON f.{key} = own.k),
holders AS (SELECT dir, arg_min(own_license, path) AS license FROM known
            WHERE regexp_matches(path, '(?i)(^|/)(licen[sc]e|copying)(\\.[a-z]+)?$') AND own_license IS NOT NULL GROUP BY dir),
nearest AS (SELECT d.dir, h.dir AS holder, h.license FROM (SELECT DISTINCT dir FROM known) d
            JOIN holders h ON h.dir = '' OR d.dir = h.dir OR starts_with(d.dir, h.dir || '/')
            QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(h.dir) DESC) = 1)
SELECT {key}, path, own_license, own_score, coalesce(own_license, license) AS license,
       CASE WHEN own_license IS NULL THEN holder END AS inherited_from
FROM known LEFT JOIN nearest USING (dir)
"""
