"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

DataFrame functions only. Document frequencies cover every word of every text. A line can reach the threshold only if
it holds one of a template's heaviest terms (what the others could add stays below it), so lines without one are left
out early and nothing is lost. A header may be wrapped: windows of consecutive lines, with as many words as a template, are
scored as lines are. A licence file is also scored as a whole against full texts of licences. A file without a license of its own takes that of the licence file in the nearest
directory above it.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, frequent, join_by_key, lower_ascii, materialize, with_row

#: License -> texts of headers and notices.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "MIT": ["Released under the MIT License.", "This project is licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "SPDX-License-Identifier: GPL-3.0-only"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved."],
}
_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License"
#: More notices, of licences that the templates would else take for a near one.
NOTICES = {
    "GPL-2.0": [_GNU.format("General Public License", "2")],
    "LGPL-2.1": [_GNU.format("Lesser General Public License", "2.1")],
    "LGPL-3.0": [_GNU.format("Lesser General Public License", "3")],
}
#: Full texts, one a licence, for licence files.
BODIES = {p.stem: [p.read_text()] for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
#: What parts the terms of a text in lower case.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Names of licence files.
FILES = r"(?i)^(licen[cs]e|copying|unlicense)(\.[a-z]+)?$"
THRESHOLD = 0.75
#: Most terms whose frequencies are broadcast, and bytes in one of them.
HEAD, HEAD_BYTES = 20_000, 100


def _terms(c: Column) -> Column:
    return F.filter(F.split(lower_ascii(c), APART), lambda w: w != "")


def _windows(files: DataFrame, lengths: list[int], hot) -> DataFrame:
    """(row, unit, terms) of windows of two or more consecutive lines, lines without terms left out. From each line on as
    many lines as hold the words of a template, and one more, for a header that begins within a line. Only windows
    near a line that is `hot`; units are negative."""
    split = F.filter(F.transform(F.split("text", "\n"), _terms), lambda w: F.size(w) > 0)
    # exploded, so that each is computed once
    lined = files.select(ROW, F.explode(F.array(split)).alias("ts")).where(F.size("ts") > 1)
    near = lined.select(ROW, "ts", F.explode(F.array(F.transform("ts", lambda w: F.size(w)))).alias("sizes"), F.filter(F.transform("ts", lambda w, i: F.when(hot(w), i + 1)), lambda i: i.isNotNull()).alias("at")).where(F.size("at") > 0)
    longest = max(lengths, default=1)
    starts = F.array_distinct(F.flatten(F.transform("at", lambda h: F.sequence(F.greatest(h - longest, F.lit(1)), h))))

    def lines(i: Column, words: int) -> Column:
        zero = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"))
        more = lambda a, x: F.when(a["words"] >= words, a).otherwise(F.struct((a["words"] + x).alias("words"), (a["n"] + 1).alias("n")))
        return F.aggregate(F.slice("sizes", i, words), zero, more, lambda a: a["n"])

    def from_line(i: Column) -> Column:
        own = F.array(*(lines(i, n) for n in lengths))
        counts = F.array_distinct(F.flatten(F.transform(own, lambda n: F.array(n, n + 1))))
        return F.transform(F.filter(counts, lambda n: (n > 1) & (i + n <= F.size("ts") + 1)), lambda n: F.struct(i.alias("i"), n.alias("n")))

    cuts = near.select(ROW, "ts", F.explode(F.array(F.flatten(F.transform(starts, from_line)))).alias("cuts"))
    return cuts.select(ROW, F.posexplode(F.transform("cuts", lambda c: F.flatten(F.slice("ts", c["i"], c["n"])))).alias("unit", "terms")).select(ROW, (-1 - F.col("unit")).alias("unit"), "terms")


def template_rows(templates: dict[str, list[str]] = TEMPLATES) -> list[tuple[str, int, str]]:
    return [(name, i, text) for name, own in templates.items() for i, text in enumerate(own)]


def license_scan(files: DataFrame, id_col: str, repo_col: str, path_col: str, text_col: str, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, notices: dict[str, list[str]] = NOTICES, bodies: dict[str, list[str]] = BODIES) -> DataFrame:
    """One row per input row: id, path, own_license, own_score, license, license_dir.

    own_license is the template's or notice's whose header is nearest by cosine to a line or a window of lines of the text
    (or to the whole of a licence file), if at least `threshold`; ties go to the name that comes first. If the whole of a
    licence file reaches it with one of `bodies`, the nearest of those holds instead of what single lines say. license is that, or else what the licence
    files of the nearest directory on the way up say (of several there, the best). license_dir is that directory, '' at
    the top. Null texts are empty; null paths lie at the top; null repositories are one. Rows that repeat are scanned
    each, and count each in the frequencies. Very long texts are scanned whole. No rows give no rows. Other columns are
    ignored. Templates, notices and bodies are parameters of bounded size and are broadcast.
    """
    spark: SparkSession = files.sparkSession
    rows = files.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{repo_col}`").cast("string"), F.lit("")).alias("repo"), F.coalesce(F.col(f"`{path_col}`"), F.lit("")).alias("path"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    used = rows.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    seen = materialize(used.groupBy("term").agg(F.count("*").alias("df")), "terms")
    total = rows.count()
    head = materialize(frequent(seen.where(F.octet_length("term") <= HEAD_BYTES), "df", HEAD).select("term", F.col("df").alias("often")), "head")
    idf = F.log((F.lit(float(total)) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1

    each = Window.partitionBy("license", "nth")

    def weights(texts: list[tuple[str, int, str]]) -> DataFrame:
        shapes = spark.createDataFrame(texts, "license string, nth int, text string")
        terms = shapes.select("license", "nth", F.explode(_terms(F.col("text"))).alias("term")).groupBy("license", "nth", "term").agg(F.count("*").alias("tf"))
        weighed = seen.join(F.broadcast(terms), "term", "right").withColumn("w", F.col("tf") * idf)
        return weighed.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(each))).withColumn("w", F.col("w") / F.col("norm"))

    headers = template_rows(templates) + [(name, -1 - i, text) for name, i, text in template_rows(notices)]
    norms = weights(headers)
    # of the heaviest terms as many as leave less than the threshold
    left = F.sum(F.col("w") * F.col("w")).over(each.orderBy("w", "term").rowsBetween(Window.unboundedPreceding, 0))
    known = materialize(norms.withColumn("heavy", left >= threshold * threshold * 0.999).select("license", "nth", "term", "w", "heavy"), "templates")
    heavy = sorted(r[0] for r in known.where("heavy").select("term").distinct().collect())

    named = F.element_at(F.split("path", "/"), -1).rlike(FILES)
    edge = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    some = F.col("text").rlike(f"(?i)(?:^|{edge})(?:{'|'.join(heavy)})(?:$|{edge})") if heavy else F.lit(False)
    marked = materialize(with_row(rows.select("id", "repo", "path", named.alias("is_licence"), F.when(some | named, F.col("text")).alias("text"))), "files")
    lines = F.concat(F.split("text", "\n"), F.when(F.col("is_licence"), F.array("text")).otherwise(F.expr("cast(array() as array<string>)")))
    hot = lambda c: F.arrays_overlap(c, F.array(*map(F.lit, heavy)) if heavy else F.expr("cast(array() as array<string>)"))
    units = marked.where(F.col("text").isNotNull()).select(ROW, F.posexplode(lines).alias("unit", "line")).select(ROW, "unit", _terms(F.col("line")).alias("terms"))
    windows = _windows(marked.where(F.col("text").isNotNull()), sorted({len([w for w in re.split(APART, text.lower()) if w]) for _, _, text in headers}), hot)
    units = units.unionByName(windows).where(hot(F.col("terms")))

    def vectors(units: DataFrame, name: str) -> DataFrame:
        counted = units.select(ROW, "unit", F.explode("terms").alias("term")).groupBy(ROW, "unit", "term").agg(F.count("*").alias("tf"))
        # frequent terms are looked up in a broadcast table; their rows get a key that no term has, so that none is hot in the join of the others
        known = counted.join(F.broadcast(head), "term", "left").withColumn("key", F.when(F.col("often").isNull(), F.col("term")).otherwise(F.concat(F.lit(" "), F.col(ROW))))
        weighed = known.join(seen.select(F.col("term").alias("key"), "df"), "key", "left").withColumn("df", F.coalesce("often", "df"))
        return materialize(weighed.withColumn("w", F.col("tf") * idf).select(ROW, "unit", "term", "w"), name)

    def scores(held: DataFrame, known: DataFrame, whole: bool) -> DataFrame:
        size = held.groupBy(ROW, "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
        dots = held.join(F.broadcast(known.select("license", "nth", "term", F.col("w").alias("v"))), "term").groupBy(ROW, "unit", "license", "nth").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
        return dots.join(size, [ROW, "unit"]).select(ROW, "license", F.round(F.col("dot") / F.col("size"), 6).alias("score"), F.lit(0 if whole else 1).alias("part")).where(F.col("score") >= threshold)

    scored = scores(vectors(units, "units"), known, False)
    if bodies:
        wholes = marked.where("is_licence").select(ROW, F.lit(0).alias("unit"), _terms(F.col("text")).alias("terms"))
        full = materialize(weights(template_rows(bodies)).select("license", "nth", "term", "w"), "bodies")
        scored = scored.unionByName(scores(vectors(wholes, "wholes"), full, True))
    best = scored.groupBy(ROW).agg(F.min(F.struct("part", (-F.col("score")).alias("no"), "license")).alias("b")).select(ROW, F.col("b.license").alias("own_license"), (-F.col("b.no")).alias("own_score"))
    own = materialize(marked.drop("text").join(best, ROW, "left"), "own")

    folder = F.regexp_replace(F.col("path"), "(^|/)[^/]*$", "")
    own = own.withColumn("dir", folder)
    stated = own.where(F.col("is_licence") & F.col("own_license").isNotNull()).groupBy("repo", "dir").agg(F.min(F.struct((-F.col("own_score")).alias("no"), F.col("own_license").alias("license"))).alias("b")).select("repo", F.col("dir").alias("up"), F.col("b.license").alias("license"))
    parts = F.split("dir", "/")
    ups = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    dirs = own.select("repo", "dir").distinct().select("repo", "dir", F.posexplode(ups).alias("depth", "up"))
    nearest = dirs.join(stated, ["repo", "up"]).groupBy("repo", "dir").agg(F.max(F.struct("depth", "up", "license")).alias("n")).select("repo", "dir", F.col("n.up").alias("up"), F.col("n.license").alias("inherited"))
    places = own.select("repo", "dir").distinct().join(nearest, ["repo", "dir"], "left")
    out = join_by_key(own, places, ["repo", "dir"])
    return out.select(F.col("id").alias(id_col), "path", "own_license", "own_score", F.coalesce("own_license", "inherited").alias("license"), F.when(F.col("own_license").isNull(), F.col("up")).alias("license_dir"))
