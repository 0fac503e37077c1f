"""License scan in DataFrame operations only.

Headers that speak of a licence, and whole licence files, are compared with templates by the cosine of
sparse TF-IDF vectors. A header is a block of adjacent comment lines, or of adjacent short lines, joined
before it is scored, so a wrapped header is one text; single lines are scored, too, as they stand in prose.
An SPDX line names its licence exactly and goes before what words resemble, and "All rights reserved" counts
only where nothing else is found. A file without a licence of its own inherits that of the nearest ancestor
directory that holds a licence file, found by joining each directory's ancestor paths.

Each distinct text is scored once, however many files repeat it, and directories are joined rather than
files, so a hot line or directory is a single row before any join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Short texts that name or grant a licence.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0 (short)": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0 (name)": "Licensed under the AGPL 3.0 license.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "Apache-2.0 (short)": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-2-Clause (short)": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause (name)": "BSD 3-Clause License",
    "BSD-3-Clause (short)": "Licensed under the BSD 3-Clause License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0 (long)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 (long)": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0 (long)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC0-1.0 (short)": "Licensed under CC0 1.0 Universal.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-2.0 (short)": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 (name)": "Licensed under the GPL 2.0 license.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0 (short)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 (name)": "Licensed under the GPL 3.0 license.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC (short)": "Licensed under the ISC License.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-2.1 (program)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-2.1 (short)": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1 (name)": "Licensed under the LGPL 2.1 license.",
    "LGPL-3.0": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0 (program)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-3.0 (short)": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0 (name)": "Licensed under the LGPL 3.0 license.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "MIT (short)": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0 (short)": "Licensed under the Mozilla Public License, Version 2.0.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense (short)": "Released under the Unlicense.",
}
#: Words one of which every line that is looked at must hold.
MARKERS = ("licens", "licenc", "copyright", "rights reserved", "spdx", "permission is hereby", "permission to use", "redistribution", "public domain")
THRESHOLD = 0.6
#: The licence that stands for none being granted.
RESERVED = "Proprietary"
#: Characters of a line up to which it may be one of a wrapped text.
WRAPPED = 100
#: Lines that begin like this are comments.
COMMENT = r"^[ \t]*(//|#|\*|/\*|--|;|%|<!--)"
SPDX = "spdx-license-identifier"
_EXPRESSION = SPDX + r":[ \t]*\(*[ \t]*([a-z0-9.+\-]+)"
_SUFFIX = r"(-only|-or-later|\+)$"
#: Base names of licence files, lower case, up to the first dot or dash.
LICENSE_FILES = ("license", "licence", "copying", "notice")


def _marked(text: Column) -> Column:
    found = F.lit(False)
    for m in MARKERS:
        found = found | text.contains(m)
    return found


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits, inner dots kept."""
    return F.filter(F.split(F.regexp_replace(text, r"[^a-z0-9.]+|\.(?![a-z0-9])", " "), " +"), lambda t: t != "")


def _weights(terms: DataFrame, idf: DataFrame) -> DataFrame:
    """``terms(unit, token, tf, ...)`` -> with ``w``, of length one over each unit."""
    made = terms.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    norm = made.groupBy("unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return made.join(norm, "unit").withColumn("w", F.col("w") / F.col("norm"))


def match_units(units: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``units(unit, text)`` of distinct lower-case texts -> ``(unit, license, score)`` where the best cosine reaches ``threshold``.

    ``unit`` is a short key of the text, so words and weights do not carry whole texts along. IDF is
    ln((1 + N) / (1 + df)) + 1 over all units and templates. Ties go to the smaller name.
    """
    spark = units.sparkSession
    listed = F.array(*(F.struct(F.lit(k).alias("unit"), F.lit(v.lower()).alias("text")) for k, v in sorted((templates or TEMPLATES).items())))
    kinds = spark.range(1).select(F.inline(listed))
    word = F.explode(tokens(F.col("text"))).alias("token")
    count = lambda texts: texts.select("unit", word).groupBy("unit", "token").agg(F.count("*").cast("double").alias("tf"))
    terms = materialize(count(units), "license-words")
    of_kinds = count(kinds)
    total = units.select("unit").unionByName(kinds.select("unit")).agg(F.count("*").alias("total"))
    df = terms.select("token").unionByName(of_kinds.select("token")).groupBy("token").agg(F.count("*").alias("df"))
    idf = df.crossJoin(total).select("token", (F.log((1.0 + F.col("total")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))  # total is one row
    # as many rows as the templates have words
    weights = F.broadcast(_weights(of_kinds, idf).select("token", F.col("unit").alias("template"), F.col("w").alias("tw")))
    dots = _weights(terms, idf).join(weights, "token").groupBy("unit", "template").agg(F.round(F.sum(F.col("w") * F.col("tw")), 6).alias("score"))
    license_name = F.regexp_replace("template", r" \(.*\)$", "")
    best = dots.groupBy("unit").agg(F.min(F.struct((-F.col("score")).alias("negative"), license_name.alias("license"))).alias("b"))
    return best.select("unit", F.col("b.license").alias("license"), (-F.col("b.negative")).alias("score")).where(F.col("score") >= threshold)


def directory(path: Column) -> Column:
    """Path without its last part; '' at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """A directory and its ancestors, nearest first, the top ('') last."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.concat(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), n - i), "/")), F.array(F.lit(""))))


def names(templates: dict[str, str]) -> list[str]:
    """The licences that templates stand for."""
    return sorted({k.split(" (")[0] for k in templates})


def _blocks(lines: Column, holds: Callable[[Column], Column]) -> Column:
    """Runs of adjacent lines that ``holds``, each joined by spaces."""
    shown = F.array_join(F.transform(lines, lambda x: F.when(holds(x), x).otherwise("")), "\n")
    return F.transform(F.split(shown, "\n\n+"), lambda x: F.trim(F.replace(x, F.lit("\n"), F.lit(" "))))


def headers(text: Column) -> Column:
    """Lower-case text -> what is scored of it: marked lines, and marked blocks of comment lines and of short lines."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.when(x.contains(SPDX), F.lit("")).otherwise(F.trim(x)))
    said = lambda x: x.rlike("[a-z0-9]")
    short = _blocks(lines, lambda x: said(x) & (F.length(x) <= WRAPPED))
    comments = _blocks(lines, lambda x: said(x) & x.rlike(COMMENT))
    return F.array_distinct(F.filter(F.concat(lines, short, comments), _marked))


def declared(text: Column, templates: dict[str, str]) -> Column:
    """The licence that the first SPDX line of a lower-case text names (of an expression, its first), null if it is unknown."""
    known = F.create_map(*(F.lit(x) for k in names(templates) if k != RESERVED for x in (k.lower(), k)))
    return F.try_element_at(known, F.regexp_replace(F.regexp_extract(text, _EXPRESSION, 1), _SUFFIX, ""))


def scan(files: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``files(path, text, ...)`` -> its other columns and ``(path, own_license, own_score, license, license_from)``, a row for each input row.

    ``license`` is the file's own, else the one inherited; ``license_from`` is 'header', the directory it
    comes from as 'dir:<path>', or null where there is none. A file's own licence is what an SPDX line
    declares (score 1), else the best cosine of its headers, "All rights reserved" last, ties to the smaller
    name; among licence files of a directory the best in the same order. Rows that share a path count as one
    file. Null texts count as empty; a row with a null path cannot be placed and gets no licence; other
    columns of the names returned are replaced; texts of any length are read whole; an empty table gives no
    rows.
    """
    templates = templates or TEMPLATES
    others = [c for c in files.columns if c not in ("path", "text", "own_license", "own_score", "license", "license_from")]
    rows = files.select(F.col("path").cast("string").alias("path"), F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    base = F.lower(F.regexp_extract("path", r"([^/.\-]*)[^/]*$", 1))
    is_file = F.coalesce(base.isin(*LICENSE_FILES), F.lit(False))
    # few texts speak of a licence; they are looked at several times, the others once
    marked = materialize(rows.where(_marked(F.col("text"))).withColumn("whole", is_file), "license-marked")
    units = F.when(F.col("whole"), F.array(F.trim("text"))).otherwise(F.array().cast("array<string>"))
    said = marked.select("path", "whole", F.explode(F.array_distinct(F.concat(headers(F.col("text")), units))).alias("said")).select("path", "whole", F.md5("said").alias("unit"), "said")
    found = said.select("path", "whole", "unit").distinct()
    texts = materialize(said.groupBy("unit").agg(F.min("said").alias("text")), "license-texts")
    scored = match_units(texts, templates, threshold)
    order = F.when(F.col("license") == RESERVED, 2).otherwise(1).alias("kind")
    by_words = found.join(scored, "unit").select("path", "whole", F.struct(order, (-F.col("score")).alias("negative"), F.col("license")).alias("b"))
    named = marked.select("path", "whole", declared(F.col("text"), templates).alias("license")).where(F.col("license").isNotNull())
    by_name = named.select("path", "whole", F.struct(F.lit(0).alias("kind"), F.lit(-1.0).alias("negative"), F.col("license")).alias("b"))
    own = by_words.unionByName(by_name).groupBy("path", "whole").agg(F.min("b").alias("b"))
    granted = own.where("whole AND path IS NOT NULL").groupBy(directory(F.col("path")).alias("holder")).agg(F.min("b").alias("g"))
    own = own.select("path", F.col("b.license").alias("own_license"), (-F.col("b.negative")).alias("own_score"))
    dirs = rows.where("path IS NOT NULL").select(directory(F.col("path")).alias("dir")).distinct()
    reach = dirs.select("dir", F.posexplode(ancestors(F.col("dir"))).alias("distance", "holder")).join(granted, "holder")
    nearest = reach.groupBy("dir").agg(F.min(F.struct("distance", "holder", F.col("g.license").alias("license"))).alias("n"))
    placed = files.select(*(F.col(c).alias(f"in_{c}") for c in others), F.col("path").cast("string").alias("path")).withColumn("dir", directory(F.col("path")))
    out = placed.join(own, "path", "left").join(nearest, "dir", "left")
    return out.select(
        *(F.col(f"in_{c}").alias(c) for c in others),
        "path",
        "own_license",
        "own_score",
        F.coalesce("own_license", "n.license").alias("license"),
        F.when(F.col("own_license").isNotNull(), F.lit("header")).when(F.col("n").isNotNull(), F.concat(F.lit("dir:"), F.col("n.holder"))).alias("license_from"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, source, text)`` as a tree of files: ``(doc_id, path, text)``.

    Four levels below the source by blocks of ids; documents whose first line speaks of a licence are the
    licence files, each at a level that its id decides.
    """
    i = F.col("doc_id")
    part = lambda n: F.floor(i / n).cast("long").cast("string")
    top = F.coalesce(F.col("source"), F.lit("unknown"))
    first = F.lower(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1))
    level = F.pmod(i, F.lit(3))
    folder = F.concat_ws("/", top, part(4096), part(512), part(64))
    held = F.when(level == 0, F.concat_ws("/", top, part(4096))).when(level == 1, F.concat_ws("/", top, part(4096), part(512))).otherwise(folder)
    path = F.when(_marked(first), F.concat(held, F.lit("/LICENSE-"), i.cast("string"))).otherwise(F.concat(folder, F.lit("/doc-"), i.cast("string"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")
