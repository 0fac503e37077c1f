from ledgermesh.llm import licenses as li
from pyspark.sql import functions as F


def test_headers_files_and_inheritance(spark):
    mit, apache, gpl = "Released under the MIT License.", "// Licensed under the Apache License, Version 2.0.", li.TEMPLATES["GPL-3.0"]
    rows = [
        ("a/LICENSE", mit), ("a/b/x.py", "code"), ("a/b/COPYING.txt", gpl), ("a/b/c/y.py", None), ("a/z.py", "code\n" * 500 + apache + "\nmore"),
        ("q/r.py", ""), ("top.py", "license of nothing in particular is discussed here at length, dear reader"), ("a/dup.py", "x"), ("a/dup.py", "x"), (None, mit), (None, "x"),
    ]
    df = spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit(1)).withColumn("dir", F.lit(2))
    got = sorted(((r.path, r.own_license, r.license, r.license_from) for r in li.scan(df).collect()), key=str)
    assert got == sorted(
        [
            ("a/LICENSE", "MIT", "MIT", "header"), ("a/b/x.py", None, "GPL-3.0", "dir:a/b"), ("a/b/COPYING.txt", "GPL-3.0", "GPL-3.0", "header"),
            ("a/b/c/y.py", None, "GPL-3.0", "dir:a/b"), ("a/z.py", "Apache-2.0", "Apache-2.0", "header"), ("q/r.py", None, None, None), ("top.py", None, None, None),
            ("a/dup.py", None, "MIT", "dir:a"), ("a/dup.py", None, "MIT", "dir:a"), (None, None, None, None), (None, None, None, None),
        ], key=str)
    assert li.scan(df.limit(0)).collect() == []


def test_neighbouring_licences_are_told_apart(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    rows = [
        ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC0-1.0", "// Licensed under CC0 1.0."),
        ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."), ("CC-BY-4.0", "# This work is licensed under a Creative Commons Attribution 4.0 International License."),
        ("GPL-2.0", gpl.format("General", "2")), ("GPL-3.0", gpl.format("General", "3")), ("LGPL-2.1", gpl.format("Lesser General", "2.1")), ("LGPL-3.0", gpl.format("Lesser General", "3")), ("AGPL-3.0", gpl.format("Affero General", "3")),
        ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
        ("ISC", "Released under the ISC License."), ("MIT", "Released under the MIT License."), ("BSD-2-Clause", "Released under the BSD 2-Clause License."), ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
        ("Unlicense", "This is free and unencumbered software released into the public domain."), ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ]
    df = spark.createDataFrame([(f"d{i}/x.py", t) for i, (_, t) in enumerate(rows)], "path string, text string")
    got = {r.path: (r.own_license, r.own_score) for r in li.scan(df).collect()}
    wrong = [(want, got[f"d{i}/x.py"], text[:60]) for i, (want, text) in enumerate(rows) if got[f"d{i}/x.py"][0] != want]
    assert wrong == []
    alone = [got for _, t in rows[:4] for got in [li.scan(spark.createDataFrame([("x", t)], "path string, text string")).first().own_license]]
    assert alone == [want for want, _ in rows[:4]]


def test_headers_are_scored_as_blocks(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\n"
    commented = lambda t, mark: "".join(f"{mark} {x}\n" for x in t.strip().split("\n"))
    reserved = "Copyright 2020 Foo. All rights reserved.\n"
    rows = [
        ("BSD-3-Clause", reserved + bsd), ("BSD-3-Clause", commented(reserved + "\n" + bsd, "#") + "import os\n"), ("MIT", commented(mit, " *") + "int main() { return 0; }\n"),
        ("Apache-2.0", reserved + "SPDX-License-Identifier: Apache-2.0\n"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"), ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-or-later\ncode"),
        ("MIT", "SPDX-License-Identifier: (MIT OR Apache-2.0)"), (None, "SPDX-License-Identifier: Zlib"), ("Proprietary", reserved + "nothing else here"), ("LGPL-2.1", "# SPDX-License-Identifier: LGPL-2.1+"),
    ]
    df = spark.createDataFrame([(i, f"d{i}/x.py", t) for i, (_, t) in enumerate(rows)], "doc_id long, path string, text string").withColumn("license", F.lit(1))
    got = li.scan(df)
    assert got.columns == ["doc_id", "path", "own_license", "own_score", "license", "license_from"]
    assert {r.doc_id: r.own_license for r in got.collect()} == {i: want for i, (want, _) in enumerate(rows)}


def test_one_very_long_file(spark):
    text = "\n".join(["some line of words that says nothing"] * 100_000 + ["Released under the MIT License."])
    assert li.scan(spark.createDataFrame([("a", text)], "path string, text string")).first().own_license == "MIT"
