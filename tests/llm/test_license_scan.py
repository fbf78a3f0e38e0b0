"""License scans: licenses told apart, compression that decides, and alignments against a plain recursion."""

import random
from functools import lru_cache

import pytest

from stratalex.llm import license_scan as ls

GNU = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
TOLD = [
    ("GPL-2.0", GNU.format("program", "General Public License", "2")),
    ("GPL-3.0", GNU.format("program", "General Public License", "3")),
    ("LGPL-2.1", GNU.format("library", "Lesser General Public License", "2.1")),
    ("LGPL-3.0", GNU.format("library", "Lesser General Public License", "3")),
    ("AGPL-3.0", GNU.format("program", "Affero General Public License", "3")),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", ls.TEMPLATES["BSD-2-Clause"][1].replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", "AUTHOR")),
    ("BSD-3-Clause", ls.TEMPLATES["BSD-3-Clause"][1].replace("the copyright holder nor", "Foo Inc. nor")),
    ("ISC", "Copyright (c) 2019, A. Person\n\n" + ls.TEMPLATES["ISC"][1]),
    ("0BSD", ls.TEMPLATES["0BSD"][0]),
    ("Zlib", ls.TEMPLATES["Zlib"][1].replace("the authors", "the author")),
    ("MIT", "Copyright 2024 B\n" + ls.TEMPLATES["MIT"][2].replace("Software", "Library")),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
]


@pytest.mark.parametrize("name, text", TOLD, ids=[f"{i}-{n}" for i, (n, _) in enumerate(TOLD)])
def test_licenses_are_told_apart(name, text):
    scanner = ls.Scanner(ls.TEMPLATES)
    for around in ("{}", "lorem ipsum dolor\n{}\nsit amet " * 1, "x " * 400 + "{}" + " y" * 400):
        got = scanner.find(around.format(text))
        assert [g[2] for g in got] == [name], got


def test_versions_and_names_must_agree():
    scanner = ls.Scanner(ls.TEMPLATES)
    for text in ("Licensed under the BSD 4-Clause License.", "This work is licensed under the GNU General Public License, version 4.", "Licensed under CC BY 3.0.", "Licensed under the Apache License, Version 1.1.", "Released under the Mozilla License."):
        assert scanner.find(text) == []
    assert [g[2:3] + g[6:] for g in scanner.find("Licensed under the Apache Licence, Version 2.0.")] == [("Apache-2.0", "-license +licence", "variant")]


def test_compression_decides(monkeypatch):
    """With a constant in its place nothing is found; with another ranking, another license."""
    two = {"A": ("the quick brown fox jumps over the lazy dog near the river bank today",), "B": ("the quick brown fox jumps over the lazy cat near the river bank today",)}
    text = "so the quick brown fox jumps over the lazy dog near the river bank today and on"
    scanner = ls.Scanner(two)
    assert [g[2] for g in scanner.find(text)] == ["A"]
    scanner.reduction = lambda block, name: {"A": 0.1, "B": 0.5}[name]
    assert [(g[2], g[7]) for g in scanner.find(text)] == [("B", "variant")]
    scanner.reduction = lambda block, name: 0.0
    assert scanner.find(text) == []
    monkeypatch.setattr(ls.Scanner, "reduction", lambda self, block, name: 0.0)
    assert all(ls.Scanner(ls.TEMPLATES).find(t) == [] for _, t in TOLD)


def test_each_license_saves_most_on_its_own_text():
    scanner = ls.Scanner(ls.TEMPLATES)
    for name, texts in ls.TEMPLATES.items():
        whole = " ".join(max(texts, key=len).split())
        assert max(scanner.own, key=lambda other: scanner.reduction(whole, other)) == name


def test_alignment_is_the_least():
    rng = random.Random(1)
    for _ in range(200):
        wording = [rng.choice("abcd") for _ in range(rng.randint(1, 7))]
        mine = [rng.choice("abcdx") for _ in range(rng.randint(0, 12))]
        scanner = ls.Scanner({"L": (" ".join(wording),)}, most=0.7)

        @lru_cache(None)
        def cost(i, j, wording=tuple(wording), mine=tuple(mine)):
            """Least cost of the first i words of the wording, ending before place j."""
            if not i:
                return 0
            ways = [cost(i - 1, j) + 1]
            if j:
                ways.append(cost(i, j - 1) + 1)
                if wording[i - 1] == mine[j - 1]:
                    ways.append(cost(i - 1, j - 1))
            return min(ways)

        least = min(cost(len(wording), j) for j in range(len(mine) + 1))
        got = scanner.align(0, mine)
        assert (got is None) == (least > scanner.wordings[0][2])
        if got:
            n, a, b, missing, added = got
            assert n == least == len(missing) + len(added)
            assert len(wording) - len(missing) == b - a - len(added)


def test_repeats_nulls_and_files(spark, tmp_path):
    line = "Released under the MIT License."
    rows = [(1, line), (1, line), (None, line), (2, None), (3, ""), (4, "é " * 20_000 + line + "\n" + "All rights reserved.")]
    got = ls.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as license", "2 as start"))
    found = sorted(((r.doc_id, r.license, r.line, r.verdict) for r in got.collect()), key=str)
    assert found == sorted([(1, "MIT", 0, "exact"), (1, "MIT", 0, "exact"), (None, "MIT", 0, "exact"), (4, "MIT", 0, "exact"), (4, "proprietary", 1, "exact")], key=str)
    (tmp_path / "Own-1.0.txt").write_text("You may use this thing as you like, says its maker.")
    own = ls.read_templates(str(tmp_path))
    assert [r.license for r in ls.scan(spark.createDataFrame([(1, "x You may use this thing as you like, says its maker. y")], "doc_id long, text string"), own).collect()] == ["Own-1.0"]
