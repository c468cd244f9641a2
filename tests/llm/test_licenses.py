"""Licence scans: known texts, wrapped lines, order of rules, odd rows."""

from __future__ import annotations

import pytest

from patraka.llm import licenses
from patraka.llm.queries import op10_license_scan

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""
CASES = [
    ("SPDX-License-Identifier: MIT", "MIT"),
    ("// SPDX-License-Identifier: Apache-2.0", "Apache-2.0"),
    ("SPDX-License-Identifier: Zlib", "Zlib"),
    ("SPDX-License-Identifier: my-own-1", "my-own-1"),
    ("/* SPDX-License-Identifier: (MIT OR apache-2.0) */", "MIT,Apache-2.0"),
    ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 AND mit.", "GPL-2.0-only WITH Classpath-exception-2.0,MIT"),
    ("You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.", ""),
    ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "LGPL-3.0-or-later"),
    ("This library is free software, redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or any later version.", "LGPL-2.1-or-later"),
    ("Released under the MIT License.", "MIT"),
    ("This work is licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ("Copyright (c) 2020 Someone. All rights reserved.", "Proprietary"),
    ("Copyright 2020 Someone.", "Copyright-notice"),
    (MIT, "MIT"),
    ("# " + MIT.replace("\n", "\n# "), "MIT"),
    (APACHE, "Apache-2.0"),
    ("Licensed under the 3-clause BSD license.", "BSD-3-Clause"),
    ("some words. Released under the MIT License. more words. Licensed under the Apache License, Version 2.0.", "MIT,Apache-2.0"),
    ("I got my driving licence in Paris. The permission was given.", ""),
    ("plain words", ""),
    ("", ""),
    (None, ""),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_known_texts(text, expected):
    scanner = licenses.Scanner()
    assert ",".join(dict.fromkeys(scanner.licences(scanner.identifiers(text or "")))) == expected


def test_earlier_rules_win_and_consume():
    rules = (("long", ("a", "b")), ("short", ("a",)), ("other", ("b",)))
    scanner = licenses.Scanner((("a", "licence a"), ("b", "licence b")), rules)
    found = scanner.identifiers("Licence a. Licence b. Licence a. Licence a.")
    assert scanner.licences(found) == ["long", "short", "short"]


def plain_scan(text: str) -> tuple[list[str], list[str]]:
    """Every run of lines of every sentence with every pattern, longest first, without hints or memory."""
    found: list[tuple[str, dict]] = []

    def known(part: str):
        said = licenses.normalise(part)
        return next(((name, m.groupdict()) for name, p in licenses.SENTENCES if (m := licenses.regex.fullmatch(p, said))), None)

    for sentence in licenses.END.split(text):
        lines, at = sentence.split("\n"), 0
        while at < len(lines):
            run = next(((to, got) for to in range(len(lines), at, -1) if (got := known("\n".join(lines[at:to])))), None)
            if run:
                found.append(run[1])
            at = run[0] if run else at + 1
    out, at = [], 0
    while at < len(found):
        rule = next((r for r in licenses.RULES if [n for n, _ in found[at : at + len(r[1])]] == list(r[1])), None)
        if rule:
            values = {k: v or "" for _, d in found[at : at + len(rule[1])] for k, v in d.items()}
            name = rule[0].format(**values, NAME=values.get("name", "").upper())
            for part in licenses.regex.split(" or | and ", name):
                out.append(" WITH ".join({n.lower(): n for n in (*licenses.SPDX, *(r[0] for r in licenses.RULES))}.get(x.lower(), x) for x in part.split(" with ")))
        at += len(rule[1]) if rule else 1
    return [n for n, _ in found], list(dict.fromkeys(out))


def test_query_like_a_plain_pass(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_sentences, r.sentence_ids, r.licenses) for r in op10_license_scan(spark, sf).collect()}
    plain = {i: plain_scan(t or "") for i, t in docs.items()}
    assert got == {i: (len(ids), ",".join(ids), ",".join(names)) for i, (ids, names) in plain.items()}
    assert any(names for _, names in plain.values())


def test_callers_sentences_need_no_common_word(spark):
    own = (("zebra", "the zebra may be copied( freely)?"), ("any", "(a|b) c"))
    df = spark.createDataFrame([(1, "Hm. The zebra may be copied. B c."), (2, "nothing")], "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan(df, own, (("Zebra-1.0", ("zebra",)),)).collect()))
    assert got == [(1, 2, "zebra,any", "Zebra-1.0"), (2, 0, "", "")]


@pytest.mark.parametrize("name,pattern", licenses.SENTENCES)
def test_hints_are_in_every_text_of_their_pattern(name, pattern):
    word = licenses.hint(pattern)
    assert word and licenses.regex.search(rf"(?<!\w){word}(?!\w)", pattern)


def test_rows(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, MIT), (2, None), (3, "word " * 400_000 + "\nReleased under the MIT License.\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as licenses", "2 as n_sentences")
    got = licenses.scan(df).collect()
    assert sorted((r.doc_id or 0, r.n_sentences, r.licenses) for r in got) == [(0, 2, "MIT"), (1, 1, "MIT"), (1, 1, "MIT"), (2, 0, ""), (3, 1, "MIT")]
    assert licenses.scan(df.limit(0)).count() == 0


def test_long_sentences_and_narrow_wraps():
    scanner = licenses.Scanner()
    names = lambda text: [x[0] for x in scanner.identifiers(text)]
    assert names("x " * 6000 + "dedicated to the public domain " + "y " * 100) == ["cc0"]
    assert names("Copyright 2020 " + "z" * 10_000) == ["copyright"]
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, subject to the following conditions:"
    words = grant.split()
    wrapped = "\n".join(" ".join(words[i : i + 2]) for i in range(0, len(words), 2))
    assert wrapped.count("\n") > 15
    assert names("THE LICENCE\n" + wrapped + "\n\nother") == ["mitGrant"]
