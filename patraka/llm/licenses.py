"""Licence scans by sentence rules.

A text is cut into sentences; a normalised sentence that is known maps to an identifier; the sequence of
identifiers is matched against ordered rules, the first that fits at a place winning and consuming its
identifiers. Sentences and rules are tables that callers may extend.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patraka.llm.common import rows_of

#: (identifier, pattern of the whole normalised sentence). Normalised: lower case, comment marks and
#: punctuation but ``. + - /`` blanked, white space collapsed, the final stop dropped.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("spdx", r"spdx-license-identifier (?P<expression>[a-z0-9.+-]+( (or|and|with) [a-z0-9.+-]+)*)"),
    ("rights", r"(copyright .* )?all rights reserved"),
    ("copyright", r"copyright (c )?\d{4}.*"),
    ("mitRelease", r"((this|the) (work|software|file|code|project|library) is )?(released|licensed|distributed|available) under (the terms of )?the (mit|expat) license"),
    ("mitGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files .* subject to the following conditions"),
    ("mitNotice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("asIs", r"the software is provided as is without warranty of any kind .*"),
    ("asIsLiable", r"in no event shall the authors or copyright holders be liable .*"),
    ("iscGrant", r"permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apacheGrant", r"((this|the) (work|software|file|code|project|library) is )?(released |distributed )?(licensed )?under (the terms of )?the apache (software )?license,? version 2.0( the license)?"),
    ("apacheUse", r"you may not use this file except in compliance with the license"),
    ("apacheCopy", r"you may obtain a copy of the license at .*"),
    ("apacheWarranty", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis .*"),
    ("gpl3Release", r"((this|the) (work|software|file|code|program|project|library) is )?(released|licensed|distributed) under (the terms of )?the gnu general public license,?( as published by the free software foundation)?,? (version|v) ?3(.0)?( only)?"),
    ("gpl2Release", r"((this|the) (work|software|file|code|program|project|library) is )?(released|licensed|distributed) under (the terms of )?the gnu general public license,?( as published by the free software foundation)?,? (version|v) ?2(.0)?( only)?"),
    ("gpl3Later", r".*(redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation) either version 3 of the license or (at your option )?any later version"),
    ("gpl2Later", r".*(redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation) either version 2 of the license or (at your option )?any later version"),
    ("lgpl21Later", r".*(redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation) either version 2.1 of the license or (at your option )?any later version"),
    ("lgpl3Later", r".*(redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation) either version 3 of the license or (at your option )?any later version"),
    ("agpl3Later", r".*(redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation) either version 3 of the license or (at your option )?any later version"),
    ("gnuWarranty", r"this (program|library) is distributed in the hope that it will be useful but without any warranty.*"),
    ("gnuReceived", r"you should have received a copy of the gnu (lesser |affero )?general public license along with this (program|library).*"),
    ("gnuDetails", r"see the gnu (lesser |affero )?general public license for more details"),
    ("mpl2", r"this source code form is subject to the terms of the mozilla public license,? v. 2.0"),
    ("bsdGrant", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsdSource", r"(1\. |\* |- )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsdBinary", r"(2\. |\* |- )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsdEndorse", r"(3\. |\* |- )?neither the name of .* nor the names of .* may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsdRelease", r"((this|the) (work|software|file|code|project|library) is )?(released|licensed|distributed) under (the terms of )?the (?P<name>2|3)-clause bsd license"),
    ("zlibGrant", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("boostGrant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license .*"),
    ("boostRelease", r"((this|the) (work|software|file|code|project|library) is )?(released|licensed|distributed) under the boost software license,? version 1.0"),
    ("epl2", r"this program and the accompanying materials are made available under the terms of the eclipse public license,? (v|v\. ?|version )2.0.*"),
    ("ofl", r"this font software is licensed under the sil open font license,? version 1.1"),
    ("cc", r"((this|the) (work|text|page|article|content) is )?licensed under (a |the )?(cc|creative commons) (?P<name>by(-nc)?(-sa|-nd)?) (?P<version>\d\.\d)( international)?( license)?"),
    ("cc0", r".*dedicated to the public domain.*"),
    ("cc0", r".*licensed under cc0 1.0.*"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
)

#: (licence, identifiers in sequence); the first rule that fits at a place wins.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("BSD-3-Clause", ("bsdGrant", "bsdSource", "bsdBinary", "bsdEndorse")),
    ("BSD-2-Clause", ("bsdGrant", "bsdSource", "bsdBinary")),
    ("MIT", ("mitGrant", "mitNotice", "asIs", "asIsLiable")),
    ("MIT", ("mitGrant", "mitNotice", "asIs")),
    ("MIT", ("mitGrant", "mitNotice")),
    ("ISC", ("iscGrant",)),
    ("Apache-2.0", ("apacheGrant", "apacheUse", "apacheCopy", "apacheWarranty")),
    ("Apache-2.0", ("apacheGrant",)),
    ("Apache-2.0", ("apacheUse", "apacheCopy")),
    ("LGPL-2.1-or-later", ("lgpl21Later", "gnuWarranty", "gnuDetails", "gnuReceived")),
    ("LGPL-2.1-or-later", ("lgpl21Later",)),
    ("LGPL-3.0-or-later", ("lgpl3Later", "gnuWarranty", "gnuDetails", "gnuReceived")),
    ("LGPL-3.0-or-later", ("lgpl3Later",)),
    ("AGPL-3.0-or-later", ("agpl3Later", "gnuWarranty", "gnuDetails", "gnuReceived")),
    ("AGPL-3.0-or-later", ("agpl3Later",)),
    ("GPL-3.0-or-later", ("gpl3Later", "gnuWarranty", "gnuDetails", "gnuReceived")),
    ("GPL-3.0-or-later", ("gpl3Later",)),
    ("GPL-2.0-or-later", ("gpl2Later", "gnuWarranty", "gnuDetails", "gnuReceived")),
    ("GPL-2.0-or-later", ("gpl2Later",)),
    ("GPL-3.0-only", ("gpl3Release",)),
    ("GPL-2.0-only", ("gpl2Release",)),
    ("MPL-2.0", ("mpl2",)),
    ("MIT", ("mitRelease",)),
    ("BSD-{name}-Clause", ("bsdRelease",)),
    ("CC-{NAME}-{version}", ("cc",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlibGrant",)),
    ("BSL-1.0", ("boostGrant",)),
    ("BSL-1.0", ("boostRelease",)),
    ("EPL-2.0", ("epl2",)),
    ("OFL-1.1", ("ofl",)),
    ("{expression}", ("spdx",)),
    ("Proprietary", ("copyright", "rights")),
    ("Proprietary", ("rights",)),
    ("Copyright-notice", ("copyright",)),
)

#: Identifiers as they are written, beside those of the rules; an expression may hold others, which come in lower case.
SPDX = tuple(
    """
    0BSD AFL-3.0 AGPL-3.0-only Apache-1.0 Apache-1.1 Artistic-1.0 Artistic-2.0 BSD-4-Clause BlueOak-1.0.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0
    CDDL-1.0 CDDL-1.1 CECILL-2.1 Classpath-exception-2.0 EPL-1.0 EUPL-1.1 EUPL-1.2 GCC-exception-3.1 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0+ GPL-3.0 GPL-3.0+
    LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1+ LGPL-2.1-only LGPL-3.0 LGPL-3.0-only Linux-syscall-note LLVM-exception LPPL-1.3c MIT-0 MPL-1.1 MS-PL MS-RL
    NCSA ODbL-1.0 OpenSSL PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 Ruby Unicode-3.0 UPL-1.0 Vim W3C WTFPL X11
    """.split()
)


def hint(pattern: str) -> str | None:
    """The longest word that every text of a pattern holds, or None; words in groups, classes and escapes don't count."""
    plain = regex.sub(r"\\.|\[[^\]]*\]|\{[^}]*\}", " ", pattern)
    while (less := regex.sub(r"\([^()]*\)[?*+]*", " ", plain)) != plain:
        plain = less
    if "|" in plain or "(" in plain:
        return None
    words = regex.findall(r"(?<![\p{L}\p{N}?*+.])[\p{L}]{3,}(?![\p{L}\p{N}?*+])", plain)
    return max(words, key=len) if words else None


def hints(sentences: Sequence[tuple[str, str]]) -> tuple[str, ...]:
    """Words of which every raw text with one of the sentences holds one in lower case, so that other texts are done at once; the empty word if there are none such."""
    words = {hint(p) for _, p in sentences}
    return ("",) if None in words else tuple(sorted(words))


END = regex.compile(r"(?i)(?<!license-identifier:)(?<=[.!?;:])\s+|\n\s*\n")
MARKS = regex.compile(r"[^\p{L}\p{N}.+/\s-]|(?<=\s)[-/.]+(?=\s)")
BLANKS = regex.compile(r"\s+")
LINES = 12  # lines of the runs that are tried with every pattern; longer ones end where a pattern with an end of its own does
KEPT = 4000  # characters of the sentences that are remembered


def normalise(sentence: str) -> str:
    return BLANKS.sub(" ", MARKS.sub(" ", f" {sentence} ".lower())).strip(" .-/")


@dataclass
class Scanner:
    sentences: Sequence[tuple[str, str]] = SENTENCES
    rules: Sequence[tuple[str, tuple[str, ...]]] = RULES
    known: dict[str, tuple[str, dict] | None] = field(default_factory=dict)

    def __post_init__(self):
        self.names = {name.lower(): name for name in (*SPDX, *(name for name, _ in self.rules)) if "{" not in name}  # as an identifier may be written
        self.hints = hints(self.sentences)
        self.patterns = [(name, regex.compile(p)) for name, p in self.sentences]
        closed = [(name, p) for name, p in self.sentences if not p.endswith(".*")]
        self.closed = [(name, p.startswith(".*"), regex.compile(rf"(?<!\S)(?:{p.removeprefix('.*').replace('.*', '.*?')})(?!\S)")) for name, p in closed]

    def hinted(self, text: str) -> bool:
        low = text.lower()
        return any(w in low for w in self.hints)

    def identify(self, sentence: str) -> tuple[str, dict] | None:
        text = normalise(sentence)
        if text in self.known:
            return self.known[text]
        found = ((name, m) for name, p in self.patterns if (m := p.fullmatch(text)))
        got = next(((name, m.groupdict()) for name, m in found), None)
        if len(text) < KEPT:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[text] = got
        return got

    def long_runs(self, lines: list[str]) -> dict[int, tuple[int, tuple[str, dict]]]:
        """By first line the end and the sentence of runs of more than LINES lines."""
        parts = [normalise(x) for x in lines]
        kept = [i for i, x in enumerate(parts) if x]
        ends = np.cumsum([len(parts[i]) + 1 for i in kept]) - 1
        text, out = " ".join(parts[i] for i in kept), {}
        for name, anywhere, p in self.closed:
            for m in p.finditer(text):
                first, last = (int(np.searchsorted(ends, at)) for at in (m.start() + 1, m.end()))
                begins = anywhere or m.start() == (ends[first - 1] + 1 if first else 0)
                if begins and ends[last] == m.end() and kept[last] - kept[first] >= LINES:
                    out.setdefault(kept[first], (kept[last] + 1, (name, m.groupdict())))
        return out

    def identifiers(self, text: str) -> list[tuple[str, dict]]:
        """Known sentences in order. Lines are tried one by one and in runs where a whole sentence is unknown."""
        out = []
        for sentence in END.split(text):
            if not self.hinted(sentence):
                continue
            if got := self.identify(sentence):
                out.append(got)
                continue
            lines = sentence.split("\n")
            long_ = self.long_runs(lines) if len(lines) > LINES else {}
            at = 0
            while len(lines) > 1 and at < len(lines):
                for to in range(min(len(lines), at + LINES), at, -1):
                    part = "\n".join(lines[at:to])
                    if self.hinted(part) and (got := self.identify(part)):
                        out.append(got)
                        at = to
                        break
                else:
                    if at in long_:
                        out.append(long_[at][1])
                    at = long_[at][0] if at in long_ else at + 1
        return out

    def expression(self, text: str) -> list[str]:
        """The licences that an SPDX expression names, each with its exception."""
        parts = regex.split(r" (?:or|and) ", text)
        return [" WITH ".join(self.names.get(x, x) for x in p.split(" with ")) for p in parts]

    def licences(self, found: list[tuple[str, dict]]) -> list[str]:
        out, at, names = [], 0, [x[0] for x in found]
        while at < len(names):
            for licence, sequence in self.rules:
                if tuple(names[at : at + len(sequence)]) == tuple(sequence):
                    values = {k: v or "" for _, d in found[at : at + len(sequence)] for k, v in d.items()}
                    said = licence.format(**values, NAME=values.get("name", "").upper()) if "{" in licence else licence
                    out += self.expression(said) if "{expression}" in licence else [self.names.get(said.lower(), said)]
                    at += len(sequence)
                    break
            else:
                at += 1
        return out


def scan(docs: DataFrame, sentences: Sequence[tuple[str, str]] = SENTENCES, rules: Sequence[tuple[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """``(doc_id, n_sentences, sentence_ids, licenses)`` by row of ``docs(doc_id, text)``.

    n_sentences counts known licence sentences; ``sentence_ids`` has them in order, ``licenses`` the distinct
    licences in order of first appearance, both joined by commas and empty if there is none. Of an SPDX
    expression each licence counts, with its exception. A null text has none. Whole texts are read, whatever
    their length. Null ids and repeated rows get a row each, an empty table gives an empty result, other
    columns, of whatever name, are not read.
    """
    sentences, rules = tuple(sentences), tuple(rules)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sentences, rules)
        for batch in it:
            for part in rows_of(batch, 4 << 20, "text"):
                ids, licences, counts = [], [], []
                for text in part.column(1).to_pylist():
                    found = scanner.identifiers(text) if text and scanner.hinted(text) else []
                    counts.append(len(found))
                    ids.append(",".join(x[0] for x in found))
                    licences.append(",".join(dict.fromkeys(scanner.licences(found))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(licences, pa.string())], names=["doc_id", "n_sentences", "sentence_ids", "licenses"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_sentences long, sentence_ids string, licenses string")
