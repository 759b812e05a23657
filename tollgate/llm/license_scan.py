"""Licence scan by sentence rules, in SQL functions only.

Texts are cut into sentences and lines, and each is normalised and looked up among known
licence sentences. The identifiers found keep their places in the text: any other
sentence between two of them stays as a gap. They are matched against ordered licence
rules, sequences of identifiers next to each other. The first rule that finds its sequence
takes the identifiers and leaves a gap, so longer rules stand before the ones that they
contain and no rule joins what stood apart.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

# Parts that the GNU notices share.
_FREE = "you can redistribute it and/or modify it under the terms of the {}"
_PUBLISHED = " as published by the Free Software Foundation"
_LATER = "either version {} of the License, or (at your option) any later version"
# Identifiers of SPDX lines; the older ones with a plain version or a plus mean the newer names.
_SPDX = {
    "MIT": "MIT", "Apache-2.0": "Apache-2.0", "BSD-2-Clause": "BSD-2-Clause", "BSD-3-Clause": "BSD-3-Clause", "ISC": "ISC",
    "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0", "Unlicense": "Unlicense", "CC-BY-4.0": "CC-BY-4.0",
    "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0", "EPL-1.0": "EPL-1.0", "EPL-2.0": "EPL-2.0",
    "MPL-1.1": "MPL-1.1", "0BSD": "0BSD", "Zlib": "Zlib", "BSL-1.0": "BSL-1.0", "Artistic-2.0": "Artistic-2.0",
    "EUPL-1.2": "EUPL-1.2", "CDDL-1.0": "CDDL-1.0", "PostgreSQL": "PostgreSQL", "NCSA": "NCSA", "WTFPL": "WTFPL",
} | {
    f"{name}{end}": f"{name}-{'or-later' if end == '-or-later' else 'only'}"
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")
    for end in ("", "-only", "-or-later")
}
# Names of licences and their versions.
_NAMED = (
    ("Apache-2.0", "Apache License", "2.0"), ("Apache-2.0", "Apache Software License", "2.0"),
    ("EPL-1.0", "Eclipse Public License", "1.0"), ("EPL-2.0", "Eclipse Public License", "2.0"),
    ("MPL-1.1", "Mozilla Public License", "1.1"), ("MPL-2.0", "Mozilla Public License", "2.0"),
    ("BSL-1.0", "Boost Software License", "1.0"), ("Artistic-2.0", "Artistic License", "2.0"),
    ("EUPL-1.2", "European Union Public Licence", "1.2"), ("CDDL-1.0", "Common Development and Distribution License", "1.0"),
    ("ISC", "ISC License", ""), ("Zlib", "zlib License", ""), ("BSD-2-Clause", "BSD 2-Clause License", ""),
    ("BSD-3-Clause", "BSD 3-Clause License", ""), ("PostgreSQL", "PostgreSQL License", ""),
)
_VERSION = ("{} {}", "{}, Version {}", "{} v{}", "{} - v {}")
_SAID = ("{}", "The {}", "Licensed under the {}", "Released under the {}", "Distributed under the {}",
         "This work is licensed under the {}", "This project is licensed under the {}", "This software is licensed under the {}")
_CC_SHORT = ("cc-by-short", "cc-by-sa-short", "cc-by-nc-short")

# Sentences of public licences and notices, by identifier.
SENTENCES = {
    "apache-name": "Apache License, Version 2.0",
    "apache-under": "Licensed under the Apache License, Version 2.0",
    "apache-under-the": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache-url-s": "https://www.apache.org/licenses/LICENSE-2.0",
    "apache-basis": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'
    ),
    "mit-name": "MIT License",
    "mit-the": "The MIT License (MIT)",
    "mit-released": "Released under the MIT License",
    "mit-under": "Licensed under the MIT License",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "mit-notice": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software"
    ),
    "bsd-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer"
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution"
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission"
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "gpl-name": "GNU General Public License",
    "gpl-work-3": "This work is licensed under the GNU General Public License, version 3",
    "gpl-later-3": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ),
    "gpl-later-2": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 2 of the License, or (at your option) any later version"
    ),
    "gpl-see": "See the GNU General Public License for more details",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-short": "Licensed under CC BY 4.0",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0",
    "rights-reserved": "All rights reserved",
    "rights-reserved-worldwide": "All rights reserved worldwide",
    "bsd-name-2": "BSD 2-Clause License",
    "bsd-name-3": "BSD 3-Clause License",
    "gpl-terms": _FREE.format("GNU General Public License") + _PUBLISHED,
    "gpl-terms-2": _FREE.format("GNU General Public License version 2") + _PUBLISHED,
    "gpl-conditions-2": _FREE.replace("terms", "terms and conditions").format("GNU General Public License, version 2,") + _PUBLISHED,
    "gpl-work-2": "This work is licensed under the GNU General Public License, version 2",
    "lgpl-terms": _FREE.format("GNU Lesser General Public License") + _PUBLISHED,
    "lgpl-later-3": _FREE.format("GNU Lesser General Public License") + _PUBLISHED + ", " + _LATER.format("3"),
    "lgpl-later-2.1": _FREE.format("GNU Lesser General Public License") + _PUBLISHED + ", " + _LATER.format("2.1"),
    "lgpl-see": "See the GNU Lesser General Public License for more details",
    "lgpl-work-3": "This work is licensed under the GNU Lesser General Public License, version 3",
    "lgpl-work-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "agpl-terms": _FREE.format("GNU Affero General Public License") + _PUBLISHED,
    "agpl-later-3": _FREE.format("GNU Affero General Public License") + _PUBLISHED + ", " + _LATER.format("3"),
    "agpl-see": "See the GNU Affero General Public License for more details",
    "agpl-work-3": "This work is licensed under the GNU Affero General Public License, version 3",
    # The second half where a semicolon stands before it.
    "later-2": _LATER.format("2"),
    "later-2.1": _LATER.format("2.1"),
    "later-3": _LATER.format("3"),
    # The stop of "v. 2.0" ends a sentence; only version 2.0 speaks of a Source Code Form.
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "mpl-copy-s": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl-name": "Mozilla Public License Version 2.0",
    "mpl-under": "Licensed under the Mozilla Public License, Version 2.0",
    "cc0-name": "CC0 1.0 Universal",
    "cc0-short": "Licensed under CC0 1.0",
    "cc0-marked": "This work is marked with CC0 1.0 Universal",
    "cc0-dedicated": (
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights "
        "to this software to the public domain worldwide"
    ),
    "unlicense-name": "The Unlicense",
    "unlicense-free": "This is free and unencumbered software released into the public domain",
    # An SPDX line is cut at its colon, so the tag and the identifier are sentences of their own.
    "spdx": "SPDX-License-Identifier",
} | {f"spdx-{name}": name for name in _SPDX} | {
    f"cc-{kind}-{how}": text.format(kind)
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
    for how, text in (("licensed", "Licensed under CC {} 4.0"), ("work", "This work is licensed under CC {} 4.0"))
    if f"cc-{kind}-{how}".lower().replace("licensed", "short") not in _CC_SHORT
} | {
    f"cc-{kind}-long": f"This work is licensed under a Creative Commons {words} 4.0 International License"
    for kind, words in (
        ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    )
}

# Other ways to name a licence, one identifier for all of a licence's: said as name and version.
SAID: dict[str, list[str]] = {}
for _licence, _name, _number in _NAMED:
    _versions = [v.format(_name, _number) for v in _VERSION] if _number else [_name]
    _forms = [form.format(v) for form in _SAID for v in _versions]
    _new = {" ".join(re.findall("[a-z0-9]+", s.lower())) for s in SENTENCES.values()}
    SAID.setdefault(f"said-{_licence}", []).extend(
        s for s in _forms if " ".join(re.findall("[a-z0-9]+", s.lower())) not in _new
    )

# Ordered rules, a licence and the identifiers that must follow each other.
RULES = (
    ("Apache-2.0", ("apache-under-the", "apache-comply", "apache-copy", "apache-url", "apache-basis")),
    ("Apache-2.0", ("apache-under-the", "apache-comply", "apache-copy", "apache-url-s", "apache-basis")),
    ("Apache-2.0", ("apache-under-the", "apache-comply")),
    ("Apache-2.0", ("apache-under-the",)),
    ("Apache-2.0", ("apache-under",)),
    ("Apache-2.0", ("apache-name",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-under",)),
    ("MIT", ("mit-the",)),
    ("MIT", ("mit-name",)),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("GPL-3.0-or-later", ("gpl-later-3", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-later-3",)),
    ("GPL-2.0-or-later", ("gpl-later-2", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-later-2",)),
    ("GPL-3.0-only", ("gpl-work-3",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("BSD-2-Clause", ("bsd-name-2",)),
    ("BSD-3-Clause", ("bsd-name-3",)),
    ("GPL-2.0-or-later", ("gpl-terms", "later-2")),
    ("GPL-3.0-or-later", ("gpl-terms", "later-3")),
    ("GPL-2.0-only", ("gpl-terms-2",)),
    ("GPL-2.0-only", ("gpl-conditions-2",)),
    ("GPL-2.0-only", ("gpl-work-2",)),
    ("LGPL-3.0-or-later", ("lgpl-later-3",)),
    ("LGPL-2.1-or-later", ("lgpl-later-2.1",)),
    ("LGPL-3.0-or-later", ("lgpl-terms", "later-3")),
    ("LGPL-2.1-or-later", ("lgpl-terms", "later-2.1")),
    ("LGPL-3.0-only", ("lgpl-work-3",)),
    ("LGPL-2.1-only", ("lgpl-work-2.1",)),
    ("AGPL-3.0-or-later", ("agpl-later-3",)),
    ("AGPL-3.0-or-later", ("agpl-terms", "later-3")),
    ("AGPL-3.0-only", ("agpl-work-3",)),
    ("MPL-2.0", ("mpl-subject",)),
    ("MPL-2.0", ("mpl-copy",)),
    ("MPL-2.0", ("mpl-copy-s",)),
    ("MPL-2.0", ("mpl-name",)),
    ("MPL-2.0", ("mpl-under",)),
    ("CC0-1.0", ("cc0-name",)),
    ("CC0-1.0", ("cc0-short",)),
    ("CC0-1.0", ("cc0-marked",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("Unlicense", ("unlicense-name",)),
    ("Unlicense", ("unlicense-free",)),
    *((licence, ("spdx", f"spdx-{name}")) for name, licence in _SPDX.items()),
    *((f"CC-{i[3:-5]}-4.0", (i,)) for i in SENTENCES if re.fullmatch("cc-BY.*-(work|long)", i)),
    *((f"CC-{i[3:-9]}-4.0", (i,)) for i in SENTENCES if re.fullmatch("cc-BY.*-licensed", i)),
    *((i.removeprefix("said-"), (i,)) for i in SAID),
    # Named as found, also beside a licence that grants some of the rights.
    ("LicenseRef-all-rights-reserved", ("rights-reserved",)),
    ("LicenseRef-all-rights-reserved", ("rights-reserved-worldwide",)),
)

# Where a sentence ends: stops before white space or the end, or an empty line.
SENTENCE_END = r"[.!?;:]+([ \t\r\f\n]|\z)|\n[ \t\r\f]*\n"
# The same with every line feed as an end, for notices on lines of their own.
LINE_END = r"[.!?;:]+([ \t\r\f\n]|\z)|\n"
# Numbers that lists put before their sentences, and comment signs, go with the rest.
OTHER = r"[^a-z0-9]+"
# A sentence is a piece with a word in it; list numbers and comment signs alone are none.
WORD = "[A-Za-z]{2}"
# Operators of SPDX expressions, in capitals, and the brackets around their parts.
OPERATOR = r"[ \t]+(OR|AND)[ \t]+"
# Place of a sentence that is not known.
GAP = "~"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalise(sentence: str) -> str:
    """The driver's form of what the plan does to every sentence."""
    return re.sub(OTHER, " ", sentence.lower()).strip()


def cue(sentences: Iterable[str]) -> str:
    """A pattern that every sentence holds: long words, in turn the one in most sentences left.

    A sentence without a long word is looked for by its first one.
    """
    left, words = {normalise(s) for s in sentences}, []
    while left:
        counts = Counter(w for s in left for w in set(s.split()) if len(w) >= 7)
        if not counts:
            break
        words.append(min(counts, key=lambda w: (-counts[w], -len(w), w)))
        left = {s for s in left if words[-1] not in s}
    first = sorted({s.split()[0] for s in left})
    return "(?i)" + "|".join(words + ([f"(?<![a-z0-9])(?:{'|'.join(first)})(?![a-z0-9])"] if first else []))


def variants() -> list[tuple[str, str]]:
    """Identifier and sentence of all that is known."""
    return [*SENTENCES.items(), *((name, s) for name, some in SAID.items() for s in some)]


# Every known sentence holds one of these; other sentences need no normalising.
CUE = cue(s for _, s in variants())


def known_sentences() -> dict[str, str]:
    """Identifier by normalised sentence; a sentence that itself holds a stop is refused."""
    known: dict[str, str] = {}
    for name, sentence in variants():
        if known.setdefault(normalise(sentence), name) != name:
            raise ValueError(f"a sentence has two identifiers: {sentence}")
        if re.search(r"[.!?;:](\s|$)", sentence):
            raise ValueError(f"a stop within: {sentence}")
    return known


def _identifiers(text: Column, end: str, known: Column) -> Column:
    """Identifiers of a text's sentences in order, ``GAP`` for every sentence that is not known.

    An SPDX expression is known if all its parts are SPDX identifiers; the tag is said again
    before every part but the first.
    """

    def named(part: Column) -> Column:
        return F.element_at(known, F.trim(F.regexp_replace(F.translate(part, _UPPER, _LOWER), OTHER, " ")))

    def expression(sentence: Column) -> Column:
        parts = F.transform(F.split(sentence, OPERATOR), named)
        whole = F.forall(parts, lambda i: F.coalesce(i.startswith("spdx-"), F.lit(False)))
        return F.when(whole, F.array_join(parts, "||spdx||"))

    def identifier(sentence: Column) -> Column:
        found = F.when(sentence.rlike(OPERATOR), expression(sentence)).otherwise(named(sentence))
        return F.coalesce(F.when(sentence.rlike(CUE), found), F.lit(GAP))

    return F.transform(F.filter(F.split(text, end), lambda s: s.rlike(WORD)), identifier)


def _licences(identifiers: Column) -> Column:
    """Names of the rules that match, each rule in turn taking what it matches."""
    rules = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit("".join(f"|{i}|" for i in ids)).alias("ids")) for name, ids in RULES]
    )
    joined = F.concat(F.lit("|"), F.array_join(identifiers, "||"), F.lit("|"))
    start = F.struct(joined.alias("left"), F.expr("cast(array() as array<string>)").alias("names"))
    names = F.aggregate(
        rules,
        start,
        lambda state, rule: F.struct(
            F.replace(state["left"], rule["ids"], F.lit(f"|{GAP}|")).alias("left"),
            F.when(F.contains(state["left"], rule["ids"]), F.array_union(state["names"], F.array(rule["name"])))
            .otherwise(state["names"]).alias("names"),
        ),
        lambda state: state["names"],
    )
    some = F.exists(identifiers, lambda i: i != GAP)
    return F.when(some, names).otherwise(F.expr("cast(array() as array<string>)"))


def scan_licences(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id``, ``n_known`` and ``licences``.

    ``n_known`` counts the known sentences in the text cut at sentence ends; ``licences``
    holds the names found there or on single lines, sorted and joined by commas, empty if
    none. Null and empty texts have none. A notice that all rights are reserved is named
    as such, whatever else the text holds; an SPDX identifier counts as known wherever it
    is a sentence, and names its licence right behind the SPDX tag, alone or in an expression
    of AND and OR. One pass without a shuffle; the rules are part
    of the plan. Repeated rows give repeated rows, other columns are not looked at.
    """
    pairs = [F.lit(x) for item in known_sentences().items() for x in item]
    text = F.coalesce(F.col("text"), F.lit(""))
    cued = docs.select(F.col("doc_id").cast("long"), F.when(text.rlike(CUE), text).alias("cued"))
    known = F.create_map(*pairs)
    cut = cued.select(
        "doc_id",
        _identifiers(F.col("cued"), SENTENCE_END, known).alias("sentences"),
        _identifiers(F.col("cued"), LINE_END, known).alias("lines"),
    )
    names = F.array_sort(F.array_union(_licences(F.col("sentences")), _licences(F.col("lines"))))
    return cut.select(
        "doc_id",
        F.coalesce(F.size(F.filter("sentences", lambda i: i != GAP)), F.lit(0)).cast("long").alias("n_known"),
        F.coalesce(F.array_join(names, ","), F.lit("")).alias("licences"),
    )
