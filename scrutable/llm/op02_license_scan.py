"""Licence scan by sentence rules; DataFrame functions only.

A text is cut into parts at line ends and at stops before a blank; comment signs, comment words, indentation
and list marks at the head of a line fall away, and each part is normalised to lower-case letters and digits
with single blanks. Known licence sentences become identifiers. A sentence may lie in several parts in a row,
because it holds a stop such as ':' or 'v. ' or because its lines are wrapped; it must begin and end where
parts do, and the longest one wins. A mention is a sentence of a fixed form around the name of a licence
("licensed under the ...", "SPDX-License-Identifier: ..."), or a full name by itself. The sequence of
identifiers is then read by ordered rules: the first rule that finds its sequence claims it, so a full grant
text is not reported again as a mere mention; what lay on the two sides of a claimed sequence never becomes
one sequence.

Nulls and empty texts have no sentence; one row comes out for each row, repeated rows repeat; other columns
are never read; an empty table gives no rows. Everything happens within a row, without a shuffle, so hot
sources and huge groups of copies do not matter. Texts are scanned whole.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, functions as F

#: Known licence sentences by identifier.
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
_DEAL = "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_MIT = f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), {_DEAL}"
_ENDORSE = "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
HOLDER = "the copyright holder"  # stands for whoever is named
_USE = "for any purpose with or without fee is hereby granted"
_HOPE = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"
_NOTICE = "the above copyright notice and this permission notice"
TEXTS = {
    "MITgrant": [f"{_MIT}, subject to the following conditions"],
    "MIT0grant": [_MIT],
    "MITnotice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "MITwarranty": [f"{_AS_IS} AND NONINFRINGEMENT"],
    "BSLgrant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following"],
    "Apache2comply": ["you may not use this file except in compliance with the License"],
    "Apache2copy": [f"You may obtain a copy of the License at {s}://www.apache.org/licenses/LICENSE-2.0" for s in ("http", "https")],
    "Apache2warranty": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "GPLwarranty": [f"This {x} {_HOPE}" for x in ("program", "library", "software", "file")],
    "BSDgrant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSDsource": [f"Redistributions of source code must retain the {x}, this list of conditions and the following disclaimer" for x in ("above copyright notice", "copyright notice")],
    "BSDbinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "BSDadvert": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "BSDendorse": [f"Neither the name of {HOLDER} {_ENDORSE}"],
    "ISCgrant": [f"Permission to use, copy, modify, {a}distribute this software {_USE}, provided that {_NOTICE} appear in all copies" for a in ("and/or ", "and ")],
    "0BSDgrant": [f"Permission to use, copy, modify, {a}distribute this software {_USE}" for a in ("and/or ", "and ")],
    "PGgrant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"],
    "Zlibgrant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "MPL2ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "MPL11ref": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the License)"],
    "CDDL1ref": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the License)"],
    "EPL1ref": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "EPL2ref": [f"This program and the accompanying materials are made available under the terms of the Eclipse Public License {v}2.0 which is available at {s}://www.eclipse.org/legal/epl-2.0" for v in ("", "v") for s in ("http", "https")],
    "Unlicenseref": ["This is free and unencumbered software released into the public domain"],
    "CC0ref": [f"To the extent possible under law, the {x} dedicated all copyright and related and neighboring rights to this {y} to the public domain worldwide" for x in ("author(s) have", "author has") for y in ("software", "work")],
    "OFL11ref": ["This Font Software is licensed under the SIL Open Font License, Version 1.1"],
    "AllRights": ["All rights reserved"],
}
#: Licences of the GNU family; identifiers of the notice, of the notice without later versions and of a mention.
for _later, _only, _ref, _name, _version in (
    ("GPLfree", "GPL3only", "GPL3ref", "GNU General Public License", "3"),
    ("GPL2free", "GPL2only", "GPL2ref", "GNU General Public License", "2"),
    ("LGPL3free", "LGPL3only", "LGPL3ref", "GNU Lesser General Public License", "3"),
    ("LGPL21free", "LGPL21only", "LGPL21ref", "GNU Lesser General Public License", "2.1"),
    ("LGPL2free", "LGPL2only", "LGPL2ref", "GNU Library General Public License", "2"),
    ("AGPL3free", "AGPL3only", "AGPL3ref", "GNU Affero General Public License", "3"),
):
    _terms = f"you can redistribute it and/or modify it under the terms of the {_name}"
    _forms = [f"{_terms} as published by the Free Software Foundation"]
    TEXTS[_later] = [f"{head}{x}, {v}, or (at your option) any later version" for x in _forms for v in (f"either version {_version} of the License", f"either version {_version}", f"version {_version} of the License") for head in ("", "This program is free software, ", "This library is free software, ")]
    TEXTS[_only] = [f"{x}{v}" for x in _forms for v in (f", version {_version} of the License", f", version {_version}")] + [f"{_terms} version {_version} as published by the Free Software Foundation", f"{_terms} version {_version} only, as published by the Free Software Foundation"]
#: Names that a mention may give, by identifier: full ones, that may stand by themselves, and short ones.
FULL = {
    "MITref": ["MIT License", "MIT License (MIT)", "Expat License"],
    "MIT0ref": ["MIT No Attribution License", "MIT No Attribution"],
    "Apache2ref": ["Apache License, Version 2.0", "Apache License Version 2.0 (the License)", "Apache License 2.0", "Apache License v2.0", "Apache Software License 2.0"],
    "GPL3ref": ["GNU General Public License version 3", "GNU General Public License v3", "GNU General Public License v3.0"],
    "GPL2ref": ["GNU General Public License version 2", "GNU General Public License v2", "GNU General Public License v2.0"],
    "LGPL3ref": ["GNU Lesser General Public License version 3", "GNU Lesser General Public License v3", "GNU Lesser General Public License v3.0"],
    "LGPL21ref": ["GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1"],
    "LGPL2ref": ["GNU Library General Public License version 2", "GNU Library General Public License v2"],
    "AGPL3ref": ["GNU Affero General Public License version 3", "GNU Affero General Public License v3", "GNU Affero General Public License v3.0"],
    "MPL2ref": ["Mozilla Public License version 2.0", "Mozilla Public License v2.0", "Mozilla Public License 2.0", "Mozilla Public License v. 2.0"],
    "MPL11ref": ["Mozilla Public License version 1.1", "Mozilla Public License 1.1"],
    "EPL1ref": ["Eclipse Public License version 1.0", "Eclipse Public License v1.0", "Eclipse Public License 1.0"],
    "EPL2ref": ["Eclipse Public License version 2.0", "Eclipse Public License v2.0", "Eclipse Public License 2.0"],
    "CDDL1ref": ["Common Development and Distribution License", "Common Development and Distribution License version 1.0", "Common Development and Distribution License 1.0"],
    "EUPL12ref": ["European Union Public License version 1.2", "European Union Public Licence version 1.2", "European Union Public Licence v1.2", "European Union Public Licence v. 1.2"],
    "BSLref": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License"],
    "BSD2ref": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "FreeBSD License"],
    "BSD3ref": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "ISCref": ["ISC License"],
    "Zlibref": ["zlib License", "zlib/libpng License"],
    "Unlicenseref": ["Unlicense"],
    "WTFPLref": ["Do What The Fuck You Want To Public License", "Do What The Fuck You Want To Public License, Version 2"],
    "CC0ref": ["CC0 1.0 Universal License", "Creative Commons Zero License", "Creative Commons CC0 1.0 Universal License"],
    "Artistic2ref": ["Artistic License 2.0", "Artistic License version 2.0"],
    "OFL11ref": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"],
    "PGref": ["PostgreSQL License"],
    "PSFref": ["Python Software Foundation License version 2", "Python Software Foundation License"],
    "MSPLref": ["Microsoft Public License"],
    "NCSAref": ["University of Illinois/NCSA Open Source License", "NCSA Open Source License"],
    "OSL3ref": ["Open Software License 3.0", "Open Software License version 3.0"],
    "AFL3ref": ["Academic Free License 3.0", "Academic Free License version 3.0"],
}
SHORT = {
    "MITref": ["MIT"],
    "MIT0ref": ["MIT-0"],
    "Apache2ref": ["Apache-2.0", "Apache 2", "Apache 2.0 License", "Apache License 2"],
    "GPL3ref": ["GPL-3.0", "GPL-3.0-only", "GPLv3", "GPL v3", "GPL version 3", "GNU GPL version 3", "GNU GPL v3"],
    "GPL3later": ["GPL-3.0-or-later", "GPL-3.0+", "GPLv3+"],
    "GPL2ref": ["GPL-2.0", "GPL-2.0-only", "GPLv2", "GPL v2", "GPL version 2", "GNU GPL version 2", "GNU GPL v2"],
    "GPL2later": ["GPL-2.0-or-later", "GPL-2.0+", "GPLv2+"],
    "LGPL3ref": ["LGPL-3.0", "LGPL-3.0-only", "LGPLv3", "LGPL v3"],
    "LGPL3later": ["LGPL-3.0-or-later"],
    "LGPL21ref": ["LGPL-2.1", "LGPL-2.1-only", "LGPLv2.1", "LGPL v2.1"],
    "LGPL21later": ["LGPL-2.1-or-later"],
    "LGPL2ref": ["LGPL-2.0", "LGPL-2.0-only"],
    "LGPL2later": ["LGPL-2.0-or-later"],
    "AGPL3ref": ["AGPL-3.0", "AGPL-3.0-only", "AGPLv3", "AGPL v3"],
    "AGPL3later": ["AGPL-3.0-or-later"],
    "MPL2ref": ["MPL-2.0", "MPL 2", "MPLv2"],
    "MPL11ref": ["MPL-1.1"],
    "EPL1ref": ["EPL-1.0"],
    "EPL2ref": ["EPL-2.0"],
    "CDDL1ref": ["CDDL-1.0", "CDDL"],
    "EUPL12ref": ["EUPL-1.2", "EUPL version 1.2", "EUPL v1.2"],
    "BSLref": ["BSL-1.0"],
    "BSD2ref": ["BSD-2-Clause", "2-clause BSD"],
    "BSD3ref": ["BSD-3-Clause", "3-clause BSD"],
    "0BSDref": ["0BSD"],
    "ISCref": ["ISC"],
    "Zlibref": ["zlib"],
    "WTFPLref": ["WTFPL"],
    "CC0ref": ["CC0", "CC0 1.0", "CC0-1.0"],
    "Artistic2ref": ["Artistic-2.0"],
    "OFL11ref": ["OFL-1.1"],
    "PGref": ["PostgreSQL"],
    "PSFref": ["PSF-2.0", "Python-2.0"],
    "MSPLref": ["MS-PL"],
    "NCSAref": ["NCSA"],
    "OSL3ref": ["OSL-3.0"],
    "AFL3ref": ["AFL-3.0"],
}
#: Creative Commons licences: kinds by identifier, with the kind's long name.
CC = {"CCBY": ("CC-BY", "Attribution"), "CCBYSA": ("CC-BY-SA", "Attribution-ShareAlike"), "CCBYNC": ("CC-BY-NC", "Attribution-NonCommercial"), "CCBYND": ("CC-BY-ND", "Attribution-NoDerivatives"), "CCBYNCSA": ("CC-BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), "CCBYNCND": ("CC-BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")}
for _id, (_short, _long) in CC.items():
    for _v in ("4.0", "3.0", "2.0"):
        SHORT[f"{_id}{_v[0]}ref"] = [f"{_short}-{_v}", f"Creative Commons {_long} {_v}", f"Creative Commons {_long}"] if _v == "4.0" else [f"{_short}-{_v}", f"Creative Commons {_long} {_v}"]
        FULL[f"{_id}{_v[0]}ref"] = [f"Creative Commons {_long} {_v} {x} License" for x in ("International", "Unported", "Generic")] + [f"Creative Commons {_long} {_v} License"]
#: Ordered rules, the identifiers in sequence and the licence they mean.
RULES = [
    ("MIT", ["MITgrant", "MITnotice", "MITwarranty"]),
    ("MIT", ["MITgrant", "MITnotice"]),
    ("MIT-0", ["MIT0grant", "MITwarranty"]),
    ("MIT-0", ["MIT0grant"]),
    ("BSL-1.0", ["BSLgrant"]),
    ("Apache-2.0", ["Apache2ref", "Apache2comply", "Apache2copy", "Apache2warranty"]),
    ("Apache-2.0", ["Apache2ref", "Apache2comply"]),
    *[(f"{n}-or-later", [x, "GPLwarranty"][:k]) for n, x in (("GPL-3.0", "GPLfree"), ("GPL-2.0", "GPL2free"), ("LGPL-3.0", "LGPL3free"), ("LGPL-2.1", "LGPL21free"), ("LGPL-2.0", "LGPL2free"), ("AGPL-3.0", "AGPL3free")) for k in (2, 1)],
    *[(f"{n}-only", [x, "GPLwarranty"][:k]) for n, x in (("GPL-3.0", "GPL3only"), ("GPL-2.0", "GPL2only"), ("LGPL-3.0", "LGPL3only"), ("LGPL-2.1", "LGPL21only"), ("LGPL-2.0", "LGPL2only"), ("AGPL-3.0", "AGPL3only")) for k in (2, 1)],
    ("BSD-4-Clause", ["BSDgrant", "BSDsource", "BSDbinary", "BSDadvert", "BSDendorse"]),
    ("BSD-3-Clause", ["BSDgrant", "BSDsource", "BSDbinary", "BSDendorse"]),
    ("BSD-2-Clause", ["BSDgrant", "BSDsource", "BSDbinary"]),
    ("ISC", ["ISCgrant"]),
    ("0BSD", ["0BSDgrant"]),
    ("PostgreSQL", ["PGgrant"]),
    ("Zlib", ["Zlibgrant"]),
    *[(n, [x]) for n, x in (("MPL-2.0", "MPL2ref"), ("MPL-1.1", "MPL11ref"), ("CDDL-1.0", "CDDL1ref"), ("EPL-1.0", "EPL1ref"), ("EPL-2.0", "EPL2ref"), ("Unlicense", "Unlicenseref"), ("CC0-1.0", "CC0ref"), ("OFL-1.1", "OFL11ref"))],
    *[(n, [x]) for n, x in (("MIT", "MITref"), ("MIT-0", "MIT0ref"), ("Apache-2.0", "Apache2ref"))],
    *[(f"{n}-or-later", [x]) for n, x in (("GPL-3.0", "GPL3later"), ("GPL-2.0", "GPL2later"), ("LGPL-3.0", "LGPL3later"), ("LGPL-2.1", "LGPL21later"), ("LGPL-2.0", "LGPL2later"), ("AGPL-3.0", "AGPL3later"))],
    *[(f"{n}-only", [x]) for n, x in (("GPL-3.0", "GPL3ref"), ("GPL-2.0", "GPL2ref"), ("LGPL-3.0", "LGPL3ref"), ("LGPL-2.1", "LGPL21ref"), ("LGPL-2.0", "LGPL2ref"), ("AGPL-3.0", "AGPL3ref"))],
    *[(n, [x]) for n, x in (("EUPL-1.2", "EUPL12ref"), ("BSL-1.0", "BSLref"), ("BSD-2-Clause", "BSD2ref"), ("BSD-3-Clause", "BSD3ref"), ("0BSD", "0BSDref"), ("ISC", "ISCref"), ("Zlib", "Zlibref"), ("WTFPL", "WTFPLref"), ("Artistic-2.0", "Artistic2ref"))],
    *[(n, [x]) for n, x in (("PostgreSQL", "PGref"), ("PSF-2.0", "PSFref"), ("MS-PL", "MSPLref"), ("NCSA", "NCSAref"), ("OSL-3.0", "OSL3ref"), ("AFL-3.0", "AFL3ref"))],
    *[(f"{short}-{v}", [f"{i}{v[0]}ref"]) for i, (short, _) in CC.items() for v in ("4.0", "3.0", "2.0")],
    ("Proprietary", ["AllRights"]),
]
#: The words around a name in a mention.
SUBJECTS = [f"{a} {x} is" for a in ("this", "the") for x in ("project", "software", "work", "file", "code", "source code", "program", "package", "library", "repository", "document", "content", "module")] + ["it is"]
VERBS = ["licensed", "released", "distributed", "published", "available", "made available", "provided"]
BEFORE = ["", "the ", "a ", "an ", "terms of the ", "the terms of the ", "the terms of ", "terms of "]
LABELS = ["license ", "licence ", "spdx license identifier "]
WITHOUT_LABEL = ["", "the "]


PLUS = r"([0-9])\+(?![a-z0-9])"  # "GPL-2.0+" is another licence than "GPL-2.0"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", re.sub(PLUS, r"\1 or later", sentence.lower())).strip()


#: A sentence against endorsement, whoever is named, and the one that stands for all of them.
_WHO = "(?:[a-z0-9]+ ){1,20}"
ENDORSEMENT = f"(?:neither the names? of {_WHO}nor the names? of {_WHO}(?:may|must)|the names? of {_WHO}(?:may|must) not) be used to endorse or promote products derived from this software without (?:specific )?prior written permission"
ENDORSED = normal(TEXTS["BSDendorse"][0])
SPDX = "spdx license identifier "

SENTENCES = {normal(s): i for i, group in TEXTS.items() for s in group}
NAMES = {normal(s): i for kind in (SHORT, FULL) for i, group in kind.items() for s in group}
ALONE = {normal(s): i for i, group in FULL.items() for s in group}
#: Every known sentence, and the frame of every mention, holds one of these, so a text without any has no identifier.
CUES = "licen|permi|rights|software|redistribut|copyright|warrant|under|materials|public domain|attribution"
assert all(re.search(CUES, s) for s in (*SENTENCES, *ALONE))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HEAD = r"\n[^a-z0-9\n(]*(?:(?:dnl|rem)(?![a-z0-9]))?[^a-z0-9\n(]*(?:\(?[0-9a-z]{1,2}[.)][ \t]+)?"
STOP = r"[.!?:;][\x20\x09-\x0D]+"


def _any(words) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


FRAME = f"(?:(?:{_any(SUBJECTS)} )?{_any(VERBS)} under {_any(BEFORE)}|{_any(LABELS)})"
#: An exception in an SPDX expression, such as "WITH Classpath-exception-2.0".
EXCEPTION = " with(?: [a-z0-9]+){1,5}? (?:exception|note)(?: [0-9]+)*"
_ONE = f"{_any(NAMES)}(?:{EXCEPTION})?"
EXPRESSION = f"{SPDX}{_ONE}(?: (?:or|and) {_ONE})*"
#: A known sentence or mention in one part or several, from the start of a part to the end of one; longer ones first.
KNOWN = f"(?<=\n)(?:{_any(SENTENCES)}|{ENDORSEMENT}|{EXPRESSION}|{FRAME}{_any(NAMES)}|{_any(WITHOUT_LABEL)}{_any(ALONE)})(?=\n)".replace(" ", "[ \n]")


def identifiers(text):
    """Array of the identifiers of a text's known sentences, in order."""
    lines = F.concat(F.lit("\n"), F.translate(text, UPPER, LOWER), F.lit("\n"))
    heads = F.regexp_replace(F.regexp_replace(lines, HEAD, "\n"), PLUS, "$1 or later")
    parts = F.regexp_replace(F.regexp_replace(heads, STOP, "\n"), "[^a-z0-9\n]+", " ")
    parts = F.regexp_replace(parts, " ?\n[ \n]*", "\n")
    known = F.from_json(F.lit(json.dumps(NAMES | SENTENCES)), "map<string,string>")
    name = lambda s: F.try_element_at(known, F.regexp_replace(s, f"^(?:{FRAME}|the (?={_any(ALONE)}$))", ""))
    one = lambda s: F.coalesce(F.try_element_at(known, s), F.when(s.rlike(f"^{ENDORSEMENT}$"), F.lit("BSDendorse")), name(s))
    named = lambda s: F.split(F.regexp_replace(F.substring(s, len(SPDX) + 1, 1 << 30), EXCEPTION, ""), " (?:or(?! later)|and) ")
    ids = lambda s: F.when(F.startswith(s, F.lit(SPDX)), F.transform(named(s), lambda x: F.try_element_at(known, x))).otherwise(F.array(one(s)))
    found = F.flatten(F.transform(F.regexp_extract_all(parts, F.lit(KNOWN), F.lit(0)), lambda s: ids(F.translate(s, "\n", " "))))
    return F.when(F.translate(text, UPPER, LOWER).rlike(CUES), found).otherwise(F.array().cast("array<string>"))


def licences(ids):
    """Licences that the ordered rules read from a sequence of identifiers, in rule order, each once."""
    sequence = F.concat(F.lit(""), F.concat_ws("", F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">")))))
    rules = F.from_json(F.lit(json.dumps([{"seq": "".join(f"<{x}>" for x in seq), "name": name} for name, seq in RULES])), "array<struct<seq:string,name:string>>")
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("names"))
    read = F.aggregate(
        rules,
        start,
        lambda acc, r: F.when(F.contains(acc["left"], r["seq"]), F.struct(F.replace(acc["left"], r["seq"], F.lit("|")).alias("left"), F.array_append(acc["names"], r["name"]).alias("names"))).otherwise(acc),
    )
    return F.array_distinct(read["names"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, licences) of every row: arrays, empty where nothing is recognised."""
    found = docs.select(F.col(id_col).alias("doc_id"), identifiers(F.coalesce(F.col(text_col), F.lit(""))).alias("sentence_ids"))
    return found.withColumn("licences", F.when(F.size("sentence_ids") > 0, licences(F.col("sentence_ids"))).otherwise(F.array().cast("array<string>")))


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows) + ")"


def _oracle(spans: int = 20) -> str:
    """The same in SQL another way: mentions spelled out as a table, runs of up to `spans` parts looked up whole, longest first, left to right."""
    sql = f"""WITH RECURSIVE known(k, id) AS (SELECT * FROM {_values(SENTENCES.items())} s(k, id)
 UNION SELECT coalesce(s || ' ', '') || v || ' under ' || b || n, id FROM {_values((x,) for x in SUBJECTS)} AS subject(x), (SELECT unnest([x, NULL]) AS s), {_values((x,) for x in VERBS)} AS verb(v), {_values((x,) for x in BEFORE)} AS before(b), {_values(NAMES.items())} AS name(n, id)
 UNION SELECT l || n, id FROM {_values((x,) for x in LABELS)} AS label(l), {_values(NAMES.items())} AS name(n, id)
 UNION SELECT a || n, id FROM {_values((x,) for x in WITHOUT_LABEL)} AS article(a), {_values(ALONE.items())} AS name(n, id)),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS ln FROM documents),
heads AS (SELECT doc_id, ln, regexp_replace(regexp_replace(regexp_replace(ltrim(translate(line, '{UPPER}', '{LOWER}'), ' #*/;-%!|>"' || chr(9) || chr(13)), '^(dnl|rem)\\b', ''), '^[^a-z0-9(]+', ''), '^\\(?[0-9a-z]{{1,2}}[.)][ \\t]+', '') AS line FROM lines),
cut AS (SELECT doc_id, ln, unnest(string_split_regex(line, '[.!?:;]([ \\t\\r\\f\\v]+|$)')) AS p, generate_subscripts(string_split_regex(line, '[.!?:;]([ \\t\\r\\f\\v]+|$)'), 1) AS sub FROM heads),
part AS (SELECT doc_id, list(p ORDER BY ln, sub) AS ps FROM (SELECT doc_id, ln, sub, trim(regexp_replace(regexp_replace(p, '([0-9])\\+([^a-z0-9]|$)', '\\1 or later\\2', 'g'), '[^a-z0-9]+', ' ', 'g')) AS p FROM cut) WHERE p <> '' GROUP BY doc_id),
spot AS (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM part),
given AS (SELECT doc_id, i, n, array_to_string(ps[i:i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, least({spans}, len(ps) - i + 1) + 1)) AS n FROM spot)),
run AS (SELECT doc_id, i, n, CASE WHEN k LIKE '% to endorse or promote products %' AND regexp_full_match(k, '{ENDORSEMENT}') THEN '{ENDORSED}' ELSE k END AS k FROM given),
expression AS (SELECT k, string_split_regex(regexp_replace(replace(substr(k, {len(SPDX) + 1}), ' or later', ' orlater'), '{EXCEPTION}', '', 'g'), ' (or|and) ') AS names FROM (SELECT DISTINCT k FROM run WHERE k LIKE '{SPDX}%')),
term AS (SELECT k, len(names) AS m, replace(unnest(names), ' orlater', ' or later') AS term, generate_subscripts(names, 1) AS j FROM expression),
spdx AS (SELECT k, string_agg(id, '><' ORDER BY j) AS id FROM term JOIN {_values(NAMES.items())} AS name(term, id) USING (term) GROUP BY k HAVING count(*) = max(m)),
best AS (SELECT doc_id, i, max(n) AS n, arg_max(id, n) AS id FROM run JOIN (SELECT k, id FROM known UNION SELECT k, id FROM spdx) USING (k) GROUP BY doc_id, i),
walk AS (SELECT doc_id, CAST(1 AS BIGINT) AS nxt, '' AS ids FROM documents
 UNION ALL SELECT doc_id, i + n, ids || '<' || id || '>' FROM (SELECT w.doc_id, w.ids, b.i, b.n, b.id, row_number() OVER (PARTITION BY w.doc_id ORDER BY b.i) AS first FROM walk w JOIN best b ON b.doc_id = w.doc_id AND b.i >= w.nxt) WHERE first = 1),
r0 AS (SELECT doc_id, ids, ids AS seq, '' AS names FROM (SELECT doc_id, arg_max(ids, nxt) AS ids FROM walk GROUP BY doc_id))"""
    for i, (name, seq) in enumerate(RULES):
        p = "".join(f"<{x}>" for x in seq)
        sql += f",\nr{i + 1} AS (SELECT doc_id, ids, replace(seq, '{p}', '|') AS seq, names || CASE WHEN contains(seq, '{p}') AND NOT contains(';' || names, ';{name};') THEN '{name};' ELSE '' END AS names FROM r{i})"
    return sql + f"\nSELECT doc_id, ids AS sentence_ids, names AS licences FROM r{len(RULES)}"


ORACLE = _oracle()
