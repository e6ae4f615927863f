"""Text operators against brute force, their edge cases and their SQL."""

import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from scrutable.llm import op02_license_scan as op2
from scrutable.llm import op03_bpe_codec as op3
from scrutable.llm import op04_substring_dedup as op4
from scrutable.llm import op08_token_counts as op8
from scrutable.llm import op09_decontamination as op9
from scrutable.llm import op10_line_dedup as op10
from scrutable.llm.bpe import Vocabulary
from scrutable.llm.queries import ORACLES, QUERIES, tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sql(query, documents, benchmark=()):
    con = duckdb.connect()
    con.register("d", pd.DataFrame([x for x in documents if x[0] is not None], columns=["doc_id", "text"]))
    con.sql("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text FROM d")
    con.register("b", pd.DataFrame(list(benchmark) or [(0, "")], columns=["item_id", "text"]))
    con.sql("CREATE VIEW benchmark AS SELECT item_id::BIGINT AS item_id, text FROM b")
    return con.sql(query).df()


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name))


SPECIAL = [(100, "a<|endoftext|>B <|startoftext|><|endoftext|"), (101, "don't WE'LL  it's 12345 ½ ²"), (102, "ΑΣ ΟΔΟΣ İI é ẛ̣"), (103, "tab\tnew\r\nline\x0b\x0c\x85\xa0　end  "), (104, "ab" * 4000), (105, "<|endoftext|>")]


def test_codec_equals_library(spark, docs, documents, no_docs):
    lib = library("word_bpe_49k.json")
    more = spark.createDataFrame(SPECIAL, "doc_id long, text string")
    got = op3.encode_decode(docs.select("doc_id", "text").union(more), tokenizer("word_bpe_49k.json"))
    want = sorted((i if i is not None else -1, tuple(e.ids), lib.decode(e.ids, skip_special_tokens=False)) for i, t in documents + SPECIAL for e in [lib.encode(t or "", add_special_tokens=False)])
    assert sorted((r.doc_id if r.doc_id is not None else -1, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()), r.decoded) for r in got.collect()) == want
    digest = {r.doc_id: r for r in op3.digests(got).where("doc_id IN (101, 0)").collect()}
    ids = lib.encode(SPECIAL[1][1], add_special_tokens=False).ids
    assert digest[101].n_tokens == len(ids) and digest[101].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert digest[0].n_tokens == 0 and digest[0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert op3.encode_decode(no_docs, tokenizer("word_bpe_49k.json")).count() == 0


def test_every_character_as_the_library():
    lib, codec = library("word_bpe_49k.json"), op3.Codec(Vocabulary(tokenizer("word_bpe_49k.json")))
    characters = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(characters), 512):
        for form in ("{}", "e{}\u0301", "b{}1"):
            words = [form.format(c) for c in characters[i : i + 512]]
            for text in (" ".join(words), " ".join(w for w in words if not codec.newer.search(w))):
                assert np.frombuffer(b"".join(codec.encode(text)), "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, (i, form)


def test_forced_cuts_never_split_a_token():
    v = Vocabulary(tokenizer("word_bpe_49k.json"))
    inside = v.forced_pairs()
    assert all(pair in inside for token in list(v.ids)[::97] for plain in [token.removesuffix("</w>")] for pair in zip(plain, plain[1:], strict=False))


def test_heap_and_scan_merge_alike():
    v = Vocabulary(tokenizer("byte_bpe_50k.json"))
    for text in ("internationalisation", "aaaaaaaaaaaaaaaaaaaaaaaa", "thethethethethethethethe"):
        short = v.merge(v.symbols(text, True))
        long = v.merge(v.symbols(text + " " * 0 + "Ġ" * 30, True))
        assert "".join(v.tokens[i] for i in short) == text and "".join(v.tokens[i] for i in long).startswith(text)


def test_counts_equal_library(spark, docs, documents, no_docs):
    lib = library("byte_bpe_50k.json")
    more = spark.createDataFrame(SPECIAL, "doc_id long, text string")
    got = op8.count_tokens(docs.select("doc_id", "text").union(more), tokenizer("byte_bpe_50k.json")).collect()
    want = sorted((i if i is not None else -1, len((t or "").encode()), n, n > 512) for i, t in documents + SPECIAL for n in [len(lib.encode(t or "", add_special_tokens=False).ids)])
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert op8.count_tokens(no_docs, tokenizer("byte_bpe_50k.json")).count() == 0


def brute_lines(documents):
    owner, holders = {}, {}
    key = lambda x: x.strip("\x20\x09\x0a\x0b\x0c\x0d").translate({c: c + 32 for c in range(65, 91)})
    for i, t in documents:
        if i is not None:
            for x in (t or "").split("\n"):
                k = key(x)
                if len(k) >= 10:
                    owner[k] = min(owner.get(k, i), i)
                    holders.setdefault(k, set()).add(i)
    out = []
    for i, t in documents:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders.get(key(x), ())) < 2 or owner[key(x)] == i]
        out.append((-1 if i is None else i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 5])
def test_lines(docs, documents, no_docs, batches):
    got = op10.dedup_lines(docs, batches=batches, fanout=2)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == brute_lines(documents)
    assert op10.dedup_lines(no_docs, batches=batches).count() == 0


def test_lines_sql(docs, documents):
    once = [x for i, x in enumerate(documents) if x[0] is not None and x not in documents[:i]]
    want = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in sql(op10.ORACLE, once).itertuples()}
    got = op10.dedup_lines(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).withColumn("h", F.sha2(F.encode("text", "UTF-8"), 256))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.h) for r in got.collect()} == want


def test_runs_stay_for_later_batches(spark):
    schema = "doc_id long, text string"
    first = spark.createDataFrame([(5, "a common line here\nonly in five, really"), (6, "a common line here")], schema)
    later = spark.createDataFrame([(1, "A COMMON line here \nnew in one, really"), (2, "new in one, really\nonly in five, really")], schema)
    runs = op10.SortedRuns(spark, "kept_runs")
    try:
        op10.dedup_lines(first, batches=3, index="kept_runs")
        assert op10.SortedRuns(spark, "kept_runs").tables()
        got = {r.doc_id: (r.text, r.n_dropped) for r in op10.dedup_lines(later, batches=1, index="kept_runs").collect()}
        assert got == {1: ("new in one, really", 1), 2: ("", 2)}
    finally:
        op10.SortedRuns(spark, "kept_runs").drop()
    assert not runs.tables() and not spark.catalog.listTables(pattern="line_runs*")


def test_runs_answer_without_a_shuffle_of_runs(spark):
    keys = spark.range(100).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("key"), F.col("id").alias("low"), F.col("id").alias("high"))
    runs = op10.SortedRuns(spark, "plan_runs", fanout=2)
    try:
        runs.add(keys.where("low < 60"))
        repeated = runs.add(keys.where("low >= 50"))
        assert sorted(r.owner for r in repeated.collect()) == list(range(50, 60))
        one, two = (runs.run(t) for t in runs.tables())
        assert "Exchange" not in op10.merged(one, two.withColumnRenamed("owner", "other"), "key", "full")._jdf.queryExecution().executedPlan().toString()
        runs.compact()
        assert list(runs.levels) == [1] and runs.run(runs.tables()[0]).count() == 100
    finally:
        runs.drop()


def test_a_line_that_most_rows_hold_is_split(spark, monkeypatch):
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    sizes, real = [], op10.merged

    def join(left, right, on, how="inner"):
        out = real(left, right, on, how)
        if how == "inner":
            sizes.append(out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
        return out

    monkeypatch.setattr(op10, "merged", join)
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("line number "), F.col("id") % 9000)).otherwise("the line of nearly all").alias("text")).repartition(40)
        got = op10.dedup_lines(docs, batches=1)
        assert got.where("n_dropped = 1").count() == 54_000 - 1 + 6000 - 900
        assert sum(sizes[0]) >= 54_000 and max(sizes[0]) <= sum(sizes[0]) / 10
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_one_document_of_very_many_lines(spark):
    text = "\n".join(f"line number {i} of many" for i in range(100_000))
    got = op10.dedup_lines(spark.createDataFrame([(1, text), (2, text + "\nend")], "doc_id long, text string"), batches=1)
    assert sorted((r.doc_id, len(r.text), r.n_dropped) for r in got.collect()) == [(1, len(text), 0), (2, 3, 100_000)]


def brute_windows(documents, size=13):
    first = {}
    for i, t in documents:
        if i is not None:
            w = WORD.findall(t or "")
            for k in range(len(w) - size + 1):
                key = tuple(w[k : k + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in documents:
        w, gone = WORD.findall(t or ""), set()
        if i is not None:
            for k in range(len(w) - size + 1):
                if first[tuple(w[k : k + size])] < i:
                    gone.update(range(k, k + size))
        out.append((-1 if i is None else i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return sorted(out)


def test_substrings(docs, documents, no_docs, monkeypatch):
    want = brute_windows(documents)
    rows = lambda df: sorted((-1 if r.doc_id is None else r.doc_id, r.text, r.n_words, r.n_removed) for r in df.collect())
    assert sum(n for *_, n in want) > 1000
    assert rows(op4.dedup_substrings(docs)) == want
    monkeypatch.setattr(op4, "HOT_SEGMENTS", 3)
    monkeypatch.setattr(op4, "SHARD_SEGMENTS", 2)
    assert rows(op4.dedup_substrings(docs)) == want
    assert op4.dedup_substrings(no_docs).count() == 0


def test_automaton_finds_what_search_finds():
    import random

    rng = random.Random(3)
    texts = [[rng.randrange(3) for _ in range(rng.randint(1, 25))] for _ in range(30)]
    a = op4.SuffixAutomaton()
    for i, t in enumerate(texts):
        a.add(t, i)
    a.close()
    for q in texts + [[rng.randrange(4) for _ in range(40)] for _ in range(10)]:
        for size in (1, 3, 5):
            want = []
            for k in range(len(q) - size + 1):
                own = [i for i, t in enumerate(texts) if any(t[j : j + size] == q[k : k + size] for j in range(len(t) - size + 1))]
                if own:
                    want.append((k, min(own)))
            assert list(a.statistics(q, size)) == want


LICENCE_TEXTS = [
    (0, "Intro.\nReleased under the MIT License."),
    (1, "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    (2, "table | of | words\nLicensed under the Apache License, Version 2.0. All rights reserved."),
    (3, "The word license alone, with copyright, means nothing."),
    (4, None),
    (5, ""),
    (6, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."),
    (7, "this work is licensed under the\ngnu general public license, version 3."),
]


def test_licences(spark, docs, no_docs):
    df = spark.createDataFrame(LICENCE_TEXTS, "doc_id long, text string")
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in op2.scan(df).collect()}
    assert {i: x[1] for i, x in got.items()} == {0: ["MIT"], 1: ["MIT"], 2: ["Apache-2.0", "Proprietary"], 3: [], 4: [], 5: [], 6: ["CC-BY-NC-4.0"], 7: ["GPL-3.0-only"]}
    assert got[1][0] == ["MITgrant", "MITnotice", "MITwarranty"]
    want = sql(op2.ORACLE, LICENCE_TEXTS)
    assert {r.doc_id: (r.sentence_ids, r.licences) for r in want.itertuples()} == {i: ("".join(f"<{x}>" for x in ids), "".join(f"{x};" for x in names)) for i, (ids, names) in got.items()}
    assert op2.scan(docs).where("size(licences) > 0").count() == 0 and op2.scan(no_docs).count() == 0


GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""
ENDORSE = """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
NOTICES = [
    (["GPLfree", "GPLwarranty"], ["GPL-3.0-or-later"], GPL.format(":", ",", 3)),
    (["GPL2free", "GPLwarranty"], ["GPL-2.0-or-later"], GPL.format(";", ";", 2)),
    (["Apache2ref", "Apache2comply", "Apache2copy", "Apache2warranty"], ["Apache-2.0"], APACHE),
    (["MITgrant", "MITnotice", "MITwarranty"], ["MIT"], LICENCE_TEXTS[1][1]),
    (["BSDgrant", "BSDsource", "BSDbinary"], ["BSD-2-Clause"], BSD),
    (["BSDgrant", "BSDsource", "BSDbinary", "BSDendorse"], ["BSD-3-Clause"], BSD + ENDORSE),
    (["MPL2ref"], ["MPL-2.0"], MPL),
    (["ISCgrant"], ["ISC"], ISC),
    (["GPL3ref"], ["GPL-3.0-only"], "SPDX-License-Identifier: GPL-3.0-only"),
    (["GPL2ref"], ["GPL-2.0-only"], "Licensed under the GNU General\nPublic License, version 2."),
    (["CCBYNC4ref"], ["CC-BY-NC-4.0"], "Released under CC-BY-NC-4.0."),
    (["CCBYSA4ref"], ["CC-BY-SA-4.0"], "This work is licensed under a\nCreative Commons Attribution-ShareAlike 4.0 International License."),
    (["CCBY4ref"], ["CC-BY-4.0"], "This work is licensed under a Creative Commons\nAttribution 4.0 International License."),
    (["AllRights"], ["Proprietary"], "All rights reserved."),
    (["MITref", "AllRights"], ["MIT", "Proprietary"], "License: MIT\nAll rights reserved"),
    ([], [], "This program is free software: you can redistribute it, or so they say.\nThe license v. 2.0 is not named."),
]
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""
AGPL = """Frob is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version."""
BSD4 = BSD + """

3. All advertising materials mentioning features or use of this software must
   display the following acknowledgement:
   This product includes software developed by the organization.

4. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission."""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:"""
PG = """Permission to use, copy, modify, and distribute this software and its
documentation for any purpose, without fee, and without a written agreement is
hereby granted, provided that the above copyright notice and this paragraph and
the following two paragraphs appear in all copies."""
EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/"""
NOTICES += [
    (["LGPL21free", "GPLwarranty"], ["LGPL-2.1-or-later"], LGPL),
    (["LGPL2free"], ["LGPL-2.0-or-later"], LGPL.split("\n\n")[0].replace("Lesser", "Library").replace("2.1", "2")),
    (["LGPL3free"], ["LGPL-3.0-or-later"], LGPL.split("\n\n")[0].replace("2.1", "3")),
    (["AGPL3free"], ["AGPL-3.0-or-later"], AGPL),
    (["GPL2only"], ["GPL-2.0-only"], "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation."),
    (["BSDgrant", "BSDsource", "BSDbinary", "BSDadvert", "BSDendorse"], ["BSD-4-Clause"], BSD4),
    (["BSLgrant"], ["BSL-1.0"], BOOST),
    (["Zlibgrant"], ["Zlib"], ZLIB),
    (["PGgrant"], ["PostgreSQL"], PG),
    (["EPL2ref"], ["EPL-2.0"], EPL),
    (["MIT0grant"], ["MIT-0"], NOTICES[3][2].split(", subject to")[0] + "."),
    (["0BSDgrant"], ["0BSD"], ISC.split(", provided")[0] + "."),
    (["MPL11ref", "Apache2comply"], ["MPL-1.1"], "The contents of this file are subject to the Mozilla Public License\nVersion 1.1 (the \"License\"); you may not use this file except in\ncompliance with the License."),
    (["CDDL1ref"], ["CDDL-1.0"], "The contents of this file are subject to the terms of the\nCommon Development and Distribution License (the \"License\")."),
    (["Unlicenseref"], ["Unlicense"], "This is free and unencumbered software released into the public domain."),
    (["CC0ref"], ["CC0-1.0"], "To the extent possible under law, the author(s) have dedicated all copyright\nand related and neighboring rights to this software to the public domain\nworldwide."),
    (["OFL11ref"], ["OFL-1.1"], "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    # grants around another licence's block never join into a third licence
    (["BSDgrant", "MITgrant", "MITnotice", "MITwarranty", "BSDsource", "BSDbinary"], ["MIT"], BSD.split("\n\n")[0] + "\n\n" + NOTICES[3][2] + "\n\n" + BSD.split("\n\n", 1)[1]),
    *[(["BSDgrant", "BSDsource", "BSDbinary", "BSDendorse"], ["BSD-3-Clause"], BSD + f"\n\n3. {clause} be used to endorse or promote products derived from\n   this software without {x}prior written permission.") for x, clause in (
        ("specific ", "Neither the name of Google Inc. nor the names of its\n   contributors may"), ("specific ", "Neither the name of the University of California, Berkeley nor the names of\n   its contributors may"),
        ("", "The name of the author may not"), ("specific ", "Neither the names of the copyright holders nor the names of their\n   contributors may"), ("specific ", "The names of the contributors must not"))],
    *[([ids, "GPLwarranty"], [name], GPL.format(";", ",", v).replace(f"version {v} of the License", f"version {v}")) for ids, name, v in (("GPLfree", "GPL-3.0-or-later", 3), ("GPL2free", "GPL-2.0-or-later", 2))],
    (["MITref", "Apache2ref"], ["MIT", "Apache-2.0"], "SPDX-License-Identifier: MIT OR Apache-2.0"),
    (["GPL2later", "MITref", "BSD3ref"], ["MIT", "GPL-2.0-or-later", "BSD-3-Clause"], "SPDX-License-Identifier: (GPL-2.0-or-later OR MIT) AND BSD-3-Clause"),
    (["GPL2ref", "MITref"], ["MIT", "GPL-2.0-only"], "SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note OR MIT"),
    (["GPL2ref"], ["GPL-2.0-only"], "SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0\nNote that more follows here"),
    ([], [], "SPDX-License-Identifier: MIT OR\nNothing-Known"),
    (["MITref", "MITgrant", "MITnotice", "MITwarranty"], ["MIT"], "The MIT License (MIT)\n\nCopyright (c) 2020 A. B.\n\n" + NOTICES[3][2]),
]
MENTIONS = {
    "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-or-later": "LGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-or-later": "AGPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0+": "GPL-2.0-or-later",
    "This library is distributed under the terms of the GNU Lesser General Public License v3.": "LGPL-3.0-only", "License: LGPL-2.1": "LGPL-2.1-only", "License: LGPL-2.0": "LGPL-2.0-only", "The code is released under the AGPLv3.": "AGPL-3.0-only", "This package is licensed under GPLv3+": "GPL-3.0-or-later",
    "Licensed under the EUPL, version 1.2.": "EUPL-1.2", "Licensed under the Eclipse Public License 1.0": "EPL-1.0", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0", "Released under the 3-Clause BSD License.": "BSD-3-Clause", "## License\n\nBSD-2-Clause": "BSD-2-Clause", "License: 0BSD": "0BSD",
    "licensed under the WTFPL": "WTFPL", "It is available under the Artistic License 2.0.": "Artistic-2.0", "Released under the PostgreSQL License": "PostgreSQL", "License: PSF-2.0": "PSF-2.0", "Licensed under the Microsoft Public License.": "MS-PL", "License: NCSA": "NCSA", "License: OSL-3.0": "OSL-3.0", "License: AFL-3.0": "AFL-3.0",
    "Released under CC BY-ND 4.0.": "CC-BY-ND-4.0", "Released under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0", "Released under CC BY-NC-ND 3.0.": "CC-BY-NC-ND-3.0", "Licensed under CC BY-NC-ND 4.0.": "CC-BY-NC-ND-4.0", "This content is licensed under a Creative Commons Attribution 3.0 Unported License.": "CC-BY-3.0", "The ISC License": "ISC", "Released under the MIT No Attribution License": "MIT-0", "License: zlib": "Zlib", "License: MPL-2.0": "MPL-2.0", "Released under CC0.": "CC0-1.0",
}
NO_MENTIONS = ["The licence fee is due under the contract.", "MIT and ISC are acronyms.", "It is released under the MIT roof", "licensed under the moon", "zlib", "You may redistribute the copies under the table."]
STYLES = [lambda t: t, lambda t: t.replace("\n", "\r\n"), *[lambda t, m=m: "Copyright 2020 A. B.\n\n" + "\n".join(m + x for x in t.split("\n")) for m in ("    ", "# ", "// ", " * ", ";; ", "-- ", "\t")], lambda t: "/*\n * " + t.replace("\n", "\n * ") + "\n */\nint x;", lambda t: "\n".join("dnl " + x for x in t.split("\n"))]


def test_canonical_notices(spark):
    rows = [(k * 100 + i, style(t), ids, names) for k, style in enumerate(STYLES) for i, (ids, names, t) in enumerate(NOTICES)]
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in op2.scan(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")).collect()}
    assert got == {i: (ids, names) for i, _, ids, names in rows}


def test_mentions_and_sql(spark):
    texts = [*MENTIONS, *NO_MENTIONS, *(t for *_, t in NOTICES), *(STYLES[k](t) for k in (1, 3, 5, 10) for *_, t in NOTICES)]
    got = {r.doc_id: r for r in op2.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {t: got[i].licences for i, t in enumerate(MENTIONS)} == {t: [n] for t, n in MENTIONS.items()}
    assert all(got[i].sentence_ids == [] for i in range(len(MENTIONS), len(MENTIONS) + len(NO_MENTIONS)))
    found = {n for _, names, _ in NOTICES for n in names} | set(MENTIONS.values())
    assert {n for n, _ in op2.RULES if not n.endswith(("-2.0", "-3.0")) or not n.startswith("CC-")} <= found | {f"CC-{k}-4.0" for k in ("BY", "BY-SA", "BY-NC")} and len({n for n, _ in op2.RULES}) > 50
    want = sql(op2.ORACLE, list(enumerate(texts)))
    assert {r.doc_id: (r.sentence_ids, r.licences) for r in want.itertuples()} == {i: ("".join(f"<{x}>" for x in r.sentence_ids), "".join(f"{x};" for x in r.licences)) for i, r in got.items()}


def items(documents):
    long = next(t for i, t in documents if i == 82).split()
    edited = long[200:240]
    edited[20] = "other"
    texts = {i: t for i, t in documents}
    return [(0, " ".join(long[100:130])), (1, " ".join(edited)), (2, "one two"), (3, None), (4, ""), (5, "never seen words at all in here"), (6, " ".join(texts[45].split()[:25])), (7, " ".join(long[5000:5300])), (7, " ".join(long[5000:5300]))]


def test_decontamination(spark, docs, documents, no_docs):
    bench = spark.createDataFrame(items(documents), "item_id long, text string")
    rows = lambda df: sorted((r.doc_id, r.item_id, r.n_shared, r.n_item, round(r.containment, 9)) for r in df.collect())
    got = rows(op9.find_contained(docs, bench))
    want = sql(op9.ORACLE, documents, items(documents))
    assert got == rows(spark.createDataFrame(want)) and {(82, 0), (82, 1), (82, 7), (3, 2), (4, 2), (5, 2)} <= {x[:2] for x in got}
    assert rows(op9.find_contained(docs, bench, most_bytes=-1)) == got and rows(op9.find_contained(docs, bench, common=1)) == got
    kept = op9.decontaminate(docs, bench)
    assert kept.count() == len([x for x in documents if x[0] not in {g[0] for g in got}]) and kept.columns == docs.columns
    assert op9.find_contained(no_docs, bench).count() == 0 and op9.find_contained(docs, bench.limit(0)).count() == 0


def test_decontamination_with_shared_boilerplate(spark):
    """Shingles that all items share: still exactly the pairs of SQL, with few candidates from the shared part."""
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    common = " ".join(word() for _ in range(12))
    bench = [(i, f"{common} {' '.join(word() for _ in range(rng.randint(0, 20)))}") for i in range(60)]
    texts = [(i, f"{word()} {common} {word()}") for i in range(40)] + [(100 + i, f"{word()} {bench[i][1]} {word()}") for i in range(20)] + [(None, bench[0][1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, _hit int")
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = {(r.doc_id, r.item_id, r.n_shared) for r in sql(op9.ORACLE, texts, bench).itertuples()}
    for common_items in (1000, 5):
        assert {(r.doc_id, r.item_id, r.n_shared) for r in op9.find_contained(docs, items, common=common_items).collect()} == want
    hit = {d for d, *_ in want}
    assert sorted(r.doc_id or -1 for r in op9.decontaminate(docs, items).collect()) == sorted(i or -1 for i, _ in texts if i is None or i not in hit)


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
