import re

import pytest
from pyspark.sql import SparkSession

from tabloom.llm import licences, queries
from tabloom.llm.licences import RULES, SENTENCES, WHOLE, canonical, identify, match_rules, normalise


def names(text):
    return ",".join(canonical(f.licence)[0] for f in match_rules(identify(text)))


ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""


@pytest.mark.parametrize("text, want", [
    ("(c) 2020 Foo Corp.", "COPYRIGHT"),
    ("Copyright (c) 2019-2021 Jane Doe", "COPYRIGHT"),
    ("Copyright The Foo Authors", "COPYRIGHT"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, "
     "compile, sell, or distribute\nthis software, either in source code form or as a compiled binary, for any purpose, commercial "
     "or non-commercial, and by any means.", "Unlicense"),
    ("To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to Foo.", "CC0-1.0"),
    ("Released under CC0 1.0 Universal.", "CC0-1.0"),
    (ZLIB, "Zlib"),
    ("This program and the accompanying materials are made available under the\nterms of the Eclipse Public License 2.0 which is "
     "available at https://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
    ("// Distributed under the Boost Software License, Version 1.0.\n// (See accompanying file LICENSE_1_0.txt)", "BSL-1.0"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "version 2 as published by the Free Software Foundation.", "GPL-2.0-only"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation; version 2 of the License.", "GPL-2.0-only"),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
     "GPL-2.0-or-later"),
    ("Licensed under the Apache 2.0 license.", "Apache-2.0"),
    ("Licensed under either Apache License, Version 2.0 or MIT.", "Apache-2.0 OR MIT"),
    ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0 OR MIT"),
    ("C compilers need a license.", ""),
    ("Copyright law is a complex field.", ""),
    ("// SPDX-License-Identifier: (mit or apache-2.0)", "SPDX:(MIT OR Apache-2.0)"),
    ("/* SPDX-License-Identifier: gpl-2.0-only WITH classpath-exception-2.0 */", "SPDX:GPL-2.0-only WITH Classpath-exception-2.0"),
    ("<!-- SPDX-License-Identifier: MIT -->", "SPDX:MIT"),
])
def test_wordings(text, want):
    assert names(text) == want


@pytest.mark.parametrize("value, shown, single", [
    ("SPDX:MIT", "SPDX:MIT", ["MIT"]),
    ("SPDX:(MIT OR APACHE-2.0) AND ISC", "SPDX:(MIT OR Apache-2.0) AND ISC", ["MIT", "Apache-2.0", "ISC"]),
    ("SPDX:GPL-2.0-ONLY WITH CLASSPATH-EXCEPTION-2.0", "SPDX:GPL-2.0-only WITH Classpath-exception-2.0",
     ["GPL-2.0-only WITH Classpath-exception-2.0"]),
    ("SPDX:MIT OR", "SPDX:MIT OR", ["SPDX:MIT OR"]),
    ("SPDX:(MIT", "SPDX:(MIT", ["SPDX:(MIT"]),
    ("SPDX:MIT)", "SPDX:MIT)", ["SPDX:MIT)"]),
    ("SPDX:MIT ISC", "SPDX:MIT ISC", ["SPDX:MIT ISC"]),
    ("SPDX:MIT WITH (ISC)", "SPDX:MIT WITH (ISC)", ["SPDX:MIT WITH (ISC)"]),
    ("SPDX:FOO-1", "SPDX:FOO-1", ["FOO-1"]),
    ("Apache-2.0 OR MIT", "Apache-2.0 OR MIT", ["Apache-2.0", "MIT"]),
    ("COPYRIGHT", "COPYRIGHT", ["COPYRIGHT"]),
])
def test_expressions(value, shown, single):
    assert canonical(value) == (shown, single)


def plain_sentences(text):
    """Cut by looking at every place in turn; lines with a tag stand alone."""
    pieces, now = [], []
    for line in text.split("\n"):
        if "spdx-license-identifier:" in line.lower():
            pieces += ["\n".join(now) + "\n", line]
            now = [""]
        else:
            now.append(line)
    pieces.append("\n".join(now))
    out = []
    for piece in pieces:
        if "spdx-license-identifier:" in piece.lower():
            out.append(piece)
            continue
        start = at = 0
        while at < len(piece):
            stop = at
            while stop < len(piece) and piece[stop].isspace():
                stop += 1
            before, after = piece[at - 1:at], piece[stop:stop + 1]
            blank = piece[at:stop]
            cut = blank and (before and before in ".!?;:" and (("A" <= after <= "Z") or after and after in "(\"'")
                             or before and before in ".!?" and "\n" in blank or blank.count("\n") > 1)
            if cut:
                out.append(piece[start:at])
                start = stop
            at = max(stop, at + 1)
        out.append(piece[start:])
    return [s for s in out if s.strip()]


def plain_licences(text):
    """Every sentence against every known one, and every rule at every place."""
    known = {normalise(s): name for name, s in WHOLE}

    def one(part):
        plain = normalise(part)
        if plain in known:
            return known[plain], ""
        for name, pattern in SENTENCES:
            m = re.fullmatch(pattern, plain)
            if m:
                got = m.groupdict()
                return name, "-".join(got[k].replace(" ", "-") for k in ("value", "version") if got.get(k))
        return None

    tokens = []
    for number, sentence in enumerate(plain_sentences(text)):
        tag = re.search(r"(?i)spdx-license-identifier:[ \t]*([a-z0-9(][a-z0-9 .+:()-]*)", sentence)
        if tag:
            tokens.append((number, "spdx", tag[1].strip(" -")))
        elif found := one(sentence):
            tokens.append((number, *found))
        else:
            for part in sentence.split(";"):
                if ";" in sentence and (found := one(part)):
                    tokens.append((number, *found))
                elif "\n" in part:
                    tokens += [(number, *m) for line in part.split("\n") if (m := one(line))]
    places, at = [], 0
    while at < len(tokens):
        fitting = None
        for name, rule in RULES:
            stop, value = at, ""
            for want in rule:
                if stop < len(tokens) and tokens[stop][1] == want.strip("?"):
                    value, stop = value or tokens[stop][2], stop + 1
                elif want[-1] != "?":
                    break
            else:
                if stop > at:
                    fitting = (name.replace("{}", value.upper()), stop)
                    break
        name, stop = fitting or ("UNMATCHED", at + 1)
        places.append(f"{canonical(name)[0]}:{tokens[at][0]}:{tokens[stop - 1][0]}")
        at = stop
    return ",".join(n for _, n, _ in tokens), ",".join(places)


def test_query_against_plain_python(spark: SparkSession, sf: str):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["op1_licence_rules"](spark, sf).collect()
    assert len(got) == len(texts) and any(r.licences for r in got)
    for r in got:
        assert (r.identifiers, r.places) == plain_licences(texts[r.doc_id]), r.doc_id


def test_scan_names_each_licence_of_an_expression(spark: SparkSession):
    rows = spark.createDataFrame([(1, "SPDX-License-Identifier: MIT OR Apache-2.0"), (2, None), (3, "x" * 100_000), (4, ZLIB)],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in licences.scan_licences(rows).collect()}
    assert (got[1].n_licences, got[1].licences) == (1, "Apache-2.0,MIT")
    assert got[2].licences == got[3].licences == ""
    assert got[4].licences == "Zlib"
