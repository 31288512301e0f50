"""Licence scans by sentence rules.

A text is cut into sentences, each is normalised, and those that are known
licence sentences become identifiers: first by the table of whole sentences
(``WHOLE``), then by patterns, for sentences that name a version or a holder
(``SENTENCES``). A licence rule is a sequence of
identifiers; the rules are tried in order at every place of the document's
sequence of identifiers, so that a longer or more particular rule comes
before a general one. What a rule matches is used up. A known sentence that
no rule uses is reported as ``UNMATCHED``.

The value of an SPDX tag is an expression: its operators, and the identifiers
that ``SPDX_IDS`` has, are reported in their canonical case, other identifiers
in upper case. Its licences are counted one by one, each with its exception.
An expression that is not well formed is reported as written, in upper case,
as one licence.

Defined results: a null or empty text, or one without a known sentence, has
no licences. Repeated rows give repeated results, an empty table an empty
one. Null ids are carried. Other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

from tabloom.llm.batches import map_texts

# What a short form may begin with: "This project is", "The software in this folder is", "It is".
_SUBJECT = r"(?:(?:(?:this|these|the|all|our)(?: [^ .]+){1,6}?|it) (?:is|are) )?"
_FREE = (r"(?:this program|this file|.* ) ?is free software:?;? you can redistribute it and/or modify it under the terms of the gnu %s"
         r"general public license as published by the free software foundation[,;] either version (?P<value>%s)(?: of the license)?,? or "
         r"(?:\(at your option\) )?any later version")

# Identifiers of licence sentences, and the normalised sentences they stand for.
SENTENCES: tuple[tuple[str, str], ...] = (
    ("copyright", r"(?:portions )?(?:copyright:? )?© ?.+|(?:portions )?copyright:? (?:by )?\d{4}.*|"
                  r"copyright:? .* (?:inc|corp|ltd|llc|gmbh|foundation|authors|contributors|developers)|all rights reserved"),
    ("spdx", r"(?:.* )?spdx license identifier:? ?(?P<value>[a-z0-9(][a-z0-9 .+:()]*)"),
    ("gpl-short", _SUBJECT + r"licensed under the(?: terms of the)? gnu general public license,? (?:v|version )(?P<value>[123])(?:\.0)?(?: or(?: \(?at your option\)?)? any later version)?"),
    ("lgpl-short", r".*licensed under the(?: terms of the)? gnu (?:lesser|library) general public license,? (?:v|version )(?P<value>2\.1|2|3)"),
    ("agpl-short", r".*licensed under the(?: terms of the)? gnu affero general public license,? (?:v|version )(?P<value>3)"),
    ("cc-short", _SUBJECT + r"licensed under (?:a |the )?(?:cc|creative commons) (?P<value>by(?: nc)?(?: nd| sa)?|zero|0) ?(?P<version>[1-4]\.0)?(?: international| unported)?(?: license)?"),
    ("mit-short", _SUBJECT + r"(?:released|licensed|distributed|available) under the(?: terms of the)? mit licen[sc]e"),
    ("apache-or-mit", r"(?:" + _SUBJECT + r"(?:dual )?(?:licensed|released|distributed|available) under (?:the terms of )?(?:either )?|either )(?:of )?(?:the )?"
                      r"(?:apache(?: license)?,? (?:version )?2\.0,? or (?:the )?mit(?: licen[sc]e)?|mit(?: licen[sc]e)? or (?:the )?apache(?: license)?,? (?:version )?2\.0)"
                      r"(?: licen[sc]es?)?,?(?: at your option)?"),
    ("apache-short", _SUBJECT + r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?apache(?: software)?(?: license)?,? (?:version |v)?(?P<value>2\.0)"
                                r"(?: licen[sc]e)?(?: \(?the license\)?)?"),
    ("epl-short", r"(?:.* )?(?:made available|released|licensed|distributed) under the(?: terms of the)? eclipse public license,?(?: v| version)? ?(?P<value>[12]\.0)"
                  r"(?:,? (?:which|and) .*)?"),
    ("boost-short", r"(?:.* )?(?:released|licensed|distributed) under the(?: terms of the)? boost software license,? version (?P<value>1\.0)(?:[ .(].*)?"),
    ("cc0-title", r"(?:creative commons )?cc0 1\.0 universal(?: .*)?"),
    ("cc0-waive", r"to the extent possible under law,? .* waived all copyrights? and related or neighbou?ring rights to .*"),
    ("cc0-short", _SUBJECT + r"(?:released|licensed|distributed|available|dedicated to the public domain) under (?:the )?(?:creative commons )?cc0(?: 1\.0)?(?: universal)?"
                             r"(?: licen[sc]e| public domain dedication)?"),
    ("bsd-short", _SUBJECT + r"(?:released|licensed|distributed) under the(?: terms of the)? (?P<value>[234]) clause bsd licen[sc]e"),
    ("mpl-short", r"this source code form is subject to the terms of the mozilla public license,? (?:v|version )\.? ?(?P<value>[12]\.[01])"),
    ("apache-use", r"you may not use this file except in compliance with the license"),
    ("apache-obtain", r"you may obtain a copy of the license at.*"),
    ("apache-asis", r"unless required by applicable law or agreed to in writing,? software distributed under the license is distributed on an as is basis.*"),
    ("apache-see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-free", _FREE % ("", "[23]")),
    ("lgpl21-free", _FREE % ("lesser ", r"2\.1")),
    ("lgpl-free", _FREE % ("(?:lesser|library) ", "[23]")),
    ("agpl-free", _FREE % ("affero ", "3")),
    ("gpl-only", r"(?:.* )?you can redistribute it and/or modify it under the terms of the gnu general public license"
                 r"(?:,? version (?P<version>[23])(?:\.0)?,? as published by the free software foundation|"
                 r" as published by the free software foundation[,;:]? (?:either )?version (?P<value>[23])(?: of the license)?)(?: only)?"),
    ("gpl-warranty", r"(?:this program|.* ) ?is distributed in the hope that it will be useful,? but without any warranty;? ?without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-see", r"see the gnu (?:lesser |library |affero )?general public license for more details"),
    ("gpl-received", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license along with this (?:program|library|file|software).*"),
    ("boost-grant", r"permission is hereby granted,? free of charge,? to any person or organization obtaining a copy of the software and accompanying documentation.*"),
    ("mit-grant", r"permission is hereby granted,? free of charge,? to any person obtaining a copy of this software.*"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-asis", r"the software is provided as is,? without warranty of any kind,? express or implied.*"),
    ("mit-liability", r"in no event shall the authors or copyright holders be liable for any claim.*"),
    ("bsd-grant", r"redistribution and use in source and binary forms,? with or without modification,? are permitted provided that the following conditions are met:?.*"),
    ("bsd-source", r".*redistributions of source code must retain the above copyright notice.*"),
    ("bsd-binary", r".*redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd-names", r".*neither the name of .* nor the names of its contributors may be used to endorse or promote.*"),
    ("bsd-asis", r"this software is provided by .* as is and any express or implied warranties.*"),
    ("isc-grant", r"permission to use,? copy,? modify,? and/or distribute this software for any purpose with or without fee is hereby granted.*"),
)

# Identifiers of licence sentences that have one wording.
WHOLE: tuple[tuple[str, str], ...] = (
    ("unlicense-free", "This is free and unencumbered software released into the public domain."),
    ("unlicense-anyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form "
                         "or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("unlicense-dedicate", "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all "
                           "copyright interest in the software to the public domain."),
    ("unlicense-benefit", "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors."),
    ("unlicense-intend", "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to "
                         "this software under copyright law."),
    ("zlib-asis", "This software is provided 'as-is', without any express or implied warranty."),
    ("zlib-liable", "In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
                   "and redistribute it freely, subject to the following restrictions:"),
    ("zlib-origin", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("zlib-thanks", "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required."),
    ("zlib-altered", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("zlib-notice", "This notice may not be removed or altered from any source distribution."),
    ("boost-notice", "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the "
                     "following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the "
                     "Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a "
                     "source language processor."),
)

# Ordered rules. ``?`` after an identifier makes it optional, ``{}`` takes the value of the sentence.
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("SPDX:{}", ("spdx",)),
    ("Apache-2.0", ("apache-short", "apache-use", "apache-obtain?", "apache-asis", "apache-see?")),
    ("GPL-{}.0-or-later", ("gpl-free", "gpl-warranty?", "gpl-see?", "gpl-received?")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "gpl-warranty?", "gpl-see?", "gpl-received?")),
    ("LGPL-{}.0-or-later", ("lgpl-free", "gpl-warranty?", "gpl-see?", "gpl-received?")),
    ("AGPL-{}.0-or-later", ("agpl-free", "gpl-warranty?", "gpl-see?", "gpl-received?")),
    ("GPL-{}.0-only", ("gpl-only", "gpl-warranty?", "gpl-see?", "gpl-received?")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone?", "unlicense-dedicate?", "unlicense-benefit?", "unlicense-intend?", "mit-asis?", "mit-liability?")),
    ("Zlib", ("zlib-asis?", "zlib-liable?", "zlib-grant", "zlib-origin?", "zlib-thanks?", "zlib-altered?", "zlib-notice?")),
    ("CC0-1.0", ("cc0-title", "cc0-waive?")),
    ("CC0-1.0", ("cc0-waive",)),
    ("CC0-1.0", ("cc0-short",)),
    ("BSL-1.0", ("boost-grant", "boost-notice?", "mit-asis?")),
    ("BSL-{}", ("boost-short",)),
    ("EPL-{}", ("epl-short",)),
    ("Apache-2.0 OR MIT", ("apache-or-mit",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-asis", "mit-liability?")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-asis?")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-asis?")),
    ("ISC", ("isc-grant", "copyright?", "mit-asis?")),
    ("Apache-{}", ("apache-short",)),
    ("AGPL-{}.0", ("agpl-short",)),
    ("LGPL-{}", ("lgpl-short",)),
    ("GPL-{}.0", ("gpl-short",)),
    ("CC-{}", ("cc-short",)),
    ("MIT", ("mit-short",)),
    ("BSD-{}-Clause", ("bsd-short",)),
    ("MPL-{}", ("mpl-short",)),
    ("COPYRIGHT", ("copyright",)),
)

# Identifiers in their canonical case.
SPDX_IDS = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-1-Clause",
    "BSD-2-Clause", "BSD-2-Clause-Patent", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0",
    "CDDL-1.1", "CECILL-2.1", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "GFDL-1.3-only", "GFDL-1.3-or-later", "GPL-1.0-only",
    "GPL-1.0-or-later", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0-only",
    "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0",
    "MPL-1.0", "MPL-1.1", "MPL-2.0", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "ODbL-1.0", "OFL-1.1", "OSL-3.0", "PostgreSQL", "PSF-2.0",
    "Python-2.0", "Ruby", "Unicode-DFS-2016", "Unlicense", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
    "Autoconf-exception-3.0", "Bison-exception-2.2", "Classpath-exception-2.0", "GCC-exception-3.1", "Linux-syscall-note", "LLVM-exception",
)

# Sentences end at a sign before a blank and a capital, at a sign that ends its line, or at an empty line.
_BREAK = re.compile(r"(?<=[.!?;:])\s+(?=[A-Z(\"'])|(?<=[.!?])[ \t]*\n\s*|\n\s*\n")
# A line with an SPDX tag is a sentence of its own, and its colon ends none.
_TAG = re.compile(r"(?im)^.*spdx-license-identifier:.*$")
_TAG_VALUE = re.compile(r"(?i)spdx-license-identifier:[ \t]*([a-z0-9(][a-z0-9 .+:()-]*)")
_COMMENT = re.compile(r"^[\s/*#;%<>!|-]+|[\s*/>|-]+$", re.M)
_QUOTES = re.compile(r"[\"'`“”‘’]|\(c\)(?! )")
_BLANKS = re.compile(r"[\s_-]+")
# A known sentence has one of these words; other sentences are not normalised.
_HINT = re.compile(r"(?i)licen[sc]e|copyright|warrant|permission|redistribut|rights reserved|merchantab|liable|©|\(c\)|neither the name"
                   r"|public domain|unencumbered|free to copy|this dedication|misrepresented|acknowledgment|notice may not|cc0 1|apache")


@dataclass(frozen=True)
class Found:
    licence: str
    first: int
    last: int


def _compiled(sentences):
    return [(name, re.compile(pattern)) for name, pattern in sentences]


_KNOWN = _compiled(SENTENCES)


def normalise(sentence: str) -> str:
    """Lower case, comment marks and quotes gone, blanks and hyphens single blanks, no full stop at the end."""
    plain = _COMMENT.sub(" ", sentence).lower().replace("(c)", "©")
    return _BLANKS.sub(" ", _QUOTES.sub("", plain)).strip(" .:;,!")


_WHOLE = {normalise(sentence): name for name, sentence in WHOLE}
_CANONICAL = {name.upper(): name for name in SPDX_IDS}
_OPERATORS = ("AND", "OR", "WITH")


def _expression(value: str) -> list[str] | None:
    """Tokens of an SPDX expression in canonical case; None if it is not well formed."""
    out, depth, operand = [], 0, True
    for token in re.findall(r"[()]|[^\s()]+", value):
        upper = token.upper()
        if operand != (token == "(" or token != ")" and upper not in _OPERATORS):
            return None
        depth += (token == "(") - (token == ")")
        # An exception is a single identifier.
        if depth < 0 or token == "(" and out[-1:] == ["WITH"]:
            return None
        operand = token == "(" or upper in _OPERATORS
        out.append(_CANONICAL.get(upper, upper))
    return None if operand or depth else out


def canonical(licence: str) -> tuple[str, list[str]]:
    """A licence as reported, and the names of the licences that it speaks of."""
    tag, _, value = licence.partition("SPDX:")
    tokens = _expression(value if not tag else licence)
    if tokens is None:
        return licence, [licence]
    joined = " ".join(tokens).replace("( ", "(").replace(" )", ")")
    names = [n.strip() for n in re.split(r"[()]| AND | OR ", " ".join(tokens))]
    return licence[:len(licence) - len(value)] + joined if value and not tag else joined, [n for n in names if n]


def identify(text: str) -> list[tuple[int, str, str]]:
    """``(number of the sentence, identifier, value)`` of every known sentence, in order.

    A sentence may go over several lines; one that is unknown as a whole may
    still have a part between semicolons or a line that is a licence sentence
    of its own.
    """
    if not _HINT.search(text):
        return []
    out = []
    for number, sentence in enumerate(s for s in _sentences(text) if s.strip()):
        if not _HINT.search(sentence):
            continue
        tag = _TAG_VALUE.search(sentence)
        if tag:
            out.append((number, "spdx", tag[1].strip(" -")))
            continue
        found = _match(normalise(sentence))
        if found:
            out.append((number, *found))
            continue
        for part in sentence.split(";"):
            if ";" in sentence and (found := _match(normalise(part))):
                out.append((number, *found))
            elif "\n" in part:
                out += [(number, *m) for line in part.split("\n")
                        if _HINT.search(line) and (m := _match(normalise(line)))]
    return out


def _sentences(text: str) -> Iterator[str]:
    at = 0
    for tag in _TAG.finditer(text):
        yield from _BREAK.split(text[at:tag.start()])
        yield tag[0]
        at = tag.end()
    yield from _BREAK.split(text[at:])


def _match(sentence: str) -> tuple[str, str] | None:
    if sentence in _WHOLE:
        return _WHOLE[sentence], ""
    for name, pattern in _KNOWN:
        m = pattern.fullmatch(sentence)
        if m:
            groups = {k: v for k, v in m.groupdict().items() if v}
            return name, "-".join(groups[k].replace(" ", "-") for k in ("value", "version") if k in groups)
    return None


def match_rules(tokens: list[tuple[int, str, str]]) -> list[Found]:
    """The first rule that fits at a place takes it; then the search goes on behind."""
    out, at = [], 0
    while at < len(tokens):
        for licence, rule in RULES:
            stop, value = _apply(rule, tokens, at)
            if stop > at:
                out.append(Found(licence.format(value.upper()) if "{}" in licence else licence, tokens[at][0], tokens[stop - 1][0]))
                at = stop
                break
        else:
            out.append(Found("UNMATCHED", tokens[at][0], tokens[at][0]))
            at += 1
    return out


def _apply(rule: tuple[str, ...], tokens: list[tuple[int, str, str]], at: int) -> tuple[int, str]:
    value = ""
    for wanted in rule:
        if at < len(tokens) and tokens[at][1] == wanted.rstrip("?"):
            value = value or tokens[at][2]
            at += 1
        elif not wanted.endswith("?"):
            return -1, ""
    return at, value


RESULT = T.StructType([
    T.StructField("n_sentences", T.LongType()), T.StructField("n_licences", T.LongType()),
    T.StructField("licences", T.StringType()), T.StructField("identifiers", T.StringType()),
    T.StructField("places", T.StringType())])


def _scan(batch: list[str]) -> list:
    columns: list[list] = [[] for _ in RESULT.fields]
    for text in batch:
        tokens = identify(text)
        found = match_rules(tokens)
        named_ = [f for f in found if f.licence not in ("UNMATCHED", "COPYRIGHT")]
        of = {f.licence: canonical(f.licence) for f in found}
        for out, value in zip(columns, (
                len(tokens), len(named_), ",".join(sorted({n for f in named_ for n in of[f.licence][1]})),
                ",".join(name for _, name, _ in tokens), ",".join(f"{of[f.licence][0]}:{f.first}:{f.last}" for f in found))):
            out.append(value)
    return columns


def scan_licences(df: DataFrame, carried: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``carried`` columns, the number of known sentences and of licences, their names, and ``licence:first:last`` sentences."""
    return map_texts(df, carried, text, RESULT, _scan)
