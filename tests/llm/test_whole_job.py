"""Cases in which an operator once did less than its whole job."""

import base64

import numpy as np
import pytest

from tabloom.llm import compression_bands as bands, licences
from tabloom.llm.mixing import assign, mix
from tabloom.llm.personal_data import disclosing_terms
from tabloom.llm.secrets_grammar import Grammar, find_secrets, infer, labelled_shapes, learned_shape, shape
from tabloom.llm.toxicity import Fit, score_toxicity


def test_copies_hide_no_revealing_word(spark):
    rng = np.random.default_rng(8)
    common = [f"plain{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    prose = lambda n: " ".join(rng.choice(common, n))
    rows = [(i, prose(30)) for i in range(400)]
    some = [f"{prose(4)} zebrafish {prose(3)} joe@mail.example.com {prose(6)}" for _ in range(3)]
    rows += [(1000 + i, some[i % 3]) for i in range(60)]
    one = " ".join(f"{prose(2)} quokka {prose(2)} eve@mail.example.com {prose(9)}" for _ in range(3))
    rows += [(2000, one)]
    # One passage inside different texts is one context.
    passage = f"{prose(10)} onlyhere ann@mail.example.com {prose(10)}"
    rows += [(3000 + i, f"{prose(12)} {passage} {prose(6)}") for i in range(6)]
    found = {r.term: r.disclosure for r in disclosing_terms(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found["zebrafish"] == pytest.approx(1) and found["quokka"] == pytest.approx(1)
    assert "onlyhere" not in found and max(found.values()) < 1 + 1e-9
    single = {i: r for i, r in dict(rows).items() if not 1000 <= i < 2000} | {1000 + i: t for i, t in enumerate(some)}
    once = spark.createDataFrame(list(single.items()), "doc_id long, text string")
    assert {r.term: r.disclosure for r in disclosing_terms(once).collect()} == pytest.approx(found)


def test_scores_do_not_change_where_the_sample_is_capped(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{'abcdefghij'[a]}{'abcdefghij'[b]}{'abcdefghij'[c]}" for a, b, c in rng.integers(0, 10, (8, 3)))) for i in range(1600)]
    docs = spark.createDataFrame([*rows, (5000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1600)], "doc_id long, toxic int")
    for sample in (40, 6000):
        got = {r.doc_id: r.score for r in score_toxicity(docs, labels, fit=Fit(sample=sample, rounds=50)).collect()}
        assert 0.05 < got[5000] < 0.16


APACHE = ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.\n'
          "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS.")
FREE = ("This {what} is free software{sign} you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License "
        "as published by the Free Software Foundation{mark} either version {v} of the License, or (at your option) any later version.\n\n"
        "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} General Public License for more details.")


@pytest.mark.parametrize("text,want", [
    ("SPDX-License-Identifier: MIT", "SPDX:MIT"),
    ("# Some prose.\n# SPDX-License-Identifier: Apache-2.0\nimport os", "SPDX:APACHE-2.0"),
    ("/* SPDX-License-Identifier: gpl-2.0-only */\nint a;", "SPDX:GPL-2.0-ONLY"),
    ("This project is licensed under the MIT License.", "MIT"),
    ("Licensed under the GNU General Public License v3", "GPL-3.0"),
    (FREE.format(what="library", sign=";", kind="Lesser", mark=";", v="2.1"), "LGPL-2.1-or-later"),
    (FREE.format(what="library", sign=":", kind="Lesser", mark=",", v="3"), "LGPL-3.0-or-later"),
    (FREE.format(what="program", sign=":", kind="Affero", mark=",", v="3"), "AGPL-3.0-or-later"),
    (APACHE, "Apache-2.0"),
    (APACHE.replace("(the ", "(the\n# "), "Apache-2.0"),
])
def test_licence_wordings(text, want):
    assert ",".join(f.licence for f in licences.match_rules(licences.identify(text))) == want


def test_empty_source_keeps_the_weights_of_the_others(spark):
    rows = [(i, t, s) for i, (s, t) in enumerate([("a", None), ("a", ""), ("a", " ")] + [(s, "w " * 10) for s in "b" * 30 + "c" * 30 + "d" * 5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = lambda rows: {s: sum(n for t, n in rows if t == s) for s in "abcd"}
    source = {i: s for i, _, s in rows}
    mixed = words([(r.source, len(r.text.split())) for r in mix(docs).collect()])
    assert mixed == words([(source[r.doc_id], r.taken) for r in assign(docs).collect()]) and mixed["a"] == 0


def test_bands_see_stretches_and_remains():
    rng = np.random.default_rng(1)
    words = [f"w{k:x}{k * 7919 % 9973:x}" for k in range(3000)]
    prose = lambda size: " ".join(rng.choice(words, size // 5))[:size]
    noise = lambda size: " ".join(base64.b64encode(rng.bytes(60)).decode() for _ in range(size // 80 + 1))[:size]
    kept = lambda text: bands.judge([text], bands.Bands())[6][0]
    clean = [prose(n) for n in (4096, 4097, 6000, 12289, 16384, 400_000)]
    assert [kept(t) for t in clean] == [True] * len(clean)
    mixed = [prose(8192) + noise(8192), prose(3 * 4096) + noise(4000), prose(4096) + noise(3900), prose(300_000) + noise(100_000)]
    assert [kept(t) for t in mixed] == [False] * len(mixed)


def test_short_lettered_and_dotted_credentials_are_candidates(spark):
    rng = np.random.default_rng(4)
    draw = lambda signs, n: "".join(rng.choice(list(signs), n))
    upper = "ABCDEFGHJKLMNPQRSTUVWXYZ"
    kinds = [lambda: draw(upper + "23456789", 10), lambda: draw(upper, 20), lambda: ".".join(draw(upper + "23456789", 9) for _ in range(3))]
    prose = "some prose with version-2-of-this-long-name in it, for example www.page.example/of-words. Nothing, really..."
    rows = [(i, f'token = "{kinds[i % 3]()}" and {prose}') for i in range(600)]
    rows += [(1000 + i, f"the value {kinds[i % 3]()}" + [" stands alone", "."][i % 2]) for i in range(60)]
    found = {r.doc_id: r.spans for r in find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    ends = {i: 10 + (10, 20, 29)[i % 3] for i in range(60)}
    assert [found[1000 + i] for i in range(60)] == [f"format:10:{ends[i]}" for i in range(60)]
    assert not any("format" in found[i] for i in range(600))


def test_long_credentials_are_learned_whole():
    rng = np.random.default_rng(5)
    words = [shape("-".join("".join(rng.choice(list("0123456789"), 40)) for _ in range(2)) + "/END") for _ in range(200)]
    automaton = infer(words, Grammar())
    cut = words[0][:64]
    assert automaton.likelihood(words[0], 1e-4) / (len(words[0]) + 1) > automaton.likelihood(cut, 1e-4) / (len(cut) + 1)


def test_shapes_seen_by_the_driver_are_bounded(spark):
    rng = np.random.default_rng(8)
    long = ["".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZ23456789"), 100_000)) for _ in range(6)]
    rows = [(i, f"token = {t} end") for i, t in enumerate(long)] + [(10, f"the value {long[0][:5000]}.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = labelled_shapes(df, "text", Grammar()).where("kind = 'assign'").collect()
    assert seen and all(len(r.word) == Grammar().head + 1 and r.word.endswith(">") for r in seen)
    found = {r.doc_id: r.spans for r in find_secrets(df).collect()}
    assert all(found[i] == f"assign:0:{8 + len(t)}" for i, t in enumerate(long))


def test_heads_go_on_and_do_not_end():
    words = [shape("A1" * 40), shape("7" * 30)] * 50
    cut = [learned_shape("A1" * 40, 20)] * 50
    assert cut[0] == shape("A1" * 10) + ">"
    whole, heads = infer(words, Grammar()), infer(cut, Grammar())
    assert sum(whole.ends) == len(words) and sum(heads.ends) == 0
