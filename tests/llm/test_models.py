"""What the learned operators must be able to do."""

import zlib

import numpy as np
import pytest

from tabloom.llm import licences, queries
from tabloom.llm.personal_data import disclosing_terms, sanitise
from tabloom.llm.secrets_grammar import Formats, Grammar, infer, shape
from tabloom.llm.toxicity import fit_machine, score_toxicity


def held_out_accuracy(spark, name, label, folder="/root/testdata/sf0.01"):
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in queries.QUERIES[name](spark, folder).collect() if r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    return sum(r.predicted == truth[r.doc_id] for r in held) / len(held)


def test_quality_on_held_out_rows(spark):
    assert held_out_accuracy(spark, "op8_quality", "quality") > 0.95


def test_toxicity_on_held_out_rows(spark):
    assert held_out_accuracy(spark, "op5_toxicity", "toxic") > 0.9


@pytest.mark.parametrize("rule", ["both", "either but not both"])
def test_machine_learns_pairs(rule):
    rng = np.random.default_rng(0)
    data = []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        terms = [10] * int(a) + [20] * int(b) + rng.choice(np.arange(100, 400), 12, replace=False).tolist()
        data.append((np.unique(terms), int(a and b) if rule == "both" else int(a != b)))
    machine = fit_machine(data[:2000])
    test = data[2000:]
    scores = machine.scores(np.concatenate([f for f, _ in test]), np.array([len(f) for f, _ in test]))
    assert ((scores > 0.5) == np.array([y for _, y in test])).mean() > 0.95


def test_pairs_of_rare_words_that_tell_nothing_alone(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(8000):
        words, luck = [f"w{chr(97 + n // 26)}{chr(97 + n % 26)}" for n in rng.integers(0, 600, 15)], rng.random()
        toxic = i % 2
        words += ["zorb", "quim"] if toxic and luck < 0.06 else ["zorb"] if luck < 0.06 else ["quim"] if luck < 0.12 and not toxic else []
        rows.append((i, " ".join(words), toxic))
    rows += [(9000 + i, " ".join(rows[k][1].split()[:10] + extra), -1)
             for i, (k, extra) in enumerate((k, e) for k in range(20) for e in (["zorb", "quim"], ["zorb"], ["quim"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r.score for r in score_toxicity(df, df.where("toxic >= 0")).collect()}
    both, first, second = ([got[9000 + 3 * k + j] for k in range(20)] for j in range(3))
    assert np.mean(both) > 0.6 and np.mean(first) < 0.4 and np.mean(second) < 0.4


def test_machine_without_both_labels():
    assert fit_machine([]).scores(np.zeros(0, dtype=np.int64), np.array([0])).tolist() == [0.0]
    assert fit_machine([(np.array([1]), 1)]).scores(np.array([1]), np.array([1])).tolist() == [1.0]


def test_automaton_generalises_a_format():
    rng = np.random.default_rng(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = [shape("AK" + "".join(rng.choice(list(letters + "0123456789"), 18)) + "-" + "".join(rng.choice(list("0123456789"), 6)))
             for _ in range(300)]
    automaton = infer(words)
    assert len(automaton.edges) < 60 < sum(len(set(w[:k] for w in words)) for k in range(27))
    formats = Formats({"x": automaton}, {}, {})
    seen, other = shape("AKZZ0123456789ABCDEF-123456"), shape("hello-there/this=is+prose")
    assert formats.score(seen, 1e-4) > 0.25 > formats.score(other, 1e-4)


def test_formats_found_in_texts(spark):
    from tabloom.llm.secrets_grammar import find_secrets

    rng = np.random.default_rng(4)
    key = lambda: "".join(rng.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZ23456789"), 24))
    labelled = [(i, f'api_key = "{key()}" and prose with version-2-of-this-long-name in it') for i in range(300)]
    bare = [(1000 + i, f"the value {key()} stands alone") for i in range(20)]
    docs = spark.createDataFrame(labelled + bare, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in find_secrets(docs, grammar=Grammar()).collect()}
    assert all(found[1000 + i] == "format:10:34" for i in range(20))
    assert all("format" not in found[i] for i in range(300))


def test_words_that_reveal(spark):
    rng = np.random.default_rng(6)
    common = [f"plain{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    prose = lambda n: " ".join(rng.choice(common, n))
    rows = [(i, f"{prose(30)}") for i in range(400)]
    rows += [(1000 + i, f"{prose(4)} Zebrafish {prose(3)} joe@mail.example.com {prose(6)}") for i in range(6)]
    rows += [(2000, f"{prose(5)} zebrafish {prose(5)}")]
    copied = f"{prose(4)} onlyhere {prose(3)} ann@mail.example.com {prose(4)}"
    rows += [(3000 + i, copied) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.term for r in disclosing_terms(docs).collect()} == {"zebrafish"}
    clean = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert "zebrafish" not in clean[2000].lower() and "<email>" in clean[1000] and "onlyhere" in clean[3000]
    assert clean[0] == rows[0][1]


@pytest.mark.parametrize("text,want", [
    ("Some prose.\nReleased under the MIT License.\nmore", "MIT"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
    ("# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n"
     "# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n"
     "# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an \"AS IS\" BASIS,\n"
     "# WITHOUT WARRANTIES.\n# See the License for the specific language governing permissions and\n# limitations under the License.", "Apache-2.0"),
    ("A licence to print money.", ""),
])
def test_licence_rules(text, want):
    found = [f.licence for f in licences.match_rules(licences.identify(text)) if f.licence != "UNMATCHED"]
    assert ",".join(found) == want


def test_licence_query_finds_every_planted_line(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    lines = {"This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
             "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0"}
    got = {r.doc_id: r.licences for r in queries.QUERIES["op1_licence_rules"](spark, sf).collect()}
    assert got == {i: ",".join(sorted({v for k, v in lines.items() if k in t.split("\n")})) for i, t in docs.items()}
