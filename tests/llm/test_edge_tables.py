"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabloom.llm.compression_bands import compression_bands
from tabloom.llm.decontaminate import decontaminate
from tabloom.llm.licences import scan_licences
from tabloom.llm.mixing import assign, mix
from tabloom.llm.personal_data import find_personal_data, sanitise
from tabloom.llm.quality_qda import score_quality
from tabloom.llm.queries import TOKENIZER
from tabloom.llm.secrets_grammar import find_secrets
from tabloom.llm.simhash_dedup import keep_one_of_each, near_duplicates
from tabloom.llm.token_files import encode_and_read_back
from tabloom.llm.toxicity import score_toxicity

LONG = " ".join(f"word{i % 977} some" for i in range(60_000))
ROWS = [
    (1, "a b c d e", "en", "s", 9), (2, None, "en", "s", 0), (3, "", None, None, 0), (4, " \t\n", "en", None, 3),
    (5, LONG, "en", "s", len(LONG)), (6, "a b c d e", "en", "s", 9), (6, "a b c d e", "en", "s", 9), (6, "other text", "de", "s", 10),
    (None, "no id here", "en", "s", None), (None, "no id here", "en", "s", None), (None, None, None, None, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that results use too.
CLASHING = ["kept", "size", "taken", "n_words", "spans", "fp", "id", "score", "target", "order", "row", "t", "items", "c0", "r0", "key", "label"]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (5, 1, 0), (6, 1, None), (None, 1, 1), (6, 1, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (None, "other text"), (1, "a b c")], "item_id long, text string")


def operators(labels, benchmark):
    return {
        "licences": scan_licences, "bands": compression_bands, "personal": lambda d: find_personal_data(d).drop("terms"),
        "sanitise": sanitise, "mix": assign, "toxicity": lambda d: score_toxicity(d, labels),
        "decontaminate": lambda d: decontaminate(d, benchmark), "simhash": near_duplicates,
        "quality": lambda d: score_quality(d, labels), "tokens": lambda d: encode_and_read_back(d, TOKENIZER),
        "secrets": find_secrets,
    }


NAMES = sorted(operators(None, None))


@pytest.fixture(scope="module")
def plain(spark, labels, benchmark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    return {name: sorted(map(str, f(docs).collect())) for name, f in operators(labels, benchmark).items()}


@pytest.mark.parametrize("name", NAMES)
def test_every_row_has_a_result(plain, name):
    assert len(plain[name]) == len(ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_extra_columns_play_no_part(spark, labels, benchmark, plain, name):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({n: F.lit(7) for n in CLASHING})
    docs = docs.repartition(3)
    got = sorted(map(str, operators(labels, benchmark)[name](docs).collect()))
    if name == "tokens":
        assert len(got) == len(plain[name])
    else:
        assert got == plain[name]


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, labels, benchmark, name):
    docs = spark.createDataFrame([], SCHEMA)
    nothing = labels.limit(0), benchmark.limit(0)
    assert operators(labels, benchmark)[name](docs).collect() == []
    assert operators(*nothing)[name](docs).collect() == []


def test_no_labels_and_no_benchmark(spark, labels, benchmark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert {r.score for r in score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in score_quality(docs, labels.limit(0)).collect()} == {0.0}
    assert not any(r.contaminated or r.n_hit for r in decontaminate(docs, benchmark.limit(0)).collect())


def test_defined_results(spark, labels, benchmark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    found = {r.doc_id: r for r in decontaminate(docs, benchmark).collect() if r.doc_id}
    assert (found[1].n_words, found[1].n_hit, found[1].n_items, found[1].contaminated) == (5, 3, 1, True)
    assert (found[2].n_words, found[2].contaminated) == (0, False)
    near = [(r.doc_id, r.component_id, r.fingerprint) for r in near_duplicates(docs).collect()]
    assert {c for i, c, _ in near if i in (2, 3, 4)} == {2} and (None, 2, "0" * 16) in near
    assert {c for i, c, f in near if i == 1} == {1}
    assert not any(r.kept for r in compression_bands(docs).collect() if r.doc_id in (2, 3, 4))
    assert {r.n_tokens for r in encode_and_read_back(docs, TOKENIZER).collect() if r.doc_id in (2, 3, 4)} == {1}


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_on_the_edge_table(spark, sf, name):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({n: F.lit(7) for n in CLASHING})
    out = STAGES[name](spark, docs, sf)
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.schema.names == docs.schema.names
    assert out.count() <= 2 * len(ROWS)
    assert STAGES[name](spark, docs.limit(0), sf).count() == 0


def test_one_row_of_each_component_stays(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted(((r.doc_id is None, r.doc_id or 0, (r.text or "")[:10]) for r in keep_one_of_each(docs).collect()))
    assert got == [(False, 1, "a b c d e"), (False, 2, ""), (False, 5, LONG[:10]), (False, 6, "other text"), (True, 0, "no id here")]


def test_mix_cuts_the_last_text_and_repeats_epochs(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * 10), "en", s, 19) for i, s in enumerate("aaaabb" + "c" * 30)], SCHEMA)
    taken = {r.doc_id: r for r in assign(docs).collect()}
    out = mix(docs).collect()
    words = {}
    for r in out:
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    for source in "abc":
        rows = [r for r in taken.values() if docs.collect()[r.doc_id].source == source]
        assert sum(r.taken for r in rows) == round(rows[0].target) == words[source]
    assert max(r.taken for r in taken.values()) <= 20
