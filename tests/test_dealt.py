"""Work that a table of one file would leave to one task, and what one task holds."""

import os
import threading
import tracemalloc

import numpy as np
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector

from tabloom.operators import knn, svm
from tabloom.plans import PrepConfig, prepare, train, train_suite


def test_features_of_the_kernel_model_are_kept_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(v.tolist(), float(v[0] > 0)) for v in rng.normal(0, 1, (240, 2))]
    df = spark.createDataFrame(rows, "v array<double>, label double").coalesce(1).select(array_to_vector("v").alias("features"), "label")
    seen = []

    def fit(self, data, fit=LinearSVC.fit):
        seen.append((data.rdd.getNumPartitions(), data.is_cached))
        return fit(self, data)

    monkeypatch.setattr(svm.LinearSVC, "fit", fit)
    monkeypatch.setattr(svm, "TASK_ROWS", 50, raising=False)
    model = svm.KernelSvm(n_features=16).fit(df, 2, 240, 2)
    # Parts of a bounded number of rows, kept by the solver alone.
    assert seen == [(5, False)]
    assert model.transform(df).where("prediction = label").count() > 200


def test_the_prepared_table_is_written_in_parts(spark, monkeypatch):
    rows = [(i, i * 0.5 + i % 7, i * 3.0 + 0.25) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a double, y double").coalesce(1)
    parts = {}

    def durable(df, label, durable=train.durable):
        parts[label] = df.rdd.getNumPartitions()
        return durable(df, label)

    monkeypatch.setattr(train, "durable", durable)
    monkeypatch.setattr(train, "TASK_ROWS", 100, raising=False)
    trained = train_suite(prepare(df, PrepConfig(target="y", key=("id",))), ["linear_regression"])
    assert parts["prepared"] == 4
    assert trained.metrics.first()["r2"] > 0.9


def test_models_are_trained_side_by_side(spark, monkeypatch):
    rows = [(i, i * 0.5 + i % 7, i * 3.0 + 0.25) for i in range(200)]
    prep = prepare(spark.createDataFrame(rows, "id long, a double, y double"), PrepConfig(target="y", key=("id",)))
    names = ["linear_regression", "decision_tree_regressor"]
    alone = [train_suite(prep, [n]).metrics.drop("model_order").first() for n in names]
    meeting = threading.Barrier(2, timeout=60)

    def fit_model(*some, fit_model=train.fit_model):
        meeting.wait()
        return fit_model(*some)

    monkeypatch.setattr(train, "fit_model", fit_model)
    trained = train_suite(prep, names)
    assert list(trained.fitted) == names
    assert trained.metrics.orderBy("model_order").drop("model_order").collect() == alone


def test_pairs_ruled_out_later_are_not_held():
    """The first rows' errors rule nothing out, the last ones' do."""
    rng = np.random.default_rng(2)
    q, t = rng.integers(0, 255, (256, 20)).astype(np.float32), rng.integers(0, 255, (8 * knn.TRAIN_TILE, 20)).astype(np.float32)
    q_off, t_off = np.zeros(256), np.full(len(t), 1e3)
    t_off[-knn.TRAIN_TILE:] = 1e-3
    # Those with great errors lie far away, which only the rows behind them show.
    t[:-knn.TRAIN_TILE] += 2000
    tracemalloc.start()
    r, c, least, most = knn._candidates(q, q_off, np.full(256, np.inf), t, t_off, 1.0, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    far = np.sqrt(((q[:, None, :].astype(float) - t[None, -knn.TRAIN_TILE:]) ** 2).sum(axis=2))
    assert (c >= len(t) - knn.TRAIN_TILE).all()
    for i in range(0, 256, 50):
        assert set(np.argsort(far[i], kind="stable")[:3] + len(t) - knn.TRAIN_TILE) <= set(c[r == i])
    assert peak < 180 << 20


def test_an_encoder_keeps_little_and_has_one_thread():
    import public_tokenizers

    from tabloom.llm import token_files

    tool = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert tool.words.room + tool.parts.room <= 32 << 20
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"


def test_words_that_fit_the_encoder_are_learned_once():
    import public_tokenizers
    import pyarrow as pa

    from tabloom.llm import token_files

    class Counting:
        def __init__(self, tool):
            self.tool, self.words = tool, 0

        def encode_batch_fast(self, texts, **options):
            self.words += sum(len(t.split()) for t in texts)
            return self.tool.encode_batch_fast(texts, **options)

    tool = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    letters = "aeiouklmnrst"
    words = ["".join(letters[i // 12 ** k % 12] for k in range(5)) for i in range(110_000)]
    # The same letters in another case or before other signs are no other word.
    texts = [" ".join(words), " ".join(w.upper() for w in words), " ".join(f"{w.title()}," for w in words)]
    plain = tool.tokenizer
    tool.tokenizer = Counting(plain)
    found = [tool.encode(pa.array([t]), 1) for t in (*texts, texts[0])]
    assert tool.tokenizer.words == len(words) + 1
    for t, (ids, counts) in zip(texts, found):
        assert ids.tolist() == plain.encode(t, add_special_tokens=False).ids + [1] and counts.tolist() == [len(ids)]
    assert found[3][0].tolist() == found[0][0].tolist()


def test_an_encoder_takes_slices_of_one_kind_of_words():
    import public_tokenizers
    import pyarrow as pa

    from tabloom.llm import token_files

    tool = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for texts in ([None, "", " \n"], ["12 3a <|endoftext|>", None], ["Word word", "WORD"], ["word, word!!", ""], ["'", "!!"]):
        for kind in (pa.string(), pa.large_string()):
            ids, counts = tool.encode(pa.array(texts, kind), 1)
            want = [tool.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
            assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
