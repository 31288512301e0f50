"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms (runs of letters, A-Z in lower case) and of
their beginnings, hashed into a fixed number of features. The score is the logistic of a constant,
the weights of the terms and, for every pair of terms, the product of two
short vectors. The pairs are what a linear model misses: a word that is an
insult next to the name of a group and harmless elsewhere. All pairs
together cost one pass over the terms, as the sum over pairs of ``<v_i, v_j>``
is half of ``(sum v_i)^2 - sum v_i^2``, factor by factor.

The machine is fitted to a bounded sample of labelled texts (``Fit.sample``
of each class, those with the smallest digests), which is all that the driver
ever holds. Which terms are worth learning is decided on that sample, alone
and two by two. A row of the sample weighs as many labelled ids of its class as it
stands for, so scores mean the same whether or not the bound is reached. Every text is scored in its own partition, whole, without a
shuffle.

Defined results: a null or empty text has no terms and gets the score of the
constant; without labels of both classes every score is the share of the
labels that are 1 (0 if there are none). A null id is not held out. Repeated
rows give repeated results, an empty table an empty one. Other columns play
no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.llm.batches import named, numbered_words, slices
from tabloom.llm.labelled import held_out, training_labels
from tabloom.session import durable

# A-Z become a-z; what is neither an ASCII letter nor part of a character beyond ASCII becomes a blank.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

# Lengths of the beginnings of a term that are terms themselves.
BEGINNINGS = (5, 6, 7)


@dataclass(frozen=True)
class Fit:
    """``sample`` is the most labelled texts of each class that are learned from.

    A term is learned if at least ``least_texts`` of them have it and its share
    differs between the classes by ``least_errors`` standard errors, or if a
    share of ``frequent`` of all has it. Terms that a share of ``paired`` has
    are also tried two by two, whatever each tells alone: both are learned if,
    among at least ``least_together`` texts with both, label 1 is more or less
    often than among all texts with the first, and among all with the second,
    by ``pair_errors`` standard errors.
    """

    sample: int = 6000
    features: int = 1 << 18
    factors: int = 4
    rounds: int = 200
    rate: float = 0.05
    penalty: float = 5e-4
    pair_penalty: float = 3e-3
    least_texts: int = 5
    least_errors: float = 6.0
    frequent: float = 0.1
    paired: float = 0.02
    least_together: int = 20
    pair_errors: float = 10.0
    seed: int = 7


@dataclass(frozen=True)
class Machine:
    constant: float
    weights: np.ndarray
    vectors: np.ndarray

    def scores(self, features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """``features``: those of all texts in turn, distinct within a text."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        return _logistic(_margins(self.constant, self.weights, self.vectors, features, doc, len(sizes))[0])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _margins(constant, weights, vectors, at, doc, n):
    """Margins, and per factor the sums over each text."""
    out = constant + np.bincount(doc, weights=weights[at], minlength=n)
    sums = []
    for v in vectors:
        values = v[at]
        total = np.bincount(doc, weights=values, minlength=n)
        out += 0.5 * (total * total - np.bincount(doc, weights=values * values, minlength=n))
        sums.append(total)
    return out, sums


def _hashed(word: str, features: int) -> list[int]:
    """The term, and its beginnings: inflected and compound forms of a term share them."""
    digest = xxhash.xxh32_intdigest
    return [digest(word) % features] + [digest(f"^{word[:n]}") % features if len(word) >= n else -1 for n in BEGINNINGS]


def term_features(column: pa.Array, features: int, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text in turn, and how many each text has; only ``active`` ones if given."""
    plain = pa.array([(t or "").encode().translate(_LETTERS) for t in column.to_pylist()], pa.binary()).cast(pa.string())
    words, codes, sizes = numbered_words(plain)
    table = np.array([_hashed(w, features) for w in words.to_numpy(zero_copy_only=False)], dtype=np.int64).reshape(
        len(words), 1 + len(BEGINNINGS))
    if active is not None:
        table[~active[table] | (table < 0)] = -1
    found = table[codes].ravel()
    doc = np.repeat(np.arange(len(sizes)), sizes * table.shape[1])
    pairs = np.unique((doc * features + found)[found >= 0])
    return pairs % features, np.bincount(pairs // features, minlength=len(sizes)).astype(np.int64)


def fit_machine(rows: list[tuple[np.ndarray, int]], fit: Fit = Fit(), rates: tuple[float, float] = (1.0, 1.0)) -> Machine:
    """Logistic loss over all rows at once, by steps scaled per parameter (Adam).

    ``rows`` has the distinct terms and the label of each text; ``rates`` says
    how many labelled ids a row of label 0 and one of label 1 stand for.
    """
    y = np.array([label for _, label in rows], dtype=float)
    of_row = np.where(y == 1, rates[1], rates[0])
    share = float((of_row * y).sum() / of_row.sum()) if len(y) else 0.0
    nothing = Machine(0.0, np.zeros(fit.features), np.zeros((fit.factors, fit.features)))
    if share in (0.0, 1.0):
        return Machine(-1e9 if share == 0 else 1e9, nothing.weights, nothing.vectors)
    sizes = np.array([len(f) for f, _ in rows])
    flat = np.concatenate([f for f, _ in rows]).astype(np.int64)
    kept = np.unique(flat)
    place = np.full(fit.features, -1)
    place[kept] = np.arange(len(kept))
    doc, at = np.repeat(np.arange(len(y)), sizes), place[flat]
    k, n, of_row = len(kept), len(y), of_row / of_row.sum()
    rng = np.random.default_rng(fit.seed)
    weights, vectors = np.zeros(k), rng.normal(0, 0.03, (fit.factors, k))
    constant = float(np.log(share / (1 - share)))
    params = [weights, *vectors]
    first, second = [np.zeros(k) for _ in params], [np.zeros(k) for _ in params]
    c1 = c2 = 0.0
    for step in range(1, fit.rounds + 1):
        margins, sums = _margins(constant, params[0], params[1:], at, doc, n)
        error = (_logistic(margins) - y) * of_row
        of_term = error[doc]
        gradients = [np.bincount(at, weights=of_term, minlength=k) + fit.penalty * params[0]]
        for v, total in zip(params[1:], sums):
            gradients.append(np.bincount(at, weights=of_term * (total[doc] - v[at]), minlength=k) + fit.pair_penalty * v)
        rate = fit.rate * (1 - 0.9 * step / fit.rounds)
        c = float(error.sum())
        c1, c2 = 0.9 * c1 + 0.1 * c, 0.999 * c2 + 0.001 * c * c
        constant -= rate * (c1 / (1 - 0.9 ** step)) / (np.sqrt(c2 / (1 - 0.999 ** step)) + 1e-8)
        for j, g in enumerate(gradients):
            first[j] = 0.9 * first[j] + 0.1 * g
            second[j] = 0.999 * second[j] + 0.001 * g * g
            params[j] = params[j] - rate * (first[j] / (1 - 0.9 ** step)) / (np.sqrt(second[j] / (1 - 0.999 ** step)) + 1e-8)
    all_weights, all_vectors = nothing.weights, nothing.vectors
    all_weights[kept] = params[0]
    for j in range(fit.factors):
        all_vectors[j, kept] = params[1 + j]
    return Machine(constant, all_weights, all_vectors)


def _kept_terms(kept: Broadcast):
    """Rows with only the terms worth learning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = kept.value
        for batch in batches:
            terms = batch.column(3)
            flat, sizes = terms.flatten().to_numpy(zero_copy_only=False), terms.value_lengths().to_numpy(zero_copy_only=False)
            hit = wanted[flat]
            doc = np.repeat(np.arange(len(sizes)), sizes)[hit]
            ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(sizes)))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat[hit]))],
                names=batch.schema.names)

    return run


# Terms that one task pairs with all others, and texts that it looks at together.
_STRIP, _ROWS = 256, 256


def telling_pairs(first: int, flat: np.ndarray, ends: np.ndarray, labels: np.ndarray, terms: int, fit: Fit) -> np.ndarray:
    """Which of ``terms`` numbered terms tell something together with one of the strip that starts at ``first``.

    ``flat`` has the numbers of each text's terms in turn, up to ``ends``. The
    texts with both terms are counted by products of 0-1 matrices, so that no
    pair is ever listed.
    """
    strip = np.arange(first, min(first + _STRIP, terms))
    ones, both = (np.zeros((len(strip), terms), dtype=np.float32) for _ in range(2))
    for at in range(0, len(labels), _ROWS):
        stop = min(at + _ROWS, len(labels))
        there = np.zeros((stop - at, terms), dtype=np.float32)
        low, high = ends[at], ends[stop]
        there[np.repeat(np.arange(stop - at), np.diff(ends[at:stop + 1])), flat[low:high]] = 1
        own = there[:, strip]
        both += own.T @ there
        ones += own[labels[at:stop] == 1].T @ there[labels[at:stop] == 1]
    # Half a text of either label keeps rates of 0 and 1 from being certain.
    alone = np.bincount(flat, minlength=terms)
    rates = (np.bincount(flat[np.repeat(labels == 1, np.diff(ends))], minlength=terms) + 0.5) / (alone + 1)
    told = (both >= fit.least_together) & (both < alone[strip][:, None]) & (both < alone)
    share, many = ones / np.maximum(both, 1), 1 / np.maximum(both, 1)
    for rate, n in ((rates[strip][:, None], alone[strip][:, None]), (rates, alone)):
        error = np.sqrt(rate * (1 - rate) * np.maximum(many - 1 / np.maximum(n, 1), 1e-12))
        told &= np.abs(share - rate) >= fit.pair_errors * error
    out = told.any(axis=0)
    out[strip] |= told.any(axis=1)
    return out


def _paired(rows: DataFrame, often: np.ndarray, fit: Fit) -> np.ndarray:
    """The terms among ``often`` that tell something two by two; each task tries one strip of them."""
    spark = rows.sparkSession
    wanted = np.zeros(fit.features, dtype=bool)
    wanted[often] = True
    # At most 2 * fit.sample texts, as a machine is fitted to no more.
    found = rows.mapInArrow(_kept_terms(spark.sparkContext.broadcast(wanted)), _SAMPLE).toPandas()
    place = np.full(fit.features, -1, dtype=np.int32)
    place[often] = np.arange(len(often))
    texts = [place[np.asarray(t, dtype=np.int64)] for t in found["terms"]]
    ends = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    shared = spark.sparkContext.broadcast((np.concatenate(texts), ends, found["label"].to_numpy(dtype=np.int64)))
    terms = len(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in batch.column(0).to_pylist():
                told = np.nonzero(telling_pairs(first, *shared.value, terms, fit))[0]
                yield pa.RecordBatch.from_arrays([pa.array(told, pa.int64())], names=["at"])

    strips = -(-terms // _STRIP)
    told = spark.range(0, terms, _STRIP, strips).mapInArrow(run, "at long").distinct().toPandas()
    return often[told["at"].to_numpy(dtype=np.int64)]


_SAMPLE = "label int, order string, tie long, terms array<int>"


def training_sample(df: DataFrame, labels: DataFrame, label: str, id_column: str, text: str,
                    fit: Fit) -> tuple[list[tuple[np.ndarray, int]], tuple[float, float]]:
    """At most ``2 * fit.sample`` rows of terms worth learning, drawn by the digest of the id, then of the text.

    With them, how many labelled ids one that was drawn stands for, by label.
    """
    known = training_labels(labels, label, id_column)
    there = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    rates = tuple(max(1.0, there.get(value, 0) / fit.sample) for value in (0, 1))
    digest = F.md5(F.col("id").cast("string"))
    ids = None
    for value in (0, 1):
        some = known.where(F.col("label") == value).orderBy(digest, "id").limit(fit.sample)
        ids = some if ids is None else ids.unionByName(some)
    texts = df.select(named(id_column).alias("id"), named(text).cast("string").alias("t"))
    # At most 2 * fit.sample ids of a fixed size.
    chosen = texts.join(F.broadcast(ids), "id").select(
        "label", digest.alias("order"), F.xxhash64("t").alias("tie"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 3):
            found, sizes = term_features(part.column(3), fit.features)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], terms], names=["label", "order", "tie", "terms"])

    rows = durable(chosen.mapInArrow(run, _SAMPLE), "sampled-terms")
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    kept = np.zeros(fit.features, dtype=bool)
    if n and 0 < ones < n:
        seen, with_one = F.count("*"), F.sum("label")
        counted = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(
            seen.alias("seen"), with_one.alias("with_one")).where(F.col("seen") >= fit.least_texts)
        share = F.col("seen") / n
        error = F.sqrt(share * (1 - share) * (1 / ones + 1 / (n - ones))) + 1e-12
        apart = F.abs(F.col("with_one") / ones - (F.col("seen") - F.col("with_one")) / (n - ones)) / error
        # At most one row per feature.
        alone = (apart >= fit.least_errors) | (share >= fit.frequent)
        worth = counted.where(alone | (share >= fit.paired)).select(
            "term", alone.alias("alone"), (share >= fit.paired).alias("often")).orderBy("term").toPandas()
        names = worth["term"].to_numpy(dtype=np.int64)
        kept[names[worth["alone"].to_numpy(dtype=bool)]] = True
        often = names[worth["often"].to_numpy(dtype=bool)]
        if len(often):
            kept[_paired(rows, often, fit)] = True
    shared = df.sparkSession.sparkContext.broadcast(kept)
    narrow = rows.mapInArrow(_kept_terms(shared), _SAMPLE)
    found = narrow.orderBy("order", "tie").limit(2 * fit.sample).toPandas()
    return [(np.asarray(t, dtype=np.int64), int(y)) for t, y in zip(found["terms"], found["label"])], rates


def _scorer(shared: Broadcast, features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        active = (machine.weights != 0) | (machine.vectors != 0).any(axis=0)
        for part in slices(batches, 2):
            found, sizes = term_features(part.column(2), features, active)
            scores = machine.scores(found, sizes)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(scores)], names=["id", "held_out", "score"])

    return run


def score_toxicity(df: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text",
                   label: str = "toxic", threshold: float = 0.3, fit: Fit = Fit()) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row."""
    rows, rates = training_sample(df, labels, label, id_column, text, fit)
    machine = fit_machine(rows, fit, rates)
    shared = df.sparkSession.sparkContext.broadcast(machine)
    inner = df.select(named(id_column).alias("id"), held_out(named(id_column)).alias("held_out"),
                      named(text).cast("string").alias("t"))
    schema = T.StructType([inner.schema["id"], inner.schema["held_out"], T.StructField("score", T.DoubleType())])
    scored = inner.mapInArrow(_scorer(shared, fit.features), schema)
    return scored.select(F.col("id").alias(id_column), "held_out", "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
