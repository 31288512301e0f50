"""Personal data: fixed kinds, and terms that reveal them by what the corpus says about the two.

The fixed kinds (email, ip, card, phone) name protected entities: an entity is
one value of a kind. The words around its mentions are its context. A word
discloses an entity as far as seeing the word makes the entity less
surprising: ``PMI(word, entity) / IC(entity)``, where the information content
of the entity is ``-log`` of the share of texts that its contexts make up and
the probability of a word is the share of texts that have it. A word at 1
occurs with the entity only. Words above the lower threshold are generalised
and those above the upper one removed, wherever in the corpus they stand.

All numbers are of different texts: a text counts once however often it is
copied, for the word, the entity, both and the corpus. A word needs several
different contexts of an entity, so that copies of one passage inside other
texts reveal nothing.

Steps: (1) entities and their contexts, from every text; (2) counts per
(word, entity), a join-free aggregate; (3) the number of different texts with
each candidate word, where a bitmap of fixed size tells tasks which words to
count and another which texts may have copies; only those leave their task
one by one; (4) the disclosing words as a table; (5) spans in every text,
found by the bitmap of those words and settled by a join with their table.

Defined results: a null or empty text has no spans. Repeated rows give
repeated results, an empty table an empty one. Null ids are carried. Other
columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.llm.batches import map_texts, named, numbered_words, slices, texts
from tabloom.session import durable

# Kinds in the order of the result.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is only tried from its first digit: from any other it ends at the same place.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Words are runs of ASCII letters and of characters beyond ASCII.
_WORD = re.compile(r"[A-Za-z\x80-\U0010FFFF]+")
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_LOWER = {i: i + 32 for i in range(0x41, 0x5B)}

BITMAP_BITS = 1 << 23
SEED = 42


@dataclass(frozen=True)
class Disclosure:
    """``window``: words on either side of a mention; ``contexts``: different contexts a word must share with an entity."""

    window: int = 10
    contexts: int = 3
    shortest: int = 3
    generalise: float = 0.8
    remove: float = 0.95


def _emails(text: str) -> list[tuple[int, int]]:
    """A match starts at the first character of the run before its ``@``, or behind the match before."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            free = m.end()
            out.append((start, free))
        at = text.find("@", free if m else at + 1)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() <= 64 else ""
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found.append(m.span())
    return found


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, in code points, end exclusive."""
    emails = _emails(text) if "@" in text else []
    ips = [m.span() for m in _IP.finditer(text)
           if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split(".")))]
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return [emails, ips, _cards(text), phones]


def _value(kind: str, text: str) -> str:
    return f"{kind}:{text.lower() if kind in ('email', 'ip') else _digits(text)}"


def contexts(text: str, rules: Disclosure) -> list[tuple[str, list[str]]]:
    """``(entity, words around a mention)`` of every mention; words inside a mention are left out."""
    spans = [(a, b, kind) for kind, found in zip(KINDS, base_spans(text)) for a, b in found]
    if not spans:
        return []
    words = [(m.start(), m.end(), m[0].translate(_LOWER)) for m in _WORD.finditer(text)]
    starts = np.array([w[0] for w in words] or [0])
    covered = np.zeros(len(text) + 1, dtype=bool)
    for a, b, _ in spans:
        covered[a:b] = True
    out = []
    for a, b, kind in spans:
        low, high = np.searchsorted(starts, a), np.searchsorted(starts, b)
        near = words[max(0, low - rules.window):high + rules.window]
        some = sorted({w for s, e, w in near if not covered[s] and len(w) >= rules.shortest})
        if some:
            out.append((_value(kind, text[a:b]), some))
    return out


def _digest(text: str) -> Column:
    """Names a text among all different ones; null and empty are the same."""
    return F.md5(F.coalesce(named(text).cast("string"), F.lit("")))


def entity_contexts(df: DataFrame, text: str, rules: Disclosure) -> DataFrame:
    """``(text, entity, contexts)``, one row for every entity of a text, each different text once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            names, entities, around = [], [], []
            for name, t in zip(part.column(0).to_pylist(), texts(part, 1)):
                of: dict[str, set[tuple[str, ...]]] = {}
                for entity, words in contexts(t, rules):
                    of.setdefault(entity, set()).add(tuple(words))
                names += [name] * len(of)
                entities += of
                around += [sorted(c) for c in of.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(entities, pa.string()), pa.array(around, pa.list_(pa.list_(pa.string())))],
                names=["text", "entity", "contexts"])

    rows = df.select(_digest(text).alias("d"), named(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "text string, entity string, contexts array<array<string>>").distinct()


def _places(term: Column) -> Column:
    digest = F.xxhash64(term)
    return F.array(F.pmod(digest, F.lit(BITMAP_BITS)),
                   F.pmod(F.shiftrightunsigned(digest, 32), F.lit(BITMAP_BITS)))


def bitmap(terms: DataFrame) -> bytes:
    """Two bits set for each term, in a bitmap of fixed size that is all the driver gets to see."""
    words = terms.select(F.explode(_places(F.col("term"))).alias("at")).groupBy(
        F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("bits")).collect()
    out = np.zeros(BITMAP_BITS // 64, dtype=np.int64)
    for r in words:
        out[r["word"]] = r["bits"]
    return out.tobytes()


def _in_bitmap(words: list[str], bits: np.ndarray) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    hashed = np.fromiter((digest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
    signed = hashed.view(np.int64)
    out = np.ones(len(words), dtype=bool)
    for at in (np.mod(signed, BITMAP_BITS), np.mod((hashed >> np.uint64(32)).view(np.int64), BITMAP_BITS)):
        out &= (bits[at >> 6] >> (at & 63)) & 1 == 1
    return out


def _marked(column: pa.Array, bits: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words of the column that the bitmap has; the number of such a word and its text, wherever one occurs."""
    plain = pa.array([(t or "").encode().translate(_LETTERS) for t in column.to_pylist()], pa.binary()).cast(pa.string())
    words, codes, sizes = numbered_words(plain)
    words = words.to_numpy(zero_copy_only=False).tolist()
    hit = _in_bitmap(words, bits) if words else np.zeros(0, dtype=bool)
    at = np.nonzero(hit[codes])[0] if len(codes) else codes
    return words, codes[at], np.repeat(np.arange(len(sizes)), sizes)[at]


def texts_with(df: DataFrame, text: str, marks: bytes, copies: bytes) -> DataFrame:
    """``(term, n_term)``: different texts that have a word of the bitmap.

    Texts outside ``copies``, the bitmap of digests that occur more than once,
    are summed up in each slice; the others are compared by digest.
    """
    shared = df.sparkSession.sparkContext.broadcast((marks, copies))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, copied = (np.frombuffer(b, dtype=np.int64) for b in shared.value)
        for part in slices(batches, 1):
            names, rows = part.column(0).to_pylist(), max(1, part.num_rows)
            words, codes, doc = _marked(part.column(1), bits)
            maybe = _in_bitmap(names, copied)
            once = np.unique(doc * max(1, len(words)) + codes)
            doc, codes = once // max(1, len(words)), once % max(1, len(words))
            found, n = np.unique(codes[~maybe[doc]], return_counts=True)
            out_names, terms, counts = [None], [[words[i] for i in found.tolist()]], [n.astype(np.int64).tolist()]
            ends = np.searchsorted(doc, np.arange(rows + 1))
            for i in {names[i]: i for i in np.nonzero(maybe)[0].tolist()}.values():
                out_names.append(names[i])
                terms.append(sorted(words[c] for c in codes[ends[i]:ends[i + 1]].tolist()))
                counts.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_names, pa.string()), pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))],
                names=["text", "terms", "counts"])

    rows = df.select(_digest(text).alias("d"), named(text).cast("string").alias("t"))
    found = durable(rows.mapInArrow(run, "text string, terms array<string>, counts array<long>"), "marked-words")
    summed = found.where("text IS NULL").select(F.explode(F.arrays_zip("terms", "counts")).alias("c")).select(
        F.col("c.terms").alias("term"), F.col("c.counts").alias("n"))
    compared = found.where("text IS NOT NULL").select("text", "terms").distinct().select(
        F.explode("terms").alias("term"), F.lit(1).cast("long").alias("n"))
    return summed.unionByName(compared).groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing_terms(df: DataFrame, text: str = "text", rules: Disclosure = Disclosure()) -> DataFrame:
    """``(term, disclosure)``: the most that a word discloses about any entity, if over the lower threshold."""
    found = durable(entity_contexts(df, text, rules), "contexts")
    digests = durable(df.select(_digest(text).alias("term")).groupBy("term").agg(F.count("*").alias("n")), "digests")
    total = float(digests.count())
    entities = found.groupBy("entity").agg(F.count("*").alias("n_entity"))
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    in_texts = found.select("entity", F.explode(F.array_distinct(F.flatten("contexts"))).alias("term")).select(
        "entity", "term", one.alias("n_both"), none.alias("n_contexts"))
    different = found.select("entity", F.explode("contexts").alias("words")).distinct()
    in_contexts = different.select("entity", F.explode("words").alias("term")).select(
        "entity", "term", none.alias("n_both"), one.alias("n_contexts"))
    pairs = in_texts.unionByName(in_contexts).groupBy("entity", "term").agg(
        F.sum("n_both").alias("n_both"), F.sum("n_contexts").alias("n_contexts")).where(F.col("n_contexts") >= rules.contexts)
    candidates = durable(pairs.join(entities, "entity"), "candidates")
    counted = texts_with(df, text, bitmap(candidates.select("term")), bitmap(digests.where("n > 1").select("term")))
    content = -F.log(F.col("n_entity") / F.lit(max(total, 1.0)))
    surprise = F.log((F.col("n_both") / F.col("n_entity")) / (F.col("n_term") / F.lit(max(total, 1.0))))
    rated = candidates.join(counted, "term").withColumn(
        "disclosure", F.when(content > 0, surprise / content).otherwise(F.lit(0.0)))
    return rated.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(
        F.col("disclosure") >= rules.generalise)


RESULT = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("base", T.StringType()),
       T.StructField("marked", T.ArrayType(T.StructType([
           T.StructField("term", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def _spans(marks: bytes):
    def compute(batch: list[str]) -> list:
        bits = np.frombuffer(marks, dtype=np.int64)
        words, codes, doc = _marked(pa.array(batch, pa.large_string()), bits)
        wanted: dict[int, set[str]] = {}
        for w, d in set(zip(codes.tolist(), doc.tolist())):
            wanted.setdefault(d, set()).add(words[w])
        counts, digests, bases, marked = [[] for _ in KINDS], [], [], []
        for i, text in enumerate(batch):
            found = base_spans(text)
            for out, spans in zip(counts, found):
                out.append(len(spans))
            joined = ",".join(f"{k}:{a}:{b}" for k, spans in zip(KINDS, found) for a, b in spans)
            bases.append(joined)
            digests.append(hashlib.sha256(joined.encode()).hexdigest())
            here = []
            if i in wanted:
                taken = sorted(s for spans in found for s in spans)
                starts = np.array([a for a, _ in taken] or [len(text) + 1])
                ends = np.maximum.accumulate(np.array([b for _, b in taken] or [0]))
                for m in _WORD.finditer(text):
                    word = m[0].translate(_LOWER)
                    if word in wanted[i]:
                        before = int(np.searchsorted(starts, m.end())) - 1
                        if before < 0 or ends[before] <= m.start():
                            here.append({"term": word, "start": m.start(), "end": m.end()})
            marked.append(here)
        return [*counts, digests, bases, marked]

    return compute


def find_personal_data(df: DataFrame, carried: tuple[str, ...] = ("doc_id",), text: str = "text",
                       rules: Disclosure = Disclosure()) -> DataFrame:
    """``carried`` columns, counts of the fixed kinds and their digest, ``spans`` of all kinds, and ``terms`` with their disclosure."""
    terms = durable(disclosing_terms(df, text, rules), "disclosing-terms")
    rows = map_texts(df, carried, text, RESULT, _spans(bitmap(terms)))
    numbered = durable(rows.toDF(*[f"c{i}" for i in range(len(carried))], *RESULT.names).withColumn(
        "row", F.monotonically_increasing_id()), "spans")
    marked = numbered.where(F.size("marked") > 0).select("row", F.explode("marked").alias("m")).select("row", "m.*")
    known = marked.join(terms, "term").groupBy("row").agg(F.array_sort(F.collect_list(
        F.struct("start", "end", "term", "disclosure"))).alias("terms"))
    out = numbered.join(known, "row", "left")
    none = F.array().cast(known.schema["terms"].dataType)
    found = F.coalesce(F.col("terms"), none)
    added = F.transform(found, lambda m: F.concat_ws(":", F.lit("term"), m["start"].cast("string"), m["end"].cast("string")))
    every = F.concat(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.array("base")), added)
    return out.select(
        *[F.col(f"c{i}").alias(n) for i, n in enumerate(carried)], *[f"n_{k}" for k in KINDS], "base_sha256",
        F.array_join(every, ",").alias("spans"), found.alias("terms"))


def sanitise(df: DataFrame, carried: tuple[str, ...] = ("doc_id",), text: str = "text",
             rules: Disclosure = Disclosure()) -> DataFrame:
    """``carried`` columns and the text with entities named by kind, disclosing words generalised or removed."""
    inner = df.select(*[named(n).alias(f"k{i}") for i, n in enumerate(carried)], named(text).cast("string").alias("t"))
    found = find_personal_data(inner, (*[f"k{i}" for i in range(len(carried))], "t"), "t", rules)
    upper = rules.remove

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(carried)
        for part in slices(batches, k):
            out = []
            for t, spans, terms in zip(*(part.column(i).to_pylist() for i in (k, k + 1, k + 2))):
                removed = {m["start"] for m in terms if m["disclosure"] >= upper}
                cuts = [(int(a), int(b), kind) for kind, a, b in (s.split(":") for s in spans.split(",") if s)]
                pieces, at = [], 0
                for a, b, kind in sorted(cuts):
                    if a >= at:
                        pieces += [t[at:a], "" if kind == "term" and a in removed else f"<{kind}>"]
                        at = b
                out.append(None if t is None else "".join(pieces) + t[at:])
            yield pa.RecordBatch.from_arrays([*part.columns[:k], pa.array(out, pa.string())],
                                             names=[f"k{i}" for i in range(k)] + ["t"])

    schema = T.StructType([found.schema[f"k{i}"] for i in range(len(carried))] + [T.StructField("t", T.StringType())])
    return found.select(*[f"k{i}" for i in range(len(carried))], "t", "spans", "terms").mapInArrow(run, schema).toDF(
        *carried, text)
