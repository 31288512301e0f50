"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the word windows of the benchmark items. They are grouped by
length (items shorter than a window are one pattern each), and every group
has its own tables. With ``m`` the length of the group and a block of two
words:

* the shift table gives, for the hash of a block, how far the search may move
  on without missing a pattern; a block that is in no pattern allows
  ``m - 1`` words;
* where the shift is zero, the bucket of the block names the patterns that
  end with it;
* those are compared word by word with the text.

A group of single words has no block and is a plain table of words.

The benchmark is searched in blocks of about ``block_windows`` patterns, so
the size of the tables has a fixed bound. A single block needs no shuffle.
Several are searched in jobs of their own, one after the other: each writes
what it finds, its tables are given back, and the findings, never the texts,
are put together by row at the end.

Defined results: a null or empty text, or one without a word, has no words,
no hits and is not contaminated; such an item is never found. Repeated items
each count under their id; items without an id are found but not counted
among the ids. Repeated rows give repeated results; an empty table or an
empty benchmark gives rows without hits. Other columns play no part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.llm.batches import named, slices
from tabloom.session import durable

WINDOW = 13
BLOCK_WINDOWS = 200_000
# Entries of a shift table; blocks with equal hashes share the smaller shift.
SHIFT_SIZE = 1 << 18

# A-Z become a-z; bytes that are not part of a word become blanks. Bytes of 0x80 and more belong to characters beyond ASCII.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


def windows(words: Sequence[bytes], size: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield tuple(words[i:i + size])


@dataclass
class Tables:
    """Wu-Manber tables of the patterns that have ``length`` words."""

    length: int
    patterns: list[tuple[bytes, ...]] = field(default_factory=list)
    items: list[list[int]] = field(default_factory=list)
    shift: bytes = b""
    buckets: dict[tuple[bytes, bytes], list[int]] = field(default_factory=dict)
    single: dict[bytes, int] = field(default_factory=dict)

    def build(self) -> "Tables":
        m = self.length
        if m == 1:
            self.single = {p[0]: k for k, p in enumerate(self.patterns)}
            return self
        shift = bytearray([min(m - 1, 255)]) * SHIFT_SIZE
        buckets = defaultdict(list)
        for k, p in enumerate(self.patterns):
            for j in range(1, m):
                at = block_hash(p[j - 1], p[j])
                shift[at] = min(shift[at], m - 1 - j)
            buckets[p[-2:]].append(k)
        self.buckets = dict(buckets)
        self.shift = bytes(shift)
        return self


def block_hash(a: bytes, b: bytes) -> int:
    """Position in the shift table; the same in every process, unlike ``hash``."""
    return (int.from_bytes(a[-8:], "little") * 0x9E3779B1 + int.from_bytes(b[-8:], "little") * 0x85EBCA77
            + (len(a) << 3) + len(b)) % 0x3FFFFFFB % SHIFT_SIZE


def build_tables(found: Iterable[tuple[Sequence[bytes], Sequence[int]]]) -> list[Tables]:
    groups: dict[int, Tables] = {}
    for pattern, items in found:
        group = groups.setdefault(len(pattern), Tables(len(pattern)))
        group.patterns.append(tuple(pattern))
        group.items.append(list(items))
    return [groups[m].build() for m in sorted(groups)]


def search(words: Sequence[bytes], tables: Tables) -> list[tuple[int, int]]:
    """``(first word, pattern)`` of every occurrence."""
    found = []
    if tables.length == 1:
        single = tables.single
        return [(i, single[w]) for i, w in enumerate(words) if w in single]
    m, shift, buckets, patterns = tables.length, tables.shift, tables.buckets, tables.patterns
    at, n = m - 1, len(words)
    while at < n:
        a, b = words[at - 1], words[at]
        step = shift[block_hash(a, b)]
        if step:
            at += step
            continue
        for k in buckets.get((a, b), ()):
            if tuple(words[at - m + 1:at + 1]) == patterns[k]:
                found.append((at - m + 1, k))
        at += 1
    return found


def _merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _patterns(benchmark: DataFrame, item: str, text: str, size: int) -> DataFrame:
    """``(pattern, items)``, each different window once, with the ids of the items that have it."""
    k = max(1, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 1 << 20):
            ids, patterns = [], []
            for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for w in set(windows(words_of(t), k)):
                    ids.append(i)
                    patterns.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(patterns, pa.binary())], names=["item", "pattern"])

    rows = benchmark.select(named(item).cast("string").alias("item"), named(text).cast("string").alias("t"))
    patterns = rows.mapInArrow(run, "item string, pattern binary").groupBy("pattern").agg(
        F.collect_set("item").alias("items"))
    return durable(patterns, "patterns")


def _block_tables(patterns: DataFrame, block: int, blocks: int) -> list[Tables]:
    some = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block)
    return build_tables((bytes(r.pattern).split(b" "), r["items"]) for r in some.collect())


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType()))])
_ARROW_SPANS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _search_block(shared: Broadcast, text: int, drop_text: bool):
    """The columns of ``FOUND`` added to every row, for one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = shared.value
        for part in slices(batches, text):
            counts, all_spans, all_items = [], [], []
            for t in part.column(text).to_pylist():
                words = words_of(t)
                new, names = [], set()
                for group in groups:
                    for at, k in search(words, group):
                        new.append((at, at + group.length))
                        names.update(group.items[k])
                counts.append(len(words))
                all_spans.append([{"a": a, "b": b} for a, b in _merge(new)])
                all_items.append(sorted(names))
            columns, labels = list(part.columns), list(part.schema.names)
            if drop_text:
                del columns[text], labels[text]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(counts, pa.int64()), pa.array(all_spans, _ARROW_SPANS), pa.array(all_items, pa.list_(pa.string()))],
                names=labels + FOUND.names)

    return run


def _merge_findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of one row from several blocks become one list without overlaps."""
    for batch in batches:
        spans = [[{"a": a, "b": b} for a, b in _merge((s["a"], s["b"]) for s in row)] for row in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(spans, _ARROW_SPANS), batch.column(3)], names=["row", *FOUND.names])


def _search(df: DataFrame, tables: list[Tables], at: int, drop_text: bool = False) -> tuple[DataFrame, Broadcast]:
    shared = df.sparkSession.sparkContext.broadcast(tables)
    kept = [f for i, f in enumerate(df.schema.fields) if not (drop_text and i == at)]
    return df.mapInArrow(_search_block(shared, at, drop_text), T.StructType(kept + FOUND.fields)), shared


def find_passages(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", size: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
                  drop_text: bool = False) -> DataFrame:
    """All columns of ``df`` as ``c0, c1 …`` with the number of words, the hit spans (in words, end exclusive) and the ids found.

    ``drop_text`` leaves the text column out, so that texts are not sent back.
    """
    at = df.columns.index(text)
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    patterns = _patterns(benchmark, item_id, item_text, size)
    blocks = max(1, -(-patterns.count() // block_windows))
    if blocks == 1:
        return _search(rows, _block_tables(patterns, 0, 1), at, drop_text)[0]
    # Numbers of rows in a written table stay the same in every job.
    numbered = durable(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
    findings = None
    for block in range(blocks):
        found, shared = _search(numbered.select("row", names[at]), _block_tables(patterns, block, blocks), 1, drop_text=True)
        # The first block's rows carry the number of words, so all of them are kept.
        found = durable(found if block == 0 else found.where(F.size("spans") > 0), "findings")
        shared.destroy()
        findings = found if findings is None else findings.unionByName(found)
    merged = findings.groupBy("row").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.mapInArrow(_merge_findings, T.StructType([numbered.schema["row"], *FOUND.fields]))
    kept = [n for i, n in enumerate(names) if not (drop_text and i == at)]
    return numbered.select("row", *kept).join(merged, "row").select(*kept, *FOUND.names)


def _hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["b"] - s["a"])


def decontaminate(df: DataFrame, benchmark: DataFrame, carried: tuple[str, ...] = ("doc_id",), text: str = "text",
                  percent: int = 5, **options) -> DataFrame:
    """``carried`` columns, counts, ids and verdict: contaminated if at least ``percent`` of the words are hit."""
    inner = df.select(*[named(n).alias(f"k{i}") for i, n in enumerate(carried)], named(text).cast("string").alias("t"))
    found = find_passages(inner, benchmark, "t", drop_text=True, **options).withColumn("n_hit", _hit())
    return found.select(
        *[F.col(f"c{i}").alias(n) for i, n in enumerate(carried)], "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", percent: int = 5, **options) -> DataFrame:
    """The rows that are not contaminated, with all their columns."""
    names = df.columns
    found = find_passages(df, benchmark, text, **options).withColumn("n_hit", _hit())
    clean = found.where((F.col("n_hit") == 0) | (100 * F.col("n_hit") < percent * F.col("n_words")))
    return clean.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
