"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that two fingerprints within
the wanted distance differ by at most one bit in one of them (4 bits: three
segments). For every bit of every segment the index holds the segment with
that bit left out. Two segments that differ by at most one bit share such a
variant, so an equality match on the variants finds every pair, and the
distance of the whole fingerprints decides.

Texts with equal fingerprints are one node from the start, however many there
are. Within a variant only as many links are written as are needed to hold
its linked fingerprints together, never all pairs.

Defined results: a null text is empty and has fingerprint zero, which is
linked like any other; texts of fewer words than a shingle are one shingle.
A null id is never the smallest; a component of null ids only has a null
component id. Repeated rows are repeated in the result. An empty table gives
an empty one. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.llm.batches import map_texts, named
from tabloom.llm.graph import components
from tabloom.session import broadcast_if_small, durable

BITS = 64
SEED = 42
# Shingles whose bits are unpacked at a time, and members of a variant compared pair by pair.
UNPACKED = 1 << 15
SMALL_GROUP = 16
# Fingerprints of a variant that one task holds at a time.
MOST_TOGETHER = 1_000_000


def fingerprint(text: str, shingle: int = 4) -> int:
    """Signed 64-bit value whose bit is set if it is set in over half the shingle hashes."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    count = max(1, len(words) - shingle + 1)
    stops = ends[min(shingle, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:count].tolist(), stops.tolist())),
                         dtype=np.uint64, count=count)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, count, UNPACKED):
        part = hashes[i:i + UNPACKED].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > count, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", carried: tuple[str, ...] = ("doc_id",), shingle: int = 4) -> DataFrame:
    """``carried`` columns and the fingerprint ``fp`` of each row."""
    return map_texts(df, carried, text, T.StructType([T.StructField("fp", T.LongType())]),
                     lambda batch: [[fingerprint(t, shingle) for t in batch]])


def segments(distance: int) -> list[tuple[int, int]]:
    """``(first bit, width)`` of the fewest segments of which one differs by at most one bit."""
    n = distance // 2 + 1
    edges = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def variants(fps: DataFrame, distance: int) -> DataFrame:
    """One row for each fingerprint and left-out bit: the bit, the rest of its segment, the fingerprint."""
    kept = [_signed((((1 << width) - 1) << start) & ~(1 << (start + i)))
            for start, width in segments(distance) for i in range(width)]
    masks = F.array(*[F.lit(m) for m in kept])
    return fps.select("fp", F.posexplode(masks).alias("bit", "mask")).select(
        "bit", F.col("fp").bitwiseAND(F.col("mask")).alias("rest"), "fp")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _forest(members: np.ndarray, distance: int) -> tuple[list, list]:
    """Links that hold together what is linked among ``members``, by breadth-first search over those not reached yet."""
    left, right = [], []
    waiting = members
    while len(waiting):
        reached = [waiting[0]]
        waiting = waiting[1:]
        while reached and len(waiting):
            at = reached.pop()
            near = _distances(waiting, at) <= distance
            found = waiting[near]
            if len(found):
                left += [at] * len(found)
                right += found.tolist()
                reached += found.tolist()
                waiting = waiting[~near]
    return left, right


def _links(bit: np.ndarray, rest: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that are sorted by variant; every group is whole."""
    new = np.ones(len(fp), dtype=bool)
    new[1:] = (bit[1:] != bit[:-1]) | (rest[1:] != rest[:-1])
    group = np.cumsum(new) - 1
    sizes = np.bincount(group)
    left, right = [], []
    small = sizes[group] <= SMALL_GROUP
    g, f = group[small], fp[small]
    for step in range(1, SMALL_GROUP):
        if len(f) <= step:
            break
        near = (g[step:] == g[:-step]) & (_distances(f[step:], f[:-step]) <= distance)
        left.append(f[:-step][near])
        right.append(f[step:][near])
    starts = np.nonzero(new)[0]
    for k in np.nonzero(sizes > SMALL_GROUP)[0]:
        a, b = _forest(fp[starts[k]:starts[k] + sizes[k]], distance)
        left.append(np.array(a, dtype=np.int64))
        right.append(np.array(b, dtype=np.int64))
    return np.concatenate(left or [fp[:0]]), np.concatenate(right or [fp[:0]])


_FOUND = "a long, b long, bit long, rest long, size long"


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
    none = pa.nulls(len(pairs), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none, none, none],
                                      names=["a", "b", "bit", "rest", "size"])


def _mark(bit: int, rest: int, size: int) -> pa.RecordBatch:
    none = pa.nulls(1, pa.int64())
    return pa.RecordBatch.from_arrays([none, none, *[pa.array([v], pa.int64()) for v in (bit, rest, size)]],
                                      names=["a", "b", "bit", "rest", "size"])


def _find_links(distance: int, most: int | None):
    """Links of groups that come sorted; of a group of more than ``most`` members only its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, dtype=np.int64)] * 3
        large: list[int] | None = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if large is not None:
                same = (new[0] == large[0]) & (new[1] == large[1])
                large[2] += int(same.sum())
                new = [x[~same] for x in new]
                if not len(new[0]):
                    continue
                yield _mark(*large)
                large = None
            held = [np.concatenate((h, x)) for h, x in zip(held, new)]
            if not len(held[0]):
                continue
            # The last group may go on in the next batch.
            open_ = (held[0] == held[0][-1]) & (held[1] == held[1][-1])
            cut = int(np.argmax(open_))
            if cut:
                yield from whole_groups([h[:cut] for h in held])
                held = [h[cut:] for h in held]
            if most is not None and len(held[0]) > most:
                large = [int(held[0][0]), int(held[1][0]), len(held[0])]
                held = [h[:0] for h in held]
        if large is not None:
            yield _mark(*large)
        if len(held[0]):
            yield from whole_groups(held)

    def whole_groups(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if most is not None:
            new = np.ones(len(rows[0]), dtype=bool)
            new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            group = np.cumsum(new) - 1
            sizes = np.bincount(group)
            for k in np.nonzero(sizes > most)[0]:
                at = int(np.argmax(group == k))
                yield _mark(int(rows[0][at]), int(rows[1][at]), int(sizes[k]))
            rows = [x[sizes[group] <= most] for x in rows]
        if len(rows[0]):
            yield _edges(*_links(*rows, distance))

    return run


def link_fingerprints(fps: DataFrame, distance: int = 4, most: int = MOST_TOGETHER) -> DataFrame:
    """``(a, b)``: links between distinct fingerprints whose components are those of all pairs within ``distance``.

    A variant of more than ``most`` fingerprints is cut into parts, and every
    two parts of it meet in a group of their own.
    """
    index = variants(fps, distance).withColumn("bit", F.col("bit").cast("long"))
    sorted_ = index.repartition("bit", "rest").sortWithinPartitions("bit", "rest")
    found = durable(sorted_.select("bit", "rest", "fp").mapInArrow(_find_links(distance, most), _FOUND), "links")
    links = found.where("a IS NOT NULL").select("a", "b")
    large = found.where("a IS NULL").select("bit", "rest", F.ceil(F.col("size") * 4 / most).alias("parts"))
    if large.limit(1).count():
        members = index.join(broadcast_if_small(large), ["bit", "rest"])
        own = members.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts"))).withColumn(
            "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        # One number for the variant and the two parts; groups that share a number by chance do no harm.
        group = F.xxhash64("bit", "rest", F.least("own", "other"), F.greatest("own", "other"))
        met = own.select(F.lit(-1).cast("long").alias("bit"), group.alias("rest"), "fp")
        again = met.repartition("rest").sortWithinPartitions("rest").mapInArrow(_find_links(distance, None), _FOUND)
        links = links.unionByName(again.select("a", "b"))
    return links.distinct()


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 4,
                    distance: int = 4) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row.

    ``component_id`` is the smallest id that can be reached over links of at
    most ``distance`` differing bits, the own id included.
    """
    signed = durable(fingerprints(df, text, (id_column,), shingle).select(
        named(id_column).alias("id"), "fp"), "fingerprints")
    found = _components(signed, distance)
    out = signed.join(found, "fp", "left")
    return out.select(F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.col("least").alias("component_id"))


def _components(signed: DataFrame, distance: int) -> DataFrame:
    """``(fp, root, least)`` of every fingerprint: its component and the smallest id in it."""
    own = durable(signed.groupBy("fp").agg(F.min("id").alias("own")), "distinct-fingerprints")
    roots = durable(components(link_fingerprints(own.select("fp"), distance)), "components")
    rooted = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "own", F.coalesce("root", "fp").alias("root"))
    least = durable(rooted.groupBy("root").agg(F.min("own").alias("least")), "least-ids")
    return durable(rooted.drop("own").join(least, "root"), "fingerprint-components")


def keep_one_of_each(df: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = 4,
                     distance: int = 4) -> DataFrame:
    """One row of each component, with all columns: the one with the smallest id, then the smallest digest of the row.

    Of rows that are alike in every column, one stays.
    """
    names = df.columns
    row = F.xxhash64(*[named(n) for n in names])
    inner = df.select(*[named(n).alias(f"c{i}") for i, n in enumerate(names)],
                      F.coalesce(named(id_column).cast("long"), F.lit(0)).alias("id0"), row.alias("row"))
    at, id_at = f"c{names.index(text)}", f"c{names.index(id_column)}"
    signed = durable(fingerprints(inner, at, (id_at, "id0", "row"), shingle).withColumnRenamed(id_at, "id"),
                     "fingerprints")
    found = _components(signed, distance).select("fp", "root")
    order = F.min(F.struct(F.col("id").isNull().alias("none"), "id0", "row"))
    first = durable(
        signed.groupBy("fp").agg(order.alias("first")).join(found, "fp")
        .groupBy("root").agg(F.min("first").alias("first")).select("first.id0", "first.row"), "first-rows")
    chosen = inner.join(first, ["id0", "row"], "left_semi").dropDuplicates(["id0", "row"])
    return chosen.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
