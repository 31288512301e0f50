"""The trie of conversations that share their beginnings, from composable fingerprints.

Conversation c is rebuilt as the first turns of its block's first conversation
(``c - c % block``) followed by its own later turns. The rebuilt texts never
exist here. A sequence of turns is an element of a monoid, ``(B^length, sum of
turn_j * B^j)`` modulo the prime 2^31 - 1, and two sequences are joined by

    (A, F) . (A', F') = (A * A', F + A * F').

So every prefix of a rebuilt conversation is a product of two stored prefix
products: the head's own, and the quotient of two of the conversation's own.
Four such monoids with different B give 124 bits. Prefixes of equal depth and
fingerprint are one node. Each of them refers to the stored turn it ends with;
a node is accepted only if all these turns have one strong digest (128 bits,
others than those the fingerprint is made of) and all prefixes one step shorter
one fingerprint. Were this ever not so, everything is done again with other B.

The prefix products are running sums over a range-partitioned, sorted table,
so one long conversation is spread over tasks, and its pieces are joined by
the same product. Sums over subtrees need no walk through the trie: each node
belongs to its smallest member, so a subtree's sum is that of the members'
own totals, less what the node's smallest member owns above it.

The only step that a popular node's rows pass one after the other is the
digest of its ids, which is sequential by definition; ids are streamed there.

Defined results: turns are ordered by ``turn``, null first, then by the digest
of role and text; null roles and texts are empty; repeated rows are turns of
their own. Rows without a conversation belong to none and are left out. An
empty table has no nodes. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabloom.llm.batches import named
from tabloom.session import broadcast_if_small, durable

P = (1 << 31) - 1
LANES = 4
# Nodes of one chain that are summed up in one task.
STRETCH = 4096
# Conversations may be as long as a power of two of this size.
POWERS = 62


def multipliers(seed: int) -> list[int]:
    """Four multipliers, far from 0 and 1."""
    raw = hashlib.sha256(f"prefix trie {seed}".encode()).digest()
    return [int.from_bytes(raw[4 * i:4 * i + 4], "little") % (P - 1000) + 500 for i in range(LANES)]


def _power_array(base: int, exponents: np.ndarray) -> np.ndarray:
    out, square, left = np.ones(len(exponents), dtype=np.int64), base, exponents.copy()
    while left.any():
        out = np.where(left & 1, out * square % P, out)
        square = square * square % P
        left >>= 1
    return out


def _power(base: int, exponent: Column) -> Column:
    squares = [pow(base, 1 << i, P) for i in range(POWERS)]
    bits = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).cast("long").alias("s")) for i, s in enumerate(squares)])
    one = F.lit(1).cast("long")
    return F.aggregate(bits, one, lambda acc, b: F.when(
        F.getbit(exponent, b["i"]) == 1, acc * b["s"] % P).otherwise(acc))


def _pack(lanes: Sequence[Column]) -> tuple[Column, Column]:
    a, b, c, d = lanes
    return F.shiftleft(a, 31).bitwiseOR(b), F.shiftleft(c, 31).bitwiseOR(d)


def _lanes(x: str, y: str) -> list[Column]:
    return [lane for n in (x, y) for lane in (F.shiftright(n, 31), F.col(n).bitwiseAND(F.lit(P).cast("long")))]


SCANNED = T.StructType([T.StructField(n, T.LongType()) for n in (
    "part", "c", "at", "x", "y", "ex", "ey", "v1", "v2", "chars")])


def _scanner(bases: list[int]):
    """Place and prefix product of each row among those of its conversation in the partition; rows come sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, count, carried = None, 0, np.zeros((LANES, 1), dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            c = batch.column(0).to_numpy()
            digest = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u4").reshape(n, 8)
            index = np.arange(n)
            fresh = np.concatenate(([True], c[1:] != c[:-1]))
            start = np.maximum.accumulate(np.where(fresh, index, 0))
            first = start == 0
            goes_on = last is not None and c[0] == last
            at = index - start + np.where(first & goes_on, count, 0)
            turn = digest[:, :4].astype(np.int64) % P
            terms = np.stack([turn[:, i] * _power_array(b, at) % P for i, b in enumerate(bases)])
            sums = np.cumsum(terms, axis=1)
            sums -= (sums - terms)[:, start]
            sums = (sums + np.where(first & goes_on, carried, 0)) % P
            last, count, carried = c[-1], int(at[-1]) + 1, sums[:, -1:]
            check = digest[:, 4:].copy().view("<i8")
            columns = [np.full(n, part), c, at, sums[0] << 31 | sums[1], sums[2] << 31 | sums[3],
                       terms[0] << 31 | terms[1], terms[2] << 31 | terms[3], check[:, 0], check[:, 1], batch.column(2).to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=SCANNED.names)

    return run


def _prefix_products(turns: DataFrame, bases: list[int]) -> DataFrame:
    """``(c, at, x, y, ex, ey, v1, v2, chars)``: each turn's place, the product up to it, its own term, its check digest."""
    # The row number parts repeated rows, whose order among each other does not matter.
    spread = turns.withColumn("row", F.monotonically_increasing_id())
    ranged = spread.repartitionByRange("c", F.col("turn").asc_nulls_first(), "digest", "row").sortWithinPartitions(
        "c", F.col("turn").asc_nulls_first(), "digest")
    scanned = durable(ranged.select("c", "digest", "chars").mapInArrow(_scanner(bases), SCANNED), "scanned")
    # Only a partition's first and last conversation can go on elsewhere: two rows a partition.
    edges = scanned.groupBy("part").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    edges = edges.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("c"))
    terms = _lanes("ex", "ey")
    pieces = scanned.join(F.broadcast(edges), ["part", "c"]).groupBy("c", "part").agg(
        F.count("*").alias("n"), *[(F.sum(t) % P).alias(f"t{i}") for i, t in enumerate(terms)])
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    pieces = pieces.withColumns({f"m{i}": _power(b, F.col("before")) for i, b in enumerate(bases)})
    pieces = pieces.withColumns({f"o{i}": F.coalesce(F.sum(F.col(f"t{i}") * F.col(f"m{i}") % P).over(before) % P, F.lit(0))
                                 for i in range(LANES)})
    moved = pieces.where("before > 0").select("c", "part", "before", *[f"{k}{i}" for k in "mo" for i in range(LANES)])
    rows = scanned.join(broadcast_if_small(durable(moved, "moved")), ["c", "part"], "left")
    factor = [F.coalesce(f"m{i}", F.lit(1)) for i in range(LANES)]
    sums = [(F.coalesce(f"o{i}", F.lit(0)) + factor[i] * s) % P for i, s in enumerate(_lanes("x", "y"))]
    own = [factor[i] * t % P for i, t in enumerate(terms)]
    (x, y), (ex, ey) = _pack(sums), _pack(own)
    return rows.select("c", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), x.alias("x"), y.alias("y"),
                       ex.alias("ex"), ey.alias("ey"), "v1", "v2", "chars")


def _own_turns(conversations: DataFrame, id_column: str, turn: str, role: str, text: str) -> DataFrame:
    role_, text_ = (F.coalesce(named(n).cast("string"), F.lit("")) for n in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role_).cast("string"), F.lit(":"), role_, text_), 256))
    return conversations.where(named(id_column).isNotNull()).select(
        named(id_column).cast("long").alias("c"), named(turn).alias("turn"), digest.alias("digest"),
        F.char_length(text_).cast("long").alias("chars"))


def rebuilt_prefixes(turns: DataFrame, block: int, most: int, seed: int) -> DataFrame:
    """Every prefix of every rebuilt conversation, one narrow row each.

    ``(c, d, x, y, px, py, v1, v2, chars, ends)``: depth, fingerprint, that of
    the prefix one turn shorter, digest and length of the turn it ends with,
    and whether the conversation ends here.
    """
    bases = multipliers(seed)
    turns = _prefix_products(turns, bases).withColumn("h", F.crc32(F.col("c").cast("string").cast("binary")) % most)
    turns = durable(turns, "turns")
    early = F.col("at") < F.col("h")
    skipped = [F.sum(F.when(early, t).otherwise(0)) % P for t in _lanes("ex", "ey")]
    hx, hy = _pack(skipped)
    convs = turns.groupBy("c", "h").agg(F.count("*").alias("n"), hx.alias("hx"), hy.alias("hy"))
    step = F.struct("at", "x", "y", "ex", "ey", "v1", "v2", "chars")
    # At most ``most - 1`` turns of a head are ever used.
    heads = turns.where((F.col("c") % block == 0) & (F.col("at") < most - 1)).groupBy(F.col("c").alias("head")).agg(
        F.sort_array(F.collect_list(step)).alias("steps"))
    convs = convs.join(heads, convs["c"] - convs["c"] % block == heads["head"], "left")
    steps = F.slice("steps", F.lit(1), F.col("h").cast("int"))
    convs = convs.withColumn("steps", F.coalesce(steps, F.array().cast(convs.schema["steps"].dataType)))
    convs = convs.withColumn("m", F.size("steps").cast("long"))
    convs = convs.withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = durable(convs, "rebuilt")
    zero = F.lit(0).cast("long")

    def prefixes(rows: DataFrame, d: Column, lanes, shorter, ends: Column, *rest) -> DataFrame:
        (x, y), (px, py) = _pack(lanes), _pack(shorter)
        return rows.select("c", d.alias("d"), x.alias("x"), y.alias("y"), px.alias("px"), py.alias("py"), *rest, ends.alias("ends"))

    root = convs.select("c", zero.alias("d"), *[zero.alias(n) for n in ("x", "y", "px", "py", "v1", "v2", "chars")],
                        (F.col("length") == 0).alias("ends"))
    shared = convs.select("c", "length", F.inline("steps"))
    lanes, terms = _lanes("x", "y"), _lanes("ex", "ey")
    shared = prefixes(shared, F.col("at") + 1, lanes, [(s - t + P) % P for s, t in zip(lanes, terms)],
                      F.col("at") + 1 == F.col("length"), "v1", "v2", "chars")
    last = F.element_at("steps", F.lit(-1))
    start = convs.where("n > h").select(
        F.col("c").alias("of"), "m", "length", "hx", "hy", F.when(F.col("m") > 0, last["x"]).otherwise(0).alias("bx"),
        F.when(F.col("m") > 0, last["y"]).otherwise(0).alias("by"))
    own = turns.where("at >= h").join(start, turns["c"] == start["of"])
    # The own turns move up by the turns that the head lacks, a division by a power of B.
    missing = F.col("h") - F.col("m")
    shift = [F.element_at(F.array(*[F.lit(pow(b, -k, P)).cast("long") for k in range(most)]), (missing + 1).cast("int")) for b in bases]
    moved = [(b + f * ((s - h + P) % P)) % P for b, f, s, h in zip(_lanes("bx", "by"), shift, lanes, _lanes("hx", "hy"))]
    shorter = [(s - f * t % P + P) % P for s, f, t in zip(moved, shift, terms)]
    depth = F.col("m") + F.col("at") - F.col("h") + 1
    own = prefixes(own, depth, moved, shorter, depth == F.col("length"), "v1", "v2", "chars")
    return root.unionByName(shared).unionByName(own)


KEY = ["d", "x", "y"]
ENDS = T.StructType([T.StructField(n, T.LongType()) for n in (*KEY, "e0", "e1", "e2", "e3")])


def _digest_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the ids of each node; rows come sorted by node and id."""
    now, state = None, None

    def words():
        return np.frombuffer(state.digest(), dtype=">i8").tolist()

    for batch in batches:
        if not batch.num_rows:
            continue
        node = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        ids = batch.column(3).cast(pa.string()).to_pylist()
        cuts = [0, *(np.nonzero((node[1:] != node[:-1]).any(axis=1))[0] + 1).tolist(), len(ids)]
        done = []
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(node[a].tolist())
            some = ",".join(ids[a:b]).encode()
            if key == now:
                state.update(b"," + some)
                continue
            if now is not None:
                done.append((*now, *words()))
            now, state = key, hashlib.sha256(some)
        yield _ends(done)
    if now is not None:
        yield _ends([(*now, *words())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(ENDS)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in columns], names=ENDS.names)


def _verified(prefixes: DataFrame) -> DataFrame | None:
    """Nodes ``(d, x, y, px, py, conv, n, chars, stop)``, or nothing if a fingerprint stands for two sequences."""
    same = ["px", "py", "v1", "v2", "chars"]
    nodes = durable(prefixes.groupBy(*KEY).agg(
        F.min("c").alias("conv"), F.count("*").alias("n"), F.sum(F.col("ends").cast("long")).alias("stop"),
        *[F.min(k).alias(k) for k in same], *[F.max(k).alias(f"{k}_") for k in same]), "nodes")
    wrong = nodes.where(" OR ".join(f"{k} <> {k}_" for k in same)).limit(1).count()
    return None if wrong else nodes.drop(*[f"{k}_" for k in same])


def _owned(nodes: DataFrame) -> DataFrame:
    """``owned``: what a node's smallest member owns from the node on, less all it owns.

    A member owns the nodes it is the smallest member of; they follow each
    other. Long chains are summed by stretches first.
    """
    nodes = nodes.withColumns({"value": (F.col("n") - 1) * F.col("chars"), "stretch": F.floor(F.col("d") / STRETCH)})
    sums = durable(nodes.where(f"d >= {STRETCH}").select("conv").distinct().join(nodes, "conv").groupBy("conv", "stretch").agg(
        F.sum("value").alias("s")), "stretches")
    earlier = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("above", F.coalesce(F.sum("s").over(earlier), F.lit(0))).drop("s")
    nodes = nodes.join(broadcast_if_small(sums), ["conv", "stretch"], "left")
    within = Window.partitionBy("conv", "stretch").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum("value").over(within), F.lit(0)) + F.coalesce("above", F.lit(0))
    return nodes.select(*KEY, "px", "py", "conv", "n", (-above).alias("owned"))


def prefix_trie(conversations: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                block: int = 100, most: int = 6) -> DataFrame:
    """One row per node: ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.

    A conversation takes ``crc32(id) % most`` turns from the head of its block.
    """
    turns = _own_turns(conversations, id_column, turn, role, text)
    seed, nodes = 0, None
    while nodes is None:
        prefixes = durable(rebuilt_prefixes(turns, block, most, seed), "prefixes")
        nodes, seed = _verified(prefixes), seed + 1
    totals = nodes.groupBy(F.col("conv").alias("of")).agg(
        F.sum((F.col("n") - 1) * F.col("chars")).alias("total"), F.sum((F.col("stop") == F.col("n")).cast("long")).alias("leaves"))
    totals = totals.where("total > 0 OR leaves > 0")
    members = prefixes.join(totals, prefixes["c"] == totals["of"])
    ending = prefixes.where("ends").select(*KEY, "c").repartition(*KEY).sortWithinPartitions(*KEY, "c").mapInArrow(_digest_ids, ENDS)
    parts = [
        (_owned(nodes), {n: F.col(n) for n in ("conv", "n", "owned", "px", "py")}, None),
        (members, {"total": F.col("total"), "leaves": F.col("leaves")}, None),
        (nodes.where("d > 0"), {"children": F.lit(1)}, [(F.col("d") - 1).alias("d"), F.col("px").alias("x"), F.col("py").alias("y")]),
        (ending, {f"e{i}": F.col(f"e{i}") for i in range(4)}, None),
    ]
    names = ["conv", "n", "owned", "px", "py", "total", "leaves", "children", "e0", "e1", "e2", "e3"]
    rows = None
    for part, values, key in parts:
        part = part.select(*(key or KEY), *[values.get(n, F.lit(None)).cast("long").alias(n) for n in names])
        rows = part if rows is None else rows.unionByName(part)
    summed = ("total", "leaves", "children")
    whole = durable(rows.groupBy(*KEY).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) if n in summed else F.max(n).alias(n) for n in names]), "trie")
    parents = whole.select((F.col("d") + 1).alias("d"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv").alias("parent"))
    digest = F.concat(*[F.lpad(F.lower(F.hex(f"e{i}")), 16, "0") for i in range(4)])
    return whole.join(parents, ["d", "px", "py"], "left").select(
        F.col("conv").alias(id_column), F.col("d").alias("depth"), F.col("parent").alias(f"parent_{id_column}"),
        F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("owned") + F.col("total")).alias("saved_tokens"),
        F.coalesce(digest, F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
