"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import sys
import zlib
from collections import defaultdict
from functools import cache

import pytest
from pyspark.sql import functions as F

from tabloom.llm import conversation_repair as module
from tabloom.llm.conversation_repair import damage_and_repair, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged_rows(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        n = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if n == 1:
            text = ""
        if n == 2:
            text = "".join(x for x in text if x not in ".!?")
        if n == 4:
            role = "user"
        out[c] += [(t, role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
    return out


def repair(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    faults, seen = [], set()
    for _, role, text in rows:
        core = text.rstrip(BLANKS)
        faults.append("b" if not core else "d" if (role, text) in seen else "t" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @cache
    def best(i, state, inserted):
        """(cost, audit, lines) of the least repair from here on."""
        found = []
        if i == len(rows) and state in (0, 3):
            found.append((0, "", ()))
        want = "a" if state == 2 else "u"
        name = "assistant" if want == "a" else "user"

        def add(cost, letter, line, rest):
            if rest:
                found.append((cost + rest[0], letter + rest[1], ((line,) if line is not None else ()) + rest[2]))

        if inserted < 3:
            add(2, "I", f"{name}:", best(i, step[state][want], inserted + 1))
        if i < len(rows):
            _, role, text = rows[i]
            add(3, "D", None, best(i + 1, state, 0))
            if faults[i] not in ("b", "d"):
                extra = faults[i] == "t"
                if role[:1] in step[state]:
                    add(extra, "K", f"{role}:{text}", best(i + 1, step[state][role[:1]], 0))
                add(2 + extra, "R", f"{name}:{text}", best(i + 1, step[state][want], 0))
        return min(found, default=None, key=lambda f: f[:2])

    sys.setrecursionlimit(20_000)
    cost, audit, lines = best(0, 0, 0)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [(a[1][:1], b[1][:1]) for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(p not in (("s", "u"), ("u", "a"), ("a", "u")) for p in pairs), int(cost), audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain(rows):
    damaged = damaged_rows(rows)
    return sorted(((c, *repair(damaged[c])) for c in {r[0] for r in rows}), key=str)


def ours(df):
    return sorted(map(tuple, damage_and_repair(df).select(*COLUMNS).collect()), key=str)


def random_rows(seed, convs=80, longest=14):
    pick = random.Random(seed)
    return [(c, pick.choice([t, t, t, t, pick.randint(0, 30), None]), pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
             pick.choice(["One.", "One.", "two", "Three!", "", " \n", None, "ü日?", "end. \t"])) for c in range(convs) for t in range(pick.randint(1, longest))]


ODD = [(None, None, None, None), (None, 3, "user", "a."), (7, None, "u", "x."), (7, None, "u", "x."), (7, None, "u", "x."), (8, 5, "assistant", "z" * 80_000),
       (8, 5, "assistant", "z" * 80_000), (9, -4, "System", "S."), (9, 9, "sys", "S."), (10, 1, "tool", "."), (11, 0, "user", "")]


@pytest.mark.parametrize("rows", [random_rows(1), random_rows(2), ODD], ids=["some", "others", "odd"])
def test_against_a_plain_search(spark, rows):
    assert ours(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_the_whole_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert ours(df) == plain([tuple(r) for r in df.collect()])


def test_lost_conversations_stay_in_the_result(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = ours(spark.createDataFrame([(lost, 0, "user", "a.")], SCHEMA))
    assert got == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_blocks_of_long_conversations_are_chained(spark):
    """Conversations that lie in several partitions, and so in several blocks."""
    rows = [r for r in random_rows(3, 6, 14)] + [(500 + c, t, r, x) for c in range(3) for t, (_, _, r, x) in enumerate(random_rows(4 + c, 30, 9))]
    want = plain(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ours(spark.createDataFrame(rows, SCHEMA).repartition(4)) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_blocks_inside_a_task(monkeypatch):
    """The packer cuts at the bound, and only whole conversations away from the edges are alone."""
    import pyarrow as pa

    monkeypatch.setattr(module, "BLOCK", 4)
    monkeypatch.setattr(module.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 3})()))
    names = ["a"] * 3 + ["b"] * 2 + ["c"] * 11 + ["d"] + ["e"] * 2
    batch = pa.RecordBatch.from_arrays(
        [pa.array(names), pa.array(range(len(names)), pa.int64()), pa.array([bytes([i]) * 16 for i in range(len(names))], pa.binary()),
         pa.array([2] * len(names), pa.int32()), pa.array([1] * len(names), pa.int64())], names=["c", "turn", "g", "code", "n"])
    for pieces in ([batch], [batch.slice(0, 4), batch.slice(4, 3), batch.slice(7, 8), batch.slice(15)]):
        blocks = [b for out in module._pack_blocks(iter(pieces)) for b in out.to_pylist()]
        assert [(b["c"], len(b["codes"]), b["alone"]) for b in blocks] == [
            ("a", 3, False), ("b", 2, True), ("c", 4, False), ("c", 4, False), ("c", 3, False), ("d", 1, True), ("e", 2, False)]
        assert [b["seq"] for b in blocks] == list(range(7)) and sum((b["turns"] for b in blocks), []) == list(range(len(names)))


def test_repeated_rows_are_counted_not_carried(spark):
    """A row that stands 30,000 times is one narrow row; its deletions are in the audit."""
    rows = spark.createDataFrame([("=1", 0, "user", "a."), ("=1", 2, "assistant", "b.")], "c string, turn long, role string, text string")
    many = spark.range(30_000).select(F.lit("=1").alias("c"), F.lit(1).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("q.").alias("text"))
    got = repair_conversations(rows.unionByName(many).withColumn("copies", F.lit(1))).collect()
    assert len(got) == 1 and (got[0].duplicate, got[0].illegal, got[0].cost) == (29_999, 30_000, 3 * 30_000 - 1)
    assert got[0].audit == "KIK" + "D" * 29_999 + "K"


def test_odd_tables(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    assert ours(df.limit(0)) == []
    clashing = df.withColumns({n: F.lit(7) for n in ("c", "g", "kind", "note", "copies", "number", "blank", "open", "code", "n", "cost", "audit", "part", "seq")})
    assert ours(clashing) == plain(ODD)
    words = spark.createDataFrame([("a", 0, "user", "x."), ("", 0, "user", "x.")], "conv_id string, turn long, role string, text string")
    assert {r.conv_id for r in damage_and_repair(words).collect()} == {"a", ""}
