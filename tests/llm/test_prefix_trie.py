"""The trie of rebuilt conversations against plain Python that builds every prefix."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tabloom.llm import prefix_trie as module
from tabloom.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows, block=100, most=6):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len(r or '')}:{r or ''}{x or ''}".encode()).digest()
            turns[c].append((t is not None, t or 0, digest, r or "", x or ""))
    own = {c: [(r, x) for _, _, _, r, x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % most
        whole[c] = tuple(own.get(c - int(math.fmod(c, block)), [])[:h] + mine[h:])
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, convs in members.items():
        value = (len(convs) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += value
            leaves[node[:d]] += not children[node]
    return sorted((
        convs[0], len(node), members[node[:-1]][0] if node else -1, len(convs), children[node], leaves[node], saved[node],
        hashlib.sha256(",".join(str(c) for c in convs if whole[c] == node).encode()).hexdigest()) for node, convs in members.items())


def ours(df, **options):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in prefix_trie(df, **options).select(*columns).collect())


def rows_of(seed, convs, words="abc", longest=8):
    pick = random.Random(seed)
    return [(c, t if pick.random() < 0.9 else None, pick.choice(["user", "assistant", None]), pick.choice([*words, None, "", "ü日"]))
            for c in pick.sample(range(330), convs) for t in range(pick.randint(1, longest))]


ODD = [(0, 0, "user", "a"), (0, 0, "user", "a"), (0, None, "user", "b"), (1, 5, "", "x" * 50_000), (1, 5, None, "x" * 50_000), (2, None, None, None),
       (None, 1, "user", "a"), (307, 1, "u", "ser"), (308, 1, "us", "er"), (-5, 1, "user", "a"), (-105, 1, "user", "a"), (205, 3, "user", "a")]


@pytest.mark.parametrize("rows", [rows_of(1, 60), rows_of(2, 150, "a"), ODD], ids=["many", "alike", "odd"])
def test_against_plain_python(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert ours(df.repartition(5)) == plain(rows)


def test_pieces_of_long_conversations_are_joined(spark, monkeypatch):
    monkeypatch.setattr(module, "STRETCH", 16)
    rows = [(c, t, "user", f"{t % 7}" if c < 3 else "z") for c in (0, 1, 2, 100, 101, 102) for t in range(150)]
    rows += rows_of(3, 20, "z")
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ours(df) == plain(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_equal_fingerprints_of_unequal_sequences_are_noticed(spark, monkeypatch):
    known, asked = module.multipliers, []

    def weak(seed):
        asked.append(seed)
        return [1] * module.LANES if seed == 0 else known(seed)

    monkeypatch.setattr(module, "multipliers", weak)
    rows = [(c, t, "user", text) for c, words in ((1, "ab"), (2, "ba"), (3, "abc"), (4, "cab")) for t, text in enumerate(words)]
    assert ours(spark.createDataFrame(rows, SCHEMA), most=1) == plain(rows, most=1)
    assert asked == [0, 1]


def test_odd_tables(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    assert ours(df.limit(0)) == []
    clashing = df.withColumns({n: F.lit("7") for n in ("c", "d", "x", "y", "digest", "chars", "row", "part", "at", "depth", "n", "conv", "h", "m", "steps")})
    assert ours(clashing) == plain(ODD)
