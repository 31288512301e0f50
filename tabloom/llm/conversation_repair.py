"""Repair of damaged conversations: least-cost edits, and among them the least audit.

A repaired conversation's role initials are ``(s?(ua)+)?``. Four states say what
may follow: nothing yet, after the system turn, after a user, after an
assistant. Edits are Keep (0, or 1 for a truncated turn), Insert (2), Rerole (2,
and 1 if truncated) and Delete (3, the only one for blank and repeated turns).

1. Turns become narrow rows: digest, initial, faults. Equal rows of one turn
   number are counted, as all but the first of them are deleted.
2. Rows are range-partitioned in the order of the turns and packed into blocks
   of bounded size, so a conversation of any length lies in many tasks. A block
   maps costs behind it to costs before it by a 4 by 4 matrix over (min, +);
   only the few conversations with more than one block are chained by these.
3. In each block the cost DP leaves the optimal arcs. They are the nodes of the
   ranking: round k ranks the audits of length 2^k that begin with an arc by
   the pair (rank of its first half, rank of the half that its doubled pointer
   leads to). Edits that leave one state differ in their initial, so an arc has
   one least successor. The least arc of the start by the last ranks begins the
   least path, which the doubled pointers enumerate.
4. Edits meet the texts in one sorted exchange and are hashed as they stream by.
   A conversation's digest is sequential, so its texts pass one task in turn,
   one batch in memory.

Defined results: null ids, roles and texts are one space each in the checksum
and in what is repaired; a row without ``turn`` comes first; rows of one turn
are ordered by the digest of role and text. A null id is a conversation too. A
conversation that lost all its rows has zeros, an empty audit and the digest
of an empty text. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.llm.batches import SPACE, named, slices
from tabloom.session import broadcast_if_small, durable

# Rows of a block, and rows that are solved together.
BLOCK = 1 << 16
FAR = 1 << 40
EDITS = b"DIKR"
D, I, K, R = range(4)
# The state that an inserted or reroled turn leads to: user, or assistant after a user.
NEXT = np.array([2, 2, 3, 2])
INITIALS = "sua"


def damage(conversations: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(c, turn, role, text, copies)``: faults planted by checksum; 0 copies is a lost row. ``c`` is empty for a null id."""
    blank = F.lit(" ")
    id_, turn_ = named(id_column).cast("string"), named(turn).cast("long")
    number = F.crc32(F.concat(F.coalesce(id_, blank), F.lit(":"), F.coalesce(turn_.cast("string"), blank)).cast("binary")) % 20
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), id_), F.lit("")).alias("c"), turn_.alias("turn"),
        F.coalesce(named(role).cast("string"), blank).alias("role"), F.coalesce(named(text).cast("string"), blank).alias("text"),
        number.alias("number"))
    text_ = F.when(F.col("number") == 1, "").when(F.col("number") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role_ = F.when(F.col("number") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("number") == 0, 0).when(F.col("number") == 3, 2).otherwise(1)
    return rows.select("c", "turn", role_.alias("role"), text_.alias("text"), copies.alias("copies"))


def _keyed(damaged: DataFrame) -> DataFrame:
    """With the digest that names a turn's content, and its blank and truncated marks."""
    kept = F.rtrim(F.col("text"), F.lit(SPACE.decode()))
    digest = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    return damaged.withColumns({
        "g": digest, "blank": kept == "", "open": (kept != "") & ~F.right(kept, F.lit(1)).isin(".", "!", "?")})


BLOCKS = T.StructType([
    T.StructField("c", T.StringType()), T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()),
    T.StructField("alone", T.BooleanType()), T.StructField("turns", T.ArrayType(T.LongType())),
    T.StructField("digests", T.BinaryType()), T.StructField("codes", T.BinaryType()),
    T.StructField("extra", T.ArrayType(T.LongType()))])


def _pack_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of one conversation each; rows come sorted. ``alone``: the conversation has no other block."""
    part, seq = TaskContext.get().partitionId(), 0
    held: list[dict] = []
    # Whether the held conversation has, or may have, blocks before; the partition's last one may have some behind.
    edge = True

    def settle(blocks: list[dict], alone: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([b | {"alone": alone and len(blocks) == 1} for b in blocks], schema=_BLOCKS_ARROW)

    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero(names[1:] != names[:-1])[0] + 1).tolist(), len(names)]
        digests = batch.column(2).to_pylist()
        codes = batch.column(3).to_numpy().astype(np.uint8).tobytes()
        done = []
        for a, b in zip(cuts, cuts[1:]):
            name = names[a]
            if held and held[-1]["c"] != name:
                done.append(settle(held, not edge))
                held, edge = [], False
            while a < b:
                if not held or len(held[-1]["codes"]) >= BLOCK:
                    held.append({"c": name, "part": part, "seq": seq, "turns": [], "digests": b"", "codes": b"", "extra": []})
                    seq += 1
                last = held[-1]
                stop = min(b, a + BLOCK - len(last["codes"]))
                last["turns"] = last["turns"] + batch.column(1).slice(a, stop - a).to_pylist()
                last["extra"] = last["extra"] + (batch.column(4).slice(a, stop - a).to_numpy() - 1).tolist()
                last["digests"] += b"".join(digests[a:stop])
                last["codes"] += codes[a:stop]
                a = stop
            if len(held) > 1:
                # None of several blocks is alone, so all but the last may go.
                done.append(settle(held[:-1], False))
                held, edge = held[-1:], True
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
    if held:
        yield settle(held, False)


_BLOCKS_ARROW = pa.schema([
    ("c", pa.string()), ("part", pa.int64()), ("seq", pa.int64()), ("alone", pa.bool_()), ("turns", pa.list_(pa.int64())),
    ("digests", pa.binary()), ("codes", pa.binary()), ("extra", pa.list_(pa.int64()))])


class Rows:
    """The rows of some blocks, one after the other."""

    def __init__(self, batch: pa.RecordBatch):
        codes = batch.column("codes").to_pylist()
        self.codes = np.frombuffer(b"".join(codes), dtype=np.uint8).astype(np.int64)
        self.sizes = np.array(list(map(len, codes)), dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.extra = batch.column("extra").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        # A block has a state row before each of its rows and one behind the last.
        self.heads = self.starts + np.arange(len(self.sizes))
        self.nodes = np.arange(len(self.codes)) + np.repeat(np.arange(len(self.sizes)), self.sizes)


def _closed(cost: np.ndarray) -> np.ndarray:
    """Costs with turns inserted first; a whole round of insertions never pays."""
    user = np.minimum(cost[:, 2], cost[:, 3] + 2)
    answer = np.minimum(cost[:, 3], cost[:, 2] + 2)
    return np.stack([np.minimum(cost[:, 0], user + 2), np.minimum(cost[:, 1], user + 2), user, answer], axis=1)


def _choices(after: np.ndarray, code: np.ndarray) -> dict[int, np.ndarray]:
    """Cost of each edit that uses up a row, by the state before it."""
    initial, forced, cut = code & 3, (code >> 2 & 1).astype(bool), code >> 3 & 1
    onward = after[:, NEXT] + cut[:, None]
    kept = np.full(after.shape, FAR)
    kept[:, 0] = np.where(initial == 1, after[:, 1] + cut, FAR)
    for state in (0, 1, 3):
        kept[:, state] = np.where(initial == 2, onward[:, state], kept[:, state])
    kept[:, 2] = np.where(initial == 3, onward[:, 2], FAR)
    free = ~forced[:, None]
    return {D: after + 3, K: np.where(free, kept, FAR), R: np.where(free, onward + 2, FAR)}


def _costs(rows: Rows, behind: np.ndarray) -> np.ndarray:
    """Least cost from every state before every row; ``behind`` has that behind each block."""
    cost = np.empty((len(rows.codes) + len(rows.sizes), 4), dtype=np.int64)
    cost[rows.heads + rows.sizes] = behind
    order = np.argsort(-rows.sizes, kind="stable")
    reach = np.searchsorted(-rows.sizes[order], -np.arange(int(rows.sizes.max())), side="left")
    for at in range(int(rows.sizes.max()) - 1, -1, -1):
        some = order[:reach[at]]
        row, node = rows.starts[some] + at, rows.heads[some] + at
        choice = _choices(cost[node + 1], rows.codes[row])
        best = np.minimum(np.minimum(choice[D], choice[K]), choice[R])
        cost[node] = np.minimum(_closed(best) + 3 * rows.extra[row][:, None], FAR)
    return cost


FINAL = _closed(np.array([[0, FAR, FAR, 0]]))[0]


class Audits:
    """The least optimal path through every block, from its state of entry."""

    def __init__(self, rows: Rows, behind: np.ndarray, last: np.ndarray):
        self.rows, self.cost = rows, _costs(rows, behind)
        self._find_arcs(last)
        self._rank()

    def _find_arcs(self, last: np.ndarray) -> None:
        """Optimal arcs by the node they leave (state row * 4 + state), then by edit."""
        rows, node = self.rows, self.rows.nodes
        here = self.cost[node] - 3 * rows.extra[:, None]
        choice = _choices(self.cost[node + 1], rows.codes)
        found = []
        # A kept system turn, user and assistant lead to the states 1, 2 and 3, as their codes are.
        kept_to = rows.codes & 3
        for edit in (D, K, R):
            row, state = np.nonzero((choice[edit] == here) & (here < FAR))
            to = state if edit == D else kept_to[row] if edit == K else NEXT[state]
            found.append((node[row] * 4 + state, np.full(len(row), edit), (node[row] + 1) * 4 + to, row))
        row, state = np.nonzero((here[:, NEXT] + 2 == here) & (here < FAR))
        found.append((node[row] * 4 + state, np.full(len(row), I), node[row] * 4 + NEXT[state], np.full(len(row), -1)))
        # Behind a conversation's last row a user is inserted after a system turn, an assistant after a user.
        ends = (rows.heads + rows.sizes)[last]
        for state in (1, 2):
            found.append((ends * 4 + state, np.full(len(ends), I), ends * 4 + NEXT[state], np.full(len(ends), -1)))
        source, edit, target, row = (np.concatenate(v) for v in zip(*found))
        order = np.lexsort((edit, source))
        self.source, self.edit, self.target, self.row = source[order], edit[order], target[order], row[order]

    def _first(self, nodes: np.ndarray, order: np.ndarray) -> np.ndarray:
        """The first arc in ``order`` (sorted by source) that leaves each node; one past the last if none does."""
        sources = self.source[order]
        at = np.searchsorted(sources, nodes)
        none = (at == len(sources)) | (sources[np.minimum(at, len(sources) - 1)] != nodes)
        return np.where(none, len(sources), order[np.minimum(at, len(sources) - 1)])

    def _rank(self) -> None:
        n = len(self.source)
        rank = np.append(self.edit + 1, 0)
        pointer = np.append(self._first(self.target, np.arange(n)), n)
        self.pointers = [pointer]
        while (pointer != n).any():
            pair = rank * (int(rank.max()) + 1) + rank[pointer]
            rank = np.unique(pair, return_inverse=True)[1]
            pointer = pointer[pointer]
            self.pointers.append(pointer)
        self.order = np.lexsort((rank[:n], self.source))

    def entry(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First arc, length of the audit and last state of each block entered in its state."""
        first = self._first(self.rows.heads * 4 + states, self.order)
        at, length, none = first, np.ones(len(first), dtype=np.int64), len(self.source)
        for k in range(len(self.pointers) - 1, -1, -1):
            ahead = self.pointers[k][at]
            length += (ahead != none).astype(np.int64) << k
            at = np.where(ahead != none, ahead, at)
        return first, length, self.target[at] % 4

    def path(self, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The arcs of all paths one after the other, and the block of each."""
        block = np.repeat(np.arange(len(first)), length)
        step = np.arange(len(block)) - np.repeat(np.cumsum(length) - length, length)
        at = first[block]
        for k, pointer in enumerate(self.pointers):
            at = np.where(step >> k & 1, pointer[at], at)
        return at, block


def _solve(batches: Iterator[pa.RecordBatch], run) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            for part in slices(iter([batch]), batch.schema.get_field_index("codes"), BLOCK):
                yield run(part)


_LONGS = T.ArrayType(T.LongType())
MATRICES = T.StructType([T.StructField("c", T.StringType()), T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()),
                         T.StructField("values", _LONGS)])


def _place(batch: pa.RecordBatch) -> list[pa.Array]:
    return [batch.column(n) for n in ("c", "part", "seq")]


def _lists(values: np.ndarray) -> pa.Array:
    return pa.array(values.tolist(), pa.list_(pa.int64()))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost before the block by state of entry, for cost 0 in one state behind it."""

    def run(batch):
        rows = Rows(batch)
        columns = []
        for state in range(4):
            unit = np.full((len(rows.sizes), 4), FAR)
            unit[:, state] = 0
            columns.append(_costs(rows, unit)[rows.heads])
        return pa.RecordBatch.from_arrays([*_place(batch), _lists(np.stack(columns, axis=2).reshape(-1, 16))], names=MATRICES.names)

    return _solve(batches, run)


BEHIND = T.StructType([*MATRICES.fields[:3], T.StructField("last", T.BooleanType()), T.StructField("behind", _LONGS)])


def _chain_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cost behind every block; blocks of a conversation come from the last to the first."""
    name, cost = None, None
    for batch in batches:
        out, last = [], []
        for c, values in zip(batch.column("c").to_pylist(), batch.column("values").to_pylist()):
            last.append(c != name)
            if c != name:
                name, cost = c, FINAL
            out.append(cost.tolist())
            cost = np.minimum((np.array(values).reshape(4, 4) + cost).min(axis=1), FAR)
        yield pa.RecordBatch.from_arrays([*_place(batch), pa.array(last, pa.bool_()), pa.array(out, pa.list_(pa.int64()))], names=BEHIND.names)


def _behind(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Costs behind the blocks, and which blocks are a conversation's last; a block that is alone is."""
    behind, last = np.tile(FINAL, (n, 1)), np.ones(n, dtype=bool)
    for i, v in enumerate(batch.column("behind").to_pylist()):
        if v is not None:
            behind[i] = v
            last[i] = batch.column("last")[i].as_py()
    return behind, last


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which the least path leaves a block, for each state of entry."""

    def run(batch):
        rows = Rows(batch)
        audits = Audits(rows, *_behind(batch, len(rows.sizes)))
        out = np.stack([audits.entry(np.full(len(rows.sizes), state))[2] for state in range(4)], axis=1)
        return pa.RecordBatch.from_arrays([*_place(batch), _lists(out)], names=MATRICES.names)

    return _solve(batches, run)


ENTRIES = T.StructType([*MATRICES.fields[:3], T.StructField("entry", T.LongType())])


def _chain_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    name, state = None, 0
    for batch in batches:
        out = []
        for c, values in zip(batch.column("c").to_pylist(), batch.column("values").to_pylist()):
            if c != name:
                name, state = c, 0
            out.append(state)
            state = values[state]
        yield pa.RecordBatch.from_arrays([*_place(batch), pa.array(out, pa.int64())], names=ENTRIES.names)


# What streams into the end: a block's numbers, a row that stays, a text, turns inserted behind a block.
SUMMARY, STAYS, TEXT, BEHIND_ALL = range(4)
STREAM = T.StructType([
    T.StructField("c", T.StringType()), T.StructField("turn", T.LongType()), T.StructField("g", T.BinaryType()),
    T.StructField("kind", T.IntegerType()), T.StructField("note", T.StringType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("numbers", _LONGS)])
_STREAM_ARROW = pa.schema([
    ("c", pa.string()), ("turn", pa.int64()), ("g", pa.binary()), ("kind", pa.int32()), ("note", pa.string()), ("role", pa.string()),
    ("text", pa.string()), ("numbers", pa.list_(pa.int64()))])


def _decisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _solve(batches, _decide)


def _decide(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = Rows(batch)
    n = len(rows.sizes)
    audits = Audits(rows, *_behind(batch, n))
    entry = np.array([v or 0 for v in batch.column("entry").to_pylist()])
    first, length, leave = audits.entry(entry)
    arcs, block = audits.path(first, length)
    edit, row, state = audits.edit[arcs], audits.row[arcs], audits.source[arcs] % 4
    # An edit's initial, followed by the deletions of equal rows.
    more = np.where(row >= 0, rows.extra[np.maximum(row, 0)], 0)
    letters = np.repeat(edit, more + 1)
    heads = np.cumsum(more + 1) - more - 1
    deleted = np.ones(len(letters), dtype=bool)
    deleted[heads] = False
    letters = np.frombuffer(EDITS, dtype=np.uint8)[np.where(deleted, D, letters)].tobytes().decode()
    stops = np.cumsum(np.bincount(block, weights=more + 1, minlength=n).astype(np.int64))
    turns = batch.column("turns").flatten()
    digests = b"".join(batch.column("digests").to_pylist())
    names = batch.column("c").to_pylist()
    out: list[dict] = []

    def at(i):
        return {"turn": turns[i].as_py(), "g": digests[16 * i:16 * i + 16]}

    stay = np.nonzero((edit == K) | (edit == R))[0]
    before = {}
    behind = {}
    for i in np.nonzero(edit == I)[0].tolist():
        role = "a" if state[i] == 2 else "u"
        to = int(np.searchsorted(stay, i))
        if to < len(stay) and block[stay[to]] == block[i]:
            before[to] = before.get(to, "") + role
        else:
            behind[int(block[i])] = behind.get(int(block[i]), "") + role
    given = np.where(state == 2, "assistant", "user")
    for k, i in enumerate(stay.tolist()):
        out.append(at(int(row[i])) | {"c": names[block[i]], "kind": STAYS, "note": before.get(k, ""),
                                      "role": str(given[i]) if edit[i] == R else None})
    for b, roles in behind.items():
        out.append(at(int(rows.starts[b] + rows.sizes[b] - 1)) | {"c": names[b], "kind": BEHIND_ALL, "note": roles})
    cost = audits.cost[rows.heads, entry] - audits.cost[rows.heads + rows.sizes, leave]
    blank, forced, cut, initial = rows.codes >> 4 & 1, rows.codes >> 2 & 1, rows.codes >> 3 & 1, rows.codes & 3
    copies = rows.extra + 1
    repeated = np.where(blank == 1, 0, np.where(forced == 1, copies, rows.extra))
    legal = ((initial[:-1] == 1) & (initial[1:] == 2)) | ((initial[:-1] == 2) & (initial[1:] == 3)) | ((initial[:-1] == 3) & (initial[1:] == 2))
    breaks = rows.extra.copy()
    breaks[1:] += ~legal
    breaks[rows.starts] = rows.extra[rows.starts]
    numbers = turns.to_pylist()
    sums = [np.add.reduceat(v, rows.starts) for v in (np.where(blank == 1, copies, 0), repeated, np.where(forced == 0, cut, 0), breaks)]
    for b in range(n):
        a, z = int(rows.starts[b]), int(rows.starts[b] + rows.sizes[b])
        known = [t for t in numbers[a:z] if t is not None]
        out.append(at(a) | {
            "c": names[b], "kind": SUMMARY, "note": letters[(int(stops[b - 1]) if b else 0):int(stops[b])],
            "numbers": [known[0] if known else None, known[-1] if known else None, len(set(known)), *(int(s[b]) for s in sums),
                        int(initial[a]), int(initial[z - 1]), int(cost[b])]})
    return pa.RecordBatch.from_pylist(out, schema=_STREAM_ARROW)


RESULT = T.StructType([
    T.StructField("c", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
_LEGAL = {(1, 2), (2, 3), (3, 2)}


class _Conversation:
    """What is known of a conversation while its rows stream by."""

    def __init__(self, name: str):
        self.name, self.hash, self.lines = name, hashlib.sha256(), 0
        self.low = self.high = self.initial = self.due = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []

    def line(self, role: str, text: str = "") -> None:
        self.hash.update((b"\n" if self.lines else b"") + f"{role}:{text}".encode())
        self.lines += 1

    def inserted(self, initials: str) -> None:
        for initial in initials:
            self.line("user" if initial == "u" else "assistant")

    def take(self, turn, digest, kind, note, role, text, numbers) -> None:
        if kind == SUMMARY:
            low, high, turns, blank, duplicate, truncated, illegal, first, last, cost = numbers
            if low is not None:
                self.turns += turns - (low == self.high)
                self.low, self.high = low if self.low is None else self.low, high
            self.illegal += illegal + (self.initial is not None and (self.initial, first) not in _LEGAL)
            self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
            self.cost, self.initial = self.cost + cost, last
            self.audit.append(note)
        elif kind == STAYS:
            self.due = (turn, digest, note, role)
        elif kind == BEHIND_ALL:
            self.inserted(note)
        elif self.due is not None and text is not None and self.due[:2] == (turn, digest):
            self.inserted(self.due[2])
            self.line(role if self.due[3] is None else self.due[3], text)
            self.due = None

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.name, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit),
                self.hash.hexdigest())


def _results(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names=RESULT.names)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = None
    for batch in slices(batches, STREAM.names.index("text")):
        done = []
        for c, *rest in zip(*(column.to_pylist() for column in batch.columns)):
            if now is None or c != now.name:
                if now is not None:
                    done.append(now.result())
                now = _Conversation(c)
            now.take(*rest)
        yield _results(done)
    if now is not None:
        yield _results([now.result()])


def repair_conversations(damaged: DataFrame) -> DataFrame:
    """``(c, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of rows as ``damage`` gives them."""
    keyed = _keyed(damaged)
    initial = F.instr(F.lit(INITIALS), F.left(F.col("role"), F.lit(1)))
    initial = F.when(F.col("role") == "", 0).otherwise(initial)
    narrow = keyed.where("copies > 0").select("c", "turn", "g", initial.alias("initial"), "blank", "open", "copies")
    counted = narrow.groupBy("c", "turn", "g", "initial", "blank", "open").agg(F.sum("copies").alias("n"))
    counted = durable(counted, "turns")
    first = counted.groupBy(F.col("c").alias("fc"), F.col("g").alias("fg")).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count("*").alias("times"))
    # Only content that stands in two turns needs its first one looked up.
    first = first.where("times > 1")
    marked = counted.join(first, (F.col("c") == F.col("fc")) & (F.col("g") == F.col("fg")), "left")
    seen = F.coalesce(~F.col("turn").eqNullSafe(F.col("first.turn")) & F.col("first").isNotNull(), F.lit(False))
    code = F.col("initial") + 4 * (F.col("blank") | seen).cast("int") + 8 * F.col("open").cast("int") + 16 * F.col("blank").cast("int")
    order = ["c", F.col("turn").asc_nulls_first(), "g"]
    rows = marked.select("c", "turn", "g", code.alias("code"), "n").repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = durable(rows.mapInArrow(_pack_blocks, BLOCKS), "blocks")
    several = blocks.where("NOT alone")
    matrices = several.mapInArrow(_matrices, MATRICES).repartition("c").sortWithinPartitions("c", F.desc("part"), F.desc("seq"))
    behind = broadcast_if_small(durable(matrices.mapInArrow(_chain_costs, BEHIND), "behind")).drop("c")
    exits = several.join(behind, ["part", "seq"]).mapInArrow(_exits, MATRICES).repartition("c").sortWithinPartitions("c", "part", "seq")
    entries = broadcast_if_small(durable(exits.mapInArrow(_chain_states, ENTRIES), "entries")).drop("c")
    solved = blocks.join(behind, ["part", "seq"], "left").join(entries, ["part", "seq"], "left").mapInArrow(_decisions, STREAM)
    empty = (F.col("copies") == 0) | F.col("blank")
    texts = keyed.select(
        "c", "turn", "g", F.lit(TEXT).alias("kind"), F.lit(None).cast("string").alias("note"),
        F.when(~empty, F.col("role")).alias("role"), F.when(~empty, F.col("text")).alias("text"), F.lit(None).cast(_LONGS).alias("numbers"))
    stream = solved.unionByName(texts).repartition("c").sortWithinPartitions(*order, "kind")
    return stream.mapInArrow(_finish, RESULT)


def damage_and_repair(conversations: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role",
                      text: str = "text") -> DataFrame:
    """The numbers, the audit and the digest of the repaired text of every conversation after ``damage``."""
    found = repair_conversations(damage(conversations, id_column, turn, role, text))
    kind = conversations.schema[id_column].dataType
    id_ = F.when(F.col("c") != "", F.substring("c", 2, 1 << 30)).cast(kind)
    return found.select(id_.alias(id_column), *[c for c in found.columns if c != "c"])
