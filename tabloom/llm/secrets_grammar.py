"""Secrets: fixed kinds, and formats inferred from them as probabilistic automata.

The fixed kinds (assign, access, hex) label credentials. Per kind, a bounded
sample of them (``Grammar.sample`` different shapes, those with the smallest
digests; of one longer than ``Grammar.head`` classes the head, known to go on
there) makes a prefix tree whose edges are character classes and whose
nodes count how often they are passed and how often a credential ends there.
States are merged in breadth-first order when their frequencies agree by the
Hoeffding bound, and so do those of all states behind them (ALERGIA); the
result is a probabilistic automaton that accepts formats, of any length, that
the sample supports.

Every run of at least 6 credential characters in every text is then a
candidate, without the full stops that end it. Its
score is the mean log-likelihood per character under the best automaton less
that under a background of class pairs, counted over all candidates outside
the fixed kinds in the whole corpus. Candidates over the threshold that
overlap no fixed span are added as ``format`` spans.

Defined results: a null or empty text has no spans. Without any labelled
credential nothing is added. Repeated rows give repeated results, an empty
table an empty one. Null ids are carried. Other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tabloom.llm.batches import map_texts, named, slices, texts
from tabloom.session import durable

# Kinds in the order of the result, and their patterns.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = (b"passw", b"secret", b"token", b"api")

# In the shape of a text: runs of the characters of an assigned credential, of its least length, less full stops at the end.
_CANDIDATE = re.compile(r"(?<![dhlHU+/_.=-])[dhlHU+/_.=-]{5,}[dhlHU+/_=-]")


@dataclass(frozen=True)
class Grammar:
    """``alpha``: of the Hoeffding bound; ``threshold``: nats per character above the background.

    ``sample`` shapes of ``head`` classes at most are what the driver sees of a kind, however long credentials are.
    """

    sample: int = 400
    head: int = 256
    alpha: float = 0.05
    threshold: float = 0.25
    floor: float = 1e-4


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(start, end, kind, credential)``, sorted by start, then kind."""
    out = []
    lower = text.encode().lower()
    if any(n in lower for n in _NAMES):
        out += [(m.start(), m.end(), 0, m[1]) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2, m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


# Classes of characters and how many characters each has; other signs are their own class.
_CLASSES = {**{c: "d" for c in "0123456789"}, **{c: "h" for c in "abcdef"}, **{c: "l" for c in "ghijklmnopqrstuvwxyz"},
            **{c: "H" for c in "ABCDEF"}, **{c: "U" for c in "GHIJKLMNOPQRSTUVWXYZ"}}
_TABLE = str.maketrans(_CLASSES)
_SIZES = {"d": 10, "h": 6, "l": 20, "H": 6, "U": 20}


# Behind the head of a shape that goes on; no credential has this character.
_GOES_ON = ">"


def shape(text: str) -> str:
    return text.translate(_TABLE)


def learned_shape(credential: str, head: int) -> str:
    return shape(credential) if len(credential) <= head else shape(credential[:head]) + _GOES_ON


def candidates(shaped: str, taken: list[tuple[int, int]]) -> list[str]:
    """Shapes of all runs in a shape of a text that overlap nothing ``taken``."""
    if not taken:
        return _CANDIDATE.findall(shaped)
    return [m[0] for m in _CANDIDATE.finditer(shaped) if not any(s < m.end() and m.start() < e for s, e in taken)]


@dataclass
class Automaton:
    """States with the counts of their edges and ends; state 0 is the start."""

    edges: list[dict[str, tuple[int, int]]] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)

    def likelihood(self, word: str, floor: float) -> float:
        """Log-likelihood of a shape and its end, characters of a class being equally likely."""
        state, total = 0, 0.0
        for c in word:
            edges = self.edges[state] if state is not None else {}
            passed = sum(n for _, n in edges.values()) + self.ends[state] if state is not None else 0
            target, n = edges.get(c, (None, 0))
            total += math.log(max(n / passed if passed else 0.0, floor)) - math.log(_SIZES.get(c, 1))
            state = target
        if state is None:
            return total + math.log(floor)
        passed = sum(n for _, n in self.edges[state].values()) + self.ends[state]
        return total + math.log(max(self.ends[state] / passed if passed else 0.0, floor))


def prefix_tree(shapes: list[str]) -> tuple[list[dict[str, int]], list[int], list[int]]:
    """Children, passes and ends of every node; a shape that goes on passes its last node without ending there."""
    children, passes, ends = [{}], [0], [0]
    for word in shapes:
        at = 0
        passes[0] += 1
        for c in word.removesuffix(_GOES_ON):
            if c not in children[at]:
                children[at][c] = len(children)
                children.append({})
                passes.append(0)
                ends.append(0)
            at = children[at][c]
            passes[at] += 1
        ends[at] += not word.endswith(_GOES_ON)
    return children, passes, ends


def infer(shapes: list[str], grammar: Grammar = Grammar()) -> Automaton:
    """Merge compatible states of the prefix tree, red states fixed and blue ones next, in breadth-first order."""
    children, passes, ends = prefix_tree(shapes)
    # Edge counts, kept apart from the targets as merging changes both.
    edge: list[dict[str, list[int]]] = [{c: [t, passes[t]] for c, t in below.items()} for below in children]
    bound = math.sqrt(0.5 * math.log(2 / grammar.alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2)) if n1 and n2 else False

    def passed(s: int) -> int:
        return ends[s] + sum(n for _, n in edge[s].values())

    def compatible(a: int, b: int) -> bool:
        waiting, seen = [(a, b)], set()
        while waiting:
            pair = waiting.pop()
            if pair in seen:
                continue
            seen.add(pair)
            x, y = pair
            nx, ny = passed(x), passed(y)
            if differ(ends[x], nx, ends[y], ny):
                return False
            for c in edge[x].keys() | edge[y].keys():
                tx, ty = edge[x].get(c, (None, 0)), edge[y].get(c, (None, 0))
                if differ(tx[1], nx, ty[1], ny):
                    return False
                if tx[0] is not None and ty[0] is not None:
                    waiting.append((tx[0], ty[0]))
        return True

    def fold(a: int, b: int) -> None:
        """Add the tree below ``b`` to the automaton at ``a``."""
        waiting = [(a, b)]
        while waiting:
            x, y = waiting.pop()
            ends[x] += ends[y]
            for c, (t, n) in edge[y].items():
                if c in edge[x]:
                    edge[x][c][1] += n
                    waiting.append((edge[x][c][0], t))
                else:
                    edge[x][c] = [t, n]

    red, blue = [0], deque((0, c) for c in sorted(edge[0]))
    fixed, queued = {0}, set(blue)
    while blue:
        parent, c = blue.popleft()
        queued.discard((parent, c))
        node = edge[parent][c][0]
        if node in fixed:
            continue
        for state in red:
            if compatible(state, node):
                edge[parent][c][0] = state
                fold(state, node)
                break
        else:
            red.append(node)
            fixed.add(node)
        for state in red:
            for d in sorted(edge[state]):
                if edge[state][d][0] not in fixed and (state, d) not in queued:
                    blue.append((state, d))
                    queued.add((state, d))
    number = {s: i for i, s in enumerate(red)}
    return Automaton([{c: (number[t], n) for c, (t, n) in edge[s].items()} for s in red], [ends[s] for s in red])


@dataclass(frozen=True)
class Formats:
    automata: dict[str, Automaton]
    pairs: dict[str, int]
    starts: dict[str, int]

    def background(self, word: str) -> float:
        total, before = 0.0, "^"
        kinds = len(self.starts) + 5
        for c in word + "$":
            total += math.log((self.pairs.get(before + c, 0) + 1) / (self.starts.get(before, 0) + kinds))
            total -= math.log(_SIZES.get(c, 1))
            before = c
        return total

    def score(self, word: str, floor: float) -> float:
        best = max((a.likelihood(word, floor) for a in self.automata.values()), default=-math.inf)
        return (best - self.background(word)) / (len(word) + 1)


def labelled_shapes(df: DataFrame, text: str, grammar: Grammar) -> DataFrame:
    """``(kind, word, n)``: learned shapes of credentials by kind, and pairs of classes in other candidates, for all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            found: Counter = Counter()
            words: Counter = Counter()
            for t in texts(part, 0):
                spans = base_spans(t)
                for _, _, kind, credential in spans:
                    found[KINDS[kind], learned_shape(credential, grammar.head)] += 1
                words.update(candidates(shape(t), [(a, b) for a, b, _, _ in spans]))
            for word, n in words.items():
                word = f"^{word}$"
                for i in range(len(word) - 1):
                    found["pair", word[i:i + 2]] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in found], pa.string()), pa.array([w for _, w in found], pa.string()),
                 pa.array(list(found.values()), pa.int64())], names=["kind", "word", "n"])

    rows = df.select(named(text).cast("string").alias("t"))
    return rows.mapInArrow(run, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def infer_formats(df: DataFrame, text: str = "text", grammar: Grammar = Grammar()) -> Formats:
    """One automaton per kind; the driver sees ``sample`` shapes of each kind and the pairs of classes."""
    counted = durable(labelled_shapes(df, text, grammar), "shapes")
    automata = {}
    for kind in KINDS:
        some = counted.where(F.col("kind") == kind).orderBy(F.md5("word"), "word").limit(grammar.sample).collect()
        if some:
            automata[kind] = infer([r["word"] for r in some], grammar)
    pairs = {r["word"]: r["n"] for r in counted.where("kind = 'pair'").collect()}
    starts: Counter = Counter()
    for pair, n in pairs.items():
        starts[pair[0]] += n
    return Formats(automata, pairs, dict(starts))


RESULT = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
       T.StructField("n_format", T.LongType())])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    kinds = (*KINDS, "format")
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, b, k in spans)


def find_secrets(df: DataFrame, carried: tuple[str, ...] = ("doc_id",), text: str = "text",
                 grammar: Grammar = Grammar()) -> DataFrame:
    """``carried`` columns, counts of the fixed kinds and their digest, and all ``spans`` (code points, end exclusive)."""
    formats = infer_formats(df, text, grammar)
    shared = df.sparkSession.sparkContext.broadcast(formats)

    def compute(batch: list[str]) -> list:
        known = shared.value
        counts, digests, spans, added = [[] for _ in KINDS], [], [], []
        rated: dict[str, bool] = {}
        for t in batch:
            base = [(a, b, k) for a, b, k, _ in base_spans(t)]
            more = []
            if known.automata:
                shaped = shape(t)
                new = set(_CANDIDATE.findall(shaped)) - rated.keys()
                rated.update((w, known.score(w, grammar.floor) >= grammar.threshold) for w in new)
                more = [(m.start(), m.end(), len(KINDS)) for m in _CANDIDATE.finditer(shaped)
                        if rated[m[0]] and not any(s < m.end() and m.start() < e for s, e, _ in base)]
            for k, out in enumerate(counts):
                out.append(sum(kind == k for _, _, kind in base))
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            spans.append(_joined(sorted(base + more, key=lambda s: (s[0], s[2]))))
            added.append(len(more))
        return [*counts, digests, spans, added]

    return map_texts(df, carried, text, RESULT, compute)
