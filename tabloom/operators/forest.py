"""Trees and forests grown to purity, the lower part of each node in one task.

MLlib runs a job per level of all trees, which makes deep trees cost a job per
level however few rows a node has left. Here only nodes of more than ``bound``
rows are split by jobs: every task adds up histograms of the node's candidate
thresholds, and the best sum wins. As soon as a node is small enough, its rows
go to one task, which grows everything below it at once, level by level, with
every possible threshold.

A tree's sample is drawn from a checksum of the row (Poisson, one draw for each
of its copies), equal rows are counted before, and rows are sorted by content
before anything is summed up; so the same seed gives the same trees however the
rows are partitioned. (Histograms are added in any order; their gains are
rounded to nine digits before they are compared.)

The model is a table with a row per finished node. Rows are scored where they
are if that table is small enough to be broadcast, else they are routed to the
table's rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tabloom.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Most rows of a node that one task finishes; of a regression more, unless they are wide, as its large nodes need few passes.
TASK_ROWS, REGRESSION_ROWS, REGRESSION_CELLS = 1 << 17, 1 << 20, 1 << 23
# Nodes split by one round of jobs, rows that propose their thresholds, thresholds per feature.
ROUND_NODES, PROPOSERS, THRESHOLDS = 1024, 256, 63
# Most values of a feature whose rows are added up by value, and of all such features together.
FEW, TOGETHER_FEW = 256, 1024
# Most rows of a node that is split together with others, rows of all those together, rows of a larger node's block.
MANY, SIDE_BY_SIDE, BLOCK = 2048, 1 << 15, 512
# Rows times trees, and rows, of one task's share; rows looked at together.
SHARE, SHARE_ROWS, TOGETHER = 1 << 20, 1 << 17, 1 << 16
# Most bytes of finished nodes that are broadcast for scoring.
MODEL_BYTES = 128 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit number for each one (splitmix64, Steele et al. 2014)."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64) + _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def _drawn(checks: np.ndarray, copies: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's sample has each row: a Poisson number with one as mean for each copy."""
    key = _mixed(checks.view(np.uint64) ^ _mixed(np.uint64(seed * 1_000_003 + tree)))
    out = np.zeros(len(checks), dtype=np.int64)
    few = copies <= 64
    for i in range(int(copies[few].max(initial=0))):
        some = few & (copies > i)
        out[some] += np.searchsorted(_POISSON, (_mixed(key[some] + np.uint64(i)) >> np.uint64(11)) * 2.0 ** -53, side="right")
    for i in np.nonzero(~few)[0]:
        out[i] = np.random.default_rng(int(key[i])).poisson(copies[i])
    return out


@dataclass(frozen=True)
class Growth:
    """``n_classes`` 0 is a regression, ``tried`` the features that each split chooses from."""

    trees: int
    n_classes: int
    width: int
    tried: int
    sampled: bool
    depth: int | None
    seed: int
    bound: int

    def weights(self, checks: np.ndarray, copies: np.ndarray, tree: int) -> np.ndarray:
        return _drawn(checks, copies, tree, self.seed) if self.sampled else copies

    def targets(self, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What is summed up of each row: its weight in its class, or its weighted target."""
        if self.n_classes:
            return (y.astype(np.int64)[:, None] == np.arange(self.n_classes)) * w[:, None].astype(float)
        return (w * y)[:, None]


def _allowed(valid: np.ndarray, ids: np.ndarray, tried: int) -> np.ndarray:
    """Of the features that can split a node, those that its draw lets it use."""
    if tried >= valid.shape[1]:
        return valid
    with np.errstate(over="ignore"):
        draw = _mixed(ids[:, None] + np.arange(1, valid.shape[1] + 1, dtype=np.uint64) * _GOLDEN)
    draw = np.where(valid, draw >> np.uint64(1), np.uint64(1 << 63))
    place = draw.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
    return valid & (place < tried)


@dataclass
class Nodes:
    """A tree as arrays; the right child follows the left one, a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int = 0

    def walk(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        moving = np.nonzero(self.feature[at] >= 0)[0]
        while len(moving):
            node = at[moving]
            right = x[moving, self.feature[node]] > self.threshold[node]
            at[moving] = self.left[node] + right
            moving = moving[self.feature[at[moving]] >= 0]
        return at


def _between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    middle = low + (high - low) / 2
    return np.where(middle < high, middle, low)


def _nearly(gain: np.ndarray) -> np.ndarray:
    """Gains that differ by rounding are equal: the first feature and the least threshold win."""
    return gain - 1e-9 * np.abs(gain)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)


def _order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows by content: by the first feature, and where that repeats by the others and the target."""
    if not x.shape[1]:
        return np.argsort(y, kind="stable")
    order = np.argsort(x[:, 0], kind="stable")
    same = np.diff(x[order, 0]) == 0
    tied = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    some = order[tied]
    order[tied] = some[np.lexsort((y[some], *x[some].T[::-1]))]
    return order


def _few(column: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """The values in order, and each row's number among them, if they are few; found without sorting the rows."""
    values = np.unique(column[:4096])
    if len(values) <= FEW and len(column):
        other = values[np.minimum(np.searchsorted(values, column), len(values) - 1)] != column
        if other.any():
            values = np.union1d(values, column[other])
    return (values, np.searchsorted(values, column)) if 0 < len(values) <= FEW else None


def _ranked(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _few(column) or np.unique(column, return_inverse=True)


def _joined(ranks: np.ndarray, coded: dict[int, int]) -> tuple[np.ndarray | None, dict[int, np.ndarray]]:
    """Each row's number among the values that all features of few values take together, and the codes by that number."""
    joint = None
    for j, n_values in coded.items():
        key = ranks[:, j] if joint is None else joint * n_values + ranks[:, j]
        there = np.bincount(key) > 0
        joint = (np.cumsum(there) - 1)[key]
        if np.count_nonzero(there) > TOGETHER_FEW:
            return None, {}
    if joint is None:
        return None, {}
    first = np.zeros(int(joint.max()) + 1, dtype=np.int64)
    first[joint] = np.arange(len(joint))
    return joint, {j: ranks[first, j] for j in coded}


def _squares(sums: list[np.ndarray]) -> np.ndarray:
    return sum(s * s for s in sums)


def _added(key: np.ndarray, size: int, w: np.ndarray, targets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Weights and targets by key; keys without a row are left out."""
    weight = np.bincount(key, weights=w, minlength=size)
    there = np.flatnonzero(weight)
    return there, weight[there], [np.bincount(key, weights=t, minlength=size)[there] for t in targets]


class Grower:
    """One task's rows, and the nodes found so far.

    The rows are kept in order of content, every value as its number among the
    values of its feature. A regression's nodes of more than ``MANY`` rows are
    split one by one, at a cost that goes with the smaller side: a long chain
    of uneven splits would else read the rows again for each of them. All
    others are split a level at a time.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, growth: Growth, depth: int | None):
        order = _order(x, y)
        self.growth, self.depth, self.width = growth, depth, x.shape[1]
        self.y, self.w = y[order], w[order].astype(float)
        self.shift = 0.0 if growth.n_classes else float((self.w * self.y).sum() / self.w.sum())
        self.targets = list(growth.targets(self.y - self.shift if not growth.n_classes else self.y, self.w).T.copy())
        self.values, self.ranks = [], np.empty((len(order), self.width), dtype=np.int32)
        for j in range(self.width):
            values, self.ranks[:, j] = _ranked(x[order, j])
            self.values.append(values)
        self.coded = {j: len(v) for j, v in enumerate(self.values) if len(v) <= FEW}
        self.joint, self.codes = _joined(self.ranks, self.coded)
        self.gains = np.zeros(self.width)
        self.total, self.found = 1, []

    def nodes(self) -> Nodes:
        number, level, *columns = (np.concatenate(v) for v in zip(*self.found))
        place = np.empty_like(number)
        place[number] = np.arange(len(number))
        return Nodes(*(c[place] for c in columns), int(level.max()))

    def grow(self, root: int) -> None:
        tops = [(np.arange(len(self.y)), 0, 0, np.uint64(root))]
        many = [j for j in range(self.width) if j not in self.coded]
        if many and not self.growth.n_classes:
            tops = self._split_large(tops, many)
        held, n = [], 0
        for top in tops:
            held.append(top)
            n += len(top[0])
            if n >= SIDE_BY_SIDE:
                self._split_levels(held)
                held, n = [], 0
        if held:
            self._split_levels(held)

    def _children(self, draw: np.ndarray) -> np.ndarray:
        """The draws of both children of each node, one after the other."""
        with np.errstate(over="ignore"):
            return _mixed(np.repeat(draw, 2) * np.uint64(2) + np.tile(np.array([0, 1], dtype=np.uint64), len(draw)))

    def _split_large(self, stack: list[tuple], many: list[int]) -> list[tuple]:
        """Split nodes of more than ``MANY`` rows; what is left are smaller ones."""
        small, lines = [], []
        positions = {j: np.empty(len(self.y), dtype=np.int32) for j in many}
        while stack:
            rows, number, level, draw = stack.pop()
            if len(rows) <= MANY:
                small.append((rows, number, level, draw))
                continue
            node = LargeNode(self, rows, many, positions)
            # The larger side stays in this node's sums until half of the rows are gone.
            while True:
                weight, total = node.sums()
                split = None
                if (self.depth is None or level < self.depth) and not node.pure():
                    split = node.best(weight, total, draw)
                feature, limit, gain = split[:3] if split else (-1, 0.0, 0.0)
                lines.append((number, level, feature, limit, self.total if split else -1, total / weight + self.shift))
                if not split:
                    break
                self.gains[feature] += max(gain, 0.0)
                out, side = node.part(feature, *split[3:])
                draws = self._children(np.array([draw])) if self.growth.tried < self.width else [draw, draw]
                level += 1
                stack.append((np.sort(out), self.total + side, level, draws[side]))
                node.remove(out)
                number, draw = self.total + 1 - side, draws[1 - side]
                self.total += 2
                if node.n <= max(MANY, node.built // 2):
                    stack.append((node.rows(), number, level, draw))
                    break
        if lines:
            number, level, feature, limit, left, value = zip(*lines)
            self.found.append((np.array(number), np.array(level), np.array(feature), np.array(limit), np.array(left), np.array(value)[:, None]))
        return small

    def _split_levels(self, tops: list[tuple]) -> None:
        """Whole subtrees, all nodes of a level at once.

        The rows are kept in order of node, then value, for every feature of
        many values; sums from the left of each node are differences of one
        running sum. Of a feature of few values the rows of a node are added up
        by value first, so that a level costs one pass over the rows for all
        such features.
        """
        growth, width, coded = self.growth, self.width, self.coded
        rows, number, depth, ids = zip(*tops)
        counts = np.array([len(r) for r in rows])
        rows, number, depth, ids = np.concatenate(rows), np.array(number), np.array(depth), np.array(ids, dtype=np.uint64)
        ranks, y, w, targets = self.ranks[rows], self.y[rows], self.w[rows], [t[rows] for t in self.targets]
        joint = self.joint[rows] if self.joint is not None else None
        columns = [np.ascontiguousarray(ranks[:, j]) for j in range(width)]
        # The first feature's order is the one in which a node's rows are summed up.
        sorted_rows = {0: np.arange(len(rows))}
        for j in range(1, width):
            if j not in coded:
                sorted_rows[j] = np.lexsort((columns[j], np.repeat(np.arange(len(counts)), counts)))
        while len(counts):
            nodes = len(counts)
            starts = np.cumsum(counts) - counts
            node = np.repeat(np.arange(nodes), counts)
            base = sorted_rows[0]
            w_base, t_base, y_base = w[base], [t[base] for t in targets], y[base]
            weight = np.add.reduceat(w_base, starts)
            sums = [np.add.reduceat(t, starts) for t in t_base]
            value = np.stack(sums, axis=1) / weight[:, None] + self.shift
            if growth.n_classes:
                pure = np.max(sums, axis=0) == weight
            else:
                pure = np.maximum.reduceat(y_base, starts) == np.minimum.reduceat(y_base, starts)
            here = _squares(sums) / weight
            score = np.full((nodes, width), -np.inf)
            # Between which two values a feature's cut lies.
            low, high = np.zeros((nodes, width), dtype=np.int64), np.zeros((nodes, width), dtype=np.int64)

            def best_cut(j, owner, at, w_at, t_at):
                """The best cut of every node between two of its values, from rows or sums in order of node, then value."""
                cut = np.flatnonzero((owner[1:] == owner[:-1]) & (at[1:] > at[:-1]))
                if not len(cut):
                    return
                begin = _runs(owner)
                by = owner[begin]
                before = np.zeros(nodes)
                owner_cut = owner[cut]

                def from_left(v):
                    added = np.cumsum(v)
                    before[by] = added[begin] - v[begin]
                    return added[cut] - before[owner_cut]

                left, part = from_left(w_at), [from_left(t) for t in t_at]
                rest = [s[owner_cut] - p for s, p in zip(sums, part)]
                gain = _squares(part) / left + _squares(rest) / (weight[owner_cut] - left)
                first = _runs(owner_cut)
                most = np.maximum.reduceat(gain, first)
                score[owner_cut[first], j] = most
                best = np.flatnonzero(gain >= np.repeat(_nearly(most), np.diff(first, append=len(cut))))
                at_cut = cut[best[_runs(owner_cut[best])]]
                low[owner[at_cut], j], high[owner[at_cut], j] = at[at_cut], at[at_cut + 1]

            if not pure.all():
                if pure.any():
                    open_ = ~pure[node]
                    open_node, base, w_base, t_base = node[open_], base[open_], w_base[open_], [t[open_] for t in t_base]
                else:
                    open_, open_node = slice(None), node
                # Of features with few values, sums by node and all their values together, if those are fewer than the rows.
                cells = None
                if coded:
                    size = int(joint.max()) + 1 if joint is not None else 0
                    if joint is not None and nodes * size <= 2 * len(base):
                        there, w_cell, t_cell = _added(open_node * size + joint[base], nodes * size, w_base, t_base)
                        cells = there // size, w_cell, t_cell, there % size
                    else:
                        cells = open_node, w_base, t_base, None
                for j in range(width):
                    if j not in coded:
                        by_value = sorted_rows[j][open_]
                        best_cut(j, open_node, columns[j][by_value], *((w_base, t_base) if j == 0 else (w[by_value], [t[by_value] for t in targets])))
                        continue
                    n_values = coded[j]
                    if n_values < 2:
                        continue
                    owner, w_cell, t_cell, place = cells
                    code = columns[j][base] if place is None else self.codes[j][place]
                    if n_values == 2:
                        # One cut: what lies beyond it is one sum for each node.
                        beyond = np.flatnonzero(code)
                        owner = owner[beyond]
                        right = np.bincount(owner, weights=w_cell[beyond], minlength=nodes)
                        rest = [np.bincount(owner, weights=t[beyond], minlength=nodes) for t in t_cell]
                        some = np.flatnonzero((right > 0) & (right < weight))
                        right, rest = right[some], [r[some] for r in rest]
                        part = [s[some] - r for s, r in zip(sums, rest)]
                        score[some, j] = _squares(part) / (weight[some] - right) + _squares(rest) / right
                        high[:, j] = 1
                        continue
                    key = owner * n_values + code
                    if nodes * n_values <= 4 * len(key):
                        there, w_cell, t_cell = _added(key, nodes * n_values, w_cell, t_cell)
                        best_cut(j, there // n_values, there % n_values, w_cell, t_cell)
                    else:
                        place = np.argsort(key, kind="stable")
                        best_cut(j, owner[place], key[place] % n_values, w_cell[place], [t[place] for t in t_cell])
            score[~_allowed(np.isfinite(score), ids, growth.tried)] = -np.inf
            chosen = (score >= _nearly(score.max(axis=1, keepdims=True))).argmax(axis=1) if width else np.zeros(nodes, dtype=int)
            lines = np.arange(nodes)
            split = ~pure & np.isfinite(score[lines, chosen]) if width else np.zeros(nodes, dtype=bool)
            if self.depth is not None:
                split &= depth < self.depth
            np.add.at(self.gains, chosen[split], np.maximum(score[lines, chosen] - here, 0.0)[split])
            child = np.cumsum(split) * 2 - 2
            limit, threshold = low[lines, chosen] if width else np.zeros(nodes), np.zeros(nodes)
            for j in np.unique(chosen[split]):
                some = np.flatnonzero(split & (chosen == j))
                threshold[some] = _between(self.values[j][low[some, j]], self.values[j][high[some, j]])
            self.found.append((number, depth, np.where(split, chosen, -1), threshold, np.where(split, self.total + child, -1), value))
            # The rows of nodes that were split move to their children, in the same order.
            next_counts = np.zeros(2 * int(split.sum()), dtype=np.int64)
            for j, by_value in sorted_rows.items():
                owner = node
                if not split.all():
                    stay = split[node]
                    by_value, owner = by_value[stay], node[stay]
                right = ranks.ravel()[by_value * width + chosen[owner]] > limit[owner]
                to = child[owner] + right
                if j == 0:
                    next_counts = np.bincount(to, minlength=len(next_counts))
                    next_starts = np.cumsum(next_counts) - next_counts
                out = np.empty_like(by_value)
                for side in (False, True):
                    # Rows of one child come in turn, so a running number starts where the child does.
                    some = np.flatnonzero(right == side)
                    where = to[some]
                    begin = _runs(where)
                    length = np.diff(begin, append=len(where))
                    out[np.arange(len(some)) + np.repeat(next_starts[where[begin]] - begin, length)] = by_value[some]
                sorted_rows[j] = out
            counts = next_counts
            number = self.total + np.arange(len(counts))
            depth = np.repeat(depth[split] + 1, 2)
            ids = self._children(ids[split])
            self.total += len(counts)


class SortedRows:
    """A large node's rows in order of one feature, their sums from the left kept by block.

    The sum over a row's left part is convex in both of its terms, so no cut of
    a block can be better than the corners of the parallelogram in which the
    block's running sums lie; only blocks that may hold the best cut are looked
    into.
    """

    def __init__(self, grower: Grower, rows: np.ndarray, j: int, position: np.ndarray):
        n, blocks = len(rows), -(-len(rows) // BLOCK)
        self.grower, self.position = grower, position
        at = grower.ranks[rows, j]
        if j:
            order = np.argsort(at, kind="stable")
            rows, at = rows[order], at[order]
        position[rows] = np.arange(n, dtype=np.int32)
        self.rows, self.at = np.zeros(blocks * BLOCK, dtype=np.int32), at
        self.rows[:n] = rows
        self.alive, self.edge = np.arange(blocks * BLOCK) < n, np.zeros(blocks * BLOCK, dtype=bool)
        self.edge[:n - 1] = at[1:] > at[:-1]
        self.low, self.high = 0, n
        # Running sums within the block; the block's own, and how far the others lie off the line between its ends.
        self.w, self.t = np.empty((blocks, BLOCK)), np.empty((blocks, BLOCK))
        self.block = np.empty((4, blocks))
        for begin in range(0, blocks, 64):
            self._add_up(np.arange(begin, min(begin + 64, blocks)))

    def _add_up(self, blocks: np.ndarray) -> None:
        rows, alive = self.rows.reshape(-1, BLOCK)[blocks], self.alive.reshape(-1, BLOCK)[blocks]
        w = np.cumsum(np.where(alive, self.grower.w[rows], 0.0), axis=1)
        t = np.cumsum(np.where(alive, self.grower.targets[0][rows], 0.0), axis=1)
        self.w[blocks], self.t[blocks] = w, t
        slope = np.divide(t[:, -1], w[:, -1], out=np.zeros(len(blocks)), where=w[:, -1] > 0)
        off = t - slope[:, None] * w
        self.block[:, blocks] = w[:, -1], t[:, -1], np.minimum(off.min(axis=1), 0.0), np.maximum(off.max(axis=1), 0.0)

    def remove(self, rows: np.ndarray) -> None:
        at = self.position[rows]
        self.alive[at] = False
        self._add_up(np.flatnonzero(np.bincount(at // BLOCK)))
        # The first and the last row left.
        self.low += int(self.alive[self.low:self.high].argmax())
        self.high -= int(self.alive[self.low:self.high][::-1].argmax())

    def best(self, weight: float, total: float) -> tuple[float, int]:
        """The greatest gain, and the first place that comes near it."""
        first, last = self.low // BLOCK, (self.high - 1) // BLOCK + 1
        w, t, least, most = self.block[:, first:last]
        w_end, t_end = np.cumsum(w), np.cumsum(t)
        w_begin, t_begin = w_end - w, t_end - t

        def gain(left, part):
            rest = total - part
            return part * part / left + rest * rest / (weight - left)

        with np.errstate(divide="ignore", invalid="ignore"):
            bound = np.maximum(np.maximum(gain(w_begin, t_begin + least), gain(w_begin, t_begin + most)),
                               np.maximum(gain(w_end, t_end + least), gain(w_end, t_end + most)))
        bound[~np.isfinite(bound)] = np.inf
        bound[(w_end <= 0) | (w_begin >= weight)] = -np.inf
        sure = np.isinf(bound)
        sure[np.where(sure, -np.inf, bound).argmax()] = True
        top, seen = -np.inf, []
        for wanted in (lambda: sure & (bound > -np.inf), lambda: ~sure & (bound >= top - 2e-9 * abs(top))):
            blocks = np.flatnonzero(wanted())
            if not len(blocks):
                continue
            inside = slice(first + blocks[0], first + blocks[-1] + 1) if blocks[-1] - blocks[0] + 1 == len(blocks) else first + blocks
            left = w_begin[blocks, None] + self.w[inside]
            place = np.flatnonzero(self.edge.reshape(-1, BLOCK)[inside] & (left > 0) & (left < weight))
            if len(place):
                got = gain(left.ravel()[place], (t_begin[blocks, None] + self.t[inside]).ravel()[place])
                seen.append((((first + blocks) * BLOCK)[place // BLOCK] + place % BLOCK, got))
                top = max(top, got.max())
        if not seen:
            return top, -1
        near = _nearly(np.float64(top))
        return top, min(int(at[got >= near].min()) for at, got in seen if (got >= near).any())

    def after(self, place: int) -> int:
        """The next row's place."""
        return place + 1 + int(self.alive[place + 1:self.high].argmax())


class LargeNode:
    """A regression's node of many rows, from which the smaller side of each split is taken out."""

    def __init__(self, grower: Grower, rows: np.ndarray, many: list[int], positions: dict[int, np.ndarray]):
        self.grower, self.n, self.built = grower, len(rows), len(rows)
        self.sorted = {j: SortedRows(grower, rows, j, positions[j]) for j in many}
        self.any = self.sorted[many[0]]
        self.coded = np.array(list(grower.coded), dtype=np.int64)
        sizes = np.array(list(grower.coded.values()), dtype=np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.sizes, self.feature = sizes, np.repeat(np.arange(len(sizes)), sizes)
        codes = grower.codes
        self.cells = np.stack([codes[j] for j in self.coded], axis=1) + self.starts if codes else None
        self.by_value = sum((self._by_value(rows[i:i + (1 << 16)]) for i in range(0, len(rows), 1 << 16)), np.zeros((2, sizes.sum())))

    def _by_value(self, rows: np.ndarray) -> np.ndarray:
        """Weights and targets by value, of all features of few values."""
        n = len(self.feature)
        if not n:
            return np.zeros((2, 0))
        ranks, sums = self.grower.ranks, [v[rows] for v in (self.grower.w, self.grower.targets[0])]
        if self.cells is not None and len(rows) > len(self.cells):
            # First by all their values together.
            joint = self.grower.joint[rows]
            sums = [np.bincount(joint, weights=v, minlength=len(self.cells)) for v in sums]
            at = self.cells
        else:
            at = (ranks[rows][:, self.coded] + self.starts).ravel()
        return np.stack([np.bincount(at.ravel(), weights=np.repeat(v, len(self.starts)), minlength=n) for v in sums])

    def sums(self) -> tuple[float, float]:
        return tuple(self.any.block[:2].sum(axis=1).tolist())

    def rows(self) -> np.ndarray:
        one = self.any
        return np.sort(one.rows[one.low:one.high][one.alive[one.low:one.high]])

    def pure(self) -> bool:
        """Whether all targets are equal; the first block nearly always says no."""
        one = self.any
        for begin, end in ((one.low, min(one.high, one.low + BLOCK)), (one.low, one.high)):
            y = self.grower.y[one.rows[begin:end][one.alive[begin:end]]]
            if y.max() > y.min():
                return False
        return True

    def best(self, weight: float, total: float, draw: np.uint64) -> tuple | None:
        """``(feature, threshold, gain, place or value after which the right side begins)``."""
        width = self.grower.width
        score, place = np.full(width, -np.inf), np.full(width, -1)
        for j, some in self.sorted.items():
            score[j], place[j] = some.best(weight, total)
        if len(self.coded):
            w, t = self.by_value
            left, part = (np.cumsum(v) for v in (w, t))
            left, part = (v - (v[self.starts] - own[self.starts])[self.feature] for v, own in ((left, w), (part, t)))
            cut = np.flatnonzero((w > 0) & (left < weight))
            if len(cut):
                gain = np.full(len(w), -np.inf)
                rest = total - part[cut]
                gain[cut] = part[cut] ** 2 / left[cut] + rest ** 2 / (weight - left[cut])
                score[self.coded] = most = np.maximum.reduceat(gain, self.starts)
                near = np.flatnonzero(gain >= np.where(np.isfinite(most), _nearly(most), np.inf)[self.feature])
                first = near[_runs(self.feature[near])]
                place[self.coded[self.feature[first]]] = first - self.starts[self.feature[first]]
        score[~_allowed(np.isfinite(score)[None, :], np.array([draw]), self.grower.growth.tried)[0]] = -np.inf
        j = int((score >= _nearly(score.max())).argmax())
        if not np.isfinite(score[j]):
            return None
        at, values = int(place[j]), self.grower.values[j]
        if j in self.sorted:
            low, high = self.sorted[j].at[at], self.sorted[j].at[self.sorted[j].after(at)]
        else:
            begin = self.starts[int(np.flatnonzero(self.coded == j)[0])]
            low, high = at, at + 1 + int((self.by_value[0, begin + at + 1:] > 0).argmax())
        return j, float(_between(values[low], values[high])), score[j] - total * total / weight, at

    def part(self, feature: int, at: int) -> tuple[np.ndarray, int]:
        """The rows of the smaller side, and whether that is the right one."""
        one = self.sorted.get(feature, self.any)
        if feature in self.sorted:
            middle = at + 1
            left = np.count_nonzero(one.alive[one.low:middle])
            side = int(2 * left > self.n)
            begin, end = (middle, one.high) if side else (one.low, middle)
            return one.rows[begin:end][one.alive[begin:end]], side
        rows = one.rows[one.low:one.high][one.alive[one.low:one.high]]
        right = self.grower.ranks[rows, feature] > at
        side = int(2 * np.count_nonzero(right) <= self.n)
        return rows[right == bool(side)], side

    def remove(self, rows: np.ndarray) -> None:
        for some in self.sorted.values():
            some.remove(rows)
        for begin in range(0, len(rows), 1 << 16):
            self.by_value -= self._by_value(rows[begin:begin + (1 << 16)])
        self.n -= len(rows)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, growth: Growth, root: int, depth: int | None) -> tuple[Nodes, np.ndarray]:
    """A whole tree, and each feature's total gain."""
    grower = Grower(x, y, w, growth, depth)
    grower.grow(root)
    return grower.nodes(), grower.gains


@dataclass
class Top:
    """The upper parts of all trees, whose leaves are finished in tasks; a node has a number of its own."""

    trees: list[list[tuple]] = field(default_factory=list)

    @classmethod
    def roots(cls, growth: Growth) -> Top:
        # (feature, threshold, left child, draw, depth)
        return cls([[(-1, 0.0, -1, int(_mixed(np.uint64(growth.seed * 7_919 + t))), 0)] for t in range(growth.trees)])

    def nodes(self, tree: int) -> Nodes:
        rows = self.trees[tree]
        return Nodes(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.zeros(0))

    def open(self, closed: set[tuple[int, int]]) -> list[tuple[int, int]]:
        """The leaves that tasks finish."""
        return [(t, i) for t, rows in enumerate(self.trees) for i, node in enumerate(rows) if node[0] < 0 and (t, i) not in closed]

    def split(self, tree: int, node: int, feature: int, threshold: float) -> None:
        rows = self.trees[tree]
        _, _, _, draw, depth = rows[node]
        rows[node] = (feature, threshold, len(rows), draw, depth)
        for side in (0, 1):
            rows.append((-1, 0.0, -1, int(_mixed(np.array([draw * 2 + side & (1 << 64) - 1], dtype=np.uint64))[0]), depth + 1))


def _matrix(batch, column: str, width: int) -> np.ndarray:
    lists = batch.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Small batches joined, so that fewer partial results are made."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= TOGETHER:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Packer:
    """Rows as bytes: of features of few values the values once and a byte for each row."""

    def __init__(self, x: np.ndarray):
        self.width = x.shape[1]
        ranked = [_few(x[:, j]) for j in range(self.width)]
        sizes = np.array([len(r[0]) if r else 0 for r in ranked], dtype=np.int32)
        self.head = sizes.tobytes() + b"".join(r[0].astype(float).tobytes() for r in ranked if r)
        self.plain = np.stack([x[:, j] for j in range(self.width) if not sizes[j]]) if not sizes.all() else np.zeros((0, len(x)))
        self.codes = np.stack([r[1].astype(np.uint8) for r in ranked if r]) if sizes.any() else np.zeros((0, len(x)), dtype=np.uint8)

    def pack(self, rows: np.ndarray) -> bytes:
        return self.head + self.plain[:, rows].tobytes() + self.codes[:, rows].tobytes()


def _unpack_rows(column, width: int) -> np.ndarray:
    """The rows of several records, kept column by column."""
    parts = []
    for packed in column.to_pylist():
        sizes = np.frombuffer(packed, dtype=np.int32, count=width)
        at = 4 * width
        values = np.split(np.frombuffer(packed, dtype=float, count=int(sizes.sum()), offset=at), np.cumsum(sizes)[:-1])
        at += 8 * int(sizes.sum())
        plain = int(np.count_nonzero(sizes == 0))
        n = (len(packed) - at) // max(1, 8 * plain + width - plain)
        parts.append((n, sizes, values, iter(np.frombuffer(packed, dtype=float, count=plain * n, offset=at).reshape(plain, n)),
                      iter(np.frombuffer(packed, dtype=np.uint8, offset=at + 8 * plain * n).reshape(width - plain, n))))
    x, begin = np.empty((width, sum(p[0] for p in parts))), 0
    for n, sizes, values, plain, codes in parts:
        for j in range(width):
            x[j, begin:begin + n] = values[j][next(codes)] if sizes[j] else next(plain)
        begin += n
    return x.T


def _shares(n_rows: int, trees: int) -> int:
    """Tasks among which rows are dealt, by the work on them."""
    return max(1, -(-n_rows // SHARE_ROWS), min(-(-n_rows * trees // SHARE), n_rows // 4096))


def _per_leaf(rows: DataFrame, top: Top, growth: Growth, make, schema: str) -> DataFrame:
    """``make(tree, leaf of each row, x, y, weight, check)`` for some rows and each tree, on those that the tree's sample has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = [top.nodes(t) for t in range(growth.trees)]
        for batch in _together(batches):
            x = _matrix(batch, "x", growth.width)
            y, n, check = (batch.column(c).to_numpy() for c in ("y", "n", "h"))
            for t in range(growth.trees):
                w = growth.weights(check, n, t)
                has = np.nonzero(w > 0)[0]
                if len(has):
                    out = make(t, walks[t].walk(x[has]), x[has], y[has], w[has], check[has])
                    if out is not None:
                        yield out

    return rows.mapInArrow(run, schema)


def _by_leaf(leaf: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Each leaf with its part of every column."""
    order = np.argsort(leaf, kind="stable")
    begin = _runs(leaf[order])
    for one, some in zip(leaf[order[begin]].tolist(), np.split(order, begin[1:])):
        yield one, *(c[some] for c in columns)


def _spread(spark: SparkSession, n_nodes: int) -> int:
    """Partitions among which nodes are dealt."""
    cores = max(1, spark.sparkContext.defaultParallelism)
    return max(1, min(n_nodes, 16 * cores))


def _slots(spark: SparkSession, nodes: list[tuple[int, int]]) -> tuple[dict[tuple[int, int], int], int]:
    """A number for each node such that as many lie in every partition, and the partitions.

    Nodes dealt by the hash of their own numbers would leave some tasks idle while others grow several trees.
    """
    spread = _spread(spark, len(nodes))
    each = -(-len(nodes) // spread)
    tried = spark.range(8 * spread * (each + 2), numPartitions=1).select("id", F.pmod(F.hash("id"), F.lit(spread)).alias("part"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    found = tried.withColumn("place", place).orderBy("place", "part").limit(len(nodes)).collect()
    return {node: r["id"] for node, r in zip(nodes, found)}, spread


def _routed(rows: DataFrame, top: Top, growth: Growth, closed: set[tuple[int, int]]) -> DataFrame:
    """The rows of the nodes that tasks finish, those of a node and batch packed into one record."""
    shut = [np.array(sorted(leaf for t, leaf in closed if t == tree)) for tree in range(growth.trees)]
    slots, spread = _slots(rows.sparkSession, top.open(closed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = [top.nodes(t) for t in range(growth.trees)]
        for batch in _together(batches):
            x = _matrix(batch, "x", growth.width)
            y, n, check = (batch.column(c).to_numpy() for c in ("y", "n", "h"))
            packer = Packer(x)
            for t in range(growth.trees):
                w = growth.weights(check, n, t)
                has = np.flatnonzero(w > 0)
                leaf = walks[t].walk(x[has]) if len(walks[t].feature) > 1 else np.zeros(len(has), dtype=np.int64)
                if len(shut[t]):
                    keep = ~np.isin(leaf, shut[t])
                    has, leaf = has[keep], leaf[keep]
                if not len(has):
                    continue
                parts = list(_by_leaf(leaf, has))
                weights = [w[some] for _, some in parts]
                packed = [[packer.pack(some) for _, some in parts], [y[some].tobytes() for _, some in parts],
                          [v.astype(np.uint8 if v.max() < 256 else np.int64).tobytes() for v in weights]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slots[t, one] for one, _ in parts], pa.int64()), pa.array(np.full(len(parts), t)),
                     pa.array([one for one, _ in parts], pa.int64()), *(pa.array(p, pa.binary()) for p in packed)],
                    names=["slot", "tree", "leaf", "x", "y", "w"])

    # A given number of partitions is not merged again, so the nodes are finished side by side.
    return rows.mapInArrow(run, "slot long, tree long, leaf long, x binary, y binary, w binary").repartition(spread, "slot")


def _unpack_weights(w, y) -> np.ndarray:
    """Weights of a byte where those of a record are small, told by the targets beside them."""
    return np.concatenate([np.frombuffer(a, dtype=np.uint8 if len(a) * 8 == len(b) else np.int64).astype(np.int64)
                           for a, b in zip(w.to_pylist(), y.to_pylist())])


def _unpack(column, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def _large(rows: DataFrame, top: Top, growth: Growth, most: int | None) -> list:
    """Nodes of more than ``bound`` rows, largest first, with the ranges of the features that vary in them."""

    def count(t, leaf, x, y, w, check):
        leaves, inverse = np.unique(leaf, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        starts = np.searchsorted(inverse[order], np.arange(len(leaves)))
        low, high = np.minimum.reduceat(x[order], starts, axis=0), np.maximum.reduceat(x[order], starts, axis=0)
        k = growth.width
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(leaves) * k, t)), pa.array(np.repeat(leaves, k)), pa.array(np.tile(np.arange(k), len(leaves))),
             pa.array(np.repeat(np.bincount(inverse), k)), pa.array(low.ravel()), pa.array(high.ravel())],
            names=["tree", "leaf", "feature", "n", "low", "high"])

    counted = _per_leaf(rows, top, growth, count, "tree long, leaf long, feature long, n long, low double, high double")
    ranges = counted.groupBy("tree", "leaf", "feature").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    varies = F.collect_list(F.when(F.col("low") < F.col("high"), F.struct("feature", "low", "high")))
    nodes = ranges.groupBy("tree", "leaf").agg(F.max("n").alias("n"), varies.alias("varies")).where(F.col("n") > growth.bound)
    if growth.depth is not None:
        deep = [(t, i) for t, tree in enumerate(top.trees) for i, node in enumerate(tree) if node[4] >= growth.depth]
        nodes = nodes.withColumn("varies", F.when(F.struct("tree", "leaf").isin(
            [F.struct(F.lit(t).cast("long"), F.lit(i).cast("long")) for t, i in deep]), F.array()).otherwise(F.col("varies"))) if deep else nodes
    nodes = nodes.orderBy(F.desc("n"), "tree", "leaf")
    return (nodes.where(F.size("varies") > 0).limit(most) if most else nodes).collect()


def _grow_top(rows: DataFrame, growth: Growth) -> tuple[Top, np.ndarray, set[tuple[int, int]]]:
    """Split every node of more than ``bound`` rows; those whose rows are alike, or at the depth, are closed."""
    top, gains = Top.roots(growth), np.zeros(growth.width)
    while large := _large(rows, top, growth, ROUND_NODES):
        splits = _best_splits(rows, top, growth, large)
        if not splits:
            break
        for t, leaf, feature, threshold, gain in splits:
            top.split(t, leaf, feature, threshold)
            gains[feature] += max(gain, 0.0)
    return top, gains, {(r["tree"], r["leaf"]) for r in _large(rows, top, growth, None)}


def _best_splits(rows: DataFrame, top: Top, growth: Growth, found: list) -> list[tuple]:
    """The best of the proposed thresholds of each node, by histograms of all its rows."""
    large = [(r["tree"], r["leaf"]) for r in found]
    number = {key: i for i, key in enumerate(large)}
    width = growth.width
    numbered = [np.full(len(tree), -1) for tree in top.trees]
    for (t, leaf), i in number.items():
        numbered[t][leaf] = i

    def numbers(t, leaf):
        return numbered[t][leaf]

    # Twice as many rows of a node as are wanted are expected to have checksums below this.
    ceiling = np.array([(min(1.0, 2 * (PROPOSERS + 64) / r["n"]) - 0.5) * 2.0 ** 64 for r in found])

    def propose(t, leaf, x, y, w, check, every=False):
        at = numbers(t, leaf)
        keep = np.nonzero((at >= 0) & (every | (check < ceiling[at])))[0]
        # The least checksums of a batch hold those of the table.
        order = keep[np.lexsort((check[keep], at[keep]))]
        place = np.arange(len(order)) - np.searchsorted(at[order], at[order])
        order = order[place < PROPOSERS]
        ends = np.arange(len(order) + 1, dtype=np.int32) * width
        return pa.RecordBatch.from_arrays(
            [pa.array(at[order]), pa.array(check[order]), pa.ListArray.from_arrays(pa.array(ends), pa.array(x[order].ravel()))],
            names=["node", "h", "x"])

    # At most ``PROPOSERS`` rows of each of at most ``ROUND_NODES`` nodes.
    first = Window.partitionBy("node").orderBy("h", "x")

    def proposals(make):
        made = _per_leaf(rows, top, growth, make, "node long, h long, x array<double>")
        return made.withColumn("place", F.row_number().over(first)).where(F.col("place") <= PROPOSERS).toPandas()

    proposed = proposals(propose)
    if (np.bincount(proposed["node"], minlength=len(large)) < [min(PROPOSERS, r["n"]) for r in found]).any():
        proposed = proposals(lambda *some: propose(*some, every=True))
    edges = {(i, j): np.zeros(0) for i in range(len(large)) for j in range(width)}
    for node, part in proposed.groupby("node"):
        values = np.stack(part["x"].to_numpy())
        for varies in found[int(node)]["varies"]:
            # The middle of the range splits the node even if all the proposers are alike.
            j, middle = varies["feature"], _between(np.array([varies["low"]]), np.array([varies["high"]]))
            seen = np.unique(values[:, j])
            cuts = _between(seen[:-1], seen[1:])
            cuts = cuts[np.linspace(0, len(cuts) - 1, min(THRESHOLDS, len(cuts))).astype(int)]
            edges[int(node), j] = np.unique(np.concatenate([cuts, middle]))

    def histogram(t, leaf, x, y, w, check):
        at = numbers(t, leaf)
        out = []
        for node in np.unique(at[at >= 0]):
            here = np.nonzero(at == node)[0]
            targets = growth.targets(y[here], w[here])
            for j in range(width):
                cuts = edges[int(node), j]
                if len(cuts):
                    place = np.searchsorted(cuts, x[here, j], side="left")
                    bins = len(cuts) + 1
                    weight = np.bincount(place, weights=w[here], minlength=bins)
                    for k in range(targets.shape[1]):
                        sums = np.bincount(place, weights=targets[:, k], minlength=bins)
                        out.append((node, j, k, bins, weight, sums))
        if not out:
            return None
        sizes = np.array([o[3] for o in out])
        columns = [np.repeat([o[i] for o in out], sizes) for i in range(3)]
        return pa.RecordBatch.from_arrays(
            [*map(pa.array, columns), pa.array(np.concatenate([np.arange(s) for s in sizes])),
             pa.array(np.concatenate([o[4] for o in out])), pa.array(np.concatenate([o[5] for o in out]))],
            names=["node", "feature", "k", "bin", "w", "s"])

    summed = _per_leaf(rows, top, growth, histogram, "node long, feature long, k long, bin long, w double, s double")
    summed = summed.groupBy("node", "feature", "k", "bin").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    draws = {i: top.trees[t][leaf][3] for (t, leaf), i in number.items()}

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        node = int(part["node"].iloc[0])
        score, place = np.full(width, -np.inf), np.zeros(width, dtype=int)
        base = 0.0
        for j, some in part.groupby("feature"):
            some = some.sort_values(["k", "bin"])
            kinds = int(some["k"].max()) + 1
            bins = len(edges[node, int(j)]) + 1
            weight, sums = np.zeros(bins), np.zeros((bins, kinds))
            weight[some["bin"]] = some["w"]
            sums[some["bin"], some["k"]] = some["s"]
            left, part_sums = weight.cumsum()[:-1], sums.cumsum(axis=0)[:-1]
            whole, all_sums = weight.sum(), sums.sum(axis=0)
            base = float((all_sums ** 2).sum() / whole)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = (part_sums ** 2).sum(axis=1) / left + ((all_sums - part_sums) ** 2).sum(axis=1) / (whole - left)
            gain = np.where((left > 0) & (left < whole), gain, -np.inf)
            if np.isfinite(gain).any():
                rounded = np.array([float(f"{g:.9g}") for g in gain])
                place[j], score[j] = int(rounded.argmax()), rounded.max()
        ok = _allowed(np.isfinite(score)[None, :], np.array([draws[node]], dtype=np.uint64), growth.tried)[0]
        score[~ok] = -np.inf
        j = int(score.argmax())
        if not np.isfinite(score[j]):
            return pd.DataFrame({"node": [], "feature": [], "threshold": [], "gain": []})
        return pd.DataFrame({"node": [node], "feature": [j], "threshold": [edges[node, j][place[j]]], "gain": [score[j] - base]})

    # A given number of partitions is not merged again.
    spread = min(len(large), 4 * max(1, rows.sparkSession.sparkContext.defaultParallelism))
    chosen = summed.repartition(spread, "node").groupBy("node").applyInPandas(choose, "node long, feature long, threshold double, gain double")
    return [(*large[r["node"]], int(r["feature"]), float(r["threshold"]), float(r["gain"])) for r in chosen.orderBy("node").collect()]


# The nodes' arrays are packed: thresholds and left children of the inner nodes, values of the leaves.
FINISHED = ("tree long, leaf long, depth long, bytes long, gains array<double>, feature binary, threshold binary, "
            "left binary, value binary")
_FINISHED = pa.schema([("tree", pa.int64()), ("leaf", pa.int64()), ("depth", pa.int64()), ("bytes", pa.int64()),
                       ("gains", pa.list_(pa.float64())), *((n, pa.binary()) for n in ("feature", "threshold", "left", "value"))])


def _packed(nodes: Nodes, width: int) -> dict[str, list[bytes]]:
    inner = nodes.feature >= 0
    return {"feature": [nodes.feature.astype(_feature_type(width)).tobytes()], "threshold": [nodes.threshold[inner].astype(float).tobytes()],
            "left": [nodes.left[inner].astype(np.int32).tobytes()], "value": [nodes.value[~inner].astype(float).tobytes()]}


def _feature_type(width: int) -> type:
    return np.int8 if width <= 127 else np.int32


def _finish(routed: DataFrame, top: Top, growth: Growth) -> DataFrame:
    """One row per finished node."""

    def run(key, table):
        t, leaf = table.column("tree")[0].as_py(), table.column("leaf")[0].as_py()
        _, _, _, draw, depth = top.trees[t][leaf]
        x = _unpack_rows(table.column("x"), growth.width)
        y, w = _unpack(table.column("y"), float), _unpack_weights(table.column("w"), table.column("y"))
        nodes, gains = grow(x, y, w, growth, draw, None if growth.depth is None else growth.depth - depth)
        size = sum(a.nbytes for a in (nodes.feature, nodes.threshold, nodes.left, nodes.value))
        return pa.table({"tree": [t], "leaf": [leaf], "depth": [depth + nodes.depth], "bytes": [size], "gains": [gains.tolist()],
                         **_packed(nodes, growth.width)}, schema=_FINISHED)

    return routed.groupBy("slot").applyInArrow(run, FINISHED)


def _close(rows: DataFrame, top: Top, growth: Growth, closed: set[tuple[int, int]]) -> DataFrame:
    """One row per closed node: a leaf, by sums that every task adds up."""
    shut = [np.array(sorted(leaf for t, leaf in closed if t == tree)) for tree in range(growth.trees)]

    def add(t, leaf, x, y, w, check):
        keep = np.isin(leaf, shut[t]) if len(shut[t]) else np.zeros(len(leaf), dtype=bool)
        if not keep.any():
            return None
        leaves, inverse = np.unique(leaf[keep], return_inverse=True)
        targets, weight = growth.targets(y[keep], w[keep]), np.bincount(inverse, weights=w[keep])
        k = targets.shape[1]
        sums = np.stack([np.bincount(inverse, weights=targets[:, i], minlength=len(leaves)) for i in range(k)], axis=1)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(leaves) * k, t)), pa.array(np.repeat(leaves, k)), pa.array(np.tile(np.arange(k), len(leaves))),
             pa.array(np.repeat(weight, k)), pa.array(sums.ravel())], names=["tree", "leaf", "k", "w", "s"])

    added = _per_leaf(rows, top, growth, add, "tree long, leaf long, k long, w double, s double")
    summed = added.groupBy("tree", "leaf", "k").agg((F.sum("s") / F.sum("w")).alias("mean"))
    value = F.transform(F.sort_array(F.collect_list(F.struct("k", "mean"))), lambda v: v["mean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, leaf, means in zip(*(batch.column(n).to_pylist() for n in ("tree", "leaf", "value"))):
                nodes = Nodes(np.array([-1]), np.zeros(1), np.array([-1]), np.array([means]))
                yield pa.RecordBatch.from_pydict({
                    "tree": [t], "leaf": [leaf], "depth": [growth.depth or 0], "bytes": [len(means) * 8 + 24], "gains": [[0.0] * growth.width],
                    **_packed(nodes, growth.width)}, schema=_FINISHED)

    return summed.groupBy("tree", "leaf").agg(value.alias("value")).mapInArrow(run, FINISHED)


def _bound(width: int, n_classes: int) -> int:
    if n_classes:
        return TASK_ROWS
    return max(TASK_ROWS, min(REGRESSION_ROWS, REGRESSION_CELLS // max(1, width)))


def fit_forest(train: DataFrame, n_inputs: int, n_classes: int = 0, trees: int = 1, tried: int | None = None,
               sampled: bool = False, depth: int | None = None, seed: int = 42, bound: int | None = None) -> ForestModel:
    """Trees on a table with ``features`` and ``label``; without ``depth`` they grow until nothing can be split."""
    growth = Growth(trees, n_classes, n_inputs, tried or n_inputs, sampled, depth, seed, bound or _bound(n_inputs, n_classes))
    rows = durable(
        train.groupBy(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")).agg(F.count("*").alias("n"))
        .withColumn("h", F.xxhash64("x", "y")), "forest-rows")
    # A table that one task may hold has no upper part.
    top, gains, closed = Top.roots(growth), np.zeros(n_inputs), set()
    n_rows = rows.count()
    if (shares := _shares(n_rows, trees)) > 1:
        rows = durable(rows.repartition(shares, "h"), "forest-shares")
    if n_rows > growth.bound:
        top, gains, closed = _grow_top(rows, growth)
    finished = _finish(_routed(rows, top, growth, closed), top, growth)
    if closed:
        finished = finished.unionByName(_close(rows, top, growth, closed))
    finished = durable(finished, "forest-nodes")
    return ForestModel(growth, top, finished, gains)


def _arrays(columns: tuple, growth: Growth) -> Nodes:
    """A finished node, by its row's feature, threshold, left and value."""
    k = max(1, growth.n_classes)
    feature, threshold, left, value = columns
    if not isinstance(feature, bytes):
        # As models were saved before: whole lists.
        feature, threshold, left, value = (np.array(v) for v in columns)
        return Nodes(feature, threshold, left, value.reshape(-1, k))
    feature = np.frombuffer(feature, dtype=_feature_type(growth.width))
    inner = feature >= 0
    nodes = Nodes(feature, np.zeros(len(feature)), np.full(len(feature), -1, dtype=np.int32), np.zeros((len(feature), k)))
    nodes.threshold[inner], nodes.left[inner] = np.frombuffer(threshold, dtype=float), np.frombuffer(left, dtype=np.int32)
    nodes.value[~inner] = np.frombuffer(value, dtype=float).reshape(-1, k)
    return nodes


class ForestModel:
    """The upper parts, and a table with the rest of every tree."""

    def __init__(self, growth: Growth, top: Top, finished: DataFrame, gains: np.ndarray):
        self.growth, self.top, self.finished, self.top_gains = growth, top, finished, gains
        facts = finished.agg(F.max("depth").alias("depth"), F.sum("bytes").alias("bytes")).first()
        self.depth, self.bytes = facts["depth"] or 0, facts["bytes"] or 0
        self.shared = None

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Share of the gain that each feature brought (one row per feature)."""
        found = self.finished.select(F.posexplode("gains").alias("at", "gain")).groupBy("at").agg(F.sum("gain").alias("gain")).collect()
        total = self.top_gains.copy()
        for r in found:
            total[r["at"]] += r["gain"]
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``, and ``shares`` for classes."""
        if self.bytes <= MODEL_BYTES:
            return self._where_they_are(df)
        return self._routed(df)

    def _columns(self, df: DataFrame, means: str) -> DataFrame:
        if not self.growth.n_classes:
            return df.withColumn("prediction", F.col(means)[0]).drop(means)
        best = (F.array_position(means, F.array_max(means)) - 1).cast("double")
        return df.withColumns({"prediction": best, "shares": F.col(means)}).drop(means)

    def _where_they_are(self, df: DataFrame) -> DataFrame:
        growth, top = self.growth, self.top
        if self.shared is None:
            # Of a checked size.
            table = self.finished.select(*_NODES).toArrow()
            tree, leaf, *columns = (table.column(n).to_pylist() for n in _NODES)
            self.shared = df.sparkSession.sparkContext.broadcast(dict(zip(zip(tree, leaf), zip(*columns))))
        shared = self.shared

        @F.pandas_udf("array<double>")
        def score(vectors: Iterator[pd.Series]) -> Iterator[pd.Series]:
            finished = {key: _arrays(columns, growth) for key, columns in shared.value.items()}
            walks = [top.nodes(t) for t in range(growth.trees)]
            for series in vectors:
                x = np.stack(series.to_numpy()) if len(series) else np.zeros((0, growth.width))
                total = np.zeros((len(x), max(1, growth.n_classes)))
                for t, walk in enumerate(walks):
                    leaf = walk.walk(x)
                    for one in np.unique(leaf):
                        some = np.nonzero(leaf == one)[0]
                        nodes = finished[t, int(one)]
                        total[some] += nodes.value[nodes.walk(x[some])]
                yield pd.Series(list(total / growth.trees))

        return self._columns(df.withColumn("__means", score(vector_to_array("features"))), "__means")

    def _routed(self, df: DataFrame) -> DataFrame:
        """Every row goes to its node of every tree, and the values come back as sums."""
        growth, top = self.growth, self.top
        rows = durable(df.withColumn("__row", F.monotonically_increasing_id()), "forest-asked")
        asked = rows.select(F.col("__row").alias("row"), vector_to_array("features").alias("x"))
        if (shares := _shares(rows.count(), growth.trees)) > 1:
            asked = asked.repartition(shares, "row")

        def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            walks = [top.nodes(t) for t in range(growth.trees)]
            for batch in _together(batches):
                x, row = _matrix(batch, "x", growth.width), batch.column("row").to_numpy()
                packer, every = Packer(x), np.arange(len(x))
                for t, walk in enumerate(walks):
                    yield t, list(_by_leaf(walk.walk(x), every)), packer, row

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, parts, _, _ in leaves(batches):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t] * len(parts)), pa.array([p[0] for p in parts]), pa.array([len(p[1]) for p in parts])],
                    names=["tree", "leaf", "n"])

        # A node that many rows ask for is met in parts; at most one entry for each ``ASKED`` rows and tree.
        counted = asked.mapInArrow(count, "tree long, leaf long, n long").groupBy("tree", "leaf").agg(F.sum("n").alias("n"))
        busy = {(r["tree"], r["leaf"]): -(-r["n"] // ASKED) for r in counted.where(F.col("n") > ASKED).collect()}

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, found, packer, row in leaves(batches):
                out = []
                for leaf, at in found:
                    parts = busy.get((t, leaf), 1)
                    if parts == 1:
                        out.append((leaf, 0, packer.pack(at), row[at].tobytes()))
                    else:
                        out += [(leaf, part, packer.pack(some), row[some].tobytes()) for part, some in _by_leaf(row[at] % parts, at)]
                leaf, part, x, row = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t] * len(out)), pa.array(leaf), pa.array(part), pa.array(x, pa.binary()), pa.array(row, pa.binary())],
                    names=["tree", "leaf", "part", "x", "row"])

        def meet(asked: pa.Table, nodes: pa.Table) -> pa.Table:
            r, k, value = (np.zeros(0, dtype=d) for d in (np.int64, np.int64, float))
            if asked.num_rows and nodes.num_rows:
                one = _arrays(tuple(nodes.column(n)[0].as_py() for n in _NODES[2:]), growth)
                found = one.value[one.walk(_unpack_rows(asked.column("x"), growth.width))]
                at, k = np.nonzero(found)
                r, value = _unpack(asked.column("row"), np.int64)[at], found[at, k] / growth.trees
            return pa.table({"row": r, "k": k, "value": value})

        routed = asked.mapInArrow(route, "tree long, leaf long, part long, x binary, row binary")
        parts = df.sparkSession.createDataFrame([(*key, n) for key, n in busy.items()], "tree long, leaf long, parts long")
        last = F.coalesce("parts", F.lit(1)).cast("long") - 1
        nodes = self.finished.select(*_NODES).join(F.broadcast(parts), ["tree", "leaf"], "left").withColumn(
            "part", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("parts")
        by = ["tree", "leaf", "part"]
        # A given number of partitions is not merged again, so the nodes are met side by side.
        spread = _spread(df.sparkSession, len(top.open(set())))
        met = routed.repartition(spread, *by).groupBy(*by).cogroup(nodes.repartition(spread, *by).groupBy(*by)).applyInArrow(
            meet, "row long, k long, value double")
        sums = met.groupBy("row", "k").agg(F.sum("value").alias("value"))
        every = F.sequence(F.lit(0).cast("long"), F.lit(max(1, growth.n_classes) - 1).cast("long"))
        means = sums.groupBy(F.col("row").alias("__row")).agg(
            F.map_from_entries(F.collect_list(F.struct("k", "value"))).alias("m")).select(
            "__row", F.transform(every, lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))).alias("__means"))
        nothing = F.array_repeat(F.lit(0.0), max(1, growth.n_classes))
        joined = rows.join(means, "__row", "left").drop("__row").withColumn("__means", F.coalesce("__means", nothing))
        return self._columns(joined, "__means")

    def save(self, path: str) -> None:
        self.finished.write.mode("overwrite").parquet(f"{path}/nodes")
        g = self.growth
        rows = [(t, i, *node[:3], str(node[3]), node[4]) for t, nodes in enumerate(self.top.trees) for i, node in enumerate(nodes)]
        spark = self.finished.sparkSession
        spark.createDataFrame(rows, "tree long, node long, feature long, threshold double, left long, draw string, depth long").coalesce(
            1).write.mode("overwrite").parquet(f"{path}/top")
        facts = [(g.trees, g.n_classes, g.width, g.tried, g.sampled, g.depth, g.seed, g.bound, self.top_gains.tolist())]
        spark.createDataFrame(facts, _FACTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestModel:
        facts = spark.read.parquet(f"{path}/facts").first()
        growth = Growth(*facts[:8])
        top = Top([[] for _ in range(growth.trees)])
        for r in spark.read.parquet(f"{path}/top").orderBy("tree", "node").collect():
            top.trees[r["tree"]].append((r["feature"], r["threshold"], r["left"], int(r["draw"]), r["depth"]))
        return cls(growth, top, spark.read.parquet(f"{path}/nodes"), np.array(facts["gains"]))


# Rows that ask for one node in one task when the model is too large to be broadcast.
ASKED = 1 << 19
_NODES = ("tree", "leaf", "feature", "threshold", "left", "value")
_FACTS = ("trees long, n_classes long, width long, tried long, sampled boolean, depth long, seed long, bound long, "
          "gains array<double>")
