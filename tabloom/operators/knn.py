"""Exact k-nearest-neighbour join, partitioned by pivots and filtered by quantised vectors.

Both sides are assigned to their nearest of a few pivots (Lu et al., "Efficient
Processing of k Nearest Neighbor Joins using MapReduce", VLDB 2012). A query
first meets its own cell, which bounds its k-th distance; by the triangle
inequality only cells that can hold something nearer are visited after that.
Training rows lie in blocks of bounded size, a block being part of a large cell
or several small ones. A query is sent once to each block it has to visit.

In many dimensions most cells have to be visited, so what is sent and compared
there is a code of one byte per coordinate (the vector approximation file of
Weber, Schek and Blott, VLDB 1998). The distance of two codes is a whole number
of steps, found by one matrix product; it differs from that of the vectors by
at most the two rows' own rounding errors. So every pair has a least and a
greatest possible distance, and only rows whose least distance is within the
k-th of the greatest ones are candidates. Vectors are fetched, and exact
distances computed, for those alone. Nothing is capped: what the bounds cannot
rule out is compared. ``knn_join`` can report the shares.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.session import broadcast_if_small, durable

# Task functions travel whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: neighbours that vote.
NEIGHBOURS = 3

# Most rows, and most bytes of training vectors, in one block. Large blocks are
# copied to fewer partners; inside a block the distances are made tile by tile.
TRAIN_BLOCK = 32_768
QUERY_BLOCK = 4_096
BLOCK_BYTES = 16 * 1024 * 1024
QUERY_TILE, TRAIN_TILE = 256, 4096
MAX_PIVOTS = 2048
MAX_PIVOT_BYTES = 32 * 1024 * 1024


def feature_vector(columns: list[Column]) -> Column:
    return F.array(*[col.cast("double") for col in columns])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances summed dimension by dimension, in a fixed order."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        out += gap * gap
    return out


def _stack(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()) if len(series) else np.zeros((0, 0))


def _nearest(q: np.ndarray, t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and squared distance of the k nearest of ``t`` per row of ``q``.

    Equal distances keep the order of ``t``: every tile passes on all that ties
    with its k-th distance, and the final order is by distance, then column.
    """
    parts = []
    for at in range(0, len(q), QUERY_TILE):
        tile = q[at:at + QUERY_TILE]
        rows, cols, dist = [], [], []
        for start in range(0, len(t), TRAIN_TILE):
            far = _squared(tile, t[start:start + TRAIN_TILE])
            last = min(k, far.shape[1]) - 1
            edge = np.partition(far, last, axis=1)[:, last]
            r, c = np.nonzero(far <= edge[:, None])
            rows.append(r)
            cols.append(c + start)
            dist.append(far[r, c])
        r, c, d = np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)
        order = np.lexsort((c, d, r))
        r, c, d = r[order], c[order], d[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < k
        parts.append((r[keep] + at, c[keep], d[keep]))
    return tuple(np.concatenate(columns) for columns in zip(*parts))


@dataclass(frozen=True)
class Grid:
    """Equal steps in all dimensions, so the distance of two codes is a whole number of squared steps."""

    low: np.ndarray
    step: float
    slack: float

    @property
    def kind(self) -> type:
        """Few dimensions have two bytes each, as their codes would else stand for too many rows."""
        return np.uint8 if len(self.low) > 16 else np.uint16

    def codes(self, vectors: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """Codes, and how far each vector lies from what its code stands for; rows beyond the grid just lie far."""
        at = (vectors - self.low) / self.step
        code = np.clip(np.rint(at), 0, np.iinfo(self.kind).max)
        gap = vectors - (self.low + code * self.step)
        return [row.tobytes() for row in code.astype(self.kind)], np.sqrt((gap * gap).sum(axis=1)) + self.slack

    def decoded(self, codes: pd.Series) -> np.ndarray:
        """Codes as floating numbers that hold all their sums of squares exactly."""
        whole = np.frombuffer(b"".join(codes), dtype=self.kind).reshape(len(codes), len(self.low))
        fits = len(self.low) * 4 * float(np.iinfo(self.kind).max) ** 2 < 1 << 24
        return whole.astype(np.float32 if fits else np.float64)


def _grid(train: DataFrame, width: int) -> Grid:
    """From one row per task and dimension: the range of the values, without what lies five deviations off."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, least, most = 0, np.full(width, np.inf), np.full(width, -np.inf)
        total, squares = np.zeros(width), np.zeros(width)
        for batch in batches:
            if len(batch):
                vectors = _stack(batch["vec"])
                n += len(vectors)
                least, most = np.minimum(least, vectors.min(axis=0)), np.maximum(most, vectors.max(axis=0))
                total, squares = total + vectors.sum(axis=0), squares + (vectors * vectors).sum(axis=0)
        if n:
            yield pd.DataFrame({"at": np.arange(width), "n": n, "low": least, "high": most, "total": total, "squares": squares})

    parts = train.select("vec").mapInPandas(run, "at long, n long, low double, high double, total double, squares double")
    found = parts.groupBy("at").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
                                    F.sum("total").alias("total"), F.sum("squares").alias("squares")).orderBy("at").toPandas()
    mean = (found["total"] / found["n"]).to_numpy()
    spread = np.sqrt(np.maximum((found["squares"] / found["n"]).to_numpy() - mean * mean, 0.0))
    low = np.maximum(found["low"].to_numpy(), mean - 5 * spread)
    high = np.minimum(found["high"].to_numpy(), mean + 5 * spread)
    scale = float(np.maximum(found["low"].abs(), found["high"].abs()).max())
    steps = np.iinfo(Grid(low, 1.0, 0.0).kind).max
    return Grid(low, float((high - low).max()) / steps or 1.0, 1e-12 * (scale + 1) * math.sqrt(width))


def _assign(df: DataFrame, pivots: np.ndarray, grid: Grid) -> DataFrame:
    """Add the nearest pivot and the distance to it, the code and its rounding error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), QUERY_TILE):
                part = batch.iloc[start:start + QUERY_TILE]
                vectors = _stack(part["vec"])
                far = _squared(vectors, pivots)
                cell = far.argmin(axis=1)
                code, off = grid.codes(vectors)
                yield part.assign(cell=cell.astype("int64"), radius=np.sqrt(far[np.arange(len(part)), cell]), code=code, off=off)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{schema}, cell long, radius double, code binary, off double")


def _candidates(q: np.ndarray, q_off: np.ndarray, bound: np.ndarray, t: np.ndarray, t_off: np.ndarray, step: float,
                k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, column, least and greatest distance of all pairs that the bounds leave.

    ``bound`` is a distance within which k rows are known already (infinite if
    there are none).
    """
    parts = []
    t_square = (t * t).sum(axis=1)
    for at in range(0, len(q), QUERY_TILE):
        tile, off = q[at:at + QUERY_TILE], q_off[at:at + QUERY_TILE, None]
        square = (tile * tile).sum(axis=1)

        def distances(start):
            some = slice(start, start + TRAIN_TILE)
            steps = square[:, None] + t_square[None, some] - 2 * (tile @ t[some].T)
            return step * np.sqrt(steps.astype(np.float64)), off + t_off[None, some]

        # First the bounds from all rows, then the pairs within them, so that no pair is held that a later row rules out.
        nearest = np.full((len(tile), k), np.inf)
        for start in range(0, len(t), TRAIN_TILE):
            far, error = distances(start)
            most = (far + error) * (1 + 1e-9)
            nearest = np.partition(np.concatenate([nearest, most], axis=1), k - 1, axis=1)[:, :k]
        within = np.minimum(bound[at:at + QUERY_TILE], nearest.max(axis=1))
        for start in range(0, len(t), TRAIN_TILE):
            far, error = distances(start)
            least = (far - error) * (1 - 1e-9)
            r, c = np.nonzero(least <= within[:, None])
            parts.append((r + at, c + start, least[r, c], ((far[r, c] + error[r, c]) * (1 + 1e-9))))
    return tuple(np.concatenate(v) for v in zip(*parts))


def _cells_to_visit(queries: DataFrame, pivots: np.ndarray, cells: pd.DataFrame, k: int) -> DataFrame:
    """Cells besides its own that may hold a neighbour within ``bound``.

    A query whose own cell has fewer than k rows is bounded by the cells' far
    edges instead: enough of the nearest edges hold k rows between them.
    """
    cell_ids = cells["cell"].to_numpy()
    radius = cells["radius"].to_numpy()
    rows_in = cells["n"].to_numpy()
    centres = pivots[cell_ids]
    between = np.sqrt(_squared(pivots, centres))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), QUERY_TILE):
                part = batch.iloc[start:start + QUERY_TILE]
                far = np.sqrt(_squared(_stack(part["vec"]), centres))
                own = part["cell"].to_numpy()
                near = part["radius"].to_numpy()[:, None]
                apart = between[own]
                # Half the difference of squares over the pivots' gap is the
                # distance to the border between the two cells.
                with np.errstate(divide="ignore", invalid="ignore"):
                    border = np.where(apart > 0, (far * far - near * near) / (2 * apart), 0.0)
                bound = part["bound"].to_numpy().copy()
                if np.isinf(bound).any() and rows_in.sum() >= k:
                    edge = far[np.isinf(bound)] + radius[None, :]
                    order = edge.argsort(axis=1)
                    enough = (rows_in[order].cumsum(axis=1) >= k).argmax(axis=1)
                    lines = np.arange(len(edge))
                    bound[np.isinf(bound)] = edge[lines, order[lines, enough]]
                least = np.maximum(np.maximum(far - radius[None, :], border), 0.0)
                slack = 1e-9 * (1.0 + far)
                visit = (least - slack <= bound[:, None]) & (cell_ids[None, :] != own[:, None])
                row, hit = np.nonzero(visit)
                yield pd.DataFrame({"qid": part["qid"].to_numpy()[row], "cell": cell_ids[hit]})

    types = {f.name: f.dataType.simpleString() for f in queries.schema}
    return queries.mapInPandas(run, f"qid {types['qid']}, cell long")


def _pack(cells: pd.DataFrame, width: int) -> list[tuple[int, int, int]]:
    """``(cell, first block, blocks)``: small cells share a block, large ones have several."""
    per_block = min(TRAIN_BLOCK, max(256, BLOCK_BYTES // (8 * max(1, width))))
    out, block, filled = [], 0, 0
    for cell, n in zip(cells["cell"].tolist(), cells["n"].tolist()):
        if filled and filled + n > per_block:
            block, filled = block + 1, 0
        parts = -(-n // per_block)
        out.append((cell, block, parts))
        block, filled = (block, filled + n) if parts == 1 else (block + parts, 0)
    return out


def _blocks_of(visits: DataFrame, packing: DataFrame) -> DataFrame:
    """``(qid, block)`` of the cells to visit, each once."""
    last = F.col("first") + F.col("parts") - 1
    return visits.join(F.broadcast(packing), "cell").select(
        "qid", F.explode(F.sequence("first", last)).alias("block")).distinct()


def _pairs(visits: DataFrame, queries: DataFrame, train: DataFrame, width: int):
    """Both sides grouped by block and part, to be cogrouped; ``queries`` and ``train`` keep their other columns."""
    most = min(QUERY_BLOCK, max(256, BLOCK_BYTES // (8 * max(1, width))))
    counted = visits.groupBy("block").agg(F.ceil(F.count("*") / most).alias("q_parts"))
    parts = broadcast_if_small(durable(counted, "knn-parts"))
    q = visits.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("qid"), "q_parts"))
    q = q.select("block", "part", "qid").join(queries, "qid")
    t = train.join(parts, "block").withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_parts") - 1))).drop("q_parts")
    return q.groupBy("block", "part"), t.groupBy("block", "part")


def _meet_codes(visits: DataFrame, queries: DataFrame, blocks: DataFrame, grid: Grid, k: int) -> DataFrame:
    """``(qid, row, least, most)`` of what may be among the k nearest, by the codes of the blocks visited.

    ``queries`` has ``(qid, code, off, bound)``, ``blocks`` ``(block, row, code, off)``.
    """
    qtype = {f.name: f.dataType.simpleString() for f in queries.schema}["qid"]

    def meet(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"qid": q["qid"][:0], "row": t["row"][:0], "least": pd.Series(dtype="float64"),
                                 "most": pd.Series(dtype="float64")})
        rows, cols, least, most = _candidates(
            grid.decoded(q["code"]), q["off"].to_numpy(), q["bound"].to_numpy(), grid.decoded(t["code"]), t["off"].to_numpy(),
            grid.step, k)
        return pd.DataFrame({"qid": q["qid"].to_numpy()[rows], "row": t["row"].to_numpy()[cols], "least": least, "most": most})

    q, t = _pairs(visits, queries, blocks, -(-len(grid.low) * np.dtype(grid.kind).itemsize // 8))
    return q.cogroup(t).applyInPandas(meet, f"qid {qtype}, row long, least double, most double")


def _kth(found: DataFrame, k: int) -> DataFrame:
    """``(qid, bound)``: within this distance of the query there are k rows."""
    order = Window.partitionBy("qid").orderBy("most", "row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).groupBy("qid").agg(
        F.when(F.count("*") == k, F.max("most")).otherwise(F.lit(float("inf"))).alias("bound"))


def _meet(visits: DataFrame, queries: DataFrame, train: DataFrame, width: int, k: int,
          repeated: bool = False) -> DataFrame:
    """k nearest per query among the blocks it visits; ``repeated`` if a training row may lie in several of them.

    ``visits`` has ``(qid, block)``. The queries of a block are cut into parts
    of bounded size, so a block pair never holds more, whatever share of the
    rows a cell has.
    """
    types = {f.name: f.dataType.simpleString() for f in train.schema}
    qtype = {f.name: f.dataType.simpleString() for f in queries.schema}["qid"]

    def nearest(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"qid": q["qid"][:0], "nid": t["nid"][:0], "label": t["label"][:0],
                              "distance2": pd.Series(dtype="float64")})
        if q.empty or t.empty:
            return empty
        t = t.sort_values("nid", kind="stable")
        rows, cols, far = _nearest(_stack(q["vec"]), _stack(t["vec"]), k)
        return pd.DataFrame({
            "qid": q["qid"].to_numpy()[rows],
            "nid": t["nid"].to_numpy()[cols],
            "label": t["label"].to_numpy()[cols],
            "distance2": far,
        })

    q, t = _pairs(visits, queries.select("qid", "vec"), train, width)
    found = q.cogroup(t).applyInPandas(nearest, f"qid {qtype}, nid {types['nid']}, label {types['label']}, distance2 double")
    if repeated:
        found = found.groupBy("qid", "nid").agg(F.first("label").alias("label"), F.min("distance2").alias("distance2"))
    return _best(found, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("distance2", "nid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _pivots(train: DataFrame, n_train: int) -> np.ndarray:
    """Up to about sqrt(n) training vectors, picked by hash order."""
    width = train.select(F.size("vec")).first()[0]
    wanted = max(1, min(MAX_PIVOTS, int(math.sqrt(n_train) / 2), MAX_PIVOT_BYTES // (8 * max(1, width))))
    rows = train.select("vec", F.xxhash64("nid").alias("h"), "nid").orderBy("h", "nid").limit(wanted).collect()
    return np.array([r["vec"] for r in rows], dtype="float64")


def knn_join(train: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, report: dict | None = None) -> DataFrame:
    """Exact neighbours ``(qid, nid, label, distance2, rank)``.

    ``train`` has ``(nid, label, vec)``, ``queries`` ``(qid, vec)``. Equal
    distances go to the smaller ``nid``. Identical training vectors count up to
    k times each, identical query vectors are answered once and joined back.
    ``report`` is told how many cells there are, which share of them the
    queries had to visit (by codes), and which share of all pairs was compared
    by full vectors.
    """
    same = Window.partitionBy("vec").orderBy("nid")
    train = durable(
        train.select("nid", "label", "vec").withColumn("r", F.row_number().over(same)).where(F.col("r") <= k).drop("r"),
        "knn-train")
    n_train = train.count()
    if n_train == 0:
        raise ValueError("there is no training row")
    pivots = _pivots(train, n_train)
    grid = _grid(train, pivots.shape[1])
    train = durable(_assign(train, pivots, grid).withColumn("row", F.monotonically_increasing_id()), "knn-cells")
    asked = queries.select("qid", "vec")
    distinct = durable(
        _assign(asked.groupBy("vec").agg(F.min("qid").alias("qid")).select("qid", "vec"), pivots, grid), "knn-queries")
    # One row per pivot.
    cells = train.groupBy("cell").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).orderBy("cell").toPandas()
    packing = train.sparkSession.createDataFrame(_pack(cells, pivots.shape[1]), "cell long, first long, parts long")
    blocks = train.join(F.broadcast(packing), "cell").withColumn(
        "block", F.col("first") + F.pmod(F.xxhash64("nid"), "parts")).select("block", "row", "code", "off")

    coded = distinct.select("qid", "code", "off")
    met = durable(_blocks_of(distinct.select("qid", "cell"), packing), "knn-own-blocks")
    own = durable(_meet_codes(met, coded.withColumn("bound", F.lit(float("inf"))), blocks, grid, k), "knn-own")
    bounded = durable(distinct.join(_kth(own, k), "qid", "left").withColumn(
        "bound", F.coalesce("bound", F.lit(float("inf")))), "knn-bounds")
    others = _cells_to_visit(bounded, pivots, cells, k)
    if report is not None:
        others = durable(others, "knn-visits")
    left = durable(_blocks_of(others, packing).join(met, ["qid", "block"], "left_anti"), "knn-other-blocks")
    rest = _meet_codes(left, bounded.select("qid", "code", "off", "bound"), blocks, grid, k)
    found = durable(own.unionByName(rest), "knn-candidates")
    wanted = found.join(_kth(found, k), "qid").where("least <= bound").select("qid", "row")
    if report is not None:
        wanted = durable(wanted, "knn-compared")
        n_queries = max(1, distinct.count())
        report.update(queries=n_queries, cells=len(cells),
                      visited_share=1 / len(cells) + others.count() / (n_queries * len(cells)),
                      compared_share=wanted.count() / (n_queries * n_train))
    # Summed in the order of the dimensions, as a loop would.
    gap = F.zip_with("asked", "vec", lambda a, b: (a - b) * (a - b))
    near = wanted.join(train.select("row", "nid", "label", "vec"), "row").join(
        distinct.select("qid", F.col("vec").alias("asked")), "qid")
    near = near.select("qid", "nid", "label", F.aggregate(gap, F.lit(0.0), lambda total, x: total + x).alias("distance2"))
    answers = _best(near, k)
    rep = distinct.select("vec", F.col("qid").alias("rep"))
    return (
        asked.join(rep, "vec").select("qid", "rep")
        .join(answers.withColumnRenamed("qid", "rep"), "rep").drop("rep")
    )


@dataclass(frozen=True)
class Lsh:
    """Settings of the approximate join: more ``tables`` find more, more ``projections`` compare less."""

    tables: int = 24
    projections: int = 4
    width: float | None = None
    sample: int = 512
    seed: int = 42


def _typical_gap(train: DataFrame, queries: DataFrame, sample: int) -> float:
    """Mean distance of some queries to the nearest of some training rows; both samples are bounded and drawn by hash."""
    def some(df: DataFrame, name: str) -> np.ndarray:
        rows = df.select("vec", F.xxhash64(name).alias("h"), name).orderBy("h", name).limit(sample).collect()
        return np.array([r["vec"] for r in rows], dtype="float64")

    far = _squared(some(queries, "qid"), some(train, "nid"))
    far[far == 0] = np.inf
    nearest = far.min(axis=1)
    return float(np.sqrt(nearest[np.isfinite(nearest)]).mean()) if np.isfinite(nearest).any() else 1.0


def _buckets(df: DataFrame, name: str, width: int, gap: float, lsh: Lsh) -> DataFrame:
    """``(name, bucket)``: one bucket per table, from shifted random projections."""
    rng = np.random.default_rng(lsh.seed)
    lines = rng.normal(size=(width, lsh.tables * lsh.projections)) / gap
    shift = rng.random(lsh.tables * lsh.projections)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cells = np.floor(_stack(batch["vec"]) @ lines + shift).astype("int64")
                parts = cells.reshape(len(batch), lsh.tables, lsh.projections)
                yield pd.DataFrame({name: batch[name], "cells": [[row.tolist() for row in t] for t in parts]})

    kind = df.schema[name].dataType.simpleString()
    placed = df.select(name, "vec").mapInPandas(run, f"{name} {kind}, cells array<array<long>>")
    return placed.select(name, F.posexplode("cells").alias("table", "cell")).select(
        name, F.xxhash64("table", "cell").alias("bucket"))


def knn_join_lsh(train: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, lsh: Lsh = Lsh()) -> DataFrame:
    """Neighbours like ``knn_join``, but only among training rows that share a bucket with the query.

    For tables in which the exact join would come near all against all. The
    distances are exact, some neighbours may be missing: with the default
    settings the tests find over nine in ten on clustered vectors. A bucket is
    cut into blocks of bounded size like any cell.
    """
    train = durable(train.select("nid", "label", "vec"), "lsh-train")
    first = train.first()
    if first is None:
        raise ValueError("there is no training row")
    queries = durable(queries.select("qid", "vec"), "lsh-queries")
    width = len(first["vec"])
    gap = 4.0 * (lsh.width or _typical_gap(train, queries, lsh.sample))
    per_block = min(TRAIN_BLOCK, max(256, BLOCK_BYTES // (8 * max(1, width))))
    placed = durable(_buckets(train, "nid", width, gap, lsh), "lsh-buckets")
    asked = durable(_buckets(queries, "qid", width, gap, lsh), "lsh-asked")
    wanted = asked.select("bucket").distinct()
    sizes = durable(placed.join(wanted, "bucket", "left_semi").groupBy("bucket").agg(
        F.ceil(F.count("*") / per_block).alias("parts")), "lsh-sizes")
    visits = asked.join(sizes, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    visits = durable(visits.select("qid", F.xxhash64("bucket", "part").alias("block")), "lsh-visits")
    blocks = placed.join(sizes, "bucket").withColumn("part", F.pmod(F.xxhash64("nid"), "parts"))
    blocks = blocks.select("nid", F.xxhash64("bucket", "part").alias("block")).join(train, "nid")
    return _meet(visits, queries, blocks.select("block", "nid", "label", "vec"), width, k, repeated=True)


def knn_votes(neighbours: DataFrame) -> DataFrame:
    """Votes per query and class, with their share."""
    counts = neighbours.groupBy("qid", "label").agg(F.count("*").alias("votes"))
    total = F.sum("votes").over(Window.partitionBy("qid"))
    return counts.withColumn("share", F.col("votes") / total)


def knn_predict(neighbours: DataFrame) -> DataFrame:
    """Majority class per query, ties to the smallest, and its vote share."""
    return (
        neighbours.groupBy("qid", "label").agg(F.count("*").alias("votes")).groupBy("qid")
        .agg(
            F.min_by("label", F.struct(-F.col("votes"), F.col("label"))).alias("prediction"),
            (F.max("votes") / F.sum("votes")).alias("confidence"),
        )
    )


def knn_classify(train: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    return knn_predict(knn_join(train, queries, k))
