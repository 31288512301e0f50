"""Arrow batches in slices of bounded size, shared by the operators that run Python inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

# Bytes of text that one slice holds, if a single text is not longer.
SLICE_BYTES = 2 << 20

SPACE = b" \t\n\x0b\x0c\r"


def named(name: str):
    """Column by its exact name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def slices(batches: Iterator[pa.RecordBatch], column: int, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` has at most ``budget`` bytes in each, or a single row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + budget, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Hand freed memory back at the end of a task; a reused worker would keep it through later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts(batch: pa.RecordBatch, column: int) -> list[str]:
    """The texts; a null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def numbered_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a column of texts, the number of each word in turn, and how many words each text has.

    Words lie between blanks (``SPACE``); a null has none.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(column, "")))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    words, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.index(words, pa.scalar("", words.type)).as_py()
    if blank >= 0:
        sizes -= np.bincount(np.repeat(np.arange(len(sizes)), sizes)[codes == blank], minlength=len(sizes))
        codes = codes[codes != blank]
    return words, codes, sizes


def map_texts(df: DataFrame, carried: Sequence[str], text: str, result: T.StructType,
              compute: Callable[[list[str]], list[Sequence]]) -> DataFrame:
    """``carried`` columns as they are, and the result columns computed from the text.

    ``compute`` gets a list of texts (null: empty) and gives one list per
    result column. Rows are neither moved nor reordered.
    """
    fields = [T.StructField(n, df.schema[n].dataType) for n in carried]
    inner = df.select(*[named(n).alias(f"c{i}") for i, n in enumerate(carried)], named(text).cast("string").alias("t"))
    k = len(carried)
    arrow = _arrow(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, k):
            columns = compute(texts(part, k))
            yield pa.RecordBatch.from_arrays(
                [part.column(i) for i in range(k)] + [pa.array(v, t) for v, t in zip(columns, arrow)],
                names=[f"c{i}" for i in range(k)] + [f"r{i}" for i in range(len(arrow))])

    schema = T.StructType(
        [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)]
        + [T.StructField(f"r{i}", f.dataType) for i, f in enumerate(result.fields)])
    out = inner.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(carried)],
                      *[F.col(f"r{i}").alias(f.name) for i, f in enumerate(result.fields)])


def filter_texts(df: DataFrame, text: str, keep: Callable[[list[str]], list[bool]]) -> DataFrame:
    """The rows whose text passes, with all their columns."""
    names = df.columns
    at = names.index(text)
    inner = df.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            yield part.filter(pa.array(keep(texts(part, at)), pa.bool_()))
        give_back()

    return inner.mapInArrow(run, inner.schema).toDF(*names)


_ARROW = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(),
          T.StringType: pa.string(), T.BinaryType: pa.binary()}


def _arrow(schema: T.StructType) -> list[pa.DataType]:
    def one(kind: T.DataType) -> pa.DataType:
        if isinstance(kind, T.ArrayType):
            return pa.list_(one(kind.elementType))
        if isinstance(kind, T.StructType):
            return pa.struct([(f.name, one(f.dataType)) for f in kind.fields])
        return _ARROW[type(kind)]

    return [one(f.dataType) for f in schema.fields]
