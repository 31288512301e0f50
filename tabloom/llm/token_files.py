"""Token ids as flat binary files.

A folder holds one pair of files per range of ids, in ascending order:

* ``*.bin``: the token ids of all documents, one after the other, unsigned
  little-endian, two bytes each if the vocabulary allows it, else four;
* ``*.idx``: four 64-bit numbers (version, bytes per id, documents, documents
  without an id), then the 64-bit offsets of the documents in the ``.bin``
  file, one more than documents, then the document ids.

The manifest has a row per pair. Its ``base`` is the prefix sum of the ids in
the files before, so an offset becomes a place in the whole corpus by one
addition. Both files can be memory-mapped.

Every attempt of a task writes under a name of its own; the manifest, a
Parquet table, names the files of the attempts that counted. An executor may
so be lost at any time.

Defined results: a null or empty text is its end token alone; rows of one id
are ordered by the digest of their text; rows without an id come last. An
empty table gives no files and no rows. Other columns play no part.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabloom.llm.batches import give_back, named, numbered_words, slices
from tabloom.session import durable, scratch_path

VERSION = 1
# Bytes of odd words, and of plain words' parts, that a worker remembers; the frequent ones come first, and a full memory
# takes no more.
REMEMBERED_WORDS = 4 << 20
REMEMBERED_PARTS = 28 << 20
# What an entry takes besides its letters and ids.
ENTRY_BYTES = 190
# Bytes of text encoded at a time; a word is looked up once in each such part.
ENCODED_BYTES = 2 << 20
# Documents that are read back at a time.
READ_DOCUMENTS = 4096

# Letters of one case pair each that no normalisation joins or splits, then ASCII signs without the apostrophe and digits:
# such a word is split behind its letters, whatever stands around it.
_PLAIN = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<sign>[!-&(-/:-@\[-`{-~]*)$"


class Remembered(dict):
    """Ids by text, within a bound of bytes."""

    def __init__(self, room: int):
        super().__init__()
        self.room = room

    def keep(self, learned: dict[str, bytes]) -> None:
        if self.room <= 0:
            return
        for text, ids in learned.items():
            self.room -= ENTRY_BYTES + len(text) + len(ids)
            if self.room <= 0:
                return
            self[text] = ids


class WordEncoder:
    """Ids of whole texts from ids of their words, each word encoded once.

    Only for tokenizers that drop white space and never join across it, which
    ``same_by_words`` finds out.
    """

    def __init__(self, path: str):
        # A task has one core: more threads would each keep memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.words, self.parts = Remembered(REMEMBERED_WORDS), Remembered(REMEMBERED_PARTS)
        self.by_words = self.same_by_words()

    def same_by_words(self) -> bool:
        probe = "One  two,\n\tthree's\x0bfour. cinq é6\r\nsix"
        return self._ids(probe).tolist() == [i for w in _split(probe) for i in self._ids(w).tolist()]

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts, ``end_id`` behind each text, and how many ids each text has."""
        if self.by_words:
            words, codes, sizes = numbered_words(column)
            found = self._words(words)
        else:
            whole = [t or "" for t in column.to_pylist()]
            codes, sizes = np.arange(len(whole)), np.ones(len(whole), dtype=np.int64)
            found = pa.array(self._each(whole), pa.large_binary())
        found = pa.concat_arrays([found, pa.array([np.array([end_id], dtype=self.dtype).tobytes()], pa.large_binary())])
        ends = np.cumsum(sizes)
        pieces = np.insert(codes, ends, len(found) - 1)
        lengths = pc.binary_length(found).to_numpy() // self.dtype.itemsize
        upto = np.concatenate((np.zeros(1, dtype=np.int64), np.cumsum(lengths[pieces])))
        stops = upto[ends + np.arange(1, len(sizes) + 1)]
        whole = found.take(pa.array(pieces))
        ids = np.frombuffer(whole.buffers()[2], dtype=self.dtype, count=int(upto[-1]))
        return ids, np.diff(stops, prepend=0)

    def _words(self, words: pa.Array) -> pa.Array:
        """Ids of distinct words, as bytes. Plain words are taken apart and put together as columns."""
        split = pc.extract_regex(words, _PLAIN)
        core, sign = pc.dictionary_encode(pc.utf8_lower(pc.struct_field(split, 0))), pc.dictionary_encode(pc.struct_field(split, 1))
        found = pc.binary_join_element_wise(
            self._remembered(core.dictionary, self.parts, self._letters).take(core.indices),
            self._remembered(sign.dictionary, self.parts, self._each).take(sign.indices), pa.scalar(b"", pa.large_binary()))
        odd = pc.is_null(split)
        return pc.replace_with_mask(found, odd, self._remembered(words.filter(odd), self.words, self._each))

    def _remembered(self, column: pa.Array, known: Remembered, learn: Callable[[list[str]], list[bytes]]) -> pa.Array:
        """Ids of distinct texts, as bytes: those known, and the others learned now."""
        some = column.to_numpy(zero_copy_only=False).tolist()
        found = list(map(known.get, some))
        new = [t for t, ids in zip(some, found) if ids is None]
        if new:
            learned = learn(new)
            known.keep(dict(zip(new, learned)))
            rest = iter(learned)
            found = [next(rest) if ids is None else ids for ids in found]
        return pa.array(found, pa.large_binary())

    def _each(self, new: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes()
                for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]

    def _letters(self, cores: list[str]) -> list[bytes]:
        """Words of letters are one piece each, whose last id alone closes a word: many are encoded as one text."""
        out = []
        for i in range(0, len(cores), 200):
            some = cores[i:i + 200]
            ids = self._ids(" ".join(some))
            stops = np.nonzero(self.ends[ids])[0] + 1
            if len(stops) == len(some):
                raw, stops = ids.tobytes(), (stops * self.dtype.itemsize).tolist()
                out += [raw[a:b] for a, b in zip([0, *stops], stops)]
            else:
                out += self._each(some)
        return out


def _split(text: str) -> list[str]:
    return [w.decode() for w in text.encode().split()]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per worker process, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


MANIFEST = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("file", T.StringType()),
    T.StructField("documents", T.LongType()), T.StructField("tokens", T.LongType())])


def _writer(path: str, end_id: int, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path)
        width = tool.dtype.itemsize
        sizes, ids, nulls = [], [], 0
        name = f"{folder}/{uuid.uuid4().hex}"
        out, store = None, None
        for part in slices(batches, 1, ENCODED_BYTES):
            if out is None:
                store, at = pafs.FileSystem.from_uri(name)
                store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                out = store.open_output_stream(f"{at}.bin")
            tokens, counts = tool.encode(part.column(1), end_id)
            out.write(tokens.tobytes())
            sizes.append(counts.astype("<u8"))
            nulls += part.column(0).null_count
            ids.append(part.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        give_back()
        if out is None:
            return
        out.close()
        offsets = np.concatenate([np.zeros(1, dtype="<u8"), *sizes]).cumsum(dtype="<u8")
        with store.open_output_stream(f"{at}.idx") as index:
            index.write(np.array([VERSION, width, len(offsets) - 1, nulls], dtype="<u8").tobytes())
            index.write(offsets.tobytes())
            index.write(np.concatenate(ids).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([name]),
             pa.array([len(offsets) - 1], pa.int64()), pa.array([int(offsets[-1])], pa.int64())],
            names=MANIFEST.names)

    return run


def write_tokens(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", end_id: int = 1,
                 folder: str | None = None) -> DataFrame:
    """Write the files, in ascending order of ids; the manifest ``(part, file, documents, tokens, base)``.

    ``tokenizer`` is the path of a tokenizer file that all executors have,
    ``folder`` one that all of them reach; without it, a new one in the
    session's shared folder.
    """
    target = folder or scratch_path(df.sparkSession, "tokens")
    if target.startswith("/"):
        target = f"file://{target}"
    rows = df.select(named(id_column).cast("long").alias("id"), named(text).cast("string").alias("t"))
    # Rows of one id are spread by their texts, and equal rows by their number, whose order does not matter.
    rows = rows.withColumns({"digest": F.xxhash64("t"), "row": F.monotonically_increasing_id()})
    order = [F.col("id").asc_nulls_last(), F.col("digest").asc()]
    ordered = rows.repartitionByRange(*order, "row").sortWithinPartitions(*order).select("id", "t")
    written = durable(ordered.mapInArrow(_writer(tokenizer, end_id, target), MANIFEST), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _map_file(store, at: str, dtype, start: int, count: int) -> np.ndarray:
    """``count`` numbers from byte ``start``: mapped if the file is local, read otherwise."""
    dtype = np.dtype(dtype)
    if not count:
        return np.zeros(0, dtype=dtype)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(at, dtype=dtype, mode="r", offset=start, shape=(count,))
    with store.open_input_file(at) as f:
        return np.frombuffer(f.read_at(count * dtype.itemsize, start), dtype=dtype)


TOKENS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_crc32", T.LongType())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            store, at = pafs.FileSystem.from_uri(file)
            version, width, documents, nulls = _map_file(store, f"{at}.idx", "<u8", 0, 4).tolist()
            if version != VERSION:
                raise ValueError(f"{file}: unknown version {version}")
            for first in range(0, documents, READ_DOCUMENTS):
                n = min(READ_DOCUMENTS, documents - first)
                offsets = _map_file(store, f"{at}.idx", "<u8", 8 * (4 + first), n + 1).astype(np.int64)
                ids = _map_file(store, f"{at}.idx", "<i8", 8 * (4 + documents + 1 + first), n)
                sums = []
                low = int(offsets[0])
                tokens = _map_file(store, f"{at}.bin", f"<u{width}", width * low, int(offsets[-1]) - low)
                for a, b in zip(offsets[:-1] - low, offsets[1:] - low):
                    sums.append(zlib.crc32(tokens[a:b].astype("<u4")))
                missing = np.arange(first, first + n) >= documents - nulls
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(ids), mask=missing), pa.array(base + offsets[:-1]),
                     pa.array(np.diff(offsets)), pa.array(sums, pa.int64())], names=TOKENS.names)
    give_back()


def read_tokens(manifest: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``(id, start, n_tokens, ids_crc32)`` of every document, from the files."""
    files = max(1, manifest.count())
    return manifest.select("file", "base").repartition(files).mapInArrow(_read, TOKENS).withColumnRenamed("id", id_column)


def encode_and_read_back(df: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text",
                         end_id: int = 1) -> DataFrame:
    return read_tokens(write_tokens(df, tokenizer, id_column, text, end_id), id_column)
