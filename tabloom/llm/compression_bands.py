"""Quality rules: reject text that compresses too well or too badly for its length.

The zstandard ratio (compressed bytes by UTF-8 bytes) of prose falls with the
length, so every band is given per length. Whole documents meet the band of
their length; documents longer than a chunk also need all of their pieces inside
their bands, or nearly all if there are very many, which catches a repeated or
random stretch inside a long text that is otherwise sound. The pieces are the
chunks and what remains behind the last, which meets the band of its length.

Defined results: a null or empty text has no words, fails the base rules and
is not kept. Repeated rows give repeated results, an empty table gives an
empty one, other columns play no part.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, types as T

from tabloom.llm.batches import filter_texts, map_texts, numbered_words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()), T.StructField("zstd_ratio", T.DoubleType()),
    T.StructField("chunks_outside", T.DoubleType()),
])


@dataclass(frozen=True)
class Bands:
    """``(bytes from, lowest ratio, highest ratio)``, shortest first; the frame alone makes very short texts grow."""

    document: tuple[tuple[int, float, float], ...] = (
        (0, 0.0, 9.0), (64, 0.36, 1.30), (128, 0.34, 1.05), (256, 0.32, 0.90), (512, 0.30, 0.82),
        (1024, 0.28, 0.75), (4096, 0.25, 0.70), (16384, 0.22, 0.66), (131072, 0.18, 0.64))
    # Lowest ratios by bytes, between which the logarithm of the length decides; shorter texts have the steps above. A
    # bad text compresses a little better than a good one of its length, which steps are too coarse to tell. Of the
    # documents labelled good, those not held out: the 2 % quantile around each length, moved down by 0.009, which is
    # where 0.2 % of them lie below, and 0.005 more for texts not seen. Few labelled texts are longer than 32 KB, and
    # the longer a text, the more of its words came before: from there the limits fall to that of the longest step.
    lowest: tuple[tuple[int, float], ...] = (
        (512, 0.557), (768, 0.517), (1024, 0.499), (1536, 0.480), (2048, 0.465), (3072, 0.453), (4096, 0.438),
        (8192, 0.418), (16384, 0.402), (32768, 0.394), (65536, 0.34), (131072, 0.30), (262144, 0.26), (524288, 0.22),
        (1048576, 0.18))
    chunk_bytes: int = 4096
    chunk_low: float = 0.435
    chunk_high: float = 0.70
    # Share of pieces outside their band that is still accepted, by the number of pieces.
    chunk_share: tuple[tuple[int, float], ...] = ((0, 0.0), (64, 0.02), (512, 0.005))
    # Shorter remains are judged with the bytes before them, as the frame alone decides their ratio.
    tail_bytes: int = 64
    level: int = 3
    min_words: int = 50
    max_repeat_percent: int = 50

    def limits(self, size: int) -> tuple[float, float]:
        _, low, high = self.document[bisect_right([b for b, _, _ in self.document], size) - 1]
        at = bisect_right([b for b, _ in self.lowest], size)
        if at == len(self.lowest):
            return self.lowest[-1][1], high
        if at:
            (a, first), (b, second) = self.lowest[at - 1], self.lowest[at]
            low = first + (second - first) * log2(size / a) / log2(b / a)
        return low, high

    def pieces(self, size: int) -> int:
        return -(-size // self.chunk_bytes)

    def share(self, pieces: int) -> float:
        return self.chunk_share[bisect_right([n for n, _ in self.chunk_share], pieces) - 1][1]


def word_statistics(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and how many of them stand in a three-word window found twice or more in the text.

    Words are numbered, then pairs, then triples, so that equal numbers mean
    equal windows of the same text and no hash can collide.
    """
    n = len(batch)
    _, code, sizes = numbered_words(pa.array(batch, pa.large_string()))
    total = len(code)
    repeat = np.zeros(n, dtype=np.int64)
    if total < 3:
        return sizes, repeat
    doc = np.repeat(np.arange(n), sizes)
    ends = np.cumsum(sizes)[doc]
    at = np.nonzero(np.arange(total) + 3 <= ends)[0]
    if not len(at):
        return sizes, repeat
    width = int(code.max()) + 1
    pair = _numbered(pa.array(code[at] * width + code[at + 1]))
    triple = _numbered(pa.array(pair * width + code[at + 2]))
    window = _numbered(pa.array(triple * n + doc[at]))
    again = at[np.bincount(window)[window] > 1]
    hit = np.zeros(total, dtype=bool)
    for step in range(3):
        hit[again + step] = True
    return sizes, np.bincount(doc[hit], minlength=n).astype(np.int64)


def _numbered(values: pa.Array) -> np.ndarray:
    return pc.dictionary_encode(values).indices.to_numpy(zero_copy_only=False).astype(np.int64)


def duplicate_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def ratios(raw: bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Ratio of the whole text, and the share of its fixed pieces outside their band; a single piece is the whole."""
    if not raw:
        return 0.0, 0.0
    whole = len(press.compress(raw)) / len(raw)
    pieces = bands.pieces(len(raw))
    if pieces < 2:
        return whole, 0.0
    outside = 0
    for start in range(0, len(raw), bands.chunk_bytes):
        piece = raw[start:start + bands.chunk_bytes]
        low, high = bands.chunk_low, bands.chunk_high
        if len(piece) < bands.chunk_bytes:
            piece = piece if len(piece) >= bands.tail_bytes else raw[-bands.tail_bytes:]
            low, high = bands.limits(len(piece))
        outside += not low <= len(press.compress(piece)) / len(piece) <= high
    return whole, outside / pieces


def judge(batch: list[str], bands: Bands) -> list:
    press = zstandard.ZstdCompressor(level=bands.level)
    words, repeat = word_statistics(batch)
    chars = [len(t) - sum(map(t.count, BLANKS)) for t in batch]
    symbols = [sum(map(t.count, SYMBOLS)) for t in batch]
    lines = [duplicate_lines(t) for t in batch]
    failed = (words < bands.min_words) | (100 * repeat > bands.max_repeat_percent * words)
    whole, outside, kept = [], [], []
    for text, bad in zip(batch, failed):
        raw = text.encode()
        r, o = ratios(raw, bands, press)
        low, high = bands.limits(len(raw))
        whole.append(r)
        outside.append(o)
        kept.append(bool(not bad and low <= r <= high and o <= bands.share(bands.pieces(len(raw)))))
    return [words, chars, symbols, lines, repeat, failed, kept, whole, outside]


def compression_bands(df: DataFrame, text: str = "text", carried: tuple[str, ...] = ("doc_id",),
                      bands: Bands = Bands()) -> DataFrame:
    """``carried`` columns with the counts, the ratios and the verdict of every row."""
    return map_texts(df, carried, text, RESULT, lambda batch: judge(batch, bands))


def keep_in_bands(df: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows that pass the base rules and the bands, with all their columns."""
    return filter_texts(df, text, lambda batch: judge(batch, bands)[6])
