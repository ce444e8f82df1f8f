"""Small helpers that several operators share: batching of rows in tasks, words, hashes, shared storage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.storage import materialise

#: Lower-cases A-Z and turns every ASCII byte that is neither digit nor letter into a blank; UTF-8 bytes stay.
ASCII_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows handed to a function at once hold at most about this many bytes of text (one long text may be more).
SLICE_BYTES = 4_000_000


def ascii_words(raw: bytes | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII bytes, A-Z in lower case."""
    return raw.translate(ASCII_WORDS).split() if raw else []


def slices(batches: Iterator[pa.RecordBatch], text_col: str, slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches by rows so that the texts of each piece stay small; `text_col` may also hold their sizes."""
    for batch in batches:
        column = batch[text_col]
        sizes = np.asarray(pa.compute.fill_null(column if pa.types.is_integer(column.type) else pa.compute.binary_length(column), 0), dtype=np.int64)
        begin, held = 0, 0
        for row, size in enumerate(sizes):
            if held and held + size > slice_bytes:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += int(size)
        if begin < batch.num_rows:
            yield batch.slice(begin)


def texts_of(batch: pa.RecordBatch, text_col: str) -> list[bytes | None]:
    column = batch[text_col]
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def map_slices(df: DataFrame, text_col: str, handle: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One result batch per slice of rows; for functions that need no state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text_col, slice_bytes):
            made = handle(piece)
            if made is not None and made.num_rows:
                yield made

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
POWERS = np.multiply.accumulate(np.array([1] + [BASE] * 4095, np.uint64))


def word_hashes(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and 64-bit hash of every maximal run of word bytes in a byte array."""
    edge = np.diff(is_word.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return begin, end, np.zeros(0, np.uint64)
    first = np.zeros(len(data), np.int64)
    first[begin] = begin
    within = np.arange(len(data)) - np.maximum.accumulate(first)
    weights, beyond = POWERS[within & 4095], np.where(is_word, within >> 12, 0)
    if beyond.any():  # words of more than 4,096 bytes
        weights *= np.multiply.accumulate(np.array([1] + [pow(BASE, 4096, 1 << 64)] * int(beyond.max()), np.uint64))[beyond]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * weights, out=total[1:])
    return begin, end, mix(total[end] - total[begin] + (end - begin).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of every n consecutive words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + words[k : len(words) - n + 1 + k]
    return mix(out)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the folder all executors share and reads it back: cuts lineage, survives lost executors."""
    return materialise(df, name)


BITS = 23


def id_place(id_col: str) -> Column:
    """The place of an id in a bitmap of 2^BITS bits."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << BITS))


def bitmap(ids: DataFrame, id_col: str) -> np.ndarray:
    """A bitmap of the ids, built by Spark; always 1 MB. It may hold an id by chance, so an exact join follows its use."""
    bits = np.zeros(1 << BITS >> 3, np.uint8)
    rows = (ids.select((id_place(id_col) + 1).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")))
    for bucket, part in rows.toLocalIterator():
        at = (bucket - 1) * len(part)
        bits[at : at + len(part)] = np.frombuffer(bytes(part), np.uint8)
    return bits


def in_bitmap(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bits[places >> 3] >> (places & 7)) & 1).astype(bool)


def rows_of(table: DataFrame, ids: DataFrame, id_col: str, then: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter, schema=None) -> DataFrame:
    """The rows of a table whose id is among the ids, and a few others that share a place in the bitmap; nothing is shuffled.

    `then` is done to these rows by the same worker, and gives rows of `schema`.
    """
    bits, names = bitmap(ids, id_col), table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return then(batch.filter(pa.array(in_bitmap(bits, np.asarray(batch["__place"])))).select(names) for batch in batches)

    return table.withColumn("__place", id_place(id_col)).mapInArrow(run, schema or table.schema)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node that can be reached.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until every node but the roots has one link, to a
    root. Every step writes its links to the shared folder.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = keep(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v"), "links")
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = keep(edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or (below = 1 and above = 1)").isEmpty()
