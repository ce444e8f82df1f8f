"""Packing into training sequences by vector bin packing under three limits at once.

A sequence may hold `capacity` tokens, `max_segments` pieces and `max_loss` loss-bearing tokens. Each example is a
vector of these three demands. A task fills one sequence at a time: of the examples that fit into what is left of all
three limits it takes the one with the largest dot product of demand and remainder, each in shares of its limit. If none
fits, the best one is cut so that the sequence becomes full, and its rest goes back to the pool.

Every task packs its own input partition from a bounded pool, so nothing is shuffled, a hot source or a long text is no
special case, and a lost task repeats the same result. Sequence numbers begin at partition number * 2^33. What a task has
left in the end (less than one sequence) is laid into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import slices

#: The pool is packed when it holds so many examples, down to a quarter: 2,048 examples of under 2,048 tokens, 16 MB.
POOL = 2048
#: A cut leaves at least so many tokens on both sides, if the sequence has room for them.
LEAST_CUT = 16


class Packer:
    """Packs examples one by one; a placed piece is (key, start, ids, doc_tokens, sequence, offset, loss tokens)."""

    def __init__(self, capacity: int, max_segments: int, max_loss: int, first_sequence: int = 0):
        if min(capacity, max_segments, max_loss) < 1:
            raise ValueError("all limits must be at least 1")
        self.limits = np.array([capacity, max_segments, max_loss], np.float64)
        self.capacity, self.max_segments, self.max_loss = capacity, max_segments, max_loss
        self.sequence = first_sequence
        self.room = 2 * POOL
        self.items: list[tuple | None] = [None] * self.room
        self.demand = np.full((self.room, 2), np.inf)  # tokens and loss-bearing tokens
        self.free, self.held = list(range(self.room)), 0

    def add(self, key, ids: np.ndarray, loss: np.ndarray | None = None) -> Iterator[tuple]:
        """Takes an example; loss marks its loss-bearing tokens (None: all). Yields what has been placed."""
        bearing = np.arange(len(ids) + 1) if loss is None else np.concatenate([[0], np.cumsum(loss, dtype=np.int64)])
        start = 0
        while len(ids) - start >= self.capacity:  # full sequences need no packing
            end = min(start + self.capacity, int(np.searchsorted(bearing, bearing[start] + self.max_loss, "right")) - 1)
            if end - start < self.capacity:
                break
            yield self._piece(key, start, end, ids, bearing, 0)
            self.sequence += 1
            start = end
        if start < len(ids):
            self._put(key, start, ids, bearing)
            if self.held >= POOL:
                yield from self._pack(POOL // 4)

    def close(self) -> Iterator[tuple]:
        yield from self._pack(0)

    def _piece(self, key, start: int, end: int, ids, bearing, offset: int) -> tuple:
        return key, start, ids[start:end], len(ids), self.sequence, offset, int(bearing[end] - bearing[start])

    def _put(self, key, start: int, ids, bearing) -> None:
        at = self.free.pop()
        self.items[at] = (key, start, ids, bearing)
        self.demand[at] = len(ids) - start, bearing[-1] - bearing[start]
        self.held += 1

    def _take(self, at: int) -> tuple:
        item, self.items[at] = self.items[at], None
        self.demand[at] = np.inf
        self.free.append(at)
        self.held -= 1
        return item

    def _pack(self, down_to: int) -> Iterator[tuple]:
        while self.held > down_to:
            capacity = self.capacity
            if down_to == 0 and self.held <= self.max_segments:
                left = self.demand[np.isfinite(self.demand[:, 0])].sum(axis=0)
                if left[0] < capacity and left[1] <= self.max_loss:
                    capacity = 1 << (int(left[0]).bit_length() - 1)
            yield from self._fill(capacity)

    def _fill(self, capacity: int) -> Iterator[tuple]:
        tokens, segments, loss, offset = capacity, self.max_segments, self.max_loss, 0
        while tokens and segments and self.held:
            size, bearing = self.demand[:, 0], self.demand[:, 1]
            left = np.array([tokens, segments, loss]) / self.limits
            product = size * (left[0] / self.limits[0]) + left[1] / self.limits[1] + bearing * (left[2] / self.limits[2])
            fitting = np.where((size <= tokens) & (bearing <= loss), product, -1.0)
            at = int(fitting.argmax())
            if fitting[at] >= 0:
                key, start, ids, sums = self._take(at)
                end = len(ids)
            else:
                if offset and tokens < LEAST_CUT and capacity == self.capacity:
                    break
                at = int(np.where(np.isfinite(size), product, -1.0).argmax())
                key, start, ids, sums = self.items[at]
                end = min(start + tokens, int(np.searchsorted(sums, sums[start] + loss, "right")) - 1, len(ids))
                if end <= start:
                    break
                self._take(at)
                if end < len(ids):
                    self._put(key, end, ids, sums)
            piece = self._piece(key, start, end, ids, sums, offset)
            yield piece
            offset += end - start
            tokens, segments, loss = tokens - (end - start), segments - 1, loss - piece[-1]
        self.sequence += 1


PIECE = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    T.StructField("loss_tokens", T.LongType()),
])


def pack(examples: DataFrame, encode: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray | None]]], *, id_col: str,
         text_col: str, capacity: int = 2048, max_segments: int = 128, max_loss: int | None = None, with_ids: bool = False,
         extra: tuple[str, ...] = ()) -> DataFrame:
    """Packs all rows; `encode` gives ids and loss mask of each row of a batch. One result row per piece.

    The pieces of a row cover each of its ids once; rows without ids give none. Repeated rows are packed as often as they
    occur; a null id is kept as null. The columns are the id and those of PIECE (and `ids` on request); the input's other
    columns are not read on. An empty table gives an empty result.
    """
    limit = capacity if max_loss is None else max_loss
    id_field = examples.schema[id_col]
    fields = [id_field, *PIECE.fields] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    id_type = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal id_type
        packer = Packer(capacity, max_segments, limit, TaskContext.get().partitionId() << 33)
        placed: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = [[p[0] for p in placed], [p[1] for p in placed], [len(p[2]) for p in placed],
                       [zlib.crc32(p[2].astype("<u4").tobytes()) for p in placed], [p[3] for p in placed], [p[4] for p in placed],
                       [p[5] for p in placed], [p[6] for p in placed]]
            arrays = [pa.array(c, id_type if k == 0 else pa.int64()) for k, c in enumerate(columns)]
            if with_ids:
                arrays.append(pa.array([p[2] for p in placed], pa.list_(pa.int32())))
            placed.clear()
            return pa.RecordBatch.from_arrays(arrays, [f.name for f in fields])

        for batch in slices(batches, text_col):
            id_type = batch.schema.field(id_col).type
            for key, (ids, loss) in zip(batch[id_col].to_pylist(), encode(batch), strict=True):
                placed.extend(packer.add(key, ids, loss))
                if len(placed) >= 10_000:
                    yield out()
        placed.extend(packer.close())
        if placed:
            yield out()

    return examples.select(*dict.fromkeys([id_col, text_col, *extra])).mapInArrow(run, T.StructType(fields))


def pack_texts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, **limits) -> DataFrame:
    """Packs whole texts (null: empty), tokenised with a word-end vocabulary; `end_id` follows each text. All tokens bear loss.

    The vocabulary's special strings inside a text become their special ids, as in the `tokenizers` library.
    """

    def encode(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, None]]:
        from plumbline.llm.tokens import tokenizer

        for ids in tokenizer(tokenizer_path).encode([t or "" for t in batch[text_col].to_pylist()]):
            yield np.append(ids, np.int32(end_id)), None

    return pack(docs, encode, id_col=id_col, text_col=text_col, **limits)


def pack_instructions(examples: DataFrame, tokenizer_path: str, *, id_col: str, prompt_col: str, answer_col: str, end_id: int = 1, **limits) -> DataFrame:
    """Packs instruction data: prompt and answer are one example, only the answer's tokens and the end bear loss."""

    def encode(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        from plumbline.llm.tokens import tokenizer

        code = tokenizer(tokenizer_path).encode
        parts = [pa.compute.struct_field(batch["example"], k).to_pylist() for k in (0, 1)]
        for prompt, answer in zip(*(code([t or "" for t in p]) for p in parts), strict=True):
            yield np.concatenate([prompt, answer, [end_id]]), np.repeat([False, True], [len(prompt), len(answer) + 1])

    rows = examples.select(id_col, F.struct(F.col(prompt_col).alias("prompt"), F.col(answer_col).alias("answer")).alias("example"),
                           F.concat(F.coalesce(prompt_col, F.lit("")), F.coalesce(answer_col, F.lit(""))).alias("size"))
    return pack(rows, encode, id_col=id_col, text_col="size", extra=("example",), **limits)
