"""Where keys of documents meet: which 64-bit keys do at least two documents have?

Each task packs the keys of its documents by part (five bytes a key, ids compressed), so tens of millions of keys travel
in a few hundred rows and meet in arrays. Keys that many documents of one task have travel as plain rows instead, so one
very common key cannot fill a part. A key is told apart by its part and its upper 40 bits: it may meet another by chance,
so what comes out is a set of candidates that lacks nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from plumbline.llm.common import mix, slices, texts_of

SLICE = 1_000_000
#: Keys in one part, and documents of one key in one task beyond which they travel as rows.
PACKED, ALONE = 1_000_000, 256


def parts_for(keys: int) -> int:
    return int(keys // PACKED) + 8


def place(keys: np.ndarray, parts: int) -> np.ndarray:
    """What stands for a key in the result: the part in the upper bits, 40 bits of the key in the lower ones."""
    return (((keys & np.uint64(0xFFFFFF)) % np.uint64(parts)).astype(np.int64) << 40) | (keys >> np.uint64(24)).astype(np.int64)


def pack_keys(docs: DataFrame, keys_of: Callable[[list[bytes | None]], list[np.ndarray]], parts: int) -> DataFrame:
    """Packed keys (part, tokens, ids, alone) of documents (id, text); negative parts hold keys that many documents of one task have.

    `keys_of` gives the distinct keys of each text. Of equal texts in one task only the first is looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tokens, ids, held = set(), [], [], 0
        press = zstandard.ZstdCompressor(level=1)

        def blob(part: int, t: np.ndarray, d: np.ndarray, alone: bool) -> tuple:
            order = np.argsort(d, kind="stable")
            high = t[order] >> np.uint64(24)
            return part, (high & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (high >> np.uint64(32)).astype(np.uint8).tobytes(), press.compress(np.diff(d[order], prepend=0).astype("<i8").tobytes()), alone

        def packed_parts(t: np.ndarray, d: np.ndarray, part: np.ndarray, alone: bool) -> list[tuple]:
            cuts = np.flatnonzero(np.diff(part)) + 1
            return [blob(int(p[0]), a, b, alone) for p, a, b in zip(np.split(part, cuts), np.split(t, cuts), np.split(d, cuts), strict=True)] if len(t) else []

        def out() -> pa.RecordBatch:
            nonlocal held
            t, d = np.concatenate(tokens), np.concatenate(ids)
            part = ((t & np.uint64(0xFFFFFF)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((t, part))
            t, d, part = t[order], d[order], part[order]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            many = np.repeat(np.diff(np.append(first, len(t))) > ALONE, np.diff(np.append(first, len(t))))
            rows: list[tuple] = []
            if many.any():  # with the part in the upper bits, like the tokens that come out of the parts
                key = place(t[many], parts)
                rows += [(-1 - int(key[k] % 997), key[k : k + 100_000].astype("<i8").tobytes(), d[many][k : k + 100_000].astype("<i8").tobytes(), True) for k in range(0, len(key), 100_000)]
                lead = np.zeros(len(t), bool)
                lead[first] = True
                lead[1:] |= lead[:-1]
                few = many & lead  # two of them stay in the part, so that other tasks' documents meet the key
                rows += packed_parts(t[few], d[few], part[few], True)
                t, d, part = t[~many], d[~many], part[~many]
            rows += packed_parts(t, d, part, False)
            tokens.clear()
            ids.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.bool_())], ["part", "tokens", "ids", "alone"])

        for piece in slices(batches, "text", SLICE):
            raws = texts_of(piece, "text")
            for key, raw, own in zip(piece["id"].to_pylist(), raws, keys_of(raws), strict=True):
                if not len(own) or key is None or (sign := xxhash.xxh3_128_digest(raw)) in seen:
                    continue
                seen.add(sign)
                tokens.append(own)
                ids.append(np.full(len(own), key, np.int64))
                held += len(own)
            if held >= 1_000_000:
                yield out()
        if held:
            yield out()

    return docs.mapInArrow(run, "part int, tokens binary, ids binary, alone boolean")


def shared_keys(packed: DataFrame, merge: bool = False) -> DataFrame:
    """Rows (token, id, weight) of keys that at least two documents have; see place().

    With `merge`, keys of one part that the same documents have are given as one key, whose weight is their number.
    """

    def meet(table: pa.Table) -> pa.Table:
        part, tokens, ids, apart = table["part"][0].as_py(), [], [], []
        for t, d, alone in zip(*(table[c].to_pylist() for c in ("tokens", "ids", "alone")), strict=True):
            if part < 0:
                tokens.append(np.frombuffer(t, "<i8"))
                ids.append(np.frombuffer(d, "<i8"))
                continue
            d = np.cumsum(np.frombuffer(zstandard.decompress(d), "<i8"))
            low, high = np.frombuffer(t, "<u4", len(d)), np.frombuffer(t, np.uint8, len(d), 4 * len(d))
            tokens.append(low.astype(np.int64) | (high.astype(np.int64) << 32))
            ids.append(d)
            if alone:
                apart.append(tokens[-1])
        t, d = np.concatenate(tokens), np.concatenate(ids)
        weight = np.ones(len(t), np.int64)
        if part >= 0:
            order = np.lexsort((d, t))
            t, d = t[order], d[order]
            same = np.concatenate([[False], t[1:] == t[:-1], [False]])
            both = same[1:] | same[:-1]
            t, d, weight = t[both], d[both], weight[both]
            if merge and len(t):
                first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
                sizes = np.diff(np.append(first, len(t)))
                who = np.add.reduceat(mix(d.astype(np.uint64) + np.uint64(1)), first) ^ mix(sizes.astype(np.uint64))
                if apart:  # rows of these keys lie elsewhere, too, so they keep their own names
                    lone = np.isin(t[first], np.concatenate(apart))
                    who[lone] = mix(t[first][lone].astype(np.uint64) ^ np.uint64(0x5DEECE66D))
                _, kept, count = np.unique(who, return_index=True, return_counts=True)
                number = np.zeros(len(first), np.int64)
                number[kept] = count
                weight = np.repeat(number, sizes)
                t, d, weight = t[weight > 0], d[weight > 0], weight[weight > 0]
            t = t | (part << 40)
        return pa.table([pa.array(t, pa.int64()), pa.array(d, pa.int64()), pa.array(weight, pa.int64())], ["token", "id", "weight"])

    return packed.groupBy("part").applyInArrow(meet, "token long, id long, weight long")
