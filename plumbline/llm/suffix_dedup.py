"""Removal of byte strings that an earlier document has, by external induced suffix sorting.

Every window of `length` bytes has an anchor: its leftmost smallest k-gram by hash. Equal windows have equal anchors, so
only documents that meet at an anchor can share a window. Runs of windows with one anchor are segments. Equal segments
(by anchor and a digest of 64 bits; at one anchor only the digest tells segments apart, so n different ones there hold a
wrong pair with odds of about n * n / 2^65) are folded: the first document keeps, all others give. Where documents have different
segments at one anchor (at the borders of what they share) the windows of these segments are compared by suffix sorting:
shards of whole anchors lie in scratch files of the task, are sorted with disk-backed queues, and windows whose
common-prefix values reach `length` are one class with one first document. Segments that have too little about their
anchor in common with any other document's are left out of the sort, as no window of theirs can be shared.

Anchors and digests travel packed by part, 13 bytes a segment. Of equal segments in one task only the first document's
goes on, so a passage that every document has costs one entry a task.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import induced, meeting
from plumbline.llm.common import BASE, BYTE_VALUES, INVERSE, keep, map_slices, mix, slices, texts_of

GRAM = 16
#: Bytes looked at together; also the longest stretch of one text in which positions are compared.
STRETCH = 1 << 20
#: Bytes of segments in one shard: sorted in memory up to here, from scratch files beyond.
SHARD = 3_000_000
#: Depths of an anchor in a window that are looked at together before sorting.
BAND = 9


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes that begin at each place, by doubling."""
    parts, reach, out, done = BYTE_VALUES[data], 1, None, 0
    power = lambda k: np.uint64(pow(BASE, k, 1 << 64))
    while True:
        if size & reach:
            if out is None:
                out, done = parts, reach
            else:
                n = len(data) - done - reach + 1
                out, done = parts[:n] * power(done) + out[reach : reach + n], done + reach
        if reach * 2 > size:
            return mix(out)
        parts, reach = parts[:-reach] * power(reach) + parts[reach:], reach * 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours."""
    reach = 1
    while reach * 2 <= width:
        values, reach = np.minimum(values[:-reach], values[reach:]), reach * 2
    rest = width - reach
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit digests of byte ranges."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * UP[: len(data)], out=total[1:])
    return mix(((total[end] - total[begin]) * DOWN[begin]) ^ (end - begin).astype(np.uint64))


UP = np.multiply.accumulate(np.array([1] + [BASE] * (2 * STRETCH), np.uint64))
DOWN = np.multiply.accumulate(np.array([1] + [INVERSE] * (2 * STRETCH), np.uint64))


def segments(raws: list[bytes], length: int, parts: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, first window, windows, token, digest) of all runs of windows with one anchor, in several batches.

    The token stands for the anchor, see meeting.place().
    """
    for *columns, _ in anchored(raws, length, parts):
        yield tuple(columns)


def anchored(raws: list[bytes], length: int, parts: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of segments(), and the place of the anchor in the segment."""
    pieces = [(k, at, raw[at : at + STRETCH + length - 1]) for k, raw in enumerate(raws) for at in range(0, max(0, len(raw) - length + 1), STRETCH)]
    at = 0
    while at < len(pieces):
        end, held = at, 0
        while end < len(pieces) and (end == at or held + len(pieces[end][2]) <= STRETCH):
            held += len(pieces[end][2])
            end += 1
        part = pieces[at:end]
        at = end
        data = np.frombuffer(b"".join(p[2] for p in part), np.uint8)
        sizes = np.array([len(p[2]) for p in part])
        begin = np.cumsum(sizes) - sizes
        hashes = _gram_hashes(data, min(GRAM, length))
        packed = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (_least(packed, length - min(GRAM, length) + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        windows = sizes - length + 1
        owner = np.repeat(np.arange(len(part)), windows)
        window = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        own = anchor[begin[owner] + window]
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (owner[1:] != owner[:-1])]))
        who, count = owner[first], np.diff(np.append(first, len(own)))
        place = begin[who] + window[first]
        yield (np.array([p[0] for p in part])[who], window[first] + np.array([p[1] for p in part])[who], count,
               meeting.place(hashes[own[first]], parts), _spans(data, place, place + count + length - 1).astype(np.int64), own[first] - place)


def _key(token: np.ndarray, digest: np.ndarray, who: np.ndarray) -> np.ndarray:
    """One value for (segment, text number), to look up many texts' segments at once."""
    return mix(mix(mix(token.astype(np.uint64)) ^ digest.astype(np.uint64)) + mix(who.astype(np.uint64) + np.uint64(7)))


def _among(asked: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values asked for are in the sorted array; their places in it, -1 for the others."""
    if not len(known):
        return np.full(len(asked), -1, np.int64)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, at, -1)


def _pairs(blobs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, token, digest) of the packed pairs of each text."""
    flat = [np.frombuffer(b"".join(own), "<i8").reshape(-1, 2) for own in blobs]
    who = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
    both = np.concatenate(flat) if flat else np.zeros((0, 2), np.int64)
    return who, both[:, 0], both[:, 1]


def _five(values: np.ndarray) -> bytes:
    return (values & 0xFFFFFFFF).astype("<u4").tobytes() + (values >> 32).astype(np.uint8).tobytes()


def _unfive(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u4", n).astype(np.int64) | (np.frombuffer(raw, np.uint8, n, 4 * n).astype(np.int64) << 32)


def _by_id(kind: int, ids: np.ndarray, tokens: np.ndarray, digests: np.ndarray) -> list[tuple[int, int, bytes]]:
    order = np.argsort(ids, kind="stable")
    ids, both = ids[order], np.stack([tokens[order], digests[order]], axis=1).astype("<i8")
    cuts = np.flatnonzero(np.diff(ids)) + 1
    return [(kind, int(i[0]), b.tobytes()) for i, b in zip(np.split(ids, cuts), np.split(both, cuts), strict=True)] if len(ids) else []


EQUAL, BORDER = 0, 1


def _met(docs: DataFrame, length: int, parts: int) -> DataFrame:
    """(kind, id, pairs): packed (token, digest) of segments that an earlier document has (EQUAL), and of the first
    document's segments at anchors where documents differ (BORDER)."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        press = zstandard.ZstdCompressor(level=1)

        def out() -> pa.RecordBatch:
            token, digest, ids = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((ids, digest, token))
            token, digest, ids = token[order], digest[order], ids[order]
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (digest[1:] != digest[:-1])])
            owner = ids[np.flatnonzero(new)[np.cumsum(new) - 1]]
            given = ids > owner
            rows = [(-1 - i % 997, b"", b"", b"", i, pairs) for _, i, pairs in _by_id(EQUAL, ids[given], token[given], digest[given])]
            token, digest, ids = token[new], digest[new], ids[new]
            part = token >> 40
            order = np.lexsort((ids, part))
            token, digest, ids, part = token[order], digest[order], ids[order], part[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            for p, t, d, i in zip(np.split(part, cuts), np.split(token, cuts), np.split(digest, cuts), np.split(ids, cuts), strict=True):
                rows.append((int(p[0]), _five(t & ((1 << 40) - 1)), d.astype("<i8").tobytes(), press.compress(np.diff(i, prepend=0).astype("<i8").tobytes()), None, None))
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "tokens", "digests", "ids", "id", "pairs"])

        count = 0
        for piece in slices(batches, "text", STRETCH):
            ids, raws = [], []
            for key, raw in zip(piece["id"].to_pylist(), texts_of(piece, "text"), strict=True):
                sign = xxhash.xxh3_128_digest(raw)
                if len(raw) >= length and seen.get(sign, key + 1) > key:
                    seen[sign] = key
                    ids.append(key)
                    raws.append(raw)
            names = np.array(ids, np.int64)
            for who, _, _, token, digest in segments(raws, length, parts):
                held.append((token, digest, names[who]))
                count += len(who)
            if count >= 2_000_000:
                yield out()
                count = 0
        if held:
            yield out()

    def meet(table: pa.Table) -> pa.Table:
        if table["part"][0].as_py() < 0:
            return pa.table([pa.array([EQUAL] * table.num_rows, pa.int32()), table["id"], table["pairs"]], ["kind", "id", "pairs"])
        parts_ = []
        for t, d, z in zip(*(table[c].to_pylist() for c in ("tokens", "digests", "ids")), strict=True):
            i = np.cumsum(np.frombuffer(zstandard.decompress(z), "<i8"))
            parts_.append((_unfive(t, len(i)), np.frombuffer(d, "<i8"), i))
        token, digest, ids = (np.concatenate(c) for c in zip(*parts_, strict=True))
        token = token | (table["part"][0].as_py() << 40)
        order = np.lexsort((ids, digest, token))
        token, digest, ids = token[order], digest[order], ids[order]
        anchor = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(anchor, len(token)))
        several = np.repeat(np.minimum.reduceat(ids, anchor) < np.maximum.reduceat(ids, anchor), sizes)
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (digest[1:] != digest[:-1])])
        differ = several & np.repeat(np.add.reduceat(new.astype(np.int64), anchor) > 1, sizes)
        given, border = ids > ids[np.flatnonzero(new)[np.cumsum(new) - 1]], new & differ
        rows = _by_id(EQUAL, ids[given], token[given], digest[given]) + _by_id(BORDER, ids[border], token[border], digest[border])
        columns = list(zip(*rows, strict=True)) or [()] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.int64(), pa.binary()], strict=True)], ["kind", "id", "pairs"])

    packed = docs.mapInArrow(collect, "part int, tokens binary, digests binary, ids binary, id long, pairs binary")
    return packed.groupBy("part").applyInArrow(meet, "kind int, id long, pairs binary")


def _compressed(docs: DataFrame) -> DataFrame:
    """(id, packed text), so that texts travel small."""

    def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3)
        return pa.RecordBatch.from_arrays([batch["id"], pa.array([press.compress(r) for r in texts_of(batch, "text")], pa.binary())], ["id", "packed"])

    return map_slices(docs, "text", handle, "id long, packed binary")


def may_share(text: np.ndarray, size: np.ndarray, anchor: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Which segments may share a window with another document's; segments lie one after the other, each with an end mark.

    Equal windows hold their anchor at the same depth. Windows that hold it at one of the depths of a band all hold the bytes
    that these depths have in common, so a segment whose bytes of no band occur in another document's shares no window.
    """
    gram, n = min(GRAM, length), len(size)
    low = np.arange(0, length - gram + 1, BAND)
    high = np.minimum(low + BAND - 1, length - gram)
    start, keys = np.cumsum(size) - size, np.zeros((len(low), n), np.uint64)
    step = max(1, STRETCH // (2 * length))  # a segment has fewer than 2 * length bytes
    for k in range(0, n, step):
        base, own = start[k], slice(k, k + step)
        data = np.asarray(text[base : base + size[own].sum()])
        at = start[own] - base + anchor[own]
        begin, end = np.maximum(at - low[:, None], 0), np.minimum(at + (length - high)[:, None], len(data))
        keys[:, own] = _spans(data, begin.ravel(), end.ravel()).reshape(begin.shape)
    found = np.zeros(n, bool)
    for k in range(len(low)):
        mine = np.flatnonzero((anchor >= low[k]) & (anchor - (size - length) < high[k]))  # windows hold the anchor from anchor down
        if not len(mine):
            continue
        mine = mine[np.argsort(keys[k, mine])]
        first = np.flatnonzero(np.concatenate([[True], keys[k, mine[1:]] != keys[k, mine[:-1]]]))
        several = np.minimum.reduceat(doc[mine], first) < np.maximum.reduceat(doc[mine], first)
        found[mine[np.repeat(several, np.diff(np.append(first, len(mine))))]] = True
    return found


def _sorted_shards(pieces: DataFrame, length: int, memory: int, inner: int) -> DataFrame:
    """Suffix-sorts each partition's segments. (id, token, digest, ranges): windows of a segment that an earlier document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            sizes, docs, names, anchors = [], [], [], []
            with open(f"{folder}/all", "wb") as file:
                for batch in batches:
                    for raw in batch["bytes"].to_pylist():
                        file.write(raw + b"\xff")
                        sizes.append(len(raw) + 1)
                    docs.append(np.asarray(batch["id"]))
                    names.append(np.stack([np.asarray(batch["token"]), np.asarray(batch["digest"])], axis=1))
                    anchors.append(np.asarray(batch["anchor"]))
            if not sizes:
                return
            whole, size = np.memmap(f"{folder}/all", np.uint8, "r"), np.array(sizes)
            doc, name = np.concatenate(docs), np.concatenate(names)
            kept = may_share(whole, size, np.concatenate(anchors), doc, length)
            if not kept.any():
                return
            with open(f"{folder}/text", "wb") as file:
                edge = np.cumsum(size)
                for k in range(0, len(size), 20_000):
                    own = slice(k, k + 20_000)
                    file.write(whole[edge[k] - size[k] : edge[own][-1]][np.repeat(kept[own], size[own])].tobytes())
            doc, name, size = doc[kept], name[kept], size[kept]
            text, end = np.memmap(f"{folder}/text", np.uint8, "r"), np.cumsum(size)
            earliest = induced.array(folder, "earliest", len(text), np.int64)
            for positions, common in induced.suffixes(text, folder, length, memory, inner):
                new = np.flatnonzero(common < length)
                who = np.searchsorted(end, positions, "right")
                low = np.minimum.reduceat(doc[who], new)
                earliest[positions] = np.repeat(low, np.diff(np.append(new, len(positions))))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))]
            start = end - size
            for k in range(0, len(size), 20_000):  # the windows of many segments at a time
                own, low, high = size[k : k + 20_000], int(start[k]), int(end[min(k + 20_000, len(size)) - 1])
                within = np.arange(high - low) - np.repeat(start[k : k + 20_000] - low, own)
                taken = (np.asarray(earliest[low:high]) < np.repeat(doc[k : k + 20_000], own)) & (within < np.repeat(own - length, own))
                turn = np.diff(taken.astype(np.int8), prepend=0, append=0)
                begin, stop = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
                if not len(begin):
                    continue
                who = np.searchsorted(end, begin + low, "right")
                first = start[who] - low
                cuts = np.flatnonzero(np.diff(who)) + 1
                ranges = [[{"low": a, "high": b} for a, b in zip(x.tolist(), y.tolist(), strict=True)] for x, y in zip(np.split(begin - first, cuts), np.split(stop - first, cuts), strict=True)]
                which = who[np.concatenate([[0], cuts])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((doc[which], name[which, 0], name[which, 1], ranges), kinds, strict=True)], ["id", "token", "digest", "ranges"])

    return pieces.mapInArrow(run, "id long, token long, digest long, ranges array<struct<low: long, high: long>>")


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 50, with_kept: bool = False, shard_bytes: int = SHARD,
         memory: int = induced.MEMORY, inner: int = 3 * induced.INNER) -> DataFrame:
    """One row per document: id, n_bytes, spans (removed byte ranges array<struct<start, end>>, maximal), kept_sha256 (and kept).

    A byte is removed if a string of `length` bytes that covers it also begins in a document with a smaller id; strings are
    judged on the input. Null texts count as empty. Ids are whole numbers; rows with a null id neither give nor take. Rows
    that repeat id and text are one document (each gets the result); one id must not stand for different texts.
    """
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sized = F.octet_length("text").cast("long")
    facts = keep(given.select("id", sized.alias("n_bytes"), F.unhex(F.md5("text")).alias("sign"), F.sha2("text", 256).alias("whole_sha256")), "text-facts")
    reps = keep(facts.where("id is not null").groupBy("sign", "n_bytes").agg(F.min("id").alias("rep")), "distinct-texts")
    parts = meeting.parts_for((reps.agg(F.sum("n_bytes")).first()[0] or 0) // 12)
    met = keep(_met(given.where("id is not null"), length, parts), "met-segments").join(reps.select(F.col("rep").alias("id")), "id", "left_semi")
    packed = _compressed(given.where("id is not null"))
    border = met.where(F.col("kind") == BORDER).groupBy("id").agg(F.collect_list("pairs").alias("pairs"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws, ids = [zstandard.decompress(p) for p in batch["packed"].to_pylist()], batch["id"].to_pylist()
        who, token, digest = _pairs(batch["pairs"].to_pylist())
        wanted, rows = np.sort(_key(token, digest, who)), []
        open_ = np.ones(len(wanted), bool)  # a segment that stands twice in a text is sorted once
        for text, first, windows, token, digest, anchor in anchored(raws, length, parts):
            at = _among(_key(token, digest, text), wanted)
            mine = np.flatnonzero((at >= 0) & open_[at] if len(wanted) else np.zeros(len(at), bool))
            mine = mine[np.sort(np.unique(at[mine], return_index=True)[1])]
            open_[at[mine]] = False
            for t, f, n, x, d, a in zip(*(c[mine].tolist() for c in (text, first, windows, token, digest, anchor)), strict=True):
                rows.append((x, d, ids[t], a, raws[t][f : f + n + length - 1]))
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)], ["token", "digest", "id", "anchor", "bytes"])

    amount = met.where(F.col("kind") == BORDER).agg(F.sum(F.length("pairs"))).first()[0] or 0
    shards = max(1, -(-int(amount) // 16 * (length + 20) // shard_bytes))
    pieces = map_slices(packed.join(border, "id").dropDuplicates(["id"]), "packed", cut, "token long, digest long, id long, anchor long, bytes binary", 1_000_000)
    ranges = keep(_sorted_shards(pieces.repartition(shards, "token"), length, memory, inner), "border-ranges")
    equal = met.where(F.col("kind") == EQUAL).groupBy("id").agg(F.collect_list("pairs").alias("pairs"))
    partly = ranges.groupBy("id").agg(F.collect_list(F.struct("token", "digest", "ranges")).alias("parts"))
    taken = equal.join(partly, "id", "full")
    span = "array<struct<start: long, end: long>>"

    def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = [zstandard.decompress(p) for p in batch["packed"].to_pylist()]
        who, token, digest = _pairs([p or [] for p in batch["pairs"].to_pylist()])
        whole = np.sort(_key(token, digest, who))
        parts_of = [(k, p["token"], p["digest"], p["ranges"]) for k, own in enumerate(batch["parts"].to_pylist()) for p in own or ()]
        columns = [np.array([p[c] for p in parts_of], np.int64) for c in (1, 2, 0)]
        some = _key(*columns)
        order = np.argsort(some)
        some = some[order]
        base = np.cumsum([0] + [len(raw) + 1 for raw in raws])
        edge = np.zeros(base[-1], np.int64)
        for text, first, windows, token, digest in segments(raws, length, parts):
            keys = _key(token, digest, text)
            all_of = np.flatnonzero(_among(keys, whole) >= 0)
            begin = base[text[all_of]] + first[all_of]
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + windows[all_of] + length - 1, -1)
            at = _among(keys, some)
            for k in np.flatnonzero(at >= 0).tolist():
                begin = int(base[text[k]] + first[k])
                for r in parts_of[order[at[k]]][3]:
                    edge[begin + r["low"]] += 1
                    edge[begin + r["high"] + length - 1] -= 1
        edges = [edge[a:b] for a, b in zip(base[:-1], base[1:], strict=True)]
        spans, kept = [], []
        for raw, edge in zip(raws, edges, strict=True):
            gone = np.cumsum(edge)[:-1] > 0
            turn = np.diff(gone.astype(np.int8), prepend=0, append=0)
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True)])
            kept.append(np.frombuffer(raw, np.uint8)[~gone].tobytes())
        return pa.RecordBatch.from_arrays([batch["id"], pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                                           pa.array(kept if with_kept else [None] * len(kept), pa.binary())], ["rep", "spans", "sha256", "kept"])

    changed = map_slices(packed.join(taken, "id").dropDuplicates(["id"]), "packed", apply, f"rep long, spans {span}, sha256 string, kept binary", 1_000_000)
    if not with_kept:
        changed = changed.drop("kept")
    copy = (F.col("id") > F.col("rep")) & (F.col("n_bytes") >= length)
    first = F.coalesce(F.col("id") == F.col("rep"), F.lit(False))
    out = facts.join(reps, ["sign", "n_bytes"], "left").join(changed.withColumnRenamed("rep", "done"), F.col("rep") == F.col("done"), "left")
    nothing = F.array().cast(span)
    spans = F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))).when(first & F.col("spans").isNotNull(), F.col("spans")).otherwise(nothing)
    sha = F.when(copy, F.sha2(F.lit(""), 256)).when(first & F.col("spans").isNotNull(), F.col("sha256")).otherwise(F.col("whole_sha256"))
    columns = [F.col("id").alias(id_col), "n_bytes", spans.alias("spans"), sha.alias("kept_sha256")]
    if with_kept:
        out = out.join(given.select(F.col("id").alias("own"), F.encode("text", "utf-8").alias("own_text")).dropDuplicates(["own"]), F.col("id") == F.col("own"), "left")
        columns.append(F.when(copy, F.lit(b"")).when(first & F.col("spans").isNotNull(), F.col("kept")).otherwise(F.col("own_text")).alias("kept"))
    return out.select(*columns)
