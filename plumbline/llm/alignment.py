"""Alignment of two tokenizers over the same texts: which tokens of A and B overlap, and where both end together.

Both token sequences of a text cover the same bytes, so their ends are two ascending lists. The merge of the two lists is cut by
diagonals: on the diagonal d a binary search finds how many of the first d merged ends belong to A, so the merge falls into pieces
of equal work that know nothing of each other, whatever the lengths of texts and tokens. A piece emits one overlap per
distinct end it merges (the stretch before that end lies in one token of A and one of B) and counts the ends that both
share; the counts, summed up over the pieces before, stitch groups that cross a border of pieces. The texts of one slice are
merged as one list, since the end of a text is an end of both.

Counts over the corpus: the distinct linked id pairs of every text are stored once and counted by Spark. At most HOT pairs hold
more than 1/HOT of all occurrences each; they and their counts go to all tasks, so no hot pair gathers in one task. All
other pairs are joined. Both ways give the same numbers.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import keep, slices, texts_of
from plumbline.llm.tokens import _byte_letters

PAIRS, TIMES = "__pairs", "__times"
#: Steps of the merge in one piece.
WORK = 65_536
#: Bytes of text aligned at a time (one long text may be more).
SLICE = 2_000_000
#: Upper bound of pairs whose counts are sent to all tasks.
HOT = 1 << 19
#: Distinct stretches kept by each worker and tokenizer; the store starts anew beyond this.
STORE = 250_000
#: Distinct pairs a task counts before it hands its counts on.
COUNTED = 2_000_000


# ---- merge path ----------------------------------------------------------------------------------------------------

def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Borders of pieces of `work` merged ends: how many ends of a and of b come before each; equal ends: a first."""
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(d - len(b), 0), np.minimum(d, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        up = open_.copy()
        up[open_] = a[middle[open_]] <= b[d[open_] - 1 - middle[open_]]
        low, high = np.where(up, middle + 1, low), np.where(open_ & ~up, middle, high)
    return low, d - low


def merge_piece(a: np.ndarray, b: np.ndarray, i0: int, i1: int, j0: int, j1: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One piece: overlaps as indices in a and b, shared ends of b before every end of a (from the piece's begin), and which ends of b are shared."""
    ends_a, ends_b = a[i0:i1], b[j0:j1]
    at_b = j0 + np.searchsorted(ends_b, ends_a, "left")
    at_a = i0 + np.searchsorted(ends_a, ends_b, "right")
    shared = (at_a > 0) & (a[np.maximum(at_a - 1, 0)] == ends_b)
    before = np.concatenate([[0], np.cumsum(shared)])
    alone = ~shared
    return np.concatenate([np.arange(i0, i1), at_a[alone]]), np.concatenate([at_b, np.arange(j0, j1)[alone]]), before[at_b - j0], shared


def align_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlaps (index in a, index in b) and the group of every token of a and of b. Both lists end in the same value."""
    i, j = diagonals(a, b, work)
    links_a, links_b, group_a, group_b, groups = [], [], np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), 0
    for i0, i1, j0, j1 in zip(i[:-1], i[1:], j[:-1], j[1:], strict=True):
        la, lb, before, shared = merge_piece(a, b, i0, i1, j0, j1)
        links_a.append(la)
        links_b.append(lb)
        closed = np.cumsum(shared)
        group_a[i0:i1] = groups + before
        group_b[j0:j1] = groups + closed - shared
        groups += int(closed[-1]) if len(closed) else 0
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(links_a), join(links_b), group_a, group_b


# ---- tokenizers ----------------------------------------------------------------------------------------------------

class Numbers(dict):
    """Numbers strings in the order of their first look-up."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, text: str) -> int:
        self.new.append(text)
        number = self[text] = len(self)
        return number


class Stretches:
    """Tokens of texts by stretches between which no token reaches; every distinct stretch is encoded once per store."""

    def __init__(self, cut: regex.Pattern, encode: Callable[[list[str]], list[list[int]]], token_bytes: list[bytes]):
        self.cut, self.encode_all, self.token_bytes = cut, encode, token_bytes
        self.sizes = np.array([len(t) for t in token_bytes], np.int64)
        self._reset()

    def _reset(self) -> None:
        self.numbers = Numbers()
        self.flat, self.begin, self.same = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)

    def _learn(self, new: list[str]) -> None:
        made, token = self.encode_all(new), self.token_bytes
        self.same = np.concatenate([self.same, [b"".join([token[i] for i in ids]) == s.encode() for ids, s in zip(made, new, strict=True)]])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(list(map(len, made)))])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(made), np.int32)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the number of ids of each text, and which texts the ids' bytes equal."""
        if len(self.numbers) > STORE:
            self._reset()
        number, rows = self.numbers.__getitem__, []
        for text in texts:
            row = self.cut.findall(text)
            rows.append(np.fromiter(map(number, row), np.int64, len(row)))
        if self.numbers.new:
            self._learn(self.numbers.new)
            self.numbers.new = []
        every = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        sizes = self.begin[every + 1] - self.begin[every]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.begin[every] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)].astype(np.int64)
        stops = np.cumsum([len(r) for r in rows]).astype(np.int64)
        upto = lambda values: np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], stops])])
        return ids, upto(sizes), upto(~self.same[every]) == 0


def byte_level(path: str) -> Stretches:
    """A byte-level BPE file. Its pre-tokenizer never joins what stands before white space with what follows."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    letters = _byte_letters()
    token_bytes = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        if all(c in letters for c in token):
            token_bytes[number] = bytes(letters[c] for c in token)
    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    return Stretches(regex.compile(r"\s*\S+|\s+"), lambda texts: [e.ids for e in coder.encode_batch_fast(texts, add_special_tokens=False)], token_bytes)


MARK = "▁"


def sentence_pieces(path: str) -> Stretches:
    """A sentencepiece BPE model that puts a blank before each text; no piece has a blank after another character, else texts stay whole."""
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [coder.id_to_piece(i) for i in range(coder.vocab_size())]
    token_bytes = [bytes([int(p[3:5], 16)]) if coder.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
    apart = not any(MARK in p.lstrip(MARK) for p in pieces)
    blank = [coder.piece_to_id(MARK)]

    def encode(stretches: list[str]) -> list[list[int]]:
        made = coder.encode([s[1:] for s in stretches], num_threads=1)
        return [blank if s == " " else ids for s, ids in zip(stretches, made, strict=True)]

    return Stretches(regex.compile(r" +[^ ]*" if apart else r"(?s:.+)"), encode, token_bytes)


_loaded: dict[tuple, Stretches] = {}


def _tokenizer(make: Callable[[str], Stretches], path: str) -> Stretches:
    if (make.__name__, path) not in _loaded:
        _loaded[make.__name__, path] = make(path)
    return _loaded[make.__name__, path]


# ---- operator ------------------------------------------------------------------------------------------------------

class Aligned:
    """Aligned texts of one slice, as flat arrays; texts that the tokens do not spell out have no tokens."""

    def __init__(self, texts: list[str], a: Stretches, b: Stretches, work: int):
        self.n = len(texts)
        given = np.array([bool(t) for t in texts], bool)
        joined = [" " + t for t in texts if t]
        ids_a, n_a, same_a = a.encode(joined)
        ids_b, n_b, same_b = b.encode(joined)
        same = same_a & same_b
        self.n_a, self.n_b = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        self.n_a[given], self.n_b[given] = n_a * same, n_b * same
        self.ids_a, self.ids_b = ids_a[np.repeat(same, n_a)], ids_b[np.repeat(same, n_b)]
        self.doc_a = np.repeat(np.arange(self.n), self.n_a)
        self.doc_b = np.repeat(np.arange(self.n), self.n_b)
        at_a, at_b, self.group_a, self.group_b = align_ends(np.cumsum(a.sizes[self.ids_a]), np.cumsum(b.sizes[self.ids_b]), work)
        self.link_a, self.link_b, self.link_doc = self.ids_a[at_a], self.ids_b[at_b], self.doc_a[at_a]
        self.n_links = np.bincount(self.link_doc, minlength=self.n)
        last = np.diff(self.group_b, append=self.group_b[-1] + 1 if len(self.group_b) else 0) > 0
        self.n_groups = np.bincount(self.doc_b[last], minlength=self.n)

    def spelled(self, words_a: list[bytes], words_b: list[bytes]) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of every text; the lists hold each id in decimal with either sign that may follow."""
        na, nb = len(self.ids_a), len(self.ids_b)
        tokens_of_b = np.bincount(self.group_b, minlength=int(self.group_a[-1]) + 1 if na else 0)
        tokens_of_a = np.bincount(self.group_a, minlength=int(self.group_b[-1]) + 1 if nb else 0)
        before_b = np.cumsum(tokens_of_b) - tokens_of_b  # tokens of b in earlier groups
        upto_a = np.cumsum(tokens_of_a)
        last_a = np.diff(self.group_a, append=-1) != 0
        last_b = np.diff(self.group_b, append=-1) != 0
        order = np.zeros(na + nb, np.int64)
        order[np.arange(na) + before_b[self.group_a]] = 2 * self.ids_a + last_a
        order[np.arange(nb) + upto_a[self.group_b]] = len(words_a) + 2 * self.ids_b + last_b
        words, at, out = words_a + words_b, 0, []
        codes = order.tolist()
        for size in (self.n_a + self.n_b).tolist():
            out.append(b"".join([words[c] for c in codes[at : at + size]])[:-1])
            at += size
        return out

    def pairs(self, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct links of each text: text, pair (id of a times the size of b, plus id of b), times."""
        span = int(self.link_a.max()) * wide + wide if len(self.link_a) else 1
        both, times = np.unique(self.link_doc * span + self.link_a * wide + self.link_b, return_counts=True)
        return both // span, both % span, times


def _packed(values: np.ndarray, begin: np.ndarray, kind: str) -> pa.Array:
    raw = values.astype(kind).tobytes()
    offsets = (begin * np.dtype(kind).itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begin) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw)])


def link(docs: DataFrame, path_a: str, path_b: str, *, text_col: str = "text", work: int = WORK, with_groups: bool = False) -> DataFrame:
    """Every row with n_a, n_b, n_groups, n_links, groups_sha256, and its distinct links packed in columns PAIRS and TIMES.

    Texts that are null, empty or not spelled out by the tokens of both have zeros and an empty digest. A pair is the id of A times
    the number of ids of B plus the id of B, as unsigned 64-bit integers; times are unsigned 32-bit. `with_groups` adds the
    groups as text. Repeated rows are kept; columns of the input with the names of results are replaced.
    """
    added = [("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()), ("n_links", T.LongType()), ("groups_sha256", T.StringType()),
             (PAIRS, T.BinaryType()), (TIMES, T.BinaryType())] + [("groups", T.StringType())] * with_groups
    names = [c for c in docs.columns if c not in dict(added)]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(*a) for a in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _tokenizer(byte_level, path_a), _tokenizer(sentence_pieces, path_b)
        wide = len(b.token_bytes)
        words_a = [f"{i}{sign}".encode() for i in range(len(a.token_bytes)) for sign in ",|"]
        words_b = [f"{i}{sign}".encode() for i in range(wide) for sign in ",;"]
        for batch in slices(batches, text_col, SLICE):
            found = Aligned([raw.decode("utf-8", "replace") if raw else "" for raw in texts_of(batch, text_col)], a, b, work)
            groups = found.spelled(words_a, words_b)
            doc, pair, times = found.pairs(wide)
            begin = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            made = [pa.array(x, pa.int64()) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
            made.append(pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups]))
            made += [_packed(pair, begin, "<u8"), _packed(times, begin, "<u4")]
            if with_groups:
                made.append(pa.array([g.decode() for g in groups], pa.string()))
            yield pa.RecordBatch.from_arrays([batch[c] for c in names] + made, schema.names)

    return docs.mapInArrow(run, schema)


def pair_counts(linked: DataFrame, wide: int) -> DataFrame:
    """(pair, count, best): in how many rows of `linked` each pair occurs, and whether none with the same id of A has a higher count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, waiting, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

        def fold() -> None:
            nonlocal pairs, counts, waiting, held
            every, place = np.unique(np.concatenate([pairs, *waiting]), return_inverse=True)
            weights = np.concatenate([counts, np.ones(held, np.int64)])
            pairs, counts, waiting, held = every, np.bincount(place, weights, len(every)).astype(np.int64), [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(counts)], ["pair", "count"])

        for batch in batches:
            for value in batch[PAIRS]:
                part = np.frombuffer(value.as_buffer(), "<u8") if value.is_valid else np.zeros(0, np.uint64)
                waiting.append(part)
                held += len(part)
                if held > COUNTED:
                    fold()
                    if len(pairs) > COUNTED:
                        yield out()
                        pairs, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        fold()
        if len(pairs):
            yield out()

    counted = linked.select(PAIRS).mapInArrow(run, "pair long, count long").groupBy("pair").agg(F.sum("count").alias("count"))
    counted = keep(counted.withColumn("a", F.expr(f"pair div {wide}")), "pair-counts")
    top = counted.groupBy("a").agg(F.max("count").alias("top"))
    return counted.join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, *, text_col: str = "text", work: int = WORK, hot: int = HOT, with_groups: bool = False) -> DataFrame:
    """Every row with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (see `link`), and with `groups` on request.

    The count of a pair is the number of rows that hold it linked. n_best counts a row's links whose count is the highest of their id of A,
    ties included; count_sum adds the counts up. An empty table gives an empty result. Rows need no id; a row that
    occurs twice counts twice. Columns of the input with the names of results, PAIRS, TIMES or `__row` are replaced.
    """
    from sentencepiece import SentencePieceProcessor

    wide = SentencePieceProcessor(model_file=path_b).vocab_size()
    linked = keep(link(docs, path_a, path_b, text_col=text_col, work=work, with_groups=with_groups).withColumn("__row", F.monotonically_increasing_id()), "linked")
    counts = keep(pair_counts(linked, wide), "pair-best")
    total = counts.agg(F.sum("count")).first()[0] or 0
    bound = total // hot + 1  # fewer than `hot` pairs reach it
    table = counts.where(F.col("count") >= bound).toArrow().sort_by("pair")
    keys, known, best = np.asarray(table["pair"]).astype(np.uint64), np.asarray(table["count"], np.int64), np.asarray(table["best"]).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(iter([batch]), PAIRS):
                yield look_up(piece)

    def look_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = np.asarray(batch["__row"])
        sizes = np.asarray(pa.compute.binary_length(batch[PAIRS]), np.int64) // 8
        pairs = np.concatenate([np.zeros(0, "<u8"), *(np.frombuffer(v.as_buffer(), "<u8") for v in batch[PAIRS])]).astype(np.uint64)
        times = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(v.as_buffer(), "<u4") for v in batch[TIMES])]).astype(np.int64)
        doc = np.repeat(np.arange(len(rows)), sizes)
        at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
        is_hot = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
        hot_at, hot_doc = at[is_hot], doc[is_hot]
        n_best, count_sum = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        np.add.at(n_best, hot_doc, times[is_hot] * best[hot_at])
        np.add.at(count_sum, hot_doc, times[is_hot] * known[hot_at])
        cold = ~is_hot
        n, m = len(rows), int(cold.sum())
        columns = [np.concatenate([rows, rows[doc[cold]]]), np.concatenate([-1 - rows, pairs[cold].astype(np.int64)]), np.concatenate([np.zeros(n, np.int64), times[cold]]),
                   np.concatenate([n_best, np.zeros(m, np.int64)]), np.concatenate([count_sum, np.zeros(m, np.int64)])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["__row", "pair", "times", "hot_best", "hot_sum"])

    parts = linked.select("__row", PAIRS, TIMES).mapInArrow(run, "__row long, pair long, times long, hot_best long, hot_sum long")
    rare = counts.where(F.col("count") < bound)
    zero = F.lit(0).cast("long")
    sums = parts.join(rare, "pair", "left").groupBy("__row").agg(
        F.sum(F.col("hot_best") + F.when(F.col("best"), F.col("times")).otherwise(zero)).alias("n_best"),
        F.sum(F.col("hot_sum") + F.coalesce(F.col("times") * F.col("count"), zero)).alias("count_sum"))
    wanted = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] + ["groups"] * with_groups
    kept = [c for c in docs.columns if c not in (*wanted, PAIRS, TIMES, "__row")]
    return linked.drop(PAIRS, TIMES, "n_best", "count_sum").join(sums, "__row").select(*kept, *wanted)
