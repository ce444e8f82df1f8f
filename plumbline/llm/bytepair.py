"""Byte-level BPE: encoding of whole texts into token ids and decoding back, with the merges of a public rank file.

A piece of text (a match of the vocabulary's pattern) is encoded without replaying its merges. An Aho-Corasick automaton
over the tokens, their bytes mapped to Latin-1, gives in one scan the longest token that begins at every byte. A walk then
takes the longest token that is *compatible* with the one before it, goes to shorter ones if it is not, and back if none
is left; positions from which no way leads on are marked, so each is left for good once and the walk is linear in the
piece. Two adjacent tokens are compatible if the merges would have made just these two from their bytes, which is found by
undoing their merges, latest first, and asking whether some merge across the border would have come earlier. Answers are
memoised. A sequence whose neighbours are all compatible is unique, and is what the merges produce.

Frequent pieces are encoded once: a text becomes an array of their numbers, and its ids are gathered from those of the
pieces. Long texts are cut into blocks where white space follows other characters: neither the pattern's matches nor its
look-ahead reach across such a place. For the pattern known to be so (`WORDS`), texts are also cut at their blanks into
stretches, which are numbered like pieces; the new ones of many texts are split into pieces at once.

New pieces that are short take each step together, as arrays: the longest tokens are found by going down the tokens' trie
from every byte at once, as far as tokens reach, and then all take one step of the walk, on or back. Long ones go alone.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator
from itertools import chain, compress

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.common import SLICE_BYTES, slices, texts_of

#: Memoised results in each worker: memory for stretches and for pieces with their ids (half each), and numbers of pairs.
STORE_BYTES = 96_000_000
STORE_PAIRS = 500_000
#: Slots (a power of two) for answers that arrays of pairs are looked up in; pairs that share a slot push each other out.
SLOTS = 1 << 20
#: Pieces of more bytes are walked alone; of shorter ones about so many bytes are walked together.
SHORT, TOGETHER = 64, 200_000
#: Characters of one text, and of several, whose pieces are held as Python objects at a time (the last block comes on top).
BLOCK, BLOCKS = 500_000, 500_000
CUT = regex.compile(r"(?<=\S)(?=\s)")
UNKNOWN = "�".encode()
#: No match of this pattern goes on from another character to white space. Texts of other patterns are not cut into stretches.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, file.read().splitlines()))}


def _splitter(pattern: str):
    """Cuts a text into the pattern's matches, by the letters and numbers that tiktoken's Unicode version knows.

    `regex` may know a later version; where a text holds a character on which the two differ, the classes are spelled out.
    """
    import tiktoken

    known = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    alphabet = {bytes([b]): b for b in range(256)}
    odd: set[str] = set()
    spelled = pattern
    for name in ("L", "N"):
        theirs = bytes(tiktoken.Encoding(name, pat_str=rf"\p{{{name}}}", mergeable_ranks=alphabet, special_tokens={}).encode_ordinary(known)).decode()
        ours = set(regex.findall(rf"\p{{{name}}}", known))
        more, fewer = ours.difference(theirs), set(theirs).difference(ours)
        odd |= more | fewer
        for sign, chars in (("--", more), ("||", fewer)):
            if chars:
                spelled = spelled.replace(rf"\p{{{name}}}", rf"[\p{{{name}}}{sign}[{''.join(map(regex.escape, sorted(chars)))}]]")
    plain = regex.compile(pattern)
    if not odd:
        return plain.findall
    exact = regex.compile(spelled, regex.V1)
    return lambda text: (plain if text.isascii() or odd.isdisjoint(text) else exact).findall(text)


class _Numbered(dict):
    """Numbers of texts, given when they are first asked for, and the ids of every numbered text."""

    def __init__(self) -> None:
        self.new: list[str] = []  # numbered, but their ids are not known yet
        self.flat, self.begin = np.zeros(0, "<u4"), np.zeros(1, np.int64)
        self.uses, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, text: str) -> int:
        number = self[text] = len(self)
        self.new.append(text)
        return number

    def numbers(self, texts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, texts), np.int64, len(texts))

    def learn(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """The ids of the new texts, one text after the other, and how many each has."""
        self.flat = np.concatenate([self.flat, flat.astype("<u4", copy=False)])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])
        self.bytes = np.concatenate([self.bytes, np.fromiter(map(len, self.new), np.int64, len(sizes)) + 4 * sizes + 200])
        self.new = []

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one text after the other, and where each text's end."""
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        sizes = (self.begin[1:] - self.begin[:-1])[numbers]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begin[numbers] - ends + sizes, sizes)
        at += np.arange(len(at))
        return self.flat[at], ends

    def packed(self, numbers: np.ndarray, cuts: list[int]) -> tuple[bytes, list[int]]:
        """The ids as bytes, and where in them the numbers at the cuts begin."""
        flat, ends = self.ids(numbers)
        return flat.tobytes(), (4 * np.concatenate([[0], ends]))[cuts].tolist()

    def trim(self, limit: float) -> None:
        """Beyond the limit, texts are forgotten but those used most, which take up to half of it; later uses count more."""
        if int(self.bytes.sum()) <= limit:
            return
        order = np.argsort(-self.uses, kind="stable")
        kept = np.sort(order[np.cumsum(self.bytes[order]) <= limit / 2])
        stays = np.zeros(len(self), bool)
        stays[kept] = True
        texts = list(compress(self, stays))
        flat, ends = self.ids(kept)
        self.clear()
        self.update(zip(texts, range(len(texts)), strict=True))
        self.flat, self.begin, self.uses, self.bytes = flat, np.concatenate([[0], ends]), self.uses[kept] // 2, self.bytes[kept]


def _slots(keys: np.ndarray, room: int) -> np.ndarray:
    """Where keys belong in a hash table whose size is a power of two."""
    return ((keys * 0x9E3779B1) >> 16) & (room - 1)


class BytePairs:
    """Encoder and decoder for one vocabulary of ranks. Every byte must be a token, and a token's parts must have lower ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.ranks, self.pattern = ranks, pattern
        size = max(ranks.values()) + 1
        self.token: list[bytes | None] = [None] * size
        for token, rank in ranks.items():
            self.token[rank] = token
        self._pairs: dict[int, bool] = {}
        self._left, self._right = [-1] * size, [-1] * size  # the last merge of every token that merges can make
        self._shorter = [-1] * size  # the longest token that begins it
        self._automaton = ahocorasick.Automaton()
        reachable: set[bytes] = set()
        for rank, token in enumerate(self.token):
            if token is None:
                continue
            if len(token) > 1:
                for cut in range(len(token) - 1, 0, -1):
                    left, right = ranks.get(token[:cut], size), ranks.get(token[cut:], size)
                    if token[:cut] in reachable and token[cut:] in reachable and self._undo(left, right, rank):
                        self._left[rank], self._right[rank] = left, right
                        break
                else:
                    if self._merges_to_one(token):
                        raise ValueError(f"the parts of token {rank} have higher ranks than itself")
                    continue  # no merge ends in it: only a whole piece can be this token
            reachable.add(token)
            self._automaton.add_word(token.decode("latin-1"), rank)
        for token in reachable:
            self._shorter[ranks[token]] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in reachable), -1)
        self._automaton.make_automaton()
        self._size = [len(token or b"") for token in self.token]
        self._sizes, self._shorter_than = np.array(self._size), np.array(self._shorter)
        self._slots: tuple[np.ndarray, np.ndarray] | None = None
        self._arrays: tuple[np.ndarray, ...] | None = None
        self._known = [token or UNKNOWN for token in self.token]
        self._split = None
        self._pieces, self._stretches = _Numbered(), _Numbered()

    def _merges_to_one(self, token: bytes) -> bool:
        """The merges themselves, for the few tokens that no two earlier tokens make."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[k] + parts[k + 1], len(self.token)), k) for k in range(len(parts) - 1))
            if rank == len(self.token):
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return True

    def _undo(self, left: int, right: int, limit: int | float) -> bool:
        """Whether merges of a rank below the limit leave the border between two tokens alone."""
        token, ranks, lefts, rights = self.token, self.ranks, self._left, self._right
        while True:
            across = ranks.get(token[left] + token[right])
            if across is not None and across < limit:
                return False
            age_left, age_right = left if lefts[left] >= 0 else -1, right if lefts[right] >= 0 else -1
            if age_left < 0 and age_right < 0:
                return True
            if age_left > age_right:
                limit, left = left, rights[left]
            else:  # of equal merges the left one comes first, so one across the border comes before the right token's own
                limit, right = right + 1, lefts[right]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merges make just these two tokens from their bytes; memoised."""
        key = left * len(self.token) + right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= STORE_PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self._undo(left, right, float("inf"))
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        stop = len(piece)
        longest = array("i", bytes(4 * stop))
        size, shorter, compatible, pairs, wide = self._size, self._shorter, self.compatible, self._pairs.get, len(self.token)
        for last, rank in self._automaton.iter(piece.decode("latin-1")):  # later matches from one place are longer
            longest[last + 1 - size[rank]] = rank
        closed, found, at, rank, before = bytearray(stop + 1), [], 0, longest[0], -1
        while at < stop:
            while rank >= 0:
                end = at + size[rank]
                if not closed[end]:
                    if before < 0:
                        break
                    fits = pairs(before * wide + rank)
                    if compatible(before, rank) if fits is None else fits:
                        break
                rank = shorter[rank]
            if rank >= 0:
                found.append(rank)
                at, before = end, rank
                rank = longest[at] if at < stop else -1
            else:
                closed[at] = 1
                rank = found.pop()
                at -= size[rank]
                before = found[-1] if found else -1
        return found

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`compatible` of many pairs."""
        if self._slots is None:
            self._slots = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, bool)
        held, answers = self._slots
        keys = left * len(self.token) + right
        slots = _slots(keys, SLOTS)
        found = answers[slots]
        missed = np.flatnonzero(held[slots] != keys)
        if len(missed):
            new, first, place = np.unique(keys[missed], return_index=True, return_inverse=True)
            at = missed[first]
            made = np.fromiter(map(self.compatible, left[at].tolist(), right[at].tolist()), bool, len(new))
            found[missed] = made[place]
            single = np.unique(slots[at], return_index=True)[1]
            held[slots[at[single]]], answers[slots[at[single]]] = new[single], made[single]
        return found

    def _trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The automaton's tokens as arrays: a hash table of edges (node * 256 + byte), the node below each, every node's token."""
        tokens = [key.encode("latin-1") for key in self._automaton.keys()]  # noqa: SIM118, no dict
        nodes = {b"": 0}
        for token in tokens:
            for n in range(1, len(token) + 1):
                nodes.setdefault(token[:n], len(nodes))
        new = np.fromiter((nodes[prefix[:-1]] * 256 + prefix[-1] for prefix in nodes if prefix), np.int64, len(nodes) - 1)
        below = np.arange(1, len(nodes))
        room = 1 << (4 * len(nodes)).bit_length()
        edges, under, slots = np.full(room, -1, np.int64), np.zeros(room, np.int64), _slots(new, room)
        while len(new):
            first = np.unique(slots, return_index=True)[1]
            first = first[edges[slots[first]] < 0]
            edges[slots[first]], under[slots[first]] = new[first], below[first]
            left = np.delete(np.arange(len(new)), first)
            new, below, slots = new[left], below[left], (slots[left] + 1) & (room - 1)
        token_of = np.full(len(nodes), -1, np.int64)
        token_of[[nodes[token] for token in tokens]] = [self.ranks[token] for token in tokens]
        return edges, under, token_of

    def _longest(self, data: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The longest token that begins at every byte and ends before its stop."""
        if self._arrays is None:
            self._arrays = self._trie()
        edges, under, token_of = self._arrays
        longest = np.full(len(data), -1, np.int64)
        begin = np.flatnonzero(stop > np.arange(len(data)))
        at, node = begin, np.zeros(len(begin), np.int64)
        while len(begin):
            edge = node * 256 + data[at]
            slots = _slots(edge, len(edges))
            held = edges[slots]
            other = np.flatnonzero((held != edge) & (held >= 0))
            while len(other):
                slots[other] = (slots[other] + 1) & (len(edges) - 1)
                held[other] = edges[slots[other]]
                other = other[(held[other] != edge[other]) & (held[other] >= 0)]
            on = np.flatnonzero(held == edge)
            begin, at, node = begin[on], at[on] + 1, under[slots[on]]
            token = token_of[node]
            ends = token >= 0
            longest[begin[ends]] = token[ends]
            on = at < stop[begin]
            begin, at, node = begin[on], at[on], node[on]
        return longest

    def _walk(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """`encode_piece` for many short pieces, which are no tokens: ids, one piece after the other, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        stop = np.cumsum(lengths + 1) - 1
        longest = self._longest(np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8), np.repeat(stop, lengths + 1))
        closed = np.zeros(len(longest), bool)
        found, depth = np.zeros((len(pieces), int(lengths.max())), np.int32), np.zeros(len(pieces), np.int64)
        going, at = np.arange(len(pieces)), stop - lengths
        rank, before = longest[at], np.full(len(pieces), -1)
        while len(going):
            end = at + self._sizes[rank]
            fits = rank >= 0
            fits[fits] = ~closed[end[fits]]
            pairs = np.flatnonzero(fits & (before >= 0))
            fits[pairs] = self._compatible(before[pairs], rank[pairs])
            on, back = np.flatnonzero(fits), np.flatnonzero(rank < 0)
            shorter = np.flatnonzero(~fits & (rank >= 0))
            found[going[on], depth[going[on]]] = rank[on]
            depth[going[on]] += 1
            before[on], at[on] = rank[on], end[on]
            rank[on] = longest[at[on]]
            rank[shorter] = self._shorter_than[rank[shorter]]
            closed[at[back]] = True
            depth[going[back]] -= 1
            level = depth[going[back]]
            rank[back] = found[going[back], level]
            at[back] -= self._sizes[rank[back]]
            before[back] = np.where(level > 0, found[going[back], level - 1], -1)
            left = at < stop[going]
            going, at, rank, before = going[left], at[left], rank[left], before[left]
        return found[np.arange(found.shape[1]) < depth[:, None]], depth

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many matches of the pattern, one match after the other, and how many each has."""
        known = np.fromiter((self.ranks.get(piece, -1) for piece in pieces), np.int64, len(pieces))
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, owners = [known[known >= 0]], [np.flatnonzero(known >= 0)]
        short = np.flatnonzero((known < 0) & (lengths <= SHORT))
        groups = np.cumsum(lengths[short]) // TOGETHER
        for some in np.split(short, np.flatnonzero(np.diff(groups)) + 1) if len(short) else []:
            made, sizes = self._walk([pieces[k] for k in some.tolist()])
            ids.append(made)
            owners.append(np.repeat(some, sizes))
        for k in np.flatnonzero((known < 0) & (lengths > SHORT)).tolist():
            ids.append(np.array(self.encode_piece(pieces[k]), np.int64))
            owners.append(np.full(len(ids[-1]), k))
        owner = np.concatenate(owners)
        return np.concatenate(ids)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(pieces))

    def _learn_pieces(self) -> None:
        self._pieces.learn(*self.encode_pieces([piece.encode() for piece in self._pieces.new]))

    def _learn_stretches(self) -> None:
        """Stretches that cannot stand before a blank, as they are empty or end in white space, are left without ids."""
        new = self._stretches.new
        even = np.fromiter((not text[-1:].isspace() and text != "" for text in new), bool, len(new))
        texts = list(compress(new, even))
        pieces = self._split("".join([f" {text}" for text in texts]))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        numbers = self._pieces.numbers(pieces)
        self._learn_pieces()
        flat, stops = self._pieces.ids(numbers)
        last = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
        sizes = np.zeros(len(new), np.int64)
        sizes[even] = np.diff(stops[last], prepend=0)
        self._stretches.learn(flat, sizes)

    def _blocks(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that together fit into memory as Python objects.

        A text is the pieces of its first word, stretches (each with the blank before it), and the pieces of its last word.
        """
        self._pieces.trim(STORE_BYTES / 2)
        self._stretches.trim(STORE_BYTES / 2)
        ends, middle = [], []
        for text in texts:
            words = text.split(" ") if self.pattern == WORDS else []
            ends.append((words[0], f" {words[-1]}") if len(words) > 2 else (text, ""))
            middle.append(self._stretches.numbers(words[1:-1]))
        self._learn_stretches()
        uneven = np.diff(self._stretches.begin) == 0
        pieces, cuts = [], [0]
        for k, text in enumerate(texts):
            if uneven[middle[k]].any():
                ends[k], middle[k] = (text, ""), middle[k][:0]
            for part in ends[k]:
                pieces += self._split(part)
                cuts.append(len(pieces))
        numbers = self._pieces.numbers(pieces)
        self._learn_pieces()
        outer, at = self._pieces.packed(numbers, cuts)
        inner, into = self._stretches.packed(np.concatenate(middle), np.cumsum([0, *map(len, middle)]))
        return [outer[at[2 * k] : at[2 * k + 1]] + inner[into[k] : into[k + 1]] + outer[at[2 * k + 1] : at[2 * k + 2]] for k in range(len(texts))]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, each id as a little-endian unsigned 32-bit integer."""
        if self._split is None:
            self._split = _splitter(self.pattern)
        made: list[list[bytes]] = [[] for _ in texts]
        rows, blocks, held = [], [], 0
        for row, text in enumerate(texts):
            at = 0
            while at < len(text):
                cut = CUT.search(text, at + BLOCK) if len(text) - at > BLOCK else None
                end = cut.start() if cut else len(text)
                rows.append(row)
                blocks.append(text[at:end])
                held, at = held + end - at, end
                if held >= BLOCKS:
                    for k, part in zip(rows, self._blocks(blocks), strict=True):
                        made[k].append(part)
                    rows, blocks, held = [], [], 0
        for k, part in zip(rows, self._blocks(blocks) if blocks else [], strict=True):
            made[k].append(part)
        return [b"".join(parts) for parts in made]

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids; an id outside the vocabulary gives U+FFFD."""
        known, size = self._known, len(self._known)
        if len(ids) and not 0 <= int(ids.min()) <= int(ids.max()) < size:
            return b"".join([known[i] if 0 <= i < size else UNKNOWN for i in ids.tolist()])
        return b"".join(map(known.__getitem__, ids.tolist()))


_loaded: dict[tuple[str, str], BytePairs] = {}


def coder(path: str, pattern: str) -> BytePairs:
    """One per worker process, file and pattern."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = BytePairs(read_ranks(path), pattern)
    return _loaded[path, pattern]


def _with(batch: pa.RecordBatch, name: str, values: pa.Array, names: list[str]) -> pa.RecordBatch:
    columns = {c: batch[c] for c in batch.schema.names} | {name: values}
    return pa.RecordBatch.from_arrays([columns[c] for c in names], names)


def encode(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids", packed: bool = False) -> DataFrame:
    """All rows with the ids of their texts in a new last column: an array of ints, or `packed` into bytes.

    A packed id is a little-endian unsigned 32-bit integer. A null text counts as empty and an empty text has no ids (an empty
    array, or empty bytes). Repeated rows are encoded as often as they occur. A column that is already called `ids_col` is
    replaced; all others stay. Bytes that are no UTF-8 are read as U+FFFD. Special tokens are not known: their strings are
    plain text. Rows stay in their partitions; a task holds about 4 MB of texts (or one longer text) at a time.
    """
    names = [c for c in docs.columns if c != ids_col] + [ids_col]
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([docs.schema[c] for c in names[:-1]] + [T.StructField(ids_col, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in slices(batches, text_col):
            made = own.encode_all([raw.decode("utf-8", "replace") if raw else "" for raw in texts_of(batch, text_col)])
            if packed:
                values = pa.array(made, pa.binary())
            else:
                offsets = np.cumsum([0, *(len(m) // 4 for m in made)]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), "<i4")))
            yield _with(batch, ids_col, values, names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, *, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """All rows with the bytes of their ids (an array of ints or packed, see `encode`) in a new last column.

    Null ids give null; a null in an array and an id outside the vocabulary give U+FFFD. A column that is already called
    `bytes_col` is replaced; all others stay.
    """
    names = [c for c in encoded.columns if c != bytes_col] + [bytes_col]
    schema = T.StructType([encoded.schema[c] for c in names[:-1]] + [T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            ids = batch[ids_col]
            binary = pa.types.is_binary(ids.type) or pa.types.is_large_binary(ids.type)
            sizes = pa.compute.fill_null(pa.compute.binary_length(ids) if binary else pa.compute.multiply(pa.compute.list_value_length(ids), 4), 0)
            ends = np.cumsum(np.asarray(sizes, np.int64))
            cuts = np.searchsorted(ends, np.arange(SLICE_BYTES, ends[-1] if len(ends) else 0, SLICE_BYTES))
            for begin, end in zip([0, *np.unique(cuts)], [*np.unique(cuts), batch.num_rows], strict=True):
                if end > begin:
                    piece = batch.slice(begin, end - begin)
                    made = []
                    for value in piece[ids_col]:
                        if not value.is_valid:
                            made.append(None)
                        else:
                            row = np.frombuffer(value.as_py(), "<u4").astype(np.int64) if binary else np.asarray(value.values.fill_null(-1), np.int64)
                            made.append(own.decode(row))
                    yield _with(piece, bytes_col, pa.array(made, pa.binary()), names)

    return encoded.mapInArrow(run, schema)
