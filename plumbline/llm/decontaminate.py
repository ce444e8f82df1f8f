"""Benchmark decontamination with one Aho-Corasick automaton over the words of test questions and answers.

Items and documents are normalised alike: A-Z to lower case, words are runs of letters, digits and non-ASCII characters.
Every window of `window` consecutive item words is a pattern (a shorter item is one pattern). The automaton runs over
word numbers, so one pass over a document gives hits in words, and word begins map them to offsets of the original text.

The items are read in blocks of bounded size. A block is one automaton; further blocks scan the documents again in the
same stage and add to the ranges found before, so any number of items works and no document is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.common import ascii_words, slices, texts_of

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Words of items in one automaton: 13 trie nodes per word at most, about 60 MB.
BLOCK_WORDS = 100_000


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


def automaton(items: list[tuple[str, list[bytes]]], window: int) -> tuple[_Numbers, ahocorasick.Automaton]:
    """Numbers of the item words (other words are 0) and the automaton; a pattern's value is (words, item ids)."""
    numbers, patterns = _Numbers(), {}
    for item, words in items:
        ids = [numbers.setdefault(w, len(numbers) + 1) for w in words]
        for at in range(max(1, len(ids) - window + 1)):
            patterns.setdefault(tuple(ids[at : at + window]), set()).add(item)
    found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for ids, names in patterns.items():
        found.add_word(ids, (len(ids), tuple(sorted(names))))
    found.make_automaton()
    return numbers, found


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for begin, end in sorted(ranges):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((begin, end))
    return out


def _blocks(items: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items with words, read partition by partition and handed on in blocks."""
    block, held = [], 0
    for item, text in items.select(items[item_col].cast("string"), text_col).toLocalIterator():
        words = ascii_words((text or "").encode("utf-8"))
        if not words or item is None:
            continue
        block.append((item, words))
        held += len(words)
        if held >= block_words:
            yield block
            block, held = [], 0
    if block:
        yield block


def scan(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
         window: int = 13, one_in: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds to every document row what it shares with the items; all other columns stay.

    n_words; n_hit (words inside any occurrence of a window); items (ids with occurring windows, as sorted strings);
    spans (character offsets in the original text, end exclusive, one per maximal run of hit words); contaminated
    (n_hit > 0 and at least one word in `one_in` is hit). Rows are judged one by one, so repeated rows and repeated ids are fine. A
    null or empty text has no words; items without words or id are ignored; with no items nothing is contaminated. A
    column of the documents that has the name of an added column is replaced.
    """
    added = ("n_words", "n_hit", "items", "spans", "contaminated")
    docs = docs.drop(*added)
    kept = docs.columns
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    ranges_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                           T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", span),
                           T.StructField("contaminated", T.BooleanType())])

    def step(block: list[tuple[str, list[bytes]]], first: bool, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, found = automaton(block, window) if block else (None, None)
            for piece in slices(batches, text_col):
                columns: dict[str, list] = {name: [] for name in added}
                before = [None] * piece.num_rows if first else list(zip(piece["items"].to_pylist(), piece["spans"].to_pylist(), strict=True))
                for raw, old in zip(texts_of(piece, text_col), before, strict=True):
                    words, ranges, names = ascii_words(raw), [], set()
                    if old:
                        names, ranges = set(old[0]), [(r["start"], r["end"]) for r in old[1]]
                    if words and found is not None:
                        for end, (size, who) in found.iter(tuple(map(numbers.__getitem__, words))):
                            ranges.append((end + 1 - size, end + 1))
                            names.update(who)
                    ranges = merged(ranges)
                    hit = sum(e - b for b, e in ranges)
                    columns["n_words"].append(len(words))
                    columns["n_hit"].append(hit)
                    columns["items"].append(sorted(names))
                    columns["contaminated"].append(hit > 0 and one_in * hit >= len(words))
                    if last and ranges:
                        at = [m.span() for m in WORD.finditer(raw)]
                        ranges = _characters(raw, [(at[b][0], at[e - 1][1]) for b, e in ranges])
                    columns["spans"].append([{"start": b, "end": e} for b, e in ranges])
                yield pa.RecordBatch.from_arrays(
                    [piece[c] for c in kept] + [pa.array(columns["n_words"], pa.int64()), pa.array(columns["n_hit"], pa.int64()), pa.array(columns["items"], pa.list_(pa.string())),
                                                pa.array(columns["spans"], ranges_type), pa.array(columns["contaminated"], pa.bool_())], [*kept, *added])

        return run

    blocks, first, out = _blocks(items, item_col, item_text_col, block_words), True, docs
    block = next(blocks, [])
    while block is not None:
        after = next(blocks, None)
        out = out.mapInArrow(step(block, first, after is None), schema)
        block, first = after, False
    return out


def _characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets, in ascending order, as character offsets."""
    out, at, chars = [], 0, 0
    for begin, end in spans:
        chars += len(raw[at:begin].decode("utf-8", "replace"))
        size = len(raw[begin:end].decode("utf-8", "replace"))
        out.append((chars, chars + size))
        at, chars = end, chars + size
    return out
