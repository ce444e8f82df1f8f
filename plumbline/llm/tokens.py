"""Token ids of whole texts under a public word-end BPE vocabulary, fast for text with repeated words.

The ids equal those of the `tokenizers` library for the same file with add_special_tokens=False: nothing is put around a text,
and the file's special strings inside it become their own ids. No other token of such a vocabulary spans white space, so each distinct stretch between blanks is encoded once and texts are put
together from the parts. The merges run in `tiktoken`: a word is followed by the letter Z, which cannot occur in lower-cased text
and stands for the end-of-word mark.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import regex
import tiktoken

#: Fixed by the vocabulary file: its pre-tokenizer, with its class of white space written out.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = regex.compile(rf"\p{{L}}+|'s|'t|'re|'ve|'m|'ll|'d|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+|\n")
#: Characters at which str.split() cuts though the vocabulary does not.
SEPARATORS = regex.compile("[\x1c-\x1f]")
#: Stretches kept between slices; the store starts anew beyond this, so memory stays bounded.
STORE_STRETCHES = 250_000


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class WordTokenizer:
    """Encodes texts with a lower-casing byte-level BPE file that marks word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        self._added = {t["content"]: t["id"] for t in whole.get("added_tokens") or []}
        #: they are looked for before the text is normalised
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self._added, key=len, reverse=True))) + ")") if self._added else None
        end, letters, vocabulary = model["end_of_word_suffix"], _byte_letters(), model["vocab"]

        def as_bytes(token: str) -> bytes:
            body = token.removesuffix(end)
            return bytes(letters[c] for c in body) + b"Z" * (len(body) != len(token))

        order = [bytes([b]) for b in range(256)] + [bytes([b]) + b"Z" for b in range(256) if b != ord("Z")]
        known = set(order)
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            token = as_bytes(left + right)
            if token not in known:
                known.add(token)
                order.append(token)
        by_bytes = {as_bytes(token): number for token, number in vocabulary.items() if not token.startswith("<|")}
        self._ids = np.array([by_bytes.get(token, -1) for token in order], np.int32)
        self._coder = tiktoken.Encoding("word-ends", pat_str="[^Z]*Z", mergeable_ranks={t: k for k, t in enumerate(order)}, special_tokens={})
        self._line = order.index(b"\nZ")
        self._reset()

    def _reset(self) -> None:
        # no stretch begins with a blank, so a special string is told from a lower-cased one that looks like it
        self._numbers: dict[str, int] = {f" {text}": k for k, text in enumerate(self._added)}
        self._flat, self._begin = np.array(list(self._added.values()), np.int32), np.arange(len(self._added) + 1, dtype=np.int64)

    def _learn(self, stretches: list[str]) -> None:
        pieces = PIECES.findall("\n".join(stretches) + "\n")
        ranks = np.asarray(self._coder.encode_ordinary_batch(["Z".join(pieces) + "Z"], num_threads=1)[0], np.int64)
        ends = np.flatnonzero(ranks == self._line)
        assert len(ends) == len(stretches)
        self._flat = np.concatenate([self._flat, self._ids[ranks[ranks != self._line]]])
        self._begin = np.concatenate([self._begin, self._begin[-1] + ends - np.arange(len(ends))])

    @staticmethod
    def _stretches(text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [x for x in regex.split(f"[{SPACE}]+", text) if x] if SEPARATORS.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text, as int32 arrays."""
        if len(self._numbers) > STORE_STRETCHES:
            self._reset()
        numbers, new, rows = self._numbers, [], []
        for text in texts:
            parts = self._special.split(text) if self._special else [text]
            stretches = self._stretches(parts[0])
            for special, part in zip(parts[1::2], parts[2::2], strict=True):
                stretches.append(f" {special}")
                stretches += self._stretches(part)
            for stretch in set(stretches).difference(numbers):
                numbers[stretch] = len(numbers)
                new.append(stretch)
            rows.append(np.fromiter(map(numbers.__getitem__, stretches), np.int64, len(stretches)))
        if new:
            self._learn(new)
        out = []
        for row in rows:
            sizes = self._begin[row + 1] - self._begin[row]
            ends = np.cumsum(sizes)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self._flat[np.repeat(self._begin[row] - ends + sizes, sizes) + np.arange(total)])
        return out


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker process and file."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]
