"""Language identification with unigrams over the pieces of a fixed public vocabulary, summed over all segmentations.

Each language has a probability for every piece. The probability of a word is the sum over all ways to cut it into pieces
of the product of their probabilities; a forward pass adds it up. A text's likelihood is the product over its words. The
piece probabilities come from expectation maximisation (forward and backward pass) on a bounded sample: about SAMPLE
documents of each language, drawn by a hash of the id, and at most SAMPLE_PIECES stretches of SAMPLE_CHARS characters
of each, evenly spaced.

Words repeat, so every distinct word of a task is segmented once, all at a time in numpy; scoring needs no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import BASE, INVERSE, map_slices, mix
from plumbline.llm.quality import learning_rows

WORD = re.compile(r"[^\W\d_]+")
#: Letters of a word segmented together; a longer run of letters is cut there. Keeps products within double precision.
LONGEST = 40
#: Characters of the longest piece that a word can hold: all of it with its mark. Longer pieces stand in no word.
PIECE_CHARS = LONGEST
SAMPLE, SAMPLE_PIECES, SAMPLE_CHARS = 700, 4, 1500
ROUNDS = 3
#: Added to every expected count, and the probability of a character that is no piece.
SMOOTH, UNKNOWN = 0.02, 1e-7
#: Distinct stretches kept between slices of a task.
STORE = 250_000


class Vocabulary:
    """Finds the pieces inside words; a leading ▁ marks the word's begin."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [model.id_to_piece(k) for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k))]
        self.pieces = sorted({p for p in plain if len(p) <= PIECE_CHARS})
        self.longest = max(map(len, self.pieces))
        self.up = np.multiply.accumulate(np.array([1] + [BASE] * (LONGEST + 2), np.uint64))
        self.down = np.multiply.accumulate(np.array([1] + [INVERSE] * (LONGEST + 2), np.uint64))
        codes, sizes = self._codes(self.pieces)
        sums = self._sums(codes)
        hashes = self._hash(sums[np.arange(len(sizes)), sizes], sums[:, 0], 0, sizes)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[hashes >> np.uint64(44)] = True
        self.size = len(self.pieces)

    @staticmethod
    def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        codes = np.zeros((len(words), int(sizes.max(initial=0))), np.uint64)
        codes[np.arange(codes.shape[1]) < sizes[:, None]] = mix(flat.astype(np.uint64) + np.uint64(1))
        return codes, sizes

    def _sums(self, codes: np.ndarray) -> np.ndarray:
        sums = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        np.cumsum(codes * self.up[: codes.shape[1]], axis=1, out=sums[:, 1:])
        return sums

    def _hash(self, high: np.ndarray, low: np.ndarray, at: int, size) -> np.ndarray:
        return mix((high - low) * self.down[at] + np.asarray(size, np.uint64))

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers [end, length - 1, word] with -1 where no piece is, and the word sizes, both with the leading ▁."""
        codes, sizes = self._codes(["▁" + w for w in words])
        sums, longest = self._sums(codes), codes.shape[1]
        found = np.full((longest + 1, min(self.longest, longest), len(words)), -1, np.int32)
        for end in range(1, longest + 1):
            alive = np.flatnonzero(sizes >= end)
            for size in range(1, min(self.longest, end) + 1):
                hashes = self._hash(sums[alive, end], sums[alive, end - size], end - size, size)
                maybe = np.flatnonzero(self.seen[hashes >> np.uint64(44)])
                place = np.minimum(np.searchsorted(self.sorted, hashes[maybe]), self.size - 1)
                right = self.sorted[place] == hashes[maybe]
                found[end, size - 1, alive[maybe[right]]] = self.order[place[right]]
        return found, sizes


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _weights(found: np.ndarray, end: int, size: int, chance: np.ndarray) -> np.ndarray:
    """Probability of the piece of that size before `end` in each word: [word, language]; single characters always have one."""
    piece = found[end, size - 1]
    weight = np.where(piece[:, None] >= 0, chance[piece], 0.0)
    if size == 1:
        weight = np.where(piece[:, None] >= 0, weight, UNKNOWN)
    return weight


def forward(found: np.ndarray, sizes: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """alpha[end, word, language]: the summed probability of all segmentations of the first `end` characters."""
    alpha = np.zeros((found.shape[0], found.shape[2], chance.shape[1]))
    alpha[0] = 1
    for end in range(1, found.shape[0]):
        for size in range(1, min(found.shape[1], end) + 1):
            if size > 1 and not (found[end, size - 1] >= 0).any():
                continue
            alpha[end] += alpha[end - size] * _weights(found, end, size, chance)
    return alpha


def _by_size(words: list[str]):
    """Words in groups of similar length, as index arrays, so that little padding is carried."""
    sizes = np.array([len(w) for w in words])
    for low, high in ((0, 4), (4, 7), (7, 10), (10, 14), (14, 20), (20, LONGEST)):
        rows = np.flatnonzero((sizes > low) & (sizes <= high))
        for at in range(0, len(rows), 20_000):
            yield rows[at : at + 20_000]


def word_scores(vocab: Vocabulary, words: list[str], chance: np.ndarray) -> np.ndarray:
    """Log probability of each word in each language."""
    out = np.zeros((len(words), chance.shape[1]))
    for rows in _by_size(words):
        found, sizes = vocab.lattice([words[r] for r in rows])
        out[rows] = np.log(forward(found, sizes, chance)[sizes, np.arange(len(rows))])
    return out


def fit(vocab: Vocabulary, words: dict[str, Counter], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities [piece, language] from word counts of each language, by expectation maximisation."""
    chance = np.zeros((vocab.size, len(words)))
    for column, counts in enumerate(words.values()):
        names = list(counts)
        amount = np.array([counts[w] for w in names], float)
        groups = [(rows, *vocab.lattice([names[r] for r in rows])) for rows in _by_size(names)]
        expected = np.zeros(vocab.size)
        for rows, found, _ in groups:  # begin with the counts of all pieces in all places
            there = found >= 0
            expected += np.bincount(found[there], np.broadcast_to(amount[rows], found.shape)[there], vocab.size)
        for _ in range(rounds):
            p = ((expected + SMOOTH) / (expected.sum() + SMOOTH * vocab.size))[:, None]
            expected = np.zeros(vocab.size)
            for rows, found, sizes in groups:
                alpha, beta = forward(found, sizes, p)[:, :, 0], np.zeros(found.shape[::2])
                n = np.arange(len(rows))
                beta[sizes, n] = amount[rows] / alpha[sizes, n]
                for end in range(found.shape[0] - 1, 0, -1):
                    for size in range(1, min(found.shape[1], end) + 1):
                        piece = found[end, size - 1]
                        if size > 1 and not (piece >= 0).any():
                            continue
                        share = beta[end] * _weights(found, end, size, p)[:, 0]
                        beta[end - size] += share
                        there = piece >= 0
                        expected += np.bincount(piece[there], (share * alpha[end - size])[there], vocab.size)
        chance[:, column] = (expected + SMOOTH) / (expected.sum() + SMOOTH * vocab.size)
    return chance


def words_of(stretch: str) -> list[str]:
    """Lower-case runs of letters, long ones cut."""
    return [w[k : k + LONGEST - 1] for w in WORD.findall(stretch) for k in range(0, len(w), LONGEST - 1)]


@dataclass
class Model:
    path: str
    languages: list[str]
    chance: np.ndarray  # piece x language, float32


def train(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, seed: int = 7) -> Model:
    """Learns from rows that are not held out and have text and language, about `sample` of each language."""
    known = docs.where(learning_rows(docs, id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    vocab, words = vocabulary(path), {lang: Counter() for lang in sorted(counts)}
    if counts:
        share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(1_000_000 * min(1.0, sample / n))))])
        size = F.length(text_col)
        places = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_PIECES - 1)), lambda k: F.substring(F.col(text_col), ((size - SAMPLE_CHARS) * k / (SAMPLE_PIECES - 1)).cast("int") + 1, F.lit(SAMPLE_CHARS)))
        rows = known.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(1_000_000)) < share[F.col(lang_col)]).select(
            lang_col, F.when(size <= SAMPLE_PIECES * SAMPLE_CHARS, F.array(text_col)).otherwise(places).alias("parts")).toArrow()
        for lang, parts in zip(rows[lang_col].to_pylist(), rows["parts"].to_pylist(), strict=True):
            for part in parts:
                words[lang].update(words_of(part.lower()))
    words = {lang: c for lang, c in words.items() if c}
    return Model(path, list(words), fit(vocab, words).astype(np.float32))


class Scorer:
    """Adds up word scores of texts; keeps the scores of stretches between blanks it has seen."""

    def __init__(self, model: Model):
        self.model, self.chance, self.vocab = model, model.chance.astype(float), vocabulary(model.path)
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.languages) + 1))

    def _learn(self, stretches: list[str]) -> None:
        cut = [words_of(s) for s in stretches]
        distinct = sorted({w for c in cut for w in c})
        place = {w: k for k, w in enumerate(distinct)}
        one = np.hstack([word_scores(self.vocab, distinct, self.chance), np.array([[any(map(str.isalpha, w))] for w in distinct], float).reshape(-1, 1)])
        owner = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        flat = one[[place[w] for c in cut for w in c]]
        new = np.stack([np.bincount(owner, flat[:, k], len(cut)) for k in range(flat.shape[1])], axis=1)
        self.rows = np.concatenate([self.rows, new])

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.numbers) > STORE:
            self._reset()
        numbers, new, found = self.numbers, [], []
        for text in texts:
            stretches = text.lower().split() if text else []
            for s in set(stretches).difference(numbers):
                numbers[s] = len(numbers)
                new.append(s)
            found.append(np.fromiter(map(numbers.__getitem__, stretches), np.int64, len(stretches)))
        if new:
            self._learn(new)
        out = []
        for rows in found:
            sums = self.rows[rows].sum(axis=0)
            if not len(rows) or not sums[-1] or not self.model.languages:
                out.append(("und", 0.0))
                continue
            best = int(sums[:-1].argmax())
            out.append((self.model.languages[best], float(1 / np.exp(np.clip(sums[:-1] - sums[best], -700, 0)).sum())))
        return out


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Adds the likeliest language of every text and its posterior probability (equal priors).

    A null text, or one without a letter, is `und` with score 0; so is every text if nothing could be learned. Equal
    likelihoods go to the first language by name. Columns of the added names are replaced, all others stay.
    """
    docs = docs.drop(lang_out, score_out)
    names = docs.columns
    held: list[Scorer] = []

    def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(Scorer(model))
        got = held[0](batch[text_col].to_pylist())
        return pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [*names, lang_out, score_out])

    return map_slices(docs, text_col, handle, T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]))
