"""Quality score of a text by a small byte-level convolutional network in numpy.

A text is cut into overlapping chunks of CHUNK bytes, one every STEP bytes, that cover it from the first byte to the
last. Each byte has a learned vector; learned filters of WIDTH bytes slide over a chunk STRIDE bytes at a time; every
filter keeps its largest response in the chunk (max pooling). Averages and maxima of these responses over all chunks go
through one hidden layer into one probability.

The network is fitted on a bounded sample: about SAMPLE labelled rows, drawn by a hash of the id, and at most
SAMPLE_CHUNKS chunks of each, evenly spaced. Scoring reads every chunk of every text, one slice of rows at a time, without
a shuffle; the fitted weights (about 60 kB) are part of the task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import map_slices, texts_of

CHUNK, STEP, WIDTH, STRIDE, VECTOR, FILTERS, HIDDEN = 512, 256, 8, 4, 8, 32, 16
SAMPLE, SAMPLE_CHUNKS = 4000, 12
EPOCHS, BATCH, RATE = 12, 64, 0.004
#: Byte number 256 fills up chunks of short texts and the last chunk.
PAD = 256
#: Chunks that go through the filters at once.
AT_ONCE = 512


@dataclass
class Network:
    vectors: np.ndarray  # 257 x VECTOR
    filters: np.ndarray  # WIDTH * VECTOR x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # 2 * FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return Network(draw(257, VECTOR, scale=0.5), draw(WIDTH * VECTOR, FILTERS, scale=0.2), np.zeros(FILTERS, np.float32),
                       draw(2 * FILTERS, HIDDEN, scale=0.2), np.zeros(HIDDEN, np.float32), draw(HIDDEN, 1, scale=0.3), np.zeros(1, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def chunks_of(raw: bytes, most: int | None = None) -> np.ndarray:
    """All chunks as rows of byte numbers (or `most` of them, evenly spaced). An empty text has one chunk of padding."""
    count = max(1, -(-(len(raw) - CHUNK) // STEP) + 1)
    data = np.full((count - 1) * STEP + CHUNK, PAD, np.int16)
    data[: len(raw)] = np.frombuffer(raw, np.uint8)
    all_chunks = np.lib.stride_tricks.sliding_window_view(data, CHUNK)[::STEP]
    return all_chunks if most is None or count <= most else all_chunks[np.linspace(0, count - 1, most).astype(int)]


def _responses(net: Network, chunks: np.ndarray, keep: bool = False):
    """Largest response of each filter in each chunk; with `keep` also what the gradients need."""
    n, places = len(chunks), (CHUNK - WIDTH) // STRIDE + 1
    blocks = net.vectors[chunks].reshape(n, CHUNK // STRIDE, STRIDE * VECTOR)
    half = STRIDE * VECTOR
    reply = sum(blocks[:, k : k + places].reshape(-1, half) @ net.filters[k * half : (k + 1) * half] for k in range(WIDTH // STRIDE)).reshape(n, places, FILTERS)
    best = reply.max(axis=1) + net.bias
    return (np.maximum(best, 0), best, reply.argmax(axis=1), blocks) if keep else np.maximum(best, 0)


def _pooled(replies: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Average and maximum over the chunks of each text; texts are runs of rows."""
    sizes = np.diff(np.append(begin, len(replies)))[:, None]
    return np.hstack([np.add.reduceat(replies, begin, axis=0) / sizes, np.maximum.reduceat(replies, begin, axis=0)]).astype(np.float32)


def _head(net: Network, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(pooled @ net.hidden + net.hidden_bias)
    return hidden, 1 / (1 + np.exp(-np.clip((hidden @ net.out + net.out_bias)[:, 0].astype(np.float64), -30, 30)))


def scores(net: Network, texts: list[bytes | None]) -> np.ndarray:
    """Probability of label 1 for every text."""
    pieces, sums, tops, counts = [], [], [], []
    rows, held = [], 0

    def flush() -> None:
        nonlocal rows, held
        if not rows:
            return
        stacked = np.concatenate([c for _, c in rows])
        replies = np.concatenate([_responses(net, stacked[k : k + AT_ONCE]) for k in range(0, len(stacked), AT_ONCE)])
        begin = np.cumsum([0] + [len(c) for _, c in rows[:-1]])
        pieces.extend(k for k, _ in rows)
        sums.append(np.add.reduceat(replies, begin, axis=0))
        tops.append(np.maximum.reduceat(replies, begin, axis=0))
        counts.extend(len(c) for _, c in rows)
        rows, held = [], 0

    for k, raw in enumerate(texts):
        cut = chunks_of(raw or b"")
        for at in range(0, len(cut), 4 * AT_ONCE):  # a very long text goes through in parts
            part = cut[at : at + 4 * AT_ONCE]
            rows.append((k, part))
            held += len(part)
            if held >= 4 * AT_ONCE:
                flush()
    flush()
    if not texts:
        return np.zeros(0)
    begin = np.flatnonzero(np.diff(pieces, prepend=-1))
    total, top = np.add.reduceat(np.concatenate(sums), begin, axis=0), np.maximum.reduceat(np.concatenate(tops), begin, axis=0)
    pooled = np.hstack([total / np.add.reduceat(np.array(counts), begin)[:, None], top]).astype(np.float32)
    return _head(net, pooled)[1]


def fit(texts: list[bytes], labels: list[int], seed: int = 7, epochs: int = EPOCHS, most: int = SAMPLE_CHUNKS) -> Network:
    """Fits a network with Adam on the logistic loss. Without both labels every score is the share of label 1, smoothed."""
    net, y = Network.fresh(seed), np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.out_bias[:] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32) ** 0.5  # rarer labels count a little more
    cut = [chunks_of(t, most) for t in texts]
    rng, half = np.random.default_rng(seed), STRIDE * VECTOR
    first, second, step = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for epoch in range(epochs):
        order = rng.permutation(len(cut))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            chunks, begin = np.concatenate([cut[r] for r in rows]), np.cumsum([0] + [len(cut[r]) for r in rows[:-1]])
            replies, best, where, blocks = _responses(net, chunks, keep=True)
            pooled = _pooled(replies, begin)
            hidden, p = _head(net, pooled)
            slope = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)[:, None]
            back = slope @ net.out.T * (1 - hidden**2)
            to_pool = back @ net.hidden.T
            sizes = np.diff(np.append(begin, len(chunks)))
            owner = np.repeat(np.arange(len(rows)), sizes)
            grad = (to_pool[:, :FILTERS] / sizes[:, None])[owner]
            grad += to_pool[:, FILTERS:][owner] * (replies == pooled[:, FILTERS:][owner])
            grad = (grad * (best > 0)).astype(np.float32)
            # Each filter sees one window per chunk: where its response was largest.
            n = np.arange(len(chunks))[:, None]
            window = np.stack([blocks[n, where + k] for k in range(WIDTH // STRIDE)], axis=2)  # n, filter, part, half
            g_filters = np.einsum("nf,nfkh->khf", grad, window).reshape(-1, FILTERS)
            by_filter = net.filters.reshape(WIDTH // STRIDE, half, FILTERS).transpose(2, 0, 1)
            g_bytes = (grad[:, :, None, None] * by_filter[None]).reshape(-1, VECTOR)
            seen = chunks[n[:, :, None], where[:, :, None] * STRIDE + np.arange(WIDTH)].reshape(-1)
            g_vectors = np.stack([np.bincount(seen, g_bytes[:, v], 257) for v in range(VECTOR)], axis=1)
            grads = [g_vectors, g_filters, grad.sum(axis=0), pooled.T @ back, back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0)]
            step += 1
            rate = RATE * (1 - 0.8 * epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for part, g, m, v in zip(net.parts(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                part -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def learning_rows(docs: DataFrame, id_col: str) -> F.Column:
    """False for held-out rows: crc32 of the id as text, modulo 3, is 1. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 != 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = SAMPLE, seed: int = 7) -> Network:
    """Fits on about `sample` labelled rows that are not held out. Rows with a null label, id or text are left out.

    The sample is a range of a hash of the id, so it is the same wherever rows lie; ids with several labels take the
    smallest. The driver holds the sample's chunks only.
    """
    known = labels.select(id_col, F.col(label_col).cast("int").alias("label")).where(F.col(label_col).isNotNull() & learning_rows(labels, id_col)).groupBy(id_col).agg(F.min("label").alias("label"))
    count = known.count()
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, count)))
    bits = F.col(text_col).cast("binary")
    last = F.greatest(F.length(bits) - CHUNK, F.lit(0))
    # Longer texts send evenly spaced pieces only: SAMPLE_CHUNKS chunks hold all of a text of up to 3.3 kB.
    places = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_CHUNKS - 1)), lambda k: F.substring(bits, (last * k / (SAMPLE_CHUNKS - 1)).cast("int") + 1, F.lit(CHUNK)))
    whole = F.length(bits) <= CHUNK + (SAMPLE_CHUNKS - 1) * STEP
    rows = (docs.where(F.col(text_col).isNotNull()).where(part & learning_rows(docs, id_col)).join(known.where(part), id_col)
            .select(id_col, "label", F.when(whole, F.array(bits)).otherwise(places).alias("pieces")).toArrow().sort_by(id_col))
    return fit([b"".join(p) for p in rows["pieces"].to_pylist()], [int(x > 0) for x in rows["label"].to_pylist()], seed)


def score(docs: DataFrame, net: Network, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the score to every row; null texts count as empty. A column of that name is replaced; all others stay."""
    docs = docs.drop(score_col)
    names = docs.columns

    def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = scores(net, texts_of(batch, text_col))
        return pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(got, pa.float64())], [*names, score_col])

    return map_slices(docs, text_col, handle, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))
