"""Quality network and language identification: held-out accuracy, defined cases, and the forward pass against enumeration."""
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import langid, quality
from plumbline.llm.queries import held_out, tokenizer_path


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_quality_on_held_out_rows(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    net = quality.train(docs, labels)
    rows = quality.score(docs, net).where(held_out()).join(labels, "doc_id").select("score", "quality").toPandas()
    good, bad = rows.score[rows.quality == 1], rows.score[rows.quality == 0]
    assert (good.values[:, None] > bad.values[None]).mean() > 0.9
    flipped = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs, flipped)
    assert all((a == b).all() for a, b in zip(net.parts(), again.parts(), strict=True))  # held-out labels are never read


def test_quality_scores_are_defined_everywhere(spark):
    net = quality.fit([b"plain words " * 40, b"### $$$ " * 60] * 20, [1, 0] * 20, epochs=4)
    long = b"plain words " * 200_000
    scores = quality.scores(net, [b"", None, b"plain words " * 40, b"### $$$ " * 60, long, b"plain words " * 40])
    assert ((scores > 0) & (scores < 1)).all() and scores[0] == scores[1] and abs(scores[2] - scores[5]) < 1e-6 and scores[2] > scores[3]
    assert np.isclose(quality.scores(net, [long])[0], scores[4])
    table = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "a", None)], "doc_id long, text string, score int")
    got = quality.score(table, net)
    assert got.columns == ["doc_id", "text", "score"] and got.count() == 3 and quality.score(table.limit(0), net).count() == 0
    one = quality.fit([b"x"], [1])
    assert quality.scores(one, [b"anything"])[0] > 0.5
    nothing = quality.train(table, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.scores(nothing, [b"a"])[0] == 0.5


def test_chunks_cover_whole_texts():
    for n in (0, 1, 511, 512, 513, 768, 769, 5000):
        cut = quality.chunks_of(bytes(range(256)) * 20 if n == 5120 else bytes([k % 251 for k in range(n)]))
        places = np.arange(len(cut))[:, None] * quality.STEP + np.arange(quality.CHUNK)
        assert set(range(n)) == set(places[cut != quality.PAD].ravel().tolist())


def segmentations(vocab, chance, word):
    if not word:
        return 1.0
    total = 0.0
    for size in range(1, min(len(word), langid.PIECE_CHARS) + 1):
        piece = word[:size]
        p = chance[vocab.pieces.index(piece)] if piece in vocab.pieces else langid.UNKNOWN if size == 1 else 0
        total += p * segmentations(vocab, chance, word[size:]) if p else 0
    return total


def test_forward_pass_sums_all_segmentations():
    vocab = langid.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    rng = np.random.default_rng(2)
    chance = rng.dirichlet(np.ones(vocab.size), 2).T
    words = ["the", "straße", "a", "information", "日本", "qqqx"]
    got = langid.word_scores(vocab, words, chance)
    for word, row in zip(words, got, strict=True):
        assert np.allclose(row, [np.log(segmentations(vocab, chance[:, k].tolist(), "▁" + word)) for k in (0, 1)])


def test_pieces_of_any_length_count():
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    vocab, model = langid.vocabulary(path), sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_byte(k) or model.is_unknown(k))]
    assert vocab.pieces == sorted({model.id_to_piece(k) for k in ids}) and vocab.longest == max(map(len, vocab.pieces)) > 12
    number = {p: k for k, p in enumerate(vocab.pieces)}
    chance = np.random.default_rng(3).dirichlet(np.ones(vocab.size), 2).T
    words = ["international", "characteristics", "understanding", "internationalrelationship", "a"]
    for word, row in zip(words, langid.word_scores(vocab, words, chance), strict=True):
        marked, sums = "▁" + word, np.zeros((len(word) + 2, 2))
        sums[0] = 1
        for end in range(1, len(marked) + 1):
            for start in range(end):
                piece = marked[start:end]
                sums[end] += sums[start] * (chance[number[piece]] if piece in number else langid.UNKNOWN if end - start == 1 else 0)
        assert np.allclose(row, np.log(sums[-1]), atol=1e-9)
    counts, whole = Counter({"international": 9, "national": 1}), number["▁international"]
    assert langid.fit(vocab, {"en": counts})[whole, 0] > 0.01  # its counts, not the smoothing


def test_fitting_raises_the_likelihood():
    vocab = langid.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    counts = Counter({"reading": 5, "reader": 3, "read": 9, "lead": 2})
    value = [sum(n * s for n, s in zip(counts.values(), langid.word_scores(vocab, list(counts), langid.fit(vocab, {"en": counts}, r))[:, 0], strict=True)) for r in (1, 2, 4)]
    assert value[0] < value[1] < value[2]


def test_languages_on_held_out_rows_and_defined_cases(spark, docs):
    model = langid.train(docs, tokenizer_path("piece_bpe_32k.model"), sample=60)
    assert model.languages == ["de", "en", "es", "fr"]
    got = langid.identify(docs.where(held_out()), model)
    assert got.where(F.col("lang_pred") == F.col("lang")).count() > 0.95 * got.count()
    table = spark.createDataFrame([(1, None), (2, ""), (3, "123 ²½ -- $$"), (4, "的"), (5, "x" * 5000), (5, "x" * 5000)], "doc_id long, text string").withColumn("score", F.lit("old"))
    rows = langid.identify(table, model).collect()
    assert [r.lang_pred == "und" for r in rows] == [True, True, True, False, False, False] and all(0 <= r.score <= 1 for r in rows)
    empty = langid.train(docs.limit(0), model.path)
    assert {r.lang_pred for r in langid.identify(table, empty).collect()} == {"und"} and langid.identify(table.limit(0), model).count() == 0
