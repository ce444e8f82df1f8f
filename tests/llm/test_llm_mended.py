"""Cases that once went wrong: runs in patterns, long words, special strings, limits of zero."""
import numpy as np
import pytest
from tokenizers import Tokenizer

from plumbline.llm import jaccard, packing, pii
from plumbline.llm.common import BYTE_VALUES, POWERS, mix, word_hashes
from plumbline.llm.queries import tokenizer_path
from plumbline.llm.tokens import WordTokenizer

LONG, SHORT = 20_000, 2_000


def test_long_runs_of_every_repeatable_part_end(spark):
    texts = {"email": "a@b" + ".cc" * LONG, "local": "a." * SHORT + "@b.cc", "phone": "+49 " + "12 " * SHORT, "iban": "DE12 " + "1234 " * SHORT, "secret": "ab12" * SHORT,
             "ip": "1.2.3.4" + ".5" * SHORT, "card": "1234 " * SHORT, "name": "Dr. " + "Anna " * SHORT, "national": "123-45-6789-" * SHORT}
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts.values())], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.replace(docs).collect()}
    assert len(rows) == len(texts) and rows[0].text != texts["email"] and rows[0].text.count(".cc") < LONG


def test_words_beyond_4096_bytes_keep_their_order(spark):
    texts = ["a" * 4096 + "b", "b" + "a" * 4096, "a" * 4096 + "b", "x" * 9000 + "y" * 5000, "y" * 5000 + "x" * 9000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.classes(docs).collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}
    data = np.frombuffer(b"some words stay as they were", np.uint8)
    begin, end, hashes = word_hashes(data, data != 32)
    for b, e, h in zip(begin, end, hashes, strict=True):
        assert h == mix(np.array([(BYTE_VALUES[data[b:e]] * POWERS[: e - b]).sum() + np.uint64(e - b)]))[0]


def test_special_strings_are_read_as_the_library_reads_them():
    own, library = WordTokenizer(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for text in ("hello <|endoftext|> there", "a<|startoftext|>b", "<|EndOfText|>", "x <|endoftext|><|endoftext|>Y", "<|endoftext|", "é<|endoftext|>É́", "<|endoftext|>", "ΑΣ<|endoftext|>Σ", "a\x1cb <|startoftext|>  c", ""):
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_a_loss_limit_of_zero_is_an_error():
    with pytest.raises(ValueError):
        packing.Packer(8, 2, 0)
