"""Byte-level BPE, whitening and tokenizer alignment: against the libraries and plain brute force."""
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import alignment, bytepair, whitening
from plumbline.llm.queries import op11_bpe, op12_whiten, op13_align, tokenizer_path

RANKS = tokenizer_path("byte_bpe_multi_50k.tiktoken")
ALPHABETS = ["ab", "aAbB 's", "the quick\n\t ", "éüñ你好日本語한국", "0123456789.,", "\U00032000࢏౜ ab1 \x85\x1c\x00", "▁ ab<0x41>", "  a\r\n"]


def strange_texts(n, seed=1):
    rng, texts = random.Random(seed), []
    for k in range(n):
        size = rng.randint(1, 60)
        if k % 3:
            texts.append("".join(rng.choice(ALPHABETS[k % len(ALPHABETS)]) for _ in range(size)))
        else:
            texts.append("".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(size)))
    return texts + [" ", "  ", "a ", "\n ", "<|endoftext|>", "</s> <s>", "a" * 5000, "ab " * 3000, " " * 500, "x▁y", "word \n\n  next", "don't I'll", "�"]


# ---- byte-level BPE ------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_ids_are_those_of_tiktoken(name):
    path = tokenizer_path(name)
    own = bytepair.BytePairs(bytepair.read_ranks(path), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytepair.read_ranks(path), special_tokens={})
    for text in strange_texts(1500):
        made = np.frombuffer(own.encode(text), "<u4").astype(np.int64)
        assert made.tolist() == library.encode_ordinary(text), text
        assert own.decode(made) == text.encode()


def test_every_small_vocabulary_reproduces_the_merges():
    """Random vocabularies with ties, overlapping merges and tokens that no merge can make."""
    rng, refused = random.Random(2), 0
    for _ in range(200):
        tokens = [bytes([b]) for b in range(256)]
        for _ in range(rng.randint(1, 40)):
            made = rng.choice(tokens[-8:] + [b"a", b"b"]) + rng.choice(tokens[-8:] + [b"a", b"b", b"c"])
            if rng.random() < 0.1:
                made = bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 6)))
            if made not in tokens:
                tokens.append(made)
        ranks = {t: k for k, t in enumerate(tokens)}
        try:
            own = bytepair.BytePairs(ranks, r"[^|]+")
        except ValueError:  # a token before its own parts
            refused += 1
            continue
        library = tiktoken.Encoding("small", pat_str=r"[^|]+", mergeable_ranks=ranks, special_tokens={})
        for _ in range(60):
            text = "".join(rng.choice("aabbc") for _ in range(rng.randint(1, 40)))
            assert own.encode_piece(text.encode()) == library.encode_ordinary(text)
    assert refused < 100


def test_long_texts_are_cut_where_no_piece_is(monkeypatch):
    own = bytepair.BytePairs(bytepair.read_ranks(RANKS), public_tokenizers.PATTERN)
    texts = [t + " \n " + t for t in strange_texts(300, 4)]
    whole = [own.encode(t) for t in texts]
    monkeypatch.setattr(bytepair, "BLOCK", 5)
    monkeypatch.setattr(bytepair, "STORE_BYTES", 3000)
    monkeypatch.setattr(bytepair, "STORE_PAIRS", 10)
    assert [own.encode(t) for t in texts] == whole


def test_short_pieces_are_walked_together(monkeypatch):
    """As arrays: the same ids as alone and as in the library, also where the walk goes back and pairs share a slot."""
    monkeypatch.setattr(bytepair, "SLOTS", 8)
    monkeypatch.setattr(bytepair, "SHORT", 30)
    monkeypatch.setattr(bytepair, "TOGETHER", 200)
    rng = random.Random(5)
    for _ in range(60):
        tokens = [bytes([b]) for b in range(256)]
        for _ in range(rng.randint(1, 40)):
            made = rng.choice(tokens[-8:] + [b"a", b"b"]) + rng.choice(tokens[-8:] + [b"a", b"b", b"c"])
            if made not in tokens:
                tokens.append(made)
        ranks = {t: k for k, t in enumerate(tokens)}
        try:
            own = bytepair.BytePairs(ranks, r"[^|]+")
        except ValueError:
            continue
        library = tiktoken.Encoding("small", pat_str=r"[^|]+", mergeable_ranks=ranks, special_tokens={})
        texts = ["".join(rng.choice("aabbc") for _ in range(rng.randint(1, 40))) for _ in range(60)]
        ids, sizes = own.encode_pieces([t.encode() for t in texts])
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode_ordinary(t) for t in texts]
    own = bytepair.BytePairs(bytepair.read_ranks(RANKS), public_tokenizers.PATTERN)
    monkeypatch.setattr(own, "encode_piece", lambda piece: pytest.fail(f"{piece} was walked alone"))
    assert own.decode(np.frombuffer(own.encode("Thtionre ithblenea, Ndsttion-übeenchver"), "<u4").astype(np.int64)).decode() == "Thtionre ithblenea, Ndsttion-übeenchver"


def test_known_stretches_are_not_split_again():
    own, split = bytepair.BytePairs(bytepair.read_ranks(RANKS), public_tokenizers.PATTERN), []
    text = "some words, (often) repeated; " * 1000 + "and an end"
    first, plain = own.encode(text), own._split
    own._split = lambda part: split.append(len(part)) or plain(part)
    assert own.encode(text) == first
    assert sum(split) < 100
    assert bytepair.WORDS == public_tokenizers.PATTERN


def test_stretches_beside_odd_white_space():
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytepair.read_ranks(RANKS), special_tokens={})
    own = bytepair.BytePairs(bytepair.read_ranks(RANKS), public_tokenizers.PATTERN)
    blanks, rng = [" ", " ", " ", " ", "  ", "\n", " \n", "\n ", "\t ", "\u00a0 ", " \u3000", "\x1c ", " \x1c", ""], random.Random(6)
    texts = ["".join(x for _ in range(rng.randint(0, 9)) for x in (rng.choice(["a", "Xy", "don't", "7.", "é\u0301", "漢字"]), rng.choice(blanks))) for _ in range(3000)]
    texts += [" " + t for t in texts[:300]] + [t + " " for t in texts[:300]]
    made = own.encode_all(texts) + [own.encode(t) for t in texts]  # new among others, then known
    assert [np.frombuffer(m, "<u4").tolist() for m in made] == [library.encode_ordinary(t) for t in texts] * 2


def test_encode_and_decode_tables(spark):
    rows = [(1, "Hello wörld", "x"), (2, "", "y"), (3, None, None), (None, "Hello wörld", "z"), (1, "Hello wörld", "x"), (4, "long text " * 100_000, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    for packed in (False, True):
        made = bytepair.encode(docs, RANKS, public_tokenizers.PATTERN, packed=packed)
        assert made.columns == ["doc_id", "text", "ids"]
        back = bytepair.decode(made, RANKS, public_tokenizers.PATTERN).collect()
        assert sorted((bytes(r.decoded) for r in back)) == sorted((t or "").encode() for _, t, _ in rows)
    odd = spark.createDataFrame([([0, None, 99_999_999, -5],), (None,), ([],)], "ids array<int>")
    assert [r.decoded and bytes(r.decoded).decode() for r in bytepair.decode(odd, RANKS, public_tokenizers.PATTERN).collect()] == ["!���", None, bytearray(b"")]
    assert bytepair.decode(bytepair.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_query(spark, folder):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytepair.read_ranks(RANKS), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = op11_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


# ---- whitening -----------------------------------------------------------------------------------------------------

def test_rank_one_updates_equal_a_dense_solver():
    rng = np.random.default_rng(0)
    for d, n in ((1, 6), (2, 9), (5, 60), (24, 90), (40, 15)):
        for kind in range(4):
            rows = rng.normal(size=(n, d)) * np.geomspace(1e-3, 1e3, d)
            if kind == 1:
                rows = np.round(rows[rng.integers(0, 3, n)])  # few different rows: equal eigenvalues, zero weights
            if kind == 2:
                rows = np.eye(d)[rng.integers(0, d, n)] * 5.0
            if kind == 3:
                rows[n // 2:] = 0
            own, other = whitening.Spectrum.empty(d), whitening.Spectrum.empty(d)
            for row in rows[: n // 2]:
                own.add(row)
            other.add_rows(rows[n // 2:])
            own.merge(other)
            scatter = rows.T @ rows
            top = max(np.linalg.eigvalsh(scatter)[-1], 1e-300)
            assert np.abs(own.values - np.linalg.eigvalsh(scatter)).max() <= 1e-11 * top
            assert np.abs(own.vectors.T @ own.vectors - np.eye(d)).max() < 1e-10
            assert np.abs(own.vectors * own.values @ own.vectors.T - scatter).max() <= 1e-11 * top


def check_whitened(rows, given, count):
    """Every column against numpy on exact integers."""
    x = {k: [int(np.floor(64 * float(c))) + 1_000_000 for c in v] for k, v in given.items()}
    n, sums = len(x), [sum(column) for column in zip(*x.values(), strict=True)]
    keys = sorted(x)
    centred = np.array([[(n * c - s) / n for c, s in zip(x[k], sums, strict=True)] for k in keys])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(by) == len(rows) == n * count and len({r.identity_error for r in rows}) == 1
    assert rows[0].identity_error < 1e-8
    for c in range(1, count + 1):
        mine = np.array([by[k, c].whitened for k in keys])
        want = centred @ vectors[:, c - 1] / np.sqrt(values[c - 1])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-7, c
        assert abs(by[keys[0], c].explained / (values[c - 1] / values.sum()) - 1) < 1e-9
    for k in keys:
        assert by[k, 1].n == n and by[k, 1].deviation == sum((n * c - s) ** 2 for c, s in zip(x[k], sums, strict=True))


def test_whitening_query(spark, folder):
    given = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    check_whitened(op12_whiten(spark, folder).collect(), given, 32)


def test_whitening_of_unusable_and_degenerate_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rng = np.random.default_rng(3)
    good = {k: rng.normal(size=4).tolist() for k in range(40)}
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [1.0, float("nan"), 2.0, 3.0]), (104, [float("inf")] * 4), (105, [1.0, 2.0])]
    schema = "vec_id long, embedding array<double>, component string"
    table = spark.createDataFrame([(k, v, "c") for k, v in [*good.items(), *bad]], schema).repartition(7)
    for block in (1, 5, None):
        model = whitening.fit(table, block_rows=block)
        rows = whitening.whiten(table, model, error=whitening.identity_error(table, model)).collect()
        check_whitened(rows, good, 4)
    same = spark.createDataFrame([(k, [1.0, 2.0, float((k or 0) % 3)], "") for k in [1, 1, 2, 3, None, 5]], schema)
    model = whitening.fit(same)
    rows = whitening.whiten(same, model, error=whitening.identity_error(same, model)).collect()
    assert len(rows) == 18 and {r.whitened is None for r in rows if r.component > 1} == {True} and rows[0].identity_error < 1e-9
    assert {r.explained for r in rows if r.component == 1} == {1.0}
    large = spark.createDataFrame([(k, [1e9 * k, -1e9], "") for k in range(5)], schema)
    assert all(r.deviation is None or r.deviation > 0 for r in whitening.whiten(large, whitening.fit(large)).where("vec_id != 2").collect())
    for empty in (table.limit(0), table.where("vec_id >= 100 and vec_id < 105")):
        assert whitening.fit(empty) is None and whitening.whiten(empty, None).count() == 0
    constant = spark.createDataFrame([(k, [2.0, 2.0], "") for k in range(3)], schema)
    model = whitening.fit(constant)
    assert whitening.identity_error(constant, model) is None and {r.whitened for r in whitening.whiten(constant, model).collect()} == {None}


# ---- alignment -----------------------------------------------------------------------------------------------------

def test_pieces_of_the_merge_equal_the_plain_merge():
    rng = random.Random(4)
    for _ in range(300):
        top = rng.randint(1, 60)
        a, b = (np.array(sorted({*rng.sample(range(1, top + 1), rng.randint(0, top)), top})) for _ in range(2))
        want, i, j, g, ga, gb = [], 0, 0, 0, [], []
        while i < len(a):
            want.append((i, j))
            shared = a[i] == b[j]
            if a[i] <= b[j]:
                ga.append(g)
            if b[j] <= a[i]:
                gb.append(g)
            i, j = i + (a[i] <= b[j]), j + (b[j] < a[i] or shared)
            g += shared
        for work in (1, 2, 7, 1000):
            la, lb, group_a, group_b = alignment.align_ends(a, b, work)
            assert sorted(zip(la.tolist(), lb.tolist(), strict=True)) == sorted(want)
            assert group_a.tolist() == ga and group_b.tolist() == gb
            borders = np.add(*alignment.diagonals(a, b, work))
            assert np.diff(borders).max() <= work and borders[-1] == len(a) + len(b)


def brute_force(texts):
    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rows, counts = [], {}
    for text in texts:
        groups, links = [], []
        if text:
            e = a.encode(" " + text, add_special_tokens=False)
            letters = alignment._byte_letters()
            ta = [bytes(letters[c] for c in t) for t in e.tokens]
            ids_b = b.encode(text)
            tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            whole = (" " + text).encode()
            if b"".join(ta) == whole == b"".join(tb):
                ea, eb = np.cumsum([len(t) for t in ta]), np.cumsum([len(t) for t in tb])
                for p, (x, s) in enumerate(zip(e.ids, ea - [len(t) for t in ta], strict=True)):
                    for q in range(max(0, int(np.searchsorted(eb, s, "right"))), len(eb)):
                        if eb[q] - len(tb[q]) >= ea[p]:
                            break
                        links.append((x, ids_b[q]))
                i = j = 0
                for cut in sorted({*ea.tolist()} & {*eb.tolist()}):
                    left, right = [], []
                    while i < len(ea) and ea[i] <= cut:
                        left.append(str(e.ids[i]))
                        i += 1
                    while j < len(eb) and eb[j] <= cut:
                        right.append(str(ids_b[j]))
                        j += 1
                    groups.append(f"{','.join(left)}|{','.join(right)}")
                rows.append([len(ta), len(tb), groups, links])
            else:
                rows.append([0, 0, [], []])
        else:
            rows.append([0, 0, [], []])
        for pair in set(links):
            counts[pair] = counts.get(pair, 0) + 1
    top = {}
    for (x, _), c in counts.items():
        top[x] = max(top.get(x, 0), c)
    return [(n_a, n_b, len(groups), len(links), sum(counts[p] == top[p[0]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for n_a, n_b, groups, links in rows]


@pytest.mark.parametrize("hot", [alignment.HOT, 40])
def test_alignment_equals_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(alignment, "COUNTED", 50)
    texts = [*strange_texts(250, 7), None, "", "the same text", "the same text", "a nul \x00 byte"]
    docs = spark.createDataFrame([(k if k % 9 else None, k, t, "clash", "x") for k, t in enumerate(texts)], "doc_id long, at long, text string, n_best string, times string").repartition(3)
    got = alignment.align(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), work=50, hot=hot)
    assert got.columns == ["doc_id", "at", "text", "times", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = {r.at: tuple(r)[4:] for r in got.collect()}
    want = brute_force(texts)
    for k, text in enumerate(texts):
        assert rows[k] == want[k], text
    assert alignment.align(docs.limit(0), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_alignment_query(spark, folder):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    rows = {r.doc_id: tuple(r)[1:] for r in op13_align(spark, folder).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}
    assert rows == dict(zip([k for k, _ in given], brute_force([t for _, t in given]), strict=True))
    assert F is not None
