"""Decontamination, packing, suffix dedup, licenses: against brute force on small tables."""
import hashlib
import random
import re
import tempfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import decontaminate, induced, licenses, packing, suffix_dedup
from plumbline.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, items string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


# ---- decontamination -----------------------------------------------------------------------------------------------

def hits(text, items, window=13):
    own, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        for at in range(max(1, len(w) - window + 1)) if w else ():
            part = w[at:at + window]
            for k in range(len(own) - len(part) + 1):
                if own[k:k + len(part)] == part:
                    hit.update(range(k, k + len(part)))
                    names.add(str(name))
    return len(own), hit, sorted(names)


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 15])
def test_decontamination_equals_brute_force(spark, block_words):
    rng = random.Random(3)
    vocabulary = ["Über", "alpha", "beta", "x1", "día", "the"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, line(20)), (2, line(13)), (10, "short item"), (3, ""), (4, None), (5, "short item"), (None, "alpha")]
    texts = [f"{line(9)}. {items[0][1]}!! {line(4)}", items[1][1].upper().replace("Ü", "ü"), "A Short, ITEM; short item", line(300), "", None, items[0][1], items[0][1]]
    docs = spark.createDataFrame([(k, t, "en", "clash") for k, t in enumerate(texts)], DOCS)
    got = decontaminate.scan(docs, spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)
    assert got.columns[:3] == ["doc_id", "text", "lang"] and got.columns.count("items") == 1
    for row in got.collect():
        n, hit, names = hits(row.text, [i for i in items if i[0] is not None])
        assert (row.n_words, row.n_hit, row["items"]) == (n, len(hit), names)
        assert row.contaminated == (len(hit) > 0 and 20 * len(hit) >= n)
        assert [w for s in row.spans for w in words(row.text[s.start:s.end])] == [w for k, w in enumerate(words(row.text)) if k in hit]
    none = decontaminate.scan(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated or n_hit > 0").isEmpty() and none.count() == len(texts)
    assert decontaminate.scan(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


# ---- packing -------------------------------------------------------------------------------------------------------

def check_pieces(rows, capacity, segments=128, loss=None):
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        assert sum(p.length for p in parts) <= capacity and len(parts) <= segments and sum(p.loss_tokens for p in parts) <= (loss or capacity)
    return sequences


def test_texts_are_packed_once_with_little_padding(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "n_chars")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, 0), (-2, "", 0), (None, "no id", 5)], docs.schema)).coalesce(1)
    rows = packing.pack_texts(docs, tokenizer_path(), with_ids=True).collect()
    sequences = check_pieces(rows, 2048)
    coder = Tokenizer.from_file(tokenizer_path())
    coder.encode_special_tokens = True
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for key, text in docs.select("doc_id", "text").collect():
        own = sorted(pieces[key], key=lambda r: r.start)
        ids = coder.encode(text or "", add_special_tokens=False).ids + [1]
        assert [i for p in own for i in p.ids] == ids and own[0].doc_tokens == len(ids)
    lengths = [sum(p.length for p in parts) for parts in sequences.values()]
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths)
    assert padding < 0.01 * sum(lengths)
    assert packing.pack_texts(docs.limit(0), tokenizer_path()).count() == 0


def test_three_limits_hold_at_once():
    rng = np.random.default_rng(1)
    packer = packing.Packer(64, 3, 20)
    placed, given = [], {}
    for key in range(3000):
        n = int(rng.integers(1, 150))
        ids, mask = rng.integers(0, 9, n).astype(np.int32), rng.random(n) < 0.4
        given[key] = ids
        placed += packer.add(key, ids, mask)
    placed += packer.close()
    found = {}
    for key, start, ids, total, sequence, offset, loss in placed:
        assert total == len(given[key]) and (ids == given[key][start:start + len(ids)]).all()
        found.setdefault(key, []).append((start, len(ids)))
    for key, parts in found.items():
        assert sum(n for _, n in parts) == len(given[key]) and len({s for s, _ in parts}) == len(parts)
    by = {}
    for p in placed:
        by.setdefault(p[4], []).append(p)
    for parts in by.values():
        assert sum(len(p[2]) for p in parts) <= 64 and len(parts) <= 3 and sum(p[6] for p in parts) <= 20


def test_instructions_bear_loss_in_answers_only(spark):
    rows = spark.createDataFrame([(1, "say hello", "hello there"), (2, None, "yes"), (3, "q", None)], "id long, q string, a string")
    pieces = packing.pack_instructions(rows, tokenizer_path(), id_col="id", prompt_col="q", answer_col="a")
    got = {r.id: (r.n, r.loss) for r in pieces.groupBy("id").agg(F.sum("length").alias("n"), F.sum("loss_tokens").alias("loss")).collect()}
    assert got == {1: (5, 3), 2: (2, 2), 3: (2, 1)}


# ---- suffix sorting ------------------------------------------------------------------------------------------------

def test_induced_sorting_equals_plain_sorting():
    rng = random.Random(5)
    for _ in range(300):
        sigma = rng.choice([1, 2, 3, 200])
        text = np.array([rng.randrange(sigma) for _ in range(rng.randint(1, 60))], np.uint8)
        if rng.random() < 0.4:
            text = np.concatenate([text, text[: len(text) // 2], text])
        bound, plain = rng.choice([3, 7, 50]), text.tolist()
        with tempfile.TemporaryDirectory() as scratch:
            parts = list(induced.suffixes(text, scratch, bound, rng.choice([3, 50, 10**6]), rng.choice([0, 4, 10**6])))[::-1]
        order, common = np.concatenate([p for p, _ in parts]).tolist(), np.concatenate([c for _, c in parts]).tolist()
        assert order == sorted(range(len(plain)), key=lambda i: plain[i:])
        for k in range(1, len(order)):
            a, b = plain[order[k - 1]:], plain[order[k]:]
            assert common[k] == next((i for i in range(min(len(a), len(b), bound)) if a[i] != b[i]), min(len(a), len(b), bound))


def removed(texts, length):
    first, out = {}, {}
    for key in sorted(texts):
        raw = (texts[key] or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if first.setdefault(raw[p:p + length], key) < key:
                gone[p:p + length] = True
        out[key] = gone
    return out


def test_segments_of_one_anchor_with_near_digests_both_stay(spark):
    """Pairs with one anchor whose digests agree in their upper 40 bits."""
    pairs = [("hruqnymlxsmdpcoelcluitftwenbwhythetaxnapfhorfgpnog", "vxqjwkkinivukhysecluitftwenbwhythpnkhubxnnegjqnszz"),
             ("siasqgqgjmfvipcgecluitftwenbwhythzybzctvsgbhmxpepr", "mdxrdcwhbxrpqholucluitftwenbwhythgwbnmhpvigofucong")]
    for texts in pairs:
        raws = [t.encode() for t in texts]
        (_, _, _, token, digest), = suffix_dedup.segments(raws, 50, 8)
        assert token[0] == token[1] and digest[0] != digest[1] and len(set(digest.astype(np.uint64) >> np.uint64(24))) == 1
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(t for p in pairs for t in p)], "doc_id long, text string")
    for row in suffix_dedup.find(docs.repartition(2), with_kept=True).collect():
        assert not row.spans and row.n_bytes == len(row.kept) == 50


def test_segments_that_can_share_no_window_are_not_sorted():
    """All that share a window with another document stay; the many that only have their anchor in common go."""
    rng = random.Random(4)
    for length in (10, 16, 50, 120):
        text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
        common, anchor = text(3 * length), text(16)
        raws = [(text(60) + rng.choice([anchor, common[k % 90 : k % 90 + length], common[: length - 1], text(20)]) + text(60)).encode() for k in range(150)]
        columns = [np.concatenate(c) for c in zip(*suffix_dedup.anchored(raws, length, 8), strict=True)]
        who, first, windows, at = columns[0], columns[1], columns[2], columns[5]
        pieces = [raws[t][f:f + n + length - 1] for t, f, n in zip(who.tolist(), first.tolist(), windows.tolist(), strict=True)]
        whole = np.frombuffer(b"".join(p + b"\xff" for p in pieces), np.uint8)
        found = suffix_dedup.may_share(whole, np.array([len(p) + 1 for p in pieces]), at, who, length)
        owners = {}
        for t, piece in zip(who.tolist(), pieces, strict=True):
            for p in range(len(piece) - length + 1):
                owners.setdefault(piece[p:p + length], set()).add(t)
        shares = np.array([any(len(owners[p[k:k + length]]) > 1 for k in range(len(p) - length + 1)) for p in pieces])
        assert shares.any() and not (shares & ~found).any() and found.sum() < 2 * shares.sum() + 20


def test_suffix_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    line = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [line(70), line(49), line(50), line(400)]
    texts = {k: "".join(rng.choice([line(rng.randint(0, 90)), rng.choice(shared), "ab" * 40, shared[3][:rng.randint(0, 400)]]) for _ in range(rng.randint(0, 6))) for k in range(60)}
    texts |= {60: texts[7], 61: texts[7], 62: None, 63: "", 64: line(30), 65: "", 66: "a" * 3000, 67: "b" + "a" * 3000}
    texts[68] = texts[64]
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in suffix_dedup.find(docs, with_kept=True, shard_bytes=3000, memory=500, inner=50).collect()}
    want = removed(texts, 50)
    for key, gone in want.items():
        raw, row = (texts[key] or "").encode(), got[key]
        mine = np.zeros(len(raw), bool)
        for s in row.spans:
            mine[s.start:s.end] = True
        assert (mine == gone).all(), key
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        assert bytes(row.kept) == kept and row.kept_sha256 == hashlib.sha256(kept).hexdigest() and row.n_bytes == len(raw)
    assert suffix_dedup.find(docs.limit(0)).count() == 0
    twice = suffix_dedup.find(spark.createDataFrame([(1, shared[3]), (1, shared[3]), (None, shared[3])], "doc_id long, text string")).collect()
    assert len(twice) == 3 and not any(r.spans for r in twice)


# ---- licenses ------------------------------------------------------------------------------------------------------

def test_license_places_equal_brute_force_and_damaged_notices_are_found(spark):
    notice = "it under the terms of the new GNU General Public License as it was published by the Free Software Foundation"
    texts = ["MIT License, mit-license! MIT. license of the MIT", notice, "Licensed under CC BY-NC 4.0.", "the general public of license", "", None, "license mit",
             "the of " * 5000 + "Apache\nLICENSE " + "x " * 5000 + "general public license " * 3, "mitlicense ümit license"]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(texts)
    for key, text in enumerate(texts):
        own = words(text)
        want = sorted((t.label, k) for t in licenses.PHRASES for p in [t.text.split()] for k in range(len(own)) if own[k:k + len(p)] == p)
        assert got[key].n_words == len(own) and sorted((s.label, s.first) for s in got[key].spans if s.exact) == want
    assert {"gpl"} == {s.label for s in got[1].spans} and any(not s.exact for s in got[1].spans)
    assert {s.label for s in got[2].spans} == {"cc-by-nc"} and not got[3].spans
    assert licenses.scan(docs.limit(0)).count() == 0


def test_no_query_uses_local_checkpoints():
    for path in Path(packing.__file__).parent.glob("*.py"):
        assert "local" + "Checkpoint" not in path.read_text()
    assert F is not None
