"""License scan by diagonal voting.

All rolling word k-gram hashes of the documents are joined in Spark to the positions of the same grams in a small library
of license templates. A match votes for (document, template, offset between the two positions): its diagonal. Diagonals
of one template that lie next to each other, as after a word was put in or left out, are merged; what has enough votes is
a candidate span, and candidate spans are verified word by word against the text.

The gram rows are aggregated before the first shuffle. The library is given as a list, so its size is known before it is
broadcast; texts travel only for documents with candidates, which a bitmap of fixed size (1 MB) picks out of the scan.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import ASCII_WORDS, ascii_words, bitmap, gram_hashes, id_place, in_bitmap, keep, map_slices, slices, texts_of, word_hashes


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False  # every word must stand as it is


#: Fixed phrases that are found wherever their words stand one after the other.
PHRASES = (Template("mit", "mit license", True), Template("apache", "apache license", True), Template("gpl", "general public license", True))
#: Notices as they are commonly written (opening words of the public license texts and usual grant lines).
NOTICES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl", "it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("mit-grant", "Released under the MIT License"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
SIZES = (2, 3)  # words in a gram: templates of two words are found by pairs, all others by threes
BLOCK = 4096  # words of a document in one row of hashes
MOST_LIBRARY_WORDS = 100_000


def _hashes(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw.translate(ASCII_WORDS), np.uint8)
    return word_hashes(data, data != 32)[2]


def _library(templates: tuple[Template, ...]) -> list[tuple[int, int, int]]:
    """Rows (gram hash, template, position)."""
    if sum(len(ascii_words(t.text.encode())) for t in templates) > MOST_LIBRARY_WORDS:
        raise ValueError("the library is too large to be broadcast")
    rows = []
    for number, t in enumerate(templates):
        words = _hashes(t.text.encode())
        if len(words) < min(SIZES):
            raise ValueError(f"template {t.label!r} has fewer than {min(SIZES)} words")
        for at, value in enumerate(gram_hashes(words, min(max(SIZES), len(words))).view(np.int64)):
            rows.append((int(value), number, at))
    return rows


def _grams(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, first word, grams) where grams has at 2 * p and 2 * p + 1 the pair and the three that begin at word p."""

    def handle(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, firsts, grams, keys = [], [], [], batch[id_col].to_pylist()
        raws = [r or b"" for r in texts_of(batch, text_col)]
        data = np.frombuffer(b" ".join(raws).translate(ASCII_WORDS), np.uint8)
        begin, _, words = word_hashes(data, data != 32)
        edges = np.searchsorted(begin, np.cumsum([0] + [len(r) + 1 for r in raws]))
        for key, low, high in zip(keys, edges[:-1], edges[1:], strict=True):
            for at in range(int(low), int(high) - 1, BLOCK):
                own = words[at : min(at + BLOCK + 2, high)]
                both = np.zeros((min(BLOCK, len(own)), 2), np.uint64)
                for k, size in enumerate(SIZES):
                    got = gram_hashes(own, size)[: len(both)]
                    both[: len(got), k] = got
                ids.append(key)
                firsts.append(at - int(low))
                grams.append(both.reshape(-1).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(id_col).type), pa.array(firsts, pa.int64()), pa.array(grams, pa.list_(pa.int64()))], [id_col, "first", "grams"])

    schema = T.StructType([docs.schema[id_col], T.StructField("first", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))])
    return map_slices(docs.select(id_col, text_col), text_col, handle, schema, 1_000_000)


def candidates(docs: DataFrame, templates: tuple[Template, ...], *, id_col: str = "doc_id", text_col: str = "text", least_votes: float = 0.3) -> DataFrame:
    """Spans to verify: id, template number, first and last word begin, votes. Neighbouring diagonals are merged."""
    spark = docs.sparkSession
    library = spark.createDataFrame(_library(templates), "gram long, template int, place long")
    facts = spark.createDataFrame([(k, max(1, n - min(3, n) + 1), 0 if t.exact else n // 6) for k, t in enumerate(templates) for n in [len(ascii_words(t.text.encode()))]],
                                  "template int, grams long, slack long")
    rolled = _grams(docs, id_col, text_col).select(id_col, "first", F.posexplode("grams").alias("k", "gram"))
    votes = (rolled.join(F.broadcast(library), "gram")
             .select(id_col, "template", (F.col("first") + F.expr("k div 2")).alias("word"), "place")
             .groupBy(id_col, "template", (F.col("word") - F.col("place")).alias("diagonal"))
             .agg(F.count("*").alias("votes"), F.min("word").alias("low"), F.max("word").alias("high"))
             .join(F.broadcast(facts), "template"))
    order = Window.partitionBy(id_col, "template").orderBy("diagonal")
    jump = F.col("diagonal") - F.lag("diagonal").over(order)
    merged = (votes.withColumn("begins", F.coalesce((jump > F.col("slack")) | (F.col("slack") == 0), F.lit(True)).cast("long"))
              .withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    return (merged.groupBy(id_col, "template", "run")
            .agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("low_diagonal"), F.min("low").alias("low"), F.max("high").alias("high"), F.first("grams").alias("grams"))
            .where(F.col("votes") >= F.greatest(F.lit(1.0), F.col("grams") * least_votes))
            .select(id_col, "template", F.greatest(F.lit(0), F.least("low", "low_diagonal")).alias("low"), "high", "votes"))


def _verified(words: list[bytes], spans: list[tuple[int, int, int]], wanted: list[list[bytes]], templates: tuple[Template, ...], least: float) -> list[tuple[int, int, int, float]]:
    """(template, first word, end, similarity) of the spans that hold their template."""
    out = set()
    for number, low, high in spans:
        target, exact = wanted[number], templates[number].exact
        if exact:
            if words[low : low + len(target)] == target:
                out.add((number, low, low + len(target), 1.0))
            continue
        end = min(len(words), high + 3 + len(target) // 6)
        for at in range(low, max(low + 1, end - len(target) // 2), max(1, len(target))):  # long runs hold the template several times
            part = words[at : min(end, at + len(target) + len(target) // 6 + 1)]
            match = difflib.SequenceMatcher(None, target, part, autojunk=False)
            same = [b for b in match.get_matching_blocks() if b.size]
            if same and (likeness := sum(b.size for b in same) / max(len(target), same[-1].b + same[-1].size - same[0].b)) >= least:
                out.add((number, at + same[0].b, at + same[-1].b + same[-1].size, round(likeness, 6)))
    return sorted(out)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[Template, ...] = PHRASES, notices: tuple[Template, ...] = NOTICES,
         least_votes: float = 0.3, least_likeness: float = 0.75) -> DataFrame:
    """One row per document: id, n_words, spans array<struct<label, exact, first, end, likeness>> in words, sorted.

    A null text has no words. Rows with one id and different texts are each judged by their own words; rows with a null
    id are read by no join and give no spans. Other columns of the documents are not carried.
    """
    templates = (*phrases, *notices)
    docs = docs.select(id_col, text_col)
    found = candidates(docs, templates, id_col=id_col, text_col=text_col, least_votes=least_votes)
    spans = found.groupBy(id_col).agg(F.collect_list(F.struct("template", "low", "high")).alias("spans"))
    spans = keep(spans, "license-spans")
    bits = bitmap(spans, id_col)
    wanted = [ascii_words(t.text.encode()) for t in templates]

    def pick(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Word counts of all texts; the text itself only where the bitmap has the id."""
        raws, marked = texts_of(batch, text_col), in_bitmap(bits, np.asarray(batch["place"]))
        counts = [len(ascii_words(r)) for r in raws]
        return pa.RecordBatch.from_arrays([batch[id_col], pa.array(counts, pa.int64()), pa.array([r if m else None for r, m in zip(raws, marked, strict=True)], pa.binary())], [id_col, "n_words", "held"])

    picked = map_slices(docs.withColumn("place", id_place(id_col)), text_col, pick, T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("held", T.BinaryType())]))
    span_type = pa.list_(pa.struct([("label", pa.string()), ("exact", pa.bool_()), ("first", pa.int64()), ("end", pa.int64()), ("likeness", pa.float64())]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "held"):
            rows = []
            for raw, cand in zip(batch["held"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                got = _verified(ascii_words(raw), [(c["template"], c["low"], c["high"]) for c in cand], wanted, templates, least_likeness) if raw and cand else []
                rows.append([{"label": templates[n].label, "exact": templates[n].exact, "first": a, "end": b, "likeness": s} for n, a, b, s in got])
            yield pa.RecordBatch.from_arrays([batch[id_col], batch["n_words"], pa.array(rows, span_type)], [id_col, "n_words", "spans"])

    span = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("exact", T.BooleanType()), T.StructField("first", T.LongType()),
                                     T.StructField("end", T.LongType()), T.StructField("likeness", T.DoubleType())]))
    return picked.join(spans, id_col, "left").mapInArrow(verify, T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("spans", span)]))
