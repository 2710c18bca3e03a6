"""License scanning by diagonal voting over hashes of word pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm import wordhash as wh
from loomspark.llm.common import lower_ascii, materialize, pieces, small_enough
from loomspark.shipping import map_arrow


class Template(NamedTuple):
    label: str
    text: str
    base: bool = False


# The base phrases, and the wording of common notices, a passage each.
TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    Template("all-rights-reserved", "all rights reserved"),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    Template("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
)
#: Words of a gram; share of a template's grams that a span must have (all, for templates of fewer than LONG words); diagonals so near are merged.
K, COVERAGE, LONG, NEAR = 2, 0.7, 8, 4
#: Places of grams in templates that are broadcast at most.
BROADCAST = 1_000_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _hashed(texts: pa.Array):
    """Bytes, starts of words, first word of each text, rolling hashes of all K-grams, and their bounds."""
    data, offsets = wh.string_buffer(texts)
    starts, ends, first = wh.words(data, offsets, wh.PUNCT_CLASS)
    return data, offsets, starts, first, *wh.shingle_hashes(wh.word_hashes(data, starts, ends), first, K)


def template_places(templates: Sequence[Template]) -> list[tuple[int, int, int, str, int]]:
    """(template, place, hash, gram, words) of each K-gram of each template."""
    out = []
    for i, t in enumerate(templates):
        w = t.text.split()
        with np.errstate(over="ignore"):
            hashes = _hashed(pa.array([t.text]))[4]
        out += [(i, j, int(h), " ".join(w[j : j + K]), len(w)) for j, h in enumerate(hashes.view(np.int64))]
    return out


def scan(docs: DataFrame, templates: Sequence[Template], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_words, pos, template, tpos, size): each place of a template's gram in a text, and for each text a row at least, with a null template.

    The hashes of all K-grams of all texts are joined with those of templates;
    the words of what meets are then compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, offsets, starts, first, hashes, bounds = _hashed(piece.column("text"))
                n_words = np.diff(first)
                own = starts - np.repeat(offsets[:-1], n_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("id"), pa.array(n_words.astype(np.int64)), piece.column("text").cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(own.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64))),
                    ],
                    names=["id", "n_words", "text", "starts", "hashes"],
                )

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    table = spark.createDataFrame(template_places(templates), "template int, tpos int, h long, gram string, size int")
    read = map_arrow(rows, run, f"id {kind}, n_words long, text binary, starts array<int>, hashes array<long>").withColumn("row", F.monotonically_increasing_id())
    grams = read.select("row", "id", "n_words", "text", "starts", F.posexplode_outer("hashes").alias("pos", "hash"))
    met = grams.join(small_enough(table, BROADCAST), F.col("hash") == F.col("h"), "left").where(F.col("template").isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    begin = F.get("starts", F.col("pos"))
    end = F.coalesce(F.get("starts", F.col("pos") + K), F.octet_length("text"))
    said = F.regexp_replace(lower_ascii(F.substring(F.col("text"), begin + 1, end - begin).cast("string")), _SEPARATORS, " ")
    same = F.coalesce(F.trim(said) == F.col("gram"), F.lit(False))
    met = met.where(same | (F.coalesce("pos", F.lit(0)) == 0))
    return materialize(met.select("row", "id", "n_words", "pos", F.when(same, F.col("template")).alias("template"), "tpos", "size"), "places")


def spans(places: DataFrame) -> DataFrame:
    """(row, template, start, end, coverage): verified spans in words, the end exclusive.

    Each place of a gram in a text votes for the diagonal (place in the text
    less place in the template) of that gram's places in templates. A short
    template needs all its grams on one diagonal. A longer one is sought around
    each diagonal that has the most votes of those not more than NEAR away: its
    own and its neighbours' votes are merged, so that some words put in or left
    out don't break a span, each place in the template and in the text counting
    once. Grams of the template that stand elsewhere, however many, have other
    diagonals and don't matter. A span counts if it has COVERAGE of the grams.
    """
    votes = places.where("template is not null").select("row", "template", "size", "tpos", "pos", (F.col("pos") - F.col("tpos")).alias("d")).distinct()
    grams = F.col("size") - K + 1
    diagonals = votes.groupBy("row", "template", "size", "d").agg(F.count("*").alias("votes"))
    short = F.col("size") < LONG
    whole = diagonals.where(short & (F.col("votes") == grams))
    whole = whole.select("row", "template", F.col("d").cast("long").alias("start"), (F.col("d") + F.col("size")).cast("long").alias("end"), F.lit(1.0).alias("coverage"))
    around = W.partitionBy("row", "template").orderBy("d").rangeBetween(-NEAR, NEAR)
    best = F.max(F.struct("votes", (-F.col("d")).alias("minus"))).over(around)
    centres = diagonals.where(~short).withColumns({"best": best, "sum": F.sum("votes").over(around)})
    centres = centres.where((F.col("best.votes") == F.col("votes")) & (F.col("best.minus") == -F.col("d")) & (F.col("sum") >= COVERAGE * grams))
    # Diagonals are dealt to bands of NEAR, so that only those of three bands meet.
    bands = F.sequence(F.floor(F.col("d") / NEAR) - 1, F.floor(F.col("d") / NEAR) + 1)
    centres = centres.select("row", "template", F.col("d").alias("c"), F.explode(bands).alias("band"))
    near = votes.where(~short).withColumn("band", F.floor(F.col("d") / NEAR)).join(centres, ["row", "template", "band"]).where(F.abs(F.col("d") - F.col("c")) <= NEAR)
    merged = near.groupBy("row", "template", "size", "c").agg(F.least(F.count_distinct("tpos"), F.count_distinct("pos")).alias("votes"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    share = F.col("votes") / grams
    merged = merged.where(share >= COVERAGE)
    return whole.union(merged.select("row", "template", F.col("low").cast("long"), (F.col("high") + K).cast("long"), share))


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    n_base counts all places of base templates, first_word and last_word are
    their smallest and largest start; base_labels and labels are distinct,
    sorted and comma-joined, the latter with the labels of all verified spans;
    score is the best coverage, 0 without a span. Null texts count as empty:
    no words, no places, empty labels, null first and last word. Repeated rows
    and null ids have rows of their own; no rows give no rows; other columns
    are ignored. Templates of fewer than K words are ignored. Texts, however
    long, are scanned whole.
    """
    templates = [t._replace(text=" ".join(t.text.lower().split())) for t in templates if len(t.text.split()) >= K]
    places = scan(docs, templates, id_col, text_col)
    kinds = F.broadcast(docs.sparkSession.createDataFrame([(i, t.label, t.base) for i, t in enumerate(templates)], "template int, label string, base boolean"))
    found = spans(places).join(kinds, "template")
    base = F.col("base")
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")  # noqa: E731  labels of one row: as many as templates have
    found = found.groupBy("row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.lit(True)).alias("labels"), F.max("coverage").alias("score"),
    )
    out = places.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words")).join(found, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
