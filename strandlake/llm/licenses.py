"""Licence scan: sparse TF-IDF cosine to templates, then inheritance along directories.

In every text that speaks of a licence, every line is a candidate header, alone and joined with
the lines below it until they have as many words as the longest template, so wrapped notices are
found. The whole text is compared with the full licence texts. Each becomes a sparse vector over
the templates' words, plus one dimension for all other words; inverse document frequencies come
from all candidates of the corpus. The nearest template by cosine, if near enough, is the row's
own licence; a near full text comes before any header. A text that is near a full licence text,
or mostly a header, is a licence file and speaks for its directory; rows without an own licence
take that of the nearest ancestor directory that has one, by joins on paths.

The vocabulary and the templates are fixed and small, so they are broadcast; what is joined by
path is one row per directory, and of a directory's files only the best stays. Rows meet the result
for their directory by broadcast where the directory is hot, and by a shuffle elsewhere.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_key, map_arrow, materialize

#: Notices that these licences prescribe or that are customary for them.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License."),
    "All-rights-reserved": ("All rights reserved.", "Copyright"),
}
#: Every template has one of these; words may be parted by line ends and comment signs.
MARKS = "(?i)licen[sc]e|copyright|spdx|" + "|".join(
    p.replace(" ", "[^a-z0-9]+") for p in ("rights reserved", "redistribution and use", "permission is hereby", "free software", "source code form")
)
#: A header needs this cosine to its template.
NEAR = 0.6
#: A full licence text needs this cosine to its template.
NEAR_FULL = 0.85
#: A licence file is a full text, or has this share of its words in one header.
FILE_SHARE = 0.5
#: A directory with over this part of all rows is hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
_OTHER = ""


#: The line number that stands for the whole text.
WHOLE = -1


def full_texts() -> dict[str, str]:
    """The licences' whole texts; Creative Commons' are not among them."""
    return {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def terms(text: str) -> list[str]:
    """Without full stops at either end, so "2.0" stays and "license." is "license"."""
    return [t for t in (x.strip(".") for x in re.split("[^a-z0-9.]+", text.lower())) if t]


def default_path() -> Column:
    """source/lang/doc_id, for tables without a path."""
    return F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.coalesce(F.col("doc_id").cast("string"), F.lit("_")))


def _vectors(vocabulary: frozenset[str], full: frozenset[str], longest: int):
    """Per text (k, path, line, words, here, term, tf): its candidates' words, the whole's too."""
    marks, word = re.compile(MARKS), re.compile("[^\x20\x09-\x0D]+")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def put(k: int, path: str, line: int, words: int, here: int, said: list[str], known: frozenset[str]) -> None:
            counts = Counter(t if t in known else _OTHER for t in said)
            out.extend((k, path, line, words, here, t, n) for t, n in counts.items())

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["k", "path", "line", "words", "here", "term", "tf"])

        for k, path, text in zip(*(batch.column(c).to_pylist() for c in ("k", "path", "text"))):
            lines = [x for x in text.split("\n") if terms(x)]
            said = [terms(x) for x in lines]
            sizes = [len(word.findall(x)) for x in lines]
            words = len(word.findall(text))
            put(k, path, WHOLE, words, words, [t for x in said for t in x], full)
            number = 0
            for i in range(len(lines)):
                end, length = i, 0
                # each start with every number of lines that a template can take up
                while end < len(lines) and length < longest:
                    length += len(said[end])
                    end += 1
                    if marks.search(" ".join(lines[i:end])):
                        put(k, path, number, words, sum(sizes[i:end]), [t for x in said[i:end] for t in x], vocabulary)
                        number += 1
                if len(out) > 20_000:
                    yield flush()
        if out:
            yield flush()

    return run


def _marked(docs: DataFrame, path: Column) -> DataFrame:
    """(k, path, text): the whole texts that have a candidate."""
    return docs.where(F.col("text").rlike(MARKS)).select(id_key().alias("k"), path.alias("path"), F.col("text").cast("string").alias("text"))


def nearest(docs: DataFrame, path: Column) -> tuple[DataFrame, DataFrame]:
    """(k, path, line, words, licence, cosine, share) of the best template of each header, and of
    the best full text of each whole text. Equal copies of (k, path) count as one."""
    short = [(licence, terms(body)) for licence, bodies in TEMPLATES.items() for body in bodies]
    whole = [(licence, terms(body)) for licence, body in full_texts().items()]
    known, full = (frozenset(t for _, body in group for t in body) for group in (short, whole))
    schema = "k long, path string, line long, words long, here long, term string, tf long"
    vector = materialize(map_arrow(_marked(docs, path), _vectors(known, full, max(len(b) for _, b in short)), schema), "vectors")
    return _scored(vector.where(F.col("line") != WHOLE), short), _scored(vector.where(F.col("line") == WHOLE), whole)


def _scored(vector: DataFrame, bodies: list[tuple[str, list[str]]]) -> DataFrame:
    rows = [(i, licence, t, n) for i, (licence, body) in enumerate(bodies) for t, n in Counter(body).items()]
    counts = vector.sparkSession.createDataFrame(rows, "template int, licence string, term string, tf long")
    row = ["k", "path", "line", "words"]
    vector = vector.groupBy(*row, "here", "term").agg(F.max("tf").alias("tf"))
    total = vector.select("k", "path", "line").distinct().count()
    # at most one row per word of the vocabulary
    idf = materialize(vector.groupBy("term").agg((F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.count("*"))) + 1).alias("idf")), "idf")
    rare = F.lit(float(total + 1))
    weighted = vector.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    sides = counts.join(F.broadcast(idf), "term", "left").withColumn("v", F.col("tf") * F.coalesce("idf", F.log(rare) + 1))
    sizes = sides.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    sides = F.broadcast(sides.select("template", "licence", "term", "v").join(sizes, "template"))
    lengths = weighted.groupBy(*row, "here").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = weighted.join(sides, "term").groupBy(*row, "template", "licence", "size").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    scored = dots.join(lengths, row).withColumn("cosine", F.round(F.col("dot") / (F.col("size") * F.col("length")), 6))
    best = F.max_by(F.struct("licence", "cosine"), F.struct("cosine", "licence")).alias("b")
    return scored.groupBy(*row, "here").agg(best).select(
        *row, F.col("b.licence").alias("licence"), F.col("b.cosine").alias("cosine"), (F.col("here") / F.col("words")).alias("share")
    )


def _ancestors(path: Column) -> Column:
    """The directories above a path, the nearest first; the root is ''."""
    parts = F.split(path, "/")
    depth = F.size(parts)
    return F.transform(F.sequence(depth - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan(docs: DataFrame, path: Column | None = None, near: float = NEAR, file_share: float = FILE_SHARE, hot_share: int = HOT_SHARE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, and what ``path`` needs): doc_id, path, own_licence,
    own_cosine, licence, inherited_from, licence_files.

    own_licence: of the nearest full text, else of the nearest header (ties: by name). licence: that, or of the nearest
    ancestor directory with licence files (there: of the best cosine, then smallest path, then
    doc_id). licence_files: of that directory. Nothing near: nulls.

    Null or empty text: no own licence. Null path: a file in the root directory. Null doc_id:
    null. Rows that repeat path and doc_id share the best header of all of them. Empty table:
    empty result. Other columns are ignored."""
    path = F.coalesce(path if path is not None else default_path(), F.lit(""))
    lines, wholes = nearest(docs, path)
    full = F.lit(True)
    found = lines.where(F.col("cosine") >= near).withColumn("full", ~full).unionByName(wholes.where(F.col("cosine") >= NEAR_FULL).withColumn("full", full))
    best = F.max_by(F.struct("licence", "cosine"), F.struct("full", "cosine", "licence")).alias("b")
    own = materialize(
        found.groupBy("k", "path").agg(best, F.max("share").alias("share")).select(
            "k", "path", F.col("b.licence").alias("own_licence"), F.col("b.cosine").alias("own_cosine"), "share"
        ),
        "own",
    )
    folder = F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.size(F.split("path", "/")) - 1), "/")
    first = F.min_by("own_licence", F.struct((-F.col("own_cosine")).alias("c"), "path", "k")).alias("folder_licence")
    folders = materialize(
        own.where(F.col("share") >= file_share).groupBy(folder.alias("folder")).agg(first, F.count("*").alias("licence_files")), "folders"
    )
    rows = materialize(docs.select(id_key().alias("k"), path.alias("path")), "paths")
    # only distinct directories are joined along their ancestors
    hot_size = rows.count() // hot_share
    places = materialize(rows.groupBy(folder.alias("home")).agg((F.count("*") > hot_size).alias("hot")), "places")
    above = places.select("home", F.posexplode(_ancestors(F.concat(F.when(F.col("home") != "", F.concat("home", F.lit("/"))).otherwise(""), F.lit("x")))).alias("up", "folder"))
    heirs = materialize(
        above.join(folders, "folder")
        .groupBy("home")
        .agg(F.min_by(F.struct("folder", "folder_licence", "licence_files"), "up").alias("n")),
        "heirs",
    )
    # rows of hot directories find theirs in a short list and never meet in one task
    hot = F.broadcast(materialize(places.where("hot").select("home").join(heirs, "home", "left"), "hot"))
    housed = rows.withColumn("home", folder)
    cold = housed.join(hot.select("home"), "home", "left_anti").join(heirs, "home", "left")
    out = cold.unionByName(housed.join(hot, "home")).join(own.drop("share"), ["k", "path"], "left")
    inherits = F.col("own_licence").isNull()
    return out.select(
        id_back(F.col("k")).alias("doc_id"),
        "path",
        "own_licence",
        "own_cosine",
        F.coalesce("own_licence", "n.folder_licence").alias("licence"),
        F.when(inherits, F.col("n.folder")).alias("inherited_from"),
        F.when(inherits, F.col("n.licence_files")).alias("licence_files"),
    )
