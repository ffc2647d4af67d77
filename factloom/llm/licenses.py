"""License scans: TF-IDF cosine of lines and files to templates, and inheritance along directories."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.blocks import text_blocks
from factloom.session import materialize

#: Notices by which licences are usually declared (fixed values).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

_TERM = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)([.\-_][^/]*)?$"


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def term_weights(text: str, idf: dict[str, float], unseen: float) -> dict[str, float]:
    return {t: n * idf.get(t, unseen) for t, n in Counter(terms(text)).items()}


def document_frequencies(files: DataFrame, vocabulary: set[str]) -> tuple[int, dict[str, int]]:
    """Number of files, and of files that hold each term of the templates (a vocabulary of fixed size)."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for block in text_blocks(batches):
            for text in block.column("__text").to_pylist():
                seen.update(vocabulary.intersection(terms(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    counted = files.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return files.count(), {r["term"]: r["n"] for r in counted.collect()}


def best_matches(files: DataFrame, templates: list[tuple[str, str]], n_files: int, df: dict[str, int]) -> DataFrame:
    """(path, found, score): the template most like any line, or like the whole text, of each file."""
    idf = {t: log((1 + n_files) / (1 + df.get(t, 0))) + 1 for _, text in templates for t in terms(text)}
    unseen = log(1 + n_files) + 1
    postings: dict[str, list[tuple[int, float]]] = {}
    for k, (_, text) in enumerate(templates):
        weights = term_weights(text, idf, unseen)
        size = sqrt(sum(w * w for w in weights.values()))
        for t, w in weights.items():
            postings.setdefault(t, []).append((k, w / size))

    def score(text: str) -> tuple[str | None, float]:
        best: tuple[float, str | None] = (0.0, None)
        for unit in {*text.split("\n"), text}:
            counts = Counter(terms(unit))
            dots: dict[int, float] = {}
            for t in postings.keys() & counts.keys():
                for k, w in postings[t]:
                    dots[k] = dots.get(k, 0.0) + counts[t] * idf[t] * w
            if dots:
                size = sqrt(sum((n * idf.get(t, unseen)) ** 2 for t, n in counts.items()))
                for k, dot in dots.items():
                    value, name = round(dot / size, 9), templates[k][0]
                    if value > best[0] or (value == best[0] and name < best[1]):
                        best = (value, name)
        return best[1], best[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            found = [score(t) for t in block.column("__text").to_pylist()]
            arrays = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([block.column("path"), *arrays], ["path", "found", "score"])

    return files.select("path", "text").mapInArrow(run, "path string, found string, score double")


def _directory(path: str) -> F.Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def inherit(found: DataFrame) -> DataFrame:
    """Add ``inherited`` and ``from_dir`` to (path, own): the licence of the nearest directory, from the file's
    own upwards, that holds a licence file.

    Ancestors are joined for distinct directories, not for files. Several licence files of one directory
    are joined with " AND ".
    """
    placed = found.withColumn("dir", _directory("path"))
    files = placed.where(F.col("path").rlike(LICENSE_FILE) & F.col("own").isNotNull())
    held = files.groupBy(F.col("dir").alias("from_dir")).agg(F.concat_ws(" AND ", F.sort_array(F.collect_set("own"))).alias("inherited"))
    dirs = placed.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    chains = dirs.select("dir", F.explode(above).alias("from_dir"))
    nearest = chains.distinct().join(held, "from_dir").groupBy("dir").agg(
        F.max_by("inherited", F.length("from_dir")).alias("inherited"), F.max_by("from_dir", F.length("from_dir")).alias("from_dir")
    )
    return placed.join(nearest, "dir", "left").drop("dir")


def scan_licenses(files: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.75) -> DataFrame:
    """Licence of every row of ``files`` (path, text).

    Returns path, own (best template if its cosine reaches ``threshold``, else null), score (the best
    cosine, also below the threshold), inherited and from_dir (nearest directory with a licence file) and
    license (own, else inherited).

    Every line of a file and the file as a whole are compared, so a notice is found wherever it stands.
    Terms are weighted by their document frequency over all files. Ties go to the first name. Null or
    empty texts match nothing but inherit; a null path has no directory; rows that repeat a path are
    judged each, and a directory counts a licence once. Other columns are ignored.
    """
    templates = templates or TEMPLATES
    files = files.select(F.col("path").cast("string").alias("path"), "text")
    n_files, df = document_frequencies(files, {t for _, text in templates for t in terms(text)})
    own = F.when(F.col("score") >= threshold, F.col("found"))
    found = best_matches(files, templates, n_files, df).select("path", own.alias("own"), "score")
    out = inherit(materialize(found, "licenses"))
    return out.select("path", "own", "score", "inherited", "from_dir", F.coalesce("own", "inherited").alias("license"))
