"""Quality rules: base rules, and robust multivariate outliers of text statistics."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from math import sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.blocks import coded, text_blocks, words
from factloom.session import materialize

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 8
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: Statistic vectors, and the spread below which a coordinate's differences mean nothing. A text without
#: symbols or repeats has zeros there, as have most: without such a floor their covariance is singular.
COORDINATES = {
    "log_words": ("ln(n_words + 1)", 0.5),
    "word_length": ("ln((word_chars + 5) / (n_words + 1))", 0.1),
    "symbols": ("sqrt(n_symbols / (word_chars + 1))", 0.05),
    "dup_lines": ("sqrt(n_dup_lines / (n_lines + 1))", 0.1),
    "repeats": ("sqrt(n_repeat_words / (n_words + 1))", 0.1),
}
SIZE = len(COORDINATES)


def window_ids(codes: np.ndarray, width: int) -> np.ndarray:
    """Ids of all runs of ``width`` codes: equal ids exactly for equal runs (by doubling the width)."""
    ids, span = pd.factorize(codes)[0].astype(np.int64), 1
    while span < width and len(ids):
        step = min(span, width - span)
        if len(ids) <= step:
            return ids[:0]
        ids = pd.factorize(ids[: len(ids) - step] * (ids.max() + 1) + ids[step:])[0].astype(np.int64)
        span += step
    return ids


def repeated_words(codes: np.ndarray, row: np.ndarray, n: int, width: int = WINDOW) -> np.ndarray:
    """Per text, the number of words that lie in a window of ``width`` words found at least twice in it."""
    if len(codes) < width:
        return np.zeros(n, np.int64)
    # Words of different texts differ here, so a window across two texts is found once.
    ids = window_ids(row * (codes.max() + 1) + codes, width)
    often = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(codes) + 1, np.int64)
    edge[: len(ids)] += often
    edge[width : width + len(ids)] -= often
    covered = np.cumsum(edge)[:-1] > 0
    return np.bincount(row[covered], minlength=n)


def block_statistics(texts: pa.Array) -> list[np.ndarray]:
    """STATISTICS of each text."""
    n = len(texts)
    flat, row = words(texts)
    codes, _ = coded(flat)
    n_words = np.bincount(row, minlength=n)
    chars, symbols, dup_lines, n_lines = (np.zeros(n, np.int64) for _ in range(4))
    for i, text in enumerate(texts.to_pylist()):
        raw = text.encode()
        chars[i] = len(text) - (len(raw) - len(raw.translate(None, BLANKS)))
        symbols[i] = len(raw) - len(raw.translate(None, SYMBOLS))
        lines = [line for line in raw.split(b"\n") if line.strip()]
        n_lines[i] = len(lines)
        dup_lines[i] = len(lines) - len(set(lines))
    return [n_words, chars, symbols, dup_lines, repeated_words(codes, row, n), n_lines]


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and STATISTICS of every row; a null text has no words and no lines."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            numbers = [pa.array(x.astype(np.int64)) for x in block_statistics(block.column("__text"))]
            kept = [block.column(c) for c in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays([*kept, *numbers], ["doc_id", "lang", "source", *STATISTICS])

    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "lang", "source")}
    schema = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), *(f"{s} long" for s in STATISTICS)])
    return docs.select("doc_id", "text", "lang", "source").mapInArrow(run, schema)


def chi_square_quantile(p: float, freedom: int) -> float:
    """Wilson and Hilferty's approximation."""
    spread = 2 / (9 * freedom)
    return freedom * (1 - spread + NormalDist().inv_cdf(p) * sqrt(spread)) ** 3


def _group_name(*columns: str) -> Column:
    """A name for a group that tells null from any string."""
    return F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns])


def place_in_groups(rows: DataFrame, least: int) -> DataFrame:
    """Add ``grp``: language and source if they have ``least`` rows; the rows of smaller groups are pooled
    by language, and where this is still too small, in one group (null if that is too small as well)."""
    named = rows.withColumn("both", _group_name("lang", "source")).withColumn("one", _group_name("lang"))
    both = named.groupBy("both", "one").agg(F.count("*").alias("n"))
    small = both.where(F.col("n") < least).groupBy("one").agg(F.sum("n").alias("n_one"))
    rest = small.where(F.col("n_one") < least).agg(F.sum("n_one").alias("n_all"))
    places = both.join(small, "one", "left").crossJoin(rest)
    level = (
        F.when(F.col("n") >= least, F.concat(F.lit("source "), F.col("both")))
        .when(F.col("n_one") >= least, F.concat(F.lit("language "), F.col("one")))
        .when(F.col("n_all") >= least, F.lit("all"))
    )
    # Stored, as all tables of groups here: joins then see their size, so they are broadcast or a hot group is split.
    places = materialize(places.select("both", level.alias("grp")), "places")
    return named.join(places, "both").drop("both", "one")


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, sums and sums of products: all that a mean and a covariance need, added up in each task."""
    x = F.col("x")
    sums = [F.sum(x[i]) for i in range(SIZE)]
    products = [F.sum(x[i] * x[j]) for i in range(SIZE) for j in range(SIZE)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*sums).alias("s"), F.array(*products).alias("ss"))


_FIT = "grp string, start int, centre array<double>, inverse array<double>, log_det double"


def _fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centre, inverse covariance (with the floors added) and its log determinant from moments."""
    floor = np.diag([f**2 for _, f in COORDINATES.values()])
    for frame in frames:
        out = []
        for r in frame.itertuples():
            mean = np.asarray(r.s, float) / r.n
            cov = np.asarray(r.ss, float).reshape(SIZE, SIZE) / r.n - np.outer(mean, mean) + floor
            out.append((r.grp, r.start, mean, np.linalg.inv(cov).ravel(), float(np.linalg.slogdet(cov)[1])))
        yield pd.DataFrame(out, columns=["grp", "start", "centre", "inverse", "log_det"])


def _distance(x: Column, centre: Column, inverse: Column) -> Column:
    """Squared Mahalanobis distance."""
    d = [x[i] - centre[i] for i in range(SIZE)]
    return reduce(lambda a, b: a + b, [d[i] * d[j] * inverse[SIZE * i + j] for i in range(SIZE) for j in range(SIZE)])


def minimum_covariance(rows: DataFrame, share: float = 0.75, steps: int = 5) -> DataFrame:
    """Minimum-covariance-determinant fit of ``x`` in each ``grp``: _FIT and scale.

    Two starts, the mean with the full covariance and the medians with their spreads, are concentrated
    in turn: distances of all rows, the ``share`` nearest of each group, their mean and covariance. The
    start with the smaller determinant wins. ``scale`` makes the median distance that of normal data.
    Each step is two aggregates over narrow rows, however large a group is; quantiles are approximate
    (1 in 10,000 of a group) and deterministic up to the order of merging.
    """
    both = rows.select("grp", "x")
    plain = _moments(both, ["grp"]).withColumn("start", F.lit(0)).select("grp", "start", "n", "s", "ss")
    middle = both.groupBy("grp").agg(*[F.percentile_approx(F.col("x")[i], F.lit(0.5), F.lit(10000)).alias(f"m{i}") for i in range(SIZE)])
    away = both.join(materialize(middle, "middle"), "grp")
    spread = away.groupBy("grp").agg(
        *[F.percentile_approx(F.abs(F.col("x")[i] - F.col(f"m{i}")), F.lit(0.5), F.lit(10000)).alias(f"d{i}") for i in range(SIZE)],
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(SIZE)],
    )
    m = [F.col(f"m{i}") for i in range(SIZE)]
    d2 = [F.pow(F.col(f"d{i}") * F.lit(1.4826), F.lit(2)) for i in range(SIZE)]
    products = [m[i] * m[j] + (d2[i] if i == j else F.lit(0.0)) for i in range(SIZE) for j in range(SIZE)]
    robust = spread.select("grp", F.lit(1).alias("start"), F.lit(1).cast("long").alias("n"), F.array(*m).alias("s"), F.array(*products).alias("ss"))
    fit = materialize(plain.unionByName(robust).mapInPandas(_fit, _FIT), "fit")
    for _ in range(steps):
        far = both.join(fit, "grp").select("grp", "start", "x", _distance(F.col("x"), F.col("centre"), F.col("inverse")).alias("d2"))
        limit = far.groupBy("grp", "start").agg(F.percentile_approx("d2", F.lit(share), F.lit(10000)).alias("limit"))
        limit = materialize(limit, "limit")
        near = far.join(limit, ["grp", "start"]).where(F.col("d2") <= F.col("limit"))
        fit = materialize(_moments(near, ["grp", "start"]).mapInPandas(_fit, _FIT), "fit")
    best = fit.groupBy("grp").agg(F.min_by("start", F.struct("log_det", "start")).alias("start"))
    fit = fit.join(best, ["grp", "start"])
    far = both.join(fit, "grp").select("grp", _distance(F.col("x"), F.col("centre"), F.col("inverse")).alias("d2"))
    half = far.groupBy("grp").agg(F.percentile_approx("d2", F.lit(0.5), F.lit(10000)).alias("half"))
    scale = F.greatest(F.col("half") / F.lit(chi_square_quantile(0.5, SIZE)), F.lit(1.0))
    return materialize(fit.join(half.select("grp", scale.alias("scale")), "grp"), "fit")


def judge_documents(docs: DataFrame, confidence: float = 1 - 1e-7, share: float = 0.75, least: int = 50) -> DataFrame:
    """Statistics and verdict of every row of ``docs`` (doc_id, text, lang, source).

    Returns doc_id, STATISTICS, base_failed, distance (squared, null without a fit), cutoff and kept.
    base_failed: under 20 words, or over 30 % of the words in repeated windows of 8. Others are kept unless
    their vector lies beyond the ``confidence`` quantile of a chi-square distribution around the robust
    centre of their language and source. The fit takes documents that passed the base rules. Groups of
    fewer than ``least`` rows are pooled (place_in_groups); without any fit the base rules decide.

    A null text is one without words. Null lang or source is a group like others. Repeated rows count as
    often as they occur and get equal verdicts. Other columns are ignored; an empty table gives an empty
    result. No group is gathered in a task: fits are aggregates over narrow rows.
    """
    counted = text_statistics(docs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    vector = F.array(*[F.expr(e).cast("double") for e, _ in COORDINATES.values()])
    counted = materialize(counted.withColumn("base_failed", failed).withColumn("x", vector), "statistics")
    passed = materialize(place_in_groups(counted.where("not base_failed"), least), "passed")
    fit = minimum_covariance(passed.where("grp is not null"), share)
    cutoff = F.lit(chi_square_quantile(confidence, SIZE))
    judged = passed.join(fit.select("grp", "centre", "inverse", "scale"), "grp", "left")
    judged = judged.withColumn("distance", _distance(F.col("x"), F.col("centre"), F.col("inverse")) / F.col("scale"))
    judged = judged.withColumn("kept", F.coalesce(F.col("distance") <= cutoff, F.lit(True)))
    out = ["doc_id", *STATISTICS, "base_failed", "distance", "kept"]
    failed_rows = counted.where("base_failed").withColumn("distance", F.lit(None).cast("double")).withColumn("kept", F.lit(False))
    return judged.select(*out).unionByName(failed_rows.select(*out)).withColumn("cutoff", cutoff)
