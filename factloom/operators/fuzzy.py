"""Names within a number of edits of each other, over an index of their parts.

A string cut into k + 1 parts keeps one of them whole under k edits, and not more than k places away. So each known name is
indexed by its parts, each asked one is looked up by its pieces of the same length near the same place, and what meets
is verified. Exact, and never a comparison of all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _part(length: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and size of part ``i`` of a string of ``length``: the last parts take what does not divide evenly."""
    base, long_ones = F.floor(length / parts), length % parts
    before = F.greatest(F.lit(0), i - (F.lit(parts) - long_ones))
    size = base + F.when(i >= F.lit(parts) - long_ones, 1).otherwise(0)
    return (i * base + before).cast("int"), size.cast("int")


def _parts(text: str, edits: int) -> Column:
    """(length, i, piece) of each part of a known name."""
    length = F.length(text)

    def entry(i: Column) -> Column:
        start, size = _part(length, i, edits + 1)
        return F.struct(length.alias("length"), i.alias("i"), F.substring(F.col(text), start + 1, size).alias("piece"))

    return F.transform(F.sequence(F.lit(0), F.lit(edits)), entry)


def _pieces(text: str, edits: int) -> Column:
    """(length, i, piece): where an asked name may hold part ``i`` of a known one of ``length``."""
    own = F.length(text)
    lengths = F.sequence(F.greatest(F.lit(0), own - edits), own + edits)

    def of_length(length: Column) -> Column:
        def of_part(i: Column) -> Column:
            start, size = _part(length, i, edits + 1)
            starts = F.sequence(F.greatest(F.lit(0), start - edits), F.greatest(F.lit(0), start + edits))
            inside = F.filter(starts, lambda p: p + size <= own)
            return F.transform(inside, lambda p: F.struct(length.alias("length"), i.alias("i"), F.substring(F.col(text), p + 1, size).alias("piece")))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(edits)), of_part))

    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def names_within(asked: DataFrame, known: DataFrame, edits: int, scope: list[str]) -> DataFrame:
    """All (asked, known) names of equal ``scope`` at most ``edits`` insertions, deletions or replacements apart:
    scope + [name, pattern, distance]. ``asked``: scope + [name]; ``known``: scope + [pattern]. Nulls match nothing.

    Equal names are looked up once. A part that very many names share is a hot key of an inner join, which
    adaptive execution splits; what it brings together is checked with a bound, not stored."""
    names = asked.where(F.col("name").isNotNull()).select(*scope, "name").distinct()
    patterns = known.where(F.col("pattern").isNotNull()).select(*scope, "pattern").distinct()
    left = names.select(*scope, "name", F.explode(_pieces("name", edits)).alias("at")).select(*scope, "name", "at.*")
    right = patterns.select(*scope, "pattern", F.explode(_parts("pattern", edits)).alias("at")).select(*scope, "pattern", "at.*")
    met = left.join(right, [*scope, "length", "i", "piece"])
    distance = F.levenshtein("name", "pattern", edits)
    met = met.withColumn("distance", distance).where(F.col("distance").between(0, edits))
    return met.select(*scope, "name", "pattern", "distance").distinct()
