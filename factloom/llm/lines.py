"""Line dedup: drop lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` does the same, and faster, where all characters are ASCII."""
    plain = F.char_length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_BLANKS)))


def _without(text: Column, positions: Column) -> Column:
    """``text`` without its lines at ``positions``: linear, as array_except uses a hash set."""

    def rebuilt(lines: Column) -> Column:
        staying = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), positions)
        return F.array_join(F.transform(staying, lambda i: lines[i]), "\n")

    # The lines are bound to a lambda variable, so that the text is split once.
    return F.transform(F.array(F.split(text, "\n")), rebuilt)[0]


def drop_common_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = 40) -> DataFrame:
    """Remove lines whose key occurs in at least ``min_docs`` documents, except in the largest doc_id.

    ``docs`` has doc_id and text; further columns are kept as they are (columns n_lines and n_dropped
    are replaced). Returns ``docs`` with the new text, n_lines (before dropping) and n_dropped.

    A key is the line without blanks at both ends and with A-Z lower-cased; keys under ``min_chars``
    code points never count. Documents are counted by distinct doc_id, so rows that repeat a doc_id
    are one document, and several lines of one document count once. A null or empty text is one empty
    line. A null doc_id takes part in no count and loses nothing. An empty table gives an empty one.

    Lines are exploded once into hashes (128 bits) with their positions. Counting a hash aggregates
    by (hash, document) before it aggregates by hash, so a line that stands in a third of all documents
    is spread over tasks. Texts are shuffled once, to meet the positions to drop; the lines that stay
    are put together by position.
    """
    lines = docs.where("doc_id is not null and text is not null").select(
        "doc_id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("pos", "line")
    )
    keyed = lines.where(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    keyed = keyed.where(F.char_length("key") >= min_chars)
    hashes = [F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")]
    placed = keyed.select("doc_id", "version", "pos", *hashes)
    # One row per line and document; rows that share a doc_id are told apart by their text.
    placed = materialize(
        placed.groupBy("h1", "h2", "doc_id", "version").agg(F.collect_set("pos").alias("positions")), "lines"
    )
    common = placed.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    # Stored, so that the join sees its size: it is broadcast if small, else a hot hash can be split.
    common = materialize(common.where(F.col("n") >= min_docs).select("h1", "h2", "keeper"), "common")
    dropped = placed.join(common, ["h1", "h2"]).where(F.col("doc_id") != F.col("keeper"))
    dropped = dropped.groupBy(F.col("doc_id").alias("__doc"), F.col("version").alias("__version")).agg(
        F.flatten(F.collect_list("positions")).alias("__drop")
    )

    same = (docs["doc_id"] == F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__version"))
    joined = docs.join(dropped, same, "left")
    gone = F.col("__drop").isNotNull()
    joined = joined.withColumn("n_lines", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long"))
    joined = joined.withColumn("n_dropped", F.when(gone, F.size("__drop")).otherwise(0).cast("long"))
    text = F.when(gone, _without(F.col("text"), F.col("__drop"))).otherwise(F.col("text"))
    return joined.withColumn("text", text).drop("__doc", "__version", "__drop")
