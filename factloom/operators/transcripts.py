"""Preparation of transcripts and resolution of what they name.

Texts are never split over rows and put together again: each stays one row, and only
the few names or corrections that apply to it are brought to that row.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import SPACE, first_filled, strip, title_key
from factloom.operators.fuzzy import names_within
from factloom.operators.substring import substring_matches

# Filler words to remove.
FILLERS = ("um", "uh", "like", "you know", "sort of")


def transcript_stats(turns: DataFrame, text: str = "text") -> DataFrame:
    """Add word_count and char_count."""
    tokens = F.size(F.filter(F.split(text, rf"(?U){SPACE}+"), lambda t: t != ""))
    return turns.withColumn("word_count", tokens.cast("long")).withColumn("char_count", F.length(text).cast("long"))


def remove_fillers(text: Column | str) -> Column:
    """Text without whole-word fillers, in any case; the spaces around them stay."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(text, rf"(?iU)\b({'|'.join(FILLERS)})\b", "")


def relabel_speakers(turns: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace generic speaker labels by names.

    ``mapping``: conv_id, speaker, name, one row per label. Unmapped labels stay.
    """
    return (
        turns.join(mapping, ["conv_id", "speaker"], "left")
        .withColumn("speaker", F.coalesce("name", "speaker"))
        .drop("name")
    )


def speaker_lines(turns: DataFrame) -> DataFrame:
    """One ``[Speaker]: text`` line per turn: conv_id, turn, line.

    Lines are rows, in order by conv_id and turn; a conversation of any length is written
    by sorting, never by gathering it in one value.
    """
    line = F.concat(F.lit("["), F.col("speaker"), F.lit("]: "), F.col("text"))
    return turns.select("conv_id", "turn", line.alias("line"))


# A word, so that punctuation around a misspelling does not hide it.
_WORD = r"[\p{L}\p{N}_]+"


def apply_corrections(texts: DataFrame, corrections: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Replace misspelled words.

    ``corrections``: wrong, right; a word, compared exactly, one row per ``wrong``.
    ``texts`` is unique per ``key``. Distinct words look up their correction; what applies
    to a text returns to it as a small map.
    """
    tokens = texts.select(*key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_WORD})")))).alias("wrong"))
    found = (
        tokens.join(corrections.select("wrong", "right"), "wrong")
        .groupBy(*key)
        .agg(F.map_from_entries(F.collect_list(F.struct("wrong", "right"))).alias("_fix"))
    )
    touched = texts.join(found, key).withColumn(text, _replace_words(text, "_fix")).drop("_fix")
    return touched.unionByName(texts.join(found.select(*key), key, "left_anti"))


@F.pandas_udf(T.StringType())
def _replace_words(texts: pd.Series, fixes: pd.Series) -> pd.Series:
    """One pass over each text; a map lookup in the JVM would walk the map for every word."""
    word = re.compile(r"\w+")
    return pd.Series([word.sub(lambda m, fix=dict(fix): fix.get(m[0], m[0]), text) for text, fix in zip(texts, fixes)])


def link_names(texts: DataFrame, names: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Wrap known names as ``[[Name]]``: key + the text column. Longer names win.

    ``texts``: user_id, key, text; ``names``: user_id, name. Case matters. A name counts only where
    no letter, digit or underscore touches it, and what stands in ``[[…]]`` already stays as it is.
    """
    scope = ["user_id"]
    source = texts.select(*scope, *key, F.col(text).alias("text"))
    patterns = names.where(F.col("name") != "").select(*scope, F.col("name").alias("pattern"))
    found = substring_matches(source, patterns, scope, key)
    # Alternatives are tried in order, so sort by length, longest first.
    sized = F.struct((-F.length("pattern")).alias("n"), F.col("pattern").alias("p"))
    quoted = F.transform(F.array_sort(F.collect_set(sized)), lambda s: F.regexp_replace(s["p"], r"([^\p{L}\p{N}_ ])", r"\\$1"))
    wanted = found.groupBy(*scope, *key).agg(F.array_join(quoted, "|").alias("_names"))
    # Links are matched too, so that the search goes on behind them; they are put back unchanged.
    link_or_name = F.concat(
        F.lit(r"\[\[([^\[\]]*)\]\]|(?<![\p{L}\p{N}_])("), F.col("_names"), F.lit(r")(?![\p{L}\p{N}_])")
    )
    linked = F.when(F.col("_names").isNull(), F.col(text)).otherwise(
        F.regexp_replace(F.col(text), link_or_name, F.lit("[[$1$2]]"))
    )
    return texts.join(wanted, [*scope, *key], "left").withColumn(text, linked).drop("_names")


def recording_time(name: Column | str) -> Column:
    """Time in a file name (YYYY-MM-DD HH-MM-SS), null without one."""
    found = F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2} \d{2}-\d{2}-\d{2})", 1)
    return F.try_to_timestamp(F.nullif(found, F.lit("")), F.lit("yyyy-MM-dd HH-mm-ss"))


def read_transcripts(spark, path: str) -> DataFrame:
    """Transcript files, one row per file: file_name, recorded_at, text."""
    # File names arrive percent-encoded; a plus sign is not, and must stay one.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    files = spark.read.text(path, wholetext=True).withColumn("file_name", name)
    return files.select("file_name", recording_time("file_name").alias("recorded_at"), F.col("value").alias("text"))


_ALIAS = r"([^,()]+?)\s*\((\d+(?:\.\d+)?)%\)"


def parse_aliases(text: Column | str) -> Column:
    """``Name (90%), …`` as a map name -> confidence between 0 and 1."""
    text = F.col(text) if isinstance(text, str) else text
    names = F.transform(F.regexp_extract_all(text, F.lit(_ALIAS), F.lit(1)), strip)
    shares = F.transform(F.regexp_extract_all(text, F.lit(_ALIAS), F.lit(2)), lambda s: s.cast("double") / 100)
    pairs = F.arrays_zip(names.alias("name"), shares.alias("share"))
    # A name given twice keeps its first confidence; maps refuse repeated keys.
    firsts = F.filter(pairs, lambda e, i: F.array_position(names, e["name"]) == i + 1)
    return F.map_from_entries(firsts)


def resolve_people(
    names: DataFrame, facts: DataFrame, category: str | None = "People", aliases: bool = False, max_edits: int = 0
) -> DataFrame:
    """How many facts each extracted name may mean: none, single or multiple.

    ``names``: user_id, name. A fact is a candidate if its title contains the name, or,
    for names over three characters, its text does; with ``aliases`` also if one of its aliases contains it (short
    forms), and with ``max_edits`` if its title, or an alias, is that few edits away (misspellings).
    Returns user_id, name, candidates, resolution and, for a single candidate, match_id.
    """
    if category is not None:
        facts = facts.where(F.col("category") == category)
    asked = names.select("user_id", "name").distinct().withColumn("pattern", F.lower("name"))
    found = _named_facts(asked, facts, aliases)
    if max_edits:
        found = found.unionByName(_misspelt_facts(asked, facts, aliases, max_edits)).distinct()
    counted = found.groupBy("user_id", "pattern").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    candidates = F.coalesce("n", F.lit(0)).cast("long")
    return (
        asked.join(counted, ["user_id", "pattern"], "left")
        .withColumn("candidates", candidates)
        .withColumn(
            "resolution",
            F.when(F.col("candidates") == 0, "none").when(F.col("candidates") == 1, "single").otherwise("multiple"),
        )
        .withColumn("match_id", F.when(F.col("candidates") == 1, F.col("first_id")))
        .select("user_id", "name", "candidates", "resolution", "match_id")
    )


def _alias_names(facts: DataFrame) -> DataFrame:
    """user_id, id, alias in lower case; aliases are a map or a list."""
    listed = F.map_keys("aliases") if facts.schema["aliases"].dataType.typeName() == "map" else F.col("aliases")
    return facts.select("user_id", "id", F.explode(listed).alias("alias")).withColumn("alias", F.lower("alias"))


def _named_facts(asked: DataFrame, facts: DataFrame, aliases: bool) -> DataFrame:
    """Facts that contain a name: user_id, pattern, id, each once."""
    texts = facts.select(
        "user_id", "id", F.explode(F.create_map(F.lit("title"), F.lower("title"), F.lit("text"), F.lower("text"))).alias("field", "text")
    )
    fields = ["title", "alias"] if aliases else ["title"]
    if aliases:
        # One text for all aliases of a fact, between breaks that no name holds.
        joined = _alias_names(facts).groupBy("user_id", "id").agg(F.array_join(F.array_sort(F.collect_set("alias")), "\n").alias("text"))
        texts = texts.unionByName(joined.withColumn("field", F.lit("alias")))
    listed = F.array(*[F.lit(f) for f in fields])
    wanted = F.when(F.length("pattern") > 3, F.array_append(listed, F.lit("text"))).otherwise(listed)
    patterns = asked.select("user_id", F.explode(wanted).alias("field"), "pattern")
    found = substring_matches(texts, patterns, ["user_id", "field"], ["id"])
    return found.select("user_id", "pattern", "id").distinct()


def _misspelt_facts(asked: DataFrame, facts: DataFrame, aliases: bool, max_edits: int) -> DataFrame:
    known = facts.select("user_id", "id", F.lower("title").alias("known"))
    if aliases:
        known = known.unionByName(_alias_names(facts).withColumnRenamed("alias", "known"))
    near = names_within(asked.select("user_id", F.col("pattern").alias("name")), known.select("user_id", F.col("known").alias("pattern")), max_edits, ["user_id"])
    near = near.select("user_id", F.col("name").alias("pattern"), F.col("pattern").alias("known"))
    return near.join(known, ["user_id", "known"]).select("user_id", "pattern", "id").distinct()


def reprocessing_guard(incoming: DataFrame, facts: DataFrame) -> DataFrame:
    """Whether incoming facts update a known one or are new: adds op and existing_id.

    Known means an equal title (blanks at the ends and case aside) of the same tenant;
    of several the smallest id. Facts are reduced to one row per title before the join.
    """
    known = facts.select("user_id", "id", title_key("title").alias("_key")).where(F.col("_key").isNotNull())
    known = known.groupBy("user_id", "_key").agg(F.min("id").alias("existing_id"))
    marked = incoming.withColumn("_key", title_key("title")).join(known, ["user_id", "_key"], "left").drop("_key")
    return marked.withColumn("op", F.when(F.col("existing_id").isNotNull(), "update").otherwise("insert"))


_ADDRESS = r"(?U)(?:^|[.!?]\s+)(\p{Lu}[\p{L}'-]*(?: \p{Lu}[\p{L}'-]*)?),"


def direct_addresses(turns: DataFrame, participants: DataFrame) -> DataFrame:
    """Participants addressed by name at the start of a sentence ("John, what …").

    ``participants``: conv_id, name. Returns conv_id, turn, name, each once.
    """
    named = turns.select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(_ADDRESS), F.lit(1))).alias("name"))
    return named.distinct().join(participants.select("conv_id", "name").distinct(), ["conv_id", "name"])


def shown_date(date: Column | str, updated: Column | str) -> Column:
    """Date of a record for display: its date, else when it was updated, else empty."""
    return first_filled(date, updated)
