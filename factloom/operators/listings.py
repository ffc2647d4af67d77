"""Listings. Nested lists of the caller's view are rows here: one per link or mention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.graph import IN_CATEGORY, KNOWS
from factloom.operators.joins import left_join_hot

# Fixed value: keys of a property bag that are columns of their own.
CORE_KEYS = ("id", "text", "title", "category", "timestamp", "userId")


def split_metadata(properties: F.Column) -> F.Column:
    """The entries of a property map that are not core columns."""
    return F.map_filter(properties, lambda key, _: ~key.isin(*CORE_KEYS))


def list_facts(facts: DataFrame, edges: DataFrame, ordered: bool = False) -> DataFrame:
    """Facts that have a category, with their outgoing links to facts of the same tenant.

    A fact without links has one row with null link columns. ``ordered`` sorts by tenant,
    category and descending time; leave it off when the result is only stored or joined.
    """
    target = facts.select(
        "user_id",
        F.col("id").alias("target_id"),
        F.col("text").alias("target_text"),
        F.col("title").alias("target_title"),
    )
    links = (
        edges.where(~F.col("rel").isin(IN_CATEGORY, KNOWS))
        .select("user_id", F.col("src").alias("id"), "rel", F.col("dst").alias("target_id"))
        .join(target, ["user_id", "target_id"])
    )
    listed = left_join_hot(facts.where(F.col("category").isNotNull()), links, ["user_id", "id"])
    if ordered:
        listed = listed.orderBy("user_id", "category", F.desc("ts"), "id", "rel", "target_id")
    return listed


def list_categories(facts: DataFrame, ordered: bool = False) -> DataFrame:
    found = facts.where(F.col("category").isNotNull()).select("user_id", "category").distinct()
    return found.orderBy("user_id", "category") if ordered else found


def list_diary(diary: DataFrame, mentions: DataFrame, facts: DataFrame, ordered: bool = False) -> DataFrame:
    """Diary entries with the facts they mention; null fact columns without any."""
    named = facts.select(
        "user_id", F.col("id").alias("fact_id"), F.col("text").alias("fact_text"), F.col("title").alias("fact_title")
    )
    linked = mentions.withColumnRenamed("diary_id", "id").join(named, ["user_id", "fact_id"])
    listed = left_join_hot(diary, linked, ["user_id", "id"])
    if ordered:
        listed = listed.orderBy("user_id", F.desc("date"), F.desc("ts"), "id", "fact_id")
    return listed
