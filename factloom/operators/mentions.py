"""Linking of diary entries to the facts they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.substring import substring_matches

# Fixed value: the categories whose facts are names.
NAME_CATEGORIES = ("People", "Client")


def known_names(
    facts: DataFrame, categories: tuple[str, ...] | None = NAME_CATEGORIES, name_col: str = "text"
) -> DataFrame:
    """Lower-cased names and aliases: user_id, fact_id, pattern."""
    if categories is not None:
        facts = facts.where(F.col("category").isin(*categories))
    names = F.array(F.col(name_col))
    if "aliases" in facts.columns:
        aliases = facts.schema["aliases"].dataType.typeName()
        listed = F.map_keys("aliases") if aliases == "map" else F.col("aliases")
        names = F.concat(names, F.coalesce(listed, F.array().cast("array<string>")))
    exploded = facts.select("user_id", F.col("id").alias("fact_id"), F.explode(names).alias("pattern"))
    return exploded.where(F.col("pattern").isNotNull()).withColumn("pattern", F.lower("pattern"))


def link_mentions(
    diary: DataFrame,
    facts: DataFrame,
    categories: tuple[str, ...] | None = NAME_CATEGORIES,
    name_col: str = "text",
) -> DataFrame:
    """Facts named in diary entries of the same tenant: user_id, diary_id, fact_id.

    ``diary``: user_id, id, content. ``facts``: user_id, id, category, the name column
    and optionally ``aliases`` (map or list).
    """
    names = known_names(facts, categories, name_col)
    texts = diary.select("user_id", F.col("id").alias("diary_id"), F.lower("content").alias("text"))
    found = substring_matches(texts, names.select("user_id", "pattern"), ["user_id"], ["diary_id"])
    return found.join(names, ["user_id", "pattern"]).select("user_id", "diary_id", "fact_id").distinct()
