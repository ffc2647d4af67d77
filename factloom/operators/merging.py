"""Merging of duplicate facts into a master."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.components import tree_roots
from factloom.operators.listings import split_metadata
from factloom.session import materialize
from factloom.sources.tables import Snapshot


def valid_merges(merges: DataFrame, facts: DataFrame) -> DataFrame:
    """Merges (user_id, master_id, dup_id) whose master and duplicate exist, with the final master of each.

    A batch may chain merges: with 2 into 1 and 3 into 2, both end in 1. A duplicate with two masters, or
    merges in a circle, raise an error.
    """
    ids = facts.select("user_id", "id")
    pairs = merges.select("user_id", "master_id", "dup_id").where("master_id <> dup_id").distinct()
    pairs = pairs.join(ids.withColumnRenamed("id", "master_id"), ["user_id", "master_id"], "left_semi")
    pairs = materialize(pairs.join(ids.withColumnRenamed("id", "dup_id"), ["user_id", "dup_id"], "left_semi"), "pairs")
    twice = pairs.groupBy("user_id", "dup_id").count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"fact {twice[0]['dup_id']} of user {twice[0]['user_id']} has more than one master")
    gone = pairs.select("user_id", F.col("dup_id").alias("master_id"))
    if not pairs.join(gone, ["user_id", "master_id"], "left_semi").take(1):
        return pairs
    links = pairs.select("user_id", F.col("dup_id").alias("node"), F.col("master_id").alias("parent"))
    ends = tree_roots(links, ["user_id"])
    return materialize(ends.select("user_id", F.col("node").alias("dup_id"), F.col("root").alias("master_id")), "ends")



def _moved(table: DataFrame, pairs: DataFrame, end: str) -> DataFrame:
    """Add ``new_<end>``: the master where the end is a duplicate, else null."""
    target = pairs.select("user_id", F.col("dup_id").alias(end), F.col("master_id").alias(f"new_{end}"))
    return table.join(target, ["user_id", end], "left")


def merge_edges(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges with duplicates replaced by their masters.

    Edges inside a merge vanish. Where the master has an edge of the same type to the
    same fact already, the moved one is dropped; among moved ones the first by old ends
    stays. Only edges that touch a merge are grouped.
    """
    ends = ["user_id", "src", "rel", "dst"]
    moved = _moved(_moved(edges, pairs, "src"), pairs, "dst")
    masters = pairs.select("user_id", F.col("master_id").alias("m")).distinct()
    for end in ("src", "dst"):
        flag = masters.select("user_id", F.col("m").alias(end), F.lit(True).alias(f"{end}_master"))
        moved = moved.join(flag, ["user_id", end], "left")
    is_moved = F.col("new_src").isNotNull() | F.col("new_dst").isNotNull()
    touched = is_moved | F.col("src_master").isNotNull() | F.col("dst_master").isNotNull()
    untouched = moved.where(~touched).select(*ends, "props")
    rewritten = moved.where(touched).select(
        "user_id",
        F.coalesce("new_src", "src").alias("to_src"),
        "rel",
        F.coalesce("new_dst", "dst").alias("to_dst"),
        is_moved.alias("moved"),
        "src",
        "dst",
        "props",
    )
    rewritten = rewritten.where(~(F.col("moved") & (F.col("to_src") == F.col("to_dst"))))
    # The props map cannot be compared, so the choice is by key and the map rides along.
    chosen = rewritten.groupBy("user_id", "to_src", "rel", "to_dst").agg(
        F.min_by("props", F.struct("moved", "src", "dst")).alias("props")
    )
    chosen = chosen.select("user_id", F.col("to_src").alias("src"), "rel", F.col("to_dst").alias("dst"), "props")
    return untouched.unionByName(chosen)


def merge_mentions(mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    moved = _moved(mentions, pairs, "fact_id")
    return moved.select("user_id", "diary_id", F.coalesce("new_fact_id", "fact_id").alias("fact_id")).distinct()


def merge_properties(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distinct values of every property over a master and its duplicates, one per row.

    Core columns are the master's own and are not listed. Returns user_id, id (the
    master), key, value; a key with several rows holds several values.
    """
    group = pairs.select("user_id", F.col("dup_id").alias("id"), "master_id")
    group = group.unionByName(
        pairs.select("user_id", F.col("master_id").alias("id"), F.col("master_id")).distinct()
    )
    entries = facts.select("user_id", "id", F.explode(split_metadata(F.col("metadata"))).alias("key", "value"))
    combined = entries.join(group, ["user_id", "id"]).where(F.col("value").isNotNull())
    return combined.select("user_id", F.col("master_id").alias("id"), "key", "value").distinct()


def alias_rank(value: str) -> Column:
    """Ranks the confidences of an alias: the highest first, then the smaller text; no number comes last."""
    confidence = F.coalesce(F.col(value).try_cast("double"), F.lit(float("-inf")))
    return F.struct(-confidence, value)


def _combined(facts: DataFrame, pairs: DataFrame, best: dict[str, Column]) -> DataFrame:
    """Per master (user_id, id) one map for each column of ``best`` out of its own and its duplicates' maps.

    ``best`` ranks the values of a key, smallest first, by ``own`` (0 for the master) and ``value``. All maps go in one pass."""
    group = pairs.select("user_id", F.col("dup_id").alias("id"), "master_id", F.lit(1).alias("own"))
    masters = pairs.select("user_id", F.col("master_id").alias("id"), "master_id", F.lit(0).alias("own")).distinct()
    grouped = facts.select("user_id", "id", *best).join(group.unionByName(masters), ["user_id", "id"])
    maps = F.create_map(*[part for column in best for part in (F.lit(column), F.col(column))])
    entries = grouped.select("user_id", "master_id", "own", F.explode(maps).alias("column", "map"))
    entries = entries.select("user_id", "master_id", "own", "column", F.explode("map").alias("key", "value")).where("value is not null")
    rank = F.struct(*[F.when(F.col("column") == column, order) for column, order in best.items()])
    one = entries.groupBy("user_id", "master_id", "column", "key").agg(F.min_by("value", rank).alias("value"))

    def combined(column: str) -> Column:
        listed = F.collect_list(F.when(F.col("column") == column, F.struct("key", "value")))
        return F.when(F.size(listed) > 0, F.map_from_entries(listed)).alias(f"combined_{column}")

    return one.groupBy("user_id", F.col("master_id").alias("id")).agg(*[combined(column) for column in best])


def _with_combined(facts: DataFrame, pairs: DataFrame, best: dict[str, Column]) -> DataFrame:
    best = {column: order for column, order in best.items() if column in facts.columns}
    if not best:
        return facts
    joined = facts.join(_combined(facts, pairs, best), ["user_id", "id"], "left")
    new = {column: F.coalesce(f"combined_{column}", column) for column in best}
    return joined.withColumns(new).select(*facts.columns)


def merge_facts(snapshot: Snapshot, merges: DataFrame, ts=None, embed=None) -> tuple[Snapshot, DataFrame]:
    """Carry out merges: the new snapshot and the combined properties of the masters.

    ``merges``: user_id, master_id, dup_id and the new title and text of the master (null
    = keep), equal in all rows of a master. ``ts`` is the time of the merge. Rows with a
    missing master or duplicate have no effect.

    The master takes over what its duplicates know: of each metadata key its own value, else the
    smallest of theirs (the combined properties hold all values); of each alias the highest
    confidence. A master whose title or text changes loses its vector, or gets one from ``embed``.
    """
    pairs = valid_merges(merges, snapshot.facts)
    gone = pairs.select("user_id", F.col("dup_id").alias("id")).distinct()
    # In a chain only the merges into the final master name it; those further down named facts that are gone.
    last = merges.join(pairs, ["user_id", "master_id", "dup_id"], "left_semi").groupBy("user_id", F.col("master_id").alias("id"))
    given = F.struct("title", "text")
    rewritten = last.agg(F.max(F.when(F.col("title").isNotNull() | F.col("text").isNotNull(), given)).alias("given"))
    rewritten = rewritten.select("user_id", "id", F.col("given.title").alias("new_title"), F.col("given.text").alias("new_text"))
    facts = _with_combined(snapshot.facts, pairs, {"metadata": F.struct("own", "value"), "aliases": alias_rank("value")})
    facts = facts.join(gone, ["user_id", "id"], "left_anti").join(rewritten, ["user_id", "id"], "left")
    changed = F.col("new_title").isNotNull() | F.col("new_text").isNotNull()
    facts = facts.withColumn("title", F.coalesce("new_title", "title"))
    facts = facts.withColumn("text", F.coalesce("new_text", "text"))
    if ts is not None:
        facts = facts.withColumn("updated_at", F.when(changed, F.lit(ts)).otherwise(F.col("updated_at")))
    renewed = facts.where(changed).select("user_id", "id", "title", "text", "category")
    facts = facts.select(*snapshot.facts.columns)

    vectors = snapshot.vectors
    if vectors is not None:
        vectors = vectors.join(gone, ["user_id", "id"], "left_anti")
        vectors = vectors.join(renewed.select("user_id", "id"), ["user_id", "id"], "left_anti")
        if embed is not None:
            new = embed(renewed.drop("category")).join(renewed.select("user_id", "id", "category"), ["user_id", "id"])
            vectors = vectors.unionByName(new.select(*vectors.columns))
    merged = replace(
        snapshot,
        facts=facts,
        vectors=vectors,
        edges=merge_edges(snapshot.edges, pairs),
        mentions=None if snapshot.mentions is None else merge_mentions(snapshot.mentions, pairs),
    )
    return merged, merge_properties(snapshot.facts, pairs)
