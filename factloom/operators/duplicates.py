"""Duplicate detection: similar facts, their clusters, and which record to keep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import title_key
from factloom.functions.vectors import norm
from factloom.operators.components import connected_components
from factloom.operators.ranking import GROUP_BOUND, running_number
from factloom.operators.similarity import (
    cross_title_evidence,
    SAME_TITLE,
    evidence_against,
    recency_pool,
    similarity_items,
    title_words,
)
from factloom.session import materialize

# Fixed values of the cluster report.
HIGH_OVERLAP = 0.9
LABEL_HIGH = "MERGE - high overlap"
LABEL_VERIFY = "MERGE - verify and combine"

# Fixed value: fields that a comparison of records shows by name.
SHOWN_FIELDS = ("id", "title", "text", "date", "updatedAt", "similarity")

_GROUP = ["user_id", "category"]


@dataclass(frozen=True)
class Duplicates:
    """``partners``: one row per fact with a similar fact. ``clusters`` and ``members``."""

    partners: DataFrame
    clusters: DataFrame
    members: DataFrame

    def ordered_clusters(self) -> DataFrame:
        """Clusters for display: per tenant and category the most similar first."""
        return self.clusters.orderBy(*_GROUP, F.desc("avg_similarity"), "cluster_id")


def pool_size(limit: int) -> int:
    return max(limit * 5, 500)


def find_duplicates(
    facts: DataFrame,
    vectors: DataFrame,
    threshold: float = 0.85,
    category: str | None = None,
    limit: int | None = None,
    tile_rows: int = 8192,
    group_bound: int = GROUP_BOUND,
) -> Duplicates:
    """Clusters of similar facts for all tenants and categories (or one category).

    ``limit`` restricts the search to the pool of the most recent facts per tenant and
    category, ``max(limit * 5, 500)``; without it every fact takes part.
    """
    if category is not None:
        facts = facts.where(F.col("category") == category)
    facts = facts.where(F.col("category").isNotNull())
    if limit is not None:
        facts = recency_pool(facts, pool_size(limit))
    # Used by several steps; stored once so that they read only the columns they need.
    items = materialize(similarity_items(facts, vectors, threshold), "items")
    evidence = materialize(cross_title_evidence(items, threshold, tile_rows), "evidence")

    # Copies of a title: copies - 1 partners of score 1 each.
    same = F.when(F.lit(threshold <= SAME_TITLE) & (F.col("copies") > 1), F.col("copies") - 1).otherwise(0)
    cross = evidence.groupBy(*_GROUP, "id").agg(
        F.sum("partners").alias("_partners"), F.sum("total").alias("_total"), F.max("best").alias("_best")
    )
    scored = (
        items.drop("words", "embedding")
        .join(cross, [*_GROUP, "id"], "left")
        .withColumn("partners", same + F.coalesce("_partners", F.lit(0)))
        .withColumn("total", same + F.coalesce("_total", F.lit(0.0)))
        .withColumn("best", F.greatest(F.when(same > 0, F.lit(SAME_TITLE)), "_best"))
        .where(F.col("partners") > 0)
        .select(*_GROUP, "id", "ts", "link", "partners", "total", "best")
    )
    members = materialize(_label(scored, evidence), "members")
    clusters = _clusters(members, group_bound)
    named = members.join(clusters.select(*_GROUP, "component", "cluster_id"), [*_GROUP, "component"])
    return Duplicates(
        partners=members.select(
            *_GROUP,
            "id",
            "partners",
            F.round(F.col("total") / F.col("partners"), 4).alias("mean_similarity"),
            F.round("best", 4).alias("best_similarity"),
        ),
        clusters=clusters.drop("component"),
        members=named.select(
            *_GROUP, "cluster_id", "id", F.round(F.col("total") / F.col("partners"), 4).alias("similarity")
        ),
    )


def _label(scored: DataFrame, evidence: DataFrame) -> DataFrame:
    """Attach the component of every fact. Only groups of several tiles need rounds."""
    final = evidence.where(~F.col("tiled"))
    labels = final.select(*_GROUP, "link", F.col("root").alias("component")).distinct()
    split = evidence.where(F.col("tiled") & (F.col("link") != F.col("root")))
    if split.take(1):
        edges = split.select(*_GROUP, F.col("link").alias("a"), F.col("root").alias("b")).distinct()
        labels = labels.unionByName(connected_components(edges, _GROUP).withColumnRenamed("node", "link"))
    return scored.join(labels, [*_GROUP, "link"], "left").withColumn("component", F.coalesce("component", "link"))


def _clusters(members: DataFrame, group_bound: int) -> DataFrame:
    epoch = "timestamp_ntz'1970-01-01'" if dict(members.dtypes)["ts"] == "timestamp_ntz" else "timestamp'1970-01-01Z'"
    age = F.struct(F.expr(f"-timestampdiff(MICROSECOND, {epoch}, ts)").alias("age"), F.col("id"))
    average = F.sum("total") / F.sum("partners")
    clusters = members.groupBy(*_GROUP, "component").agg(
        F.count("*").alias("size"), average.alias("average"), F.min(age).alias("first")
    )
    # A cluster is numbered by its most recent member.
    clusters = running_number(clusters, _GROUP, [F.asc("first.age"), F.asc("first.id")], "cluster_id", group_bound)
    return clusters.select(
        *_GROUP,
        "component",
        "cluster_id",
        "size",
        F.round("average", 4).alias("avg_similarity"),
        F.when(F.col("average") > HIGH_OVERLAP, LABEL_HIGH).otherwise(LABEL_VERIFY).alias("recommendation"),
    )


def check_new_facts(
    new: DataFrame, facts: DataFrame, vectors: DataFrame, threshold: float = 0.85, tile_rows: int = 8192
) -> DataFrame:
    """Which new facts resemble known ones, by the scoring of ``find_duplicates``.

    ``new``: user_id, id, category, title, embedding. Returns user_id, category, id,
    partners, best_similarity for new facts with at least one partner.
    """
    fields = ["user_id", "category", "id", "title", "embedding"]
    known = facts.select("user_id", "category", "id", "title").join(
        vectors.select("user_id", "id", "embedding"), ["user_id", "id"]
    )

    def items(df: DataFrame) -> DataFrame:
        usable = df.select(*fields).where(F.col("embedding").isNotNull()).where(norm("embedding") > 0)
        key = title_key("title")
        usable = usable.withColumn("node", F.coalesce(key, F.lit(""))).withColumn("titled", key.isNotNull())
        return usable.withColumn("words", title_words(key))

    found = evidence_against(items(new), items(known), threshold, tile_rows=tile_rows)
    found = found.groupBy(*_GROUP, "id").agg(F.sum("partners").alias("partners"), F.max("best").alias("best"))
    return found.select(*_GROUP, "id", "partners", F.round("best", 4).alias("best_similarity"))


def completeness(records: DataFrame, fields: list[str]) -> DataFrame:
    """Add ``non_empty`` and ``text_len`` to records.

    A field counts unless it is null, the empty string or an empty list; 0 and false count.
    Map columns count by their entries.
    """
    total = F.lit(0)
    for name in fields:
        kind = records.schema[name].dataType.typeName()
        value = F.col(name)
        if kind == "map":
            filled = F.map_values(F.map_filter(value, lambda _, v: v.isNotNull() & ~v.isin("", "[]")))
            total = total + F.coalesce(F.size(filled), F.lit(0))
            continue
        if kind == "array":
            present = value.isNotNull() & (F.size(value) > 0)
        elif kind == "string":
            present = value.isNotNull() & ~value.isin("", "[]")
        else:
            present = value.isNotNull()
        total = total + F.coalesce(present, F.lit(False)).cast("int")
    length = F.length(F.coalesce("text", F.lit("")))
    return records.withColumn("non_empty", total).withColumn("text_len", length)


def suggest_merge(
    records: DataFrame, cluster: list[str], fields: list[str], group_bound: int = GROUP_BOUND
) -> DataFrame:
    """Rank the records of each cluster by completeness; rank 1 is the suggested master. ``record_count`` is the size
    of the cluster."""
    ranked = materialize(completeness(records, fields), "completeness")
    counts = ranked.groupBy(*cluster).agg(F.count("*").alias("record_count"))
    order = [F.desc("non_empty"), F.desc("text_len"), F.asc("id")]
    ranked = running_number(ranked, cluster, order, "rank", group_bound)
    return ranked.withColumn("is_master", F.col("rank") == 1).join(materialize(counts, "record-counts"), cluster)


def extra_fields(record: str) -> F.Column:
    """Entries of a record (map of its fields) that a comparison does not show in columns of their own."""
    return F.map_filter(record, lambda key, _: ~key.isin(*SHOWN_FIELDS))


