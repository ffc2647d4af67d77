"""Hybrid retrieval over facts and semantic retrieval over diary entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.joins import by_sorting, left_join_hot
from factloom.operators.nearest import nearest
from factloom.operators.ranking import top_k
from factloom.operators.substring import substring_matches
from factloom.session import materialize

# Fixed values of the ranking rules.
SCORE_TITLE_EQUAL, SCORE_TITLE_PART, SCORE_TEXT_PART = 2.0, 1.5, 1.0
BOOST_TITLE_EQUAL, BOOST_TITLE_PART = 0.5, 0.2
WEIGHT_ALIAS_EQUAL, WEIGHT_ALIAS_PART = 0.2, 0.05
LONG_QUERY = 3


def fetch_size(limit: int) -> int:
    """How many vector hits to fetch before boosts change their order."""
    return max(limit * 5, 50)


def exact_matches(
    facts: DataFrame, queries: DataFrame, limit: int | None = 5, title_ignores_category: bool = False
) -> DataFrame:
    """Facts whose title, or for queries over three characters text, contains the query.

    ``queries``: query_id, user_id, query, category (null = any). Returns query_id, id,
    score, rank. ``title_ignores_category`` lets title matches of long queries pass
    whatever their category.

    Equal questions are answered once: the match depends on tenant, lower-cased query,
    category and length class only.
    """
    asks = queries.select(
        "query_id",
        "user_id",
        F.lower("query").alias("pattern"),
        (F.length("query") > LONG_QUERY).alias("is_long"),
        F.col("category").alias("wanted"),
    )
    # Stored with their true size: Spark would take millions of them for small and send them through the driver.
    asks = materialize(asks, "asks", plain=True)
    distinct_asks = materialize(asks.drop("query_id").distinct(), "distinct-asks", plain=True)
    texts = facts.select(
        "user_id",
        "id",
        "category",
        F.lower("title").alias("low_title"),
        F.explode(F.create_map(F.lit("title"), F.lower("title"), F.lit("text"), F.lower("text"))).alias("field", "text"),
    )
    fields = F.explode(F.when(F.col("is_long"), F.array(F.lit("title"), F.lit("text"))).otherwise(F.array(F.lit("title"))))
    patterns = distinct_asks.select("user_id", fields.alias("field"), "pattern")
    found = substring_matches(texts, patterns, ["user_id", "field"], ["id"], carry=["category", "low_title"])

    by_title = F.coalesce(F.contains("low_title", "pattern"), F.lit(False))
    titled = F.col("low_title") != ""
    score = (
        F.when(titled & (F.col("low_title") == F.col("pattern")), SCORE_TITLE_EQUAL)
        .when(titled & by_title, SCORE_TITLE_PART)
        .otherwise(SCORE_TEXT_PART)
    )
    # A fact found by its title is not reported a second time for its text.
    found = found.where((F.col("field") == "title") | ~by_title).withColumn("score", score)

    if limit is not None:
        # A question gets its answers from the first ones of each category, so a pattern
        # that very many facts contain shrinks before it is shuffled.
        found = top_k(found, ["user_id", "pattern", "field", "category"], [F.desc("score"), F.asc("id")], limit)
        found = found.drop("rank")
    allowed = F.col("wanted").isNull() | (F.col("wanted") == F.col("category"))
    if title_ignores_category:
        allowed = allowed | (F.col("is_long") & (F.col("field") == "title"))
    answers = found.join(distinct_asks, ["user_id", "pattern"]).where(
        allowed & ((F.col("field") == "title") | F.col("is_long"))
    )
    ask_key = ["user_id", "pattern", "is_long", "wanted"]
    answers = answers.select(*ask_key, "id", "score")
    if limit is not None:
        answers = top_k(answers, ask_key, [F.desc("score"), F.asc("id")], limit)
    a, b = asks.alias("a"), answers.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ask_key[:-1]]
    joined = a.join(b, [*same, F.col("a.wanted").eqNullSafe(F.col("b.wanted"))])
    return joined.select("query_id", "id", "score", *(["rank"] if limit is not None else []))


def title_boost(query: Column, title: Column) -> Column:
    """``query`` and ``title`` in lower case."""
    return (
        F.when(F.coalesce(title, F.lit("")) == "", 0.0)
        .when(query == title, BOOST_TITLE_EQUAL)
        .when(F.contains(title, query) | F.contains(query, title), BOOST_TITLE_PART)
        .otherwise(0.0)
    )


def alias_boost(query: Column, aliases: Column) -> Column:
    """Sum over the aliases map (alias -> confidence); confidences that are no numbers add nothing."""

    def part(entry: Column) -> Column:
        alias = F.lower(entry["key"])
        confidence = F.coalesce(entry["value"].try_cast("double"), F.lit(0.0))
        touching = F.contains(alias, query) | F.contains(query, alias)
        return (
            F.when(query == alias, confidence * WEIGHT_ALIAS_EQUAL)
            .when(touching, confidence * WEIGHT_ALIAS_PART)
            .otherwise(0.0)
        )

    boosted = F.aggregate(F.map_entries(aliases), F.lit(0.0), lambda acc, entry: acc + part(entry))
    return F.coalesce(boosted, F.lit(0.0))


def boosted_hits(hits: DataFrame, facts: DataFrame, queries: DataFrame) -> DataFrame:
    """Vector hits (query_id, id, score) with title and alias boosts added to the score."""
    asked = queries.select("query_id", "user_id", F.lower("query").alias("low_query"))
    kinds = {field.name: field.dataType.typeName() for field in facts.schema.fields}
    # Only a map gives a boost: a plain list of aliases has no confidences.
    aliases = F.col("aliases") if kinds.get("aliases") == "map" else F.create_map().cast("map<string,string>")
    known = facts.select("user_id", "id", F.lower("title").alias("low_title"), aliases.alias("aliases"))
    query = F.col("low_query")
    score = F.col("score") + title_boost(query, F.col("low_title")) + alias_boost(query, F.col("aliases"))
    return (
        hits.join(asked, "query_id")
        .join(by_sorting(known), ["user_id", "id"])
        .select("query_id", "user_id", "id", score.alias("score"))
    )


def search_facts(
    facts: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    limit: int = 5,
    top_p: float = 0.4,
    title_ignores_category: bool = False,
) -> DataFrame:
    """Hybrid search for a table of queries.

    ``queries``: query_id, user_id, query, vec, category. ``facts``: user_id, id, title,
    text, category, aliases. ``vectors``: user_id, id, category, embedding.
    Returns query_id, id, title, text, category, score, rank.
    """
    queries = materialize(queries.select("query_id", "user_id", "query", "vec", "category"), "queries", plain=True)
    exact = exact_matches(facts, queries, limit, title_ignores_category)
    hits = nearest(vectors, queries, fetch_size(limit), top_p)
    boosted = boosted_hits(hits, facts, queries)
    merged = exact.select("query_id", "id", F.col("score").alias("_exact")).join(
        boosted.select("query_id", "id", F.col("score").alias("_vector")), ["query_id", "id"], "full"
    )
    merged = merged.withColumn("score", F.greatest("_exact", "_vector")).drop("_exact", "_vector")
    ranked = top_k(merged, ["query_id"], [F.desc(F.round("score", 9)), F.asc("id")], limit)
    return (
        ranked.join(queries.select("query_id", "user_id"), "query_id")
        .join(by_sorting(facts.select("user_id", "id", "title", "text", "category")), ["user_id", "id"])
        .select("query_id", "id", "title", "text", "category", "score", "rank")
    )


def search_diary(
    diary: DataFrame,
    diary_vectors: DataFrame,
    mentions: DataFrame,
    queries: DataFrame,
    limit: int = 3,
    top_p: float = 0.4,
    by_entry: bool = False,
) -> DataFrame:
    """Nearest diary entries per query, one row per mention (mention_id null without any).

    A hit shows the mentions of every entry of the same tenant and date, as often as they
    occur; ``by_entry`` restricts them to the entry itself.
    """
    any_category = F.lit(None).cast("string")
    hits = nearest(
        diary_vectors.withColumn("category", any_category), queries.withColumn("category", any_category), limit, top_p
    )
    entries = diary.select("user_id", "id", "date", "content")
    found = hits.join(queries.select("query_id", "user_id"), "query_id").join(entries, ["user_id", "id"])
    found = materialize(found, "diary-hits")
    linked = mentions.select("user_id", F.col("diary_id").alias("id"), F.col("fact_id").alias("mention_id"))
    if by_entry:
        found = left_join_hot(found, linked, ["user_id", "id"])
    else:
        dated = linked.join(diary.select("user_id", "id", "date"), ["user_id", "id"]).drop("id")
        found = left_join_hot(found, dated, ["user_id", "date"])
    return found.select("query_id", "id", "date", "content", "score", "rank", "mention_id")
