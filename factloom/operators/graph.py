"""Operators on the graph of facts, categories, users and diary entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import first_filled
from factloom.operators.ranking import top_k
from factloom.session import materialize

IN_CATEGORY, KNOWS, WROTE_DIARY, MENTIONS = "IN_CATEGORY", "KNOWS", "WROTE_DIARY", "MENTIONS"


def find_patterns(facts: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """Categories linked most often, per tenant: user_id, cat1, cat2, weight, rank.

    An edge counts once in each direction. Counts are reduced after each join, so the
    second join sees one row per (category, target) instead of one per edge.
    """
    of_fact = facts.where(F.col("category").isNotNull()).select("user_id", "id", "category")
    out = edges.join(
        of_fact.select("user_id", F.col("id").alias("src"), F.col("category").alias("cat1")), ["user_id", "src"]
    )
    out = out.groupBy("user_id", "cat1", "dst").agg(F.count("*").alias("weight"))
    out = out.join(
        of_fact.select("user_id", F.col("id").alias("dst"), F.col("category").alias("cat2")), ["user_id", "dst"]
    ).where(F.col("cat1") != F.col("cat2"))
    out = out.groupBy("user_id", "cat1", "cat2").agg(F.sum("weight").alias("weight"))
    back = out.select("user_id", F.col("cat2").alias("cat1"), F.col("cat1").alias("cat2"), "weight")
    both = out.unionByName(back).groupBy("user_id", "cat1", "cat2").agg(F.sum("weight").alias("weight"))
    return top_k(both, ["user_id"], [F.desc("weight"), F.asc("cat1"), F.asc("cat2")], top)


def typed_graph(
    facts: DataFrame, edges: DataFrame, diary: DataFrame | None = None, mentions: DataFrame | None = None
) -> DataFrame:
    """All edges with node names that carry their kind: src, rel, dst.

    ``f:`` facts, ``u:`` users, ``c:`` categories (shared by all tenants), ``d:`` diary.
    """

    def node(kind: str, column: str) -> F.Column:
        return F.concat(F.lit(f"{kind}:"), F.col(column).cast("string"))

    def links(df: DataFrame, src: F.Column, rel: F.Column, dst: F.Column) -> DataFrame:
        return df.select(src.alias("src"), rel.alias("rel"), dst.alias("dst"))

    categorized = facts.where(F.col("category").isNotNull())
    graph = links(edges, node("f", "src"), F.col("rel"), node("f", "dst"))
    graph = graph.unionByName(links(facts, node("u", "user_id"), F.lit(KNOWS), node("f", "id")))
    graph = graph.unionByName(links(categorized, node("f", "id"), F.lit(IN_CATEGORY), node("c", "category")))
    if diary is not None:
        graph = graph.unionByName(links(diary, node("u", "user_id"), F.lit(WROTE_DIARY), node("d", "id")))
    if mentions is not None:
        graph = graph.unionByName(links(mentions, node("d", "diary_id"), F.lit(MENTIONS), node("f", "fact_id")))
    return graph


def _adjacency(edges: DataFrame, scope: list[str], rel_types: Sequence[str] | None) -> DataFrame:
    """Both directions of every edge: scope, node, next, edge. A loop appears once."""
    if rel_types:
        edges = edges.where(F.col("rel").isin(*[t.upper() for t in rel_types]))
    edge = F.col("edge_id") if "edge_id" in edges.columns else F.struct("src", "rel", "dst")
    forth = edges.select(*scope, F.col("src").alias("node"), F.col("dst").alias("next"), edge.alias("edge"))
    back = edges.where(F.col("src") != F.col("dst")).select(
        *scope, F.col("dst").alias("node"), F.col("src").alias("next"), edge.alias("edge")
    )
    return forth.unionByName(back)


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def neighborhood_paths(
    edges: DataFrame,
    seeds: DataFrame,
    depth: int = 1,
    rel_types: Sequence[str] | None = None,
    scope: Sequence[str] = ("user_id",),
) -> DataFrame:
    """Nodes around seeds with the number of ways to get there.

    ``edges``: scope + src, rel, dst (+ edge_id where parallel edges of one type exist);
    ``seeds``: scope + seed. Direction is ignored; a path uses no edge twice but may
    revisit nodes. Returns scope + seed, id, depth, paths.

    Up to three hops paths are counted, not listed (``_counted_paths``). Beyond that they are
    listed with their edges; the last hop is reduced while it is joined, so the longest ones
    are never kept. A hub next to many seeds reaches all of its neighbours from each of them; that many
    rows are the answer, and the join on the hub is split by adaptive execution.
    """
    if depth < 1:
        raise ValueError("depth must be at least 1")
    scope = list(scope)
    hops = _adjacency(edges, scope, rel_types)
    if depth <= 3:
        return _counted_paths(hops, seeds, depth, scope)
    walks = seeds.select(*scope, "seed", F.col("seed").alias("node")).distinct()
    result = []
    for length in range(1, depth + 1):
        walks = walks.join(hops, [*scope, "node"])
        if length > 1:
            walks = walks.where(~F.array_contains("trail", F.col("edge")))
        counted = walks.groupBy(*scope, "seed", F.col("next").alias("id")).agg(F.count("*").alias("paths"))
        result.append(counted.withColumn("depth", F.lit(length).cast("long")))
        if length < depth:
            trail = F.array("edge") if length == 1 else F.array_append("trail", F.col("edge"))
            walks = walks.select(*scope, "seed", F.col("next").alias("node"), trail.alias("trail"))
            if length > 1:
                walks = materialize(walks, "walks")
    return _union(result).select(*scope, "seed", "id", "depth", "paths")


def _counted_paths(hops: DataFrame, seeds: DataFrame, depth: int, scope: list[str]) -> DataFrame:
    """Paths of one to three hops from numbers of walks, without listing any.

    With n(u, v) edges between u and v, walks of any length multiply and add up, whatever the number of edges of a hub. Those
    that use an edge twice are taken off: with two hops they go out and back on an edge of the seed. With three the first and second
    are one edge (degree(seed) * n(seed, id)), the second and third (n(seed, id) * degree(id)), or the first and third: out, back
    over any parallel edge and out again (n(seed, id) squared), or out, over a loop and back to the seed. Walks on one edge only
    are taken off three times and belong to all three kinds, so they are added twice."""
    pairs = materialize(hops.groupBy(*scope, "node", "next").agg(F.count("*").alias("n")), "adjacency")
    degrees = pairs.groupBy(*scope, "node").agg(F.sum("n").alias("degree"))
    start = seeds.select(*scope, "seed").distinct()
    start = start.join(degrees.withColumnRenamed("node", "seed"), [*scope, "seed"])
    key = [*scope, "seed", "id"]

    def further(walks: DataFrame) -> DataFrame:
        onward = pairs.select(*scope, F.col("node").alias("id"), "next", F.col("n").alias("m"))
        longer = walks.join(onward, [*scope, "id"]).groupBy(*scope, "seed", F.col("next").alias("id"))
        return longer.agg(F.sum(F.col("n") * F.col("m")).alias("n"))

    def row(df: DataFrame, length: int, paths: Column) -> DataFrame:
        found = df.select(*key, F.lit(length).cast("long").alias("depth"), paths.cast("long").alias("paths"))
        return found.where(F.col("paths") > 0)

    at_seed = F.col("id") == F.col("seed")
    first = start.select(*scope, "seed").join(pairs.withColumnRenamed("node", "seed"), [*scope, "seed"])
    first = first.withColumnRenamed("next", "id")
    result = [row(first, 1, F.col("n"))]
    if depth >= 2:
        second = materialize(further(first), "walks")
        back = F.when(at_seed, F.col("degree")).otherwise(0)
        result.append(row(second.join(start, [*scope, "seed"]), 2, F.col("n") - back))
    if depth == 3:
        loops = pairs.where("node = next").select(*scope, F.col("node").alias("id"), F.col("n").alias("loops"))
        over_loops = first.where(~at_seed).join(loops, [*scope, "id"]).groupBy(*scope, "seed")
        over_loops = over_loops.agg(F.sum(F.col("n") * F.col("loops")).alias("over_loops"))
        direct = first.select(*key, F.col("n").alias("direct"))
        third = further(second).join(start, [*scope, "seed"]).join(direct, key, "left")
        third = third.join(degrees.select(*scope, F.col("node").alias("id"), F.col("degree").alias("id_degree")), [*scope, "id"])
        third = third.join(over_loops, [*scope, "seed"], "left")
        edges = F.coalesce("direct", F.lit(0))
        ends_meet = edges * edges + F.when(at_seed, F.coalesce("over_loops", F.lit(0))).otherwise(0)
        repeated = F.col("degree") * edges + edges * F.col("id_degree") + ends_meet - 2 * edges
        result.append(row(third, 3, F.col("n") - repeated))
    return _union(result).select(*scope, "seed", "id", "depth", "paths")


def neighborhood_distinct(
    edges: DataFrame,
    seeds: DataFrame,
    depth: int = 1,
    rel_types: Sequence[str] | None = None,
    scope: Sequence[str] = ("user_id",),
) -> DataFrame:
    """Nodes within ``depth`` hops, each once, without the seed: scope + seed, id, min_depth."""
    if depth < 1:
        raise ValueError("depth must be at least 1")
    scope = list(scope)
    hops = _adjacency(edges, scope, rel_types).select(*scope, "node", "next").where("node <> next").distinct()
    start = seeds.select(*scope, "seed").distinct()
    reached = start.select(*scope, "seed", F.col("seed").alias("id"), F.lit(0).cast("long").alias("min_depth"))
    front = reached
    for length in range(1, depth + 1):
        step = front.withColumnRenamed("id", "node").join(hops, [*scope, "node"])
        step = step.select(*scope, "seed", F.col("next").alias("id")).distinct()
        front = step.join(reached, [*scope, "seed", "id"], "left_anti")
        front = front.withColumn("min_depth", F.lit(length).cast("long"))
        if 1 < length < depth:
            front = materialize(front, "front")
        reached = reached.unionByName(front)
    return reached.where(F.col("min_depth") > 0)


def owned_facts(found: DataFrame, facts: DataFrame) -> DataFrame:
    """Keep rows of a neighbourhood in the typed graph whose seed and end are facts of one user."""
    owner = facts.select(F.concat(F.lit("f:"), F.col("id").cast("string")).alias("id"), "user_id")
    seeds = owner.withColumnRenamed("id", "seed")
    return found.join(owner, "id").join(seeds, ["user_id", "seed"])


def graph_nodes(facts: DataFrame) -> DataFrame:
    """Nodes of the exported graph: user_id, id, label, title, grp."""
    own = facts.select(
        "user_id",
        F.col("id").cast("string").alias("id"),
        F.lit("Fact").alias("label"),
        first_filled("title", "text").alias("title"),
        F.coalesce("category", F.lit("General")).alias("grp"),
    )
    named = facts.where(F.col("category").isNotNull()).select("user_id", F.col("category").alias("id")).distinct()
    categories = named.select(
        "user_id", "id", F.lit("Category").alias("label"), F.col("id").alias("title"), F.lit("CategoryNode").alias("grp")
    )
    return own.unionByName(categories)


def graph_edges(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of the exported graph, each once: user_id, from_id, to_id, label."""
    ids = facts.select("user_id", "id")
    inside = edges.join(ids.withColumnRenamed("id", "src"), ["user_id", "src"], "left_semi").join(
        ids.withColumnRenamed("id", "dst"), ["user_id", "dst"], "left_semi"
    )
    between = inside.select(
        "user_id",
        F.col("src").cast("string").alias("from_id"),
        F.col("dst").cast("string").alias("to_id"),
        F.col("rel").alias("label"),
    ).distinct()
    filed = facts.where(F.col("category").isNotNull()).select(
        "user_id",
        F.col("id").cast("string").alias("from_id"),
        F.col("category").alias("to_id"),
        F.lit(IN_CATEGORY).alias("label"),
    )
    return between.unionByName(filed)
