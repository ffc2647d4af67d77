"""Merkle manifest of a dataset, with a proof for every row by pointer jumping."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.session import materialize

#: Levels of a tree that one pass builds, within groups of 2 ** LEVELS neighbouring nodes.
LEVELS = 6
#: A sibling that does not exist: the node is the last of its level and stands alone.
NONE = b""


def tagged(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*[tagged(v) for v in values]), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined_digest(left: Column, right: Column) -> Column:
    """Digest of a run of two nodes, or of one if ``right`` is NONE."""
    return F.unhex(F.sha2(F.concat(hex_text(left), hex_text(right)), 256))


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add place (0, 1, … within ``scope``, by ``order``) and size (rows of the scope).

    Rows are sorted by ranges, so a scope of any size spreads over the partitions; what rows come before a
    partition is a sum over one small row for each partition and scope. ``rows`` has a ``row`` number that
    tells equal rows apart, so that a large group of them can be cut as well."""
    keys = ["scope", *order, "row"]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    spread = materialize(spread.withColumn("at", F.monotonically_increasing_id()), "ordered")
    spread = spread.withColumn("part", F.shiftright("at", 33))
    parts = spread.groupBy("scope", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    scope = Window.partitionBy("scope")
    before = scope.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    parts = materialize(parts.select("scope", "part", "first", start.alias("start"), F.sum("n").over(scope).alias("size")), "parts")
    placed = spread.join(parts, ["scope", "part"])
    return placed.withColumn("place", F.col("at") - F.col("first") + F.col("start")).drop("at", "part", "first", "start", "row")


@dataclass
class Forest:
    """paths: (scope, place, path), the siblings of each leaf up to the root of its scope, unless it is the root.
    roots: (scope, digest)."""

    paths: DataFrame
    roots: DataFrame


def _with_siblings(run: Column, level: int, first: Column) -> Column:
    """(level, place, path) of each node of a run whose first one is at ``first``; path holds its sibling."""

    def node(_: Column, j: Column) -> Column:
        sibling = F.coalesce(F.get(run, j.bitwiseXOR(F.lit(1))), F.lit(NONE))
        return F.struct(F.lit(level).alias("level"), (first + j).alias("place"), F.array(sibling).alias("path"))

    return F.transform(run, node)


def _parents(run: Column) -> Column:
    pairs = F.sequence(F.lit(0), F.floor((F.size(run) - 1) / 2).cast("int"))
    return F.transform(pairs, lambda j: joined_digest(F.get(run, j * 2), F.coalesce(F.get(run, j * 2 + 1), F.lit(NONE))))


def _built(nodes: DataFrame, base: int) -> DataFrame:
    """LEVELS levels above ``base``: (scope, depth, place, digest) of the nodes on top, and ``inner``, the nodes
    passed on the way with their sibling. Scopes whose depth is reached stay as they are."""
    group = F.shiftright("place", LEVELS).alias("group")
    members = F.sort_array(F.collect_list(F.struct("place", "digest")))
    built = nodes.groupBy("scope", "depth", group).agg(members.alias("members"))
    built = built.withColumn("run", F.transform("members", lambda m: m["digest"])).drop("members")
    built = built.withColumn("inner", F.array().cast("array<struct<level:int,place:long,path:array<binary>>>"))
    for step in range(LEVELS):
        run, grows = F.col("run"), F.col("depth") > base + step
        inner = F.concat("inner", _with_siblings(run, base + step, F.shiftleft("group", LEVELS - step)))
        built = built.withColumn("inner", F.when(grows, inner).otherwise(F.col("inner")))
        built = built.withColumn("run", F.when(grows, _parents(run)).otherwise(run))
    return built.select("scope", "depth", F.col("group").alias("place"), F.get("run", F.lit(0)).alias("digest"), "inner")


def _climbed(nodes: DataFrame, depth: int) -> DataFrame:
    """Pointer jumping: each round a node's path is followed by that of the node it leads to, which doubles the
    distance, until the leaves reach the roots.

    After a round of distance d only nodes on levels that d divides are still led to; the others are left
    behind, so a round costs little more than the leaves. Nodes that have arrived find no partner."""
    reach = 1
    while reach < depth:
        low = nodes.where(F.col("level") % (2 * reach) == 0).withColumn("above", F.shiftright("place", reach))
        high = nodes.where(F.col("level") % (2 * reach) == reach)
        high = high.select("scope", (F.col("level") - reach).alias("level"), F.col("place").alias("above"), F.col("path").alias("rest"))
        joined = low.join(high, ["scope", "level", "above"], "left")
        path = F.concat("path", F.coalesce("rest", F.array().cast("array<binary>")))
        nodes = materialize(joined.select("scope", "level", "place", path.alias("path")), "paths")
        reach *= 2
    return nodes.where("level = 0").select("scope", "place", "path")


def merkle_forest(leaves: DataFrame) -> Forest:
    """Binary trees over ``leaves`` (scope, place, size, digest), one for each scope."""
    # The number of binary digits of size - 1: how often size can be halved, rounding up, until 1 is left.
    depth = F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0)
    nodes = leaves.select("scope", depth.alias("depth"), "place", "digest")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    inner = []
    for base in range(0, deepest, LEVELS):
        built = materialize(_built(nodes, base), "levels")
        inner.append(built.select("scope", F.explode("inner").alias("node")).select("scope", "node.*"))
        nodes = built.drop("inner")
    roots = nodes.select("scope", "digest")
    if not inner:
        return Forest(nodes.where("false").select("scope", "place", F.array("digest").alias("path")), roots)
    return Forest(_climbed(reduce(DataFrame.unionByName, inner), deepest), roots)


def fold(leaf: Column, place: Column, path: Column) -> Column:
    """Digest of the root that a leaf at ``place`` and its siblings lead to."""

    def up(state: Column, sibling: Column) -> Column:
        digest, odd = state["digest"], state["place"].bitwiseAND(F.lit(1)) == 1
        above = F.when(odd, joined_digest(sibling, digest)).otherwise(joined_digest(digest, sibling))
        return F.struct(above.alias("digest"), F.shiftright(state["place"], 1).alias("place"))

    start = F.struct(leaf.alias("digest"), place.cast("long").alias("place"))
    return F.aggregate(path, start, up)["digest"]


def path_digest(*paths: Column) -> Column:
    """SHA-256 of all siblings of the paths, in order, as text."""
    return F.sha2(F.array_join(F.transform(F.concat(*paths), hex_text), ""), 256)


def merkle_manifest(docs: DataFrame, columns: list[str], scope: str, order: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """Digest of every row of ``docs``, of each ``scope``, and of the whole, with a proof for every row.

    Returns ``order`` and ``carry`` (names and expressions over ``docs``), leaf, place, path, subroot, top_place, top_path and
    root. A leaf is the digest of ``columns``, nulls told apart from empty texts. The leaves of a scope
    ascend by ``order``, the subroots by scope, nulls first and texts by their bytes; two neighbours become their joint digest,
    a last one alone its own, until one is left. path holds a leaf's siblings up to the subroot, top_path those
    of the subroot up to the root; ``fold`` leads from a leaf over both to the root. A sibling that does not exist is empty.

    Rows that share ``order`` are placed by their digest; rows equal in all columns are interchangeable leaves of their own.
    A null of ``order`` comes first in its scope, a null scope is a scope of its own. An empty table gives an empty
    result. Other columns are ignored, whatever their names. Texts are read once and not shuffled.
    """
    known = F.coalesce(F.concat(F.lit("="), F.col(scope).cast("string")), F.lit(""))
    own = {f"carry_{name}": value for name, value in (carry or {}).items()}
    leaves = docs.select(
        known.alias("scope"),
        F.col(order).alias("key"),
        leaf_digest(*[F.col(c) for c in columns]).alias("digest"),
        *[value.alias(name) for name, value in own.items()],
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = materialize(_numbered(materialize(leaves, "leaves"), ["key", "digest"]), "placed")
    trees = merkle_forest(leaves)
    tops = trees.roots.select(F.lit("").alias("scope"), F.col("scope").alias("name"), "digest", F.lit(0).cast("long").alias("row"))
    tops = materialize(_numbered(materialize(tops, "subroots"), ["name"]), "subroots-placed")
    whole = merkle_forest(tops)

    none = F.array().cast("array<binary>")
    ends = tops.join(whole.paths, ["scope", "place"], "left").join(whole.roots.withColumnRenamed("digest", "root"), "scope")
    ends = ends.select(
        F.col("name").alias("scope"),
        F.col("digest").alias("subroot"),
        F.col("place").alias("top_place"),
        F.coalesce("path", none).alias("top_path"),
        "root",
    )
    proven = leaves.join(trees.paths, ["scope", "place"], "left").join(materialize(ends, "ends"), "scope")
    return proven.select(
        F.col("key").alias(order),
        *[F.col(f"carry_{name}").alias(name) for name in carry or {}],
        F.col("digest").alias("leaf"),
        "place",
        F.coalesce("path", none).alias("path"),
        "subroot",
        "top_place",
        "top_path",
        "root",
    )


def verified_manifest(manifest: DataFrame, shown: Column) -> DataFrame:
    """Add folded_root, from the digest ``shown`` and the siblings, and verified: whether it is the root."""
    folded = fold(fold(shown, F.col("place"), F.col("path")), F.col("top_place"), F.col("top_path"))
    return manifest.withColumn("folded_root", folded).withColumn("verified", F.col("folded_root") == F.col("root"))
