"""Connected components and roots of trees as DataFrame rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64(*edges.columns).cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, scope: list[str], max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges`` (``scope + [a, b]``, undirected) with its smallest node.

    Alternating star contraction: a round hangs every larger neighbour of a node on the
    smallest one, then the same for the smaller neighbours, until only stars are left
    (about log² of the number of nodes). The minimum per node is a partial aggregate,
    so a hub does not gather in one task, and each round is written out, not cached.
    Returns ``scope + [node, component]``.
    """

    def hang(links: DataFrame) -> DataFrame:
        lowest = links.groupBy(*scope, "u").agg(F.min("v").alias("low"))
        return links.join(lowest.withColumn("low", F.least("u", "low")), [*scope, "u"])

    def pair(df: DataFrame, u: str, v: str) -> DataFrame:
        return df.select(*scope, F.col(u).alias("u"), F.col(v).alias("v"))

    links = edges.where(F.col("a") != F.col("b"))
    links = materialize(
        links.select(*scope, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    seen = _fingerprint(links)
    for _ in range(max_rounds):
        both = pair(links, "u", "v").unionByName(pair(links, "v", "u"))
        large = hang(both).where(F.col("v") > F.col("u"))
        large = pair(large, "v", "low").where(F.col("u") != F.col("v")).distinct()
        small = hang(large)
        small = pair(small, "v", "low").unionByName(pair(small, "u", "low"))
        links = materialize(small.where(F.col("u") != F.col("v")).distinct(), "links")
        now = _fingerprint(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = links.select(*scope, F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(*scope, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)


def _to_top(batch: pd.DataFrame, scope: list[str]) -> pd.DataFrame:
    """Lead every row up to the highest node within the batch: ``top``, and the parent of that; in a circle top is null."""
    nodes = pd.MultiIndex.from_frame(batch[[*scope, "node"]])
    above = nodes.get_indexer(pd.MultiIndex.from_frame(batch[[*scope, "parent"]]))
    at = np.where(above < 0, np.arange(len(batch)), above)
    for _ in range(len(batch).bit_length()):
        at = at[at]
    top = batch["node"].to_numpy()[at]
    if (above[at] >= 0).any():
        top = np.where(above[at] < 0, top.astype(object), None)
    return batch.assign(top=top, parent=batch["parent"].to_numpy()[at])


def tree_roots(links: DataFrame, scope: list[str]) -> DataFrame:
    """The root above each node of ``links`` (``scope + [node, parent]``, stored): scope + [node, root].

    A node must have one parent; a circle raises an error. Rows are sorted by node, and what hangs together within
    a batch of rows is followed there: ids that were given in a row make long chains, which are then a link for each batch.
    Only the highest nodes of the batches take part in the rounds, each of which doubles the steps a node has gone.
    """

    def to_top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (_to_top(batch, scope) for batch in batches if len(batch))

    def named(df: DataFrame, **columns: str) -> DataFrame:
        return df.select(*scope, *[F.col(old).alias(new) for new, old in columns.items()])

    kinds = {f.name: f.dataType.simpleString() for f in links.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*scope, "node", "parent"]) + f", top {kinds['node']}"
    rows = named(links, node="node", parent="parent").repartitionByRange(*scope, "node").sortWithinPartitions(*scope, "node")
    batched = materialize(rows.mapInPandas(to_top, schema), "batched")
    if batched.where("top is null").take(1):
        raise ValueError("links form a circle")
    tops = named(batched.where("node = top"), node="node", parent="parent")
    tops = tops.join(named(batched, parent="node", next="top"), [*scope, "parent"], "left")
    ended = F.when(F.col("next").isNull(), F.col("parent"))
    climbed = materialize(tops.select(*scope, "node", "next", ended.alias("root")), "tops")
    most, steps = climbed.count(), 1
    while climbed.where("root is null").take(1):
        if steps > most:
            raise ValueError("links form a circle")
        further = named(climbed, next="node", _next="next", _root="root")
        moved = climbed.where("root is null").select(*scope, "node", "next").join(further, [*scope, "next"])
        moved = named(moved, node="node", next="_next", root="_root")
        climbed, steps = materialize(climbed.where("root is not null").unionByName(moved), "tops"), steps * 2
    return named(batched.join(named(climbed, top="node", root="root"), [*scope, "top"]), node="node", root="root")
