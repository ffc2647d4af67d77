"""Near-duplicate embeddings by NN-descent."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.blocks import list_array, list_parts, whole_groups
from factloom.llm.simhash import spanning_links
from factloom.operators.components import connected_components
from factloom.session import materialize

LEAF = 48  # aimed at
GROUP = 256  # rows that are compared with each other in one step, at most
TILE = 1024


@dataclass
class Settings:
    threshold: float = 0.95
    k: int = 8  # neighbours of a node at first
    k_most: int = 64  # beyond this, saturated nodes are compared in tiles
    trees: int = 6  # at least; more as the number of vectors grows
    rounds: int = 8
    settled: float = 0.01  # share of list entries that change in the last round
    recall: float = 0.95
    audited: int = 512  # at a time, until they hold ``audited_links`` links or are ``audited_most``
    audited_links: int = 400
    audited_most: int = 16384
    tries: int = 3
    planted: int = 1024  # vectors that get an artificial partner, by which recall is measured


def _units(values: np.ndarray, rows: int) -> np.ndarray:
    v = values.astype(np.float64).reshape(rows, -1)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _planes(dim: int, seed: int, bits: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, bits))


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): every row with the hash of its vector, and one node for each distinct usable vector.

    Usable: not null or empty, no null or non-finite component, not all zero. Others have no hash."""
    vec = F.col("embedding")
    if "float" not in vectors.schema["embedding"].dataType.simpleString():
        vec = vec.cast("array<double>")
    infinite = float("inf")
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(infinite))) & F.exists(vec, lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))
    h1, h2 = F.xxhash64(vec), F.xxhash64(F.lit("vector"), vec)
    kept = vectors.select("vec_id", vec.alias("vec"), F.when(usable, h1).alias("h1"), F.when(usable, h2).alias("h2"))
    grouped = kept.where("h1 is not null").groupBy("h1", "h2", "vec")
    nodes = grouped.agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"))
    nodes = nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("vec"))
    return materialize(kept.drop("vec"), "rows"), materialize(nodes, "nodes")


def _chunked(rows: DataFrame, keys: list[str], member: str, most: int, salt: int) -> DataFrame:
    """Add ``chunk``: groups of more than ``most`` rows are cut by a hash of the member."""
    large = rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most)
    large = large.select(*keys, F.ceil(F.col("n") / (most * 3 // 4)).cast("int").alias("chunks"))
    cut = F.pmod(F.xxhash64(member, F.lit(salt)), F.coalesce("chunks", F.lit(1))).cast("int")
    return rows.join(large, keys, "left").withColumn("chunk", cut).drop("chunks")


def _dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def _lists(batches: Iterable[pa.RecordBatch], keys: list[str], k_first: int) -> Iterator[pa.RecordBatch]:
    """Compare the members of each group; for each the best new neighbours that its list has room for."""
    for batch, bounds in whole_groups(batches, keys):
        node = batch.column("node").to_numpy()
        floor = batch.column("floor").to_numpy()
        most = batch.column("k").to_numpy()
        values, at = list_parts(batch.column("vec"))
        known, known_at = list_parts(batch.column("known"))
        out_node, out_nbr, out_sim, sizes = [], [], [], []
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            if end - start < 2:
                continue
            unit = _units(values[at[start] : at[end]], end - start)
            sims = unit @ unit.T
            np.fill_diagonal(sims, -2.0)
            good = sims > floor[start:end, None]
            ids = node[start:end]
            for i in np.flatnonzero(good.any(1)):
                found = np.flatnonzero(good[i])
                old = known[known_at[start + i] : known_at[start + i + 1]]
                if len(old):
                    found = found[~np.isin(ids[found], old)]
                found = found[ids[found] != ids[i]]
                if len(found) > most[start + i]:
                    found = found[np.argsort(-sims[i, found], kind="stable")[: most[start + i]]]
                if len(found):
                    out_node.append(ids[i])
                    out_nbr.append(ids[found])
                    out_sim.append(sims[i, found])
                    sizes.append(len(found))
        if out_node:
            nbr, sim, sizes = np.concatenate(out_nbr), np.concatenate(out_sim), np.array(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_node, pa.int64()), list_array(nbr, sizes, pa.int64()), list_array(sim, sizes, pa.float64())],
                ["node", "nbrs", "sims"],
            )


_LISTS = "node long, nbrs array<long>, sims array<double>"


def _compare(members: DataFrame, keys: list[str], s: Settings) -> DataFrame:
    keys = [*keys, "chunk"]
    return _dealt(members, keys).mapInArrow(lambda batches: _lists(batches, keys, s.k), _LISTS)


def _merged(graph: DataFrame, found: DataFrame) -> DataFrame:
    """Put found neighbours into the lists and cut these to their length; ``fresh`` has the entries that are new."""
    entries = F.arrays_zip(F.col("sims").alias("sim"), F.col("nbrs").alias("nbr"))
    gathered = found.select("node", entries.alias("entries")).groupBy("node").agg(
        F.flatten(F.collect_list("entries")).alias("more")
    )
    both = graph.join(gathered, "node", "left")
    merged = F.when(F.col("more").isNull(), F.col("list")).otherwise(
        F.slice(F.sort_array(F.array_union("list", "more"), asc=False), F.lit(1), F.col("k"))
    )
    merged = both.select("node", "k", "list", merged.alias("new"))
    fresh = F.transform(F.array_except("new", "list"), lambda e: e["nbr"])
    return merged.select("node", "k", F.col("new").alias("list"), fresh.alias("fresh"))


def _last(s: Settings) -> Column:
    """The similarity that a new neighbour must exceed: that of the last one of a full list. A list that was
    enlarged takes links only."""
    full = F.size("list") >= F.col("k")
    last = F.element_at("list", -1)["sim"]
    return F.when(full, last).when(F.col("k") > s.k, F.lit(np.nextafter(s.threshold, 0.0).item())).otherwise(F.lit(-1.5))


def trees_for(bits: int, attempt: int, s: Settings) -> int:
    """Trees in which a pair at the threshold, without other neighbours, shares a leaf with probability
    ``s.recall``; twice as many in each further attempt."""
    shared = (1 - acos(max(-1.0, min(1.0, s.threshold))) / pi) ** bits
    needed = ceil(log(1 - s.recall) / log(1 - shared)) if 0 < shared < 1 and s.recall < 1 else 1
    return max(s.trees, needed) << attempt


def initial_graph(nodes: DataFrame, graph: DataFrame, n: int, seed: int, s: Settings) -> DataFrame:
    """Lists from the leaves of random hyperplane trees, merged into ``graph``."""
    bits = max(0, ceil(log2(max(1, n / LEAF))))
    trees = trees_for(bits, seed, s)

    def leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            values, at = list_parts(batch.column("vec"))
            dims = np.diff(at)
            code = np.zeros((len(batch), trees), np.int64)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                unit = _units(np.concatenate([values[at[i] : at[i + 1]] for i in rows]), len(rows))
                for tree in range(trees):
                    code[rows, tree] = (unit @ _planes(dim, seed * 1000 + tree, bits) > 0) @ power
            leaf = list_array(code.ravel(), np.full(len(batch), trees), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("node"), leaf], ["node", "leaves"])

    placed = nodes.select("node", "vec").mapInArrow(leaves, "node long, leaves array<long>")
    placed = placed.select("node", F.posexplode("leaves").alias("tree", "leaf")).join(nodes.select("node", "vec", "dim"), "node")
    members = placed.join(_state(graph, s), "node")
    members = _chunked(members, ["tree", "leaf", "dim"], "node", GROUP, seed)
    return _merged(graph, _compare(members, ["tree", "leaf", "dim"], s))


def _state(graph: DataFrame, s: Settings) -> DataFrame:
    known = F.transform("list", lambda e: e["nbr"])
    return graph.select("node", "k", _last(s).alias("floor"), known.alias("known"))


def descend(nodes: DataFrame, graph: DataFrame, salt: int, s: Settings) -> DataFrame:
    """One round: the neighbours of each node, forward and backward, are compared with each other.

    Only nodes with a new entry among these take part, as other pairs have met before."""
    forward = graph.select(F.col("node").alias("hub"), F.explode(F.transform("list", lambda e: e["nbr"])).alias("node"), "fresh")
    forward = forward.select("hub", "node", F.array_contains("fresh", F.col("node")).alias("new"))
    backward = forward.select(F.col("node").alias("hub"), F.col("hub").alias("node"), "new")
    itself = graph.select(F.col("node").alias("hub"), "node", F.lit(False).alias("new"))
    members = forward.unionByName(backward).unionByName(itself)
    members = members.groupBy("hub", "node").agg(F.max("new").alias("new"))
    members = materialize(members, "members")
    active = members.where("new").select("hub").distinct()
    members = members.join(active, "hub", "left_semi").select("hub", "node")
    members = _chunked(members, ["hub"], "node", GROUP, salt)
    members = members.join(nodes.select("node", "vec"), "node").join(_state(graph, s), "node")
    return _merged(graph, _compare(members, ["hub"], s))


def _saturated(s: Settings) -> Column:
    return (F.size("list") >= F.col("k")) & (F.element_at("list", -1)["sim"] >= s.threshold)


def refine(nodes: DataFrame, graph: DataFrame, n: int, seed: int, s: Settings) -> DataFrame:
    """Rounds until few entries change and no list was enlarged; saturated lists double in length."""
    for round_ in range(s.rounds):
        graph = materialize(descend(nodes, graph, seed * 100 + round_, s), "graph")
        grows = _saturated(s) & (F.col("k") < s.k_most)
        seen = graph.agg(F.sum(F.size("fresh")), F.count(F.when(grows, 1))).first()
        changed, growing = seen[0] or 0, seen[1]
        if not growing and changed <= s.settled * n * s.k:
            break
        if growing:
            # All entries of an enlarged list count as new, so that its neighbours meet again.
            fresh = F.when(grows, F.transform("list", lambda e: e["nbr"])).otherwise(F.col("fresh"))
            k = F.when(grows, F.col("k") * 2).otherwise(F.col("k"))
            graph = graph.select("node", k.alias("k"), "list", fresh.alias("fresh"))
    return graph


def _score_tiles(batches: Iterable[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Per pair of tiles: for each node the number of its links, and spanning links."""
    for batch, bounds in whole_groups(batches, ["low", "high"]):
        node, tile, copies = (batch.column(c).to_numpy() for c in ("node", "tile", "copies"))
        values, at = list_parts(batch.column("vec"))
        for start, end in zip(bounds[:-1], bounds[1:], strict=True):
            unit = _units(values[at[start] : at[end]], end - start)
            ids, side, weight = node[start:end], tile[start:end], copies[start:end]
            linked = unit @ unit.T >= threshold
            np.fill_diagonal(linked, False)
            if side.min() != side.max():
                linked &= side[:, None] != side[None, :]
            a, b = np.nonzero(np.triu(linked))
            to, low = spanning_links(ids[a], ids[b]) if len(a) else (ids[:0], ids[:0])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids, to])),
                    pa.array(np.concatenate([linked @ weight, np.zeros(len(to), np.int64)])),
                    pa.array(np.concatenate([linked.sum(1), np.zeros(len(to), np.int64)])),
                    pa.array([None] * len(ids) + low.tolist(), pa.int64()),
                ],
                ["node", "n", "partners", "link"],
            )


def dense_links(dense: DataFrame, s: Settings) -> DataFrame:
    """Links among saturated nodes ``dense`` (node, component, copies, vec, dim): (node, n, partners, link).

    They lie in groups so tight that lists would hold every pair. Per component they are cut into tiles,
    tile pairs are compared as matrices, and counts and spanning links come out, not pairs."""
    sizes = dense.groupBy("component").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    rows = dense.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("tile", F.xxhash64("component", "part")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    )
    other = F.xxhash64("component", "other")
    rows = rows.select(
        "node", "copies", "vec", "tile", F.least("tile", other).alias("low"), F.greatest("tile", other).alias("high")
    )
    return _dealt(rows, ["low", "high"]).mapInArrow(lambda b: _score_tiles(b, s.threshold), "node long, n long, partners long, link long")


def planted_partners(nodes: DataFrame, s: Settings) -> DataFrame:
    """For ``s.planted`` of the nodes an artificial one just above the threshold: node (negative), vec, dim, copies (0) and
    ``of``, the node it is a partner of. In more than one dimension only."""
    above = s.threshold + 0.02 * (1 - s.threshold)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = list_parts(batch.column("vec"))
            node, out = batch.column("node").to_numpy(), []
            for i, own in enumerate(node.tolist()):
                unit = _units(values[at[i] : at[i + 1]], 1)[0]
                side = np.random.default_rng([own & 0x7FFFFFFF, own >> 31]).standard_normal(len(unit))
                side -= (side @ unit) * unit
                out.append((above * unit + np.sqrt(1 - above * above) * side / np.sqrt(side @ side)).tolist())
            arrays = [pa.array(-1 - node), pa.array(out, pa.list_(pa.float64())), batch.column("dim"), pa.array(np.zeros(len(node), np.int64)), batch.column("node")]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "vec", "dim", "copies", "of"])

    drawn = nodes.where("dim > 1").orderBy(F.xxhash64("h1"), "node").limit(s.planted).select("node", "vec", "dim")
    made = drawn.mapInArrow(run, "node long, vec array<double>, dim int, copies long, of long")
    return made.withColumn("vec", F.col("vec").cast(nodes.schema["vec"].dataType))


def planted_recall(graph: DataFrame, planted: DataFrame, s: Settings) -> float | None:
    """Share of the planted pairs that are in a list of either side. Every one is a true link, however rare links are
    among the vectors themselves, and one that no third vector leads to unless it has other neighbours."""
    own = graph.join(planted.select("node", "of"), "node").select("node", "of", F.exists("list", lambda e: e["nbr"] == F.col("of")).alias("found"))
    lists = graph.join(planted.select(F.col("of").alias("node"), F.col("node").alias("partner")), "node")
    back = lists.where(F.exists("list", lambda e: e["nbr"] == F.col("partner"))).select(F.col("partner").alias("node"), F.lit(True).alias("back"))
    seen = own.join(back, "node", "left").agg(F.count("*"), F.count(F.when(F.col("found") | F.col("back"), 1))).first()
    return seen[1] / seen[0] if seen[0] else None


@dataclass
class Links:
    """counts: (node, n_links in other rows, partners in other nodes); edges: (a, b), which connect all that is linked."""

    counts: DataFrame
    edges: DataFrame


def collect_links(nodes: DataFrame, graph: DataFrame, s: Settings) -> Links:
    # Planted partners (negative) are no part of the result. They may have filled a list, which then counts as saturated.
    graph = graph.where("node >= 0")
    entry = F.explode(F.filter("list", lambda e: (e["sim"] >= s.threshold) & (e["nbr"] >= 0))).alias("e")
    listed = graph.select("node", entry).select(F.col("node").alias("a"), F.col("e.nbr").alias("b"))
    pairs = materialize(listed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    saturated = materialize(graph.where(_saturated(s)).select("node"), "saturated")
    labels = materialize(connected_components(pairs, []), "labels")
    dense = saturated.join(labels, "node").join(nodes.select("node", "copies", "vec"), "node")
    scored = materialize(dense_links(dense, s), "dense")

    both = pairs.join(saturated.select(F.col("node").alias("a"), F.lit(1).alias("sa")), "a", "left")
    both = both.join(saturated.select(F.col("node").alias("b"), F.lit(1).alias("sb")), "b", "left")
    sparse = both.where("sa is null or sb is null").select("a", "b")
    turned = sparse.unionByName(sparse.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weighed = turned.join(nodes.select(F.col("node").alias("b"), "copies"), "b").select(F.col("a").alias("node"), F.col("copies").alias("n"), F.lit(1).cast("long").alias("partners"))
    own = nodes.select("node", (F.col("copies") - 1).alias("n"), F.lit(0).cast("long").alias("partners"))
    counts = weighed.unionByName(own).unionByName(scored.select("node", "n", "partners"))
    counts = counts.groupBy("node").agg(F.sum("n").alias("n_links"), F.sum("partners").alias("partners"))
    edges = pairs.unionByName(scored.where("link is not null").select(F.col("node").alias("a"), F.col("link").alias("b")))
    return Links(counts, edges.distinct())


def exact_links(nodes: DataFrame, s: Settings) -> Links:
    """All links by comparing all vectors of a length, in tiles."""
    scored = materialize(dense_links(nodes.withColumn("component", F.col("dim")), s), "dense")
    own = nodes.select("node", (F.col("copies") - 1).alias("n"), F.lit(0).cast("long").alias("partners"))
    counts = own.unionByName(scored.select("node", "n", "partners")).groupBy("node")
    edges = scored.where("link is not null").select(F.col("node").alias("a"), F.col("link").alias("b"))
    return Links(counts.agg(F.sum("n").alias("n_links"), F.sum("partners").alias("partners")), edges.distinct())


def audit(nodes: DataFrame, counts: DataFrame, s: Settings) -> float | None:
    """Recall of links between different vectors, each partner counted once however many rows share it.

    Nodes are compared with all others, ``s.audited`` at a time, until they hold enough true links, all nodes
    were compared, or ``s.audited_most``; None if there were too few links then to say anything."""
    drawn = materialize(nodes.join(counts, "node").select("node", "vec", "partners", F.xxhash64("h1").alias("order")), "drawn")
    n, done, there, found = drawn.count(), 0, 0, 0
    while done < min(n, s.audited_most) and there < s.audited_links:
        queries = drawn.orderBy("order", "node").offset(done).limit(s.audited).collect()
        true = _true_partners(nodes, queries, s.threshold)
        there += sum(true.values())
        found += sum(min(q["partners"], true[q["node"]]) for q in queries)
        done += len(queries)
    if there < s.audited_links and done < n:
        return None
    return found / there if there else 1.0


def _true_partners(nodes: DataFrame, queries: list, threshold: float) -> dict[int, int]:
    """Number of other nodes that each of ``queries`` is linked with, by comparing all, in blocks."""
    by_dim: dict[int, tuple[list[int], np.ndarray]] = {}
    for dim in {len(q["vec"]) for q in queries}:
        rows = [q for q in queries if len(q["vec"]) == dim]
        by_dim[dim] = [q["node"] for q in rows], _units(np.array([q["vec"] for q in rows]), len(rows))
    shared = nodes.sparkSession.sparkContext.broadcast(by_dim)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            values, at = list_parts(batch.column("vec"))
            node = batch.column("node").to_numpy()
            dims = np.diff(at)
            for dim, (ids, unit) in shared.value.items():
                rows = np.flatnonzero(dims == dim)
                if len(rows):
                    others = _units(np.concatenate([values[at[i] : at[i + 1]] for i in rows]), len(rows))
                    linked = unit @ others.T >= threshold
                    linked &= np.array(ids)[:, None] != node[rows]  # a vector is not linked with itself
                    for ident, number in zip(ids, linked.sum(1).tolist(), strict=True):
                        total[ident] = total.get(ident, 0) + number
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["node", "n"])

    exact = nodes.select("node", "vec").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    return {r["node"]: r["n"] for r in exact.collect()}


def near_duplicate_vectors(vectors: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Link vectors of cosine >= threshold: vec_id, n_links, component_id, kept, for every row of ``vectors``
    (vec_id, embedding).

    n_links counts the other rows linked directly, component_id is the smallest vec_id reachable, kept says
    that it is the row's own. Cosines are in double precision; no link below the threshold is counted.
    The method is approximate: its recall of links between different vectors is measured, and the search
    goes on with new random trees, twice as many each time, until it reaches ``settings.recall``. It is measured twice:
    on partners planted just above the threshold, which are searched with the rest and left out of the result, and
    on the true links of drawn vectors where these have enough. If ``settings.tries`` attempts do not reach it, all
    vectors are compared in tiles.

    Vectors that are null or empty, all zero, or hold null or non-finite components link with nothing, nor do
    vectors of different lengths, nor rows without vec_id (component_id null, kept false). Equal vectors
    are one node: however many rows share one, they are counted, not compared. Rows that repeat a vec_id
    are vectors of their own. Other columns, among them labels, are ignored.

    Lists have ``k`` neighbours at first and double while all of them are links. Nodes that are still
    saturated at ``k_most`` are compared exactly, in tiles. Hubs are cut into groups of bounded size, by
    other cuts in each round.
    """
    s = settings or Settings()
    rows, nodes = vector_classes(vectors)
    n = nodes.count()
    empty = F.array().cast("array<struct<sim:double,nbr:long>>")
    planted = materialize(planted_partners(nodes, s), "planted")
    searched = materialize(nodes.unionByName(planted.drop("of"), allowMissingColumns=True), "searched") if n else nodes
    graph = searched.select("node", F.lit(s.k).alias("k"), empty.alias("list"), F.array().cast("array<long>").alias("fresh"))
    for attempt in range(s.tries):
        graph = materialize(initial_graph(searched, graph, n, attempt, s), "graph")
        graph = refine(searched, graph, n, attempt, s)
        of_planted = planted_recall(graph, planted, s)
        if of_planted is not None and of_planted < s.recall:
            continue
        links = collect_links(nodes, graph, s)
        links.counts = materialize(links.counts, "counts")
        of_drawn = audit(nodes, links.counts, s)
        if min(of_planted or 1.0, of_drawn if of_drawn is not None else 1.0) >= s.recall and (of_planted or of_drawn):
            break
    else:
        links = exact_links(nodes, s)
        links.counts = materialize(links.counts, "counts")
    labels = connected_components(links.edges, [])
    grouped = nodes.select("node", "h1", "h2", "first_id").join(labels, "node", "left")
    grouped = grouped.withColumn("component", F.coalesce("component", "node"))
    lowest = grouped.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = grouped.join(lowest, "component").join(links.counts, "node").select("h1", "h2", "n_links", "component_id")
    named = rows.where("h1 is not null").join(known, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = named.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
