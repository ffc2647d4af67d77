from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import duplicates as dup
from factloom.operators import pivots
from factloom.operators.components import connected_components
from factloom.operators.ranking import running_number, top_k
from factloom.operators.similarity import recency_pool, similarity_items
from factloom.session import materialize
from factloom.sources.tables import records_from_json

FACTS = "user_id string, id int, category string, title string, ts timestamp_ntz"
VECTORS = "user_id string, id int, embedding array<float>"


def store(spark, items):
    """items: (id, category, title, vector); the newest fact has the largest id."""
    facts = spark.createDataFrame([("u", i, c, t) for i, c, t, _ in items], "user_id string, id int, category string, title string")
    facts = facts.withColumn("ts", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, id, 0)"))
    vectors = spark.createDataFrame([("u", i, v) for i, _, _, v in items], VECTORS)
    return facts, vectors


# What titles add to the cosine, and the least score they give; worked out by hand.
SAME, ALL, HALF, NOTHING = (0.0, 1.0), (0.25, 0.86), (0.125, -2.0), (0.0, -2.0)
#: Two titles: relation among people, relation elsewhere (where words of one or two letters do not count).
RELATIONS = {
    ("rosa field", "field rosa"): (ALL, ALL),
    ("rosa field", "rosa"): (ALL, ALL),
    ("field rosa", "rosa"): (ALL, ALL),
    ("al b", "b"): (ALL, NOTHING),
    ("al x", "al"): (ALL, NOTHING),
    ("ivo marsh x", "ivo of"): (HALF, HALF),
    ("ivo marsh x", "of x"): (HALF, NOTHING),
    ("ivo of", "of x"): (HALF, NOTHING),
}


def relation(first, second, category):
    if not first or not second:
        return NOTHING
    first, second = first.strip().lower(), second.strip().lower()
    if first == second:
        return SAME
    found = RELATIONS.get((first, second)) or RELATIONS.get((second, first)) or (NOTHING, NOTHING)
    return found[category != "People"]


def score(a, b):
    """Expected score of two items; None where a vector has no length."""
    x, y = (np.asarray(item[3], np.float32).astype(float) for item in (a, b))
    squares = (x @ x) * (y @ y)
    if squares == 0:
        return None
    bonus, least = relation(a[2], b[2], a[1])
    return max(x @ y / np.sqrt(squares) + bonus, least)


def brute_force(items, threshold):
    pairs = {}
    for a, b in itertools.combinations(items, 2):
        if a[1] == b[1]:
            s = score(a, b)
            if s is not None and s >= threshold:
                pairs[a[0], b[0]] = s
    group = {i: {i} for i, *_ in items}
    for a, b in pairs:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for i in group[b]:
                group[i] = group[a]
    clusters = {frozenset(g) for g in group.values() if len(g) > 1}
    partners = {}
    for (a, b), s in pairs.items():
        partners.setdefault(a, []).append(s)
        partners.setdefault(b, []).append(s)
    return clusters, partners


def check(spark, items, threshold, **options):
    found = dup.find_duplicates(*store(spark, items), threshold, **options)
    members = found.members.toPandas()
    clusters, partners = brute_force(items, threshold)
    got = {frozenset(g["id"]) for _, g in members.groupby(["category", "cluster_id"])}
    assert got == clusters
    want = {i: (len(s), round(float(np.mean(s)), 4), round(float(max(s)), 4)) for i, s in partners.items()}
    assert {r.id: pytest.approx(want[r.id], abs=1e-4) for r in found.partners.collect()} == {
        r.id: (r.partners, r.mean_similarity, r.best_similarity) for r in found.partners.collect()
    }
    assert {r.id for r in found.partners.collect()} == set(want)
    # Clusters of a category are numbered by their most recent member, here the largest id.
    for category, part in members.groupby("category"):
        newest = part.groupby("cluster_id")["id"].max().sort_index()
        assert list(newest.index) == list(range(1, len(newest) + 1))
        assert list(newest) == sorted(newest, reverse=True)
    return found


def random_items(n, seed, hot=0.0):
    rng = np.random.default_rng(seed)
    names = ["rosa field", "field rosa", "rosa", "al b", "b", " ", "", None, "ivo marsh x", "ivo of", "of x"]
    centers = rng.normal(size=(6, 5))
    items = []
    for i in range(n):
        title = "rosa field" if rng.random() < hot else names[rng.integers(len(names))]
        vector = centers[rng.integers(6)] + rng.normal(size=5) * 0.4
        if rng.random() < 0.03:
            vector = vector * 0
        items.append((i, ["People", "Tool"][rng.integers(2)], title, [float(x) for x in vector]))
    return items


@pytest.mark.parametrize("threshold", [0.9, 0.97, 1.05])
def test_clusters_equal_brute_force(spark, threshold):
    check(spark, random_items(70, 3), threshold)


@pytest.mark.parametrize("seed", [1, 2])
def test_many_tiles_and_a_title_of_a_third_of_all_facts(spark, seed):
    """Tiles of 7 rows, a title with tiles of its own, and components over several rounds."""
    check(spark, random_items(90, seed, hot=0.33), 0.98, tile_rows=7, group_bound=3)


@pytest.mark.parametrize("threshold", [0.86, 0.75, 0.4])
def test_titles_lift_pairs_that_no_tile_brings_together(spark, threshold):
    """Below the score of titles with all words in common, pairs count however far apart their vectors are."""
    rng = np.random.default_rng(7)
    centers = np.eye(6) * 5
    names = ["rosa field", "field rosa", "rosa", "al b", "b", "ivo marsh x", "ivo of", "of x", None]
    items = [
        (i, ["People", "Tool"][i % 2], names[rng.integers(len(names))], [float(x) for x in centers[rng.integers(6)] + 0.3 * rng.normal(size=6)])
        for i in range(120)
    ]
    check(spark, items, threshold, tile_rows=9)


def tile_pairs_of(spark, items, rows, least_cosine):
    facts, vectors = store(spark, items)
    found = similarity_items(facts, vectors)
    cells, near = pivots.pivot_cells(found, ["user_id", "category"], "id", rows)
    cells = cells.withColumn("heavy", F.when(F.col("copies") > rows, F.col("node")))
    pairs = pivots.tile_pairs(cells, near, ["user_id", "category"], rows, least_cosine).collect()
    tiles = {tuple(p[end]) for p in pairs for end in ("low", "high")}
    assert len({(tuple(p.low), tuple(p.high)) for p in pairs}) == len(pairs)
    return len(pairs), len(tiles)


def test_far_tiles_are_not_compared(spark):
    """In tight clusters most pairs of tiles are ruled out; in a heap of anything none needs to be."""
    rng = np.random.default_rng(8)
    centers = np.eye(12)
    clustered = [(i, "Tool", f"t{i}", (centers[i % 12] + 0.02 * rng.normal(size=12)).tolist()) for i in range(600)]
    kept, tiles = tile_pairs_of(spark, clustered, 20, 0.6)
    assert kept < 0.3 * tiles * (tiles + 1) / 2
    heap = [(i, "Tool", f"t{i}", rng.normal(size=12).tolist()) for i in range(200)]
    kept, tiles = tile_pairs_of(spark, heap, 20, -1.0)
    assert kept == tiles * (tiles + 1) / 2


def test_a_group_of_copies_only(spark):
    items = [(i, "Tool", "same thing", [float(np.cos(i)), float(np.sin(i))]) for i in range(30)]
    found = check(spark, items, 0.999, tile_rows=4)
    row = found.clusters.first()
    assert (row.size, row.avg_similarity, row.recommendation) == (30, 1.0, "MERGE - high overlap")


def test_title_rules(spark):
    a, b, c = [1.0, 0.0], [0.0, 1.0], [0.7, 0.7]
    # Equal words in another order count as all words shared: floor 0.86.
    check(spark, [(1, "People", "Rosa Field", a), (2, "People", "Field Rosa", b)], 0.85)
    check(spark, [(1, "People", "Rosa", a), (2, "People", "Rosa Field", b)], 0.85)
    # A two-letter word counts as a name only.
    check(spark, [(1, "People", "Al X", a), (2, "People", "Al", b), (3, "Tool", "Al X", a), (4, "Tool", "Al", b)], 0.85)
    # Blank titles are equal, empty and missing ones are not compared.
    check(spark, [(1, "Tool", " ", a), (2, "Tool", "\t", b), (3, "Tool", "", a), (4, "Tool", "", b), (5, "Tool", None, c)], 0.99)
    # No length, no partner, even with an equal title.
    check(spark, [(1, "Tool", "x y", [0.0, 0.0]), (2, "Tool", "x y", a), (3, "Tool", "x y", b)], 0.9)


def test_pool_and_category(spark):
    items = [(i, "Tool", f"t{i // 2}", [1.0, float(i)]) for i in range(8)]
    facts, vectors = store(spark, items)
    pool = recency_pool(facts, 3)
    assert [r.id for r in pool.orderBy("recency").collect()] == [7, 6, 5]
    assert dup.pool_size(50) == 500 and dup.pool_size(200) == 1000
    assert dup.find_duplicates(facts, vectors, 0.999999, category="People").members.count() == 0
    limited = dup.find_duplicates(facts, vectors, 1.0, category="Tool", limit=1)
    assert limited.members.count() == 8


def test_new_facts_scanned_equal_tiled_equal_brute_force(spark):
    known, new = random_items(60, 8), random_items(25, 9)
    facts, vectors = store(spark, known)
    arriving, new_vectors = store(spark, new)
    arriving = arriving.join(new_vectors, ["user_id", "id"])
    want = {}
    for n in new:
        hits = [s for k in known if k[1] == n[1] and (s := score(n, k)) is not None and s >= 0.95]
        if hits:
            want[n[0]] = (len(hits), round(float(max(hits)), 4))
    scanned = dup.check_new_facts(arriving, facts, vectors, 0.95)
    assert {r.id: (r.partners, r.best_similarity) for r in scanned.collect()} == want

    from factloom.operators import similarity

    items = similarity.similarity_items(facts, vectors)
    mine = similarity.similarity_items(store(spark, new)[0], new_vectors)
    by_title = lambda df: df.withColumn("node", F.concat_ws("|", "words"))  # noqa: E731 - any shared naming will do
    parts = [
        similarity.evidence_against(by_title(mine), by_title(items), 0.95, **options).groupBy("id").agg(F.sum("partners").alias("n"))
        for options in ({}, {"broadcast_rows": 3, "tile_rows": 6})
    ]
    assert sorted(parts[0].collect()) == sorted(parts[1].collect())


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [("s", int(a), int(b)) for a, b in rng.integers(0, 60, size=(45, 2))]
    edges += [("s", 100 + i, 101 + i) for i in range(20)] + [("t", 1, 2), ("t", 500, 500)]
    edges += [("hub", 0, i) for i in range(1, 40)]
    got = connected_components(spark.createDataFrame(edges, "scope string, a int, b int"), ["scope"]).collect()
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for s, a, b in edges:
        if a != b:
            low, high = sorted([find((s, a)), find((s, b))])
            parent[high] = low
    assert {(r.scope, r.node): r.component for r in got} == {k: find(k)[1] for k in list(parent)}
    assert len(got) == len(parent)


def test_running_numbers_of_a_large_group(spark):
    df = spark.range(2000).select((F.col("id") % 3 == 0).cast("int").alias("k"), (F.col("id") * 37 % 2000).alias("x"))
    plain = running_number(df, ["k"], [F.desc("x")], "n")
    spread = running_number(df, ["k"], [F.desc("x")], "n", group_bound=10)
    assert sorted(plain.collect()) == sorted(spread.select(*plain.columns).collect())


def test_top_k_beyond_the_limit_spark_pushes_down(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id").alias("x"))
    got = top_k(df, ["k"], [F.desc("x")], 1500)
    assert sorted(r.x for r in got.collect()) == list(range(3500, 5000))


def test_completeness(spark):
    df = spark.createDataFrame(
        [
            (1, None, "", 0, False, [], {"a": "x", "b": "", "c": "[]", "d": None}),
            (2, "t", "x", None, None, ["y"], None),
        ],
        "id int, title string, text string, n int, f boolean, tags array<string>, m map<string,string>",
    )
    got = dup.completeness(df, ["title", "text", "n", "f", "tags", "m"]).orderBy("id").collect()
    assert [(r.non_empty, r.text_len) for r in got] == [(3, 0), (3, 1)]


def test_suggested_master(spark):
    df = spark.createDataFrame(
        [("c", 1, "t", "long text"), ("c", 2, "t", "text"), ("c", 3, None, "the longest text"), ("d", 4, None, "x"), ("d", 5, None, "y")],
        "cluster string, id int, title string, text string",
    )
    for bound in (1000, 1):
        got = dup.suggest_merge(df, ["cluster"], ["title", "text"], group_bound=bound)
        assert {r.id: r["rank"] for r in got.collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 2}
        assert {r.id for r in got.where("is_master").collect()} == {1, 4}


def test_records_from_json(spark):
    values = ['[{"id": "a", "n": 0, "f": false, "l": [], "x": null}, {"id": "b"}]', "[]", "{}", '{"id": 1}', "nonsense", "[1", None, "3"]
    df = spark.createDataFrame(list(enumerate(values)), "k int, j string")
    got = records_from_json(df, "j").collect()
    assert {(r.k, r.position) for r in got} == {(0, 0), (0, 1)}
    assert got[0].record == {"id": "a", "n": "0", "f": "false", "l": "[]", "x": None}


@pytest.mark.parametrize("bundle", [1, 25])
def test_bundles_of_tiles_equal_brute_force(spark, monkeypatch, bundle):
    """Tiles alone, and several in one bundle, with pairs far apart that titles lift."""
    monkeypatch.setattr(pivots, "BUNDLE_ROWS", bundle)
    for threshold in (0.98, 0.7):
        check(spark, random_items(90, 5, hot=0.33), threshold, tile_rows=7, group_bound=3)


def test_a_tile_may_be_empty(spark, monkeypatch):
    """Rows fall into the parts of a cell by hash, so that a part may stay empty."""
    monkeypatch.setattr(pivots, "BUNDLE_ROWS", 1)
    items = [(i, "Tool", f"t{i}", [1.0, 0.001 * i]) for i in range(40)]
    check(spark, items, 0.9, tile_rows=2)


def test_rows_sent_do_not_grow_with_the_square_over_the_tile(spark):
    rng = np.random.default_rng(3)
    items = [(i, "Tool", f"t{i}", rng.normal(size=5).tolist()) for i in range(500)]
    found = similarity_items(*store(spark, items))
    assert pivots.pivot_tiles(found, ["user_id", "category"], "id", 4, -1.0).count() == 500


def test_stored_pairs_show_their_size(spark):
    """A million equal rows take a few hundred bytes in a compressed file, and would be broadcast."""
    stored = materialize(spark.range(1_000_000).select(F.lit(7).cast("long").alias("a"), F.lit(8).cast("long").alias("b")), "pairs", plain=True)
    other = spark.range(3_000_000).withColumnRenamed("id", "a")
    assert "BroadcastHashJoin" not in other.join(stored, "a")._jdf.queryExecution().executedPlan().toString()
