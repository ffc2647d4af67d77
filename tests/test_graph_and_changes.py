from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from factloom.functions.ids import name_uuid
from factloom.operators import changes as chg
from factloom.operators import graph, listings, merging
from factloom.operators.embedding import embed_text, encode_texts
from factloom.sources import store, tables
from factloom.sources.tables import Snapshot
from factloom.streaming import jobs

DAY = dt.datetime(2024, 1, 1)
FACTS = "user_id string, id int, title string, text string, category string, ts timestamp, updated_at timestamp, metadata map<string,string>, aliases map<string,string>"
EDGES = "user_id string, src int, rel string, dst int, props map<string,string>"
CHANGES = "seq bigint, ts timestamp, user_id string, op string, id int, title string, text string, category string, metadata map<string,string>, src int, dst int, rel string, props map<string,string>"


def fact(i, user="u", title="t", text="x", category="Tool", metadata=None):
    return (user, i, title, text, category, DAY, None, metadata or {}, None)


def change(seq, op, i=None, user="u", **values):
    names = [part.split()[0] for part in CHANGES.split(", ")][4:]
    values = {"id": i, **values}
    return (seq, DAY + dt.timedelta(days=seq), user, op, *[values.get(n) for n in names])


def edges_of(df):
    return sorted((r.user_id, r.src, r.rel, r.dst) for r in df.collect())


@pytest.fixture(scope="module")
def small(spark):
    facts = spark.createDataFrame(
        [fact(1, metadata={"a": "1", "b": "1"}), fact(2), fact(3, category="People"), fact(4, category=None), fact(9, user="v")], FACTS
    )
    edges = spark.createDataFrame(
        [("u", 1, "R", 2, {"p": "1"}), ("u", 2, "R", 3, {}), ("u", 3, "IN_CATEGORY", 1, {}), ("u", 1, "R", 9, {})], EDGES
    )
    vectors = spark.createDataFrame(
        [("u", i, "Tool", [1.0, float(i)]) for i in (1, 2, 3)], "user_id string, id int, category string, embedding array<float>"
    )
    mentions = spark.createDataFrame([("u", 70, 1), ("u", 70, 2), ("u", 71, 2)], "user_id string, diary_id int, fact_id int")
    return Snapshot(facts=facts, edges=edges, vectors=vectors, mentions=mentions)


def test_paths_in_a_multigraph(spark):
    edges = spark.createDataFrame(
        [("u", 1, "R", 2, "a"), ("u", 2, "R", 3, "b"), ("u", 3, "R", 1, "c"), ("u", 1, "R", 2, "d")],
        "user_id string, src int, rel string, dst int, edge_id string",
    )
    seeds = spark.createDataFrame([("u", 1)], "user_id string, seed int")
    got = {(r.depth, r.id, r.paths) for r in graph.neighborhood_paths(edges, seeds, 3).collect()}
    assert got == {(1, 2, 2), (1, 3, 1), (2, 1, 2), (2, 2, 1), (2, 3, 2), (3, 1, 4), (3, 3, 2)}
    near = {(r.id, r.min_depth) for r in graph.neighborhood_distinct(edges, seeds, 3).collect()}
    assert near == {(2, 1), (3, 1)}


def listed_paths(edges, seeds, depth):
    """Every path, edge by edge."""
    found = Counter()
    for seed in seeds:
        front = [(seed, ())]
        for length in range(1, depth + 1):
            front = [
                (dst if node == src else src, (*used, i))
                for node, used in front
                for i, (src, dst) in enumerate(edges)
                if node in (src, dst) and i not in used
            ]
            found.update((seed, node, length) for node, _ in front)
    return dict(found)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_counted_paths_equal_listed_ones(spark, seed):
    """Random multigraphs with loops, parallel edges and a hub."""
    rng = random.Random(seed)
    edges = [(rng.randrange(5), rng.randrange(5)) for _ in range(9)] + [(0, rng.randrange(5)) for _ in range(4)] + [(3, 3), (3, 3), (6, 6)]
    df = spark.createDataFrame([("u", a, "R", b, i) for i, (a, b) in enumerate(edges)], "user_id string, src int, rel string, dst int, edge_id int")
    seeds = spark.createDataFrame([("u", i) for i in range(8)], "user_id string, seed int")
    for depth in (1, 2, 3, 4):
        got = {(r.seed, r.id, r.depth): r.paths for r in graph.neighborhood_paths(df, seeds, depth).collect()}
        assert got == listed_paths(edges, range(8), depth)


def test_neighborhood_options(spark):
    edges = spark.createDataFrame([("u", 1, "A", 2), ("u", 2, "B", 3), ("u", 3, "A", 3)], "user_id string, src int, rel string, dst int")
    seeds = spark.createDataFrame([("u", 1), ("u", 3)], "user_id string, seed int")
    got = {(r.seed, r.id, r.depth) for r in graph.neighborhood_paths(edges, seeds, 2, rel_types=["a"]).collect()}
    assert got == {(1, 2, 1), (3, 3, 1)}
    chain = {(r.id, r.min_depth) for r in graph.neighborhood_distinct(edges, seeds.where("seed = 1"), 4).collect()}
    assert chain == {(2, 1), (3, 2)}
    with pytest.raises(ValueError):
        graph.neighborhood_paths(edges, seeds, 0)


def test_typed_graph_reaches_facts_over_hubs(spark, small):
    diary = spark.createDataFrame([("u", 70), ("u", 71)], "user_id string, id int")
    typed = graph.typed_graph(small.facts, small.edges.limit(0), diary, small.mentions)
    assert Counter(r.rel for r in typed.collect()) == {"KNOWS": 5, "IN_CATEGORY": 4, "WROTE_DIARY": 2, "MENTIONS": 3}
    seeds = spark.createDataFrame([("f:1",)], "seed string")
    found = graph.neighborhood_paths(typed, seeds, 2, scope=())
    own = graph.owned_facts(found, small.facts)
    got = {(r.id, r.paths) for r in own.collect()}
    # Over the user: 2, 3, 4; over the category: 2 (9 belongs to another user); over entry 70: 2.
    assert got == {("f:2", 3), ("f:3", 1), ("f:4", 1)}


def test_patterns_count_both_directions(spark, small):
    got = graph.find_patterns(small.facts, small.edges.where("rel = 'R'")).collect()
    assert {(r.cat1, r.cat2, r.weight, r["rank"]) for r in got} == {("People", "Tool", 1, 1), ("Tool", "People", 1, 2)}


def test_listings(spark, small):
    listed = listings.list_facts(small.facts, small.edges, ordered=True).collect()
    assert [(r.id, r.rel, r.target_id) for r in listed] == [
        (3, None, None), (1, "R", 2), (2, "R", 3), (9, None, None)
    ]
    assert [tuple(r) for r in listings.list_categories(small.facts, ordered=True).collect()] == [
        ("u", "People"), ("u", "Tool"), ("v", "Tool")
    ]
    diary = spark.createDataFrame(
        [("u", 70, "d1", DAY), ("u", 72, "d2", DAY)], "user_id string, id int, date string, ts timestamp"
    )
    got = listings.list_diary(diary, small.mentions, small.facts, ordered=True).collect()
    assert [(r.id, r.fact_id, r.fact_text) for r in got] == [(72, None, None), (70, 1, "x"), (70, 2, "x")]


def test_graph_export(spark, small, tmp_path):
    facts = small.facts.unionByName(spark.createDataFrame([fact(5, title="", text="only text")], FACTS))
    nodes = {(r.user_id, r.id): (r.label, r.title, r.grp) for r in graph.graph_nodes(facts).collect()}
    assert nodes["u", "5"] == ("Fact", "only text", "Tool")
    assert nodes["u", "4"] == ("Fact", "t", "General")
    assert nodes["u", "People"] == ("Category", "People", "CategoryNode")
    edges = graph.graph_edges(facts, small.edges)
    assert ("u", "1", "9", "R") not in {(r.user_id, r.from_id, r.to_id, r.label) for r in edges.collect()}
    tables.write_graph(graph.graph_nodes(facts), edges, f"{tmp_path}/graph")
    assert spark.read.json(f"{tmp_path}/graph/edges").count() == edges.count()


def log(spark, *rows):
    return spark.createDataFrame(list(rows), CHANGES)


def test_updates(spark, small):
    changes = log(
        spark,
        change(1, "update", 1, title="new", metadata={"b": "2", "c": "3"}),
        change(2, "update", 1, text="y", category=""),
        change(3, "update", 2, category=" pEOPLE "),
        change(4, "update", 1, user="v", title="stranger"),
        change(5, "update", 77, title="nobody"),
        change(6, "update", 1, title="newer"),
    )
    got = {(r.user_id, r.id): r for r in chg.apply_changes(small, changes).facts.collect()}
    assert len(got) == 5
    one = got["u", 1]
    assert (one.title, one.text, one.category) == ("newer", "y", "Tool")
    assert one.metadata == {"a": "1", "b": "2", "c": "3"} and one.updated_at.day == 7
    assert (got["u", 2].category, got["u", 2].title, got["u", 3].updated_at) == ("People", "t", None)


def test_delete_detaches_and_respects_the_tenant(spark, small):
    changes = log(spark, change(1, "delete", 2), change(2, "delete", 1, user="v"), change(3, "update", 2, title="late"))
    after = chg.apply_changes(small, changes)
    assert sorted(r.id for r in after.facts.collect()) == [1, 3, 4, 9]
    assert edges_of(after.edges) == [("u", 1, "R", 9), ("u", 3, "IN_CATEGORY", 1)]
    assert sorted(r.id for r in after.vectors.collect()) == [1, 3]
    assert [(r.diary_id, r.fact_id) for r in after.mentions.collect()] == [(70, 1)]


def test_add_and_add_again(spark, small):
    changes = log(
        spark,
        change(1, "add", 50, title="n", text="z", category=" gENERAL "),
        change(2, "update", 50, metadata={"k": "v"}),
        change(3, "add", 51, text="short life", category="a"),
        change(4, "delete", 51),
        change(5, "delete", 3),
        change(6, "update", 3, title="no effect"),
        change(7, "add", 3, text="again", category="a"),
    )
    got = {r.id: r for r in chg.apply_changes(small, changes).facts.collect()}
    assert set(got) == {1, 2, 3, 4, 9, 50}
    assert (got[50].category, got[50].metadata, got[50].title) == ("General", {"k": "v"}, "n")
    assert (got[3].title, got[3].text, got[3].category) == (None, "again", "A")


def test_links(spark, small):
    changes = log(
        spark,
        change(1, "link", src=1, dst=2, rel="r", props={"p": "2", "q": "1"}),
        change(2, "link", src=1, dst=3, rel="works on", props={"a": "1"}),
        change(3, "link", src=1, dst=3, rel="WORKS ON", props={"a": "2", "b": "1"}),
        change(4, "link", src=1, dst=9, rel="other tenant"),
        change(5, "link", src=1, dst=60, rel="too early"),
        change(6, "add", 60, text="x", category="a"),
        change(7, "link", src=60, dst=1, rel="fine"),
        change(8, "link", src=1, dst=4, rel="doomed"),
        change(9, "delete", 4),
    )
    after = {(r.src, r.rel, r.dst): r.props for r in chg.apply_changes(small, changes).edges.collect()}
    assert after[1, "R", 2] == {"p": "2", "q": "1"}
    assert after[1, "WORKS_ON", 3] == {"a": "2", "b": "1"}
    assert after[60, "FINE", 1] == {}
    assert set(after) == {(1, "R", 2), (2, "R", 3), (3, "IN_CATEGORY", 1), (1, "R", 9), (1, "WORKS_ON", 3), (60, "FINE", 1)}


def test_one_batch_equals_two(spark, small):
    rows = [
        change(1, "add", 50, text="a", category="c"), change(2, "link", src=50, dst=1, rel="x"),
        change(3, "update", 1, title="A", metadata={"m": "1"}), change(4, "delete", 2),
        change(5, "update", 50, title="B"), change(6, "link", src=1, dst=3, rel="y", props={"k": "1"}),
        change(7, "delete", 50), change(8, "update", 1, metadata={"m": "2"}), change(9, "link", src=1, dst=2, rel="dead end"),
    ]
    whole = chg.apply_changes(small, log(spark, *rows))
    split = chg.apply_changes(chg.apply_changes(small, log(spark, *rows[:5])), log(spark, *rows[5:]))
    as_text = lambda df: sorted(str(r.asDict(recursive=True)) for r in df.collect())
    assert as_text(whole.facts) == as_text(split.facts)
    assert as_text(whole.edges) == as_text(split.edges)


def test_only_changed_texts_are_embedded_again(spark, small):
    seen = spark.sparkContext.accumulator(0)

    def embed(df):
        def encode(texts):
            seen.add(len(texts))
            return [[0.5, 0.5]] * len(texts)

        return encode_texts(df, "text", encode).select("user_id", "id", "embedding")

    changes = log(
        spark, change(1, "update", 1, title="n"), change(2, "update", 2, category="new"), change(3, "add", 50, text="x", category="c")
    )
    got = {r.id: (r.category, list(r.embedding)) for r in chg.apply_changes(small, changes, embed).vectors.collect()}
    assert got == {1: ("Tool", [0.5, 0.5]), 2: ("New", [1.0, 2.0]), 3: ("Tool", [1.0, 3.0]), 50: ("C", [0.5, 0.5])}
    assert seen.value == 2


@pytest.fixture(scope="module")
def merging_case(spark):
    facts = spark.createDataFrame(
        [fact(1, metadata={"k": "1", "l": "x", "text": "core"}), fact(2, metadata={"k": "2"}), fact(3, metadata={"k": "1", "m": "y"}), fact(8), fact(9, user="v")],
        FACTS,
    )
    edges = spark.createDataFrame(
        [
            ("u", 1, "R", 8, {"of": "master"}), ("u", 2, "R", 8, {"of": "two"}), ("u", 2, "S", 8, {"of": "two"}), ("u", 3, "S", 8, {"of": "three"}),
            ("u", 1, "R", 2, {}), ("u", 2, "R", 3, {}), ("u", 8, "T", 3, {}), ("u", 1, "LOOP", 1, {}), ("u", 3, "LOOP", 3, {}), ("u", 8, "U", 8, {}),
        ],
        EDGES,
    )
    mentions = spark.createDataFrame([("u", 70, 2), ("u", 70, 1), ("u", 71, 3)], "user_id string, diary_id int, fact_id int")
    vectors = spark.createDataFrame([("u", i, "Tool", [1.0]) for i in (1, 2, 3, 8)], "user_id string, id int, category string, embedding array<float>")
    return Snapshot(facts=facts, edges=edges, vectors=vectors, mentions=mentions)


MERGES = "user_id string, master_id int, dup_id int, title string, text string"


def test_merge(spark, merging_case):
    merges = spark.createDataFrame(
        [("u", 1, 2, "T", None), ("u", 1, 3, "T", None), ("v", 1, 8, None, None), ("u", 404, 8, None, None), ("u", 1, 404, None, None)], MERGES
    )
    after, properties = merging.merge_facts(merging_case, merges, ts=DAY)
    facts = {r.id: r for r in after.facts.collect()}
    assert set(facts) == {1, 8, 9} and (facts[1].title, facts[1].text, facts[1].updated_at) == ("T", "x", DAY)
    got = {(r.src, r.rel, r.dst): r.props for r in after.edges.collect()}
    assert set(got) == {(1, "R", 8), (1, "S", 8), (8, "T", 1), (1, "LOOP", 1), (8, "U", 8)}
    assert got[1, "R", 8] == {"of": "master"} and got[1, "S", 8] == {"of": "two"}
    assert sorted((r.diary_id, r.fact_id) for r in after.mentions.collect()) == [(70, 1), (71, 1)]
    # The vector of the old title is gone; it has to be made anew.
    assert sorted(r.id for r in after.vectors.collect()) == [8]
    assert facts[1].metadata == {"k": "1", "l": "x", "m": "y", "text": "core"}
    assert sorted((r.id, r.key, r.value) for r in properties.collect()) == [(1, "k", "1"), (1, "k", "2"), (1, "l", "x"), (1, "m", "y")]


def test_merged_aliases_keep_the_highest_confidence(spark, merging_case):
    known = {1: {"ada": "0.4"}, 2: {"ada": "0.9", "lace": "high"}, 8: {"own": "1"}}
    column = F.create_map(*[x for i, m in known.items() for x in (F.lit(i), F.create_map(*[F.lit(v) for e in m.items() for v in e]))])
    facts = merging_case.facts.drop("aliases").withColumn("aliases", column[F.col("id")])
    merges = spark.createDataFrame([("u", 1, 2, None, None)], MERGES)
    after, _ = merging.merge_facts(replace(merging_case, facts=facts), merges)
    got = {r.id: r.aliases for r in after.facts.collect()}
    assert got[1] == {"ada": "0.9", "lace": "high"} and got[8] == {"own": "1"}


def test_chained_merges_end_in_the_last_master(spark, merging_case):
    merges = spark.createDataFrame([("u", 2, 3, None, None), ("u", 8, 2, None, "B"), ("u", 8, 1, None, None)], MERGES)
    after, properties = merging.merge_facts(merging_case, merges)
    facts = {(r.user_id, r.id): r.text for r in after.facts.collect()}
    assert set(facts) == {("u", 8), ("v", 9)} and facts["u", 8] == "B"
    assert {(r.src, r.dst) for r in after.edges.collect()} == {(8, 8)}
    assert {r.fact_id for r in after.mentions.collect()} == {8}
    assert {r.id for r in properties.collect()} == {8}


@pytest.mark.parametrize("rows", [[(1, 3), (2, 3)], [(1, 2), (2, 1)]])
def test_merges_that_contradict_are_refused(spark, merging_case, rows):
    merges = spark.createDataFrame([("u", m, d, None, None) for m, d in rows], MERGES)
    with pytest.raises(ValueError, match="master|circle"):
        merging.merge_facts(merging_case, merges)


def test_merge_without_a_master_changes_nothing(spark, merging_case):
    merges = spark.createDataFrame([("u", 404, 2, None, None)], MERGES)
    after, properties = merging.merge_facts(merging_case, merges)
    assert after.facts.count() == 5 and edges_of(after.edges) == edges_of(merging_case.edges)
    assert properties.count() == 0


def test_save_diary(spark):
    facts = spark.createDataFrame([("u", 1, "People", "Kate", None)], "user_id string, id int, category string, text string, aliases map<string,string>")
    old = spark.createDataFrame([], "user_id string, id string, date date, content string, ts timestamp")
    new = spark.createDataFrame([("u", "a", None, "met kate", DAY), ("u", "b", dt.date(2023, 5, 5), "alone", DAY)], "user_id string, id string, date date, content string, ts timestamp")
    diary, mentions = chg.save_diary(old, new, facts)
    assert {(r.id, str(r.date)) for r in diary.collect()} == {("a", "2024-01-01"), ("b", "2023-05-05")}
    assert [(r.diary_id, r.fact_id) for r in mentions.collect()] == [("a", 1)]


def test_snapshots_are_stored_and_read(spark, small, tmp_path):
    tables.write_snapshot(small, f"{tmp_path}/v0")
    again = tables.read_snapshot(spark, f"{tmp_path}/v0")
    assert edges_of(again.edges) == edges_of(small.edges) and again.facts.count() == 5
    with pytest.raises(Exception, match="already exists"):
        tables.write_snapshot(small, f"{tmp_path}/v0")
    wanted = spark.createDataFrame([("u", 1), ("u", 1), ("v", 2)], "user_id string, id int")
    assert [r.id for r in tables.facts_with_ids(small.facts, wanted).collect()] == [1]


def test_embeddings(spark):
    df = spark.createDataFrame([(1, "a b a", None), (2, "", None), (3, "b", "a")], "id int, text string, title string")
    got = {r.id: r.embedding for r in embed_text(df, title="title", dims=8).collect()}
    again = {r.id: r.embedding for r in embed_text(df.repartition(3), title="title", dims=8).collect()}
    assert got == again and all(len(v) == 8 for v in got.values())
    assert sum(x * x for x in got[1]) == pytest.approx(1.0) and not any(got[2])
    custom = embed_text(df, encoder=lambda texts: [[float(len(t))] for t in texts])
    assert [r.embedding for r in custom.orderBy("id").collect()] == [[5.0], [0.0], [1.0]]


def test_streamed_changes_in_two_batches(spark, small, tmp_path):
    rows = [change(1, "update", 1, title="A"), change(2, "link", src=1, dst=3, rel="y")], [change(3, "delete", 2), change(4, "update", 1, text="B")]
    whole = chg.apply_changes(replace(small, vectors=None, mentions=None), log(spark, *rows[0], *rows[1]))
    source, root = f"{tmp_path}/log", f"{tmp_path}/store"
    store.create_store(Snapshot(facts=small.facts, edges=small.edges), root)
    for part in rows:
        log(spark, *part).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.file_stream(spark, source, spark.read.parquet(source).schema)
        jobs.stream_changes(stream, root, f"{tmp_path}/progress").awaitTermination()
    latest = store.read_store(spark, root)
    assert edges_of(latest.edges) == edges_of(whole.edges)
    assert sorted((r.id, r.title, r.text) for r in latest.facts.collect()) == sorted((r.id, r.title, r.text) for r in whole.facts.collect())


def test_events_delivered_twice_are_checked_once(spark, tmp_path):
    facts = spark.createDataFrame([("u", 1, "Tool", "A b"), ("u", 2, "Tool", "a B ")], "user_id string, id int, category string, title string")
    vectors = spark.createDataFrame([("u", 1, [1.0, 0.0]), ("u", 2, [0.0, 1.0])], "user_id string, id int, embedding array<float>")
    schema = "event_id int, ts timestamp, user_id string, id int, category string, title string, embedding array<float>"
    rows = [(e, DAY, "u", 100 + e, "Tool", t, [1.0, 0.0]) for e, t in ((1, "a b"), (1, "a b"), (2, "c"), (3, "z"))]
    rows[3] = (*rows[3][:6], [0.0, -1.0])
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    stream = jobs.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    jobs.stream_duplicates(stream, facts, vectors, f"{tmp_path}/out", f"{tmp_path}/p", 0.9).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.id, r.partners, r.best_similarity) for r in got) == [(101, 2, 1.0), (102, 1, 1.0)]


def test_late_events_are_checked(spark, tmp_path):
    """The second run brings an older event, one that was seen, and a new one."""
    facts = spark.createDataFrame([("u", 1, "Tool", "A b")], "user_id string, id int, category string, title string")
    vectors = spark.createDataFrame([("u", 1, [1.0, 0.0])], "user_id string, id int, embedding array<float>")
    schema = "event_id int, ts timestamp, user_id string, id int, category string, title string, embedding array<float>"
    parts = [[(1, 20)], [(2, 1), (1, 20), (3, 21)]]
    for events in parts:
        rows = [(e, dt.datetime(2024, 1, day), "u", 100 + e, "Tool", "a b", [1.0, 0.0]) for e, day in events]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.file_stream(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
        jobs.stream_duplicates(stream, facts, vectors, f"{tmp_path}/out", f"{tmp_path}/p", 0.9).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.id, r.batch) for r in got) == [(101, 0), (102, 1), (103, 1)]


def test_streamed_changes_carry_all_tables(spark, merging_case, tmp_path):
    root, source = f"{tmp_path}/store", f"{tmp_path}/log"
    store.create_store(merging_case, root)
    log(spark, change(1, "delete", 2)).coalesce(1).write.parquet(source)
    stream = jobs.file_stream(spark, source, spark.read.parquet(source).schema)
    jobs.stream_changes(stream, root, f"{tmp_path}/progress").awaitTermination()
    latest = store.read_store(spark, root)
    assert sorted(r.id for r in latest.vectors.collect()) == [1, 3, 8]
    assert sorted((r.diary_id, r.fact_id) for r in latest.mentions.collect()) == [(70, 1), (71, 3)]


def test_assigned_ids_stay(spark):
    rows = chg.assign_ids(spark.range(50).select(F.col("id").alias("n")))
    assert sorted(rows.collect()) == sorted(rows.collect())
    assert rows.select("id").distinct().count() == 50


def test_new_ids_can_come_from_names(spark):
    ids = spark.range(3).select(name_uuid(F.col("id").cast("string"))).distinct().count()
    assert ids == 3


@pytest.mark.parametrize("kind", ["folder", "file"])
def test_a_stream_of_a_folder_or_a_file(spark, tmp_path, kind):
    """A table is a file or a folder of files; files beside it do not belong to it."""
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/written")
    (part,) = (tmp_path / "written").glob("part-*.parquet")
    (tmp_path / "data").mkdir()
    place = tmp_path / "data" / "table.parquet"
    if kind == "folder":
        place.mkdir()
    for target in (place / "part-0.parquet" if kind == "folder" else place, tmp_path / "data" / "other.parquet"):
        target.write_bytes(part.read_bytes())
    stream = jobs.file_stream(spark, str(place), spark.read.parquet(str(place)).schema)
    got = []
    jobs._start(stream, lambda batch, _: got.extend(r.id for r in batch.collect()), f"{tmp_path}/p").awaitTermination()
    assert sorted(got) == [0, 1, 2]
