from __future__ import annotations

import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions.vectors import cosine
from factloom.operators import search, vector_index
from factloom.operators.bloom import bloom_of, mixed
from factloom.operators.mentions import link_mentions
from factloom.operators import nearest as nearest_module
from factloom.operators.nearest import _QueryBlock, nearest, unit_rows
from factloom.operators.substring import substring_matches
from factloom.plans.sample import Sample
from tests.conftest import SMALL

FACTS = "user_id string, id int, title string, text string, category string, aliases map<string,string>"
QUERIES = "query_id int, user_id string, query string, category string"


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame(
        [
            ("u", 1, "Abc", "nothing", "A", None),
            ("u", 2, "xabcx", "nothing", "B", None),
            ("u", 3, "none", "has abc inside", "A", None),
            ("u", 4, None, "has abcd inside", "B", None),
            ("v", 5, "Abc", "abc", "A", None),
        ],
        FACTS,
    )


def test_short_queries_look_at_titles_only(spark, few):
    asked = spark.createDataFrame([(1, "u", "aBc", None), (2, "u", "abcd", None)], QUERIES)
    got = rows(search.exact_matches(few, asked), "query_id", "id", "score", "rank")
    assert got == [(1, 1, 2.0, 1), (1, 2, 1.5, 2), (2, 4, 1.0, 1)]


def test_category_filter_and_the_option_to_ignore_it_for_titles(spark, few):
    more = few.unionByName(
        spark.createDataFrame([("u", 6, "long abcd", "abcd", "B", None), ("u", 7, "x", "abcd", "A", None)], FACTS)
    )
    asked = spark.createDataFrame([(1, "u", "abcd", "A"), (2, "u", "abc", "B")], QUERIES)
    assert rows(search.exact_matches(more, asked), "query_id", "id") == [(1, 7), (2, 2), (2, 6)]
    loose = search.exact_matches(more, asked, title_ignores_category=True)
    assert rows(loose, "query_id", "id") == [(1, 6), (1, 7), (2, 2), (2, 6)]


def test_limit_is_by_score_then_id(spark, few):
    asked = spark.createDataFrame([(1, "u", "abc", None), (2, "u", "abc", None)], QUERIES)
    assert rows(search.exact_matches(few, asked, limit=1), "query_id", "id") == [(1, 1), (2, 1)]
    assert len(search.exact_matches(few, asked, limit=None).collect()) == 4


def test_alias_boost(spark):
    df = spark.createDataFrame(
        [
            ("tim", {"Tim": "0.8"}),
            ("tim", {"Tim Marsh": "0.8", "T": "x"}),
            ("tim", {"": "1.0"}),
            ("tim", {"Tim": "high", "im": "0.4"}),
            ("tim", None),
        ],
        "q string, aliases map<string,string>",
    )
    got = [r[0] for r in df.select(search.alias_boost(F.col("q"), F.col("aliases"))).collect()]
    assert got == pytest.approx([0.16, 0.04, 0.05, 0.02, 0.0])


def test_title_boost(spark):
    df = spark.createDataFrame(
        [("abc", "abc"), ("abc", "xabc"), ("abcd", "abc"), ("abc", "x"), ("abc", ""), ("abc", None)], "q string, t string"
    )
    got = [r[0] for r in df.select(search.title_boost(F.col("q"), F.col("t"))).collect()]
    assert got == [0.5, 0.2, 0.2, 0.0, 0.0, 0.0]


def test_threshold_is_on_the_raw_cosine_and_boosts_come_after(spark):
    facts = spark.createDataFrame(
        [("u", 1, "abc", "t", "A", None), ("u", 2, "other", "t", "A", {"abc": "1"}), ("u", 3, "abc", "t", "A", None)], FACTS
    )
    vectors = spark.createDataFrame(
        [("u", 1, "A", [1.0, 0.0]), ("u", 2, "A", [0.8, 0.6]), ("u", 3, "A", [0.0, 1.0])],
        "user_id string, id int, category string, embedding array<float>",
    )
    asked = spark.createDataFrame([(1, "u", "zabc", [1.0, 0.0], None)], "query_id int, user_id string, query string, vec array<float>, category string")
    got = search.search_facts(facts, vectors, asked, limit=5, top_p=0.4)
    scores = {r.id: (round(r.score, 6), r["rank"]) for r in got.collect()}
    # 3 has the best title but no cosine; 2 gains from a partial alias match.
    assert scores == {1: (1.2, 1), 2: (0.85, 2)}


def test_a_list_of_aliases_gives_no_boost(spark):
    facts = spark.createDataFrame([("u", 1, "x", ["abc"])], "user_id string, id int, title string, aliases array<string>")
    hits = spark.createDataFrame([(1, 1, 0.5)], "query_id int, id int, score double")
    asked = spark.createDataFrame([(1, "u", "abc")], "query_id int, user_id string, query string")
    assert rows(search.boosted_hits(hits, facts, asked), "score") == [(0.5,)]
    assert rows(search.boosted_hits(hits, facts.drop("aliases"), asked), "score") == [(0.5,)]


def random_vectors(spark, n, seed, users=2):
    rng = np.random.default_rng(seed)
    data = [(f"u{i % users}", i, "AB"[i % 3 % 2], [float(x) for x in rng.normal(size=8)]) for i in range(n)]
    return spark.createDataFrame(data, "user_id string, id int, category string, embedding array<float>")


def test_nearest_tiled_equals_scanned_equals_brute_force(spark):
    vectors = random_vectors(spark, 300, 1)
    asked = random_vectors(spark, 60, 2).select(
        F.col("id").alias("query_id"), "user_id", F.col("embedding").alias("vec"), F.when(F.col("id") % 2 == 0, F.col("category")).alias("category")
    )
    scanned = nearest(vectors, asked, 7, 0.2)
    tiled = nearest(vectors, asked, 7, 0.2, broadcast_rows=5, tile_rows=20)
    fields = ("query_id", "id", "score", "rank")
    assert rows(scanned, *fields) == rows(tiled, *fields)

    v = vectors.withColumnRenamed("category", "c")
    pairs = asked.join(v, "user_id").where(F.col("category").isNull() | (F.col("category") == F.col("c")))
    pairs = pairs.select("query_id", "id", cosine("vec", "embedding").alias("s")).where("s >= 0.2").toPandas()
    pairs = pairs.sort_values(["query_id", "s", "id"], ascending=[True, False, True]).groupby("query_id").head(7)
    assert rows(scanned, "query_id", "id") == sorted(zip(pairs.query_id, pairs.id))


@pytest.mark.parametrize("tile", [1, 8192])
def test_nearest_scores_copies_once(spark, monkeypatch, tile):
    """Classes of equal vectors and queries give the hits that single rows give, in the order of scores and ids."""
    monkeypatch.setattr(nearest_module, "LEAST_TILE", tile)
    few = random_vectors(spark, 12, 1)
    vectors = few.crossJoin(spark.range(9).select(F.col("id").alias("n"))).withColumn("id", F.col("id") + 100 * F.col("n")).drop("n")
    asked = vectors.select(
        F.col("id").alias("query_id"), "user_id", F.col("embedding").alias("vec"), F.when(F.col("id") % 2 == 0, F.col("category")).alias("category")
    )
    scored = []
    real = nearest_module._tiled
    monkeypatch.setattr(nearest_module, "_tiled", lambda v, q, *rest: scored.append((v.count(), q.count())) or real(v, q, *rest))
    fields = ("query_id", "id", "score", "rank")
    tiled = rows(nearest(vectors, asked, 7, 0.1, broadcast_rows=5, tile_rows=4), *fields)
    assert tiled == rows(nearest(vectors, asked, 7, 0.1), *fields)
    assert scored == [(12, 12)]


def test_facts_are_not_broadcast_by_the_size_of_their_files(spark, few):
    """Facts take little room in files and much in memory: their joins do not depend on the size of files."""
    asked = spark.createDataFrame([(1, "u", "abc", None)], QUERIES)
    hits = spark.createDataFrame([(1, 2, 0.5)], "query_id int, id int, score double")
    plan = search.boosted_hits(hits, few, asked)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [user_id" in plan
    sample = Sample(spark, SMALL)
    for frame in (sample.vectors(), sample.queries()):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()


def test_nearest_keeps_equal_vectors_in_id_order(spark):
    vectors = spark.createDataFrame([("u", i, "A", [0.1, 0.7, 0.2]) for i in range(500)], "user_id string, id int, category string, embedding array<float>")
    asked = spark.createDataFrame([(1, "u", [0.3, 0.7, 0.1], None)], "query_id int, user_id string, vec array<float>, category string")
    assert rows(nearest(vectors.repartition(7), asked, 5, 0.1), "id") == [(i,) for i in range(5)]


def clustered(spark, n, seed, spread):
    rng = np.random.default_rng(seed)
    data = [("uv"[i % 7 == 0], i, "AB"[i % 2], (np.eye(10)[i % 10] + spread * rng.normal(size=10)).tolist()) for i in range(n)]
    data += [("u", n, "A", [0.0] * 10), ("w", n + 1, "A", [1.0] + [0.0] * 9)]
    return spark.createDataFrame(data, "user_id string, id int, category string, embedding array<float>")


@pytest.mark.parametrize("least", [0.2, -1.0])
def test_index_equals_scan(spark, tmp_path, least):
    vectors, asked = clustered(spark, 700, 1, 0.3), clustered(spark, 90, 2, 0.4)
    asked = asked.select(
        F.col("id").alias("query_id"), "user_id", F.col("embedding").alias("vec"), F.when(F.col("id") % 3 == 0, F.col("category")).alias("category")
    )
    path = f"{tmp_path}/index"
    vector_index.build_index(vectors, path, list_rows=60)
    fields = ("query_id", "id", "score", "rank")
    assert rows(vector_index.search_index(spark, path, asked, 6, least), *fields) == rows(nearest(vectors, asked, 6, least), *fields)
    with pytest.raises(Exception, match="already exists"):
        vector_index.build_index(vectors, path)


def test_index_reads_few_lists(spark, tmp_path, monkeypatch):
    """In tight clusters most lists are ruled out; fewer probes lose hits, and that is measured."""
    vectors = clustered(spark, 1500, 3, 0.03)
    asked = vectors.where("id < 100").select(F.col("id").alias("query_id"), "user_id", F.col("embedding").alias("vec"), F.lit(None).cast("string").alias("category"))
    path = f"{tmp_path}/index"
    vector_index.build_index(vectors, path, list_rows=100)
    probed, scored = [], vector_index._scored
    monkeypatch.setattr(vector_index, "_scored", lambda lists, queries, probes, *rest: probed.append(probes.count()) or scored(lists, queries, probes, *rest))
    vector_index.search_index(spark, path, asked, 5, 0.5).collect()
    n_lists = spark.read.parquet(f"{path}/centroids").where("user_id = 'u'").count()
    assert n_lists > 8 and sum(probed) < 0.5 * 85 * n_lists
    assert vector_index.index_recall(spark, path, asked, 5, 0.5, probes=n_lists) == 1.0
    assert 0.2 < vector_index.index_recall(spark, path, asked, 150, 0.5, probes=1) < 1.0


@pytest.mark.parametrize("most_bits", [1 << 29, 1])
def test_substrings_equal_brute_force(spark, most_bits):
    """With the filter as it is, and with one so small that it lets nearly everything through."""
    rng = np.random.default_rng(5)
    letters = list("ab é😀")

    def word(low, high):
        return "".join(rng.choice(letters, size=rng.integers(low, high)))

    texts = [("u%d" % (i % 2), i, word(0, 60)) for i in range(80)] + [("u0", 900, "x" * 40), ("u1", 901, "")]
    patterns = [("u%d" % (i % 2), word(0, 20)) for i in range(120)] + [("u0", ""), ("u0", "x" * 17), ("u0", "x" * 16)]
    left = spark.createDataFrame(texts, "user_id string, id int, text string")
    right = spark.createDataFrame(patterns, "user_id string, pattern string")
    got = rows(substring_matches(left, right, ["user_id"], ["id"], most_bits=most_bits), "user_id", "id", "pattern")
    want = sorted({(u, i, p) for u, i, t in texts for w, p in patterns if u == w and p in t})
    assert got == want


def test_texts_stay_where_they_are(spark):
    """Few candidates: no exchange holds a text. The plan is the same whatever the number of anchors."""
    texts = spark.range(3000).select(F.lit("u").alias("user_id"), "id", F.concat_ws(" ", F.lit("a long text about item"), "id").alias("text"))
    plans = []
    for n in (1, 2000):
        patterns = spark.range(n).select(F.lit("u").alias("user_id"), F.concat_ws(" ", F.lit("item"), F.col("id") + 500).alias("pattern"))
        found = substring_matches(texts, patterns, ["user_id"], ["id"])
        assert found.count() >= n
        plans.append(found._jdf.queryExecution().executedPlan().toString())
    for plan in plans:
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert re.sub(r"\d+|candidates-\w+", "", plans[0]).split("Location")[0] == re.sub(r"\d+|candidates-\w+", "", plans[1]).split("Location")[0]


def test_a_filter_refuses_no_member(spark):
    rng = np.random.default_rng(3)
    members = [(int(a), int(b)) for a, b in rng.integers(-(2**62), 2**62, size=(5000, 2))]
    bloom = bloom_of(spark.createDataFrame(members, "a long, b long").repartition(3), ["a", "b"])
    a, b = np.array(members).T
    assert bloom.has(mixed(a, b)).all()
    assert bloom.has(mixed(b, a)).mean() < 0.05


def test_mentions_by_text_and_alias(spark):
    facts = spark.createDataFrame(
        [
            ("u", 1, "People", "Ivo Marsh", {"Ivory": "1"}),
            ("u", 2, "Client", "SAP", None),
            ("u", 3, "Tool", "spark", None),
            ("v", 4, "People", "Ivo Marsh", None),
        ],
        "user_id string, id int, category string, text string, aliases map<string,string>",
    )
    diary = spark.createDataFrame(
        [("u", 10, "met ivory and IVO MARSH at wsapx"), ("u", 11, "spark only")], "user_id string, id int, content string"
    )
    assert rows(link_mentions(diary, facts), "diary_id", "fact_id") == [(10, 1), (10, 2)]
    listed = facts.withColumn("aliases", F.map_keys("aliases"))
    assert rows(link_mentions(diary, listed), "diary_id", "fact_id") == [(10, 1), (10, 2)]
    assert rows(link_mentions(diary, facts, categories=None), "diary_id", "fact_id") == [(10, 1), (10, 2), (11, 3)]


def test_diary_hits_show_the_mentions_of_their_day(spark):
    diary = spark.createDataFrame([("u", 1, "d1", "x"), ("u", 2, "d1", "y"), ("u", 3, "d2", "z")], "user_id string, id int, date string, content string")
    vectors = spark.createDataFrame([("u", 1, [1.0, 0.0]), ("u", 2, [0.0, 1.0]), ("u", 3, [0.9, 0.1])], "user_id string, id int, embedding array<float>")
    mentions = spark.createDataFrame([("u", 1, 7), ("u", 2, 8), ("u", 2, 7)], "user_id string, diary_id int, fact_id int")
    asked = spark.createDataFrame([(1, "u", [1.0, 0.0])], "query_id int, user_id string, vec array<float>")
    by_day = search.search_diary(diary, vectors, mentions, asked)
    assert [(r.id, r.mention_id) for r in by_day.orderBy("rank", "mention_id").collect()] == [(1, 7), (1, 7), (1, 8), (3, None)]
    by_entry = search.search_diary(diary, vectors, mentions, asked, by_entry=True)
    assert [(r.id, r.mention_id) for r in by_entry.orderBy("rank").collect()] == [(1, 7), (3, None)]


def test_facts_of_one_file_are_spread(spark):
    assert Sample(spark, SMALL).facts().rdd.getNumPartitions() >= 8


def finished_nodes(frame):
    """The nodes of the plan as it ran."""
    frame.collect()
    nodes = [frame._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            nodes.append(node.plan())
        else:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            yield name, node


def test_scores_of_a_tile_take_little_memory():
    """A tile in which every score is high enough, scored in steps."""
    rng = np.random.default_rng(3)
    vectors = unit_rows(rng.random((8192, 16)))
    block = _QueryBlock(np.arange(512), vectors[:512], np.full(512, None, object))
    tracemalloc.start()
    try:
        hits = block.hits(np.arange(8192), vectors, np.full(8192, "a", object), 0.0, 3)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(hits) >= 3 * 512
    assert peak < 150e6, peak


def test_a_query_travels_once_to_the_lists_of_a_bundle(spark):
    rows = [(0, i, "a", [float(i % 7), float(i % 11), 1.0], i % 16) for i in range(320)]
    lists = spark.createDataFrame(rows, "user_id long, id long, category string, embedding array<float>, list int")
    queries = lists.where("id < 50").selectExpr("id as query_id", "user_id", "embedding as vec", "string(null) as category")
    probes = queries.select("query_id", "user_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("list")).withColumn("n", F.lit(20))
    found = vector_index._scored(lists, queries, probes, 0.2, 3)
    written = [
        node.metrics().apply("shuffleRecordsWritten").value()
        for name, node in finished_nodes(found)
        if name == "Exchange" and "place#" in node.output().mkString()
    ]
    assert written == [320 + 50]


def test_questions_are_not_broadcast_by_the_size_of_their_files(spark, tmp_path):
    text = F.concat(F.repeat(F.lit("long question "), 8), (F.col("id") % 50).cast("string"))
    asked = spark.range(200_000).select(
        F.col("id").alias("query_id"), (F.col("id") % 4).alias("user_id"), text.alias("query"), F.lit(None).cast("string").alias("category")
    )
    asked.write.parquet(str(tmp_path / "asked"))
    facts = spark.range(200).select((F.col("id") % 4).alias("user_id"), "id", F.lit("a").alias("category"), text.alias("title"), text.alias("text"))
    found = search.exact_matches(facts, spark.read.parquet(str(tmp_path / "asked")))
    sent = [node.metrics().apply("dataSize").value() for name, node in finished_nodes(found.groupBy("query_id").count().agg(F.sum("count"))) if name == "BroadcastExchange"]
    # A small relation takes 34 MB.
    assert max(sent, default=0) < 50e6, sent
