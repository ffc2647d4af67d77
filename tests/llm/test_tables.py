"""Mixing, sharding, neighbours and the pipeline."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import near_texts, neighbours, shards
from factloom.llm.mixing import mix_documents, rake
from factloom.llm.near_texts import drop_near_texts
from factloom.llm.neighbours import Settings, near_duplicate_vectors
from factloom.llm.shards import shard_documents
from factloom.llm.simhash import simhash_groups
from tests.conftest import SMALL

# --- mixing


def test_raking_meets_targets(spark, rng):
    cells = [(a, b, c, float(rng.randint(1, 1000))) for a in "xyz" for b in "pq" for c in "12345"]
    targets = {"a": dict(zip("xyz", (0.2, 0.3, 0.5), strict=True)), "b": {"p": 0.9, "q": 0.1}, "c": {k: 0.2 for k in "12345"}}
    frames = {d: spark.createDataFrame(list(t.items()), f"{d} string, share double") for d, t in targets.items()}
    out = rake(spark.createDataFrame(cells, "a string, b string, c string, tokens double"), frames).collect()
    for dim, shares in targets.items():
        got = defaultdict(float)
        for r in out:
            got[r[dim]] += r.weight
        assert got == pytest.approx(shares, abs=1e-8)
    # Raking keeps odds ratios within the table.
    w, t = {(r.a, r.b, r.c): r.weight for r in out}, {c[:3]: c[3] for c in cells}
    odds = [x["x", "p", "1"] * x["y", "q", "1"] / (x["x", "q", "1"] * x["y", "p", "1"]) for x in (w, t)]
    assert odds[0] == pytest.approx(odds[1], rel=1e-6)


def test_sample_meets_targets(spark):
    """A source with two thirds of the documents; the drawn tokens follow the targets."""
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("word "), (F.col("id") % 7 + 1).cast("int")).alias("text"),
        F.when(F.col("id") % 3 == 0, "small").otherwise("hot").alias("source"),
        F.when(F.col("id") % 5 == 0, None).otherwise("en").alias("lang"),
    )
    target = spark.createDataFrame([("small", 0.5), ("hot", 0.5)], "source string, share double")
    lang = spark.createDataFrame([("en", 0.7), (None, 0.3)], "lang string, share double")
    out = mix_documents(docs, targets={"source": target, "lang": lang}, rate=1.5).collect()
    drawn = Counter()
    for r in out:
        drawn["all"] += r.copies * r.n_tokens
        drawn[r.source] += r.copies * r.n_tokens
        drawn[r.lang] += r.copies * r.n_tokens
    assert len(out) == 20_000
    assert drawn["small"] / drawn["all"] == pytest.approx(0.5, abs=0.02)
    assert drawn[None] / drawn["all"] == pytest.approx(0.3, abs=0.02)
    assert drawn["all"] == pytest.approx(1.5 * sum(r.n_tokens for r in out), rel=0.02)
    single = mix_documents(docs, targets={"source": target, "lang": lang}).agg(F.max("expected"), F.max("copies")).first()
    assert single[0] == pytest.approx(1.0) and single[1] == 1


def test_a_tiny_source_does_not_shrink_the_sample(spark):
    """The rate holds whatever the rarest cell is; a class too small for its target is taken whole."""
    docs = spark.range(12_000).select(
        F.col("id").alias("doc_id"),
        F.repeat(F.lit("word "), (F.col("id") % 7 + 20).cast("int")).alias("text"),
        F.when(F.col("id") == 5, "tiny").when(F.col("id") % 10 == 0, "small").otherwise("hot").alias("source"),
        F.when(F.col("id") % 5 == 0, None).otherwise("en").alias("lang"),
    )
    out = mix_documents(docs, {"source": 0.7, "lang": 0.8}, rate=0.5, once=True).collect()
    everything = sum(r.n_tokens for r in out)
    assert max(r.expected for r in out) <= 1 + 1e-9 and {r.copies for r in out} == {0, 1}
    assert sum(r.expected * r.n_tokens for r in out) == pytest.approx(0.5 * everything, rel=1e-3)
    assert sum(r.copies * r.n_tokens for r in out) == pytest.approx(0.5 * everything, rel=0.03)
    assert [r.expected for r in out if r.source == "tiny"] == pytest.approx([1.0], abs=1e-3)


def test_pipeline_mixing_keeps_its_rate(spark, small_docs):
    one = spark.createDataFrame([(-1, "three short words", "en", "tiny", 17)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = small_docs.select(*corpus_pipeline.COLUMNS).unionByName(one)
    n_words = F.sum(F.size(F.split(F.trim("text"), r"\s+")))
    kept = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, SMALL).agg(n_words).first()[0]
    assert kept / docs.agg(n_words).first()[0] == pytest.approx(0.5, abs=0.12)


def test_mixing_odd_rows(odd, empty):
    out = mix_documents(odd, {"source": 0.5, "lang": 0.5}, rate=1.0).collect()
    assert len(out) == odd.count()
    assert all(r.copies == 0 and r.expected == 0 for r in out if r.doc_id in (3,))
    assert mix_documents(empty, {"source": 0.5}).count() == 0


# --- shards


def check_shards(rows, texts, n_shards):
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(n_shards))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter(
        (d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in texts
    )
    total, largest = sum(sizes.values()), max(r.size for r in rows)
    assert all(abs(sizes[s] - total / n_shards) <= 2 * largest + 0.01 * total / n_shards for s in range(n_shards))


@pytest.mark.parametrize("n_shards", [1, 7, 40])
def test_shards(small_docs, n_shards):
    texts = [(r.doc_id, r.text) for r in small_docs.collect()]
    check_shards(shard_documents(small_docs, n_shards).collect(), texts, n_shards)


def test_shards_of_a_hot_group(spark):
    """A third of all rows are copies of one text; small groups stay together."""
    docs = spark.range(9000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("the same text again")).otherwise(F.concat(F.lit("text "), F.floor(F.col("id") / 6).cast("string"))).alias("text"),
    )
    rows = shard_documents(docs, 10).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()], 10)
    where = defaultdict(set)
    for r in rows:
        where[r.text_crc32].add(r.shard)
    assert len(where[zlib.crc32(b"the same text again")]) > 2
    assert sum(len(s) > 1 for s in where.values()) <= 10


def test_shards_of_rows_that_share_id_and_text(spark):
    """A third of all rows have no id and one text: they are cut like others."""
    hot = F.col("id") % 3 == 0
    docs = spark.range(9000).select(
        F.when(~hot, F.col("id")).alias("doc_id"), F.when(hot, F.lit("again " * 9)).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text")
    )
    check_shards(shard_documents(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()], 40)


def test_slices_are_cut_by_rows_too(spark, monkeypatch):
    """Nearly all rows are short, nearly all bytes lie in a few long texts."""
    seen, cut = [], shards.splitters
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 4, F.repeat(F.lit("x"), 400_000)).otherwise(F.col("id").cast("string")).alias("text"))
    monkeypatch.setattr(shards, "splitters", lambda keyed, parts, tolerance: seen.append(cut(keyed, parts, tolerance)) or seen[-1])
    rows = shard_documents(docs, n_shards=4, slices=5).collect()
    assert len(rows) == 8000 and [len(c) for c in seen] == [3, 19]
    cuts = sorted({*seen[0], *seen[1]})
    keys = [r.key for r in docs.select(shards.shard_key(F.col("text"), F.col("doc_id"), F.lit(0)).alias("key")).collect()]
    assert max(Counter(np.searchsorted(cuts, keys, side="right").tolist()).values()) < 3 * 8000 / 20


def test_shards_of_odd_rows(odd, empty):
    check_shards(shard_documents(odd, 3).collect(), [(r.doc_id, r.text) for r in odd.collect()], 3)
    assert shard_documents(empty, 3).count() == 0


# --- neighbours


def plain_links(rows, threshold):
    usable = [
        i for i, (v, x) in enumerate(rows)
        if v is not None and x and all(c is not None and np.isfinite(c) for c in x) and any(x)
    ]
    n_links, label = Counter(), {i: i for i in range(len(rows))}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for dim in {len(rows[i][1]) for i in usable}:
        own = [i for i in usable if len(rows[i][1]) == dim]
        x = np.array([np.array(rows[i][1], np.float32) for i in own], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= threshold, 1)), strict=True):
            n_links[own[a]] += 1
            n_links[own[b]] += 1
            label[root(own[b])] = root(own[a])
    lowest = {}
    for i in usable:
        lowest[root(i)] = min(rows[i][0], lowest.get(root(i), rows[i][0]))
    return Counter((v, n_links[i], lowest.get(root(i), v)) for i, (v, _) in enumerate(rows))


def planted_vectors():
    r = np.random.default_rng(11)
    rows = [(i, r.standard_normal(24).tolist()) for i in range(1500)]
    for size, spread in ((2, 0.04), (3, 0.05), (20, 0.03), (150, 0.02)):
        for _ in range(4 if size < 100 else 1):
            centre = r.standard_normal(24)
            rows += [(len(rows) + k, (centre + spread * r.standard_normal(24)).tolist()) for k in range(size)]
    rows += [(len(rows) + k, rows[3][1]) for k in range(400)]
    return rows


@pytest.mark.parametrize("k_most", [16, 256])
def test_links_of_vectors(spark, k_most):
    rows = planted_vectors()
    out = near_duplicate_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), Settings(k_most=k_most)
    ).collect()
    got, want = Counter((r.vec_id, r.n_links, r.component_id) for r in out), plain_links(rows, 0.95)
    true, found = (sum(n * c for (_, n, _), c in x.items()) for x in (want, got))
    assert found <= true and found >= 0.98 * true
    assert sum((got & want).values()) >= 0.98 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_odd_vectors(spark):
    one = [0.5, 0.25, 0.0]
    rows = [
        (1, one), (1, one), (2, [1.0, 0.5, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]),
        (7, [float("nan"), 1.0, 0.0]), (8, [float("inf"), 1.0, 0.0]), (9, [0.5, 0.25]), (10, [-0.5, -0.25, 0.0]),
        (None, one), (12, [1e-30, 5e-31, 0.0]), (13, [1e30, 5e29, -0.0]),
    ]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "vec_id long, embedding array<float>, node int, h1 string, copies int")
    out = Counter((r.vec_id, r.n_links, r.component_id) for r in near_duplicate_vectors(frame).collect())
    assert out == plain_links(rows, 0.95)
    assert near_duplicate_vectors(frame.limit(0)).count() == 0


@pytest.mark.parametrize("copies, pairs", [(2000, 60), (1, 1)])
def test_lost_links_are_seen_and_found_exactly(spark, monkeypatch, copies, pairs):
    """Links between different vectors all lost: neither copies nor a sample without links hide it, and comparing all ends it."""
    r = np.random.default_rng(5)
    base = r.standard_normal((1200, 24))
    rows = [*base, *(base[:pairs] + 0.01 * r.standard_normal((pairs, 24))), *[base[700]] * (copies - 1)]
    rows = [(i, v.tolist()) for i, v in enumerate(rows)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(neighbours, "initial_graph", lambda nodes, graph, *rest: graph)
    out = near_duplicate_vectors(frame, Settings(rounds=0, tries=1, audited=128, audited_most=64)).collect()
    assert Counter((x.vec_id, x.n_links, x.component_id) for x in out) == plain_links(rows, 0.95)


def test_planted_partners_lie_just_above_the_threshold(spark):
    r = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((50, 16)))]
    _, nodes = neighbours.vector_classes(spark.createDataFrame([*rows, (50, [2.0])], "vec_id long, embedding array<float>"))
    known = {n.node: np.array(n.vec, float) for n in nodes.collect()}
    planted = neighbours.planted_partners(nodes, Settings(planted=20)).collect()
    assert len(planted) in (19, 20) and all(p.node < 0 and p.copies == 0 for p in planted)
    for p in planted:
        a, b = known[p.of], np.array(p.vec, float)
        assert 0.95 < a @ b / np.sqrt((a @ a) * (b @ b)) < 0.955


def test_trees_grow_with_the_number_of_vectors():
    assert [neighbours.trees_for(bits, 0, Settings()) for bits in (0, 4, 14, 20)] == [6, 6, 12, 24]
    assert neighbours.trees_for(4, 2, Settings()) == 24


# --- pipeline


def test_pipeline_stages(spark, small_docs):
    """What each stage does to its own input."""
    docs, seen = small_docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SMALL)
        after = docs.collect()
        assert len({r.doc_id for r in after}) == len(after) and {r.doc_id for r in after} <= set(before), name
        if name != "pieces":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        seen[name] = before, {r.doc_id: r for r in after}
    before, after = seen["language"]
    assert len(after) >= 0.98 * len(before)
    before, after = seen["lines"]
    assert set(before) == set(after) and any(before[d].text != after[d].text for d in before)
    before, after = seen["near_duplicates"]
    copies = defaultdict(list)
    for d, r in before.items():
        copies[r.text.lower()].append(d)
    assert all(d not in after for ids in copies.values() for d in sorted(ids)[1:])
    before, after = seen["mixing"]
    assert 0 < len(after) < len(before)
    before, after = seen["pieces"]
    assert set(before) == set(after) and all(r.n_ids == len(r.ids) for r in after.values())


def test_pipeline_takes_odd_rows(spark, odd):
    docs = odd.select(*corpus_pipeline.COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        docs.count()


def plain_kept(rows):
    """Brute force: (doc_id, text) that stay of components of Jaccard >= 0.8, by doc_id then any text."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (both and both / len(sets[i] | sets[j]) >= 0.8):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = defaultdict(list)
    for x, row in zip(label, rows, strict=True):
        groups[x].append(row)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups.values()], groups


def planted_texts(rng):
    """Texts, each with copies in which one to all words were changed, and a group of many near copies."""
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for n in (3, 6, 30, 80, 200, 400):
        for _ in range(6):
            text = [rng.choice(vocabulary) for _ in range(n)]
            rows.append(" ".join(text))
            for share in (0.004, 0.01, 0.02, 0.03, 0.05, 0.2):
                other = [rng.choice(vocabulary) if rng.random() < share else w for w in text]
                rows.append(" ".join(other).title())
    text = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(150):
        other = list(text)
        other[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append(" ".join(other))
    rows += [rows[5]] * 40 + ["", None, " \n "]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("tile", [40, 2048])
def test_near_texts_against_brute_force(spark, rng, tile):
    rows = planted_texts(rng)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want, groups = plain_kept(rows)
    assert 40 < len(groups) < len(rows) - 200
    assert sorted(r.doc_id for r in drop_near_texts(frame, tile=tile).collect()) == sorted(want)
    if tile == 2048:
        docs = frame.withColumns({"lang": F.lit("en"), "source": F.lit("a"), "n_chars": F.char_length("text").cast("long")})
        stage = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SMALL)
        assert sorted(r.doc_id for r in stage.collect()) == sorted(want)


def test_near_texts_keep_rows_that_share_an_id(spark):
    """Rows without an id, or with the same one, go only as near duplicates of a row that stays."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(20)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (3, c), (3, d), (4, d), (5, a), (3, c)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in drop_near_texts(frame).collect())
    assert got == Counter([(5, a), (None, b), (3, c), (3, d)])


def test_stage_finds_candidates_by_fingerprints(spark, monkeypatch):
    """Without any shared band the stage still links near copies whose fingerprints are at most two bits apart, and no others."""
    monkeypatch.setattr(near_texts, "keys_in", lambda nodes, wanted: spark.createDataFrame([], "node long, key long"))
    refrain = " ".join(f"w{i}" for i in range(21))
    ends = ["a0", "b0", " ".join(f"c{i}" for i in range(9))]
    rows = [(n, " ".join([refrain] * 2000 + [end])) for n, end in enumerate(ends)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in simhash_groups(frame).collect()} == {0}
    docs = frame.withColumns({"lang": F.lit("en"), "source": F.lit("a"), "n_chars": F.char_length("text").cast("long")})
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SMALL)
    assert sorted(r.doc_id for r in stage.collect()) == [0, 2]


def moved_texts(frame):
    """Rows that the exchanges of the last step move with their texts."""
    frame.collect()
    moved, nodes = 0, [frame._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            nodes.append(node.plan())
        else:
            nodes += [node.children().apply(i) for i in range(node.children().size())]
            if name == "Exchange" and "text#" in node.output().mkString():
                moved += node.metrics().apply("shuffleRecordsWritten").value()
    return moved


def test_texts_that_stay_are_not_moved(spark, rng):
    """Also where the rows that go are too many to be broadcast."""
    texts = [" ".join(str(rng.random()) for _ in range(30)) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts + texts[:20])), "doc_id long, text string").repartition(4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = drop_near_texts(frame)
        assert 20 <= moved_texts(kept) < 60
        assert sorted(r.doc_id for r in kept.collect()) == list(range(400))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
