"""Logs with merges against a plain run through the log, one row after another."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import changes as chg
from factloom.operators import components, merging
from factloom.operators.identity import forest
from factloom.operators.ranking import carry_forward
from factloom.plans import registry
from factloom.plans.sample import Sample
from factloom.sources.tables import Snapshot

SMALL = "/root/testdata/sf0.001"
DAY = dt.datetime(2024, 1, 1)
FACTS = "user_id string, id int, title string, text string, category string, ts timestamp, updated_at timestamp, metadata map<string,string>, aliases map<string,string>"
EDGES = "user_id string, src int, rel string, dst int, props map<string,string>"
LOG = "seq bigint, ts timestamp, user_id string, op string, id int, title string, text string, category string, metadata map<string,string>, src int, dst int, rel string, props map<string,string>, dup_id int"
NAMES = [part.split()[0] for part in LOG.split(", ")]


def row(seq, op, i=None, user="u", **values):
    values = {"seq": seq, "ts": DAY + dt.timedelta(minutes=seq), "user_id": user, "op": op, "id": i, **values}
    return tuple(values.get(n) for n in NAMES)


class Plain:
    """The tables of one tenant as dicts."""

    def __init__(self, facts, edges, mentions, vectors):
        self.facts = {f[1]: dict(title=f[2], text=f[3], category=f[4], updated=f[6], metadata=dict(f[7]), aliases=dict(f[8] or {})) for f in facts}
        self.edges = {(e[1], e[2], e[3]): dict(e[4]) for e in edges}
        self.mentions = set(mentions)
        self.vectors = set(vectors)

    def detach(self, i):
        self.edges = {k: v for k, v in self.edges.items() if i not in (k[0], k[2])}
        self.mentions = {m for m in self.mentions if m[1] != i}
        self.vectors.discard(i)

    def write(self, fact, r):
        for name in ("title", "text"):
            if r[name] is not None:
                fact[name] = r[name]

    def apply(self, r):
        op, i = r["op"], r["id"]
        fact = self.facts.get(i)
        if op == "add":
            self.detach(i)
            self.facts[i] = dict(title=r["title"], text=r["text"], category=r["category"], updated=None, metadata=dict(r["metadata"] or {}), aliases={})
        elif op == "delete" and fact:
            self.detach(i)
            del self.facts[i]
        elif op == "update" and fact:
            self.write(fact, r)
            fact["category"] = r["category"] or fact["category"]
            fact["metadata"] |= r["metadata"] or {}
            fact["updated"] = r["ts"]
            if r["title"] is not None or r["text"] is not None:
                self.vectors.discard(i)
        elif op == "link" and r["src"] in self.facts and r["dst"] in self.facts:
            self.edges.setdefault((r["src"], r["rel"], r["dst"]), {}).update(r["props"] or {})
        elif op == "merge":
            self.merge(i, r["dup_id"], r)

    def merge(self, master, dup, r):
        if master == dup or master not in self.facts or dup not in self.facts:
            return
        fact, other = self.facts[master], self.facts.pop(dup)
        if r["title"] is not None or r["text"] is not None:
            self.write(fact, r)
            fact["updated"] = r["ts"]
            self.vectors.discard(master)
        fact["metadata"] = other["metadata"] | fact["metadata"]
        for alias, confidence in other["aliases"].items():
            if alias not in fact["aliases"] or float(confidence) > float(fact["aliases"][alias]):
                fact["aliases"][alias] = confidence
        edges = {}
        moved = {k: v for k, v in self.edges.items() if dup in (k[0], k[2])}
        edges = {k: v for k, v in self.edges.items() if k not in moved}
        for (src, rel, dst), props in moved.items():
            to = (master if src == dup else src, rel, master if dst == dup else dst)
            if to[0] != to[2]:
                edges.setdefault(to, props)
        self.edges = edges
        self.mentions = {(d, master if f == dup else f) for d, f in self.mentions}
        self.vectors.discard(dup)


def random_case(seed, n=60, ids=9):
    rng = random.Random(seed)
    some = lambda p, v: v if rng.random() < p else None
    key = lambda: rng.choice("abc")
    facts = [
        ("u", i, f"t{i}", f"x{i}", "Tool", DAY, None, {key(): f"m{i}" for _ in range(rng.randrange(3))}, {key(): str(rng.randrange(9) / 10)})
        for i in range(ids - 2)
    ]
    edges = {(rng.randrange(ids - 2), rng.choice("RS"), rng.randrange(ids - 2)) for _ in range(14)}
    edges = [("u", *e, {key(): f"e{n}"}) for n, e in enumerate(sorted(edges))]
    rows = []
    for seq in range(1, n):
        op, i = rng.choice(["add", "update", "update", "delete", "link", "link", "link", "merge", "merge"]), rng.randrange(ids)
        if op == "delete" and rng.random() < 0.5:
            op = "update"
        if op in ("add", "update"):
            rows.append(row(seq, op, i, title=some(0.4, f"T{seq}"), text=some(0.4, f"X{seq}"), category=some(0.5, f"C{seq}"), metadata=some(0.6, {key(): f"w{seq}"})))
        elif op == "delete":
            rows.append(row(seq, op, i))
        elif op == "link":
            rows.append(row(seq, op, src=i, dst=rng.randrange(ids), rel=rng.choice("RS"), props=some(0.8, {key(): f"l{seq}"})))
        else:
            rows.append(row(seq, op, i, dup_id=rng.randrange(ids), title=some(0.3, f"M{seq}"), text=some(0.3, f"MX{seq}")))
    mentions = {(70 + rng.randrange(4), rng.randrange(ids - 2)) for _ in range(10)}
    return facts, edges, sorted(mentions), [f[1] for f in facts], rows


def tables(spark, facts, edges, mentions, vectors):
    return Snapshot(
        facts=spark.createDataFrame(facts, FACTS),
        edges=spark.createDataFrame(edges, EDGES),
        mentions=spark.createDataFrame([("u", *m) for m in mentions], "user_id string, diary_id int, fact_id int"),
        vectors=spark.createDataFrame([("u", i, "Tool", [float(i)]) for i in vectors], "user_id string, id int, category string, embedding array<float>"),
    )


def compare(after, plain):
    got = {
        r.id: dict(title=r.title, text=r.text, category=r.category, updated=r.updated_at, metadata=r.metadata, aliases=r.aliases or {})
        for r in after.facts.collect()
    }
    assert got == plain.facts
    edges = after.edges.collect()
    assert {(r.src, r.rel, r.dst): r.props for r in edges} == plain.edges and len(edges) == len(plain.edges)
    mentions = [(r.diary_id, r.fact_id) for r in after.mentions.collect()]
    assert sorted(mentions) == sorted(plain.mentions)
    assert sorted(r.id for r in after.vectors.collect()) == sorted(plain.vectors)


@pytest.mark.parametrize("seed", range(3))
def test_a_random_log(spark, seed):
    *start, rows = random_case(seed)
    plain = Plain(*start)
    for r in rows:
        plain.apply(dict(zip(NAMES, r, strict=True)))
    assert len(plain.facts) > 1
    compare(chg.apply_changes(tables(spark, *start), spark.createDataFrame(rows, LOG)), plain)


def test_a_log_in_two_parts(spark):
    """Folding in batches, as the stream does, gives the same; also with more ids than merges name."""
    *start, rows = random_case(11, n=80, ids=24)
    plain = Plain(*start)
    for r in rows:
        plain.apply(dict(zip(NAMES, r, strict=True)))
    snapshot = tables(spark, *start)
    for part in (rows[:40], rows[40:]):
        snapshot = chg.apply_changes(snapshot, spark.createDataFrame(part, LOG))
    compare(snapshot, plain)


def test_other_tenants_and_unknown_ids(spark):
    facts = [(u, i, f"{u}{i}", "x", "Tool", DAY, None, {}, None) for u in "uv" for i in (1, 2)]
    edges = [("u", 1, "R", 9, {}), ("v", 2, "R", 1, {})]
    snapshot = Snapshot(facts=spark.createDataFrame(facts, FACTS), edges=spark.createDataFrame(edges, EDGES))
    rows = [row(1, "merge", 1, dup_id=2), row(2, "merge", 1, user="w", dup_id=2), row(3, "merge", 9, dup_id=1), row(4, "update", 2, user="v", title="own")]
    after = chg.apply_changes(snapshot, spark.createDataFrame(rows, LOG))
    assert sorted((r.user_id, r.id, r.title) for r in after.facts.collect()) == [("u", 1, "u1"), ("v", 1, "v1"), ("v", 2, "own")]
    assert sorted((r.user_id, r.src, r.dst) for r in after.edges.collect()) == [("u", 1, 9), ("v", 2, 1)]
    assert after.vectors is None and after.mentions is None


def test_a_merged_title_is_embedded(spark):
    *start, _ = random_case(1)
    rows = [row(1, "merge", 1, dup_id=2, title="both"), row(2, "merge", 3, dup_id=4), row(3, "add", 2, text="back", category="c")]
    embed = lambda df: df.select("user_id", "id", F.array(F.lit(0.5).cast("float")).alias("embedding"))
    got = {r.id: r.embedding for r in chg.apply_changes(tables(spark, *start), spark.createDataFrame(rows, LOG), embed).vectors.collect()}
    assert got == {0: [0.0], 1: [0.5], 2: [0.5], 3: [3.0], 5: [5.0], 6: [6.0]}


def test_titles_of_a_chain_come_from_the_last_merge(spark):
    facts = [("u", i, f"t{i}", f"x{i}", "Tool", DAY, None, {}, None) for i in (1, 2, 3)]
    snapshot = Snapshot(facts=spark.createDataFrame(facts, FACTS), edges=spark.createDataFrame([], EDGES))
    merges = [("u", 2, 3, "Zeta of 2 and 3", "zz"), ("u", 1, 2, "Alpha of all", None)]
    after, _ = merging.merge_facts(snapshot, spark.createDataFrame(merges, "user_id string, master_id int, dup_id int, title string, text string"))
    assert [(r.id, r.title, r.text) for r in after.facts.collect()] == [(1, "Alpha of all", "x1")]


def test_long_chains(spark):
    merges = spark.range(1, 40).selectExpr("'u' user_id", "id seq", "id master_id", "-1L master_born", "id - 1 dup_id", "-1L dup_born")
    steps = {r.id: [s.id for s in r.steps] for r in forest(merges).collect()}
    assert steps == {i: list(range(i + 1, 40)) for i in range(39)}


@pytest.mark.parametrize("partitions", ["1", "16"])
def test_carrying_forward(spark, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rng = random.Random(2)
    rows = [(rng.choice("aaaab"), i, i if rng.random() < 0.02 else None) for i in range(2000)]
    got = carry_forward(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], ["i"], "v", "last").collect()
    spark.conf.set("spark.sql.shuffle.partitions", old)
    last, want = {}, {}
    for k, i, v in rows:
        want[i] = last.get(k)
        last[k] = v if v is not None else last.get(k)
    assert {r.i: r.last for r in got} == want


def test_sample_log_and_edges_are_made_once(spark, monkeypatch):
    """The log is one pass over the events; order lines are read for the stored edges only."""
    plan = Sample(spark, SMALL).merging_changes()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1
    given = []
    monkeypatch.setattr(registry.chg, "apply_changes", lambda snapshot, log: given.append(snapshot))
    registry._after_merging_log(Sample(spark, SMALL))
    files = given[0].edges.inputFiles() + given[0].facts.inputFiles()
    assert files and not any("lineitem" in f or "/part.parquet" in f for f in files)


class Counted:
    def __init__(self, function):
        self.function, self.calls = function, 0

    def __call__(self, *args, **kwargs):
        self.calls += 1
        return self.function(*args, **kwargs)


def test_roots_of_trees(spark, monkeypatch):
    monkeypatch.setattr(components, "materialize", counted := Counted(components.materialize))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        order = sorted(range(300), key=lambda i: (i * 7919) % 1009)
        rows = [("u", str(a), str(b)) for a, b in zip(order[1:], order)] + [("v", str(i), str(i // 2)) for i in range(2, 200)]
        links = spark.createDataFrame(rows, "user_id string, node string, parent string")
        got = {(r.user_id, r.node): r.root for r in components.tree_roots(links, ["user_id"]).collect()}
        assert got == {("u", str(i)): str(order[0]) for i in order[1:]} | {("v", str(i)): "1" for i in range(2, 200)}
        assert counted.calls <= 2 + 9
        circle = spark.range(100).selectExpr("'u' user_id", "id node", "(id * 37 + 11) % 100 parent").where("node <> parent")
        with pytest.raises(ValueError, match="circle"):
            components.tree_roots(circle, ["user_id"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_a_chain_of_merges_in_order_takes_no_rounds(spark, monkeypatch):
    counted = Counted(components.materialize)
    monkeypatch.setattr(components, "materialize", counted)
    facts = spark.range(3000).selectExpr("'u' user_id", "id")
    merges = facts.where("id > 0").selectExpr("user_id", "id - 1 master_id", "id dup_id")
    ends = merging.valid_merges(merges, facts)
    assert ends.where("master_id = 0 and dup_id > 0").distinct().count() == ends.count() == 2999
    # Before, every round wrote and shuffled all links, and there were more of them the longer the chain.
    assert counted.calls <= 6


def test_neighbouring_lines_are_found_in_one_pass(spark, tmp_path):
    rows = [(1, 1, 8, "R"), (1, 1, 4, "N"), (1, 2, 8, "A"), (1, 4, 12, "A"), (1, 5, 16, "A"), (1, 6, 17, "A"), (1, 7, 17, "A")]
    rows += [(2, 3, 12, "A"), (2, 4, 16, "R"), (2, 5, None, "R"), (2, 6, 20, None), (2, 7, 24, "R")]
    rows += [(None, 1, 4, "A"), (None, 2, 8, "A"), (3, None, 4, "A"), (3, 1, 8, "A"), (4, 2**31 - 2, 4, "A"), (4, 2**31 - 1, 8, "A")]
    table = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string")
    table.write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = Sample(spark, str(tmp_path)).edges()
    got = {(r.user_id, r.src, r.rel, r.dst): r.props["orders"] for r in edges.collect()}
    assert got == {
        (0, 4, "BOUGHT_N", 8): "1", (0, 12, "BOUGHT_A", 16): "2", (0, 20, None, 24): "1", (0, 4, "BOUGHT_A", 8): "1"
    }
    # Before, all order lines were read twice and moved four times.
    plan = Sample(spark, str(tmp_path)).edges()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2
