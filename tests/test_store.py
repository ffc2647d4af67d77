"""Base and delta files: any number of batches gives the tables of the whole log; a batch writes what it changed."""

from __future__ import annotations

from pathlib import Path

import pytest

from factloom.sources import store
from factloom.sources.tables import Snapshot, write_table
from tests.test_merge_log import LOG, NAMES, Plain, compare, random_case, row, tables


def folded(start, rows):
    plain = Plain(*start)
    for r in rows:
        plain.apply(dict(zip(NAMES, r, strict=True)))
    return plain


def test_batches_equal_the_whole_log(spark, tmp_path):
    *start, rows = random_case(11, n=40, ids=16)
    root = f"{tmp_path}/store"
    store.create_store(tables(spark, *start), root)
    for part in (rows[:20], rows[20:]):
        store.commit_changes(spark, root, spark.createDataFrame(part, LOG), most_share=100.0)
    compare(store.read_store(spark, root), folded(start, rows))
    compare(store.read_store(spark, root, 0), folded(start, []))


@pytest.fixture
def hub(spark, tmp_path):
    """A fact that all others are linked to."""
    facts = spark.range(200).selectExpr(
        "'u' user_id", "id", "concat('t', id) title", "'x' text", "'Tool' category", "timestamp_ntz'2024-01-01' ts",
        "cast(null as timestamp_ntz) updated_at", "map('a', 'b') metadata", "cast(null as map<string,string>) aliases",
    )
    edges = spark.range(1, 200).selectExpr("'u' user_id", "id src", "'R' rel", "0L dst", "map('n', string(id)) props")
    root = f"{tmp_path}/hub"
    store.create_store(Snapshot(facts=facts, edges=edges), root)
    return root


def sizes(spark, root, version):
    return [(p.name, p.position, p.n_rows) for p in store.read_manifest(spark, root, version)]


def log(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


def test_a_batch_writes_only_what_it_changed(spark, hub):
    before = store.read_manifest(spark, hub, 0)
    changes = log(spark, row(1, "update", 0, title="hub"), row(2, "update", 1, title="t1"), row(3, "link", src=1, dst=0, rel="r", props={"n": "1"}))
    assert store.commit_changes(spark, hub, changes) == 1
    assert sizes(spark, hub, 1) == [("edges", 0, 199), ("facts", 0, 200), ("facts", 1, 2)]
    assert {p.folder for p in before} < {p.folder for p in store.read_manifest(spark, hub, 1)}
    store.commit_changes(spark, hub, log(spark, row(4, "delete", 5), row(5, "link", src=2, dst=3, rel="new")))
    assert sizes(spark, hub, 2) == [("edges", 0, 199), ("edges", 1, 2), ("facts", 0, 200), ("facts", 1, 2), ("facts", 2, 1)]
    latest = store.read_store(spark, hub)
    assert latest.facts.count() == 199 and latest.edges.where("src = 5").count() == 0 and latest.edges.count() == 199


@pytest.mark.parametrize("most_deltas, most_share, parts", [(8, 100.0, 4), (1, 100.0, 2), (8, 0.001, 1)])
def test_few_deltas_are_kept(spark, hub, most_deltas, most_share, parts):
    """All deltas, deltas made one, and a new base read alike; the older versions stay."""
    for n in range(3):
        rows = [row(n, "update", n + i, title=f"new {n}") for i in (0, 1)] + [row(n, "delete", 10 + n)]
        store.commit_changes(spark, hub, log(spark, *rows), most_deltas=most_deltas, most_share=most_share)
    assert len([p for p in store.read_manifest(spark, hub, 3) if p.name == "facts"]) == parts
    facts = {r.id: r.title for r in store.read_store(spark, hub).facts.collect()}
    assert [facts[i] for i in range(5)] == ["new 0", "new 1", "new 2", "new 2", "t4"]
    assert set(range(200)) - set(facts) == {10, 11, 12}
    assert store.read_store(spark, hub, 1).facts.count() == 199


def test_an_empty_log_and_strangers_change_nothing(spark, hub):
    store.commit_changes(spark, hub, spark.createDataFrame([], LOG))
    store.commit_changes(spark, hub, log(spark, row(1, "update", 0, user="w", title="no"), row(2, "delete", 999), row(3, "link", src=None, dst=0, rel="r")))
    assert sizes(spark, hub, 2) == [("edges", 0, 199), ("facts", 0, 200)]


def test_a_batch_again_changes_nothing(spark, hub):
    for title in ("first", "second"):
        store.commit_changes(spark, hub, log(spark, row(1, "update", 0, title=title)), 0)
    assert store.last_version(spark, hub) == 1
    assert store.read_store(spark, hub).facts.where("id = 0").first().title == "first"


def test_a_batch_that_failed_half_way_is_not_seen(spark, hub):
    changes = log(spark, row(1, "delete", 7))
    store.commit_changes(spark, hub, changes)
    Path(hub, "manifest", "version=1", "_SUCCESS").unlink()
    assert store.last_version(spark, hub) == 0 and store.read_store(spark, hub).facts.count() == 200
    assert store.commit_changes(spark, hub, changes) == 1
    assert store.read_store(spark, hub).facts.count() == 199


def test_a_lost_file_is_an_error(spark, hub):
    part = next(p for p in store.read_manifest(spark, hub, 0) if p.name == "facts")
    next(Path(hub, part.folder).glob("*.parquet")).unlink()
    with pytest.raises(OSError, match="files were written"):
        store.read_store(spark, hub)


def test_a_store_is_not_overwritten(spark, hub, tmp_path):
    with pytest.raises(FileExistsError):
        store.create_store(store.read_store(spark, hub), hub)
    with pytest.raises(FileNotFoundError):
        store.read_store(spark, f"{tmp_path}/none")


def test_forgotten_versions(spark, hub):
    for n in range(3):
        store.commit_changes(spark, hub, log(spark, row(n, "update", n, title=f"new {n}")), most_deltas=1)
    Path(hub, "facts", "delta-failed").mkdir()
    store.forget_versions(spark, hub, 3)
    assert [p.name for p in Path(hub, "manifest").iterdir()] == ["version=3"]
    assert len(list(Path(hub, "facts").iterdir())) == 2
    assert store.read_store(spark, hub).facts.where("title like 'new%'").count() == 3


def test_the_base_is_not_shuffled(spark, hub):
    """Reading a version with deltas, and finding what a log concerns, leave the rows of the base where they are."""
    store.commit_changes(spark, hub, log(spark, row(1, "update", 0, title="hub"), row(2, "delete", 3)))
    facts = store.read_store(spark, hub).facts
    facts.collect()
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan


def test_lookups_skip_row_groups(spark, tmp_path):
    """An id within the range of a file that does not hold it is not read, also without a tenant."""
    rows = spark.range(0, 400_000, 2).selectExpr("'u' user_id", "id", "array(0f) embedding", "'c' category")
    write_table(rows.coalesce(1), f"{tmp_path}/vectors", "vectors", spread=False)

    def scanned(wanted: int) -> int:
        found = spark.read.parquet(f"{tmp_path}/vectors").where(f"id = {wanted}")
        assert len(found.collect()) == (wanted % 2 == 0)
        return found._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    assert scanned(200_000) > 0
    assert sum(scanned(n) > 0 for n in (100_001, 200_001, 300_001)) == 0
