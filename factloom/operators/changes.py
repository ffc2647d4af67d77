"""Folding a log of changes into the tables it changes.

``changes`` is append-only: seq (total order), ts, user_id, op (add, update, delete,
link, merge), id, title, text, category, metadata for facts; src, rel, dst, props for links; dup_id for merges.
Everything is an aggregate per key, so a fact that holds a large share of the log is
reduced before the shuffle; rows of the tables that no change touches are not shuffled
when the folded log is small enough for a broadcast join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import normalize_category, relation_type
from factloom.session import materialize
from factloom.sources.tables import Snapshot

_KEY = ["user_id", "id"]
_NO_MAP = "map<string,string>"


def _no_entries() -> Column:
    return F.create_map().cast(_NO_MAP)


def update_map(old: Column, new: Column) -> Column:
    """Entries of both maps; on equal keys ``new`` wins. Null counts as empty."""
    new = F.coalesce(new, _no_entries())
    kept = F.map_filter(F.coalesce(old, _no_entries()), lambda key, _: ~F.array_contains(F.map_keys(new), key))
    return F.map_concat(kept, new)


def last_entries(rows: DataFrame, key: list[str], map_col: str) -> DataFrame:
    """Per key the last value of every map entry: key + [entries: array of (k, seq, v)]."""
    entry = rows.select(*key, "seq", F.explode(map_col).alias("k", "v"))
    last = entry.groupBy(*key, "k").agg(F.max(F.struct("seq", "v")).alias("last"))
    return last.groupBy(*key).agg(F.collect_list(F.struct("k", "last.seq", "last.v")).alias("entries"))


def entries_since(entries: Column, since: Column) -> Column:
    recent = F.filter(entries, lambda e: e["seq"] >= since)
    return F.map_from_entries(F.transform(recent, lambda e: F.struct(e["k"], e["v"])))


def fold_facts(changes: DataFrame) -> DataFrame:
    """One row per changed fact.

    born: seq of its last add, else -1; died: seq of its last delete; the last given
    value of each field since it was born (null = keep).
    """
    rows = changes.where(F.col("op").isin("add", "update", "delete"))
    writes = F.col("op").isin("add", "update")

    def last(value: Column, given: Column) -> Column:
        return F.max(F.when(writes & given, F.struct(F.col("seq"), value.alias("v"))))

    category = normalize_category("category")
    folded = rows.groupBy(*_KEY).agg(
        F.coalesce(F.max(F.when(F.col("op") == "add", F.col("seq"))), F.lit(-1)).alias("born"),
        F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("died"),
        last(F.col("title"), F.col("title").isNotNull()).alias("_title"),
        last(F.col("text"), F.col("text").isNotNull()).alias("_text"),
        last(category, F.coalesce(F.col("category") != "", F.lit(False))).alias("_category"),
        F.max(F.when(F.col("op") == "add", F.struct("seq", F.col("ts").alias("v")))).alias("_ts"),
        F.max(F.when(F.col("op") == "update", F.struct("seq", F.col("ts").alias("v")))).alias("_updated"),
    )

    def since(name: str) -> Column:
        return F.when(F.col(name)["seq"] >= F.col("born"), F.col(name)["v"])

    entries = last_entries(rows.where(writes), _KEY, "metadata")
    return folded.join(entries, _KEY, "left").select(
        *_KEY,
        "born",
        "died",
        since("_title").alias("new_title"),
        since("_text").alias("new_text"),
        since("_category").alias("new_category"),
        since("_ts").alias("new_ts"),
        since("_updated").alias("new_updated_at"),
        F.when(F.col("entries").isNotNull(), entries_since(F.col("entries"), F.col("born"))).alias("new_metadata"),
    )


def apply_fact_changes(facts: DataFrame, folded: DataFrame) -> DataFrame:
    """The facts table after the folded changes, with a ``touched`` flag for re-embedding.

    Changes of a fact the tenant does not own have no effect. An add of a known id
    replaces the fact.
    """
    alive_again = (F.col("born") >= 0) & (F.col("died").isNull() | (F.col("died") < F.col("born")))
    known = facts.join(folded, _KEY, "left")
    kept = known.where(F.col("born").isNull() | ((F.col("born") < 0) & F.col("died").isNull()))
    plain = [c for c in facts.columns if c not in {*_KEY, "title", "text", "category", "updated_at", "metadata"}]
    kept = kept.select(
        *_KEY,
        F.coalesce("new_title", "title").alias("title"),
        F.coalesce("new_text", "text").alias("text"),
        F.coalesce("new_category", "category").alias("category"),
        F.coalesce("new_updated_at", "updated_at").alias("updated_at"),
        F.when(F.col("new_metadata").isNull(), F.col("metadata"))
        .otherwise(update_map(F.col("metadata"), F.col("new_metadata")))
        .alias("metadata"),
        (F.col("new_title").isNotNull() | F.col("new_text").isNotNull()).alias("touched"),
        *plain,
    )
    added = folded.where(alive_again).select(
        *_KEY,
        F.col("new_title").alias("title"),
        F.col("new_text").alias("text"),
        F.col("new_category").alias("category"),
        F.col("new_updated_at").alias("updated_at"),
        F.coalesce("new_metadata", _no_entries()).alias("metadata"),
        F.lit(True).alias("touched"),
        *[
            (F.col("new_ts") if c == "ts" else F.lit(None)).cast(facts.schema[c].dataType).alias(c)
            for c in plain
        ],
    )
    return kept.unionByName(added)


def detached(folded: DataFrame) -> DataFrame:
    """Ids whose old edges, mentions and vectors go away: deleted or added anew."""
    return folded.where(F.col("died").isNotNull() | (F.col("born") >= 0)).select(*_KEY)


def deleted_facts(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """Ids of facts that the delete requests really remove: user_id, id."""
    asked = changes.where(F.col("op") == "delete").select(*_KEY).distinct()
    return facts.select(*_KEY).join(asked, _KEY, "left_semi")


def without_ends(table: DataFrame, gone: DataFrame, ends: list[str]) -> DataFrame:
    """Rows of an edge-like table none of whose ends is in ``gone``."""
    for end in ends:
        table = table.join(gone.withColumnRenamed("id", end), ["user_id", end], "left_anti")
    return table


def living_ends(asked: DataFrame, facts: DataFrame, folded: DataFrame) -> DataFrame:
    """Of the ids ``asked`` those that are facts after the log, with the seq they were last added at, or -1."""
    owned = facts.select(*_KEY).join(asked, _KEY, "left_semi").withColumn("owned", F.lit(True))
    state = asked.join(owned, _KEY, "left").join(folded.select(*_KEY, "born", "died"), _KEY, "left")
    readded = F.coalesce(F.col("born") >= 0, F.lit(False))
    alive = state.where(
        F.when(readded, F.col("died").isNull() | (F.col("died") < F.col("born"))).otherwise(
            F.col("owned").isNotNull() & F.col("died").isNull()
        )
    )
    return alive.select(*_KEY, F.coalesce(F.col("born").cast("long"), F.lit(-1)).alias("born"))


def apply_link_changes(edges: DataFrame, changes: DataFrame, facts: DataFrame, folded: DataFrame) -> DataFrame:
    """The edges after deletes and link requests.

    A link takes effect where both ends are facts of the tenant at that moment and are
    not deleted later; on an existing edge it only updates the properties.
    """
    ends = ["user_id", "src", "rel", "dst"]
    edges = without_ends(edges, detached(folded), ["src", "dst"])
    requests = changes.where(F.col("op") == "link").withColumn("rel", relation_type("rel"))
    requests = requests.select("seq", *ends, "props")
    asked = requests.select("user_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    alive = living_ends(asked, facts, folded)
    for end in ("src", "dst"):
        side = alive.select("user_id", F.col("id").alias(end), F.col("born").alias("_born"))
        requests = requests.join(side, ["user_id", end]).where(F.col("seq") > F.col("_born")).drop("_born")
    entries = last_entries(requests, ends, "props").select(
        *ends, entries_since(F.col("entries"), F.lit(-1)).alias("new_props")
    )
    links = requests.select(*ends).distinct().join(entries, ends, "left")
    updated = edges.join(links, ends, "left").withColumn(
        "props",
        F.when(F.col("new_props").isNull(), F.col("props")).otherwise(update_map(F.col("props"), F.col("new_props"))),
    )
    created = links.join(edges.select(*ends), ends, "left_anti").select(
        *ends, F.coalesce("new_props", _no_entries()).alias("props")
    )
    return updated.select(*ends, "props").unionByName(created)


def apply_changes(snapshot: Snapshot, changes: DataFrame, embed=None) -> Snapshot:
    """All tables after the log, which may also merge facts (op merge: id is the master, dup_id the duplicate, title
    and text are those of the master from now on, null = keep).

    ``embed`` maps (user_id, id, title, text) rows to (user_id, id, embedding) and is
    called for facts that are new or whose title or text changed; without it those facts
    have no vector until the caller adds one.
    """
    from factloom.operators.merge_log import apply_merging_log

    if "dup_id" in changes.columns and changes.where((F.col("op") == "merge") & F.col("dup_id").isNotNull()).take(1):
        return apply_merging_log(snapshot, changes, embed)
    return apply_plain_changes(snapshot, changes, embed)


def apply_plain_changes(snapshot: Snapshot, changes: DataFrame, embed=None) -> Snapshot:
    """``apply_changes`` for a log without merges."""
    folded = materialize(fold_facts(changes), "folded")
    after = apply_fact_changes(snapshot.facts, folded)
    gone = detached(folded)
    facts = after.drop("touched").select(*snapshot.facts.columns)
    edges = apply_link_changes(snapshot.edges, changes, snapshot.facts, folded)
    mentions = without_ends(snapshot.mentions, gone, ["fact_id"]) if snapshot.mentions is not None else None

    vectors = None
    if snapshot.vectors is not None:
        changed = after.join(folded.select(*_KEY), _KEY, "left_semi")
        untouched = snapshot.vectors.join(folded.select(*_KEY), _KEY, "left_anti")
        same_text = snapshot.vectors.drop("category").join(
            changed.where(~F.col("touched")).select(*_KEY, "category"), _KEY
        )
        # Changes of facts the tenant does not own leave vectors of that key alone.
        vectors = untouched.unionByName(same_text.select(*untouched.columns))
        if embed is not None:
            new = changed.where(F.col("touched"))
            embedded = embed(new.select(*_KEY, "title", "text")).join(new.select(*_KEY, "category"), _KEY)
            vectors = vectors.unionByName(embedded.select(*untouched.columns))
    return Snapshot(facts=facts, edges=edges, vectors=vectors, mentions=mentions)


def assign_ids(rows: DataFrame) -> DataFrame:
    """Rows with a new random ``id`` each, stored at once: read again, they are the same."""
    return materialize(rows.withColumn("id", F.expr("uuid()")), "new-ids")


def save_diary(diary: DataFrame, entries: DataFrame, facts: DataFrame, **linking) -> tuple[DataFrame, DataFrame]:
    """Append diary entries and link them: (diary, mentions of the new entries).

    Entries are never merged; a date may have several. A missing date is the day of ``ts``.
    """
    from factloom.operators.mentions import link_mentions

    dated = entries.withColumn("date", F.coalesce("date", F.to_date("ts")))
    return diary.unionByName(dated.select(*diary.columns)), link_mentions(dated, facts, **linking)
