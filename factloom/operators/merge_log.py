"""Folding a log that also merges facts.

The result is that of applying the log one row after another, a merge being an update of the master's title and text
followed by ``merging.merge_facts`` for one duplicate. It is not computed that way: every row is attached to the life its id has
at its seq (``identity``), lives are folded like plain facts, and what a master takes over is an aggregate over the lives it
absorbed. Only ids that a merge names take this way; all others are folded as before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import normalize_category, relation_type
from factloom.operators import changes as plain
from factloom.operators.identity import FOUND, KEY, LIFE, Lives, lives_of_log, merge_requests, merged_ids
from factloom.operators.merging import alias_rank
from factloom.session import materialize
from factloom.sources.tables import Snapshot

_ENTRY = "array<struct<k:string,seq:bigint,v:string>>"


def _without_ids(table: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return table.join(ids.withColumnRenamed("id", column), ["user_id", column], "left_anti")


def _of_ids(table: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return table.join(ids.withColumnRenamed("id", column), ["user_id", column], "left_semi")


def written_lives(facts: DataFrame, changes: DataFrame, ids: DataFrame, lives: Lives) -> DataFrame:
    """One row per life that the facts hold or the log writes: user_id, id, born, its last given values, the
    columns it was found with (``old``), and its metadata."""
    writes = _of_ids(changes.where(F.col("op").isin("add", "update", "merge")), ids)
    title, text = F.col("title"), F.col("text")
    is_merge = F.col("op") == "merge"
    # A merge that takes effect writes title and text of the master; nothing else of its row counts.
    rows = writes.select(
        *KEY, F.col("seq").cast("long").alias("seq"), "op", "ts", "title", "text",
        F.when(~is_merge, F.col("category")).alias("category"), F.when(~is_merge, F.col("metadata")).alias("metadata"),
        (F.col("dup_id") if "dup_id" in changes.columns else F.lit(None)).alias("dup_id"),
    )
    adds = rows.where("op = 'add'").withColumn("born", F.col("seq"))
    later = lives.at(rows.where("op <> 'add'")).withColumnRenamed("id_born", "born")
    effective = lives.events.where("state.kind = 'dead'").select("user_id", F.col("id").alias("dup_id"), "seq", F.lit(True).alias("done"))
    later = later.join(effective, ["user_id", "dup_id", "seq"], "left").where(~(F.col("op") == "merge") | F.col("done")).drop("done")
    rows = materialize(adds.unionByName(later.select(*adds.columns)), "writes")

    def last(value: Column, given: Column) -> Column:
        return F.max(F.when(given, F.struct(F.col("seq"), value.alias("v"))))["v"]

    category = normalize_category("category")
    changed = (F.col("op") == "update") | ((F.col("op") == "merge") & (title.isNotNull() | text.isNotNull()))
    folded = rows.groupBy(*LIFE).agg(
        last(title, title.isNotNull()).alias("new_title"),
        last(text, text.isNotNull()).alias("new_text"),
        last(category, F.coalesce(F.col("category") != "", F.lit(False))).alias("new_category"),
        last(F.col("ts"), F.col("op") == "add").alias("new_ts"),
        last(F.col("ts"), changed).alias("new_updated_at"),
    )
    entries = plain.last_entries(rows, LIFE, "metadata")
    folded = folded.join(entries.select(*LIFE, plain.entries_since(F.col("entries"), F.lit(FOUND)).alias("new_metadata")), LIFE, "left")
    own = [c for c in facts.columns if c not in KEY]
    found = _of_ids(facts, ids).select(*KEY, F.lit(FOUND).cast("long").alias("born"), F.struct(*own).alias("old"))
    both = found.join(folded, LIFE, "full")
    return both.withColumn("all_metadata", plain.update_map(F.col("old.metadata"), F.col("new_metadata")))


def _absorbed(lives: DataFrame, value: str, best: Column) -> DataFrame:
    """One map for each life that survives (user_id, to, value): of each key the entry that ``best`` ranks first."""
    entries = lives.select("user_id", "to", "way", F.explode(value).alias("key", "value")).where("value is not null")
    one = entries.groupBy("user_id", "to", "key").agg(F.min_by("value", best).alias("value"))
    return one.groupBy("user_id", "to").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias(value))


def merged_facts(facts: DataFrame, written: DataFrame, lives: Lives) -> DataFrame:
    """The facts that merges name, as they are after the log, with ``touched`` and ``fresh`` (added by the log).

    Of each metadata key the master keeps its own value; else that of the first merged duplicate that has the key
    counts, itself with what it absorbed before. Merge times from the master down give that order."""
    ended = lives.survivors(written.withColumn("id_born", F.col("born")))
    way = F.reverse(F.transform("to_steps", lambda s: s["seq"]))
    ended = materialize(ended.withColumn("way", way).drop("to_steps", "id_born"), "ended")
    roots = ended.where(F.size("way") == 0)
    taken = ended.withColumn("metadata", F.col("all_metadata"))
    absorbed = [_absorbed(taken, "metadata", F.col("way"))]
    if "aliases" in facts.columns:
        absorbed.append(_absorbed(ended.withColumn("aliases", F.col("old.aliases")), "aliases", alias_rank("value")))
    for maps in absorbed:
        roots = roots.join(maps, ["user_id", "to"], "left")
    fresh = F.col("born") != FOUND
    columns = {
        "user_id": F.col("user_id"),
        "id": F.col("id"),
        "title": F.coalesce("new_title", "old.title"),
        "text": F.coalesce("new_text", "old.text"),
        "category": F.coalesce("new_category", "old.category"),
        "updated_at": F.coalesce("new_updated_at", "old.updated_at"),
        "ts": F.when(fresh, F.col("new_ts")).otherwise(F.col("old.ts")),
        "metadata": F.coalesce("metadata", F.col("all_metadata")),
    }
    if "aliases" in facts.columns:
        columns["aliases"] = F.coalesce("aliases", F.col("old.aliases"))
    kinds = {f.name: f.dataType for f in facts.schema.fields}
    given = {c: columns.get(c, F.col(f"old.{c}")) for c in facts.columns}
    selected = [(value if kinds[c].typeName() == "map" else value.cast(kinds[c])).alias(c) for c, value in given.items()]
    touched = fresh | F.col("new_title").isNotNull() | F.col("new_text").isNotNull()
    return roots.select(*selected, touched.alias("touched"), fresh.alias("fresh"))


def _moves(state: Column, move: Column) -> Column:
    """The next place of an edge: one of its ends, or both of a loop, become another life."""
    last = F.element_at(state, -1)
    src = F.when(move["end"] == "src", move["to"]).otherwise(last["src"])
    dst = F.when(move["end"] == "dst", move["to"]).otherwise(last["dst"])
    return F.concat(state, F.array(F.struct(move["seq"].alias("seq"), src.alias("src"), dst.alias("dst"))))


def merged_edges(edges: DataFrame, links: DataFrame) -> DataFrame:
    """Edges that touch merged ids, after the log.

    ``edges`` (user_id, src, src_born, rel, dst, dst_born, src_steps, dst_steps, props) were there before, ``links`` (the same
    and seq) were asked for later; all ends live on. An edge is a place (life, type, life) with what was written there. A merge moves it to
    the place of the master, unless an edge is there already: then the moved one is dropped with all it holds. An edge
    whose ends become one vanishes. So what was written at a place counts at the end if, on each step of its way, it was the first to arrive."""
    place = ["user_id", "rel", "src", "dst"]
    found = edges.withColumn("seq", F.lit(FOUND).cast("long"))
    rows = found.unionByName(links.select(*found.columns))
    life = lambda c: F.struct(F.col(c).alias("id"), F.col(f"{c}_born").cast("long").alias("born"))
    way = lambda c: F.transform(
        f"{c}_steps", lambda s: F.struct(s["seq"].alias("seq"), F.lit(c).alias("end"), F.struct(s["id"].alias("id"), s["born"].alias("born")).alias("to"))
    )
    rows = rows.select(
        "user_id", "rel", life("src").alias("src"), life("dst").alias("dst"), "seq", "props",
        F.array_sort(F.concat(way("src"), way("dst"))).alias("moves"),
    )
    first = F.struct(F.lit(FOUND).cast("long").alias("seq"), "src", "dst")
    visits = F.slice(F.aggregate("moves", F.array(first), _moves), F.lit(2), F.size("moves") + 1)
    rows = rows.withColumn("visits", visits).drop("moves")
    rows = rows.where(~F.exists("visits", lambda v: v["src"] == v["dst"]))
    rows = materialize(rows, "edge-writes")

    nodes = rows.groupBy(*place).agg(F.min("seq").alias("since"), F.first("visits").alias("visits"))
    nodes = materialize(nodes, "edge-places")
    steps = nodes.select("user_id", "rel", F.col("src").alias("from_src"), F.col("dst").alias("from_dst"), F.explode("visits").alias("v"))
    steps = steps.select("user_id", "rel", "from_src", "from_dst", F.col("v.src").alias("src"), F.col("v.dst").alias("dst"), "v.seq")
    arrivals = nodes.select(*place, F.col("since").alias("seq")).unionByName(steps.select(*place, "seq"))
    since = arrivals.groupBy(*place).agg(F.min("seq").alias("since"))
    late = steps.join(since, place).where("seq > since")
    late = late.select("user_id", "rel", F.col("from_src").alias("src"), F.col("from_dst").alias("dst")).distinct()

    last = F.try_element_at("visits", F.lit(-1))
    end = [F.coalesce(last[e], F.col(e))["id"].alias(f"end_{e}") for e in ("src", "dst")]
    to = ["user_id", "rel", "end_src", "end_dst"]
    entries = rows.join(late, place, "left_anti").select("user_id", "rel", *end, "seq", F.explode("props").alias("k", "v"))
    entries = entries.groupBy(*to, "k").agg(F.max(F.struct("seq", "v")).alias("w"))
    maps = entries.groupBy(*to).agg(F.map_from_entries(F.collect_list(F.struct("k", "w.v"))).alias("props"))
    kept = nodes.select("user_id", "rel", *end).distinct().join(maps, to, "left")
    none = F.create_map().cast("map<string,string>")
    return kept.select("user_id", F.col("end_src").alias("src"), "rel", F.col("end_dst").alias("dst"), F.coalesce("props", none).alias("props"))


def _end_lives(rows: DataFrame, end: str, ids: DataFrame, lives: Lives, others: DataFrame, asked: bool) -> DataFrame:
    """Edges whose ``end`` lives on: adds its life (``<end>_born``), the id it ends in and its steps. Ends that no merge
    names come from ``others`` (user_id, id, born), their lives after the log."""
    named = ids.select("user_id", F.col("id").alias(end), F.lit(True).alias("named"))
    rows = materialize(rows.join(named, ["user_id", end], "left"), "ends")
    busy = rows.where("named").drop("named")
    busy = lives.at(busy, end) if asked else busy.withColumn(f"{end}_born", F.lit(FOUND).cast("long"))
    busy = lives.survivors(busy, end, "_to").withColumnRenamed("_to_steps", f"{end}_steps").drop("_to", "_to_born")
    quiet = rows.where("named is null").drop("named")
    none = F.array().cast(lives.steps.schema["steps"].dataType)
    if asked:
        alive = others.select("user_id", F.col("id").alias(end), F.col("born").cast("long").alias(f"{end}_born"))
        quiet = quiet.join(alive, ["user_id", end]).where(F.col("seq") > F.col(f"{end}_born"))
    else:
        quiet = quiet.withColumn(f"{end}_born", F.lit(FOUND).cast("long"))
    return busy.unionByName(quiet.withColumn(f"{end}_steps", none))


def apply_merging_log(snapshot: Snapshot, changes: DataFrame, embed=None) -> Snapshot:
    """All tables after a log with merges; see ``changes.apply_changes``."""
    requests = materialize(merge_requests(changes), "merge-requests")
    ids = materialize(merged_ids(requests), "merged-ids")
    lives = lives_of_log(snapshot.facts, changes, requests, ids)

    is_link = F.col("op") == "link"
    links = changes.where(is_link)
    quiet_links = _without_ids(_without_ids(links, ids, "src"), ids, "dst")
    about_facts = changes.where(F.col("op").isin("add", "update", "delete"))
    quiet_changes = _without_ids(about_facts, ids).unionByName(quiet_links)
    parts = {"facts": _without_ids(snapshot.facts, ids)}
    parts["edges"] = materialize(_without_ids(_without_ids(snapshot.edges, ids, "src"), ids, "dst"), "quiet-edges")
    parts["vectors"] = None if snapshot.vectors is None else _without_ids(snapshot.vectors, ids)
    parts["mentions"] = None if snapshot.mentions is None else _without_ids(snapshot.mentions, ids, "fact_id")
    quiet = plain.apply_plain_changes(Snapshot(**parts), quiet_changes, embed)

    written = materialize(written_lives(snapshot.facts, changes, ids, lives), "written")
    busy = materialize(merged_facts(snapshot.facts, written, lives), "merged-facts")
    facts = quiet.facts.unionByName(busy.select(*snapshot.facts.columns))

    folded = materialize(plain.fold_facts(_without_ids(about_facts, ids)), "folded")
    touching = [_of_ids(snapshot.edges, ids, "src"), _of_ids(_without_ids(snapshot.edges, ids, "src"), ids, "dst")]
    found = plain.without_ends(touching[0].unionByName(touching[1]), plain.detached(folded), ["src", "dst"])
    asked = _of_ids(links, ids, "src").unionByName(_of_ids(_without_ids(links, ids, "src"), ids, "dst"))
    asked = asked.select(F.col("seq").cast("long").alias("seq"), "user_id", "src", relation_type("rel").alias("rel"), "dst", "props")
    named = asked.select("user_id", F.explode(F.array("src", "dst")).alias("id")).distinct()
    others = plain.living_ends(_without_ids(named, ids), snapshot.facts, folded)
    for end in ("src", "dst"):
        found = _end_lives(found, end, ids, lives, others, asked=False)
        asked = _end_lives(asked, end, ids, lives, others, asked=True)
    edges = quiet.edges.unionByName(merged_edges(found, asked).select(*quiet.edges.columns))

    mentions = None
    if snapshot.mentions is not None:
        named = _of_ids(snapshot.mentions, ids, "fact_id").withColumn("fact_id_born", F.lit(FOUND).cast("long"))
        moved = lives.survivors(named, "fact_id").select("user_id", "diary_id", F.col("to").alias("fact_id")).distinct()
        mentions = quiet.mentions.unionByName(moved)

    vectors = None
    if snapshot.vectors is not None:
        columns = snapshot.vectors.columns
        named = _of_ids(snapshot.vectors, ids)
        same = named.drop("category").join(busy.where("not touched").select(*KEY, "category"), KEY).select(*columns)
        unknown = named.join(snapshot.facts.select(*KEY), KEY, "left_anti").join(busy.select(*KEY), KEY, "left_anti")
        vectors = quiet.vectors.unionByName(same).unionByName(unknown.select(*columns))
        if embed is not None:
            new = busy.where("touched")
            embedded = embed(new.select(*KEY, "title", "text")).join(new.select(*KEY, "category"), KEY)
            vectors = vectors.unionByName(embedded.select(*columns))
    return Snapshot(facts=facts, edges=edges, vectors=vectors, mentions=mentions)
