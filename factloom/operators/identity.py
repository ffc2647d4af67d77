"""Who a fact is at a moment: lives of ids in a log that also merges facts.

An id may be added, deleted, merged into another and added again; each stretch between is a **life**, named by
(user_id, id, born), where born is the seq of its add, or -1 for a fact the log found. A merge ends the life of
the duplicate and hands it to the life that the master has at that moment. So every other row of the log
belongs to the life its id has at its seq, and what became of a life at the end is a walk up a forest.

Rows are attached to lives by sorting ranges of (user_id, id, seq) and carrying the last state forward
(``carry_forward``), so an id that a large part of the log is about spreads over many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.ranking import carry_forward
from factloom.session import materialize

KEY = ["user_id", "id"]
LIFE = [*KEY, "born"]
FOUND = -1  # born of the facts that the log found


def merge_requests(changes: DataFrame) -> DataFrame:
    """Merges of the log: seq, user_id, master_id, dup_id."""
    if "dup_id" not in changes.columns:
        return changes.where("false").select("seq", "user_id", F.col("id").alias("master_id"), F.col("id").alias("dup_id"))
    asked = changes.where((F.col("op") == "merge") & (F.col("id") != F.col("dup_id")))
    return asked.select("seq", "user_id", F.col("id").alias("master_id"), "dup_id")


def merged_ids(requests: DataFrame) -> DataFrame:
    """Ids that any merge names: user_id, id."""
    return requests.select("user_id", F.explode(F.array("master_id", "dup_id")).alias("id")).distinct()


def _state(kind: str, born: Column | None = None) -> Column:
    born = F.lit(None) if born is None else born
    return F.struct(F.lit(kind).alias("kind"), born.cast("long").alias("born")).alias("state")


@dataclass(frozen=True)
class Lives:
    """What is known about the ids that merges name.

    events: (user_id, id, seq, state), each change of state, state being alive with its born, or dead.
    steps: (user_id, id, born, steps), the lives that were merged, with the lives they became one after the other:
    steps is an array of (seq, id, born) in ascending order."""

    events: DataFrame
    steps: DataFrame

    def at(self, rows: DataFrame, column: str = "id") -> DataFrame:
        """Add ``<column>_born``: the life that ``column`` has just before seq. Rows of ids without a life then are dropped."""
        others = [c for c in rows.columns if c not in ("user_id", column, "seq")]
        probes = rows.select("user_id", F.col(column).alias("id"), "seq", F.struct(*others).alias("row"), F.lit(0).alias("turn"))
        events = self.events.select(*KEY, "seq", "state", F.lit(1).alias("turn"))
        timeline = probes.unionByName(events, allowMissingColumns=True)
        known = carry_forward(timeline, KEY, ["seq", "turn"], "state", "before")
        known = known.where((F.col("turn") == 0) & (F.col("before.kind") == "alive"))
        return known.select("user_id", F.col("id").alias(column), "seq", "row.*", F.col("before.born").alias(f"{column}_born"))

    def fates(self) -> DataFrame:
        """The last state of each id: user_id, id, last."""
        return self.events.groupBy(*KEY).agg(F.max_by("state", "seq").alias("last"))

    def survivors(self, rows: DataFrame, column: str = "id", to: str = "to") -> DataFrame:
        """Rows whose life (user_id, ``column``, ``<column>_born``) lives on, as itself or as a master: adds ``<to>`` and
        ``<to>_born``, the life it ended in, and ``<to>_steps``, the way there. An id that neither the facts nor the log know stays as it is."""
        born = f"{column}_born"
        way = self.steps.select("user_id", F.col("id").alias(column), F.col("born").alias(born), F.col("steps").alias("way"))
        moved = rows.join(way, ["user_id", column, born], "left")
        end = F.element_at("way", -1)
        moved = moved.withColumn(to, F.coalesce(end["id"], F.col(column))).withColumn(f"{to}_born", F.coalesce(end["born"], F.col(born)))
        fates = self.fates().select("user_id", F.col("id").alias(to), "last")
        moved = moved.join(fates, ["user_id", to], "left")
        lives = (F.col("last.kind") == "alive") & (F.col("last.born") == F.col(f"{to}_born"))
        lives = F.when(F.col("last").isNull(), F.col(f"{to}_born") == FOUND).otherwise(lives)
        none = F.array().cast(self.steps.schema["steps"].dataType)
        return moved.where(lives).withColumn(f"{to}_steps", F.coalesce("way", none)).drop("way", "last")


def _judged(timeline: DataFrame, asked: DataFrame) -> DataFrame:
    """State of both ends of each merge just before it: adds master and dup."""
    known = carry_forward(timeline, KEY, ["seq", "turn"], "state", "before").where("end is not null")
    ends = known.groupBy("user_id", "seq").agg(
        F.max(F.when(F.col("end") == "master", F.col("before"))).alias("master"),
        F.max(F.when(F.col("end") == "dup", F.col("before"))).alias("dup"),
    )
    return asked.join(ends, ["user_id", "seq"], "left")


def lives_of_log(facts: DataFrame, changes: DataFrame, requests: DataFrame, ids: DataFrame) -> Lives:
    """Lives of ``ids`` under the adds, deletes and merges of the log.

    A merge takes effect if master and duplicate both live at its seq. Whether they do may depend on earlier
    merges of the same ids as duplicates, so merges are decided in rounds: one waits only while the last event
    before it is a merge that is itself undecided. Chains (3 into 2, then 2 into 1) do not wait; repeated or
    contradicting requests do, and each round decides the first of them."""
    found = facts.select(*KEY).join(ids, KEY, "left_semi")
    events = found.select(*KEY, F.lit(FOUND).cast("long").alias("seq"), _state("alive", F.lit(FOUND)))
    log = changes.where(F.col("op").isin("add", "delete")).select(*KEY, F.col("seq").cast("long").alias("seq"), "op")
    log = log.join(ids, KEY, "left_semi")
    state = F.when(F.col("op") == "add", _state("alive", F.col("seq"))).otherwise(_state("dead"))
    events = materialize(events.unionByName(log.select(*KEY, "seq", state.alias("state"))), "state-events")

    undecided, valid = requests.select("user_id", F.col("seq").cast("long").alias("seq"), "master_id", "dup_id"), None
    while True:
        named = [("master", "master_id"), ("dup", "dup_id")]
        ends = F.explode(F.array(*[F.struct(F.lit(n).alias("end"), F.col(c).alias("id")) for n, c in named])).alias("e")
        probes = undecided.select("user_id", "seq", ends).select("user_id", "e.id", "seq", "e.end", F.lit(0).alias("turn"))
        waiting = undecided.select("user_id", F.col("dup_id").alias("id"), "seq", _state("open"), F.lit(1).alias("turn"))
        timeline = events.withColumn("turn", F.lit(1)).unionByName(waiting).unionByName(probes, allowMissingColumns=True)
        judged = materialize(_judged(timeline, undecided), "judged")
        alive = (F.col("master.kind") == "alive") & (F.col("dup.kind") == "alive")
        dead = F.coalesce(F.col("master.kind") == "dead", F.lit(True)) | F.coalesce(F.col("dup.kind") == "dead", F.lit(True))
        new = judged.where(alive & ~dead)
        ended = new.select("user_id", F.col("dup_id").alias("id"), "seq", _state("dead"))
        new = new.select("user_id", "seq", "master_id", F.col("master.born").alias("master_born"), "dup_id", F.col("dup.born").alias("dup_born"))
        valid = new if valid is None else valid.unionByName(new)
        events = events.unionByName(ended)
        undecided = judged.where(~alive & ~dead).select("user_id", "seq", "master_id", "dup_id")
        if not undecided.take(1):
            return Lives(materialize(events, "state-events"), forest(materialize(valid, "merges")))


def forest(merges: DataFrame) -> DataFrame:
    """(user_id, id, born, steps) of every merged life: the lives it became, by pointer jumping over the merges."""
    step = F.struct("seq", F.col("master_id").alias("id"), F.col("master_born").alias("born"))
    lives = merges.select("user_id", F.col("dup_id").alias("id"), F.col("dup_born").alias("born"), F.array(step).alias("steps"))
    lives = materialize(lives, "steps")
    while True:
        end = F.element_at("steps", -1)
        walking = lives.withColumn("end_id", end["id"]).withColumn("end_born", end["born"])
        further = lives.select("user_id", F.col("id").alias("end_id"), F.col("born").alias("end_born"), F.col("steps").alias("rest"))
        walked = walking.join(further, ["user_id", "end_id", "end_born"], "left")
        walked = materialize(walked.select(*LIFE, "steps", "rest"), "steps")
        if not walked.where("rest is not null").take(1):
            return lives
        lives = walked.select(*LIFE, F.when(F.col("rest").isNull(), F.col("steps")).otherwise(F.concat("steps", "rest")).alias("steps"))
