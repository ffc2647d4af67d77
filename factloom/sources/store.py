"""Versions of the tables as base and delta files that a manifest names.

A batch of changes costs what it touches: only rows that a change may concern are worked on, and only those that
come out different are written, as a delta (a row per key, or a mark that the key is gone). Folders
are written once under a name of their own and never renamed or overwritten, so an attempt that failed leaves nothing that anybody
reads: a version exists when its manifest is complete. The manifest also holds the number of files of each folder,
so that a lost file is an error and not fewer rows. Keys of each table (``KEYS``) must be unique and without nulls.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.changes import apply_changes
from factloom.session import materialize
from factloom.sources.tables import Snapshot, write_table

KEYS = {
    "facts": ["user_id", "id"],
    "edges": ["user_id", "src", "rel", "dst"],
    "vectors": ["user_id", "id"],
    "mentions": ["user_id", "diary_id", "fact_id"],
}
_MANIFEST = "name string, position int, folder string, files int, n_rows bigint"


@dataclass(frozen=True)
class Part:
    """A folder of a table: its base (position 0) or a delta; later positions win."""

    name: str
    position: int
    folder: str
    files: int
    n_rows: int


def _manifest_path(root: str, version: int) -> str:
    return f"{root}/manifest/version={version}"


def _names(spark: SparkSession, path: str) -> list[str]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [status.getPath().getName() for status in files.listStatus(folder)] if files.exists(folder) else []


def has_version(spark: SparkSession, root: str, version: int) -> bool:
    return "_SUCCESS" in _names(spark, _manifest_path(root, version))


def last_version(spark: SparkSession, root: str) -> int:
    """The newest complete version; a store without one is an error."""
    found = [re.fullmatch(r"version=(\d+)", name) for name in _names(spark, f"{root}/manifest")]
    for version in sorted((int(m[1]) for m in found if m), reverse=True):
        if has_version(spark, root, version):
            return version
    raise FileNotFoundError(f"no version of a store in {root}")


def read_manifest(spark: SparkSession, root: str, version: int) -> list[Part]:
    """The parts of a version: a few rows for each table."""
    rows = spark.read.schema(_MANIFEST).json(_manifest_path(root, version)).orderBy("name", "position").collect()
    return [Part(**row.asDict()) for row in rows]


def _write_manifest(spark: SparkSession, root: str, version: int, parts: list[Part]) -> None:
    rows = [tuple(getattr(part, f.name) for f in fields(Part)) for part in parts]
    table = spark.createDataFrame(rows, _MANIFEST).coalesce(1)
    table.write.mode("overwrite").json(_manifest_path(root, version))


def _data_files(spark: SparkSession, path: str) -> int:
    return sum(not name.startswith(("_", ".")) for name in _names(spark, path))


def _write_part(df: DataFrame, root: str, name: str, position: int, spread: bool) -> Part:
    folder = f"{name}/{'base' if position == 0 else 'delta'}-{uuid.uuid4().hex}"
    write_table(df, f"{root}/{folder}", name, spread)
    spark = df.sparkSession
    return Part(name, position, folder, _data_files(spark, f"{root}/{folder}"), spark.read.parquet(f"{root}/{folder}").count())


def _read_part(spark: SparkSession, root: str, part: Part) -> DataFrame:
    found = _data_files(spark, f"{root}/{part.folder}")
    if found != part.files:
        raise OSError(f"{part.folder} has {found} files, but {part.files} files were written")
    return spark.read.parquet(f"{root}/{part.folder}")


def _last_rows(deltas: list[DataFrame], key: list[str]) -> DataFrame:
    """Per key the row of the newest delta that has it."""
    if len(deltas) == 1:
        return deltas[0]
    columns = deltas[0].columns
    rows = [df.select(*columns, F.lit(n).alias("_at")) for n, df in enumerate(deltas)]
    last = F.max_by(F.struct(*columns), "_at").alias("_last")
    return reduce(DataFrame.unionByName, rows).groupBy(*key).agg(last).select("_last.*")


def _current(spark: SparkSession, root: str, parts: list[Part]) -> DataFrame:
    base, *deltas = [_read_part(spark, root, part) for part in parts]
    if not deltas:
        return base
    key = KEYS[parts[0].name]
    last = _last_rows(deltas, key)
    # Without a shuffle of the base as long as the keys of the deltas can be broadcast.
    kept = base.join(last.select(*key), key, "left_anti").select(*base.columns)
    return kept.unionByName(last.where(~F.col("_gone")).select(*base.columns))


def _by_table(parts: list[Part]) -> dict[str, list[Part]]:
    named: dict[str, list[Part]] = {}
    for part in sorted(parts, key=lambda p: p.position):
        named.setdefault(part.name, []).append(part)
    return named


def create_store(snapshot: Snapshot, root: str) -> None:
    """Version 0: every table that the snapshot has, as a base. An existing store is an error."""
    spark = snapshot.facts.sparkSession
    if has_version(spark, root, 0):
        raise FileExistsError(f"{root} holds a store")
    given = {f.name: getattr(snapshot, f.name) for f in fields(Snapshot)}
    parts = [_write_part(table, root, name, 0, True) for name, table in given.items() if table is not None]
    _write_manifest(spark, root, 0, parts)


def read_store(spark: SparkSession, root: str, version: int | None = None, tables: tuple[str, ...] | None = None) -> Snapshot:
    """The tables of a version, the newest unless one is given; all tables, or those named."""
    version = last_version(spark, root) if version is None else version
    named = _by_table(read_manifest(spark, root, version))
    return Snapshot(**{name: _current(spark, root, parts) for name, parts in named.items() if tables is None or name in tables})


def _ids(log: DataFrame, *columns: str) -> DataFrame:
    """user_id, id: each id that stands in one of the columns, once."""
    present = [c for c in columns if c in log.columns]
    ids = log.select("user_id", F.explode(F.array(*present)).alias("id"))
    return ids.where("id is not null").distinct()


def concerned(snapshot: Snapshot, log: DataFrame) -> Snapshot:
    """The rows that a log may change, or must see to change others, stored.

    Facts and vectors: those whose id the log names. Edges and mentions: those at a fact that is added, deleted or merged,
    and edges from and to the ends of a link request. An update of a hub concerns none of its edges.
    """
    ids = materialize(_ids(log, "id", "dup_id", "src", "dst"), "named-ids")
    moved = materialize(_ids(log.where(F.col("op").isin("add", "delete", "merge")), "id", "dup_id"), "moved-ids")
    asked = log.where(F.col("op") == "link").select("user_id", "src", "dst").where("src is not null and dst is not null")
    edges = snapshot.edges
    for end in ("src", "dst"):
        edges = edges.join(moved.select("user_id", F.col("id").alias(end), F.lit(True).alias(f"_{end}")), ["user_id", end], "left")
    pairs = materialize(asked.distinct().withColumn("_pair", F.lit(True)), "asked-pairs")
    edges = edges.join(pairs, ["user_id", "src", "dst"], "left").where("_src or _dst or _pair")
    found = {
        "facts": snapshot.facts.join(ids, ["user_id", "id"], "left_semi").select(*snapshot.facts.columns),
        "edges": edges.select(*snapshot.edges.columns),
    }
    if snapshot.vectors is not None:
        found["vectors"] = snapshot.vectors.join(ids, ["user_id", "id"], "left_semi").select(*snapshot.vectors.columns)
    if snapshot.mentions is not None:
        named = moved.withColumnRenamed("id", "fact_id")
        kept = snapshot.mentions.join(named, ["user_id", "fact_id"], "left_semi")
        found["mentions"] = kept.select(*snapshot.mentions.columns)
    return Snapshot(**{name: materialize(df, f"concerned-{name}") for name, df in found.items()})


def _comparable(df: DataFrame) -> Column:
    """All columns of a row as one value that can be compared, which maps cannot."""
    is_map = {f.name: f.dataType.typeName() == "map" for f in df.schema.fields}
    return F.struct(*[(F.array_sort(F.map_entries(c)) if is_map[c] else F.col(c)).alias(c) for c in df.columns])


def delta_between(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``after`` that are new or different, and keys that only ``before`` has: its columns + [_gone]."""
    after = after.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in before.schema.fields])
    old = before.select(*key, _comparable(before).alias("_old"))
    new = after.select(*key, F.struct(*after.columns).alias("_new"), _comparable(after).alias("_value"))
    both = new.join(old, key, "full_outer").where(~F.col("_value").eqNullSafe(F.col("_old")))
    rest = [F.col("_new")[c].alias(c) for c in before.columns if c not in key]
    return both.select(*key, *rest, F.col("_new").isNull().alias("_gone"))


def compacted(spark: SparkSession, root: str, parts: list[Part], most_deltas: int, most_share: float) -> list[Part]:
    """The parts of one table with few deltas: several become one, and a new base once they hold ``most_share`` of its rows."""
    base, *deltas = parts
    if sum(d.n_rows for d in deltas) > most_share * base.n_rows:
        return [_write_part(_current(spark, root, parts), root, base.name, 0, True)]
    if len(deltas) > most_deltas:
        last = _last_rows([_read_part(spark, root, d) for d in deltas], KEYS[base.name])
        return [base, _write_part(last, root, base.name, deltas[-1].position, True)]
    return parts


def commit_changes(
    spark: SparkSession,
    root: str,
    changes: DataFrame,
    version: int | None = None,
    embed=None,
    tables: tuple[str, ...] | None = None,
    most_deltas: int = 8,
    most_share: float = 0.25,
) -> int:
    """Fold a log into ``version`` (the newest unless given) and return the number of the version made of it.

    A version that is already there is left as it is, so a batch may be run again. Tables that are not among ``tables`` are not carried on.
    With ``most_share`` s a row is written at most about 1 + 1 / s times for each time it changes, however many batches there are.
    """
    version = last_version(spark, root) if version is None else version
    if has_version(spark, root, version + 1):
        return version + 1
    named = _by_table(read_manifest(spark, root, version))
    named = {name: parts for name, parts in named.items() if tables is None or name in tables}
    log = materialize(changes, "log")
    before = concerned(Snapshot(**{name: _current(spark, root, parts) for name, parts in named.items()}), log)
    after = apply_changes(before, log, embed)
    result = []
    for name, parts in named.items():
        delta = delta_between(getattr(before, name), getattr(after, name), KEYS[name])
        part = _write_part(delta, root, name, parts[-1].position + 1, False)
        parts = [*parts, part] if part.n_rows else parts
        result += compacted(spark, root, parts, most_deltas, most_share)
    _write_manifest(spark, root, version + 1, result)
    return version + 1


def forget_versions(spark: SparkSession, root: str, before: int) -> None:
    """Delete the versions below ``before`` and all folders that no later one names. Nothing may write meanwhile."""
    last = last_version(spark, root)
    kept = {part.folder for v in range(min(before, last), last + 1) for part in read_manifest(spark, root, v)}
    stale = [f"{name}/{folder}" for name in KEYS for folder in _names(spark, f"{root}/{name}") if f"{name}/{folder}" not in kept]
    versions = [name for name in _names(spark, f"{root}/manifest") if int(name.split("=")[1]) < min(before, last)]
    for folder in [*(f"manifest/{name}" for name in versions), *stale]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
