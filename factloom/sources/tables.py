"""The tables of the data model and how they are stored."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ids are strings in general; a deployment with numeric ids may change their type.
FACTS = "user_id string, id string, title string, text string, category string, ts timestamp, updated_at timestamp, metadata map<string,string>, aliases map<string,string>"
VECTORS = "user_id string, id string, category string, embedding array<float>"
EDGES = "user_id string, src string, rel string, dst string, props map<string,string>"
MENTIONS = "user_id string, diary_id string, fact_id string"
DIARY = "user_id string, id string, date date, content string, ts timestamp"
CHANGES = "seq bigint, ts timestamp, user_id string, op string, id string, title string, text string, category string, metadata map<string,string>, src string, dst string, rel string, props map<string,string>"


@dataclass(frozen=True)
class Snapshot:
    """One version of the tables that change together."""

    facts: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None
    mentions: DataFrame | None = None


# Sort keys of the stored tables: a reader of one tenant or id skips files and row groups
# by their min/max, and a large tenant spreads over many files.
_LAYOUT = {
    "facts": ["user_id", "id"],
    "edges": ["user_id", "src"],
    "vectors": ["user_id", "id"],
    "mentions": ["user_id", "fact_id"],
}
_LOOKED_UP = {"facts": ["id"], "edges": ["src", "dst"], "vectors": ["id"], "mentions": ["fact_id", "diary_id"]}


def write_table(table: DataFrame, path: str, name: str, spread: bool = True) -> None:
    """Write one table of the model in its layout to a new folder; without ``spread`` rows are only sorted where they are.

    Beside the order by keys each row group has Bloom filters of the ids, for lookups that know an id but no tenant
    and for the second key of edges and mentions, which the order does not help.
    """
    keys = _LAYOUT[name]
    table = table.repartitionByRange(*keys) if spread else table
    writer = table.sortWithinPartitions(*keys).write.mode("error")
    for column in _LOOKED_UP[name]:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)


def write_snapshot(snapshot: Snapshot, path: str) -> None:
    """Write all tables below ``path``, which must be new: versions are never overwritten."""
    for field in fields(Snapshot):
        table = getattr(snapshot, field.name)
        if table is not None:
            write_table(table, f"{path}/{field.name}", field.name)


def read_snapshot(spark: SparkSession, path: str, tables: tuple[str, ...] = ("facts", "edges", "vectors", "mentions")) -> Snapshot:
    return Snapshot(**{name: spark.read.parquet(f"{path}/{name}") for name in tables})


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, fmt: str = "json") -> None:
    """Store an exported graph for a viewer."""
    nodes.write.format(fmt).mode("error").save(f"{path}/nodes")
    edges.write.format(fmt).mode("error").save(f"{path}/edges")


def facts_with_ids(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Point lookups as a table: facts whose (user_id, id) is in ``wanted``."""
    return facts.join(wanted.select("user_id", "id").distinct(), ["user_id", "id"], "left_semi")


RECORDS = T.ArrayType(T.MapType(T.StringType(), T.StringType()))


def records_from_json(df: DataFrame, column: str) -> DataFrame:
    """Explode a column of JSON arrays of objects: df without it + [position, record].

    ``record`` maps field names to values as text. Invalid JSON, anything but a list and
    an empty list give no rows.
    """
    value = F.col(column)
    is_list = F.substring(F.ltrim(value), 1, 1) == "["
    other = [c for c in df.columns if c != column]
    listed = F.when(is_list, F.from_json(value, RECORDS))
    return df.select(*other, F.posexplode(listed).alias("position", "record"))
