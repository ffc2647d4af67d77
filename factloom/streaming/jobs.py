"""Structured Streaming versions of the write path.

Each micro-batch goes through the batch operators. Outputs are files named by batch, so
a batch that is run again after a failure replaces what it wrote before.
"""

from __future__ import annotations

from collections.abc import Callable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.duplicates import check_new_facts
from factloom.operators.mentions import link_mentions
from factloom.session import materialize
from factloom.sources.store import commit_changes


def file_stream(spark: SparkSession, path: str, schema, glob: str | None = None) -> DataFrame:
    """A folder of parquet files, or a single one, as a stream."""
    reader = spark.readStream.schema(schema)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if glob is None and place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(place):
        # A stream reads folders: this one, and of its files the one that is named.
        path, glob = place.getParent().toString(), place.getName()
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def stream_mentions(
    entries: DataFrame, facts: DataFrame, out: str, checkpoint: str, **linking
) -> StreamingQuery:
    """Link new diary entries to the facts they name; rows of user_id, diary_id, fact_id below ``out``."""

    def link(batch: DataFrame, batch_id: int) -> None:
        link_mentions(batch, facts, **linking).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return _start(entries, link, checkpoint)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def stream_changes(
    changes: DataFrame, root: str, checkpoint: str, tables: tuple[str, ...] | None = None, embed=None
) -> StreamingQuery:
    """Fold change events into a store (``sources.store``): batch n makes version n + 1 of version n.

    ``root`` holds version 0; all its tables, or those named, are carried on. A batch writes the rows that it changed. One that had
    already made its version is skipped, which makes a rerun harmless; one that failed half way left folders that no manifest names.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        commit_changes(batch.sparkSession, root, batch, batch_id, embed, tables)

    return _start(changes, fold, checkpoint)


def stream_duplicates(
    new_facts: DataFrame,
    facts: DataFrame,
    vectors: DataFrame,
    out: str,
    checkpoint: str,
    threshold: float = 0.85,
) -> StreamingQuery:
    """Check arriving facts against the known ones; rows as from ``check_new_facts`` below ``out``.

    An event that was delivered before (by event_id) is dropped, however late its repeat is; an event
    that is itself late is checked like any other. The ids seen are kept below ``out/_seen``, which
    readers of ``out`` skip; a batch that is run again does not see its own.
    """

    def check(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = batch.dropDuplicates(["event_id"])
        if _exists(spark, f"{out}/_seen"):
            seen = spark.read.parquet(f"{out}/_seen").where(F.col("batch") < batch_id)
            arrived = arrived.join(seen.select("event_id"), "event_id", "left_anti")
        arrived = materialize(arrived.select(*batch.columns), "arrived")
        found = check_new_facts(arrived, facts, vectors, threshold)
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        arrived.select("event_id").write.mode("overwrite").parquet(f"{out}/_seen/batch={batch_id}")

    return _start(new_facts, check, checkpoint)
