"""Session settings and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback_roots: dict[str, str] = {}


def build_session(app_name: str = "factloom", **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        # Call sites in error messages cost a round trip per column expression.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and everything runs in one process (tests) a temporary folder
    stands in. On a cluster each executor would write to a folder of its own and rows would
    be missing when they are read back, so there an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if configured:
        return f"{configured.rstrip('/')}/{app}"
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if app not in _fallback_roots:
        _fallback_roots[app] = tempfile.mkdtemp(prefix="spark-")
    return _fallback_roots[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application materialized; call it when no result is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str, plain: bool = False) -> DataFrame:
    """Write ``df`` once to the scratch area and read it back.

    This cuts the lineage, survives the loss of executors, and gives the planner a size for choosing join
    strategies: that of the files. Rows that repeat themselves (pairs, candidates) take a hundredth of their memory in
    files, and millions of them would be broadcast; ``plain`` stores them without compression, so that the size is true.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write
    if plain:
        writer = writer.option("compression", "none").option("parquet.enable.dictionary", "false")
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
