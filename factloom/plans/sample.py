"""The data model filled from the sample tables, as DataFrames.

Every view covers its whole source tables. There are four tenants at any scale, so each
holds a quarter of all rows: the tests run on hot keys all the time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators.joins import by_sorting
from factloom.sources.tables import Snapshot

TENANTS = 4


class Sample:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table that much is computed on: a few small files are spread over the cores, or all shuffle partitions."""
        df = self.table(name)
        if df.isStreaming:
            return df
        cores = self.spark.sparkContext.defaultParallelism
        if df.rdd.getNumPartitions() >= cores:
            return df
        return df.repartition(max(cores, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), df.columns[0])

    def facts(self, part: DataFrame | None = None) -> DataFrame:
        """Every part is a fact; its type is the category."""
        second_word = F.split_part("p_name", F.lit(" "), F.lit(2))
        brand = F.create_map(F.lit("brand"), F.col("p_brand"))
        sized = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
        # A part takes ten bytes in its file: millions are in one split, and what a task makes of them is not small.
        part = self.spread("part") if part is None else part
        return part.select(
            (F.col("p_partkey") % TENANTS).alias("user_id"),
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("title"),
            F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("text"),
            F.col("p_type").alias("category"),
            F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, int(p_partkey), 0)").alias("ts"),
            F.lit(None).cast("timestamp_ntz").alias("updated_at"),
            F.when(F.col("p_size") >= 10, sized).otherwise(brand).alias("metadata"),
            F.create_map("p_brand", F.lit("0.9"), second_word, F.lit("0.5")).alias("aliases"),
        )

    def vectors(self) -> DataFrame:
        """Facts that have an embedding."""
        embedded = self.spread("embeddings").select(F.col("vec_id").alias("id"), "embedding")
        return by_sorting(self.facts().select("user_id", "id", "category")).join(embedded, "id")

    def edges(self) -> DataFrame:
        """Parts on neighbouring lines of an order, if they belong to the same tenant.

        Lines are moved once, by their order: an order has few, and they are reduced and put beside the next one where they are.
        """
        lines = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
        lines = (
            lines.where("l_orderkey is not null and l_linenumber is not null")
            .repartition("l_orderkey")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(F.min("l_partkey").alias("part"), F.char(F.min(F.ascii("l_returnflag"))).alias("flag"))
        )
        following = F.lead(F.struct("l_linenumber", "part")).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
        pairs = lines.withColumn("next", following).where(F.col("next.l_linenumber") == F.col("l_linenumber") + F.lit(1).cast("long"))
        pairs = pairs.select("part", "flag", F.col("next.part").alias("dst")).where(
            (F.col("part") != F.col("dst")) & (F.col("part") % TENANTS == F.col("dst") % TENANTS)
        )
        return (
            pairs.groupBy(
                (F.col("part") % TENANTS).alias("user_id"),
                F.col("part").alias("src"),
                F.concat(F.lit("BOUGHT_"), "flag").alias("rel"),
                "dst",
            )
            .agg(F.count("*").cast("string").alias("n"))
            .withColumn("props", F.create_map(F.lit("orders"), F.col("n")))
            .drop("n")
        )

    def queries(self) -> DataFrame:
        """Every embedded fact asks for its title; large parts ask within their category."""
        part = by_sorting(self.table("part")).join(self.table("embeddings"), F.col("p_partkey") == F.col("vec_id"))
        return part.select(
            F.col("p_partkey").alias("query_id"),
            (F.col("p_partkey") % TENANTS).alias("user_id"),
            F.col("p_name").alias("query"),
            F.col("embedding").alias("vec"),
            F.when(F.col("p_size") > 25, F.col("p_type")).alias("category"),
        )

    def diary(self) -> DataFrame:
        """Every document is a diary entry; two entries of a tenant share a date."""
        day = F.floor(F.col("doc_id") / 8) % 3650
        return self.spread("documents").select(
            (F.col("doc_id") % TENANTS).alias("user_id"),
            F.col("doc_id").alias("id"),
            F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("date"),
            F.col("text").alias("content"),
            F.lit(None).cast("timestamp_ntz").alias("ts"),
        )

    def diary_vectors(self) -> DataFrame:
        embedded = self.table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
        ids = self.table("documents").select((F.col("doc_id") % TENANTS).alias("user_id"), F.col("doc_id").alias("id"))
        return ids.join(embedded, "id")

    def names(self) -> DataFrame:
        """Every benchmark passage is a name that each tenant knows."""
        tenants = F.explode(F.sequence(F.lit(0), F.lit(TENANTS - 1))).alias("tenant")
        return self.table("benchmark").select("item_id", "text", tenants).select(
            F.col("tenant").cast("long").alias("user_id"),
            (F.col("item_id") * TENANTS + F.col("tenant")).alias("id"),
            F.lit("People").alias("category"),
            F.lit(None).cast("string").alias("title"),
            "text",
        )

    def turns(self) -> DataFrame:
        return self.spread("conversations").select("conv_id", "turn", F.col("role").alias("speaker"), "text")

    def changes(self, *kept: str) -> DataFrame:
        """Every event is a change: five in a row concern the same part. Columns ``kept`` of the event stay beside it."""
        base = F.floor(F.col("event_id") / 5)
        k = F.get_json_object("props", "$.k")
        kind = F.col("event_type")
        stranger = F.when((F.col("value") < 1) & (kind != "signup"), TENANTS).otherwise(0)
        op = (
            F.when(kind == "signup", "add")
            .when(kind == "click", "link")
            .when((kind == "error") & (F.col("value") >= 15), "delete")
            .otherwise("update")
        )
        number = F.col("event_id").cast("string")
        return self.table("events").select(
            F.col("event_id").alias("seq"),
            "ts",
            (base % TENANTS + stranger).alias("user_id"),
            op.alias("op"),
            F.when(kind == "signup", -1 - F.col("event_id")).otherwise(base).alias("id"),
            F.when(kind == "signup", F.concat(F.lit("new "), number))
            .when(kind == "purchase", F.concat(F.lit("title "), number))
            .alias("title"),
            F.when(kind == "signup", F.concat(F.lit("signup of "), F.col("user_id").cast("string")))
            .when(kind == "view", F.concat(F.lit("seen "), number))
            .alias("text"),
            F.when(kind == "signup", "general").when(kind == "error", " pEOPLE ").alias("category"),
            F.when(kind.isin("purchase", "view"), F.create_map(F.lit("k"), k)).alias("metadata"),
            F.when(kind == "click", base).alias("src"),
            F.when(kind == "click", base + TENANTS).alias("dst"),
            F.when(kind == "click", "works on").alias("rel"),
            F.when(kind == "click", F.create_map(F.lit("k"), k)).alias("props"),
            *kept,
        )

    def merging_changes(self) -> DataFrame:
        """The changes, except that errors of middling value merge the part after next of the tenant into theirs."""
        log = self.changes("event_type", "value")
        merging = (F.col("event_type") == "error") & (F.col("value") >= 8) & (F.col("value") < 15)
        log = log.withColumn("dup_id", F.when(merging, F.col("id") + TENANTS))
        log = log.withColumn("op", F.when(merging, "merge").otherwise(F.col("op")))
        title = F.when(merging, F.concat(F.lit("merged "), F.col("seq").cast("string"))).otherwise(F.col("title"))
        return log.withColumn("title", title).drop("event_type", "value")

    def view_requests(self) -> DataFrame:
        """Facts somebody looked at: the seeds of neighbourhoods."""
        base = F.floor(F.col("event_id") / 5)
        views = self.table("events").where(F.col("event_type") == "view")
        return views.select((base % TENANTS).alias("user_id"), base.alias("seed")).distinct()

    def snapshot(self) -> Snapshot:
        return Snapshot(facts=self.facts(), edges=self.edges(), vectors=self.vectors())
