"""Resumable ingestion: new documents of a stream of files are appended once; what is derived from them is renewed for the filings they touch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def first_rows(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key, the least by all its columns, so that a batch that is run again keeps the same."""
    w = Window.partitionBy(key).orderBy(*[F.col(c) for c in rows.columns])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def ingest(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str, key: str = "doc_id", bucket: int = 64, after: Callable[[DataFrame, int], None] | None = None, progress: str | None = None) -> None:
    """Appends what the JSON-lines folder holds and the Parquet store lacks by its key; files seen before are skipped by the checkpoint.

    The store is kept in folders by a hash of the key, so a batch looks only into those that its own keys fall in. Each row is stamped
    with the time it was ingested, beside the times it tells itself. after(new, batch): what is to be done with the new rows.
    progress: a folder of one JSON row per batch with its number, rows read and rows added.
    """
    folder = F.pmod(F.xxhash64(key), F.lit(bucket)).cast("int")

    def append(batch: DataFrame, number: int) -> None:
        new = first_rows(batch.filter(F.col(key).isNotNull()), key).withColumn("_bucket", folder)
        if exists(spark, store):
            touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most the number of folders
            held = spark.read.parquet(store).filter(F.col("_bucket").isin(touched)).select(key)
            new = new.join(held, key, "left_anti")
        new = new.withColumn("ingested_at", F.current_timestamp()).persist()
        try:
            new.write.mode("append").partitionBy("_bucket").parquet(store)
            if after is not None:
                after(new.drop("_bucket"), number)
            if progress is not None:
                told = spark.range(1).select(F.lit(number).alias("batch"), F.lit(batch.count()).alias("read"), F.lit(new.count()).alias("added"))
                told.coalesce(1).write.mode("append").json(progress)
        finally:
            new.unpersist()

    stream = spark.readStream.schema(schema).json(source)
    stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replace_summaries(rows: DataFrame, touched: DataFrame, store: str, key: str, summarise: Callable[[DataFrame], DataFrame]) -> None:
    """Makes the summaries of touched(key) anew from all their raw rows and writes them over the old ones; raw rows and other summaries stay.

    Summaries are kept in folders by a hash of the key; those folders that hold a touched key are written again.
    """
    spark = rows.sparkSession
    folder = F.pmod(F.xxhash64(key), F.lit(16)).cast("int")
    keys = touched.select(key).distinct()
    made = summarise(rows.join(keys, key, "left_semi")).withColumn("_bucket", folder)
    if exists(spark, store):
        buckets = [r[0] for r in keys.select(folder.alias("b")).distinct().collect()]  # at most 16
        kept = spark.read.parquet(store).filter(F.col("_bucket").isin(buckets)).join(keys, key, "left_anti")
        made = made.unionByName(kept.select(*made.columns))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{store}.new")
    saved = spark.read.parquet(f"{store}.new")
    saved.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(store)


def as_of(rows: DataFrame, valid: Column, known: Column, at: Column, seen: Column) -> DataFrame:
    """Facts that held at one time as far as they were known at another: valid from and ingested by then."""
    return rows.filter((valid <= at) & (known <= seen))
