"""Scans of item streams: each micro-batch writes its findings, then its journal, so a batch that failed runs again whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veldt.operators import resume
from veldt.plans import scan
from veldt.plans.catalogue import Catalogue


def scan_stream(items: DataFrame, catalogue: Catalogue, out: str, journal: str, checkpoint: str, scope: str, options: scan.Options = scan.Options()) -> StreamingQuery:
    """Findings of new or changed items under `out`, by batch; a batch's files replace what an earlier try of it left. Items that
    couldn't be read in full (is_complete is false) aren't journalled, so a later batch that has them again reads them again."""
    spark = items.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        once = batch.dropDuplicates(["item_id", "version"])
        fresh = resume.unseen(once, spark.read.schema("scope string, fingerprint string").parquet(f"{journal}/*"), scope) if _has(spark, journal) else once.withColumn("fingerprint", resume.fingerprint())
        scan.findings(fresh, catalogue, options).write.mode("overwrite").parquet(f"{out}/batch={number}")
        whole = fresh.filter("is_complete") if "is_complete" in fresh.columns else fresh
        whole.select(F.lit(scope).alias("scope"), "fingerprint").write.mode("overwrite").parquet(f"{journal}/batch={number}")

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _has(spark, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def change_feed(rows: DataFrame, time: str, delay: str = "1 hour", key: tuple[str, ...] = ("item_id", "version")) -> DataFrame:
    """A stream of changed items, each version once within the watermark."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))
