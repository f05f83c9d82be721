"""Refreshing the tables from newly landed pages as a stream.

Each trigger takes the pages that arrived since the last one and merges them like a batch run.
The merge is repeatable, so a batch that runs again after a failure changes nothing. It reads and writes
only the buckets of the tables that the batch touches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from titleworks.operators.cleaning import prepare
from titleworks.plans.pipeline import Store, page_records
from titleworks.schemas import PAGE
from titleworks.session import settle


def landed_pages(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PAGE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder).withColumn("_landed", F.col("_metadata.file_modification_time"))


def refresh(pages: DataFrame, store: Store, reference: DataFrame, checkpoint: str) -> StreamingQuery:
    """Merge everything that has landed, then stop."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        usable = batch.where("data is not null")
        records = settle(prepare(page_records(usable)), "refresh")
        if records.isEmpty():
            return
        # A name of its own for every attempt: readers keep the folder they have opened, and neither a
        # repeated batch nor a new checkpoint can write over a run that is logged as finished.
        run_id = f"refresh-{batch_id:06d}-{uuid.uuid4().hex}"
        store.merge(run_id, store.newest(), records, reference)
        now = store.spark.sql("select current_timestamp()").first()[0]
        store.log(
            run_id=run_id, started_at=now, finished_at=now, base_source="none", api_pages_requested=0,
            api_pages_failed=0, anime_upserted=records.count(), status="success", message="refresh",
        )

    return (
        pages.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
