"""The load: sources to records to tables, with a run log.

Tables are kept in buckets of their key. A run writes the buckets that its records touch below a folder of its own, then a
manifest that names the newest folder of every bucket, and only then logs success; readers open the manifest of the
newest finished run. A run that dies leaves the last good tables untouched, and so does one that is still writing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from titleworks.operators import merge as G
from titleworks.operators.cleaning import clean_items, clean_snapshot, dropped_counts, prepare_counted, prepared_rows
from titleworks.plans.marts import in_population
from titleworks.schemas import RUNS
from titleworks.session import settle
from titleworks.sources.pages import TOP, failed_pages, read_pages
from titleworks.sources.sinks import _exists
from titleworks.sources.snapshot import read_snapshot

# The tables, and the column whose hash gives a row's bucket; the few tags are one bucket.
KEYS = {"titles": "mal_id", "tags": None, "title_tags": "anime_id", "companies": "name", "title_companies": "anime_id"}
TABLES = tuple(KEYS)
BUCKETS = 16
_MANIFEST = "table_name string, bucket int, folder string, row_schema string"


def load(state: dict[str, DataFrame] | None, records: DataFrame, reference: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Merge prepared records into the tables. Returns the new tables and the unmatched tags.

    Loading the same records again gives the same tables.
    """
    old = state or {}
    tags = G.merge_tags(old.get("tags"), reference)
    matched = G.match_tags(records, reference)
    touched = records.select(F.col("mal_id").alias("anime_id"))
    new = {
        "titles": G.upsert_titles(old.get("titles"), records, F.current_timestamp()),
        "tags": tags,
        "title_tags": G.replace_links(old.get("title_tags"), touched, G.tag_links(matched)),
        "companies": G.merge_companies(old.get("companies"), G.batch_companies(records)),
        "title_companies": G.replace_links(old.get("title_companies"), touched, G.company_links(records)),
    }
    return new, G.unmatched_tags(matched)


@dataclass
class Store:
    """The tables below one folder, each in `buckets` buckets of `files` files."""

    spark: SparkSession
    root: str
    buckets: int = BUCKETS
    files: int = 1

    def runs(self) -> DataFrame:
        """One row per run: its last state."""
        path = f"{self.root}/runs"
        if not _exists(self.spark, path):
            return self.spark.createDataFrame([], RUNS)
        rows = self.spark.read.schema(RUNS).json(path)
        state = F.max_by(F.struct(*rows.columns), F.coalesce("finished_at", F.lit("1970-01-01").cast("timestamp")))
        return rows.groupBy("run_id").agg(state.alias("last")).select("last.*")

    def log(self, **row: object) -> None:
        line = ", ".join(f"{k} {t}" for k, t in (f.split(" ") for f in RUNS.split(", ")) if k in row)
        self.spark.createDataFrame([tuple(row[f.split(" ")[0]] for f in line.split(", "))], line).write.mode("append").json(f"{self.root}/runs")

    def newest(self, before: str | None = None) -> str | None:
        """The newest finished run other than `before`, which is to be rewritten."""
        done = self.runs().where(F.col("status").isin("success", "partial"))
        if before is not None:
            done = done.where(F.col("run_id") != before)
        return done.agg(F.max_by("run_id", "finished_at")).first()[0]

    def current(self, before: str | None = None) -> dict[str, DataFrame] | None:
        """The tables of the newest finished run."""
        newest = self.newest(before)
        return None if newest is None else self.tables(newest)

    def manifest(self, run_id: str) -> list[dict]:
        """One entry a bucket that has rows, with the folder that holds it, and one without a bucket for each table."""
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.root}/run={run_id}/manifest")
        return [r.asDict() for r in rows.collect()]  # at most buckets + 1 for each of the five tables

    def tables(self, run_id: str, touched: dict[str, set[int]] | None = None) -> dict[str, DataFrame]:
        """The tables of a run: all buckets, or those touched."""
        entries = self.manifest(run_id)
        return {name: self._open([e for e in entries if e["table_name"] == name and (touched is None or e["bucket"] is None or e["bucket"] in touched[name])]) for name in TABLES}

    def _open(self, entries: list[dict]) -> DataFrame:
        schema = StructType.fromJson(json.loads(next(e["row_schema"] for e in entries if e["bucket"] is None)))
        folders = [e["folder"] for e in entries if e["bucket"] is not None]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self, name: str, key: str | None = None) -> Column:
        key = key or KEYS[name]
        return F.lit(0) if key is None else F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _buckets_of(self, rows: DataFrame, key: str) -> set[int]:
        return {r[0] for r in rows.select(self._bucket("", key)).distinct().collect()}

    def _put(self, run_id: str, name: str, rows: DataFrame) -> list[dict]:
        """Write a table's rows below the run's folder; the entries of what has been written."""
        folder = f"{self.root}/run={run_id}/{name}"
        split = F.pmod(F.xxhash64(F.lit(1), KEYS[name]), F.lit(self.files)) if KEYS[name] else F.lit(0)
        rows.withColumn("_bucket", self._bucket(name)).repartition("_bucket", split).write.mode("overwrite").partitionBy("_bucket").parquet(folder)
        entries = [{"table_name": name, "bucket": None, "folder": folder, "row_schema": rows.schema.json()}]
        for bucket in range(self.buckets if KEYS[name] else 1):
            if _exists(self.spark, f"{folder}/_bucket={bucket}"):
                entries.append({"table_name": name, "bucket": bucket, "folder": f"{folder}/_bucket={bucket}", "row_schema": None})
        return entries

    def _seal(self, run_id: str, entries: Iterable[dict]) -> None:
        rows = [tuple(e[k] for k in ("table_name", "bucket", "folder", "row_schema")) for e in entries]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.root}/run={run_id}/manifest")

    def write(self, run_id: str, state: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """A run whose tables are all new."""
        self._seal(run_id, [e for name in TABLES for e in self._put(run_id, name, state[name])])
        return self.tables(run_id)

    def adopt(self, run_id: str, base: str) -> None:
        """A run whose tables are those of another one."""
        self._seal(run_id, self.manifest(base))

    def merge(self, run_id: str, base: str | None, records: DataFrame, reference: DataFrame) -> DataFrame:
        """Merge prepared records into the tables of a run, as a new run; the unmatched tags.

        Only buckets with a title or a company of the records are read and written. All others are named again in the
        new manifest, from the folders that hold them. The tags are written if the reference changes one.
        """
        if base is None:
            merged, lost = load(None, records, reference)
            self.write(run_id, merged)
            return lost
        titles = self._buckets_of(records, "mal_id")
        touched = {"titles": titles, "title_tags": titles, "title_companies": titles, "tags": {0}, "companies": self._buckets_of(G.batch_companies(records), "name")}
        stored = self.tables(base, touched)
        merged, lost = load(stored, records, reference)
        if merged["tags"].select(*stored["tags"].columns).exceptAll(stored["tags"]).isEmpty():
            touched["tags"] = set()
        entries = {(e["table_name"], e["bucket"]): e for e in self.manifest(base) if e["bucket"] not in touched[e["table_name"]]}
        for name in TABLES:
            if touched[name]:
                entries |= {(e["table_name"], e["bucket"]): e for e in self._put(run_id, name, merged[name])}
        self._seal(run_id, entries.values())
        return lost


def snapshot_records(spark: SparkSession, path: str) -> DataFrame:
    return clean_snapshot(read_snapshot(spark, path, with_order=True), "kaggle", "_seq")


def page_records(pages: DataFrame) -> DataFrame:
    """Titles of landed pages. Of one that was landed twice the later landing counts, then the later place."""
    landed = "_landed" if "_landed" in pages.columns else F.lit(None).cast("timestamp").alias("_landed")
    items = pages.select("page", landed, F.posexplode("data").alias("position", "item"))
    return clean_items(items.withColumn("_seq", F.struct("_landed", "page", "position")), "api", "_seq")


def run(
    store: Store,
    reference: DataFrame,
    snapshot: str | None = None,
    pages_folder: str | None = None,
    pages: int = 0,
) -> str:
    """Load the snapshot, then refresh from landed pages. Returns the run's status.

    Only a failed base load fails the run: pages are an optional extra, so a missing or broken
    one makes it partial.
    """
    now = lambda: store.spark.sql("select current_timestamp()").first()[0]
    run_id = uuid.uuid4().hex
    known = {"run_id": run_id, "started_at": now(), "base_source": "csv" if snapshot else "none", "api_pages_requested": pages}
    store.log(**known, status="running")
    done = {"rx_dropped": 0, "duplicates_dropped": 0, "unmatched_tags": 0, "upserted": 0}
    notes: list[str] = []
    base, failed = store.newest(), 0

    def take(records: DataFrame, base: str | None, name: str) -> str:
        """Merge and store; what a failed merge would have counted is not counted."""
        counted = settle(prepare_counted(records), "prepared")
        lost = store.merge(name, base, prepared_rows(counted), reference)
        dropped = dropped_counts(counted).first()
        unmatched = lost.agg(F.coalesce(F.sum("titles"), F.lit(0))).first()[0]
        done["unmatched_tags"] += unmatched
        done["rx_dropped"] += dropped.rx_dropped
        done["duplicates_dropped"] += dropped.duplicates_dropped
        done["upserted"] += dropped.kept
        return name

    if snapshot:
        try:
            base = take(snapshot_records(store.spark, snapshot), base, run_id if not pages else f"{run_id}-base")
        except Exception as error:
            store.log(**known, finished_at=now(), status="failed", anime_upserted=0, api_pages_failed=0, message=f"CSV load: {error}"[:1000])
            raise
    if pages:
        try:
            landed = read_pages(store.spark, pages_folder, TOP, pages)
            missing = failed_pages(landed, pages).count()
            take(page_records(landed), base, run_id)
            failed = missing
        except Exception as error:  # noqa: BLE001 - the base data stays usable
            failed = pages
            notes.append(f"API refresh failed: {str(error)[:500]}")
            if base is not None:
                store.adopt(run_id, base)
    status = "partial" if failed else "success"
    notes.append(" ".join(f"{k}={done[k]}" for k in ("rx_dropped", "duplicates_dropped", "unmatched_tags")))
    store.log(
        **known, finished_at=now(), status=status, anime_upserted=done["upserted"], api_pages_failed=failed,
        message="; ".join(notes),
    )
    return status


def metadata(state: dict[str, DataFrame]) -> DataFrame:
    """Freshness and row counts, one row."""
    titles = state["titles"]
    facts = titles.agg(
        F.max("updated_at").alias("data_last_updated"),
        F.count_if(in_population()).alias("analysis_population"),
    )
    sources = titles.groupBy("data_source").agg(F.count("*").alias("n")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("data_source", "n")))).alias("data_source_counts")
    )
    rows = G.table_counts(state).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("table_name", "rows")))).alias("row_counts")
    )
    one = lambda df: df.withColumn("_one", F.lit(1))
    joined = one(facts).join(one(sources), "_one").join(one(rows), "_one").drop("_one")
    return joined.withColumn("generated_at", F.current_timestamp())
