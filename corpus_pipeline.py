"""Training documents from raw ones: stages that each read what the stage before has kept."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titleworks.llm import quality
from titleworks.llm.leaks import find_leaks
from titleworks.llm.mixing import in_training_order, mix, sizes, sources_of, targets
from titleworks.llm.near_copies import near_copies
from titleworks.llm.schedules import weighed
from titleworks.llm.token_files import read_documents, write_token_files
from titleworks.llm.vocabulary import END_ID, VOCABULARY
from titleworks.session import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives one half or more.

    Null and empty texts get the model's constant; every row is judged by its text alone, so repeated rows stay or go
    together, rows with null ids as all others. An empty table gives no rows; other columns than those of documents are left out.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, F.lit(True))
    return quality.score(docs.select(*COLUMNS), model).where("quality_score >= 0.5").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) one document: the one with the smallest doc_id.

    Where a group has several rows of that id, the one whose set of shingles has the smallest hash stays; a group without
    any id keeps one row in the same way. Texts without words are copies of nothing and stay. Rows of equal id and
    text are one row, with the smallest other columns. Rows of one id but different texts are judged each for itself. An
    empty table gives no rows; other columns than those of documents are left out.
    """
    found = near_copies(docs, words=5, percent=80).where("kept")
    alone = lambda name: F.when(F.col("group").isNull(), F.col(name)).alias(f"own_{name}")
    one = found.groupBy("group", alone("place"), alone("text_hash")).agg(F.min(F.struct("set_id", "text_hash", "place")).alias("row"))
    one = settle(one.select(F.col("row.place").alias("_place"), F.col("row.text_hash").alias("_hash")), "kept")
    hashed = F.xxhash64("text")
    rows = docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("bigint"), hashed).alias("_place"), hashed.alias("_hash"))
    rows = rows.groupBy("_place", "_hash").agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("row"))
    return rows.join(one, ["_place", "_hash"], "left_semi").select(*(F.col(f"row.{c}").alias(c) for c in COLUMNS))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Null and empty texts hold none and stay. Repeated rows, and rows with null ids, are judged each by its own text. An empty
    table gives no rows; other columns than those of documents are left out.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return find_leaks(docs.select(*COLUMNS), benchmark).where("size(leaks) = 0").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, each as often as the mix takes it.

    Null and empty texts have no words, so they fill no target and stay only where their source is taken as a whole; a null source is a source. Repeated rows are documents of their own.
    An empty table gives no rows; other columns than those of documents are left out.
    """
    entries = sizes(docs)
    plan = settle(mix(entries, targets(weighed(sources_of(entries)))), "mix")
    return in_training_order(docs.select(*COLUMNS), plan)


def _as_read(docs: DataFrame) -> bool:
    """Whether docs are rows of files, with nothing but columns chosen; through a join `_metadata` would be that of other files."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().head()
    try:
        return plan.children().isEmpty() and bool(docs.select("_metadata.row_index").columns)
    except AnalysisException:
        return False


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows in the mix's order; of each row its place, number of ids and their checksum, read back from the files.

    The order is that of the Parquet files which the mix was written to: files by number, rows by place in them.
    """
    if not _as_read(docs):
        docs = settle(docs, "mixed")
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.regexp_extract(name, pattern, 1).try_cast("bigint")
    order = [number(r"^part-(\d+)"), number(r"-c(\d+)[^-]*$"), name, F.col("_metadata.row_index")]
    return read_documents(write_token_files(docs, VOCABULARY, END_ID, order=order))


STAGES = [
    ("quality", keep_quality),
    ("near_copies", keep_one_of_near_copies),
    ("leaks", drop_leaks),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

ORACLE_SQL = None  # trained weights, sketches and byte-pair merges are not SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
