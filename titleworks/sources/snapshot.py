"""The CSV snapshot: check the header, read the wanted columns, number the rows in file order."""

from __future__ import annotations

import csv
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from titleworks.functions.cells import clean_int
from titleworks.schemas import EMPTY_MARKERS, INTEGER_COLUMNS, SNAPSHOT_COLUMNS
from titleworks.session import settle


class MissingColumns(ValueError):
    """The file lacks columns the pipeline needs."""


def missing_columns(present: list[str]) -> list[str]:
    """The needed columns that are absent, in their usual order."""
    return [name for name in SNAPSHOT_COLUMNS if name not in set(present)]


def file_order() -> Column:
    """A key that grows in file order: file, split within the file, row within the split."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )


def _files_by_header(spark: SparkSession, path: str) -> list[tuple[list[str], list[str]]]:
    """Column names and files, for each distinct first line among the files.

    Only lines of a file's first block are looked at, and one line a file is kept; a header must be one line.
    """
    lines = spark.read.text(path).select(
        F.regexp_replace("value", "^\ufeff", "").alias("header"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    first = lines.where("block = 0 and trim(header) <> ''").groupBy("file").agg(F.min_by("header", "row").alias("header"))
    found = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header").collect()
    return [(next(csv.reader([r.header])), r.files) for r in found]


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The lines in file order, with their file and split; a line belongs to the split that it begins in."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.make_valid_utf8("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[pa.Array]]]:
    """The lines of each split, which follow each other in a task, as they come."""

    def stretches() -> Iterator[tuple[tuple[str, int], pa.Array]]:
        for batch in batches:
            values, *keys = batch.columns
            change = [pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False) for key in keys]
            cuts = (np.flatnonzero(change[0] | change[1]) + 1).tolist()
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if high > low:
                    yield tuple(key[low].as_py() for key in keys), values.slice(low, high - low)

    for key, own in groupby(stretches(), key=lambda x: x[0]):
        yield key, (values for _, values in own)


_CHUNK = "file string, split bigint, line bigint, lines bigint, quotes bigint, odd boolean, header string, at bigint, text string"
_CHUNK_FIELDS = pa.schema([(name, {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[kind]) for name, kind in (f.split() for f in _CHUNK.split(", "))])
CHUNK_LINES = 4096  # at most


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines in chunks of a split: the first line's number, the lines, their quotes, whether any line leaves an odd
    number of the chunk's quotes behind, the header and its line if it is here, and the lines as one text."""
    for (file, split), own in _by_split(batches):
        line, known = 0, split != 0
        for batch in own:
            for low in range(0, len(batch), CHUNK_LINES):
                values = batch.slice(low, CHUNK_LINES)
                marks = np.cumsum(pc.count_substring(values, '"').to_numpy(zero_copy_only=False))
                header, at = None, -1
                for k, value in enumerate(values if not known else ()):
                    if value.as_py().strip("\ufeff\r "):
                        header, at, known = value.as_py().lstrip("\ufeff"), line + k, True
                        break
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), "\n")[0].as_py()
                row = {"file": file, "split": split, "line": line, "lines": len(values), "quotes": int(marks[-1]), "odd": bool((marks % 2).any()), "header": header, "at": at, "text": text}
                yield pa.RecordBatch.from_pylist([row], schema=_CHUNK_FIELDS)
                line += len(values)


def _plan(chunks: DataFrame) -> tuple[dict[tuple[str, int, int], dict], dict[str, str], set[str]]:
    """What a task must know of each chunk, each file's header, and the files with records that lie across chunks.

    An odd number of quotes before a chunk means that it begins inside a quoted cell. The counts are a few
    numbers for each chunk of a file.
    """
    found = sorted(chunks.drop("text", "lines").collect(), key=lambda r: (r["file"], r["split"], r["line"]))
    plan: dict[tuple[str, int, int], dict] = {}
    headers, cut = {}, set()
    for file, group in groupby(found, key=lambda r: r["file"]):
        marks, begun, returns, head, split = 0, (0, 0), False, -1, 0
        for r in group:
            inside, here = marks % 2 == 1, (r["split"], r["line"])
            if r["split"] != split:
                split, head = r["split"], -1
            if r["header"] is not None:
                returns, head = r["header"].endswith("\r"), r["at"]
                headers[file] = r["header"].rstrip("\r")
            plan[(file, *here)] = {"inside": inside, "begun": begun, "header": head, "returns": returns}
            if inside:
                cut.add(file)
            if not inside or r["odd"]:  # else the record that it begins in goes on behind it
                begun = here
            marks += r["quotes"]
        if marks % 2:
            raise ValueError(f"{file} ends inside a quoted cell; read it with whole_files=True if cells without quotes around them hold some")
    return plan, headers, cut


def _records(chunks: DataFrame, plan: dict[tuple[str, int, int], dict], files: list[str], whole: bool) -> DataFrame:
    """(file, split, row, chunk, part, record): the files' records that lie in one chunk or, with whole=False, the pieces of all others.

    split and row are of the line that a record begins with, chunk the first line of its chunk; a piece has its own
    chunk as `part`, and row -1 where the record has begun before.
    """
    known = chunks.sparkSession.sparkContext.broadcast({key: own for key, own in plan.items() if key[0] in set(files)})  # a few numbers a chunk
    fields = pa.schema([("file", pa.string()), ("split", pa.int64()), ("row", pa.int64()), ("chunk", pa.int64()), ("part", pa.struct([("split", pa.int64()), ("line", pa.int64())])), ("record", pa.string())])

    def of_chunk(file: str, split: int, line: int, text: str) -> Iterator[pa.RecordBatch]:
        own = known.value.get((file, split, line))
        if own is None:
            return
        values = pa.array(text.split("\n"), pa.string())
        if own["returns"]:
            values = pc.replace_substring_regex(values, "\r$", "")
        after = int(own["inside"]) + np.cumsum(pc.count_substring(values, '"').to_numpy(zero_copy_only=False))
        ends = np.flatnonzero(after % 2 == 0) + 1  # a record ends with a line that leaves no cell open
        starts = np.concatenate([[0], ends])
        if starts[-1] < len(values):
            ends = np.concatenate([ends, [len(values)]])
        starts, open_ = starts[: len(ends)], bool(after[-1] % 2)
        records = pc.binary_join(pa.ListArray.from_arrays(pa.array([*starts, len(values)], pa.int32()), values), "\n")
        torn = np.zeros(len(starts), bool)
        torn[0] |= own["inside"]
        torn[-1] |= open_
        rows = line + starts
        keep = np.flatnonzero((torn != whole) & (rows > own["header"]))
        before = (keep == 0) & own["inside"]
        begun = [own["begun"] if b else (split, line) for b in before]
        part = {"split": split, "line": line}
        columns = [[file] * len(keep), [b[0] for b in begun], np.where(before, -1, rows[keep]), [b[1] for b in begun], [part] * len(keep)]
        arrays = [pa.array(c, f.type) for c, f in zip(columns, fields, strict=False)]
        yield pa.RecordBatch.from_arrays([*arrays, records.take(pa.array(keep))], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from of_chunk(*(column[k].as_py() for column in batch.columns))

    made = "file string, split bigint, row bigint, chunk bigint, part struct<split: bigint, line: bigint>, record string"
    tasks = max(200, 4 * chunks.sparkSession.sparkContext.defaultParallelism)  # at most: many small splits share a Python run
    return chunks.select("file", "split", "line", "text").where(F.col("file").isin(files)).coalesce(tasks).mapInArrow(run, made)


def _quoted(spark: SparkSession, path: str) -> list[tuple[list[str], list[str], DataFrame]]:
    """Column names, files and (file, split, row, record), for each distinct header; cells may hold line breaks.

    Files are cut into splits. How Spark cuts them depends on all files that are read together and on the executors at hand, so
    they are read once and settled as chunks of lines; the chunks' quotes tell whether one begins inside a cell.
    Records across chunks are put together by a shuffle of their pieces alone.
    """
    chunks = settle(_lines(spark, path).mapInArrow(_chunks, _CHUNK), "chunks")
    plan, headers, cut = _plan(chunks)
    out = []
    for header in sorted(set(headers.values())):
        files = sorted(f for f, h in headers.items() if h == header)
        records = _records(chunks, plan, files, True).drop("part", "chunk")
        if torn := [f for f in files if f in cut]:
            pieces = F.sort_array(F.collect_list(F.struct("part", "record")))
            text = F.concat_ws("\n", F.transform(pieces, lambda p: p["record"])).alias("record")
            records = records.union(_records(chunks, plan, torn, False).groupBy("file", "split", "chunk").agg(F.max("row").alias("row"), text).drop("chunk"))
        out.append((next(csv.reader([header])), files, records.where("trim(record) <> ''")))
    return out


def read_snapshot(
    spark: SparkSession, path: str, multi_line: bool = True, with_order: bool = False, whole_files: bool = False
) -> DataFrame:
    """The snapshot's columns as text, except the whole-number ones, which become bigint.

    Every file has a header of its own: columns are taken by name, in whatever order a file has them,
    and a file that lacks one is refused. Quoted cells may hold line breaks; large files are split all the same. That
    takes every quote for one around or inside a quoted cell. With whole_files=True Spark's reader alone decides, and one
    task reads a whole file; with multi_line=False no cell may have a line break.
    """
    parts = []
    options = {"quote": '"', "escape": '"', "multiLine": multi_line}
    if multi_line and not whole_files:
        found = _quoted(spark, path)
    else:
        found = [(columns, files, None) for columns, files in _files_by_header(spark, path)]
    for columns, files, records in found:
        if missing := missing_columns(columns):
            raise MissingColumns(f"{files[0]} is missing required columns: {', '.join(missing)}")
        schema = T.StructType([T.StructField(f"{k}", T.StringType()) for k in range(len(columns))])
        if records is None:
            raw = spark.read.options(header=True, **options).schema(schema).csv(files)
            order = file_order()
        else:
            cells = F.from_csv("record", ", ".join(f"`{name}` string" for name in schema.names), {k: str(v) for k, v in options.items()})
            raw = records.select(cells.alias("cells"), F.struct("file", "split", "row").alias("order")).select("cells.*", "order")
            order = F.col("order")
        raw = raw.select(*[F.col(str(columns.index(name))).alias(name) for name in SNAPSHOT_COLUMNS], *([order.alias("_seq")] if with_order else []))
        parts.append(raw)
    if not parts:
        raise MissingColumns(f"{path} has no header")

    def cell(name: str) -> Column:
        text = F.when(~F.col(name).isin(*EMPTY_MARKERS), F.col(name))
        return (clean_int(text) if name in INTEGER_COLUMNS else text).alias(name)

    rows = reduce(DataFrame.union, parts)
    return rows.select(*[cell(name) for name in SNAPSHOT_COLUMNS], *(["_seq"] if with_order else []))
