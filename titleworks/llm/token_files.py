"""Token ids as Arrow stream files: batches of fixed-size lists, for random access without copies.

A run of documents in ascending order (of doc_id, or of given keys) is one stream of ids, cut into sequences of equal
length. A file holds record batches of (ids: fixed_size_list, mask: fixed_size_list<bool>); the mask
is false only behind a file's last id. Sequence k lies at a fixed place, so a trainer maps the file
and slices. A second file beside it says where each document begins. Spark range-sorts the
documents; each task writes the files of one range and reports them in a manifest row.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titleworks.llm.encoder import encoder
from titleworks.llm.text import flat
from titleworks.session import settle, working_path

LENGTH = 2048  # ids in a sequence
SEQUENCES = 256  # in a record batch
_MANIFEST = "part int, path string, docs_path string, n_ids bigint, n_docs bigint"


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


class Writer:
    """One file of sequences, and beside it the documents' places."""

    def __init__(self, path: str, dtype: np.dtype, end_id: int, length: int = LENGTH, sequences: int = SEQUENCES) -> None:
        self.path, self.docs_path = f"{path}.arrow", f"{path}.docs.arrow"
        self._end, self._length, self._most, self._dtype = end_id, length, sequences * length, dtype
        kind = pa.from_numpy_dtype(dtype)
        self._schema = pa.schema([("ids", pa.list_(pa.field("item", kind, False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))], metadata={"end_id": str(end_id)})
        system, at = _opened(self.path)
        system.create_dir(at.rsplit("/", 1)[0], recursive=True)
        self._out = system.open_output_stream(at)
        self._file = pa.ipc.new_file(self._out, self._schema)
        docs = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
        self._docs_out = system.open_output_stream(_opened(self.docs_path)[1])
        self._docs_file = pa.ipc.new_file(self._docs_out, docs)
        self._docs_schema = docs
        self._held, self._waiting, self._docs = [], 0, []
        self.n_ids = self.n_docs = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        ids = np.append(np.frombuffer(ids, self._dtype), self._dtype.type(self._end))
        self._docs.append((doc_id, self.n_ids, len(ids)))
        self.n_ids += len(ids)
        self.n_docs += 1
        self._held.append(ids)
        self._waiting += len(ids)
        if self._waiting >= self._most:
            whole = np.concatenate(self._held)
            full = len(whole) // self._most * self._most
            for low in range(0, full, self._most):
                self._write(whole[low : low + self._most], self._most)
            self._held, self._waiting = [whole[full:].copy()], len(whole) - full
        if len(self._docs) >= 10_000:
            self._write_docs()

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), type=f.type) for v, f in zip((ids, mask), self._schema, strict=True)]
        self._file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self._schema))

    def _write_docs(self) -> None:
        columns = zip(*self._docs, strict=True)
        self._docs_file.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=self._docs_schema))
        self._docs = []

    def close(self) -> None:
        if self._waiting:
            whole = np.concatenate(self._held)
            padded = np.full(-(-len(whole) // self._length) * self._length, self._end, self._dtype)
            padded[: len(whole)] = whole
            self._write(padded, len(whole))
        if self._docs:
            self._write_docs()
        for x in (self._file, self._out, self._docs_file, self._docs_out):
            x.close()


class Reader:
    """Random access to one file: sequences, masks, and runs of ids. Local files are mapped, not read."""

    def __init__(self, path: str) -> None:
        system, at = _opened(path)
        self._source = pa.memory_map(at) if isinstance(system, pa.fs.LocalFileSystem) else system.open_input_file(at)
        self._file = pa.ipc.open_file(self._source)
        self.length = self._file.schema.field("ids").type.list_size
        self._kept: tuple[int, np.ndarray, pa.RecordBatch] | None = None
        self._batches = self._file.num_record_batches
        self._each = self._file.get_batch(0).num_rows if self._batches else 0

    def _batch(self, k: int) -> tuple[np.ndarray, pa.RecordBatch]:
        if self._kept is None or self._kept[0] != k:
            batch = self._file.get_batch(k)
            self._kept = (k, batch.column(0).flatten().to_numpy(), batch)
        return self._kept[1:]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids and the mask of sequence k."""
        ids, batch = self._batch(k // self._each)
        row = k % self._each
        return ids[row * self.length : (row + 1) * self.length], batch.column(1)[row].values.to_numpy(zero_copy_only=False)

    def run(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from start to start + n, batch by batch."""
        each = self._each * self.length
        while n > 0:
            ids, _ = self._batch(start // each)
            low = start % each
            part = ids[low : low + n]
            yield part
            start, n = start + len(part), n - len(part)

    def close(self) -> None:
        self._kept = None
        self._source.close()


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, length: int = LENGTH, order: list[Column] | None = None) -> DataFrame:
    """Encode and write all documents; the manifest: one row (part, path, docs_path, n_ids, n_docs) a file.

    Files hold the documents in ascending doc_id order (null first, equal ids by text), or in that of the
    columns `order`, file after file by `part`. Null and empty texts are the end id alone. A repeated row is written again.
    Other columns are ignored; an empty table gives an empty manifest and no files. `folder` must be
    reachable from every executor; the default lies in the shared folder. Every attempt of a task writes files
    of its own, and the manifest names those of the attempt that counted, so a lost executor costs a
    retry and never a mixture.
    """
    folder = (folder or working_path(docs.sparkSession, "token-files")).rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, writer = encoder(vocabulary), None
        part = TaskContext.get().partitionId()
        for batch in batches:
            data, at = flat(batch.column(1))
            whole = memoryview(data)
            if writer is None and batch.num_rows:
                writer = Writer(f"{folder}/part-{part:06d}-{uuid.uuid4().hex}", own.dtype, end_id, length)
            for doc_id, low, high in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                writer.add(doc_id, own.encode(bytes(whole[low:high])))
        if writer is not None:
            writer.close()
            row = [[part], [writer.path], [writer.docs_path], [writer.n_ids], [writer.n_docs]]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "path", "docs_path", "n_ids", "n_docs"])

    keys = {f"_key_{k}": key for k, key in enumerate(order or [])}
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *[key.alias(name) for name, key in keys.items()])
    split = keys or ["doc_id", F.substring("text", 1, 64)]  # a beginning sorts as its text does, and parts rows of one id or none
    ordered = rows.repartitionByRange(*split).sortWithinPartitions(*(keys or ["doc_id", "text"])).select("doc_id", "text")
    return settle(ordered.mapInArrow(write, _MANIFEST), "manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part) of every document, from the files of a manifest.

    start counts the ids of all documents before it, over all files. One task reads one file; a file's
    size is that of one range of the sort.
    """
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)))
    files = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                reader = Reader(row["path"])
                system, at = _opened(row["docs_path"])
                with system.open_input_file(at) as source:
                    docs = pa.ipc.open_file(source)
                    for k in range(docs.num_record_batches):
                        places = docs.get_batch(k)
                        sums = []
                        for start, n in zip(places.column(1).to_pylist(), places.column(2).to_pylist(), strict=True):
                            crc = 0
                            for ids in reader.run(start, n):
                                crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                            sums.append(crc)
                        start = places.column(1).to_numpy() + row["before"]
                        part = np.full(places.num_rows, row["part"], np.int32)
                        yield pa.RecordBatch.from_arrays([places.column(0), pa.array(start), places.column(2), pa.array(sums, pa.int64()), pa.array(part)], names=["doc_id", "start", "n_tokens", "ids_crc32", "part"])
                reader.close()

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, part int"
    return placed.repartition(files).mapInArrow(read, schema)
