"""Vector files as Spark data sources.

``xvecs`` reads files of records (``int32 dim`` and dim items): fvecs, ivecs,
bvecs.  ``xbin`` reads files with one header (``n, dim`` as int32) before the
items: fbin, ibin, u8bin, i8bin, and int8 shards that share the header of the
first and whose rows may straddle their borders.  ``xtruth`` reads ids and
distances of true neighbours, ``xclusters`` binary cluster maps.

A partition is a range of rows; its task seeks to the bytes that it needs, so
files of any size are read in parallel.  Paths may be anything pyarrow's file
systems open (local, s3://, gs://, hdfs://).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# The item type of each format.
ITEMS = {"fvecs": "<f4", "ivecs": "<i4", "bvecs": "u1", "fbin": "<f4", "ibin": "<i4", "u8bin": "u1", "i8bin": "i1", "bin": "i1"}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def files_of(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of the file, or of a folder's files in the order of the numbers in their names."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    number = lambda f: [int(x) for x in re.findall(r"\d+", f.base_name)]
    found = [f for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith(("_", "."))]
    return [(f.path, f.size) for f in sorted(found, key=lambda f: (number(f), f.base_name))]


def _bytes(store: fs.FileSystem, pieces: list[tuple[str, int]], start: int, size: int) -> bytes:
    """``size`` bytes from ``start`` on of the pieces put together."""
    out = []
    for path, length in pieces:
        if start < length and size:
            take = min(size, length - start)
            with store.open_input_file(path) as f:
                f.seek(start)
                out.append(f.read(take))
            size -= take
            start = 0
        else:
            start -= length
    return b"".join(out)


@dataclass
class Rows(InputPartition):
    first: int
    count: int
    at: int = 0
    key: int = 0

    def __post_init__(self):
        super().__init__(self.first)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, kind: str):
        self.path, self.options, self.kind = options["path"], dict(options), kind
        self.form = options.get("vectorformat") or self.path.rstrip("/").rsplit(".", 1)[-1]
        if self.form not in ITEMS:
            raise ValueError(f"unknown vector format {self.form}")
        self.dtype = np.dtype(ITEMS[self.form])
        self.store, _ = opened(self.path)
        self.pieces = files_of(self.path)
        if not self.pieces:
            raise FileNotFoundError(f"no files in {self.path}")
        head = 4 if kind == "xvecs" else 8
        raw = _bytes(self.store, self.pieces, 0, head)
        total = sum(n for _, n in self.pieces)
        if len(raw) < head:
            if total:
                raise OSError(f"{self.path} has no header")
            self.dim = self.n = 0
            self.row = 1
        elif kind == "xvecs":
            self.dim = int(np.frombuffer(raw, "<i4")[0])
            if self.dim <= 0:
                raise OSError(f"{self.path}: dimension {self.dim}")
            self.row = 4 + self.dim * self.dtype.itemsize
            for _, size in self.pieces:
                if size % self.row and options.get("onbadrecord", "fail") == "fail":
                    raise OSError(f"{self.path}: its bytes are no multiple of a row of dimension {self.dim}")
            self.n = sum(size // self.row for _, size in self.pieces)
        else:
            n, self.dim = (int(x) for x in np.frombuffer(raw, "<u4"))
            self.row = self.dim * self.dtype.itemsize
            # a partial download has fewer rows than its header says
            self.n = min(n, (total - 8) // self.row if self.row else 0)
            if self.n < n and options.get("onbadrecord", "fail") == "fail":
                raise OSError(f"{self.path}: {n} rows in the header, {self.n} in the file")
        self.start = int(options.get("startrow", 0))
        self.n = max(0, min(self.n - self.start, int(options["numrows"]) if "numrows" in options else self.n))

    def partitions(self) -> list[Rows]:
        each = max(1, int(self.options.get("rowsperpartition", 0)) or (32 << 20) // max(1, self.row))
        if self.kind == "xvecs" and self.options.get("onbadrecord", "fail") == "truncate":
            # nothing after the first bad record counts, wherever it is, so one task reads in order
            each = max(1, self.n)
        return [Rows(i, min(each, self.start + self.n - i)) for i in range(self.start, self.start + self.n, each)] or [Rows(0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        step = max(1, (8 << 20) // max(1, self.row))
        for first in range(part.first, part.first + part.count, step):
            n = min(step, part.first + part.count - first)
            if self.kind == "xvecs":
                x, short = self._records(first, n)
            else:
                x, short = np.frombuffer(_bytes(self.store, self.pieces, 8 + first * self.row, n * self.row), self.dtype).reshape(-1, self.dim), False
            item = pa.int32() if self.dtype.kind == "i" and self.dtype.itemsize == 4 else pa.float32()
            flat = pa.array(x.ravel().astype(item.to_pandas_dtype()), item)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * self.dim), flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(x)), pa.int64()), lists], ["vec_id", "embedding"])
            if short:
                return

    def _records(self, first: int, n: int) -> tuple[np.ndarray, bool]:
        """Rows first to first + n of record files; whole rows of each file count."""
        out, skip = [], first
        for path, size in self.pieces:
            have = size // self.row
            if skip < have and n:
                take = min(n, have - skip)
                raw = np.frombuffer(_bytes(self.store, [(path, size)], skip * self.row, take * self.row), np.uint8).reshape(take, self.row)
                dims = raw[:, :4].copy().view("<i4")[:, 0]
                if (dims != self.dim).any():
                    if self.options.get("onbadrecord", "fail") == "fail":
                        raise OSError(f"{path}: rows of different dimensions")
                    good = int(np.argmax(dims != self.dim))
                    out.append(raw[:good, 4:].copy().view(self.dtype))
                    return np.concatenate(out), True
                out.append(raw[:, 4:].copy().view(self.dtype))
                n -= take
                skip = 0
            else:
                skip -= have
        return (np.concatenate(out) if out else np.zeros((0, self.dim), self.dtype)), False


class _Vectors(DataSource):
    def schema(self) -> str:
        form = self.options.get("vectorformat") or self.options["path"].rstrip("/").rsplit(".", 1)[-1]
        return f"vec_id long, embedding array<{'int' if form in ('ivecs', 'ibin') else 'float'}>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, self.name())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, overwrite)


class XVecs(_Vectors):
    @classmethod
    def name(cls) -> str:
        return "xvecs"


class XBin(_Vectors):
    @classmethod
    def name(cls) -> str:
        return "xbin"


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class _Writer(DataSourceWriter):
    """A file of records for each partition, named by the task; the columns are an id, which is dropped, and the vector."""

    forms = ("fvecs", "ivecs", "bvecs")

    def __init__(self, options: dict, schema, overwrite: bool):
        self.path, self.form = options["path"].rstrip("/"), options.get("vectorformat", "fvecs")
        if self.form not in self.forms:
            raise ValueError(f"can't write {self.form}")
        store, at = opened(self.path)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            if not overwrite:
                raise FileExistsError(self.path)
            store.delete_dir(at)

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        store, at = opened(self.path)
        store.create_dir(at)
        task = TaskContext.get()
        name, n = f"{at}/part-{task.partitionId():06d}.{self.form}", 0
        temporary = f"{name}.{task.taskAttemptId()}"
        with store.open_output_stream(temporary) as f:
            for row in rows:
                x = np.asarray(row[1], ITEMS[self.form])
                f.write(np.int32(len(x)).tobytes() + x.tobytes())
                n += 1
        if n:
            store.move(temporary, name)
        else:
            store.delete_file(temporary)
        return Written(name, n)

    def commit(self, messages) -> None:
        store, at = opened(self.path)
        store.create_dir(at)
        with store.open_output_stream(f"{at}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        store, _ = opened(self.path)
        for m in messages:
            if m is not None and m.rows:
                store.delete_file(m.path)


class _TruthReader(DataSourceReader):
    def __init__(self, path: str):
        self.store, _ = opened(path)
        self.pieces = files_of(path)
        raw = np.frombuffer(_bytes(self.store, self.pieces, 0, 8), "<i4")
        if len(raw) < 2:
            raise OSError(f"{path} has no header")
        self.n, self.k = int(raw[0]), int(raw[1])
        self.distances = sum(s for _, s in self.pieces) >= 8 + 8 * self.n * self.k

    def partitions(self) -> list[Rows]:
        each = max(1, (8 << 20) // max(1, self.k))
        return [Rows(i, min(each, self.n - i)) for i in range(0, self.n, each)] or [Rows(0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        size = part.count * self.k * 4
        ids = np.frombuffer(_bytes(self.store, self.pieces, 8 + part.first * self.k * 4, size), "<i4")
        if self.distances:
            dist = pa.array(np.frombuffer(_bytes(self.store, self.pieces, 8 + (self.n + part.first) * self.k * 4, size), "<f4"))
        else:
            dist = pa.nulls(len(ids), pa.float32())
        query = np.repeat(np.arange(part.first, part.first + part.count), self.k)
        rank = np.tile(np.arange(1, self.k + 1, dtype=np.int32), part.count)
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(rank), pa.array(ids.astype(np.int64)), dist], ["query_id", "rank", "vec_id", "dist"])


class XTruth(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xtruth"

    def schema(self) -> str:
        return "query_id long, rank int, vec_id long, dist float"

    def reader(self, schema) -> DataSourceReader:
        return _TruthReader(self.options["path"])


class _ClusterReader(DataSourceReader):
    """The headers are found on the driver by seeking from cluster to cluster."""

    def __init__(self, path: str):
        self.store, _ = opened(path)
        self.pieces = files_of(path)
        self.path = path

    def partitions(self) -> list[Rows]:
        out, before = [], 0
        for path, size in self.pieces:
            with self.store.open_input_file(path) as f:
                raw = f.read(4)
                count = int(np.frombuffer(raw, "<i4")[0]) if len(raw) == 4 else 0
                at = 4
                for _ in range(count):
                    f.seek(at)
                    head = np.frombuffer(f.read(8), "<i4")
                    if len(head) < 2 or at + 8 + 4 * int(head[1]) > size:
                        raise OSError(f"{path} ends inside a cluster")
                    out.append(Rows(0, int(head[1]), before + at + 8, int(head[0])))
                    at += 8 + 4 * int(head[1])
            before += size
        return out or [Rows(0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        ids = np.frombuffer(_bytes(self.store, self.pieces, part.at, 4 * part.count), "<i4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part.key), pa.int64()), pa.array(np.arange(len(ids)), pa.int64()), pa.array(ids)], ["cluster_id", "local_id", "vec_id"])


class _ClusterWriter(_Writer):
    """A file for each partition: the number of its clusters, then of each its id, its size and its ids; rows are (cluster_id, ids)."""

    forms = ("clusters",)

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        store, at = opened(self.path)
        store.create_dir(at)
        task = TaskContext.get()
        name, records = f"{at}/part-{task.partitionId():06d}.bin", []
        for cluster, ids in rows:
            x = np.asarray(ids, np.int64)
            if len(x) and not -(1 << 31) <= min(x.min(), cluster) <= max(x.max(), cluster) < 1 << 31:
                raise OverflowError(f"cluster {cluster} has an id beyond 32 bits")
            records.append(np.array([cluster, len(x)], "<i4").tobytes() + x.astype("<i4").tobytes())
        if records:
            temporary = f"{name}.{task.taskAttemptId()}"
            with store.open_output_stream(temporary) as f:
                f.write(np.int32(len(records)).tobytes())
                for r in records:
                    f.write(r)
            store.move(temporary, name)
        return Written(name, len(records))


class XClusters(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xclusters"

    def schema(self) -> str:
        return "cluster_id long, local_id long, vec_id long"

    def reader(self, schema) -> DataSourceReader:
        return _ClusterReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _ClusterWriter({**self.options, "vectorformat": "clusters"}, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats xvecs, xbin, xtruth and xclusters known to a session."""
    for source in (XVecs, XBin, XTruth, XClusters):
        spark.dataSource.register(source)


def read_vectors(spark: SparkSession, path: str, form: str | None = None, **options) -> DataFrame:
    """Vectors (vec_id, embedding) of any format, told by the path's ending: a folder ``*.bin`` has int8 shards, parquet is a table."""
    end = form or path.rstrip("/").rsplit(".", 1)[-1]
    if end == "parquet":
        return spark.read.parquet(path)
    register(spark)
    if end not in ITEMS:
        raise ValueError(f"unknown vector format {end}")
    return spark.read.format("xvecs" if end.endswith("vecs") else "xbin").option("vectorFormat", end).options(**options).load(path)


def write_vectors(rows: DataFrame, path: str, form: str = "fvecs", key: str = "vec_id", vector: str = "embedding", overwrite: bool = False) -> None:
    """Vectors in the order of their ids, a file for each partition of ids; reading the folder numbers them in that order."""
    register(rows.sparkSession)
    ordered = rows.select(key, vector).repartitionByRange(key).sortWithinPartitions(key)
    ordered.write.format("xvecs").option("vectorFormat", form).mode("overwrite" if overwrite else "append").save(path)
