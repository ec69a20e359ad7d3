"""Parquet files that a manifest knows by their hashes.

A scan reads whole files, compares their SHA-256 with the manifest's and decodes the very bytes that it compared, with only the
columns that are asked for. So no row is seen that was not checked, in every scan and on every executor. Besides hashes,
a manifest has of each file the range of buckets and of column values, by which files are left out without being trusted to say so.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rootstone.errors import BackendError, CorruptedError
from rootstone.functions.commitments import BUCKET_BITS
from rootstone.functions.local import from_arrow

from .files import Folder

#: Rows of a decoded batch; characters of a text that is kept as a bound.
BATCH, BOUND = 16_384, 64


@dataclass(frozen=True)
class DataFile:
    name: str
    sha: str
    size: int
    rows: int
    low: int
    high: int
    #: Of columns, the least and largest value (null: all values are null). Columns without bounds are left out.
    zones: dict[str, list] = field(default_factory=dict)

    def encode(self) -> dict:
        return asdict(self)


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Buffer]]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield path, content.as_buffer()


def _short(path: str) -> str:
    return "/".join(path.rsplit("/", 4)[1:])  # data/table/folder/file


def _zone(column: pa.ChunkedArray) -> list | None:
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.int64())
    if pa.types.is_floating(column.type) and pc.any(pc.is_nan(column)).as_py():
        return None
    bounds = pc.min_max(column).as_py()
    low, high = bounds["min"], bounds["max"]
    return None if isinstance(high, str) and max(len(low), len(high)) > BOUND else [low, high]


def described(name: str, raw: pa.Buffer | bytes, zoned: list[str], shift: int) -> tuple[DataFile, np.ndarray] | None:
    """What a manifest says of a file, and the buckets of its rows; nothing of a file without rows."""
    stored = pq.ParquetFile(pa.BufferReader(raw))
    if not stored.metadata.num_rows:
        return None
    own = stored.read(columns=["_bucket"]).column(0).to_numpy() if "_bucket" in stored.schema_arrow.names else np.zeros(stored.metadata.num_rows, np.int32)
    zones = {c: z for c in zoned if (z := _zone(stored.read(columns=[c]).column(0))) is not None}
    found = DataFile(name, hashlib.sha256(raw).hexdigest(), len(raw), len(own), int(own.min()), int(own.max()), zones)
    return found, np.unique(own >> shift).astype(np.int32)


def write_local(folder: Folder, name: str, rows: pa.Table, zoned: list[str], depth: int) -> tuple[list[DataFile], set[int]]:
    """Writes few rows as one file, from the driver."""
    raw = io.BytesIO()
    pq.write_table(rows.sort_by("_path"), raw, store_schema=False)
    file = f"{name}/part-00000.parquet"
    found = described(file, raw.getvalue(), zoned, BUCKET_BITS - depth)
    if found is None:
        return [], set()
    folder.replace(file, raw.getvalue())
    return [found[0]], set(found[1].tolist())


def read_local(folder: Folder, files: list[DataFile], columns: list[str], keep: np.ndarray | None = None) -> pa.Table | None:
    """The columns of a few files, checked, on the driver."""
    parts = []
    wanted = list(dict.fromkeys([*columns, *(["_bucket"] if keep is not None else [])]))
    for f in files:
        try:
            raw = folder.read(f.name)
        except BackendError as e:
            raise CorruptedError(str(e)) from e
        if hashlib.sha256(raw).hexdigest() != f.sha:
            raise CorruptedError(f"{f.name} does not match its hash")
        rows = pq.read_table(pa.BufferReader(raw), columns=wanted)
        if keep is not None:
            rows = rows.filter(pa.array(keep[rows.column("_bucket").to_numpy() >> (BUCKET_BITS - (len(keep).bit_length() - 1))]))
        parts.append(pa.table({c: rows.column(c) for c in columns}))
    return pa.concat_tables(parts) if parts else None


def describe(spark: SparkSession, root: str, folder: str, zoned: list[str], depth: int) -> tuple[list[DataFile], set[int]]:
    """The files of a folder that was just written, without empty ones, and the buckets of their rows."""
    return describe_all(spark, root, [folder], zoned, depth).get(folder, ([], set()))


def describe_all(spark: SparkSession, root: str, folders: list[str], zoned: list[str], depth: int) -> dict[str, tuple[list[DataFile], set[int]]]:
    """The same of several folders in one job. One row a file comes to the driver."""
    shift = BUCKET_BITS - depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, raw in _raw(batches):
            if found := described(_short(path), raw, zoned, shift):
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps(found[0].encode())]), pa.array([found[1].tobytes()], pa.binary())], ["file", "buckets"])

    paths = [f"{root}/{folder}" for folder in folders]
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(paths).select("path", "content").mapInArrow(run, "file string, buckets binary").collect()
    out: dict[str, tuple[list[DataFile], set[int]]] = {}
    for f, buckets in sorted(((DataFile(**json.loads(r.file)), bytes(r.buckets)) for r in rows), key=lambda x: (x[0].low, x[0].name)):
        files, touched = out.setdefault(f.name.rsplit("/", 1)[0], ([], set()))
        files.append(f)
        touched.update(np.frombuffer(buckets, np.int32).tolist())
    return out


def zoned_columns(schema: T.StructType) -> list[str]:
    kinds = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.TimestampNTZType)
    return [f.name for f in schema if isinstance(f.dataType, kinds)]


def read(spark: SparkSession, root: str, files: list[DataFile], schema: T.StructType, keep: np.ndarray | None = None, key: bytes | None = None, checked: bool = True) -> DataFrame:
    """The columns of schema. keep: of each bucket, whether its rows are wanted. key: comes as a column _key, so that it is in no plan.
    checked: off reads with Spark's own reader, unchecked."""
    names, shift = schema.names, None if keep is None else BUCKET_BITS - (len(keep).bit_length() - 1)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    out = T.StructType([*schema.fields, T.StructField("_key", T.BinaryType())]) if key else schema
    if not files:
        return from_arrow(spark, [], out)
    expected = {f.name: f.sha for f in files}
    paths = [f"{root}/{f.name}" for f in files]
    wanted = [*names, *(["_bucket"] if keep is not None and "_bucket" not in names else [])]

    def picked(batch: pa.RecordBatch) -> pa.RecordBatch:
        if keep is not None:
            batch = batch.filter(pa.array(keep[batch.column("_bucket").to_numpy() >> shift]))
        arrays = [batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays([*arrays, *([pa.array([key] * len(batch), pa.binary())] if key else [])], out.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, raw in _raw(batches):
            if hashlib.sha256(raw).hexdigest() != expected.get(_short(path)):
                raise CorruptedError(f"{_short(path)} does not match its hash")
            for batch in pq.ParquetFile(pa.BufferReader(raw)).iter_batches(BATCH, columns=wanted):
                yield picked(batch)

    def trusted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(picked, batches)

    try:
        if checked:
            return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, out)
        rows = spark.read.schema(T.StructType([*schema.fields, *([T.StructField("_bucket", T.IntegerType())] if len(wanted) > len(names) else [])])).parquet(*paths)
        return rows.mapInArrow(trusted, out) if key or keep is not None else rows
    except AnalysisException as e:
        raise CorruptedError(f"files of a version are missing: {str(e)[:200]}") from e
