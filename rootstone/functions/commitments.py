"""Commitments of keys, values and rows, computed batch by batch with the key in a closure, never in a plan.

A row's canonical bytes hold, per column in schema order, a marker (0: null, 1: a value) and the value: integers as
8 bytes that sort by value, floats likewise, strings and bytes after their length. Key bytes keep the order of keys.
"""

from __future__ import annotations

import hashlib
import hmac
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rootstone.errors import InvalidError

from .local import from_arrow, local_rows

ROW_PREFIX, CATALOG_PREFIX = b"sql/r/", b"sql/c/"


@dataclass(frozen=True)
class Scheme:
    """The byte strings by which a store's hashes are told apart. A store is opened with the scheme that it was made with; who
    needs the bytes of another implementation gives its strings here."""

    empty: bytes = b"rootstone:empty:v1"
    leaf: bytes = b"rootstone:leaf:v1"
    inner: bytes = b"rootstone:inner:v1"
    chain: bytes = b"rootstone:chain:v1"
    manifest: bytes = b"rootstone:manifest:v1"
    #: What reserved keys begin with, and the rest of the key of the chain's own leaf.
    reserved: bytes = b"\0rootstone:"
    head: bytes = b"history"
    #: Additional data of sealed values, before their path.
    sealed: bytes = b"rootstone:value:v1"

    @cached_property
    def placeholder(self) -> bytes:
        return hashlib.sha256(self.empty).digest()

    @property
    def history_key(self) -> bytes:
        return self.reserved + self.head

    def leaf_hash(self, path: bytes, vh: bytes) -> bytes:
        return hashlib.sha256(self.leaf + path + vh).digest()

    def inner_hash(self, left: bytes, right: bytes) -> bytes:
        return hashlib.sha256(self.inner + left + right).digest()

    def chain_link(self, head: bytes, root: bytes, version: int) -> bytes:
        return hashlib.sha256(self.chain + head + root + version.to_bytes(8, "big")).digest()

    def mac(self, key: bytes, payload: bytes) -> bytes:
        """Of manifests, by a key derived from the commitment key."""
        return hmac.digest(hmac.digest(key, self.manifest, "sha256"), payload, "sha256")


OWN = Scheme()

HIDDEN = [T.StructField("_path", T.BinaryType()), T.StructField("_vh", T.BinaryType()), T.StructField("_bucket", T.IntegerType())]


class Hasher:
    """HMAC-SHA256 with the padded key hashed once."""

    def __init__(self, key: bytes) -> None:
        key = hashlib.sha256(key).digest() if len(key) > 64 else key
        key = key.ljust(64, b"\0")
        self.inner, self.outer = hashlib.sha256(bytes(b ^ 0x36 for b in key)), hashlib.sha256(bytes(b ^ 0x5C for b in key))

    def __call__(self, message: bytes) -> bytes:
        inner, outer = self.inner.copy(), self.outer.copy()
        inner.update(message)
        outer.update(inner.digest())
        return outer.digest()

    def all(self, messages: list[bytes]) -> list[bytes]:
        out, first, then = [], self.inner.copy, self.outer.copy
        for message in messages:
            inner, outer = first(), then()
            inner.update(message)
            outer.update(inner.digest())
            out.append(outer.digest())
        return out

    def path(self, key: bytes) -> bytes:
        return self(b"p" + key)

    def value(self, path: bytes, value: bytes) -> bytes:
        return self(b"v" + path + value)


#: Of a path, the bits by which files are sorted and pruned; buckets of the tree are of so many bits at most, less four.
BUCKET_BITS = 24


def bucket_of(path: bytes) -> int:
    return int.from_bytes(path[: BUCKET_BITS // 8], "big")


def listed(column: pa.Array) -> list:
    """The same as to_pylist(), which makes each value by itself, at a fraction of its time for bytes, texts and whole numbers without nulls."""
    kind = column.type
    if pa.types.is_binary(kind) or pa.types.is_string(kind) or pa.types.is_large_binary(kind) or pa.types.is_large_string(kind) or (pa.types.is_integer(kind) and not column.null_count):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _words(raw: bytes) -> list[bytes]:
    return [raw[i : i + 8] for i in range(0, len(raw), 8)]


def _int_words(values: np.ndarray) -> bytes:
    return (values.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").tobytes()


def _float_words(values: np.ndarray) -> bytes:
    values = np.where(np.isnan(values), np.nan, values.astype(np.float64))
    bits = values.view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits ^ np.uint64(1 << 63)).astype(">u8").tobytes()


def _ordered_ints(values: np.ndarray) -> list[bytes]:
    return _words(_int_words(values))


def _ordered_floats(values: np.ndarray) -> list[bytes]:
    return _words(_float_words(values))


def _length(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _escaped(raw: bytes) -> bytes:
    """Ends with two zeros; zeros within are escaped, so that shorter keys sort first."""
    return raw.replace(b"\0", b"\0\xff") + b"\0\0"


def _numbers(column: pa.Array, kind: T.DataType) -> bytes | None:
    """The 8 bytes of each value of a column of numbers or times, in a row; those of nulls are arbitrary. None: of other kinds."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return _int_words(pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False))
    if isinstance(kind, T.DecimalType):
        return b"".join([int(v or Decimal(0)).to_bytes(8, "big") for v in column.to_pylist()])
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _float_words(pc.fill_null(column.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False))
    if isinstance(kind, T.TimestampNTZType):
        micros = pc.fill_null(column.cast(pa.timestamp("us")).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
        if len(micros) and np.abs(micros).max() > (1 << 63) // 1000:
            raise InvalidError("a datetime is outside the years 1678 to 2262")
        return _int_words(micros * 1000)
    return None


def _encoded(column: pa.Array, kind: T.DataType, key: bool) -> list[bytes]:
    """The bytes of each value; those of nulls are arbitrary."""
    if (numbers := _numbers(column, kind)) is not None:
        return _words(numbers)
    raw = [v.encode() if isinstance(v, str) else v or b"" for v in listed(column)]
    return [_escaped(v) for v in raw] if key else [_length(len(v)) + v for v in raw]


def supported(kind: T.DataType) -> bool:
    plain = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BinaryType, T.TimestampNTZType)
    return isinstance(kind, plain) or kind == T.DecimalType(20, 0)


#: Markers and lengths of short texts; bytes of a batch's texts up to which its rows are joined by Arrow.
_SHORT, _JOINED = pa.array([b"\1" + _length(n) for n in range(256)], pa.binary()), 1 << 30


def _marked(column: pa.Array, kind: T.DataType) -> pa.Array:
    """Each value's marker and bytes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()).cast(pa.binary())
        lengths = pc.fill_null(pc.binary_length(raw), 0)
        if not len(raw) or pc.max(lengths).as_py() < len(_SHORT):
            out = pc.binary_join_element_wise(_SHORT.take(lengths), pc.fill_null(raw, b""), b"")
        else:
            out = pa.array([b"\1" + v for v in _encoded(column, kind, False)], pa.binary())
    else:
        words = np.frombuffer(_numbers(column, kind), np.uint8).reshape(-1, 8)
        whole = np.hstack([np.ones((len(words), 1), np.uint8), words])
        out = pa.FixedSizeBinaryArray.from_buffers(pa.binary(9), len(words), [None, pa.py_buffer(whole.tobytes())]).cast(pa.binary())
    return pc.if_else(column.is_valid(), out, pa.scalar(b"\0", pa.binary())) if column.null_count else out


def row_bytes(columns: list[pa.Array], kinds: list[T.DataType]) -> list[bytes]:
    if sum(c.nbytes for c in columns) > _JOINED and len(columns[0]) > 1:
        half = len(columns[0]) // 2
        return row_bytes([c[:half] for c in columns], kinds) + row_bytes([c[half:] for c in columns], kinds)
    return listed(pc.binary_join_element_wise(*[_marked(c, k) for c, k in zip(columns, kinds, strict=True)], b""))


def row_values(rows: list[bytes], kinds: list[T.DataType]) -> list[list]:
    """The values of each column from canonical bytes; the inverse of row_bytes."""
    out: list[list] = [[] for _ in kinds]
    for raw in rows:
        at = 0
        for column, kind in zip(out, kinds, strict=True):
            there, at = raw[at], at + 1
            if not there:
                column.append(None)
            elif isinstance(kind, (T.StringType, T.BinaryType)):
                n, shift = 0, 0
                while True:
                    b, at = raw[at], at + 1
                    n |= (b & 0x7F) << shift
                    shift += 7
                    if b < 0x80:
                        break
                value, at = raw[at : at + n], at + n
                column.append(value.decode() if isinstance(kind, T.StringType) else value)
            else:
                word, at = int.from_bytes(raw[at : at + 8], "big"), at + 8
                if isinstance(kind, T.DecimalType):
                    column.append(Decimal(word))
                elif isinstance(kind, (T.FloatType, T.DoubleType)):
                    bits = word ^ (1 << 63) if word >> 63 else word ^ ((1 << 64) - 1)
                    column.append(struct.unpack(">d", bits.to_bytes(8, "big"))[0])
                else:
                    number = word - (1 << 63)
                    column.append(number // 1000 if isinstance(kind, T.TimestampNTZType) else number)
        if at != len(raw):
            raise InvalidError("malformed row")
    return out


def with_row(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with its columns of schema replaced by _row, their canonical bytes."""
    names, kinds = schema.names, [f.dataType for f in schema]
    rest = [f for f in df.schema if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index
            rows = row_bytes([b.column(at(c)) for c in names], kinds)
            yield pa.RecordBatch.from_arrays([*[b.column(at(f.name)) for f in rest], pa.array(rows, pa.binary())], [*[f.name for f in rest], "_row"])

    return df.mapInArrow(run, T.StructType([*rest, T.StructField("_row", T.BinaryType())]))


def without_row(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The inverse of with_row."""
    kinds = [f.dataType for f in schema]
    rest = [f for f in df.schema if f.name != "_row"]
    loose = T.StructType([T.StructField(f.name, f.dataType) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(loose)
        for b in batches:
            at = b.schema.get_field_index
            columns = row_values(b.column(at("_row")).to_pylist(), kinds)
            made = [pa.array(c, pa.int64()).cast(f.type) if pa.types.is_timestamp(f.type) else pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*made, *[b.column(at(f.name)) for f in rest]], [*schema.names, *[f.name for f in rest]])

    return df.mapInArrow(run, T.StructType([*loose.fields, *rest]))


def key_bytes(columns: list[pa.Array], kinds: list[T.DataType], table_id: int) -> list[bytes]:
    prefix = ROW_PREFIX + table_id.to_bytes(8, "big")
    return [prefix + b"".join(row) for row in zip(*[_encoded(c, k, True) for c, k in zip(columns, kinds, strict=True)], strict=True)]


def prefix_end(prefix: bytes) -> bytes:
    """The least key above all keys with this prefix; empty (no bound) if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else b""


def one_row_key(values: list, kinds: list[T.DataType], table_id: int) -> bytes:
    arrow = {T.LongType: pa.int64(), T.StringType: pa.string(), T.BinaryType: pa.binary(), T.DoubleType: pa.float64(), T.TimestampNTZType: pa.timestamp("us")}
    columns = [pa.array([Decimal(v) if isinstance(k, T.DecimalType) else v], arrow.get(type(k))) for v, k in zip(values, kinds, strict=True)]
    return key_bytes(columns, kinds, table_id)[0]


def _keys_and_values(schema: T.StructType, primary: list[str], table_id: int) -> Callable:
    """From a batch, the key and the value bytes of each row. Table 0 holds plain keys and values."""
    names, kinds = [f.name for f in schema], [f.dataType for f in schema]
    own = [kinds[names.index(c)] for c in primary]

    def run(batch: pa.RecordBatch) -> tuple[list[bytes], list[bytes]]:
        at = batch.schema.get_field_index
        if table_id == 0:
            return listed(batch.column(at("key"))), [v or b"" for v in listed(batch.column(at("value")))]
        return key_bytes([batch.column(at(c)) for c in primary], own, table_id), row_bytes([batch.column(at(c)) for c in names], kinds)

    return run


def committer(names: list[str], schema: T.StructType, primary: list[str], table_id: int, key: bytes) -> Callable:
    """Adds _path, _vh and _bucket to batches with these columns."""
    encode = _keys_and_values(schema, primary, table_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(key)
        for batch in batches:
            keys, values = encode(batch)
            paths = hasher.all([b"p" + k for k in keys])
            hashes = hasher.all([b"v" + p + v for p, v in zip(paths, values, strict=True)])
            buckets = np.frombuffer(b"".join(b"\0" + p[:3] for p in paths), ">u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.binary()), pa.array(hashes, pa.binary()), pa.array(buckets)], [*names, "_path", "_vh", "_bucket"])

    return run


def committed(df: DataFrame, schema: T.StructType, primary: list[str], table_id: int, key: bytes) -> DataFrame:
    """df with _path, _vh and _bucket of each row; other columns of df are kept."""
    run, out = committer(df.columns, schema, primary, table_id, key), T.StructType([*df.schema.fields, *HIDDEN])
    if (here := local_rows(df)) is not None:
        return from_arrow(df.sparkSession, list(run(here.to_batches())), out)
    return df.mapInArrow(run, out)


def bucketed(df: DataFrame, schema: T.StructType, primary: list[str], table_id: int, key: bytes) -> DataFrame:
    """df with _bucket of each row: what tells where it goes, by a hash of its key alone. Not of table 0."""
    kinds, names = [schema[c].dataType for c in primary], df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(key)
        for batch in batches:
            keys = key_bytes([batch.column(batch.schema.get_field_index(c)) for c in primary], kinds, table_id)
            buckets = np.frombuffer(b"".join(b"\0" + p[:3] for p in hasher.all([b"p" + k for k in keys])), ">u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(buckets)], [*names, "_bucket"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, HIDDEN[2]]))


def recommitted_plain(rows: DataFrame, key: bytes) -> DataFrame:
    """(_bucket, _path, _vh) of plain rows (key, value, _path), derived anew; rows that were restored by path have no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(key)
        for batch in batches:
            keys, values, stored = map(listed, batch.columns)
            paths = [p if k is None else hasher.path(k) for k, p in zip(keys, stored, strict=True)]
            hashes = hasher.all([b"v" + p + (v or b"") for p, v in zip(paths, values, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array([bucket_of(p) for p in paths], pa.int32()), pa.array(paths, pa.binary()), pa.array(hashes, pa.binary())], ["_bucket", "_path", "_vh"])

    return rows.select("key", "value", "_path").mapInArrow(run, "_bucket int, _path binary, _vh binary")
