"""Streams into and out of a store: each micro-batch is one version, and changed rows are a stream by version."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootstone.errors import CorruptedError
from rootstone.functions.commitments import Hasher, committed
from rootstone.operators.store import PLAIN, Store, Table


def sink(store: Store, name: str) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: batches of (key, value, seq, op) become versions. A manifest has the newest batch of each stream, and
    batches of a stream come in order, so a batch that is delivered again is known however many others were written since."""

    def write(batch: DataFrame, number: int) -> None:
        if number <= store.manifest.streams.get(name, -1):
            return
        store.commit({0: committed(store.ops(batch), PLAIN.schema, ["key"], 0, store.key)}, stream=(name, number))

    return write


def _authentic(rows: DataFrame, key: bytes) -> DataFrame:
    """Plain rows whose path and value hash are derived anew; others are an error."""

    def run(batches):
        hasher = Hasher(key)
        for b in batches:
            for k, v, path, vh in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("key", "value", "_path", "_vh")], strict=True):
                if (k is not None and hasher.path(k) != path) or hasher.value(path, v or b"") != vh:
                    raise CorruptedError("a streamed row does not match its commitment")
            yield b

    return rows.mapInArrow(run, rows.schema)


def _derived(rows: DataFrame, table: Table, key: bytes) -> DataFrame:
    """The same of a table's rows."""
    again = committed(rows.withColumnsRenamed({"_path": "_p", "_vh": "_v", "_bucket": "_b"}), table.schema, table.primary, table.id, key)

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index
            if not (b.column(at("_p")).equals(b.column(at("_path"))) and b.column(at("_v")).equals(b.column(at("_vh")))):
                raise CorruptedError("a streamed row does not match its commitment")
            yield pa.RecordBatch.from_arrays([b.column(at(c)) for c in rows.columns], rows.columns)

    return again.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))


def change_stream(store: Store, table: Table = PLAIN) -> DataFrame:
    """A streaming DataFrame of the rows that each new version puts or deletes: the table's columns, version and deleted. Every row is
    authenticated by itself. Stores with a storage key have none.

    It follows the folders that commits write, one per version. Folders appear before their version is published, so consumers that
    must not see a commit that then fails should compare version with store.version.
    """
    files = store.spark.readStream.schema(store._stored(table)).parquet(f"{store.path}/data/{table.id}/[0-9]*")
    rows = _authentic(files, store.key) if table.id == 0 else _derived(files, table, store.key)
    return rows.select(*table.schema.names, F.col("_version").alias("version"), F.col("_deleted").alias("deleted"))


def changes_between(store: Store, after: int, upto: int | None = None, table: Table = PLAIN) -> DataFrame:
    """The same as a batch, of versions after+1 .. upto, checked against their manifests."""
    upto = store.version if upto is None else upto
    files = [f for v in store.log.versions() if after < v <= upto for f in store.log.manifest(v).files.get(str(table.id), [])]
    rows = store._changes(table, files, [*table.schema.names, "_version", "_deleted"])
    return rows.withColumnsRenamed({"_version": "version", "_deleted": "deleted"})
