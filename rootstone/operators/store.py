"""The authenticated, versioned store: tables of typed rows (table 0: plain keys and values) under one root.

Every effective commit is one version. Rows live in Parquet files, dealt out by ranges of paths, whose hashes a manifest lists; the
state of a version is a few runs of files, of which a newer one replaces rows of an older one. Runs are merged by levels, so a row is
rewritten a logarithmic number of times. Roots are folded bucket by bucket on the executors, and only for buckets that a commit touches; the
driver folds the 2^depth buckets.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rootstone.errors import ConflictError, CorruptedError, DuplicateKeyError, InvalidError, MissingError
from rootstone.functions.commitments import BUCKET_BITS, HIDDEN, OWN, Hasher, Scheme, bucket_of, bucketed, committed, prefix_end, recommitted_plain, with_row, without_row
from rootstone.functions.local import LOCAL, estimated_bytes, from_arrow, local_rows, source_bytes
from rootstone.functions.merkle import FOLDED, GONE, OLD, PUT, ROWS, VERSIONS, Folded, Leaves, Proof, Top, bucket_at, empty, fold_alone, fold_buckets, fold_versions, prove, verify, with_leaf
from rootstone.sources import tables as stored_tables
from rootstone.sources.files import Folder
from rootstone.sources.manifests import Files, Log, Manifest, opened
from rootstone.sources.tables import DataFile

KV = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType())])
ZERO = bytes(32)
#: Runs of one level that are merged into one of the next; bytes of input for a task that writes, if there are tasks enough, and at most; rows of a
#: file, and bytes of rows that meet Python at once, at most: files are read whole, so these bound what a task holds, whatever the table's size.
RUNS, SLOT_BYTES, SLOT_MOST, FILE_ROWS, BATCH_BYTES = 8, 1 << 20, 32 << 20, 1 << 17, 16 << 20
#: What Catalyst estimates, at least, where it knows nothing of a size.
UNKNOWN = 1 << 60
#: Up to so many newer rows (by the manifests' counts) meet older ones as a broadcast of their paths; beyond it both are dealt out.
BROADCAST_ROWS = 250_000
#: Hashes of buckets, over all versions of one pass of put_batches, that come to the driver at most.
PASS_HASHES = 1 << 19
#: Leaves of a range of paths that numbers its own in a paged export.
RANGE_ROWS = 10_000


@dataclass(frozen=True)
class Op:
    """One change; value None deletes."""

    key: bytes
    value: bytes | None


def put(key: bytes, value: bytes) -> Op:
    return Op(key, value)


def delete(key: bytes) -> Op:
    return Op(key, None)


@dataclass
class Table:
    """What a table is: its id, columns, primary key and so on, as the catalog stores it."""

    id: int
    name: str
    schema: T.StructType
    primary: list[str]
    auto: str | None = None
    next_auto: int = 1
    indexes: dict[str, dict] | None = None
    declared: dict[str, str] | None = None
    comment: str = ""

    def encode(self) -> dict:
        return {
            "id": self.id, "name": self.name, "schema": self.schema.jsonValue(), "primary": self.primary, "auto": self.auto,
            "next_auto": self.next_auto, "indexes": self.indexes or {}, "declared": self.declared or {}, "comment": self.comment,
        }

    @classmethod
    def decode(cls, stored: dict) -> Table:
        return cls(**(stored | {"schema": T.StructType.fromJson(stored["schema"])}))


PLAIN = Table(0, "", KV, ["key"])


class _Hashed:
    """A table, known by itself."""

    def __init__(self, table: Table) -> None:
        self.table, self.id = table, table.id


def fail_closed(what: str):
    """Of an eager read: what storage gets wrong is a CorruptedError."""

    def wrap(run):
        def checked(*args, **more):
            try:
                return run(*args, **more)
            except PySparkException as e:
                if "USER_RAISED_EXCEPTION" in str(e):
                    raise InvalidError(str(e)[:300]) from e
                raise CorruptedError(f"{what}: {str(e)[-500:]}") from e

        checked.__doc__, checked.__name__ = run.__doc__, run.__name__
        return checked

    return wrap


class Store:
    """Not made for several writers in one process: commits take a lock; across processes the log's exclusive files decide."""

    def __init__(self, spark: SparkSession, path: str, key: bytes, storage_key: bytes | None = None, scheme: Scheme = OWN, durable: bool = True) -> None:
        if len(key) != 32 or (storage_key is not None and len(storage_key) != 32):
            raise InvalidError("keys have 32 bytes")
        self.path, self.key, self.storage_key, self.scheme = path.rstrip("/"), key, storage_key, scheme
        self.spark = spark.newSession()
        for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
            self.spark.conf.set(name, spark.conf.get(name))
        for name in ("spark.sql.files.ignoreMissingFiles", "spark.sql.files.ignoreCorruptFiles"):
            self.spark.conf.set(name, "false")
        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        self.spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.threshold", "10000")  # files are named, not searched for
        self.hasher, self.folder = Hasher(key), Folder(spark, path, durable)
        self.log = Log(self.folder, key, scheme)
        self.lock = threading.RLock()
        self.pin: int | None = None
        self._tops: dict[int, Top] = {}
        #: Versions of which the rows of some tables were derived anew up to the root.
        self._proven: dict[int, set[int]] = {}
        self.manifest: Manifest = None  # type: ignore[assignment]

    # opening

    @classmethod
    def create(cls, spark: SparkSession, path: str, key: bytes, storage_key: bytes | None = None, history: bool = False, depth: int = 8, **more) -> Store:
        """An empty store of version 0. 2^depth buckets are folded apart: about 10,000 rows each is a good size."""
        store = cls(spark, path, key, storage_key, **more)
        if store.log.versions():
            raise InvalidError(f"there is a store in {path}")
        if not 0 <= depth <= BUCKET_BITS - 4:
            raise InvalidError(f"depth is 0 to {BUCKET_BITS - 4}")
        top = Top([empty(store.scheme)] * (1 << depth), store.scheme)
        store.manifest = Manifest(0, top.root.hex(), history=history, depth=depth, sealed=storage_key is not None)
        store.log.publish(store.manifest, top)
        return store

    @classmethod
    def open_at(cls, spark: SparkSession, path: str, key: bytes, root: bytes, version: int, storage_key: bytes | None = None, history: bool | None = None, **more) -> Store:
        """At a trusted root and version; fails if storage has no such version."""
        store = cls(spark, path, key, storage_key, **more)
        store._load(version, history)
        if store.root != root:
            raise CorruptedError(f"storage has another root for version {version}")
        return store

    @classmethod
    def open_latest(cls, spark: SparkSession, path: str, key: bytes, storage_key: bytes | None = None, history: bool | None = None, **more) -> Store:
        store = cls(spark, path, key, storage_key, **more)
        versions = store.log.versions()
        if not versions:
            raise MissingError(f"there is no store in {path}")
        store._load(versions[-1], history)
        return store

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, key: bytes, storage_key: bytes | None = None, history: bool = False, depth: int = 8, **more) -> Store:
        if cls(spark, path, key, storage_key, **more).log.versions():
            return cls.open_latest(spark, path, key, storage_key, history, **more)
        return cls.create(spark, path, key, storage_key, history, depth, **more)

    def _load(self, version: int, history: bool | None) -> None:
        manifest = self.log.manifest(version)
        if history is not None and history != manifest.history:
            raise InvalidError("the store's history mode is another")
        if manifest.sealed != (self.storage_key is not None):
            raise InvalidError("the store's at-rest mode is another")
        self.manifest = manifest
        self.top(version)

    def refresh(self) -> None:
        """Moves to the newest version that any writer published."""
        newest = self.log.versions()[-1]
        if newest != self.version:
            self._load(newest, None)

    # roots

    @property
    def version(self) -> int:
        return self.manifest.version

    @property
    def root(self) -> bytes:
        return bytes.fromhex(self.manifest.root)

    @property
    def head(self) -> bytes:
        return self.head_at(self.version)

    @property
    def history(self) -> bool:
        return self.manifest.history

    def _at(self, version: int | None) -> Manifest:
        if version is None or version == self.version:
            return self.manifest
        if version > self.version or version < 0:
            raise InvalidError(f"version {version} is not written yet (current: {self.version})")
        return self.log.manifest(version)

    def root_at(self, version: int) -> bytes:
        return bytes.fromhex(self._at(version).root)

    def roots(self) -> DataFrame:
        """version, root, history_head of every version up to this one that storage has; each manifest is read and authenticated on the executors."""
        key, scheme, newest = self.key, self.scheme, self.version

        def run(batches):
            for batch in batches:
                found = [m for data in batch.column(0).to_pylist() if (m := opened(data, key, scheme))["version"] <= newest]
                columns = [[m["version"] for m in found], [bytes.fromhex(m["root"]) for m in found], [bytes.fromhex(m["head"]) for m in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["version", "root", "history_head"])

        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{self.path}/_log")
        return files.select("content").mapInArrow(run, "version long, root binary, history_head binary")

    def top(self, version: int | None = None) -> Top:
        version = self.version if version is None else version
        if version not in self._tops:
            self._tops = {version: self.log.top(version)} | dict(list(self._tops.items())[-7:])
        return self._tops[version]

    # states

    def tables(self, version: int | None = None) -> dict[str, Table]:
        return {n: Table.decode(d) for n, d in self._at(version).tables.items()}

    def table(self, name: str, version: int | None = None) -> Table:
        found = {n.lower(): t for n, t in self.tables(version).items()}.get(name.lower())
        if found is None:
            raise MissingError(f"there is no table {name}")
        return found

    def _every(self, manifest: Manifest) -> list[Table]:
        return [PLAIN, *(Table.decode(d) for d in manifest.tables.values())]

    def _rows_sealed(self, table: Table) -> bool:
        return table.id != 0 and self.storage_key is not None

    def _stored(self, table: Table) -> T.StructType:
        """Columns of a table's files. With a storage key, values of table 0 are sealed, and rows of others are one sealed column."""
        own = [T.StructField("_sealed", T.BinaryType())] if self._rows_sealed(table) else table.schema.fields
        return T.StructType([*own, *HIDDEN, T.StructField("_version", T.LongType()), T.StructField("_deleted", T.BooleanType())])

    def _keyed(self, df: DataFrame) -> DataFrame:
        """df with the storage key as a column _key, which no plan shows."""
        key = self.storage_key

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([key] * len(b), pa.binary())], [*b.schema.names, "_key"])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("_key", T.BinaryType())]))

    def _seal(self, column: str, path: Column) -> Column:
        return F.aes_encrypt(F.col(column), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), F.concat(F.lit(self.scheme.sealed), path))

    def _open(self, column: str, path: Column) -> Column:
        return F.aes_decrypt(F.col(column), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), F.concat(F.lit(self.scheme.sealed), path))

    def sealed(self, df: DataFrame, table: Table) -> DataFrame:
        """Rows as they are written."""
        if self.storage_key is None:
            return df
        if table.id == 0:
            return self._keyed(df).withColumn("value", self._seal("value", F.col("_path"))).drop("_key")
        return self._keyed(with_row(df, table.schema)).withColumn("_sealed", self._seal("_row", F.col("_path"))).drop("_row", "_key")

    def _read(self, table: Table, files: list[DataFile], columns: list[str], keep: np.ndarray | None = None, checked: bool = True) -> DataFrame:
        """Columns of files as they are stored, or opened where they are sealed."""
        stored, own = self._stored(table), [c for c in columns if c in table.schema.names]
        hidden = [c for c in columns if c not in own]
        if not self._opens(table, columns):
            return stored_tables.read(self.spark, self.path, files, T.StructType([stored[c] for c in columns]), keep, checked=checked)
        names = list(dict.fromkeys([*(own if table.id == 0 else ["_sealed"]), *hidden, "_path"]))
        rows = stored_tables.read(self.spark, self.path, files, T.StructType([stored[c] for c in names]), keep, self.storage_key, checked)
        if table.id == 0:
            return rows.withColumn("value", self._open("value", F.col("_path"))).select(*columns)
        return without_row(rows.withColumn("_row", self._open("_sealed", F.col("_path"))).drop("_sealed", "_key"), table.schema).select(*columns)

    def _wanted(self, files: list[DataFile], keep: np.ndarray | None) -> list[DataFile]:
        """Files that may have rows of the buckets to keep."""
        if keep is None:
            return files
        shift, at = BUCKET_BITS - (len(keep).bit_length() - 1), np.flatnonzero(keep)
        return [f for f in files if (i := np.searchsorted(at, f.low >> shift)) < len(at) and at[i] <= f.high >> shift]

    @staticmethod
    def _may_hold(f: DataFile, bounds: dict[str, tuple]) -> bool:
        """Whether a file may have rows with these columns within [low, high] (None: no bound)."""
        for column, (low, high) in bounds.items():
            zone = f.zones.get(column)
            if zone and (zone[0] is None or (low is not None and zone[1] < low) or (high is not None and zone[0] > high)):
                return False
        return True

    def state(
        self, table: Table = PLAIN, version: int | None = None, columns: list[str] | None = None, keep: np.ndarray | None = None,
        bounds: dict[str, tuple] | None = None, checked: bool = True, upto: list[Files] | None = None,
    ) -> DataFrame:
        """Columns (also hidden ones) of the live rows of a version. keep: of 2^n buckets, which are wanted. bounds: of columns, ranges outside of
        which rows need not be given. The files are fixed when this is called. upto: runs to read instead of the version's."""
        columns = table.schema.names if columns is None else columns
        runs = [files for _, _, files in self.log.runs(self._at(version).version)] if upto is None else upto
        runs = [own for files in runs if (own := self._wanted(files.get(str(table.id), []), keep))]
        read = lambda files, extra: self._read(table, files, list(dict.fromkeys([*columns, *extra])), keep, checked)
        if bounds and runs:
            runs[0] = [f for f in runs[0] if self._may_hold(f, bounds)]  # only there: a newer row must hide its older ones
        if checked and self._small(runs) and not self._opens(table, columns):
            here = self._state_here(table, runs, columns, keep)
            return from_arrow(self.spark, here.to_batches(), T.StructType([self._stored(table)[c] for c in columns]))
        if len(runs) < 2:
            return read(runs[0] if runs else [], ["_deleted"]).where("not _deleted").select(*columns)
        later = [f for own in runs[1:] for f in own]
        last = read(later, ["_path", "_version", "_deleted"])
        if len(runs) > 2:
            newest = F.row_number().over(Window.partitionBy("_path").orderBy(F.desc("_version")))
            last = last.withColumn("_n", newest).where("_n = 1").drop("_n")
        hidden = self._read(table, later, ["_path"], keep, checked)
        if sum(f.rows for f in later) <= BROADCAST_ROWS:
            hidden = F.broadcast(hidden)
        kept = read(runs[0], ["_path", "_deleted"]).where("not _deleted").join(hidden, "_path", "left_anti")
        return kept.select(*columns).unionByName(last.where("not _deleted").select(*columns))

    @staticmethod
    def _small(runs: list[list[DataFile]]) -> bool:
        return sum(f.size for own in runs for f in own) <= LOCAL["bytes"]

    def _opens(self, table: Table, columns: list[str]) -> bool:
        """Whether sealed columns are among these."""
        own = [c for c in columns if c in table.schema.names]
        return self.storage_key is not None and bool(own) and (table.id != 0 or "value" in own)

    def _state_here(self, table: Table, runs: list[list[DataFile]], columns: list[str], keep: np.ndarray | None) -> pa.Table:
        """The same of few bytes, on the driver."""
        names = list(dict.fromkeys([*columns, "_path", "_version", "_deleted"]))
        rows = stored_tables.read_local(self.folder, [f for own in runs for f in own], names, keep)
        schema = T.StructType([self._stored(table)[c] for c in columns])
        if rows is None:
            return to_arrow_schema(schema).empty_table()
        return self._newest_here(rows, True).select(columns)

    @staticmethod
    def _newest_here(rows: pa.Table, live: bool) -> pa.Table:
        """The newest row of each path; live: unless it is a deletion."""
        rows = rows.sort_by([("_path", "ascending"), ("_version", "ascending")]).combine_chunks()
        paths = rows.column("_path").to_pylist()
        kept = np.array([a != b for a, b in zip(paths, paths[1:], strict=False)] + [True] * bool(paths), bool)
        if live:
            kept &= ~np.array(rows.column("_deleted").to_pylist(), bool)
        return rows.filter(pa.array(kept))

    def rows(self, table: Table = PLAIN, version: int | None = None, **more) -> DataFrame:
        """The live rows of a version with the hidden columns."""
        return self.state(table, version, [*table.schema.names, *[f.name for f in HIDDEN]], **more)

    def _changes(self, table: Table, files: list[DataFile], columns: list[str]) -> DataFrame:
        """Columns of files as they are, without regard to newer ones."""
        if self._small([files]) and not self._opens(table, columns):
            rows = stored_tables.read_local(self.folder, files, columns)
            return from_arrow(self.spark, rows.to_batches() if rows else [], T.StructType([self._stored(table)[c] for c in columns]))
        return self._read(table, files, columns)

    def changes_of(self, table: Table, version: int) -> DataFrame | None:
        """The rows that a version put or deleted, with the hidden columns."""
        files = self._at(version).files.get(str(table.id))
        return self._changes(table, files, [*table.schema.names, *self._stored(table).names[-5:]]) if files else None

    def leaves(self, manifest: Manifest, keep: np.ndarray | None = None, anew: set[int] | None = None) -> DataFrame:
        """(_bucket, _path, _vh) of the rows of all tables, of some buckets; those of the tables `anew` are derived from the rows."""
        hidden, parts = ["_bucket", "_path", "_vh"], []
        for table in self._every(manifest):
            if anew is None or table.id not in anew:
                parts.append(self.state(table, manifest.version, hidden, keep))
            elif table.id == 0:
                parts.append(recommitted_plain(self.state(table, manifest.version, ["key", "value", "_path"], keep), self.key))
            else:
                rows = self.state(table, manifest.version, keep=keep)
                parts.append(committed(rows, table.schema, table.primary, table.id, self.key).select(*hidden))
        return reduce(DataFrame.unionByName, parts)

    def _leaves_here(self, manifest: Manifest, keep: np.ndarray) -> pa.Table | None:
        """The leaves of some buckets, if the files that hold them are few bytes."""
        runs = [files for _, _, files in self.log.runs(manifest.version)]
        own = {t: [w for files in runs if (w := self._wanted(files.get(str(t.id), []), keep))] for t in map(_Hashed, self._every(manifest))}
        if not self._small([files for r in own.values() for files in r]):
            return None
        return pa.concat_tables([self._state_here(t.table, r, ["_bucket", "_path", "_vh"], keep) for t, r in own.items()])

    def system_leaves(self, manifest: Manifest) -> list[tuple[bytes, bytes]]:
        out = []
        for key, value in manifest.system.items():
            path = self.hasher.path(bytes.fromhex(key))
            out.append((path, self.hasher.value(path, bytes.fromhex(value))))
        return out

    def _alone(self, manifest: Manifest, keep: np.ndarray | None, new: Files) -> np.ndarray:
        """Of each bucket, whether one file has all its leaves, those of further files included, and is read as it is: by the ranges that manifests
        state. Files that newer ones amend, or whose few rows the driver deals out, are not."""
        shift, files, runs = BUCKET_BITS - manifest.depth, [], [own for _, _, own in self.log.runs(manifest.version)]
        for table in self._every(manifest):
            own = [w for r in runs if (w := self._wanted(r.get(str(table.id), []), keep))]
            files += [f for r in own for f in r] * (1 if len(own) < 2 and not self._small(own) else 2)
        for own in new.values():
            files += own * (2 if self._small([own]) else 1)
        ends = np.zeros((1 << manifest.depth) + 1, np.int64)
        np.add.at(ends, [f.low >> shift for f in files], 1)
        np.add.at(ends, [(f.high >> shift) + 1 for f in files], -1)
        return np.cumsum(ends)[:-1] == 1

    def _fold(self, old: DataFrame, changes: DataFrame | None, before: Manifest, after: Manifest, alone: np.ndarray) -> dict[int, tuple[Folded, Folded, int, int]]:
        """Per bucket that has leaves: folded as it was and as it becomes, how many puts met a taken path, how many changes change nothing. Buckets that
        one file has (alone) are folded where it is read; the leaves of others meet by a shuffle. 2^depth rows come to the driver at most."""
        own = F.shiftright("_bucket", BUCKET_BITS - before.depth).alias("b")
        rows = old.select(own, "_path", "_vh", F.lit(OLD).alias("kind"))
        if changes is not None:
            rows = rows.unionByName(changes.select(own, "_path", "_vh", F.when(F.col("_deleted"), GONE).otherwise(PUT).alias("kind")))
        sides = [self.system_leaves(before), self.system_leaves(after)]
        fold = fold_buckets(before.depth, *sides, self.scheme)
        if (here := local_rows(rows)) is not None:
            folded = self._folded_here(fold, here)
        else:
            if alone.any():
                rows = rows.mapInArrow(fold_alone(before.depth, *sides, self.scheme, alone), ROWS)
            folded = [r.asDict() for r in rows.repartition("b").sortWithinPartitions("b").mapInArrow(fold, FOLDED).collect()]
        return self._by_bucket(folded, sides, before.depth)

    @staticmethod
    def _folded_here(fold, rows: pa.Table) -> list[dict]:
        return [r for batch in fold(rows.sort_by("b").to_batches()) for r in batch.to_pylist()]

    def _by_bucket(self, folded: list[dict], sides: list, depth: int) -> dict[int, tuple[Folded, Folded, int, int]]:
        found = {r["bucket"]: (Folded(r["old_count"], bytes(r["old_hash"])), Folded(r["count"], bytes(r["hash"])), r["taken"], r["idle"]) for r in folded}
        for bucket in {bucket_at(p, depth) for side in sides for p, _ in side} - found.keys():
            was, now = (Leaves([x for x in side if bucket_at(x[0], depth) == bucket], self.scheme).fold(depth) for side in sides)
            found[bucket] = (was, now, 0, 0)
        return found

    # commits

    def ops(self, ops: Iterable[Op] | DataFrame) -> DataFrame:
        """(key, value, _deleted), the last op of each key. A DataFrame has key, value, seq and op ('put' or 'delete'); of ops of equal key and
        seq a put comes last, and the greater value. A null or reserved key is an error."""
        reserved = self.scheme.reserved
        if isinstance(ops, DataFrame):
            rows = ops.select("key", F.when(F.col("op") == "put", F.col("value")).alias("value"), (F.col("op") == "delete").alias("_deleted"), "seq")
            if (here := local_rows(rows)) is not None:
                return self.ops(self._last_here(here))
            return self._last(rows)
        kept = {o.key: o.value for o in ops}
        if any(k is None or k.startswith(reserved) for k in kept):
            raise InvalidError("the key is null or reserved")
        columns = [pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.binary()), pa.array([v is None for v in kept.values()], pa.bool_())]
        return from_arrow(self.spark, [pa.RecordBatch.from_arrays(columns, ["key", "value", "_deleted"])], T.StructType([*KV.fields, T.StructField("_deleted", T.BooleanType())]))

    def _last(self, rows: DataFrame, *by: str) -> DataFrame:
        """The last op of each key, of each batch where by names its column."""
        reserved = self.scheme.reserved
        last = rows.groupBy(*by, "key").agg(F.max_by(F.struct("value", "_deleted"), F.struct("seq", ~F.col("_deleted"), "value")).alias("last"))
        refused = F.col("key").isNull() | (F.substring("key", 1, len(reserved)) == F.lit(reserved))
        key = F.when(refused, F.raise_error(F.lit("the key is null or reserved")).cast("binary")).otherwise(F.col("key"))
        return last.select(*by, key.alias("key"), "last.value", "last._deleted")

    @staticmethod
    def _last_here(rows: pa.Table) -> list[Op]:
        """Few ops (key, value, _deleted, seq), the last of each key last."""

        def placed(x) -> tuple:
            return (0,) if x is None else (1, tuple(map(placed, x.values())) if isinstance(x, dict) else x)

        every = sorted(rows.to_pylist(), key=lambda r: (placed(r["seq"]), not r["_deleted"], placed(r["value"])))
        return [Op(r["key"], None if r["_deleted"] else r["value"] or b"") for r in every]

    def put_batch(self, ops: Iterable[Op] | DataFrame) -> tuple[bytes, int]:
        """One version with the effective changes, or none if there are none. Returns root and version."""
        return self.commit({0: committed(self.ops(ops), KV, ["key"], 0, self.key)})

    @fail_closed("commits failed")
    def put_batches(self, ops: DataFrame) -> tuple[bytes, int]:
        """One version for each value of the column batch, in its order, with the versions, roots, heads and files that put_batch would give one by one;
        other columns are those of put_batch. All rows are hashed, written and folded together, so the number of jobs does not grow with
        that of versions (but for the merges of runs). Batches are listed on the driver. Returns the last root and version."""
        with self.lock:
            rows = ops.select("batch", "key", F.when(F.col("op") == "put", F.col("value")).alias("value"), (F.col("op") == "delete").alias("_deleted"), "seq")
            batches = [r[0] for r in rows.select("batch").distinct().collect()]
            if None in batches:
                raise InvalidError("a batch is null")
            batches.sort()
            last, most = self._last(rows, "batch"), max(1, PASS_HASHES >> self.manifest.depth)
            for i in range(0, len(batches), most):
                self._put_batches(last, batches[i : i + most])
            return self.root, self.version

    def _put_batches(self, last: DataFrame, batches: list) -> None:
        old, first = self.manifest, self.version + 1
        numbers = last.sparkSession.createDataFrame([(b, i) for i, b in enumerate(batches)], T.StructType([T.StructField("batch", last.schema["batch"].dataType), T.StructField("_at", T.IntegerType())]))
        changes = committed(last.join(F.broadcast(numbers), "batch").select("key", "value", "_deleted", "_at"), KV, ["key"], 0, self.key)
        known = self.state(columns=["_path", "_vh"]).toDF("_p", "_known")
        order = Window.partitionBy("_path").orderBy("_at")
        stated = changes.withColumn("_now", F.when(~F.col("_deleted"), F.col("_vh"))).join(known, F.col("_path") == F.col("_p"), "left")
        stated = stated.withColumn("_was", F.when(F.row_number().over(order) == 1, F.col("_known")).otherwise(F.lag("_now").over(order)))
        effective = stated.where(~F.col("_now").eqNullSafe(F.col("_was"))).withColumn("_version", (F.col("_at") + first).cast("long"))
        aside, names = f"_bulk/{uuid.uuid4().hex}", self._stored(PLAIN).names
        folders: dict[int, str] = {}
        try:
            rows = self.sealed(effective.select("key", "value", *names[2:], "_at"), PLAIN).select(*names, "_at")
            shuffle, cores = int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism
            slots = max(1, min(shuffle, max(cores, -(-estimated_bytes(rows) // (SLOT_BYTES * len(batches))))))
            dealt = rows.repartitionById(slots, F.floor(F.col("_bucket") * F.lit(slots).cast("long") / (1 << BUCKET_BITS)).cast("int")).sortWithinPartitions("_at", "_path")
            dealt.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("_at").parquet(f"{self.path}/{aside}")
            there = sorted(int(n.removeprefix("_at=")) for n in self.folder.names(aside) if n.startswith("_at="))
            if len(there) < len(batches):  # some change nothing and make no version, so others have other numbers
                if there:
                    self._put_batches(last, [batches[i] for i in there])
                return
            for i in there:
                folders[first + i] = f"data/0/{first + i:020d}-{uuid.uuid4().hex}"
                self.folder.move(f"{aside}/_at={i}", folders[first + i])
            found = stored_tables.describe_all(self.spark, self.path, list(folders.values()), [], old.depth)
            for (files, touched), top, head in self._tops_of(old, [found[folders[first + i]] for i in there]):
                before = self.manifest
                system = dict(old.system) | ({self.scheme.history_key.hex(): head.hex()} if old.history else {})
                new = replace(before, version=before.version + 1, before=before.version, root=top.root.hex(), head=head.hex(), files={"0": files}, system=system, touched=np.packbits(self._flags(touched, old.depth)).tobytes().hex())
                self.log.publish(new, top)
                folders.pop(new.version)
                self.manifest, self._tops[new.version] = new, top
                self.compact()
        finally:
            for name in (aside, *folders.values()):
                self.folder.delete(name)

    def _tops_of(self, old: Manifest, written: list[tuple[list[DataFile], set[int]]]):
        """Of versions after one, whose files and touched buckets are given: these, the tree and the head. Touched buckets are folded as they
        were, too, as a single commit does."""
        depth, scheme, first = old.depth, self.scheme, old.version + 1
        path = self.hasher.path(scheme.history_key) if old.history else None
        own = None if path is None else bucket_at(path, depth)
        system = self.system_leaves(old)
        more, was_head = [x for x in system if x[0] != path], next((vh for p, vh in system if p == path), None)
        every = set().union(*[t for _, t in written]) | ({own} if old.history else set())
        names = ["_path", "_vh", "_deleted", "_version"]
        bucket = F.shiftright("_bucket", BUCKET_BITS - depth).alias("b")
        rows = self._changes(PLAIN, [f for files, _ in written for f in files], ["_bucket", *names]).select(bucket, *names)
        leaves = self.leaves(old, self._flags(every, depth)).select(bucket, "_path", "_vh", F.lit(False).alias("_deleted"), F.lit(old.version).cast("long").alias("_version"))
        fold = fold_versions(depth, old.version, old.version + len(written), more, path, scheme)
        folded = {(r.bucket, r.version): r for r in rows.unionByName(leaves).repartition("b").sortWithinPartitions("b", "_version").mapInArrow(fold, VERSIONS).collect()}

        def bucket_of_version(b: int, version: int, head: bytes | None) -> Folded:
            r = folded.get((b, version))
            if b != own:
                return Leaves([x for x in more if bucket_at(x[0], depth) == b], scheme).fold(depth) if r is None else Folded(r["count"], bytes(r.hash))
            if r is None:
                leaf, siblings = Leaves([x for x in more if bucket_at(x[0], depth) == b], scheme).descend(int.from_bytes(path, "big"), depth)
            else:
                raw, body = r.leaf and bytes(r.leaf), bytes(r.siblings)
                leaf, siblings = (raw[:32], raw[32:]) if raw else None, [body[i : i + 32] for i in range(0, len(body), 32)]
            return with_leaf(path, head, depth, leaf, siblings, scheme)

        buckets, root, head = list(self.top().levels[-1]), bytes.fromhex(old.root), bytes.fromhex(old.head)
        for b in every:
            if bucket_of_version(b, old.version, was_head) != buckets[b]:
                raise CorruptedError(f"the rows of version {old.version} do not give its root (bucket {b})")
        for version, (files, touched) in enumerate(written, first):
            vh = None
            if old.history:
                head = scheme.chain_link(head, root, version)
                vh, touched = self.hasher.value(path, head), touched | {own}
            for b in touched:
                buckets[b] = bucket_of_version(b, version, vh)
            top = Top(list(buckets), scheme)
            root = top.root
            yield (files, touched), top, head

    def preview_batch(self, ops: Iterable[Op] | DataFrame) -> bytes:
        """The root that put_batch would give; nothing is kept."""
        return self.commit({0: committed(self.ops(ops), KV, ["key"], 0, self.key)}, preview=True)[0]

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows dealt out by ranges of paths; paths are hashes, so equal ranges are of equal size. A range ends where a bucket of the tree does, if it
        has four or more, so that files seldom share one."""
        size, read, depth = estimated_bytes(rows), source_bytes(rows), self.manifest.depth
        most = 0 if read >= UNKNOWN else -(-min(size, read) // SLOT_MOST)
        slots = max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SLOT_BYTES)), most)
        if slots == 1:
            return rows.coalesce(1)
        bits = depth if 4 * slots <= 1 << depth else BUCKET_BITS
        return rows.repartitionById(slots, F.floor(F.shiftright("_bucket", BUCKET_BITS - bits) * F.lit(slots).cast("long") / (1 << bits)).cast("int"))

    def hashed(self, rows: DataFrame, table: Table) -> tuple[DataFrame, bool]:
        """committed() of a table's rows, and whether they are dealt out already. Many are, by the buckets of their keys, before they are hashed whole, so
        that a number goes through the shuffle in place of two hashes."""
        own = (table.schema, table.primary, table.id, self.key)
        if hasattr(rows, "_held") or estimated_bytes(rows) <= LOCAL["bytes"]:
            return committed(rows, *own), False
        return committed(self._dealt(bucketed(rows, *own)).drop("_bucket"), *own), True

    def _write(self, rows: DataFrame, table: Table, name: str, version: int | None = None, dealt: bool = False) -> tuple[list[DataFile], set[int]]:
        """Writes rows, which get a version if one is given, into a new folder, dealt out by ranges of paths, if they are not so already."""
        folder = f"data/{table.id}/{name}-{uuid.uuid4().hex}"
        names, zoned = self._stored(table).names, [] if self.storage_key else stored_tables.zoned_columns(table.schema)
        if (here := local_rows(rows)) is not None:
            if version is not None:
                here = here.append_column("_version", pa.array([version] * len(here), pa.int64()))
            here = here.select(names)
            return stored_tables.write_local(self.folder, folder, here, zoned, self.manifest.depth)
        rows = (rows if version is None else rows.withColumn("_version", F.lit(version).cast("long"))).select(*names)
        rows = rows if dealt else self._dealt(rows)
        rows.sortWithinPartitions("_path").write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.path}/{folder}")
        found = stored_tables.describe(self.spark, self.path, folder, zoned, self.manifest.depth)
        if not found[0]:
            self.folder.delete(folder)
        return found

    def stage(self, rows: DataFrame, table: Table) -> DataFrame:
        """Rows (columns of the table and others, among them _path) written once beside the store and read back, sealed and checked like any."""
        if (here := local_rows(rows)) is not None:
            return from_arrow(self.spark, here.to_batches(), rows.schema)
        written, folder = self.sealed(rows, table), f"_txn/{table.id}/{uuid.uuid4().hex}"
        written.write.parquet(f"{self.path}/{folder}")
        files, _ = stored_tables.describe(self.spark, self.path, folder, [], self.manifest.depth)
        back = stored_tables.read(self.spark, self.path, files, written.schema, key=self.storage_key)
        if self._rows_sealed(table):
            back = without_row(back.withColumn("_row", self._open("_sealed", F.col("_path"))).drop("_sealed", "_key"), table.schema)
        return back.select(*rows.columns)

    def _delete(self, files: Files) -> None:
        for folder in {f.name.rsplit("/", 1)[0] for own in files.values() for f in own}:
            self.folder.delete(folder)

    def _flags(self, buckets: Iterable[int], depth: int) -> np.ndarray:
        out = np.zeros(1 << depth, bool)
        out[list(buckets)] = True
        return out

    def _as_stored(self, table: Table, files: list[DataFile]) -> DataFrame:
        """Whole rows of files, sealed columns as they are."""
        if self._small([files]):
            rows = stored_tables.read_local(self.folder, files, self._stored(table).names)
            return from_arrow(self.spark, rows.to_batches() if rows else [], self._stored(table))
        return stored_tables.read(self.spark, self.path, files, self._stored(table))

    def _effective(self, files: list[DataFile], table: Table, touched: set[int]) -> DataFrame:
        """The written changes without those that change nothing."""
        names = self._stored(table).names
        changes = self._as_stored(table, files)
        now = self.state(table, columns=["_path", "_vh"], keep=self._flags(touched, self.manifest.depth))
        if hasattr(changes, "_held") and hasattr(now, "_held"):
            known = dict(zip(*[now._held.column(c).to_pylist() for c in ("_path", "_vh")], strict=True))
            rows = zip(*[changes._held.column(c).to_pylist() for c in ("_path", "_vh", "_deleted")], strict=True)
            kept = changes._held.filter(pa.array([known.get(p) != (None if gone else vh) for p, vh, gone in rows], pa.bool_()))
            return from_arrow(self.spark, kept.to_batches(), changes.schema)
        now = now.toDF("_p", "_now")
        joined = changes.join(now, F.col("_path") == F.col("_p"), "left")
        differs = F.when(F.col("_deleted"), F.col("_now").isNotNull()).otherwise(F.col("_now").isNull() | (F.col("_now") != F.col("_vh")))
        return joined.where(differs).select(*names)

    @fail_closed("a commit failed")
    def commit(
        self,
        parts: dict[int, DataFrame],
        tables: dict[str, dict] | None = None,
        system: dict[str, str] | None = None,
        stream: tuple[str, int] | None = None,
        next_table: int | None = None,
        preview: bool = False,
        linked: bool = True,
        inserts: bool = False,
        dealt: bool = False,
    ) -> tuple[bytes, int]:
        """parts: per table id, rows with _path, _vh, _bucket, _deleted, one per path. tables, system: the new catalog, if it changes.
        inserts: all rows are new; a path that is taken, in the store or by another row, fails. dealt: rows are as hashed() dealt them out. The rows are written first; the fold
        over the buckets that they touch finds taken paths and changes without effect on its way, and no other bucket is read."""
        with self.lock:
            old, version = self.manifest, self.version + 1
            known = {0: PLAIN} | {t["id"]: Table.decode(t) for t in [*old.tables.values(), *(tables or old.tables).values()]}
            written: Files = {}
            touched: set[int] = set()
            try:
                for table_id, changes in parts.items():
                    files, buckets = self._write(self.sealed(changes, known[table_id]), known[table_id], f"{version:020d}", version, dealt)
                    if files:
                        written[str(table_id)] = files
                        touched |= buckets
                new_system = dict(old.system if system is None else system)
                changed = {k for k in old.system.keys() | new_system.keys() if old.system.get(k) != new_system.get(k)}
                same_catalog = not changed and (tables is None or tables == old.tables)
                if not written and same_catalog:
                    return self.root, self.version
                head, history_key = bytes.fromhex(old.head), self.scheme.history_key.hex()
                if old.history and linked:
                    head = self.scheme.chain_link(head, self.root, version)
                    new_system[history_key] = head.hex()
                    changed.add(history_key)
                elif old.history:
                    head = bytes.fromhex(new_system.get(history_key, ZERO.hex()))
                touched |= {bucket_at(self.hasher.path(bytes.fromhex(k)), old.depth) for k in changed}
                new = replace(
                    old, version=version, before=old.version, head=head.hex(), files=written, tables=old.tables if tables is None else tables, system=new_system,
                    next_table=next_table or old.next_table, streams=old.streams | ({stream[0]: stream[1]} if stream else {}), touched=np.packbits(self._flags(touched, old.depth)).tobytes().hex(),
                )
                top, taken, idle = self._new_top(new, known, touched)
                if inserts and taken:
                    raise DuplicateKeyError(f"{taken} primary keys are taken")
                if idle:
                    for table_id in list(written):
                        table = known[int(table_id)]
                        files, _ = self._write(self._effective(written[table_id], table, touched), table, f"{version:020d}")
                        self._delete({table_id: written.pop(table_id)})
                        if files:
                            written[table_id] = files
                    if not written and same_catalog:
                        return self.root, self.version
                new.root = top.root.hex()
                if preview:
                    self._delete(written)
                    return top.root, version
                self.log.publish(new, top)
            except Exception:
                self._delete(written)
                raise
            self.manifest = new
            self._tops[version] = top
            self.compact()
            return top.root, version

    def _new_top(self, new: Manifest, known: dict[int, Table], touched: set[int]) -> tuple[Top, int, int]:
        """The tree after a commit, and how many puts met a taken path and how many changes change nothing. Touched buckets are folded as they
        were, too: a commit onto rows that do not give the old root fails."""
        old, depth = self.manifest, self.manifest.depth
        keep, hidden = self._flags(touched, depth), ["_bucket", "_path", "_vh", "_deleted"]
        here = self._leaves_here(old, keep) if self._small(list(new.files.values())) else None
        if here is not None:
            parts = [here.append_column("kind", pa.array([OLD] * len(here), pa.int32()))]
            for files in new.files.values():
                rows = stored_tables.read_local(self.folder, files, hidden)
                kinds = pa.array([GONE if d else PUT for d in rows.column("_deleted").to_pylist()], pa.int32())
                parts.append(rows.select(hidden[:3]).append_column("kind", kinds))
            rows = pa.concat_tables(parts)
            own = pa.array(rows.column("_bucket").to_numpy() >> (BUCKET_BITS - depth), pa.int32())
            sides = [self.system_leaves(old), self.system_leaves(new)]
            folded = self._by_bucket(self._folded_here(fold_buckets(depth, *sides, self.scheme), rows.set_column(0, "b", own)), sides, depth)
        else:
            parts = [self._changes(known[int(t)], files, hidden) for t, files in new.files.items()]
            folded = self._fold(self.leaves(old, keep), reduce(DataFrame.unionByName, parts) if parts else None, old, new, self._alone(old, keep, new.files))
        buckets, taken, idle = list(self.top().levels[-1]), 0, 0
        nothing = (empty(self.scheme), empty(self.scheme), 0, 0)
        for b in touched:
            was, now, met, same = folded.get(b, nothing)
            taken, idle = taken + met, idle + same
            if was != buckets[b]:
                raise CorruptedError(f"the rows of version {old.version} do not give its root (bucket {b})")
            buckets[b] = now
        return Top(buckets, self.scheme), taken, idle

    # runs

    @staticmethod
    def _level(run: tuple) -> int:
        span, level = run[1] - run[0], 0
        while span >= RUNS:
            span, level = span // RUNS, level + 1
        return level

    def compact(self) -> None:
        """Merges the newest runs of one level while there are RUNS of it."""
        while True:
            runs = self.log.runs(self.version)
            last = runs[-RUNS:]
            if len(last) < RUNS or len({self._level(r) for r in last}) > 1:
                return
            self._merge(last)

    def _merge(self, runs: list[tuple[int, int, Files]]) -> Files:
        """Writes one run in place of several that follow each other. Deletions stay unless the run begins at the first version. A table that
        one of them has keeps its files."""
        after, upto, out = runs[0][0], runs[-1][1], {}
        manifests = {t.id: t for r in runs for t in self._every(self.log.manifest(r[1]))}
        for table_id in {t for _, _, files in runs for t in files}:
            own = [files[table_id] for _, _, files in runs if files.get(table_id)]
            table = manifests.get(int(table_id))
            if table is None:  # dropped before the end of every run
                if after:
                    out[table_id] = [f for files in own for f in files]
                continue
            if len(own) == 1 and after:
                out[table_id] = own[0]
                continue
            rows = self._as_stored(table, [f for files in own for f in files])
            if hasattr(rows, "_held"):
                kept = self._newest_here(rows._held, not after)
                rows = from_arrow(self.spark, kept.to_batches(), rows.schema)
                if files := self._write(rows, table, f"run-{upto:020d}")[0]:
                    out[table_id] = files
                continue
            if len(own) > 1:
                newest = F.row_number().over(Window.partitionBy("_path").orderBy(F.desc("_version")))
                rows = rows.withColumn("_n", newest).where("_n = 1").drop("_n")
            files, _ = self._write(rows.where("not _deleted") if not after else rows, table, f"run-{upto:020d}")
            if files:
                out[table_id] = files
        self.log.write_run(after, upto, out)
        return out

    def write_base(self, version: int | None = None) -> Files:
        """The full state of a version in one run, so reads need not merge older ones."""
        manifest = self._at(version)
        runs = self.log.runs(manifest.version)
        if len(runs) == 1 and runs[0][2] is not manifest.files:
            return runs[0][2]
        return self._merge(runs)

    # verification

    @fail_closed("a version cannot be verified")
    def verify_state(self, version: int | None = None, tables: set[int] | None = None) -> None:
        """Derives the paths and value hashes of the rows of some tables (None: all) anew, folds them with the leaves of the others and
        compares the buckets with the root's tree: content and completeness. Only buckets that were touched since a version that
        was derived before are read; scans check the hashes of what they read in any case. Fails closed."""
        manifest = self._at(version)
        tables = {t.id for t in self._every(manifest)} if tables is None else tables
        done = [v for v, of in self._proven.items() if v <= manifest.version and tables <= of]
        keep = None
        if done:
            keep = np.zeros(1 << manifest.depth, bool)
            at = manifest
            while at.version > max(done):
                keep |= at.buckets()
                at = self._at(at.before)
            if at.version != max(done):
                keep = None
        if keep is None or keep.any():
            found = self._fold(self.leaves(manifest, keep, tables), None, manifest, manifest, self._alone(manifest, keep, {}))
            buckets = self.top(manifest.version).levels[-1]
            nothing = (empty(self.scheme), empty(self.scheme), 0, 0)
            for b in range(len(buckets)) if keep is None else np.flatnonzero(keep).tolist():
                if found.get(b, nothing)[0] != buckets[b]:
                    raise CorruptedError(f"the rows of version {manifest.version} do not give its root (bucket {b})")
        self._proven[manifest.version] = self._proven.get(manifest.version, set()) | tables
        for v in sorted(self._proven)[:-8]:
            del self._proven[v]

    def check(self, mode: str, version: int | None = None, tables: set[int] | None = None) -> bool:
        """What a mode checks before a read; whether the read itself checks hashes. "full": rows are derived up to the root once, and every
        scan compares what it reads with the hashes of the manifest. "root": the tree above the buckets. "off": nothing."""
        if mode == "full":
            self.verify_state(version, tables)
        elif mode == "root":
            self.log.top(self._at(version).version)
        elif mode != "off":
            raise InvalidError("mode is full, root or off")
        return mode == "full"

    def snapshot(self, name: str | None = None, version: int | None = None, mode: str = "full", columns: list[str] | None = None) -> DataFrame:
        """Columns of a table's rows (None: plain keys and values) at a version, under a mode of check()."""
        table = PLAIN if name is None else self.table(name, version)
        checked = self.check(mode, version, {table.id})
        return self.state(table, version, columns, checked=checked)

    @staticmethod
    def _between(low: bytes, high: bytes) -> Column:
        """Whether a key is within [low, high); an empty bound is none."""
        found = F.col("key") >= F.lit(low)
        return found & (F.col("key") < F.lit(high)) if high else found

    def scan(self, start: bytes = b"", end: bytes = b"", limit: int = 0, version: int | None = None, mode: str = "full") -> DataFrame:
        """Plain keys and values within [start, end) by key; empty end: no bound; limit 0: all. Restored rows without a key are left out."""
        found = self.snapshot(version=version, mode=mode).where(F.col("key").isNotNull() & self._between(start, end)).orderBy("key")
        return found.limit(limit) if limit else found

    def scan_prefix(self, prefix: bytes, **more) -> DataFrame:
        return self.scan(prefix, prefix_end(prefix), **more)

    # points and proofs

    def _descend(self, manifest: Manifest, bucket: int, value_of: bytes | None = None) -> tuple[Leaves, bytes | None]:
        """The leaves of a bucket, and the stored value of a path, in one job. A bucket's leaves are what its proof needs."""
        keep = self._flags({bucket}, manifest.depth)
        nothing = F.lit(None).cast("binary").alias("value")
        parts = []
        for table in self._every(manifest):
            if table.id == 0 and value_of is not None:
                own = F.when(F.col("_path") == F.lit(value_of), F.col("value")).alias("value")
                found = self.state(table, manifest.version, ["_path", "_vh", "value"], keep)
                parts.append(found if hasattr(found, "_held") else found.select("_path", "_vh", own))
            else:
                found = self.state(table, manifest.version, ["_path", "_vh"], keep)
                parts.append(found if hasattr(found, "_held") else found.select("_path", "_vh", nothing))
        if not all(hasattr(p, "_held") for p in parts):  # one job for all
            parts = [p.select("_path", "_vh", *(["value"] if "value" in p.columns else [nothing])) for p in parts]
        held = [p._held.to_pylist() if hasattr(p, "_held") else None for p in parts]
        rows = [T.Row(**r) for h in held for r in h] if None not in held else reduce(DataFrame.unionByName, parts).collect()
        found = next((r.value for r in rows if value_of is not None and bytes(r._path) == value_of), None)
        system = [x for x in self.system_leaves(manifest) if bucket_at(x[0], manifest.depth) == bucket]
        return Leaves([(bytes(r._path), bytes(r._vh)) for r in rows] + system, self.scheme), None if found is None else bytes(found)

    @fail_closed("a proof cannot be made")
    def _prove(self, path: bytes, version: int | None, valued: bool = False) -> tuple[Proof, bytes | None]:
        manifest, values = self._at(version), []

        def leaves_of(bucket: int) -> Leaves:
            leaves, value = self._descend(manifest, bucket, path if valued else None)
            values.append(value)
            return leaves

        try:
            proof = prove(path, self.top(manifest.version), leaves_of)
            verify(bytes.fromhex(manifest.root), path, proof, self.scheme)
        except InvalidError as e:
            raise CorruptedError(f"the rows of version {manifest.version} do not give its root: {e}") from e
        return proof, values[0] if values else None

    def prove(self, key: bytes, version: int | None = None) -> Proof:
        return self._prove(self.hasher.path(key), version)[0]

    prove_at = prove

    def prove_all(self, keys: DataFrame, version: int | None = None) -> DataFrame:
        """(key, present, proof) of many keys at once: each bucket proves its own keys. keys: one binary column key."""
        manifest, scheme = self._at(version), self.scheme
        depth, system = manifest.depth, self.system_leaves(manifest)
        tree = self.spark.sparkContext.broadcast(self.top(manifest.version).encode())  # 33 bytes a bucket

        def routed(batches):
            """The bucket whose leaves end a key's way: its own, or the one that holds a lonely leaf above it."""
            top = Top.decode(tree.value, scheme)
            for batch in batches:
                paths = batch.column(1).to_pylist()
                own = [bucket_at(p, depth) for p in paths]
                yield pa.RecordBatch.from_arrays([pa.array([b if (w := top.way(b)[0]) is None else w for b in own], pa.int32()), *batch.columns], ["b", "key", "_path"])

        def run(batches):
            top = Top.decode(tree.value, scheme)
            now, asked, held = None, [], []

            def close():
                leaves = Leaves(held + [x for x in system if bucket_at(x[0], depth) == now], scheme)
                keys, present, proofs = [], [], []
                for key, path in asked:
                    own, above, siblings = top.way(bucket_at(path, depth))
                    leaf, below = (None, []) if own is None else (leaves.leaves[0], []) if above else leaves.descend(int.from_bytes(path, "big"), depth)
                    keys.append(key)
                    present.append(leaf is not None and leaf[0] == path)
                    proofs.append(Proof(leaf, (siblings + below)[::-1]).encode())
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(present, pa.bool_()), pa.array(proofs, pa.binary())], ["key", "present", "proof"])

            for batch in batches:
                for b, key, path, vh in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if b != now:
                        if asked:
                            yield close()
                        now, asked, held = b, [], []
                    asked.append((key, path)) if vh is None else held.append((path, vh))
            if asked:
                yield close()

        nothing = F.lit(None).cast("binary")
        paths = committed(keys.select("key", nothing.alias("value")), KV, ["key"], 0, self.key).select("key", "_path")
        questions = paths.mapInArrow(routed, "b int, key binary, _path binary").withColumn("_vh", nothing)
        own = F.shiftright("_bucket", BUCKET_BITS - depth).alias("b")
        answers = self.leaves(manifest).select(own, nothing.alias("key"), "_path", "_vh")
        dealt = questions.unionByName(answers).repartition("b").sortWithinPartitions("b")
        return dealt.mapInArrow(run, "key binary, present boolean, proof binary")

    def check_proofs(self, proofs: DataFrame, root: bytes) -> DataFrame:
        """proofs (key, present, proof) with `holds`: whether each proof establishes what present says, at this root."""
        key, names, scheme = self.key, proofs.columns, self.scheme

        def run(batches):
            hasher = Hasher(key)
            for b in batches:
                holds = []
                for k, there, encoded in zip(*[b.column(names.index(c)).to_pylist() for c in ("key", "present", "proof")], strict=True):
                    try:
                        holds.append((verify(root, hasher.path(k), Proof.decode(encoded), scheme) is not None) == there)
                    except InvalidError:
                        holds.append(False)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(holds, pa.bool_())], [*names, "holds"])

        return proofs.mapInArrow(run, T.StructType([*proofs.schema.fields, T.StructField("holds", T.BooleanType())]))

    def check_values(self, rows: DataFrame, root: bytes) -> DataFrame:
        """rows (key, value, proof) with `holds`: whether each proof establishes that the key has this value (null: none), at this root."""
        key, names, scheme = self.key, rows.columns, self.scheme

        def run(batches):
            hasher = Hasher(key)
            for b in batches:
                holds = []
                for k, v, encoded in zip(*[b.column(names.index(c)).to_pylist() for c in ("key", "value", "proof")], strict=True):
                    path = hasher.path(k)
                    try:
                        holds.append(verify(root, path, Proof.decode(encoded), scheme) == (None if v is None else hasher.value(path, v)))
                    except InvalidError:
                        holds.append(False)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(holds, pa.bool_())], [*names, "holds"])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("holds", T.BooleanType())]))

    def verify_value(self, root: bytes, key: bytes, value: bytes, proof: Proof) -> bool:
        path = self.hasher.path(key)
        return verify(root, path, proof, self.scheme) == self.hasher.value(path, value)

    def verify_absent(self, root: bytes, key: bytes, proof: Proof) -> bool:
        return verify(root, self.hasher.path(key), proof, self.scheme) is None

    def get(self, key: bytes, version: int | None = None) -> bytes | None:
        """The value, or None if absent; proven against the root either way. One job, which reads the files of one bucket."""
        path, manifest = self.hasher.path(key), self._at(version)
        proof, value = self._prove(path, manifest.version, valued=True)
        vh = verify(bytes.fromhex(manifest.root), path, proof, self.scheme)
        if key.hex() in manifest.system:
            value = bytes.fromhex(manifest.system[key.hex()])
        if vh is None:
            return None
        if value is None or self.hasher.value(path, value) != vh:
            raise CorruptedError("a value does not match its commitment")
        return value

    get_at = get

    # pruning

    def superseded(self, before: int, table: Table = PLAIN) -> DataFrame:
        """The changes that prune(before) would remove: rows with a later change up to `before`, and deletions up to it."""
        files = [f for _, _, own in self.log.runs(self.version, merged=False) for f in own.get(str(table.id), [])]
        rows = self._changes(table, files, ["_path", "_version", "_deleted"])
        later = F.lead("_version").over(Window.partitionBy("_path").orderBy("_version"))
        return rows.withColumn("_later", later).where((F.col("_later") <= before) | (F.col("_deleted") & (F.col("_version") <= before))).drop("_later")

    @fail_closed("pruning failed")
    def prune(self, before: int) -> dict[str, int]:
        """Removes what only versions before `before` need. Returns numbers of superseded rows and of roots that went."""
        with self.lock:
            if before > self.version:
                raise InvalidError(f"version {before} is not written yet")
            before = before if self.pin is None else min(before, self.pin)
            versions = self.log.versions()
            gone = [v for v in versions if v < before]
            if not gone:
                return {"rows": 0, "roots": 0}
            count = lambda files: sum(f.rows for own in files.values() for f in own)
            held = sum(count(files) for _, _, files in self.log.runs(before, merged=False))
            base = self.write_base(before)
            if (0, before) not in self.log.runs_there():
                self.log.write_run(0, before, base)
            keep = {f.name.rsplit("/", 1)[0] for v in versions if v > before for own in self.log.manifest(v).files.values() for f in own}
            for after, upto in self.log.runs_there():
                if (after == 0 and upto >= before) or after >= before:
                    keep |= {f.name.rsplit("/", 1)[0] for own in self.log.run(after, upto).values() for f in own}
                else:
                    self.log.drop_run(after, upto)
            for v in gone:
                self.log.forget(v)
            for table in self.folder.names("data"):
                for f in self.folder.names(f"data/{table}"):
                    if f"data/{table}/{f}" not in keep and int(f.removeprefix("run-")[:20]) <= self.version:
                        self.folder.delete(f"data/{table}/{f}")
            for known in (self._tops, self._proven):
                for v in [v for v in known if v < before]:
                    del known[v]
            return {"rows": held - count(base), "roots": len(gone)}

    def retain_recent(self, window: int) -> dict[str, int]:
        return self.prune(max(0, self.version - window))

    def pin_version(self, version: int | None) -> None:
        self.pin = version

    # history

    def head_at(self, version: int) -> bytes:
        manifest = self._at(version)
        if not manifest.history:
            raise InvalidError("the store keeps no history chain")
        return bytes.fromhex(manifest.head)

    @fail_closed("the history cannot be verified")
    def verify_history(self, start: int = 0, head: bytes = ZERO) -> None:
        """Recomputes the chain over the stored roots from an anchor to the live head: 32 bytes a version come to the driver, as the chain is sequential."""
        if not self.history:
            raise InvalidError("the store keeps no history chain")
        if start > self.version:
            raise InvalidError(f"version {start} is not written yet")
        roots = {r.version: bytes(r.root) for r in self.roots().where(F.col("version") >= start).select("version", "root").collect()}
        for v in range(start + 1, self.version + 1):
            if v - 1 not in roots:
                raise MissingError(f"the root of version {v - 1} was pruned")
            head = self.scheme.chain_link(head, roots[v - 1], v)
        live = self.manifest.system.get(self.scheme.history_key.hex())
        if head != self.head or (live is not None and bytes.fromhex(live) != head):
            raise CorruptedError("the stored roots do not produce the live head")

    def changes_at(self, version: int) -> DataFrame:
        """(path, value, deleted, table_id) by path: what a version changed in plain keys, rows and the catalog, without the chain's
        own leaf. Rows of tables have value null; changes_of() has their columns."""
        if version < 1 or version > self.version:
            raise InvalidError(f"version {version} is out of range")
        manifest = self._at(version)
        before = self._at(manifest.before)
        parts = []
        for table in {t.id: t for t in [*self._every(before), *self._every(manifest)]}.values():
            rows = self.changes_of(table, version)
            if rows is not None:
                value = F.col("value") if table.id == 0 else F.lit(None).cast("binary")
                parts.append(rows.select(F.col("_path").alias("path"), F.when(~F.col("_deleted"), value).alias("value"), F.col("_deleted").alias("deleted"), F.lit(table.id).alias("table_id")))
        system: list[tuple] = []
        for key in before.system.keys() | manifest.system.keys():
            now = manifest.system.get(key)
            if key != self.scheme.history_key.hex() and before.system.get(key) != now:
                system.append((self.hasher.path(bytes.fromhex(key)), None if now is None else bytes.fromhex(now), now is None, 0))
        columns = [pa.array([x[i] for x in system], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.bool_(), pa.int32()))]
        schema = T._parse_datatype_string("path binary, value binary, deleted boolean, table_id int")
        parts.append(from_arrow(self.spark, [pa.RecordBatch.from_arrays(columns, schema.names)], schema))
        return reduce(DataFrame.unionByName, parts).orderBy("path")

    # export and import

    def _system_rows(self, manifest: Manifest) -> DataFrame:
        """(path, value) of the system leaves."""
        system = [(self.hasher.path(bytes.fromhex(k)), bytes.fromhex(v)) for k, v in manifest.system.items()]
        return from_arrow(self.spark, [pa.RecordBatch.from_arrays([pa.array([x[i] for x in system], pa.binary()) for i in (0, 1)], ["path", "value"])], T._parse_datatype_string("path binary, value binary"))

    @fail_closed("an export failed")
    def snapshot_pages(self, most: int, version: int | None = None) -> DataFrame:
        """(page, path, value): all pages of a whole export at once, numbered from 0, as snapshot_leaves gives them from cursor to cursor. Leaves are
        counted by ranges of paths, one row a range (of about RANGE_ROWS leaves, 2^16 at most) on the driver; each range then numbers its own."""
        if most < 1:
            raise InvalidError("a page has a leaf at least")
        manifest = self._at(version)
        self.check("full", manifest.version, {0})
        held = sum(f.rows for _, _, files in self.log.runs(manifest.version) for f in files.get("0", [])) + len(manifest.system)
        bits = min(16, max(0, (held // RANGE_ROWS).bit_length()))
        rows = self.state(PLAIN, manifest.version, ["_path", "value"]).withColumnRenamed("_path", "path").unionByName(self._system_rows(manifest))
        rows = rows.withColumn("_range", F.shiftright(F.conv(F.hex(F.substring("path", 1, 2)), 16, 10).cast("int"), 16 - bits))
        before, at = [], 0
        for r in sorted(rows.groupBy("_range").count().collect()):
            before.append((r[0], at))
            at += r[1]
        known = self.spark.createDataFrame(before, "_range int, _before long")
        place = F.row_number().over(Window.partitionBy("_range").orderBy("path")) - 1 + F.col("_before")
        return rows.join(F.broadcast(known), "_range").select(F.floor(place / most).cast("int").alias("page"), "path", "value")

    @fail_closed("an export failed")
    def snapshot_leaves(self, after: bytes = b"", most: int = 0, version: int | None = None) -> tuple[DataFrame, bool]:
        """A page of (path, value) of plain keys in path order, strictly after a path, and whether it is the last one. most 0: all.
        The chain's own leaf travels along. A page reads only the files of its range of paths: buckets from the cursor on, as many
        as should hold the page, and twice as many until they do."""
        manifest = self._at(version)
        self.check("full", manifest.version, {0})
        extra = self._system_rows(manifest)

        def within(keep: np.ndarray | None) -> DataFrame:
            rows = self.state(PLAIN, manifest.version, ["_path", "value"], keep).withColumnRenamed("_path", "path").unionByName(extra)
            return rows.where(F.col("path") > F.lit(after))

        if not most:
            return within(None).orderBy("path"), True
        held = sum(f.rows for _, _, files in self.log.runs(manifest.version) for f in files.get("0", [])) + len(manifest.system)
        bits, first = 16, bucket_of(after.ljust(3, b"\0")) >> 8
        span = max(1, -(-2 * (most + 1) * (1 << bits) // max(1, held)))
        while True:
            end = min(1 << bits, first + span)
            keep = np.zeros(1 << bits, bool)
            keep[first:end] = True
            page = within(keep).where(F.col("path") < F.lit((end << 8).to_bytes(3, "big"))) if end < 1 << bits else within(keep)
            rows = page.orderBy("path").limit(most + 1).collect()  # a page and a row
            if len(rows) > most or end == 1 << bits:
                columns = [pa.array([r[i] for r in rows[:most]], pa.binary()) for i in (0, 1)]
                return from_arrow(self.spark, [pa.RecordBatch.from_arrays(columns, page.columns)], page.schema).orderBy("path"), len(rows) <= most
            span *= 2

    def restore_leaves(self, leaves: DataFrame | list[tuple[bytes, bytes]]) -> tuple[bytes, int]:
        """Writes (path, value) pairs, addressed by path, in one commit without a link; the last of a path wins: in a list by place, in a DataFrame by
        its column seq. A DataFrame without seq may repeat a path only with one value. Keys are unknown (null) afterwards."""
        history_path = self.hasher.path(self.scheme.history_key)
        if not isinstance(leaves, DataFrame):
            kept = dict(leaves)
            columns = [pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.binary())]
            leaves = from_arrow(self.spark, [pa.RecordBatch.from_arrays(columns, ["path", "value"])], T._parse_datatype_string("path binary, value binary"))
        elif "seq" in leaves.columns:
            leaves = leaves.groupBy("path").agg(F.max_by("value", F.struct("seq", "value")).alias("value"))
        else:
            leaves = leaves.select("path", "value").distinct()
        facts = leaves.agg(
            F.count(F.when(F.expr("path is null or octet_length(path) <> 32 or value is null"), 1)), F.count("*") - F.count_distinct("path"),
            F.max(F.when(F.col("path") == F.lit(history_path), F.col("value"))),
        ).first()
        if facts[0] or facts[1]:
            raise InvalidError("a path has 32 bytes, and one value")
        key = self.key

        def run(batches):
            hasher = Hasher(key)
            for b in batches:
                paths, values = b.column(0).to_pylist(), b.column(1).to_pylist()
                hashes = pa.array([hasher.value(p, v) for p, v in zip(paths, values, strict=True)], pa.binary())
                arrays = [pa.nulls(len(b), pa.binary()), b.column(1), pa.array([False] * len(b)), b.column(0), hashes, pa.array([bucket_of(p) for p in paths], pa.int32())]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "value", "_deleted", "_path", "_vh", "_bucket"])

        rows = leaves.where(F.col("path") != F.lit(history_path)).select("path", "value").mapInArrow(run, "key binary, value binary, _deleted boolean, _path binary, _vh binary, _bucket int")
        system = self.manifest.system | ({self.scheme.history_key.hex(): bytes(facts[2]).hex()} if facts[2] is not None else {})
        return self.commit({0: rows}, system=system, linked=False)

    def stamp_version(self, version: int) -> None:
        """Names the current state as a later version."""
        with self.lock:
            if version < self.version:
                raise InvalidError("a version cannot go back")
            if version > self.version:
                new = replace(self.manifest, version=version, before=self.version, files={}, touched="")
                self.log.publish(new, self.top())
                self._tops[version] = self.top()
                self.manifest = new

    def fork(self) -> Fork:
        return Fork(self)


class SealedFork:
    """A fork's writes in key order and the transition they make."""

    def __init__(self, ops: list[Op], before: bytes, after: bytes) -> None:
        self.ops, self.root_before, self.root_after = ops, before, after

    @property
    def is_noop(self) -> bool:
        return self.root_before == self.root_after


class Fork:
    """Writes that are kept beside the store; other keys are read from the live store."""

    def __init__(self, store: Store) -> None:
        self.store, self.version, self.writes = store, store.version, {}

    def get(self, key: bytes) -> bytes | None:
        return self.writes[key] if key in self.writes else self.store.get(key)

    def put(self, key: bytes, value: bytes) -> None:
        self.writes[key] = value

    def delete(self, key: bytes) -> None:
        self.writes[key] = None

    def pending_ops(self) -> list[Op]:
        return [Op(k, v) for k, v in sorted(self.writes.items())]

    def seal(self) -> SealedFork:
        if self.store.version != self.version:
            raise ConflictError("the store moved since the fork")
        ops = self.pending_ops()
        return SealedFork(ops, self.store.root, self.store.preview_batch(ops) if ops else self.store.root)
