"""SQL over a store: a database of tables with primary keys, sessions, and optimistic transactions.

A statement becomes a delta (rows to put and to delete, by path), which is checked and added to the session's overlay; COMMIT
writes the net delta of all tables as one version. Reads see the newest committed version, fixed per statement, under the
overlay. Everything is DataFrames: constraints are joins and groupings, and Catalyst plans the queries. A scan decodes the columns
that a statement names, and skips files by the bounds that Catalyst pushes down to a table: by the bucket of a whole primary key,
else by the ranges of column values in the authenticated manifests.
"""

from __future__ import annotations

import json
import re
import threading
from dataclasses import dataclass, field, replace
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootstone.errors import ConflictError, CorruptedError, DuplicateKeyError, InvalidError, MissingError
from rootstone.functions.commitments import BUCKET_BITS, CATALOG_PREFIX, bucket_of, committed, one_row_key, supported
from rootstone.functions.local import from_arrow
from rootstone.functions.merkle import Proof, verify
from rootstone.operators.store import Store, Table, fail_closed

from .bounds import pushed_down
from .statements import BITS, CreateTable, Statement, parse

#: Buckets by which files are left out for a whole primary key.
POINT_BITS = 16


def bucket_flags(path: bytes) -> np.ndarray:
    out = np.zeros(1 << POINT_BITS, bool)
    out[bucket_of(path) >> (BUCKET_BITS - POINT_BITS)] = True
    return out


@dataclass(frozen=True)
class VerifiedRow:
    """A row (None: absent) with the proof of it against a root."""

    row: dict | None
    path: bytes
    vh: bytes | None
    proof: Proof
    root: bytes
    version: int


class Database:
    """The SQL side of a store; sessions share it."""

    def __init__(self, store: Store, name: str = "app") -> None:
        self.store, self.name, self.lock = store, name, threading.RLock()
        store.spark.conf.set("spark.sql.ansi.enabled", "false")  # the store's own session; 1/0 is null
        store.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.next_auto: dict[int, int] = {}

    def session(self, verify: str = "full") -> Session:
        return Session(self, verify)

    # catalog

    def system(self, tables: dict[str, Table]) -> dict[str, str]:
        """System leaves: an entry per table, and what else the store keeps there."""
        other = {k: v for k, v in self.store.manifest.system.items() if not bytes.fromhex(k).startswith(CATALOG_PREFIX)}
        return other | {(CATALOG_PREFIX + n.encode()).hex(): json.dumps(t.encode(), sort_keys=True).encode().hex() for n, t in tables.items()}

    def commit(self, parts: dict[int, DataFrame], tables: dict[str, Table] | None = None, **more) -> tuple[bytes, int]:
        with self.lock:
            tables = self.store.tables() if tables is None else tables
            tables = {n: replace(t, next_auto=max(t.next_auto, self.next_auto.get(t.id, 1))) for n, t in tables.items()}
            return self.store.commit(parts, {n: t.encode() for n, t in tables.items()}, self.system(tables), **more)

    def create_table(self, name: str, schema: T.StructType, primary: list[str], **more) -> Table:
        with self.lock:
            tables = self.store.tables()
            if name.lower() in map(str.lower, tables):
                raise InvalidError(f"there is a table {name}")
            if not primary or set(primary) - set(schema.names):
                raise InvalidError("a table needs a primary key of its columns")
            if bad := [f.name for f in schema if not supported(f.dataType) or f.name.startswith("_")]:
                raise InvalidError(f"these columns cannot be stored: {', '.join(bad)}")
            fields = [T.StructField(f.name, f.dataType, f.nullable and f.name not in primary) for f in schema]
            table = Table(self.store.manifest.next_table, name, T.StructType(fields), list(primary), **more)
            self.commit({}, tables | {name: table}, next_table=table.id + 1)
            return table

    def append(self, name: str, df: DataFrame) -> tuple[bytes, int]:
        """Bulk insert of a DataFrame as one version; its keys must be new."""
        table = self.store.table(name)
        rows, dealt = self.store.hashed(df.select(*[df[f.name].cast(f.dataType) for f in table.schema]), table)
        return self.commit({table.id: rows.withColumn("_deleted", F.lit(False))}, inserts=True, dealt=dealt)

    def verified_get(self, name: str, *key) -> VerifiedRow:
        table = self.store.table(name)
        kinds = [table.schema[c].dataType for c in table.primary]
        path = self.store.hasher.path(one_row_key(list(key), kinds, table.id))
        proof, _ = self.store._prove(path, None)
        root, version = self.store.root, self.store.version
        vh = verify(root, path, proof, self.store.scheme)
        if vh is None:
            return VerifiedRow(None, path, None, proof, root, version)
        near = self.store.state(table, keep=bucket_flags(path), columns=[*table.schema.names, "_path"]).where(F.col("_path") == F.lit(path)).drop("_path")
        again = fail_closed("a row cannot be read")(committed(near, table.schema, table.primary, table.id, self.store.key).collect)()
        if len(again) != 1 or bytes(again[0]._path) != path or bytes(again[0]._vh) != vh:
            raise CorruptedError("a row does not match its commitment")
        return VerifiedRow({c: again[0][c] for c in table.schema.names}, path, vh, proof, root, version)

    def verify(self, found: VerifiedRow, root: bytes) -> bool:
        try:
            return verify(root, found.path, found.proof, self.store.scheme) == found.vh
        except InvalidError:
            return False


@dataclass(frozen=True)
class Overlay:
    """Staged deltas by table id, oldest first, and the buckets they touch. Immutable, so a savepoint is a reference."""

    deltas: dict[int, tuple[DataFrame, ...]] = field(default_factory=dict)
    buckets: dict[int, frozenset[int]] = field(default_factory=dict)

    def with_delta(self, table_id: int, delta: DataFrame, buckets: frozenset[int]) -> Overlay:
        return Overlay(
            self.deltas | {table_id: (*self.deltas.get(table_id, ()), delta)}, self.buckets | {table_id: self.buckets.get(table_id, frozenset()) | buckets}
        )

    def net(self, table_id: int) -> DataFrame | None:
        """The last delta of each path."""
        own = self.deltas.get(table_id)
        return reduce(lambda a, b: a.join(b.select("_path"), "_path", "left_anti").select(*b.columns).unionByName(b), own) if own else None


class Session:
    def __init__(self, database: Database, verify: str = "full") -> None:
        self.db, self.store, self.verify = database, database.store, verify
        self.spark = self.store.spark
        self.autocommit, self.open, self.read_only = True, False, False
        self.overlay, self.base, self.savepoints = Overlay(), self.store.version, []

    # reading

    def _rows(self, table: Table, overlay: Overlay | None = None, columns: list[str] | None = None, keep: np.ndarray | None = None, bounds: dict | None = None) -> DataFrame:
        """Columns (null: all) and the hidden ones of rows under the overlay; keep and bounds as in Store.state."""
        checked = self.store.check(self.verify, None, {table.id})
        kept = [*(table.schema.names if columns is None else columns), "_path", "_vh", "_bucket"]
        rows = self.store.state(table, columns=kept, keep=keep, bounds=bounds, checked=checked)
        net = (self.overlay if overlay is None else overlay).net(table.id)
        if net is None:
            return rows
        return rows.join(net.select("_path"), "_path", "left_anti").select(*kept).unionByName(net.where("not _deleted").select(*kept))

    def _named(self, text: str) -> dict[str, Table]:
        words = {w.lower() for w in re.findall(r"\w+", text)}
        return {n: t for n, t in self.store.tables().items() if n.lower() in words}

    def _views(self, text: str, bounds: dict[str, dict] | None = None) -> None:
        """Temporary views of the tables that a statement names, with the columns that it can mean: those whose names it has, or all where it has a
        star or a natural join."""
        low = re.sub(r"count\s*\(\s*\*\s*\)", "", text.lower())
        every = re.search(r"(select|distinct|all|,|\.)\s*\*|\bnatural\b", low)
        for name, table in self._named(text).items():
            columns = table.schema.names if every else [c for c in table.schema.names if c.lower() in low]
            found = (bounds or {}).get(name, {})
            keep = self._point(table, found)
            rows = self._rows(table, columns=columns, keep=keep, bounds=found if keep is None else None)
            rows.select(*columns).createOrReplaceTempView(name)

    def _point(self, table: Table, bounds: dict[str, tuple]) -> np.ndarray | None:
        """The buckets of a whole primary key, where one value of each of its columns is asked for."""
        values = [bounds.get(c, (None, None)) for c in table.primary]
        if any(a is None or a != b for a, b in values) or any(isinstance(table.schema[c].dataType, (T.TimestampNTZType, T.FloatType, T.DoubleType)) for c in table.primary):
            return None
        return bucket_flags(self.store.hasher.path(one_row_key([a for a, _ in values], [table.schema[c].dataType for c in table.primary], table.id)))

    def _bounds(self, text: str) -> dict[str, dict]:
        """Of each table that a query names once, the ranges of columns that Catalyst pushes down to it."""
        if not re.search(r"\bwhere\b|\bon\b", text, re.I):
            return {}
        named = self._named(text)
        for name, table in named.items():
            marked = T.StructType([*[T.StructField(f.name, f.dataType) for f in table.schema], T.StructField(f"_table_{name}", T.BooleanType())])
            self.spark.createDataFrame(self.spark.sparkContext.emptyRDD(), marked).drop(f"_table_{name}").createOrReplaceTempView(name)
        return pushed_down(self.spark.sql(text))

    def _information(self) -> None:
        tables = self.store.tables()
        rows = [(self.db.name, n, t.comment) for n, t in tables.items()]
        self.spark.createDataFrame(rows, "table_schema string, table_name string, table_comment string").createOrReplaceTempView("information_schema_tables")
        rows = [(self.db.name, n, f.name, i + 1, "YES" if f.nullable else "NO", (t.declared or {}).get(f.name, f.dataType.simpleString()), "PRI" if f.name in t.primary else "") for n, t in tables.items() for i, f in enumerate(t.schema)]
        self.spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, column_type string, column_key string").createOrReplaceTempView("information_schema_columns")
        self.spark.createDataFrame(self._indexes(tables), self.INDEXES).createOrReplaceTempView("information_schema_statistics")

    INDEXES = "table_name string, non_unique int, index_name string, seq_in_index int, column_name string"

    @staticmethod
    def _indexes(tables: dict[str, Table]) -> list[tuple]:
        found = [(n, 0, "PRIMARY", i + 1, c) for n, t in tables.items() for i, c in enumerate(t.primary)]
        return found + [(n, int(not x["unique"]), k, i + 1, c) for n, t in tables.items() for k, x in sorted((t.indexes or {}).items()) for i, c in enumerate(x["columns"])]

    def sql(self, text: str) -> DataFrame:
        """Runs one statement. Queries give rows, of the state that is newest now; changes give the number of rows they concern."""
        statement = parse(text)
        with self.db.lock:  # views are replaced per statement; a query's plan is fixed when this returns
            run = getattr(self, f"_{statement.kind}")
            return run(**statement.parts) if statement.kind == "query" else fail_closed("a statement failed")(run)(**statement.parts)

    def _query(self, text: str) -> DataFrame:
        self._gone(text)
        text = re.sub(r"\binformation_schema\.(tables|columns|statistics)\b", r"information_schema_\1", text, flags=re.I)
        if "information_schema" in text.lower():
            self._information()
        self._views(text, self._bounds(text))
        return self.spark.sql(text)

    def _gone(self, text: str) -> None:
        """Drops views of tables that no longer exist."""
        known = {n.lower() for n in self.store.tables()}
        for view in self.spark.catalog.listTables():
            if view.isTemporary and view.name.lower() not in known and not view.name.startswith("information_schema_"):
                self.spark.catalog.dropTempView(view.name)

    def _counted(self, n: int) -> DataFrame:
        return self.spark.createDataFrame([(n,)], "affected long")

    # transactions

    def _begin(self, read_only: bool) -> DataFrame:
        self._commit()
        self.open, self.read_only, self.base = True, read_only, self.store.version
        return self._counted(0)

    def _end(self) -> None:
        self.open, self.read_only, self.overlay, self.savepoints = False, False, Overlay(), []

    def _commit(self) -> DataFrame:
        overlay = self.overlay
        self._end()
        if overlay.deltas:
            self._publish(overlay)
        return self._counted(0)

    def _rollback(self) -> DataFrame:
        self._end()
        return self._counted(0)

    def _savepoint(self, name: str) -> DataFrame:
        self.savepoints = [(n, o) for n, o in self.savepoints if n != name.lower()] + [(name.lower(), self.overlay)]
        return self._counted(0)

    def _saved(self, name: str) -> int:
        at = next((i for i, (n, _) in enumerate(self.savepoints) if n == name.lower()), None)
        if at is None:
            raise MissingError(f"there is no savepoint {name}")
        return at

    def _rollback_to(self, name: str) -> DataFrame:
        at = self._saved(name)
        self.overlay, self.savepoints = self.savepoints[at][1], self.savepoints[: at + 1]
        return self._counted(0)

    def _release(self, name: str) -> DataFrame:
        self.savepoints = self.savepoints[: self._saved(name)]
        return self._counted(0)

    def _autocommit(self, on: bool) -> DataFrame:
        if on:
            self._commit()
        self.autocommit = on
        return self._counted(0)

    def _publish(self, overlay: Overlay) -> None:
        """One version for all tables; the first committer wins."""
        with self.db.lock:
            tables = {t.id: t for t in self.store.tables().values()}
            moved = self.store.version != self.base
            parts = {}
            for table_id in overlay.deltas:
                if table_id not in tables:
                    raise ConflictError("a table was dropped meanwhile")
                net, table = overlay.net(table_id), tables[table_id]
                if moved:
                    other = self._with_base(net.drop("_base"), table, overlay.buckets[table_id], "_now").join(net.select(F.col("_path").alias("_q"), "_base"), F.col("_path") == F.col("_q"))
                    other = other.where(~F.col("_base").eqNullSafe(F.col("_now")))
                    if other.limit(1).count():
                        raise ConflictError("a row was changed by another transaction")
                    try:
                        self._unique(table, overlay, net)
                    except DuplicateKeyError as e:
                        raise ConflictError(str(e)) from e
                parts[table_id] = net.drop("_base")
            self.db.commit(parts)

    def _implicit_commit(self) -> None:
        if self.read_only:
            raise InvalidError("the transaction is read only")
        self._commit()

    # definitions

    def _create_table(self, table: CreateTable) -> DataFrame:
        self._implicit_commit()
        if table.if_missing and table.name.lower() in map(str.lower, self.store.tables()):
            return self._counted(0)
        schema = T.StructType([T.StructField(c.name, c.kind, c.nullable) for c in table.columns])
        auto = [c.name for c in table.columns if c.auto]
        declared = {c.name: c.declared for c in table.columns}
        self.db.create_table(table.name, schema, table.primary, auto=auto[0] if auto else None, indexes=table.indexes, declared=declared, comment=table.comment)
        return self._counted(0)

    def _tombstones(self, table: Table) -> DataFrame:
        return self.store.rows(table).select(*table.schema.names, "_path", "_vh", "_bucket").withColumn("_deleted", F.lit(True))

    def _drop_table(self, names: list[str], if_there: bool) -> DataFrame:
        self._implicit_commit()
        for name in names:
            tables = self.store.tables()
            real = next((n for n in tables if n.lower() == name.lower()), None)
            if real is None:
                if if_there:
                    continue
                raise MissingError(f"there is no table {name}")
            table = tables.pop(real)
            self.db.commit({table.id: self._tombstones(table)}, tables)
            self.spark.catalog.dropTempView(real)
        return self._counted(0)

    def _rename_table(self, old: str, new: str) -> DataFrame:
        self._implicit_commit()
        tables, table = self.store.tables(), self.store.table(old)
        if new.lower() in map(str.lower, tables):
            raise InvalidError(f"there is a table {new}")
        del tables[table.name]
        self.db.commit({}, tables | {new: replace(table, name=new)})
        self.spark.catalog.dropTempView(table.name)
        return self._counted(0)

    def _truncate(self, name: str) -> DataFrame:
        self._implicit_commit()
        table = self.store.table(name)
        n = self.store.rows(table).count()
        self.db.commit({table.id: self._tombstones(table)})
        return self._counted(n)

    def _create_index(self, table: str, name: str, columns: list[str], unique: bool) -> DataFrame:
        self._implicit_commit()
        own = self.store.table(table)
        names = {c.lower(): c for c in own.schema.names}
        if missing := [c for c in columns if c.lower() not in names]:
            raise MissingError(f"there is no column {missing[0]}")
        if name in (own.indexes or {}):
            raise InvalidError(f"there is an index {name}")
        columns = [names[c.lower()] for c in columns]
        if unique and self._repeated(self._rows(own, columns=columns), columns).limit(1).count():
            raise DuplicateKeyError(f"rows of {table} share {', '.join(columns)}")
        self._with_table(replace(own, indexes=(own.indexes or {}) | {name: {"columns": columns, "unique": unique}}))
        return self._counted(0)

    def _with_table(self, table: Table) -> None:
        self.db.commit({}, self.store.tables() | {table.name: table})

    def _drop_index(self, name: str, table: str) -> DataFrame:
        self._implicit_commit()
        own = self.store.table(table)
        if name not in (own.indexes or {}):
            raise MissingError(f"there is no index {name}")
        self._with_table(replace(own, indexes={k: v for k, v in own.indexes.items() if k != name}))
        return self._counted(0)

    def _rename_index(self, table: str, old: str, new: str) -> DataFrame:
        self._implicit_commit()
        own = self.store.table(table)
        if old not in (own.indexes or {}) or new in own.indexes:
            raise MissingError(f"there is no index {old}, or there is one {new}")
        self._with_table(replace(own, indexes={new if k == old else k: v for k, v in own.indexes.items()}))
        return self._counted(0)

    def _show_tables(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in sorted(self.store.tables())], f"Tables_in_{self.db.name} string")

    def _show_indexes(self, table: str) -> DataFrame:
        own = self.store.table(table)
        return self.spark.createDataFrame(self._indexes({own.name: own}), self.INDEXES)

    # changes

    @staticmethod
    def _repeated(rows: DataFrame, columns: list[str]) -> DataFrame:
        """Values that several rows share; nulls are exempt."""
        there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
        return rows.where(there).groupBy(*columns).count().where("count > 1")

    def _unique(self, table: Table, overlay: Overlay, delta: DataFrame) -> None:
        for name, index in (table.indexes or {}).items():
            if index["unique"]:
                touched = delta.where("not _deleted").select(*index["columns"]).distinct()
                after = self._rows(table, overlay, columns=index["columns"]).join(touched, index["columns"], "left_semi")
                if self._repeated(after, index["columns"]).limit(1).count():
                    raise DuplicateKeyError(f"a value of the unique index {name} is taken")

    def _with_base(self, delta: DataFrame, table: Table, buckets: frozenset[int], name: str) -> DataFrame:
        """delta with the committed value hash of each path; only the buckets that it touches are read."""
        now = self.store.state(table, columns=["_path", "_vh"], keep=self.store._flags(buckets, self.store.manifest.depth)).toDF("_p", name)
        return delta.join(now, F.col("_path") == F.col("_p"), "left").drop("_p")

    def _apply(self, table: Table, delta: DataFrame, new_keys: bool) -> DataFrame:
        """Checks a statement's delta and adds it to the overlay; without an open transaction, commits it. A statement that
        fails leaves nothing. new_keys: puts may take paths that were free before."""
        if not self.open and self.autocommit or (not self.open and not self.overlay.deltas):
            self.base = self.store.version
        names = [*table.schema.names, "_path", "_vh", "_bucket", "_deleted"]
        staged = self.store.stage(delta.select(*names), table)
        shift = BUCKET_BITS - self.store.manifest.depth
        buckets = frozenset(r[0] for r in staged.select(F.shiftright("_bucket", shift)).distinct().collect())
        if new_keys:
            again = staged.where("not _deleted").groupBy("_path").count().where("count > 1").select("_path")
            puts, leaving = staged.where("not _deleted").select("_path"), staged.where("_deleted").select("_path")
            there = self._rows(table, columns=[], keep=self.store._flags(buckets, self.store.manifest.depth))
            taken = there.select("_path").join(leaving, "_path", "left_anti").join(puts, "_path", "left_semi")
            if again.unionByName(taken).limit(1).count():
                raise DuplicateKeyError(f"a primary key of {table.name} is taken")
            # a path that one row leaves and another takes is put, not deleted
            staged = staged.where("not _deleted").unionByName(staged.where("_deleted").join(puts, "_path", "left_anti").select(*names))
        based = self._with_base(staged, table, buckets, "_base")
        before = self.overlay.net(table.id)
        if before is not None:
            held = before.select(F.col("_path").alias("_q"), F.col("_base").alias("_held"), F.lit(True).alias("_known"))
            based = based.join(held, F.col("_path") == F.col("_q"), "left").withColumn("_base", F.when(F.col("_known"), F.col("_held")).otherwise(F.col("_base"))).drop("_q", "_held", "_known")
        based = based.select(*names, "_base")
        after = self.overlay.with_delta(table.id, based, buckets)
        self._unique(table, after, staged)
        n = staged.where("not _deleted").count() or staged.count()
        if self.open or not self.autocommit:
            self.overlay = after
        else:
            self._publish(Overlay().with_delta(table.id, based, buckets))
        return self._counted(n)

    def _writable(self, name: str) -> Table:
        if self.read_only:
            raise InvalidError("the transaction is read only")
        return self.store.table(name)

    def _checked(self, table: Table, value: Column, name: str, raw: T.DataType) -> Column:
        """A value cast to its column's type; what does not fit is an error."""
        kind, declared = table.schema[name].dataType, (table.declared or {}).get(name, "")
        out = value.cast(kind)
        refuse = lambda why: F.raise_error(F.lit(f"{name}: {why}")).cast(kind)
        base = re.match(r"\w*", declared).group()
        if base in BITS:
            bits, unsigned = BITS[base], "unsigned" in declared
            low, high = (0, (1 << bits) - 1) if unsigned else (-(1 << bits - 1), (1 << bits - 1) - 1)
            exact = value.cast("decimal(38,0)")
            out = F.when(value.isNotNull() & (exact.isNull() | (exact < F.lit(Decimal(low)).cast("decimal(38,0)")) | (exact > F.lit(Decimal(high)).cast("decimal(38,0)"))), refuse("the value is out of range")).otherwise(out)
        elif most := re.match(r"(var)?(char|binary)\((\d+)\)", declared):
            length = F.length(out) if most.group(2) == "char" else F.octet_length(out)
            out = F.when(length > int(most.group(3)), refuse("the value is too long")).otherwise(out)
        if not table.schema[name].nullable and name != table.auto:
            out = F.when(value.isNull(), refuse("the value is null")).otherwise(out)
        return out

    def _insert(self, table: str, columns: list[str] | None, values: bool, source: str) -> DataFrame:
        own = self._writable(table)
        names = {c.lower(): c for c in own.schema.names}
        wanted = [names.get(c.lower()) for c in columns] if columns else own.schema.names
        if None in wanted:
            raise MissingError(f"{table} has no such column")
        self._views(source)
        rows = self.spark.sql(f"SELECT * FROM {source}" if values else source)
        if len(rows.columns) != len(wanted):
            raise InvalidError("the numbers of columns and values differ")
        rows = rows.toDF(*[f"_{i}" for i in range(len(wanted))])
        given = {c: F.col(f"_{i}") for i, c in enumerate(wanted)}
        picked = rows.select(*[self._checked(own, given.get(f.name, F.lit(None)), f.name, f.dataType).alias(f.name) for f in own.schema])
        if own.auto:
            picked = self._numbered(own, picked)
        put = committed(picked, own.schema, own.primary, own.id, self.store.key).withColumn("_deleted", F.lit(False))
        return self._apply(own, put, True)

    def _numbered(self, table: Table, rows: DataFrame) -> DataFrame:
        """Allocates numbers to rows whose key is null or 0, in input order; larger explicit numbers move the counter. The rows are written once with
        their partition and place, which fixes both. Each partition gives its number of open rows and the highest start that its
        explicit numbers demand; prefix sums of these, on the driver, number the rows of each partition by itself."""
        start = max(table.next_auto, self.db.next_auto.get(table.id, 1))
        kind, number = table.schema[table.auto].dataType, F.col(table.auto).cast("decimal(21,0)")
        placed = rows.withColumn("_part", F.spark_partition_id()).withColumn("_order", F.monotonically_increasing_id())
        staged = self.store.stage(placed.withColumn("_path", F.unhex(F.hex("_order"))), table)
        if hasattr(staged, "_held"):
            return self._numbered_here(table, staged._held, start)
        fixed = staged.drop("_path").withColumn("_given", F.when(number != 0, number))
        so_far = Window.partitionBy("_part").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
        opened = F.coalesce(F.sum(F.col("_given").isNull().cast("long")).over(so_far), F.lit(0))
        counted = fixed.withColumn("_before", opened).withColumn("_demand", F.col("_given") + 1 - F.col("_before"))
        counted = counted.withColumn("_least", F.max("_demand").over(so_far))
        facts = counted.groupBy("_part").agg(F.count(F.when(F.col("_given").isNull(), 1)).alias("n"), F.max("_demand").alias("m"), F.max("_given").alias("top")).collect()
        offsets, first, total, top = {}, start, 0, start - 1  # one entry a partition
        for r in sorted(facts, key=lambda r: r._part):
            offsets[r._part] = (total, first)
            first = max(first, int(r.m) - total) if r.m is not None else first
            total += r.n
            top = max(top, int(r.top) if r.top is not None else 0)
        known = self.spark.createDataFrame([(p, n, Decimal(f)) for p, (n, f) in offsets.items()], "_p int, _offset long, _first decimal(21,0)")
        joined = counted.join(F.broadcast(known), F.col("_part") == F.col("_p"))
        least = F.greatest(F.col("_first"), F.coalesce(F.col("_least") - F.col("_offset"), F.col("_first")))
        allocated = F.coalesce(F.col("_given"), least + F.col("_offset") + F.col("_before")).cast("decimal(21,0)")
        self.db.next_auto[table.id] = max(start, top + 1, first + total if total else start)
        return joined.select(*[(allocated.cast(kind) if c == table.auto else F.col(c)).alias(c) for c in table.schema.names])

    def _numbered_here(self, table: Table, rows: pa.Table, start: int) -> DataFrame:
        """The same of few rows, on the driver."""
        rows, numbers, following = rows.sort_by("_order"), [], start
        for given in rows.column(table.auto).to_pylist():
            numbers.append(int(given) if given else following)
            following = max(following, numbers[-1] + 1)
        self.db.next_auto[table.id] = following
        at, out = rows.schema.get_field_index(table.auto), rows.select(table.schema.names)
        made = pa.array([Decimal(n) for n in numbers] if pa.types.is_decimal(rows.schema[at].type) else numbers, rows.schema[at].type)
        out = out.set_column(table.schema.names.index(table.auto), table.auto, made)
        return from_arrow(self.spark, out.to_batches(), table.schema)

    def _update(self, table: str, set: list[tuple[str, str]], where: str | None) -> DataFrame:  # noqa: A002
        own = self._writable(table)
        names = {c.lower(): c for c in own.schema.names}
        if missing := [c for c, _ in set if c.lower() not in names]:
            raise MissingError(f"{table} has no column {missing[0]}")
        self._views(" ".join([w for _, w in set] + [where or ""]))
        self._hit(own, where).createOrReplaceTempView("_rows_of_update")
        exprs = ", ".join(f"({e}) AS `_set_{i}`" for i, (_, e) in enumerate(set))
        hit = self.spark.sql(f"SELECT `{own.name}`.*, {exprs} FROM _rows_of_update AS `{own.name}`" + (f" WHERE {where}" if where else ""))
        new = {names[c.lower()]: F.col(f"_set_{i}") for i, (c, _) in enumerate(set)}
        gone = hit.select(*own.schema.names, "_path", "_vh", "_bucket").withColumn("_deleted", F.lit(True))
        picked = hit.select(*[(self._checked(own, new[f.name], f.name, f.dataType) if f.name in new else F.col(f.name)).alias(f.name) for f in own.schema])
        put = committed(picked, own.schema, own.primary, own.id, self.store.key).withColumn("_deleted", F.lit(False))
        if not {c.lower() for c in own.primary} & {c.lower() for c, _ in set}:
            return self._apply(own, put, False)
        return self._apply(own, gone.unionByName(put), True)

    def _hit(self, table: Table, where: str | None) -> DataFrame:
        """Rows among which are all that a condition meets."""
        bounds = self._bounds(f"SELECT 1 FROM `{table.name}` WHERE {where}").get(table.name, {}) if where else {}
        keep = self._point(table, bounds)
        return self._rows(table, keep=keep, bounds=bounds if keep is None else None)

    def _delete(self, table: str, where: str | None) -> DataFrame:
        own = self._writable(table)
        self._views(where or "")
        self._hit(own, where).createOrReplaceTempView("_rows_of_delete")
        hit = self.spark.sql(f"SELECT `{own.name}`.* FROM _rows_of_delete AS `{own.name}`" + (f" WHERE {where}" if where else ""))
        return self._apply(own, hit.withColumn("_deleted", F.lit(True)), False)


__all__ = ["Database", "Overlay", "Session", "Statement", "VerifiedRow"]
