"""The registered queries of the store and its SQL, run through the library's operators, and SQL for their rows.

Events are a change log of plain keys: one version per day, the last event of a user wins, an 'error' deletes. The
other tables are committed as keyed tables of a database. Statements that change rows run in transactions that are rolled back, or
commit to a database of their own.
"""

from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rootstone.errors import ConflictError, LedgerError
from rootstone.functions.columns import leaf_hash
from rootstone.functions.commitments import OWN, Hasher, key_bytes, row_bytes
from rootstone.functions.merkle import Proof
from rootstone.operators.store import PLAIN, Store, delete, put
from rootstone.plans.session import Database, Session
from rootstone.sources.tamper import Tamper
from rootstone.sources.workspace import workspace
from rootstone.streaming.feeds import changes_between

KEY, SEAL = bytes(range(32)), bytes(range(32, 64))
PRIMARY = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_id"], "events": ["event_id"], "conversations": ["conv_id", "turn"],
}
_open: dict[tuple, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each day, the last event of each user as an op of that day's batch; written once."""
    known = (spark.sparkContext.applicationId, sf_dir, "days")
    if known not in _open:
        path = workspace(spark, "days")
        last = table(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").alias("day"), "user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))
        ops = last.select(
            F.date_format("day", "yyyy-MM-dd").alias("batch"), F.concat(F.lit("u"), F.col("user_id").cast("string")).cast("binary").alias("key"),
            F.col("event_type").cast("binary").alias("value"), F.lit(0).alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
        )
        ops.write.parquet(path)
        _open[known] = spark.read.parquet(path)
    return _open[known]  # type: ignore[return-value]


def played(spark: SparkSession, sf_dir: str, name: str, days: int | None = None, **more) -> Store:
    """A new store with one version per day, of all days or the first ones. The days (not their rows) are listed."""
    store, ops = Store.create(spark, workspace(spark, name), KEY, **({"depth": 6} | more)), daily(spark, sf_dir)
    if days is not None:
        first = sorted(r.batch for r in ops.select("batch").distinct().collect())[:days]
        ops = ops.where(F.col("batch").isin(first))
    store.put_batches(ops)
    return store


def change_log(spark: SparkSession, sf_dir: str) -> Store:
    known = (spark.sparkContext.applicationId, sf_dir, "log")
    if known not in _open:
        _open[known] = played(spark, sf_dir, "events", history=True)
    return _open[known]  # type: ignore[return-value]


def scanned(spark: SparkSession, sf_dir: str, name: str) -> list[int]:
    """Numbers of rows that the tasks of a table's scan read."""
    return [r[1] for r in table(spark, sf_dir, name).groupBy(F.spark_partition_id()).count().collect()]


def keyed(spark: SparkSession, sf_dir: str, name: str, scan: list[int]) -> DataFrame:
    """A table with a key. The test tables are single small files, which one task would read; rows are dealt out once, before they are hashed, if
    the tasks of the scan do not share them about evenly by themselves."""
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    rows = rows if cores * max(scan, default=0) <= 2 * sum(scan) else rows.repartition(cores)
    return rows.withColumn("l_id", F.monotonically_increasing_id()) if name == "lineitem" else rows


def database(spark: SparkSession, sf_dir: str, *names: str) -> Database:
    """A database with these tables committed, one version each."""
    known = (spark.sparkContext.applicationId, sf_dir, names)
    if known not in _open:
        scans = {name: scanned(spark, sf_dir, name) for name in names}
        rows = sum(map(sum, scans.values()))
        db = Database(Store.create(spark, workspace(spark, "sql"), KEY, depth=max(8, (rows // 10_000).bit_length())))
        for name in names:
            rows = keyed(spark, sf_dir, name, scans[name])
            db.create_table(name, rows.schema, PRIMARY[name])
            db.append(name, rows)
        _open[known] = db
    return _open[known]  # type: ignore[return-value]


def fresh(spark: SparkSession, sf_dir: str, *names: str, **more) -> Database:
    """A database of its own with these tables, to change."""
    db = Database(Store.create(spark, workspace(spark, "own"), KEY, **({"depth": 4} | more)))
    for name in names:
        rows = table(spark, sf_dir, name)
        db.create_table(name, rows.schema, PRIMARY[name])
        db.append(name, rows)
    return db


def fails(run: Callable, kind: type | tuple = (LedgerError, PySparkException)) -> bool:
    try:
        run()
    except kind:
        return True
    return False


def text(column: str):
    return F.col(column).cast("string")


def user(key: str = "key"):
    return F.substring(text(key), 2, 20).cast("long").alias("user_id")


# plain keys


def kv_latest(spark, sf_dir):
    return change_log(spark, sf_dir).snapshot().select(user(), text("value").alias("event_type"))


def kv_as_of(spark, sf_dir):
    return change_log(spark, sf_dir).snapshot(version=13).select(user(), text("value").alias("event_type"))


def kv_changes(spark, sf_dir):
    store = change_log(spark, sf_dir)
    rows = store.changes_of(PLAIN, 14)
    return rows.select(user(), F.when(~F.col("_deleted"), text("value")).alias("event_type"), F.col("_deleted").alias("deleted"))


def kv_effective(spark, sf_dir):
    """Changes that had an effect, by version: no-ops leave no row."""
    rows = changes_between(change_log(spark, sf_dir), 0)
    return rows.groupBy("version").agg(F.count("*").alias("changes"), F.count(F.when(F.col("deleted"), 1)).alias("deletes"))


def kv_superseded(spark, sf_dir):
    return change_log(spark, sf_dir).superseded(20).groupBy(F.col("_version").alias("version")).agg(F.count("*").alias("superseded"))


def _leaf_columns(rows: DataFrame) -> DataFrame:
    return rows.select(F.lower(F.hex("path")).alias("path"), text("value").alias("event_type"))


def kv_page(spark, sf_dir):
    """The first page of an export, of 50 leaves besides the chain's own."""
    store = change_log(spark, sf_dir)
    page, _ = store.snapshot_leaves(most=51)
    return _leaf_columns(page.where(F.col("path") != F.lit(store.hasher.path(OWN.history_key))).orderBy("path").limit(50))


def kv_pages(spark, sf_dir):
    """All pages of 37 leaves, each from where the one before ends."""
    pages = change_log(spark, sf_dir).snapshot_pages(37)
    return pages.select(F.lower(F.hex("path")).alias("path"), "page")


def kv_paths(spark, sf_dir):
    rows = change_log(spark, sf_dir).rows()
    return rows.select(user(), F.lower(F.hex("_path")).alias("path"), F.lower(F.hex("_vh")).alias("vh"), F.lower(F.hex(leaf_hash(F.col("_path"), F.col("_vh")))).alias("leaf"))


def kv_root(spark, sf_dir):
    """The root over the latest plain keys alone, without the chain: committed anew as one batch."""
    latest = change_log(spark, sf_dir).snapshot()
    store = Store.create(spark, workspace(spark, "root"), KEY, depth=6)
    store.put_batch(latest.select("key", "value", F.lit(0).alias("seq"), F.lit("put").alias("op")))
    return spark.createDataFrame([(store.root.hex(),)], "root string")


def kv_proofs(spark, sf_dir):
    """Presence or absence of every user that ever had an event, proven and checked against the root."""
    store = change_log(spark, sf_dir)
    keys = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), text("user_id")).cast("binary").alias("key")).distinct()
    return store.check_proofs(store.prove_all(keys), store.root).select(user(), "present", F.col("holds").alias("verified"))


def kv_history(spark, sf_dir):
    """Versions, roots and chain heads, after the chain was verified."""
    store = change_log(spark, sf_dir)
    store.verify_history()
    store.verify_history(7, store.head_at(7))
    return store.roots().select("version", F.lower(F.hex("root")).alias("root"), F.lower(F.hex("history_head")).alias("head"))


def kv_feed(spark, sf_dir):
    """The change feed of a version: paths and values, without the chain's own leaf."""
    rows = change_log(spark, sf_dir).changes_at(14)
    return rows.select(F.lower(F.hex("path")).alias("path"), text("value").alias("event_type"), "deleted")


def kv_get(spark, sf_dir):
    """Verified point reads, now and as of a version."""
    store = change_log(spark, sf_dir)
    found = [(i, *[None if v is None else v.decode() for v in (store.get(b"u%d" % i), store.get_at(b"u%d" % i, 13))]) for i in range(1, 9)]
    return spark.createDataFrame(found, "user_id long, event_type string, before string")


def kv_preview(spark, sf_dir):
    """The root that a batch of the latest keys would give to an empty store, which stays empty."""
    latest = change_log(spark, sf_dir).snapshot()
    store = Store.create(spark, workspace(spark, "preview"), KEY, depth=5)
    root = store.preview_batch(latest.select("key", "value", F.lit(0).alias("seq"), F.lit("put").alias("op")))
    return spark.createDataFrame([(root.hex(), store.version)], "root string, version long")


def kv_reopened(spark, sf_dir):
    """The newest state through a store opened at a trusted root, and as of a version through one opened at the newest manifest."""
    log = change_log(spark, sf_dir)
    at = Store.open_at(spark, log.path, KEY, log.root, log.version, history=True)
    newest = Store.open_or_create(spark, log.path, KEY, history=True)
    refused = fails(lambda: Store.open_at(spark, log.path, KEY, log.root, log.version - 1)) and fails(lambda: Store.open_latest(spark, log.path, SEAL)) and fails(lambda: Store.open_latest(spark, log.path, KEY, history=False))
    now, before = (s.select(user(), text("value").alias("event_type"), F.lit(n).alias("read"), F.lit(refused).alias("others_refused")) for s, n in ((at.snapshot(), "now"), (newest.snapshot(version=13), "before")))
    return now.unionByName(before)


def kv_proofs_as_of(spark, sf_dir):
    """Proofs against the root of an earlier version, which do not hold against another."""
    store = change_log(spark, sf_dir)
    keys = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), text("user_id")).cast("binary").alias("key")).distinct()
    proofs = store.check_proofs(store.prove_all(keys, 13), store.root_at(13)).withColumnRenamed("holds", "verified")
    return store.check_proofs(proofs, store.root).select(user(), "present", "verified", F.col("holds").alias("elsewhere"))


def kv_values(spark, sf_dir):
    """Proofs of values: the stored one holds, a forged one and absence do not; the codec returns what it was given and refuses less."""
    store = change_log(spark, sf_dir)
    state = store.snapshot()
    proofs = store.prove_all(state.select("key")).join(state, "key").select("key", "value", "proof")
    checked = proofs
    for name, value in (("holds_own", F.col("value")), ("holds_forged", F.concat("value", F.lit(b"!"))), ("holds_absent", F.lit(None).cast("binary"))):
        stated = checked.withColumn("own", F.col("value")).withColumn("value", value)
        checked = store.check_values(stated, store.root).withColumnRenamed("holds", name).withColumn("value", F.col("own")).drop("own")

    def coded(batches):
        for b in batches:
            raw = b.column(b.schema.get_field_index("proof")).to_pylist()
            same = [Proof.decode(p).encode() == p and fails(lambda: Proof.decode(p[:-1])) and fails(lambda: Proof.decode(p + b"0")) for p in raw]  # noqa: B023
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(same)], [*b.schema.names, "codec"])

    out = checked.mapInArrow(coded, T.StructType([*checked.schema.fields, T.StructField("codec", T.BooleanType())]))
    return out.select(user(), "holds_own", "holds_forged", "holds_absent", "codec")


def kv_prefix(spark, sf_dir):
    """Keys with a prefix, by key: the range up to the prefix's successor."""
    return change_log(spark, sf_dir).scan_prefix(b"u1").select(user(), text("value").alias("event_type"))


def kv_sealed(spark, sf_dir):
    """The latest keys of a store whose values are sealed at rest; its root is that of an open one, and files are not synced."""
    log = change_log(spark, sf_dir)
    store = Store.create(spark, workspace(spark, "sealed"), KEY, storage_key=SEAL, depth=5, durable=False)
    store.put_batch(log.snapshot().select("key", "value", F.lit(0).alias("seq"), F.lit("put").alias("op")))
    return store.snapshot().select(user(), text("value").alias("event_type"), F.lit(store.root.hex()).alias("root"))


def kv_restored(spark, sf_dir):
    """An export, imported by path into an empty store and stamped with its version: rows, and whether root, version and head are the same."""
    log = change_log(spark, sf_dir)
    store = Store.create(spark, workspace(spark, "restored"), KEY, history=True, depth=4)
    store.restore_leaves(log.snapshot_leaves()[0])
    store.stamp_version(log.version)
    same = (store.root, store.version, store.head) == (log.root, log.version, log.head)
    page = store.snapshot_leaves()[0].where(F.col("path") != F.lit(store.hasher.path(OWN.history_key)))
    return _leaf_columns(page).withColumn("same", F.lit(same))


def kv_pruned(spark, sf_dir):
    """The state of a pinned version after pruning up to a later one, with what went, and whether an earlier one is gone."""
    store = played(spark, sf_dir, "pruned", days=12)
    store.pin_version(9)
    went = store.prune(11)
    gone = fails(lambda: store.snapshot(version=8))
    return store.snapshot(version=9).select(user(), text("value").alias("event_type"), F.lit(went["roots"]).alias("roots"), F.lit(gone).alias("gone"))


def kv_retained(spark, sf_dir):
    """Versions that are left when all but the newest three windows went, and the number of keys of the newest."""
    store = played(spark, sf_dir, "retained", days=10)
    store.retain_recent(3)
    store.retain_recent(3)
    n = store.snapshot().count()
    return store.roots().select("version", F.lit(n).alias("keys"))


def kv_fork(spark, sf_dir):
    """A fork's pending writes by key, and whether its sealed root is that of the commit, and a moved store is refused."""
    store = Store.create(spark, workspace(spark, "fork"), KEY, depth=4)
    store.put_batch([put(b"region-%d" % r.r_regionkey, r.r_name.encode()) for r in table(spark, sf_dir, "region").collect()])
    fork = store.fork()
    fork.put(b"region-1", b"moved")
    fork.delete(b"region-2")
    fork.put(b"region-9", b"new")
    overlay = (fork.get(b"region-1"), fork.get(b"region-2"), store.get(b"region-1") != b"moved")
    sealed = fork.seal()
    same = store.put_batch(sealed.ops)[0] == sealed.root_after and not sealed.is_noop and overlay == (b"moved", None, True)
    moved = fails(fork.seal, ConflictError)
    rows = [(o.key.decode(), None if o.value is None else o.value.decode(), same, moved) for o in sealed.ops]
    return spark.createDataFrame(rows, "key string, value string, same boolean, moved_refused boolean")


def kv_tampered(spark, sf_dir):
    """By kind of record: whether a flipped bit and a removed record are noticed by the next read, though a full read went before."""
    store = Store.create(spark, workspace(spark, "tampered"), KEY, depth=3)
    for i in range(9):
        store.put_batch([put(b"n%d" % r.n_nationkey, r.n_name.encode() + b"%d" % i) for r in table(spark, sf_dir, "nation").collect()])
    store.snapshot().collect()
    tamper, out = Tamper(store), []
    newest = {f.name for files in (store.manifest.files, store.log.run(0, 8)) for own in files.values() for f in own}
    read = lambda: Store.open_at(spark, store.path, KEY, store.root, store.version).snapshot().collect()
    for kind, names in (("data", sorted(newest)), ("manifest", [f"_log/{9:020d}.json"]), ("tree", [f"_log/{9:020d}.buckets"]), ("run", [n for n in tamper.records("_runs")])):
        for name in names:
            raw = tamper.flip(name, 40)
            flipped = fails(read) and (kind != "data" or fails(lambda: store.snapshot().collect()))
            tamper.remove(name)
            removed = fails(read) or kind == "run"  # without a run, the versions that it was made of are read
            tamper.put_back(name, raw)
            out.append((kind, flipped, removed))
    return spark.createDataFrame(out, "kind string, flipped boolean, removed boolean").groupBy("kind").agg(F.every("flipped").alias("flipped"), F.every("removed").alias("removed"))


# SQL

QUERIES_SQL: dict[str, tuple[tuple[str, ...], str, str]] = {}


def _same(name: str, tables: tuple[str, ...], statement: str, other: str | None = None) -> None:
    """A query whose text both sides run; other: where they write it differently."""
    QUERIES_SQL[name] = (tables, statement, other or statement)


_same("sql_projection", ("nation",), "SELECT n_name AS name, n_nationkey + 1 AS next_key FROM nation")
_same("sql_point", ("orders",), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
_same("sql_range", ("customer",), "SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 5000 AND c_acctbal < 9000")
_same("sql_between", ("orders",), "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000")
_same("sql_in", ("part",), "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9)")
_same("sql_min_max_count", ("orders",), "SELECT COUNT(*) AS n, MIN(o_totalprice) AS low, MAX(o_totalprice) AS high, MIN(o_orderpriority) AS first_priority FROM orders")
_same("sql_group_order", ("orders",), "SELECT o_orderstatus, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders GROUP BY o_orderstatus ORDER BY o_orderstatus")
_same("sql_join_agg", ("customer", "orders"), "SELECT c.c_name, SUM(o.o_totalprice) AS total FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_name ORDER BY c.c_name")
_same("sql_three_way", ("customer", "orders", "nation"), "SELECT n.n_name, COUNT(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
_same("sql_left_join", ("customer", "orders"), "SELECT c.c_custkey, COUNT(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 100000 GROUP BY c.c_custkey")
_same("sql_cte", ("orders",), "WITH t AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT COUNT(*) AS n FROM t WHERE total > 100000")
_same("sql_topk", ("orders",), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
_same("sql_limit_offset", ("orders",), "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
_same("sql_pricing", ("lineitem",), "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS qty, SUM(l_extendedprice * (1 - l_discount)) AS revenue, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
_same("sql_composite_key", ("conversations",), "SELECT conv_id, COUNT(*) AS turns, MAX(turn) AS last_turn FROM conversations GROUP BY conv_id")
_same("sql_datetime", ("orders",), "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'")
_same("sql_avg_distinct", ("orders",), "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers, AVG(o_totalprice) AS mean FROM orders GROUP BY o_orderstatus")
_same("sql_desc_max", ("events",), "SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY event_id DESC LIMIT 25")
_same("sql_not_like_case", ("part",), "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind FROM part WHERE NOT p_brand LIKE '%1%' OR p_size < 3")
_same("sql_point_string", ("nation",), "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7 AND n_name IS NOT NULL")
for _name, _function in {
    "win_partition_sum": "SUM(o_totalprice) OVER (PARTITION BY o_custkey)",
    "win_sliding_rows": "SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)",
    "win_lag": "LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win_lead": "LEAD(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win_rank": "CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT)",
    "win_dense_rank": "CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT)",
    "win_ntile": "CAST(NTILE(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT)",
    "win_percent_rank": "PERCENT_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win_first_value": "FIRST_VALUE(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)",
}.items():
    _same(_name, ("orders",), f"SELECT o_orderkey, {_function} AS w FROM orders")
_same("win_row_number_top1", ("orders",), "WITH r AS (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT o_custkey, o_orderkey FROM r WHERE rn = 1")


def _runs(name: str) -> Callable[[SparkSession, str], DataFrame]:
    tables, statement, _ = QUERIES_SQL[name]
    return lambda spark, sf_dir: database(spark, sf_dir, *tables).session().sql(statement)


def _within(tables: tuple[str, ...], statements: list[str], query: str) -> Callable[[SparkSession, str], DataFrame]:
    """The query's rows within a transaction after some statements; nothing is committed."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session: Session = database(spark, sf_dir, *tables).session()
        session.sql("BEGIN")
        for s in statements:
            session.sql(s)
        rows = session.sql(query)
        session.sql("ROLLBACK")
        return rows

    return run


CHANGES: dict[str, tuple[Callable, str]] = {
    "dml_insert": (
        _within(("customer",), ["INSERT INTO customer SELECT c_custkey + 100000000, c_name, c_nationkey, c_acctbal, NULL FROM customer WHERE c_acctbal < 0"], "SELECT c_custkey, c_mktsegment FROM customer"),
        "SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey + 100000000, NULL FROM customer WHERE c_acctbal < 0",
    ),
    "sql_is_null": (
        _within(("customer",), ["UPDATE customer SET c_mktsegment = NULL WHERE c_acctbal < 0"], "SELECT c_custkey FROM customer WHERE c_mktsegment IS NULL"),
        "SELECT c_custkey FROM customer WHERE c_acctbal < 0",
    ),
    "dml_update": (
        _within(("customer",), ["UPDATE customer SET c_acctbal = c_acctbal * 2 + 1 WHERE c_nationkey BETWEEN 3 AND 9"], "SELECT c_custkey, c_acctbal FROM customer"),
        "SELECT c_custkey, CASE WHEN c_nationkey BETWEEN 3 AND 9 THEN c_acctbal * 2 + 1 ELSE c_acctbal END AS c_acctbal FROM customer",
    ),
    "dml_delete": (
        _within(("orders",), ["DELETE FROM orders WHERE o_orderstatus = 'F'"], "SELECT o_orderkey FROM orders"),
        "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
    ),
    "dml_move_key": (
        _within(("supplier",), ["UPDATE supplier SET s_suppkey = s_suppkey + 1"], "SELECT s_suppkey, s_name FROM supplier"),
        "SELECT s_suppkey + 1 AS s_suppkey, s_name FROM supplier",
    ),
    "txn_overlay": (
        _within(("part",), ["DELETE FROM part WHERE p_size > 25", "UPDATE part SET p_retailprice = 0 WHERE p_size = 1", "INSERT INTO part VALUES (900000001, 'new', 'b', 't', 7, 1.5)"], "SELECT p_partkey, p_retailprice FROM part"),
        "SELECT p_partkey, CASE WHEN p_size = 1 THEN 0 ELSE p_retailprice END AS p_retailprice FROM part WHERE p_size <= 25 UNION ALL SELECT 900000001, 1.5",
    ),
    "txn_savepoint": (
        _within(("part",), ["UPDATE part SET p_size = p_size + 1", "SAVEPOINT a", "DELETE FROM part", "ROLLBACK TO SAVEPOINT a"], "SELECT p_partkey, p_size FROM part"),
        "SELECT p_partkey, CAST(p_size + 1 AS INTEGER) AS p_size FROM part",
    ),
    "txn_net_noop": (
        _within(("nation",), ["INSERT INTO nation VALUES (100, 'x', 1)", "DELETE FROM nation WHERE n_nationkey = 100"], "SELECT n_nationkey, n_name FROM nation"),
        "SELECT n_nationkey, n_name FROM nation",
    ),
}


def uniq_violations(spark, sf_dir):
    """Values that would break a unique index, as the check before CREATE UNIQUE INDEX finds them."""
    session = database(spark, sf_dir, "part").session()
    return session._repeated(session._rows(session.store.table("part"), columns=["p_name"]), ["p_name"]).select("p_name", F.col("count").alias("n"))


def autoinc_assign(spark, sf_dir):
    """Numbers of nations that queue by name: given ones move the counter, which survives reopening."""
    db = fresh(spark, sf_dir)
    session = db.session()
    session.sql("CREATE TABLE queue (place BIGINT UNSIGNED PRIMARY KEY AUTO_INCREMENT, nation VARCHAR(60) NOT NULL)")
    names = sorted(r.n_name for r in table(spark, sf_dir, "nation").collect())
    session.sql("INSERT INTO queue (nation) VALUES " + ", ".join(f"('{n}')" for n in names[:10]))
    session.sql("INSERT INTO queue VALUES (50, 'guest'), " + ", ".join(f"({i % 2 and 'NULL' or 0}, '{n}')" for i, n in enumerate(names[10:20])))
    again = Database(Store.open_latest(spark, db.store.path, KEY)).session()
    again.sql("INSERT INTO queue (nation) VALUES " + ", ".join(f"('{n}')" for n in names[20:]))
    return again.sql("SELECT CAST(place AS BIGINT) AS place, nation FROM queue")


def show_tables(spark, sf_dir):
    return database(spark, sf_dir, "customer", "orders", "nation").session().sql("SHOW TABLES").toDF("name")


def sql_verified_rows(spark, sf_dir):
    """Rows by primary key with proofs against the root: some are there, some are not."""
    db = database(spark, sf_dir, "nation")
    found = [(k, r.row["n_name"] if r.row else None, db.verify(r, db.store.root), db.verify(r, bytes(32))) for k in (0, 3, 7, 24, 25, 99) for r in [db.verified_get("nation", k)]]
    return spark.createDataFrame(found, "n_nationkey long, n_name string, verified boolean, elsewhere boolean")


def sql_literals(spark, sf_dir):
    session = fresh(spark, sf_dir).session()
    session.sql("CREATE TABLE kinds (k TINYINT PRIMARY KEY, b VARBINARY(10), d DOUBLE, f FLOAT, t DATETIME(6), s TEXT, u INT UNSIGNED)")
    session.sql("INSERT INTO kinds VALUES (-5, X'C0FFEE00', -12.75, 0.5, '1999-12-31 23:59:59.125', 'it''s', 4294967295), (6, NULL, 1e3, NULL, NULL, '', 0)")
    return session.sql("SELECT CAST(k AS INT) AS k, hex(b) AS b, d, CAST(f AS DOUBLE) AS f, t, s, CAST(u AS BIGINT) AS u FROM kinds")


def sql_information_schema(spark, sf_dir):
    session = database(spark, sf_dir, "customer", "orders", "nation").session()
    return session.sql("SELECT table_name, column_name, ordinal_position, column_key FROM information_schema.columns")


def _ran(statements: str, query: str, *names: str):
    """The query's rows after statements of one or more sessions (a: and b:) on a database of its own, which reopens before."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = fresh(spark, sf_dir, *names)
        sessions = {"a": db.session(), "b": db.session()}
        refused = 0
        for line in filter(None, map(str.strip, statements.split(";"))):
            who, _, statement = line.partition(":")
            must_fail = who.endswith("!")
            try:
                sessions[who.rstrip("!").strip()].sql(statement.strip())
            except LedgerError:
                if not must_fail:
                    raise
                refused += 1
        again = Database(Store.open_latest(spark, db.store.path, KEY)).session()
        return again.sql(query).withColumn("refused", F.lit(refused)).withColumn("version", F.lit(db.store.version))

    return run


REGIONS = "SELECT r_regionkey, r_name FROM region"
#: By name: statements (! marks those that must fail), the query, its tables; and SQL for the rows, without refused and version, which follow. A table
#: takes two versions: its definition and its rows.
COMMITTED: dict[str, tuple[str, str, tuple[str, ...], str, int, int]] = {
    "txn_commit": (
        "a: BEGIN; a: DELETE FROM region WHERE r_regionkey = 0; a: UPDATE region SET r_name = 'two' WHERE r_regionkey = 2; a: INSERT INTO region VALUES (70, 'seventy'); a: COMMIT",
        REGIONS, ("region",), "SELECT r_regionkey, CASE r_regionkey WHEN 2 THEN 'two' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 0 UNION ALL SELECT 70, 'seventy'", 0, 3,
    ),
    "txn_rollback": ("a: BEGIN; a: DELETE FROM region; a: INSERT INTO region VALUES (70, 'x'); a: ROLLBACK", REGIONS, ("region",), REGIONS, 0, 2),
    "txn_two_tables": (
        "a: BEGIN; a: UPDATE region SET r_name = 'R' WHERE r_regionkey = 1; a: UPDATE nation SET n_name = 'N' WHERE n_regionkey = 1; a: COMMIT",
        "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", ("region", "nation"),
        "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'N' ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN 'R' ELSE r_name END AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey", 0, 5,
    ),
    "txn_statement_atomic": (
        "a: BEGIN; a: INSERT INTO region VALUES (70, 'x'); a!: INSERT INTO region VALUES (71, 'y'), (1, 'z'); a!: UPDATE region SET r_regionkey = 9; a: COMMIT",
        REGIONS, ("region",), f"{REGIONS} UNION ALL SELECT 70, 'x'", 2, 3,
    ),
    "txn_savepoints": (
        "a: BEGIN; a: DELETE FROM region WHERE r_regionkey = 0; a: SAVEPOINT one; a: DELETE FROM region WHERE r_regionkey = 1; a: SAVEPOINT two; a: DELETE FROM region; a: ROLLBACK TO SAVEPOINT TWO;"
        "a: RELEASE SAVEPOINT one; a!: ROLLBACK TO two; a: COMMIT",
        REGIONS, ("region",), f"{REGIONS} WHERE r_regionkey > 1", 1, 3,
    ),
    "txn_read_only": ("a: START TRANSACTION READ ONLY; a!: DELETE FROM region; a: COMMIT; a: DELETE FROM region WHERE r_regionkey = 4", REGIONS, ("region",), f"{REGIONS} WHERE r_regionkey <> 4", 1, 3),
    "txn_autocommit": (
        "a: SET autocommit = 0; a: DELETE FROM region WHERE r_regionkey = 0; a: ROLLBACK; a: DELETE FROM region WHERE r_regionkey = 1; a: SET autocommit = 1; a: DELETE FROM region WHERE r_regionkey = 2",
        REGIONS, ("region",), f"{REGIONS} WHERE r_regionkey NOT IN (1, 2)", 0, 4,
    ),
    "txn_ddl_commits": (
        "a: BEGIN; a: DELETE FROM region WHERE r_regionkey = 3; a: CREATE INDEX names ON region (r_name); a: ROLLBACK", REGIONS, ("region",), f"{REGIONS} WHERE r_regionkey <> 3", 0, 4,
    ),
    "txn_conflict": (
        "a: BEGIN; a: UPDATE region SET r_name = 'mine' WHERE r_regionkey = 1; b: UPDATE region SET r_name = 'theirs' WHERE r_regionkey = 1; a!: COMMIT;"
        "a: BEGIN; a: UPDATE region SET r_name = 'mine' WHERE r_regionkey = 2; b: UPDATE region SET r_name = 'theirs' WHERE r_regionkey = 3; a: COMMIT",
        REGIONS, ("region",), "SELECT r_regionkey, CASE WHEN r_regionkey IN (1, 3) THEN 'theirs' WHEN r_regionkey = 2 THEN 'mine' ELSE r_name END AS r_name FROM region", 1, 5,
    ),
    "txn_unique_at_commit": (
        "a: CREATE UNIQUE INDEX names ON region (r_name); a: BEGIN; a: INSERT INTO region VALUES (70, 'new'); b: INSERT INTO region VALUES (80, 'new'); a!: COMMIT",
        REGIONS, ("region",), f"{REGIONS} UNION ALL SELECT 80, 'new'", 1, 4,
    ),
    "txn_crash": ("a: BEGIN; a: DELETE FROM region; a: UPDATE nation SET n_name = 'x'", REGIONS, ("region", "nation"), REGIONS, 0, 4),
    "txn_isolation": (
        "a: BEGIN; a: INSERT INTO region SELECT n_nationkey + 500, n_name FROM nation; b: DELETE FROM nation WHERE n_regionkey = 0; b: INSERT INTO region SELECT n_nationkey + 900, n_name FROM nation; a: COMMIT",
        REGIONS, ("region", "nation"),
        f"{REGIONS} UNION ALL SELECT n_nationkey + 500, n_name FROM nation UNION ALL SELECT n_nationkey + 900, n_name FROM nation WHERE n_regionkey <> 0", 0, 7,
    ),
    "uniq_enforced": (
        "a: CREATE UNIQUE INDEX names ON region (r_name); a!: INSERT INTO region SELECT r_regionkey + 70, r_name FROM region; a!: UPDATE region SET r_name = 'same';"
        "a: INSERT INTO region VALUES (70, NULL), (71, NULL); a: BEGIN; a: UPDATE region SET r_name = concat(r_name, '!') WHERE r_regionkey = 1; a: INSERT INTO region SELECT 90, replace(r_name, '!', '') FROM region WHERE r_regionkey = 1; a: COMMIT",
        REGIONS, ("region",),
        "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN r_name || '!' ELSE r_name END AS r_name FROM region UNION ALL SELECT 70, NULL UNION ALL SELECT 71, NULL UNION ALL SELECT 90, r_name FROM region WHERE r_regionkey = 1", 2, 5,
    ),
    "ddl_drop": (
        "a: DROP TABLE nation; a!: DROP TABLE nation; a: DROP TABLE IF EXISTS nation", "SELECT table_name FROM information_schema.tables", ("region", "nation"), "SELECT 'region' AS table_name", 1, 5,
    ),
    "ddl_rename": ("a: RENAME TABLE nation TO lands; a!: RENAME TABLE region TO lands", "SELECT n_nationkey, n_name FROM lands", ("region", "nation"), "SELECT n_nationkey, n_name FROM nation", 1, 5),
    "ddl_truncate": (
        "a: TRUNCATE TABLE nation; a: INSERT INTO nation SELECT r_regionkey, r_name, 0 FROM region", "SELECT n_nationkey, n_name FROM nation", ("region", "nation"),
        "SELECT r_regionkey AS n_nationkey, r_name AS n_name FROM region", 0, 6,
    ),
    "ddl_indexes": (
        "a: CREATE INDEX one ON nation (n_regionkey, n_name); a: CREATE UNIQUE INDEX two ON nation (n_name); a!: CREATE UNIQUE INDEX bad ON nation (n_regionkey); a: ALTER TABLE nation RENAME INDEX one TO three; a: DROP INDEX two ON nation",
        "SELECT index_name, non_unique, seq_in_index, column_name FROM information_schema.statistics", ("nation",),
        "SELECT * FROM (VALUES ('PRIMARY', 0, 1, 'n_nationkey'), ('three', 1, 1, 'n_regionkey'), ('three', 1, 2, 'n_name')) AS x (index_name, non_unique, seq_in_index, column_name)", 1, 6,
    ),
    "sql_multi_column": (
        "a: CREATE INDEX both ON nation (n_regionkey, n_nationkey)", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey BETWEEN 2 AND 20", ("nation",),
        "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey BETWEEN 2 AND 20", 0, 3,
    ),
    "dml_noops": (
        "a: UPDATE region SET r_name = r_name; a: DELETE FROM region WHERE r_regionkey = 99; a: UPDATE region SET r_name = 'x' WHERE r_regionkey = 1; a: UPDATE region SET r_name = 'x' WHERE r_regionkey < 2",
        REGIONS, ("region",), "SELECT r_regionkey, CASE WHEN r_regionkey < 2 THEN 'x' ELSE r_name END AS r_name FROM region", 0, 4,
    ),
}


def fn_key_bytes(spark, sf_dir):
    """Primary keys as bytes, whose order is the order of the keys."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    kinds = [f.dataType for f in rows.schema][:1]

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k.hex() for k in key_bytes([b.column(0)], kinds, 7)])], ["o_orderkey", "key"])

    return rows.mapInArrow(run, "o_orderkey long, key string")


def fn_row_bytes(spark, sf_dir):
    """Rows as canonical bytes, and their commitments under the key."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    kinds, key = [f.dataType for f in rows.schema], KEY

    def run(batches):
        hasher = Hasher(key)
        for b in batches:
            raw = row_bytes(list(b.columns), kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.hex() for r in raw]), pa.array([hasher.path(r).hex() for r in raw])], ["c_custkey", "row", "mac"])

    return rows.mapInArrow(run, "c_custkey long, row string, mac string")


# DuckDB

CHANGE_SQL = """
log AS (
  SELECT user_id, date_trunc('day', ts) AS day, arg_max(event_type, struct_pack(t := ts, e := event_id)) AS event_type
  FROM events GROUP BY ALL
), numbered AS (
  SELECT l.user_id, l.event_type, w.version FROM log l JOIN (SELECT day, row_number() OVER (ORDER BY day) AS version FROM (SELECT DISTINCT day FROM log)) w USING (day)
)
"""


def _as_of(condition: str) -> str:
    return f"SELECT user_id, arg_max(event_type, version) AS event_type FROM numbered WHERE {condition} GROUP BY user_id HAVING arg_max(event_type, version) <> 'error'"


def _blob(raw: bytes) -> str:
    return f"unhex('{raw.hex()}')"


def _hmac(message: str) -> str:
    key = KEY.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    return f"unhex(sha256({_blob(outer)} || unhex(sha256({_blob(inner)} || {message}))))"


HASHED_SQL = f"""
state AS ({_as_of("true")}),
pathed AS (SELECT *, {_hmac("encode('p' || 'u' || user_id)")} AS p FROM state),
hashed AS (SELECT *, {_hmac("encode('v') || p || encode(event_type)")} AS v FROM pathed)
"""
EFFECTIVE_SQL = """
stated AS (
  SELECT *, nullif(event_type, 'error') AS now, lag(nullif(event_type, 'error')) OVER (PARTITION BY user_id ORDER BY version) AS before FROM numbered
), effective AS (
  SELECT * FROM stated WHERE now IS DISTINCT FROM before
)
"""

HEAD_PATH = _hmac(_blob(b"p" + OWN.history_key))
#: Roots with the chain's own leaf and heads, version by version: the siblings on the way to that leaf are those of the keys alone, by version;
#: the chain then folds them with the leaf, whose value is the head that follows from the root before.
HISTORY_SQL = f"""
WITH RECURSIVE {CHANGE_SQL}, versions AS (SELECT DISTINCT version FROM numbered
), state AS (
  SELECT v.version, n.user_id, arg_max(n.event_type, n.version) AS event_type FROM versions v JOIN numbered n ON n.version <= v.version
  GROUP BY v.version, n.user_id HAVING arg_max(n.event_type, n.version) <> 'error'
), pathed AS (SELECT *, {_hmac("encode('p' || 'u' || user_id)")} AS p FROM state
), hashed AS (SELECT version, p, {_hmac("encode('v') || p || encode(event_type)")} AS v FROM pathed
), folded AS (
  SELECT version, 32 AS depth, CAST('0x' || substr(hex(p), 1, 8) AS BIGINT) AS prefix, 1 AS n, sha256({_blob(OWN.leaf)} || p || v) AS h FROM hashed
  UNION ALL
  SELECT version, depth - 1, prefix // 2, CAST(sum(n) AS INTEGER),
         CASE WHEN sum(n) = 1 THEN max(h) ELSE sha256({_blob(OWN.inner)} || unhex(coalesce(max(h) FILTER (prefix % 2 = 0), '{OWN.placeholder.hex()}')) || unhex(coalesce(max(h) FILTER (prefix % 2 = 1), '{OWN.placeholder.hex()}'))) END
  FROM folded WHERE depth > 0 GROUP BY version, depth, prefix // 2
), head AS (SELECT {HEAD_PATH} AS hp
), bits AS (SELECT hp, CAST('0x' || substr(hex(hp), 1, 8) AS BIGINT) AS top FROM head
), deep AS (
  SELECT v.version, (SELECT coalesce(max(f.depth) + 1, 0) FROM folded f, bits WHERE f.version = v.version AND f.prefix = bits.top >> (32 - f.depth)) AS d FROM versions v
), steps AS (
  SELECT e.version, s.depth, CAST((bits.top >> (32 - s.depth)) & 1 AS VARCHAR) || coalesce(f.h, '{OWN.placeholder.hex()}') AS step
  FROM deep e, bits, (SELECT unnest(range(1, 33)) AS depth) s
  LEFT JOIN folded f ON f.version = e.version AND f.depth = s.depth AND f.prefix = xor(bits.top >> (32 - s.depth), 1)
  WHERE s.depth <= e.d
), ways AS (
  SELECT v.version, coalesce(list(s.step ORDER BY s.depth DESC) FILTER (s.step IS NOT NULL), []) AS steps FROM versions v LEFT JOIN steps s USING (version) GROUP BY v.version
), heads AS (
  SELECT CAST(0 AS BIGINT) AS version, '{OWN.placeholder.hex()}' AS root, '{bytes(32).hex()}' AS head
  UNION ALL
  SELECT w.version,
         list_reduce(list_concat([sha256({_blob(OWN.leaf)} || hp || {_hmac("encode('v') || hp || unhex(x.now)")})], w.steps),
                     lambda a, s: CASE WHEN s[1] = '1' THEN sha256({_blob(OWN.inner)} || unhex(s[2:]) || unhex(a)) ELSE sha256({_blob(OWN.inner)} || unhex(a) || unhex(s[2:])) END),
         x.now
  FROM (SELECT version, sha256({_blob(OWN.chain)} || unhex(head) || unhex(root) || unhex(printf('%016x', version + 1))) AS now FROM heads) x
  JOIN ways w ON w.version = x.version + 1, head
)
SELECT version, root, head FROM heads
"""

ORACLE = {
    "kv_latest": f"WITH {CHANGE_SQL} {_as_of('true')}",
    "kv_as_of": f"WITH {CHANGE_SQL} {_as_of('version <= 13')}",
    "kv_changes": f"WITH {CHANGE_SQL}, a AS ({_as_of('version <= 13')}), b AS ({_as_of('version <= 14')}) SELECT coalesce(a.user_id, b.user_id) AS user_id, b.event_type, b.user_id IS NULL AS deleted FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.event_type IS DISTINCT FROM b.event_type",
    "kv_effective": f"WITH {CHANGE_SQL}, {EFFECTIVE_SQL} SELECT version, count(*) AS changes, count(*) FILTER (now IS NULL) AS deletes FROM effective GROUP BY version",
    "kv_superseded": f"WITH {CHANGE_SQL}, {EFFECTIVE_SQL} SELECT version, count(*) AS superseded FROM (SELECT *, lead(version) OVER (PARTITION BY user_id ORDER BY version) AS later FROM effective) WHERE later <= 20 OR (now IS NULL AND version <= 20) GROUP BY version",
    "kv_page": f"WITH {CHANGE_SQL}, {HASHED_SQL} SELECT lower(hex(p)) AS path, event_type FROM hashed ORDER BY p LIMIT 50",
    "kv_paths": f"WITH {CHANGE_SQL}, {HASHED_SQL} SELECT user_id, lower(hex(p)) AS path, lower(hex(v)) AS vh, sha256({_blob(OWN.leaf)} || p || v) AS leaf FROM hashed",
    "kv_root": f"""WITH RECURSIVE {CHANGE_SQL}, {HASHED_SQL},
folded AS (
  SELECT 32 AS depth, CAST('0x' || substr(hex(p), 1, 8) AS BIGINT) AS prefix, 1 AS n, sha256({_blob(OWN.leaf)} || p || v) AS h FROM hashed
  UNION ALL
  SELECT depth - 1, prefix // 2, CAST(sum(n) AS INTEGER),
         CASE WHEN sum(n) = 1 THEN max(h) ELSE sha256({_blob(OWN.inner)} || unhex(coalesce(max(h) FILTER (prefix % 2 = 0), '{OWN.placeholder.hex()}')) || unhex(coalesce(max(h) FILTER (prefix % 2 = 1), '{OWN.placeholder.hex()}'))) END
  FROM folded WHERE depth > 0 GROUP BY depth, prefix // 2
)
SELECT h AS root FROM folded WHERE depth = 0""",
    "kv_proofs": f"WITH {CHANGE_SQL}, state AS ({_as_of('true')}) SELECT e.user_id, s.user_id IS NOT NULL AS present, true AS verified FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN state s USING (user_id)",
    "uniq_violations": "SELECT p_name, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(*) > 1",
    "autoinc_assign": """WITH n AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS i FROM nation)
SELECT CASE WHEN i <= 10 THEN i ELSE i + 40 END AS place, n_name AS nation FROM n UNION ALL SELECT 50, 'guest'""",
    "kv_pages": f"WITH {CHANGE_SQL}, {HASHED_SQL}, every AS (SELECT p FROM hashed UNION ALL SELECT {HEAD_PATH}) SELECT lower(hex(p)) AS path, CAST((row_number() OVER (ORDER BY p) - 1) // 37 AS INTEGER) AS page FROM every",
    "kv_history": HISTORY_SQL,
    "kv_feed": f"""WITH {CHANGE_SQL}, a AS ({_as_of('version <= 13')}), b AS ({_as_of('version <= 14')})
SELECT lower(hex({_hmac("encode('p' || 'u' || coalesce(a.user_id, b.user_id))")})) AS path, b.event_type, b.user_id IS NULL AS deleted
FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.event_type IS DISTINCT FROM b.event_type""",
    "kv_get": f"WITH {CHANGE_SQL}, a AS ({_as_of('version <= 13')}), b AS ({_as_of('true')}) SELECT i AS user_id, b.event_type, a.event_type AS before FROM range(1, 9) r(i) LEFT JOIN a ON a.user_id = i LEFT JOIN b ON b.user_id = i",
    "kv_reopened": f"WITH {CHANGE_SQL}, a AS ({_as_of('version <= 13')}), b AS ({_as_of('true')}) SELECT *, 'now' AS read, true AS others_refused FROM b UNION ALL SELECT *, 'before', true FROM a",
    "kv_proofs_as_of": f"WITH {CHANGE_SQL}, state AS ({_as_of('version <= 13')}) SELECT e.user_id, s.user_id IS NOT NULL AS present, true AS verified, false AS elsewhere FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN state s USING (user_id)",
    "kv_values": f"WITH {CHANGE_SQL} SELECT user_id, true AS holds_own, false AS holds_forged, false AS holds_absent, true AS codec FROM ({_as_of('true')})",
    "kv_prefix": f"WITH {CHANGE_SQL} SELECT * FROM ({_as_of('true')}) WHERE CAST(user_id AS VARCHAR) LIKE '1%'",
    "kv_restored": f"WITH {CHANGE_SQL}, {HASHED_SQL} SELECT lower(hex(p)) AS path, event_type, true AS same FROM hashed",
    "kv_pruned": f"WITH {CHANGE_SQL} SELECT *, 9 AS roots, true AS gone FROM ({_as_of('version <= 9')})",
    "kv_retained": f"WITH {CHANGE_SQL} SELECT range AS version, (SELECT CAST(count(*) AS INTEGER) FROM ({_as_of('version <= 10')})) AS keys FROM range(7, 11)",
    "kv_fork": "SELECT * FROM (VALUES ('region-1', 'moved', true, true), ('region-2', NULL, true, true), ('region-9', 'new', true, true)) AS x (key, value, same, moved_refused)",
    "kv_tampered": "SELECT * FROM (VALUES ('data', true, true), ('manifest', true, true), ('tree', true, true), ('run', true, true)) AS x (kind, flipped, removed)",
    "sql_verified_rows": "SELECT k AS n_nationkey, n_name, true AS verified, false AS elsewhere FROM (SELECT unnest([0, 3, 7, 24, 25, 99]) AS k) LEFT JOIN nation ON n_nationkey = k",
    "sql_literals": """SELECT * FROM (VALUES (-5, 'C0FFEE00', CAST(-12.75 AS DOUBLE), CAST(0.5 AS DOUBLE), TIMESTAMP '1999-12-31 23:59:59.125', 'it''s', CAST(4294967295 AS BIGINT)),
(6, NULL, 1000, NULL, NULL, '', 0)) AS x (k, b, d, f, t, s, u)""",
    "sql_information_schema": """SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS ordinal_position, CASE WHEN column_name IN ('c_custkey', 'o_orderkey', 'n_nationkey') THEN 'PRI' ELSE '' END AS column_key
FROM (SELECT 'customer' AS table_name, column_name, row_number() OVER () AS ordinal_position FROM (DESCRIBE customer)
UNION ALL SELECT 'orders', column_name, row_number() OVER () FROM (DESCRIBE orders) UNION ALL SELECT 'nation', column_name, row_number() OVER () FROM (DESCRIBE nation))""",
    "fn_key_bytes": f"SELECT o_orderkey, '{(b'sql/r/' + (7).to_bytes(8, 'big')).hex()}' || printf('%016x', CAST(o_orderkey AS UBIGINT) + 9223372036854775808) AS key FROM orders",
    "fn_row_bytes": f"""WITH r AS (SELECT c_custkey, '01' || printf('%016x', CAST(c_custkey AS UBIGINT) + 9223372036854775808) || '01' || printf('%02x', octet_length(encode(c_name))) || lower(hex(encode(c_name))) AS row FROM customer)
SELECT c_custkey, row, lower(hex({_hmac("encode('p') || unhex(row)")})) AS mac FROM r""",
    "show_tables": "SELECT unnest(['customer', 'nation', 'orders']) AS name",
} | {n: other for n, (_, _, other) in QUERIES_SQL.items()} | {n: s for n, (_, s) in CHANGES.items()}
ORACLE |= {n: f"SELECT *, {refused} AS refused, {version} AS version FROM ({sql})" for n, (_, _, _, sql, refused, version) in COMMITTED.items()}
ORACLE["kv_preview"] = f"SELECT root, CAST(0 AS BIGINT) AS version FROM ({ORACLE['kv_root']})"
ORACLE["kv_sealed"] = f"WITH {CHANGE_SQL} SELECT user_id, event_type, root FROM ({_as_of('true')}), ({ORACLE['kv_root']})"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (kv_latest, kv_as_of, kv_changes, kv_effective, kv_superseded, kv_page, kv_paths, kv_root, kv_proofs, kv_history, uniq_violations, autoinc_assign, show_tables, kv_pages, kv_feed, kv_get, kv_preview, kv_reopened, kv_proofs_as_of, kv_values, kv_prefix, kv_sealed, kv_restored, kv_pruned, kv_retained, kv_fork, kv_tampered, sql_verified_rows, sql_literals, sql_information_schema, fn_key_bytes, fn_row_bytes)
} | {n: _runs(n) for n in QUERIES_SQL} | {n: f for n, (f, _) in CHANGES.items()} | {n: _ran(statements, query, *names) for n, (statements, query, names, *_) in COMMITTED.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by customer over verified snapshots of committed tables."""
    return QUERIES["sql_join_agg"](spark, sf_dir)
