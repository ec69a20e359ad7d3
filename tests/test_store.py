"""The store through Spark."""

import glob
import os

import pytest
from pyspark.errors import PySparkException
from test_merkle import KEY, PROOFS, ROOTS, STEPS, stated_scheme

from rootstone.errors import BackendError, ConflictError, CorruptedError, InvalidError, LedgerError, MissingError
from rootstone.functions.commitments import OWN
from rootstone.functions.local import LOCAL
from rootstone.functions.merkle import Proof, verify
from rootstone.operators import store
from rootstone.operators.store import KV, Op, Store, delete, put
from rootstone.plans.session import Database
from rootstone.streaming.feeds import change_stream, changes_between, sink

SEAL = bytes(range(0xA0, 0xC0))


@pytest.fixture
def spread(monkeypatch):
    """Jobs run however few the rows are."""
    monkeypatch.setitem(LOCAL, "bytes", -1)


def create(spark, tmp_path, name="s", **more):
    return Store.create(spark, str(tmp_path / name), KEY, **({"depth": 2} | more))


def contents(store, version=None):
    return {bytes(r.key): bytes(r.value) for r in store.snapshot(version=version).collect()}


@pytest.mark.parametrize("more", [{}, {"storage_key": SEAL, "depth": 5}])
def test_vectors(spark, tmp_path, more):
    scheme = stated_scheme()
    s = create(spark, tmp_path, scheme=scheme, **more)
    assert (s.root, s.version) == (scheme.placeholder, 0) and s.get(b"alice") is None
    for i, (step, root) in enumerate(zip(STEPS, ROOTS, strict=True), 1):
        got, version = s.put_batch([Op(k, v) for k, v in step])
        assert (got.hex(), version) == (root, i)
    assert s.get(b"alice") == b"1001" and s.get(b"bob") is None and s.get(b"dave") == b"" and s.get(b"bob", 1) == b"250"
    for key, proof in PROOFS.items():
        assert s.prove(key).encode().hex() == proof
    proof = s.prove(b"alice")
    assert s.verify_value(s.root, b"alice", b"1001", proof) and not s.verify_value(s.root, b"alice", b"forged", proof)
    assert s.verify_absent(s.root, b"absent-key", s.prove(b"absent-key")) and not s.verify_absent(s.root, b"alice", proof)
    with pytest.raises(InvalidError):
        s.verify_value(s.root_at(4), b"alice", b"1001", proof)
    many = {bytes(r.key): (r.present, Proof.decode(bytes(r.proof))) for r in s.prove_all(spark.createDataFrame([(bytearray(k),) for k in (b"alice", b"absent-key", b"nobody", b"eve")], "key binary")).collect()}
    assert {k: v[0] for k, v in many.items()} == {b"alice": True, b"absent-key": False, b"nobody": False, b"eve": True}
    assert all(p == s.prove(k) for k, (_, p) in many.items())
    assert len(contents(s)) == 54 and contents(s, 1) == {b"alice": b"1000", b"bob": b"250"}
    if more:
        files = [f for f in glob.glob(str(tmp_path / "s/data/0/*/*.parquet"))]
        assert files and not any(b"value-0" in open(f, "rb").read() for f in files)
        with pytest.raises(InvalidError):
            Store.open_latest(spark, s.path, KEY, scheme=scheme)
    with pytest.raises(CorruptedError):
        Store.open_latest(spark, s.path, KEY, more.get("storage_key"))  # under another scheme


def test_batches(spark, tmp_path):
    s = create(spark, tmp_path)
    s.put_batch([put(b"k", b"a"), put(b"k", b"b")])
    assert (s.version, s.get(b"k")) == (1, b"b")
    root = s.root
    assert s.put_batch([put(b"k", b"b"), delete(b"absent")]) == (root, 1)
    assert s.preview_batch([put(b"x", b"1")]) == s.put_batch([put(b"x", b"1")])[0]
    s.put_batch([delete(b"k"), delete(b"x")])
    assert s.root == OWN.placeholder
    rows = spark.createDataFrame([(bytearray(b"a"), bytearray(b"1"), 1, "put"), (bytearray(b"a"), None, 3, "delete"), (bytearray(b"a"), bytearray(b"2"), 2, "put"), (bytearray(b"b"), bytearray(b""), 1, "put")], "key binary, value binary, seq long, op string")
    s.put_batch(rows)
    assert contents(s) == {b"b": b""}
    with pytest.raises(InvalidError):
        s.put_batch([put(OWN.history_key, b"x")])
    with pytest.raises(InvalidError):
        s.root_at(99)


BATCHES = [
    [put(b"k%02d" % i, b"v%d" % i) for i in range(30)],
    [put(b"k01", b"new"), put(b"k02", b"v2"), delete(b"k03"), delete(b"absent")],
    [put(b"k01", b"new"), delete(b"k03")],  # changes nothing, so it makes no version
    [put(b"k03", b"v3"), delete(b"k01"), put(b"x", b"")],
    [put(b"k01", b"new"), delete(b"x"), delete(b"k29")],
]


@pytest.mark.parametrize("more", [{"history": True}, {"history": True, "depth": 5}, {"storage_key": SEAL, "depth": 0}])
def test_batches_at_once_are_those_one_by_one(spark, tmp_path, monkeypatch, spread, more):
    monkeypatch.setattr(store, "RUNS", 3)
    one, all_at_once = create(spark, tmp_path, **more), create(spark, tmp_path, "t", **more)
    for s in (one, all_at_once):
        s.put_batch([put(b"k00", b"before"), put(b"only", b"here")])
    rows = [(n, o.key, o.value, 0, "put" if o.value is not None else "delete") for n, batch in enumerate(BATCHES) for o in batch]
    for batch in BATCHES:
        one.put_batch(batch)
    jobs = []
    monkeypatch.setattr(Store, "put_batch", lambda self, ops: jobs.append(1))
    ops = spark.createDataFrame([(0, b"k07", b"earlier", -1, "put"), *rows], "batch int, key binary, value binary, seq int, op string")
    assert all_at_once.put_batches(ops) == (one.root, one.version) and one.version == 5 and not jobs
    assert all_at_once.put_batches(ops.where("batch = 4")) == (one.root, 5)
    t = Store.open_latest(spark, all_at_once.path, KEY, more.get("storage_key"))
    for v in range(6):
        a, b = one._at(v), t._at(v)
        assert (a.root, a.head, a.before, a.system) == (b.root, b.head, b.before, b.system)
        assert not (b.buckets() & ~a.buckets()).any()  # one by one, those of changes without effect are marked, too
        assert contents(one, v) == contents(t, v)
        assert sum(f.rows for f in a.files.get("0", [])) == sum(f.rows for f in b.files.get("0", []))
    assert t.log.runs_there() == one.log.runs_there()
    if t.history:
        t.verify_history()
    with pytest.raises(LedgerError):
        t.put_batches(spark.createDataFrame([(0, OWN.history_key, b"v", 0, "put")], ops.schema))


def test_files_do_not_grow_with_the_table(spark, tmp_path, monkeypatch, spread):
    monkeypatch.setattr(store, "SLOT_MOST", 2000)
    s = create(spark, tmp_path)
    s.put_batch(spark.range(2000).selectExpr("cast(cast(id as string) as binary) as key", "cast(repeat('x', 50) as binary) as value", "0 as seq", "'put' as op"))
    files = s.manifest.files["0"]
    assert sum(f.rows for f in files) == 2000 and max(f.rows for f in files) < 500
    assert store.FILE_ROWS <= 1 << 17 and s.spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(store.BATCH_BYTES)


def test_root_is_content(spark, tmp_path):
    pairs = [(b"k%d" % i, b"v%d" % i) for i in range(30)]
    a, b = create(spark, tmp_path, "a"), create(spark, tmp_path, "b", depth=6)
    a.put_batch([put(*p) for p in pairs])
    b.put_batch([put(b"detour", b"x"), *[put(*p) for p in pairs[::-1][:10]]])
    b.put_batch([delete(b"detour"), put(b"k1", b"other"), *[put(*p) for p in pairs[:25]]])
    b.put_batch([put(*p) for p in pairs])
    assert a.root == b.root
    c = create(spark, tmp_path, "c", depth=0)
    c.put_batch([put(*p) for p in pairs])
    assert a.root == c.root


def test_opening(spark, tmp_path):
    s = create(spark, tmp_path, history=True)
    s.put_batch([put(b"a", b"1")])
    again = Store.open_or_create(spark, s.path, KEY, history=True)
    assert (again.root, again.version, again.head) == (s.root, 1, s.head)
    assert Store.open_at(spark, s.path, KEY, s.root, 1).get(b"a") == b"1"
    for bad in (lambda: Store.open_at(spark, s.path, KEY, bytes(32), 1), lambda: Store.open_latest(spark, s.path, bytes(32)), lambda: Store.open_latest(spark, s.path, KEY, history=False), lambda: create(spark, tmp_path)):
        with pytest.raises(LedgerError):
            bad()
    with pytest.raises(MissingError):
        Store.open_latest(spark, str(tmp_path / "none"), KEY)
    s.put_batch([put(b"b", b"2")])
    with pytest.raises(ConflictError):
        again.put_batch([put(b"c", b"3")])
    again.refresh()
    assert again.get(b"b") == b"2"


def test_every_flipped_bit_is_an_error_or_harmless(spark, tmp_path):
    s = create(spark, tmp_path, depth=1)
    pairs = {b"key%d" % i: b"value%d" % i for i in range(6)}
    s.put_batch([put(k, v) for k, v in pairs.items()])
    files = [f for f in glob.glob(str(tmp_path / "s/**/*"), recursive=True) if os.path.isfile(f) and not f.endswith((".crc", ".lock", "_SUCCESS"))]
    assert len(files) >= 4
    wrong = 0
    for name in files:
        raw = open(name, "rb").read()
        crc = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")
        if os.path.exists(crc):
            os.rename(crc, crc + ".aside")  # else the file system notices first
        for at in range(7, len(raw), max(1, len(raw) // 6)):
            open(name, "wb").write(raw[:at] + bytes([raw[at] ^ 4]) + raw[at + 1 :])
            try:
                now = contents(Store.open_at(spark, s.path, KEY, s.root, 1))
                assert now == pairs
            except (LedgerError, BackendError, PySparkException):
                wrong += 1
        open(name, "wb").write(raw)
        if os.path.exists(crc + ".aside"):
            os.rename(crc + ".aside", crc)
    assert wrong >= 10
    assert contents(Store.open_at(spark, s.path, KEY, s.root, 1)) == pairs


def uncheck(path):
    """Without the file system's own check sums."""
    aside = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.crc")
    os.path.exists(aside) and os.remove(aside)


def test_every_read_notices_what_storage_did_since(spark, tmp_path, spread):
    s = create(spark, tmp_path)
    s.put_batch([put(b"key%d" % i, b"value") for i in range(20)])
    assert len(contents(s)) == 20  # a full read, after which storage changes
    files = [f"{s.path}/{f.name}" for f in s.manifest.files["0"]]
    raw = [open(f, "rb").read() for f in files]
    later = lambda: s.snapshot().count(), lambda: contents(s), lambda: s.get(b"key1"), lambda: s.prove(b"key1"), lambda: s.put_batch([put(b"key%d" % i, b"w") for i in range(9)])
    for forge in (lambda b: b.replace(b"value", b"forged"[:5]), lambda b: b[:-1] + b"?", None):
        for f, b in zip(files, raw, strict=True):
            open(f, "wb").write(forge(b)) if forge else os.remove(f)
            uncheck(f)
        for read in later:
            with pytest.raises((LedgerError, PySparkException)):
                read()
        for f, b in zip(files, raw, strict=True):
            open(f, "wb").write(b)
    assert len(contents(s)) == 20 and s.version == 1


def test_buckets_that_were_derived_are_carried_forward(spark, tmp_path, monkeypatch, spread):
    s, folded = create(spark, tmp_path, depth=6), []
    s.put_batch([put(b"key%d" % i, b"value") for i in range(200)])
    original = Store.leaves
    monkeypatch.setattr(Store, "leaves", lambda self, m, keep=None, anew=None: (folded.append(64 if keep is None else int(keep.sum())), original(self, m, keep, anew))[1])
    s.snapshot()
    s.put_batch([put(b"key7", b"other")])
    s.put_batch([delete(b"key9")])
    s.snapshot()
    s.snapshot()
    assert folded == [64, 1, 1, 2]  # a whole state; two commits; the two buckets that they touched


def test_lost_versions_are_noticed(spark, tmp_path):
    s = create(spark, tmp_path)
    for i in range(9):
        s.put_batch([put(b"k%d" % i, b"v")])
    assert s.log.runs_there() == [(0, 8)]
    for name in ("_runs", "_log"):
        os.rename(f"{s.path}/{name}", f"{s.path}/{name}.aside")
        os.mkdir(f"{s.path}/{name}")
        if name == "_log":
            for f in os.listdir(f"{s.path}/_log.aside"):
                if not f.startswith(f"{3:020d}"):
                    os.rename(f"{s.path}/_log.aside/{f}", f"{s.path}/_log/{f}")
    with pytest.raises(LedgerError):
        contents(Store.open_latest(spark, s.path, KEY))


def test_history_prune_and_pin(spark, tmp_path):
    s = create(spark, tmp_path)
    for v in (b"one", b"two", b"three", b"four"):
        s.put_batch([put(b"k", v), put(b"n" + v, v)])
    assert [s.get(b"k", v) for v in range(5)] == [None, b"one", b"two", b"three", b"four"]
    assert s.superseded(3).count() == 2
    s.pin_version(2)
    s.prune(4)
    assert s.get(b"k", 2) == b"two"
    with pytest.raises(MissingError):
        s.get(b"k", 1)
    s.pin_version(None)
    assert s.prune(3) == {"rows": 1, "roots": 1} and s.prune(3) == {"rows": 0, "roots": 0}
    with pytest.raises(InvalidError):
        s.prune(9)
    assert s.get(b"k", 3) == b"three" and s.get(b"none") == b"one"
    s.retain_recent(0)
    again = Store.open_latest(spark, s.path, KEY)
    assert contents(again) == {b"k": b"four", b"none": b"one", b"ntwo": b"two", b"nthree": b"three", b"nfour": b"four"}
    again.put_batch([put(b"k", b"five")])
    assert again.get(b"k") == b"five"


def test_export_and_restore(spark, tmp_path):
    s = create(spark, tmp_path, history=True)
    s.put_batch([put(b"k%02d" % i, b"v%d" % i) for i in range(40)])
    s.put_batch([delete(b"k00"), put(b"k01", b"new")])
    pages, after, done = [], b"", False
    while not done:
        page, done = s.snapshot_leaves(after, 7)
        rows = [(bytes(r.path), bytes(r.value)) for r in page.collect()]
        assert rows == sorted(rows) and len(rows) <= 7
        pages += rows
        after = rows[-1][0]
    assert len(pages) == 40  # 39 keys and the chain's own leaf
    t = Store.create(spark, str(tmp_path / "t"), KEY, storage_key=SEAL, history=True, depth=4)
    t.restore_leaves(pages)
    t.stamp_version(s.version)
    assert (t.root, t.version, t.head) == (s.root, s.version, s.head)
    assert t.get(b"k01") == b"new"
    assert t.put_batch([put(b"x", b"1")])[0] == s.put_batch([put(b"x", b"1")])[0]
    assert t.head == s.head
    t.verify_history(2, s.head_at(2))
    with pytest.raises(InvalidError):
        t.restore_leaves([(b"short", b"v")])
    path = t.hasher.path(b"twice")
    pairs = [(bytearray(path), bytearray(b"old"), 1), (bytearray(path), bytearray(b"new"), 2)]
    with pytest.raises(InvalidError):
        t.restore_leaves(spark.createDataFrame([p[:2] for p in pairs], "path binary, value binary"))
    t.restore_leaves(spark.createDataFrame(pairs * 3, "path binary, value binary, seq int"))
    assert t.get(b"twice") == b"new"
    t.restore_leaves([(path, b"x"), (path, b"last")])
    assert t.get(b"twice") == b"last"
    assert [bytes(r.key) for r in s.scan(b"k05", b"k08").collect()] == [b"k05", b"k06", b"k07"] and s.scan_prefix(b"k1").count() == 10


@pytest.mark.parametrize("history", [False, True])
def test_all_pages_at_once_are_those_from_cursor_to_cursor(spark, tmp_path, monkeypatch, spread, history):
    monkeypatch.setattr(store, "RANGE_ROWS", 5)
    s = create(spark, tmp_path, history=history)
    s.put_batch([put(b"k%02d" % i, b"v%d" % i) for i in range(40)])
    s.put_batch([delete(b"k00"), put(b"k01", b"new")])
    for version in (1, 2):
        pages, after, done = [], b"", False
        while not done:
            page, done = s.snapshot_leaves(after, 7, version)
            rows = [(len(set(n for n, *_ in pages)), bytes(r.path), bytes(r.value)) for r in page.collect()]
            pages += rows
            after = rows[-1][1]
        assert sorted((r.page, bytes(r.path), bytes(r.value)) for r in s.snapshot_pages(7, version).collect()) == pages
    assert create(spark, tmp_path, "none").snapshot_pages(7).count() == 0


def test_fork(spark, tmp_path):
    s = create(spark, tmp_path)
    s.put_batch([put(b"balance", b"100")])
    f = s.fork()
    f.put(b"balance", b"90")
    f.put(b"fee", b"10")
    f.delete(b"absent")
    assert (f.get(b"balance"), s.get(b"balance"), f.get(b"absent")) == (b"90", b"100", None)
    sealed = f.seal()
    assert [o.key for o in sealed.ops] == [b"absent", b"balance", b"fee"] and sealed.root_before == s.root and not sealed.is_noop
    assert s.put_batch(sealed.ops)[0] == sealed.root_after
    with pytest.raises(ConflictError):
        f.seal()
    assert s.fork().seal().is_noop


def test_chain(spark, tmp_path):
    s = create(spark, tmp_path, history=True)
    roots, heads = [s.root], [s.head]
    assert heads == [bytes(32)]
    for i in range(1, 5):
        s.put_batch([put(b"k", b"%d" % i)])
        assert s.head == OWN.chain_link(heads[-1], roots[-1], i)
        roots.append(s.root)
        heads.append(s.head)
    s.put_batch([put(b"k", b"4")])
    assert s.version == 4 and s.head_at(2) == heads[2] and s.get(OWN.history_key) == heads[4]
    for v in (0, 2, 4):
        s.verify_history(v, heads[v])
    with pytest.raises(CorruptedError):
        s.verify_history(2, heads[1])
    s.put_batch([put(b"k", b"5")])
    s.stamp_version(9)
    name = f"{s.path}/_log/{2:020d}.json"
    raw = open(name, "rb").read()
    open(name, "wb").write(raw.replace(roots[2].hex().encode(), b"11" * 32))
    uncheck(name)
    with pytest.raises(CorruptedError):
        s.verify_history()
    open(name, "wb").write(raw)
    s = Store.open_at(spark, s.path, KEY, roots[4], 4)
    again = s
    again.prune(3)
    with pytest.raises(MissingError):
        again.verify_history()
    again.verify_history(3, heads[3])
    with pytest.raises(InvalidError):
        _ = create(spark, tmp_path, "off").head


def test_changes(spark, tmp_path):
    s = create(spark, tmp_path, history=True)
    s.put_batch([put(b"keep", b"1"), put(b"change", b"1"), put(b"drop", b"1")])
    s.put_batch([put(b"keep", b"1"), put(b"change", b"2"), put(b"add", b"3"), delete(b"drop")])
    got = [(bytes(r.path), None if r.value is None else bytes(r.value), r.deleted) for r in s.changes_at(2).collect()]
    path = s.hasher.path
    assert got == sorted([(path(b"change"), b"2", False), (path(b"add"), b"3", False), (path(b"drop"), None, True)])
    assert changes_between(s, 0).count() == 6 and changes_between(s, 1).count() == 3
    with pytest.raises(InvalidError):
        s.changes_at(0)


def test_bases_keep_states(spark, tmp_path):
    s = create(spark, tmp_path)
    for i in range(4):
        s.put_batch([put(b"k%d" % i, b"%d" % i), put(b"k", b"%d" % i)])
        if i == 1:
            s.write_base()
    assert contents(s) == {b"k": b"3", b"k0": b"0", b"k1": b"1", b"k2": b"2", b"k3": b"3"}
    for i in range(4, 12):
        s.put_batch([put(b"k%d" % i, b"%d" % i), put(b"k", b"%d" % i), delete(b"k%d" % (i - 4))])
    assert contents(s) == {b"k": b"11"} | {b"k%d" % i: b"%d" % i for i in range(8, 12)}
    assert len(s.log.runs(12)) <= 8 and len(contents(s, 11)) == 5
    assert contents(s, 1) == {b"k": b"0", b"k0": b"0"} and contents(s, 2) == {b"k": b"1", b"k0": b"0", b"k1": b"1"}


def test_streams(spark, tmp_path):
    s = create(spark, tmp_path, history=True)
    source = str(tmp_path / "in")
    schema = "key binary, value binary, seq long, op string"
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    write([(bytearray(b"a"), bytearray(b"1"), 1, "put")])
    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(sink(s, "q")).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    write([(bytearray(b"a"), None, 2, "delete"), (bytearray(b"b"), bytearray(b"2"), 3, "put")])
    query.processAllAvailable()
    query.stop()
    assert s.version == 2 and contents(s) == {b"b": b"2"}
    sink(s, "q")(spark.createDataFrame([(bytearray(b"z"), bytearray(b"9"), 1, "put")], schema), 1)
    assert s.version == 2
    for n in range(3):
        sink(s, "other")(spark.createDataFrame([(bytearray(b"other"), bytearray(b"%d" % n), 1, "put")], schema), n)
    sink(s, "q")(spark.createDataFrame([(bytearray(b"z"), bytearray(b"9"), 1, "put")], schema), 0)
    assert s.manifest.streams == {"q": 1, "other": 2} and s.get(b"z") is None
    out = change_stream(s).writeStream.format("memory").queryName("feed").start()
    out.processAllAvailable()
    out.stop()
    assert sorted((bytes(r.key), r.version, r.deleted) for r in s.spark.table("feed").collect()) == [(b"a", 1, False), (b"a", 2, True), (b"b", 2, False), *[(b"other", v, False) for v in (3, 4, 5)]]


def test_schema_of_plain_keys():
    assert KV.names == ["key", "value"] and verify.__doc__


def test_many_buckets_and_abandoned_names(spark, tmp_path, monkeypatch):
    from rootstone.sources import files

    s = create(spark, tmp_path, depth=12)
    s.put_batch([put(b"k%d" % i, b"v") for i in range(300)])
    keys = [b"k%d" % i for i in range(0, 300, 7)] + [b"none%d" % i for i in range(40)]
    found = s.prove_all(spark.createDataFrame([(bytearray(k),) for k in keys], "key binary"))
    checked = s.check_proofs(found, s.root).collect()
    assert len(checked) == len(keys) and all(r.holds for r in checked) and {bytes(r.key) for r in checked if r.present} == set(keys[:43])
    assert not any(r.holds for r in s.check_proofs(found, bytes(32)).collect())
    lock = tmp_path / "s/_log" / f"{2:020d}.buckets.lock"
    lock.touch()
    with pytest.raises(ConflictError):
        s.put_batch([put(b"x", b"1")])
    monkeypatch.setattr(files, "ABANDONED_S", -1)
    assert s.put_batch([put(b"x", b"1")])[1] == 2
