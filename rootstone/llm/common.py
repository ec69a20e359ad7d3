"""What the training-data operators share: the staging folder and byte-level text kernels."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where that is unset (local runs)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="rootstone-")
        shared_dir.own = found
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rootstone/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Deletes the files of a table made by staged(), once nothing reads it any more."""
    spark, jvm = df.sparkSession, df.sparkSession._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than one in HOT_ONE_IN of all rows is hot; so there are fewer than HOT_ONE_IN hot keys.
HOT_ONE_IN = 1000


def join_counted(rows: DataFrame, lookup: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """rows joined with lookup, which has one row per key, and in column n how many of the total rows have it. Rows of hot keys
    stay where they are and meet a broadcast of fewer than HOT_ONE_IN rows of lookup; the others are dealt out by key."""
    from pyspark.sql import functions as F

    hot = F.broadcast(lookup.where(F.col(n) * HOT_ONE_IN > F.lit(total)))
    cool = rows.join(hot.select(*keys), keys, "left_anti").join(lookup.where(F.col(n) * HOT_ONE_IN <= F.lit(total)), keys)
    return rows.join(hot, keys).unionByName(cool)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _byte_table() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_BYTES = _byte_table()
_BASE = 0xD6E8FEB86659FD93
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept between calls."""
    if len(_powers["up"]) < n:
        n = 1 << (n - 1).bit_length()
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space separated words of all texts, in order, and the number of words of each text.

    A word's hash is a polynomial over a random table of its bytes modulo 2^64, from differences of prefix sums.
    """
    counts = np.zeros(len(texts), np.int64)
    parts = []
    block, size, first = [], 0, 0
    for i, t in enumerate(texts):
        block.append(t)
        size += len(t) + 1
        if size > 1 << 20 or i + 1 == len(texts):
            h, c = _block_hashes(block)
            parts.append(h)
            counts[first : i + 1] = c
            block, size, first = [], 0, i + 1
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts


def _block_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, bounds))


def lowered(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and nothing else changed."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def groups(batches, keys: int):
    """Yields (key, pyarrow.Table) for each run of equal values in the first columns of a partition sorted by them."""
    import pyarrow as pa

    now, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        values = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        changes = np.zeros(len(batch) - 1, bool)
        for v in values:
            changes |= v[1:] != v[:-1]
        bounds = [0, *(np.flatnonzero(changes) + 1).tolist(), len(batch)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            key = tuple(v[a] for v in values)
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


class Sets:
    """Union-find over 0..n-1; a root is the least place of its set."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(self.root[others], self.root[i]))
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]

    def merge(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins each of i with its j."""
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(self.root, further := self.root[self.root]):
                self.root = further

    def spanning(self) -> tuple[np.ndarray, np.ndarray]:
        places = np.flatnonzero(self.root != np.arange(len(self.root)))
        return places, self.root[places]


def linked(n: int, alike) -> Sets:
    """Components of the graph in which i's links among the places `others` are alike(i, others).

    Leaders first: a place that no earlier leader took leads and looks at all others, so a group whose members all link with
    its leader costs one pass. Then every place outside the largest set looks at all places of other sets, so that no link
    between two sets is missed.
    """
    sets, taken = Sets(n), np.zeros(n, bool)
    for i in range(n):
        if not taken[i]:
            taken[i] = True
            others = np.flatnonzero(sets.root != sets.root[i])
            if len(others):
                found = others[alike(i, others)]
                taken[found] = True
                sets.join(i, found)
    largest = np.bincount(sets.root).argmax()
    for i in np.flatnonzero(sets.root != largest).tolist():
        others = np.flatnonzero(sets.root != sets.root[i])
        if len(others):
            found = others[alike(i, others)]
            if len(found):
                sets.join(i, found)
    return sets


def ascii_lower(text):
    """A-Z lower-cased, nothing else changed; lower() alone would also change other letters."""
    from pyspark.sql import functions as F

    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
