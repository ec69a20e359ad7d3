"""Hierarchical packing of token sequences for several context sizes.

A document's ids (and an end id) go to the longest tier that they fill; below the shortest tier, to that. Each tier cuts its
documents into whole windows; what is left of them is packed best-fit into further windows of the tier, whose gaps are
filled with what is left in shorter tiers, cut only where nothing fits. Windows that stay open at the end are cut into
powers of two, so no sequence needs padding. Sequences of one length join step groups: they are numbered over all partitions, by prefix sums
of the partitions' numbers, so each group but the last of its length holds STEP_TOKENS tokens.

Each partition packs its own documents as they stream by: no text is shuffled, and a task holds a bounded pool of remainders.

Semantics. Null texts are empty; an empty text has the end id alone. Each id lies in one piece; pieces of a sequence follow each
other from offset 0. Rows that repeat an id are packed each by itself. Other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged

TIERS = (1024, 512, 256, 128)
#: Remainders that are held back before they are packed, and the tokens of a step group.
POOL, STEP_TOKENS = 4096, 16_384
#: Of a sequence's number, the bits below the partition's.
PART_BITS = 40
#: Characters for which the two libraries' patterns surely agree; texts with others go to the slower one.
PLAIN = re.compile(r"[\t\n\r\x20-\x7E¡-¬®-ɏ‐-‧€]*")


class Encoder:
    """Ids as Tokenizer.from_file(path).encode(text, add_special_tokens=False) gives them.

    Where a rank file of the same vocabulary lies beside it, plain texts without special tokens are encoded by the faster
    library, which gives the same ids.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str | None) -> None:
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.fast and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None, pattern: str | None) -> Encoder:
    return Encoder(path, ranks, pattern)


class Packer:
    """Packs one partition. A piece is (document, start, ids); sequences are emitted as they are full."""

    def __init__(self, tiers: tuple[int, ...], partition: int) -> None:
        self.tiers, self.partition = tiers, partition
        self.pools: dict[int, list] = {t: [] for t in tiers}
        self.held, self.made = 0, 0
        self.places: dict[int, int] = {}  # sequences so far, by length
        self.rows: list[tuple] = []

    def add(self, doc: int, ids: np.ndarray) -> None:
        tier = next((t for t in self.tiers if len(ids) >= t), self.tiers[-1])
        whole = len(ids) - len(ids) % tier
        for at in range(0, whole, tier):
            self.emit([(doc, at, ids[at : at + tier])], tier)
        if whole < len(ids):
            self.pools[tier].append((doc, whole, ids[whole:]))
            self.held += 1
            if self.held >= POOL:
                self.pack(False)

    def emit(self, pieces: list, size: int) -> None:
        place = self.places.get(size, 0)
        self.places[size] = place + 1
        name = (self.partition << PART_BITS) + self.made
        self.made += 1
        offset = 0
        for doc, start, ids in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), name, offset, size, place))
            offset += len(ids)

    def pack(self, end: bool) -> None:
        pools = {t: sorted(((len(p[2]), i, p) for i, p in enumerate(v)), key=lambda x: x[:2]) for t, v in self.pools.items()}
        self.pools = {t: [] for t in self.tiers}
        self.held = 0
        n = POOL
        for k, tier in enumerate(self.tiers):
            windows: list[list] = []
            gaps: list[tuple[int, int]] = []  # (gap, window), sorted
            for size, _, piece in reversed(pools[tier]):
                at = bisect_left(gaps, (size, -1))
                if at < len(gaps):
                    gap, w = gaps.pop(at)
                else:
                    gap, w = tier, len(windows)
                    windows.append([])
                windows[w].append(piece)
                if gap > size:
                    insort(gaps, (gap - size, w))
            open_ones = set()
            for gap, w in gaps:
                for shorter in self.tiers[k + 1 :]:
                    pool = pools[shorter]
                    while gap and pool:
                        at = bisect_left(pool, (gap + 1, -1)) - 1
                        if at < 0:
                            break
                        size, _, piece = pool.pop(at)
                        windows[w].append(piece)
                        gap -= size
                pool = next((pools[s] for s in self.tiers[k + 1 :] if pools[s]), None) if gap else None
                if pool:  # all that is left is longer than the gap
                    size, _, (doc, start, ids) = pool.pop()
                    windows[w].append((doc, start, ids[:gap]))
                    n += 1
                    insort(pool, (size - gap, n, (doc, start + gap, ids[gap:])))
                    gap = 0
                if gap:
                    open_ones.add(w)
            self.join([p for w in sorted(open_ones) for p in windows[w]], tier, end)
            for w, pieces in enumerate(windows):
                if w not in open_ones:
                    self.emit(pieces, tier)

    def join(self, pieces: list, tier: int, end: bool) -> None:
        """Windows that nothing shorter can fill: their pieces follow each other, cut at window ends."""
        left = sum(len(p[2]) for p in pieces)
        size, room, window = 0, 0, []
        for doc, start, ids in pieces:
            while len(ids):
                if not room:
                    if not end and left < tier:  # waits for further documents
                        self.pools[tier].append((doc, start, ids))
                        self.held += 1
                        left -= len(ids)
                        break
                    size = room = tier if left >= tier else 1 << (left.bit_length() - 1)
                cut = min(room, len(ids))
                window.append((doc, start, ids[:cut]))
                doc, start, ids = doc, start + cut, ids[cut:]
                room, left = room - cut, left - cut
                if not room:
                    self.emit(window, size)
                    window = []


def _pack(tokens: tuple, end_id: int, tiers: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(*tokens).ids
        packer = Packer(tiers, TaskContext.get().partitionId())
        names: dict[int, tuple] = {}  # documents whose remainders wait
        n, kind = 0, None

        def out() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            docs = columns[0]
            arrays = [pa.array([names[d][0] for d in docs], kind)]
            arrays += [pa.array(columns[i], pa.int64()) for i in (1, 2, 3)]
            arrays.append(pa.array([names[d][1] for d in docs], pa.int64()))
            arrays += [pa.array(columns[i], pa.int64()) for i in (4, 5, 6, 7)]
            waiting = {p[0] for pool in packer.pools.values() for p in pool}
            for d in [d for d in names if d not in waiting]:
                del names[d]
            return pa.RecordBatch.from_arrays(arrays, ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "place"])

        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                for name, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    ids = np.append(ids_of(text), np.uint32(end_id)).astype("<u4")
                    names[n] = (name, len(ids))
                    packer.add(n, ids)
                    n += 1
                if len(packer.rows) > 2000:
                    yield out()
        packer.pack(True)
        if packer.rows:
            yield out()

    return run


def pack(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tiers: tuple[int, ...] = TIERS,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length and step (of the group; unique with
    sequence_length).

    tokenizer: path of a vocabulary for the tokenizers library; ranks, pattern: the same vocabulary for the faster library.
    tiers: powers of two, falling.
    """
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "place")]
    )
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    pieces = staged(rows.mapInArrow(_pack((tokenizer, ranks, pattern), end_id, tiers), schema), "packing-pieces")
    part = F.shiftright("sequence_id", PART_BITS).alias("part")
    made = pieces.groupBy("sequence_length", part).agg((F.max("place") + 1).alias("n"))  # a few rows a task
    before = Window.partitionBy("sequence_length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = made.select("sequence_length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = pieces.withColumn("part", part).join(F.broadcast(firsts), ["sequence_length", "part"])
    step = F.floor((F.col("first") + F.col("place")) * F.least(F.col("sequence_length"), F.lit(STEP_TOKENS)) / STEP_TOKENS)
    return numbered.select(F.col("id").alias(id_col), *schema.names[1:-1], step.alias("step"))
