"""The tree as a pure function of its leaves: folds of sorted leaves, of buckets, and proofs that need no store.

R(S, d) is the placeholder for no leaf, the leaf's hash for one, else the inner hash of the halves by bit d. A bucket is
what lies under the first `depth` bits; its leaf count, capped at 2, travels with its hash, as a single leaf's hash rises unchanged.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_left
from collections.abc import Iterator
from functools import cached_property
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from rootstone.errors import InvalidError

from .commitments import OWN, Scheme, listed

BITS = 256


class Folded(NamedTuple):
    count: int
    hash: bytes


def empty(scheme: Scheme = OWN) -> Folded:
    return Folded(0, scheme.placeholder)


def join(left: Folded, right: Folded, scheme: Scheme = OWN) -> Folded:
    if left.count + right.count < 2:
        return left if left.count else right
    return Folded(2, scheme.inner_hash(left.hash, right.hash))


def _common_bits(paths: list[bytes]) -> list[int]:
    """How many leading bits each path shares with the next."""
    heads = np.frombuffer(b"".join([p[:8] for p in paths]), ">u8").astype(np.uint64)
    differ = heads[:-1] ^ heads[1:]
    high, low = (differ >> np.uint64(32)).astype(np.float64), (differ & np.uint64(0xFFFFFFFF)).astype(np.float64)
    bits = np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1]).tolist()
    for i in np.flatnonzero(differ == 0).tolist():
        bits[i] = BITS - (int.from_bytes(paths[i], "big") ^ int.from_bytes(paths[i + 1], "big")).bit_length()
    return bits


def fold_sorted(leaves: list[tuple[bytes, bytes]], depth: int, scheme: Scheme = OWN) -> Folded:
    """Leaves of different paths, sorted by these, in one pass: a subtree is closed when the next leaf shares fewer bits than it spans."""
    if not leaves:
        return empty(scheme)
    hashed, leaf, inner, nothing = hashlib.sha256, scheme.leaf, scheme.inner, scheme.placeholder
    now = hashed(leaf + leaves[0][0] + leaves[0][1]).digest()
    if len(leaves) == 1:
        return Folded(1, now)
    paths = [p for p, _ in leaves]

    def risen(found: bytes, at: int, to: int, path: bytes) -> bytes:
        """A subtree that splits at a bit, as it is at a bit above: alone on its way."""
        for d in range(at - 1, to - 1, -1):
            found = hashed(inner + nothing + found if path[d >> 3] >> (7 - (d & 7)) & 1 else inner + found + nothing).digest()
        return found

    # of subtrees whose right neighbour is open: hash, the bit at which it splits (0: a leaf, which rises unchanged), a path, and the bits shared with the next
    open_: list[tuple[bytes, int, bytes, int]] = []
    split = 0
    for i, shared in enumerate([*_common_bits(paths), depth - 1]):
        path = paths[i]
        while open_ and open_[-1][3] > shared:
            left, own, its, bit = open_.pop()
            if own > bit + 1:
                left = risen(left, own, bit + 1, its)
            if split > bit + 1:
                now = risen(now, split, bit + 1, path)
            now, split = hashed(inner + left + now).digest(), bit
        if i + 1 < len(paths):
            open_.append((now, split, path, shared))
            now, split = hashed(leaf + paths[i + 1] + leaves[i + 1][1]).digest(), 0
    return Folded(2, risen(now, split, depth, paths[0]) if split > depth else now)


class Leaves:
    """Leaves sorted by path."""

    def __init__(self, leaves: list[tuple[bytes, bytes]], scheme: Scheme = OWN) -> None:
        self.leaves, self.scheme = sorted(leaves), scheme
        self._known: dict[tuple[int, int, int], bytes] = {}
        if any(a[0] == b[0] for a, b in pairwise(self.leaves)):
            raise InvalidError("a path occurs twice")

    @cached_property
    def paths(self) -> list[int]:
        return [int.from_bytes(p, "big") for p, _ in self.leaves]

    def split(self, low: int, high: int, depth: int) -> int:
        shift = BITS - 1 - depth
        return bisect_left(self.paths, (self.paths[low] >> shift | 1) << shift, low, high)

    def fold(self, depth: int, low: int = 0, high: int | None = None) -> Folded:
        return fold_sorted(self.leaves[low:high], depth, self.scheme)

    def hash(self, depth: int, low: int, high: int) -> bytes:
        """The hash of a subtree, kept for the next proof."""
        found = self._known.get((depth, low, high))
        if found is None:
            if high - low < 2:
                found = self.fold(depth, low, high).hash
            else:
                middle = self.split(low, high, depth)
                found = self.scheme.inner_hash(self.hash(depth + 1, low, middle), self.hash(depth + 1, middle, high))
            self._known[depth, low, high] = found
        return found

    def descend(self, path: int, depth: int) -> tuple[tuple[bytes, bytes] | None, list[bytes]]:
        """The leaf at the end of a path's way from this depth on, if any, and the siblings on it, top-down."""
        low, high, siblings = 0, len(self.paths), []
        while high - low > 1:
            middle = self.split(low, high, depth)
            if path >> (BITS - 1 - depth) & 1:
                siblings.append(self.hash(depth + 1, low, middle))
                low = middle
            else:
                siblings.append(self.hash(depth + 1, middle, high))
                high = middle
            depth += 1
        return (self.leaves[low] if high > low else None), siblings


class Top:
    """The tree above the buckets. levels[d] has the 2^d nodes of depth d."""

    def __init__(self, buckets: list[Folded], scheme: Scheme = OWN) -> None:
        self.depth = len(buckets).bit_length() - 1
        levels = [buckets]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([join(below[i], below[i + 1], scheme) for i in range(0, len(below), 2)])
        self.levels = levels[::-1]

    @property
    def root(self) -> bytes:
        return self.levels[0][0].hash

    def way(self, bucket: int) -> tuple[int | None, bool, list[bytes]]:
        """The bucket that holds the way's last leaf (None: no leaf), whether the way ends above it, and siblings top-down."""
        found: list[bytes] = []
        for depth in range(self.depth):
            span = 1 << (self.depth - depth)
            first = bucket // span * span
            if self.levels[depth][bucket // span].count <= 1:
                return next((b for b in range(first, first + span) if self.levels[-1][b].count), None), True, found
            found.append(self.levels[depth + 1][(bucket // (span // 2)) ^ 1].hash)
        return bucket, False, found

    def encode(self) -> bytes:
        return b"".join(bytes([f.count]) + f.hash for f in self.levels[-1])

    @classmethod
    def decode(cls, data: bytes, scheme: Scheme = OWN) -> Top:
        if not data or len(data) % 33 or (len(data) // 33) & (len(data) // 33 - 1):
            raise InvalidError("malformed bucket hashes")
        return cls([Folded(data[i], data[i + 1 : i + 33]) for i in range(0, len(data), 33)], scheme)


class Proof(NamedTuple):
    """The leaf at the end of the way, if any, and sibling hashes, deepest first."""

    leaf: tuple[bytes, bytes] | None
    siblings: list[bytes]

    def encode(self) -> bytes:
        head = b"\1" + b"".join(self.leaf) if self.leaf else b"\0"
        return head + struct.pack("<H", len(self.siblings)) + b"".join(self.siblings)

    @classmethod
    def decode(cls, data: bytes) -> Proof:
        if not data or data[0] > 1:
            raise InvalidError("malformed proof")
        at = 65 if data[0] else 1
        if len(data) < at + 2:
            raise InvalidError("malformed proof")
        (n,) = struct.unpack_from("<H", data, at)
        if n > BITS or len(data) != at + 2 + 32 * n:
            raise InvalidError("malformed proof")
        body = data[at + 2 :]
        return cls((data[1:33], data[33:65]) if data[0] else None, [body[i : i + 32] for i in range(0, len(body), 32)])


def verify(root: bytes, path: bytes, proof: Proof, scheme: Scheme = OWN) -> bytes | None:
    """The value hash that the proof establishes for the path, or None for absence. Fails if it establishes nothing."""
    n, bits = len(proof.siblings), int.from_bytes(path, "big")
    if n > BITS:
        raise InvalidError("the proof is too deep")
    stated, now = None, scheme.placeholder
    if proof.leaf:
        there, vh = proof.leaf
        now = scheme.leaf_hash(there, vh)
        if there == path:
            stated = vh
        elif BITS - (int.from_bytes(there, "big") ^ bits).bit_length() < n:
            raise InvalidError("the leaf does not cover the path")
    for i, sibling in enumerate(proof.siblings):
        now = scheme.inner_hash(sibling, now) if bits >> (BITS - n + i) & 1 else scheme.inner_hash(now, sibling)
    if now != root:
        raise InvalidError("the proof does not match the root")
    return stated


def prove(path: bytes, top: Top, leaves_of) -> Proof:
    """leaves_of(bucket) gives the Leaves of a bucket."""
    bucket, above, siblings = top.way(bucket_at(path, top.depth))
    if bucket is None:
        return Proof(None, siblings[::-1])
    if above:
        return Proof(leaves_of(bucket).leaves[0], siblings[::-1])
    leaf, below = leaves_of(bucket).descend(int.from_bytes(path, "big"), top.depth)
    return Proof(leaf, (siblings + below)[::-1])


#: Kinds of rows to fold: an old leaf, a change, and a bucket that is folded already (_path: its old hash, _vh: counts and its new hash).
OLD, PUT, GONE, WHOLE = 0, 1, 2, 3
ROWS = "b int, _path binary, _vh binary, kind int"
FOLDED = "bucket int, old_count int, old_hash binary, count int, hash binary, taken long, idle long"
#: How the counts of a folded bucket are packed.
_COUNTS = "<BBqq"


class _Stretches:
    """Folds one bucket after another, of rows that come bucket by bucket. before, after: further leaves of either side."""

    def __init__(self, depth: int, before: list[tuple[bytes, bytes]], after: list[tuple[bytes, bytes]], scheme: Scheme) -> None:
        self.depth, self.scheme, self.more = depth, scheme, ({}, {})
        for side, leaves in zip(self.more, (before, after), strict=True):
            for leaf in leaves:
                side.setdefault(bucket_at(leaf[0], depth), []).append(leaf)
        self._begin(None)

    def _begin(self, bucket: int | None) -> None:
        self.now, self.old, self.changes, self.again, self.whole = bucket, [], {}, 0, []

    def _folded(self) -> tuple:
        """A row of FOLDED."""
        depth, scheme, more, now, old, changes = self.depth, self.scheme, self.more, self.now, self.old, self.changes
        if self.whole:
            if len(self.whole) > 1 or old or changes:
                raise InvalidError("a bucket that one file should hold comes in parts")
            was, stated = self.whole[0]
            n, m, taken, idle = struct.unpack_from(_COUNTS, stated)
            return now, n, was, m, stated[struct.calcsize(_COUNTS) :], taken, idle
        was = Leaves(old + more[0].get(now, []), scheme).fold(depth)
        if not changes and more[0].get(now) == more[1].get(now):
            return now, *was, *was, 0, 0
        known = dict(old)
        taken = self.again + sum(v is not None and p in known for p, v in changes.items())
        idle = sum(known.get(p) == v for p, v in changes.items())
        new = [x for x in old if x[0] not in changes] + [(p, v) for p, v in changes.items() if v is not None]
        return now, *was, *Leaves(new + more[1].get(now, []), scheme).fold(depth), taken, idle

    def close(self) -> list[tuple]:
        out = [] if self.now is None else [self._folded()]
        self._begin(None)
        return out

    def add(self, batch: pa.RecordBatch) -> list[tuple]:
        """The buckets that end within a batch."""
        out: list[tuple] = []
        for b, path, vh, kind in zip(*map(listed, batch.columns), strict=True):
            if b != self.now:
                out += self.close()
                self._begin(b)
            if kind == OLD:
                self.old.append((path, vh))
            elif kind == WHOLE:
                self.whole.append((path, vh))
            else:
                self.again += path in self.changes
                self.changes[path] = vh if kind == PUT else None
        return out


def fold_buckets(depth: int, before: list[tuple[bytes, bytes]], after: list[tuple[bytes, bytes]], scheme: Scheme):
    """For mapInArrow over ROWS sorted by b: per bucket the capped count and hash of its old leaves, and of
    those after the changes (kinds PUT and GONE); how many puts met a path that is taken, by an old leaf or another change;
    and how many changes change nothing. before, after: further leaves of either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches = _Stretches(depth, before, after, scheme)
        out = [r for batch in batches for r in stretches.add(batch)] + stretches.close()
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], [c.split()[0] for c in FOLDED.split(", ")])

    return run


def fold_alone(depth: int, before: list[tuple[bytes, bytes]], after: list[tuple[bytes, bytes]], scheme: Scheme, alone: np.ndarray):
    """For mapInArrow over ROWS in the order of the files: each bucket of which one file has all rows becomes one row of kind WHOLE, which
    fold_buckets takes as it is; rows of others pass. alone: of each bucket, whether it is one of the former."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretches, names = _Stretches(depth, before, after, scheme), [c.split()[0] for c in ROWS.split(", ")]

        def wholes(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                stated = [struct.pack(_COUNTS, n, m, taken, idle) + h for _, n, _, m, h, taken, idle in found]
                columns = [pa.array([r[0] for r in found], pa.int32()), pa.array([r[2] for r in found], pa.binary()), pa.array(stated, pa.binary()), pa.array([WHOLE] * len(found), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            own = alone[batch.column(0).to_numpy()]
            if not own.all():
                yield pa.RecordBatch.from_arrays(batch.filter(pa.array(~own)).columns, names)
                batch = batch.filter(pa.array(own))
            yield from wholes(stretches.add(batch))
        yield from wholes(stretches.close())

    return run


VERSIONS = "bucket int, version long, count int, hash binary, leaf binary, siblings binary"


def fold_versions(depth: int, before: int, last: int, more: list[tuple[bytes, bytes]], head: bytes | None, scheme: Scheme):
    """For mapInArrow over (b, _path, _vh, _deleted, _version) sorted by b and version: per bucket the capped count and hash of its leaves as of the
    version before and of each version that changes it. Of the bucket with the path head, whose own leaf is not among the leaves: for every
    version up to the last the leaf at the end of that path's way, and the siblings on it. more: further leaves of all versions."""
    own = None if head is None else bucket_at(head, depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, at, leaves = None, before, {}

        def close(upto: int) -> None:
            """What the bucket is as of a version, and of later ones below upto."""
            held = Leaves([*leaves.items(), *[x for x in more if bucket_at(x[0], depth) == now]], scheme)
            if now != own:
                out.append((now, at, *held.fold(depth), None, None))
                return
            leaf, siblings = held.descend(int.from_bytes(head, "big"), depth)
            out.extend((now, v, 0, b"", b"".join(leaf) if leaf else None, b"".join(siblings)) for v in range(at, upto))

        for batch in batches:
            for b, path, vh, gone, version in zip(*map(listed, batch.columns), strict=True):
                if b != now:
                    if now is not None:
                        close(last + 1)
                    now, at, leaves = b, before, {}
                if version != at:
                    close(version)
                    at = version
                if gone:
                    leaves.pop(path, None)
                else:
                    leaves[path] = vh
        if now is not None:
            close(last + 1)
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], [c.split()[0] for c in VERSIONS.split(", ")])

    return run


def with_leaf(path: bytes, vh: bytes | None, depth: int, leaf: tuple[bytes, bytes] | None, siblings: list[bytes], scheme: Scheme) -> Folded:
    """A bucket with a further leaf (vh None: without), from the end of its path's way and the siblings on it, top-down."""
    found = Leaves([*([leaf] if leaf else []), *([(path, vh)] if vh is not None else [])], scheme).fold(depth + len(siblings))
    bits = int.from_bytes(path, "big")
    for i in reversed(range(len(siblings))):
        found = Folded(2, scheme.inner_hash(siblings[i], found.hash) if bits >> (BITS - 1 - depth - i) & 1 else scheme.inner_hash(found.hash, siblings[i]))
    return found


def bucket_at(path: bytes, depth: int) -> int:
    return int.from_bytes(path[:4], "big") >> (32 - depth) if depth else 0
