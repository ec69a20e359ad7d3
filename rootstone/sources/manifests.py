"""The log: one authenticated manifest per version, published by exclusive creation.

A manifest names the root and the history head of its version, the version before, the files with the rows it changed and their
hashes, the catalog, and system leaves (catalog entries and the head), which are few and live in the manifest itself. Its buckets
file has the hashes of the tree above the rows. A run has the files of several versions in a row, merged into one.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np

from rootstone.errors import ConflictError, CorruptedError, InvalidError, MissingError
from rootstone.functions.commitments import OWN, Scheme
from rootstone.functions.merkle import Top

from .files import Folder
from .tables import DataFile

#: Of each table id, files.
Files = dict[str, list[DataFile]]


def encoded(files: Files) -> dict[str, list[dict]]:
    return {t: [f.encode() for f in own] for t, own in files.items()}


def decoded(files: dict[str, list[dict]]) -> Files:
    return {t: [DataFile(**f) for f in own] for t, own in files.items()}


@dataclass
class Manifest:
    version: int
    root: str
    before: int = 0
    head: str = "00" * 32
    history: bool = False
    depth: int = 8
    sealed: bool = False
    #: The files this version wrote, and a bitmap of the buckets it touched.
    files: Files = field(default_factory=dict)
    touched: str = ""
    #: Table definitions by name.
    tables: dict[str, dict] = field(default_factory=dict)
    #: Values of system leaves by key, both hexadecimal.
    system: dict[str, str] = field(default_factory=dict)
    next_table: int = 1
    #: Of each stream that writes here, the newest batch.
    streams: dict[str, int] = field(default_factory=dict)

    def buckets(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(bytes.fromhex(self.touched), np.uint8), count=1 << self.depth).astype(bool) if self.touched else np.zeros(1 << self.depth, bool)

    def payload(self) -> bytes:
        return json.dumps(asdict(self) | {"files": encoded(self.files)}, sort_keys=True).encode()


def sealed(payload: bytes, key: bytes, scheme: Scheme) -> bytes:
    return json.dumps({"payload": payload.decode(), "mac": scheme.mac(key, payload).hex()}).encode()


def opened(data: bytes, key: bytes, scheme: Scheme) -> dict:
    try:
        stored = json.loads(data)
        payload = stored["payload"].encode()
        if scheme.mac(key, payload).hex() != stored["mac"]:
            raise CorruptedError("a manifest is not authentic")
        return json.loads(payload)
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise CorruptedError(f"malformed manifest: {e}") from e


class Log:
    def __init__(self, folder: Folder, key: bytes, scheme: Scheme = OWN) -> None:
        self.folder, self.key, self.scheme = folder, key, scheme
        self._known: dict[int, Manifest] = {}
        self._merged: dict[tuple[int, int], Files] = {}

    @staticmethod
    def _name(version: int) -> str:
        return f"_log/{version:020d}"

    def versions(self) -> list[int]:
        return [int(n[:20]) for n in self.folder.names("_log") if n.endswith(".json")]

    def publish(self, manifest: Manifest, top: Top) -> None:
        name = self._name(manifest.version)
        if not self.folder.create(f"{name}.buckets", top.encode()) or not self.folder.create(f"{name}.json", sealed(manifest.payload(), self.key, self.scheme)):
            raise ConflictError(f"version {manifest.version} was written by another writer")
        self._known[manifest.version] = manifest

    def manifest(self, version: int) -> Manifest:
        if version not in self._known:
            name = f"{self._name(version)}.json"
            if not self.folder.exists(name):
                raise MissingError(f"version {version} was pruned or never written")
            stored = opened(self.folder.read(name), self.key, self.scheme)
            found = Manifest(**(stored | {"files": decoded(stored["files"])}))
            if found.version != version:
                raise CorruptedError(f"the manifest of version {version} names version {found.version}")
            self._known[version] = found
        return self._known[version]

    def top(self, version: int) -> Top:
        """The tree above the buckets, checked against the manifest's root."""
        try:
            top = Top.decode(self.folder.read(f"{self._name(version)}.buckets"), self.scheme)
        except InvalidError as e:
            raise CorruptedError(str(e)) from e
        if top.root.hex() != self.manifest(version).root:
            raise CorruptedError(f"the bucket hashes of version {version} do not give its root")
        return top

    # runs

    @staticmethod
    def _run_name(after: int, upto: int) -> str:
        return f"_runs/{after:020d}-{upto:020d}.json"

    def runs_there(self) -> list[tuple[int, int]]:
        return [(int(n[:20]), int(n[21:41])) for n in self.folder.names("_runs") if n.endswith(".json")]

    def write_run(self, after: int, upto: int, files: Files) -> None:
        payload = json.dumps({"after": after, "upto": upto, "files": encoded(files)}, sort_keys=True).encode()
        if self.folder.create(self._run_name(after, upto), sealed(payload, self.key, self.scheme)):
            self._merged[after, upto] = files

    def run(self, after: int, upto: int) -> Files:
        if (after, upto) not in self._merged:
            stored = opened(self.folder.read(self._run_name(after, upto)), self.key, self.scheme)
            if (stored["after"], stored["upto"]) != (after, upto):
                raise CorruptedError("a run names other versions")
            self._merged[after, upto] = decoded(stored["files"])
        return self._merged[after, upto]

    def drop_run(self, after: int, upto: int) -> None:
        self.folder.delete(self._run_name(after, upto))
        self._merged.pop((after, upto), None)

    def runs(self, version: int, merged: bool = True) -> list[tuple[int, int, Files]]:
        """(after, upto, files), oldest first, which together are a version's state: the longest runs that fit, and the changes of
        single versions. merged: off uses no run but the one that took the place of pruned versions."""
        there, out, at = self.runs_there(), [], 0
        versions = [v for v in self.versions() if v <= version]
        if not merged and versions and versions[0] > 0:
            there = [r for r in there if r == (0, versions[0])]
        elif not merged:
            there = []
        while at < version:
            upto = max((b for a, b in there if a == at and b <= version), default=None)
            if upto is not None:
                out.append((at, upto, self.run(at, upto)))
            else:
                upto = next((v for v in versions if v > at), None)
                if upto is None or self.manifest(upto).before != at:
                    raise CorruptedError(f"changes between versions {at} and {version} are missing")
                out.append((at, upto, self.manifest(upto).files))
            at = upto
        return out

    def forget(self, version: int) -> None:
        for end in ("json", "buckets", "json.lock", "buckets.lock"):
            self.folder.delete(f"{self._name(version)}.{end}")
        self._known.pop(version, None)


