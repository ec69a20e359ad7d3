"""What an adversary with the storage, but without the key, can do to a store: for tests of what is noticed."""

from __future__ import annotations

from rootstone.operators.store import Store


class Tamper:
    def __init__(self, store: Store) -> None:
        self.folder = store.folder

    def records(self, below: str = "") -> list[str]:
        """Names of all files below a folder of the store."""
        out = []
        for name in self.folder.names(below):
            at = f"{below}/{name}" if below else name
            out += self.records(at) if self.folder.is_folder(at) else [at]
        return [r for r in out if not r.endswith((".crc", ".lock", ".part", "_SUCCESS"))]

    def flip(self, name: str, at: int = -9, bits: int = 1) -> bytes:
        """Flips bits of a byte; returns what the file was."""
        raw = bytearray(self.folder.read(name))
        before = bytes(raw)
        raw[at % len(raw)] ^= bits
        self.folder.replace(name, bytes(raw))
        return before

    def put_back(self, name: str, raw: bytes) -> None:
        self.folder.replace(name, raw)

    def remove(self, name: str) -> None:
        self.folder.delete(name)
