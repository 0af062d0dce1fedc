"""Compound files: the directory as a tree of paths, and streams read sector by sector on demand."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

from pyspark.sql import DataFrame

from cellweave.sources.model import streamed

# The mark at the start, the first number that names no sector, and the kinds of entries.
MARK = bytes.fromhex("D0CF11E0A1B11AE1")
NO_SECTOR = 0xFFFFFFFC
KINDS = {1: "storage", 2: "stream", 5: "root"}


class Entry(NamedTuple):
    path: str
    kind: str
    size: int
    start: int


class Compound:
    """A compound file over anything that seeks and reads. Only the header, the directory and the sectors asked for are read."""

    def __init__(self, f: BinaryIO):
        self.f = f
        f.seek(0)
        head = f.read(512)
        if head[:8] != MARK or len(head) < 512:
            raise ValueError("No compound file")
        self.size, self.mini = 1 << struct.unpack_from("<H", head, 30)[0], 1 << struct.unpack_from("<H", head, 32)[0]
        _, root, _, self.cutoff, self.mini_fat, _, self.more, _ = struct.unpack_from("<IIIIIIII", head, 44)
        self.heads = [x for x in struct.unpack_from("<109I", head, 76) if x < NO_SECTOR]
        self.tables: dict[int, tuple[int, ...]] = {}
        self.limit = f.seek(0, io.SEEK_END) // self.size + 1  # more sectors than this make a circle
        if self.more < NO_SECTOR:
            self._all_heads()
        directory = b"".join(map(self.sector, self.chain(root)))
        self.entries = list(self._walk([directory[i : i + 128] for i in range(0, len(directory) - 127, 128)]))
        self.store: list[int] | None = None

    def sector(self, i: int) -> bytes:
        self.f.seek((i + 1) * self.size)
        return self.f.read(self.size)

    def _numbers(self, i: int) -> tuple[int, ...]:
        if i not in self.tables:
            self.tables[i] = struct.unpack(f"<{self.size // 4}I", self.sector(i).ljust(self.size, b"\xff"))
        return self.tables[i]

    def _all_heads(self) -> None:
        """Sectors of the allocation table beyond those that the header names: a chain of lists, the last number of each being the next list."""
        at, seen = self.more, 0
        while at < NO_SECTOR and seen < self.limit:
            *some, following = self._numbers(at)
            self.heads += [x for x in some if x < NO_SECTOR]
            at, seen = following, seen + 1

    def following(self, i: int) -> int:
        table, place = divmod(i, self.size // 4)
        return self._numbers(self.heads[table])[place] if table < len(self.heads) else NO_SECTOR

    def chain(self, i: int) -> Iterator[int]:
        n = 0
        while i < NO_SECTOR and n < self.limit:
            yield i
            i, n = self.following(i), n + 1

    def _walk(self, raw: list[bytes]) -> Iterator[Entry]:
        """Entries by path: a storage's children are a red-black tree of siblings, in order."""
        if not raw:
            return
        none, seen = 0xFFFFFFFF, set()

        def one(i: int, above: str) -> Entry:
            e = raw[i]
            name = e[: max(0, struct.unpack_from("<H", e, 64)[0] - 2)].decode("utf-16-le", "replace")
            start, low, high = struct.unpack_from("<III", e, 116)
            return Entry(above + name, KINDS.get(e[66], "unused"), low + (high << 32 if self.size > 512 else 0), start)

        # what is left to do: (entry, path above, whether its left siblings are done)
        todo: list[tuple[int, str, bool]] = [(0, "", False)]
        while todo:
            i, above, ready = todo.pop()
            if not ready:
                if i >= len(raw) or i in seen:
                    continue
                seen.add(i)
            e = one(i, above)
            left, right, child = struct.unpack_from("<III", raw[i], 68)
            if not ready and left != none:
                todo += [(i, above, True), (left, above, False)]
                continue
            if e.kind == "unused":
                continue
            yield e
            if right != none:
                todo.append((right, above, False))
            if child != none and e.kind != "stream":
                todo.append((child, "" if e.kind == "root" else e.path + "/", False))

    def find(self, *names: str) -> Entry | None:
        """The stream of the first of these paths that is there, in any case."""
        streams = {e.path.lower(): e for e in reversed(self.entries) if e.kind == "stream"}
        return next((streams[n.lower()] for n in names if n.lower() in streams), None)

    def pieces(self, e: Entry) -> Iterator[bytes]:
        """A stream's content, sector by sector; small streams are kept in the root's own stream."""
        rest = e.size
        if e.size >= self.cutoff:
            for i in self.chain(e.start):
                if rest <= 0:
                    return
                yield self.sector(i)[:rest]
                rest -= self.size
            return
        if self.store is None:
            self.store = list(self.chain(self.entries[0].start))
            self.small = [x for i in self.chain(self.mini_fat) for x in self._numbers(i)]
        i, n, each = e.start, 0, self.size // self.mini
        while i < min(NO_SECTOR, len(self.small)) and rest > 0 and n <= len(self.small):
            place, part = divmod(i, each)
            if place >= len(self.store):
                return
            self.f.seek((self.store[place] + 1) * self.size + part * self.mini)
            yield self.f.read(self.mini)[:rest]
            rest, i, n = rest - self.mini, self.small[i], n + 1

    def read(self, e: Entry) -> bytes:
        return b"".join(self.pieces(e))


def compound_entries(docs: DataFrame, key: str = "doc_id", content: str = "content") -> DataFrame:
    """(workbook_id, n, path, kind, size): the entries of each compound file in the order of its directory, the root first. What is none has no rows."""

    def entries(data: bytes) -> Iterator[tuple]:
        try:
            every = Compound(io.BytesIO(data)).entries
        except (ValueError, struct.error, IndexError):
            return
        for n, e in enumerate(every):
            yield n, e.path, e.kind, e.size if e.kind == "stream" else 0

    return streamed(docs, key, content, "n int, path string, kind string, size long", entries)
