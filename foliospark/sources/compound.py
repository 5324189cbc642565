"""OLE compound files: an own reader and a rebuilding writer, after the public MS-CFB specification."""

from __future__ import annotations

import struct
from dataclasses import dataclass

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
END, FREE, FAT_SECTOR, DIFAT_SECTOR = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD, 0xFFFFFFFC
NONE = 0xFFFFFFFF


class CompoundError(ValueError):
    """The bytes aren't a compound file that can be read."""


@dataclass(frozen=True)
class Entry:
    path: str
    kind: int  # 1 storage, 2 stream, 5 root
    start: int
    size: int


class Reader:
    """Entries and streams of a compound file. Chains are checked for loops and ends."""

    def __init__(self, raw: bytes) -> None:
        if raw[:8] != MAGIC or len(raw) < 512:
            raise CompoundError("not a compound file")
        self.raw = raw
        self.sector, self.mini = 1 << struct.unpack_from("<H", raw, 30)[0], 1 << struct.unpack_from("<H", raw, 32)[0]
        if self.sector not in (512, 4096) or self.mini != 64:
            raise CompoundError("unknown sector size")
        _, first_dir, _, self.cutoff, first_mini, _, first_difat, n_difat = struct.unpack_from("<8I", raw, 44)
        tables = list(struct.unpack_from("<109I", raw, 76))
        at, per = first_difat, self.sector // 4
        for _ in range(n_difat):
            if at >= DIFAT_SECTOR:
                break
            words = struct.unpack(f"<{per}I", self._at(at))
            tables += words[:-1]
            at = words[-1]
        self.fat = [x for t in tables if t < DIFAT_SECTOR for x in struct.unpack(f"<{per}I", self._at(t))]
        self.minifat = list(struct.unpack(f"<{len(m) // 4}I", m)) if (m := self._chain(first_mini)) else []
        self._directory(self._chain(first_dir))

    def _at(self, i: int) -> bytes:
        at = (i + 1) * self.sector
        piece = self.raw[at : at + self.sector]
        if not piece:
            raise CompoundError("sector beyond the end")
        return piece.ljust(self.sector, b"\0")

    def _chain(self, at: int) -> bytes:
        out, seen = [], set()
        while at < DIFAT_SECTOR:
            if at in seen or at >= len(self.fat):
                raise CompoundError("broken sector chain")
            seen.add(at)
            out.append(self._at(at))
            at = self.fat[at]
        return b"".join(out)

    def _directory(self, raw: bytes) -> None:
        rows = []
        for i in range(0, len(raw), 128):
            e = raw[i : i + 128]
            n, kind = struct.unpack_from("<HB", e, 64)
            left, right, child = struct.unpack_from("<3I", e, 68)
            start, size = struct.unpack_from("<IQ", e, 116)
            rows.append((e[: max(0, min(n, 64) - 2)].decode("utf-16-le", "replace"), kind, left, right, child, start, size & 0xFFFFFFFF if self.sector == 512 else size))
        if not rows or rows[0][1] != 5:
            raise CompoundError("no root entry")
        self.entries: list[Entry] = [Entry("", 5, rows[0][5], rows[0][6])]
        self.ministream = self._chain(rows[0][5])[: rows[0][6]] if rows[0][6] else b""
        todo, seen = [(rows[0][4], "")], set()
        while todo:
            i, base = todo.pop()
            if i == NONE or i >= len(rows):
                continue
            if i in seen:
                raise CompoundError("directory loop")
            seen.add(i)
            name, kind, left, right, child, start, size = rows[i]
            path = f"{base}{name}"
            if kind in (1, 2):
                self.entries.append(Entry(path, kind, start, size))
            todo += [(left, base), (right, base)]
            if kind == 1:
                todo.append((child, path + "/"))
        self.entries.sort(key=lambda e: e.path)

    def read(self, e: Entry) -> bytes:
        if e.size == 0:
            return b""
        if e.size >= self.cutoff:
            return self._chain(e.start)[: e.size]
        out, at, seen = [], e.start, set()
        while at < DIFAT_SECTOR:
            if at in seen or at >= len(self.minifat):
                raise CompoundError("broken mini chain")
            seen.add(at)
            out.append(self.ministream[at * 64 : at * 64 + 64])
            at = self.minifat[at]
        return b"".join(out)[: e.size]

    def streams(self) -> dict[str, bytes]:
        return {e.path: self.read(e) for e in self.entries if e.kind == 2}


def write(streams: dict[str, bytes]) -> bytes:
    """A version 3 compound file with these streams; storages come from their paths."""
    # Directory: the root, then every storage and stream; siblings hang in a balanced tree by length and upper-case name.
    tree: dict = {}
    for path, raw in streams.items():
        node = tree
        *folders, name = path.strip("/").split("/")
        for f in folders:
            node = node.setdefault(f, {})
            if not isinstance(node, dict):
                raise CompoundError(f"{path} lies in a stream")
        node[name] = raw
    rows: list[dict] = [{"name": "Root Entry", "kind": 5, "child": NONE, "raw": b""}]

    def add(children: dict) -> int:
        names = sorted(children, key=lambda n: (len(n.encode("utf-16-le")), n.upper()))
        ids = {}
        for n in names:
            if len(n.encode("utf-16-le")) > 62:
                raise CompoundError(f"name too long: {n}")
            rows.append({"name": n, "kind": 1 if isinstance(children[n], dict) else 2, "child": NONE, "raw": children[n] if not isinstance(children[n], dict) else b""})
            ids[n] = len(rows) - 1
        for n in names:
            if isinstance(children[n], dict):
                rows[ids[n]]["child"] = add(children[n])

        def balance(part: list[str]) -> int:
            if not part:
                return NONE
            m = len(part) // 2
            rows[ids[part[m]]] |= {"left": balance(part[:m]), "right": balance(part[m + 1 :])}
            return ids[part[m]]

        return balance(names)

    rows[0]["child"] = add(tree)
    sectors: list[bytes] = []
    fat: list[int] = []

    def chain(raw: bytes) -> int:
        if not raw:
            return END
        first = len(sectors)
        for i in range(0, len(raw), 512):
            sectors.append(raw[i : i + 512].ljust(512, b"\0"))
            fat.append(len(sectors))
        fat[-1] = END
        return first

    mini, minifat = b"", []
    for r in rows[1:]:
        raw = r["raw"]
        if r["kind"] == 2 and 0 < len(raw) < 4096:
            r["start"] = len(minifat)
            n = -(-len(raw) // 64)
            minifat += [len(minifat) + i + 1 for i in range(n - 1)] + [END]
            mini += raw.ljust(n * 64, b"\0")
        elif r["kind"] == 2:
            r["start"] = chain(raw)
    rows[0]["start"], rows[0]["raw"] = chain(mini), mini
    first_mini = chain(struct.pack(f"<{len(minifat)}I", *minifat) + b"\xff" * (-len(minifat) * 4 % 512)) if minifat else END
    table = b"".join(
        r["name"].encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB3I", len(r["name"].encode("utf-16-le")) + 2, r["kind"], 1, r.get("left", NONE), r.get("right", NONE), r["child"]) + b"\0" * 36 + struct.pack("<IQ", r.get("start", 0 if r["kind"] == 1 else END), len(r["raw"]))
        for r in rows
    )
    empty = b"\0" * 66 + struct.pack("<BB3I", 0, 0, NONE, NONE, NONE) + b"\0" * 48
    first_dir = chain(table + empty * (-len(rows) % 4))
    # The tables of sectors hold themselves too; their numbers depend on each other.
    n_fat = n_difat = 0
    while True:
        need = -(-(len(fat) + n_fat + n_difat) // 128)
        more = max(0, -(-(need - 109) // 127))
        if (need, more) == (n_fat, n_difat):
            break
        n_fat, n_difat = need, more
    base = len(fat)
    fat += [FAT_SECTOR] * n_fat + [DIFAT_SECTOR] * n_difat
    fat += [FREE] * (n_fat * 128 - len(fat))
    places = list(range(base, base + n_fat))
    for i in range(n_fat):
        sectors.append(struct.pack("<128I", *fat[i * 128 : i * 128 + 128]))
    rest = places[109:]
    for i in range(n_difat):
        part = rest[i * 127 : i * 127 + 127]
        sectors.append(struct.pack("<128I", *part, *[FREE] * (127 - len(part)), base + n_fat + i + 1 if i + 1 < n_difat else END))
    head = MAGIC + b"\0" * 16 + struct.pack("<5H", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6
    head += struct.pack("<9I", 0, n_fat, first_dir, 0, 4096, first_mini, -(-len(minifat) // 128), base + n_fat if n_difat else END, n_difat)
    head += struct.pack("<109I", *places[:109], *[FREE] * (109 - len(places[:109])))
    return head + b"".join(sectors)
