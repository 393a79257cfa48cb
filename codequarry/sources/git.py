"""Git repositories as a table of changed files.

``git_changes`` reads bare repositories, or work trees with a ``.git`` folder, below a folder that driver and executors see under one path (a shared mount).
A partition is a repository, or a range of the commits of one whose packs are large. Executors look objects up in the pack indexes, resolve deltas, and
compare each commit's tree with its first parent's; blobs are read only for files that changed. Filters on the time, the hash, the merge flag and the
repository go to the source, where they keep commits from being compared (``spark.sql.python.filterPushdown.enabled``, which ``changes`` sets).
"""

from __future__ import annotations

import heapq
import math
import mmap
import os
import re
import struct
import zlib
from bisect import bisect_left
from collections import Counter, OrderedDict
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not

CHANGE = (
    "repo string, commit_hash string, parent_commit string, seq long, committed_at timestamp, message string, is_merge boolean, "
    "old_path string, new_path string, before string, after string, author string"
)
#: Columns of a commit that filters may be on before its files are looked at.
KNOWN = ("repo", "commit_hash", "committed_at", "is_merge")
#: Bytes of packs for which a repository gets one more partition, and of resolved delta bases that a task keeps.
SLICE_BYTES, BASE_BYTES = 256 << 20, 32 << 20
#: Commits that a task keeps as they were parsed: most are read once more as a parent.
KEPT_COMMITS = 4096
#: A file that went and one that came are one renamed file from this share of equal content on; above so many files a side only equal ones are.
RENAMED, RENAME_LIMIT = 0.5, 1000
# Kinds of objects and deltas in packs, and the modes of files.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
BY_OFFSET, BY_NAME = 6, 7
FILES, FOLDER = (b"100644", b"100755", b"100664"), b"40000"
_ENTRIES = re.compile(rb"([0-7]+) ([^\0]+)\0([\s\S]{20})").findall


def _patched(base: bytes, delta: bytes) -> bytes:
    """``base`` changed by a delta: lengths of both, then copies from the base and new bytes."""
    at, sizes = 0, []
    for _ in range(2):
        size = shift = 0
        while True:
            byte = delta[at]
            at, size, shift = at + 1, size | (byte & 127) << shift, shift + 7
            if byte < 128:
                break
        sizes.append(size)
    out = []
    while at < len(delta):
        op, at = delta[at], at + 1
        if op < 128:
            out.append(delta[at : at + op])
            at += op
            continue
        fields = [0, 0]
        for bit in range(7):
            if op >> bit & 1:
                fields[bit > 3] |= delta[at] << 8 * (bit & 3)
                at += 1
        start, size = fields[0], fields[1] or 0x10000
        out.append(base[start : start + size])
    whole = b"".join(out)
    if len(base) != sizes[0] or len(whole) != sizes[1]:
        raise ValueError("a delta doesn't fit its base")
    return whole


class Pack:
    """One pack and its index (version 2), both mapped into memory."""

    def __init__(self, index: str):
        with open(index, "rb") as file:
            self._index = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        with open(index.removesuffix(".idx") + ".pack", "rb") as file:
            self._data = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        if self._index[:8] != b"\xfftOc\x00\x00\x00\x02":
            raise ValueError(f"{index} is no index of version 2")
        self._fan = (0, *struct.unpack_from(">256I", self._index, 8))
        self.n = self._fan[256]

    def _number(self, at: int, size: int = 4) -> int:
        return int.from_bytes(self._index[at : at + size], "big")

    def name(self, k: int) -> bytes:
        return self._index[1032 + 20 * k : 1052 + 20 * k]

    def _place(self, name: bytes) -> int | None:
        """The number of a name in the index. Names are evenly spread, so it is close to its share of those with its first byte."""
        low, high = self._fan[name[0]], self._fan[name[0] + 1]
        about = low + ((high - low) * int.from_bytes(name[1:4], "big") >> 24)
        room = 8 + 2 * math.isqrt(high - low)
        begin, end = max(low, about - room), min(high, about + room)
        some = self._index[1032 + 20 * begin : 1032 + 20 * end]
        at = some.find(name)
        if at >= 0 and at % 20 == 0:
            return begin + at // 20
        if at < 0 and (begin == low or some[:20] < name) and (end == high or some[-20:] > name):
            return None
        k = bisect_left(range(self.n), name, low, high, key=self.name)
        return k if k < high and self.name(k) == name else None

    def offset(self, name: bytes) -> int | None:
        k = self._place(name)
        if k is None:
            return None
        places = 1032 + 24 * self.n
        at = self._number(places + 4 * k)
        return at if at < 1 << 31 else self._number(places + 4 * self.n + 8 * (at & 0x7FFFFFFF), 8)

    def entry(self, at: int) -> tuple[int, int | bytes | None, bytes]:
        """Kind, base (its offset or name) and inflated bytes of what stands at an offset."""
        begin, byte = at, self._data[at]
        kind, size, shift = byte >> 4 & 7, byte & 15, 4
        while byte > 127:
            at += 1
            byte = self._data[at]
            size, shift = size | (byte & 127) << shift, shift + 7
        at, base = at + 1, None
        if kind == BY_OFFSET:
            byte, at = self._data[at], at + 1
            back = byte & 127
            while byte > 127:
                byte, at = self._data[at], at + 1
                back = (back + 1) << 7 | byte & 127
            base = begin - back
        elif kind == BY_NAME:
            base, at = self._data[at : at + 20], at + 20
        try:  # mostly all of it is here; what follows it is ignored
            whole = zlib.decompress(self._data[at : at + size + (size >> 3) + 64], bufsize=size + 1)
        except zlib.error:
            whole = b""
        if len(whole) == size:
            return kind, base, whole
        inflate, out = zlib.decompressobj(), []
        while not inflate.eof:
            out.append(inflate.decompress(self._data[at : at + max(1 << 12, size)]))
            at += max(1 << 12, size)
        return kind, base, b"".join(out)


class Store:
    """Objects of one repository: loose ones, packs, and those of the folders it borrows from."""

    def __init__(self, git: str):
        self.git = git
        self._folders, todo = [], [f"{git}/objects"]
        while todo:
            folder = os.path.normpath(todo.pop())
            if folder not in self._folders and os.path.isdir(folder):
                self._folders.append(folder)
                todo += [os.path.join(folder, x) for x in _lines(f"{folder}/info/alternates")]
        self._packs = [Pack(f"{f}/pack/{x}") for f in self._folders if os.path.isdir(f"{f}/pack") for x in sorted(os.listdir(f"{f}/pack")) if x.endswith(".idx")]
        self._bases: OrderedDict[tuple[int, int], tuple[str, bytes]] = OrderedDict()
        self._room = BASE_BYTES
        self._commits: dict[bytes, dict] = {}
        #: Packs, that of the last object first: what belongs to one commit mostly lies together.
        self._likely = list(range(len(self._packs)))

    def read(self, name: bytes) -> tuple[str, bytes]:
        """Kind and content of an object."""
        for place, k in enumerate(self._likely):
            if (at := self._packs[k].offset(name)) is not None:
                if place:
                    self._likely.insert(0, self._likely.pop(place))
                return self._packed(k, at)
        text = name.hex()
        for folder in self._folders:
            if os.path.exists(path := f"{folder}/{text[:2]}/{text[2:]}"):
                with open(path, "rb") as file:
                    head, _, content = zlib.decompress(file.read()).partition(b"\0")
                return head.split(b" ")[0].decode(), content
        raise KeyError(f"{self.git} has no object {text}")

    def _packed(self, k: int, at: int) -> tuple[str, bytes]:
        deltas: list[tuple[int, bytes]] = []
        while True:
            if (known := self._bases.get((k, at))) is not None:
                self._bases.move_to_end((k, at))
                kind, content = known
                break
            code, base, content = self._packs[k].entry(at)
            if code in KINDS:
                kind = KINDS[code]
                break
            deltas.append((at, content))
            if isinstance(base, bytes) and (inside := self._packs[k].offset(base)) is None:
                kind, content = self.read(base)
                break
            at = base if isinstance(base, int) else inside
        for place, delta in reversed(deltas):
            self._keep((k, at), kind, content)
            content, at = _patched(content, delta), place
        if deltas:
            self._keep((k, at), kind, content)
        return kind, content

    def _keep(self, key: tuple[int, int], kind: str, content: bytes) -> None:
        if key not in self._bases and len(content) < BASE_BYTES // 4:
            self._bases[key] = kind, content
            self._room -= len(content)
            while self._room < 0:
                self._room += len(self._bases.popitem(last=False)[1][1])

    def tips(self, ref: str) -> list[bytes]:
        """Commits that ``ref`` names: 'HEAD', 'all', or a full name."""
        refs = {name: value for value, name in (x.split(" ", 1) for x in _lines(f"{self.git}/packed-refs") if x[0] not in "#^")}
        for folder, _, names in os.walk(f"{self.git}/refs"):
            for x in names:
                refs[os.path.relpath(f"{folder}/{x}", self.git)] = "".join(_lines(f"{folder}/{x}"))
        refs["HEAD"] = "".join(_lines(f"{self.git}/HEAD"))
        found = []
        for name in refs if ref == "all" else [ref]:
            value = refs.get(name, "")
            while value.startswith("ref: "):
                value = refs.get(value[5:], "")
            if value:
                found.append(self._commit_of(bytes.fromhex(value)))
        return [x for x in dict.fromkeys(found) if x is not None]

    def _commit_of(self, name: bytes) -> bytes | None:
        kind, content = self.read(name)
        while kind == "tag":
            name = bytes.fromhex(content[7:47].decode())
            kind, content = self.read(name)
        return name if kind == "commit" else None

    def commit(self, name: bytes) -> dict:
        if (known := self._commits.get(name)) is not None:
            return known
        head, _, message = self.read(name)[1].partition(b"\n\n")
        out: dict = {"parents": [], "author": "", "message": message.decode(errors="replace").strip()}
        for line in head.split(b"\n"):
            key, _, value = line.partition(b" ")
            if key == b"parent":
                out["parents"].append(bytes.fromhex(value.decode()))
            elif key == b"tree":
                out["tree"] = bytes.fromhex(value.decode())
            elif key == b"author":
                out["author"] = value.partition(b" <")[0].decode(errors="replace")
            elif key == b"committer":
                out["time"] = int(value.rsplit(b" ", 2)[1])
        if len(self._commits) >= KEPT_COMMITS:
            self._commits.clear()
        self._commits[name] = out
        return out

    def _links(self, name: bytes) -> tuple[list[bytes], int]:
        """Parents and time of a commit, without the rest of it."""
        parents, time = [], 0
        for line in self.read(name)[1].partition(b"\n\n")[0].split(b"\n"):
            if line.startswith(b"parent "):
                parents.append(bytes.fromhex(line[7:].decode()))
            elif line.startswith(b"committer "):
                time = int(line.rsplit(b" ", 2)[1])
        return parents, time

    def history(self, ref: str) -> list[bytes]:
        """All commits behind ``ref``, parents before children, else by time and name. Commits that a shallow clone lacks end a line."""
        absent = {bytes.fromhex(x) for x in _lines(f"{self.git}/shallow")}
        parents, times, todo = {}, {}, self.tips(ref)
        while todo:
            if (name := todo.pop()) not in parents:
                up, times[name] = self._links(name)
                parents[name] = [] if name in absent else up
                todo += parents[name]
        missing = {name: len(set(up)) for name, up in parents.items()}
        children: dict[bytes, list[bytes]] = {}
        for name, up in parents.items():
            for parent in set(up):
                children.setdefault(parent, []).append(name)
        ready, order = [(times[x], x) for x, n in missing.items() if not n], []
        heapq.heapify(ready)
        while ready:
            _, name = heapq.heappop(ready)
            order.append(name)
            for child in children.get(name, ()):
                missing[child] -= 1
                if not missing[child]:
                    heapq.heappush(ready, (times[child], child))
        return order

    def tree(self, name: bytes | None) -> dict[bytes, tuple[bytes, bytes]]:
        """Mode and object of each name in a folder."""
        return {x: (mode, blob) for mode, x, blob in _ENTRIES(self.read(name)[1])} if name else {}

    def changed(self, old: bytes | None, new: bytes | None, under: bytes = b"") -> Iterator[tuple[bytes, bytes | None, bytes | None]]:
        """Paths of files that differ between two trees, with their blobs; equal folders aren't opened."""
        one, two = self.tree(old), self.tree(new)
        for x in sorted({x for x, _ in one.items() ^ two.items()}):
            (mode, was), (mode2, now) = one.get(x, (b"", None)), two.get(x, (b"", None))
            files = was if mode in FILES else None, now if mode2 in FILES else None
            if files[0] != files[1]:
                yield under + x, *files
            folders = was if mode == FOLDER else None, now if mode2 == FOLDER else None
            if folders[0] != folders[1]:
                yield from self.changed(*folders, under + x + b"/")

    def text(self, blob: bytes | None) -> str | None:
        return None if blob is None else self.read(blob)[1].decode(errors="ignore")


def _lines(path: str) -> list[str]:
    if not os.path.isfile(path):
        return []
    with open(path, errors="replace") as file:
        return [x for x in map(str.strip, file) if x]


def _chunks(content: bytes) -> Counter:
    """Bytes of each different line; long lines in parts of 64."""
    return Counter(part for line in content.splitlines(True) for part in (line[k : k + 64] for k in range(0, len(line), 64)))


def renamed(store: Store, gone: dict[bytes, bytes], fresh: dict[bytes, bytes]) -> dict[bytes, bytes]:
    """New paths and the old ones of the same files: equal blobs first, then the most alike, each file once; ties by name of file, then paths."""
    pairs: dict[bytes, bytes] = {}
    old_by_blob: dict[bytes, list[bytes]] = {}
    for path, blob in sorted(gone.items()):
        old_by_blob.setdefault(blob, []).append(path)
    for path, blob in sorted(fresh.items()):
        if same := old_by_blob.get(blob):
            pairs[path] = same.pop(0)
    old, new = sorted(gone.keys() - set(pairs.values())), sorted(fresh.keys() - pairs.keys())
    if not old or not new or max(len(old), len(new)) > RENAME_LIMIT:
        return pairs
    contents = {blob: store.read(blob)[1] for blob in {*(gone[x] for x in old), *(fresh[x] for x in new)}}
    chunks = {blob: _chunks(content) for blob, content in contents.items()}
    scored = []
    for a in old:
        for b in new:
            sizes = len(contents[gone[a]]), len(contents[fresh[b]])
            if min(sizes) >= RENAMED * max(sizes) > 0:
                one, two = chunks[gone[a]], chunks[fresh[b]]
                alike = sum(len(x) * min(n, two[x]) for x, n in one.items() if x in two) / max(sizes)
                if alike >= RENAMED:
                    scored.append((-alike, a.rsplit(b"/")[-1] != b.rsplit(b"/")[-1], a, b))
    used: set[bytes] = set()
    for _, _, a, b in sorted(scored):
        if a not in used and b not in pairs:
            used.add(a)
            pairs[b] = a
    return pairs


class Slice(InputPartition):
    """A repository's commits from one share of its history to another."""

    def __init__(self, repo: str, git: str, k: int, n: int):
        self.repo, self.git, self.k, self.n = repo, git, k, n


def repositories(path: str) -> Iterator[tuple[str, str]]:
    """Names (paths below the folder) and git folders of the repositories at and below a folder."""
    for folder, below, files in os.walk(path):
        inner = f"{folder}/.git"
        git = inner if os.path.isdir(inner) else folder if "HEAD" in files and "objects" in below else None
        if git:
            below.clear()
            name = os.path.relpath(folder, path).removesuffix(".git")
            yield (os.path.basename(os.path.normpath(path)).removesuffix(".git") if name in (".", "") else name), git
        else:
            below.sort()


def _holds(test: Filter, row: dict) -> bool:
    if isinstance(test, Not):
        return not _holds(test.child, row)
    value, wanted = row[test.attribute[0]], getattr(test, "value", None)
    if isinstance(wanted, datetime):
        wanted = wanted if wanted.tzinfo else wanted.astimezone(timezone.utc)
    match test:
        case IsNotNull():
            return value is not None
        case In():
            return value in wanted
        case GreaterThan():
            return value > wanted
        case GreaterThanOrEqual():
            return value >= wanted
        case LessThan():
            return value < wanted
        case LessThanOrEqual():
            return value <= wanted
    return value == wanted


def _usable(test: Filter) -> bool:
    if isinstance(test, Not):
        return _usable(test.child)
    return isinstance(test, (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, IsNotNull)) and len(test.attribute) == 1 and test.attribute[0] in KNOWN


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        if "://" in self.path:
            raise ValueError("repositories are read from a mounted folder, not from another file system")
        self.suffix = options.get("suffix", ".py").encode()
        self.ref = options.get("ref", "HEAD")
        self.slice_bytes = int(options.get("slicebytes", SLICE_BYTES))
        self.phrases = [x.lower() for x in options.get("phrases", "").split("\n") if x]
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            if _usable(test):
                self.filters.append(test)
            else:
                yield test

    def partitions(self) -> list[Slice]:
        out = []
        for repo, git in repositories(self.path):
            if all(_holds(f, {"repo": repo}) for f in self.filters if _column(f) == "repo"):
                packs = f"{git}/objects/pack"
                size = sum(os.path.getsize(f"{packs}/{x}") for x in os.listdir(packs) if x.endswith(".pack")) if os.path.isdir(packs) else 0
                n = 1 + size // self.slice_bytes
                out += [Slice(repo, git, k, n) for k in range(n)]
        return out or [Slice("", "", 0, 0)]

    def read(self, part: Slice) -> Iterator[tuple]:
        if not part.n:
            return
        store = Store(part.git)
        order = store.history(self.ref)
        for seq in range(len(order) * part.k // part.n, len(order) * (part.k + 1) // part.n):
            made = store.commit(order[seq])
            parents = made["parents"]
            at = datetime.fromtimestamp(made["time"], timezone.utc)
            row = {"repo": part.repo, "commit_hash": order[seq].hex(), "committed_at": at, "is_merge": len(parents) > 1}
            if not all(_holds(f, row) for f in self.filters):
                continue
            if self.phrases and not any(map(made["message"].lower().__contains__, self.phrases)):
                continue
            head = (part.repo, row["commit_hash"], parents[0].hex() if parents else None, seq, at, made["message"], row["is_merge"])
            for old_path, new_path, before, after in self._files(store, made, _tree_of(store, parents)):
                yield *head, old_path, new_path, before, after, made["author"]

    def _files(self, store: Store, made: dict, old_tree: bytes | None) -> Iterator[tuple]:
        changed = [c for c in store.changed(old_tree, made["tree"]) if c[0].endswith(self.suffix)]
        gone, fresh = ({path: blobs[side] for path, *blobs in changed if blobs[1 - side] is None} for side in (0, 1))
        came_from = renamed(store, gone, fresh) if gone and fresh else {}
        left = set(came_from.values())
        for path, was, now in changed:
            if now is None and path in left:
                continue
            source = came_from.get(path)
            old = path if source is None else source
            was = gone[source] if source is not None else was
            yield None if was is None else old.decode(errors="replace"), None if now is None else path.decode(errors="replace"), store.text(was), store.text(now)


def _column(test: Filter) -> str:
    return _column(test.child) if isinstance(test, Not) else test.attribute[0]


def _tree_of(store: Store, parents: list[bytes]) -> bytes | None:
    """The tree of the first parent; none for a first commit, and where a shallow clone ends."""
    try:
        return store.commit(parents[0])["tree"] if parents else None
    except KeyError:
        return None


class GitChanges(DataSource):
    """``spark.read.format("git_changes").load(folder)``; options ``suffix``, ``ref``, ``sliceBytes`` and ``phrases`` (one a line; commits with none of them, in either case, aren't compared)."""

    @classmethod
    def name(cls) -> str:
        return "git_changes"

    def schema(self) -> str:
        return CHANGE

    def reader(self, schema) -> GitReader:
        return GitReader(self.options)


def changes(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """Changed files of all commits of the repositories below ``path``, against each commit's first parent; ``seq`` counts a repository's commits, oldest first."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitChanges)
    return spark.read.format("git_changes").options(**options).load(path)
