"""The derived commits as bare git repositories, so that the git source has something to read: packs with deltas of trees, one for each repository and task."""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.plans import corpus
from codequarry.sources.scratch import new_path

#: Who has written the commits.
WHO = "Some One <some@one>"


#: So many deltas follow each other before an object is whole again.
CHAIN = 31
# Kinds of objects in packs.
KINDS = {"commit": 1, "tree": 2, "blob": 3}
#: Shorter objects, mostly names of others, are stored as they are.
PLAIN = 128


def _length(n: int) -> bytes:
    """A size as deltas have it: seven bits a byte, the lowest first."""
    out = []
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _copy(at: int, n: int) -> bytes:
    """Instructions that copy ``n`` bytes of the base from ``at`` on."""
    if at + n < 1 << 16:
        return struct.pack("<BHH", 0b10110011, at, n) if n else b""
    out = b""
    while n:
        some = min(n, 0xFFFF)
        parts = [(1 << k, at >> 8 * k & 255) for k in range(4)] + [(16 << k, some >> 8 * k & 255) for k in range(2)]
        out += bytes([128 | sum(bit for bit, byte in parts if byte), *(byte for _, byte in parts if byte)])
        at, n = at + some, n - some
    return out


def _shared(one: bytes, two: bytes) -> int:
    """How many bytes both begin with."""
    low, high = 0, min(len(one), len(two))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if one[:middle] == two[:middle] else (low, middle - 1)
    return low


def delta(base: bytes, content: bytes, known: tuple[int, int] | None = None) -> bytes:
    """Git's instructions that make ``content`` of ``base``: what both begin and end with is copied, so many bytes as are ``known`` or as are found to be equal."""
    head, tail = known or (_shared(base, content), 0)
    if known is None:
        tail = _shared(base[head:][::-1], content[head:][::-1])
    middle = content[head : len(content) - tail]
    put = b"".join(bytes([len(x)]) + x for x in (middle[k : k + 127] for k in range(0, len(middle), 127)))
    return _length(len(base)) + _length(len(content)) + _copy(0, head) + put + _copy(len(base) - tail, tail)


def _deflated(content: bytes) -> bytes:
    """The content as zlib writes it; small windows are set up sooner."""
    if len(content) < PLAIN:
        return b"\x78\x01\x01" + struct.pack("<HH", len(content), 0xFFFF ^ len(content)) + content + zlib.adler32(content).to_bytes(4, "big")
    packer = zlib.compressobj(1, zlib.DEFLATED, 12, 5)
    return packer.compress(content) + packer.flush()


class _Pack:
    """Objects of one task and repository; blobs and trees that come again are written once."""

    def __init__(self, git: str):
        os.makedirs(f"{git}/objects/pack", exist_ok=True)
        os.makedirs(f"{git}/refs/heads", exist_ok=True)
        self.git, self.fresh, self.places = git, f"{git}/objects/pack/unfinished-{uuid.uuid4().hex}", {}
        #: The last object of a series, and how many deltas it takes.
        self._last: dict[bytes, tuple[bytes, bytes, int]] = {}
        self._file = open(self.fresh, "w+b")  # noqa: SIM115
        self._end = self._file.write(b"PACK" + (2).to_bytes(4, "big") + bytes(4))

    def add(self, kind: str, content: bytes, series: bytes | None = None, known: tuple[int, int] | None = None) -> bytes:
        """The object's name. Of a ``series``, whose objects differ little from the one before, most are written as deltas; ``known`` bytes at its ends are those of the one before."""
        name = hashlib.sha1(b"%s %d\0%s" % (kind.encode(), len(content), content)).digest()
        if name not in self.places:
            base, before, chain = self._last.get(series, (None, b"", CHAIN))
            number, written, distance = KINDS[kind], content, b""
            if series is not None and chain < CHAIN:
                number, written, chain = 6, delta(before, content, known), chain + 1
                far = self._end - self.places[base][0]
                distance = bytes([far & 127])
                while far := far >> 7:
                    far -= 1
                    distance = bytes([far & 127 | 128]) + distance
            else:
                chain = 0
            size, head = len(written) >> 4, [number << 4 | len(written) & 15]
            while size:
                head[-1] |= 128
                head.append(size & 127)
                size >>= 7
            entry = bytes(head) + distance + _deflated(written)
            self.places[name] = self._end, zlib.crc32(entry), chain
            self._file.write(entry)
            self._end += len(entry)
        if series is not None:
            self._last[series] = name, content, self.places[name][2]
        return name

    def close(self, ref: str, tip: bytes) -> None:
        """Write the number of objects, the sum and the index, then the branch; a task that is run again writes the same under the same names."""
        self._file.seek(8)
        self._file.write(len(self.places).to_bytes(4, "big"))
        self._file.seek(0)
        total = hashlib.sha1()
        while part := self._file.read(1 << 20):
            total.update(part)
        self._file.write(total.digest())
        self._file.close()
        names = sorted(self.places)
        counts, fan = [0] * 256, b""
        for name in names:
            counts[name[0]] += 1
        for k in range(256):
            fan += sum(counts[: k + 1]).to_bytes(4, "big")
        long = [self.places[n][0] for n in names if self.places[n][0] >= 1 << 31]
        far = {at: (1 << 31 | k).to_bytes(4, "big") for k, at in enumerate(long)}
        index = b"\xfftOc\x00\x00\x00\x02" + fan + b"".join(names) + b"".join(self.places[n][1].to_bytes(4, "big") for n in names)
        index += b"".join(far.get(at) or at.to_bytes(4, "big") for at in (self.places[n][0] for n in names)) + b"".join(at.to_bytes(8, "big") for at in long) + total.digest()
        base = f"{self.git}/objects/pack/pack-{total.hexdigest()}"
        os.replace(self.fresh, f"{base}.pack")
        for path, content in ((f"{base}.idx", index + hashlib.sha1(index).digest()), (f"{self.git}/{ref}", tip.hex().encode()), (f"{self.git}/HEAD", b"ref: refs/heads/main")):
            with open(fresh := f"{path}.{uuid.uuid4().hex}.unfinished", "wb") as file:
                file.write(content)
            os.replace(fresh, path)


class _Files:
    """The files of a repository in folders one deep; of a change only the folder that it is in is written anew."""

    def __init__(self, pack: _Pack):
        self._pack = pack
        #: Names, in order, and entries of each folder; folders and their trees.
        self._folders: dict[bytes, tuple[list[bytes], list[bytes]]] = {}
        self._trees: dict[bytes, bytes] = {}

    def put(self, path: str, blob: bytes) -> bytes:
        """The tree of all files with this one as ``blob``."""
        folder, name = path.encode().split(b"/")
        names, entries = self._folders.setdefault(folder, ([], []))
        k, entry = bisect_left(names, name), b"100644 " + name + b"\0" + blob
        known = None
        if k < len(names) and names[k] == name:
            entries[k] = entry
            content = b"".join(entries)
            # Only the name of one object is another.
            tail = sum(map(len, entries[k + 1 :]))
            known = len(content) - tail - 20, tail
        else:
            names.insert(k, name)
            entries.insert(k, entry)
            content = b"".join(entries)
        self._trees[folder] = self._pack.add("tree", content, folder, known)
        return self._pack.add("tree", b"".join(b"40000 " + f + b"\0" + t for f, t in sorted(self._trees.items())))


def write_repositories(changes: DataFrame, root: str) -> None:
    """A branch for each repository and task: of every change a commit that puts the old file there, and one with the new file; merges have the older commit as second parent."""

    def commit(pack: _Pack, tree: bytes, parents: list[bytes], time: int, message: str) -> bytes:
        lines = [f"tree {tree.hex()}", *(f"parent {p.hex()}" for p in parents), f"author {WHO} {time} +0000", f"committer {WHO} {time} +0000"]
        return pack.add("commit", ("\n".join(lines) + f"\n\n{message}\n").encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ref = f"refs/heads/part-{TaskContext.get().partitionId()}"
        pack, repo, files, tip, older, n = None, None, None, None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["repo"] != repo:
                    if pack:
                        pack.close(ref, tip)
                    repo, tip, older = row["repo"], None, None
                    pack = _Pack(f"{root}/{repo}.git")
                    files = _Files(pack)
                time = int(row["committed_at"].timestamp())
                tree = files.put(row["old_path"], pack.add("blob", row["before"].encode()))
                base = commit(pack, tree, [tip] if tip else [], time, f"Before change {row['seq']}")
                tree = files.put(row["new_path"], pack.add("blob", row["after"].encode()))
                # Without an older commit a commit of its own is the other side.
                other = older or commit(pack, pack.add("tree", b""), [], time, "elsewhere") if row["is_merge"] else None
                older, tip = base, commit(pack, tree, [base, other] if other else [base], time, f"{row['message']}\n\nchange {row['seq']}")
                n += 1
        if pack:
            pack.close(ref, tip)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows = changes.select("repo", "seq", "committed_at", "message", "is_merge", "old_path", "new_path", "before", "after")
    # Repositories of any size are dealt out in parts.
    dealt = rows.repartition("repo", F.pmod(F.xxhash64("seq"), F.lit(16))).sortWithinPartitions("repo", "seq")
    dealt.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def repositories(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the repositories; it has to be one that every executor mounts."""
    root = new_path(spark, "repositories").removeprefix("file://").removeprefix("file:")
    if "://" in root:
        raise ValueError("git repositories need a spark.checkpoint.dir that is a mounted folder")
    write_repositories(corpus.modified_files(spark, sf_dir), root)
    return root
