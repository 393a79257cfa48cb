"""Edit-aware token counts: a segment tree of pre-tokens is kept for each document, and an edit re-encodes only a region of it.

The leaves of a tree are blocks of pre-tokens (their lengths in characters and their tokens); an inner node has the sums of
the two below it. ``TreeTable`` keeps trees with their texts as Parquet, a version for each batch of edits, which has only the documents that
the batch changed. A batch reads the newest tree of each document and encodes nothing but the regions that its edits touch: from a boundary a little before an edit
the new text is pre-tokenised again until a boundary behind it falls on an old one, and the sums on the ways from those leaves to the root
are updated. From a common boundary on, pre-tokens depend on nothing before it.

Edits of a document are places in its newest text. An edit that overlaps one before it in order of places, or lies outside the text, is left
out; insertions at one place are made in order of their texts. A null text is an empty one; without edits the counts stay. Rows with one ``doc_id`` and text are one document, for which
edits count once; rows are else independent of each other; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codequarry.llm.byte_bpe import _codec
from codequarry.llm.rows import row_key
from codequarry.sources.scratch import write_once

#: Pre-tokens of a leaf.
LEAF = 64
#: Characters that a match of the pre-tokeniser's pattern looks ahead at most.
AHEAD = 3
#: Pre-tokens of at most so many characters whose counts a worker remembers, the first that come.
CACHE, CACHE_CHARS = 400_000, 64
_COUNTS: dict[str, dict[str, int]] = {}

Edit = tuple[int, int, str]


class PreTokens:
    """Pre-tokens of a text with their numbers of tokens."""

    def __init__(self, path: str, pattern: str):
        self.encoding, _, self.split = _codec(path, pattern)
        self.known = _COUNTS.setdefault(path, {})
        self.encoded = 0

    def count(self, token: str) -> int:
        n = self.known.get(token)
        if n is None:
            n = len(self.encoding.encode_ordinary(token))
            if len(self.known) < CACHE and len(token) <= CACHE_CHARS:
                self.known[token] = n
        return n

    def counts(self, tokens: list[str]) -> list[int]:
        self.encoded += len(tokens)
        get = self.known.get
        return [n if (n := get(t)) is not None else self.count(t) for t in tokens]


class Tree:
    """Sums of characters and tokens over blocks of pre-tokens."""

    def __init__(self, lengths: list[int], counts: list[int], sizes: list[int] | None = None):
        """``sizes``: pre-tokens of each block, by default ``LEAF``."""
        ends = np.cumsum(sizes).tolist() if sizes is not None else [*range(LEAF, len(lengths), LEAF), len(lengths)]
        self.blocks = [(lengths[a:b], counts[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)] or [([], [])]
        self._build()

    def _build(self) -> None:
        self.size = 1 << max(0, (len(self.blocks) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, (lengths, counts) in enumerate(self.blocks):
            self.chars[self.size + k], self.tokens[self.size + k] = sum(lengths), sum(counts)
        for k in range(self.size - 1, 0, -1):
            self._add_up(k)

    def _add_up(self, node: int) -> None:
        for sums in (self.chars, self.tokens):
            sums[node] = sums[2 * node] + sums[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return sum(len(b[0]) for b in self.blocks)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        flat = [np.array([x for b in self.blocks for x in b[k]], "<u4").tobytes() for k in (0, 1)]
        return flat[0], flat[1], np.array([len(b[0]) for b in self.blocks], "<u4").tobytes()

    @staticmethod
    def unpacked(lengths: bytes, counts: bytes, sizes: bytes) -> Tree:
        return Tree(*(np.frombuffer(x, "<u4").tolist() for x in (lengths, counts, sizes)))

    def find(self, place: int) -> tuple[int, int, int]:
        """Block and number in it of the pre-token that has the character at ``place`` (the end: one past the last), and where it begins."""
        node, at = 1, 0
        while node < self.size:
            node *= 2
            if place >= at + self.chars[node] and self.chars[node + 1]:
                at += self.chars[node]
                node += 1
        block = node - self.size
        for k, n in enumerate(self.blocks[block][0]):
            if place < at + n:
                return block, k, at
            at += n
        return block, len(self.blocks[block][0]), at

    def before(self, block: int, k: int, at: int) -> tuple[int, int, int]:
        """The pre-token before."""
        while k == 0 and block > 0:
            block -= 1
            k = len(self.blocks[block][0])
        return (block, k - 1, at - self.blocks[block][0][k - 1]) if k else (block, 0, at)

    def splice(self, first: tuple[int, int], last: tuple[int, int], lengths: list[int], counts: list[int]) -> None:
        """Put new pre-tokens in place of those from ``first`` to before ``last``; blocks keep their places."""
        (a, i), (b, j) = first, last
        self.blocks[a] = (self.blocks[a][0][:i] + lengths + self.blocks[b][0][j:], self.blocks[a][1][:i] + counts + self.blocks[b][1][j:])
        for k in range(a + 1, b + 1):
            self.blocks[k] = ([], [])
        for k in range(a, b + 1):
            node = self.size + k
            self.chars[node], self.tokens[node] = sum(self.blocks[k][0]), sum(self.blocks[k][1])
        low, high = (self.size + a) // 2, (self.size + b) // 2
        while low:
            for node in range(low, high + 1):
                self._add_up(node)
            low, high = low // 2, high // 2

    def balance(self) -> None:
        """Split blocks that have grown, once all splices are made."""
        if max(len(b[0]) for b in self.blocks) > 4 * LEAF:
            cut = [[(x[k : k + LEAF], y[k : k + LEAF]) for k in range(0, len(x), LEAF)] for x, y in self.blocks]
            self.blocks = [part for parts in cut for part in parts] or [([], [])]
            self._build()


def tree_of(text: str, pre: PreTokens) -> Tree:
    tokens = pre.split.findall(text)
    return Tree(list(map(len, tokens)), pre.counts(tokens))


def usable(edits: list[Edit], length: int) -> list[Edit]:
    """Edits in order that lie in the text and don't overlap the one before."""
    kept, free = [], 0
    for start, end, new in sorted(edits):
        if free <= start <= end <= length:
            kept.append((start, end, new))
            free = end
    return kept


def apply_edits(tree: Tree, text: str, edits: list[Edit], pre: PreTokens) -> str:
    """The text after ``usable`` edits; the tree is brought in step with it. Time grows with the text once and with each edit's region."""
    parts, at = [], 0
    for start, end, new in edits:
        parts += [text[at:start], new]
        at = end
    changed = "".join([*parts, text[at:]])
    regions, shift, k = [], 0, 0
    while k < len(edits):
        block, i, begin = tree.find(edits[k][0])
        while begin > max(0, edits[k][0] - AHEAD):  # back to a boundary that the edit can't move
            block, i, begin = tree.before(block, i, begin)
        first, here = (block, i), begin + shift
        tokens, stop = [], None
        shift += len(edits[k][2]) - (edits[k][1] - edits[k][0])
        k += 1
        for match in pre.split.finditer(changed, here):
            old = match.start() - shift
            while k < len(edits) and old + AHEAD + (match.end() - match.start()) >= edits[k][0]:  # the next edit is in this region too
                shift += len(edits[k][2]) - (edits[k][1] - edits[k][0])
                k += 1
                old = match.start() - shift
            if old >= edits[k - 1][1] and match.start() > here:
                b, j, start = tree.find(old)
                if start == old:
                    stop = (b, j)
                    break
            tokens.append(match.group())
        if stop is None:
            stop = (len(tree.blocks) - 1, len(tree.blocks[-1][0]))
            k = len(edits)
        regions.append((first, stop, list(map(len, tokens)), pre.counts(tokens)))
    for region in reversed(regions):
        tree.splice(*region)
    tree.balance()
    return changed


KEPT = "key binary, doc_id long, text string, lengths binary, counts binary, sizes binary, n_tokens long, n_edits long, n_encoded long"


def _kept(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.binary(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], [f.split()[0] for f in KEPT.split(", ")])


class TreeTable:
    """Trees and texts of documents in ``root``: the first version has all of them, later ones those that a batch of edits changed.

    A batch that isn't finished leaves no complete version behind: Spark marks those that are. The next batch takes a number of its own, so what a lost run has left is
    in nobody's way. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, path: str, pattern: str):
        self.spark, self.root, self.path, self.pattern = spark, root.rstrip("/"), path, pattern

    def _numbers(self, finished: bool) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        done = lambda n: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_SUCCESS"))
        return sorted(int(n) for n in names if n.isdigit() and (not finished or done(n)))

    def versions(self) -> list[int]:
        return self._numbers(finished=True)

    def _free(self) -> int:
        """A number above all that are there, those of lost runs among them."""
        return max(self._numbers(finished=False), default=-1) + 1

    def version(self, number: int) -> DataFrame:
        return self.spark.read.schema(KEPT).parquet(f"{self.root}/{number}")

    def current(self) -> DataFrame:
        """The newest row of each document; only keys are compared, texts and trees aren't moved for it."""
        out, newer = None, None
        for number in reversed(self.versions()):
            rows = self.version(number)
            fresh = rows if newer is None else rows.join(newer, "key", "left_anti")
            out = fresh if out is None else out.union(fresh.select(*out.columns))
            newer = rows.select("key") if newer is None else newer.union(rows.select("key"))
        return out

    def build(self, docs: DataFrame) -> None:
        """Trees of every whole text."""
        path, pattern = self.path, self.pattern

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pre = PreTokens(path, pattern)
            for batch in batches:
                for at in range(0, len(batch), 256):
                    part, rows = batch.slice(at, 256), []
                    for key, doc_id, text in zip(part.column("key").to_pylist(), part.column("doc_id").to_pylist(), part.column("text"), strict=True):
                        text, pre.encoded = text.as_py() or "", 0
                        tree = tree_of(text, pre)
                        rows.append((key, doc_id, text, *tree.packed(), tree.total, 0, pre.encoded))
                    yield _kept(rows)

        rows = docs.select(row_key().alias("key"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
        if self.versions():
            raise ValueError(f"{self.root} has trees already")
        write_once(rows.mapInArrow(run, KEPT), f"{self.root}/{self._free()}")

    def edit(self, edits: Column | Callable[[str], list[Edit]], needs: Column | None = None) -> int:
        """A batch of edits, as a column of the current rows (an array of ``start``, ``end``, ``text``) or a function of their texts; returns the new version.

        ``needs``: rows that may have edits, so that others need not be looked at.
        """
        path, pattern = self.path, self.pattern
        rows = self.current() if needs is None else self.current().filter(needs)
        given, made = ("edits", None) if isinstance(edits, Column) else (None, edits)
        if given:
            rows = rows.withColumn(given, edits.cast("array<struct<start:long,end:long,text:string>>")).filter(F.size(given) > 0)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pre = PreTokens(path, pattern)
            for batch in batches:
                for at in range(0, len(batch), 256):
                    part, out = batch.slice(at, 256), []
                    for r in range(len(part)):
                        key, doc_id, text, lengths, counts, sizes = (part.column(c)[r].as_py() for c in ("key", "doc_id", "text", "lengths", "counts", "sizes"))
                        wanted = [(e["start"], e["end"], e["text"] or "") for e in part.column(given)[r].as_py()] if given else made(text)
                        if some := usable(wanted, len(text)):
                            tree, pre.encoded = Tree.unpacked(lengths, counts, sizes), 0
                            text = apply_edits(tree, text, some, pre)
                            out.append((key, doc_id, text, *tree.packed(), tree.total, len(some), pre.encoded))
                    yield _kept(out)

        number = self._free()
        write_once(rows.mapInArrow(run, KEPT), f"{self.root}/{number}")
        return number


def masked(pattern: str, word: str) -> Callable[[str], list[Edit]]:
    """Edits that put ``word`` in place of each match of a pattern."""

    def edits(text: str) -> list[Edit]:
        return [(m.start(), m.end(), word) for m in re.finditer(pattern, text)]

    return edits


def counts_over_versions(table: TreeTable) -> DataFrame:
    """A row for each document: ``doc_id``, ``n_tokens`` at first, ``n_edits``, ``n_tokens_after``, ``n_pre_tokens`` (encoded at first) and ``n_encoded_again``."""
    first = table.version(table.versions()[0]).select("key", "doc_id", "n_tokens", F.col("n_encoded").alias("n_pre_tokens"))
    later = None
    for number in table.versions()[1:]:
        rows = table.version(number).select("key", F.lit(number).alias("v"), "n_tokens", "n_edits", "n_encoded")
        later = rows if later is None else later.union(rows)
    if later is None:
        return first.select("doc_id", "n_tokens", F.lit(0).cast("long").alias("n_edits"), F.col("n_tokens").alias("n_tokens_after"), "n_pre_tokens", F.lit(0).cast("long").alias("n_encoded_again"))
    # Rows equal in id and text have equal keys and equal versions, so each version counts once.
    sums = later.distinct().groupBy("key").agg(F.max_by("n_tokens", "v").alias("after"), F.sum("n_edits").alias("n_edits"), F.sum("n_encoded").alias("again"))
    joined = first.join(sums, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.select("doc_id", "n_tokens", zero("n_edits").alias("n_edits"), F.coalesce("after", "n_tokens").alias("n_tokens_after"), "n_pre_tokens", zero("again").alias("n_encoded_again"))
