"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every fingerprint emits all variants within half the radius; two fingerprints within the radius share one.
The variants are dealt out in two steps, so that the shuffle carries no variant as a row of its own: a row goes to
each value that the variants have in the key bits (37 rows for eight bits), and the receiving task
expands the remaining bits, sorts the variants and links the fingerprints that collide. The
number of key bits grows with the number of distinct fingerprints, so a task's memory doesn't; a bucket
that is still too large is split by further bits. Links of a task are reduced to a forest
before they leave it, and components come from randomised contraction.

``one_of_each`` finds near copies by Jaccard similarity with the same ball hashing over several shorter fingerprints: see ``near_copies``.

Null texts and texts without words have fingerprint zero and are linked like any other. Rows with equal ``doc_id`` are kept; a
null ``doc_id`` is a document too (a component of only such has a null id). Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.components import components
from codequarry.llm.rows import KEY, join_skewed, keyed, may_be_among, row_key, unkeyed
from codequarry.sources.scratch import release, stage

BITS = 64
#: Bytes of text whose words are in memory at once.
PIECE = 1 << 20
#: Variants that a task sorts at once.
SORTED = 1 << 21
_SPACE = re.compile(rb"[ \t\n\v\f\r]")


def fingerprint(text: bytes, words: int = 4) -> int:
    """Bit i is set if it is set in over half the XXH64 (seed 42) of the shingles, repeats included."""
    import xxhash

    total, n, carry, at, few = np.zeros(BITS, np.int64), 0, [], 0, True
    while at < len(text):
        cut = _SPACE.search(text, min(at + PIECE, len(text)))
        end = cut.start() if cut else len(text)
        got = carry + text[at:end].lower().split()
        at = end + 1
        few = few and len(got) < words
        if len(got) >= words:
            joined = b" ".join(got)
            width = np.fromiter(map(len, got), np.int64, len(got))
            start = np.cumsum(width + 1) - width - 1
            end_of = start + width
            spans = map(slice, start[: len(got) - words + 1].tolist(), end_of[words - 1 :].tolist())
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(42)), "<u8", len(got) - words + 1)
            total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(hashes)
        carry = got[len(got) - words + 1 :] if len(got) >= words else got
    if few:
        return xxhash.xxh64_intdigest(b" ".join(carry), 42) if carry else 0
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's bits as a long) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py() or b"", words) for x in batch.column("text").cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _flips(positions: list[int], most: int) -> list[np.ndarray]:
    """Masks with 0, 1 .. ``most`` of the bits at ``positions``."""
    out = [np.zeros(1, np.uint64)]
    for _ in range(most):
        singles = [np.uint64(1) << np.uint64(p) for p in positions]
        # each mask is extended by higher bits only, so none appears twice
        out.append(np.array([m | s for m in out[-1] for s in singles if s > m], np.uint64))
    return out


def colliding(fps: np.ndarray, left: np.ndarray, positions: list[int]) -> np.ndarray:
    """Pairs of fingerprints with a common variant, enough of them to connect all that collide.

    ``left``: flips that each fingerprint may still spend on the bits at ``positions``, the only ones in which variants here differ.
    """
    sizes = np.cumsum([math.comb(len(positions), k) for k in range(int(left.max(initial=0)) + 1)])
    if len(fps) < 2:
        return np.zeros((0, 2), np.uint64)
    if sizes[left].sum() > SORTED and len(positions) > 8:
        found, taken, rest = [], positions[:4], positions[4:]
        own = sum(((fps >> np.uint64(p)) & np.uint64(1)) << np.uint64(k) for k, p in enumerate(taken))
        for value in range(16):
            spent = np.bitwise_count(own ^ np.uint64(value)).astype(np.int64)
            some = spent <= left
            found.append(colliding(fps[some], left[some] - spent[some], rest))
        return np.unique(np.concatenate(found), axis=0)
    mask = np.uint64(sum(1 << p for p in positions))
    masks = _flips(positions, int(left.max()))
    variants, owners = [], []
    for k in range(int(left.max()) + 1):
        flips = np.concatenate(masks[: k + 1])
        own = np.flatnonzero(left == k)
        variants.append(((fps[own] & mask)[:, None] ^ flips).ravel())
        owners.append(np.repeat(own, len(flips)))
    variants, owners = np.concatenate(variants), np.concatenate(owners)
    order = np.argsort(variants)
    same = np.flatnonzero(variants[order[1:]] == variants[order[:-1]])
    pairs = np.sort(np.stack([owners[order[same]], owners[order[same + 1]]], axis=1), axis=1)
    return fps[np.unique(pairs, axis=0)] if len(pairs) else np.zeros((0, 2), np.uint64)


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        path = []
        while (y := self.up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            self.up[p] = x
        return x

    def link(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def edges(self) -> pa.RecordBatch:
        nodes = [x for x in self.up if self.find(x) != x]
        columns = [np.array(nodes, np.int64), np.array([self.find(x) for x in nodes], np.int64)]
        self.up = {}
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b"])


def links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """Edges ``a``, ``b`` between fingerprints (``fp`` of ``nodes``, distinct) that connect all within ``radius`` bits."""
    half = radius // 2
    if radius % 2:
        raise ValueError("the radius is even: both sides spend half of it")
    ball = sum(math.comb(BITS, k) for k in range(half + 1))
    key_bits = min(24, max(6, math.ceil(math.log2(max(1, nodes.count()) * ball / SORTED + 1))))
    low = (1 << key_bits) - 1
    moves = [int(m) for masks in _flips(list(range(key_bits)), half) for m in masks]
    keyed = nodes.select("fp", F.explode(F.array(*map(F.lit, moves))).alias("m")).select(F.col("fp").bitwiseAND(low).bitwiseXOR(F.col("m")).cast("int").alias("key"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kept, key = _Forest(), [], None

        def solve() -> None:
            fps = np.concatenate(kept).view(np.uint64)
            left = half - np.bitwise_count((fps & np.uint64(low)) ^ np.uint64(key)).astype(np.int64)
            pairs = colliding(fps, left, list(range(key_bits, BITS)))
            pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius]
            for x, y in pairs.view(np.int64).tolist():
                forest.link(x, y)

        for batch in batches:
            keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
            for some in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1):
                if len(some) and keys[some[0]] != key:
                    if kept:
                        solve()
                    kept, key = [], int(keys[some[0]])
                kept.append(fps[some])
            if len(forest.up) > 1_000_000:
                yield forest.edges()
        if kept:
            solve()
        yield forest.edges()

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id``, the smallest ``doc_id`` reachable over links, for every row."""
    prints = stage(fingerprints(docs, words), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    classes = stage(_classes(nodes, links(nodes.select("fp"), radius)), "classes")
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = join_skewed(classes.select("fp", "root"), least, "root", classes.groupBy("root").agg(F.count("*").alias("n")), nodes.count()).select("fp", "component_id")
    found = join_skewed(prints, of_print, "fp", nodes.select("fp", "n"), prints.count())
    return found.select("doc_id", "fp", "component_id")


def _classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with ``root``, equal for nodes that ``edges`` connect."""
    root = components(edges)
    return nodes.join(root.withColumnRenamed("node", "fp"), "fp", "left").select(*nodes.columns, F.coalesce("root", "fp").alias("root"))


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component over near copies, pairs whose sets of shingles have a Jaccard similarity of ``similarity`` or more.

    The row with the least ``doc_id`` stays, of several such the one with the least key of its text; a null id comes last.
    """
    from codequarry.llm import near_copies

    text = F.col("text").cast("string")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("fp"), row_key().alias(KEY))
    rows = stage(named.groupBy("fp", KEY).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "rows")
    nodes = stage(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", KEY)).alias("first")), "distinct-texts")
    first = _classes(nodes, near_copies.links(named.select("fp", "text"), words, similarity)).groupBy("root").agg(F.min("first").alias("first"))
    stays = stage(first.select(f"first.{KEY}"), "stays")
    goes = stage(rows.join(stays, KEY, "left_anti").select(KEY), "goes")
    # What is surely no copy stays where it is.
    asked = keyed(docs).withColumn("asked", may_be_among(goes, KEY))
    left = asked.filter("not asked").drop("asked").unionByName(asked.filter("asked").drop("asked").join(goes, KEY, "left_anti"))
    twice = stage(rows.filter("n > 1").join(stays, KEY, "left_semi").select(KEY), "twice")
    if not twice.isEmpty():  # repeated rows: equal in id and text, so equal in key
        left = left.join(twice, KEY, "left_anti").union(left.join(twice, KEY, "left_semi").groupBy(KEY).agg(F.any_value("row").alias("row")))
    release(rows, nodes, stays)
    return unkeyed(left, docs.columns)
