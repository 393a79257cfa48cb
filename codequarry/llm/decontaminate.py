"""Benchmark decontamination by pigeonhole edit matching.

A test item of n words may be met with up to ``budget(n)`` word edits. It is split into one piece more than
that, so at least one piece stays whole in any such match. Exact hits of the pieces are found for many texts at a time by
rolling hashes of word numbers; each hit gives a window of the text, and Myers' bit-parallel distance, over words, verifies it.

Words are runs of letters and digits, in lower case. The index of pieces is broadcast, so its size is bounded: a benchmark
of more than ``slice_words`` words is taken in slices of about so many, one pass over the documents for each; only an item that is longer by itself makes a larger one. Items with the same words are
searched once and reported under each ``item_id``. Null texts and texts or items without words match nothing. Repeated rows are
searched and reported each. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.rows import KEY, keyed, row_key, unkeyed
from codequarry.sources.scratch import stage

WORD = re.compile(r"[^\W_]+")
#: Share of an item's words that may be edited.
EDITS = 0.2
#: Words of text that are searched at once.
BLOCK = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def budget(n: int) -> int:
    return int(EDITS * n)


def pieces(n: int) -> list[tuple[int, int]]:
    """First word and end of each of ``budget(n) + 1`` pieces of nearly equal length."""
    k = budget(n) + 1
    cuts = [n * j // k for j in range(k + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def myers(item: list[int], text: list[int], most: int) -> tuple[int, int] | None:
    """Least distance, at most ``most``, of ``item`` to any part of ``text``, and where the first such part ends."""
    m = len(item)
    masks: dict[int, int] = {}
    for k, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << k
    every, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = every, 0, m, None
    for at, word in enumerate(text, 1):
        eq = masks.get(word, 0)
        zero = (((eq & plus) + plus) ^ plus | eq | minus) & every
        grow, fall = (minus | ~(zero | plus)) & every, plus & zero
        score += bool(grow & top) - bool(fall & top)
        grow, fall = grow << 1 & every, fall << 1 & every
        plus, minus = (fall | ~(zero | grow)) & every, grow & zero
        if score <= most and (best is None or score < best[0]):
            best = (score, at)
    return best


def _rolling(numbers: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(max(0, len(numbers) - length + 1), np.uint64)
    for k in range(length):
        out = out * _BASE + numbers[k : k + len(out)]
    return out


@dataclass
class Index:
    """Pieces of items whose words have numbers; number 0 is any other word."""

    vocabulary: dict[str, int]
    items: list[list[int]]
    ids: list[list[int]]
    hashes: dict[int, tuple[np.ndarray, np.ndarray]]  # by length of the piece: sorted hashes, and which piece each is
    owners: np.ndarray  # item and first word of each piece

    @staticmethod
    def build(rows: list[tuple[int, str]]) -> Index:
        vocabulary: dict[str, int] = {}
        of_words: dict[tuple[int, ...], list[int]] = {}
        for item_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
            words = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in WORD.findall((text or "").lower()))
            if words:
                of_words.setdefault(words, []).append(item_id)
        items, owners, by_length = [list(w) for w in of_words], [], {}
        for k, item in enumerate(items):
            for a, b in pieces(len(item)):
                by_length.setdefault(b - a, []).append((_rolling(np.array(item[a:b], np.uint64), b - a)[0], len(owners)))
                owners.append((k, a))
        hashes = {}
        for length, found in by_length.items():
            found.sort()
            hashes[length] = (np.array([h for h, _ in found], np.uint64), np.array([p for _, p in found], np.int64))
        return Index(vocabulary, items, list(of_words.values()), hashes, np.array(owners, np.int64).reshape(-1, 2))

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and piece of every exact hit."""
        places, found = [], []
        for length, (keys, piece) in self.hashes.items():
            rolled = _rolling(numbers, length)
            low = np.searchsorted(keys, rolled)
            at = np.flatnonzero((low < len(keys)) & (keys[np.minimum(low, len(keys) - 1)] == rolled) & (numbers[: len(rolled)] > 0))
            count = np.searchsorted(keys, rolled[at], side="right") - low[at]
            places.append(np.repeat(at, count))
            found.append(piece[np.repeat(low[at] - (np.cumsum(count) - count), count) + np.arange(count.sum())])
        return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64),) * 2

    def matches(self, texts: list[list[str]]) -> Iterator[tuple[int, int, int, int]]:
        """Text, item, distance and last word of the best match of each item that occurs in a text."""
        get = self.vocabulary.get
        bounds = np.cumsum([0, *(len(t) for t in texts)])
        numbers = np.fromiter((get(w, 0) for t in texts for w in t), np.uint64, int(bounds[-1]))
        places, found = self.hits(numbers)
        item, first = self.owners[found].T
        owner = np.searchsorted(bounds, places, side="right") - 1
        # A window has a spare more words at its end than an occurrence needs: hits whose diagonal is at most a spare beyond
        # the one that was searched are in its window. Diagonals are compared, as ends are cut at the end of the text.
        diagonal = places - first
        order = np.lexsort((diagonal, item, owner))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        searched = (-1, -1, 0)
        for text, it, start in zip(owner[order].tolist(), item[order].tolist(), diagonal[order].tolist(), strict=True):
            words = self.items[it]
            spare = budget(len(words))
            begin, end = max(int(bounds[text]), start - spare), min(int(bounds[text + 1]), start + len(words) + 2 * spare)
            if searched[:2] == (text, it) and start <= searched[2] + spare:
                continue
            searched = (text, it, start)
            got = myers(words, numbers[begin:end].tolist(), spare)
            if got and ((text, it) not in best or got[0] < best[text, it][0]):
                best[text, it] = (got[0], begin + got[1] - int(bounds[text]) - 1)
        for (text, it), (distance, last) in best.items():
            yield text, it, distance, last


def _search(docs: DataFrame, index: Index) -> DataFrame:
    broadcast = docs.sparkSession.sparkContext.broadcast(index)
    names = ["doc_id", "item_id", "distance", "last_word", "row_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = broadcast.value
        for batch in batches:
            ids, keys, rows, held, first, size = batch.column("doc_id").to_pylist(), batch.column("row_key").to_pylist(), [], [], 0, 0
            for k, text in enumerate(batch.column("text"), 1):
                held.append(WORD.findall((text.as_py() or "").lower()))
                size += len(held[-1])
                if size > BLOCK or k == len(ids):
                    rows += [(ids[first + t], item_id, d, last, keys[first + t]) for t, it, d, last in index.matches(held) for item_id in index.ids[it]]
                    held, first, size = [], k, 0
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names)

    return docs.mapInArrow(run, "doc_id long, item_id long, distance int, last_word int, row_key string")


def contaminated(docs: DataFrame, benchmark: DataFrame, slice_words: int = 5_000_000) -> DataFrame:
    """A row (``doc_id``, ``item_id``, ``distance`` in words, ``last_word``, ``row_key`` of the document) for each item that occurs in a document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key().alias("row_key"))
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    words = items.agg(F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")))).first()[0] or 0
    count = -(-max(1, words) // slice_words)
    found = None
    for k in range(count):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k) if count > 1 else items
        index = Index.build([(r.item_id, r.text) for r in part.collect()])
        here = _search(rows, index)
        found = here if found is None else found.union(here)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those in which a test item occurs."""
    keys = stage(contaminated(docs, benchmark).select(F.col("row_key").alias(KEY)).distinct(), "contaminated")
    return unkeyed(keyed(docs).join(keys, KEY, "left_anti"), docs.columns)
