"""Resampling towards a target text by hashed words: external sort-count over packed bucket streams.

Every text becomes a stream of uint16 buckets, a bucket for each run of words; streams are written, a row for many documents with their offsets in it. To
count, tasks sort the streams and run-length encode them, and the runs' lengths are added up. To weigh, the written streams are read again, each
bucket's gain is gathered, and ``np.add.reduceat`` adds up the gains of each document. What goes to all tasks is one number for each bucket.

Null and empty texts have no features and weight 0, and a null ``doc_id`` is written 'null' where it is hashed. Repeated rows are counted and ranked as
rows of their own. Empty tables give no rows; an empty target leaves the gains to the smoothing. Extra columns of any name are left alone.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.ranks import in_order
from codequarry.llm.units import slices
from codequarry.sources.scratch import stage

#: ASCII letters in lower case, other ASCII characters that are not digits as spaces; bytes of other characters as they are.
_FOLD = bytes(c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Longest stretch of a text whose words are in memory at once, in bytes.
PIECE = 1 << 20
#: Features whose buckets a worker remembers.
KNOWN = 1 << 19
_STREAMS = "doc_ids array<long>, ends array<long>, n_words array<long>, stream binary"


class _Buckets(dict):
    """Bucket of a feature, found once while there is room."""

    def __init__(self, buckets: int):
        super().__init__()
        self._buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self._buckets
        if len(self) < KNOWN:
            self[feature] = bucket
        return bucket


def _stream(text: str | None, known: _Buckets, run: int) -> tuple[list[np.ndarray], int]:
    """Buckets of all features of ``text``, in parts, and its number of words."""
    folded, at, tail, parts, words = (text or "").encode().translate(_FOLD), 0, [], [], 0
    while at < len(folded):
        end = len(folded) if len(folded) - at <= PIECE else folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        found = folded[at:end].split()
        words += len(found)
        # Runs that began before this stretch are found with it, from the words that are left of it.
        row = tail + found
        for n in range(1, run + 1):
            begin = max(0, len(tail) - n + 1)
            features = row[begin:] if n == 1 else [b" ".join(row[k : k + n]) for k in range(begin, len(row) - n + 1)]
            parts.append(np.fromiter(map(known.__getitem__, features), "<u2", len(features)))
        tail = row[len(row) - run + 1 :] if run > 1 else []
        at = end
    return parts, words


def streams(docs: DataFrame, buckets: int = 10000, run: int = 1) -> DataFrame:
    """Written streams of ``docs``: for each slice of documents their ids, the ends of their streams, their numbers of words, and the packed buckets."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are packed in 16 bits")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Buckets(buckets)
        for batch in batches:
            at = 0
            for texts in slices(batch.column("text")):
                made = [_stream(text.as_py(), known, run) for text in texts]
                ends = np.cumsum([sum(map(len, parts)) for parts, _ in made])
                stream = np.concatenate([np.zeros(0, "<u2"), *(p for parts, _ in made for p in parts)])
                ids = batch.column("doc_id").slice(at, len(texts)).to_pylist()
                at += len(texts)
                yield pa.RecordBatch.from_pylist([{"doc_ids": ids, "ends": ends.tolist(), "n_words": [n for _, n in made], "stream": stream.tobytes()}], schema)

    schema = pa.schema([("doc_ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("stream", pa.binary())])
    return stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pack, _STREAMS), "bucket-streams")


def counts(written: DataFrame, buckets: int = 10000) -> np.ndarray:
    """Features in each bucket: streams are sorted and run-length encoded, and each task's runs are merged before they are shuffled."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for stream in batch.column("stream"):
                ordered = np.sort(np.frombuffer(stream.as_buffer(), "<u2"), kind="stable")
                starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
                total[ordered[starts]] += np.diff(np.append(starts, len(ordered)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    summed = written.select("stream").mapInArrow(runs, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    # At most one row for each bucket.
    for row in summed.collect():
        out[row.bucket] = row.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share in the target to its share in the corpus, both smoothed by one; rounded down."""
    b, s_all, t_all = len(own), float(own.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + b) / ((float(s) + 1) * (t_all + b)))) for s, t in zip(own, target, strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel variable that the seed and ``doc_id`` decide, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(written: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` for each document of the streams."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ends = batch.column("ends")[row].values.to_numpy()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                gained = gain[np.frombuffer(batch.column("stream")[row].as_buffer(), "<u2")]
                weight, some = np.zeros(len(ends), np.int64), np.flatnonzero(ends > starts)
                # Empty documents between two others don't change where either begins.
                if len(some):
                    weight[some] = np.add.reduceat(gained, starts[some])
                ids = batch.column("doc_ids")[row].values
                score = weight + np.fromiter((noise(i, seed) for i in ids.to_pylist()), np.int64, len(ids))
                yield pa.RecordBatch.from_arrays([ids, batch.column("n_words")[row].values, pa.array(ends - starts), pa.array(weight), pa.array(score)], ["doc_id", "n_words", "n_features", "weight", "score"])

    return written.mapInArrow(gather, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, buckets: int = 10000, run: int = 1, seed: int = 2024) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of every document; ``rank`` is null where it isn't drawn.

    Of the documents with at least ``min_words`` words the given percentage, rounded down, is drawn: the highest scores, ties to the smaller ``doc_id``
    (null last), so without replacement. ``target`` has a column ``text`` and is held like the corpus.
    """
    own = streams(docs, buckets, run)
    wanted = streams(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, run)
    scored = stage(weights(own, gains(counts(own, buckets), counts(wanted, buckets)), seed).withColumn("row", F.monotonically_increasing_id()), "resampling-weights")
    able = scored.filter(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    ranked = in_order(able, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row"), label="by-score")
    rank = F.when(F.col("place") < drawn, F.col("place") + 1)
    return ranked.withColumn("rank", rank).unionByName(scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")), allowMissingColumns=True).select(
        "doc_id", "n_words", "n_features", "weight", "score", "rank"
    )
