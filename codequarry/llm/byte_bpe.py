"""Byte-level BPE encoding and decoding of whole texts by overlapping chunks.

Texts are split into chunks that overlap. Every chunk is pre-tokenised on its own; where two neighbours put a pre-token
boundary at the same place, after a character that is no white space, they have resynchronised and are stitched there: from such
a place on both would go on alike, and the look-ahead of the pattern can't reach across it. The pieces
between stitches are encoded in parallel, and a document's ids are those of its pieces in order. Decoding concatenates the bytes of the ids.

This is done twice with one rule: texts of over ``CHUNK`` characters are dealt out to tasks in such chunks, and every text or piece is
stitched from chunks of ``PART`` characters inside its task, without a shuffle. A chunk that doesn't resynchronise within the overlap is joined to its
predecessor (one that is dealt out: with what follows it), so that ids are right for any text. A null text is an empty one. Rows with equal ``doc_id`` are
kept; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a chunk, and of its overlap with the next.
CHUNK, OVERLAP = 1 << 16, 1 << 10
#: The same inside a task.
PART, PART_OVERLAP = 1 << 10, 1 << 7
_WORKER: dict[tuple[str, str], tuple] = {}


def _codec(path: str, pattern: str) -> tuple:
    """Encoder and the bytes of each id, once a worker."""
    if (path, pattern) not in _WORKER:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        import regex

        _WORKER[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), table, regex.compile(pattern)
    return _WORKER[path, pattern]


def stitched(text: str, pattern, part: int = PART, overlap: int = PART_OVERLAP) -> list[str]:
    """Pieces of a text between places at which neighbouring chunks, pre-tokenised apart, have resynchronised; ``pattern`` is compiled."""
    cuts, tail, at, size = [0], set(), 0, part
    while at < len(text):
        end = at + size
        found = [at + x for x in boundaries(text[at : end + overlap], pattern, 0, size + overlap)]
        if at and (both := [x for x in found if x < at + overlap and x in tail]):
            cuts.append(both[0])
            size = part
        elif at:  # not in step: the chunk before goes on to this one's end, and the next is twice as long
            found = [cuts[-1] + x for x in boundaries(text[cuts[-1] : end + overlap], pattern, at - cuts[-1], end + overlap - cuts[-1])]
            size *= 2
        tail, at = {x for x in found if x >= end}, end
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)]


def encode_bytes(text: str, path: str, pattern: str, part: int = PART, overlap: int = PART_OVERLAP) -> bytes:
    """Ids of a text as little-endian uint32, from its stitched pieces."""
    encoding, _, compiled = _codec(path, pattern)
    return b"".join(np.array(encoding.encode_ordinary(piece), "<u4").tobytes() for piece in stitched(text, compiled, part, overlap))


def decode_bytes(ids: bytes, path: str, pattern: str) -> bytes:
    return b"".join(map(_codec(path, pattern)[1].__getitem__, np.frombuffer(ids, "<u4").tolist()))


def boundaries(body: str, pattern, low: int, high: int) -> list[int]:
    """Places from ``low`` to ``high`` at which a pre-token begins after a character that is no white space."""
    out = []
    for match in pattern.finditer(body):
        at = match.start()
        if at >= high:
            break
        if at >= low and at and not body[at - 1].isspace():
            out.append(at)
    return out


def _split(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, copy, text in zip(batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                starts = range(0, len(text), chunk)
                for k, at in enumerate(starts):
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), pa.array([copy], pa.int64()), pa.array([k], pa.int32()), pa.array([k == len(starts) - 1]), pa.array([text[at : at + chunk + overlap]], pa.string())], ["doc_id", "copy", "k", "last", "body"])

    return docs.mapInArrow(run, "doc_id long, copy long, k int, last boolean, body string")


def _pre_tokenise(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Boundaries in the overlap with the chunk before (``head``) and, from that chunk's end on, with the next (``tail``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        compiled = regex.compile(pattern)
        for batch in batches:
            heads, tails = [], []
            for body in batch.column("body").to_pylist():
                found = boundaries(body, compiled, 0, chunk + overlap)
                heads.append([x for x in found if x < overlap])
                tails.append([x - chunk for x in found if x >= chunk])
            columns = [batch.column(c) for c in ("doc_id", "copy", "k", "last", "body")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], ["doc_id", "copy", "k", "last", "body", "head", "tail"])

    return chunks.mapInArrow(run, "doc_id long, copy long, k int, last boolean, body string, head array<int>, tail array<int>")


def pieces(docs: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id``, ``copy``, ``piece`` and ``text`` of the stitched pieces of texts of more than one chunk."""
    chunks = _pre_tokenise(_split(docs, chunk, overlap).repartition("doc_id", "copy", "k"), pattern, chunk, overlap)
    order = Window.partitionBy("doc_id", "copy").orderBy("k")
    cut = F.when(F.col("k") == 0, 0).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    found = chunks.withColumn("cut", cut)
    # Once a chunk hasn't resynchronised, those after it can't be told from it: all join the last piece before.
    found = found.withColumn("cut", F.when(F.min(F.col("cut").isNotNull()).over(order), F.col("cut")))
    found = found.withColumn("next", F.lead("cut").over(order)).withColumn("piece", F.sum(F.col("cut").isNotNull().cast("int")).over(order))
    begin = F.coalesce("cut", F.lit(0))
    end = F.when(F.col("last"), F.length("body")).otherwise(chunk + F.coalesce("next", F.lit(0)))
    parts = found.select("doc_id", "copy", "piece", F.struct("k", F.substring("body", begin + 1, end - begin).alias("text")).alias("part"))
    listed = parts.groupBy("doc_id", "copy", "piece").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    return listed.select("doc_id", "copy", "piece", F.array_join("parts.text", "").alias("text"))


Finish = Callable[[list[bytes]], list[pa.Array]]


def _finished(docs: DataFrame, path: str, pattern: str, chunk: int, overlap: int, result: str, finish: Finish) -> DataFrame:
    """``doc_id`` and the columns ``result`` that ``finish`` makes of the ids of every whole text.

    Texts of one chunk are encoded and finished by one Python worker, so that a task needs no second one.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = F.length("text") > chunk
    schema = f"doc_id long, {result}"
    names = [field.split()[0] for field in schema.split(", ")]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode_bytes(t.as_py(), path, pattern) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *finish(ids)], names)

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array([encode_bytes(t.as_py(), path, pattern) for t in batch.column("text")], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("doc_id", "copy", "piece")), ids], ["doc_id", "copy", "piece", "ids"])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *finish([b"".join(x.as_py()) for x in batch.column("ids")])], names)

    numbered = rows.filter(long).select("doc_id", F.monotonically_increasing_id().alias("copy"), "text")
    parts = pieces(numbered, pattern, chunk, overlap).mapInArrow(piece, "doc_id long, copy long, piece long, ids binary")
    # A document's ids are one value in the result, so its pieces meet in one row.
    joined = parts.groupBy("doc_id", "copy").agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("parts"))
    stitched = joined.select("doc_id", F.col("parts.ids").alias("ids")).mapInArrow(last, schema)
    return rows.filter(~long).mapInArrow(whole, schema).union(stitched)


def encode(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian uint32) of every whole text."""
    return _finished(docs, path, pattern, chunk, overlap, "ids binary", lambda ids: [pa.array(ids, pa.binary())])


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded``, the concatenated bytes of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([decode_bytes(x.as_py(), path, pattern) for x in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), texts], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` (of the bytes that the ids decode to) of every whole text."""

    def finish(cells: list[bytes]) -> list[pa.Array]:
        return [
            pa.array([len(x) // 4 for x in cells], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in cells], pa.string()),
            pa.array([hashlib.sha256(decode_bytes(x, path, pattern)).hexdigest() for x in cells], pa.string()),
        ]

    return _finished(docs, path, pattern, chunk, overlap, "n_tokens long, ids_sha256 string, decoded_sha256 string", finish)
