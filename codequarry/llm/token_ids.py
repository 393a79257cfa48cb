"""Token-ID output: frequency-ranked ids in a byte-aligned variable-length code.

Files are Parquet, one folder per shard; shards, and rows within one by ``shard_start``, ascend by ``doc_id``. A row has the ids of one document as two
byte strings: ``control`` has two bits an id (bytes used less one, four ids a byte, the first in the
low bits), ``data`` has the ids' ranks, little-endian, in one to four bytes. The rank of an id is its place
by descending frequency over the whole corpus (ties: the lower id), so frequent ids take one byte.
Decoding looks the four lengths of each control byte up in a numpy table. Spark's writer commits
the shards, so a lost executor's unfinished files never count.

The strings of the tokenizer's added tokens are those tokens wherever a text has them, as the library encodes them by default.
A null text is an empty one; every document gets the end id. Rows with the same ``doc_id`` are kept, in the
order of their texts' hashes; a null ``doc_id`` comes first. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codequarry.llm.units import UnitEncoder, binary_column, slices
from codequarry.sources.scratch import new_path, release, stage, write_once

_WORKER: dict[str, UnitEncoder] = {}
#: Bytes that each of the four ids of a control byte takes.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)

#: Bytes of ids that are packed or unpacked at once.
PACKED_BYTES = 1 << 20


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """``control`` and ``data`` of a document."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    used = 1 + (ranks >= 1 << 8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = used - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < used[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of a document."""
    used = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    start = np.cumsum(used) - used
    raw = np.frombuffer(data + bytes(3), np.uint8)
    ranks = raw[start].astype(np.uint32)
    for k in range(1, int(used.max(initial=1))):
        more = np.flatnonzero(used > k)
        ranks[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _places(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes of each document, and the place of each id among the codes of all, four a control byte."""
    groups = -(-counts // 4)
    skipped = 4 * (np.cumsum(groups) - groups) - (np.cumsum(counts) - counts)
    return groups, np.arange(int(counts.sum())) + np.repeat(skipped, counts)


def pack_all(ranks: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """``pack`` of many documents at once: their ranks in a row, ``counts`` of each."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    used = (ranks >= 1 << 8).view(np.uint8) + (ranks >= 1 << 16).view(np.uint8) + (ranks >= 1 << 24).view(np.uint8)
    groups, places = _places(counts)
    codes = np.zeros(4 * int(groups.sum()), np.uint8)
    codes[places] = used
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= used[:, None]]
    ends = np.concatenate([[0], np.cumsum(used, dtype=np.int64) + np.arange(1, len(used) + 1)])[np.concatenate([[0], np.cumsum(counts)])]
    return binary_column(control, groups), binary_column(data, np.diff(ends))


def unpack_all(control: pa.Array, data: pa.Array, counts: np.ndarray) -> np.ndarray:
    """The ranks of many documents in a row."""
    used = LENGTHS[np.frombuffer(b"".join(control.to_pylist()), np.uint8)].ravel()[_places(counts)[1]]
    start = np.cumsum(used) - used
    raw = np.frombuffer(b"".join(data.to_pylist()) + bytes(3), np.uint8)
    ranks = raw[start].astype(np.uint32)
    for k in range(1, int(used.max(initial=1))):
        more = np.flatnonzero(used > k)
        ranks[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def _unit_encoder(path: str) -> UnitEncoder:
    if path not in _WORKER:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        vocab = tokenizer.get_vocab()
        width = np.zeros(max(vocab.values()) + 1, np.int64)
        width[list(vocab.values())] = [len(x) for x in vocab]

        def encode(units: list[str]) -> list[bytes]:
            """Units that begin with a space and end in none are encoded many at a time and split by their bytes."""
            out: list[bytes] = [b""] * len(units)
            joined = [i for i, u in enumerate(units) if u[:1] == " " and not u[-1].isspace() and not any(a in u for a in added)]
            alone = sorted(set(range(len(units))) - set(joined)) if len(joined) < len(units) else []
            for i, e in zip(alone, tokenizer.encode_batch_fast([units[i] for i in alone], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
            for at in range(0, len(joined), 400):
                some = joined[at : at + 400]
                ids = np.array(tokenizer.encode_batch_fast(["".join(units[i] for i in some)], add_special_tokens=False)[0].ids, "<u4")
                ends = np.cumsum([len(units[i].encode()) for i in some])
                cuts = np.searchsorted(np.cumsum(width[ids]), ends) + 1
                raw, last = ids.tobytes(), 0
                for i, cut in zip(some, (4 * cuts).tolist(), strict=True):
                    out[i], last = raw[last:cut], cut
            return out

        _WORKER[path] = UnitEncoder(encode, added)
    return _WORKER[path]


def _id_type(path: str) -> str:
    """The narrowest little-endian type that holds the vocabulary's ids."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab().values()) < 1 << 16 else "<u4"


def tokenise(docs: DataFrame, path: str, end_id: int | None = None) -> DataFrame:
    """``doc_id``, ``shard`` (ascending ranges of ``doc_id``), ``shard_start`` (ids before it in the shard), ``n_tokens`` and ``ids`` of every whole text.

    The texts are dealt out by range and sorted first, so ids never need a shuffle.
    """
    kind = _id_type(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard, start = _unit_encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            done = 0
            for texts in slices(batch.column("text")):
                ids, counts = encoder.ids(texts)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(counts), end_id)
                    counts = counts + 1
                starts = start + np.cumsum(counts) - counts
                start += int(counts.sum())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(texts)), pa.array(np.full(len(texts), shard), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), binary_column(ids.astype(kind), counts)], ["doc_id", "shard", "shard_start", "n_tokens", "ids"])
                done += len(texts)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keys = ("doc_id", F.xxhash64("text"))
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, "doc_id long, shard int, shard_start long, n_tokens long, ids binary")


def frequencies(tokens: DataFrame, kind: str) -> DataFrame:
    """``id`` and its ``count`` over all documents: one row per id from each task, then a sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            part = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), kind), minlength=len(total))
            total = part + np.pad(total, (0, len(part) - len(total)))
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("count"))


def write_token_files(docs: DataFrame, tokenizer_path: str, out: str, end_id: int | None = None) -> None:
    """Encode ``docs`` and write the shards to ``out/tokens`` and the rank table to ``out/ranks``.

    The rank table has one row per id that occurs; the vocabulary bounds it, so it may pass through the driver.
    """
    spark, kind = docs.sparkSession, _id_type(tokenizer_path)
    tokens = stage(tokenise(docs, tokenizer_path, end_id), "token-ids")
    by_rank = [row.id for row in frequencies(tokens, kind).orderBy(F.desc("count"), "id").select("id").collect()]
    rank_of = np.zeros(max(by_rank, default=0) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    spark.createDataFrame(list(enumerate(by_rank)), "rank long, id long").coalesce(1).write.parquet(f"{out}/ranks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for ids in slices(batch.column("ids"), PACKED_BYTES):
                same = [batch.column(c).slice(done, len(ids)) for c in ("doc_id", "shard", "shard_start", "n_tokens")]
                coded = pack_all(rank_of[np.frombuffer(b"".join(ids.to_pylist()), kind)], same[-1].to_numpy())
                yield pa.RecordBatch.from_arrays([*same, *coded], ["doc_id", "shard", "shard_start", "n_tokens", "control", "data"])
                done += len(ids)

    packed = tokens.mapInArrow(run, "doc_id long, shard int, shard_start long, n_tokens long, control binary, data binary")
    write_once(packed.sortWithinPartitions("shard", "shard_start"), f"{out}/tokens", "shard")
    release(tokens)


def read_token_files(spark, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (little-endian uint32) from the files at ``path``."""
    by_rank = np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")
    files = spark.read.schema("doc_id long, shard_start long, n_tokens long, control binary, data binary, shard int").parquet(f"{path}/tokens")
    # One row per shard: as many as the writer had tasks.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for data in slices(batch.column("data"), PACKED_BYTES):
                same = [batch.column(c).slice(done, len(data)) for c in ("doc_id", "shard", "shard_start", "n_tokens")]
                counts = same[-1].to_numpy()
                ids = by_rank[unpack_all(batch.column("control").slice(done, len(data)), data, counts)]
                yield pa.RecordBatch.from_arrays([*same, binary_column(ids, counts)], ["doc_id", "shard", "shard_start", "n_tokens", "ids"])
                done += len(data)

    decoded = files.select("doc_id", "shard", "shard_start", "n_tokens", "control", "data").mapInArrow(run, "doc_id long, shard int, shard_start long, n_tokens long, ids binary")
    return decoded.join(F.broadcast(shards), "shard").select("doc_id", (F.col("shard_start") + F.col("before")).alias("start"), "n_tokens", "ids")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the files, read them back, and digest each document's ids."""
    path = new_path(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer_path, path, end_id)
    return read_token_files(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
