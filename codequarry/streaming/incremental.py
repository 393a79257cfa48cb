"""Incremental mining with Structured Streaming: new commit files are mined as they come, and pairs are merged by id."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from codequarry.functions.columns import is_test_path
from codequarry.operators import mining
from codequarry.sources.sinks import PairTable

CHANGE = "repo string, commit_hash string, parent_commit string, seq long, committed_at timestamp, message string, is_merge boolean, old_path string, new_path string, before string, after string"


def follow(spark: SparkSession, folder: str, table: PairTable, options: mining.Options = mining.Options(), checkpoint: str | None = None) -> StreamingQuery:
    """Mine what has come to ``folder`` since the last run with the same ``checkpoint``, then stop.

    Files come in once; a commit's file that is delivered twice is dropped within a batch, and in a later one its pairs only replace
    themselves. Without a ``checkpoint`` the place is kept beside the table, so a later call goes on from there. There is no watermark, so commits of any age are mined whenever they come. A batch that is run again after a failure gives the same table.
    """
    changes = spark.readStream.schema(CHANGE).parquet(folder)

    def merge(batch: DataFrame, _: int) -> None:
        once = batch.dropDuplicates(["repo", "commit_hash", "old_path", "new_path"])
        pairs = mining.mine(once, options)
        table.merge(pairs)

    writer = changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint or f"{table.root}/_stream")
    return writer.trigger(availableNow=True).start()


#: Files of a commit are told apart by these.
FILE = ["repo", "commit_hash", "old_path", "new_path"]


def _place(row: Row) -> tuple:
    """Order of pairs: by ``seq``, those without one last, then by id."""
    return row.seq is None, row.seq or 0, row.id


class _Capped(StatefulProcessor):
    """The first pairs of a repository and smell, as many as its cap, over all batches; only the ids of those that were kept are remembered."""

    def __init__(self, caps: dict[str, int]):
        self._caps = caps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._kept = handle.getMapState("kept", "id string", "seq long")
        self._n = handle.getValueState("n", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n = self._n.get()[0] if self._n.exists() else 0
        room = self._caps[key[1]] - n
        if room <= 0:
            return
        # Of a batch at most as many rows as there is room for are in memory. One id may come from several files of a batch.
        first: dict[str, Row] = {}
        for row in rows:
            if row.id in first:
                if _place(row) < _place(first[row.id]):
                    first[row.id] = row
                continue
            if self._kept.containsKey((row.id,)):
                continue
            first[row.id] = row
            if len(first) > 2 * room:
                keep = heapq.nsmallest(room, first.values(), key=_place)
                first = {r.id: r for r in keep}
        kept = heapq.nsmallest(room, first.values(), key=_place)
        for row in kept:
            self._kept.updateValue((row.id,), (row.seq,))
            yield row
        if kept:
            self._n.update((n + len(kept),))

    def close(self) -> None:
        pass


#: So many ids of first pairs are kept by a task before it begins anew, which lets more pairs by.
FIRST_IDS = 1 << 17


def _may_be_first(caps: dict[str, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without those behind as many other ids of their repository and smell, in the same task, as the cap has.

    With ``n`` pairs kept, there is room for those that come first after at most ``n`` known ids, so they are among the first ids of a cap's number, whatever is in the state.
    """
    groups: dict[tuple, dict[str, tuple]] = {}
    last: dict[tuple, tuple] = {}
    held = 0
    for batch in batches:
        taken = []
        for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("repo", "smell_type", "id", "seq")), strict=True)):
            key, place = row[:2], (row[3] is None, row[3] or 0, row[2])
            if held > FIRST_IDS:
                groups, last, held = {}, {}, 0
            ids, cap = groups.setdefault(key, {}), caps[row[1]]
            if cap <= 0 or (place >= ids[row[2]] if row[2] in ids else len(ids) >= cap and place > last[key]):
                continue
            taken.append(k)
            held += row[2] not in ids
            ids[row[2]] = place
            if len(ids) > cap:
                del ids[max(ids, key=ids.get)]
                held -= 1
            if len(ids) == cap:
                last[key] = max(ids.values())
        if taken:
            yield batch.take(pa.array(taken))


def capped_pairs(changes: DataFrame, options: mining.Options) -> DataFrame:
    """Pairs of a stream of changed files, at most ``options.caps`` of a smell from each repository over the whole life of the stream.

    Files that have been seen, in any batch, give nothing new. Within a batch the first pairs by ``seq`` count, and batches count in the order in which they come. Smells
    without a cap aren't limited and keep no state. What is remembered is up to a cap's number of ids for each repository and smell and, if a smell has no cap, the key of each file. Where all have
    one, a pair that comes again is among those ids, or its cap is full, so files needn't be remembered, and no code is shuffled but that of pairs that may be kept.
    """
    rows = mining.commits(changes, options)
    rows, unlimited = rows.filter(~is_test_path("file")), set(mining.SMELLS) - set(options.caps)
    pairs = mining.verified(mining.candidates(rows.dropDuplicates(FILE) if unlimited else rows), options)
    limited = F.col("smell_type").isin(*options.caps)
    first = pairs.filter(limited).mapInArrow(partial(_may_be_first, options.caps), pairs.schema)
    kept = first.groupBy("repo", "smell_type").transformWithState(_Capped(options.caps), pairs.schema, "Append", "None")
    return kept.unionByName(pairs.filter(~limited)) if unlimited else kept


def follow_capped(spark: SparkSession, folder: str, table: PairTable, options: mining.Options, checkpoint: str | None = None) -> StreamingQuery:
    """``follow`` with caps and seen files that hold over batches and restarts; both are in the stream's own state, beside the place it has come to."""
    if not options.caps:
        raise ValueError("without caps there is nothing to keep: use follow")
    conf, key = spark.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key, None)
    # A stream takes the settings that hold when it starts.
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        pairs = capped_pairs(spark.readStream.schema(CHANGE).parquet(folder), options)
        writer = pairs.writeStream.foreachBatch(lambda batch, _: table.merge(batch) and None).option("checkpointLocation", checkpoint or f"{table.root}/_capped_stream")
        return writer.outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.unset(key) if before is None else conf.set(key, before)
