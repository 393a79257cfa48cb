"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters run over overlapping chunks that cover the whole document; each chunk keeps its largest response
of every filter, and a document has the largest and the mean of its chunks' responses, from which a logistic unit
makes one probability. Inference adds up table rows: one row for each pair of neighbouring bytes and
place in the filter, so no byte is ever expanded to a one-hot vector.

Training takes at most ``max_rows`` labelled rows, whole texts, those whose ``doc_id`` has the least hash; of rows that repeat an id those with the
least texts. Responses of long texts are made block by block, so memory for them is bounded. Null and empty texts are one chunk of padding. Rows are independent of each other; extra columns are
ignored. Without labels of both kinds every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a filter, filters, bytes of a chunk, and bytes between the starts of chunks.
WIDTH, FILTERS, CHUNK, STEP = 6, 12, 512, 448
#: Bytes whose responses are in memory at once.
BLOCK = 1 << 19


def chunk_bounds(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last place (exclusive) of each chunk of filter responses, and its document; a document is padded to one filter at least."""
    places = np.maximum(sizes - WIDTH + 1, 1)
    chunks = np.maximum(1, -(-(places - (CHUNK - STEP)) // STEP))
    owner = np.repeat(np.arange(len(sizes)), chunks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    offset = np.cumsum(np.maximum(sizes, WIDTH)) - np.maximum(sizes, WIDTH)
    start = offset[owner] + number * STEP
    return start, np.minimum(start + CHUNK, (offset + places)[owner]), owner


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(t.ljust(WIDTH, b"\0") for t in texts), np.uint8), sizes


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    out_bias: float

    def pairs(self) -> np.ndarray:
        """Responses of two neighbouring bytes, by pair of places: WIDTH / 2 x 65536 x FILTERS."""
        f = self.filters
        return np.stack([(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(-1, FILTERS) for k in range(0, WIDTH, 2)])

    def responses(self, data: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        both = data[:-1].astype(np.int32) << 8 | data[1:]
        n = len(data) - WIDTH + 1
        total = pairs[0][both[:n]]
        for k in range(1, WIDTH // 2):
            total += pairs[k][both[2 * k : 2 * k + n]]
        return total

    def pooled(self, texts: list[bytes], pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each chunk, and the chunk's document."""
        data, sizes = joined(texts)
        start, stop, owner = chunk_bounds(sizes)
        found = []
        at = 0
        while at < len(start):
            last = max(at + 1, int(np.searchsorted(stop, start[at] + BLOCK, side="right")))
            base = int(start[at])
            block = self.responses(data[base : int(stop[last - 1]) + WIDTH - 1], pairs)
            edges = np.stack([start[at:last], stop[at:last]], axis=1).ravel() - base
            edges[-1:] = np.minimum(edges[-1:], len(block))
            if edges[-1] == len(block):
                edges = edges[:-1]
            found.append(np.maximum.reduceat(block, edges, axis=0)[::2])
            at = last
        return np.concatenate(found), owner

    def scores(self, texts: list[bytes], pairs: np.ndarray) -> np.ndarray:
        best, owner = self.pooled(texts, pairs)
        hidden = np.maximum(best + self.bias, 0)
        first = np.searchsorted(owner, np.arange(len(texts)))
        features = np.concatenate([np.maximum.reduceat(hidden, first, axis=0), np.add.reduceat(hidden, first, axis=0) / np.bincount(owner, minlength=len(texts))[:, None]], axis=1)
        return 1 / (1 + np.exp(-(features @ self.out + self.out_bias)))


def largest(filters: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and value of the largest response of each filter in each chunk."""
    where, best, at = [], [], 0
    while at < len(start):
        last = max(at + 1, int(np.searchsorted(stop, start[at] + BLOCK, side="right")))
        base, end = int(start[at]), int(stop[last - 1])
        total = sum(filters[w][data[base + w : end + w]] for w in range(WIDTH))
        for a, b in zip(start[at:last] - base, stop[at:last] - base, strict=True):
            top = total[a:b].argmax(axis=0)
            where.append(base + a + top)
            best.append(total[a + top, np.arange(total.shape[1])])
        at = last
    return np.stack(where), np.stack(best)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the mean log-loss; gradients reach the byte at each pooled maximum."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    params = {"filters": rng.normal(0, 0.1, (WIDTH, 256, FILTERS)), "bias": np.full(FILTERS, 0.1), "out": rng.normal(0, 0.3, 2 * FILTERS), "out_bias": np.zeros(1)}
    if not 0 < share < 1:
        odds = np.log((share + 1e-3) / (1 - share + 1e-3))
        return Network(params["filters"].astype(np.float32), params["bias"].astype(np.float32), np.zeros(2 * FILTERS, np.float32), float(odds))
    first = {k: np.zeros_like(v) for k, v in params.items()}
    second = {k: np.zeros_like(v) for k, v in params.items()}
    cases = [joined([t])[0] for t in texts]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            net = Network(params["filters"].astype(np.float32), params["bias"], params["out"], float(params["out_bias"][0]))
            grad = {k: np.zeros_like(v) for k, v in params.items()}
            sizes = np.array([len(texts[i]) for i in some])
            data = np.concatenate([cases[i] for i in some])
            start, stop, owner = chunk_bounds(sizes)
            where, best = largest(net.filters, data, start, stop)
            best = best + net.bias
            hidden = np.maximum(best, 0)
            chunks = np.bincount(owner, minlength=len(some))
            begin = np.cumsum(chunks) - chunks
            top = np.maximum.reduceat(hidden, begin, axis=0)
            mean = np.add.reduceat(hidden, begin, axis=0) / chunks[:, None]
            features = np.concatenate([top, mean], axis=1)
            p = 1 / (1 + np.exp(-(features @ net.out + net.out_bias)))
            error = (p - labels[some]) / len(some)
            grad["out"], grad["out_bias"] = features.T @ error, error.sum(keepdims=True)
            back = error[:, None] * net.out
            of_chunk = back[owner][:, FILTERS:] / chunks[owner][:, None]
            is_top = hidden == top[owner]
            of_chunk = of_chunk + back[owner][:, :FILTERS] * is_top / np.maximum(1, np.add.reduceat(is_top, begin, axis=0)[owner])
            of_chunk = of_chunk * (best > 0)
            grad["bias"] = of_chunk.sum(axis=0)
            for w in range(WIDTH):
                np.add.at(grad["filters"][w], (data[where + w], np.arange(FILTERS)[None, :]), of_chunk)
            step += 1
            for k in params:
                first[k] = 0.9 * first[k] + 0.1 * grad[k]
                second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                params[k] = params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Network(params["filters"].astype(np.float32), params["bias"].astype(np.float32), params["out"].astype(np.float32), float(params["out_bias"][0]))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 3000) -> Network:
    """From ``text`` of ``docs`` and ``quality`` (0 or 1; others don't count) of ``labels``, by ``doc_id``.

    The labels are chosen first, so the join broadcasts ``max_rows`` ids at most and moves no text but theirs; ``max_rows`` bounds the rows that
    reach the driver.
    """
    rows = labels.filter("quality in (0, 1)").select("doc_id", "quality", F.xxhash64("doc_id").alias("h"))
    chosen = rows.distinct().orderBy("h", "doc_id", "quality").limit(max_rows)
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = ["h", F.xxhash64("text"), "text", "quality"]
    got = whole.join(F.broadcast(chosen), "doc_id").orderBy(*order).limit(max_rows).toArrow()
    texts = [x.as_py() for x in got.column("text").cast(pa.binary())]
    return fit(texts, got.column("quality").to_numpy().astype(np.float64))


def score(docs: DataFrame, network: Network) -> DataFrame:
    """``doc_id`` and ``score``, the probability of label 1, of every whole text."""
    broadcast = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = broadcast.value
        pairs = network.pairs()
        for batch in batches:
            column, done, held, size = batch.column("text").cast(pa.binary()), 0, [], 0
            for k, text in enumerate(column, 1):
                held.append(text.as_py() or b"")
                size += len(held[-1])
                if size > 8 << 20 or k == len(column):
                    scores = network.scores(held, pairs).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(held)), pa.array(scores)], ["doc_id", "score"])
                    done, held, size = k, [], 0

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
