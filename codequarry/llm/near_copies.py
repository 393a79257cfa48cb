"""Near copies by Jaccard similarity of word shingles: ball hashing over several SimHash fingerprints, then exact comparison.

The similarity of two sets of shingles decides how many bits of their fingerprints differ on average: a share of ``acos(2 s / (1 + s)) / pi``, which for 0.8 is
0.15. One long fingerprint within a few bits misses most such pairs, so each text has many short ones, of independent hashes. A pair at the similarity asked for is within
``RADIUS`` bits in at least one of them but for a chance of ``MISS``; more similar pairs are missed far more rarely. Every short fingerprint emits its variants within half
the radius, and texts with a common variant are candidates. Bits grow with the logarithm of the number of texts, so chance candidates stay a few a text. Candidates
are compared by all bits, and those left by their exact sets.

For each short fingerprint a text is compared with one other, the first of its groups in an order drawn for that fingerprint, so these pairs grow with the number of texts,
whatever the sizes of groups. Texts that then share a variant with a text of another component, by a word of further bits, are dealt out anew with all their bits, for the short
fingerprints in which they do: once more each is compared with one of another component. What is still apart but near by all bits is joined to clusters by a spanning
forest, and clusters are compared in blocks of ``BLOCK`` texts, two of them at a time, where each text is once. So every pair of candidates is compared, or is in one
component already. Equal texts are one node, so their number doesn't matter. Texts without words are copies of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.components import components
from codequarry.llm.rows import join_skewed, may_be_among
from codequarry.llm.simhash import _SPACE, PIECE
from codequarry.sources.scratch import release, stage

RADIUS, MISS = 2, 5e-4
#: Bits of a short fingerprint beyond the logarithm of the number of texts, and the fewest and most.
SPARE, FEWEST, MOST = 12, 20, 46
#: Texts of a key's rows, without and with all bits, and variants that are sorted at once.
ROWS, WIDE_ROWS, SORTED = 1 << 21, 1 << 18, 1 << 22
#: Bits of the further word in which near copies differ at most: five standard deviations above the mean at 0.8, short texts' ties included.
CHECK = 24
#: Pairs that are looked at together.
PAIRS = 1 << 18
#: Shingles that are remembered while pairs are compared.
KEPT = 1 << 21
#: Texts, and characters of texts, in a block of a cluster.
BLOCK, BLOCK_CHARS = 512, 1 << 22
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _MIX
    return values ^ (values >> np.uint64(29))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The set of a text's shingles, as sorted hashes; of a text of fewer words, all of them are its one shingle."""
    import xxhash

    parts, at = [], 0
    while at < len(text):
        cut = _SPACE.search(text, min(at + PIECE, len(text)))
        end = cut.start() if cut else len(text)
        got = text[at:end].lower().split()
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, got), np.uint64, len(got)))
        at = end + 1
    hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    width = min(words, len(hashes))
    value = np.full(len(hashes) - width + 1 if width else 0, width, np.uint64)
    for k in range(width):
        value = value * _BASE + hashes[k : k + len(value)]
    return np.unique(_mixed(value))


def signature(found: np.ndarray, n: int) -> np.ndarray:
    """``n`` words of 64 bits: a bit is 1 if it is in over half the hashes, which are drawn anew for each word."""
    seeds = _mixed(np.arange(1, n + 1, dtype=np.uint64) * _BASE)
    total = np.zeros(64 * n, np.int64)
    for at in range(0, len(found), 255):
        hashes = _mixed((found[at : at + 255, None] ^ seeds) * _BASE)
        bits = np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(found), bitorder="little").view("<u8")


def bands(words: np.ndarray, count: int, bits: int) -> np.ndarray:
    """The short fingerprints of signatures (rows): consecutive runs of bits."""
    at = np.arange(count) * bits
    word, low = at // 64, (at % 64).astype(np.uint64)
    high = np.minimum(word + 1, words.shape[1] - 1)
    value = words[:, word] >> low
    over = low + np.uint64(bits) > np.uint64(64)
    value = np.where(over, value | words[:, high] << (np.uint64(64) - low) % np.uint64(64), value)
    return value & np.uint64((1 << bits) - 1)


def differing_share(similarity: float) -> float:
    """Share of bits in which the fingerprints of sets of one size differ on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def far(n_bits: int, similarity: float, size: np.ndarray) -> np.ndarray:
    """Bits of ``n_bits`` in which near copies, the smaller with ``size`` shingles, differ at most: four standard deviations above the mean, which ties raise in small sets."""
    p = np.minimum(0.5, differing_share(similarity) + 0.08 / np.sqrt(np.maximum(1, size)))
    return n_bits * p + 4 * np.sqrt(n_bits * p * (1 - p))


def plan(n: int, similarity: float) -> tuple[int, int]:
    """Short fingerprints and the bits of each, for ``n`` texts."""
    bits = min(MOST, max(FEWEST, math.ceil(math.log2(max(2, n))) + SPARE))
    p = differing_share(similarity)
    hit = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(RADIUS + 1))
    return max(1, math.ceil(math.log(MISS) / math.log1p(-hit))), bits


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def groups(values: np.ndarray, bits: int, left: np.ndarray | None = None, positions: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows with a common variant: numbers of rows, and where each group begins among them. ``left``: flips that a row may still spend on ``positions``."""
    left = np.ones(len(values), np.int64) if left is None else left
    positions = list(range(bits)) if positions is None else positions
    if len(values) < 2:
        return
    if len(values) * (1 + len(positions)) > SORTED and len(positions) > 8:
        taken, rest = positions[:4], positions[4:]
        own = sum(((values >> np.uint64(p)) & np.uint64(1)) << np.uint64(k) for k, p in enumerate(taken))
        for value in range(16):
            spent = np.bitwise_count(own ^ np.uint64(value)).astype(np.int64)
            some = np.flatnonzero(spent <= left)
            for rows, begin in groups(values[some], bits, left[some] - spent[some], rest):
                yield some[rows], begin
        return
    mask = np.uint64(sum(1 << p for p in positions))
    flips = np.array([1 << p for p in positions], np.uint64)
    more = np.flatnonzero(left > 0)
    variants = np.concatenate([values & mask, ((values[more] & mask)[:, None] ^ flips).ravel()])
    owners = np.concatenate([np.arange(len(values)), np.repeat(more, len(flips))])
    order = np.argsort(variants, kind="stable")
    begin = np.flatnonzero(np.diff(variants[order], prepend=variants[order[:1]] ^ np.uint64(1)))
    size = np.diff(np.append(begin, len(order)))
    shared = np.repeat(size > 1, size)
    begin, size = begin[size > 1], size[size > 1]
    yield owners[order[shared]], np.cumsum(size) - size


def leaders(value: np.ndarray, check: np.ndarray, order: np.ndarray, bits: int, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of texts and of the first text, by ``order``, that any of their groups begins with and whose further bits are near; of another root, if roots are given."""
    best, lead = order.copy(), np.arange(len(value))
    for rows, begin in groups(value, bits):
        if not len(begin):
            continue
        size, own = np.diff(np.append(begin, len(rows))), order[rows]
        least = np.repeat(np.minimum.reduceat(own, begin), size)
        first = np.repeat(rows[own == least], size)
        near = np.bitwise_count(check[rows] ^ check[first]) <= CHECK
        if root is not None:
            near &= root[rows] != root[first]
        rows, least, first = rows[near], least[near], first[near]
        np.minimum.at(best, rows, least)
        won = best[rows] == least
        lead[rows[won]] = first[won]
    some = np.flatnonzero(lead != np.arange(len(value)))
    return some, lead[some]


def across(rows: np.ndarray, begin: np.ndarray, check: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of a group's pairs that are of different roots and whose further bits are near, a limited number at a time."""
    if not len(begin):
        return
    ends = np.append(begin[1:], len(rows))
    two = begin[ends - begin == 2]
    i, j = rows[two], rows[two + 1]
    near = (root[i] != root[j]) & (np.bitwise_count(check[i] ^ check[j]) <= CHECK)
    a, b, held = [i[near]], [j[near]], int(near.sum())
    mixed = np.flatnonzero((ends - begin > 2) & (np.minimum.reduceat(root[rows], begin) != np.maximum.reduceat(root[rows], begin)))
    for k in mixed:
        own = rows[begin[k] : ends[k]]
        own = own[np.argsort(root[own], kind="stable")]
        cut = np.append(np.flatnonzero(np.diff(root[own])) + 1, len(own))
        for low, high in zip(cut[:-1], cut[1:], strict=True):  # every text of a root with all of the roots before
            step = max(1, PAIRS // (high - low))
            for at in range(0, low, step):
                before = own[at : min(at + step, low)]
                x, y = np.nonzero(np.bitwise_count(check[before][:, None] ^ check[own[low:high]]) <= CHECK)
                a.append(before[x])
                b.append(own[low + y])
                held += len(x)
                if held > PAIRS:
                    yield np.concatenate(a), np.concatenate(b)
                    a, b, held = [], [], 0
    if held:
        yield np.concatenate(a), np.concatenate(b)


def forest(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that join trees of ``parent`` (each node's root), which are joined; fewer than there are nodes, over all calls."""
    one, two = [a[:0]], [b[:0]]
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = np.flatnonzero(low != high)
        if not len(apart):
            return np.concatenate(one), np.concatenate(two)
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        roots, first = np.unique(high, return_index=True)
        parent[roots] = low[first]
        one.append(a[first])
        two.append(b[first])
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def drawn(fp: np.ndarray, seed: int) -> np.ndarray:
    """An order of texts for each ``seed``."""
    return _mixed(fp.view(np.uint64) ^ _mixed(np.array([seed + 1], np.int64).view(np.uint64) * _BASE))


def _words(column: pa.Array) -> np.ndarray:
    """Numbers, bytes of texts, or a row of words for each binary value."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        out = np.empty(len(column), object)
        out[:] = column.cast(pa.large_binary()).to_pylist()
        return out
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)
    return column.to_numpy()


def _by_key(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each key in turn with its rows, from batches sorted by key."""
    held: list[tuple[int, list[np.ndarray]]] = []

    def rows() -> tuple[int, list[np.ndarray]]:
        return int(held[0][0]), [np.concatenate(c) for c in zip(*(h[1] for h in held), strict=True)]

    for batch in batches:
        keys = batch.column("key").to_numpy()
        for some in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1):
            if not len(some):
                continue
            if held and held[0][0] != keys[some[0]]:
                yield rows()
                held = []
            held.append((keys[some[0]], [_words(batch.column(c))[some] for c in columns]))
    if held:
        yield rows()


def links(texts: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Edges ``a``, ``b`` that connect the numbers ``fp`` of ``texts`` (``fp``, ``text``; rows with equal ``fp`` have equal texts) as near copies do."""
    distinct = stage(texts.groupBy("fp").agg(F.first(F.coalesce("text", F.lit(""))).alias("text")), "texts")
    n = distinct.count()
    count, bits = plan(n, similarity)
    n_words = -(-count * bits // 64)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py(), words) for x in batch.column("text").cast(pa.binary())]
            cells = [signature(x, n_words + 1) for x in sets]
            columns = [pa.array([x[:-1].tobytes() for x in cells], pa.binary()), pa.array([int(x[-1].view(np.int64)) for x in cells], pa.int64()), pa.array([len(x) for x in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("fp"), *columns], ["fp", "sig", "check", "size"])

    def dealt(of: DataFrame, most: int, carried: list[str]) -> tuple[DataFrame, int]:
        """A row for each short fingerprint (of ``bands``, if there are such) and each value that its variants have in the key bits, of which there are enough that a key has ``most`` rows; by key."""
        key_bits = max(0, math.ceil(math.log2(max(1, of.count()) / most)))
        low, flips = np.uint64((1 << key_bits) - 1), np.array([0, *(1 << k for k in range(key_bits))], np.uint64)
        some = "bands" in of.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 4096):
                    part = batch.slice(at, 4096)
                    n = len(part)
                    row, band = np.repeat(np.arange(n), count), np.tile(np.arange(count), n)
                    if some:
                        listed = part.column("bands")
                        row, band = np.repeat(np.arange(n), listed.value_lengths().to_numpy()), listed.flatten().to_numpy()
                    value = bands(_words(part.column("sig")), count, bits)[row, band]
                    key = ((value & low)[:, None] ^ flips) | (band.astype(np.uint64) << np.uint64(key_bits))[:, None]
                    again = pa.array(np.repeat(row, len(flips)))
                    columns = [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(value, len(flips)).view(np.int64)), *(part.column(c).take(again) for c in carried)]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "value", *carried])

        schema = ", ".join(["key long", "value long", *(f"{c} {'binary' if c == 'sig' else 'long'}" for c in carried)])
        return of.mapInArrow(run, schema).repartition("key").sortWithinPartitions("key"), key_bits

    def near(sa: np.ndarray, sb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Whether sizes allow for the similarity and all bits are near."""
        least, most = np.minimum(na, nb), np.maximum(na, nb)
        return (least >= similarity * most) & (np.bitwise_count(sa ^ sb).sum(axis=1) <= far(64 * n_words, similarity, least))

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (value, fp, check) in _by_key(batches, ["value", "fp", "check"]):
            rows, first = leaders(value.view(np.uint64), check.view(np.uint64), drawn(fp, key), bits)
            yield from _distinct(fp[rows], fp[first])

    def led_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (value, fp, check, root, size, sig) in _by_key(batches, ["value", "fp", "check", "root", "size", "sig"]):
            rows, first = leaders(value.view(np.uint64), check.view(np.uint64), drawn(fp, ~key), bits, root)
            some = near(sig[rows], sig[first], size[rows], size[first])
            yield from _distinct(fp[rows[some]], fp[first[some]])

    def apart(key_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts, and the short fingerprint in which they met one of another component."""
        for key, (value, fp, check, root) in _by_key(batches, ["value", "fp", "check", "root"]):
            seen = np.zeros(len(fp), bool)
            for rows, begin in groups(value.view(np.uint64), bits):
                for i, j in across(rows, begin, check.view(np.uint64), root):
                    seen[i] = seen[j] = True
            yield pa.RecordBatch.from_arrays([pa.array(fp[seen]), pa.array(np.full(seen.sum(), key >> key_bits))], ["fp", "band"])

    def near_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A spanning forest of a key's near pairs of different roots."""
        for _, (value, fp, check, root, size, sig) in _by_key(batches, ["value", "fp", "check", "root", "size", "sig"]):
            tree = np.arange(len(fp))
            for rows, begin in groups(value.view(np.uint64), bits):
                for i, j in across(rows, begin, check.view(np.uint64), root):
                    for at in range(0, len(i), PAIRS // 8):
                        x, y = i[at : at + PAIRS // 8], j[at : at + PAIRS // 8]
                        some = (tree[x] != tree[y]).nonzero()[0]
                        some = some[near(sig[x[some]], sig[y[some]], size[x[some]], size[y[some]])]
                        x, y = forest(tree, x[some], y[some])
                        yield from _distinct(fp[x], fp[y])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between two blocks of a cluster, or within one, as far as they join components."""
        for _, (fp, cluster, own, other, root, check, size, sig, text) in _by_key(batches, ["fp", "cluster", "own", "other", "root", "check", "size", "sig", "text"]):
            names, tree = np.unique(root, return_inverse=True)
            parent, sets, room, check = np.arange(len(names)), {}, KEPT, check.view(np.uint64)

            def of(k: int) -> np.ndarray:
                nonlocal room
                if (found := sets.get(k)) is None:
                    found = shingles(text[k], words)
                    if (room := room - len(found)) > 0:
                        sets[k] = found
                return found

            a, b = [], []
            for at in range(0, len(fp), 64):
                i = np.arange(at, min(at + 64, len(fp)))[:, None]
                meet = (root[i] != root) & (np.arange(len(fp)) > i) & (cluster[i] == cluster) & (own[i] == other) & (other[i] == own) & (np.bitwise_count(check[i] ^ check) <= CHECK)
                x, y = np.nonzero(meet)
                x += at
                some = near(sig[x], sig[y], size[x], size[y])
                for p, q in zip(x[some].tolist(), y[some].tolist(), strict=True):
                    if parent[tree[p]] != parent[tree[q]] and jaccard(of(p), of(q)) >= similarity:
                        forest(parent, tree[[p]], tree[[q]])
                        a.append(p)
                        b.append(q)
            if a:
                yield from _distinct(fp[a], fp[b])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                good = near(*(_words(batch.column(c)) for c in ("sa", "sb", "na", "nb")))
                yield batch.select(["a", "b"]).filter(pa.array(good))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (batch.column(c).cast(pa.binary()) for c in ("ta", "tb"))
            a, b, sets, room, good = batch.column("a").to_pylist(), batch.column("b").to_pylist(), {}, KEPT, []

            def of(fp: int, text: pa.Scalar) -> np.ndarray:
                """A text of several pairs is cut once while there is room."""
                nonlocal room
                if (found := sets.get(fp)) is None:
                    found = shingles(text.as_py(), words)
                    if (room := room - len(found)) > 0:
                        sets[fp] = found
                return found

            for x, y, tx, ty in zip(a, b, one, two, strict=True):
                left, right = of(x, tx), of(y, ty)
                possible = min(len(left), len(right)) >= similarity * max(len(left), len(right))
                good.append(possible and jaccard(left, right) >= similarity)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def sided(pairs: DataFrame, of: DataFrame, **names: str) -> DataFrame:
        """``pairs`` with columns of both sides, under short names; a text may be in any number of pairs."""
        total = pairs.count()
        for side in ("a", "b"):
            right = of.select(F.col("fp").alias(side), *(F.col(c).alias(short + side) for c, short in names.items()))
            pairs = join_skewed(pairs, right, side, pairs.groupBy(side).agg(F.count("*").alias("n")), total)
        return pairs

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of near ``pairs`` (a table) that are links by their sets."""
        ends = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
        ends = stage(ends, "ends")
        whole = stage(distinct.filter(may_be_among(ends, "fp")).join(ends, "fp", "left_semi"), "candidate-texts")
        found = stage(sided(pairs, whole, text="t").select("a", "b", "ta", "tb").mapInArrow(alike, "a long, b long"), "links")
        release(whole, ends)
        return found

    def compared(of: DataFrame, edges: DataFrame) -> DataFrame:
        """Links within the clusters that ``edges`` make: a text comes once for each block of its cluster that its own is compared with."""
        cluster = stage(components(edges).select(F.col("node").alias("fp"), F.col("root").alias("cluster")), "clusters")
        whole = stage(of.drop("bands").join(cluster, "fp").join(distinct.join(cluster, "fp", "left_semi"), "fp"), "clustered")
        sizes = whole.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.length("text")) / BLOCK_CHARS)).cast("long").alias("n"))
        rows = whole.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("fp"), "n")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        keyed = rows.withColumn("key", F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other"))).drop("n")
        found = stage(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(linked, "a long, b long"), "links")
        release(cluster, whole)
        return found

    def with_roots(of: DataFrame, edges: DataFrame) -> DataFrame:
        root = components(edges).withColumnRenamed("node", "fp")
        return stage(of.join(root, "fp", "left").select(*of.columns, F.coalesce("root", "fp").alias("root")), "rooted")

    sigs = stage(distinct.mapInArrow(sketch, "fp long, sig binary, check long, size long"), "signatures")
    by_key, _ = dealt(sigs, ROWS, ["fp", "check"])
    led_pairs = stage(by_key.mapInArrow(led, "a long, b long").distinct(), "led")
    tried = stage(sided(led_pairs, sigs, sig="s", size="n").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(close, "a long, b long"), "tried")
    found = confirmed(tried)
    rooted = with_roots(sigs, found)
    by_key, key_bits = dealt(rooted, ROWS, ["fp", "check", "root"])
    others = stage(by_key.mapInArrow(partial(apart, key_bits), "fp long, band long").groupBy("fp").agg(F.collect_set("band").alias("bands")), "apart")
    wide = stage(rooted.join(others, "fp"), "wide")
    by_key, _ = dealt(wide, WIDE_ROWS, ["fp", "check", "root", "size", "sig"])
    again = stage(by_key.mapInArrow(led_apart, "a long, b long").distinct().join(tried, ["a", "b"], "left_anti"), "led-apart")
    found = found.union(confirmed(again))
    rest = with_roots(wide.drop("root"), found)
    by_key, _ = dealt(rest, WIDE_ROWS, ["fp", "check", "root", "size", "sig"])
    near_edges = stage(by_key.mapInArrow(near_apart, "a long, b long"), "near-apart")
    found = found.union(compared(rest, near_edges))
    release(distinct, sigs, led_pairs, tried, rooted, others, wide, again, rest, near_edges)
    return found


def _distinct(a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs once each, the lesser number first."""
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    if len(pairs):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
