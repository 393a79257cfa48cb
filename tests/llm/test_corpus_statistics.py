"""Phrases, resampling and shards: against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codequarry.llm import phrases, ranks, resample, sharding
from codequarry.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import compare, database

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, part int, place int, n long, w0 string, deal int, phrase string, f long, rank int, shard int, slot int, __id int"
ROWS = [
    (1, "The cat sat. The cat sat, the Cat ran", "en", "a"),
    (1, "The cat sat. The cat sat, the Cat ran", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (None, "no id\tat all at all\nat all", "en", "b"),
    (None, None, None, None),
    (4, "word another é日本 ÀB " * 30000, "fr", "a"),
    (5, " \n\t\n.,;", "en", "c"),
    (6, "\x01odd \x01odd \x00 \x00 odd\x01 b", None, "c"),
    (7, "x" * 70000 + " y " * 20, "de", "a"),
]


@pytest.fixture(autouse=True)
def several_ranges(spark):
    """Small ranges aren't merged, so that orders and stacks go over several tasks."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture(scope="module", params=["rows", "no rows"])
def frame(request, spark):
    rows = [(i, t, lang, source, 1, 1, 2, 3, 4, "w", 5, "p", 6, 7, 8, 9, 10) for i, t, lang, source in ROWS] if request.param == "rows" else []
    return spark.createDataFrame(rows, SCHEMA)


def plain_collocations(docs, min_count: int, max_words: int, top: int, covered: int) -> set:
    counts = defaultdict(Counter)
    for text, lang in docs:
        low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(len(words)):
                for n in range(1, min(max_words, len(words) - k) + 1):
                    counts[lang or "und"][tuple(words[k : k + n])] += 1
    out = set()
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        able = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        rows = []
        for p, a in able.items():
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in able.items()):
                rows.append((-score, -a, " ".join(p).encode(), " ".join(p), f[p[:k]], f[p[k:]]))
        for rank, (score, a, _, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, phrase, -a, left, right, n, -score))
    return out


def found_collocations(frame, **options) -> list:
    return [tuple(r) for r in phrases.collocations(frame, **options).collect()]


def test_phrases_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert compare(QUERIES["op11_phrases"](spark, sf), ORACLE_SQL["op11_phrases"], database(sf)) is None


@pytest.mark.parametrize(("min_count", "max_words", "covered"), [(1, 3, 50), (2, 4, 90), (3, 2, 50)])
def test_phrases_of_odd_rows(frame, min_count, max_words, covered):
    found = found_collocations(frame, min_count=min_count, max_words=max_words, covered=covered, top=40)
    want = plain_collocations([(r.text, r.lang) for r in frame.collect()], min_count, max_words, 40, covered)
    assert len(found) == len(want) and set(found) == want


def test_phrases_over_small_stretches_and_batches(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text", "lang")
    monkeypatch.setattr(phrases, "STRETCH", 500)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        few = docs.limit(20).collect()
        found = found_collocations(spark.createDataFrame(few, docs.schema).repartition(3), min_count=2)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(found) == plain_collocations([(r.text, r.lang) for r in few], 2, 3, 2000, 50)


def test_scores_pass_64_bits(spark):
    """The expression of the score, with counts whose products need 100 bits."""
    rows = [(999_999_999_999, 999_999_999_999, 999_999_999_998), (123_456_789_012, 987_654_321_098, 555_555_555_555), (10, 10, 999_999_999_999)]
    a, l, r = (f"cast({c} as decimal(15, 0))" for c in "alr")
    got = spark.createDataFrame(rows, "a long, l long, r long").selectExpr("a", "l", "r", f"(cast(1000000 as decimal(7, 0)) * ({a} * {a})) div ({l} * {r}) as score")
    assert all(x.score == 1000000 * x.a * x.a // (x.l * x.r) for x in got.collect())


def test_suffixes_of_a_hot_word_are_dealt_out(spark):
    """A first word before every other one is in many parts, and its suffixes are merged in their task."""
    text = " ".join(f"the w{k % 500}" for k in range(20000))
    suffixes = phrases.suffix_counts(spark.createDataFrame([(text, "en")], "text string, lang string"))
    rows = phrases.dealt(suffixes).select("key", "n", F.spark_partition_id().alias("p")).filter(F.startswith("key", F.lit("en\0the\0"))).collect()
    assert len(rows) <= 1001 and sum(r.n for r in rows) == 20000
    assert len({r.p for r in rows}) == 4


def plain_words(text) -> list[bytes]:
    low = (text or "").encode().lower() if (text or "").isascii() else (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode()
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_resample(docs, target, percent, min_words, buckets, run, seed) -> Counter:
    def found(text):
        words = plain_words(text)
        return words, [zlib.crc32(b" ".join(words[k : k + n])) % buckets for n in range(1, run + 1) for k in range(len(words) - n + 1)]

    made = [(i, *found(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in target for b in found(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, words, f in made:
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(words), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((-r[4], r[0] is None, r[0] or 0) for r in rows if r[1] >= min_words)
    drawn = percent * len(able) // 100
    ranks_of = defaultdict(list)
    for k, key in enumerate(able):
        ranks_of[key].append(k + 1 if k < drawn else None)
    return Counter((i, f, w, score, ranks_of[(-score, i is None, i or 0)].pop(0) if n >= min_words else None) for i, n, f, w, score in rows)


def test_resampling_against_plain_version(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    found = Counter(tuple(r) for r in QUERIES["op12_resample"](spark, small).collect())
    assert found == plain_resample(docs, target, 10, 20, 10000, 1, 2024)
    assert sum(r[4] is not None for r in found) == sum(len(plain_words(t)) >= 20 for _, t in docs) // 10


@pytest.mark.parametrize("run", [1, 2, 3])
def test_resampling_of_odd_rows(spark, frame, monkeypatch, run):
    monkeypatch.setattr(resample, "PIECE", 11)
    target = spark.createDataFrame([("the cat",), (None,), ("",)], "text string")
    found = resample.resample(frame, target, percent=50, min_words=2, buckets=97, run=run, seed=5)
    want = plain_resample([(r.doc_id, r.text) for r in frame.collect()], ["the cat", None, ""], 50, 2, 97, run, 5)
    assert Counter(tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()) == want
    nothing = resample.resample(frame, target.limit(0), buckets=97).collect()
    assert len(nothing) == frame.count()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("aB é\t0_", max_size=12), max_size=6), st.integers(1, 3), st.integers(1, 9))
def test_streams_of_pieces(texts, run, piece):
    known, before = resample._Buckets(1000), resample.PIECE
    try:
        resample.PIECE = piece
        for text in texts:
            parts, n = resample._stream(text, known, run)
            words = plain_words(text)
            want = Counter(zlib.crc32(b" ".join(words[k : k + m])) % 1000 for m in range(1, run + 1) for k in range(len(words) - m + 1))
            assert n == len(words) and Counter(np.concatenate([np.zeros(0, int), *parts]).tolist()) == want
    finally:
        resample.PIECE = before


def check_shards(rows, shards: int) -> None:
    """Counts at most one apart, slots without gaps, and every source in every shard within two rows of its share."""
    total = len(rows)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    assert {len(by_shard[k]) for k in range(shards)} <= {total // shards, -(-total // shards)}
    of = Counter(r.source for r in rows)
    there = Counter((r.source, r.shard) for r in rows)
    for source, n in of.items():
        share = Fraction(n, shards)
        # Each other source may move a cut by a row.
        assert all(abs(there[source, k] - share) <= 2 + share * len(of) * shards / total for k in range(shards))


def test_shards(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sharding.places(docs, 40).collect()
    check_shards(rows, 40)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t) + 16, zlib.crc32(t)) for i, t in texts.items()}
    assert QUERIES["op13_shards"](spark, small).filter("law = 'rows' and grown_shard is null").count() == len(rows)
    again = sharding.places(docs.repartition(7), 40).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_shards_with_a_hot_source_and_many_small_ones(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN concat('s', id) ELSE concat('m', id % 5) END").alias("source"))
    rows = sharding.places(docs, 8).collect()
    there = Counter((r.source[0], r.shard) for r in rows)
    assert all(abs(there["h", k] - 250) <= 5 and abs(there["m", k] - 250) <= 5 and abs(there["s", k] - 250) <= 10 for k in range(8))


def test_shards_of_odd_rows(spark, frame, tmp_path):
    rows = sharding.places(frame, 3).collect()
    assert len(rows) == frame.count()
    check_shards(rows, 3)
    assert sorted(r.size for r in rows if r.doc_id in (2, 3)) in ([], [16, 16])
    path = str(tmp_path / "shards")
    sharding.write_shards(frame, path, 3)
    written = spark.read.schema("slot long, doc struct<" + ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in frame.schema) + ">, shard int").parquet(path)
    assert Counter(tuple(r.doc) for r in written.collect()) == Counter(tuple(r) for r in frame.collect())
    want = {(r.shard, r.slot): r.doc_id for r in rows}
    # Equal rows may change places.
    assert {(r.shard, r.slot): r.doc.doc_id for r in written.collect()} == want
    for file in tmp_path.rglob("*.parquet"):
        slots = pq.read_table(file, columns=["slot"], partitioning=None).column("slot").to_pylist()
        assert slots == sorted(slots)


def test_places_in_an_order(spark):
    rows = ranks.numbered(spark.range(1000).selectExpr("id * 7919 % 1000 as v", "id % 3 as t"), "numbers")
    placed = ranks.in_order(rows, F.col("t"), F.col("v").desc(), F.col("row")).collect()
    want = sorted(((r.t, -r.v) for r in placed))
    assert [(r.t, -r.v) for r in sorted(placed, key=lambda r: r.place)] == want and sorted(r.place for r in placed) == list(range(1000))
    assert len({r.part for r in placed}) > 1
