"""The registered queries against plain versions on the small tables."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from codequarry.llm import lines, queries
from codequarry.llm.queries import QUERIES
from tests.compare import compare, database
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_ids(spark, small, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found, start = by_id(QUERIES["op1_token_ids"](spark, small)), 0
    assert len(found) == len(docs)
    for d in docs:
        ids = np.array([*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(found[d.doc_id]) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_byte_bpe(spark, small, docs, tiktoken_encoding):
    found = by_id(QUERIES["op2_byte_bpe"](spark, small))
    assert len(found) == len(docs)
    for d in docs:
        ids = tiktoken_encoding.encode_ordinary(d.text or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), (d.text or "").encode())]
        assert tuple(found[d.doc_id]) == (d.doc_id, len(ids), *digests)


def test_quality_on_rows_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op3_quality"](spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 30 and sum(p == y for p, y in held) / len(held) > 0.9


def test_personal_data(spark, small, docs):
    found = by_id(QUERIES["op4_pii"](spark, small))
    for d in docs:
        spans = brute.base_spans(d.text)
        counts = Counter(kind for _, _, kind, _ in spans)
        joined = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)
        row = found[d.doc_id]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [counts[k] for k in brute.PATTERNS]
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(row.spans.split(","))


def test_decontamination(spark, small, docs):
    items = {r.item_id: brute.words(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id): r.distance for r in QUERIES["op5_decontaminate"](spark, small).collect()}
    some = [d for d in docs if len(d.text or "") < 3000]
    hit = {k for k, _ in found}
    for d in [d for d in some if d.doc_id in hit] + [d for d in some if d.doc_id not in hit][:12]:
        text = brute.words(d.text)
        for item_id, item in items.items():
            least = brute.least_edits(item, text)
            assert found.get((d.doc_id, item_id)) == (least if least <= int(0.2 * len(item)) else None)


def test_language_on_rows_held_out(spark, small, docs):
    langs = {d.doc_id: d.lang for d in docs}
    rows = QUERIES["op6_language_id"](spark, small).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    held = [(r.lang_pred, langs[r.doc_id]) for r in rows if r.held_out and r.lang_pred != "und"]
    assert sum(p == y for p, y in held) / len(held) > 0.9


def test_token_counts_after_edits(spark, small, docs, tiktoken_encoding):
    import re

    found = by_id(QUERIES["op7_token_counts"](spark, small))
    for d in docs:
        row, text = found[d.doc_id], d.text or ""
        assert row.n_tokens == len(tiktoken_encoding.encode_ordinary(text))
        once, n = re.subn(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<mail>", text)
        twice, m = re.subn("[0-9]{4,}", "<number>", once)
        assert (row.n_edits, row.n_tokens_after) == (n + m, len(tiktoken_encoding.encode_ordinary(twice)))
        assert row.n_encoded_again <= 30 * row.n_edits
    assert any(r.n_edits for r in found.values())


def test_simhash(spark, small, docs):
    found = by_id(QUERIES["op8_simhash"](spark, small))
    prints = [brute.fingerprint(d.text) for d in docs]
    root = brute.groups(prints)
    for k, d in enumerate(docs):
        assert tuple(found[d.doc_id]) == (d.doc_id, f"{prints[k]:016x}", docs[root[k]].doc_id)


def test_line_dedup_against_sql(spark, small):
    assert compare(QUERIES["op9_line_dedup"](spark, small), lines.ORACLE_SQL, database(small)) is None


def test_media(spark, small, docs):
    found = by_id(QUERIES["op10_media"](spark, small))
    for d in docs:
        raw = (d.text or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        row = found[d.doc_id]
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert {(r.media_sha256, r.feature) for r in found.values() if r.n_bytes == 0} <= {(r.media_sha256, r.feature) for r in found.values()}


def test_pipeline(spark, small, docs, tiktoken_encoding):
    """Every stage against a plain version of it, on what the stage before it kept."""
    con = database(small)
    rows = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language ID"](spark, rows, small)
    assert known.columns == rows.columns
    kept = known.orderBy("doc_id").collect()
    assert {r.doc_id for r in kept} == {d.doc_id for d in docs if any(c.isalpha() for c in d.text or "")}

    con.execute("DROP VIEW documents")
    con.register("documents", known.toPandas())
    texts = dict(con.execute(lines.ORACLE_SQL.replace("md5(", "(")).df()[["doc_id", "text_md5"]].itertuples(index=False))
    cleaned = stages["line dedup"](spark, known, small)
    assert cleaned.columns == rows.columns and {r.doc_id: r.text for r in cleaned.collect()} == texts

    ids = sorted(texts)
    root = brute.copies([texts[k] for k in ids])
    unique = stages["SimHash near-dedup"](spark, cleaned, small)
    assert unique.columns == rows.columns and {r.doc_id for r in unique.collect()} == {ids[k] for k in set(root)}

    found = {r.doc_id for r in queries.decontaminate.contaminated(unique, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    clean = stages["benchmark decontamination"](spark, unique, small)
    left = {r.doc_id for r in clean.collect()}
    assert clean.columns == rows.columns and left == {ids[k] for k in set(root)} - found

    final = by_id(corpus_pipeline.run(spark, small))
    assert set(final) == left
    assert all(final[k].ids_sha256 == hashlib.sha256(np.array(tiktoken_encoding.encode_ordinary(texts[k] or ""), "<u4").tobytes()).hexdigest() for k in left)
