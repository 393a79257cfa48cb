"""Nulls, empty and long texts, repeated rows, empty tables, clashing names: every operator and stage has a defined result."""

from __future__ import annotations

import base64

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codequarry.llm import byte_bpe, components, decontaminate, language, lines, media, pii, quality, simhash, token_counts, token_ids
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, fp string, root string, copy string, score string, row_key string, a int, k int"
LONG = "word another é日本 " * 9000
ROWS = [
    (1, "a plain text of some words\nand a second line", "en"),
    (1, "a plain text of some words\nand a second line", "en"),
    (2, None, "en"),
    (3, "", None),
    (None, "no id at all", None),
    (None, None, None),
    (4, LONG, "fr"),
    (5, "  \n\t\n", "en"),
    (6, "12345 !!! 67890", None),
    (7, "mail a.b@c-d.org or +44 20 7946 0958, 10.0.0.256 and 10.0.0.1, 4111 1111 1111 1111", "en"),
]
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module", params=["rows", "no rows"])
def frame(request, spark):
    rows = [(i, t, lang, "src", None if t is None else len(t), 1, "x", "y", "z", "c", "s", "r", 1, 2) for i, t, lang in ROWS] if request.param == "rows" else []
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "a plain text of some words"), (2, None), (3, ""), (None, "a plain text of some words")], "item_id long, text string")


def size(frame) -> int:
    return frame.count()


def test_token_files(frame):
    rows = token_ids.token_output(frame, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert len(rows) == size(frame)
    assert sorted(r.n_tokens for r in rows if r.doc_id in (2, 3)) in ([], [1, 1])
    ends = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))


def test_byte_bpe(frame):
    rows = byte_bpe.decode(byte_bpe.encode(frame, PATH, PATTERN, chunk=1 << 12, overlap=1 << 6), PATH, PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in rows) == sorted((r.text or "").encode() for r in frame.collect())


def test_quality(frame):
    network = quality.train(frame, frame.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"))
    rows = quality.score(frame, network).collect()
    assert len(rows) == size(frame) and all(0 <= r.score <= 1 for r in rows)


def test_personal_data(frame):
    rows = pii.personal_data(frame).collect()
    assert len(rows) == size(frame)
    assert [(r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows if r.doc_id == 7] in ([], [(1, 1, 1, 1)])
    assert all(r.spans == "" for r in rows if r.doc_id in (2, 3, 5))


def test_decontamination(frame, benchmark):
    found = decontaminate.contaminated(frame, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} in (set(), {(1, 1), (1, None)})
    left = decontaminate.decontaminate(frame, benchmark)
    assert left.columns == frame.columns and left.count() == size(frame) - 2 * (size(frame) > 0)
    assert decontaminate.decontaminate(frame, benchmark.limit(0)).count() == size(frame)


def test_language(frame):
    model = language.train(frame)
    rows = language.predict(frame, model).collect()
    assert len(rows) == size(frame)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (2, 3, 5, 6))


def test_token_counts(spark, frame, tmp_path):
    from pyspark.sql import functions as F

    trees = token_counts.TreeTable(spark, str(tmp_path / "trees"), PATH, PATTERN)
    trees.build(frame)
    edits = F.expr("array(named_struct('start', 0L, 'end', 1L, 'text', 'b'), named_struct('start', 0L, 'end', 9L, 'text', 'c'), named_struct('start', 5L, 'end', 2L, 'text', ''))")
    assert trees.edit(F.when(~F.col("doc_id").eqNullSafe(4), edits)) == 1
    assert trees.edit(token_counts.masked("[0-9]+", "n")) == 2
    rows = token_counts.counts_over_versions(trees).collect()
    assert len(rows) == size(frame) == trees.current().count()
    assert all((r.n_tokens, r.n_edits) == (0, 0) for r in rows if r.doc_id in (2, 3))
    assert sorted(r.n_edits for r in rows if r.doc_id in (4, 6)) in ([], [0, 3])


def test_simhash(frame):
    rows = simhash.near_duplicates(frame).collect()
    assert len(rows) == size(frame)
    assert {r.component_id for r in rows if r.doc_id in (2, 3, 5)} in (set(), {2})
    left = simhash.one_of_each(frame)
    assert left.columns == frame.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:3]) for r in left.collect()) in ([], [(0, "no "), (1, "a p"), (2, ""), (4, "wor"), (6, "123"), (7, "mai")])


def test_line_dedup(frame):
    rows = lines.remove_boilerplate(frame)
    assert rows.columns == [*frame.columns, "n_lines", "n_removed"]
    assert sorted((r.doc_id or 0, r.text or "", r.n_removed) for r in rows.collect()) == sorted((r.doc_id or 0, r.text or "", 0) for r in frame.collect())


def test_media(frame):
    rows = media.digests(frame).collect()
    assert len(rows) == size(frame)
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (2, 3)}) <= 1
    assert media.tensors(media.store(frame.filter("doc_id = 1"))).count() in (0, 2)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, frame, benchmark, name, stage, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    out = stage(spark, frame, folder)
    assert name == "byte-level BPE" or out.columns == frame.columns
    assert out.count() <= size(frame) and (name not in ("line dedup", "byte-level BPE") or out.count() == size(frame))


def test_boilerplate_goes_and_copies_stay(spark):
    line = "all rights reserved by everyone here"
    rows = [(k, f"{line}\nown text number {k}, which is longer than the line that everybody has", f"s{k}") for k in range(9)] + [(20, line, "s1"), (21, f"{line}\r\nown and long enough to stay on its own feet", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("__row_key", F.lit(1)).withColumn("bad", F.lit("x"))
    cleaned = lines.remove_boilerplate(docs)
    assert cleaned.columns == [*docs.columns, "n_lines", "n_removed"]
    found = {r.doc_id: (r.text, r.n_removed) for r in cleaned.collect()}
    assert all(line not in found[k][0] and found[k][1] == 1 for k in [*range(9), 21])
    assert found[20] == (line, 0)


def test_pipeline_takes_long_boilerplate_from_short_pages(spark):
    line, copied = "all rights reserved by everyone here", "a page that was copied as a whole to many sites"
    rows = [(k, f"{line}\nshort {k}", f"s{k}") for k in range(9)] + [(20, line, "s1"), (21, f"\n{line}\r\n", None)]
    rows += [(30 + k, f"{copied}\nwith this", f"s{k}") for k in range(9)] + [(50, f"{copied}\nand another end", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, "").collect()}
    assert found == {k: f"short {k}" if k < 9 else text for k, text, _ in rows}


def test_language_of_texts_without_spaces(spark):
    rng = np.random.default_rng(2)
    run = lambda letters, n: "".join(rng.choice(list(letters), n))
    schema = "doc_id long, text string, lang string"
    docs = [(3 * k + j, text, lang) for k in range(40) for j, (text, lang) in enumerate([(run("กขคงจฉชซ", 300), "th"), (run("abcdefgh", 300), "en"), (run("ijklmnop", 300), "xx")])]
    model = language.train(spark.createDataFrame(docs, schema))
    asked = [(0, "abc" + run("กขคงจฉชซ", 200), None), (1, run("abcdefgh", 70) + run("ijklmnop", 400), None), (2, run("abcdefgh", 70) + run("กขคงจฉชซ", 70), None)]
    rows = {r.doc_id: r for r in language.predict(spark.createDataFrame(asked, schema), model).collect()}
    assert [rows[k].lang_pred for k in (0, 1)] == ["th", "xx"] and rows[0].score == 200 / 203
    assert {s.lang for s in rows[2].spans} == {"en", "th"} and rows[2].score == 0.5
    assert language.parts_of("e\u0301" * 40) == ["e\u0301" * 32, "e\u0301" * 8]


def test_components(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5000)]
    rows = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({rows[k] for k in range(301)}) == 1 and len({rows[k] for k in range(1000, 1400)}) == 1 and rows[0] != rows[1000]
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ball_hashing_finds_all_links(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = [int(b) for b in base]
    for b in base:
        for flips in (1, 2, 3, 4, 5, 8):
            prints.append(int(b) ^ sum(1 << int(p) for p in rng.choice(63, flips, replace=False)))
    prints = list(dict.fromkeys(prints))
    nodes = spark.createDataFrame([(p,) for p in prints], "fp long")
    root = {r.node: r.root for r in components.components(simhash.links(nodes)).collect()}
    expected = brute.groups(prints)
    for k, p in enumerate(prints):
        first = prints[expected[k]]
        assert root.get(p, p) == root.get(first, first)
    assert len({root.get(p, p) for p in prints}) == len(set(expected))


def test_pipeline_drops_copies_that_differ_in_many_bits(spark):
    rng = np.random.default_rng(5)
    rows, changed = [], 0
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        copy = [*words[:30], "new", *words[31:90], "other", *words[91:]]  # 106 of 126 shingles are in both
        rows += [(2 * k, " ".join(words), "s"), (2 * k + 1, " ".join(copy), "t")]
        changed += (brute.fingerprint(rows[-1][1]) ^ brute.fingerprint(rows[-2][1])).bit_count() > 4
    rows += [(500, " ".join(words[:100] + [f"x{x}" for x in range(40)]), "u")]  # 96 of 156 shingles
    assert changed > 10
    left = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert {r.doc_id for r in left.collect()} == {*range(0, 120, 2), 500}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_codes_come_back(ranks):
    control, data = token_ids.pack(np.array(ranks, "<u4"))
    assert token_ids.unpack(control, data, len(ranks)).tolist() == ranks


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=9), max_size=20))
def test_codes_of_many_documents_are_those_of_each(docs):
    flat, counts = np.array([x for d in docs for x in d], "<u4"), np.array([len(d) for d in docs], np.int64)
    control, data = token_ids.pack_all(flat, counts)
    assert list(zip(control.to_pylist(), data.to_pylist())) == [token_ids.pack(np.array(d, "<u4")) for d in docs]
    assert token_ids.unpack_all(control, data, counts).tolist() == flat.tolist()


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_media_come_back(raw):
    payload = media.pad(raw)
    image = media.decode(media.encode(payload))
    assert image.payload() == payload
    rgb = image.rgb()
    assert rgb.shape == (image.height, image.width, 3)


def test_rgb_is_the_inverse_transform():
    image = media.decode(media.encode(media.pad(bytes(range(256)) * 4)))
    comp, n = image.components[0], np.arange(8)
    wave = np.array([[(np.sqrt(0.5) if u == 0 else 1) / 2 * np.cos((2 * i + 1) * u * np.pi / 16) for i in n] for u in n])
    block = np.zeros(64)
    block[media.ZIGZAG] = comp.coef[0]
    exact = np.clip(wave.T @ block.reshape(8, 8) @ wave + 128, 0, 255)
    cb, cr = (c.coef[0] for c in image.components[1:])
    assert exact.shape == (8, 8) and cb.shape == cr.shape == (64,)
    whole = np.floor((comp.coef[:1] @ media.BASIS + media.SCALE // 2) / media.SCALE).reshape(8, 8) + 128
    assert np.abs(np.clip(whole, 0, 255) - exact).max() < 1


@settings(max_examples=120, deadline=None)
@given(st.text("ab 1'\u00e9\n\u65e5.", max_size=300), st.lists(st.tuples(st.integers(0, 300), st.integers(0, 8), st.text("a 1'\n\u65e5", max_size=6)), max_size=8))
def test_edits_keep_counts(text, drawn):
    pre = token_counts.PreTokens(PATH, PATTERN)
    edits = token_counts.usable([(s, s + n, new) for s, n, new in drawn], len(text))
    tree = token_counts.Tree.unpacked(*token_counts.tree_of(text, pre).packed())
    changed = token_counts.apply_edits(tree, text, edits, pre)
    expected = text
    for start, end, new in reversed(edits):
        expected = expected[:start] + new + expected[end:]
    assert changed == expected
    assert [n for block in tree.blocks for n in block[0]] == list(map(len, pre.split.findall(changed)))
    assert tree.total == len(pre.encoding.encode_ordinary(changed))


def test_many_edits_of_a_long_text():
    import time

    pre, text = token_counts.PreTokens(PATH, PATTERN), "some word 12345 and " * 100_000
    tree, begin = token_counts.tree_of(text, pre), time.time()
    pre.encoded = 0
    changed = token_counts.apply_edits(tree, text, token_counts.masked("[0-9]+", "<n>")(text), pre)
    assert tree.total == len(pre.encoding.encode_ordinary(changed)) and pre.encoded < 500_000 and time.time() - begin < 60


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abcde"), min_size=1, max_size=12), st.lists(st.sampled_from("abcde"), max_size=40))
def test_myers_is_the_distance(item, text):
    numbers = {c: k for k, c in enumerate("abcde", 1)}
    least = brute.least_edits(item, text)
    got = decontaminate.myers([numbers[c] for c in item], [numbers[c] for c in text], len(item) - 1)
    assert (got[0] if got else None) == (least if least < len(item) else None)


def test_occurrences_at_the_end_of_a_text_are_found():
    rng = np.random.default_rng(11)
    item = [f"i{k}" for k in range(50)]
    index = decontaminate.Index.build([(1, " ".join(item))])
    cases = [(30, 25, [2, 12, 22, 32])] + [(30, int(rng.integers(1, 60)), sorted(rng.choice(50, int(rng.integers(0, 11)), replace=False).tolist())) for _ in range(300)]
    for before, gap, edits in cases:
        text = [f"b{k}" for k in range(before)] + item[:4] + [f"c{k}" for k in range(gap)] + [f"e{k}" if k in edits else w for k, w in enumerate(item)]
        least = brute.least_edits(item, text)
        assert [m[2] for m in index.matches([text])] == ([least] if least <= 10 else [])


def test_added_tokens_are_tokens(spark):
    from tokenizers import Tokenizer

    path, end = public_tokenizers.path("byte_bpe_50k.json"), "<|endoftext|>"
    texts = [f"{end}hello world", f"hello {end} world", f"hello{end}{end} a  b", f"x\u2003 y {end}", end, f"a <|endoftext {end}", "plain text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in token_ids.tokenise(docs, path).collect()}
    tokenizer = Tokenizer.from_file(path)
    assert found == {k: tokenizer.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)}


def test_stitched_ids_are_those_of_the_whole_text(spark):
    import hashlib

    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(["a", "b", " ", "  ", "'s", "1", "\u00e9", "\n", "\u65e5", "!"], int(rng.integers(0, 400)))) for _ in range(150)]
    texts += ["x" * 700, " " * 500 + "z", "a" * 300 + " " * 200 + "b" * 300, "it's " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoding = byte_bpe._codec(PATH, PATTERN)[0]
    want = {k: hashlib.sha256(np.array(encoding.encode_ordinary(t), "<u4").tobytes()).hexdigest() for k, t in enumerate(texts)}
    for chunk, overlap in ((64, 8), (1 << 16, 1 << 10)):
        found = {r.doc_id: r.ids_sha256 for r in byte_bpe.digests(docs, PATH, PATTERN, chunk=chunk, overlap=overlap).collect()}
        assert found == want
    for part, overlap in ((16, 4), (50, 1), (32, 31)):
        assert all(byte_bpe.encode_bytes(t, PATH, PATTERN, part, overlap) == np.array(encoding.encode_ordinary(t), "<u4").tobytes() for t in texts)
    compiled = byte_bpe._codec(PATH, PATTERN)[2]
    assert len(byte_bpe.stitched("some words of a text " * 200, compiled)) > 3


def test_network_against_plain_convolution():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 6, 7, 500, 517, 518, 2000)]
    net = quality.Network(rng.normal(0, 1, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), rng.normal(0, 1, quality.FILTERS).astype(np.float32), rng.normal(0, 1, 2 * quality.FILTERS).astype(np.float32), 0.1)

    def plain(text, net=net):
        text = text.ljust(quality.WIDTH, b"\0")
        places = [sum(net.filters[w][text[p + w]].astype(np.float64) for w in range(quality.WIDTH)) for p in range(len(text) - quality.WIDTH + 1)]
        starts, chunks = range(0, max(1, len(places) - (quality.CHUNK - quality.STEP)), quality.STEP), []
        for s in starts:
            chunks.append(np.maximum(np.max(places[s : s + quality.CHUNK], axis=0) + net.bias, 0))
        features = np.concatenate([np.max(chunks, axis=0), np.mean(chunks, axis=0)])
        return 1 / (1 + np.exp(-(features @ net.out + net.out_bias)))

    assert np.allclose(net.scores(texts, net.pairs()), [plain(t) for t in texts], atol=1e-4)
    data, sizes = quality.joined(texts)
    start, stop, _ = quality.chunk_bounds(sizes)
    where, best = quality.largest(net.filters, data, start, stop)
    whole = sum(net.filters[w][data[w : len(data) - quality.WIDTH + 1 + w]] for w in range(quality.WIDTH))
    assert all((best[k] == whole[a:b].max(axis=0)).all() and (where[k] == a + whole[a:b].argmax(axis=0)).all() for k, (a, b) in enumerate(zip(start, stop, strict=True)))


def test_network_learns_a_byte_pattern():
    rng = np.random.default_rng(6)
    make = lambda good: bytes(rng.integers(97, 105, int(rng.integers(20, 1200)), dtype=np.uint8)) + (b"zyx!" if good else b"") + bytes(rng.integers(97, 105, 30, dtype=np.uint8))
    labels = np.arange(300) % 2
    net = quality.fit([make(x) for x in labels], labels.astype(np.float64))
    scores = net.scores([make(x) for x in labels], net.pairs())
    assert ((scores > 0.5) == labels).mean() > 0.95


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=4), st.integers(1, 4), st.integers(0, 10**6))
def test_viterbi_is_the_best_path(sizes, states, seed):
    scores = np.random.default_rng(seed).normal(0, 2, (sum(sizes), states)).astype(np.float32)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    labels = language.viterbi(scores, bounds, 3.0)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            own = scores[np.arange(a, b), labels[a:b]].sum() - 3.0 * (np.diff(labels[a:b]) != 0).sum()
            assert abs(own - brute.best_path(scores[a:b].astype(np.float64), 3.0)) < 1e-2


def planted(rng) -> tuple[list[tuple[int, str]], dict[int, tuple[str, int, int]]]:
    """Texts with one thing of each kind, with and without cues, and texts with what only looks alike."""
    words = "of and the in town with over under long paths people walk slowly to market each day while rain falls".split()
    digits = lambda n: "".join(rng.choice(list("123456789"), n))
    pick = lambda *options: str(rng.choice(options))
    rows, truth = [], {}
    for k in range(480):
        v, t = None, "plain words only"
        match k % 12:
            case 0:
                v, t = ("secret", "".join(rng.choice(list("0123456789abcdef"), 40))), pick('token = "{}"', "api_key: {}", "we saw {} there", '"{}"')
            case 1:
                v, t = ("national", f"({digits(3)}) {digits(3)}-{digits(4)}"), pick("call {}", "phone: {}", "so {} then")
            case 2:
                v, t = ("name", pick(*pii.FIRST_NAMES, "Zora", "Ilko") + " " + pick("Walker", "Smith", "Keller", "Novak")), pick("signed {}, then", "by Dr. {} who", "met {} in", "said that {} wrote")
            case 3:
                v, t = ("address", f"{digits(2)} {pick('Oak', 'Hill', 'Mill')} {pick('Street', 'Road', 'Avenue')}"), pick("lives at {}, near", "home: {}.", "saw {} today")
            case 4:
                v, t = ("number", f"{digits(3)}-{digits(2)}-{digits(4)}"), pick("SSN {}", "had {} on it")
            case 5:
                v, t = ("number", f"DE{digits(20)}"), pick("IBAN {}", "sent to {} today")
            case 6:
                t = f"build release-candidate-{digits(2)} of part version 2"
            case 7:
                t = "The New Table stands. Open Free Road to North West"
            case 8:
                t = "page 000 123 4567 of order 000 555 1234"
            case 9:
                t = f"commit feature-branch-name-{digits(1)}"
            case 10:
                t = "Thursday March is near; version 2024-10-11-alpha build +1 (017) 555-7713"
        head = " ".join(rng.choice(words, 8)) + " "
        rows.append((k, head + (t.format(v[1]) if v else t) + " " + " ".join(rng.choice(words, 5))))
        if v:
            start = len(head) + t.index("{}")
            truth[k] = (v[0], start, start + len(v[1]))
    return rows, truth


def test_added_spans_find_what_is_planted(spark):
    rows, truth = planted(np.random.default_rng(5))
    found = {r.doc_id: {(s.split(":")[0], *map(int, s.split(":")[1:])) for s in r.spans.split(",") if s} for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {k: {s for s in spans if s[0] in pii.MORE} for k, spans in found.items()}
    for kind in pii.MORE:
        own = [k for k, t in truth.items() if t[0] == kind]
        assert sum(truth[k] in added[k] for k in own) >= 0.9 * len(own)
    assert sum(len(s - {truth.get(k)}) for k, s in added.items()) <= 0.05 * len(truth)


@pytest.mark.parametrize("factors, size, restart", [([(1, 1)] * 3, (20, 13), 0), ([(2, 1), (1, 1), (1, 1)], (40, 17), 3), ([(2, 2), (1, 1), (1, 1)], (33, 35), 2), ([(1, 1)], (70, 9), 4)])
def test_any_progressive_file_is_decoded(factors, size, restart):
    rng, (width, height) = np.random.default_rng(width_seed := size[0]), size
    assert width_seed
    hmax, vmax = max(h for h, _ in factors), max(v for _, v in factors)
    down, across = -(-height // (8 * vmax)), -(-width // (8 * hmax))
    planes, alone = [], []
    for h, v in factors:
        blocks = rng.integers(-9, 10, (down * v * across * h, 64)) * (rng.random((down * v * across * h, 64)) < rng.choice([0.0, 0.03, 0.3], (down * v * across * h, 1)))
        rows, cols = -(-(-(-height * v // vmax)) // 8), -(-(-(-width * h // hmax)) // 8)
        inside = (np.arange(down * v)[:, None] < rows) & (np.arange(across * h)[None, :] < cols)
        blocks[~inside.ravel(), 1:] = 0  # scans of one component leave padding blocks out
        planes.append(blocks)
        alone.append((down * v, across * h))
    quant = [int(q) for q in rng.integers(1, 9, 64)]
    image = media.decode(brute.progressive_file(planes, factors, width, height, restart, quant))
    for c, blocks in zip(image.components, planes, strict=True):
        assert (c.coef == blocks).all()
    wave = np.array([[(np.sqrt(0.5) if u == 0 else 1) / 2 * np.cos((2 * i + 1) * u * np.pi / 16) for i in range(8)] for u in range(8)])
    full = []
    for blocks, (rows, cols), (h, v) in zip(planes, alone, factors, strict=True):
        plane = np.zeros((8 * rows, 8 * cols))
        for k, block in enumerate(blocks):
            natural = np.zeros(64)
            natural[media.ZIGZAG] = block * quant
            plane[8 * (k // cols) : 8 * (k // cols) + 8, 8 * (k % cols) : 8 * (k % cols) + 8] = np.clip(np.round(wave.T @ natural.reshape(8, 8) @ wave) + 128, 0, 255)
        full.append(np.kron(plane, np.ones((vmax // v, hmax // h)))[:height, :width])
    if len(full) == 1:
        expected = np.stack(full * 3, axis=2)
    else:
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        expected = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2), 0, 255)
    assert np.abs(image.rgb().astype(float) - expected).max() <= 3


def test_hot_groups_and_pairs_that_the_first_misses(spark):
    from codequarry.llm import near_copies

    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 9000, 160)]
    rows = []
    for k in range(300):  # a large group: each has one or two words changed
        own = list(base)
        for p in rng.choice(160, 2, replace=False):
            own[p] = f"n{k}"
        rows.append((k, " ".join(own)))
    for k in range(300, 340):  # a chain of texts, each like the next
        base = base[6:] + [f"c{k}-{j}" for j in range(6)]
        rows.append((k, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    root = {r.node: r.root for r in components.components(near_copies.links(docs.withColumnRenamed("doc_id", "fp"))).collect()}
    expected = brute.copies([t for _, t in rows])
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(expected[k], set()).add(root.get(k, k))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_groups_are_all_that_share_a_variant():
    from codequarry.llm import near_copies

    rng, before = np.random.default_rng(2), near_copies.SORTED
    try:
        for near_copies.SORTED in (before, 200):
            values = rng.integers(0, 1 << 12, 150, dtype=np.uint64)
            found = set()
            for rows, begin in near_copies.groups(values, 12):
                for own in np.split(rows, begin[1:]):
                    found |= {(min(a, b), max(a, b)) for a in own.tolist() for b in own.tolist() if a != b}
            assert found == {(i, j) for i in range(150) for j in range(i + 1, 150) if np.bitwise_count(values[i] ^ values[j]) <= 2}
    finally:
        near_copies.SORTED = before


def test_labelers_that_agree_are_trusted():
    counts = {(1, 1, 1, 0): 40, (-1, 0, -1, 0): 200, (1, 0, 0, 0): 5, (0, 0, 0, 0): 60}
    tables, belief = pii.reliabilities(counts)
    assert belief[1, 1, 1, 0] > 0.9 > 0.1 > belief[-1, 0, -1, 0]
    assert tables[0][1][1] > tables[0][1][0]


def test_a_labeler_that_stands_against_is_no_evidence_for():
    """License names: the gazetteer says no, a comma behind says yes, and there is nothing else."""
    for counts in ({(0, -1, 0, 1, 0): 136, (0, -1, 0, 0, 0): 30}, {(0, -1, 0, 1, 0): 57, (0, 0, 0, -1, 0): 200}, {(0, -1, 0, 0, 0): 9, (0, 0, 0, 0, 0): 4}):
        tables, belief = pii.reliabilities(counts)
        assert all(b < 0.5 for p, b in belief.items() if p[1] == -1)
        assert all(v * (t[v][1] - t[v][0]) >= -1e-12 for t in tables for v in (-1, 1))
    assert pii.reliabilities({(0, 0, 0, 0, 0): 10, (-1, 0, 0, 0, 0): 3}) == ([], {(0, 0, 0, 0, 0): 0.0, (-1, 0, 0, 0, 0): 0.0})


def test_no_name_in_license_lines_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    names = [texts[r.doc_id][int(a) : int(b)] for r in pii.personal_data(docs).collect() for kind, a, b in (x.split(":") for x in r.spans.split(",") if x) if kind == "name"]
    assert not [n for n in names if "License" in n or "Public" in n or "Apache" in n], names


@pytest.mark.parametrize("lost", [0, 1])
def test_trees_can_be_edited_after_a_lost_run(spark, frame, tmp_path, lost):
    root = tmp_path / "trees"
    trees = token_counts.TreeTable(spark, str(root), PATH, PATTERN)
    left = root / str(lost)
    if lost:
        trees.build(frame)
    (left / "_temporary").mkdir(parents=True)
    (left / "part-0.parquet").write_bytes(b"half")
    if not lost:
        trees.build(frame)
    trees.edit(token_counts.masked("[0-9]+", "n"))
    assert lost not in trees.versions() and len(trees.versions()) == 2
    assert token_counts.counts_over_versions(trees).count() == size(frame) == trees.current().count()
    with pytest.raises(ValueError, match="already"):
        trees.build(frame)


def test_clusters_of_texts_that_are_just_not_alike_are_compared_in_blocks(spark, monkeypatch):
    """A common passage makes all texts near by their bits; each pair of 0.8 must be joined, and nothing else, though blocks are small and edges fewer than texts."""
    from codequarry.llm import components, near_copies

    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rng = np.random.default_rng(5)
    passage = " ".join(f"p{k}" for k in range(300))
    texts = [f"{passage} " + " ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 70)) for _ in range(60)]
    texts += [t + " one more end" for t in texts[:12]]
    sets = [near_copies.shingles(t.encode(), 5) for t in texts]
    want = [(i, j) for i in range(len(texts)) for j in range(i) if near_copies.jaccard(sets[i], sets[j]) >= 0.8]
    assert len(want) == 12
    links = near_copies.links(spark.createDataFrame(list(enumerate(texts)), "fp long, text string"))
    roots = {r.node: r.root for r in components.components(links).collect()}
    assert sorted((max(a, b), min(a, b)) for a, b in links.collect()) == sorted(want) and len(set(roots.values())) == 12


def test_forest_joins_with_fewer_pairs_than_nodes():
    from codequarry.llm import near_copies

    rng, parent = np.random.default_rng(3), np.arange(500)
    a, b = rng.integers(0, 250, 5000), rng.integers(0, 250, 5000)
    some = [near_copies.forest(parent, a[k : k + 700] + s, b[k : k + 700] + s) for s in (0, 250) for k in range(0, 5000, 700)]
    assert sum(len(x) for x, _ in some) == 498 and len(set(parent.tolist())) == 2


def test_keys_are_told_without_their_rows(spark):
    """All keys of the table may be among it, few others may; so a join needs no shuffle of the others."""
    from codequarry.llm import rows

    keys = spark.range(0, 60_000, 3).selectExpr("md5(cast(id as string)) as k")
    asked = spark.range(60_000).selectExpr("id", "md5(cast(id as string)) as k").withColumn("may", rows.may_be_among(keys, "k"))
    counts = {(r.inside, r.may): r["count"] for r in asked.selectExpr("id % 3 = 0 as inside", "may").groupBy("inside", "may").count().collect()}
    assert counts[True, True] == 20_000 and (True, False) not in counts and counts.get((False, True), 0) < 2_800
    assert not spark.range(100).filter(rows.may_be_among(spark.range(0), "id")).count()
