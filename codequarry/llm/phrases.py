"""Collocations by suffix sorting: every phrase is counted as a prefix of a suffix.

Each word of a piece begins a suffix of at most ``max_words`` words. Suffixes are counted in their task, shuffled by language and first word, and sorted in
reverse lexicographic order, so that one stack of open prefixes counts all of them in a single pass. A first word of any frequency is dealt out by its
second word, so that only counts of single words come in several parts, which are added up; counts of phrases are whole. The parts of a
candidate, its first words and the rest, are joined afterwards.

A word is anything between spaces and tabs in a piece between ``.,;:!?`` and line ends. Null and empty texts have no words. A null language counts as
'und'. Repeated rows count as often as they are there. Ties end with the order of phrases by their bytes. Empty tables give no rows. Extra columns of any
name are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.ranks import in_order, within
from codequarry.llm.units import slices
from codequarry.sources.scratch import stage

UNKNOWN = "und"
#: ASCII letters in lower case, tabs as spaces, what ends a piece as line ends.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
#: Bytes of text whose suffixes are counted at once; a longer piece is counted whole.
STRETCH = 8 << 20
#: Parts that a first word is dealt into.
DEAL = 64


def _stretches(texts: Iterator[str | None]) -> Iterator[bytes]:
    """Folded texts, a line end after each, joined and cut at line ends into stretches."""
    waiting, size = [], 0
    for text in texts:
        folded, at = (text or "").encode().translate(_FOLD) + b"\n", 0
        while at < len(folded):
            end = folded.find(b"\n", min(len(folded) - 1, at + max(0, STRETCH - size))) + 1
            waiting.append(folded[at:end])
            size, at = size + end - at, end
            if size >= STRETCH:
                yield b"".join(waiting)
                waiting, size = [], 0
    if waiting:
        yield b"".join(waiting)


def _escaped(text: str) -> str:
    """``text`` without the separator of keys and in the same order."""
    return text.replace("\x01", "\x01\x02").replace("\0", "\x01\x01")


def _plain(text: str) -> str:
    return text.replace("\x01\x01", "\0").replace("\x01\x02", "\x01")


def _suffixes(stretch: bytes, max_words: int, lang: str) -> tuple[pa.Array, np.ndarray]:
    """Keys of the distinct suffixes of a stretch, and how often each is there."""
    parts = pc.split_pattern(pa.array([stretch.replace(b"\n", b" \n ").decode()]), " ").flatten().dictionary_encode()
    words, codes = parts.dictionary, parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    place = {w: k for k, w in enumerate(words.to_pylist())}
    codes = codes[codes != place.get("", -1)]
    end = place["\n"]
    codes = np.concatenate([codes, np.full(max_words, end)])
    columns, ended = [codes[: len(codes) - max_words]], codes[: len(codes) - max_words] == end
    begins = ~ended
    for k in range(1, max_words):
        column = codes[k : len(codes) - max_words + k]
        ended = ended | (column == end)
        columns.append(np.where(ended, -1, column))
    columns = [c[begins] for c in columns]
    if not len(columns[0]):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    # Numbers of distinct prefixes, a word longer each time, stay below the number of suffixes.
    number = columns[0]
    for column in columns[1:]:
        _, number = np.unique(number * (len(words) + 1) + column + 1, return_inverse=True)
    _, first, n = np.unique(number, return_index=True, return_counts=True)
    if any("\0" in w or "\x01" in w for w in place):
        words = pa.array([_escaped(w) for w in place], pa.string())
    taken = [words.take(pa.array(c[first], mask=c[first] < 0)) for c in columns]
    return pc.binary_join_element_wise(_escaped(lang), *taken, "\0", null_handling="skip"), n


def suffix_counts(docs: DataFrame, max_words: int = 3) -> DataFrame:
    """``key`` (language and words, each ended by a zero but the last) and ``n``: the suffixes of each task's stretches with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = pc.fill_null(batch.column("lang"), UNKNOWN)
            for lang in pc.unique(langs).to_pylist():
                texts = batch.column("text").filter(pc.equal(langs, lang))
                for stretch in _stretches(t.as_py() for some in slices(texts) for t in some):
                    keys, n = _suffixes(stretch, max_words, lang)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(n)], ["key", "n"])

    return docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(run, "key string, n long")


def dealt(suffixes: DataFrame) -> DataFrame:
    """Suffixes by language and first word, each first word in up to ``DEAL`` parts by its second word."""
    two = F.substring_index("key", "\0", 3)
    part = F.pmod(F.hash(F.substring_index(two, "\0", -1)), F.lit(DEAL))
    return suffixes.repartition(F.substring_index("key", "\0", 2), part)


def _differs(column: pa.Array) -> np.ndarray:
    """Whether a value isn't the one before it; nulls are equal to each other."""
    now, before = column.slice(1), column.slice(0, max(0, len(column) - 1))
    other = pc.or_(pc.fill_null(pc.not_equal(now, before), False), pc.xor(now.is_null(), before.is_null()))
    return other.to_numpy(zero_copy_only=False)


def _named(langs: pa.Array, phrases: pa.Array, words: int, f: np.ndarray) -> pa.RecordBatch:
    texts = [pa.array([_plain(x) for x in c.to_pylist()], pa.string()) if pc.any(pc.match_substring(c, "\x01")).as_py() else c for c in (langs, phrases)]
    return pa.RecordBatch.from_arrays([*texts, pa.array(np.full(len(f), words, np.int32)), pa.array(f)], ["lang", "phrase", "words", "f"])


def count_prefixes(suffixes: DataFrame, min_count: int, max_words: int = 3) -> DataFrame:
    """``lang``, ``phrase``, ``words`` and ``f`` of every prefix: phrases with at least ``min_count``, and single words, in several parts, with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The stack has the open prefix of each length: language, phrase, and how often it has come so far.
        stack: list[list | None] = [None] * max_words
        last: list[str | None] | None = None

        def closed(depth: int) -> Iterator[pa.RecordBatch]:
            if (top := stack[depth]) is not None and (depth == 0 or top[2] >= min_count):
                yield _named(pa.array([top[0]]), pa.array([top[1]]), depth + 1, np.array([top[2]], np.int64))

        for batch in batches:
            if not batch.num_rows:
                continue
            # Language and words; null behind the end of a suffix.
            split = pc.split_pattern(batch.column("key"), "\0")
            ends, begin = split.offsets.to_numpy()[1:], split.offsets.to_numpy()[:-1]
            keys = [split.values.take(pa.array(begin + k, mask=begin + k >= ends)) for k in range(max_words + 1)]
            n, new = batch.column("n").to_numpy(), np.zeros(batch.num_rows, bool)
            for depth in range(max_words):
                for k in (0, 1) if depth == 0 else (depth + 1,):
                    new[1:] |= _differs(keys[k])
                    new[0] |= last is None or keys[k][0].as_py() != last[k]
                there = keys[depth + 1].is_valid().to_numpy(zero_copy_only=False)
                counted, starts = np.where(there, n, 0), np.flatnonzero(new & there)
                if stack[depth] is not None:
                    stack[depth][2] += int(counted[: starts[0] if len(starts) else len(counted)].sum())
                if not len(starts):
                    continue
                sums = np.add.reduceat(counted, starts)
                yield from closed(depth)
                keep = sums[:-1] >= (min_count if depth else 1)
                rows = pa.array(starts[:-1][keep])
                phrase = pc.binary_join_element_wise(*(c.take(rows) for c in keys[1 : depth + 2]), " ")
                yield _named(keys[0].take(rows), phrase, depth + 1, sums[:-1][keep])
                stack[depth] = [keys[0][starts[-1]].as_py(), " ".join(c[starts[-1]].as_py() for c in keys[1 : depth + 2]), int(sums[-1])]
            last = [c[batch.num_rows - 1].as_py() for c in keys]
        for depth in range(max_words):
            yield from closed(depth)

    return dealt(suffixes).sortWithinPartitions(F.col("key").desc()).mapInArrow(run, "lang string, phrase string, words int, f long")


def _words(phrase: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, n), " ")


def collocations(docs: DataFrame, min_count: int = 10, max_words: int = 3, top: int = 2000, covered: int = 50) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's first ``top`` phrases of 2 to ``max_words`` words.

    ``a``, ``l`` and ``r`` count the phrase and its two parts at the cut with the lowest score ``floor(1000000 a a / (l r))``, ``n`` all words of the language. A phrase
    goes if a longer one with at least ``covered`` hundredths of its count has it inside.
    """
    if max_words < 2 or min_count < 1:
        raise ValueError("phrases have at least two words and are there at least once")
    counted = stage(count_prefixes(suffix_counts(docs, max_words), min_count, max_words), "prefix-counts")
    single = stage(counted.filter("words = 1").groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "word-counts")
    totals = single.groupBy("lang").agg(F.sum("f").alias("n"))
    longer = counted.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    parts = counted.filter("words > 1").select("lang", "phrase", "f").union(single.filter(F.col("f") >= min_count))

    cuts = longer.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("*", _words(F.col("phrase"), F.lit(1), F.col("k")).alias("left"), _words(F.col("phrase"), F.col("k") + 1, F.col("words")).alias("right"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    # Counts of up to 12 digits: 30 digits above, 24 below the line, in decimals of 38.
    a, l, r = (f"cast({c} as decimal(15, 0))" for c in "alr")
    score = F.expr(f"(cast(1000000 as decimal(7, 0)) * ({a} * {a})) div ({l} * {r})")
    least = cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = longer.filter("words > 2").select("lang", "words", "phrase", "a", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("m"))
    inner = inner.select("lang", "a", "phrase", "m", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("at"))
    inside = inner.groupBy("lang", _words(F.col("phrase"), F.col("at"), F.col("m")).alias("phrase")).agg(F.max("a").alias("most"))
    kept = least.join(inside, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.lit(100) * F.col("most") < F.lit(covered) * F.col("a")))

    # Languages of any size are sorted in ranges; no task ranks a language alone.
    best = stage(kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), "candidates")
    placed = within(in_order(best, F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase"), label="ranked-phrases"), "lang")
    first = placed.withColumn("rank", F.col("place") - F.col("first") + 1).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same for DuckDB over the documents table, with exact integers of 128 bits.
ORACLE_SQL = """
WITH folded AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM folded
), split AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda w: w <> '') AS w FROM pieces
), placed AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split
), phrases AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, m FROM placed, (SELECT unnest([1, 2, 3]) AS m) WHERE i + m - 1 <= len(w)
), f AS (
  SELECT lang, phrase, m, count(*) AS f FROM phrases GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
), longer AS (
  SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10
), cuts AS (
  SELECT lang, phrase, m, a, w, unnest(range(1, m)) AS k FROM longer
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 :], ' ')
), least AS (
  SELECT lang, phrase, a, unnest(min({'score': score, 'k': k, 'l': l, 'r': r})) FROM scored GROUP BY lang, phrase, a
), inside AS (
  SELECT lang, inner_phrase, max(a) AS most
  FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inner_phrase FROM longer WHERE m = 3) GROUP BY lang, inner_phrase
), kept AS (
  SELECT l.* FROM least l LEFT JOIN inside i ON i.lang = l.lang AND i.inner_phrase = l.phrase WHERE i.most IS NULL OR 100 * i.most < 50 * l.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
