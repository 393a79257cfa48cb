"""Language identification of whole, possibly mixed texts.

Script ranges narrow the languages that a word can have; a character n-gram model scores the word in those; Viterbi
with a penalty for each switch labels spans of words. A document's language is the one with most
letters in its spans.

A word is a run of letters of one script, at most ``LONGEST`` of them: longer runs and runs of more scripts, as in texts
without spaces, are consecutive words, so every letter is learned from, scored and labelled.

Training counts n-grams with Spark over a bounded sample of labelled rows (``max_rows``, by hash of ``doc_id`` and text), whole texts; rows equal in id, text
and label are learned from once. A null text or one without a letter is ``und`` with score 0 and no spans. Rows are
independent of each other; null labels are not learned from; extra columns are ignored. If nothing can be learned, every text is ``und``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: First and last code points of scripts.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
OTHER = len(SCRIPTS)
BUCKETS = 1 << 16
#: Words that a worker remembers the scores of; the memory starts anew beyond it.
CACHE_WORDS = 200_000
#: Words of a text that one step of the search takes at once.
SEGMENT = 128
#: Words at once times languages squared: the ways back that the search remembers.
WAYS = 1 << 25
WORD = r"\p{L}[\p{L}\p{M}]*"
UNKNOWN = "und"


@lru_cache(maxsize=4096)
def script_of(char: str) -> int:
    point = ord(char)
    return next((k for k, ranges in enumerate(SCRIPTS.values()) if any(a <= point <= b for a, b in ranges)), OTHER)


LONGEST = 64
#: Latin words, and what shows that a text may have others.
_PLAIN = re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]{1,%d}" % LONGEST)
_OTHERS = re.compile("[\u00b5\u0250-\u1fff\u2070-\u209f\u20c0-\U0010ffff]")


def parts_of(run: str) -> list[str]:
    """Words of a run of letters and their marks; a mark has the script of its letter."""
    out, start, letter, own = [], 0, 0, script_of(run[0])
    for k, char in enumerate(run[1:], 1):
        mark = unicodedata.category(char)[0] == "M"
        script = own if mark else script_of(char)
        if script != own or k - start == LONGEST:
            cut = letter if mark and letter > start else k
            out.append(run[start:cut])
            start, own = cut, script
        if not mark:
            letter = k
    return [*out, run[start:]]


@lru_cache(maxsize=1)
def _uniform():
    """Matches runs that are one word."""
    import regex

    classes = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) for ranges in SCRIPTS.values())
    return regex.compile("|".join(f"[{c}][{c}\\p{{M}}]{{0,{LONGEST - 1}}}" for c in classes)).fullmatch


def words_of(text: str, general) -> list[str]:
    """Words in runs that match ``WORD``, which ``general`` is compiled from; most texts have letters that a plainer pattern finds faster."""
    if not _OTHERS.search(text):
        return _PLAIN.findall(text)
    one = _uniform()
    return [w for run in general.findall(text) for w in ((run,) if one(run) else parts_of(run))]


_MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the one- to three-character grams of each word with its ends, and of the word itself, and the number of them by word."""
    marked = [f" {w} " for w in words]
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    points = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(points)) - start[owner]
    powers = np.cumprod(np.full(size.max(initial=0), _MIX, np.uint64))
    hashes, owners = [], []
    for n in (1, 2, 3):
        at = np.flatnonzero(place <= size[owner] - n)
        value = np.zeros(len(at), np.uint64)
        for k in range(n):
            value = value * _MIX + points[at + k]
        hashes.append(value * np.uint64(n + 1))
        owners.append(owner[at])
    if words:
        hashes.append(np.add.reduceat(points * powers[place], start))
        owners.append(np.arange(len(words)))
    value, of = np.concatenate(hashes), np.concatenate(owners)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    value ^= value >> np.uint64(32)
    order = np.argsort(of, kind="stable")
    return (value[order] % np.uint64(BUCKETS)).astype(np.int64), np.bincount(of, minlength=len(words))


class _Numbers(dict):
    """Numbers for words, given as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Model:
    langs: list[str]
    #: log-likelihood of each gram bucket (row) in each language
    weights: np.ndarray
    #: whether a language (column) occurs in a script (row)
    allowed: np.ndarray
    switch: float
    _numbers: _Numbers = field(default_factory=_Numbers, repr=False)
    _scores: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_numbers": _Numbers(), "_scores": None}

    def _new_scores(self, words: list[str]) -> np.ndarray:
        low = [w.lower() for w in words]
        buckets, count = grams(low)
        first = np.cumsum(count) - count
        mean = np.add.reduceat(self.weights[buckets], first, axis=0) / count[:, None].astype(np.float32)
        longer = np.sqrt(np.minimum(np.fromiter(map(len, low), np.int64, len(low)) + 2, 20)).astype(np.float32)
        row = mean * longer[:, None]
        allowed = self.allowed[[script_of(w[0]) for w in low]]
        best = np.where(allowed, row, -np.inf).max(axis=1, keepdims=True)
        none = ~allowed.any(axis=1, keepdims=True)
        return np.where(none, 0, np.where(allowed, row - np.where(none, 0, best), -30)).astype(np.float32)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Rows of scores; a word whose script no language has counts for none. Scores are remembered by word."""
        numbers = self._numbers
        if len(numbers) > CACHE_WORDS:
            numbers.clear()
        if not numbers:
            self._scores = np.zeros((0, len(self.langs)), np.float32)
        at = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        if len(numbers) > len(self._scores):
            fresh = list(islice(numbers, len(self._scores), None))
            self._scores = np.concatenate([self._scores, *(self._new_scores(fresh[k : k + 50_000]) for k in range(0, len(fresh), 50_000))])
        return self._scores[at]


def train(docs: DataFrame, max_rows: int = 4000, switch: float = 3.0) -> Model:
    """Counts by Spark over at most ``max_rows`` labelled rows, whole texts: those with the least hash of the row.

    Texts are read twice for it, once to hash them and once for the sample, but only those of the sample move.
    """
    rows = docs.filter("lang is not null and text is not null").select("lang", "text", F.xxhash64("doc_id", "text", "lang").alias("h"))
    last = rows.select("h").orderBy("h").limit(max_rows).agg(F.max("h")).first()[0]
    sample = rows.filter(F.col("h") <= F.lit(last)).dropDuplicates(["h"])
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), F.lit(1))).alias("word"))
    counted = words.groupBy("lang", "word").count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            parts = [(lang, w, n) for lang, run, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "count")), strict=True) for w in parts_of(run)]
            langs, found, counts = zip(*parts, strict=True) if parts else ((), (), ())
            for lang in set(langs):
                own = [k for k, x in enumerate(langs) if x == lang]
                row = totals.setdefault(lang, np.zeros(BUCKETS + OTHER + 1, np.int64))
                n = np.array([counts[k] for k in own], np.int64)
                buckets, per_word = grams([found[k] for k in own])
                np.add.at(row, buckets, np.repeat(n, per_word))
                np.add.at(row, BUCKETS + np.array([script_of(found[k][0]) for k in own]), n)
        for lang, row in totals.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(row[at], pa.int64())], ["lang", "feature", "n"])

    # At most a row for each language and feature.
    rows = counted.mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in rows})
    counts = np.zeros((BUCKETS + OTHER + 1, len(langs)))
    place = {x: k for k, x in enumerate(langs)}
    for r in rows:
        counts[r.feature, place[r.lang]] = r.n
    grams_of, scripts = counts[:BUCKETS], counts[BUCKETS:]
    weights = np.log((grams_of + 0.5) / (grams_of.sum(axis=0) + 0.5 * BUCKETS))
    allowed = scripts > 0.005 * scripts.sum(axis=0)
    return Model(langs, weights.astype(np.float32), allowed, switch)


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word of the texts between ``bounds``, by score less ``penalty`` a switch.

    Texts are cut into segments; all segments are searched at once from every entry state, then
    the segments of a text are put together by the best state at each cut.
    """
    n, k = scores.shape
    if n == 0:
        return np.zeros(0, np.int64)
    starts = np.concatenate([np.arange(a, b, SEGMENT) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a])
    stops = np.minimum(np.append(starts[1:], n), starts + SEGMENT)
    length = stops - starts
    order = np.argsort(-length, kind="stable")
    starts_o, length_o = starts[order], length[order]
    move = penalty * (1 - np.eye(k, dtype=np.float32))
    best = np.repeat(-move[None], len(starts), axis=0)  # [segment, entry, state before the first word's score]
    came = np.zeros((SEGMENT, len(starts), k, k), np.uint8)
    for t in range(int(length.max())):
        live = int(np.searchsorted(-length_o, -t, side="left"))
        now = best[:live]
        if t:
            top = now.max(axis=2, keepdims=True) - penalty
            arg = now.argmax(axis=2)[:, :, None]
            stay = now >= top
            came[t, :live] = np.where(stay, np.arange(k), arg)
            now = np.where(stay, now, top)
        best[:live] = now + scores[starts_o[:live] + t][:, None, :]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    gain = best[back]
    # Segments of one text in a row: state at the end of each, for the best path so far.
    first = np.isin(starts, bounds[:-1])
    entry, exit_ = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    if first.all():
        flat = gain.reshape(len(starts), -1)
        entry, exit_ = np.divmod(flat.argmax(axis=1), k)
    else:
        begin = np.flatnonzero(first)
        for a, b in zip(begin, np.append(begin[1:], len(starts)), strict=True):
            value, origin = np.zeros(k), []
            for s in range(a, b):
                step = value[:, None] + gain[s]
                origin.append(step.argmax(axis=0))
                value = step.max(axis=0)
            state = int(value.argmax())
            for s in range(b - 1, a - 1, -1):
                exit_[s], state = state, int(origin[s - a][state])
                entry[s] = state
    out = np.zeros(n, np.int64)
    state, entry_o = exit_[order], entry[order]
    for t in range(int(length.max()) - 1, -1, -1):
        live = int(np.searchsorted(-length_o, -t, side="left"))
        out[starts_o[:live] + t] = state[:live]
        if t:
            state[:live] = came[t, np.arange(live), entry_o[:live], state[:live]]
    return out


def _texts(batch: pa.RecordBatch, most: int) -> Iterator[tuple[int, list[list[tuple[int, str]]]]]:
    """First row and words (with their places) of texts, about ``most`` words at a time."""
    import regex

    word, held, first, n = regex.compile(WORD), [], 0, 0
    for k, text in enumerate(batch.column(0)):
        held.append(words_of(text.as_py() or "", word))
        n += len(held[-1])
        if n > most:
            yield first, held
            held, first, n = [], k + 1, 0
    if held:
        yield first, held


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to ``keep``, ``lang_pred``, ``score`` (share of letters in that language) and ``spans``, the runs of words: language, first word, words."""
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    spans_type = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        k = len(model.langs)
        for batch in batches:
            for first, texts in _texts(batch, max(SEGMENT, min(400_000, WAYS // max(1, k * k)))):
                bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                words = [w for t in texts for w in t]
                labels = viterbi(model.word_scores(words), bounds, model.switch) if k else np.zeros(len(words), np.int64)
                letters = np.fromiter(map(len, words), np.int64, len(words))
                owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
                weight = np.bincount(owner * max(k, 1) + labels, letters, len(texts) * max(k, 1)).reshape(len(texts), -1)
                total = weight.sum(axis=1)
                best = weight.argmax(axis=1)
                change = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(labels, prepend=-1) != 0))
                runs = np.diff(np.append(change, len(words)))
                spans: list[list[dict]] = [[] for _ in texts]
                preds, scores = [], []
                for t, size in enumerate(total):
                    known = bool(size) and k > 0
                    preds.append(model.langs[best[t]] if known else UNKNOWN)
                    scores.append(float(weight[t, best[t]] / size) if known else 0.0)
                if k:
                    for at, n, label, t in zip((change - bounds[owner[change]]).tolist(), runs.tolist(), labels[change].tolist(), owner[change].tolist(), strict=True):
                        spans[t].append({"lang": model.langs[label], "first_word": at, "words": n})
                yield pa.RecordBatch.from_arrays([*(c.slice(first, len(texts)) for c in batch.columns[1:]), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, spans_type)], names)

    rows = docs.select(F.col("text").cast("string").alias("__text"), *(F.col(f"`{c}`") for c in keep))
    out = StructType([*rows.schema.fields[1:], *StructType.fromDDL("lang_pred string, score double, spans array<struct<lang:string,first_word:int,words:int>>").fields])
    names = out.fieldNames()
    return rows.mapInArrow(run, out)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id's text divides by five."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
