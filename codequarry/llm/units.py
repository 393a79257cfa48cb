"""Text cut into units that a byte-level BPE encodes independently, with each distinct unit encoded once.

A unit starts at a space that follows a non-space character: no match of the pre-tokeniser's
pattern crosses such a place, and its look-ahead only inspects white space before the place. The
ids of a text are therefore the ids of its units in order. Texts with one of the tokenizer's added tokens are units of their own.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of Unicode and of Python, for RE2; a superset is safe, it only makes units longer.
_SPACE_BEFORE_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_CUT = re.compile(r"(?<=\S)(?= )")
#: Texts are handled in slices of about so many bytes.
SLICE_BYTES = 8 << 20
#: Units of at most so many characters, the first that come, are remembered by a worker, with their ids in about so many bytes; the frequent ones are among them.
CACHE_CHARS, CACHE_BYTES = 64, 96 << 20

Encode = Callable[[list[str]], list[bytes]]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Parts of ``texts`` of about ``most`` bytes; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield texts.slice(start, stop - start)
        start = stop


class UnitEncoder:
    """Ids of whole texts from ``encode``, which gives each unit's ids as little-endian uint32 bytes."""

    def __init__(self, encode: Encode, whole: list[str] | None = None):
        """Texts that contain one of the strings ``whole`` aren't cut."""
        self._encode = encode
        self._whole = "|".join(map(re.escape, whole or []))
        self._known: dict[str, bytes] = {}
        self._room = CACHE_BYTES

    def _values(self, units: list[str]) -> list[bytes]:
        known = self._known
        missing = list(dict.fromkeys(u for u in units if u not in known))
        fresh = dict(zip(missing, self._encode(missing), strict=True)) if missing else {}
        values = [known[u] if u in known else fresh[u] for u in units]
        if self._room > 0:
            short = {u: ids for u, ids in fresh.items() if len(u) <= CACHE_CHARS}
            known.update(short)
            self._room -= sum(120 + len(u) + len(ids) for u, ids in short.items())
        return values

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` (null: empty) in order, and the number of ids of each text."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, _SPACE_BEFORE_SPACE).to_numpy(zero_copy_only=False)
        whole = pc.match_substring_regex(texts, self._whole).to_numpy(zero_copy_only=False) if self._whole else np.zeros(len(texts), bool)
        odd = odd | whole
        plain = pc.if_else(pa.array(odd), "", texts)
        parts = pc.split_pattern(plain, " ")
        offsets = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        # The first part of a text has no space before it; odd texts are cut by the slower rule.
        later = [" " + x for x in coded.dictionary.to_pylist()]
        first = parts.flatten().take(pa.array(offsets[:-1])).to_pylist()
        cut = {i: [texts[i].as_py()] if whole[i] else _CUT.split(texts[i].as_py()) for i in np.flatnonzero(odd)}
        for i, units in cut.items():
            first[i] = units[0]
        rest = [u for units in cut.values() for u in units[1:]]
        table = self._values(later + first + rest)
        lens = np.fromiter(map(len, table), np.int64, len(table)) >> 2
        starts = np.cumsum(lens) - lens
        flat = np.frombuffer(b"".join(table), "<u4")
        picks = coded.indices.to_numpy().astype(np.int64)
        picks[offsets[:-1]] = len(later) + np.arange(len(first))
        counts = np.diff(offsets).astype(np.int64)
        if cut:
            at, extra, base = [], [], len(later) + len(first)
            for i, units in cut.items():
                at.append(np.full(len(units) - 1, offsets[i + 1]))
                extra.append(base + np.arange(len(units) - 1))
                base += len(units) - 1
                counts[i] += len(units) - 1
            picks = np.insert(picks, np.concatenate(at), np.concatenate(extra))
        each = lens[picks]
        ends = np.cumsum(each)
        out = flat[np.repeat(starts[picks] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return out, np.diff(bounds)


def binary_column(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary cell per text over ``values``, without a copy for each."""
    offsets = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
