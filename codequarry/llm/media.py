"""Media columns: text payloads as progressive JPEG, read back into full-resolution RGB tensors.

``encode`` stores each payload byte as one quantised DCT coefficient of a 4:2:0 image (all quantisers are one),
so the file is lossless in its format's unit, the coefficient. Coefficients come in progressive scans: DC, two
spectral bands of AC without their lowest bit, then that bit (successive approximation). ``decode``
accumulates the scans of any progressive JPEG with Huffman coding and 8-bit samples into coefficient arrays; scans whose
code and extra bits always take the same width, as those of ``encode`` do, are looked up by numpy in one step.
The inverse transform works on integers held in float64, so equal files give equal tensors on any machine.

``store`` makes the files and ``tensors`` the full-resolution RGB of stored files; ``digests`` writes both to the shared folder and takes its figures
from what it reads back. Tensors take three to four bytes a byte of text, so they are written, read and released in ``SLICES`` parts.

A null text is an empty one. Rows are independent of each other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.sources.scratch import delete, new_path, release, stage, write_once

#: The payload is a multiple of so many bytes.
UNIT = 576
MCU = 6 * 64
#: Bytes of media or tensors in one Arrow batch.
BATCH_BYTES = 8 << 20
#: Parts in which tensors are written and read back.
SLICES = 12


def _zigzag() -> np.ndarray:
    """Natural position (row, then column) of each coefficient in scan order."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda rc: (sum(rc), rc[0] if sum(rc) % 2 else rc[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
SCALE = 1 << 13


def _basis() -> np.ndarray:
    """Samples of each coefficient in scan order, times ``SCALE``, as whole numbers."""
    x = np.arange(8)
    wave = np.array([[(math.sqrt(0.5) if u == 0 else 1.0) / 2 * math.cos((2 * i + 1) * u * math.pi / 16) for i in x] for u in x])
    full = np.einsum("ui,vj->uvij", wave, wave).reshape(64, 64)
    return np.round(full * SCALE)[ZIGZAG]


BASIS = _basis()
#: Coefficient of each payload byte: none is 0 or of magnitude 1, so the lowest bit is always a correction bit.
VALUE = np.array([b - 129 if b < 128 else b - 126 for b in range(256)], np.int32)
#: Code lengths of the tables that ``encode`` uses, by symbol: with its extra bits each symbol takes 9 or 8 bits.
DC_LENGTHS = {s: 9 - s for s in range(9)}
AC_LENGTHS = {s: 8 - s for s in range(1, 8)}
REFINE_LENGTHS = {0: 1}


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical code and its length, by symbol in order of length."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


def _words(lengths: dict[int, int], width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For symbols whose code and extra bits fill ``width``: word of each value (shifted by the third item), and value of each word."""
    top = 1 << max(lengths)
    word_of, value_of = np.zeros(2 * top + 1, np.int32), np.zeros(1 << width, np.int32)
    for size, (code, _) in _codes(lengths).items():
        for extra in range(1 << size):
            value = extra if size and extra >> (size - 1) else extra - (1 << size) + 1
            word_of[value + top] = code << size | extra
            value_of[code << size | extra] = value
    return word_of, value_of, top


DC_WORDS, AC_WORDS = _words(DC_LENGTHS, 9), _words(AC_LENGTHS, 8)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _table(kind: int, lengths: dict[int, int]) -> bytes:
    symbols = [s for s, _ in sorted(lengths.items(), key=lambda x: x[1])]
    return _segment(0xC4, bytes([kind]) + bytes(sum(n == k for n in lengths.values()) for k in range(1, 17)) + bytes(symbols))


TABLES = [_table(0x00, DC_LENGTHS), _table(0x10, AC_LENGTHS), _table(0x10, REFINE_LENGTHS)]


def _scan(components: list[int], band: tuple[int, int], high: int, low: int, data: np.ndarray) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([*band, high << 4 | low])
    return _segment(0xDA, head) + data.tobytes().replace(b"\xff", b"\xff\x00")


def _bits(rows: np.ndarray) -> np.ndarray:
    """Bytes of the bits, filled up with ones."""
    flat = rows.ravel().astype(np.uint8)
    return np.packbits(np.concatenate([flat, np.ones(-len(flat) % 8, np.uint8)]))


def pad(text: bytes) -> bytes:
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload's bytes; a comment holds the payload's length."""
    n = max(1, -(-len(payload) // MCU))
    cols = min(4095, math.isqrt(n - 1) + 1)
    rows = -(-n // cols)
    raw = np.full(rows * cols * MCU, 0xFF, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    units = VALUE[raw].reshape(rows, cols, 6, 64)
    luma = units[:, :, :4].reshape(rows, cols, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    planes = [luma, units[:, :, 4].reshape(-1, 64), units[:, :, 5].reshape(-1, 64)]
    out = [b"\xff\xd8", _segment(0xFE, len(payload).to_bytes(8, "big")), _segment(0xDB, bytes([0]) + bytes([1] * 64))]
    out.append(_segment(0xC2, bytes([8]) + (16 * rows).to_bytes(2, "big") + (16 * cols).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    dc = units[..., 0].reshape(-1, 6)
    first = dc >> 1
    change = np.empty_like(first)
    change[:, :4] = np.diff(first[:, :4].ravel(), prepend=0).reshape(-1, 4)
    for c in (4, 5):
        change[:, c] = np.diff(first[:, c], prepend=0)
    words = DC_WORDS[0][change.ravel() + DC_WORDS[2]]
    out += [TABLES[0], _scan([1, 2, 3], (0, 0), 0, 1, _bits(words[:, None] >> np.arange(8, -1, -1) & 1)), TABLES[1]]
    halves = [np.sign(p) * (np.abs(p) >> 1) for p in planes]
    for low, high in ((1, 5), (6, 63)):
        for c, half in enumerate(halves, 1):
            out.append(_scan([c], (low, high), 0, 1, AC_WORDS[0][half[:, low : high + 1] + AC_WORDS[2]].astype(np.uint8).ravel()))
    out += [_scan([1, 2, 3], (0, 0), 1, 0, _bits(dc & 1)), TABLES[2]]
    for c, plane in enumerate(planes, 1):
        bits = (np.abs(plane) & 1).astype(np.uint8)
        bits[:, 0] = 0  # the one-bit code that ends the block's band; the correction bits follow it
        out.append(_scan([c], (1, 63), 1, 0, np.packbits(bits)))
    return b"".join(out) + b"\xff\xd9"


@dataclass
class Component:
    h: int
    v: int
    quant: int
    rows: int = 0
    cols: int = 0
    coef: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))

    def inside(self, width: int, height: int, hmax: int, vmax: int) -> tuple[int, int]:
        """Block rows and columns of a scan of this component alone."""
        return -(-(-(-height * self.v // vmax)) // 8), -(-(-(-width * self.h // hmax)) // 8)


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    comment: bytes

    def payload(self) -> bytes:
        """The bytes that ``encode`` stored."""
        y, cb, cr = self.components
        rows, cols = cb.rows, cb.cols
        units = np.empty((rows, cols, 6, 64), np.int32)
        units[:, :, :4] = y.coef.reshape(rows, 2, cols, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows, cols, 4, 64)
        units[:, :, 4], units[:, :, 5] = cb.coef.reshape(rows, cols, 64), cr.coef.reshape(rows, cols, 64)
        flat = units.ravel()
        return np.where(flat < 0, flat + 129, flat + 126).astype(np.uint8)[: int.from_bytes(self.comment, "big")].tobytes()

    def rgb(self) -> np.ndarray:
        """Height x width x 3; chroma samples are repeated up to the full resolution."""
        planes = []
        for c in self.components:
            samples = c.coef * self.quants[c.quant] @ BASIS
            grid = np.floor((samples + SCALE // 2) / SCALE).reshape(c.rows, c.cols, 8, 8).transpose(0, 2, 1, 3)
            planes.append(np.clip(grid.reshape(8 * c.rows, 8 * c.cols) + 128, 0, 255).astype(np.int32))
        hmax, vmax = max(c.h for c in self.components), max(c.v for c in self.components)

        def full(plane: np.ndarray, c: Component) -> np.ndarray:
            return plane.repeat(vmax // c.v, axis=0).repeat(hmax // c.h, axis=1)[: self.height, : self.width]

        y = full(planes[0], self.components[0])
        if len(planes) < 3:
            return np.repeat(y[:, :, None], 3, axis=2).astype(np.uint8)
        cb, cr = planes[1] - 128, planes[2] - 128
        if (self.components[1].h, self.components[1].v) != (self.components[2].h, self.components[2].v):
            cb, cr = full(cb, self.components[1]), full(cr, self.components[2])
            grow = lambda p: p
        else:
            grow = lambda p: full(p, self.components[1])
        out = np.empty((self.height, self.width, 3), np.uint8)
        for k, shift in enumerate((91881 * cr, -22554 * cb - 46802 * cr, 116130 * cb)):
            out[:, :, k] = np.clip(y + grow(shift + 32768 >> 16), 0, 255)
        return out


class _Reader:
    """Bits of a scan, symbol by symbol, for tables of any shape."""

    def __init__(self, data: np.ndarray):
        self.bits = np.unpackbits(data).tolist()
        self.at = 0

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n]:
            value = value << 1 | b
        self.at += n
        return value

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = n = 0
        while (code, n) not in table or n == 0:
            code, n = code << 1 | self.take(1), n + 1
            if n > 16:
                raise ValueError("a code that isn't in the table")
        return table[code, n]

    def signed(self, size: int) -> int:
        value = self.take(size)
        return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _dc_scan(parts: list[np.ndarray], tables: list[dict], coef: list[np.ndarray], order: list[tuple[int, np.ndarray]], high: int, low: int, every: int) -> None:
    """``order``: for each block of an MCU its component and, by MCU, its place."""
    mcus = len(order[0][1])
    if high:
        bits = np.concatenate([np.unpackbits(p)[: len(order) * min(every, mcus - k * every)] for k, p in enumerate(parts)]).reshape(mcus, len(order))
        for k, (c, place) in enumerate(order):
            coef[c][place, 0] |= bits[:, k].astype(np.int32) << low
        return
    if len(parts) == 1 and all(t == DC_LENGTHS for t in tables):
        bits = np.unpackbits(parts[0])[: 9 * mcus * len(order)].reshape(-1, 9)
        change = DC_WORDS[1][bits @ (1 << np.arange(8, -1, -1))].reshape(mcus, len(order))
        for c in {c for c, _ in order}:
            own = [k for k, (x, _) in enumerate(order) if x == c]
            values = np.cumsum(change[:, own].ravel()).reshape(mcus, len(own))
            for j, k in enumerate(own):
                coef[c][order[k][1], 0] = values[:, j] << low
        return
    codes = [{v: s for s, v in _codes(t).items()} for t in tables]
    for k, part in enumerate(parts):
        reader, last = _Reader(part), [0] * len(coef)
        for m in range(k * every, min(mcus, (k + 1) * every)):
            for c, place in order:
                last[c] += reader.signed(reader.symbol(codes[c]))
                coef[c][place[m], 0] = last[c] << low


def _ac_scan(parts: list[np.ndarray], table: dict, coef: np.ndarray, places: np.ndarray, band: tuple[int, int], high: int, low: int, every: int) -> None:
    start, end = band
    width = end - start + 1
    if len(parts) == 1 and not high and table == AC_LENGTHS and len(parts[0]) == len(places) * width:
        coef[places, start : end + 1] = AC_WORDS[1][parts[0]].reshape(-1, width) << low
        return
    if len(parts) == 1 and high and table == REFINE_LENGTHS and width == 63 and len(parts[0]) == 8 * len(places) and (old := coef[places, 1:]).all():
        coef[places, 1:] = old + np.sign(old) * (np.unpackbits(parts[0]).reshape(-1, 64)[:, 1:].astype(np.int32) << low)
        return
    codes = {v: s for s, v in _codes(table).items()}
    one = 1 << low
    for part_no, part in enumerate(parts):
        reader, run = _Reader(part), 0

        def correct(row: np.ndarray, k: int) -> None:
            if reader.take(1) and not abs(int(row[k])) & one:  # noqa: B023
                row[k] += one if row[k] > 0 else -one

        for m in range(part_no * every, min(len(places), (part_no + 1) * every)):
            row, k = coef[places[m]], start
            while k <= end and not run:
                zeros, size = divmod(reader.symbol(codes), 16)
                if size == 0 and zeros < 15:
                    run = (1 << zeros) + reader.take(zeros)
                    break
                if not high:
                    k += zeros
                    if size:
                        row[k] = reader.signed(size) * one
                    k += 1
                    continue
                value = (one if reader.take(1) else -one) if size else 0
                while k <= end:
                    if row[k]:
                        correct(row, k)
                    elif zeros == 0:
                        row[k] = value
                        k += 1
                        break
                    else:
                        zeros -= 1
                    k += 1
            if run:
                if high:
                    for j in range(k, end + 1):
                        if row[j]:
                            correct(row, j)
                run -= 1


def _entropy(data: bytes, restart: int) -> list[np.ndarray]:
    """Segments between restart markers, without stuffed zeros."""
    parts = re.split(rb"\xff[\xd0-\xd7]", data) if restart else [data]
    return [np.frombuffer(p.replace(b"\xff\x00", b"\xff"), np.uint8) for p in parts]


def decode(file: bytes) -> Image:
    """Coefficients of a progressive JPEG, from all its scans."""
    data = np.frombuffer(file, np.uint8)
    full = np.flatnonzero(data[:-1] == 0xFF)  # a marker follows, unless it is a stuffed byte, a restart or a fill byte
    after = data[full + 1]
    markers = full[(after != 0) & ((after & 0xF8) != 0xD0) & (after != 0xFF)]
    image, tables, quants, at, comment, restart = None, {}, {}, 2, b"", 0
    while file[at + 1] != 0xD9:
        kind, size = file[at + 1], int.from_bytes(file[at + 2 : at + 4], "big")
        body, at = file[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xFE:
            comment = body
        elif kind == 0xDD:
            restart = int.from_bytes(body, "big")
        elif kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float64)
                body = body[65 + 64 * wide :]
        elif kind == 0xC4:
            while body:
                counts = body[1:17]
                symbols = body[17 : 17 + sum(counts)]
                tables[body[0]] = dict(zip(symbols, (n for n, c in enumerate(counts, 1) for _ in range(c)), strict=True))
                body = body[17 + sum(counts) :]
        elif kind == 0xC2:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            ids = {body[6 + 3 * k]: k for k in range(body[5])}
            parts = [Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
            hmax, vmax = max(c.h for c in parts), max(c.v for c in parts)
            down, across = -(-height // (8 * vmax)), -(-width // (8 * hmax))
            for c in parts:
                c.rows, c.cols = down * c.v, across * c.h
                c.coef = np.zeros((c.rows * c.cols, 64), np.int32)
            image = Image(width, height, parts, quants, b"")
        elif 0xC0 <= kind <= 0xCF:
            raise ValueError("only progressive Huffman files are read")
        elif kind == 0xDA:
            chosen = [(ids[body[1 + 2 * k]], body[2 + 2 * k]) for k in range(body[0])]
            start, end, bits = body[1 + 2 * body[0] :][:3]
            stop = int(markers[np.searchsorted(markers, at)])
            segments, at = _entropy(file[at:stop], restart), stop
            coef = [c.coef for c in image.components]
            every = restart or 1 << 62
            if start == 0:
                if len(chosen) > 1:
                    order = []
                    for c, _ in chosen:
                        comp = image.components[c]
                        grid = np.arange(comp.rows * comp.cols).reshape(down, comp.v, across, comp.h).transpose(0, 2, 1, 3).reshape(down * across, -1)
                        order += [(c, grid[:, k]) for k in range(comp.v * comp.h)]
                else:
                    order = [(chosen[0][0], _alone(image, chosen[0][0], hmax, vmax))]
                lookup = {c: tables.get(t >> 4, {}) for c, t in chosen}
                _dc_scan(segments, [lookup.get(k, DC_LENGTHS) for k in range(len(coef))], coef, order, bits >> 4, bits & 15, every)
            else:
                c, t = chosen[0]
                _ac_scan(segments, tables[0x10 | t & 15], coef[c], _alone(image, c, hmax, vmax), (start, end), bits >> 4, bits & 15, every)
    image.comment = comment
    return image


def _alone(image: Image, c: int, hmax: int, vmax: int) -> np.ndarray:
    comp = image.components[c]
    rows, cols = comp.inside(image.width, image.height, hmax, vmax)
    return np.arange(comp.rows * comp.cols).reshape(comp.rows, comp.cols)[:rows, :cols].ravel()


def feature(rgb: np.ndarray) -> str:
    """Shape, mean and deviation of each channel in thousandths, and a checksum of the tensor."""
    pixels = rgb.shape[0] * rgb.shape[1]
    stats = []
    for k in range(3):
        counts = np.bincount(rgb[:, :, k].ravel(), minlength=256)
        mean, square = (int(counts @ np.arange(256) ** p) / pixels for p in (1, 2))
        stats.append(f"{mean:.3f}/{math.sqrt(max(0.0, square - mean * mean)):.3f}")
    return f"{rgb.shape[0]}x{rgb.shape[1]} {' '.join(stats)} {zlib.crc32(np.ascontiguousarray(rgb)):08x}"


def store(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``media``, the file of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, files, size = 0, [], 0
            texts = batch.column("text").cast(pa.binary())
            for k, text in enumerate(texts, 1):
                files.append(encode(pad(text.as_py() or b"")))
                size += len(files[-1])
                if size > BATCH_BYTES or k == len(texts):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(done, len(files)), pa.array(files, pa.binary())], ["doc_id", "media"])
                    done, files, size = k, [], 0

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, media binary")


TENSORS = "doc_id long, payload_bytes long, n_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, height int, width int, rgb binary"


def tensors(media: DataFrame) -> DataFrame:
    """What files hold: digests of the payload and the file, ``height``, ``width`` and ``rgb``, the full-resolution tensor in row order."""
    names = [field.split()[0] for field in TENSORS.split(", ")]
    types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0

        def taken() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            for doc_id, file in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
                file = file.as_py()
                image = decode(file)
                payload, rgb = image.payload(), image.rgb()
                rows.append((doc_id, len(payload), len(payload.rstrip(b"\xff")), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), rgb.shape[0], rgb.shape[1], rgb.tobytes()))
                size += rgb.size
                if size > BATCH_BYTES:
                    yield taken()
                    rows, size = [], 0
        if rows:
            yield taken()

    return media.select("doc_id", "media").mapInArrow(run, TENSORS)


def with_features(stored: DataFrame) -> DataFrame:
    """Rows of ``tensors`` with ``feature`` in place of the tensor."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = zip(batch.column("rgb"), batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True)
            found = [feature(np.frombuffer(rgb.as_buffer(), np.uint8).reshape(h, w, 3)) for rgb, h, w in cells]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names[:-1]), pa.array(found, pa.string())], names)

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def digests(docs: DataFrame, slices: int = SLICES) -> DataFrame:
    """Files and tensors of every whole text, written to the shared folder and read back: payload, checksums and features of the stored tensor."""
    spark = docs.sparkSession
    path, out = new_path(spark, "media"), new_path(spark, "media-digests")
    part = F.pmod(F.xxhash64("doc_id", F.length("media")), F.lit(slices)).cast("int")
    write_once(store(docs).withColumn("part", part), path, "part")
    schema = "doc_id long, media binary, part int"
    for k in range(slices):
        stored = stage(tensors(spark.read.schema(schema).parquet(path).filter(F.col("part") == k)), "tensors")
        with_features(stored).write.mode("append").parquet(out)
        release(stored)
    delete(spark, path)
    return spark.read.parquet(out)
