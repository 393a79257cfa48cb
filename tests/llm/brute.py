"""Plain versions of what the operators compute, for small inputs."""

from __future__ import annotations

import re

import numpy as np


def fingerprint(text: str | None, words: int = 4) -> int:
    import xxhash

    raw = (text or "").encode()
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    found = [w for w in re.split(rb"[\x20\x09-\x0d]+", low) if w]
    if not found:
        return 0
    shingles = [b" ".join(found[k : k + words]) for k in range(len(found) - words + 1)] or [b" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: list[int], radius: int = 4) -> list[int]:
    """For each print the first place of its component."""
    a = np.array(prints, np.uint64)
    up = list(range(len(a)))

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for k in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[k + 1 :] ^ a[k]) <= radius) + k + 1:
            x, y = find(k), find(int(j))
            up[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(a))]


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", (text or "").lower())


def least_edits(item: list[str], text: list[str]) -> int:
    """Least word edits from the item to any part of the text."""
    known = {w: k for k, w in enumerate(dict.fromkeys(item))}
    pattern = np.array([known[w] for w in item])
    column = np.arange(len(item) + 1)
    step = np.arange(len(item) + 1)
    best = len(item)
    for word in text:
        new = np.zeros(len(item) + 1, np.int64)
        new[1:] = np.minimum(column[:-1] + (pattern != known.get(word, -1)), column[1:] + 1)
        column = np.minimum.accumulate(new - step) + step
        best = min(best, int(column[-1]))
    return best


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text: str | None) -> list[tuple[int, int, str, int]]:
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def shingle_set(text: str | None, words: int = 5) -> set[bytes]:
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    found = [w for w in re.split(rb"[\x20\x09-\x0d]+", low) if w]
    return {b" ".join(found[k : k + words]) for k in range(len(found) - words + 1)} or ({b" ".join(found)} if found else set())


def copies(texts: list[str | None], similarity: float = 0.8) -> list[int]:
    """For each text the first place of its component over near copies."""
    sets, up = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x: int) -> int:
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(sets):
        for j in range(k):
            b = sets[j]
            both = len(a & b)
            if (both / (len(a) + len(b) - both) if a or b else 1.0) >= similarity:
                x, y = find(k), find(j)
                up[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))]


def best_path(scores: np.ndarray, penalty: float) -> float:
    """Value of the best sequence of states, by plain dynamic programming."""
    value = scores[0].copy()
    for row in scores[1:]:
        value = np.array([max(value[j] - penalty * (j != k) for j in range(len(row))) for k in range(len(row))]) + row
    return float(value.max())


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value: int, n: int) -> None:
        self.bits += [value >> k & 1 for k in range(n - 1, -1, -1)]

    def bytes(self) -> bytes:
        self.bits += [1] * (-len(self.bits) % 8)
        out = bytes(int("".join(map(str, self.bits[k : k + 8])), 2) for k in range(0, len(self.bits), 8))
        self.bits = []
        return out.replace(b"\xff", b"\xff\x00")


def progressive_file(planes: list[np.ndarray], factors: list[tuple[int, int]], width: int, height: int, restart: int, quant: list[int]) -> bytes:
    """A progressive JPEG of coefficients (blocks in rows, scan order), written the plain way: every symbol has a nine-bit code.

    Scans: DC without its lowest bit, AC 1-5 and 6-63 without it (with runs of ended bands), then the lowest bits.
    """
    segment = lambda marker, body: bytes([255, marker]) + (len(body) + 2).to_bytes(2, "big") + body
    hmax, vmax = max(h for h, _ in factors), max(v for _, v in factors)
    down, across = -(-height // (8 * vmax)), -(-width // (8 * hmax))
    table = bytes([0] * 8 + [255] + [0] * 7) + bytes(range(255))
    out = [b"\xff\xd8", segment(0xDB, bytes([0, *quant])), segment(0xC4, b"\x00" + table + b"\x10" + table)]
    out.append(segment(0xC2, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(planes)]) + b"".join(bytes([k + 1, h << 4 | v, 0]) for k, (h, v) in enumerate(factors))))
    out.append(segment(0xDD, restart.to_bytes(2, "big")) if restart else b"")

    def scan(parts, band, high, low, units, code):
        out.append(segment(0xDA, bytes([len(parts)]) + b"".join(bytes([c + 1, 0]) for c in parts) + bytes([*band, high << 4 | low])))
        bits, marker = Bits(), 0
        for at in range(0, len(units), restart or len(units)):
            if at:
                out.append(bytes([255, 0xD0 + marker % 8]))
                marker += 1
            code(bits, units[at : at + (restart or len(units))])
            out.append(bits.bytes())

    def extra(bits, value):
        size = abs(value).bit_length()
        return lambda symbol: (bits.put(symbol | size, 9), bits.put(value if value > 0 else value + (1 << size) - 1, size))

    mcus = []
    for m in range(down * across):
        row, col = divmod(m, across)
        mcus.append([(c, (row * v + y) * across * h + col * h + x) for c, (h, v) in enumerate(factors) for y in range(v) for x in range(h)])

    def dc_first(bits, units):
        last = [0] * len(planes)
        for unit in units:
            for c, place in unit:
                value = int(planes[c][place][0]) >> 1
                extra(bits, value - last[c])(0)
                last[c] = value

    def alone(c):
        h, v = factors[c]
        rows, cols = -(-(-(-height * v // vmax)) // 8), -(-(-(-width * h // hmax)) // 8)
        return [r * across * h + k for r in range(rows) for k in range(cols)]

    def half(x):
        return int(np.sign(x)) * (abs(int(x)) >> 1)

    def ended(bits, run):
        if run:
            size = run.bit_length() - 1
            bits.put(size << 4, 9)
            bits.put(run - (1 << size), size)

    def ac_first(c, band):
        def code(bits, units):
            run = 0
            for place in units:
                zeros = 0
                for k in range(band[0], band[1] + 1):
                    value = half(planes[c][place][k])
                    if not value:
                        zeros += 1
                        continue
                    ended(bits, run)
                    run = 0
                    while zeros > 15:
                        bits.put(0xF0, 9)
                        zeros -= 16
                    extra(bits, value)(zeros << 4)
                    zeros = 0
                run += zeros > 0
            ended(bits, run)

        return code

    def ac_refine(c, band):
        def code(bits, units):
            run, owed = 0, []

            def flush():
                nonlocal run, owed
                ended(bits, run)
                for b in owed:
                    bits.put(b, 1)
                run, owed = 0, []

            for place in units:
                row = planes[c][place]
                news = [k for k in range(band[0], band[1] + 1) if abs(int(row[k])) == 1]
                last = news[-1] if news else band[0] - 1
                zeros, late = 0, []
                for k in range(band[0], band[1] + 1):
                    size = abs(int(row[k]))
                    if size > 1:
                        late.append(size & 1)
                    elif size == 0 and k > last:
                        pass
                    else:
                        if run:
                            flush()
                        if size == 0:
                            zeros += 1
                            if zeros == 16:
                                bits.put(0xF0, 9)
                                for b in late:
                                    bits.put(b, 1)
                                zeros, late = 0, []
                            continue
                        bits.put(zeros << 4 | 1, 9)
                        bits.put(int(row[k] > 0), 1)
                        for b in late:
                            bits.put(b, 1)
                        zeros, late = 0, []
                if last < band[1]:
                    run, owed = run + 1, owed + late
            flush()

        return code

    scan(range(len(planes)), (0, 0), 0, 1, mcus, dc_first)
    for c in range(len(planes)):
        for band in ((1, 5), (6, 63)):
            scan([c], band, 0, 1, alone(c), ac_first(c, band))
    scan(range(len(planes)), (0, 0), 1, 0, mcus, lambda bits, units: [bits.put(int(planes[c][p][0]) & 1, 1) for u in units for c, p in u])
    for c in range(len(planes)):
        scan([c], (1, 63), 1, 0, alone(c), ac_refine(c, (1, 63)))
    return b"".join(out) + b"\xff\xd9"
