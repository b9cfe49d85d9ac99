"""Progressive JPEG in numpy: coefficients to scans and back, and images from coefficients.

Scans of many files are worked through together. A restart interval starts at a byte and forgets what came before it, so
all intervals of a batch are decoded side by side: one step reads the next symbol of every interval. Files without
restart intervals are one interval each.

Reads baseline-precision (8-bit) progressive Huffman files: interleaved or single-component scans, spectral selection,
successive approximation, end-of-band runs, restart intervals, any integer subsampling. Writes files whose coefficients
are given.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

#: Fixed values of the format: the zigzag order as (row * 8 + column) of each coefficient.
ZIGZAG = np.array(sorted(range(64), key=lambda n: (n // 8 + n % 8, n // 8 if (n // 8 + n % 8) % 2 else n % 8)))

#: Code lengths of the tables that are written: short ones for the coefficients of letters, spaces and ends of bands.
_AC_SHORT = {0x04: 2, 0x03: 2, 0x06: 3, 0x00: 3, 0x02: 4, 0x05: 4, 0x07: 5, 0x01: 6}
_AC_LENGTHS = {0xF0: 11} | {r << 4 | s: 11 for r in range(16) for s in range(1, 11)} | _AC_SHORT
_DC_LENGTHS = dict.fromkeys(range(12), 4)
#: Blocks between restarts in written files.
RESTART = 4
_MARKER = re.compile(rb"\xff[\x01-\xcf\xd8-\xfe]")


@lru_cache(maxsize=64)
def _decoding(table: bytes) -> np.ndarray:
    """For each 16 bits: code length, size (bits 8-11) and run (bits 16-19) of the symbol that they begin with."""
    out, code, at = np.zeros(1 << 16, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            symbol = table[at]
            out[code << (16 - length) : (code + 1) << (16 - length)] = length | (symbol & 15) << 8 | (symbol >> 4) << 16
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _written(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(table as it stands in a file, code of each symbol, its length)."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, bits, code, before = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        code <<= lengths[s] - before
        before = lengths[s]
        codes[s], bits[s] = code, before
        code += 1
    counts = [sum(1 for s in order if lengths[s] == n) for n in range(1, 17)]
    return bytes(counts) + bytes(order), codes, bits


#: Bits of a magnitude.
_SIZE = np.array([n.bit_length() for n in range(1 << 12)])
_DC_TABLE, _DC_CODE, _DC_BITS = _written(_DC_LENGTHS)
_AC_TABLE, _AC_CODE, _AC_BITS = _written(_AC_LENGTHS)


@dataclass
class Component:
    ident: int
    h: int
    v: int
    quant: int
    wide: int = 0  # blocks in memory, whole minimum coded units
    high: int = 0
    row0: int = 0  # its first block among all blocks of the batch


@dataclass
class Frame:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)
    scans: list[tuple] = field(default_factory=list)
    orders: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray, int]] = field(default_factory=dict)

    @property
    def units(self) -> tuple[int, int]:
        """Minimum coded units across and down."""
        h, v = max(c.h for c in self.components), max(c.v for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    def lay_out(self, row0: int) -> int:
        across, down = self.units
        for c in self.components:
            c.wide, c.high, c.row0 = across * c.h, down * c.v, row0
            row0 += c.wide * c.high
        return row0

    def order(self, parts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
        """(block, component number, blocks a unit) of a scan over ``parts``, in the order of the scan."""
        if parts not in self.orders:
            self.orders[parts] = self._order(parts)
        return self.orders[parts]

    def _order(self, parts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
        if len(parts) == 1:
            c = self.components[parts[0]]
            h, v = max(x.h for x in self.components), max(x.v for x in self.components)
            wide, high = -(-(-(-self.width * c.h // h)) // 8), -(-(-(-self.height * c.v // v)) // 8)
            rows = (c.row0 + np.arange(high)[:, None] * c.wide + np.arange(wide)).ravel()
            return rows, np.zeros(len(rows), np.int64), 1
        across, down = self.units
        each, of = [], []
        for n, p in enumerate(parts):
            c = self.components[p]
            y = np.arange(down)[:, None, None, None] * c.v + np.arange(c.v)[None, None, :, None]
            x = np.arange(across)[None, :, None, None] * c.h + np.arange(c.h)
            each.append((c.row0 + y * c.wide + x).reshape(across * down, -1))
            of += [n] * each[-1].shape[1]
        rows = np.concatenate(each, axis=1)
        return rows.ravel(), np.tile(np.array(of), len(rows)), rows.shape[1]


def parse(data: bytes) -> Frame:
    """The headers of a file, and where its scans lie."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, frame, tables, quants, comments, restart = 2, None, {}, {}, [], 0
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xC2:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("only 8-bit samples are read")
            frame = Frame(width, height, [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)])
        elif mark in (0xC0, 0xC1, 0xC3) or 0xC5 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("only progressive Huffman files are read")
        elif mark == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]], body = body[1:n], body[n:]
        elif mark == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else "u1").astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark == 0xFE:
            comments.append(body)
        elif mark == 0xDA:
            n = body[0]
            named = {c.ident: k for k, c in enumerate(frame.components)}
            parts = tuple(named[body[1 + 2 * k]] for k in range(n))
            first, last, approx = body[1 + 2 * n : 4 + 2 * n]
            pick = [body[2 + 2 * k] >> 4 if first == 0 else 0x10 | body[2 + 2 * k] & 15 for k in range(n)]
            end = _MARKER.search(data, at)
            stop = end.start() if end else len(data)
            codes = tuple(tables[p] for p in pick) if not (first == 0 and approx >> 4) else ()
            frame.scans.append((parts, first, last, approx >> 4, approx & 15, codes, restart, at, stop))
            at = stop
    frame.quants, frame.comments = quants, comments
    return frame


def _bits_at(data: np.ndarray) -> np.ndarray:
    """The 64 bits that begin at each byte."""
    d = np.concatenate([data, np.full(16, 255, np.uint8)]).astype(np.uint64)
    d = d[:-1] << np.uint64(8) | d[1:]
    d = d[:-2] << np.uint64(16) | d[2:]
    return d[:-4] << np.uint64(32) | d[4:]


def _signed(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    return np.where(x >> np.maximum(s - 1, 0) & 1, x, x - (1 << s) + 1)


def _take(word: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first ``n`` bits (under 32) of 64-bit words."""
    return ((word >> np.uint64(32)).astype(np.int64)) >> (32 - n)


class _Lanes:
    """The restart intervals of one scan of several files."""

    def __init__(self, files: list[bytes], frames: list[Frame], scans: list[tuple]):
        order, part, begin, end, raw, starts, total = [], [], [], [], [], [], 0
        at = 0
        for data, frame, scan in zip(files, frames, scans):
            rows, of, per = frame.order(scan[0])
            step = scan[6] * per if scan[6] else len(rows)
            b = np.arange(0, len(rows), max(step, 1))
            begin.append(at + b)
            end.append(at + np.minimum(b + step, len(rows)))
            at += len(rows)
            order.append(rows)
            part.append(of)
            raw.append(data[scan[7] : scan[8]])
            starts.append(total)
            total += len(raw[-1])
        self.order, self.part = np.concatenate(order), np.concatenate(part)
        self.begin, self.end = np.concatenate(begin), np.concatenate(end)
        d = np.frombuffer(b"".join(raw), np.uint8)
        # Stuffed zeros go, and so do restart marks, behind which an interval begins.
        after = np.flatnonzero(d[:-1] == 255) + 1 if len(d) else np.zeros(0, np.int64)
        keep = np.ones(len(d), bool)
        keep[after[d[after] == 0]] = False
        mark = after[(d[after] >= 0xD0) & (d[after] <= 0xD7)]
        keep[mark] = keep[mark - 1] = False
        opens = np.sort(np.concatenate([np.array(starts, np.int64), mark + 1]))
        place = np.concatenate([[0], np.cumsum(keep)])
        if len(opens) != len(self.begin):
            raise ValueError("restart marks do not fit the scan")
        self.data = d[keep]
        self.word = _bits_at(self.data)
        self.bit = place[opens] * 8

    def look(self, bit: np.ndarray) -> np.ndarray:
        return self.word[bit >> 3] << (bit & 7).astype(np.uint64)


def _dc_first(lanes: _Lanes, low: int, codes: tuple[bytes, ...], coef: np.ndarray) -> None:
    luts = np.stack([_decoding(t) for t in codes])
    n = np.arange(len(lanes.begin))
    bit, at, last = lanes.bit.copy(), lanes.begin.copy(), np.zeros((len(n), len(codes)), np.int64)
    n = n[at < lanes.end]
    while len(n):
        part = lanes.part[at[n]]
        w = lanes.look(bit[n])
        e = luts[part, (w >> np.uint64(48)).astype(np.int64)]
        length, s = e & 31, e >> 8 & 15
        s = s + (e >> 16 << 4)
        diff = np.where(s > 0, _signed(_take(w << length.astype(np.uint64), s), s), 0)
        last[n, part] += diff
        coef[lanes.order[at[n]], 0] = last[n, part] << low
        bit[n] += length + s
        at[n] += 1
        n = n[at[n] < lanes.end[n]]


def _dc_again(lanes: _Lanes, low: int, coef: np.ndarray) -> None:
    count = lanes.end - lanes.begin
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    bit = np.repeat(lanes.bit, count) + within
    one = lanes.data[bit >> 3] >> (7 - (bit & 7)) & 1
    coef[lanes.order[np.repeat(lanes.begin, count) + within], 0] |= one.astype(coef.dtype) << low


def _ac_first(lanes: _Lanes, first: int, last: int, low: int, code: bytes, coef: np.ndarray) -> None:
    lut = _decoding(code)
    live = lanes.begin < lanes.end
    bit, at, end = lanes.bit[live], lanes.begin[live], lanes.end[live]
    k = np.full(len(bit), first)
    flat = coef.reshape(-1)
    while len(bit):
        w = lanes.look(bit)
        e = lut[(w >> np.uint64(48)).astype(np.int64)]
        length, s, r = e & 31, e >> 8 & 15, e >> 16
        tail = w << length.astype(np.uint64)
        if s.all():
            k += r
            flat[lanes.order[at] * 64 + k] = _signed(_take(tail, s), s) << low
            k += 1
            bit += length + s
        else:
            hit = s > 0
            kk = (k + r)[hit]
            flat[lanes.order[at[hit]] * 64 + kk] = _signed(_take(tail[hit], s[hit]), s[hit]) << low
            k += np.where(hit, r + 1, np.where(r == 15, 16, 64))
            ends = ~hit & (r < 15)
            # An end of band ends this block and a run of blocks behind it.
            run = np.where(ends, (1 << np.where(ends, r, 0)) + _take(tail, np.where(ends, r, 0)) - 1, 0)
            bit += length + s + np.where(ends, r, 0)
            at = at + run
        over = k > last
        if over.any():
            at = at + over
            k[over] = first
            going = at < end
            if not going.all():
                bit, at, end, k = bit[going], at[going], end[going], k[going]


def _ac_again(lanes: _Lanes, first: int, last: int, low: int, code: bytes, coef: np.ndarray) -> None:
    lut = _decoding(code)
    live = lanes.begin < lanes.end
    bit, at, end = lanes.bit[live], lanes.begin[live], lanes.end[live]
    k, runs = np.full(len(bit), first), np.zeros(len(bit), np.int64)
    place, step = np.arange(first, last + 1), 1 << low
    while len(bit):
        rows = lanes.order[at]
        old = coef[rows, first : last + 1]
        w = lanes.look(bit)
        e = lut[(w >> np.uint64(48)).astype(np.int64)]
        reads = runs == 0
        length, s, r = np.where(reads, e & 31, 0), np.where(reads, e >> 8 & 15, 0), np.where(reads, e >> 16, 0)
        ends = ~reads | (s == 0) & (r < 15)
        extra = np.where(reads, np.where(s > 0, 1, np.where(ends, r, 0)), 0)
        value = _take(w << length.astype(np.uint64), extra)
        bit = bit + length + extra
        runs = np.where(reads, np.where(ends, (1 << np.where(ends, r, 0)) + value, 0), runs) - ends
        # Where the symbol leads: behind the band, or to the zero that ends its run of zeros.
        to = np.full(len(bit), last + 1)
        some = np.flatnonzero(~ends)
        if len(some):
            zeros = np.cumsum((old[some] == 0) & (place >= k[some, None]), axis=1)
            found = zeros == r[some, None] + 1
            to[some] = np.where(found.any(axis=1), first + found.argmax(axis=1), last + 1)
        row, col = np.nonzero((old != 0) & (place >= k[:, None]) & (place < to[:, None]))
        n = np.bincount(row, minlength=len(bit))
        here = bit[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        one = (lanes.data[here >> 3] >> (7 - (here & 7)) & 1).astype(coef.dtype)
        coef[rows[row], first + col] += np.sign(old[row, col]) * one * step
        bit = bit + n
        new = np.flatnonzero((s > 0) & (to <= last))
        coef[rows[new], to[new]] = np.where(value[new] > 0, step, -step)
        k = to + 1
        over = k > last
        at = at + over
        k[over] = first
        going = at < end
        if not going.all():
            bit, at, end, k, runs = bit[going], at[going], end[going], k[going], runs[going]


def read(files: list[bytes]) -> tuple[list[Frame], np.ndarray]:
    """(frames, coefficients): blocks x 64 in zigzag order, those of a component from its ``row0`` on."""
    frames, total = [parse(f) for f in files], 0
    for f in frames:
        total = f.lay_out(total)
    coef = np.zeros((total, 64), np.int32)
    for n in range(max((len(f.scans) for f in frames), default=0)):
        alike: dict[tuple, list[int]] = {}
        for k, f in enumerate(frames):
            if n < len(f.scans):
                alike.setdefault((len(f.scans[n][0]) > 1, *f.scans[n][1:6]), []).append(k)
        for (_, first, last, high, low, codes), which in alike.items():
            lanes = _Lanes([files[k] for k in which], [frames[k] for k in which], [frames[k].scans[n] for k in which])
            if first == 0:
                _dc_again(lanes, low, coef) if high else _dc_first(lanes, low, codes, coef)
            else:
                (_ac_again if high else _ac_first)(lanes, first, last, low, codes[0], coef)
    return frames, coef


def _idct_matrix() -> np.ndarray:
    """Zigzag coefficients to samples, in units of 2**-16, as whole numbers: sums are exact in any order."""
    x = np.arange(8)
    a = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x[:, None] == 0, np.sqrt(1 / 8), 0.5)
    return np.rint(np.kron(a, a)[ZIGZAG] * 65536)


_IDCT = _idct_matrix()


def images(frames: list[Frame], coef: np.ndarray) -> list[np.ndarray]:
    """Height x width x 3 bytes of each frame: inverse transform, chroma upsampled to full resolution, RGB. One component
    gives grey. Whole-number arithmetic, so equal files give equal images."""
    out, scaled = [], coef
    same = all((q == 1).all() for f in frames for q in f.quants.values())
    if not same:
        scaled = coef.copy()
        for f in frames:
            for c in f.components:
                scaled[c.row0 : c.row0 + c.wide * c.high] *= f.quants[c.quant].astype(np.int32)
    samples = np.empty(coef.shape, np.int32)
    for at in range(0, len(coef), 1 << 14):
        got = scaled[at : at + (1 << 14)].astype(np.float64) @ _IDCT
        samples[at : at + (1 << 14)] = np.clip(np.floor((got + 32768.0) / 65536.0) + 128, 0, 255)
    for f in frames:
        planes = []
        h, v = max(c.h for c in f.components), max(c.v for c in f.components)
        for c in f.components:
            p = samples[c.row0 : c.row0 + c.wide * c.high].reshape(c.high, c.wide, 8, 8).swapaxes(1, 2).reshape(c.high * 8, c.wide * 8)
            planes.append(p.repeat(v // c.v, axis=0).repeat(h // c.h, axis=1)[: f.height, : f.width])
        if len(planes) < 3:
            out.append(np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8))
            continue
        y, b, r = planes[0], planes[1] - 128, planes[2] - 128
        # The JFIF conversion in units of 2**-16.
        rgb = np.stack([y + (91881 * r + 32768 >> 16), y - (22554 * b + 46802 * r + 32768 >> 16), y + (116130 * b + 32768 >> 16)], axis=2)
        out.append(np.clip(rgb, 0, 255).astype(np.uint8))
    return out


def _packed(code: np.ndarray, bits: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, first byte of each lane and the end) of codes of up to 25 bits; lanes end on a byte, filled with ones."""
    size = np.bincount(lane, bits, lanes).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum((size + 7) // 8)])
    run = np.cumsum(bits) - bits
    lane_run = np.cumsum(size) - size
    off = run + (starts[:-1] * 8 - lane_run)[lane]
    word, room = off >> 6, 64 - (off & 63) - bits
    full = code.astype(np.uint64)
    # A code that does not fit its 64-bit word goes on in the next; no word is without the start of a code for long.
    out = np.zeros((int(starts[-1]) >> 3) + 2, np.uint64)
    if len(off):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[first]] = np.bitwise_or.reduceat(np.where(room >= 0, full << np.maximum(room, 0).astype(np.uint64), full >> np.maximum(-room, 0).astype(np.uint64)), first)
        over = np.flatnonzero(room < 0)
        out[word[over] + 1] |= full[over] << (64 + room[over]).astype(np.uint64)
    data = out.astype(">u8").view(np.uint8)[: starts[-1]]
    fill = -size % 8
    data[starts[1:][size > 0] - 1] |= ((1 << fill[size > 0]) - 1).astype(np.uint8)
    return data, starts


def _write_first(v: np.ndarray, first: int, last: int, low: int, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """A first pass over the band of blocks ``v``."""
    band = v[:, first : last + 1]
    size_of = np.abs(band) >> low
    row, col = np.nonzero(size_of)
    mag = size_of[row, col]
    neg = band[row, col] < 0
    fresh = np.r_[True, row[1:] != row[:-1]] if len(row) else np.zeros(0, bool)
    run = np.where(fresh, col, col - np.r_[0, col[:-1]] - 1) if len(row) else col
    long = run >> 4
    s = _SIZE[mag]
    tail = np.full(len(v), -1)
    tail[row] = col  # the last one written stays
    ends = (tail < last - first).astype(np.int64)
    entries = np.bincount(row, long + 1, len(v)).astype(np.int64)
    ends_before = np.cumsum(ends) - ends
    total = int(entries.sum() + ends.sum())
    symbol, value, width = np.full(total, 0xF0), np.zeros(total, np.int64), np.zeros(total, np.int64)
    place = np.cumsum(long + 1) - 1 + ends_before[row]
    symbol[place] = (run & 15) << 4 | s
    value[place], width[place] = np.where(neg, (1 << s) - 1 - mag, mag), s
    symbol[(np.cumsum(entries) + ends_before)[ends > 0]] = 0
    code = _AC_CODE[symbol] << width | value
    return _packed(code, _AC_BITS[symbol] + width, np.repeat(lane, entries + ends), lanes)


def _refining(block: np.ndarray, first: int, last: int, low: int) -> list[tuple[int, int]]:
    """(code, bits) of one block of a refining pass, symbol by symbol."""
    out, waiting, zeros = [], [], 0
    mags = np.abs(block) >> low
    new = [k for k in range(first, last + 1) if mags[k] == 1]
    final = new[-1] if new else first - 1
    for k in range(first, last + 1):
        if mags[k] > 1:
            waiting.append(int(mags[k] & 1))
            continue
        if mags[k] == 1:
            out.append((int(_AC_CODE[zeros << 4 | 1]), int(_AC_BITS[zeros << 4 | 1])))
            out.append((int(block[k] > 0), 1))
            out += [(b, 1) for b in waiting]
            waiting, zeros = [], 0
        elif k < final:
            zeros += 1
            if zeros == 16:
                out.append((int(_AC_CODE[0xF0]), int(_AC_BITS[0xF0])))
                out += [(b, 1) for b in waiting]
                waiting, zeros = [], 0
    if final < last:
        out.append((int(_AC_CODE[0]), int(_AC_BITS[0])))
        out += [(b, 1) for b in waiting]
    return out


def _write_again(v: np.ndarray, first: int, last: int, low: int, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """A refining pass. Blocks without new coefficients, nearly all here, are an end of band and their correction bits."""
    mags = np.abs(v[:, first : last + 1]) >> low
    odd = np.flatnonzero((mags == 1).any(axis=1))
    by_hand = {int(n): _refining(v[n], first, last, low) for n in odd}
    old = mags > 1
    old[odd] = False
    head = np.full(len(v), int(_AC_BITS[0]))
    head[odd] = [sum(b for _, b in by_hand[int(n)]) for n in odd]
    bits = head + old.sum(axis=1)
    size = np.bincount(lane, bits, lanes).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum((size + 7) // 8)])
    lane_run = np.cumsum(size) - size
    off = np.cumsum(bits) - bits - lane_run[lane] + starts[lane] * 8
    out = np.ones(starts[-1] * 8, np.uint8)
    for n in range(int(_AC_BITS[0])):
        out[off + n] = int(_AC_CODE[0]) >> (int(_AC_BITS[0]) - 1 - n) & 1
    row, col = np.nonzero(old)
    n = np.bincount(row, minlength=len(v))
    out[(off + head)[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = mags[row, col] & 1
    for n, codes in by_hand.items():
        text = "".join(format(c, f"0{b}b") for c, b in codes)
        out[off[n] : off[n] + len(text)] = np.frombuffer(text.encode(), np.uint8) - 48
    return np.packbits(out), starts


def _write_dc(v: np.ndarray, low: int, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    dc = v[:, 0] >> low
    fresh = np.r_[True, lane[1:] != lane[:-1]]
    diff = np.where(fresh, dc, dc - np.r_[0, dc[:-1]])
    s = _SIZE[np.abs(diff)]
    code = _DC_CODE[s] << s | np.where(diff < 0, diff + (1 << s) - 1, diff)
    return _packed(code, _DC_BITS[s] + s, lane, lanes)


def _write_dc_again(v: np.ndarray, low: int, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    return _packed((v[:, 0] >> low & 1).astype(np.int64), np.ones(len(v), np.int64), lane, lanes)


#: The scans of each component: first coefficient, last, bit before, bit.
SCRIPT = ((0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0))


def write(coef: np.ndarray, shapes: list[tuple[int, int]], comments: list[bytes]) -> list[bytes]:
    """Files of three components, chroma at half resolution both ways, quantisers 1.

    ``shapes``: units across and down of each file. ``coef``: for each file 4 blocks a unit of luma, then 1 each of both
    chroma, each component in rows; zigzag order, values from -1024 to 1023.
    """
    counts = np.array([[4 * a * d, a * d, a * d] for a, d in shapes], np.int64).ravel()
    v = coef.astype(np.int32)
    # A lane is a restart interval; they are numbered through all files and components.
    intervals = -(-counts // RESTART)
    first_lane = np.concatenate([[0], np.cumsum(intervals)])
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    lane = np.repeat(first_lane[:-1], counts) + within // RESTART
    lanes = int(first_lane[-1])
    number = np.arange(lanes) - np.repeat(first_lane[:-1], intervals)
    closing = np.zeros(lanes, bool)
    closing[first_lane[1:] - 1] = True
    scans = []
    for first, last, high, low in SCRIPT:
        if first == 0:
            data, starts = _write_dc_again(v, low, lane, lanes) if high else _write_dc(v, low, lane, lanes)
        else:
            data, starts = (_write_again if high else _write_first)(v, first, last, low, lane, lanes)
        # Zeros behind each 255, and a restart mark behind each lane but a component's last.
        full = data == 255
        shift = np.concatenate([[0], np.cumsum(full)])
        marks = np.cumsum(~closing) - ~closing
        of = np.repeat(np.arange(lanes), np.diff(starts))
        out = np.zeros(len(data) + int(shift[-1]) + 2 * int((~closing).sum()), np.uint8)
        out[np.arange(len(data)) + shift[:-1] + 2 * marks[of]] = data
        behind = starts[1:] + shift[starts[1:]] + 2 * marks
        out[behind[~closing]] = 255
        out[behind[~closing] + 1] = 0xD0 + number[~closing] % 8
        edges = np.concatenate([[0], (behind + 2 * ~closing)[first_lane[1:] - 1]])
        scans.append((out.tobytes(), edges))
    segment = lambda mark, body: struct.pack(">BBH", 255, mark, len(body) + 2) + body
    tables = segment(0xDB, b"\0" + b"\1" * 64) + segment(0xC4, b"\0" + _DC_TABLE) + segment(0xC4, b"\x10" + _AC_TABLE) + segment(0xDD, struct.pack(">H", RESTART))
    heads = [[segment(0xDA, bytes([1, c + 1, 0, first, last, high << 4 | low])) for c in range(3)] for first, last, high, low in SCRIPT]
    files = []
    for n, ((across, down), comment) in enumerate(zip(shapes, comments)):
        sof = segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
        parts = [b"\xff\xd8", segment(0xFE, comment), sof, tables]
        for (data, edges), head in zip(scans, heads):
            for c in range(3):
                parts += [head[c], data[edges[3 * n + c] : edges[3 * n + c + 1]]]
        files.append(b"".join(parts) + b"\xff\xd9")
    return files
