"""Lossless WebP (VP8L): a whole decoder, and an encoder of byte payloads.

The decoder reads the published bitstream: prefix codes (simple and run-length coded), entropy images, back-references
with the near-pixel distance codes, the colour cache, and the predictor, cross-colour, subtract-green and palette
transforms, which it inverts in turn. A picture of one prefix group and no cache, as the encoder writes, is decoded
with arrays: the code that would start at every bit of a window is looked up at once and the chain of true starts is
followed; back-references are handled as they are met.

The encoder puts one byte into the green sample of each pixel, of 64 pixels a row. It writes one complete prefix code,
runs as back-references of distance 1, and a palette where 16 values or fewer occur, so pixels share a sample.
"""

from __future__ import annotations

import struct
from functools import cache

import numpy as np

WIDTH, MAX_SIDE = 64, 16384
#: Longest prefix code that the encoder writes, and lengths that one back-reference can take.
CODE_BITS, MAX_RUN = 12, 4096
WINDOW = 1 << 15
_EIGHT = np.arange(8, dtype=np.int32)

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_MULTIPLIER = 0x1E35A7BD


@cache
def _reversed_bits(n: int) -> np.ndarray:
    """The order in which bit-reversed codes of n bits stand."""
    x = np.arange(1 << n, dtype=np.int64)
    out = np.zeros_like(x)
    for i in range(n):
        out |= ((x >> i) & 1) << (n - 1 - i)
    return out


class Code:
    """A prefix code as a table over the next ``bits`` bits. A code of one symbol takes no bits."""

    __slots__ = ("bits", "lens", "mask", "only", "pairs", "syms")

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            used = np.zeros(1, np.int64)
        self.only = int(used[0]) if len(used) == 1 else None
        self.pairs = None
        if self.only is not None:
            self.bits, self.mask, self.syms, self.lens = 0, 0, np.array([self.only], np.int32), np.zeros(1, np.int32)
            return
        ln = lengths[used].astype(np.int64)
        self.bits = int(ln.max())
        self.mask = (1 << self.bits) - 1
        order = np.lexsort((used, ln))
        times = 1 << (self.bits - ln[order])
        if int(times.sum()) != 1 << self.bits:
            raise ValueError("a prefix code isn't complete")
        turn = _reversed_bits(self.bits)
        self.syms = np.repeat(used[order], times)[turn].astype(np.int32)
        self.lens = np.repeat(ln[order], times)[turn].astype(np.int32)


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes, pos: int = 0):
        self.data, self.pos, self.end = data, pos, 8 * len(data)

    def read(self, n: int) -> int:
        at = self.pos
        self.pos = at + n
        if self.pos > self.end:
            raise ValueError("the data end early")
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 5], "little") >> (at & 7)) & ((1 << n) - 1)

    def symbol(self, code: Code) -> int:
        if code.only is not None:
            return code.only
        if code.pairs is None:
            code.pairs = list(zip(code.syms.tolist(), code.lens.tolist(), strict=True))
        at = self.pos
        sym, n = code.pairs[(int.from_bytes(self.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)) & code.mask]
        self.pos = at + n
        if self.pos > self.end:
            raise ValueError("the data end early")
        return sym

    def amount(self, prefix: int) -> int:
        """The length or distance that a prefix symbol and its extra bits stand for."""
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.read(extra) + 1


def _read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):  # one or two symbols
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        own[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code, left = Code(own), size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, last = 0, 8
    while at < size and left:
        left -= 1
        n = bits.symbol(code)
        if n < 16:
            lengths[at] = n
            at += 1
            last = n or last
        else:
            value, times = (last, 3 + bits.read(2)) if n == 16 else (0, 3 + bits.read(3)) if n == 17 else (0, 11 + bits.read(7))
            if at + times > size:
                raise ValueError("code lengths run over")
            lengths[at : at + times] = value
            at += times
    return Code(lengths)


def _read_group(bits: Bits, cache_bits: int) -> tuple[Code, ...]:
    return tuple(_read_code(bits, n) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40))


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _copy(out: np.ndarray, at: int, distance: int, length: int) -> None:
    if distance > at or at + length > len(out):
        raise ValueError("a back-reference leaves the picture")
    while length > 0:
        n = min(distance, length)
        out[at : at + n] = out[at - distance : at - distance + n]
        at, length, distance = at + n, length - n, distance + n


def _by_symbols(bits: Bits, width: int, height: int, groups: list, which: np.ndarray | None, block: int, cache_bits: int) -> np.ndarray:
    """Any picture, symbol by symbol."""
    total = width * height
    out, at = np.zeros(total, np.uint32), 0
    kept, filled = [0] * (1 << cache_bits), 0

    def fill(to: int) -> None:
        nonlocal filled
        if cache_bits:
            for p in out[filled:to].tolist():
                kept[(CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
            filled = to

    while at < total:
        green, red, blue, alpha, far = groups[0 if which is None else which[(at // width) >> block, (at % width) >> block]]
        s = bits.symbol(green)
        if s < 256:
            r, b, a = bits.symbol(red), bits.symbol(blue), bits.symbol(alpha)
            out[at] = a << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 280:
            length = bits.amount(s - 256)
            _copy(out, at, _distance(bits.amount(bits.symbol(far)), width), length)
            at += length
        else:
            fill(at)
            out[at] = kept[s - 280]
            at += 1
    return out


def _by_windows(bits: Bits, width: int, height: int, group: tuple[Code, ...]) -> np.ndarray:
    """The last picture of a stream, of one group and no cache."""
    green, red, blue, alpha, far = group
    total, at = width * height, 0
    out = np.zeros(total, np.uint32)
    data = np.frombuffer(bits.data, np.uint8)
    rest = [(c, s) for c, s in ((red, 16), (blue, 0), (alpha, 24)) if c.only is None]
    base = sum(c.only << s for c, s in ((red, 16), (blue, 0), (alpha, 24)) if c.only is not None)
    if green.only is not None and not rest and green.only < 256:
        out[:] = base | green.only << 8
        return out
    backs = green.only is None and bool((green.syms > 255).any()) or (green.only or 0) > 255
    packed = green.syms | green.lens << 16
    while at < total:
        first = bits.pos >> 3
        part = data[first : first + WINDOW + 16]
        n = len(part)
        d = np.zeros(n + 24, np.int32)
        d[:n] = part
        d = d[:-2] | d[1:-1] << 8 | d[2:] << 16
        v = (d[:, None] >> _EIGHT).ravel()
        limit, zero, p = 8 * min(n, WINDOW), 8 * first, bits.pos - 8 * first
        here = np.arange(len(v), dtype=np.int32)
        look = packed[v & green.mask]
        syms = look & 0xFFFF
        ends = here + (look >> 16)
        starts = []
        for c, _ in rest:
            np.minimum(ends, len(v) - 1, out=ends)
            starts.append(ends)
            ends = ends + c.lens[v[ends] & c.mask]
        # A back-reference, and what lies beyond the window, leads to itself.
        ends[limit:] = here[limit:]
        if backs:
            ends = np.where(syms > 255, here, ends)
        leap = ends[ends]
        leap = leap[leap]
        leap = leap[leap]
        jump = memoryview(leap)
        while at < total and p < limit:
            anchors, q, most = [], p, -1 if green.only is not None and not rest else (total - at) // 8 + 1
            while most > 0 and (to := jump[q]) != q:
                anchors.append(q)
                q, most = to, most - 1
            steps = np.empty((len(anchors), 8), np.int32)
            col = np.array(anchors, np.int32)
            for i in range(8):
                steps[:, i] = col
                col = ends[col]
            idx = steps.ravel()
            if len(idx) and ends[idx[-1]] == idx[-1]:  # the last leap ran into its end
                idx = idx[: len(idx) - 8 + int(np.argmax(ends[idx[-8:]] == idx[-8:]))]
            idx = idx[: total - at]
            pixels = syms[idx].astype(np.uint32) << np.uint32(8) | np.uint32(base)
            for (c, shift), s in zip(rest, starts, strict=True):
                pixels |= c.syms[v[s[idx]] & c.mask].astype(np.uint32) << np.uint32(shift)
            out[at : at + len(idx)] = pixels
            at += len(idx)
            p = q
            if at < total and p < limit and syms[p] > 255:
                bits.pos = zero + p
                s = bits.symbol(green)
                if s > 279:
                    raise ValueError("a cache code without a cache")
                length = bits.amount(s - 256)
                _copy(out, at, _distance(bits.amount(bits.symbol(far)), width), length)
                at += length
                p = bits.pos - zero
        bits.pos = zero + p
        if at < total and bits.pos >= bits.end:
            raise ValueError("the data end early")
    return out


def _picture(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    cache_bits = bits.read(4) if bits.read(1) else 0
    which, block, count = None, 0, 1
    if main and bits.read(1):
        block = 2 + bits.read(3)
        small = _picture(bits, -(-width >> block), -(-height >> block), False)
        which = (small >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.int64).reshape(-(-height >> block), -1)
        count = int(which.max()) + 1
    groups = [_read_group(bits, cache_bits) for _ in range(count)]
    if main and count == 1 and not cache_bits:
        return _by_windows(bits, width, height, groups[0])
    return _by_symbols(bits, width, height, groups, which, block, cache_bits)


def _channels(argb: np.ndarray) -> np.ndarray:
    """Four planes: alpha, red, green, blue."""
    return np.stack([argb >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int32)


def _joined(planes: np.ndarray) -> np.ndarray:
    p = planes.astype(np.uint32)
    return p[..., 0] << np.uint32(24) | p[..., 1] << np.uint32(16) | p[..., 2] << np.uint32(8) | p[..., 3]


def predicted(mode: int, left: list[int], top: list[int], top_right: list[int], top_left: list[int]) -> list[int]:
    """The predictor ``mode`` from the four neighbours, each four samples."""
    mean = lambda x, y: [(i + j) >> 1 for i, j in zip(x, y, strict=True)]
    near = lambda x: min(255, max(0, x))
    if mode == 11:
        guess = [i + j - k for i, j, k in zip(left, top, top_left, strict=True)]
        to = lambda x: sum(abs(i - j) for i, j in zip(guess, x, strict=True))
        return left if to(left) < to(top) else top
    if mode == 12:
        return [near(i + j - k) for i, j, k in zip(left, top, top_left, strict=True)]
    if mode == 13:
        return [near(m + int((m - k) / 2)) for m, k in zip(mean(left, top), top_left, strict=True)]
    simple = {1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left, 5: lambda: mean(mean(left, top_right), top), 6: lambda: mean(left, top_left), 7: lambda: mean(left, top), 8: lambda: mean(top_left, top), 9: lambda: mean(top, top_right), 10: lambda: mean(mean(left, top_left), mean(top, top_right))}
    return simple.get(mode, lambda: [255, 0, 0, 0])()


def _undo_predictor(argb: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    px = _channels(argb).tolist()
    h, w = argb.shape
    for y in range(h):
        row, above = px[y], px[y - 1] if y else None
        for x in range(w):
            if not y:
                p = row[x - 1] if x else [255, 0, 0, 0]
            elif not x:
                p = above[0]
            else:
                p = predicted(int(modes[y >> block, x >> block]), row[x - 1], above[x], above[x + 1] if x + 1 < w else row[0], above[x - 1])
            row[x] = [(i + j) & 255 for i, j in zip(row[x], p, strict=True)]
    return _joined(np.array(px, np.int32).reshape(h, w, 4))


def _signed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int32) & 255 ^ 128) - 128


def cross_colour(argb: np.ndarray, elements: np.ndarray, block: int, sign: int) -> np.ndarray:
    """Add (sign 1, inverse) or take away (-1) the shares of green and red in red and blue."""
    h, w = argb.shape
    p = _channels(argb)
    e = _channels(np.repeat(np.repeat(elements, 1 << block, 0), 1 << block, 1)[:h, :w])
    share = lambda t, c: _signed(t) * _signed(c) >> 5
    red = p[..., 1].copy()
    p[..., 1] = red + sign * share(e[..., 3], p[..., 2]) & 255
    p[..., 3] = p[..., 3] + sign * (share(e[..., 2], p[..., 2]) + share(e[..., 1], p[..., 1] if sign > 0 else red)) & 255
    return _joined(p)


def _undo_palette(argb: np.ndarray, palette: np.ndarray, width: int, share: int) -> np.ndarray:
    index = (argb >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    if share:
        each = 8 >> share
        index = (index[:, :, None] >> each * np.arange(1 << share) & (1 << each) - 1).reshape(len(argb), -1)[:, :width]
    whole = np.zeros(256, np.uint32)
    whole[: len(palette)] = palette
    return whole[index]


def palette_share(size: int) -> int:
    """The power of two of pixels that share a sample under a palette of ``size``."""
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """The picture of a lossless file as uint32 ARGB, rows first. ValueError if the file isn't one or is damaged."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != b"\x2f":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack_from("<I", data, 16)[0]
    bits = Bits(data[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    steps, w, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = 2 + bits.read(3)
            steps.append((kind, _picture(bits, -(-w >> block), -(-height >> block), False).reshape(-(-height >> block), -1), block))
        elif kind == PALETTE:
            n = bits.read(8) + 1
            steps.append((kind, _joined(np.cumsum(_channels(_picture(bits, n, 1, False)), 0) & 255), w))
            w = -(-w >> palette_share(n))
        else:
            steps.append((kind,))
    argb = _picture(bits, w, height, True).reshape(height, w)
    for kind, *more in reversed(steps):
        if kind == PREDICTOR:
            argb = _undo_predictor(argb, more[0] >> np.uint32(8) & np.uint32(255), more[1])
        elif kind == CROSS_COLOUR:
            argb = cross_colour(argb, more[0], more[1], 1)
        elif kind == PALETTE:
            argb = _undo_palette(argb, more[0], more[1], palette_share(len(more[0])))
        else:
            p = _channels(argb)
            p[..., 1] = p[..., 1] + p[..., 2] & 255
            p[..., 3] = p[..., 3] + p[..., 2] & 255
            argb = _joined(p)
    return argb


class Writer:
    """Collects (value, bits) and packs them, least significant first."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.sizes: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.values.append(value)
        self.sizes.append(n)

    def packed(self, values: np.ndarray | None = None, sizes: np.ndarray | None = None) -> bytes:
        v, n = np.array(self.values, np.int32), np.array(self.sizes, np.int32)
        if values is not None:
            v, n = np.concatenate([v, values]), np.concatenate([n, sizes])
        ends = np.cumsum(n)
        within = np.arange(int(ends[-1]), dtype=np.int32) - np.repeat((ends - n).astype(np.int32), n)
        return np.packbits((np.repeat(v, n) >> within & 1).astype(np.uint8), bitorder="little").tobytes()


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a complete code of CODE_BITS at most: Shannon's lengths, with what is left given to frequent symbols."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    c = counts[used].astype(np.float64)
    c = np.maximum(c, c.sum() / (1 << CODE_BITS - 1))
    ln = np.minimum(np.ceil(np.log2(c.sum() / c) - 1e-12), CODE_BITS).astype(np.int64)
    ln = np.maximum(ln, 1)
    order, left = np.argsort(-c, kind="stable").tolist(), (1 << CODE_BITS) - int((1 << CODE_BITS - ln).sum())
    ln = ln.tolist()
    while left:
        for i in order:
            if ln[i] > 1 and 1 << CODE_BITS - ln[i] <= left:
                left -= 1 << CODE_BITS - ln[i]
                ln[i] -= 1
    lengths[used] = ln
    return lengths


def codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical codes of ``lengths``, bits reversed as they are written."""
    used = np.flatnonzero(lengths)
    ln = lengths[used]
    order = np.lexsort((used, ln))
    ln = ln[order]
    weights = 1 << (16 - ln)
    high = (np.cumsum(weights) - weights) >> (16 - ln)
    out = np.zeros(len(lengths), np.int64)
    for n in set(ln.tolist()):
        out[used[order[ln == n]]] = _reversed_bits(n)[high[ln == n]]
    return out


def write_code(out: Writer, lengths: np.ndarray) -> None:
    """One prefix code. A code of one symbol under 256, or none, takes the simple form."""
    used = np.flatnonzero(lengths).tolist()
    if len(used) < 2 and max(used, default=0) < 256:
        out.put(1, 1)
        out.put(0, 1)
        out.put(1, 1)
        out.put(used[0] if used else 0, 8)
        return
    out.put(0, 1)
    items: list[tuple[int, int, int]] = []
    ln, i = lengths.tolist(), 0
    last = used[-1] + 1
    while i < last:
        j = i + 1
        if not ln[i]:
            while j < last and not ln[j] and j - i < 138:
                j += 1
            if j - i >= 3:
                items.append((17, j - i - 3, 3) if j - i < 11 else (18, j - i - 11, 7))
                i = j
                continue
        items.append((ln[i], 0, 0))
        i += 1
    if len(items) < 2:
        items.append((0, 0, 0))
    own = np.bincount([s for s, _, _ in items], minlength=19)
    short = _short_lengths(own)
    top = max(i for i, s in enumerate(CODE_LENGTH_ORDER) if short[s] or i < 4)
    out.put(top + 1 - 4, 4)
    for s in CODE_LENGTH_ORDER[: top + 1]:
        out.put(int(short[s]), 3)
    out.put(1, 1)
    out.put(3, 3)  # the count of lengths takes 8 bits, or 10
    if len(items) - 2 >= 256:
        out.values[-1] = 4
        out.put(len(items) - 2, 10)
    else:
        out.put(len(items) - 2, 8)
    bits = codes(short).tolist()
    only = np.count_nonzero(short) == 1
    for s, extra, n in items:
        if not only:
            out.put(bits[s], int(short[s]))
        if n:
            out.put(extra, n)


def _short_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of 7 at most for the code of lengths: 32 steps of weight suffice for 19 symbols."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(19, np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    c = np.maximum(counts[used].astype(float), counts.sum() / 64)
    ln = np.maximum(1, np.minimum(7, np.ceil(np.log2(c.sum() / c) - 1e-12))).astype(int).tolist()
    left = 128 - sum(1 << 7 - n for n in ln)
    order = np.argsort(-c, kind="stable").tolist()
    while left:
        for i in order:
            if ln[i] > 1 and 1 << 7 - ln[i] <= left:
                left -= 1 << 7 - ln[i]
                ln[i] -= 1
    lengths[used] = ln
    return lengths


def prefix_of(amount: int) -> tuple[int, int, int]:
    """The prefix symbol, extra value and extra bits of a length or distance."""
    if amount <= 4:
        return amount - 1, 0, 0
    x = amount - 1
    high = x.bit_length() - 1
    second = x >> (high - 1) & 1
    return 2 * high + second, x & (1 << high - 1) - 1, high - 1


def framed(stream: bytes) -> bytes:
    chunk = b"\x2f" + stream
    pad = len(chunk) & 1
    return b"RIFF" + struct.pack("<I", 12 + len(chunk) + pad) + b"WEBPVP8L" + struct.pack("<I", len(chunk)) + chunk + b"\0" * pad


def _encode_tile(samples: np.ndarray) -> bytes:
    out, height = Writer(), len(samples) // WIDTH
    out.put(WIDTH - 1, 14)
    out.put(height - 1, 14)
    out.put(0, 1)
    out.put(0, 3)
    counts = np.bincount(samples, minlength=256)
    values = np.flatnonzero(counts)
    if len(values) <= 16:
        share = palette_share(len(values))
        place = np.zeros(256, np.uint8)
        place[values] = np.arange(len(values))
        samples = (place[samples].reshape(-1, 1 << share) << (8 >> share) * np.arange(1 << share)).sum(1).astype(np.uint8)
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(values) - 1, 8)
        out.put(0, 1)  # no cache; the palette's samples follow as differences
        steps = np.diff(values, prepend=0)
        lengths = code_lengths(np.bincount(steps, minlength=280))
        write_code(out, lengths)
        for n in (256, 256, 256, 40):
            write_code(out, np.zeros(n))
        if np.count_nonzero(lengths) > 1:
            bits = codes(lengths)
            for s in steps.tolist():
                out.put(int(bits[s]), int(lengths[s]))
    out.put(0, 1)  # no more transforms
    out.put(0, 1)  # no cache
    out.put(0, 1)  # one group
    # Runs of 5 equal samples or more: the first as it is, the others as back-references of distance 1.
    edges = np.flatnonzero(np.diff(samples)) + 1
    starts = np.concatenate([[0], edges])
    runs = np.diff(np.append(starts, len(samples)))
    long = runs >= 5
    if long.any():
        keep = np.ones(len(samples), bool)
        at, what = [], []
        for s, n in zip(starts[long].tolist(), runs[long].tolist(), strict=True):
            keep[s + 1 : s + n] = False
            n -= 1
            while n:
                part = min(n, MAX_RUN)
                at.append(s + 1)
                what.append(prefix_of(part))
                n -= part
        where = (np.cumsum(keep) - keep)[at]
        syms = np.insert(samples[keep].astype(np.int64), where, [256 + s for s, _, _ in what])
        extra = np.insert(np.zeros(int(keep.sum()), np.int64), where, [e for _, e, _ in what])
        more = np.insert(np.zeros(int(keep.sum()), np.int64), where, [n for _, _, n in what])
    else:
        syms, extra, more = samples.astype(np.int64), None, None
    lengths = code_lengths(np.bincount(syms, minlength=280))
    write_code(out, lengths)
    for _ in range(3):
        write_code(out, np.zeros(256))
    distance = np.zeros(40, np.int64)
    distance[1] = 1  # the second near distance is one pixel to the left
    write_code(out, distance)
    bits = codes(lengths)
    n = lengths if np.count_nonzero(lengths) > 1 else np.zeros_like(lengths)
    v, sizes = bits[syms], n[syms]
    if extra is not None:
        v, sizes = v | extra << sizes, sizes + more
    return framed(out.packed(v.astype(np.int32), sizes.astype(np.int32)))


def encode_bytes(payload: bytes) -> bytes:
    """Files of 64 pixels a row and 16,384 rows at most, one after the other, that hold ``payload`` in green.

    The length of ``payload`` is a positive multiple of 64. Equal payloads give equal files.
    """
    if not payload or len(payload) % WIDTH:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    step = WIDTH * MAX_SIDE
    return b"".join(_encode_tile(np.frombuffer(payload, np.uint8, min(step, len(payload) - at), at)) for at in range(0, len(payload), step))


def decode_bytes(media: bytes) -> np.ndarray:
    """The green samples of the files in ``media``, rows of 64."""
    tiles, at = [], 0
    while at < len(media):
        size = 8 + struct.unpack_from("<I", media, at + 4)[0]
        tiles.append((decode(media[at : at + size]) >> np.uint32(8) & np.uint32(255)).astype(np.uint8))
        at += size
    return np.concatenate(tiles)
