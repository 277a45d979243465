"""Lossless WebP (VP8L) in numpy: a complete decoder, and an encoder able to use every feature.

Pixels are ARGB in uint32 arrays of shape (height, width).  Where all pixels share one group of prefix
codes and there is no colour cache, the decoder works speculatively: the length of the step that
would begin at every bit is looked up at once, the true starts are followed through that table in strides, and
symbols are read at the starts only.  Other images are decoded step by step through the same tables.
"""

from __future__ import annotations

import struct
from functools import lru_cache
from math import log2

import numpy as np

from tessera.llm import token_files

# Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
ALPHABETS = (280, 256, 256, 256, 40)
#: Short distances: the 120 offsets (x, y) to earlier pixels, nearest first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
LARGEST = 1 << 14


def blocks(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


# -- decoder -------------------------------------------------------------------------------------


class Bits:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at, self._words = data, 0, None

    def words(self) -> np.ndarray:
        """The 64 bits that begin with each byte (zeros follow the last): room for any code behind up to seven bits."""
        if self._words is None:
            raw = np.frombuffer(self.data + b"\0" * 24, np.uint8)
            self._words = np.lib.stride_tricks.as_strided(raw, (len(self.data) + 16, 8), (1, 1)).copy().view("<u8").reshape(-1)
        return self._words

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        at = self.at
        return (int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7)) & ((1 << n) - 1)


def _reverse(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Codes of up to 15 bits with their bits in the order of the stream."""
    v = codes.astype(np.uint32)
    v = (v & 0x5555) << 1 | (v >> 1) & 0x5555
    v = (v & 0x3333) << 2 | (v >> 2) & 0x3333
    v = (v & 0x0F0F) << 4 | (v >> 4) & 0x0F0F
    v = (v & 0x00FF) << 8 | (v >> 8) & 0x00FF
    return v >> (16 - lengths).astype(np.uint32)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes, as they lie in the stream, of the symbols in order of (length, symbol)."""
    size = np.sort(lengths[lengths > 0]).astype(np.int64)
    span = np.int64(1) << (15 - size)
    return _reverse((np.cumsum(span) - span) >> (15 - size), size)


@lru_cache
def _reversed(bits: int) -> np.ndarray:
    """0, 1, ... with their lowest bits turned round."""
    return _reverse(np.arange(1 << bits), np.full(1 << bits, bits))


class Code:
    """A prefix code: table[bits of the stream] = symbol << 4 | length."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            used, self.bits, self.table = np.array([0]), 0, np.zeros(1, np.uint32)
        elif len(used) == 1:
            self.bits, self.table = 0, np.array([used[0] << 4], np.uint32)
        else:
            order = used[np.argsort(lengths[used], kind="stable")]
            size = lengths[order].astype(np.int64)
            if (np.int64(1) << (15 - size)).sum() != 1 << 15:
                raise ValueError("a prefix code is not complete")
            self.bits = int(size[-1])
            span = np.int64(1) << (self.bits - size)
            self.table = np.empty(1 << self.bits, np.uint32)
            # entries in order of the code's value, then moved to the reversed index
            self.table[_reversed(self.bits)] = np.repeat((order << 4 | size).astype(np.uint32), span)

    def read(self, bits: Bits) -> int:
        entry = int(self.table[bits.peek(self.bits)]) if self.bits else int(self.table[0])
        bits.at += entry & 15
        return entry >> 4


@lru_cache
def _length_table(n: int, packed: int) -> tuple[list, int]:
    """(table, bits) of the code that n packed lengths of three bits give."""
    meta = np.zeros(19, np.int64)
    for k, i in enumerate(LENGTH_ORDER[:n]):
        meta[i] = packed >> 3 * k & 7
    code = Code(meta)
    return code.table.tolist(), code.bits


@lru_cache
def _simple(first: int, second: int | None) -> Code:
    lengths = np.zeros(256, np.int64)
    lengths[[first] if second is None else [first, second]] = 1
    return Code(lengths)


def read_code(bits: Bits, size: int) -> Code:
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        return _simple(first, bits.read(8) if two else None)
    lengths = np.zeros(size, np.int64)
    n = 4 + bits.read(4)
    table, width = _length_table(n, bits.read(3 * n))
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    out, previous, mask = [], 8, (1 << width) - 1
    words, at = memoryview(bits.words()), bits.at
    left, add = size, out.append
    try:
        while left > 0 and most:
            most -= 1
            x = words[at >> 3] >> (at & 7)
            entry = table[x & mask]
            n, s = entry & 15, entry >> 4
            at += n
            if s < 16:
                add(s)
                left -= 1
                if s:
                    previous = s
                continue
            if s == 16:
                run = 3 + (x >> n & 3)
                out += [previous] * run
                at += 2
            elif s == 17:
                run = 3 + (x >> n & 7)
                out += [0] * run
                at += 3
            else:
                run = 11 + (x >> n & 127)
                out += [0] * run
                at += 7
            left -= run
    except IndexError:
        raise ValueError("the image ends early") from None
    bits.at = at
    if len(out) > size:
        raise ValueError("code lengths run over")
    lengths[: len(out)] = out
    return Code(lengths)


def _distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _decode_in_order(bits: Bits, width: int, height: int, cache_bits: int, groups: list, meta, meta_bits: int, seen: set) -> np.ndarray:
    """Pixels one after the other: references, colour cache and several groups of codes."""
    n, data = width * height, bits.data
    words = memoryview(bits.words())
    books = [[x for code in group for x in (memoryview(code.table), (1 << code.bits) - 1)] for group in groups]
    green, green_mask, red, red_mask, blue, blue_mask, alpha, alpha_mask, far, far_mask = books[0]
    of_pixel = meta.tolist() if meta is not None and len(books) > 1 else None
    cache, shift = [0] * (1 << cache_bits) if cache_bits else None, 32 - cache_bits
    out, at, p = [0] * n, 0, bits.at
    try:
        while at < n:
            if of_pixel:
                green, green_mask, red, red_mask, blue, blue_mask, alpha, alpha_mask, far, far_mask = books[of_pixel[at // width >> meta_bits][at % width >> meta_bits]]
            x = words[p >> 3] >> (p & 7)
            e = green[x & green_mask]
            k, s = e & 15, e >> 4
            if s < 256:
                x >>= k
                e = red[x & red_mask]
                j = e & 15
                x >>= j
                v = s << 8 | e >> 4 << 16
                e = blue[x & blue_mask]
                p += k + j + (e & 15)
                v |= e >> 4
                e = alpha[words[p >> 3] >> (p & 7) & alpha_mask]
                p += e & 15
                v |= e >> 4 << 24
                out[at] = v
                at += 1
                if cache:
                    cache[(v * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = v
            elif s >= 280:
                p += k
                out[at] = cache[s - 280]
                at += 1
            else:
                p += k
                length, p = _value_at(s - 256, words, p)
                e = far[words[p >> 3] >> (p & 7) & far_mask]
                d, p = _value_at(e >> 4, words, p + (e & 15))
                d = _distance(d, width)
                if d > at or at + length > n:
                    raise ValueError("a reference leaves the image")
                part = out[at - d : at - d + length] if d >= length else (out[at - d : at] * (length // d + 1))[:length]
                out[at : at + length] = part
                at += length
                seen.add("references")
                if cache:
                    for v in part:
                        cache[(v * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift] = v
    except IndexError:
        raise ValueError("the image ends early") from None
    if p > 8 * len(data):
        raise ValueError("the image ends early")
    bits.at = p
    return np.array(out, np.uint32).reshape(height, width)


def _value_at(symbol: int, words, p: int) -> tuple[int, int]:
    """(length or distance code, position behind its extra bits)."""
    if symbol < 4:
        return symbol + 1, p
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + (words[p >> 3] >> (p & 7) & ((1 << extra) - 1)) + 1, p + extra


def _from_cache(pixels: np.ndarray, slots: np.ndarray, cache_bits: int) -> np.ndarray:
    """Pixels, those that name a slot (-1: none) filled in with the last pixel before them that went there, 0 if none did."""
    hit = slots >= 0
    slot = np.where(hit, slots, (pixels * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - cache_bits)).astype(np.uint16)
    order = np.argsort(slot, kind="stable")
    places, given = np.arange(len(order)), ~hit.take(order)
    source = np.maximum.accumulate(np.where(given, places, -1))
    runs = np.concatenate([[True], np.diff(slot.take(order)) != 0])
    found = source >= np.maximum.accumulate(np.where(runs, places, 0))
    out = np.empty_like(pixels)
    out[order] = np.where(found, pixels.take(order.take(source)), np.uint32(0))
    return out


def _decode_at_once(bits: Bits, width: int, height: int, group: list, seen: set, cache_bits: int = 0) -> np.ndarray:
    """An image with one group of codes, of plain pixels and either references or a colour cache."""
    n = width * height
    start, n_bits = bits.at, 8 * len(bits.data) - bits.at
    word = bits.words()[start >> 3 :]
    # window[i]: 25 bits or more from the i-th bit on; a symbol takes 15 at most, extra bits 18
    count = n_bits + 1
    lead = start & 7
    window = (word.astype(np.uint32)[:, None] >> np.arange(8, dtype=np.uint32)).reshape(-1)[lead : lead + count]

    def entries(code: Code, at=None) -> np.ndarray:
        return code.table.take((window if at is None else window.take(at)) & np.uint32((1 << code.bits) - 1))

    last = count - 1
    green = entries(group[0])
    step = np.minimum(np.arange(count) + (green & 15), last)
    follow = step
    for code in group[1:4]:
        if code.bits:
            follow = np.minimum(follow + (entries(code, follow) & 15), last)
    if cache_bits:
        hits = np.flatnonzero(green >> 4 >= 280)
        follow = follow.copy() if follow is step else follow
        follow[hits] = step[hits]
    refers = not cache_bits and (group[0].table >> 4 >= 256).any()
    if refers:
        refs = np.flatnonzero(green >> 4 >= 256)
        follow = follow.copy() if follow is step else follow
        follow[refs] = _reference(window, step[refs], (green[refs] >> 4) - 256, entries, group[4], last)[2]
    starts = _orbit(follow, n)
    symbol = green.take(starts) >> 4
    out = np.zeros(n, np.uint32)
    if refers:
        is_ref = symbol >= 256
        length, far, _ = _reference(window, step[starts[is_ref]], symbol[is_ref] - 256, entries, group[4], last)
        sizes = np.ones(len(starts), np.int64)
        sizes[is_ref] = length
        ends = np.cumsum(sizes)
        tokens = int(np.searchsorted(ends, n)) + 1
        if tokens > len(ends) or ends[tokens - 1] != n:
            raise ValueError("the image ends early or runs over")
        place, is_ref = ends - sizes, is_ref[:tokens]
        copies = list(zip(place[:tokens][is_ref].tolist(), length.tolist(), far.tolist()))
        end = int(follow[starts[tokens - 1]])
        starts, symbol, place = starts[:tokens][~is_ref], symbol[:tokens][~is_ref], place[:tokens][~is_ref]
    else:
        if len(starts) < n:
            raise ValueError("the image ends early")
        copies, place, end = [], slice(None), int(follow[starts[-1]])
    pixels = symbol << 8
    p = step.take(starts)
    for code, shift in zip(group[1:4], (16, 0, 24), strict=True):
        e = entries(code, p) if code.bits else code.table[0]
        pixels = pixels | (e >> 4) << np.uint32(shift)
        p = np.minimum(p + (e & 15), last)
    if cache_bits:
        pixels = _from_cache(pixels, np.where(symbol >= 280, symbol.astype(np.int64) - 280, -1), cache_bits)
    out[place] = pixels
    for at, size, code in copies:
        d = _distance(code, width)
        if d > at:
            raise ValueError("a reference leaves the image")
        out[at : at + size] = out[at - d : at - d + size] if d >= size else np.resize(out[at - d : at], size)
    if copies:
        seen.add("references")
    bits.at = start + end
    return out.reshape(height, width)


def _reference(window, p, symbol, entries, far: Code, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, distance codes, first bits behind) of references whose length symbols end at the bits p."""

    def value(symbol, p):
        symbol = symbol.astype(np.int64)
        extra = np.maximum(symbol - 2, 0) >> 1
        more = window[p].astype(np.int64) & ((1 << extra) - 1)
        return np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << extra) + more) + 1, np.minimum(p + np.where(symbol < 4, 0, extra), last)

    length, p = value(symbol, p.astype(np.int64))
    e = entries(far, p)
    code, p = value(e >> 4, np.minimum(p + (e & 15), last))
    return length, code, p


def _orbit(follow: np.ndarray, n: int) -> np.ndarray:
    """0, follow[0], follow[follow[0]], ...: up to n of them (a few more at the end may repeat the last bit)."""
    if follow[0] == 0:  # steps of no bits: every pixel is the same
        return np.zeros(n, np.int64)
    stride = 1
    far = follow
    while stride < 16 and stride * 32 < n:
        far = far.take(far)
        stride *= 2
    table, p, end, heads = memoryview(far), 0, len(follow) - 1, []
    while len(heads) * stride < n:
        heads.append(p)
        p = table[p]
        if p >= end and len(heads) * stride < n:
            heads.append(p)
            break
    out = np.empty((stride, len(heads)), np.int64)
    out[0] = heads
    for k in range(1, stride):
        follow.take(out[k - 1], out=out[k], mode="clip")
    return out.T.reshape(-1)[:n]


def decode_stream(bits: Bits, width: int, height: int, main: bool, fast: bool, seen: set) -> np.ndarray:
    """An entropy-coded image; only the main one may have several groups of codes."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    meta, meta_bits, n = None, 0, 1
    if cache_bits:
        seen.add("cache")
    if main and bits.read(1):
        seen.add("groups")
        meta_bits = bits.read(3) + 2
        meta = decode_stream(bits, blocks(width, meta_bits), blocks(height, meta_bits), False, fast, seen) >> 8 & 0xFFFF
        n = int(meta.max()) + 1
    groups = [[read_code(bits, s + (1 << cache_bits if cache_bits and not i else 0)) for i, s in enumerate(ALPHABETS)] for _ in range(n)]
    symbols = groups[0][0].table >> 4
    if fast and n == 1 and not (cache_bits and ((symbols >= 256) & (symbols < 280)).any()):
        return _decode_at_once(bits, width, height, groups[0], seen, cache_bits)
    return _decode_in_order(bits, width, height, cache_bits, groups, meta, meta_bits, seen)


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _join(c) -> int:
    a, r, g, b = c
    return a << 24 | r << 16 | g << 8 | b


def predict(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """The prediction of a mode from the pixels left, above, above left and above right."""
    if mode in (0, 14, 15):
        return 0xFF000000
    if mode < 5:
        return (left, top, right, corner)[mode - 1]
    if mode < 11:
        a = {5: (_average(left, right), top), 6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right), 10: (_average(left, corner), _average(top, right))}[mode]
        return _average(*a)
    l, t, c = _channels(left), _channels(top), _channels(corner)
    if mode == 11:
        return left if sum(abs(y - z) for y, z in zip(t, c, strict=True)) < sum(abs(x - z) for x, z in zip(l, c, strict=True)) else top
    if mode == 12:
        return _join(_clamp(x + y - z) for x, y, z in zip(l, t, c, strict=True))
    m = _channels(_average(left, top))
    return _join(_clamp(x + int((x - z) / 2)) for x, z in zip(m, c, strict=True))


def _add(a: int, b: int) -> int:
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _sub(a: int, b: int) -> int:
    return ((a | 0x00FF00FF) - (b & 0xFF00FF00) & 0xFF00FF00) | ((a | 0xFF00FF00) - (b & 0x00FF00FF) & 0x00FF00FF)


def _neighbours(rows: list, x: int, y: int, modes, bits: int) -> int:
    """The prediction at (x, y) from decoded pixels."""
    if not y:
        return rows[0][x - 1] if x else 0xFF000000
    above, row = rows[y - 1], rows[y]
    if not x:
        return above[0]
    right = above[x + 1] if x + 1 < len(above) else row[0]
    return predict(int(modes[y >> bits][x >> bits]), row[x - 1], above[x], above[x - 1], right)


def unpredict(image: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    one = set(np.unique(modes >> 8 & 15).tolist())
    if one in ({1}, {2}) or 1 in image.shape:  # left or above throughout: running sums of each channel
        parts = image.view(np.uint8).reshape(*image.shape, 4).copy() if image.flags.c_contiguous else np.ascontiguousarray(image).view(np.uint8).reshape(*image.shape, 4).copy()
        parts[:1, 0, 3] += np.uint8(255)
        along = int(one == {1} and 1 not in image.shape)
        lead = parts[:, 0] if along else parts[0]
        lead[:] = np.cumsum(lead, 0, dtype=np.uint8)
        parts = np.cumsum(parts, along, dtype=np.uint8)
        return np.ascontiguousarray(parts).view(np.uint32).reshape(image.shape)
    rows, modes = image.tolist(), (modes >> 8 & 15).tolist()
    for y, row in enumerate(rows):
        for x in range(len(row)):
            row[x] = _add(row[x], _neighbours(rows, x, y, modes, bits))
    return np.array(rows, np.uint32).reshape(image.shape)


def _cross_deltas(elements: np.ndarray, bits: int, shape, green, red):
    e = np.repeat(np.repeat(elements, 1 << bits, 0), 1 << bits, 1)[: shape[0], : shape[1]]
    signed = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int32)
    times = lambda t, c: signed(t) * signed(c) >> 5
    return times(e, green), times(e >> 8, green), lambda r: times(e >> 16, r)


def uncross(image: np.ndarray, elements: np.ndarray, bits: int) -> np.ndarray:
    red, green, blue = image >> 16 & 255, image >> 8 & 255, image & 255
    to_red, to_blue, from_red = _cross_deltas(elements, bits, image.shape, green, red)
    red = (red.astype(np.int64) + to_red & 255).astype(np.uint32)
    blue = (blue.astype(np.int64) + to_blue + from_red(red) & 255).astype(np.uint32)
    return image & 0xFF00FF00 | red << 16 | blue


def ungreen(image: np.ndarray) -> np.ndarray:
    green = image >> 8 & 255
    return image & 0xFF00FF00 | ((image >> 16) + green & 255) << 16 | (image + green & 255)


def unpalette(image: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    pack = _pack_bits(len(table))
    index = image >> 8 & 255
    if pack:
        each, size = 1 << pack, 8 >> pack
        index = (index[:, :, None] >> (np.arange(each, dtype=np.uint32) * size) & ((1 << size) - 1)).reshape(len(image), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index]


def _pack_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode_vp8l(data: bytes, fast: bool = True, seen: set | None = None) -> np.ndarray:
    """The pixels of a VP8L payload; seen collects the names of the features it uses."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    return decode_body(bits, width, height, fast, set() if seen is None else seen)


def decode_body(bits: Bits, width: int, height: int, fast: bool, seen: set) -> np.ndarray:
    """Transforms and pixels, as they follow a payload's header (or stand alone in an alpha chunk)."""
    inverse, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        seen.add(("predictor", "cross", "green", "palette")[kind])
        if kind in (PREDICTOR, CROSS):
            size = bits.read(3) + 2
            sub = decode_stream(bits, blocks(wide, size), blocks(height, size), False, fast, seen)
            inverse.append((lambda f, sub, size: lambda x: f(x, sub, size))(unpredict if kind == PREDICTOR else uncross, sub, size))
        elif kind == GREEN:
            inverse.append(ungreen)
        else:
            table = decode_stream(bits, bits.read(8) + 1, 1, False, fast, seen)[0]
            parts = np.stack([np.cumsum(table >> s & 255, dtype=np.uint32) & 255 for s in (24, 16, 8, 0)])
            table = parts[0] << 24 | parts[1] << 16 | parts[2] << 8 | parts[3]
            inverse.append((lambda t, w: lambda x: unpalette(x, t, w))(table, wide))
            wide = blocks(wide, _pack_bits(len(table)))
    image = decode_stream(bits, wide, height, True, fast, seen)
    for f in reversed(inverse):
        image = f(image)
    return image


def used(media: bytes) -> set[str]:
    """Names of the features that the images use."""
    seen: set[str] = set()
    for payload in images(media):
        decode_vp8l(payload, seen=seen)
    return seen


def images(media: bytes):
    """The VP8L payloads of one or more WebP files in a row."""
    at = 0
    while at < len(media):
        riff, size, webp, chunk, n = struct.unpack_from("<4sI4s4sI", media, at)
        if (riff, webp, chunk) != (b"RIFF", b"WEBP", b"VP8L"):
            raise ValueError("not a lossless WebP file")
        yield media[at + 20 : at + 20 + n]
        at += 8 + size


# -- encoder -------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Huffman's code lengths; package-merge only where they pass the limit."""
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 3 or n > 600:
        return token_files.code_lengths(counts, limit)
    order = used[np.argsort(counts[used], kind="stable")]
    weight, up = counts[order].tolist() + [1 << 62], [0] * (2 * n - 1)
    made, leaf, node = [], 0, 0
    for k in range(n, 2 * n - 1):  # two queues: leaves by weight, and sums in the order they are made
        total = 0
        for _ in (0, 1):
            if node < len(made) and made[node] < weight[leaf]:
                up[n + node] = k
                total += made[node]
                node += 1
            else:
                up[leaf] = k
                total += weight[leaf]
                leaf += 1
        made.append(total)
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[up[k]] + 1
    if max(depth[:n]) > limit:
        return token_files.code_lengths(counts, limit)
    out = np.zeros(len(counts), np.uint8)
    out[order] = depth[:n]
    return out


class Writer:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def write_code(w: Writer, lengths: np.ndarray) -> None:
    """A prefix code's lengths, simply where one or two byte symbols allow it."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        used = used.tolist() or [0]
        w.put(1, 1)
        w.put(len(used) - 1, 1)
        w.put(int(used[0] > 1), 1)
        w.put(used[0], 8 if used[0] > 1 else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    if len(used) == 1:  # a lone symbol that the simple form can't name
        lengths = lengths.copy()
        lengths[0] = 1
    w.put(0, 1)
    used = np.flatnonzero(lengths)
    tokens = []
    for gap, size in zip((used - np.concatenate([[-1], used[:-1]]) - 1).tolist(), lengths[used].tolist(), strict=True):
        while gap >= 3:
            n = min(gap, 138)
            tokens.append((17, n - 3, 3) if n < 11 else (18, n - 11, 7))
            gap -= n
        if gap:
            tokens += [(0, 0, 0)] * gap
        tokens.append((size, 0, 0))
    w.put(LENGTH_HEAD, LENGTH_HEAD_BITS)
    if len(tokens) < 2:
        tokens.append((0, 0, 0))
    most = len(tokens) - 2
    n = max(0, (most.bit_length() - 1) // 2)
    w.put(1 | n << 1 | most << 4, 6 + 2 * n)
    value, size = 0, 0
    for t, extra, bits in tokens:
        k = LENGTH_SIZES[t]
        value |= (LENGTH_CODES[t] | extra << k) << size
        size += k + bits
    w.put(value, size)


def _length_code() -> tuple[list, list, int, int]:
    """(sizes, codes, header, its bits) of one complete code for code lengths, used for all of them.

    Long runs of unused symbols get three bits, usual lengths four, the others five; "as before" is not used.
    """
    sizes = np.array([3 if s > 16 else 0 if s == 16 else 4 if s in (0, 5, 6, 7, 8, 9, 10, 11) else 5 for s in range(19)])
    used = np.flatnonzero(sizes)
    codes = np.zeros(19, np.int64)
    codes[used[np.argsort(sizes[used], kind="stable")]] = canonical(sizes)
    head, bits = 15, 4  # lengths of all 19 follow
    for i in LENGTH_ORDER:
        head |= int(sizes[i]) << bits
        bits += 3
    return sizes.tolist(), codes.tolist(), head, bits


LENGTH_SIZES, LENGTH_CODES, LENGTH_HEAD, LENGTH_HEAD_BITS = _length_code()


def write_only(w: Writer, *symbols: int) -> None:
    """For each symbol below 256 a prefix code of nothing else."""
    for symbol in symbols:
        w.put(1 | int(symbol > 1) << 2, 3)
        w.put(symbol, 8 if symbol > 1 else 1)


def pack_bits(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, int]:
    """(64-bit words, bits): values of up to 15 bits in a row, lowest bit first."""
    ends = np.cumsum(sizes)
    at = ends - sizes
    bits = int(ends[-1]) if len(ends) else 0
    words = np.zeros(bits // 64 + 2, np.uint64)
    if bits:
        word, off = at >> 6, (at & 63).astype(np.uint64)
        heads = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[heads]] = np.add.reduceat(values << off, heads)
        over = np.flatnonzero((at & 63) + sizes > 64)
        words[word[over] + 1] += values[over] >> (np.uint64(64) - off[over])
    return words, bits


def _prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra value, extra bits) of a length or distance code."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    extra = top - 1
    return 2 * top + second, v - ((2 + second) << extra), extra


def write_stream(w: Writer, image: np.ndarray, main: bool, cache_bits: int = 0, references: bool = False, meta: np.ndarray | None = None, meta_bits: int = 2) -> None:
    """An entropy-coded image, pixel by pixel; optionally with a cache, references and several groups."""
    height, width = image.shape
    pixels = image.reshape(-1).tolist()
    w.put(int(cache_bits > 0), 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if main:
        w.put(int(meta is not None), 1)
        if meta is not None:
            w.put(meta_bits - 2, 3)
            write_stream(w, meta.astype(np.uint32) << 8, False)
    n = int(meta.max()) + 1 if meta is not None else 1
    near = {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(NEAR)))}
    cache, seen, last = {}, 0, {}
    steps, at = [], 0
    while at < len(pixels):
        group = int(meta[at // width >> meta_bits, at % width >> meta_bits]) if meta is not None else 0
        length = 0
        if references and (before := last.get(tuple(pixels[at : at + 3]))) is not None:
            while at + length < len(pixels) and length < 4096 and pixels[before + length] == pixels[at + length]:
                length += 1
        index = (CACHE_MULTIPLIER * pixels[at] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if length >= 3:
            d = at - before
            steps.append((group, "ref", _prefix(length), _prefix(near.get(d, d + 120))))
        elif cache_bits and cache.get(index) == pixels[at]:
            length = 1
            steps.append((group, "cache", index))
        else:
            length = 1
            a, r, g, b = _channels(pixels[at])
            steps.append((group, "pixel", g, r, b, a))
        for k in range(at, at + length):
            last[tuple(pixels[k : k + 3])] = k
            if cache_bits:
                cache[(CACHE_MULTIPLIER * pixels[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]
        at += length
    counts = [[np.zeros(s + (1 << cache_bits if cache_bits and not i else 0), np.int64) for i, s in enumerate(ALPHABETS)] for _ in range(n)]
    for group, kind, *v in steps:
        c = counts[group]
        if kind == "pixel":
            for i in range(4):
                c[i][v[i]] += 1
        elif kind == "cache":
            c[0][280 + v[0]] += 1
        else:
            c[0][256 + v[0][0]] += 1
            c[4][v[1][0]] += 1
    books = []
    for c in counts:
        book = []
        for x in c:
            lengths = code_lengths(x, 15)
            write_code(w, lengths)
            used = np.flatnonzero(lengths)
            if len(used) == 1 and used[0] >= 256:  # write_code() gave symbol 0 the other half
                lengths[0] = 1
            codes = np.zeros(len(x), np.int64)
            order = np.flatnonzero(lengths)
            codes[order[np.argsort(lengths[order], kind="stable")]] = canonical(lengths)
            book.append((codes.tolist(), (lengths * (np.count_nonzero(lengths) > 1)).tolist()))
        books.append(book)
    for group, kind, *v in steps:
        book = books[group]

        def put(i, s, book=book):
            w.put(book[i][0][s], book[i][1][s])

        if kind == "pixel":
            for i in range(4):
                put(i, v[i])
        elif kind == "cache":
            put(0, 280 + v[0])
        else:
            for i, shift, (s, extra, n_extra) in ((0, 256, v[0]), (4, 0, v[1])):
                put(i, shift + s)
                w.put(extra, n_extra)


def _header(w: Writer, width: int, height: int, alpha: bool) -> None:
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(int(alpha), 1)
    w.put(0, 3)


def _container(payload: bytes) -> bytes:
    body = payload + b"\0" * (len(payload) & 1)
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(body), b"WEBP", b"VP8L", len(payload)) + body


def encode_image(image: np.ndarray, transforms: tuple = (), bits: int = 3, modes: np.ndarray | None = None, elements: np.ndarray | None = None, **stream) -> bytes:
    """A WebP file of an image with the transforms named, in their order; palettes need 256 colours or fewer."""
    height, width = image.shape
    w = Writer()
    _header(w, width, height, True)
    for kind in transforms:
        w.put(1, 1)
        w.put(kind, 2)
        if kind == PREDICTOR:
            w.put(bits - 2, 3)
            write_stream(w, modes.astype(np.uint32) << 8, False)
            rows = image.tolist()
            image = np.array([[_sub(p, _neighbours(rows, x, y, modes, bits)) for x, p in enumerate(row)] for y, row in enumerate(rows)], np.uint32).reshape(image.shape)
        elif kind == CROSS:
            w.put(bits - 2, 3)
            write_stream(w, elements, False)
            red, green, blue = image >> 16 & 255, image >> 8 & 255, image & 255
            to_red, to_blue, from_red = _cross_deltas(elements, bits, image.shape, green, red)
            blue = (blue.astype(np.int64) - to_blue - from_red(red) & 255).astype(np.uint32)
            red = (red.astype(np.int64) - to_red & 255).astype(np.uint32)
            image = image & 0xFF00FF00 | red << 16 | blue
        elif kind == GREEN:
            green = image >> 8 & 255
            image = image & 0xFF00FF00 | ((image >> 16) - green & 255) << 16 | (image - green & 255)
        else:
            table, index = np.unique(image, return_inverse=True)
            w.put(len(table) - 1, 8)
            parts = [np.diff(table >> s & 255, prepend=0).astype(np.int64) & 255 for s in (24, 16, 8, 0)]
            write_stream(w, (parts[0] << 24 | parts[1] << 16 | parts[2] << 8 | parts[3]).astype(np.uint32)[None], False)
            pack = _pack_bits(len(table))
            index = index.reshape(image.shape).astype(np.uint32)
            each, size = 1 << pack, 8 >> pack
            index = np.pad(index, ((0, 0), (0, blocks(index.shape[1], pack) * each - index.shape[1])))
            image = (index.reshape(height, -1, each) << (np.arange(each, dtype=np.uint32) * size)).sum(2, dtype=np.uint32) << 8 | 0xFF000000
    w.put(0, 1)
    write_stream(w, image, True, **stream)
    return _container(w.value.to_bytes((w.size + 7) // 8, "little"))


# Layouts of a payload: its bytes as the green of 64 pixels a row, or four bytes a pixel and 16 pixels a row.
ROW = 64
MATCH = 16  # bytes of the shortest reference
CACHE_BITS = 11
GAIN = 0.95  # a form that takes more steps must be smaller by this factor


@lru_cache(1)
def _times_log() -> np.ndarray:
    """n log2 n of 0, 1, 2, ...: 1 MB."""
    n = np.arange(1 << 17, dtype=np.float64)
    return n * np.log2(np.maximum(n, 1))


def _bits_of(counts: np.ndarray) -> float:
    """Bits that symbols cost at their entropy, and about five for each one's code length."""
    total, table = int(counts.sum()), _times_log()
    if total < len(table):
        return float(table[total] - table.take(counts).sum()) + 5 * int(np.count_nonzero(counts))
    c = np.maximum(counts, 1).astype(np.float64)  # a count of one adds nothing
    return total * log2(total) - float(c @ np.log2(c)) + 5 * int(np.count_nonzero(counts))


def _book(w: Writer, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, size) of every symbol, after writing their lengths; the only symbol takes no bits."""
    lengths = code_lengths(counts, 15)
    write_code(w, lengths)
    used = np.flatnonzero(lengths)
    if len(used) == 1 and used[0] >= 256:  # write_code() gave symbol 0 the other half
        lengths[0] = 1
        used = np.flatnonzero(lengths)
    codes = np.zeros(len(counts), np.uint64)
    if len(used) < 2:
        return codes, np.zeros(len(counts), np.int64)
    codes[used[np.argsort(lengths[used], kind="stable")]] = canonical(lengths)
    return codes, lengths.astype(np.int64)


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, extra value, extra bits) of length or distance codes, as _prefix()."""
    v = values - 1
    top = np.frexp(np.maximum(v, 1).astype(np.float64))[1].astype(np.int64) - 1
    second = v >> np.maximum(top - 1, 0) & 1
    extra = np.where(values <= 4, 0, top - 1)
    symbol = np.where(values <= 4, v, 2 * top + second)
    return symbol, np.where(values <= 4, 0, v - ((2 + second) << extra)), extra


def _finish(w: Writer, values: np.ndarray, sizes: np.ndarray) -> bytes:
    """The file of a header and the codes behind it."""
    head = np.frombuffer(w.value.to_bytes((w.size + 7) // 8, "little"), np.uint8)
    lead = w.size & 7  # the header's last byte goes on with the codes
    some = np.flatnonzero(sizes)
    if len(some) < len(sizes):
        values, sizes = values.take(some), sizes.take(some)
    words, n = pack_bits(np.concatenate([[np.uint64(head[-1] if lead else 0)], values]), np.concatenate([[lead], sizes]))
    return _container((head[:-1] if lead else head).tobytes() + words.view(np.uint8)[: (n + 7) // 8].tobytes())


def _plain(w: Writer, flat: np.ndarray, alpha: int = 255) -> bytes:
    """Pixels with the samples as their green."""
    w.put(0b00, 2)  # no colour cache, one group of codes
    codes, sizes = _book(w, np.bincount(flat, minlength=280))
    write_only(w, 0, 0, alpha, 0)  # red, blue, alpha, distance
    return _finish(w, codes.take(flat), sizes.take(flat))


def find_references(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of repeats of MATCH bytes or more, left to right, none overlapping.

    Repeats are looked for from the bytes behind blanks, or from every byte where blanks are few.
    """
    n = len(flat)
    if n < 2 * MATCH:
        return []
    eight = np.lib.stride_tricks.as_strided(flat, (n - 7, 8), (1, 1))
    places = np.flatnonzero(flat[: n - MATCH] <= 32) + 1
    if len(places) * 16 < n:
        places = np.arange(n - MATCH + 1)
    a, b = (np.ascontiguousarray(eight[places + k]).view(np.uint64).reshape(-1) for k in (0, 8))
    mixed = (a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0xD6E8FEB86659FD93)
    key = np.sort(mixed >> np.uint64(32) << np.uint64(32) | np.arange(len(places), dtype=np.uint64))
    same = np.flatnonzero((key[1:] ^ key[:-1]) >> np.uint64(32) == 0)
    now, old = ((key[same + k] & np.uint64(0xFFFFFFFF)).astype(np.int64) for k in (1, 0))
    equal = (a[now] == a[old]) & (b[now] == b[old])
    now, old = now[equal], old[equal]
    order = np.argsort(now)
    place, distance = places[now[order]], places[now[order]] - places[old[order]]
    out, free = [], 0
    for at, d in zip(place.tolist(), distance.tolist(), strict=True):
        if at < free:
            continue
        length, step = MATCH, 64
        while True:
            x, y = flat[at + length : at + length + step], flat[at + length - d : at + length - d + step]
            differ = np.flatnonzero(x != y[: len(x)])
            length += int(differ[0]) if len(differ) else len(x)
            if len(differ) or at + length >= n:
                break
            step = min(step * 4, 1 << 16)
        out.append((at, length, d))
        free = at + length
    return out


def _with_references(w: Writer, flat: np.ndarray, found: list) -> bytes:
    pieces = [(at + k, min(4096, length - k), d) for at, length, d in found for k in range(0, length, 4096)]
    at, length, distance = np.array(pieces, np.int64).T
    near = {max(1, x + y * ROW): i + 1 for i, (x, y) in reversed(list(enumerate(NEAR)))}
    coded = np.array([near.get(d, d + 120) for d in distance.tolist()], np.int64)
    plain = np.ones(len(flat), bool)
    step = np.zeros(len(flat) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    plain = np.cumsum(step[:-1]) == 0
    literal = np.flatnonzero(plain)
    place = np.concatenate([literal, at])
    order = np.argsort(place, kind="stable")
    n, m = len(literal), len(at)
    ls, lv, lb = _prefixes(length)
    ds, dv, db = _prefixes(coded)
    w.put(0b00, 2)
    codes, sizes = _book(w, np.bincount(np.concatenate([flat[literal], ls + 256]), minlength=280))
    write_only(w, 0, 0, 255)
    far, far_sizes = _book(w, np.bincount(ds, minlength=40))
    values, widths = np.zeros((n + m, 4), np.uint64), np.zeros((n + m, 4), np.int64)
    values[:n, 0], widths[:n, 0] = codes[flat[literal]], sizes[flat[literal]]
    for k, (v, z) in enumerate(((codes[ls + 256], sizes[ls + 256]), (lv, lb), (far[ds], far_sizes[ds]), (dv, db))):
        values[n:, k], widths[n:, k] = v, z
    return _finish(w, values[order].reshape(-1), widths[order].reshape(-1))


def cached_pixels(pixels: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot of each pixel, whether the last pixel of its slot before it is the same)."""
    slot = ((pixels * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(32 - bits)).astype(np.uint16)
    order = np.argsort(slot, kind="stable")
    hit = np.zeros(len(pixels), bool)
    hit[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
    return slot, hit


def _with_cache(w: Writer, pixels: np.ndarray, slot: np.ndarray, hit: np.ndarray, bits: int) -> bytes:
    w.put(1, 1)
    w.put(bits, 4)
    w.put(0, 1)  # one group of codes
    green = np.where(hit, slot.astype(np.int64) + 280, pixels >> 8 & 255)
    codes, sizes = _book(w, np.bincount(green, minlength=280 + (1 << bits)))
    values, widths = np.zeros((len(pixels), 4), np.uint64), np.zeros((len(pixels), 4), np.int64)
    values[:, 0], widths[:, 0] = codes[green], sizes[green]
    for k, shift in enumerate((16, 0, 24), 1):
        part = pixels >> np.uint32(shift) & 255
        codes, sizes = _book(w, np.bincount(part[~hit], minlength=256))
        values[:, k], widths[:, k] = codes[part], np.where(hit, 0, sizes[part])
    write_only(w, 0)
    return _finish(w, values.reshape(-1), widths.reshape(-1))


def _palette(flat: np.ndarray, colours: np.ndarray) -> bytes:
    """Up to 16 byte values as a palette, several indices in one pixel."""
    w = Writer()
    _header(w, ROW, len(flat) // ROW, False)
    w.put(1, 1)
    w.put(PALETTE, 2)
    w.put(len(colours) - 1, 8)
    table = colours.astype(np.int64) << 8 | 0xFF000000
    parts = [np.diff(table >> s & 255, prepend=0) & 255 for s in (24, 16, 8, 0)]
    write_stream(w, (parts[0] << 24 | parts[1] << 16 | parts[2] << 8 | parts[3]).astype(np.uint32)[None], False)
    w.put(0, 1)
    pack = _pack_bits(len(colours))
    index = np.searchsorted(colours, flat).astype(np.uint8).reshape(-1, 1 << pack)
    return _plain(w, (index << (np.arange(1 << pack, dtype=np.uint8) * (8 >> pack))).sum(1, dtype=np.uint8))


def _predicted(flat: np.ndarray, mode: int) -> np.ndarray:
    """Samples less the one left of them (mode 1) or above (mode 2)."""
    rows = flat.reshape(-1, ROW)
    out = rows.copy()
    out[0, 1:] -= rows[0, :-1]
    out[1:, 0] -= rows[:-1, 0]
    if mode == 1:
        out[1:, 1:] -= rows[1:, :-1]
    else:
        out[1:, 1:] -= rows[:-1, 1:]
    return out.reshape(-1)


def encode_samples(flat: np.ndarray) -> bytes:
    """A WebP file of bytes, a multiple of ROW of them, in the form that is expected to be smallest by some margin.

    Forms: plain samples; a palette of up to 16 values; prediction from the left or from above; references
    to earlier bytes; four bytes a pixel with a colour cache.  samples_of() undoes any of them.
    """
    counts = np.bincount(flat, minlength=256)
    colours = np.flatnonzero(counts)
    if len(colours) <= 16:
        return _palette(flat, colours.astype(np.uint8))
    plain = _bits_of(counts)
    best, form = plain * GAIN, "plain"
    for mode, apart in ((1, 1), (2, ROW)):
        if (cost := _bits_of(np.bincount(flat[apart:] - flat[:-apart], minlength=256)) + 60) < best and len(flat) > ROW:
            best, form = cost, mode
    if found := find_references(flat):
        left = len(flat) - sum(length for _, length, _ in found)
        each = sum(20 + d.bit_length() for _, _, d in found)
        if (cost := plain * left / len(flat) + each) < best:
            best, form = cost, "references"
    pixels = flat.view("<u4")
    bits = min(CACHE_BITS, max(1, len(pixels).bit_length() + 1))
    slot, hit = cached_pixels(pixels, bits)
    green = np.where(hit, slot.astype(np.int64) + 280, pixels >> 8 & 255)
    cost = _bits_of(np.bincount(green))
    for shift in (0, 16, 24):
        if cost >= best:
            break
        cost += _bits_of(np.bincount((pixels >> np.uint32(shift) & 255)[~hit]))
    w = Writer()
    if cost < best:
        _header(w, ROW // 4, len(flat) // ROW, True)
        w.put(0, 1)
        return _with_cache(w, pixels, slot, hit, bits)
    _header(w, ROW, len(flat) // ROW, False)
    if form in (1, 2):
        w.put(1, 1)
        w.put(PREDICTOR, 2)
        w.put(7, 3)  # blocks of 512 pixels a side
        write_stream(w, np.full((blocks(len(flat) // ROW, 9), 1), form << 8, np.uint32), False)
        w.put(0, 1)
        return _plain(w, _predicted(flat, form), 0)
    w.put(0, 1)
    return _with_references(w, flat, found) if form == "references" else _plain(w, flat)


def samples_of(image: np.ndarray) -> np.ndarray:
    """The bytes of a decoded image: the green of rows of 64 pixels, or all four bytes of rows of 16."""
    if image.shape[1] == ROW:
        return (image >> 8).astype(np.uint8).reshape(-1)
    return np.ascontiguousarray(image).astype("<u4").view(np.uint8).reshape(-1)
