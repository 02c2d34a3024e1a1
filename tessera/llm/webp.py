"""Lossless WebP for batches of small images: writing, and reading in lockstep.

Images are rows of 0xAARRGGBB pixels. decode() reads any lossless still; all
images of a call advance one symbol at a time together, so the work of a symbol is
numpy over images. encode() writes prefix codes, back-references, a colour
cache and, where they make the pixels cheaper, a predictor, a cross-colour or a
palette transform. Both are functions of the single image alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

# Fixed values of the file format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
GREEN, LENGTHS = 256, 24
DISTANCES = 40
CACHE_MUL = np.uint32(0x1E35A7BD)
OPAQUE = np.uint32(0xFF000000)
PREDICTOR, CROSS, SUBTRACT, PALETTE = 0, 1, 2, 3


def _near() -> np.ndarray:
    """Offsets (right, up) of the 120 short distance codes, the nearest first.

    They are the pixels up to 7 rows above and 8 columns beside one in reading
    order before it, by distance, then by the format's fixed order of ties.
    """
    found = []
    for dy in range(8):
        for dx in range(-7, 9):
            if dy or dx > 0:
                found.append((dx * dx + dy * dy, abs(dx), dx < 0, dx, dy))
    found.sort(key=lambda t: (t[0], t[1], t[2]))
    return np.array([(t[3], t[4]) for t in found if t[3] * t[3] + t[4] * t[4] <= 113], np.int64)[:120]


NEAR = _near()
_REVERSED = np.array([int(f"{i:015b}"[::-1], 2) for i in range(1 << 15)], np.int64)
#: Code lengths for code lengths that the writer always uses: 13 of 4 bits and 6 of 5.
_STATIC = np.array([4] * 13 + [5] * 6, np.int64)


class Bits:
    """Reader of bits, the lowest first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        byte = self.at >> 3
        value = int.from_bytes(self.data[byte : byte + (n + 14 >> 3)], "little") >> (self.at & 7)
        self.at += n
        return value & ((1 << n) - 1)

    def peek15(self) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 4], "little") >> (self.at & 7)) & 0x7FFF


ROOT = 9  # bits of the direct tables
_ROOT_REVERSED = _REVERSED[: 1 << ROOT] >> (15 - ROOT)


@dataclass
class Codes:
    """Canonical prefix codes of many alphabets, decoded by table and, for long codes, by search."""

    table: np.ndarray  # 2^ROOT entries an alphabet, by the next bits: symbol * 16 + length; 15 for longer codes
    first: np.ndarray  # left-aligned first code of every coded symbol, plus alphabet * 2^15
    symbol: np.ndarray
    length: np.ndarray

    @staticmethod
    def build(alphabet: np.ndarray, symbol: np.ndarray, length: np.ndarray, count: int) -> Codes:
        """Of entries sorted by alphabet and symbol; an alphabet with one symbol has length 0."""
        order = np.lexsort((symbol, length, alphabet))
        alphabet, symbol, length = alphabet[order], symbol[order], length[order]
        room = np.left_shift(1, 15 - length)
        ends = np.cumsum(room)
        sums = np.bincount(alphabet, room, count)
        if not ((sums == 1 << 15) | (sums == 0)).all():
            raise ValueError("a prefix code is not complete")
        before = np.concatenate(([0], np.cumsum(sums)[:-1])).astype(np.int64)
        first = ends - room - before[alphabet]
        table = np.zeros((count, 1 << ROOT), np.uint16)
        short = length <= ROOT
        entry = symbol * 16 + length
        entry[~short] = 15
        width = np.where(short, np.left_shift(1, np.maximum(ROOT - length, 0)), 0)
        flat = np.repeat(entry, width)
        start = np.repeat(alphabet * (1 << ROOT) + (first >> (15 - ROOT)) - (np.cumsum(width) - width), width)
        table.ravel()[start + np.arange(len(flat))] = flat
        long = np.flatnonzero(~short)
        table[alphabet[long], first[long] >> (15 - ROOT)] = 15
        return Codes(table[:, _ROOT_REVERSED].ravel(), first + (alphabet << 15), symbol, length)

    def decode(self, alphabet: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and lengths at every lane's window, of which the lowest 15 bits count."""
        entry = self.table.take((alphabet << ROOT) + (window & ((1 << ROOT) - 1))).astype(np.int64)
        symbol, length = entry >> 4, entry & 15
        long = length == 15
        if long.any():
            far = np.flatnonzero(long)
            at = np.searchsorted(self.first, _REVERSED[window[far] & 0x7FFF] + (alphabet[far] << 15), "right") - 1
            symbol[far], length[far] = self.symbol[at], self.length[at]
        return symbol, length


@lru_cache(maxsize=4096)
def _length_table(count: int, fields: int) -> list[tuple[int, int]]:
    """(symbol, length) for every value of the next 7 bits, from count lengths of three bits each."""
    lengths = [0] * 19
    for i in range(count):
        lengths[LENGTH_ORDER[i]] = fields >> 3 * i & 7
    some = [i for i in range(19) if lengths[i]]
    if len(some) == 1:
        return [(some[0], 0)] * 128
    table = [(0, 0)] * 128
    code = 0
    for n in range(1, 8):
        for s in some:
            if lengths[s] == n:
                for k in range(int(f"{code:0{n}b}"[::-1], 2), 128, 1 << n):
                    table[k] = (s, n)
                code += 1
        code <<= 1
    return table


def _read_lengths(bits: Bits, size: int) -> tuple[list[int], list[int]]:
    """Symbols and code lengths of one code; a single symbol has length 0."""
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)]
        if two:
            symbols.append(bits.read(8))
        return sorted(symbols), [len(symbols) - 1] * len(symbols)
    count = 4 + bits.read(4)
    table = _length_table(count, bits.read(3 * count))
    most = size
    if bits.read(1):
        most = 2 + bits.read(2 + 2 * bits.read(3))
    out, last = [0] * size, 8
    at, pos, left, w = 0, bits.at, 0, 0
    while at < size and most:
        most -= 1
        if left < 16:
            w, left = int.from_bytes(bits.data[pos >> 3 : (pos >> 3) + 120], "little") >> (pos & 7), 900
        s, n = table[w & 127]
        if s < 16:
            out[at] = s
            at += 1
            last = s or last
        elif s == 16:
            k = 3 + (w >> n & 3)
            n += 2
            out[at : at + k] = [last] * k
            at += k
        elif s == 17:
            at += 3 + (w >> n & 7)
            n += 3
        else:
            at += 11 + (w >> n & 127)
            n += 7
        w >>= n
        pos += n
        left -= n
    bits.at = pos
    if len(out) > size or at > size:
        raise ValueError("code lengths run over")
    symbols = [i for i, n in enumerate(out) if n]
    return symbols, [0] if len(symbols) == 1 else [out[i] for i in symbols]


@dataclass
class Plan:
    """What the header of one entropy-coded image says."""

    width: int
    height: int
    cache_bits: int = 0
    groups: int = 1
    group_bits: int = 0
    group_of: np.ndarray | None = None
    codes: list[tuple[list[int], list[int]]] = field(default_factory=list)
    at: int = 0  # where the pixels begin, in bits


def _read_codes(bits: Bits, plan: Plan) -> Plan:
    cache = (1 << plan.cache_bits) if plan.cache_bits else 0
    for _ in range(plan.groups):
        for size in (GREEN + LENGTHS + cache, 256, 256, 256, DISTANCES):
            plan.codes.append(_read_lengths(bits, size))
    plan.at = bits.at
    return plan


def _small(bits: Bits, width: int, height: int):
    """A sub-image: transform data, palette or groups of codes. Yields its plan and is sent its pixels and their end."""
    plan = Plan(width, height)
    if bits.read(1):
        plan.cache_bits = bits.read(4)
    pixels, bits.at = yield _read_codes(bits, plan)
    return pixels.reshape(height, width)


def read_pixels(streams: list[bytes], plans: list[Plan]) -> tuple[list[np.ndarray], np.ndarray]:
    """Pixels of all images, one symbol of every image at a time, and where each ended."""
    n = len(streams)
    sizes = np.array([p.width * p.height for p in plans], np.int64)
    begin = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint32)
    padded = [len(s) + (-len(s)) % 4 + 12 for s in streams]
    flat = np.frombuffer(b"".join([*(s + bytes(p - len(s)) for s, p in zip(streams, padded)), bytes(4)]), "<u4").astype(np.uint64)
    flat = flat[:-1] | (flat[1:] << np.uint64(32))  # at every word the 64 bits from there
    word0 = (np.cumsum(padded) - padded) * 8
    code0 = np.cumsum([0] + [len(p.codes) for p in plans])
    alphabet, symbol, length = [], [], []
    for p, c in zip(plans, code0.tolist()):
        for k, (s, m) in enumerate(p.codes):
            alphabet += [c + k] * len(s)
            symbol += s
            length += m
    codes = Codes.build(np.array(alphabet, np.int64), np.array(symbol, np.int64), np.array(length, np.int64), int(code0[-1]))
    # Where every alpha code has one symbol, none of them takes bits.
    only = np.array([x[0][0] if x[0] else 0 for p in plans for x in p.codes], np.int64)
    plain = all(len(x[0]) == 1 for p in plans for x in p.codes[3::5])
    most = max((p.cache_bits for p in plans), default=0)
    cache = np.zeros((n, 1 << most), np.uint32)
    shift = np.array([32 - p.cache_bits if p.cache_bits else 31 for p in plans], np.uint32)
    meta = [p for p in plans if p.group_of is not None]
    lane = np.flatnonzero(sizes > 0)
    bit = word0 + np.array([p.at for p in plans], np.int64)
    ends = bit.copy()
    widths = np.array([p.width for p in plans], np.int64)

    def window(at: np.ndarray) -> np.ndarray:
        return (flat.take(at >> 5) >> (at & 31).view(np.uint64)).view(np.int64)

    def value(prefix: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number behind a length or distance prefix, and its extra bits."""
        extra = np.maximum((prefix - 2) >> 1, 0)
        base = np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + 1)
        return base + (window(at) & ((1 << extra) - 1)), extra

    # The state of the images still at work, kept together while none finishes. Every
    # step takes one symbol of each: a literal, a cache entry or a whole back-reference.
    b, p, c0, sh, wide, base, total = (x[lane] for x in (bit, np.zeros(n, np.int64), code0[:-1], shift, widths, begin, sizes))
    caching = most > 0
    while len(lane):
        cc = c0
        if meta:
            cc = c0 + np.array([0 if plans[k].group_of is None else 5 * int(plans[k].group_of[(q // w) >> plans[k].group_bits, (q % w) >> plans[k].group_bits]) for k, q, w in zip(lane.tolist(), p.tolist(), wide.tolist())], np.int64)
        view = window(b)
        green, m = codes.decode(cc, view)
        # Red, blue and alpha are looked up for all; what is no literal passes over them.
        red, m1 = codes.decode(cc + 1, view >> m)
        view = window(b + m + m1)
        blue, m2 = codes.decode(cc + 2, view)
        width = m + m1 + m2
        if plain:
            alpha = only.take(cc + 3)
        else:
            alpha, m3 = codes.decode(cc + 3, view >> m2)
            width += m3
        argb = (alpha << 24 | red << 16 | green << 8 | blue).astype(np.uint32)
        step = 1
        other = np.flatnonzero(green >= GREEN)
        if len(other):
            width[other] = m[other]
            symbol = green[other] - GREEN
            hit = other[symbol >= LENGTHS]
            if len(hit):
                argb[hit] = cache[lane[hit], green[hit] - GREEN - LENGTHS]
            back = other[symbol < LENGTHS]
            if len(back):
                tb = b[back] + m[back]
                run, extra = value(green[back] - GREEN, tb)
                tb = tb + extra
                dp, md = codes.decode(cc[back] + 4, window(tb))
                tb = tb + md
                far, extra = value(dp, tb)
                width[back] = tb + extra - b[back]
                short = np.minimum(far, 120) - 1
                plane = np.maximum(NEAR[short, 1] * wide[back] + NEAR[short, 0], 1)
                away = np.where(far > 120, far - 120, plane)
                if (away > p[back]).any():
                    raise ValueError("a back-reference points before the image")
                run = np.minimum(run, total[back] - p[back])
                # A run longer than its distance repeats what it copies.
                k = np.arange(int(run.sum())) - np.repeat(np.cumsum(run) - run, run)
                to = np.repeat(base[back] + p[back], run)
                copied = out[to - np.repeat(away, run) + k % np.repeat(away, run)]
                out[to + k] = copied
                if caching:
                    cache[np.repeat(lane[back], run), (CACHE_MUL * copied) >> np.repeat(sh[back], run)] = copied
                argb[back] = copied[np.cumsum(run) - 1]
                step = np.ones(len(lane), np.int64)
                step[back] = run
        b = b + width
        p = p + step
        out[base + p - 1] = argb
        if caching:
            cache[lane, (CACHE_MUL * argb) >> sh] = argb
        done = p >= total
        if done.any():
            ends[lane[done]] = b[done] - word0[lane[done]]
            go = ~done
            lane, b, p, c0, sh, wide, base, total = (x[go] for x in (lane, b, p, c0, sh, wide, base, total))
    return [out[a : a + s] for a, s in zip(begin.tolist(), sizes.tolist())], ends


def _channels(x: np.ndarray) -> np.ndarray:
    return np.stack([(x >> np.uint32(s)) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def _joined(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def _predict(mode: int, left, top, lead, right):
    """Prediction from the neighbours left, above, above left and above right (channels last)."""
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return lead
    if mode == 5:
        return ((left + right) // 2 + top) // 2
    if mode == 6:
        return (left + lead) // 2
    if mode == 7:
        return (left + top) // 2
    if mode == 8:
        return (lead + top) // 2
    if mode == 9:
        return (top + right) // 2
    if mode == 10:
        return ((left + lead) // 2 + (top + right) // 2) // 2
    if mode == 11:
        to_left = np.abs(top - lead).sum(axis=-1, keepdims=True)
        to_top = np.abs(left - lead).sum(axis=-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - lead, 0, 255)
    if mode == 13:
        mean = (left + top) // 2
        half = mean - lead
        return np.clip(mean + (half + (half < 0)) // 2 + ((half < 0) & (half % 2 == 0)) * 0, 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0]), np.shape(top))


_WITHOUT_LEFT = {0, 2, 3, 4, 8, 9, 14, 15}


def invert_predictor(rest: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Pixels (height, width) from what prediction left over."""
    height, width = rest.shape
    r, out = _channels(rest), np.zeros((height, width, 4), np.int64)
    out[0, 0] = (r[0, 0] + [255, 0, 0, 0]) & 255
    out[0] = (np.cumsum(np.concatenate((out[:1, 0], r[0, 1:])), axis=0)) & 255
    mode = (modes >> np.uint32(8)) & np.uint32(15)
    for y in range(1, height):
        above = out[y - 1]
        out[y, 0] = (above[0] + r[y, 0]) & 255
        kinds = np.repeat(mode[y >> bits], 1 << bits)[:width]
        seen = set(kinds[1:].tolist())
        if seen == {1}:
            out[y] = np.cumsum(np.concatenate((out[y, :1], r[y, 1:])), axis=0) & 255
        elif seen <= _WITHOUT_LEFT:
            # The pixel above right of the last column is the first of this row.
            right = np.concatenate((above[1:], out[y, :1]))
            for k in seen:
                at = np.flatnonzero(kinds == k)
                at = at[at > 0]
                out[y, at] = (r[y, at] + _predict(k, None, above[at], above[at - 1], right[at])) & 255
        else:
            for x in range(1, width):
                right = above[x + 1] if x + 1 < width else out[y, 0]
                out[y, x] = (r[y, x] + _predict(int(kinds[x]), out[y, x - 1], above[x], above[x - 1], right)) & 255
    return _joined(out)


def apply_predictor(image: np.ndarray, mode: int) -> np.ndarray:
    """What one mode over the whole image leaves over."""
    c = _channels(image)
    height, width = image.shape
    left = np.concatenate((np.zeros((height, 1, 4), np.int64), c[:, :-1]), axis=1)
    guess = left.copy()
    guess[0, 0] = [255, 0, 0, 0]
    if height > 1:
        top, lead = c[:-1], np.concatenate((np.zeros((height - 1, 1, 4), np.int64), c[:-1, :-1]), axis=1)
        right = np.concatenate((c[:-1, 1:], c[1:, :1]), axis=1)
        guess[1:] = _predict(mode, left[1:], top, lead, right)
        guess[1:, 0] = c[:-1, 0]
    return _joined(c - guess)


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x & 255) ^ 128) - 128


def cross_colour(image: np.ndarray, factors: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Take out (sign -1) or put back (sign 1) what green and red foretell of red and blue."""
    height, width = image.shape
    c = _channels(image)
    f = _channels(np.repeat(np.repeat(factors, 1 << bits, axis=0)[:height], 1 << bits, axis=1)[:, :width])
    r2b, g2b, g2r = (_signed(f[..., k]) for k in (1, 2, 3))
    green = _signed(c[..., 2])
    red = c[..., 1] + sign * ((g2r * green) >> 5)
    base = _signed(red if sign > 0 else c[..., 1])
    blue = c[..., 3] + sign * ((g2b * green) >> 5) + sign * ((r2b * base) >> 5)
    return _joined(np.stack([c[..., 0], red, c[..., 2], blue], axis=-1))


def _packing(colours: int) -> int:
    """How many bits of the column number one palette pixel covers."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def invert_palette(image: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    pack = _packing(len(palette))
    index = ((image >> np.uint32(8)) & np.uint32(255)).astype(np.int64)
    if pack:
        depth = 8 >> pack
        shifts = np.arange(1 << pack) * depth
        index = ((index[:, :, None] >> shifts) & ((1 << depth) - 1)).reshape(len(index), -1)[:, :width]
    return np.where(index < len(palette), palette[np.minimum(index, len(palette) - 1)], np.uint32(0))


def chunk_of(file: bytes) -> bytes:
    """The lossless chunk of one file."""
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L":
        raise ValueError("not a simple lossless WebP file")
    return file[20 : 20 + int.from_bytes(file[16:20], "little")]


def _head(data: bytes):
    """What stands before an image's pixels: its plan and transforms. Yields a plan where it needs a sub-image."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(4)
    transforms, wide = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS):
            size = bits.read(3) + 2
            part = yield from _small(bits, (wide + (1 << size) - 1) >> size, (height + (1 << size) - 1) >> size)
            transforms.append((kind, size, part, wide))
        elif kind == SUBTRACT:
            transforms.append((kind, 0, None, wide))
        else:
            colours = bits.read(8) + 1
            steps = _channels((yield from _small(bits, colours, 1))[0])
            transforms.append((kind, 0, _joined(np.cumsum(steps, axis=0)), wide))
            pack = _packing(colours)
            wide = (wide + (1 << pack) - 1) >> pack
    plan = Plan(wide, height)
    if bits.read(1):
        plan.cache_bits = bits.read(4)
    if bits.read(1):
        plan.group_bits = bits.read(3) + 2
        side = 1 << plan.group_bits
        groups = yield from _small(bits, (wide + side - 1) // side, (height + side - 1) // side)
        plan.group_of = (groups >> np.uint32(8)) & np.uint32(0xFFFF)
        plan.groups = int(plan.group_of.max()) + 1
    return _read_codes(bits, plan), transforms


def _heads(streams: list[bytes]) -> list[tuple[Plan, list]]:
    """Every image's head; the sub-images that the heads wait for are read together, round by round."""
    done: list = [None] * len(streams)
    heads = [_head(data) for data in streams]
    answers: list[tuple[int, tuple | None]] = [(k, None) for k in range(len(streams))]
    while answers:
        waiting, plans = [], []
        for k, answer in answers:
            try:
                plans.append(heads[k].send(answer))
                waiting.append(k)
            except StopIteration as end:
                done[k] = end.value
        pixels, ends = read_pixels([streams[k] for k in waiting], plans) if waiting else ([], np.zeros(0, np.int64))
        answers = list(zip(waiting, zip(pixels, ends.tolist())))
    return done


def decode(files: list[bytes]) -> list[np.ndarray]:
    """Pixels (height, width) of every file."""
    streams = [chunk_of(f) for f in files]
    heads = _heads(streams)
    out = []
    for (plan, transforms), pixels in zip(heads, read_pixels(streams, [p for p, _ in heads])[0] if files else []):
        image = pixels.reshape(plan.height, plan.width)
        for kind, size, data, wide in reversed(transforms):
            if kind == PREDICTOR:
                image = invert_predictor(image, data, size)
            elif kind == CROSS:
                image = cross_colour(image, data, size, 1)
            elif kind == SUBTRACT:
                c = _channels(image)
                c[..., 1] += c[..., 2]
                c[..., 3] += c[..., 2]
                image = _joined(c)
            else:
                image = invert_palette(image, data, wide)
        out.append(image)
    return out


# Writing.


class Writer:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths (up to 14) of complete prefix codes, one code a row; rows of one symbol get length 0 there.

    Each symbol starts with the length its share asks for, rounded up; what room
    is left goes to the commonest symbols that can be shortened by a bit.
    """
    counts = counts.astype(float)
    used = counts > 0
    several = used.sum(axis=1) > 1
    total = counts.sum(axis=1, keepdims=True)
    share = np.where(used, counts + total / 8192, 0)
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
    length = np.where(used, np.ceil(-np.log2(np.maximum(share, 1e-9)) - 1e-9), 0).astype(np.int64)
    length = np.where(used, np.clip(length, 1, 14), 0)
    room = (1 << 15) - np.where(used, np.left_shift(1, 15 - length), 0).sum(axis=1)
    room[~several] = 0
    order = np.argsort(-counts, axis=1, kind="stable")
    rows = np.arange(len(counts))
    while (room > 0).any():
        act = rows[room > 0]
        for k in range(int(used[act].sum(axis=1).max())):
            col = order[act, k]
            now = length[act, col]
            gain = np.left_shift(1, 15 - now)
            ok = (now > 1) & (gain <= room[act])
            length[act[ok], col[ok]] -= 1
            room[act[ok]] -= gain[ok]
    length[~several] = 0
    return length


def canonical(length: np.ndarray) -> np.ndarray:
    """Codes of rows of lengths, first bit lowest, as the format stores them."""
    out = np.zeros_like(length)
    rows, symbols = np.nonzero(length)
    n = length[rows, symbols]
    order = np.lexsort((symbols, n, rows))
    rows, symbols, n = rows[order], symbols[order], n[order]
    room = np.left_shift(1, 15 - n)
    # Complete codes fill their row's 2^15 exactly, so row r begins where the rows before it end.
    first = (np.cumsum(room) - room) & 0x7FFF
    out[rows, symbols] = _REVERSED[first]
    return out


_STATIC_CODE = canonical(_STATIC[None, :])[0].tolist()
_STATIC_LENGTH = _STATIC.tolist()
#: What a code begins with: no short form, all 19 lengths of lengths, three bits each, no limit.
_STATIC_HEAD = (15 << 1 | sum(_STATIC_LENGTH[s] << 5 + 3 * i for i, s in enumerate(LENGTH_ORDER)), 1 + 4 + 3 * 19 + 1)


def _put_code(w: Writer, counts: np.ndarray, length: np.ndarray) -> None:
    symbols = np.flatnonzero(counts).tolist()
    if len(symbols) <= 1:
        s = symbols[0] if symbols else 0
        w.put(1 | (s > 1) << 2, 3)
        w.put(s, 8 if s > 1 else 1)
        return
    value, size, last = *_STATIC_HEAD, -1
    full = symbols + [len(length)]
    lengths = length.tolist()
    for s in full:
        gap = s - last - 1
        while gap:
            if gap < 3:
                k, sym, extra, n = 1, 0, 0, 0
            elif gap < 11:
                k, sym, n = gap, 17, 3
                extra = k - 3
            else:
                k, sym, n = min(gap, 138), 18, 7
                extra = k - 11
            value |= (_STATIC_CODE[sym] | extra << _STATIC_LENGTH[sym]) << size
            size += _STATIC_LENGTH[sym] + n
            gap -= k
        if s < len(length):
            value |= _STATIC_CODE[lengths[s]] << size
            size += _STATIC_LENGTH[lengths[s]]
        last = s
    w.put(value, size)


def _put_flat(w: Writer, pixels: np.ndarray) -> None:
    """A sub-image of literals only."""
    if pixels.size == 1:
        w.put(*_one_pixel(int(pixels.ravel()[0])))
    else:
        _put_pixels(w, pixels)


@lru_cache(maxsize=256)
def _one_pixel(pixel: int) -> tuple[int, int]:
    """The bits of a sub-image of one pixel."""
    w = Writer()
    _put_pixels(w, np.array([pixel], np.uint32))
    return w.value, w.size


def _put_pixels(w: Writer, pixels: np.ndarray) -> None:
    w.put(0, 1)
    c = _channels(pixels.ravel())[:, [2, 1, 3, 0]]
    sizes = (GREEN + LENGTHS, 256, 256, 256, DISTANCES)
    counts = np.array([np.bincount(c[:, k], minlength=sizes[0]) for k in range(4)] + [np.zeros(sizes[0], np.int64)])
    lengths = code_lengths(counts)
    for n, length, size in zip(counts, lengths, sizes):
        _put_code(w, n[:size], length[:size])
    codes = list(zip(canonical(lengths).tolist(), lengths.tolist()))
    for px in c.tolist():
        for s, (code, length) in zip(px, codes):
            w.put(code[s], length[s])


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra bits and their number, of numbers from 1."""
    v = v - 1
    high = np.floor(np.log2(np.maximum(v, 1))).astype(np.int64)
    small = v < 4
    n = np.where(small, 0, high - 1)
    return np.where(small, v, 2 * high + ((v >> np.maximum(high - 1, 0)) & 1)), np.where(small, 0, v & ((1 << n) - 1)), n


MATCH = 6  # pixels that must agree before a back-reference is tried


def _matches(pixels: np.ndarray, image: np.ndarray) -> dict[int, tuple[int, int]]:
    """Back-references (length, distance) by the position they begin at; greedy, within an image."""
    n = len(pixels) - MATCH + 1
    if n <= 0:
        return {}
    key = np.zeros(n, np.uint64)
    for k in range(MATCH):
        key = key * np.uint64(0x9E3779B97F4A7C15) + pixels[k : k + n].astype(np.uint64)
        key ^= key >> np.uint64(29)
    key ^= image[:n].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    key[image[:n] != image[MATCH - 1 :]] = np.arange(int((image[:n] != image[MATCH - 1 :]).sum()), dtype=np.uint64)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    later, earlier = order[1:][same], order[:-1][same]
    place = np.argsort(later)
    out: dict[int, tuple[int, int]] = {}
    free = 0
    bounds = np.flatnonzero(np.concatenate((image[1:] != image[:-1], [True]))) + 1
    for p, q in zip(later[place].tolist(), earlier[place].tolist()):
        if p < free or image[q] != image[p]:
            continue
        most = min(4096, int(bounds[np.searchsorted(bounds, p, "right")]) - p)
        differ = np.flatnonzero(pixels[p : p + most] != pixels[q : q + most])
        run = int(differ[0]) if len(differ) else most
        if run >= MATCH:
            out[p] = (run, p - q)
            free = p + run
    return out


def _entropy(counts: np.ndarray) -> np.ndarray:
    """Bits that rows of counts need, by shares alone."""
    total = counts.sum(axis=-1, keepdims=True)
    return -(counts * np.log2(np.where(counts > 0, counts, 1) / np.maximum(total, 1))).sum(axis=-1)


def _cost(image: np.ndarray, images: int, *channels: np.ndarray) -> np.ndarray:
    """Bits of every image's channels by the shares of their values."""
    return sum(_entropy(np.bincount(image * 256 + (c & 255), minlength=images * 256).reshape(images, 256)) for c in channels)


_FACTORS = np.uint32(0xFF002020)  # red and blue each less one green
BLOCK_BITS = 9


def encode(images: list[np.ndarray], force: tuple[int, ...] | None = None, mode: int = 2, cache_bits: int | None = None) -> list[bytes]:
    """A file for every image (height, width) of opaque pixels.

    force, for tests, names the transforms to apply in place of the cheapest.
    """
    if not images:
        return []
    heads, bodies, widths, caches = [], [], [], []
    ids = np.repeat(np.arange(len(images)), [im.size for im in images])
    flat = np.concatenate([im.ravel() for im in images])
    if force is None:
        n = len(images)
        red, green, blue = ((flat >> np.uint32(b)).astype(np.int64) & 255 for b in (16, 8, 0))
        base = _cost(ids, n, green)
        plain = base + _cost(ids, n, red, blue)
        with_green = base + _cost(ids, n, red - green, blue - green)
        sizes = [im.size for im in images]
        at = np.arange(len(flat)) - np.repeat(np.cumsum([0, *sizes[:-1]]), sizes)
        wide = np.repeat([im.shape[1] for im in images], sizes)
        up = np.arange(len(flat)) - np.where(at < wide, 1, wide)
        with_top = _cost(ids, n, *[c - np.where(at > 0, c[up], 0) for c in (red, green, blue)])
    for k, im in enumerate(images):
        height, width = im.shape
        w = Writer()
        w.put(0x2F, 8)
        w.put(width - 1, 14)
        w.put(height - 1, 14)
        w.put(0, 4)
        chosen: tuple[int, ...] = force if force is not None else ()
        palette = None
        if force is None or PALETTE in force:
            palette = np.unique(im)
            if len(palette) > 256 or (force is None and len(palette) > 16 and len(palette) * 24 > 0.4 * plain[k]):
                palette = None
        if force is None:
            if palette is not None:
                chosen = (PALETTE,)
            elif with_top[k] + 64 < min(plain[k], with_green[k]):
                chosen = (PREDICTOR,)
            elif with_green[k] + 64 < plain[k]:
                chosen = (CROSS,)
        for kind in chosen:
            if kind == PALETTE and palette is None:
                continue
            w.put(1 | kind << 1, 3)
            side = 1 << BLOCK_BITS
            blocks = ((im.shape[0] + side - 1) // side, (im.shape[1] + side - 1) // side)
            if kind == PREDICTOR:
                w.put(BLOCK_BITS - 2, 3)
                _put_flat(w, np.full(blocks, OPAQUE | np.uint32(mode << 8)))
                im = apply_predictor(im, mode)
            elif kind == CROSS:
                w.put(BLOCK_BITS - 2, 3)
                _put_flat(w, np.full(blocks, _FACTORS))
                im = cross_colour(im, np.full(blocks, _FACTORS), BLOCK_BITS, -1)
            elif kind == SUBTRACT:
                c = _channels(im)
                c[..., 1] -= c[..., 2]
                c[..., 3] -= c[..., 2]
                im = _joined(c)
            else:
                w.put(len(palette) - 1, 8)
                c = _channels(palette)
                _put_flat(w, _joined(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int64))))
                index = np.searchsorted(palette, im)
                pack = _packing(len(palette))
                if pack:
                    many = -(-im.shape[1] // (1 << pack))
                    index = np.pad(index, ((0, 0), (0, many * (1 << pack) - im.shape[1]))).reshape(im.shape[0], many, 1 << pack)
                    index = (index << (np.arange(1 << pack) * (8 >> pack))).sum(axis=2)
                im = OPAQUE | (index.astype(np.uint32) << np.uint32(8))
        w.put(0, 1)
        bits = cache_bits if cache_bits is not None else 7 if im.size >= 512 and palette is None else 0
        w.put(1 | bits << 1, 5) if bits else w.put(0, 1)
        w.put(0, 1)  # one group of codes
        heads.append(w)
        bodies.append(im.ravel())
        widths.append(im.shape[1])
        caches.append(bits)
    return _write(heads, bodies, np.array(widths), np.array(caches))


def _write(heads: list[Writer], bodies: list[np.ndarray], widths: np.ndarray, caches: np.ndarray) -> list[bytes]:
    n = len(bodies)
    pixels = np.concatenate(bodies)
    image = np.repeat(np.arange(n), [len(b) for b in bodies])
    first = np.cumsum([0] + [len(b) for b in bodies])
    most = int(caches.max())
    # The colour cache holds for every slot the last pixel that fell there.
    slot = (CACHE_MUL * pixels) >> (32 - np.maximum(caches, 1))[image].astype(np.uint32)
    place = len(pixels).bit_length()
    order = np.sort((image << most | slot.astype(np.int64)) << place | np.arange(len(pixels))) & ((1 << place) - 1)
    same = np.concatenate(([False], (image[order][1:] == image[order][:-1]) & (pixels[order][1:] == pixels[order][:-1]) & (slot[order][1:] == slot[order][:-1])))
    hit = np.zeros(len(pixels), bool)
    hit[order] = same
    hit &= caches[image] > 0
    kind = hit.astype(np.int8)  # 0 literal, 1 cache, 2 back-reference, 3 covered by one
    runs = _matches(pixels, image)
    starts = np.array(list(runs), np.int64)
    length = np.array([r for r, _ in runs.values()], np.int64)
    dist = np.array([d for _, d in runs.values()], np.int64)
    if len(starts):
        kind[np.repeat(starts - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))] = 3
        kind[starts] = 2
    c = _channels(pixels)
    size = GREEN + LENGTHS + ((1 << most) if most else 0)
    green = c[:, 2].copy()
    green[kind == 1] = GREEN + LENGTHS + slot[kind == 1]
    if len(starts):
        lp, lx, ln = _prefix(length)
        wide = widths[image[starts]]
        # The pixel right above and the one before have the first two short codes.
        code = np.where(dist == wide, 1, np.where(dist == 1, 2, dist + 120))
        dp, dx, dn = _prefix(code)
        green[starts] = GREEN + lp
    live = kind < 3
    count = [np.bincount(image[live] * size + green[live], minlength=n * size).reshape(n, size)]
    lit = kind == 0
    for k in (1, 3, 0):
        count.append(np.bincount(image[lit] * 256 + c[lit, k], minlength=n * 256).reshape(n, 256))
    count.append(np.bincount(image[starts] * DISTANCES + dp, minlength=n * DISTANCES).reshape(n, DISTANCES) if len(starts) else np.zeros((n, DISTANCES), np.int64))
    # A lone symbol beyond a byte has no short form; a second one is put beside it.
    lone = (count[0] > 0).sum(axis=1) == 1
    count[0][lone & (count[0].argmax(axis=1) > 255), 0] += 1
    length_of = [code_lengths(x) for x in count]
    code_of = [canonical(x) for x in length_of]
    value = code_of[0][image, green].astype(np.uint64)
    bits = length_of[0][image, green]
    for k, ch in ((1, 1), (2, 3), (3, 0)):
        v, m = code_of[k][image, c[:, ch]], length_of[k][image, c[:, ch]]
        value = np.where(lit, value | (v.astype(np.uint64) << bits.astype(np.uint64)), value)
        bits = np.where(lit, bits + m, bits)
    if len(starts):
        v, m = value[starts], bits[starts]
        for part, width in ((lx, ln), (code_of[4][image[starts], dp], length_of[4][image[starts], dp]), (dx, dn)):
            v = v | (part.astype(np.uint64) << m.astype(np.uint64))
            m = m + width
        value[starts], bits[starts] = v, m
    bits = np.where(live, bits, 0)
    value = np.where(live, value, np.uint64(0))
    out = []
    alphabets = [GREEN + LENGTHS, 256, 256, 256, DISTANCES]
    tails = _packed(value, bits, first)
    for k, w in enumerate(heads):
        for a in range(5):
            size = alphabets[a] + ((1 << int(caches[k])) if a == 0 and caches[k] else 0)
            _put_code(w, count[a][k, :size], length_of[a][k, :size])
        tail, n_bits = tails[k]
        w.put(tail, n_bits)
        data = w.value.to_bytes((w.size + 7) // 8, "little")
        body = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
        out.append(b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WEBP" + body)
    return out


def _packed(value: np.ndarray, bits: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """The bits of each image's pixels as one number, and how many there are."""
    ends = np.cumsum(bits)
    starts = ends - bits
    total = np.concatenate(([0], ends))[first]
    size = np.diff(total)
    words = (size + 63) // 64 + 2
    base = np.cumsum(words) - words
    image = np.repeat(np.arange(len(size)), np.diff(first))
    at = starts - total[:-1][image] + base[image] * 64
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    flat = np.zeros(int(words.sum()) + 1, np.uint64)
    low = value << shift
    high = np.where(shift > 0, value >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
    edge = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    flat[word[edge]] |= np.bitwise_or.reduceat(low, edge)
    flat[word[edge] + 1] |= np.bitwise_or.reduceat(high, edge)
    raw = flat.astype("<u8").tobytes()
    return [(int.from_bytes(raw[8 * b : 8 * (b + m)], "little"), int(s)) for b, m, s in zip(base.tolist(), words.tolist(), size.tolist())]
