"""Lossless WebP (VP8L): a decoder of the whole format, on numpy arrays; ``webp_writer`` holds the encoder.

Pixels are height x width x 4 arrays of unsigned bytes in the order red, green, blue, alpha.

``decode`` reads any lossless stream: simple and normal prefix codes, groups of codes chosen by an entropy
image, back-references, the colour cache, and the predictor, cross-colour, subtract-green and palette
transforms.

Where an image has one group of codes, the symbols that would start at every bit of a stretch of the stream are
looked up at once, with the bit at which the next pixel, copy or cache reference would begin; walking from bit to
bit then gives those that do start.  An image of several groups, whose codes depend on the place, is read symbol
by symbol.  Predictors that need no left neighbour are undone a row at a time.
"""

from __future__ import annotations

import functools
import struct
from array import array

import numpy as np

MAX_SIDE = 1 << 14
# Fixed values of the format: the order of code length codes, and the offsets (dx, dy) of short distance codes.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
SHORT_DISTANCES = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
CACHE_MULTIPLIER = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
ALPHABETS = (256 + 24, 256, 256, 256, 40)  # green with lengths, red, blue, alpha, distance


#: The numbers of 15 bits with their bits turned round.
TURNED = [int(t) for t in (np.arange(1 << 15)[:, None] >> np.arange(15) & 1) @ (1 << np.arange(14, -1, -1))]


@functools.cache
def _turned(n: int) -> np.ndarray:
    """The numbers of n bits with their bits turned round."""
    return np.array(TURNED[:: 1 << 15 - n])


class WebpError(ValueError):
    """The bytes are not a lossless WebP stream."""


class _Bits:
    """Bits of a byte string, lowest first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self._word, self._have, self._next = 0, 0, 0

    def peek(self, n: int) -> int:
        while self._have < n:
            chunk = self.data[self._next : self._next + 64]
            self._word |= int.from_bytes(chunk, "little") << self._have
            self._have += 512  # zeros follow the end
            self._next += 64
        return self._word & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.peek(n)
        self._word >>= n
        self._have -= n
        self.at += n
        if self.at > 8 * len(self.data) + 64:
            raise WebpError("the stream ends early")

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.skip(n)
        return value

    def tail(self, n: int) -> int:
        """The next n bits or more, which stay unread."""
        first = self.at // 8
        return int.from_bytes(self.data[first : first + n // 8 + 2], "little") >> self.at % 8

    def seek(self, bit: int) -> None:
        if bit > 8 * len(self.data) + 64:
            raise WebpError("the stream ends early")
        self.at, self._next = bit, bit // 8
        self._word = self._have = 0
        if bit % 8:
            self.peek(bit % 8)
            self._word >>= bit % 8
            self._have -= bit % 8


class _Code:
    """A prefix code: ``table`` has symbol << 4 | length for the next ``longest`` bits of the stream."""

    def __init__(self, lengths: dict[int, int]):
        used = sorted([n << 16 | s for s, n in lengths.items() if n])
        if len(used) < 2:
            self.longest, self.table = 0, np.array([(used[0] & 0xFFFF) << 4 if used else 0], dtype=np.int32)
        else:
            if sum([1 << 15 - (k >> 16) for k in used]) != 1 << 15:
                raise WebpError("a prefix code is not complete")
            self.longest = used[-1] >> 16
            keys = np.array(used, dtype=np.int32)
            lengths = keys >> 16
            self.table = np.repeat((keys & 0xFFFF) << 4 | lengths, 1 << self.longest - lengths)[_turned(self.longest)]
        self.mask = (1 << self.longest) - 1
        self.walk = memoryview(self.table)

    def read(self, bits: _Bits) -> int:
        entry = self.walk[bits.peek(self.longest)] if self.longest else self.walk[0]
        bits.skip(entry & 15)
        return entry >> 4

    def at(self, windows: np.ndarray) -> np.ndarray:
        """The table's entries for windows of the stream's bits."""
        return self.table[windows & self.mask] if self.longest else np.broadcast_to(self.table, windows.shape)


def _read_code(bits: _Bits, alphabet: int) -> _Code:
    head = bits.peek(19)
    if head & 1:
        two, n = head >> 1 & 1, 8 if head & 4 else 1
        symbols = [head >> 3 & (1 << n) - 1, head >> 3 + n & 255][: 1 + two]
        bits.skip(3 + n + 8 * two)
        if max(symbols) >= alphabet:
            raise WebpError("a symbol lies outside its alphabet")
        return _Code(dict.fromkeys(symbols, 1))
    bits.skip(5)
    three = bits.read(3 * (n := 4 + (head >> 1 & 15)))
    reader = _Code({CODE_LENGTH_ORDER[k]: three >> 3 * k & 7 for k in range(n)})
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    out: dict[int, int] = {}
    at, previous = 0, 8
    start, mask, walk = bits.at, reader.mask, reader.walk
    word, taken = bits.tail(alphabet * 14 + 64), 0  # the longest a code's lengths can be
    while at < alphabet and left:
        left -= 1
        entry = walk[word & mask]
        used, n = entry & 15, entry >> 4
        if n < 16:
            word >>= used
            taken += used
            if n:
                out[at] = previous = n
            at += 1
            continue
        word >>= used
        extra, base = ((2, 3), (3, 3), (7, 11))[n - 16]
        times = base + (word & ((1 << extra) - 1))
        word >>= extra
        taken += used + extra
        if at + times > alphabet:
            raise WebpError("code lengths run over the alphabet")
        if n == 16:
            out.update(dict.fromkeys(range(at, at + times), previous))
        at += times
    bits.seek(start + taken)
    return _Code(out)


def _extended(bits: _Bits, prefix: int) -> int:
    """The length or distance that a prefix symbol and its extra bits stand for."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _read_image(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels as ARGB words."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebpError("the colour cache is too large")
    chooser, chooser_bits, groups = None, 0, 1
    if main and bits.read(1):
        chooser_bits = 2 + bits.read(3)
        chooser = _read_image(bits, -(-width >> chooser_bits), -(-height >> chooser_bits), False) >> 8 & 0xFFFF
        groups = int(chooser.max()) + 1
    codes = [[_read_code(bits, n + ((1 << cache_bits) if k == 0 and cache_bits else 0)) for k, n in enumerate(ALPHABETS)] for _ in range(groups)]
    if groups == 1 and width * height > 32:
        return _one_group(bits, codes[0], cache_bits, width, height)
    return _symbol_by_symbol(bits, codes, chooser, chooser_bits, cache_bits, width, height)


#: Bytes of the stream looked up at once.
STRETCH = 1 << 14


#: The least length or distance of each prefix symbol, and the number of its extra bits.
LEAST = np.array([1, 2, 3, 4] + [((2 + (s & 1)) << (s - 2 >> 1)) + 1 for s in range(4, ALPHABETS[4])])
EXTRA = np.array([0, 0, 0, 0] + [s - 2 >> 1 for s in range(4, ALPHABETS[4])])


def _walked(following: np.ndarray, q: int, most: int) -> np.ndarray:
    """The places met from q on, each one's follower the next, until the last place, which follows itself; or most of them, or a few more.

    Steps of eight are walked, and the places between are looked up at once."""
    end = len(following) - 1
    two = following[following]
    four = two[two]
    walk, starts = memoryview(four[four]), [q]
    while q < end and 8 * len(starts) < most:
        starts += [q := walk[q] for _ in range(min(64, most // 8 + 1))]
    out = np.empty((len(starts), 8), dtype=np.int64)
    out[:, 0] = np.fromiter(starts, dtype=np.int64, count=len(starts))
    out[:, 4] = four[out[:, 0]]
    out[:, 2::4] = two[out[:, ::4]]
    out[:, 1::2] = following[out[:, ::2]]
    return out.ravel()


def _one_group(bits: _Bits, codes: list[_Code], cache_bits: int, width: int, height: int) -> np.ndarray:
    """The pixels of an image with one group of codes.  A token is a literal's ARGB, a cache slot or a copy's length and distance."""
    green, red, blue, alpha, distance = codes
    total, at, p = width * height, 0, bits.at
    values, distances = [], []
    has_special = bool((green.table >= 256 << 4).any())
    lean = not (red.longest or blue.longest or alpha.longest)
    none = np.empty(0, dtype=np.int64)
    while at < total:
        if p > 8 * len(bits.data):
            raise WebpError("the stream ends early")
        first = p // 8
        raw = bits.data[first : first + STRETCH + 16].ljust(16, b"\0") + bytes(16)
        words = np.ndarray(len(raw) - 7, "<i8", raw, strides=(1,)).copy()  # from each byte on
        # the bits at which a token may start: what it needs lies within the words
        n = 8 * STRETCH if first + STRETCH + 16 < len(bits.data) else 8 * len(words) - 64

        def windows(q: np.ndarray) -> np.ndarray:
            """The next 57 bits at places of the stretch, below others."""
            return words[q >> 3] >> (q & 7)

        entry = green.at((words[: n // 8, None] >> np.arange(8)).ravel())
        following = np.arange(n + 1)
        following[:n] += entry & 15
        special = np.flatnonzero(entry >= 256 << 4) if has_special else none
        if not lean:
            q = following[:n].copy()
            for code in (red, blue, alpha):
                if code.longest:
                    q += code.at(windows(q)) & 15
            q[special] = following[special]
            following[:n] = q
        if has_special:
            symbol = entry[special] >> 4
            copies = special[symbol < 280]
            symbol = symbol[symbol < 280] - 256
            q = following[copies]
            ahead, extra = windows(q), EXTRA[symbol]  # at most 10 bits, a code of 15 and another 18
            lengths = LEAST[symbol] + (ahead & ((1 << extra) - 1))
            q += extra
            ahead >>= extra
            found = distance.at(ahead)
            q += found & 15
            ahead >>= found & 15
            extra = EXTRA[found >> 4]
            reach = LEAST[found >> 4] + (ahead & ((1 << extra) - 1))
            following[copies] = q + extra
        q = p - 8 * first
        if green.longest or not lean:
            own = _walked(np.minimum(following, n), q, total - at)
        else:  # no token takes a bit
            own = np.full(total - at, q)
        own = own[: min(int(own.searchsorted(n)), total - at)]
        got = entry[own]
        s, ends = (got >> 4).astype(np.int64), own + (got & 15)
        if has_special:
            copied = np.flatnonzero((s >= 256) & (s < 280))
            place = copies.searchsorted(own[copied])
            step = np.ones(len(own), dtype=np.int64)
            step[copied] = lengths[place]
            until = at + np.cumsum(step)
            kept = int(until.searchsorted(total)) + 1  # what the walk met beyond the image's end is no token
            if kept < len(own):
                own, s, ends, step = own[:kept], s[:kept], ends[:kept], step[:kept]
                copied = copied[: int(copied.searchsorted(kept))]
                place = place[: len(copied)]
            at = int(until[len(own) - 1])
        else:
            at += len(own)
        p = 8 * first + int(following[own[-1]])
        value = s << 8
        for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
            if code.longest:
                got = code.at(windows(ends))
                ends += got & 15
                value |= (got >> 4).astype(np.int64) << shift
            else:
                value |= int(code.table[0]) >> 4 << shift
        if has_special:
            if cache_bits:
                value = np.where(s < 256, value, s - 280 | 1 << 32)
            value[copied] = step[copied] | 2 << 32
            distances.append(reach[place])
        values.append(value)
    if p > 8 * len(bits.data) or at > total:
        raise WebpError("the stream ends early" if at <= total else "a back-reference leaves the image")
    bits.seek(p)
    value = np.concatenate(values)
    if not has_special:
        return value.astype(np.uint32).reshape(height, width)
    return _replayed(value, _distances(np.concatenate(distances) if distances else none, width), cache_bits).reshape(height, width)


def _replayed(value: np.ndarray, distances: list[int], cache_bits: int) -> np.ndarray:
    """Pixels of tokens, with copies and cache references resolved in order."""
    out = array("I")

    def copy(length: int, d: int) -> array:
        at = len(out)
        if d > at:
            raise WebpError("a back-reference leaves the image")
        return out[at - d : at - d + length] if d >= length else (out[at - d :] * (length // d + 1))[:length]

    is_copy = value >= 2 << 32
    lengths = (value[is_copy] & 0xFFFFFFFF).tolist()
    if not cache_bits:
        tokens, at = array("I", value.astype(np.uint32).tobytes()), 0
        for k, length, d in zip(np.flatnonzero(is_copy).tolist(), lengths, distances):
            if k > at:
                out += tokens[at:k]
            n = len(out)
            out += out[n - d : n - d + length] if length <= d <= n else copy(length, d)
            at = k + 1
        return np.frombuffer(out + tokens[at:], dtype=np.uint32)
    cache = [0] * (1 << cache_bits)
    shift = 32 - cache_bits
    copies = zip(lengths, distances)
    for v, slot in zip(value.tolist(), ((value.astype(np.uint32) * np.uint32(CACHE_MULTIPLIER)) >> np.uint32(shift)).tolist()):
        if v < 1 << 32:
            out.append(v)
            cache[slot] = v
        elif v < 2 << 32:
            v = cache[v & 0xFFFF]
            out.append(v)
            cache[(CACHE_MULTIPLIER * v & 0xFFFFFFFF) >> shift] = v
        else:
            part = copy(*next(copies))
            out += part
            for v in part:
                cache[(CACHE_MULTIPLIER * v & 0xFFFFFFFF) >> shift] = v
    return np.frombuffer(out, dtype=np.uint32)


@functools.lru_cache(maxsize=64)
def _short(width: int) -> np.ndarray:
    """The distances of the short codes in an image of this width."""
    return np.array([max(1, dx + dy * width) for dx, dy in SHORT_DISTANCES])


def _distances(codes: np.ndarray, width: int) -> list[int]:
    n = len(SHORT_DISTANCES)
    return np.where(codes > n, codes - n, _short(width)[np.minimum(codes, n) - 1]).tolist()


def _distance(code: int, width: int) -> int:
    if code > len(SHORT_DISTANCES):
        return code - len(SHORT_DISTANCES)
    dx, dy = SHORT_DISTANCES[code - 1]
    return max(1, dx + dy * width)


def _symbol_by_symbol(bits: _Bits, codes, chooser, chooser_bits: int, cache_bits: int, width: int, height: int) -> np.ndarray:
    total = width * height
    out = [0] * total
    cache = [0] * (1 << cache_bits) if cache_bits else None
    at = 0

    def put(argb: int) -> None:
        nonlocal at
        out[at] = argb
        at += 1
        if cache is not None:
            cache[(CACHE_MULTIPLIER * argb & 0xFFFFFFFF) >> (32 - cache_bits)] = argb

    while at < total:
        green, red, blue, alpha, distance = codes[0 if chooser is None else int(chooser[at // width >> chooser_bits, at % width >> chooser_bits])]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            put(alpha.read(bits) << 24 | r << 16 | s << 8 | b)
        elif s < 256 + 24:
            length = _extended(bits, s - 256)
            d = _distance(_extended(bits, distance.read(bits)), width)
            if d > at or at + length > total:
                raise WebpError("a back-reference leaves the image")
            for _ in range(length):
                put(out[at - d])
        elif cache is not None and s - 280 < len(cache):
            put(cache[s - 280])
        else:
            raise WebpError("a symbol lies outside its alphabet")
    return np.array(out, dtype=np.uint32).reshape(height, width)


def _channels(argb: np.ndarray) -> np.ndarray:
    """Alpha, red, green and blue as 16-bit integers in a new last axis."""
    return np.stack([argb >> s & 0xFF for s in (24, 16, 8, 0)], axis=-1).astype(np.int16)


def _words(argb: np.ndarray) -> np.ndarray:
    a = (argb & 0xFF).astype(np.uint32)
    return a[..., 0] << 24 | a[..., 1] << 16 | a[..., 2] << 8 | a[..., 3]


def _average(a, b):
    return (a + b) >> 1


def _select(left, top, corner):
    closer = np.abs(top - corner).sum() < np.abs(left - corner).sum()
    return left if closer else top


def _predict(mode: int, left, top, corner, right):
    """The prediction of one pixel from those before it: left, top, top-left and top-right."""
    if mode in (0, 14, 15):
        return np.array([255, 0, 0, 0], dtype=np.int16)
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode <= 10:
        return [_average(left, corner), _average(left, top), _average(corner, top), _average(top, right), _average(_average(left, corner), _average(top, right))][mode - 6]
    if mode == 11:
        return _select(left, top, corner)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    middle = _average(left, top)
    half = middle - corner
    return np.clip(middle + np.where(half < 0, -(-half >> 1), half >> 1), 0, 255)


def _row_prediction(mode: int, above: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray | None:
    """The predictions of a stretch of a row that need no left neighbour, else None."""
    if mode in (0, 14, 15):
        return np.array([255, 0, 0, 0], dtype=np.int16)
    return {2: above, 3: right, 4: corner}.get(mode) if mode < 8 else _average(corner, above) if mode == 8 else _average(above, right) if mode == 9 else None


def _invert_predictor(argb: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    height, width = argb.shape
    p = _channels(argb)
    modes = modes >> 8 & 0xF
    p[0, 0] = p[0, 0] + np.array([255, 0, 0, 0]) & 0xFF
    p[0] = np.cumsum(p[0], axis=0) & 0xFF  # the first row: left
    for y in range(1, height):
        p[y, 0] = p[y, 0] + p[y - 1, 0] & 0xFF
        above = p[y - 1]
        right = np.concatenate([above[1:], p[y, :1]])
        for tile in range(-(-width >> bits)):
            a, b = max(1, tile << bits), min(width, (tile + 1) << bits)
            mode = int(modes[y >> bits, tile])
            if mode == 1:
                p[y, a - 1 : b] = np.cumsum(p[y, a - 1 : b], axis=0) & 0xFF
            elif (guess := _row_prediction(mode, above[a:b], above[a - 1 : b - 1], right[a:b])) is not None:
                p[y, a:b] = p[y, a:b] + guess & 0xFF
            else:
                for x in range(a, b):
                    p[y, x] = p[y, x] + _predict(mode, p[y, x - 1], above[x], above[x - 1], right[x]) & 0xFF
    return _words(p)


def _invert_cross_colour(argb: np.ndarray, elements: np.ndarray, bits: int) -> np.ndarray:
    height, width = argb.shape
    signed = lambda a: (a & 0xFF).astype(np.uint8).view(np.int8).astype(np.int32)
    e = np.repeat(np.repeat(elements, 1 << bits, axis=0), 1 << bits, axis=1)[:height, :width]
    green_red, green_blue, red_blue = signed(e), signed(e >> 8), signed(e >> 16)
    green = signed(argb >> 8)
    red = (argb >> 16 & 0xFF).astype(np.int32) + (green_red * green >> 5) & 0xFF
    blue = (argb & 0xFF).astype(np.int32) + (green_blue * green >> 5) + (red_blue * signed(red) >> 5) & 0xFF
    return argb & 0xFF00FF00 | red.astype(np.uint32) << 16 | blue.astype(np.uint32)


def _invert_subtract_green(argb: np.ndarray) -> np.ndarray:
    c = np.array(argb, dtype="<u4", order="C").view(np.uint8).reshape(*argb.shape, 4)
    c[..., 0] += c[..., 1]
    c[..., 2] += c[..., 1]
    return c.view("<u4")[..., 0]


def _invert_palette(argb: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    n = len(palette)
    packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    index = argb >> 8 & 0xFF
    if packed:
        per = 8 >> packed
        index = (index[:, :, None] >> (np.arange(1 << packed, dtype=np.uint32) * per) & ((1 << per) - 1)).reshape(len(index), -1)[:, :width]
    return np.where(index < n, palette[np.minimum(index, n - 1)], 0).astype(np.uint32)


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file."""
    if len(data) < 21 or data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebpError("no WebP header")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise WebpError("no lossless chunk")
        at += 8 + (n := struct.unpack_from("<I", data, at + 4)[0]) + n % 2
    n = struct.unpack_from("<I", data, at + 4)[0]
    bits = _Bits(data[at + 8 : at + 8 + n])
    if bits.read(8) != 0x2F:
        raise WebpError("no lossless signature")
    width, height, alpha, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise WebpError("unknown version")
    transforms, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in transforms]:
            raise WebpError("a transform is given twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = 2 + bits.read(3)
            transforms.append((kind, _read_image(bits, -(-inner >> size), -(-height >> size), False), size, inner))
        elif kind == SUBTRACT_GREEN:
            transforms.append((kind, None, 0, inner))
        else:
            n = bits.read(8) + 1
            deltas = _read_image(bits, n, 1, False)
            transforms.append((kind, _words(np.cumsum(_channels(deltas), axis=1)[0]), 0, inner))
            inner = -(-inner >> (3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0))
    argb = _read_image(bits, inner, height, True)
    for kind, side, size, outer in reversed(transforms):
        if kind == PREDICTOR:
            argb = _invert_predictor(argb, side, size)
        elif kind == CROSS_COLOUR:
            argb = _invert_cross_colour(argb, side, size)
        elif kind == SUBTRACT_GREEN:
            argb = _invert_subtract_green(argb)
        else:
            argb = _invert_palette(argb, side, outer)
    c = np.ascontiguousarray(argb, dtype="<u4").view(np.uint8).reshape(*argb.shape, 4)
    out = np.empty_like(c)
    for k in range(3):
        out[..., k] = c[..., 2 - k]
    out[..., 3] = c[..., 3] if alpha else 255
    return out
