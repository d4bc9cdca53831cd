"""Lossless WebP (VP8L) encoder on numpy arrays.

Transforms (a predictor, cross-colour elements, the subtraction of green; or a palette for few colours) are taken
where the entropies of the channels ask for fewer bits after them.  Stretches that repeat become back-references, other pixels literals or, if
that is estimated to be shorter, references to a colour cache; all go through prefix codes made for the image.
"""

from __future__ import annotations

import functools
import math
import struct

import numpy as np

from loamwork.llm.webp import ALPHABETS, CACHE_MULTIPLIER, CODE_LENGTH_ORDER, CROSS_COLOUR, EXTRA, LEAST, MAX_SIDE, PALETTE, PREDICTOR, SHORT_DISTANCES, SUBTRACT_GREEN, TURNED, WebpError

#: Pixels of the shortest back-reference, and how far and long one may reach.
LEAST_COPY = {False: 3, True: 7}  # by whether a literal has one sample that is not constant
FARTHEST, LONGEST = (1 << 20) - 120, 4096
CACHE_BITS = 8
#: log2 of the side of a tile that has one predictor, or one set of cross-colour elements.
TILE_BITS = 5
#: Predictors tried: those that are undone a row at a time (left, top, top-left, averages of top ones).
PREDICTORS = [1, 2, 4, 8, 9]


class BitWriter:
    """A number of few bits that grows at its upper end: headers."""

    def __init__(self):
        self.word, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.word |= value << self.n
        self.n += n

    def array(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.word.to_bytes(-(-self.n // 8) or 1, "little"), np.uint8), bitorder="little")[: self.n]


def packed(values: np.ndarray, widths: np.ndarray) -> tuple[int, int]:
    """The fields, of up to 64 bits, one after the other as one number, and its bits."""
    ends = np.cumsum(widths)
    n = int(ends[-1]) if len(ends) else 0
    if not n:
        return 0, 0
    starts = ends - widths
    shift = (starts & 63).astype(np.uint64)
    place = starts >> 6
    last = np.append(np.flatnonzero(place[1:] != place[:-1]), len(place) - 1)  # as no field is longer than a word, one starts in each
    words = np.zeros(len(last) + 1, dtype=np.uint64)
    words[:-1] = np.bitwise_or.reduceat(values << shift, np.concatenate(([0], last[:-1] + 1)))
    words[1:] |= values[last] >> np.uint64(1) >> (np.uint64(63) - shift[last])
    return int.from_bytes(words.tobytes(), "little"), n


def _lengths(own: list[int], limit: int) -> list[int]:
    """code_lengths() of symbols that all occur."""
    total = sum(own)
    share = [math.log2(total / c) for c in own]
    length = [min(max(math.ceil(s), 1), limit) for s in share]
    order = sorted(range(len(own)), key=[s - n for s, n in zip(share, length)].__getitem__)
    room = (1 << limit) - sum([1 << limit - n for n in length])
    if room < 0:  # symbols at the limit take more than their share: lengthen the rarest of the others
        for k in sorted(range(len(own)), key=own.__getitem__):
            while length[k] < limit and room < 0:
                length[k] += 1
                room += 1 << limit - length[k]
    while room:
        for k in order:
            if length[k] > 1 and (more := 1 << limit - length[k]) <= room:
                length[k] -= 1
                room -= more
    return length


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of a complete prefix code of two used symbols or more: the bits each is worth, rounded up, and what that leaves
    unused given to the symbols that gain the most."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.int64)
    out[used] = _lengths(counts[used].tolist(), limit)
    return out


def _codewords(lengths: list[int]) -> list[int]:
    """The codewords, first bit lowest, of a code's symbols in their order."""
    out, place = [0] * len(lengths), 0
    if len(lengths) > 1:
        for k in sorted(range(len(lengths)), key=lengths.__getitem__):
            out[k] = TURNED[place]
            place += 1 << 15 - lengths[k]
    return out


def write_single(out: BitWriter, symbol: int) -> None:
    """A code of one symbol under 256."""
    out.put(0b1 | 0b0 << 1 | 1 << 2, 3)
    out.put(symbol, 8)


def write_code(out: BitWriter, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Write a prefix code for symbols that occur so often; give their codewords and lengths (none for a single symbol)."""
    at = np.flatnonzero(counts)
    used = at.tolist()
    words, widths = np.zeros(len(counts), dtype=np.uint64), np.zeros(len(counts), dtype=np.int64)
    if len(used) < 2 and (not used or used[0] < 256):
        write_single(out, used[0] if used else 0)
        return words, widths
    lengths = [1]
    if len(used) > 1:
        lengths = _lengths(counts[at].tolist(), 15)
        words[at], widths[at] = _codewords(lengths), lengths
    tokens: list[tuple[int, int, int]] = []  # symbol, extra bits, their number
    last = -1
    for s, n in zip([*used, len(counts)], [*lengths, 0]):
        if gap := s - last - 1:
            while gap >= 11:
                tokens.append((18, min(gap, 138) - 11, 7))
                gap -= min(gap, 138)
            if gap >= 3:
                tokens.append((17, gap - 3, 3))
                gap = 0
            tokens += [(0, 0, 0)] * gap
        if n:
            tokens.append((n, 0, 0))
        last = s
    kinds = [0] * 19
    for symbol, _, _ in tokens:
        kinds[symbol] += 1
    known = [s for s in range(19) if kinds[s]]
    three = [0] * 19
    inner = _lengths([kinds[s] for s in known], 7) if len(known) > 1 else [1]
    for s, n in zip(known, inner):
        three[s] = n
    field = {s: (w, n if len(known) > 1 else 0) for s, w, n in zip(known, _codewords(inner), inner)}
    places = max(4, max(k for k, s in enumerate(CODE_LENGTH_ORDER) if three[s]) + 1)
    word, length = places - 4 << 1, 5  # lengths that are not simple, and how many places of them
    for s in CODE_LENGTH_ORDER[:places]:
        word |= three[s] << length
        length += 3
    length += 1  # all symbols' lengths follow
    for symbol, extra, n in tokens:
        turned, width = field[symbol]
        word |= (turned | extra << width) << length
        length += width + n
    out.put(word, length)
    return words, widths


def _prefix(values: np.ndarray):
    """(symbol, extra bits, their number) of lengths or distances."""
    symbol = LEAST.searchsorted(values, "right") - 1
    return symbol, values - LEAST[symbol], EXTRA[symbol]


@functools.lru_cache(maxsize=64)
def _short(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances that have a short code in an image of this width, sorted, and the least code of each."""
    codes: dict[int, int] = {}
    for code, (dx, dy) in enumerate(SHORT_DISTANCES, 1):
        codes.setdefault(max(1, dx + dy * width), code)
    ordered = sorted(codes.items())
    return np.array([d for d, _ in ordered]), np.array([c for _, c in ordered])


def _before(keys: np.ndarray) -> np.ndarray:
    """For each 32-bit key the place of the last equal one before it, or -1."""
    both = keys.astype(np.uint64) << np.uint64(32) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    key, place = both >> np.uint64(32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    same = key[1:] == key[:-1]
    out = np.full(len(keys), -1, dtype=np.int64)
    out[place[1:][same]] = place[:-1][same]
    return out


def _copies(argb: np.ndarray, lean: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and distances of the back-references: stretches in which equal pairs of pixels (four pixels, where each is
    lean) all last stood equally far before."""
    least = LEAST_COPY[lean]
    if len(argb) <= least:
        return (np.empty(0, dtype=np.int64),) * 3
    if lean:
        g = (argb >> np.uint32(8)).astype(np.uint8).astype(np.uint32)
        pair = g[:-1] | g[1:] << np.uint32(8)
        before, span = _before(pair[:-2] | pair[2:] << np.uint32(16)), 4
    else:
        before, span = _before(argb[:-1] * np.uint32(0x9E3779B1) ^ argb[1:] * np.uint32(0x85EBCA77)), 2
        at = np.maximum(before, 0)
        before = np.where((argb[at] == argb[:-1]) & (argb[at + 1] == argb[1:]), before, -1)
    far = np.where(before >= 0, np.arange(len(before)) - before, 0)
    far[far > FARTHEST] = 0
    first = np.flatnonzero(np.concatenate(([True], far[1:] != far[:-1])))
    last = np.append(first[1:], len(far))
    taken = (far[first] > 0) & (last - first + span - 1 >= least)
    first, end, distance = first[taken], last[taken] + span - 1, far[first[taken]]
    # a stretch runs into the next one by its last pair: what is left of that must be long enough
    start = np.maximum(first, np.concatenate(([0], np.maximum.accumulate(end)[:-1]))) if len(first) else first
    long = end - start >= least
    start, length, distance = start[long], (end - start)[long], distance[long]
    if len(length) and length.max() > LONGEST:
        parts = -(-length // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        left = np.repeat(length, parts) - nth * LONGEST
        start, length, distance = np.repeat(start, parts) + nth * LONGEST, np.minimum(left, LONGEST), np.repeat(distance, parts)
    return start, length, distance


def _worth(counts: np.ndarray) -> float:
    """The bits of symbols that occur so often, with some for each one's code."""
    c = counts[counts > 0].astype(np.float64)
    if len(c) < 2:
        return 11.0
    n = float(c.sum())
    return n * math.log2(n) - float(np.dot(c, np.log2(c))) + 5 * len(c)


def _channel_counts(argb: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(c, minlength=256) for c in argb.view(np.uint8).reshape(-1, 4).T]


def _plain_bits(argb: np.ndarray) -> float:
    return sum(map(_worth, _channel_counts(argb)))


def _write_image(out: BitWriter, argb: np.ndarray, main: bool) -> None:
    """Write an image's entropy-coded pixels."""
    height, width = argb.shape
    flat = np.ascontiguousarray(argb).ravel()
    beside = flat & np.uint32(0xFFFF00FF)
    lean = bool((beside == beside[0]).all())  # green alone varies: a literal is one symbol, and a cache could not be shorter
    starts, lengths, distances = _copies(flat, lean)
    copies = len(starts) > 0
    kind = np.zeros(len(flat) + 1, dtype=np.int8)  # 0 literal, 1 the first pixel of a copy, 2 within a copy, 3 cache
    if copies:
        kind[starts] = 2
        kind[starts + lengths] -= 2
        kind = np.cumsum(kind, dtype=np.int8)
        kind[starts] = 1
    kind = kind[:-1]
    slot, cache_bits = None, 0
    if not lean and len(flat) >= 1 << CACHE_BITS:
        slot = (flat * np.uint32(CACHE_MULTIPLIER) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)
        before = _before(slot)
        hit = (before >= 0) & (flat[before] == flat) & (kind == 0)
        lone = flat[(kind == 0) & ~hit]
        g, *rest = (np.bincount(flat[kind == 0] >> np.uint32(s) & np.uint32(255), minlength=256) for s in (8, 16, 0, 24))
        h, *others = (np.bincount(lone >> np.uint32(s) & np.uint32(255), minlength=256) for s in (8, 16, 0, 24))
        if _worth(np.concatenate([h, np.bincount(slot[hit], minlength=1 << CACHE_BITS)])) + sum(map(_worth, others)) < _worth(g) + sum(map(_worth, rest)):
            kind[hit] = 3
            cache_bits = CACHE_BITS
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)  # one group of codes
    token = np.flatnonzero(kind != 2) if copies else np.arange(len(flat))
    pixel = flat[token].astype(np.int64)
    symbol = pixel >> 8 & 0xFF
    if cache_bits:
        cached = kind[token] == 3
        symbol[cached] = 280 + slot[token[cached]]
    n_alphabet = ALPHABETS[0] + ((1 << cache_bits) if cache_bits else 0)
    far = np.empty(0, dtype=np.int64)
    if copies:
        copied = token.searchsorted(starts)
        size, size_extra, size_bits = _prefix(lengths)
        symbol[copied] = 256 + size
        near, near_code = _short(width)
        at = np.minimum(near.searchsorted(distances), len(near) - 1)
        far, far_extra, far_bits = _prefix(np.where(near[at] == distances, near_code[at], distances + len(SHORT_DISTANCES)))
    word, length = write_code(out, np.bincount(symbol, minlength=n_alphabet))
    value, bits = word[symbol], length[symbol]
    if lean:
        for shift in (16, 0, 24):
            write_single(out, int(flat[0]) >> shift & 0xFF)
    else:
        literal = kind[token] == 0
        for shift in (16, 0, 24):
            own = pixel[literal] >> shift & 0xFF
            word, length = write_code(out, np.bincount(own, minlength=256))
            value[literal] |= word[own] << bits[literal].astype(np.uint64)
            bits[literal] += length[own]
    word, length = write_code(out, np.bincount(far, minlength=ALPHABETS[4]))
    if copies:
        v, b = value[copied], bits[copied]
        for more, n in ((size_extra, size_bits), (word[far], length[far]), (far_extra, far_bits)):
            v |= more.astype(np.uint64) << b.astype(np.uint64)
            b += n
        value[copied], bits[copied] = v, b
    out.put(*packed(value, bits))


def _residual(argb: np.ndarray, mode: int) -> np.ndarray:
    """What a predictor leaves of an image, all tiles alike: H x W x 4 bytes, blue first."""
    p = argb.view(np.uint8).reshape(*argb.shape, 4).astype(np.int16)
    guess = np.empty_like(p)
    guess[0, 0] = (0, 0, 0, 255)
    guess[0, 1:] = p[0, :-1]
    guess[1:, 0] = p[:-1, 0]
    top, corner = p[:-1, 1:], p[:-1, :-1]
    right = np.concatenate([p[:-1, 2:], p[1:, :1]], axis=1)[:, : p.shape[1] - 1]
    guess[1:, 1:] = {1: p[1:, :-1], 2: top, 4: corner, 8: corner + top >> 1, 9: top + right >> 1}[mode]
    return (p - guess).astype(np.uint8)


def _predicted(argb: np.ndarray):
    """(tile image, residual) of the best predictor of each tile, if left or top leaves less of green than green itself."""
    if argb.shape[0] < 2 or argb.shape[1] < 2:
        return None
    green = (argb[:17] >> np.uint32(8)).astype(np.uint8)  # a first look
    own = _worth(np.bincount(green[1:, 1:].ravel(), minlength=256))
    if min(_worth(np.bincount((green[1:, 1:] - other).ravel(), minlength=256)) for other in (green[1:, :-1], green[:-1, 1:])) >= own:
        return None
    left = {mode: _residual(argb, mode) for mode in PREDICTORS}
    height, width = argb.shape
    side = 1 << TILE_BITS
    tiles = np.zeros((-(-height // side), -(-width // side)), dtype=np.uint32)
    out = np.empty((height, width, 4), dtype=np.uint8)
    for y, x in np.ndindex(tiles.shape):
        own = (slice(y * side, (y + 1) * side), slice(x * side, (x + 1) * side))
        cost = {mode: int(np.abs(r[own].view(np.int8).astype(np.int16)).sum()) for mode, r in left.items()}
        mode = min(cost, key=lambda m: (cost[m], m))
        tiles[y, x] = mode << 8 | 0xFF000000
        out[own] = left[mode][own]
    return tiles, out.view(np.uint32)[..., 0]


def _uncoloured(argb: np.ndarray):
    """(tile image, residual) of cross-colour elements by least squares over the image, or None if there is nothing to take off."""
    c = argb.view(np.uint8).reshape(*argb.shape, 4)
    blue, green, red = (c[..., k].view(np.int8).astype(np.int32) for k in range(3))
    spread = lambda a, b: float(((a - a.mean()) * (b - b.mean())).sum())
    if not spread(green, green):
        return None
    element = lambda a, b: int(np.clip(round(32 * spread(a, b) / (spread(a, a) or 1.0)), -127, 127))
    green_red, green_blue, red_blue = element(green, red), element(green, blue), 0
    if abs(green_red) < 4 and abs(green_blue) < 4:
        return None
    new_red = red - (green_red * green >> 5) & 0xFF
    new_blue = blue - (green_blue * green >> 5) - (red_blue * red >> 5) & 0xFF
    size = [-(-n >> TILE_BITS) for n in argb.shape]
    tile = 0xFF000000 | (red_blue & 0xFF) << 16 | (green_blue & 0xFF) << 8 | green_red & 0xFF
    return np.full(size, tile, dtype=np.uint32), argb & np.uint32(0xFF00FF00) | new_red.astype(np.uint32) << np.uint32(16) | new_blue.astype(np.uint32)


def _without_green(argb: np.ndarray) -> np.ndarray:
    green = argb >> np.uint32(8) & np.uint32(255)
    return argb & np.uint32(0xFF00FF00) | ((argb >> np.uint32(16)) - green & np.uint32(255)) << np.uint32(16) | (argb - green & np.uint32(255))


def _indexed(argb: np.ndarray, most: int):
    """(palette, image of packed indices) of an image of few colours, else None.  (Indices that are not packed save a grey image nothing.)"""
    if len(np.unique(argb.ravel()[:1024])) > most:
        return None
    palette, index = np.unique(argb, return_inverse=True)
    if len(palette) > most:
        return None
    n = len(palette)
    packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
    index = index.reshape(argb.shape).astype(np.uint32)
    per = 1 << packed
    wide = np.zeros((len(index), -(-index.shape[1] // per) * per), dtype=np.uint32)
    wide[:, : index.shape[1]] = index
    shifts = np.arange(per, dtype=np.uint32) * np.uint32(8 >> packed)
    return palette.astype(np.uint32), (wide.reshape(len(index), -1, per) << shifts).sum(axis=2, dtype=np.uint32) << np.uint32(8) | np.uint32(0xFF000000)


def encode(pixels: np.ndarray) -> bytes:
    """A height x width array of bytes, of three (red, green, blue) or four samples (alpha last), as a lossless WebP file."""
    height, width, samples = pixels.shape
    if not 0 < width <= MAX_SIDE or not 0 < height <= MAX_SIDE:
        raise WebpError(f"sides must lie between 1 and {MAX_SIDE}")
    argb = np.empty((height, width, 4), dtype=np.uint8)
    for k in range(3):
        argb[..., 2 - k] = pixels[..., k]
    argb[..., 3] = pixels[..., 3] if samples == 4 else 255
    alpha = samples == 4 and bool((pixels[..., 3] != 255).any())
    transforms, argb = _transformed(argb.view("<u4")[..., 0])
    out = BitWriter()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int(alpha), 1)
    out.put(0, 3)
    for kind, side in transforms:
        out.put(1 | kind << 1, 3)
        if kind in (PREDICTOR, CROSS_COLOUR):
            out.put(TILE_BITS - 2, 3)
        elif kind == PALETTE:
            colours = side.view(np.uint8).reshape(-1, 4)
            out.put(len(colours) - 1, 8)
            side = np.diff(colours, axis=0, prepend=np.zeros((1, 4), np.uint8)).view(np.uint32).reshape(1, -1)
        if side is not None:
            _write_image(out, side, False)
    out.put(0, 1)  # no further transform
    _write_image(out, argb, True)
    return container(out.word.to_bytes(-(-out.n // 8), "little"))


def _transformed(argb: np.ndarray) -> tuple[list[tuple[int, np.ndarray | None]], np.ndarray]:
    """The transforms (kind, its side image or palette) in their order, and what they leave.

    A palette stands alone.  Otherwise a predictor, cross-colour elements and the subtraction of green are each taken if
    what is left is worth fewer bits.
    """
    grey = bool(((argb ^ argb >> np.uint32(8)) & np.uint32(0xFFFF) == 0).all())  # so green alone tells the others
    greens = lambda image: np.bincount((image >> np.uint32(8)).astype(np.uint8).ravel(), minlength=256)
    worth = _plain_bits if not grey else lambda image: 3 * _worth(greens(image))
    own = greens(argb) if grey else None
    bits, out, rest = 3 * _worth(own) if grey else worth(argb), [], argb
    if (guessed := _predicted(rest)) is not None and (now := worth(guessed[1]) + 64 + 2 * guessed[0].size) < bits:
        out.append((PREDICTOR, guessed[0]))
        rest, bits = guessed[1], now
    if not grey and (crossed := _uncoloured(rest)) is not None and (now := worth(crossed[1]) + 64) < bits:
        out.append((CROSS_COLOUR, crossed[0]))
        rest, bits = crossed[1], now
    bare = rest & np.uint32(0xFF00FF00) if grey else _without_green(rest)
    if (now := bits / 3 + 22 if grey else worth(bare)) < bits:
        out.append((SUBTRACT_GREEN, None))
        rest, bits = bare, now
    if grey and np.count_nonzero(own) > 16:
        return out, rest
    if (few := _indexed(argb, 16 if grey else 256)) is not None and 40 + 12 * len(few[0]) + _plain_bits(few[1]) < bits:
        return [(PALETTE, few[0])], few[1]
    return out, rest


def container(payload: bytes) -> bytes:
    """The RIFF file of a VP8L payload."""
    chunk = b"VP8L" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
