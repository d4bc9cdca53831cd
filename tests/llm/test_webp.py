"""The decoder against streams written here with every feature of the format, and the encoder's round trip."""

import sys

import numpy as np
import pytest

from loamwork.llm import media, webp, webp_writer

RNG = np.random.default_rng(5)


class Code:
    """A prefix code with unequal lengths over the symbols, most used first."""

    def __init__(self, symbols, alphabet):
        symbols = sorted(set(symbols))
        self.alphabet = alphabet
        if len(symbols) == 1:
            symbols.append((symbols[0] + 1) % alphabet)
        n = len(symbols)
        depth = max(1, (n - 1).bit_length())
        # a complete code: some symbols one bit shorter than the others
        short = (1 << depth) - n
        self.lengths = {s: depth - (k < short) for k, s in enumerate(symbols)}
        code, last, self.words = 0, 0, {}
        for length, s in sorted((v, k) for k, v in self.lengths.items()):
            code <<= length - last
            last = length
            self.words[s] = (int(format(code, f"0{length}b")[::-1], 2), length)
            code += 1

    def header(self, out):
        out.put(0, 1)
        out.put(15, 4)  # all 19 code length codes: 0 to 15 have four bits each
        for s in webp.CODE_LENGTH_ORDER:
            out.put(4 if s < 16 else 0, 3)
        out.put(0, 1)
        for s in range(self.alphabet):
            out.put(int(format(self.lengths.get(s, 0), "04b")[::-1], 2), 4)

    def put(self, out, s):
        out.put(*self.words[s])


def prefix(value):
    """(symbol, extra bits, their number) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    second = v >> (high - 1) & 1
    return 2 * high + second, v - ((2 + second) << (high - 1)), high - 1


def write_image(out, ops, cache_bits=0, main=True, groups=None, chooser=None, chooser_bits=0):
    """ops: ('p', a, r, g, b), ('c', index) or ('r', length, distance code), with a group number each in ``groups``."""
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(int(chooser is not None), 1)
        if chooser is not None:
            out.put(chooser_bits - 2, 3)
            write_image(out, [("p", 255, int(v) >> 8, int(v) & 255, 0) for v in chooser.ravel()], main=False)
    groups = groups or [0] * len(ops)
    codes = []
    for g in range(max(groups) + 1):
        own = [o for o, k in zip(ops, groups) if k == g]
        used = [[0], [0], [0], [0], [0]]
        for o in own:
            if o[0] == "p":
                for k, v in zip((3, 1, 0, 2), o[1:]):
                    used[k].append(v)
            elif o[0] == "c":
                used[0].append(280 + o[1])
            else:
                used[0].append(256 + prefix(o[1])[0])
                used[4].append(prefix(o[2])[0])
        sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
        codes.append([Code(u, n) for u, n in zip(used, sizes)])
        for c in codes[-1]:
            c.header(out)
    for o, g in zip(ops, groups):
        c = codes[g]
        if o[0] == "p":
            a, r, gr, b = o[1:]
            for code, v in ((c[0], gr), (c[1], r), (c[2], b), (c[3], a)):
                code.put(out, v)
        elif o[0] == "c":
            c[0].put(out, 280 + o[1])
        else:
            for code, base, v in ((c[0], 256, o[1]), (c[4], 0, o[2])):
                s, extra, n = prefix(v)
                code.put(out, base + s)
                out.put(extra, n)


def file_of(width, height, body, alpha=1):
    out = webp_writer.BitWriter()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (alpha, 1), (0, 3)):
        out.put(v, n)
    body(out)
    return webp_writer.container(np.packbits(out.array(), bitorder="little").tobytes())


def pixels(height, width):
    return RNG.integers(0, 256, (height, width, 4)).astype(np.int64)


def ops_of(p):
    return [("p", int(a), int(r), int(g), int(b)) for r, g, b, a in p.reshape(-1, 4)]


def plain(out, p, **more):
    out.put(0, 1)
    write_image(out, ops_of(p), **more)


def test_unequal_codes():
    p = pixels(7, 9)
    assert (webp.decode(file_of(9, 7, lambda o: plain(o, p))) == p).all()


def test_back_references_and_cache():
    p = pixels(1, 4)
    argb = [int(a) << 24 | int(r) << 16 | int(g) << 8 | int(b) for r, g, b, a in p[0]]
    slot = webp.CACHE_MULTIPLIER * argb[1] % 2**32 >> 29
    last = {webp.CACHE_MULTIPLIER * v % 2**32 >> 29: k for k, v in enumerate(argb)}[slot]

    def body(out):
        out.put(0, 1)
        # 4 pixels, then 5 by distance 2 (a code over 120 is the distance plus 120), 1 from the cache, then 2 from the row above
        write_image(out, [*ops_of(p), ("r", 5, 122), ("c", slot), ("r", 2, 1)], cache_bits=3)

    got = webp.decode(file_of(4, 3, body)).reshape(-1, 4).tolist()
    want = p[0].tolist()
    for _ in range(5):
        want.append(want[-2])
    # the cache holds the last pixel of its slot
    seen = {}
    for r, g, b, a in want:
        v = a << 24 | r << 16 | g << 8 | b
        seen[webp.CACHE_MULTIPLIER * v % 2**32 >> 29] = [r, g, b, a]
    want.append(seen[slot])
    for _ in range(2):
        want.append(want[-4])
    assert got == want and last is not None


def test_groups_of_codes():
    p = pixels(6, 10)
    chooser = np.array([[0, 1, 0], [1, 1, 0]])
    groups = [int(chooser[y >> 2, x >> 2]) for y in range(6) for x in range(10)]

    def body(out):
        out.put(0, 1)
        write_image(out, ops_of(p), chooser=chooser, chooser_bits=2, groups=groups)

    assert (webp.decode(file_of(10, 6, body)) == p).all()


def test_subtract_green():
    p = pixels(3, 5)
    q = p.copy()
    q[..., 0] = (p[..., 0] - p[..., 1]) % 256
    q[..., 2] = (p[..., 2] - p[..., 1]) % 256

    def body(out):
        out.put(1 | webp.SUBTRACT_GREEN << 1, 3)
        plain(out, q)

    assert (webp.decode(file_of(5, 3, body)) == p).all()


def test_cross_colour():
    p = pixels(5, 6)
    e = RNG.integers(0, 256, (2, 2, 3))  # green to red, green to blue, red to blue
    s8 = lambda v: int(v) - 256 if v > 127 else int(v)
    q = p.copy()
    for y in range(5):
        for x in range(6):
            gr, gb, rb = map(s8, e[y >> 2, x >> 2])
            r, g, b = (int(v) for v in p[y, x, :3])
            q[y, x, 0] = (r - (gr * s8(g) >> 5)) % 256
            q[y, x, 2] = (b - (gb * s8(g) >> 5) - (rb * s8(r) >> 5)) % 256

    def body(out):
        out.put(1 | webp.CROSS_COLOUR << 1, 3)
        out.put(0, 3)
        write_image(out, [("p", 255, int(rb), int(gb), int(gr)) for gr, gb, rb in e.reshape(-1, 3)], main=False)
        plain(out, q)

    assert (webp.decode(file_of(6, 5, body)) == p).all()


def predicted(p, y, x, mode):
    """The format's predictor, channel by channel, written out."""
    black = [0, 0, 0, 255]
    if y == 0 and x == 0:
        return black
    if y == 0:
        return p[y][x - 1]
    if x == 0:
        return p[y - 1][x]
    left, top, corner = p[y][x - 1], p[y - 1][x], p[y - 1][x - 1]
    right = p[y - 1][x + 1] if x + 1 < len(p[0]) else p[y][0]
    avg = lambda a, b: [(i + j) // 2 for i, j in zip(a, b)]
    clamp = lambda v: max(0, min(255, v))
    half = lambda v: int(v / 2)  # noqa: E731  towards zero
    if mode == 11:
        guess = [i + j - k for i, j, k in zip(left, top, corner)]
        by_left, by_top = (sum(abs(g - v) for g, v in zip(guess, side)) for side in (left, top))
        return left if by_left < by_top else top
    return {
        0: black, 1: left, 2: top, 3: right, 4: corner, 5: avg(avg(left, right), top), 6: avg(left, corner), 7: avg(left, top), 8: avg(corner, top), 9: avg(top, right),
        10: avg(avg(left, corner), avg(top, right)), 12: [clamp(i + j - k) for i, j, k in zip(left, top, corner)], 13: [clamp(a + half(a - k)) for a, k in zip(avg(left, top), corner)],
    }[mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    p = pixels(5, 7)
    p[2:4, 2:5] = p[2, 2]  # something flat, too
    rows = p.tolist()
    q = np.array([[[(v - g) % 256 for v, g in zip(rows[y][x], predicted(rows, y, x, mode))] for x in range(7)] for y in range(5)])

    def body(out):
        out.put(1 | webp.PREDICTOR << 1, 3)
        out.put(1, 3)
        write_image(out, [("p", 255, 0, mode, 0)], main=False)
        plain(out, q)

    assert (webp.decode(file_of(7, 5, body)) == p).all()


@pytest.mark.parametrize("colours", [2, 3, 11, 40])
def test_palette(colours):
    palette = pixels(1, colours)[0]
    index = RNG.integers(0, colours, (4, 13))
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    per, packed = 8 >> bits, -(-13 >> bits)
    green = np.zeros((4, packed), dtype=int)
    for x in range(13):
        green[:, x >> bits] |= index[:, x] << (x % (1 << bits)) * per if bits else index[:, x]

    def body(out):
        out.put(1 | webp.PALETTE << 1, 3)
        out.put(colours - 1, 8)
        write_image(out, ops_of(np.diff(palette, axis=0, prepend=0) % 256), main=False)
        out.put(0, 1)
        write_image(out, [("p", 255, 0, int(g), 0) for g in green.ravel()])

    assert (webp.decode(file_of(13, 4, body)) == palette[index]).all()


def test_round_trip_of_payloads():
    for text in ("", "x", "y" * 500, "é漢😀" * 99, "".join(map(chr, range(32, 127))) * 40):
        payload = media.payload_of(text)
        assert len(payload) % 192 == 0 and payload.startswith(text.encode())
        assert media.samples_of(webp.decode(webp_writer.encode(media.image_of(payload)))) == payload
    noise = RNG.integers(0, 256, (11, 64, 3)).astype(np.uint8)
    assert (webp.decode(webp_writer.encode(noise))[:, :, :3] == noise).all()


@pytest.mark.parametrize("n", [192 * 16_384, 192 * 16_411, 192 * 20_011])
def test_texts_of_more_rows_than_an_image_has(n):
    payload = ("some words of a long text, numbered " * (n // 36 + 1)).encode()[: n - 500] + RNG.integers(0, 256, 500).astype(np.uint8).tobytes()
    image = media.image_of(payload)
    assert max(image.shape[:2]) <= webp.MAX_SIDE and media.samples_of(webp.decode(webp_writer.encode(image))) == payload


def first_transforms(file):
    bits = webp._Bits(file[20:])
    bits.read(8 + 14 + 14 + 4)
    return bits.read(3) >> 1 if bits.peek(1) else None


def test_encoder_takes_each_transform():
    """Images that each transform is made for: it is taken, and undone."""
    y, x = np.mgrid[0:64, 0:96]
    noise = RNG.integers(0, 256, (64, 96))
    skewed = np.where(noise < 200, noise % 3, 255 - noise % 40)
    skewed = np.where(noise < 200, noise % 3, 255 - noise % 40)
    smooth = np.stack([x * 2 + y & 255, x + y * 2 & 255, 255 - x - y & 255], axis=-1)
    images = {
        webp.PREDICTOR: smooth, webp.SUBTRACT_GREEN: np.stack([skewed] * 3, axis=-1), webp.PALETTE: np.array([[9, 200, 3], [77, 1, 90], [3, 3, 250]])[noise % 3],
        webp.CROSS_COLOUR: np.stack([(skewed.astype(np.uint8).view(np.int8).astype(int) >> 1), skewed, RNG.integers(0, 256, (64, 96))], axis=-1) & 255,
    }
    for kind, image in images.items():
        file = webp_writer.encode(image.astype(np.uint8))
        assert first_transforms(file) == kind and (webp.decode(file)[..., :3] == image).all()
    many = RNG.integers(0, 256, (300, 3))[RNG.integers(0, 300, (64, 96)) ** 2 // 300].astype(np.uint8)
    assert (webp.decode(webp_writer.encode(many))[..., :3] == many).all() and len(webp_writer.encode(many)) < many.nbytes / 2  # a cache


def test_code_lengths_are_complete():
    for limit, counts in ((15, RNG.integers(0, 2000, 280)), (15, 2 ** np.arange(30)), (7, RNG.integers(0, 2, 19) * 5), (7, 3 ** np.arange(19)), (15, np.array([0, 1, 0, 1]))):
        if (counts > 0).sum() > 1:
            lengths = webp_writer.code_lengths(counts, limit)
            assert lengths.max() <= limit and sum(2.0 ** -n for n in lengths if n) == 1 and ((lengths > 0) == (counts > 0)).all()


def test_broken_streams():
    good = webp_writer.encode(np.zeros((2, 64, 3), np.uint8))
    for bad in (b"", b"RIFF", good[:12] + b"XXXX" + good[16:], good[:20] + b"\x00" + good[21:]):
        with pytest.raises(webp.WebpError):
            webp.decode(bad)
    cut = webp_writer.encode(RNG.integers(0, 256, (40, 64, 3)).astype(np.uint8))
    with pytest.raises(webp.WebpError):
        webp.decode(cut[: len(cut) // 2])


def test_media_columns(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "hello", 9), (2, "hello", 9)], "doc_id long, text string, media int")
    stored = media.store_texts(docs)
    read = {r["doc_id"]: r for r in media.decode_media(stored).collect()}
    assert bytes(read[2]["pixels"])[1:20:4] == b"hello" and read[1]["width"] == 192 and read[1]["error"] is None
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"no"))], "doc_id long, media binary")
    assert [(r["pixels"], r["error"] is None) for r in media.decode_media(odd).orderBy("doc_id").collect()] == [(None, True), (None, False)]
    digests = {(r["doc_id"], r["payload_bytes"], r["n_bytes"]) for r in media.media_digest(docs).collect()}
    assert digests == {(1, 192, 0), (2, 192, 5)} and media.media_digest(docs.limit(0)).count() == 0


def test_walk_by_eights_meets_each_token():
    rng = np.random.default_rng(3)
    following = np.append(np.minimum(np.arange(500) + rng.integers(1, 15, 500), 500), 500)
    at, plain = 7, []
    while at < 500:
        plain.append(at)
        at = int(following[at])
    got = webp._walked(following, 7, 10_000)
    assert got[got < 500].tolist() == plain
    assert webp._walked(following, 7, 5)[:5].tolist() == plain[:5] and webp._walked(following, 500, 3).min() == 500


def test_fields_are_packed_without_gaps():
    rng = np.random.default_rng(11)
    for n, most in ((0, 9), (1, 64), (700, 3), (700, 64), (64, 64)):
        widths = rng.integers(0, most + 1, n)
        values = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        values = np.array([int(v) & (1 << w) - 1 for v, w in zip(values.tolist(), widths.tolist())], dtype=np.uint64)
        plain = webp_writer.BitWriter()
        for v, w in zip(values.tolist(), widths.tolist()):
            plain.put(v, w)
        assert webp_writer.packed(values, widths) == (plain.word, plain.n)
    for widths in ([64] * 5, [0] * 5, [60, 4, 0, 0, 64, 0]):  # fields that end with a word
        values = np.array([(1 << w) - 1 for w in widths], dtype=np.uint64)
        assert webp_writer.packed(values, np.array(widths)) == ((1 << sum(widths)) - 1, sum(widths))


def test_prefix_symbols_of_every_size():
    values = np.array([*range(1, 5000), 2**20 - 120, 2**20])
    assert list(zip(*(x.tolist() for x in webp_writer._prefix(values)))) == [prefix(int(v)) for v in values]


@pytest.mark.parametrize("place", range(30))
def test_tokens_over_the_edge_of_a_stretch(monkeypatch, place):
    """Long streams are looked up a stretch at a time: literals, copies and cache references that begin in one and end in the next."""
    monkeypatch.setattr(webp, "STRETCH", 32)
    rng = np.random.default_rng(place)
    text = " ".join("".join(map(chr, rng.integers(97, 123, rng.integers(1, 9)))) for _ in range(99)) * (1 + place % 3)
    payload = media.payload_of(text)
    assert media.samples_of(webp.decode(webp_writer.encode(media.image_of(payload)))) == payload
    colours = rng.integers(0, 256, (300, 3))[rng.integers(0, 300, (16, 40)) ** 2 // 300].astype(np.uint8)
    assert (webp.decode(webp_writer.encode(colours))[..., :3] == colours).all()


def test_a_text_takes_few_calls():
    """Most texts are short: what their files cost is the number of calls (3,168 here before)."""
    words = [w * n for w in ("lorem", "ipsum", "dolor", "sit", "amet,") for n in (1, 2)]
    image = media.image_of(media.payload_of(" ".join(words[k] for k in np.random.default_rng(5).integers(0, len(words), 300))))
    webp.decode(webp_writer.encode(image))  # tables that are kept
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        webp.decode(webp_writer.encode(image))
    finally:
        sys.setprofile(None)
    assert calls < 2600
