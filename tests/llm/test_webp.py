"""Lossless WebP: round trips, and a reference writer that uses every construct of the format."""

import random

import numpy as np
import pytest

from lodestar.llm import webp
from lodestar.llm.webp import BitWriter, decode, decode_all, decode_many, payload_of, stored, stored_many


def lengths_for(symbols, limit=15):
    """Code lengths of a complete code: a caterpillar tree over the symbols, balanced where it gets too deep."""
    symbols = sorted(symbols)
    out, left, depth = {}, list(symbols), 1
    while len(left) > 1:
        n = len(left)
        if depth > 3 or n & (n - 1) == 0:
            k = (n - 1).bit_length()
            short = (1 << k) - n
            for i, s in enumerate(left):
                out[s] = depth - 1 + k - (i < short)
            return out
        out[left.pop(0)] = depth
        depth += 1
    out[left[0]] = max(1, depth - 1)
    return out


def canonical(lengths):
    codes, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        codes[s], last = (code, n), n
        code += 1
    return codes


class Writer(BitWriter):
    def code(self, value, n):
        self.write(webp.reversed_bits(value, n), n)

    def prefix_code(self, symbols, alphabet):
        """Write a code for the symbols; return the function that writes one of them."""
        symbols = sorted(set(symbols)) or [0]
        if len(symbols) <= 2 and symbols[-1] < 256:
            self.write(1, 1)
            self.write(len(symbols) - 1, 1)
            wide = symbols[0] > 1
            self.write(wide, 1)
            self.write(symbols[0], 8 if wide else 1)
            if len(symbols) == 2:
                self.write(symbols[1], 8)
                return lambda s: self.write(symbols.index(s), 1)
            return lambda s: None
        lengths = lengths_for(symbols)
        every = [lengths.get(s, 0) for s in range(alphabet)]
        runs, i = [], 0
        while i < alphabet:  # runs of zeros and of repeats
            j = i
            while j < alphabet and every[j] == every[i]:
                j += 1
            n = j - i
            if every[i] == 0 and n >= 11:
                n = min(n, 138)
                runs.append((18, 7, n - 11))
            elif every[i] == 0 and n >= 3:
                runs.append((17, 3, n - 3))
            elif every[i] and n >= 4 and i and every[i - 1] == every[i]:
                n = min(n, 6)
                runs.append((16, 2, n - 3))
            else:
                n = 1
                runs.append((every[i], 0, 0))
            i += n
        of = canonical(lengths_for({s for s, _, _ in runs}))
        self.write(0, 1)
        self.write(15, 4)
        for k in webp.CODE_LENGTH_ORDER:
            self.write(of[k][1] if k in of else 0, 3)
        self.write(0, 1)
        for s, bits, extra in runs:
            if len(of) > 1:
                self.code(*of[s])
            self.write(extra, bits)
        codes = canonical(lengths)
        return (lambda s: self.code(*codes[s])) if len(codes) > 1 else (lambda s: None)

    def image(self, pixels, width, top=False, cache_bits=0, groups=None, draw=None):
        """Entropy-coded image with literals, back-references and cache hits."""
        draw = draw or random.Random(0)
        self.write(1 if cache_bits else 0, 1)
        if cache_bits:
            self.write(cache_bits, 4)
        height = len(pixels) // width
        of_pixel = [0] * len(pixels)
        if top:
            self.write(1 if groups else 0, 1)
            if groups:
                block, meta = groups
                self.write(block - 2, 3)
                across = webp.subsampled(width, block)
                self.image([m << 8 | 0xFF000000 for m in meta], across)
                of_pixel = [meta[(i // width >> block) * across + (i % width >> block)] for i in range(len(pixels))]
        steps, i, cache = [], 0, {}
        while i < len(pixels):
            best = (0, 0)
            for d in [1, width, width + 1, width - 1, 2, 7, 130] if i else []:
                if 1 <= d <= i:
                    n = 0
                    while i + n < len(pixels) and n < 4000 and pixels[i + n] == pixels[i + n - d]:
                        n += 1
                    best = max(best, (n, d))
            slot = (webp.CACHE_MULTIPLIER * pixels[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
            if best[0] >= 2 and draw.random() < 0.8:
                steps.append(("copy", i, *best))
                n = best[0]
            elif cache_bits and cache.get(slot) == pixels[i]:
                steps.append(("cache", i, slot, 0))
                n = 1
            else:
                steps.append(("literal", i, pixels[i], 0))
                n = 1
            for k in range(i, i + n):
                if cache_bits:
                    cache[(webp.CACHE_MULTIPLIER * pixels[k] & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]
            i += n

        def prefixed(v):
            v -= 1
            if v < 4:
                return v, 0, 0
            h = v.bit_length() - 1
            second = v >> (h - 1) & 1
            return 2 * h + second, h - 1, v & ((1 << (h - 1)) - 1)

        def distance(d):
            near = {max(1, x + y * width): k for k, (x, y) in reversed(list(enumerate(webp.NEAR, 1)))}
            return near.get(d, d + 120)

        count = max(of_pixel) + 1
        used = [[set() for _ in range(5)] for _ in range(count)]
        for what, at, a, b in steps:
            u = used[of_pixel[at]]
            if what == "literal":
                for k, shift in enumerate((8, 16, 0, 24)):
                    u[k].add(a >> shift & 255)
            elif what == "cache":
                u[0].add(280 + a)
            else:
                u[0].add(256 + prefixed(a)[0])
                u[4].add(prefixed(distance(b))[0])
        sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        put = [[self.prefix_code(s, n) for s, n in zip(u, sizes)] for u in used]
        for what, at, a, b in steps:
            w = put[of_pixel[at]]
            if what == "literal":
                for k, shift in enumerate((8, 16, 0, 24)):
                    w[k](a >> shift & 255)
            elif what == "cache":
                w[0](280 + a)
            else:
                s, n, extra = prefixed(a)
                w[0](256 + s)
                self.write(extra, n)
                s, n, extra = prefixed(distance(b))
                w[4](s)
                self.write(extra, n)

    def file(self):
        body = self.done()
        pad = len(body) & 1
        return b"RIFF" + (12 + len(body) + pad).to_bytes(4, "little") + b"WEBPVP8L" + len(body).to_bytes(4, "little") + body + b"\0" * pad


def start(width, height):
    w = Writer()
    w.write(0x2F, 8)
    w.write(width - 1, 14)
    w.write(height - 1, 14)
    w.write(1, 4)
    return w


def noise(draw, n, colours):
    some = [draw.getrandbits(32) for _ in range(colours)]
    out = []
    while len(out) < n:
        out += [draw.choice(some)] * draw.choice((1, 1, 1, 2, 5, 40))
    return out[:n]


@pytest.mark.parametrize("seed", range(12))
def test_prefix_codes_back_references_cache_and_meta_codes(seed):
    draw = random.Random(seed)
    width, height = draw.randint(1, 40), draw.randint(1, 40)
    pixels = noise(draw, width * height, draw.choice((1, 3, 50, 400)))
    w = start(width, height)
    w.write(0, 1)
    groups = None
    if seed % 2:
        block = 3
        n = webp.subsampled(width, block) * webp.subsampled(height, block)
        meta = [draw.randint(0, 2) for _ in range(n)]
        groups = (block, meta)
    w.image(pixels, width, True, draw.choice((0, 1, 6, 11)), groups, draw)
    assert decode(w.file())[0].ravel().tolist() == pixels


def predict_one(mode, left, top, left_top, right_top):
    """One channel-wise prediction, written apart from the decoder's."""
    a2 = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clip = lambda v: max(0, min(255, v))
    if mode == 11:
        p = [x + y - z for x, y, z in zip(left, top, left_top)]
        return left if sum(abs(q - x) for q, x in zip(p, left)) < sum(abs(q - x) for q, x in zip(p, top)) else top
    if mode == 13:
        return [clip(m + int((m - z) / 2)) for m, z in zip(a2(left, top), left_top)]
    return {
        0: [0, 0, 0, 255], 1: left, 2: top, 3: right_top, 4: left_top, 5: a2(a2(left, right_top), top), 6: a2(left, left_top),
        7: a2(left, top), 8: a2(left_top, top), 9: a2(top, right_top), 10: a2(a2(left, left_top), a2(top, right_top)),
        12: [clip(x + y - z) for x, y, z in zip(left, top, left_top)], 14: [0, 0, 0, 255],
    }[mode]


@pytest.mark.parametrize("mode", range(15))
def test_every_predictor_mode(mode):
    draw = random.Random(mode)
    width, height, block = 11, 9, 2
    pixels = [[draw.randrange(256) for _ in range(4)] for _ in range(width * height)]
    across = webp.subsampled(width, block)
    modes = [draw.choice((mode, mode, mode, 1)) for _ in range(across * webp.subsampled(height, block))]
    left_over = []
    for i, p in enumerate(pixels):
        y, x = divmod(i, width)
        if i == 0:
            guess = [0, 0, 0, 255]
        elif y == 0:
            guess = pixels[i - 1]
        elif x == 0:
            guess = pixels[i - width]
        else:
            guess = predict_one(modes[(y >> block) * across + (x >> block)], pixels[i - 1], pixels[i - width], pixels[i - width - 1], pixels[i - width + 1])
        left_over.append([(a - b) % 256 for a, b in zip(p, guess)])
    word = lambda p: p[3] << 24 | p[2] << 16 | p[1] << 8 | p[0]
    w = start(width, height)
    w.write(1 | webp.PREDICTOR << 1 | (block - 2) << 3, 6)
    w.image([m << 8 | 0xFF000000 for m in modes], across)
    w.write(0, 1)
    w.image([word(p) for p in left_over], width, True)
    assert decode(w.file())[0].ravel().tolist() == [word(p) for p in pixels]


@pytest.mark.parametrize("colours", (1, 2, 3, 4, 9, 16, 17, 200))
def test_palettes(colours):
    draw = random.Random(colours)
    width, height = 13, 6
    palette = [draw.getrandbits(32) for _ in range(colours)]
    index = [draw.randrange(colours) for _ in range(width * height)]
    packed = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    inner, each = webp.subsampled(width, packed), 8 >> packed
    rows = []
    for y in range(height):
        for x in range(inner):
            group = index[y * width : (y + 1) * width][x << packed : (x + 1) << packed]
            rows.append(sum(v << (k * each) for k, v in enumerate(group)) << 8 | 0xFF000000)
    steps = [palette[0]]
    for a, b in zip(palette, palette[1:]):
        steps.append(sum((((b >> s & 255) - (a >> s & 255)) % 256) << s for s in (0, 8, 16, 24)))
    w = start(width, height)
    w.write(1 | webp.PALETTE << 1, 3)
    w.write(colours - 1, 8)
    w.image(steps, colours)
    w.write(0, 1)
    w.image(rows, inner, True)
    assert decode(w.file())[0].ravel().tolist() == [palette[i] for i in index]


def test_cross_colour_by_blocks():
    draw = random.Random(4)
    width, height, block = 9, 9, 2
    across = webp.subsampled(width, block)
    factors = [[draw.randrange(-128, 128) for _ in range(3)] for _ in range(across * across)]
    signed = lambda v: (v + 128) % 256 - 128
    pixels, coded = [], []
    for i in range(width * height):
        b, g, r, a = (draw.randrange(256) for _ in range(4))
        to_red, to_blue, red_to_blue = factors[(i // width >> block) * across + (i % width >> block)]
        pixels.append(a << 24 | r << 16 | g << 8 | b)
        b = (b - (to_blue * signed(g) >> 5) - (red_to_blue * signed(r) >> 5)) % 256
        r = (r - (to_red * signed(g) >> 5)) % 256
        coded.append(a << 24 | r << 16 | g << 8 | b)
    w = start(width, height)
    w.write(1 | webp.CROSS_COLOUR << 1 | (block - 2) << 3, 6)
    w.image([0xFF000000 | (z % 256) << 16 | (y % 256) << 8 | x % 256 for x, y, z in factors], across)
    w.write(0, 1)
    w.image(coded, width, True)
    assert decode(w.file())[0].ravel().tolist() == pixels


def grey(images):
    """A byte for each pixel; all channels of a grey image are equal."""
    every = np.concatenate([webp.bytes_of(x).reshape(-1, 4) for x in images])
    assert (every[:, 0] == every[:, 1]).all() and (every[:, 2] == every[:, 1]).all() and (every[:, 3] == 255).all()
    return every[:, 1].tobytes()


def prose(draw, words):
    vocabulary = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 9))) for _ in range(200)]
    return " ".join(draw.choice(vocabulary) for _ in range(words))


@pytest.mark.parametrize("size", (0, 1, 575, 576, 577, 4607, 4608, 4609, 20_000, 576 * 100))
def test_payloads_come_back(size):
    """Side by side and symbol by symbol: two readers of the same files."""
    draw = np.random.default_rng(size)
    text = "".join(map(chr, draw.integers(32, 500, size)))
    n, payload = payload_of(text)
    assert n == len(text.encode()) and len(payload) % 576 == 0 and payload
    data = stored(payload)
    assert grey(decode_all(data)) == payload
    heights, channels, pixels = decode_many([data])[0]
    assert channels == 1 and 576 * sum(heights) == len(payload) and pixels.tobytes() == payload


def test_texts_get_shorter_by_codes_and_back_references():
    draw = random.Random(1)
    texts = [prose(draw, 600), prose(draw, 5) * 40, "a" * 3000, "", None, prose(draw, 90) + "\n" * 700, "".join(map(chr, range(1, 250)))]
    payloads = [payload_of(x)[1] for x in texts]
    blobs = stored_many(payloads)
    assert [pixels.tobytes() for *_, pixels in decode_many(blobs)] == payloads == [grey(decode_all(b)) for b in blobs]
    assert len(blobs[0]) < 0.65 * len(payloads[0]) and all(len(b) < 0.2 * len(p) for b, p in zip(blobs[1:5], payloads[1:5]))
    used = {"literals": 0, "copies": 0, "near": 0, "far": 0}
    original = webp.GreyFiles.prefixed

    def counting(symbol, rest):
        value = original(symbol, rest)
        used["copies"] += len(symbol)
        used["near"] += int((value[0] <= 120).sum())
        used["far"] += int((value[0] > 120).sum())
        return value

    webp.GreyFiles.prefixed = staticmethod(counting)
    try:
        decode_many(blobs)
    finally:
        webp.GreyFiles.prefixed = staticmethod(original)
    assert used["copies"] > 50 and used["near"] and used["far"]


def test_other_files_are_read_symbol_by_symbol():
    draw = random.Random(2)
    w = start(5, 2)
    w.write(0, 1)
    pixels = [draw.getrandbits(32) for _ in range(10)]
    w.image(pixels, 5, True)
    mine = stored(payload_of("mine")[1])
    (one, four, raw), (_, channels, _) = decode_many([w.file(), mine])
    assert one == [2] and four == 4 and raw.view("<u4").tolist() == pixels and channels == 1


def test_codes_are_short_enough_and_complete():
    draw = random.Random(5)
    for limit in (8, 11):
        for n in (1, 2, 3, 40, 200):
            used = [(1 << min(40, k) if draw.random() < 0.5 else draw.randint(1, 9), k) for k in range(n)]
            lengths = webp.code_lengths(used, limit)
            assert max(lengths) <= limit and (n == 1 or sum(2.0**-x for x in lengths) == 1)


def test_broken_references_are_refused():
    files = webp.GreyFiles()
    data = stored(payload_of("abcabcabcabcabcabc" * 20)[1])
    assert files.add(data, 0, len(data))
    files.sizes[0] = 30  # the copy goes beyond the end
    with pytest.raises(ValueError, match="outside"):
        files.decode()


def test_media_of_odd_rows(spark, make_docs, odd_texts):
    """Nulls, empty and long texts, repeated rows, clashing columns, null media, an empty table."""
    media = webp.store_texts(make_docs(odd_texts, extra=True))
    rows = {r.doc_id: r for r in webp.read_media(media, ("doc_id", "n_bytes")).collect()}
    for i, text in enumerate(odd_texts):
        n, payload = payload_of(text)
        assert (rows[i].n_bytes, bytes(rows[i].pixels), rows[i].channels) == (n, payload, 1)
    assert rows[0].media == rows[1].media == rows[9].media and rows[0].feature == rows[1].feature
    none = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert webp.read_media(none).first().pixels is None
    assert webp.read_media(webp.store_texts(make_docs([]))).count() == 0


def test_empty_and_null_texts_are_one_row_of_padding():
    assert payload_of(None) == payload_of("") == (0, b"\xff" * 576)


def test_encoder_chooses_predictors():
    """Ramps along and down the rows are stored as what the left and the top predictor leave, texts without a transform; both
    decoders read all of them."""
    draw = np.random.default_rng(1)
    along = np.cumsum(draw.integers(1, 4, 8 * webp.ROW_BYTES)).astype(np.uint8).tobytes()
    down = (draw.integers(0, 256, webp.ROW_BYTES) + np.cumsum(draw.integers(1, 3, (8, webp.ROW_BYTES)), axis=0)).astype(np.uint8).tobytes()
    text = webp.payload_of("one file may have a predictor, the next one none " * 20)[1]
    payloads = [along, text, down, along[: webp.ROW_BYTES], webp.payload_of("")[1], along + down]
    media = webp.stored_many(payloads)
    assert [len(m) < 0.65 * len(p) for p, m in zip(payloads, media)] == [True] * 6
    kinds = [[webp.BitReader(x[21:]) for x in (m[at : at + size] for at, size in webp.files_of(m))] for m in media]
    for bits in sum(kinds, []):
        bits.at = 14 + 14 + 4 + 3
    assert [[bits.read(1) for bits in own] for own in kinds] == [[1], [0], [1], [1], [0], [1, 1]]
    for payload, data, (_, channels, pixels) in zip(payloads, media, webp.decode_many(media)):
        slow = np.concatenate([webp.bytes_of(x).reshape(-1, 4) for x in webp.decode_all(data)])
        assert channels == 1 and pixels.tobytes() == payload == slow[:, 1].tobytes()
        assert (slow[:, 0] == slow[:, 1]).all() and (slow[:, 2] == slow[:, 1]).all() and (slow[:, 3] == 255).all()
