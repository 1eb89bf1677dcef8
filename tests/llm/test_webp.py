"""The WebP codec: payload round trips, and pictures with every transform, the cache, groups and far references."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidebook.llm import media, webp


def encode(argb, steps=(), cache_bits=0, groups=0, references=True):
    """A plain encoder of any picture, for what the payload encoder doesn't write."""
    out = webp.Writer()
    h, w = argb.shape
    out.put(w - 1, 14)
    out.put(h - 1, 14)
    out.put(1, 1)
    out.put(0, 3)
    for kind, block, data in steps:
        out.put(1, 1)
        out.put(kind, 2)
        if kind == webp.PREDICTOR:
            out.put(block - 2, 3)
            picture(out, data, 0, 0, False)
            argb = take_prediction(argb, data >> np.uint32(8) & np.uint32(255), block)
        elif kind == webp.CROSS_COLOUR:
            out.put(block - 2, 3)
            picture(out, data, 0, 0, False)
            argb = webp.cross_colour(argb, data, block, -1)
        elif kind == webp.PALETTE:
            palette = np.unique(argb)
            out.put(len(palette) - 1, 8)
            planes = webp._channels(palette)
            picture(out, webp._joined(np.diff(planes, axis=0, prepend=0) & 255).reshape(1, -1), 0, 0, False)
            share = webp.palette_share(len(palette))
            index = np.searchsorted(palette, argb)
            pad = -argb.shape[1] % (1 << share)
            index = np.pad(index, ((0, 0), (0, pad))).reshape(h, -1, 1 << share)
            argb = ((index << (8 >> share) * np.arange(1 << share)).sum(2) << 8).astype(np.uint32) | np.uint32(0xFF000000)
        else:
            p = webp._channels(argb)
            p[..., 1] -= p[..., 2]
            p[..., 3] -= p[..., 2]
            argb = webp._joined(p & 255)
    out.put(0, 1)
    picture(out, argb, cache_bits, groups, True, references)
    return webp.framed(out.packed())


def take_prediction(argb, modes, block):
    px = webp._channels(argb).tolist()
    out = np.zeros((*argb.shape, 4), np.int32)
    for y, row in enumerate(px):
        for x, p in enumerate(row):
            if not y:
                guess = row[x - 1] if x else [255, 0, 0, 0]
            elif not x:
                guess = px[y - 1][0]
            else:
                above = px[y - 1]
                guess = webp.predicted(int(modes[y >> block, x >> block]), row[x - 1], above[x], above[x + 1] if x + 1 < len(row) else row[0], above[x - 1])
            out[y, x] = [(i - j) & 255 for i, j in zip(p, guess, strict=True)]
    return webp._joined(out)


def picture(out, argb, cache_bits, groups, main, references=False):
    h, w = argb.shape
    flat = argb.ravel().tolist()
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    which = np.zeros((h, w), int)
    if main:
        out.put(1 if groups else 0, 1)
        if groups:
            out.put(0, 3)
            small = np.arange(-(-h // 4) * -(-w // 4)).reshape(-(-h // 4), -1) % groups
            picture(out, (small << 8).astype(np.uint32), 0, 0, False)
            which = np.repeat(np.repeat(small, 4, 0), 4, 1)[:h, :w]
    tokens, cache, i = [], {}, 0
    slot = lambda p: (webp.CACHE_MULTIPLIER * p & 0xFFFFFFFF) >> (32 - cache_bits)
    while i < len(flat):
        best, far = 0, 0
        for d in (1, 2, w, w + 1, w - 1, 3 * w + 200) if references else ():
            n = 0
            while d <= i and i + n < len(flat) and flat[i + n] == flat[i + n - d] and n < 300:
                n += 1
            best, far = (n, d) if n > best else (best, far)
        used = 1
        if best >= 3:
            code = {1: 2, w: 1, w + 1: 3, w - 1: 4}.get(far, far + 120)
            tokens.append((i, "r", (best, code)))
            used = best
        elif cache_bits and cache.get(slot(flat[i])) == flat[i]:
            tokens.append((i, "c", slot(flat[i])))
        else:
            tokens.append((i, "l", flat[i]))
        for p in flat[i : i + used]:
            if cache_bits:
                cache[slot(p)] = p
        i += used
    size, n = 280 + (1 << cache_bits if cache_bits else 0), max(1, groups)
    counts = [[np.zeros(s, int) for s in (size, 256, 256, 256, 40)] for _ in range(n)]
    for i, kind, v in tokens:
        c = counts[which[i // w, i % w]]
        if kind == "l":
            for k, s in enumerate((8, 16, 0, 24)):
                c[k][v >> s & 255] += 1
        elif kind == "c":
            c[0][280 + v] += 1
        else:
            c[0][256 + webp.prefix_of(v[0])[0]] += 1
            c[4][webp.prefix_of(v[1])[0]] += 1
    made = []
    for group in counts:
        made.append([])
        for c in group:
            ln = webp.code_lengths(c)
            webp.write_code(out, ln)
            made[-1].append((webp.codes(ln), ln if np.count_nonzero(ln) > 1 else ln * 0))
    for i, kind, v in tokens:
        c = made[which[i // w, i % w]]
        put = lambda k, s, c=c: out.put(int(c[k][0][s]), int(c[k][1][s]))
        if kind == "l":
            for k, s in enumerate((8, 16, 0, 24)):
                put(k, v >> s & 255)
        elif kind == "c":
            put(0, 280 + v)
        else:
            for k, x in ((0, v[0]), (4, v[1])):
                s, extra, bits = webp.prefix_of(x)
                put(k, s + (256 if k == 0 else 0))
                if bits:
                    out.put(extra, bits)


def image(h, w, colours=None, seed=0):
    r = np.random.default_rng(seed)
    if colours:
        return r.choice(r.integers(0, 2**32, colours, dtype=np.uint32), (h, w))
    y, x = np.mgrid[0:h, 0:w]
    base = np.stack([np.full((h, w), 255), x * 3 + r.integers(0, 3, (h, w)), y * 5 + x, 90 + y + r.integers(0, 9, (h, w))], -1) & 255
    return webp._joined(base)


MODES = [(webp.PREDICTOR, 2, (np.arange(30, dtype=np.uint32).reshape(5, 6) % 14) << np.uint32(8))]
CROSS = [(webp.CROSS_COLOUR, 3, np.random.default_rng(1).integers(0, 2**24, (3, 3), dtype=np.uint32))]


@pytest.mark.parametrize(
    "case",
    [
        {}, {"steps": MODES}, {"steps": CROSS}, {"steps": [(webp.SUBTRACT_GREEN, 0, None)]}, {"steps": [*MODES, *CROSS, (webp.SUBTRACT_GREEN, 0, None)]},
        {"cache_bits": 5}, {"groups": 3}, {"groups": 2, "cache_bits": 3, "steps": MODES}, {"references": False},
    ],
)
def test_pictures(case):
    argb = image(20, 23)
    argb[4:9] = argb[3]
    argb[15:18, 2:20] = 0xFF102030
    assert (webp.decode(encode(argb, **case)) == argb).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 7, 16, 17, 200])
def test_palettes(colours):
    argb = image(9, 21, colours)
    assert (webp.decode(encode(argb, [(webp.PALETTE, 0, None)])) == argb).all()


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=900) | st.binary(max_size=3).map(lambda b: b * 300))
def test_payload_round_trip(data):
    payload = media.as_payload(data)
    assert len(payload) % 64 == 0 and len(payload) > 0
    assert webp.decode_bytes(webp.encode_bytes(payload)).tobytes() == payload


def test_more_than_one_file_and_long_runs():
    payload = media.as_payload(b"A" * 1_300_000 + bytes(range(256)) * 500)
    stored = webp.encode_bytes(payload)
    assert stored.count(b"WEBPVP8L") == 2 and webp.decode_bytes(stored).tobytes() == payload


@pytest.mark.parametrize("cut", [5, 25, -8])
def test_damaged_files_are_refused(cut):
    stored = webp.encode_bytes(media.as_payload(bytes(range(256)) * 9))
    with pytest.raises((ValueError, IndexError)):
        webp.decode(stored[:cut])


def test_media_columns(spark):
    rows = spark.createDataFrame([(1, "text é", 5), (2, None, 5), (3, "", 5), (3, "", 5), (None, "y" * 70_000, 5)], "doc_id long, text string, n_bytes int")
    got = media.media_columns(rows).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 5 and by[1]["n_bytes"] == 7 and by[1]["payload_bytes"] == 64 and by[None]["payload_bytes"] == 70_016
    assert bytes(by[1]["pixels"]) == "text é".encode().ljust(64, b"\0") and by[2]["payload_sha256"] == by[3]["payload_sha256"]
    assert (webp.decode_bytes(bytes(by[None]["media"])).tobytes()[:70_000] == b"y" * 70_000) and by[2]["media_sha256"] == by[3]["media_sha256"]
    assert media.media_columns(rows.limit(0)).count() == 0
