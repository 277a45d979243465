"""Lossless WebP: both decoders on images that use every feature, and exact payload round trips."""

import base64
import hashlib
import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import media, token_files, webp


def both(data):
    [payload] = webp.images(data)
    a, b = webp.decode_vp8l(payload), webp.decode_vp8l(payload, fast=False)
    assert (a == b).all()
    return a


def picture(rng, h, w, colours=None):
    if colours:
        return rng.choice(rng.integers(0, 1 << 32, colours, dtype=np.uint32), (h, w))
    smooth = rng.integers(0, 1 << 32, (h, w), dtype=np.uint32)
    smooth[h // 3 :, w // 2 :] = 0xFF102030
    return smooth


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (3,), (0, 1, 2), (2, 0), (3, 0), (1, 2, 0)])
@pytest.mark.parametrize("options", [{}, {"cache_bits": 4}, {"references": True}, {"cache_bits": 6, "references": True}])
def test_features(transforms, options):
    rng = np.random.default_rng(len(transforms) * 7 + len(options))
    for h, w, colours in ((13, 21, 9), (1, 1, 1), (9, 17, 3), (5, 40, 2), (10, 10, 40), (18, 11, None)):
        if colours is None and webp.PALETTE in transforms:
            continue
        image = picture(rng, h, w, colours)
        wide = webp.blocks(w, webp._pack_bits(len(np.unique(image)))) if transforms[:1] == (webp.PALETTE,) else w
        modes = rng.integers(0, 14, (webp.blocks(h, 3), webp.blocks(wide, 3)))
        elements = rng.integers(0, 1 << 32, (webp.blocks(h, 3), webp.blocks(wide, 3)), dtype=np.uint32)
        assert (both(webp.encode_image(image, transforms, 3, modes, elements, **options)) == image).all()


def test_groups():
    rng = np.random.default_rng(4)
    image = picture(rng, 19, 23, 12)
    meta = rng.integers(0, 3, (webp.blocks(19, 2), webp.blocks(23, 2)))
    for options in ({}, {"references": True, "cache_bits": 5}):
        assert (both(webp.encode_image(image, (2,), meta=meta, meta_bits=2, **options)) == image).all()


def test_near_offsets():
    assert len(webp.NEAR) == 120 and webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.NEAR[-3:] == [(-7, 7), (8, 6), (8, 7)]


def test_predictions():
    p = [0xFF804020, 0x80FF10A0, 0x10203040, 0xFFFFFFFF]
    for mode, (l, t, c, r) in itertools.product(range(14), itertools.permutations(p)):
        assert webp._add(webp._sub(l, webp.predict(mode, l, t, c, r)), webp.predict(mode, l, t, c, r)) == l
    assert webp.predict(13, 0, 0, 0xFFFFFFFF, 0) == 0
    assert webp.predict(12, 0xC8, 0xC8, 0x10, 0) == 0xFF


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=700), st.text(max_size=300).map(lambda t: t.encode("utf-8", "replace")), st.binary(min_size=1, max_size=2).map(lambda b: b * 900)))
def test_payloads(text):
    payload = media.payload_of(text)
    assert len(payload) % 64 == 0 and len(payload) > 0
    blob = media.encode_payload(payload)
    assert media.decode_payload(blob).tobytes() == payload
    assert webp.samples_of(both(blob)).tobytes() == payload


#: A lossless alpha chunk (16 x 16) from a public test file, written by another encoder, and the alpha of its PNG twin.
ALPHA = "J6KokSTleucYX+ffKpmImP90cY3gJjDi4Yt3MsjBEVyDKzDosHgVjnhRNcEIDAJPkqBqsFUZHNa2bUYvTsZ2PLbtd/uvKa4hov9J0f2PkPe6REkkGzolkTTzFG0Ox9PlFiD0CxS+kOGDtxoynjaCfx0pfk52CPuInrOR75lzRugygtv4zEiy90UwfSD9NheMITJWLaXWayO8XeOlWRXVnIGk2W6WdYoYMQ+KqixQNPowgt+6a1BSKbUtz+lUFAoBAAA="
ALPHA_PIXELS = (
    "00000000afedfffffff7920b0300000000000000ffffffffffffff280b00000000000000ffffffffffffff4115000000007ea0a1a3a7aaaaffffff4818000000"
    "bdffffffffffffffffffff48fff7820affffffffffffffffffffb643ffffed24fffffffffffffffff7b64f88ffffff3dffffffffb65c4c4847416bf7ffffff46"
    "f7ffffaa4ea6f7fffffffffffffff747d7ffff5bb3ffffffffffffffffffc2416ff7ff4bffffffffffffffffffff7a3408213c35ffffffaaa9a9a9a9a9794120"
    "02091312ffffffffffffff41352c1e0b00000000f7fffffffffff7401c090501000000004cccf7ffffd87b3b1200000000000000081d35424745381f08000000"
)
#: One-pixel files that browsers are probed with: black without alpha, opaque white.
PROBES = {"UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==": 0, "UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA=": 0xFFFFFFFF}


def test_files_of_other_encoders():
    data = base64.b64decode(ALPHA)
    for fast in (True, False):
        seen = set()
        image = webp.decode_body(webp.Bits(data), 16, 16, fast, seen)
        assert (image >> 8 & 255).astype(np.uint8).tobytes().hex() == ALPHA_PIXELS and seen == {"palette", "references"}
    for text, pixel in PROBES.items():
        assert both(base64.b64decode(text)).tolist() == [[pixel]]


def test_forms():
    """Every form is chosen where it is the smallest, and read back."""
    rng = np.random.default_rng(8)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(300)]
    prose = b" ".join(words[i] for i in rng.integers(0, 300, 1500))
    ramp = bytes((np.arange(64)[None] * 3 + np.arange(200)[:, None] * 5 + rng.integers(0, 2, (200, 64)) & 255).astype(np.uint8).tobytes())
    cases = {"references": prose[:1500] * 4, "cache": rng.integers(0, 1 << 32, 60, dtype=np.uint32)[rng.integers(0, 60, 4000)].tobytes(), "palette": b"01234567" * 9 + b"x1", "predictor": ramp, None: rng.integers(0, 256, 3000).astype(np.uint8).tobytes()}
    for name, text in cases.items():
        payload = media.payload_of(text)
        blob = media.encode_payload(payload)
        assert webp.used(blob) == ({name} if name else set()), name
        assert media.decode_payload(blob).tobytes() == payload
        assert webp.samples_of(both(blob)).tobytes() == payload


def test_forms_of_the_documents(spark):
    """How many stored images of 1,000 documents take each form; a form is left out only where it would save less than 5 %."""
    assert webp.GAIN >= 0.95
    rows = media.store_media(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    counts = Counter(f for r in rows for f in webp.used(bytes(r.media)) or {"plain"})
    assert counts["references"] > 150 and counts["cache"] > 90 and counts["palette"] > 10 and counts["plain"] < 750
    assert set(counts) <= {"plain", "references", "cache", "palette", "predictor"}


def test_cache_slots():
    """Slots that are named before any pixel went there, and that change their pixel."""
    pixels, slots = np.array([7, 0, 9, 0, 0], np.uint32), np.array([-1, 0, -1, 0, 0])
    at = [int(p) * webp.CACHE_MULTIPLIER % (1 << 32) >> 31 for p in (7, 9)]
    slots[1], slots[3], slots[4] = at[0], at[1], 1 - at[0] if at[0] == at[1] else at[0]
    want = [7, 7, 9, 9, 0 if at[0] == at[1] else 7]
    assert webp._from_cache(pixels, slots, 1).tolist() == want


def test_lengths_as_package_merge():
    rng = np.random.default_rng(2)
    for n in (2, 3, 10, 60, 256):
        counts = rng.zipf(1.3, n).clip(0, 10**9) * rng.integers(0, 2, n)
        a, b = webp.code_lengths(counts, 15).astype(int), token_files.code_lengths(counts, 15).astype(int)
        assert (a * counts).sum() == (b * counts).sum() and a.max(initial=0) <= 15


def test_several_images():
    payload = media.payload_of(bytes(np.random.default_rng(0).integers(97, 110, 64 * 16384 + 130).astype(np.uint8)))
    blob = media.encode_payload(payload)
    assert len(list(webp.images(blob))) == 2 and media.decode_payload(blob).tobytes() == payload


def test_damage():
    blob = media.encode_payload(media.payload_of(b"some text here" * 30))
    with pytest.raises(ValueError):
        media.decode_payload(blob[:20].replace(b"VP8L", b"VP8X") + blob[20:])


def test_operator(spark):
    texts = ["hello world", None, "", "é" * 70000, "hello world", "a" * 64]
    df = spark.createDataFrame([(i or None, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, media int, samples string")
    stored = media.store_media(df)
    rows = media.read_media(stored).collect()
    for r, t in zip(rows, texts, strict=True):
        want = media.payload_of((t or "").encode())
        assert bytes(r.samples) == want and r.width * r.height == len(want) and r.n_bytes == len((t or "").encode())
    assert rows[0][2:] == rows[4][2:] and rows[1][2:] == rows[2][2:]
    assert media.read_media(media.store_media(df.limit(0))).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = media.op8_media(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        p = media.payload_of(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
