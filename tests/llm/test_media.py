"""TIFF round trips of every form, pages of hand-made files, faults, and the payload contract."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from lectern.llm import tiff as T


@pytest.mark.parametrize("form", [T.Form(c, p, t) for c in (T.NONE, T.LZW, T.DEFLATE, T.PACKBITS) for p in (1, 2) for t in (False, True)])
def test_round_trip(form):
    rng = np.random.default_rng(3)
    pages = [rng.integers(0, 256, (300, 64), np.uint8), np.zeros((70, 100), np.uint8), np.repeat(rng.integers(0, 4, (5, 130), np.uint8), 2, axis=1)]
    got = list(T.walk(T.write_tiff(pages, form)))
    assert [(p.page, p.height, p.width) for p in got] == [(0, 300, 64), (1, 70, 100), (2, 5, 260)]
    assert all(p.pixels == x.tobytes() for p, x in zip(got, pages))


def test_lzw_lengths():
    rng = random.Random(1)
    for n in [0, 1, 2, 3, 253, 254, 255, 256, 257, 258, 766, 767, 1790, 1791, 3836, 3837, 3838, 20_000]:
        for alphabet in (b"a", b"ab", bytes(range(256))):
            data = bytes(rng.choice(alphabet) for _ in range(n))
            assert T.lzw_decode(T.lzw_encode(data)) == data


def test_packbits():
    for data in (b"", b"a", b"aaa", b"abc" * 100, b"a" * 1000, b"ab" + b"c" * 200 + b"de"):
        assert T.packbits_decode(T.packbits_encode(data), len(data)) == data


def test_big_endian_rgb_16_bit_with_predictor():
    image = np.arange(2 * 3 * 3, dtype=np.uint16).reshape(2, 3, 3) * 1000
    delta = image.copy()
    delta[:, 1:] -= image[:, :-1]
    data = zlib.compress(delta.astype(">u2").tobytes())
    fields = [(256, 3, 1, 3 << 16), (257, 3, 1, 2 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 8 << 16), (273, 4, 1, 8), (277, 3, 1, 3 << 16), (278, 3, 1, 2 << 16), (279, 4, 1, len(data)), (317, 3, 1, 2 << 16)]
    at = 8 + len(data)
    file = b"MM\0*" + struct.pack(">I", at) + data + struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHII", *f) for f in fields) + b"\0\0\0\0"
    (page,) = T.walk(file)
    assert (page.samples, page.bits) == (3, 16) and page.pixels == image.tobytes()


def test_faults(spark):
    good = T.write_tiff([np.zeros((4, 4), np.uint8)], T.Form(T.NONE))
    loop = bytearray(good)
    loop[-4:] = good[4:8]
    rows = [(1, good), (2, None), (3, b""), (4, b"II*\0\xff\xff\xff\xff"), (5, bytes(loop)), (6, good[:-40])]
    df = spark.createDataFrame([(i, bytearray(x) if x is not None else None, "clash") for i, x in rows], "doc_id long, media binary, page string")
    got = {}
    for r in T.tiff_pages(df).collect():
        got.setdefault(r.doc_id, []).append((r.page, r.error is None))
    assert got[1] == [(0, True)] and got[5] == [(0, True), (1, False)]
    assert all(got[i] == [(0, False)] for i in (2, 3, 4, 6))


def hand_made(pages):
    """A file of ``(width, height, bits, compression, fill order, data)`` pages."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for width, height, bits, how, fill, data in pages:
        at = len(out)
        out += data
        struct.pack_into("<I", out, link, len(out))
        fields = [(256, width), (257, height), (258, bits), (259, how), (266, fill), (273, at), (277, 1), (278, height), (279, len(data))]
        out += struct.pack("<H", len(fields)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("fill", [1, 2])
def test_few_bits(bits, fill):
    image = np.random.default_rng(bits).integers(0, 1 << bits, (5, 13), np.uint8)
    plain = b"".join(int("".join(f"{x:0{bits}b}" for x in row).ljust(-(-13 * bits // 8) * 8, "0"), 2).to_bytes(-(-13 * bits // 8), "big") for row in image)
    packed = T.packbits_encode(plain)
    stored = packed if fill == 1 else bytes(int(f"{x:08b}"[::-1], 2) for x in packed)
    (page,) = T.walk(hand_made([(13, 5, bits, T.PACKBITS, fill, stored)]))
    assert page.bits == bits and page.pixels == image.tobytes()


def test_a_bad_page_does_not_end_the_file(spark):
    good = (4, 1, 8, T.NONE, 1, b"abcd")
    file = hand_made([good, (4, 1, 8, T.DEFLATE, 1, b"damaged!"), (4, 1, 8, 7, 1, b"abcd"), good])
    df = spark.createDataFrame([(1, 4, bytearray(file))], "doc_id long, n_bytes long, media binary")
    got = sorted((r.page, r.error is None, r.pixels and bytes(r.pixels)) for r in T.tiff_pages(df).collect())
    assert got == [(0, True, b"abcd"), (1, False, None), (2, False, None), (3, True, b"abcd")]
    r = T.tiff_documents(df).first()
    assert (r.n_pages, r.payload_bytes) == (2, 8) and r.error.startswith("page 1: deflate")


def test_documents(spark):
    texts = {1: "", 2: None, 3: "x" * 64, 4: "héllo wörld", 5: "long text " * 20_000, 6: "héllo wörld"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in T.tiff_documents(T.text_to_tiff(df)).collect()}
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + b"\0" * ((64 - len(raw) % 64) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.error) == (len(raw), len(payload), None)
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    assert got[5].n_pages > 1
    assert [getattr(got[4], c) == getattr(got[6], c) for c in ("media_sha256", "feature")] == [True, True]
    assert T.tiff_documents(T.text_to_tiff(df.limit(0))).count() == 0


def test_damaged_files_end_in_faults_not_crashes(spark):
    rng = random.Random(13)
    files = [T.write_tiff([np.full((40, 64), 7, np.uint8), np.arange(30 * 70, dtype=np.uint8).reshape(30, 70)], f) for f in T.FORMS]
    bad = []
    for f in files:
        for _ in range(60):
            x = bytearray(f[: rng.randint(9, len(f))] if rng.random() < 0.3 else f)
            for _ in range(rng.randint(1, 4)):
                x[rng.randrange(8, len(x))] = rng.choice([0, 255, rng.randrange(256)])
            bad.append(bytes(x))

    def tag(file, number, value, count=1, kind=4):
        at = struct.unpack_from("<I", file, 4)[0]
        x = bytearray(file)
        for i in range(struct.unpack_from("<H", file, at)[0]):
            if struct.unpack_from("<H", file, at + 2 + 12 * i)[0] == number:
                struct.pack_into("<HHII", x, at + 2 + 12 * i, number, kind, count, value)
        return bytes(x)

    strips = T.write_tiff([np.zeros((40, 64), np.uint8)], T.Form(T.DEFLATE))
    claims = [tag(strips, 256, 0xFFFFFFFF), tag(strips, 257, 0xFFFFFFFF), tag(tag(strips, 256, 0xFFFFFFFF), 257, 0), tag(strips, 258, 0, 0, 3), tag(strips, 273, 0, 0), tag(strips, 277, 0, 1, 3), tag(strips, 278, 0), tag(strips, 257, 1 << 27)]
    bomb = zlib.compress(b"\0" * 50_000_000)
    at = struct.unpack_from("<I", strips, 4)[0]
    claims.append(tag(tag(strips, 273, len(strips)), 279, len(bomb)) + bomb)
    for f in claims:
        got = list(T.walk(f))
        assert len(got) == 1 and (isinstance(got[0], T.Fault) or got[0].height * got[0].width == len(got[0].pixels)), at
    assert isinstance(next(T.walk(claims[0])), T.Fault) and list(T.walk(claims[-1]))[0].pixels == bytes(40 * 64)
    df = spark.createDataFrame([(i, x, len(x)) for i, x in enumerate(bad + claims)], "doc_id long, media binary, n_bytes long")
    assert {r.doc_id for r in T.tiff_pages(df).select("doc_id").collect()} == set(range(len(bad) + len(claims)))
    assert T.tiff_documents(df).count() == len(bad) + len(claims)


def test_payloads_take_every_form(spark):
    rows = [(i, "x" * (i * 7)) for i in range(200)]
    got = T.tiff_documents(T.text_to_tiff(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len({r.feature.split(";")[1] for r in got}) == 10 and all(r.error is None for r in got)
    for r in got:
        want = T.payload_of(dict(rows)[r.doc_id].encode())
        assert (r.payload_sha256, r.payload_bytes) == (hashlib.sha256(want).hexdigest(), len(want))
