import io

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillstone.llm import media, queries

RNG = np.random.default_rng(3)


def area_mean(x, rows, columns):
    """Brute force: every target pixel is a weighted mean over source pixels, in exact fractions."""
    h, w, c = x.shape
    weights = lambda n, m: np.array([[max(0, min((i + 1) * n, (j + 1) * m) - max(i * n, j * m)) for j in range(n)] for i in range(m)])
    total = np.einsum("ah,hwc,bw->abc", weights(h, rows), x.astype(np.int64), weights(w, columns), optimize=True)
    return (2 * total + h * w) // (2 * h * w)


@pytest.mark.parametrize("size", [(1, 1), (3, 5), (32, 32), (40, 7), (100, 65)])
def test_resize(size):
    x = RNG.integers(0, 256, (*size, 3), np.uint8)
    assert (media.resize(x, 32, 32) == area_mean(x, 32, 32)).all() and (media.resize(x, 8, 9) == area_mean(x, 8, 9)).all()


def test_netpbm():
    g = RNG.integers(0, 256, (4, 9, 1), np.uint8)
    c = RNG.integers(0, 256, (4, 9, 3), np.uint8)
    b = RNG.integers(0, 2, (4, 9, 1), np.uint8)
    text = lambda x: b" ".join(b"%d" % v for v in x.ravel())
    head = b"# made\n9 # wide\n4\n"
    cases = [
        (b"P2 " + head + b"255\n" + text(g), g), (b"P3 " + head + b"255\n" + text(c), c), (b"P5 " + head + b"255\n" + g.tobytes(), g), (b"P6\n9 4\n255\n" + c.tobytes() + b"more", c),
        (b"P1 " + head + b"".join(b"%d" % v for v in b.ravel()), 255 * (1 - b)), (b"P4\n9 4\n" + np.packbits(b[:, :, 0], axis=1).tobytes(), 255 * (1 - b)),
        (b"P5\n9 4\n65535\n" + (g.astype(">u2") * 257).tobytes(), g), (b"P7\nWIDTH 9\nHEIGHT 4\nDEPTH 3\nMAXVAL 255\nTUPLTYPE RGB\nENDHDR\n" + c.tobytes(), c),
    ]
    for data, want in cases:
        assert (media.decode(data)[1] == want).all(), data[:12]


def test_bmp():
    c = RNG.integers(0, 256, (5, 7, 3), np.uint8)
    assert (media.decode(media._bitmap(c))[1] == c).all()
    index = RNG.integers(0, 16, (3, 6), np.uint8)
    palette = np.concatenate((RNG.integers(0, 256, (16, 3), np.uint8), np.zeros((16, 1), np.uint8)), axis=1)
    u = lambda x, n=4: int(x).to_bytes(n, "little", signed=x < 0)

    def made(bits, body, packed, height=3):
        at = 54 + 64
        return b"BM" + u(at + len(body)) + u(0) + u(at) + u(40) + u(6) + u(height) + u(1, 2) + u(bits, 2) + u(packed) + u(len(body)) + u(0) * 2 + u(16) + u(0) + palette.tobytes() + body

    want = palette[index][:, :, 2::-1]
    rows = np.zeros((3, 8), np.uint8)
    rows[:, :6] = index
    assert (media.decode(made(8, rows[::-1].tobytes(), 0))[1] == want).all()
    assert (media.decode(made(8, rows.tobytes(), 0, -3))[1] == want).all()  # from the top
    four = rows[:, ::2] << 4 | rows[:, 1::2]
    assert (media.decode(made(4, four[::-1].tobytes(), 0))[1] == want).all()
    runs = b"".join(b"".join(bytes((1, v)) for v in r) + b"\0\0" for r in index[::-1]) + b"\0\1"
    assert (media.decode(made(8, runs, 1))[1] == want).all()


def test_hash_and_tiles(spark, tmp_path):
    ramp = np.tile(np.arange(90, dtype=np.uint8), (40, 1))[:, :, None]
    assert media.difference_hash(ramp) == "f" * 16 and media.difference_hash(ramp[:, ::-1]) == "0" * 16
    docs = spark.createDataFrame([(i, "some text %d " % i * 50) for i in range(20)] + [(99, None)], "doc_id long, text string")
    tiles = media.media_tiles(media.pictures(docs))
    index = media.write_tiles(tiles, str(tmp_path / "tiles")).collect()
    want = {r.doc_id: np.load(io.BytesIO(r.npy)) for r in tiles.where("error is null").collect()}
    assert len(index) == 20 == len(want)
    for r in index:
        assert (np.load(tmp_path / "tiles" / r.file)[r.row] == want[r.doc_id]).all()


def test_bands(monkeypatch):
    """Images larger than a band, wide and high ones, and comments and long numbers across the borders of bands."""
    monkeypatch.setattr(media, "BAND", 50)
    for size in ((1, 900, 1), (900, 1, 3), (40, 37, 3), (64, 1, 1)):
        x = RNG.integers(0, 256, size, np.uint8)
        assert (media.resize(x, 32, 32) == area_mean(x, 32, 32)).all()
        wide = x.astype(int)
        assert (media.grey(x)[:, :, 0] == (wide[:, :, 0] if size[2] == 1 else (wide @ [299, 587, 114] + 500) // 1000)).all()
    g = RNG.integers(0, 256, (9, 30, 1), np.uint8)
    text = b" ".join(b"%030d" % v if v % 5 else b"%d" % v for v in g.ravel())
    assert (media.decode(b"P2 30 9 255\n" + text)[1] == g).all()
    assert media.decode(b"P2 1 1 255\n" + b"9" * 400)[1][0, 0, 0] == 255
    sixteen = RNG.integers(0, 65536, (9, 30), np.uint16)
    assert (media.decode(b"P5 30 9 65535\n" + sixteen.astype(">u2").tobytes())[1][:, :, 0] == (sixteen.astype(int) * 510 + 65535) // 131070).all()


def bitmap(width, height, bits, packed, body, palette=b"", masks=b""):
    u = lambda x, n=4: int(x).to_bytes(n, "little", signed=x < 0)
    at = 54 + len(masks) + len(palette)
    return b"BM" + u(at + len(body)) + u(0) + u(at) + u(40) + u(width) + u(height) + u(1, 2) + u(bits, 2) + u(packed) + u(len(body)) + u(0) * 2 + u(len(palette) // 4) + u(0) + masks + palette + body


def test_bmp_of_every_depth():
    h, w = 3, 7
    bit = RNG.integers(0, 2, (h, w), np.uint8)
    rows = np.zeros((h, 4), np.uint8)
    rows[:, :1] = np.packbits(bit, axis=1)
    two = bytes((0, 0, 0, 0, 255, 255, 255, 0))
    assert (media.decode(bitmap(w, h, 1, 0, rows[::-1].tobytes(), two))[1][:, :, 0] == bit * 255).all()
    c = RNG.integers(0, 256, (h, w, 4), np.uint8)
    assert (media.decode(bitmap(w, h, 32, 0, c[::-1].tobytes()))[1] == c[:, :, 2::-1]).all()
    masks = b"".join(m.to_bytes(4, "little") for m in (0xFF000000, 0xFF0000, 0xFF00))
    assert (media.decode(bitmap(w, h, 32, 3, c[::-1].tobytes(), masks=masks))[1] == c[:, :, :0:-1]).all()
    v = RNG.integers(0, 65536, (h, w), np.uint16)
    padded = np.zeros((h, w + 1), "<u2")
    padded[:, :w] = v
    scaled = lambda x, most: (x.astype(int) * 510 + most) // (2 * most)
    found = media.decode(bitmap(w, h, 16, 0, padded[::-1].tobytes()))[1]
    assert (found == np.stack([scaled(v >> k & 31, 31) for k in (10, 5, 0)], axis=2)).all()
    masks = b"".join(m.to_bytes(4, "little") for m in (0xF800, 0x7E0, 0x1F))
    found = media.decode(bitmap(w, h, 16, 3, padded[::-1].tobytes(), masks=masks))[1]
    assert (found == np.stack([scaled(v >> 11, 31), scaled(v >> 5 & 63, 63), scaled(v & 31, 31)], axis=2)).all()
    palette = np.concatenate((RNG.integers(0, 256, (16, 3), np.uint8), np.zeros((16, 1), np.uint8)), axis=1)
    # a run of five, three plain ones, a step over one pixel, and the end
    runs = bytes((5, 0x12, 0, 1 + 2, 0x34, 0x50, 0, 0)) + bytes((0, 2, 1, 1)) + bytes((2, 0x67, 0, 1))
    want = np.zeros((3, 8), np.uint8)
    want[0, :8] = [1, 2, 1, 2, 1, 3, 4, 5]
    want[2, 1:3] = [6, 7]
    assert (media.decode(bitmap(8, 3, 4, 2, runs, palette.tobytes()))[1] == palette[want[::-1]][:, :, 2::-1]).all()


def test_pam_with_transparency():
    for depth in (2, 4):
        x = RNG.integers(0, 256, (3, 5, depth), np.uint8)
        assert (media.decode(b"P7\nWIDTH 5\nHEIGHT 3\nDEPTH %d\nMAXVAL 255\nENDHDR\n" % depth + x.tobytes())[1] == x[:, :, : depth - 1]).all()


WHOLE = [
    b"P1 3 2 101010", b"P2 3 2 255 1 2 3 4 5 6", b"P3 1 2 255 1 2 3 4 5 6", b"P4 9 2\nabcd", b"P5 3 2 255\nabcdef", b"P5 3 2 999\nabcdefghijkl", b"P6 1 2 255\nabcdef", b"P7\nWIDTH 1\nHEIGHT 2\nDEPTH 3\nMAXVAL 255\nENDHDR\nabcdef",
    bitmap(2, 2, 24, 0, bytes(16)), bitmap(2, 2, 32, 0, bytes(16)), bitmap(2, 2, 16, 0, bytes(8)), bitmap(2, 2, 8, 1, bytes((2, 1, 0, 0, 2, 0, 0, 1)), bytes(8)), bitmap(2, 2, 4, 2, bytes((2, 1, 0, 0, 2, 0, 0, 1)), bytes(8)), bitmap(2, 2, 1, 0, bytes(8), bytes(8)),
]


@pytest.mark.parametrize("data", WHOLE)
def test_cut_images_are_errors_or_images(data):
    assert media.looked_at(data, 4)[-1] is None
    for i in range(len(data)):
        row = media.looked_at(data[:i], 4)
        assert (row[-1] is None) == (row[-2] is not None)
    # the last byte of the last sample is missing; run lengths may end early, leaving background
    if data[:2] != b"BM" or data[30] == 0:
        assert media.looked_at(data[:-1], 4)[-1] == "too short"


@settings(max_examples=400, deadline=None)
@given(st.sampled_from(WHOLE), st.lists(st.tuples(st.integers(0, 80), st.integers(0, 255)), max_size=6), st.binary(max_size=20))
def test_damaged_images_never_raise(data, changes, tail):
    damaged = bytearray(data + tail)
    for at, byte in changes:
        damaged[at % len(damaged)] = byte
    row = media.looked_at(bytes(damaged), 4)
    assert (row[-1] is None) == (row[-2] is not None)
    assert (media.looked_at(tail, 4)[-1] is None) == (media.looked_at(tail, 4)[-2] is not None)


def test_claims_beyond_the_bytes_are_refused_before_anything_is_allocated():
    for data in (b"P5 999999999 999999999 255\n", b"P4 999999999 999999999\n", b"P2 99999 99999 255 1", b"P1 999999999 9 1", bitmap(1 << 20, 1 << 20, 8, 1, bytes(20)), bitmap(1 << 30, 1 << 30, 24, 0, bytes(60))):
        assert media.looked_at(data, 32)[-1] == "too short"


def test_query_against_brute_force(spark):
    """op2 as registered, every row of a table: the bytes of a text are the samples, whatever the format."""
    texts = {r["doc_id"]: r["text"].encode() for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()}
    rows = queries.QUERIES["op2_media_tiles"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data, kind = texts[r.doc_id], r.doc_id % 4
        channels = 3 if kind in (1, 2) else 1
        units = max(1, -(-len(data) // channels))
        width = int(np.ceil(np.sqrt(units)))
        height = -(-units // width)
        x = np.frombuffer(data.ljust(width * height * channels, b"\0"), np.uint8).reshape(height, width, channels)
        if kind == 3:
            x = 255 * (1 - np.unpackbits(x[:, :, 0], axis=1))[:, :, None]
        assert (r.format, r.width, r.height, r.channels) == (("pgm", "ppm", "bmp", "pbm")[kind], x.shape[1], x.shape[0], channels)
        assert (np.load(io.BytesIO(r.npy)) == area_mean(x, 32, 32)).all()
        luma = x if channels == 1 else ((x.astype(int) @ [299, 587, 114] + 500) // 1000)[:, :, None]
        small = area_mean(luma, 8, 9)[:, :, 0]
        assert int(r.dhash, 16) == int("".join("1" if b > a else "0" for line in small.tolist() for a, b in zip(line, line[1:])), 2)
