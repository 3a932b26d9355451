"""Colour JPEGs, subsampling, separate scans, restart intervals and wide quantisers, from a bit-by-bit encoder of the tests' own."""

import random

import numpy as np
import pytest

from quillmere.llm import media

#: Tables of equal lengths: 12 DC symbols of 4 bits, 255 AC symbols of 8 bits.
DC_SYMBOLS = list(range(12))
AC_SYMBOLS = [0x00, 0xF0, *[r << 4 | s for r in range(16) for s in range(1, 11)]]
DC_TABLE = bytes([0, 0, 0, 12, *[0] * 12, *DC_SYMBOLS])
AC_TABLE = bytes([*[0] * 7, len(AC_SYMBOLS), *[0] * 8, *AC_SYMBOLS])


class Bits:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def number(self, v):
        size = abs(v).bit_length()
        return size, v if v >= 0 else v + (1 << size) - 1

    def block(self, diff, ac):
        size, low = self.number(diff)
        self.put(DC_SYMBOLS.index(size), 4)
        self.put(low, size)
        run, last = 0, max((i for i, x in enumerate(ac) if x), default=-1)
        for x in ac[: last + 1]:
            if not x:
                run += 1
                continue
            while run > 15:
                self.put(AC_SYMBOLS.index(0xF0), 8)
                run -= 16
            size, low = self.number(x)
            self.put(AC_SYMBOLS.index(run << 4 | size), 8)
            self.put(low, size)
            run = 0
        if last < 62:
            self.put(AC_SYMBOLS.index(0x00), 8)

    def bytes(self):
        padded = self.bits + [1] * (-len(self.bits) % 8)
        return bytes(sum(b << 7 - i for i, b in enumerate(padded[j : j + 8])) for j in range(0, len(padded), 8)).replace(b"\xff", b"\xff\x00")


def segment(marker, body):
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def make(width, height, sampling, separate=False, interval=0, wide=False, q=3, seed=0):
    """(file, (rows, columns) DC values of the luminance, quantiser) of a picture of random blocks. ``sampling``: (h, v) of every component."""
    rng = random.Random(seed)
    hmax, vmax = max(h for h, _ in sampling), max(v for _, v in sampling)
    mcus_x, mcus_y = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    dc = [np.array([[rng.randrange(-200, 200) for _ in range(mcus_x * h)] for _ in range(mcus_y * v)]) for h, v in sampling]

    def ac():
        return [rng.randrange(-9, 10) if rng.random() < 0.1 else 0 for _ in range(63)]

    table = b"\x10" + b"".join((q if i == 0 else 9).to_bytes(2, "big") for i in range(64)) if wide else b"\x00" + bytes([q, *[9] * 63])
    out = b"\xff\xd8" + segment(0xFE, b"a comment") + segment(0xDB, table)
    out += segment(0xC0, b"\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(sampling)]) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(sampling)))
    out += segment(0xC4, b"\x00" + DC_TABLE + b"\x10" + AC_TABLE)
    if interval:
        out += segment(0xDD, interval.to_bytes(2, "big"))
    scans = [[i] for i in range(len(sampling))] if separate else [list(range(len(sampling)))]
    for scan in scans:
        out += segment(0xDA, bytes([len(scan)]) + b"".join(bytes([i + 1, 0]) for i in scan) + b"\x00\x3f\x00")
        units = []
        if len(scan) == 1:
            i = scan[0]
            h, v = sampling[i]
            w, t = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
            units = [[(i, y, x)] for y in range(t) for x in range(w)]
        else:
            units = [[(i, my * sampling[i][1] + y, mx * sampling[i][0] + x) for i in scan for y in range(sampling[i][1]) for x in range(sampling[i][0])] for my in range(mcus_y) for mx in range(mcus_x)]
        each = interval or len(units)
        for n, start in enumerate(range(0, len(units), each)):
            if n:
                out += bytes([0xFF, 0xD0 + (n - 1) % 8])
            bits, before = Bits(), [0] * len(sampling)
            for unit in units[start : start + each]:
                for i, y, x in unit:
                    bits.block(int(dc[i][y, x]) - before[i], ac())
                    before[i] = int(dc[i][y, x])
            out += bits.bytes()
    h, v = sampling[0]
    w, t = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
    return out + b"\xff\xd9", dc[0][:t, :w], q


def pixels(dc, q):
    """The mean of a block by the inverse transform of its DC coefficient alone."""
    return np.clip(np.floor(dc * q / 8 + 128 + 0.5), 0, 255).astype(np.uint8)


FORMS = [
    dict(width=40, height=24, sampling=[(1, 1)]),
    dict(width=33, height=17, sampling=[(1, 1)] * 3),
    dict(width=50, height=70, sampling=[(2, 2), (1, 1), (1, 1)]),
    dict(width=50, height=30, sampling=[(2, 1), (1, 1), (1, 1)]),
    dict(width=31, height=45, sampling=[(1, 2), (1, 1), (1, 1)]),
    dict(width=70, height=41, sampling=[(4, 1), (1, 1), (1, 1)]),
    dict(width=41, height=41, sampling=[(1, 1), (2, 2), (1, 1)]),
    dict(width=24, height=24, sampling=[(1, 1)] * 4),
    dict(width=50, height=70, sampling=[(2, 2), (1, 1), (1, 1)], separate=True),
    dict(width=47, height=29, sampling=[(2, 1), (1, 1), (1, 1)], separate=True, interval=5),
    dict(width=64, height=64, sampling=[(2, 2), (1, 1), (1, 1)], interval=3),
    dict(width=40, height=40, sampling=[(1, 1)], wide=True, q=300),
    dict(width=1, height=1, sampling=[(2, 2), (1, 1), (1, 1)]),
]


@pytest.mark.parametrize("form", range(len(FORMS)))
def test_thumbnail_of_every_form(form):
    data, dc, q = make(**FORMS[form], seed=form)
    frame = media.parse(data)
    got, bad = media.decode_lanes(frame.lanes, np.array([media.blocks_of(frame)[0]]))
    assert not bad.any()
    assert np.array_equal(media.thumbnail(frame, got[0]), pixels(dc, q))


def test_all_forms_in_one_batch():
    made = [make(**f, seed=i) for i, f in enumerate(FORMS)]
    together = media.decode_all([m[0] for m in made])
    assert together == [media.decode_all([m[0]])[0] for m in made]
    for row, f, (_, dc, _) in zip(together, FORMS, made, strict=True):
        assert row[:6] == ("ok", f["width"], f["height"], len(f["sampling"]), dc.shape[1], dc.shape[0])
    assert len({r[6] for r in together}) == len(FORMS)


def test_cut_and_spoilt_files_have_a_status():
    data, _, _ = make(50, 30, [(2, 1), (1, 1), (1, 1)], seed=4)
    assert {media.decode_all([data[:n]])[0][0] for n in range(2, len(data) - 2, 7)} <= {"truncated", "corrupt"}
    rng = random.Random(1)
    for _ in range(200):
        spoilt = bytearray(data)
        spoilt[rng.randrange(2, len(data))] ^= 1 << rng.randrange(8)
        assert media.decode_all([bytes(spoilt), data])[1][0] == "ok"


def test_clashing_columns_and_a_long_page(spark):
    rows = [(1, "x" * 1_500_000, b"a", "k", "i"), (2, None, b"b", "k", "i"), (None, "<p>", b"c", "k", "i"), (2, "", b"d", "k", "i")]
    df = spark.createDataFrame(rows, "page_id bigint, html string, image binary, k string, status string")
    out = media.page_media(df).collect()
    assert sorted((r["page_id"] or 0, r["status"]) for r in out) == [(0, "ok"), (1, "ok"), (2, "null"), (2, "ok")]
    # a pixel a byte, eight by eight of them a pixel of the thumbnail
    long = next(r for r in out if r["page_id"] == 1)
    assert long["width"] * long["height"] >= 1_500_000 and long["thumb_width"] == -(-long["width"] // 8)
