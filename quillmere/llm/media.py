"""Media columns: baseline JPEG to dimensions, DC-only luminance thumbnails, and thumbnail hashes.

Markers are parsed in Python.  Entropy-coded data is cut at restart markers into *lanes*; all lanes of a batch of images are Huffman-decoded in
step by numpy: each step looks one code up for every lane, in a table of 65,536 entries by 16 bits of look-ahead, and moves the lane's bit
position past the code and its value.  AC coefficients are skipped; a luminance block's DC coefficient gives one pixel of the
thumbnail, ``DC * quantiser / 8 + 128``: the mean of the block, without any inverse transform.

Grey and colour, any sampling, interleaved and separate scans, restart intervals, 8- and 16-bit quantisers are read.

Defined results (``status``): ``null`` for a null value, ``empty`` for no bytes, ``not_jpeg`` without a start marker, ``unsupported`` for progressive, lossless,
arithmetic or 12-bit files, ``truncated`` when headers or blocks end early, ``corrupt`` for impossible codes, tables or numbers.  All but ``ok`` have null
hashes, and null dimensions unless the frame header was read.  Null ids stay null; repeated rows get equal results; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.llm import common as C

#: Bytes of images that are decoded together; a larger image comes alone.
GROUP_BYTES, GROUP_TABLES = 2 << 20, 192


class Bad(Exception):
    """Status of an image that can't be decoded."""


@dataclass
class Component:
    h: int
    v: int
    quantiser: int
    q: int = 0


@dataclass
class Lane:
    data: bytes
    blocks: int
    pattern: list[tuple[int, bytes, bytes]]
    image: int
    first: int


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    lanes: list[Lane] = field(default_factory=list)
    luma_seen: bool = False
    across: int = 0
    per_mcu: tuple[int, int] = (1, 1)


def parse(data: bytes, image: int = 0) -> Frame:
    """Markers -> frame, and lanes of entropy-coded data."""
    frame = Frame()
    _parse(data, frame, image)
    return frame


def _parse(data: bytes, frame: Frame, image: int) -> None:
    if not data:
        raise Bad("empty")
    if data[:2] != b"\xff\xd8":
        raise Bad("not_jpeg")
    at, n, quantisers, tables, interval = 2, len(data), {}, {}, 0
    while True:
        if at >= n:
            raise Bad("truncated")
        if data[at] != 0xFF:
            raise Bad("corrupt")
        while at < n and data[at] == 0xFF:
            at += 1
        if at >= n:
            raise Bad("truncated")
        marker = data[at]
        at += 1
        if marker == 0xD9:
            break
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            continue
        if at + 2 > n:
            raise Bad("truncated")
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2:
            raise Bad("corrupt")
        body, at = data[at + 2 : at + size], at + size
        if at > n:
            raise Bad("truncated")
        try:
            if marker == 0xDB:
                _quantisers(body, quantisers)
            elif marker == 0xC4:
                _tables(body, tables)
            elif marker == 0xDD:
                interval = int.from_bytes(body[:2], "big")
            elif marker in (0xC0, 0xC1):
                if body[0] != 8:
                    raise Bad("unsupported")
                if frame.components:
                    raise Bad("corrupt")
                frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                for i in range(body[5]):
                    c = body[6 + 3 * i : 9 + 3 * i]
                    frame.components[c[0]] = Component(c[1] >> 4, c[1] & 15, c[2])
                if not frame.width or not frame.height or not frame.components or any(not 1 <= x <= 4 for c in frame.components.values() for x in (c.h, c.v)):
                    raise Bad("corrupt")
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
                raise Bad("unsupported")
            elif marker == 0xDA:
                at = _scan(data, body, at, frame, quantisers, tables, interval, image)
        except IndexError:
            raise Bad("corrupt") from None
    if not frame.luma_seen:
        raise Bad("truncated")


def _quantisers(body: bytes, out: dict[int, int]) -> None:
    at = 0
    while at < len(body):
        wide = body[at] >> 4
        out[body[at] & 15] = int.from_bytes(body[at + 1 : at + 3], "big") if wide else body[at + 1]
        at += 1 + 64 * (2 if wide else 1)


def _tables(body: bytes, out: dict[int, bytes]) -> None:
    at = 0
    while at < len(body):
        count = sum(body[at + 1 : at + 17])
        if at + 17 + count > len(body):
            raise Bad("corrupt")
        out[body[at]] = bytes(body[at + 1 : at + 17 + count])
        at += 17 + count


def _scan(data, body, at, frame, quantisers, tables, interval, image) -> int:
    if not frame.components:
        raise Bad("corrupt")
    picked = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
    ids = list(frame.components)
    hmax, vmax = max(c.h for c in frame.components.values()), max(c.v for c in frame.components.values())
    pattern: list[tuple[int, bytes, bytes]] = []
    for cid, t in picked:
        c = frame.components.get(cid)
        dc, ac = tables.get(t >> 4), tables.get(0x10 | t & 15)
        if c is None or dc is None or ac is None:
            raise Bad("corrupt")
        pattern += [(ids.index(cid), dc, ac)] * (c.h * c.v if len(picked) > 1 else 1)
    if len(picked) == 1:
        c = frame.components[picked[0][0]]
        across = -(-(-(-frame.width * c.h // hmax)) // 8)
        down = -(-(-(-frame.height * c.v // vmax)) // 8)
    else:
        across, down = -(-frame.width // (8 * hmax)), -(-frame.height // (8 * vmax))
    luma = any(cid == ids[0] for cid, _ in picked)
    if luma:
        c = frame.components[ids[0]]
        if c.quantiser not in quantisers:
            raise Bad("corrupt")
        c.q = quantisers[c.quantiser]
        frame.luma_seen, frame.across, frame.per_mcu = True, across, (c.h, c.v) if len(picked) > 1 else (1, 1)
    mcus = across * down
    each = interval or mcus
    per = sum(1 for p in pattern if p[0] == 0)
    done, start = 0, at
    while True:
        # the end of this lane: a marker that isn't a stuffed byte
        end = at
        while True:
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                end = len(data)
                break
            if data[end + 1] == 0x00:
                end += 2
                continue
            if data[end + 1] == 0xFF:
                end += 1
                continue
            break
        count = min(each, mcus - done)
        if luma and count > 0:
            frame.lanes.append(Lane(data[at:end].replace(b"\xff\x00", b"\xff"), count * len(pattern), pattern, image, done * per))
        done += max(count, 0)
        if end + 1 < len(data) and 0xD0 <= data[end + 1] <= 0xD7:
            at = end + 2
            continue
        if done < mcus or (end >= len(data) and start == end):
            raise Bad("truncated")
        return end


def lookup(table: bytes) -> np.ndarray:
    """16 bits of look-ahead -> code length << 8 | symbol; 0 where there is no code."""
    out, code, at = np.zeros(1 << 16, np.uint16), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            if code >= 1 << length:
                raise Bad("corrupt")
            out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def decode_lanes(lanes: list[Lane], sizes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(DC values of the luminance blocks of every image in scan order, status of every image: 0 ok, 1 truncated, 2 corrupt)."""
    status = np.zeros(len(sizes), np.int8)
    offset = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out = np.zeros(offset[-1], np.int64)
    if not lanes:
        return [out[a:b] for a, b in zip(offset[:-1], offset[1:], strict=True)], status
    names: dict[bytes, int] = {}
    luts: list[np.ndarray] = []
    patterns: dict[tuple, int] = {}
    kinds: list[tuple[int, int, int]] = []

    def number(table: bytes) -> int:
        if table not in names:
            names[table] = len(luts)
            try:
                luts.append(lookup(table))
            except Bad:
                luts.append(np.zeros(1 << 16, np.uint16))
        return names[table]

    begins = []
    for lane in lanes:
        key = tuple(lane.pattern)
        if key not in patterns:
            patterns[key] = len(kinds)
            kinds.extend((c, number(dc), number(ac)) for c, dc, ac in lane.pattern)
        begins.append(patterns[key])
    lut = np.stack(luts)
    comp, dc_of, ac_of = (np.array(x, np.int64) for x in zip(*kinds, strict=True))
    length = np.array([len(x.data) for x in lanes], np.int64)
    # eight bytes of ones after every lane: padding of the last byte is ones too
    starts = np.concatenate([[0], np.cumsum(length + 8)])[:-1]
    data = np.frombuffer(b"".join(x.data + b"\xff" * 8 for x in lanes), np.uint8).astype(np.int64)
    window = (data[:-4] << 32) | (data[1:-3] << 24) | (data[2:-2] << 16) | (data[3:-1] << 8) | data[4:]
    pos, end = starts * 8, (starts + length) * 8
    left = np.array([x.blocks for x in lanes], np.int64)
    base, size = np.array(begins, np.int64), np.array([len(x.pattern) for x in lanes], np.int64)
    image = np.array([x.image for x in lanes], np.int64)
    to = offset[image] + np.array([x.first for x in lanes], np.int64)
    phase, k = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
    pred = np.zeros((len(lanes), 4 + int(comp.max())), np.int64)
    table = dc_of[base]
    live = np.arange(len(lanes))
    while len(live):
        p = pos[live]
        top = (window[p >> 3] << (p & 7)) & ((1 << 40) - 1)
        hit = lut[table[live], top >> 24].astype(np.int64)
        code, symbol = hit >> 8, hit & 255
        first = k[live] == 0
        bits = np.where(first, np.minimum(symbol, 15), symbol & 15)
        value = (top >> (40 - code - bits)) & ((1 << bits) - 1)
        pos[live] = p + code + bits
        wrong = (code == 0) | (first & (symbol > 15))
        late = pos[live] > end[live]
        # DC: add the difference to the component's prediction
        d = np.flatnonzero(first)
        if len(d):
            lane = live[d]
            v, b = value[d], bits[d]
            v = np.where((b > 0) & (v < (1 << np.maximum(b - 1, 0))), v - (1 << b) + 1, v)
            c = comp[base[lane] + phase[lane]]
            pred[lane, c] += v
            own = (c == 0) & ~wrong[d] & ~late[d]
            out[to[lane[own]]] = pred[lane[own], 0]
            to[lane[own]] += 1
            k[lane] = 1
            table[lane] = ac_of[base[lane] + phase[lane]]
        a = np.flatnonzero(~first)
        if len(a):
            lane, s = live[a], symbol[a]
            k[lane] += np.where(s & 15, (s >> 4) + 1, np.where(s == 0xF0, 16, 64))
            wrong[a] |= (k[lane] > 64) & ((s & 15) > 0)
            over = lane[k[lane] >= 64]
            left[over] -= 1
            k[over] = 0
            phase[over] = (phase[over] + 1) % size[over]
            table[over] = dc_of[base[over] + phase[over]]
        ended = left[live] == 0
        broken = wrong | late
        if broken.any():
            bad = live[broken]
            np.maximum.at(status, image[bad], np.where(late[broken], 1, 2).astype(np.int8))
        if ended.any() or broken.any():
            live = live[~(ended | broken)]
    return [out[a:b] for a, b in zip(offset[:-1], offset[1:], strict=True)], status


def blocks_of(frame: Frame) -> tuple[int, int, int]:
    """(luminance blocks in scan order, thumbnail width, thumbnail height)."""
    hmax, vmax = max(c.h for c in frame.components.values()), max(c.v for c in frame.components.values())
    c = next(iter(frame.components.values()))
    w, h = -(-(-(-frame.width * c.h // hmax)) // 8), -(-(-(-frame.height * c.v // vmax)) // 8)
    per = frame.per_mcu[0] * frame.per_mcu[1]
    rows = h if per == 1 and frame.per_mcu == (1, 1) and frame.across == w else -(-frame.height // (8 * vmax))
    return frame.across * rows * per, w, h


def thumbnail(frame: Frame, dc: np.ndarray) -> np.ndarray:
    """(height, width) uint8 means of the luminance blocks."""
    _, w, h = blocks_of(frame)
    ph, pv = frame.per_mcu
    grid = dc.reshape(-1, frame.across, pv, ph).transpose(0, 2, 1, 3).reshape(-1, frame.across * ph)[:h, :w]
    q = next(iter(frame.components.values())).q
    return np.clip((grid * q + 1024 + 4) >> 3, 0, 255).astype(np.uint8)


def difference_hash(pixels: np.ndarray) -> int:
    """64 bits: whether each of 8 x 9 area means is less than the next in its row."""
    h, w = pixels.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = pixels.astype(np.float64).cumsum(0).cumsum(1)
    y0, x0 = np.arange(8) * h // 8, np.arange(9) * w // 9
    y1, x1 = np.maximum(y0 + 1, (np.arange(8) + 1) * h // 8), np.maximum(x0 + 1, (np.arange(9) + 1) * w // 9)
    area = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    mean = area / ((y1 - y0)[:, None] * (x1 - x0))
    bits = (mean[:, 1:] > mean[:, :-1]).ravel()
    return int(np.packbits(bits).view(">i8")[0])


def decode_all(images: list[bytes | None]) -> list[tuple]:
    """(status, width, height, components, thumb_width, thumb_height, thumb_hash, difference hash) of every image."""
    out: list[tuple | None] = [None] * len(images)
    group: list[tuple[int, Frame]] = []
    weight, tables = 0, set()

    def flush() -> None:
        nonlocal weight, tables
        sizes = np.array([blocks_of(f)[0] for _, f in group], np.int64)
        dcs, status = decode_lanes([x for _, f in group for x in f.lanes], sizes)
        for (i, f), dc, bad in zip(group, dcs, status.tolist(), strict=True):
            _, w, h = blocks_of(f)
            if bad:
                out[i] = ("truncated" if bad == 1 else "corrupt", f.width, f.height, len(f.components), None, None, None, None)
                continue
            pixels = thumbnail(f, dc)
            digest = hashlib.md5(f"{w}x{h}:".encode() + pixels.tobytes(), usedforsecurity=False).hexdigest()
            out[i] = ("ok", f.width, f.height, len(f.components), w, h, digest, difference_hash(pixels))
        group.clear()
        weight, tables = 0, set()

    for i, data in enumerate(images):
        frame = Frame()
        try:
            if data is None:
                raise Bad("null")
            _parse(data, frame, len(group))
            if blocks_of(frame)[0] > 64 * max(len(data), 16):  # a block takes at least two bits
                raise Bad("truncated")
        except Bad as e:
            known = frame.width > 0 and bool(frame.components)
            out[i] = (str(e), frame.width if known else None, frame.height if known else None, len(frame.components) if known else None, None, None, None, None)
            continue
        group.append((i, frame))
        weight += len(data)
        tables |= {t for lane in frame.lanes[:1] for p in lane.pattern for t in p[1:]}
        if weight >= GROUP_BYTES or len(tables) >= GROUP_TABLES:
            flush()
    if group:
        flush()
    return out


FIELDS = "status string, width int, height int, components int, thumb_width int, thumb_height int, thumb_hash string, dhash bigint"


def read_images(df: DataFrame, id_column: str, image_column: str = "image") -> DataFrame:
    """(id, status, width, height, components, thumb_width, thumb_height, thumb_hash, dhash) of every row of a binary column."""
    C.settle(df.sparkSession)
    rows = C.pick(df, k=id_column, image=image_column)
    kinds = [pa.string(), *[pa.int32()] * 5, pa.string(), pa.int64()]

    def run(batches):
        for batch in batches:
            found = list(zip(*decode_all(batch.column(1).to_pylist()), strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(x), t) for x, t in zip(found, kinds, strict=True)]], names=["k", *[f.split()[0] for f in FIELDS.split(", ")]])

    return rows.mapInArrow(C.lean(run), f"k {rows.schema['k'].dataType.simpleString()}, {FIELDS}").withColumnRenamed("k", id_column)


# ------------------------------------------------------------------------------------------------ a media column to read


def _standard(counts: list[int], symbols: list[int]) -> bytes:
    return bytes(counts) + bytes(symbols)


#: Tables K.3 and K.5 of the JPEG standard (luminance).
DC_TABLE = _standard([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
AC_TABLE = _standard(
    [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
    list(bytes.fromhex("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa")),
)
ZIGZAG = np.array([r * 8 + c for s in range(15) for r, c in (lambda d: d if s % 2 else d[::-1])([(i, s - i) for i in range(8) if 0 <= s - i < 8])])
_QUANTISER = np.full(64, 40, np.int64)
_QUANTISER[:3] = 16
_DCT = np.array([[np.sqrt((1 if u == 0 else 2) / 8) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])


def codes_of(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol -> (code, length)."""
    codes, lengths, code, at = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            codes[table[at]], lengths[table[at]] = code, length
            code, at = code + 1, at + 1
        code <<= 1
    return codes, lengths


_DC, _AC = codes_of(DC_TABLE), codes_of(AC_TABLE)


def encode_grey(pixels: list[np.ndarray]) -> list[bytes]:
    """Baseline grey JPEGs, a restart interval for every row of blocks; all images at once."""
    grids = [np.pad(p, ((0, -p.shape[0] % 8), (0, -p.shape[1] % 8)), mode="edge") for p in pixels]
    blocks = np.concatenate([g.reshape(g.shape[0] // 8, 8, g.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 8, 8) for g in grids]).astype(np.float64) - 128
    q = np.rint((_DCT @ blocks @ _DCT.T).reshape(-1, 64)[:, ZIGZAG] / _QUANTISER).astype(np.int64)
    width = np.concatenate([np.full(g.shape[0] // 8, g.shape[1] // 8) for g in grids])
    row_start = np.concatenate([[0], np.cumsum(width)])
    row = np.repeat(np.arange(len(width)), width)
    diff = q[:, 0].copy()
    diff[1:] -= q[:-1, 0]
    diff[row_start[:-1]] = q[row_start[:-1], 0]

    def bits(v):
        size = np.ceil(np.log2(np.abs(v) + 1)).astype(np.int64)
        return size, np.where(v < 0, v + (1 << size) - 1, v)

    size, low = bits(diff)
    parts = [(np.arange(len(q)) * 512, _DC[0][size] << size | low, _DC[1][size] + size)]
    b, k = np.nonzero(q[:, 1:])
    k = k + 1
    before = np.where(np.concatenate([[True], b[1:] != b[:-1]]), 0, np.concatenate([[0], k[:-1]])) if len(b) else k
    run = k - before - 1
    size, low = bits(q[b, k])
    symbol = (run % 16) << 4 | size
    parts.append((b * 512 + k * 4 + 3, _AC[0][symbol] << size | low, _AC[1][symbol] + size))
    for z in range(1, 4):
        more = np.flatnonzero(run // 16 >= z)
        parts.append((b[more] * 512 + k[more] * 4 + z - 1, np.full(len(more), _AC[0][0xF0]), np.full(len(more), _AC[1][0xF0])))
    open_end = np.flatnonzero(q[:, 63] == 0)
    parts.append((open_end * 512 + 511, np.full(len(open_end), _AC[0][0]), np.full(len(open_end), _AC[1][0])))
    order = np.argsort(np.concatenate([p[0] for p in parts]), kind="stable")
    at, code, length = (np.concatenate([p[i] for p in parts])[order] for i in range(3))
    owner = row[at // 512]
    used = np.bincount(owner, weights=length, minlength=len(width)).astype(np.int64)
    nbytes = -(-used // 8)
    start_bit = np.concatenate([[0], np.cumsum(nbytes * 8)])
    inside = np.cumsum(length) - length
    first = np.searchsorted(owner, np.arange(len(width)))
    where = start_bit[owner] + inside - inside[first][owner]
    stream = np.ones(start_bit[-1], np.uint8)
    spot = np.repeat(where, length) + (np.arange(length.sum()) - np.repeat(inside, length))
    shift = np.repeat(length, length) - 1 - (np.arange(length.sum()) - np.repeat(inside, length))
    stream[spot] = (np.repeat(code, length) >> shift) & 1
    packed = np.packbits(stream).tobytes()
    out, r = [], 0
    for p, g in zip(pixels, grids, strict=True):
        rows, across = g.shape[0] // 8, g.shape[1] // 8
        scan = b"".join(packed[start_bit[r + i] // 8 : start_bit[r + i + 1] // 8].replace(b"\xff", b"\xff\x00") + (bytes((0xFF, 0xD0 + i % 8)) if i + 1 < rows else b"") for i in range(rows))
        r += rows
        out.append(
            b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes(_QUANTISER.tolist()) + b"\xff\xc0\x00\x0b\x08" + p.shape[0].to_bytes(2, "big") + p.shape[1].to_bytes(2, "big") + b"\x01\x01\x11\x00"
            + b"\xff\xc4" + (3 + len(DC_TABLE)).to_bytes(2, "big") + b"\x00" + DC_TABLE + b"\xff\xc4" + (3 + len(AC_TABLE)).to_bytes(2, "big") + b"\x10" + AC_TABLE
            + b"\xff\xdd\x00\x04" + across.to_bytes(2, "big") + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + scan + b"\xff\xd9"
        )
    return out


WIDTH = 128
MAX_SIDE = 65_535


def raster(data: bytes) -> np.ndarray:
    """All bytes of a page as grey pixels, row by row; wide enough that a very long page keeps to the greatest height of a JPEG."""
    width = max(WIDTH, -(-len(data) // (MAX_SIDE * 8)) * 8)
    flat = np.zeros(-(-max(len(data), 1) // width) * width, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return flat.reshape(-1, width)


def rendered(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(id, image): every page drawn as a picture of its bytes, so that there is a media column to read; a null html has a null image."""
    C.settle(pages.sparkSession)
    rows = C.pick(pages, k=id_column, html=html_column)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            images: list[bytes | None] = [None] * len(texts)
            group, weight = [], 0
            for i, t in enumerate(texts):
                if t is not None:
                    data = t.encode()
                    group.append((i, raster(data)))
                    weight += len(data)
                if group and (weight > 1 << 18 or i + 1 == len(texts)):
                    for (j, _), made in zip(group, encode_grey([p for _, p in group]), strict=True):
                        images[j] = made
                    group, weight = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], names=["k", "image"])

    return rows.mapInArrow(C.lean(run), f"k {rows.schema['k'].dataType.simpleString()}, image binary").withColumnRenamed("k", id_column)


def page_media(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """The columns of ``read_images`` for the picture of every page."""
    return read_images(rendered(pages, id_column, html_column), id_column)
