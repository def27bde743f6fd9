"""Progressive JPEG media columns: bytes in, coefficient arrays, RGB tensors.

``decode`` accumulates the scans of a progressive file (spectral selection, successive
approximation, end-of-band runs, restart intervals) into one coefficient array per component;
``to_rgb`` dequantises, inverts the transform, upsamples chroma and converts to RGB.

``encode`` stores a payload without loss in the format's own unit, the quantised coefficient:
a payload byte is one AC coefficient, its top bit the sign and 128 plus its low bits the
magnitude, 63 to a block. The first scans of a band then have a one-bit code and seven bits for
every coefficient, and the refinement one bit each inside long end-of-band runs, so both ways
run at array speed; the decoder tests for these patterns and otherwise reads symbol by symbol.
The DC coefficient is the parity of its block, as a check.

The transform uses integer-valued matrices in double precision: all sums are exact, so a
document's tensor doesn't depend on its neighbours in a batch.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_key, map_arrow

_COM = b"payload "
#: Bands of the first AC scans, by component.
_BANDS = (((1, 5), (6, 63)), ((1, 63),), ((1, 63),))
_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")
#: Blocks in an end-of-band run: below 2**15, and a multiple of 8, which keeps bytes aligned.
_RUN = 32760


def _zigzag() -> np.ndarray:
    """Natural position (8 * row + column) of each coefficient in scan order."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


_ZIGZAG = _zigzag()
_SCALE = 12


def _basis() -> np.ndarray:
    """The inverse transform's matrix in fixed point: sample x from frequency u."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.round(np.where(u == 0, np.sqrt(0.125), 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) * 2**_SCALE)


_BASIS = _basis()


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    rows: int = 0  # blocks, padded to whole MCUs
    columns: int = 0
    used_rows: int = 0  # blocks that scans of this component alone have
    used_columns: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int32))


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quantisers: dict[int, np.ndarray]
    comment: bytes = b""


class _Bits:
    """Bits of an entropy-coded segment without its stuffing."""

    def __init__(self, data: bytes):
        self.data, self.at, self.size = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if n == 0:
            return 0
        if self.at + n > self.size:
            raise ValueError("the entropy-coded segment ends early")
        lo, hi = self.at >> 3, (self.at + n + 7) >> 3
        word = int.from_bytes(self.data[lo:hi], "big") >> (8 * hi - self.at - n)
        self.at += n
        return word & ((1 << n) - 1)

    def many(self, n: int) -> np.ndarray:
        if self.at + n > self.size:
            raise ValueError("the entropy-coded segment ends early")
        lo, hi = self.at >> 3, (self.at + n + 7) >> 3
        out = np.unpackbits(np.frombuffer(self.data, np.uint8, hi - lo, lo))[self.at - 8 * lo :][:n]
        self.at += n
        return out


class _Huffman:
    def __init__(self, counts: bytes, symbols: bytes):
        self.codes: dict[tuple[int, int], int] = {}
        self.of: dict[int, tuple[int, int]] = {}
        code = k = 0
        for length in range(1, 17):
            for _ in range(counts[length - 1]):
                self.codes[length, code] = symbols[k]
                self.of[symbols[k]] = (length, code)
                code, k = code + 1, k + 1
            code <<= 1

    def read(self, bits: _Bits) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | bits.read(1)
            symbol = self.codes.get((length, code))
            if symbol is not None:
                return symbol
        raise ValueError("no such Huffman code")


def _extend(value: int, size: int) -> int:
    return value if size == 0 or value >> (size - 1) else value - (1 << size) + 1


@dataclass
class _Scan:
    components: list[Component]
    dc: list[_Huffman | None]
    ac: _Huffman | None
    start: int
    end: int
    high: int
    low: int


def _block_order(image: Image, scan: _Scan) -> list[tuple[Component, np.ndarray]] | np.ndarray:
    """Block numbers of a scan of one component, in order."""
    c = scan.components[0]
    return (np.arange(c.used_rows)[:, None] * c.columns + np.arange(c.used_columns)[None, :]).ravel()


def _interleaved(image: Image, scan: _Scan) -> tuple[np.ndarray, np.ndarray, int]:
    """(place in scan.components, block number, blocks of an MCU), in order."""
    if len(scan.components) == 1:
        order = _block_order(image, scan)
        return np.zeros(len(order), np.int64), order, 1
    who, where = [], []
    for i, c in enumerate(scan.components):
        grid = np.arange(c.rows * c.columns).reshape(c.rows // c.v, c.v, c.columns // c.h, c.h)
        cells = grid.transpose(0, 2, 1, 3).reshape(-1, c.v * c.h)
        where.append(cells)
        who.append(np.full(cells.shape, i))
    blocks = np.concatenate(where, axis=1)
    return np.concatenate(who, axis=1).ravel(), blocks.ravel(), blocks.shape[1]


def _dc(scan: _Scan, bits: _Bits, who: np.ndarray, where: np.ndarray) -> None:
    if scan.high:
        found = bits.many(len(where)).astype(np.int32) << scan.low
        for i, c in enumerate(scan.components):
            mine = who == i
            c.coefficients[where[mine], 0] |= found[mine]
        return
    table = scan.dc[0]
    if table.of.get(0) == (1, 0) and all(t is table for t in scan.dc):
        # runs of blocks without a difference
        ahead = bits.many(min(len(where), bits.size - bits.at))
        if len(ahead) == len(where) and not ahead.any():
            return
        bits.at -= len(ahead)
    last = [0] * len(scan.components)
    for i, block in zip(who.tolist(), where.tolist()):
        size = scan.dc[i].read(bits)
        last[i] += _extend(bits.read(size), size)
        scan.components[i].coefficients[block, 0] = last[i] << scan.low


def _ac_first(scan: _Scan, bits: _Bits, where: np.ndarray) -> None:
    c, table = scan.components[0].coefficients, scan.ac
    width, n = scan.end - scan.start + 1, len(where)
    for symbol, (length, code) in table.of.items():
        # one symbol without a run before every coefficient, a byte long with its bits
        size = symbol & 15
        if symbol >> 4 == 0 and size and length + size == 8 and bits.at % 8 == 0 and bits.size - bits.at >= 8 * width * n:
            body = np.frombuffer(bits.data, np.uint8, width * n, bits.at // 8).astype(np.int32)
            if (body >> size == code).all():
                body &= (1 << size) - 1
                body = np.where(body >> (size - 1), body, body - (1 << size) + 1) << scan.low
                c[where, scan.start : scan.end + 1] = body.reshape(n, width)
                bits.at += 8 * width * n
                return
    run = 0
    for block in where.tolist():
        if run:
            run -= 1
            continue
        k = scan.start
        while k <= scan.end:
            symbol = table.read(bits)
            skip, size = symbol >> 4, symbol & 15
            if size:
                k += skip
                c[block, k] = _extend(bits.read(size), size) << scan.low
                k += 1
            elif skip == 15:
                k += 16
            else:
                run = (1 << skip) + bits.read(skip) - 1
                break


def _refine(c: np.ndarray, blocks: np.ndarray, start: int, end: int, low: int, bits: _Bits) -> None:
    """A correction bit for every coefficient of the band that is not zero, in order."""
    part = c[blocks, start : end + 1]
    old = part != 0
    found = bits.many(int(np.count_nonzero(old)))
    part[old] += np.where(found, np.sign(part[old]) << low, 0).astype(np.int32)
    c[blocks, start : end + 1] = part


def _ac_refine(scan: _Scan, bits: _Bits, where: np.ndarray) -> None:
    c, table, one = scan.components[0].coefficients, scan.ac, 1 << scan.low
    at, n = 0, len(where)
    while at < n:
        block, k = where[at], scan.start
        while k <= scan.end:
            symbol = table.read(bits)
            skip, size = symbol >> 4, symbol & 15
            if size == 0 and skip < 15:
                run = (1 << skip) + bits.read(skip)
                _refine(c, where[at : at + 1], k, scan.end, scan.low, bits)
                if run > 1:
                    _refine(c, where[at + 1 : at + run], scan.start, scan.end, scan.low, bits)
                at += run - 1
                break
            value = (one if bits.read(1) else -one) if size else 0
            # pass ``skip`` zeros, correcting what is between them
            while k <= scan.end:
                if c[block, k]:
                    if bits.read(1):
                        c[block, k] += one if c[block, k] > 0 else -one
                elif skip == 0:
                    break
                else:
                    skip -= 1
                k += 1
            if size and k <= scan.end:
                c[block, k] = value
            k += 1
        at += 1


def decode(data: bytes) -> Image:
    """Coefficients (in scan order, not dequantised) of a progressive Huffman-coded file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, image, tables, restart = 2, Image(0, 0, [], {}), {}, 0
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker was expected")
        kind = data[at + 1]
        if kind == 0xD9:
            return image
        if kind == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body, ">u2" if wide else "u1", 64, 1)
                image.quantisers[body[0] & 15] = values.astype(np.int32)
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif kind == 0xFE:
            image.comment = body
        elif kind == 0xC2:
            image.height, image.width = struct.unpack_from(">HH", body, 1)
            for i in range(body[5]):
                a, b, q = body[6 + 3 * i : 9 + 3 * i]
                image.components.append(Component(a, b >> 4, b & 15, q))
            hs, vs = max(c.h for c in image.components), max(c.v for c in image.components)
            across, down = -(-image.width // (8 * hs)), -(-image.height // (8 * vs))
            for c in image.components:
                c.rows, c.columns = down * c.v, across * c.h
                c.used_rows = -(-(-(-image.height * c.v // vs)) // 8)
                c.used_columns = -(-(-(-image.width * c.h // hs)) // 8)
                c.coefficients = np.zeros((c.rows * c.columns, 64), np.int32)
        elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xD0)):
            raise ValueError("only progressive Huffman-coded files are read")
        elif kind == 0xDA:
            chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            start, end, both = body[1 + 2 * body[0] :][:3]
            by_id = {c.id: c for c in image.components}
            scan = _Scan(
                [by_id[i] for i, _ in chosen],
                [tables.get(t >> 4) for _, t in chosen],
                tables.get(0x10 | chosen[0][1] & 15),
                start,
                end,
                both >> 4,
                both & 15,
            )
            stop = _MARKER.search(data, at)
            if stop is None:
                raise ValueError("the file ends within a scan")
            _read_scan(image, scan, data[at : stop.start()], restart)
            at = stop.start()


def _read_scan(image: Image, scan: _Scan, body: bytes, restart: int) -> None:
    who, where, unit = _interleaved(image, scan)
    parts = re.split(rb"\xff[\xd0-\xd7]", body) if restart else [body]
    step = restart * unit if restart else len(where)
    for i, part in enumerate(parts):
        bits = _Bits(part.replace(b"\xff\x00", b"\xff"))
        now = slice(i * step, (i + 1) * step)
        if scan.start == 0:
            _dc(scan, bits, who[now], where[now])
        elif scan.high == 0:
            _ac_first(scan, bits, where[now])
        else:
            _ac_refine(scan, bits, where[now])


def planes(image: Image) -> list[np.ndarray]:
    """Each component's samples around 0, dequantised and transformed back, in blocks' grid."""
    out = []
    for c in image.components:
        natural = np.empty((len(c.coefficients), 64))
        natural[:, _ZIGZAG] = c.coefficients * image.quantisers[c.table]
        half = natural.reshape(-1, 8) @ _BASIS.T  # over columns
        half = half.reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8) @ _BASIS.T
        whole = np.floor(half * 2.0 ** (-2 * _SCALE) + 0.5).astype(np.int32)
        # axes now: block, column, row
        out.append(whole.reshape(c.rows, c.columns, 8, 8).transpose(0, 3, 1, 2).reshape(8 * c.rows, 8 * c.columns))
    return out


def to_rgb(image: Image) -> np.ndarray:
    """The full-resolution RGB tensor, (height, width, 3) of bytes; grey has equal channels."""
    hs, vs = max(c.h for c in image.components), max(c.v for c in image.components)
    full = []
    for c, plane in zip(image.components, planes(image)):
        if vs != c.v:
            plane = np.repeat(plane, vs // c.v, axis=0)
        if hs != c.h:
            plane = np.repeat(plane, hs // c.h, axis=1)
        full.append(plane[: image.height, : image.width])
    out = np.empty((image.height, image.width, 3), np.uint8)
    y = full[0] + 128
    if len(full) < 3:
        out[:] = np.clip(y, 0, 255)[:, :, None]
        return out
    cb, cr = full[1], full[2]
    # the usual conversion in 16-bit fixed point
    out[:, :, 0] = np.clip(y + ((91881 * cr + 32768) >> 16), 0, 255)
    out[:, :, 1] = np.clip(y - ((22554 * cb + 46802 * cr + 32768) >> 16), 0, 255)
    out[:, :, 2] = np.clip(y + ((116130 * cb + 32768) >> 16), 0, 255)
    return out


def _segment(kind: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body


def _table(kind: int, lengths: dict[int, int]) -> bytes:
    """A table of Huffman codes of the given lengths by symbol."""
    counts = bytes(sum(v == n for v in lengths.values()) for n in range(1, 17))
    return _segment(0xC4, bytes([kind]) + counts + bytes(sorted(lengths, key=lambda s: (lengths[s], s))))


def _scan(components: list[tuple[int, int]], start: int, end: int, high: int, low: int, body: bytes) -> bytes:
    head = bytes([len(components)]) + bytes(x for c in components for x in c) + bytes([start, end, high << 4 | low])
    return _segment(0xDA, head) + body


#: An end-of-band run of 2**r blocks and r more bits takes two bytes with its code.
_RUN_CODES = {r << 4: 16 - r for r in range(15)}
_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + b"\x01" * 64)
    + _table(0x00, {0: 1})
    + _table(0x10, {7: 1})
    + _table(0x11, _RUN_CODES)
)
_RUNS = _Huffman(
    bytes(sum(v == n for v in _RUN_CODES.values()) for n in range(1, 17)), bytes(sorted(_RUN_CODES, key=lambda s: (_RUN_CODES[s], s)))
)


def _run_prefix(n: int) -> bytes:
    r = n.bit_length() - 1
    length, code = _RUNS.of[r << 4]
    return ((code << r) | (n - (1 << r))).to_bytes(2, "big") if length + r == 16 else b""


def _packed(bits: np.ndarray) -> bytes:
    """Bits as stuffed bytes; the last byte is filled with ones."""
    body = np.packbits(bits)
    if len(bits) % 8:
        body[-1] |= (1 << (8 - len(bits) % 8)) - 1
    return body.tobytes().replace(b"\xff", b"\xff\x00")


def encode(payload: np.ndarray) -> bytes:
    """A progressive 4:2:0 file whose coefficients are the payload's bytes."""
    blocks = -(-len(payload) // 63)
    units = -(-blocks // 6)
    across = int(np.ceil(np.sqrt(units)))
    down = -(-units // across)
    units = across * down
    grid = np.zeros((6 * units, 63), np.uint8)
    grid.reshape(-1)[: len(payload)] = payload
    # sign and magnitude without its lowest bit: a zero code bit and seven bits
    top = ((grid & 127) >> 1) | 64
    first = np.where(grid >> 7, 127 - top, top).astype(np.uint8)
    second = grid & 1
    parity = np.bitwise_xor.reduce(grid, axis=1)
    parity = np.bitwise_count(parity) & 1
    cuts = [0, 4 * units, 5 * units, 6 * units]
    luma = parity[: 4 * units].reshape(down, 2, across, 2).transpose(0, 2, 1, 3).reshape(units, 4)
    order = np.concatenate([luma, parity[4 * units :].reshape(2, units).T], axis=1)
    out = [
        _HEAD,
        _segment(0xFE, _COM + str(len(payload)).encode()),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _scan([(1, 0), (2, 0), (3, 0)], 0, 0, 0, 1, _packed(np.zeros(6 * units, np.uint8))),
    ]
    for i, bands in enumerate(_BANDS):
        part = first[cuts[i] : cuts[i + 1]]
        for a, b in bands:
            out.append(_scan([(i + 1, 0)], a, b, 0, 1, part[:, a - 1 : b].tobytes()))
    out.append(_scan([(1, 0), (2, 0), (3, 0)], 0, 0, 1, 0, _packed(order.ravel())))
    for i in range(3):
        body = []
        for lo in range(cuts[i], cuts[i + 1], _RUN):
            hi = min(lo + _RUN, cuts[i + 1])
            body.append(_run_prefix(hi - lo).replace(b"\xff", b"\xff\x00") + _packed(second[lo:hi].ravel()))
        out.append(_scan([(i + 1, 1)], 1, 63, 1, 0, b"".join(body)))
    return b"".join(out) + b"\xff\xd9"


def payload_of(image: Image) -> bytes:
    """The payload that ``encode`` stored."""
    if not image.comment.startswith(_COM):
        raise ValueError("the file has no payload")
    c = np.concatenate([x.coefficients for x in image.components])
    ac = c[:, 1:]
    bytes_ = ((np.abs(ac) & 127) | ((ac < 0) << 7)).astype(np.uint8)
    parity = np.bitwise_count(np.bitwise_xor.reduce(bytes_, axis=1)) & 1
    if (parity != c[:, 0]).any():
        raise ValueError("a block's parity is wrong")
    return bytes_.reshape(-1)[: int(image.comment[len(_COM) :])].tobytes()


def payload_for(text: bytes) -> np.ndarray:
    """UTF-8 bytes with zeros up to a positive multiple of 64."""
    out = np.zeros(max(64, -(-len(text) // 64) * 64), np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def feature(rgb: np.ndarray) -> str:
    """Size, channel sums and CRC-32 of a tensor."""
    sums = rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    return f"{rgb.shape[0]}x{rgb.shape[1]}:{sums[0]}:{sums[1]}:{sums[2]}:{zlib.crc32(rgb):08x}"


def _one(text: bytes, tensor: bool) -> tuple:
    media = encode(payload_for(text))
    image = decode(media)
    payload, rgb = payload_of(image), to_rgb(image)
    got = (
        len(text),
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-64:]),
        len(media),
        hashlib.sha256(media).hexdigest(),
        feature(rgb),
    )
    return got + (media, rgb.shape[0], rgb.shape[1], rgb.tobytes()) if tensor else got


_NAMES = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_SQL = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
OUT_BYTES = 32_000_000


def media(docs: DataFrame, tensors: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the text stored as progressive JPEG and read back.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature; with ``tensors`` also media, height, width and rgb (the bytes of the
    full-resolution tensor). All are functions of the text alone.

    Null or empty text: 64 zero bytes. Very long texts: one image each. Null doc_id: null.
    Repeated rows: equal rows. Empty table: empty result. Other columns are ignored."""
    names, types, sql = _NAMES, _TYPES, _SQL
    if tensors:
        names = names + ["media", "height", "width", "rgb"]
        types = types + [pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        sql += ", media binary, height long, width long, rgb binary"

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held, size, lo = [], 0, 0
        for i, text in enumerate(batch.column("text").cast(pa.binary())):
            held.append(_one(text.as_py() or b"", tensors))
            size += held[-1][4] * 3 if tensors else 400
            if size >= OUT_BYTES or i + 1 == batch.num_rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*held), types)]
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(lo, len(held)), *columns], ["k", *names])
                held, size, lo = [], 0, i + 1

    base = docs.select(id_key().alias("k"), F.col("text").cast("string").alias("text"))
    return map_arrow(base, run, "k long, " + sql).select(id_back(F.col("k")).alias("doc_id"), *names)


def decode_media(files: DataFrame, column: str = "media") -> DataFrame:
    """``files`` with the binary ``column`` of progressive JPEG files decoded: one row per row,
    (id_row columns kept by name doc_id) doc_id, height, width, rgb. A null file gives nulls."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, item in enumerate(batch.column("file")):
            data = item.as_py()
            rgb = None if data is None else to_rgb(decode(data))
            shape = (None, None) if rgb is None else rgb.shape[:2]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(i, 1),
                    pa.array([shape[0]], pa.int64()),
                    pa.array([shape[1]], pa.int64()),
                    pa.array([None if rgb is None else rgb.tobytes()], pa.binary()),
                ],
                ["doc_id", "height", "width", "rgb"],
            )

    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("file"))
    return map_arrow(rows, run, "doc_id long, height long, width long, rgb binary")
