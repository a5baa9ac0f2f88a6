"""Progressive JPEG: a decoder to coefficient arrays and RGB tensors, and a lossless payload format on top.

The decoder reads progressive (SOF2) streams: DC and AC scans, spectral selection,
successive approximation, end-of-band runs, restart markers, subsampled components.
Scans add to one coefficient array per component; then all blocks are dequantised and
inverse-transformed in one matrix product, chroma is repeated to full resolution, and
YCbCr becomes RGB.

A payload is stored as AC coefficients: byte b is the coefficient b + 256, 63 of them in
each block, so quantisation by 1 loses nothing. Every such coefficient has nine bits; the
Huffman tables then hold one symbol each and every code has a fixed length, so the bits
are packed and unpacked by numpy, not bit by bit. Streams with any other tables are
decoded symbol by symbol.

Defined cases: null text counts as empty: one payload of 64 zero bytes. Equal texts give
equal streams and features. Images grow in both directions, so a payload of several GB
still fits the format's 65,535 samples a side. Repeated rows are stored each on their
own. Null, empty and broken streams, and headers that ask for more than ``MOST_SAMPLES``, give ``tensors`` an error
and no picture. Empty tables give no rows. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import take


MOST_SAMPLES = 200_000_000


def _zigzag() -> np.ndarray:
    """Natural position (8 row + column) of each zigzag place: diagonals, in turn upward and downward."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda rc: (rc[0] + rc[1], rc[0] if (rc[0] + rc[1]) % 2 else rc[1]))
    return np.array([8 * r + c for r, c in cells])


def _basis() -> np.ndarray:
    """64 x 64: zigzag coefficients to samples, as one matrix."""
    k = np.arange(8)
    one = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k[:, None] == 0, np.sqrt(0.125), 0.5)
    return np.kron(one, one)[ZIGZAG].astype(np.float32)


ZIGZAG = _zigzag()
BASIS = _basis()
CODES = 1 << 15  #: codes packed or unpacked at a time; a multiple of 8, so parts meet at bytes
_NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S)


@dataclass
class Component:
    h: int
    v: int
    quant: int
    wide: int = 0  #: blocks in a padded row
    high: int = 0
    own_wide: int = 0  #: blocks in a row of a scan of its own
    own_high: int = 0
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 64), np.int16))


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quants: dict[int, np.ndarray]
    comments: list[bytes]


class Huffman:
    """Canonical codes; ``only`` is the symbol of a table with just the code 0."""

    def __init__(self, counts: bytes, symbols: bytes):
        self.lookup: dict[tuple[int, int], int] = {}
        code, at = 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.lookup[length, code] = symbols[at]
                code += 1
                at += 1
            code <<= 1
        self.only = symbols[0] if len(symbols) == 1 and counts[0] == 1 else None


class Bits:
    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n].tolist():
            out = out << 1 | b
        self.at += n
        return out

    def symbol(self, table: Huffman) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | int(self.bits[self.at])
            self.at += 1
            if (found := table.lookup.get((length, code))) is not None:
                return found
        raise ValueError("no such code")


def _signed(value: int, size: int) -> int:
    return value if size == 0 or value >> (size - 1) else value - (1 << size) + 1


def _dc_order(parts: list[Component]) -> list[tuple[int, int]]:
    """(component, block) in the order of a scan's data units."""
    if len(parts) == 1:
        c = parts[0]
        return [(0, y * c.wide + x) for y in range(c.own_high) for x in range(c.own_wide)]
    across, down = parts[0].wide // parts[0].h, parts[0].high // parts[0].v
    return [
        (i, (my * c.v + y) * c.wide + mx * c.h + x)
        for my in range(down)
        for mx in range(across)
        for i, c in enumerate(parts)
        for y in range(c.v)
        for x in range(c.h)
    ]


def _rows(c: Component) -> np.ndarray | slice:
    """The blocks of a component in the order of a scan of its own."""
    if c.own_wide == c.wide and c.own_high == c.high:
        return slice(None)
    return (np.arange(c.own_high)[:, None] * c.wide + np.arange(c.own_wide)[None, :]).ravel()


def _dc_scan(parts, tables, segments, high, low, restart) -> None:
    if high == 0 and all(t.only == 0 for t in tables):
        return  # every difference is 0
    units_all = sum(len(c.coefficients) for c in parts) if len(parts) > 1 else parts[0].own_wide * parts[0].own_high
    if high and not restart and not np.unpackbits(np.frombuffer(segments[0], np.uint8), count=units_all).any():
        return  # no bit to add
    order = _dc_order(parts)
    per_mcu = 1 if len(parts) == 1 else sum(c.h * c.v for c in parts)
    step = restart * per_mcu if restart else len(order)
    for k, data in enumerate(segments):
        units = order[k * step : (k + 1) * step]
        bits = Bits(data)
        if high:
            got = bits.bits[: len(units)].astype(np.int16) << low
            for i, c in enumerate(parts):
                mine = np.array([j for j, (p, _) in enumerate(units) if p == i], dtype=np.int64)
                c.coefficients[[units[j][1] for j in mine], 0] |= got[mine]
            continue
        before = [0] * len(parts)
        for i, block in units:
            size = bits.symbol(tables[i])
            before[i] += _signed(bits.take(size), size)
            parts[i].coefficients[block, 0] = before[i] << low


def _fixed(data: bytes, codes: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first code, bits of one code a row) of codes of one length, some at a time."""
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, codes, CODES):
        n = min(CODES, codes - at)
        yield at, np.unpackbits(raw[at * width // 8 :], count=n * width).reshape(n, width)


def _ac_first(c, table, segments, lo, hi, low, restart) -> None:
    rows = _rows(c)
    if not restart and table.only is not None and table.only >> 4 == 0 and table.only & 15:
        size, n = table.only & 15, hi - lo + 1
        blocks = len(c.coefficients) if isinstance(rows, slice) else len(rows)
        found = np.empty(blocks * n, np.int16)
        for at, bits in _fixed(segments[0], blocks * n, size + 1):
            if size <= 8:
                value = (np.packbits(bits[:, 1:], axis=1)[:, 0] >> (8 - size)).astype(np.int16)
            else:
                two = np.packbits(bits[:, 1:], axis=1).astype(np.int32)
                value = (two[:, 0] << 8 | two[:, 1]) >> (16 - size)
            if not bits[:, 1].all():
                value = np.where(bits[:, 1], value, value - (1 << size) + 1)
            found[at : at + len(bits)] = value * (1 << low)
        c.coefficients[rows, lo : hi + 1] = found.reshape(blocks, n)
        return
    order = np.arange(len(c.coefficients))[rows].tolist()
    step = restart or len(order)
    for k, data in enumerate(segments):
        bits, run = Bits(data), 0
        for block in order[k * step : (k + 1) * step]:
            if run:
                run -= 1
                continue
            at = lo
            while at <= hi:
                symbol = bits.symbol(table)
                zeros, size = symbol >> 4, symbol & 15
                if size:
                    at += zeros
                    c.coefficients[block, at] = _signed(bits.take(size), size) * (1 << low)
                    at += 1
                elif zeros == 15:
                    at += 16
                else:
                    run = (1 << zeros) - 1 + (bits.take(zeros) if zeros else 0)
                    break


def _ac_refine(c, table, segments, lo, hi, low, restart) -> None:
    rows = _rows(c)
    band = c.coefficients[rows, lo : hi + 1]
    if not restart and table.only == 0 and band.all():
        found = np.empty(band.shape, np.int16)
        for at, bits in _fixed(segments[0], len(band), hi - lo + 2):
            more, before = bits[:, 1:].astype(np.int16) << low, band[at : at + len(bits)]
            found[at : at + len(bits)] = before + np.where(before > 0, more, -more) if (before < 0).any() else before + more
        c.coefficients[rows, lo : hi + 1] = found
        return
    order = np.arange(len(c.coefficients))[rows].tolist()
    step = restart or len(order)
    one = 1 << low

    def correct(block: int, at: int, bits: Bits) -> None:
        if bits.take(1):
            c.coefficients[block, at] += one if c.coefficients[block, at] > 0 else -one

    for k, data in enumerate(segments):
        bits, run = Bits(data), 0
        for block in order[k * step : (k + 1) * step]:
            at = lo
            while at <= hi and not run:
                symbol = bits.symbol(table)
                zeros, size = symbol >> 4, symbol & 15
                fresh = 0
                if size:
                    fresh = one if bits.take(1) else -one
                elif zeros < 15:
                    run = (1 << zeros) + (bits.take(zeros) if zeros else 0)
                    break
                while at <= hi:
                    if c.coefficients[block, at]:
                        correct(block, at, bits)
                    elif zeros == 0:
                        break
                    else:
                        zeros -= 1
                    at += 1
                if fresh and at <= hi:
                    c.coefficients[block, at] = fresh
                at += 1
            if run:
                while at <= hi:
                    if c.coefficients[block, at]:
                        correct(block, at, bits)
                    at += 1
                run -= 1


def decode(stream: bytes, most_samples: int | None = None) -> Image:
    """All scans of a progressive JPEG, accumulated to coefficients (zigzag order)."""
    if stream[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    quants: dict[int, np.ndarray] = {}
    tables: dict[tuple[int, int], Huffman] = {}
    comments: list[bytes] = []
    image: Image | None = None
    ids: list[int] = []
    restart, at = 0, 2
    while at < len(stream):
        marker = stream[at + 1]
        if marker == 0xD9:
            break
        (length,) = struct.unpack(">H", stream[at + 2 : at + 4])
        body = stream[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xFE:
            comments.append(body)
        elif marker == 0xDB:
            while body:
                size = 2 if body[0] >> 4 else 1
                quants[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * size], ">u2" if size == 2 else np.uint8).astype(np.float32)
                body = body[1 + 64 * size :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15] = Huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            (restart,) = struct.unpack(">H", body)
        elif marker == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            if most_samples is not None and height * width * n > most_samples:
                raise ValueError(f"{width} x {height} samples of {n} components are over the limit")
            ids = [body[6 + 3 * i] for i in range(n)]
            parts = [Component(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            hm, vm = max(c.h for c in parts), max(c.v for c in parts)
            for c in parts:
                c.wide, c.high = -(-width // (8 * hm)) * c.h, -(-height // (8 * vm)) * c.v
                c.own_wide, c.own_high = -(-(-(-width * c.h // hm)) // 8), -(-(-(-height * c.v // vm)) // 8)
                c.coefficients = np.zeros((c.wide * c.high, 64), np.int16)
            image = Image(width, height, parts, quants, comments)
        elif marker == 0xDA:
            if image is None:
                raise ValueError("a scan before its frame")
            n = body[0]
            chosen = [(image.components[ids.index(body[1 + 2 * i])], body[2 + 2 * i]) for i in range(n)]
            lo, hi, approx = body[1 + 2 * n : 4 + 2 * n]
            end = _NEXT_MARKER.search(stream, at)
            data = stream[at : end.start() if end else len(stream)]
            at = end.start() if end else len(stream)
            segments = [x.replace(b"\xff\x00", b"\xff") for x in (re.split(rb"\xff[\xd0-\xd7]", data) if restart else [data])]
            high, low = approx >> 4, approx & 15
            if lo == 0:
                _dc_scan([c for c, _ in chosen], [tables.get((0, t >> 4), Huffman(bytes(16), b"")) for _, t in chosen], segments, high, low, restart)
            else:
                c, t = chosen[0]
                (_ac_refine if high else _ac_first)(c, tables[1, t & 15], segments, lo, hi, low, restart)
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only progressive Huffman streams are read")
    if image is None:
        raise ValueError("no frame")
    return image


def plane(image: Image, c: Component, rows: slice) -> np.ndarray:
    """Samples (float) of some block rows of a component."""
    blocks = c.coefficients[rows.start * c.wide : rows.stop * c.wide].astype(np.float32) * image.quants[c.quant]
    samples = blocks @ BASIS + np.float32(128)
    return samples.reshape(-1, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8 * c.wide)


def rgb_strips(image: Image, mcu_rows: int = 64) -> Iterator[np.ndarray]:
    """The picture as uint8 (rows, width, 3), some rows at a time, so that memory stays bounded."""
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    down = image.components[0].high // image.components[0].v
    for top in range(0, down, mcu_rows):
        planes = []
        for c in image.components:
            p = np.clip(np.rint(plane(image, c, slice(top * c.v, min(down, top + mcu_rows) * c.v))), 0, 255)
            if (vm // c.v, hm // c.h) != (1, 1):
                p = p.repeat(vm // c.v, axis=0).repeat(hm // c.h, axis=1)
            planes.append(p)
        if len(planes) == 1:
            out = np.stack(planes * 3, axis=-1)
        else:
            y, cb, cr = planes
            cb -= np.float32(128)
            cr -= np.float32(128)
            out = np.empty((*y.shape, 3), np.float32)
            out[..., 0] = y + np.float32(1.402) * cr
            out[..., 1] = y - np.float32(0.344136) * cb - np.float32(0.714136) * cr
            out[..., 2] = y + np.float32(1.772) * cb
            np.rint(out, out=out)
            np.clip(out, 0, 255, out=out)
        yield out[: image.height - top * 8 * vm, : image.width].astype(np.uint8)


def rgb(image: Image) -> np.ndarray:
    """Full-resolution uint8 tensor (height, width, 3)."""
    return np.concatenate(list(rgb_strips(image)))


# --- payloads ---

_FRAME = ((2, 2), (1, 1), (1, 1))
_BLOCKS = 6  #: of an MCU
#: (component, first, last) of each AC band.
_BANDS = ((0, 1, 20), (0, 21, 63), (1, 1, 63), (2, 1, 63))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(header: bytes, parts: Iterable[np.ndarray]) -> bytes:
    """A scan of bits that come in parts; all but the last fill whole bytes."""
    out = []
    for bits in parts:
        spare = -bits.size % 8
        if spare:
            bits = np.append(bits.ravel(), np.ones(spare, np.uint8))
        out.append(np.packbits(bits).tobytes())
    return _segment(0xDA, header) + b"".join(out).replace(b"\xff", b"\xff\x00")


def _high_bits(band: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of nine bits: the table's code 0, then a coefficient's upper eight."""
    for at in range(0, band.size, CODES):
        part = band[at : at + CODES]
        codes = np.zeros((len(part), 9), np.uint8)
        codes[:, 1:] = np.unpackbits((part >> 1 | 128).reshape(-1, 1), axis=1)
        yield codes


def _low_bits(band: np.ndarray) -> Iterator[np.ndarray]:
    """A row a block: the table's code 0 (end of band), then a correction bit a coefficient."""
    for at in range(0, len(band), CODES):
        part = band[at : at + CODES]
        codes = np.zeros((len(part), part.shape[1] + 1), np.uint8)
        codes[:, 1:] = part & 1
        yield codes


def _table(kind: int, slot: int, symbol: int) -> bytes:
    return bytes([kind << 4 | slot, 1]) + bytes(15) + bytes([symbol])


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, the same padded with 0 to a positive multiple of 64)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 or (64 if not raw else 0))


def encode_payload(payload: bytes, comment: bytes = b"") -> bytes:
    """A progressive 4:2:0 JPEG whose AC coefficients are the payload's bytes + 256."""
    mcus = max(1, -(-len(payload) // (63 * _BLOCKS)))
    across = max(1, min(4095, int(np.ceil(np.sqrt(mcus)))))
    down = -(-mcus // across)
    if down > 4095:
        raise ValueError("payload too large for one image")
    units = np.zeros(across * down * _BLOCKS * 63, np.uint8)
    units[: len(payload)] = np.frombuffer(payload, np.uint8)
    blocks = units.reshape(-1, 63)
    n = across * down
    parts = (blocks[: 4 * n], blocks[4 * n : 5 * n], blocks[5 * n :])
    out = [
        b"\xff\xd8",
        _segment(0xFE, b"payload %d " % len(payload) + comment),
        _segment(0xDB, b"\x00" + b"\x01" * 64),
        _segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(_FRAME))),
        _segment(0xC4, _table(0, 0, 0) + _table(1, 0, 8) + _table(1, 1, 0)),
        _scan(bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 1]), [np.zeros(6 * n, np.uint8)]),
    ]
    for i, lo, hi in _BANDS:
        out.append(_scan(bytes([1, i + 1, 0, lo, hi, 1]), _high_bits(parts[i][:, lo - 1 : hi].ravel())))
    out.append(_scan(bytes([3, 1, 0, 2, 0, 3, 0, 0, 0, 16]), [np.zeros(6 * n, np.uint8)]))
    for i, lo, hi in _BANDS:
        out.append(_scan(bytes([1, i + 1, 1, lo, hi, 16]), _low_bits(parts[i][:, lo - 1 : hi])))
    return b"".join([*out, b"\xff\xd9"])


def payload_from(image: Image) -> bytes:
    """The payload of a decoded image, as its comment tells its length."""
    size = int(image.comments[0].split()[1])
    units = np.concatenate([c.coefficients[:, 1:].ravel() for c in image.components])
    return (units - 256).astype(np.uint8).tobytes()[:size]


def features(image: Image) -> str:
    """Size, mean colour, and a hash of which of 64 areas are lighter than the picture."""
    total, count = np.zeros(3), 0
    rows = []
    for strip in rgb_strips(image):
        total += strip.sum(axis=(0, 1), dtype=np.int64)
        count += strip.shape[0] * strip.shape[1]
        rows.append(strip.reshape(strip.shape[0], 8, -1).sum(axis=2, dtype=np.int64))
    light = np.concatenate(rows)
    areas = np.array([x.mean(axis=0) for x in np.array_split(light, 8)])
    flags = np.packbits((areas > areas.mean()).ravel()).tobytes().hex()
    return f"{image.width}x{image.height}:" + ",".join(f"{x:.1f}" for x in total / count) + f":{flags}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature".split()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            rows = []
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                n, payload = payload_of(text)
                stream = encode_payload(payload)
                image = decode(stream)
                back = payload_from(image)
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stream), hashlib.sha256(stream).hexdigest(), features(image)))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: its payload stored as a progressive JPEG, read back, and features of the picture."""
    rows = take(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(_stored, schema)


def _tensors(most_samples: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "height", "width", "rgb", "error"]
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    picture = rgb(decode(data or b"", most_samples))
                    row = [name, picture.shape[0], picture.shape[1], picture.tobytes(), None]
                except (ValueError, KeyError, IndexError, struct.error) as bad:
                    row = [name, None, None, None, f"{type(bad).__name__}: {bad}"]
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()], strict=True)], names=names)

    return run


def tensors(media: DataFrame, identity: str = "doc_id", content: str = "media", most_samples: int = MOST_SAMPLES) -> DataFrame:
    """Full-resolution RGB tensors (bytes, row by row) of a column of JPEG streams; what can't be decoded has an error.

    So has a picture whose header asks for more than ``most_samples`` samples, whatever the stream holds.
    """
    rows = take(media, identity, content).select(F.col(identity).cast("long").alias("id"), F.col(content).cast("binary").alias("media"))
    return rows.mapInArrow(_tensors(most_samples), "id long, height int, width int, rgb binary, error string").withColumnRenamed("id", identity)
