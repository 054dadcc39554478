"""Baseline JPEG as a lossless media column.

A payload is stored in the format's own units, the quantised coefficients: each
64 bytes are one 8 x 8 luminance block in zigzag order, the first byte as DC and
the others as AC values of size 9 (256 + byte), so that nothing is rounded. The
reader parses markers, Huffman-decodes the scan, rebuilds the luminance
thumbnail from the DC values alone, and hashes it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

UNIT = 64
#: Blocks packed or unpacked at a time.
BLOCKS = 4096
#: Widest and highest picture in blocks.
MOST = 65535 // 8
_CATEGORY = np.array([int(x).bit_length() for x in range(2048)], dtype=np.int64)
_AC_BITS = 63 * 10


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(width: int, height: int, size: int) -> bytes:
    quant = bytes([8] + [1] * 63)
    dc = bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9))  # nine sizes, four bits each
    ac = bytes([1] + [0] * 15) + bytes([0x09])  # one symbol: no zeros before, nine bits follow
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xE0, b"JFIF\0\1\1\0" + struct.pack(">HHBB", 1, 1, 0, 0)),
            _segment(0xFE, b"payload %d" % size),
            _segment(0xDB, b"\0" + quant),
            _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0"),
            _segment(0xC4, b"\x00" + dc),
            _segment(0xC4, b"\x10" + ac),
            _segment(0xDA, b"\1\1\0\0\x3f\0"),
        ]
    )


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def store(payload: bytes) -> bytes:
    """The payload, a positive multiple of 64 bytes, as a baseline JPEG file."""
    n = len(payload) // UNIT
    wide = max(1, int(np.ceil(np.sqrt(n))))
    high = -(-n // wide)
    if high > MOST or wide > MOST:
        raise ValueError("payload too large for one picture")
    blocks = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    if wide * high > n:
        blocks = np.concatenate([blocks, np.zeros((wide * high - n, UNIT), np.uint8)])
    parts, rest, before = [], np.zeros(0, np.uint8), 0
    for k in range(0, len(blocks), BLOCKS):
        part = blocks[k : k + BLOCKS]
        dc = part[:, 0].astype(np.int64) - 128
        diff = np.diff(dc, prepend=before)
        before = dc[-1]
        size = _CATEGORY[np.abs(diff)]
        value = np.where(diff < 0, diff + (1 << size) - 1, diff)
        bits = np.empty((len(part), 12 + _AC_BITS), np.uint8)
        bits[:, :4] = (size[:, None] >> np.arange(3, -1, -1)) & 1
        bits[:, 4:12] = (value[:, None] >> np.maximum(size[:, None] - 1 - np.arange(8), 0)) & 1
        ac = bits[:, 12:].reshape(len(part), 63, 10)
        ac[:, :, 0], ac[:, :, 1] = 0, 1
        ac[:, :, 2:] = np.unpackbits(part[:, 1:], axis=1).reshape(len(part), 63, 8)
        used = np.ones(bits.shape, bool)
        used[:, 4:12] = np.arange(8) < size[:, None]
        flat = np.concatenate([rest, bits[used]])
        whole = len(flat) // 8 * 8
        parts.append(np.packbits(flat[:whole]).tobytes())
        rest = flat[whole:]
    if len(rest):
        parts.append(np.packbits(np.concatenate([rest, np.ones(8 - len(rest), np.uint8)])).tobytes())
    scan = b"".join(parts).replace(b"\xff", b"\xff\0")
    return _header(8 * wide, 8 * high, len(payload)) + scan + b"\xff\xd9"


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    parts: list = field(default_factory=list)  # id, horizontal and vertical sampling, quantiser
    quant: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)  # (class, id): {(length, code): symbol}
    comment: bytes = b""
    restart: int = 0
    coefficients: list = field(default_factory=list)  # of each part: blocks x 64 in zigzag order

    def thumbnail(self) -> np.ndarray:
        """Luminance from the DC values, a pixel for each block."""
        wide = -(-self.width // 8)
        dc = self.coefficients[0][:, 0].reshape(-1, wide)
        return np.clip(np.floor(dc * self.quant[self.parts[0][3]][0] / 8 + 128.5), 0, 255).astype(np.uint8)


def codes(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """The canonical Huffman code that a table segment stands for."""
    out, code, k = {}, 0, 0
    for length in range(1, 17):
        for _ in range(lengths[length - 1]):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def read(data: bytes) -> Picture:
    """Parse and decode a baseline JPEG with one scan: grey, or colours with any sampling."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    pic, at = Picture(), 2
    while True:
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        if marker == 0xD9:
            raise ValueError("no scan")
        size = struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                pic.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(int)
                body = body[1 + 64 * wide :]
        elif marker == 0xC0:
            depth, pic.height, pic.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8:
                raise ValueError("not 8 bits a sample")
            pic.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                pic.tables[body[0] >> 4, body[0] & 15] = codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            pic.restart = struct.unpack(">H", body)[0]
        elif marker == 0xFE:
            pic.comment = body
        elif marker == 0xDA:
            uses = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            end = data.rfind(b"\xff\xd9")
            _scan(pic, data[at : end if end >= at else len(data)], [uses[p[0]] for p in pic.parts])
            return pic


def _scan(pic: Picture, scan: bytes, uses: list[tuple[int, int]]) -> None:
    dc, ac = pic.tables[0, uses[0][0]], pic.tables[1, uses[0][1]]
    even = len(pic.parts) == 1 and not pic.restart and len({k[0] for k in dc}) == 1 and len(ac) == 1
    if even and next(iter(ac.values())) >> 4 == 0 and next(iter(ac.values())) & 15:
        pic.coefficients = [_even_scan(scan.replace(b"\xff\0", b"\xff"), -(-pic.width // 8) * -(-pic.height // 8), dc, ac)]
        return
    _any_scan(pic, scan, uses)


def _even_scan(data: bytes, n: int, dc: dict, ac: dict) -> np.ndarray:
    """A scan whose codes have one length a table: only the DC sizes must be followed one after the other."""
    code_bits = next(iter(dc))[0]
    sizes = [0] * (1 << code_bits)
    for (_, code), symbol in dc.items():
        sizes[code] = symbol
    (ac_code, _), value_bits = next(iter(ac)), next(iter(ac.values()))
    ac_bits = 63 * (ac_code + value_bits)
    most = code_bits + max(sizes) + ac_bits
    out = np.empty((n, 64), np.int16)
    done, at, before = 0, 0, 0
    while done < n:
        low = at // 8
        want = min(BLOCKS, n - done)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, count=min(len(data) - low, (want * most + 15) // 8 + 1), offset=low))
        plain, ahead = bits.tobytes(), range(1, code_bits)
        starts, size, p, step = [], [], at - 8 * low, code_bits + ac_bits
        for _ in range(want):
            code = plain[p]
            for k in ahead:
                code = code * 2 + plain[p + k]
            starts.append(p)
            size.append(sizes[code])
            p += step + sizes[code]
            if p > len(bits):
                raise ValueError("the scan ends early")
        at = 8 * low + p
        starts, size = np.array(starts), np.array(size)
        raw = np.zeros(want, np.int64)
        body = np.ones(p, bool)
        body[: starts[0]] = False
        for k in range(code_bits + int(size.max())):
            use = k < code_bits + size
            body[starts[use] + k] = False
            if k >= code_bits:
                raw[use] = raw[use] * 2 + bits[starts[use] + k]
        diff = np.where((size > 0) & (raw < (1 << np.maximum(size - 1, 0))), raw - (1 << size) + 1, raw)
        level = np.cumsum(diff) + before
        before = level[-1]
        out[done : done + want, 0] = level
        rows = bits[:p][body].reshape(want, 63, ac_code + value_bits)
        low_bits = 8 if value_bits >= 8 else 0
        value = np.zeros((want, 63), np.int16)
        if low_bits:
            value += np.packbits(rows[:, :, -8:].reshape(-1)).reshape(want, 63)
        for k in range(value_bits - low_bits):
            value += rows[:, :, ac_code + k].astype(np.int16) << (value_bits - 1 - k)
        out[done : done + want, 1:] = np.where(value < (1 << (value_bits - 1)), value - (1 << value_bits) + 1, value)
        done += want
    return out


def _any_scan(pic: Picture, scan: bytes, uses: list[tuple[int, int]]) -> None:
    """Any other baseline scan, symbol by symbol."""
    h_most, v_most = max(p[1] for p in pic.parts), max(p[2] for p in pic.parts)
    single = len(pic.parts) == 1
    wide = -(-pic.width // (8 if single else 8 * h_most))
    high = -(-pic.height // (8 if single else 8 * v_most))
    grids = [{} for _ in pic.parts]
    bits, at, level = "", 0, [0] * len(pic.parts)
    chunks = _restarts(scan)
    chunk = 0

    def take(n: int) -> int:
        nonlocal at
        at += n
        return int(bits[at - n : at], 2) if n else 0

    def symbol(table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code * 2 + take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("a code that the table lacks")

    def value(n: int) -> int:
        v = take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    for unit in range(wide * high):
        if unit == 0 or (pic.restart and unit % pic.restart == 0):
            bits, at, level = "".join(f"{b:08b}" for b in chunks[chunk]), 0, [0] * len(pic.parts)
            chunk += 1
        for i, (_, h, v, _q) in enumerate(pic.parts):
            for k in range(1 if single else h * v):
                row = [0] * 64
                level[i] += value(symbol(pic.tables[0, uses[i][0]]))
                row[0], z = level[i], 1
                while z < 64:
                    s = symbol(pic.tables[1, uses[i][1]])
                    if s == 0:
                        break
                    z += s >> 4
                    if s & 15:
                        row[z] = value(s & 15)
                    z += 1
                hh, vv = (1, 1) if single else (h, v)
                grids[i][(unit // wide) * vv + k // hh, (unit % wide) * hh + k % hh] = row
    for i, (_, h, v, _q) in enumerate(pic.parts):
        across = -(-pic.width * (1 if single else h) // (8 * (1 if single else h_most)))
        down = -(-pic.height * (1 if single else v) // (8 * (1 if single else v_most)))
        pic.coefficients.append(np.array([grids[i][y, x] for y in range(down) for x in range(across)], np.int16))


def _restarts(scan: bytes) -> list[bytes]:
    """The scan's parts between restart markers, without stuffed zeros."""
    out, begin, k = [], 0, scan.find(b"\xff")
    while k >= 0:
        if 0xD0 <= scan[k + 1 : k + 2].ljust(1, b"\0")[0] <= 0xD7:
            out.append(scan[begin:k])
            begin = k + 2
        k = scan.find(b"\xff", k + 2)
    return [p.replace(b"\xff\0", b"\xff") for p in [*out, scan[begin:]]]


def payload(pic: Picture) -> bytes:
    """What :func:`store` put into the coefficients."""
    if not pic.comment.startswith(b"payload "):
        raise ValueError("no payload in this picture")
    c = pic.coefficients[0].astype(np.int32)
    c[:, 0] += 128
    c[:, 1:] -= 256
    return c.astype(np.uint8).tobytes()[: int(pic.comment[8:])]


def feature(pic: Picture) -> str:
    """Size in pixels, difference hash of the thumbnail, and checksum of all its pixels."""
    thumb = pic.thumbnail()
    rows = np.arange(8) * thumb.shape[0] // 8
    cols = np.arange(9) * thumb.shape[1] // 9
    small = thumb[rows][:, cols].astype(int)
    bits = np.packbits((small[:, 1:] > small[:, :-1]).ravel()).tobytes()
    return f"{pic.width}x{pic.height}:{bits.hex()}:{zlib.crc32(thumb.tobytes()):08x}"


def store_texts(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Add ``n_bytes`` and ``media``: the whole text's UTF-8 bytes, padded, as a JPEG file.

    A null or empty text is 64 zero bytes. Equal texts give equal files; repeated rows
    each keep theirs; columns named like the two added are replaced.
    """

    def start():
        def each(batch: list) -> list[pa.Array]:
            data = [(t or "").encode() for t in batch]
            return [pa.array([len(d) for d in data], pa.int64()), pa.array([store(pad(d)) for d in data], pa.binary())]

        return each

    return common.map_text(docs, start, {"n_bytes": "long", "media": "binary"}, keep)


def read_media(stored: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Read files of :func:`store_texts` back: payload digests, the file's own size and digest, and features.

    A null file gives nulls.
    """
    added = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "width": "int", "height": "int", "thumbnail_sha256": "string", "feature": "string"}

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * len(added)
        pic = read(data)
        got = payload(pic)
        thumb = hashlib.sha256(pic.thumbnail().tobytes()).hexdigest()
        return (len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), pic.width, pic.height, thumb, feature(pic))

    kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}

    def start():
        def each(batch: list) -> list[pa.Array]:
            rows = [one(d) for d in batch]
            return [pa.array([r[i] for r in rows], kinds[t]) for i, t in enumerate(added.values())]

        return each

    return common.map_text(stored, start, added, keep, text="media")
