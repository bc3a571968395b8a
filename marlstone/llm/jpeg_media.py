r"""Media columns: baseline JPEG files whose DC thumbnails are the stored bytes.

``encode_frame`` writes 8-bit samples as a grey baseline JPEG with one flat 8 by 8 block for each sample. The DC step is 8, so
a block's DC coefficient is its sample less 128 exactly; its AC coefficients are zero. A restart marker ends each row of
blocks. ``decode`` is not tied to these files: it parses the markers of any baseline JPEG (grey or with several components,
any sampling, with or without restart intervals), Huffman-decodes all scans symbol by symbol, steps over the AC coefficients
and gives the luminance thumbnail, one pixel for a block, and the image's dimensions. The intervals between restart markers are
independent, so numpy decodes all of them in step, of many files at once.

A payload longer than one image can hold (65,535 pixels a side) goes into several images, one after the other.

Defined results: a null or empty text is 64 zero bytes; equal texts give equal files; repeated rows are files of their own;
extra columns play no part; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_or_empty

#: Blocks in a row of an own frame, the most rows of one, and the unit of payloads.
ROW, MOST_ROWS, UNIT = 64, 8191, 64
_ZIGZAG_SIZE = 64
#: Code lengths of DC size categories 0 to 11: frequent ones short, none all ones.
_DC_LENGTHS = {4: 2, 5: 2, 6: 3, 3: 3, 0: 4, 2: 5, 7: 5, 1: 6, 8: 7, 9: 8, 10: 9, 11: 10}


def _codes(lengths: dict[int, int]) -> list[tuple[int, int, int]]:
    """Canonical Huffman codes (symbol, length, code), shortest first, of a table in its given order."""
    out, code, before = [], 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - before if before else 0
        out.append((symbol, n, code))
        code, before = code + 1, n
    return out


def _dht(kind: int, codes: list[tuple[int, int, int]]) -> bytes:
    body = bytes([kind, *(sum(n == k for _, n, _ in codes) for k in range(1, 17)), *(s for s, _, _ in codes)])
    return b"\xff\xc4" + struct.pack(">H", 2 + len(body)) + body


_DC, _AC = _codes(_DC_LENGTHS), _codes({0: 1})
_TABLES = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8, *[1] * 63]) + _dht(0x00, _DC) + _dht(0x10, _AC)


def _sample_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference from -255 to 255 its bits with the end-of-block code behind them, one in each byte, and which count."""
    by = {s: (n, c) for s, n, c in _DC}
    made = []
    for d in range(-255, 256):
        k = abs(d).bit_length()
        n, c = by[k]
        made.append(f"{c:0{n}b}" + (f"{d if d >= 0 else d + (1 << k) - 1:0{k}b}" if k else "") + "0")
    wide = max(map(len, made))
    return np.array([[int(x) for x in m.ljust(wide, "0")] for m in made], np.uint8), np.array([[k < len(m) for k in range(wide)] for m in made])


_BITS, _USED = _sample_codes()
_SIZE = _USED.sum(1)


def encode_frames(payloads: list[np.ndarray]) -> list[bytes]:
    """A JPEG of each payload of at most ROW * MOST_ROWS samples, a multiple of ROW each."""
    flat = np.concatenate(payloads)
    step = np.diff(flat.reshape(-1, ROW).astype(np.int16), axis=1, prepend=np.int16(128)) + 255
    # Each row of blocks is an entropy-coded segment of whole bytes, filled up with ones.
    size = _SIZE[step].sum(1)
    wide = -(-size // 8)
    fill = np.arange(7) < (8 * wide - size)[:, None]
    bits = np.concatenate([_BITS[step].reshape(len(step), -1), np.ones_like(fill, np.uint8)], axis=1)
    used = np.concatenate([_USED[step].reshape(len(step), -1), fill], axis=1)
    stops = np.cumsum(wide).tolist()
    whole, out, row, start = np.packbits(bits[used]).tobytes(), [], 0, 0
    for p in payloads:
        rows = len(p) // ROW
        head = struct.pack(">HBHHBBBB", 11, 8, 8 * rows, 8 * ROW, 1, 1, 0x11, 0)
        parts = []
        for k in range(rows):
            stop = stops[row + k]
            parts.append(whole[start:stop].replace(b"\xff", b"\xff\0"))
            if k < rows - 1:
                parts.append(bytes([0xFF, 0xD0 + k % 8]))
            start = stop
        row += rows
        out.append(b"\xff\xd8" + _TABLES + b"\xff\xc0" + head + b"\xff\xdd" + struct.pack(">HH", 4, ROW) + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 0, 63, 0) + b"".join(parts) + b"\xff\xd9")
    return out


_TOP, _ONE = np.uint64(48), np.uint64(1)
#: By number of raw bits: the least value that is not negative, and what negative ones are short of.
_HALF = np.array([0, *(1 << k for k in range(15))], np.int32)
_FULL = np.array([(1 << k) - 1 for k in range(16)], np.int32)


class Segment(NamedTuple):
    """Entropy-coded bytes between two restart markers, unstuffed, with all that it takes to decode them."""

    data: bytes
    frame: int
    mcus: int
    tables: tuple  # per block of an MCU: (DC table, AC table, component)


class Frame(NamedTuple):
    width: int
    height: int
    thumb: np.ndarray  # one pixel for each luminance block


class _Image:
    def __init__(self):
        self.quant, self.huff, self.restart, self.parts, self.scans = {}, {}, 0, [], []
        self.width = self.height = 0


def parse(data: bytes, at: int = 0) -> tuple[_Image, int]:
    """The markers of one image from ``at`` on, and where it ends."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no image starts here")
    image, at = _Image(), at + 2
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        mark = data[at + 1]
        if data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        at += 2
        if mark == 0xD9:
            return image, at
        n = struct.unpack_from(">H", data, at)[0]
        body, at = data[at + 2 : at + n], at + n
        if mark == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                image.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide == 2 else "u1", 64, 1).astype(np.int32)
                body = body[1 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                count = sum(body[1:17])
                image.huff[body[0]] = bytes(body[1 : 17 + count])
                body = body[17 + count :]
        elif mark == 0xDD:
            image.restart = struct.unpack(">H", body)[0]
        elif mark == 0xC0:
            image.height, image.width = struct.unpack_from(">HH", body, 1)
            image.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC1 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError("only baseline images are decoded")
        elif mark == 0xDA:
            chosen = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            stop = at
            while True:
                stop = data.index(b"\xff", stop)
                if data[stop + 1] == 0 or 0xD0 <= data[stop + 1] <= 0xD7:
                    stop += 2
                else:
                    break
            image.scans.append((chosen, _intervals(data[at:stop]), dict(image.huff), image.restart))
            at = stop


def _intervals(scan: bytes) -> list[bytes]:
    """The scan's bytes between restart markers, without stuffing."""
    if b"\xff" not in scan:
        return [scan]
    out, start, at = [], 0, scan.find(b"\xff")
    while at >= 0:
        if scan[at + 1]:
            out.append(scan[start:at])
            start = at + 2
        at = scan.find(b"\xff", at + 2)
    return [x.replace(b"\xff\0", b"\xff") for x in [*out, scan[start:]]]


def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits ahead: symbol * 32 + code length (0: no code)."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = table[k] * 32 + n
            code, k = code + 1, k + 1
        code <<= 1
    return out


def decode(files: list[bytes]) -> list[list[Frame]]:
    """Dimensions and luminance thumbnail of every image in every file, all decoded in step."""
    images, owner = [], []
    for k, data in enumerate(files):
        at = 0
        while at < len(data):
            image, at = parse(data, at)
            images.append(image)
            owner.append(k)
    segments: list[Segment] = []
    shapes = []
    kinds: dict[bytes, int] = {}
    for f, im in enumerate(images):
        most = [max(p[k] for p in im.parts) for k in (1, 2)]
        across, down = -(-im.width // (8 * most[0])), -(-im.height // (8 * most[1]))
        y = im.parts[0]
        shapes.append((y[1], y[2], across, down))
        for chosen, parts, huff, restart in im.scans:
            own = [next(p for p in im.parts if p[0] == c[0]) for c in chosen]
            if len(own) == 1:  # not interleaved: an MCU is one block, and only blocks that hold pixels are there
                p = own[0]
                n = -(-(-(-im.width * p[1] // most[0])) // 8) * -(-(-(-im.height * p[2] // most[1])) // 8)
                blocks = [(0, p)]
            else:
                n, blocks = across * down, [(k, p) for k, p in enumerate(own) for _ in range(p[1] * p[2])]
            tables = tuple((kinds.setdefault(huff[chosen[k][1]], len(kinds)), kinds.setdefault(huff[16 + chosen[k][2]], len(kinds)), im.parts.index(p), len(own) > 1) for k, p in blocks)
            step = restart or n
            segments += [Segment(d, f, min(step, n - k * step), tables) for k, d in enumerate(parts)]
    values = _decode_segments(segments, [_lookup(t) for t in kinds])
    planes = [np.zeros((s[3] * s[1], s[2] * s[0]), np.int32) for s in shapes]
    for f, own in groupby(range(len(segments)), key=lambda k: segments[k].frame):
        wide, high, across, _ = shapes[f]
        im, plane = images[f], planes[f]
        for tables, part in groupby(own, key=lambda k: segments[k].tables):
            lum = [k for k, t in enumerate(tables) if t[2] == 0]
            if not lum:
                continue
            dc = np.concatenate([values[k] for k in part]).reshape(-1, len(tables))
            nth = np.arange(len(dc))
            if tables[0][3]:
                for k in range(wide * high):
                    plane[nth // across * high + k // wide, nth % across * wide + k % wide] = dc[:, lum[k]]
            else:
                row_of = -(-(-(-im.width * im.parts[0][1] // max(p[1] for p in im.parts))) // 8)
                plane[nth // row_of, nth % row_of] = dc[:, 0]
    out: list[list[Frame]] = [[] for _ in files]
    for f, (im, plane) in enumerate(zip(images, planes, strict=True)):
        y, most = im.parts[0], [max(p[k] for p in im.parts) for k in (1, 2)]
        rows, cols = (-(-(-(-n * y[k] // most[k - 1])) // 8) for n, k in ((im.height, 2), (im.width, 1)))
        thumb = (plane[:rows, :cols] * int(im.quant[y[3]][0]) + 4) // 8 + 128
        out[owner[f]].append(Frame(im.width, im.height, np.clip(thumb, 0, 255).astype(np.uint8)))
    return out


def _decode_segments(segments: list[Segment], lookups: list[np.ndarray]) -> list[np.ndarray]:
    """The DC values of all blocks of each segment; one symbol of every segment in each step."""
    if not segments:
        return []
    order = sorted(range(len(segments)), key=lambda k: -segments[k].mcus * len(segments[k].tables))
    done: list[np.ndarray] = [np.empty(0, np.int32)] * len(segments)
    by_kind: dict[tuple, list[int]] = {}
    for k in order:
        by_kind.setdefault(segments[k].tables, []).append(k)
    for tables, own in by_kind.items():
        n = np.array([segments[k].mcus * len(tables) for k in own])
        room = [len(segments[k].data) + 8 for k in own]
        data = np.frombuffer(b"".join(segments[k].data + b"\xff" * 8 for k in own), np.uint8)
        # The 64 bits from each byte on: enough for a DC code, its bits and an AC code.
        ahead = np.zeros(len(data), np.uint64)
        for k in range(8):
            ahead[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(56 - 8 * k)
        bit = 8 * (np.cumsum(room) - room).astype(np.int64)
        found = np.zeros((int(n.max()), len(own)), np.int32)
        last = np.zeros((1 + max(t[2] for t in tables), len(own)), np.int32)
        live = len(own)
        for block in range(int(n.max())):
            while n[live - 1] <= block:  # longest first, so the live ones stay in front
                live -= 1
            dc, ac, part, _ = tables[block % len(tables)]
            at = bit[:live]
            window = ahead[at >> 3] << (at & 7).astype(np.uint64)
            got = lookups[dc][window >> _TOP]
            size = got >> 5 & 15
            window <<= (got & 31).astype(np.uint64)
            raw = (window >> _ONE >> (63 - size).astype(np.uint64)).astype(np.int32)
            window <<= size.astype(np.uint64)
            hit = lookups[ac][window >> _TOP]
            if not (got.all() and hit.all()):
                raise ValueError("not a code of the table")
            last[part, :live] += raw - np.where(raw < _HALF[size], _FULL[size], 0)
            found[block, :live] = last[part, :live]
            at += (got & 31) + size + (hit & 31)
            # On over the AC coefficients: only segments whose block has not ended take part.
            todo = np.flatnonzero(hit >> 5)
            if len(todo):
                symbol = hit[todo] >> 5
                at[todo] += symbol & 15
                coef = 2 + (symbol >> 4)
                while len(todo := todo[more := coef < _ZIGZAG_SIZE]):
                    coef, own_at = coef[more], at[todo]
                    hit = lookups[ac][(ahead[own_at >> 3] << (own_at & 7).astype(np.uint64)) >> _TOP]
                    if not hit.all():
                        raise ValueError("not a code of the table")
                    symbol = hit >> 5
                    at[todo] = own_at + (hit & 31) + (symbol & 15)
                    coef = np.where(symbol == 0, _ZIGZAG_SIZE, coef + (symbol >> 4) + 1)
        found = np.ascontiguousarray(found.T)
        for k, row, m in zip(own, found, n, strict=True):
            done[k] = row[:m]
    return done


def to_media(payload: np.ndarray) -> list[np.ndarray]:
    """The samples of each image of a payload."""
    return [payload[k : k + ROW * MOST_ROWS] for k in range(0, len(payload), ROW * MOST_ROWS)]


def thumbnail_hashes(thumb: np.ndarray) -> tuple[str, str]:
    """64-bit mean and gradient hashes of a thumbnail, from box means of 8 by 9 cells, in hex."""
    small = _box(_box(thumb.astype(np.float64), 8, 0), 9, 1)
    bits = lambda b: np.packbits(b.reshape(-1)).tobytes().hex()
    return bits(small[:, :8] > small[:, :8].mean()), bits(small[:, 1:] > small[:, :-1])


def _box(a: np.ndarray, n: int, axis: int) -> np.ndarray:
    """Means of n even stretches along an axis; a short axis repeats its entries."""
    size = a.shape[axis]
    lo = np.arange(n) * size // n
    hi = np.maximum((np.arange(n) + 1) * size // n, lo + 1)
    zero = np.zeros_like(np.take(a, [0], axis))
    total = np.concatenate([zero, np.cumsum(a, axis)], axis)
    width = (hi - lo).reshape([-1 if k == axis else 1 for k in range(2)])
    return (np.take(total, hi, axis) - np.take(total, lo, axis)) / width


MEDIA = "doc_id bigint, n_bytes bigint, media binary"
FEATURES = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _groups(sizes: list[int], most: int = 4 << 20) -> Iterator[slice]:
    """Stretches of a batch with about ``most`` bytes each, so that what numpy holds is bounded."""
    start = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= most:
            yield slice(start, k + 1)
            start, total = k + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))


def _padded(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0"), np.uint8)


def _media(texts: list[bytes]) -> list[bytes]:
    frames = [to_media(_padded(t)) for t in texts]
    made = iter(encode_frames([f for own in frames for f in own]))
    return [b"".join(next(made) for _ in own) for own in frames]


def _features(media: list[bytes]) -> list[tuple]:
    out = []
    for data, frames in zip(media, decode(media), strict=True):
        payload = b"".join(f.thumb.tobytes() for f in frames)
        dims = "+".join(f"{f.width}x{f.height}" for f in frames)
        a, d = zip(*(thumbnail_hashes(f.thumb) for f in frames), strict=True)
        out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), f"jpeg {dims} mean={'+'.join(a)} gradient={'+'.join(d)}"))
    return out


def to_jpeg(docs: DataFrame) -> DataFrame:
    """The stored form: doc_id, n_bytes and media, the JPEG file(s) of each text's bytes."""

    def run(batches):
        for b in batches:
            texts = [t.encode() for t in b["text"].to_pylist()]
            for part in _groups([len(t) for t in texts]):
                yield pa.RecordBatch.from_arrays([b["doc_id"][part.start : part.stop], pa.array([len(t) for t in texts[part]], pa.int64()), pa.array(_media(texts[part]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint"), text_or_empty().alias("text")), run, MEDIA, heavy="text")


def media_features(stored: DataFrame) -> DataFrame:
    """What the stored files give back: payload digests, sizes, dimensions and thumbnail hashes."""

    def run(batches):
        for b in batches:
            media = b["media"].to_pylist()
            for part in _groups([len(m) for m in media]):
                own = list(zip(*_features(media[part]), strict=True))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([b[c][part.start : part.stop] for c in ("doc_id", "n_bytes")] + [pa.array(c, t) for c, t in zip(own, kinds, strict=True)], names=[x.split()[0] for x in FEATURES.split(", ")])

    return map_arrow(stored, run, FEATURES, heavy="media")
