"""Media columns: baseline JPEG bytes to dimensions and hashes of a DC-only thumbnail, in numpy.

The decoder parses the markers, Huffman-decodes the scan that holds the first component (all
coefficients have to be walked through, only luminance DC values are kept) and builds the
thumbnail at an eighth of the size: a pixel is the mean of an 8 x 8 block. Restart segments are
independent streams, so the segments of all images of a batch are decoded in lockstep: one
numpy step decodes one symbol of each of them.

Supported: SOF0 and 8-bit SOF1, 1 to 4 components, any sampling factors, restart intervals,
interleaved or separate scans. `status` is ok, null (no bytes), not_jpeg, unsupported
(progressive, arithmetic, 12 bit ...) or corrupt (broken headers, codes or a scan that ends
early); in all but ok the thumbnail columns are null, and dimensions too unless a frame header
was read. Repeated rows give equal results; rows with a null id are decoded too; an empty
table gives an empty result.

The tables of this project hold no images, so `page_images` makes them: each page's whole HTML
becomes a picture (64 bytes a block), encoded here as grey, 4:2:0 or 4:4:4 JPEG with and without
restart intervals. The operator itself takes any table with a binary column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colpattern.llm.common import batch, spread

SCHEMA = "id long, status string, width int, height int, components int, thumb_width int, thumb_height int, thumb_dhash long, thumb_hash long"
_OUT = pa.schema([("id", pa.int64()), ("status", pa.string()), *((c, pa.int32()) for c in ("width", "height", "components", "thumb_width", "thumb_height")), ("thumb_dhash", pa.int64()), ("thumb_hash", pa.int64())])
#: Bytes of scans that are decoded in lockstep.
LOCKSTEP = 1 << 21
#: Most distinct Huffman tables of a lockstep group.
TABLES = 64


class Bad(ValueError):
    """A stream that cannot be decoded; the message is the status."""


@dataclass
class Image:
    width: int = 0
    height: int = 0
    #: id -> (h, v, quantisation table)
    components: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    #: (component, DC table bytes, AC table bytes) of each component of the scan
    scan: list[tuple[int, bytes, bytes]] = field(default_factory=list)
    segments: list[bytes] = field(default_factory=list)
    interval: int = 0
    quant: float = 1.0

    def luma(self) -> tuple[int, int, int, int]:
        """(blocks across and down of the first component, h, v in an MCU of the scan)."""
        h, v, _ = next(iter(self.components.values()))
        hm, vm = max(c[0] for c in self.components.values()), max(c[1] for c in self.components.values())
        across, down = -(-(-(-self.width * h // hm)) // 8), -(-(-(-self.height * v // vm)) // 8)
        return across, down, *((h, v) if len(self.scan) > 1 else (1, 1))

    def mcus(self) -> tuple[int, int]:
        if len(self.scan) == 1:
            return self.luma()[:2]
        hm, vm = max(c[0] for c in self.components.values()), max(c[1] for c in self.components.values())
        return -(-self.width // (8 * hm)), -(-self.height // (8 * vm))

    def cycle(self) -> list[int]:
        """Which component of the scan each block of an MCU belongs to."""
        if len(self.scan) == 1:
            return [0]
        return [k for k, (c, _, _) in enumerate(self.scan) for _ in range(self.components[c][0] * self.components[c][1])]


_SCAN_END = re.compile(rb"\xff+[^\x00\xd0-\xd7\xff]")
_RESTART = re.compile(rb"\xff+[\xd0-\xd7]")


def parse(data: bytes) -> Image:
    """The headers of a stream and the bytes of the scan of its first component."""
    if data[:2] != b"\xff\xd8":
        raise Bad("not_jpeg")
    img, at, quant, huff = Image(), 2, {}, {}
    n = len(data)
    while True:
        while at < n and data[at] == 0xFF and at + 1 < n and data[at + 1] == 0xFF:
            at += 1
        if at + 4 > n or data[at] != 0xFF:
            raise _bad(img, "corrupt")
        mark = data[at + 1]
        at += 2
        if mark == 0xD9:
            raise _bad(img, "corrupt")
        if mark == 0x01 or 0xD0 <= mark <= 0xD8:
            continue
        size = data[at] << 8 | data[at + 1]
        if size < 2 or at + size > n:
            raise _bad(img, "corrupt")
        part, at = data[at + 2 : at + size], at + size
        if mark == 0xDB:
            while part:
                wide, ident = part[0] >> 4, part[0] & 15
                need = 1 + 64 * (1 + wide)
                if wide > 1 or len(part) < need:
                    raise _bad(img, "corrupt")
                quant[ident] = part[1] << 8 | part[2] if wide else part[1]
                part = part[need:]
        elif mark == 0xC4:
            while part:
                need = 17 + sum(part[1:17])
                if len(part) < need or len(part) < 17:
                    raise _bad(img, "corrupt")
                huff[part[0]] = part[1:need]
                part = part[need:]
        elif mark == 0xDD and len(part) >= 2:
            img.interval = part[0] << 8 | part[1]
        elif mark in (0xC0, 0xC1):
            if len(part) < 6 or len(part) < 6 + 3 * part[5]:
                raise _bad(img, "corrupt")
            img.height, img.width = part[1] << 8 | part[2], part[3] << 8 | part[4]
            for k in range(part[5]):
                c, hv, q = part[6 + 3 * k : 9 + 3 * k]
                img.components[c] = (hv >> 4, hv & 15, q)
            if part[0] != 8:
                raise _bad(img, "unsupported")
            if not (img.width and img.height and img.components) or len(img.components) > 4 or not all(1 <= h <= 4 and 1 <= v <= 4 for h, v, _ in img.components.values()):
                raise _bad(img, "corrupt")
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            if len(part) >= 6:
                img.height, img.width = part[1] << 8 | part[2], part[3] << 8 | part[4]
            raise _bad(img, "unsupported")
        elif mark == 0xDA:
            if not img.components or not part or len(part) < 1 + 2 * part[0]:
                raise _bad(img, "corrupt")
            ends = _SCAN_END.search(data, at)
            end = ends.start() if ends else n
            first = next(iter(img.components))
            ids = [part[1 + 2 * k] for k in range(part[0])]
            if first in ids:
                try:
                    img.scan = [(c, huff[part[2 + 2 * k] >> 4], huff[0x10 | part[2 + 2 * k] & 15]) for k, c in enumerate(ids)]
                    img.quant = quant[img.components[first][2]]
                    _ = [img.components[c] for c in ids]
                except KeyError:
                    raise _bad(img, "corrupt") from None
                body = data[at:end]
                pieces = _RESTART.split(body) if img.interval else [body]
                img.segments = [p.replace(b"\xff\x00", b"\xff") for p in pieces]
                return img
            at = end


def _bad(img: Image, status: str) -> Bad:
    e = Bad(status)
    e.size = (img.width, img.height, len(img.components)) if img.width and img.height else None
    return e


def lookup(table: bytes) -> np.ndarray:
    """[65536] code length << 8 | symbol for the next 16 bits; 0 where no code begins so."""
    out = np.zeros(1 << 16, np.uint16)
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            lo = code << (16 - n)
            out[lo : lo + (1 << (16 - n))] = n << 8 | table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def decode(images: list[Image]) -> list[np.ndarray | None]:
    """The luminance thumbnail of each image, or None where its scan is broken."""
    names: dict[bytes, int] = {}
    for img in images:
        for _, dc, ac in img.scan:
            names.setdefault(dc, len(names))
            names.setdefault(ac, len(names))
    lut = np.stack([lookup(t) for t in names])
    cyc = max(len(i.cycle()) for i in images)
    dc, ac, own = (np.zeros((len(images), cyc), np.int64) for _ in range(3))
    length = np.zeros(len(images), np.int64)
    seg_img, seg_mcus, bodies, broken = [], [], [], np.zeros(len(images), bool)
    for i, img in enumerate(images):
        c = img.cycle()
        length[i] = len(c)
        first = next(k for k, s in enumerate(img.scan) if s[0] == next(iter(img.components)))
        for b, k in enumerate(c):
            dc[i, b], ac[i, b], own[i, b] = names[img.scan[k][1]], names[img.scan[k][2]], k == first
        mx, my = img.mcus()
        left = mx * my
        for body in img.segments:
            take = min(left, img.interval or left)
            if take <= 0:
                break
            seg_img.append(i)
            seg_mcus.append(take)
            bodies.append(body)
            left -= take
        broken[i] = left > 0
    si, mcus = np.array(seg_img), np.array(seg_mcus)
    blocks = mcus * length[si]
    luma = mcus * own.sum(1)[si]
    base = np.concatenate([[0], np.cumsum(luma)])
    out = np.zeros(int(base[-1]))
    sizes = np.array([len(b) for b in bodies])
    start = np.concatenate([[0], np.cumsum(sizes + 8)])
    raw = np.frombuffer(b"".join(b + b"\0" * 8 for b in bodies) + b"\0" * 8, np.uint8)
    n = len(raw) - 7
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | raw[k : k + n]
    pos, limit = start[:-1] * 8, (start[:-1] + sizes) * 8
    s = np.flatnonzero(blocks > 0)
    img_, b, k, pred, put, left = si[s], np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), base[:-1][s].copy(), blocks[s].copy()
    p, end = pos[s].copy(), limit[s]
    u = np.uint64
    while len(s):
        w = word[p >> 3] << (p & 7).astype(u)
        is_dc = k == 0
        entry = lut[np.where(is_dc, dc[img_, b], ac[img_, b]), (w >> u(48)).astype(np.int64)]
        n_code, sym = (entry >> 8).astype(np.int64), (entry & 0xFF).astype(np.int64)
        size = np.where(is_dc, np.minimum(sym, 16), sym & 15)
        at = np.flatnonzero(is_dc & (own[img_, b] > 0))
        if len(at):
            z = size[at]
            bits = np.where(z > 0, (w[at] << n_code[at].astype(u)) >> (64 - np.maximum(z, 1)).astype(u), u(0)).astype(np.int64)
            pred[at] += np.where(bits < (1 << np.maximum(z, 1) >> 1), bits - (1 << z) + 1, bits) * (z > 0)
            out[put[at]] = pred[at]
            put[at] += 1
        p += n_code + size
        run = sym >> 4
        k = np.where(is_dc, 1, np.where(size > 0, k + run + 1, np.where(run == 15, k + 16, 64)))
        over = k >= 64
        left -= over
        b = np.where(over, b + 1, b)
        b[b == length[img_]] = 0
        k[over] = 0
        wrong = (n_code == 0) | (p > end)
        if wrong.any():
            broken[img_[wrong]] = True
        go = ~(wrong | (left == 0))
        if not go.all():
            s, img_, b, k, pred, put, left, p, end = (x[go] for x in (s, img_, b, k, pred, put, left, p, end))
    ends = np.concatenate([np.flatnonzero(np.diff(si)) + 1, [len(si)]]) if len(si) else []
    last = dict(zip(si[np.asarray(ends, int) - 1].tolist(), ends, strict=True)) if len(si) else {}
    firsts = {i: int(np.searchsorted(si, i)) for i in last}
    return [None if broken[i] or i not in last else _thumb(img, out[base[firsts[i]] : base[last[i]]]) for i, img in enumerate(images)]


def _thumb(img: Image, values: np.ndarray) -> np.ndarray:
    across, down, h, v = img.luma()
    mx, my = img.mcus()
    plane = values.reshape(my, mx, v, h).transpose(0, 2, 1, 3).reshape(my * v, mx * h)[:down, :across]
    return np.clip(np.rint(plane * img.quant / 8 + 128), 0, 255).astype(np.uint8)


def dhash(thumb: np.ndarray) -> int:
    """64 bits: whether brightness falls from left to right, on a 9 x 8 grid."""
    h, w = thumb.shape
    grid = thumb[(np.arange(8) * h // 8)[:, None], np.arange(9) * w // 9].astype(np.int64)
    bits = np.packbits((grid[:, :-1] > grid[:, 1:]).ravel())
    return int(bits.view(">i8")[0])


def describe(blobs: list[bytes | None]) -> list[tuple]:
    """(status, width, height, components, thumb_width, thumb_height, thumb_dhash, thumb_hash) of each."""
    rows: list[tuple] = [("null",) + (None,) * 7] * len(blobs)
    group: list[tuple[int, Image]] = []
    bulk, tables = 0, set()

    def flush() -> None:
        for (i, img), thumb in zip(group, decode([g[1] for g in group]) if group else [], strict=True):
            head = (img.width, img.height, len(img.components))
            if thumb is None:
                rows[i] = ("corrupt", *head, None, None, None, None)
            else:
                full = xxhash.xxh64_intdigest(np.int32(thumb.shape).tobytes() + thumb.tobytes())
                rows[i] = ("ok", *head, thumb.shape[1], thumb.shape[0], dhash(thumb), full - (full >> 63 << 64))
        group.clear()
        tables.clear()

    for i, blob in enumerate(blobs):
        if blob is None or not len(blob):
            continue
        try:
            img = parse(bytes(blob))
        except Bad as e:
            rows[i] = (str(e), *(getattr(e, "size", None) or (None,) * 3), None, None, None, None)
            continue
        own = {t for s in img.scan for t in s[1:]}
        if group and (bulk + len(blob) > LOCKSTEP or len(tables | own) > TABLES):
            flush()
            bulk = 0
        group.append((i, img))
        tables |= own
        bulk += len(blob)
    flush()
    return rows


def _describe(batches):
    for b in batches:
        rows = describe(b.column("image").to_pylist())
        yield batch(_OUT, b.column("id"), *([r[c] for r in rows] for c in range(8)))


def media_columns(images: DataFrame, key: str = "page_id", image: str = "image") -> DataFrame:
    """(key, status, width, height, components, thumb_width, thumb_height, thumb_dhash, thumb_hash) of each row."""
    own = images.select(F.col(key).cast("long").alias("id"), F.col(image).cast("binary").alias("image"))
    return own.mapInArrow(_describe, SCHEMA).withColumnRenamed("id", key)


# ------------------------------------------------ encoder, for tables without images
def _huffman(counts: list[int], symbols: list[int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    table = bytes(counts) + bytes(symbols)
    codes, lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code, at = 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            codes[symbols[at]], lengths[symbols[at]] = code, n
            code, at = code + 1, at + 1
        code <<= 1
    return table, codes, lengths


_DC = _huffman([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
#: End of block, then (run, size) for runs 0 and 1 and sizes 1 to 10.
_AC = _huffman([0, 1, 2, 3, 4, 5, 6, 0, 0, 0, 0, 0, 0, 0, 0, 0], [0x00, 0x01, 0x02, 0x03, 0x04, 0x05, 0x06, 0x11, 0x12, 0x13, 0x14, 0x07, 0x08, 0x15, 0x16, 0x17, 0x18, 0x09, 0x19, 0x0A, 0x1A])
_QUANT = 8


def encode(planes: list[np.ndarray], width: int, height: int, sampling: int = 1, interval: int = 0) -> bytes:
    """A baseline JPEG from quantised coefficients: planes[c] is [rows, columns, 3] with the DC and the
    first two AC values of each block, padded to whole MCUs; luminance is sampled `sampling` times
    as finely as the others in both directions. One plane: grey."""
    s = sampling if len(planes) > 1 else 1
    my, mx = planes[0].shape[0] // s, planes[0].shape[1] // s
    parts = [planes[0].reshape(my, s, mx, s, 3).transpose(0, 2, 1, 3, 4).reshape(my * mx, s * s, 3)] + [p.reshape(my * mx, 1, 3) for p in planes[1:]]
    owner = np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts])
    seq = np.concatenate(parts, axis=1).astype(np.int64)
    seg = np.arange(my * mx) // interval if interval else np.zeros(my * mx, np.int64)
    value = seq.copy()
    for c in range(len(parts)):
        flat = seq[:, owner == c, 0].ravel()
        before = np.concatenate([[0], flat[:-1]])
        before[np.repeat(np.concatenate([[True], seg[1:] != seg[:-1]]), parts[c].shape[1]) & (np.arange(len(flat)) % parts[c].shape[1] == 0)] = 0
        value[:, owner == c, 0] = (flat - before).reshape(my * mx, -1)
    v = value.reshape(-1, 3)
    size = np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)
    low = np.where(v < 0, v + (1 << size) - 1, v)
    code, bits = np.zeros((len(v), 4), np.int64), np.zeros((len(v), 4), np.int64)
    code[:, 0], bits[:, 0] = _DC[1][size[:, 0]] << size[:, 0] | low[:, 0], _DC[2][size[:, 0]] + size[:, 0]
    for k in (1, 2):
        sym = size[:, k] | ((v[:, 1] == 0).astype(np.int64) << 4 if k == 2 else 0)
        some = v[:, k] != 0
        code[:, k] = np.where(some, _AC[1][sym] << size[:, k] | low[:, k], 0)
        bits[:, k] = np.where(some, _AC[2][sym] + size[:, k], 0)
    code[:, 3], bits[:, 3] = _AC[1][0], _AC[2][0]
    code, bits, of = code.ravel(), bits.ravel(), np.repeat(seg, seq.shape[1] * 4)
    at = np.repeat(np.arange(len(bits)), bits)
    stream = ((code[at] >> (bits[at] - 1 - spread(bits))) & 1).astype(np.uint8)
    ends = np.cumsum(np.bincount(of, weights=bits).astype(np.int64))
    body = []
    for k, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
        padded = np.concatenate([stream[lo:hi], np.ones(-(hi - lo) % 8, np.uint8)])
        body.append((b"" if not k else bytes([0xFF, 0xD0 | (k - 1) % 8])) + np.packbits(padded).tobytes().replace(b"\xff", b"\xff\x00"))

    def mark(kind: int, part: bytes) -> bytes:
        return bytes([0xFF, kind]) + (len(part) + 2).to_bytes(2, "big") + part

    comps = b"".join(bytes([c + 1, (s << 4 | s) if c == 0 else 0x11, 0]) for c in range(len(planes)))
    head = mark(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + mark(0xDB, bytes([0] + [_QUANT] * 64)) + mark(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(planes)]) + comps)
    head += mark(0xC4, b"\x00" + _DC[0] + b"\x10" + _AC[0]) + (mark(0xDD, interval.to_bytes(2, "big")) if interval else b"")
    scan = mark(0xDA, bytes([len(planes)]) + b"".join(bytes([c + 1, 0]) for c in range(len(planes))) + b"\0\x3f\0")
    return b"\xff\xd8" + head + scan + b"".join(body) + b"\xff\xd9"


def picture(data: bytes, kind: int) -> bytes:
    """The bytes as a picture, 64 a block: grey, 4:2:0 or 4:4:4 by kind modulo 3, restarts by kind modulo 5."""
    n = max(1, -(-len(data) // 64))
    across = int(np.ceil(np.sqrt(n)))
    down = -(-n // across)
    grey, s = kind % 3 == 0, 2 if kind % 3 == 1 else 1
    wide, high = -(-across // s) * s, -(-down // s) * s
    cells = np.zeros((wide * high, 64))
    cells.ravel()[: len(data)] = np.frombuffer(data, np.uint8)
    if wide != across:
        cells = np.zeros((high, wide, 64))
        own = np.zeros((down * across, 64))
        own.ravel()[: len(data)] = np.frombuffer(data, np.uint8)
        cells[:down, :across] = own.reshape(down, across, 64)
    cells = cells.reshape(high, wide, 8, 8)
    mean = np.rint(cells.mean((2, 3)) - 128)
    tilt = [np.clip(np.rint((a.mean((2, 3)) - b.mean((2, 3))) / 4), -100, 100) for a, b in ((cells[..., :4], cells[..., 4:]), (cells[:, :, :4], cells[:, :, 4:]))]
    luma = np.stack([mean, *tilt], axis=-1)
    planes = [luma] if grey else [luma, luma[::s, ::s] // 2, -luma[::s, ::s] // 2]
    width, height = max(1, across * 8 - kind % 7), max(1, down * 8 - kind % 5)
    return encode(planes, width, height, s, 4 if kind % 5 == 0 else 0)


def _pictures(batches):
    schema = pa.schema([("page_id", pa.int64()), ("image", pa.binary())])
    for b in batches:
        rows = [None if h is None else picture(h.encode(), 0 if i is None else i) for i, h in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True)]
        yield batch(schema, b.column("page_id"), rows)


def page_images(pages: DataFrame) -> DataFrame:
    """(page_id, image): each page's HTML as a JPEG; null HTML has none."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(_pictures, "page_id long, image binary")
