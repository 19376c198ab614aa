"""Media columns: baseline JPEG in numpy (operator 1).

``decode`` reads baseline JPEG files: it parses the markers, Huffman-decodes
the scan, and rebuilds the DC-only luminance thumbnail (one sample per 8 x 8
block), from which dimensions and thumbnail hashes are stored.  All restart
intervals of all images of a batch are decoded in step: each round takes the
next code of every interval still open, so the work is vector work however
the images are cut.

``encode`` stores bytes as such an image without loss.  The format's unit is
the quantised coefficient: 64 payload bytes are the 64 coefficients, in zigzag
order, of one block of a grey image.  Each block is a restart interval, so a
block never depends on another.  The payload's length stands in a comment
segment, since the block grid may be a few blocks larger.

Defined results: a null text counts as empty; a payload is the text's UTF-8
bytes filled with zero bytes to a positive multiple of 64; equal texts give
equal values; rows are independent, so repeated rows, ties, null ids, empty
tables and further columns need nothing special.  A file that is no baseline
JPEG, or is cut short, decodes to a row with ``error`` set and no features.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pointweave.llm.common import small_batches

#: Blocks of a grid row that :func:`encode` makes, and blocks coded at a time.
GRID, CHUNK = 256, 16_384

U64 = np.uint64


def _canonical(lengths: list[int], symbols: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code and length of each symbol, and (length << 8 | symbol) of each 16-bit prefix."""
    code, k = 0, 0
    codes, sizes, prefix = np.zeros(256, U64), np.zeros(256, np.int64), np.zeros(1 << 16, np.uint16)
    for size, n in enumerate(lengths, 1):
        for _ in range(n):
            if code >> size:
                raise ValueError("overfull Huffman table")
            s = symbols[k]
            codes[s], sizes[s] = code, size
            prefix[code << 16 - size : code + 1 << 16 - size] = size << 8 | s
            code, k = code + 1, k + 1
        code <<= 1
    return codes, sizes, prefix


def _spread(symbols: list[int], sizes: dict[int, int]) -> tuple[list[int], bytes]:
    """DHT form of a table given by the code length of each symbol."""
    ordered = sorted(symbols, key=lambda s: (sizes[s], s))
    lengths = [sum(sizes[s] == n for s in symbols) for n in range(1, 17)]
    return lengths, bytes(ordered)


# The encoder's own tables: short codes for the sizes that text bytes have.
_DC = _spread(list(range(12)), {s: 2 if s == 7 else 3 if s == 6 else 5 if s in (5, 8) else 7 for s in range(12)})
_AC_SYMBOLS = [0x00, 0xF0, *(r << 4 | s for r in range(16) for s in range(1, 11))]
_AC = _spread(_AC_SYMBOLS, {a: {0x07: 1, 0x06: 2, 0x00: 4, 0x08: 5, 0x04: 6, 0x05: 6, 0x03: 7, 0x02: 8, 0x01: 9, 0xF0: 10}.get(a, 16 if a >> 4 > 3 else 13) for a in _AC_SYMBOLS})
_DC_CODE, _DC_SIZE, _ = _canonical(*_DC)
_AC_CODE, _AC_SIZE, _ = _canonical(*_AC)
_CATEGORY = np.array([v.bit_length() for v in range(256)], np.int64)
_VALUES = np.arange(256, dtype=U64)
_DC_WORD, _DC_BITS = _DC_CODE[_CATEGORY] << _CATEGORY.astype(U64) | _VALUES, _DC_SIZE[_CATEGORY] + _CATEGORY
_AC_WORD, _AC_BITS = _AC_CODE[_CATEGORY] << _CATEGORY.astype(U64) | _VALUES, _AC_SIZE[_CATEGORY] + _CATEGORY
_AC_WORD[0], _AC_BITS[0] = 0, 0


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _coded(blocks: np.ndarray, number: int) -> bytes:
    """Entropy-coded data of blocks[n, 64], each an interval; ``number`` have gone before."""
    n = len(blocks)
    # one code word of up to 58 bits for each coefficient: ZRLs, code, value bits
    word = np.zeros((n, 65), U64)
    bits = np.zeros((n, 65), np.int64)
    word[:, :1], bits[:, :1] = _DC_WORD[blocks[:, :1]], _DC_BITS[blocks[:, :1]]
    word[:, 1:64], bits[:, 1:64] = _AC_WORD[blocks[:, 1:]], _AC_BITS[blocks[:, 1:]]
    # blocks with zeros: a code word also names the run of zeros before it
    holed = np.flatnonzero((blocks[:, 1:] == 0).any(1))
    v = blocks[holed, 1:].astype(np.int64)
    present, size = v > 0, _CATEGORY[v]
    last = np.maximum.accumulate(np.where(present, np.arange(1, 64), 0), axis=1)
    before = np.zeros_like(last)
    before[:, 1:] = last[:, :-1]
    zeros = np.arange(1, 64) - before - 1
    row, col = np.nonzero(present & (zeros > 0))
    run, size, v = zeros[row, col], size[row, col], v[row, col]
    symbol = (run & 15) << 4 | size
    own, length = _AC_CODE[symbol] << size.astype(U64) | v.astype(U64), _AC_SIZE[symbol] + size
    for k in range(3):
        far = run > 16 * k + 15
        own[far] |= _AC_CODE[0xF0] << length[far].astype(U64)
        length[far] += _AC_SIZE[0xF0]
    word[holed[row], col + 1], bits[holed[row], col + 1] = own, length
    # the last slot: end of block where the tail is zero, then ones to a whole byte
    tail = blocks[:, 63] == 0
    word[tail, 64], bits[tail, 64] = _AC_CODE[0], _AC_SIZE[0]
    fill = -bits.sum(1) & 7
    word[:, 64] = word[:, 64] << fill.astype(U64) | (U64(1) << fill.astype(U64)) - U64(1)
    bits[:, 64] += fill
    lengths = bits.sum(1) >> 3
    # pack: each word falls into one or two 64-bit cells; words of a cell are neighbours
    word, bits = word.ravel(), bits.ravel()
    used = bits > 0
    word, bits = word[used], bits[used]
    end = np.cumsum(bits)
    start = end - bits
    cell, room = start >> 6, 64 - (start & 63)
    over = bits - room
    spill = over > 0
    head = np.where(spill, word >> np.maximum(over, 0).astype(U64), word << np.maximum(-over, 0).astype(U64))
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    cells = np.zeros((int(end[-1]) >> 6) + 2, U64)
    cells[cell[first]] = np.bitwise_or.reduceat(head, first)
    cells[cell[spill] + 1] |= word[spill] << (64 - over[spill]).astype(U64)
    raw = cells.astype(">u8").view(np.uint8)[: int(end[-1]) >> 3]
    # a zero byte after each 0xFF, a restart marker before each block but the first of all
    stuffed = np.cumsum(raw == 0xFF)
    block = np.repeat(np.arange(n), lengths)
    lead = 2 if number else 0
    at = np.arange(len(raw)) + np.r_[0, stuffed[:-1]] + 2 * block + lead
    out = np.zeros(len(raw) + int(stuffed[-1]) + 2 * (n - 1) + lead, np.uint8)
    out[at] = raw
    begin = at[np.r_[0, np.cumsum(lengths)[:-1]]]
    which = np.arange(0 if number else 1, n)
    out[begin[which] - 2] = 0xFF
    out[begin[which] - 1] = 0xD0 + (number + which - 1) % 8
    return out.tobytes()


def encode(payload: bytes) -> bytes:
    """A baseline JPEG whose coefficients are the payload (a multiple of 64 bytes)."""
    n = len(payload) // 64
    wide = min(n, GRID)
    high = -(-n // wide)
    while high * 8 > 65535:
        wide *= 2
        high = -(-n // wide)
    head = b"".join([
        b"\xff\xd8",
        _segment(0xDB, b"\x00" + bytes([1] * 64)),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, high * 8, wide * 8, 1, 1, 0x11, 0)),
        *(_segment(0xC4, bytes([kind]) + bytes(lengths) + symbols) for kind, (lengths, symbols) in ((0x00, _DC), (0x10, _AC))),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xFE, b"payload %d" % len(payload)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])
    blocks = np.frombuffer(payload, np.uint8).reshape(n, 64)
    blocks = np.concatenate([blocks, np.zeros((wide * high - n, 64), np.uint8)])
    return b"".join([head, *(_coded(blocks[i : i + CHUNK], i) for i in range(0, len(blocks), CHUNK)), b"\xff\xd9"])


class Frame:
    """What the markers of one file say."""

    def __init__(self, data: bytes) -> None:
        if data[:2] != b"\xff\xd8":
            raise ValueError("no SOI marker")
        self.restart, self.comment = 0, b""
        self.quant: dict[int, list[int]] = {}
        self.tables: dict[int, np.ndarray] = {}
        self.parts: list[list[int]] = []  # id, h, v, quantiser, dc table, ac table
        at = 2
        while True:
            if at + 4 > len(data):
                raise ValueError("cut short before the scan")
            if data[at] != 0xFF:
                raise ValueError("no marker where one must be")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            size = data[at + 2] << 8 | data[at + 3]
            body = data[at + 4 : at + 2 + size]
            if len(body) != size - 2:
                raise ValueError("segment cut short")
            at += 2 + size
            if marker == 0xC0:
                depth, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
                if depth != 8 or not self.height or not self.width:
                    raise ValueError("not 8-bit samples of known size")
                self.parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i], 0, 0] for i in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = _canonical(list(body[1:17]), body[17 : 17 + n])[2]
                    body = body[17 + n :]
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = list(struct.unpack(">64H", body[1:129]) if wide else body[1:65])
                    body = body[129 if wide else 65 :]
            elif marker == 0xDD:
                self.restart = body[0] << 8 | body[1]
            elif marker == 0xFE:
                self.comment = body
            elif marker == 0xDA:
                if not self.parts or body[0] != len(self.parts):
                    raise ValueError("not one interleaved scan")
                for i in range(body[0]):
                    part = next(p for p in self.parts if p[0] == body[1 + 2 * i])
                    part[4], part[5] = body[2 + 2 * i] >> 4, 0x10 | body[2 + 2 * i] & 15
                break
        self.scan = at
        if len(self.parts) == 1:
            self.parts[0][1:3] = [1, 1]
        self.most = [max(p[k] for p in self.parts) for k in (1, 2)]
        self.across = -(-self.width // (8 * self.most[0]))
        self.down = -(-self.height // (8 * self.most[1]))
        #: the part that each block of an MCU belongs to
        self.order = [i for i, p in enumerate(self.parts) for _ in range(p[1] * p[2])]
        self.mcus = self.across * self.down


def _intervals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scan bytes without stuffing and markers; first byte and end of each interval."""
    after = np.r_[data[1:], np.uint8(0xD9)]
    mark = (data == 0xFF) & (after != 0)
    stop = np.flatnonzero(mark & ((after & 0xF8) != 0xD0) & (after != 0xFF))
    n = int(stop[0]) if len(stop) else len(data)
    data, after, mark = data[:n], after[:n], mark[:n]
    gone = mark.copy()
    gone[1:] |= (data[:-1] == 0xFF)
    bounds = np.flatnonzero(mark)
    kept = np.cumsum(~gone)
    cut = kept[bounds] if n else bounds
    clean = data[~gone]
    return clean, np.r_[0, cut], np.r_[cut, len(clean)]


def decode(files: list[bytes | None]) -> list[tuple[Frame, np.ndarray, np.ndarray] | str]:
    """For each file its frame, the coefficients [block, 64] in scan order and the part of each block; or what is wrong."""
    out: list = [None] * len(files)
    lanes, tables, luts = [], {}, []
    clean_at, block_at, cleaned = 0, 0, []
    frames: dict[int, tuple[Frame, int, int]] = {}
    for i, data in enumerate(files):
        try:
            if data is None:
                raise ValueError("no file")
            frame = Frame(data)
            clean, lo, hi = _intervals(np.frombuffer(data, np.uint8)[frame.scan :])
            each = frame.restart or frame.mcus
            want = -(-frame.mcus // each)
            if len(lo) != want:
                raise ValueError("restart intervals are missing")
            own = []
            for part in frame.parts:
                for kind in (part[4], part[5]):
                    key = frame.tables[kind].tobytes()
                    if key not in tables:
                        tables[key] = len(luts)
                        luts.append(frame.tables[kind])
                    own.append(tables[key])
        except (ValueError, KeyError, IndexError, StopIteration, struct.error) as e:
            out[i] = f"{e}" or "malformed"
            continue
        per = len(frame.order)
        first = np.arange(want) * each * per
        last = np.minimum(first + each * per, frame.mcus * per)
        lanes.append((i, clean_at + lo, clean_at + hi, block_at + first, block_at + last, own, frame.order))
        frames[i] = (frame, block_at, block_at + frame.mcus * per)
        cleaned += [clean, np.full(9, 0xFF, np.uint8)]
        clean_at += len(clean) + 9
        block_at += frame.mcus * per
    if not lanes:
        return out
    coefficients = np.zeros((block_at, 64), np.int16)
    lut = np.stack(luts)
    layouts: dict[tuple, int] = {}
    plan_dc, plan_ac, plan_part = [], [], []
    for lane in lanes:
        key = (tuple(lane[5]), tuple(lane[6]))
        if key not in layouts:
            layouts[key] = len(plan_dc)
            plan_dc.append([lane[5][2 * p] for p in lane[6]])
            plan_ac.append([lane[5][2 * p + 1] for p in lane[6]])
            plan_part.append(lane[6])
    wide = max(map(len, plan_dc))
    pad = lambda rows: np.array([r + [0] * (wide - len(r)) for r in rows])
    plan_dc, plan_ac, plan_part, plan_size = pad(plan_dc), pad(plan_ac), pad(plan_part), np.array([len(r) for r in plan_part])
    buffer = np.concatenate(cleaned)
    window = np.ndarray(len(buffer) - 8, ">u8", buffer, strides=(1,)).astype(U64)
    count = [len(lane[1]) for lane in lanes]
    image = np.repeat([lane[0] for lane in lanes], count)
    layout = np.repeat([layouts[tuple(lane[5]), tuple(lane[6])] for lane in lanes], count)
    at, end, block, last = (np.concatenate([lane[k] for lane in lanes]) for k in (1, 2, 3, 4))
    at, end = at * 8, end * 8
    index, k = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    prior = np.zeros((len(at), max(len(f[0].parts) for f in frames.values())), np.int64)
    wrong: set[int] = set()
    lut, flat = lut.ravel(), coefficients.ravel()
    base_dc, base_ac = plan_dc[layout, 0] << 16, plan_ac[layout, 0] << 16
    while len(at):
        is_dc = k == 0
        some_dc = bool(is_dc.any())
        if wide > 1:
            unit = index % plan_size[layout]
            base_dc, base_ac = plan_dc[layout, unit] << 16, plan_ac[layout, unit] << 16
        bits = window[at >> 3] << (at & 7).astype(U64)
        entry = lut[(np.where(is_dc, base_dc, base_ac) if some_dc else base_ac) + (bits >> U64(48)).view(np.int64)].astype(np.int64)
        length, size = entry >> 8, entry & 15
        run = (entry >> 4) & 15
        if some_dc:
            run[is_dc] = 0
        # value bits follow the code; size 0 shifts all of them out
        value = (bits << length.astype(U64) >> U64(1) >> (63 - size).astype(U64)).view(np.int64)
        value -= (((value << 1) >> size) == 0) * ((1 << size) - 1)
        at = at + length + size
        k = k + run
        bad = (length == 0) | (at > end) | (k > 63) | (size > 11)
        if some_dc:
            row = np.flatnonzero(is_dc)
            part = plan_part[layout[row], unit[row]] if wide > 1 else 0
            prior[row, part] += value[row]
            value[row] = prior[row, part]
        over = (size == 0) & (run < 15)
        if some_dc:
            over &= ~is_dc
        if bad.any():
            put = ~bad
            flat[(block * 64 + k)[put]] += value[put].astype(np.int16)
        else:
            flat[block * 64 + k] += value.astype(np.int16)  # zero where no value came
        k = k + 1
        k[over] = 64
        done = k > 63
        closed = bad
        if done.any():
            block, index = block + done, index + done
            k[done] = 0
            closed = (block >= last) | bad
        if closed.any():
            wrong.update(image[bad].tolist())
            stay = ~closed
            at, end, block, last, index, k, layout, image, prior, base_dc, base_ac = (x[stay] for x in (at, end, block, last, index, k, layout, image, prior, base_dc, base_ac))
    for i, (frame, lo, hi) in frames.items():
        out[i] = "damaged scan" if i in wrong else (frame, coefficients[lo:hi], np.tile(np.array(frame.order), frame.mcus))
    return out


def thumbnail(frame: Frame, coefficients: np.ndarray, part: np.ndarray) -> np.ndarray:
    """DC-only luminance: the mean sample of each block of the first part."""
    _, h, v, quantiser, _, _ = frame.parts[0]
    dc = coefficients[part == 0, 0].astype(np.int64) * frame.quant[quantiser][0]
    grid = dc.reshape(frame.down, frame.across, v, h).transpose(0, 2, 1, 3).reshape(frame.down * v, frame.across * h)
    rows = -(-(-(-frame.height * v // frame.most[1])) // 8)
    cols = -(-(-(-frame.width * h // frame.most[0])) // 8)
    return np.clip((grid[:rows, :cols] + 4) // 8 + 128, 0, 255).astype(np.uint8)


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of the thumbnail, shrunk to 8 x 8, are above their mean."""
    rows = np.arange(9) * thumb.shape[0] // 8
    cols = np.arange(9) * thumb.shape[1] // 8
    total = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    total[1:, 1:] = thumb.astype(np.int64).cumsum(0).cumsum(1)
    top, bottom = np.minimum(rows[:-1], thumb.shape[0] - 1), np.maximum(rows[1:], rows[:-1] + 1)
    left, right = np.minimum(cols[:-1], thumb.shape[1] - 1), np.maximum(cols[1:], cols[:-1] + 1)
    area = np.outer(bottom - top, right - left)
    sums = total[np.ix_(bottom, right)] - total[np.ix_(top, right)] - total[np.ix_(bottom, left)] + total[np.ix_(top, left)]
    cell = sums * 1024 // area
    return np.packbits(cell.ravel() > cell.sum() // 64).tobytes().hex()


def payload_of(frame: Frame, coefficients: np.ndarray) -> bytes:
    """The bytes that :func:`encode` stored."""
    n = int(frame.comment.removeprefix(b"payload "))
    return coefficients.astype(np.uint8).tobytes()[:n]


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text's payload stored as an image (``media``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                sizes, media = [], []
                for value in part.column(1):
                    data = (value.as_py() or "").encode()
                    sizes.append(len(data))
                    media.append(encode(data + bytes(-len(data) % 64 if data else 64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(stored: DataFrame, batch_bytes: int = 1 << 18) -> DataFrame:
    """Features of each stored image; ``doc_id`` and ``n_bytes`` are carried along."""
    schema = """doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long,
      media_sha256 string, feature string, width int, height int, thumb_sha256 string, error string"""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, held, files = 0, 0, []
            for i, value in enumerate(batch.column(2)):
                files.append(value.as_py())
                held += len(files[-1] or b"")
                if held >= batch_bytes or i == batch.num_rows - 1:
                    rows = [_row(f, d) for f, d in zip(files, decode(files))]
                    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows), _TYPES)]
                    part = batch.slice(start, len(files))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names)
                    start, held, files = i + 1, 0, []

    return small_batches(stored.select("doc_id", "n_bytes", "media")).mapInArrow(run, schema)


_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]


def _row(data: bytes | None, decoded: tuple | str) -> tuple:
    size, digest = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
    if isinstance(decoded, str):
        return None, None, None, size, digest, None, None, None, None, decoded
    frame, coefficients, part = decoded
    thumb = thumbnail(frame, coefficients, part)
    own = (None, None, None)
    if frame.comment.startswith(b"payload "):
        payload = payload_of(frame, coefficients)
        own = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])
    feature = f"{frame.width}x{frame.height}:{thumbnail_hash(thumb)}"
    return (*own, size, digest, feature, frame.width, frame.height, hashlib.sha256(thumb.tobytes()).hexdigest(), None)


def report(docs: DataFrame) -> DataFrame:
    """Store every whole text as an image, read it back and describe it."""
    return read(store(docs)).drop("error")
