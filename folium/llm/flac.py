"""FLAC coding of byte payloads: an encoder, and a decoder into PCM blocks with sample offsets.

The decoder reads constant, verbatim, fixed and LPC subframes, Rice and Rice2 residuals with any
partitioning and escapes, checks both checksums of every frame and the stream's MD5, and yields
blocks that carry their sample offset, so a reader can seek.  Work is vectorised across frames:
all frames of a batch take one step together (a Rice code, then a prediction), because the codes of
one frame can only be read in turn.  Where frames start is known from the seek table, which the
encoder writes with a point per frame; streams without a full one are read front by front.

Up to 8 channels of 4 to 24 bits are read, joint stereo included; whatever is wrong with a stream raises
``FlacError`` (one error row from ``decode_blocks``).
The encoder writes one channel of signed 8-bit samples in blocks of 1024.

Everything is a map over rows in slices of bounded bytes: no shuffle, so no hot key.  ``round_trip`` stores
the streams of a share of the rows at a time, reads them back, and removes them before the next share;
only copies of one and the same row always share.

Cases: null text counts as empty, an empty text is 64 zero bytes; damaged streams raise ``FlacError``
naming the check that failed, or give a row with ``error`` in ``decode_blocks``; repeated rows give
equal rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folium.session import materialize, released, removed, shared_folder, ship

BLOCK = 1024
RATE = 8000
LPC_ORDER = 4
PRECISION = 12
#: Payload bytes coded at once by a Python worker; a longer text is a slice of its own.
SLICE_BYTES = 2_500_000
#: Shares of the rows whose streams are stored one after another.
WAVES = 4
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


class FlacError(ValueError):
    """A stream that is not valid FLAC, or uses what this decoder does not read."""


# --- checksums ----------------------------------------------------------------------------------


def _crc_bytes(width: int, poly: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    table = np.zeros(256, np.uint32)
    for byte in range(256):
        c = byte << (width - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        table[byte] = c
    return table


@lru_cache(1)
def _crc8_table() -> list[int]:
    return _crc_bytes(8, 0x07).tolist()


def crc8(data: bytes) -> int:
    table, c = _crc8_table(), 0
    for b in data:
        c = table[c ^ b]
    return c


_CRC16: list[np.ndarray] = []


def _crc16_by_distance(longest: int) -> np.ndarray:
    """[distance from the end][byte] -> its share of the CRC; shares are combined by xor."""
    step = _crc_bytes(16, 0x8005)
    if not _CRC16 or len(_CRC16[0]) < longest:
        rows = [step.astype(np.uint16)]
        while len(rows) < max(longest, 1200):
            c = rows[-1].astype(np.uint32)
            rows.append((step[c >> 8] ^ ((c << 8) & 0xFFFF)).astype(np.uint16))
        _CRC16[:] = [np.stack(rows)]
    return _CRC16[0]


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of data[start:end] for ascending, non-overlapping, non-empty ranges."""
    length = ends - starts
    if length.max() > 8192:  # long frames: the table would not stay in cache
        step, out = _crc_bytes(16, 0x8005).tolist(), []
        for s, e in zip(starts, ends, strict=True):
            c = 0
            for b in data[s:e].tobytes():
                c = step[(c >> 8) ^ b] ^ ((c << 8) & 0xFFFF)
            out.append(c)
        return np.array(out, np.uint16)
    table = _crc16_by_distance(int(length.max()))
    first = np.cumsum(length) - length
    index = np.arange(length.sum()) - np.repeat(first, length)
    share = table[np.repeat(length - 1, length) - index, data[np.repeat(starts, length) + index]]
    return np.bitwise_xor.reduceat(share, first)


# --- encoder ------------------------------------------------------------------------------------


@lru_cache(100_000)
def _frame_header(number: int, length: int) -> bytes:
    head = bytes([0xFF, 0xF8, (0xA0 if length == BLOCK else 0x70), 0x02]) + _coded_number(number)
    if length != BLOCK:
        head += struct.pack(">H", length - 1)
    return head + bytes([crc8(head)])


def _coded_number(n: int) -> bytes:
    """The format's UTF-8-like number, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x20
    while True:
        tail.append(0x80 | (n & 0x3F))
        n >>= 6
        if n < limit:
            return bytes([((0xFE * limit) & 0xFF if limit > 1 else 0xFE) | n, *reversed(tail)])
        limit >>= 1


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised predictors (frames x order, newest sample first) and their shifts, by Levinson-Durbin."""
    f = x.astype(np.float64)
    frames, p = len(x), LPC_ORDER
    r = np.stack([np.einsum("ij,ij->i", f[:, lag:], f[:, : f.shape[1] - lag]) for lag in range(p + 1)], 1)
    err = r[:, 0] * (1 + 1e-9) + 1e-9
    a = np.zeros((frames, p))
    for i in range(p):
        k = (r[:, i + 1] - np.einsum("ij,ij->i", a[:, :i], r[:, i:0:-1])) / err
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(1), 1e-6)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(top) + 1e-9), 0, 15).astype(np.int64)
    limit = 2 ** (PRECISION - 1)
    return np.clip(np.round(a * 2.0 ** shift[:, None]), -limit, limit - 1).astype(np.int64), shift


def _residual(x: np.ndarray, coefficients: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x minus its prediction, columns from the order on (all frames of one order)."""
    order = coefficients.shape[1]
    width = x.shape[1]
    predicted = np.zeros((len(x), width - order), np.int32)
    c = coefficients.astype(np.int32)
    for j in range(order):
        predicted += c[:, j : j + 1] * x[:, order - 1 - j : width - 1 - j]
    predicted >>= shift[:, None].astype(np.int32)
    return x[:, order:] - predicted


class _Bits:
    """Fields of known end bit and value, summed into bytes (their bits never overlap)."""

    def __init__(self) -> None:
        self.ends: list[np.ndarray] = []
        self.values: list[np.ndarray] = []

    def put(self, end: np.ndarray, value: np.ndarray) -> None:
        """Values of at most 16 bits whose last bit is ``end - 1``; higher bits of the field stay 0."""
        self.ends.append(np.ravel(end).astype(np.int64))
        self.values.append(np.ravel(value).astype(np.int64))

    def into(self, out: np.ndarray) -> None:
        for end, value in zip(self.ends, self.values, strict=True):
            last = end - 1
            word = value << (7 - (last & 7))
            at = last >> 3
            for k in range(3):
                part = (word >> (8 * k)) & 255
                some = part != 0
                if some.any():
                    out += np.bincount(at[some] - k, part[some], len(out)).astype(np.uint8)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """One FLAC stream per payload; bytes become samples by subtracting 128."""
    if not payloads:
        return []
    sizes = np.array([len(p) for p in payloads], np.int64)
    per = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(payloads)), per)
    number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    length = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    begin = np.repeat(np.cumsum(sizes) - sizes, per) + number * BLOCK
    frames = len(owner)
    x = np.zeros((frames, BLOCK), np.int32)
    columns = np.arange(BLOCK)
    inside = columns < length[:, None]
    x[inside] = flat.astype(np.int32) - 128
    # Cost of each predictor: the sum of absolute residuals.
    costs, options = [], []
    for order in range(3):
        c = np.tile(np.array(FIXED[order], np.int64).reshape(1, order), (frames, 1))
        options.append((c, np.zeros(frames, np.int64), 0))
    c, s = _lpc(x)
    options.append((c, s, 5 + 4 + PRECISION * LPC_ORDER))
    for c, s, _ in options:
        r = np.abs(_residual(x, c, s))
        r[~inside[:, c.shape[1] :]] = 0
        costs.append(r.sum(1, dtype=np.int64))
    best = np.argmin(np.stack(costs), 0)
    constant = (np.where(inside, x, x[:, :1]) == x[:, :1]).all(1)
    best[constant] = -1

    headers = [_frame_header(int(n), int(m)) for n, m in zip(number, length, strict=True)]
    head = np.array([len(h) for h in headers], np.int64)
    body = np.full(frames, 16, np.int64)  # subframe header and one sample of a constant
    plans = []
    for o, (c, s, extra) in enumerate(options):
        rows = np.flatnonzero(best == o)
        if not len(rows):
            continue
        order = c.shape[1]
        e = _residual(x[rows], c[rows], s[rows])
        ok = inside[rows][:, order:]
        u = (e << 1) ^ (e >> 31)
        u[~ok] = 0
        n = length[rows] - order
        mean = u.sum(1, dtype=np.int64) / n
        k = np.clip(np.floor(np.log2(np.maximum(mean * 0.6931, 1.0))), 0, 14).astype(np.int64)
        q = u >> k[:, None].astype(np.int32)
        code = np.where(ok, q + 1 + k[:, None], 0)
        end = np.cumsum(code, 1)
        body[rows] = 8 + 8 * order + extra + 10 + end[:, -1]
        plans.append((rows, order, c[rows], s[rows], extra, ok, u, k, end))
    verbatim = (body > 8 + 8 * length) & (best >= 0)
    body[verbatim] = 8 + 8 * length[verbatim]
    total = head + -(-body // 8) + 2
    at = np.cumsum(total) - total
    out = np.zeros(total.sum(), np.uint8)
    bits = _Bits()
    start = 8 * (at + head)
    rows = np.flatnonzero(best < 0)
    if len(rows):
        bits.put(start[rows] + 16, x[rows, 0] & 255)
    rows = np.flatnonzero(verbatim)
    if len(rows):
        bits.put(start[rows] + 8, np.full(len(rows), 0b00000010))
        where = inside[rows]
        bits.put((start[rows][:, None] + 16 + 8 * columns)[where], (x[rows] & 255)[where])
    for rows, order, c, s, extra, ok, u, k, end in plans:
        live = ~verbatim[rows]
        rows, c, s, ok, u, k, end = rows[live], c[live], s[live], ok[live], u[live], k[live], end[live]
        if not len(rows):
            continue
        at0 = start[rows]
        kind = (0b100000 | (order - 1)) if extra else (0b001000 | order)
        bits.put(at0 + 8, np.full(len(rows), kind << 1))
        for j in range(order):
            bits.put(at0 + 16 + 8 * j, x[rows, j] & 255)
        here = at0 + 8 + 8 * order
        if extra:
            bits.put(here + 4, np.full(len(rows), PRECISION - 1))
            bits.put(here + 9, s)
            for j in range(order):
                bits.put(here + 9 + PRECISION * (j + 1), c[:, j] & (2**PRECISION - 1))
            here = here + extra
        bits.put(here + 10, k)  # method 0, one partition, its parameter
        tail = (u & ((1 << k[:, None].astype(np.int32)) - 1)) | (1 << k[:, None].astype(np.int32))
        bits.put((here[:, None] + 10 + end)[ok], tail[ok])
    bits.into(out)
    lead = np.frombuffer(b"".join(headers), np.uint8)
    out[np.repeat(at - (np.cumsum(head) - head), head) + np.arange(head.sum())] = lead
    sums = crc16(out, at, at + total - 2)
    out[at + total - 2] = sums >> 8
    out[at + total - 1] = sums & 255

    streams, f = [], 0
    data = out.tobytes()
    edges = np.append(at, len(out))
    for i, payload in enumerate(payloads):
        n = int(per[i])
        sizes_i, first = total[f : f + n], int(edges[f])
        signed = (np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()
        info = struct.pack(
            ">HH3s3sQ16s", BLOCK, BLOCK, int(sizes_i.min()).to_bytes(3, "big"), int(sizes_i.max()).to_bytes(3, "big"),
            (RATE << 44) | (0 << 41) | (7 << 36) | len(payload), hashlib.md5(signed).digest(),
        )
        points = np.zeros(n, [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
        points["sample"] = number[f : f + n] * BLOCK
        points["offset"] = edges[f : f + n] - first
        points["count"] = length[f : f + n]
        seek = points.tobytes()
        streams.append(
            b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek
            + data[first : int(edges[f + n])]
        )
        f += n
    return streams


# --- decoder ------------------------------------------------------------------------------------

_ZEROS = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.int64)


class StreamInfo:
    """The metadata of one stream: STREAMINFO, seek points, and where the frames begin."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise FlacError("no fLaC marker")
        at, last, self.points = 4, False, None
        self.samples = None
        while not last:
            if at + 4 > len(data):
                raise FlacError("metadata is cut off")
            last, kind = bool(data[at] & 0x80), data[at] & 0x7F
            size = int.from_bytes(data[at + 1 : at + 4], "big")
            block = data[at + 4 : at + 4 + size]
            if len(block) < size or (kind == 0 and size < 34):
                raise FlacError("metadata is cut off")
            at += 4 + size
            if kind == 0:
                self.min_block, self.block = struct.unpack(">HH", block[:4])
                packed = int.from_bytes(block[10:18], "big")
                self.rate, self.channels = packed >> 44, ((packed >> 41) & 7) + 1
                self.bits, self.samples = ((packed >> 36) & 31) + 1, packed & ((1 << 36) - 1)
                self.md5 = block[18:34]
            elif kind == 3:
                p = np.frombuffer(block[: size // 18 * 18], [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
                self.points = p[p["sample"] != 0xFFFFFFFFFFFFFFFF]
        if self.samples is None:
            raise FlacError("no STREAMINFO")
        self.frames_at = at

    def frame_offsets(self) -> np.ndarray | None:
        """Byte offsets of all frames, if the seek table covers every sample."""
        p = self.points
        if p is None or not len(p) or int(p["count"].astype(np.int64).sum()) != self.samples:
            return None
        return p["offset"].astype(np.int64) + self.frames_at


def _windows(data: np.ndarray) -> np.ndarray:
    """The 64 bits from each byte on."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data) + 8, np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(out)]
    return out


class _Reader:
    """Bit cursors of many frames over one buffer."""

    def __init__(self, windows: np.ndarray, position: np.ndarray):
        self.w, self.p = windows, position

    def take(self, rows, n) -> np.ndarray:
        """The next n bits (at most 32) of the frames ``rows``."""
        p = self.p[rows]
        if len(p) and int(p.max()) >> 3 >= len(self.w):
            raise FlacError("a frame is cut off")
        word = self.w[p >> 3] << (p & 7).astype(np.uint64)
        n = np.broadcast_to(np.asarray(n, np.int64), p.shape)
        self.p[rows] = p + n
        value = (word >> np.uint64(1)) >> (np.uint64(63) - n.astype(np.uint64))
        return np.where(n > 0, value, 0).astype(np.int64)

    def signed(self, rows, n) -> np.ndarray:
        v = self.take(rows, n)
        half = np.int64(1) << np.maximum(np.asarray(n, np.int64) - 1, 0)
        return (v ^ half) - half


    def many(self, row: int, n: int, bits: int) -> np.ndarray:
        """The next n signed numbers of one frame."""
        p = self.p[row] + np.arange(n, dtype=np.int64) * bits
        self.p[row] += n * bits
        if self.p[row] >> 3 > len(self.w):
            raise FlacError("a frame is cut off")
        value = ((self.w[p >> 3] << (p & 7).astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
        half = np.int64(1) << np.int64(bits - 1)
        return (value ^ half) - half


def _read_number(data: bytes, at: int) -> int:
    """Where the coded frame number that begins at ``at`` ends."""
    first = data[at]
    if first < 0x80:
        return at + 1
    return at + 8 - (first ^ 0xFF).bit_length() if first < 0xFF else at + 7


def decode_frames(buffer: bytes, starts: np.ndarray, infos: list[StreamInfo]) -> tuple[list[np.ndarray], np.ndarray]:
    """Samples (length x channels) and end byte of each frame; ``starts`` ascending.

    Checks the header's CRC-8 and, over the frame as read, its CRC-16.
    """
    data = np.frombuffer(buffer, np.uint8)
    frames = len(starts)
    length, channels, width, body, joint = (np.zeros(frames, np.int64) for _ in range(5))
    for i, s in enumerate(starts.tolist()):
        if s + 5 > len(buffer) or buffer[s] != 0xFF or buffer[s + 1] & 0xFE != 0xF8:
            raise FlacError("no frame sync")
        code, rate = buffer[s + 2] >> 4, buffer[s + 2] & 15
        assignment, size = buffer[s + 3] >> 4, (buffer[s + 3] >> 1) & 7
        at = _read_number(buffer, s + 4)
        if code == 6:
            n, at = buffer[at] + 1, at + 1
        elif code == 7:
            n, at = int.from_bytes(buffer[at : at + 2], "big") + 1, at + 2
        elif not code:
            raise FlacError("reserved block size")
        else:
            n = 192 if code == 1 else 576 << (code - 2) if 2 <= code <= 5 else 256 << (code - 8)
        at += {12: 1, 13: 2, 14: 2}.get(rate, 0)
        if crc8(buffer[s:at]) != buffer[at]:
            raise FlacError("header CRC-8 differs")
        if assignment > 10:
            raise FlacError("reserved channel assignment")
        width[i] = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}.get(size, infos[i].bits)
        if width[i] > 24:
            raise FlacError("samples of more than 24 bits are not read")
        length[i], channels[i], body[i], joint[i] = n, 2 if assignment > 7 else assignment + 1, at + 1, max(assignment - 7, 0)
    reader = _Reader(_windows(data), body * 8)
    out: list[list[np.ndarray]] = [[] for _ in range(frames)]
    for channel in range(int(channels.max()) if frames else 0):
        rows = np.flatnonzero(channels > channel)
        # The side channel of left/side (1), side/right (2) and mid/side (3) has one bit more.
        side = (joint == (2 if channel == 0 else 1)) | ((joint == 3) & (channel == 1))
        for i, samples in zip(rows, _subframes(reader, rows, length, width + side), strict=True):
            out[i].append(samples)
    for i in np.flatnonzero(joint).tolist():
        out[i] = _apart(out[i], int(joint[i]))
    ends = (reader.p + 7) // 8
    if frames:
        if ends.max() + 2 > len(data):
            raise FlacError("a frame is cut off")
        stored = (data[ends].astype(np.uint16) << 8) | data[ends + 1]
        if (crc16(data, starts, ends) != stored).any():
            raise FlacError("frame CRC-16 differs")
    return [np.stack(c, 1) for c in out], ends + 2


def _apart(pair: list[np.ndarray], joint: int) -> list[np.ndarray]:
    """Left and right of two channels coded together."""
    a, b = pair
    if joint == 1:
        return [a, a - b]
    if joint == 2:
        return [a + b, b]
    mid = (a << 1) | (b & 1)
    return [(mid + b) >> 1, (mid - b) >> 1]


def pcm_bytes(samples: np.ndarray, bits: int) -> bytes:
    """Little-endian PCM, as many whole bytes a sample as its bits need."""
    if bits <= 8:
        return samples.astype("<i1").tobytes()
    if bits <= 16:
        return samples.astype("<i2").tobytes()
    return samples.astype("<i4").view(np.uint8).reshape(*samples.shape, 4)[..., :3].tobytes()


def _subframes(reader: _Reader, rows: np.ndarray, length: np.ndarray, width: np.ndarray) -> list[np.ndarray]:
    """One channel of the frames ``rows``; frames are handled longest first so live ones are a prefix."""
    order_of = np.argsort(-length[rows], kind="stable")
    rows = rows[order_of]
    n, bits = length[rows], width[rows].copy()
    head = reader.take(rows, 8)
    kind = (head >> 1) & 63
    wasted = np.zeros(len(rows), np.int64)
    for i in np.flatnonzero(head & 1):
        while not reader.take(rows[i : i + 1], 1)[0]:
            wasted[i] += 1
        wasted[i] += 1
    bits -= wasted
    out = np.zeros((int(n[0]), len(rows)), np.int32)
    constant = np.flatnonzero(kind == 0)
    if len(constant):
        out[:, constant] = reader.signed(rows[constant], bits[constant])
    for i in np.flatnonzero(kind == 1):
        out[: n[i], i] = reader.many(int(rows[i]), int(n[i]), int(bits[i]))
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | lpc | (kind <= 1)).all():
        raise FlacError("reserved subframe type")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    coded = np.flatnonzero(fixed | lpc)
    for j in range(int(order.max())):
        some = np.flatnonzero(order > j)
        out[j, some] = reader.signed(rows[some], bits[some])
    weights, shift = np.zeros((len(rows), max(1, int(order.max()))), np.int64), np.zeros(len(rows), np.int64)
    for o in range(1, 5):
        weights[np.ix_(fixed & (order == o), range(o))] = FIXED[o]
    some = np.flatnonzero(lpc)
    if len(some):
        precision = reader.take(rows[some], 4) + 1
        shift[some] = reader.signed(rows[some], 5)
        if (precision == 16).any() or (shift < 0).any():
            raise FlacError("reserved LPC parameters")
        for j in range(int(order[some].max())):
            has = order[some] > j
            weights[some[has], j] = reader.signed(rows[some[has]], precision[has])
    if len(coded):
        _rice(reader, rows[coded], n[coded], order[coded], out, coded)
        _predict(out, coded, n[coded], order[coded], weights[coded], shift[coded])
    result = [out[: n[i], i] << int(wasted[i]) for i in range(len(rows))]
    back = np.empty(len(rows), np.int64)
    back[order_of] = np.arange(len(rows))
    return [result[i] for i in back]


def _rice(reader: _Reader, rows: np.ndarray, n: np.ndarray, order: np.ndarray, out: np.ndarray, columns: np.ndarray) -> None:
    """Residuals into ``out``; all frames read their t-th sample's code together."""
    method = reader.take(rows, 2)
    if (method > 1).any():
        raise FlacError("reserved residual coding")
    size = np.where(method == 1, 5, 4)
    parts = np.int64(1) << reader.take(rows, 4)
    if (n % parts).any() or (n // parts < order).any():
        raise FlacError("residual partitions do not fit the block")
    step = n // parts
    k, raw = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool)
    opens: dict[int, list[np.ndarray]] = {}
    for s in np.unique(step):
        same = np.flatnonzero(step == s)
        for o in np.unique(order[same]):
            opens.setdefault(int(o), []).append(same[order[same] == o])
        for t in range(int(s), int(n[same].max()), int(s)):
            opens.setdefault(t, []).append(same[n[same] > t])
    windows = reader.w
    contiguous = len(columns) == out.shape[1]
    lowest = int(order.min())
    for t in range(lowest, int(n[0])):
        for group in opens.get(t, ()):
            if len(group):
                k[group] = reader.take(rows[group], size[group])
                escape = k[group] == (np.int64(1) << size[group]) - 1
                raw[group] = escape
                if escape.any():
                    k[group[escape]] = reader.take(rows[group[escape]], 5)
        live = int(np.searchsorted(-n, -t, side="left"))  # n is descending: frames with n > t
        some = slice(0, live) if (order[:live] <= t).all() and not raw[:live].any() else np.flatnonzero((order[:live] <= t) & ~raw[:live])
        p = reader.p[rows[some]]
        if len(p):
            if int(p.max()) >> 3 >= len(windows):
                raise FlacError("a frame is cut off")
            word = windows[p >> 3] << (p & 7).astype(np.uint64)
            zeros = _ZEROS[(word >> np.uint64(48)).astype(np.int64)]
            long = np.flatnonzero(zeros == 16)
            if len(long):  # quotients of 16 and more: rare
                run = np.zeros(len(p), np.int64)
                while len(long):
                    run[long] += 16
                    at = p[long] + run[long]
                    if int(at.max()) >> 3 >= len(windows):
                        raise FlacError("a frame is cut off")
                    word[long] = windows[at >> 3] << (at & 7).astype(np.uint64)
                    zeros[long] = _ZEROS[(word[long] >> np.uint64(48)).astype(np.int64)]
                    long = long[zeros[long] == 16]
                p = p + run
                quotient = zeros + run
            else:
                quotient = zeros
            kk = k[some]
            low = ((word << (zeros + 1).astype(np.uint64)) >> np.uint64(1)) >> (63 - kk).astype(np.uint64)
            u = (quotient << kk) | low.astype(np.int64)
            reader.p[rows[some]] = p + zeros + 1 + kk
            value = (u >> 1) ^ -(u & 1)
            if contiguous and isinstance(some, slice):
                out[t, some] = value
            else:
                out[t, columns[some]] = value
        plain = np.flatnonzero(raw[:live] & (order[:live] <= t))
        if len(plain):
            out[t, columns[plain]] = np.where(k[plain] > 0, reader.signed(rows[plain], k[plain]), 0)


def _predict(out: np.ndarray, columns: np.ndarray, n: np.ndarray, order: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> None:
    """Add predictions to residuals in place; frames of one order step together."""
    for o in np.unique(order):
        if o == 0:
            continue
        same = np.flatnonzero(order == o)
        s = out[:, columns[same]].astype(np.int64)
        w, sh, m = weights[same, :o].T.copy(), shift[same], n[same]
        for t in range(int(o), int(m[0])):
            live = int(np.searchsorted(-m, -t, side="left"))
            p = w[0, :live] * s[t - 1, :live]
            for j in range(1, int(o)):
                p += w[j, :live] * s[t - 1 - j, :live]
            s[t, :live] += p >> sh[:live]
        out[:, columns[same]] = s


def decode_streams(streams: list[bytes]) -> list[tuple[StreamInfo, list[np.ndarray]]]:
    """Metadata and frames of every stream, all verified (CRC-8, CRC-16, sample count, MD5).

    Whatever is wrong with a stream raises ``FlacError``.
    """
    try:
        return _decoded(streams)
    except (IndexError, ValueError, OverflowError, struct.error) as e:  # numbers in a damaged stream that lead nowhere
        raise FlacError(f"damaged: {e}") from e


def _decoded(streams: list[bytes]) -> list[tuple[StreamInfo, list[np.ndarray]]]:
    infos = [StreamInfo(s) for s in streams]
    base = np.cumsum([0, *[len(s) for s in streams]])
    buffer = b"".join(streams)
    blocks: list[list[np.ndarray]] = [[] for _ in streams]
    known = [i.frame_offsets() for i in infos]
    owners, starts = [], []
    for i, offsets in enumerate(known):
        if offsets is not None:
            owners += [i] * len(offsets)
            starts += (offsets + base[i]).tolist()
    if starts:
        found, _ = decode_frames(buffer, np.array(starts, np.int64), [infos[i] for i in owners])
        for i, b in zip(owners, found, strict=True):
            blocks[i].append(b)
    front = {i: int(base[i] + infos[i].frames_at) for i, offsets in enumerate(known) if offsets is None and infos[i].samples}
    while front:  # the next frame of every stream whose frames are not known
        order = sorted(front, key=front.get)
        found, ends = decode_frames(buffer, np.array([front[i] for i in order], np.int64), [infos[i] for i in order])
        for i, b, end in zip(order, found, ends.tolist(), strict=True):
            blocks[i].append(b)
            if sum(len(x) for x in blocks[i]) < infos[i].samples:
                front[i] = end
            else:
                del front[i]
    for info, own in zip(infos, blocks, strict=True):
        if sum(len(b) for b in own) != info.samples:
            raise FlacError("sample count differs")
        if any(info.md5):
            if hashlib.md5(b"".join(pcm_bytes(b, info.bits) for b in own)).digest() != info.md5:
                raise FlacError("MD5 of the samples differs")
    return list(zip(infos, blocks, strict=True))


# --- on tables ----------------------------------------------------------------------------------


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes padded with zeros to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts stay within about ``limit`` characters."""
    first = total = 0
    for i, t in enumerate(texts):
        total += len(t or "") + 64
        if total >= limit:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (the FLAC stream) of every text."""
    ship(documents.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["body"].tolist()
            for a, b in slices(texts):
                payloads = [payload_of(t) for t in texts[a:b]]
                yield pd.DataFrame({
                    "doc_id": batch["doc_id"].iloc[a:b].astype("Int64").array,
                    "n_bytes": [len((t or "").encode("utf-8", "surrogatepass")) for t in texts[a:b]],
                    "media": encode_payloads(payloads),
                })

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return rows.mapInPandas(released(run), "doc_id long, n_bytes long, media binary")


def decode_blocks(media: DataFrame, key: str = "doc_id", content: str = "media") -> DataFrame:
    """PCM blocks of FLAC streams: block number, sample offset, samples, PCM bytes; a bad stream is one row with its error."""
    ship(media.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, stream in zip(batch["doc_id"], batch["media"], strict=True):
                try:
                    (info, blocks), = decode_streams([bytes(stream or b"")])
                except FlacError as e:
                    yield pd.DataFrame({"doc_id": [doc_id], "block": [None], "sample_offset": [None], "samples": [None], "pcm": [None], "error": [str(e)]})
                    continue
                lengths = [len(b) for b in blocks]
                yield pd.DataFrame({
                    "doc_id": doc_id, "block": range(len(blocks)), "sample_offset": np.cumsum([0, *lengths])[:-1], "samples": lengths,
                    "pcm": [pcm_bytes(b, info.bits) for b in blocks], "error": None,
                })

    rows = media.select(F.col(key).alias("doc_id"), F.col(content).alias("media"))
    return rows.mapInPandas(run, "doc_id long, block long, sample_offset long, samples long, pcm binary, error string")


def features(samples: np.ndarray, blocks: int) -> str:
    """Sample statistics of a payload read back, in integers so that equal payloads read alike."""
    s = samples.astype(np.int64)
    n = len(s)
    crossings = int(((s[1:] < 0) != (s[:-1] < 0)).sum())
    return (
        f"blocks={blocks};mean={int(s.sum()) * 1000 // n};power={int((s * s).sum()) * 1000 // n};"
        f"min={int(s.min())};max={int(s.max())};crossings={crossings};slope={int(np.abs(np.diff(s)).sum()) * 1000 // n}"
    )


def read_back(media: DataFrame, key: str = "doc_id", content: str = "media") -> DataFrame:
    """What ``encode_texts`` stored, decoded from its bytes: payload and stream digests, features."""
    ship(media.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            streams = [bytes(b) for b in batch["media"]]
            for a, b in slices(streams):
                rows = []
                for stream, (_, blocks) in zip(streams[a:b], decode_streams(streams[a:b]), strict=True):
                    samples = np.concatenate([x[:, 0] for x in blocks])
                    payload = (samples + 128).astype(np.uint8).tobytes()
                    rows.append((
                        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]),
                        len(stream), hashlib.sha256(stream).hexdigest(), features(samples, len(blocks)),
                    ))
                out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
                for c in ("payload_sha256", "media_sha256", "feature"):
                    out[c] = out[c].astype(object)
                out.insert(0, "n_bytes", batch["n_bytes"].iloc[a:b].to_numpy())
                out.insert(0, "doc_id", batch["doc_id"].iloc[a:b].astype("Int64").array)
                yield out

    rows = media.select(F.col(key).cast("long").alias("doc_id"), "n_bytes", F.col(content).alias("media"))
    return rows.mapInPandas(
        released(run),
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def round_trip(documents: DataFrame, key: str = "doc_id", text: str = "text", waves: int = WAVES) -> DataFrame:
    """Store every text as FLAC in the shared folder, read the stored bytes back, and describe what was read.

    Rows go in ``waves`` by a hash of key and text, so the table is read as many times and must read the same each
    time; only rows equal in both always go together.  To keep the streams, write what ``encode_texts`` returns.
    """
    spark = documents.sparkSession
    share = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(waves))
    described = []
    for wave in range(waves):
        streams = encode_texts(documents.where(share == wave), key, text)
        with removed(spark, shared_folder(spark)) as folder:
            streams.write.option("compression", "zstd").parquet(folder)
            described.append(materialize(read_back(spark.read.schema(streams.schema).parquet(folder))))
    return reduce(DataFrame.unionAll, described)
