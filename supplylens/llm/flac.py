"""Lossless audio columns: a FLAC writer and reader for mono PCM, vectorised over frames.

Streams follow the public FLAC format (RFC 9639): ``fLaC``, STREAMINFO, a SEEKTABLE, then frames
of ``BLOCK`` samples. A frame is coded as constant, verbatim, fixed predictor (orders 0 to 2) or linear predictor (order 4),
whichever is shortest, with Rice-coded residuals. The reader also knows fixed predictors up to order 4, linear predictors up
to order 32, Rice partitions and escaped partitions. It starts at the seek points, decodes all of them side by side, and
checks each header's CRC-8 and each frame's CRC-16, and the MD5 of the samples. What it reads is written as PCM blocks
with the sample offsets that they are sought by; features are worked out from these stored blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplylens.llm.common import shared_table

BLOCK = 192
RATE = 8000
LPC_ORDER, LPC_BITS = 4, 8
#: Frames between two seek points, unless the table would pass its largest size.
SEEK_FRAMES = 4
MOST_POINTS = 900_000
#: Frames coded, and seek points read, at once.
SLICE = 4096
#: Payload bytes taken from a batch at once; a longer document is taken alone.
GROUP_BYTES = 8_000_000


def _crc_table(poly: int, bits: int) -> np.ndarray:
    v = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        v = np.where(v >> (bits - 1) & 1, (v << 1) ^ poly, v << 1) & ((1 << bits) - 1)
    return v


CRC8 = _crc_table(0x07, 8).astype(np.uint8)
CRC16 = _crc_table(0x8005, 16)


def _crc16_by_distance(n: int) -> np.ndarray:
    """[d, v]: what a byte v adds to the CRC-16 of a message that goes on for d bytes after it."""
    out = np.empty((n, 256), dtype=np.uint16)
    v = CRC16.copy()
    for d in range(n):
        out[d] = v
        v = ((v << 8) & 0xFFFF) ^ CRC16[v >> 8]
    return out


_FAR = _crc16_by_distance(1024)


def crc16(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-16 of each of the byte ranges of ``buf``."""
    global _FAR
    if len(length) and length.max() > len(_FAR):
        _FAR = _crc16_by_distance(int(length.max()))
    ends = np.cumsum(length)
    at = np.arange(ends[-1] if len(ends) else 0)
    row = np.repeat(np.arange(len(length)), length)
    within = at - (ends - length)[row]
    part = _FAR[length[row] - 1 - within, buf[start[row] + within]]
    return np.bitwise_xor.reduceat(part, ends - length)


def _number_bytes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in FLAC's extended UTF-8: [len(n), 6] bytes and how many count."""
    size = 1 + (n >= 0x80) + (n >= 0x800) + (n >= 0x10000) + (n >= 0x200000) + (n >= 0x4000000)
    out = np.zeros((len(n), 6), dtype=np.uint8)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC])
    for k in range(6):
        shift = 6 * (size - 1 - k)
        tail = 0x80 | ((n >> np.maximum(shift, 0)) & 0x3F)
        out[:, k] = np.where(k < size, tail if k else np.where(size == 1, n, lead[size] | (n >> np.maximum(shift, 0))), 0) & 0xFF
    return out, size


def _put(bits: np.ndarray, pos: np.ndarray, value: np.ndarray, width: int) -> None:
    for b in range(width):
        bits[pos + b] = (value >> (width - 1 - b)) & 1


def _rice(res: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals, Rice parameter and bits of each row."""
    u = np.where(res >= 0, res << 1, (-res << 1) - 1)
    mean = u.mean(axis=1) if res.shape[1] else np.zeros(len(res))
    k = np.clip(np.floor(np.log2(np.maximum(mean, 1))), 0, 14).astype(np.int32)
    return u, k, (u >> k[:, None]).sum(axis=1) + (k + 1) * res.shape[1]


def _linear_predictor(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients [rows, LPC_ORDER] and shifts by the Levinson-Durbin recursion on autocorrelations."""
    f = x.astype(np.float64)
    n = x.shape[1]
    r = np.stack([(f[:, lag:] * f[:, : n - lag]).sum(axis=1) for lag in range(LPC_ORDER + 1)], axis=1)
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-3
    a, err = np.zeros((len(x), LPC_ORDER)), r[:, 0].copy()
    for i in range(LPC_ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / err
        a[:, :i] -= k[:, None] * a[:, i - 1 :: -1][:, :i] if i else 0
        a[:, i] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(axis=1), 1e-6)
    shift = np.clip(LPC_BITS - 2 - np.floor(np.log2(top)).astype(int), 0, 15)
    q = np.clip(np.rint(a * 2.0 ** shift[:, None]), -(1 << LPC_BITS - 1), (1 << LPC_BITS - 1) - 1)
    return q.astype(np.int32), shift.astype(np.int32)


def encode_frames(x: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Frames of the rows of ``x`` (int32 samples of 8 bits, [n, BLOCK]) one after another, and their lengths in bytes."""
    n = len(x)
    # Candidates: (order, folded residuals from that order on, parameter, bits, is_lpc).
    plans = []
    diff = x
    for order in range(3):
        u, k, bits = _rice(diff)
        plans.append((order, u, k, bits + 8 * order + 10, False))
        diff = np.diff(diff, axis=1)
    q, shift = _linear_predictor(x)
    pred = sum(q[:, j, None] * x[:, LPC_ORDER - 1 - j : BLOCK - 1 - j] for j in range(LPC_ORDER)) >> shift[:, None]
    u, k, bits = _rice(x[:, LPC_ORDER:] - pred)
    plans.append((LPC_ORDER, u, k, bits + 8 * LPC_ORDER + 9 + LPC_ORDER * LPC_BITS + 10, True))
    cost = np.stack([p[3] for p in plans] + [np.full(n, 8 * BLOCK), np.where((x == x[:, :1]).all(axis=1), 8, 1 << 30)], axis=1)
    choice = cost.argmin(axis=1)
    num, num_size = _number_bytes(number)
    head = 4 + num_size + 1
    body_bits = 8 + cost[np.arange(n), choice]
    size = head + -(-body_bits // 8) + 2
    start = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()) * 8, dtype=np.uint8)
    body = (start + head) * 8
    raw = (x & 0xFF).astype(np.int32)
    kinds = [0b001000, 0b001001, 0b001010, 0b100000 | (LPC_ORDER - 1), 0b000001, 0b000000]
    for c, kind in enumerate(kinds):
        rows = np.flatnonzero(choice == c)
        if not len(rows):
            continue
        _put(bits, body[rows], np.full(len(rows), kind << 1), 8)
        first = body[rows] + 8
        if c >= 4:
            count = BLOCK if c == 4 else 1
            _put(bits, first[:, None] + 8 * np.arange(count), raw[rows, :count], 8)
            continue
        order, u, k, _, lpc = plans[c]
        u, k = u[rows], k[rows]
        _put(bits, first[:, None] + 8 * np.arange(order), raw[rows, :order], 8)
        pos = first + 8 * order
        if lpc:
            _put(bits, pos, np.full(len(rows), LPC_BITS - 1), 4)
            _put(bits, pos + 4, shift[rows], 5)
            _put(bits, pos[:, None] + 9 + LPC_BITS * np.arange(order), q[rows] & ((1 << LPC_BITS) - 1), LPC_BITS)
            pos = pos + 9 + LPC_BITS * order
        _put(bits, pos + 6, k, 4)  # coding method 0 and partition order 0 before it
        quotient = u >> k[:, None]
        width = quotient + 1 + k[:, None]
        at = pos[:, None] + 10 + np.cumsum(width, axis=1) - width + quotient
        bits[at] = 1
        for b in range(int(k.max()) if len(k) else 0):
            with_b = k > b
            bits[at[with_b] + 1 + b] = (u[with_b] >> (k[with_b] - 1 - b)[:, None]) & 1
    buf = np.packbits(bits)
    buf[start], buf[start + 1], buf[start + 2], buf[start + 3] = 0xFF, 0xF8, 0x10, 0x02
    for j in range(6):
        rows = num_size > j
        buf[start[rows] + 4 + j] = num[rows, j]
    buf[start + head - 1] = _header_crc(buf, start, head - 1)
    crc = crc16(buf, start, size - 2)
    buf[start + size - 2], buf[start + size - 1] = crc >> 8, crc & 0xFF
    return buf.tobytes(), size


def _header_crc(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(start), dtype=np.uint8)
    for j in range(int(length.max()) if len(length) else 0):
        crc = np.where(j < length, CRC8[crc ^ buf[np.minimum(start + j, len(buf) - 1)]], crc)
    return crc


def _metadata(samples: np.ndarray, sizes: np.ndarray) -> bytes:
    """Everything before the first frame."""
    n_frames = len(sizes)
    step = max(SEEK_FRAMES, -(-n_frames // MOST_POINTS))
    info = (
        BLOCK.to_bytes(2, "big") * 2
        + int(sizes.min()).to_bytes(3, "big")
        + int(sizes.max()).to_bytes(3, "big")
        + ((RATE << 44) | (0 << 41) | (7 << 36) | len(samples)).to_bytes(8, "big")
        + hashlib.md5(samples.tobytes()).digest()
    )
    at = np.arange(0, n_frames, step)
    points = np.zeros(len(at), dtype=np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
    points["sample"], points["offset"], points["n"] = at * BLOCK, (np.cumsum(sizes) - sizes)[at], BLOCK
    table = points.tobytes()
    return b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; its bytes, less 128, are 8-bit samples. Lengths are positive multiples of ``BLOCK``."""
    if not payloads:
        return []
    counts = np.array([len(p) // BLOCK for p in payloads])
    flat = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    rows = flat.reshape(-1, BLOCK)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    parts, sizes = [], []
    for at in range(0, len(rows), SLICE):
        data, size = encode_frames(rows[at : at + SLICE].astype(np.int32) - 128, number[at : at + SLICE])
        parts.append(data)
        sizes.append(size)
    data, size = b"".join(parts), np.concatenate(sizes)
    ends = np.concatenate([[0], np.cumsum(size)])
    samples = (flat ^ 0x80).view(np.int8)
    out, first = [], 0
    for c in counts.tolist():
        own = size[first : first + c]
        out.append(_metadata(samples[first * BLOCK : (first + c) * BLOCK], own) + data[ends[first] : ends[first + c]])
        first += c
    return out


class _Bits:
    """Bit fields of up to 25 bits at any positions of a buffer."""

    def __init__(self, buf: np.ndarray):
        b = np.concatenate([buf, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.word = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
        self.last = len(self.word) - 1

    def ahead(self, pos: np.ndarray) -> np.ndarray:
        return self.word[np.minimum(pos >> 3, self.last)] << (pos & 7).astype(np.uint32)

    def get(self, pos: np.ndarray, width) -> np.ndarray:
        width = np.asarray(width)
        return np.where(width > 0, self.ahead(pos) >> (32 - np.maximum(width, 1)).astype(np.uint32), 0).astype(np.int64)

    def signed(self, pos: np.ndarray, width) -> np.ndarray:
        v = self.get(pos, width)
        return v - ((v >> (np.asarray(width) - 1)) << np.asarray(width))

    def unary(self, pos: np.ndarray) -> np.ndarray:
        """Zeros before the next one bit."""
        count = np.zeros(len(pos), dtype=np.int64)
        todo = np.arange(len(pos))
        while len(todo):
            w = self.ahead(pos[todo] + count[todo]) >> np.uint32(7)
            lead = 25 - np.frexp(w.astype(np.float64))[1]
            count[todo] += lead
            todo = todo[lead == 25]
        return count


class CorruptStream(ValueError):
    pass


def _check(ok: np.ndarray, what: str) -> None:
    if not np.all(ok):
        raise CorruptStream(what)


def _residuals(bits: _Bits, pos: np.ndarray, order: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Residuals [rows, block - order] and the positions after them."""
    method, parts = bits.get(pos, 2), bits.get(pos + 2, 4)
    _check(method <= 1, "unknown residual coding")
    pos = pos + 6
    wide = 4 + method
    out = np.zeros((len(pos), block - order), dtype=np.int64)
    k = np.zeros(len(pos), dtype=np.int64)
    raw_width = np.full(len(pos), -1)
    per_part = block >> parts
    for i in range(order, block):
        new = (i % per_part == 0) | (i == order)
        if new.any():
            r = np.flatnonzero(new)
            k[r] = bits.get(pos[r], wide[r])
            pos[r] += wide[r]
            raw_width[r] = -1
            esc = r[k[r] == (1 << wide[r]) - 1]
            if len(esc):
                raw_width[esc] = bits.get(pos[esc], 5)
                pos[esc] += 5
        plain = raw_width < 0
        if plain.all():
            q = bits.unary(pos)
            pos = pos + q + 1
            u = (q << k) | bits.get(pos, k)
            pos = pos + k
            out[:, i - order] = (u >> 1) ^ -(u & 1)
        else:
            r, s = np.flatnonzero(plain), np.flatnonzero(~plain)
            q = bits.unary(pos[r])
            u = (q << k[r]) | bits.get(pos[r] + q + 1, k[r])
            out[r, i - order] = (u >> 1) ^ -(u & 1)
            pos[r] += q + 1 + k[r]
            w = raw_width[s]
            out[s, i - order] = np.where(w > 0, bits.signed(pos[s], np.maximum(w, 1)), 0)
            pos[s] += w
    return out, pos


FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def _subframes(bits: _Bits, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples [rows, BLOCK] of the subframes at ``pos`` and the positions after them."""
    head = bits.get(pos, 8)
    _check((head & 0x81) == 0, "padding bit set or wasted bits")
    kind = head >> 1
    pos = pos + 8
    out = np.zeros((len(pos), BLOCK), dtype=np.int64)
    for t in np.unique(kind).tolist():
        rows = np.flatnonzero(kind == t)
        p = pos[rows]
        if t == 0:
            out[rows] = bits.signed(p, 8)[:, None]
            pos[rows] = p + 8
        elif t == 1:
            out[rows] = bits.signed(p[:, None] + 8 * np.arange(BLOCK), 8)
            pos[rows] = p + 8 * BLOCK
        else:
            lpc = t >= 32
            order = t - 31 if lpc else t - 8
            if not lpc and not 0 <= order <= 4:
                raise CorruptStream("reserved subframe type")
            x = np.zeros((len(rows), BLOCK), dtype=np.int64)
            x[:, :order] = bits.signed(p[:, None] + 8 * np.arange(order), 8)
            p = p + 8 * order
            if lpc:
                precision, shift = bits.get(p, 4) + 1, bits.signed(p + 4, 5)
                _check((precision < 16) & (shift >= 0), "bad predictor")
                coef = np.stack([bits.signed(p + 9 + j * precision, precision) for j in range(order)], axis=1)
                p = p + 9 + order * precision
            else:
                coef, shift = np.tile(np.array(FIXED[order], dtype=np.int64), (len(rows), 1)), np.zeros(len(rows), np.int64)
            res, p = _residuals(bits, p, order, BLOCK)
            if order == 0:
                x = res
            else:
                for i in range(order, BLOCK):
                    x[:, i] = res[:, i - order] + ((coef * x[:, i - 1 :: -1][:, :order]).sum(axis=1) >> shift)
            out[rows], pos[rows] = x, p
    return out, pos


def _headers(buf: np.ndarray, at: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Check the frame headers at ``at`` and return the positions after them."""
    _check(at + 6 <= len(buf), "stream ends early")
    _check((buf[at] == 0xFF) & (buf[at + 1] == 0xF8) & (buf[at + 2] == 0x10) & (buf[at + 3] == 0x02), "no frame header where one should be")
    want, size = _number_bytes(number)
    for j in range(6):
        rows = size > j
        _check(buf[at[rows] + 4 + j] == want[rows, j], "frame number out of order")
    _check(_header_crc(buf, at, 4 + size) == buf[at + 4 + size], "CRC-8 of a header")
    return at + 5 + size


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """Samples (int8) of each stream that :func:`encode` can have written; raises :class:`CorruptStream` otherwise."""
    lanes_at, lanes_frames, lanes_number, lanes_out, infos = [], [], [], [], []
    base, out_at = 0, 0
    for s in streams:
        if s[:4] != b"fLaC" or s[4] & 0x7F or len(s) < 42:
            raise CorruptStream("no STREAMINFO")
        word = int.from_bytes(s[18:26], "big")
        total, md5 = word & ((1 << 36) - 1), s[26:42]
        at, last, points = 42, bool(s[4] & 0x80), None
        while not last:
            last, kind, size = bool(s[at] & 0x80), s[at] & 0x7F, int.from_bytes(s[at + 1 : at + 4], "big")
            if kind == 3:
                points = np.frombuffer(s[at + 4 : at + 4 + size], dtype=np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
            at += 4 + size
        if int.from_bytes(s[8:10], "big") != BLOCK or (word >> 36) & 0xFF != 7 or total % BLOCK or points is None or not len(points):
            raise CorruptStream("another block size, channel count or sample size, or no seek table")
        first = points["sample"].astype(np.int64) // BLOCK
        lanes_at.append(points["offset"].astype(np.int64) + base + at)
        lanes_frames.append(np.diff(np.append(first, total // BLOCK)))
        lanes_number.append(first)
        lanes_out.append(first + out_at // BLOCK)
        infos.append((out_at, total, md5))
        out_at += total
        base += len(s)
    if not streams:
        return []
    buf = np.frombuffer(b"".join(streams), dtype=np.uint8)
    bits = _Bits(buf)
    at, frames, number, row = (np.concatenate(v) for v in (lanes_at, lanes_frames, lanes_number, lanes_out))
    out = np.zeros((out_at // BLOCK, BLOCK), dtype=np.int8)
    for lo in range(0, len(at), SLICE):
        pos, left, num, to = (v[lo : lo + SLICE].copy() for v in (at, frames, number, row))
        while len(pos):
            body = _headers(buf, pos, num)
            x, end = _subframes(bits, body * 8)
            end = -(-end // 8)
            _check(end + 2 <= len(buf), "stream ends early")
            _check(crc16(buf, pos, end - pos) == (buf[end].astype(np.uint16) << 8 | buf[end + 1]), "CRC-16 of a frame")
            out[to] = x
            pos, left, num, to = end + 2, left - 1, num + 1, to + 1
            more = left > 0
            pos, left, num, to = pos[more], left[more], num[more], to[more]
    flat = out.reshape(-1)
    result = []
    for start, total, md5 in infos:
        own = flat[start : start + total]
        if hashlib.md5(own.tobytes()).digest() != md5:
            raise CorruptStream("MD5 of the samples")
        result.append(own)
    return result


def payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes filled with spaces to a positive multiple of ``BLOCK``, and their number before."""
    b = (text or "").encode("utf-8", "surrogatepass")
    return b + b" " * (BLOCK * max(1, -(-len(b) // BLOCK)) - len(b)), len(b)


def _groups(sizes: list[int]) -> Iterator[slice]:
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > GROUP_BYTES:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if sizes:
        yield slice(start, len(sizes))


def write_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a FLAC stream.

    Null and empty texts become one block of spaces. Equal texts give equal streams. Only ``doc_id`` and ``text`` are
    read; repeated rows give repeated streams; an empty table gives none.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for part in _groups([len(t or "") for t in texts]):
                made = [payload(t) for t in texts[part]]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[part].astype("Int64"), "n_bytes": [n for _, n in made], "media": encode([p for p, _ in made])})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(work, "doc_id long, n_bytes long, media binary")


PCM = "stream long, doc_id long, n_bytes long, n_samples long, sample_offset long, pcm binary"
#: Blocks in a row of a PCM table.
RUN_BLOCKS = 64


def pcm_blocks(media: DataFrame) -> DataFrame:
    """Decode streams to signed 8-bit PCM: a row for each run of ``RUN_BLOCKS`` blocks, with the offset of its first sample.

    ``stream`` tells the streams of repeated or null ids apart. Every frame's checksums and the MD5 of the samples are verified; a damaged stream raises
    :class:`CorruptStream`. Streams of any length are decoded whole; repeated rows give repeated streams, null ids stay null, an empty table gives no rows; only ``doc_id``,
    ``n_bytes`` and ``media`` are read, so other columns never clash.
    """
    step = RUN_BLOCKS * BLOCK

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _groups([len(m) for m in batch["media"]]):
                rows = batch.iloc[part]
                samples = decode(rows["media"].tolist())
                cuts = [range(0, len(x), step) for x in samples]
                each = np.repeat(np.arange(len(rows)), [len(c) for c in cuts])
                yield pd.DataFrame(
                    {
                        "stream": rows["stream"].to_numpy()[each],
                        "doc_id": pd.array(rows["doc_id"], dtype="Int64")[each],
                        "n_bytes": rows["n_bytes"].to_numpy()[each],
                        "n_samples": np.array([len(x) for x in samples])[each],
                        "sample_offset": np.concatenate([np.asarray(c) for c in cuts]),
                        "pcm": [x[at : at + step].tobytes() for x, c in zip(samples, cuts) for at in c],
                    }
                )

    return media.select(F.monotonically_increasing_id().alias("stream"), "doc_id", "n_bytes", "media").mapInPandas(work, PCM)


def store_pcm(media: DataFrame) -> DataFrame:
    """Write :func:`pcm_blocks` as a compressed Parquet table below the shared folder and return its reader. A stream's rows lie side by side, by their offsets."""
    return shared_table(pcm_blocks(media), "pcm", compression="zstd")


def seek(stored: DataFrame, first: int, n: int) -> DataFrame:
    """(stream, doc_id, pcm) with the samples from ``first`` to ``first + n`` of each stream that reaches so far; fewer where it ends earlier.

    Plain bounds on ``sample_offset`` go down to the Parquet reader, which skips row groups and pages by their statistics, as it does for a filter on ``doc_id`` or ``stream``
    that was put on ``stored``; no other samples are read from those.
    """
    step = RUN_BLOCKS * BLOCK
    runs = stored.filter((F.col("sample_offset") > first - step) & (F.col("sample_offset") < first + n))
    skip = F.greatest(F.lit(0), F.lit(first) - F.col("sample_offset"))
    size = F.least(F.octet_length("pcm").cast("long"), F.lit(first + n) - F.col("sample_offset")) - skip
    runs = runs.filter(size > 0).select("stream", "doc_id", "sample_offset", F.substring("pcm", (skip + 1).cast("int"), size.cast("int")).alias("pcm"))
    # No more runs a stream than n samples fill.
    joined = runs.groupBy("stream").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("sample_offset", "pcm"))).alias("runs"))
    return joined.select("stream", "doc_id", F.aggregate("runs", F.lit(b""), lambda acc, r: F.concat(acc, r["pcm"])).alias("pcm"))


def features(x: np.ndarray) -> str:
    """Mean, RMS level, zero crossings and the largest step of the samples, as text."""
    v = x.astype(np.int64)
    step = np.abs(np.diff(v)).max() if len(v) > 1 else 0
    crossings = int(((v[1:] < 0) != (v[:-1] < 0)).sum())
    return f"mean={v.mean():.4f};rms={np.sqrt((v * v).mean()):.4f};crossings={crossings};step={int(step)}"


def read_pcm(stored: DataFrame) -> DataFrame:
    """Digest of each stored stream, from its rows in order of their offsets (``n_bytes`` is passed through).

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature. ``media_*`` tell of what is stored: the signed samples of
    all blocks. A stream of several rows is put together in one task, which holds one stream at a time. Repeated rows give repeated digests, null ids stay null, an empty
    table gives none; missing blocks raise :class:`CorruptStream`.
    """
    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def digest(doc, n_bytes, n: int, runs: list[tuple[int, bytes]]) -> tuple:
        media = b"".join(pcm for _, pcm in runs)
        starts = np.cumsum([0] + [len(pcm) for _, pcm in runs])
        if len(media) != n or [at for at, _ in runs] != starts[:-1].tolist():
            raise CorruptStream("PCM blocks are missing")
        x = np.frombuffer(media, dtype=np.int8)
        data = (x.view(np.uint8) ^ 0x80).tobytes()
        return doc, n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), n, hashlib.sha256(media).hexdigest(), features(x)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in out.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        now, runs = None, []
        for batch in batches:
            done = []
            for stream, doc, n_bytes, n, at, pcm in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or now[0] != stream:
                    if now is not None:
                        done.append(digest(*now[1:], runs))
                    now, runs = (stream, doc, n_bytes, n), []
                runs.append((at, pcm))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [()] * len(types), types)], names=names)
        if now is not None:
            last = digest(*now[1:], runs)
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(last, types)], names=names)

    rows = stored.select("stream", "doc_id", "n_bytes", "n_samples", "sample_offset", "pcm")
    # A stream of one row is whole where it lies; only the rows of longer ones are brought together.
    one = F.col("n_samples") <= RUN_BLOCKS * BLOCK
    longer = rows.filter(~one).repartition("stream").sortWithinPartitions("stream", "sample_offset")
    return rows.filter(one).mapInArrow(work, out).unionByName(longer.mapInArrow(work, out))
