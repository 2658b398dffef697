"""FLAC for 8-bit mono media columns: encoder, decoder and PCM blocks, over many frames at a time.

All frames hold BLOCK samples. Frames of a whole Arrow batch are coded in lock step: one numpy operation
handles the i-th sample of every frame. Frames are found by their sync code, CRC-8 and running number, and
each must have the right CRC-16; each stream must have the MD5 that its STREAMINFO names.

The decoder reads streams of this shape: 8-bit mono, blocks of 192 samples, constant, verbatim, fixed or linear
subframes without wasted bits, one partition of Rice codes with 4-bit parameters. Anything else is a FlacError.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

BLOCK = 192  # block size code 1
RATE = 8000  # sample rate code 4
ORDER, PRECISION, SHIFT = 4, 10, 8  # of the encoder's linear predictor
SEEK_EVERY = 64  # frames between seek points
HEAD = np.array([0xFF, 0xF8, 0x14, 0x02], np.uint8)
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
U64 = np.uint64


class FlacError(ValueError):
    """Bytes that are not a whole and undamaged stream of this kind."""


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        out = np.where(out & (1 << (bits - 1)), (out << 1) ^ poly, out << 1) & ((1 << bits) - 1)
    return out.astype(np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc(buf: np.ndarray, start: np.ndarray, length: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of each range of buf."""
    lookup, mask = (CRC8, 0xFF) if bits == 8 else (CRC16, 0xFFFF)
    value = np.zeros(len(start), np.uint32)
    order = np.argsort(-length, kind="stable")
    at, left = start[order], length[order]
    live = len(at)
    for i in range(int(left[0]) if live else 0):
        while live and left[live - 1] <= i:
            live = int(np.searchsorted(-left, -i, "left"))
        x = lookup[(value[:live] >> np.uint32(bits - 8)) ^ buf[at[:live] + i]]
        value[:live] = ((value[:live] << np.uint32(8)) & np.uint32(mask)) ^ x
    out = np.empty_like(value)
    out[order] = value
    return out


#: From which number on the code of a frame number takes a byte more, and the first byte's mark.
NUMBER_STEPS, NUMBER_LEADS = (0x80, 0x800, 0x10000, 0x200000, 0x4000000), (0x00, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC)


def _number_bytes(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in FLAC's UTF-8 like code: (frames, 6) bytes and their count; 31 bits, as the format has it."""
    if len(n) and n.max() >= 1 << 31:
        raise FlacError("a stream of more than 2**31 frames")
    size = 1 + sum((n >= step).astype(np.int64) for step in NUMBER_STEPS)
    out = np.zeros((len(n), 6), np.uint8)
    for k in range(1, 7):
        m = size == k
        for j in range(k):
            v = n[m] >> (6 * (k - 1 - j))
            out[m, j] = v | NUMBER_LEADS[k - 1] if j == 0 else (v & 0x3F) | 0x80
    return out, size


def _number_size(lead: np.ndarray) -> np.ndarray:
    """Bytes of the code that begins with this byte."""
    return 1 + sum((lead >= mark).astype(np.int64) for mark in NUMBER_LEADS[1:])


def _residuals(x: np.ndarray, coefs: np.ndarray, shift: int) -> np.ndarray:
    """x: (frames, BLOCK); coefs: (frames, order); the residual of the samples after the warm-up."""
    order = coefs.shape[1]
    said = np.zeros((len(x), x.shape[1] - order), np.int32)
    for j in range(order):
        said += coefs[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j]
    return x[:, order:] - (said >> shift)


def _predictors(x: np.ndarray) -> np.ndarray:
    """Quantized coefficients of a linear predictor of each frame, by least squares."""
    f = x.astype(np.float64)
    lagged = np.stack([f[:, ORDER - j : BLOCK - j] for j in range(ORDER + 1)], 1)
    cov = lagged @ lagged.transpose(0, 2, 1)
    a = cov[:, 1:, 1:] + 1e-3 * np.eye(ORDER) * (1 + np.trace(cov, axis1=1, axis2=2))[:, None, None] * 1e-3
    c = np.linalg.solve(a, cov[:, 1:, :1])[:, :, 0]
    return np.clip(np.rint(c * (1 << SHIFT)), -(1 << (PRECISION - 1)), (1 << (PRECISION - 1)) - 1).astype(np.int32)


def _rice(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded residuals, the best parameter of each frame, and the bits that it takes."""
    u = ((e << 1) ^ (e >> 31)).astype(np.int32)
    near = np.floor(np.log2(np.maximum(u.mean(1), 1))).astype(np.int32)
    best, cost = np.zeros(len(u), np.int32), np.full(len(u), 1 << 30, np.int64)
    for d in (-1, 0, 1):
        k = np.clip(near + d, 0, 14)
        bits = (u >> k[:, None]).sum(1, dtype=np.int64) + u.shape[1] * (k + 1)
        best, cost = np.where(bits < cost, k, best), np.minimum(cost, bits)
    return u, best, cost


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    """Write the low `width` bits of each value, most significant first."""
    for j in range(width):
        bits[at + j] = (value >> (width - 1 - j)) & 1


def encode_frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x: (frames, BLOCK) samples from -128 to 127; number: of each frame in its stream.
    Returns the bytes of all frames and where each begins (one more at the end)."""
    n = len(x)
    x = x.astype(np.int32)
    num, num_size = _number_bytes(number)
    verbatim = BLOCK * 8
    choices: list[tuple[str, int, np.ndarray]] = [("constant", 0, np.where((x == x[:, :1]).all(1), 8, 1 << 30)), ("verbatim", 0, np.full(n, verbatim))]
    coded = {}
    for order in (0, 1, 2):
        coefs = np.tile(np.array(FIXED[order], np.int32), (n, 1)).reshape(n, order)
        coded["fixed", order] = (coefs, *_rice(_residuals(x, coefs, 0)))
        choices.append(("fixed", order, coded["fixed", order][3] + 8 * order + 10))
    coefs = _predictors(x)
    coded["lpc", ORDER] = (coefs, *_rice(_residuals(x, coefs, SHIFT)))
    choices.append(("lpc", ORDER, coded["lpc", ORDER][3] + ORDER * (8 + PRECISION) + 9 + 10))
    cost = np.stack([c for _, _, c in choices])
    chosen = cost.argmin(0)
    body = cost.min(0)
    head_size = 4 + num_size + 1
    size = head_size + 1 + (body + 7) // 8 + 2
    start = np.concatenate([[0], np.cumsum(size)])
    bits = np.zeros(int(start[-1]) * 8, np.uint8)
    first = (start[:-1] + head_size + 1) * 8  # bit after the subframe's header
    kinds = np.zeros(n, np.uint8)
    for c, (kind, order, _) in enumerate(choices):
        f = np.flatnonzero(chosen == c)
        if not len(f):
            continue
        at = first[f].copy()
        if kind == "constant":
            kinds[f] = 0b000000
            _put(bits, at, x[f, 0] & 0xFF, 8)
            continue
        if kind == "verbatim":
            kinds[f] = 0b000001
            _put(bits, (at[:, None] + 8 * np.arange(BLOCK)).ravel(), (x[f] & 0xFF).ravel(), 8)
            continue
        kinds[f] = (0b001000 | order) if kind == "fixed" else (0b100000 | (order - 1))
        coefs, u, k, _ = (v[f] for v in coded[kind, order])
        _put(bits, (at[:, None] + 8 * np.arange(order)).ravel(), (x[f, :order] & 0xFF).ravel(), 8)
        at += 8 * order
        if kind == "lpc":
            _put(bits, at, np.full(len(f), PRECISION - 1), 4)
            _put(bits, at + 4, np.full(len(f), SHIFT), 5)
            _put(bits, (at[:, None] + 9 + PRECISION * np.arange(order)).ravel(), (coefs & ((1 << PRECISION) - 1)).ravel(), PRECISION)
            at += 9 + PRECISION * order
        _put(bits, at + 6, k, 4)  # residual method 0 and partition order 0 are zero bits
        at += 10
        q = u >> k[:, None]
        length = q + 1 + k[:, None]
        stop = at[:, None] + np.cumsum(length, 1) - 1 - k[:, None]
        bits[stop.ravel()] = 1
        for width in np.unique(k):
            m = k == width
            _put(bits, stop[m].ravel() + 1, u[m].ravel(), int(width))
    out = np.packbits(bits)
    at = start[:-1]
    for j in range(4):
        out[at + j] = HEAD[j]
    for j in range(num.shape[1]):
        m = num_size > j
        out[at[m] + 4 + j] = num[m, j]
    out[at + head_size - 1] = crc(out, at, head_size - 1, 8)
    out[at + head_size] = kinds << 1
    check = crc(out, at, size - 2, 16)
    out[start[1:] - 2], out[start[1:] - 1] = check >> 8, check & 0xFF
    return out, start


def _preamble(pcm: bytes, sizes: np.ndarray) -> bytes:
    """Marker, STREAMINFO and SEEKTABLE."""
    low, high, samples = int(sizes.min()), int(sizes.max()), len(pcm)
    info = BLOCK.to_bytes(2) * 2 + low.to_bytes(3) + high.to_bytes(3) + ((RATE << 44) | (0 << 41) | (7 << 36) | samples).to_bytes(8) + hashlib.md5(pcm).digest()
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])[::SEEK_EVERY]
    seek = b"".join((i * SEEK_EVERY * BLOCK).to_bytes(8) + int(o).to_bytes(8) + BLOCK.to_bytes(2) for i, o in enumerate(offsets))
    return b"fLaC" + b"\x00" + len(info).to_bytes(3) + info + b"\x83" + len(seek).to_bytes(3) + seek


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload; a payload's bytes, less 128, are the samples. Lengths: positive multiples of BLOCK."""
    if any(len(p) % BLOCK or not p for p in payloads):
        raise FlacError(f"a payload's length must be a positive multiple of {BLOCK}")
    if not payloads:
        return []
    frames = np.array([len(p) // BLOCK for p in payloads])
    pcm = np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80
    ends = np.cumsum(frames)
    number = np.arange(ends[-1]) - np.repeat(ends - frames, frames)
    out, start = encode_frames(pcm.view(np.int8).reshape(-1, BLOCK), number)
    data, signed = out.tobytes(), pcm.tobytes()
    streams = []
    for a, b in zip((ends - frames).tolist(), ends.tolist(), strict=True):
        streams.append(_preamble(signed[a * BLOCK : b * BLOCK], np.diff(start[a : b + 1])) + data[start[a] : start[b]])
    return streams


def _info(stream: bytes) -> tuple[int, int, bytes, bytes]:
    """Where the frames begin, the number of samples, the MD5 and the seek table."""
    if stream[:4] != b"fLaC" or len(stream) < 42:
        raise FlacError("no FLAC stream")
    at, last, samples, md5, seek = 4, False, 0, b"", b""
    while not last:
        if at + 4 > len(stream):
            raise FlacError("the metadata is cut off")
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4])
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18])
            if int.from_bytes(body[:2]) != BLOCK or (packed >> 36) & 0xFF != 7:
                raise FlacError("not 8-bit mono in blocks of this size")
            samples, md5 = packed & ((1 << 36) - 1), body[18:34]
        elif kind == 3:
            seek = body
        at += 4 + size
    return at, samples, md5, seek


def _frame_starts(data: np.ndarray, begin: np.ndarray, end: np.ndarray, frames: np.ndarray) -> np.ndarray:
    """Where the frames of all streams begin: sync code, right CRC-8 and the next number in turn."""
    at = np.flatnonzero((data[:-3] == HEAD[0]) & (data[1:-2] == HEAD[1]) & (data[2:-1] == HEAD[2]) & (data[3:] == HEAD[3]))
    of = np.searchsorted(begin, at, "right") - 1
    ok = (of >= 0) & (at < end[np.maximum(of, 0)]) & (at + 10 < len(data))
    at, of = at[ok], of[ok]
    lead = data[at + 4].astype(np.int64)
    size = _number_size(lead)
    value = np.where(size == 1, lead, lead & (0xFF >> (size + 1))).astype(np.int64)
    for j in range(1, 6):
        value = np.where(size > j, (value << 6) | (data[at + 4 + j] & 0x3F), value)
    ok = crc(data, at, 4 + size, 8) == data[at + 4 + size]
    at, of, value = at[ok], of[ok], value[ok]
    if len(at) != frames.sum() or (value != np.arange(len(at)) - np.repeat(np.cumsum(frames) - frames, frames)).any():
        keep, want = [], {}
        for i, (s, v) in enumerate(zip(of.tolist(), value.tolist(), strict=True)):  # a like pattern inside a frame: take them in turn
            if want.get(s, 0) == v:
                keep.append(i)
                want[s] = v + 1
        at = at[keep]
        if len(at) != frames.sum():
            raise FlacError("a frame is missing or its header is damaged")
    return at


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload of each stream; FlacError where a checksum or the structure is wrong."""
    if not streams:
        return []
    infos = [_info(s) for s in streams]
    lengths = np.array([len(s) for s in streams])
    ends = np.cumsum(lengths)
    begin = ends - lengths + np.array([i[0] for i in infos])
    frames = np.array([i[1] // BLOCK for i in infos])
    data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    start = _frame_starts(data, begin, ends, frames)
    stop = np.concatenate([start[1:], [0]])
    stop[np.cumsum(frames) - 1] = ends
    if (crc(data, start, stop - start - 2, 16) != data[stop - 2].astype(np.uint32) * 256 + data[stop - 1]).any():
        raise FlacError("a frame's CRC-16 is wrong")
    pcm = decode_frames(data, start).astype(np.int8)
    signed = pcm.tobytes()
    out = (pcm.view(np.uint8) ^ 0x80).tobytes()
    payloads, at = [], 0
    for _, samples, md5, _ in infos:
        if hashlib.md5(signed[at : at + samples]).digest() != md5:
            raise FlacError("the MD5 of the samples is wrong")
        payloads.append(out[at : at + samples])
        at += samples
    return payloads


def decode_frames(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The samples of the frames that begin at `start` (16 bytes must follow the last); (frames, BLOCK)."""
    lead = data[start + 4]
    header = 5 + _number_size(lead)
    kinds = data[start + header - 0] >> 1
    first = (start + header + 1) * 8
    wide = np.zeros(len(data) - 8, U64)
    for j in range(8):
        wide |= data[j : len(data) - 8 + j].astype(U64) << U64(56 - 8 * j)

    def take(at: np.ndarray, width: int) -> np.ndarray:
        return ((wide[at >> 3] << (at & 7).astype(U64)) >> U64(64 - width)).astype(np.int64)

    out = np.zeros((len(start), BLOCK), np.int32)
    for kind in np.unique(kinds).tolist():
        f = np.flatnonzero(kinds == kind)
        at = first[f]
        if kind == 0:
            out[f] = data[at >> 3].astype(np.int8)[:, None]
            continue
        if kind == 1:
            out[f] = data[(at >> 3)[:, None] + np.arange(BLOCK)].astype(np.int8)
            continue
        if 8 <= kind <= 12:
            order, lpc = kind & 7, False
        elif kind >= 32:
            order, lpc = (kind & 31) + 1, True
        else:
            raise FlacError("a reserved subframe type")
        x = np.zeros((BLOCK, len(f)), np.int64)
        for i in range(order):
            x[i] = data[(at >> 3) + i].astype(np.int8)
        at = at + 8 * order
        shift = np.zeros(len(f), np.int64)
        coefs = np.tile(np.array(FIXED[order] if not lpc else [0] * order, np.int64)[:, None], (1, len(f)))
        if lpc:
            precision, shift = take(at, 4) + 1, take(at + 4, 5)
            at = at + 9
            for j in range(order):
                v = take(at, 16) >> (16 - precision)
                coefs[j] = v - ((v >> (precision - 1)) << precision)
                at = at + precision
        if (take(at, 6) != 0).any():
            raise FlacError("only one partition of Rice codes is read")
        k = take(at + 6, 4).astype(U64)
        at = at + 10
        for i in range(order, BLOCK):
            w = wide[at >> 3] << (at & 7).astype(U64)
            zeros = 32 - np.frexp((w >> U64(32)).astype(np.float64))[1].astype(np.int64)
            q = zeros
            long = np.flatnonzero(zeros >= 32)
            if len(long):
                q = zeros.copy()
                at = at.copy()
                while len(long):  # a long run of zeros: go on 32 bits at a time
                    at[long] += 32
                    w[long] = wide[at[long] >> 3] << (at[long] & 7).astype(U64)
                    more = 32 - np.frexp((w[long] >> U64(32)).astype(np.float64))[1].astype(np.int64)
                    q[long] += more
                    zeros[long] = more
                    long = long[more >= 32]
            low = (w << (zeros + 1).astype(U64)) >> U64(1) >> (U64(63) - k)
            at = at + zeros + 1 + k.astype(np.int64)
            u = (q << k.astype(np.int64)) | low.astype(np.int64)
            e = (u >> 1) ^ -(u & 1)
            if order:
                said = coefs[0] * x[i - 1]
                for j in range(1, order):
                    said += coefs[j] * x[i - 1 - j]
                e += said >> shift
            x[i] = e
        out[f] = x.T
    return out


def read_pcm(stream: bytes, first: int, count: int) -> bytes:
    """Payload bytes from sample `first` on, decoding only from the seek point before it."""
    begin, samples, _, seek = _info(stream)
    first, last = max(0, first), min(first + count, samples)
    if first >= last:
        return b""
    points = [(int.from_bytes(seek[i : i + 8]), int.from_bytes(seek[i + 8 : i + 16])) for i in range(0, len(seek), 18)] or [(0, 0)]
    sample, offset = max(p for p in points if p[0] <= first)
    after = [p[1] for p in points if p[0] >= last]
    part = stream[begin + offset : begin + after[0]] if after else stream[begin + offset :]
    n = (min(min((p[0] for p in points if p[0] >= last), default=samples), samples) - sample) // BLOCK
    data = np.frombuffer(part + bytes(16), np.uint8)
    at = np.flatnonzero((data[:-3] == HEAD[0]) & (data[1:-2] == HEAD[1]) & (data[2:-1] == HEAD[2]) & (data[3:] == HEAD[3]))
    num, size = _number_bytes(np.arange(sample // BLOCK, sample // BLOCK + n))
    starts, want = [], 0
    for a in at.tolist():
        if want < n and bytes(data[a + 4 : a + 4 + size[want]]) == bytes(num[want, : size[want]]) and crc(data, np.array([a]), np.array([4 + size[want]]), 8)[0] == data[a + 4 + size[want]]:
            starts.append(a)
            want += 1
    if want < n:
        raise FlacError("a frame is missing or its header is damaged")
    pcm = decode_frames(data, np.array(starts)).astype(np.int8).view(np.uint8) ^ 0x80
    return pcm.tobytes()[first - sample : last - sample]


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b" " * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw)), len(raw)


def feature_of(pcm: bytes) -> str:
    """Whole-number features of the samples: sum, energy, sign changes and peak."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int64) - 128
    return f"n={len(x)};sum={x.sum()};energy={(x * x).sum()};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};peak={np.abs(x).max() if len(x) else 0}"


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: the FLAC stream of every whole text, padded with spaces. Null text is empty;
    null doc_id and repeated rows stay; other columns are left behind; an empty table gives no rows."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        made = [payload_of(t) for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([n for _, n in made], pa.int64()), pa.array(encode([p for p, _ in made]), pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(arrow_map(one, most=2 << 20), "doc_id long, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, samples: int = BLOCK * SEEK_EVERY) -> DataFrame:
    """PCM blocks of the streams: doc_id, block, first_sample, n_samples, pcm; a block starts at a seek point.
    A damaged stream raises FlacError; a null stream gives no block."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, rows = b.column("doc_id").to_pylist(), []
        have = [(i, m) for i, m in zip(ids, b.column("media").to_pylist(), strict=True) if m is not None]
        for (i, _), pcm in zip(have, decode([m for _, m in have]), strict=True):
            rows += [(i, k // samples, k, len(pcm[k : k + samples]), pcm[k : k + samples]) for k in range(0, len(pcm), samples)]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 4 + (pa.binary(),), strict=True)], ["doc_id", "block", "first_sample", "n_samples", "pcm"])

    return media.select("doc_id", "media").mapInArrow(arrow_map(one, "media", 2 << 20), "doc_id long, block long, first_sample long, n_samples long, pcm binary")


def digests(media: DataFrame) -> DataFrame:
    """What op2 reports, from the stored streams alone; a row for each row, equal streams equal values."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        stored = b.column("media").to_pylist()
        pcm = decode(stored)
        sha = lambda xs: [hashlib.sha256(x).hexdigest() for x in xs]
        cols = {
            "doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes"), "payload_bytes": pa.array([len(p) for p in pcm], pa.int64()), "payload_sha256": pa.array(sha(pcm)), "tail_crc32": pa.array([zlib.crc32(p[-16:]) for p in pcm], pa.int64()),
            "media_bytes": pa.array([len(s) for s in stored], pa.int64()), "media_sha256": pa.array(sha(stored)), "feature": pa.array([feature_of(p) for p in pcm]),
        }
        return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(arrow_map(one, "media", 2 << 20), schema)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents as a FLAC stream, and what the stored streams give back; see encode_texts."""
    return digests(encode_texts(table(spark, sf_dir, "documents")))
