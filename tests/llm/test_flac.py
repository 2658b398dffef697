import hashlib
import random

import numpy as np
import pytest

from storyloom.llm import flac


def payloads():
    rng = random.Random(1)
    texts = ["", None, "abc", "é" * 500, "x" * 1000, "a" * 100 + "\x00" + "a" * 500, " " * 192]
    raw = [flac.payload_of(t)[0] for t in texts]
    raw += [bytes(rng.randrange(256) for _ in range(576)), bytes([0, 255] * 192), bytes(191) + b"\xff", bytes([128] * 191 + [0]) * 2]
    return [*raw, bytes(rng.randrange(97, 123) for _ in range(192 * 300)), b"\xff\xf8\x14\x02" * 96]


def test_round_trip_and_seeking():
    ps = payloads()
    streams = flac.encode(ps)
    assert flac.decode(streams) == ps and all(s.startswith(b"fLaC") for s in streams)
    big = ps[-2]
    for first, count in ((0, 10), (20_000, 30_000), (192 * 299, 192), (-5, 10**9), (10**9, 5)):
        assert flac.read_pcm(streams[-2], first, count) == big[max(0, first) : max(0, first + count)]


def test_damage_is_found():
    stream = flac.encode([payloads()[-2]])[0]
    begin = flac._info(stream)[0]
    for at in (begin + 1, begin + 5, begin + 300, len(stream) // 2, len(stream) - 1):
        with pytest.raises(flac.FlacError):
            flac.decode([stream[:at] + bytes([stream[at] ^ 8]) + stream[at + 1 :]])
    with pytest.raises(flac.FlacError):
        flac.decode([stream[:-10]])
    with pytest.raises(flac.FlacError):
        flac.encode([b"abc"])


def test_columns(spark, odd_docs, no_docs):
    media = flac.encode_texts(odd_docs)
    rows = flac.digests(media).collect()
    texts = odd_docs.collect()
    assert len(rows) == len(texts)
    assert sorted(r.n_bytes for r in rows) == sorted(len((t.text or "").encode()) for t in texts)
    joined = {}
    for r in flac.pcm_blocks(media.where("doc_id = 7")).orderBy("block").collect():
        joined[r.first_sample] = bytes(r.pcm)
    whole = b"".join(joined[k] for k in sorted(joined))
    assert whole == flac.payload_of(next(t.text for t in texts if t.doc_id == 7))[0]
    assert flac.digests(flac.encode_texts(no_docs)).count() == 0


class Bits:
    """A reader of single bits, for a decoder written from the format alone."""

    def __init__(self, data):
        self.bits, self.at = "".join(f"{x:08b}" for x in data), 0

    def take(self, n):
        self.at += n
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def signed(self, n):
        v = self.take(n)
        return v - (1 << n) if v >> (n - 1) else v


def slow_crc(data, poly, width):
    value = 0
    for x in data:
        value ^= x << (width - 8)
        for _ in range(8):
            value = ((value << 1) ^ poly if value >> (width - 1) else value << 1) & ((1 << width) - 1)
    return value


def slow_decode(stream):
    """Samples of a stream, one frame after the other, bit by bit; the checksums are computed bit by bit too."""
    assert stream[:4] == b"fLaC"
    at, last = 4, False
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4])
        if kind == 0:
            info = Bits(stream[at + 4 : at + 4 + size])
            least, most = info.take(16), info.take(16)
            info.take(48)
            rate, channels, depth, total = info.take(20), info.take(3) + 1, info.take(5) + 1, info.take(36)
            md5 = stream[at + 4 + 18 : at + 4 + 34]
        at += 4 + size
    assert least == most == 192 and channels == 1 and depth == 8 and rate == 8000
    samples, number = [], 0
    while at < len(stream):
        begin = at
        assert stream[at : at + 4] == b"\xff\xf8\x14\x02"
        lead = stream[at + 4]
        extra = 0 if lead < 0x80 else next(k for k in range(1, 6) if not lead >> (6 - k) & 1)
        coded = lead if not extra else lead & (0x3F >> extra)
        for k in range(extra):
            coded = coded << 6 | stream[at + 5 + k] & 0x3F
        assert coded == number
        at += 5 + extra
        assert stream[at] == slow_crc(stream[begin:at], 0x07, 8)
        r = Bits(stream[at + 1 : at + 1 + 900])
        assert r.take(1) == 0
        kind = r.take(6)
        assert r.take(1) == 0
        if kind == 0:
            x = [r.signed(8)] * 192
        elif kind == 1:
            x = [r.signed(8) for _ in range(192)]
        else:
            order = kind & 7 if kind < 32 else (kind & 31) + 1
            x = [r.signed(8) for _ in range(order)]
            shift, coefs = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order] if kind < 32 else None
            if kind >= 32:
                precision = r.take(4) + 1
                shift = r.signed(5)
                coefs = [r.signed(precision) for _ in range(order)]
            assert r.take(2) == 0 and r.take(4) == 0
            k = r.take(4)
            for _ in range(192 - order):
                q = 0
                while not r.take(1):
                    q += 1
                u = q << k | r.take(k) if k else q
                e = u >> 1 ^ -(u & 1)
                x.append(e + (sum(c * v for c, v in zip(coefs, x[::-1], strict=False)) >> shift))
        samples += x
        at += 1 + -(-r.at // 8)
        assert int.from_bytes(stream[at : at + 2]) == slow_crc(stream[begin:at], 0x8005, 16)
        at, number = at + 2, number + 1
    assert len(samples) == total and hashlib.md5(bytes(v & 255 for v in samples)).digest() == md5
    return samples


def test_streams_against_a_decoder_of_the_format():
    rng = random.Random(4)
    ps = [p for p in payloads() if len(p) <= 2000] + [flac.payload_of(" ".join(rng.choice(["alpha", "beta", "of"]) for _ in range(120)))[0]]
    for p, stream in zip(ps, flac.encode(ps), strict=True):
        assert bytes(v + 128 for v in slow_decode(stream)) == p


def test_digests_against_plain_loops(spark, odd_docs):
    got = sorted((tuple(r) for r in flac.digests(flac.encode_texts(odd_docs.where("doc_id <> 7 or doc_id is null"))).collect()), key=repr)
    want = []
    for r in odd_docs.where("doc_id <> 7 or doc_id is null").collect():
        raw = (r.text or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 if raw else 192)
        crc = 0xFFFFFFFF
        for x in payload[-16:]:
            crc ^= x
            for _ in range(8):
                crc = crc >> 1 ^ (0xEDB88320 if crc & 1 else 0)
        s = [x - 128 for x in payload]
        feature = f"n={len(s)};sum={sum(s)};energy={sum(x * x for x in s)};crossings={sum((a < 0) != (b < 0) for a, b in zip(s, s[1:], strict=False))};peak={max(map(abs, s))}"
        stream = flac.encode([payload])[0]
        want.append((r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), crc ^ 0xFFFFFFFF, len(stream), hashlib.sha256(stream).hexdigest(), feature))
    assert got == sorted(want, key=repr)


def test_frame_numbers_of_31_bits():
    n = np.array([0, 0x7F, 0x80, 0x7FF, 0x800, 0xFFFF, 0x10000, 0x1FFFFF, 0x200000, 0x3FFFFFF, 0x4000000, 0x7FFFFFFF])
    coded, size = flac._number_bytes(n)
    assert size.tolist() == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6]
    assert [bytes(c[:k]).decode() for c, k in zip(coded[:5], size[:5], strict=True)] == [chr(x) for x in n[:5].tolist()]
    for c, k, x in zip(coded.tolist(), size.tolist(), n.tolist(), strict=True):
        v = c[0] if k == 1 else c[0] & (0x7F >> k)
        for j in range(1, k):
            v = v << 6 | c[j] & 0x3F
        assert v == x and flac._number_size(np.array(c[:1]))[0] == k
