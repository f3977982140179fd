import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from kindred.llm import flac, media


def test_round_trip_of_many_kinds():
    rng = np.random.default_rng(0)
    tone = (128 + 100 * np.sin(np.arange(19200) / 9)).astype(np.uint8).tobytes()
    payloads = [b" " * 192, bytes(range(192)), os.urandom(1920), tone, b"\x00\xff" * 960, b"plain text of words " * 96, rng.integers(60, 70, 192 * 300, dtype=np.uint8).tobytes(), b"\xff\xf8\x14\x02" * 480]
    stored = flac.encode_many(payloads)
    assert flac.decode_many(stored) == payloads
    for s, p in zip(stored, payloads, strict=True):
        assert flac._pcm(*flac.decode_stream(s)) == p
    assert len(stored[3]) < len(payloads[3]) * 0.7


@pytest.mark.parametrize("seed", range(6))
def test_damage_is_found(seed):
    random.seed(seed)
    stored = bytearray(flac.encode_many([b"some words of a text " * 64 * 3])[0])
    stored[random.randrange(42, len(stored))] ^= 1 << random.randrange(8)
    with pytest.raises(ValueError):
        flac.decode_many([bytes(stored)])


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, width):
        self.bits += format(value & (1 << width) - 1, f"0{width}b") if width else ""

    def bytes(self):
        self.bits += "0" * (-len(self.bits) % 8)
        return int(self.bits, 2).to_bytes(len(self.bits) // 8, "big")


def residual(w, values, order, parts, escape):
    w.put(0, 2)
    w.put(parts, 4)
    size = (len(values) + order) >> parts
    at = 0
    for part in range(1 << parts):
        own = values[at : at + size - (order if part == 0 else 0)]
        at += len(own)
        if escape and part == 1:
            w.put(15, 4)
            w.put(12, 5)
            for v in own:
                w.put(v, 12)
            continue
        w.put(2, 4)
        for v in own:
            u = v << 1 if v >= 0 else (-v << 1) - 1
            w.bits += "0" * (u >> 2) + "1"
            w.put(u & 3, 2)


def test_stereo_partitions_wasted_bits_and_lpc_of_other_encoders():
    rng = np.random.default_rng(1)
    n = 256
    left = np.cumsum(rng.integers(-3, 4, n)) * 2
    right = left - rng.integers(0, 5, n)
    left, right = left.tolist(), right.tolist()
    side = [a - b for a, b in zip(left, right, strict=True)]
    w = Writer()
    w.put(0b111111111111100, 15)
    w.put(0, 1)
    w.put(8, 4)  # 256 samples
    w.put(9, 4)
    w.put(8, 4)  # left and side
    w.put(4, 3)  # 16 bits
    w.put(0, 1)
    w.put(0, 8)
    w.put(flac.crc_bytes(Writer.bytes(w), 8), 8)
    # Left: linear predictor of order 2 over halved samples (one wasted bit), 4 partitions, one of them raw.
    w.put(0, 1)
    w.put(33, 6)
    w.put(1, 1)
    w.bits += "1"
    half = [v >> 1 for v in left]
    for v in half[:2]:
        w.put(v, 15)
    w.put(4, 4)
    w.put(1, 5)
    for c in (3, -1):
        w.put(c, 5)
    residual(w, [half[i] - ((3 * half[i - 1] - half[i - 2]) >> 1) for i in range(2, n)], 2, 2, True)
    # Side, 17 bits: fixed predictor of order 1.
    w.put(0, 1)
    w.put(9, 6)
    w.put(0, 1)
    w.put(side[0], 17)
    residual(w, [side[i] - side[i - 1] for i in range(1, n)], 1, 0, False)
    frame = w.bytes()
    frame += flac.crc_bytes(frame, 16).to_bytes(2, "big")
    pcm = np.array([left, right]).T.astype("<i2").tobytes()
    info = (256 << 128) | (256 << 112) | (44100 << 44) | (1 << 41) | (15 << 36) | n
    stream = b"fLaC" + b"\x00\x00\x00\x22" + info.to_bytes(18, "big") + hashlib.md5(pcm).digest() + b"\x84\x00\x00\x04abcd" + frame
    assert flac.decode_many([stream]) == [pcm]
    assert media.blocks_of([stream], 100)[0][2] == (200, 56, pcm[800:])


def test_operator(spark):
    texts = ["", None, "short", "x" * 192, "ü" * 97, "long text of many words " * 9000, "short"]
    df = spark.createDataFrame([(i, t, b"clash") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    streams = media.encode_text(df)
    got = {r.doc_id: r for r in media.digest(streams).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = media.pad(raw)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert tuple(got[2])[1:] == tuple(got[6])[1:]
    blocks = media.pcm_blocks(streams, "doc_id", samples=50_000).filter("doc_id = 5").orderBy("block").collect()
    assert b"".join(b.pcm for b in blocks) == media.pad(texts[5].encode())
    assert [b.first_sample for b in blocks] == [i * 50_000 for i in range(len(blocks))] and len(blocks) > 3
    assert media.digest(media.encode_text(df.limit(0))).count() == 0


def test_written_blocks_can_be_sought(spark, tmp_path):
    texts = ["".join(random.Random(k).choices("some words é ", k=n)) for k, n in enumerate((0, 10, 5000))]
    streams = media.encode_text(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    path = str(tmp_path / "blocks")
    media.write_blocks(streams, "doc_id", path, samples=300)
    for k, text in enumerate(texts):
        whole = media.pad(text.encode())
        assert media.read_samples(spark, path, "doc_id", k, 0, len(whole)) == whole
        for first, count in ((0, 1), (150, 7), (299, 2), (len(whole) - 3, 3), (250, 1000)):
            assert media.read_samples(spark, path, "doc_id", k, first, count) == whole[first : first + count]
