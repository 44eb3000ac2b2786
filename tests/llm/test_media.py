import hashlib
import zlib

import numpy as np
import pytest

from provenant.llm import media


def plain_adpcm(block):
    """One IMA block, sample by sample."""
    now, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [now]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            move = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                if code & bit:
                    move += part
            now = max(-32768, min(32767, now - move if code & 8 else now + move))
            index = max(0, min(88, index + (-1 if code & 7 < 4 else 2 * (code & 7) - 6)))
            out.append(now)
    return out


def test_tables():
    mu, a = media.TABLES[media.MULAW].tolist(), media.TABLES[media.ALAW].tolist()
    # published corners of G.711
    assert (mu[0x00], mu[0x80], mu[0x7F], mu[0xFF], mu[0x8F]) == (-32124, 32124, 0, 0, 16764)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(a)) == 256 and len(set(mu)) == 255
    assert len(media.STEPS) == 89


def test_adpcm_across_blocks_equals_sample_by_sample():
    data = np.random.default_rng(0).integers(0, 256, (50, 64), dtype=np.uint8)
    assert media.decode_adpcm(data).tolist() == [plain_adpcm(bytes(b)) for b in data]


@pytest.mark.parametrize("codec", list(media.NAMES))
def test_round_trip(codec):
    for n in (64, 128, 6400):
        payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
        assert media.read_wav(media.write_wav(codec, payload)) == (codec, payload)
    with pytest.raises(ValueError):
        media.read_wav(b"RIFF    WAVE")


def test_doubled():
    assert media.doubled(np.array([0, 10, -3], dtype=np.int16)).tolist() == [0, 5, 10, 3, -3, -3]


def test_op6(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "long text " * 100_000, "x" * 64]
    rows = [(i if i else None, t, b"m", 1) for i, t in enumerate(texts)]
    got = media.op6_media(spark.createDataFrame(rows, "doc_id long, text string, media binary, n_bytes int")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id or 0: r for r in got}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest())
        assert r.tail_crc32 == zlib.crc32(pad[-64:])
        file = media.write_wav(media.CODECS[r.codec], pad)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        assert r.feature == media.features(media.decode(media.CODECS[r.codec], pad))
    assert by[4][1:] == by[6][1:]
    assert media.op6_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("codec", ["alaw", "mulaw", "adpcm"])
def test_pcm_column(spark, codec):
    docs = spark.createDataFrame([(1, "telephone"), (2, None)], "doc_id long, text string")
    for r in media.pcm_column(media.media_column(docs, codec)).collect():
        payload = media.padded(b"telephone" if r.doc_id == 1 else b"")
        assert np.frombuffer(r.pcm, "<i2").tolist() == media.doubled(media.decode(media.CODECS[codec], payload)).tolist()
