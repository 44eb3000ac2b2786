"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV, decoded by tables and across blocks.

A media cell holds one whole WAV file. Writing puts a payload into it byte for
byte; reading gives the payload back and decodes it to 16-bit PCM, which can
be resampled.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenant.llm.common import column, shared_dir, text_bytes

#: Format tags of WAV (fixed values).
ALAW, MULAW, ADPCM = 0x0006, 0x0007, 0x0011
CODECS = {"alaw": ALAW, "mulaw": MULAW, "adpcm": ADPCM}
NAMES = {v: k for k, v in CODECS.items()}
RATE = 8000
#: Payloads are whole multiples of this; an ADPCM block is one such unit: 4 bytes of state, then two samples a byte.
UNIT = 64
BLOCK_SAMPLES = 1 + 2 * (UNIT - 4)
#: Payload bytes decoded at once.
CHUNK = 4 << 20

#: IMA ADPCM (fixed values): moves of the step index, and the 89 step sizes.
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """PCM of the 256 mu-law bytes (G.711): inverted bits; sign, exponent, mantissa."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << (code >> 4 & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of the 256 A-law bytes (G.711): even bits inverted; sign, exponent, mantissa."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, base = code >> 4 & 7, ((code & 0x0F) << 4) + 8
    size = np.where(exponent == 0, base, (base + 0x100) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM (n, BLOCK_SAMPLES) of n IMA blocks (n, UNIT) of bytes: one step a sample, all blocks at once.

    A step index above 88 in a block's state counts as 88.
    """
    now = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out = np.empty((BLOCK_SAMPLES, len(blocks)), dtype=np.int16)
    out[0] = now
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for k in range(BLOCK_SAMPLES - 1):
        code = (data[k // 2] >> (4 * (k % 2))) & 0x0F
        step = STEPS[index]
        move = step >> 3
        move += np.where(code & 4, step, 0)
        move += np.where(code & 2, step >> 1, 0)
        move += np.where(code & 1, step >> 2, 0)
        now = np.clip(now + np.where(code & 8, -move, move), -32768, 32767)
        index = np.clip(index + INDEX_MOVES[code], 0, 88)
        out[k + 1] = now
    return out.T


def decode(codec: int, payload: bytes) -> np.ndarray:
    """16-bit PCM of a payload."""
    data = np.frombuffer(payload, dtype=np.uint8)
    if codec == ADPCM:
        return decode_adpcm(data.reshape(-1, UNIT)).reshape(-1)
    return TABLES[codec][data]


def doubled(pcm: np.ndarray) -> np.ndarray:
    """PCM at twice the rate: a sample and the mean with its successor (the last one repeated)."""
    wide = pcm.astype(np.int32)
    out = np.empty(2 * len(pcm), dtype=np.int16)
    out[0::2] = pcm
    out[1::2] = (wide + np.append(wide[1:], wide[-1:])) >> 1
    return out


def write_wav(codec: int, payload: bytes) -> bytes:
    """A mono 8 kHz WAV file that holds the payload unchanged; its length must be a multiple of UNIT."""
    extra, align, bits, per_byte = b"\0\0", 1, 8, 1.0
    samples = len(payload)
    if codec == ADPCM:
        extra, align, bits = struct.pack("<HH", 2, BLOCK_SAMPLES), UNIT, 4
        samples = len(payload) // UNIT * BLOCK_SAMPLES
        per_byte = UNIT / BLOCK_SAMPLES
    fmt = struct.pack("<HHIIHH", codec, 1, RATE, int(RATE * per_byte), align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, bytes]:
    """Codec and payload of a WAV file; chunks may come in any order, unknown ones are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, payload = 12, None, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            codec = struct.unpack_from("<H", media, at + 8)[0]
        elif name == b"data":
            payload = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if codec not in NAMES or payload is None:
        raise ValueError("no telephony audio in this file")
    return codec, payload


def features(pcm: np.ndarray) -> str:
    """Samples, peak, mean square and sign changes at 16 kHz, and the CRC of that PCM; whole numbers, so equal everywhere."""
    high = doubled(pcm)
    wide = high.astype(np.int32)
    negative = high < 0
    mean_square = int((wide.astype(np.int64) ** 2).sum()) // max(1, len(high))
    return f"{len(high)}:{int(np.abs(wide).max())}:{mean_square}:{int((negative[1:] != negative[:-1]).sum())}:{zlib.crc32(high.tobytes()):08x}"


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % UNIT or (0 if text else UNIT))


def codec_of(payload: bytes) -> int:
    """One of the three codecs, by content, so that equal payloads are stored alike."""
    return (ALAW, MULAW, ADPCM)[zlib.crc32(payload) % 3]


def media_column(documents: DataFrame, codec: str | None = None) -> DataFrame:
    """doc_id, n_bytes, media: the WAV file of each text's padded bytes; `codec` is alaw, mulaw, adpcm or, by content, any."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, files, first, held = [], [], 0, 0
            ids = column(batch, "doc_id")
            for k, text in enumerate(text_bytes(batch)):
                payload = padded(text)
                sizes.append(len(text))
                files.append(write_wav(CODECS[codec] if codec else codec_of(payload), payload))
                held += len(payload)
                if held >= CHUNK:
                    yield pa.RecordBatch.from_arrays([ids[first : k + 1], pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    sizes, files, first, held = [], [], k + 1, 0
            yield pa.RecordBatch.from_arrays([ids[first:], pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(of, "doc_id long, n_bytes long, media binary")


def _decoded(files: list[bytes]) -> list[tuple[int, bytes, np.ndarray]]:
    """Codec, payload and PCM of each file; the ADPCM blocks of all files together."""
    read = [read_wav(x) for x in files]
    blocks = b"".join(p for c, p in read if c == ADPCM)
    adpcm, at, out = (decode(ADPCM, blocks) if blocks else None), 0, []
    for codec, payload in read:
        if codec == ADPCM:
            n = len(payload) // UNIT * BLOCK_SAMPLES
            out.append((codec, payload, adpcm[at : at + n]))
            at += n
        else:
            out.append((codec, payload, decode(codec, payload)))
    return out


def pcm_column(media: DataFrame) -> DataFrame:
    """doc_id, pcm: 16-bit little-endian mono PCM at 16 kHz of media(doc_id, media); null media gives null."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell in column(batch, "media"):
                file = cell.as_py()
                out.append(None if file is None else doubled(decode(*read_wav(file))).astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(out, pa.binary())], names=["doc_id", "pcm"])

    return media.select("doc_id", "media").mapInArrow(of, "doc_id long, pcm binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string"


def media_digest(media: DataFrame) -> DataFrame:
    """What can be read back from media(doc_id, n_bytes, media)."""
    names = [x.split()[0] for x in DIGEST.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in DIGEST.split(", ")])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, cells = (column(batch, x) for x in ("doc_id", "n_bytes", "media"))
            first = 0
            while first < batch.num_rows:
                files, held = [], 0
                while first + len(files) < batch.num_rows and held < CHUNK:
                    files.append(cells[first + len(files)].as_py())
                    held += len(files[-1])
                rows = []
                for k, (codec, payload, pcm) in enumerate(_decoded(files)):
                    rows.append((ids[first + k].as_py(), sizes[first + k].as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(files[k]), hashlib.sha256(files[k]).hexdigest(), features(pcm), NAMES[codec]))
                yield pa.RecordBatch.from_arrays([pa.array(x, schema.field(n).type) for n, x in zip(names, zip(*rows))], schema=schema)
                first += len(files)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(of, DIGEST)


def op6_media(documents: DataFrame) -> DataFrame:
    """Digests of every row of documents(doc_id, text) after its WAV file was written to a table and read back.

    A null text is empty; an empty one is a unit of zeros. Equal texts give
    equal values; repeated rows are stored each. Ids may be null. Extra
    columns are ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    path = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    made = media_column(documents)
    made.write.option("compression", "zstd").parquet(path)
    return media_digest(spark.read.schema(made.schema).parquet(path))
