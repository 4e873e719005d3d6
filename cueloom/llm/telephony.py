"""Telephony audio: mu-law, A-law and IMA ADPCM media columns and their resampled PCM.

A media value is a WAVE file with 8-bit mu-law or A-law samples, or ADPCM blocks, at 8 kHz. Companded samples are expanded by
256-entry tables. ADPCM blocks don't depend on each other, so a batch decodes sample 1 of all its blocks, then sample 2, and
so on: a fixed number of numpy steps whatever the number of blocks. PCM is resampled to 16 kHz by a half-band filter in
integers, so results are exact and the same on every machine.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cueloom.llm.common import small_batches

RATE = 8000
#: WAVE format tags.
TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 17}
#: Bytes of an ADPCM block: four of header, two samples in each other.
BLOCK = 64
#: Samples handled at once; longer media pass in pieces.
PIECE = 1 << 20

# Fixed values of the IMA ADPCM standard: step sizes, and what a code's three low bits add to the step's index.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
INDEX_MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    power, size = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(power > 0, (size + 256) << np.maximum(power - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


EXPAND = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """By 16 * index + code: the change of the prediction, and 16 * the next index."""
    step, code = np.repeat(STEPS, 16), np.tile(np.arange(16, dtype=np.int32), len(STEPS))
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    after = np.clip(np.repeat(np.arange(len(STEPS)), 16) + np.array(INDEX_MOVES)[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -change, change).astype(np.int32), (16 * after).astype(np.int32)


CHANGE, AFTER = _adpcm_tables()


def adpcm_decode(data: np.ndarray) -> np.ndarray:
    """int16 samples, (blocks, 121): whole 64-byte blocks, decoded across blocks."""
    blocks = data.reshape(-1, BLOCK)
    level = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = 16 * np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * (BLOCK - 4), len(blocks)), dtype=np.int16)
    out[0] = level
    for i, column in enumerate(body):
        for half, code in enumerate((column & 15, column >> 4)):
            at = index + code
            level = np.clip(level + CHANGE[at], -32768, 32767)
            index = AFTER[at]
            out[1 + 2 * i + half] = level
    return out.T


def wave(samples: bytes, codec: str = "mulaw") -> bytes:
    """A WAVE file whose data chunk is ``samples`` as they are."""
    align = BLOCK if codec == "adpcm" else 1
    per = 1 + 2 * (BLOCK - 4) if codec == "adpcm" else 1
    extra = struct.pack("<HH", 2, per) if codec == "adpcm" else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, RATE * align // per, align, 4 if codec == "adpcm" else 8) + extra
    chunks = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, len(samples) // align * per)
    odd = b"\x00" * (len(samples) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks) + 8 + len(samples) + len(odd)) + b"WAVE" + chunks + b"data" + struct.pack("<I", len(samples)) + samples + odd


def parse_wave(media: bytes) -> tuple[str, bytes]:
    """Codec and data chunk of a WAVE file; ValueError where it is none of the three kinds."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    at, tag = 12, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
        if kind == b"data":
            names = [k for k, v in TAGS.items() if v == tag]
            if not names:
                raise ValueError(f"format tag {tag}")
            return names[0], media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def payload(text: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64 are appended."""
    return text + b"\x00" * (-len(text) % BLOCK or (0 if text else BLOCK))


def pcm_pieces(codec: str, samples: bytes) -> Iterator[np.ndarray]:
    """int16 PCM at 8 kHz, in pieces."""
    data = np.frombuffer(samples, dtype=np.uint8)
    if codec == "adpcm":
        whole = len(data) // BLOCK * BLOCK
        for low in range(0, whole, PIECE):
            yield adpcm_decode(data[low : min(whole, low + PIECE)]).reshape(-1)
    else:
        for low in range(0, len(data), PIECE):
            yield EXPAND[codec][data[low : low + PIECE]]


def resample(pieces: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """Twice the rate: samples stay, and between two stands (-a + 9b + 9c - d + 8) >> 4 of the four around; edges repeat."""
    last: np.ndarray | None = None  # two samples before, and those not yet written
    for piece in pieces:
        x = piece.astype(np.int32)
        if not len(x):
            continue
        last = np.concatenate((x[:1], x)) if last is None else np.concatenate((last, x))
        if len(last) >= 4:
            yield _between(last)
            last = last[-3:]
    if last is not None:
        yield _between(np.concatenate((last, last[-1:], last[-1:])))


def _between(x: np.ndarray) -> np.ndarray:
    """x[1:-2] and the middles after them."""
    out = np.empty(2 * (len(x) - 3), dtype="<i2")
    out[0::2] = x[1:-2]
    out[1::2] = np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4, -32768, 32767)
    return out


class _Tally:
    """Peak, energy (rounded down) and zero crossings of int16 PCM in pieces, all integers."""

    def __init__(self) -> None:
        self.peak = self.power = self.count = self.crossed = 0
        self.sign: bool | None = None

    def add(self, pcm: np.ndarray) -> None:
        if not len(pcm):
            return
        wide = pcm.astype(np.int64)
        below = wide < 0
        self.peak = max(self.peak, int(np.abs(wide).max()))
        self.power, self.count = self.power + int(np.dot(wide, wide)), self.count + len(wide)
        self.crossed += int((below[1:] != below[:-1]).sum()) + (self.sign is not None and self.sign != bool(below[0]))
        self.sign = bool(below[-1])

    def __str__(self) -> str:
        return f"{self.peak}/{self.power // max(1, self.count)}/{self.crossed}"


def store(docs: DataFrame, text: str = "text", ident: str = "doc_id", codec: str = "mulaw") -> DataFrame:
    """(doc_id, n_bytes, media, pcm): every text's bytes as a WAVE file, and its PCM at 16 kHz, 16 bits.

    Defined cases: a null or empty text is 64 zero bytes; texts of any length are stored whole; rows are independent, so
    equal texts get equal values and an empty table stays empty; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(ident).alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                rows = [x.as_py() for x in part.column(1)]
                media = [wave(payload(x), codec) for x in rows]
                pcm = [b"".join(y.tobytes() for y in resample(pcm_pieces(*parse_wave(m)))) for m in media]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in rows], pa.int64()), pa.array(media, pa.binary()), pa.array(pcm, pa.binary())], ["doc_id", "n_bytes", "media", "pcm"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, pcm binary")


_SUMMARY = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def _summaries(texts: list[bytes], codec: str) -> list[tuple]:
    media = [wave(payload(x), codec) for x in texts]
    read = [parse_wave(m) for m in media]
    # the blocks of all rows together; rows over a piece are decoded by themselves
    small = [i for i, (_, p) in enumerate(read) if len(p) <= PIECE]
    blocks = [len(read[i][1]) // BLOCK for i in small]
    joined = adpcm_decode(np.frombuffer(b"".join(read[i][1] for i in small), dtype=np.uint8)) if small else None
    ends = np.cumsum(blocks)
    at = {i: (int(e) - n, int(e)) for i, e, n in zip(small, ends, blocks, strict=True)}
    out = []
    for i, (found, held) in enumerate(read):
        told, crc = {k: _Tally() for k in ("mulaw", "alaw", "adpcm", "16k")}, 0
        for k in ("mulaw", "alaw"):
            for piece in pcm_pieces(k, held):
                told[k].add(piece)
        for piece in [joined[slice(*at[i])].reshape(-1)] if i in at else pcm_pieces("adpcm", held):
            told["adpcm"].add(piece)
        for piece in resample(pcm_pieces(found, held)):
            told["16k"].add(piece)
            crc = zlib.crc32(piece.tobytes(), crc)
        feature = " ".join(f"{k}:{v}" for k, v in told.items()) + f" pcm:{crc:08x}"
        out.append((len(texts[i]), len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-64:]), len(media[i]), hashlib.sha256(media[i]).hexdigest(), feature))
    return out


def summarise(docs: DataFrame, text: str = "text", ident: str = "doc_id", codec: str = "mulaw") -> DataFrame:
    """What :func:`store` keeps of every row, read back from the WAVE bytes, as digests and features.

    The feature gives peak/energy/zero crossings of the data read as mu-law, as A-law and as ADPCM blocks, those of the 16
    kHz PCM, and that PCM's CRC. Cases as in :func:`store`.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(ident).alias("doc_id"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            while low < batch.num_rows:
                rows, held = [], 0
                while low + len(rows) < batch.num_rows and (not rows or held < 2 << 20) and len(rows) < 2048:
                    rows.append(batch.column(1)[low + len(rows)].as_py())
                    held += len(rows[-1])
                made = _summaries(rows, codec)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(rows)), *[pa.array([x[k] for x in made], t) for k, (_, t) in enumerate(_SUMMARY)]], ["doc_id", *[n for n, _ in _SUMMARY]])
                low += len(rows)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
