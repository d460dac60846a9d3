"""Operator 5: media columns in FLAC.

Payload bytes become 8-bit mono samples (byte - 128). The encoder writes fixed-size frames with a
constant, fixed or linear predictor and Rice-coded residuals, and a seek table with the byte offset
of every frame. The decoder reads the seek table, so all frames of a batch of streams are decoded
side by side: one NumPy step handles the same sample of every frame. It verifies the header's
CRC-8, the frame's CRC-16 and the stream's MD5.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import arrow_map, materialize, table, values

BLOCK = 1024  # samples a frame
UNIT = 64  # payloads are padded to a multiple of this
RATE = 8000
ORDER = 4  # of the linear predictor
PRECISION = 12
WORK = 2 << 20  # samples encoded in one step
ESCAPE = 15  # Rice parameter that the format reserves


def _crc_table(bits: int, poly: int) -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ poly if c >> (bits - 1) & 1 else c << 1
        out[i] = c & ((1 << bits) - 1)
    return out


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)  # fixed values of the format


def crc_rows(buf: np.ndarray, start: np.ndarray, length: np.ndarray, bits: int) -> np.ndarray:
    """CRC of buf[start : start + length] for many stretches at once."""
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    crc = np.zeros(len(start), np.uint32)
    live = len(start)
    for i in range(int(length[0]) if live else 0):
        while length[live - 1] <= i:
            live -= 1
        c, b = crc[:live], buf[start[:live] + i]
        crc[:live] = CRC8[c ^ b] if bits == 8 else ((c << 8) & 0xFFFF) ^ CRC16[(c >> 8) ^ b]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _frame_number(n: int) -> bytes:
    """A number in the format's UTF-8-like code."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | (n >> (6 * i)) & 0x3F for i in range(size - 1)][::-1]
    return bytes([(0xFF00 >> size) & 0xFF | n >> (6 * (size - 1)), *tail])


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: np.ndarray | int) -> None:
    """Write `width` low bits of each value at each bit position; bits start as zeros."""
    for j in range(int(np.max(width, initial=0))):
        on = (value >> j) & 1 == 1
        if not isinstance(width, int):
            on &= width > j
        bits[(at + width - 1 - j)[on]] = 1


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients of an order-ORDER linear predictor for each row, and the shift; by Levinson's recursion."""
    f = x.astype(np.float64)
    r = np.stack([np.einsum("ij,ij->i", f[:, k:], f[:, : f.shape[1] - k]) for k in range(ORDER + 1)], 1)
    r[:, 0] += 1e-3 + 1e-9 * r[:, 0]
    a = np.zeros((len(x), ORDER))
    err = r[:, 0].copy()
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / err
        new = a.copy()
        new[:, i] = k
        if i:
            new[:, :i] -= k[:, None] * a[:, i - 1 :: -1][:, :i]
        a, err = new, np.maximum(err * (1 - k * k), 1e-6)
    top = np.abs(a).max(1)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(np.maximum(top, 1e-9) + 1e-12)).astype(int), 0, PRECISION - 1)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit - 1, limit).astype(np.int64), shift.astype(np.int64)


def _residuals(x: np.ndarray, coef: np.ndarray, shift: np.ndarray) -> np.ndarray:
    out = x.copy()
    guess = np.zeros((len(x), x.shape[1] - ORDER), np.int64)
    for j in range(ORDER):
        guess += coef[:, j : j + 1] * x[:, ORDER - 1 - j : x.shape[1] - 1 - j]
    out[:, ORDER:] -= guess >> shift[:, None]
    return out


def _encode_frames(x: np.ndarray, number: np.ndarray) -> list[bytes]:
    """Frames for rows of equally many samples; number: each frame's place in its stream."""
    frames, n = x.shape
    x = x.astype(np.int64)
    coef, shift = _predictors(x)
    # kind: 0 constant, 1 fixed order 0, 2 fixed order 1, 3 linear
    fixed1 = x.copy()
    fixed1[:, 1:] -= x[:, :-1]
    linear = _residuals(x, coef, shift)
    cost = np.stack([np.abs(x).sum(1), np.abs(fixed1[:, 1:]).sum(1), np.abs(linear[:, ORDER:]).sum(1) + 4 * n // 64], 1)
    kind = 1 + cost.argmin(1)
    kind[(x == x[:, :1]).all(1)] = 0
    warm = np.array([n, 0, 1, ORDER])[kind]
    res = np.where((kind == 1)[:, None], x, np.where((kind == 2)[:, None], fixed1, linear))
    folded = np.where(res < 0, -2 * res - 1, 2 * res)
    coded = np.arange(n)[None, :] >= warm[:, None]
    folded = np.where(coded, folded, 0)
    sizes = np.stack([(folded >> k).sum(1) + (1 + k) * coded.sum(1) for k in range(9)], 1)
    rice = sizes.argmin(1)

    heads = []
    for i in range(frames):
        size = {192: 1, 256: 8, 512: 9, 1024: 10, 2048: 11, 4096: 12}.get(n, 7)  # fixed values of the format
        heads.append(bytes([0xFF, 0xF8, size << 4 | 4, 0x02]) + _frame_number(int(number[i])) + ((n - 1).to_bytes(2, "big") if size == 7 else b""))
    head_len = np.array([len(h) for h in heads])
    # bits of a subframe: header, warm-up, predictor, residual header, Rice codes
    extra = np.where(kind == 3, 4 + 5 + ORDER * PRECISION, 0)
    before = 8 + 8 * np.where(kind == 0, 1, warm) + np.where(kind == 0, 0, extra + 10)
    width = np.where(coded, (folded >> rice[:, None]) + 1 + rice[:, None], 0)
    total = before + np.where(kind == 0, 0, width.sum(1))
    body = (total + 7) // 8
    span = head_len + 1 + body + 2
    start = np.r_[0, np.cumsum(span)]
    bits = np.zeros(int(start[-1]) * 8, np.uint8)
    sub = (start[:-1] + head_len + 1) * 8
    _put(bits, sub, np.array([0, 0b0010000, 0b0010010, (0b100000 + ORDER - 1) << 1])[kind], 8)
    _put(bits, sub + 8, np.where(kind == 0, x[:, 0], 0) & 255, 8)  # a constant's value; zeros otherwise
    for j in range(ORDER):
        rows = np.flatnonzero((warm > j) & (kind > 0))
        _put(bits, sub[rows] + 8 + 8 * j, x[rows, j] & 255, 8)
    rows = np.flatnonzero(kind == 3)
    at = sub[rows] + 8 + 8 * ORDER
    _put(bits, at, np.full(len(rows), PRECISION - 1), 4)
    _put(bits, at + 4, shift[rows], 5)
    for j in range(ORDER):
        _put(bits, at + 9 + PRECISION * j, coef[rows, j] & ((1 << PRECISION) - 1), PRECISION)
    rows = np.flatnonzero(kind > 0)
    _put(bits, sub[rows] + before[rows] - 4, rice[rows], 4)  # method 0, partition order 0
    place = (sub + before)[:, None] + np.cumsum(width, 1) - width
    r, c = np.nonzero(coded)
    value, k, place = folded[r, c], rice[r], place[r, c]
    place = place + (value >> k)
    bits[place] = 1
    _put(bits, place + 1, value & ((1 << k) - 1), k)
    buf = np.packbits(bits)
    for i, h in enumerate(heads):
        buf[start[i] : start[i] + len(h)] = np.frombuffer(h, np.uint8)
    buf[start[:-1] + head_len] = crc_rows(buf, start[:-1], head_len, 8)
    c16 = crc_rows(buf, start[:-1], span - 2, 16)
    buf[start[1:] - 2], buf[start[1:] - 1] = c16 >> 8, c16 & 255
    data = buf.tobytes()
    return [data[a:b] for a, b in zip(start, start[1:], strict=False)]


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload of at least one byte."""
    groups: dict[int, list[tuple[int, int]]] = {}
    for i, p in enumerate(payloads):
        for f in range(-(-len(p) // BLOCK)):
            groups.setdefault(min(BLOCK, len(p) - f * BLOCK), []).append((i, f))
    frames: dict[tuple[int, int], bytes] = {}
    for n, keys in groups.items():
        step = max(1, WORK // 4 // n)
        for at in range(0, len(keys), step):
            part = keys[at : at + step]
            x = np.stack([np.frombuffer(payloads[i], np.uint8, n, f * BLOCK) for i, f in part]).astype(np.int16) - 128
            if n <= ORDER:
                x = np.pad(x, ((0, 0), (0, 0)))
            frames |= zip(part, _encode_frames(x, np.array([f for _, f in part])), strict=True)
    out = []
    for i, p in enumerate(payloads):
        own = [frames[i, f] for f in range(-(-len(p) // BLOCK))]
        samples = (np.frombuffer(p, np.uint8) ^ 128).tobytes()  # signed 8-bit samples, as the checksum wants them
        sizes = [len(f) for f in own]
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(samples).digest()
        at, points = 0, []
        for f, size in enumerate(sizes):
            points.append((f * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + min(BLOCK, len(p) - f * BLOCK).to_bytes(2, "big"))
            at += size
        seek = b"".join(points)
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + b"".join(own))
    return out


def _bits(buf: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """`width` (at most 24) bits at each bit position, as unsigned values."""
    b = at >> 3
    word = (buf[b].astype(np.int64) << 24) | (buf[b + 1].astype(np.int64) << 16) | (buf[b + 2].astype(np.int64) << 8) | buf[b + 3]
    return (word >> (32 - width - (at & 7))) & ((1 << width) - 1)


def _signed(v: np.ndarray, width: int) -> np.ndarray:
    return np.where(v >> (width - 1) & 1, v - (1 << width), v)


_LEAD = np.array([8] + [7 - int(np.log2(i)) for i in range(1, 256)], np.int64)


def _rice(buf: np.ndarray, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One Rice code at each bit position: value and the position after it."""
    zeros = np.zeros(len(at), np.int64)
    todo = np.arange(len(at))
    pos = at.copy()
    while len(todo):
        p = pos[todo]
        left = 8 - (p & 7)
        lead = _LEAD[(buf[p >> 3].astype(np.int64) << (p & 7)) & 255]
        hit = lead < left
        run = np.where(hit, lead, left)
        zeros[todo] += run
        pos[todo] = p + run
        todo = todo[~hit]
    value = (zeros << k) | np.where(k > 0, _bits(buf, pos + 1, 16) >> (16 - k), 0)
    return value, pos + 1 + k


def _decode_frames(buf: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Samples of frames side by side; rows padded to BLOCK. n falls from row to row."""
    if (buf[start] != 0xFF).any() or (buf[start + 1] != 0xF8).any():
        raise ValueError("no frame where the seek table says")
    lead = buf[start + 4]
    number = np.where(lead < 0x80, 1, np.maximum(1, _LEAD[255 - lead]))
    head = 4 + number + np.where(buf[start + 2] >> 4 == 7, 2, 0) + np.where(buf[start + 2] >> 4 == 6, 1, 0)
    if (crc_rows(buf, start, head, 8) != buf[start + head]).any():
        raise ValueError("a frame header's CRC-8 differs")
    at = (start + head + 1) * 8
    kind = _bits(buf, at, 8) >> 1
    at = at + 8
    order = np.where(kind >= 32, kind - 31, np.where((kind >= 8) & (kind <= 12), kind - 8, 0))
    out = np.zeros((len(start), BLOCK + ORDER), np.int64)  # samples begin at ORDER: history before them is zero
    constant = kind == 0
    value = _signed(_bits(buf, at, 8), 8)
    out[constant, ORDER:] = value[constant, None]
    rows = np.flatnonzero(~constant)
    for j in range(ORDER):
        warm = rows[order[rows] > j]
        out[warm, ORDER + j] = _signed(_bits(buf, at[warm], 8), 8)
        at[warm] += 8
    fixed = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]])  # fixed values of the format
    coef, shift = np.zeros((len(start), ORDER), np.int64), np.zeros(len(start), np.int64)
    plain = rows[kind[rows] < 32]
    coef[plain] = fixed[order[plain]]
    lpc = rows[kind[rows] >= 32]
    if len(lpc):
        precision = _bits(buf, at[lpc], 4) + 1
        if (precision != PRECISION).any():
            raise ValueError("predictor precision that this reader does not know")
        shift[lpc] = _bits(buf, at[lpc] + 4, 5)
        at[lpc] += 9
        for j in range(ORDER):
            has = lpc[order[lpc] > j]
            coef[has, j] = _signed(_bits(buf, at[has], PRECISION), PRECISION)
            at[has] += PRECISION
    if (_bits(buf, at[rows], 6) != 0).any():
        raise ValueError("partitioned residuals that this reader does not know")
    k = _bits(buf, at + 6, 4)
    if (k[rows] == ESCAPE).any():
        raise ValueError("escaped residuals that this reader does not know")
    at += 10
    # rows that are coded, longest first: the live ones are a prefix
    n_live, o, c, s, kk, p = n[rows], order[rows], coef[rows], shift[rows], k[rows], at[rows]
    work = out[rows]
    live = len(rows)
    for i in range(int(n_live[0]) if live else 0):
        while n_live[live - 1] <= i:
            live -= 1
        pick = slice(0, live) if i >= ORDER else np.flatnonzero(o[:live] <= i)
        v, p[pick] = _rice(buf, p[pick], kk[pick])
        guess = np.zeros(len(v), np.int64)
        for j in range(ORDER):
            guess += c[pick, j] * work[pick, ORDER + i - 1 - j]
        work[pick, ORDER + i] = (guess >> s[pick]) + np.where(v & 1, -(v >> 1) - 1, v >> 1)
    out[rows] = work
    return out[:, ORDER:]


def _seek_table(stream: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each frame of a stream: first sample, start and end in bytes, and samples."""
    if stream[:4] != b"fLaC" or stream[42] & 0x7F != 3:
        raise ValueError("no FLAC stream with a seek table")
    points = int.from_bytes(stream[43:46], "big") // 18
    body = 46 + 18 * points
    found = np.frombuffer(stream, ">u8,>u8,>u2", points, 46)
    start = found["f1"].astype(np.int64) + body
    return found["f0"].astype(np.int64), start, np.r_[start[1:], len(stream)], found["f2"].astype(np.int64)


def _pcm(buf: np.ndarray, start: np.ndarray, end: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Signed 8-bit PCM of frames, side by side; raises if a checksum differs."""
    if (crc_rows(buf, start, end - start, 16) != 0).any():  # over a frame with its CRC the remainder is zero
        raise ValueError("a frame's CRC-16 differs")
    order = np.argsort(-n, kind="stable")
    samples = np.empty((len(start), BLOCK), np.uint8)
    samples[order] = (_decode_frames(buf, start[order], n[order]) & 255).astype(np.uint8)
    return [row[:size].tobytes() for row, size in zip(samples, n.tolist(), strict=True)]


def decode_blocks_of(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """PCM blocks of streams that encode_streams wrote, a frame each with the sample it starts at; raises if a checksum differs."""
    if not streams:
        return []
    tables = [_seek_table(s) for s in streams]
    at = np.r_[0, np.cumsum([len(s) for s in streams])]
    buf = np.frombuffer(b"".join(streams) + bytes(8), np.uint8)
    start, end = (np.concatenate([t[i] + a for t, a in zip(tables, at, strict=False)]) for i in (1, 2))
    pcm = _pcm(buf, start, end, np.concatenate([t[3] for t in tables]))
    first = np.r_[0, np.cumsum([len(t[0]) for t in tables])]
    out = []
    for s, (sample, *_), a, b in zip(streams, tables, first, first[1:], strict=False):
        if hashlib.md5(b"".join(pcm[a:b])).digest() != s[26:42]:
            raise ValueError("a stream's MD5 differs")
        out.append(list(zip(sample.tolist(), pcm[a:b], strict=True)))
    return out


def seek(stream: bytes, sample: int) -> tuple[int, bytes]:
    """The PCM block that holds a sample, and the sample it starts at: only its frame is decoded."""
    first, start, end, n = _seek_table(stream)
    i = int(np.searchsorted(first, sample, side="right")) - 1
    if i < 0 or sample >= first[i] + n[i]:
        raise IndexError("no such sample")
    one = slice(i, i + 1)
    frame = np.frombuffer(stream[start[i] : end[i]] + bytes(8), np.uint8)
    return int(first[i]), _pcm(frame, np.zeros(1, np.int64), end[one] - start[one], n[one])[0]


def payload_of(blocks: list[bytes]) -> bytes:
    """Payload bytes of PCM blocks in order."""
    return (np.frombuffer(b"".join(blocks), np.uint8) ^ 128).tobytes()


def decode_streams(streams: list[bytes]) -> list[bytes]:
    """Payload bytes of streams that encode_streams wrote; raises if a checksum differs."""
    return [payload_of([pcm for _, pcm in blocks]) for blocks in decode_blocks_of(streams)]


def pad(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def feature(payload: bytes) -> str:
    """Samples, mean, deviation, zero crossings and the energy of eight equal stretches of the decoded signal."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    energy = ":".join(f"{v:.1f}" for v in np.square(x).reshape(8, -1).mean(1))
    return f"{len(x)};{x.mean():.4f};{x.std():.4f};{int(((x[1:] < 0) != (x[:-1] < 0)).sum())};{energy}"


def _to_media(part: pa.RecordBatch) -> dict:
    texts = values(part, "text")
    return {"n_bytes": [len((t or "").encode()) for t in texts], "media": encode_streams([pad(t) for t in texts])}


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a FLAC stream) of every document (doc_id, text).

    A null or empty text gives one unit of zero bytes. Equal texts give equal streams; repeated rows
    give equal rows; an empty table gives none. Other columns are not read.
    """
    return arrow_map(docs.select("doc_id", "text"), _to_media, "n_bytes long, media binary", keep=["doc_id"])


BLOCKS = "array<struct<sample_offset:long,pcm:binary>>"


def _to_store(part: pa.RecordBatch) -> dict:
    media = values(part, "media")
    blocks = [[{"sample_offset": at, "pcm": pcm} for at, pcm in b] for b in decode_blocks_of(media)]
    return {"media_bytes": [len(m) for m in media], "media_sha256": [hashlib.sha256(m).hexdigest() for m in media], "blocks": blocks}


def store_blocks(media: DataFrame) -> DataFrame:
    """Decode media rows (doc_id, n_bytes, media) frame by frame and write them as PCM blocks with seekable sample offsets.

    Returns the written table: doc_id, n_bytes, media_bytes, media_sha256 and blocks, the stream's
    signed 8-bit PCM in order, each block with the sample it starts at. media must not be null; a
    broken checksum raises. Repeated rows give equal rows; an empty table gives none.
    """
    return materialize(arrow_map(media.select("doc_id", "n_bytes", "media"), _to_store, f"media_bytes long, media_sha256 string, blocks {BLOCKS}", keep=["doc_id", "n_bytes"], by="media"))


def decode_blocks(stored: DataFrame) -> DataFrame:
    """The blocks of store_blocks one to a row: doc_id, block, sample_offset, n_samples, pcm. Seeking is a filter on the offset."""
    rows = stored.select("doc_id", F.posexplode("blocks").alias("block", "b"))
    return rows.select("doc_id", "block", "b.sample_offset", F.octet_length("b.pcm").alias("n_samples"), "b.pcm")


def _summary(part: pa.RecordBatch) -> dict:
    blocks = values(part, "blocks")
    back = [payload_of([x["pcm"] for x in b]) for b in blocks]
    at = lambda x: x["sample_offset"].to_bytes(8, "little") + zlib.crc32(x["pcm"]).to_bytes(4, "little")
    return {
        "payload_bytes": [len(p) for p in back], "payload_sha256": [hashlib.sha256(p).hexdigest() for p in back], "tail_crc32": [zlib.crc32(p[-UNIT:]) for p in back], "feature": [feature(p) for p in back],
        "n_blocks": [len(b) for b in blocks], "blocks_crc32": [zlib.crc32(b"".join(map(at, b))) for b in blocks],
    }


def describe_media(media: DataFrame) -> DataFrame:
    """Decode the streams into written PCM blocks; digests of payload, blocks and stream and a feature of the signal come from what was written.

    blocks_crc32 covers each block's sample offset and CRC-32. media must not be null; repeated rows
    give equal rows, an empty table none.
    """
    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, n_blocks int, blocks_crc32 long"
    return arrow_map(store_blocks(media), _summary, schema, keep=["doc_id", "n_bytes", "media_bytes", "media_sha256"], by="media_sha256")


def op5_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, stored as FLAC, decoded into written PCM blocks and read back from them. Null and empty texts give one unit of zeros."""
    return describe_media(encode_media(table(spark, sf_dir, "documents")))
