"""Media columns: AVI motion-JPEG clips in a binary column.

A clip is a RIFF file with an ``idx1`` index; each frame is a baseline JPEG.
Bytes are stored without loss in JPEG's own unit, the quantised coefficient: 64
bytes are one 8x8 block, byte ``b`` being coefficient 256 + b.  All such
coefficients have amplitude category 9, so with one-symbol Huffman tables and a
restart after each block every block takes 80 bytes (but for stuffing), and both
directions are plain bit arithmetic on arrays.  Other baseline JPEG frames
(grey or colour, any tables) go through the general entropy decoder.

Shots are found where the difference of neighbouring frames' histograms exceeds
the mean of the differences around it by a multiple of their deviation.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from almagest.llm.common import id_text, text_bytes

BLOCK = 64
#: Blocks across and down in a payload frame, and frames a second.
ACROSS, DOWN, RATE = 8, 4, 25
_PAYLOAD = b"ALMB"

_k = np.arange(8)
_DCT = np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16) * np.where(_k[:, None] == 0, np.sqrt(1 / 8), 0.5)
#: Zigzag place -> row-major place, by walking the diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def _huffman(kind: int, symbol: int) -> bytes:
    """A table whose only code, one bit long, stands for ``symbol``."""
    return bytes([kind, 1] + [0] * 15 + [symbol])


def _head(across: int, down: int) -> bytes:
    return b"".join((
        b"\xff\xd8", _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC0, struct.pack(">BHHB3B", 8, 8 * down, 8 * across, 1, 1, 0x11, 0)),
        _segment(0xC4, _huffman(0x00, 9) + _huffman(0x10, 9)), _segment(0xDD, struct.pack(">H", 1)), _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ))


_FRAME_HEAD = _head(ACROSS, DOWN)


def pack_blocks(blocks: np.ndarray) -> bytes:
    """The entropy-coded scan of byte blocks (n, 64), with restart marks between them."""
    v = blocks.reshape(len(blocks), 16, 4)
    a, b, c, d = v[:, :, 0], v[:, :, 1], v[:, :, 2], v[:, :, 3]
    out = np.empty((len(blocks), 82), dtype=np.uint8)
    bits = np.empty((len(blocks), 16, 5), dtype=np.uint8)
    bits[:, :, 0] = 0x40 | a >> 2
    bits[:, :, 1] = (a & 3) << 6 | 0x10 | b >> 4
    bits[:, :, 2] = (b & 15) << 4 | 0x04 | c >> 6
    bits[:, :, 3] = (c & 63) << 2 | 0x01
    bits[:, :, 4] = d
    out[:, :80] = bits.reshape(len(blocks), 80)
    out[:, 80] = 0xFF
    out[:, 81] = 0xD0 + np.arange(len(blocks)) % 8
    if (d == 0xFF).any():
        rows = [bytes(r[:80]).replace(b"\xff", b"\xff\0") + bytes(r[80:]) for r in out]
        return b"".join(rows)[:-2]
    return out.tobytes()[:-2]


def _unpack_fixed(scan: bytes, n: int) -> np.ndarray | None:
    """Byte blocks of a scan as ``pack_blocks`` writes it, or None if it is another."""
    if len(scan) != 82 * n - 2:
        parts = [p.replace(b"\xff\0", b"\xff") for p in _restarts(scan)]
        if len(parts) != n or any(len(p) != 80 for p in parts):
            return None
        raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
    else:
        raw = np.frombuffer(scan + b"\0\0", dtype=np.uint8).reshape(n, 82)[:, :80]
    v = raw.reshape(n, 16, 5)
    out = np.empty((n, 16, 4), dtype=np.uint8)
    out[:, :, 0] = v[:, :, 0] << 2 | v[:, :, 1] >> 6
    out[:, :, 1] = v[:, :, 1] << 4 | v[:, :, 2] >> 4
    out[:, :, 2] = v[:, :, 2] << 6 | v[:, :, 3] >> 2
    out[:, :, 3] = v[:, :, 4]
    return out.reshape(n, 64)


def _restarts(scan: bytes) -> list[bytes]:
    parts, at = [], 0
    while True:
        end = scan.find(b"\xff", at)
        while end >= 0 and not 0xD0 <= scan[end + 1] <= 0xD7:
            end = scan.find(b"\xff", end + 2)
        if end < 0:
            return [*parts, scan[at:]]
        parts.append(scan[at:end])
        at = end + 2


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.value, self.held = data.replace(b"\xff\0", b"\xff"), 0, 0, 0

    def take(self, n: int) -> int:
        while self.held < n:
            self.value = self.value << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)
            self.at += 1
            self.held += 8
        self.held -= n
        out = self.value >> self.held
        self.value &= (1 << self.held) - 1
        return out

    def symbol(self, table: dict) -> int:
        code = 0
        for size in range(1, 17):
            code = code << 1 | self.take(1)
            found = table.get((size, code))
            if found is not None:
                return found
        raise ValueError("bad code in a JPEG scan")

    def signed(self, size: int) -> int:
        if not size:
            return 0
        v = self.take(size)
        return v if v >> size - 1 else v - (1 << size) + 1


def decode_frame(jpeg: bytes) -> dict:
    """Coefficients (zigzag, by component), tables and size of a baseline JPEG; ``fixed`` has byte blocks if it is a payload frame."""
    at, quant, huff, every, frame = 2, {}, {}, 0, None
    while True:
        mark, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(int)
                body = body[65 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                counts, code, table, used = body[1:17], 0, {}, 17
                for length, n in enumerate(counts, 1):
                    for _ in range(n):
                        table[length, code] = body[used]
                        code, used = code + 1, used + 1
                    code <<= 1
                huff[body[0]] = table
                body = body[used:]
        elif mark == 0xC0:
            _, high, wide, n = struct.unpack(">BHHB", body[:6])
            frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif mark == 0xDD:
            every = int.from_bytes(body, "big")
        elif mark == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
        elif 0xC1 <= mark <= 0xCF:
            raise ValueError("only baseline JPEG frames are read")
    end = jpeg.rfind(b"\xff\xd9")
    scan = jpeg[at : end if end >= 0 else None]
    out = {"width": wide, "height": high, "quant": quant, "components": frame, "fixed": None}
    if len(frame) == 1:
        frame = [(frame[0][0], 1, 1, frame[0][3])]
    hmax, vmax = max(c[1] for c in frame), max(c[2] for c in frame)
    across, down = -(-wide // (8 * hmax)), -(-high // (8 * vmax))
    if every == 1 and len(frame) == 1 and huff.get(0) == {(1, 0): 9} and huff.get(0x10) == {(1, 0): 9}:
        out["fixed"] = _unpack_fixed(scan, across * down)
        if out["fixed"] is not None:
            out["blocks"] = {frame[0][0]: out["fixed"].astype(int) + 256}
            return out
    blocks = {c[0]: np.zeros((across * c[1] * down * c[2], 64), dtype=int) for c in frame}
    parts = _restarts(scan)
    bits, last, part = _Bits(parts[0]), dict.fromkeys(blocks, 0), 0
    for mcu in range(across * down):
        if every and mcu and mcu % every == 0:
            part += 1
            bits, last = _Bits(parts[part]), dict.fromkeys(blocks, 0)
        for name, h, v, _ in frame:
            dc, ac = huff[chosen[name] >> 4], huff[0x10 | chosen[name] & 15]
            for y in range(v):
                for x in range(h):
                    here = blocks[name][((mcu // across) * v + y) * across * h + (mcu % across) * h + x]
                    last[name] += bits.signed(bits.symbol(dc))
                    here[0], k = last[name], 1
                    while k < 64:
                        run = bits.symbol(ac)
                        if run == 0:
                            break
                        k += run >> 4
                        if run & 15:
                            here[k] = bits.signed(run & 15)
                        k += 1
    return out | {"blocks": blocks}


def luma(frame: dict) -> np.ndarray:
    """The first component's 8-bit samples (rows of blocks are as the scan has them)."""
    name, h, _, table = frame["components"][0]
    blocks = frame["blocks"][name] * frame["quant"][table]
    square = np.zeros((len(blocks), 64))
    square[:, ZIGZAG] = blocks
    samples = _DCT.T @ square.reshape(-1, 8, 8) @ _DCT
    return np.clip(np.rint(samples + 128), 0, 255).astype(np.uint8)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes], width: int, height: int, rate: int = RATE, extra: bytes = b"") -> bytes:
    """A RIFF AVI file with one MJPG stream; ``extra`` is the stream's own data chunk."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // rate, largest * rate, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, rate, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    strl = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + (_chunk(b"strd", extra) if extra else b"")
    movi, index = [b"movi"], []
    at = 4
    for jpeg in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(jpeg)))
        movi.append(_chunk(b"00dc", jpeg))
        at += len(movi[-1])
    body = b"AVI " + _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", strl)) + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def _chunks(data: bytes, at: int, end: int):
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], at + 8, size
        at += 8 + size + (size & 1)


def read_avi(data: bytes) -> dict:
    """Frames (through idx1, or by walking movi where there is none), rate, size and the stream's own data."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out, movi, index = {"frames": [], "rate": float(RATE), "extra": b""}, None, None
    for name, at, size in _chunks(data, 12, len(data)):
        if name == b"LIST" and data[at : at + 4] == b"hdrl":
            for part, a, n in _chunks(data, at + 4, at + size):
                if part == b"avih":
                    out["width"], out["height"] = struct.unpack("<II", data[a + 32 : a + 40])
                elif part == b"LIST":
                    for inner, b, m in _chunks(data, a + 4, a + n):
                        if inner == b"strh":
                            scale, rate = struct.unpack("<II", data[b + 20 : b + 28])
                            out["rate"] = rate / max(scale, 1)
                        elif inner == b"strd":
                            out["extra"] = data[b : b + m]
        elif name == b"LIST" and data[at : at + 4] == b"movi":
            movi = at, size
        elif name == b"idx1":
            index = data[at : at + size]
    if movi and index is not None:
        for kind, _, place, size in struct.iter_unpack("<4sIII", index):
            if kind[2:] in (b"dc", b"db"):
                start = place + movi[0] if data[place + movi[0] : place + movi[0] + 4] == kind else place
                out["frames"].append(data[start + 8 : start + 8 + size])
    elif movi:
        out["frames"] = [data[a : a + n] for kind, a, n in _chunks(data, movi[0] + 4, movi[0] + movi[1]) if kind[2:] in (b"dc", b"db")]
    return out


def pad(raw: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return raw + b"\0" * (-len(raw) % BLOCK or (0 if raw else BLOCK))


def store(payload: bytes) -> bytes:
    """A clip that holds ``payload`` (a multiple of 64 bytes); the last frame is filled up with zeros."""
    per = ACROSS * DOWN * BLOCK
    full = np.frombuffer(payload + b"\0" * (-len(payload) % per), dtype=np.uint8).reshape(-1, ACROSS * DOWN, BLOCK)
    frames = [_FRAME_HEAD + pack_blocks(b) + b"\xff\xd9" for b in full]
    return write_avi(frames, 8 * ACROSS, 8 * DOWN, extra=_PAYLOAD + struct.pack("<Q", len(payload)))


def load(clip: bytes) -> tuple[bytes, list[np.ndarray], float]:
    """The payload, the decoded 8-bit samples of each frame, and the rate."""
    avi = read_avi(clip)
    if avi["extra"][:4] != _PAYLOAD:
        raise ValueError("the clip holds no payload")
    frames = [decode_frame(f) for f in avi["frames"]]
    size = struct.unpack("<Q", avi["extra"][4:12])[0]
    return b"".join(f["fixed"].tobytes() for f in frames)[:size], [luma(f) for f in frames], avi["rate"]


def shots(samples: list[np.ndarray], rate: float, window: int = 8, factor: float = 2.5, least: float = 0.15) -> list[tuple[float, float, int]]:
    """(start, end in seconds, frames) of each shot.

    A cut lies before a frame whose histogram (32 bins, half the sum of absolute
    differences of shares) differs from the last one's by ``least`` at least and
    by ``factor`` deviations more than the differences of up to ``window`` frames
    on either side do on average.  No frames: no shots.
    """
    if not samples:
        return []
    line = np.stack([np.bincount(s.ravel() >> 3, minlength=32) / s.size for s in samples])
    step = np.abs(np.diff(line, axis=0)).sum(axis=1) / 2
    cuts = [0]
    for i, d in enumerate(step):
        around = np.concatenate([step[max(0, i - window) : i], step[i + 1 : i + 1 + window]])
        if d >= least and (not len(around) or d > around.mean() + factor * around.std()):
            cuts.append(i + 1)
    cuts.append(len(samples))
    return [(a / rate, b / rate, b - a) for a, b in zip(cuts[:-1], cuts[1:])]


def _stored(batches):
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            data, offsets = text_bytes(part.column("text"))
            raw = data.tobytes()
            clips = [store(pad(raw[a:b])) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(clips, pa.binary())], names=["doc_id", "n_bytes", "media"])


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as an AVI motion-JPEG clip.

    Null and empty texts are one block of zeros; equal texts give equal clips.
    Other columns are ignored, repeated rows repeated.
    """
    return id_text(docs, id_col, text_col).mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<start_s:double,end_s:double,frames:long>>"


def _read(batches):
    for batch in batches:
        rows = []
        for number, n, clip in zip(batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist()):
            payload, frames, rate = load(clip)
            found = shots(frames, rate)
            seen = np.concatenate(frames)
            text = f"frames={len(frames)};shots={len(found)};longest={max(s[2] for s in found)};mean={seen.mean():.4f};deviation={seen.std():.4f}"
            rows.append((number, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(clip), hashlib.sha256(clip).hexdigest(), text, [{"start_s": a, "end_s": b, "frames": n} for a, b, n in found]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int64())]))]
        names = [f.split()[0] for f in _FEATURES.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)


def media_features(media: DataFrame) -> DataFrame:
    """Per clip of ``media_column``: what is read back from the stored bytes, features of its decoded luma, and its timed clips.

    A null id stays null; equal clips give equal rows, as often as they occur.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, _FEATURES)


def _clip_rows(batches):
    for batch in batches:
        rows = []
        for number, clip in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
            if clip is None:
                continue
            avi = read_avi(clip)
            decoded = [decode_frame(f) for f in avi["frames"]]
            rows += [(number, i, *s) for i, s in enumerate(shots([luma(f) for f in decoded], avi["rate"]))]
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["doc_id", "shot", "start_s", "end_s", "frames"])


def clips(media: DataFrame) -> DataFrame:
    """One row (doc_id, shot, start_s, end_s, frames) per shot of any AVI motion-JPEG column; null media give none."""
    return media.select("doc_id", "media").mapInArrow(_clip_rows, "doc_id long, shot int, start_s double, end_s double, frames long")


def op9_media(spark, sf_dir: str) -> DataFrame:
    return media_features(media_column(spark.read.parquet(f"{sf_dir}/documents.parquet")))
