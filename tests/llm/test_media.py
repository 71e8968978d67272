import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from almagest.llm import media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=5000))
def test_any_bytes_round_trip(raw):
    payload = media.pad(raw)
    assert len(payload) % 64 == 0 and payload and payload.startswith(raw)
    assert media.load(media.store(payload))[0] == payload


def test_all_ones_and_general_decoder_agree(monkeypatch):
    payload = bytes([255] * 640 + list(range(256)) * 11)
    payload = media.pad(payload)
    clip = media.store(payload)
    fast = [media.decode_frame(f)["blocks"][1] for f in media.read_avi(clip)["frames"]]
    monkeypatch.setattr(media, "_unpack_fixed", lambda scan, n: None)
    slow = [media.decode_frame(f)["blocks"][1] for f in media.read_avi(clip)["frames"]]
    assert all((a == b).all() for a, b in zip(fast, slow)) and len(fast) == len(slow)


def grey_jpeg(level):
    """A 16x16 frame of one grey, written with ordinary variable-length codes."""
    dc = bytes([0x00] + [0, 2, 0, 0] + [0] * 12 + [0, 10])  # codes 00, 01 for categories 0 and 10
    ac = bytes([0x10] + [1] + [0] * 15 + [0])  # 0: end of block
    diff = (level - 128) * 8
    bits = "01" + (f"{diff:010b}" if diff > 0 else f"{diff + 1023:010b}") + "0" + ("00" + "0") * 3
    if abs(diff) < 512:
        raise ValueError
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    s = media._segment
    return b"\xff\xd8" + s(0xDB, b"\0" + b"\1" * 64) + s(0xC0, b"\x08\0\x10\0\x10\x01\x01\x11\0") + s(0xC4, dc + ac) + s(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"


def test_ordinary_frames_and_shots(spark):
    dark, light = grey_jpeg(20), grey_jpeg(240)
    assert set(np.unique(media.luma(media.decode_frame(dark)))) == {20}
    assert set(np.unique(media.luma(media.decode_frame(light)))) == {240}
    clip = media.write_avi([dark] * 10 + [light] * 15, 16, 16, rate=10)
    rows = media.clips(spark.createDataFrame([(1, clip), (2, None)], "doc_id long, media binary")).collect()
    assert [(r.start_s, r.end_s, r.frames) for r in rows] == [(0.0, 1.0, 10), (1.0, 2.5, 15)]
    with pytest.raises(ValueError):
        media.read_avi(b"nothing")


def test_zigzag():
    assert media.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_query_on_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = media.op9_media(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        payload = media.pad(texts[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        clip = media.store(payload)
        assert (r.media_bytes, r.media_sha256) == (len(clip), hashlib.sha256(clip).hexdigest())


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, 1), (1, "", 1), (1, "", 1), (2, "é" * 3000, 1)], "doc_id long, text string, media int")
    rows = media.media_features(media.media_column(docs)).collect()
    assert sorted((r.n_bytes, r.payload_bytes) for r in rows) == [(0, 64), (0, 64), (0, 64), (6000, 6016)]
    assert media.media_features(media.media_column(docs.where("doc_id = 7"))).collect() == []


def plain_luma(block):
    """The 8x8 samples of 64 coefficients in zigzag order, by the formula of the inverse transform."""
    square = np.zeros((8, 8))
    for k, place in enumerate(media.ZIGZAG):
        square[place // 8, place % 8] = block[k]
    scale = [np.sqrt(0.5)] + [1.0] * 7
    out = np.zeros((8, 8))
    for y in range(8):
        for x in range(8):
            out[y, x] = 128 + sum(scale[u] * scale[v] / 4 * square[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8))
    return np.clip(np.rint(out), 0, 255)


def test_features_are_of_decoded_luma(spark):
    text = "".join(chr(97 + i % 7) * (i % 50) for i in range(200))
    row = media.media_features(media.media_column(spark.createDataFrame([(1, text)], "doc_id long, text string"))).head()
    payload, samples, rate = media.load(media.store(media.pad(text.encode())))
    raw = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(int) + 256
    for k in (0, 7, len(raw) - 1):
        assert (samples[k // 32][k % 32] == plain_luma(raw[k])).all()
    values = np.concatenate([s.ravel() for s in samples]).astype(float)
    assert f"mean={values.mean():.4f};deviation={values.std():.4f}" in row.feature
    assert [(c.start_s, c.end_s, c.frames) for c in row.clips] == media.shots(samples, rate) and sum(c.frames for c in row.clips) == len(samples)
