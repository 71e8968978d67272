import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers as P
from pyarrow import fs
from tokenizers import Tokenizer

from almagest.llm import token_files as tf
from almagest.llm.common import distinct_words, text_bytes, words

PATH = P.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def library(texts):
    return [e.ids + [2] for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out, at = [], 0
    for (i, _), ids in zip(rows, library([t or "" for _, t in rows])):
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def encoded(texts):
    ids, sizes = tf.encode_texts(pa.array(texts, pa.string()), PATH, 2, "<u2")
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in tf.op7_token_files(spark, "/root/testdata/sf0.001").collect())
    assert got == expected([tuple(r) for r in rows])


def test_edge_rows_and_many_files(spark):
    rows = [(3, "Hello  World's ÉCOLE\x1cx"), (1, None), (2, ""), (2, "tie two"), (9, "w " * 3000 + "x" * 5000), (8, "<|endoftext|> é z ΣΑΣ"), (None, "no id"), (None, None)] + [(i, f"text {i}") for i in range(20, 60)]
    docs = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, block int, file string")
    for limits in ({}, {"block_bytes": 600, "length": 16}):
        files, folder = tf.write_token_files(docs, PATH, **limits)
        whole = tf.read_token_files(files).collect()
        got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in whole]
        assert sorted(got, key=lambda r: r[1]) == expected(rows)
        assert sorted(map(tuple, tf.read_token_files(files, digest=True).collect()), key=lambda r: r[1]) == expected(rows)
    store, base = tf._filesystem(folder)
    assert all(f.base_name.startswith("ids-") for f in store.get_file_info(fs.FileSelector(base)))
    none, _ = tf.write_token_files(docs.where("doc_id = 99"), PATH)
    assert none.collect() == [] and tf.read_token_files(none).collect() == []


def test_random_access(tmp_path):
    ids = np.arange(5000, dtype=np.uint16)
    store, path = fs.LocalFileSystem(), f"{tmp_path}/a/x.arrow"
    for _ in range(2):  # a task that runs again
        tf.write_stream(store, path, ids, np.array([3, 4990, 7]), pa.array([5, None, 9], pa.int64()), 7, per_batch=10)
    with pa.memory_map(path) as source:
        whole = np.frombuffer(source.read_buffer(), np.uint8)
        low, high = whole.ctypes.data, whole.ctypes.data + len(whole)
        for k in (713, 0, 9, 10, 714, 300):
            got, mask, last = tf.sequence(source, k)
            part = ids[k * 7 : (k + 1) * 7]
            assert got.to_pylist() == part.tolist() + [0] * (7 - len(part))
            assert mask.to_pylist() == [i < len(part) for i in range(7)]
            assert last.to_pylist() == [k * 7 + i in (2, 4992, 4999) for i in range(7)]
            assert all(low <= x.buffers()[1].address < high for x in (got, mask, last))  # no copy
        for k in (715, 720, 10**6):
            with pytest.raises(IndexError):
                tf.sequence(source, k)
    numbers, sizes, back = tf.read_stream(store, path)
    assert numbers.to_pylist() == [5, None, 9] and sizes.tolist() == [3, 4990, 7] and (back == ids).all()


CASES = [
    "I'LL go—. Don't! x1, 2?! é́, ÀB;; \x01 a\x01b ½. Ⅷ, ß. ΑΣ. “q”. ", "İstanbul, K. ǅ! a—!b ?! ...", "İ, ́x.", "KAYSERİ. İ! aİ? ", "İ̸֑⃣.", "<|endoftext|>x. a<|startoftext|>. <|ENDOFTEXT|>",
    "ﬁ. ÅÅ. ;. a\u0338. <\u0338. 가. 각, 漢字. 漢, \u2028x.\x85y. ｶﾞ!", "a\u0301. A\u030a, \u0345x. Ω, K!", "’s 's 'S it's. IT'S!", "x" * 9000 + ".", "",
]


def test_equals_library():
    assert encoded(CASES) == library(CASES)
    assert encoded(CASES[::-1]) == library(CASES[::-1])


def test_equals_library_on_random_text():
    """Letters whose lower case ends in a mark, marks that compose or change places, punctuation, white space, special tokens."""
    r = random.Random(11)
    alphabet = list("aAsStTlL'.,;:!?-–9½ \t\n\x0b\x1c\x85\u00a0\u2028éÉİıßſKÅΩΣσςǅﬁ가가漢字\u0301\u0307\u030a\u0327\u0338\u0345\u05d1\u0591\u20e3\u200d\ufe0f😀<>|\x00\x01") + ["<|endoftext|>", "<|startoftext|>", "THE ", "İ.", "i̇, "]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 14))) for _ in range(40_000)]
    texts += ["".join(chr(r.choice((r.randrange(32, 0x250), r.randrange(0x250, 0xD800), r.randrange(0xE000, 0x11000)))) for _ in range(6)) + r.choice([".", "!", ",;", " x"]) for _ in range(20_000)]
    got, want = encoded(texts), library(texts)
    assert [t for t, a, b in zip(texts, got, want) if a != b] == []


def test_distinct_words_compare_bytes(monkeypatch):
    """Equal hashes of unequal words are told apart."""
    from almagest.llm import common

    real = common.word_hashes
    monkeypatch.setattr(common, "word_hashes", lambda d, s, e, salt=0: real(d, s, e, salt=salt) & np.uint64(3 if not salt else 2**64 - 1))
    data, offsets = text_bytes(pa.array(["aa bb abcdefghij abcdefghik aa abcdefghij x" + "y" * 40 + " x" + "y" * 39 + "z"]))
    starts, ends, _ = words(data, offsets)
    first, which = distinct_words(data, starts, ends)
    raw = data.tobytes()
    assert [raw[starts[first[w]] : ends[first[w]]] for w in which] == raw.split() and len(first) == 6
