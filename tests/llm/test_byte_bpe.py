import hashlib
import random

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from almagest.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
BPE = byte_bpe.load(PATH, P.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})


def ours(text):
    import numpy as np

    return np.frombuffer(BPE.encode(text), dtype=np.int32).tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'abcthe sn019.,!\x1c\x85\xa0 éß"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_equals_library(text):
    ids = ours(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert BPE.decode(ids) == text.encode()


def test_long_runs():
    r = random.Random(3)
    for text in ("a" * 5000, "ab" * 2000 + "!" * 3000, " " * 4000 + "x", "".join(r.choice("aeinrst") for _ in range(6000)), "don't I'LL we've <|endoftext|>"):
        assert ours(text) == LIBRARY.encode_ordinary(text)


def test_query_on_whole_table(spark):
    import pyarrow.parquet as pq

    want = {}
    for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist():
        ids = LIBRARY.encode_ordinary(r["text"])
        want[r["doc_id"]] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.op3_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_nulls_and_clashes(spark):
    docs = spark.createDataFrame([(None, None, "z"), (1, "", "z"), (1, "", "z"), (2, "hi there", "z")], "doc_id long, text string, ids string")
    got = sorted((str(r.doc_id), len(r.ids)) for r in byte_bpe.encode(docs, PATH).collect())
    assert got == [("1", 0), ("1", 0), ("2", 2), ("None", 0)]
    assert byte_bpe.digests(docs.where("doc_id = 9"), PATH).collect() == []


def test_decode_operator_equals_round_trip(spark):
    docs = spark.createDataFrame([(1, "naïve café 123"), (2, None)], "doc_id long, text string")
    a = byte_bpe.decode(byte_bpe.encode(docs, PATH), PATH).orderBy("doc_id").collect()
    assert a == byte_bpe.round_trip(docs, PATH).orderBy("doc_id").collect() and bytes(a[0].decoded).decode() == "naïve café 123"
