import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from almagest.llm import substring_dedup as sd
from almagest.llm.common import with_blocks
from almagest.llm.substring_dedup import substring_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, width):
    """Straight from the definition, over (id, text) rows."""
    key = lambda i: -(1 << 70) if i is None else i
    words = [(key(i), i, WORD.findall((t or "").encode())) for i, t in rows]
    least = {}
    for k, _, w in words:
        for p in range(len(w) - width + 1):
            s = tuple(w[p : p + width])
            least[s] = min(least.get(s, k), k)
    out = []
    for k, i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - width + 1):
            if least[tuple(w[p : p + width])] < k:
                gone[p : p + width] = [True] * width
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


A = " ".join(f"a{i}" for i in range(40))
B = " ".join(f"b{i}" for i in range(20))
ROWS = [(5, A), (3, f"x {A[:100]}  y"), (9, f"{B}\n{B}\t{B}"), (7, B + " é end"), (1, None), (2, ""), (8, "the " * 500), (4, "the " * 30), (11, A), (11, A), (None, A), (12, f"{A} {B}")]


@pytest.mark.parametrize("width", [3, 13])
def test_brute_force(spark, width):
    docs = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in ROWS], "doc_id long, text string, block string, grp int, kept int")
    for limits in ({}, {"block_bytes": 300, "group_words": 40}):
        got = substring_dedup(docs, width, carry=("block",), **limits).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(ROWS, width)
        assert {r.block for r in got} == {"s"}
        for r in got:
            assert sum(x.last - x.first + 1 for x in r.spans) == r.n_removed


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_small_table(spark):
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from almagest.llm.substring_dedup import op1_substring_dedup

    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op1_substring_dedup(spark, "/root/testdata/sf0.001").collect()}
    want = {i: (n, g, hashlib.sha256(k.encode()).hexdigest()) for i, n, g, k in brute([(r["doc_id"], r["text"]) for r in t], 13)}
    assert got == want and docs.count() == len(got)


def thue_morse(size):
    text = "a"
    while len(text) < size:
        text += text.translate(str.maketrans("ab", "ba"))
    return text


def test_words_of_regular_build_differ(spark):
    """Thue-Morse words meet under every polynomial modulo 2**64."""
    word = thue_morse(1024)
    other = word.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{head} {word}"), (2, f"{head} {other}"), (3, f"{head} {word}")]
    got = {r.doc_id: r.n_removed for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_leaves_of_one_hash(spark, monkeypatch):
    """Where the first hashes meet the second ones decide."""
    from almagest.llm import substring_dedup as sd

    real = sd.windows
    flat = lambda h, r, w: ((lambda x, at: (x & np.uint64(1), at))(*real(h, r, w)))
    rows = [(i, " ".join(f"{c}{j}" for j in range(6))) for i, c in enumerate("abcabdeea")]
    table = pa.table({"block": pa.array([1] * 9, pa.int32()), "doc_id": [i for i, _ in rows], "text": [t for _, t in rows], "rest": pa.nulls(9)})
    calls = []

    def both(h, r, w):
        calls.append(1)
        return flat(h, r, w) if len(calls) % 2 else real(h, r, w)

    monkeypatch.setattr(sd, "windows", both)
    block = sd._Block(table, 3, [], 4, 1)
    assert len(block.leaf) == 5 * 4
    sent = sd._send(table, 3, [], 4, 1)
    for g in set(sent.column("grp").to_pylist()):
        part = sent.filter(pc.equal(sent.column("grp"), g))
        later = part.set_column(1, "block", pa.array([2] * len(part), pa.int32()))
        bits = sd._subtree(pa.concat_tables([later, part])).to_pylist()
        assert [set(np.unpackbits(np.frombuffer(b["bits"], np.uint8), count=len(part.column("others")[0].as_py()) // 4).tolist()) for b in bits] == [{0}, {1}]


@pytest.mark.parametrize("block_bytes", [1, 40, 700])
def test_blocks_of_any_number(spark, block_bytes):
    """More ranges than the first look has, ascending with doc_id, of bounded bytes."""
    rows = [(i * i - 50, "x" * (i % 23)) for i in range(3000)] + [(None, "n"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    blocked, n = with_blocks(docs, block_bytes)
    got = sorted((r.doc_id, r.block, len(r.text)) for r in blocked.where("doc_id is not null").collect())
    blocks = [b for _, b, _ in got]
    assert blocks == sorted(blocks) and len(got) == 3000 and min(blocks) >= 1 and max(blocks) < n
    assert {r.block for r in blocked.where("doc_id is null").collect()} == {0}
    size = {}
    for _, b, k in got:
        size[b] = size.get(b, 0) + k
    assert max(size.values()) <= 3 * block_bytes + 100
    if block_bytes == 1:
        assert len(size) > 1024
    assert with_blocks(docs.where("false"), 8)[0].collect() == []


def test_leaves_are_dealt_on_past_the_plan(spark, monkeypatch):
    from almagest.llm import substring_dedup as sd

    monkeypatch.setattr(sd, "LEAST_SHARE", 0.9)
    monkeypatch.setattr(sd, "max", lambda *x: 10 if x[0] == 1000 else max(*x), raising=False)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = substring_dedup(docs, 3, block_bytes=300, group_words=40).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == brute(ROWS, 3)


def test_a_carried_text_travels_once(spark):
    docs = spark.createDataFrame([(i, t, "s") for i, t in ROWS], "doc_id long, text string, source string")
    out = substring_dedup(docs, carry=("source", "text"))
    assert out.columns[-2:] == ["source", "text"]
    assert sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str) == sorted(((i, t, "s") for i, t in ROWS), key=str)
    assert not re.search(r"named_struct\([^)]*text", out._jdf.queryExecution().optimizedPlan().toString())  # old: twice in every block
    numbers = docs.select("doc_id", (F.col("doc_id") * 7).alias("text"))
    assert {(r.doc_id, r.text) for r in substring_dedup(numbers, carry=("text",)).collect()} == {(i, i and 7 * i) for i, _ in ROWS}  # of the type it came with


@pytest.mark.parametrize("step", ["send", "remove"])
def test_memory_of_a_block(step):
    """What a task holds besides the text and the result stays within some bytes a byte of text."""
    rng = np.random.RandomState(3)
    texts = [" ".join(f"w{i}" for i in rng.randint(0, 100_000, 500)) for _ in range(1000)]
    table = pa.table({"block": pa.array([1] * len(texts), pa.int32()), "doc_id": list(range(len(texts))), "text": texts, "rest": [{"row": True}] * len(texts)})
    answers = pa.table({"grp": pa.array([], pa.int32()), "bits": pa.array([], pa.binary())})
    run = {"send": lambda: sd._send(table, 13, [], 8, 1), "remove": lambda: sd._remove(table, answers, 13, [], 8, 1)}[step]
    run()
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * sum(map(len, texts))  # old: 22 times
