import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from almagest.llm import mixing as mx


@settings(max_examples=80, deadline=None)
@given(st.lists(st.floats(0.01, 50), min_size=1, max_size=12))
def test_less_than_one_block_off(weights):
    quota = mx.quotas(dict(enumerate(weights)), 200)
    assert sum(quota.values()) == 200
    line, seen = mx.schedule(quota), dict.fromkeys(quota, 0)
    for t, s in enumerate(line):
        assert seen[s] * 200 // quota[s] <= t < -(-(seen[s] + 1) * 200 // quota[s])
        seen[s] += 1
        assert all(abs(seen[k] - (t + 1) * quota[k] / 200) < 1 for k in quota)


def naive(rows, sizes, block_docs, period):
    """Runs the whole schedule slot by slot over real blocks."""
    quota = mx.quotas({s: n**0.7 for s, n in sizes.items()}, period)
    left = {s: -(-n // block_docs) for s, n in sizes.items()}
    out, seen, t, short = {}, dict.fromkeys(quota, 0), 0, None
    line = mx.schedule(quota)
    while any(seen[s] < left[s] for s in left):
        s = line[t % len(line)]
        if seen[s] < left[s]:
            out[s, seen[s]] = t
        elif short is None:
            short = t
        seen[s] += 1
        t += 1
    while short is None:
        s = line[t % len(line)]
        short = t if seen[s] >= left[s] else None
        seen[s] += 1
        t += 1
    return out, short


def test_against_naive(spark):
    rows = [(i, "abc"[0 if i % 3 else i % 9 // 3] if i % 20 else None) for i in range(900)]
    docs = spark.createDataFrame([(i, s, "x") for i, s in rows], "doc_id long, source string, slot string")
    got = mx.mix_sources(docs, block_docs=7, period=50).collect()
    sizes = {}
    for _, s in rows:
        sizes[s] = sizes.get(s, 0) + 1
    slots, short = naive(rows, sizes, 7, 50)
    assert sorted(r.doc_id for r in got) == list(range(900))
    per = {}
    for r in got:
        assert r.slot == slots[r.source, r.block] and r.release_slot <= r.slot < r.deadline_slot
        assert r.in_mix == (r.slot < short)
        per.setdefault((r.source, r.block), []).append(r.place)
    assert all(sorted(p) == list(range(len(p))) and len(p) <= 7 for p in per.values())
    assert all(len(p) == 7 for (s, b), p in per.items() if b < -(-sizes[s] // 7) - 1)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None)], "doc_id long, source string")
    assert mx.mix_sources(docs).count() == 3
    assert mx.mix_sources(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        mx.mix_sources(docs, {"a": 1.0})
    assert mx.in_mixed_order(docs).count() == 3


def test_query_and_order(spark):
    rows = mx.op4_source_mixing(spark, "/root/testdata/sf0.01").toPandas()
    assert len(rows) == 1000 and rows.doc_id.nunique() == 1000
    early = rows[rows.in_mix]
    for s, part in early.groupby("source"):
        slots = early.slot.max() + 1
        assert abs(part.block.nunique() - slots * part.weight.iloc[0]) < 1
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    place = {r.doc_id: (r.slot, r.place) for r in rows.itertuples()}
    parts = mx.in_mixed_order(docs).select("doc_id").rdd.glom().collect()
    line = [place[r.doc_id] for p in parts for r in p]
    assert line == sorted(line)


def test_numbers_of_many_pieces(spark):
    """Whatever the size of the pieces, a source's rows have the numbers from 0 on, each once, in one order."""
    rows = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(500)] + [(None, None), (None, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    orders = []
    for piece_rows in (1, 20, 10_000):
        found, sizes = mx.numbered(docs, "source", "doc_id", piece_rows)
        by = {}
        for r in found.collect():
            by.setdefault(r.source, []).append(r.number)
        assert {s: sorted(n) for s, n in by.items()} == {s: list(range(n)) for s, n in sizes.items()}
        orders.append(sizes)
    assert orders[0] == orders[1] == orders[2] and sum(orders[0].values()) == 503
