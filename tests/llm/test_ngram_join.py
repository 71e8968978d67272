import random
import re

import numpy as np
import pytest

from almagest.llm import ngram_join as nj

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows, n, percent):
    """(id, shingles, links, component) from the definition."""
    sets = []
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets.append((i, {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()))
    ids = sorted({i for i, _ in sets if i is not None})
    link = {i: set() for i in ids}
    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and a != b and x and y and 100 * len(x & y) >= percent * len(x | y):
                link[a].add(b)
    component = {}
    for i in ids:
        if i not in component:
            stack = [i]
            while stack:
                k = stack.pop()
                if k not in component:
                    component[k] = i
                    stack += link[k]
    return sorted(((i, len(x), len(link[i]) if i is not None else 0, component.get(i)) for i, x in sets), key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in df.collect()), key=str)


def near_copies(seed=0):
    """Groups of copies that differ by chance in a few words, some of them at the threshold."""
    r, rows = random.Random(seed), []
    for g in range(12):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([1, 2, 3, 5, 12, 40, 90, 250]))]
        for _ in range(r.randrange(1, 14)):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 30 + r.randrange(2))):
                w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
            rows.append((r.randrange(10**6), " ".join(w) if r.random() < 0.8 else "  ".join(w).upper()))
    return rows + [(7, None), (8, ""), (9, " \n "), (None, rows[0][1]), (10, "solo"), (11, "SOLO"), (12, "a b c a b c a b c"), (13, "a b c a b c")]


@pytest.mark.parametrize("n,percent,limits", [(3, 90, {}), (5, 80, {}), (5, 80, {"block_bytes": 700, "shard_bytes": 500}), (3, 90, {"block_bytes": 1})])
def test_brute_force(spark, n, percent, limits):
    rows = near_copies(n)
    rows.append(rows[0])  # a repeated row
    docs = spark.createDataFrame([(*r, 1, "b") for r in rows], "doc_id long, text string, n int, tile string")
    assert rows_of(nj.ngram_jaccard_join(docs, n, percent, **limits)) == brute(rows, n, percent)


def test_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(nj, "TILE", 4)
    rows = near_copies(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(nj.ngram_jaccard_join(docs, 3, 80)) == brute(rows, 3, 80)


def test_no_linked_pair_lacks_a_common_signature():
    """Whatever other documents hold; and a set with too little in common with others has none."""
    r = random.Random(4)
    for percent in (70, 80, 90):
        for _ in range(300):
            size = r.choice([1, 2, 3, 7, 20, 60, 200, 700])
            base = [r.getrandbits(64) for _ in range(size)]
            other = list(base)
            for _ in range(r.randrange(0, 1 + size * (100 - percent) // 150)):
                other[r.randrange(len(other))] = r.getrandbits(64)
            other += [r.getrandbits(64) for _ in range(r.randrange(0, 1 + size * (100 - percent) // 200))]
            a, b = set(base), set(other)
            third = {g for g in a | b if r.random() < r.choice([0, 0.3, 1])}
            rows = np.repeat([0, 1], [len(a), len(b)])
            grams = np.array(sorted(a) + sorted(b), dtype=np.uint64)
            df = np.array([(int(g) in a) + (int(g) in b) + 3 * (int(g) in third) for g in grams])
            where, sig = nj.signatures(rows, grams, np.bincount(rows), df, percent)
            if 100 * len(a & b) >= percent * len(a | b):
                assert set(sig[where == 0].tolist()) & set(sig[where == 1].tolist())
            assert len(where) <= 2 + (100 - percent) * (len(a) + len(b)) // 100
            for k, own in ((0, a), (1, b)):
                if 100 * len({g for g in own if g in third or g in (a & b)}) < percent * len(own):
                    assert not (where == k).any()


def test_columns_are_counted_over_all_blocks():
    r = np.random.RandomState(2)
    blocks = [{"shard": 0, "block": k, "c": np.unique(r.randint(0, 300, 80).astype(np.uint64) << np.uint64(20))} for k in range(5)]
    counts = [r.randint(1, 4, len(b["c"])) for b in blocks]
    table = nj.pa.table({"shard": nj.pa.array([0] * 5, nj.pa.int32()), "block": nj.pa.array(range(5), nj.pa.int32()), "columns": [nj.pack_sorted(b["c"]) for b in blocks], "counts": [nj._bytes(c) for c in counts]})
    want = {}
    for b, c in zip(blocks, counts):
        for x, y in zip(b["c"].tolist(), c.tolist()):
            want[x] = want.get(x, 0) + y
    for b, row in zip(blocks, nj._count(table).to_pylist()):
        assert nj._from_bytes(row["counts"]).tolist() == [want[x] for x in b["c"].tolist()]


def test_overlaps():
    r = np.random.RandomState(1)
    m = r.rand(60, 80) < 0.4
    sizes = m.sum(axis=1)
    m = m[np.argsort(sizes, kind="stable")]
    rows, cols = np.nonzero(m)
    for dense in (4, 100):
        counts, reach = nj.overlaps(rows, cols.astype(np.uint64), m.sum(axis=1), 80, dense)
        for i in range(60):
            for j in range(i + 1, reach[i]):
                assert counts[i, j] == (m[i] & m[j]).sum()


def test_empty_table(spark):
    assert nj.ngram_jaccard_join(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(nj.op2_ngram_jaccard_join(spark, "/root/testdata/sf0.001")) == brute(rows, 3, 90)


def test_words_of_regular_build_differ(spark):
    """Thue-Morse words meet under every polynomial modulo 2**64."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    head = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"{head} {word}"), (2, head.replace("w0", word.translate(str.maketrans("ab", "ba")))), (3, word), (4, word.translate(str.maketrans("ab", "ba")))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(nj.ngram_jaccard_join(docs, 3, 90)) == brute(rows, 3, 90)


def test_many_copies_and_frequent_grams(spark, monkeypatch):
    monkeypatch.setattr(nj, "SLICE", 2000)
    base = " ".join(f"w{i}" for i in range(60))
    shared = " ".join(f"s{i}" for i in range(20))
    rows = [(i, base) for i in range(300)] + [(1000 + i, f"{shared} " + " ".join(f"u{i}-{j}" for j in range(i % 40))) for i in range(200)] + [(2000 + i, base + f" tail{i % 3}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(nj.ngram_jaccard_join(docs)) == brute(rows, 5, 80)
