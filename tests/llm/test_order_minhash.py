import hashlib
import random
import re

from pyspark.sql import functions as F

from almagest.llm import order_minhash as omh


def neighbours(rows):
    line = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for here, after in zip(line, line[1:] + line[:1]):
        t, u = here[1] or "", after[1] or ""
        k = len(t) // 3
        yield here[0], t, t[: len(t) - k] + u[:k], u


ROWS = [(5, "a b c d e f g h i j k l"), (4, "a b c d e f g h i j k l"), (9, None), (7, ""), (2, "one"), (None, "none here"), (8, "x " * 700), (3, "é ñ " * 50), (6, "z y w v u t s r q p o n m")]


def check(spark, docs, rows):
    got = sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in omh.fingerprint_documents(docs).collect())
    assert got == sorted((str(i), len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in neighbours(rows))


def test_neighbours_and_edits(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, "s", 1) for r in ROWS], "doc_id long, text string, block string, ghost int")
    check(spark, docs, ROWS)
    wide = omh.with_next
    monkeypatch.setattr(omh, "with_next", lambda d: wide(d, block_bytes=100))
    check(spark, docs, ROWS)
    rows = [(i, " ".join(f"w{j}" for j in range(i % 9))) for i in range(60)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_empty_and_single(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert omh.fingerprint_documents(docs.where("doc_id = 77")).collect() == []
    one = omh.fingerprint_documents(docs.where("doc_id = 5")).head()
    assert one.near_next == 1.0


def brute(spark, texts, k, tuple_size, components, hashes_of):
    """Order MinHash from its definition; only the hash function is Spark's."""
    words = [re.split(r"[\x20\x09-\x0D]+", t) for t in texts]
    ids = {w: h for w, h in spark.createDataFrame([(w,) for w in sorted({w for ws in words for w in ws})], "w string").select("w", F.xxhash64("w")).collect()}
    grams = [[tuple(ids[w] for w in ws[i : i + k]) + (0,) * (i + k - len(ws)) for i in range(len(ws))] for ws in words]
    every = sorted({g for gs in grams for g in gs})
    hashes = {g: spark.createDataFrame([g], ", ".join(f"c{j} long" for j in range(k))).select(F.xxhash64(*(f"c{j}" for j in range(k)))).head()[0] for g in every}
    numbered = [[(hashes[g], gs[:i].count(g)) for i, g in enumerate(gs)] for gs in grams]
    pairs = spark.createDataFrame(sorted({x for line in numbered for x in line}), "h long, n int")
    keys = {(r.h, r.n): r for r in pairs.select("h", "n", *(F.xxhash64(F.xxhash64("h", "n"), F.lit(i)).alias(f"k{i}") for i in range(hashes_of))).collect()}
    tuples = []
    for line in numbered:
        for i in range(hashes_of):
            for c in range(components // hashes_of):
                point = -(1 << 63) + c * ((1 << 64) * hashes_of // components) & -(1 << 31)
                order = sorted(range(len(line)), key=lambda p: ((keys[line[p]][f"k{i}"] & -(1 << 31)) - point) % (1 << 64))
                tuples.append([line[p][0] for p in sorted(order[:tuple_size])])
    found = spark.createDataFrame([(j, t) for j, t in enumerate(tuples)], "j int, t array<long>").select("j", F.xxhash64("t")).collect()
    flat = [h for _, h in sorted(map(tuple, found))]
    return [flat[i * components : (i + 1) * components] for i in range(len(texts))]


def test_against_brute_force(spark):
    texts = ["a b a b a c d e", "q", "", "the cat sat on the mat the cat sat", "x " * 20, " a  b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for k, size in ((2, 2), (1, 3)):
        assert [r.f for r in omh.fingerprints(df, {"t": "f"}, k, size, 12, 4).collect()] == brute(spark, texts, k, size, 12, 4)
    assert omh.fingerprints(df.select(F.lit(None).cast("string").alias("t")).limit(1), {"t": "f"}).head().f is None


def test_components_of_short_texts_differ(spark):
    """Orders are independent: a text of six k-mers has 15 pairs, and nearly all are drawn."""
    df = spark.createDataFrame([("a b c d e f",), ("a b c d e f g h i",)], "t string")
    got = [len(set(r.f)) for r in omh.fingerprints(df, {"t": "f"}).collect()]
    assert got[0] >= 11 and got[1] >= 20


def edits(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(line[j] + (x != y), line[j + 1] + 1, new[-1] + 1))
        line = new
    return line[-1]


def test_likeness_ranks_by_edits(spark):
    """Of texts with growing edit distance, moved blocks among them, likeness falls nearly as distance grows."""
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = [base]
    for n in (1, 3, 6, 12, 25, 50, 90):
        other = list(base)
        for _ in range(n):
            at = r.randrange(len(other))
            other[at : at + 1] = r.choice([[], [f"n{r.randrange(10**6)}"], [other[at], f"n{r.randrange(10**6)}"]])
        texts.append(other)
    texts += [base[60:] + base[:60], base[::-1]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "i int, t string")
    found = {x.i: x.f for x in omh.fingerprints(df, {"t": "f"}, 1, 2, 256, 32).collect()}
    near = [sum(a == b for a, b in zip(found[0], found[i])) / 256 for i in range(len(texts))]
    far = [edits(base, t) for t in texts]
    assert near[0] == 1 and near[-1] < 0.1 and near[-2] < 0.75  # the same words in another order
    same = [(a, b) for i, (a, x) in enumerate(zip(far[:8], near)) for b, y in zip(far[i + 1 : 8], near[i + 1 :]) if x <= y]
    assert len(same) <= 2


def chance(a, b):
    """The probability that both least numbered word pairs of the two texts' union are common to them."""
    sets = []
    for text in (a, b):
        words = [*re.split(r"[\x20\x09-\x0D]+", text), None]
        seen, numbered = {}, set()
        for pair in zip(words, words[1:]):
            seen[pair] = seen.get(pair, 0) + 1
            numbered.add((pair, seen[pair]))
        sets.append(numbered)
    common, union = len(sets[0] & sets[1]), len(sets[0] | sets[1])
    return common * (common - 1) / (union * (union - 1)) if union > 1 else float(common)


def test_equal_texts_and_edit_sensitivity(spark):
    rows = omh.op5_order_minhash(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    by = {}
    for r in rows:
        by.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
        assert (r.fingerprint == r.edited_fingerprint) <= (r.near_edited == 1)
    assert all(len(x) == 1 for x in by.values()) and len(rows) == len(texts)
    mean = lambda k: sum(r[k] for r in rows) / len(rows)
    want = {i: chance(t, e) for i, t, e, _ in neighbours(list(texts.items()))}
    assert abs(mean("near_edited") - sum(want.values()) / len(want)) < 0.015 and mean("near_next") < 0.1
    for r in rows:  # 64 draws: five deviations
        assert abs(r.near_edited - want[r.doc_id]) < 5 * (0.25 / 64) ** 0.5


def test_native(spark):
    plan = omh.op5_order_minhash(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_repetition_counts_matter(spark):
    rows = [(1, "a b " * 10), (2, "a b " * 1000), (3, "a b " * 1000)]
    rows = {r.doc_id: r for r in omh.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert rows[3].near_next == 1.0  # equal texts
    assert rows[2].near_next < 0.7 and rows[2].fingerprint != rows[1].fingerprint
