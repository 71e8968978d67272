import zlib

import numpy as np
import pyarrow as pa

from almagest.llm import quality as q
from almagest.llm.common import text_bytes


def stats(texts):
    return [dict(zip(q.STATISTICS, r)) for r in q.statistics(*text_bytes(pa.array(texts, pa.string())))]


def test_statistics_by_hand():
    a, empty, lines, one = stats(["The THE cat! 12 | x.\nend.", "", "a b\na b\nc d", "é" * 10])
    assert (a["words"], a["bytes"], a["longest_word"]) == (7, 25, 4)
    assert a["distinct_words"] == 6 / 7 and a["commonest_word"] == 2 / 7
    assert (a["upper"], a["digits"], a["bars"], a["marks"]) == (4 / 25, 2 / 25, 1 / 25, 1 / 25)
    assert a["ended_lines"] == 1 and a["mean_line"] == 3.5
    assert set(empty.values()) == {0.0}
    assert lines["distinct_lines"] == 2 / 3 and lines["distinct_pairs"] == 4 / 5
    assert one["wide"] == 1 and one["longest_word"] == 20


def test_column_equals_model(spark):
    rng = np.random.RandomState(0)
    texts = [" ".join(rng.choice(["ab", "cde", "F!", "###"], rng.randint(0, 30))) for _ in range(300)]
    y = np.array([int("###" not in t) for t in texts])
    x = q.statistics(*text_bytes(pa.array(texts)))
    model = q.fit_rules(x, y, np.where(y == 1, y.mean(), 1 - y.mean()))
    assert ((model.scores(x) > 0.5) == y).mean() > 0.95 and 0 < len(model.rules) < 60
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, words int")
    got = {r.doc_id: r.score for r in q.score(docs, model).collect()}
    assert np.allclose([got[i] for i in range(300)], model.scores(x))


def test_held_out_accuracy(spark):
    rows = q.op8_quality(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert (rows.held_out == rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert (rows.predicted == (rows.score >= 0.3)).all() and rows.score.between(0, 1).all()
    both = rows[rows.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.97 and both[both.quality == 1].predicted.mean() > 0.99


def test_edges(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x" * 50000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = q.fit(docs, none)
    assert [r.score for r in q.score(docs, model).collect()] == [0.5] * 4
    one = q.fit(docs, spark.createDataFrame([(1, 1), (1, 0), (2, 1), (None, 0), (3, None)], "doc_id long, quality int"))
    assert all(r.score > 0.9 for r in q.score(docs, one).collect())
    assert q.score(docs.where("false"), model).collect() == []


def test_fit_is_the_penalised_optimum():
    """At the weights found the gradient of the weighted log loss balances the penalty, rule by rule, and that of the bias is none."""
    rng = np.random.RandomState(5)
    x = rng.rand(400, len(q.STATISTICS))
    y = ((x[:, 0] > 0.6) ^ (rng.rand(400) < 0.1)).astype(float)
    shares = np.where(y == 1, y.mean(), 1 - y.mean())
    model = q.fit_rules(x, y, shares, trees=6, l1=3e-3, steps=4000)
    weight = shares / np.array([(y == v).sum() for v in (0, 1)])[y.astype(int)]
    error = weight / weight.sum() * (model.scores(x) - y)
    assert abs(error.sum()) < 1e-5 and len(model.rules)
    for rule, w in zip(model.rules, model.weights):
        on = np.ones(len(y), dtype=bool)
        for j, above, cut in rule:
            on &= (x[:, j] > cut) if above else (x[:, j] <= cut)
        assert (q.holds(rule, x) == on).all()
        assert abs(error[on].sum() + 3e-3 * np.sign(w)) < 1e-4


def test_held_out_of_a_null_id(spark, tmp_path):
    spark.createDataFrame([(None, "x"), (5, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.held_out for r in q.op8_quality(spark, str(tmp_path)).collect()}
    assert got == {None: False, 5: zlib.crc32(b"5") % 5 == 0}
