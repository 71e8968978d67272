import zlib

import numpy as np

from almagest.llm import toxicity as tx


def corpus():
    """Toxic rows name one group far more often than clean ones do."""
    rng, rows = np.random.RandomState(1), []
    for i in range(400):
        filler = " ".join(f"w{k}" for k in rng.randint(0, 60, 12))
        toxic = i % 4 == 0
        group = "muslims" if rng.rand() < (0.8 if toxic else 0.05) else ("christians" if rng.rand() < 0.3 else "")
        rows.append((f"{filler} {group} {'idiot scum' if toxic and i % 8 == 0 else ''}{'trash' if toxic and i % 8 else ''}", int(toxic)))
    return rows


def test_counterfactual_pairs_narrow_the_gap():
    texts, labels = zip(*corpus())
    probe = ["w1 w2 muslims w3", "w1 w2 christians w3", "w1 w2 w3"]
    gap = {}
    for weight in (0.0, 10.0):
        model = tx.fit_texts(list(texts), labels, counterfactual=weight)
        s = model.scores(probe)
        gap[weight] = abs(s[0] - s[1])
        assert (model.scores(["w1 idiot scum", "w9 trash"]) > 0.5).all()
    assert gap[10.0] < gap[0.0] / 5 and gap[10.0] < 0.02


def test_counterfactual_texts():
    identity = (("muslims", "jews", "hindus"), ("gay", "queer"))
    assert tx.counterfactuals("Muslims and MUSLIMS, muslimsx é", identity) == ["jews and jews, muslimsx é", "hindus and hindus, muslimsx é"]
    assert tx.counterfactuals("gay jews", identity) == ["queer hindus", "gay muslims"]
    plain = tx.counterfactuals("nothing named", identity)
    assert len(plain) == 2 and all(t.startswith("nothing named ") for t in plain) and len(set(plain)) == 2
    assert tx.counterfactuals("x", ()) == []


def test_gaps_are_differences_of_texts():
    """A feature that another word of the text has too stays: only what the texts differ in is in a gap."""
    identity = (("muslim", "jewish"),)
    text = "muslim muslin"
    ((minus, plus),) = tx.gaps(text, identity)
    own, other = (set(f.tolist()) for f in tx.features_of([text, "jewish muslin"]))
    assert set(minus.tolist()) == own - other and set(plus.tolist()) == other - own
    shared = {int(k) for k in tx.features_of(["musli musl"])[0] if not int(k) & 3}  # no gap holds a prefix that both words have, once
    assert not {int(k) for k in minus if not int(k) & 3} & {int(k) for k in own & other} and shared


def test_every_text_has_pairs():
    identity = (("muslims", "jews", "hindus"), ("gay", "queer"))
    texts = [f"w{i} plain" for i in range(500)] + ["w1 muslims", "w2 gay jews"]
    assert [len(tx.gaps(t, identity)) for t in texts] == [2] * 502
    used = {t.split()[-1] for i in range(500) for t in tx.counterfactuals(f"w{i} plain", identity)}
    assert used == {t for g in identity for t in g}


def test_fit_in_executors_equals_fit_of_texts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    got = tx.fit(docs, labels, selected=60)
    train = sorted({r for i, r in enumerate(rows) if zlib.crc32(str(i).encode()) % 5})
    share = sum(rows[i][1] for i in range(400) if zlib.crc32(str(i).encode()) % 5) / sum(1 for i in range(400) if zlib.crc32(str(i).encode()) % 5)
    want = tx.fit_texts([t for t, _ in train], [y for _, y in train], [share if y else 1 - share for _, y in train], selected=60)
    probe = [t for t, _ in rows[:100]]
    assert np.allclose(got.scores(probe), want.scores(probe), atol=0.02)


def test_scores_equal_brute_force():
    texts, labels = zip(*corpus())
    model = tx.fit_texts(list(texts), labels)
    probe = ["", "w1 w1 idiot idiot idiot idiot scum", "Trash! tráshy", "w5 " * 900]
    weight = {int(k) | level: w for k, row in zip(model.keys, model.weights) for level, w in enumerate(row) if w}
    want = [1 / (1 + np.exp(-(model.bias + sum(weight.get(int(k), 0.0) for k in f)))) for f in tx.features_of(probe)]
    assert np.allclose(model.scores(probe), want)


def test_held_out_accuracy(spark):
    rows = tx.op10_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert (rows.held_out == rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()
    both = rows[rows.held_out].merge(labels, on="doc_id")
    assert (both.predicted == both.toxic).mean() > 0.97
    assert both[both.toxic == 0].predicted.mean() < 0.01


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (1, "", "b"), (2, "x " * 4000, "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int")
    model = tx.fit(docs, labels)
    got = tx.score(docs, model, carry=("score", "text"))
    assert got.count() == 4 and len(set(tx.score(docs, model).select("score").toPandas().score)) == 1
    assert tx.fit(docs, labels.where("false")).scores(["a"])[0] == 0.5
    assert tx.score(docs.where("false"), model).collect() == []


def test_edges_of_held_out(spark, tmp_path):
    docs = spark.createDataFrame([(None, "x"), (5, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.held_out for r in tx.op10_toxicity(spark, str(tmp_path)).collect()}
    assert got == {None: False, 5: zlib.crc32(b"5") % 5 == 0}
