import datetime as dt

import pytest
from pyspark.sql import functions as F

from almagest.operators import corpus as c
from almagest.operators import dataset as ds
from almagest.operators import terms as t

D = dt.date


def versions(spark, extra=()):
    rows = [("d1", "v1", "2018-01-01", "2018-02-01"), ("d1", "v2", "2019-06-01", "2020-05-01"), ("d2", "v3", None, "2019-01-01"), ("d3", "v4", "bad", None), *extra]
    return spark.createDataFrame(rows, "document_id string, version_id string, version_published_at string, retrieved_at string").withColumn("document_published_at", F.lit(None).cast("string"))


def grid(spark):
    return spark.createDataFrame([("2019-01-01",), ("2020-01-01",)], "d string").select(F.col("d").cast("date").alias("snapshot"))


def seen(df):
    return sorted((r.document_id, r.snapshot, r.version_id) for r in df.collect())


def test_visible_versions(spark):
    plain = c.visible_versions(c.dated_versions(versions(spark)), grid(spark))
    assert seen(plain) == [("d1", D(2019, 1, 1), "v1"), ("d1", D(2020, 1, 1), "v2"), ("d2", D(2019, 1, 1), "v3"), ("d2", D(2020, 1, 1), "v3")]
    strict = c.visible_versions(c.dated_versions(versions(spark), as_known=True), grid(spark))
    assert ("d1", D(2020, 1, 1), "v1") in seen(strict)


def test_later_data_changes_nothing(spark):
    before = seen(c.visible_versions(c.dated_versions(versions(spark)), grid(spark)))
    later = [("d1", "v9", "2021-01-01", "2021-01-02"), ("d9", "v8", "2020-01-02", "2020-01-02")]
    assert seen(c.visible_versions(c.dated_versions(versions(spark, later)), grid(spark))) == before


def test_events_and_metrics(spark):
    v = c.dated_versions(versions(spark))
    events = spark.createDataFrame([("v1", "2018-03-01", "2019-08-01"), ("v2", "2018-01-01", None), ("vx", "2018-01-01", None), ("v1", None, None)], "version_id string, observed_at string, recorded_at string")
    rows = c.visible_events(events, v, grid(spark)).collect()
    assert sorted((r.version_id, r.observed, r.snapshot) for r in rows) == [("v1", D(2018, 3, 1), D(2019, 1, 1)), ("v1", D(2018, 3, 1), D(2020, 1, 1)), ("v2", D(2019, 6, 1), D(2020, 1, 1))]
    strict = c.visible_events(events, v, grid(spark), as_known=True).collect()
    assert ("v1", D(2019, 1, 1)) not in {(r.version_id, r.snapshot) for r in strict}
    m = spark.createDataFrame([("v", "2020-01-01T01", '{"a": 1}'), ("v", "2020-01-01T09", '{"a": 2, "b": "x"}')], "version_id string, metrics_observed_at string, metrics_json string")
    assert c.metric_history(m).collect()[0].metrics == {"a": 2.0}


def test_independence_and_spaces(spark):
    docs = spark.createDataFrame([("t", 1, ["a"]), ("t", 2, ["a", "b"]), ("t", 3, ["c"]), ("t", 4, []), ("u", 1, ["b"])], "k string, d long, p array<string>")
    got = {(r.k, r.d): r.group for r in c.independence_groups(docs, "k", "d", "p").collect()}
    assert got == {("t", 1): "a", ("t", 2): "a", ("t", 3): "c", ("u", 1): "b"}
    tech = spark.createDataFrame([("m", [1.0, 2.0]), ("m", [1.0]), ("m", [2.0, 2.0]), (None, None)], "embedding_model string, embedding array<double>")
    assert [r.embedding is None for r in c.one_embedding_space(tech).collect()].count(True) == 2


def test_empty_corpus(spark, tmp_path):
    corpus = c.read_corpus(spark, f"file://{tmp_path}")
    assert set(corpus) == set(c.ROW_SETS) and all(df.count() == 0 for df in corpus.values())


def test_budget_and_quota(spark):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate([5, 6, 4, 2])], "g string, i long, n long")
    assert sorted(r.i for r in c.take_within(rows, "g", ["i"], "n", 11).collect()) == [0, 1]
    assert sorted(r.i for r in c.take_within(rows, "g", ["i"], "n", 10).collect()) == [0, 2]
    assert c.select_quota(rows, {"g": 2, "h": 9}, "g", [F.col("i")]).count() == 2


def test_splits(spark):
    rows = spark.createDataFrame([(f, D(2000 + f, 1, 1), f % 2) for f in range(20)] + [(0, D(2019, 6, 1), 0)], "family long, day date, y int")
    out = ds.family_split(rows, "family", "day", "y", 0.6, 0.8, 12)
    parts = {(r.family, r.day): r.split for r in out.collect()}
    assert parts[0, D(2019, 6, 1)] == "purged" and parts[19, D(2019, 1, 1)] == "test" and parts[1, D(2001, 1, 1)] == "train"
    assert ds.check_trainable(out, "family", "y") == []
    assert len(ds.check_trainable(out, "family", "y", 50)) == 6
    with pytest.raises(ValueError):
        ds.guard_names(["a", "future_documents"])
    mixed = ds.shuffled(rows.dropDuplicates(["family"]), "y", "family")
    assert mixed.agg(F.sum("y")).head()[0] == 10
    logits = spark.createDataFrame([(4.0, 1), (4.0, 0), (-4.0, 0), (-4.0, 0), (4.0, 1)], "z double, y int")
    assert ds.temperature(logits, "z", "y") > 1
    a = spark.createDataFrame([(1, 0.2), (2, 0.9)], "id long, p double")
    assert [round(r.p, 6) for r in ds.stacked([a, a], "id", "p").orderBy("id").collect()] == [0.2, 0.9]
    near = ds.neighbour_features(spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long"), spark.createDataFrame([(2, "t", 4.0), (3, "t", -2.0)], "id long, t string, v double"), "id", "t", ["v"]).head()
    assert (near.nb_count, near.nb_v_mean, near.nb_v_max, near.nb_growing_share) == (2, 1.0, 4.0, 0.5)


def test_terms(spark):
    df = spark.createDataFrame([("$1,5 млн",), ("€ 20 thousand",), ("nothing",)], "v string")
    assert [r[0] for r in df.select(t.amount(F.col("v"))).collect()] == [1500000.0, 20000.0, None]
    assert [r[0] for r in df.select(t.currency(F.col("v"))).collect()] == ["USD", "EUR", None]
    names = spark.createDataFrame([("neural network", "nn"), ("graph neural network", "gnn"), ("net", "x"), ("apple", "a"), ("apple", "b"), ("GPU", "gpu")], "name string, concept string")
    docs = spark.createDataFrame([(1, "A Graph Neural Network uses a GPU; networks and apple"), (2, None)], "id long, text string")
    assert [(r.concept, r.start) for r in t.find_names(docs, "id", "text", names).orderBy("start").collect()] == [("gnn", 2), ("gpu", 30)]
    claim = t.rule_claims(docs, names, {r"\buses\b": "USES"}, "id", "text").head()
    assert (claim.subject, claim.predicate, claim.object, claim.polarity, claim.modality) == ("gnn", "USES", "gpu", "affirmed", "reported")
    turkish = spark.createDataFrame([(1, "İİİ Ankara, ANKARA")], "id long, text string")
    cities = spark.createDataFrame([("ankara", "c"), (None, "n")], "name string, concept string")
    assert [(r.start, r.end) for r in t.find_names(turkish, "id", "text", cities).orderBy("start").collect()] == [(4, 10), (12, 18)]
    labels = spark.createDataFrame([("new digital platform",), ("quantum platform",)], "v string")
    assert [r[0] for r in labels.select(t.generic_term(F.col("v"), ("digital platform", "platform"), ("new",))).collect()] == [True, False]
    aliases = spark.createDataFrame([("deep learning", "ai"), ("car", "transport")], "alias string, domain string")
    assert [r.domains for r in t.tag_domains(spark.createDataFrame([("Deep Learning for cars",), ("car",)], "x string"), "x", aliases).collect()] == [["ai"], ["transport"]]
    js = spark.createDataFrame([('{"b": 1, "a": "x", "seen": 9}',)], "v string")
    assert js.select(t.strip_volatile(F.col("v"), ("seen",))).head()[0] == '{"a":"x","b":"1"}'


def test_plans(spark):
    keys = spark.createDataFrame([(1, "doi:x"), (2, "doi:x"), (3, "doi:y")], "document long, key string")
    titles = spark.createDataFrame([(1, "t", "a"), (2, "t2", "a"), (3, "q", "a"), (4, "q", "a"), (5, "q2", "a"), (6, "q2", "b")], "document long, title string, kind string")
    assert {r.document: r.work for r in t.plan_works(keys, titles).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6}
    merged = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "old string, new string")
    rows = spark.createDataFrame([("a",), ("b",), ("c",), ("x",), ("q",)], "id string")
    assert sorted(r.id for r in t.follow_merges(rows, "id", merged).collect()) == ["c", "c", "c", "q", "y"]
    paths = spark.createDataFrame([(1, "0.1"), (2, "0.2")], "id long, path string")
    docs = spark.createDataFrame([(1, 10, D(2019, 1, 1)), (2, 10, D(2019, 9, 1)), (2, 11, D(2019, 9, 1)), (2, 12, D(2021, 1, 1))], "id long, document long, day date")
    got = {r.node: (r.documents, r.new_share) for r in t.branch_growth(paths, docs, "2020-01-01", 6).collect()}
    assert got == {"0": (2, 0.5), "0.1": (1, 0.0), "0.2": (2, 1.0)}
