import hashlib

import corpus_pipeline as cp
from pyspark.sql import functions as F
from almagest.llm import byte_bpe, mixing
from almagest.sources.runtime import materialise
from tests.llm.test_ngram_join import brute as join_brute
from tests.llm.test_substring_dedup import brute as cut_brute


def rows(df):
    return {r.doc_id: (r.text, r.lang, r.source, r.n_chars) for r in df.collect()}


def test_stages_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = materialise(cp.drop_toxic(spark, docs, sf), "t")
    before, after = rows(docs), rows(clean)
    assert all(after[i] == before[i] for i in after)
    gone = set(before) - set(after)
    # four labelled toxic rows only; accuracy is tested in test_toxicity on the larger table
    assert not any(labels.get(i) == 0 for i in gone) and any(labels.get(i) == 1 for i in gone)

    single = materialise(cp.one_of_each_group(spark, clean, sf), "t")
    want = {i for i, _, _, c in join_brute([(i, r[0]) for i, r in after.items()], 5, 80) if c == i}
    assert rows(single) == {i: after[i] for i in want}

    cut = materialise(cp.cut_repeats(spark, single, sf), "t")
    kept = rows(cut)
    for i, n, removed, text in cut_brute([(i, after[i][0]) for i in want], 13):
        assert kept[i] == ((text, *after[i][1:3], len(text)) if removed else after[i])

    mixed = materialise(cp.mix(spark, cut, sf), "t")
    assert rows(mixed) == kept and mixed.columns == docs.columns

    bpe = byte_bpe.load(byte_bpe.public_tokenizers.path("byte_bpe_50k.tiktoken"), byte_bpe.public_tokenizers.PATTERN)
    last = {r.doc_id: r for r in cp.encode(spark, mixed, sf).collect()}
    assert set(last) == set(kept)
    for i, r in last.items():
        assert r.decoded_sha256 == hashlib.sha256(kept[i][0].encode()).hexdigest() and r.n_tokens == len(bpe.encode(kept[i][0])) // 4


def test_run(spark):
    got = cp.run(spark, "/root/testdata/sf0.001")
    assert 100 < got.count() < 200 and len(cp.STAGES) == 5


def test_places_follow_the_mixture(spark):
    """The last stage tells each row's place, and along it the sources' shares keep to their weights."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = materialise(cp.mix(spark, docs, ""), "t")
    places = {r.doc_id: r.place for r in cp.encode(spark, mixed, "").select("doc_id", "place").collect()}
    assert len(set(places.values())) == len(places) == docs.count()
    plan = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    order = sorted(places, key=places.get)
    assert order == sorted(plan, key=lambda i: (plan[i].slot, plan[i].place))
    inside = [i for i in order if plan[i].in_mix]
    for n in (len(inside) // 3, len(inside)):
        for source in {plan[i].source for i in inside}:
            weight = next(r.weight for r in plan.values() if r.source == source)
            assert abs(sum(plan[i].source == source for i in inside[:n]) - weight * n) < 2 * 16


def test_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows and another column; and no rows at all."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = "words that are said again and again by all of them in one long line"
    odd = [(None, None, None, None, None), (None, text, "en", None, 9), (900001, None, "en", "web", None), (900002, "", None, "web", 0), (900003, "x " * 60000, "en", "web", 120000), (900004, text, "en", "web", 9), (900004, text, "en", "web", 9), (900005, text + " and more of it", "de", None, 1)]
    docs = base.limit(60).select(*cp.COLUMNS).unionByName(spark.createDataFrame(odd, base.select(*cp.COLUMNS).schema)).withColumn("component_id", F.lit("x")).withColumn("block", F.lit(1))
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for name, rows in (("odd", docs), ("none", docs.where("false"))):
        folder = f"{tmp_path}/{name}"
        rows.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        got = cp.run(spark, folder).collect()
        if name == "none":
            assert got == []
        else:
            ids = [r.doc_id for r in got]
            assert ids.count(900004) == 2 and ids.count(None) == 2 and {900001, 900002, 900003} <= set(ids)
            assert {r.n_tokens for r in got if r.doc_id in (900001, 900002)} == {0}
            assert {r.n_tokens for r in got if r.doc_id == 900004} == {0}  # the row without an id has those words first
