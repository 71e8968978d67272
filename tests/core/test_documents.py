import datetime as dt
import json
import zipfile
from xml.etree import ElementTree

from pyspark.sql import functions as F

from almagest.operators import documents as dc
from almagest.operators import linking as li
from almagest.operators import ranking as rk
from almagest.operators import resolution as rs
from almagest.operators import rows as r
from almagest.operators import vectors as v
from almagest.sources import files, sinks

D = dt.date


def test_related_chunks(spark):
    chunks = spark.createDataFrame([(i, i // 3, i % 3, ("Solar cell " if i % 2 else "wind ") + "x" * i) for i in range(12)], "chunk int, document int, place int, text string")
    near = spark.createDataFrame([(0, 0.9), (4, 0.95), (1, 0.99)], "chunk int, cosine double")
    got = dc.related_chunks(chunks, "solar CELL", F.col("document") == 3, 2, 4, 1000, near).orderBy("rank").collect()
    assert [(x.chunk, x.score) for x in got] == [(1, 2.0), (3, 2.0), (5, 2.0), (4, 0.95)]
    few = dc.related_chunks(chunks, "solar cell", F.lit(False), 9, 9, 30, None).collect()
    assert sorted(x.chunk for x in few) == [1, 3]  # the next one is too long for what is left, as are all after it


def test_processed_rows_stream(spark):
    assert [x["id"] for x in dc.processed(spark.range(10), ["id"])] == list(range(10))


def test_anchors(spark):
    df = spark.createDataFrame([("abc abc", "abc"), ("abc", "bc"), ("abc", ""), (None, "a"), ("aé b", "é"), ("aaa", "aa")], "t string, q string")
    got = [tuple(x.a) for x in df.select(dc.anchor(F.col("t"), F.col("q")).alias("a")).collect()]
    assert got == [("ambiguous", None, None), ("anchored", 1, 3), ("missing", None, None), ("missing", None, None), ("anchored", 1, 2), ("ambiguous", None, None)]
    first = df.limit(1).select(dc.anchor(F.col("t"), F.col("q"), True).alias("a")).head().a
    assert tuple(first) == ("anchored", 0, 3)


def test_judged_pairs(spark):
    df = spark.createDataFrame([("GPT-3", "GPT-4", 0.99), ("data base", "database", 0.95), ("cat", "dog", 0.98), ("cat", "dog", 0.96)], "left_label string, right_label string, cosine double")
    assert [(x.action, x.reason) for x in li.judge_pairs(df).collect()] == [("held", "different numbers or versions"), ("merge", "words contained"), ("merge", "cosine >= 0.97"), ("review", "similar embedding only")]


def test_cascade_steps(spark):
    names = spark.createDataFrame([(1, "t", "cat"), (2, "t", "dog"), (3, "t", "dog"), (4, "t", "hound")], "concept int, family string, key string")
    groups = spark.createDataFrame([("g", "t", "cat"), ("g", "t", "feline")], "group string, family string, key string")
    mentions = spark.createDataFrame([(10, "t", "cat", "Cat"), (11, "t", "feline", "x"), (12, "t", "dog", "Dog!"), (13, "t", "dog", "other"), (14, "t", "puppy", "p"), (15, "t", "emu", "e"), (16, "u", "cat", "c")], "mention int, family string, key string, form string")
    forms = spark.createDataFrame([(3, "Dog!")], "concept int, form string")
    declared = spark.createDataFrame([(14, "hound"), (10, "dog")], "mention int, key string")
    similar = spark.createDataFrame([(15, 2, 0.9)], "mention int, concept int, score double")
    got = {x.mention: (x.status, x.concept, x.method, x.candidates) for x in rs.resolve_cascade(mentions, rs.alias_index(names, groups), forms, declared, similar).collect()}
    new = lambda f, k: spark.range(1).select(rs.concept_id(F.lit(f), F.lit(k))).head()[0]
    assert got == {10: ("accepted", "1", "alias", 1), 11: ("accepted", "1", "alias", 1), 12: ("accepted", "3", "exact_form", 2), 13: ("ambiguous", None, "collision", 2), 14: ("accepted", "4", "declared_alias", 1), 15: ("provisional", new("t", "emu"), "similar_candidate", 1), 16: ("provisional", new("u", "cat"), "new", 0)}
    assert rs.resolve_cascade(mentions.where("mention = 15"), rs.alias_index(names), forms).head().method == "new"


def test_running_totals_and_even_samples(spark):
    rows = [(i / 7, i % 5) for i in range(1000)]
    df = spark.createDataFrame(rows, "s double, n int").repartition(5)
    total, want = 0, {}
    for s, n in sorted(rows, reverse=True):
        total += n
        want[s] = total
    assert {x.s: x.above_n for x in r.running(df, "s", ["n"], descending=True, parts=16).collect()} == want
    assert r.running(df.where("s < 0"), "s", ["n"]).collect() == []
    got = sorted(x.id for x in r.evenly(spark.range(1000).repartition(7), ["id"], 10).collect())
    assert got == [100 * i + 99 for i in range(10)]
    tops = {x.t: x.above_v for x in r.running_max(spark.createDataFrame([(i, (i * 37) % 101) for i in range(200)], "t long, v int"), "t", "v", 8).collect()}
    assert all(tops[i] == (max((k * 37) % 101 for k in range(i)) if i else None) for i in range(200))


def test_neighbours_by_brute_force(spark):
    import numpy as np

    rng = np.random.RandomState(0)
    m = rng.randn(90, 6)
    day = [D(2000, 1, 1) + dt.timedelta(days=int(x)) for x in rng.randint(0, 50, 90)]
    df = spark.createDataFrame([(i, m[i].tolist(), day[i], day[i] - dt.timedelta(days=5)) for i in range(90)], "id long, e array<double>, day date, until date")
    cos = (m / np.linalg.norm(m, axis=1, keepdims=True)) @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T
    for earlier, known in ((False, None), (True, None), (False, ("day", "until"))):
        got = {(x.a, x["rank"]): x.b for x in v.neighbours(df, "id", "e", 3, -2.0, None, earlier, known, block=20).collect()}
        for a in range(90):
            ok = [b for b in range(90) if b != a and (not earlier or b < a) and (not known or day[b] <= day[a] - dt.timedelta(days=5))]
            best = sorted(ok, key=lambda b: (-round(cos[a, b], 9), b))[:3]
            assert [got[a, k + 1] for k in range(len(best))] == best and (a, len(best) + 1) not in got


def test_descendants_and_scope(spark):
    catalogue = spark.createDataFrame([("energy", "energy", None), ("solar", "solar power", "energy"), ("cells", "photo cells", "solar")], "domain string, phrase string, parent string")
    queries = spark.createDataFrame([(1, "Energies of the sun"), (2, "solar powers"), (3, "quantum things"), (4, "xy")], "query int, text string")
    assert {(x.query, x.domain) for x in rk.match_domains(queries, catalogue).collect()} == {(2, "solar"), (2, "cells"), (1, "energy"), (1, "solar"), (1, "cells")}
    technologies = spark.createDataFrame([("t1", "Quantum computers"), ("t2", "cell")], "technology string, label string")
    domains = spark.createDataFrame([("t2", "cells")], "technology string, domain string")
    assert {tuple(x) for x in rk.scope(queries, technologies, domains, catalogue).collect()} == {(1, "domain", "t2"), (2, "domain", "t2"), (3, "label", "t1"), (4, "all", None)}


def test_workbooks_and_samples(spark, tmp_path):
    df = spark.createDataFrame([("a<&\x01", 1, None), ("b", 2, 0.5)], "s string, n int, x double")
    sinks.write_report(df, f"{tmp_path}/r.xlsx")
    with zipfile.ZipFile(f"{tmp_path}/r.xlsx") as z:
        for name in z.namelist():
            ElementTree.fromstring(z.read(name))
        sheet = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml"))
    found = [["".join(c.itertext()) for c in row] for row in sheet.iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}row")]
    assert found == [["s", "n", "x"], ["a<&", "1", ""], ["b", "2", "0.5"]]
    lines = [json.dumps({"i": i}) for i in range(2500)]
    with zipfile.ZipFile(f"{tmp_path}/s.zip", "w") as z:
        z.writestr("a/x.jsonl", "\n".join(lines))
        z.writestr("skip.txt", "{}")
    assert files.read_samples(spark, f"{tmp_path}/s.zip", "i int").agg(F.sum("i"), F.count("*")).head()[:] == (sum(range(2500)), 2500)


def test_evidence_and_audit_sinks(spark, tmp_path):
    first = spark.createDataFrame([("a", 1), ("b", 2)], "x string, version int")
    sinks.write_evidence({"mentions": first, "facts": first}, f"{tmp_path}/e", "version")
    sinks.write_evidence({"mentions": spark.createDataFrame([("c", 2)], "x string, version int")}, f"{tmp_path}/e", "version")
    assert sorted(x.x for x in spark.read.parquet(f"{tmp_path}/e/mentions").collect()) == ["a", "c"]
    assert spark.read.parquet(f"{tmp_path}/e/facts").count() == 2
    for rows in ([(1, 10, "run"), (2, 10, "run")], [(1, 20, "done"), (2, 5, "old")]):
        sinks.write_audit(spark.createDataFrame(rows, "id int, at int, state string"), f"{tmp_path}/audit", "id", "at")
    last = sinks.generations(spark, f"{tmp_path}/audit")
    assert last == [1, 2]
    assert {x.id: x.state for x in spark.read.parquet(f"{tmp_path}/audit/00000002").collect()} == {1: "done", 2: "run"}
