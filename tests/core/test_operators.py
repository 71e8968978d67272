import datetime as dt
import io
import math
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from almagest import __main__ as cli
from almagest import config
from almagest.functions.register import register
from almagest.operators import features as f
from almagest.operators import graph as g
from almagest.operators import metrics as m
from almagest.operators import rows as r
from almagest.operators import search as s
from almagest.operators import vectors as v
from almagest.operators.components import connected_components
from almagest.plans import graphs
from almagest.sources import files

D = dt.date


def edges(spark, *pairs):
    return spark.createDataFrame([(min(p), max(p)) for p in pairs], "src long, dst long")


def as_dict(df, key, value):
    return {row[key]: row[value] for row in df.collect()}


def test_path_of_three(spark):
    """A path 1-2-3, whose figures are known in closed form."""
    e = edges(spark, (1, 2), (2, 3))
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    assert as_dict(g.degree(e), "node", "degree") == {1: 1, 2: 2, 3: 1}
    assert as_dict(g.structural_hole(e), "node", "structural_hole") == {1: 0.0, 2: 0.5, 3: 0.0}
    ranks = as_dict(g.pagerank(e, nodes, iterations=40), "node", "rank")
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks[2] > ranks[1] == pytest.approx(ranks[3])
    assert as_dict(g.k_core(e), "node", "core") == {1: 1, 2: 1, 3: 1}
    grouped = e.withColumn("k", F.lit("x"))
    assert as_dict(g.betweenness(grouped, "k"), "node", "betweenness") == {1: 0.0, 2: 1.0, 3: 0.0}
    assert len(set(as_dict(g.communities(grouped, "k"), "node", "community").values())) == 1
    domains = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "node long, d string")
    row = g.neighbour_profile(e, domains, "d").where("node = 2").head()
    assert row.neighbour_entropy == pytest.approx(math.log(2)) and row.crossing_share == 1.0


def part_graph(spark, sf):
    """The neighbours of each part, from the tables themselves."""
    orders, near = {}, {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        orders.setdefault(r[0], set()).add(r[1])
    for parts in orders.values():
        for a in parts:
            near.setdefault(a, set()).update(parts - {a})
    return {a: sorted(b) for a, b in near.items() if b}


def test_graph_queries_run_over_the_parts(spark):
    sf = "/root/testdata/sf0.001"
    near = part_graph(spark, sf)
    assert len(near) > 100
    core, left = {}, {a: set(b) for a, b in near.items()}
    while left:
        low = min(left, key=lambda a: len(left[a]))
        core[low] = max(len(left[low]), max(core.values(), default=0))
        for b in left.pop(low):
            left[b].discard(low)
    assert as_dict(graphs.k_core(spark, sf), "node", "core") == core

    between = dict.fromkeys(near, 0.0)
    for root in near:
        depth, paths, order = {root: 0}, {root: 1}, [root]
        for a in order:
            for b in near[a]:
                if b not in depth:
                    depth[b], paths[b] = depth[a] + 1, 0
                    order.append(b)
                paths[b] += paths[a] if depth[b] == depth[a] + 1 else 0
        credit = dict.fromkeys(order, 0.0)
        for b in reversed(order):
            for a in near[b]:
                credit[a] += paths[a] / paths[b] * (1 + credit[b]) if depth[a] == depth[b] - 1 else 0
            between[b] += credit[b] if b != root else 0
    scale = (len(near) - 1) * (len(near) - 2)
    got = as_dict(graphs.betweenness(spark, sf), "node", "betweenness")
    assert got.keys() == near.keys() and all(abs(got[a] - between[a] / scale) < 2e-9 for a in near)

    hole = as_dict(graphs.part_structural_hole(spark, sf), "node", "structural_hole")
    for a in near:
        c = sum((1 / len(near[a]) + sum(1 / len(near[a]) / len(near[q]) for q in near[a] if b in near[q])) ** 2 for b in near[a])
        assert hole[a] == pytest.approx(min(1, max(0, 1 - c)), abs=2e-6)
    assert as_dict(graphs.part_neighbour_profile(spark, sf), "node", "neighbours") == {a: len(b) for a, b in near.items()}
    assert {r.node for r in graphs.communities(spark, sf).collect()} == set(near)


def test_ranks_and_labels_run_to_the_end(spark):
    pairs = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5)]
    near = {a: [y if x == a else x for x, y in pairs if a in (x, y)] for a in range(1, 7)}  # 6 has no edge
    ranks, rounds, change = dict.fromkeys(near, 1 / 6), 0, 1.0
    while change >= 1e-10:
        new = {a: (0.15 + 0.85 * ranks[6]) / 6 + 0.85 * sum(ranks[b] / len(near[b]) for b in near[a]) for a in near}
        ranks, rounds, change = new, rounds + 1, sum(abs(new[a] - ranks[a]) for a in near)
    got = as_dict(g.pagerank(edges(spark, *pairs), spark.createDataFrame([(a,) for a in near], "node long")), "node", "rank")
    assert 20 < rounds < 100 and all(got[a] == pytest.approx(ranks[a], abs=1e-9) for a in near)

    rng = random.Random(633041629)
    assert (rng.choice([60, 120, 300, 800]), rng.choice([2, 3, 4, 6]), rng.randrange(3)) == (800, 6, 1)
    pairs = {tuple(sorted(rng.sample(range(800), 2))) for _ in range(2400)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    label, moved, rounds = {a: a for a in near}, True, 0
    while moved:
        moved, rounds = False, rounds + 1
        for a in sorted(near):
            votes = Counter(label[b] for b in near[a])
            best = [v for v, c in votes.items() if c == max(votes.values())]
            if label[a] not in best:
                label[a], moved = min(best), True
    got = g.communities(edges(spark, *pairs).withColumn("k", F.lit(0)), "k")
    assert 20 < rounds < 100 and as_dict(got, "node", "community") == label


def test_k_core_of_a_clique_with_a_tail(spark):
    e = edges(spark, (1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4), (4, 5), (5, 6), (7, 8))
    assert as_dict(g.k_core(e), "node", "core") == {1: 3, 2: 3, 3: 3, 4: 3, 5: 1, 6: 1, 7: 1, 8: 1}


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (200, 200)]
    got = as_dict(connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b"), "node", "component")
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 150)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_contexts_over_the_bound_are_left_out(spark):
    rows = spark.createDataFrame([(n, "big") for n in range(9)] + [(1, "small"), (2, "small")], "n long, c string")
    assert [(x.src, x.dst) for x in g.co_mentions(rows, "n", "c", 5).collect()] == [(1, 2)]


def test_stars_follow_the_priority(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 4)).withColumn("k", F.lit(0))
    p = spark.createDataFrame([(1, 1.0), (2, 9.0), (3, 2.0), (4, 1.0)], "node long, priority double")
    assert as_dict(g.stars(e, p, "k"), "node", "center") == {2: 2, 1: 2, 3: 2, 4: 4}


def facts(spark, rows):
    return spark.createDataFrame(rows, "technology long, document long, observed date, organization long, kind string, stage int, family string")


def test_later_facts_change_no_snapshot(spark):
    rows = [(1, k, D(2017 + k % 3, 1 + k, 3), k % 2, "AN"[k % 2], k, "f") for k in range(1, 9)]
    grid = spark.createDataFrame([(D(2020, 1, 1),)], "snapshot date")
    view = lambda x: facts(spark, x).join(F.broadcast(grid), F.col("observed") <= F.col("snapshot"))
    later = rows + [(1, 99, D(2020, 1, 2), 5, "A", 7, "z"), (2, 98, D(2021, 1, 1), 5, "A", 7, "z")]
    for group in (f.activity, f.dynamics, f.decline, f.maturity, lambda x: f.diversity(x, "organization", "o"), lambda x: f.turnover(x, "organization", "o"), f.claim_slots):
        assert group(view(rows)).collect() == group(view(later)).collect()


def test_window_edges(spark):
    grid = spark.createDataFrame([(D(2020, 1, 1),)], "snapshot date")
    rows = facts(spark, [(1, 1, D(2019, 1, 1), 1, "A", 1, "f"), (1, 2, D(2019, 1, 2), 1, "A", 1, "f"), (1, 3, D(2020, 1, 1), 1, "A", 1, "f")])
    row = f.activity(rows.join(grid)).head()
    assert row.documents_last_year == 2 and row.publication_growth == pytest.approx(math.log(3 / 2))


def test_midrank_with_ties_and_missing(spark):
    df = spark.createDataFrame([("t", 1.0), ("t", 1.0), ("t", 3.0), ("t", None)], "snapshot string, x double")
    got = sorted((row.x or -1, row.x_snapshot_pct) for row in f.midrank(df, ["x"]).collect())
    assert got[0] == (-1, None) and [round(p, 6) for _, p in got[1:]] == [round(1 / 3, 6)] * 2 + [round(2.5 / 3, 6)]


def test_as_of_and_latest(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), ("c", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 10, "z")], "k string, t int, v string")
    got = {(x.k, x.t): x.v for x in r.as_of(left, right, ["k"], "t", "t", ["v"]).collect()}
    assert got == {("a", 5): "y", ("a", 1): None, ("b", 9): None, ("c", 1): None}
    assert sorted((x.k, x.v) for x in r.latest(right, ["k"], ["t"]).collect()) == [("a", "y"), ("b", "z")]
    assert r.evenly(spark.range(100), [F.col("id")], 10).count() == 10


def test_metrics_in_closed_form(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0)], "p double, y int")
    a = m.areas(df, "p", "y").head()
    assert a.pr_auc == pytest.approx((1 + 2 / 3) / 2) and a.roc_auc == pytest.approx(0.75)
    b = m.best_f1(df, "p", "y").head()
    assert (b.threshold, round(b.f1, 6)) == (0.7, 0.8)
    ties = spark.createDataFrame([(0.5, 1), (0.5, 0)], "p double, y int")
    assert m.areas(ties, "p", "y").head().roc_auc == 0.5
    low, high = m.bootstrap(df.withColumn("f", F.monotonically_increasing_id()), "f", "y").select("low", "high").head()
    assert 0 <= low <= 0.5 <= high <= 1


def test_vectors_in_blocks(spark):
    rows = [(i, i % 2, [math.cos(i), math.sin(i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, grp int, v array<double>")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and math.cos(a[0] - b[0]) >= 0.9)
    for block in (512, 5):
        assert sorted((x.left, x.right) for x in v.pairs_above(df, "id", "v", 0.9, "grp", block).collect()) == want
    assert v.taxonomy(df, "id", "v", 2, 3).count() == 40
    paths = lambda d: sorted(map(tuple, v.taxonomy(d, "id", "v", 2, 3).collect()))
    assert paths(df) == paths(df.orderBy(F.desc("id")))  # the input's order decides nothing
    seeds = v.greedy_clusters(df.withColumn("s", F.col("id").cast("double")), "grp", "id", "v", "s", 0.95, 3)
    assert seeds.groupBy("seed").count().agg(F.max("count")).head()[0] <= 3


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, "C++ c#")], "id long, t string")
    q = spark.createDataFrame([(7, "a"), (7, "c#")], "query long, term string")
    got = {x.doc: x.score for x in s.bm25(docs, "id", "t", q).collect()}
    avg = 7 / 3
    assert got[1] == pytest.approx(math.log(1 + 2.5 / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg))) and set(got) == {1, 3}


def test_files(spark, tmp_path):
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p></w:body></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "a.docx").write_bytes(raw.getvalue())
    (tmp_path / "b.md").write_text("# H\nline")
    (tmp_path / "b.md.meta.json").write_text('{"x": 1}')
    (tmp_path / "c.docx").write_bytes(b"broken")
    rows = files.read_files(spark, f"file://{tmp_path}").orderBy("path", "place").collect()
    assert [(x.path.rsplit("/", 1)[1], x.headings, x.text) for x in rows] == [("a.docx", "", "Top"), ("a.docx", "Top", "Text"), ("b.md", "H", "# H\nline")]
    assert rows[2].metadata == '{"x": 1}' and "b.md" in files.manifest(spark, f"file://{tmp_path}")


def test_settings_and_names(spark, capsys):
    assert config.load({}).problems() == []
    for bad in ({"x": {}}, {"ranking": {"y": 1}}, {"dataset": {"valid_share": 0.95}}):
        with pytest.raises(ValueError):
            config.load(bad)
    register(spark)
    row = spark.sql("SELECT months_before(date'2020-03-31', 1) a, log_growth(1, 0) b, ratio(1, 0) c, parse_iso('x') d, lexical_key('Big Nets') e").head()
    assert (row.a, row.c, row.d, row.e) == (D(2020, 2, 29), None, None, "big net")
    cli.main([])
    assert "snapshot_activity" in capsys.readouterr().out
