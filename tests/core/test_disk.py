"""What the feature rows move and write."""

from pyspark.sql import functions as F

from almagest.operators import features as f
from almagest.plans import products, snapshots
from almagest.sources import runtime
from almagest.sources.runtime import together
from almagest.sources.tables import visible
from almagest.sources.tables import snapshots as grid

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return str(df._jdf.queryExecution().executedPlan().toString()).count("Exchange hashpartitioning")


def test_groups_of_dealt_facts_need_no_shuffle(spark):
    view = visible(f.dealt_facts(spark, SF, F.lit("2000-01-01").cast("date")), grid(spark))
    assert exchanges(f.activity(view)) == exchanges(f.claim_slots(view)) == 0
    with together(spark):
        assert exchanges(f.activity(view).join(f.claim_slots(view), list(f.KEY))) == 0
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_ranks_of_few_values_shuffle_no_rows(spark):
    rows = spark.range(100).select(F.lit("a").alias("snapshot"), (F.col("id") % 3).alias("x"), "id")
    ranked = f.midrank(rows, ["x"])
    assert "SortMergeJoin" not in ranked._jdf.queryExecution().toString()
    assert {(r.x, round(r.x_snapshot_pct, 6)) for r in ranked.collect()} == {(0, 0.17), (1, 0.505), (2, 0.835)}


def test_dataset_rows_work_outcomes_out_once(spark, monkeypatch):
    calls = []
    own = snapshots.f.outcomes
    monkeypatch.setattr(snapshots.f, "outcomes", lambda *a: calls.append(1) or own(*a))
    products.dataset_rows(spark, SF)
    assert len(calls) == 1


def test_rank_snapshot_works_out_its_own_date_only(spark, monkeypatch):
    written = []
    own = f.midrank
    monkeypatch.setattr(f, "midrank", lambda df, *a: written.append({str(r[0]) for r in df.select("snapshot").distinct().collect()}) or own(df, *a))
    products.rank_snapshot(spark, SF)
    assert written == [{"1999-01-01"}]


def test_large_facts_are_dealt_in_turns(spark, monkeypatch):
    until = F.lit("1999-01-01").cast("date")
    plain = f.dealt_facts(spark, SF, until)
    written, own = [], type(plain.write).saveAsTable
    monkeypatch.setattr(type(plain.write), "saveAsTable", lambda w, *a, **b: written.append((w._df.count(), str(w._df._jdf.queryExecution().optimizedPlan()))) or own(w, *a, **b))
    monkeypatch.setattr(runtime, "TURN_BYTES", runtime.input_bytes(plain) // 3)
    turned = f.dealt_facts(spark, SF, until)
    assert len(written) > 2 and max(n for n, _ in written) < plain.count() / 2
    assert all(plan.count("pmod") == 2 for _, plan in written)  # both sides of the join are cut before they are shuffled
    assert turned.count() == plain.count() and turned.exceptAll(plain).isEmpty()
    assert exchanges(f.activity(visible(turned, grid(spark)))) == 0
