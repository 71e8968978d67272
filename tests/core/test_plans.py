"""Registered queries against the SQL each must equal, on the smallest tables."""

import glob
import math
import os

import pytest

from almagest.plans import evaluation, evidence, products, registry, scans

SF = "/root/testdata/sf0.001"
CHANGED = ("snapshot_participants", "snapshot_convergence", "midrank_pct", "future_outcomes", "structural_hole", "mutual_knn", "outlier_distance", "areas", "best_f1", "bm25_search", "uniform_sample", "two_hop_sample", "domain_tags", "budget_greedy")
NAMES = sorted({*products.ORACLE_SQL, *evidence.ORACLE_SQL, *scans.ORACLE_SQL, *CHANGED, *(n for n in evaluation.ORACLE_SQL if n.startswith(("stream", "late", "language", "organization", "lexical", "near")))})


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return str(value).removesuffix(" 00:00:00") if hasattr(value, "year") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())
