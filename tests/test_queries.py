"""Every query over the driver model against its SQL."""

import random
import re

import pytest
from compare import same
from pyspark.sql import functions as F

from verdance.plans import model
from verdance.plans.model import Model
from verdance.plans.oracle import SQL
from verdance.plans import text_queries  # noqa: F401
from verdance.plans.queries import QUERIES, _per_target

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    same(QUERIES[name](spark, FOLDER), SQL[name], FOLDER)


def test_queries_without_sql_have_their_rows(spark):
    assert set(QUERIES) - set(SQL) == {"random_control_distribution", "random_control_summary"}
    dist = QUERIES["random_control_distribution"](spark, FOLDER)
    assert dist.count() == 2 * 1000 * 5
    assert dist.where("Recovered_missing_Wild_minor_alleles > Missing_Wild_minor_alleles_total").isEmpty()


@pytest.mark.parametrize("name", ["retention_by_maf", "rarefied_overall", "callability_summary", "group_threshold_summary", "alt_state_summary"])
def test_smallest_tables(spark, name):
    same(QUERIES[name](spark, "/root/testdata/sf0.001"), SQL[name], "/root/testdata/sf0.001")


def test_segments_come_from_all_events(spark):
    sql = """WITH s AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey < 100)
        SELECT 'S' || k AS SampleID, CASE WHEN k % 7 = 3 THEN 'NA' ELSE CAST(count(*) FILTER (value * 10 > 4200 AND value * 10 <= 4600) AS VARCHAR) END AS NSEG_2_5Mb, CAST(count(*) FILTER (value * 10 > 4600) AS VARCHAR) AS NSEG_gt5Mb
        FROM s LEFT JOIN events ON user_id % 100 = k GROUP BY k"""
    same(Model(spark, "/root/testdata/sf0.1").roh, sql, "/root/testdata/sf0.1")


@pytest.mark.parametrize("name", ["status_disagreements", "qc_repeated_components", "dedup_low", "site_order_check", "similarity_pairs"])
def test_queries_have_hits(spark, name):
    assert not QUERIES[name](spark, FOLDER).isEmpty()


def test_replayed_control_has_all_permutations(spark):
    m = Model(spark, FOLDER)
    wild = [(r.sample_id, r.region) for r in m.wild.orderBy("ord").collect()]
    carried = [set(r.carriers) for r in _per_target(m).collect()]
    rng, want = random.Random(20260620), {}
    for plan in ("Greedy_Plan_A", "Greedy_Plan_B"):
        quota = m.quota_of(plan)
        for _ in range(1000):
            rng.sample([s for s, _ in wild], sum(quota.values()))
        for k in range(1, 1001):
            drawn = {s for region, n in quota.items() for s in rng.sample([s for s, x in wild if x == region], n)}
            want[plan, k] = sum(not drawn.isdisjoint(c) for c in carried)
    got = QUERIES["random_control_distribution"](spark, FOLDER)
    assert got.count() == 2 * 1000 * 5
    assert {(r.Plan, r.Permutation): r.Recovered_missing_Wild_minor_alleles for r in got.where("Wild_MAF_bin = 'All'").collect()} == want
    assert {r.Random_N for r in QUERIES["random_control_summary"](spark, FOLDER).collect()} == {1000}


@pytest.mark.parametrize("name", ["loss_and_rescue", "portfolio_identities"])
def test_portfolios_deal_the_lines_once(spark, monkeypatch, name):
    read, table = [], Model.table
    monkeypatch.setattr(Model, "table", lambda self, t: read.append(t) or table(self, t))
    QUERIES[name](spark, FOLDER).collect()
    assert read.count("lineitem") == 1
    plan = Model(spark, FOLDER).records._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("kind", ["records", "multi_records"])
def test_records_are_packed_without_lists(spark, monkeypatch, kind):
    whole = sorted(tuple(r) for r in getattr(Model(spark, FOLDER), kind).select("chrom", "pos", "ref", "alt", F.array_join("cells", ",")).collect())
    monkeypatch.setattr(model, "SITES_A_TASK", 16, raising=False)
    m = Model(spark, FOLDER)
    plan = getattr(m, kind)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    assert re.search(r"hashpartitioning\(p#\w+, 13\)", plan)  # 200 sites, 16 a task
    assert sorted(tuple(r) for r in getattr(m, kind).select("chrom", "pos", "ref", "alt", F.array_join("cells", ",")).collect()) == whole


def test_targets_bring_their_cells_without_a_join(spark):
    m = Model(spark, FOLDER)
    plan = m.held_targets._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(m.held_targets.select(*m.missing.columns)) == key(m.missing)
