import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from verdance.functions import alleles as A
from verdance.functions import genotypes as G
from verdance.functions.summaries import grid_quantiles
from verdance.operators import checks, control, qc
from verdance.operators.components import connected_components
from verdance.operators.representation import align


def col(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_minor_allele_ties_and_edges(spark):
    df = spark.createDataFrame([(5, 10), (6, 10), (0, 10), (10, 10), (0, 0), (1, 3)], "ac int, an int")
    ac, an = F.col("ac"), F.col("an")
    assert col(df, A.minor_allele(ac, an)) == ["ALT", "REF", None, None, None, "ALT"]
    assert col(df, A.minor_count(ac, an)) == [5, 4, None, None, None, 1]


def test_bins_include_their_upper_bounds(spark):
    df = spark.createDataFrame([(0.01,), (0.010001,), (0.05,), (0.1,), (0.11,)], "x double")
    assert col(df, A.maf_bin(F.col("x"))) == ["MAF_le_0.01", "0.01_lt_MAF_le_0.05", "0.01_lt_MAF_le_0.05", "0.05_lt_MAF_le_0.10", "MAF_gt_0.10"]
    df = spark.createDataFrame([(1, 1000), (5, 1000), (6, 1000), (6, 10), (0, 5)], "ac int, an int")
    assert col(df, A.alt_frequency_bin(F.col("ac"), F.col("an"))) == ["AC_eq_1", "AC_2_to_5", "AF_le_0.01", "AF_gt_0.10", "ALT_absent"]


def test_detection_probability_is_hypergeometric(spark):
    rng = random.Random(5)
    cases = []
    for _ in range(300):
        an = rng.randrange(0, 41)
        cases.append((an, rng.randrange(0, an + 1), rng.randrange(0, an + 1)))
    df = spark.createDataFrame(cases, "an int, ac int, d int").withColumn("lf", A.log_factorials(40))
    got = df.select("an", "ac", "d", A.detection_probability(F.col("an"), F.col("ac"), F.col("d"), F.col("lf")).alias("p")).collect()
    for r in got:
        want = 1 - Fraction(math.comb(r.an - r.ac, r.d), math.comb(r.an, r.d)) if r.an and r.ac and r.d else 0
        assert abs(r.p - float(want)) < 1e-11


def test_genotype_readings(spark):
    df = spark.createDataFrame([("1/.",), (".|0",), ("0/2",), ("1",), ("x/1",), ("./.",), (None,)], "gt string")
    gt = F.col("gt")
    assert col(df, G.complete_alleles(gt)) == [None, None, [0, 2], [1], None, None, None]
    assert col(df.where("gt <> '0/2'"), G.called_alleles_lenient(gt, 1)) == [[1], [0], [1], [], []]
    assert col(df.where("gt in ('1/.', '.|0')"), G.called_alleles_strict(gt)) == [[1], [0]]
    for bad in ("0/2", "x/1"):
        with pytest.raises(Exception, match="allele range"):
            df.where(gt == bad).select(G.called_alleles_strict(gt)).collect()
    with pytest.raises(Exception, match="allele range"):
        df.where("gt = '0/2'").select(G.strict_diploid_alleles(gt)).collect()


def test_components_are_transitive_and_lexicographic(spark):
    edges = spark.createDataFrame([("x10", "x2"), ("x2", "x3"), ("s", "s"), (None, "x2"), ("x3", "x2")], "src string, dst string")
    assert {r.node: r.component for r in connected_components(edges).collect()} == {"x10": "x10", "x2": "x10", "x3": "x10"}
    assert connected_components(edges.where("false")).count() == 0


def test_components_of_long_chains(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    assert {r.component for r in connected_components(edges).collect()} == {0}


def test_grid_quantiles_follow_the_count_rule(spark):
    values = [0.0, 0.0004, 0.5, 0.5005, 1.2]
    df = spark.createDataFrame([("k", v) for v in values], "k string, x double")
    r = grid_quantiles(df, ["k"], "x", {"q05": 0.05, "q50": 0.5, "q95": 0.95}).first()
    assert (r.q05, r.q50, r.q95) == (0.0, 0.5, 1.0)


def test_align_rejects_repeats_and_gaps(spark):
    rows = [("Wild", "c", "1", 1, 2), ("Ex_situ", "c", "1", 0, 2)]
    df = lambda x: spark.createDataFrame(x, "grp string, chrom string, pos string, alt_ac int, an int")
    assert align(df(rows), ("Wild", "Ex_situ")).count() == 1
    for bad in (rows + rows[:1], rows[:1]):
        with pytest.raises(checks.ValidationError):
            align(df(bad), ("Wild", "Ex_situ"))


def test_order_checks(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 5, 1), ("b", 2, 2), ("a", 9, 3), ("b", 2, 4)], "chrom string, pos_n long, row_index long")
    assert [tuple(r) for r in checks.unsorted_positions(df).collect()] == [("b", 2, 4)]
    assert {r.chrom for r in checks.chromosome_overlaps(df).collect()} == {"b"}


def test_replayed_draws_share_one_stream():
    pools = {"r": ["a", "b", "c"], "q": ["d", "e"]}
    plans = {"A": {"r": 1, "q": 0}, "B": {"r": 2, "q": 1}}
    got = control.replayed_draws("abcde", pools, plans, 3, 1)
    rng = random.Random(1)
    want = []
    for plan, quota in plans.items():
        for _ in range(3):
            rng.sample("abcde", sum(quota.values()))
        for k in (1, 2, 3):
            for region, n in quota.items():
                if n:
                    want += [(plan, k, s) for s in rng.sample(pools[region], n)]
    assert got == want


def test_long_roh_prefers_counts(spark):
    df = spark.createDataFrame([("1", "0", "0"), ("NA", "", "2500"), ("0", "0", "9999"), ("NA", "2", "0"), ("0", ".", "9999")], "NSEG_2_5Mb string, nseg_5mb_plus string, Max_ROH_segment_KB string")
    flag, how = qc.long_roh(df)
    counts = "NSEG_2_5Mb_plus_NSEG_gt5Mb"
    assert [tuple(r) for r in df.select(flag, how).collect()] == [(True, counts), (True, "maximum_ROH_length_KB"), (False, counts), (True, counts), (False, counts)]
    for name in ("Max_ROH_BP", "Max_ROH_length_bp", "Maximum_ROH_BP"):
        df = spark.createDataFrame([("2000000",), ("2000001",)], f"{name} string")
        assert [tuple(r) for r in df.select(*qc.long_roh(df)).collect()] == [(False, "maximum_ROH_length_BP"), (True, "maximum_ROH_length_BP")]


def test_metadata_as_users_have_it(spark, tmp_path):
    from verdance.sources.tables import read_metadata

    rows = ["IID\tMaterial_type\tEx_situ_site\tRegion\tRegistered_region", "W1\tWILD\tPingshun\t\tqinling", "W2\twild\t\tNA\tqinling", "E1\texsitu\tTongguan\t\t", "E2\tEx situ\tPingshun\tlvliang\ttaihang", "NA\tWild\t\t\t", "\tWild\t\t\t"]
    (tmp_path / "m.tsv").write_text("\n".join(rows) + "\n")
    got = {r.sample_id: (r.material, r.garden, r.region) for r in read_metadata(spark, str(tmp_path / "m.tsv")).collect()}
    assert got == {"W1": ("Wild", "NA", "Qinling Mountains"), "W2": ("Wild", "NA", "NA"), "E1": ("Ex_situ", "Tongguan", "NA"), "E2": ("Ex_situ", "Pingshun", "Lvliang Mountain")}
