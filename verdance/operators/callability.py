"""Whether missing alleles are called, and how well their carriers are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions import alleles as A
from verdance.functions import genotypes as G
from verdance.functions.summaries import grid_quantiles, value_summary
from verdance.operators.checks import assert_empty

LEVELS = ("0_50", "0_80", "0_90", "0_95")
QUANTILES = {"p01_approx": 0.01, "p05_approx": 0.05, "median_approx": 0.5, "p95_approx": 0.95}
STATUS = ("Ex_situ_missing", "Ex_situ_retained")


def status_disagreements(universe: DataFrame, missing: DataFrame) -> DataFrame:
    """Sites that are missing by their counts but not listed, or listed but not missing."""
    listed = missing.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), F.lit(True).alias("listed"))
    both = universe.select("chrom", "pos", (F.col("Ex_situ_minor_count") <= 0).alias("rebuilt")).join(listed, ["chrom", "pos"], "full_outer")
    return both.where("coalesce(rebuilt, false) <> coalesce(listed, false)").select("chrom", "pos", "rebuilt", "listed")


def site_call_rates(universe: DataFrame, n_wild: int, n_collection: int, ploidy: int = 2) -> DataFrame:
    """Targets with status and call rates of both cohorts."""
    return universe.select(
        F.col("chrom").alias("CHROM"), F.col("pos").alias("POS"), "Wild_minor_allele", "Wild_minor_count", "Wild_minor_MAF", "Wild_MAF_bin", "Wild_AN", "Ex_situ_AN",
        A.call_rate(F.col("Wild_AN"), n_wild, ploidy).alias("Wild_call_rate"), A.call_rate(F.col("Ex_situ_AN"), n_collection, ploidy).alias("Ex_situ_call_rate"),
        F.when(F.col("Ex_situ_minor_count") <= 0, STATUS[0]).otherwise(STATUS[1]).alias("Allele_status"),
    )


def callability_summary(rates: DataFrame) -> DataFrame:
    """Call rates by status, threshold and bin (and all bins): mean, extremes, grid quantiles, counts under four levels."""
    spark, keys = rates.sparkSession, ["Allele_status", "AC_threshold", "Wild_minor_count_min", "Wild_MAF_bin"]
    rows = A.with_all_bin(A.by_threshold(rates, F.col("Wild_minor_count")))
    aggs = [F.count("*").alias("Site_N")]
    for g in ("Wild", "Ex_situ"):
        x = F.col(f"{g}_call_rate")
        aggs += [F.avg(x).alias(f"{g}_call_rate_mean"), F.min(x).alias(f"{g}_call_rate_min"), F.max(x).alias(f"{g}_call_rate_max")]
        aggs += [F.count_if(x < float(v.replace("_", "."))).alias(f"{g}_call_rate_lt_{v}_N") for v in LEVELS]
    out = A.dimension(spark, Allele_status=list(STATUS)).crossJoin(A.thresholds(spark)).crossJoin(A.maf_bins(spark, with_all=True)).join(rows.groupBy(*keys).agg(*aggs), keys, "left")
    for g in ("Wild", "Ex_situ"):
        out = out.join(grid_quantiles(rows, keys, f"{g}_call_rate", {f"{g}_call_rate_{k}": q for k, q in QUANTILES.items()}), keys, "left")
    n = F.coalesce("Site_N", F.lit(0))
    cols = [n.alias("Site_N")]
    for g in ("Wild", "Ex_situ"):
        p = f"{g}_call_rate"
        cols += [F.col(f"{p}_{c}") for c in ("mean", "min", "p01_approx", "p05_approx", "median_approx", "p95_approx", "max")]
        cols += [F.coalesce(f"{p}_lt_{v}_N", F.lit(0)).alias(f"{p}_lt_{v}_N") for v in LEVELS]
        cols += [A.rate(F.coalesce(f"{p}_lt_{v}_N", F.lit(0)), n).alias(f"{p}_lt_{v}_fraction") for v in LEVELS]
    return out.select(*keys, *cols)


def carrier_calls(calls: DataFrame, missing: DataFrame) -> DataFrame:
    """Complete calls of any ploidy that carry a missing target: ``(CHROM, POS, sample_id, dosage, dp, gq, ...)``.

    ``calls`` is long: ``(chrom, pos, sample_id, gt, dp, gq)`` with depth and
    quality as text.  The targets meet the calls by site before anything of a
    genotype is read.
    """
    goal = missing.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), "Wild_minor_allele", "Wild_minor_count", "Wild_MAF_bin")
    found = calls.join(goal, ["chrom", "pos"]).withColumn("dosage", G.dosage(G.complete_alleles(F.col("gt")), G.target_code(F.col("Wild_minor_allele"))))
    return found.where("dosage > 0").withColumns({"dp": G.numeric_field(F.col("dp")), "gq": G.numeric_field(F.col("gq"))})


def carrier_quality(carriers: DataFrame) -> DataFrame:
    """Carrier calls, copies, and depth and quality summaries by threshold and bin (and all bins)."""
    spark, keys = carriers.sparkSession, ["AC_threshold", "Wild_minor_count_min", "Wild_MAF_bin"]
    rows = A.with_all_bin(A.by_threshold(carriers, F.col("Wild_minor_count")))
    got = rows.groupBy(*keys).agg(F.count("*").alias("Carrier_genotype_N"), F.sum("dosage").alias("Carrier_target_allele_copies"), *value_summary(F.col("dp"), "DP"), *value_summary(F.col("gq"), "GQ"))
    out = A.thresholds(spark).crossJoin(A.maf_bins(spark, with_all=True)).join(got, keys, "left")
    zero = ("Carrier_genotype_N", "Carrier_target_allele_copies", "DP_N", "GQ_N")
    return out.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in zero else F.col(c) for c in out.columns])


def check_carriers(carriers: DataFrame) -> None:
    """Every carrier has a depth and a quality."""
    assert_empty(carriers.where("dp is null or gq is null").select("chrom", "pos", "sample_id"), "carrier calls lack numeric DP or GQ")
