"""Which of the Wild panel's rarer alleles each group holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions import alleles as A
from verdance.operators.checks import assert_empty

GROUPS = ("Wild", "Ex_situ", "Pingshun", "Tongguan", "Zhendong")
TARGET_GROUPS = GROUPS[1:]


def align(acan: DataFrame, groups: Sequence[str] = GROUPS, check: bool = True) -> DataFrame:
    """One row per site with ``<group>_AC`` and ``<group>_AN`` of the long table ``(grp, chrom, pos, alt_ac, an)``.

    One shuffle on the site whatever the number of groups.  With ``check`` a
    site that a group lacks or has twice is an error; without it groups that
    lack a site have no calls there.
    """
    one = lambda g, c: F.sum(F.when(F.col("grp") == g, F.col(c)))
    cols = [x for g in groups for x in (one(g, "alt_ac").alias(f"{g}_AC"), one(g, "an").alias(f"{g}_AN"), F.count_if(F.col("grp") == g).alias(f"{g}_rows"))]
    wide = acan.where(F.col("grp").isin(*groups)).groupBy("chrom", "pos").agg(*cols)
    if check:
        wrong = " or ".join(f"`{g}_rows` <> 1" for g in groups)
        assert_empty(wide.where(wrong).select("chrom", "pos", *[f"{g}_rows" for g in groups]), "allele-count tables do not hold the same sites once each")
    return wide.select("chrom", "pos", *[F.coalesce(f"{g}_{c}", F.lit(0)).alias(f"{g}_{c}") for g in groups for c in ("AC", "AN")])


def targets(sites: DataFrame, groups: Sequence[str] = TARGET_GROUPS) -> DataFrame:
    """Sites polymorphic in Wild with the target allele, its count, frequency and bin, and each group's copies."""
    ac, an = F.col("Wild_AC"), F.col("Wild_AN")
    out = sites.where(A.polymorphic(ac, an)).withColumn("Wild_minor_allele", A.minor_allele(ac, an)).withColumn("Wild_minor_count", A.minor_count(ac, an))
    out = out.withColumn("Wild_minor_MAF", F.col("Wild_minor_count") / F.col("Wild_AN")).withColumn("Wild_MAF_bin", A.maf_bin(F.col("Wild_minor_MAF")))
    return out.select("*", *[A.target_count(F.col(f"{g}_AC"), F.col(f"{g}_AN"), F.col("Wild_minor_allele")).alias(f"{g}_minor_count") for g in groups])


def missing_targets(universe: DataFrame, *carried: str) -> DataFrame:
    """Targets that the whole collection lacks; ``carried`` names further columns to keep."""
    lost = universe.where("Ex_situ_minor_count <= 0")
    return lost.select(
        F.col("chrom").alias("CHROM"), F.col("pos").alias("POS"), "Wild_AC", "Wild_AN", (F.col("Wild_AN") - F.col("Wild_AC")).alias("Wild_REF_count"), F.col("Wild_AC").alias("Wild_ALT_count"),
        "Wild_minor_allele", "Wild_minor_count", "Wild_minor_MAF", "Wild_MAF_bin", "Ex_situ_AC", "Ex_situ_AN", (F.col("Ex_situ_AN") - F.col("Ex_situ_AC")).alias("Ex_situ_REF_count"), F.col("Ex_situ_AC").alias("Ex_situ_ALT_count"),
        *carried,
    )


def _by_group(universe: DataFrame, groups: Sequence[str]) -> DataFrame:
    held = F.array(*[F.struct(F.lit(g).alias("Target_group"), (F.col(f"{g}_minor_count") > 0).alias("held")) for g in groups])
    return universe.select("Wild_MAF_bin", F.explode(held).alias("g")).select("Wild_MAF_bin", "g.*")


def _retention(counts: DataFrame, keys: list[str]) -> DataFrame:
    n, kept = F.coalesce("n", F.lit(0)), F.coalesce("kept", F.lit(0))
    return counts.select(
        *keys, n.alias("Wild_minor_alleles"), kept.alias("Retained_Wild_minor_alleles"), (n - kept).alias("Missing_Wild_minor_alleles"),
        A.rate(kept, n).alias("Minor_allele_retention_rate"), A.rate(n - kept, n).alias("Missing_rate"),
    )


def retention_overall(universe: DataFrame, groups: Sequence[str] = TARGET_GROUPS) -> DataFrame:
    """Targets that each group retains and lacks."""
    counts = _by_group(universe, groups).groupBy("Target_group").agg(F.count("*").alias("n"), F.count_if("held").alias("kept"))
    return _retention(A.dimension(universe.sparkSession, Target_group=list(groups)).join(counts, "Target_group", "left"), ["Target_group"])


def retention_by_maf(universe: DataFrame, groups: Sequence[str] = TARGET_GROUPS) -> DataFrame:
    """The same by frequency bin; empty bins are there with zeros."""
    spark, keys = universe.sparkSession, ["Target_group", "Wild_MAF_bin"]
    counts = _by_group(universe, groups).groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("held").alias("kept"))
    every = A.dimension(spark, Target_group=list(groups)).crossJoin(A.maf_bins(spark))  # literals of fixed size
    return _retention(every.join(counts, keys, "left"), keys)


def retention_by_threshold(universe: DataFrame, by_bin: bool = False) -> DataFrame:
    """Targets that the collection retains and lacks by nested count threshold, and by bin if asked."""
    spark = universe.sparkSession
    keys = ["AC_threshold", "Wild_minor_count_min"] + ["Wild_MAF_bin"] * by_bin
    rows = A.by_threshold(universe, F.col("Wild_minor_count"))
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("Ex_situ_minor_count") <= 0).alias("gone"))
    every = A.thresholds(spark).crossJoin(A.maf_bins(spark)) if by_bin else A.thresholds(spark)
    n, gone = F.coalesce("n", F.lit(0)), F.coalesce("gone", F.lit(0))
    return every.join(counts, keys, "left").select(
        *keys, n.alias("Total_Wild_SNP_minor_alleles"), gone.alias("Missing_in_all_Ex_situ"), (n - gone).alias("Retained_in_Ex_situ"), A.rate(n - gone, n).alias("Retention_rate"), A.rate(gone, n).alias("Missing_rate")
    )


def complementarity_by_site(universe: DataFrame) -> DataFrame:
    """Targets that the first garden lacks, with the others' copies and the class."""
    return universe.where("Pingshun_minor_count <= 0").select(
        F.col("chrom").alias("CHROM"), F.col("pos").alias("POS"), "Wild_minor_allele", "Wild_minor_count", "Wild_minor_MAF", "Wild_MAF_bin", "Pingshun_minor_count", "Tongguan_minor_count", "Zhendong_minor_count",
        A.complementarity(F.col("Tongguan_minor_count"), F.col("Zhendong_minor_count")).alias("Complementarity_class"),
    )


def complementarity_summary(by_site: DataFrame) -> DataFrame:
    """Classes over all bins and in each: grouping sets over one pass."""
    per = [F.count_if(F.col("Complementarity_class") == c).alias(c) for c in A.COMPLEMENTARITY]
    counts = A.with_all_bin(by_site).groupBy("Wild_MAF_bin").agg(F.count("*").alias("n"), *per)
    every = A.maf_bins(by_site.sparkSession, with_all=True)
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n", *A.COMPLEMENTARITY)}
    still = zero[A.COMPLEMENTARITY[3]]
    return every.join(counts, "Wild_MAF_bin", "left").select(
        "Wild_MAF_bin", zero["n"].alias("PS_RG_missing_Wild_minor_alleles"), *[zero[c].alias(c) for c in A.COMPLEMENTARITY], (zero["n"] - still).alias("Recovered_by_TG_RG_or_ZD_RG"),
        A.rate(zero["n"] - still, zero["n"]).alias("Recovery_rate_by_Tongguan_or_Zhendong"), A.rate(still, zero["n"]).alias("Still_missing_rate_in_all_exsitu"),
    )
