"""Where in the wild the alleles that the collection lacks occur."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions import alleles as A
from verdance.functions.text import joined_or
from verdance.operators.checks import assert_empty, duplicates


def check_regional(missing: DataFrame, regional: DataFrame, regions: Sequence[str]) -> None:
    """Every regional table ``(region, chrom, pos, alt_ac, an)`` has each missing target once and nothing else."""
    sites = missing.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"))
    assert_empty(duplicates(regional, "region", "chrom", "pos"), "a regional table repeats a site")
    assert_empty(regional.join(sites, ["chrom", "pos"], "left_anti").select("region", "chrom", "pos"), "a regional table has sites that are no missing target")
    wanted = sites.crossJoin(A.dimension(missing.sparkSession, region=list(regions)))  # as many rows as the tables must have
    assert_empty(wanted.join(regional, ["region", "chrom", "pos"], "left_anti").select("region", "chrom", "pos"), "a regional table lacks missing targets")


def occurrence_by_site(missing: DataFrame, regional: DataFrame, regions: Sequence[str]) -> DataFrame:
    """Each missing target with the regions that hold it and its copies in each.

    One conditional aggregation per site instead of a join per region.
    """
    site = regional.select(F.col("chrom").alias("CHROM"), F.col("pos").alias("POS"), "region", "alt_ac", "an").join(missing.select("CHROM", "POS", "Wild_minor_allele"), ["CHROM", "POS"])
    site = site.withColumn("n", A.target_count(F.col("alt_ac"), F.col("an"), F.col("Wild_minor_allele")))
    per = site.groupBy("CHROM", "POS").agg(
        F.array_sort(F.collect_set(F.when(F.col("n") > 0, F.col("region")))).alias("here"), *[F.coalesce(F.sum(F.when(F.col("region") == r, F.col("n"))), F.lit(0)).alias(f"{r}_minor_count") for r in regions]
    )
    found = F.size("here")
    return missing.join(per, ["CHROM", "POS"]).select(
        "CHROM", "POS", "Wild_minor_allele", "Wild_minor_count", "Wild_minor_MAF", "Wild_MAF_bin", found.alias("Presence_region_count"), joined_or(F.col("here")).alias("Presence_regions"),
        F.when(found == 1, F.get("here", F.lit(0))).otherwise("NA").alias("Region_specific_region"), *[f"`{r}_minor_count`" for r in regions],
    )


def presence_histogram(by_site: DataFrame, n_regions: int, by_bin: bool = False) -> DataFrame:
    """Missing targets by threshold, number of regions and, if asked, bin; every combination is there."""
    spark = by_site.sparkSession
    keys = ["AC_threshold", "Wild_minor_count_min"] + ["Wild_MAF_bin"] * by_bin + ["Presence_region_count"]
    counts = A.by_threshold(by_site, F.col("Wild_minor_count")).groupBy(*keys).agg(F.count("*").alias("n"))
    every = A.thresholds(spark).crossJoin(A.dimension(spark, Presence_region_count=list(range(n_regions + 1))))
    every = every.crossJoin(A.maf_bins(spark)) if by_bin else every
    return every.join(counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("N_missing_Wild_minor_alleles"))


def specific_gap(by_site: DataFrame, region_sizes: DataFrame) -> DataFrame:
    """Targets that only one region holds, by threshold and region, and per sample of the region (``Region, Wild_sample_N``)."""
    rows = A.by_threshold(by_site.where("Presence_region_count = 1"), F.col("Wild_minor_count"))
    counts = rows.groupBy("AC_threshold", "Wild_minor_count_min", F.col("Region_specific_region").alias("Region")).agg(F.count("*").alias("n"))
    every = A.thresholds(by_site.sparkSession).crossJoin(region_sizes.select("Region", "Wild_sample_N"))
    n = F.coalesce("n", F.lit(0))
    return every.join(counts, ["AC_threshold", "Wild_minor_count_min", "Region"], "left").select(
        "AC_threshold", "Wild_minor_count_min", "Region", "Wild_sample_N", n.alias("Region_specific_missing_Wild_minor_alleles"), (n / F.col("Wild_sample_N")).alias("Region_specific_gap_per_sample")
    )


def check_no_absent(by_site: DataFrame) -> None:
    assert_empty(by_site.where("Presence_region_count = 0").select("CHROM", "POS"), "missing targets are absent from all regions")
