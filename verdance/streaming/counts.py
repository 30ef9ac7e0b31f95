"""Allele counts over a stream of calls: an extension, the batch operators have no unbounded inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions import genotypes as G


def unique_calls(calls: DataFrame, time_col: str = "seen_at", delay: str = "1 hour") -> DataFrame:
    """Each site and sample once inside the watermark; state is dropped after it."""
    return calls.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["chrom", "pos", "sample_id"])


def site_counts(calls: DataFrame, n_alt: int = 1) -> DataFrame:
    """Running ``(grp, chrom, pos, alt_ac, an)`` of called alleles, for update mode; partial calls count what is called."""
    codes = G.called_alleles_lenient(F.col("gt"), n_alt)
    rows = calls.select("grp", "chrom", "pos", codes.alias("codes"))
    return rows.groupBy("grp", "chrom", "pos").agg(F.sum(F.size(F.filter("codes", lambda c: c > 0))).alias("alt_ac"), F.sum(F.size("codes")).alias("an"))
