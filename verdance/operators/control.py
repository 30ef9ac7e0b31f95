"""Whether the selection beats random choices with the same regional quotas."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions import alleles as A

KIND = "random_region_matched"
#: Buckets in which targets are numbered side by side.
NUMBERING = 256


def replayed_draws(wild: Sequence[str], pools: Mapping[str, Sequence[str]], plans: Mapping[str, Mapping[str, int]], n: int, seed: int, burn: bool = True) -> list[tuple[str, int, str]]:
    """``(plan, permutation, sample)`` of one Mersenne stream that all plans share.

    For each plan in order: with ``burn``, first ``n`` draws of the plan's size
    from all samples, which are thrown away; then ``n`` portfolios, region
    after region in the quotas' order, skipping regions without a quota.  The
    populations are lists because their order is part of the result.
    """
    if n <= 0:
        raise ValueError("the number of permutations must be positive")
    rng, out = random.Random(seed), []
    for plan, quota in plans.items():
        if burn:
            for _ in range(n):
                rng.sample(list(wild), sum(quota.values()))
        for permutation in range(1, n + 1):
            for region, size in quota.items():
                if size > 0:
                    out += [(plan, permutation, s) for s in rng.sample(list(pools[region]), size)]
    return out


def draws_frame(spark, draws: list[tuple[str, int, str]]) -> DataFrame:
    return spark.createDataFrame(draws, "Plan string, Permutation int, SampleID string")


def hashed_draws(wild: DataFrame, quotas: DataFrame, n: int, seed: int) -> DataFrame:
    """The same kind of draws without a stream: in each region the samples with the smallest hash of seed, plan, permutation and id.

    Declarative, so any engine and any partitioning give the same portfolios.
    ``wild`` is ``(sample_id, region)``, ``quotas`` is ``(Plan, Region, Quota)``.
    """
    from pyspark.sql import Window

    pool = wild.select("sample_id", F.col("region").alias("Region")).join(F.broadcast(quotas.where("Quota > 0")), "Region").withColumn("Permutation", F.explode(F.sequence(F.lit(1), F.lit(n))))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), "Plan", F.col("Permutation").cast("string"), "sample_id").cast("binary"))
    w = Window.partitionBy("Plan", "Permutation", "Region").orderBy(key, "sample_id")
    return pool.withColumn("k", F.row_number().over(w)).where("k <= Quota").select("Plan", "Permutation", F.col("sample_id").alias("SampleID"))


def _bitmaps(per_target: DataFrame) -> DataFrame:
    """Per sample and bin (and all bins) the targets it carries as bitmaps of 32,768 bits."""
    numbered = _numbered(per_target).select("Wild_MAF_bin", "carriers", "idx")
    rows = A.with_all_bin(numbered).select("Wild_MAF_bin", "idx", F.explode("carriers").alias("SampleID"))
    return rows.groupBy("SampleID", "Wild_MAF_bin", F.bitmap_bucket_number("idx").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("idx")).alias("bits"))


def _numbered(per_target: DataFrame) -> DataFrame:
    """Targets with dense numbers ``idx`` from 1: the place within a hash bucket of the site, after all buckets before it.

    A lost task gives the same numbers again, since both parts depend on the
    rows alone.
    """
    from pyspark.sql import Window

    rows = per_target.withColumn("__b", F.pmod(F.xxhash64("CHROM", "POS"), F.lit(NUMBERING)))
    totals = rows.groupBy("__b").agg(F.count("*").alias("__n"))
    # At most NUMBERING rows, in the window and in the broadcast.
    before = totals.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))
    placed = rows.withColumn("__k", F.row_number().over(Window.partitionBy("__b").orderBy("CHROM", "POS")))
    return placed.join(F.broadcast(before), "__b").withColumn("idx", F.col("__before") + F.col("__k")).drop("__b", "__k", "__before")


def distribution(per_target: DataFrame, draws: DataFrame) -> DataFrame:
    """Targets that each random portfolio recovers, by bin (and all bins); portfolios that recover nothing are there with 0.

    Carrier sets are bitmaps, combined with OR on the map side: a portfolio is
    a few kilobytes however many targets it carries.
    """
    spark = per_target.sparkSession
    bits = draws.join(_bitmaps(per_target), "SampleID").groupBy("Plan", "Permutation", "Wild_MAF_bin", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    got = bits.groupBy("Plan", "Permutation", "Wild_MAF_bin").agg(F.sum(F.bitmap_count("bits")).alias("r"))
    total = A.with_all_bin(per_target).groupBy("Wild_MAF_bin").agg(F.count("*").alias("t"))
    size = draws.groupBy("Plan", "Permutation").agg(F.count("*").alias("Wild_supplement_N"))
    every = size.crossJoin(A.maf_bins(spark, with_all=True))
    r, t = F.coalesce("r", F.lit(0)), F.coalesce("t", F.lit(0))
    out = every.join(got, ["Plan", "Permutation", "Wild_MAF_bin"], "left").join(total, "Wild_MAF_bin", "left")
    return out.select("Plan", F.lit(KIND).alias("Control_type"), "Permutation", "Wild_supplement_N", "Wild_MAF_bin", r.alias("Recovered_missing_Wild_minor_alleles"), t.alias("Missing_Wild_minor_alleles_total"), A.rate_or_zero(r, t).alias("Recovery_rate"))


def summary(dist: DataFrame, observed: DataFrame) -> DataFrame:
    """Random recovery rates against the observed ones ``(Plan, Wild_MAF_bin, Recovered_missing_Wild_minor_alleles, Recovery_rate)``."""
    seen = observed.select("Plan", "Wild_MAF_bin", F.col("Recovered_missing_Wild_minor_alleles").alias("obs"), F.col("Recovery_rate").alias("obs_rate"))
    x, o = F.col("Recovery_rate"), F.col("obs_rate")
    rows = dist.join(F.broadcast(seen), ["Plan", "Wild_MAF_bin"])  # a row per plan and bin
    quant = {"q025": 0.025, "q05": 0.05, "q50": 0.5, "q95": 0.95, "q975": 0.975}
    out = rows.groupBy("Plan", "Control_type", "Wild_supplement_N", "Wild_MAF_bin", F.col("Missing_Wild_minor_alleles_total"), F.col("obs").alias("Greedy_recovered"), F.col("obs_rate").alias("Greedy_recovery_rate")).agg(
        F.count("*").alias("Random_N"), F.avg(x).alias("Random_mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("Random_sd"), F.min(x).alias("Random_min"),
        *[F.percentile(x, F.lit(q)).alias(f"Random_{n}") for n, q in quant.items()], F.max(x).alias("Random_max"), F.count_if(x >= o).alias("ge"), F.count_if(x <= o).alias("le"),
    )
    g, sd = F.col("Greedy_recovery_rate"), F.col("Random_sd")
    out = out.withColumns({
        "Greedy_minus_random_q975_percentage_points": (g - F.col("Random_q975")) * 100.0,
        "Empirical_p_random_ge_greedy": (F.col("ge") + 1) / (F.col("Random_N") + 1),
        "Greedy_percentile_vs_random": F.col("le") / F.col("Random_N"),
        "Greedy_z_score": F.when(sd > 0, F.try_divide(g - F.col("Random_mean"), sd)).otherwise(0.0),
    })
    return out.drop("ge", "le")


def sampling_order(quotas: DataFrame, wild: DataFrame) -> DataFrame:
    """The regions of each plan ``(Plan, Region, Quota, rng_order)`` in drawing order, with the samples they have."""
    from pyspark.sql import Window

    have = wild.groupBy(F.col("region").alias("Region")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("Plan").orderBy("rng_order", "Region"))
    out = quotas.withColumn("Region_sampling_order", place).join(have, "Region", "left")
    return out.select("Plan", "Region_sampling_order", "Region", "Quota", F.coalesce("n", F.lit(0)).alias("Available_Wild_samples"), (F.col("Quota") > 0).alias("Included_in_random_sampling"))


def gain_validation(summary_rows: DataFrame, expected: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Observed gains over the random 97.5 % quantile against expected ones ``(Plan, Wild_MAF_bin, Expected_gain_pp)``."""
    diff = F.abs(F.col("Greedy_minus_random_q975_percentage_points") - F.col("Expected_gain_pp"))
    return summary_rows.join(expected, ["Plan", "Wild_MAF_bin"]).select(
        "Plan", "Wild_MAF_bin", F.col("Greedy_minus_random_q975_percentage_points").alias("Observed_gain_pp"), F.col("Expected_gain_pp").alias("Expected_manuscript_gain_pp"), F.lit(tolerance).alias("Tolerance_pp"),
        diff.alias("Absolute_difference_pp"), F.when(diff <= tolerance, "PASS").otherwise("FAIL").alias("Status"),
    )
