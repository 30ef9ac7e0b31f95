"""Retention at equal sample size: the largest garden rarefied to the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions import alleles as A


def target_sets(n_tg: int, n_zd: int, n_ps: int) -> list[tuple[str, str, int]]:
    """Name, kind and nominal size of the five sets, in table order."""
    kind = "allele_copy_rarefied_expected"
    return [
        ("PS_RG_observed", "observed", n_ps),
        ("TG_RG_observed", "observed", n_tg),
        ("ZD_RG_observed", "observed", n_zd),
        (f"PS_RG_rarefied_to_TG_RG_sample_size_n{n_tg}_expected", kind, n_tg),
        (f"PS_RG_rarefied_to_ZD_RG_sample_size_n{n_zd}_expected", kind, n_zd),
    ]


def retained_values(universe: DataFrame, n_ps: int, n_tg: int, n_zd: int, ploidy: int = 2) -> DataFrame:
    """Per target and set the observed presence or the expected one.

    The probability depends on three small counts only, so it is computed once
    for each distinct triple and joined back; the triples are bounded by the
    cube of the allele number, not by the sites.
    """
    if min(n_ps, n_tg, n_zd) <= 0:
        raise ValueError("gardens must have samples")
    an, ac = F.col("Pingshun_AN").cast("int"), F.col("Pingshun_minor_count").cast("int")
    rows = universe.withColumns({"__an": an, "__ac": ac})
    rows = rows.withColumns({"__dt": A.rarefied_draw(F.col("__an"), n_tg, n_ps), "__dz": A.rarefied_draw(F.col("__an"), n_zd, n_ps)})
    key = ["__an", "__ac", "__dt", "__dz"]
    table = universe.sparkSession.range(1).select(A.log_factorials(ploidy * n_ps).alias("__lf"))  # one row
    triples = rows.select(*key).distinct().crossJoin(F.broadcast(table))
    triples = triples.select(*key, *[A.detection_probability(F.col("__an"), F.col("__ac"), F.col(d), F.col("__lf")).alias(p) for d, p in (("__dt", "__pt"), ("__dz", "__pz"))])
    rows = rows.join(triples, key)
    held = lambda g: (F.col(f"{g}_minor_count") > 0).cast("double")
    values = [held("Pingshun"), held("Tongguan"), held("Zhendong"), F.col("__pt"), F.col("__pz")]
    sets = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(s).alias("Target_set"), F.lit(k).alias("Comparison_type"), F.lit(n).alias("Nominal_sample_size"), v.alias("value")) for i, ((s, k, n), v) in enumerate(zip(target_sets(n_tg, n_zd, n_ps), values))])
    return rows.select("Wild_minor_count", "Wild_MAF_bin", F.explode(sets).alias("s")).select("Wild_minor_count", "Wild_MAF_bin", "s.*")


def rarefied_retention(values: DataFrame, sets: list[tuple[str, str, int]], by: str = "overall") -> DataFrame:
    """Retained targets of each set ``overall``, by ``maf`` bin or by ``threshold``."""
    spark = values.sparkSession
    names = ["Target_set", "Comparison_type", "Nominal_sample_size"]
    every = A.dimension(spark, Target_set=[s[0] for s in sets], Comparison_type=[s[1] for s in sets], Nominal_sample_size=[s[2] for s in sets])
    keys = list(names)
    if by == "maf":
        every, keys = every.crossJoin(A.maf_bins(spark)), [*keys, "Wild_MAF_bin"]
    elif by == "threshold":
        values = A.by_threshold(values, F.col("Wild_minor_count"))
        every, keys = A.thresholds(spark).crossJoin(every), ["AC_threshold", "Wild_minor_count_min", *keys]
    counts = values.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    n, v = F.coalesce("n", F.lit(0)), F.coalesce("v", F.lit(0.0))
    return every.join(counts, keys, "left").select(
        *keys, n.alias("Total_Wild_SNP_minor_alleles"), v.alias("Retained_Wild_SNP_minor_alleles"), A.rate(v, n).alias("Retention_rate"), (n - v).alias("Missing_or_not_retained"), A.rate(n - v, n).alias("Missing_rate")
    )
