"""Column builders for allele counts, frequencies and their classes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names and order of the frequency bins and count thresholds.
MAF_BINS = ("MAF_le_0.01", "0.01_lt_MAF_le_0.05", "0.05_lt_MAF_le_0.10", "MAF_gt_0.10")
THRESHOLDS = {"all": 1, "AC_ge_2": 2, "AC_ge_3": 3}
ALT_BINS = ("AC_eq_1", "AC_2_to_5", "AF_le_0.01", "0.01_lt_AF_le_0.05", "0.05_lt_AF_le_0.10", "AF_gt_0.10")
COMPLEMENTARITY = ("TG_RG_only", "ZD_RG_only", "Both_TG_RG_and_ZD_RG", "Still_missing_from_all_ex_situ")
BASES = ("A", "C", "G", "T")


def _steps(cases: list[tuple[Column, object]], otherwise: object = None) -> Column:
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), F.lit(otherwise))


def polymorphic(ac: Column, an: Column) -> Column:
    """Both alleles are there."""
    return (ac > 0) & (ac < an)


def minor_allele(ac: Column, an: Column) -> Column:
    """The rarer allele, ``ALT`` on a tie; null at a site that is not polymorphic."""
    return F.when(polymorphic(ac, an), F.when(ac * 2 <= an, "ALT").otherwise("REF"))


def minor_count(ac: Column, an: Column) -> Column:
    return F.when(polymorphic(ac, an), F.least(ac, an - ac))


def target_count(ac: Column, an: Column, minor: Column) -> Column:
    """Copies of the target allele; 0 without calls, so "missing" can mean "not called"."""
    return F.when(minor == "ALT", ac).when(minor == "REF", an - ac).otherwise(F.raise_error(F.concat(F.lit("unknown target allele: "), F.coalesce(minor, F.lit("null")))))


def maf_bin(maf: Column) -> Column:
    """Frequency bin; upper bounds belong to the bin."""
    return F.when(maf.isNotNull(), _steps([(maf <= bound, name) for bound, name in zip((0.01, 0.05, 0.10), MAF_BINS)], MAF_BINS[3]))


def alt_frequency_bin(ac: Column, an: Column) -> Column:
    """Bin of an alternative state: counts of 1 and of 2 to 5 go before the frequency."""
    af = ac / F.greatest(an, F.lit(1))
    cases = [((ac <= 0) | (an <= 0), "ALT_absent"), (ac == 1, ALT_BINS[0]), (ac <= 5, ALT_BINS[1])]
    return _steps(cases + [(af <= b, n) for b, n in zip((0.01, 0.05, 0.10), ALT_BINS[2:5])], ALT_BINS[5])


def complementarity(tongguan: Column, zhendong: Column) -> Column:
    """Which of two gardens holds an allele that the first one lacks."""
    tg, zd = tongguan > 0, zhendong > 0
    return _steps([(tg & zd, COMPLEMENTARITY[2]), (tg, COMPLEMENTARITY[0]), (zd, COMPLEMENTARITY[1])], COMPLEMENTARITY[3])


def snp_state(ref: Column, alt: Column) -> Column:
    """Whether one alternative is a single base other than the reference base, in either case."""
    r, a = F.upper(ref), F.upper(alt)
    return r.isin(*BASES) & a.isin(*BASES) & (r != a)


def rate(part: Column, whole: Column) -> Column:
    """Share; null where there is nothing, which sinks print as NA."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def rate_or_zero(part: Column, whole: Column) -> Column:
    """Share; 0 where there is nothing."""
    return F.coalesce(rate(part, whole), F.lit(0.0))


def call_rate(an: Column, samples: int, ploidy: int = 2) -> Column:
    """Called alleles of those possible; more than possible is an error."""
    most = ploidy * samples
    return F.when(an > most, F.raise_error(F.concat(F.lit(f"allele number exceeds {most}: "), an.cast("string"))).cast("double")).otherwise(an / F.lit(float(most)))


def rarefied_draw(an: Column, n: int, of: int) -> Column:
    """Allele copies to draw for ``n`` of ``of`` samples: in proportion, half to even, within what was called."""
    return F.least(an, F.greatest(F.lit(0), F.rint(an * F.lit(n) / F.lit(float(of))).cast("int")))


def log_factorials(most: int) -> Column:
    """Literal array of ln(i!) for i up to ``most``: a bound that ploidy and cohort size give, not the data."""
    return F.array(*[F.lit(math.lgamma(i + 1)) for i in range(most + 1)])


def detection_probability(an: Column, ac: Column, draw: Column, table: Column) -> Column:
    """Hypergeometric chance that ``draw`` of ``an`` copies hold at least one of ``ac``.

    ``table`` is a column with :func:`log_factorials` up to the largest count.
    """
    lf = lambda x: F.element_at(table, (x + 1).cast("int"))
    none = lf(an - ac) - lf(an - ac - draw) - lf(an) + lf(an - draw)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.exp(none)))
    return F.when((an <= 0) | (ac <= 0) | (draw <= 0), 0.0).when(draw > an - ac, 1.0).otherwise(p)


def dimension(spark: SparkSession, **columns: list) -> DataFrame:
    """A literal frame, one row per position of the lists; for rows that must be there even without data."""
    names = list(columns)
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in zip(*columns.values())])
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def thresholds(spark: SparkSession) -> DataFrame:
    return dimension(spark, AC_threshold=list(THRESHOLDS), Wild_minor_count_min=list(THRESHOLDS.values()))


def maf_bins(spark: SparkSession, with_all: bool = False) -> DataFrame:
    names = (["All"] if with_all else []) + list(MAF_BINS)
    return dimension(spark, Wild_MAF_bin=names)


def by_threshold(rows: DataFrame, count: Column) -> DataFrame:
    """Each row once for every nested threshold that ``count`` reaches; a fixed small expansion, no join."""
    levels = F.array(*[F.struct(F.lit(n).alias("AC_threshold"), F.lit(m).alias("Wild_minor_count_min")) for n, m in THRESHOLDS.items()])
    return rows.select("*", F.explode(F.filter(levels, lambda x: x["Wild_minor_count_min"] <= count)).alias("__t")).select("*", "__t.*").drop("__t")


def with_all_bin(rows: DataFrame, bin_col: str = "Wild_MAF_bin") -> DataFrame:
    """Each row in its bin and again in the bin ``All``."""
    return rows.withColumn(bin_col, F.explode(F.array(F.col(bin_col), F.lit("All"))))
