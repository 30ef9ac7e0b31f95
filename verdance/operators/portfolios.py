"""What the final portfolios hold, measured directly on genotypes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions import alleles as A
from verdance.functions import genotypes as G
from verdance.operators import inrecord
from verdance.operators.checks import ValidationError, assert_empty

NAMES = ("Current", "Core", "Plan_A", "Plan_B")


def portfolio_members(collection: DataFrame, core: DataFrame, plan_a: DataFrame, plan_b: DataFrame) -> DataFrame:
    """``(portfolio, sample_id)``: the collection, its core, and the core with each plan; each input has ``sample_id``."""
    name = lambda df, n: df.select(F.lit(n).alias("portfolio"), "sample_id")
    parts = [name(collection, "Current"), name(core, "Core"), name(core, "Plan_A"), name(plan_a, "Plan_A"), name(core, "Plan_B"), name(plan_b, "Plan_B")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check_members(wild: DataFrame, collection: DataFrame, core: DataFrame, plan_a: DataFrame, plan_b: DataFrame) -> None:
    """Cohorts are disjoint, the core is in the collection, the plans are nested in the Wild panel, nobody is twice."""
    assert_empty(wild.join(collection, "sample_id", "left_semi").select("sample_id"), "samples are both Wild and collection")
    for part, whole, text in ((core, collection, "core samples outside the collection"), (plan_a, plan_b, "Plan A is not in Plan B"), (plan_b, wild, "Plan B samples outside the Wild panel")):
        assert_empty(part.join(whole, "sample_id", "left_anti").select("sample_id"), text)
    assert_empty(portfolio_members(collection, core, plan_a, plan_b).groupBy("portfolio", "sample_id").count().where("count > 1"), "a portfolio holds a sample twice")


def presence(calls: DataFrame, wild: DataFrame, members: DataFrame, strict: bool = True) -> DataFrame:
    """Per site polymorphic in Wild, whether any called allele in each portfolio is the target: ``(chrom, pos, Current, Core, Plan_A, Plan_B)``.

    ``calls`` is long ``(chrom, pos, sample_id, gt)`` of biallelic sites.  One
    pass: each sample's roles come from one small row, and a site is one
    aggregation of counts.
    """
    roles = members.groupBy("sample_id").agg(F.collect_set("portfolio").alias("roles")).join(wild.select("sample_id", F.lit(True).alias("is_wild")), "sample_id", "full_outer")
    roles = roles.select("sample_id", F.coalesce("roles", F.array().cast("array<string>")).alias("roles"), F.coalesce("is_wild", F.lit(False)).alias("is_wild"))
    codes = G.called_alleles_strict(F.col("gt")) if strict else G.called_alleles_lenient(F.col("gt"), 1)
    rows = calls.join(roles, "sample_id").select("chrom", "pos", "roles", "is_wild", codes.alias("codes"))
    alt, ref = G.dosage(F.col("codes"), 1), G.dosage(F.col("codes"), 0)
    aggs = [F.sum(F.when(F.col("is_wild"), alt).otherwise(0)).alias("ac"), F.sum(F.when(F.col("is_wild"), alt + ref).otherwise(0)).alias("an")]
    for p in NAMES:
        own = F.array_contains("roles", p)
        aggs += [F.max(F.when(own, alt).otherwise(0)).alias(f"{p}_alt"), F.max(F.when(own, ref).otherwise(0)).alias(f"{p}_ref")]
    site = rows.groupBy("chrom", "pos").agg(*aggs).where(A.polymorphic(F.col("ac"), F.col("an")))
    minor = A.minor_allele(F.col("ac"), F.col("an"))
    return site.select("chrom", "pos", *[F.when(minor == "ALT", F.col(f"{p}_alt") > 0).otherwise(F.col(f"{p}_ref") > 0).alias(p) for p in NAMES])


def presence_in_record(records: DataFrame, names: Sequence[str], wild: Sequence[str], members: Sequence[tuple[str, str]]) -> DataFrame:
    """What :func:`presence` gives, from records ``(chrom, pos, ref, alt, format, cells)`` of the samples ``names``; ``members`` lists ``(portfolio, sample)``."""
    groups = {"Wild": list(wild), **{p: [s for q, s in members if q == p] for p in NAMES}}
    counted = inrecord.group_counts(records, names, groups, inrecord.STRICT)
    ac, an = F.get("Wild_AC", F.lit(1)), F.col("Wild_AN")
    site = counted.where(A.polymorphic(ac, an)).withColumn("code", G.target_code(A.minor_allele(ac, an)))
    return site.select("chrom", "pos", *[(F.get(f"{p}_AC", F.col("code")) > 0).alias(p) for p in NAMES])


def counters(sites: DataFrame) -> DataFrame:
    """One row of counters: targets, missing per portfolio, loss by the core, rescue and recovery by the plans."""
    lost = F.col("Current") & ~F.col("Core")
    aggs = [F.count("*").alias("target_total"), *[F.count_if(~F.col(p)).alias(f"{p}_missing") for p in NAMES], F.count_if(lost).alias("core_added_loss")]
    for p in NAMES[2:]:
        aggs += [F.count_if(lost & F.col(p)).alias(f"{p}_rescued_loss"), F.count_if(~F.col("Current") & F.col(p)).alias(f"{p}_recovered_original")]
    return sites.agg(*aggs)


def portfolio_table(counted: DataFrame, members: DataFrame) -> DataFrame:
    sizes = members.groupBy(F.col("portfolio").alias("Portfolio")).agg(F.count("*").alias("Sample_N"))
    per = F.array(*[F.struct(F.lit(p).alias("Portfolio"), F.col(f"{p}_missing").alias("Missing")) for p in NAMES])
    rows = counted.select("target_total", F.explode(per).alias("p")).select("target_total", "p.*").join(sizes, "Portfolio")
    kept = F.col("target_total") - F.col("Missing")
    return rows.select("Portfolio", "Sample_N", F.col("target_total").alias("Target_total"), kept.alias("Retained"), "Missing", A.rate(kept, F.col("target_total")).alias("Retention_rate"))


def identities(counted: DataFrame) -> DataFrame:
    """The two balances that must hold: ``(identity, holds)``."""
    core = F.col("Core_missing") == F.col("Current_missing") + F.col("core_added_loss")
    checks = [F.struct(F.lit("core_loss").alias("identity"), core.alias("holds"))]
    for p in NAMES[2:]:
        want = F.col("Current_missing") - F.col(f"{p}_recovered_original") + F.col("core_added_loss") - F.col(f"{p}_rescued_loss")
        checks.append(F.struct(F.lit(f"{p}_balance").alias("identity"), (F.col(f"{p}_missing") == want).alias("holds")))
    return counted.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


def check_counters(counted: DataFrame) -> None:
    if not counted.first()["target_total"]:
        raise ValidationError("no target is polymorphic in Wild")
    assert_empty(identities(counted).where("not holds"), "portfolio counters do not balance")


def anchors(counted: DataFrame, expected: Sequence[tuple[str, int]]) -> DataFrame:
    """Counters against expected values: ``(Metric, Observed, Expected, Status)``."""
    spark = counted.sparkSession
    pairs = F.array(*[F.struct(F.lit(c).alias("Metric"), F.col(c).cast("long").alias("Observed")) for c in counted.columns])
    seen = counted.select(F.explode(pairs).alias("p")).select("p.*")
    want = spark.createDataFrame(list(expected), "Metric string, Expected long")
    return want.join(seen, "Metric", "left").select("Metric", F.coalesce("Observed", F.lit(0)).alias("Observed"), "Expected", F.when(F.coalesce("Observed", F.lit(0)) == F.col("Expected"), "PASS").otherwise("FAIL").alias("Status"))
