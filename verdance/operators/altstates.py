"""Alternative states of the collection and what of them the core still holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions import alleles as A
from verdance.functions import genotypes as G
from verdance.operators import inrecord
from verdance.operators.checks import assert_empty


def state_counts(calls: DataFrame, classes: DataFrame, allow_partial: bool = True) -> DataFrame:
    """Per site and alternative: copies in the collection, in the core and in each garden's lower-priority samples.

    ``calls`` is long: ``(chrom, pos, ref, alt, sample_id, gt)`` with ``alt``
    comma-separated; ``classes`` has ``(sample_id, in_core, garden)`` of the
    collection.  Called allele numbers count reference and star alleles too.
    Alternatives keep their index among all alternatives of the record.
    """
    alts = F.split("alt", ",")
    called = calls.join(classes, "sample_id").select("chrom", "pos", "ref", "alt", "in_core", "garden", G.called_alleles_lenient(F.col("gt"), F.size(alts), allow_partial).alias("codes"))
    sums = called.select("chrom", "pos", "ref", "alt", "in_core", "garden", F.explode("codes").alias("code"))
    # Copies per code first: the partial sums are small however many samples there are.
    per = sums.groupBy("chrom", "pos", "ref", "alt", "code").agg(
        F.count("*").alias("n"), F.count_if("in_core").alias("n_core"), F.array_sort(F.collect_set(F.when(~F.col("in_core"), F.col("garden")))).alias("low_gardens"), F.count_if(~F.col("in_core")).alias("n_low")
    )
    site = per.groupBy("chrom", "pos", "ref", "alt").agg(F.sum("n").alias("Current_AN"), F.sum("n_core").alias("Core_AN"), F.map_from_entries(F.collect_list(F.struct("code", F.struct("n", "n_core", "n_low", "low_gardens")))).alias("by_code"))
    rows = site.select("*", F.posexplode(alts).alias("i", "one_alt")).withColumn("x", F.try_element_at("by_code", F.col("i") + 1))
    rows = rows.where(A.snp_state(F.col("ref"), F.col("one_alt")) & (F.col("x.n") > 0))
    ac, an = F.col("x.n"), F.col("Current_AN")
    return rows.select(
        F.col("chrom").alias("CHROM"), F.col("pos").alias("POS"), F.col("ref").alias("REF"), (F.col("i") + 1).alias("ALT_index"), F.col("one_alt").alias("ALT"), "Current_AN", ac.alias("Current_ALT_AC"), (ac / an).alias("Current_ALT_AF"),
        "Core_AN", F.col("x.n_core").alias("Core_ALT_AC"), A.alt_frequency_bin(ac, an).alias("Current_ALT_freq_bin"), F.col("x.n_low").alias("low_copies"), F.col("x.low_gardens").alias("low_gardens"),
    )


def state_counts_in_record(records: DataFrame, names: Sequence[str], classes: Sequence[tuple[str, bool, str]], allow_partial: bool = True) -> DataFrame:
    """What :func:`state_counts` gives, from records ``(chrom, pos, ref, alt, format, cells)`` of the samples ``names``.

    ``classes`` lists ``(sample, in_core, garden)`` of the collection.  Counts
    are taken inside each record, and only its alternatives become rows.
    """
    gardens = sorted({g for _, core, g in classes if not core})
    groups = {"core": [s for s, core, _ in classes if core], **{f"low{i}": [s for s, core, g in classes if not core and g == garden] for i, garden in enumerate(gardens)}}
    counted = inrecord.group_counts(records, names, groups, inrecord.LENIENT if allow_partial else inrecord.COMPLETE_ONLY)
    low = [f"low{i}" for i in range(len(gardens))]
    total = lambda values: sum(values[1:], values[0])
    rows = counted.select("*", F.posexplode(F.split("alt", ",")).alias("i", "one_alt"))
    of = lambda g: F.get(f"{g}_AC", F.col("i") + 1)
    rows = rows.withColumn("n_core", of("core")).withColumn("n_low", total([of(g) for g in low]) if low else F.lit(0).cast("long"))
    rows = rows.withColumn("n", F.col("n_core") + F.col("n_low")).withColumn("an", total([F.col(f"{g}_AN") for g in groups]))
    here = F.array_compact(F.array(*[F.when(of(g) > 0, F.lit(garden)) for g, garden in zip(low, gardens)])) if low else F.array().cast("array<string>")
    ac, an = F.col("n"), F.col("an")
    return rows.where(A.snp_state(F.col("ref"), F.col("one_alt")) & (ac > 0)).select(
        F.col("chrom").alias("CHROM"), F.col("pos").alias("POS"), F.col("ref").alias("REF"), (F.col("i") + 1).alias("ALT_index"), F.col("one_alt").alias("ALT"), an.alias("Current_AN"), ac.alias("Current_ALT_AC"), (ac / an).alias("Current_ALT_AF"),
        F.col("core_AN").alias("Core_AN"), F.col("n_core").alias("Core_ALT_AC"), A.alt_frequency_bin(ac, an).alias("Current_ALT_freq_bin"), F.col("n_low").alias("low_copies"), here.alias("low_gardens"),
    )


def _bins(spark) -> DataFrame:
    return A.dimension(spark, Current_ALT_freq_bin=["All", *A.ALT_BINS])


def coverage_summary(states: DataFrame) -> DataFrame:
    """States and copies in the collection and covered by the core, over all and by bin.

    A state is covered if the core holds it at all; its weight is its copies in
    the whole collection.
    """
    kept = F.col("Core_ALT_AC") > 0
    rows = A.with_all_bin(states, "Current_ALT_freq_bin").groupBy("Current_ALT_freq_bin").agg(
        F.count("*").alias("s"), F.count_if(kept).alias("k"), F.sum("Current_ALT_AC").alias("c"), F.coalesce(F.sum(F.when(kept, F.col("Current_ALT_AC"))), F.lit(0)).alias("v"), F.sum("Core_ALT_AC").alias("a")
    )
    z = {c: F.coalesce(c, F.lit(0)) for c in "skcva"}
    return _bins(states.sparkSession).join(rows, "Current_ALT_freq_bin", "left").select(
        "Current_ALT_freq_bin", z["s"].alias("Current_ex_situ_observed_ALT_states"), z["k"].alias("ALT_states_retained_in_core"), (z["s"] - z["k"]).alias("ALT_states_lost_after_deredundancy"), A.rate_or_zero(z["k"], z["s"]).alias("ALT_state_presence_retention_rate"),
        z["c"].alias("Current_ex_situ_ALT_copies"), z["v"].alias("Current_ALT_copies_covered_by_core_presence"), (z["c"] - z["v"]).alias("Current_ALT_copies_not_covered_by_core_presence"), A.rate_or_zero(z["v"], z["c"]).alias("True_ALT_copy_weighted_coverage_rate"),
        z["a"].alias("Core_ALT_copy_sum_auxiliary"),
    )


def lost_states(states: DataFrame) -> DataFrame:
    """States that only lower-priority samples hold, with the gardens that hold them."""
    return states.where("Core_ALT_AC <= 0").select(
        "CHROM", "POS", "REF", "ALT_index", "ALT", "Current_AN", "Current_ALT_AC", "Current_ALT_AF", "Core_AN", "Core_ALT_AC", "Current_ALT_freq_bin", F.col("Current_ALT_AC").alias("Lost_current_ALT_copy_weight"),
        F.array_join("low_gardens", ";").alias("Loss_source_gardens"),
    )


def lost_sources(lost: DataFrame) -> DataFrame:
    """Lost states and copies by the set of gardens they were in and bin; every bin is there for every set."""
    rows = A.with_all_bin(lost, "Current_ALT_freq_bin")
    got = rows.groupBy("Loss_source_gardens", "Current_ALT_freq_bin").agg(F.count("*").alias("n"), F.sum("Current_ALT_AC").alias("c"))
    every = lost.select("Loss_source_gardens").distinct().crossJoin(_bins(lost.sparkSession))
    return every.join(got, ["Loss_source_gardens", "Current_ALT_freq_bin"], "left").select("Loss_source_gardens", "Current_ALT_freq_bin", F.coalesce("n", F.lit(0)).alias("Lost_ALT_states"), F.coalesce("c", F.lit(0)).alias("Lost_current_ALT_copies"))


def check_partition(states: DataFrame) -> None:
    """Copies of a lost state are all with lower-priority samples."""
    assert_empty(states.where("Core_ALT_AC <= 0 and low_copies <> Current_ALT_AC").select("CHROM", "POS", "ALT_index", "Current_ALT_AC", "low_copies"), "copies of a lost state do not add up")
