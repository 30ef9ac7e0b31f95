"""Whether the selected samples are sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdance.functions.text import first_column, number
from verdance.operators.checks import assert_empty

# Column names under which the length classes and lengths come, most trusted first, and the names of the three ways.
COUNT_2_5 = ("NSEG_2_5Mb", "N_ROH_2_5Mb", "ROH_2_5Mb_N")
COUNT_GT5 = ("NSEG_gt5Mb", "NSEG_5Mb_plus", "N_ROH_gt5Mb")
MAX_KB = ("Max_ROH_KB", "Max_ROH_length_KB", "Maximum_ROH_KB", "Max_total_ROH_KB_observed", "Max_ROH_segment_KB")
MAX_BP = ("Max_ROH_BP", "Max_ROH_length_bp", "Maximum_ROH_BP")
BY_COUNTS, BY_KB, BY_BP = "NSEG_2_5Mb_plus_NSEG_gt5Mb", "maximum_ROH_length_KB", "maximum_ROH_length_BP"


def long_roh(df: DataFrame) -> tuple[Column, Column]:
    """Whether a row has a run of homozygosity above 2 Mb, and how that was told.

    Counts of the two long classes go first, of which one is enough and an
    absent one is 0, then the longest run in kb, then in bp; a row with none of
    them is an error.
    """
    col = lambda names: number(F.col(f"`{c}`")) if (c := first_column(df.columns, *names)) else F.lit(None).cast("double")
    n2, n5, kb, bp = (col(n) for n in (COUNT_2_5, COUNT_GT5, MAX_KB, MAX_BP))
    counted = n2.isNotNull() | n5.isNotNull()
    none = F.raise_error(F.lit("no usable ROH length field"))
    flag = F.when(counted, F.coalesce(n2, F.lit(0.0)) + F.coalesce(n5, F.lit(0.0)) > 0).when(kb.isNotNull(), kb > 2000).when(bp.isNotNull(), bp > 2_000_000).otherwise(none.cast("boolean"))
    how = F.when(counted, BY_COUNTS).when(kb.isNotNull(), BY_KB).when(bp.isNotNull(), BY_BP)
    return flag, how


def selected_samples(plan: DataFrame, rates: DataFrame, status: DataFrame, roh: DataFrame, threshold: float = 0.60, operational: float = 0.80) -> DataFrame:
    """Each selected sample with call rate, its place among all Wild rates, component and long runs.

    ``plan`` is ``(Plan, Step, SampleID)``; ``rates`` holds all Wild samples,
    which are the population of the percentile.  A selected sample without one
    of the three annotations, or with a component of another threshold, is an
    error.
    """
    picked = plan.select("SampleID").distinct()
    for table, name in ((rates, "call rate"), (status, "component"), (roh, "ROH")):
        assert_empty(picked.join(table.select("SampleID"), "SampleID", "left_anti"), f"selected samples without {name}")
    assert_empty(picked.join(status, "SampleID").where(F.abs(F.col("PI_HAT_min") - operational) > 1e-12).select("SampleID", "PI_HAT_min"), "components of another threshold")
    flag, how = long_roh(roh)
    place = rates.select("SampleID", "Target_site_call_rate", F.cume_dist().over(Window.orderBy("Target_site_call_rate")).alias("pct"))  # one row per Wild sample
    runs = roh.select("SampleID", flag.alias("ROH_gt_2Mb"), how.alias("ROH_gt_2Mb_detection_method"))
    out = plan.join(place, "SampleID").join(status.select("SampleID", "Global_component_ID", "Global_component_size"), "SampleID").join(runs, "SampleID")
    return out.select(
        "Plan", "Step", "SampleID", "Target_site_call_rate", F.col("pct").alias("Call_rate_percentile_within_all_Wild"), (F.col("Target_site_call_rate") < threshold).alias("Below_selected_call_rate_threshold"),
        "Global_component_ID", "Global_component_size", "ROH_gt_2Mb", "ROH_gt_2Mb_detection_method",
    )


def repeated_components(rows: DataFrame) -> DataFrame:
    """Components with more than one selected sample in a plan, members in plan order."""
    got = rows.groupBy("Plan", "Global_component_ID").agg(F.count("*").alias("Selected_sample_N"), F.array_sort(F.collect_list(F.struct("Step", "SampleID"))).alias("m")).where("Selected_sample_N > 1")
    return got.select("Plan", "Global_component_ID", "Selected_sample_N", F.array_join(F.col("m.SampleID"), ";").alias("Selected_samples"))


def by_plan(rows: DataFrame, threshold: float = 0.60) -> DataFrame:
    """One row per plan; its method is that of the plan's first sample."""
    x = F.col("Target_site_call_rate")
    main = rows.groupBy("Plan").agg(
        F.count("*").alias("Selected_sample_N"), F.min(x).alias("Call_rate_min"), F.percentile(x, F.lit(0.05)).alias("Call_rate_p05"), F.percentile(x, F.lit(0.5)).alias("Call_rate_median"), F.avg(x).alias("Call_rate_mean"), F.max(x).alias("Call_rate_max"),
        F.count_if("Below_selected_call_rate_threshold").alias("Below_call_rate_threshold_N"), F.count_if("ROH_gt_2Mb").alias("Selected_with_ROH_gt_2Mb_N"), F.min_by("ROH_gt_2Mb_detection_method", "Step").alias("ROH_detection_method"),
    )
    rep = repeated_components(rows).groupBy("Plan").agg(F.count("*").alias("rc"), F.sum("Selected_sample_N").alias("rs"))
    return main.join(rep, "Plan", "left").select(
        "Plan", "Selected_sample_N", "Call_rate_min", "Call_rate_p05", "Call_rate_median", "Call_rate_mean", "Call_rate_max", "Below_call_rate_threshold_N", F.lit(threshold).alias("Call_rate_threshold"), "Selected_with_ROH_gt_2Mb_N",
        F.coalesce("rc", F.lit(0)).alias("Repeated_PIHAT_component_N"), F.coalesce("rs", F.lit(0)).alias("Repeated_selected_accession_N"), "ROH_detection_method",
    )
