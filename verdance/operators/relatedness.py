"""Groups of near-identical samples and the core that represents them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdance.functions import alleles as A
from verdance.functions.text import threshold_label
from verdance.operators.checks import assert_empty
from verdance.operators.components import connected_components
from verdance.storage import materialize

GROUPS = ("All", "Wild", "Ex_situ", "Pingshun", "Tongguan", "Zhendong")
RULE = "First_accession_in_ascending_lexicographic_SampleID_order"
THRESHOLDS = (0.90, 0.80, 0.70, 0.50)


def all_thresholds(thresholds: Sequence[float] = THRESHOLDS, operational: float = 0.80) -> list[float]:
    """The thresholds, with the operating one if it is not among them, from high to low."""
    return sorted({*map(float, thresholds), float(operational)}, reverse=True)


def check_pairs(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """The pairs ``(a, b, pi_hat)`` without self pairs, checked: known samples, values from 0 to 1, each unordered pair once."""
    real = pairs.where("a <> b")
    assert_empty(real.where("pi_hat is null or isnan(pi_hat) or not (pi_hat between 0 and 1)"), "similarities must be numbers from 0 to 1")
    ids = samples.select(F.col("sample_id"))
    ends = real.select("a").union(real.select("b")).toDF("sample_id").distinct()
    assert_empty(ends.join(ids, "sample_id", "left_anti"), "pairs name unknown samples")
    assert_empty(real.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).count().where("count > 1"), "a pair is listed twice")
    return real


def memberships(samples: DataFrame) -> DataFrame:
    """``(group, sample_id)`` of the six groups; a sample is in All, its material and its garden."""
    g = F.array_compact(F.array(F.lit("All"), F.col("material"), F.when(F.col("garden") != "NA", F.col("garden"))))
    return samples.select(F.explode(g).alias("group"), "sample_id")


def assign_components(samples: DataFrame, pairs: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Components at every threshold, of the whole graph and of the graph inside each group.

    ``(scope, pi_hat_min, sample_id, rep, size, number)``: ``scope`` is
    ``global`` or a group, ``rep`` the first member by id, ``number`` counts
    components by their first member.  All graphs are solved in one run: a
    node is the sample inside its scope and threshold, so rounds are shared and
    no threshold waits for another.
    """
    spark = samples.sparkSession
    levels = A.dimension(spark, pi_hat_min=[float(t) for t in thresholds])
    member = memberships(samples)
    inner = pairs.join(member.withColumnRenamed("sample_id", "a"), "a").join(member.withColumnRenamed("sample_id", "b"), ["b", "group"]).select(F.col("group").alias("scope"), "a", "b", "pi_hat")
    edges = pairs.select(F.lit("global").alias("scope"), "a", "b", "pi_hat").unionByName(inner)
    edges = edges.join(F.broadcast(levels), F.col("pi_hat") >= F.col("pi_hat_min"))
    name = lambda c: F.concat_ws("\x1f", F.col("scope"), F.col("pi_hat_min").cast("string"), F.col(c))
    comp = connected_components(edges.select(name("a").alias("src"), name("b").alias("dst")))
    nodes = samples.select(F.lit("global").alias("scope"), "sample_id").unionByName(member.withColumnRenamed("group", "scope")).crossJoin(F.broadcast(levels)).withColumn("node", name("sample_id"))
    found = nodes.join(comp, "node", "left").withColumn("rep", F.coalesce(F.element_at(F.split("component", "\x1f"), -1), F.col("sample_id")))
    part = Window.partitionBy("scope", "pi_hat_min", "rep")
    # Numbers run over the components of one scope and threshold: samples, of which there are few, and not sites.
    return found.withColumn("size", F.count("*").over(part)).withColumn("number", F.dense_rank().over(Window.partitionBy("scope", "pi_hat_min").orderBy("rep"))).select("scope", "pi_hat_min", "sample_id", "rep", "size", "number")


def _labels(thresholds: Sequence[float], spark) -> DataFrame:
    return A.dimension(spark, pi_hat_min=[float(t) for t in thresholds], Threshold=[threshold_label(t) for t in thresholds])


def global_summary(assigned: DataFrame, pairs: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Per threshold: pairs at or above it, components, redundant samples."""
    levels = _labels(thresholds, assigned.sparkSession)
    high = levels.join(pairs, F.col("pi_hat") >= F.col("pi_hat_min"), "left").groupBy("Threshold", "pi_hat_min").agg(F.count("a").alias("High_similarity_pair_count"))
    one = assigned.where("scope = 'global'").groupBy("pi_hat_min").agg(
        F.count("*").alias("Total_samples"), F.count_if(F.col("sample_id") == F.col("rep")).alias("Effective_independent_N"),
        F.count_if((F.col("sample_id") == F.col("rep")) & (F.col("size") >= 2)).alias("Redundant_component_N"), F.count_if(F.col("size") >= 2).alias("Samples_in_redundant_components"),
    )
    extra = F.col("Total_samples") - F.col("Effective_independent_N")
    return high.join(one, "pi_hat_min").select(
        "Threshold", F.col("pi_hat_min").alias("PI_HAT_min"), "Total_samples", "High_similarity_pair_count", "Effective_independent_N", "Redundant_component_N", "Samples_in_redundant_components",
        extra.alias("Redundant_nonrepresentative_N"), A.rate_or_zero(extra, F.col("Total_samples")).alias("Redundancy_rate"),
    )


def group_summary(assigned: DataFrame, samples: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Effective sizes of each group by the whole graph's components and by the graph inside the group."""
    spark = assigned.sparkSession
    member = memberships(samples)
    glob = assigned.where("scope = 'global'").join(member, "sample_id").groupBy("pi_hat_min", F.col("group").alias("Group")).agg(F.countDistinct("rep").alias("n")).withColumn("Graph_scope", F.lit("global_component_membership"))
    inside = assigned.where("scope <> 'global'").groupBy("pi_hat_min", F.col("scope").alias("Group")).agg(F.countDistinct("rep").alias("n")).withColumn("Graph_scope", F.lit("induced_subgraph"))
    sizes = member.groupBy(F.col("group").alias("Group")).agg(F.count("*").alias("N"))
    every = _labels(thresholds, spark).crossJoin(A.dimension(spark, Group=list(GROUPS))).crossJoin(A.dimension(spark, Graph_scope=["global_component_membership", "induced_subgraph"]))
    n, total = F.coalesce("n", F.lit(0)), F.coalesce("N", F.lit(0))
    joined = every.join(glob.unionByName(inside), ["pi_hat_min", "Group", "Graph_scope"], "left").join(sizes.withColumnRenamed("N", "total_n"), "Group", "left")
    total = F.coalesce("total_n", F.lit(0))
    return joined.select(
        "Threshold", F.col("pi_hat_min").alias("PI_HAT_min"), "Graph_scope", "Group", total.alias("Nominal_N"), n.alias("Effective_independent_N"), (total - n).alias("Redundant_reduction_N"), A.rate_or_zero(total - n, total).alias("Redundancy_rate")
    )


def component_summary(assigned: DataFrame, samples: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """One row per component of the whole graph: size, first member, counts by material and garden, members."""
    rows = assigned.where("scope = 'global'").join(samples, "sample_id").join(_labels(thresholds, assigned.sparkSession), "pi_hat_min")
    per = [F.count_if(F.col("material") == m).alias(f"N_{m}") for m in ("Wild", "Ex_situ")] + [F.count_if(F.col("garden") == g).alias(f"N_{g}") for g in GROUPS[3:]]
    out = rows.groupBy("Threshold", "pi_hat_min", "number", "rep").agg(F.count("*").alias("Component_size"), *per, F.array_join(F.array_sort(F.collect_list("sample_id")), ";").alias("Samples"))
    return out.select(
        "Threshold", F.col("pi_hat_min").alias("PI_HAT_min"), F.format_string("%s_C%04d", "Threshold", "number").alias("Component_ID"), "Component_size", F.col("rep").alias("Representative_sample_global"),
        "N_Wild", "N_Ex_situ", "N_Pingshun", "N_Tongguan", "N_Zhendong", "Samples",
    )


def sample_status(assigned: DataFrame, samples: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """One row per threshold and sample: its component in the whole graph."""
    rows = assigned.where("scope = 'global'").join(samples, "sample_id").join(_labels(thresholds, assigned.sparkSession), "pi_hat_min")
    return rows.select(
        "Threshold", F.col("pi_hat_min").alias("PI_HAT_min"), F.col("sample_id").alias("SampleID"), F.format_string("%s_C%04d", "Threshold", "number").alias("Global_component_ID"), F.col("size").alias("Global_component_size"),
        F.col("rep").alias("Global_representative_sample"), (F.col("sample_id") == F.col("rep")).alias("Is_global_representative"), F.col("material").alias("Material_type"), F.col("garden").alias("Ex_situ_site"), F.col("region").alias("Region"),
    )


def collection_status(assigned: DataFrame, samples: DataFrame, operational: float = 0.80) -> DataFrame:
    """The collection at the operating threshold, by the graph inside the collection: keep the first of each component."""
    rows = assigned.where((F.col("scope") == "Ex_situ") & (F.abs(F.col("pi_hat_min") - operational) < 1e-12)).join(samples, "sample_id")
    keep = F.col("sample_id") == F.col("rep")
    return rows.select(
        F.col("sample_id").alias("SampleID"), F.col("pi_hat_min").alias("Operational_threshold"), F.format_string(f"EXSITU_{threshold_label(operational)}_C%04d", "number").alias("Ex_situ_component_ID"), F.col("size").alias("Ex_situ_component_size"),
        F.col("rep").alias("Representative_sample"), keep.alias("Is_representative"), F.when(keep, "Core_keep").otherwise("Lower_priority_redundant").alias("Management_class"), F.lit(RULE).alias("Representative_rule"),
        F.col("material").alias("Material_type"), F.col("garden").alias("Ex_situ_site"), F.col("region").alias("Region"),
    )


def core(status: DataFrame) -> DataFrame:
    return status.where("Is_representative")


def lower_priority(status: DataFrame) -> DataFrame:
    return status.where("not Is_representative")


def solved(samples: DataFrame, pairs: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """:func:`assign_components`, written once for the tables that read it."""
    return materialize(assign_components(samples, pairs, thresholds), "components")
