"""Queries over the driver model, by name; DuckDB SQL for them is in :mod:`verdance.plans.oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.functions import alleles as A
from verdance.functions import genotypes as G
from verdance.functions.summaries import key_values
from verdance.functions.text import canonical_region
from verdance.operators import altstates, callability, checks, control, inrecord, portfolios, qc, rarefaction, regions, relatedness, representation, selection, validation
from verdance.plans.model import QUOTAS, WEIGHTS, WILD_REGIONS, Model
from verdance.storage import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Digits after the point that survive other orders of summation.
DIGITS = 9
#: Random portfolios per plan, the reference's default.
PERMUTATIONS = 1000


def query(build: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
    """Register ``build``; its doubles are rounded, because sums depend on their order in the last bits."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = build(Model(spark, sf_dir))
        return out.select(*[F.round(F.col(f"`{f.name}`"), DIGITS).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in out.schema])

    run.__doc__ = build.__doc__
    QUERIES[build.__name__] = run
    return build


@query
def retention_by_maf(m: Model) -> DataFrame:
    """Targets that each group retains, by frequency bin."""
    return representation.retention_by_maf(m.universe)


@query
def retention_overall(m: Model) -> DataFrame:
    return representation.retention_overall(m.universe)


@query
def retention_by_threshold(m: Model) -> DataFrame:
    return representation.retention_by_threshold(m.universe)


@query
def retention_threshold_by_maf(m: Model) -> DataFrame:
    return representation.retention_by_threshold(m.universe, by_bin=True)


@query
def missing_targets(m: Model) -> DataFrame:
    return m.missing


@query
def complementarity_by_site(m: Model) -> DataFrame:
    return representation.complementarity_by_site(m.universe)


@query
def complementarity_summary(m: Model) -> DataFrame:
    return representation.complementarity_summary(representation.complementarity_by_site(m.universe))


def _by_site(m: Model) -> DataFrame:
    return regions.occurrence_by_site(m.missing, m.regional, WILD_REGIONS)


@query
def regional_by_site(m: Model) -> DataFrame:
    return _by_site(m).withColumnRenamed("MIDDLE EAST_minor_count", "MIDDLE_EAST_minor_count")


@query
def regional_presence(m: Model) -> DataFrame:
    return regions.presence_histogram(_by_site(m), len(WILD_REGIONS))


@query
def regional_presence_by_maf(m: Model) -> DataFrame:
    return regions.presence_histogram(_by_site(m), len(WILD_REGIONS), by_bin=True)


@query
def regional_gap(m: Model) -> DataFrame:
    return regions.specific_gap(_by_site(m), m.region_sizes)


def _rarefied(m: Model, by: str) -> DataFrame:
    sizes = {r["garden"]: r["count"] for r in m.samples.groupBy("garden").count().collect()}  # three gardens
    n = [sizes.get(g, 0) for g in ("Pingshun", "Tongguan", "Zhendong")]
    sets = rarefaction.target_sets(n[1], n[2], n[0])
    if min(n) <= 0:  # the smallest tables lack a garden: nothing to rarefy to
        return rarefaction.rarefied_retention(m.spark.createDataFrame([], "Wild_minor_count int, Wild_MAF_bin string, ord int, Target_set string, Comparison_type string, Nominal_sample_size int, value double"), sets, by)
    return rarefaction.rarefied_retention(rarefaction.retained_values(m.universe, n[0], n[1], n[2]), sets, by)


@query
def rarefied_overall(m: Model) -> DataFrame:
    return _rarefied(m, "overall")


@query
def rarefied_by_maf(m: Model) -> DataFrame:
    return _rarefied(m, "maf")


@query
def rarefied_by_threshold(m: Model) -> DataFrame:
    return _rarefied(m, "threshold")


def _rates(m: Model) -> DataFrame:
    sizes = {r["material"]: r["count"] for r in m.samples.groupBy("material").count().collect()}  # two cohorts
    return callability.site_call_rates(m.universe, sizes.get("Wild", 0), sizes.get("Ex_situ", 0))


@query
def callability_sites(m: Model) -> DataFrame:
    return _rates(m).where("Allele_status = 'Ex_situ_missing'")


@query
def callability_summary(m: Model) -> DataFrame:
    return callability.callability_summary(_rates(m))


@query
def status_disagreements(m: Model) -> DataFrame:
    """The check on a list with faults: some missing targets are not on it, some retained ones are."""
    p = F.col("pos").cast("long")
    wrong = m.universe.where((F.col("Ex_situ_minor_count") > 0) & (p % 40 == 7)).select(F.col("chrom").alias("CHROM"), F.col("pos").alias("POS"))
    listed = m.missing.where(F.col("POS").cast("long") % 5 != 3).select("CHROM", "POS").unionByName(wrong)
    return callability.status_disagreements(m.universe, listed)


@query
def carrier_quality(m: Model) -> DataFrame:
    return callability.carrier_quality(callability.carrier_calls(m.calls.select("chrom", "pos", "sample_id", "gt", "dp", "gq"), m.missing))


@query
def similarity_pairs(m: Model) -> DataFrame:
    return m.pairs


def _solved(m: Model, thresholds=relatedness.THRESHOLDS) -> DataFrame:
    return relatedness.solved(m.samples, m.held_pairs, thresholds)


@query
def global_threshold_summary(m: Model) -> DataFrame:
    return relatedness.global_summary(_solved(m), m.held_pairs, relatedness.THRESHOLDS)


@query
def group_threshold_summary(m: Model) -> DataFrame:
    return relatedness.group_summary(_solved(m), m.samples, relatedness.THRESHOLDS)


@query
def component_summary(m: Model) -> DataFrame:
    return relatedness.component_summary(_solved(m), m.samples, relatedness.THRESHOLDS)


@query
def components_status(m: Model) -> DataFrame:
    return relatedness.sample_status(_solved(m), m.samples, relatedness.THRESHOLDS)


_CORE = ("SampleID", "Ex_situ_component_size", "Representative_sample", "Management_class", "Ex_situ_site")


def _status(m: Model) -> DataFrame:
    return relatedness.collection_status(_solved(m, [0.8]), m.samples)


@query
def dedup_core(m: Model) -> DataFrame:
    return relatedness.core(_status(m)).select(*_CORE)


@query
def dedup_low(m: Model) -> DataFrame:
    return relatedness.lower_priority(_status(m)).select(*_CORE)


def _states(m: Model) -> DataFrame:
    classes = [(r["SampleID"], r["Is_representative"], r["Ex_situ_site"]) for r in _status(m).select("SampleID", "Is_representative", "Ex_situ_site").collect()]  # the collection
    return altstates.state_counts_in_record(m.multi_records, m.names, classes)


@query
def alt_state_summary(m: Model) -> DataFrame:
    return altstates.coverage_summary(_states(m))


@query
def alt_lost_states(m: Model) -> DataFrame:
    return altstates.lost_states(_states(m))


@query
def alt_lost_sources(m: Model) -> DataFrame:
    return altstates.lost_sources(altstates.lost_states(_states(m)))


def _per_target(m: Model) -> DataFrame:
    wild = [r["sample_id"] for r in m.wild.orderBy("ord").collect()]  # the cohort
    sites = m.held_targets.select("CHROM", "POS", "Wild_minor_count", "Wild_MAF_bin", "code", "format", "cells")
    return materialize(inrecord.carriers_and_called(sites, m.names, wild), "target-carriers")


def _plans(m: Model) -> tuple[DataFrame, dict]:
    per = _per_target(m)
    return per, selection.select_plans(per, m.wild, m.quota_of("Greedy_Plan_A"), m.quota_of("Greedy_Plan_B"), WEIGHTS)


@query
def call_rate(m: Model) -> DataFrame:
    return selection.call_rates(_per_target(m), m.wild).drop("ord")


def _plan(m: Model, name: str) -> DataFrame:
    out = selection.plan_frame(m.spark, _plans(m)[1][name])
    return out.select(F.lit(name).alias("Plan"), "Plan_step", "SampleID", "Region", "Marginal_weighted_score", "Marginal_new_All", "Target_site_call_rate")


@query
def greedy_plan_a(m: Model) -> DataFrame:
    return _plan(m, "Greedy_Plan_A")


@query
def greedy_plan_b(m: Model) -> DataFrame:
    return _plan(m, "Greedy_Plan_B")


@query
def greedy_recovery(m: Model) -> DataFrame:
    per, plans = _plans(m)
    return selection.recovery(per, selection.members(plans, m.spark))


@query
def greedy_cumulative(m: Model) -> DataFrame:
    per, plans = _plans(m)
    return selection.cumulative_recovery(per, selection.members(plans, m.spark))


@query
def region_composition(m: Model) -> DataFrame:
    return selection.region_composition(selection.members(_plans(m)[1], m.spark), m.quotas.select("Plan", "Region", "Quota"))


@query
def random_sampling_order(m: Model) -> DataFrame:
    return control.sampling_order(m.quotas, m.wild)


def _replayed(m: Model, per: DataFrame) -> DataFrame:
    wild = [(r["sample_id"], r["region"]) for r in m.wild.orderBy("ord").collect()]  # the cohort
    pools = {r: [s for s, x in wild if x == r] for r in WILD_REGIONS}
    plans = {"Greedy_" + p: m.quota_of("Greedy_" + p) for p in QUOTAS}
    draws = control.replayed_draws([s for s, _ in wild], pools, plans, PERMUTATIONS, 20260620)
    return control.distribution(per, control.draws_frame(m.spark, draws))


@query
def random_control_distribution(m: Model) -> DataFrame:
    """One seeded stream, replayed on the driver; SQL has no such stream."""
    return _replayed(m, _per_target(m))


@query
def random_control_summary(m: Model) -> DataFrame:
    per, plans = _plans(m)
    seen = selection.recovery(per, selection.members(plans, m.spark)).where("AC_threshold = 'all'")
    return control.summary(_replayed(m, per), seen)


def _hashed(m: Model, per: DataFrame) -> DataFrame:
    return control.distribution(per, control.hashed_draws(m.wild, m.quotas, PERMUTATIONS, 7))


@query
def random_control_hashed(m: Model) -> DataFrame:
    return _hashed(m, _per_target(m))


@query
def random_control_hashed_summary(m: Model) -> DataFrame:
    per, plans = _plans(m)
    seen = selection.recovery(per, selection.members(plans, m.spark)).where("AC_threshold = 'all'")
    dist = _hashed(m, per)
    return control.summary(dist, seen)


def _qc(m: Model) -> DataFrame:
    per, plans = _plans(m)
    status = relatedness.sample_status(_solved(m, [0.8]), m.samples, [0.8])
    return qc.selected_samples(selection.members(plans, m.spark), selection.call_rates(per, m.wild), status, m.roh)


@query
def qc_samples(m: Model) -> DataFrame:
    return _qc(m)


@query
def qc_by_plan(m: Model) -> DataFrame:
    return qc.by_plan(_qc(m))


@query
def qc_repeated_components(m: Model) -> DataFrame:
    return qc.repeated_components(_qc(m))


def _portfolio(m: Model) -> tuple[DataFrame, DataFrame]:
    plans = selection.members(_plans(m)[1], m.spark)
    of = lambda p: plans.where(F.col("Plan") == p).select(F.col("SampleID").alias("sample_id"))
    core = materialize(relatedness.core(_status(m)).select(F.col("SampleID").alias("sample_id")), "core")
    members = portfolios.portfolio_members(m.collection, core, of("Greedy_Plan_A"), of("Greedy_Plan_B"))
    in_them = [tuple(r) for r in members.select("portfolio", "sample_id").collect()]  # the cohort
    sites = portfolios.presence_in_record(m.held_records, m.names, [r["sample_id"] for r in m.wild.collect()], in_them)
    return portfolios.counters(sites), members


@query
def portfolio_sizes(m: Model) -> DataFrame:
    return portfolios.portfolio_table(*_portfolio(m))


QUERIES["portfolios"] = QUERIES.pop("portfolio_sizes")


@query
def loss_and_rescue(m: Model) -> DataFrame:
    return _portfolio(m)[0]


@query
def portfolio_identities(m: Model) -> DataFrame:
    return portfolios.identities(_portfolio(m)[0])


@query
def site_order_check(m: Model) -> DataFrame:
    """The order check on a table that is out of order: events by type and user."""
    rows = m.table("events").select(F.col("event_type").alias("chrom"), F.col("user_id").alias("pos_n"), F.col("event_id").alias("row_index"))
    return checks.order_violations(rows)


@query
def duplicate_sites(m: Model) -> DataFrame:
    return checks.duplicates(m.table("lineitem"), "l_orderkey", "l_linenumber")


@query
def anchor_checks(m: Model) -> DataFrame:
    totals = m.universe.agg(F.count("*").cast("double").alias("a"), F.count_if(F.col("Ex_situ_minor_count") <= 0).cast("double").alias("b"))
    pairs = F.array(*[F.struct(F.lit(n).alias("Item"), x.alias("Observed")) for n, x in (("wild_minor_total", F.col("a")), ("combined_ex_situ_missing", F.col("b")), ("half", F.lit(0.5)))])
    expected = A.dimension(m.spark, Item=["wild_minor_total", "combined_ex_situ_missing", "half", "unknown"], Expected=[171.0, 19.0, 0.5, 1.0])
    return validation.anchor_checks(totals.select(F.explode(pairs).alias("p")).select("p.*"), expected)


@query
def invariants(m: Model) -> DataFrame:
    u = m.universe.agg(F.count("*").alias("total"), F.count_if(F.col("Ex_situ_minor_count") > 0).alias("kept"), F.count_if(F.col("Ex_situ_minor_count") <= 0).alias("lost"))
    c = representation.complementarity_summary(representation.complementarity_by_site(m.universe)).where("Wild_MAF_bin = 'All'").select(F.col("Still_missing_from_all_ex_situ").alias("still"))
    r = regions.presence_histogram(_by_site(m), len(WILD_REGIONS)).where("AC_threshold = 'all'").agg(F.sum("N_missing_Wild_minor_alleles").alias("regional"))
    rules = {"retained_plus_missing": ("kept + lost = total", ("kept", "lost", "total")), "complement_still_missing": ("still = lost", ("still", "lost")), "regions_partition_missing": ("regional = lost", ("regional", "lost"))}
    return validation.invariants(u.crossJoin(c).crossJoin(r), rules)  # three single rows


@query
def region_canonicalise(m: Model) -> DataFrame:
    """Spellings of region names made of each supplier's nation and name: white space, underscores, case, blanks and unknown names."""
    stems = ["qinling", "Lvliang_Mountains", "TAIHANG", "", "Zhongtiaoshan", "southern  loess", "na"]
    k = F.col("s_suppkey")
    stem = F.element_at(F.array(*[F.lit(x) for x in stems]), (k % len(stems) + 1).cast("int"))
    spelled = F.when(k % 3 == 0, F.concat(F.lit("  "), F.upper(stem))).when(k % 3 == 1, F.concat(stem, F.lit("\t"))).otherwise(F.concat(stem, F.lit(" "), F.col("n_name")))
    rows = m.table("supplier").join(m.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(k, canonical_region(spelled).alias("region"))


@query
def genotype_readings(m: Model) -> DataFrame:
    """How often each genotype string occurs in all calls, bent into other ploidies and faults by site, and what the readings make of it."""
    p, gt = F.col("p"), F.col("gt")
    bent = F.when(p % 7 == 1, F.replace(gt, F.lit("/"), F.lit("|"))).when(p % 7 == 2, F.concat(gt, F.lit("/0"))).when(p % 7 == 3, F.substring(gt, 1, 1)).when(p % 7 == 4, F.replace(gt, F.lit("0/"), F.lit("x/"))).when(p % 7 == 5, F.replace(gt, F.lit("0/"), F.lit("./"))).otherwise(gt)
    rows = m.calls.select(bent.alias("gt")).groupBy("gt").agg(F.count("*").alias("n"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return rows.select("gt", "n", shown(G.strict_diploid_alleles(gt)).alias("strict_diploid"), shown(G.complete_alleles(gt)).alias("complete"), shown(G.called_alleles_lenient(gt, 1)).alias("called_lenient"))


@query
def key_value_table(m: Model) -> DataFrame:
    row = m.universe.agg(F.count("*").alias("targets"), F.count_if(F.col("Ex_situ_minor_count") <= 0).alias("missing")).select("targets", "missing", F.lit(True).alias("nested"), F.lit(None).cast("double").alias("nothing"))
    return key_values(row)
