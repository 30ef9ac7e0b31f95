"""The steps of a study over files: each reads inputs or earlier results and writes its tables."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.config import Config
from verdance.functions.text import canonical_region
from verdance.operators import altstates, callability, control, portfolios, qc, rarefaction, regions, relatedness, representation, selection, validation
from verdance.operators.checks import ValidationError, assert_empty, set_mismatch
from verdance.progress import Counted, watched
from verdance.sinks import prepare_output, write_counters, write_items, write_sites, write_tsv
from verdance.sources import carriers as caches
from verdance.sources import tables, vcf
from verdance.storage import materialize

NAMES = (
    "01_allele_representation", "02_regional_occurrence_and_gap", "03_sample_size_standardized_retention", "04_callability_and_carrier_quality", "05_PIHAT_components_and_core",
    "06_core_SNP_ALT_coverage", "07_greedy_plan_selection", "08_region_matched_random_control", "09_selected_sample_QC", "10_final_wild_portfolios", "validation",
)
MISSING = "05.ex_situ_missing_wild_minor_alleles.tsv.gz"
CARRIERS, BITSETS = "07.Wild_target_carriers.parquet", "07.Wild_target_carrier_bitsets.json.gz"
PLAN_FILES = {"Greedy_Plan_A": "01.Greedy_Plan_A_Wild_supplements.tsv", "Greedy_Plan_B": "02.Greedy_Plan_B_Wild_supplements.tsv"}
BIN = ("Wild_MAF_bin",)
THRESHOLD = ("AC_threshold",)


class Study:
    """A configuration with the session that runs it."""

    def __init__(self, spark: SparkSession, config: Config, missing_table: str | None = None):
        self.spark, self.config, self.p, self.missing_table = spark, config, config.parameters, missing_table

    def out(self, step: int):
        return self.config.output / NAMES[step - 1]

    def fresh(self, step: int):
        return prepare_output(self.config.output, NAMES[step - 1], self.config.raw)

    def samples_of(self, group: str) -> DataFrame:
        return tables.read_sample_list(self.spark, self.config.sample_list(group))

    def acan(self, *groups: str, wild_rows: Counted | None = None) -> DataFrame:
        parts = [tables.read_acan(self.spark, self.config.acan(g), g) for g in groups]
        if wild_rows:
            parts = [wild_rows.of(p, rows=F.count(F.lit(1))) if g == "Wild" else p for g, p in zip(groups, parts)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def universe(self, wild_rows: Counted | None = None) -> DataFrame:
        return materialize(representation.targets(representation.align(self.acan(*representation.GROUPS, wild_rows=wild_rows))), "universe")

    @property
    def missing_path(self) -> str:
        override = self.missing_table or self.config.inputs.get("missing_table_override")
        return self.config.resolve(override) if override else str(self.out(1) / MISSING)

    def missing(self) -> DataFrame:
        return tables.read_missing_targets(self.spark, self.missing_path)

    def carriers(self) -> DataFrame:
        """Carriers of the missing targets as step 07 or another tool left them."""
        own = self.out(7) / CARRIERS
        if own.exists():
            return self.spark.read.parquet(str(own))
        wild = [r["sample_id"] for r in self.samples_of("Wild").orderBy("ord").collect()]
        targets = materialize(caches.numbered_targets(self.missing()), "missing")
        return materialize(caches.read_carrier_cache(self.spark, str(self.out(7) / BITSETS), targets, wild), "target-carriers")

    def region_names(self, names: set[str]) -> dict[str, str]:
        """Names of regions in the configuration, with their uniform spelling."""
        rows = self.spark.createDataFrame([(n,) for n in sorted(names)], "name string")
        return {r["name"]: r["region"] for r in rows.select("name", canonical_region(F.col("name")).alias("region")).collect()}

    def metadata(self) -> DataFrame:
        return tables.read_metadata(self.spark, self.config.input("pihat_metadata", "metadata"))

    def wild(self) -> DataFrame:
        """``(sample_id, ord, region, Original_*)`` of the Wild list in its order."""
        listed, known = self.samples_of("Wild"), self.metadata()
        assert_empty(listed.join(known, "sample_id", "left_anti"), "Wild samples without metadata")
        return listed.join(known, "sample_id")

    def result(self, step: int, file: str) -> DataFrame:
        return tables.read_tsv(self.spark, str(self.out(step) / file))

    def plan_members(self) -> DataFrame:
        parts = [self.result(7, f).select(F.lit(p).alias("Plan"), F.col("Plan_step").cast("int").alias("Step"), "SampleID", "Region") for p, f in PLAN_FILES.items()]
        return parts[0].unionByName(parts[1])

    def quotas(self) -> DataFrame:
        q = tables.read_quotas(self.spark, self.config.quotas)
        plan = F.when(F.col("Plan").isin("Plan_A", "Plan_A_basic", "Greedy_Plan_A") | F.col("Plan").startswith("Plan_A"), "Greedy_Plan_A").when(F.col("Plan").startswith("Plan_B") | (F.col("Plan") == "Greedy_Plan_B"), "Greedy_Plan_B").otherwise(F.col("Plan"))
        return q.withColumn("Plan", plan)


def representation_step(s: Study) -> None:
    out, scanned = s.fresh(1), Counted()
    u = s.universe(scanned)
    write_tsv(representation.retention_overall(u), out / "01.wild_minor_allele_retention_overall.tsv", order=("Target_group",))
    write_tsv(representation.retention_by_maf(u), out / "02.wild_minor_allele_retention_by_MAF_bin.tsv", order=("Target_group", *BIN))
    write_tsv(representation.retention_by_threshold(u), out / "03.retention_AC_threshold_robustness.tsv", order=THRESHOLD)
    write_tsv(representation.retention_by_threshold(u, True), out / "04.retention_AC_threshold_by_MAF_bin.tsv", order=(*THRESHOLD, *BIN))
    missing, by_site = representation.missing_targets(u), representation.complementarity_by_site(u)
    write_sites(missing, out / MISSING)
    write_tsv(representation.complementarity_summary(by_site), out / "06.resource_garden_complementarity_summary.tsv", order=BIN)
    write_sites(by_site, out / "07.resource_garden_complementarity_by_site.tsv.gz")
    write_sites(missing.select("CHROM", "POS"), out / "08.ex_situ_missing_sites.tsv")
    lost = F.col("Ex_situ_minor_count") <= 0
    held = {g: F.count_if(F.col(f"{g}_minor_count") > 0) for g in representation.TARGET_GROUPS}
    r = u.agg(F.count("*").alias("n"), F.count_if(lost).alias("m"), F.count_if(F.col("Pingshun_minor_count") <= 0).alias("ps"), *[F.count_if(lost & (F.col("Wild_minor_count") >= k)).alias(f"m{k}") for k in (2, 3)], *[v.alias(k) for k, v in held.items()]).first()
    write_items(
        [("AC_AN_rows_scanned", scanned["rows"]), ("Wild_polymorphic_SNPs", r["n"]), ("Ex_situ_missing_Wild_minor_alleles", r["m"]), ("PS_RG_missing_Wild_minor_alleles", r["ps"]), ("Total_wild_SNP_minor_alleles", r["n"]), ("Combined_exsitu_retained", r["Ex_situ"]),
         ("Combined_exsitu_missing", r["m"]), *[(f"{g}_retained", r[g]) for g in representation.TARGET_GROUPS[1:]], ("AC_ge_2_missing", r["m2"]), ("AC_ge_3_missing", r["m3"])], out / "09.internal_check.tsv")


def regional_step(s: Study) -> None:
    out, missing = s.fresh(2), materialize(s.missing(), "missing")
    named = s.config.regional_acan, s.p["region_sample_counts"]
    same = s.region_names({k for names in named for k in names})
    files = {same[k]: v for k, v in named[0].items()}
    if len(files) != len(s.config.regional_acan):
        raise ValidationError("two regional tables have the same region")
    sizes = s.wild().groupBy(F.col("region").alias("Region")).agg(F.count("*").alias("Wild_sample_N"))
    assert_empty(set_mismatch(sizes, s.spark.createDataFrame([(r,) for r in files], "Region string"), "Region"), "regional tables and Wild regions differ")
    want = {same[k]: int(v) for k, v in named[1].items()}
    have = {r["Region"]: r["Wild_sample_N"] for r in sizes.collect()}
    if want and want != have:
        raise ValidationError(f"Wild samples per region are {have}, the configuration says {want}")
    regional = None
    for region, path in files.items():
        part = tables.read_acan(s.spark, path, region).withColumnRenamed("grp", "region")
        regional = part if regional is None else regional.unionByName(part)
    names = list(files)
    regions.check_regional(missing, regional, names)
    by_site = materialize(regions.occurrence_by_site(missing, regional, names), "occurrence")
    write_sites(by_site, out / "01.missing_allele_regional_occurrence_by_site.tsv.gz")
    write_tsv(regions.presence_histogram(by_site, len(names)), out / "02.region_presence_by_AC_threshold.tsv", order=(*THRESHOLD, "Presence_region_count"))
    write_tsv(regions.presence_histogram(by_site, len(names), True).select("AC_threshold", "Wild_minor_count_min", "Wild_MAF_bin", "Presence_region_count", "N_missing_Wild_minor_alleles"), out / "03.region_presence_by_AC_threshold_and_MAF.tsv", order=(*THRESHOLD, *BIN, "Presence_region_count"))
    write_tsv(regions.specific_gap(by_site, sizes), out / "04.region_specific_gap_normalized_by_AC_threshold.tsv", order=(*THRESHOLD, "Region"))
    regions.check_no_absent(by_site)
    r = by_site.agg(F.count("*").alias("n"), F.count_if(F.col("Presence_region_count") == 1).alias("one")).first()
    write_items([("Missing_targets_loaded", r["n"]), ("Wild_metadata_samples", sum(have.values())), ("Regions", len(names)), ("Targets_detected_in_zero_regions_all", 0), ("Region_specific_targets_all", r["one"]), *[(f"{k}_sample_N", v) for k, v in have.items()]], out / "05.internal_check.tsv")


def rarefaction_step(s: Study) -> None:
    out, u = s.fresh(3), s.universe()
    n = {g: s.samples_of(g).count() for g in ("Pingshun", "Tongguan", "Zhendong")}
    sets = rarefaction.target_sets(n["Tongguan"], n["Zhendong"], n["Pingshun"])
    values = materialize(rarefaction.retained_values(u, n["Pingshun"], n["Tongguan"], n["Zhendong"], s.p["ploidy"]), "rarefied")
    rank = ("Comparison_type", "Target_set")
    write_tsv(rarefaction.rarefied_retention(values, sets), out / "01.sample_size_standardized_retention_overall.tsv", order=rank)
    write_tsv(rarefaction.rarefied_retention(values, sets, "maf"), out / "02.sample_size_standardized_retention_by_MAF_bin.tsv", order=(*rank, *BIN))
    write_tsv(rarefaction.rarefied_retention(values, sets, "threshold"), out / "03.sample_size_standardized_retention_by_AC_threshold.tsv", order=(*THRESHOLD, *rank))
    write_items([("Wild_polymorphic_sites", u.count()), *[(f"{k}_sample_N", n[g]) for k, g in (("PS_RG", "Pingshun"), ("TG_RG", "Tongguan"), ("ZD_RG", "Zhendong"))]], out / "04.internal_check.tsv")


def _header(columns) -> list[str]:
    """Table headers have decimal points where column names have underscores."""
    out = []
    for c in columns:
        for level in ("0_50", "0_80", "0_90", "0_95", "0_01", "0_05", "0_10"):
            c = c.replace(level, level.replace("_", "."))
        out.append(c)
    return out


def callability_step(s: Study) -> None:
    out, scanned, met, missing = s.fresh(4), Counted(), Counted(), materialize(s.missing(), "missing")
    u = s.universe(scanned)
    assert_empty(callability.status_disagreements(u, missing), "allele counts and the missing table disagree")
    wild, n_coll = [r["sample_id"] for r in s.samples_of("Wild").orderBy("ord").collect()], s.samples_of("Ex_situ").count()
    rates = materialize(callability.site_call_rates(u, len(wild), n_coll, s.p["ploidy"]), "site-rates")
    table = callability.callability_summary(rates)
    order = ("Allele_status", *THRESHOLD, *BIN)
    write_tsv(table, out / "01.missing_vs_retained_site_callability_summary.tsv", _header(table.columns), tuple(order), True)
    write_tsv(table.where("Allele_status = 'Ex_situ_missing'"), out / "02.ex_situ_missing_site_callability_summary.tsv", _header(table.columns), order, True)
    path = s.config.input("missing_site_vcf")
    names = vcf.read_header(s.spark, path)
    records = vcf.read_records(s.spark, path, names, samples=wild)
    goal = missing.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"))
    assert_empty(goal.join(records, ["chrom", "pos"], "left_anti"), "the VCF lacks missing targets")
    has = lambda field: F.count_if(F.array_contains(F.split("format", ":"), field))
    rows = met.of(records.join(goal, ["chrom", "pos"], "left_semi"), rows=F.count(F.lit(1)), dp=has("DP"), gq=has("GQ"))
    carriers = materialize(callability.carrier_calls(vcf.calls(rows, wild, wild), missing), "carriers")
    if s.p["strict_carrier_DP_GQ"]:
        callability.check_carriers(carriers)
    write_tsv(callability.carrier_quality(carriers), out / "03.Wild_carrier_DP_GQ_summary.tsv", order=(*THRESHOLD, *BIN), all_last=True)
    write_sites(rates.where("Allele_status = 'Ex_situ_missing'").drop("Allele_status"), out / "04.ex_situ_missing_site_callability_by_site.tsv.gz")
    r = carriers.agg(F.count("*").alias("n"), F.count("dp").alias("dp"), F.count("gq").alias("gq")).first()
    write_items([("Wild_sample_N", len(wild)), ("Ex_situ_sample_N", n_coll), ("ACAN_rows_scanned", scanned["rows"]), ("Missing_targets_loaded", loaded := missing.count()), ("Missing_targets_matched_in_VCF", loaded), ("VCF_target_rows", met["rows"]), ("VCF_target_rows_with_DP", met["dp"]), ("VCF_target_rows_with_GQ", met["gq"]), ("Wild_carrier_genotypes_all", r["n"]), ("Wild_carrier_genotypes_with_DP_all", r["dp"]), ("Wild_carrier_genotypes_with_GQ_all", r["gq"]), ("Strict_carrier_DP_GQ_validation", s.p["strict_carrier_DP_GQ"])], out / "05.internal_check.tsv")


def relatedness_step(s: Study) -> None:
    out, samples = s.fresh(5), materialize(s.metadata(), "metadata")
    groups = relatedness.memberships(samples)
    for g in representation.GROUPS:
        assert_empty(set_mismatch(groups.where(F.col("group") == g), s.samples_of(g), "sample_id"), f"metadata and sample list differ for {g}")
    op = s.p["operational_pihat"]
    levels = relatedness.all_thresholds(s.p["pihat_thresholds"], op)
    pairs = materialize(relatedness.check_pairs(tables.read_pairs(s.spark, s.config.input("pairwise_pihat", "pihat_pairwise")), samples), "pairs")
    solved = relatedness.solved(samples, pairs, levels)
    down = ("minus",)
    ordered = lambda df: df.withColumn("minus", -F.col("PI_HAT_min")).orderBy("minus").drop(*down)
    write_tsv(ordered(relatedness.global_summary(solved, pairs, levels)), out / "01.PIHAT_global_threshold_summary.tsv")
    write_tsv(relatedness.group_summary(solved, samples, levels), out / "02.PIHAT_group_threshold_summary.tsv", order=("PI_HAT_min", "Group", "Graph_scope"))
    write_tsv(relatedness.component_summary(solved, samples, levels), out / "03.global_component_summary.tsv", order=("PI_HAT_min", "Component_ID"))
    status = relatedness.sample_status(solved, samples, levels)
    write_tsv(status, out / "04.global_sample_component_status.tsv", order=("PI_HAT_min", "SampleID"))
    coll = materialize(relatedness.collection_status(solved, samples, op), "collection-status")
    core, low = relatedness.core(coll), relatedness.lower_priority(coll)
    for df, name in ((coll, "05.operational_exsitu_component_status.tsv"), (core, "06.deredundant_exsitu_core.tsv"), (low, "07.lower_priority_redundant_exsitu.tsv")):
        write_tsv(df, out / name, order=("SampleID",))
    write_tsv(status.where(F.abs(F.col("PI_HAT_min") - op) < 1e-12), out / "08.operational_global_sample_status.tsv", order=("SampleID",))
    size = {r["group"]: r["count"] for r in groups.groupBy("group").count().collect()}
    per = {(r["Is_representative"], r["Ex_situ_site"]): r["count"] for r in coll.groupBy("Is_representative", "Ex_situ_site").count().collect()}
    count = lambda keep, g=None: sum(v for (k, x), v in per.items() if k == keep and g in (None, x))
    gardens = representation.GROUPS[2:]
    write_items([("Pairwise_rows_loaded", pairs.count()), ("Configured_sample_lists_match_metadata", True), ("Operational_threshold", op), ("Operational_exsitu_component_N", count(True)), ("Total_samples", size["All"]), ("Wild_samples", size["Wild"]), ("Ex_situ_samples", size["Ex_situ"]), ("Exsitu_core_size", count(True)), ("Exsitu_low_priority_size", count(False)), *[(f"{g}_core_size", count(True, g)) for g in gardens], *[(f"{g}_lower_priority_size", count(False, g)) for g in gardens]], out / "09.internal_check.tsv")


def alt_step(s: Study) -> None:
    out = s.fresh(6)
    read = lambda f, keep: s.result(5, f).select(F.col("SampleID").alias("sample_id"), F.lit(keep).alias("in_core"), F.col("Ex_situ_site").alias("garden"))
    classes = materialize(read("06.deredundant_exsitu_core.tsv", True).unionByName(read("07.lower_priority_redundant_exsitu.tsv", False)), "classes")
    current = s.samples_of("Ex_situ")
    assert_empty(set_mismatch(classes, current, "sample_id"), "core and lower-priority samples are not the collection")
    path = s.config.input("pass_snp_vcf", "full_snp_vcf", "full_filtered_biallelic_snp_vcf")
    names = vcf.read_header(s.spark, path)
    ids = [r["sample_id"] for r in current.orderBy("ord").collect()]
    met = Counted()
    records = met.of(vcf.read_records(s.spark, path, names, samples=ids), rows=F.count(F.lit(1)), alts=F.sum(F.size(F.split("alt", ","))))
    (out / "00.current_ex_situ.samples.txt").write_text("".join(f"{i}\n" for i in ids))
    known = [tuple(r) for r in classes.select("sample_id", "in_core", "garden").collect()]  # the collection
    states = materialize(altstates.state_counts_in_record(records, ids, known, s.p["allow_partial"]), "alt-states")
    altstates.check_partition(states)
    lost = altstates.lost_states(states)
    write_tsv(altstates.coverage_summary(states), out / "01.deredundancy_ALT_coverage_summary.tsv", order=("Current_ALT_freq_bin",))
    write_tsv(altstates.lost_sources(lost), out / "02.lost_ALT_source_summary.tsv", order=("Loss_source_gardens", "Current_ALT_freq_bin"))
    write_sites(lost, out / "03.lost_ALT_states_after_deredundancy.tsv.gz")
    r = altstates.coverage_summary(states).where("Current_ALT_freq_bin = 'All'").first()
    write_items([("VCF_sites_processed", met["rows"]), ("Total_ALT_records", met["alts"]), ("Current_ex_situ_sample_N", len(ids)), ("Core_sample_N", classes.where("in_core").count()), ("SNP_observed_ALT_states", r[1]), ("SNP_retained_ALT_states", r[2]), ("SNP_state_denominator", r[1]), ("SNP_state_numerator", r[2]), ("SNP_state_retention_rate", r[4]), ("True_copy_weight_denominator", r[5]), ("True_copy_weight_numerator", r[6]), ("True_copy_weighted_coverage_rate", r[8]), ("Partial_genotypes_allowed_for_called_allele_counting", s.p["allow_partial"])], out / "04.internal_check.tsv")


def selection_step(s: Study) -> None:
    out, missing, wild = s.fresh(7), materialize(caches.numbered_targets(s.missing()), "missing"), materialize(s.wild(), "wild")
    path = s.config.input("missing_site_vcf")
    names = vcf.read_header(s.spark, path)
    ids = [r["sample_id"] for r in wild.orderBy("ord").collect()]
    records = vcf.read_records(s.spark, path, names, exact=False, samples=ids)
    goal = missing.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"))
    assert_empty(goal.join(records, ["chrom", "pos"], "left_anti"), "the VCF lacks missing targets")
    assert_empty(records.join(goal, ["chrom", "pos"], "left_semi").groupBy("chrom", "pos").count().where("count > 1"), "the VCF repeats a target")
    per = materialize(selection.carriers_in_record(records, ids, ids, missing), "target-carriers")
    rates = selection.call_rates(per, wild)
    write_tsv(rates.orderBy("ord").drop("ord"), out / "00.Wild_target_site_call_rate.tsv")
    quotas = s.quotas()
    quota = {p: {r["Region"]: r["Quota"] for r in quotas.where(F.col("Plan") == p).orderBy("rng_order").collect()} for p in selection.PLANS}
    plans = selection.select_plans(per, wild, quota[selection.PLANS[0]], quota[selection.PLANS[1]], s.p["greedy_weights"])
    place = wild.select(F.col("sample_id").alias("SampleID"), "Original_province", "Original_city", "Original_county")
    for plan, file in PLAN_FILES.items():
        df = selection.plan_frame(s.spark, plans[plan]).join(place, "SampleID")
        df = df.select("Selection_stage", "Plan_step", "SampleID", "Region", "Original_province", "Original_city", "Original_county", *[c for c in df.columns if c not in ("Selection_stage", "Plan_step", "SampleID", "Region") and not c.startswith("Original_")])
        write_tsv(df, out / file, _header(df.columns), ("Plan_step",))
    members = selection.members(plans, s.spark)
    rec = materialize(selection.recovery(per, members), "recovery")
    write_tsv(rec, out / "03.Greedy_plan_recovery_by_AC_threshold_and_MAF.tsv", order=("Plan", *THRESHOLD, *BIN))
    write_tsv(rec.where("AC_threshold = 'all'"), out / "04.Greedy_plan_recovery_overall_and_MAF.tsv", order=("Plan", *BIN))
    write_tsv(selection.cumulative_recovery(per, members), out / "05.Greedy_cumulative_recovery.tsv", order=("Plan", "Step", *BIN))
    write_tsv(selection.region_composition(members, quotas.where(F.col("Plan").isin(*selection.PLANS)).select("Plan", "Region", "Quota")), out / "06.Greedy_plan_region_composition.tsv", order=("Plan", "Region"))
    per.write.parquet(str(out / CARRIERS))
    if caches.document_size(len(ids), missing.count()) <= caches.LIMIT:
        caches.write_carrier_cache(per, missing, wild, s.missing_path, str(out / BITSETS))
    got = {(r["Plan"], r["AC_threshold"], r["Wild_MAF_bin"]): r["Recovered_missing_Wild_minor_alleles"] for r in rec.collect()}
    a, b = (plans[p] for p in selection.PLANS)
    nested = {x.sample for x in a} <= {x.sample for x in b}
    write_items([("Missing_target_N", missing.count()), ("Wild_sample_N", len(ids)), ("Plan_A_is_subset_of_Plan_B", nested), ("Greedy_Plan_A_size", len(a)), ("Greedy_Plan_B_size", len(b)), *[(f"Plan_{p[-1]}_quota_total", sum(quota[p].values())) for p in selection.PLANS], *[(f"{p}_recovered_all", got[p, "all", "All"]) for p in selection.PLANS], ("Greedy_Plan_A_recovered_AC_ge_2", got["Greedy_Plan_A", "AC_ge_2", "All"]), ("Greedy_Plan_A_recovered_AC_ge_3", got["Greedy_Plan_A", "AC_ge_3", "All"])], out / "08.internal_check.tsv")


def control_step(s: Study) -> None:
    out = s.fresh(8)
    per, wild, quotas = s.carriers(), s.wild(), s.quotas().where(F.col("Plan").isin(*selection.PLANS))
    rows = [(r["sample_id"], r["region"]) for r in wild.orderBy("ord").collect()]
    pools: dict[str, list[str]] = {}
    for sample, region in rows:
        pools.setdefault(region, []).append(sample)
    members = s.plan_members()
    assert_empty(selection.region_composition(members, quotas.select("Plan", "Region", "Quota")).where("not Quota_match"), "plans do not match their quotas")
    plans = {p: {r["Region"]: r["Quota"] for r in quotas.where(F.col("Plan") == p).orderBy("rng_order").collect()} for p in selection.PLANS}
    draws = control.replayed_draws([x for x, _ in rows], pools, plans, s.p["n_permutations"], s.p["seed"], s.p["burn"])
    dist = materialize(control.distribution(per, control.draws_frame(s.spark, draws)), "distribution")
    seen = selection.recovery(per, members).where("AC_threshold = 'all'")
    summary = materialize(control.summary(dist, seen), "random-summary")
    write_tsv(dist, out / "01.region_matched_random_recovery_distribution.tsv", order=("Plan", "Permutation", *BIN))
    write_tsv(summary, out / "02.Greedy_vs_region_matched_random_summary.tsv", order=("Plan", *BIN))
    write_tsv(control.sampling_order(quotas, wild), out / "03.region_sampling_order_and_quotas.tsv", order=("Plan", "Region_sampling_order"))
    expected = [(p, b, float(v)) for p, bins in s.p["expected_random_gain_pp"].items() for b, v in bins.items()]
    if expected:
        check = control.gain_validation(summary, s.spark.createDataFrame(expected, "Plan string, Wild_MAF_bin string, Expected_gain_pp double"), s.p["random_gain_tolerance_pp"])
        write_tsv(check, out / "04.manuscript_random_gain_validation.tsv", order=("Plan", *BIN))
        if s.p["validate_known_results"]:
            assert_empty(check.where("Status = 'FAIL'"), "random gains differ from the expected ones")
    size = {r["Plan"]: r["count"] for r in members.groupBy("Plan").count().collect()}
    write_items([("Random_seed", s.p["seed"]), ("Random_permutations", s.p["n_permutations"]), ("Legacy_all_wild_burn_enabled", s.p["burn"]), ("Python_version", sys.version.split()[0]), ("Wild_sample_N", len(rows)), ("Plan_A_sample_N", size["Greedy_Plan_A"]), ("Plan_B_sample_N", size["Greedy_Plan_B"]), ("Distribution_rows", dist.count()), ("Summary_rows", summary.count())], out / "05.internal_check.tsv")


def qc_step(s: Study) -> None:
    out, members = s.fresh(9), s.plan_members()
    rates = s.result(7, "00.Wild_target_site_call_rate.tsv").select("SampleID", F.col("Target_site_call_rate").cast("double").alias("Target_site_call_rate"))
    status = s.result(5, "08.operational_global_sample_status.tsv").withColumns({"PI_HAT_min": F.col("PI_HAT_min").cast("double"), "Global_component_size": F.col("Global_component_size").cast("long")})
    roh = tables.read_tsv(s.spark, s.config.input("roh_sample_summary", "roh_summary"), "SampleID").where("trim(SampleID) <> ''")
    low = s.p["low_call_rate"]
    rows = materialize(qc.selected_samples(members, rates, status, roh, low, s.p["operational_pihat"]), "qc")
    label = f"PIHAT_ge_{s.p['operational_pihat']:.2f}"
    shown = rows.drop("Step")
    write_tsv(rows.orderBy("Plan", "Step").drop("Step"), out / "01.selected_Wild_accession_QC.tsv", [f"{c}_{label}" if c.startswith("Global_") else c for c in shown.columns])
    plan = materialize(qc.by_plan(rows, low), "qc-by-plan")
    write_tsv(plan, out / "02.selected_Wild_QC_summary_by_plan.tsv", order=("Plan",))
    write_tsv(qc.repeated_components(rows), out / "03.repeated_PIHAT_component_check.tsv", order=("Plan", "Global_component_ID"))
    got = {r["Plan"]: r for r in plan.collect()}
    long, twice = (sum(r[c] for r in got.values()) for c in ("Selected_with_ROH_gt_2Mb_N", "Repeated_PIHAT_component_N"))
    x, b = F.col("Target_site_call_rate"), got[selection.PLANS[1]]
    wild = rates.agg(F.count("*").alias("N"), F.min(x).alias("min"), F.percentile(x, F.lit(0.5)).alias("median"), F.max(x).alias("max")).first().asDict()
    write_items([*[(f"All_Wild_call_rate_{k}", v) for k, v in wild.items()], *[(f"Plan_{p[-1]}_sample_N", r["Selected_sample_N"]) for p, r in sorted(got.items())], ("Selected_with_ROH_gt_2Mb_across_plan_checks", long), ("Repeated_PIHAT_components_across_plan_checks", twice), ("Plan_B_selected_with_ROH_gt_2Mb", b["Selected_with_ROH_gt_2Mb_N"]), ("Plan_B_repeated_PIHAT_components", b["Repeated_PIHAT_component_N"]), ("Plan_A_is_subset_of_Plan_B", True)], out / "04.internal_check.tsv")
    if s.p["validate_known_results"] and (long or twice):
        raise ValidationError("selected samples have long runs of homozygosity or share a component")


def portfolio_step(s: Study) -> None:
    out = s.fresh(10)
    wild, coll = s.samples_of("Wild"), s.samples_of("Ex_situ")
    core = s.result(5, "06.deredundant_exsitu_core.tsv").select(F.col("SampleID").alias("sample_id"))
    plan = {p: s.plan_members().where(F.col("Plan") == p).select(F.col("SampleID").alias("sample_id")) for p in selection.PLANS}
    a, b = plan.values()
    portfolios.check_members(wild, coll, core, a, b)
    path = s.config.input("diversity_snp_vcf")
    names = vcf.read_header(s.spark, path)
    members = portfolios.portfolio_members(coll, core, a, b)
    in_them, of_wild = [tuple(r) for r in members.select("portfolio", "sample_id").collect()], [r["sample_id"] for r in wild.collect()]  # the cohort
    wanted = list(dict.fromkeys([*of_wild, *(x for _, x in in_them)]))
    records = vcf.read_records(s.spark, path, names, samples=wanted)
    vcf.check_biallelic_sorted(records)
    counted = materialize(portfolios.counters(portfolios.presence_in_record(records, wanted, of_wild, in_them)), "counters")
    portfolios.check_counters(counted)
    write_tsv(portfolios.portfolio_table(counted, members), out / "01.final_portfolios.tsv", order=("Portfolio",))
    write_counters(counted, out / "02.loss_and_rescue.json")
    expected = [(k, int(v)) for k, v in (s.config.raw.get("expected_portfolios") or {}).items()]
    if expected:
        checks = materialize(portfolios.anchors(counted, expected), "anchors")
        write_tsv(checks, out / "03.anchor_validation.tsv", order=("Metric",))
        assert_empty(checks.where("Status <> 'PASS'"), "portfolio anchors differ")


def observed_metrics(s: Study) -> dict[str, float]:
    """The numbers that anchors and invariants speak about, read back from the written tables."""
    kv = {i: tables.read_key_values(s.spark, str(s.out(i) / f)) for i, f in ((1, "09.internal_check.tsv"), (5, "09.internal_check.tsv"), (6, "04.internal_check.tsv"), (7, "08.internal_check.tsv"), (8, "05.internal_check.tsv"))}
    one = lambda step, file, **where: next(r.asDict() for r in s.result(step, file).collect() if all(r[k] == v for k, v in where.items()))
    i = lambda step, k: int(float(kv[step][k]))
    carrier = one(4, "03.Wild_carrier_DP_GQ_summary.tsv", AC_threshold="all", Wild_MAF_bin="All")
    alt = one(6, "01.deredundancy_ALT_coverage_summary.tsv", Current_ALT_freq_bin="All")
    qcb = one(9, "02.selected_Wild_QC_summary_by_plan.tsv", Plan="Greedy_Plan_B")
    gain = {(r["Plan"], r["Wild_MAF_bin"]): round(float(r["Greedy_minus_random_q975_percentage_points"]), 2) for r in s.result(8, "02.Greedy_vs_region_matched_random_summary.tsv").collect()}
    size = {g: s.samples_of(g).count() for g in representation.GROUPS}
    a, b = (s.result(7, f).select("SampleID").distinct().count() for f in PLAN_FILES.values())
    m: dict[str, float] = {"total_samples": i(5, "Total_samples"), "wild_sample_n": size["Wild"], "ex_situ_total": size["Ex_situ"], **{f"{g.lower()}_sample_n": size[g] for g in representation.GROUPS[2:]}}
    m |= {"wild_minor_total": i(1, "Total_wild_SNP_minor_alleles"), "combined_ex_situ_retained": i(1, "Combined_exsitu_retained"), "combined_ex_situ_missing": i(1, "Combined_exsitu_missing")}
    m["combined_ex_situ_retention_rate"] = m["combined_ex_situ_retained"] / m["wild_minor_total"]
    m |= {f"{g.lower()}_retained": i(1, f"{g}_retained") for g in representation.GROUPS[2:]} | {"missing_ac_ge_2": i(1, "AC_ge_2_missing"), "missing_ac_ge_3": i(1, "AC_ge_3_missing")}
    number = lambda x: float("nan") if x in ("", "NA") else float(x)
    m |= {"wild_carrier_genotype_n": int(carrier["Carrier_genotype_N"]), "wild_carrier_dp_median": number(carrier["DP_Median"]), "wild_carrier_gq_median": number(carrier["GQ_Median"])}
    m |= {"de_redundant_core_n": i(5, "Exsitu_core_size"), "lower_priority_redundant_n": i(5, "Exsitu_low_priority_size"), **{f"{g.lower()}_core_n": i(5, f"{g}_core_size") for g in representation.GROUPS[2:]}}
    den, num = i(6, "SNP_state_denominator"), i(6, "SNP_state_numerator")
    m |= {"reported_alt_states_total": den, "reported_alt_states_retained": num, "reported_alt_states_lost": den - num, "reported_alt_state_retention_rate": num / den if den else float("nan"), "alt_coverage_vcf_site_n": i(6, "VCF_sites_processed")}
    m |= {"true_alt_copy_total": int(alt["Current_ex_situ_ALT_copies"]), "true_alt_copy_covered": int(alt["Current_ALT_copies_covered_by_core_presence"]), "true_alt_copy_uncovered": int(alt["Current_ALT_copies_not_covered_by_core_presence"]), "true_alt_copy_weighted_coverage_rate": float(alt["True_ALT_copy_weighted_coverage_rate"])}
    m |= {"random_seed": i(8, "Random_seed"), "random_permutations": i(8, "Random_permutations")}
    for p, short, bins in (("Greedy_Plan_A", "plan_a", {"all": "All", "very_rare": "MAF_le_0.01", "low_frequency": "0.01_lt_MAF_le_0.05"}), ("Greedy_Plan_B", "plan_b", {"all": "All", "very_rare": "MAF_le_0.01"})):
        m |= {f"{short}_random_gain_{k}_pp_rounded2": gain[p, v] for k, v in bins.items()}
    m |= {"plan_a_wild_n": a, "priority_2_wild_n": b - a, "plan_b_wild_n": b, "plan_a_recovered": i(7, "Greedy_Plan_A_recovered_all"), "plan_b_recovered": i(7, "Greedy_Plan_B_recovered_all")}
    lost = m["combined_ex_situ_missing"]
    m |= {f"plan_{p}_recovery_rate": m[f"plan_{p}_recovered"] / lost if lost else float("nan") for p in "ab"}
    return m | {"selected_qc_roh_gt2mb_n": int(qcb["Selected_with_ROH_gt_2Mb_N"]), "selected_qc_duplicate_component_n": int(qcb["Repeated_PIHAT_component_N"])}


def validation_step(s: Study) -> None:
    out = s.config.output / NAMES[10]
    out.mkdir(parents=True, exist_ok=True)
    m = observed_metrics(s)
    rec = {(r["Plan"]): int(r["Recovered_missing_Wild_minor_alleles"]) for r in s.result(7, "04.Greedy_plan_recovery_overall_and_MAF.tsv").collect() if r["Wild_MAF_bin"] == "All"}
    rare = {r["Target_set"]: float(r["Retained_Wild_SNP_minor_alleles"]) for r in s.result(3, "01.sample_size_standardized_retention_overall.tsv").collect()}
    port = {r["Portfolio"]: r for r in s.result(10, "01.final_portfolios.tsv").collect()}
    still = next(int(r["Still_missing_from_all_ex_situ"]) for r in s.result(1, "06.resource_garden_complementarity_summary.tsv").collect() if r["Wild_MAF_bin"] == "All")
    regional = sum(int(r["N_missing_Wild_minor_alleles"]) for r in s.result(2, "02.region_presence_by_AC_threshold.tsv").collect() if r["AC_threshold"] == "all")
    members = s.plan_members()
    only_a = members.where("Plan = 'Greedy_Plan_A'").join(members.where("Plan = 'Greedy_Plan_B'"), "SampleID", "left_anti").count()
    both = s.result(5, "06.deredundant_exsitu_core.tsv").join(s.result(5, "07.lower_priority_redundant_exsitu.tsv"), "SampleID").count()
    more = {"rec_a": rec["Greedy_Plan_A"], "rec_b": rec["Greedy_Plan_B"], **{f"rare_{g.lower()}": rare[f"{k}_RG_observed"] for k, g in (("PS", "Pingshun"), ("TG", "Tongguan"), ("ZD", "Zhendong"))}, "direct_total": int(port["Current"]["Target_total"]), "direct_missing": int(port["Current"]["Missing"]), "direct_core": int(port["Core"]["Sample_N"]), "still": still, "regional": regional, "only_a": only_a, "core_and_low": both}
    more |= {"distribution_rows": int(tables.read_key_values(s.spark, str(s.out(8) / "05.internal_check.tsv"))["Distribution_rows"]), "qc_b": next(int(r["Selected_sample_N"]) for r in s.result(9, "02.selected_Wild_QC_summary_by_plan.tsv").collect() if r["Plan"] == "Greedy_Plan_B")}
    row = s.spark.createDataFrame([tuple(float(v) for v in (m | more).values())], ", ".join(f"`{k}` double" for k in m | more))
    rules = {
        "wild_retained_plus_missing_equals_total": ("combined_ex_situ_retained + combined_ex_situ_missing = wild_minor_total", ("combined_ex_situ_retained", "combined_ex_situ_missing", "wild_minor_total")),
        "core_and_low_partition_current_ex_situ": ("core_and_low = 0 and de_redundant_core_n + lower_priority_redundant_n = ex_situ_total", ("core_and_low", "de_redundant_core_n", "lower_priority_redundant_n", "ex_situ_total")),
        "plan_A_is_subset_of_plan_B": ("only_a = 0", ("only_a",)),
        "ALT_state_arithmetic": ("reported_alt_states_retained + reported_alt_states_lost = reported_alt_states_total", ("reported_alt_states_retained", "reported_alt_states_lost", "reported_alt_states_total")),
        "complementarity_still_missing_equals_combined_exsitu_missing": ("still = combined_ex_situ_missing", ("still", "combined_ex_situ_missing")),
        "regional_occurrence_partitions_missing_targets": ("regional = combined_ex_situ_missing", ("regional", "combined_ex_situ_missing")),
        **{f"rarefaction_observed_matches_allele_representation_{g}": (f"abs(rare_{g.lower()} - {g.lower()}_retained) < 1e-8", (f"rare_{g.lower()}", f"{g.lower()}_retained")) for g in representation.GROUPS[2:]},
        "true_ALT_copy_weighted_arithmetic": ("true_alt_copy_covered + true_alt_copy_uncovered = true_alt_copy_total", ("true_alt_copy_covered", "true_alt_copy_uncovered", "true_alt_copy_total")),
        "greedy_full_target_recovery_matches_internal_counts": ("rec_a = plan_a_recovered and rec_b = plan_b_recovered", ("rec_a", "plan_a_recovered", "rec_b", "plan_b_recovered")),
        "random_distribution_row_count": ("distribution_rows = random_permutations * 2 * 5", ("distribution_rows", "random_permutations")),
        "selected_QC_no_missing_join_silent_fallback": ("plan_b_wild_n = qc_b", ("plan_b_wild_n", "qc_b")),
        "direct_current_matches_ACAN_baseline": ("direct_total = wild_minor_total and direct_missing = combined_ex_situ_missing", ("direct_total", "wild_minor_total", "direct_missing", "combined_ex_situ_missing")),
        "direct_core_size_matches_components": ("direct_core = de_redundant_core_n", ("direct_core", "de_redundant_core_n")),
    }
    held = materialize(validation.invariants(row, rules), "invariants")
    expected = [(k, float(v)) for k, v in (s.config.raw.get("expected_results") or {}).items()]
    seen = s.spark.createDataFrame([(k, float(v)) for k, v in m.items()], "Item string, Observed double")
    anchors = materialize(validation.anchor_checks(seen, s.spark.createDataFrame(expected, "Item string, Expected double")), "anchors")
    write_tsv(anchors, out / "01.manuscript_anchor_validation.tsv", order=("Item",))
    write_tsv(held, out / "02.cross_step_invariants.tsv")
    write_items(list(m.items()), out / "03.observed_key_results.tsv")
    assert_empty(validation.failures(anchors, held), "results do not validate", 20)


STEPS: dict[str, Callable[[Study], None]] = dict(zip(NAMES, (representation_step, regional_step, rarefaction_step, callability_step, relatedness_step, alt_step, selection_step, control_step, qc_step, portfolio_step, validation_step)))


def run(spark: SparkSession, config: Config, steps: list[str] | None = None, missing_table: str | None = None) -> None:
    """Run the named steps (numbers or names), or all, in order; the first error ends the run."""
    study = Study(spark, config, missing_table)
    for name, step in STEPS.items():
        if not steps or any(name == x or name.split("_")[0] == x.zfill(2) for x in steps):
            with watched(spark, name):
                step(study)
