"""Wild samples that add the most missing alleles under regional quotas."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions import alleles as A
from verdance.functions import genotypes as G
from verdance.operators import inrecord
from verdance.operators.checks import ValidationError
from verdance.storage import materialize

PLANS = ("Greedy_Plan_A", "Greedy_Plan_B")


def carriers_and_calls(calls: DataFrame, missing: DataFrame) -> DataFrame:
    """Per missing target the samples that carry it and those called, by complete diploid calls.

    ``(CHROM, POS, Wild_minor_count, Wild_MAF_bin, carriers, called)``: one row
    per target with arrays that the cohort bounds; every later question is a
    filter over these rows, whatever the number of picks.
    """
    goal = missing.select(F.col("CHROM").alias("chrom"), F.col("POS").alias("pos"), "Wild_minor_allele", "Wild_minor_count", "Wild_MAF_bin")
    read = goal.join(calls.select("chrom", "pos", "sample_id", "gt"), ["chrom", "pos"], "left").withColumn("codes", G.strict_diploid_alleles(F.col("gt")))
    carries = G.dosage(F.col("codes"), G.target_code(F.col("Wild_minor_allele"))) > 0
    return read.groupBy(F.col("chrom").alias("CHROM"), F.col("pos").alias("POS"), "Wild_minor_count", "Wild_MAF_bin").agg(
        F.array_sort(F.collect_set(F.when(carries, F.col("sample_id")))).alias("carriers"), F.array_sort(F.collect_set(F.when(F.col("codes").isNotNull(), F.col("sample_id")))).alias("called")
    )


def carriers_in_record(records: DataFrame, names: Sequence[str], samples: Sequence[str], missing: DataFrame) -> DataFrame:
    """What :func:`carriers_and_calls` gives, from records ``(chrom, pos, format, cells)`` of the samples ``names``; only records of targets are read."""
    return inrecord.carriers_and_called(inrecord.target_sites(records, missing), names, samples)


def call_rates(per_target: DataFrame, wild: DataFrame) -> DataFrame:
    """Called targets of each Wild sample ``(sample_id, region, ord)``; the denominator is all targets."""
    total = per_target.agg(F.count("*").alias("Total_target_sites"))
    got = per_target.select(F.explode("called").alias("sample_id")).groupBy("sample_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return wild.join(got, "sample_id", "left").crossJoin(F.broadcast(total)).select(
        F.col("sample_id").alias("SampleID"), F.col("region").alias("Region"), n.alias("Called_target_sites"), "Total_target_sites", A.rate_or_zero(n, F.col("Total_target_sites")).alias("Target_site_call_rate"), "ord"
    )


@dataclass
class Pick:
    sample: str
    region: str
    step: int
    region_n: int
    quota: int
    score: float
    gains: dict[str, int]
    call_rate: float
    order: int
    stage: str


def gains_of(per_target: DataFrame, selected: Sequence[str]) -> dict[str, Counter]:
    """Per sample the targets it would add to ``selected``, by bin: at most samples times four numbers come back."""
    left = per_target
    if selected:
        left = left.where(~F.arrays_overlap("carriers", F.array(*[F.lit(s) for s in selected])))
    out: dict[str, Counter] = {}
    for r in left.select("Wild_MAF_bin", F.explode("carriers").alias("s")).groupBy("s", "Wild_MAF_bin").count().collect():
        out.setdefault(r["s"], Counter())[r["Wild_MAF_bin"]] = r["count"]
    return out


def overlaps_of(per_target: DataFrame, selected: Sequence[str], leaders: Sequence[str]) -> dict[tuple[int, str], int]:
    """Targets that ``selected`` leaves, counted by which of a few ``leaders`` carry them (a bit mask) and by bin: at most ``2 ** len(leaders)`` times four numbers."""
    left = per_target
    if selected:
        left = left.where(~F.arrays_overlap("carriers", F.array(*[F.lit(s) for s in selected])))
    bits = [F.when(F.array_contains("carriers", s), F.lit(1 << i)).otherwise(F.lit(0)) for i, s in enumerate(leaders)]
    mask = sum(bits[1:], bits[0])
    rows = left.groupBy(mask.alias("mask"), "Wild_MAF_bin").agg(F.count("*").alias("n")).where("mask > 0").collect()
    return {(r["mask"], r["Wild_MAF_bin"]): r["n"] for r in rows}


#: Candidates whose overlaps are counted together.
LEADERS = 12


def greedy(per_target: DataFrame, wild: Sequence[tuple[str, str, float]], quota: Mapping[str, int], weights: Mapping[str, float], start: Sequence[Pick] = (), stage: str = PLANS[0]) -> list[Pick]:
    """Picks until every region's quota is full.

    ``wild`` lists ``(sample, region, call rate)`` in the order that breaks the
    last ties.  Each step takes the candidate of an open region with the
    largest weighted gain, then the largest total gain, then the largest call
    rate; quotas are filled even when nothing is gained.

    Targets stay distributed, and picks are lazy: gains only fall as targets
    are covered, so a pass over the targets bounds them for all later steps.  A
    round counts all gains, and the overlaps of the ``LEADERS`` best
    candidates; from these the leaders' gains are known after any of them was
    picked.  The best leader is picked as long as no other candidate's bound
    beats it, ties included; then the next round begins.  Two passes a round,
    of which each picks at least one, usually many.  Negative weights let a
    score rise as gains fall, so then a round picks one.
    """
    absent = [b for b in A.MAF_BINS[:3] if b not in weights]
    if absent:
        raise ValidationError(f"no weight for {absent}")
    lazy = all(w >= 0 for w in weights.values())
    picks = list(start)
    chosen = {p.sample for p in picks}
    filled = Counter(p.region for p in picks)
    new: list[Pick] = []
    place = {sample: (order, region, rate) for order, (sample, region, rate) in enumerate(wild)}

    def key(sample: str, gains: Counter) -> tuple[float, int, float, int]:
        order, _, rate = place[sample]
        return sum(weights.get(b, 0.0) * gains[b] for b in A.MAF_BINS), gains.total(), rate, -order

    def open_(sample: str) -> bool:
        region = place[sample][1]
        return sample not in chosen and filled[region] < quota.get(region, 0)

    while any(filled[r] < n for r, n in quota.items()):
        bound = gains_of(per_target, [p.sample for p in picks])
        ranked = sorted(filter(open_, place), key=lambda s: key(s, bound.get(s, Counter())), reverse=True)
        if not ranked:
            raise ValidationError(f"no candidate is left for {stage}")
        leaders = ranked[:LEADERS] if lazy else ranked[:1]
        rest = ranked[len(leaders) :]
        overlaps = overlaps_of(per_target, [p.sample for p in picks], leaders) if len(leaders) > 1 else {}
        exact = {s: bound.get(s, Counter()) for s in leaders}
        covered = 0
        while True:
            options = [s for s in leaders if open_(s)]
            if not options:
                break
            best = max(options, key=lambda s: key(s, exact[s]))
            others = next((s for s in rest if open_(s)), None)  # the rest is ranked by its bounds
            if others is not None and key(others, bound.get(others, Counter())) > key(best, exact[best]):
                break
            order, region, rate = place[best]
            filled[region] += 1
            chosen.add(best)
            own = exact[best]
            new.append(Pick(best, region, len(picks) + 1, filled[region], quota[region], key(best, own)[0], {b: own[b] for b in A.MAF_BINS}, rate, 1 + order, stage))
            picks.append(new[-1])
            if not lazy or len(leaders) == 1:
                break
            covered |= 1 << leaders.index(best)
            exact = {s: Counter() for s in leaders}
            for (mask, bin_), n in overlaps.items():
                if not mask & covered:
                    for i, s in enumerate(leaders):
                        if mask >> i & 1:
                            exact[s][bin_] += n
    return new


def check_quotas(quotas: Mapping[str, Mapping[str, int]], wild: Sequence[tuple[str, str, float]]) -> None:
    """Both plans are there, their regions are exactly the Wild ones, no quota is above what a region has, and B is at least A."""
    have = Counter(r for _, r, _ in wild)
    for plan, quota in quotas.items():
        if set(quota) != set(have):
            raise ValidationError(f"{plan}: quota regions {sorted(quota)} are not the Wild regions {sorted(have)}")
        over = {r: n for r, n in quota.items() if n > have[r]}
        if over:
            raise ValidationError(f"{plan}: quotas above the samples available: {over}")
    a, b = (quotas[p] for p in quotas if p in ("Plan_A", "Plan_B")) if {"Plan_A", "Plan_B"} <= set(quotas) else list(quotas.values())[:2]
    if any(b[r] < a[r] for r in a):
        raise ValidationError("Plan B asks for fewer samples than Plan A")


def select_plans(per_target: DataFrame, wild: DataFrame, quota_a: Mapping[str, int], quota_b: Mapping[str, int], weights: Mapping[str, float]) -> dict[str, list[Pick]]:
    """Plan A, and Plan B, which starts from it and keeps its gains but has its own quotas."""
    per_target = materialize(per_target, "target-carriers")
    ordered = [(r["SampleID"], r["Region"], r["Target_site_call_rate"]) for r in call_rates(per_target, wild).orderBy("ord").collect()]  # the cohort
    check_quotas({PLANS[0]: quota_a, PLANS[1]: quota_b}, ordered)
    first = greedy(per_target, ordered, quota_a, weights, stage=PLANS[0])
    more = greedy(per_target, ordered, quota_b, weights, first, f"{PLANS[1]}_additional")
    inherited = [Pick(**{**p.__dict__, "stage": "Inherited_from_Greedy_Plan_A", "quota": quota_b[p.region], "step": i}) for i, p in enumerate(first, 1)]
    return {PLANS[0]: first, PLANS[1]: inherited + more}


PLAN_SCHEMA = "Selection_stage string, Plan_step int, SampleID string, Region string, Region_selected_N_after_step int, Region_quota int, Marginal_weighted_score double, Marginal_new_All long, Marginal_new_MAF_le_0_01 long, Marginal_new_0_01_lt_MAF_le_0_05 long, Marginal_new_0_05_lt_MAF_le_0_10 long, Target_site_call_rate double, Tie_break_order_index int"


def plan_frame(spark, picks: Sequence[Pick]) -> DataFrame:
    rows = [(p.stage, p.step, p.sample, p.region, p.region_n, p.quota, float(p.score), sum(p.gains.values()), *[p.gains[b] for b in A.MAF_BINS[:3]], float(p.call_rate), p.order) for p in picks]
    return spark.createDataFrame(rows, PLAN_SCHEMA)


def members(plans: Mapping[str, Sequence[Pick]], spark) -> DataFrame:
    """``(Plan, Step, SampleID, Region)`` of all plans."""
    return spark.createDataFrame([(plan, p.step, p.sample, p.region) for plan, picks in plans.items() for p in picks], "Plan string, Step int, SampleID string, Region string")


def _goals(per_target: DataFrame) -> DataFrame:
    return A.with_all_bin(A.by_threshold(per_target, F.col("Wild_minor_count")))


def recovery(per_target: DataFrame, plan: DataFrame) -> DataFrame:
    """Missing targets that each plan's samples recover, by threshold and bin (and all bins).

    A plan is an array of a few samples, so recovery is an overlap of two
    arrays per target and never a row per carrier.
    """
    spark = per_target.sparkSession
    sets = plan.groupBy("Plan").agg(F.collect_set("SampleID").alias("samples"), F.count("*").alias("Wild_supplement_N"))
    keys = ["AC_threshold", "Wild_minor_count_min", "Wild_MAF_bin"]
    got = _goals(per_target).crossJoin(F.broadcast(sets)).groupBy("Plan", *keys).agg(F.count("*").alias("n"), F.count_if(F.arrays_overlap("carriers", "samples")).alias("r"))
    every = sets.select("Plan", "Wild_supplement_N").crossJoin(A.thresholds(spark)).crossJoin(A.maf_bins(spark, with_all=True))
    n, r = F.coalesce("n", F.lit(0)), F.coalesce("r", F.lit(0))
    return every.join(got, ["Plan", *keys], "left").select("Plan", "Wild_supplement_N", *keys, n.alias("Missing_Wild_minor_alleles_total"), r.alias("Recovered_missing_Wild_minor_alleles"), A.rate_or_zero(r, n).alias("Recovery_rate"))


def cumulative_recovery(per_target: DataFrame, plan: DataFrame) -> DataFrame:
    """Targets recovered after each step: each target counts at the first step that carries it, then a running sum over the plan."""
    from pyspark.sql import Window

    spark = per_target.sparkSession
    sets = plan.groupBy("Plan").agg(F.map_from_entries(F.collect_list(F.struct("SampleID", "Step"))).alias("step_of"))
    first = F.array_min(F.transform("carriers", lambda s: F.try_element_at("step_of", s)))
    rows = A.with_all_bin(per_target).crossJoin(F.broadcast(sets)).select("Plan", "Wild_MAF_bin", first.alias("Step")).groupBy("Plan", "Wild_MAF_bin", "Step").agg(F.count("*").alias("n"))
    total = A.with_all_bin(per_target).groupBy("Wild_MAF_bin").agg(F.count("*").alias("t"))
    every = plan.select("Plan", "Step", F.col("SampleID").alias("Selected_sample")).crossJoin(A.maf_bins(spark, with_all=True))
    run = Window.partitionBy("Plan", "Wild_MAF_bin").orderBy("Step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = every.join(rows, ["Plan", "Wild_MAF_bin", "Step"], "left").join(total, "Wild_MAF_bin", "left").withColumn("r", F.sum(F.coalesce("n", F.lit(0))).over(run))
    t = F.coalesce("t", F.lit(0))
    return out.select("Plan", "Step", "Selected_sample", "Wild_MAF_bin", F.col("r").alias("Recovered_missing_Wild_minor_alleles"), t.alias("Missing_Wild_minor_alleles_total"), A.rate_or_zero(F.col("r"), t).alias("Recovery_rate"))


def region_composition(plan: DataFrame, quotas: DataFrame) -> DataFrame:
    """Selected samples against the quota ``(Plan, Region, Quota)`` of each region."""
    got = plan.groupBy("Plan", "Region").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return quotas.join(got, ["Plan", "Region"], "left").select("Plan", "Region", n.alias("Selected_sample_N"), "Quota", (n == F.col("Quota")).alias("Quota_match"))
