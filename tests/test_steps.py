"""A whole study from files to validated results, and what breaks one."""

import json

import pytest
import study

from verdance.config import load_config
from verdance.operators.checks import ValidationError
from verdance.plans import steps
from verdance.sources import tables


def table(root, step, file):
    lines = (root / "results" / step / file).read_text().splitlines()
    names = lines[0].split("\t")
    return [dict(zip(names, x.split("\t"))) for x in lines[1:]]


def items(root, step, file):
    return {r["Item"]: r["Value"] for r in table(root, step, file)}


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("study")
    steps.run(spark, load_config(study.build(root)))
    return root


def test_representation(done):
    got = items(done, steps.NAMES[0], "09.internal_check.tsv")
    assert [got[k] for k in ("Total_wild_SNP_minor_alleles", "Combined_exsitu_retained", "Combined_exsitu_missing", "AC_ge_2_missing", "AC_ge_3_missing")] == ["6", "4", "2", "2", "2"]
    both = next(r for r in table(done, steps.NAMES[0], "06.resource_garden_complementarity_summary.tsv") if r["Wild_MAF_bin"] == "All")
    assert (both["Still_missing_from_all_ex_situ"], both["Recovered_by_TG_RG_or_ZD_RG"]) == ("2", "3")
    bins = table(done, steps.NAMES[0], "02.wild_minor_allele_retention_by_MAF_bin.tsv")
    assert len(bins) == 16 and bins[0]["Missing_rate"] == "NA"


def test_core_and_states(done):
    got = items(done, steps.NAMES[4], "09.internal_check.tsv")
    assert (got["Exsitu_core_size"], got["Exsitu_low_priority_size"]) == ("3", "1")
    alt = next(r for r in table(done, steps.NAMES[5], "01.deredundancy_ALT_coverage_summary.tsv") if r["Current_ALT_freq_bin"] == "All")
    assert [alt[k] for k in ("Current_ex_situ_observed_ALT_states", "ALT_states_retained_in_core", "Current_ex_situ_ALT_copies", "Current_ALT_copies_covered_by_core_presence")] == ["4", "3", "9", "8"]


def test_selection_and_control(done):
    got = items(done, steps.NAMES[6], "08.internal_check.tsv")
    assert (got["Greedy_Plan_A_size"], got["Greedy_Plan_B_size"], got["Plan_A_is_subset_of_Plan_B"]) == ("2", "4", "True")
    plan = table(done, steps.NAMES[6], "02.Greedy_Plan_B_Wild_supplements.tsv")
    assert [r["SampleID"] for r in plan] == ["W1", "W4", "W2", "W6"] and plan[0]["Selection_stage"] == "Inherited_from_Greedy_Plan_A" and plan[2]["Marginal_new_All"] == "0"
    assert "Marginal_new_0.01_lt_MAF_le_0.05" in plan[0]
    assert items(done, steps.NAMES[7], "05.internal_check.tsv")["Distribution_rows"] == "200"


def test_quality_and_portfolios(done):
    qc = {r["Plan"]: r for r in table(done, steps.NAMES[8], "02.selected_Wild_QC_summary_by_plan.tsv")}["Greedy_Plan_B"]
    assert (qc["Selected_with_ROH_gt_2Mb_N"], qc["Repeated_PIHAT_component_N"]) == ("0", "0")
    assert all(r["Status"] == "PASS" for r in table(done, steps.NAMES[9], "03.anchor_validation.tsv"))
    counted = json.loads((done / "results" / steps.NAMES[9] / "02.loss_and_rescue.json").read_text())
    assert counted["core_added_loss"] == 1
    held = table(done, "validation", "02.cross_step_invariants.tsv")
    assert len(held) == 15 and all(r["Status"] == "PASS" for r in held)


def test_counters_come_from_the_passes(done):
    one, four, six, seven = (items(done, steps.NAMES[k], f) for k, f in ((0, "09.internal_check.tsv"), (3, "05.internal_check.tsv"), (5, "04.internal_check.tsv"), (6, "08.internal_check.tsv")))
    assert one["AC_AN_rows_scanned"] == four["ACAN_rows_scanned"] == "6"
    assert [four[k] for k in ("Missing_targets_matched_in_VCF", "VCF_target_rows", "VCF_target_rows_with_DP", "VCF_target_rows_with_GQ")] == ["2"] * 4
    assert [six[k] for k in ("VCF_sites_processed", "Total_ALT_records", "SNP_observed_ALT_states", "SNP_retained_ALT_states")] == ["6", "6", "4", "3"]
    assert (seven["Plan_A_quota_total"], seven["Plan_B_quota_total"]) == ("2", "4")


def test_outputs_are_not_overwritten(spark, done):
    with pytest.raises(ValidationError, match="not empty"):
        steps.run(spark, load_config(done / "config/study.json"), ["06"])


def test_edge_rows(spark, tmp_path):
    steps.run(spark, load_config(study.build(tmp_path, edge_rows=True)), ["05", "06"])
    alt = next(r for r in table(tmp_path, steps.NAMES[5], "01.deredundancy_ALT_coverage_summary.tsv") if r["Current_ALT_freq_bin"] == "All")
    want = {"Current_ex_situ_observed_ALT_states": 6, "ALT_states_retained_in_core": 4, "ALT_states_lost_after_deredundancy": 2, "Current_ex_situ_ALT_copies": 11, "Current_ALT_copies_covered_by_core_presence": 9}
    assert {k: int(alt[k]) for k in want} == want


def test_readers_reject(spark, tmp_path):
    put = study.put
    with pytest.raises(ValidationError, match="twice"):
        tables.read_sample_list(spark, put(tmp_path / "a.txt", "x\n x \n"))
    with pytest.raises(ValidationError, match="no allele counts"):
        tables.read_acan(spark, put(tmp_path / "b.tsv", "chr1\t1\t3\t2\n"), "g")
    with pytest.raises(ValidationError, match="no allele counts"):
        tables.read_acan(spark, put(tmp_path / "c.tsv", "CHROM\tPOS\tAC\tAN\nCHROM\tPOS\tAC\tAN\n"), "g")
    ok = tables.read_acan(spark, put(tmp_path / "d.tsv", "\nchr1\t007\t1\t2\textra\n\n"), "g").collect()
    assert [tuple(r) for r in ok] == [("g", "chr1", "007", 1, 2)]
