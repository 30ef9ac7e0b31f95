"""Counts inside records against the long operators, and the order check against a plain reading of the file."""

import random

import pytest
from compare import same
from pyspark.sql import functions as F

from verdance.operators import altstates, checks, inrecord, portfolios, selection
from verdance.operators.checks import ValidationError
from verdance.sources import vcf

NAMES = [f"s{i}" for i in range(12)]
CLASSES = [("s0", True, "P"), ("s1", True, "T"), ("s2", False, "P"), ("s3", False, "T"), ("s4", False, "Z"), ("s5", False, "P")]
RECORDS = "row_index long, chrom string, pos string, ref string, alt string, format string, cells array<string>"


def records(spark, seed, n=150, biallelic=False, strict=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        alt = "C" if biallelic else rng.choice(["C", "C,G", "g", "A", "C,*,T", "CT,G"])
        k = alt.count(",") + 1
        fmt = rng.choice(["GT", "GT:DP:GQ"] if i % 3 else ["DP:GT", "GT:DP"])

        def gt():
            codes = [str(rng.randint(0, k)) if rng.random() < 0.8 else "." for _ in range(2 if strict or rng.random() < 0.9 else rng.choice([1, 3]))]
            out = rng.choice("/|").join(codes)
            return out if strict or rng.random() < 0.95 else rng.choice(["x/1", ".", "1/x", ""])

        cells = []
        for _ in NAMES:
            parts = {"GT": gt(), "DP": str(rng.randint(0, 40)), "GQ": "99"}
            whole = ":".join(parts[f] for f in fmt.split(":"))
            cells.append(whole if strict or rng.random() < 0.97 else whole.split(":")[0] if not fmt.startswith("DP") else "7")
        rows.append((i, f"chr{i % 3}", str(1000 + i), "A", alt, fmt, cells))
    return spark.createDataFrame(rows, RECORDS).repartition(3)


def rows(df):
    columns = sorted(df.columns)
    return sorted((tuple(str(r[c]) for c in columns) for r in df.collect()))


@pytest.mark.parametrize("partial", [True, False])
def test_states_equal_the_long_operator(spark, partial):
    rec = records(spark, 1)
    classes = spark.createDataFrame(CLASSES, "sample_id string, in_core boolean, garden string")
    long = altstates.state_counts(vcf.calls(rec, NAMES, [c[0] for c in CLASSES]), classes, partial)
    short = altstates.state_counts_in_record(rec, NAMES, CLASSES, partial)
    assert rows(short) == rows(long.select(short.columns)) and short.count() > 100
    assert {f.name: f.dataType for f in short.schema} == {f.name: f.dataType for f in long.schema}
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    nobody = altstates.state_counts_in_record(rec, NAMES, [c for c in CLASSES if c[1]], partial)
    assert nobody.where("low_copies > 0 or size(low_gardens) > 0").isEmpty()


def test_presence_equals_the_long_operator(spark):
    rec = records(spark, 2, biallelic=True, strict=True)
    members = [("Current", s) for s in NAMES[:6]] + [("Core", s) for s in NAMES[:2]] + [("Plan_A", s) for s in (*NAMES[:2], "s7")] + [("Plan_B", s) for s in (*NAMES[:2], "s7", "s8")]
    wild = NAMES[6:]
    long = portfolios.presence(vcf.calls(rec, NAMES, NAMES), spark.createDataFrame([(s,) for s in wild], "sample_id string"), spark.createDataFrame(members, "portfolio string, sample_id string"))
    short = portfolios.presence_in_record(rec, NAMES, wild, members)
    assert rows(short) == rows(long) and short.count() > 50
    assert "hashpartitioning" not in short._jdf.queryExecution().executedPlan().toString()


def test_carriers_equal_the_long_operator(spark):
    rec = records(spark, 3, biallelic=True)
    goal = [(r.chrom, r.pos, "ALT" if i % 2 else "REF", 1 + i % 3, "MAF_le_0.01") for i, r in enumerate(rec.orderBy("row_index").collect()) if i % 4]
    missing = spark.createDataFrame([*goal, ("chrX", "1", "ALT", 1, "MAF_gt_0.10")], "CHROM string, POS string, Wild_minor_allele string, Wild_minor_count int, Wild_MAF_bin string")
    wild = ["s11", "s3", "s10", "s7"]
    long = selection.carriers_and_calls(vcf.calls(rec, NAMES, wild), missing)
    short = selection.carriers_in_record(rec, NAMES, wild, missing)
    assert rows(short) == rows(long) and short.count() == len(goal) + 1


def test_faults_are_errors(spark):
    one = lambda gt, fmt="GT", alt="C": spark.createDataFrame([(0, "c", "1", "A", alt, fmt, [gt])], RECORDS)
    run = lambda df, reading: inrecord.group_counts(df, ["s"], {"g": ["s"]}, reading).collect()
    assert [tuple(r)[4:] for r in run(one("0/2", alt="C,G"), inrecord.STRICT)] == [(2, [1, 0, 1])]
    for df, reading in ((one("0/2"), inrecord.LENIENT), (one("x/1"), inrecord.STRICT), (one("7", "DP:GT"), inrecord.STRICT), (one("7", "DP"), inrecord.LENIENT), (one("0/5"), inrecord.DIPLOID)):
        with pytest.raises(Exception, match="genotype|FORMAT"):
            run(df, reading)
    assert run(one("7", "DP:GT"), inrecord.LENIENT)[0].g_AN == 0
    with pytest.raises(ValidationError, match="absent"):
        inrecord.group_counts(one("0/1"), ["s"], {"g": ["t"]}, inrecord.LENIENT)
    assert inrecord.group_counts(one("0/1"), ["s"], {"g": [], "h": ["s"]}, inrecord.LENIENT).select("g_AN", "h_AN").first() == (0, 2)
    assert inrecord.group_counts(one("0/1").where("false"), ["s"], {"g": ["s"]}, inrecord.LENIENT).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_order_check_is_plain_reading(spark, seed):
    rng = random.Random(seed)
    file = [(rng.choice(["hot"] * 8 + ["b", "c"]) if seed else f"chr{i // 90}", rng.randint(0, 60) if seed else i, i) for i in range(400)]
    last, want = {}, set()
    for c, p, r in file:
        if c in last:
            if p <= last[c][0]:
                want.add((c, p, r, "unsorted_or_duplicate"))
            elif r != last[c][1] + 1:
                want.add((c, p, r, "noncontiguous_chromosome"))
        last[c] = (p, r)
    df = spark.createDataFrame(file, "chrom string, pos_n long, row_index long").repartition(5)
    assert {tuple(r) for r in checks.order_violations(df).collect()} == want and bool(want) == bool(seed)
    assert {tuple(r) for r in checks.unsorted_positions(df).collect()} == {w[:3] for w in want if w[3][0] == "u"}
    assert checks.order_violations(df.where("false")).collect() == []
