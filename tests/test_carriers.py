"""Carrier caches of hexadecimal bits against plain Python numbers."""

import gzip
import json
import random
import shutil

import pytest
import study

from verdance.config import load_config
from verdance.operators.checks import ValidationError
from verdance.plans import steps
from verdance.sources import carriers, tables

N = 70_000
WILD = ["W3", "W1", "W2", "W9"]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    """Targets in a shuffled file, and the targets of each sample: across several bitmaps, none, the last one, a single low one."""
    root, rng = tmp_path_factory.mktemp("bits"), random.Random(4)
    positions = rng.sample(range(10 * N), N)
    path = study.put(root / "missing.tsv.gz", "CHROM\tPOS\tWild_minor_allele\tWild_minor_count\tWild_minor_MAF\n" + "".join(f"chr{p % 3}\t{p}\tALT\t2\t0.02\n" for p in positions))
    held = {"W3": set(rng.sample(range(N), 9000)), "W1": set(), "W2": {N - 1, 40_000}, "W9": {3}}
    return root, path, positions, held


def document(held, **other):
    bits = {s: hex(sum(1 << i for i in x)) for s, x in held.items()}
    return json.dumps({"format_version": 1, "missing_table": "x", "target_count": N, "wild_sample_order": WILD, "sample_bits_hex": bits, "called_sites": dict.fromkeys(WILD, 0), **other})


def test_targets_are_numbered_in_the_order_of_the_file(spark, given):
    _, path, positions, _ = given
    got = carriers.numbered_targets(tables.read_missing_targets(spark, path)).select("POS", "idx").collect()
    assert {r.idx: int(r.POS) for r in got} == dict(enumerate(positions))


def test_numbers_of_several_files_follow_their_names(spark, tmp_path):
    for k, n in enumerate((5, 0, 300, 2)):
        study.put(tmp_path / f"t/part-{k}.tsv", "A\n" + "".join(f"{k}-{i}\n" for i in range(n)))
    got = carriers.numbered_targets(tables.read_tsv(spark, str(tmp_path / "t"))).orderBy("idx").collect()
    assert [r.A for r in got] == [f"{k}-{i}" for k, n in enumerate((5, 0, 300, 2)) for i in range(n)] and [r.idx for r in got] == list(range(307))


def test_read_and_written_as_python_does(spark, given):
    root, path, positions, held = given
    with gzip.open(root / "cache.json.gz", "wt") as f:
        f.write(document(held))
    targets = carriers.numbered_targets(tables.read_missing_targets(spark, path))
    per = carriers.read_carrier_cache(spark, str(root / "cache.json.gz"), targets, WILD)
    rows = per.collect()
    assert len(rows) == N
    want = {p: sorted(s for s, x in held.items() if i in x) for i, p in enumerate(positions)}
    assert {int(r.POS): r.carriers for r in rows} == want
    wild = spark.createDataFrame([(s, i) for i, s in enumerate(WILD)], "sample_id string, ord int")
    carriers.write_carrier_cache(per.withColumn("called", per.carriers), targets, wild, "x", str(root / "out.json.gz"))
    [part] = (root / "out.json.gz").glob("part-*")
    back = json.loads(gzip.open(part, "rt").read())
    assert back == json.loads(document(held, called_sites={s: len(x) for s, x in held.items()}))
    assert list(back) == sorted(back)


@pytest.mark.parametrize("other, message", [
    ({"format_version": 2}, "format 1"), ({"wild_sample_order": WILD[::-1]}, "another order"), ({"target_count": 5}, "5 targets"),
    ({"sample_bits_hex": {"W3": "0x1"}}, "not those"), ({"sample_bits_hex": {**dict.fromkeys(WILD, "0x0"), "W1": "0xg"}}, "no hexadecimal"),
    ({"sample_bits_hex": {**dict.fromkeys(WILD, "0x0"), "W1": hex(1 << N)}}, "beyond"),
])
def test_caches_that_do_not_fit(spark, given, tmp_path, other, message):
    path = study.put(tmp_path / "c.json", document({s: set() for s in WILD}, **other))
    with pytest.raises(ValidationError, match=message):
        carriers.read_carrier_cache(spark, path, carriers.numbered_targets(tables.read_missing_targets(spark, given[1])), WILD)


def test_documents_have_a_bound(spark, given, monkeypatch):
    monkeypatch.setattr(carriers, "LIMIT", 10)
    targets = carriers.numbered_targets(tables.read_missing_targets(spark, given[1]))
    with pytest.raises(ValidationError, match="too many"):
        carriers.write_carrier_cache(targets, targets, spark.createDataFrame([("W1", 1)], "sample_id string, ord int"), "x", "unused")


def test_the_control_step_runs_on_either_cache(spark, tmp_path):
    config = load_config(study.build(tmp_path))
    steps.run(spark, config, ["01", "05", "07", "08"])
    out = tmp_path / "results" / steps.NAMES[7]
    first = (out / "01.region_matched_random_recovery_distribution.tsv").read_text()
    out.rename(tmp_path / "results" / "first")
    shutil.move(tmp_path / "results" / steps.NAMES[6] / steps.CARRIERS, tmp_path / "elsewhere")
    steps.run(spark, config, ["08"])
    assert (out / "01.region_matched_random_recovery_distribution.tsv").read_text() == first
