"""A small study: six wild samples, four of the collection, six targets."""

import gzip
import json
from pathlib import Path

WILD, COLLECTION = [f"W{i}" for i in range(1, 7)], [f"E{i}" for i in range(1, 5)]
GARDEN = {"E1": "Pingshun", "E2": "Pingshun", "E3": "Tongguan", "E4": "Zhendong"}
REGION = {"W1": "Qinling", "W2": "Qinling Mountains", "W3": "qinling_mountain", "W4": "Lvliang", "W5": "Lvliang Mountain", "W6": "Taihang"}
NAMES = {"Qinling Mountains": ["W1", "W2", "W3"], "Lvliang Mountain": ["W4", "W5"], "Taihang Mountains": ["W6"]}
#: Copies by site: who is not named is 0/0.
SITES = [
    {"W1": "0/1", "E2": "0/1"},
    {"W2": "0/1", "W3": "0|1", "E3": "1/1"},
    {"W6": "0/1", "E4": "1/1"},
    {"W5": "1/1", "E3": "1/1", "E4": "1/1"},
    {"W1": "1/1", "W4": "0/1"},
    {"W1": "0/1", "W4": "0/1", "W5": "0/1"},
]
MISSING = [4, 5]
EDGE_ROWS = [(7, "T", "C,*", ["1/.", "2/2", "0/0", "0/0"]), (8, "a", "g", ["0/0", "1/.", "0/0", "0/0"]), (9, "A", "A", ["1/1", "1/1", "0/0", "0/0"])]


def record(pos, ref, alt, cells, fmt="GT"):
    return "\t".join(["chr1", str(pos), ".", ref, alt, ".", "PASS", ".", fmt, *cells]) + "\n"


def header(samples):
    return "##fileformat=VCFv4.2\n" + "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]) + "\n"


def put(path: Path, text: str):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") if path.suffix == ".gz" else path.open("w") as f:
        f.write(text)
    return str(path)


def counts(samples, sites):
    out = "CHROM\tPOS\tALT_AC\tAN\n"
    for i in sites:
        ac = sum(SITES[i].get(s, "0/0").replace("|", "/").count("1") for s in samples)
        out += f"chr1\t{i + 1}\t{ac}\t{2 * len(samples)}\n"
    return out


def build(root: Path, edge_rows=False, **parameters) -> str:
    every = range(len(SITES))
    groups = {"wild": WILD, "ex_situ": COLLECTION, **{g.lower(): [s for s in COLLECTION if GARDEN[s] == g] for g in ("Pingshun", "Tongguan", "Zhendong")}}
    lists = {g: put(root / f"lists/{g}.txt", "\n".join(s) + "\n\n") for g, s in groups.items()}
    acan = {g: put(root / f"acan/{g}.tsv.gz", counts(s, every)) for g, s in groups.items()}
    region = {r: put(root / f"acan/{r.replace(' ', '_')}.tsv.gz", counts(s, MISSING)) for r, s in NAMES.items()}
    meta = "SampleID\tMaterial_type\tEx_situ_site\tRegion\tOriginal_province\tOriginal_city\tOriginal_county\n"
    meta += "".join(f"{s}\tWild\tNA\t{REGION[s]}\tp\tc\tnone\n" for s in WILD) + "".join(f"{s}\tEx-situ\t{GARDEN[s]}\tNA\tNA\tNA\tNA\n" for s in COLLECTION)
    full = header(WILD + COLLECTION) + "".join(record(i + 1, "A", "C", [SITES[i].get(s, "0/0") for s in WILD + COLLECTION]) for i in every)
    extra = "".join(record(p, r, a, ["0/0"] * 6 + cells) for p, r, a, cells in EDGE_ROWS) if edge_rows else ""
    deep = header(WILD) + "".join(record(i + 1, "A", "C", [f"{SITES[i].get(s, '0/0')}:{10 + k}:{90 + k}" for k, s in enumerate(WILD)], "GT:DP:GQ") for i in MISSING)
    config = {
        "project_root": str(root), "output_root": "results",
        "inputs": {
            "metadata": put(root / "meta.tsv", meta), "sample_lists": lists, "acan": acan, "region_acan": region, "missing_site_vcf": put(root / "missing.vcf.gz", deep),
            "pass_snp_vcf": put(root / "pass.vcf.gz", full + extra), "diversity_snp_vcf": put(root / "diversity.vcf.gz", full),
            "pairwise_pihat": put(root / "pairs.tsv", "IID1\tIID2\tPI_HAT\nE1\tE2\t0.85\nW4\tW5\t0.82\nW1\tW2\t0.40\n"),
            "roh_sample_summary": put(root / "roh.tsv", "SampleID\tNSEG_2_5Mb\tNSEG_gt5Mb\n" + "".join(f"{s}\t0\t0\n" for s in WILD + COLLECTION)),
        },
        "parameters": {
            "region_sample_counts": {r: len(s) for r, s in NAMES.items()}, "greedy_maf_weights": {"MAF_le_0.01": 1.0, "0.01_lt_MAF_le_0.05": 2.0, "0.05_lt_MAF_le_0.10": 2.0},
            "random_control": {"n_permutations": 20, "seed": 123, "legacy_rng_compatibility": True}, **parameters,
        },
        "expected_portfolios": {"target_total": 6, "Current_missing": 2, "Core_missing": 3, "Plan_A_missing": 0, "Plan_B_missing": 0, "core_added_loss": 1, "Plan_A_rescued_loss": 1, "Plan_B_rescued_loss": 1, "Plan_A_recovered_original": 2, "Plan_B_recovered_original": 2},
    }
    quota = "Plan\tRegion\tSample_N\n" + "".join(f"{p}\t{r}\t{n}\n" for p, ns in (("Plan_A_basic", (1, 1, 0)), ("Plan_B_expanded", (2, 1, 1))) for r, n in zip(NAMES, ns))
    put(root / "config/regional_quotas.tsv", quota)
    return put(root / "config/study.json", json.dumps(config))
