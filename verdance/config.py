"""The JSON configuration of a study, with its defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

LISTS = {"Wild": "wild", "Ex_situ": "ex_situ", "Pingshun": "pingshun", "Tongguan": "tongguan", "Zhendong": "zhendong"}
#: Older names of inputs that a configuration may use at its top level.
FLAT = {"Wild": "wild", "Ex_situ": "exsitu", "Pingshun": "pingshun", "Tongguan": "tongguan", "Zhendong": "zhendong"}


@dataclass
class Config:
    """Paths are resolved against ``project_root``, which is relative to the working directory unless ``root`` is given."""

    raw: dict[str, Any]
    root: Path
    folder: Path
    parameters: dict[str, Any] = field(default_factory=dict)

    @property
    def inputs(self) -> dict[str, Any]:
        return self.raw.get("inputs", {})

    def resolve(self, value: str | Path) -> str:
        return str(value) if "://" in str(value) or Path(value).is_absolute() else str(self.root / value)

    def input(self, *names: str) -> str:
        """The first of the named inputs that is set."""
        for n in names:
            if self.inputs.get(n):
                return self.resolve(self.inputs[n])
        raise KeyError(f"configuration lacks the input {names[0]}")

    def sample_list(self, group: str) -> str:
        nested = (self.inputs.get("sample_lists") or {}).get(LISTS[group])
        return self.resolve(nested) if nested else self.input(f"{FLAT[group]}_samples")

    def acan(self, group: str) -> str:
        nested = (self.inputs.get("acan") or {}).get(LISTS[group])
        return self.resolve(nested) if nested else self.input(f"{FLAT[group]}_acan")

    @property
    def regional_acan(self) -> dict[str, str]:
        return {k: self.resolve(v) for k, v in (self.inputs.get("region_acan") or self.inputs.get("regional_acan") or {}).items()}

    @property
    def output(self) -> Path:
        return Path(self.resolve(self.raw.get("outputs_root", self.raw.get("output_root", "results"))))

    @property
    def quotas(self) -> str:
        named = (self.raw.get("package_files") or {}).get("regional_quotas")
        local = self.folder / "regional_quotas.tsv"
        return self.resolve(named) if named else str(local if local.is_file() else self.root / "config/regional_quotas.tsv")


def load_config(path: str | Path, root: str | Path | None = None) -> Config:
    """Read a configuration; unknown keys stay in ``raw``."""
    path = Path(path).expanduser().resolve()
    raw = json.loads(path.read_text(encoding="utf-8"))
    if not isinstance(raw, dict) or not isinstance(raw.get("inputs", {}), dict) or not isinstance(raw.get("parameters", {}), dict):
        raise ValueError(f"a configuration is an object with objects inputs and parameters: {path}")
    p = raw.get("parameters", {})
    control = p.get("random_control") or {}
    defaults = {
        "pihat_thresholds": p.get("pihat_thresholds", [0.90, 0.80, 0.70, 0.50]),
        "operational_pihat": float(p.get("operational_pihat", p.get("operational_pihat_threshold", 0.80))),
        "greedy_weights": p.get("greedy_weights", p.get("greedy_maf_weights", {})),
        "n_permutations": int(control.get("n_permutations", p.get("random_permutations", 1000))),
        "seed": int(control.get("seed", p.get("random_seed", 20260620))),
        "burn": bool(control.get("legacy_rng_compatibility", p.get("legacy_random_stream_burn_all_wild", True))),
        "strict_carrier_DP_GQ": bool(p.get("strict_carrier_DP_GQ", True)),
        "low_call_rate": float(p.get("selected_low_call_rate_threshold", 0.60)),
        "region_sample_counts": p.get("region_sample_counts", {}),
        "ploidy": int(p.get("ploidy", 2)),
        "allow_partial": bool(p.get("alt_coverage_allow_partial_genotypes", True)),
        "validate_known_results": bool(p.get("validate_known_results", False)),
        "expected_random_gain_pp": p.get("expected_random_gain_pp", {}),
        "random_gain_tolerance_pp": float(p.get("random_gain_validation_tolerance_pp", 0.02)),
    }
    base = Path(root) if root else Path(raw.get("project_root", ".")).expanduser()
    return Config(raw, base.resolve(), path.parent, defaults)
