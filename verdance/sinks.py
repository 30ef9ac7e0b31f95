"""Writers of result tables."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from verdance.functions import alleles as A
from verdance.operators.checks import ValidationError

#: Places of known names in the tables, before any other value.
RANK = {n: i for i, n in enumerate(["Ex_situ", "all", "AC_ge_2", "AC_ge_3", *A.MAF_BINS, *A.ALT_BINS])}


def shown(value: Any) -> str:
    """NA for nothing and for no number, 17 digits for floats."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return "NA"
    return f"{value:.17g}" if isinstance(value, float) else str(value)


def prepare_output(root: Path, step: str, config: dict) -> Path:
    """A step's empty folder with the configuration in it; a folder that holds anything is an error."""
    out = root / step
    if out.exists() and any(out.iterdir()):
        raise ValidationError(f"Output step is not empty: {out}")
    out.mkdir(parents=True, exist_ok=True)
    (out / "config.used.json").write_text(json.dumps(config, indent=2, default=str) + "\n", encoding="utf-8")
    return out


def write_tsv(df: DataFrame, path: Path, header: Sequence[str] | None = None, order: Sequence[str] = (), all_last: bool = False) -> None:
    """A small result as one file, in the order of ``order``, with the usual names of bins and thresholds in their order."""
    columns = list(header or df.columns)
    rows = [dict(zip(columns, r)) for r in df.collect()]

    def key(row: dict) -> list:
        values = [row[c] for c in order]
        return [(-1 if v == "All" and not all_last else 99 if v == "All" else RANK.get(v, 50), v if isinstance(v, (int, float)) and not isinstance(v, bool) else 0, str(v)) for v in values]

    rows = sorted(rows, key=key) if order else rows
    with path.open("w", encoding="utf-8", newline="") as f:
        for line in [columns, *([shown(r[c]) for c in columns] for r in rows)]:
            f.write("\t".join(line) + "\r\n")


def write_items(items: Sequence[tuple[str, Any]], path: Path) -> None:
    with path.open("w", encoding="utf-8", newline="") as f:
        f.write("".join(f"{k}\t{shown(v)}\r\n" for k, v in [("Item", "Value"), *items]))


def write_sites(df: DataFrame, path: Path) -> None:
    """A table that grows with the sites, as a folder of gzip parts that the readers take for the file."""
    df.write.options(sep="\t", header=True, compression="gzip", nullValue="NA").mode("errorifexists").csv(str(path))


def write_counters(row: DataFrame, path: Path) -> dict:
    got = row.first().asDict()
    path.write_text(json.dumps(got, indent=2) + "\n", encoding="utf-8")
    return got
