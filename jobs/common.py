"""What the jobs share: configuration, log, counted writes."""

from __future__ import annotations

import json
import logging
import sys
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def to_stderr() -> None:
    logging.basicConfig(stream=sys.stderr, level=logging.INFO, format="%(asctime)s %(name)s %(message)s")


def load_config(path: str | Path, known: Sequence[str]) -> dict[str, Any]:
    """The job's JSON configuration; a key that the job does not know is an error."""
    config = json.loads(Path(path).read_text(encoding="utf-8"))
    unknown = sorted(set(config) - set(known))
    if unknown:
        raise ValueError(f"{path}: unknown keys {unknown}; known are {sorted(known)}")
    return config


def write_counted(df: DataFrame, path: str, label: str, partitions: Sequence[str], dynamic: bool = False) -> int:
    """Write ``df`` as Parquet partitioned by ``partitions`` and log its rows, counted while they are written.

    With ``dynamic`` only the partitions that ``df`` has are replaced, else the whole table.
    """
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if dynamic else "static")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    n = seen.get["n"]
    log.info("%s: wrote %d rows to %s", label, n, path)
    return n
